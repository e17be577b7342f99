"""Quality by a generalised additive model with pairwise interactions: lookup tables learned by cyclic boosting."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import documents, map_batches, texts
from sightline.llm.labels import SAMPLE, fold, gather, labelled, sigmoid
from sightline.llm.registry import query

FEATURES = (
    "log_words", "word_length", "word_spread", "distinct_share", "common_share", "top_word_share", "repeat_share", "log_lines", "line_repeat_share",
    "line_words", "upper_share", "digit_share", "symbol_share", "pipe_share", "mark_share", "stop_share", "other_share", "symbol_words", "one_letter_words", "cycle_share",
)
BINS = 32
#: The predicted class is 1 from this score on.
THRESHOLD = 0.3


def features(text: str) -> list[float]:
    """What a text's form says of it; nothing depends on the language or on single words."""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(raw) - int(counts[32] + counts[10]))
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    most = max(seen.values(), default=0)
    upper, digits = counts[65:91].sum(), counts[48:58].sum()
    marks = counts[33] + counts[44] + counts[46] + counts[63] + counts[58] + counts[59]
    symbols = counts[33:127].sum() - counts[65:91].sum() - counts[97:123].sum() - digits - marks - counts[124]
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    odd = sum(not (w[-1].isalnum() or w[-1] in ".,;:?!\"')") for w in words)
    return [
        np.log1p(len(words)), float(lengths.mean()), float(lengths.std()), len(seen) / n, sum(c for c in seen.values() if c >= 3) / n, most / n, repeats / n,
        np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(words) / max(1, len(lines))), upper / size, digits / size, symbols / size,
        counts[124] / size, marks / size, counts[46] / n, counts[128:].sum() / size, odd / n, float((lengths == 1).mean()), cycle(words),
    ]


def cycle(words: list[str]) -> float:
    """The share of words whose sequence of three occurred before."""
    if len(words) < 6:
        return 0.0
    codes: dict[str, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    size = len(codes)
    threes = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    return 1 - len(np.unique(threes)) / len(threes)


@dataclass
class Model:
    """Bin edges and a table for each feature, a table for each chosen pair of features."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    single: np.ndarray | None = None
    pairs: list[tuple[int, int]] = field(default_factory=list)
    double: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Sums of table entries, by bins: no tree is walked."""
        b = self.bins(x)
        total = np.full(len(x), self.base)
        if self.single is not None:
            for j in range(b.shape[1]):
                total += self.single[j, b[:, j]]
            for (i, j), table in zip(self.pairs, self.double):
                total += table[b[:, i], b[:, j]]
        return sigmoid(total)


def cuts(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Leaf values, for each bin, of a tree of few leaves on one binned feature, grown by the best cut each time."""
    g, h = np.concatenate(([0.0], np.cumsum(grad))), np.concatenate(([0.0], np.cumsum(hess)))
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    borders = [0, len(grad)]
    while len(borders) <= leaves:
        best = None
        for a, b in zip(borders, borders[1:]):
            if b - a > 1:
                m = np.arange(a + 1, b)
                left, right = h[m] - h[a], h[b] - h[m]
                won = np.where((left > 1) & (right > 1), (g[m] - g[a]) ** 2 / (left + ridge) + (g[b] - g[m]) ** 2 / (right + ridge) - gain(a, b), -1.0)
                k = int(np.argmax(won))
                if best is None or won[k] > best[0]:
                    best = (won[k], int(m[k]))
        if best is None or best[0] <= 1e-6:
            break
        borders = sorted([*borders, best[1]])
    out = np.zeros(len(grad))
    for a, b in zip(borders, borders[1:]):
        out[a:b] = -(g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.1, leaves: int = 3, ridge: float = 5.0) -> Model:
    """Cyclic boosting: in each round every feature in turn gets a shallow tree, added to its table; then the best pairs.

    With no rows, or only one class, the model is the share of class 1 with a prior of a half.
    """
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Model(base=float(np.log(share / (1 - share))))
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])]
    if len(np.unique(y)) < 2:
        return model
    b, k = model.bins(x), x.shape[1]
    model.single = np.zeros((k, BINS))
    total = np.full(len(y), model.base)
    for _ in range(rounds):
        for j in range(k):
            p = sigmoid(total)
            step = rate * cuts(np.bincount(b[:, j], p - y, BINS), np.bincount(b[:, j], p * (1 - p), BINS), leaves, ridge)
            model.single[j] += step
            total += step[b[:, j]]
    coarse = b // 4
    width = BINS // 4
    p = sigmoid(total)
    gains = []
    for i in range(k):
        for j in range(i):
            cell = coarse[:, i] * width + coarse[:, j]
            g, h = np.bincount(cell, p - y, width * width), np.bincount(cell, p * (1 - p), width * width)
            gains.append(((g * g / (h + ridge)).sum(), i, j))
    for _, i, j in sorted(gains, reverse=True)[:n_pairs]:
        model.pairs.append((i, j))
        model.double.append(np.zeros((BINS, BINS)))
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.double):
            p = sigmoid(total)
            step = np.zeros((width, width))
            cell = coarse[:, i] * width + coarse[:, j]
            g = np.bincount(cell, p - y, width * width).reshape(width, width)
            h = np.bincount(cell, p * (1 - p), width * width).reshape(width, width)
            half = cuts(g.sum(1), h.sum(1), 2, ridge)
            for side in np.unique(half):  # a tree of depth two: one feature's cut, then the other's in each part
                own = half == side
                step[own] = cuts(g[own].sum(0), h[own].sum(0), 2, ridge)
            fine = np.repeat(np.repeat(step, 4, 0), 4, 1) * rate
            table += fine
            total += fine[b[:, i], b[:, j]]
    return model


def feature_table(docs: DataFrame, *more: str) -> DataFrame:
    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame([features(t) for t in rows["text"]], columns=FEATURES)
        for name in reversed(("doc_id", *more)):
            out.insert(0, name, rows[name].array)
        return out

    return map_batches(texts(docs, *more), batch, "doc_id bigint, " + "".join(f"{m} int, " for m in more) + ", ".join(f"{f} double" for f in FEATURES))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from a bounded sample of the labelled rows that may be learned from (fold 0 of 5 is held out)."""
    got = gather(feature_table(labelled(docs, labels, "quality", 5, 0, sample), "label"))
    return boost(got[list(FEATURES)].to_numpy(np.float64).reshape(-1, len(FEATURES)), got["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for each row; null texts are scored as empty, very long ones in full, repeated rows alike."""

    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        got = model.score(np.array([features(t) for t in rows["text"]]))
        return pd.DataFrame({"doc_id": rows["doc_id"].array, "score": got, "predicted": (got >= threshold).astype(np.int32)})

    return map_batches(texts(docs), batch, "doc_id bigint, score double, predicted int")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, all columns as they are; nothing is shuffled."""

    @F.pandas_udf("double")
    def rate(batch: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in batch]).reshape(-1, len(FEATURES))))

    return docs.where(rate(F.coalesce("text", F.lit(""))) >= threshold)


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")
