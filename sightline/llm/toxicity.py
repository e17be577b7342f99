"""Toxicity: Levenshtein automata intersected with a trie of learned terms, and windows of context around what they accept."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import documents, map_batches, texts
from sightline.llm.labels import SAMPLE, fold, gather, labelled, logistic, sigmoid
from sightline.llm.registry import query

THRESHOLD = 0.7
#: Terms in the lexicon at most, and the documents of class 1 that a term must be in.
TERMS = 400
SUPPORT = 5
#: Terms of so many letters or more are also found with one letter wrong, missing, added or two swapped.
FUZZY = 5
WINDOW = 6
QUOTES = "\"“”„«»‹›"
# fixed values: words that report speech, words that address a reader
REPORTING = "said says wrote writes called quote quoted quotes word term sagte schrieb nannte zitat dit écrit appelé cité dijo escribió llamó cita".split()
ADDRESS = "you your yours u ur du dich dein deine ihr euch tu toi ton ta vous votre tú usted eres ustedes vosotros".split()
FEATURES = ("exact", "fuzzy", "strongest", "distinct", "density", "quoted", "addressed", "log_words")


# ---------------------------------------------------------------- the automaton


@dataclass
class Automaton:
    """A table of transitions over letter classes; state 0 is dead. ``term`` is the accepted term of a state or -1, ``edits`` its distance."""

    classes: dict[str, int]
    table: np.ndarray
    term: np.ndarray
    edits: np.ndarray


def intersect(terms: list[str], fuzzy: int = FUZZY) -> Automaton:
    """The automaton of all words within the distance of a term: Levenshtein automata run along the trie of all terms.

    A state is a set of (trie node, edits, letter owed by a swap). Short terms are accepted as they are.
    """
    children: list[dict[str, int]] = [{}]
    ends: dict[int, int] = {}
    for k, term in enumerate(terms):
        node = 0
        for c in term:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
            node = children[node][c]
        ends[node] = k
    # the trie is walked with an edit only where a term long enough lies below
    deep = [False] * len(children)

    def mark(node: int, depth: int) -> bool:
        deep[node] = any([mark(child, depth + 1) for child in children[node].values()]) or (node in ends and depth >= fuzzy)
        return deep[node]

    mark(0, 0)
    letters = sorted({c for kids in children for c in kids})

    def closed(states: set) -> frozenset:
        """With letters left out; of one place with several edits the least counts."""
        least: dict[tuple, int] = {}
        for node, edits, owed in states:
            least[node, owed] = min(edits, least.get((node, owed), 9))
        for (node, owed), edits in [*least.items()]:
            if not edits and not owed:
                for child in children[node].values():
                    if deep[child]:
                        least[child, ""] = min(1, least.get((child, ""), 9))
        return frozenset((n, e, o) for (n, o), e in least.items())

    def step(states: frozenset, c: str | None) -> frozenset:
        out = set()
        for node, edits, owed in states:
            if owed:
                if owed == c:
                    out.add((node, 1, ""))
                continue
            kids = children[node]
            if c is not None and c in kids:
                out.add((kids[c], edits, ""))
            if not edits:
                if deep[node]:
                    out.add((node, 1, ""))
                for first, child in kids.items():
                    if deep[child]:
                        if first != c:
                            out.add((child, 1, ""))
                        if c is not None and c in children[child] and deep[children[child][c]]:
                            out.add((children[child][c], 1, first))
        return closed(out)

    start = closed({(0, 0, "")})
    number, todo, rows = {frozenset(): 0, start: 1}, [start], {0: [0] * (len(letters) + 1)}
    while todo:
        states = todo.pop()
        row = []
        for c in [None, *letters]:
            after = step(states, c)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
        rows[number[states]] = row
    term, edits = np.full(len(number), -1), np.zeros(len(number), np.int64)
    for states, i in number.items():
        found = [(e, ends[n]) for n, e, owed in states if not owed and n in ends and (e == 0 or len(terms[ends[n]]) >= fuzzy)]
        if found:
            edits[i], term[i] = min(found)
    table = np.zeros((len(number), len(letters) + 2), np.int32)  # class 0 ends a word
    for i, row in rows.items():
        table[i, 1:] = row
    return Automaton({c: k + 2 for k, c in enumerate(letters)}, table, term, edits)


_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """1 for letters and digits by code point, 0 for the rest."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), np.uint8, 0x110000))
    return _LETTERS[0]


class Matcher:
    """All words of a batch stepped through the automaton side by side, a letter at a time; most die early."""

    def __init__(self, terms: list[str], weights: np.ndarray):
        self.automaton = intersect(terms)
        self.terms, self.weights = terms, weights
        self.classes = letter_table().astype(np.uint8 if len(self.automaton.classes) < 250 else np.uint16)
        for c, k in self.automaton.classes.items():
            self.classes[ord(c)] = k
        marks = np.zeros(0x110000, np.uint8)
        marks[[ord(c) for c in QUOTES]] = 1
        self.quotes = marks

    def features(self, batch: list[str]) -> np.ndarray:
        lowered = [t.lower() for t in batch]
        codes = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = self.classes[codes]
        inside = classes > 0
        starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        ends = np.flatnonzero(np.concatenate(([False], inside[:-1])) & ~inside)
        borders = np.cumsum([0, *[len(t) + 1 for t in lowered]])
        first_word = np.searchsorted(starts, borders)
        out = np.zeros((len(batch), len(FEATURES)))
        out[:, 7] = np.log1p(np.diff(first_word))
        alive, at = np.arange(len(starts)), starts.copy()
        state = np.ones(len(starts), np.int64)
        hits, terms, edits = [], [], []
        auto = self.automaton
        while len(alive):
            over = at == ends[alive]
            if over.any():
                k = auto.term[state[over]]
                good = k >= 0
                hits.append(alive[over][good])
                terms.append(k[good])
                edits.append(auto.edits[state[over]][good])
                alive, at, state = alive[~over], at[~over], state[~over]
            state = auto.table[state, classes[at]]
            on = state > 0
            alive, at, state = alive[on], at[on] + 1, state[on]
        if not hits or not sum(map(len, hits)):
            return out
        word, term, edit = np.concatenate(hits), np.concatenate(terms), np.concatenate(edits)
        doc = np.searchsorted(first_word, word, "right") - 1
        quote_at = np.flatnonzero(self.quotes[codes])
        word_of = lambda w: "".join(map(chr, codes[starts[w] : ends[w]]))
        for d in np.unique(doc).tolist():
            own = doc == d
            w, t, e = word[own], term[own], edit[own]
            lo, hi = first_word[d], first_word[d + 1]
            weight = self.weights[t] * np.where(e > 0, 0.8, 1.0)
            quoted = addressed = 0.0
            for x in w.tolist():
                a, b = max(lo, x - WINDOW), min(hi, x + WINDOW + 1)
                marks = np.searchsorted(quote_at, [starts[a], starts[x], ends[b - 1]])
                near = {word_of(i) for i in range(a, b) if i != x}
                quoted += (marks[1] > marks[0]) and (marks[2] > marks[1]) or bool(near & REPORT)
                addressed += bool(near & YOU)
            out[d, :7] = (
                np.log1p(weight[e == 0].sum()), np.log1p(weight[e > 0].sum()), weight.max(), np.log1p(len(set(t.tolist()))),
                np.log1p(100 * len(w) / (hi - lo)), quoted / len(w), addressed / len(w),
            )
        return out


REPORT, YOU = set(REPORTING), set(ADDRESS)


# ---------------------------------------------------------------- learning


@dataclass
class Model:
    terms: list[str]
    weights: np.ndarray
    coefficients: np.ndarray


def learn_terms(sample: DataFrame, limit: int = TERMS, support: int = SUPPORT) -> tuple[list[str], np.ndarray]:
    """Words that tell class 1: in ``support`` of its documents or more and mostly in them; weighted by their log-odds.

    Documents with the same middle count once, so that copies of one text don't make its words look telling.
    """
    once = sample.dropDuplicates(["label", "_middle"])
    words = once.select("label", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word")).where(F.length("word") >= 3)
    found = words.groupBy("word").agg(F.sum("label").alias("p"), F.count("*").alias("n")).where((F.col("p") >= support) & (F.col("p") > 0.7 * F.col("n")))
    sizes = once.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    best = found.orderBy(F.desc(F.col("p") - 3 * (F.col("n") - F.col("p"))), "word").limit(limit).collect()
    pos, neg = sizes["p"] or 0, sizes["n"] - (sizes["p"] or 0)
    terms = [r["word"] for r in best]
    odds = [np.log((r["p"] + 0.5) / (pos - r["p"] + 0.5)) - np.log((r["n"] - r["p"] + 0.5) / (neg - r["n"] + r["p"] + 0.5)) for r in best]
    return terms, np.array(odds)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Terms and coefficients from a bounded sample of the labelled rows that may be learned from (fold 1 of 3 is held out)."""
    rows = labelled(docs, labels, "toxic", 3, 1, sample)
    rows = rows.withColumn("_middle", F.xxhash64(F.substring(F.col("text"), (F.length("text") / 2).cast("int") + 1, F.lit(80)))).persist()
    terms, weights = learn_terms(rows)
    matcher_of = cached(terms, weights)

    def batch(part: pd.DataFrame) -> pd.DataFrame:
        got = pd.DataFrame(matcher_of().features(part["text"].tolist()), columns=FEATURES)
        got.insert(0, "label", part["label"].array)
        return got

    got = gather(map_batches(rows.select("text", "label"), batch, "label int, " + ", ".join(f"{f} double" for f in FEATURES)))
    rows.unpersist()
    y = got["label"].to_numpy(np.float64)
    if len(np.unique(y)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(terms, weights, np.array([np.log(share / (1 - share)), *np.zeros(len(FEATURES))]))
    return Model(terms, weights, logistic(got[list(FEATURES)].to_numpy(), y, ridge=0.5))


_MATCHERS: dict[tuple, Matcher] = {}


def cached(terms: list[str], weights: np.ndarray):
    """A function that gives the matcher, built once in a Python worker."""
    key = (tuple(terms), weights.tobytes())

    def get() -> Matcher:
        if key not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[key] = Matcher(terms, weights)
        return _MATCHERS[key]

    return get


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of each row; null texts are scored as empty, long ones in full, repeated rows alike; nothing is shuffled."""
    matcher_of = cached(model.terms, model.weights)

    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([matcher_of().features(rows["text"].iloc[a : a + 512].tolist()) for a in range(0, len(rows), 512)])
        got = sigmoid(model.coefficients[0] + x @ model.coefficients[1:])
        return pd.DataFrame({"doc_id": rows["doc_id"].array, "score": got, "predicted": (got >= threshold).astype(np.int32)})

    return map_batches(texts(docs), batch, "doc_id bigint, score double, predicted int")


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")
