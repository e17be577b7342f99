"""Language identification by interpolated Kneser-Ney character models, kept in tables that grow with the texts.

Counts, discounts and back-off weights of every order are Spark aggregates over all grams. The distinct grams of the
texts to be scored meet the model's tables by joins; the most frequent of them are carried to the texts in a sorted hash
array of fixed size, words with any other gram go to the tables. So no model has to fit into a task or the driver.
"""

from __future__ import annotations

import string
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import attach, documents, split_ids, texts, whole_ids
from sightline.llm.labels import fold, logistic_rows, sigmoid
from sightline.llm.registry import query
from sightline.plans.ranks import quantiles
from sightline.plans.storage import materialise

ORDER = 5
#: More languages than this are an error: a row's code lengths are an array with a place for each.
LANGUAGES = 500
#: A run of more letters than this is taken as several words, so that scripts without spaces have words of bounded length.
LETTERS = 32
#: Values (two of the gram and one a language) of the most frequent grams that are broadcast, 32 MB; the others are reached by joins.
HELD = 4_000_000
REMEMBERED = 400_000
#: A text whose confidence is below this, or that fits its language worse than all but 1 in 1,000 training texts, is marked as rejected.
REJECT = 0.5
START, END = 1, 2
#: Bits of a code point: three letters fill ``lo``, the two before them ``hi``.
BITS = 21
NO_LETTERS = string.punctuation + string.digits
MASK = (1 << BITS) - 1


def letters_of(token: str) -> list[str]:
    """The runs of letters in a token, lower-cased, in pieces of at most LETTERS; digits and signs cut."""
    # signs and digits at the ends are what most tokens without a pure run have
    low = token.lower().strip(NO_LETTERS)
    runs = [low] if low.isalpha() else "".join(c if c.isalpha() else " " for c in low).split()
    if len(low) <= LETTERS:
        return runs
    return [w[i : i + LETTERS] for w in runs for i in range(0, len(w), LETTERS)]


def grams(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hi and lo of the gram of ``order`` letters that ends at each letter and at each word's END (START before a word), and the word of each."""
    joined = "".join(w + "\n" for w in words)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(c):
        return c, c, c
    word = np.concatenate(([0], np.cumsum(c == 10)[:-1]))
    c = np.where(c == 10, END, c)
    place = np.arange(len(c)) - np.flatnonzero(np.diff(word, prepend=-1))[word]
    halves = [np.zeros(len(c), np.int64), c]
    for k in range(1, order):
        before = np.concatenate((np.zeros(min(k, len(c)), np.int64), c[:-k]))
        # what lies before a word's first letter is START once, and nothing further left
        letter = np.where(place >= k, before, np.where(place == k - 1, START, 0))
        halves[k < 3] = halves[k < 3] | (letter << (BITS * (k % 3)))
    return halves[0], halves[1], word


def ending(k: int, hi: Column, lo: Column) -> list[Column]:
    """The last ``k`` letters of a gram."""
    if k >= 3:
        return [hi if k >= 5 else hi.bitwiseAND(F.lit(MASK)) if k == 4 else F.lit(0).cast("bigint"), lo]
    return [F.lit(0).cast("bigint"), lo.bitwiseAND(F.lit((1 << (BITS * k)) - 1))]


def context(hi: Column, lo: Column) -> list[Column]:
    """A gram without its last letter."""
    carried = F.call_function("shiftleft", hi.bitwiseAND(F.lit(MASK)), F.lit(2 * BITS))
    return [F.shiftright(hi, BITS), F.shiftright(lo, BITS).bitwiseOR(carried)]


def first_letter(k: int, hi: Column, lo: Column) -> Column:
    """The first letter of a gram of ``k`` letters; 0 if it is shorter."""
    half, at = (lo, k - 1) if k <= 3 else (hi, k - 4)
    return F.shiftright(half, BITS * at).bitwiseAND(F.lit(MASK))


# ---------------------------------------------------------------- counting


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, hi, lo, n): grams of the highest order in all texts of docs (lang, text), summed in each task before the shuffle; a null lang is one of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str | None, Counter] = {}

        def flush():
            for lang, tokens in held.items():
                words: Counter = Counter()
                for token, n in tokens.items():
                    for w in letters_of(token):
                        words[w] += n
                hi, lo, word = grams([*words], order)
                made = pd.DataFrame({"hi": hi, "lo": lo, "n": np.fromiter(words.values(), np.int64, len(words))[word]})
                made = made.groupby(["hi", "lo"], as_index=False)["n"].sum()
                yield pd.DataFrame({"lang": np.full(len(made), lang, object), "hi": made["hi"], "lo": made["lo"], "n": made["n"]})
            held.clear()

        size = 0
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                own = held.setdefault(lang, Counter())
                before = len(own)
                own.update(text.split())
                # long texts weigh more, since whole lines of unspaced scripts are tokens
                size += len(own) - before + len(text) // 1024
                if size > REMEMBERED:
                    yield from flush()
                    size = 0
        yield from flush()

    found = docs.select("lang", "text").mapInPandas(run, "lang string, hi bigint, lo bigint, n bigint")
    return found.groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- the models


@dataclass
class Model:
    """For each order k a table of grams (hi, lo, gain) and one of contexts (hi, lo, rest), with a place in the arrays for each language."""

    languages: list[str]
    gain: list[DataFrame] = field(default_factory=list)
    rest: list[DataFrame] = field(default_factory=list)
    alphabet: int = 64
    worst: np.ndarray = field(default_factory=lambda: np.empty(0))
    calibration: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0, 0.5]))


def kneser_ney(counts: DataFrame, languages: list[str], order: int = ORDER) -> Model:
    """The model of (lang, hi, lo, n), counts of the highest order.

    Below the highest order a gram counts the different letters before it; grams that begin a word
    have none before them and keep their counts. A language and order have one discount, n1 / (n1 + 2 n2).
    """
    hi, lo = F.col("hi"), F.col("lo")
    wide = lambda value, missing: F.array(*[F.coalesce(F.max(F.when(F.col("lang") == lang, F.col(value))), F.lit(missing)) for lang in languages])
    model = Model(languages)
    counts = materialise(counts)
    for k in range(order, 0, -1):
        ones, twos = F.sum((F.col("n") == 1).cast("double")), F.sum((F.col("n") == 2).cast("double"))
        usual = F.least(F.lit(0.95), F.greatest(F.lit(0.1), ones / (ones + 2 * twos)))
        # a row for each language
        discount = F.broadcast(counts.groupBy("lang").agg(F.when(ones > 0, usual).otherwise(F.lit(0.5)).alias("discount")))
        placed = counts.select("lang", "hi", "lo", "n", *[c.alias(f"c_{x}") for c, x in zip(context(hi, lo), ("hi", "lo"))])
        totals = placed.groupBy("lang", "c_hi", "c_lo").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        totals = totals.join(discount, "lang")
        share = placed.join(totals, ["lang", "c_hi", "c_lo"]).withColumn("share", F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total"))
        left = totals.withColumn("left", F.col("discount") * F.col("kinds") / F.col("total"))
        model.gain.insert(0, materialise(share.groupBy("hi", "lo").agg(wide("share", 0.0).alias("gain"))))
        model.rest.insert(0, materialise(left.groupBy(F.col("c_hi").alias("hi"), F.col("c_lo").alias("lo")).agg(wide("left", 1.0).alias("rest"))))
        if k > 1:
            # a gram padded with nothing on the left is the same event in the order below
            n = F.when(first_letter(k, hi, lo) == 0, F.col("n")).otherwise(F.lit(1).cast("bigint"))
            end_hi, end_lo = ending(k - 1, hi, lo)
            counts = materialise(counts.select("lang", n.alias("n"), end_hi.alias("hi"), end_lo.alias("lo")).groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n")))
    model.alphabet = max(64, model.gain[0].count())
    return model


def probabilities(found: DataFrame, model: Model) -> DataFrame:
    """The columns of ``found`` (hi, lo: distinct grams of the highest order) and p, an array with each language's probability of the last letter."""
    order = len(model.gain)
    hi, lo = F.col("hi"), F.col("lo")
    below = None
    for k in range(1, order + 1):
        end_hi, end_lo = ending(k, hi, lo)
        here = found if k == order else found.select(end_hi.alias("hi"), end_lo.alias("lo")).distinct()
        around = [c.alias(x) for c, x in zip(context(hi, lo), ("c_hi", "c_lo"))]
        here = here.select("*", *around).join(model.gain[k - 1], ["hi", "lo"], "left")
        here = here.join(model.rest[k - 1].toDF("c_hi", "c_lo", "rest"), ["c_hi", "c_lo"], "left").drop("c_hi", "c_lo")
        if below is None:
            here = here.withColumn("q", F.array_repeat(F.lit(1.0 / model.alphabet), len(model.languages)))
        else:
            s_hi, s_lo = ending(k - 1, hi, lo)
            here = here.select("*", s_hi.alias("s_hi"), s_lo.alias("s_lo")).join(below.select(hi.alias("s_hi"), lo.alias("s_lo"), F.col("p").alias("q")), ["s_hi", "s_lo"]).drop("s_hi", "s_lo")
        carried = F.when(F.col("rest").isNull(), F.col("q")).otherwise(F.zip_with("rest", "q", lambda r, q: r * q))
        here = here.withColumn("p", F.when(F.col("gain").isNull(), carried).otherwise(F.zip_with("gain", carried, lambda g, q: g + q)))
        below = here.drop("gain", "rest", "q")
    return below


def gram_bits(docs: DataFrame, model: Model, counts: DataFrame | None = None) -> DataFrame:
    """(hi, lo, n, bits) of the distinct grams of all texts of docs: how often, and the last letter's code length under each language.

    ``counts``, if given, are those of ``count_grams`` over the same texts, which are then not read again.
    """
    if counts is None:
        counts = count_grams(docs.select(F.lit("").alias("lang"), "text"), len(model.gain))
    found = materialise(counts.groupBy("hi", "lo").agg(F.sum("n").alias("n")))
    return materialise(probabilities(found, model).select("hi", "lo", "n", F.transform("p", lambda p: -F.log2(p)).alias("bits")))


def word_bits(words: DataFrame, known: DataFrame, model: Model) -> DataFrame:
    """(a, b, bits, letters) of distinct words: 128 bits of the word, its code length under each language, its letters and END."""
    order = len(model.gain)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hi, lo, word = grams(batch["word"].tolist(), order)
            yield pd.DataFrame({"a": batch["a"].to_numpy()[word], "b": batch["b"].to_numpy()[word], "hi": hi, "lo": lo})

    rows = words.select(*hashes(), "word").mapInPandas(run, "a bigint, b bigint, hi bigint, lo bigint")
    total = known.agg(F.sum("n")).first()[0] or 0
    met = attach(rows, known, ["hi", "lo"], ["bits"], "n", total, F.col("a"))
    sums = F.array(*[F.sum(F.col("bits")[j]) for j in range(len(model.languages))])
    return met.groupBy("a", "b").agg(sums.alias("bits"), F.count("*").alias("letters"))


def hashes() -> list[Column]:
    return [F.xxhash64("word").alias("a"), F.xxhash64(F.lit(1), "word").alias("b")]


# ---------------------------------------------------------------- scoring


class Scorer:
    """Code lengths of grams in an array sorted by hash, and those of tokens met before."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, bits: np.ndarray, order: int):
        key = gram_hash(hi, lo)
        by = np.argsort(key)
        self.key, self.hi, self.lo, self.bits, self.order = key[by], hi[by], lo[by], bits[by], order
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, bits.shape[1] + 1))

    def lengths(self, words: list[str]) -> np.ndarray:
        """Bits under each language, and letters, of each word; the letters are 0 if a gram of it isn't held here."""
        out = np.zeros((len(words), self.rows.shape[1]))
        hi, lo, word = grams(words, self.order)
        if not len(word) or not len(self.key):
            return out
        key = gram_hash(hi, lo)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        here = (self.hi[at] == hi) & (self.lo[at] == lo)
        head = np.flatnonzero(np.diff(word, prepend=-1))
        out[:, :-1] = np.add.reduceat(self.bits[at], head)
        out[:, -1] = np.diff(np.append(head, len(word)))
        return np.where(np.logical_and.reduceat(here, head)[:, None], out, 0.0)

    def sums(self, batch: list[str]) -> tuple[np.ndarray, list[Counter]]:
        """Bits and letters of each text, and the words that can't be told from the grams held here."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.rows = self.rows[:0]
        tokens = [t.split() for t in batch]
        new = [*(set().union(*tokens) - self.known.keys())]
        runs = [letters_of(t) for t in new]
        flat = [w for r in runs for w in r]
        many = np.fromiter(map(len, runs), np.int64, len(runs))
        each, owner = self.lengths(flat), np.repeat(np.arange(len(new)), many)
        own = np.zeros((len(new), each.shape[1]))
        np.add.at(own, owner, each)
        missing = {w for w, held in zip(flat, each[:, -1] > 0) if not held}
        # tokens with a word to be looked up elsewhere, and very long ones, are not remembered and come last
        rank = np.fromiter((len(t) > 64 for t in new), np.int64, len(new))
        rank[owner[each[:, -1] == 0]] = 2
        order, start = np.argsort(rank, kind="stable"), len(self.rows)
        table = np.concatenate((self.rows, own[order]))
        self.known.update(zip([new[i] for i in order], range(start, len(table))))
        keep, first_open = start + np.count_nonzero(rank == 0), start + np.count_nonzero(rank < 2)
        out, rest = np.zeros((len(batch), table.shape[1])), []
        for i, t in enumerate(tokens):
            at = np.fromiter(map(self.known.__getitem__, t), np.int64, len(t))
            out[i] = table[at].sum(axis=0)
            words: Counter = Counter()
            for j, n in zip(*np.unique(at[at >= first_open], return_counts=True)):
                for w in runs[order[j - start]]:
                    if w in missing:
                        words[w] += int(n)
            rest.append(words)
        for i in order[keep - start :]:
            del self.known[new[i]]
        self.rows = table[:keep]
        return out, rest


def gram_hash(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """64 bits of a gram; whoever finds one compares the gram itself."""
    x = hi.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ lo.astype(np.uint64)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


_SCORERS: dict[str, Scorer] = {}


def scorer(shared, name: str) -> Scorer:
    """The scorer of the broadcast grams, one in a Python worker."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(*shared.value)
    return _SCORERS[name]


def frequent(known: DataFrame, width: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hi, lo and bits of the most frequent grams, at most ``most``; grams of one frequency all or none.

    Only these reach the driver, as flat columns: a sort with a limit would send it that many rows from every task.
    """
    # a row for each frequency: their sum is the number of grams read, so they are few
    sizes = known.groupBy("n").agg(F.count("*").alias("rows")).toArrow().to_pandas().sort_values("n", ascending=False)
    fits = sizes["n"][sizes["rows"].cumsum() <= most]
    chosen = known.where(F.col("n") >= F.lit(int(fits.min()))) if len(fits) else known.limit(0)
    got = chosen.select("hi", "lo", *[F.col("bits")[j].alias(f"b{j}") for j in range(width)]).toArrow()
    return got["hi"].to_numpy(), got["lo"].to_numpy(), np.column_stack([got[f"b{j}"].to_numpy() for j in range(width)])


def code_lengths(docs: DataFrame, model: Model, counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, _no_id, told, bits, letters) of each row of docs (doc_id, text, told): code length under each language, letters and ENDs.

    The most frequent grams, HELD values in all, are broadcast, and words made of them are summed where the text is read.
    The others go by word to their grams' code lengths, skew-safe, and back by row.
    """
    spark, width = docs.sparkSession, len(model.languages)
    known = gram_bits(docs, model, counts)
    held = frequent(known, width, HELD // (width + 2)) + (len(model.gain),)
    shared, name = spark.sparkContext.broadcast(held), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = scorer(shared, name)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                sums, rest = own.sums(part["text"].tolist())
                yield pd.DataFrame({"rid": part["rid"].array, "doc_id": part["doc_id"].array, "_no_id": part["_no_id"].array, "told": part["told"].array, "bits": [*sums[:, :-1]], "letters": sums[:, -1], "word": None, "times": 0})
                rare = [(rid, w, n) for rid, words in zip(part["rid"], rest) for w, n in words.items()]
                if rare:
                    yield pd.DataFrame(rare, columns=["rid", "word", "times"]).assign(doc_id=0, _no_id=False, told=None, bits=None, letters=0.0)

    # a row's number holds only inside this table, which is written once
    rows = split_ids(docs.select("doc_id", "text", "told")).withColumn("rid", F.monotonically_increasing_id())
    read = materialise(rows.mapInPandas(run, "rid bigint, doc_id bigint, _no_id boolean, told string, bits array<double>, letters double, word string, times bigint"))
    asked = read.where(F.col("word").isNotNull()).select("rid", "word", *hashes(), "times")
    words = materialise(asked.groupBy("word").agg(F.count("*").alias("n")))
    facts = word_bits(words, known, model).join(words.select(*hashes(), "n"), ["a", "b"])
    rare = attach(asked.select("rid", "a", "b", "times"), facts, ["a", "b"], ["bits", "letters"], "n", words.agg(F.sum("n")).first()[0] or 0, F.col("rid"))
    rare = rare.groupBy("rid").agg(F.array(*[F.sum(F.col("bits")[j] * F.col("times")) for j in range(width)]).alias("more"), F.sum(F.col("letters") * F.col("times")).alias("others"))
    whole = read.where(F.col("word").isNull()).drop("word", "times").join(rare, "rid", "left")
    both = F.when(F.col("more").isNull(), F.col("bits")).otherwise(F.zip_with("bits", "more", lambda x, y: x + y))
    return whole.select("doc_id", "_no_id", "told", both.alias("bits"), (F.col("letters") + F.coalesce("others", F.lit(0))).alias("letters"))


def decide(rows: pd.DataFrame) -> pd.DataFrame:
    """best (place of the fewest bits a letter; of equal ones the first by name; -1 without letters), entropy, margin to the next."""
    letters = rows["letters"].to_numpy(float)
    # sums are made in any order: what that changes is rounded away
    entropy = np.round(np.array(rows["bits"].tolist(), float).reshape(len(rows), -1) / np.maximum(letters, 1)[:, None], 9)
    order = np.sort(entropy, axis=1)
    margin = order[:, 1] - order[:, 0] if order.shape[1] > 1 else np.full(len(rows), 1.0)
    return pd.DataFrame({"best": np.where(letters > 0, entropy.argmin(axis=1), -1), "entropy": order[:, 0], "margin": margin, "letters": letters})


def evidence(margin: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """What a decision's confidence rests on: bits a letter, and bits in all, by which the next language is worse."""
    return np.column_stack([np.minimum(margin, 4.0), np.log1p(margin * letters)])


def decisions(docs: DataFrame, model: Model, counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, _no_id, told, best, entropy, margin, letters) of each row of docs (doc_id, text, told), written once: narrow rows.

    ``counts``, if at hand, are those of ``count_grams`` over the same texts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield pd.concat([rows[["doc_id", "_no_id", "told"]], decide(rows)], axis=1)

    schema = "doc_id bigint, _no_id boolean, told string, best int, entropy double, margin double, letters double"
    return materialise(code_lengths(docs, model, counts).mapInPandas(run, schema))


def count_texts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``count_grams`` of all texts of docs, by the language told; null for those that may not be learned from."""
    return materialise(count_grams(docs.select(told_of().alias("lang"), F.coalesce("text", F.lit("")).alias("text")), order))


def count_models(counts: DataFrame, order: int = ORDER) -> Model:
    """Models from the counts of all texts that may be learned from (crc32 fold 0 of 5 is held out) and have a language, not yet calibrated."""
    counts = counts.where(F.col("lang").isNotNull())
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    return kneser_ney(counts, languages, order) if languages else Model([])


def told_of() -> Column:
    """The language of a row that may be learned from, null of all others."""
    return F.when(fold(5) != 0, F.col("lang"))


def calibrate(model: Model, made: DataFrame) -> None:
    """Set the model's limits of rejection and its confidence by all rows of ``made``, decisions on texts whose language is told.

    The limit of a language is an exact quantile of its rows. Confidence is fitted by Newton steps whose sums are
    Spark aggregates over all rows; what reaches the driver is a few numbers for each language and step.
    """
    told = made.where(F.col("told").isNotNull() & (F.col("best") >= 0))
    limits = quantiles(told.where(F.col("letters") >= 20), ["entropy"], [0.999], ["best"])
    model.worst = np.full(len(model.languages), np.inf)
    for r in limits.collect():
        model.worst[r["best"]] = r["q"][0] + 0.25
    names = F.array(*[F.lit(name) for name in model.languages])
    rows = told.select((F.element_at(names, F.col("best") + 1) == F.col("told")).cast("double").alias("y"), F.least("margin", F.lit(4.0)).alias("x0"), F.log1p(F.col("margin") * F.col("letters")).alias("x1"))
    if rows.agg(F.countDistinct("y")).first()[0] == 2:
        # sums are made in any order: what that changes is rounded away
        model.calibration = np.round(logistic_rows(rows, ["x0", "x1"], "y", ridge=0.1), 9)
    # all right: the prior of a right decision grows with the bits that speak for it, as the class says


def learn(docs: DataFrame, order: int = ORDER) -> Model:
    """Models from all texts that may be learned from (crc32 fold 0 of 5 is held out) and have a language.

    Every one of these texts is counted and every gram kept, in tables; confidence is fitted, and the limit of
    rejection set, on all of them too. More than LANGUAGES languages are an error.
    """
    rows = docs.where(told_of().isNotNull())
    counts = count_texts(rows, order)
    model = count_models(counts, order)
    if model.languages:
        calibrate(model, decisions(texts(rows, F.col("lang").alias("told")), model, counts))
    return model


def answers(made: DataFrame, model: Model) -> DataFrame:
    """``identify``'s columns of decisions."""
    names, worst, c = np.array([*model.languages, "und"], object), np.append(model.worst, np.inf), model.calibration

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_ids(batches):
            if len(rows):
                best, entropy = rows["best"].to_numpy(), rows["entropy"].to_numpy()
                sure = np.where(best >= 0, sigmoid(c[0] + evidence(rows["margin"].to_numpy(), rows["letters"].to_numpy()) @ c[1:]), 0.0)
                yield pd.DataFrame({"doc_id": rows["doc_id"].array, "lang_pred": names[best], "score": sure, "entropy": entropy, "rejected": (sure < REJECT) | (entropy > worst[best])})

    return made.drop("told").mapInPandas(run, "doc_id bigint, lang_pred string, score double, entropy double, rejected boolean")


def nothing_learned(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("entropy"), F.lit(True).alias("rejected"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, entropy (bits a letter), rejected of each row.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing
    was learned. Rejection is told in its own column; lang_pred still names the closest language, of equal ones
    the first by name. Texts are read whole, runs of over LETTERS letters as several words; repeated rows get the
    same answer; other columns of ``docs`` are left behind; an empty table gives an empty result. Runs jobs when called.
    """
    if not model.languages:
        return nothing_learned(docs)
    return answers(decisions(texts(docs, F.lit(None).cast("string").alias("told")), model), model)


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """``identify(docs, learn(docs))`` with every text counted and scored once: the decisions on the training texts calibrate the answers."""
    counts = count_texts(docs)
    model = count_models(counts)
    if not model.languages:
        return nothing_learned(docs)
    made = decisions(texts(docs, told_of().alias("told")), model, counts)
    calibrate(model, made)
    return answers(made, model)


@query("op5_language")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = learn_and_identify(documents(spark, sf_dir, "doc_id", "text", "lang"))
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
