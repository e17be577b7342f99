"""Learned operators: held-out accuracy, folds, parts against brute force, odd rows."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.llm import language, quality, toxicity
from sightline.llm.labels import logistic, sigmoid


def auc(score, label):
    rank = pd.Series(score).rank().to_numpy()
    one = label == 1
    return (rank[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())


@pytest.fixture(scope="module")
def small(spark):
    """A hundredth of the benchmark tables: the smallest that holds enough labels."""
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")


def test_logistic_fits():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < sigmoid(0.5 + x @ [2.0, -1.0])).astype(float)
    assert np.abs(logistic(x, y) - [0.5, 2.0, -1.0]).max() < 0.2


# ---------------------------------------------------------------- quality


def test_quality_tells_held_out_rows(small):
    docs, labels = small("documents"), small("labels")
    got = quality.score(docs, quality.learn(docs, labels)).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[[zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"]]]
    assert auc(held["score"], held["quality"].to_numpy()) > 0.97 and (held["predicted"] == held["quality"]).mean() > 0.93


def test_tables_add_up_to_the_score():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, len(quality.FEATURES)))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(3000) < 0.05)).astype(float)
    model = quality.boost(x, y)
    assert {0, 1} in [set(p) for p in model.pairs] and auc(model.score(x), y) > 0.85
    b = model.bins(x[:5])
    for k in range(5):
        total = model.base + sum(model.single[j, b[k, j]] for j in range(b.shape[1])) + sum(t[b[k, i], b[k, j]] for (i, j), t in zip(model.pairs, model.double))
        assert math.isclose(1 / (1 + math.exp(-total)), model.score(x[k : k + 1])[0])


def test_quality_odd(spark, odd, none, small):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None), (5, 1), (3, 0), (6, 0), (7, 7)], "doc_id bigint, quality int")
    for train, told in ((odd, labels), (none, labels), (odd, labels.where("false"))):
        model = quality.learn(train, told)
        got = quality.score(odd, model).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
        assert quality.score(none, model).collect() == []
        kept = quality.keep(odd, model)
        assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in got)


# ---------------------------------------------------------------- toxicity


def distance(a, b):
    """Edits with swaps of neighbours as one (each letter edited once)."""
    d = {(-1, j): j + 1 for j in range(-1, len(b))} | {(i, -1): i + 1 for i in range(-1, len(a))}
    for i, j in itertools.product(range(len(a)), range(len(b))):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
        if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automaton_equals_edit_distance():
    rng = random.Random(6)
    terms = ["clown", "clowns", "loser", "scum", "moron", "ab", "losers"]
    auto = toxicity.intersect(terms)
    words = terms + ["".join(rng.choice("clownsermuabx") for _ in range(rng.randint(1, 7))) for _ in range(1500)]
    for t in terms:
        for _ in range(150):
            w = list(t)
            for _ in range(rng.randint(1, 2)):
                i, k = rng.randrange(max(1, len(w))), rng.random()
                if k < 0.3:
                    w[i : i + 1] = rng.choice("clownx")
                elif k < 0.6:
                    w.insert(i, rng.choice("clownx"))
                elif k < 0.8 and len(w) > 1:
                    del w[i]
                elif i:
                    w[i - 1], w[i] = w[i], w[i - 1]
            words.append("".join(w))
    for w in words:
        state = 1
        for c in w:
            state = auto.table[state, auto.classes.get(c, 1)]
        want = min((distance(w, t) for t in terms if w == t or len(t) >= toxicity.FUZZY and distance(w, t) <= 1), default=None)
        assert (auto.edits[state] if auto.term[state] >= 0 else None) == want, w


def test_context_tells_quotation_from_address():
    matcher = toxicity.Matcher(["idiot"], np.array([3.0]))
    plain, quoted, said, fuzzy, none = matcher.features(["you are an idiot here", 'the so "called idiot" of old', "he said idiot then", "what an IDI0T he was", "nothing at all"])
    names = toxicity.FEATURES
    at = lambda row, f: row[names.index(f)]
    assert at(plain, "addressed") == 1 and at(plain, "quoted") == 0 and at(quoted, "quoted") == 1 and at(said, "quoted") == 1
    assert at(fuzzy, "fuzzy") > 0 and at(fuzzy, "exact") == 0 and at(none, "strongest") == 0


def test_toxicity_tells_held_out_rows(load, spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs.join(labels.select("doc_id"), "doc_id"), model).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[[zlib.crc32(str(d).encode()) % 3 == 1 for d in got["doc_id"]]]
    assert auc(held["score"], held["toxic"].to_numpy()) > 0.95
    assert held.loc[held["predicted"] == 1, "toxic"].mean() > 0.95 and held.loc[held["toxic"] == 0, "predicted"].mean() < 0.01


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None), (5, 1), (3, 0)], "doc_id bigint, toxic int")
    for train, told in ((odd, labels), (none, labels), (odd, labels.where("false"))):
        model = toxicity.learn(train, told)
        got = toxicity.score(odd, model).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
        assert toxicity.score(none, model).collect() == []


# ---------------------------------------------------------------- language


def recursive_bits(texts, word, order, alphabet):
    """A word's code length by the textbook recursion over dictionaries of letter tuples."""
    padded = lambda w: (None,) * (order - 2) + ("<",) + tuple(w) + (">",)
    tables = {order: {}}
    for w in texts:
        p = padded(w)
        for i in range(order - 1, len(p)):
            g = p[i - order + 1 : i + 1]
            tables[order][g] = tables[order].get(g, 0) + 1
    for k in range(order, 1, -1):
        below = tables[k - 1] = {}
        for g, n in tables[k].items():
            below[g[1:]] = below.get(g[1:], 0) + (n if g[0] is None else 1)

    def probability(g):
        if not g:
            return 1 / alphabet
        counts = tables[len(g)]
        ones, twos = (sum(n == x for n in counts.values()) for x in (1, 2))
        discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        around = [n for h, n in counts.items() if h[:-1] == g[:-1]]
        if not around:
            return probability(g[1:])
        return max(counts.get(g, 0) - discount, 0) / sum(around) + discount * len(around) / sum(around) * probability(g[1:])

    p = padded(word)
    return sum(-math.log2(probability(p[i - order + 1 : i + 1])) for i in range(order - 1, len(p)))


@pytest.mark.parametrize("order", [2, 3, 5])
def test_code_lengths_equal_recursion(spark, order):
    said = {"x": ["the", "then", "hat", "that", "a", "tat"] * 3 + ["heat", "ten"], "y": ["das", "dass", "daß", "日本語", "日本", "ab"] * 2 + ["\U00020000a"]}
    docs = spark.createDataFrame([(lang, " ".join(words)) for lang, words in said.items()], "lang string, text string")
    model = language.kneser_ney(language.count_grams(docs, order), ["x", "y"], order)
    tried = ["the", "tha", "zebra", "日語", "das", "t", "\U00020000"]
    words = spark.createDataFrame([(w,) for w in tried], "word string")
    known = language.gram_bits(words.withColumnRenamed("word", "text"), model)
    got = {r.word: r for r in words.select("word", *language.hashes()).join(language.word_bits(words, known, model), ["a", "b"]).collect()}
    for w in tried:
        assert got[w].letters == len(w) + 1
        assert got[w].bits == pytest.approx([recursive_bits(said[x], w, order, 64) for x in "xy"]), w


def test_counts_equal_brute_force(spark, make):
    docs = make([(1, "The cat, the CAT!\nsat"), (2, "a-b 12 x1y"), (3, None)]).selectExpr("doc_id", "coalesce(text, '') as text", "lang")
    got = {(r.hi, r.lo): r.n for r in language.count_grams(docs, 3).collect()}
    hi, lo, _ = language.grams(["the", "cat", "the", "cat", "sat", "a", "b", "x", "y"], 3)
    assert got == Counter(zip(hi.tolist(), lo.tolist()))


def test_rare_and_frequent_words_add_up(spark, make, monkeypatch):
    docs = make([(i, "the cat sat on the mat " * (i + 1) + f"zq{'abcdefghij'[i]}x Ünï") for i in range(10)])
    model = language.learn(docs)
    whole = {r.doc_id: r.entropy for r in language.identify(docs, model).collect()}
    for held in (0, 60):  # all words, and nearly all, go through the shuffles
        monkeypatch.setattr(language, "HELD", held)
        assert {r.doc_id: r.entropy for r in language.identify(docs, model).collect()} == pytest.approx(whole)


def test_language_frequent_grams_whole_classes_without_a_sort(spark):
    rows = [(i, 7 * i, 9 if i < 3 else 4 if i < 8 else 1, [float(i), i / 2]) for i in range(40)]
    known = spark.createDataFrame(rows, "hi bigint, lo bigint, n bigint, bits array<double>").repartition(5)
    for most, want in ((2, 0), (3, 3), (7, 3), (8, 8), (39, 8), (40, 40)):
        hi, lo, bits = language.frequent(known, 2, most)
        assert sorted(hi) == list(range(want)) and bits.shape == (want, 2)
        assert (lo == 7 * hi).all() and (bits[:, 0] == hi).all() and (bits[:, 1] == hi / 2).all()


def test_language_tells_held_out_rows(small):
    docs = small("documents")
    got = language.identify(docs, language.learn(docs)).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[[zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"]]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.98 and held["score"].between(0, 1).all()


def test_language_calibrated_on_all_training_rows(spark):
    """More training texts than any sample held: the limits and the confidence are those of all of them."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{'aeiou'[i % 5]}" for i in range(300)]
    rows = [(i, " ".join(words[(i * k) % 300] for k in range(1, 12)) + f" {words[i * i % 300]}" * (i % 7), "en" if i % 40 else "xx") for i in range(16_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    model = language.learn(docs)
    train = docs.where(language.told_of().isNotNull())
    made = language.decisions(language.texts(train, F.col("lang").alias("told")), model).toPandas()
    assert len(made) > 12_000 and made["told"].nunique() == 2
    for j in set(made["best"]):
        own = made[(made["best"] == j) & (made["letters"] >= 20)]["entropy"]
        assert model.worst[j] == pytest.approx(own.quantile(0.999) + 0.25, abs=1e-9)
    right = (np.array(model.languages)[made["best"]] == made["told"]).to_numpy(float)
    assert len(set(right)) == 2
    want = logistic(language.evidence(made["margin"].to_numpy(), made["letters"].to_numpy()), right, ridge=0.1)
    assert model.calibration == pytest.approx(want, abs=1e-6)
    once = {r.doc_id: (r.lang_pred, round(r.score, 6), r.rejected) for r in language.learn_and_identify(docs).collect()}
    assert once == {r.doc_id: (r.lang_pred, round(r.score, 6), r.rejected) for r in language.identify(docs, model).collect()}


def test_language_texts_counted_once_with_those_of_no_language(spark, monkeypatch):
    rows = [(i, f"{w} mo{w}, {i}{w}. 7", lang) for i in range(40) for w, lang in ((("la", "x"), ("ke", "y"), ("du", None))[i % 3],)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    once = {(r.hi, r.lo): r.n for r in language.count_grams(docs.select(F.lit("").alias("lang"), "text")).collect()}
    apart, told = {}, set()
    for r in language.count_texts(docs).collect():
        apart[r.hi, r.lo] = apart.get((r.hi, r.lo), 0) + r.n
        told.add(r.lang)
    assert apart == once and told == {"x", "y", None}
    calls, count = [], language.count_grams
    monkeypatch.setattr(language, "count_grams", lambda *args: calls.append(args) or count(*args))
    got = {r.doc_id: r.lang_pred for r in language.learn_and_identify(docs).collect()}
    assert len(calls) == 1 and len(got) == 40 and all(got[i] == "xy"[i % 3] for i in range(40) if i % 3 < 2)


def test_language_tokens_split_as_letter_by_letter():
    odd = ["erly.", "(a-b", "c3d9", "12", "--", "É.", "中文，字", "ʼn1", "İx!", "²x", "_" * 40 + "ab" + "c" * 40 + "9", "x" * 33]
    for token in odd:
        runs = "".join(c if c.isalpha() else " " for c in token.lower()).split()
        assert language.letters_of(token) == [r[i : i + 32] for r in runs for i in range(0, len(r), 32)]


def test_language_odd(odd, none, spark):
    model = language.learn(odd)
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in language.identify(odd, model).collect()}
    assert {p for d, p, _ in got if d in (2, 3, 6)} == {"und"} and {p for d, p, _ in got if d in (1, 4, 8, -9)} == {"en"}
    assert language.identify(none, model).collect() == []
    nothing = language.learn(none)
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}
