"""Ranked search beside scoring of every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sightline.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n = sum(bool(b) for _, b in bags)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, bag in bags:
            m = 50 + 50 * sum(bag.values()) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in set(terms(text)) if bag[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        for k, (score, none, d) in enumerate(sorted(found)[:top]):
            out.append((item, k + 1, None if none else d, -score))
    return Counter(out)


def table(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], "doc_id bigint, text string, rank int, score int, item string")


def bench(spark, rows):
    return spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "item_id bigint, text string, doc_id string, rank int")


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(d, " ".join(rng.choices(words, k=rng.choice([1, 5, 40, 200])))) for d in range(300)]
    docs += [(1000 + d, docs[5][1]) for d in range(200)]  # a large group of copies: ties
    docs += [(None, docs[5][1]), (5, docs[5][1]), (2000, None), (2001, ""), (2002, " -- \x00\x7f"), (2003, "É日本 É W1_w2"), (2**53 + 1, "W3 w3"), (2004, "w1 " * 300_000 + "x" * 100_000)]
    return docs


@pytest.mark.parametrize("block", [8, 1 << 16])
def test_ranks(spark, docs, monkeypatch, block):
    rng = random.Random(3)
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", block)
    items = [(i, " ".join(f"w{int(rng.paretovariate(0.5))}" for _ in range(25))) for i in range(30)]
    items += [(31, None), (32, "..."), (33, "É É日本 É"), (34, "absent"), (5, docs[5][1]), (5, "w2 w3"), (None, "w9 w1")]
    got = ranked_search.ranked_search(table(spark, docs), bench(spark, items), top=7, block_items=400 if block == 8 else 1 << 20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == brute(docs, items, 7)


def test_empty_tables(spark, docs):
    assert ranked_search.ranked_search(table(spark, []), bench(spark, [(1, "w1")])).collect() == []
    assert ranked_search.ranked_search(table(spark, docs[:9]), bench(spark, [])).collect() == []
    assert ranked_search.ranked_search(table(spark, [(1, None), (2, "?")]), bench(spark, [(1, "w1")])).collect() == []


def test_accumulators_are_limited(monkeypatch):
    """Once the rest can't reach the k-th score, a common term makes no accumulators, and the result is the same."""
    n = 5000
    doc, gain = [np.arange(10), np.arange(n)], [np.full(10, 100), np.full(n, 3)]
    place = np.array([0, 10, 10 + n])
    made = []
    real = np.partition
    monkeypatch.setattr(np, "partition", lambda x, k: (made.append(len(x)), real(x, k))[1])
    best = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    ranked_search.search_block([[0, 1]], place, np.concatenate(doc), np.concatenate(gain), n, np.arange(n), best, 5)
    assert made == [10] and best[0][0].tolist() == [103] * 5 and best[0][1].tolist() == [0, 1, 2, 3, 4]
