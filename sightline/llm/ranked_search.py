"""Ranked lexical search: term at a time, rarest term first, with a limit on accumulators that never loses a result."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.common import documents
from sightline.llm.registry import query
from sightline.plans.storage import materialise

TOP = 50
#: Documents and postings that a task holds at once; a block ends when it has either.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 16, 1 << 22
#: Bytes of item texts that are searched for together; more items are searched for in further blocks.
BLOCK_ITEMS = 4 << 20
SCALE = 1_000_000_000

#: Bytes to term bytes: separators become spaces, A-Z a-z; bytes from 0x80 on belong to terms.
TERM_BYTES = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters and digits and of all other non-ASCII characters, A-Z lower-cased."""
    return text.translate(TERM_BYTES).split()


class Items:
    """A block of items: the number of each term, and the terms of each item."""

    def __init__(self, texts: list[bytes]):
        self.code: dict[bytes, int] = {}
        self.of = [sorted({self.code.setdefault(t, len(self.code)) for t in terms(text)}) for text in texts]


def postings(batches: Iterator[pd.DataFrame], code: dict[bytes, int]) -> Iterator[tuple[list, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """(doc_ids, lengths, term numbers and counts of each document) of blocks of documents of a bounded size."""
    ids, lengths, numbers, counts, held = [], [], [], [], 0
    for rows in batches:
        for doc_id, text in zip(rows["doc_id"].tolist(), rows["text"].tolist()):
            words = terms(text)
            got = np.array([x for x in map(code.get, words) if x is not None], np.int64)
            t, n = np.unique(got, return_counts=True)
            ids.append(doc_id)
            lengths.append(len(words))
            numbers.append(t)
            counts.append(n)
            held += len(t)
            if len(ids) >= BLOCK_DOCS or held >= BLOCK_POSTINGS:
                yield ids, np.array(lengths, np.int64), numbers, counts
                ids, lengths, numbers, counts, held = [], [], [], [], 0
    if ids:
        yield ids, np.array(lengths, np.int64), numbers, counts


def statistics(docs: DataFrame, code: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all their terms, documents holding each term of ``code``) over all documents."""
    size = len(code)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(size + 2, np.int64)
        for _, lengths, numbers, _ in postings(batches, code):
            df[size] += np.count_nonzero(lengths)
            df[size + 1] += lengths.sum()
            df[:size] += np.bincount(np.concatenate(numbers), minlength=size)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": at, "n": df[at]})

    out = np.zeros(size + 2, np.int64)
    # a row for each term of the block of items
    for r in docs.mapInPandas(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return int(out[size]), int(out[size + 1]), out[:size]


def search_block(order: list[list[int]], place: np.ndarray, doc: np.ndarray, gain: np.ndarray, n_docs: int, ids: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]], top: int) -> None:
    """Bring ``best``, the (scores, ids) of the ``top`` best documents of each item so far, up to date with a block of documents.

    Postings of term t are place[t]:place[t + 1] of ``doc`` and ``gain`` (score). Terms of an item come rarest
    first. As soon as what the remaining terms can give at most is less than the top-th partial score, no new
    accumulator is made: a document without one cannot be among the best, not even by a tie. The
    others are updated to their exact scores.
    """
    most = np.array([gain[a:b].max() if b > a else 0 for a, b in zip(place[:-1], place[1:])], np.int64)
    score = np.zeros(n_docs, np.int64)
    for item, own in enumerate(order):
        if not own:
            continue
        left = np.concatenate((np.cumsum(most[own][::-1])[::-1], [0]))
        floor = int(best[item][0][-1]) if len(best[item][0]) >= top else 0  # scores are above 0
        seen = np.empty(0, np.int64)
        open_ = True
        for k, t in enumerate(own):
            a, b = place[t], place[t + 1]
            if a == b:
                continue
            if open_ and left[k] < floor:
                open_ = False
            if open_:
                fresh = doc[a:b][score[doc[a:b]] == 0]
                score[doc[a:b]] += gain[a:b]
                seen = np.concatenate((seen, fresh[score[fresh] > 0]))
                if len(seen) >= top:
                    floor = max(floor, int(np.partition(score[seen], len(seen) - top)[len(seen) - top]))
            elif len(seen) < b - a:  # a search in the term's postings, which are sorted, for each accumulator
                at = np.searchsorted(doc[a:b], seen)
                hit = at < b - a
                hit[hit] = doc[a:b][at[hit]] == seen[hit]
                score[seen[hit]] += gain[a:b][at[hit]]
            else:
                hit = score[doc[a:b]] > 0
                score[doc[a:b][hit]] += gain[a:b][hit]
        if not len(seen):
            continue
        got = score[seen]
        score[seen] = 0
        keep = got >= floor
        scores, names = np.concatenate((best[item][0], got[keep])), np.concatenate((best[item][1], ids[seen[keep]]))
        first = np.lexsort((names, -scores))[:top]
        best[item] = (scores[first], names[first])


def search_items(docs: DataFrame, texts: list[bytes], top: int = TOP) -> DataFrame:
    """(item, score, doc_id) of each task's best documents for a block of items; the best of all are among them.

    A first scan takes the statistics of all documents. In the second each task goes through its
    documents block by block and keeps the best of each item so far, whose last score limits the accumulators from
    the block's first term on.
    """
    items = Items(texts)
    n, total, df = statistics(docs, items.code)
    if not n or not items.code:
        return docs.sparkSession.createDataFrame([], "item int, score bigint, doc_id bigint")
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    rank = np.lexsort((np.arange(len(df)), df))
    place_of = np.empty(len(df), np.int64)
    place_of[rank] = np.arange(len(df))
    order = [sorted(own, key=place_of.__getitem__) for own in items.of]
    shared = docs.sparkSession.sparkContext.broadcast((items.code, order, weight))
    # ids come as they are; a missing id sorts last and is told apart by the largest value, which no id has
    none = np.iinfo(np.int64).max

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, order, weight = shared.value
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(order)
        for ids, lengths, numbers, counts in postings(batches, code):
            sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
            doc = np.repeat(np.arange(len(ids)), sizes)
            term, tf = np.concatenate(numbers), np.concatenate(counts)
            by = np.argsort(term, kind="stable")
            doc, term, tf = doc[by], term[by], tf[by].astype(np.int64)
            m = 100 - 50 + np.array([(50 * int(x) * n) // total for x in lengths], np.int64)
            gain = weight[term] * ((SCALE * tf) // (1000 * tf + 20 * m[doc]))
            place = np.searchsorted(term, np.arange(len(code) + 1))
            search_block(order, place, doc, gain, len(ids), np.array(ids, np.int64), best, top)
        for lo in range(0, len(order), 1000):
            part = best[lo : lo + 1000]
            yield pd.DataFrame(
                {
                    "item": np.repeat(np.arange(lo, lo + len(part)), [len(s) for s, _ in part]).astype(np.int32),
                    "score": np.concatenate([s for s, _ in part]),
                    "doc_id": pd.arrays.IntegerArray(ids := np.concatenate([d for _, d in part]), ids == none),
                }
            )

    return docs.mapInPandas(best, "item int, score bigint, doc_id bigint")


def item_blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of about ``size`` bytes, one after the other; the driver holds one partition's items at most."""
    block, held = [], 0
    for r in benchmark.select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).toLocalIterator():
        block.append((r["item_id"], bytes(r["text"])))
        held += len(r["text"]) + 64
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def ranked_search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents with the highest scores above 0 for each item, all if fewer.

    The score sums, over the item's distinct terms, floor(1000 ln((2N+2)/(2df+1))) * ((10**9 tf) div (1000 tf + 20 m)) with
    m = 50 + ((50 n N) div L), in 64-bit integers; terms are ``terms`` of the whole texts. Equal scores come
    by ascending doc_id, a missing one last; rows repeated with one doc_id are ranked as documents of their own. Null and empty texts have no
    terms: as documents they are not counted and never found, as items they have no rows. Items that share an
    id are ranked each for itself. A text of any length is read whole; other columns are not read; an empty table on either side gives an empty result.

    Statistics and postings come from scans; no text and no posting is shuffled, only each task's ``top``
    documents an item. Items beyond ``block_items`` bytes are searched for in further blocks.
    """
    # no id has the largest value of a bigint
    rows = docs.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    session, found = docs.sparkSession, None
    for block in item_blocks(benchmark, block_items):
        names = session.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id bigint")
        got = search_items(rows, [text for _, text in block], top)
        # each task sends ``top`` rows an item at most; the window keeps as many before its shuffle
        ranked = got.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= top)
        ranked = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        # a further block is searched for after this one, so that one block's items are held at a time
        found = ranked if found is None else materialise(found).unionByName(materialise(ranked))
    return found if found is not None else session.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts, row_number() OVER () AS r FROM documents),
b AS (SELECT item_id, row_number() OVER () AS q, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
g AS (SELECT count(*) AS nn, CAST(sum(len(ts)) AS BIGINT) AS ll FROM d WHERE len(ts) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY r, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, nn),
s AS (
    SELECT b.q, b.item_id, d.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * len(ts) * nn) // ll))))) AS BIGINT) AS score
    FROM b JOIN p USING (term) JOIN f USING (term) JOIN d USING (r), g GROUP BY b.q, b.item_id, r, d.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 50
"""


@query("op12_ranked_search", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return ranked_search(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
