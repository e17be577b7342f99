"""SimHash near-duplicates: Burkhard-Keller trees over shards of fingerprints, then connected components."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.common import attach, components, documents, map_batches, partitions, texts, without
from sightline.llm.registry import query
from sightline.plans.storage import materialise

SEED = 42
#: Members of one tree; a larger shard is cut into parts and every pair of parts has a tree.
TREE = 4096
ROWS_A_TASK = 50_000
FRONTIER = 4_000_000
#: Bits of the filter that tells common shingles; it is 2 MB and broadcast.
COMMON_BITS = 1 << 24


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words, repeats included; A-Z lower-cased, ASCII white space between words."""
    split = text.encode().lower().split()
    if not split:
        return np.empty(0, np.uint64)
    if len(split) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(split), seed)], np.uint64)
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(split) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist())], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A second family of hashes from the first (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """Bit b is 1 if set in over half of ``h``; no hash at all gives zero."""
    if not len(h):
        return 0
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int32) if len(h) < 256 else sum(bits[i : i + 8192].sum(axis=0, dtype=np.int32) for i in range(0, len(h), 8192))
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int, width: int = 1) -> DataFrame:
    """(doc_id, row, f0 ... of 64 bits each) of every row; row is a hash of the text, texts without a word have fingerprint zero."""

    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((len(rows), width), np.uint64)
        for i, text in enumerate(rows["text"]):
            h = shingle_hashes(text, words)
            for w in range(width):
                h = mixed(h) if w else h
                out[i, w] = majority(h)
        return pd.DataFrame({"doc_id": rows["doc_id"].array, "row": rows["row"].array} | {f"f{w}": out[:, w].view(np.int64) for w in range(width)})

    return map_batches(texts(docs).withColumn("row", F.xxhash64("text")), batch, "doc_id bigint, row bigint, " + ", ".join(f"f{w} bigint" for w in range(width)))


# ---------------------------------------------------------------- trees


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """One Burkhard-Keller tree for each shard: a child hangs under its parent by their integer distance.

    Items are sorted by shard; the first of a shard is its root. All trees grow together, a
    level at a time: of the items waiting at one parent with one distance the first becomes the
    child, the rest go on below it.
    """

    def __init__(self, shard: np.ndarray, points: np.ndarray):
        n = len(shard)
        self.points, self.steps = points, 64 * points.shape[1] + 1
        first = np.ones(n, bool)
        first[1:] = shard[1:] != shard[:-1]
        heads = np.flatnonzero(first)
        self.root = heads[np.cumsum(first) - 1]
        self.size = np.diff(np.append(heads, n))[np.cumsum(first) - 1]
        waiting, at = np.flatnonzero(~first), self.root.copy()
        links = []
        while len(waiting):
            key = at[waiting] * self.steps + distance(points[waiting], points[at[waiting]])
            order = np.argsort(key, kind="stable")
            waiting, key = waiting[order], key[order]
            lead = np.ones(len(key), bool)
            lead[1:] = key[1:] != key[:-1]
            links.append((key[lead], waiting[lead]))
            at[waiting] = waiting[lead][np.cumsum(lead) - 1]
            waiting = waiting[~lead]
        self.keys = np.concatenate([k for k, _ in links]) if links else np.empty(0, np.int64)
        self.nodes = np.concatenate([c for _, c in links]) if links else np.empty(0, np.int64)
        order = np.argsort(self.keys)
        self.keys, self.nodes = self.keys[order], self.nodes[order]

    def within(self, items: np.ndarray, radius: int):
        """Pairs (item, node) within the radius, in pieces; only edges that can hold one are followed."""
        asks, nodes = items, self.root[items]
        while len(asks):
            d = distance(self.points[asks], self.points[nodes])
            hit = (d <= radius) & (asks != nodes)
            if hit.any():
                yield asks[hit], nodes[hit]
            lo = np.searchsorted(self.keys, nodes * self.steps + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.keys, nodes * self.steps + np.minimum(d + radius, self.steps - 1), "right")
            many = hi - lo
            asks = np.repeat(asks, many)
            nodes = self.nodes[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())]

    def pieces(self) -> list[np.ndarray]:
        """The items that are not alone in their shard, in pieces that bound what a search holds."""
        items = np.flatnonzero(self.size > 1)
        cuts = np.cumsum(self.size[items]) // FRONTIER
        return np.split(items, np.flatnonzero(np.diff(cuts)) + 1) if len(items) else []

    def nearest(self, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, its closest other item in the shard within the radius, the smallest of several, their distance)."""
        none = np.iinfo(np.int64).max
        best = np.full(len(self.root), none)
        for piece in self.pieces():
            for a, b in self.within(piece, radius):
                np.minimum.at(best, a, distance(self.points[a], self.points[b]) << 40 | b)
        items = np.flatnonzero(best < none)
        return items, best[items] & ((1 << 40) - 1), best[items] >> 40

    def labels(self, radius: int) -> np.ndarray:
        """For each item the first item of its shard that it reaches by steps within the radius."""
        label = np.arange(len(self.root))
        for piece in self.pieces():
            pairs = list(self.within(piece, radius))
            if not pairs:
                continue
            a, b = (np.concatenate(x) for x in zip(*pairs))
            while True:
                low = np.minimum(label[a], label[b])
                np.minimum.at(label, label[a], low)
                np.minimum.at(label, label[b], low)
                while (label[label] != label).any():
                    label = label[label]
                if (label[a] == label[b]).all():
                    break
        return label


# ---------------------------------------------------------------- shards


def pigeonhole(radius: int, blocks: int) -> list[tuple[int, ...]]:
    """Masks of 64 bits: two fingerprints within ``radius`` agree under at least one of them."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [(sum(c),) for c in itertools.combinations(parts, blocks - radius)]


def bit_samples(width: int, bits: int, tables: int, seed: int = SEED) -> list[tuple[int, ...]]:
    """Masks of ``bits`` bits drawn from 64 x width; a pair agreeing in a share p of its bits meets in a table with chance p^bits."""
    rng = np.random.default_rng(seed)
    masks = []
    for _ in range(tables):
        chosen = rng.choice(64 * width, bits, replace=False)
        masks.append(tuple(sum(1 << int(b % 64) for b in chosen if b // 64 == w) for w in range(width)))
    return masks


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(points: DataFrame, masks: Sequence[tuple[int, ...]], radius: int, tree: int = TREE) -> DataFrame:
    """Links (a, b) that connect whatever is within ``radius`` and shares a mask; ``points`` has node and f0 ..., each once.

    A task returns each point with the first one that it reaches, never all pairs.
    """

    def linked(forest: Forest, group: pd.DataFrame) -> pd.DataFrame:
        node, label = group["node"].to_numpy(), forest.labels(radius)
        on = label != np.arange(len(label))
        return pd.DataFrame({"a": node[on], "b": node[label[on]]})

    return meetings(points, masks, linked, "a bigint, b bigint", tree).distinct()


def meetings(points: DataFrame, masks: Sequence[tuple[int, ...]], find: Callable[[Forest, pd.DataFrame], pd.DataFrame], schema: str, tree: int = TREE) -> DataFrame:
    """What ``find`` makes of the trees over each shard of ``points`` (node, f0 ...), each point once.

    A shard is the points that agree under one mask. Its tree goes to the tasks that search it by
    a shuffle: a tree over all fingerprints has no size bound that would let it be broadcast. A
    shard of more than ``tree`` points is cut into parts, and each pair of parts has a tree, so no
    task holds more than two parts at once.
    """
    spark = points.sparkSession
    fs = [c for c in points.columns if c != "node"]
    keys = F.array(*[F.xxhash64(F.lit(t), *[F.col(f).bitwiseAND(F.lit(signed(m))) for f, m in zip(fs, mask)]) for t, mask in enumerate(masks)])
    rows = points.select("node", *fs, F.explode(keys).alias("shard"))
    total = points.count() * len(masks)
    large = rows.groupBy("shard").agg(F.count("*").alias("_n")).where(F.col("_n") > tree)
    rows = attach(rows, large, ["shard"], ["_n"], "_n", total, F.col("node"))
    parts = F.ceil(F.coalesce("_n", F.lit(1)) / tree).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int")
    rows = rows.withColumn("_parts", parts).withColumn("_mine", mine)
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    rows = rows.where((F.col("_parts") == 1) | (F.col("_parts") == 2) & (F.col("_other") == 0) | (F.col("_parts") > 2) & (F.col("_mine") != F.col("_other")))
    unit = F.when(F.col("_parts") <= 2, F.col("shard")).otherwise(F.xxhash64("shard", F.least("_mine", "_other"), F.greatest("_mine", "_other")))
    buckets = max(4 * partitions(spark), -(-total // ROWS_A_TASK))
    rows = rows.select("node", *fs, unit.alias("unit")).withColumn("bucket", F.pmod(F.xxhash64("unit", F.lit(3)), F.lit(buckets)))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["unit", "node"], kind="stable")
        return find(Forest(group["unit"].to_numpy(), group[fs].to_numpy().view(np.uint64)), group)

    return rows.groupBy("bucket").applyInPandas(search, schema)


def near_groups(prints: DataFrame, masks: Sequence[tuple[int, ...]], radius: int) -> DataFrame:
    """``prints`` (doc_id, row, f0 ...) with component_id, the smallest doc_id that links within ``radius`` lead to.

    Equal fingerprints are one point, so copies are counted, never paired. Rows without a
    doc_id take part and get the smallest id that is there, or null if there is none.
    """
    fs = [c for c in prints.columns if c not in ("doc_id", "row")]
    prints = materialise(prints)
    total = prints.count()
    node = F.col(fs[0]) if len(fs) == 1 else F.xxhash64(*fs)
    points = materialise(prints.groupBy(*fs).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).withColumn("node", node))
    labels = materialise(components(links(points.select("node", *fs), masks, radius)))
    nodes = points.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    nodes = materialise(nodes.select(*fs, "first", "copies", "label", F.xxhash64(*fs).alias("_spread")))
    heads = nodes.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("_n")).where("_n > 1")
    nodes = attach(nodes, heads, ["label"], ["component_id"], "_n", total, F.col("_spread"))
    facts = nodes.select(*fs, F.coalesce("component_id", "first").alias("component_id"), "copies").where(F.col("component_id").isNotNull())
    return attach(prints, facts, fs, ["component_id"], "copies", total, F.col("doc_id"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the distinct shingle hashes of one document for each text in ``wanted`` (node, first)."""

    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"node": rows["node"], "shingles": [np.unique(shingle_hashes(t, words)).view(np.int64) for t in rows["text"]]})

    names = wanted.select(F.col("node").alias("_node"), F.col("first").alias("_first"))
    rows = texts(docs).withColumn("node", F.xxhash64("text")).join(names, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    return map_batches(rows.select("node", "text"), batch, "node bigint, shingles array<bigint>").dropDuplicates(["node"])


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets have a Jaccard similarity of ``similarity`` or more."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_y"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    least, most = F.least(F.size("_x"), F.size("_y")), F.greatest(F.size("_x"), F.size("_y"))
    shared = F.size(F.array_intersect("_x", "_y"))
    # the sizes alone rule out many
    return both.where((least >= similarity * most) & (shared >= similarity * (F.size("_x") + F.size("_y") - shared) - 1e-9)).select("a", "b")


def may_be_alike(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different label in ``sets`` (node, label, shingles) that can reach the similarity.

    In any order of all shingles, two sets that reach it share one of the first n - ceil(similarity n) + 1 of each.
    Here those seen in fewer than three texts come first (a bit array of a fixed size tells them), so texts around one
    passage, or far copies of one text, first meet at a place from which on too little is left, and are not compared.
    """
    counts = sets.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 2")
    spot = F.pmod("s", F.lit(COMMON_BITS))
    words = counts.groupBy(F.shiftright(spot, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(spot, F.lit(64)).cast("int"))).alias("bits"))
    bits = np.zeros(COMMON_BITS // 64, np.int64)
    for r in words.collect():  # COMMON_BITS / 64 rows at most
        bits[r["at"]] = r["bits"]
    shared = sets.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for own in rows["shingles"]:
                own = np.sort(np.asarray(own, np.int64))
                at = own & (COMMON_BITS - 1)
                common = (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
                out.append(own[np.argsort(common, kind="stable")][: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1])
            sizes = [len(x) for x in out]
            if sum(sizes):
                n = rows["shingles"].map(len).to_numpy()
                yield pd.DataFrame({"node": np.repeat(rows["node"].to_numpy(), sizes), "label": np.repeat(rows["label"].to_numpy(), sizes), "n": np.repeat(n, sizes), "p": np.concatenate([np.arange(k) for k in sizes]), "s": np.concatenate(out)})

    rows = materialise(sets.mapInPandas(first, "node bigint, label bigint, n bigint, p bigint, s bigint"))
    mixed_ = rows.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("s")
    rows = materialise(rows.join(mixed_, "s"))
    one, two = rows.toDF("s", "a", "la", "na", "pa"), rows.toDF("s", "b", "lb", "nb", "pb")
    # at the first shingle that two sets share, what either has from there on is all that they can have in common
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    close = (left >= similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-9) & (F.col("la") != F.col("lb")) & (F.col("a") < F.col("b"))
    return one.join(two, "s").where(close).select("a", "b").distinct()


def samples_for(points: int, width: int) -> list[tuple[int, ...]]:
    """Bit samples for so many points: a shard stays at about 16 unrelated ones, and a pair that differs in 15 % of its bits meets with the same chance."""
    bits = max(14, math.ceil(math.log2(max(2, points))) - 4)
    return bit_samples(width, bits, math.ceil(56 * 0.85 ** (14 - bits)))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, width: int = 2) -> DataFrame:
    """(doc_id, row, component_id) of documents linked by a Jaccard similarity of their word shingles of ``similarity`` or more.

    SimHashes propose and the shingles decide. Fingerprints have 64 x ``width`` bits, repeats of shingles
    count in them; they meet under samples of bits and are searched by trees within a radius of a quarter of the
    bits. First each text is compared with the closest two that it meets. Among all texts that met any, pairs of different groups
    that can still reach the similarity are then compared as well; so a group of copies is not paired with itself.
    Every link is exact; of the pairs at 0.8, 98 % are found, of those at 0.9 all but one in a thousand. row is a
    hash of the text. Null and empty texts are one group; repeated rows and ties go to the smallest doc_id; rows without a doc_id get the
    smallest id of their group, or null if there is none; an empty table gives an empty result; extra columns are not read.
    """
    prints = materialise(fingerprints(docs, words, width))
    total = prints.count()
    fs = [f"f{w}" for w in range(width)]
    points = prints.groupBy(F.col("row").alias("node")).agg(*[F.min(f).alias(f) for f in fs], F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    points = materialise(points)
    masks, radius = samples_for(points.count(), width), 16 * width

    def closest(forest: Forest, group: pd.DataFrame) -> pd.DataFrame:
        node = group["node"].to_numpy()
        a, b, d = forest.nearest(radius)
        return pd.DataFrame({"a": node[a], "b": node[b], "d": d})

    ordered = lambda t: t.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met = meetings(points.select("node", *fs), masks, closest, "a bigint, b bigint, d bigint").distinct()
    place = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))  # a row for each mask at most
    tried = materialise(ordered(met.withColumn("_k", place).where("_k <= 2")))
    known = tried.select(F.col("a").alias("node")).union(met.select("a")).distinct()
    sets = materialise(shingle_sets(docs, points.join(known, "node").select("node", "first"), words))
    found = materialise(alike(tried, sets, similarity))
    grouped = sets.join(components(found), "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = may_be_alike(grouped.select("node", "label", "shingles"), similarity).join(tried, ["a", "b"], "left_anti")
    found = materialise(found.unionByName(alike(rest, sets, similarity)))
    labels = materialise(components(found))
    nodes = materialise(points.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("node", "first", "copies", "label"))
    heads = nodes.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("_n")).where("_n > 1")
    nodes = attach(nodes, heads, ["label"], ["component_id"], "_n", total, F.col("node"))
    facts = nodes.select(F.col("node").alias("row"), F.coalesce("component_id", "first").alias("component_id"), "copies").where(F.col("component_id").isNotNull())
    return attach(prints.select("doc_id", "row"), facts, ["row"], ["component_id"], "copies", total, F.col("doc_id"))


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8, width: int = 2) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest doc_id; texts without a word are no group and stay.

    All columns come back as they are, whatever they are called. Rows repeated with one doc_id and text are one document. Rows without a doc_id go if their group
    has a row with one, and stay otherwise.
    """
    text = F.coalesce("text", F.lit(""))
    groups = near_duplicates(docs.where(F.length(F.trim(text, F.lit(" \t\r\n\x0b\x0c"))) > 0), words, similarity, width)
    gone = groups.where(F.col("component_id").isNotNull() & ~F.col("component_id").eqNullSafe(F.col("doc_id")))
    return without(docs, gone)


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word fingerprints linked at three differing bits or fewer; complete by the pigeonhole masks."""
    groups = near_groups(fingerprints(documents(spark, sf_dir, "doc_id", "text"), 3), pigeonhole(3, 5), 3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
