"""Prefix trie of conversations, with subtree totals by centroid decomposition of its parent edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.common import attach, partitions, sorted_parts
from sightline.llm.registry import query
from sightline.plans.storage import materialise

#: Nodes of a component that one task decomposes; a larger one is split in rounds of Spark jobs.
COMPONENT = 20_000
#: Turns of a conversation whose prefix keys are made together.
STRETCH = 4096
WORDS = r"[^\x20\x09-\x0D]+"
NUMBERS = 1 << 33  # of rows in a part, as monotonically_increasing_id counts


# ---------------------------------------------------------------- sequences


def positions(turns: DataFrame, order: list) -> DataFrame:
    """``turns`` with pos, the place (from 1) in its conv_id by ``order``; a conversation may lie in many parts."""
    placed = sorted_parts(turns, ["conv_id", *order]).withColumn("_id", F.monotonically_increasing_id())
    pieces = placed.groupBy("conv_id", "part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    # a key of this join holds one part's rows at most
    out = placed.join(pieces.select("conv_id", "part", "_first", "_before"), ["conv_id", "part"])
    return out.withColumn("pos", F.col("_before") + F.col("_id") - F.col("_first") + 1).drop("part", "_id", "_first", "_before")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, words): turns by turn, nulls first, ties by role and text; 128 bits of role and text and the text's words."""
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        F.substring("text", 1, 200).alias("_start"),
        F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.lit(7), F.col("text"), F.col("role")).alias("h2"),
        F.regexp_count("text", F.lit(WORDS)).cast("bigint").alias("words"),
    )
    return positions(rows, [F.col("turn").asc_nulls_first(), "role", "_start", "h1"]).select("conv_id", "pos", "h1", "h2", "words")


# ---------------------------------------------------------------- nodes


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, depth, h1, h2, ...) with a, b: 128 bits that stand for the first ``depth`` turns, and pa, pb: those of one turn less.

    The key of a sequence is the exclusive or of hashes of each turn with its place, so stretches of a long conversation
    are added up apart and put together by their totals.
    """
    own = turns.withColumn("_s", F.floor(F.col("depth") / STRETCH)).withColumn("_x", F.xxhash64("depth", "h1", "h2")).withColumn("_y", F.xxhash64("h2", "depth", "h1"))
    own = own.drop("h1", "h2")
    so_far = Window.partitionBy("conv_id", "_s").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("_a", F.bit_xor("_x").over(so_far)).withColumn("_b", F.bit_xor("_y").over(so_far))
    earlier = Window.partitionBy("conv_id").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy("conv_id", "_s").agg(F.bit_xor("_x").alias("_ta"), F.bit_xor("_y").alias("_tb"))
    totals = totals.select("conv_id", "_s", F.bit_xor("_ta").over(earlier).alias("_ta"), F.bit_xor("_tb").over(earlier).alias("_tb")).where("_ta is not null")
    out = own.join(totals, ["conv_id", "_s"], "left")
    zero = F.lit(0).cast("bigint")
    a, b = F.col("_a").bitwiseXOR(F.coalesce("_ta", zero)), F.col("_b").bitwiseXOR(F.coalesce("_tb", zero))
    out = out.withColumn("a", a).withColumn("b", b).withColumn("pa", F.col("a").bitwiseXOR(F.col("_x"))).withColumn("pb", F.col("b").bitwiseXOR(F.col("_y")))
    return out.drop("_s", "_x", "_y", "_a", "_b", "_ta", "_tb")


def chain_at(steps: Column, depth: Column) -> Column:
    """The heavy chain on which the path described by ``steps`` is at ``depth``."""
    return F.element_at(F.filter(steps, lambda s: s["depth"] <= depth), -1)


def trie_nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie from ``rows`` (conv_id, depth, words, len, a, b, pa, pb) and ``convs`` (conv_id, len), with what the decomposition needs.

    weight is the number of rows at or below a node, which needs no walk: it is the sum of what its members
    have left. A node's heaviest child continues its chain; on any path the chain changes no more often than the weight
    can halve, so ``steps``, where it changes (depth, key of the chain's top), is a short list from which
    every ancestor of the node can be named.
    """
    nodes = rows.groupBy("a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.sum(F.col("len") - F.col("depth") + 1).alias("weight")
    )
    zero = F.lit(0).cast("bigint")
    none = F.lit(None).cast("bigint")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("len") + 1).alias("weight")).where("n_convs > 0")
    root = root.select(zero.alias("a"), zero.alias("b"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("words"), none.alias("pa"), none.alias("pb"), "weight")
    nodes = materialise(nodes.unionByName(root))
    total = nodes.count()
    family = nodes.where("pa is not null").groupBy("pa", "pb").agg(F.count("*").alias("n_children"), F.max(F.struct("weight", "a", "b")).alias("heir"))
    parents = nodes.select("a", "b", F.col("conv_id").alias("parent_conv_id")).join(family, (F.col("a") == F.col("pa")) & (F.col("b") == F.col("pb")))
    parents = materialise(parents.select(F.col("a").alias("pa"), F.col("b").alias("pb"), "parent_conv_id", "n_children", F.col("heir.a").alias("ha"), F.col("heir.b").alias("hb")))
    children = parents.select(F.col("pa").alias("a"), F.col("pb").alias("b"), F.col("n_children").alias("_c"))
    nodes = nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("_c", F.lit(0))).drop("_c")
    up = nodes.where("pa is not null")
    up = attach(up, parents.withColumnRenamed("n_children", "_n"), ["pa", "pb"], ["parent_conv_id", "ha", "hb"], "_n", total, F.xxhash64("a", "b"))
    up = materialise(up.withColumn("light", (F.col("ha") != F.col("a")) | (F.col("hb") != F.col("b"))).drop("ha", "hb"))
    top = nodes.where("pa is null").withColumn("parent_conv_id", none).withColumn("light", F.lit(True))
    # where the path of each conversation that stands for a node changes its chain
    light = up.where("light").select("a", "b", F.col("n_convs").alias("_n"), F.lit(True).alias("light"))
    met = attach(rows.select("conv_id", "depth", "a", "b"), light, ["a", "b"], ["light"], "_n", rows.count(), F.xxhash64("conv_id", "depth")).where("light")
    steps = met.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "a", "b"))).alias("steps"))
    owned = up.groupBy("conv_id").agg(F.count("*").alias("_n"))
    steps = owned.join(steps, "conv_id", "left")
    start = F.array(F.struct(zero.alias("depth"), zero.alias("a"), zero.alias("b")))
    up = attach(up, steps, ["conv_id"], ["steps"], "_n", total, F.xxhash64("a", "b")).withColumn("steps", F.concat(start, F.coalesce("steps", F.array().cast("array<struct<depth:bigint,a:bigint,b:bigint>>"))))
    up = up.withColumn("steps", F.filter("steps", lambda s: s["depth"] <= F.col("depth")))
    return materialise(up.drop("light").unionByName(top.drop("light").withColumn("steps", start)))


# ---------------------------------------------------------------- decomposition


def decompose(parent: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree totals of ``values`` (a row per node) in a forest; parent -1 marks a top; weight falls strictly from parent to child.

    In each round every component has one centroid: the lightest node holding half of the component's weight. What
    hangs below it there, with itself, is added along the path from it to the component's top; it is
    then removed, which leaves components of at most half the weight.
    """
    n = len(parent)
    weight, link, out = weight.astype(np.int64).copy(), parent.copy(), np.zeros_like(values)
    alive = np.arange(n)
    gone = np.zeros(n, bool)
    while len(alive):
        ptr = np.arange(n)
        ptr[alive] = np.where(link[alive] >= 0, link[alive], alive)
        top = lead(ptr)
        # the lightest with half the weight: candidates of a component lie on one path
        able = alive[2 * weight[alive] >= weight[top[alive]]]
        by = np.lexsort((weight[able], top[able]))
        able = able[by]
        centroid = able[np.concatenate(([True], top[able][1:] != top[able][:-1]))]
        ptr[centroid] = centroid
        head = lead(ptr)
        mark = np.zeros(n, bool)
        mark[centroid] = True
        below = alive[mark[head[alive]]]
        sums = np.zeros_like(values)
        np.add.at(sums, head[below], values[below])
        walk, give = centroid.copy(), centroid
        off = weight[centroid].copy()
        while len(walk):
            out[walk] += sums[give]
            weight[walk] -= off
            on = link[walk] >= 0
            walk, give, off = link[walk[on]], give[on], off[on]
        gone[centroid] = True
        alive = alive[~gone[alive]]
        link[alive] = np.where((link[alive] >= 0) & gone[link[alive]], -1, link[alive])
    return out


def lead(ptr: np.ndarray) -> np.ndarray:
    """Where following ``ptr`` ends, by pointer doubling."""
    while True:
        further = ptr[ptr]
        if (further == ptr).all():
            return ptr
        ptr = further


def subtree_totals(nodes: DataFrame, fields: list[str], component: int = COMPONENT) -> DataFrame:
    """(a, b, fields): for each node the sums of ``fields`` over its subtree, by centroid decomposition.

    ``nodes``: a, b (key), pa, pb (parent's key), depth, weight, steps, fields. While a component has
    more than ``component`` nodes, a round finds its centroid, sums up what lies below it, adds that along the
    path to the top and splits: rows of all such components at once, in a number of rounds that grows with the logarithm
    of the weight. Components within the bound are decomposed to the end inside tasks, many to a task.
    """
    zero = F.lit(0).cast("bigint")
    got = [f"got_{f}" for f in fields]
    open_ = nodes.select("a", "b", "pa", "pb", "depth", "weight", "steps", *fields, *[zero.alias(g) for g in got], zero.alias("ca"), zero.alias("cb"), zero.alias("cd"))
    comp = ["ca", "cb", "cd"]
    done: list[DataFrame] = []
    ready: list[DataFrame] = []
    while True:
        open_ = materialise(open_)
        sizes = open_.groupBy(*comp).agg(F.count("*").alias("_n"), F.max("weight").alias("_w"))
        total = open_.count()
        if not total:
            break
        here = attach(open_, sizes, comp, ["_n", "_w"], "_n", total, F.xxhash64("a", "b")).withColumnRenamed("_n", "_size")
        here = materialise(here)
        ready.append(here.where(F.col("_size") <= component).drop("_size", "_w"))
        large = here.where(F.col("_size") > component)
        chain = chain_at(F.col("steps"), F.col("depth"))
        best = large.where("2 * weight >= _w").groupBy(*comp, F.col("_size").alias("_n")).agg(F.min(F.struct("weight", "depth", chain.alias("chain"), "steps")).alias("c"))
        best = best.select(*comp, "_n", F.col("c.weight").alias("c_weight"), F.col("c.depth").alias("c_depth"), F.col("c.chain").alias("c_chain"), F.col("c.steps").alias("c_steps"))
        seen = attach(large, best, comp, ["c_weight", "c_depth", "c_chain", "c_steps"], "_n", total, F.xxhash64("a", "b"))
        under = (F.col("depth") >= F.col("c_depth")) & (chain_at(F.col("steps"), F.col("c_depth")) == F.col("c_chain"))
        over = (F.col("depth") <= F.col("c_depth")) & (chain_at(F.col("c_steps"), F.col("depth")) == chain)
        seen = materialise(seen.withColumn("under", under).withColumn("over", over))
        sums = seen.groupBy(*comp).agg(F.count("*").alias("_n"), *[F.sum(F.when(F.col("under"), F.col(f)).otherwise(0)).alias(f"_s_{f}") for f in fields])
        seen = attach(seen, sums, comp, [f"_s_{f}" for f in fields], "_n", total, F.xxhash64("a", "b"))
        for f, g in zip(fields, got):
            seen = seen.withColumn(g, F.when(F.col("over"), F.col(g) + F.col(f"_s_{f}")).otherwise(F.col(g)))
        seen = materialise(seen)
        done.append(seen.where("under and over").select("a", "b", *got))
        seen = seen.where("not (under and over)")
        part = chain_at(F.col("steps"), F.col("c_depth") + 1)
        open_ = seen.select(
            "a", "b", "pa", "pb", "depth", F.when(F.col("over"), F.col("weight") - F.col("c_weight")).otherwise(F.col("weight")).alias("weight"), "steps", *fields, *got,
            F.when(F.col("under"), part["a"]).otherwise(F.col("ca")).alias("ca"), F.when(F.col("under"), part["b"]).otherwise(F.col("cb")).alias("cb"), F.when(F.col("under"), F.col("c_depth") + 1).otherwise(F.col("cd")).alias("cd"),
        )

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        keys = pd.MultiIndex.from_arrays([rows["a"], rows["b"]])
        # the parent lies in the component unless the node is its top
        at = keys.get_indexer(pd.MultiIndex.from_arrays([rows["pa"], rows["pb"]]))
        same = np.ones(len(rows), bool)
        for c in comp:
            values = rows[c].to_numpy()
            same &= values == values[at]
        at = np.where((at >= 0) & same & (at != np.arange(len(rows))), at, -1)  # the root is its own parent here
        sums = decompose(at, rows["weight"].to_numpy(), rows[fields].to_numpy(np.int64))
        return pd.DataFrame({"a": rows["a"], "b": rows["b"]} | {g: rows[g].to_numpy() + sums[:, k] for k, g in enumerate(got)})

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            held.append(rows)
            if sum(map(len, held)) >= 2 * component:
                rows = pd.concat(held, ignore_index=True)
                last = (rows[comp] == rows[comp].iloc[-1]).all(axis=1).to_numpy()
                if not last.all():
                    yield solve(rows[~last].reset_index(drop=True))
                held = [rows[last]]
        if held and sum(map(len, held)):
            yield solve(pd.concat(held, ignore_index=True))

    tables = [t.select("a", "b", F.coalesce("pa", zero).alias("pa"), F.coalesce("pb", zero).alias("pb"), "weight", *fields, *got, *comp) for t in ready]
    together = tables[0] if tables else None
    for t in tables[1:]:
        together = together.unionByName(t)
    if together is None:
        return nodes.select("a", "b", *fields)
    spread = together.repartition(partitions(nodes.sparkSession), *comp).sortWithinPartitions(*comp)
    out = spread.mapInPandas(local, ", ".join(["a bigint, b bigint", *[f"{g} bigint" for g in got]]))
    for d in done:
        out = out.unionByName(d)
    return out.select("a", "b", *[F.col(g).alias(f) for g, f in zip(got, fields)])


def id_lists(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of ``ends`` (a, b, conv_id): the digest of each node's ids, ascending, joined by commas; a batch is held at a time."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sha = None, None
        for rows in batches:
            out = []
            a, b, ids = (rows[c].to_numpy(np.int64) for c in ("a", "b", "conv_id"))
            cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]) if len(ids) else ():
                text = ",".join(map(str, ids[lo:hi].tolist())).encode()
                if key == (a[lo], b[lo]):
                    sha.update(b"," + text)
                    continue
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (a[lo], b[lo]), hashlib.sha256(text)
            if out:
                yield pd.DataFrame(out, columns=["a", "b", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, sha.hexdigest())], columns=["a", "b", "ends_sha256"])

    return ends.repartition("a", "b").sortWithinPartitions("a", "b", "conv_id").mapInPandas(digest, "a bigint, b bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, component: int = COMPONENT) -> DataFrame:
    """A row for each node of the trie of ``convs`` (conv_id, len) with ``turns`` (conv_id, depth from 1, h1, h2, words).

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless nodes in the
    subtree), saved_tokens (over the subtree, (n_convs - 1) * words of the last turn), ends_sha256 (members that end here).
    A node is a distinct sequence of first turns; sequences are told apart by 128 bits of hash. A conversation may hold any
    share of the turns and a node any share of the conversations; repeated conversations are members of the same nodes. An empty table has no root
    and gives no rows.
    """
    rows = materialise(prefixes(turns.join(convs, "conv_id")) if "len" not in turns.columns else prefixes(turns))
    nodes = trie_nodes(rows, convs)
    nodes = nodes.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words"))
    totals = subtree_totals(nodes, ["n_leaves", "saved_tokens"], component)
    zero = F.lit(0).cast("bigint")
    ends = rows.where("depth = len").select("a", "b", "conv_id").unionByName(convs.where("len = 0").select(zero.alias("a"), zero.alias("b"), "conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(totals, ["a", "b"]).join(id_lists(ends), ["a", "b"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    )


def shared_starts(conversations: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) for ``prefix_trie`` of conversations whose first h = crc32(conv_id) % ``most`` turns are those of conversation conv_id - conv_id % ``every``.

    Null roles and texts count as empty; turns without a conv_id belong to no conversation; only conv_id, turn, role and text are read.
    """
    own = materialise(ordered_turns(conversations))
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(lengths, "base", "left").withColumn("got", F.least("h", F.coalesce("n_base", F.lit(0).cast("bigint"))))
    convs = materialise(convs.withColumn("len", F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    heads = own.where(F.col("pos") < most).withColumnRenamed("conv_id", "base")  # most - 1 rows of a base, every conversations
    heads = convs.select("conv_id", "base", "got", "len").where("got > 0").join(heads, "base").where("pos <= got").select("conv_id", F.col("pos").alias("depth"), "len", "h1", "h2", "words")
    tails = attach(own, convs.select("conv_id", "h", "got", "len", "n"), ["conv_id"], ["h", "got", "len"], "n", own.count(), F.col("pos")).where("pos > h")
    tails = tails.select("conv_id", (F.col("pos") - F.col("h") + F.col("got")).alias("depth"), "len", "h1", "h2", "words")
    return heads.unionByName(tails), convs.select("conv_id", "len")


SQL = r"""
WITH o AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
c0 AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base FROM o GROUP BY conv_id),
poly AS (SELECT i, CASE WHEN i >= 0 THEN i END AS v FROM generate_series(0, 255) AS g(i)),
digits AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s FROM c0),
crc AS (
    WITH RECURSIVE step(conv_id, s, k, bit, x) AS (
        SELECT conv_id, s, 1, 0, xor(4294967295::BIGINT, ascii(s[1])::BIGINT) FROM digits
        UNION ALL
        SELECT conv_id, s, CASE WHEN bit = 7 THEN k + 1 ELSE k END, (bit + 1) % 8,
            xor(CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END, CASE WHEN bit = 7 AND k < length(s) THEN ascii(s[k + 1])::BIGINT ELSE 0 END)
        FROM step WHERE k <= length(s))
    SELECT conv_id, xor(x, 4294967295::BIGINT) % 4 AS h FROM step WHERE k = length(s) + 1),
c AS (SELECT c0.conv_id, base, h, least(h, coalesce((SELECT n FROM c0 b WHERE b.conv_id = c0.base), 0)) AS got FROM c0 JOIN crc USING (conv_id)),
r AS (
    SELECT c.conv_id AS c, o.pos AS d, role, text FROM c JOIN o ON o.conv_id = c.base WHERE o.pos <= c.got
    UNION ALL SELECT c.conv_id, o.pos - h + got, role, text FROM c JOIN o USING (conv_id) WHERE o.pos > h),
p AS (SELECT c, d, text, sha256(string_agg(sha256(role || chr(0) || text), '' ) OVER (PARTITION BY c ORDER BY d)) AS k FROM r
    UNION ALL SELECT conv_id, 0, '', '' FROM c),
pp AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS pk, d = max(d) OVER (PARTITION BY c) AS ends FROM p),
n AS (SELECT k, any_value(d) AS depth, any_value(pk) AS pk, min(c) AS conv_id, count(*) AS n_convs, any_value(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS words,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM pp GROUP BY k),
f AS (SELECT pk AS k, count(*) AS n_children FROM n WHERE pk IS NOT NULL GROUP BY pk),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN f USING (k)),
t AS (SELECT pp.k, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((m.n_convs - 1) * m.words) AS saved FROM m JOIN pp ON pp.c = m.conv_id AND pp.d <= m.depth GROUP BY pp.k)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN t USING (k) LEFT JOIN m u ON u.k = m.pk
"""


@query("op13_prefix_trie", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each started as the first of its twenty."""
    return prefix_trie(*shared_starts(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
