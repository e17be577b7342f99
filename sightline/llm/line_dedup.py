"""Line de-duplication by a deletion-neighbourhood join: equal lines and lines one word apart, the earliest is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import attach, documents, packed
from sightline.llm.registry import query
from sightline.plans.storage import materialise

#: Lines of fewer words are never called duplicates; with 1, every line but an empty one can be.
MIN_WORDS = 1
#: From this many words on, one word may be inserted, deleted or replaced: a fifth of the shortest such line.
EDIT_WORDS = 5
#: A line is cut into so many stretches; two lines one edit apart agree outside one of them.
STRETCHES = 2
#: Bits of the filters that keep lines without a candidate partner out of the joins; each is 2 MB and broadcast. A full one costs work, not results.
FILTER_BITS = 1 << 24


def joined_without(array: Column, at: Column, skip: Column, size: Column) -> Column:
    """``array`` of ``size`` entries without the ``skip`` entries from place ``at`` (from 0) on."""
    return F.concat(F.slice(array, F.lit(1), at), F.slice(array, at + skip + 1, F.greatest(size - at - skip, F.lit(0))))


def row_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each line of ``min_words`` words or more: doc_id, _row (hash of the text), pos, line (tabs as spaces), n (words), a, b (128 bits of the line)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # made inside the array, so that each value is computed once and not again in filters and keys above
    spaced = F.replace("text", F.lit("\t"), F.lit(" "))
    # trimming looks at every character, so only lines that need it are trimmed
    outer = lambda x: x.startswith(" ") | x.startswith("\r") | x.endswith(" ") | x.endswith("\r")
    trimmed = F.transform(F.split(spaced, "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.when(outer(x), F.trim(x, F.lit(" \r"))).otherwise(x).alias("line")))
    counted = F.transform(trimmed, lambda x: F.struct(x["pos"], x["line"], (F.octet_length(x["line"]) - F.octet_length(F.replace(x["line"], F.lit(" "), F.lit(""))) + 1).alias("n")))
    rows = rows.select("doc_id", row_hash().alias("_row"), F.inline(F.filter(counted, lambda x: (x["n"] >= min_words) & (x["line"] != ""))))
    return rows.withColumn("a", F.xxhash64("line")).withColumn("b", F.xxhash64(F.lit(1), F.col("line")))


def stretch_keys(line: Column, n: Column, stretches: int) -> list[Column]:
    """Keys of which two lines one edit apart share one: the line without one stretch, at its own length and at one word less.

    Of two lines whose shorter one has m words, with an edit in stretch k, the words before k and
    those after it (counted from the end) are the same. They are cut from the line's text, which
    costs less than an array of its words.
    """
    keys = []
    words = lambda count: F.call_function("substring_index", line, F.lit(" "), count)
    for m in (n, n - 1):
        for k in range(stretches):
            before = F.floor(m * k / stretches).cast("int")
            after = F.greatest(m - F.floor(m * (k + 1) / stretches).cast("int") - 1, F.lit(0))
            keys.append(F.xxhash64(F.lit(k), m, words(before), words(-after)))
    return keys


def keyed_lines(docs: DataFrame, min_words: int, edit_words: int, stretches: int) -> DataFrame:
    """(doc_id, _row, pos, a, b, keys) of ``lines_of``: the stretch keys of a line in place of its text, null below ``edit_words`` words."""
    keys = F.when(F.col("n") >= edit_words, F.array(*stretch_keys(F.col("line"), F.col("n"), stretches)))
    return lines_of(docs, min_words).select("doc_id", "_row", "pos", "a", "b", keys.alias("keys"))


def bit_array(keys: DataFrame, bits: int) -> DataFrame:
    """(_at, _bits) of keys (key): 64 bits a row, those set at which a key lies; bits / 64 rows at most."""
    spot = F.pmod(F.col("key"), F.lit(bits))
    words = keys.groupBy(F.shiftright(spot, 6).alias("_at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(spot, F.lit(64)).cast("int"))).alias("_bits"))
    return materialise(words)


def held(rows: DataFrame, key: str, words: DataFrame, bits: int) -> DataFrame:
    """The rows whose ``key`` may be among those of a bit array, which is broadcast: none that is goes, some others stay."""
    spot = F.pmod(F.col(key), F.lit(bits))
    met = rows.join(F.broadcast(words), F.shiftright(spot, 6) == F.col("_at"))
    return met.where(F.getbit("_bits", F.pmod(spot, F.lit(64)).cast("int")) == 1).drop("_at", "_bits")


def open_lines(placed: DataFrame, stretches: int, filter_bits: int) -> DataFrame:
    """(a, b, doc_id, _row, pos, on) of each different line of ``placed`` that shares a stretch key with another: its first place, and which stretches the edit may lie in.

    A bit array of the shared keys, broadcast, keeps most other lines out of the shuffle; which of the rest
    share a key is then told exactly by a join, however full the bit array is.
    """
    keyed = placed.select("doc_id", "_row", "pos", "a", "b", F.posexplode("keys").alias("k", "key"))
    shared = keyed.groupBy("key").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi")
    likely = held(keyed, "key", bit_array(shared, filter_bits), filter_bits)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "pos", "_row")
    likely = materialise(likely.groupBy("key", "a", "b").agg(F.min(place).alias("place"), F.min(F.col("k") % stretches).alias("k")))
    groups = likely.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1")
    sure = attach(likely, groups, ["key"], ["_n"], "_n", likely.count(), F.col("a")).where(F.col("_n").isNotNull())
    on = F.array(*[F.bool_or(F.col("k") == k) for k in range(stretches)])
    sure = sure.groupBy("a", "b").agg(F.min("place").alias("place"), on.alias("on"))
    return materialise(sure.select("a", "b", "place.doc_id", "place._row", "place.pos", "on"))


def texts_of(docs: DataFrame, lines: DataFrame, min_words: int, filter_bits: int) -> DataFrame:
    """(a, b, first, line, n, on) of ``open_lines``: their texts, cut from the documents that hold them, and their order.

    Bit arrays of those documents and lines, broadcast, keep most others out of the work; a join by place decides.
    """
    own = held(docs.withColumn("_key", F.xxhash64("doc_id", row_hash())), "_key", bit_array(lines.select(F.xxhash64("doc_id", "_row").alias("key")), filter_bits), filter_bits)
    cut = held(lines_of(own, min_words), "a", bit_array(lines.select(F.col("a").alias("key")), filter_bits), filter_bits)
    named = lines.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_of"), F.col("pos").alias("_pos"), "on")
    met = cut.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_of")) & (F.col("pos") == F.col("_pos")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "pos", "a", "b")
    return materialise(met.groupBy("a", "b").agg(F.min(order).alias("first"), F.first("line").alias("line"), F.first("n").alias("n"), F.first("on").alias("on")))


def near_lines(docs: DataFrame, placed: DataFrame, min_words: int, stretches: int, filter_bits: int) -> DataFrame:
    """(a, b) of lines for which an earlier line is one word away.

    Lines that share no stretch key with a different line can have no partner and leave at once. The others
    emit the hash of the line with one word deleted, for each word of the stretch concerned, and of
    the whole line. Equal variants with the word deleted at the same place are lines with one word replaced; a
    variant equal to a whole line is a line with one word more. Each variant is grouped with the
    earliest line only, the edit is verified on the text, and no pairs within a group are made.
    """
    texts = texts_of(docs, open_lines(placed, stretches, filter_bits), min_words, filter_bits)
    rows = texts.withColumn("words", F.split("line", " ")).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    # places to delete at: those of the stretches on, with a word to spare since the partner may be a word shorter
    ranges = []
    for k in range(stretches):
        first = F.floor((F.col("n") - 1) * k / stretches).cast("int")
        last = F.least(F.floor(F.col("n") * (k + 1) / stretches).cast("int") + 1, F.col("n") - 1)
        ranges.append(F.when(F.col("on")[k], F.sequence(first, last)).otherwise(F.array().cast("array<int>")))
    places = F.array_distinct(F.concat(*ranges))
    rows = rows.withColumn("i", F.explode(F.concat(F.array(F.lit(-1)), places)))
    rest = F.when(F.col("i") < 0, F.col("h")).otherwise(joined_without(F.col("h"), F.col("i"), F.lit(1), F.col("n")))
    rows = rows.select("a", "b", "first", "i", F.xxhash64(rest).alias("v"), F.xxhash64(F.lit(1), rest).alias("u"))
    rows = materialise(rows)
    total = rows.count()

    # few variants meet another: bit arrays of those that do keep most of the rest out of the joins
    meeting = lambda met: held(rows.where("i >= 0"), "v", bit_array(met.select(F.col("v").alias("key")), filter_bits), filter_bits)
    # one word replaced: the same rest, deleted at the same place
    same = rows.where("i >= 0").groupBy("v", "u", "i").agg(F.min("first").alias("before"), F.count("*").alias("_n")).where("_n > 1")
    same = materialise(same)
    replaced = attach(meeting(same), same, ["v", "u", "i"], ["before"], "_n", total, F.col("a")).where(F.col("before") < F.col("first"))
    # one word more: a variant equal to a whole line, of which there is one
    whole = rows.where("i < 0").select("v", "u", F.col("first").alias("short"))
    cut = rows.where("i >= 0").groupBy("v", "u").agg(F.min(F.struct("first", "i")).alias("long"), F.count("*").alias("_n")).join(whole, ["v", "u"])
    cut = materialise(cut)
    longer = attach(meeting(cut), cut, ["v", "u"], ["short"], "_n", total, F.col("a")).where(F.col("short") < F.col("first"))
    shorter = cut.where(F.col("long.first") < F.col("short"))
    pairs = (
        replaced.select("a", "b", F.col("before.a").alias("ea"), F.col("before.b").alias("eb"), "i")
        .union(longer.select("a", "b", "short.a", "short.b", "i"))
        .union(shorter.select("short.a", "short.b", "long.first.a", "long.first.b", "long.i"))
        .groupBy("a", "b", "ea", "eb")
        .agg(F.min("i").alias("i"))
    )
    pairs = materialise(pairs)
    named = texts.select(F.col("a").alias("ea"), F.col("b").alias("eb"), F.col("line").alias("earlier"), F.col("n").alias("en"))
    hubs = pairs.groupBy("ea", "eb").agg(F.count("*").alias("_n")).join(named, ["ea", "eb"])
    both = attach(pairs, hubs, ["ea", "eb"], ["earlier", "en"], "_n", pairs.count(), F.col("a"))
    both = both.join(texts.select("a", "b", "line", "n"), ["a", "b"]).where(one_apart(F.col("line"), F.col("n"), F.col("earlier"), F.col("en"), F.col("i")))
    return both.select("a", "b").distinct()


def one_apart(x: Column, n: Column, y: Column, m: Column, i: Column) -> Column:
    """Whether lines x of n and y of m words agree but for one word: replaced at place ``i`` (from 0), or one more there in the longer line."""
    words = lambda line, count: F.call_function("substring_index", line, F.lit(" "), count)
    after = i + 1 - F.greatest(n, m)
    return (F.abs(n - m) <= 1) & (words(x, i) == words(y, i)) & (words(x, after) == words(y, after))


def cut_lines(docs: DataFrame, min_words: int, edit_words: int, stretches: int, filter_bits: int) -> DataFrame:
    """(doc, text, n_lines, n_dropped): each row of ``docs`` as a struct, where no column's name can clash, with its text cut to the lines that stay."""
    placed = materialise(keyed_lines(docs.select("doc_id", "text"), min_words, edit_words, stretches))
    near = near_lines(docs.select("doc_id", "text"), placed, min_words, stretches, filter_bits).withColumn("near", F.lit(True))
    # a document's number (nulls last) and a line's place in one number, of which a hash aggregate can keep the least
    order = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)")) * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos")
    placed = placed.drop("keys")
    total = placed.count()
    once = placed.groupBy("a", "b").agg(F.min(order).alias("first"), F.count("*").alias("_n"))
    facts = once.join(near, ["a", "b"], "left").where("_n > 1 or near")
    facts = materialise(facts.select("a", "b", "first", "_n", F.coalesce("near", F.lit(False)).alias("near")))
    seen = attach(placed, facts, ["a", "b"], ["first", "near"], "_n", total, F.xxhash64("doc_id", "pos"))
    gone = seen.where(F.col("near") | (F.col("first") != order))
    gone = gone.groupBy(F.col("doc_id").alias("_id"), F.col("_row").alias("_of")).agg(F.collect_set("pos").alias("_gone"))
    out = packed(docs).join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_row")), "left").withColumn("text", F.col("doc.text"))
    split = F.split("text", "\n", -1)
    # a map makes the test for each line cheap in texts of very many lines
    kept = F.filter(split, lambda line, i: ~F.map_contains_key("_map", i))
    out = out.withColumn("_map", F.map_from_entries(F.transform("_gone", lambda p: F.struct(p, F.lit(True)))))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.coalesce(F.size(split), F.lit(0))).cast("bigint")
    n_dropped = F.when(F.col("_gone").isNull(), 0).otherwise(F.coalesce(F.size("_gone"), F.lit(0))).cast("bigint")
    return out.select("doc", text.alias("text"), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, edit_words: int = EDIT_WORDS, stretches: int = STRETCHES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` with text cut to the lines that stay, and n_lines, n_dropped; every row and column is kept.

    A line of ``min_words`` words or more, in any script, goes if the same line occurs earlier (by doc_id, nulls last,
    then place), or, from ``edit_words`` words on, an earlier line that differs by one word inserted,
    deleted or replaced. Words are parted by single spaces or tabs, which count as the same; spaces, tabs and carriage
    returns around a line do not count, and empty lines always stay. Whether the earlier line stays itself does not matter. Rows repeated with the same doc_id and text are one document
    and keep the same lines. Null texts stay null with no lines; a text may be of any length; columns
    of ``docs`` named like the two added are replaced, all others come back as they are; an empty table gives an empty result.
    """
    cut = cut_lines(docs, min_words, edit_words, stretches, filter_bits)
    own = [F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return cut.select(*own, "n_lines", "n_dropped")


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS, edit_words: int = EDIT_WORDS, stretches: int = STRETCHES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``dedup_lines`` with the columns of ``docs`` alone: rows all of whose lines went are dropped, and n_chars, if there is one, follows the text.

    Null and empty texts stay, as do all rows of which no line went.
    """
    cut = cut_lines(docs, min_words, edit_words, stretches, filter_bits)
    left = cut.where((F.col("n_dropped") == 0) | (F.length(F.trim(F.col("text"), F.lit(" \t\r\n"))) > 0))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None
    own = {"text": F.col("text"), "n_chars": n_chars}
    return left.select(*[own[c].alias(c) if c in own else F.col(f"doc.`{c}`") for c in docs.columns])


# every variant of every line, without the filter, for documents whose doc_id occurs once
SQL = """
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS raw, trim(replace(ls[i], chr(9), ' '), ' ' || chr(13)) AS line, doc_id::HUGEINT * 2147483648 + i AS o FROM d, unnest(generate_series(1, len(ls))) AS g(i)),
k AS (SELECT * FROM l WHERE line <> ''),
u AS (SELECT line, string_split(line, ' ') AS w, min(o) AS o FROM k GROUP BY line),
v AS (SELECT line, o, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS rest FROM u, unnest(generate_series(1, len(w))) AS g(i) WHERE len(w) >= 5),
near AS (
    SELECT line FROM (SELECT line, o, min(o) OVER (PARTITION BY rest, i) AS m FROM v) WHERE m < o
    UNION SELECT v.line FROM v JOIN u ON v.rest = u.line WHERE len(u.w) >= 5 AND u.o < v.o
    UNION SELECT u.line FROM v JOIN u ON v.rest = u.line WHERE len(u.w) >= 5 AND v.o < u.o),
gone AS (SELECT k.o FROM k JOIN u ON k.line = u.line WHERE k.o <> u.o OR k.line IN (SELECT line FROM near)),
r AS (SELECT l.doc_id, string_agg(raw, chr(10) ORDER BY l.i) FILTER (WHERE gone.o IS NULL) AS rest, count(*) AS n_lines, count(gone.o) AS n_dropped FROM l LEFT JOIN gone ON l.o = gone.o GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(rest, '') END AS text, CASE WHEN d.text IS NULL THEN 0 ELSE n_lines END AS n_lines, n_dropped
FROM d JOIN r ON d.doc_id = r.doc_id
"""


@query("op6_line_dedup", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the lines that stay, its lines and how many went."""
    return dedup_lines(documents(spark, sf_dir, "doc_id", "text"))
