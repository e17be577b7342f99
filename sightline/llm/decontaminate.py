"""Benchmark decontamination: windows of templates in which numbers, names and units are typed placeholders."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import documents, map_batches, without
from sightline.llm.registry import query
from sightline.plans.storage import materialise

WINDOW = 5
#: A document has an item from this share of the item's windows on.
SHARE = 0.5
#: Windows of placeholders with fewer plain words than this say nothing.
PLAIN = 2
#: A document also has an item from a run of so many of its tokens on, whatever the item's length.
RUN = 20
FILTER_BITS = 1 << 22

NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*%?$")
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees kmh mph km/h meter meters metre metres"
).split()
WORD, NUM, UNIT, NAME, NONE = range(5)
MARKS = ("", "<num>", "<unit>", "<name>")
EDGES = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
NUMBERS, MEASURES = frozenset(NUMBER_WORDS), frozenset(UNITS)
CODES = [np.uint64(xxhash.xxh64_intdigest(m, 1)) for m in MARKS]


def token(raw: str) -> tuple[int, str, int, bool]:
    """(hash, core, kind, ends a sentence) of a raw word; NAME is a capitalised word; whether it is a name depends on its place."""
    if letters := raw.isalpha():
        # nothing to cut off, no digit and no sign
        core, ends = raw, False
    else:
        core = EDGES.sub("", raw)
        ends = raw[-1:] in ".!?:" or raw.rstrip("\"')")[-1:] in ".!?"
    low = core.lower()
    if not core:
        return 0, "", NONE, ends
    if low in NUMBERS or not letters and NUMBER.match(core):
        kind = NUM
    elif low in MEASURES:
        kind = UNIT
    elif core[0].isupper() and core[1:].islower():
        kind = NAME
    else:
        kind = WORD
    return xxhash.xxh64_intdigest(low, 1), core, kind, ends


class Tokens:
    """Raw words by number, with what ``token`` says of them as arrays; kept from batch to batch within a bound."""

    KEPT, CHARACTERS = 400_000, 8_000_000

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.table: list[tuple[int, str, int, bool]] = []
        self.hashes, self.kinds, self.ends = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
        self.held = 0

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word; new ones are added."""
        code = self.code
        if unseen := set(words).difference(code):
            new = [*map(token, unseen)]
            code.update(zip(unseen, range(len(self.table), len(self.table) + len(new))))
            self.table += new
            self.held += sum(map(len, unseen))
            hashes, _, kinds, ends = zip(*new)
            self.hashes = np.concatenate((self.hashes, np.array(hashes, np.uint64)))
            self.kinds = np.concatenate((self.kinds, np.array(kinds, np.int64)))
            self.ends = np.concatenate((self.ends, np.array(ends, bool)))
        return np.fromiter(map(code.__getitem__, words), np.int64, len(words))

    def tidy(self) -> None:
        """Between batches: start anew once there are too many words or characters."""
        if len(self.table) > self.KEPT or self.held > self.CHARACTERS:
            self.clear()


class Templates:
    """The templates of a batch of texts as flat arrays; tokens without a letter or digit are left out."""

    def __init__(self, batch: list[str], tokens: Tokens | None = None):
        tokens = tokens or Tokens()
        words: list[str] = []
        sizes, line_starts = [], []
        for text in batch:
            before = len(words)
            for line in text.split("\n"):
                line_starts.append(len(words))
                words += line.split()
            sizes.append(len(words) - before)
        flat = tokens.numbers(words)
        kinds = tokens.kinds[flat]
        starts = np.ones(len(flat) + 1, bool)
        starts[1:] = tokens.ends[flat]
        starts[line_starts] = True
        doc = np.repeat(np.arange(len(batch)), sizes)
        words = tokens.hashes[flat]
        # a capital at the start of a sentence makes a name only of a word that is a name elsewhere in the text
        first = (kinds == NAME) & starts[: len(flat)]
        with np.errstate(over="ignore"):
            own = words + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        kinds[first] = np.where(np.isin(own[first], own[(kinds == NAME) & ~first]), NAME, WORD)
        use = kinds != NONE
        self.table, self.flat, self.kinds, self.doc = tokens.table, flat[use], kinds[use], doc[use]
        self.literal = words[use]
        self.hashes = np.where(self.kinds == WORD, self.literal, np.array(CODES, np.uint64)[self.kinds])
        self.lengths = np.bincount(self.doc, minlength=len(batch))
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and hashes of the windows of ``size`` tokens within one text, and whether they hold enough plain words.

        Those that don't would fit too much as templates; they are hashed by their literal tokens.
        """
        n = len(self.flat) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
        plain = np.zeros(n, np.int64)
        for k in range(size):
            plain += self.kinds[k : k + n] == WORD
        rich = plain >= min(PLAIN, size)
        value = self.hashed(self.hashes, size, size)
        poor = np.flatnonzero(~rich)
        if len(poor):
            value[poor] = self.hashed(self.literal, size, -size, poor)
        good = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return good, value[good], rich[good]

    def hashed(self, hashes: np.ndarray, size: int, start: int, at: np.ndarray | None = None) -> np.ndarray:
        n = len(hashes) - size + 1
        value = np.full(n if at is None else len(at), start & (2**64 - 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                value = (value ^ (hashes[k : k + n] if at is None else hashes[at + k])) * np.uint64(0x9E3779B97F4A7C15)
                value ^= value >> np.uint64(29)
        return value

    def show(self, at: int, size: int, rich: bool) -> tuple[str, list[str]]:
        """The template of a window as text, and what fills its slots; of a window poor in plain words its tokens."""
        words, slots = [], []
        for i in range(at, at + size):
            core, kind = self.table[self.flat[i]][1].lower(), self.kinds[i]
            words.append(rich and MARKS[kind] or core)
            if rich and kind != WORD:
                slots.append(f"{MARKS[kind]}{core}")
        return " ".join(words) if rich else "=" + " ".join(words), slots


ROWS = "window bigint, template string, slots array<string>, pos int, rich boolean"


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, n_windows, n_rich, size, window, template, slots, pos, rich): all windows of each item; a shorter item of three tokens or more is one window."""

    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        made = Templates(rows["text"].tolist())
        out = []
        for size in sorted({window, *range(3, window)}):
            places, values, rich = made.windows(size)
            for at, value, full in zip(places.tolist(), values.view(np.int64).tolist(), rich.tolist()):
                d = int(made.doc[at])
                if size == window or made.lengths[d] == size:
                    out.append((rows["item_id"].iat[d], size, value, *made.show(at, size, full), at - int(made.starts[d]), full))
        return pd.DataFrame(out, columns=["item_id", "size", "window", "template", "slots", "pos", "rich"])

    rows = map_batches(benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")), batch, "item_id bigint, size int, " + ROWS)
    counts = rows.groupBy("item_id").agg(F.countDistinct("pos").alias("n_windows"), F.countDistinct(F.when(F.col("rich"), F.col("pos"))).alias("n_rich"))
    return materialise(rows.join(counts, "item_id"))


def longest_run(places: Column) -> Column:
    """The most consecutive numbers in an ascending array."""
    zero = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(state: Column, x: Column) -> Column:
        run = F.when(x == state["last"] + 1, state["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(state["best"], run).alias("best"))

    return F.aggregate(places, zero, step, lambda s: s["best"])


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, run: int = RUN) -> DataFrame:
    """(doc_id, _row, item_id, n_windows, n_matched, n_run, n_slots, share) of each document and item it contains.

    A document contains an item if a share ``share`` of the item's windows or more occur in it (of all, or of
    those that are templates), or a run of consecutive ones that spans ``run`` tokens. Windows
    poor in plain words are compared by their literal tokens, the others as templates with consistent slots: each number, name or unit of the item stands for one value throughout
    the document's copy; windows that say otherwise don't count. So re-parameterised questions are
    found, and texts that merely share a form are not. Windows are joined by hash and compared as
    text. A bit array of the item windows, of a fixed size, lets a task send on only windows that may
    match, so neither the documents' windows nor the items need fit anywhere.

    _row is a hash of the text, which tells rows of one doc_id apart. Null and empty texts contain nothing, nor
    do items under three tokens occur; equal items are all reported; repeated rows once; extra columns are not
    read; with an empty table on either side there are no rows.
    """
    items = item_windows(benchmark, window)
    spot = F.pmod(F.col("window"), F.lit(FILTER_BITS))
    words = items.groupBy(F.shiftright(spot, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(spot, F.lit(64)).cast("int"))).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words:  # FILTER_BITS / 64 rows at most
        bits[r["at"]] = r["bits"]
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # window sizes: three at most
    shared = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))
    tokens = Tokens()  # each task fills its own

    def batch(rows: pd.DataFrame) -> pd.DataFrame | None:
        out = []
        for start in range(0, len(rows), 512):
            piece = rows.iloc[start : start + 512]
            ids, marks = piece["doc_id"].tolist(), piece["_row"].tolist()
            made = Templates(piece["text"].tolist(), tokens)
            for size in sizes:
                places, values, rich = made.windows(size)
                spots = values.view(np.int64) & (FILTER_BITS - 1)
                hit = np.flatnonzero((shared.value[spots >> 6] >> (spots & 63).astype(np.uint64)) & np.uint64(1))
                for at, value, full in zip(places[hit].tolist(), values[hit].view(np.int64).tolist(), rich[hit].tolist()):
                    d = int(made.doc[at])
                    out.append((ids[d], marks[d], value, *made.show(at, size, full)))
            tokens.tidy()
        if not out:
            return None
        frame = pd.DataFrame(out, columns=["doc_id", "_row", "window", "template", "d_slots"])
        frame["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in frame["doc_id"]], "Int64")
        return frame

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_row", F.xxhash64("text"))
    found = map_batches(texts, batch, "doc_id bigint, _row bigint, window bigint, template string, d_slots array<string>").distinct()
    found = found.join(items.select("item_id", "n_windows", "n_rich", "window", "template", "slots", "pos", "rich"), ["window", "template"])
    found = materialise(found.select("doc_id", "_row", "item_id", "n_windows", "n_rich", "pos", "rich", "slots", "d_slots"))
    # the value that most windows give a slot; of equally many the smaller one
    group = ["doc_id", "_row", "item_id"]
    votes = found.where(F.size("slots") > 0).select(*group, F.explode(F.arrays_zip("slots", "d_slots")).alias("z")).select(*group, "z.slots", "z.d_slots")
    votes = votes.groupBy(*group, "slots", "d_slots").agg(F.count("*").alias("n")).groupBy(*group, "slots").agg(F.min(F.struct(-F.col("n"), "d_slots"))["d_slots"].alias("value"))
    filled = votes.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("slots", "value"))).alias("filled"))
    side = filled.select(F.col("doc_id").alias("_d"), F.col("_row").alias("_r"), F.col("item_id").alias("_i"), "filled")
    joined = found.join(side, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r")) & (F.col("item_id") == F.col("_i")), "left")
    fits = (F.size("slots") == 0) | F.coalesce(F.transform("slots", lambda s: F.element_at("filled", s)) == F.col("d_slots"), F.lit(False))
    places = F.array_sort(F.collect_set("pos"))  # as many as the item has windows, at most
    out = joined.where(fits).groupBy(*group).agg(
        F.max("n_windows").alias("n_windows"), F.max("n_rich").alias("n_rich"), places.alias("at"), F.size(F.collect_set(F.when(F.col("rich"), F.col("pos")))).alias("m_rich"), F.max(F.coalesce(F.size("filled"), F.lit(0))).alias("n_slots")
    )
    out = out.withColumn("n_matched", F.size("at").cast("bigint")).withColumn("n_run", longest_run(F.col("at")))
    out = out.withColumn("share", F.greatest(F.col("n_matched") / F.col("n_windows"), F.coalesce(F.try_divide("m_rich", "n_rich"), F.lit(0.0))))
    out = out.where((F.col("share") >= share) | (F.col("n_run") >= run - window + 1))
    return out.select(*group, "n_windows", "n_matched", "n_run", F.greatest("n_slots", F.lit(0)).alias("n_slots"), "share")


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns as they are, whatever they are called.

    Null and empty texts stay; rows repeated with one doc_id and text stay or go together; with an empty table on either side all rows stay.
    """
    return without(docs, contaminated(docs, benchmark, window, share).withColumnRenamed("_row", "row"))


@query("op3_decontaminate")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, and which."""
    found = contaminated(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "n_windows", "n_matched", "n_run", "n_slots", "share")
