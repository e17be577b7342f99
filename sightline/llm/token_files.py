"""Token files: ids under a static range asymmetric numeral system, in interleaved blocks with checkpoints and checksums."""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.bpe import byte_letters, shared_vocabulary
from sightline.llm.common import documents, map_batches, partitions, split_ids, texts, whole_ids
from sightline.llm.registry import query
from sightline.plans.storage import scratch_path

#: Frequencies add up to 2 ** SCALE, whatever the vocabulary (below 2 ** 17 ids).
SCALE = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
#: Coders side by side in a block, and steps between two checkpoints.
LANES = 2048
STEPS = 256
#: Ids after which a block is closed; a document is never cut, so one longer document is a block of its own.
BLOCK = 1 << 20
MAGIC = b"RTB1"


# ---------------------------------------------------------------- the coder


class Tables:
    """Frequencies and their running sums; every id of the vocabulary has a frequency of 1 at least."""

    def __init__(self, counts: np.ndarray):
        total = 1 << SCALE
        spare = total - len(counts)
        share = counts.astype(np.float64) / max(1, counts.sum())
        freq = 1 + np.floor(share * spare).astype(np.int64)
        freq[int(np.argmax(counts))] += total - freq.sum()
        self.freq = freq.astype(np.uint64)
        self.low = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.filler = int(np.argmax(counts))
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq.astype(np.int64))
        return self._slots


def encode_block(ids: np.ndarray, tables: Tables) -> bytes:
    """One block: header, a checkpoint (lane states, place in the words, CRC) for each STEPS steps, the words."""
    n = len(ids)
    lanes = min(LANES, max(1, n // 32))
    steps = -(-n // lanes)
    grid = np.full(steps * lanes, tables.filler, np.int64)
    grid[:n] = ids
    grid = grid.reshape(steps, lanes)
    freq, low = tables.freq[grid], tables.low[grid]
    top = freq << np.uint64(31 - SCALE + 32)
    state = np.full(lanes, LOW, np.uint64)
    words, marks = [], []
    shift, mask = np.uint64(SCALE), np.uint64(0xFFFFFFFF)
    for s in range(steps - 1, -1, -1):
        f = freq[s]
        over = state >= top[s]
        words.append((state[over] & mask).astype("<u4"))
        state = np.where(over, state >> WORD, state)
        quotient = state // f
        state = (quotient << shift) + (state - quotient * f) + low[s]
        if s % STEPS == 0:
            marks.append((s, state, len(words)))
    sizes = [len(w) for w in words]
    done = np.cumsum(sizes)
    stream = np.concatenate(words[::-1]) if words else np.empty(0, "<u4")
    out = [MAGIC, np.array([n, lanes, steps, len(marks), len(stream)], "<u4").tobytes()]
    for s, states, upto in reversed(marks):
        part = ids[s * lanes : (s + STEPS) * lanes].astype("<u4").tobytes()
        out += [np.array([len(stream) - done[upto - 1], zlib.crc32(part)], "<u4").tobytes(), states.astype("<u8").tobytes()]
    out.append(stream.tobytes())
    body = b"".join(out)
    return body + np.array([zlib.crc32(body)], "<u4").tobytes()


def decode_block(block: bytes, tables: Tables) -> np.ndarray:
    """The ids of a block. All stretches between checkpoints are decoded side by side, and checked."""
    if block[:4] != MAGIC or zlib.crc32(block[:-4]) != int(np.frombuffer(block[-4:], "<u4")[0]):
        raise ValueError("a token block is damaged")
    n, lanes, steps, stretches, size = (int(x) for x in np.frombuffer(block[4:24], "<u4"))
    if not n:
        return np.empty(0, "<u4")
    marks = np.frombuffer(block[24 : 24 + stretches * (8 + 8 * lanes)], np.dtype([("at", "<u4"), ("crc", "<u4"), ("state", "<u8", (lanes,))]))
    stream = np.frombuffer(block[24 + stretches * (8 + 8 * lanes) : -4], "<u4")
    stream = np.append(stream, np.zeros(lanes, "<u4")).astype(np.uint64)
    at, state = marks["at"].astype(np.int64), marks["state"].astype(np.uint64)
    out = np.zeros((stretches, STEPS, lanes), "<u4")
    mask, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    last = steps - (stretches - 1) * STEPS
    for s in range(min(steps, STEPS)):
        if s == last and stretches > 1:
            at, state = at[:-1], state[:-1]
        slot = state & mask
        got = tables.slots[slot.astype(np.int64)]
        out[: len(at), s] = got
        state = tables.freq[got] * (state >> shift) + slot - tables.low[got]
        need = state < LOW
        order = np.cumsum(need, axis=1)
        state = np.where(need, (state << WORD) | stream[at[:, None] + np.maximum(order - 1, 0)], state)
        at = at + order[:, -1]
    ids = out.reshape(-1)[:n]
    for k, crc in enumerate(marks["crc"].tolist()):
        if zlib.crc32(ids[k * STEPS * lanes : (k + 1) * STEPS * lanes].tobytes()) != crc:
            raise ValueError("a stretch of a token block does not match its checksum")
    return ids


# ---------------------------------------------------------------- the tokenizer


class WordEncoder:
    """The tokenizers library, run once for each distinct word.

    A tokenizer whose normalizer and pre-tokenizer never join or look across white space gives a
    text the ids of its words one after the other. Words of plain Latin letters, digits and
    signs, which the normalizer only lower-cases, are cut by the pre-tokenizer's pattern, and each
    piece not met before goes to the library's model; all other words go through the whole library.
    """

    WORDS, PIECES = 400_000, 800_000
    #: Letters that are their own normal form and have the same lower case everywhere.
    PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")
    LINES = re.compile("[\n!-~\u00a1-\u012f\u0131-\u024f]+")
    MARK = b"\xff\xff\xff\xff"  # no id looks like it

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        told = json.loads(spec)
        normal = [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])]
        before = told["pre_tokenizer"].get("pretokenizers", [])
        if normal != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in before] != ["Split", "ByteLevel"] or not before[0]["invert"] or before[0]["behavior"] != "Removed":
            raise ValueError("a tokenizer is needed that lower-cases, drops white space, splits by a pattern and is byte-level")
        self.special = [t["content"] for t in told["added_tokens"]]
        self.cut = regex.compile(before[0]["pattern"]["Regex"] + r"|\n")
        self.letters = {b: c for c, b in byte_letters().items()}
        self.model = self.tokenizer.model
        self.size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1)
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {"\n": self.MARK}

    def whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def learn(self, new: set[str]) -> None:
        plain, odd, fits = [*new], [], self.PLAIN.fullmatch
        joined = "\n".join(plain)
        # most batches have none of either, which one look at all words tells
        if not self.LINES.fullmatch(joined):
            odd = [w for w in plain if not fits(w)]
            plain = [w for w in plain if fits(w)]
        for special in self.special:
            if special in joined:
                odd += [w for w in plain if special in w]
                plain = [w for w in plain if special not in w]
        if odd:
            self.words.update(zip(odd, self.whole(odd)))
            joined = "\n".join(plain)
        if plain:
            found = self.cut.findall(joined.lower())
            fresh = set(found).difference(self.pieces)
            self.pieces.update(zip(fresh, map(self.piece, fresh)))
            self.words.update(zip(plain, b"".join(map(self.pieces.__getitem__, found)).split(self.MARK)))

    def encode(self, batch: list[str], end: int) -> list[bytes]:
        """Ids of each text, with ``end`` after the last, as little-endian 32-bit integers."""
        split = [t.replace("\n", " ").split(" ") for t in batch]
        new = set().union(*split).difference(self.words)
        if new:
            self.learn(new)
        found, last = self.words.__getitem__, np.array([end], "<u4").tobytes()
        out = [b"".join(map(found, s)) + last for s in split]
        if len(self.pieces) > self.PIECES:
            self.pieces = {"\n": self.MARK}
        if len(self.words) > self.WORDS:
            self.words = {"": b""}
        return out


_ENCODERS: dict[str, WordEncoder] = {}
_TABLES: dict[str, Tables] = {}


def encoder(key: str, spec: str) -> WordEncoder:
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(spec)
    return _ENCODERS[key]


def tables_of(counts: bytes) -> Tables:
    key = hashlib.sha256(counts).hexdigest()
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = Tables(np.frombuffer(counts, "<i8"))
    return _TABLES[key]


# ---------------------------------------------------------------- jobs


def packed(ids: bytes, wide: bool) -> bytes:
    return ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def encode_documents(docs: DataFrame, path: str, folder: str, end: int) -> DataFrame:
    """Write (doc_id, tie, ids) of every document to ``folder`` and read it back: ids as 16-bit integers where the vocabulary allows."""
    text, key = shared_vocabulary(docs.sparkSession, path)

    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        words, out = encoder(key, text.value), []
        for at in range(0, len(rows), 256):
            out += [packed(x, words.size > 1 << 16) for x in words.encode(rows["text"].iloc[at : at + 256].tolist(), end)]
        return pd.DataFrame({"doc_id": rows["doc_id"].array, "tie": rows["tie"].array, "ids": out})

    rows = map_batches(texts(docs).withColumn("tie", F.xxhash64("text")), batch, "doc_id bigint, tie bigint, ids binary")
    rows.write.option("compression", "zstd").parquet(f"{folder}/ids")
    return docs.sparkSession.read.parquet(f"{folder}/ids")


def id_counts(encoded: DataFrame, size: int, wide: bool) -> np.ndarray:
    """How often each id occurs in all documents; the driver gets a row for each id of the vocabulary."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 256):
                total += np.bincount(np.frombuffer(b"".join(batch["ids"].iloc[at : at + 256]), "<u4" if wide else "<u2"), minlength=size)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen, "n": total[seen]})

    out = np.zeros(size, np.int64)
    for r in encoded.select("ids").mapInPandas(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write_tokens(docs: DataFrame, path: str, folder: str, end: int = 2) -> None:
    """Write the ids of all documents in ascending doc_id order to ``folder``.

    ``folder``/tables has the frequency tables, counted over all documents; ``folder``/blocks a row for
    each block: the part and its number there, ids before it in the part, doc_ids (and which are null) and id
    counts of its documents, the coded ids. Parts are ranges of doc_id (nulls first), so no
    task sees more than its range, and a task that is run again writes the same blocks.
    ``folder``/ids is what the counting and the coding both read.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as file:
        size = max(WordEncoder(file.read()).size, end + 1)
    wide = size > 1 << 16
    encoded = encode_documents(docs, path, folder, end)
    counts = id_counts(encoded, size, wide).astype("<i8").tobytes()
    spark.createDataFrame([(SCALE, end, counts)], "scale int, end_id int, counts binary").coalesce(1).write.parquet(f"{folder}/tables")
    shared = spark.sparkContext.broadcast(counts)

    def blocks(batches):
        part, number, before = TaskContext.get().partitionId(), 0, 0
        held_ids, held, waiting = [], [], 0

        def close():
            nonlocal number, before, held_ids, held, waiting
            ids = np.frombuffer(b"".join(held), "<u4" if wide else "<u2")
            row = {
                "part": part,
                "block": number,
                "before": before,
                "n_ids": len(ids),
                "doc_ids": [0 if pd.isna(i) else int(i) for i in held_ids],
                "no_ids": [bool(pd.isna(i)) for i in held_ids],
                "lengths": [len(h) // (4 if wide else 2) for h in held],
                "coded": encode_block(ids, tables_of(shared.value)),
            }
            number, before, held_ids, held, waiting = number + 1, before + len(ids), [], [], 0
            return pd.DataFrame([row])

        for batch in whole_ids(batches):
            for doc_id, ids in zip(batch["doc_id"].tolist(), batch["ids"].tolist()):
                held_ids.append(doc_id)
                held.append(ids)
                waiting += len(ids) // (4 if wide else 2)
                if waiting >= BLOCK:
                    yield close()
        if held:
            yield close()

    schema = "part int, block int, before bigint, n_ids bigint, doc_ids array<bigint>, no_ids array<boolean>, lengths array<int>, coded binary"
    order = F.col("doc_id").asc_nulls_first()
    ordered = encoded.repartitionByRange(partitions(spark), order).sortWithinPartitions(order, "tie")
    split_ids(ordered).mapInPandas(blocks, schema).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in ``folder``, and its ids when asked for.

    Blocks are decoded independently of each other. The places of the parts come from a sum for
    each part, so what reaches the driver is a row for each task that wrote.
    """
    blocks = spark.read.parquet(f"{folder}/blocks")
    first = spark.read.parquet(f"{folder}/tables").first()
    if first["scale"] != SCALE:
        raise ValueError("the files use other tables")
    shared = spark.sparkContext.broadcast(bytes(first["counts"]))
    sums = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts, total = {}, 0
    for part, n in sums:
        starts[part], total = total, total + n

    def decode(batch: pd.DataFrame) -> pd.DataFrame:
        tables, out = tables_of(shared.value), []
        for part, before, docs, gone, lengths, coded in zip(batch["part"], batch["before"], batch["doc_ids"], batch["no_ids"], batch["lengths"], batch["coded"]):
            got = decode_block(coded, tables)
            ends = np.cumsum(lengths).tolist()
            for doc_id, missing, a, b in zip(docs.tolist(), gone.tolist(), [0, *ends], ends):
                own = got[a:b]
                out.append((None if missing else doc_id, starts[int(part)] + int(before) + a, b - a, zlib.crc32(own.tobytes())) + ((own.astype(np.int32),) if ids else ()))
        columns = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids
        frame = pd.DataFrame(out, columns=columns)
        frame["doc_id"] = pd.array([r[0] for r in out], "Int64")
        return frame

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids
    return map_batches(blocks.select("part", "before", "doc_ids", "no_ids", "lengths", "coded"), decode, schema)


def round_trip(docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    """Write the token files to the cluster's shared folder and return what is read back from them.

    Null and empty texts have the end id alone; rows repeated with one doc_id follow each
    other by a hash of their texts, rows without a doc_id come first; extra columns are not read;
    an empty table gives an empty result.
    """
    folder = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, folder, end)
    return read_tokens(docs.sparkSession, folder)


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
