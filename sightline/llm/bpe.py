"""Byte-level BPE by speculation and verification, and its inverse."""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import documents, map_batches, texts
from sightline.llm.registry import query

#: Pieces whose ids are remembered between batches, and the longest that are.
REMEMBERED = 500_000
LONGEST = 64
NEVER = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens, merges and what the checks need of them, from the JSON text of a byte-level BPE tokenizer."""

    def __init__(self, text: str, pattern: str):
        spec = json.loads(text)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or spec["normalizer"] or model["end_of_word_suffix"] or model["continuing_subword_prefix"]:
            raise ValueError("a byte-level BPE without normalizer and affixes is needed")
        self.pattern = regex.compile(pattern)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        vocab = model["vocab"]
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        a = np.array([vocab[x] for x, _ in merges], np.int64)
        b = np.array([vocab[y] for _, y in merges], np.int64)
        made = np.array([vocab[x + y] for x, y in merges], np.int64)
        self.rank = np.full(self.size, -1, np.int64)
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        self.rank[made], self.left[made], self.right[made] = np.arange(len(made)), a, b
        self.merges = {(int(x), int(y)): (r, int(z)) for r, (x, y, z) in enumerate(zip(a, b, made))}
        self.made = made
        keys = a * self.size + b
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order
        self.single = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        # a token counts as a proposal only if merging its own bytes yields it; one made in two ways is left to exact merging
        sound = ~self.crossed(self.left, self.right, inner=True)
        sound[np.unique(made)[np.unique(made, return_counts=True)[1] > 1]] = False
        whole = np.zeros(self.size, bool)
        whole[self.single] = True
        for z, x, y in zip(made.tolist(), a.tolist(), b.tolist()):
            whole[z] = sound[z] and whole[x] and whole[y]
        self.proposals = {self.bytes[i]: int(i) for i in np.flatnonzero(whole)}
        self.reach: dict[bytes, int] = {}  # the longest token by its first three bytes
        for token in self.proposals:
            self.reach[token[:3]] = max(self.reach.get(token[:3], 2), len(token))
        self.known: dict[str, bytes] = {}

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER * 4)

    def crossed(self, a: np.ndarray, b: np.ndarray, inner: bool = False) -> np.ndarray:
        """Whether merging would join something across the border of tokens a and b, for all pairs at once.

        The merges of both sides are undone from the last to the first. ``a`` then is the piece left of
        the border, there until merge ``end_a`` takes it in, and ``b`` the piece right of it. A merge of
        the two that comes before either is taken in crosses the border; of equal merges the one
        further left is first. ``inner`` leaves out the join of the two whole tokens.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        end_a, end_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        crossed, open_ = np.zeros(len(a), bool), np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            rank = self.pair_rank(x, y)
            hit = (rank < end_a[open_]) & (rank <= end_b[open_])
            if inner:
                hit[:], inner = False, False
            crossed[open_[hit]] = True
            back_a, back_b = self.rank[x], self.rank[y]
            on = ~hit & ((back_a >= 0) | (back_b >= 0))
            undo = on & (back_a > back_b)
            i = open_[undo]
            end_a[i], a[i] = back_a[undo], self.right[x[undo]]
            undo = on & ~(back_a > back_b)
            i = open_[undo]
            end_b[i], b[i] = back_b[undo], self.left[y[undo]]
            open_ = open_[on]
        return crossed

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest matches."""
        reach, token_of = self.reach.get, self.proposals.get
        if (whole := token_of(word)) is not None:
            return [whole]
        out, at, n = [], 0, len(word)
        while at < n:
            for size in range(min(reach(word[at : at + 3], 2), n - at), 0, -1):
                if (token := token_of(word[at : at + size])) is not None:
                    out.append(token)
                    at += size
                    break
        return out

    def merge_together(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many short words: each round joins the lowest-ranked, then leftmost pair of every word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        out: list[list[int]] = [[]] * len(words)

        def ranks(i: np.ndarray) -> np.ndarray:
            return np.where(word[i] == word[np.minimum(i + 1, len(word) - 1)], self.pair_rank(ids[i], ids[np.minimum(i + 1, len(ids) - 1)]), NEVER * 4)

        rank = ranks(np.arange(len(ids)))
        rank[-1:] = NEVER * 4
        while len(ids):
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, heads)
            counts = np.diff(np.append(heads, len(ids)))
            if (over := least >= NEVER).any():
                for k in np.flatnonzero(over).tolist():
                    out[word[heads[k]]] = ids[heads[k] : heads[k] + counts[k]].tolist()
                go = np.repeat(~over, counts)
                ids, word, rank, least, counts = ids[go], word[go], rank[go], least[~over], counts[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(least, counts))
            at = at[np.diff(word[at], prepend=-1) > 0]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = np.cumsum(keep)[at] - 1
            ids, word, rank = ids[keep], word[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                rank[i] = ranks(i)
            rank[-1:] = NEVER * 4
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging of one long word: the lowest-ranked, then leftmost pair first."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(self.merges[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = self.merges[x, y][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (ids[p], ids[q]) in self.merges:
                    heapq.heappush(heap, (self.merges[ids[p], ids[q]][0], p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """Ids of each word, and how many words failed the check of adjacent pairs."""
        proposed = [self.propose(w) for w in words]
        count = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(count.sum()))
        word = np.repeat(np.arange(len(words)), count)
        inside = word[1:] == word[:-1]
        pairs, back = np.unique((flat[:-1] * self.size + flat[1:])[inside], return_inverse=True)
        bad = self.crossed(pairs // self.size, pairs % self.size)[back]
        failing = np.unique(word[1:][inside][bad]).tolist()
        short = [i for i in failing if len(words[i]) <= LONGEST]
        for i, ids in zip(short, self.merge_together([words[i] for i in short])):
            proposed[i] = ids
        for i in failing:
            if len(words[i]) > LONGEST:
                proposed[i] = self.merge(words[i])
        return proposed, len(failing)

    def pieces(self, text: str) -> list[str]:
        """The text cut before spaces where no word of the pattern can span the cut, else as one piece."""
        if self.split_unsafe(text):
            return [text]
        head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]]

    @staticmethod
    def split_unsafe(text: str, search=regex.compile(r" (?:\s|$)").search) -> bool:
        return search(text) is not None

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces as little-endian 32-bit integers; all their words are proposed and checked together."""
        words: dict[bytes, int] = {}
        cuts = []
        for piece in pieces:
            cuts.append((piece, [words.setdefault(w.encode(), len(words)) for w in self.pattern.findall(piece)]))
        ids, _ = self.encode_words(list(words))
        flat = np.fromiter((t for x in ids for t in x), "<u4").tobytes()
        ends = np.cumsum([4 * len(x) for x in ids]).tolist()
        packed = [flat[a:b] for a, b in zip([0, *ends], ends)]
        return {piece: b"".join([packed[w] for w in own]) for piece, own in cuts}

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cut = [self.cut.split(t) if self.cut and any(s in t for s in self.special) else [t] for t in batch]
        parts = [[(p if p in self.special else self.pieces(p)) for p in t if p] for t in cut]
        new = {x for t in parts for p in t if isinstance(p, list) for x in p} - self.known.keys()
        if new:
            self.known.update(self.learn(new))
        found = self.known.__getitem__
        out = [b"".join([b"".join(map(found, p)) if isinstance(p, list) else np.array([self.special[p]], "<u4").tobytes() for p in t]) for t in parts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        else:
            for piece in new:
                if len(piece) > LONGEST:
                    del self.known[piece]
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_LOADED: dict[str, Vocabulary] = {}


def loaded(key: str, text: str, pattern: str) -> Vocabulary:
    """The vocabulary, built once in a Python worker."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(text, pattern)
    return _LOADED[key]


def shared_vocabulary(spark: SparkSession, path: str):
    """The file's text, read by the driver and broadcast (a vocabulary: a few MB, checked), and a key for it."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if len(text) > 64 << 20:
        raise ValueError(f"{path} is too large for a vocabulary")
    return spark.sparkContext.broadcast(text), hashlib.sha256(text.encode()).hexdigest()


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row; null and empty texts have no ids; one row for each row of ``docs``."""
    text, key = shared_vocabulary(docs.sparkSession, path)
    pattern = pattern or default_pattern()

    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        ids = loaded(key, text.value, pattern).encode(rows["text"].tolist())
        return pd.DataFrame({"doc_id": rows["doc_id"].array, "ids": [np.frombuffer(x, "<i4") for x in ids]})

    return map_batches(texts(docs), batch, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids are read as none."""
    text, key = shared_vocabulary(encoded.sparkSession, path)
    pattern = pattern or default_pattern()

    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        vocabulary = loaded(key, text.value, pattern)
        return pd.DataFrame({"doc_id": rows["doc_id"].array, "text": [vocabulary.decode(np.asarray(x)) for x in rows["ids"]]})

    return map_batches(encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")), batch, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded and its ids decoded, in one pass without a shuffle.

    Greedy longest matches propose the tokens of each distinct word of a batch, the pair
    check tests all adjacent tokens at once, and only words that fail are merged exactly. Texts
    of any length are read whole; null counts as empty; rows repeat as they come; extra columns are
    not read; an empty table gives an empty result.
    """
    text, key = shared_vocabulary(docs.sparkSession, path)
    pattern = pattern or default_pattern()

    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        vocabulary = loaded(key, text.value, pattern)
        out = []
        for at in range(0, len(rows), 256):
            for ids in vocabulary.encode(rows["text"].iloc[at : at + 256].tolist()):
                decoded = vocabulary.decode(np.frombuffer(ids, "<u4"))
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        result = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        result.insert(0, "doc_id", rows["doc_id"].array)
        return result

    return map_batches(texts(docs), batch, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


@query("op8_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
