"""BPE and token files against the tokenizers library, exact round trips, damaged files."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sightline.llm import bpe, token_files

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABETS = ["ab", "aaab ", "the andi ", "abc\n \t", "it's we'LL 12 \x1c\x1f\x85\xa0  x", "éèñ ßİΣσς日本語\U0001f642a ", "=-_*/ a", "é ́a"]


def samples(n=150):
    rng = random.Random(1)
    out = ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in ALPHABETS for _ in range(n)]
    out += ["a<|endoftext|>b <|endoftext|>", "<|endoftext|>", "x <|startoftext|> y", " a", " ", "  ", "a ", "\n", "a\n b", "a\n \nb", "a \nb", "x" * 3000, "aé" * 2000]
    return out + [f"{chr(c)}a {chr(c)}{chr(c)} 1{chr(c)}" for c in range(1, 0x3000, 7)]


@pytest.fixture(scope="module")
def vocabulary():
    with open(BYTES, encoding="utf-8") as file:
        return bpe.Vocabulary(file.read(), public_tokenizers.PATTERN)


def test_bpe_equals_the_library(vocabulary):
    library = Tokenizer.from_file(BYTES)
    texts = samples()
    for text, got in zip(texts, vocabulary.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert vocabulary.decode(np.array(want)) == library.decode(want, skip_special_tokens=False) == text


def test_bpe_checks_catch_what_greedy_gets_wrong(vocabulary):
    rng = random.Random(4)
    words = [bytes(rng.choice(b"thandersio") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    exact = [vocabulary.merge(w) for w in words]
    assert vocabulary.merge_together(words) == exact
    got, failing = vocabulary.encode_words(words)
    assert got == exact
    assert 0 < failing == sum(vocabulary.propose(w) != e for w, e in zip(words, exact))


def test_bpe_jobs(odd, none):
    library = Tokenizer.from_file(BYTES)
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    want = []
    for d, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted((tuple(r) for r in bpe.round_trip(odd, BYTES).collect()), key=str) == sorted(want, key=str)
    back = bpe.decode(bpe.encode(odd, BYTES), BYTES).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(rows, key=str)
    assert bpe.round_trip(none, BYTES).collect() == []


@pytest.mark.parametrize("n", [0, 1, 31, 32, 5000, 70_000, 1_200_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49_407).astype(np.uint32) if n else np.empty(0, np.uint32)
    tables = token_files.Tables(np.bincount(ids, minlength=49_408))
    assert int(tables.freq.sum()) == 1 << token_files.SCALE and tables.freq.min() >= 1
    block = token_files.encode_block(ids, tables)
    assert (token_files.decode_block(block, tables) == ids).all()
    unseen = np.arange(0, 49_408, 7, dtype=np.uint32)
    assert (token_files.decode_block(token_files.encode_block(unseen, tables), tables) == unseen).all()
    damaged = bytearray(block)
    damaged[len(block) // 2] ^= 1
    with pytest.raises(ValueError):
        token_files.decode_block(bytes(damaged), tables)


def test_words_equal_the_library():
    library = Tokenizer.from_file(WORDS)
    with open(WORDS, encoding="utf-8") as file:
        words = token_files.WordEncoder(file.read())
    texts = samples()
    for text, got in zip(texts, words.encode(texts, 2)):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids + [2], text


def test_token_files(spark, odd, none):
    library = Tokenizer.from_file(WORDS)
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(token_files.round_trip(odd, WORDS).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, _ in rows]
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    ids = lambda t: library.encode(t, add_special_tokens=False).ids + [2]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for d, t in rows)
    assert token_files.round_trip(none, WORDS).collect() == []


def test_plain_words_are_looked_at_together():
    import public_tokenizers
    from sightline.llm.token_files import WordEncoder

    class Never:
        def fullmatch(self, word):
            raise AssertionError(word)

    with open(public_tokenizers.path("word_bpe_49k.json")) as file:
        coder = WordEncoder(file.read())
    mixed = ["plain words here", "日本語 and plain", f"x{coder.special[0]}y z", ""]
    got = coder.encode(mixed, 2)
    for text, ids in zip(mixed, got):
        assert [*memoryview(ids).cast("I")] == coder.tokenizer.encode(text, add_special_tokens=False).ids + [2]
    coder.PLAIN = Never()
    assert coder.encode(["only Latin words, 12 of them"], 2)
