"""Secrets and benchmark leaks on planted cases and against brute force."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import time
import urllib.parse
import zlib

import pytest

from sightline.llm import secrets
from sightline.llm.decontaminate import contaminated, keep_clean

SECRET = 'password = "hunter2secret99"'


def base(text):
    """The contract's base matches, by its patterns as they stand."""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_matches():
    rng = random.Random(8)
    parts = ["token", "API_KEY", "apikey", "Secret", "passwd", ":", "=", " ", '"', "'", "abcdef", "x1", "AKIA" + "Q" * 16, "AKIAQQ", "0123456789abcdef" * 2, "deadbeef", "\n", "é", "ſecret=abcdefg", "İ"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        got, spans, _, _ = secrets.find(text)
        assert got == base(text), text
        assert set(got) <= set(spans)


b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
LAYERS = {
    "url": urllib.parse.quote(SECRET),
    "twice url": urllib.parse.quote(urllib.parse.quote(SECRET)),
    "unicode": "".join(f"\\u{ord(c):04x}" for c in SECRET),
    "entities": "".join(f"&#{ord(c)};" for c in SECRET),
    "base64": b64(SECRET),
    "url-safe base64": base64.urlsafe_b64encode((SECRET + "???>>>").encode()).decode(),
    "three times base64": b64(b64(b64(SECRET))),
    "gzip": b64(gzip.compress(SECRET.encode(), mtime=0)),
    "zlib in url in base64": b64(urllib.parse.quote(b64(zlib.compress(SECRET.encode())), safe="")),
    "bz2 of gzip": b64(bz2.compress(gzip.compress(SECRET.encode(), mtime=0))),
}


@pytest.mark.parametrize("name", LAYERS)
def test_nested_layers_map_to_the_document(name):
    text = f"before {LAYERS[name]} after"
    got, spans, layers, cut = secrets.find(text)
    assert got == [] and layers >= 1 and cut == 0
    assert any(k == 0 and 7 <= a < b <= 7 + len(LAYERS[name]) for a, k, b in spans)


def percent(raw):
    return "".join(f"%{b:02x}" for b in raw)


def lines(text, width, joint="\n"):
    return joint.join(text[i : i + width] for i in range(0, len(text), width))


LONG = "some words before it, " * 20 + SECRET + " and some after it" * 20
PACKERS = {"gzip": lambda x: gzip.compress(x, mtime=0), "zlib": zlib.compress, "bz2": bz2.compress, "xz": lzma.compress}


@pytest.mark.parametrize("name", PACKERS)
def test_all_members_broken_streams_and_raw_bytes(name):
    pack = PACKERS[name]
    packed = pack(LONG.encode())
    two = pack(b"first member ") + pack(SECRET.encode())
    assert any(k == 0 for _, k, _ in secrets.find(f"x {b64(two)} y")[1])
    for text in (percent(packed), urllib.parse.quote_from_bytes(packed), "data=" + percent(two), percent(pack(b64(packed).encode()))):
        spans = secrets.find(f"x {text} y")[1]
        assert any(k == 0 and 2 <= a < b <= 2 + len(text) for a, k, b in spans), text
    if name in ("gzip", "zlib"):
        # nothing but the end is damaged or missing: what was unpacked before it counts
        noisy = pack((SECRET + " " + "".join(chr(33 + random.Random(i).randrange(90)) for i in range(900))).encode())
        for broken in (noisy[:-60], noisy[:-6] + bytes(6), noisy[:-3]):
            assert any(k == 0 for _, k, _ in secrets.find(f"x {b64(broken)} y")[1])


@pytest.mark.parametrize("width", [20, 64, 76])
@pytest.mark.parametrize("joint", ["\n", "\r\n", "\n    "])
def test_wrapped_base64_is_one_segment(width, joint):
    for packed in (LONG.encode(), gzip.compress(LONG.encode(), mtime=0), b64(LONG).encode()):
        body = lines(b64(packed), width, joint)
        for before, after in (("", ""), ("Some text:\n", "\nand more words"), ("key: ", "\n\nEnd"), ("-----BEGIN-----\n", "\n-----END-----\n")):
            text = before + body + after
            assert any(k == 0 and len(before) <= a < b <= len(before) + len(body) for a, k, b in secrets.find(text)[1]), text


def test_broken_layers_take_linear_time():
    start = time.monotonic()
    for text in ["A" * 400_000, "Abcdefghijklmnop1\n" * 20_000, "Ab1" * 100_000 + "\n" * 1000, "%78%9c" * 30_000, ("Qa" * 38 + "\n") * 3000, "a \n" * 50_000]:
        assert secrets.find(text)[1] == []
    assert time.monotonic() - start < 60


def test_escapes_map_exactly():
    assert secrets.find("k %41KIAABCDEFGHIJKLMNOP1 z")[1] == [(2, 1, 25)]
    assert secrets.find("café t\\u006fken=abcdefgh!")[1] == [(5, 0, 24)]


def test_key_and_value_parted_by_spaces():
    """Only one of key and value is escaped, with spaces between them."""
    cases = ['"password": "\\u0068unter2pass99"', "token: sk%2Dlive%2Dabc123", "api_key = %41bcdef123", "p%61ssword  =  hunter2pass99", "token %3D abcdefgh", "secret : &#104;unter2pass"]
    cases += ["api_key = %2541bcdef123", "pa%73sword = \\u0068unter2"]
    for case in cases:
        for before, after in (("", ""), ("some words ", " and more"), ("x\n", "\ny")):
            _, spans, _, _ = secrets.find(before + case + after)
            first = case.startswith('"')
            last = case.endswith('"')
            assert (len(before) + first, 0, len(before) + len(case) - last) in spans, case
    assert secrets.find("token:\n%41bcdef123")[1] == []


def test_nothing_to_decode_and_cycles():
    for text in ["", "100% sure %zz", "plain words only Internationalisation", "A" * 5000, "%" * 3000, "z" * 100_000 + "%41", "\\u" * 2000, "%2525252525252525"]:
        assert secrets.find(text)[1] == []


def test_secrets_job(odd, none):
    got = {(r.doc_id, r.spans, r.base_sha256) for r in secrets.secrets(odd).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert {s for _, s, _ in got} == {""} and {h for _, _, h in got} == {empty} and len(secrets.secrets(odd).collect()) == odd.count()
    assert secrets.secrets(none).collect() == []


# ---------------------------------------------------------------- benchmark leaks


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (1, "Maria has 12 apples and gives 5 apples to Paul. How many apples does Maria have in the end?"),
        (2, "a quick test of how the fine old river ran past seven green hills in one long summer night"),
        (3, "short item here"),
        (4, None),
        (5, "two words"),
    ]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_leaks(make, items, odd, none):
    filler = " ".join(f"word{i}" for i in range(80))
    whole = "a quick test of how the fine old river ran past seven green hills in one long summer night"
    rows = [
        (1, f"{filler} {whole} {filler}"),
        (2, f"{filler}\nPeter has 40 apples and gives 7 apples to Anna. How many apples does Peter have in the end? {filler}"),
        (3, filler),
        (4, f"{filler}. Maria has 3 apples and Paul gives 9 apples to Anna. {filler}"),
        (5, whole.upper()),
        (6, "this is a short item here indeed"),
        (7, None),
        (8, ""),
        (9, "apples " * 500),
        (None, whole),
        (10, "two words and three"),
    ]
    got = {(r.doc_id, r.item_id) for r in contaminated(make(rows), items).collect()}
    assert got == {(1, 2), (2, 1), (5, 2), (6, 3), (None, 2)}
    assert sorted(r.doc_id for r in keep_clean(make(rows), items).collect()) == [3, 4, 7, 8, 9, 10]
    assert contaminated(none, items).collect() == [] and contaminated(make(rows), items.where("false")).collect() == []
    assert contaminated(odd, items).collect() == []


def test_slots_must_be_consistent(make, items):
    """The same form with a value that changes half-way is not the item with other values."""
    good = "Peter has 40 apples and gives 7 apples to Anna. How many apples does Peter have in the end?"
    got = {r.doc_id: r for r in contaminated(make([(1, good), (2, good.replace("does Peter", "does Maria").replace("Peter has", "Anna has"))]), items, share=0.95).collect()}
    assert got[1].share == 1.0 and got[1].n_slots >= 2 and 2 not in got


def test_leaks_equal_brute_force_on_the_tables(load):
    docs, bench = load("documents"), load("benchmark")
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    want = set()
    texts = {r.doc_id: " " + " ".join(words(r.text)) + " " for r in docs.collect()}
    for r in bench.collect():
        inner = " ".join(words(r.text)[1:])
        want |= {(d, r.item_id) for d, t in texts.items() if f" {inner} " in t}
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert want <= got and len(got) <= len(want) + 3


def test_passages_and_windows_without_plain_words(spark, make):
    """A run of 20 tokens of a long item is found, and items of numbers and names are found as they stand."""
    long = " ".join(f"palabra{i}" for i in range(80))
    items = spark.createDataFrame([(1, long), (2, "Compute 17 + 23 - 45 / 6 * 81 = 99"), (3, "Anna Bert Carl Dora Emil Fritz Gerd")], "item_id bigint, text string")
    part = lambda n: "before it " + " ".join(long.split()[20 : 20 + n]) + " after it"
    rows = [(1, part(20)), (2, part(19)), (3, "x Compute 17 + 23 - 45 / 6 * 81 = 99 y"), (4, "Compute 18 + 24 - 46 / 7 * 82 = 98"), (5, "so Anna Bert Carl Dora Emil Fritz Gerd met"), (6, "Ute Bert Otto Dora Kurt Fritz Hans")]
    got = {(r.doc_id, r.item_id) for r in contaminated(make(rows), items).collect()}
    assert got == {(1, 1), (3, 2), (5, 3)}


def test_words_of_any_length(make, items):
    rows = [(1, "x" * 9_000_000 + " a"), (2, "Z " * 100), (3, "y" * 300)]
    assert contaminated(make(rows), items).collect() == []


def test_words_of_letters_need_no_patterns(monkeypatch):
    from sightline.llm import decontaminate

    words = ["plain", "Seven", "Miles", "Anna", "ÜBER", "日本語", "kg.", "3.5%", "(Hello)", "...", "x_y", "don't"]
    want = []
    for raw in words:
        core = decontaminate.EDGES.sub("", raw)
        want.append((core, bool(decontaminate.NUMBER.match(core)) or core.lower() in decontaminate.NUMBER_WORDS))
    assert [(t[1], t[2] == decontaminate.NUM) for t in map(decontaminate.token, words)] == want
    monkeypatch.setattr(decontaminate, "EDGES", None)
    monkeypatch.setattr(decontaminate, "NUMBER", None)
    kinds = [decontaminate.token(w)[2] for w in words[:5]]
    assert kinds == [decontaminate.WORD, decontaminate.NUM, decontaminate.UNIT, decontaminate.NAME, decontaminate.WORD]
