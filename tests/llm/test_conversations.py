"""Chat formatting and the prefix trie beside plain Python over small tables with odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sightline.llm import chat_format, prefix_trie
from sightline.llm.chat_format import INJECTED, Template

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, n int, state string, none string, pos string, depth int, a string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y", "z", 3, "w") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    """A conversation with half of all rows, nulls, empty and very long texts, ties, repeated rows, control strings."""
    rng = random.Random(5)
    out = [(7, k, ("user", "assistant")[k % 2], f"turn {k} <|im_end|>\n<\\|x") for k in range(600)]
    out += [(c, k, rng.choice(["system", "user", "assistant", "tool", "odd\nrole<n>"]), rng.choice(["a b", "<|im_start|>", "", "x  y z\t"])) for c in range(20, 90) for k in range(rng.randrange(1, 7))]
    out += [(3, None, None, None), (3, None, "user", "first"), (3, 1, "assistant", None), (3, 1, "assistant", None), (4, 0, "user", "w " * 200_000), (None, 0, "user", "no id"), (None, 1, "assistant", "none")]
    out += [(2**53 + 1, 0, "user", "q"), (2**53 + 1, 1, "assistant", "r"), (-5, 0, "user", "q")]
    rng.shuffle(out)
    return out


def in_order(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [(r.decode(), t.decode()) for _, _, r, t in sorted(own)] for c, own in convs.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_format_and_back(spark, rows, tmp_path):
    chat_format.write_formatted(chat_format.format_conversations(table(spark, rows)), str(tmp_path / "f"))
    written = spark.read.parquet(str(tmp_path / "f"))
    got = {r.conv_id: r for r in chat_format.read_back(written).collect()}
    want = in_order(rows)
    assert set(got) == set(want)
    moves = Template().moves
    for c, turns in want.items():
        r = got[c]
        loss = [t for role, t in turns if role == "assistant"]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (sum(map(len, loss)), sha("".join(loss)))
        state, bad = "start", None
        for k, (role, _) in enumerate(turns):
            state = moves.get(state, {}).get(role, "bad")
            bad = k if bad is None and state == "bad" else bad
        assert (r.first_invalid, r.valid) == (bad, state == "assistant"), c
    # no control string is left inside what was put in, and loss is flagged on whole texts only
    for r in written.collect():
        assert [s.loss for s in r.segments][::2] == [False, False]
        assert "<|" not in r.segments[1].text and r.segments[0].text.count("<|") == 1 and r.segments[0].text.count("\n") == 1


def test_escapes_have_a_way_back(spark):
    template, rng = Template(), random.Random(1)
    texts = ["".join(rng.choice("<|\\n>\nx") for _ in range(rng.randrange(12))) for _ in range(2000)] + [INJECTED, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", template.escape("t").alias("e"), template.escape_role("t").alias("r"))
    for r in frame.collect():
        assert "<|" not in r.e and template.unescape(r.e) == r.t
        assert "<|" not in r.r and "\n" not in r.r and template.unescape_role(r.r) == r.t


def test_format_of_nothing(spark):
    assert chat_format.read_back(chat_format.format_conversations(table(spark, []))).collect() == []


def brute_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for key, own in members.items():
        under = [k for k in members if k[: len(key)] == key]
        kids = [k for k in under if len(k) == len(key) + 1]
        leaves = sum(not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in under) for k in under)
        saved = sum((len(members[k]) - 1) * len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", k[-1][1])]) for k in under if k)
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(key))))
        out.add((min(own), len(key), min(members[key[:-1]]) if key else None, len(own), len(kids), leaves, saved, sha(ends)))
    return out


def rebuilt(rows):
    own = {c: t for c, t in in_order(rows).items() if c is not None}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


@pytest.mark.parametrize("component", [3, 50, 10**6])
def test_trie(spark, rows, monkeypatch, component):
    monkeypatch.setattr(prefix_trie, "STRETCH", 16)
    small = [r for r in rows if r[0] != 7 or r[1] < 60] + [(c, k, "user", "copy") for c in range(100, 118) for k in range(3)]
    got = prefix_trie.prefix_trie(*prefix_trie.shared_starts(table(spark, small)), component)
    assert {tuple(r) for r in got.collect()} == brute_trie(rebuilt(small))


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(*prefix_trie.shared_starts(table(spark, []))).collect() == []
    assert prefix_trie.prefix_trie(*prefix_trie.shared_starts(table(spark, [(None, 0, "user", "x")]))).collect() == []


def test_decomposition_of_forests():
    rng = np.random.default_rng(3)
    for shape in ("random", "path", "star", "forest"):
        n = 400
        parent = np.array([-1] + [{"random": rng.integers(0, k), "path": k - 1, "star": 0, "forest": -1 if k % 50 == 0 else k - 1}[shape] for k in range(1, n)])
        values = rng.integers(0, 9, (n, 2))
        want, weight = values.copy(), np.ones(n, np.int64)
        for k in range(n - 1, 0, -1):
            if parent[k] >= 0:
                want[parent[k]] += want[k]
                weight[parent[k]] += weight[k]
        assert (prefix_trie.decompose(parent, weight, values) == want).all()
