"""Exact, near and line de-duplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from sightline.llm import line_dedup, simhash
from sightline.llm.common import attach, components
from sightline.llm.exact_dedup import exact_groups
from sightline.llm.line_dedup import dedup_lines


def group(n, link):
    """Smallest member reachable of each of n items."""
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if link(i, j):
                a, b = label[i], label[j]
                low = min(a, b)
                label = [low if x in (a, b) else x for x in label]
    return label


# ---------------------------------------------------------------- exact


def exact_brute(rows):
    by = {}
    for d, t in rows:
        by.setdefault(t or "", []).append(d)
    out = []
    for d, t in rows:
        ids = by[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_odd(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((tuple(r) for r in exact_groups(odd).collect()), key=str) == exact_brute(rows)


def test_exact_hot_group_and_shared_prefixes(make):
    rows = [(i, "copy") for i in range(400)] + [(1000 + i, "p" * 64 + chr(97 + i % 5)) for i in range(60)] + [(2000 + i, "p" * 64 + f"{i:04}") for i in range(40)]
    got = sorted((tuple(r) for r in exact_groups(make(rows)).collect()), key=str)
    assert got == exact_brute(rows)


def test_exact_empty(none):
    assert exact_groups(none).collect() == []


# ---------------------------------------------------------------- near


def fingerprint(text, words):
    split = (text or "").encode().lower().split()
    shingles = [b" ".join(split[i : i + words]) for i in range(max(1, len(split) - words + 1))] if split else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints(odd):
    got = {(r.doc_id, r.row): r.f0 & (1 << 64) - 1 for r in simhash.fingerprints(odd, 3).collect()}
    want = {fingerprint(r.text, 3) for r in odd.collect()}
    assert set(got.values()) == want


@pytest.mark.parametrize("tree", [4, 4096])
def test_links_find_every_component(spark, tree):
    rng = random.Random(5)
    points = []
    for _ in range(12):
        middle = rng.getrandbits(64)
        for _ in range(25):
            x = middle
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            points.append(x)
    points = sorted(set(points))
    want = group(len(points), lambda i, j: bin(points[i] ^ points[j]).count("1") <= 3)
    frame = spark.createDataFrame([(simhash.signed(p), simhash.signed(p)) for p in points], "node bigint, f0 bigint")
    links = simhash.links(frame, simhash.pigeonhole(3, 5), 3, tree)
    label = {r.node: r.label for r in components(links).collect()}
    got = [label.get(simhash.signed(p), simhash.signed(p)) for p in points]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_forest_follows_only_near_edges():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    points = np.array([[b ^ np.uint64(1 << int(k))] for b in base for k in rng.integers(0, 63, 10)], np.uint64)
    shard = np.sort(rng.integers(0, 5, len(points)))
    forest = simhash.Forest(shard, points)
    found = {(int(a), int(b)) for x, y in forest.within(np.arange(len(points)), 4) for a, b in zip(x, y)}
    want = {(i, j) for i in range(len(points)) for j in range(len(points)) if i != j and shard[i] == shard[j] and int(points[i, 0] ^ points[j, 0]).bit_count() <= 4}
    assert found == want


def test_near_groups_have_the_smallest_doc_id(make, odd, none):
    text = " ".join(f"w{i}" for i in range(300))
    near = text.replace("w150 ", "changed ")
    rows = [(9, text), (4, near), (11, text), (5, " ".join(f"v{i}" for i in range(300))), (6, None), (7, "")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(make(rows)).collect()}
    assert got == {9: 4, 4: 4, 11: 4, 5: 5, 6: 6, 7: 6}
    kept = {r.doc_id for r in simhash.keep_first(make(rows)).collect()}
    assert kept == {4, 5, 6, 7}
    assert simhash.keep_first(none).collect() == []
    left = [r.doc_id for r in simhash.keep_first(odd).collect()]
    assert sorted(x for x in left if x is not None) == [-9, 2, 3, 4, 6, 7, 8, 2**62] and left.count(None) == 1


def test_near_copies_are_found(make):
    """Texts whose five-word shingles agree to 0.8 or more end up together; unlike texts don't."""
    rng = random.Random(2)
    rows, family = [], {}
    for f in range(40):
        words = [f"t{rng.randrange(4000)}" for _ in range(rng.randint(150, 400))]
        for _ in range(3):
            copy = list(words)
            for _ in range(len(words) // 100):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(9999)}"
            family[len(rows)] = f
            rows.append((len(rows), " ".join(copy)))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(make(rows)).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    alike = [(i, j) for i in family for j in range(i) if family[i] == family[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert sum(got[i] == got[j] for i, j in alike) >= 0.95 * len(alike) and len(alike) > 60
    assert all(family[d] == family[c] for d, c in got.items())


# ---------------------------------------------------------------- helpers


def test_attach_spreads_a_hot_key(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("k"))
    facts = rows.groupBy("k").agg(F.count("*").alias("c"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    out = attach(rows, facts, ["k"], ["c"], "c", 20_000, F.col("id"), heavy=20)
    assert out.where("c is null").count() == 0 and out.count() == 20_000
    cold = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "_salt" in x and "hashpartitioning" in x]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert cold, "the salt must be one of the keys that deal out the rows"


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(200)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(201)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# ---------------------------------------------------------------- lines


def one_apart(x, y):
    if abs(len(x) - len(y)) > 1:
        return False
    s = 0
    while s < min(len(x), len(y)) and x[s] == y[s]:
        s += 1
    return x[s + (len(x) >= len(y)) :] == y[s + (len(y) >= len(x)) :]


def lines_brute(docs):
    """docs: distinct (doc_id, text) rows."""
    seen, out = [], {}
    for d, t in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        keep = []
        for line in (t or "").split("\n"):
            words = line.strip(" \t\r").replace("\t", " ").split(" ")
            if words == [""]:
                keep.append(line)
                continue
            if not any(words == s or len(words) >= 5 and len(s) >= 5 and one_apart(words, s) for s in seen):
                keep.append(line)
            seen.append(words)
        out[d] = None if t is None else "\n".join(keep)
    return out


def test_lines_against_brute_force(make):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 12, 24]))] for _ in range(30)]

    def changed(words):
        words = list(words)
        for _ in range(rng.choice([0, 0, 1, 1, 1, 2])):
            k, i = rng.random(), rng.randrange(len(words))
            if k < 0.33:
                words[i] = rng.choice(vocabulary)
            elif k < 0.66:
                words.insert(rng.randint(0, len(words)), rng.choice(vocabulary))
            elif len(words) > 2:
                del words[i]
        return rng.choice([" ", " ", "\t"]).join(words)

    docs = [(i, "\n".join(changed(rng.choice(base)) for _ in range(rng.randint(0, 6)))) for i in range(200)]
    got = {r.doc_id: r for r in dedup_lines(make(docs)).collect()}
    want = lines_brute(docs)
    assert {d: r.text for d, r in got.items()} == want
    text = dict(docs)
    assert all(r.n_lines - r.n_dropped == (len(want[d].split("\n")) if r.n_dropped < r.n_lines else 0) and r.n_lines == len(text[d].split("\n")) for d, r in got.items())


def test_lines_odd(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = dedup_lines(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_dropped"]
    got = got.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.text for r in got if r.doc_id not in (1, None)}
    assert by[2] is None and by[3] == "" and by[4] == dict(rows)[4] and by[6] == " \n\t " and by[-9] == "one two three four five six seven"
    assert [r.text for r in got if r.doc_id == 1] == ["", ""] and by[5] == "\n".join(x for x in dict(rows)[4].split("\n") if not x.strip())
    assert dedup_lines(none).collect() == []


def test_lines_of_few_words_and_unspaced_scripts(make):
    chinese, line, tabs = "这是一个没有空格的很长的句子它在许多文件里一再出现", "short line of four", "a\tb\tc\td\te\tf"
    rows = [(i, f"{chinese}\n{line}\n\n{tabs}\nown{i}\n") for i in range(5)] + [(5, "a b c d e g"), (6, "short line of five")]
    got = {r.doc_id: r.text for r in dedup_lines(make(rows)).collect()}
    # equal lines go at any length; a fifth of a line may differ, a quarter may not
    assert got == {0: rows[0][1], 5: "", 6: "short line of five"} | {i: f"\nown{i}\n" for i in range(1, 5)}


def test_lines_hot_line_in_a_third_of_rows(make):
    hot = "the very same line stands in a third of all the rows here"
    rows = [(i, f"{hot}\nown line {i} with quite some words {i * 7}" if i % 3 == 0 else f"plain {i} text of row {i} only once {i}") for i in range(600)]
    got = {r.doc_id: r for r in dedup_lines(make(rows)).collect()}
    assert got[0].n_dropped == 0 and all(got[i].n_dropped == 1 for i in range(3, 600, 3)) and all(got[i].n_dropped == 0 for i in range(1, 600, 3))


def test_lines_open_by_shared_keys_alone_however_full_the_filter(make):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(900)}" for _ in range(rng.randint(5, 12))] for _ in range(60)]
    near = [[*w[:i], "other", *w[i + 1 :]] for w in base[:10] for i in [rng.randrange(len(w))]]
    docs = make([(i, " ".join(w)) for i, w in enumerate(base + near + base[20:25])] + [(None, "\n" + " ".join(base[12][:-1]) + "\r")])
    placed = line_dedup.keyed_lines(docs, 1, 5, 2).cache()
    holders = {}
    for r in placed.collect():
        for key in r["keys"] or ():
            holders.setdefault(key, set()).add((r.a, r.b))
    want = {line for group in holders.values() if len(group) > 1 for line in group}
    assert 22 <= len(want) < 60
    for bits in (64, 1 << 16):  # every bit set, hardly one set
        got = line_dedup.open_lines(placed, 2, bits).collect()
        assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
        by = {r.doc_id: r.text for r in dedup_lines(docs, filter_bits=bits).collect()}
        assert [i for i in range(75) if not by[i]] == [*range(60, 75)] and by[None] == ""


def test_links_are_exact_and_recall_is_measured(make):
    """200 single pairs at each similarity: none linked at 0.7, nearly all at 0.8 and at 0.9; a group of copies with one edit each is whole."""
    rng = random.Random(6)
    fresh = lambda n: [f"x{rng.getrandbits(40)}" for _ in range(n)]
    rows, level = [], {}
    for shared, own, name in ((280, 60, 0.7), (320, 40, 0.8), (360, 20, 0.9)):
        for _ in range(200):
            start = fresh(shared + 4)  # so many shingles in common, and so many of its own on either side
            level[len(rows)] = name
            rows += [(len(rows), " ".join(start + fresh(own))), (len(rows) + 1, " ".join(start + fresh(own)))]
    base, first = fresh(300), len(rows)
    for k in range(300):
        copy = list(base)
        copy[rng.randrange(300)] = f"e{k}"
        rows.append((len(rows), " ".join(copy)))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(make(rows)).collect()}
    linked = {name: sum(got[d + 1] == d for d, x in level.items() if x == name) for name in (0.7, 0.8, 0.9)}
    assert linked[0.7] == 0 and linked[0.8] >= 190 and linked[0.9] >= 198, linked
    assert {got[d] for d in range(first, len(rows))} == {first}
