"""Distributed ranks, positions, chunks and lookups against pandas."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.functions.columns import sample_kurtosis, sample_skewness
from sightline.plans import ordered, ranks
from sightline.plans.gram import cross_moments, uncentred_vif
from sightline.plans.lookup import attach

SLOW = dict(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, data, parts=3):
    return spark.createDataFrame(pd.DataFrame(data)).repartition(parts)


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    x = np.concatenate([np.full(400, 7.0), rng.normal(size=600).round(2), [np.nan] * 20])
    rng.shuffle(x)
    return pd.DataFrame({"x": x, "y": rng.integers(0, 50, len(x)).astype(float), "k": rng.choice(list("aaab"), len(x))})


@pytest.mark.parametrize("parts", [1, 2, 16, 64])
def test_value_ranks_match_pandas(spark, skewed, parts):
    got = ranks.value_ranks(frame(spark, skewed), ["x", "y"], ranges=parts).toPandas()
    for c in ("x", "y"):
        want = pd.DataFrame({"value": skewed[c], "rank": skewed[c].rank()}).dropna().drop_duplicates().sort_values("value")
        mine = got[got["column"] == c].sort_values("value")
        np.testing.assert_allclose(mine["rank"], want["rank"])
        n = skewed[c].notna().sum()
        assert (mine["rank"] * mine["count"]).sum() == n * (n + 1) / 2


@pytest.mark.parametrize("parts", [None, 5])
def test_value_ranks_by_key(spark, skewed, parts):
    got = ranks.value_ranks(frame(spark, skewed), ["x"], ["k"], ranges=parts).toPandas()
    skewed = skewed.assign(r=skewed.groupby("k")["x"].rank())
    for k, part in skewed.dropna().groupby("k"):
        want = part[["x", "r"]].drop_duplicates().sort_values("x")
        np.testing.assert_allclose(got[got["k"] == k].sort_values("value")["rank"], want["r"])


def test_quantiles_match_pandas(spark, skewed):
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.951, 1.0]
    clean = frame(spark, skewed).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = {r["column"]: r["q"] for r in ranks.quantiles(clean, ["x", "y"], probs).collect()}
    for c in ("x", "y"):
        np.testing.assert_allclose(got[c], skewed[c].quantile(probs), atol=1e-12)


def test_quantiles_by_key(spark, skewed):
    clean = frame(spark, skewed).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = {r["k"]: r["q"] for r in ranks.quantiles(clean, ["x"], [0.25, 0.5], ["k"]).collect()}
    for k, part in skewed.groupby("k"):
        np.testing.assert_allclose(got[k], part["x"].quantile([0.25, 0.5]))


def test_ranks_of_null_keys_odd_names_and_signed_zeros(spark):
    rows = [(None, 2.0), (None, -0.0), (None, 0.0), ("a", float("nan")), ("a", None), ("a", float("-inf")), ("a", 1.0)]
    df = spark.createDataFrame(rows, "`k.1` string, `x.y` double")
    got = {(r["k.1"], r["column"], r["value"]): (r["count"], r["before"], r["rank"], r["n"]) for r in ranks.value_ranks(df, ["x.y"], ["k.1"], ranges=3).collect()}
    assert got == {
        (None, "x.y", 0.0): (2, 0, 1.5, 3), (None, "x.y", 2.0): (1, 2, 3.0, 3),
        ("a", "x.y", float("-inf")): (1, 0, 1.0, 2), ("a", "x.y", 1.0): (1, 1, 2.0, 2),
    }
    assert ranks.value_ranks(df.limit(0), ["x.y"]).collect() == []


def test_ranges_follow_the_rows(spark, monkeypatch):
    """Sorts get more ranges with more rows, whatever the number of shuffle partitions, and the results stay."""
    monkeypatch.setattr(ranks, "RANGE_ROWS", 100)
    sizes = []
    for n in (1_000, 4_000):
        df = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(10 * n)).cast("double").alias("x"), "id")
        got = ranks.value_ranks(df, ["x"])
        assert got.agg(F.sum(F.col("rank") * F.col("count"))).first()[0] == n * (n + 1) / 2
        numbered, total = ranks.row_positions(df, ["x"])
        assert total == n and numbered.agg(F.sum("_pos")).first()[0] == n * (n - 1) // 2
        sizes.append((ranks.range_count(df, n), numbered.rdd.getNumPartitions()))
    assert [s[0] for s in sizes] == [10, 40] and sizes[1][1] == 40 and sizes[0][1] == 10


@settings(**SLOW)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40), st.integers(1, 5))
def test_ranks_do_not_depend_on_layout(spark, values, parts):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(parts)
    got = ranks.value_ranks(df, ["x"]).select("value", "rank").toPandas().sort_values("value")
    want = pd.Series(values, dtype=float).rank()
    assert dict(zip(got["value"], got["rank"])) == dict(zip(map(float, values), want))


def test_attach_ranks_keeps_every_row(spark, skewed):
    df = frame(spark, skewed.dropna())
    got = ranks.attach_ranks(df, ["x", "y"]).toPandas()
    clean = skewed.dropna()
    assert len(got) == len(clean)
    np.testing.assert_allclose(sorted(got["_r0"]), sorted(clean["x"].rank()))
    assert got["_r0"].corr(got["_r1"]) == pytest.approx(clean["x"].rank().corr(clean["y"].rank()))


def test_attach_handles_null_and_unknown_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "z"), (4, "a")], "id int, k string")
    facts = spark.createDataFrame([("a", 9, 2, 4), ("b", 8, 1, 4)], "value string, f int, count bigint, n bigint")
    for heavy in (1, 8):
        got = {r["id"]: r["f"] for r in attach(rows, F.col("k"), facts, ["f"], heavy).collect()}
        assert got == {1: 9, 2: None, 3: None, 4: 9}


def test_row_positions_are_a_total_order(spark):
    rows = [(i % 3, f"v{i % 7}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b string, c int").repartition(5)
    numbered, n = ranks.row_positions(df, ["a", "b"])
    got = [(r["a"], r["b"], r["c"]) for r in numbered.orderBy("_pos").collect()]
    assert n == 500 and got == sorted(rows)
    assert sorted(r["_pos"] for r in numbered.collect()) == list(range(500))


@pytest.mark.parametrize("chunk", [3, 7, 1000])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_chunked_windows_match_pandas(spark, chunk, keys):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.choice(list("aab"), 60), "t": range(60), "v": rng.normal(size=60)})
    got = ordered.over_neighbours(
        frame(spark, pdf),
        ["t"],
        lambda w: {"m": F.sum("v").over(w.rowsBetween(-2, 0)), "nxt": F.lead("v").over(w)},
        back=2,
        ahead=1,
        keys=keys,
        chunk=chunk,
    ).toPandas().sort_values("t")
    grouped = pdf.groupby("k")["v"] if keys else pdf["v"]
    roll = grouped.rolling(3, min_periods=1).sum()
    want = roll.reset_index(level=0, drop=True).sort_index() if keys else roll
    np.testing.assert_allclose(got["m"], want)
    np.testing.assert_allclose(got["nxt"], grouped.shift(-1))
    assert len(got) == 60


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_carry_matches_pandas(spark, forward, keys, monkeypatch):
    monkeypatch.setattr(ordered, "chunk_rows", lambda df, total, reach: 4)
    rng = np.random.default_rng(6)
    v = pd.Series(rng.normal(size=50)).where(rng.random(50) > 0.6)
    pdf = pd.DataFrame({"k": rng.choice(list("ab"), 50), "t": range(50), "v": v})
    df = frame(spark, pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = ordered.carry(df, ["t"], ["v"], forward, keys).toPandas().sort_values("t")["v"]
    base = pdf.groupby("k")["v"] if keys else pdf["v"]
    want = base.ffill() if forward else base.bfill()
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float))


@pytest.mark.parametrize("wide", [2, 100])
def test_moments(spark, wide, monkeypatch):
    from sightline.plans import gram

    monkeypatch.setattr(gram, "WIDE", wide)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 4)) + 100
    x[:, 3] = x[:, 0] + 0.1 * rng.normal(size=200)
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf.loc[0, "b"] = np.nan
    m = cross_moments(frame(spark, pdf), list("abcd"))
    clean = pdf.dropna().to_numpy()
    assert m.n == 199
    np.testing.assert_allclose(m.cov, np.cov(clean.T, ddof=0), rtol=1e-9)
    np.testing.assert_allclose(m.raw(), clean.T @ clean, rtol=1e-9)
    for i, (_, v) in enumerate(uncentred_vif(m).items()):
        others = np.delete(clean, i, 1)
        fit = others @ np.linalg.lstsq(others, clean[:, i], rcond=None)[0]
        r2 = 1 - ((clean[:, i] - fit) ** 2).sum() / (clean[:, i] ** 2).sum()
        assert v == pytest.approx(1 / (1 - r2), rel=1e-5)


def test_sample_shape_statistics(spark, skewed):
    df = frame(spark, skewed.dropna())
    row = df.agg(sample_skewness(F.col("x")), sample_kurtosis(F.col("x"))).first()
    assert row[0] == pytest.approx(skewed["x"].skew(), rel=1e-10)
    assert row[1] == pytest.approx(skewed["x"].kurt(), rel=1e-10)


def test_moments_of_counted_values(spark, skewed):
    df = frame(spark, skewed).withColumn("c", F.lit(0.1)).withColumn("two", F.when(F.col("y") < 0, F.lit(1.0)))
    got = {r["column"]: r for r in ranks.value_moments(ranks.counted_values(df, ["x", "y", "c", "two"])).collect()}
    assert set(got) == {"x", "y", "c"}
    for c in ("x", "y"):
        data = skewed[c].dropna()
        for name, want in (("mean", data.mean()), ("std", data.std()), ("skewness", data.skew()), ("kurtosis", data.kurt()), ("mode", data.mode()[0])):
            assert got[c][name] == pytest.approx(want, rel=1e-9), (c, name)
    assert (got["c"]["std"], got["c"]["skewness"], got["c"]["kurtosis"], got["c"]["count"]) == (0.0, 0.0, 0.0, len(skewed))
    single = ranks.value_moments(spark.createDataFrame([("a", 3.0, 1)], "column string, value double, count bigint")).first()
    assert (single["std"], single["skewness"], single["kurtosis"], single["mode"]) == (None, None, None, 3.0)


def test_no_window_in_a_single_task(spark, load, monkeypatch):
    """Ranks and fills without keys never gather more than one range in one partition."""
    monkeypatch.setattr(ranks, "RANGE_ROWS", 100)
    df = load("events")
    for plan in (
        ranks.value_ranks(df, ["value"]),
        ordered.carry(df.select("event_id", "value"), ["event_id"], ["value"]),
    ):
        text = plan._jdf.queryExecution().executedPlan().toString()
        for piece in text.split("\n"):
            assert "SinglePartition" not in piece or "ENSURE_REQUIREMENTS" in piece and "Window" not in piece
