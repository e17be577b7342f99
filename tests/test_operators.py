"""Operators on small frames: definitions, brute force, edge cases."""

import json
import math
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.operators import anomaly, audit, chart_data, cleaning, clusters, encoding, fuzzy, models, near_texts, neighbours
from sightline.operators import personal_data, profile, readiness, shapley, trust, type_repair
from sightline.plans import longform
from sightline.sources import html_tables, readers, writers
from sightline.streaming import stateless


def frame(spark, data, parts=3):
    return spark.createDataFrame(pd.DataFrame(data)).repartition(parts)


# ---------------------------------------------------------------- profile and trust


def test_profile_of_an_awkward_table(spark):
    df = spark.createDataFrame(
        [(1, float("nan"), "x", True, None), (2, 2.0, None, False, None), (3, 2.0, "y", None, None)],
        "id int, v double, s string, b boolean, empty string",
    )
    info = {r["column"]: r for r in profile.column_info(df).collect()}
    assert info["v"]["missing"] == 1 and info["empty"]["distinct_count"] == 0
    assert info["b"]["category"] == "Boolean" and info["s"]["category"] == "Categorical"
    stats = {r["column"]: r for r in profile.describe_numeric(df).collect()}
    assert stats["v"]["mode"] == 2.0 and stats["v"]["std"] == 0.0 and stats["id"]["median"] == 2.0
    assert profile.table_info(df).first()["missing_cells"] == 6


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, s string")
    assert profile.quality_score(df).first()["completeness"] == 0.0
    assert profile.describe_numeric(df).first()["count"] == 0
    assert trust.trust_score(df).count() == 1


def test_sketch_path_of_describe(spark):
    df = frame(spark, {"v": np.arange(1000.0)})
    got = profile.describe_numeric(df, accuracy=1000).first()
    assert abs(got["median"] - 499.5) < 3 and got["mode"] == 0.0


def test_first_values_search_whole_table(spark, monkeypatch):
    monkeypatch.setattr(longform, "HEAD_ROWS", 4)
    df = spark.createDataFrame([(i, None if i < 20 else f"v{i}") for i in range(40)], "i int, s string").repartition(5)
    got = {r["column"]: r["samples"] for r in longform.first_values(df, ["i", "s"], ["i"], 3).collect()}
    assert got == {"i": ["0", "1", "2"], "s": ["v20", "v21", "v22"]}


def test_context_is_json(spark, load):
    c = json.loads(profile.dataset_context(load("customer"), ["c_custkey"]).first()["context"])
    assert c["shape"]["rows"] == 150 and len(c["sample"]) == 5 and c["duplicates"] == 0


def test_trust_flags_constant_and_mixed(spark):
    df = frame(spark, {"k": [1.0] * 40, "m": ["1"] * 10 + ["x"] * 30})
    kinds = {r["kind"] for r in trust.trust_flags(df).collect()}
    assert {"variance", "uniqueness", "size", "consistency"} <= kinds


def test_scanned_once(spark, load):
    plan = profile.missing_analysis(load("orders"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    plan = personal_data.value_matches(load("documents").select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "doc_id" not in plan.split("ReadSchema:")[1]


# ---------------------------------------------------------------- types and personal data


def test_type_rules(spark):
    df = frame(
        spark,
        {
            "i": range(12),
            "price": ["$1,200.50", "€3"] * 6,
            "flag": ["Yes", "no "] * 6,
            "when": ["2024-01-31", "03/04/2023"] * 6,
            "pct": ["4.5%", " 10 %"] * 6,
            "num": ["1e3", "2.5"] * 6,
            "word": ["a", "b"] * 6,
        },
    )
    got = type_repair.detected_fixes(df, ["i"])
    assert got == {
        "price": "currency", "flag": "boolean", "when": "datetime", "pct": "percentage", "num": "numeric",
    }
    fixed = type_repair.apply_type_fixes(df, got).orderBy("i").first()
    assert fixed["price"] == 1200.5 and fixed["flag"] is True and fixed["pct"] == pytest.approx(0.045) and fixed["num"] == 1000.0
    assert str(fixed["when"]) == "2024-01-31 00:00:00"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abcé1@. -", max_size=12), min_size=1, max_size=8))
def test_mask_keeps_length(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", personal_data.mask(F.col("t")).alias("m")).collect():
        t = r["t"]
        assert r["m"] == ("***" if len(t) <= 4 else t[:2] + "*" * (len(t) - 4) + t[-2:])


# ---------------------------------------------------------------- cleaning


@pytest.fixture(scope="module")
def gaps(spark):
    rng = np.random.default_rng(11)
    v = pd.Series(rng.normal(size=60).round(2)).where(rng.random(60) > 0.3)
    return pd.DataFrame({"i": range(60), "v": v, "w": rng.integers(0, 4, 60).astype(float), "s": rng.choice(["p", "q", None], 60)})


def clean_frame(spark, pdf):
    df = frame(spark, pdf)
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def test_fill_in_order(spark, gaps):
    df = clean_frame(spark, gaps)
    got = cleaning.fill_missing(df, {"s": "drop", "v": "mean"}).toPandas().sort_values("i")
    kept = gaps[gaps["s"].notna()]
    np.testing.assert_allclose(got["v"], kept["v"].fillna(kept["v"].mean()))
    got = cleaning.fill_missing(df, {"v": "median", "s": "mode"}).toPandas().sort_values("i")
    np.testing.assert_allclose(got["v"], gaps["v"].fillna(gaps["v"].median()))
    assert list(got["s"]) == list(gaps["s"].fillna(gaps["s"].mode()[0]))
    with pytest.raises(ValueError):
        cleaning.fill_missing(df, {"nope": "mean"})


@pytest.mark.parametrize("method", ["iqr_clip", "zscore_clip", "winsorize"])
def test_clip_bounds_hold(spark, gaps, method):
    got = cleaning.treat_outliers(clean_frame(spark, gaps), method, ["v"]).toPandas().sort_values("i")["v"]
    v = gaps["v"]
    q = v.quantile
    low, high = {
        "iqr_clip": (q(0.25) - 1.5 * (q(0.75) - q(0.25)), q(0.75) + 1.5 * (q(0.75) - q(0.25))),
        "zscore_clip": (v.mean() - 3 * v.std(), v.mean() + 3 * v.std()),
        "winsorize": (q(0.05), q(0.95)),
    }[method]
    np.testing.assert_allclose(got.to_numpy(float), v.clip(low, high).to_numpy(float))


def test_encodings(spark, gaps):
    df = clean_frame(spark, gaps)
    hot = encoding.one_hot(df).toPandas().sort_values("i")
    want = pd.get_dummies(gaps[["i", "s"]], columns=["s"])
    assert list(hot["s_p"]) == list(want["s_p"]) and "s" not in hot.columns
    coded = encoding.label_encode(df).toPandas().sort_values("i")["s"]
    order = {s: i for i, s in enumerate(sorted(gaps["s"].fillna("nan").unique()))}
    assert list(coded) == [order[s] for s in gaps["s"].fillna("nan")]
    freq = encoding.frequency_encode(df).toPandas().sort_values("i")["s"]
    np.testing.assert_allclose(freq.to_numpy(float), gaps["s"].map(gaps["s"].value_counts(normalize=True)).to_numpy(float))


def test_plan_rejects_empty_and_unknown(spark):
    df = spark.createDataFrame([(None,)], "v double")
    with pytest.raises(ValueError, match="no row is left"):
        cleaning.apply_plan(df, {"missing_strategy": {"v": "drop"}})
    with pytest.raises(ValueError, match="unknown settings"):
        cleaning.apply_plan(df, {"drop_all": True})


def test_audit_undo_keeps_ten(spark, tmp_path):
    trail = audit.AuditTrail(spark, str(tmp_path / "trail"))
    for i in range(12):
        trail.save_snapshot(spark.range(i + 1))
    trail.record("drop", ["a"], 10, 7, 2, 2)
    assert trail.versions().where("action = 'save'").count() == 10
    assert trail.undo().count() == 12 and trail.undo().count() == 11
    s = trail.summary().first()
    assert s["total_operations"] == 1 and s["total_rows_affected"] == 3
    trail.clear()
    assert trail.undo() is None and trail.export_log().count() == 0
    trail.record("again")
    assert [r["operation"] for r in trail.export_log().collect()] == ["again"]


def test_audit_outlives_its_session(spark, tmp_path):
    """Another session continues the log, and writers at the same time never share a number or an undone version."""
    folder = str(tmp_path / "trail")
    first = audit.AuditTrail(spark, folder)
    assert not first.can_undo() and first.versions().count() == 0 and first.export_log().count() == 0
    first.save_snapshot(spark.range(3))
    first.record("step", ["a"], 5, 3)
    second = audit.AuditTrail(spark.newSession(), folder)
    assert second.can_undo() and sorted(r["id"] for r in second.undo().collect()) == [0, 1, 2]
    assert not first.can_undo() and first.undo() is None
    assert [r["operation"] for r in first.export_log().collect()] == ["step", audit.UNDO]
    for i in range(4):
        first.save_snapshot(spark.range(10 + i))
    with ThreadPoolExecutor(4) as pool:
        trails = [audit.AuditTrail(spark, folder) for _ in range(4)]
        undone = list(pool.map(lambda t: t.undo().count(), trails))
        list(pool.map(lambda t: t.record("same time"), trails))
    assert sorted(undone) == [10, 11, 12, 13]
    seqs = [r["seq"] for r in audit.AuditTrail(spark, folder)._log().collect()]
    assert sorted(seqs) == list(range(1, len(seqs) + 1)) and len(seqs) == 3 + 4 + 4 + 4


def test_audit_steps_over_a_number_whose_writer_died(spark, tmp_path):
    trail = audit.AuditTrail(spark, str(tmp_path / "trail"))
    trail.record("one")
    (tmp_path / "trail" / "log" / f"{2:012d}.json").write_text("")
    trail.record("two")
    assert [(r["seq"], r["operation"]) for r in trail.export_log().collect()] == [(1, "one"), (3, "two")]


# ---------------------------------------------------------------- neighbours, anomalies, clusters


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_cells_find_the_exact_neighbours(spark, metric):
    rng = np.random.default_rng(17)
    x = np.vstack([rng.normal(size=(150, 3)), rng.normal(6, 0.2, (80, 3)), np.tile([[1.0, 2, 3]], (70, 1))])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, v array<double>")
    got = neighbours.nearest_neighbours(df, df, 4, exclude_self=True, metric=metric, block=40).toPandas()
    gap = x[:, None] - x[None]
    d = np.abs(gap).sum(2) if metric == "manhattan" else np.sqrt((gap**2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, 1)[:, :4]
    got = got.sort_values(["id", "place"])
    np.testing.assert_allclose(got["distance"].to_numpy().reshape(-1, 4), want, atol=1e-9)
    order = np.lexsort((np.tile(np.arange(len(x)), (len(x), 1)), d.round(12)), axis=1)[:, :4]
    same = got["neighbour"].to_numpy().reshape(-1, 4) == order
    assert same.mean() > 0.98


def test_isolation_forest_finds_the_far_points(spark):
    rng = np.random.default_rng(19)
    x = np.vstack([rng.normal(size=(400, 2)), rng.normal(9, 0.5, (8, 2))])
    df = frame(spark, {"id": range(408), "a": x[:, 0], "b": x[:, 1]})
    found = anomaly.detect_anomalies(df, "id", "isolation_forest", 0.02).toPandas()
    assert set(range(400, 408)) <= set(found[found["is_anomaly"]]["id"])
    again = anomaly.isolation_scores(df.repartition(7), ["id"]).toPandas().sort_values("id")
    np.testing.assert_allclose(again["score"], found.sort_values("id")["score"])
    with pytest.raises(ValueError):
        anomaly.detect_anomalies(df.limit(5), "id")


def test_cluster_recovers_blobs(spark):
    rng = np.random.default_rng(23)
    x = np.vstack([rng.normal(c, 0.2, (40, 2)) for c in (0, 5, 10)])
    df = frame(spark, {"id": range(120), "a": x[:, 0], "b": x[:, 1]})
    assert clusters.run_kmeans(df, ["id"]).summary.first()["silhouette"] is None
    done = clusters.run_kmeans(df, ["id"], exact_silhouette=True)
    assert sorted(r["size"] for r in done.sizes.collect()) == [40, 40, 40]
    assert done.summary.first()["silhouette"] > 0.8


# ---------------------------------------------------------------- near-duplicates

PLAIN = st.text(alphabet="abc ", max_size=14)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        diag = 0
        for j, other in enumerate(b):
            diag, row[j + 1] = row[j + 1], max(row[j + 1], row[j], diag + (ch == other))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(PLAIN, PLAIN)
def test_similarity_is_the_subsequence_ratio(a, b):
    want = 1.0 if not a and not b else 2 * lcs(a, b) / (len(a) + len(b))
    assert fuzzy.similarity(a, b) == pytest.approx(want)


def brute_groups(texts, t):
    leader = {}
    for i, a in enumerate(texts):
        if i in leader:
            continue
        leader[i] = i
        for j in range(i + 1, len(texts)):
            if j not in leader and fuzzy.similarity(a, texts[j]) >= t:
                leader[j] = i
    sizes = pd.Series(leader).value_counts()
    return {(v, k) for k, v in leader.items() if sizes[v] > 1}


def test_fuzzy_alignment_stops_and_is_exact():
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefghijklmnop", k=4000))
    far = ["".join(rng.choices("abcdefghijklmnop", k=4000)) for _ in range(3)]
    close = text[:900] + text[1000:2500] + "xyz" * 30 + text[2500:]
    read = []

    class Places(dict):
        def get(self, ch, other=None):
            read.append(ch)
            return super().get(ch, other)

    others = [Places(fuzzy._places(t)) for t in [*far, close]]
    sizes = np.array([len(t) for t in [*far, close]])
    needed = fuzzy._needed(sizes + len(text), 0.85)
    assert fuzzy._common(text, others, sizes, needed).tolist() == [-1, -1, -1, 3900]
    # three unlike texts are given up before the middle, where one like it is read to the end
    assert len(read) < 16 * (16 + 3 * 8)
    whole = fuzzy._common(text, others, sizes, np.zeros(4, int))
    assert whole[3] == 3900 and all(fuzzy.similarity(text, t) == 2 * w / 8000 for t, w in zip(far, whole))


def edited(rng, text, letters, place):
    """``text`` with 0 to 17 in a hundred characters deleted and as many inserted, all over, at one place or at the ends."""
    out, share = list(text), rng.uniform(0, 0.17)
    for change in ["delete"] * int(len(text) * share) + ["insert"] * int(len(text) * rng.choice([0, share])):
        at = {"all": rng.randrange(len(out) + 1), "one": len(out) // 3, "ends": rng.choice([0, len(out)])}[place]
        if change == "insert":
            out.insert(at, rng.choice(letters))
        elif out:
            del out[min(at, len(out) - 1)]
    return "".join(out)


@pytest.mark.parametrize("threshold", [0.6, 0.85, 0.95])
def test_fuzzy_unlike_texts_are_ruled_out_before_an_alignment(threshold, monkeypatch):
    monkeypatch.setattr(near_texts, "FEW", 0)
    monkeypatch.setattr(near_texts, "LAST", 0)
    rng = random.Random(17)
    letters = "eeeeetttaaooiinnsshhrrdlcumwfgypbvk      " + "日本語"
    texts = ["".join(rng.choices(letters, k=k)) for k in (40, 90, 200, 400, 400, 900, 1000, 1700) for _ in range(6)]
    texts += [edited(rng, t, letters, place) for t in texts for place in ("all", "one", "ends")]
    rng.shuffle(texts)
    kept = {(max(i, j), min(i, j)) for i, js in near_texts.near_pairs(texts, None, threshold) for j in js.tolist()}
    half = len(texts) // 2
    sides = [(texts[:half], texts[half:], False), (texts[half:], texts[:half], True)]
    crossed = [{(i, j) for i, js in near_texts.near_pairs(a, b, threshold, strict) for j in js.tolist()} for a, b, strict in sides]
    alike, unlike = 0, 0
    places = [fuzzy._places(t) for t in texts]
    sizes = np.array([len(t) for t in texts])
    for i, text in enumerate(texts):
        common = fuzzy._common(text, places[:i], sizes[:i], fuzzy._needed(sizes[:i] + len(text), threshold)) if i else np.zeros(0)
        for j in np.flatnonzero(common >= 0).tolist():
            assert (i, j) in kept
            assert (i < half or j >= half) or (j, i - half) in crossed[0] or (i - half, j) in crossed[1]
        alike += int((common >= 0).sum())
        unlike += int((common < 0).sum())
    assert alike > 50
    # at 0.6 random texts of these letters are nearly alike
    assert threshold < 0.8 or len(kept) - alike < 0.01 * unlike


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_fuzzy_moved_texts_are_kept_up_to_the_threshold(threshold, monkeypatch):
    monkeypatch.setattr(near_texts, "FEW", 0)
    monkeypatch.setattr(near_texts, "LAST", 0)
    rng = random.Random(23)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for n in (300, 1000, 3000):
        for first, second in ((0, n), (n // 10, n // 2), (n // 3, 2 * n // 3), (n // 2, n)):
            text = "".join(rng.choices(letters, k=n))
            gap = min(int((1 - threshold) * n), second - first)
            new = "".join(rng.choices("#$%&", k=gap))
            # a block out and one in: all between is moved as far as the threshold allows
            for other in (text[:first] + text[first + gap : second] + new + text[second:], text[:first] + new + text[first : second - gap] + text[second:]):
                assert fuzzy.similarity(text, other) >= threshold
                assert len(list(near_texts.near_pairs([text], [other], threshold))) == 1
                assert len(list(near_texts.near_pairs([other], [text], threshold))) == 1
                # and without what came in
                less = text[:first] + text[first + 2 * gap :]
                if len(less) >= n - 2 * gap and fuzzy.similarity(text, less) >= threshold:
                    assert len(list(near_texts.near_pairs([text], [less], threshold))) == 1


def test_fuzzy_pairs_are_aligned_once(spark, monkeypatch):
    met = []
    monkeypatch.setattr(fuzzy, "_meet", lambda texts, leaders, *a, _own=fuzzy._meet, **k: met.append((texts.count(), leaders.count())) or _own(texts, leaders, *a, **k))
    df = spark.createDataFrame([(i, chr(97 + i) * 9) for i in range(6)], "id bigint, t string")
    assert fuzzy.find_fuzzy_duplicates(df, "id", ["t"], 0.85).count() == 0
    assert met == [(6, 6)]


@pytest.mark.parametrize("threshold", [0.6, 0.85, 1.0])
def test_fuzzy_groups_match_brute_force(spark, threshold, monkeypatch):
    monkeypatch.setattr(fuzzy, "FIRST_ROUND", 5)
    rng = np.random.default_rng(29)
    base = ["silver ring small", "large plate steel", "x", ""]
    texts = [list(rng.choice(base)) for _ in range(50)]
    for t in texts:
        for _ in range(rng.integers(0, 4)):
            if t:
                t[rng.integers(0, len(t))] = rng.choice(list("abc"))
    texts = ["".join(t) for t in texts]
    df = frame(spark, {"id": range(50), "t": texts})
    groups = fuzzy.find_fuzzy_duplicates(df, "id", ["t"], threshold)
    assert {(r["leader"], r["member"]) for r in groups.collect()} == brute_groups(texts, threshold)
    assert groups.select("member").distinct().count() == groups.count()
    for strategy, kept in (("keep_first", 1), ("keep_last", 1), ("remove_all", 0)):
        left = fuzzy.merge_fuzzy_duplicates(df, groups, "id", strategy).count()
        table = fuzzy.group_table(df, groups, "id", ["t"])
        assert left == 50 - groups.count() + kept * table.count()


# ---------------------------------------------------------------- models


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(37)
    n = 400
    pdf = pd.DataFrame({"id": range(n), "a": rng.normal(size=n), "b": rng.normal(3, 5, n), "s": rng.choice(list("xyz"), n)})
    pdf["y"] = 4 * pdf["a"] - 0.5 * pdf["b"] + 0.1 * rng.normal(size=n)
    pdf["c"] = np.where(pdf["y"] > 0, "yes", "no")
    return pdf


@pytest.fixture(scope="module")
def prepared(spark, points):
    return models.prepare(frame(spark, points.drop(columns="c")), "y", ["id"])


def test_split_does_not_depend_on_layout(spark, points, prepared):
    again = models.prepare(frame(spark, points.drop(columns="c"), 9), "y", ["id"])
    pick = lambda p: sorted(r["key"]["id"] for r in p.test.collect())
    assert pick(prepared) == pick(again) and 0.12 < len(pick(again)) / 400 < 0.28


@pytest.mark.parametrize("name", ["Ridge", "Lasso", "ElasticNet"])
def test_penalties_match_their_objective(spark, prepared, name):
    model, _ = models.train(name, prepared, {"alpha": 0.3 if name != "Ridge" else 50.0})
    rows = prepared.train.select("scaled", "label").collect()
    X, y = np.array([r["scaled"].toArray() for r in rows]), np.array([r["label"] for r in rows])
    X, y = X - X.mean(0), y - y.mean()
    n = len(y)
    l2, l1 = {"Ridge": (50.0 / n, 0.0), "Lasso": (0.0, 0.3), "ElasticNet": (0.15, 0.15)}[name]
    b = np.zeros(X.shape[1])
    for _ in range(2000):
        for j in range(len(b)):
            rest = X[:, j] @ (y - X @ b + X[:, j] * b[j]) / n
            b[j] = np.sign(rest) * max(abs(rest) - l1, 0) / (X[:, j] @ X[:, j] / n + l2)
    np.testing.assert_allclose(model.coefficients.toArray(), b, atol=2e-4)


def test_arena_orders_and_reports_failures(spark, points):
    df = frame(spark, points.drop(columns="y"))
    arena = models.run_arena(df, "c", ["id"], ["SVR", "Logistic Regression", "KNN"], cross_validate=False)
    board = arena.leaderboard.toPandas()
    assert arena.best == "Logistic Regression" or arena.best == "KNN"
    assert board[board["algorithm"] == "SVR"]["place"].iloc[0] == 3 and board[board["algorithm"] == "SVR"]["error"].notna().all()
    accuracy = board[board["metric"] == "accuracy"].set_index("algorithm")["value"]
    assert accuracy["Logistic Regression"] > 0.9


def test_search_improves_monotonically(spark, prepared):
    found = models.search(prepared, "Lasso", trials=3, folds=3)
    best = [r["best_so_far"] for r in found.trials.orderBy("trial").collect()]
    assert best == sorted(best) and found.best_score == pytest.approx(best[-1]) and found.model is not None


def test_shapley_adds_up(spark, prepared):
    model, _ = models.train("Decision Tree", prepared)
    background = shapley.sample_by_hash(prepared.train, 12)
    explained = shapley.sample_by_hash(prepared.test, 6)
    values = shapley.permutation_shapley(model, background, explained, prepared.features)
    base = shapley.base_value(model, background)
    sums = {r["id"]: r["s"] for r in values.groupBy("id").agg(F.sum("shap_value").alias("s")).collect()}
    for r in model.transform(explained).collect():
        assert base + sums[r["id"]] == pytest.approx(r["prediction"], abs=1e-9)


def test_shapley_of_a_linear_model(spark, prepared):
    model, _ = models.train("Linear Regression", prepared)
    background = shapley.sample_by_hash(prepared.train, 10)
    explained = shapley.sample_by_hash(prepared.test, 5)
    walk = shapley.permutation_shapley(model, background, explained, prepared.features).toPandas()
    exact = shapley.linear_shapley(background, explained, model.coefficients, prepared.features).toPandas()
    both = walk.merge(exact, on=["id", "feature"])
    np.testing.assert_allclose(both["shap_value_x"], both["shap_value_y"], atol=1e-9)


def test_readiness_penalties(spark, points):
    bad = points.assign(copy=points["y"] * 2).head(150)
    row = readiness.readiness(frame(spark, bad), "y").first()
    assert row["leakage"] == "copy" and row["problem_type"] == "regression" and row["score"] == 100 - 25 - 15


# ---------------------------------------------------------------- charts


def test_histogram_of_a_constant(spark):
    got = chart_data.histogram(frame(spark, {"x": [5.0] * 9}), "x", 4).orderBy("bin").toPandas()
    assert list(got["count"]) == [9, 0, 0, 0]


def test_quantile_line_of_long_runs(spark, monkeypatch):
    rng = np.random.default_rng(43)
    x = np.r_[rng.normal(size=300), np.full(400, 0.25)]
    df = frame(spark, {"x": x})
    whole = chart_data.quantile_plot(df, "x")[1].first()
    from sightline.functions.tails import normal_ppf

    z = np.array([normal_ppf(chart_data._filliben(i, 700)) for i in range(1, 701)])
    slope, intercept = np.polyfit(z, np.sort(x), 1)
    assert whole["slope"] == pytest.approx(slope) and whole["intercept"] == pytest.approx(intercept)
    monkeypatch.setattr(chart_data, "SUMMED_RUN", 100)
    assert chart_data._run_sums(100, 600, 700) == pytest.approx((z[99:600].sum(), (z[99:600] ** 2).sum()), rel=1e-4)


# ---------------------------------------------------------------- sources and streams


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_csv_delimiters(spark, tmp_path, sep):
    (tmp_path / "t.csv").write_text(f'a{sep}b\n1{sep}"x, y; z"\n2{sep}w\n')
    got = readers.load_table(spark, str(tmp_path / "t.csv")).orderBy("a").collect()
    assert [r["a"] for r in got] == [1, 2] and got[0]["b"] == "x, y; z"


def test_text_tables(spark, tmp_path):
    (tmp_path / "tab.tsv").write_text("a\tb\n1\t2.5\n")
    (tmp_path / "wide.txt").write_text("name   size\nring     3\nbolt 4\n")
    (tmp_path / "comma.txt").write_text("a,b\n1,2\n")
    assert readers.load_table(spark, str(tmp_path / "tab.tsv")).first()["b"] == 2.5
    assert {r["name"]: r["size"] for r in readers.load_table(spark, str(tmp_path / "wide.txt")).collect()} == {"ring": 3, "bolt": 4}
    assert readers.load_table(spark, str(tmp_path / "comma.txt")).first()["b"] == 2


@pytest.mark.parametrize("orient", ["records", "columns", "index", "split", "values", "lines"])
def test_json_orientations(spark, tmp_path, orient):
    pdf = pd.DataFrame({"a": [1, 2], "b": [2.5, 3.5]})
    text = pdf.to_json(orient="records", lines=True) if orient == "lines" else pdf.to_json(orient=orient)
    (tmp_path / "t.json").write_text(text)
    got = readers.load_table(spark, str(tmp_path / "t.json")).toPandas()
    got.columns = ["a", "b"]
    pd.testing.assert_frame_equal(got.sort_values("a").reset_index(drop=True), pdf, check_dtype=False)


def test_feather_folder_and_unknown_format(spark, tmp_path):
    folder = tmp_path / "t.feather"
    folder.mkdir()
    for i in range(3):
        pd.DataFrame({"a": [i, i + 10], "s": ["p", "q"]}).to_feather(folder / f"{i}.feather", compression="uncompressed")
    got = readers.load_table(spark, str(folder))
    assert sorted(r["a"] for r in got.collect()) == [0, 1, 2, 10, 11, 12]
    with pytest.raises(ValueError, match="Unsupported"):
        readers.load_table(spark, "x.docx")


def test_html_tables(spark, tmp_path):
    page = (
        "<table><tr><td>only</td></tr></table><table><tr><th>n</th><th>v</th></tr>"
        "<tr><td>a &amp; b<td>1<tr><td>c <i>d</i></td><td>2</td></tr></table>"
    )
    (tmp_path / "p.html").write_text(page)
    got = {r["n"]: r["v"] for r in readers.load_table(spark, str(tmp_path / "p.html")).collect()}
    assert got == {"a & b": 1, "c d": 2}
    pages = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "id int, html string")
    cells = html_tables.html_cells(pages, "id", "html")
    assert cells.select("page_id").distinct().count() == 1 and cells.count() == 4


def test_writers(spark, tmp_path, load):
    df = load("nation")
    writers.write_csv(df, str(tmp_path / "c"))
    writers.write_json(df, str(tmp_path / "j"))
    writers.write_parquet(df, str(tmp_path / "p"))
    writers.write_statistics(df, str(tmp_path / "s"))
    assert readers.load_table(spark, str(tmp_path / "c"), "csv").count() == 25
    assert readers.load_table(spark, str(tmp_path / "j"), "json").count() == 25
    assert readers.read_parquet(spark, str(tmp_path / "p")).count() == 25
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 3


def test_streams(spark, sf, load, tmp_path):
    events = load("events")
    source = tmp_path / "in"
    events.write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).parquet(str(source))
    bounds = stateless.zscore_bounds(events, ["value"])
    flagged = stateless.flag_by_bounds(personal_data.mask_columns(stream, "event_type"), bounds)
    bins = stateless.resample_stream(stream, "ts", "value", "1 day", "sum")
    for name, frame_, mode in (("flags", flagged, "append"), ("bins", bins, "complete")):
        q = (
            frame_.writeStream.format("memory").queryName(name).outputMode(mode)
            .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        )
        q.awaitTermination(120)
    still = stateless.flag_by_bounds(events, bounds)
    assert spark.table("flags").where("_anomaly_flag = 'Anomaly'").count() == still.where("_anomaly_flag = 'Anomaly'").count()
    want = events.agg(F.sum("value")).first()[0]
    assert math.isclose(spark.table("bins").agg(F.sum("value")).first()[0], want)


# ---------------------------------------------------------------- names, sizes, hot values


def test_names_with_dots_and_ticks(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (2.0, 3.0), (None, 4.0)], "`a.b` double, `c``d` double")
    got = {r["column"]: r for r in profile.describe_numeric(df).collect()}
    assert got["a.b"]["count"] == 2 and got["c`d"]["median"] == 3.5
    assert {r["column"] for r in profile.missing_analysis(df).collect()} == {"a.b", "c`d"}


def test_distances_by_product_are_exact_for_close_points():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)) + 1e4
    y = np.vstack([x[:100], x[100:200] + 1e-7, rng.normal(size=(50, 8)) + 1e4])
    want = np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))
    assert np.allclose(clusters.distances(x, y), want, rtol=1e-9, atol=1e-12)
    assert (clusters.distances(x, y)[np.arange(100), np.arange(100)] == 0).all()


def test_queries_go_to_few_blocks(spark, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    own, sent = PandasCogroupedOps.applyInPandas, []
    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", lambda self, func, schema: sent.append(self._gd1._df.count()) or own(self, func, schema))
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=4)]) for i in range(9000)], "id bigint, v array<double>").repartition(4)
    assert neighbours.nearest_neighbours(df, df, 3, exclude_self=True).count() == 27_000
    # each in its own cell, and in the other one at most
    assert sent[0] == 9000 and sum(sent) <= 18_000


def test_neighbours_are_found_once_for_a_lookup(spark):
    found = spark.sparkContext.accumulator(0)
    near = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5)], "id bigint, neighbour bigint, distance double")

    def seen(batches):
        for b in batches:
            found.add(len(b))
            yield b

    labels = spark.createDataFrame([(1, 3.0), (2, 4.0)], "id bigint, label double")
    got = neighbours.vote(near.mapInPandas(seen, near.schema), labels).collect()
    assert {(r.id, r.prediction) for r in got} == {(1, 4.0), (2, 3.0)} and found.value == 2


def test_silhouette_has_no_row_limit(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(300, 3)), rng.normal(size=(200, 3)) + 4, [[9.0, 9.0, 9.0]] * 40])
    label = [0] * 300 + [1] * 200 + [2] * 40
    from pyspark.ml.functions import array_to_vector

    df = frame(spark, {"v": [list(map(float, r)) for r in x], "cluster": label}).select(array_to_vector("v").alias("features"), F.col("cluster").cast("int").alias("cluster"))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    label = np.array(label)
    want = []
    for i in range(len(x)):
        means = {k: d[i, label == k].sum() / ((label == k).sum() - (k == label[i])) for k in set(label)}
        a = means.pop(label[i])
        want.append((min(means.values()) - a) / max(a, min(means.values())))
    assert clusters.euclidean_silhouette(df, block=64) == pytest.approx(np.mean(want))
    assert clusters.euclidean_silhouette(df) == pytest.approx(np.mean(want))


def test_lookup_parts_identical_rows(spark):
    from sightline.plans.lookup import attach

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([("hot",)] * 3000 + [(f"v{i}",) for i in range(30)], "v string").repartition(3)
        facts = rows.groupBy(F.col("v").alias("value")).agg(F.count("*").alias("count")).withColumn("n", F.lit(3030))
        out = attach(rows, F.col("v"), facts, ["count"], 10)
        assert {(r["v"], r["count"]) for r in out.collect()} == {("hot", 3000), *((f"v{i}", 1) for i in range(30))}
        assert any("_salt" in line and "hashpartitioning" in line for line in out._jdf.queryExecution().executedPlan().toString().split("\n"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_html_pages_of_one_split_are_dealt_out(spark):
    """A small file is one split; its pages are parsed in several tasks, each page once."""
    page = F.concat(F.lit("<table><tr><td>"), F.col("id").cast("string"), F.lit("</td></tr></table>"))
    pages = spark.range(0, 9_000, numPartitions=1).withColumn("html", page)
    got = html_tables.html_cells(pages, "id", "html").withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in got}) > 1
    assert sorted((r["page_id"], r["cells"][0]) for r in got) == [(i, str(i)) for i in range(9_000)]


def test_prepared_rows_of_one_split_are_dealt_out(spark):
    """A fit's passes don't read a narrow table in as few tasks as its file has splits."""
    df = spark.range(0, 40_000, numPartitions=1).select(F.col("id"), (F.col("id") % 97).alias("x"), (F.col("id") * 0.5).alias("y"))
    p = models.prepare(df, "y", ["id"])
    assert p.data.select(F.spark_partition_id()).distinct().count() > 1
    assert p.rows == 40_000 and p.data.select("key.id").distinct().count() == 40_000


def test_cleaning_issues_count_only_texts(spark, monkeypatch):
    """Values of numbers and dates are not shuffled to tell constant columns; the same columns are found."""
    asked = []
    count = longform.distinct_counts
    monkeypatch.setattr(cleaning, "distinct_counts", lambda df, cols, *a: asked.extend(cols) or count(df, cols, *a))
    rows = [(i, 1.0, -0.0 if i % 2 else 0.0, None, "a", f"t{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, one double, zeros double, none int, same string, many string")
    got = {(r["issue"], r["column"]): r["amount"] for r in cleaning.cleaning_issues(df).collect()}
    assert sorted(asked) == ["many", "same"]
    assert {k: v for k, v in got.items() if k[0] in ("constant", "high_cardinality")} == {
        ("constant", "one"): 1, ("constant", "none"): 0, ("constant", "same"): 1, ("high_cardinality", "many"): 60
    }
    numbers = cleaning.cleaning_issues(df.select("id", "one")).where("issue = 'constant'").collect()
    assert [r["column"] for r in numbers] == ["one"]
