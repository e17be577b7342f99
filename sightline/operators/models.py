"""Prepare, train, compare and tune models with MLlib."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.columns import is_boolean, is_datetime, is_numeric, is_text, nan_to_null, quoted, require
from sightline.operators.encoding import label_encode
from sightline.operators.neighbours import nearest_neighbours, vote
from sightline.plans.longform import modes, spread
from sightline.plans.ranks import quantiles, range_count
from sightline.plans.storage import materialise

SEED = 42
FOLDS = 5
CLASS_LIMIT = 20
# No model here can be trained on more classes than this.
CLASS_CAPACITY = 1000
SCALED = {"SVM", "KNN", "Logistic Regression", "Ridge", "Lasso", "ElasticNet"}
CLASSIFIERS = ("Random Forest", "Logistic Regression", "Decision Tree", "KNN", "Naive Bayes", "Gradient Boosting", "SVM", "XGBoost", "LightGBM")
REGRESSORS = ("Random Forest", "Linear Regression", "Decision Tree", "KNN", "Ridge", "Lasso", "ElasticNet", "Gradient Boosting", "XGBoost", "LightGBM")
BOOSTED = {"Gradient Boosting", "XGBoost", "LightGBM"}

LEADERBOARD = (
    "place int, algorithm string, metric string, value double, cv_mean double, cv_std double, "
    "train_size bigint, test_size bigint, error string"
)
IMPORTANCE = "algorithm string, feature string, importance double, place int"
TRIALS = "trial int, params string, score double, best_so_far double"


@dataclass(frozen=True)
class Prepared:
    """Features assembled, target coded, rows split; ``data`` is kept in shared storage."""

    data: DataFrame
    features: list[str]
    classify: bool
    classes: list = field(default_factory=list)
    rows: int = 0
    train_rows: int = 0
    label_spread: float = 0.0

    @property
    def train(self) -> DataFrame:
        return self.data.where(~F.col("is_test"))

    @property
    def test(self) -> DataFrame:
        return self.data.where(F.col("is_test"))


def prepare(df: DataFrame, target: str, key: Sequence[str], test_size: float = 0.2, seed: int = SEED) -> Prepared:
    """Text coded by sorted order, medians for missing features, the target's median or mode for its own gaps.

    Dates become seconds. The split comes from a seeded hash of the key, so it is the
    same on every run and whatever the partitioning.
    """
    require(df, target, *key)
    df = nan_to_null(df)
    kind = df.schema[target].dataType
    features = [
        f.name
        for f in df.schema.fields
        if f.name != target and f.name not in key and (is_numeric(f.dataType) or is_text(f.dataType) or is_boolean(f.dataType) or is_datetime(f.dataType))
    ]
    if not features:
        raise ValueError("no usable feature columns")
    number = is_numeric(kind)
    kinds = df.select(quoted(target)).distinct().where(quoted(target).isNotNull()).limit(CLASS_LIMIT + 1).count()
    classify = not number or kinds <= CLASS_LIMIT

    ids = F.xxhash64(*[quoted(k) for k in key], F.lit(seed))
    split = F.pmod(ids, F.lit(1_000_000)) < int(test_size * 1_000_000)
    base = df.select(
        F.struct(*[quoted(k) for k in key]).alias("key"),
        ids.alias("id"),
        split.alias("is_test"),
        quoted(target).alias("_target"),
        *[
            (F.unix_micros(quoted(c).cast("timestamp")) / 1e6).alias(c) if is_datetime(df.schema[c].dataType) else quoted(c)
            for c in features
        ],
    )
    texts = [c for c in features if is_text(df.schema[c].dataType)]
    if texts:
        base = label_encode(base, texts)
    base = base.withColumns({c: quoted(c).cast("double") for c in features})
    holes = base.agg(*[F.count(F.when(quoted(c).isNull(), 1)) for c in [*features, "_target"]], F.count("*")).first()
    gaps = [c for c, h in zip(features, holes) if h]
    if gaps:
        middle = quantiles(base, gaps, [0.5]).select("column", F.col("q")[0].alias("m"))
        base = base.crossJoin(F.broadcast(spread(middle, gaps, "m", "_md")))
        base = base.withColumns({c: F.coalesce(quoted(c), F.col(f"_md{i}")) for i, c in enumerate(gaps)})
        base = base.drop(*[f"_md{i}" for i in range(len(gaps))])
    if holes[len(features)]:
        if number:
            fill = quantiles(base, ["_target"], [0.5]).select(F.col("q")[0].cast(kind).alias("_fill"))
        else:
            fill = modes(base, ["_target"]).select(F.col("mode").cast(kind).alias("_fill"))
        base = base.crossJoin(F.broadcast(fill)).withColumn("_target", F.coalesce("_target", "_fill")).drop("_fill")
    classes: list = []
    if classify:
        # one entry per class of the model
        found = base.select("_target").distinct().limit(CLASS_CAPACITY + 1).collect()
        if len(found) > CLASS_CAPACITY:
            raise ValueError(f"{target} has more than {CLASS_CAPACITY} classes")
        classes = sorted(r[0] for r in found)
        code = F.array_position(F.array(*[F.lit(c).cast(kind) for c in classes]), F.col("_target")) - 1
        base = base.withColumn("label", code.cast("double"))
    else:
        base = base.withColumn("label", F.col("_target").cast("double"))
    base = VectorAssembler(inputCols=features, outputCol="raw").transform(base)
    base = base.select("key", "id", "is_test", "label", "raw")
    # a narrow table is few splits of a file, and every pass of a fit would read it in as few tasks
    parts = range_count(base, holes[len(features) + 1])
    base = materialise(base.repartition(parts) if parts > 1 else base)
    # the scaler learns from the training rows
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(base.where(~F.col("is_test")))
    data = materialise(scaler.transform(base))
    facts = data.agg(
        F.count("*"), F.count(F.when(~F.col("is_test"), 1)), F.stddev_pop(F.when(~F.col("is_test"), F.col("label")))
    ).first()
    return Prepared(data, features, classify, classes, facts[0], facts[1], facts[2] or 0.0)


# ---------------------------------------------------------------- estimators


def _penalty(ridge: float, lasso: float, spread_y: float) -> dict:
    """MLlib's two settings for 1/2n RSS + ridge/2 sum b^2 + lasso sum |b|.

    MLlib applies its penalty to a target of unit deviation, which multiplies the
    squared part by that deviation.
    """
    squared = ridge * spread_y
    total = lasso + squared
    return {"regParam": total, "elasticNetParam": lasso / total if total else 0.0}


def estimator(name: str, p: Prepared, params: Mapping | None = None):
    """An unfitted MLlib estimator for an algorithm name, or None when there is none."""
    given = dict(params or {})
    column = "scaled" if name in SCALED else "raw"
    common = {"featuresCol": column, "labelCol": "label"}
    n = max(1, p.train_rows)
    several = len(p.classes) > 2

    def one_vs_rest(inner):
        return OneVsRest(classifier=inner, parallelism=4, **common) if several else inner

    if p.classify:
        if name == "Random Forest":
            return RandomForestClassifier(**common, **{"numTrees": 100, "maxDepth": 10, "seed": SEED, "maxBins": 64, **given})
        if name == "Logistic Regression":
            return LogisticRegression(**common, **{"maxIter": 1000, "regParam": 1.0 / n, "standardization": False, **given})
        if name == "Decision Tree":
            return DecisionTreeClassifier(**common, **{"maxDepth": 10, "seed": SEED, "maxBins": 64, **given})
        if name in BOOSTED:
            return one_vs_rest(GBTClassifier(**common, **{"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, "seed": SEED, **given}))
        if name == "Naive Bayes":
            return NaiveBayes(modelType="gaussian", **common)
        if name == "SVM":
            return one_vs_rest(LinearSVC(**common, **{"maxIter": 100, "regParam": 1.0 / n, "standardization": False, **given}))
        return None
    if name == "Random Forest":
        return RandomForestRegressor(**common, **{"numTrees": 100, "maxDepth": 10, "seed": SEED, "maxBins": 64, **given})
    if name == "Decision Tree":
        return DecisionTreeRegressor(**common, **{"maxDepth": 10, "seed": SEED, "maxBins": 64, **given})
    if name in BOOSTED:
        return GBTRegressor(**common, **{"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, "seed": SEED, **given})
    linear = {"standardization": False, **common}
    if name == "Linear Regression":
        return LinearRegression(**linear)
    alpha = given.get("alpha", 1.0)
    if name == "Ridge":
        return LinearRegression(**linear, **_penalty(alpha / n, 0.0, p.label_spread))
    if name == "Lasso":
        return LinearRegression(**linear, maxIter=1000, tol=1e-9, **_penalty(0.0, alpha, p.label_spread))
    if name == "ElasticNet":
        mix = given.get("l1_ratio", 0.5)
        return LinearRegression(**linear, maxIter=1000, tol=1e-9, **_penalty(alpha * (1 - mix), alpha * mix, p.label_spread))
    return None


def _knn_predict(p: Prepared, train: DataFrame, test: DataFrame, k: int = 5, weights: str = "uniform", metric: str = "euclidean") -> DataFrame:
    points = train.select("id", vector_to_array("scaled").alias("v"))
    asks = test.select("id", vector_to_array("scaled").alias("v"))
    near = nearest_neighbours(asks, points, k, metric=metric)
    voted = vote(near, train.select("id", "label"), p.classify, weights)
    return test.select("key", "id", "label").join(voted, "id")


# ---------------------------------------------------------------- metrics


def classification_metrics(predictions: DataFrame) -> dict[str, float]:
    """Accuracy and support-weighted precision, recall and F1 from the confusion counts."""
    cells = predictions.groupBy("label", "prediction").agg(F.count("*").alias("n")).collect()  # classes squared
    total = sum(r["n"] for r in cells)
    if not total:
        return {}
    actual, guessed, hit = {}, {}, {}
    for r in cells:
        actual[r["label"]] = actual.get(r["label"], 0) + r["n"]
        guessed[r["prediction"]] = guessed.get(r["prediction"], 0) + r["n"]
        if r["label"] == r["prediction"]:
            hit[r["label"]] = r["n"]
    out = {"accuracy": sum(hit.values()) / total, "f1_score": 0.0, "precision": 0.0, "recall": 0.0}
    for c, support in actual.items():
        right = hit.get(c, 0)
        precision = right / guessed[c] if guessed.get(c) else 0.0
        recall = right / support
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        for name, v in (("f1_score", f1), ("precision", precision), ("recall", recall)):
            out[name] += v * support / total
    return out


def regression_metrics(predictions: DataFrame) -> dict[str, float]:
    """R2, RMSE and MAE in one aggregate."""
    e = F.col("label") - F.col("prediction")
    row = predictions.agg(
        F.count("*").alias("n"), F.sum(e * e).alias("sse"), F.var_pop("label").alias("v"), F.avg(F.abs(e)).alias("mae")
    ).first()
    if not row["n"]:
        return {}
    spread_y = (row["v"] or 0.0) * row["n"]
    return {"r2": 1 - row["sse"] / spread_y if spread_y else 0.0, "rmse": math.sqrt(row["sse"] / row["n"]), "mae": row["mae"]}


def roc_auc(predictions: DataFrame, score: str = "rawPrediction") -> float:
    evaluator = BinaryClassificationEvaluator(rawPredictionCol=score, labelCol="label", numBins=0)
    return evaluator.evaluate(predictions)


def metrics_table(predictions: DataFrame, classify: bool) -> DataFrame:
    """(metric, value)"""
    values = classification_metrics(predictions) if classify else regression_metrics(predictions)
    return predictions.sparkSession.createDataFrame([(k, float(v)) for k, v in values.items()], "metric string, value double")


def _importance(model: Model, features: Sequence[str]) -> list[tuple[str, float]]:
    """Tree importances or absolute coefficients of all features, the largest first."""
    if hasattr(model, "featureImportances"):
        weights = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        weights = abs(model.coefficientMatrix.toArray()[0])
    elif hasattr(model, "coefficients"):
        weights = abs(model.coefficients.toArray())
    else:
        return []
    return sorted(zip(features, map(float, weights)), key=lambda t: (-t[1], t[0]))


def _cross_validate(name: str, p: Prepared, data: DataFrame, params: Mapping | None = None, folds: int = FOLDS) -> tuple[float | None, float | None]:
    """Mean and population deviation of the score over folds cut by the hash of the row's id."""
    data = data.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(folds)).cast("int"))
    if name == "KNN":
        scores = []
        for k in range(folds):
            out = _knn_predict(p, data.where(F.col("fold") != k), data.where(F.col("fold") == k), **dict(params or {}))
            m = classification_metrics(out) if p.classify else regression_metrics(out)
            if m:
                scores.append(m["accuracy" if p.classify else "r2"])
        mean = sum(scores) / len(scores)
        return mean, math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    evaluator = (
        MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
        if p.classify
        else RegressionEvaluator(labelCol="label", metricName="r2")
    )
    validator = CrossValidator(
        estimator=estimator(name, p, params),
        estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=evaluator,
        numFolds=folds,
        foldCol="fold",
        parallelism=2,
    )
    done = validator.fit(data)
    return float(done.avgMetrics[0]), float(done.stdMetrics[0])


# ---------------------------------------------------------------- arena


@dataclass(frozen=True)
class Arena:
    leaderboard: DataFrame
    importance: DataFrame
    models: dict
    prepared: Prepared
    best: str | None


def train(name: str, p: Prepared, params: Mapping | None = None) -> tuple[Model | None, DataFrame]:
    """A fitted model and its predictions (key, label, prediction, ...) on the test rows."""
    if name == "KNN":
        return None, _knn_predict(p, p.train, p.test, **dict(params or {}))
    est = estimator(name, p, params)
    if est is None:
        raise ValueError("Not available for this problem")
    model = est.fit(p.train)
    return model, model.transform(p.test)


def run_arena(
    df: DataFrame,
    target: str,
    key: Sequence[str],
    algorithms: Sequence[str],
    test_size: float = 0.2,
    cross_validate: bool = True,
    prepared: Prepared | None = None,
    fold_everything: bool = False,
) -> Arena:
    """Every algorithm on one prepared frame, best first and failures last."""
    p = prepared or prepare(df, target, key, test_size)
    spark = df.sparkSession
    results, models, importances = [], {}, []
    for name in algorithms:
        try:
            model, predictions = train(name, p)
            metrics = classification_metrics(predictions) if p.classify else regression_metrics(predictions)
            if p.classify and len(p.classes) == 2 and name not in ("KNN", "SVM"):
                metrics["roc_auc"] = roc_auc(predictions)
            cv = (None, None)
            if cross_validate:
                cv = _cross_validate(name, p, p.data if fold_everything else p.train)
            models[name] = model
            importances += [(name, f, w, i + 1) for i, (f, w) in enumerate(_importance(model, p.features))]
            results.append((metrics["accuracy" if p.classify else "r2"], name, metrics, cv, None))
        except Exception as problem:  # one model's failure is a row, not the end of the comparison
            results.append((-math.inf, name, {}, (None, None), str(problem).splitlines()[0][:300]))
    results.sort(key=lambda r: -r[0])
    rows = []
    for place, (_, name, metrics, cv, error) in enumerate(results, 1):
        for metric, value in metrics.items() or [(None, None)]:
            rows.append(
                (
                    place, name, metric, None if value is None else float(value), cv[0], cv[1],
                    p.train_rows, p.rows - p.train_rows, error,
                )
            )
    best = next((r[1] for r in results if r[4] is None), None)
    return Arena(
        spark.createDataFrame(rows, LEADERBOARD),
        spark.createDataFrame(importances, IMPORTANCE),
        models,
        p,
        best,
    )


@dataclass(frozen=True)
class Trained:
    name: str
    arena: Arena
    predictions: DataFrame


def run_single(df: DataFrame, target: str, key: Sequence[str], algorithm: str = "Random Forest", test_size: float = 0.2) -> Trained:
    """One algorithm, cross-validated over all rows; an unknown name means a random forest."""
    p = prepare(df, target, key, test_size)
    known = CLASSIFIERS if p.classify else REGRESSORS
    name = algorithm if algorithm in known else "Random Forest"
    arena = run_arena(df, target, key, [name], test_size, prepared=p, fold_everything=True)
    if arena.best is None:
        raise ValueError(arena.leaderboard.first()["error"])
    if name == "KNN":
        predictions = _knn_predict(p, p.train, p.test)
    else:
        predictions = arena.models[name].transform(p.test)
    return Trained(name, arena, predictions.select("key", "label", "prediction"))


# ---------------------------------------------------------------- search

#: Trials of a search that run side by side.
TRIALS_AT_ONCE = 2
# MLlib trees stop at this depth.
DEEPEST = 30


@dataclass(frozen=True)
class Whole:
    """A whole number, both ends included."""

    low: int
    high: int

    def draw(self, rng: random.Random):
        return rng.randint(self.low, self.high)


@dataclass(frozen=True)
class Real:
    """A number between two ends, evenly or (``log``) evenly in its logarithm."""

    low: float
    high: float
    log: bool = False

    def draw(self, rng: random.Random):
        return math.exp(rng.uniform(math.log(self.low), math.log(self.high))) if self.log else rng.uniform(self.low, self.high)


@dataclass(frozen=True)
class OneOf:
    values: tuple

    def draw(self, rng: random.Random):
        return rng.choice(self.values)


def tree_ranges() -> dict:
    """Settings of MLlib's trees; the ends are those a user of the usual libraries knows."""
    return {"maxDepth": Whole(3, DEEPEST), "minInstancesPerNode": Whole(1, 10)}


def boosting_ranges() -> dict:
    return {"maxIter": Whole(50, 500), "maxDepth": Whole(3, 15), "stepSize": Real(0.01, 0.3, log=True), "subsamplingRate": Real(0.6, 1.0)}


def penalty_range(weakest: float) -> Real:
    return Real(weakest, 10.0 if weakest < 0.01 else 100.0, log=True)


def search_space(name: str, p: Prepared) -> dict:
    """The settings that a trial draws, under the names the trained model takes; every one of them is used."""
    n = max(1, p.train_rows)
    inverse = Real(0.01 / n, 100.0 / n, log=True)  # MLlib's penalty is a mean over rows, so it shrinks with them
    spaces = {
        "Random Forest": lambda: {"numTrees": Whole(50, 500), "featureSubsetStrategy": OneOf(("sqrt", "log2", "all")), **tree_ranges()},
        "Decision Tree": lambda: tree_ranges() | ({"impurity": OneOf(("gini", "entropy"))} if p.classify else {}),
        "Gradient Boosting": boosting_ranges,
        "SVM": lambda: {"regParam": inverse},
        "Logistic Regression": lambda: {"regParam": inverse, "maxIter": Whole(100, 2000)},
        "KNN": lambda: {"k": Whole(3, 30), "weights": OneOf(("uniform", "distance")), "metric": OneOf(("euclidean", "manhattan"))},
        "Ridge": lambda: {"alpha": penalty_range(0.01)},
        "Lasso": lambda: {"alpha": penalty_range(0.001)},
        "ElasticNet": lambda: {"alpha": penalty_range(0.001), "l1_ratio": Real(0.1, 0.9)},
    }
    spaces |= {boosted: lambda: boosting_ranges() | {"featureSubsetStrategy": OneOf(tuple(f"{i / 10:.1f}" for i in range(6, 10)) + ("all",))} for boosted in BOOSTED if boosted not in spaces}
    if name not in spaces:
        raise ValueError(f"no settings to search for {name}")
    return spaces[name]()


@dataclass(frozen=True)
class Search:
    trials: DataFrame
    best_params: dict
    best_score: float
    model: Model | None


def search(p: Prepared, algorithm: str, trials: int = 50, folds: int = FOLDS, seed: int = SEED, limits: Mapping | None = None) -> Search:
    """Seeded random search by cross-validation on the training rows, then a refit of the best.

    ``limits`` replaces ranges of the space, for instance to bound the number of trees.
    """
    space = {**search_space(algorithm, p), **(limits or {})}
    rng = random.Random(seed)
    drawn = [{setting: span.draw(rng) for setting, span in space.items()} for _ in range(trials)]
    # trials are jobs of their own; a few run side by side
    with ThreadPool(TRIALS_AT_ONCE) as pool:
        scores = pool.map(inheritable_thread_target(p.data.sparkSession)(lambda params: _cross_validate(algorithm, p, p.train, params, folds)[0]), drawn)
    rows, best = [], None
    for t, (params, score) in enumerate(zip(drawn, scores)):
        if best is None or score > best[0]:
            best = (score, params)
        rows.append((t, json.dumps(params, sort_keys=True), float(score), float(best[0])))
    model = None if algorithm == "KNN" else estimator(algorithm, p, best[1]).fit(p.train)
    return Search(p.data.sparkSession.createDataFrame(rows, TRIALS), best[1], best[0], model)
