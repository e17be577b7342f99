"""Is a table ready for modelling, and which features would help."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.columns import (
    count_if,
    datetime_columns,
    is_numeric,
    lenient_timestamp,
    nan_to_null,
    numeric_columns,
    quoted,
    require,
    sample_skewness,
    share,
    text_columns,
)
from sightline.operators.cleaning import date_features
from sightline.operators.encoding import frequency_encode, one_hot
from sightline.plans.longform import aggregate_rows, distinct_counts, duplicate_rows, value_counts

ISSUES = "level string, topic string, columns string, amount double, penalty int"
CLASS_LIMIT = 20
MANY = 50


def leakage(df: DataFrame, target: str, threshold: float = 0.95) -> DataFrame:
    """(column, correlation) for numeric columns that almost repeat the target; null counts as 0."""
    require(df, target)
    df = nan_to_null(df)
    others = [c for c in numeric_columns(df) if c != target]
    if not others or not is_numeric(df.schema[target].dataType):
        return df.sparkSession.createDataFrame([], "column string, correlation double")
    zero = F.lit(0.0)
    t = F.coalesce(quoted(target).cast("double"), zero)
    rows = [
        [F.lit(c).alias("column"), F.abs(F.corr(F.coalesce(quoted(c).cast("double"), zero), t)).alias("correlation")]
        for c in others
    ]
    return aggregate_rows(df, rows).where((F.col("correlation") > threshold) & ~F.isnan("correlation"))


def scaling_hints(df: DataFrame) -> DataFrame:
    """(column, std, range) for numeric columns spread widely enough to call for scaling."""
    df = nan_to_null(df)
    cols = numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, std double, range double")
    rows = [
        [
            F.lit(c).alias("column"),
            F.stddev_samp(quoted(c).cast("double")).alias("std"),
            (F.max(quoted(c)) - F.min(quoted(c))).cast("double").alias("range"),
        ]
        for c in cols
    ]
    return aggregate_rows(df, rows).where((F.col("std") > 100) | ((F.col("range") > 1000) & F.col("std").isNotNull()))


def _target_facts(df: DataFrame, target: str) -> DataFrame:
    """rows with a target, its distinct values and the share of the most common one."""
    counts = value_counts(df, [target])
    return counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("present"),
        F.count("*").alias("kinds"),
        share(F.max("count"), F.sum("count")).alias("top_share"),
    )


def readiness(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row: score, problem type, target facts and the columns each check names.

    score, problem_type, rows, missing_pct, duplicate_rows, top_share, leakage, high_cardinality, to_encode,
    to_scale, feature_count
    """
    if target is not None:
        require(df, target)
    df = nan_to_null(df)
    texts = text_columns(df)
    cells = F.lit(0).cast("bigint")
    for c in df.columns:
        cells = cells + count_if(quoted(c).isNull())
    row = df.agg(F.count("*").alias("rows"), share(cells, F.count("*") * len(df.columns), 100).alias("missing_pct"))
    row = row.crossJoin(F.broadcast(duplicate_rows(df)))

    def names(frame: DataFrame, out: str) -> DataFrame:
        return frame.agg(F.array_join(F.array_sort(F.collect_list("column")), ",").alias(out))

    row = row.crossJoin(F.broadcast(names(scaling_hints(df), "to_scale")))
    if texts:
        many = distinct_counts(df, texts).where(F.col("distinct_count") > MANY)
        row = row.crossJoin(F.broadcast(names(many, "high_cardinality")))
    else:
        row = row.withColumn("high_cardinality", F.lit(""))
    if target is None:
        row = row.withColumns({"top_share": F.lit(None).cast("double"), "leakage": F.lit(""), "problem_type": F.lit("unknown")})
    else:
        row = row.crossJoin(F.broadcast(_target_facts(df, target))).crossJoin(F.broadcast(names(leakage(df, target), "leakage")))
        few = (share(F.col("kinds"), F.col("present")) < 0.05) & (F.col("kinds") <= CLASS_LIMIT)
        number = F.lit(is_numeric(df.schema[target].dataType))
        row = row.withColumn("problem_type", F.when(number & ~few, "regression").otherwise("classification"))
    n, pct = F.col("rows"), F.col("missing_pct")
    classes = F.col("problem_type") == "classification"
    penalty = (
        F.when(n >= 1000, 0).when(n >= 200, 10).otherwise(25)
        + F.when(pct == 0, 0).when(pct < 5, 5).when(pct < 20, 15).otherwise(25)
        + F.when(F.col("duplicate_rows") > 0, 5).otherwise(0)
        + F.when(classes & (F.col("top_share") > 0.85), 20).when(classes & (F.col("top_share") > 0.70), 10).otherwise(0)
        + F.when(F.col("leakage") != "", 15).otherwise(0)
        + F.when(F.col("high_cardinality") != "", 5).otherwise(0)
    )
    encode = ",".join(sorted(c for c in texts if c != target))
    return row.select(
        F.greatest(F.lit(0), F.least(F.lit(100), 100 - penalty)).alias("score"),
        "problem_type",
        "rows",
        "missing_pct",
        "duplicate_rows",
        F.when(classes, F.col("top_share")).alias("top_share"),
        "leakage",
        "high_cardinality",
        F.lit(encode).alias("to_encode"),
        "to_scale",
        F.lit(len([c for c in df.columns if c != target])).alias("feature_count"),
    )


def readiness_issues(df: DataFrame, target: str | None = None) -> DataFrame:
    """(level, topic, columns, amount): check, warning or error per topic."""
    r = readiness(df, target)
    n, pct, top = F.col("rows"), F.col("missing_pct"), F.col("top_share")

    def entry(level: Column | str, topic: str, columns: Column | None, amount: Column | None) -> Column:
        none = F.lit(None)
        return F.struct(
            (F.lit(level) if isinstance(level, str) else level).alias("level"),
            F.lit(topic).alias("topic"),
            (none.cast("string") if columns is None else columns).alias("columns"),
            (none.cast("double") if amount is None else amount.cast("double")).alias("amount"),
        )

    encoded = F.size(F.filter(F.split("to_encode", ","), lambda s: s != "")).cast("double")
    entries = [
        entry(F.when(n >= 1000, "check").when(n >= 200, "warning").otherwise("error"), "sample_size", None, n),
        entry(F.when(pct == 0, "check").when(pct < 20, "warning").otherwise("error"), "missing_values", None, pct),
        entry(F.when(F.col("duplicate_rows") > 0, "warning").otherwise("check"), "duplicate_rows", None, F.col("duplicate_rows")),
        F.when(
            F.col("problem_type") == "classification",
            entry(F.when(top > 0.85, "error").when(top > 0.70, "warning").otherwise("check"), "class_balance", None, top),
        ),
        F.when(F.col("problem_type") == "unknown", entry("warning", "no_target", None, None)),
        F.when(F.col("leakage") != "", entry("error", "leakage", F.col("leakage"), None)),
        F.when(F.col("high_cardinality") != "", entry("warning", "high_cardinality", F.col("high_cardinality"), None)),
        F.when(F.col("to_encode") != "", entry("warning", "encoding", F.col("to_encode"), encoded)),
        F.when(F.col("to_scale") != "", entry("warning", "scaling", F.col("to_scale"), None)),
    ]
    return r.select(F.inline(F.array_compact(F.array(*entries))))


def feasibility(df: DataFrame, target: str) -> DataFrame:
    """feasibility, score, problem_type, data_sufficiency, recommended models and the expected range."""
    r = readiness(df, target)
    n, top = F.col("rows"), F.col("top_share")
    classes = F.col("problem_type") == "classification"

    def percent(c: Column) -> Column:
        return F.format_string("%.0f%%", F.bround(c * 100, 0))

    return r.select(
        F.when(F.col("score") >= 75, "High").when(F.col("score") >= 50, "Medium").otherwise("Low").alias("feasibility"),
        "score",
        "problem_type",
        F.when(n >= 10000, "Excellent").when(n >= 1000, "Good").when(n >= 200, "Adequate").otherwise("Insufficient").alias("data_sufficiency"),
        F.when(classes, "Logistic Regression,Random Forest,XGBoost").otherwise("Linear Regression,Random Forest,XGBoost").alias("recommended_models"),
        F.when(classes, percent(top)).alias("baseline_accuracy"),
        F.when(
            classes,
            F.concat(percent(F.greatest(top + 0.05, F.lit(0.6))), F.lit(" to "), percent(F.least(top + 0.15, F.lit(0.95)))),
        )
        .otherwise("0.60 to 0.85")
        .alias("expected_range"),
    )


# ---------------------------------------------------------------- features


def suggest_features(df: DataFrame) -> DataFrame:
    """(kind, column, impact, detail): date parts, date parsing, encodings, a product and logarithms."""
    df = nan_to_null(df)
    numbers, texts, dates = numeric_columns(df), text_columns(df), datetime_columns(df)
    rows = [("DateTime Decomposition", c, "High", "year, month, day, dayofweek, quarter, is_weekend") for c in dates]
    if len(numbers) >= 2:
        rows.append(("Interaction Feature", f"{numbers[0]} x {numbers[1]}", "Medium", f"{numbers[0]} * {numbers[1]}"))
    out = df.sparkSession.createDataFrame(rows, "kind string, column string, impact string, detail string")
    if texts:
        parsed = aggregate_rows(
            df,
            [
                [
                    F.lit(c).alias("column"),
                    share(count_if(lenient_timestamp(quoted(c)).isNotNull()), F.count("*")).alias("ok"),
                ]
                for c in texts
            ],
        ).where(F.col("ok") > 0.7)
        out = out.unionByName(
            parsed.select(
                F.lit("DateTime Parsing").alias("kind"), "column", F.lit("High").alias("impact"), F.lit("parse and take date parts").alias("detail")
            )
        )
        kinds = distinct_counts(df, texts)
        encoded = F.when(F.col("distinct_count") > MANY, "Frequency Encoding").when(F.col("distinct_count") > 2, "One-Hot Encoding")
        out = out.unionByName(
            kinds.select(
                encoded.alias("kind"),
                "column",
                F.lit("Medium").alias("impact"),
                F.format_string("%d unique values", "distinct_count").alias("detail"),
            ).where(F.col("kind").isNotNull())
        )
    if numbers:
        skewed = aggregate_rows(
            df,
            [
                [
                    F.lit(c).alias("column"),
                    F.min(quoted(c)).cast("double").alias("low"),
                    sample_skewness(quoted(c).cast("double")).alias("skew"),
                ]
                for c in numbers
            ],
        ).where((F.col("low") > 0) & (F.abs("skew") > 1.5))
        out = out.unionByName(
            skewed.select(
                F.lit("Log Transform").alias("kind"), "column", F.lit("High").alias("impact"), F.format_string("skew=%.2f", "skew").alias("detail")
            )
        )
    return out


def apply_features(df: DataFrame, suggestions: DataFrame) -> DataFrame:
    """The table with every suggested feature added or, for encodings and dates, put in place."""
    found = [(r["kind"], r["column"]) for r in suggestions.select("kind", "column").collect()]  # a few per column
    by = {kind: sorted({c for k, c in found if k == kind}) for kind, _ in found}
    out = df
    for c in by.get("Log Transform", []):
        out = out.withColumn(f"log_{c}", F.log1p(quoted(c)))
    for pair in by.get("Interaction Feature", []):
        a, b = pair.split(" x ")
        out = out.withColumn(f"{a}_x_{b}", quoted(a) * quoted(b))
    parsed = by.get("DateTime Parsing", [])
    dates = [*by.get("DateTime Decomposition", []), *parsed]
    if dates:
        out = date_features(out, dates)
    frequent = [c for c in by.get("Frequency Encoding", []) if c not in parsed]
    if frequent:
        names = {c: f"{c}_freq" for c in frequent}
        out = frequency_encode(out.withColumns({n: quoted(c) for c, n in names.items()}), list(names.values()))
    hot = [c for c in by.get("One-Hot Encoding", []) if c not in parsed]
    return one_hot(out, hot, MANY) if hot else out


def high_cardinality(df: DataFrame, limit: int = MANY, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, distinct_count) of text columns with more than ``limit`` values."""
    cols = list(columns) if columns is not None else text_columns(df)
    return distinct_counts(nan_to_null(df), cols).where(F.col("distinct_count") > limit)
