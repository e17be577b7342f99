"""Column profiles: what a table holds, column by column."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.columns import (
    boolean_columns,
    count_if,
    datetime_columns,
    is_boolean,
    is_datetime,
    is_integer,
    is_numeric,
    is_text,
    lenient_timestamp,
    nan_to_null,
    numeric_columns,
    quoted,
    require,
    sample_kurtosis,
    sample_skewness,
    scalar_columns,
    share,
    skew_label,
    text_columns,
)
from sightline.plans.longform import (
    aggregate_rows,
    column_names,
    distinct_counts,
    duplicate_rows,
    first_values,
    most_common,
    value_counts,
)
from sightline.plans.ranks import counted_values, quantiles, selected_quantiles, value_moments, value_ranks

CATEGORY_LIMIT = 20
CATEGORY_RATIO = 0.05


# ---------------------------------------------------------------- rows of a table


def preview(df: DataFrame, order_by: Sequence[str], rows: int = 10, end: str = "head") -> DataFrame:
    """The first or last rows in a stated order."""
    require(df, *order_by)
    if end == "head":
        return df.orderBy(*[quoted(c).asc() for c in order_by]).limit(rows)
    last = df.orderBy(*[quoted(c).desc() for c in order_by]).limit(rows)
    return last.orderBy(*[quoted(c).asc() for c in order_by])


def sample_rows(df: DataFrame, keys: Sequence[str], rows: int, seed: int = 42) -> DataFrame:
    """A repeatable sample: the rows whose seeded key hash is smallest."""
    require(df, *keys)
    mark = F.xxhash64(*[quoted(k) for k in keys], F.lit(seed))
    return df.withColumn("_mark", mark).orderBy("_mark", *[quoted(k) for k in keys]).limit(rows).drop("_mark")


def filter_columns(
    column_table: DataFrame, categories: Sequence[str] | None = None, only_missing: bool = False
) -> DataFrame:
    """Rows of a column table with the chosen categories and, if asked, with nulls."""
    kept = column_table
    if categories is not None:
        kept = kept.where(F.col("category").isin(list(categories)))
    return kept.where(F.col("missing") > 0) if only_missing else kept


# ---------------------------------------------------------------- table level


def _width(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    fixed = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    if is_text(dtype):
        return F.coalesce(F.octet_length(quoted(name)), F.lit(0))
    return F.lit(fixed.get(dtype.simpleString(), 8))


def _missing_cells(df: DataFrame) -> Column:
    total = F.lit(0).cast("bigint")
    for c in df.columns:
        total = total + count_if(quoted(c).isNull())
    return total


def table_info(df: DataFrame) -> DataFrame:
    """rows, columns, bytes, duplicate_rows, missing_cells"""
    df = nan_to_null(df)
    size = F.lit(0).cast("bigint")
    for c in df.columns:
        size = size + _width(df, c)
    base = df.agg(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"),
        _missing_cells(df).alias("missing_cells"),
    )
    return base.crossJoin(F.broadcast(duplicate_rows(df))).select(
        "rows", "columns", "bytes", "duplicate_rows", "missing_cells"
    )


def repeated_rows(df: DataFrame) -> DataFrame:
    """Each row that occurs more than once, with how many times it repeats an earlier one."""
    df = nan_to_null(df)
    counted = df.groupBy(*[quoted(c) for c in df.columns]).agg((F.count("*") - 1).alias("repeats"))
    return counted.where(F.col("repeats") > 0)


def quality_score(df: DataFrame) -> DataFrame:
    """completeness, uniqueness and their mean, in percent."""
    info = table_info(df)
    cells = F.col("rows") * F.col("columns")
    complete = share(cells - F.col("missing_cells"), cells, 100)
    unique = share(F.col("rows") - F.col("duplicate_rows"), F.col("rows"), 100)
    return info.select(
        F.bround(complete, 2).alias("completeness"),
        F.bround(unique, 2).alias("uniqueness"),
        F.bround((complete + unique) / 2, 2).alias("overall_score"),
        cells.alias("total_cells"),
        "missing_cells",
        "duplicate_rows",
    )


# ---------------------------------------------------------------- column level


def column_info(df: DataFrame, approximate: bool = False) -> DataFrame:
    """column, data_type, category, missing, missing_pct, distinct_count"""
    df = nan_to_null(df)
    cols = scalar_columns(df)
    base = aggregate_rows(
        df,
        [
            [
                F.lit(c).alias("column"),
                F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
                F.lit(_fixed_category(df, c)).alias("fixed"),
                count_if(quoted(c).isNull()).alias("missing"),
                F.count("*").alias("rows"),
            ]
            for c in cols
        ],
    )
    joined = base.join(F.broadcast(distinct_counts(df, cols, approximate)), "column")
    category = F.coalesce(
        F.col("fixed"), F.when(F.col("distinct_count") <= CATEGORY_LIMIT, "Categorical").otherwise("Text")
    )
    return joined.select(
        "column",
        "data_type",
        category.alias("category"),
        "missing",
        share(F.col("missing"), F.col("rows"), 100).alias("missing_pct"),
        "distinct_count",
    )


def _fixed_category(df: DataFrame, name: str) -> str | None:
    dtype = df.schema[name].dataType
    if is_numeric(dtype):
        return "Numeric"
    if is_datetime(dtype):
        return "DateTime"
    if is_boolean(dtype):
        return "Boolean"
    return None


def describe_numeric(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """count, mean, std, min, q1, median, q3, max, range, iqr, skewness, kurtosis, mode per numeric column.

    Runs at once unless ``accuracy`` asks for the quantile sketch; a column without values has count 0 and nulls.
    """
    df = nan_to_null(df)
    cols = numeric_columns(df)
    # everything comes from one table of counted values; the rows themselves are read once
    values = value_ranks(df, cols) if accuracy is None else counted_values(df, cols)
    probs = [0.25, 0.5, 0.75]
    picked = selected_quantiles(values, probs) if accuracy is None else quantiles(df, cols, probs, accuracy=accuracy)
    q = [F.col("q")[i] for i in range(3)]
    found = value_moments(values).join(F.broadcast(picked), "column")
    return (
        column_names(df, cols)
        .join(F.broadcast(found), "column", "left")
        .select(
            "column",
            F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
            "mean",
            "std",
            "min",
            q[0].alias("q1"),
            q[1].alias("median"),
            q[2].alias("q3"),
            "max",
            (F.col("max") - F.col("min")).alias("range"),
            (q[2] - q[0]).alias("iqr"),
            "skewness",
            "kurtosis",
            "mode",
        )
    )


def describe_text(df: DataFrame) -> DataFrame:
    """count, unique, top and freq of every non-numeric column."""
    df = nan_to_null(df)
    cols = [c for c in scalar_columns(df) if c not in numeric_columns(df)]
    counts = value_counts(df, cols)
    top = most_common()
    return counts.groupBy("column").agg(
        F.sum("count").alias("count"),
        F.count("*").alias("unique"),
        top.alias("top"),
        F.max("count").alias("freq"),
    )


def describe_all(df: DataFrame) -> DataFrame:
    """The statistics table that is exported: numbers to four places, text by count and mode."""
    numbers = describe_numeric(df).select(
        "column",
        F.col("count"),
        *[F.bround(c, 4).alias(c) for c in ("mean", "std", "min", "q1", "median", "q3", "max")],
    )
    return describe_text(df).unionByName(numbers, allowMissingColumns=True)


def categorical_stats(df: DataFrame, max_categories: int = CATEGORY_LIMIT) -> DataFrame:
    """(column, value, count, percentage) for every column with few distinct values."""
    df = nan_to_null(df)
    cols = scalar_columns(df)
    counts = value_counts(df, cols)
    few = counts.groupBy("column").agg(F.count("*").alias("kinds")).where(F.col("kinds") <= max_categories)
    rows = df.agg(F.count("*").alias("rows"))
    return (
        counts.join(F.broadcast(few), "column", "left_semi")
        .crossJoin(F.broadcast(rows))
        .select("column", "value", "count", F.bround(share(F.col("count"), F.col("rows"), 100), 2).alias("percentage"))
    )


def missing_analysis(df: DataFrame) -> DataFrame:
    """missing and present counts and percentages per column, most missing first."""
    df = nan_to_null(df)
    base = aggregate_rows(
        df,
        [
            [F.lit(c).alias("column"), count_if(quoted(c).isNull()).alias("missing"), F.count("*").alias("rows")]
            for c in df.columns
        ],
    )
    missing = F.bround(share(F.col("missing"), F.col("rows"), 100), 2)
    return base.select(
        "column",
        F.col("missing").alias("missing_count"),
        missing.alias("missing_pct"),
        (F.col("rows") - F.col("missing")).alias("present_count"),
        F.bround(F.lit(100.0) - missing, 2).alias("present_pct"),
    ).orderBy(F.desc("missing_pct"), "column")


def semantic_types(df: DataFrame, sample: int | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """(column, semantic_type): datetime, datetime_parseable, integer, float, boolean, categorical or text.

    Text counts as a parseable time when every value parses; ``sample`` limits the
    test to the first rows in a stated order.
    """
    df = nan_to_null(df)
    cols = scalar_columns(df)
    texts = [c for c in cols if is_text(df.schema[c].dataType)]
    fixed = {c: _fixed_semantic(df, c) for c in cols}
    names = column_names(df, cols).select(
        "column", F.create_map(*[F.lit(x) for c in cols for x in (c, fixed[c] or "")])[F.col("column")].alias("fixed")
    )
    if not texts:
        return names.select("column", F.col("fixed").alias("semantic_type"))
    tested = df.select(*texts)
    if sample is not None:
        require(df, *order_by)
        tested = preview(df, order_by, sample).select(*texts)
    parsed = aggregate_rows(
        tested,
        [
            [
                F.lit(c).alias("column"),
                F.count(quoted(c)).alias("present"),
                count_if(lenient_timestamp(quoted(c)).isNotNull()).alias("parsed"),
            ]
            for c in texts
        ],
    )
    kinds = distinct_counts(df, texts)
    rows = df.agg(F.count("*").alias("rows"))
    few = (share(F.col("distinct_count"), F.col("rows")) < CATEGORY_RATIO) | (
        F.col("distinct_count") <= CATEGORY_LIMIT
    )
    guess = (
        F.when((F.col("present") > 0) & (F.col("parsed") == F.col("present")), "datetime_parseable")
        .when(few, "categorical")
        .otherwise("text")
    )
    found = parsed.join(F.broadcast(kinds), "column").crossJoin(F.broadcast(rows)).select("column", guess.alias("guess"))
    return names.join(F.broadcast(found), "column", "left").select(
        "column", F.coalesce("guess", "fixed").alias("semantic_type")
    )


def _fixed_semantic(df: DataFrame, name: str) -> str | None:
    dtype = df.schema[name].dataType
    if is_datetime(dtype):
        return "datetime"
    if is_integer(dtype):
        return "integer"
    if is_numeric(dtype):
        return "float"
    if is_boolean(dtype):
        return "boolean"
    return None


def type_groups(df: DataFrame) -> DataFrame:
    """(kind, columns): columns gathered under numeric, categorical, datetime, text or boolean."""
    t = F.col("semantic_type")
    kind = (
        F.when(t.isin("integer", "float"), "numeric")
        .when(t.isin("datetime", "datetime_parseable"), "datetime")
        .otherwise(t)
    )
    return (
        semantic_types(df)
        .groupBy(kind.alias("kind"))
        .agg(F.array_join(F.array_sort(F.collect_list("column")), ",").alias("columns"))
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """One row describing a numeric column's shape, with outlier counts and advice."""
    require(df, column)
    from sightline.operators.hypothesis import normality

    base = nan_to_null(df.select(quoted(column).cast("double").alias("x"))).where(F.col("x").isNotNull())
    x = F.col("x")
    stats = base.agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.stddev_pop(x).alias("_sd"),
        sample_skewness(x).alias("skewness"),
        sample_kurtosis(x).alias("kurtosis"),
    )
    q = quantiles(base, ["x"], [0.05, 0.25, 0.5, 0.75, 0.95]).select("q")
    row = stats.crossJoin(F.broadcast(q))
    fence = (F.col("q")[3] - F.col("q")[1]) * 1.5
    outside = (x < F.col("q")[1] - fence) | (x > F.col("q")[3] + fence)
    far = F.abs(x - F.col("mean")) > F.col("_sd") * 3
    counts = base.crossJoin(F.broadcast(row)).agg(
        count_if(outside).alias("iqr_outliers"), count_if(far).alias("zscore_outliers")
    )
    normal = normality(base, "x").select("test", "p_value", "passed")
    skew = F.col("skewness")
    advice = (
        F.when(F.abs(skew) < 0.5, "No transformation needed")
        .when(skew > 0.5, "Apply log or square-root transformation")
        .otherwise("Apply square or exponential transformation")
    )
    return (
        row.crossJoin(F.broadcast(counts))
        .crossJoin(F.broadcast(normal))
        .where(F.col("n") >= 3)
        .select(
            F.lit(column).alias("column"),
            "n",
            "mean",
            F.col("q")[2].alias("median"),
            "std",
            "skewness",
            skew_label(skew).alias("skewness_label"),
            "kurtosis",
            F.col("test").alias("normality_test"),
            F.col("p_value").alias("normality_p"),
            F.col("passed").alias("normal"),
            "iqr_outliers",
            "zscore_outliers",
            F.col("q")[0].alias("p5"),
            F.col("q")[1].alias("p25"),
            F.col("q")[3].alias("p75"),
            F.col("q")[4].alias("p95"),
            advice.alias("transform_advice"),
        )
    )


def quick_insight(df: DataFrame, column: str) -> DataFrame:
    """(column, finding, text): one sentence about a column."""
    require(df, column)
    df = nan_to_null(df.select(quoted(column).alias("x")))
    if is_numeric(df.schema["x"].dataType):
        base = df.select(F.col("x").cast("double").alias("x")).where(F.col("x").isNotNull())
        x = F.col("x")
        stats = base.agg(sample_skewness(x).alias("skew"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
        q = quantiles(base, ["x"], [0.01, 0.99]).select("q")
        tails = base.crossJoin(F.broadcast(q)).agg(
            share(count_if((x > F.col("q")[1]) | (x < F.col("q")[0])), F.count("*"), 100).alias("outside")
        )
        finding = (
            F.when(F.abs("skew") > 1.5, "skewed").when(F.col("outside") > 5, "outliers").otherwise("well distributed")
        )
        text = (
            F.when(
                F.abs("skew") > 1.5,
                F.format_string(
                    "Heavily %s-skewed (skew=%.2f): consider a log transform",
                    F.when(F.col("skew") > 0, "right").otherwise("left"),
                    "skew",
                ),
            )
            .when(F.col("outside") > 5, F.format_string("%.1f%% potential outliers", "outside"))
            .otherwise(F.format_string("Well distributed (mean=%.2f, std=%.2f)", "mean", "std"))
        )
        return stats.crossJoin(F.broadcast(tails)).select(
            F.lit(column).alias("column"), finding.alias("finding"), text.alias("text")
        )
    counts = value_counts(df, ["x"])
    top = most_common()
    row = counts.agg(
        F.count("*").alias("kinds"), top.alias("top"), share(F.max("count"), F.sum("count"), 100).alias("pct")
    )
    text = F.when(
        F.col("pct") > 70, F.format_string("Dominated by '%s' (%.0f%%): highly imbalanced", "top", "pct")
    ).otherwise(F.format_string("%d categories, top='%s' (%.0f%%)", "kinds", "top", "pct"))
    return row.select(
        F.lit(column).alias("column"),
        F.when(F.col("pct") > 70, "dominated").otherwise("categories").alias("finding"),
        text.alias("text"),
    )


@dataclass(frozen=True)
class Role:
    """A column's likely role: for which kind, up to how many distinct values, with which words in its name."""

    kind: str
    text: str
    most: int | None = None
    words: tuple[str, ...] = ()


# fixed values: the limits and words that decide a column's role; the first that fits counts
ROLES = (
    Role("datetime", "point in time"),
    Role("numeric", "flag with two values", most=2),
    Role("numeric", "code or rank, {kinds} values", most=10),
    Role("numeric", "row identifier", words=("id", "key")),
    Role("numeric", "age", words=("age",)),
    Role("numeric", "money", words=("price", "cost", "amount")),
    Role("numeric", "score", words=("score", "grade", "rating")),
    Role("numeric", "share or rate", words=("pct", "percent", "rate")),
    Role("numeric", "measure from {low} to {high}"),
    Role("text", "flag with two values", most=2),
    Role("text", "category, {kinds} values", most=20),
    Role("text", "name", words=("name",)),
    Role("text", "e-mail address", words=("email",)),
    Role("text", "place", words=("address", "city", "country")),
    Role("text", "time kept as text", words=("date", "time")),
    Role("text", "free text, {kinds} values"),
)


def role_text(name: str, dtype) -> Column:
    """The text of the first role that fits a column; counts and ends are those of its row."""
    kind = "datetime" if is_datetime(dtype) else "numeric" if is_numeric(dtype) else "text" if is_text(dtype) else ""
    spoken = name.lower().replace("_", " ").replace("-", " ")
    filled = {"kinds": F.col("distinct_count").cast("string"), "low": F.format_string("%.2f", "low"), "high": F.format_string("%.2f", "high")}
    out = F.lit("")
    for role in reversed([r for r in ROLES if r.kind == kind and (not r.words or any(w in spoken for w in r.words))]):
        pieces = [filled[x[1:-1]] if x.startswith("{") else F.lit(x) for x in re.split(r"({\w+})", role.text) if x]
        out = F.when(F.lit(True) if role.most is None else F.col("distinct_count") <= role.most, F.concat(*pieces)).otherwise(out)
    return out


def data_dictionary(df: DataFrame, order_by: Sequence[str], samples: int = 3) -> DataFrame:
    """column, data_type, non_null, distinct_count, missing_pct, samples, description"""
    require(df, *order_by)
    df = nan_to_null(df)
    cols = scalar_columns(df)
    numeric = set(numeric_columns(df))
    nothing = F.lit(None).cast("double")
    rows = []
    for c in cols:
        value = quoted(c)
        rows.append(
            [
                F.lit(c).alias("column"),
                F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
                F.count(value).alias("non_null"),
                share(count_if(value.isNull()), F.count("*"), 100).alias("missing_pct"),
                (F.min(value).cast("double") if c in numeric else nothing).alias("low"),
                (F.max(value).cast("double") if c in numeric else nothing).alias("high"),
            ]
        )
    base = aggregate_rows(df, rows).join(F.broadcast(distinct_counts(df, cols)), "column")
    shown = first_values(df, cols, order_by, samples).select("column", F.array_join("samples", ", ").alias("samples"))
    rule = F.lit("")
    for c in cols:
        rule = F.when(F.col("column") == c, role_text(c, df.schema[c].dataType)).otherwise(rule)
    return base.join(F.broadcast(shown), "column", "left").select(
        "column", "data_type", "non_null", "distinct_count", "missing_pct", "samples", rule.alias("description")
    )


def numeric_summary(df: DataFrame) -> DataFrame:
    """column, mean, std, min, median, max, skewness: the dictionary's numeric half."""
    return describe_numeric(df).select(
        "column", *[F.bround(c, 4).alias(c) for c in ("mean", "std", "min", "median", "max", "skewness")]
    )


def dataset_context(df: DataFrame, order_by: Sequence[str], max_rows: int = 5) -> DataFrame:
    """One JSON text: shape, kinds, null counts, numeric statistics, sample rows and duplicates."""
    df = nan_to_null(df)
    numeric = numeric_columns(df)
    shape = F.struct(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("cols"))
    nulls = F.struct(*[count_if(quoted(c).isNull()).alias(c) for c in df.columns])
    stats = [
        F.struct(
            F.bround(F.avg(quoted(c)).cast("double"), 3).alias("mean"),
            F.bround(F.stddev_samp(quoted(c)), 3).alias("std"),
            F.bround(F.min(quoted(c)).cast("double"), 3).alias("min"),
            F.bround(F.max(quoted(c)).cast("double"), 3).alias("max"),
            count_if(quoted(c).isNull()).alias("nulls"),
        ).alias(c)
        for c in numeric
    ]
    parts = [shape.alias("shape"), nulls.alias("null_counts")]
    if stats:
        parts.append(F.struct(*stats).alias("numeric_stats"))
    facts = df.agg(*parts)
    head = preview(df, order_by, max_rows)
    key = F.struct(*[quoted(c) for c in order_by])
    ordered = F.array_sort(F.collect_list(F.struct(key.alias("k"), F.struct(*[quoted(c) for c in df.columns]).alias("r"))))
    sample = head.agg(F.transform(ordered, lambda s: s["r"]).alias("sample"))

    def names(cols: Sequence[str]) -> Column:
        return F.array(*[F.lit(c) for c in cols]).cast("array<string>")

    return (
        facts.crossJoin(F.broadcast(sample))
        .crossJoin(F.broadcast(duplicate_rows(df)))
        .select(
            F.to_json(
                F.struct(
                    *[p for p in facts.columns],
                    names(df.columns).alias("columns"),
                    names(numeric).alias("numeric_columns"),
                    names(text_columns(df)).alias("categorical_columns"),
                    names(datetime_columns(df)).alias("datetime_columns"),
                    names(boolean_columns(df)).alias("boolean_columns"),
                    F.col("sample"),
                    F.col("duplicate_rows").alias("duplicates"),
                )
            ).alias("context")
        )
    )


# The words that decide which kind of answer a question gets.
QUESTION_WORDS = {
    "quality": ("reliable", "trust", "quality", "good"),
    "trend": ("trend", "pattern", "insight", "tell"),
    "features": ("column", "feature", "important", "matter"),
    "modelling": ("ml", "model", "predict", "machine"),
}


def question_class(question: str) -> str:
    low = question.lower()
    for name, words in QUESTION_WORDS.items():
        if any(w in low for w in words):
            return name
    return "summary"


def rule_based_facts(df: DataFrame, question: str, order_by: Sequence[str]) -> DataFrame:
    """(question_class, fact, value): the facts a question of that kind is answered with."""
    kind = question_class(question)
    df = nan_to_null(df)
    numeric = numeric_columns(df)

    def fact(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("fact"), value.cast("string").alias("value"))

    if kind == "trend" and numeric:
        c = quoted(numeric[0])
        spot = F.struct(*[quoted(k) for k in order_by])
        first, last = F.min_by(c, F.when(c.isNotNull(), spot)), F.max_by(c, F.when(c.isNotNull(), spot))
        row = df.agg(first.alias("first"), last.alias("last"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))
        facts = [
            fact("column", F.lit(numeric[0])),
            fact("trend", F.when(F.col("last") > F.col("first"), "increasing").otherwise("decreasing")),
            fact("first", F.format_string("%.2f", F.col("first").cast("double"))),
            fact("last", F.format_string("%.2f", F.col("last").cast("double"))),
            fact("mean", F.format_string("%.3f", F.col("mean").cast("double"))),
            fact("std", F.format_string("%.3f", "std")),
        ]
    else:
        row = table_info(df)
        null_pct = share(F.col("missing_cells"), F.col("rows") * F.col("columns"), 100)
        facts = [
            fact("rows", F.col("rows")),
            fact("columns", F.col("columns")),
            fact("numeric_columns", F.lit(len(numeric))),
            fact("null_pct", F.format_string("%.1f", null_pct)),
        ]
        if kind == "quality":
            facts.append(fact("duplicate_rows", F.col("duplicate_rows")))
            facts.append(fact("missing_risk", F.when(null_pct > 10, "high").otherwise("acceptable")))
        if kind == "features":
            facts.append(fact("categorical_columns", F.lit(len(text_columns(df)))))
        if kind == "modelling":
            facts.append(fact("sufficient", F.col("rows") > 200))
    return row.select(F.inline(F.array(*facts))).select(F.lit(kind).alias("question_class"), "fact", "value")


def chart_facts(df: DataFrame, column: str) -> DataFrame:
    """column, shape, skewness, mean, std, beyond_3_std, log_advised: numbers for a caption."""
    require(df, column)
    base = nan_to_null(df.select(quoted(column).cast("double").alias("x"))).where(F.col("x").isNotNull())
    x = F.col("x")
    row = base.agg(sample_skewness(x).alias("skewness"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    far = base.crossJoin(F.broadcast(row)).agg(
        count_if(F.abs(x - F.col("mean")) > F.col("std") * 3).alias("beyond_3_std")
    )
    skew = F.col("skewness")
    shape = F.when(skew > 0.5, "right-skewed").when(skew < -0.5, "left-skewed").otherwise("approximately normal")
    return row.crossJoin(F.broadcast(far)).select(
        F.lit(column).alias("column"),
        shape.alias("shape"),
        "skewness",
        "mean",
        "std",
        "beyond_3_std",
        (F.abs(skew) > 1).alias("log_advised"),
    )


def full_profile(df: DataFrame) -> dict[str, DataFrame]:
    """Every profile table of one frame, each lazy, by name."""
    from sightline.operators.correlation import correlation
    from sightline.operators.outliers import iqr_outliers

    return {
        "basic_info": table_info(df),
        "column_info": column_info(df),
        "descriptive_stats": describe_numeric(df),
        "missing_analysis": missing_analysis(df),
        "correlation": correlation(df),
        "data_types": semantic_types(df),
        "column_types": type_groups(df),
        "quality_score": quality_score(df),
        "outliers": iqr_outliers(df),
    }

