"""Time series: detection, rolling windows, trend, resampling, calendar statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.columns import (
    as_timestamp,
    count_if,
    datetime_columns,
    lenient_timestamp,
    nan_to_null,
    quoted,
    require,
    text_columns,
)
from sightline.plans.longform import aggregate_rows, column_names
from sightline.plans.ordered import key_positions, over_neighbours
from sightline.plans.ranks import quantiles, row_positions

WINDOWS = (7, 14, 30)


def datetime_candidates(df: DataFrame, sample: int | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """(column, kind): date columns, and text columns whose every non-null value reads as a time."""
    fixed = datetime_columns(df)
    texts = text_columns(df)
    out = column_names(df, fixed).select("column", F.lit("datetime").alias("kind")) if fixed else None
    if texts:
        tested = df.orderBy(*[quoted(c) for c in order_by]).limit(sample) if sample is not None else df
        found = aggregate_rows(
            tested,
            [
                [
                    F.lit(c).alias("column"),
                    F.count(quoted(c)).alias("n"),
                    count_if(lenient_timestamp(quoted(c)).isNotNull()).alias("ok"),
                ]
                for c in texts
            ],
        ).where((F.col("n") > 0) & (F.col("n") == F.col("ok"))).select("column", F.lit("parseable").alias("kind"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return df.sparkSession.createDataFrame([], "column string, kind string")
    return out


def prepare(df: DataFrame, ts: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., ts, value): the time read leniently, rows without one left out."""
    require(df, ts, value, *keys)
    base = df.select(*[quoted(k) for k in keys], as_timestamp(df, ts).alias("ts"), quoted(value).cast("double").alias("value"))
    return nan_to_null(base).where(F.col("ts").isNotNull())


def series_info(df: DataFrame, ts: str) -> DataFrame:
    """is_time_series, reason, frequency, is_regular, gaps, median_seconds, span_seconds, n"""
    require(df, ts)
    base = df.select(as_timestamp(df, ts).alias("ts")).where(F.col("ts").isNotNull())
    stepped = over_neighbours(
        base,
        ["ts"],
        lambda w: {"_before": F.lag("ts").over(w)},
        back=1,
    )
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_before").cast("timestamp"))) / 1e6
    months = (F.year("ts") * 12 + F.month("ts")) - (F.year("_before") * 12 + F.month("_before"))
    midnight = F.date_trunc("DAY", "ts") == F.col("ts")
    steps = stepped.withColumns({"step": seconds, "months": months, "midnight": midnight}).select(
        "ts", "step", "months", "midnight"
    )
    middle = quantiles(steps, ["step"], [0.5]).select(F.col("q")[0].alias("median"))
    facts = steps.crossJoin(F.broadcast(middle)).agg(
        F.count("*").alias("n"),
        F.count("step").alias("steps"),
        count_if(F.col("step") > 0).alias("rising"),
        count_if(F.col("step") == F.col("median")).alias("usual"),
        count_if((F.col("median") > 0) & (F.col("step") > F.col("median") * 2)).alias("gaps"),
        F.max("median").alias("median"),
        F.min("step").alias("least"),
        F.max("step").alias("most"),
        F.min("months").alias("least_months"),
        F.max("months").alias("most_months"),
        F.min(F.col("midnight") & (F.dayofmonth("ts") == 1)).alias("month_starts"),
        F.min(F.col("midnight") & (F.last_day("ts") == F.to_date("ts"))).alias("month_ends"),
        F.max(F.upper(F.date_format("ts", "EEE"))).alias("weekday"),
        F.max(F.month("ts")).alias("last_month"),
        (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("_span"),
    )
    enough, rising = F.col("n") >= 3, F.col("rising") / F.col("steps") > 0.8
    ok = enough & rising
    return facts.select(
        ok.alias("is_time_series"),
        F.when(~enough, "Insufficient data points").when(~rising, "Not monotonic").alias("reason"),
        F.when(ok, _frequency()).alias("frequency"),
        F.when(ok, F.col("usual") / F.col("steps") > 0.9).alias("is_regular"),
        F.when(ok, F.col("gaps")).alias("gaps"),
        F.when(ok, F.col("median")).alias("median_seconds"),
        F.when(ok, F.col("_span") / 1e6).alias("span_seconds"),
        "n",
    )


def _frequency() -> Column:
    """The one step all rows share, by its usual short name; null when steps differ."""
    step = F.col("least")
    even = (step == F.col("most")) & (step > 0)
    month = F.col("least_months")
    even_months = (month == F.col("most_months")) & (month > 0)

    def times(unit: float, name: str) -> Column:
        n = (step / unit).cast("bigint").cast("string")
        return F.when(step == unit, name).otherwise(F.concat(n, F.lit(name)))

    def monthly(start: str) -> Column:
        n = month.cast("string")
        return (
            F.when(month == 12, "Y" + start)
            .when(month == 3, "Q" + start)
            .when(month == 1, "M" + start)
            .otherwise(F.concat(n, F.lit("M" + start)))
        )

    return (
        F.when(even & (step == 7 * 86400), F.concat(F.lit("W-"), "weekday"))
        .when(even & (step % 86400 == 0) & ~(even_months & (F.col("month_starts") | F.col("month_ends"))), times(86400, "D"))
        .when(even_months & F.col("month_starts"), monthly("S"))
        .when(even_months & F.col("month_ends"), monthly("E"))
        .when(even & (step % 86400 == 0), times(86400, "D"))
        .when(even & (step % 3600 == 0), times(3600, "h"))
        .when(even & (step % 60 == 0), times(60, "min"))
        .when(even & (step % 1 == 0), times(1, "s"))
    )


def rolling(
    df: DataFrame,
    ts: str,
    value: str,
    windows: Sequence[int] = WINDOWS,
    keys: Sequence[str] = (),
    tie_breakers: Sequence[str] = (),
    chunk: int | None = None,
) -> DataFrame:
    """Rolling mean and sample deviation over rows; null until the window is full of values."""
    base = prepare(df, ts, value, [*keys, *[t for t in tie_breakers if t not in keys]])

    def columns(w):
        out = {}
        for size in windows:
            frame = w.rowsBetween(-(size - 1), 0)
            full = F.count("value").over(frame) == size
            out[f"rolling_mean_{size}"] = F.when(full, F.avg("value").over(frame))
            out[f"rolling_std_{size}"] = F.when(full, F.stddev_samp("value").over(frame))
        return out

    done = over_neighbours(base, ["ts", *tie_breakers], columns, back=max(windows) - 1, keys=keys, chunk=chunk)
    return done.drop("_pos")


def rolling_band(df: DataFrame, ts: str, value: str, window: int = 7, keys: Sequence[str] = (), tie_breakers: Sequence[str] = ()) -> DataFrame:
    """The series with its rolling mean and one deviation to either side."""
    mean, sd = F.col(f"rolling_mean_{window}"), F.col(f"rolling_std_{window}")
    r = rolling(df, ts, value, [window], keys, tie_breakers)
    return r.select(
        *[c for c in r.columns if not c.startswith("rolling_")],
        mean.alias("rolling_mean"),
        (mean - sd).alias("lower_band"),
        (mean + sd).alias("upper_band"),
    )


def positions(df: DataFrame, ts: str, value: str, keys: Sequence[str] = (), tie_breakers: Sequence[str] = ()) -> DataFrame:
    """(keys..., ts, value, x): the position of each row inside its series."""
    base = prepare(df, ts, value, [*keys, *[t for t in tie_breakers if t not in keys]])
    numbered, _ = row_positions(base, [*keys, "ts", *tie_breakers])
    return key_positions(numbered, keys, "x").drop("_pos")


def trend(df: DataFrame, ts: str, value: str, keys: Sequence[str] = (), tie_breakers: Sequence[str] = ()) -> DataFrame:
    """(keys..., trend, slope, intercept, n): a least-squares line against row position."""
    pos = positions(df, ts, value, keys, tie_breakers).where(F.col("value").isNotNull())
    names = [quoted(k) for k in keys]
    fit = pos.groupBy(*names).agg(
        F.regr_slope("value", "x").alias("slope"),
        F.regr_intercept("value", "x").alias("intercept"),
        F.stddev_pop("value").alias("_sd"),
        F.count("*").alias("n"),
    )
    label = (
        F.when(F.col("n") < 2, "insufficient_data")
        .when(F.col("slope") > 0.01 * F.col("_sd"), "upward")
        .when(F.col("slope") < -0.01 * F.col("_sd"), "downward")
        .otherwise("flat")
    )
    return fit.select(*names, label.alias("trend"), "slope", "intercept", "n")


def trend_line(df: DataFrame, ts: str, value: str, tie_breakers: Sequence[str] = ()) -> DataFrame:
    """(ts, value, x, fitted)"""
    pos = positions(df, ts, value, (), tie_breakers).where(F.col("value").isNotNull())
    fit = pos.agg(F.regr_slope("value", "x").alias("_b"), F.regr_intercept("value", "x").alias("_a"))
    return pos.crossJoin(F.broadcast(fit)).select("ts", "value", "x", (F.col("_a") + F.col("_b") * F.col("x")).alias("fitted"))


# ---------------------------------------------------------------- resampling

FREQUENCIES = ("H", "D", "W", "M", "Q", "Y")
AGGREGATES = ("mean", "sum", "min", "max", "first", "last", "count")


def bin_label(ts: Column, freq: str) -> Column:
    """The label of a time's bin: its start for hours and days, its last day for longer bins."""
    day = F.date_trunc("DAY", ts).cast("timestamp_ntz")
    if freq == "H":
        return F.date_trunc("HOUR", ts).cast("timestamp_ntz")
    if freq == "D":
        return day
    if freq == "W":
        return F.date_add(F.to_date(day), 6 - F.weekday(day)).cast("timestamp_ntz")
    if freq == "M":
        return F.last_day(day).cast("timestamp_ntz")
    if freq == "Q":
        return F.last_day(F.add_months(F.date_trunc("QUARTER", ts).cast("date"), 2)).cast("timestamp_ntz")
    if freq == "Y":
        return F.last_day(F.add_months(F.date_trunc("YEAR", ts).cast("date"), 11)).cast("timestamp_ntz")
    raise ValueError(f"unknown frequency {freq!r}")


def _bin_sequence(first: Column, last: Column, freq: str) -> Column:
    if freq in ("H", "D", "W"):
        step = {"H": "INTERVAL 1 HOUR", "D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY"}[freq]
        return F.sequence(first, last, F.expr(step))
    months = {"M": 1, "Q": 3, "Y": 12}[freq]
    start, end = F.trunc(first.cast("date"), "MM"), F.trunc(last.cast("date"), "MM")
    firsts = F.sequence(start, end, F.expr(f"INTERVAL {months} MONTH"))
    return F.transform(firsts, lambda d: F.last_day(d).cast("timestamp_ntz"))


def bin_aggregate(agg: str, order: Column) -> Column:
    v = F.col("value")
    seen = F.when(v.isNotNull(), order)
    return {
        "mean": F.avg(v),
        "sum": F.coalesce(F.sum(v), F.lit(0.0)),
        "min": F.min(v),
        "max": F.max(v),
        "first": F.min_by(v, seen),
        "last": F.max_by(v, seen),
        "count": F.count(v),
    }[agg]


def resample(
    df: DataFrame,
    ts: str,
    value: str,
    freq: str = "D",
    agg: str = "mean",
    keys: Sequence[str] = (),
    tie_breakers: Sequence[str] = (),
) -> DataFrame:
    """(keys..., ts, value): one row per bin between the first and last, empty bins included."""
    if freq not in FREQUENCIES or agg not in AGGREGATES:
        raise ValueError(f"unknown frequency or aggregate: {freq!r}, {agg!r}")
    base = prepare(df, ts, value, [*keys, *[t for t in tie_breakers if t not in keys]])
    names = [quoted(k) for k in keys]
    order = F.struct("ts", *[quoted(t) for t in tie_breakers], "value")
    bins = base.groupBy(*names, bin_label(F.col("ts"), freq).alias("bin")).agg(bin_aggregate(agg, order).alias("value"))
    span = bins.groupBy(*names).agg(F.min("bin").alias("_a"), F.max("bin").alias("_b"))
    every = span.select(*names, F.explode(_bin_sequence(F.col("_a"), F.col("_b"), freq)).alias("bin"))
    out = every.join(bins, [*keys, "bin"], "left")
    filled = F.col("value")
    if agg in ("sum", "count"):
        filled = F.coalesce(filled, F.lit(0).cast(bins.schema["value"].dataType))
    return out.select(*names, F.col("bin").alias("ts"), filled.alias("value"))


# ---------------------------------------------------------------- calendar

PERIODS = ("hour", "dayofweek", "day", "month", "quarter", "year")


def period_of(ts: Column, period: str) -> Column:
    return {
        "hour": F.hour(ts).cast("string"),
        "dayofweek": F.date_format(ts, "EEEE"),
        "day": F.dayofmonth(ts).cast("string"),
        "month": F.date_format(ts, "MMMM"),
        "quarter": F.quarter(ts).cast("string"),
        "year": F.year(ts).cast("string"),
    }.get(period, F.month(ts).cast("string"))


def period_stats(df: DataFrame, ts: str, value: str, period: str = "month", keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., period, mean, std, min, max, count) to two places."""
    base = prepare(df, ts, value, keys)
    stats = base.groupBy(*[quoted(k) for k in keys], period_of(F.col("ts"), period).alias("period")).agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("value").alias("count"),
    )
    return stats.withColumns({c: F.bround(c, 2) for c in ("mean", "std", "min", "max")})


def seasonality(df: DataFrame, ts: str, value: str) -> DataFrame:
    """(pattern, spread, mean, detected): whether group means vary by more than a tenth of their mean.

    One scan: values are summed by hour, weekday and month together, at most a few
    thousand groups, and the three views are taken from those.
    """
    base = prepare(df, ts, value)
    cube = base.groupBy(
        F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"), F.month("ts").alias("month")
    ).agg(F.sum("value").alias("s"), F.count("value").alias("c"), F.count("*").alias("rows"))
    total = cube.agg(F.sum("rows").alias("n"))
    parts = [("daily", "hour", 24), ("weekly", "weekday", 7), ("monthly", "month", 30)]
    out = None
    for name, unit, least in parts:
        means = cube.groupBy(unit).agg((F.sum("s") / F.nullif(F.sum("c"), F.lit(0))).alias("m"))
        one = means.agg(F.stddev_samp("m").alias("spread"), F.avg("m").alias("mean")).crossJoin(F.broadcast(total))
        one = one.where(F.col("n") > least).select(
            F.lit(f"{name}_pattern").alias("pattern"),
            "spread",
            "mean",
            F.coalesce(F.col("spread") > F.col("mean") * 0.1, F.lit(False)).alias("detected"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def series_summary(df: DataFrame, ts: str, value: str, tie_breakers: Sequence[str] = ()) -> DataFrame:
    """(section, item, result): detection, value statistics, trend and seasonality as text."""
    def lines(frame: DataFrame, section: str) -> DataFrame:
        entries = [F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("result")) for c in frame.columns]
        return frame.select(F.lit(section).alias("section"), F.inline(F.array(*entries)))

    base = prepare(df, ts, value)
    stats = base.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    seasons = seasonality(df, ts, value).select(
        F.lit("seasonality").alias("section"), F.col("pattern").alias("item"), F.col("detected").cast("string").alias("result")
    )
    return (
        lines(series_info(df, ts), "info")
        .unionByName(lines(stats, "values"))
        .unionByName(lines(trend(df, ts, value, (), tie_breakers), "trend"))
        .unionByName(seasons)
    )
