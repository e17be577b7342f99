"""Schema questions and the column expressions every operator shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_INTEGER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TEXT = (T.StringType, T.CharType, T.VarcharType)
_DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)

# What counts as a number written as text.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# The shape of each date or time layout and how it is read.
TIME_LAYOUTS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,6}$", "yyyy-MM-dd HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NUMERIC)


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, _INTEGER)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, _TEXT)


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, _DATETIME)


def is_boolean(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.BooleanType)


def is_scalar(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))


def _pick(df: DataFrame, test) -> list[str]:
    return [f.name for f in df.schema.fields if test(f.dataType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return _pick(df, is_numeric)


def integer_columns(df: DataFrame) -> list[str]:
    return _pick(df, is_integer)


def text_columns(df: DataFrame) -> list[str]:
    return _pick(df, is_text)


def datetime_columns(df: DataFrame) -> list[str]:
    return _pick(df, is_datetime)


def boolean_columns(df: DataFrame) -> list[str]:
    return _pick(df, is_boolean)


def scalar_columns(df: DataFrame) -> list[str]:
    return _pick(df, is_scalar)


def select_kind(df: DataFrame, kind: str) -> DataFrame:
    """The columns of one kind: numeric, text, datetime or boolean."""
    pickers = {
        "numeric": numeric_columns,
        "text": text_columns,
        "datetime": datetime_columns,
        "boolean": boolean_columns,
    }
    if kind not in pickers:
        raise ValueError(f"unknown kind {kind!r}")
    return df.select(*pickers[kind](df))


def require(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and null mean the same thing to every operator here."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(quoted(c)), quoted(c)) for c in floats})


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def count_if(cond: Column) -> Column:
    """Rows for which the condition holds; 0, not null, on no rows."""
    return F.count(F.when(cond, F.lit(1)))


def share(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """part / whole * scale, and 0 when there is nothing to divide by."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * F.lit(float(scale))).otherwise(F.lit(0.0))


def numeric_text(c: Column) -> Column:
    """Text read as a number, null when it is not one."""
    return F.when(c.rlike(NUMERIC_TEXT), F.trim(c).try_cast("double"))


def lenient_timestamp(c: Column) -> Column:
    """Text read as a time by the layout whose shape it has, null when it has none.

    The shape is tested first: a failed parse is far dearer than a failed match.
    """
    text = F.trim(c)
    out = F.lit(None).cast("timestamp")
    for shape, layout in reversed(TIME_LAYOUTS):
        out = F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(layout))).otherwise(out)
    return F.when(text.rlike(r"\d{4}"), out)


def as_timestamp(df: DataFrame, name: str) -> Column:
    """A column as a time, parsing text leniently."""
    if is_text(df.schema[name].dataType):
        return lenient_timestamp(quoted(name))
    return quoted(name).cast("timestamp_ntz")


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness; null below three values, 0 for a constant."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return F.when(
        F.count(c) > 2,
        F.when(F.var_pop(c) > 0, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))).otherwise(F.lit(0.0)),
    )


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values, 0 for a constant."""
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(
        F.count(c) > 3,
        F.when(F.var_pop(c) > 0, scale * ((n + 1) * g2 + 6)).otherwise(F.lit(0.0)),
    )


def skew_label(skew: Column) -> Column:
    return (
        F.when(F.abs(skew) < 0.5, "approximately symmetric")
        .when(skew > 0.5, "right-skewed (positive)")
        .otherwise("left-skewed (negative)")
    )
