"""Readers for the file formats a table may arrive in."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.sources.html_tables import read_html

DELIMITERS = (",", ";", "\t", "|")
EXTENSIONS = ("csv", "txt", "tsv", "json", "jsonl", "parquet", "feather", "arrow", "html", "htm")


def _head(spark: SparkSession, path: str, lines: int) -> list[str]:
    return [r["value"] for r in spark.read.text(path).limit(lines).collect()]


def sniff_delimiter(spark: SparkSession, path: str) -> str | None:
    """The first of comma, semicolon, tab and pipe that gives every line the same two or more cells; quoted ones don't count.

    All lines are looked at, in one scan.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    bare = F.regexp_replace("value", '"[^"]*"', "")
    cells = [F.length(bare) - F.length(F.translate(bare, d, "")) for d in DELIMITERS]
    row = lines.agg(*[f(c).alias(f"{name}{i}") for i, c in enumerate(cells) for name, f in (("lo", F.min), ("hi", F.max))]).first()
    return next((d for i, d in enumerate(DELIMITERS) if row[f"hi{i}"] and row[f"lo{i}"] == row[f"hi{i}"]), None)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Delimited text with a header. A given schema saves the pass that infers one."""
    reader = spark.read.option("header", True).option("sep", sniff_delimiter(spark, path) or ",").option("encoding", encoding)
    reader = reader.option("multiLine", False)
    return reader.csv(path, schema=schema) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_text_table(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Text split at tabs, else at runs of whitespace, else at commas: the first giving two or more columns.

    The first line of each file is its header; rows that look like it stay. Cells beyond the header's
    are kept in ``_rest``.
    """
    first = spark.read.text(path).where(F.trim("value") != "").first()
    header = first["value"] if first else ""
    if "\t" in header:
        return spark.read.option("header", True).option("sep", "\t").option("encoding", encoding).option("inferSchema", True).csv(path)
    names = header.split()
    if len(names) > 1:
        lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_id"))
        lines = lines.where(F.trim("value") != "")
        heads = lines.where("file_block_start = 0").groupBy("file_path").agg(F.min("_id").alias("_id"))  # a row for each file
        rows = lines.join(F.broadcast(heads.select("_id")), "_id", "left_anti")
        cells = F.split(F.trim("value"), r"\s+")
        wide = [F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)]
        widest = rows.agg(F.max(F.size(cells))).first()[0] or 0
        if widest > len(names):  # what goes beyond the header is kept in a column of its own
            wide.append(F.nullif(F.array_join(F.slice(cells, len(names) + 1, widest), " "), F.lit("")).alias("_rest"))
        return infer_types(rows.select(*wide))
    return spark.read.option("header", True).option("sep", ",").option("encoding", encoding).option("inferSchema", True).csv(path)


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns whose every value is a whole number or a number become bigint or double, in one scan."""
    whole, number = r"^[+-]?\d{1,18}$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    checks = []
    for i, c in enumerate(df.columns):
        value = F.col(f"`{c}`")
        checks += [F.min(value.rlike(whole)).alias(f"w{i}"), F.min(value.rlike(number)).alias(f"n{i}")]
    row = df.agg(*checks).first()
    casts = {}
    for i, c in enumerate(df.columns):
        if row[f"w{i}"]:
            casts[c] = F.col(f"`{c}`").cast("bigint")
        elif row[f"n{i}"]:
            casts[c] = F.col(f"`{c}`").cast("double")
    return df.withColumns(casts) if casts else df


# ---------------------------------------------------------------- JSON


def _orientation(text: str) -> str:
    """lines, records, values, split, index or columns, from the start of a document."""
    start = text.lstrip()
    if start.startswith("["):
        return "values" if start[1:].lstrip().startswith("[") else "records"
    if re.match(r'^\{\s*"(columns|index|data)"\s*:\s*\[', start):
        return "split"
    # an object whose values are objects: columns of rows, or rows of columns
    if re.match(r'^\{\s*"(?:[^"\\]|\\.)*"\s*:\s*\{', start):
        outer = re.match(r'^\{\s*"((?:[^"\\]|\\.)*)"', start).group(1)
        return "index" if re.fullmatch(r"-?\d+", outer) else "columns"
    return "lines"


def read_json(spark: SparkSession, path: str, orient: str | None = None) -> DataFrame:
    """JSON lines, an array of records or of rows, or a table by split, index or columns.

    Lines and arrays of records are the layouts for large data: Spark splits or
    streams them. The other three hold a whole table in one document, which one
    task has to read; tables that arrive so are meant to be small.
    """
    if orient is None:
        lines = _head(spark, path, 3)
        orient = _orientation("\n".join(lines)) if lines else "lines"
    if orient == "lines":
        return spark.read.json(path)
    if orient == "records":
        return spark.read.option("multiLine", True).json(path)
    documents = spark.read.text(path, wholetext=True)
    if orient == "values":
        rows = documents.select(F.explode(F.from_json("value", "array<array<string>>")).alias("r"))
        return _spread_array(rows)
    if orient == "split":
        parsed = documents.select(F.from_json("value", "columns array<string>, data array<array<string>>").alias("d"))
        names = parsed.select("d.columns").first()[0]
        return _spread_array(parsed.select(F.explode("d.data").alias("r")), names)
    table = documents.select(F.from_json("value", "map<string,map<string,string>>").alias("d"))
    cells = table.select(F.explode("d").alias("outer", "inner")).select("outer", F.explode("inner").alias("k", "v"))
    row, column = ("k", "outer") if orient == "columns" else ("outer", "k")
    names = [r[0] for r in cells.select(column).distinct().orderBy(column).collect()]
    wide = cells.groupBy(F.col(row).alias("_row")).pivot(column, names).agg(F.first("v"))
    return infer_types(wide.drop("_row"))


def _spread_array(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    if names is None:
        width = rows.agg(F.max(F.size("r"))).first()[0] or 0
        names = [str(i) for i in range(width)]
    return infer_types(rows.select(*[F.get("r", F.lit(i)).alias(n) for i, n in enumerate(names)]))


# ---------------------------------------------------------------- columnar files


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_feather(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A folder of Arrow IPC (Feather) files, one file to a task, in record batches.

    The schema is read from the first file unless given.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path)
    if schema is None:
        first = files.orderBy("path").select("content").first()
        if first is None:
            raise ValueError(f"no files under {path}")
        with pa.ipc.open_file(pa.BufferReader(first["content"])) as reader:
            schema = from_arrow_schema(reader.schema)

    def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for content in frame["content"]:
                with pa.ipc.open_file(pa.BufferReader(content)) as reader:
                    for i in range(reader.num_record_batches):
                        yield reader.get_batch(i).to_pandas()

    return files.select("content").repartition(F.col("content").isNotNull(), F.rand(7)).mapInPandas(batches, schema)


# ---------------------------------------------------------------- dispatch


def load_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read by extension, or by ``fmt``; anything else is an error."""
    kind = (fmt or re.sub(r"^.*\.", "", path.rstrip("/"))).lower()
    if kind == "csv":
        return read_csv(spark, path)
    if kind in ("txt", "tsv"):
        return read_text_table(spark, path)
    if kind in ("json", "jsonl"):
        return read_json(spark, path, "lines" if kind == "jsonl" else None)
    if kind == "parquet":
        return read_parquet(spark, path)
    if kind in ("feather", "arrow"):
        return read_feather(spark, path)
    if kind in ("html", "htm"):
        return read_html(spark, path)
    raise ValueError(f"Unsupported file format: .{kind}")


def load_status(df: DataFrame, name: str) -> DataFrame:
    """One row (rows, columns, message)."""
    n = len(df.columns)
    return df.agg(F.count("*").alias("rows")).select(
        "rows",
        F.lit(n).alias("columns"),
        F.format_string(f"Successfully loaded %d rows x {n} columns from %s", "rows", F.lit(name)).alias("message"),
    )


def stack_tables(tables: list[DataFrame]) -> DataFrame:
    """Tables one above the other, columns united by name, gaps null."""
    if not tables:
        raise ValueError("nothing to stack")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
