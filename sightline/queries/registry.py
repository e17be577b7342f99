"""Query registration, table access and the derived views both engines read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.columns import quoted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PLACES = 6

# Derived views; the text is the same for both engines.
VIEWS = {
    "fx_nulls": """
        SELECT l_orderkey, l_linenumber, l_shipdate,
               CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
               CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
               CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
               1 AS constant_col
        FROM {lineitem}""",
    "fx_dups": """
        SELECT c_custkey, c_mktsegment, c_acctbal FROM {customer}
        UNION ALL
        SELECT c_custkey, c_mktsegment, c_acctbal FROM {customer} WHERE c_custkey % 10 = 0""",
    "fx_types": """
        SELECT o_orderkey AS order_id,
               concat('$', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)) AS price_text,
               CAST(o_custkey AS STRING) AS cust_text,
               CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'No' END AS bool_text,
               CAST(CAST(o_orderdate AS DATE) AS STRING) AS date_text,
               concat(CAST(o_orderkey % 100 AS STRING), '%') AS pct_text,
               CAST(o_orderkey % 2 AS INT) AS flag01,
               CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS STRING) ELSE o_orderpriority END AS mixed_text
        FROM {orders}""",
    "fx_pii": """
        SELECT c_custkey,
               concat('user', CAST(c_custkey AS STRING), '@example.com') AS contact,
               concat('10.0.', CAST(c_custkey % 256 AS STRING), '.1') AS host,
               CASE WHEN c_custkey % 4 = 0 THEN '123-45-6789' ELSE 'none' END AS note
        FROM {customer}""",
    "fx_daily": """
        SELECT CAST(ts AS DATE) AS d, sum(value) AS v, count(*) AS n FROM {events} GROUP BY CAST(ts AS DATE)""",
    "fx_order_days": """
        SELECT CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS v, count(*) AS n
        FROM {orders} GROUP BY CAST(o_orderdate AS DATE)""",
    "fx_gaps": """
        SELECT CAST(ts AS DATE) AS d, sum(value) AS v, count(*) AS n FROM {events}
        WHERE day(CAST(ts AS DATE)) % 6 <> 0 GROUP BY CAST(ts AS DATE)""",
    "fx_reg": """
        SELECT l_quantity AS x1, l_discount AS x2,
               3.0 + 2.0 * l_quantity - 5.0 * l_discount + (l_partkey % 17 - 8) * 0.1 AS y
        FROM {lineitem}""",
    "fx_text_labels": """
        SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
        FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared table, as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a lazy frame."""
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def with_views(sql: str) -> str:
    """The oracle text with the views it names put in front as common table expressions."""
    needed = [v for v in VIEWS if v in sql]
    if not needed:
        return sql
    parts = [f"{v} AS ({VIEWS[v].format(**{t: t for t in TABLES})})" for v in needed]
    head = "WITH RECURSIVE " if sql.lstrip().lower().startswith("with recursive") else "WITH "
    body = sql.lstrip()
    if body.lower().startswith("with recursive"):
        body = ", " + body[len("with recursive"):]
    elif body.lower().startswith("with "):
        body = ", " + body[len("with "):]
    return head + ", ".join(parts) + " " + body


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Doubles cut to a fixed number of places, so that summation order does not show."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[(F.round(quoted(c), places) + F.lit(0.0)).alias(c) if c in doubles else quoted(c) for c in df.columns]
    )


def query(name: str, sql: str | None = None, places: int = PLACES):
    """Register a function of (spark, sf_dir) under a name, with its SQL check."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir), places)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
