"""Readers and writers exercised on the shared tables, and near-duplicate rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import profile
from sightline.plans.storage import scratch_path
from sightline.queries.registry import query, table
from sightline.sources import html_tables, readers, writers


@query("src_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    writers.write_csv(table(spark, sf, "customer"), path)
    return readers.load_table(spark, path, "csv")


@query("src_whitespace", "SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, c_mktsegment FROM customer")
def _(spark, sf):
    path = scratch_path(spark, "text")
    table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").write.option("header", True).option("sep", " ").csv(path)
    return readers.read_text_table(spark, path)


@query("src_json", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    path = scratch_path(spark, "json")
    writers.write_json(table(spark, sf, "customer"), path)
    return readers.load_table(spark, path, "jsonl")


@query("src_parquet", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def _(spark, sf):
    path = scratch_path(spark, "parquet")
    writers.write_parquet(table(spark, sf, "orders"), path)
    return readers.load_table(spark, path, "parquet")


@query(
    "src_statistics",
    """SELECT 'c_acctbal' AS "column", count(*) AS "count", NULL AS "unique", NULL AS top, NULL AS freq, round_even(avg(c_acctbal), 4) AS mean,
    round_even(stddev_samp(c_acctbal), 4) AS std, round_even(min(c_acctbal), 4) AS "min", round_even(quantile_cont(c_acctbal, .25), 4) AS q1,
    round_even(quantile_cont(c_acctbal, .5), 4) AS median, round_even(quantile_cont(c_acctbal, .75), 4) AS q3, round_even(max(c_acctbal), 4) AS "max" FROM customer
    UNION ALL SELECT 'c_mktsegment', count(*), count(DISTINCT c_mktsegment),
    (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), (SELECT count(*) FROM customer GROUP BY c_mktsegment ORDER BY 1 DESC LIMIT 1),
    NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM customer""",
)
def _(spark, sf):
    return profile.describe_all(table(spark, sf, "customer").select("c_acctbal", "c_mktsegment"))


@query("src_status", "SELECT count(*) AS \"rows\", 5 AS \"columns\", format('Successfully loaded {} rows x 5 columns from customer', count(*)) AS message FROM customer")
def _(spark, sf):
    return readers.load_status(table(spark, sf, "customer"), "customer")


def _pages(spark, sf):
    """A page per customer: a small table, then a larger one."""
    c = table(spark, sf, "customer")
    small = F.format_string("<table><tr><td>%d</td></tr></table>", "c_nationkey")
    large = F.format_string(
        "<TABLE><tr><th>name</th><th>segment</th></tr><tr><td>%s</td><td><b>%s</b></td></tr></TABLE>", "c_name", "c_mktsegment"
    )
    return c.select("c_custkey", F.concat(F.lit("<html><p>x</p>"), small, large, F.lit("</html>")).alias("html"))


@query(
    "src_html_cells",
    """SELECT c_custkey AS page_id, 0 AS table_no, 0 AS row_no, false AS header, CAST(c_nationkey AS VARCHAR) AS cells FROM customer
    UNION ALL SELECT c_custkey, 1, 0, true, 'name|segment' FROM customer
    UNION ALL SELECT c_custkey, 1, 1, false, c_name || '|' || c_mktsegment FROM customer""",
)
def _(spark, sf):
    cells = html_tables.html_cells(_pages(spark, sf), "c_custkey", "html")
    return cells.withColumn("cells", F.array_join("cells", "|"))


@query(
    "src_html_largest",
    """SELECT c_custkey AS page_id, 'name|segment' AS cells FROM customer UNION ALL SELECT c_custkey, c_name || '|' || c_mktsegment FROM customer""",
)
def _(spark, sf):
    rows = html_tables.largest_tables(html_tables.html_cells(_pages(spark, sf), "c_custkey", "html"))
    return rows.select("page_id", F.array_join("cells", "|").alias("cells"))


@query("src_html_pages", "SELECT page_id, 0 AS table_no FROM pages WHERE contains(lower(html), '<table')")
def _(spark, sf):
    return html_tables.html_cells(table(spark, sf, "pages"), "page_id", "html").select("page_id", "table_no").distinct()


@query(
    "src_stack",
    """SELECT n_name AS name, n_regionkey, NULL AS r_regionkey FROM nation UNION ALL SELECT r_name, NULL, r_regionkey FROM region""",
)
def _(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_name").alias("name"), "n_regionkey")
    region = table(spark, sf, "region").select(F.col("r_name").alias("name"), "r_regionkey")
    return readers.stack_tables([nation, region])


# ---------------------------------------------------------------- near-duplicate rows

from sightline.operators import fuzzy  # noqa: E402

COPIES = """WITH f AS (SELECT text, min(doc_id) AS leader, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)
    """


@query("fuzzy_exact", COPIES + "SELECT leader, doc_id AS member, 1.0::DOUBLE AS similarity FROM documents JOIN f USING (text)")
def _(spark, sf):
    return fuzzy.find_fuzzy_duplicates(table(spark, sf, "documents"), "doc_id", ["text"], 1.0)


@query("fuzzy_summary", COPIES + "SELECT count(*) AS n_groups, sum(n - 1)::BIGINT AS total_fuzzy_duplicates FROM f")
def _(spark, sf):
    return fuzzy.fuzzy_summary(fuzzy.find_fuzzy_duplicates(table(spark, sf, "documents"), "doc_id", ["text"], 1.0))


@query("fuzzy_documents")
def _(spark, sf):
    return fuzzy.find_fuzzy_duplicates(table(spark, sf, "documents"), "doc_id", ["text"], 0.85)


# every pair of distinct texts by the length table of common subsequences, row by row, then the leaders in order
LEADERS = """WITH RECURSIVE e AS (SELECT text, min(key) AS key, row_number() OVER (ORDER BY min(key)) AS i, string_split(text, '') AS c FROM t GROUP BY text),
    dp AS (
        SELECT a.i AS ai, b.i AS bi, a.c AS ac, b.c AS bc, 0 AS k, list_transform(range(len(b.c) + 1), lambda x: 0::BIGINT) AS l
        FROM e a JOIN e b ON b.i < a.i AND 2.0 * least(len(a.c), len(b.c)) >= 0.85 * (len(a.c) + len(b.c))
        UNION ALL
        SELECT ai, bi, ac, bc, k + 1, list_transform(range(1, len(l) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda x: CASE WHEN x > 1 AND bc[x - 1] = ac[k + 1] THEN l[x - 1] + 1 ELSE l[x] END)))
        FROM dp WHERE k < len(ac)),
    m AS (SELECT ai, bi, 2.0 * l[len(l)] / (len(ac) + len(bc)) AS s FROM dp WHERE k = len(ac) AND 2.0 * l[len(l)] / (len(ac) + len(bc)) >= 0.85),
    adj AS (SELECT i, coalesce((SELECT list(bi) FROM m WHERE ai = i), []) AS near FROM e),
    lead(n, leaders) AS (
        SELECT 0::BIGINT, []::BIGINT[]
        UNION ALL SELECT n + 1, CASE WHEN list_has_any(leaders, near) THEN leaders ELSE list_append(leaders, i) END FROM lead JOIN adj ON i = n + 1),
    last AS (SELECT leaders FROM lead ORDER BY n DESC LIMIT 1),
    own AS (SELECT i, CASE WHEN list_contains(leaders, i) THEN i ELSE list_min(list_intersect(leaders, near)) END AS li FROM adj, last),
    g AS (SELECT h.key AS leader, t.key AS member, coalesce(m.s, 1.0)::DOUBLE AS similarity, t.text
          FROM t JOIN e USING (text) JOIN own USING (i) JOIN e h ON h.i = own.li LEFT JOIN m ON m.ai = own.i AND m.bi = own.li)
    """


@query(
    "fuzzy_names",
    LEADERS.replace("WITH RECURSIVE ", "WITH RECURSIVE t AS (SELECT p_partkey AS key, p_name AS text FROM part), ") + """SELECT leader, member, round(similarity, 6) AS similarity FROM g
    WHERE leader IN (SELECT leader FROM g GROUP BY leader HAVING count(*) > 1)""",
)
def _(spark, sf):
    return fuzzy.find_fuzzy_duplicates(table(spark, sf, "part"), "p_partkey", ["p_name"], 0.85)


@query(
    "fuzzy_parts",
    LEADERS.replace("WITH RECURSIVE ", "WITH RECURSIVE t AS (SELECT p_partkey AS key, p_name || ' | ' || p_type AS text FROM part), ") + """SELECT leader, count(*) AS size, (list(text ORDER BY member))[1:3] AS samples FROM g
    GROUP BY leader HAVING count(*) > 1""",
)
def _(spark, sf):
    parts = table(spark, sf, "part")
    groups = fuzzy.find_fuzzy_duplicates(parts, "p_partkey", ["p_name", "p_type"], 0.85)
    return fuzzy.group_table(parts, groups, "p_partkey", ["p_name", "p_type"])


@query("fuzzy_merge", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    groups = fuzzy.find_fuzzy_duplicates(docs, "doc_id", ["text"], 1.0)
    return fuzzy.merge_fuzzy_duplicates(docs, groups, "doc_id").select("doc_id")


@query("fuzzy_merge_last", "SELECT max(doc_id) AS doc_id FROM documents GROUP BY text")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    groups = fuzzy.find_fuzzy_duplicates(docs, "doc_id", ["text"], 1.0)
    return fuzzy.merge_fuzzy_duplicates(docs, groups, "doc_id", "keep_last").select("doc_id")


@query("fuzzy_remove_all", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text HAVING count(*) = 1")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    groups = fuzzy.find_fuzzy_duplicates(docs, "doc_id", ["text"], 1.0)
    return fuzzy.merge_fuzzy_duplicates(docs, groups, "doc_id", "remove_all").select("doc_id")
