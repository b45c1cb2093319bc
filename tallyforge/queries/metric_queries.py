"""Queries of the metric layer, comparison and annotation operators, with their SQL twins.

Names begin with the operator's id in lower case; ``sel`` stands for the projection and scalar
operators, whose letter is taken by another family of queries.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as texts
from tallyforge.functions.normalize import word
from tallyforge.operators import annotate, compare
from tallyforge.plans import build, catalog, shop
from tallyforge.plans.accounts import history
from tallyforge.plans.compiler import Compiler, align
from tallyforge.plans.semantic import Scope
from tallyforge.queries.dirty_sql import VERSIONS
from tallyforge.session import cut, place
from tallyforge.sources import files
from tallyforge.sources.tables import table
from tallyforge.streaming.events import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_REGISTRY = shop.shop()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def _doubles(df: DataFrame, keys: list[str]) -> DataFrame:
    return _days(df.select(*keys, *[F.col(c).cast("double").alias(c) for c in df.columns if c not in keys]))


def _days(df: DataFrame) -> DataFrame:
    """Period keys as text."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in df.columns if c.startswith("metric_time__")})


def _days_sql(sql: str, grain: str | None) -> str:
    return f"SELECT * REPLACE (strftime(metric_time__{grain}, '%Y-%m-%d') AS metric_time__{grain}) FROM ({sql})" if grain else sql


def metric(name: str, names: list[str], scope: Scope, sql: str, order: bool = False) -> None:
    """Register a metric query; values come out as doubles, keys as they are."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = _doubles(Compiler(_REGISTRY, spark, d).query(names, scope), scope.keys)
        return out.orderBy(*scope.keys) if order else out

    QUERIES[name], ORACLE[name] = run, _days_sql(sql, scope.grain)


TOTAL, MONTH, DAY, YEAR = Scope(), Scope("month"), Scope("day"), Scope("year")
_O = "(SELECT *, CAST(o_totalprice AS DECIMAL(12, 2)) AS value FROM orders)"
_I = "(SELECT *, CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(12, 2))) AS revenue, CASE WHEN l_shipdate < '1998-01-01' AND l_quantity <= 25 THEN 1 ELSE 0 END AS prompt_flag FROM lineitem)"
_C = f"(SELECT o_custkey, sum(value) AS lifetime_value, min(o_orderdate) AS first_order FROM {_O} GROUP BY 1)"


def _m(col: str, grain: str = "month") -> str:
    return f"CAST(date_trunc('{grain}', {col}) AS DATE) AS metric_time__{grain}"


# --- measures and aggregation
metric("a1_sum", ["order_value"], TOTAL, f"SELECT CAST(sum(value) AS DOUBLE) AS order_value FROM {_O}")
metric("a2_sum_conditional", ["urgent_value", "returned_revenue"], TOTAL, f"SELECT (SELECT CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN value ELSE 0 END) AS DOUBLE) FROM {_O}) AS urgent_value, (SELECT CAST(sum(CASE WHEN l_returnflag = 'R' THEN revenue ELSE 0 END) AS DOUBLE) FROM {_I}) AS returned_revenue")
metric("a3_count_column", ["order_count", "customer_count"], TOTAL, "SELECT CAST(count(o_orderkey) AS DOUBLE) AS order_count, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS customer_count FROM orders")
metric("a4_sum_of_one", ["order_rows"], MONTH, f"SELECT {_m('o_orderdate')}, CAST(sum(1) AS DOUBLE) AS order_rows FROM orders GROUP BY 1")
metric("a5_sum_of_flag", ["prompt_items"], MONTH, f"SELECT {_m('l_shipdate')}, CAST(sum(prompt_flag) AS DOUBLE) AS prompt_items FROM {_I} GROUP BY 1")
metric("a6_ungrouped_total", ["order_value", "order_count", "item_revenue"], TOTAL, f"SELECT CAST(sum(value) AS DOUBLE) AS order_value, CAST(count(o_orderkey) AS DOUBLE) AS order_count, (SELECT CAST(sum(revenue) AS DOUBLE) FROM {_I}) AS item_revenue FROM {_O}")
metric("a7_by_time_grain", ["event_count", "click_count"], DAY, f"SELECT {_m('ts', 'day')}, CAST(count(event_id) AS DOUBLE) AS event_count, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS DOUBLE) AS click_count FROM events GROUP BY 1")
metric("a8_by_entity_path", ["order_value"], Scope("year", ("customer__nation__region__r_name",)), f"SELECT {_m('o_orderdate', 'year')}, r_name AS customer__nation__region__r_name, CAST(sum(value) AS DOUBLE) AS order_value FROM {_O} LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")


@query("a9_preaggregate_one_key", f"SELECT o_custkey, CAST(lifetime_value AS DOUBLE) AS lifetime_value, strftime(first_order, '%Y-%m-%d') AS first_order FROM {_C}")
def _(spark, d):
    return shop.customer_orders(spark, d).select("o_custkey", F.col("lifetime_value").cast("double").alias("lifetime_value"), F.date_format("first_order", "yyyy-MM-dd").alias("first_order"))


@query("a10_preaggregate_two_keys", f"SELECT o_custkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS order_month, CAST(sum(value) AS DOUBLE) AS month_value FROM {_O} GROUP BY 1, 2")
def _(spark, d):
    return shop.customer_months(spark, d).select("o_custkey", F.date_format("order_month", "yyyy-MM-dd").alias("order_month"), F.col("month_value").cast("double").alias("month_value"))


@query("a11_rollup_across_grains", f"SELECT o_custkey, CAST(lifetime_value AS DOUBLE) AS v1, CAST(lifetime_value AS DOUBLE) AS v2, CAST(0 AS DOUBLE) AS delta, 'both' AS presence, false AS differs FROM {_C}")
def _(spark, d):
    return compare.cross_grain(shop.customer_months(spark, d), shop.customer_orders(spark, d), ["o_custkey"], "month_value", "lifetime_value")


@query("a12_count_rows", "SELECT count(*) AS n_orders FROM orders")
def _(spark, d):
    return catalog.inline_sql(spark, d, "select count(*) as n_orders from {{ ref('orders') }}")


_LINES = r"regexp_split_to_array({}, '\r\n|\r|\n')"
_PATCH = r"regexp_replace(text, '(?i)\bsum\s*\(', 'total(', 'g')"
_CHANGED = f"WITH d AS (SELECT doc_id, {_LINES.format('text')} AS a, {_LINES.format(_PATCH)} AS b FROM documents WHERE text IS NOT NULL), z AS (SELECT doc_id, unnest(generate_series(1, len(a))) AS line_no, unnest(a) AS before, unnest(b) AS after FROM d)"


def _patched(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", "text", texts.rewrite(F.col("text"), r"(?i)\bsum\s*\(", "total(").alias("patched"))


@query("a13_count_changed_lines", f"{_CHANGED} SELECT doc_id, count(*) AS n_changed FROM z WHERE before IS DISTINCT FROM after GROUP BY 1")
def _(spark, d):
    return texts.changed_lines(_patched(spark, d), "doc_id", "text", "patched").groupBy(F.col("key").alias("doc_id")).agg(F.count("*").alias("n_changed"))


# --- metric constructors
metric("m1_simple_by_month", ["order_value"], MONTH, f"SELECT {_m('o_orderdate')}, CAST(sum(value) AS DOUBLE) AS order_value FROM {_O} GROUP BY 1 ORDER BY 1", order=True)
metric("m2_ratio_same_model", ["urgent_share", "prompt_rate"], MONTH, f"WITH a AS (SELECT {_m('o_orderdate')}, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN value ELSE 0 END) AS DOUBLE) / nullif(CAST(sum(value) AS DOUBLE), 0) AS urgent_share FROM {_O} GROUP BY 1), b AS (SELECT {_m('l_shipdate')}, CAST(sum(prompt_flag) AS DOUBLE) / nullif(CAST(sum(1) AS DOUBLE), 0) AS prompt_rate FROM {_I} GROUP BY 1) SELECT * FROM a FULL JOIN b USING (metric_time__month)")
metric("m3_ratio_across_models", ["value_per_customer"], MONTH, f"WITH a AS (SELECT {_m('o_orderdate')}, CAST(sum(value) AS DOUBLE) AS v FROM {_O} GROUP BY 1), b AS (SELECT {_m('first_order')}, CAST(count(o_custkey) AS DOUBLE) AS n FROM {_C} GROUP BY 1) SELECT metric_time__month, v / nullif(n, 0) AS value_per_customer FROM a FULL JOIN b USING (metric_time__month)")
metric("m4_derived", ["order_value_annual"], YEAR, f"SELECT {_m('o_orderdate', 'year')}, CAST(sum(value) * 12 AS DOUBLE) AS order_value_annual FROM {_O} GROUP BY 1")
metric("m5_metric_of_metrics", ["returned_to_urgent"], YEAR, f"WITH a AS (SELECT {_m('l_shipdate', 'year')}, CAST(sum(CASE WHEN l_returnflag = 'R' THEN revenue ELSE 0 END) AS DOUBLE) / nullif(CAST(sum(revenue) AS DOUBLE), 0) AS a FROM {_I} GROUP BY 1), b AS (SELECT {_m('o_orderdate', 'year')}, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN value ELSE 0 END) AS DOUBLE) / nullif(CAST(sum(value) AS DOUBLE), 0) AS b FROM {_O} GROUP BY 1) SELECT metric_time__year, a / nullif(b, 0) AS returned_to_urgent FROM a FULL JOIN b USING (metric_time__year)")
_MV = f"m AS (SELECT {_m('o_orderdate')}, sum(value) AS v FROM {_O} GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(min(metric_time__month), max(metric_time__month), INTERVAL 1 MONTH)) AS DATE) AS metric_time__month FROM m)"
metric("m6_cumulative", ["order_value_running", "order_value_last3"], MONTH, f"WITH {_MV} SELECT metric_time__month, CAST(sum(v) OVER (ORDER BY metric_time__month) AS DOUBLE) AS order_value_running, CAST(sum(v) OVER (ORDER BY metric_time__month ROWS 2 PRECEDING) AS DOUBLE) AS order_value_last3 FROM s LEFT JOIN m USING (metric_time__month)")
metric("m7_time_offset", ["order_value", "order_value_before"], MONTH, f"WITH {_MV} SELECT a.metric_time__month, CAST(a.v AS DOUBLE) AS order_value, CAST(b.v AS DOUBLE) AS order_value_before FROM m a LEFT JOIN m b ON b.metric_time__month = a.metric_time__month - INTERVAL 1 MONTH")
metric("m8_filtered", ["open_value"], MONTH, f"SELECT {_m('o_orderdate')}, CAST(sum(value) AS DOUBLE) AS open_value FROM {_O} WHERE o_orderstatus = 'O' GROUP BY 1")
metric("m9_multi_metric", ["order_value", "item_revenue", "open_value"], MONTH, f"WITH a AS (SELECT {_m('o_orderdate')}, CAST(sum(value) AS DOUBLE) AS order_value FROM {_O} GROUP BY 1), b AS (SELECT {_m('l_shipdate')}, CAST(sum(revenue) AS DOUBLE) AS item_revenue FROM {_I} GROUP BY 1), c AS (SELECT {_m('o_orderdate')}, CAST(sum(value) AS DOUBLE) AS open_value FROM {_O} WHERE o_orderstatus = 'O' GROUP BY 1) SELECT * FROM a FULL JOIN b USING (metric_time__month) FULL JOIN c USING (metric_time__month)")


@query("m10_time_spine", f"WITH {_MV} SELECT strftime(metric_time__month, '%Y-%m-%d') AS metric_time__month FROM s")
def _(spark, d):
    c = Compiler(_REGISTRY, spark, d)
    return c.spine(c.query("order_value", MONTH), MONTH).select(F.date_format("metric_time__month", "yyyy-MM-dd").alias("metric_time__month"))


@query("m11_empty_groups", f"WITH m AS (SELECT {_m('first_order')}, sum(lifetime_value) AS v FROM {_C} GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(min(metric_time__month), max(metric_time__month), INTERVAL 1 MONTH)) AS DATE) AS metric_time__month FROM m) SELECT strftime(metric_time__month, '%Y-%m-%d') AS metric_time__month, CAST(v AS DOUBLE) AS lifetime_value FROM s LEFT JOIN m USING (metric_time__month)")
def _(spark, d):
    c = Compiler(_REGISTRY, spark, d)
    return c.spine(c.query("lifetime_value", MONTH), MONTH).select(F.date_format("metric_time__month", "yyyy-MM-dd").alias("metric_time__month"), F.col("lifetime_value").cast("double").alias("lifetime_value"))


metric("w1_cumulative_frame", ["order_value_running"], DAY, f"WITH m AS (SELECT {_m('o_orderdate', 'day')}, sum(value) AS v FROM {_O} GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(min(metric_time__day), max(metric_time__day), INTERVAL 1 DAY)) AS DATE) AS metric_time__day FROM m) SELECT metric_time__day, CAST(sum(v) OVER (ORDER BY metric_time__day) AS DOUBLE) AS order_value_running FROM s LEFT JOIN m USING (metric_time__day)")
metric("w2_prior_period", ["click_count_before"], DAY, f"WITH m AS (SELECT {_m('ts', 'day')}, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS v FROM events GROUP BY 1) SELECT a.metric_time__day, CAST(b.v AS DOUBLE) AS click_count_before FROM m a LEFT JOIN m b ON b.metric_time__day = a.metric_time__day - INTERVAL 7 DAY")
metric("o1_order_by_key", ["event_count"], DAY, f"SELECT {_m('ts', 'day')}, CAST(count(event_id) AS DOUBLE) AS event_count FROM events GROUP BY 1 ORDER BY 1", order=True)


# --- scans, sources, sinks
_CUSTOMERS = "SELECT i AS customer_id, printf('customer_%05d', i) AS name, CASE (i * 7919 + 104729 + 42) % 1000003 % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'light' ELSE 'standard' END AS plan FROM generate_series(1, 400) t(i)"
_INVOICES = "SELECT i AS invoice_id, (i - 1) // 12 + 1 AS customer_id, strftime(DATE '2024-01-01' + INTERVAL 1 MONTH * ((i - 1) % 12), '%Y-%m-%d') AS invoice_month, (i * 7919 + 209458 + 42) % 1000003 % 100000 AS amount, CASE WHEN (i * 7919 + 314187 + 42) % 1000003 % 10 = 0 THEN 'open' ELSE 'paid' END AS status FROM generate_series(1, 4800) t(i)"


@query("s1_generated_source", f"SELECT i.*, c.name, c.plan FROM ({_INVOICES}) i JOIN ({_CUSTOMERS}) c ON i.customer_id = c.customer_id")
def _(spark, d):
    made = files.generated(spark, files.invoices, n_customers=400, seed=42)
    return made["invoices"].join(made["customers"], "customer_id").withColumn("invoice_month", F.date_format("invoice_month", "yyyy-MM-dd"))


@query("s2_registered_view", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _(spark, d):
    files.register(table(spark, d, "nation"), "df_in")
    out = spark.sql("SELECT n_regionkey, count(*) AS n FROM df_in GROUP BY 1")
    files.unregister(spark, "df_in")  # the plan holds the relation, not the name
    return out


@query("s3_unregister", "SELECT false AS still_there")
def _(spark, d):
    files.register(table(spark, d, "nation"), "df_gone")
    files.unregister(spark, "df_gone")
    return spark.range(1).select(F.lit(spark.catalog.tableExists("df_gone")).alias("still_there"))


@query("s4_create_schema", "SELECT true AS there")
def _(spark, d):
    files.create_schema(spark, "raw")
    files.create_schema(spark, "raw")
    return spark.range(1).select(F.lit(spark.catalog.databaseExists("raw")).alias("there"))


@query("s5_create_table_as", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    files.create_schema(spark, "raw")
    return files.create_table_as(table(spark, d, "nation"), "raw", "nation", place(spark, "raw-nation")).select("n_nationkey", "n_name")


@query("s6_session", f"SELECT 'INVOICES' AS name, count(*) AS n_rows, true AS inside, true AS closed, false AS registered FROM ({_INVOICES}) UNION ALL SELECT 'CUSTOMERS', count(*), true, true, false FROM ({_CUSTOMERS})")
def _(spark, d):
    """The loader in one piece: generate, open, register, create, unregister, close; then the tables are read by name."""
    before = spark.catalog.currentDatabase()
    with files.opened(spark, "loader") as db:
        inside = spark.catalog.currentDatabase() == db
        names = files.load(spark, files.generated(spark, files.invoices), "raw", lambda n: place(spark, f"raw-{n}"))
    closed = spark.catalog.currentDatabase() == before
    counts = [spark.table(n).agg(F.lit(n.split("`")[-2]).alias("name"), F.count("*").alias("n_rows")) for n in names]
    return counts[0].unionByName(counts[1]).select("*", F.lit(inside).alias("inside"), F.lit(closed).alias("closed"), F.lit(spark.catalog.tableExists("df_in")).alias("registered"))


@query("s7_csv_seed", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    path = place(spark, "seed")
    src = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    src.write.option("header", True).csv(path)
    return files.csv(spark, path, src.schema)


@query("s8_csv_data", "SELECT account_id, strftime(revenue_month, '%Y-%m-%d') AS revenue_month, line_no, revenue_amount, is_finalized FROM revenue_monthly")
def _(spark, d):
    path = place(spark, "data")
    src = table(spark, d, "revenue_monthly").select("account_id", "revenue_month", "line_no", "revenue_amount", "is_finalized")
    src.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    read = files.csv(spark, path, src.schema)
    return read.withColumn("revenue_month", F.date_format("revenue_month", "yyyy-MM-dd"))


def _models(spark, d, changed: bool = False) -> str:
    """The model SQL among the documents as a tree of files, `project=…/doc_id=…/part-…`, written by the executors; with ``changed`` as a later state of it."""
    path = place(spark, "models")
    rows = table(spark, d, "documents").where("doc_type = 'sql' and text is not null and project is not null")
    if changed:
        rows = rows.where("updated_at is not null").withColumn("text", F.when(F.col("lang").isNull(), F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    rows.select("project", "doc_id", "text").write.partitionBy("project", "doc_id").text(path)
    return path


_MODELS_SQL = "documents WHERE doc_type = 'sql' AND text IS NOT NULL AND project IS NOT NULL"
_DOC_ID = r"doc_id=(\d+)"


@query("s9_text_tree", f"SELECT doc_id, text || chr(10) AS text FROM {_MODELS_SQL}")
def _(spark, d):
    return files.text_tree(spark, _models(spark, d), "part-*").select(F.regexp_extract("path", _DOC_ID, 1).cast("bigint").alias("doc_id"), "text")


@query("s10_rewrite", r"SELECT doc_id, regexp_replace(text, '(?i)\bsum\s*\(', 'total(', 'g') AS patched FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    path = place(spark, "patched")
    files.write_tree(_patched(spark, d).select("doc_id", "patched"), path)
    return spark.read.parquet(path)


def _project(spark, d) -> list[build.Node]:
    """Seeds as CSV, staging, an intermediate, a mart, a snapshot and tests of them."""
    def seed(name, *columns):
        def read(spark):
            src, path = table(spark, d, name).select(*columns), place(spark, f"seed-{name}")
            src.write.option("header", True).csv(path)
            return files.csv(spark, path, src.schema)

        return read

    def mart(spark, int_customer_values, nation, region):
        at = int_customer_values.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        return at.groupBy("r_name").agg(F.sum("lifetime_value").cast("double").alias("lifetime_value"), F.count("*").alias("n_customers"))

    return [
        build.Node("mart", "model", ("int_customer_values", "nation", "region"), mart),
        build.Node("stg_orders", "model", (), lambda spark: shop.orders(spark, d)),
        build.Node("stg_customers", "model", (), lambda spark: table(spark, d, "customer")),
        build.Node("int_customer_values", "model", ("stg_orders", "stg_customers"), lambda spark, stg_orders, stg_customers: stg_orders.groupBy("o_custkey").agg(F.sum("value").alias("lifetime_value")).join(stg_customers, F.col("o_custkey") == F.col("c_custkey"))),
        build.Node("nation", "seed", (), seed("nation", "n_nationkey", "n_name", "n_regionkey")),
        build.Node("region", "seed", (), seed("region", "r_regionkey", "r_name")),
        build.Node("account_versions", "snapshot", (), lambda spark: history(spark, d)),
        build.Node("stg_accounts", "model", (), lambda spark: table(spark, d, "account_master").select(word(F.col("plan_type")).alias("plan_type"))),
        build.Node("unique_customers", "test", ("int_customer_values",), build.unique("int_customer_values", ["o_custkey"])),
        build.Node("unique_order_customers", "test", ("stg_orders",), build.unique("stg_orders", ["o_custkey"])),
        build.Node("plans_stated", "test", ("stg_accounts",), build.not_null("stg_accounts", "plan_type")),
        build.Node("plans_known", "test", ("stg_accounts",), build.accepted("stg_accounts", "plan_type", ("free", "light", "standard"))),
        build.Node("nations_in_regions", "test", ("nation", "region"), build.related("nation", "n_regionkey", "region", "r_regionkey")),
    ]


_PLAN = "nullif(lower(trim(translate(plan_type, 'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ　', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz '))), '')"


@query("s11_build_dag", f"""WITH {VERSIONS}, r AS (
  SELECT 'mart' AS node, 'model' AS kind, (SELECT count(DISTINCT n_regionkey) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) AS n_rows
  UNION ALL SELECT 'stg_orders', 'model', (SELECT count(*) FROM orders) UNION ALL SELECT 'stg_customers', 'model', (SELECT count(*) FROM customer)
  UNION ALL SELECT 'int_customer_values', 'model', (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))
  UNION ALL SELECT 'nation', 'seed', (SELECT count(*) FROM nation) UNION ALL SELECT 'region', 'seed', (SELECT count(*) FROM region) UNION ALL SELECT 'account_versions', 'snapshot', (SELECT count(*) FROM versions)
  UNION ALL SELECT 'stg_accounts', 'model', (SELECT count(*) FROM account_master) UNION ALL SELECT 'unique_customers', 'test', 0
  UNION ALL SELECT 'unique_order_customers', 'test', (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) UNION ALL SELECT 'plans_stated', 'test', (SELECT count(*) FROM account_master WHERE {_PLAN} IS NULL)
  UNION ALL SELECT 'plans_known', 'test', (SELECT count(DISTINCT {_PLAN}) FROM account_master WHERE {_PLAN} NOT IN ('free', 'light', 'standard')) UNION ALL SELECT 'nations_in_regions', 'test', (SELECT count(DISTINCT n_regionkey) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)))
  SELECT *, CASE WHEN kind <> 'test' THEN 'built' WHEN n_rows = 0 THEN 'pass' ELSE 'fail' END AS status FROM r""")
def _(spark, d):
    """Every node of a project in the order of what it needs, with its rows; tests pass or fail."""
    nodes = _project(spark, d)
    return build.report(nodes, build.build(spark, nodes))


_SHEET_SQL = "SELECT trim(pair) AS pair, CASE WHEN lower(trim(compare_at)) IN ('overall', 'overall total') THEN 'ungrouped total' ELSE lower(trim(compare_at)) END AS compare_at, nullif(lower(trim(label)), '') AS label, lower(trim(evidence_status)) AS evidence_status, nullif(trim(missing_evidence), '') AS missing_evidence, CAST(minutes AS BIGINT) AS minutes, reviewer FROM (SELECT * FROM worksheet QUALIFY row_number() OVER (PARTITION BY trim(pair), reviewer ORDER BY received_at DESC, compare_at DESC, label DESC NULLS LAST, evidence_status DESC) = 1)"


@query("s12_markdown_table", "SELECT trim(pair) AS pair, nullif(trim(compare_at), '') AS compare_at, nullif(trim(label), '') AS label, trim(evidence_status) AS evidence_status, CAST(minutes AS VARCHAR) AS minutes FROM worksheet")
def _(spark, d):
    """Worksheets written as markdown rows under a header, and read back."""
    cells = ["pair", "compare_at", "label", "evidence_status", "minutes"]
    rows = table(spark, d, "worksheet").select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells]), F.lit(" |")).alias("line"))
    head = spark.createDataFrame([("| Pair | Scope | Label | Evidence | Min |",), ("| --- | --- | --- | --- | --- |",), ("Start time: 09:00",)], "line string")
    return files.markdown_rows(head.unionByName(rows), "line", cells).drop("cells")


@query("s13_integrity", f"WITH m AS (SELECT doc_id, sha256(text || chr(10)) AS expected, CASE WHEN updated_at IS NOT NULL THEN sha256(CASE WHEN lang IS NULL THEN text || ' ' ELSE text END || chr(10)) END AS actual FROM {_MODELS_SQL}) SELECT CAST(doc_id AS VARCHAR) AS file, expected, actual, coalesce(expected = actual, false) AS ok FROM m")
def _(spark, d):
    """The manifest of the models against a later state of the files: those without lang have a blank more, those without a date are gone."""
    manifest = table(spark, d, "documents").where("doc_type = 'sql' and text is not null and project is not null").select(F.col("doc_id").cast("string").alias("file"), F.sha2(F.concat("text", F.lit("\n")), 256).alias("expected"))
    return files.verify_manifest(spark, _models(spark, d, changed=True), manifest, _DOC_ID)


@query("s14_result_table", "WITH a AS (SELECT o_orderstatus, CAST(count(*) AS VARCHAR) AS n FROM orders GROUP BY 1), w AS (SELECT greatest(13, max(length(o_orderstatus))) AS w0, greatest(1, max(length(n))) AS w1 FROM a), r AS (SELECT 0 AS no, 'o_orderstatus' AS c0, 'n' AS c1, ' ' AS p UNION ALL SELECT 1, '-', '-', '-' UNION ALL SELECT row_number() OVER (ORDER BY o_orderstatus) + 1, o_orderstatus, n, ' ' FROM a) SELECT CAST(no AS INTEGER) AS no, rpad(c0, CAST(w0 AS INTEGER), p) || '  ' || rpad(c1, CAST(w1 AS INTEGER), p) AS line FROM r, w")
def _(spark, d):
    counts = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return files.table_lines(counts, ["o_orderstatus"])


# --- projection, filter, scalar expressions
@query("sel1_project_all", "SELECT * FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("*")


@query("sel2_project_columns", "SELECT l_orderkey, l_linenumber, p_brand, s_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey")
def _(spark, d):
    out = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return out.select("l_orderkey", "l_linenumber", "p_brand", "s_name")


@query("sel3_row_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")


metric("sel4_metric_filter", ["open_value", "order_value"], Scope(None, ("o_orderpriority",)), f"SELECT o_orderpriority, CAST(sum(value) FILTER (o_orderstatus = 'O') AS DOUBLE) AS open_value, CAST(sum(value) AS DOUBLE) AS order_value FROM {_O} GROUP BY 1")


@query("sel5_conditional_value", f"SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'O' THEN value ELSE 0 END AS DOUBLE) AS open_value FROM {_O}")
def _(spark, d):
    return shop.orders(spark, d).select("o_orderkey", F.when(F.col("o_orderstatus") == "O", F.col("value")).otherwise(0).cast("double").alias("open_value"))


@query("sel6_conditional_flag", "SELECT event_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS is_click FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", 1).otherwise(0).alias("is_click"))


@query("sel7_compound_flag", f"SELECT l_orderkey, l_linenumber, prompt_flag FROM {_I}")
def _(spark, d):
    return shop.items(spark, d).select("l_orderkey", "l_linenumber", "prompt_flag")


@query("sel8_arithmetic", f"SELECT l_orderkey, l_linenumber, CAST(revenue * 12 AS DOUBLE) AS yearly, CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) - revenue AS DOUBLE) AS discount_given, l_quantity / 7 + 1 AS weeks FROM {_I}")
def _(spark, d):
    return shop.items(spark, d).select("l_orderkey", "l_linenumber", (F.col("revenue") * 12).cast("double").alias("yearly"), (F.col("l_extendedprice").cast(shop.MONEY) - F.col("revenue")).cast("double").alias("discount_given"), (F.col("l_quantity") / 7 + 1).alias("weeks"))


@query("sel9_round", f"SELECT l_orderkey, l_linenumber, CAST(round(revenue, 2) AS DOUBLE) AS revenue FROM {_I}")
def _(spark, d):
    return shop.items(spark, d).select("l_orderkey", "l_linenumber", F.round("revenue", 2).cast("double").alias("revenue"))


@query("sel10_nullif_guard", "SELECT user_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END), 0) AS rate FROM events GROUP BY 1")
def _(spark, d):
    one = lambda k: F.sum(F.when(F.col("event_type") == k, 1).otherwise(0))
    return table(spark, d, "events").groupBy("user_id").agg((one("click") / F.nullif(one("view"), F.lit(0))).alias("rate"))


@query("sel11_text_to_date", "SELECT o_orderkey, strftime(CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE), '%Y-%m-%d') AS order_day FROM orders")
def _(spark, d):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", F.to_date(text).cast("string").alias("order_day"))


@query("sel12_decimal", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS VARCHAR) AS price FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast(shop.MONEY).cast("string").alias("price"))


@query("sel13_regex_replace", r"SELECT doc_id, regexp_replace(text, '(?i)\bsum\s*\(', 'total(', 'g') AS patched FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return _patched(spark, d).select("doc_id", "patched")


@query("sel14_numbered_lines", r"WITH d AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '(\r\n|\r|\n)\z', ''), '\r\n|\r|\n') AS a FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(unnest(generate_series(1, len(a))) AS INTEGER) AS line_no, unnest(a) AS line FROM d")
def _(spark, d):
    return texts.numbered_lines(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


@query("sel15_trim_upper_format", "SELECT n_nationkey, 'RAW.\"' || upper(trim(n_name)) || '\"' AS label FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.format_string('RAW."%s"', F.upper(F.trim("n_name"))).alias("label"))


@query("sel16_constant", "SELECT o_orderstatus, CAST(sum(1) AS BIGINT) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.sum(F.lit(1)).alias("n"))


metric("sel17_truncate_year", ["order_count"], YEAR, f"SELECT {_m('o_orderdate', 'year')}, CAST(count(o_orderkey) AS DOUBLE) AS order_count FROM orders GROUP BY 1")


@query("sel18_difference", f"{_CHANGED} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, before, after FROM z WHERE before IS DISTINCT FROM after")
def _(spark, d):
    return texts.changed_lines(_patched(spark, d), "doc_id", "text", "patched").withColumnRenamed("key", "doc_id")


# --- joins and orders
@query("j1_join_in_model", "SELECT l_orderkey, l_linenumber, o_custkey, p_brand FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey")
def _(spark, d):
    out = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return out.select("l_orderkey", "l_linenumber", "o_custkey", "p_brand")


metric("j2_entity_path_join", ["item_revenue"], Scope(None, ("order__customer__c_mktsegment", "part__p_brand")), f"SELECT c_mktsegment AS order__customer__c_mktsegment, p_brand AS part__p_brand, CAST(sum(revenue) AS DOUBLE) AS item_revenue FROM {_I} LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")


@query("j3_align_models", f"WITH a AS (SELECT o_orderstatus AS k, CAST(sum(value) AS DOUBLE) AS order_value FROM {_O} GROUP BY 1), b AS (SELECT l_linestatus AS k, CAST(sum(revenue) AS DOUBLE) AS item_revenue FROM {_I} GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, order_value, item_revenue, a.k IS NOT NULL AS in_0, b.k IS NOT NULL AS in_1 FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def _(spark, d):
    c = Compiler(_REGISTRY, spark, d)
    a = c.query("order_value", Scope(None, ("o_orderstatus",))).select(F.col("o_orderstatus").alias("k"), F.col("order_value").cast("double").alias("order_value"))
    b = c.query("item_revenue", Scope(None, ("l_linestatus",))).select(F.col("l_linestatus").alias("k"), F.col("item_revenue").cast("double").alias("item_revenue"))
    return align([a, b], ["k"])


@query("j4_positional_zip", f"{_CHANGED} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (before IS DISTINCT FROM after) AS n_changed FROM z GROUP BY 1")
def _(spark, d):
    lines = _patched(spark, d).select("doc_id", F.split("text", texts.LINE_ENDS).alias("a"), F.split("patched", texts.LINE_ENDS).alias("b"))
    zipped = lines.select("doc_id", F.explode(F.slice(F.arrays_zip("a", "b"), F.lit(1), F.least(F.size("a"), F.size("b")))).alias("z"))
    return zipped.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(~F.col("z.a").eqNullSafe(F.col("z.b"))).alias("n_changed"))


_BOTH_SQL = f"WITH s AS ({_SHEET_SQL}), cases AS (SELECT a.pair, a.label AS label_1, a.evidence_status AS status_1, b.label AS label_2, b.evidence_status AS status_2, CASE WHEN a.label IS NULL OR b.label IS NULL THEN 'blank' WHEN a.label <> b.label THEN 'different' WHEN a.evidence_status IS DISTINCT FROM b.evidence_status THEN 'evidence-only' ELSE 'agree' END AS \"case\" FROM s a JOIN s b ON a.pair = b.pair AND a.reviewer = 1 AND b.reviewer = 2)"


def _sheet(spark, d):
    return annotate.latest(table(spark, d, "worksheet"))


@query("j5_worksheet_join", f"{_BOTH_SQL} SELECT pair, label_1, status_1, label_2, status_2 FROM cases")
def _(spark, d):
    return annotate.classify_cases(_sheet(spark, d)).drop("case")


@query("j6_manifest_join", "WITH m AS (SELECT doc_id, sha256(text) AS expected FROM documents WHERE text IS NOT NULL), a AS (SELECT doc_id, sha256(CASE WHEN lang IS NULL THEN text || ' ' ELSE text END) AS actual FROM documents WHERE text IS NOT NULL AND project IS NOT NULL) SELECT doc_id, expected, actual, CASE WHEN actual IS NULL THEN 'missing' WHEN expected = actual THEN 'ok' ELSE 'changed' END AS status FROM m LEFT JOIN a USING (doc_id)")
def _(spark, d):
    """A manifest of all texts against a later delivery, in which texts without lang have a blank more and those without project are gone."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    manifest = docs.select("doc_id", F.sha2("text", 256).alias("expected"))
    later = docs.where(F.col("project").isNotNull()).withColumn("text", F.when(F.col("lang").isNull(), F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    return files.check_manifest(manifest, later.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("actual")), "doc_id")


@query("o2_sorted_files", f"SELECT CAST(row_number() OVER (ORDER BY 'project=' || project || '/doc_id=' || doc_id) AS INTEGER) AS no, doc_id FROM {_MODELS_SQL}")
def _(spark, d):
    paths = files.text_tree(spark, _models(spark, d), "part-*").select("path")
    return paths.select(F.row_number().over(Window.orderBy("path")).alias("no"), F.regexp_extract("path", _DOC_ID, 1).cast("bigint").alias("doc_id"))


@query("o3_draw_order", f"{_BOTH_SQL} SELECT CAST(substr(p.pair, 4) AS BIGINT) AS draw, p.pair, \"case\" FROM metric_pair p LEFT JOIN cases c ON p.pair = c.pair")
def _(spark, d):
    """The draw order travels as an ordinal of its own (here the number in the pair's code)."""
    pairs = table(spark, d, "metric_pair")
    record = annotate.decision_record(pairs, annotate.classify_cases(_sheet(spark, d)))
    return record.select(F.substr("pair", F.lit(4)).cast("bigint").alias("draw"), "pair", "case").orderBy("draw")


# --- metadata
def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_D1 = """order_value simple value|order_rows simple rows|order_count simple keys|urgent_value simple urgent|open_value simple value|item_revenue simple revenue|returned_revenue simple returned|prompt_items simple prompt|item_count simple item_rows
lifetime_value simple lifetime|customer_count simple customers|month_value simple monthly|event_count simple events|click_count simple clicks|view_count simple views|urgent_share ratio|returned_share ratio|prompt_rate ratio|click_rate ratio|value_per_customer ratio
order_value_annual derived|returned_to_urgent derived|order_value_running cumulative|order_value_last3 cumulative|order_value_before offset|click_count_before offset"""
_D1 = [(*x.split(" "), "")[:3] for x in _D1.replace("\n", "|").split("|")]


@query("d1_list_metrics", f"SELECT metric, kind, nullif(measure, '') AS measure, CASE metric WHEN 'open_value' THEN {_quoted("o_orderstatus = 'O'")} END AS filter, {len(_D1)} AS n_metrics FROM (VALUES {', '.join(map(str, _D1))}) t(metric, kind, measure)")
def _(spark, d):
    found = catalog.list_metrics(spark, _REGISTRY)
    return found.withColumn("n_metrics", F.lit(len(_REGISTRY.metrics)))


@query("d2_list_dimensions", """SELECT * FROM (VALUES ('order_value', 'customer__c_mktsegment'), ('order_value', 'customer__nation__n_name'), ('order_value', 'customer__nation__region__r_name'), ('order_value', 'o_orderpriority'), ('order_value', 'o_orderstatus'),
  ('order_value', 'metric_time__day'), ('order_value', 'metric_time__month'), ('order_value', 'metric_time__year'), ('click_rate', 'event_type'), ('click_rate', 'metric_time__day'), ('click_rate', 'metric_time__month'), ('click_rate', 'metric_time__year'),
  ('value_per_customer', 'customer__c_mktsegment'), ('value_per_customer', 'customer__nation__n_name'), ('value_per_customer', 'customer__nation__region__r_name'), ('value_per_customer', 'metric_time__day'), ('value_per_customer', 'metric_time__month'), ('value_per_customer', 'metric_time__year')) t(metric, dimension)""")
def _(spark, d):
    """By what a simple metric, a ratio, and a ratio across models (what both can reach) can be grouped."""
    return reduce(DataFrame.unionByName, [catalog.list_dimensions(spark, _REGISTRY, m).select(F.lit(m).alias("metric"), "dimension") for m in ("order_value", "click_rate", "value_per_customer")])


_EXPLAINED = (("open_value", MONTH), ("click_rate", DAY), ("value_per_customer", MONTH), ("returned_to_urgent", YEAR), ("order_value_annual", YEAR), ("order_value_running", Scope("month", ("customer__c_mktsegment",))), ("order_value_last3", MONTH), ("click_count_before", DAY), ("item_revenue", Scope(None, ("order__customer__nation__n_name", "l_returnflag"))), ("urgent_share", TOTAL))


def _long_sql(name: str, scope: Scope) -> str:
    keys = [f"strftime({k}, '%Y-%m-%d')" if k.startswith("metric_time__") else k for k in scope.keys]
    group = f"concat_ws('|', {', '.join(keys)})" if keys else "''"
    return f"SELECT '{name}' AS metric, {group} AS group_key, round(CAST({name} AS DOUBLE), 6) AS value FROM ({catalog.render_sql(_REGISTRY, name, scope)})"


@query("d3_explain", " UNION ALL ".join(_long_sql(*x) for x in _EXPLAINED))
def _(spark, d):
    """Values of metrics of every kind; the SQL that is shown for each of them gives the same on another engine (its twin)."""
    def one(name, scope):
        out = _days(Compiler(_REGISTRY, spark, d).query(name, scope))
        return out.select(F.lit(name).alias("metric"), F.concat_ws("|", *scope.keys).alias("group_key") if scope.keys else F.lit("").alias("group_key"), F.round(F.col(name).cast("double"), 6).alias("value"))

    return reduce(DataFrame.unionByName, [one(*x) for x in _EXPLAINED])


@query("d4_inline_sql", "SELECT o_orderstatus, count(*) AS n_orders FROM orders GROUP BY 1")
def _(spark, d):
    return catalog.inline_sql(spark, d, "select o_orderstatus, count(*) as n_orders from {{ ref('orders') }} group by 1")


_D5 = {"returned_revenue": ("returned", "case when l_returnflag = 'R' then revenue else 0 end", "items"), "item_revenue": ("revenue", "revenue", "items"), "urgent_value": ("urgent", "case when o_orderpriority = '1-URGENT' then value else 0 end", "orders"), "order_value": ("value", "value", "orders")}


@query("d5_lineage", "SELECT 'returned_to_urgent' AS metric, t.*, 'sum' AS agg, CASE model WHEN 'items' THEN 'l_orderkey,l_linenumber' ELSE 'o_orderkey' END AS grain, CASE model WHEN 'items' THEN 'l_shipdate' ELSE 'o_orderdate' END AS time, CAST(NULL AS VARCHAR) AS filter FROM (VALUES " + ", ".join(f"('{k}', '{m}', {_quoted(x)}, '{model}', {_quoted(_I if model == 'items' else _O)})" for k, (m, x, model) in _D5.items()) + ") t(leaf, measure, expr, model, sql)")
def _(spark, d):
    return catalog.trace(spark, _REGISTRY, "returned_to_urgent")


# --- comparison of a pair of metrics
def _report(m1: str, m2: str, scope: Scope) -> Query:
    return lambda spark, d: _days(compare.compare(Compiler(_REGISTRY, spark, d), m1, m2, scope))


_PAIR = f"a AS (SELECT {_m('o_orderdate')}, CAST(sum(value) AS DOUBLE) AS v FROM {_O} GROUP BY 1), b AS (SELECT {_m('first_order')}, CAST(sum(lifetime_value) AS DOUBLE) AS v FROM {_C} GROUP BY 1), r AS (SELECT coalesce(a.metric_time__month, b.metric_time__month) AS metric_time__month, a.v AS v1, b.v AS v2, a.v - b.v AS delta, CASE WHEN a.metric_time__month IS NULL THEN 'right_only' WHEN b.metric_time__month IS NULL THEN 'left_only' ELSE 'both' END AS presence, coalesce(a.v <> b.v, true) AS differs FROM a FULL JOIN b ON a.metric_time__month = b.metric_time__month)"
QUERIES["c3_value_difference"], ORACLE["c3_value_difference"] = _report("order_value", "lifetime_value", MONTH), _days_sql(f"WITH {_PAIR} SELECT * FROM r", "month")
QUERIES["c2_same_way"], ORACLE["c2_same_way"] = _report("order_value", "month_value", MONTH), _days_sql(f"SELECT {_m('o_orderdate')}, CAST(sum(value) AS DOUBLE) AS v1, CAST(sum(value) AS DOUBLE) AS v2, CAST(0 AS DOUBLE) AS delta, 'both' AS presence, false AS differs FROM {_O} GROUP BY 1", "month")


@query("c1_scope_enforced", "WITH s AS (SELECT compare_at AS scope, lower(trim(compare_at)) AS w, count(*) AS n FROM worksheet GROUP BY ALL UNION ALL SELECT * FROM (VALUES ('metric_time__week', 'metric_time__week', 1), ('by branch', 'by branch', 1), ('ＯＶＥＲＡＬＬ', 'overall', 1))) SELECT scope, n, CASE WHEN w IN ('ungrouped total', 'overall', 'overall total') THEN 'ungrouped total' WHEN w IN ('metric_time__day', 'metric_time__month', 'metric_time__year') THEN w END AS declared FROM s")
def _(spark, d):
    """What every spelling of a scope is read as; those that are no declared scope, three made-up ones among them, are rejected."""
    other = spark.createDataFrame([("metric_time__week",), ("by branch",), ("ＯＶＥＲＡＬＬ",)], "compare_at string")
    return annotate.scopes_in_use(table(spark, d, "worksheet").select("compare_at").unionByName(other), "compare_at")


@query("c4_agrees_on_sample", f"SELECT 'ungrouped total' AS scope, CAST(1 AS BIGINT) AS n_groups, CAST(CASE WHEN (SELECT sum(value) FROM {_O}) = (SELECT sum(lifetime_value) FROM {_C}) THEN 0 ELSE 1 END AS BIGINT) AS n_differ, CAST(0 AS BIGINT) AS n_left_only, CAST(0 AS BIGINT) AS n_right_only, (SELECT sum(value) FROM {_O}) = (SELECT sum(lifetime_value) FROM {_C}) AS agrees_on_sample")
def _(spark, d):
    return compare.compare_scopes(Compiler(_REGISTRY, spark, d), "order_value", "lifetime_value", ["ungrouped total"])


@query("c5_missing_groups", _days_sql(f"WITH {_PAIR} SELECT metric_time__month, presence FROM r WHERE presence <> 'both'", "month"))
def _(spark, d):
    return _report("order_value", "lifetime_value", MONTH)(spark, d).where("presence <> 'both'").select("metric_time__month", "presence")


@query("c6_cross_grain", _days_sql(f"SELECT {_m('o_orderdate')}, CAST(sum(value) AS DOUBLE) AS v1, CAST(sum(value) AS DOUBLE) AS v2, CAST(0 AS DOUBLE) AS delta, 'both' AS presence, false AS differs FROM {_O} GROUP BY 1", "month"))
def _(spark, d):
    fine = shop.customer_months(spark, d).withColumn("metric_time__month", F.col("order_month").cast("date"))
    return _days(compare.cross_grain(fine, Compiler(_REGISTRY, spark, d).query("order_value", MONTH), ["metric_time__month"], "month_value", "order_value"))


@query("c7_partial_scopes", f"WITH {_PAIR} SELECT 'metric_time__month' AS scope, count(*) AS n_groups, count(*) FILTER (differs) AS n_differ, count(*) FILTER (presence = 'left_only') AS n_left_only, count(*) FILTER (presence = 'right_only') AS n_right_only, count(*) FILTER (differs) = 0 AS agrees_on_sample FROM r UNION ALL SELECT 'ungrouped total', 1, 0, 0, 0, true")
def _(spark, d):
    return compare.compare_scopes(Compiler(_REGISTRY, spark, d), "order_value", "lifetime_value", ["ungrouped total", "metric_time__month"])


# --- annotation
_VOCAB = ", ".join(f"'{x}'" for x in annotate.LABELS)
_RULES = f"""WITH s AS ({_SHEET_SQL}), p AS (SELECT trim(pair) AS pair, lower(trim(compare_at)) AS declared FROM metric_pair), j AS (SELECT s.*, declared FROM s LEFT JOIN p USING (pair)), v AS (
  SELECT pair, reviewer, 'unknown label' AS problem FROM j WHERE label IS NOT NULL AND label NOT IN ({_VOCAB})
  UNION ALL SELECT pair, reviewer, 'unknown status' FROM j WHERE evidence_status IS NULL OR evidence_status NOT IN ('sufficient', 'needs_review')
  UNION ALL SELECT pair, reviewer, 'blank label not under review' FROM j WHERE label IS NULL AND evidence_status = 'sufficient'
  UNION ALL SELECT pair, reviewer, 'review without missing evidence' FROM j WHERE evidence_status = 'needs_review' AND missing_evidence IS NULL
  UNION ALL SELECT pair, reviewer, 'unknown pair' FROM j WHERE declared IS NULL
  UNION ALL SELECT pair, reviewer, 'scope is not the declared one' FROM j WHERE declared IS NOT NULL AND compare_at IS DISTINCT FROM declared
  UNION ALL SELECT pair, reviewer, 'minutes missing' FROM j WHERE minutes IS NULL
  UNION ALL SELECT pair, NULL, 'not reviewed' FROM p WHERE pair NOT IN (SELECT pair FROM s))"""


_LINED = "(SELECT *, CASE WHEN minutes IS NULL THEN 8 ELSE 9 END AS cells, row_number() OVER (PARTITION BY reviewer ORDER BY received_at, pair) AS line_no FROM (SELECT trim(pair) AS pair, reviewer, minutes, received_at FROM worksheet WHERE pair IS NOT NULL AND reviewer IS NOT NULL))"


@query("r1_worksheet_rules", f"""{_RULES}, o AS (SELECT trim(pair) AS pair, row_number() OVER (ORDER BY trim(pair)) AS ordinal FROM metric_pair), l AS (
  SELECT w.pair, reviewer, cells, ordinal, max(ordinal) OVER (PARTITION BY reviewer ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {_LINED} w LEFT JOIN o ON o.pair = w.pair)
  SELECT * FROM v UNION ALL SELECT pair, reviewer, 'not nine cells' FROM l WHERE cells <> 9 UNION ALL SELECT pair, reviewer, 'out of packet order' FROM l WHERE ordinal < reached""")
def _(spark, d):
    """What the cells say, and how the sheets are laid out: their rows as markdown in the order received, a missing minute leaving its cell out."""
    raw = table(spark, d, "worksheet").where(F.col("pair").isNotNull() & F.col("reviewer").isNotNull())
    pairs = table(spark, d, "metric_pair")
    shown = F.concat(F.lit("|"), F.concat_ws("|", *[F.coalesce(F.regexp_replace(c, r"\|", "/"), F.lit("")) for c in annotate.CELLS[:-1]], F.col("minutes").cast("string")), F.lit("|"))
    lines = raw.select("reviewer", F.row_number().over(Window.partitionBy("reviewer").orderBy("received_at", F.trim("pair"))).alias("line_no"), F.trim("pair").alias("pair"), (F.size(F.split(shown, r"\|")) - 2).alias("cells"))
    packet = pairs.select(F.trim("pair").alias("pair"), F.row_number().over(Window.orderBy(F.trim("pair"))).cast("bigint").alias("ordinal"))
    return annotate.violations(_sheet(spark, d), pairs).unionByName(annotate.layout_violations(lines, packet))


@query("c8_label_vocabulary", f"WITH s AS ({_SHEET_SQL}), t AS (SELECT pair, reviewer, CASE WHEN reviewer = 2 THEN replace(label, '_', '-') ELSE label END AS label FROM s) SELECT pair, reviewer, label, label IN ({_VOCAB}) AS known FROM t WHERE label IS NOT NULL")
def _(spark, d):
    """Labels in and out of the vocabulary; the second reviewer's are taken as typed with hyphens, which are none."""
    typed = _sheet(spark, d).withColumn("label", F.when(F.col("reviewer") == 2, F.replace("label", F.lit("_"), F.lit("-"))).otherwise(F.col("label")))
    wrong = annotate.violations(typed, table(spark, d, "metric_pair")).where("problem = 'unknown label'").select("pair", "reviewer", F.lit(True).alias("wrong"))
    return typed.where("label is not null").join(wrong, ["pair", "reviewer"], "left").select("pair", "reviewer", "label", F.col("wrong").isNull().alias("known"))


@query("c9_evidence_status", f"{_RULES} SELECT pair, reviewer, problem FROM v WHERE problem IN ('unknown status', 'blank label not under review', 'review without missing evidence')")
def _(spark, d):
    return annotate.violations(_sheet(spark, d), table(spark, d, "metric_pair")).where("problem in ('unknown status', 'blank label not under review', 'review without missing evidence')")


@query("r2_cases", f"{_BOTH_SQL} SELECT * FROM cases")
def _(spark, d):
    return annotate.classify_cases(_sheet(spark, d))


@query("r3_agreement", f"{_BOTH_SQL} SELECT \"case\", CASE WHEN label_1 = label_2 THEN label_1 END AS label, count(*) AS n FROM cases GROUP BY 1, 2")
def _(spark, d):
    return annotate.summarize(annotate.classify_cases(_sheet(spark, d)))


_CAUSES = ", ".join(f"'{x}'" for x in annotate.ROOT_CAUSES)


@query("r4_root_cause", f"{_BOTH_SQL}, said AS (SELECT trim(pair) AS pair, min(nullif(lower(regexp_extract(conditions, 'root cause of the split is (\\w+)', 1, 'i')), '')) AS cause FROM worksheet GROUP BY 1), r AS (SELECT trim(p.pair) AS pair, coalesce(\"case\" = 'different', false) AS needs, CASE WHEN cause = 'judgment' THEN 'taste' ELSE cause END AS cause FROM metric_pair p LEFT JOIN cases c ON c.pair = trim(p.pair) LEFT JOIN said s ON s.pair = trim(p.pair)) SELECT pair, CASE WHEN needs THEN 'root cause missing or unknown' ELSE 'root cause without disagreement' END AS problem FROM r WHERE CASE WHEN needs THEN cause IS NULL OR cause NOT IN ({_CAUSES}) ELSE cause IS NOT NULL END")
def _(spark, d):
    """The record with the causes that the sheets' conditions name (judgment put down as taste, which is no known cause), held against the cases."""
    record = annotate.decision_record(table(spark, d, "metric_pair").withColumn("pair", F.trim("pair")), annotate.classify_cases(_sheet(spark, d)))
    record = annotate.with_causes(record, table(spark, d, "worksheet").select("pair", F.col("conditions").alias("text")))
    return annotate.root_cause_violations(record.withColumn("root_cause", F.when(F.col("root_cause") == "judgment", "taste").otherwise(F.col("root_cause"))))


_PARTIES = ("copperleaf-supply", "ember-canteen", "Mara Quist")
_NEUTRAL_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '[\w.+-]+@[\w-]+(\.[\w-]+)+', '<e-mail>', 'g'), '\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?', '<date>', 'g'), '\b(Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+( [A-Z][a-z]+)?\b', '<name>', 'g'), '(?i)\breviewer [A-Z0-9]+\b', 'Reviewer', 'g'), '(?i)\b(copperleaf-supply|ember-canteen|Mara Quist)\b', '<name>', 'g')"


@query("r5_redaction", r"WITH d AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '(\r\n|\r|\n)\z', ''), '\r\n|\r|\n') AS a FROM documents WHERE length(text) > 0), l AS (SELECT doc_id, CAST(unnest(generate_series(1, len(a))) AS INTEGER) AS line_no, unnest(a) AS line FROM d) SELECT doc_id, line_no, CASE WHEN starts_with(ltrim(line), '|') THEN line ELSE " + _NEUTRAL_SQL + " END AS neutral FROM l")
def _(spark, d):
    lines = texts.numbered_lines(table(spark, d, "documents"), "doc_id", "text")
    return lines.select(F.col("key").alias("doc_id"), "line_no", annotate.redact(F.col("line"), _PARTIES).alias("neutral"))


@query("r6_append_only", f"WITH s AS ({_SHEET_SQL}) SELECT pair, reviewer, CASE WHEN label IS NULL THEN 'related' ELSE label END AS label FROM s")
def _(spark, d):
    """Corrections (here: a label for every blank one) come as later rows; the log keeps both."""
    log = table(spark, d, "worksheet")
    blank = _sheet(spark, d).where("label is null").select("pair", "reviewer")
    fix = log.join(blank, ["pair", "reviewer"], "left_semi").withColumn("label", F.lit("related")).withColumn("received_at", F.lit("2100-01-01 00:00:00").cast(log.schema["received_at"].dataType))
    return annotate.latest(annotate.correct(log, fix)).select("pair", "reviewer", "label")


_LOCKED = "sha256(pair || '|' || project || '|' || metric_1 || '|' || metric_2 || '|' || {})"


@query("r7_hash_lock", f"WITH a AS (SELECT pair, {_LOCKED.format('compare_at')} AS expected FROM metric_pair), b AS (SELECT pair, {_LOCKED.format(chr(39) + 'ungrouped total' + chr(39))} AS actual FROM metric_pair WHERE project <> 'ember-canteen' UNION ALL SELECT 'MP-new', sha256('MP-new')) SELECT pair, expected, actual, CASE WHEN expected IS NULL THEN 'unlisted' WHEN actual IS NULL THEN 'missing' WHEN expected = actual THEN 'ok' ELSE 'changed' END AS status FROM a FULL JOIN b USING (pair)")
def _(spark, d):
    """Pairs locked by stored digests, held against a later packet: every scope made the total, one project left out, one pair new."""
    pairs = table(spark, d, "metric_pair")
    digest = lambda *c: F.sha2(F.concat_ws("|", *c), 256)
    locked = cut(pairs.select("pair", digest("pair", "project", "metric_1", "metric_2", "compare_at").alias("expected")), "lock")
    later = pairs.where("project <> 'ember-canteen'").select("pair", digest("pair", "project", "metric_1", "metric_2", F.lit("ungrouped total")).alias("actual"))
    new = spark.range(1).select(F.lit("MP-new").alias("pair"), F.sha2(F.lit("MP-new"), 256).alias("actual"))
    return files.check_manifest(locked, later.unionByName(new), "pair")


@query("r8_effort", f"WITH s AS ({_SHEET_SQL}), e AS (SELECT reviewer, count(*) AS n_pairs, CAST(sum(minutes) AS BIGINT) AS minutes, count(*) FILTER (minutes IS NULL) AS n_without_minutes FROM s GROUP BY 1), a AS (SELECT reviewer, CAST(sum(minutes) FILTER (minutes IS NOT NULL) + CASE reviewer WHEN 1 THEN 32 ELSE 0 END AS BIGINT) AS active_minutes FROM s GROUP BY 1) SELECT e.*, active_minutes, minutes <> active_minutes OR n_without_minutes > 0 AS mismatch FROM e JOIN a USING (reviewer)")
def _(spark, d):
    """Minutes of the pairs against the active minutes declared in the sheets' heads (here the first reviewer's are 32 more)."""
    sheet = _sheet(spark, d)
    active = sheet.groupBy("reviewer").agg((F.sum("minutes") + F.when(F.col("reviewer") == 1, 32).otherwise(0)).alias("active_minutes"))
    return annotate.effort(sheet, active)


@query("u1_sql_macro", "SELECT o_orderkey, CAST(year(CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE)) AS INTEGER) AS y FROM orders")
def _(spark, d):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION year_of_text(s STRING) RETURNS INT RETURN year(to_date(s))")
    files.register(table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), "orders_as_text")
    return spark.sql("SELECT o_orderkey, year_of_text(day) AS y FROM orders_as_text")


@query("x1_windowed_events", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12, 2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    return windowed_counts(table(spark, d, "events")).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")
