"""A registry over the order tables: models with different grains and default times, and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans.semantic import Measure, Metric, Registry, SemanticModel
from tallyforge.sources.tables import table

MONEY = "decimal(12,2)"


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("value", F.col("o_totalprice").cast(MONEY))


def items(spark: SparkSession, d: str) -> DataFrame:
    """Order items; money is decimal, and the flag holds for small and promptly shipped ones."""
    price, discount = F.col("l_extendedprice").cast(MONEY), F.col("l_discount").cast(MONEY)
    prompt = (F.col("l_shipdate") < F.lit("1998-01-01")) & (F.col("l_quantity") <= 25)
    return table(spark, d, "lineitem").withColumns({"revenue": price * (1 - discount), "prompt_flag": F.when(prompt, 1).otherwise(0)})


def customer_orders(spark: SparkSession, d: str) -> DataFrame:
    """Customer grain: what each customer ever ordered, and when first."""
    return orders(spark, d).groupBy("o_custkey").agg(F.sum("value").alias("lifetime_value"), F.min("o_orderdate").alias("first_order"))


def customer_months(spark: SparkSession, d: str) -> DataFrame:
    """Customer and month grain."""
    return orders(spark, d).groupBy("o_custkey", F.date_trunc("month", "o_orderdate").alias("order_month")).agg(F.sum("value").alias("month_value"))


_ORDERS = "(SELECT *, CAST(o_totalprice AS DECIMAL(12, 2)) AS value FROM orders)"
_ITEMS = "(SELECT *, CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(12, 2))) AS revenue, CASE WHEN l_shipdate < '1998-01-01' AND l_quantity <= 25 THEN 1 ELSE 0 END AS prompt_flag FROM lineitem)"


def _plain(name: str):
    return lambda spark, d: table(spark, d, name)


def shop() -> Registry:
    r = Registry()
    r.add(
        SemanticModel("orders", orders, ("o_orderkey",), "order", {"order": "o_orderkey", "customer": "o_custkey"}, "o_orderdate", ("o_orderstatus", "o_orderpriority"), _ORDERS),
        SemanticModel("items", items, ("l_orderkey", "l_linenumber"), "item", {"order": "l_orderkey", "part": "l_partkey", "supplier": "l_suppkey"}, "l_shipdate", ("l_returnflag", "l_linestatus"), _ITEMS),
        SemanticModel("customers", _plain("customer"), ("c_custkey",), "customer", {"customer": "c_custkey", "nation": "c_nationkey"}, None, ("c_mktsegment",), "customer"),
        SemanticModel("nations", _plain("nation"), ("n_nationkey",), "nation", {"nation": "n_nationkey", "region": "n_regionkey"}, None, ("n_name",), "nation"),
        SemanticModel("regions", _plain("region"), ("r_regionkey",), "region", {"region": "r_regionkey"}, None, ("r_name",), "region"),
        SemanticModel("parts", _plain("part"), ("p_partkey",), "part", {"part": "p_partkey"}, None, ("p_brand", "p_type"), "part"),
        SemanticModel("suppliers", _plain("supplier"), ("s_suppkey",), "supplier", {"supplier": "s_suppkey", "nation": "s_nationkey"}, None, (), "supplier"),
        SemanticModel("customer_orders", customer_orders, ("o_custkey",), "customer_life", {"customer_life": "o_custkey", "customer": "o_custkey"}, "first_order", (), f"(SELECT o_custkey, sum(value) AS lifetime_value, min(o_orderdate) AS first_order FROM {_ORDERS} GROUP BY o_custkey)"),
        SemanticModel("customer_months", customer_months, ("o_custkey", "order_month"), "customer_month", {"customer": "o_custkey"}, "order_month", (), f"(SELECT o_custkey, date_trunc('month', o_orderdate) AS order_month, sum(value) AS month_value FROM {_ORDERS} GROUP BY 1, 2)"),
        SemanticModel("events", _plain("events"), ("event_id",), "event", {"event": "event_id"}, "ts", ("event_type",), "events"),
    )
    r.add(
        Measure("value", "orders", "sum", "value"),
        Measure("rows", "orders", "sum", "1"),
        Measure("keys", "orders", "count", "o_orderkey"),
        Measure("urgent", "orders", "sum", "case when o_orderpriority = '1-URGENT' then value else 0 end"),
        Measure("revenue", "items", "sum", "revenue"),
        Measure("returned", "items", "sum", "case when l_returnflag = 'R' then revenue else 0 end"),
        Measure("prompt", "items", "sum", "prompt_flag"),
        Measure("item_rows", "items", "sum", "1"),
        Measure("lifetime", "customer_orders", "sum", "lifetime_value"),
        Measure("customers", "customer_orders", "count", "o_custkey"),
        Measure("monthly", "customer_months", "sum", "month_value"),
        Measure("events", "events", "count", "event_id"),
        Measure("clicks", "events", "sum", "case when event_type = 'click' then 1 else 0 end"),
        Measure("views", "events", "sum", "case when event_type = 'view' then 1 else 0 end"),
    )
    simple = lambda name, measure, where=None: Metric(name, "simple", measure=measure, where=where)
    ratio = lambda name, a, b: Metric(name, "ratio", numerator=a, denominator=b)
    r.add(
        simple("order_value", "value"), simple("order_rows", "rows"), simple("order_count", "keys"), simple("urgent_value", "urgent"), simple("open_value", "value", "o_orderstatus = 'O'"),
        simple("item_revenue", "revenue"), simple("returned_revenue", "returned"), simple("prompt_items", "prompt"), simple("item_count", "item_rows"),
        simple("lifetime_value", "lifetime"), simple("customer_count", "customers"), simple("month_value", "monthly"), simple("event_count", "events"), simple("click_count", "clicks"), simple("view_count", "views"),
        ratio("urgent_share", "urgent_value", "order_value"), ratio("returned_share", "returned_revenue", "item_revenue"), ratio("prompt_rate", "prompt_items", "item_count"),
        ratio("click_rate", "click_count", "view_count"), ratio("value_per_customer", "order_value", "customer_count"),
        Metric("order_value_annual", "derived", expr="v * 12", inputs=(("v", "order_value"),)),
        Metric("returned_to_urgent", "derived", expr="a / nullif(b, 0)", inputs=(("a", "returned_share"), ("b", "urgent_share"))),
        Metric("order_value_running", "cumulative", base="order_value"), Metric("order_value_last3", "cumulative", base="order_value", window=3),
        Metric("order_value_before", "offset", base="order_value", shift=1), Metric("click_count_before", "offset", base="click_count", shift=7),
    )
    return r
