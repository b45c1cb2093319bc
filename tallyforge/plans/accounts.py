"""The account tables under their reading rules: keys, months, code words and last loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.normalize import account_key, month_start, word
from tallyforge.operators.history import build_history
from tallyforge.sources.tables import table

RECORD = ("account_id", "revenue_month", "line_no")


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of plan_type and status of every account: (account_id, plan_type, status, valid_from, valid_to, newest)."""
    return versions_of(table(spark, folder, "account_master"))


def versions_of(snaps: DataFrame) -> DataFrame:
    """The same of the snapshots given."""
    versions = build_history(
        snaps,
        key=account_key(F.col("account_id")),
        date=F.col("as_of_date"),
        attributes={"plan_type": word(F.col("plan_type")), "status": word(F.col("status"))},
        loaded=F.col("loaded_at"),
        carry=("plan_type",),
    )
    return versions.withColumnRenamed("key", "account_id")


def revenue_rows(spark: SparkSession, folder: str) -> DataFrame:
    """revenue_monthly with normal account ids and months; rows with a null account_id are left out."""
    rows = table(spark, folder, "revenue_monthly")
    return rows.withColumns({"account_id": account_key(F.col("account_id")), "revenue_month": month_start(F.col("revenue_month"))}).where(F.col("account_id").isNotNull())
