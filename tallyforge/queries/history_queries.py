"""Queries p1 to p7: histories and deliveries of the account tables, and their SQL twins."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.normalize import account_key, iso, month_from_no, month_no, word
from tallyforge.operators import late, orphans
from tallyforge.operators.asof import as_known
from tallyforge.operators.dedupe import keep_last
from tallyforge.operators.history import merge_snapshot, snapshot_calendar
from tallyforge.operators.rolling import borne_out, trailing_totals
from tallyforge.operators.snapshot_diff import bucket_of, diff_pairs
from tallyforge.operators.units import to_yen
from tallyforge.plans.accounts import history, revenue_rows, versions_of
from tallyforge.queries.dirty_sql import REVENUE, VERSIONS, day
from tallyforge.session import cut
from tallyforge.sources.tables import table

#: Deliveries that bring a revenue month in full: those of the three months after it.
COVERING = 3
#: Rows of revenue_monthly to a hash bucket of the snapshot comparison.
ROWS_PER_BUCKET = 20_000

#: Keys over which the rows of one account and delivery are spread where they meet orphan instants, which are few.
SALTS = 8

_KEY = {"account_id": F.col, "revenue_month": F.col, "line_no": F.col, "snapshot_date": F.col}


def _key() -> dict:
    return {n: f(n) for n, f in _KEY.items()}


def _yen_rows(spark: SparkSession, d: str, keep: dict) -> DataFrame:
    return to_yen(revenue_rows(spark, d), table(spark, d, "fx_rate"), "revenue_amount", "currency", "remark", F.col("revenue_month"), keep)


def _trailing_months(spark: SparkSession, d: str, windows: list[int]) -> DataFrame:
    """Trailing totals of every listed account; a month's total takes each record's newest delivery."""
    rows = _yen_rows(spark, d, {**_key(), "message_count": F.col("message_count"), "loaded_at": F.col("loaded_at")})
    rows = rows.where(F.col("revenue_month").isNotNull())
    records = keep_last(
        rows,
        {n: F.col(n) for n in ("account_id", "revenue_month", "line_no")},
        [F.col("snapshot_date"), F.col("loaded_at")],
        {"yen": F.col("yen"), "messages": F.col("message_count")},
    )
    months = records.groupBy("account_id", month_no(F.col("revenue_month")).alias("period")).agg(F.count("*").alias("n"), F.sum("yen").cast("bigint").alias("yen"), F.sum("messages").alias("messages"))
    months = months.join(_listed(spark, d), "account_id", "left_semi")
    return trailing_totals(months, "account_id", "period", ["yen", "messages"], windows, rows="n")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Trailing 3 and 12 month totals and averages of every listed account and month."""
    out = _trailing_months(spark, d, [3, 12])
    return out.select("account_id", iso(month_from_no(F.col("period"))).alias("revenue_month"), F.col("n_rows").alias("n_records"), *[f"{m}_{a}_{w}" for m in ("yen", "messages") for a in ("total", "avg") for w in (3, 12)])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Silent months: rows of the trailing totals to which the month itself adds nothing.

    The totals over 3 and 12 months are worked out as in ``p1_rolling`` and held against the
    months' own contributions; a total that doesn't add up is an error.
    """
    windows = [1, 3, 12]
    out = borne_out(_trailing_months(spark, d, windows), "account_id", "period", ["yen", "messages"], windows)
    return out.where(F.col("n_rows") == 0).select("account_id", iso(month_from_no(F.col("period"))).alias("revenue_month"))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "account_master").where(F.col("as_of_date").isNotNull()).select(account_key(F.col("account_id")).alias("account_id")).distinct()


def p2_history(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d).select("account_id", "plan_type", "status", iso(F.col("valid_from")).alias("valid_from"), iso(F.col("valid_to")).alias("valid_to"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d).select("account_id", iso(F.col("valid_from")).alias("valid_from"), iso(F.col("valid_to")).alias("valid_to"))


def _months_with_plan(spark: SparkSession, d: str) -> DataFrame:
    """Account-months with the plan_type known on the first of the month, and the newest one beside it.

    Rows are first added up to account-months, so the account that holds a tenth of them has no more events than others.
    """
    months = revenue_rows(spark, d).where(F.col("revenue_month").isNotNull()).groupBy("account_id", "revenue_month").agg(F.count("*").alias("n_rows"))
    versions = history(spark, d)
    # a version's plan and the newest plan of its account travel together
    newest = F.max(F.when(F.col("newest"), F.struct("plan_type"))).over(Window.partitionBy("account_id"))
    versions = versions.select("account_id", "valid_from", "valid_to", "plan_type", newest.alias("newest"), F.lit(True).alias("known"))
    return as_known(months, versions, "account_id", "revenue_month", "valid_from", ["plan_type", "newest", "known"], valid_to="valid_to", keep=["n_rows"], bounded=True, rows=_n_rows(spark, d))  # a row a month at most


def p2_merged(spark: SparkSession, d: str) -> DataFrame:
    """The same history by one merge step: what was stored before the newest snapshot, and that snapshot."""
    snaps = table(spark, d, "account_master").where(F.col("as_of_date").isNotNull())
    newest = snaps.where(account_key(F.col("account_id")).isNotNull()).agg(F.max("as_of_date")).first()[0] or date(1970, 1, 1)
    stored = cut(versions_of(snaps.where(F.col("as_of_date") < F.lit(newest))), "history")
    attributes = {"plan_type": word(F.col("plan_type")), "status": word(F.col("status"))}
    arrived = keep_last(snaps.where((F.col("as_of_date") == F.lit(newest)) & account_key(F.col("account_id")).isNotNull()), {"key": account_key(F.col("account_id"))}, [F.col("loaded_at")], attributes)
    after = merge_snapshot(stored.withColumnRenamed("account_id", "key"), arrived, F.lit(newest), list(attributes), ("plan_type",))
    return after.select(F.col("key").alias("account_id"), "plan_type", "status", iso(F.col("valid_from")).alias("valid_from"), iso(F.col("valid_to")).alias("valid_to"))


def _n_rows(spark: SparkSession, d: str) -> int:
    """Rows of both tables, from their files' footers."""
    return table(spark, d, "revenue_monthly").count() + table(spark, d, "account_master").count()


def p3_asof(spark: SparkSession, d: str) -> DataFrame:
    return _months_with_plan(spark, d).select("account_id", iso(F.col("revenue_month")).alias("revenue_month"), "n_rows", "plan_type", iso(F.col("known_from")).alias("known_from"))


def p3_recorded(spark: SparkSession, d: str) -> DataFrame:
    """Every row of revenue_monthly with the plan_type stated and loaded by the time the row itself was loaded.

    A snapshot's row counts from the later of as_of_date and its loaded_at; a correction loaded after
    the event is not seen. Rows are taken one by one, so the account with the most of them is salted.
    """
    events = revenue_rows(spark, d).where(F.col("loaded_at").isNotNull()).select(*_KEY, "loaded_at").distinct()
    stated = table(spark, d, "account_master").where(F.col("account_id").isNotNull())
    stated = keep_last(stated, {"account_id": account_key(F.col("account_id")), "as_of_date": F.col("as_of_date"), "recorded": F.col("loaded_at")}, [word(F.col("plan_type"))], {"plan_type": word(F.col("plan_type"))})
    seen = as_known(events, stated, "account_id", "loaded_at", "as_of_date", ["plan_type"], recorded="recorded", keep=["revenue_month", "line_no", "snapshot_date"], rows=_n_rows(spark, d))
    instant = F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss")
    return seen.select("account_id", iso(F.col("revenue_month")).alias("revenue_month"), "line_no", iso(F.col("snapshot_date")).alias("snapshot_date"), instant.alias("loaded_at"), "plan_type", iso(F.col("known_from")).alias("known_from"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _months_with_plan(spark, d).where(F.col("known") & ~F.col("plan_type").eqNullSafe(F.col("newest.plan_type")))
    return rows.select("account_id", iso(F.col("revenue_month")).alias("revenue_month"), "plan_type")


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Every arrival of every record in yen, with its lag, what it adds to its record's total, and its outcome."""
    rows = _yen_rows(spark, d, {**_key(), "loaded_at": F.col("loaded_at")})
    rows = rows.select(
        F.struct("account_id", "revenue_month", "line_no").alias("record"),
        month_no(F.col("revenue_month")).alias("event_no"),
        month_no(F.col("snapshot_date")).alias("arrival_no"),
        F.col("snapshot_date").alias("arrival"),
        F.col("loaded_at").alias("loaded"),
        F.col("yen").cast("bigint").alias("amount"),
    )
    return late.classify_arrivals(rows, on_time=1, cutoff=COVERING)


def p4_triangle(spark: SparkSession, d: str) -> DataFrame:
    """Every revision of every month's total, corrected up to the third covering delivery."""
    out = late.revision_triangle(_arrivals(spark, d), cutoff=COVERING, full_deliveries=True)
    return out.select(iso(month_from_no(F.col("event_no"))).alias("revenue_month"), F.col("lag").cast("bigint").alias("delivery"), "n_new", "n_restated", "n_returned", "n_withdrawn", F.col("delta").cast("bigint").alias("delta_yen"), F.col("total").cast("bigint").alias("total_yen"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Late records by outcome, from the records' own triangles of amounts.

    An accepted arrival must leave its record's total at the amount it states, a rejected one must
    leave it untouched; a total that doesn't add up is an error.
    """
    seen = _arrivals(spark, d).where(F.col("outcome").isin("accepted", "rejected"))
    adds_up = F.assert_true((F.col("outcome") == "rejected") | (F.col("revised") == F.coalesce("amount", F.lit(0))), F.lit("revisions of a record do not add up")).isNull()
    return seen.where(adds_up).select(F.col("record.account_id").alias("account_id"), iso(F.col("record.revenue_month")).alias("revenue_month"), F.col("record.line_no").alias("line_no"), iso(F.col("arrival")).alias("snapshot_date"), "outcome")


def _deliveries(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """The calendar of deliveries and the number of their rows; only dates and whether an account is named are read."""
    rows = table(spark, d, "revenue_monthly").where(F.trim("account_id") != "")
    return snapshot_calendar(rows.select("snapshot_date"), "snapshot_date")


def _series(spark: SparkSession, d: str) -> DataFrame:
    """Every record of revenue_monthly with its deliveries, and the next delivery that has to repeat it."""
    rows = revenue_rows(spark, d).select(*_KEY).where(F.col("snapshot_date").isNotNull())
    calendar = _deliveries(spark, d)[0].select(F.col("snap_date").alias("snapshot_date"), "next_date")
    due = F.when((month_no(F.col("next_date")) - month_no(F.col("revenue_month"))).between(1, COVERING), F.col("next_date"))
    return orphans.record_series(rows.join(calendar, "snapshot_date").withColumn("due", due), "account_id", ["revenue_month", "line_no"], "snapshot_date", "due")


def _existence(spark: SparkSession, d: str) -> DataFrame:
    return orphans.existence_deltas(history(spark, d), "account_id", "valid_from", "valid_to")


def _orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    series = cut(_series(spark, d), "record-series")  # rows and deltas both come out of it
    gone = orphans.orphan_instants(orphans.reference_deltas(series), _existence(spark, d)).select("key", F.col("at").alias("snapshot_date"), "reason")
    rows = series.select("key", "revenue_month", "line_no", F.explode("seen.at").alias("snapshot_date"))
    # rows of one account and delivery may be very many: they meet their instant under several keys
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("revenue_month", "line_no"), F.lit(SALTS)).cast("int"))
    gone = gone.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(gone, ["key", "snapshot_date", "salt"]).drop("salt").withColumnRenamed("key", "account_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphan_rows(spark, d).select("account_id", iso(F.col("revenue_month")).alias("revenue_month"), "line_no", iso(F.col("snapshot_date")).alias("snapshot_date"), "reason")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan rows per table, month and reason."""
    return _orphan_rows(spark, d).groupBy(F.lit("revenue_monthly").alias("table_name"), iso(F.col("revenue_month")).alias("revenue_month"), "reason").agg(F.count("*").alias("n_rows"))


def p5_current(spark: SparkSession, d: str) -> DataFrame:
    """Accounts that records still refer to and that the newest snapshot doesn't list.

    The counts up to the delivery before the newest are stored, as an earlier run would have left
    them; the deltas since then are added.
    """
    references, existence = orphans.reference_deltas(_series(spark, d)), _existence(spark, d)
    newest = table(spark, d, "revenue_monthly").agg(F.max("snapshot_date")).first()[0] or date(1970, 1, 1)
    before, since = F.col("at") < F.lit(newest), F.col("at") >= F.lit(newest)
    stored = cut(orphans.add_deltas(None, references.where(before), existence.where(before)), "orphan-counts")
    counts = orphans.add_deltas(stored, references.where(since), existence.where(since))
    return orphans.current_orphans(counts).select(F.col("key").alias("account_id"), "n_references", "reason")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    calendar, n_rows = _deliveries(spark, d)
    record = {n: F.col(n) for n in ("account_id", "revenue_month", "line_no")}
    buckets = max(1, math.ceil(n_rows / ROWS_PER_BUCKET))
    rows = _yen_rows(spark, d, {**_key(), "loaded_at": F.col("loaded_at"), "is_finalized": F.col("is_finalized")}).where(F.col("snapshot_date").isNotNull() & F.col("revenue_month").isNotNull())
    # by bucket from the start: resent rows are dropped and tables built where the rows then lie
    rows = rows.withColumn("bucket", bucket_of(record, buckets)).repartition("bucket")
    rows = keep_last(rows, {"bucket": F.col("bucket"), **_key()}, [F.col("loaded_at")], {"yen": F.col("yen"), "is_finalized": F.col("is_finalized")})
    # the calendar has a row a delivery; its neighbours tell which months both cover in full
    days = calendar.select("snap_date", "snap_no", "next_date").withColumn("prev_date", F.lag("snap_date").over(Window.partitionBy(F.lit(0)).orderBy("snap_no")))
    rows = rows.join(days, rows["snapshot_date"] == days["snap_date"])
    covers = lambda delivery: (month_no(delivery) - month_no(F.col("revenue_month"))).between(1, COVERING)
    here = covers(F.col("snapshot_date"))
    side = lambda no, sign: F.struct(no.cast("int").alias("pair"), F.lit(sign).alias("sign"))
    pairs = F.filter(
        F.array(
            F.when(here & F.coalesce(covers(F.col("prev_date")), F.lit(False)), side(F.col("snap_no"), 1)),
            F.when(here & F.coalesce(covers(F.col("next_date")), F.lit(False)), side(F.col("snap_no") + 1, -1)),
        ),
        lambda x: x.isNotNull(),
    )
    out = diff_pairs(rows, record, {"yen": F.col("yen"), "is_finalized": F.col("is_finalized")}, pairs, buckets, bucket="bucket")
    return out.join(calendar, out["pair"] == calendar["snap_no"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).select("account_id", iso(F.col("revenue_month")).alias("revenue_month"), "line_no", iso(F.col("snap_date")).alias("snapshot_date"), "change_type")


def p7_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Whole-yen totals and rows of each unit and month."""
    rows = keep_last(_yen_rows(spark, d, {**_key(), "loaded_at": F.col("loaded_at")}), _key(), [F.col("loaded_at")], {"unit": F.col("unit"), "yen": F.col("yen")})
    return rows.groupBy(iso(F.col("revenue_month")).alias("revenue_month"), "unit").agg(F.count("*").alias("n_rows"), F.sum("yen").cast("bigint").alias("yen"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = keep_last(_yen_rows(spark, d, {**_key(), "loaded_at": F.col("loaded_at")}), _key(), [F.col("loaded_at")], {"unit": F.col("unit")})
    return rows.where(F.col("unit") != "JPY").select("account_id", iso(F.col("revenue_month")).alias("revenue_month"), "line_no", iso(F.col("snapshot_date")).alias("snapshot_date"), "unit")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_rolling": p1_report, "p1_found": p1_found, "p2_history": p2_history, "p2_found": p2_found, "p2_merged": p2_merged, "p3_asof": p3_asof, "p3_found": p3_found, "p3_recorded": p3_recorded, "p4_triangle": p4_triangle, "p4_found": p4_found,
    "p5_report": p5_report, "p5_found": p5_found, "p5_current": p5_current, "p6_found": p6_found, "p7_amounts": p7_amounts, "p7_found": p7_found,
}

_ROW = f"account_id, {day('revenue_month')} AS revenue_month, line_no, {day('snapshot_date')} AS snapshot_date"

_SPINE = """mon AS (
  SELECT account_id, revenue_month, count(*) AS n, coalesce(sum(yen), 0) AS yen, coalesce(sum(message_count), 0) AS messages FROM (
    SELECT * FROM rev QUALIFY row_number() OVER (PARTITION BY account_id, revenue_month, line_no ORDER BY snapshot_date DESC) = 1)
  WHERE account_id IN (SELECT account_id FROM versions) GROUP BY 1, 2),
spine AS (
  SELECT account_id, CAST(unnest(generate_series(min(revenue_month), max(revenue_month), INTERVAL 1 MONTH)) AS DATE) AS revenue_month FROM mon GROUP BY 1),
dense AS (
  SELECT s.account_id, s.revenue_month, coalesce(n, 0) AS n, coalesce(yen, 0) AS yen, coalesce(messages, 0) AS messages
  FROM spine s LEFT JOIN mon m ON s.account_id = m.account_id AND s.revenue_month = m.revenue_month)"""


def _trailing(m: str, w: int) -> str:
    over = f"OVER (PARTITION BY account_id ORDER BY revenue_month ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CAST(sum({m}) {over} AS BIGINT) AS {m}_total_{w}, CAST(sum({m}) {over} AS DOUBLE) / count(*) {over} AS {m}_avg_{w}"


_CHANGES = """days AS (
  SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) AS no, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS prev_date FROM (SELECT DISTINCT snapshot_date FROM rev)),
full_rows AS (SELECT rev.*, no, prev_date FROM rev JOIN days USING (snapshot_date) WHERE lag BETWEEN 1 AND 3),
olds AS (
  SELECT a.account_id, a.revenue_month, a.line_no, d.snapshot_date, a.yen, a.is_finalized FROM full_rows a JOIN days d ON d.no = a.no + 1
  WHERE (year(d.snapshot_date) * 12 + month(d.snapshot_date)) - (year(a.revenue_month) * 12 + month(a.revenue_month)) BETWEEN 1 AND 3),
news AS (
  SELECT account_id, revenue_month, line_no, snapshot_date, yen, is_finalized FROM full_rows
  WHERE (year(prev_date) * 12 + month(prev_date)) - (year(revenue_month) * 12 + month(revenue_month)) BETWEEN 1 AND 3)"""

ORACLE: dict[str, str] = {
    "p1_rolling": f"WITH {REVENUE}, {VERSIONS}, {_SPINE} SELECT account_id, {day('revenue_month')} AS revenue_month, CAST(n AS BIGINT) AS n_records, {_trailing('yen', 3)}, {_trailing('yen', 12)}, {_trailing('messages', 3)}, {_trailing('messages', 12)} FROM dense",
    "p1_found": f"WITH {REVENUE}, {VERSIONS}, {_SPINE} SELECT account_id, {day('revenue_month')} AS revenue_month FROM dense WHERE n = 0",
    "p2_history": f"WITH {VERSIONS} SELECT account_id, plan_type, status, {day('valid_from')} AS valid_from, {day('valid_to')} AS valid_to FROM versions",
    "p2_merged": f"WITH {VERSIONS} SELECT account_id, plan_type, status, {day('valid_from')} AS valid_from, {day('valid_to')} AS valid_to FROM versions",
    "p2_found": f"WITH {VERSIONS} SELECT account_id, {day('valid_from')} AS valid_from, {day('valid_to')} AS valid_to FROM versions",
    "p3_asof": f"WITH {REVENUE}, {VERSIONS}, m AS (SELECT account_id, CAST(date_trunc('month', revenue_month) AS DATE) AS revenue_month, count(*) AS n_rows FROM rev0 GROUP BY 1, 2) SELECT m.account_id, {day('m.revenue_month')} AS revenue_month, n_rows, plan_type, {day('valid_from')} AS known_from FROM m LEFT JOIN versions v ON m.account_id = v.account_id AND m.revenue_month >= valid_from AND m.revenue_month < valid_to",
    "p3_found": f"WITH {REVENUE}, {VERSIONS}, m AS (SELECT DISTINCT account_id, revenue_month FROM rev) SELECT m.account_id, {day('m.revenue_month')} AS revenue_month, v.plan_type FROM m JOIN versions v ON m.account_id = v.account_id AND m.revenue_month >= v.valid_from AND m.revenue_month < v.valid_to JOIN versions z ON z.account_id = m.account_id AND z.newest WHERE v.plan_type IS DISTINCT FROM z.plan_type",
    "p3_recorded": f"""WITH {REVENUE}, {VERSIONS}, e AS (SELECT DISTINCT account_id, revenue_month, line_no, snapshot_date, loaded_at FROM rev0 WHERE loaded_at IS NOT NULL),
      j AS (SELECT e.*, a.plan_type, a.as_of_date FROM e LEFT JOIN acc0 a ON a.account_id = e.account_id AND a.as_of_date <= e.loaded_at AND a.loaded_at <= e.loaded_at
            QUALIFY row_number() OVER (PARTITION BY e.account_id, e.revenue_month, e.line_no, e.snapshot_date, e.loaded_at ORDER BY a.as_of_date DESC NULLS LAST, a.loaded_at DESC NULLS LAST, a.plan_type DESC NULLS LAST) = 1)
      SELECT {_ROW}, strftime(loaded_at, '%Y-%m-%d %H:%M:%S') AS loaded_at, plan_type, {day('as_of_date')} AS known_from FROM j""",
    "p4_triangle": f"""WITH {REVENUE}, k AS (SELECT account_id, revenue_month, line_no, lag, coalesce(yen, 0) AS yen FROM rev WHERE lag BETWEEN 1 AND 3),
      dl AS (SELECT DISTINCT revenue_month, lag FROM k),
      base AS (SELECT DISTINCT account_id, revenue_month, line_no FROM k),
      g AS (SELECT b.*, dl.lag, k.yen, k.lag IS NOT NULL AS here,
              lag(k.yen) OVER w AS before, coalesce(lag(k.lag) OVER w IS NOT NULL, false) AS was_here,
              coalesce(count(k.lag) OVER (PARTITION BY b.account_id, b.revenue_month, b.line_no ORDER BY dl.lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS ever
            FROM base b JOIN dl ON b.revenue_month = dl.revenue_month LEFT JOIN k ON k.account_id = b.account_id AND k.revenue_month = b.revenue_month AND k.line_no = b.line_no AND k.lag = dl.lag
            WINDOW w AS (PARTITION BY b.account_id, b.revenue_month, b.line_no ORDER BY dl.lag))
      SELECT {day('revenue_month')} AS revenue_month, lag AS delivery, count(*) FILTER (here AND NOT ever) AS n_new, count(*) FILTER (here AND was_here AND yen <> before) AS n_restated,
        count(*) FILTER (here AND ever AND NOT was_here) AS n_returned, count(*) FILTER (NOT here AND was_here) AS n_withdrawn,
        CAST(sum(coalesce(yen, 0) - coalesce(before, 0)) AS BIGINT) AS delta_yen, CAST(sum(coalesce(yen, 0)) AS BIGINT) AS total_yen
      FROM g GROUP BY revenue_month, lag""",
    "p4_found": f"WITH {REVENUE}, f AS (SELECT *, min(snapshot_date) OVER (PARTITION BY account_id, revenue_month, line_no) AS first FROM rev) SELECT {_ROW}, CASE WHEN lag > 3 THEN 'rejected' ELSE 'accepted' END AS outcome FROM f WHERE lag > 3 OR (snapshot_date = first AND lag IN (2, 3))",
    "p5_report": f"WITH {REVENUE}, {VERSIONS}, o AS (SELECT rev.*, CASE WHEN (SELECT count(*) FROM versions v WHERE v.account_id = rev.account_id) = 0 THEN 'missing' WHEN (SELECT min(valid_from) FROM versions v WHERE v.account_id = rev.account_id) > snapshot_date THEN 'later' ELSE 'gone' END AS reason FROM rev WHERE NOT EXISTS (SELECT 1 FROM versions v WHERE v.account_id = rev.account_id AND v.valid_from <= rev.snapshot_date AND v.valid_to > rev.snapshot_date)) SELECT 'revenue_monthly' AS table_name, {day('revenue_month')} AS revenue_month, reason, count(*) AS n_rows FROM o GROUP BY ALL",
    "p5_found": f"WITH {REVENUE}, {VERSIONS} SELECT {_ROW}, CASE WHEN (SELECT count(*) FROM versions v WHERE v.account_id = rev.account_id) = 0 THEN 'missing' WHEN (SELECT min(valid_from) FROM versions v WHERE v.account_id = rev.account_id) > snapshot_date THEN 'later' ELSE 'gone' END AS reason FROM rev WHERE NOT EXISTS (SELECT 1 FROM versions v WHERE v.account_id = rev.account_id AND v.valid_from <= rev.snapshot_date AND v.valid_to > rev.snapshot_date)",
    "p5_current": f"""WITH {REVENUE}, {VERSIONS}, days AS (SELECT snapshot_date, lead(snapshot_date) OVER (ORDER BY snapshot_date) AS next_date FROM (SELECT DISTINCT snapshot_date FROM rev WHERE snapshot_date IS NOT NULL)),
      last AS (SELECT account_id, revenue_month, line_no, max(snapshot_date) AS snapshot_date FROM rev GROUP BY ALL),
      alive AS (SELECT account_id FROM last JOIN days USING (snapshot_date) WHERE NOT coalesce((year(next_date) * 12 + month(next_date)) - (year(revenue_month) * 12 + month(revenue_month)) BETWEEN 1 AND 3, false))
      SELECT account_id, count(*) AS n_references, CASE WHEN account_id IN (SELECT account_id FROM versions) THEN 'gone' ELSE 'missing' END AS reason FROM alive WHERE account_id NOT IN (SELECT account_id FROM versions WHERE valid_to = DATE '9999-12-31') GROUP BY ALL""",
    "p6_found": f"WITH {REVENUE}, {_CHANGES}, j AS (SELECT coalesce(o.account_id, n.account_id) AS account_id, coalesce(o.revenue_month, n.revenue_month) AS revenue_month, coalesce(o.line_no, n.line_no) AS line_no, coalesce(o.snapshot_date, n.snapshot_date) AS snapshot_date, CASE WHEN o.account_id IS NULL THEN 'added' WHEN n.account_id IS NULL THEN 'removed' WHEN o.yen IS DISTINCT FROM n.yen OR o.is_finalized IS DISTINCT FROM n.is_finalized THEN 'changed' END AS change_type FROM olds o FULL JOIN news n ON o.account_id = n.account_id AND o.revenue_month = n.revenue_month AND o.line_no = n.line_no AND o.snapshot_date = n.snapshot_date) SELECT {_ROW}, change_type FROM j WHERE change_type IS NOT NULL",
    "p7_amounts": f"WITH {REVENUE} SELECT {day('revenue_month')} AS revenue_month, unit, count(*) AS n_rows, CAST(sum(yen) AS BIGINT) AS yen FROM rev GROUP BY 1, 2",
    "p7_found": f"WITH {REVENUE} SELECT {_ROW}, unit FROM rev WHERE unit <> 'JPY'",
}
