"""SQL building blocks for the reference results: the reading rules once more, for DuckDB."""

from __future__ import annotations

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = ("".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ").replace("'", "''")


def fold(c: str) -> str:
    """Lower case, narrow, without blanks around."""
    return f"lower(trim(translate({c}, '{_WIDE}', '{_NARROW}')))"


def account(c: str) -> str:
    return f"('U' || lower(substr(trim({c}), 2)))"


UNIT = """CASE
 WHEN r LIKE '%booked in yen%' THEN 'JPY'
 WHEN r LIKE '%単位:千円%' OR r LIKE '%thousands of yen%' OR r LIKE '%千円単位%' OR r LIKE '%thousand yen%' AND r NOT LIKE '%ten thousand yen%' OR r LIKE '%1 = 1,000 jpy%' THEN 'JPY_K'
 WHEN r LIKE '%万円単位%' OR r LIKE '%単位は万円%' OR r LIKE '%ten thousand yen%' THEN 'JPY_10K'
 WHEN r LIKE '%millions of yen%' OR r LIKE '%単位:百万円%' OR r LIKE '%値は百万円%' THEN 'JPY_M'
 WHEN r LIKE '%amounts in cents%' OR r LIKE '%セント単位%' OR r LIKE '%unit: cent%' OR r LIKE '%minor units (1/100 dollar)%' THEN 'USD_CENT'
 WHEN r LIKE '%ドル建て%' OR r LIKE '%amount is in us dollars%' OR r LIKE '%value is usd%' THEN 'USD'
 WHEN c IN ('千円', 'jpy (000)', 'jpy thousand', 'kjpy', 'jpy x1000') THEN 'JPY_K'
 WHEN c IN ('万円', 'jpy 10,000s', '10k jpy') THEN 'JPY_10K'
 WHEN c IN ('百万円', 'million yen', 'jpy mn') THEN 'JPY_M'
 WHEN c IN ('usd cents', 'us cents', '¢', 'usd/100') THEN 'USD_CENT'
 WHEN c IN ('usd', '米ドル', 'us$', '$', 'u.s. dollars') THEN 'USD'
 ELSE 'JPY' END"""

#: The last loaded row of each (account, month, line, delivery), with its unit and whole yen.
REVENUE = f"""rev0 AS (
  SELECT {account('account_id')} AS account_id, CAST(date_trunc('month', revenue_month) AS DATE) AS revenue_month, line_no, snapshot_date,
         revenue_amount, message_count, is_finalized, loaded_at, {fold("coalesce(currency, '')")} AS c, {fold("coalesce(remark, '')")} AS r
  FROM revenue_monthly WHERE account_id IS NOT NULL),
rev1 AS (
  SELECT *, {UNIT} AS unit FROM rev0
  QUALIFY row_number() OVER (PARTITION BY account_id, revenue_month, line_no, snapshot_date ORDER BY loaded_at DESC NULLS LAST, revenue_amount DESC NULLS LAST, message_count DESC NULLS LAST) = 1),
rev AS (
  SELECT v.*, (year(snapshot_date) * 12 + month(snapshot_date)) - (year(revenue_month) * 12 + month(revenue_month)) AS lag,
         CAST(round(CAST(revenue_amount AS DECIMAL(19, 0)) * CAST(
           CASE unit WHEN 'JPY' THEN 1 WHEN 'JPY_K' THEN 1000 WHEN 'JPY_10K' THEN 10000 WHEN 'JPY_M' THEN 1000000 WHEN 'USD' THEN 1 ELSE 0.01 END
           * CASE WHEN unit LIKE 'USD%' THEN jpy_per_unit ELSE 1 END AS DECIMAL(18, 6)), 0) AS BIGINT) AS yen
  FROM rev1 v LEFT JOIN fx_rate f ON f.currency = 'USD' AND f.rate_month = v.revenue_month)"""

#: Versions of plan_type and status.
VERSIONS = f"""acc0 AS (
  SELECT {account('account_id')} AS account_id, as_of_date, nullif({fold('plan_type')}, '') AS plan_type, nullif({fold('status')}, '') AS status, loaded_at
  FROM account_master WHERE account_id IS NOT NULL),
acc AS (
  SELECT * FROM acc0
  QUALIFY row_number() OVER (PARTITION BY account_id, as_of_date ORDER BY loaded_at DESC NULLS LAST, plan_type DESC NULLS LAST, status DESC NULLS LAST) = 1),
cal AS (
  SELECT as_of_date, row_number() OVER (ORDER BY as_of_date) AS no, lead(as_of_date) OVER (ORDER BY as_of_date) AS next_date
  FROM (SELECT DISTINCT as_of_date FROM acc)),
pres AS (
  SELECT acc.*, no, next_date, no - row_number() OVER (PARTITION BY account_id ORDER BY no) AS island FROM acc JOIN cal USING (as_of_date)),
fill AS (
  SELECT * REPLACE (last_value(plan_type IGNORE NULLS) OVER (PARTITION BY account_id, island ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS plan_type) FROM pres),
marks AS (
  SELECT *, CASE WHEN lag(island) OVER w IS NOT DISTINCT FROM island AND lag(plan_type) OVER w IS NOT DISTINCT FROM plan_type
                  AND lag(status) OVER w IS NOT DISTINCT FROM status AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS starts
  FROM fill WINDOW w AS (PARTITION BY account_id ORDER BY no)),
runs AS (
  SELECT *, sum(starts) OVER (PARTITION BY account_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS version FROM marks),
versions AS (
  SELECT account_id, version, any_value(plan_type) AS plan_type, any_value(status) AS status, min(as_of_date) AS valid_from,
         coalesce(max_by(coalesce(next_date, DATE '9999-12-31'), no), DATE '9999-12-31') AS valid_to,
         version = max(version) OVER (PARTITION BY account_id) AS newest
  FROM runs GROUP BY account_id, version)"""


def day(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"
