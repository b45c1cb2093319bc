"""Late and out-of-order events: an event-period by arrival-period triangle, in SQL only.

A record may arrive several times, each arrival restating it. The lag of an arrival is the
number of periods from the event's period to the arrival's. What an arrival adds to what was
known of its record before is a delta; deltas are added up by (event period, lag), the cells of
the triangle, and summed over the lags by a window, which gives every corrected revision of a
period's total. Arrivals beyond the cut-off never reach a cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

_CLASSIFIED = """
WITH cells AS (  -- the finest triangle: one record's arrivals by period; of equal ones the one loaded last
  SELECT record, event_no, arrival, arrival_no - event_no AS lag, max(struct(loaded, amount)).amount AS amount
  FROM (SELECT /*+ REPARTITION(record) */ * FROM {arrivals})  -- a record's few arrivals lie together from here on
  WHERE record IS NOT NULL AND event_no IS NOT NULL AND arrival IS NOT NULL AND arrival_no IS NOT NULL
  GROUP BY record, event_no, arrival, arrival_no
),
steps AS (
  SELECT *, coalesce(amount, 0) - coalesce(lag(amount) OVER w, 0) AS delta, count(*) OVER w - 1 AS n_before
  FROM cells WINDOW w AS (PARTITION BY record ORDER BY arrival)
)
SELECT record, event_no, arrival, amount, lag, delta,
       sum(CASE WHEN lag <= {cutoff} THEN delta END) OVER (PARTITION BY record ORDER BY arrival) AS revised,
       CASE WHEN lag > {cutoff} THEN 'rejected'
            WHEN n_before > 0 THEN 'restated'
            WHEN lag > {on_time} THEN 'accepted'
            ELSE 'on_time' END AS outcome
FROM steps
"""

_TRIANGLE = """
WITH known AS (  -- the last word on a record in one arrival period
  SELECT record, event_no, lag, max(struct(arrival, amount)).amount AS amount
  FROM {classified} WHERE outcome <> 'rejected'
  GROUP BY record, event_no, lag
),
steps AS (
  SELECT event_no, lag, coalesce(amount, 0) AS amount,
         lag(coalesce(amount, 0)) OVER w AS amount_before, lag(lag) OVER w AS lag_before, lead(lag) OVER w AS lag_after
  FROM known WINDOW w AS (PARTITION BY record, event_no ORDER BY lag)
),
deltas AS (
  SELECT event_no, inline(filter(array(
    named_struct('lag', lag,
      'kind', CASE WHEN lag_before IS NULL THEN 'new' WHEN {full} AND lag_before < lag - 1 THEN 'returned' ELSE 'restated' END,
      'delta', CASE WHEN lag_before IS NULL OR ({full} AND lag_before < lag - 1) THEN amount ELSE amount - amount_before END),
    named_struct('lag', lag + 1, 'kind', 'withdrawn', 'delta', -amount)),
    d -> d.kind <> 'withdrawn' OR ({full} AND d.lag <= {cutoff} AND coalesce(lag_after, d.lag + 1) > d.lag))) AS (lag, kind, delta)
  FROM steps
),
cells AS (
  SELECT event_no, lag, sum(delta) AS delta,
         count_if(kind = 'new') AS n_new, count_if(kind = 'restated' AND delta <> 0) AS n_restated,
         count_if(kind = 'returned') AS n_returned, count_if(kind = 'withdrawn') AS n_withdrawn
  FROM deltas GROUP BY event_no, lag
  HAVING count_if(kind <> 'withdrawn') > 0  -- a period that was not delivered withdraws nothing
)
SELECT event_no, lag, n_new, n_restated, n_returned, n_withdrawn, delta,
       sum(delta) OVER (PARTITION BY event_no ORDER BY lag) AS total
FROM cells
"""


def classify_arrivals(arrivals: DataFrame, on_time: int, cutoff: int) -> DataFrame:
    """Every arrival with its lag, what it adds and its outcome: (record, event_no, arrival, amount, lag, delta, revised, outcome).

    ``arrivals`` has (record, event_no, arrival_no, arrival, loaded, amount): period numbers are
    integers, ``arrival`` is the instant they come from. Each record has its own small triangle:
    cells by arrival, their deltas, and ``revised``, the record's amount cumulated over the
    arrivals within the cut-off. ``rejected`` came with a lag beyond ``cutoff``; of the rest a
    record's first arrival is ``on_time`` up to lag ``on_time`` and ``accepted`` (late) beyond
    it, and later ones are ``restated``. Rows with a null record or period take part nowhere; a
    null amount counts as none but its row arrives. Of rows that repeat an arrival of a record
    the one loaded last counts (ties by the greatest amount), so each arrival comes out once.
    """
    return arrivals.sparkSession.sql(_CLASSIFIED, arrivals=arrivals, on_time=int(on_time), cutoff=int(cutoff))


def revision_triangle(classified: DataFrame, cutoff: int, full_deliveries: bool) -> DataFrame:
    """Every revision of every period's total: (event_no, lag, n_new, n_restated, n_returned, n_withdrawn, delta, total).

    With ``full_deliveries`` an arrival period brings all records of the event period again, so
    that a record missing from the next delivered one is withdrawn from it (and may return);
    otherwise what arrived once stays. Several arrivals in one arrival period count by the last. Periods without accepted arrivals have no row.
    """
    return classified.sparkSession.sql(_TRIANGLE, classified=classified, cutoff=int(cutoff), full=bool(full_deliveries))
