"""Worksheets of two reviewers: validation, cases, agreement counts, corrections, effort."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.normalize import word
from tallyforge.operators.dedupe import keep_last
from tallyforge.plans.semantic import Scope
from tallyforge.session import ship

# The closed vocabularies of labels, statuses and root causes.
LABELS = ("direct_equivalent", "cross_grain_equivalent", "temporal_or_scope_variant", "conflicting_definition", "related", "non_match")
STATUSES = ("sufficient", "needs_review")
ROOT_CAUSES = ("rubric_wording", "missed_evidence", "scope", "value_interpretation", "judgment", "other")


@F.pandas_udf(T.StringType())
def _declared(texts: pd.Series) -> pd.Series:
    def read(text: str | None) -> str | None:
        try:
            scope = Scope.parse(text or "")
        except ValueError:
            return None
        return f"metric_time__{scope.grain}" if scope.grain else "ungrouped total"

    return texts.map(read)


def scopes_in_use(rows: DataFrame, scope: str) -> DataFrame:
    """(scope, n, declared) of every spelling of a scope: what :meth:`Scope.parse` reads it as, null where it rejects it.

    Spellings are counted first, so each is read once.
    """
    ship(rows.sparkSession)
    return rows.groupBy(F.col(scope).alias("scope")).agg(F.count("*").alias("n")).withColumn("declared", _declared("scope"))


def scope_word(c: Column) -> Column:
    """A scope in its one spelling."""
    w = word(c)
    return F.when(w.isin("overall", "overall total"), "ungrouped total").otherwise(w)


def latest(worksheet: DataFrame) -> DataFrame:
    """The sheet as last received: one row a pair and reviewer, spellings normal. Earlier rows stay in the table untouched."""
    return keep_last(
        worksheet.where(F.col("pair").isNotNull() & F.col("reviewer").isNotNull()),
        {"pair": F.trim("pair"), "reviewer": F.col("reviewer")},
        [F.col("received_at")],
        {"compare_at": scope_word(F.col("compare_at")), "label": word(F.col("label")), "evidence_status": word(F.col("evidence_status")), "missing_evidence": F.nullif(F.trim("missing_evidence"), F.lit("")), "minutes": F.col("minutes").cast("bigint")},
    )


def correct(log: DataFrame, correction: DataFrame) -> DataFrame:
    """Append-only: a correction is added as rows of its own; what was sent is never edited."""
    return log.unionByName(correction, allowMissingColumns=True)


def violations(sheet: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, reviewer, problem) of every broken rule of a normalised sheet; a pair no one reviewed has a null reviewer."""
    rules = [
        ("unknown label", F.col("label").isNotNull() & ~F.col("label").isin(*LABELS)),
        ("unknown status", F.col("evidence_status").isNull() | ~F.col("evidence_status").isin(*STATUSES)),
        ("blank label not under review", F.col("label").isNull() & (F.col("evidence_status") == "sufficient")),
        ("review without missing evidence", (F.col("evidence_status") == "needs_review") & F.col("missing_evidence").isNull()),
        ("unknown pair", F.col("declared").isNull()),
        ("scope is not the declared one", F.col("declared").isNotNull() & ~F.col("compare_at").eqNullSafe(F.col("declared"))),
        ("minutes missing", F.col("minutes").isNull()),
    ]
    declared = pairs.select(F.trim("pair").alias("pair"), scope_word(F.col("compare_at")).alias("declared"))
    rows = sheet.join(declared, "pair", "left")
    problems = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in rules]), lambda x: x.isNotNull())
    found = rows.select("pair", "reviewer", F.explode(problems).alias("problem"))
    unseen = declared.join(sheet, "pair", "left_anti").select("pair", F.lit(None).cast("int").alias("reviewer"), F.lit("not reviewed").alias("problem"))
    return found.unionByName(unseen)


#: Cells of a worksheet row: the sheet's columns in order.
CELLS = ("pair", "compare_at", "label", "evidence_status", "supporting_lines", "queries", "missing_evidence", "conditions", "minutes")


def layout_violations(lines: DataFrame, packet: DataFrame) -> DataFrame:
    """(pair, reviewer, problem) of worksheet lines that are not laid out as the packet.

    ``lines`` has (reviewer, line_no, pair, cells): the place of each row in its reviewer's sheet and
    how many cells it has; ``packet`` has (pair, ordinal). A row without exactly nine cells and a
    row that stands after one of a later pair are named. Reviewers' sheets are apart; rows of
    pairs that the packet doesn't have are left to :func:`violations`.
    """
    placed = lines.join(packet.select("pair", "ordinal"), "pair", "left")
    before = Window.partitionBy("reviewer").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    late = placed.withColumn("reached", F.max("ordinal").over(before))
    rules = [("not nine cells", F.col("cells") != len(CELLS)), ("out of packet order", F.col("ordinal") < F.col("reached"))]
    problems = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in rules]), lambda x: x.isNotNull())
    return late.select("pair", "reviewer", F.explode(problems).alias("problem"))


def classify_cases(sheet: DataFrame) -> DataFrame:
    """(pair, label_1, status_1, label_2, status_2, case) of pairs that both reviewers sent.

    ``blank`` if a label is missing, else ``different``, ``evidence-only`` or ``agree``.
    """
    side = lambda n: sheet.where(F.col("reviewer") == n).select("pair", F.col("label").alias(f"label_{n}"), F.col("evidence_status").alias(f"status_{n}"))
    both = side(1).join(side(2), "pair")
    case = (
        F.when(F.col("label_1").isNull() | F.col("label_2").isNull(), "blank")
        .when(F.col("label_1") != F.col("label_2"), "different")
        .when(~F.col("status_1").eqNullSafe(F.col("status_2")), "evidence-only")
        .otherwise("agree")
    )
    return both.withColumn("case", case)


def summarize(cases: DataFrame) -> DataFrame:
    """(case, label, n): counts by case and, where both agree on it, by label."""
    label = F.when(F.col("label_1") == F.col("label_2"), F.col("label_1"))
    return cases.groupBy("case", label.alias("label")).agg(F.count("*").alias("n"))


def decision_record(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """The pairs in their fixed order with both reviews and the case; final columns are left blank for a person."""
    blank = [F.lit(None).cast("string").alias(c) for c in ("final_label", "final_evidence", "root_cause", "rationale")]
    return pairs.select("pair").join(cases, "pair", "left").select("pair", "label_1", "status_1", "label_2", "status_2", "case", *blank)


def root_cause_violations(record: DataFrame) -> DataFrame:
    """(pair, problem): disagreements without a known root cause, and causes where none belongs."""
    needs = F.col("case") == "different"
    bad = F.when(needs & (F.col("root_cause").isNull() | ~F.col("root_cause").isin(*ROOT_CAUSES)), "root cause missing or unknown").when(F.coalesce(~needs, F.lit(True)) & F.col("root_cause").isNotNull(), "root cause without disagreement")
    return record.select("pair", bad.alias("problem")).where(F.col("problem").isNotNull())


#: How a ruling names the cause of a disagreement.
CAUSE_SAID = r"(?i)root cause of the split is (\w+)"


def with_causes(record: DataFrame, said: DataFrame) -> DataFrame:
    """The record with the root cause that (pair, text) rulings name for each pair, lower case; of several the first in order."""
    causes = said.select(F.trim("pair").alias("pair"), F.lower(F.nullif(F.regexp_extract("text", CAUSE_SAID, 1), F.lit(""))).alias("said"))
    causes = causes.where(F.col("said").isNotNull()).groupBy("pair").agg(F.min("said").alias("said"))
    return record.join(causes, "pair", "left").withColumn("root_cause", F.col("said")).drop("said")


def effort(sheet: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """(reviewer, n_pairs, minutes, n_without_minutes), and with (reviewer, active_minutes) also those and whether they agree.

    ``mismatch`` is true where the minutes of the pairs don't add up to the declared active
    minutes or minutes are missing, null where a reviewer declared none.
    """
    out = sheet.groupBy("reviewer").agg(F.count("*").alias("n_pairs"), F.sum("minutes").alias("minutes"), F.count_if(F.col("minutes").isNull()).alias("n_without_minutes"))
    if active is None:
        return out
    off = (F.coalesce("minutes", F.lit(0)) != F.col("active_minutes")) | (F.col("n_without_minutes") > 0)
    return out.join(active.select("reviewer", "active_minutes"), "reviewer", "left").withColumn("mismatch", F.when(F.col("active_minutes").isNotNull(), off))


_NEUTRAL = (
    (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<e-mail>"),
    (r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?", "<date>"),
    (r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?\b", "<name>"),
    (r"(?i)\breviewer [A-Z0-9]+\b", "Reviewer"),
)


def redact(line: Column, names: tuple[str, ...] = ()) -> Column:
    """Neutral text in place of e-mail addresses, dates, names and reviewer codes; table rows (beginning with a pipe) untouched.

    Names are those with a title before them and the given ones, as whole words in any case.
    """
    out = line
    given = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
    for pattern, put in (*_NEUTRAL, *([(rf"(?i)(?<![A-Za-z0-9_])(?:{given})(?![A-Za-z0-9_])", "<name>")] if names else [])):
        out = F.regexp_replace(out, pattern, put)
    return F.when(F.ltrim(line).startswith("|"), line).otherwise(out)
