"""Column expressions that bring dirty spellings into normal form. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width forms U+FF01-U+FF5E stand 0xFEE0 above their ASCII twins; U+3000 is the wide blank.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "

#: Blanks of any kind: white space, non-breaking and wide ones, and those of no width.
_BLANKS = " \t\n\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200E)) + "\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"


def strip_blanks(c: Column) -> Column:
    """Drop blanks around a text; null stays null."""
    return F.btrim(c, F.lit(_BLANKS))


def narrow(c: Column) -> Column:
    """Full-width letters, digits, signs and blanks as their ASCII twins."""
    return F.translate(c, _WIDE, _NARROW)


def word(c: Column) -> Column:
    """A code word without regard to case, blanks around it or width; blank counts as null."""
    return F.nullif(F.lower(strip_blanks(narrow(c))), F.lit(""))


def account_key(c: Column) -> Column:
    """An account id in normal form (`U` and lower-case hex digits); blank counts as null."""
    t = strip_blanks(c)
    return F.nullif(F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2)))), F.lit(""))


def month_start(c: Column) -> Column:
    """First day of the month that any day of it stands for."""
    return F.trunc(c, "month")


def month_no(c: Column) -> Column:
    """Months since year 0, so that differences count calendar months."""
    return F.year(c) * F.lit(12) + F.month(c) - F.lit(1)


def month_from_no(n: Column) -> Column:
    """The inverse of :func:`month_no`."""
    return F.make_date(F.floor(n / F.lit(12)).cast("int"), (F.pmod(n, F.lit(12)) + F.lit(1)).cast("int"), F.lit(1))


def iso(c: Column) -> Column:
    """A date as `YYYY-MM-DD`."""
    return F.date_format(c, "yyyy-MM-dd")
