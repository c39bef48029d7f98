"""Column expressions with the reference's missing-value, rounding and
number-formatting rules.  All are built-in Spark expressions (JVM side,
whole-stage codegen); no Python UDF anywhere.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import MONEY_SUM


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- presence / filters -------------------------------------------------------

def present(c: str | Column) -> Column:
    """Non-missing and non-empty id: never NULL itself (FALSE for NULL input)."""
    c = _c(c)
    return c.isNotNull() & (c != F.lit(""))


def any_present(*cols: str | Column) -> Column:
    return reduce(lambda a, b: a | b, [present(c) for c in cols])


def year_at_least(date_col: str | Column, min_year: int) -> Column:
    """``year(d) >= y`` written as a date range, so Parquet can push it down."""
    return _c(date_col) >= F.make_date(F.lit(min_year), F.lit(1), F.lit(1))


# Partition column of tables laid out by close year (``sources.tables.write_opportunity``).
CLOSE_YEAR = "close_year"


def closed_since(df: DataFrame, date_col: str, min_year: int) -> Column:
    """Rows of ``df`` dated in ``min_year`` or later.

    Where ``df`` is laid out by close year the bound is on that column too, so
    that the folders of earlier years (and of rows without a date) are not even listed.
    """
    bound = year_at_least(date_col, min_year)
    return bound & (F.col(CLOSE_YEAR) >= F.lit(min_year)) if CLOSE_YEAR in df.columns else bound


def year_of(date_col: str | Column) -> Column:
    return F.year(_c(date_col)).cast("long")


# --- aggregates -----------------------------------------------------------------

def n_distinct(c: str | Column, approx: bool = False) -> Column:
    """Distinct count where a missing value counts as one more value.

    ``approx=True`` is the opt-in HyperLogLog++ estimate (one bounded sketch
    per group instead of an exact distinct aggregation).
    """
    c = _c(c)
    return ((F.approx_count_distinct(c) if approx else F.count_distinct(c))
            + F.coalesce(F.max(F.when(c.isNull(), F.lit(1)).otherwise(F.lit(0))), F.lit(0))
            ).cast("long")


def sum0(c: str | Column) -> Column:
    """Sum that is 0 (not NULL) when every input is missing; money stays exact."""
    return F.coalesce(F.sum(_c(c)), F.lit(0)).cast(MONEY_SUM)


def n() -> Column:
    return F.count(F.lit(1))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as double; NULL when den is 0 (R would give NaN / Inf)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def corr0(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over complete pairs; NULL for a constant column.

    ``corr`` itself raises on a zero variance under ANSI mode, so it is
    written from population moments over the pairs where both are present.
    """
    x, y = _c(x).cast("double"), _c(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))


# --- rounding / text ------------------------------------------------------------

def r_round(c: str | Column, digits: int = 0) -> Column:
    """R's ``round``: half to even."""
    return F.bround(_c(c), digits)


def num_text(c: str | Column) -> Column:
    """``as.character`` of a number: no trailing ``.0`` on whole values."""
    return F.regexp_replace(_c(c).cast("string"), r"\.0$", "")


def _signed_money(x: Column, body: Column) -> Column:
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"), body)


def dollar(c: str | Column) -> Column:
    """``scales::dollar(x, accuracy = 1)``: ``$1,234``, ``-$1,234``; half to even."""
    r = F.bround(_c(c), 0)
    return _signed_money(r, F.format_number(F.abs(r), 0))


def dollar_auto(c: str | Column, largest_with_cents: float = 100000) -> Column:
    """``scales::dollar(x)`` with the default accuracy heuristic.

    Cents are shown only for a fractional value whose magnitude is at most
    ``largest_with_cents``.
    """
    x = _c(c)
    cents = (F.abs(x) <= F.lit(largest_with_cents)) & (x != F.floor(x))
    r2, r0 = F.bround(x, 2), F.bround(x, 0)
    return F.when(cents, _signed_money(r2, F.format_number(F.abs(r2), 2))) \
            .otherwise(_signed_money(r0, F.format_number(F.abs(r0), 0)))


def currency(c: str | Column) -> Column:
    """Currency text with two decimals: ``$1,234.50``."""
    x = _c(c)
    return _signed_money(x, F.format_number(F.abs(x), 2))


def pct_text(c: str | Column, digits: int = 1) -> Column:
    """``paste0(round(x, 1), "%")``."""
    return F.concat(num_text(F.bround(_c(c).cast("double"), digits)), F.lit("%"))


# --- dates ----------------------------------------------------------------------

# First letters of the month names, in order.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# Two-digit years from this one on are 19xx, smaller ones 20xx.
PIVOT_YEAR = 69


# How almost every date is written; other forms take the lenient way.
PLAIN_DATE = r"^\d{1,2}/\d{1,2}/\d{4}$"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _year_month_day(plain: Column) -> Column:
    """The date of ``month/day/year`` in digits, from text with single slashes."""
    def date(parts: Column) -> Column:
        year = F.get(parts, F.lit(2))
        century = F.when(F.length(year) == 4, F.lit("")).when(year >= F.lit(str(PIVOT_YEAR)), F.lit("19")).otherwise(F.lit("20"))
        return F.try_to_date(F.concat_ws("-", F.concat(century, year), F.get(parts, F.lit(0)), F.get(parts, F.lit(1))), "yyyy-M-d")

    digits = F.rlike(plain, F.lit(r"^\d{1,2}/\d{1,2}/(\d{4}|\d{2})$"))
    return _bound(F.split(F.when(digits, plain), "/"), date)


def _lenient_date(t: Column) -> Column:
    """The date of trimmed lower-case text in any of the forms of ``mdy``."""
    def named(name: Column) -> Column:
        number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(name, 1, 3)).cast("string")
        full = F.lit(" january february march april may june july august september october november december ")
        known = F.contains(full, F.concat(F.lit(" "), name)) & (number != "0")
        return F.when(known, F.concat(number, F.regexp_replace(t, r"^[a-z]{3,9}\.?", "/")))

    compact = F.when(F.rlike(t, F.lit(r"^(\d{6}|\d{8})$")), F.regexp_replace(t, r"^(\d\d)(\d\d)", "$1/$2/"))
    by_name = F.when(F.rlike(t, F.lit("^[a-z]")), _bound(F.regexp_extract(t, r"^([a-z]{3,9})", 1), named))
    return _bound(F.regexp_replace(F.coalesce(by_name, compact, t), r"[-/., ]+", "/"), _year_month_day)


def mdy(c: str | Column) -> Column:
    """Lenient month/day/year parse: unparseable text becomes NULL, never an error.

    Month as a number or an English name (three letters or more), any run of
    ``/ - . ,`` and blanks as separator, or digits alone (``01052020``,
    ``010520``); years of four or two digits.  Plain ``M/d/yyyy`` takes one pattern
    and one parse; for other forms every intermediate text is computed once.
    """
    t = F.trim(_c(c))
    return F.when(F.rlike(t, F.lit(PLAIN_DATE)), F.try_to_date(t, "M/d/yyyy")).otherwise(_bound(F.lower(t), _lenient_date))


def mdy_strict(c: str | Column) -> Column:
    """``as.Date(x, "%m/%d/%Y")``: one pattern, NULL when it does not parse."""
    return F.try_to_date(_c(c), "M/d/yyyy")
