"""Date columns: parsing in two dialects, similarity, tolerance and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .amounts import _as_col, let, strip

_TIME = r"[T ]+\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(\s*[AaPp][Mm])?\s*(Z|[+-]\d{2}:?\d{2})?$"
_ISO = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
_NUMERIC = r"^(\d{1,2})[/.\- ](\d{1,2})[/.\- ](\d{4}|\d{2})$"
_DAY_MONTH = r"^(\d{1,2})[/.\- ]+([A-Za-z]{3,9})\.?[/.\-, ]+(\d{4}|\d{2})$"
_MONTH_DAY = r"^([A-Za-z]{3,9})\.? +(\d{1,2}),? +(\d{4})$"


def _ymd(year: Column, month: Column, day: Column) -> Column:
    """A date from text parts, null when no such day exists.

    Two-digit years lie within 50 years of today, so ``99`` is 1999.
    """
    this_year = F.year(F.current_date())
    ahead = year.try_cast("int") + 2000 >= this_year + 50
    century = F.when(ahead, F.lit("19")).otherwise(F.lit("20"))
    full = F.when(F.length(year) == 2, F.concat(century, year)).otherwise(year)
    dash = F.lit("-")
    return F.concat(full, dash, F.lpad(month, 2, "0"), dash, F.lpad(day, 2, "0")).try_cast("date")


def _english_month(name: Column) -> Column:
    """Month number of an English name, its first three letters, or "sept"; else null."""
    names = {month: i for i, month in enumerate(vocab.MONTHS_EN, start=1)}
    names |= {month[:3]: i for month, i in names.items()} | {"sept": 9}
    table = F.create_map(*[F.lit(x) for m, i in names.items() for x in (m, str(i))])
    return F.try_element_at(table, F.lower(name))


def parse_date(raw) -> Column:
    """Captured date: ISO is year-first, otherwise day-first with month-first as the fallback.

    Only complete dates parse; a time part is dropped; month names are English.
    """
    cleaned = F.regexp_replace(strip(_as_col(raw)), _TIME, "")
    return let(cleaned, _dated)


def _dated(text: Column) -> Column:
    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    first, second = part(_NUMERIC, 1).try_cast("int"), part(_NUMERIC, 2).try_cast("int")
    day_first = (second <= 12) | (first > 12)
    numeric = F.when(
        day_first, _ymd(part(_NUMERIC, 3), part(_NUMERIC, 2), part(_NUMERIC, 1))
    ).otherwise(_ymd(part(_NUMERIC, 3), part(_NUMERIC, 1), part(_NUMERIC, 2)))
    return (
        F.when(text.rlike(_ISO), _ymd(part(_ISO, 1), part(_ISO, 2), part(_ISO, 3)))
        .when(text.rlike(_NUMERIC), numeric)
        .when(
            text.rlike(_DAY_MONTH),
            _ymd(part(_DAY_MONTH, 3), _english_month(part(_DAY_MONTH, 2)), part(_DAY_MONTH, 1)),
        )
        .when(
            text.rlike(_MONTH_DAY),
            _ymd(part(_MONTH_DAY, 3), _english_month(part(_MONTH_DAY, 1)), part(_MONTH_DAY, 2)),
        )
    )


def parse_truth_date(raw) -> Column:
    """Ground-truth date: ISO prefix, then day/month/year, month/day/year, day-month-year."""
    text = strip(_as_col(raw).cast("string"))
    head = F.substring(text, 1, 10)
    slashed = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    dashed = r"^(\d{1,2})-(\d{1,2})-(\d{4})$"

    def of(pattern: str, year: int, month: int, day: int) -> Column:
        pick = [F.regexp_extract(text, pattern, g) for g in (year, month, day)]
        return F.when(text.rlike(pattern), _ymd(*pick))

    return F.coalesce(
        F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date")),
        of(slashed, 3, 2, 1),
        of(slashed, 3, 1, 2),
        of(dashed, 3, 2, 1),
    )


def date_similarity(a, b, window_days: int = vocab.WINDOW_DAYS) -> Column:
    """1 - min(days, window) / window; either missing -> 0."""
    gap = F.abs(F.datediff(_as_col(a), _as_col(b)))
    near = F.lit(1.0) - F.least(gap, F.lit(window_days)).cast("double") / F.lit(float(window_days))
    return F.coalesce(near, F.lit(0.0))


def days_within(pred, truth, tolerance_days: int = 1) -> Column:
    """Three-state date match: null when either side is missing."""
    return F.abs(F.datediff(_as_col(pred), _as_col(truth))) <= tolerance_days


def long_spanish_date(day) -> Column:
    """``02 DE JUNIO DEL 2024``."""
    value = _as_col(day)
    months = F.array(*[F.lit(m) for m in vocab.MONTHS_ES])
    return F.concat(
        F.lpad(F.dayofmonth(value).cast("string"), 2, "0"),
        F.lit(" DE "),
        F.element_at(months, F.month(value)),
        F.lit(" DEL "),
        F.year(value).cast("string"),
    )


def slashed_date(day) -> Column:
    """``02/06/2024``."""
    return F.date_format(_as_col(day), "dd/MM/yyyy")
