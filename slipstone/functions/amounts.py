"""Money columns: parsing in three dialects, similarity, fee checks and display."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(15,2)"


def _as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


#: fixed value: the characters that count as white space at the ends of a text
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(value) -> Column:
    """White space of any kind removed from both ends (``trim`` alone removes spaces only)."""
    return F.btrim(_as_col(value), F.lit(WHITESPACE))


_plain: ContextVar[bool] = ContextVar("plain", default=False)


@contextmanager
def written_out() -> Iterator[None]:
    """Inside, ``let`` repeats its value instead of binding it: SQL text has no binding."""
    token = _plain.set(True)
    try:
        yield
    finally:
        _plain.reset(token)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    if _plain.get():
        return body(value)
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_amount(raw) -> Column:
    """Captured amount, US/MX style: comma groups thousands; ambiguous or negative -> null."""
    kept = F.translate(F.regexp_replace(_as_col(raw), r"[^0-9.,\-]", ""), ",", "")

    def checked(text: Column) -> Column:
        dots = F.length(text) - F.length(F.translate(text, ".", ""))
        return F.when(dots <= 1, text.try_cast(MONEY))

    return let(let(kept, checked), lambda value: F.when(value >= 0, value))


def parse_amount_signed(raw) -> Column:
    """Ground-truth amount: currency words and commas dropped, sign kept."""
    text = strip(_as_col(raw).cast("string"))
    for token in ("$", "MXN", "MN", "USD", ","):
        text = F.replace(text, F.lit(token), F.lit(""))
    return strip(text).try_cast("decimal(20,6)")


def lenient_or_null(raw) -> Column:
    """Amount as double from loose text; missing -> null, unreadable -> 0.0."""
    text = strip(F.regexp_replace(strip(_as_col(raw).cast("string")), r"\s*[A-Z]{2,3}$", ""))
    text = strip(F.regexp_replace(text, "[$¢]", ""))

    def ungrouped(t: Column) -> Column:
        european = t.rlike(r"^\d{1,3}(\.\d{3})+(,\d+)?$")
        plain = F.when(european, F.translate(t, ",.", ".")).otherwise(F.translate(t, ",", ""))
        return F.regexp_replace(F.translate(plain, "− ", "-"), r"\.+$", "")

    def number(t: Column) -> Column:
        numeric = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
        return F.when(t.isNotNull(), F.coalesce(F.when(numeric, t.try_cast("double")), F.lit(0.0)))

    return let(let(text, ungrouped), number)


def lenient_amount(raw) -> Column:
    """Amount as double from loose text; unreadable -> 0.0, European grouping recognised."""
    return F.coalesce(lenient_or_null(raw), F.lit(0.0))


def amount_similarity(a, b) -> Column:
    """1 - |a-b| / max(|a|,|b|); both zero -> 1; either missing -> 0."""
    x, y = _as_col(a).cast("double"), _as_col(b).cast("double")
    top = F.greatest(F.abs(x), F.abs(y))
    return (
        F.when(x.isNull() | y.isNull(), F.lit(0.0))
        .when(top == 0, F.lit(1.0))
        .otherwise(F.lit(1.0) - F.abs(x - y) / F.when(top != 0, top))
    )


def format_money(amount) -> Column:
    return F.concat(F.lit("$"), F.format_number(_as_col(amount), 2))


def vat_of(fee) -> Column:
    """16 % VAT of a fee, to the cent."""
    return F.round(_as_col(fee).cast(MONEY) * F.lit("0.16").cast("decimal(3,2)"), 2).cast(MONEY)


def total_with_fee(amount, fee) -> Column:
    base = _as_col(amount).cast(MONEY) + _as_col(fee).cast(MONEY)
    return (base + vat_of(fee)).cast(MONEY)


def within_tolerance(pred, truth, tolerance: str = "0.01") -> Column:
    """Three-state amount match: null when either side is missing."""
    return F.abs(_as_col(pred) - _as_col(truth)) <= F.lit(tolerance).cast("decimal(10,4)")
