"""Text columns: reference and name normalisation, masks, slugs and account checks."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import _as_col, strip


def blank_to_null(value) -> Column:
    return F.nullif(_as_col(value), F.lit(""))


def normalize_reference(raw) -> Column:
    """Whitespace runs collapsed, trimmed, upper case; punctuation kept; empty -> null."""
    collapsed = F.regexp_replace(_as_col(raw), r"(?U)\s+", " ")
    return blank_to_null(F.upper(strip(collapsed)))


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str, dict[str, str]]:
    """Characters that decompose into one ASCII letter or digit, that one, and the characters
    that decompose into several, such as ligatures."""
    source, target, several = [], [], {}
    for code in range(0x80, 0x20000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        base = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        base = "".join(c for c in base if c.isalnum())
        if len(base) == 1:
            source.append(char)
            target.append(base)
        elif base:
            several[char] = base
    return "".join(source), "".join(target), several


def match_key(raw) -> Column:
    """Lower-case ASCII letters and digits only, accents folded away."""
    source, target, several = _fold_table()
    value = _as_col(raw)
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spelt = F.array_join(
        F.transform(F.split(value, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), ""
    )
    rare = value.rlike("[" + "".join(several) + "]")
    folded = F.lower(F.translate(F.when(rare, spelt).otherwise(value), source, target))
    return F.regexp_replace(folded, "[^a-z0-9]", "")


def slug(raw) -> Column:
    """Lower case, other runs -> ``-``, no ``-`` at either end."""
    dashed = F.regexp_replace(F.lower(_as_col(raw)), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def joined_values(*values) -> Column:
    """Non-blank values in order, separated by one space."""
    items = F.array(*[_as_col(v).cast("string") for v in values])
    return F.concat_ws(" ", F.filter(items, lambda x: x.isNotNull() & (strip(x) != "")))


def reference_of(numero_referencia, numero_comprobante) -> Column:
    """Reference number, else voucher number; trimmed; blank -> null."""
    chosen = F.coalesce(blank_to_null(numero_referencia), blank_to_null(numero_comprobante))
    return blank_to_null(strip(chosen))


def mask_account(account) -> Column:
    """Thirteen bullets and the last four characters."""
    return F.concat(F.lit("•" * 13), F.right(_as_col(account), F.lit(4)))


def clabe_check_digit(first17) -> Column:
    """Check digit of a 17-digit account prefix (weights 3, 7, 1 repeating)."""
    prefix = _as_col(first17)
    digits = F.transform(
        F.sequence(F.lit(1), F.lit(17)), lambda i: F.substring(prefix, i, F.lit(1)).cast("int")
    )
    weights = F.array(*[F.lit((3, 7, 1)[i % 3]) for i in range(17)])
    products = F.zip_with(digits, weights, lambda d, w: d * w)
    total = F.aggregate(products, F.lit(0), lambda acc, x: acc + x)
    return F.when(
        prefix.rlike(r"^[0-9]{17}$"), F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10))
    )


def clabe_is_valid(account) -> Column:
    """True when the 18th digit of the account is its check digit."""
    value = _as_col(account)
    given = F.substring(value, 18, 1).try_cast("int")
    return F.coalesce(
        value.rlike(r"^[0-9]{18}$")
        & (clabe_check_digit(F.substring(value, 1, 17)) == given),
        F.lit(False),
    )
