"""Similarity measures, their cheap bounds, the weighted score and its classes."""

from __future__ import annotations

import sys
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from ..config import ScoringConfig
from .amounts import _as_col

# fixed value: smooth inverse document frequency of a term found in one of two documents
UNSHARED_IDF = 1.4054651081081644
# fixed value: a term is a run of at least two word characters
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"

_WORD = 64

# the functions below travel to the executors by value, so workers need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _codes(values: np.ndarray, width: int) -> np.ndarray:
    """Code points of each string as a zero-padded matrix."""
    table = values.astype(f"<U{max(width, 1)}")
    return table.view(np.uint32).reshape(len(values), -1)


def _lcs_short(a: np.ndarray, b: np.ndarray, len_a: np.ndarray) -> np.ndarray:
    """LCS lengths for code-point rows, ``a`` at most 64 wide: one bit vector per row."""
    padded = np.zeros((a.shape[0], _WORD), dtype=np.uint32)
    padded[:, : a.shape[1]] = a
    vector = np.full(a.shape[0], np.uint64(0xFFFFFFFFFFFFFFFF))
    for column in range(b.shape[1]):
        char = b[:, column]
        same = (padded == char[:, None]) & (char != 0)[:, None]
        match = np.packbits(same, axis=1, bitorder="little").view(np.uint64)[:, 0]
        both = vector & match
        vector = (vector + both) | (vector - both)
    mask = np.where(
        len_a >= _WORD,
        np.uint64(0xFFFFFFFFFFFFFFFF),
        (np.uint64(1) << np.minimum(len_a, 63).astype(np.uint64)) - np.uint64(1),
    )
    return np.bitwise_count(~vector & mask).astype(np.int64)


def _lcs_long(a: str, b: str) -> int:
    """The same for one pair of any length, on Python integers."""
    where: dict[str, int] = {}
    for position, char in enumerate(a):
        where[char] = where.get(char, 0) | (1 << position)
    full = (1 << len(a)) - 1
    vector = full
    for char in b:
        both = vector & where.get(char, 0)
        vector = ((vector + both) | (vector - both)) & full
    return len(a) - vector.bit_count()


def indel_ratios(left: pd.Series, right: pd.Series) -> np.ndarray:
    """2 * LCS / (len a + len b) per row; a missing or empty side gives 0."""
    a = left.fillna("").to_numpy(dtype=object)
    b = right.fillna("").to_numpy(dtype=object)
    len_a = np.fromiter(map(len, a), dtype=np.int64, count=len(a))
    len_b = np.fromiter(map(len, b), dtype=np.int64, count=len(b))
    swap = len_a > len_b
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    short, long = np.minimum(len_a, len_b), np.maximum(len_a, len_b)
    lcs = np.zeros(len(a), dtype=np.int64)
    quick = (short > 0) & (short <= _WORD)
    if quick.any():
        width_a, width_b = int(short[quick].max()), int(long[quick].max())
        lcs[quick] = _lcs_short(
            _codes(a[quick], width_a), _codes(b[quick], width_b), short[quick]
        )
    for row in np.flatnonzero(short > _WORD):
        lcs[row] = _lcs_long(a[row], b[row])
    total = len_a + len_b
    return np.where(short > 0, 2.0 * lcs / np.maximum(total, 1), 0.0)


@F.pandas_udf(DoubleType())
def _indel_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(indel_ratios(left, right))


def indel_ratio(a, b) -> Column:
    """Reference similarity, Arrow-vectorised; equal strings never leave the JVM's answer."""
    return _indel_udf(_as_col(a), _as_col(b))


def indel_ratio_sql(a, b) -> Column:
    """The same measure from built-in expressions only; meant for short strings."""
    left, right = _as_col(a), _as_col(b)
    n, m = F.length(left), F.length(right)

    def next_row(row: Column, i: Column) -> Column:
        char = F.substring(left, i, F.lit(1))

        def cell(acc: Column, j: Column) -> Column:
            grown = F.get(row, j - 1) + 1
            kept = F.greatest(F.get(row, j), F.element_at(acc, F.lit(-1)))
            value = F.when(char == F.substring(right, j, F.lit(1)), grown).otherwise(kept)
            return F.concat(acc, F.array(value))

        return F.aggregate(F.sequence(F.lit(1), m), F.array(F.lit(0)), cell)

    start = F.transform(F.sequence(F.lit(0), m), lambda _: F.lit(0))
    table = F.aggregate(F.sequence(F.lit(1), n), start, next_row)
    ratio = F.lit(2.0) * F.element_at(table, F.lit(-1)) / (n + m)
    return F.when((n > 0) & (m > 0), ratio).otherwise(F.lit(0.0))


def reference_bounds(a, b) -> tuple[Column, Column]:
    """(lower, upper) bound of the indel ratio from the built-in edit distance.

    With substitutions allowed the distance d satisfies d <= indel <= 2d.
    """
    left, right = _as_col(a), _as_col(b)
    total = (F.length(left) + F.length(right)).cast("double")
    usable = (F.length(left) > 0) & (F.length(right) > 0)
    share = F.levenshtein(left, right) / F.when(total > 0, total)
    upper = F.when(usable, F.lit(1.0) - share).otherwise(F.lit(0.0))
    lower = F.when(usable, F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(2.0) * share)).otherwise(
        F.lit(0.0)
    )
    return lower, upper


@F.pandas_udf(DoubleType())
def _matcher_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    def one(a, b):
        return SequenceMatcher(None, a, b).ratio() if a and b else 0.0

    return pd.Series([one(a, b) for a, b in zip(left, right)], dtype="float64")


def sequence_ratio(a, b) -> Column:
    """Ratcliff-Obershelp ratio (the evaluator's measure); a missing or empty side gives 0."""
    return _matcher_udf(_as_col(a), _as_col(b))


def terms(text) -> Column:
    """Lower-case terms of a text, in order, with repeats."""
    return F.regexp_extract_all(F.lower(_as_col(text)), F.lit(f"({TERM_PATTERN})"))


#: hash buckets of a text sketch
SKETCH_WIDTH = 256


def term_hashes(text) -> Column:
    """64-bit hashes of the terms of a text, repeats included."""
    return F.transform(terms(text), lambda t: F.xxhash64(t))


@F.pandas_udf(ArrayType(FloatType()))
def _sketch_udf(hashes: pd.Series) -> pd.Series:
    def one(found) -> np.ndarray:
        term, count = np.unique(np.asarray(found, dtype=np.int64), return_counts=True)
        squares = np.bincount(term & (SKETCH_WIDTH - 1), weights=count.astype(np.float64) ** 2, minlength=SKETCH_WIDTH)
        whole = squares.sum()
        # rounded up, so that products of two sketches stay upper bounds
        return (np.sqrt(squares / whole if whole else squares) * (1 + 1e-6)).astype(np.float32)

    return hashes.map(one)


def text_sketch(text) -> Column:
    """Norm of the terms in each of 256 hash buckets, as a share of the whole norm."""
    return _sketch_udf(term_hashes(text))


def cosine_bound(a: str, b: str) -> Column:
    """Upper bound of the two-document TF-IDF cosine from two ``text_sketch`` columns.

    Unshared terms weigh more than shared ones, so the plain norms bound the divisor from below;
    within a bucket the shared products are at most the product of the two norms.
    """
    product = F.zip_with(a, b, lambda x, y: (x * y).cast("double"))
    return F.least(F.lit(1.0), F.aggregate(product, F.lit(0.0), lambda held, x: held + x))


def cosine_of_sums(dot, shared_a, all_a, shared_b, all_b) -> Column:
    """Two-document TF-IDF cosine from sums over terms.

    ``shared_*`` and ``all_*`` are sums of squared counts over shared and over all terms;
    ``dot`` is the sum of count products over shared terms.
    """
    k2 = F.lit(UNSHARED_IDF * UNSHARED_IDF)

    def norm(shared, total):
        return F.sqrt(shared.cast("double") + k2 * (total - shared).cast("double"))

    dot, shared_a, all_a, shared_b, all_b = map(_as_col, (dot, shared_a, all_a, shared_b, all_b))
    product = norm(shared_a, all_a) * norm(shared_b, all_b)
    return F.when(product > 0, dot.cast("double") / product).otherwise(F.lit(0.0))


def weighted_score(s_ref, s_text, s_monto, s_fecha, cfg: ScoringConfig) -> Column:
    return (
        F.lit(float(cfg.w_ref)) * _as_col(s_ref)
        + F.lit(float(cfg.w_text)) * _as_col(s_text)
        + F.lit(float(cfg.w_monto)) * _as_col(s_monto)
        + F.lit(float(cfg.w_fecha)) * _as_col(s_fecha)
    )


def classify(score, cfg: ScoringConfig = ScoringConfig()) -> Column:
    """>= 0.90 duplicado, >= 0.75 sospechoso, else valido (defaults)."""
    value = _as_col(score)
    return (
        F.when(value >= cfg.duplicate_at, "duplicado")
        .when(value >= cfg.suspect_at, "sospechoso")
        .otherwise("valido")
    )


def published(score) -> Column:
    """Score as stored: at most 1, six decimals."""
    return F.round(F.least(F.lit(1.0), _as_col(score)), 6)
