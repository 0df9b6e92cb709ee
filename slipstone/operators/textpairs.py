"""Text similarity of given pairs, in closed form over term counts."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from ..functions.similarity import UNSHARED_IDF, terms
from ..session import spool

# the function below travels to the executors by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


_PACKED = StructType([StructField("counts", BinaryType()), StructField("total", LongType())])


def _packed_counts(ids: list, checks: list) -> pd.DataFrame:
    """The terms of each row as one binary: 64-bit digests (sorted), 32-bit digests, counts."""
    n = len(ids)
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    row = np.repeat(np.arange(n), sizes)
    term = np.concatenate([np.asarray(x, dtype=np.int64) for x in ids] + [np.zeros(0, dtype=np.int64)])
    check = np.concatenate([np.asarray(x, dtype=np.int64) for x in checks] + [np.zeros(0, dtype=np.int64)])
    check = check.astype(np.uint32)
    order = np.lexsort((check, term, row))
    row, term, check = row[order], term[order], check[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1]) | (check[1:] != check[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(row)))
    row, term, check = row[first], term[first], check[first]
    total = np.bincount(row, weights=count.astype(np.float64) ** 2, minlength=n)
    ends = np.cumsum(np.bincount(row, minlength=n))
    count = count.astype(np.uint32)
    return pd.DataFrame({
        "counts": [
            term[s:e].tobytes() + check[s:e].tobytes() + count[s:e].tobytes()
            for s, e in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)
        ] if n else [],
        "total": total.astype(np.int64),
    })


@F.pandas_udf(_PACKED)
def _pack(ids: pd.Series, checks: pd.Series) -> pd.DataFrame:
    return _packed_counts(list(ids), list(checks))


def _packed(texts: DataFrame) -> DataFrame:
    found = terms("text")
    packed = texts.filter("text is not null").select("text_key", _pack(
        F.transform(found, lambda t: F.xxhash64(t)), F.transform(found, lambda t: F.xxhash64(F.lit(1), t))
    ).alias("packed"))
    return packed.select("text_key", "packed.counts", "packed.total").filter("total > 0")


def term_counts(texts: DataFrame) -> DataFrame:
    """Per text: its terms packed as 96-bit digests with counts, and the squared norm; stored.

    A text is counted in its own task, no term is shuffled. Rows that repeat a key count as one
    text that holds the terms of all of them.
    """
    counted = spool(_packed(texts))
    again = spool(counted.groupBy("text_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("text_key"))
    if again.isEmpty():
        return counted
    # terms do not reach over a space
    whole = texts.join(again, "text_key", "left_semi").groupBy("text_key").agg(
        F.concat_ws(" ", F.collect_list("text")).alias("text")
    )
    return spool(counted.join(again, "text_key", "left_anti").union(_packed(whole)))


def _unpacked(packed: bytes) -> tuple[np.ndarray, ...]:
    """Digests (sorted), second digests and counts of the terms of a packed text."""
    n = len(packed) // 16
    return (
        np.frombuffer(packed, np.int64, n), np.frombuffer(packed, np.uint32, n, 8 * n),
        np.frombuffer(packed, np.uint32, n, 12 * n).astype(np.float64),
    )


def _shared(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the shared terms on both sides; a shared term agrees in both digests, 96 bits in all."""
    (term, check, count), (other, twin, many) = left, right
    if len(other) > len(term):
        return _shared(right, left)[::-1]
    if not len(other):
        return count[:0], many[:0]
    if (term[1:] == term[:-1]).any():  # terms that the first digest does not tell apart
        kind = np.dtype([("term", np.int64), ("check", np.uint32)])
        pairs = []
        for t, c in ((term, check), (other, twin)):
            pairs.append(np.empty(len(t), dtype=kind))
            pairs[-1]["term"], pairs[-1]["check"] = t, c
        _, here, there = np.intersect1d(*pairs, assume_unique=True, return_indices=True)
        return count[here], many[there]
    at = np.minimum(term.searchsorted(other), len(term) - 1)
    hit = (term[at] == other) & (check[at] == twin)
    return count[at[hit]], many[hit]


@F.pandas_udf(DoubleType())
def _cosine(counts_a: pd.Series, all_a: pd.Series, counts_b: pd.Series, all_b: pd.Series) -> pd.Series:
    """Two-document TF-IDF cosine: shared terms weigh 1, all others the unshared idf.

    The terms of a text lie sorted, so those of the shorter one are looked up in the longer one.
    """
    n = len(counts_a)
    if not n:
        return pd.Series([], dtype="float64")
    dot, sx, sy = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, (a, b) in enumerate(zip(counts_a, counts_b, strict=True)):
        x, y = _shared(_unpacked(a), _unpacked(b))
        # sums of whole numbers: exact in any order
        dot[i], sx[i], sy[i] = x @ y, x @ x, y @ y
    k2 = UNSHARED_IDF * UNSHARED_IDF
    na, nb = all_a.to_numpy(dtype=np.float64), all_b.to_numpy(dtype=np.float64)
    norm = np.sqrt(sx + k2 * (na - sx)) * np.sqrt(sy + k2 * (nb - sy))
    return pd.Series(np.where(dot > 0, dot / np.where(norm > 0, norm, 1.0), 0.0))


def named_in(pairs: DataFrame) -> DataFrame:
    """The distinct text keys of the pairs."""
    return pairs.select(F.explode(F.array("key_a", "key_b")).alias("text_key")).distinct()


def text_pair_similarity(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Cosine for each distinct pair of text keys that shares a term.

    ``pairs(key_a, key_b)`` are distinct; ``texts(text_key, text)`` is unique per key and best
    holds only texts named in a pair (see ``named_in``). A pair moves two packed count vectors, 16
    bytes a term and never exploded terms, and both joins have a unique side, so a text that many
    pairs name is split by AQE.
    """
    counted = term_counts(texts)
    side_a, side_b = (
        counted.select(*[F.col(c).alias(f"{c}_{s}") for c in counted.columns]) for s in "ab"
    )
    return (
        pairs.join(side_a, F.col("key_a") == F.col("text_key_a"))
        .join(side_b, F.col("key_b") == F.col("text_key_b"))
        .select("key_a", "key_b", _cosine("counts_a", "total_a", "counts_b", "total_b").alias("s_text"))
        .filter("s_text > 0")
    )
