"""Vector codes by product quantisation, trained by Lloyd rounds that follow active entries.

Every part of every vector keeps the entry it is assigned to and its exact squared distance. When
a codebook has been updated, a part whose entry stayed where it was compares only the entries that
moved against that distance; a part whose entry moved is compared with all of them. Sums of the
entries are kept up by the parts that change their entry.

A round is one pass over a stored table of the integer vectors with this state: it writes the next
state and, once per task, what the entries' sums gain. Only the codebooks, whose size is fixed,
come to the driver.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from ..operators.keyed import lookup
from ..session import release, spool_path

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
_STATE = ["__code", "__distance", "__error", "__gains"]


@dataclass
class Codebooks:
    """``entries[part][entry]`` are integer components; all arrays are of 64-bit integers."""

    entries: np.ndarray

    @classmethod
    def first(cls, vectors: list[list[int]], parts: int) -> Codebooks:
        whole = np.array(vectors, dtype=np.int64)
        return cls(whole.reshape(len(whole), parts, -1).transpose(1, 0, 2).copy())

    def updated(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Every entry at the floor of the mean of its parts; entries without parts stay."""
        means = np.array(
            [[[int(s) // int(n) for s in part] if n else old.tolist() for part, n, old in zip(*row, strict=True)]
             for row in zip(sums, counts, self.entries, strict=True)], dtype=np.int64,
        )
        return Codebooks(means.reshape(self.entries.shape))

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def assign(vectors: np.ndarray, books: Codebooks, code: np.ndarray, distance: np.ndarray, moved: np.ndarray) -> None:
    """Bring ``code`` and ``distance`` (rows by parts) up to ``books`` in place.

    ``moved[part][entry]`` marks the entries that differ from those the state belongs to; a code
    of -1 has no state yet. Equal distances go to the lower entry.
    """
    for part, entries in enumerate(books.entries):
        own = vectors[:, part]
        stale = (code[:, part] < 0) | moved[part][code[:, part]]
        if stale.any():
            found = _distances(own[stale], entries)
            best = found.argmin(axis=1)
            code[stale, part], distance[stale, part] = best, found[np.arange(len(best)), best]
        active = np.flatnonzero(moved[part])
        if len(active) and not stale.all():
            rows = np.flatnonzero(~stale)
            found = _distances(own[rows], entries[active])
            best = found.argmin(axis=1)
            near, entry = found[np.arange(len(best)), best], active[best]
            nearer = (near < distance[rows, part]) | ((near == distance[rows, part]) & (entry < code[rows, part]))
            code[rows[nearer], part], distance[rows[nearer], part] = entry[nearer], near[nearer]


def _distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    found = np.empty((len(rows), len(entries)), dtype=np.int64)
    for number, entry in enumerate(entries):
        gap = rows - entry
        found[:, number] = np.einsum("ij,ij->i", gap, gap)
    return found


def _gains(vectors: np.ndarray, before: np.ndarray, code: np.ndarray, gains: np.ndarray) -> None:
    """Add to ``gains[part][entry]`` (components, then the count) what changed entries bring."""
    for part in range(vectors.shape[1]):
        changed = np.flatnonzero(before[:, part] != code[:, part])
        rows = np.column_stack([vectors[changed, part], np.ones(len(changed), dtype=np.int64)])
        np.add.at(gains[part], code[changed, part], rows)
        left = before[changed, part] >= 0
        np.subtract.at(gains[part], before[changed[left], part], rows[left])


def _matrix(column: pa.Array, dtype: str, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(rows, -1)


def _binary(values: np.ndarray) -> pa.Array:
    """A binary column, one row of ``values`` to a row."""
    width = values.shape[1] * values.itemsize
    offsets = np.arange(len(values) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(
        pa.binary(), len(values), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]
    )


def _round(state: DataFrame, books: Codebooks, moved: np.ndarray) -> DataFrame:
    """Rows with their new state, and a row of gains for every task that has rows."""
    parts, entries, width = books.entries.shape
    schema = state.schema
    carried = [f.name for f in schema if f.name not in _STATE]

    def run(batches):
        gains, seen, kind = np.zeros((parts, entries, width + 1), dtype=np.int64), False, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            seen, kind = True, batch.schema
            vectors = _matrix(batch["__vector"], "<i4", n).astype(np.int64).reshape(n, parts, width)
            before = _matrix(batch["__code"], "i1", n).astype(np.int64)
            code, distance = before.copy(), _matrix(batch["__distance"], "<i8", n).copy()
            assign(vectors, books, code, distance, moved)
            _gains(vectors, before, code, gains)
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in carried], _binary(code.astype("i1")), _binary(distance),
                 pa.array(distance.sum(axis=1)), pa.nulls(n, pa.list_(pa.int64()))],
                names=[*carried, *_STATE],
            )
        if seen:
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(1, kind.field(c).type) for c in [*carried, *_STATE[:-1]]],
                 pa.array([gains.ravel().tolist()], pa.list_(pa.int64()))],
                names=[*carried, *_STATE],
            )

    return state.filter("__gains is null").select(*carried, *_STATE).mapInArrow(run, schema)


def _integers(rows: DataFrame, dimension: int, parts: int) -> DataFrame:
    """The stored form: components as 32-bit integers, no state."""
    schema = StructType([
        rows.schema["vec_id"], rows.schema["label"], StructField("__vector", BinaryType()),
        StructField("__code", BinaryType()), StructField("__distance", BinaryType()),
        StructField("__error", LongType()), StructField("__gains", ArrayType(LongType())),
    ])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            values = batch["__vector"].flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(n, dimension)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["label"], _binary(values), _binary(np.full((n, parts), -1, dtype="i1")),
                 _binary(np.zeros((n, parts), dtype="<i8")), pa.array(np.zeros(n, dtype=np.int64)),
                 pa.nulls(n, pa.list_(pa.int64()))],
                names=["vec_id", "label", "__vector", *_STATE],
            )

    return rows.select("vec_id", "label", "__vector").mapInArrow(run, schema)


def compress(
    vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, Codebooks]:
    """Codes of ``vectors`` (vec_id, embedding, label) and the codebooks they belong to.

    Component x becomes floor(scale * x). Each part's codebook starts as that part of the
    ``entries`` smallest vec_ids (nulls last, equal ids by their components); every round assigns
    all parts and moves each entry to the floor of its parts' mean, then parts are assigned once
    more. Rows: ``vec_id, code (two hex digits a part), error, label_error``; error sums the
    squared distances, label_error sums it over equal labels, nulls together (null where a sum
    leaves 64 bits).

    Dropped are null vectors, those with null or non-finite components, those that ``parts``
    doesn't divide or whose length differs from that of the smallest vec_id, and those with
    components so large (over 2 ** 27 for 64 of them, scaled) that distances leave 64 bits. Rows
    that repeat a vec_id are coded each; an empty table has no rows and no entries; columns other
    than the three are ignored.
    """
    if entries > 127:
        raise ValueError("codes hold at most 127 entries")
    spark, paths = vectors.sparkSession, []

    def stored(df: DataFrame) -> DataFrame:
        """Write the next state; of the earlier ones only its source is still needed until then."""
        paths.append(spool_path(spark, "codes"))
        df.write.parquet(paths[-1])
        if len(paths) > 1:
            release(spark, paths.pop(0))
        return spark.read.schema(df.schema).parquet(paths[-1])

    def bad(x):
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    whole = vectors.select("vec_id", "label", "embedding").filter(
        F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)
        & ~F.exists("embedding", bad)
    )
    lead = whole.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding")).first()
    dimension = lead[0] if lead else parts
    reach = math.isqrt(2**60 // dimension)
    whole = whole.filter(
        (F.size("embedding") == dimension) & ~F.exists("embedding", lambda x: F.abs(x.cast("double")) * scale >= reach)
    ).select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("__vector"))
    starts = whole.orderBy(F.col("vec_id").asc_nulls_last(), "__vector").limit(entries).select("__vector").collect()
    books = Codebooks.first([r[0] for r in starts], parts) if starts else Codebooks(np.zeros((parts, 0, dimension // parts), np.int64))
    shape = books.entries.shape
    state = stored(_integers(whole, dimension, parts))
    moved = np.ones(shape[:2], dtype=bool)
    totals = np.zeros((shape[0], shape[1], shape[2] + 1), dtype=object)
    for _ in range(rounds):
        state = stored(_round(state, books, moved))
        # one row per component of a codebook, combined before the shuffle
        gains = (
            state.filter("__gains is not null").select(F.posexplode("__gains").alias("at", "gain"))
            .groupBy("at").agg(F.sum(F.col("gain").cast("decimal(38,0)")).alias("gain")).collect()
        )
        for row in gains:
            totals[np.unravel_index(row["at"], totals.shape)] += int(row["gain"])
        after = books.updated(totals[..., :-1], totals[..., -1])
        moved = (after.entries != books.entries).any(axis=2)
        books = after
    state = stored(_round(state, books, moved))
    coded = state.filter("__gains is null").select(
        "vec_id", "label", F.lower(F.hex("__code")).alias("code"), F.col("__error").alias("error")
    )
    by_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    return lookup(coded, by_label, ["label"], ["label_error"]).select("vec_id", "code", "error", "label_error"), books


def decode(code: str, books: Codebooks, scale: int = SCALE) -> list[float]:
    """The vector that ``code`` stands for."""
    chosen = bytes.fromhex(code)
    return (np.concatenate([books.entries[part][entry] for part, entry in enumerate(chosen)]) / scale).tolist()
