import math
import random

import numpy as np
import pytest

from slipstone.llm.codes import Codebooks, assign, compress, decode


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows
            if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[cut[e][p] for e in range(min(entries, len(kept)))] for p in range(parts)]

    def chosen():
        return [[min(((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p])))
                 for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found = chosen()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    sums, rows = {}, []
    for (i, _, label), f in zip(kept, chosen(), strict=True):
        error = sum(d for d, _ in f)
        sums[label] = sums.get(label, 0) + error
        rows.append((i, "".join(f"{k:02x}" for _, k in f), error, label))
    return sorted(((i, c, e, sums[label]) for i, c, e, label in rows), key=repr), books


def compared(spark, rows, **sizes):
    frame = spark.createDataFrame(
        [(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, __code int"
    ).repartition(3)
    coded, books = compress(frame, **sizes)
    want, entries = brute(rows, **sizes)
    assert sorted((tuple(r) for r in coded.select("vec_id", "code", "error", "label_error").collect()), key=repr) == want
    assert books.entries.tolist() == entries
    return coded, books


def drawn(seed, n, width=32, grid=None):
    draw = random.Random(seed)
    value = (lambda: draw.choice(grid)) if grid else (lambda: float(np.float32(draw.gauss(0, 1))))
    return [(i, [value() for _ in range(width)], draw.choice([0, 1, None])) for i in range(n)]


def test_equals_plain_lloyd(spark):
    rows = drawn(1, 120)
    rows += [(500, None, 1), (-5, [float("nan")] * 32, 1), (-6, [None] + [0.0] * 31, 1), (-7, [float("-inf")] * 32, 2),
             (-8, [], 1), (3, rows[3][1], 0), (None, rows[9][1], None), (None, [1.0] * 32, 0)]
    compared(spark, rows)


def test_ties_repeats_and_unused_entries(spark):
    rows = drawn(2, 90, 8, [0.0, 0.25, -0.25])
    compared(spark, [*rows, *[(200 + i, rows[0][1], 5) for i in range(40)]], entries=6, rounds=4)
    compared(spark, drawn(3, 4, 16))  # fewer vectors than entries


def test_empty_table_and_oversized_components(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    coded, books = compress(empty)
    assert coded.count() == 0 and books.entries.shape[1] == 0
    rows = [*drawn(4, 20, 8), (-1, [1e30] * 8, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    coded, books = compress(frame)
    assert coded.filter("vec_id = -1").isEmpty() and coded.count() == 20
    first = coded.orderBy("vec_id").first()
    assert len(decode(first.code, books)) == 8


@pytest.mark.parametrize("seed", range(8))
def test_active_entries_give_what_a_full_scan_gives(seed):
    draw = np.random.default_rng(seed)
    vectors = draw.integers(-3, 4, (200, 4, 2))
    books = Codebooks(draw.integers(-3, 4, (4, 6, 2)))
    code, distance = np.full((200, 4), -1), np.zeros((200, 4), dtype=np.int64)
    assign(vectors, books, code, distance, np.ones((4, 6), dtype=bool))
    for _ in range(5):
        moved = draw.random((4, 6)) < 0.4
        after = Codebooks(np.where(moved[..., None], draw.integers(-3, 4, (4, 6, 2)), books.entries))
        assign(vectors, after, code, distance, (after.entries != books.entries).any(axis=2))
        full = ((vectors[:, :, None, :] - after.entries[None]) ** 2).sum(axis=3)
        assert (code == full.argmin(axis=2)).all() and (distance == full.min(axis=2)).all()
        books = after
