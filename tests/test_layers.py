"""Layers against brute force on small, deliberately skewed tables."""

import math
import random
import re
from collections import Counter
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from slipstone.config import ScoringConfig
from slipstone.functions import similarity as sim
from slipstone.functions.similarity import UNSHARED_IDF
from slipstone.operators import keyed, layers
from slipstone.operators.cascade import cascade

SCHEMA = (
    "id_comprobante string, id_usuario string, texto_extraido string, referencia string, "
    "monto decimal(15,2), fecha_deposito date, hash_documento string, estado_actual string, "
    "fecha_registro timestamp, deleted_at timestamp"
)


def make(n, seed, hot=0.5):
    rng = random.Random(seed)
    texts = ["pago renta marzo", "pago luz marzo luz", "deposito nomina", "a b", None, "pago renta marzo abril"]
    rows = []
    for i in range(n):
        is_hot = rng.random() < hot
        rows.append((
            f"v{i:04d}", "u0" if is_hot else f"u{rng.randint(1, 5)}",
            rng.choice(texts),
            rng.choice([None, "REF-1", "REF-12", "X9", f"REF-{rng.randint(0, 40)}"]),
            rng.choice([None, Decimal("100.00"), Decimal("0.00"), Decimal(rng.randint(1, 500))]),
            None if rng.random() < 0.05 else date(2024, 1, 1) + timedelta(days=rng.randint(0, 70)),
            f"h{rng.randint(0, n)}", "recibido",
            datetime(2024, 3, 1) + timedelta(minutes=rng.randint(0, 50)),
            datetime(2024, 4, 1) if rng.random() < 0.1 else None,
        ))
    return rows


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def cosine(a, b):
    ta, tb = (Counter(re.findall(r"\b\w\w+\b", t.lower())) for t in (a, b))
    weight = lambda t: 1.0 if t in ta and t in tb else UNSHARED_IDF
    dot = sum(ta[t] * tb[t] for t in ta if t in tb)
    norm = lambda c: math.sqrt(sum((n * weight(t)) ** 2 for t, n in c.items()))
    return dot / (norm(ta) * norm(tb)) if ta and tb else 0.0


def score(a, b):
    s_ref = 2 * lcs(a[3], b[3]) / (len(a[3]) + len(b[3])) if a[3] and b[3] else 0.0
    s_text = cosine(a[2], b[2]) if a[2] and b[2] else 0.0
    if a[4] is None or b[4] is None:
        s_monto = 0.0
    else:
        x, y = float(a[4]), float(b[4])
        s_monto = 1.0 if max(x, y) == 0 else 1 - abs(x - y) / max(x, y)
    s_fecha = 1 - min(abs((a[5] - b[5]).days), 30) / 30
    return 0.35 * s_ref + 0.30 * s_text + 0.20 * s_monto + 0.15 * s_fecha


def brute(rows):
    out = {}
    for a in rows:
        best, who = 0.0, set()
        for b in rows:
            if (a[5] is None or b[5] is None or a[1] != b[1] or b[9] is not None
                    or (b[8], b[0]) >= (a[8], a[0]) or abs((a[5] - b[5]).days) > 30):
                continue
            s = score(a, b)
            if s > best + 1e-9:
                best, who = s, {b[0]}
            elif s > best - 1e-9 and s > 0:
                who.add(b[0])
        out[a[0]] = (round(min(1.0, best), 6), who)
    return out


@pytest.mark.parametrize("seed,tile", [(1, 20_000), (2, 9)])
def test_layer3_matches_brute_force(spark, seed, tile):
    rows = make(140, seed)
    want = brute(rows)
    got = layers.layer3(spark.createDataFrame(rows, SCHEMA), ScoringConfig(tile_rows=tile)).collect()
    assert len(got) == len(rows)
    for r in got:
        best, who = want[r.id_comprobante]
        assert r.score_similitud == pytest.approx(best, abs=1.1e-6), r
        assert (r.id_comprobante_original in who) if who else r.id_comprobante_original is None, r


def test_text_sketch_bounds_the_cosine(spark):
    rng = random.Random(3)
    words = [f"palabra{i}" for i in range(300)] + ["pago", "ño_ñ", "banco"]
    texts = ["", "a", "pago pago pago", "PAGO ño_ñ"] + [
        " ".join(rng.choices(words, k=rng.choice([1, 4, 30, 400]))) for _ in range(40)
    ]
    rows = [(a, b, cosine(a, b)) for a in texts for b in texts]
    df = spark.createDataFrame(rows, "a string, b string, exact double").select(
        "exact", "a", "b", sim.text_sketch("a").alias("x"), sim.text_sketch("b").alias("y")
    )
    got = df.select("a", "b", "exact", sim.cosine_bound("x", "y").alias("top")).collect()
    assert all(r.exact - 1e-9 <= r.top <= 1.0 for r in got)
    assert all(r.top == 0.0 for r in got if not cosine(r.a, r.a) or not cosine(r.b, r.b))
    # short unrelated texts are told apart
    assert sum(r.top for r in got if r.exact == 0.0) / sum(r.exact == 0.0 for r in got) < 0.3


def test_unlike_texts_write_few_pairs(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i:03d}" for i in range(900)]
    rows = [
        (f"v{i:04d}", "u0", " ".join(rng.sample(words, 12)), f"R{rng.randint(0, 9999):04d}",
         Decimal(rng.randint(1, 900)), date(2024, 1, 1) + timedelta(days=i % 20), f"h{i}", "recibido",
         datetime(2024, 3, 1) + timedelta(minutes=i), None)
        for i in range(150)
    ]
    written, kept = [], layers.spool

    def counted(df):
        stored = kept(df)
        if {"q_id", "c_id", "key_a"} <= set(df.columns):
            written.append(stored.count())
        return stored

    monkeypatch.setattr(layers, "spool", counted)
    got = {r.id_comprobante: r.score_similitud for r in layers.layer3(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert all(got[k] == pytest.approx(best, abs=1.1e-6) for k, (best, _) in want.items())
    # all vouchers lie in one window: 11,175 pairs
    assert max(written) <= 5 * len(rows)


def test_layer2_and_layer1(spark):
    rows = make(200, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    want2 = {}
    for a in rows:
        if None in (a[3], a[4], a[5]):
            continue
        hits = [b for b in rows if b[3:6] == a[3:6] and b[9] is None and (b[8], b[0]) < (a[8], a[0])]
        if hits:
            want2[a[0]] = min(hits, key=lambda b: (b[8], b[0]))[0]
    assert {r[0]: r[1] for r in layers.layer2(df).collect()} == want2

    first = {}
    for a in sorted(rows, key=lambda r: (r[8], r[0])):
        first.setdefault(a[6], a[0])
    survivors, rejected = layers.layer1(df)
    assert {r.id_comprobante for r in survivors.collect()} == set(first.values())
    assert {r.id_comprobante: r.id_existente for r in rejected.collect()} == {
        a[0]: first[a[6]] for a in rows if first[a[6]] != a[0]
    }


def test_lookup_with_hot_keys(spark):
    rows = [(i, None if i % 7 == 0 else ("hot" if i % 3 else f"k{i % 11}"), i * 37 % 101) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, o int")
    got = keyed.attach_first(df, ["k"], ["o", "id"], "first").collect()
    want = {}
    for i, k, o in rows:
        want[k] = min(want.get(k, (o, i)), (o, i))
    assert len(got) == 300
    assert all(tuple(r.first) == want[r.k] for r in got)


def test_rank_within(spark):
    df = spark.range(500).select("id", (F.col("id") % 3 == 0).cast("string").alias("g"))
    got = keyed.ranked_within(df, ["g"], ["id"]).collect()
    for g in {r.g for r in got}:
        mine = sorted(r.id for r in got if r.g == g)
        assert {r.id: (r["rank"], r["size"]) for r in got if r.g == g} == {
            x: (i + 1, len(mine)) for i, x in enumerate(mine)
        }


def test_micro_batches_equal_one_batch(spark):
    rows = sorted(make(120, 8), key=lambda r: (r[8], r[0]))
    whole = cascade(spark.createDataFrame(rows, SCHEMA))
    first = cascade(spark.createDataFrame(rows[:60], SCHEMA))
    stored = first.vouchers.select(*[c.split()[0] for c in SCHEMA.split(", ")])
    second = cascade(spark.createDataFrame(rows[60:], SCHEMA), store=stored)
    pick = lambda frame: {
        (r.id_comprobante, r.id_comprobante_original, r.score_similitud, r.clasificacion)
        for r in frame.collect()
    }
    assert pick(first.validations) | pick(second.validations) == pick(whole.validations)


def test_few_candidates_carry_no_sketch(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i:03d}" for i in range(900)]
    rows = [
        (f"v{i:04d}", f"u{i % 40}", " ".join(rng.sample(words, 12)), f"R{rng.randint(0, 9999):04d}",
         Decimal(rng.randint(1, 900)), date(2024, 1, 1) + timedelta(days=i % 20), f"h{i}", "recibido",
         datetime(2024, 3, 1) + timedelta(minutes=i), None)
        for i in range(120)
    ]
    columns, kept = set(), layers.spool

    def seen(df):
        columns.update(c for c in df.columns if "sketch" in c)
        return kept(df)

    monkeypatch.setattr(layers, "spool", seen)
    got = {r.id_comprobante: r.score_similitud for r in layers.layer3(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not columns
    want = brute(rows)
    assert all(got[k] == pytest.approx(best, abs=1.1e-6) for k, (best, _) in want.items())


def test_few_rows_of_a_scope_are_one_block_and_their_queries_move_once(spark, monkeypatch):
    rows = make(60, 21, hot=0.0)
    whole = layers.scoring_rows(spark.createDataFrame(rows, SCHEMA), ScoringConfig(), 1, F.lit(True)).dropna(
        subset=["scope", "fecha_deposito"]
    )
    asked, pool = layers._as_queries(whole), layers._as_candidates(whole.withColumn("first", F.col("ord")))
    placed, facing, block = layers._tiled(asked, pool, 30, 20_000)
    assert placed(asked).count() == asked.count()
    pairs = {(r.q_id, r.c_id) for r in layers._met(placed(asked), facing, block).filter(layers._in_window(30)).collect()}
    monkeypatch.setattr(layers, "SMALL_SCOPE", 0)
    placed, facing, block = layers._tiled(asked, pool, 30, 20_000)
    assert placed(asked).count() == 3 * asked.count()
    cut = layers._met(placed(asked), facing, block).filter(layers._in_window(30)).collect()
    assert len(cut) == len(pairs) > 0 and {(r.q_id, r.c_id) for r in cut} == pairs


def test_no_text_moves_with_the_survivors(spark):
    survivors, _ = layers.layer1(spark.createDataFrame(make(40, 22), SCHEMA))
    scored = layers.scoring_rows(survivors, ScoringConfig(), 1, F.lit(True))
    plan = scored._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "Join " in line]
    digests = [i for i, line in enumerate(plan) if "sha2(" in line]
    assert joins and digests and min(digests) > max(joins)


def test_shuffle_files_and_spools_of_a_step_go_when_it_is_written(spark):
    from slipstone import session

    drop_files = lambda: [
        f for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().toList().mkString("\n").split("\n")
        if "shuffle_" in f
    ]
    before = set(drop_files())
    stored = session.spool(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not set(drop_files()) - before and stored.count() == 7
    made = []

    def make():
        made.append(session.spool(spark.range(5)))
        return made[0].withColumn("x", F.col("id") + 1)

    held = len(session._spools)
    kept = session.spool_alone(make)
    assert len(session._spools) == held + 1 and kept.count() == 5
