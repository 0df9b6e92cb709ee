"""Reports, workflow, pairs, evaluation, audit, sources and streams."""

import json
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from slipstone import schemas, vocab
from slipstone.functions import text as text_functions
from slipstone.operators import audit, evaluation, pairs, reports, store, textpairs, workflow
from slipstone.sources import readers, writers
from slipstone.streaming import intake

LEGAL = set(vocab.TRANSITIONS)


def test_transition_table(spark):
    grid = [(a, b) for a in vocab.STATES + ("otro",) for b in vocab.STATES]
    got = workflow.judge(spark.createDataFrame(grid, "desde string, hacia string")).collect()
    assert len(LEGAL) == 14
    assert all(r.legal == ((r.desde, r.hacia) in LEGAL) for r in got)
    assert workflow.transitions(spark).count() == 14


def requests_of(n=400):
    return [(i % 7, i, datetime(2024, 1, 1 + i % 9, i % 24), vocab.STATES[(i * 5 + i // 3) % 8]) for i in range(n)]


def replayed():
    out = {}
    for v in range(7):
        state, done, refused = "recibido", 0, 0
        for _, _, _, target in sorted((r for r in requests_of() if r[0] == v), key=lambda r: (r[2], r[1])):
            if (state, target) in LEGAL:
                state, done = target, done + 1
            else:
                refused += 1
        out[v] = (state, done, refused)
    return out


REQUEST = "id_comprobante bigint, event_id bigint, fecha timestamp, hacia string"


def test_replay(spark):
    v = spark.createDataFrame([(i, "recibido") for i in range(7)], "id_comprobante bigint, estado_actual string")
    got = workflow.replay_requests(v, spark.createDataFrame(requests_of(), REQUEST)).collect()
    assert {r.id_comprobante: (r.estado, r.aplicadas, r.rechazadas) for r in got} == replayed()


def test_state_stream_equals_replay(spark, tmp_path):
    ordered = sorted(requests_of(), key=lambda r: (r[2], r[1]))
    for part in range(4):
        spark.createDataFrame(ordered[part * 100:(part + 1) * 100], REQUEST).coalesce(1).write.mode(
            "append"
        ).parquet(str(tmp_path / "in"))
    source = intake.read_uploads(
        spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_batch=1
    ).withColumn("inicial", F.lit("recibido"))
    out = str(tmp_path / "out")
    run = (
        intake.state_stream(source).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    assert run.awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 400
    counts = {}
    for r in rows:
        done, refused = counts.get(r.id_comprobante, (0, 0))
        counts[r.id_comprobante] = (done + r.legal, refused + (not r.legal))
    assert counts == {k: v[1:] for k, v in replayed().items()}


def test_hash_memory_bounds(spark, tmp_path):
    rows = [(f"h{i % 30}", datetime(2024, 1, 1 + i // 10)) for i in range(200)]
    for part in range(4):
        spark.createDataFrame(rows[part * 50:(part + 1) * 50], "hash_documento string, fecha_registro timestamp") \
            .coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    out = str(tmp_path / "out")
    run = (
        intake.dedup_stream(intake.read_uploads(spark, str(tmp_path / "in"), schema, files_per_batch=1))
        .writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    assert run.awaitTermination(120)
    assert 30 <= spark.read.parquet(out).count() <= 200


def test_decisions(spark):
    v = spark.createDataFrame(
        [(1, "en_revision", None), (2, "valido", None), (3, "en_revision", datetime(2024, 1, 1))],
        "id_comprobante bigint, estado_actual string, deleted_at timestamp",
    )
    d = spark.createDataFrame(
        [(10, 1, "u", "rechazar", datetime(2024, 1, 2)), (11, 1, "u", "aceptar", datetime(2024, 1, 3)),
         (12, 2, "u", "aceptar", datetime(2024, 1, 2)), (13, 3, "u", "aceptar", datetime(2024, 1, 2)),
         (14, 9, "u", "aceptar", datetime(2024, 1, 2))],
        "event_id bigint, id_comprobante bigint, id_usuario string, accion string, fecha timestamp",
    )
    updated, added, refused = workflow.apply_decisions(v, d)
    assert [tuple(r) for r in updated.collect()] == [(1, "duplicado")]
    assert added.first().metodo_deteccion == "manual"
    assert {r.event_id: r.motivo_rechazo for r in refused.collect()} == {
        11: "ya_decidido", 12: "transicion_invalida", 13: "no_encontrado", 14: "no_encontrado"
    }


def test_quota_verdicts(spark):
    users = [("a", "basic", False), ("b", "basic", False), ("c", "enterprise", False), ("d", "basic", True), ("e", "x", False)]
    u = spark.createDataFrame(users, "id_usuario string, plan string, sin_cuota boolean")
    uploads = [(f"{k}{i}", k, datetime(2024, 12, 5)) for k, n in (("a", 49), ("b", 50), ("c", 70), ("d", 70)) for i in range(n)]
    v = spark.createDataFrame(uploads, "id_comprobante string, id_usuario string, fecha_registro timestamp")
    got = {r.id_usuario: r for r in reports.quota_verdict(reports.quota_usage(v, u, date(2024, 12, 31))).collect()}
    assert {k: r.exceeded for k, r in got.items()} == {"a": False, "b": True, "c": False, "d": False, "e": True}
    assert got["a"].reset_date == date(2025, 1, 1) and got["c"].reset_date is None and got["c"].limit == -1


def test_admission_by_brute_force(spark):
    rows = [(i, f"u{i % 3}", datetime(2024, 1 + i % 2, 1 + (i * 7) % 20, i % 24)) for i in range(400)]
    v = spark.createDataFrame(rows, "id_comprobante bigint, id_usuario string, fecha_registro timestamp")
    u = spark.createDataFrame([("u0", "basic", False), ("u1", "enterprise", False), ("u2", "basic", True)],
                              "id_usuario string, plan string, sin_cuota boolean")
    got = {r.id_comprobante for r in reports.admit(v, u).filter("aceptado").collect()}
    want = {r[0] for r in rows if r[1] != "u0"}
    for month in (1, 2):
        mine = sorted((r for r in rows if r[1] == "u0" and r[2].month == month), key=lambda r: (r[2], r[0]))
        want |= {r[0] for r in mine[:50]}
    assert got == want


def test_page_arguments(spark):
    v = spark.createDataFrame([], schemas.VOUCHER)
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}, {"states": ["nada"]},
                {"date_from": date(2024, 2, 1), "date_to": date(2024, 1, 1)}):
        with pytest.raises(ValueError):
            reports.history(v, **bad)
    meta = reports.history(v, offset=20).meta.first()
    assert (meta.total, meta.has_more) == (0, False)


def test_weights(spark):
    rows = [("scoring.w_ref", "0.5"), ("scoring.w_text", "x"), ("otro", "9")]
    cfg = store.load_weights(spark.createDataFrame(rows, "key string, value string"))
    assert (cfg.w_ref, cfg.w_text, cfg.w_monto, cfg.w_fecha) == (0.5, 0.30, 0.20, 0.15)
    assert sum(vocab.DEFAULT_WEIGHTS.values()) == pytest.approx(1.0)


def sources(spark, n=60, amounts=4):
    rows = [(f"s{i:03d}", ["BBVA", "OXXO", "Uno"][0 if i % 3 else 1] if i else "Uno", float(i % amounts), f"2024-01-{1 + i % 5:02d}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "id string, banco string, monto double, fecha string")


@pytest.mark.parametrize("n", [10, 400])
def test_negative_pairs(spark, n):
    rows, src = sources(spark)
    facts = {r[0]: r for r in rows}
    got = pairs.negative_pairs(src, n, seed=7).collect()
    every = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] != b[2]]
    assert len(got) == min(n, len(every))
    assert len({(r.id_a, r.id_b) for r in got}) == len(got)
    for r in got:
        a, b = facts[r.id_a], facts[r.id_b]
        assert a[1] == b[1] and a[2] != b[2] and ("exacta" in r.notas) == (a[3] == b[3])
    if n == 10:
        used = [x for r in got for x in (r.id_a, r.id_b)]
        assert len(used) == len(set(used)) and all("exacta" in r.notas for r in got)


def test_pair_set_and_distribution(spark):
    _, src = sources(spark, 30)
    built = pairs.build_pairs(src, 20, seed=1)
    row = pairs.check_distribution(built).first()
    assert row.total == 50 and row.ok and (row.exacto, row.parcial_visual, row.negativo) == (15, 20, 15)
    bad = pairs.check_distribution(built.filter("tipo_duplicado = 'exacto'")).first()
    assert not bad.ok and bad.mensaje.startswith("Solo 15 pares")


def test_allocation_totals(spark):
    _, src = sources(spark, 61)
    for n in (10, 90, 101, 500):
        got = pairs.allocate(src, n).collect()
        assert sum(r.cuota for r in got) == max(n, 30 * len(got))


def test_audit(spark):
    v = spark.createDataFrame(
        [(1, "x", "a" * 64, "valido", Decimal("1.00")), (1, None, "a" * 64, "nada", Decimal("-1.00"))],
        "id_comprobante int, id_usuario string, hash_documento string, estado_actual string, monto decimal(15,2)",
    )
    got = {r.regla: r.violaciones for r in audit.audit_constraints({"comprobantes": v}).collect()}
    assert got["estado_actual"] == 1 and got["monto_no_negativo"] == 1 and got["usuario_no_nulo"] == 1
    assert got["unico_hash_documento"] == 1 and "imagen_larga" not in got


def test_confusion_is_zero_filled(spark):
    r = spark.createDataFrame([("no_duplicado", "valido"), ("otro", "valido"), ("no_duplicado", "nada")],
                              "clasificacion_esperada string, prediction string")
    got = {x.clasificacion_esperada: (x.duplicado, x.sospechoso, x.valido) for x in evaluation.confusion(r).collect()}
    assert got == {"duplicado_exacto": (0, 0, 0), "duplicado_parcial": (0, 0, 0), "no_duplicado": (0, 0, 1)}


def test_truth_folder(spark, tmp_path):
    record = {"schema_version": "2.0", "id": "mx-001", "monto": 3000.0, "synthetic": None,
              "extended": {"pais": "MX", "comision": 1.5}}
    (tmp_path / "mx-001.json").write_text(json.dumps(record, indent=2))
    (tmp_path / "other.json").write_text(json.dumps({**record, "id": "mx-002"}))
    (tmp_path / "noid.json").write_text(json.dumps({"monto": 1.0}))
    (tmp_path / "bad.json").write_text("{broken")
    good, bad = readers.read_truth(spark, str(tmp_path))
    assert {r.key for r in good.collect()} == {"mx-001", "mx-002", "noid"}
    assert {r.key for r in readers.addressable(good).collect()} == {"mx-001", "mx-002", "noid", "other"}
    assert [r.stem for r in bad.collect()] == ["bad"]
    assert reports.domestic(good).count() == 2


def test_document_folder(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"x")
    (tmp_path / "b.PDF").write_bytes(b"%PDF-1.7 y")
    (tmp_path / "c.jpg").write_bytes(b"")
    (tmp_path / "d.jpg").write_bytes(b"plain text")
    (tmp_path / "e.txt").write_bytes(b"ignored")
    good, bad = readers.read_documents(spark, str(tmp_path))
    assert {r.file: r.mime for r in good.collect()} == {"a.png": "image/png", "b.PDF": "application/pdf"}
    assert {r.file: r.motivo for r in bad.collect()} == {"d.jpg": "bad_type"}


def test_csv_readers_and_annotations(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id_a,id_b\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_pairs_csv(spark, str(tmp_path / "p.csv"))
    (tmp_path / "acc.csv").write_text("image_id,match_total,gt_total,match_date,gt_date\na, True ,1.0,,\n")
    row = readers.read_accuracy_csv(spark, str(tmp_path / "acc.csv")).first()
    assert row.match_total is True and row.match_date is None and row.gt_date is None
    (tmp_path / "x.txt").write_text("total: 1\nTotal : 2:3 \nplain\nDATE:\t01/02/2024\r\n")
    got = readers.read_annotations(spark, str(tmp_path)).first()
    assert (got.image_id, got.total, got.date) == ("x", "2:3", "01/02/2024")


def test_truth_writer_drops_internal_fields(spark, tmp_path):
    df = spark.range(1).select(
        F.lit("a").alias("id"), F.struct(F.lit("MX").alias("pais"), F.lit(1).alias("_seed")).alias("extended")
    )
    writers.write_truth_json(df, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).select("extended.*").columns == ["pais"]


def test_store_is_idempotent(spark):
    rows = [(1, b"abc", "png", datetime(2024, 3, 1)), (2, b"abc", "png", datetime(2024, 2, 1)), (3, b"", "png", datetime(2024, 2, 1))]
    docs = spark.createDataFrame(rows, "id_comprobante int, content binary, ext string, fecha_registro timestamp")
    stored = store.stored_documents(docs)
    got = stored.collect()
    assert [r.id_comprobante for r in got] == [2] and got[0].path.startswith("2024/02/")
    assert store.stored_documents(docs, held=stored).count() == 0


def test_account_flag(spark):
    df = spark.createDataFrame([("032180000118359719",), ("032180000118359718",), ("12",), (None,)], "x string")
    assert [r[0] for r in df.select(text_functions.clabe_is_valid("x")).collect()] == [True, False, False, False]


@pytest.mark.parametrize("n_files,n_ids", [(7, 4), (4, 7), (3, 0)])
def test_files_matched_by_position_with_unequal_lists(spark, n_files, n_ids):
    files = spark.createDataFrame([(f"scan-{i:02}.jpg", f"scan-{i:02}") for i in range(n_files)], "file string, stem string")
    truth = spark.createDataFrame(
        [(f"g{i:02}", "" if i == 2 else "BCP", 1.0, None) for i in range(n_ids)],
        "id string, banco_emisor string, monto double, fecha string",
    )
    got = {(r.file, r.gt_id) for r in pairs.match_sources(files, truth).collect()}
    # a record without a bank takes its place but is left out; what has no counterpart drops out
    assert got == {(f"scan-{i:02}.jpg", f"g{i:02}") for i in range(min(n_files, n_ids)) if i != 2}


def test_term_counts_are_packed_and_repeated_keys_add_up(spark):
    texts = spark.createDataFrame(
        [(1, "pago pago banco"), (2, "pago banco ño_ñ"), (3, "a"), (4, None), (5, "pago"), (5, "Banco banco pago")],
        "text_key long, text string",
    )
    held = {r.text_key: r for r in textpairs.term_counts(texts).collect()}
    # 16 bytes a distinct term; nothing for texts without terms
    assert {k: (len(r.counts) // 16, r.total) for k, r in held.items()} == {1: (2, 5), 2: (3, 3), 5: (2, 8)}
    pairs = spark.createDataFrame([(1, 2), (1, 5), (1, 3), (1, 4)], "key_a long, key_b long")
    got = {(r.key_a, r.key_b): r.s_text for r in textpairs.text_pair_similarity(pairs, texts).collect()}
    assert set(got) == {(1, 2), (1, 5)}
    assert got[1, 5] == pytest.approx(6 / (5**0.5 * 8**0.5))


def test_shared_terms_agree_in_both_digests():
    import random

    import numpy as np

    rng = random.Random(4)
    for _ in range(40):
        sides = []
        for _ in range(2):
            # few first digests, so that some are told apart by the second alone
            held = {(rng.randint(-9, 9), rng.randint(0, 2)): rng.randint(1, 5) for _ in range(rng.choice([0, 1, 8, 30]))}
            keys = sorted(held)
            packed = (
                np.array([k[0] for k in keys], dtype=np.int64).tobytes()
                + np.array([k[1] for k in keys], dtype=np.uint32).tobytes()
                + np.array([held[k] for k in keys], dtype=np.uint32).tobytes()
            )
            sides.append((held, textpairs._unpacked(packed)))
        (a, left), (b, right) = sides
        x, y = textpairs._shared(left, right)
        assert sorted(zip(x.tolist(), y.tolist())) == sorted((a[k], b[k]) for k in a.keys() & b.keys())
