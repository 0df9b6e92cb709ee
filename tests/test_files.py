"""Files per record, document streams, pages at any offset, SQL functions, audits of all tables."""

import datetime as dt
import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from slipstone.functions import sql
from slipstone.operators import audit
from slipstone.operators.pages import build_page_index, open_page_index
from slipstone.sources import readers
from slipstone.sources.record_files import write_records, write_truth_files


@pytest.fixture
def folder(tmp_path):
    return f"{tmp_path}/{uuid.uuid4().hex}"


def test_records_are_whole_files_and_bad_ones_are_named(spark, folder):
    rows = [("a.json", "x"), ("lote/b.json", "é" * 1000), ("", "x"), (None, "x"), ("..", "x"), ("a/b/c.txt", "x"), (".hid", "x"),
            ("no.json", None), ("dos.json", "1"), ("dos.json", "2"), ("igual.json", "3"), ("igual.json", "3")]
    frame = spark.createDataFrame([(n, b, 1) for n, b in rows], "archivo string, cuerpo string, sha256 int").repartition(3)
    for _ in range(2):  # a second run writes the same files again
        done = write_records(frame, folder).collect()
    reasons = {(r.archivo, r.motivo) for r in done}
    assert {("", "mal_nombre"), (None, "mal_nombre"), ("..", "mal_nombre"), ("a/b/c.txt", "mal_nombre"), (".hid", "mal_nombre"),
            ("no.json", "sin_contenido"), ("dos.json", "repetido"), ("dos.json", None), ("a.json", None)} <= reasons
    found = sorted(os.path.relpath(os.path.join(p, f), folder) for p, _, fs in os.walk(folder) for f in fs if not f.endswith(".crc"))
    assert found == ["a.json", "dos.json", "igual.json", "lote/b.json"]
    assert {r.archivo: r.bytes for r in done if r.motivo is None}["lote/b.json"] == 2000
    assert write_records(frame.limit(0), folder).count() == 0


def test_truth_files_come_back_by_key_and_stem(spark, folder):
    truth = spark.createDataFrame(
        [("t1", "uno", 5.0, ("MX", "x")), (None, "dos", None, ("AR", None))],
        "id string, stem string, monto double, extended struct<pais: string, _oculto: string>",
    )
    write_truth_files(truth, folder)
    assert "_oculto" not in json.load(open(f"{folder}/uno.json"))["extended"]
    with open(f"{folder}/roto.json", "w") as out:
        out.write("{")
    good, bad = readers.read_truth(spark, folder)
    keys = {(r.key, r.stem, r.monto) for r in readers.addressable(good).collect()}
    assert keys == {("t1", "uno", 5.0), ("uno", "uno", 5.0), ("dos", "dos", None)}
    assert [r.stem for r in bad.collect()] == ["roto"]


def test_document_stream_guards_by_size_before_content(spark, folder):
    rows = [("a.PDF", b"%PDF-1"), ("b.png", b"nada"), ("c.txt", b"%PDF-2"), ("d.jpg", b"\xff\xd8\xff" + b"0" * (10 * 1024 * 1024))]
    write_records(spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "archivo string, cuerpo binary"), folder)
    source = readers.document_stream(spark, folder, files_per_batch=1)
    run = (source.writeStream.format("parquet").option("path", f"{folder}-out").option("checkpointLocation", f"{folder}-check")
           .trigger(availableNow=True).start())
    run.awaitTermination(120)
    got = {r.archivo: (r.mime, r.motivo, r.hash_documento is not None) for r in spark.read.parquet(f"{folder}-out").collect()}
    assert got == {"a.PDF": ("application/pdf", None, True), "b.png": (None, "bad_type", False), "d.jpg": (None, "too_large", False)}


def test_any_page_reads_its_runs_only(spark, folder):
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame(
        [(i, start + dt.timedelta(minutes=i // 3), f"v{i}") for i in range(1000)],
        "id_comprobante long, fecha_registro timestamp, nota string",
    )
    index = build_page_index(rows.repartition(5), folder, run_rows=100)
    want = sorted(range(1000), key=lambda i: (-(i // 3), -i))
    for offset in (0, 95, 900, 990, 1000, 5000):
        assert [r.id_comprobante for r in index.page(20, offset).collect()] == want[offset : offset + 20]
    assert index.total == 1000 and index.page(0, 5).count() == 0
    read = index.page(20, 900).inputFiles()
    assert 0 < len(read) <= 3
    again = open_page_index(spark, folder, rows.schema)
    assert [r.id_comprobante for r in again.page(3, 500).collect()] == want[500:503]
    empty = build_page_index(rows.limit(0), f"{folder}-none")
    assert empty.total == 0 and empty.page(10, 0).count() == 0


def test_functions_in_sql_run_without_python(spark):
    assert sql.register(spark) == sql.register(spark)
    row = spark.sql("""SELECT slip_amount('$1,200.50') AS a, slip_amount('1.2.3') AS b, slip_date('5/Feb/2024') AS c, slip_reference('  r  1 ') AS d,
        slip_class(0.8D) AS e, slip_amount_similarity(1D, 2D) AS f, slip_mime(unhex('FFD8FF00')) AS g, slip_slug('Año Nuevo!') AS h,
        slip_amount(NULL) AS i, slip_within(1.00, 1.01) AS j, slip_date_similarity(DATE'2024-01-01', DATE'2024-01-16') AS k""").first()
    assert (str(row.a), row.b, str(row.c), row.d, row.e, row.f, row.g, row.i, row.j, row.k) == (
        "1200.50", None, "2024-02-05", "R 1", "sospechoso", 0.5, "image/jpeg", None, True, 0.5)
    spark.range(3).select(F.col("id").cast("string").alias("x")).createOrReplaceTempView("textos")
    plan = spark.sql("SELECT slip_amount(x), slip_date(x) FROM textos")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_audit_counts_add_up_and_use_one_exchange(spark):
    users = spark.createDataFrame([(1, 7, "a"), (2, 7, "a"), (3, 8, None), (3, 7, "b")], "id_usuario long, id_organizacion long, correo string")
    orgs = spark.createDataFrame([(7,), (9,)], "id_organizacion long")
    slips = spark.createDataFrame([(i, i % 5, f"h{i % 4}") for i in range(10)], "id_comprobante long, id_usuario long, hash_documento string")
    tables = {"usuarios": users, "organizaciones": orgs, "comprobantes": slips}
    want = {("comprobantes", "unico_id_comprobante"): 0, ("comprobantes", "unico_hash_documento"): 6, ("usuarios", "unico_id_usuario"): 1,
            ("usuarios", "unico_correo"): 1, ("organizaciones", "unico_id_organizacion"): 0, ("comprobantes", "huerfano_id_usuario"): 4,
            ("usuarios", "huerfano_id_organizacion"): 1}
    counts = audit.key_counts(tables)
    told = lambda c: {(r.tabla, r.regla): r.violaciones for r in audit.key_violations(c, tables).collect()}
    assert told(counts) == want
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    halves = [audit.key_counts({**{t: df.limit(0) for t, df in tables.items()}, "comprobantes": slips.filter(f"id_comprobante % 2 = {k}")}) for k in (0, 1)]
    rest = audit.key_counts({**tables, "comprobantes": slips.limit(0)})
    assert told(audit.merged_counts(audit.merged_counts(rest, halves[0]), halves[1])) == want
    twice = told(audit.merged_counts(rest, audit.merged_counts(halves[0], halves[0])))
    assert twice[("comprobantes", "unico_id_comprobante")] == 5 and twice[("usuarios", "unico_id_usuario")] == 1


def test_small_files_are_written_and_read_by_tasks_that_follow_the_cores(spark, folder, monkeypatch):
    monkeypatch.setattr(readers, "TASKS_PER_CORE", 1)
    rows = spark.range(300).coalesce(1).select(
        F.format_string("d%d.json", "id").alias("archivo"),
        F.when(F.col("id") == 7, '{"id": ').otherwise(F.format_string('{"id": "k%d", "monto": 1.5}', "id")).alias("cuerpo"),
    )
    done = write_records(rows, folder)
    assert done.filter("motivo is null").count() == 300 and len(done.inputFiles()) > 1
    found = readers.scan_documents(spark, folder, ("json",))
    assert found.count() == 300 and found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    good, bad = readers.read_truth(spark, folder)
    # the files themselves are opened once, whatever is asked of both results
    assert not [f for f in (*good.inputFiles(), *bad.inputFiles()) if folder in f]
    assert good.filter("key = concat('k', substr(stem, 2)) and monto = 1.5").count() == 299
    assert [r.stem for r in bad.collect()] == ["d7"]
