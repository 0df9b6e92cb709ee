"""White space, strict parsing, whole histories and owners: cases the fixtures avoid."""

import json
from datetime import date, datetime

from pyspark.sql import functions as F

from slipstone.functions import dates, documents, extract, text
from slipstone.operators import layers, workflow
from slipstone.sources import readers


def one(spark, value, column):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], "x string").select(column).collect()]


def test_white_space_of_any_kind_is_stripped(spark):
    assert one(spark, ["\tA1\r\n", "\t", " b "], text.reference_of("x", F.lit(None).cast("string"))) == ["A1", None, "b"]
    assert one(spark, ["Concepto: renta\r\n"], extract.rest_of_line("x", r"Concepto:([^\n]*)")) == ["renta"]
    assert one(spark, ["a", "\n\t"], text.joined_values("x", F.lit("z"))) == ["a z", "z"]


def test_dates_with_zone_tab_and_two_digit_years(spark):
    got = one(spark, ["\t2024-03-05", "2024-03-05T10:11:12Z", "2024-03-05 10:11+02:00", "31/12/99", "05/03/24"], dates.parse_date("x"))
    assert got == [date(2024, 3, 5)] * 3 + [date(1999, 12, 31), date(2024, 3, 5)]


def test_responses_are_one_whole_json_value(spark):
    def reply(content):
        return json.dumps({"choices": [{"message": {"content": content}}]})

    bodies = ['\n```json\n{"monto": "5"}\n```', '{"monto": "5"} trailing', '{"a":1} {"b":2}', '{"a":1}, {"b":2}', '{"a":1}] t', '{"a":1}} t', "[1]"]
    assert one(spark, [reply(b) for b in bodies], documents.response_problem("x")) == [None] + ["bad_json"] * 5 + ["not_object"]


def test_ligatures_and_styled_letters_fold(spark):
    assert one(spark, ["oﬁcina", "\U0001d400b", "É-1", None], text.match_key("x")) == ["oficina", "ab", "e1", None]


def test_mixed_case_extensions_and_quoted_amounts(spark, tmp_path):
    (tmp_path / "Foto.Jpg").write_bytes(b"\xff\xd8\xff1")
    assert [r.file for r in readers.scan_documents(spark, str(tmp_path)).collect()] == ["Foto.Jpg"]
    folder = tmp_path / "truth"
    folder.mkdir()
    (folder / "a.json").write_text('{"id": "a", "monto": "1,234.00", "fecha": 5}')
    (folder / "b.json").write_text("{broken")
    good, bad = readers.read_truth(spark, str(folder))
    row = good.first()
    assert (row.key, row.monto) == ("a", 1234.0) and [r.stem for r in bad.collect()] == ["b"]


def test_every_request_gets_a_verdict_in_order(spark, monkeypatch):
    monkeypatch.setattr(workflow, "CHUNK", 3)
    targets = ["procesando", "valido", "comparando", "sospechoso", "en_revision", "recibido", "valido", "error"] * 4
    requests = [("v1", t, datetime(2024, 1, 1, 0, i), f"e{i:02d}") for i, t in enumerate(targets)]
    requests.append(("gone", "valido", datetime(2024, 1, 1), "x"))
    v = spark.createDataFrame([("v1", "recibido")], "id_comprobante string, estado_actual string")
    frame = spark.createDataFrame(requests, "id_comprobante string, hacia string, fecha timestamp, event_id string")
    from slipstone import vocab

    state, expected = "recibido", {}
    for i, target in enumerate(targets):
        legal = (state, target) in vocab.TRANSITIONS
        expected[f"e{i:02d}"] = (state, target, legal)
        state = target if legal else state
    got = {r.event_id: (r.desde, r.hacia, r.legal) for r in workflow.request_verdicts(v, frame).collect()}
    assert got.pop("x") == (None, "valido", False)
    assert got == expected
    applied, refused = workflow.apply_requests(v, frame)
    assert applied.first().estado_actual == state
    assert refused.count() == sum(not e[2] for e in expected.values()) + 1


def test_invalid_actions_and_foreign_decisions_block_nothing(spark):
    v = spark.createDataFrame(
        [(1, "en_revision", "o1", None)], "id_comprobante int, estado_actual string, id_organizacion string, deleted_at timestamp"
    )
    d = spark.createDataFrame(
        [(1, 1, "u", "otro", datetime(2024, 1, 1), "o1"), (2, 1, "u", "aceptar", datetime(2024, 1, 2), "o2"),
         (3, 1, "u", "aceptar", datetime(2024, 1, 3), "o1"), (4, 1, "u", "rechazar", datetime(2024, 1, 4), "o1")],
        "event_id int, id_comprobante int, id_usuario string, accion string, fecha timestamp, id_organizacion string",
    )
    updated, added, refused = workflow.apply_decisions(v, d)
    assert [r.estado_actual for r in updated.collect()] == ["valido"] and added.count() == 1
    assert {r.event_id: r.motivo_rechazo for r in refused.collect()} == {1: "accion_invalida", 2: "no_encontrado", 4: "ya_decidido"}


def test_rows_without_hash_and_stores_with_a_hash_twice(spark):
    schema = "id_comprobante string, hash_documento string, fecha_registro timestamp"
    when = datetime(2024, 1, 1)
    new = spark.createDataFrame([("a", None, when), ("b", None, when), ("c", "h", when), ("d", "k", when)], schema)
    store = spark.createDataFrame([("s2", "h", when), ("s1", "h", when)], schema)
    kept, rejected = layers.layer1(new, store)
    assert [r.id_comprobante for r in kept.collect()] == ["d"]
    got = {r.id_comprobante: (r.id_existente, r.metodo_deteccion) for r in rejected.collect()}
    assert got == {"a": (None, "sin_hash"), "b": (None, "sin_hash"), "c": ("s1", "hash_exacto")} and rejected.count() == 3
