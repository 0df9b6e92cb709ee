"""Golden tables of the column functions."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from slipstone.functions import amounts, banks, dates, documents, extract, metrics, similarity, text


def one(spark, schema, rows, column):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in frame.orderBy("i").select(column).collect()]


def test_parse_amount(spark):
    cases = [
        ("1,234.56", "1234.56"), ("$ 1,234.56 MXN", "1234.56"), ("1,000,000.00", "1000000.00"),
        ("1,234", "1234.00"), ("0", "0.00"), ("500.", "500.00"), (None, None), ("  ", None),
        ("abc", None), ("$", None), ("MXN", None), ("1.2.3", None), ("-100", None), ("12-3", None),
    ]
    got = one(spark, "x string", [(a,) for a, _ in cases], amounts.parse_amount("x"))
    assert got == [None if b is None else Decimal(b) for _, b in cases]


def test_lenient_amount(spark):
    cases = [
        ("3,000.MXN", 3000.0), ("4,651.23 MN", 4651.23), ("$500.00 MXN", 500.0),
        ("3.675,00", 3675.0), ("−263", -263.0), (None, 0.0), ("x", 0.0), ("1,5,0", 150.0),
    ]
    assert one(spark, "x string", [(a,) for a, _ in cases], amounts.lenient_amount("x")) == [
        b for _, b in cases
    ]


def test_parse_date(spark):
    cases = [
        ("01/05/2026", date(2026, 5, 1)), ("31/12/2025", date(2025, 12, 31)),
        ("2026-05-01", date(2026, 5, 1)), ("01-05-2026", date(2026, 5, 1)),
        ("1 May 2026", date(2026, 5, 1)), ("01/02/2026", date(2026, 2, 1)),
        ("32/13/2026", None), ("no es fecha", None), ("22/Feb/2022", date(2022, 2, 22)),
        ("21/Nov/2024", date(2024, 11, 21)), ("29/01/23", date(2023, 1, 29)),
        ("20/Ago/2022", None), ("2026-05-01 10:00", date(2026, 5, 1)),
        ("05/20/2026", date(2026, 5, 20)), ("30/02/2026", None), ("", None), (None, None),
        ("May 2026", None), ("3 September 2024", date(2024, 9, 3)),
    ]
    assert one(spark, "x string", [(a,) for a, _ in cases], dates.parse_date("x")) == [
        b for _, b in cases
    ]


def test_parse_truth_date(spark):
    cases = [
        ("2024-05-01T10:00", date(2024, 5, 1)), ("18/04/2026", date(2026, 4, 18)),
        ("04/18/2026", date(2026, 4, 18)), ("18-04-2026", date(2026, 4, 18)), ("x", None),
    ]
    assert one(spark, "x string", [(a,) for a, _ in cases], dates.parse_truth_date("x")) == [
        b for _, b in cases
    ]


def test_reference(spark):
    cases = [
        ("ref-123", "REF-123"), ("REF   456", "REF 456"), (" a\t\nb ", "A B"),
        ("REF-123/A", "REF-123/A"), ("  ", None), (None, None),
    ]
    assert one(spark, "x string", [(a,) for a, _ in cases], text.normalize_reference("x")) == [
        b for _, b in cases
    ]


def test_banks(spark):
    cases = [
        ("BBVA Bancomer", "BBVA"), ("BBVA México", "BBVA"), ("Banamex", "Citibanamex"),
        ("Santandar", "Santander"), ("Banortte", "Banorte"), ("nubank", "Nu Bank"),
        ("Wells Fargo", "OTRO"), ("hello", "OTRO"), ("", "OTRO"), (None, "OTRO"),
        ("CITI", "Citibanamex"), ("Hey", "Hey Banco"), ("Ｈ.S.B.C", "HSBC"),
        ("a" * 200, "OTRO"),
    ]
    assert one(spark, "x string", [(a,) for a, _ in cases], banks.normalize_bank("x")) == [
        b for _, b in cases
    ]


def test_hash_and_store(spark):
    empty = one(spark, "x binary", [(b"",)], documents.document_hash("x"))[0]
    assert empty.startswith("e3b0c442") and empty.endswith("b855")
    good = "a" * 64
    rows = [(5, good, "PNG", 3), (5, "A" * 64, "png", 3), (5, good + "\n", "png", 3),
            (5, good, "gif", 3), (5, good, ".jpg", 0), (5, good, "pdf", 13), (0, good, "pdf", 1)]
    schema = "n int, h string, e string, m int"
    assert one(spark, schema, rows, documents.store_problem("n", "h", "e", "m")) == [
        None, "bad_hash", "bad_hash", "bad_extension", "bad_month", "bad_month", "empty"
    ]
    assert one(spark, schema, rows[:1], documents.store_path("h", "e", F.lit(2024), "m")) == [
        f"2024/03/{good}.png"
    ]


def test_response(spark):
    def wrap(content):
        import json

        return json.dumps({"choices": [{"message": {"content": content}}]})

    rows = [(wrap('{"monto": 12.5, "fecha": null}'),), (wrap('```json\n{"banco": "BBVA"}\n```'),),
            (wrap("not json"),), (wrap("[1, 2]"),), ('{"x": 1}',)]
    assert one(spark, "x string", rows, documents.response_problem("x")) == [
        None, None, "bad_json", "not_object", "bad_structure"
    ]
    got = one(spark, "x string", rows, documents.response_fields("x"))
    assert got[0]["monto"] == "12.5" and got[0]["fecha"] is None and got[1]["banco"] == "BBVA"
    assert got[2] is None


def test_similarities(spark):
    D = Decimal
    pairs = [(D("5.00"), D("5.00"), 1.0), (D("0"), D("0"), 1.0), (None, D("1"), 0.0), (D("1"), D("10"), 0.1)]
    got = one(spark, "a decimal(15,2), b decimal(15,2)", [p[:2] for p in pairs], amounts.amount_similarity("a", "b"))
    assert got == pytest.approx([p[2] for p in pairs])
    day = date(2024, 1, 1)
    days = [(day, date(2024, 1, 1), 1.0), (day, date(2024, 1, 16), 0.5), (day, date(2024, 1, 31), 0.0),
            (day, date(2025, 1, 1), 0.0), (None, day, 0.0)]
    assert one(spark, "a date, b date", [p[:2] for p in days], dates.date_similarity("a", "b")) == pytest.approx(
        [p[2] for p in days]
    )
    assert one(spark, "s double", [(0.90,), (0.89,), (0.75,), (0.74,)], similarity.classify("s")) == [
        "duplicado", "sospechoso", "sospechoso", "valido"
    ]


REFS = [
    ("santander", "santandar", 0.888889), ("TRF-001", "TRF-002", 0.857143),
    ("kitten", "sitting", 0.615385), ("abc", "xyz", 0.0), ("", "a", 0.0), (None, "a", 0.0),
    ("a" * 70 + "b" * 30, "b" * 30 + "a" * 70, 0.7), ("x" * 64, "x" * 64, 1.0), ("é1", "é2", 0.5),
]


def test_indel_engines_agree(spark):
    rows = [r[:2] for r in REFS]
    fast = one(spark, "a string, b string", rows, similarity.indel_ratio("a", "b"))
    builtin = one(spark, "a string, b string", rows, similarity.indel_ratio_sql("a", "b"))
    assert fast == pytest.approx([r[2] for r in REFS], abs=1e-6)
    assert builtin == pytest.approx(fast, abs=1e-12)


def test_reference_bounds_hold(spark):
    import random

    rng = random.Random(3)
    rows = [("".join(rng.choices("AB01-", k=rng.randint(0, 12))), "".join(rng.choices("AB01-", k=rng.randint(0, 12))))
            for _ in range(400)]
    low, top = similarity.reference_bounds("a", "b")
    got = one(spark, "a string, b string", rows, F.struct(low.alias("l"), similarity.indel_ratio("a", "b").alias("x"), top.alias("t")))
    assert all(g.l - 1e-12 <= g.x <= g.t + 1e-12 for g in got)


def test_sequence_ratio(spark):
    from difflib import SequenceMatcher

    rows = [("abcd", "bcde"), ("REF-1", "REF-2"), (None, "x")]
    want = [SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in rows]
    assert one(spark, "a string, b string", rows, similarity.sequence_ratio("a", "b")) == want


def test_masking(spark):
    import hashlib

    def ref(code):
        return "REF-" + hashlib.sha256(code.encode()).hexdigest()[:8].upper()

    raw = "CLABE 012180015512345678, card 4152-3134 5678 9012; code ABCD1234 ABCD1234 éABCD1234 short AB12"
    want = f"CLABE ****5678, card ****9012; code {ref('ABCD1234')} {ref('ABCD1234')} éABCD1234 short AB12"
    assert one(spark, "x string", [(raw,)], extract.mask_personal_data("x")) == [want]


def test_labelled_fields(spark):
    doc = (
        "Número de referencia: 33426\n#154709419317\nConcepto de pago: renta \nEstatus: Aceptada\n"
        "De ****8919 a ****5381\nTOTAL COMISIÓN: M.N. $12.50\nIVA: $2.00\n"
        "  - MONTO : M.N. $ 600.00\nPAGO TOTAL. M.N. $ 614.50\nOperación: SPEI\n10:45:00"
    )
    check = lambda col: one(spark, "x string", [(doc,)], col)[0]
    assert check(extract.found_or_blank("x", extract.REFERENCE_NUMBER)) == "33426"
    assert check(extract.found_or_blank("x", extract.VOUCHER_NUMBER)) == "154709419317"
    assert check(extract.rest_of_line("x", extract.CONCEPT)) == "renta"
    assert check(extract.rest_of_line("x", extract.STATUS, "exitosa")) == "Aceptada"
    assert check(extract.masked_account("x", 1)) == "****5381"
    assert check(amounts.lenient_amount(extract.found("x", extract.FEE))) == 12.5
    assert check(extract.net_amount(F.lit(None).cast("string"), F.lit("9"), F.col("x"))) == 600.0
    assert check(extract.total_amount(F.lit(None).cast("string"), F.lit("9"), F.col("x"))) == 614.5
    assert check(extract.hour_of(F.lit(""), F.lit(""), F.col("x"))) == "10:45"


def test_accounts_and_display(spark):
    account = "012180015512345678"
    digit = one(spark, "x string", [(account,)], text.clabe_check_digit(F.substring("x", 1, 17)))[0]
    weights = [3, 7, 1] * 6
    want = (10 - sum(int(a) * w for a, w in zip(account[:17], weights)) % 10) % 10
    assert digit == want
    assert one(spark, "x string", [(account,)], text.mask_account("x")) == ["•" * 13 + "5678"]
    assert one(spark, "d date", [(date(2024, 6, 2),)], dates.long_spanish_date("d")) == ["02 DE JUNIO DEL 2024"]
    assert one(spark, "x decimal(15,2)", [(Decimal("1234.50"),)], amounts.format_money("x")) == ["$1,234.50"]
    assert one(spark, "x string", [("Banco Azteca!",)], text.slug("x")) == ["banco-azteca"]


def test_ratios(spark):
    rows = [(1.0, 2.0), (1.0, 0.0)]
    assert one(spark, "a double, b double", rows, metrics.safe_div("a", "b")) == [0.5, 0.0]
    assert one(spark, "a int, b int", [(45, 50), (900, 50), (5, -1)], metrics.capped_percent("a", "b")) == [90, 100, 0]
