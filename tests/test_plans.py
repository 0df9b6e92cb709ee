"""Plans: filters and columns reach the scan, no nested-loop joins; queries match their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import normal
from slipstone import schemas
from slipstone.operators import keyed, layers, reports, store
from slipstone.plans.fixtures import TABLES, view


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "v")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    view(spark, sf_dir, "v_vouchers").write.parquet(path)
    return spark.read.parquet(path)


def test_history_pushes_filters_and_prunes_columns(stored):
    page = reports.history(stored, user=5, bank="BBVA", states=["valido"])
    plan = plan_of(store.list_view(page.items))
    pushed = plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert "EqualTo(id_usuario,5)" in pushed and "EqualTo(banco,BBVA)" in pushed
    assert "IsNull(deleted_at)" in pushed and "EqualTo(estado_actual,valido)" in pushed
    assert "texto_extraido" not in plan.split("ReadSchema:")[1]


def test_no_nested_loop_joins(stored):
    hot = keyed.attach_first(stored, ["referencia"], ["fecha_registro", "id_comprobante"], "f")
    for df in (hot, layers.layer1(stored)[0], layers.layer2(stored), layers.candidate_counts(stored)):
        plan = plan_of(df)
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_layer2_does_not_read_texts(stored):
    assert "texto_extraido" not in plan_of(layers.layer2(stored))


SLOW = ("j4_", "w1_", "m3_", "m4_", "m5_", "m7_cascade", "t2_", "t7_", "u1_", "u2_", "w7_", "w5_")
QUICK = [n for n in entry.oracle_sql() if not n.startswith(SLOW)]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, duck, sf_dir, name):
    frame = entry.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    theirs = [c[0] for c in cursor.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    want = sorted((tuple(normal(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(normal(r[c]) for c in columns) for r in frame.collect()), key=repr)
    assert got == want


def test_entry(spark):
    rows = {r.estado_actual: r.total for r in entry.entry(spark).collect()}
    assert set(rows) <= {"valido", "duplicado", "en_revision"} and sum(rows.values()) == 1462


def test_names_and_schemas():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(schemas.TABLES) >= {"comprobantes", "validaciones", "usuarios"}
