"""Every operator as a named query over the driver tables, with its independent SQL check.

``QUERIES[name](spark, sf_dir)`` runs the Spark operator on whole tables; ``ORACLE[name]`` is
DuckDB SQL for the same result (absent where SQL cannot express it).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..config import ScoringConfig
from ..functions import amounts, banks, dates, documents, extract, metrics, similarity, sql, text
from ..operators import evaluation, store, textpairs
from ..session import shared_dir
from ..sources import readers, record_files, writers
from .fixtures import duck, table, view
from .oracle_parts import CLASS, cosine_ctes, indel, s_fecha, s_monto

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

AS_OF = date(1998, 7, 15)
UPLOAD_AS_OF = date(2024, 1, 31)


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


# --- sources and sinks -------------------------------------------------------------------------

GUARD = ("CASE WHEN strlen(text) = 0 THEN 'empty' WHEN strlen(text) > 10485760 THEN 'too_large' END")


@query("s1_document_guard", f"""
SELECT doc_id, strlen(text) AS bytes, {GUARD} AS motivo FROM documents""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return store.document_guard(docs).select("doc_id", "bytes", "motivo")


@query("s2_directory_scan")
def _(spark, d):
    return readers.scan_documents(spark, d, ("parquet",)).select("file", "stem", "bytes")


@query("s3_truth_folder", f"""
WITH t AS (SELECT *, CASE WHEN ord % 10 = 0 THEN concat('f', CAST(ord AS VARCHAR)) ELSE id END AS stem FROM {duck('v_truth')} q)
SELECT id AS clave, stem, CAST(monto AS DOUBLE) AS monto, pais, TRUE AS legible FROM t
UNION ALL SELECT stem, stem, CAST(monto AS DOUBLE), pais, TRUE FROM t WHERE stem <> id
UNION ALL SELECT NULL, concat('roto', CAST(i AS VARCHAR)), NULL, NULL, FALSE FROM range(4) r(i)""")
def _(spark, d):
    folder = f"{shared_dir(spark)}/truth-{uuid.uuid4().hex}"
    truth = view(spark, d, "v_truth").select(
        "id", F.col("monto").cast("double").alias("monto"), "fecha",
        F.struct("pais", F.lit("x").alias("_interno")).alias("extended"),
        F.when(F.col("ord") % 10 == 0, F.concat(F.lit("f"), F.col("ord").cast("string"))).otherwise(F.col("id")).alias("stem"),
        (F.col("ord") % 4).alias("lote"),
    )
    record_files.write_truth_files(truth, folder, lot="lote")
    # a file in every folder that is no JSON
    broken = spark.range(4).select(F.format_string("%d/roto%d.json", "id", "id").alias("archivo"), F.lit('{"id": ').alias("cuerpo"))
    record_files.write_records(broken, folder)
    good, bad = readers.read_truth(spark, f"{folder}/*")
    return readers.addressable(good).select(
        F.col("key").alias("clave"), "stem", "monto", F.col("extended.pais").alias("pais"), F.lit(True).alias("legible")
    ).unionByName(bad.select(
        F.lit(None).cast("string").alias("clave"), "stem", F.lit(None).cast("double").alias("monto"),
        F.lit(None).cast("string").alias("pais"), F.lit(False).alias("legible"),
    ))


def document_files(spark, d) -> str:
    """The documents as files of three extensions; some have no known type."""
    folder = f"{shared_dir(spark)}/docs-{uuid.uuid4().hex}"
    k = F.col("doc_id")
    ext = F.when(k % 3 == 0, "pdf").when(k % 3 == 1, "PNG").otherwise("jpg")
    record_files.write_records(
        table(spark, d, "documents").select(
            F.format_string("doc-%d.%s", k, ext).alias("archivo"),
            F.concat(F.when(k % 11 == 5, "XX").otherwise("%PDF-"), F.coalesce("text", F.lit(""))).alias("cuerpo"),
        ),
        folder,
    )
    return folder


DOC_FILES = """(SELECT doc_id, concat('doc-', CAST(doc_id AS VARCHAR), '.', CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'PNG' ELSE 'jpg' END) AS archivo,
  concat(CASE WHEN doc_id % 11 = 5 THEN 'XX' ELSE '%PDF-' END, coalesce(text, '')) AS cuerpo, doc_id % 11 <> 5 AS bueno FROM documents)"""


@query("s2_document_folder", f"""
SELECT archivo, CAST(strlen(cuerpo) AS BIGINT) AS bytes, CASE WHEN NOT bueno THEN 'bad_type' END AS motivo,
  CASE WHEN bueno THEN min(doc_id) OVER (PARTITION BY cuerpo) END AS primero FROM {DOC_FILES} f""")
def _(spark, d):
    good, bad = readers.read_documents(spark, document_files(spark, d))
    # back to the table by content: the first document of each hash
    text = F.concat(F.lit("%PDF-"), F.coalesce("text", F.lit("")))
    held = table(spark, d, "documents").filter("doc_id % 11 <> 5").groupBy(
        documents.document_hash(text).alias("hash_documento")
    ).agg(F.min("doc_id").alias("primero"))
    return good.join(held, "hash_documento", "left").select(
        F.col("file").alias("archivo"), "bytes", F.lit(None).cast("string").alias("motivo"), "primero"
    ).unionByName(bad.select(F.col("file").alias("archivo"), "bytes", "motivo", F.lit(None).cast("long").alias("primero")))


@query("s4_pairs_csv_roundtrip", f"""
SELECT id_a, id_b, tipo_duplicado, 'capa_1' AS capa_esperada, clasificacion_esperada,
       concat('nota, "', id_a, '"') AS notas
FROM {duck('v_evalpairs')} p""")
def _(spark, d):
    pairs = view(spark, d, "v_evalpairs").select(
        "id_a", "id_b", "tipo_duplicado", F.lit("capa_1").alias("capa_esperada"),
        "clasificacion_esperada",
        F.concat(F.lit('nota, "'), "id_a", F.lit('"')).alias("notas"),
    )
    path = f"{shared_dir(spark)}/pairs-csv-{spark.sparkContext.applicationId}"
    writers.write_pairs_csv(pairs, path, mode="overwrite")
    return readers.read_pairs_csv(spark, path)


ACC_MATCH = """
  abs(pred_total - gt_total) <= 0.01 AS match_total,
  abs(date_diff('day', gt_date, pred_date)) <= 1 AS match_date"""


@query("s5_accuracy_csv_roundtrip", f"""
SELECT CAST(image_id AS VARCHAR) AS image_id, CAST(gt_total AS VARCHAR) AS gt_total,
       CAST(gt_date AS VARCHAR) AS gt_date, {ACC_MATCH}
FROM {duck('v_accuracy')} a""")
def _(spark, d):
    path = f"{shared_dir(spark)}/accuracy-csv-{spark.sparkContext.applicationId}"
    writers.write_accuracy_csv(_accuracy(spark, d), path, mode="overwrite")
    return readers.read_accuracy_csv(spark, path).select(
        "image_id", "gt_total", "gt_date", "match_total", "match_date"
    )


@query("s6_annotations", f"""
SELECT image_id,
  CASE WHEN image_id % 7 = 0 THEN concat(CAST(image_id AS VARCHAR), ':9')
       WHEN image_id % 5 <> 0 THEN trim(regexp_extract(text, 'Total :([^\\n]*)', 1)) END AS total,
  CASE WHEN image_id % 3 <> 0 THEN trim(regexp_extract(text, 'DATE:([^\\n]*)', 1)) END AS date
FROM {duck('v_annotations')} a""")
def _(spark, d):
    return readers.parse_annotations(view(spark, d, "v_annotations"))


@query("s7_table_scan", f"""
SELECT id_comprobante, id_usuario, monto, fecha_deposito FROM {duck('v_vouchers')} v
WHERE fecha_deposito >= DATE '1996-01-01' AND monto > 100000""")
def _(spark, d):
    return view(spark, d, "v_vouchers").filter(
        "fecha_deposito >= date'1996-01-01' and monto > 100000"
    ).select("id_comprobante", "id_usuario", "monto", "fecha_deposito")


@query("s7_stored_tables", f"""
SELECT CAST(v.id_comprobante AS VARCHAR) AS id_comprobante, v.monto, u.plan, v.estado_actual
FROM {duck('v_vouchers')} v JOIN {duck('v_users')} u USING (id_usuario) WHERE v.monto > 100000 AND u.deleted_at IS NULL""")
def _(spark, d):
    # the store as it is kept: one folder per table, explicit schemas
    root = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    for name, rows in (("comprobantes", view(spark, d, "v_vouchers")), ("usuarios", view(spark, d, "v_users"))):
        fields = StructType.fromDDL(schemas.TABLES[name]).fields
        rows.select(*[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
        ]).write.parquet(f"{root}/{name}")
    held = readers.read_tables(spark, root, ["comprobantes", "usuarios"])
    live = held["usuarios"].filter("deleted_at is null").select("id_usuario", "plan")
    return held["comprobantes"].filter("monto > 100000").join(live, "id_usuario").select(
        "id_comprobante", "monto", "plan", "estado_actual"
    )


@query("s8_insert_if_absent", f"""
SELECT id_comprobante, hash_documento FROM (
  SELECT *, row_number() OVER (PARTITION BY hash_documento ORDER BY fecha_registro, id_comprobante) AS rn
  FROM {duck('v_uploads')} u WHERE event_type <> 'view'
  AND hash_documento NOT IN (SELECT hash_documento FROM {duck('v_uploads')} w WHERE event_type = 'view')) x
WHERE rn = 1""")
def _(spark, d):
    uploads = view(spark, d, "v_uploads")
    new = uploads.filter("event_type <> 'view'")
    held = uploads.filter("event_type = 'view'")
    order = ["fecha_registro", "id_comprobante"]
    return store.insert_if_absent(new, held, "hash_documento", order).select(
        "id_comprobante", "hash_documento"
    )


@query("s9_pending_ids", f"""
SELECT o_orderkey AS image_id FROM orders
WHERE o_orderkey NOT IN (SELECT image_id FROM {duck('v_accuracy')} a WHERE pred_total IS NOT NULL)""")
def _(spark, d):
    every = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    done = view(spark, d, "v_accuracy").filter("pred_total is not null")
    return store.pending(every, done)


@query("s10_metrics_json_roundtrip", """
SELECT event_type AS tipo, count(*) AS total FROM events GROUP BY event_type""")
def _(spark, d):
    counts = table(spark, d, "events").groupBy(F.col("event_type").alias("tipo")).agg(
        F.count(F.lit(1)).alias("total")
    )
    path = f"{shared_dir(spark)}/metrics-json-{spark.sparkContext.applicationId}"
    writers.write_metrics_json(counts, path)
    return spark.read.schema("tipo string, total bigint").json(path)


DOC_EXT = "CASE id_comprobante % 5 WHEN 0 THEN 'PNG' WHEN 1 THEN '.jpg' WHEN 2 THEN 'gif' ELSE 'pdf' END"


@query("s11_store_paths", f"""
SELECT id_comprobante, hash_documento, bytes, year, month,
  concat(lpad(CAST(year AS VARCHAR), 4, '0'), '/', lpad(CAST(month AS VARCHAR), 2, '0'), '/', hash_documento, '.', ext) AS path
FROM (
  SELECT id_comprobante, hash_documento, strlen(text) AS bytes, ltrim(lower({DOC_EXT}), '.') AS ext,
         CAST(year(fecha_registro) AS INTEGER) AS year, CAST(month(fecha_registro) AS INTEGER) AS month,
         row_number() OVER (PARTITION BY hash_documento ORDER BY fecha_registro, id_comprobante) AS rn
  FROM {duck('v_docs')} x WHERE {DOC_EXT} <> 'gif' AND strlen(text) BETWEEN 1 AND 10485760) y
WHERE rn = 1""")
def _(spark, d):
    docs = view(spark, d, "v_docs").withColumnRenamed("text", "content")
    return store.stored_documents(docs.withColumn("ext", F.expr(DOC_EXT))).select(
        "id_comprobante", "hash_documento", "bytes", "year", "month", "path"
    )


@query("s12_enrich_text", f"""
SELECT t.id, CASE WHEN trim(coalesce(t.texto_extraido, '')) = '' THEN coalesce(n.texto_extraido, t.texto_extraido)
            ELSE t.texto_extraido END AS texto_extraido, t.calidad
FROM {duck('v_truth')} t
LEFT JOIN (SELECT id, concat('nuevo ', id) AS texto_extraido FROM {duck('v_truth')} u WHERE ord % 2 = 0) n ON n.id = t.id""")
def _(spark, d):
    truth = view(spark, d, "v_truth")
    offered = truth.filter("ord % 2 = 0").select(
        "id", F.concat(F.lit("nuevo "), "id").alias("texto_extraido")
    )
    return store.enrich_text(truth, offered).select("id", "texto_extraido", "calidad")


@query("s13_truth_json_roundtrip", f"""
SELECT id, CAST(monto AS DOUBLE) AS monto, pais, folio, interno FROM (
  SELECT id, monto, pais, CAST(ord AS VARCHAR) AS folio, CAST(NULL AS VARCHAR) AS interno FROM {duck('v_truth')} t) x""")
def _(spark, d):
    truth = view(spark, d, "v_truth").select(
        "id", F.col("monto").cast("double").alias("monto"),
        F.struct("pais", F.col("ord").cast("string").alias("folio"),
                 F.lit("x").alias("_interno")).alias("extended"),
    )
    path = f"{shared_dir(spark)}/truth-json-{spark.sparkContext.applicationId}"
    writers.write_truth_json(truth, path, mode="overwrite")
    back = spark.read.schema(
        "id string, monto double, extended struct<pais: string, folio: string, _interno: string>"
    ).json(path)
    return back.select(
        "id", "monto", "extended.pais", "extended.folio", F.col("extended._interno").alias("interno")
    )


@query("s14_response_shape", f"""
SELECT id_comprobante, estado_actual, monto, fecha_deposito AS fecha, referencia,
       numero_operacion, coalesce(banco, 'OTRO') AS banco
FROM {duck('v_vouchers')} v""")
def _(spark, d):
    return store.response(view(spark, d, "v_vouchers")).select(
        "id_comprobante", "estado_actual", "campos_extraidos.*"
    )


@query("s15_list_view", f"""
SELECT id_comprobante, imagen_path, referencia, monto, fecha_deposito, banco, estado_actual,
       CAST(epoch(fecha_registro) AS BIGINT) AS registro
FROM {duck('v_vouchers')} v""")
def _(spark, d):
    return store.list_view(view(spark, d, "v_vouchers")).withColumn(
        "registro", F.unix_timestamp("fecha_registro")
    ).drop("fecha_registro")


@query("s15_detail_view", f"""
SELECT id_comprobante, sha256(texto_extraido) AS texto, numero_operacion, estado_actual
FROM {duck('v_vouchers')} v""")
def _(spark, d):
    return store.detail_view(view(spark, d, "v_vouchers")).select(
        "id_comprobante", F.sha2("texto_extraido", 256).alias("texto"), "numero_operacion",
        "estado_actual",
    )


# --- scalar functions ----------------------------------------------------------------------------

CLEAN = "replace(regexp_replace(monto, '[^0-9.,\\-]', '', 'g'), ',', '')"


@query("f1_parse_amount", f"""
SELECT id_comprobante,
  CASE WHEN length({CLEAN}) - length(replace({CLEAN}, '.', '')) <= 1
        AND TRY_CAST({CLEAN} AS DECIMAL(15,2)) >= 0 THEN TRY_CAST({CLEAN} AS DECIMAL(15,2)) END AS monto
FROM {duck('v_raw')} r""")
def _(spark, d):
    return view(spark, d, "v_raw").select(
        "id_comprobante", amounts.parse_amount("monto").alias("monto")
    )


SIGNED = "trim(replace(replace(replace(replace(replace(trim(monto), '$', ''), 'MXN', ''), 'MN', ''), 'USD', ''), ',', ''))"


@query("f2_parse_amount_signed", f"""
SELECT id_comprobante, TRY_CAST({SIGNED} AS DECIMAL(20,6)) AS monto FROM {duck('v_raw')} r""")
def _(spark, d):
    return view(spark, d, "v_raw").select(
        "id_comprobante", amounts.parse_amount_signed("monto").alias("monto")
    )


def lenient_sql(x: str) -> str:
    a = f"trim(regexp_replace(trim({x}), '\\s*[A-Z]{{2,3}}$', ''))"
    b = f"trim(regexp_replace({a}, '[$¢]', '', 'g'))"
    c = (f"CASE WHEN regexp_matches({b}, '^\\d{{1,3}}(\\.\\d{{3}})+(,\\d+)?$') "
         f"THEN replace(replace({b}, '.', ''), ',', '.') ELSE replace({b}, ',', '') END")
    e = f"regexp_replace(replace(replace({c}, '−', '-'), ' ', ''), '\\.+$', '')"
    return f"coalesce(TRY_CAST({e} AS DOUBLE), 0.0)"


@query("f3_lenient_amount", f"""
SELECT id_comprobante, {lenient_sql('monto')} AS monto FROM {duck('v_raw')} r""")
def _(spark, d):
    return view(spark, d, "v_raw").select(
        "id_comprobante", amounts.lenient_amount("monto").alias("monto")
    )


def _ymd(y: str, m: str, dd: str) -> str:
    return f"TRY_CAST(concat(CASE WHEN length({y}) <> 2 THEN '' WHEN TRY_CAST({y} AS INT) + 2000 >= year(current_date) + 50 THEN '19' ELSE '20' END, {y}, '-', lpad({m}, 2, '0'), '-', lpad({dd}, 2, '0')) AS DATE)"


NUM = "'^(\\d{1,2})[/.\\- ](\\d{1,2})[/.\\- ](\\d{4}|\\d{2})$'"
MON = "'^(\\d{1,2})[/.\\- ]+([A-Za-z]{3,9})\\.?[/.\\-, ]+(\\d{4}|\\d{2})$'"
ISO = "'^(\\d{4})-(\\d{1,2})-(\\d{1,2})$'"


def parse_date_sql(x: str) -> str:
    g = lambda p, i: f"regexp_extract({x}, {p}, {i})"
    month = (f"CASE WHEN strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower(left({g(MON, 2)}, 3))) > 0 THEN "
             f"CAST((strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower(left({g(MON, 2)}, 3))) + 2) // 3 AS VARCHAR) END")
    return f"""CASE
  WHEN regexp_matches({x}, {ISO}) THEN {_ymd(g(ISO, 1), g(ISO, 2), g(ISO, 3))}
  WHEN regexp_matches({x}, {NUM}) THEN
    CASE WHEN CAST({g(NUM, 2)} AS INT) <= 12 OR CAST({g(NUM, 1)} AS INT) > 12
         THEN {_ymd(g(NUM, 3), g(NUM, 2), g(NUM, 1))} ELSE {_ymd(g(NUM, 3), g(NUM, 1), g(NUM, 2))} END
  WHEN regexp_matches({x}, {MON}) AND {month} IS NOT NULL THEN {_ymd(g(MON, 3), month, g(MON, 1))} END"""


STRIPPED = "(SELECT *, regexp_replace(trim(fecha), '[T ]+\\d{1,2}:\\d{2}(:\\d{2})?$', '') AS f FROM {v})"


@query("f4_parse_date", f"""
SELECT id_comprobante, {parse_date_sql('f')} AS fecha FROM {STRIPPED.replace('{v}', duck('v_raw') + ' r')} s""")
def _(spark, d):
    return view(spark, d, "v_raw").select(
        "id_comprobante", dates.parse_date("fecha").alias("fecha")
    )


SLASH = "'^(\\d{1,2})/(\\d{1,2})/(\\d{4})$'"
DASH = "'^(\\d{1,2})-(\\d{1,2})-(\\d{4})$'"


def _pick(p: str, y: int, m: int, dd: int) -> str:
    g = lambda i: f"regexp_extract(trim(fecha), {p}, {i})"
    return f"CASE WHEN regexp_matches(trim(fecha), {p}) THEN {_ymd(g(y), g(m), g(dd))} END"


@query("f5_parse_truth_date", f"""
SELECT id_comprobante, coalesce(
  CASE WHEN regexp_matches(left(trim(fecha), 10), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN TRY_CAST(left(trim(fecha), 10) AS DATE) END,
  {_pick(SLASH, 3, 2, 1)}, {_pick(SLASH, 3, 1, 2)}, {_pick(DASH, 3, 2, 1)}) AS fecha
FROM {duck('v_raw')} r""")
def _(spark, d):
    return view(spark, d, "v_raw").select(
        "id_comprobante", dates.parse_truth_date("fecha").alias("fecha")
    )


REF_SQL = "nullif(upper(trim(regexp_replace(referencia, '\\s+', ' ', 'g'))), '')"


@query("f6_normalize_reference", f"""
SELECT id_comprobante, {REF_SQL} AS referencia FROM {duck('v_raw')} r""")
def _(spark, d):
    return view(spark, d, "v_raw").select(
        "id_comprobante", text.normalize_reference("referencia").alias("referencia")
    )


@query("f7_match_key", """
SELECT doc_id, md5(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g')) AS clave
FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.md5(text.match_key("text")).alias("clave")
    )


ALIASES = """(VALUES (1,'BBVA','bbva'),(2,'BBVA','bbvabancomer'),(3,'BBVA','bancomer'),
 (4,'Citibanamex','citibanamex'),(5,'Citibanamex','banamex'),(6,'Citibanamex','citibanex'),(7,'Citibanamex','citi'),
 (8,'Banorte','banorte'),(9,'HSBC','hsbc'),(10,'Santander','santander'),
 (11,'Hey Banco','heybanco'),(12,'Hey Banco','hey'),(13,'Nu Bank','nubank'),(14,'Nu Bank','nu'))"""


def bank_ctes(source: str, column: str) -> str:
    """CTE ``bank_of(raw, banco)`` for the distinct values of a column."""
    return f"""
names AS (SELECT DISTINCT {column} AS raw, regexp_replace(lower(strip_accents({column})), '[^a-z0-9]', '', 'g') AS k
          FROM {source} WHERE {column} IS NOT NULL),
hits AS (
  SELECT raw, k, pos, bank, length(alias) >= 4 AND contains(k, alias) AS inside,
         CASE WHEN k = '' THEN 0.0 ELSE {indel('k', 'alias')} END AS ratio
  FROM names CROSS JOIN {ALIASES} AS a(pos, bank, alias)),
bank_of AS (
  SELECT raw, coalesce(
    arg_min(bank, pos) FILTER (WHERE inside),
    CASE WHEN max(ratio) >= 0.85 THEN arg_max(bank, ratio * 1000 - pos / 1000.0) END, 'OTRO') AS banco
  FROM hits GROUP BY raw)"""


@query("f8_normalize_bank", f"""
WITH r AS (SELECT * FROM {duck('v_raw')} q), {bank_ctes('r', 'banco')}
SELECT r.id_comprobante, coalesce(b.banco, 'OTRO') AS banco FROM r LEFT JOIN bank_of b ON b.raw = r.banco""")
def _(spark, d):
    return view(spark, d, "v_raw").select(
        "id_comprobante", banks.normalize_bank("banco").alias("banco")
    )


RESPELL = """CASE banco_emisor WHEN 'BBVA BANCOMER' THEN 'BBVA' WHEN 'Banamex' THEN 'Banamex'
 WHEN 'SCTIABANK' THEN 'Scotiabank' ELSE banco_emisor END"""


@query("f9_respell_bank", f"SELECT id, {RESPELL} AS banco FROM {duck('v_truth')} t")
def _(spark, d):
    return view(spark, d, "v_truth").select("id", banks.respell_bank("banco_emisor").alias("banco"))


@query("f10_document_hash", "SELECT doc_id, sha256(text) AS hash_documento FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", documents.document_hash("text").alias("hash_documento")
    )


@query("f11_sniff_mime", """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg'
  WHEN 2 THEN 'application/pdf' END AS mime FROM documents""")
def _(spark, d):
    magic = F.expr(
        "CASE doc_id % 5 WHEN 0 THEN unhex('89504E470D0A1A0A') WHEN 1 THEN unhex('FFD8FFE0') "
        "WHEN 2 THEN unhex('255044462D312E34') ELSE unhex('') END"
    )
    content = F.concat(magic, F.col("text").cast("binary"))
    return table(spark, d, "documents").select(
        "doc_id", documents.sniff_mime(content).alias("mime")
    )


STORE_EXT = "CASE doc_id % 6 WHEN 0 THEN 'PNG' WHEN 1 THEN '.jpg' WHEN 2 THEN 'gif' WHEN 3 THEN 'jpeg' ELSE 'pdf' END"


@query("f12_store_checks", f"""
SELECT doc_id, CASE WHEN strlen(text) = 0 THEN 'empty' WHEN doc_id % 7 = 0 THEN 'bad_hash'
  WHEN doc_id % 6 = 2 THEN 'bad_extension' WHEN doc_id % 14 = 0 OR doc_id % 14 = 13 THEN 'bad_month' END AS problema,
  CASE WHEN doc_id % 6 <> 2 THEN ltrim(lower({STORE_EXT}), '.') END AS ext,
  CASE doc_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'pdf' END AS de_mime
FROM documents""")
def _(spark, d):
    docs = table(spark, d, "documents")
    digest = F.when(F.col("doc_id") % 7 == 0, F.upper(F.sha2("text", 256))).otherwise(
        F.sha2("text", 256)
    )
    mime = F.expr(
        "CASE doc_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' "
        "WHEN 2 THEN 'application/pdf' ELSE 'text/plain' END"
    )
    ext = F.expr(STORE_EXT)
    return docs.select(
        "doc_id",
        documents.store_problem(F.octet_length("text"), digest, ext, F.col("doc_id") % 14).alias(
            "problema"
        ),
        documents.clean_extension(ext).alias("ext"),
        documents.mime_to_ext(mime).alias("de_mime"),
    )


@query("f13_response_fields", """
SELECT o_orderkey AS id,
  CASE o_orderkey % 7 WHEN 3 THEN 'bad_structure' WHEN 4 THEN 'bad_json' WHEN 5 THEN 'not_object' END AS problema,
  CASE o_orderkey % 7 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN CAST(o_custkey AS VARCHAR) || '.50' END AS monto,
  CASE WHEN o_orderkey % 7 IN (0, 1) THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS fecha,
  CASE WHEN o_orderkey % 7 = 1 THEN 'REF ' || o_orderpriority END AS referencia
FROM orders""")
def _(spark, d):
    day = F.col("o_orderdate").cast("date").cast("string")
    body = (
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(
            F.lit('{"monto": '), F.col("o_custkey").cast("string"), F.lit(', "fecha": "'), day,
            F.lit('", "banco": null}')))
        .when(F.col("o_orderkey") % 7 == 1, F.concat(
            F.lit('```json\n{"monto": "'), F.col("o_custkey").cast("string"),
            F.lit('.50", "fecha": "'), day, F.lit('", "referencia": "REF '), "o_orderpriority",
            F.lit('"}\n```')))
        .when(F.col("o_orderkey") % 7 == 4, F.concat(F.lit("no json "), "o_orderpriority"))
        .when(F.col("o_orderkey") % 7 == 5, F.concat(F.lit("["), F.col("o_custkey").cast("string"), F.lit("]")))
        .otherwise(F.lit("{}"))
    )
    wrapped = F.to_json(F.struct(F.array(F.struct(F.struct(body.alias("content")).alias("message"))).alias("choices")))
    response = F.when(F.col("o_orderkey") % 7 == 3, F.lit('{"error": "busy"}')).otherwise(wrapped)
    return (
        table(spark, d, "orders")
        .withColumn("r", response)
        .withColumn("c", documents.response_fields("r"))
        .select(F.col("o_orderkey").alias("id"), documents.response_problem("r").alias("problema"),
                "c.monto", "c.fecha", "c.referencia")
    )


@query("f14_operation_number", f"""
SELECT id_comprobante, nullif(numero_operacion, '') AS numero_operacion FROM {duck('v_raw')} r""")
def _(spark, d):
    return view(spark, d, "v_raw").select(
        "id_comprobante", text.blank_to_null("numero_operacion").alias("numero_operacion")
    )


@query("f15_assembled_text", f"""
SELECT id_comprobante, array_to_string(list_filter([monto, fecha, referencia, numero_operacion, banco],
   lambda x: x IS NOT NULL AND trim(x) <> ''), ' ') AS texto
FROM {duck('v_raw')} r""")
def _(spark, d):
    return view(spark, d, "v_raw").select(
        "id_comprobante",
        extract.assembled_text("monto", "fecha", "referencia", "numero_operacion", "banco").alias("texto"),
    )


@query("f16_reference_of", f"""
SELECT id, nullif(trim(coalesce(nullif(numero_referencia, ''), nullif(numero_comprobante, ''))), '') AS referencia
FROM {duck('v_truth')} t""")
def _(spark, d):
    return view(spark, d, "v_truth").select(
        "id", text.reference_of("numero_referencia", "numero_comprobante").alias("referencia")
    )


@query("f17_amount_similarity", f"""
SELECT image_id, round({s_monto('pred_total', 'gt_total')}, 6) AS s FROM {duck('v_accuracy')} a""")
def _(spark, d):
    return view(spark, d, "v_accuracy").select(
        "image_id", F.round(amounts.amount_similarity("pred_total", "gt_total"), 6).alias("s")
    )


@query("f18_date_similarity", f"""
SELECT image_id, round({s_fecha('pred_date', 'gt_date')}, 6) AS s FROM {duck('v_accuracy')} a""")
def _(spark, d):
    return view(spark, d, "v_accuracy").select(
        "image_id", F.round(dates.date_similarity("pred_date", "gt_date"), 6).alias("s")
    )


@query("f19_classify", f"""
SELECT id_a, {CLASS.format(s='score')} AS clase FROM {duck('v_results')} r""")
def _(spark, d):
    return view(spark, d, "v_results").select("id_a", similarity.classify("score").alias("clase"))


REF_PAIR = """(SELECT o_orderkey AS id, concat('REF-', lpad(CAST(o_orderkey % 997 AS VARCHAR), 6, '0')) AS a,
  CASE WHEN o_orderkey % 10 <> 0 THEN concat('RF', CAST(o_custkey AS VARCHAR), '/', o_orderpriority) END AS b FROM orders)"""


def _ref_pairs(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.expr("concat('REF-', lpad(cast(o_orderkey % 997 as string), 6, '0'))").alias("a"),
        F.expr("case when o_orderkey % 10 <> 0 then concat('RF', cast(o_custkey as string), '/', o_orderpriority) end").alias("b"),
    )


@query("f20_indel_ratio", f"SELECT id, round({indel('a', 'b')}, 6) AS s FROM {REF_PAIR} p")
def _(spark, d):
    return _ref_pairs(spark, d).select("id", F.round(similarity.indel_ratio("a", "b"), 6).alias("s"))


@query("f20_indel_ratio_builtin", f"SELECT id, round({indel('a', 'b')}, 6) AS s FROM {REF_PAIR} p")
def _(spark, d):
    return _ref_pairs(spark, d).select(
        "id", F.round(similarity.indel_ratio_sql("a", "b"), 6).alias("s")
    )


@query("f21_text_similarity", f"""
WITH p AS (SELECT a.doc_id AS ka, b.doc_id AS kb FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
t AS (SELECT doc_id AS k, text FROM documents), {cosine_ctes('p', 't')}
SELECT ka AS id_a, kb AS id_b, round(s_text, 6) AS s FROM cosine""")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("text_key"), "text")
    following = docs.select((F.col("text_key") - 1).alias("key_a"), F.col("text_key").alias("key_b"))
    pairs = following.join(docs.select(F.col("text_key").alias("key_a")), "key_a").select("key_a", "key_b")
    return textpairs.text_pair_similarity(pairs, docs).select(
        F.col("key_a").alias("id_a"), F.col("key_b").alias("id_b"), F.round("s_text", 6).alias("s")
    )


@query("f22_weighted_score", f"""
SELECT a.image_id, round(0.35::DOUBLE * 1.0 + 0.3::DOUBLE * 0.0 + 0.2::DOUBLE * ({s_monto('pred_total', 'gt_total')})
   + 0.15::DOUBLE * ({s_fecha('pred_date', 'gt_date')}), 6) AS score
FROM {duck('v_accuracy')} a""")
def _(spark, d):
    score = similarity.weighted_score(
        F.lit(1.0), F.lit(0.0), amounts.amount_similarity("pred_total", "gt_total"),
        dates.date_similarity("pred_date", "gt_date"), ScoringConfig(),
    )
    return view(spark, d, "v_accuracy").select("image_id", F.round(score, 6).alias("score"))


@query("f23_sequence_ratio")
def _(spark, d):
    return _ref_pairs(spark, d).select("id", F.round(similarity.sequence_ratio("a", "b"), 6).alias("s"))


@query("f24_mask_accounts", """
SELECT doc_id, md5(regexp_replace(concat(text, ' 0121800', lpad(CAST(doc_id AS VARCHAR), 11, '0')), '\\b\\d{14}(\\d{4})\\b', '****\\1', 'g')) AS texto
FROM documents""")
def _(spark, d):
    tail = F.concat("text", F.lit(" 0121800"), F.lpad(F.col("doc_id").cast("string"), 11, "0"))
    return table(spark, d, "documents").select(
        "doc_id", F.md5(extract.mask_accounts(tail)).alias("texto")
    )


@query("f25_mask_cards", """
SELECT doc_id, md5(regexp_replace(text, '\\b\\d{4}[\\s\\-]?\\d{4}[\\s\\-]?\\d{4}[\\s\\-]?(\\d{4})\\b', '****\\1', 'g')) AS texto
FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(extract.mask_cards("text")).alias("texto"))


MASKED = """regexp_replace(regexp_replace(text, '\\b\\d{14}(\\d{4})\\b', '****\\1', 'g'),
   '\\b\\d{4}[\\s\\-]?\\d{4}[\\s\\-]?\\d{4}[\\s\\-]?(\\d{4})\\b', '****\\1', 'g')"""


@query("f26_mask_personal_data", f"""
WITH m AS (SELECT doc_id AS id, 'd' AS tipo, {MASKED} AS t FROM documents
  UNION ALL SELECT conv_id * 1000 + turn, 'c', {MASKED} FROM conversations),
marked AS (SELECT id, tipo, string_split(regexp_replace(t, '([\\p{{L}}\\p{{N}}_]+)', chr(57344) || '\\1' || chr(57345), 'g'), chr(57344)) AS p FROM m)
SELECT id, tipo, md5(array_to_string(list_transform(p, lambda x: CASE
   WHEN contains(x, chr(57345)) AND regexp_full_match(string_split(x, chr(57345))[1], '[A-Z0-9]{{8,20}}')
   THEN concat('REF-', upper(left(sha256(string_split(x, chr(57345))[1]), 8)), string_split(x, chr(57345))[2])
   ELSE replace(x, chr(57345), '') END), '')) AS texto
FROM marked""")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("d").alias("tipo"), "text")
    talk = table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("c").alias("tipo"), "text"
    )
    return docs.unionByName(talk).select(
        "id", "tipo", F.md5(extract.mask_personal_data("text")).alias("texto")
    )


def _slip(spark, d):
    return view(spark, d, "v_slips")


def _simple_extract(name: str, column, sql: str):
    def run(spark, d):
        return _slip(spark, d).select("id_comprobante", *column())

    query(name, f"SELECT id_comprobante, {sql} FROM {duck('v_slips')} s")(run)


def first_sql(pattern: str, x: str = "doc_text") -> str:
    return f"regexp_extract({x}, '{pattern}', 1, 'i')"


_simple_extract(
    "f27_voucher_number",
    lambda: [extract.found_or_blank("doc_text", extract.VOUCHER_NUMBER).alias("valor")],
    f"{first_sql('#\\s*(\\d{6,15})')} AS valor",
)
_simple_extract(
    "f28_reference_number",
    lambda: [extract.found_or_blank("doc_text", extract.REFERENCE_NUMBER).alias("valor")],
    f"{first_sql('(?:N[úu]mero\\s+de\\s+referencia|Referencia\\s+num[eé]rica|Referencia)[:\\s]+(\\d{5,15})')} AS valor",
)
HOUR_SQL = "\\b(\\d{1,2}:\\d{2})(?::\\d{2})?\\b"
_simple_extract(
    "f29_hour",
    lambda: [extract.hour_of("hora", "fecha", F.col("doc_text")).alias("hora")],
    f"coalesce(nullif(hora, ''), nullif({first_sql(HOUR_SQL, 'fecha')}, ''), {first_sql(HOUR_SQL)}) AS hora",
)
LINE = "[:\\s]+(.+?)(?:\\n|$)"
MOTIVE_SQL = f"trim({first_sql('(?:Motivo|Concepto)' + LINE)})"
CONCEPT_SQL = f"trim({first_sql('(?:Concepto(?:\\s+de\\s+pago)?|Descripci[oó]n)' + LINE)})"
STATUS_SQL = f"coalesce(nullif(trim({first_sql('(?:Estatus|Estado|Status)' + LINE)}), ''), 'exitosa')"
OPERATION_SQL = f"trim({first_sql('(?:Tipo de operaci[oó]n|Operaci[oó]n)' + LINE)})"
_simple_extract(
    "f30_labelled_lines",
    lambda: [
        extract.rest_of_line("doc_text", extract.MOTIVE).alias("motivo"),
        extract.rest_of_line("doc_text", extract.CONCEPT).alias("concepto"),
        extract.rest_of_line("doc_text", extract.STATUS, "exitosa").alias("estatus"),
        extract.rest_of_line("doc_text", extract.OPERATION).alias("tipo_operacion"),
    ],
    f"{MOTIVE_SQL} AS motivo, {CONCEPT_SQL} AS concepto, {STATUS_SQL} AS estatus, {OPERATION_SQL} AS tipo_operacion",
)
_simple_extract(
    "f31_masked_accounts",
    lambda: [
        extract.masked_account("doc_text", 0).alias("emisor"),
        extract.masked_account("doc_text", 1).alias("receptor"),
    ],
    """CASE WHEN len(regexp_extract_all(doc_text, '\\*{4,7}(\\d{4})', 1)) > 0 THEN '****' || regexp_extract_all(doc_text, '\\*{4,7}(\\d{4})', 1)[1] ELSE '' END AS emisor,
    CASE WHEN len(regexp_extract_all(doc_text, '\\*{4,7}(\\d{4})', 1)) > 1 THEN '****' || regexp_extract_all(doc_text, '\\*{4,7}(\\d{4})', 1)[2] ELSE '' END AS receptor""",
)
TRACK_SQL = first_sql("(?:Clave de rastreo|CLABE rastreo|clave_rastreo)[:\\s]+([A-Z0-9]{15,40})")
FOLIO_P = "(?:Folio(?:\\s+de\\s+internet)?|FOLIO(?:\\s+NUMERO)?)[:\\s#]+([A-Z0-9]{4,20})"
TX_P = "(?:N[°º]\\.?\\s*Transacci[oó]n|n[uú]mero\\s+de\\s+transacci[oó]n)[:\\s#]+(\\d{6,25})"
_simple_extract(
    "f32_tracking_folio_transaction",
    lambda: [
        extract.found_or_blank("doc_text", extract.TRACKING).alias("clave_rastreo"),
        extract.found_or_blank("doc_text", extract.FOLIO).alias("folio"),
        extract.found_or_blank("doc_text", extract.TRANSACTION).alias("transaccion"),
    ],
    f"{TRACK_SQL} AS clave_rastreo, {first_sql(FOLIO_P)} AS folio, {first_sql(TX_P)} AS transaccion",
)
FEE_SQL = lenient_sql(first_sql("(?:(?:TOTAL\\s+)?COMISI[OÓóo]N(?:\\s+DEL\\s+BANCO)?)[:\\s]+(?:M\\.?N\\.?\\s*)?\\$?\\s*([\\d,]+\\.?\\d*)"))
VAT_SQL = lenient_sql(first_sql("\\bIVA[:\\s]+\\$?\\s*([\\d,]+\\.?\\d*)"))
_simple_extract(
    "f33_fee_and_vat",
    lambda: [
        extract.lenient_amount(extract.found("doc_text", extract.FEE)).alias("comision"),
        extract.lenient_amount(extract.found("doc_text", extract.VAT)).alias("iva"),
    ],
    f"{FEE_SQL} AS comision, {VAT_SQL} AS iva",
)


def amount_sql(x: str) -> tuple[str, str]:
    """(net, total) amount expressions over text expression ``x``."""
    net_p = "(?:Importe\\s+transferido|Importe\\s+giro)[:\\s]+\\$?\\s*([\\d,]+\\.?\\d*)"
    base_p = "(?m)^[\\s\\-]*MONTO\\s*[:\\s]+(?:M\\.?N\\.?\\s*)?\\$?\\s*([\\d,]+\\.?\\d*)"
    total_p = "(?:PAGO\\s+TOTAL|Cantidad\\s+Total|Importe\\s+a\\s+debitar)[.:\\s]+(?:M\\.?N\\.?\\s*)?\\$?\\s*([\\d,]+\\.?\\d*)"
    base = lenient_sql("importe_base")
    net = f"""CASE WHEN {base} <> 0 THEN {base}
      WHEN {first_sql(net_p, x)} <> '' THEN {lenient_sql(first_sql(net_p, x))}
      WHEN {first_sql(base_p, x)} <> '' THEN {lenient_sql(first_sql(base_p, x))}
      ELSE {lenient_sql('monto')} END"""
    total = f"""CASE WHEN {first_sql(total_p, x)} <> '' THEN {lenient_sql(first_sql(total_p, x))}
      WHEN {lenient_sql('monto')} <> 0 AND {lenient_sql('monto')} <> ({net}) THEN {lenient_sql('monto')}
      ELSE ({net}) END"""
    return net, total


_NET, _TOTAL = amount_sql("doc_text")


@query("f34_amounts", f"""
SELECT id_comprobante, {_NET} AS importe_transferido, {_TOTAL} AS importe_total FROM {duck('v_slips')} s""")
def _(spark, d):
    both = extract.both_amounts("importe_base", "monto", F.col("doc_text"))
    return _slip(spark, d).select("id_comprobante", both.alias("b")).select(
        "id_comprobante", F.col("b.net").alias("importe_transferido"),
        F.col("b.total").alias("importe_total"),
    )


RAW_TEXT = "concat(doc_text, ' ', concat_ws(' ', monto, importe_base, fecha, hora, referencia, numero_operacion, banco))"
NARROW = "concat(doc_text, ' ', coalesce(referencia, ''))"
_RNET, _RTOTAL = amount_sql("raw")
ANY_P = "(?:Monto|Importe|Amount)[:\\s]+\\$?\\s*([\\d,\\.]+)\\s*(?:MXN|MN|USD)?"


@query("f35_truth_record", f"""
WITH s AS (SELECT *, trim({RAW_TEXT}) AS raw, trim({NARROW}) AS narrow FROM {duck('v_slips')} q)
SELECT CAST(id_comprobante AS VARCHAR) AS id, coalesce(nullif(banco, ''), 'DESCONOCIDO') AS banco_emisor,
  CASE WHEN {lenient_sql('monto')} <> 0 THEN {lenient_sql('monto')} ELSE {lenient_sql(first_sql(ANY_P))} END AS monto,
  coalesce(fecha, '') AS fecha,
  coalesce(nullif(hora, ''), nullif({first_sql(HOUR_SQL, 'fecha')}, ''), {first_sql(HOUR_SQL, 'narrow')}) AS hora,
  coalesce(nullif({first_sql('#\\s*(\\d{6,15})', 'narrow')}, ''), nullif(numero_operacion, ''),
    nullif({first_sql(FOLIO_P, 'raw')}, ''), nullif({first_sql(TX_P, 'raw')}, ''),
    CASE WHEN regexp_matches(trim(referencia), '^\\d+$') THEN referencia END, '') AS numero_comprobante,
  {first_sql('(?:N[úu]mero\\s+de\\s+referencia|Referencia\\s+num[eé]rica|Referencia)[:\\s]+(\\d{5,15})', 'narrow')} AS numero_referencia,
  {MOTIVE_SQL.replace('doc_text', 'narrow')} AS motivo,
  {CONCEPT_SQL.replace('doc_text', 'raw')} AS concepto,
  {STATUS_SQL.replace('doc_text', 'raw')} AS estatus,
  {FEE_SQL.replace('doc_text', 'raw')} AS comision, {_RNET} AS importe_transferido, {_RTOTAL} AS importe_total,
  '' AS nombre_ordenante, 'MX' AS pais
FROM s""")
def _(spark, d):
    fields = {k: F.col(k) for k in
              ("monto", "importe_base", "fecha", "hora", "referencia", "numero_operacion", "banco")}
    records = extract.truth_records(
        _slip(spark, d), F.col("id_comprobante").cast("string"), "doc_text", fields, "g"
    )
    return records.select(
        "g.id", "g.banco_emisor", "g.monto", "g.fecha", "g.hora", "g.numero_comprobante",
        "g.numero_referencia", "g.motivo", "g.extended.concepto", "g.extended.estatus",
        "g.extended.comision", "g.extended.importe_transferido", "g.extended.importe_total",
        "g.extended.nombre_ordenante", "g.extended.pais",
    )


@query("f36_slug", """
SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""")
def _(spark, d):
    name = F.concat("p_name", F.lit(" "), "p_brand", F.lit("!"))
    return table(spark, d, "part").select("p_partkey", text.slug(name).alias("slug"))


@query("f_sql_functions", f"""
WITH p AS (SELECT id_comprobante, {REF_SQL} AS referencia, {parse_date_sql('f')} AS fecha, f.o_totalprice, f.o_orderdate,
    CASE WHEN length({CLEAN}) - length(replace({CLEAN}, '.', '')) <= 1 AND TRY_CAST({CLEAN} AS DECIMAL(15,2)) >= 0 THEN TRY_CAST({CLEAN} AS DECIMAL(15,2)) END AS monto
  FROM (SELECT s.*, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM {STRIPPED.replace('{v}', duck('v_raw') + ' r')} s JOIN orders ON o_orderkey = id_comprobante) f)
SELECT id_comprobante, monto, fecha, referencia, round({s_monto('monto', 'o_totalprice')}, 6) AS s_monto, round({s_fecha('fecha', 'o_orderdate')}, 6) AS s_fecha,
  {CLASS.format(s=s_monto('monto', 'o_totalprice'))} AS clase,
  concat('cuenta ****', right(lpad(CAST(id_comprobante AS VARCHAR), 11, '0'), 4)) AS cuenta, sha256(CAST(id_comprobante AS VARCHAR)) AS huella FROM p""")
def _(spark, d):
    sql.register(spark)
    view(spark, d, "v_raw").createOrReplaceTempView("capturas")
    table(spark, d, "orders").createOrReplaceTempView("pedidos")
    return spark.sql("""
        SELECT id_comprobante, slip_amount(monto) AS monto, slip_date(fecha) AS fecha, slip_reference(referencia) AS referencia,
          round(slip_amount_similarity(CAST(slip_amount(monto) AS DOUBLE), o_totalprice), 6) AS s_monto,
          round(slip_date_similarity(slip_date(fecha), CAST(o_orderdate AS DATE)), 6) AS s_fecha,
          slip_class(slip_amount_similarity(CAST(slip_amount(monto) AS DOUBLE), o_totalprice)) AS clase,
          slip_mask_accounts(concat('cuenta 0121800', lpad(CAST(id_comprobante AS STRING), 11, '0'))) AS cuenta,
          slip_hash(CAST(CAST(id_comprobante AS STRING) AS BINARY)) AS huella
        FROM capturas JOIN pedidos ON o_orderkey = id_comprobante""")


MONTHS_SQL = "['ENERO','FEBRERO','MARZO','ABRIL','MAYO','JUNIO','JULIO','AGOSTO','SEPTIEMBRE','OCTUBRE','NOVIEMBRE','DICIEMBRE']"


@query("f37_display_formats", f"""
SELECT id_comprobante, format('${{:,.2f}}', CAST(monto AS DOUBLE)) AS monto,
  concat(lpad(CAST(day(fecha_deposito) AS VARCHAR), 2, '0'), ' DE ', {MONTHS_SQL}[month(fecha_deposito)], ' DEL ', CAST(year(fecha_deposito) AS VARCHAR)) AS larga,
  strftime(fecha_deposito, '%d/%m/%Y') AS corta
FROM {duck('v_vouchers')} v""")
def _(spark, d):
    return view(spark, d, "v_vouchers").select(
        "id_comprobante", amounts.format_money("monto").alias("monto"),
        dates.long_spanish_date("fecha_deposito").alias("larga"),
        dates.slashed_date("fecha_deposito").alias("corta"),
    )


P17 = "('0121800' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0'))"


@query("f38_clabe_check_digit", f"""
SELECT o_orderkey, CAST((10 - digits % 10) % 10 AS INTEGER) AS digito, (10 - digits % 10) % 10 = o_custkey % 10 AS valida FROM (
  SELECT o_orderkey, o_custkey, list_sum(list_transform(range(1, 18), lambda i:
    CAST(substr({P17}, i, 1) AS INTEGER) * [3, 7, 1][CAST((i - 1) % 3 + 1 AS INTEGER)])) AS digits FROM orders) x""")
def _(spark, d):
    prefix = F.concat(F.lit("0121800"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))
    account = F.concat(prefix, (F.col("o_custkey") % 10).cast("string"))
    return table(spark, d, "orders").select(
        "o_orderkey", text.clabe_check_digit(prefix).alias("digito"),
        text.clabe_is_valid(account).alias("valida"),
    )


@query("f39_mask_account", """
SELECT c_custkey, concat(repeat('•', 13), right(c_name, 4)) AS mascara FROM customer""")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.mask_account("c_name").alias("mascara"))


@query("f40_fee_check", f"""
SELECT id_comprobante, iva_esperado, CAST(monto + comision + iva_esperado AS DECIMAL(15,2)) AS total_esperado,
       abs(importe_total - (monto + comision + iva_esperado)) <= 0.01 AS cuadra
FROM (SELECT *, CAST(round(comision * CAST(0.16 AS DECIMAL(3,2)), 2) AS DECIMAL(15,2)) AS iva_esperado FROM {duck('v_fees')} f) x""")
def _(spark, d):
    return store.fee_check(view(spark, d, "v_fees")).select(
        "id_comprobante", "iva_esperado", "total_esperado", "cuadra"
    )


@query("f42_ratios", """
SELECT user_id, round(CASE WHEN e > 0 THEN p / e ELSE 0.0 END, 6) AS razon,
  round(CASE WHEN p + e > 0 THEN 2.0 * p * e / (p + e) ELSE 0.0 END, 6) AS f1,
  least(100, CAST(round(n / 50.0::DOUBLE * 100.0) AS BIGINT)) AS porcentaje
FROM (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, CAST(count_if(event_type = 'purchase') AS DOUBLE) AS p,
      CAST(count_if(event_type = 'error') AS DOUBLE) AS e FROM events GROUP BY user_id) x""")
def _(spark, d):
    counts = table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("event_type") == "purchase").alias("p"),
        F.count_if(F.col("event_type") == "error").alias("e"),
    )
    return counts.select(
        "user_id",
        F.round(metrics.safe_div("p", "e"), 6).alias("razon"),
        F.round(metrics.f1("p", "e"), 6).alias("f1"),
        metrics.capped_percent("n", F.lit(50)).alias("porcentaje"),
    )


def _accuracy(spark, d):
    acc = view(spark, d, "v_accuracy")
    truth = acc.select("image_id", "gt_total", "gt_date")
    predicted = acc.select("image_id", "pred_total", "pred_date")
    return evaluation.field_matches(truth, predicted)


@query("f43_tolerance_match", f"SELECT image_id, {ACC_MATCH} FROM {duck('v_accuracy')} a")
def _(spark, d):
    return view(spark, d, "v_accuracy").select(
        "image_id",
        amounts.within_tolerance("pred_total", "gt_total").alias("match_total"),
        dates.days_within("pred_date", "gt_date").alias("match_date"),
    )


@query("f44_truth_key", f"""
SELECT id_a, id_b, CASE WHEN id_b LIKE 'dup-exact-%' OR id_b LIKE 'dup-partial-%' THEN id_a ELSE id_b END AS clave
FROM {duck('v_evalpairs')} p""")
def _(spark, d):
    return view(spark, d, "v_evalpairs").select(
        "id_a", "id_b", evaluation.truth_key("id_b", "id_a").alias("clave")
    )


from . import catalog_tables  # noqa: E402,F401  (registers the remaining queries)
