"""Voucher-shaped views over the driver tables, as SQL both engines can run.

Each view is written once with ``{table}`` placeholders and three dialect helpers; ``view``
gives the Spark DataFrame, ``duck`` the text to embed in an oracle query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_CASE_STATE = "CASE {k} % 8 " + " ".join(
    f"WHEN {i} THEN '{s}'"
    for i, s in enumerate(
        ("recibido", "procesando", "comparando", "sospechoso",
         "en_revision", "valido", "duplicado", "error")
    )
) + " END"
_STATE = _CASE_STATE.format(k="o_orderkey")
_BANK = (
    "CASE o_orderkey % 7 WHEN 0 THEN 'BBVA México' WHEN 1 THEN 'Banamex' WHEN 2 THEN 'Banortte' "
    "WHEN 3 THEN 'Santandar' WHEN 4 THEN 'nubank' WHEN 5 THEN 'Wells Fargo' ELSE 'hsbc' END"
)

# every order is one voucher; two of three share their customer's document, the rest spread
# over all documents, so text similarity takes values strictly between 0 and 1 as well
_VOUCHERS = f"""
SELECT o.o_orderkey AS id_comprobante,
       o.o_custkey AS id_usuario,
       c.c_nationkey AS id_organizacion,
       concat('img/', CAST(o.o_orderkey AS STRING), '.jpg') AS imagen_path,
       d.text AS texto_extraido,
       CASE WHEN o.o_orderkey % 13 <> 0
            THEN concat('REF-', lpad(CAST(o.o_orderkey % 997 AS STRING), 6, '0')) END AS referencia,
       CAST(o.o_totalprice AS DECIMAL(15,2)) AS monto,
       CAST(o.o_orderdate AS DATE) AS fecha_deposito,
       CAST(o.o_orderkey AS STRING) AS numero_operacion,
       {_BANK} AS banco_raw,
       CASE o.o_orderkey % 7 WHEN 0 THEN 'BBVA' WHEN 1 THEN 'Citibanamex' WHEN 2 THEN 'Banorte'
            WHEN 3 THEN 'Santander' WHEN 4 THEN 'Nu Bank' WHEN 5 THEN NULL ELSE 'HSBC' END AS banco,
       @sha(CAST(o.o_orderkey - o.o_orderkey % 40 * (CASE WHEN o.o_orderkey % 40 = 1 THEN 1 ELSE 0 END) AS STRING))@
         AS hash_documento,
       {_STATE} AS estado_actual,
       @ts(o.o_orderdate, o.o_orderkey % 86400)@ AS fecha_registro,
       CASE WHEN o.o_orderkey % 50 = 0 THEN @ts(o.o_orderdate, 0)@ END AS deleted_at
FROM {{orders}} o
JOIN {{customer}} c ON o.o_custkey = c.c_custkey
LEFT JOIN {{documents}} d
  ON d.doc_id = (CASE WHEN o.o_orderkey % 3 = 0 THEN o.o_orderkey ELSE o.o_custkey END)
                % (SELECT count(*) FROM {{documents}})
"""

_DEPOSITS = """
SELECT l_orderkey * 10 + l_linenumber AS id_comprobante,
       l_suppkey AS id_usuario,
       concat('P', CAST(l_partkey % 50 AS STRING)) AS referencia,
       CAST(l_quantity AS DECIMAL(15,2)) AS monto,
       CAST(l_shipdate AS DATE) AS fecha_deposito,
       @ts(l_shipdate, 0)@ AS fecha_registro,
       CASE WHEN l_orderkey % 50 = 0 THEN @ts(l_shipdate, 0)@ END AS deleted_at
FROM {lineitem}
"""

_DOCS = """
SELECT doc_id AS id_comprobante, text, lang, source, n_chars,
       @sha(text)@ AS hash_documento,
       @ts(DATE '2024-01-01', doc_id * 3600)@ AS fecha_registro
FROM {documents}
"""

_USERS = """
SELECT c_custkey AS id_usuario, c_nationkey AS id_organizacion, c_name AS nombre,
       concat(lower(c_name), '@example.com') AS correo,
       CASE WHEN c_custkey % 3 = 0 THEN 'basic' WHEN c_custkey % 3 = 1 THEN 'pro'
            ELSE 'enterprise' END AS plan,
       c_custkey % 10 = 0 AS sin_cuota,
       CASE WHEN c_custkey % 40 = 0 THEN @ts(DATE '2024-01-01', 0)@ END AS deleted_at
FROM {customer}
"""

# event uploads: one row per event, users taken from the events themselves
_UPLOADS = """
SELECT event_id AS id_comprobante, user_id AS id_usuario,
       @sha(concat(CAST(user_id AS STRING), '|', event_type, '|', props))@ AS hash_documento,
       @ts(ts, 0)@ AS fecha_registro, event_type, value
FROM {events}
"""

_UPLOADERS = """
SELECT user_id AS id_usuario,
       CASE WHEN user_id % 3 = 0 THEN 'basic' WHEN user_id % 3 = 1 THEN 'pro'
            ELSE 'enterprise' END AS plan,
       user_id % 10 = 0 AS sin_cuota
FROM {events} GROUP BY user_id
"""

_DECISIONS = """
SELECT event_id, event_id % (SELECT count(*) FROM {orders}) AS id_comprobante,
       user_id AS id_usuario, @ts(ts, 0)@ AS fecha,
       CASE WHEN event_type IN ('view', 'purchase') THEN 'aceptar'
            WHEN event_type = 'click' THEN 'rechazar' END AS accion
FROM {events} WHERE event_type IN ('view', 'purchase', 'click')
"""

# transition requests, one per event
_REQUESTS = f"""
SELECT event_id, event_id % (SELECT count(*) FROM {{orders}}) AS id_comprobante,
       @ts(ts, 0)@ AS fecha,
       {_CASE_STATE.format(k="(user_id + event_id)")} AS hacia
FROM {{events}}
"""

# labelled slip text built from every order
_SLIPS = """
SELECT o_orderkey AS id_comprobante, o_totalprice AS total,
  concat(
    'Comprobante de pago\\n',
    CASE WHEN o_orderkey % 2 = 0
         THEN concat('Número de referencia: ', CAST(o_orderkey + 10000 AS STRING), '\\n') ELSE '' END,
    CASE WHEN o_orderkey % 3 = 0 THEN concat('#', CAST(o_orderkey + 1000000 AS STRING), '\\n') ELSE '' END,
    CASE WHEN o_orderkey % 5 = 0 THEN concat('Concepto de pago: ', o_orderpriority, '  \\n') ELSE '' END,
    CASE WHEN o_orderkey % 7 = 0 THEN concat('Motivo: cargo ', o_orderstatus, '\\n') ELSE '' END,
    CASE WHEN o_orderkey % 4 = 0
         THEN concat('De ****', lpad(CAST(o_custkey % 10000 AS STRING), 4, '0'),
                     ' Para *****', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'), '\\n') ELSE '' END,
    CASE WHEN o_orderkey % 6 = 0
         THEN concat('Clave de rastreo: MX', lpad(CAST(o_orderkey AS STRING), 20, '0'), '\\n') ELSE '' END,
    CASE WHEN o_orderkey % 9 = 0
         THEN concat('Folio de internet: AB', CAST(o_orderkey + 1000 AS STRING), '\\n') ELSE '' END,
    CASE WHEN o_orderkey % 11 = 0
         THEN concat('número de transacción: ', CAST(o_orderkey + 3000000 AS STRING), '\\n') ELSE '' END,
    CASE WHEN o_orderkey % 10 = 0
         THEN concat('TOTAL COMISIÓN: M.N. $', CAST(o_orderkey % 90 AS STRING), '.50\\nIVA: $',
                     CAST(o_orderkey % 14 AS STRING), '.4\\n') ELSE '' END,
    CASE WHEN o_orderkey % 8 = 0 THEN 'Estatus: Aceptada \\n' ELSE '' END,
    CASE WHEN o_orderkey % 12 = 0 THEN 'Tipo de operación: SPEI Enviado\\n' ELSE '' END,
    CASE WHEN o_orderkey % 15 = 0
         THEN concat('Importe transferido: $', CAST(o_custkey AS STRING), '.25\\n') ELSE '' END,
    CASE WHEN o_orderkey % 16 = 0
         THEN concat('MONTO : M.N. $ ', CAST(o_custkey + 7 AS STRING), '.00\\n') ELSE '' END,
    CASE WHEN o_orderkey % 18 = 0
         THEN concat('PAGO TOTAL. M.N. $ ', CAST(o_custkey + 20 AS STRING), '.75\\n') ELSE '' END,
    CASE WHEN o_orderkey % 19 = 0 THEN concat('Importe: ', CAST(o_custkey AS STRING), '.10 MXN\\n') ELSE '' END,
    'hora ', lpad(CAST(o_orderkey % 24 AS STRING), 2, '0'), ':', lpad(CAST(o_orderkey % 60 AS STRING), 2, '0'), ':00'
  ) AS doc_text,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE concat('$', CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING), ' MXN') END AS monto,
  CASE WHEN o_orderkey % 21 = 0 THEN CAST(o_custkey + 3 AS STRING) END AS importe_base,
  CASE WHEN o_orderkey % 23 = 0 THEN '2024-05-01 09:15' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS fecha,
  CASE WHEN o_orderkey % 22 = 0 THEN '07:45' WHEN o_orderkey % 26 = 0 THEN '' END AS hora,
  CASE WHEN o_orderkey % 14 = 0 THEN CAST(o_orderkey AS STRING) ELSE concat('Pago ', o_orderpriority) END AS referencia,
  CASE WHEN o_orderkey % 25 = 0 THEN concat('OP', CAST(o_orderkey AS STRING)) ELSE '' END AS numero_operacion,
  CASE WHEN o_orderkey % 27 = 0 THEN NULL ELSE 'BBVA' END AS banco
FROM {orders}
"""

# raw captured fields, dirty on purpose, one row per order
_RAW = """
SELECT o_orderkey AS id_comprobante, o_custkey AS id_usuario,
  CASE o_orderkey % 9
    WHEN 0 THEN concat('$ ', CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING), ' MXN')
    WHEN 1 THEN CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING)
    WHEN 2 THEN concat('1,', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), '.50')
    WHEN 3 THEN concat('-', CAST(o_orderkey AS STRING))
    WHEN 4 THEN '1.2.3'
    WHEN 5 THEN 'MXN'
    WHEN 6 THEN concat(CAST(o_orderkey AS STRING), '.')
    WHEN 7 THEN concat('3.', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), ',00')
    ELSE NULL END AS monto,
  CASE o_orderkey % 11
    WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
    WHEN 1 THEN concat(CAST(day(o_orderdate) AS STRING), '/', CAST(month(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING))
    WHEN 2 THEN concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', CAST(year(o_orderdate) AS STRING))
    WHEN 3 THEN concat(CAST(month(o_orderdate) AS STRING), '/', CAST(day(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING))
    WHEN 4 THEN concat(CAST(day(o_orderdate) AS STRING), ' May ', CAST(year(o_orderdate) AS STRING))
    WHEN 5 THEN concat(CAST(day(o_orderdate) AS STRING), '/Feb/', CAST(year(o_orderdate) AS STRING))
    WHEN 6 THEN concat(CAST(day(o_orderdate) AS STRING), '/Ago/', CAST(year(o_orderdate) AS STRING))
    WHEN 7 THEN concat(CAST(day(o_orderdate) AS STRING), '/', CAST(month(o_orderdate) AS STRING), '/23')
    WHEN 8 THEN concat('  ', CAST(CAST(o_orderdate AS DATE) AS STRING), ' 10:30')
    WHEN 9 THEN '32/13/2026'
    ELSE 'no es fecha' END AS fecha,
  CASE o_orderkey % 5
    WHEN 0 THEN concat('  ref-', CAST(o_orderkey % 997 AS STRING), '  a')
    WHEN 1 THEN concat('REF\\t', CAST(o_orderkey % 997 AS STRING), '\\n x')
    WHEN 2 THEN '   '
    WHEN 3 THEN NULL
    ELSE concat('ref ', CAST(o_orderkey % 997 AS STRING), '/A') END AS referencia,
  CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN NULL
       ELSE CAST(o_orderkey AS STRING) END AS numero_operacion,
  CASE o_orderkey % 12 WHEN 0 THEN 'BBVA México' WHEN 1 THEN 'Banamex' WHEN 2 THEN 'Banortte'
       WHEN 3 THEN 'Santandar' WHEN 4 THEN 'nubank' WHEN 5 THEN 'Wells Fargo' WHEN 6 THEN 'h.s.b.c'
       WHEN 7 THEN '' WHEN 8 THEN NULL WHEN 9 THEN 'heybank' WHEN 10 THEN 'Ñu'
       ELSE concat('Banco ', o_orderpriority) END AS banco
FROM {orders}
"""

# uploads as they arrive: document bytes (as hex), listed size, the fields a model answered; a fifth
# were stored before. Copies of documents, empty, oversized and mistyped ones, unknown users
_INTAKE = """
SELECT r.id_comprobante,
  CASE WHEN r.id_comprobante % 59 = 3 THEN r.id_usuario + 100000000 ELSE r.id_usuario END AS id_usuario,
  r.id_comprobante % 5 = 0 AS guardado,
  CASE WHEN r.id_comprobante % 5 = 0 THEN @ts(DATE '2024-01-01', r.id_comprobante % 86400)@
       ELSE @ts(DATE '2024-01-02', r.id_comprobante * 40)@ END AS fecha_registro,
  CASE WHEN r.id_comprobante % 53 = 4 THEN CAST(10485761 AS BIGINT) END AS bytes,
  CASE WHEN r.id_comprobante % 43 = 1 THEN '' WHEN r.id_comprobante % 47 = 2 THEN '474946383961'
       ELSE concat(CASE n.dn % 3 WHEN 0 THEN '89504E470D0A1A0A' WHEN 1 THEN 'FFD8FFE0' ELSE '255044462D' END,
                   lpad(CAST(n.dn AS STRING), 12, '0')) END AS contenido_hex,
  CASE WHEN r.id_comprobante % 31 = 7 THEN 'bad_structure' WHEN r.id_comprobante % 37 = 5 THEN 'bad_json'
       WHEN r.id_comprobante % 41 = 6 THEN 'not_object' END AS fallo,
  r.monto, r.fecha, r.referencia, r.numero_operacion, r.banco,
  concat('pago mensual cliente', CAST(r.id_usuario % 7 AS STRING), ' folio', CAST(r.id_comprobante % 5 AS STRING)) AS texto
FROM {v_raw} r
JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 3 THEN o_orderkey % 499 ELSE o_orderkey + 1000 END AS dn FROM {orders}) n
  ON n.k = r.id_comprobante
"""

_ACCURACY = """
SELECT o_orderkey AS image_id,
       CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_totalprice AS DECIMAL(15,2)) END AS gt_total,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL
            WHEN o_orderkey % 7 = 0 THEN CAST(o_totalprice + 5 AS DECIMAL(15,2))
            ELSE CAST(o_totalprice AS DECIMAL(15,2)) END AS pred_total,
       CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderdate AS DATE) END AS gt_date,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL
            WHEN o_orderkey % 5 = 0 THEN @days(CAST(o_orderdate AS DATE), 1)@
            WHEN o_orderkey % 3 = 0 THEN @days(CAST(o_orderdate AS DATE), 3)@
            ELSE CAST(o_orderdate AS DATE) END AS pred_date
FROM {orders}
"""

# labelled ground truth, one record per order, for the evaluation operators
_TRUTH = """
SELECT concat('mx-', lpad(CAST(o_orderkey AS STRING), 8, '0')) AS id,
       CASE o_orderkey % 6 WHEN 0 THEN 'BBVA BANCOMER' WHEN 1 THEN 'Banamex' WHEN 2 THEN 'SCTIABANK'
            WHEN 3 THEN 'OXXO' WHEN 4 THEN 'Inbursa' ELSE '' END AS banco_emisor,
       CAST(o_totalprice AS DECIMAL(15,2)) AS monto,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS fecha,
       CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_orderkey % 997 AS STRING) END AS numero_referencia,
       CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE CAST(o_orderkey AS STRING) END AS numero_comprobante,
       CASE o_orderkey % 3 WHEN 0 THEN 'buena' WHEN 1 THEN 'regular' END AS calidad,
       CASE WHEN o_orderkey % 20 = 0 THEN 'AR' ELSE 'MX' END AS pais,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN ' '
            ELSE concat('pago ', o_orderpriority, ' ', CAST(o_custkey AS STRING)) END AS texto_extraido,
       o_orderkey AS ord
FROM {orders}
"""

# labelled pairs over the documents: copies by hash, truncated copies, same-language others
_PAIRS = """
SELECT id_a, id_b, tipo_duplicado, clasificacion_esperada FROM (
  SELECT m.first_id AS id_a, d.doc_id AS id_b, 'exacto' AS tipo_duplicado,
         'duplicado_exacto' AS clasificacion_esperada
  FROM {documents} d
  JOIN (SELECT @sha(text)@ AS h, min(doc_id) AS first_id FROM {documents} GROUP BY @sha(text)@) m
    ON @sha(d.text)@ = m.h AND d.doc_id <> m.first_id
  UNION ALL
  SELECT doc_id, -doc_id - 1, 'parcial_visual', 'duplicado_parcial' FROM {documents}
  UNION ALL
  SELECT x.doc_id, y.doc_id, 'negativo', 'no_duplicado'
  FROM {documents} x JOIN {documents} y
    ON y.doc_id = x.doc_id + 4 AND y.lang = x.lang AND y.n_chars <> x.n_chars
) p
"""

# labelled pairs over the ground truth, every order in exactly one pair type
_EVALPAIRS = """
SELECT id_a, id_b, tipo_duplicado, clasificacion_esperada FROM (
  SELECT id AS id_a,
    CASE WHEN ord % 10 < 3 THEN concat('dup-exact-', CAST(ord AS STRING))
         WHEN ord % 10 < 7 THEN concat('dup-partial-', CAST(ord AS STRING))
         ELSE concat('mx-', lpad(CAST(ord + 6 AS STRING), 8, '0')) END AS id_b,
    CASE WHEN ord % 10 < 3 THEN 'exacto' WHEN ord % 10 < 7 THEN 'parcial_visual'
         ELSE 'negativo' END AS tipo_duplicado,
    CASE WHEN ord % 10 < 3 THEN 'duplicado_exacto' WHEN ord % 10 < 7 THEN 'duplicado_parcial'
         ELSE 'no_duplicado' END AS clasificacion_esperada
  FROM {v_truth} t) p
WHERE id_b IS NOT NULL
"""

# stored image hashes: sources, exact copies (a few altered), degraded copies; some are missing
_IMAGES = """
SELECT id, hash_documento FROM (
  SELECT id, @sha(id)@ AS hash_documento, ord FROM {v_truth} a
  UNION ALL
  SELECT concat('dup-exact-', CAST(ord AS STRING)),
         @sha(CASE WHEN ord % 20 = 0 THEN concat('x', id) ELSE id END)@, ord + 1 FROM {v_truth} b WHERE ord % 10 < 3
  UNION ALL
  SELECT concat('dup-partial-', CAST(ord AS STRING)), @sha(concat('q', id))@, ord + 2
  FROM {v_truth} c WHERE ord % 10 BETWEEN 3 AND 6) i
WHERE ord % 97 <> 0
"""

# pair results as an evaluation run stores them
_RESULTS = """
SELECT o_orderkey AS id_a,
  CASE WHEN o_orderkey % 10 < 3 THEN 'exacto' WHEN o_orderkey % 10 < 7 THEN 'parcial_visual'
       ELSE 'negativo' END AS tipo_duplicado,
  CASE WHEN o_orderkey % 101 = 0 THEN 'otro' WHEN o_orderkey % 10 < 3 THEN 'duplicado_exacto'
       WHEN o_orderkey % 10 < 7 THEN 'duplicado_parcial' ELSE 'no_duplicado' END AS clasificacion_esperada,
  (o_orderkey % 10 < 3 AND o_orderkey % 20 <> 0) OR o_orderkey % 89 = 0 AS layer1_detected,
  o_orderkey % 10 < 6 AS layer2_detected,
  CAST(o_custkey % 1000 AS DOUBLE) / 1000 AS score,
  CASE WHEN o_custkey % 1000 >= 900 THEN 'duplicado' WHEN o_custkey % 1000 >= 750 THEN 'sospechoso'
       ELSE 'valido' END AS prediction,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'buena' ELSE 'regular' END AS calidad_a
FROM {orders}
"""

_ANNOTATIONS = """
SELECT o_orderkey AS image_id,
  concat('company: ', o_orderpriority, '\\n',
    CASE WHEN o_orderkey % 5 <> 0 THEN concat('Total :  ', CAST(o_custkey AS STRING), '.50 \\n') ELSE '' END,
    'no separator here\\n',
    CASE WHEN o_orderkey % 3 <> 0 THEN concat('DATE: ', CAST(CAST(o_orderdate AS DATE) AS STRING), '\\n') ELSE '' END,
    CASE WHEN o_orderkey % 7 = 0 THEN concat('TOTAL: ', CAST(o_orderkey AS STRING), ':9') ELSE 'end' END) AS text
FROM {orders}
"""

_FEES = """
SELECT l_orderkey * 10 + l_linenumber AS id_comprobante,
       CAST(l_extendedprice AS DECIMAL(15,2)) AS monto,
       CAST(l_quantity AS DECIMAL(15,2)) AS comision,
       CAST(CAST(l_extendedprice AS DECIMAL(15,2)) + CAST(l_quantity AS DECIMAL(15,2))
            + (CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity * 0.16 AS DECIMAL(15,2)) ELSE 0 END)
            AS DECIMAL(15,2)) AS importe_total
FROM {lineitem}
"""

_CONFIG = """
SELECT concat('scoring.', CASE o_orderkey % 5 WHEN 0 THEN 'w_ref' WHEN 1 THEN 'w_text'
              WHEN 2 THEN 'w_monto' WHEN 3 THEN 'w_other' ELSE 'w_none' END) AS key,
       CASE WHEN o_orderkey % 5 = 1 THEN 'abc' ELSE CAST(max(o_orderkey % 100) AS STRING) END AS value
FROM {orders} GROUP BY o_orderkey % 5
"""

# stored weights of the scored layer
_WEIGHTS = """
SELECT concat('scoring.', CASE o_orderkey % 4 WHEN 0 THEN 'w_ref' WHEN 1 THEN 'w_text' WHEN 2 THEN 'w_monto' ELSE 'w_fecha' END) AS key,
       CASE o_orderkey % 4 WHEN 0 THEN '0.4' WHEN 1 THEN '0.1' WHEN 2 THEN '0.375' ELSE '0.125' END AS value
FROM {orders} GROUP BY o_orderkey % 4
"""

# the other tables of the relational store, with a few rows that break their rules
_AUDIT_USERS = """
SELECT id_usuario, CASE WHEN id_usuario % 83 = 0 THEN 999 WHEN id_usuario % 79 = 0 THEN NULL ELSE id_organizacion END AS id_organizacion,
  CASE WHEN id_usuario % 89 = 0 THEN NULL ELSE nombre END AS nombre,
  CASE WHEN id_usuario % 71 = 0 THEN 'igual@example.com' WHEN id_usuario % 73 = 0 THEN NULL ELSE correo END AS correo,
  CASE WHEN id_usuario % 67 = 0 THEN 'oro' ELSE plan END AS plan
FROM {v_users} u WHERE id_usuario % 97 <> 0
"""

_AUDIT_ORGS = """
SELECT CASE WHEN n_nationkey = 24 THEN 23 ELSE n_nationkey END AS id_organizacion, n_name AS nombre,
  CASE WHEN n_nationkey % 7 = 0 THEN 'gratis' ELSE 'basico' END AS plan_suscripcion
FROM {nation}
"""

_AUDIT_LOG = """
SELECT event_id - event_id % 50 * (CASE WHEN event_id % 50 = 1 THEN 1 ELSE 0 END) AS id_log,
  CASE WHEN event_id % 61 = 0 THEN NULL ELSE event_id END AS id_comprobante,
  CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id * 7 END AS id_usuario,
  CASE WHEN event_id % 59 = 0 THEN concat(event_type, lpad('', 60, 'x')) ELSE event_type END AS etapa,
  CASE WHEN event_id % 47 = 0 THEN NULL ELSE props END AS mensaje,
  CASE WHEN event_id % 53 = 0 THEN 'TRACE' ELSE 'INFO' END AS nivel
FROM {events}
"""

VIEWS = {
    "v_vouchers": _VOUCHERS,
    "v_deposits": _DEPOSITS,
    "v_docs": _DOCS,
    "v_users": _USERS,
    "v_uploads": _UPLOADS,
    "v_uploaders": _UPLOADERS,
    "v_decisions": _DECISIONS,
    "v_requests": _REQUESTS,
    "v_slips": _SLIPS,
    "v_raw": _RAW,
    "v_intake": _INTAKE,
    "v_weights": _WEIGHTS,
    "v_audit_users": _AUDIT_USERS,
    "v_audit_orgs": _AUDIT_ORGS,
    "v_audit_log": _AUDIT_LOG,
    "v_accuracy": _ACCURACY,
    "v_truth": _TRUTH,
    "v_pairs": _PAIRS,
    "v_evalpairs": _EVALPAIRS,
    "v_images": _IMAGES,
    "v_results": _RESULTS,
    "v_annotations": _ANNOTATIONS,
    "v_fees": _FEES,
    "v_config": _CONFIG,
}


def _render(sql: str, tables: dict[str, str], spark: bool) -> str:
    def helper(match: re.Match) -> str:
        name, args = match.group(1), match.group(2)
        if name == "sha":
            return f"sha2({args}, 256)" if spark else f"sha256({args})"
        if name == "ts":
            base, seconds = args.rsplit(",", 1)
            if spark:
                return f"(CAST({base} AS TIMESTAMP) + make_dt_interval(0, 0, 0, {seconds}))"
            return f"(CAST({base} AS TIMESTAMP) + to_seconds(CAST({seconds} AS BIGINT)))"
        base, days = args.rsplit(",", 1)
        return f"date_add({base}, {days})" if spark else f"({base} + {days})"

    for name in re.findall(r"\{(v_\w+)\}", sql):
        sql = sql.replace("{" + name + "}", "(" + VIEWS[name] + ")")
    text = re.sub(r"@(\w+)\((.*?)\)@", helper, sql, flags=re.S)
    for table, source in tables.items():
        text = text.replace("{" + table + "}", source)
    if not spark:
        text = text.replace("AS STRING)", "AS VARCHAR)")
        text = re.sub(r"'[^']*\\[nt][^']*'", lambda m: "E" + m.group(0), text)
    return text


def prepare(spark: SparkSession) -> None:
    """The comparisons are made in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    sources = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(_render(VIEWS[name], sources, True))


def duck(name: str) -> str:
    """The view as a parenthesised DuckDB subquery."""
    return "(" + _render(VIEWS[name], {t: t for t in TABLES}, False) + ")"
