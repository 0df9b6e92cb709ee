"""DuckDB fragments the oracle queries share: brute-force scoring of candidate pairs."""

from __future__ import annotations

K = 1.4054651081081644


def lcs(a: str, b: str) -> str:
    """Longest common subsequence length of two string expressions."""
    return f"""list_last(list_reduce(
      list_transform(string_split({a}, ''), lambda x: [unicode(x)]),
      lambda acc, x: list_reduce(
        list_transform(range(1, length({b}) + 1), lambda j: [CAST(j AS INTEGER)]),
        lambda cur, j: list_append(cur, CASE WHEN x[1] = unicode(substr({b}, j[1], 1))
                                             THEN acc[j[1]] + 1
                                             ELSE greatest(acc[j[1] + 1], list_last(cur)) END),
        [0]),
      list_transform(range(0, length({b}) + 1), lambda j: 0)))"""


def indel(a: str, b: str) -> str:
    return (
        f"CASE WHEN coalesce(length({a}), 0) = 0 OR coalesce(length({b}), 0) = 0 THEN 0.0 "
        f"WHEN {a} = {b} THEN 1.0 "
        f"ELSE 2.0::DOUBLE * {lcs(a, b)} / (length({a}) + length({b})) END"
    )


def s_monto(a: str, b: str) -> str:
    x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.0 "
        f"WHEN greatest(abs({x}), abs({y})) = 0 THEN 1.0 "
        f"ELSE 1.0::DOUBLE - abs({x} - {y}) / greatest(abs({x}), abs({y})) END"
    )


def s_fecha(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.0 "
        f"ELSE 1.0::DOUBLE - CAST(least(abs(date_diff('day', {a}, {b})), 30) AS DOUBLE) / 30.0::DOUBLE END"
    )


def cosine_ctes(pairs: str, texts: str) -> str:
    """CTEs ending in ``cosine(ka, kb, s_text)`` for ``pairs(ka, kb)`` over ``texts(k, text)``."""
    k2 = repr(K * K)
    return f"""
tok AS (
  SELECT k, term, count(*) AS tf
  FROM (SELECT k, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {texts}) t
  GROUP BY k, term),
norm AS (SELECT k, CAST(sum(tf * tf) AS DOUBLE) AS n FROM tok GROUP BY k),
shared AS (
  SELECT p.ka, p.kb, CAST(sum(a.tf * b.tf) AS DOUBLE) AS dot,
         CAST(sum(a.tf * a.tf) AS DOUBLE) AS sa, CAST(sum(b.tf * b.tf) AS DOUBLE) AS sb
  FROM {pairs} p JOIN tok a ON a.k = p.ka JOIN tok b ON b.k = p.kb AND b.term = a.term
  GROUP BY p.ka, p.kb),
cosine AS (
  SELECT s.ka, s.kb,
         s.dot / (sqrt(s.sa + {k2}::DOUBLE * (na.n - s.sa)) * sqrt(s.sb + {k2}::DOUBLE * (nb.n - s.sb))) AS s_text
  FROM shared s JOIN norm na ON na.k = s.ka JOIN norm nb ON nb.k = s.kb)"""


def scored_ctes(v: str, scope: str = "id_usuario", asked: str = "TRUE") -> str:
    """CTEs ending in ``scored(id, cid, c_ts, score, ...)``: every candidate pair, scored."""
    return f"""
v AS (SELECT *, CASE WHEN regexp_matches(texto_extraido, '[\\p{{L}}\\p{{N}}_]{{2,}}') THEN md5(texto_extraido) END AS tk
      FROM {v}),
cand AS (
  SELECT a.id_comprobante AS id, b.id_comprobante AS cid, b.fecha_registro AS c_ts,
         a.referencia AS ra, b.referencia AS rb, a.tk AS ta, b.tk AS tb,
         {s_monto('a.monto', 'b.monto')} AS s_monto,
         {s_fecha('a.fecha_deposito', 'b.fecha_deposito')} AS s_fecha
  FROM v a JOIN v b
    ON a.{scope} = b.{scope} AND a.id_comprobante <> b.id_comprobante
   AND b.deleted_at IS NULL
   AND abs(date_diff('day', a.fecha_deposito, b.fecha_deposito)) <= 30
   AND (b.fecha_registro < a.fecha_registro
        OR (b.fecha_registro = a.fecha_registro AND b.id_comprobante < a.id_comprobante))
  WHERE {asked}),
refs AS (
  SELECT ra, rb, {indel('ra', 'rb')} AS s_ref
  FROM (SELECT DISTINCT ra, rb FROM cand WHERE ra IS NOT NULL AND rb IS NOT NULL) r),
tp AS (SELECT DISTINCT least(ta, tb) AS ka, greatest(ta, tb) AS kb FROM cand WHERE ta <> tb),
tx AS (SELECT tk AS k, any_value(texto_extraido) AS text FROM v
       WHERE tk IN (SELECT ka FROM tp UNION SELECT kb FROM tp) GROUP BY tk),
{cosine_ctes('tp', 'tx')},
parts AS (
  SELECT c.*, coalesce(r.s_ref, 0.0) AS s_ref,
         CASE WHEN ta = tb THEN 1.0 ELSE coalesce(x.s_text, 0.0) END AS s_text
  FROM cand c LEFT JOIN refs r ON r.ra = c.ra AND r.rb = c.rb
  LEFT JOIN cosine x ON x.ka = least(c.ta, c.tb) AND x.kb = greatest(c.ta, c.tb)),
scored AS (
  SELECT *, 0.35::DOUBLE * s_ref + 0.3::DOUBLE * s_text + 0.2::DOUBLE * s_monto
            + 0.15::DOUBLE * s_fecha AS score FROM parts)"""


def best_ctes(v: str, scope: str = "id_usuario", asked: str = "TRUE") -> str:
    """... and ``best(id, cid, score)``: the best candidate of each row that has one."""
    return scored_ctes(v, scope, asked) + """,
best AS (
  SELECT id, cid, score FROM (
    SELECT id, cid, score,
           row_number() OVER (PARTITION BY id ORDER BY score DESC, c_ts, cid) AS rn
    FROM scored WHERE score > 0) z
  WHERE rn = 1)"""


CLASS = ("CASE WHEN {s} >= 0.90 THEN 'duplicado' WHEN {s} >= 0.75 THEN 'sospechoso' "
         "ELSE 'valido' END")
