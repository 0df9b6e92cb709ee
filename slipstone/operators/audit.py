"""Constraint and reference audits: violations per rule, in one pass per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab

# rules: a row violates when the predicate is true
CHECKS: dict[str, dict[str, str]] = {
    "comprobantes": {
        "estado_actual": f"estado_actual is null or estado_actual not in {vocab.STATES!r}",
        "monto_no_negativo": "monto < 0",
        "hash_formato": "hash_documento is null or not hash_documento rlike '^[0-9a-f]{64}$'",
        "usuario_no_nulo": "id_usuario is null",
        "referencia_larga": "length(referencia) > 100",
        "banco_largo": "length(banco) > 50",
        "imagen_larga": "imagen_path is null or length(imagen_path) > 500",
    },
    "validaciones": {
        "clasificacion": f"clasificacion is null or clasificacion not in {vocab.CLASSES!r}",
        "metodo": f"metodo_deteccion is null or metodo_deteccion not in {vocab.METHODS!r}",
        "score_rango": "score_similitud < 0 or score_similitud > 1",
        "comprobante_no_nulo": "id_comprobante is null",
        "fecha_no_nula": "fecha_validacion is null",
    },
    "usuarios": {
        "organizacion_no_nula": "id_organizacion is null",
        "nombre": "nombre is null or length(nombre) > 150",
        "correo_largo": "length(correo) > 254",
        "rol": f"rol is null or rol not in {vocab.ROLES!r}",
        "plan": f"plan is null or plan not in {vocab.PLANS!r}",
        "correo_no_nulo": "correo is null",
    },
    "organizaciones": {
        "plan_suscripcion": (
            f"plan_suscripcion is null or plan_suscripcion not in {vocab.ORG_PLANS!r}"
        ),
        "nombre": "nombre is null or length(nombre) > 150",
    },
    "log_procesamiento": {
        "nivel": f"nivel is null or nivel not in {vocab.LOG_LEVELS!r}",
        "comprobante_no_nulo": "id_comprobante is null",
        "etapa": "etapa is null or length(etapa) > 50",
        "mensaje_no_nulo": "mensaje is null",
    },
}
UNIQUE: dict[str, tuple[str, ...]] = {
    "comprobantes": ("id_comprobante", "hash_documento"),
    "validaciones": ("id_validacion",),
    "usuarios": ("id_usuario", "correo"),
    "organizaciones": ("id_organizacion",),
    "log_procesamiento": ("id_log",),
    "configuracion_sistema": ("key",),
}
# (table, column, parent table, parent column)
REFERENCES: tuple[tuple[str, str, str, str], ...] = (
    ("comprobantes", "id_usuario", "usuarios", "id_usuario"),
    ("validaciones", "id_comprobante", "comprobantes", "id_comprobante"),
    ("validaciones", "id_usuario", "usuarios", "id_usuario"),
    ("validaciones", "id_comprobante_original", "comprobantes", "id_comprobante"),
    ("usuarios", "id_organizacion", "organizaciones", "id_organizacion"),
    ("log_procesamiento", "id_comprobante", "comprobantes", "id_comprobante"),
    ("log_procesamiento", "id_usuario", "usuarios", "id_usuario"),
)


def _check_rows(name: str, df: DataFrame) -> DataFrame:
    rules = {
        rule: text
        for rule, text in CHECKS.get(name, {}).items()
        if _columns_of(text) & set(df.columns)
    }
    counted = df.agg(*[F.count_if(F.expr(text)).alias(rule) for rule, text in rules.items()])
    rows = F.array(
        *[
            F.struct(F.lit(rule).alias("regla"), F.col(rule).alias("violaciones"))
            for rule in rules
        ]
    )
    return counted.select(F.explode(rows).alias("r")).select(
        F.lit(name).alias("tabla"), "r.regla", "r.violaciones"
    )


def _columns_of(text: str) -> set[str]:
    return {word.strip("(),") for word in text.split()} | {
        word.split("(")[-1].rstrip(")") for word in text.split()
    }


def _unique_rows(name: str, df: DataFrame, column: str) -> DataFrame:
    extra = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(extra.alias("violaciones"))
        .select(F.lit(name).alias("tabla"), F.lit(f"unico_{column}").alias("regla"), "violaciones")
    )


def _orphan_rows(child: DataFrame, table: str, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Children are counted per key before the join, so a popular parent moves one row."""
    named = child.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("n")
    )
    keys = parent.select(F.col(key).alias(column))
    return named.join(keys, column, "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("violaciones")
    ).select(F.lit(table).alias("tabla"), F.lit(f"huerfano_{column}").alias("regla"), "violaciones")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def audit_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """``tabla, regla, violaciones`` for every CHECK, NOT NULL and UNIQUE rule of the tables."""
    frames = [_check_rows(name, df) for name, df in tables.items() if name in CHECKS]
    frames += [
        _unique_rows(name, df, column)
        for name, df in tables.items()
        for column in UNIQUE.get(name, ())
        if column in df.columns
    ]
    return _union(frames)


def audit_references(tables: dict[str, DataFrame]) -> DataFrame:
    """``tabla, regla, violaciones`` for every foreign key whose both tables are given."""
    frames = [
        _orphan_rows(tables[child], child, column, tables[parent], key)
        for child, column, parent, key in REFERENCES
        if child in tables and parent in tables and column in tables[child].columns
    ]
    return _union(frames)


def _key_rules(tables: dict[str, DataFrame]) -> tuple[list[tuple[str, str]], list[tuple[str, str, str, str]]]:
    """UNIQUE keys and foreign keys that the given tables have the columns for."""
    unique = [(t, c) for t, df in tables.items() for c in UNIQUE.get(t, ()) if c in df.columns]
    foreign = [
        rule for rule in REFERENCES
        if rule[0] in tables and rule[2] in tables and rule[1] in tables[rule[0]].columns
    ]
    return unique, foreign


def _child(rule: tuple[str, str, str, str]) -> str:
    return f"{rule[0]}.{rule[1]}"


def key_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """How often every key is held and named: ``dominio, clave, titulares, nombrada`` (a count for
    each foreign key that names it).

    All keys of all tables go through one exchange, combined before it, so a popular key moves
    one row per task. Null keys hold and name nothing. The counts of two sets of rows add up
    (``merged_counts``), so an audit can be kept and only new rows counted.
    """
    unique, foreign = _key_rules(tables)
    names = [_child(rule) for rule in foreign]
    parts = []
    for name, df in tables.items():
        keys = [
            F.struct(F.lit(f"{name}.{c}").alias("dominio"), F.col(c).cast("string").alias("clave"), F.lit(None).cast("string").alias("hijo"))
            for t, c in dict.fromkeys([*unique, *[(r[2], r[3]) for r in foreign]]) if t == name
        ] + [
            F.struct(F.lit(f"{r[2]}.{r[3]}").alias("dominio"), F.col(r[1]).cast("string").alias("clave"), F.lit(_child(r)).alias("hijo"))
            for r in foreign if r[0] == name
        ]
        if keys:
            parts.append(df.select(F.explode(F.array(*keys)).alias("k")).select("k.*"))
    rows = _union(parts).filter("clave is not null")
    counts = rows.groupBy("dominio", "clave").agg(
        F.count_if(F.col("hijo").isNull()).alias("titulares"),
        *[F.count_if(F.col("hijo") == n).alias(f"__{i}") for i, n in enumerate(names)],
    )
    named = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.col(f"__{i}"))]) if names else (
        F.create_map().cast("map<string,long>")
    )
    return counts.select("dominio", "clave", "titulares", F.map_filter(named, lambda _, n: n > 0).alias("nombrada"))


def merged_counts(stored: DataFrame, added: DataFrame) -> DataFrame:
    """The counts of both sets of rows."""
    holders = F.array(F.struct(F.lit(None).cast("string").alias("hijo"), F.col("titulares").alias("n")))
    names = F.transform(F.map_entries("nombrada"), lambda e: F.struct(e["key"].alias("hijo"), e["value"].alias("n")))
    flat = stored.unionByName(added).select("dominio", "clave", F.inline(F.concat(holders, names)))
    sums = flat.groupBy("dominio", "clave", "hijo").agg(F.sum("n").alias("n"))
    # at most one entry per foreign key
    named = F.collect_list(F.when(F.col("hijo").isNotNull(), F.struct("hijo", "n")))
    return sums.groupBy("dominio", "clave").agg(
        F.coalesce(F.sum(F.when(F.col("hijo").isNull(), F.col("n"))), F.lit(0)).alias("titulares"),
        F.map_from_entries(named).alias("nombrada"),
    )


def key_violations(counts: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``tabla, regla, violaciones`` of every UNIQUE and foreign key from ``key_counts``."""
    unique, foreign = _key_rules(tables)
    rules = [
        (t, f"unico_{c}", F.sum(F.when((F.col("dominio") == f"{t}.{c}") & (F.col("titulares") > 1), F.col("titulares") - 1)))
        for t, c in unique
    ] + [
        (r[0], f"huerfano_{r[1]}", F.sum(F.when(
            (F.col("dominio") == f"{r[2]}.{r[3]}") & (F.col("titulares") == 0), F.try_element_at("nombrada", F.lit(_child(r)))
        )))
        for r in foreign
    ]
    found = counts.agg(*[F.coalesce(total, F.lit(0)).cast("long").alias(f"__{i}") for i, (_, _, total) in enumerate(rules)])
    rows = F.array(*[
        F.struct(F.lit(t).alias("tabla"), F.lit(rule).alias("regla"), F.col(f"__{i}").alias("violaciones"))
        for i, (t, rule, _) in enumerate(rules)
    ])
    return found.select(F.explode(rows).alias("r")).select("r.*")


def audit_all(tables: dict[str, DataFrame]) -> DataFrame:
    """Every CHECK, NOT NULL, length, UNIQUE and foreign-key rule: one pass over each table for the
    row rules, one exchange for all keys."""
    checks = [_check_rows(name, df) for name, df in tables.items() if name in CHECKS]
    return _union([*checks, key_violations(key_counts(tables), tables)])


def split_rejects(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every rule, and the others with the first failing rule as ``motivo``.

    ``rules`` maps a reason to the condition a good row fulfils.
    """
    reason = F.coalesce(
        *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    )
    tagged = df.withColumn("motivo", reason)
    return tagged.filter("motivo is null").drop("motivo"), tagged.filter("motivo is not null")
