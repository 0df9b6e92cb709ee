"""Read side: filters, pages, per-state and month-to-date reports, quotas, navigation joins."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import vocab
from ..functions.metrics import capped_percent, safe_div
from .keyed import ranked_within


@dataclass(frozen=True)
class Page:
    """One page of rows and a one-row frame describing it."""

    items: DataFrame
    meta: DataFrame


def _newest_first() -> list[Column]:
    return [F.desc("fecha_registro"), F.desc("id_comprobante")]


def live(df: DataFrame) -> DataFrame:
    return df.filter("deleted_at is null")


def month_to_date(df: DataFrame, as_of: date, col: str = "fecha_registro") -> DataFrame:
    """Rows registered since the first day of ``as_of``'s month (UTC session)."""
    return df.filter(F.col(col) >= F.lit(as_of.replace(day=1)).cast("timestamp"))


def by_ids(v: DataFrame, ids: DataFrame) -> DataFrame:
    """Live vouchers with the given ids; unknown ids give no row."""
    return live(v).join(ids.select("id_comprobante").distinct(), "id_comprobante", "left_semi")


def domestic(truth: DataFrame, country: str = "MX") -> DataFrame:
    nested = "extended" in truth.columns
    return truth.filter(F.col("extended.pais" if nested else "pais") == country)


def _checked(date_from, date_to, states, limit: int, offset: int) -> None:
    if date_from and date_to and date_from > date_to:
        raise ValueError("date_from is after date_to")
    unknown = [s for s in states or [] if s not in vocab.STATES]
    if unknown:
        raise ValueError(f"unknown states: {unknown}")
    if not 1 <= limit <= vocab.MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {vocab.MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def filtered(
    v: DataFrame, *, user=None, date_from=None, date_to=None, bank=None, states=None
) -> DataFrame:
    """Live vouchers under the optional conjunctive filters (pushed to the scan)."""
    out = live(v)
    if user is not None:
        out = out.filter(F.col("id_usuario") == user)
    if date_from is not None:
        out = out.filter(F.col("fecha_deposito") >= F.lit(date_from))
    if date_to is not None:
        out = out.filter(F.col("fecha_deposito") <= F.lit(date_to))
    if bank is not None:
        out = out.filter(F.col("banco") == bank)
    if states:
        out = out.filter(F.col("estado_actual").isin(*states))
    return out


def page_of(rows: DataFrame, limit: int, offset: int) -> Page:
    """Page in newest-first order with total and ``has_more``; beyond the end it is empty."""
    items = rows.orderBy(*_newest_first()).offset(offset).limit(limit)
    meta = rows.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.lit(limit).cast("bigint").alias("limit"),
        F.lit(offset).cast("bigint").alias("offset"),
        (F.lit(offset) + F.greatest(F.lit(0), F.least(F.lit(limit), F.col("total") - offset))
         < F.col("total")).alias("has_more"),
    )
    return Page(items, meta)


def history(
    v: DataFrame, user=None, *, date_from=None, date_to=None, bank=None, states=None,
    limit: int = 20, offset: int = 0,
) -> Page:
    _checked(date_from, date_to, states, limit, offset)
    rows = filtered(
        v, user=user, date_from=date_from, date_to=date_to, bank=bank, states=states
    )
    return page_of(rows, limit, offset)


def after_key(rows: DataFrame, stamp, last_id, limit: int = 20) -> DataFrame:
    """Keyset variant for deep pages: rows after (stamp, id) in newest-first order."""
    at = F.lit(stamp).cast("timestamp")
    older = (F.col("fecha_registro") < at) | (
        (F.col("fecha_registro") == at) & (F.col("id_comprobante") < F.lit(last_id))
    )
    return rows.filter(older).orderBy(*_newest_first()).limit(limit)


def with_org(v: DataFrame, users: DataFrame) -> DataFrame:
    """Vouchers with their owner's organisation (an ordinary join: users grow with tenants)."""
    org = users.select("id_usuario", "id_organizacion")
    return v.drop("id_organizacion").join(org, "id_usuario")


def org_list(
    v: DataFrame, users: DataFrame, org, *, states=None, date_from=None, date_to=None,
    page: int = 1, page_size: int = 20,
) -> Page:
    """One organisation's page. Members are filtered first, so the join side is small."""
    _checked(date_from, date_to, states, page_size, (page - 1) * page_size)
    members = users.filter(F.col("id_organizacion") == org).select("id_usuario")
    rows = filtered(v, date_from=date_from, date_to=date_to, states=states).join(
        members, "id_usuario", "left_semi"
    )
    found = page_of(rows, page_size, (page - 1) * page_size)
    meta = found.meta.select(
        "total",
        F.lit(page).cast("bigint").alias("page"),
        F.lit(page_size).cast("bigint").alias("page_size"),
        (F.lit(page * page_size) < F.col("total")).alias("has_more"),
    )
    return Page(found.items, meta)


def recent(v: DataFrame, n: int) -> DataFrame:
    return live(v).orderBy(*_newest_first()).limit(n)


def review_queue(v: DataFrame) -> DataFrame:
    """Live vouchers waiting for review (order with ``recent`` or ``page_of``)."""
    return live(v).filter(F.col("estado_actual") == "en_revision")


def severity(state) -> Column:
    value = F.col(state) if isinstance(state, str) else state
    table = F.create_map(*[F.lit(x) for x in chain(*vocab.SEVERITY.items())])
    return F.coalesce(F.try_element_at(table, value), F.lit("info"))


def severity_counts(v: DataFrame) -> DataFrame:
    return (
        live(v).groupBy(severity("estado_actual").alias("grupo"))
        .agg(F.count(F.lit(1)).alias("total"))
    )


def ownership(v: DataFrame, users: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of each access request (id_solicitud, id_comprobante, id_organizacion)."""
    owned = live(v).select("id_comprobante", F.col("id_usuario").alias("dueno"))
    members = live(users).select(
        F.col("id_usuario").alias("dueno"), F.col("id_organizacion").alias("org_dueno")
    )
    outcome = (
        F.when(F.col("dueno").isNull(), "not_found")
        .when(F.col("org_dueno").eqNullSafe(F.col("id_organizacion")), "ok")
        .otherwise("denied")
    )
    return (
        requests.join(owned, "id_comprobante", "left")
        .join(members, "dueno", "left")
        .select("id_solicitud", "id_comprobante", outcome.alias("resultado"))
    )


def state_counts(v: DataFrame, user=None) -> DataFrame:
    """Live vouchers per state plus a ``TOTAL`` row, from one pass."""
    return (
        filtered(v, user=user)
        .groupBy("estado_actual")
        .agg(F.count(F.lit(1)).alias("total"))
        .withColumn(
            "filas",
            F.array(
                F.struct(F.col("estado_actual").alias("estado"), "total"),
                F.struct(F.lit("TOTAL").alias("estado"), "total"),
            ),
        )
        .select(F.explode("filas").alias("f"))
        .groupBy("f.estado")
        .agg(F.sum("f.total").alias("total"))
    )


def mean_similarity(v: DataFrame, validations: DataFrame, by=None) -> DataFrame:
    """Average stored score over the owners' vouchers; deleted rows count (as reported)."""
    scored = validations.filter("score_similitud is not null").select(
        "id_comprobante", "score_similitud"
    )
    joined = scored.join(v.select("id_comprobante", "id_usuario"), "id_comprobante")
    grouped = joined.groupBy(by) if by else joined.groupBy()
    return grouped.agg(F.round(F.avg("score_similitud"), 6).alias("promedio_score_similitud"))


def org_kpis(v: DataFrame, users: DataFrame, as_of: date) -> DataFrame:
    """Month-to-date total, duplicates and error rate of every organisation.

    Vouchers are first counted per user (combined before the shuffle), so the join to users
    moves one row per active user, whatever the size of a tenant.
    """
    per_user = (
        month_to_date(live(v), as_of)
        .groupBy("id_usuario")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("estado_actual") == "duplicado").alias("d"),
        )
    )
    counted = users.select("id_usuario", "id_organizacion").join(per_user, "id_usuario", "left")
    return (
        counted.groupBy("id_organizacion")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_mes"),
            F.coalesce(F.sum("d"), F.lit(0)).alias("duplicados_mes"),
        )
        .withColumn(
            "tasa_error", F.round(safe_div("duplicados_mes", "total_mes") * 100.0, 2)
        )
    )


def plan_limit(plan, limits: dict[str, int] = vocab.PLAN_LIMITS) -> Column:
    value = F.col(plan) if isinstance(plan, str) else plan
    table = F.create_map(*[F.lit(x) for x in chain(*limits.items())])
    return F.coalesce(F.try_element_at(table, value), F.lit(0))


def quota_usage(
    v: DataFrame, users: DataFrame, as_of: date, limits: dict[str, int] = vocab.PLAN_LIMITS
) -> DataFrame:
    """Uploads this month against the plan limit, for every user; deleted uploads count."""
    used = (
        month_to_date(v, as_of).groupBy("id_usuario").agg(F.count(F.lit(1)).alias("__used"))
    )
    limit = plan_limit("plan", limits)
    unlimited = F.col("sin_cuota") | (limit == -1)
    reset = F.add_months(F.lit(as_of.replace(day=1)), 1)
    return users.join(used, "id_usuario", "left").select(
        "id_usuario",
        "plan",
        F.when(unlimited, F.lit(0)).otherwise(F.coalesce("__used", F.lit(0))).cast("bigint")
        .alias("used"),
        F.when(unlimited, F.lit(-1)).otherwise(limit).cast("bigint").alias("limit"),
        F.when(~unlimited, reset).alias("reset_date"),
        unlimited.alias("unlimited"),
    )


def quota_verdict(usage: DataFrame) -> DataFrame:
    """Add the verdict and the meter's percentage."""
    return usage.withColumn(
        "exceeded", ~F.col("unlimited") & (F.col("used") >= F.col("limit"))
    ).withColumn("percent", capped_percent("used", "limit"))


def admit(
    v: DataFrame, users: DataFrame, limits: dict[str, int] = vocab.PLAN_LIMITS
) -> DataFrame:
    """Which layer-1 survivors the monthly quota lets in, by arrival order within user and month.

    A busy user's month is never ranked as a whole: uploads are counted per minute (combined
    before the shuffle), running totals over at most 44,640 minutes place each minute before or
    after the limit, and rows are ranked only inside the one minute that crosses it.
    """
    tagged = v.join(users.select("id_usuario", "plan", "sin_cuota"), "id_usuario")
    limit = plan_limit("plan", limits)
    rows = tagged.select(
        "id_comprobante",
        "id_usuario",
        "fecha_registro",
        F.trunc(F.col("fecha_registro").cast("date"), "MM").alias("mes"),
        F.date_trunc("minute", "fecha_registro").alias("minuto"),
        F.when(F.col("sin_cuota"), F.lit(-1)).otherwise(limit).alias("limite"),
    )
    free = rows.filter("limite = -1").withColumn("aceptado", F.lit(True))
    bound = rows.filter("limite <> -1")
    minutes = bound.groupBy("id_usuario", "mes", "minuto").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("id_usuario", "mes").orderBy("minuto").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = minutes.withColumn("antes", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = bound.join(offsets, ["id_usuario", "mes", "minuto"])
    sure = placed.filter("antes + n <= limite or antes >= limite").withColumn(
        "aceptado", F.col("antes") < F.col("limite")
    )
    order = Window.partitionBy("id_usuario", "minuto").orderBy("fecha_registro", "id_comprobante")
    crossing = placed.filter("antes + n > limite and antes < limite").withColumn(
        "aceptado", F.row_number().over(order) + F.col("antes") <= F.col("limite")
    )
    keep = ["id_comprobante", "id_usuario", "mes", "aceptado"]
    return free.select(*keep).unionByName(sure.select(*keep)).unionByName(crossing.select(*keep))


def history_positions(v: DataFrame) -> DataFrame:
    """Each live voucher's place in its owner's history (newest first), safe for busy owners."""
    keyed = live(v).select(
        "id_comprobante", "id_usuario", (-F.unix_micros("fecha_registro")).alias("antiguedad")
    )
    placed = ranked_within(keyed, ["id_usuario"], ["antiguedad", "id_comprobante"], "pos", "total")
    # ties on the stamp go to the larger id: mirror the rank inside each equal stamp
    ties = placed.groupBy("id_usuario", "antiguedad").agg(
        F.min("pos").alias("primero"), F.max("pos").alias("ultimo")
    )
    return placed.join(ties, ["id_usuario", "antiguedad"]).select(
        "id_comprobante",
        "id_usuario",
        (F.col("primero") + F.col("ultimo") - F.col("pos")).alias("pos"),
    )


def with_original(validations: DataFrame, v: DataFrame) -> DataFrame:
    """Duplicates with the original's fields, blank when it is missing or deleted."""
    original = live(v).select(
        F.col("id_comprobante").alias("id_comprobante_original"),
        F.col("referencia").alias("referencia_original"),
        F.col("monto").alias("monto_original"),
        F.col("fecha_deposito").alias("fecha_original"),
        F.coalesce("banco", F.lit("OTRO")).alias("banco_original"),
    )
    duplicates = validations.filter(F.col("clasificacion") == "duplicado")
    return duplicates.join(original, "id_comprobante_original", "left")


def latest_validation(v: DataFrame, validations: DataFrame) -> DataFrame:
    """Each voucher with its newest validation and how many it has (combined before joining)."""
    newest = validations.groupBy("id_comprobante").agg(
        F.max_by(
            F.struct("clasificacion", "metodo_deteccion", "score_similitud"),
            F.struct("fecha_validacion", "metodo_deteccion"),
        ).alias("ultima"),
        F.count(F.lit(1)).alias("validaciones"),
    )
    return v.select("id_comprobante", "id_usuario").join(newest, "id_comprobante", "left").select(
        "id_comprobante",
        "id_usuario",
        F.coalesce("validaciones", F.lit(0)).alias("validaciones"),
        F.col("ultima.clasificacion").alias("clasificacion"),
        F.col("ultima.metodo_deteccion").alias("metodo_deteccion"),
        F.col("ultima.score_similitud").alias("score_similitud"),
    )


def tenant_tree(orgs: DataFrame, users: DataFrame, v: DataFrame) -> DataFrame:
    """Organisation -> users -> vouchers counts."""
    per_user = v.groupBy("id_usuario").agg(F.count(F.lit(1)).alias("n"))
    per_org = (
        users.join(per_user, "id_usuario", "left")
        .groupBy("id_organizacion")
        .agg(F.count(F.lit(1)).alias("usuarios"), F.coalesce(F.sum("n"), F.lit(0)).alias("comprobantes"))
    )
    return orgs.join(per_org, "id_organizacion", "left").select(
        "id_organizacion",
        "nombre",
        F.coalesce("usuarios", F.lit(0)).alias("usuarios"),
        F.coalesce("comprobantes", F.lit(0)).alias("comprobantes"),
    )
