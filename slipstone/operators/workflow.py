"""Voucher states: legality, applying requested transitions, manual review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..session import spool
from .keyed import attach_first, ranked_within


def transitions(spark: SparkSession) -> DataFrame:
    """The legal edges (fixed size)."""
    return spark.createDataFrame(list(vocab.TRANSITIONS), "desde string, hacia string")


def is_legal(source, target) -> Column:
    """Whether the edge source -> target exists; unknown states have none."""
    a = F.col(source) if isinstance(source, str) else source
    b = F.col(target) if isinstance(target, str) else target
    edges = [f"{x}>{y}" for x, y in vocab.TRANSITIONS]
    return F.coalesce(F.concat(a, F.lit(">"), b).isin(*edges), F.lit(False))


def judge(requests: DataFrame) -> DataFrame:
    """Add ``legal`` to rows with ``desde`` and ``hacia``."""
    return requests.withColumn("legal", is_legal("desde", "hacia"))


#: requests, or maps of requests, that one task folds at a time
CHUNK = 1_000


def _next_state(current: Column, target: Column) -> Column:
    return F.when(is_legal(current, target), target).otherwise(current)


def _end_states(run: Column) -> Column:
    """Map from every start state to the state after a list of requested states, in order."""
    return F.create_map(*[
        x for state in vocab.STATES
        for x in (F.lit(state), F.aggregate(run, F.lit(state), _next_state))
    ])


def _before(start: Column, steps: Column, move) -> Column:
    """The state before each of ``steps`` and, as last entry, after all of them."""
    none = F.array(start)
    return F.aggregate(steps, none, lambda path, step: F.concat(path, F.array(move(F.element_at(path, -1), step))))


def request_verdicts(v: DataFrame, requests: DataFrame) -> DataFrame:
    """Every request in time order with its verdict: id_comprobante, event_id, fecha, desde,
    hacia, legal, estado (the state after it).

    ``requests(id_comprobante, hacia, fecha, event_id)``; an illegal request changes nothing and
    the later ones are judged from the state it left. Requests on unknown vouchers are illegal,
    with null states. A run of requests is a map from start to end state, and such maps
    compose: runs of ``CHUNK`` requests are folded to maps, runs of maps to further maps, and
    start states are handed down the same way, so a task holds one run however long a voucher's
    history is.
    """
    ranked_rows = ranked_within(
        requests.select("id_comprobante", "event_id", "fecha", "hacia"), ["id_comprobante"], ["fecha", "event_id"]
    ).withColumn("run", F.floor((F.col("rank") - 1) / CHUNK).cast("long"))
    ordered = F.sort_array(F.collect_list(F.struct("rank", "event_id", "fecha", "hacia")))
    runs = spool(ranked_rows.groupBy("id_comprobante", "run").agg(ordered.alias("steps")))
    levels = [spool(runs.select("id_comprobante", "run", _end_states(F.col("steps.hacia")).alias("map")))]
    while not levels[-1].filter("run > 0").isEmpty():
        parts = F.sort_array(F.collect_list(F.struct("run", F.map_entries("map").alias("map"))))
        grouped = levels[-1].groupBy(
            "id_comprobante", F.floor(F.col("run") / CHUNK).cast("long").alias("run")
        ).agg(parts.alias("parts"))
        through = lambda state, part: F.try_element_at(F.map_from_entries(part["map"]), state)
        composed = F.create_map(*[
            x for state in vocab.STATES
            for x in (F.lit(state), F.aggregate("parts", F.lit(state), through))
        ])
        levels.append(spool(grouped.select("id_comprobante", "run", "parts", composed.alias("map"))))
    states = v.select("id_comprobante", F.col("estado_actual").alias("start"))
    starts = levels[-1].select("id_comprobante", "run").join(states, "id_comprobante", "left")
    for level in reversed(levels[1:]):
        through = lambda state, part: F.try_element_at(F.map_from_entries(part["map"]), state)
        starts = level.join(starts, ["id_comprobante", "run"]).select(
            "id_comprobante", F.explode(F.arrays_zip(
                F.col("parts.run").alias("run"), _before(F.col("start"), F.col("parts"), through).alias("start")
            )).alias("z")
        ).select("id_comprobante", "z.run", "z.start").filter("run is not null")
    told = runs.join(starts, ["id_comprobante", "run"]).withColumn(
        "path", _before(F.col("start"), F.col("steps.hacia"), _next_state)
    )
    return told.select("id_comprobante", F.explode(F.arrays_zip("steps", "path")).alias("z")).filter(
        "z.steps is not null"
    ).select(
        "id_comprobante", "z.steps.event_id", "z.steps.fecha", F.col("z.path").alias("desde"), "z.steps.hacia",
        is_legal("z.path", "z.steps.hacia").alias("legal"), _next_state(F.col("z.path"), F.col("z.steps.hacia")).alias("estado"),
    )


def apply_requests(v: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply every request in order: vouchers with old and new state, and all refused requests."""
    verdicts = spool(request_verdicts(v, requests))
    refused = verdicts.filter(~F.col("legal")).select("id_comprobante", "event_id", "desde", "hacia")
    return _folded(verdicts).drop("refused"), refused


def _folded(verdicts: DataFrame) -> DataFrame:
    """One row per known voucher: state before its first and after its last request, counts."""
    when = F.struct("fecha", "event_id")
    return verdicts.filter("desde is not null").groupBy("id_comprobante").agg(
        F.min_by("desde", when).alias("desde"), F.max_by("estado", when).alias("estado_actual"),
        F.count_if("legal").alias("applied"), F.count_if(~F.col("legal")).alias("refused"),
    )


def apply_decisions(
    v: DataFrame, decisions: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manual review: accept -> valido, reject -> duplicado, through the transition table.

    ``decisions(event_id, id_comprobante, id_usuario, accion, fecha)``. Both targets are final,
    so of the decisions with a valid action only a voucher's first can be legal. Where both
    tables have ``id_organizacion``, a decision from another organisation is refused as if the
    voucher did not exist and keeps no other from being the first.
    Returns updated vouchers (id, state), new validation rows and refused decisions.
    """
    target = F.when(F.col("accion") == "aceptar", "valido").when(
        F.col("accion") == "rechazar", "duplicado"
    )
    owned = "id_organizacion" in v.columns and "id_organizacion" in decisions.columns
    live = v.filter("deleted_at is null").select(
        "id_comprobante", F.col("estado_actual").alias("desde"),
        *([F.col("id_organizacion").alias("__owner")] if owned else []),
    )
    seen = decisions.withColumn("hacia", target).join(live, "id_comprobante", "left")
    if owned:
        own = F.coalesce(F.col("id_organizacion") == F.col("__owner"), F.lit(False))
        seen = seen.withColumn("desde", F.when(own, F.col("desde")))
    judged = judge(attach_first(
        seen, ["id_comprobante"], ["fecha", "event_id"], "first",
        where=F.col("hacia").isNotNull() & F.col("desde").isNotNull(),
    ))
    is_first = F.coalesce(F.col("first.event_id") == F.col("event_id"), F.lit(False))
    reason = (
        F.when(F.col("desde").isNull(), "no_encontrado")
        .when(F.col("hacia").isNull(), "accion_invalida")
        .when(~F.col("legal"), "transicion_invalida")
        .when(~is_first, "ya_decidido")
    )
    judged = judged.withColumn("motivo_rechazo", reason)
    accepted = judged.filter("motivo_rechazo is null")
    updated = accepted.select("id_comprobante", F.col("hacia").alias("estado_actual"))
    validations = accepted.select(
        "id_comprobante",
        "id_usuario",
        F.lit(None).cast("double").alias("score_similitud"),
        F.col("hacia").alias("clasificacion"),
        F.lit("manual").alias("metodo_deteccion"),
        F.col("fecha").alias("fecha_validacion"),
    )
    refused = judged.filter("motivo_rechazo is not null").select(
        "event_id", "id_comprobante", "accion", "motivo_rechazo"
    )
    return updated, validations, refused


def replay_requests(v: DataFrame, requests: DataFrame) -> DataFrame:
    """Per voucher: state before its first request, final state, applied and refused counts."""
    return _folded(request_verdicts(v, requests)).select(
        "id_comprobante", "desde", F.col("estado_actual").alias("estado"),
        F.col("applied").alias("aplicadas"), F.col("refused").alias("rechazadas"),
    )
