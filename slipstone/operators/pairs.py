"""Labelled pairs: matching files to ground truth, allocation, and building the pair set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.banks import respell_bank
from ..session import spool
from .keyed import ranked, ranked_within

_NOTE_EXACT = "copia idéntica"
_NOTE_PARTIAL = "JPEG q=50 + rotación ±3°"


def match_sources(files: DataFrame, truth: DataFrame, mode: str = "auto") -> DataFrame:
    """Files with their ground-truth id, by stem or by position.

    ``auto`` matches by stem when at least half of the stems are known ids, else the n-th file
    takes the n-th id (both sorted); extras on either side drop out. Records without a bank are
    left out. ``files(file, stem)``, ``truth(id, banco_emisor, monto, fecha)``.
    """
    facts = truth.select(
        F.col("id").alias("gt_id"),
        respell_bank("banco_emisor").alias("banco"),
        F.coalesce(F.col("monto").cast("double"), F.lit(0.0)).alias("monto"),
        F.coalesce("fecha", F.lit("")).alias("fecha"),
    )
    if mode == "auto":
        known = facts.select(F.col("gt_id").alias("stem"), F.lit(1).alias("hit"))
        share = (
            files.join(known, "stem", "left")
            .agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
            .first()["share"]
        )
        mode = "stem" if (share or 0.0) >= 0.5 else "position"
    if mode == "stem":
        matched = files.join(facts, files["stem"] == facts["gt_id"])
    else:
        matched = ranked(files, ["file"]).join(ranked(facts, ["gt_id"]), "rank")
    return matched.filter("banco <> ''").select("file", "gt_id", "banco", "monto", "fecha")


def group_sizes(src: DataFrame, min_size: int = 2, by: str = "banco") -> DataFrame:
    """Groups with at least ``min_size`` sources."""
    return src.groupBy(by).agg(F.count(F.lit(1)).alias("total")).filter(F.col("total") >= min_size)


def allocate(src: DataFrame, n: int, floor: int = 30, by: str = "banco") -> DataFrame:
    """Outputs per group: the floor, a proportional share, leftovers one each to the largest.

    Works on one row per group, so its window is as small as the catalogue of groups.
    """
    sizes = src.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    everyone = Window.partitionBy()
    rest = F.greatest(F.lit(0), F.lit(n) - F.count(F.lit(1)).over(everyone) * floor)
    share = F.floor(rest * F.col("total") / F.sum("total").over(everyone))
    base = sizes.withColumn("base", F.lit(floor) + share)
    left = F.lit(n) - F.sum("base").over(everyone)
    rank = F.row_number().over(Window.orderBy(F.desc("total"), by))
    return base.withColumn("left", left).withColumn("pos", rank).select(
        by,
        "total",
        (F.col("base") + F.when(F.col("pos") <= F.col("left"), 1).otherwise(0)).alias("cuota"),
    )


def round_robin(src: DataFrame, quotas: DataFrame, by: str = "banco", key: str = "id") -> DataFrame:
    """Assign each group's outputs 1..quota to its sources in turn.

    Every source emits its own share (its rank, then every group-size-th), so the outputs of one
    large group are produced by as many tasks as it has sources.
    """
    placed = ranked_within(src.select(key, by), [by], [key])
    shares = placed.join(quotas.select(by, "cuota"), by).filter(F.col("rank") <= F.col("cuota"))
    return shares.select(
        by,
        key,
        F.explode(F.sequence(F.col("rank"), F.col("cuota"), F.col("size"))).alias("variante"),
    )


def _halved(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint pairs inside each key with different amounts.

    Rows sorted by amount, the i-th is paired with the one half the group further on: equal
    amounts only meet when one amount fills more than half of the group.
    """
    placed = spool(ranked_within(rows, keys, ["monto", "id"]))
    half = F.floor(F.col("size") / 2)
    left = placed.filter(F.col("rank") <= half).withColumn("slot", F.col("rank"))
    right = placed.filter((F.col("rank") > half) & (F.col("rank") <= 2 * half)).select(
        *keys,
        (F.col("rank") - half).alias("slot"),
        F.col("id").alias("id_b"),
        F.col("monto").alias("monto_b"),
        F.col("fecha").alias("fecha_b"),
    )
    return left.join(right, keys + ["slot"]).filter(F.col("monto") != F.col("monto_b"))


def negative_candidates(src: DataFrame) -> DataFrame:
    """Per group: how many unordered pairs differ in amount, and how many of them share a date.

    Counted from group sizes alone; no pair is written out.
    """

    def unordered(keys: list[str], out: str) -> DataFrame:
        return (
            src.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .groupBy("banco").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias(out))
        )

    return (
        unordered(["banco"], "todos")
        .join(unordered(["banco", "monto"], "mismo_monto"), "banco")
        .join(unordered(["banco", "fecha"], "misma_fecha"), "banco")
        .join(unordered(["banco", "fecha", "monto"], "iguales"), "banco")
        .select(
            "banco",
            (F.col("todos") - F.col("mismo_monto")).alias("pares"),
            (F.col("misma_fecha") - F.col("iguales")).alias("misma_fecha"),
        )
    )


def negative_pairs(src: DataFrame, n: int, seed: int | None = 42) -> DataFrame:
    """``n`` pairs of one bank with different amounts: same date first, each id once if it can be.

    Only when the disjoint pairs run out are ids used again, by pairing rows at growing rank
    distance inside the bank until ``n`` pairs exist or every pair has been considered.
    ``src(id, banco, monto, fecha)``.
    """
    rows = src.select("id", "banco", "monto", "fecha")
    same_day = spool(
        _halved(rows, ["banco", "fecha"]).select("id", "id_b", "banco", F.lit(0).alias("prio"))
    )
    used = same_day.select(F.explode(F.array("id", "id_b")).alias("id"))
    rest = rows.join(used, "id", "left_anti")
    other_day = _halved(rest, ["banco"]).select(
        "id", "id_b", "banco",
        F.when(F.col("fecha") == F.col("fecha_b"), 0).otherwise(1).alias("prio"),
    )
    pool = spool(
        same_day.unionByName(other_day).select(
            F.least("id", "id_b").alias("id_a"), F.greatest("id", "id_b").alias("id_b"),
            "banco", "prio",
        )
    )
    have = pool.count()
    if have < n:
        pool = pool.unionByName(_reused(rows, pool, n - have))
    note = F.concat(
        F.lit("mismo banco "), "banco",
        F.when(F.col("prio").isin(0, 2), " + fecha exacta").otherwise(" + fecha cercana"),
        F.lit(" + monto distinto"),
    )
    drawn = pool.withColumn("__draw", F.lit(0) if seed is None else F.xxhash64(F.lit(seed), F.col("id_a")))
    # numbered in place, so the first n pairs never pass through one task
    first = ranked(drawn, ["prio", "__draw", "id_a", "id_b"], "__drawn").filter(F.col("__drawn") <= n)
    return first.select(
        "id_a",
        "id_b",
        F.lit("negativo").alias("tipo_duplicado"),
        F.lit("ninguna").alias("capa_esperada"),
        F.lit("no_duplicado").alias("clasificacion_esperada"),
        note.alias("notas"),
    )


def _reused(rows: DataFrame, taken: DataFrame, missing: int) -> DataFrame:
    """Further pairs that reuse ids: rank distances 1, 2, ... until enough or none are left."""
    placed = spool(ranked_within(rows, ["banco"], ["fecha", "id"]))
    longest = placed.agg(F.max("size")).first()[0] or 0
    reach = 1
    while True:
        shifted = placed.select(
            "banco", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("gap"), "rank",
            F.col("id").alias("id_1"), F.col("monto").alias("m_1"), F.col("fecha").alias("f_1"),
        ).withColumn("rank", F.col("rank") + F.col("gap"))
        found = shifted.join(placed, ["banco", "rank"]).filter(F.col("m_1") != F.col("monto"))
        extra = spool(
            found.select(
                F.least("id_1", "id").alias("id_a"), F.greatest("id_1", "id").alias("id_b"), "banco",
                F.when(F.col("f_1") == F.col("fecha"), 2).otherwise(3).alias("prio"),
            ).join(taken.select("id_a", "id_b"), ["id_a", "id_b"], "left_anti")
        )
        if extra.count() >= missing or reach >= longest - 1:
            return extra.select("id_a", "id_b", "banco", "prio")
        reach = min(reach * 2, longest - 1)


def _cycled(src: DataFrame, n: int, prefix: str, seed: int | None, fixed: dict[str, str]) -> DataFrame:
    """``n`` pairs source -> numbered copy, cycling over the sources in draw order."""
    drawn = src.select("id")
    if seed is not None:
        drawn = drawn.withColumn("__draw", F.xxhash64(F.lit(seed), F.lit(prefix), F.col("id")))
        order = ["__draw", "id"]
    else:
        order = ["id"]
    placed = ranked(drawn, order)
    total = src.agg(F.count(F.lit(1))).scalar()
    numbered = placed.filter(F.col("rank") <= n).select(
        F.col("id").alias("id_a"),
        F.explode(F.sequence(F.col("rank"), F.lit(n).cast("bigint"), total)).alias("seq"),
    )
    digits = F.col("seq").cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return numbered.select(
        "id_a",
        F.concat(F.lit(prefix), padded).alias("id_b"),
        *[F.lit(value).alias(name) for name, value in fixed.items()],
    )


def pair_split(n: int) -> dict[str, int]:
    """30 / 40 / 30 by rounding, remainder to negatives; at least 50 in total."""
    total = max(n, vocab.MIN_PAIRS)
    exact = round(total * vocab.PAIR_SHARES["exacto"])
    partial = round(total * vocab.PAIR_SHARES["parcial_visual"])
    return {"exacto": exact, "parcial_visual": partial, "negativo": total - exact - partial}


def build_pairs(src: DataFrame, n: int = 50, seed: int | None = 42) -> DataFrame:
    """The labelled pair set: exact copies, degraded copies, negatives."""
    split = pair_split(n)
    exact = _cycled(src, split["exacto"], "dup-exact-", seed, {
        "tipo_duplicado": "exacto", "capa_esperada": "capa_1",
        "clasificacion_esperada": "duplicado_exacto", "notas": _NOTE_EXACT,
    })
    partial = _cycled(src, split["parcial_visual"], "dup-partial-", seed, {
        "tipo_duplicado": "parcial_visual", "capa_esperada": "capa_2",
        "clasificacion_esperada": "duplicado_parcial", "notas": _NOTE_PARTIAL,
    })
    negative = negative_pairs(src, split["negativo"], seed)
    return exact.unionByName(partial).unionByName(negative)


def check_distribution(pairs: DataFrame, min_total: int = vocab.MIN_PAIRS) -> DataFrame:
    """One row: counts per type, whether 30/40/30 +-5 % and the minimum hold, and why not."""
    counts = pairs.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("tipo_duplicado") == t).alias(t) for t in vocab.PAIR_SHARES],
    )
    tol = vocab.PAIR_TOLERANCE
    problems = []
    for kind, share in vocab.PAIR_SHARES.items():
        part = F.try_divide(F.col(kind).cast("double"), F.col("total").cast("double"))
        low, high = share - tol, share + tol
        text = F.concat(
            F.lit(f"{kind}="), F.format_number(part * 100, 1),
            F.lit(f"% (esperado {low:.0%}–{high:.0%})"),
        )
        problems.append(F.when(~part.between(low, high), text))
    few = F.concat(
        F.lit("Solo "), F.col("total").cast("string"),
        F.lit(f" pares generados — se requieren ≥{min_total}"),
    )
    listed = F.array_compact(F.array(*problems))
    message = (
        F.when(F.col("total") < min_total, few)
        .when(F.size(listed) > 0, F.concat(F.lit("Distribución fuera de ±5%: "), F.array_join(listed, "; ")))
        .otherwise("")
    )
    return counts.withColumn("mensaje", message).withColumn("ok", F.col("mensaje") == "")
