"""Evaluation: scoring labelled pairs, detection metrics, confusion, strata, field accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..config import ScoringConfig
from ..functions import similarity as sim
from ..functions.amounts import amount_similarity, parse_amount_signed, strip, within_tolerance
from ..functions.dates import date_similarity, days_within, parse_truth_date
from ..functions.metrics import f1, safe_div
from ..functions.text import blank_to_null, reference_of
from .layers import text_key
from .textpairs import named_in, text_pair_similarity


def truth_key(image_id, id_a) -> Column:
    """Degraded copies share the ground truth of their source."""
    image = F.col(image_id) if isinstance(image_id, str) else image_id
    source = F.col(id_a) if isinstance(id_a, str) else id_a
    copy = image.startswith("dup-exact-") | image.startswith("dup-partial-")
    return F.when(copy, source).otherwise(image)


def comparable(truth: DataFrame) -> DataFrame:
    """Ground-truth rows as the values the pair checks compare."""
    return truth.select(
        "id",
        F.coalesce(blank_to_null("numero_referencia"), blank_to_null("numero_comprobante")).alias(
            "ref"
        ),
        reference_of("numero_referencia", "numero_comprobante").alias("ref_trim"),
        parse_amount_signed("monto").alias("monto"),
        parse_truth_date("fecha").alias("fecha"),
        blank_to_null(strip("texto_extraido")).alias("texto"),
        F.coalesce("calidad", F.lit("unknown")).alias("calidad"),
    )


def fields_match(a: str, b: str) -> Column:
    """Layer-2 test of a pair: equal reference, or both blank, with equal amount and date."""
    ref_a = F.coalesce(F.col(f"{a}.ref"), F.lit(""))
    ref_b = F.coalesce(F.col(f"{b}.ref"), F.lit(""))
    return F.coalesce(
        (ref_a == ref_b)
        & (F.col(f"{a}.monto") == F.col(f"{b}.monto"))
        & (F.col(f"{a}.fecha") == F.col(f"{b}.fecha")),
        F.lit(False),
    )


def score_pairs(
    pairs: DataFrame, truth: DataFrame, images: DataFrame, cfg: ScoringConfig = ScoringConfig()
) -> DataFrame:
    """All three layers on each labelled pair.

    ``images(id, hash_documento)`` are the stored files; a pair whose file is missing keeps its
    row with an error and nothing detected.
    """
    facts = comparable(truth)
    packed = F.struct(*[c for c in facts.columns if c != "id"])
    side_a = facts.select(F.col("id").alias("id_a"), packed.alias("a"))
    side_b = facts.select(F.col("id").alias("key_b"), packed.alias("b"))
    files_a = images.select(F.col("id").alias("id_a"), F.col("hash_documento").alias("hash_a"))
    files_b = images.select(F.col("id").alias("id_b"), F.col("hash_documento").alias("hash_b"))
    joined = (
        pairs.withColumn("key_b", truth_key("id_b", "id_a"))
        .join(files_a, "id_a", "left")
        .join(files_b, "id_b", "left")
        .join(side_a, "id_a", "left")
        .join(side_b, "key_b", "left")
    )
    error = F.when(
        F.col("hash_a").isNull(), F.concat(F.lit("image not found for id_a='"), "id_a", F.lit("'"))
    ).when(F.col("hash_b").isNull(), F.concat(F.lit("image not found for id_b='"), "id_b", F.lit("'")))

    if cfg.similarity == "sequence_matcher":
        joined = joined.withColumn("s_text", sim.sequence_ratio("a.texto", "b.texto"))
        s_ref = sim.sequence_ratio("a.ref_trim", "b.ref_trim")
    else:
        keyed = joined.withColumn("ta", text_key("a.texto")).withColumn("tb", text_key("b.texto"))
        open_text = F.col("ta") != F.col("tb")
        keyed = keyed.withColumn(
            "key_lo", F.when(open_text, F.least("ta", "tb"))
        ).withColumn("key_hi", F.when(open_text, F.greatest("ta", "tb")))
        wanted = keyed.filter("key_lo is not null").select(
            F.col("key_lo").alias("key_a"), F.col("key_hi").alias("key_b")
        )
        texts = (
            facts.select(text_key("texto").alias("text_key"), F.col("texto").alias("text"))
            .filter("text_key is not null")
            .groupBy("text_key")
            .agg(F.min("text").alias("text"))
        )
        wanted = wanted.distinct()
        texts = texts.join(named_in(wanted), "text_key", "left_semi")
        cosines = text_pair_similarity(wanted, texts).select(
            F.col("key_a").alias("key_lo"), F.col("key_b").alias("key_hi"), "s_text"
        )
        joined = keyed.join(cosines, ["key_lo", "key_hi"], "left").withColumn(
            "s_text",
            F.when(F.col("ta") == F.col("tb"), F.lit(1.0)).otherwise(
                F.coalesce("s_text", F.lit(0.0))
            ),
        )
        s_ref = sim.indel_ratio("a.ref_trim", "b.ref_trim")

    score = sim.weighted_score(
        s_ref, "s_text", amount_similarity("a.monto", "b.monto"),
        date_similarity("a.fecha", "b.fecha", cfg.window_days), cfg,
    )
    ok = F.col("error").isNull()
    return (
        joined.withColumn("error", error)
        .withColumn("raw", F.when(ok, score).otherwise(F.lit(0.0)))
        .select(
            "id_a",
            "id_b",
            "tipo_duplicado",
            "clasificacion_esperada",
            F.coalesce(ok & (F.col("hash_a") == F.col("hash_b")), F.lit(False)).alias("layer1_detected"),
            (ok & fields_match("a", "b")).alias("layer2_detected"),
            F.round("raw", 6).alias("score"),
            sim.classify("raw", cfg).alias("prediction"),
            F.coalesce("a.calidad", F.lit("unknown")).alias("calidad_a"),
            F.coalesce("b.calidad", F.lit("unknown")).alias("calidad_b"),
            "error",
        )
    )


def detectors() -> dict[str, Column]:
    """Detection signal of each layer over pair results."""
    return {
        "capa_1": F.col("layer1_detected"),
        "capa_2": F.col("layer2_detected"),
        "capa_3": F.col("prediction") == "duplicado",
    }


def binary_metrics(results: DataFrame, detected: dict[str, Column]) -> DataFrame:
    """TP/FP/FN, precision, recall and F1 of each named detector, in one pass."""
    positive = F.col("clasificacion_esperada").isin(*vocab.POSITIVE_LABELS)
    counts = results.agg(
        *[
            agg
            for name, hit in detected.items()
            for agg in (
                F.count_if(hit & positive).alias(f"{name}__tp"),
                F.count_if(hit & ~positive).alias(f"{name}__fp"),
                F.count_if(~hit & positive).alias(f"{name}__fn"),
            )
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("detector"),
                F.col(f"{name}__tp").alias("true_positives"),
                F.col(f"{name}__fp").alias("false_positives"),
                F.col(f"{name}__fn").alias("false_negatives"),
            )
            for name in detected
        ]
    )
    return _with_rates(counts.select(F.explode(rows).alias("r")).select("r.*"))


def _with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    precision, recall = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return counts.withColumns(
        {
            "precision": F.round(precision, 6),
            "recall": F.round(recall, 6),
            "f1": F.round(f1(precision, recall), 6),
        }
    )


def score_stats(results: DataFrame, by: str = "tipo_duplicado") -> DataFrame:
    """Min, max, mean and exact median score per group.

    Scores carry six decimals, so the median's value table has at most 1,000,001 entries.
    """
    score = F.round("score", 6)
    return results.groupBy(by).agg(
        F.round(F.min(score), 6).alias("min"),
        F.round(F.max(score), 6).alias("max"),
        F.round(F.avg(score), 6).alias("mean"),
        F.round(F.median(score), 6).alias("median"),
    )


def confusion(results: DataFrame) -> DataFrame:
    """Expected x predicted counts, zero-filled; unknown labels are left out."""
    spark = results.sparkSession
    labels = spark.createDataFrame(
        [(label,) for label in vocab.EXPECTED_LABELS], "clasificacion_esperada string"
    )
    counts = (
        results.groupBy("clasificacion_esperada")
        .pivot("prediction", list(vocab.PREDICTED_LABELS))
        .agg(F.count(F.lit(1)))
    )
    return labels.join(counts, "clasificacion_esperada", "left").na.fill(
        0, list(vocab.PREDICTED_LABELS)
    )


def by_quality(results: DataFrame, quality: str = "calidad_a") -> DataFrame:
    """Pairs, layer-1 precision and mean score per image quality."""
    positive = F.col("clasificacion_esperada").isin(*vocab.POSITIVE_LABELS)
    hit = F.col("layer1_detected")
    return (
        results.groupBy(F.coalesce(quality, F.lit("unknown")).alias("calidad"))
        .agg(
            F.count(F.lit(1)).alias("pairs"),
            F.count_if(hit & positive).alias("tp"),
            F.count_if(hit & ~positive).alias("fp"),
            F.round(F.avg("score"), 6).alias("scoring_mean"),
        )
        .select(
            "calidad",
            "pairs",
            F.round(safe_div("tp", F.col("tp") + F.col("fp")), 6).alias("capa_1_precision"),
            "scoring_mean",
        )
    )


def type_distribution(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("tipo_duplicado").agg(F.count(F.lit(1)).alias("total"))


def field_matches(
    truth: DataFrame, predicted: DataFrame, tol_amount: str = "0.01", tol_days: int = 1
) -> DataFrame:
    """Annotation against prediction per image: three-state amount and date matches."""
    joined = truth.join(predicted, "image_id", "left")
    return joined.select(
        "image_id",
        "gt_total",
        "gt_date",
        "pred_total",
        "pred_date",
        within_tolerance("pred_total", "gt_total", tol_amount).alias("match_total"),
        days_within("pred_date", "gt_date", tol_days).alias("match_date"),
    )


def field_metrics(acc: DataFrame, fields: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per field from three-state matches, in one pass.

    ``fields`` maps a name to (match column, truth column).
    """
    fields = fields or {"total": ("match_total", "gt_total"), "date": ("match_date", "gt_date")}
    counts = acc.agg(
        *[
            agg
            for name, (match, truth) in fields.items()
            for agg in (
                F.count_if(F.col(match)).alias(f"{name}__tp"),
                F.count_if(~F.col(match)).alias(f"{name}__fp"),
                F.count_if(F.col(match).isNull() & F.col(truth).isNotNull()).alias(f"{name}__fn"),
                F.count(truth).alias(f"{name}__support"),
            )
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("campo"),
                F.col(f"{name}__tp").alias("true_positives"),
                F.col(f"{name}__fp").alias("false_positives"),
                F.col(f"{name}__fn").alias("false_negatives"),
                F.col(f"{name}__support").alias("support"),
            )
            for name in fields
        ]
    )
    return _with_rates(counts.select(F.explode(rows).alias("r")).select("r.*"))


# --- fixed values: acceptance gates --------------------------------------------------------
MIN_AMOUNT_F1 = 0.80
MIN_LAYER1_PRECISION = 1.0


def gates(field: DataFrame, detection: DataFrame) -> DataFrame:
    """Whether the amount F1 and the layer-1 precision reach their floors."""
    amount = field.filter(F.col("campo") == "total").select(
        F.lit("f1_total").alias("gate"), F.col("f1").alias("valor"),
        (F.col("f1") >= MIN_AMOUNT_F1).alias("aprobado"),
    )
    hashes = detection.filter(F.col("detector") == "capa_1").select(
        F.lit("precision_capa_1").alias("gate"), F.col("precision").alias("valor"),
        (F.col("precision") >= MIN_LAYER1_PRECISION).alias("aprobado"),
    )
    return amount.unionByName(hashes)


def tally(df: DataFrame, status: str = "estado") -> DataFrame:
    """How many rows ended in each outcome."""
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("total"))
