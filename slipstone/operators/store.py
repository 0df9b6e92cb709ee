"""Writes expressed as frames: insert-if-absent, checkpointed work lists, store paths, shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..config import ScoringConfig
from ..functions import documents as doc
from ..functions.amounts import strip
from .keyed import attach_first


def insert_if_absent(new: DataFrame, existing: DataFrame, key: str, order: list[str]) -> DataFrame:
    """New rows whose key is not stored yet, the first one (by ``order``) per key."""
    fresh = new.join(existing.select(key).distinct(), key, "left_anti")
    stamped = attach_first(fresh, [key], order, "first")
    return stamped.filter(F.col("first") == F.struct(*order)).drop("first")


def pending(all_ids: DataFrame, done: DataFrame, key: str = "image_id") -> DataFrame:
    """Work list: ids without an output row yet (blank ids never count as done)."""
    finished = done.select(strip(F.col(key).cast("string")).alias("__k")).filter("__k <> ''")
    return all_ids.join(
        finished.distinct(), F.col(key).cast("string") == F.col("__k"), "left_anti"
    )


def stored_documents(docs: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Where each new document goes: one row per hash, with year, month and path.

    ``docs(id_comprobante, content, ext, fecha_registro)``; documents already held are left out.
    """
    sized = docs.select(
        "id_comprobante",
        F.octet_length("content").cast("bigint").alias("bytes"),
        doc.document_hash("content").alias("hash_documento"),
        "ext",
        "fecha_registro",
        F.year("fecha_registro").alias("year"),
        F.month("fecha_registro").alias("month"),
    )
    problem = doc.store_problem("bytes", "hash_documento", "ext", "month")
    good = sized.filter(problem.isNull() & doc.size_problem("bytes").isNull())
    if held is not None:
        good = good.join(held.select("hash_documento").distinct(), "hash_documento", "left_anti")
    order = ["fecha_registro", "id_comprobante"]
    first = attach_first(good, ["hash_documento"], order, "first").filter(
        F.col("first.id_comprobante") == F.col("id_comprobante")
    )
    return first.drop("first").withColumn(
        "path", doc.store_path("hash_documento", "ext", "year", "month")
    )


def enrich_text(truth: DataFrame, texts: DataFrame, key: str = "id") -> DataFrame:
    """Fill ``texto_extraido`` where it is missing or blank; everything else is kept."""
    offered = texts.select(key, F.col("texto_extraido").alias("__new"))
    current = F.col("texto_extraido")
    return (
        truth.join(offered, key, "left")
        .withColumn(
            "texto_extraido",
            F.when(strip(F.coalesce(current, F.lit(""))) == "", F.coalesce("__new", current))
            .otherwise(current),
        )
        .drop("__new")
    )


def pending_text(df: DataFrame) -> DataFrame:
    """Rows whose text is missing or blank."""
    return df.filter(strip(F.coalesce("texto_extraido", F.lit(""))) == "")


def without_internal_fields(df: DataFrame, nested: str = "extended") -> DataFrame:
    """Drop nested fields whose name starts with ``_``."""
    names = [f.name for f in df.schema[nested].dataType.fields if f.name.startswith("_")]
    return df.withColumn(nested, F.col(nested).dropFields(*names)) if names else df


def response(v: DataFrame) -> DataFrame:
    """API shape: extracted fields nested, the deposit date named ``fecha``, bank never null."""
    return v.select(
        "id_comprobante",
        "id_usuario",
        "estado_actual",
        "hash_documento",
        "imagen_path",
        "fecha_registro",
        F.struct(
            "monto",
            F.col("fecha_deposito").alias("fecha"),
            "referencia",
            "numero_operacion",
            F.coalesce(F.nullif("banco", F.lit("")), F.lit(vocab.BANK_OTHER)).alias("banco"),
        ).alias("campos_extraidos"),
    )


LIST_COLUMNS = [
    "id_comprobante", "imagen_path", "referencia", "monto",
    "fecha_deposito", "banco", "estado_actual", "fecha_registro",
]
DETAIL_COLUMNS = LIST_COLUMNS + ["texto_extraido", "numero_operacion"]


def list_view(v: DataFrame) -> DataFrame:
    """The list's columns; the text column is never read."""
    return v.select(*LIST_COLUMNS)


def detail_view(v: DataFrame) -> DataFrame:
    return v.select(*DETAIL_COLUMNS)


def weights_row(config: DataFrame) -> DataFrame:
    """The four weights as one row: stored value where it reads as a number, else the default."""
    picked = config.filter(F.col("key").isin(*vocab.WEIGHT_KEYS)).agg(
        *[
            F.max(F.when(F.col("key") == key, F.col("value").try_cast("double"))).alias(name)
            for key, name in vocab.WEIGHT_KEYS.items()
        ]
    )
    return picked.select(
        *[
            F.coalesce(name, F.lit(vocab.DEFAULT_WEIGHTS[name])).alias(name)
            for name in vocab.WEIGHT_KEYS.values()
        ]
    )


def load_weights(config: DataFrame, cfg: ScoringConfig = ScoringConfig()) -> ScoringConfig:
    """Scoring parameters with the stored weights (one row comes to the driver)."""
    return cfg.with_weights(**weights_row(config).first().asDict())


def document_guard(docs: DataFrame, content: str = "content") -> DataFrame:
    """Size and reason of each document; ``motivo`` is null for acceptable ones."""
    size = F.octet_length(content).cast("bigint")
    return docs.withColumn("bytes", size).withColumn("motivo", doc.size_problem("bytes"))


def fee_check(slips: DataFrame, cents: str = "0.01") -> DataFrame:
    """Whether total = amount + fee + 16 % VAT holds on each row, within a cent."""
    from ..functions.amounts import total_with_fee, vat_of

    expected = total_with_fee("monto", "comision")
    gap: Column = F.abs(F.col("importe_total") - expected)
    return slips.withColumns(
        {
            "iva_esperado": vat_of("comision"),
            "total_esperado": expected,
            "cuadra": gap <= F.lit(cents).cast("decimal(5,2)"),
        }
    )
