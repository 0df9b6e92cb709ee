"""Writers: pairs CSV, metrics JSON, ground-truth JSON, the content-addressed store, appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..operators.store import without_internal_fields


def write_pairs_csv(pairs: DataFrame, path: str, mode: str = "error") -> None:
    pairs.select(*vocab.PAIR_COLUMNS).write.mode(mode).option("header", "true").option(
        "escape", '"'
    ).csv(path)


def write_accuracy_csv(acc: DataFrame, path: str, mode: str = "append") -> None:
    """Appends by default, so that an interrupted run continues with what is pending."""
    acc.select(*[c for c in vocab.ACCURACY_COLUMNS if c in acc.columns]).write.mode(mode).option(
        "header", "true"
    ).csv(path)


def write_metrics_json(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    metrics.write.mode(mode).json(path)


def write_truth_json(truth: DataFrame, path: str, mode: str = "error") -> None:
    """Ground-truth records as JSON lines, internal nested fields dropped."""
    without_internal_fields(truth).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_store(documents: DataFrame, path: str) -> None:
    """Append documents partitioned by year and month; rows come from ``stored_documents``."""
    documents.withColumn("month", F.lpad(F.col("month").cast("string"), 2, "0")).write.mode(
        "append"
    ).partitionBy("year", "month").parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
