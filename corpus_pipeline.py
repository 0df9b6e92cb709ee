"""Documents to training samples: language ID, near-dedup, source mixing, piece sampling.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the docs of the next one. Stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipstone.llm import langid, mixing, neardup, pieces
from slipstone.session import spool

TARGET = mixing.MixTarget(entropy_share=0.95)


def _free(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, texts without a letter and scores
    under the calibrated bound go. The model learns from the labelled rows of ``docs``."""
    mark = _free("language", docs)
    judged = langid.predict(docs, langid.fit(docs), mark)
    return judged.filter(~F.col(f"{mark}.rejected")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    gone = neardup.near_duplicates(docs).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture uses it, at least once; token shares of the
    sources follow the target weights. A row per use, with the columns of documents. A null
    source is a source of its own, a null text has no tokens, rows that repeat source and doc_id
    (nulls together) are used equally often; an empty table stays empty."""
    packed = docs.select(
        "doc_id", "source", mixing.token_count(F.col("text")).alias("n_tokens"), F.struct(*docs.columns).alias("row")
    )
    return mixing.uses(packed, TARGET, "row").select("row.*")


def piece_samples(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every row, as piece ids."""
    return pieces.sample_encodings(docs, public_tokenizers.path("piece_bpe_32k.model"), samples=2)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("piece_samples", piece_samples),
]

#: a trained model and sampled segmentations are beyond SQL; the operators' own tests hold these
#: against brute force or held-out rows, the pipeline's tests check what each stage keeps on small
#: tables by the operators themselves
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir))
    return docs
