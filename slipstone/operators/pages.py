"""Pages at any offset: history stored as sorted runs with their counts.

A page at offset n of a plain query sorts and discards everything before it. Here the rows are
sorted once into runs of bounded size; a page adds up the counts, one row per run, and reads only
the runs that hold it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .reports import _newest_first


@dataclass(frozen=True)
class PageIndex:
    """``path`` holds the runs, ``counts(run, n, antes)`` how many rows each has and come before it."""

    path: str
    schema: StructType
    counts: DataFrame
    total: int

    def page(self, limit: int, offset: int) -> DataFrame:
        """Rows ``offset`` up to ``offset + limit`` in newest-first order; empty beyond the end."""
        spark = self.counts.sparkSession
        first = self.counts.filter(
            (F.col("antes") < offset + limit) & (F.col("antes") + F.col("n") > offset)
        ).orderBy("run").collect()
        if not first or limit <= 0:
            return spark.createDataFrame([], self.schema)
        # only the runs that hold the page: at most its own length of them
        rows = spark.read.schema(self.schema).parquet(*[f"{self.path}/runs/run={r['run']}" for r in first])
        return rows.orderBy(*_newest_first()).offset(offset - first[0]["antes"]).limit(limit)


def build_page_index(rows: DataFrame, path: str, run_rows: int = 100_000) -> PageIndex:
    """Sort ``rows(fecha_registro, id_comprobante, ...)`` into runs of about ``run_rows`` below ``path``."""
    runs = max(1, -(-rows.count() // run_rows))
    order = _newest_first()
    sorted_rows = rows.repartitionByRange(runs, *order).sortWithinPartitions(*order)
    sorted_rows.withColumn("run", F.spark_partition_id()).write.partitionBy("run").parquet(f"{path}/runs")
    return open_page_index(rows.sparkSession, path, rows.schema)


def open_page_index(spark: SparkSession, path: str, schema: StructType) -> PageIndex:
    """An index that was built before."""
    wide = StructType([*schema.fields, StructField("run", IntegerType())])
    stored = spark.read.schema(wide).option("basePath", f"{path}/runs").parquet(f"{path}/runs")
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    # one row per run, written once beside them
    place = f"{path}/counts"
    counts.withColumn("antes", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")).write.mode("overwrite").parquet(place)
    kept = spark.read.schema("run int, n long, antes long").parquet(place)
    total = kept.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return PageIndex(path, schema, kept, total)
