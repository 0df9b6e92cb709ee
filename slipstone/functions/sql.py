"""The column functions as Spark SQL functions: plain expressions, no Python worker.

Each is made from the column expression itself, so that SQL and DataFrame code can't differ; Spark
puts the expression in place of the call and optimises it like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession

from . import amounts, dates, documents, extract, similarity, text

#: name -> (parameters, result type, expression over columns of those names)
FUNCTIONS: dict[str, tuple[str, str, Callable[[], Column]]] = {
    "slip_amount": ("x STRING", "DECIMAL(15,2)", lambda: amounts.parse_amount("x")),
    "slip_amount_signed": ("x STRING", "DECIMAL(15,2)", lambda: amounts.parse_amount_signed("x")),
    "slip_amount_similarity": ("a DOUBLE, b DOUBLE", "DOUBLE", lambda: amounts.amount_similarity("a", "b")),
    "slip_within": ("a DECIMAL(15,2), b DECIMAL(15,2)", "BOOLEAN", lambda: amounts.within_tolerance("a", "b")),
    "slip_date": ("x STRING", "DATE", lambda: dates.parse_date("x")),
    "slip_date_similarity": ("a DATE, b DATE", "DOUBLE", lambda: dates.date_similarity("a", "b")),
    "slip_reference": ("x STRING", "STRING", lambda: text.normalize_reference("x")),
    "slip_slug": ("x STRING", "STRING", lambda: text.slug("x")),
    "slip_mask_accounts": ("x STRING", "STRING", lambda: extract.mask_accounts("x")),
    "slip_mask_cards": ("x STRING", "STRING", lambda: extract.mask_cards("x")),
    "slip_hash": ("x BINARY", "STRING", lambda: documents.document_hash("x")),
    "slip_mime": ("x BINARY", "STRING", lambda: documents.sniff_mime("x")),
    "slip_class": ("x DOUBLE", "STRING", lambda: similarity.classify("x")),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session; calling it again replaces them."""
    for name, (parameters, result, make) in FUNCTIONS.items():
        with amounts.written_out():
            body = spark._jsparkSession.expression(make()._jc).sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
