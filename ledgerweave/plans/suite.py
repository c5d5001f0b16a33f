"""Run a set of named queries and report on each."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT = """
    query STRING,
    status STRING,
    row_count BIGINT,
    columns ARRAY<STRING>,
    preview ARRAY<STRING>,
    digest DECIMAL(38,0),
    error STRING
"""


def run_suite(
    spark: SparkSession, queries: Mapping[str, Callable[[], DataFrame]], preview: int = 10
) -> DataFrame:
    """One row per query; a query that fails is reported and the others go on.

    Rows are counted where they are; only up to ``preview`` of them come back, the least
    by their JSON text. ``digest`` is a sum over all rows of the first 60 bits of their text's
    MD5, which no order of rows or tasks changes: equal results have equal digests, and a row
    that differs, is missing or comes twice shows. One job per query gives all three.
    """
    report = []
    for name, build in queries.items():
        try:
            rows = build()
            count, digest, sample = _seen(rows, preview)
            report.append((name, "passed", count, rows.columns, sample, digest, None))
        except Exception as problem:  # noqa: BLE001 - the report is the place for it
            report.append((name, "failed", None, [], [], None, str(problem).splitlines()[0]))
    return spark.createDataFrame(report, REPORT)


def row_digest(text: Column) -> Column:
    """The first 60 bits of a text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")


def _seen(rows: DataFrame, preview: int) -> tuple[int, Decimal, list[str]]:
    texts = rows.select(F.to_json(F.struct("*")).alias("row"))
    counted = texts.agg(F.count("*").alias("n"), F.sum(row_digest(F.col("row"))).alias("digest"))
    counted = counted.withColumn("row", F.lit(None).cast("string"))
    if preview:
        least = texts.orderBy("row").limit(preview)
        nothing = [F.lit(None).cast("long").alias("n"), F.lit(None).cast("decimal(38,0)").alias("digest")]
        counted = counted.unionByName(least.select(*nothing, "row"))
    found = counted.collect()
    total = next(r for r in found if r.n is not None)
    return total.n, total.digest or Decimal(0), sorted(r.row for r in found if r.n is None)


def suite_totals(report: DataFrame) -> DataFrame:
    """(passed, failed, total)."""
    return report.agg(
        F.count_if(F.col("status") == "passed").alias("passed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count("*").alias("total"),
    )
