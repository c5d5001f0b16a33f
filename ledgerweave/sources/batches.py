"""Tables as folders of batches: a write that is repeated replaces, it does not add.

Every load has a batch id, and its rows are one partition of the table. Spark stages a write
beside the table and moves the partition in when all tasks are done, so a write that fails
leaves the partition as it was, and a retry, or a corrected load under the same id, takes the
place of what was there. Other batches are not read or touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Column with the id of the load that a row came with.
BATCH = "load_batch"


def _checked(batch: str) -> str:
    if not batch or not all(c.isalnum() or c in "-_." for c in batch):
        raise ValueError(f"a batch id has letters, digits and -_. only, not {batch!r}")
    return batch


def write_batch(rows: DataFrame, path: str, batch: str) -> None:
    """Rows of one load; they replace those that ``path`` has of this batch, also if they are none."""
    part, rows = f"{path}/{BATCH}={_checked(batch)}", rows.drop(BATCH)
    if rows.isEmpty():  # a partition without rows is not staged; there is nothing to lose in it
        rows.write.mode("overwrite").parquet(part)
    else:
        writer = rows.withColumn(BATCH, F.lit(batch)).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def insert_batch(rows: DataFrame, table: str, batch: str) -> None:
    """As :func:`write_batch`, into a catalog table partitioned by ``BATCH``, its last column."""
    conf = rows.sparkSession.conf
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = conf.get(setting)
    empty = rows.isEmpty()
    # Rows that name their partition are staged; one named in the statement is emptied by no rows too.
    conf.set(setting, "static" if empty else "dynamic")
    try:
        if empty:
            rows.sparkSession.createDataFrame([], rows.schema).createOrReplaceTempView("no_rows_of_a_batch")
            rows.sparkSession.sql(
                f"INSERT OVERWRITE TABLE {table} PARTITION ({BATCH} = '{_checked(batch)}') SELECT * FROM no_rows_of_a_batch"
            )
        else:
            rows.withColumn(BATCH, F.lit(_checked(batch))).write.mode("overwrite").insertInto(table)
    finally:
        conf.set(setting, before)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all batches, with ``BATCH`` as text."""
    found = spark.read.parquet(path).schema
    fields = [StructField(BATCH, StringType()) if f.name == BATCH else f for f in found.fields]
    return spark.read.schema(StructType(fields)).parquet(path)


def batch_counts(batches: DataFrame) -> DataFrame:
    """(load_batch, n)."""
    return batches.groupBy(BATCH).agg(F.count("*").alias("n"))
