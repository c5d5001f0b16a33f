"""Text tables in, typed tables out."""

from __future__ import annotations

import csv
import re
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerweave.functions.casts import trimmed, typed
from ledgerweave.schema import TableContract
from ledgerweave.session import cut_lineage
from ledgerweave.sources.batches import BATCH, insert_batch, write_batch


REJECTS = "array<struct<column:string,raw:string>>"


#: Column of the raw table with the text of a row that does not have the header's columns.
BROKEN = "_broken_row"

OPTIONS = {"encoding": "UTF-8", "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}


def _schema(columns: list[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in [*columns, BROKEN]])


def parse_lines(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of CSV text (one column ``value``) as text fields, with ``BROKEN``.

    A row with more or fewer fields than ``columns``, or with a quote that is never closed,
    is broken and keeps its text. So is one with U+FFFF, which the parser takes for the end of
    its input and which no text may hold. Blank rows are no rows.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    sound = (quotes % 2 == 0) & ~F.contains("value", F.lit("\uffff"))
    rows = lines.where(F.trim("value") != "").select("value", F.when(sound, F.col("value")).alias("sound"))
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*columns, BROKEN])
    parsed = rows.select("*", F.from_csv("sound", schema, OPTIONS).alias("row"))
    broken = F.when(F.col("sound").isNull(), F.col("value")).otherwise(F.col("row")[BROKEN])
    fields = [F.col("row").getField(c).alias(c) for c in columns]
    return parsed.select(*fields, broken.alias(BROKEN))


#: A line of text as one field: separator and quote are code points that no text may hold.
WHOLE_LINE = {
    "encoding": "UTF-8",
    "sep": "\ufffe",
    "quote": "\uffff",
    "escape": "\uffff",
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": BROKEN,
}


def _lines(spark: SparkSession, path: str | list[str], header: bool) -> DataFrame:
    """Lines that are not blank, with their file and its size; without each file's first if ``header``."""
    reader = spark.read.options(**WHOLE_LINE, header=header).schema(f"value string, {BROKEN} string")
    return reader.csv(path).select(
        F.coalesce(BROKEN, "value").alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"),
    )


def _no_path(problem: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(problem)


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, n_lines) of every file with a line: its first line that is not blank."""
    lines = _lines(spark, path, header=False)
    return lines.groupBy("file").agg(F.min_by("value", "place").alias("header"), F.count("*").alias("n_lines"))


def _names(header: str) -> list[str]:
    """Column names of a header line; of equal names only the last one counts."""
    names = [name or f"_c{i}" for i, name in enumerate(next(csv.reader([header.removeprefix("\ufeff")])))]
    return [f"_unused_{i}" if name in names[i + 1 :] else name for i, name in enumerate(names)]


def _plain_path(file: str) -> str:
    """A file's path as the readers take it: decoded, and nothing in it a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file))


def _by_header(spark: SparkSession, path: str) -> dict[str, list[str] | None]:
    """Header line -> its files; None for all files of ``path``."""
    lines = _lines(spark, path, header=False)
    if len(lines.inputFiles()) <= 1:
        first = lines.first()
        return {first.value: None} if first else {}
    groups: dict[str, list[str]] = {}
    # As many rows as there are files, whose listing the driver holds anyway.
    for row in file_headers(spark, path).select("file", "header").collect():
        groups.setdefault(row.header, []).append(_plain_path(row.file))
    return groups if len(groups) > 1 else dict.fromkeys(groups)


def read_text_table(
    spark: SparkSession, path: str, multi_line: bool = False, declared: Sequence[str] = ()
) -> DataFrame | None:
    """A CSV file or folder with every field as text, and ``BROKEN``; None when there is none.

    Every file has a header of its own, its first line that is not blank, and its fields go by
    the names in it: files may order their columns differently, and lack some, which are NULL.
    Files with one header are one scan. For a folder that means one more pass over its lines,
    which finds the headers. With ``declared`` names, the rows of a file that has none of them
    are broken, each with its text, unless no file has any.

    Spark can split a CSV file among tasks only when no field holds a line break. Say
    ``multi_line=True`` for files where one may; each of them is then one task. Otherwise
    every line is a row by itself, and one whose quote stays open is broken. A header has no
    line break, and with ``multi_line`` only empty lines may stand before it, not lines of blanks.
    """
    try:
        groups = _by_header(spark, path)
    except AnalysisException as problem:
        if _no_path(problem):
            return None
        raise
    known = set(declared)
    any_known = any(known & set(_names(header)) for header in groups)
    found = []
    for header, files in groups.items():
        columns, files = _names(header), files or path
        if any_known and not known & set(columns):
            rows = _lines(spark, files, header=True).select(F.col("value").alias(BROKEN))
        elif multi_line:
            # The columns are given by name here, so what the file calls them is not compared.
            rows = spark.read.options(**OPTIONS, header=True, multiLine=True).schema(_schema(columns)).csv(files)
        else:
            rows = parse_lines(_lines(spark, files, header=True), columns)
        found.append(rows.drop(*[c for c in columns if c.startswith("_unused_")]))
    if not found:
        return spark.createDataFrame([], _schema([]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


MISSING, EMPTY, FOREIGN, NO_ROWS, LOAD = "missing", "empty", "foreign", "no rows", "load"


def list_inputs(spark: SparkSession, folder: str, contracts: Mapping[str, TableContract]) -> DataFrame:
    """(table, file, size, header, n_rows, decision) of every file at ``<folder>/<table>.csv``.

    The decision comes before any field is read: ``missing`` (there is no such path), ``empty``
    (no line), ``foreign`` (no declared column in the header), ``no rows`` (a header alone) or
    ``load``. Names in a header hold no commas.
    """
    found = []
    for table, contract in contracts.items():
        path = f"{folder}/{table}.csv"
        try:
            there = spark.read.format("binaryFile").load(path)
            # The driver's own listing; readers pass over files without a byte.
            files = [(re.sub("^file:/+", "file:/", f),) for f in there.inputFiles()]
            sizes = there.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
            listed = spark.createDataFrame(files or [(None,)], "file string").join(sizes, "file", "left")
            listed = listed.join(file_headers(spark, path), "file", "left")
            listed = listed.withColumns({"size": F.coalesce("bytes", F.lit(0).cast("long")), "there": F.lit(True)})
        except AnalysisException as problem:
            if not _no_path(problem):
                raise
            listed = spark.createDataFrame(
                [(None, None, None, None, False)],
                "file string, size long, header string, n_lines long, there boolean",
            )
        bare = F.translate(F.ltrim(F.col("header"), F.lit("\ufeff")), '"', "")
        known = F.arrays_overlap(F.split(bare, ","), F.array(*[F.lit(c) for c in contract.columns]))
        decision = (
            F.when(~F.col("there"), MISSING)
            .when(F.col("header").isNull(), EMPTY)
            .when(~known, FOREIGN)
            .when(F.col("n_lines") == 1, NO_ROWS)
            .otherwise(LOAD)
        )
        found.append(
            listed.select(
                F.lit(table).alias("table"),
                F.substring_index("file", "/", -1).alias("file"),
                "size",
                "header",
                F.greatest(F.coalesce("n_lines", F.lit(0)) - 1, F.lit(0)).cast("long").alias("n_rows"),
                decision.alias("decision"),
            )
        )
    return reduce(DataFrame.unionByName, found)


def conform(raw: DataFrame, contract: TableContract) -> DataFrame:
    """Typed columns in declared order, plus ``rejects``.

    Columns of the file that are not declared are dropped, declared ones the file
    lacks are NULL. ``rejects`` lists the (column, raw) pairs that have no value of
    the declared type; it is empty for a clean row. A broken row has one reject, its
    whole text without a column, and no values.
    """
    present = [f for f in contract.fields if f.name in raw.columns]
    whole = F.col(BROKEN) if BROKEN in raw.columns else F.lit(None).cast("string")
    # One projection per step: a step that the next one uses twice is not repeated.
    texts = raw.select(
        whole.alias("broken"),
        *[F.col(f.name).alias(f"raw_{f.name}") for f in present],
        *[F.when(whole.isNull(), trimmed(F.col(f.name))).alias(f"text_{f.name}") for f in present],
    )
    values = texts.select(
        "*", *[typed(F.col(f"text_{f.name}"), f.type).alias(f.name) for f in present]
    )
    nothing = F.array().cast(REJECTS)
    found = [
        F.when(
            F.col(f"text_{f.name}").isNotNull() & F.col(f.name).isNull(),
            F.array(
                F.struct(F.lit(f.name).alias("column"), F.col(f"raw_{f.name}").alias("raw"))
            ),
        ).otherwise(nothing)
        for f in present
        if not isinstance(f.type, StringType)
    ]
    finished = F.struct(
        *[
            (F.col(f.name) if f in present else F.lit(None).cast(f.type)).alias(f.name)
            for f in contract.fields
        ],
        F.when(
            F.col("broken").isNotNull(),
            F.array(F.struct(F.lit(None).cast("string").alias("column"), F.col("broken").alias("raw"))),
        )
        .otherwise(F.concat(*found) if found else nothing)
        .alias("rejects"),
    )
    # A filter on the result must not drag all these expressions below itself, where
    # they would be worked out again for every use; it cannot pass a generator.
    return values.select(F.inline(F.array(finished)))


def loadable(conformed: DataFrame) -> DataFrame:
    """The rows whose every field fits."""
    return conformed.where(F.size("rejects") == 0).drop("rejects")


def rejected(conformed: DataFrame, contract: TableContract) -> DataFrame:
    """One row per field that does not fit, with the key of its row."""
    return conformed.select(*contract.primary_key, F.explode("rejects").alias("reject")).select(
        *contract.primary_key, "reject.column", "reject.raw"
    )


def has_declared_columns(raw: DataFrame | None, contract: TableContract) -> bool:
    return raw is not None and any(c in raw.columns for c in contract.columns)


def empty_table(spark: SparkSession, contract: TableContract) -> DataFrame:
    return spark.createDataFrame([], contract.struct())


def read_table(
    spark: SparkSession,
    path: str,
    contract: TableContract,
    multi_line: bool = False,
) -> DataFrame:
    """The clean rows of a text table; an empty table when there is nothing to read."""
    raw = read_text_table(spark, path, multi_line, contract.columns)
    if not has_declared_columns(raw, contract):
        return empty_table(spark, contract)
    return loadable(conform(raw, contract))


def create_table(
    spark: SparkSession, contract: TableContract, name: str, if_not_exists: bool = True, batches: bool = False
) -> None:
    """An empty catalog table with the declared columns, and ``BATCH`` if it is loaded by ``batches``."""
    mode = "ignore" if if_not_exists else "errorifexists"
    rows = empty_table(spark, contract)
    if batches:
        rows.withColumn(BATCH, F.lit("")).write.mode(mode).partitionBy(BATCH).saveAsTable(name)
    else:
        rows.write.mode(mode).saveAsTable(name)


def append_table(rows: DataFrame, contract: TableContract, name: str, batch: str | None = None) -> None:
    """All rows in one distributed write, columns in declared order.

    With a ``batch`` the rows replace those that the table has of it, so a load can be repeated.
    """
    rows = rows.select(*contract.columns)
    if batch is None:
        rows.write.mode("append").saveAsTable(name)
    else:
        insert_batch(rows, name, batch)


def _conformed(
    spark: SparkSession, path: str, contract: TableContract, rejects_path: str | None, batch: str | None, multi_line: bool
) -> DataFrame | None:
    """Typed rows of a text table whose misfits are written out, or stop the load; None without any row."""
    raw = read_text_table(spark, path, multi_line, contract.columns)
    if not has_declared_columns(raw, contract):
        return None
    # The text is read and cast once; what follows starts from the typed rows.
    conformed = cut_lineage(conform(raw, contract))
    if conformed.isEmpty():
        return None
    bad = rejected(conformed, contract)
    if rejects_path is None:
        if not bad.isEmpty():
            raise ValueError(f"{path} holds fields that do not fit {contract.name}")
    elif batch is None:
        bad.write.mode("overwrite").parquet(rejects_path)
    else:
        write_batch(bad, rejects_path, batch)
    return conformed


def load_table(
    spark: SparkSession,
    path: str,
    contract: TableContract,
    name: str,
    rejects_path: str | None = None,
    multi_line: bool = False,
    batch: str | None = None,
) -> bool:
    """Create the table if need be and append a text table to it.

    Returns False, with nothing created, when there is no file, no row or no
    declared column. Fields that do not fit go to ``rejects_path``; without one
    they stop the load, and nothing is appended. A load with a ``batch`` id can be repeated:
    what the table, and the rejects, hold of that batch is replaced.
    """
    conformed = _conformed(spark, path, contract, rejects_path, batch, multi_line)
    if conformed is None:
        return False
    create_table(spark, contract, name, batches=batch is not None)
    append_table(loadable(conformed), contract, name, batch)
    return True


def load_folder(
    spark: SparkSession,
    path: str,
    contract: TableContract,
    target: str,
    batch: str,
    rejects_path: str | None = None,
    multi_line: bool = False,
) -> bool:
    """As :func:`load_table` with a batch, into a folder of batches instead of a catalog table."""
    conformed = _conformed(spark, path, contract, rejects_path, batch, multi_line)
    if conformed is None:
        return False
    write_batch(loadable(conformed).select(*contract.columns), target, batch)
    return True
