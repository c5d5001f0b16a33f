"""Mixing sources to target weights by Poisson replication.

Every source has a repetition rate: the bytes it should have over the bytes it has. A document
is copied k times, where k is found by inverting the Poisson distribution of that mean at a
number in [0, 1) made of the seed and doc_id alone. So no task needs to know of another, a lost
executor's rows come out the same again, and the mean of the copies is the rate. Copies get a
hash as order key and are dealt and sorted by it: a global shuffle.

The one aggregate is by source, on partial sums; a source with a third of all rows is a few
rows then. The rates are one row per source, with a distribution of at most 200 numbers. Up to
``SOURCES`` of them, by count, are broadcast, so that documents move once, in the shuffle. More
are joined by a sort-merge of both sides, whose hot keys AQE splits; documents are never the
broadcast side.

Defined results: null is a source of its own; null text has no bytes; rows with one doc_id (or
none) get one number of copies; a source without a given weight gets no copies; an empty table
gives no rows. The documents' columns are kept, whatever their names, but for ``copy``, ``copies``
and ``order_key``, which replace columns of these names; ``repeated`` keeps those too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.repeats import packed
from ledgerweave.session import cut_lineage

SEED = "mix-1"
#: Weight of a source: its bytes to this power.
SMOOTHING = 0.7
#: Sources whose rates are broadcast, 2 KB each at most.
SOURCES = 10_000
#: A rate above this is the sum of several parts, each inverted by a number of its own.
PART = 64


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits, fixed by the text of the parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(documents: DataFrame, weights: DataFrame | None = None, by: str = "source", epochs: float = 1.0) -> DataFrame:
    """``_source``, ``rate``: what each source's documents must be repeated by, on average.

    ``weights`` has a row (``source``, ``weight``) per source; without it a source weighs its
    bytes to the power ``SMOOTHING``. ``epochs`` times the bytes of the input come out.
    """
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1
    sizes = documents.select(F.col(by).cast("string").alias("_source"), size.cast("long").alias("n"))
    sizes = cut_lineage(sizes.groupBy("_source").agg(F.sum("n").cast("double").alias("bytes")))
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow("bytes", F.lit(SMOOTHING)))
    else:
        given = weights.select(F.col("source").cast("string").alias("_w"), F.col("weight").cast("double"))
        weighted = sizes.join(given, F.col("_source").eqNullSafe(F.col("_w"))).drop("_w")
    whole = sizes.agg(F.sum("bytes")).first()[0] or 0.0
    shares = weighted.agg(F.sum("weight")).first()[0] or 1.0
    rate = F.lit(whole * float(epochs)) * F.col("weight") / F.lit(shares) / F.col("bytes")
    return weighted.select("_source", rate.alias("rate"))


def with_distribution(table: DataFrame) -> DataFrame:
    """Rates with ``_parts`` and ``_cdf``, the distribution of one part: P(k <= 0), P(k <= 1), ..."""
    part = table.withColumn("_parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    part = part.withColumn("_mean", F.col("rate") / F.col("_parts"))
    last = F.ceil(F.col("_mean") + 12 * F.sqrt("_mean") + 24).cast("int")
    zero = F.exp(-F.col("_mean"))
    start = F.struct(zero.alias("p"), zero.alias("c"), F.array(zero).alias("all"))

    def more(state, k):
        p = state["p"] * F.col("_mean") / k
        c = state["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(state["all"], F.array(c)).alias("all"))

    return part.withColumn("_cdf", F.aggregate(F.sequence(F.lit(1), last), start, more, lambda s: s["all"])).drop("_mean")


def _copies(documents: DataFrame, table: DataFrame, by: str, seed: str) -> DataFrame:
    """``_doc``, the row packed, with ``copy`` from 1, ``copies`` and ``order_key``; not shuffled yet."""
    rows = packed(documents)
    key = F.coalesce(F.col("_doc.doc_id").cast("string"), F.lit("null"))
    table = cut_lineage(with_distribution(table))
    table = F.broadcast(table) if table.count() <= SOURCES else table.hint("merge")
    known = rows.join(table, F.col("_doc").getField(by).cast("string").eqNullSafe(F.col("_source")))
    draws = F.transform(
        F.sequence(F.lit(0), F.col("_parts") - 1),
        lambda j: F.size(F.filter("_cdf", lambda c: c <= uniform(F.lit(seed), key, j.cast("string")))),
    )
    drawn = known.withColumn("copies", F.aggregate(draws, F.lit(0), lambda a, b: a + b)).filter("copies > 0")
    copied = drawn.select("_doc", "copies", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), key, F.col("copy").cast("string")).cast("binary"))
    return copied.withColumn("order_key", F.substring(order, 1, 16))


def _shuffled(copies: DataFrame) -> DataFrame:
    parts = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartition(parts, "order_key", "_doc.doc_id").sortWithinPartitions("order_key", "_doc.doc_id")


def mixed(documents: DataFrame, weights: DataFrame | None = None, by: str = "source", epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """The documents repeated to the target weights, in a random order over all partitions.

    A row per copy, with ``copy`` from 1, ``copies`` and ``order_key``.
    """
    copies = _shuffled(_copies(documents, rates(documents, weights, by, epochs), by, seed))
    own = [F.col("_doc").getField(c).alias(c) for c in documents.columns if c not in ("copy", "copies", "order_key")]
    return copies.select(*own, "copy", "copies", "order_key")


def repeated(documents: DataFrame, weights: DataFrame | None = None, by: str = "source", epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """As :func:`mixed`, with the documents' columns alone, as they were."""
    return _shuffled(_copies(documents, rates(documents, weights, by, epochs), by, seed)).select("_doc.*")


def op10_poisson_mixing(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(documents).select("doc_id", "source", "copy", "copies", "order_key")


OP10_SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source, sum(coalesce(strlen(text), 0) + 1)::DOUBLE AS bytes FROM documents GROUP BY source),
rates AS (
  SELECT source, (SELECT sum(bytes) FROM sizes) * 1.0::DOUBLE * pow(bytes, {SMOOTHING}::DOUBLE)
                 / (SELECT sum(pow(bytes, {SMOOTHING}::DOUBLE)) FROM sizes) / bytes AS rate FROM sizes),
parts AS (
  SELECT source, greatest(ceil(rate / {PART}), 1)::INT AS parts,
         rate / greatest(ceil(rate / {PART}), 1)::INT AS mean FROM rates),
cdf(source, parts, mean, k, p, c) AS (
  SELECT source, parts, mean, 0, exp(-mean), exp(-mean) FROM parts
  UNION ALL
  SELECT source, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf
  WHERE k < ceil(mean + 12 * sqrt(mean) + 24)),
draws AS (
  SELECT d.doc_id, d.source, coalesce(d.doc_id::VARCHAR, 'null') AS key, j,
         ('0x' || substr(md5(concat_ws(':', '{SEED}', coalesce(d.doc_id::VARCHAR, 'null'), j)), 1, 13))::BIGINT
         / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(p.parts)) t(j)),
counts AS (
  SELECT w.doc_id, w.source, w.key, count(c.k)::INT AS copies
  FROM draws w JOIN cdf c ON w.source IS NOT DISTINCT FROM c.source AND c.c <= w.u
  GROUP BY w.doc_id, w.source, w.key)
SELECT doc_id, source, copy::INT AS copy, copies,
       substr(md5(concat_ws(':', '{SEED}', 'order', key, copy)), 1, 16) AS order_key
FROM counts, unnest(range(1, copies + 1)) u(copy)
"""
