"""Exact dedup: static binary-fuse filters of a snapshot screen the digests that come in.

A snapshot is immutable: one record per distinct normalised text, dealt into buckets by
digest, with one binary-fuse filter per bucket. A new batch is grouped by digest first, so
copies within the batch never meet the snapshot one by one. The filter of a group's bucket
answers "surely new" or "maybe known"; only the maybes join the snapshot's records, where the
32 digest bytes and the length of the normalised text are compared. Copies of a text are one
row before anything joins, so a text with a third of all rows is no hot key until the verdict
goes back to the rows; that join has plain shuffles on both sides, which AQE splits.

Defined results: null text counts as empty, empty texts equal one another; a null doc_id
comes after every other one; rows that repeat a doc_id count one by one in ``group_size`` and
carry the same verdict, though ``deduplicated`` keeps one row of a group; an empty table gives no rows. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.arrays import mix
from ledgerweave.llm.repeats import one_of_each, row_hash
from ledgerweave.session import stored

BLANKS = " \t\n\x0b\f\r"


class FuseFilter:
    """A 3-wise binary-fuse filter with 16-bit fingerprints over distinct 64-bit keys."""

    def __init__(self, seed: int, segment: int, span: int, slots: np.ndarray):
        self.seed, self.segment, self.span, self.slots = seed, segment, span, slots

    @staticmethod
    def _places(keys, seed, segment, span):
        h = mix(keys + np.uint64(seed))
        first = ((h >> np.uint64(32)) * np.uint64(span)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * segment)) ^ (h & mask)
        marks = ((h ^ (h >> np.uint64(29))) & np.uint64(0xFFFF)).astype(np.uint16)
        return np.stack([first, second, third]).astype(np.int64), marks

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 2)
        segment = 1 << min(18, max(2, int(math.log(n) / math.log(3.33) + 2.25)))
        room = round(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
        span = max(1, math.ceil(room / segment) - 2) * segment
        for attempt in range(200):
            seed = (attempt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
            places, marks = cls._places(keys, seed, segment, span)
            slots = cls._fill(places, marks, span + 2 * segment)
            if slots is not None:
                return cls(seed, segment, span, slots)
        raise RuntimeError("no seed peels the keys")

    @staticmethod
    def _fill(places, marks, size):
        """Peel all slots with one key at once, round by round; fill them in reverse."""
        degree = np.bincount(places.ravel(), minlength=size)
        names = np.zeros(size, np.int64)  # xor of the keys' numbers at a slot
        for row in places:
            np.bitwise_xor.at(names, row, np.arange(places.shape[1]))
        rounds, left = [], places.shape[1]
        while left:
            alone = np.flatnonzero(degree == 1)
            if not len(alone):
                return None
            key, first = np.unique(names[alone], return_index=True)
            rounds.append((key, alone[first]))
            left -= len(key)
            for row in places[:, key]:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(names, row, key)
        slots = np.zeros(size, np.uint16)
        for key, at in reversed(rounds):
            rest = slots[places[0, key]] ^ slots[places[1, key]] ^ slots[places[2, key]]
            slots[at] = marks[key] ^ rest ^ slots[at]
        return slots

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        places, marks = self._places(keys.astype(np.uint64), self.seed, self.segment, self.span)
        found = self.slots[places[0]] ^ self.slots[places[1]] ^ self.slots[places[2]]
        return found == marks

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.span], np.uint64).tobytes() + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> FuseFilter:
        seed, segment, span = map(int, np.frombuffer(blob, np.uint64, 3))
        return cls(seed, segment, span, np.frombuffer(blob, np.uint16, offset=24))


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def fingerprints(documents: DataFrame) -> DataFrame:
    """``digest`` and ``bytes`` of the normalised text, ``chars`` of the original, ``row`` (a hash)."""
    text = F.col("text").cast("string")
    plain = documents.select(
        "doc_id", row_hash().alias("row"), normalised(text).alias("n"), F.length(text).alias("chars")
    )
    return plain.select(
        "doc_id",
        "row",
        F.unhex(F.sha2("n", 256)).alias("digest"),
        F.octet_length("n").alias("bytes"),
        F.coalesce("chars", F.lit(0)).alias("chars"),
    )


def _groups(rows: DataFrame) -> DataFrame:
    """One record per digest: the row that stays (most code points, least doc_id, least hash), the count."""
    best = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("no"), "doc_id", "row")
    return rows.groupBy("digest", "bytes").agg(F.min(best).alias("best"), F.count("*").alias("size"))


def _key() -> Column:
    return F.xxhash64("digest")


def _build(table: pa.Table) -> pa.Table:
    blob = FuseFilter.build(table.column("key").to_numpy().view(np.uint64)).to_bytes()
    return pa.table(
        {"bucket": table.column("bucket").slice(0, 1), "filter": pa.array([blob], pa.binary())}
    )


def filters(records: DataFrame, buckets: int) -> DataFrame:
    """One filter row per bucket that has records."""
    keys = records.select(F.pmod(_key(), F.lit(buckets)).alias("bucket"), _key().alias("key"))
    return keys.groupBy("bucket").applyInArrow(_build, "bucket long, filter binary")


def _screen(incoming: pa.Table, known: pa.Table) -> pa.Table:
    keys = incoming.column("key").to_numpy().view(np.uint64)
    maybe = np.zeros(len(keys), bool)
    if known.num_rows and len(keys):
        maybe = FuseFilter.from_bytes(known.column("filter")[0].as_py()).maybe(keys)
    return pa.table({"digest": incoming.column("digest"), "maybe": pa.array(maybe)})


def screen(incoming: DataFrame, known: DataFrame, buckets: int) -> DataFrame:
    """``digest`` of every incoming group and whether the snapshot may hold it."""
    keys = incoming.select(
        "digest", F.pmod(_key(), F.lit(buckets)).alias("bucket"), _key().alias("key")
    )
    return (
        keys.groupBy("bucket")
        .cogroup(known.groupBy("bucket"))
        .applyInArrow(_screen, "digest binary, maybe boolean")
    )


def merge(snapshot: DataFrame, incoming: DataFrame, buckets: int) -> DataFrame:
    """Records of the snapshot and of a new batch, both one row per digest, as one set."""
    seen = incoming.join(screen(incoming, filters(snapshot, buckets), buckets), "digest")
    maybe = seen.filter("maybe").select(
        "digest", "bytes", F.col("best").alias("new"), F.col("size").alias("more")
    )
    # Filters err to the safe side; the join compares the digest bytes and the length.
    joined = snapshot.join(maybe, ["digest", "bytes"], "full_outer").select(
        "digest",
        "bytes",
        F.least("best", "new").alias("best"),
        (F.coalesce("size", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("size"),
    )
    return joined.unionByName(seen.filter("not maybe").drop("maybe"))


def exact_groups(documents: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest, row, keep_row`` for every row of ``documents``.

    ``kept`` is by doc_id, so several rows of a group can have it; ``keep_row`` is the hash of one.
    Rows fall into two batches by a hash of doc_id: the first is the immutable snapshot, the
    second comes in. No row is left out, and the split has no effect on the result.
    """
    buckets = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = stored(fingerprints(documents))
    old = F.xxhash64("doc_id") >= 0
    snapshot = stored(_groups(rows.filter(old)))
    incoming = stored(_groups(rows.filter(~old)))
    groups = stored(merge(snapshot, incoming, buckets))
    return rows.join(groups.drop("bytes"), "digest").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("best.doc_id")).alias("kept"),
        "digest",
        "row",
        F.col("best.row").alias("keep_row"),
    )


def deduplicated(documents: DataFrame) -> DataFrame:
    """One row of ``documents`` of each group, with all its columns, also if doc_ids repeat or are null."""
    best = exact_groups(documents).filter("row = keep_row").groupBy(F.col("row").alias("_stay"))
    return one_of_each(documents, stored(best.agg((F.count("*") > 1).alias("_one"))))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    rows = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM d WINDOW w AS (PARTITION BY n ORDER BY chars DESC, doc_id)
"""
