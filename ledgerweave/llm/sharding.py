"""Sharding by histogram sort: exact byte counts below probes place the splitters.

Rows are ordered by (hash of the text, hash of doc_id), so equal texts stand together and a
group of copies too large for a shard runs on into the next. The order is cut into cells of
near equal bytes; every shard is the same number of cells. Each round counts the exact bytes
and rows between probe keys over all partitions, keeps the one interval per cut in which the
goal lies, and probes that interval more finely, until the bytes left in it are within the
tolerance. Then all rows move once, to their cells, and are numbered there.

What reaches the driver is bounded by the number of cells: at most ``PROBES`` sums per open
cut and one count per cell. Everything is DataFrame functions.

Defined results: null text has no bytes and crc32 0, like an empty one; a null doc_id is a
value like others; rows alike in doc_id and text cannot be told apart by any cut and stay
together; an empty table gives no rows. The output keeps all columns of the documents; its
own are ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` and replace
columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.session import cut_lineage

PROBES = 256
#: Bytes by which a cut may miss its goal, as a share of a cell.
TOLERANCE = 1 / 1000
TOP = 1 << 62


def keyed(documents: DataFrame) -> DataFrame:
    """The documents with ``size`` and ``text_crc32`` and the sort key ``_h``, ``_d``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.withColumns(
        {
            "size": (F.octet_length(text) + 8).cast("long"),
            "text_crc32": F.crc32(text.cast("binary")),
            "_h": F.shiftrightunsigned(F.xxhash64(text), 2),
            "_d": F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("row")), 2),
        }
    )


class Cut:
    """A cut of the order: all keys below (h, d) lie before it."""

    def __init__(self, goal: int):
        self.goal = goal
        self.low, self.high = 0, TOP  # of h, later of d
        self.h: int | None = None  # the one h within which d is probed
        self.below = 0  # bytes before ``low``
        self.done: tuple[int, int] | None = None

    def step(self) -> int:
        return max(1, -(-(self.high - self.low) // PROBES))


def _round(keys: DataFrame, cuts: list[Cut], slack: int) -> None:
    """Count the bytes between the probes of all open cuts and narrow each to one interval."""
    spans = sorted({(c.h if c.h is not None else -1, c.low, c.high, c.step()) for c in cuts})
    found: dict[tuple, dict[int, tuple[int, int, int]]] = {}
    for field in ("_h", "_d"):
        own = [s for s in spans if (s[0] < 0) == (field == "_h")]
        if not own:
            continue
        # The spans are disjoint and few: a row looks its span up among their lower ends.
        rows = [(i, *s) for i, s in enumerate(own)]
        table = keys.sparkSession.createDataFrame(rows, "span int, at long, low long, high long, step long")
        if field == "_h":
            hit = (F.col("_h") >= F.col("low")) & (F.col("_h") <= F.col("high") - 1)
        else:
            hit = (F.col("_h") == F.col("at")) & F.col("_d").between(F.col("low"), F.col("high") - 1)
        sums = (
            _with_span(keys, own, field, table, hit)
            .groupBy("span", F.expr(f"({field} - low) div step").alias("probe"))
            .agg(F.sum("size").alias("bytes"), F.min(field).alias("least"), F.max(field).alias("most"))
            .collect()
        )
        for r in sums:
            found.setdefault(own[r.span], {})[r.probe] = (r.bytes, r.least, r.most)
    for c in cuts:
        inside = found.get((c.h if c.h is not None else -1, c.low, c.high, c.step()), {})
        below = c.below
        for probe in sorted(inside):
            bytes_, least, most = inside[probe]
            if below + bytes_ > c.goal:
                break
            below += bytes_
        else:
            c.done = (c.high, 0) if c.h is None else (c.h, c.high)
            continue
        c.below, c.low, c.high = below, least, most + 1
        if c.goal - below <= slack:
            c.done = (least, 0) if c.h is None else (c.h, least)
        elif least == most and c.h is None:
            c.h, c.low, c.high = least, 0, TOP  # within one text's copies: go on by doc_id
        elif least == most:
            # One key is left; the cut goes to the nearer side of it.
            near = least if 2 * (c.goal - below) <= bytes_ else least + 1
            c.done = (c.h, near)


def _with_span(keys, own, field, table, hit):
    if len(own) == 1 and own[0][0] < 0:
        _, low, high, step = own[0]
        return keys.select(
            field, "size", F.lit(0).alias("span"), F.lit(low).alias("low"), F.lit(step).alias("step")
        ).filter(F.col(field).between(low, high - 1))
    return keys.join(F.broadcast(table.withColumn("bin", F.explode(_bins(own)))), [_bin() == F.col("bin"), hit])


def _bin():
    """A coarse bin of the order, by which rows find the cuts near them without a scan of all."""
    return F.shiftrightunsigned("_h", 50)


def _bins(own):
    """The coarse bins a span reaches into; spans are narrow after the first round."""
    first = F.when(F.col("at") < 0, F.col("low")).otherwise(F.col("at"))
    last = F.when(F.col("at") < 0, F.col("high") - 1).otherwise(F.col("at"))
    return F.sequence(F.shiftrightunsigned(first, 50), F.shiftrightunsigned(last, 50))


def splitters(keys: DataFrame, cells: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """``cells - 1`` cuts that give every cell the same bytes, within the tolerance."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    cuts = [Cut(total * i // cells) for i in range(1, cells)]
    slack = int(total / cells * tolerance)
    while pending := [c for c in cuts if c.done is None]:
        _round(keys, pending, slack)
    return sorted(c.done for c in cuts)


def sharded(documents: DataFrame, shards: int = 24, tolerance: float = TOLERANCE) -> DataFrame:
    """All rows and columns with their shard, near equal in bytes, and their slot in it."""
    spark = documents.sparkSession
    rows = keyed(documents)
    keys = cut_lineage(rows.select("_h", "_d", "size"))
    per_shard = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    cuts = splitters(keys, shards * per_shard, tolerance)
    located = rows.join(F.broadcast(_lookup(spark, cuts)), _bin() == F.col("_b"), "left").withColumn(
        "_cell",
        (
            F.col("_base")
            + F.size(
                F.filter("_cuts", lambda c: (c["h"] < F.col("_h")) | ((c["h"] == F.col("_h")) & (c["d"] <= F.col("_d"))))
            )
        ).cast("int"),
    )
    sizes = {r["_cell"]: r["n"] for r in _cells(keys, spark, cuts).collect()}
    offsets, seen = [], 0
    for cell in range(shards * per_shard):
        if cell % per_shard == 0:
            seen = 0
        offsets.append((cell, seen))
        seen += sizes.get(cell, 0)
    starts = spark.createDataFrame(offsets, "_cell int, _start long")
    # The one exchange of the rows: to their cells, where they are put in order and numbered.
    order = Window.partitionBy("_cell").orderBy("_h", "_d", "doc_id")
    placed = located.withColumn("_n", F.row_number().over(order) - 1)
    return placed.join(F.broadcast(starts), "_cell").withColumns(
        {
            "law": F.lit("bytes"),
            "shard": F.floor(F.col("_cell") / per_shard).cast("int"),
            "slot": F.col("_start") + F.col("_n"),
            "grown_shard": F.lit(None).cast("int"),
        }
    ).drop("_cell", "_start", "_n", "_h", "_d", "_b", "_base", "_cuts")


def _lookup(spark, cuts):
    """Per coarse bin: how many cuts lie before it, and the cuts within. 4096 rows plus the cuts."""
    by: dict[int, list] = {}
    for h, d in cuts:
        by.setdefault(min(h >> 50, 4095), []).append((h, d))
    rows, base = [], 0
    for b in range(4096):
        own = by.get(b, [])
        rows.append((b, base, own))
        base += len(own)
    return spark.createDataFrame(rows, "_b long, _base int, _cuts array<struct<h:long,d:long>>")


def _cells(keys, spark, cuts):
    found = keys.join(F.broadcast(_lookup(spark, cuts)), _bin() == F.col("_b"))
    before = F.size(
        F.filter("_cuts", lambda c: (c["h"] < F.col("_h")) | ((c["h"] == F.col("_h")) & (c["d"] <= F.col("_d"))))
    )
    return found.groupBy((F.col("_base") + before).cast("int").alias("_cell")).agg(F.count("*").alias("n"))


def op5_histogram_shards(spark, sf_dir: str) -> DataFrame:
    rows = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
