"""Benchmark decontamination by winnowing: shared fingerprints are joined and extended to windows.

A window is ``WINDOW`` consecutive words of a benchmark item; an item of fewer words, but not
none, is one window of its own size. Of the ``WINDOW - GRAM + 1`` grams in a window, the one of
the least hash (the last of ties) is its fingerprint. The same words choose the same fingerprint
wherever they stand, so each occurrence of a window in a document shows one that the benchmark
has too: no shared span of ``WINDOW`` words is missed. Fingerprints of a document are looked up
among those of the benchmark; those that are there are extended to the windows that chose them,
which are compared as a whole by two independent 64-bit hashes of their words. Short items have
themselves as their fingerprint.

The distinct windows of the benchmark are grouped by Spark, each with its items, and dealt into
blocks of about ``BLOCK`` pairs of window and item by their hash. A block is what tasks hold in
memory: its size is checked by counting, and a benchmark of more pairs is searched in several
passes, whose hits are put together per document. With one block, the usual case, documents are
read once and not shuffled at all, however many of them show an item. Windows with the same
items share one list, so a phrase of all items costs a document one entry and not one a window.

Defined results: a null text has no words, nor has one without word characters; an item without
words is in no document; rows of the benchmark with one item_id are one item; a null item_id
counts as an empty one. Rows that repeat a doc_id, or have none, are judged each by its own text.
An empty benchmark leaves every document clean; an empty table gives no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.arrays import block_hashes, expand, flat, mix, pieces, runs_of
from ledgerweave.session import cut_lineage

WINDOW = 10
GRAM = 5
#: Pairs of window and item in one block, some 60 bytes each.
BLOCK = 1_000_000

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

WINDOWS = "size int, print long, high long, low long, item_id string"
HITS = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _weights(n: int, seed: int) -> list[np.uint64]:
    return [np.uint64(w) for w in mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)]


def _runs(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of the ``size`` words from every word on that has so many behind it."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, weight in enumerate(_weights(size, seed)):
        total += hashes[j : j + n] * weight
    return mix(total)


class Words:
    """The words of a piece: places, owners and hashes, with their windows and fingerprints."""

    def __init__(self, column: pa.Array):
        buf, offsets = flat(column)
        self.buf = LOWER[buf]
        self.starts, self.ends, self.owner = runs_of(IS_WORD[self.buf], offsets)
        self.hashes = block_hashes(self.buf, self.starts, self.ends)
        self.first = np.searchsorted(self.owner, np.arange(len(offsets)))  # of each text

    def inside(self, size: int) -> np.ndarray:
        """Words that begin a run of ``size`` words of one text."""
        n = len(self.owner) - size + 1
        return np.flatnonzero(self.owner[:n] == self.owner[size - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def prints(self, gram: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every gram, and for each first word of ``width`` grams the chosen one."""
        grams = _runs(self.hashes, gram, 1)
        n = max(len(grams) - width + 1, 0)
        chosen, least = np.arange(n), grams[:n].copy()
        for j in range(1, width):
            here = grams[j : j + n]
            take = here <= least
            least[take] = here[take]
            chosen[take] = np.flatnonzero(take) + j
        return grams, chosen

    def whole(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the ``size`` words from each place on."""
        high = _runs(self.hashes, size, 2)[at]
        places, back = np.unique(expand(at, np.full(len(at), size)), return_inverse=True)
        second = block_hashes(self.buf, self.starts[places], self.ends[places], 7)[back].reshape(-1, size)
        low = np.zeros(len(at), np.uint64)
        for j, weight in enumerate(_weights(size, 3)):
            low += second[:, j] * weight
        return high, mix(low)


def _shape(size: int, window: int, gram: int) -> tuple[int, int]:
    """Gram size and number of grams among which a window of ``size`` words chooses."""
    return (gram, window - gram + 1) if size == window else (size, 1)


def benchmark_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``size, print, high, low, item_id`` of every window of every item, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part.column("text"))
                counts = np.diff(words.first)
                ids = part.column("item_id")
                for size in sorted({int(min(c, window)) for c in counts if c}):
                    at = words.inside(size)
                    if size < window:
                        at = at[counts[words.owner[at]] == size]
                    if not len(at):
                        continue
                    grams, chosen = words.prints(*_shape(size, window, gram))
                    made = [grams[chosen[at]], *words.whole(at, size)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(at), size, np.int32)),
                            *[pa.array(x.view(np.int64)) for x in made],
                            ids.take(pa.array(words.owner[at])),
                        ],
                        ["size", "print", "high", "low", "item_id"],
                    )

    ids = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")
    return items.select(ids, F.col("text").cast("string").alias("text")).mapInArrow(run, WINDOWS)


class Block:
    """Windows of a benchmark with their items, as sorted arrays."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        lists: dict[tuple[str, ...], int] = {}
        which = [lists.setdefault(tuple(items), len(lists)) for items in rows.column("items").to_pylist()]
        self.lists = list(lists)
        which = np.array(which, np.int64)
        sizes = rows.column("size").to_numpy()
        got = {c: rows.column(c).to_numpy().view(np.uint64) for c in ("print", "high", "low")}
        self.sizes = {}
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            own = own[np.lexsort((got["low"][own], got["high"][own]))]
            prints = np.unique(got["print"][own])
            self.sizes[size] = prints, got["high"][own], got["low"][own], which[own]

    def found(self, words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, size and number of the item list of every window that occurs."""
        out = [np.zeros((3, 0), np.int64)]
        for size, (prints, high, low, which) in self.sizes.items():
            at = words.inside(size)
            if not len(at):
                continue
            grams, chosen = words.prints(*_shape(size, window, gram))
            places = chosen[at]  # neighbours mostly choose the same gram
            new = np.r_[True, places[1:] != places[:-1]]
            shared = _among(prints, grams[places[new]])[np.cumsum(new) - 1]
            at = at[shared]
            if not len(at):
                continue
            h, v = words.whole(at, size)
            left = np.searchsorted(high, h)
            for step in range(len(high)):  # windows alike in one hash stand next to each other
                spot = np.minimum(left + step, len(high) - 1)
                same = (high[spot] == h) & (left + step < len(high))
                if not same.any():
                    break
                hit = same & (low[spot] == v)
                out.append(np.stack([at[hit], np.full(hit.sum(), size), which[spot[hit]]]))
        return tuple(np.concatenate(out, axis=1))


def _among(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` the sorted ``known`` has."""
    if not len(known):
        return np.zeros(len(wanted), bool)
    return known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted


def _search(documents: DataFrame, block: Block, window: int, gram: int) -> DataFrame:
    """The rows of ``documents`` (``doc_id, text``) with ``HITS`` and a digest of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part.column("text"))
                at, size, which = block.found(words, window, gram)
                depth = np.zeros(len(words.owner) + 1, np.int64)
                np.add.at(depth, at, 1)
                np.add.at(depth, at + size, -1)
                hit = np.cumsum(depth)[:-1] > 0
                # A run of hit words does not cross texts.
                edge = np.diff(np.r_[False, hit, False].astype(np.int8))
                inner = words.first[1:-1]
                cut = inner[(inner > 0) & (inner < len(hit))]
                cut = np.unique(cut[hit[cut] & hit[cut - 1]])
                begin = np.sort(np.r_[np.flatnonzero(edge == 1), cut])
                end = np.sort(np.r_[np.flatnonzero(edge == -1), cut])
                home = words.owner[begin] if len(begin) else begin
                base = words.first[home]
                spans: list[list] = [[] for _ in range(part.num_rows)]
                for t, a, b in zip(home.tolist(), (begin - base).tolist(), (end - base).tolist()):
                    spans[t].append({"start": a, "end": b})
                items: list[set] = [set() for _ in range(part.num_rows)]
                for t, w in np.unique(np.stack([words.owner[at], which]), axis=1).T.tolist() if len(at) else ():
                    items[t].update(block.lists[w])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("digest"),
                        pa.array(np.diff(words.first)),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                    ],
                    ["doc_id", "digest", "n_words", "spans", "items"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.mapInArrow(run, f"doc_id {kind}, digest binary, {HITS}")


def _merged(spans):
    """Overlapping spans, sorted, as few that do not overlap."""
    def step(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["start"]),
                      F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))
                      ).otherwise(F.concat(done, F.array(span)))

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.aggregate(F.array_sort(spans), none, step)


def contaminated(
    documents: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK
) -> DataFrame:
    """``doc_id, n_words, spans, items`` for every row of ``documents``.

    ``spans`` are the runs of hit words, ``items`` the sorted ids of the items that occur.
    """
    windows = benchmark_windows(items, window, gram).groupBy("size", "print", "high", "low")
    windows = cut_lineage(windows.agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    pairs = windows.agg(F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("n")).first().n
    blocks = max(1, math.ceil(pairs / block))
    text = F.col("text").cast("string")
    # The digest tells rows apart that share a doc_id; rows alike in both have the same hits.
    digest = (F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)) if blocks > 1 else F.lit(None).cast("binary")).alias("digest")
    docs = documents.select("doc_id", text.alias("text"), digest)
    passes = []
    for number in range(blocks):
        own = windows.filter(F.pmod(F.col("high"), F.lit(blocks)) == number)
        passes.append(_search(docs, Block(own.toArrow()), window, gram))
    if blocks == 1:
        return passes[0].drop("digest")
    passes = [cut_lineage(p) for p in passes]  # one block in a worker's memory at a time
    hits = passes[0]
    for other in passes[1:]:
        hits = hits.unionByName(other)
    hits = hits.filter(F.size("items") > 0).groupBy("doc_id", "digest").agg(
        _merged(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    base = passes[0].select("doc_id", "digest", "n_words")
    hits = hits.withColumnsRenamed({"doc_id": "hit_doc", "digest": "hit_digest"})
    same = F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("digest") == F.col("hit_digest"))
    return base.join(hits, same, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def digests(found: DataFrame) -> DataFrame:
    """Counts and digest columns of :func:`contaminated`."""
    zero = F.lit(0).cast("long")
    n_hit = F.aggregate("spans", zero, lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op11_winnowing_decontamination(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(contaminated(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


OP11_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
gram AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, sizes WHERE len(w) >= k)),
hit AS (SELECT r, i, k, item_id FROM gram JOIN win USING (k, g)),
word AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
seen AS (
  SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(word.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(seen.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(word.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN seen USING (r)
"""
