"""Windows of k units that start in more than one document, found by content-routed shards.

Rows are dealt into blocks once, and three passes read them from there:

1. Every window of k units has an anchor: the least hash of its m-unit grams. Consecutive
   windows with one anchor form a run. Each block sends the distinct anchors it has, and
   whether it has them in several rows, to the anchors' shards, which reply to a block those
   that are elsewhere too. What repeats nowhere goes no further.
2. Blocks send the runs of repeated anchors, each distinct one once with the least and greatest
   doc_id it has here, to the shards of the anchors. Equal windows have equal anchors, so they
   meet in one shard. An engine finds, for every window of its runs, the least doc_id in which
   the window starts, and blocks get back what lies before one of their own rows.
3. Blocks find their runs again, look up the replies by a run's hash, and mark the units.

A passage of k units or more in a third of all documents is few runs per block, not one per row.
A shorter phrase that is the anchor in many documents is a distinct run in each. Replies call an
anchor of ``CROWD`` runs or more crowded; its runs are dealt out as finer ones, by longer grams
that reach beyond the phrase, to the shards of those. Equal windows hold equal grams of any
length, so they still meet. Shards work through their runs in parts of ``PART`` units; of one
anchor with more, the runs are made finer there until parts fit, down to windows that are equal.
Blocks and shards number with ``spark.sql.shuffle.partitions``, and with the bytes of text where
that would leave more than ``SHARE`` to a shard.

Rows alike in doc_id and text are one row to this module and get one answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.arrays import block_hashes, expand, flat, gram_hashes, mix, pieces

#: doc_id of rows that have none: after every other.
NO_ID = np.iinfo(np.int64).max
#: Units that an engine works on at once.
PART = 1 << 20
#: Runs, over all blocks, from which an anchor's are dealt to several shards.
CROWD = 1 << 14
#: Bytes of text for a shard at most, on average.
SHARE = 24 << 20

#: Texts of a piece to units and where each text's begin and end.
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Engine: units, cuts of the runs, their least doc_ids -> least doc_id of every window, run by run.
Engine = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def packed(documents: DataFrame) -> DataFrame:
    """Each row as one column ``_doc``, so that no name of its columns meets another."""
    return documents.select(F.struct("*").alias("_doc"))


def row_hash(of: str = "") -> Column:
    """A hash of a row's doc_id and text, by which passes over the same rows know them again."""
    doc_id, text = (F.col(f"{of}.{c}" if of else c) for c in ("doc_id", "text"))
    return F.xxhash64(doc_id.cast("long"), F.coalesce(text.cast("string"), F.lit("")))


def shards_for(documents: DataFrame) -> int:
    """As many as the session has shuffle partitions, or more where texts are large for these."""
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = documents.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    return max(partitions, -(-size // SHARE))


def blocks_of(documents: DataFrame, per_partition: int = 2, partitions: int = 0) -> DataFrame:
    """``block, row, doc_id, text``: every row in a block by a hash of what it holds."""
    count = per_partition * (partitions or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("row", row_hash())
    return rows.select(F.pmod("row", F.lit(count)).cast("int").alias("block"), "row", "doc_id", "text")


def one_of_each(documents: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows with a ``row_hash`` of ``stay`` (``_stay``, and ``_one``: whether rows alike are to be one).

    Of rows alike in doc_id and text the one stays whose other columns have the least hash. Few are
    grouped for it: only rows with a ``_stay`` that ``_one`` says several have.
    """
    rows = packed(documents).withColumn("_row", row_hash("_doc"))
    whole = rows.join(stay.filter("not _one").select("_stay"), F.col("_row") == F.col("_stay"), "left_semi")
    alike = rows.join(stay.filter("_one").select("_stay"), F.col("_row") == F.col("_stay"), "left_semi")
    # Maps have neither a hash nor an order.
    rest = [F.col("_doc").getField(f.name) for f in documents.schema if "map<" not in f.dataType.simpleString()]
    first = F.min_by("_doc", F.xxhash64(*rest))
    # As in ``row_hash``, a null text is an empty one.
    text = F.coalesce(F.col("_doc.text").cast("string"), F.lit("")).alias("_text")
    one = alike.groupBy(F.col("_doc.doc_id").alias("_id"), text).agg(first.alias("_doc"))
    return whole.select("_doc.*").unionByName(one.select("_doc.*"))


def ids_of(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(NO_ID).to_numpy()


class Runs:
    """Runs of windows with one anchor, over the units of several texts."""

    def __init__(self, units: np.ndarray, cuts: np.ndarray, k: int, m: int):
        self.k, self.m = k, m
        self.units = units
        n = len(units)
        stop = np.repeat(cuts[1:], np.diff(cuts))
        at = np.flatnonzero(np.arange(n) + k <= stop)  # where windows start
        least, width, want = np.zeros(0, np.uint64), 1, k - m + 1
        if len(at):
            least = gram_hashes(units, m)
            spare = np.empty_like(least)
            while width < want:  # least of ever wider stretches
                more = min(width, want - width)
                wider = spare[: len(least) - more]
                np.minimum(least[:-more], least[more:], out=wider)
                least, spare, width = wider, least, width + more
        anchors = least[at]
        fresh = np.ones(len(at), bool)
        stop = stop[at]
        fresh[1:] = (anchors[1:] != anchors[:-1]) | (at[1:] != at[:-1] + 1) | (stop[1:] != stop[:-1])
        begin = np.flatnonzero(fresh)
        self.anchor = anchors[begin]
        self.start = at[begin]
        self.windows = np.diff(np.append(begin, len(at)))
        self.text = np.searchsorted(cuts, self.start, "right") - 1
        self.end = self.start + self.windows + k - 1

    def finer(self, which: np.ndarray, crowded: np.ndarray) -> tuple[np.ndarray, ...]:
        """Anchors, starts, ends, texts and first anchors of these runs, cut by longer grams where crowded (sorted).

        What a run is cut into depends on its own units alone.
        """
        anchor, start, end, text = (a[which] for a in (self.anchor, self.start, self.end, self.text))
        if not len(crowded):
            return anchor, start, end, text, anchor
        dense = crowded[np.minimum(np.searchsorted(crowded, anchor), len(crowded) - 1)] == anchor
        own = np.flatnonzero(dense)
        found = [(anchor[~dense], start[~dense], end[~dense], text[~dense], anchor[~dense])]
        for part in bounded(end[own] - start[own], PART):
            some = own[part]
            lengths = end[some] - start[some]
            cuts = np.concatenate([[0], np.cumsum(lengths)])
            fine = Runs(self.units[expand(start[some], lengths)], cuts, self.k, self.k - (self.k - self.m) // 5)
            move = (start[some] - cuts[:-1])[fine.text]
            found.append((fine.anchor, fine.start + move, fine.end + move, text[some][fine.text], anchor[some][fine.text]))
        return tuple(np.concatenate([f[i] for f in found]) for i in range(5))


def bounded(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of neighbours with ``most`` in all, or of one that has more."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    begin = 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + most, "right")) - 1)
        yield slice(begin, end)
        begin = end


def shard_of(anchors: np.ndarray, shards: int) -> np.ndarray:
    return (mix(anchors ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(shards)).astype(np.int64)


def _bytes(values: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """The values between the cuts, as bytes."""
    data = np.ascontiguousarray(values).tobytes()
    cuts = (cuts * values.dtype.itemsize).tolist()
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def _taken(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The values of all runs, one after another; places are made for ``PART`` of them at once."""
    parts = [values[expand(starts[own], lengths[own])] for own in bounded(lengths, PART)]
    return np.concatenate(parts) if parts else values[:0]


def _read(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and how many each row has."""
    buf, offsets = flat(column)
    return np.frombuffer(buf.tobytes(), dtype), np.diff(offsets) // np.dtype(dtype).itemsize


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _walk(table: pa.Table, units: Units, k: int, m: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Runs]]:
    """Pieces of a block: place of the rows in it, units, cuts, runs."""
    place = 0
    for part in pieces(table, "text"):
        found, cuts = units(*flat(part.column("text")))
        yield np.arange(place, place + part.num_rows), found, cuts, Runs(found, cuts, k, m)
        place += part.num_rows


def _ask(units: Units, k: int, m: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        anchors, rows = [], []
        keys = table.column("row").to_numpy()
        for place, _, _, runs in _walk(table, units, k, m):
            anchors.append(runs.anchor)
            rows.append(keys[place[runs.text]])
        anchors, rows = np.concatenate(anchors), np.concatenate(rows)
        order = np.lexsort((rows, anchors))
        anchors, rows = anchors[order], rows[order]
        first = np.ones(len(anchors), bool)
        first[1:] = anchors[1:] != anchors[:-1]
        group = np.cumsum(first) - 1
        several = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
        several[group[1:][~first[1:] & (rows[1:] != rows[:-1])]] = True
        # In one byte: how many runs, as a power of two, and whether of several rows.
        several = np.frexp(np.bincount(group))[1].astype(np.uint8) - np.uint8(1) + np.uint8(128) * several
        anchors = anchors[first]
        shard = shard_of(anchors, shards)
        order = np.argsort(shard, kind="stable")
        anchors, several, shard = anchors[order], several[order], shard[order]
        used = np.unique(shard)
        cuts = np.append(np.searchsorted(shard, used), len(shard))
        return pa.table(
            {
                "shard": pa.array(used, pa.int32()),
                "block": pa.repeat(table.column("block")[0], len(used)),
                "anchors": pa.array(_bytes(anchors, cuts), pa.binary()),
                "several": pa.array(_bytes(several, cuts), pa.binary()),
            }
        )

    return run


def _reply(table: pa.Table) -> pa.Table:
    """To each block, its anchors that several rows have, there or in all blocks together, and the crowded ones."""
    anchors, counts = _read(table.column("anchors"), np.uint64)
    several, _ = _read(table.column("several"), np.uint8)
    block = np.repeat(table.column("block").to_numpy(), counts)
    _, which, times = np.unique(anchors, return_inverse=True, return_counts=True)
    many = times > 1
    many[which[several >= 128]] = True
    hit = many[which]
    crowd = np.bincount(which, np.ldexp(1.0, several & 127)) >= CROWD
    block, anchors, crowd = block[hit], anchors[hit], crowd[which[hit]]
    order = np.argsort(block, kind="stable")
    block, anchors, crowd = block[order], anchors[order], crowd[order]
    used = np.unique(block)
    cuts = np.append(np.searchsorted(block, used), len(block))
    return pa.table(
        {
            "block": pa.array(used, pa.int32()),
            "anchors": pa.array(_bytes(anchors, cuts), pa.binary()),
            "crowded": pa.array(_bytes(anchors[crowd], np.searchsorted(np.flatnonzero(crowd), cuts)), pa.binary()),
        }
    )


def _send(units: Units, k: int, m: int, shards: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        empty = {c: pa.array([], pa.binary()) for c in ("hashes", "anchors", "least", "most", "lengths", "units", "crowded")}
        none = pa.table({"shard": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), **empty})
        if not table.num_rows or not replies.num_rows:
            return none
        wanted = np.sort(_read(replies.column("anchors"), np.uint64)[0])
        crowded = np.sort(_read(replies.column("crowded"), np.uint64)[0])
        ids = ids_of(table)
        parts: list[tuple] = []
        for place, found, _, runs in _walk(table, units, k, m):
            at = np.minimum(np.searchsorted(wanted, runs.anchor), len(wanted) - 1)
            hit = np.flatnonzero(wanted[at] == runs.anchor)
            anchor, start, end, text, coarse = runs.finer(hit, crowded)
            hashes = block_hashes(found, start, end)
            _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            doc = ids[place[text]]
            least = np.full(len(first), NO_ID)
            most = np.full(len(first), np.iinfo(np.int64).min)
            np.minimum.at(least, which, doc)
            np.maximum.at(most, which, doc)
            lengths = (end - start)[first]
            values = _taken(found, start[first], lengths)
            parts.append((hashes[first], anchor[first], least, most, lengths, values, coarse[first]))
        hashes, anchors, least, most, lengths, values, coarse = (np.concatenate([p[i] for p in parts]) for i in range(7))
        parts.clear()
        if not len(hashes):
            return none
        starts = np.cumsum(lengths) - lengths
        # Once per block: the same run from several pieces.
        order = np.argsort(hashes, kind="stable")
        first = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]])
        least = np.minimum.reduceat(least[order], first)
        most = np.maximum.reduceat(most[order], first)
        order = order[first]
        shard = shard_of(anchors[order], shards)
        by = np.argsort(shard, kind="stable")
        order, shard, least, most = order[by], shard[by], least[by], most[by]
        used = np.unique(shard)
        cuts = np.append(np.searchsorted(shard, used), len(shard))
        lengths, starts, anchors, coarse = lengths[order], starts[order], anchors[order], coarse[order]
        own = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
        split = [np.unique(coarse[o][coarse[o] != anchors[o]]).tobytes() for o in own]
        return pa.table(
            {
                "shard": pa.array(used, pa.int32()),
                "block": pa.repeat(table.column("block")[0], len(used)),
                "hashes": pa.array(_bytes(hashes[order], cuts), pa.binary()),
                "anchors": pa.array(_bytes(anchors, cuts), pa.binary()),
                "least": pa.array(_bytes(least, cuts), pa.binary()),
                "most": pa.array(_bytes(most, cuts), pa.binary()),
                "lengths": pa.array(_bytes(lengths.astype(np.int32), cuts), pa.binary()),
                "units": pa.array([_packed(_taken(values, starts[o], lengths[o]).tobytes()) for o in own], pa.binary()),
                "crowded": pa.array(split, pa.binary()),
            }
        )

    return run


SENT = (
    "shard int, block int, hashes binary, anchors binary, least binary, most binary, lengths binary, units binary, "
    "crowded binary"
)
FOUND = "block int, hashes binary, at binary, windows binary, docs binary, crowded binary"


def _equal(units: np.ndarray, start: np.ndarray, windows: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """Least doc_id of every window, where most windows are equal."""
    at, out = expand(start, windows), np.empty(int(windows.sum()), np.int64)
    owner, todo = np.repeat(docs, windows), np.arange(len(out))
    while len(todo):
        first, same = at[todo[0]], np.ones(len(todo), bool)
        for i in range(k):
            same &= units[at[todo] + i] == units[first + i]
        out[todo[same]] = owner[todo[same]].min()
        todo = todo[~same]
    return out


def least_of_windows(
    engine: Engine, units: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, docs: np.ndarray, k: int, m: int
) -> np.ndarray:
    """The engine's least doc_id of every window of the runs, sorted by anchors of m units, in parts of ``PART`` units.

    Where one anchor has more, its windows are sorted by longer grams, which deal them to smaller parts.
    """
    edge = np.concatenate([[0], np.cumsum(size - k + 1)])
    out = np.empty(int(edge[-1]), np.int64)
    groups = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    bounds = np.append(groups, len(anchor))
    for part in bounded(np.add.reduceat(size, groups) if len(groups) else groups, PART):
        own = slice(bounds[part.start], bounds[part.stop])
        if part.stop - part.start > 1 or size[own].sum() <= PART:
            cuts = np.concatenate([[0], np.cumsum(size[own])])
            found = engine(units[expand(start[own], size[own])], cuts, docs[own])
        elif m == k:
            found = _equal(units, start[own], size[own] - k + 1, docs[own], k)
        else:
            found = _by_longer_grams(engine, units, start[own], size[own], docs[own], k, k - (k - m) // 2)
        out[edge[own.start] : edge[own.stop]] = found
    return out


def _by_longer_grams(
    engine: Engine, units: np.ndarray, start: np.ndarray, size: np.ndarray, docs: np.ndarray, k: int, m: int
) -> np.ndarray:
    """``least_of_windows`` of runs with one anchor, by anchors of m units."""
    windows = size - k + 1
    # A run of more than half a part is cut into stretches of windows.
    step = max(1, PART // 2)
    count = -(-windows // step)
    run = np.repeat(np.arange(len(size)), count)
    skip = expand(np.zeros(len(size), np.int64), count) * step
    start, docs = start[run] + skip, docs[run]
    windows = np.minimum(windows[run] - skip, step)
    edge = np.concatenate([[0], np.cumsum(windows)])
    fine: list[tuple] = []
    for own in bounded(windows + k - 1, PART):
        size = windows[own] + k - 1
        cuts = np.concatenate([[0], np.cumsum(size)])
        runs = Runs(units[expand(start[own], size)], cuts, k, m)
        inside = runs.start - cuts[runs.text]
        fine.append((runs.anchor, start[own][runs.text] + inside, runs.windows, docs[own][runs.text], edge[own][runs.text] + inside))
    anchor, start, windows, docs, place = (np.concatenate([f[i] for f in fine]) for i in range(5))
    fine.clear()
    order = np.argsort(anchor, kind="stable")
    found = least_of_windows(engine, units, start[order], windows[order] + k - 1, anchor[order], docs[order], k, m)
    out = np.empty(int(edge[-1]), np.int64)
    out[expand(place[order], windows[order])] = found
    return out


def _solve(engine: Engine, k: int, m: int, dtype):
    def run(table: pa.Table) -> pa.Table:
        hashes, counts = _read(table.column("hashes"), np.uint64)
        anchors, _ = _read(table.column("anchors"), np.uint64)
        least, _ = _read(table.column("least"), np.int64)
        most, _ = _read(table.column("most"), np.int64)
        lengths, _ = _read(table.column("lengths"), np.int32)
        values = np.frombuffer(b"".join(map(_unpacked, table.column("units").to_pylist())), dtype)
        block = np.repeat(table.column("block").to_numpy(), counts)
        lengths = lengths.astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        # Every distinct run once, with the least doc_id of all blocks; in the order of anchors.
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        low = np.full(len(first), NO_ID)
        np.minimum.at(low, which, least)
        order = np.argsort(anchors[first], kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        first, low, which = first[order], low[order], rank[which]
        size, anchor = lengths[first], anchors[first]
        windows = size - k + 1
        edge = np.concatenate([[0], np.cumsum(windows)])
        results = least_of_windows(engine, values, starts[first], size, anchor, low, k, m)
        # Stretches of windows with one least doc_id.
        run_of = np.repeat(np.arange(len(first)), windows)
        fresh = np.ones(len(results), bool)
        fresh[1:] = (results[1:] != results[:-1]) | (run_of[1:] != run_of[:-1])
        piece = np.flatnonzero(fresh)
        doc, owner = results[piece], run_of[piece]
        at = piece - edge[owner]
        length = np.diff(np.append(piece, len(results)))
        # Back to each block that sent the run, where one of its rows comes after the doc_id.
        from_, to = np.searchsorted(owner, which), np.searchsorted(owner, which, "right")
        each = expand(from_, to - from_)
        sender = np.repeat(np.arange(len(which)), to - from_)
        late = doc[each] < most[sender]
        each, sender = each[late], sender[late]
        order = np.argsort(block[sender], kind="stable")
        each, sender = each[order], sender[order]
        used = np.unique(block[sender])
        cuts = np.append(np.searchsorted(block[sender], used), len(sender))
        columns = {
            "hashes": hashes[sender],
            "at": at[each].astype(np.int32),
            "windows": length[each].astype(np.int32),
            "docs": doc[each],
        }
        found = {c: pa.array(_bytes(v, cuts), pa.binary()) for c, v in columns.items()}
        # A block learns of the crowded anchors again where their runs come back to it.
        split = dict(zip(table.column("block").to_pylist(), table.column("crowded").to_pylist()))
        found["crowded"] = pa.array([split[b] for b in used.tolist()], pa.binary())
        return pa.table({"block": pa.array(used, pa.int32()), **found})

    return run


def marked(table: pa.Table, found: pa.Table, units: Units, k: int, m: int) -> Iterator[tuple]:
    """Pieces of a block: its rows, units, cuts, and which units a repeated window covers."""
    ids = ids_of(table)
    hashes, _ = _read(found.column("hashes"), np.uint64)
    at, windows = (_read(found.column(c), np.int32)[0].astype(np.int64) for c in ("at", "windows"))
    docs, _ = _read(found.column("docs"), np.int64)
    crowded = np.unique(_read(found.column("crowded"), np.uint64)[0])
    order = np.argsort(hashes, kind="stable")
    hashes, at, windows, docs = hashes[order], at[order], windows[order], docs[order]
    for place, values, cuts, runs in _walk(table, units, k, m):
        _, begin, end, text, _ = runs.finer(slice(None), crowded)
        own = block_hashes(values, begin, end)
        low, high = np.searchsorted(hashes, own), np.searchsorted(hashes, own, "right")
        each = expand(low, high - low)
        run = np.repeat(np.arange(len(own)), high - low)
        late = docs[each] < ids[place[text[run]]]
        each, run = each[late], run[late]
        cover = np.zeros(len(values) + 1, np.int64)
        start = begin[run] + at[each]
        np.add.at(cover, start, 1)
        np.add.at(cover, start + windows[each] + k - 1, -1)
        yield place, values, cuts, np.cumsum(cover[:-1]) > 0


def repeated(documents: DataFrame, units: Units, engine: Engine, k: int, m: int, dtype, finish, schema: str) -> DataFrame:
    """Run the three passes; ``finish(table, found)`` makes the rows of a block."""
    shards = shards_for(documents)
    blocks = blocks_of(documents, partitions=shards)
    asked = blocks.groupBy("block").applyInArrow(
        _ask(units, k, m, shards), "shard int, block int, anchors binary, several binary"
    )
    replies = asked.groupBy("shard").applyInArrow(_reply, "block int, anchors binary, crowded binary")
    sent = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_send(units, k, m, shards), SENT)
    found = sent.groupBy("shard").applyInArrow(_solve(engine, k, m, dtype), FOUND)
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(finish, schema)
