"""MinHash near-dedup: bottom-k sketches from one hash function, joined by inverted lists.

1. Every text becomes its set of distinct two-word shingles, as 64-bit hashes; texts with one
   set are one node. A sketch is the ``K`` least hashes of a set.
2. The values that sketches retain are counted. Texts with Jaccard similarity of 0.8 share most
   of their sketches, so each node need only be listed under its rarest values: as many as
   leave fewer than the least overlap. Both sketches hold every shared value among the ``K``
   least of the union. All but a fifth of the union are shared, so with sets of up to 212 shingles
   that bound is exact. Of larger ones the number has mean 102 and deviation 4.5 at most, and
   the overlap is no more than it where one set holds the other; ``OVERLAP`` lies 6 below.
   Values no other sketch has list nobody, which leaves out most nodes here.
3. In each inverted list all nodes are paired with the least one, if their sizes allow 0.8: a
   star, not all pairs. Pairs go on if ``BITS`` words of bits per sketch leave room for enough
   shared values (a bit that one sketch alone has is a value of its own). Where their full sets
   meet, which begin with the sketches, they pass if the sketch of their union estimates
   ``PASS`` or more, which is ``OVERLAP`` of ``K``, and link if the sets confirm 0.8. Links
   make components. One pair of larger sets is lost
   with a chance below 1e-8 (binomial of 128 at 0.8, below 75), by step 2 and 3 together.
4. In lists that still hold several components all nodes are paired with up to ``HUBS`` others,
   the least by as many hashes, as in step 3: this joins most of a large group whose nodes are
   too far from its least one.
   Lists that hold several components even then pair the nodes of different ones, if they have at
   most ``SMALL`` members. For the members of larger ones the exact way is a prefix filter on
   full sets: listed under the rarest fifth of their shingles, and paired only where sizes and
   positions, and the numbers of shared values in each part of the hash range, leave room for
   the overlap that 0.8 takes. Nodes that no partner's size leaves
   room for are taken out of a list before it is joined. No list is capped.
5. Links make the components; those of later steps only join components of earlier ones. Each
   task first makes the components of up to ``EDGES`` edges; if one task held all, they are final.

Copies are one node, a group of near copies is a star per value, and joins have plain shuffles
on both sides, which AQE splits at hot keys. Sketches and full sets are kept nowhere: those of
pairs that bits leave are made from their texts again and travel once per pair, a hub's once per part of its
star, to be met by its partners one after another. The rows that ask for texts are broadcast up
to ``ASKED`` of them by count; more are joined by a shuffle. Otherwise texts move once, into
blocks; counts per value come from blocks, so a value in every text is as many rows as there are
blocks.

Defined results: null and empty texts, and texts of blanks, have an empty set and are linked
with nothing; a text of one word has that word as its set; rows with equal sets are linked,
also if they repeat a doc_id; a null doc_id is greater than any other; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.arrays import block_hashes, flat, lean, mix, pieces, words_of
from ledgerweave.llm.repeats import _bytes, _read, blocks_of, one_of_each, packed, row_hash, shard_of
from ledgerweave.session import stored

K = 128
#: Shared values among the K least of a linked pair's union, at least: mean 102.4, deviation 4.5.
OVERLAP = 75
PASS = OVERLAP / K
SMALL = 64
#: Nodes of a list that all of its nodes are compared with before any two are.
HUBS = 8
#: Words of 64 bits that bound what two sketches share.
BITS = 8
#: Shingles of a star's nodes that one part of it has, about.
STAR = 1 << 20
#: Rows of four numbers that are broadcast to the texts at most.
ASKED = 500_000
#: Parts of the hash range (a power of two) by which the exact way bounds an overlap.
PARTS = 32
#: Edges whose components one task makes at most; more are made by rounds of joins.
EDGES = 1_000_000
#: Share of the entries that a round of the exact way has to leave out for another one.
WORTH = 0.1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in rising order, and where each text's begin and end."""
    n = len(offsets) - 1
    low = _LOWER[buf]
    starts, ends, owner = words_of(low, offsets)
    words = block_hashes(low, starts, ends)
    alone = np.bincount(owner, minlength=n)[owner] == 1
    both = owner[1:] == owner[:-1]
    pairs = mix(words[:-1] * np.uint64(3) + mix(words[1:] + np.uint64(7)))[both]
    values = np.concatenate([pairs, mix(words[alone])])
    owner = np.concatenate([owner[1:][both], owner[alone]])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[first], owner[first]
    return values, np.searchsorted(owner, np.arange(n + 1))


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[cuts[1:]] - total[cuts[:-1]]


def sets(documents: DataFrame) -> DataFrame:
    """``block, row, doc_id, n, node`` for every row: size of its set, and a digest as the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                values, cuts = shingle_sets(*flat(part.column("text")))
                size = np.diff(cuts).astype(np.uint64)
                # Two sums over the set, each over hashes of its own.
                one, two = _sums(mix(values + np.uint64(1)), cuts), _sums(mix(values ^ np.uint64(0x5DEECE66D)), cuts)
                columns = [part.column(c) for c in ("block", "row", "doc_id")]
                columns += [pa.array(size.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["block", "row", "doc_id", "n", "one", "two"])

    made = blocks_of(documents).mapInArrow(lean(run), "block int, row long, doc_id long, n long, one long, two long")
    return made.select("block", "row", "doc_id", "n", F.xxhash64("n", "one", "two").alias("node"))


def _chosen(table: pa.Table, rows: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """The rows of a block with the given keys, once each, in the order of the keys."""
    keys = table.column("row").to_numpy()
    order = np.argsort(keys, kind="stable")
    at = order[np.searchsorted(keys[order], rows)]
    return table.take(pa.array(at)), at


def _sketches(values: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in their text's sketch, and where each text's begin and end."""
    size = np.diff(cuts)
    inside = np.arange(len(values)) - np.repeat(cuts[:-1], size) < K
    return np.flatnonzero(inside), np.concatenate([[0], np.cumsum(np.minimum(size, K))])


def _count(shards: int):
    def run(table: pa.Table, nodes: pa.Table) -> pa.Table:
        found = []
        rows = np.sort(nodes.column("row").to_numpy())
        if len(rows):
            for part in pieces(_chosen(table, rows)[0], "text"):
                values, cuts = shingle_sets(*flat(part.column("text")))
                found.append(values[_sketches(values, cuts)[0]])
        values, counts = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
        shard = shard_of(values, shards)
        order = np.argsort(shard, kind="stable")
        used = np.unique(shard)
        edge = np.append(np.searchsorted(shard[order], used), len(shard))
        block = [nodes.column("block")[0].as_py()] * len(used) if len(rows) else []
        return pa.table(
            {
                "shard": pa.array(used, pa.int32()),
                "block": pa.array(block, pa.int32()),
                "values": pa.array(_bytes(values[order], edge), pa.binary()),
                "counts": pa.array(_bytes(counts[order].astype(np.int32), edge), pa.binary()),
            }
        )

    return run


def _total(table: pa.Table) -> pa.Table:
    """To each block, the counts over all blocks of those of its values that two sketches have."""
    values, lengths = _read(table.column("values"), np.uint64)
    counts, _ = _read(table.column("counts"), np.int32)
    block = np.repeat(table.column("block").to_numpy(), lengths)
    _, which = np.unique(values, return_inverse=True)
    total = np.bincount(which, counts).astype(np.int64)[which]
    hit = np.flatnonzero(total > 1)
    hit = hit[np.argsort(block[hit], kind="stable")]
    used = np.unique(block[hit])
    edge = np.append(np.searchsorted(block[hit], used), len(hit))
    return pa.table(
        {
            "block": pa.array(used, pa.int32()),
            "values": pa.array(_bytes(values[hit], edge), pa.binary()),
            "counts": pa.array(_bytes(total[hit], edge), pa.binary()),
        }
    )


def least_overlap(size: np.ndarray) -> np.ndarray:
    """Values that the sketch of a set with ``size`` shingles shares with a linked one's, at least."""
    # A quarter of either set's size bounds what the two do not share.
    return np.minimum(-(-4 * size // 5), np.maximum(OVERLAP, K - size // 4))


_BIT_COLUMNS = [f"bits{i}" for i in range(BITS)]
LISTED = ", ".join(["node long", "row long", "n int", "listed array<long>", *(f"{c} long" for c in _BIT_COLUMNS)])


def sketch_bits(values: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """``BITS`` words per sketch, with the bit set that each of its values falls on."""
    place = (values & np.uint64(64 * BITS - 1)).astype(np.int64)
    words = np.zeros((rows, BITS), np.uint64)
    np.bitwise_or.at(words, (owner, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    return words


def _list(table: pa.Table, right: pa.Table) -> pa.Table:
    """Nodes of a block that other nodes' lists may hold, with their rare values and the bits of their sketches."""
    own = right.filter(pa.compute.is_valid(right.column("row")))
    rows = own.column("row").to_numpy()
    order = np.argsort(rows, kind="stable")
    nodes = own.column("node").to_numpy()[order]
    known, _ = _read(right.column("values"), np.uint64)
    totals, _ = _read(right.column("counts"), np.int64)
    by = np.argsort(known, kind="stable")
    known, totals = known[by], totals[by]
    out: list[list] = [[], [], [], []]
    bits = [np.zeros((0, BITS), np.uint64)]
    place = 0
    for part in pieces(_chosen(table, rows[order])[0], "text") if len(rows) and len(known) else ():
        values, cuts = shingle_sets(*flat(part.column("text")))
        at, edge = _sketches(values, cuts)
        sketch = values[at]
        spot = np.minimum(np.searchsorted(known, sketch), len(known) - 1)
        count = np.where(known[spot] == sketch, totals[spot], 1)
        owner = np.repeat(np.arange(part.num_rows), np.diff(edge))
        rare = np.lexsort((sketch, count, owner))
        size = np.diff(cuts)
        first = (np.diff(edge) - least_overlap(size) + 1)[owner]
        inside = np.arange(len(sketch)) - edge[owner] < first
        listed = rare[inside & (count[rare] > 1)]
        ends = np.searchsorted(owner[listed], np.arange(part.num_rows + 1))
        chosen = np.flatnonzero(np.diff(ends))
        bits.append(sketch_bits(sketch, owner, part.num_rows)[chosen])
        for i in chosen.tolist():
            out[0].append(int(nodes[place + i]))
            out[1].append(int(rows[order[place + i]]))
            out[2].append(int(size[i]))
            out[3].append(sketch[listed[ends[i] : ends[i + 1]]].view(np.int64).tolist())
        place += part.num_rows
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
    names = ("node", "row", "n", "listed")
    found = {c: pa.array(v, k) for c, v, k in zip(names, out, kinds)}
    words = np.concatenate(bits).view(np.int64)
    return pa.table(found | {c: pa.array(words[:, i].copy()) for i, c in enumerate(_BIT_COLUMNS)})


def listed_nodes(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Step 2: ``nodes`` (block, row, node) that share a rare value with others, see ``LISTED``."""
    shards = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks_of(documents)
    counted = blocks.groupBy("block").cogroup(nodes.groupBy("block"))
    counted = counted.applyInArrow(_count(shards), "shard int, block int, values binary, counts binary")
    totals = counted.groupBy("shard").applyInArrow(_total, "block int, values binary, counts binary")
    right = nodes.unionByName(totals, allowMissingColumns=True)
    return blocks.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(_list, LISTED)


def estimate(one: bytes, two: bytes, n: int, m: int) -> float:
    """Jaccard similarity by the sketch of the union; exact where both sets fit a sketch."""
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    union, times = np.unique(np.concatenate([a, b]), return_counts=True)
    if max(n, m) > K:
        times = times[:K]
    return float((times == 2).sum() / len(times))


def _texts(documents: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """Rows of ``asked``, of which there are ``most`` at most, with the ``text`` of their ``row``."""
    if most <= ASKED:
        asked = F.broadcast(asked)
    return blocks_of(documents).select("row", "text").join(asked, "row")


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, part, b`` with the set of the text; what a batch asks for twice goes on once."""
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("a", "part", "b")], 1)
        once = np.sort(np.unique(keys, axis=0, return_index=True)[1]) if len(keys) else np.zeros(0, np.int64)
        for part in pieces(batch.take(pa.array(once)), "text"):
            values, cuts = shingle_sets(*flat(part.column("text")))
            columns = [*(part.column(c) for c in ("a", "part", "b")), pa.array(_bytes(values, cuts), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "part", "b", "shingles"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with 0.8 whose sketches pass; in each part of a star the hub's own row comes first."""
    hub = np.zeros(0, np.uint64)
    for batch in batches:
        keep = []
        for a, b, shingles in zip(batch.column("a").to_numpy(), batch.column("b").to_numpy(), batch.column("shingles")):
            own = np.frombuffer(shingles.as_buffer(), np.uint64)
            if a == b:
                hub = own.copy()
                keep.append(False)
                continue
            # A set is in rising order, so its sketch comes first in it.
            if estimate(hub[:K].tobytes(), own[:K].tobytes(), len(hub), len(own)) < PASS:
                keep.append(False)
                continue
            both = len(np.intersect1d(hub, own, assume_unique=True))
            keep.append(100 * both >= 80 * (len(hub) + len(own) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _room() -> Column:
    """Whether the bits of two sketches leave room for an estimate that passes."""
    def shared(one: str, two: str) -> Column:
        alone = [F.bit_count(F.col(f"{c}_{one}").bitwiseAND(F.bitwise_not(f"{c}_{two}"))) for c in _BIT_COLUMNS]
        return F.least(F.col(f"n_{one}"), F.lit(K)) - sum(alone[1:], alone[0])

    most = F.least(shared("a", "b"), shared("b", "a"))
    exact = K * most >= OVERLAP * (F.col("n_a") + F.col("n_b") - most)
    return F.when(F.greatest("n_a", "n_b") <= K, exact).otherwise(most >= OVERLAP)


def links(pairs: DataFrame, listed: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) that bits, estimate and full sets confirm; some may come twice."""

    def side(name: str) -> DataFrame:
        columns = ("n", "row", *_BIT_COLUMNS)
        return listed.select(F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(_room())
    near = stored(near.select("a", "b", "n_b", "row_a", "row_b"))
    # Parts of a star hold about as much each, and the hub goes to all of them.
    stars_ = near.groupBy("a").agg(F.min("row_a").alias("row"), F.ceil(F.sum("n_b") / STAR).cast("int").alias("parts"))
    partners = near.join(stars_.select("a", "parts"), "a").select(
        F.col("row_b").alias("row"), "a", F.pmod(F.hash("b"), F.col("parts")).alias("part"), "b"
    )
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    hubs = stars_.select("row", "a", parts, F.col("a").alias("b"))
    # A hub's row goes to each part: one, and one more per STAR shingles of its partners.
    pairs_, shingles = near.agg(F.count("*"), F.coalesce(F.sum("n_b"), F.lit(0))).first()
    most = 2 * pairs_ + shingles // STAR
    asked = _texts(documents, partners.union(hubs), most).select("a", "part", "b", "text")
    full = asked.mapInArrow(lean(_sets_of), "a long, part int, b long, shingles binary").repartition("a", "part")
    full = full.sortWithinPartitions("a", "part", F.col("a") != F.col("b"))
    return stored(full.mapInArrow(lean(_confirmed), "a long, b long"))


def joined(edges: DataFrame, known: DataFrame) -> DataFrame:
    """``components`` of the edges and of those that ``known`` labels, if many by the edges between its components."""
    if edges.count() + known.count() <= EDGES:
        return components(known.select(F.col("node").alias("a"), F.col("label").alias("b")).union(edges.select("a", "b")))

    def ends(name: str) -> DataFrame:
        return known.select(F.col("node").alias(name), F.col("label").alias(f"label_{name}"))

    named = edges.join(ends("a"), "a", "left").join(ends("b"), "b", "left")
    named = named.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    between = stored(named.filter("a <> b").distinct())
    if between.isEmpty():
        return known
    # A label is the least node of its component, so the least label is the least node of what they make.
    labels = components(between)
    after = labels.select(F.col("node").alias("label"), F.col("label").alias("after"))
    moved = known.join(after, "label", "left").select("node", F.coalesce("after", "label").alias("label"))
    return stored(moved.union(labels.join(known, "node", "left_anti")))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of a partition's edges, with the least node that it reaches by them."""
    ends = [np.stack([batch.column(c).to_numpy() for c in ("a", "b")]) for batch in batches]
    if not sum(e.shape[1] for e in ends):
        return
    nodes, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        # Labels are roots: each joins the least that an edge of its nodes has, then nodes follow.
        one, two = label[a], label[b]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label``: the least node that each linked node reaches."""
    tasks = -(-edges.count() // EDGES)
    forest = edges.select("a", "b").coalesce(max(1, tasks)).mapInArrow(lean(_forest), "node long, label long")
    if tasks <= 1:
        return stored(forest)
    both = forest.select("node", F.col("label").alias("other"))
    both = stored(both.union(both.select("other", "node")).distinct())
    labels = stored(both.groupBy("node").agg(F.min("other").alias("label")).withColumn("label", F.least("node", "label")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node")
        near = labels.join(seen.agg(F.min("label").alias("near")), "node")
        near = near.select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # A label is a node, whose own label may be less.
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = near.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label"))
        after = stored(after)
        moved = after.filter("old <> label").limit(1).count()
        labels = after.select("node", "label")
        if not moved:
            return labels


def stars(entries: DataFrame) -> DataFrame:
    """Step 3: every node of a list with the list's least, if their sizes allow a link."""
    hubs = entries.groupBy("value").agg(
        F.min("node").alias("a"), F.min_by("n", "node").alias("n_a"), F.count("*").alias("members")
    )
    pairs = entries.join(hubs.filter("members > 1"), "value").filter("node <> a")
    pairs = pairs.filter(5 * F.least("n", "n_a") >= 4 * F.greatest("n", "n_a"))
    return pairs.select("a", F.col("node").alias("b")).distinct()


def _labelled(listed: DataFrame, labels: DataFrame) -> DataFrame:
    known = listed.select("node", "n", "listed").join(labels, "node", "left")
    return known.select("node", "n", F.coalesce("label", "node").alias("label"), F.explode("listed").alias("value"))


def more_stars(listed: DataFrame, labels: DataFrame) -> DataFrame:
    """Step 4: nodes of lists with several components, with some of their list that other components hold."""
    known = _labelled(listed, labels)
    picks = [F.min_by(F.struct("node", "label", "n"), F.xxhash64("node", F.lit(i))) for i in range(HUBS)]
    lists = known.groupBy("value").agg(F.min("label").alias("least"), F.max("label").alias("most"), *(
        pick.alias(f"hub{i}") for i, pick in enumerate(picks)
    ))
    hubs = F.array_distinct(F.array(*(f"hub{i}" for i in range(HUBS))))
    lists = lists.filter("least <> most").select("value", hubs.alias("hubs"))
    drawn = known.join(lists, "value").select("node", "label", "n", F.explode("hubs").alias("hub"))
    pairs = drawn.filter("label <> hub.label and 5 * least(n, hub.n) >= 4 * greatest(n, hub.n)")
    return pairs.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()


def _rest(listed: DataFrame, labels: DataFrame, documents: DataFrame) -> DataFrame:
    """Step 4: pairs of nodes of components that the stars left apart."""
    known = _labelled(listed, labels)
    lists = known.groupBy("value").agg(
        F.count("*").alias("members"), F.min("label").alias("least"), F.max("label").alias("most")
    )
    open_ = stored(known.join(lists.filter("least <> most").select("value", "members"), "value"))
    small = _cross(open_.filter(F.col("members") <= SMALL), 5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b"), "n")
    crowded = open_.filter(F.col("members") > SMALL)
    if crowded.isEmpty():
        return small.distinct()
    return small.union(_exact(crowded, listed, documents)).distinct()


def _cross(entries: DataFrame, room, *columns: str) -> DataFrame:
    """Pairs of one list and different labels for which there is room."""
    def side(name: str) -> DataFrame:
        return entries.select("value", *(F.col(c).alias(f"{c}_{name}") for c in ("node", "label", *columns)))

    apart = (F.col("label_a") != F.col("label_b")) & (F.col("node_a") < F.col("node_b"))
    pairs = side("a").join(side("b"), "value").filter(apart & room)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _exact(crowded: DataFrame, listed: DataFrame, documents: DataFrame) -> DataFrame:
    """Pairs among the nodes of crowded lists, by a prefix filter on their full sets."""
    members = crowded.select("node", "label").distinct()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                values, cuts = shingle_sets(*flat(part.column("text")))
                at = pa.array(np.repeat(np.arange(part.num_rows), np.diff(cuts)))
                columns = [*(part.column(c).take(at) for c in ("node", "label", "n")), pa.array(values.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "label", "n", "value"])

    asked = stored(members.join(listed.select("node", "row", "n"), "node").select("row", "node", "label", "n"))
    # Rows alike in doc_id and text would count their values twice.
    full = _texts(documents, asked, asked.count()).dropDuplicates(["node"]).select("node", "label", "n", "text")
    values = stored(full.mapInArrow(lean(spread), "node long, label long, n int, value long"))
    counts = values.groupBy("value").agg(F.count("*").alias("count")).filter("count > 1")
    shared = values.join(counts, "value")
    # Shared values fall into the same parts, so the parts' lesser counts bound the overlap.
    part = F.col("value").bitwiseAND(F.lit(PARTS - 1))
    whole = stored(
        shared.groupBy("node", "label", "n").agg(
            F.sort_array(F.collect_list(F.struct("count", "value"))).alias("all"),
            F.array(*[F.count_if(part == p).cast("int") for p in range(PARTS)]).alias("parts"),
        )
    )
    # Values that nobody shares come first in the order, so they take up places.
    number = F.size("all")
    first = F.slice("all", F.lit(1), F.greatest(F.lit(0), number - F.ceil(F.col("n") * 4 / 5).cast("int") + 1))
    rare = whole.select("node", "label", "n", (F.col("n") - number).alias("own"), F.posexplode(first))
    rare = stored(
        rare.select("node", "label", "n", F.col("col.value").alias("value"), (F.col("own") + F.col("pos")).alias("at"))
    )
    before = rare.count()
    while True:
        # Who has no room for the overlap even with the smallest of the others leaves a list.
        lists = rare.groupBy("value").agg(
            F.min("n").alias("smallest"), F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("members")
        )
        held = rare.join(lists.filter("least <> most"), "value")
        partner = F.greatest("smallest", F.ceil(F.col("n") * 4 / 5))
        able = stored(held.filter(9 * (F.col("n") - F.col("at")) >= 4 * (F.col("n") + partner)).select(*rare.columns))
        after = able.count()
        if after >= (1 - WORTH) * before:
            break
        rare, before = able, after
    wanted = 4 * (F.col("n_a") + F.col("n_b"))
    room = 9 * F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= wanted
    both = F.aggregate(F.zip_with("parts_a", "parts_b", lambda a, b: F.least(a, b)), F.lit(0), lambda a, b: a + b)
    return _cross(able.join(whole.select("node", "parts"), "node"), room & (9 * both >= wanted), "n", "at", "parts")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, row, keep_row`` for every row; ``row`` is a hash of it.

    ``kept`` is by doc_id, so several rows of a component can have it; ``keep_row`` is the hash of one.
    """
    rows = stored(sets(documents))
    filled = rows.filter("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row", "block"))
    nodes = stored(filled.groupBy("node").agg(first.alias("one")))
    listed = stored(listed_nodes(documents, nodes.select("one.block", "one.row", "node")))
    entries = listed.select("node", "n", F.explode("listed").alias("value"))
    labels = components(links(stars(entries), listed, documents))
    for pairs_of in (more_stars, lambda *known: _rest(*known, documents)):
        pairs = stored(pairs_of(listed, labels))
        if not pairs.isEmpty():
            labels = joined(links(pairs, listed, documents), labels)
    named = nodes.join(labels, "node", "left").select(
        "node", F.coalesce("label", "node").alias("label"), F.struct("one.no", "one.doc_id", "one.row").alias("one")
    )
    least = named.groupBy("label").agg(F.min("one").alias("one"))
    named = named.select("node", "label").join(least, "label")
    named = stored(named.select("node", F.col("one.doc_id").alias("component_id"), F.col("one.row").alias("keep_row")))
    # Empty sets are linked with nothing.
    alone = rows.filter("n = 0").withColumns({"component_id": F.col("doc_id"), "keep_row": F.col("row")})
    whole = filled.join(named, "node").unionByName(alone)
    return whole.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "row",
        "keep_row",
    )


def deduplicated(documents: DataFrame) -> DataFrame:
    """The rows that op9 calls kept, with all their columns: several of a component if they share its doc_id."""
    stay = near_duplicates(documents).filter("kept").select(F.col("row").alias("_stay")).distinct()
    rows = packed(documents).join(stay, row_hash("_doc") == F.col("_stay"), "left_semi")
    return rows.select("_doc.*")


def one_of_each_component(documents: DataFrame) -> DataFrame:
    """One row of each component, and all rows without shingles, with all their columns."""
    best = near_duplicates(documents).filter("row = keep_row").groupBy(F.col("row").alias("_stay"))
    several = (F.max("n_shingles") > 0) & (F.count("*") > 1)
    return one_of_each(documents, stored(best.agg(several.alias("_one"))))


def op9_bottom_k_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row", "keep_row")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
  FROM d, unnest(range(1, greatest(len(w), 2))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(x, y) AS (
  SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles,
       least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id,
       coalesce(m.y, d.doc_id) >= d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY x) m USING (doc_id)
"""
