"""Alignment of two tokenizers' tokens by diagonal run skipping, with corpus-wide counts.

Both tokenizers split the same bytes, so their tokens are aligned by where they end: offsets at
which both have an end cut the text into groups. Mostly one token stands against one. Such a
stretch lies on a diagonal, a fixed shift between the two indexes; it is jumped by comparing
slices of the two lists of ends, twice as long each time, and shorter again once they differ.
Where they differ, the smaller end is advanced until both agree: that is an irregular group, and
the shift behind it is the new one. All texts of a batch are one such walk, as a text's end is an
end of both.

Every pair of an A and a B token in one group is a link. The first pass encodes, aligns and keeps
per document its distinct linked pairs, packed, with how often each occurs. From these, tasks
count documents per pair before anything moves; the counts are added up per pair, and the
highest of each A id is marked. The last pass looks up every document's pairs. What it looks up
in is bounded by the two vocabularies, not by the corpus, and dealt into blocks of ``BLOCK``
pairs, counted beforehand; with more pairs than that, each block is one more narrow pass that
adds to the documents' sums. Documents are never joined, grouped or shuffled.

Defined results: null and empty texts, and texts whose tokens do not give back their bytes, have
no tokens: zeros and an empty ``groups_sha256``; they count for no pair. Rows that repeat a
doc_id, or have none, are documents of their own. An empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.arrays import block_hashes, expand, flat, pieces
from ledgerweave.llm.pretokens import split
from ledgerweave.session import cut_lineage

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
#: Pairs looked up in one pass, 17 bytes each.
BLOCK = 2_000_000
#: Bytes of text aligned at once; the more, the fewer pieces are encoded twice.
PIECE = 3 << 20
#: Links of a group beyond which they are counted by distinct ids, not one by one.
WIDE = 4096

Groups = tuple[np.ndarray, np.ndarray]


def diagonal_groups(a: list[int], b: list[int]) -> Groups:
    """Where each group ends, as counts of A and of B tokens, from the ends of both.

    Both lists ascend and have the same last end; the tokens have bytes, so no end repeats.
    """
    from_a, until_a, until_b = [], [], []  # of the irregular groups
    i, j, n = 0, 0, len(a)
    while i < n:
        step = 4
        while (ahead := a[i : i + step]) == b[j : j + step] and ahead:
            i, j, step = i + len(ahead), j + len(ahead), 2 * step
        while step > 1:  # the first difference is less than a step away
            step >>= 1
            if (ahead := a[i : i + step]) == b[j : j + step]:
                i, j = i + len(ahead), j + len(ahead)
        if i == n:
            break
        from_a.append(i)
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
        until_a.append(i)
        until_b.append(j)
    # A stretch between two irregular groups has as many groups as tokens.
    from_a.append(n)
    begin_a, begin_b = np.array([0, *until_a], np.int64), np.array([0, *until_b], np.int64)
    plain = np.array(from_a, np.int64) - begin_a
    lengths = plain + (np.arange(len(plain)) < len(until_a))
    groups_a, groups_b = expand(begin_a + 1, lengths), expand(begin_b + 1, lengths)
    last = (np.cumsum(lengths) - 1)[: len(until_a)]
    groups_a[last], groups_b[last] = until_a, until_b
    return groups_a, groups_b


# -- Tokenizers ------------------------------------------------------------------


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others follow from 256 on, in order.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of texts, and the bytes of every id."""

    def whole(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, straight from the library."""
        raise NotImplementedError

    def ids(self, texts: list[str], buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has.

        ``buf`` and ``offsets`` hold the bytes of a space and the text, for all texts.
        """
        return _flat(self.whole(texts))

    def _finish(self, bytes_of: list[bytes]) -> None:
        self.sizes = np.array([len(b) for b in bytes_of], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.names = [str(i) for i in range(len(bytes_of))]

    def same(self, ids: np.ndarray, counts: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts the bytes of their ids give back."""
        spelled = self.bytes[expand(self.at[ids], self.sizes[ids])]
        if len(spelled) == len(buf) and (spelled == buf).all():
            edges = np.r_[0, np.cumsum(self.sizes[ids])][np.r_[0, np.cumsum(counts)]]
            if (edges == offsets).all():
                return np.ones(len(counts), bool)
        tokens = np.r_[0, np.cumsum(counts)]
        edges = np.r_[0, np.cumsum(self.sizes[ids])][tokens].tolist()
        ends = offsets.tolist()
        return np.array(
            [
                edges[i + 1] - edges[i] == ends[i + 1] - ends[i]
                and bool((spelled[edges[i] : edges[i + 1]] == buf[ends[i] : ends[i + 1]]).all())
                for i in range(len(counts))
            ],
            bool,
        )


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts


#: Pieces a worker remembers, with their ids.
KEPT = 400_000


class ByteLevel(Side):
    """A byte-level tokenizer; each distinct piece of its pattern is encoded once."""

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True  # their strings in a text are plain text
        rules = json.loads(model)
        before = rules.get("pre_tokenizer") or {}
        self.by_piece = (
            before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and not rules.get("normalizer")
            and all(t["special"] for t in rules.get("added_tokens") or [])
        )
        self.known: dict[bytes, list[int]] = {}
        byte_of = _byte_of()
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        table = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            table[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else b""
        self._finish(table)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, texts: list[str]) -> list[list[int]]:
        return self._encoded([" " + t for t in texts])

    def ids(self, texts: list[str], buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_piece:
            return _flat(self.whole(texts))
        starts, ends, owner = split(buf, offsets)
        keys = block_hashes(buf, starts, ends)
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        data = buf.tobytes()
        found, lengths = _flat(self._of_pieces([data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]))
        begin = np.cumsum(lengths) - lengths
        counts = np.zeros(len(texts), np.int64)
        np.add.at(counts, owner, lengths[which])
        ids = found[expand(begin[which], lengths[which])]
        # Pieces with one hash would show as other bytes: such a text goes to the library whole.
        wrong = np.flatnonzero(~self.same(ids, counts, buf, offsets))
        if len(wrong):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, own in zip(wrong.tolist(), self.whole([texts[i] for i in wrong])):
                parts[i] = np.array(own, np.int64)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts

    def _of_pieces(self, pieces_: list[bytes]) -> list[list[int]]:
        found = [self.known.get(p) for p in pieces_]
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            if len(self.known) + len(new) > KEPT:
                self.known.clear()
            for i, ids in zip(new, self._encoded([pieces_[i].decode() for i in new])):
                found[i] = ids
                if len(pieces_[i]) < 64 and len(self.known) < KEPT:
                    self.known[pieces_[i]] = ids
        return found


class Pieces(Side):
    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        table = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                table.append(bytes([int(piece[3:5], 16)]))
            else:
                table.append(piece.replace("▁", " ").encode())
        self._finish(table)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


class Aligner:
    """Groups and linked pairs of texts under two tokenizers."""

    def __init__(self, model_a: bytes, model_b: bytes):
        self.a, self.b = ByteLevel(model_a), Pieces(model_b)
        self.width = len(self.b.names)
        self.pair = np.dtype("<u4" if len(self.a.names) * self.width < 1 << 32 else "<u8")
        # An id with what follows it in the digest: first all with a comma, then all with the group's mark.
        self.text_a = np.array([n + "," for n in self.a.names] + [n + "|" for n in self.a.names], object)
        self.text_b = np.array([n + "," for n in self.b.names] + [n + ";" for n in self.b.names], object)

    def aligned(self, texts: list[str | None]) -> dict[str, list]:
        """Columns of ``ALIGNED`` but the first, one entry a text."""
        n = len(texts)
        out = {c: [0] * n for c in ("n_a", "n_b", "n_groups", "n_links")}
        out |= {"groups_sha256": [""] * n, "pairs": [b""] * n, "times": [b""] * n}
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return out
        given = [texts[i] for i in full]
        buf, offsets = flat(pa.array([" " + t for t in given], pa.large_string()))
        sides = [(side, *side.ids(given, buf, offsets)) for side in (self.a, self.b)]
        good = np.logical_and(*[side.same(ids, counts, buf, offsets) for side, ids, counts in sides])
        if not good.any():
            return out
        kept = [i for i, g in zip(full, good) if g]
        (ids_a, counts_a), (ids_b, counts_b) = [
            (ids[np.repeat(good, counts)], counts[good]) for _, ids, counts in sides
        ]
        ends_a, ends_b = np.cumsum(self.a.sizes[ids_a]), np.cumsum(self.b.sizes[ids_b])
        # A token without bytes would end where the one before it does; neither side uses one.
        until_a, until_b = diagonal_groups(ends_a.tolist(), ends_b.tolist())
        size_a, size_b = np.diff(until_a, prepend=0), np.diff(until_b, prepend=0)
        owner = np.searchsorted(np.cumsum(counts_a), until_a, "left")  # of each group
        links = size_a * size_b
        keys, times = self._links(ids_a, ids_b, until_a - size_a, until_b - size_b, size_a, size_b, owner)
        digests = self._digests(ids_a, ids_b, until_a, until_b, size_a, size_b, owner, len(kept))
        pair_owner, pairs = np.divmod(keys, len(self.a.names) * self.width)
        edges = np.searchsorted(pair_owner, np.arange(len(kept) + 1))
        n_groups = np.bincount(owner, minlength=len(kept))
        n_links = np.add.reduceat(links, np.searchsorted(owner, np.arange(len(kept))))
        for k, i in enumerate(kept):
            own, often = pairs[edges[k] : edges[k + 1]], times[edges[k] : edges[k + 1]]
            out["n_a"][i], out["n_b"][i] = int(counts_a[k]), int(counts_b[k])
            out["n_groups"][i], out["n_links"][i] = int(n_groups[k]), int(n_links[k])
            out["groups_sha256"][i] = digests[k]
            out["pairs"][i] = own.astype(self.pair).tobytes()
            out["times"][i] = often.astype("<u1" if often.max() < 256 else "<u8").tobytes()
        return out

    def _links(self, ids_a, ids_b, from_a, from_b, size_a, size_b, owner) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, A id, B id) in ascending order, and how often each is linked."""
        base = owner * (len(self.a.names) * self.width)
        links = size_a * size_b
        some = np.flatnonzero(links <= WIDE)
        at = np.repeat(some, links[some])
        inner = expand(np.zeros(len(some), np.int64), links[some])
        keys = base[at] + ids_a[from_a[at] + inner // size_b[at]] * self.width + ids_b[from_b[at] + inner % size_b[at]]
        keys, times = np.unique(keys, return_counts=True)
        more = [(keys, times.astype(np.int64))]
        for g in np.flatnonzero(links > WIDE).tolist():
            x, n = np.unique(ids_a[from_a[g] : from_a[g] + size_a[g]], return_counts=True)
            y, m = np.unique(ids_b[from_b[g] : from_b[g] + size_b[g]], return_counts=True)
            more.append(((base[g] + x[:, None] * self.width + y).ravel(), np.outer(n, m).ravel()))
        if len(more) == 1:
            return more[0]
        return _added(np.concatenate([k for k, _ in more]), np.concatenate([t for _, t in more]))

    def _digests(self, ids_a, ids_b, until_a, until_b, size_a, size_b, owner, n: int) -> list[str]:
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[until_a - 1] = last_b[until_b - 1] = 1
        order = np.empty(len(ids_a) + len(ids_b), object)
        # A token stands behind all B tokens of the groups before its own, a B token behind its group's A tokens.
        order[np.arange(len(ids_a)) + np.repeat(until_b - size_b, size_a)] = self.text_a[
            ids_a + last_a * len(self.a.names)
        ]
        order[np.arange(len(ids_b)) + np.repeat(until_a, size_b)] = self.text_b[ids_b + last_b * self.width]
        ends = (until_a + until_b)[np.searchsorted(owner, np.arange(n), "right") - 1].tolist()
        texts = order.tolist()
        return [
            hashlib.sha256("".join(texts[a:b])[:-1].encode()).hexdigest() for a, b in zip([0, *ends[:-1]], ends)
        ]


def _added(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[start], np.add.reduceat(times, start)


_aligners: dict[bytes, Aligner] = {}


def aligner(model_a: bytes, model_b: bytes) -> Aligner:
    key = hashlib.sha256(model_a).digest() + hashlib.sha256(model_b).digest()
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(model_a, model_b)
    return _aligners[key]


# -- Passes over the documents ---------------------------------------------------------

FIGURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B)


def aligned(documents: DataFrame, model_a: bytes, model_b: bytes) -> DataFrame:
    """``doc_id``, ``FIGURES`` and the packed distinct pairs of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(model_a, model_b)
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                columns = own.aligned(part.column("text").to_pylist())
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                arrays = [pa.array(v, k) for v, k in zip(columns.values(), kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], ["doc_id", *columns])

    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {kind}, {FIGURES}, pairs binary, times binary")


#: Pairs a task holds before it adds them up.
HELD = 3_000_000


def pair_counts(found: DataFrame, pair: str, width: int) -> DataFrame:
    """``pair, n, best``: documents per linked pair, and whether no pair of its A id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, size = [], [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            return _added(np.concatenate(keys or [np.zeros(0, np.int64)]), np.concatenate(times or [np.zeros(0, np.int64)]))

        for batch in batches:
            for packed in batch.column("pairs"):
                own = np.frombuffer(packed.as_buffer(), pair).astype(np.int64)
                keys.append(own)
                times.append(np.ones(len(own), np.int64))
                size += len(own)
                if size > HELD:
                    one, two = added()
                    if len(one) > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], ["pair", "n"])
                        one, two = one[:0], two[:0]
                    keys, times, size = [one], [two], len(one)
        one, two = added()
        yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], ["pair", "n"])

    counts = found.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / width)))
    return counts.select("pair", "n", (F.col("n") == highest).alias("best"))


def _summed(found: DataFrame, table: pa.Table, pair: str, pairs: bool) -> DataFrame:
    """``found`` with what a block of counts adds to ``n_best`` and ``count_sum``."""
    order = np.argsort(table.column("pair").to_numpy(), kind="stable")
    known, counts, best = (table.column(c).to_numpy()[order] for c in ("pair", "n", "best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.frombuffer(p.as_buffer(), pair) for p in batch.column("pairs")]
            sizes = np.array([len(p) for p in packed], np.int64)
            keys = np.concatenate([np.zeros(0, pair), *packed]).astype(np.int64)
            times = np.concatenate(
                [np.zeros(0, np.int64)]
                + [
                    np.frombuffer(t.as_buffer(), "<u1" if t.as_buffer().size == n else "<u8").astype(np.int64)
                    for t, n in zip(batch.column("times"), sizes.tolist())
                ]
            )
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            times = times * (known[at] == keys) if len(known) else times * 0
            edges = np.r_[0, np.cumsum(sizes)]
            sums = []
            for weight in (best, counts):
                total = np.r_[0, np.cumsum(times * (weight[at] if len(known) else 0))]
                sums.append(pa.array(total[edges[1:]] - total[edges[:-1]]))
            out = {c: batch.column(c) for c in names}
            out["n_best"] = pc.add(out["n_best"], sums[0])
            out["count_sum"] = pc.add(out["count_sum"], sums[1])
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    keep = [f for f in found.schema.fields if pairs or f.name not in ("pairs", "times")]
    names = [f.name for f in keep]
    return found.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep))


def cross_aligned(
    documents: DataFrame, path_a: str | None = None, path_b: str | None = None, block: int = BLOCK
) -> DataFrame:
    """``doc_id``, ``FIGURES``, ``n_best`` and ``count_sum`` of every row of ``documents``."""
    default_a, default_b = default_paths() if path_a is None or path_b is None else (path_a, path_b)
    model_a, model_b = _read(path_a or default_a), _read(path_b or default_b)
    own = aligner(model_a, model_b)
    pair, width = own.pair.str, own.width
    zero = F.lit(0).cast("long")
    found = cut_lineage(aligned(documents, model_a, model_b).withColumns({"n_best": zero, "count_sum": zero}))
    counts = cut_lineage(pair_counts(found, pair, width))
    blocks = max(1, math.ceil(counts.count() / block))
    for number in range(blocks):
        table = counts.filter(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == number).toArrow()
        last = number == blocks - 1
        found = _summed(found, table, pair, pairs=not last)
        if not last:
            found = cut_lineage(found)  # one block in a worker's memory at a time
    return found


def op13_diagonal_alignment(spark, sf_dir: str) -> DataFrame:
    return cross_aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
