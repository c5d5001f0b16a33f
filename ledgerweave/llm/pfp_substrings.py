"""Substring dedup over bytes: prefix-free parsing puts a shard's suffixes into corpus order.

The runs of a shard (see ``repeats``) are parsed into phrases: a phrase ends with a stretch of
``TRIGGER`` bytes whose rolling hash is 0 modulo ``PHRASE``, and the next begins with the same
stretch. The dictionary of distinct phrases and the parse, the sequence of their ranks, are each
sorted by suffix doubling. As no phrase suffix longer than the trigger is a prefix of another, a
text suffix is ordered by the rank of its phrase's suffix and then by the parse from the next
phrase on; highly repetitive text has few phrases to sort. Neighbours in that corpus order are
compared byte by byte over the window's length, and the least doc_id of each stretch of equal
windows is what its windows get.

Defined results: null text is an empty one; texts under a window's length lose nothing; a text
of any length is treated whole, as UTF-8 bytes, and a removed span may cut a character, so kept
texts are bytes; rows alike in doc_id and text get one row each with the same result; rows with
one doc_id are no earlier document to each other; a row without doc_id comes after all with one;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerweave.llm.arrays import block_hashes, expand, flat, gram_hashes
from ledgerweave.llm.repeats import marked, repeated

WINDOW = 50
GRAM = 20
TRIGGER = 8
PHRASE = 24


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the keys, in it the first place of each one's equals, and whether it has others."""
    order = np.argsort(key)
    ordered = key[order]
    start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    size = np.diff(np.append(start, len(key)))
    return order, np.repeat(start, size), np.repeat(size > 1, size)


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``depth`` symbols; equal ones share a rank.

    A negative symbol ends a string: what stands behind it is not compared. A rank is the first
    place of its equals, so each round sorts only the suffixes that are still tied.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    stops = np.flatnonzero(text < 0)
    # Symbols up to the next end, it included.
    reach = np.append(stops, n)[np.searchsorted(stops, np.arange(n))] - np.arange(n) + 1
    symbols = text.astype(np.int64) + 2
    width = 1
    if symbols.max() < 256:  # the first eight at once
        packed, width = np.zeros(n, np.uint64), 8
        for k in range(min(8, n)):  # fewer symbols have no eighth
            packed <<= np.uint64(8)
            packed[: n - k] |= np.where(reach[: n - k] > k, symbols[k:], 0).astype(np.uint64)
        symbols = packed
    order, place, tied = _ranked(symbols)
    rank = np.empty(n, np.int64)
    rank[order] = place + 1
    order = order[tied]
    while width < depth and len(order):
        if text[-1] < 0:  # equals that reach their end within the width stay equal
            order = order[reach[order] > width]
        old = rank[order]
        further = order + width
        longer = np.flatnonzero((reach[order] > width) & (further < n))
        key = old * (n + 2)
        key[longer] += rank[further[longer]]
        by, place, tied = _ranked(key)
        order, old = order[by], old[by]
        first = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
        rank[order] = old + place - np.repeat(first, np.diff(np.append(first, len(old))))
        order = order[tied]
        width *= 2
    return rank


def parse(text: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of phrases, and the run of each. Runs are parsed one by one."""
    n = len(text)
    triggers = np.zeros(0, np.int64)
    if n >= TRIGGER:
        triggers = np.flatnonzero(gram_hashes(text, TRIGGER) % np.uint64(PHRASE) == 0)
        run = np.searchsorted(cuts, triggers, "right") - 1
        # Within a run, and neither its first bytes nor its last.
        triggers = triggers[(triggers + TRIGGER < cuts[run + 1]) & (triggers > cuts[run])]
    starts = np.sort(np.concatenate([cuts[:-1], triggers]))
    run = np.searchsorted(cuts, starts, "right") - 1
    ends = np.append(starts[1:] + TRIGGER, n)
    last = np.append(run[1:] != run[:-1], True)
    ends[last] = cuts[run[last] + 1]
    return starts, ends, run


def corpus_order(text: np.ndarray, cuts: np.ndarray, depth: int, at: np.ndarray) -> np.ndarray:
    """The positions ``at``, sorted by the first ``depth`` bytes that follow in their run."""
    starts, ends, run = parse(text, cuts)
    lengths = ends - starts
    last = np.append(run[1:] != run[:-1], True)
    # A run's end is part of its last phrase, which so is no prefix of another.
    keys = block_hashes(text, starts, ends) ^ last.astype(np.uint64)
    _, one, phrase = np.unique(keys, return_index=True, return_inverse=True)
    # The dictionary: every distinct phrase, with an end behind it.
    size = lengths[one]
    begin = np.cumsum(size + 1) - (size + 1)
    dictionary = np.full(int((size + 1).sum()), -1, np.int64)
    dictionary[expand(begin, size)] = text[expand(starts[one], size)]
    dictionary[begin[last[one]] + size[last[one]]] = -2
    in_dictionary = suffix_ranks(dictionary, depth)
    # The parse: the phrases' ranks, with an end behind every run.
    place = np.arange(len(phrase)) + run
    whole = np.full(len(phrase) + len(cuts) - 1, -1, np.int64)
    whole[place] = in_dictionary[begin[phrase]]
    in_parse = suffix_ranks(whole, depth)
    # A position belongs to the last phrase that starts at or before it.
    begins = np.zeros(len(text), np.int64)
    begins[starts] = 1
    own = np.cumsum(begins)[at] - 1
    inner = in_dictionary[begin[phrase[own]] + at - starts[own]]
    return at[np.argsort(inner * (len(whole) + 2) + in_parse[place[own] + 1])]


def equal_windows(text: np.ndarray, left: np.ndarray, right: np.ndarray, window: int) -> np.ndarray:
    """Whether the windows at ``left`` and ``right`` have the same bytes."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((len(text),), "<u8", padded, strides=(1,))
    same = np.ones(len(left), bool)
    for k in sorted({*range(0, window - 7, 8), max(0, window - 8)}):
        same &= words[left + k] == words[right + k]
    return same


def least_documents(units: np.ndarray, cuts: np.ndarray, docs: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The engine: for every window of every run, the least doc_id in which it starts."""
    lengths = np.diff(cuts)
    at = expand(cuts[:-1], lengths - window + 1)
    owner = np.repeat(docs, lengths - window + 1)
    order = corpus_order(units, cuts, window, at)
    fresh = np.r_[True, ~equal_windows(units, order[:-1], order[1:], window)]
    spot = np.empty(len(units), np.int64)
    spot[at] = np.arange(len(at))
    place = spot[order]
    least = np.minimum.reduceat(owner[place], np.flatnonzero(fresh))
    out = np.empty(len(at), np.int64)
    out[place] = least[np.cumsum(fresh) - 1]
    return out


def byte_units(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return buf, offsets


def _finish(window: int, gram: int, with_text: bool):
    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        sizes, removed, runs, digests, texts, spans = [], [], [], [], [], []
        for _, values, cuts, gone in marked(table, found, byte_units, window, gram):
            count = np.concatenate([[0], np.cumsum(gone)])
            kept = values[~gone].tobytes()
            left = (cuts - count[cuts]).tolist()
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            begin = cuts[:-1][np.diff(cuts) > 0]
            first[begin] = gone[begin]
            number = np.concatenate([[0], np.cumsum(first)])
            sizes.append(np.diff(cuts))
            removed.append(np.diff(count[cuts]))
            runs.append(np.diff(number[cuts]))
            for i, (a, b) in enumerate(zip(left, left[1:])):
                digests.append(hashlib.sha256(kept[a:b]).hexdigest())
                if with_text:
                    lost = gone[cuts[i] : cuts[i + 1]].astype(np.int8)
                    spans.append(np.flatnonzero(np.diff(np.r_[0, lost, 0])).reshape(-1, 2).tolist())
                    texts.append(kept[a:b])
        out = {
            "doc_id": table.column("doc_id"),
            "n_bytes": pa.array(np.concatenate(sizes)),
            "n_removed": pa.array(np.concatenate(removed)),
            "n_spans": pa.array(np.concatenate(runs)),
            "kept_sha256": pa.array(digests, pa.string()),
        }
        if with_text:
            out["spans"] = pa.array(spans, pa.list_(pa.list_(pa.int64())))
            out["kept"] = pa.array(texts, pa.binary())
        return pa.table(out)

    return run


def without_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """Per row: counts and digest, the removed spans of bytes, and the bytes kept."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        schema += ", spans array<array<long>>, kept binary"

    def engine(units, cuts, docs):
        return least_documents(units, cuts, docs, window)

    return repeated(documents, byte_units, engine, window, gram, np.uint8, _finish(window, gram, with_text), schema)


def op3_prefix_free_parsing(spark, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
