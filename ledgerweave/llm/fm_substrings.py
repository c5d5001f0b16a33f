"""Substring dedup over words: an FM-index per shard answers where windows of words start.

Words become symbols, the runs of a shard (see ``repeats``) its text. Suffixes are sorted by
their first symbols, which is all that backward search of a window needs; the Burrows-Wheeler
transform goes into a wavelet matrix, one bit vector with counts per level. Every window of the
documents that stream in is searched backwards, all at once: its matching statistic reaches the
threshold where the interval stays filled for the window's length. An interval's least doc_id
tells whether the window starts in an earlier document.

Words are compared by 64-bit hashes, a window by all of its words'.

Defined results: null text has no words; texts under a window's length lose nothing; a text of
any length is searched whole; rows alike in doc_id and text get one row each with the same
result; rows with one doc_id are no earlier document to each other; a row without doc_id comes
after all with one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerweave.llm.arrays import block_hashes, flat, words_of
from ledgerweave.llm.repeats import marked, repeated

WINDOW = 13
GRAM = 5


class WaveletMatrix:
    """Ranks of symbols in a sequence: per level a bit vector with counts every 64 bits."""

    def __init__(self, sequence: np.ndarray, levels: int):
        self.levels = []
        seq = sequence.astype(np.int64)
        n = len(seq)
        for level in reversed(range(levels)):
            bits = (seq >> level) & 1
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            ones = bits.astype(bool)
            zeros = int(n - counts[-1])
            self.levels.append((level, words, counts, zeros))
            seq = np.concatenate([seq[~ones], seq[ones]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` symbols' occurrences of ``symbols`` end, in the matrix's last order."""
        for level, words, counts, zeros in self.levels:
            word = at >> 6
            rest = words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = counts[word] + np.bitwise_count(rest)
            at = np.where((symbols >> level) & 1 == 1, zeros + ones, at - ones)
        return at


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols, by doubling."""
    n = len(text)
    rank = text.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    width = 1
    while width < depth:
        key = rank * (int(rank.max()) + 2)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        width *= 2
    return order


class FMIndex:
    """Backward search over runs of symbols; 0 stands between runs and is in no window."""

    def __init__(self, symbols: np.ndarray, cuts: np.ndarray, depth: int):
        lengths = np.diff(cuts)
        n = len(symbols) + len(lengths)
        self.text = np.zeros(n, np.int64)
        self.owner = np.repeat(np.arange(len(lengths)), lengths + 1)
        self.at = np.arange(len(symbols)) + np.repeat(np.arange(len(lengths)), lengths)
        self.text[self.at] = symbols
        self.suffixes = sorted_suffixes(self.text, depth)
        levels = max(1, int(self.text.max()).bit_length())
        transform = self.text[self.suffixes - 1]
        self.matrix = WaveletMatrix(transform, levels)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(self.text))])
        # The matrix's last order puts symbols in reversed-bit order; where each begins there.
        symbols_ = np.arange(int(self.text.max()) + 1)
        self.first = self.matrix.rank(symbols_, np.zeros(len(symbols_), np.int64))

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front."""
        both = self.matrix.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        base = self.before[symbols] - self.first[symbols]
        return both[: len(low)] + base, both[len(low) :] + base

    def intervals(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Interval of each window of the text, and its matching statistic up to ``length``."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.text))
        reached = np.zeros(len(starts), np.int64)
        for k in reversed(range(length)):
            low, high = self.step(self.text[starts + k], low, high)
            reached += high > low
        return low, high, reached


def least_documents(units: np.ndarray, cuts: np.ndarray, docs: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The engine: for every window of every run, the least doc_id in which it starts."""
    symbols = np.unique(units, return_inverse=True)[1] + 1
    index = FMIndex(symbols, cuts, window)
    lengths = np.diff(cuts)
    inside = np.arange(len(units)) - np.repeat(cuts[:-1], lengths) + window <= np.repeat(lengths, lengths)
    low, high, reached = index.intervals(index.at[inside], window)
    out = np.full(len(low), np.iinfo(np.int64).max)
    over = reached >= window
    # Intervals of windows of one length are equal or apart.
    first, which = np.unique(low[over], return_inverse=True)
    last = np.zeros(len(first), np.int64)
    last[which] = high[over]
    by_suffix = np.append(docs[index.owner[index.suffixes]], np.iinfo(np.int64).max)
    edges = np.stack([first, last], 1).ravel()
    out[over] = np.minimum.reduceat(by_suffix, edges)[::2][which] if len(edges) else 0
    return out


def word_units(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, owner = words_of(buf, offsets)
    return block_hashes(buf, starts, ends), np.searchsorted(owner, np.arange(len(offsets)))


def _finish(window: int, gram: int, with_text: bool):
    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        words, removed, digests, texts, spans = [], [], [], [], []
        column = table.column("text").combine_chunks()
        for place, _, cuts, gone in marked(table, found, word_units, window, gram):
            buf, offsets = flat(column.slice(place[0], len(place)))
            starts, ends, _ = words_of(buf, offsets)
            data = buf.tobytes()
            starts, ends = starts.tolist(), ends.tolist()
            count = np.concatenate([[0], np.cumsum(gone)])
            for a, b in zip(cuts, cuts[1:]):
                lost = gone[a:b]
                stay = np.flatnonzero(~lost) + a
                kept = b" ".join([data[starts[i] : ends[i]] for i in stay.tolist()])
                words.append(b - a)
                removed.append(count[b] - count[a])
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    edge = np.flatnonzero(np.diff(np.r_[0, lost.astype(np.int8), 0]))
                    spans.append(edge.reshape(-1, 2).tolist())
                    texts.append(kept.decode())
        out = {
            "doc_id": table.column("doc_id"),
            "n_words": pa.array(words, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
        }
        if with_text:
            out["spans"] = pa.array(spans, pa.list_(pa.list_(pa.int64())))
            out["kept_text"] = pa.array(texts, pa.string())
        return pa.table(out)

    return run


def without_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """Per row: counts and digest, the removed spans of words, and the text of the words kept."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if with_text:
        schema += ", spans array<array<long>>, kept_text string"

    def engine(units, cuts, docs):
        return least_documents(units, cuts, docs, window)

    return repeated(documents, word_units, engine, window, gram, np.uint64, _finish(window, gram, with_text), schema)


def op1_fm_index_substrings(spark, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, hash(list_slice(w, i, i + 12)) AS h
  FROM d, unnest(range(1, greatest(len(w) - 12, 0) + 1)) t(i)),
first AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN first USING (h) WHERE least < doc_id),
word AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) t(i)),
stay AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN stay USING (doc_id)
"""
