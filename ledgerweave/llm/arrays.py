"""Texts of an Arrow batch as one byte array, with words and hashes found by numpy."""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: A batch is worked on in pieces of about this many bytes; a longer text is a piece of its own.
PIECE = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + (PIECE >> 2))
        made = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        if n > 8 * PIECE:
            return tuple(made)  # for one very long text; not kept
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def give_back() -> None:
    """Hand freed memory back to the system, which allocators otherwise keep for a process's life."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not the GNU C library


_caches: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """What this worker keeps under a name from task to task, until ``lean`` runs one that does not use it."""
    return _caches.setdefault(name, {})


def keep_only(name: str | None) -> None:
    """Forget what this worker keeps under other names."""
    others = [cache for other, cache in _caches.items() if other != name and cache]
    for cache in others:
        cache.clear()
    if others:
        give_back()


def lean(run: Callable[[Iterator], Iterator], cache: str | None = None) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, with the memory that it freed given back when its task ends.

    Spark keeps workers for the tasks that follow, so those of a later stage would stand on what the
    arrays of an earlier one took at their most, and on what it kept: before its first batch a task
    forgets all that its worker keeps but the ``worker_cache`` that it names.
    """

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(cache)
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    high = x >> np.uint64(33)
    x ^= high
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= np.right_shift(x, np.uint64(33), out=high)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= np.right_shift(x, np.uint64(33), out=high)
    return x


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(table: pa.RecordBatch | pa.Table, text: str, size: int = 0) -> Iterator:
    """Runs of rows with about ``size`` (or ``PIECE``) bytes of text; every row is in one of them."""
    if not table.num_rows:
        return
    _, offsets = flat(table.column(text))
    start = 0
    while start < table.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + (size or PIECE), "right")) - 1
        end = min(max(end, start + 1), table.num_rows)
        yield table.slice(start, end - start)
        start = end


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word ``[^\\x20\\x09-\\x0D]+``."""
    return runs_of(~IS_SPACE[buf], offsets)


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of bytes that are ``inside``; none crosses texts."""
    full = offsets[1:] > offsets[:-1]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][full]] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums of a polynomial in the bytes, modulo 2**64, from which ``segment_hashes`` reads."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    terms = buf.astype(np.uint64)
    terms += np.uint64(1)
    terms *= _tables(len(buf))[0]
    np.cumsum(terms, out=sums[1:])
    return sums


def segment_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of short segments; they depend on nothing but a segment's bytes.

    For routing only: long texts can be made whose polynomials are equal, whatever the base.
    """
    inverse = _tables(len(sums))[1]
    value = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(buf: np.ndarray, m: int) -> np.ndarray:
    """``segment_hashes`` of every stretch of ``m`` units, in order, without looking one of them up."""
    sums = prefix_sums(buf)
    value = sums[m:] - sums[:-m]
    value *= _tables(len(sums))[1][: len(value)]
    value += np.uint64(m * 0xD6E8FEB86659FD93 % (1 << 64))
    return mix(value)


#: Longer segments are hashed one by one by the standard library.
LONG = 256


def block_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the segments, eight bytes at a time with a mix after each.

    Nothing here is linear in the bytes, so texts made to collide under a polynomial do not.
    Different seeds give independent hashes; two of them make 128 bits. Wider units than bytes
    are hashed by their bytes.
    """
    if buf.dtype.itemsize > 1:
        width = buf.dtype.itemsize
        buf, starts, ends = np.ascontiguousarray(buf).view(np.uint8), starts * width, ends * width
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))
    lengths = ends - starts
    h = mix(lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed * 2 + 1))
    todo = np.flatnonzero((lengths > 0) & (lengths <= LONG))
    at = starts[todo]
    while len(todo):
        left = ends[todo] - at
        block = eight[at]
        short = left < 8
        block[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        h[todo] = mix(h[todo] ^ block)
        more = left > 8
        todo, at = todo[more], at[more] + 8
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(lengths > LONG).tolist():
        digest = hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, key=key).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


def sums_by(owner: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Exact whole-number sums of ``weights`` per owner."""
    total = np.zeros(len(weights) + 1, np.int64)
    np.cumsum(weights, out=total[1:])
    edges = np.searchsorted(owner, np.arange(n + 1))
    return total[edges[1:]] - total[edges[:-1]]


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the runs ``start .. start + length - 1``, one run after another."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
