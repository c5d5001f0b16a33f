"""The pieces into which a byte-level tokenizer's pattern splits texts, found by numpy.

The pattern: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Its pieces follow from where the class of a character changes: a run takes one space before it
along; white space before a run gives its last character away; a contraction stands alone.
"""

from __future__ import annotations

import functools

import numpy as np
import regex

# The Unicode property White_Space: fixed values.
WHITE = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003,
    0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)

OTHER, LETTER, NUMBER, SPACE = range(4)


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point."""
    made = np.zeros(0x110000, np.uint8)
    points = np.r_[0:0xD800, 0xE000:0x110000].astype(np.uint32)
    text = points.tobytes().decode("utf-32-le")
    for code, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for found in regex.finditer(pattern, text):
            made[points[found.start() : found.end()]] = code
    made[list(WHITE)] = SPACE
    return made


def split(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (in bytes) and text number of every piece of every text."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)  # the first byte of every character
    n = len(at)
    if not n:
        return at, at, at
    chars = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes()[chars]
    edge = np.searchsorted(at, offsets)
    full = edge[1:] > edge[:-1]
    first = np.zeros(n + 1, bool)  # of a text
    first[edge[:-1][full]] = True
    first[n] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)  # the last is the end of all
    begin, end = runs[:-1], runs[1:]
    white = kind[begin] == SPACE
    # White space before a run of its text gives its last character away.
    start[(end - 1)[white & ~first[end] & (end - begin > 1)]] = True
    # Any other run takes along a blank before it.
    taken = begin[~white & ~first[begin] & (chars[begin - 1] == 0x20)]
    start[taken] = False
    start[taken - 1] = True
    # Contractions: an apostrophe that starts a piece, with what follows in its text.
    quote = begin[(chars[begin] == 0x27) & start[begin] & (end - begin == 1) & ~first[end]]
    if len(quote):
        one = chars[quote + 1]
        two = np.where(quote + 2 < n, chars[np.minimum(quote + 2, n - 1)], 0)
        two[first[quote + 2]] = 0
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        start[quote[short | long] + 1] = False
        start[quote[short] + 2] = True
        start[quote[long & ~short] + 3] = True
    cut = np.flatnonzero(start[:n])
    ends = np.append(at[cut[1:]], len(buf))
    starts = at[cut]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
