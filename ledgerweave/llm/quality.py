"""Quality rules: boosted trees over document statistics, scored from flat node arrays.

Statistics of a text are computed by numpy for a run of texts at once. The trees are grown on
the driver from a sample of labelled rows whose size is bounded by ``SAMPLE``: the labels with
the least hash of doc_id. Scoring covers every row, in the task that reads it; there is no
shuffle. Features in ``FALLING`` can only lower a score as they grow: a split on one puts the
higher value on its low side, and values below it stay on their side of the middle.

Defined results: null text is an empty one, which fails the base rules; repeated rows are
scored each; labels that are null, or whose doc_id is null or unknown, are ignored; where no
label is left or all agree, the model says what they say, and keeps if there is none; an empty
table gives no rows; other columns stay as they are, except those with the output's names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.llm.arrays import IS_SPACE, block_hashes, flat, mix, pieces, sums_by, words_of

#: Labelled rows that the trees are grown from, at most.
SAMPLE = 8000
MIN_WORDS = 50

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the trees see: shares and means, so that they do not depend on a text's length alone.
FEATURES = (
    "n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share",
    "digit_share", "mark_share", "bare_word_share", "line_words", "twin_share", "longest_word",
)
FALLING = frozenset({"symbol_share", "dup_line_share", "repeat_share", "upper_share", "bare_word_share", "twin_share"})


def _table(chars: bytes) -> np.ndarray:
    made = np.zeros(256, bool)
    made[list(chars)] = True
    return made


SYMBOL = _table(b"#*$%&|<>")
UPPER = _table(bytes(range(0x41, 0x5B)))
LOWER = _table(bytes(range(0x61, 0x7B)))
DIGIT = _table(b"0123456789")
MARK = _table(b"!?")
HIGH = _table(bytes(range(0x80, 0x100)))


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which keys are there more than once."""
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[which] > 1


def _of_text(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix(owner.astype(np.uint64) + np.uint64(1)))


def statistics(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All columns of ``BASE`` and ``FEATURES`` for every text."""
    n = len(offsets) - 1
    starts, ends, owner = words_of(buf, offsets)
    inside = ~IS_SPACE[buf]
    lead = (buf & 0xC0) != 0x80
    out = {
        "n_words": np.bincount(owner, minlength=n).astype(np.int64),
        "word_chars": _per_text(inside & lead, offsets),
        "n_symbols": _per_text(SYMBOL[buf], offsets),
    }
    words = block_hashes(buf, starts, ends)

    # Lines with a word, and those equal to an earlier one of their text.
    cuts = np.flatnonzero(buf == 0x0A)
    full = offsets[1:] > offsets[:-1]
    line = np.unique(np.concatenate([offsets[:-1][full], cuts + 1]))
    line = line[line < len(buf)]
    text = np.searchsorted(offsets, line, "right") - 1
    stop = np.minimum(np.append(line[1:], len(buf)), offsets[text + 1])
    stop = stop - ((stop > line) & (buf[stop - 1] == 0x0A))
    filled = np.searchsorted(starts, stop) > np.searchsorted(starts, line)
    line, stop, text = line[filled], stop[filled], text[filled]
    lines = np.bincount(text, minlength=n)
    keys = _of_text(block_hashes(buf, line, stop), text)
    firsts = np.unique(keys, return_index=True)[1]
    out["n_dup_lines"] = lines - np.bincount(text[firsts], minlength=n)

    # Words within three-word windows that a text has twice or more.
    hit = np.zeros(len(words) + 3, np.int64)
    if len(words) > 2:
        whole = owner[2:] == owner[:-2]
        window = mix(words[:-2] + np.uint64(3)) + mix(words[1:-1] + np.uint64(5)) * np.uint64(3) + words[2:] * np.uint64(7)
        at = np.flatnonzero(whole)
        again = at[_twice(_of_text(window[at], owner[at]))]
        hit[again] += 1
        hit[again + 3] -= 1
    covered = np.cumsum(hit)[: len(words)] > 0
    out["n_repeat_words"] = sums_by(owner, covered, n)

    count = np.maximum(out["n_words"], 1)
    size = np.maximum(np.diff(offsets), 1)
    letters = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(LOWER[buf] | UPPER[buf] | HIGH[buf] | DIGIT[buf], out=letters[1:])
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner, ends - starts)
    twin = np.zeros(len(words), np.int64)
    if len(words) > 1:
        twin[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    upper, lower = _per_text(UPPER[buf], offsets), _per_text(LOWER[buf], offsets)
    out |= {
        "word_length": out["word_chars"] / count,
        "symbol_share": out["n_symbols"] / size,
        "dup_line_share": out["n_dup_lines"] / np.maximum(lines, 1),
        "repeat_share": out["n_repeat_words"] / count,
        "upper_share": upper / np.maximum(upper + lower, 1),
        "digit_share": _per_text(DIGIT[buf], offsets) / size,
        "mark_share": _per_text(MARK[buf], offsets) / size,
        "bare_word_share": sums_by(owner, letters[ends] == letters[starts], n) / count,
        "line_words": out["n_words"] / np.maximum(lines, 1),
        "twin_share": sums_by(owner, twin, n) / count,
        "longest_word": longest.astype(float),
    }
    return out


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    few = stats["n_words"] < MIN_WORDS
    return few | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


class Trees:
    """Boosted trees as flat arrays: one row per tree, one column per node of a full tree."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for every row of ``x``."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(feature) + 1))):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def grow(
    x: np.ndarray, y: np.ndarray, falling: list[int], rounds: int = 60, depth: int = 3,
    rate: float = 0.2, bins: int = 64, least: float = 4.0, ridge: float = 1.0,
) -> Trees:
    """Newton boosting of the logistic loss on binned features, with falling features held so."""
    inner, leaves, wide = 2**depth - 1, 2**depth, x.shape[1]
    share = np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    feature = np.zeros((rounds, inner), np.int64)
    threshold = np.full((rounds, inner), np.inf)
    value = np.zeros((rounds, leaves))
    if not len(y) or y.min() == y.max():
        return Trees(base, feature[:0], threshold[:0], value[:0])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(wide)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    total = np.full(len(y), base)
    for r in range(rounds):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        for i in range(inner):
            rows = np.flatnonzero(node == i)
            best = (1e-6, None)
            g, h = grad[rows], hess[rows]
            parent = _gain(g.sum(), h.sum(), ridge, low[i], high[i])
            for f in range(wide) if h.sum() > 2 * least else ():
                gs = np.bincount(binned[rows, f], g, minlength=bins)[: len(edges[f])].cumsum()
                hs = np.bincount(binned[rows, f], h, minlength=bins)[: len(edges[f])].cumsum()
                left = _clip(-gs / (hs + ridge), low[i], high[i])
                right = _clip(-(g.sum() - gs) / (h.sum() - hs + ridge), low[i], high[i])
                gain = _gain(gs, hs, ridge, low[i], high[i]) - parent
                gain = gain + _gain(g.sum() - gs, h.sum() - hs, ridge, low[i], high[i])
                gain = np.where((hs >= least) & (h.sum() - hs >= least), gain, -1)
                if f in falling:
                    gain = np.where(left >= right, gain, -1)
                k = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[k] > best[0]:
                    best = (gain[k], (f, k, left[k], right[k]))
            kids = (2 * i + 1, 2 * i + 2)
            for kid in kids:
                low[kid], high[kid] = low[i], high[i]
            if best[1]:
                f, k, left, right = best[1]
                feature[r, i], threshold[r, i] = f, edges[f][k]
                if f in falling:
                    middle = (left + right) / 2
                    low[kids[0]], high[kids[1]] = middle, middle
            node[rows] = 2 * i + 1 + (x[rows, feature[r, i]] > threshold[r, i])
        gs = np.bincount(node - inner, grad, minlength=leaves)
        hs = np.bincount(node - inner, hess, minlength=leaves)
        value[r] = rate * _clip(-gs / (hs + ridge), low[inner:], high[inner:])
        total += value[r][node - inner]
    return Trees(base, feature, threshold, value)


def _clip(v, low, high):
    return np.minimum(np.maximum(v, low), high)


def _gain(g, h, ridge, low, high):
    """What the loss falls by at the best value within the bounds."""
    v = _clip(-g / (h + ridge), low, high)
    return -(g * v + 0.5 * (h + ridge) * v * v)


def _matrix(stats: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([stats[f].astype(float) for f in FEATURES], 1)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` labelled rows; all that reaches the driver are theirs."""
    good = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_y")).dropna()
    chosen = good.dropDuplicates(["_id"]).orderBy(F.xxhash64("_id"), "_id").limit(sample).collect()
    if not chosen:
        return grow(np.zeros((0, len(FEATURES))), np.zeros(0), [])
    table = documents.sparkSession.createDataFrame(chosen, good.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                stats = statistics(*flat(part.column("text")))
                columns = [pa.array(stats[f].astype(float)) for f in FEATURES]
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_y"), *columns], ["_id", "_y", *FEATURES])

    # The table has at most ``sample`` rows.
    known = documents.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
    known = known.join(F.broadcast(table), "_id").select("_id", "_y", "text")
    kind = known.schema["_id"].dataType.simpleString()
    rows = known.mapInArrow(run, f"_id {kind}, _y double, " + ", ".join(f"{f} double" for f in FEATURES))
    rows = rows.dropDuplicates(["_id"]).orderBy("_id").toPandas()
    falling = [i for i, f in enumerate(FEATURES) if f in FALLING]
    return grow(rows[list(FEATURES)].to_numpy(float), rows["_y"].to_numpy(float), falling)


def judged(documents: DataFrame, trees: Trees, keep_from: float = 0.5, with_text: bool = True) -> DataFrame:
    """The documents with the base statistics, ``base_failed``, ``quality_score`` and ``kept``.

    ``with_text=False`` leaves the texts out of what goes back to the engine.
    """
    own = [*(T.StructField(c, T.LongType()) for c in BASE), T.StructField("base_failed", T.BooleanType())]
    own += [T.StructField("quality_score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    names = [f.name for f in own]
    texts = documents.drop(*names).withColumn("text", F.col("text").cast("string"))
    back = [f for f in texts.schema if with_text or f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                stats = statistics(*flat(part.column("text")))
                failed, score = base_failed(stats), trees.score(_matrix(stats))
                columns = [part.column(f.name) for f in back]
                columns += [pa.array(stats[c].astype(np.int64)) for c in BASE]
                columns += [pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_from))]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in back), *names])

    return texts.mapInArrow(run, T.StructType([*back, *own]))


def op2_tree_quality(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trees = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(documents, trees, with_text=False)
