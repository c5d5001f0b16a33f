"""Toxicity: a support vector machine on the gapped subsequence kernel, with Nyström landmarks.

The kernel of two strings sums, over all triples of letters, what each string gives the triple:
``DECAY`` to the power of the stretch it is spread over, for each place; a unit's start counts
as a letter. Letters need not be
neighbours, so insults with signs or letters put in stay near the plain word. A unit is a word
without the signs around it, or a run of three or more single characters with blanks between
("i d i o t"). Units longer than ``WIDEST`` are scored in windows that overlap by half, so all of
a text counts. A text is scored by its ``TOP`` most toxic units together, through a logistic
plane: one unit that looks like an insult by chance speaks less than several.

Labels are of whole documents. Units with a stem, that is letters in a row, are the toxic
examples: a stem is held by several toxic documents, at least ``RATE`` of all that hold it are
toxic, and chance would let hardly any stem be so; the same is asked of the distinct units that
hold it, where two toxic documents have more than one each. So a clean document with an insult,
or a wrong label, takes no stem away. Units with a stem that clean documents hold as often are
learned from on neither side. From the second round on, units that recur in toxic documents
alone and that the machine itself finds toxic come in too. Landmarks are units of both kinds; the
Nyström map of the kernel on them is linear, the machine is trained there by Newton steps on
the squared hinge loss, with the clean units it errs on added in each round. The result is one
weight per triple of letters, 64**3 numbers, by which a unit is scored without a landmark in
sight. The sample of labelled rows is bounded by ``SAMPLE`` toxic and ``CLEAN`` times as many clean ones (least hash first);
scoring covers every row where it is read, without a shuffle.

Defined results: null and empty texts, and texts without a unit of three letters, get the score
of no evidence; labels that are null or of unknown rows are ignored; with labels of one kind
only, every score is that kind's share, and 0 without any; repeated rows are scored each; an
empty table gives no rows; other columns stay, except one with the output's name, which is replaced.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.llm.arrays import block_hashes, expand, flat, give_back, lean, pieces, words_of
from ledgerweave.llm.pretokens import LETTER, classes

#: Toxic rows that the machine learns from, at most.
SAMPLE = 1500
CLEAN = 3  # clean rows for each toxic one
LANDMARKS = 144  # of each kind, at most
UNITS = 4000  # clean units to begin training with
DECAY = 0.7
WIDEST = 32
LETTERS = 64  # codes: 0 no letter, 1 to 61 the commonest, 62 a unit's start, 63 the rest
START = 62
CUT = 0.3
#: Units of a text that its score is made of.
TOP = 3

_TRIPLES = {
    n: np.array(list(itertools.combinations(range(n), 3)), np.int64).reshape(-1, 3) for n in range(3, WIDEST + 2)
}


def _spread(n: int) -> np.ndarray:
    t = _TRIPLES[n]
    return DECAY ** (t[:, 2] - t[:, 0] + 1.0)


class Alphabet:
    """Codes of letters, case folded."""

    def __init__(self, common: str):
        self.codes = np.zeros(0x110000, np.uint8)
        self.codes[classes() == LETTER] = LETTERS - 1
        for code, letter in enumerate(common[: START - 1], 1):
            for form in {letter, letter.upper()}:
                if len(form) == 1:
                    self.codes[ord(form)] = code
        self.common = common

    @classmethod
    def of(cls, texts: list[str]) -> Alphabet:
        seen: Counter = Counter()
        for text in texts:
            seen.update(text)
        fold: Counter = Counter()
        for c, n in seen.items():
            if c.isalpha() and len(c.lower()) == 1:
                fold[c.lower()] += n
        return cls("".join(c for c, _ in sorted(fold.items(), key=lambda x: (-x[1], x[0]))))


def units(buf: np.ndarray, offsets: np.ndarray, alphabet: Alphabet):
    """Codes of all characters; start, end (in characters) and text number of every unit."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    codes = alphabet.codes[np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    starts, ends, owner = words_of(buf, offsets)
    starts, ends = np.searchsorted(at, starts), np.searchsorted(at, ends)
    # Runs of single characters count as one unit each, besides.
    single = (ends - starts) == 1
    first = single & np.r_[True, ~(single[:-1] & (owner[1:] == owner[:-1]))][: len(single)]
    last = single & np.r_[~(single[1:] & (owner[1:] == owner[:-1])), True][: len(single)]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    long = b - a >= 2
    starts = np.concatenate([starts, starts[a[long]]])
    ends = np.concatenate([ends, ends[b[long]]])
    owner = np.concatenate([owner, owner[a[long]]])
    # Signs around a unit are no part of it.
    letters = np.flatnonzero(codes)
    low = np.searchsorted(letters, starts)
    high = np.searchsorted(letters, ends) - 1
    real = high - low >= 2
    starts, ends, owner = letters[low[real]], letters[high[real]] + 1, owner[real]
    # Long units in windows that overlap by half.
    half = WIDEST // 2
    count = np.where(ends - starts > WIDEST, -(-(ends - starts - WIDEST) // half) + 1, 1)
    if (count > 1).any():
        step = expand(np.zeros(len(count), np.int64), count)
        starts, ends, owner = (np.repeat(v, count) for v in (starts, ends, owner))
        starts = starts + step * half
        ends = np.minimum(ends, starts + WIDEST)
    return codes, starts, ends, owner


def _by_length(codes, starts, ends) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of units with one length, and their codes as a matrix, with the start in front."""
    lengths = ends - starts
    for n in np.unique(lengths):
        if n >= 3:
            rows = np.flatnonzero(lengths == n)
            for part in np.array_split(rows, max(1, len(rows) * len(_TRIPLES[int(n) + 1]) // 500_000)):
                inner = codes[starts[part, None] + np.arange(n)].astype(np.int64)
                yield part, np.c_[np.full(len(part), START), inner]


def _triples(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all triples of each row, and what the row gives each; triples with a sign give 0."""
    t = _TRIPLES[matrix.shape[1]]
    a, b, c = matrix[:, t[:, 0]], matrix[:, t[:, 1]], matrix[:, t[:, 2]]
    weight = np.where((a > 0) & (b > 0) & (c > 0), _spread(matrix.shape[1]), 0.0)
    return (a * LETTERS + b) * LETTERS + c, weight


def _norms(ids: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Root of each row's kernel with itself."""
    order = np.argsort(ids, axis=1, kind="stable")
    ids, weight = np.take_along_axis(ids, order, 1), np.take_along_axis(weight, order, 1)
    total = np.cumsum(weight, axis=1)
    last = np.ones(ids.shape, bool)
    last[:, :-1] = ids[:, 1:] != ids[:, :-1]
    out = np.zeros(len(ids))
    row, column = np.nonzero(last)
    ends = total[row, column]
    fresh = np.r_[True, row[1:] != row[:-1]]
    before = np.where(fresh, 0.0, np.r_[0.0, ends[:-1]])
    np.add.at(out, row, (ends - before) ** 2)
    return np.sqrt(np.maximum(out, 1e-12))


class Machine:
    """Weights of triples, a bias, and the line from a margin to a probability."""

    def __init__(self, alphabet: Alphabet, weights: np.ndarray, bias: float):
        self.alphabet, self.bias = alphabet, bias
        letters = np.arange(LETTERS) > 0  # triples with a sign have no weight
        self.weights = weights * np.multiply.outer(np.multiply.outer(letters, letters), letters).ravel()
        self.slope, self.shift = np.eye(TOP)[0], 0.0
        self.floor = -1.0  # the margin of no evidence

    def margins(self, codes, starts, ends) -> np.ndarray:
        """Margin of each unit, where it may be above the floor; the floor elsewhere."""
        out = np.full(len(starts), self.floor)
        for rows, matrix in _by_length(codes, starts, ends):
            t, spread = _TRIPLES[matrix.shape[1]], _spread(matrix.shape[1])
            dot = np.zeros(len(rows))
            for (i, j, k), s in zip(t, spread):
                dot += s * self.weights[(matrix[:, i] * LETTERS + matrix[:, j]) * LETTERS + matrix[:, k]]
            # A unit's norm is at least that of its triples taken as all different.
            full = (matrix > 0).all(1)
            least = np.where(full, np.sqrt((spread**2).sum()), DECAY**matrix.shape[1])
            maybe = np.flatnonzero(dot / least + self.bias > self.floor)
            if len(maybe):
                exact = dot[maybe] / _norms(*_triples(matrix[maybe])) + self.bias
                out[rows[maybe]] = np.maximum(exact, self.floor)
        return out

    def text_margins(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The ``TOP`` highest margins of each text's units, in a row of their own."""
        n = len(offsets) - 1
        best = np.full((n, TOP), self.floor)
        if len(buf):
            codes, starts, ends, owner = units(buf, offsets, self.alphabet)
            keys = block_hashes(codes, starts, ends)
            _, first, which = np.unique(keys, return_index=True, return_inverse=True)
            margin = self.margins(codes, starts[first], ends[first])
            some = np.flatnonzero(margin[which] > self.floor)
            pairs = np.stack([owner[some], which[some]])  # a unit counts as often as it stands there
            pairs = pairs[:, np.lexsort((-margin[pairs[1]], pairs[0]))]
            place = np.arange(pairs.shape[1]) - np.searchsorted(pairs[0], pairs[0])
            top = place < TOP
            best[pairs[0, top], place[top]] = margin[pairs[1, top]]
        return best

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        margin = self.text_margins(buf, offsets) @ self.slope + self.shift
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


class Constant:
    """What labels of one kind, or none, allow to say."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.full(len(offsets) - 1, self.share)


def _numbered(text: str, alphabet: Alphabet, numbers: dict[str, int]) -> np.ndarray:
    """Numbers of a text's distinct units, in lower case; new ones are added."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    _, starts, ends, _ = units(data, np.array([0, len(data)], np.int64), alphabet)
    found = {text[a:b].lower() for a, b in zip(starts.tolist(), ends.tolist())}
    return np.array(sorted(numbers.setdefault(w, len(numbers)) for w in found if len(w) <= WIDEST), np.int64)


def _without_copies(lists: list[np.ndarray], n: int) -> list[bool]:
    """Whether a document shares less than a third of its units with each one before it."""
    holders: list[list[int]] = [[] for _ in range(n)]
    out = []
    for i, own in enumerate(lists):
        shared = Counter(h for w in own.tolist() for h in holders[w] if len(holders[w]) <= 8)
        out.append(not shared or 3 * shared.most_common(1)[0][1] < len(own))
        if out[-1]:
            for w in own.tolist():
                if len(holders[w]) <= 8:
                    holders[w].append(i)
    return out


#: A stretch of letters marks units if at least this share of the documents that hold it is toxic,
#: and if fewer than ``CHANCE`` stretches would be so by chance.
RATE = 0.7
CHANCE = 0.5


def _grams(word: str) -> set[str]:
    """All stretches of four letters, the start being one, and of the first six, and the word as a whole."""
    marked = f"^{word}"
    return {f"{marked}$", marked[:6], *(marked[i : i + 4] for i in range(len(marked) - 3))}


def _tail(n: np.ndarray, k: np.ndarray, share: float) -> np.ndarray:
    """Chance of ``k`` or more of ``n`` at a rate of ``share``."""
    if not len(n):
        return np.zeros(0)
    log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n.max() + 1)))])
    total = np.zeros(len(n))
    for more in range(int((n - k).max()) + 1):
        at = k + more
        inside = at <= n
        j, m = at[inside], n[inside]
        total[inside] += np.exp(log[m] - log[j] - log[m - j] + j * np.log(share) + (m - j) * np.log(1 - share))
    return total


def _marked(
    names: list[str],
    lists: list[np.ndarray],
    toxic: np.ndarray,
    alone: np.ndarray,
    seen: np.ndarray,
    weight: float,
) -> tuple[set[str], set[str]]:
    """Units that make a sentence toxic, and units in doubt.

    Both hold a stem: letters in a row that toxic documents hold and clean ones hardly do, by the
    documents, or by their distinct units where several toxic documents each have more than one.
    A stem that a clean document has by chance, or by a wrong label, stays one; a unit that clean
    documents hold as well is in doubt and learned from on neither side.
    """
    numbers: dict[str, int] = {}
    of_unit = [np.array([numbers.setdefault(g, len(numbers)) for g in _grams(w)], np.int64) for w in names]
    held, spread, several = (np.zeros((2, len(numbers)), np.int64) for _ in range(3))
    for own, label, first in zip(lists, toxic, alone):
        if len(own) and (first or not label):
            grams, times = np.unique(np.concatenate([of_unit[i] for i in own.tolist()]), return_counts=True)
            held[int(label), grams] += 1
            spread[int(label), grams] += times
            several[int(label), grams] += times > 1
    held[:, 0] = spread[:, 0] = 0
    tested = max(1, int((held[1] > 0).sum()))
    volume = [sum(len(own) for own, y, first in zip(lists, toxic, alone) if y == kind and (first or not y)) for kind in (0, 1)]
    stems = np.zeros(len(numbers), bool)
    for counts, share, least in (
        (held, (alone & (toxic == 1)).sum() / max(1, (alone | (toxic == 0)).sum()), held[1] >= 3),
        (spread, volume[1] / max(1, sum(volume)), several[1] >= 2),
    ):
        every = counts.sum(0)
        often = np.flatnonzero(least & (counts[1] >= RATE * (counts[1] + weight * counts[0])))
        stems[often[_tail(every[often], counts[1][often], float(share)) * tested < CHANCE]] = True
    holding = [i for i in range(len(names)) if stems[of_unit[i]].any()]
    marked = {names[i] for i in holding if seen[1][i] and seen[1][i] >= RATE * (weight * seen[0][i] + seen[1][i])}
    return marked, {names[i] for i in holding} - marked


def _coded(texts: list[str], alphabet: Alphabet):
    """Codes, starts and ends of strings that are units themselves."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    return alphabet.codes[points], ends - lengths, ends


def _features(texts: list[str], alphabet: Alphabet, columns: np.ndarray | None):
    """Normalised kernel features; ``columns`` are the triples kept, all that occur if None."""
    found = []
    codes, starts, ends = _coded(texts, alphabet)
    for rows, matrix in _by_length(codes, starts, ends):
        ids, weight = _triples(matrix)
        weight = weight / _norms(ids, weight)[:, None]
        found.append((np.repeat(rows, ids.shape[1]), ids.ravel(), weight.ravel()))
    row, ids, weight = (np.concatenate([f[i] for f in found]) for i in range(3))
    if columns is None:
        columns = np.unique(ids[weight > 0])
    at = np.minimum(np.searchsorted(columns, ids), len(columns) - 1)
    hit = (columns[at] == ids) & (weight > 0)
    dense = np.zeros(len(texts) * len(columns), np.float32)
    np.add.at(dense, row[hit] * len(columns) + at[hit], weight[hit])
    return dense.reshape(len(texts), len(columns)), columns


def _newton(x: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Squared hinge loss with costs ``c``, the last column of ``x`` being the bias."""
    w = np.zeros(x.shape[1])
    hold = np.full(x.shape[1], ridge)
    hold[-1] = 1e-6
    for _ in range(25):
        slack = 1 - y * (x @ w)
        active = slack > 0
        xa = x[active]
        grad = hold * w - xa.T @ (c[active] * y[active] * slack[active])
        step = np.linalg.solve(np.diag(hold) + xa.T @ (xa * c[active][:, None]), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _with_signs(text: str, k: int) -> str:
    """The unit with signs put between its letters, at every place or at one."""
    if k % 2 == 0:
        return ".".join(text)[:WIDEST]
    cut = 1 + k % max(1, len(text) - 1)
    return (text[:cut] + "*" + text[cut:])[:WIDEST]


def learn(texts: list[str], toxic: np.ndarray, weight: float = 1.0) -> Machine | Constant:
    """A machine from documents labelled as a whole; a clean one stands for ``weight`` toxic ones' share."""
    if not len(texts) or toxic.min() == toxic.max():
        return Constant(float(toxic.mean()) if len(texts) else 0.0)
    alphabet = Alphabet.of(texts)
    numbers: dict[str, int] = {}
    lists = [_numbered(text, alphabet, numbers) for text in texts]
    names = list(numbers)
    alone = _without_copies(lists, len(names))
    seen = np.zeros((2, len(names)), np.int64)
    for own, label, first in zip(lists, toxic, alone):
        if first or not label:  # copies of one toxic document bear no witness to its words
            seen[int(label), own] += 1
    marked, doubt = _marked(names, lists, toxic, np.array(alone), seen, weight)
    if not marked:
        return Constant(float(toxic.mean()))
    clean = sorted(np.flatnonzero(seen[0]).tolist(), key=lambda i: (-seen[0][i], names[i]))
    clean = [names[i] for i in clean if names[i] not in marked and names[i] not in doubt]
    bad = sorted(marked, key=lambda w: (-seen[1][numbers[w]], w))
    rest = np.flatnonzero((seen[1] >= 2) & (seen[0] == 0)).tolist()
    rest = sorted(names[i] for i in rest if names[i] not in marked)
    step = max(1, len(clean) // UNITS)
    negative = dict.fromkeys(clean[: UNITS // 3] + clean[::step][:UNITS])
    machine = None
    pool_codes = _coded(clean, alphabet)
    for _ in range(3):
        few = list(negative)
        # Half of the clean landmarks are the latest: units that the machine erred on.
        half = LANDMARKS // 2
        landmarks = bad[:LANDMARKS] + few[:half] + few[half:][-half:]
        basis, columns = _features(landmarks, alphabet, None)
        value, vector = np.linalg.eigh((basis @ basis.T).astype(float))
        kept = value > 1e-6 * value.max()
        root = vector[:, kept] / np.sqrt(value[kept])
        rows = bad + [_with_signs(w, i) for i, w in enumerate(bad)] + few
        rows += [_with_signs(w, i) for i, w in enumerate(few[: 2 * LANDMARKS])]
        rows = [w for w in rows if 3 <= len(w) <= WIDEST]
        positive = np.zeros(len(rows), bool)
        positive[: 2 * len(bad)] = True
        mapped = np.concatenate(
            [(_features(rows[i : i + 200], alphabet, columns)[0] @ basis.T).astype(float) @ root for i in range(0, len(rows), 200)]
        )
        x = np.c_[mapped, np.ones(len(rows))]
        y = np.where(positive, 1.0, -1.0)
        w = _newton(x, y, np.where(positive, 1.0 / positive.sum(), 1.0 / (~positive).sum()) * 100)
        triples = np.zeros(LETTERS**3)
        triples[columns] = basis.T @ (root @ w[:-1])
        machine = Machine(alphabet, triples, float(w[-1]))
        # Clean units that are not well below the line come in.
        margin = machine.margins(*pool_codes)
        worst = np.argsort(-margin, kind="stable")[:1500]
        for i in worst[margin[worst] > -0.6]:
            negative.setdefault(clean[i])
        # Units that recur less, but that the machine finds toxic, come in on the other side.
        found = machine.margins(*_coded(rest, alphabet)) if rest else np.zeros(0)
        grown = marked | {w for w, m in zip(rest, found) if m > 0}
        bad = sorted(grown, key=lambda w: (-seen[1][numbers[w]], w))
    margins = []
    for i in range(0, len(texts), 300):
        data = [t.encode("utf-8") for t in texts[i : i + 300]]
        cuts = np.concatenate([[0], np.cumsum([len(d) for d in data])])
        margins.append(machine.text_margins(np.frombuffer(b"".join(data), np.uint8), cuts))
    margins = np.concatenate(margins)
    machine.slope, machine.shift = _line(margins, toxic.astype(bool), weight)
    return machine


def _line(margins: np.ndarray, toxic: np.ndarray, weight: float) -> tuple[np.ndarray, float]:
    """Logistic plane through rows of margins, with targets held off 0 and 1 so that it stays
    finite. No margin may speak against toxicity: one that would is left out."""
    high, low = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (high + 1) / (high + 2), 1 / (low + 2))
    used, cost = np.arange(margins.shape[1]), np.where(toxic, 1.0, weight)
    while True:
        x = np.c_[margins[:, used], np.ones(len(margins))]
        w = np.r_[1.0, np.zeros(len(used))]
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
            grad = x.T @ (cost * (p - target)) + 1e-3 * w
            step = np.linalg.solve(x.T @ (x * (cost * p * (1 - p))[:, None]) + 1e-3 * np.eye(len(w)), grad)
            w -= np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        if (w[:-1] >= 0).all() or len(used) == 1:
            break
        used = np.delete(used, np.argmin(w[:-1]))
    slope = np.zeros(margins.shape[1])
    slope[used] = w[:-1]
    return (slope, float(w[-1])) if w[0] > 0 else (np.eye(margins.shape[1])[0], 0.0)


def held_out() -> Column:
    """Rows whose labels are for testing only."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | Constant:
    """Learn from at most ``sample`` labelled rows of each kind that are not held out."""
    known = labels.filter(~held_out()).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y"))
    known = known.dropna().dropDuplicates(["_id"])
    chosen, share = [], {}
    for kind in (0, 1):
        order = known.filter(F.col("_y") == kind).orderBy(F.xxhash64("_id"), "_id")
        drawn = order.limit(sample if kind else CLEAN * sample).collect()
        share[kind] = len(drawn) / max(1, known.filter(F.col("_y") == kind).count())
        chosen += drawn
    if not chosen:
        return Constant(0.0)
    # Toxic rows are sampled more densely; their rates are those among all labelled rows.
    weight = share[1] / share[0] if share[0] and share[1] else 1.0
    # At most (1 + CLEAN) * ``sample`` rows.
    table = F.broadcast(documents.sparkSession.createDataFrame(chosen, known.schema))
    texts = documents.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_t"))
    rows = texts.join(table, "_id").dropDuplicates(["_id"]).orderBy("_id").collect()
    machine = learn([r["_t"] or "" for r in rows], np.array([r["_y"] for r in rows], np.int64), weight)
    give_back()
    return machine


def scored(documents: DataFrame, machine: Machine | Constant, with_text: bool = True, name: str = "score") -> DataFrame:
    """The documents with the column ``name``; ``with_text=False`` leaves the texts out."""
    texts = documents.drop(name).withColumn("text", F.col("text").cast("string"))
    back = [f for f in texts.schema if with_text or f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                scores = machine.scores(*flat(part.column("text")))
                columns = [*(part.column(f.name) for f in back), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in back), name])

    return texts.mapInArrow(lean(run), T.StructType([*back, T.StructField(name, T.DoubleType())]))


def without_toxic(documents: DataFrame, machine: Machine | Constant, cut: float = CUT) -> DataFrame:
    """The documents that score below ``cut``, with their columns as they were."""
    name = "_toxicity"
    while name in documents.columns:
        name += "_"
    return scored(documents, machine, name=name).filter(F.col(name) < cut).drop(name)


def op6_subsequence_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = scored(documents, machine, with_text=False)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
