"""The data structures inside the operators, against plain versions."""

import random
import sys

import brute
import numpy as np
import pyarrow as pa
import pytest
import regex

from ledgerweave.llm import bpe, fm_substrings, minhash, pfp_substrings, pretokens, quality, repeats, sharding, toxicity
from ledgerweave.llm.arrays import flat, gram_hashes, pieces, prefix_sums, segment_hashes, words_of
from ledgerweave.llm.exact_dedup import FuseFilter


def random_texts(seed, n=300):
    rnd = random.Random(seed)
    signs = list("ab1 2  \n\t'''s t re ve ll m d!?é 　½中 .\x1c\x85") + ["'s", "'ll", "'re", "'ve"]
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50000])
def test_fuse_filters_miss_nothing_and_let_little_through(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    made = FuseFilter.from_bytes(FuseFilter.build(keys).to_bytes())
    assert made.maybe(keys).all()
    others = np.random.default_rng(n + 1).integers(0, 2**63, 20000).astype(np.uint64)
    assert made.maybe(others).mean() < 0.001
    assert made.slots.nbytes < 2 * (1.4 * n + 64)


def test_words_and_hashes():
    texts = [*random_texts(1), None, ""]
    buf, offsets = flat(pa.array(texts))
    starts, ends, owner = words_of(buf, offsets)
    found = [[] for _ in texts]
    hashes = {}
    for a, b, o, h in zip(starts, ends, owner, segment_hashes(prefix_sums(buf), starts, ends)):
        word = buf[a:b].tobytes()
        found[o].append(word.decode())
        assert hashes.setdefault(word, h) == h
    assert found == [brute.words(t) for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def test_pieces_hold_every_row(monkeypatch):
    monkeypatch.setattr("ledgerweave.llm.arrays.PIECE", 50)
    column = pa.table({"text": ["x" * n for n in (0, 10, 200, 0, 0, 49, 1, 1, 60, 0)]})
    parts = [p.column("text").to_pylist() for p in pieces(column, "text")]
    assert sum(parts, []) == column.column("text").to_pylist() and len(parts) > 3


def test_pretokens():
    from public_tokenizers import PATTERN

    pattern = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    texts = random_texts(2, 3000)
    buf, offsets = flat(pa.array(texts))
    found = [[] for _ in texts]
    for a, b, o in zip(*pretokens.split(buf, offsets)):
        found[o].append(buf[a:b].tobytes().decode())
    assert found == [pattern.findall(t) for t in texts]


def test_classes_are_those_of_the_library():
    """Every code point between letters, digits and signs, as the tiktoken library splits it."""
    import tiktoken
    from public_tokenizers import PATTERN

    # A vocabulary of bytes and of all pairs of them: where two bytes merge, no piece ends.
    own = bpe.codec(bpe.read_ranks(bpe.default_path()))
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ids, special_tokens={})
    texts = []
    for low in range(0, 0x30000, 0x400):
        points = [c for c in range(low, low + 0x400) if not 0xD800 <= c < 0xE000]
        texts.append("".join(f"er{chr(c)}er {chr(c)}12{chr(c)}  " for c in points))
    buf, offsets = flat(pa.array(texts))
    tokens, cuts = own.encode(buf, offsets)
    wrong = [hex(i * 0x400) for i, t in enumerate(texts) if library.encode_ordinary(t) != tokens[cuts[i] : cuts[i + 1]].tolist()]
    assert not wrong


def test_long_pieces_take_several_queries():
    import tiktoken
    from public_tokenizers import PATTERN

    own = bpe.codec(bpe.read_ranks(bpe.default_path()))
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ids, special_tokens={})
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcdeé") for _ in range(n)) for n in (1, 50, 200, 1500)] + ["a" * 700]
    tokens, cuts = own.encode(*flat(pa.array(texts)))
    for i, text in enumerate(texts):
        assert tokens[cuts[i] : cuts[i + 1]].tolist() == library.encode_ordinary(text)


def test_wavelet_ranks_and_backward_search():
    rng = np.random.default_rng(4)
    symbols = rng.integers(1, 30, 900)
    cuts = np.array([0, 100, 113, 400, 900])
    index = fm_substrings.FMIndex(symbols, cuts, 13)
    runs = [symbols[a:b].tolist() for a, b in zip(cuts, cuts[1:])]
    for length in (1, 2, 3):
        starts = np.concatenate([index.at[a : b - length + 1] for a, b in zip(cuts, cuts[1:])])
        low, high, reached = index.intervals(starts, length)
        for s, a, b, r in zip(starts, low, high, reached):
            window = index.text[s : s + length].tolist()
            want = sum(run[i : i + length] == window for run in runs for i in range(len(run)))
            assert b - a == want and r == length


@pytest.mark.parametrize("engine, window, high", [(fm_substrings, 13, 3), (pfp_substrings, 50, 4)])
def test_engines_find_the_least_document(engine, window, high):
    rng = np.random.default_rng(window)
    base = rng.integers(1, high, 400)
    lengths = rng.integers(window, 150, 60)
    runs = []
    for i, n in enumerate(lengths):
        at = rng.integers(0, 400 - n)
        run = base[at : at + n].copy()
        if i % 3 == 0:
            run[rng.integers(0, n)] = 9
        runs.append(run)
    runs += [np.full(200, 2), np.full(120, 2), np.tile([1, 2], 60)]
    docs = rng.integers(0, 1000, len(runs))
    dtype = np.uint64 if engine is fm_substrings else np.uint8
    cuts = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    found = engine.least_documents(np.concatenate(runs).astype(dtype), cuts, docs)
    least = {}
    for run, doc in zip(runs, docs):
        for i in range(len(run) - window + 1):
            key = run[i : i + window].tobytes()
            least[key] = min(least.get(key, doc), doc)
    want = [least[r[i : i + window].tobytes()] for r in runs for i in range(len(r) - window + 1)]
    assert found.tolist() == want


def test_trees_keep_to_their_direction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(20 * x[:, 1])) < 0.5).astype(float)
    y[rng.random(3000) < 0.1] = 1 - y[rng.random(3000) < 0.1].mean().round()
    trees = quality.grow(x, y, falling=[0, 1])
    for feature in (0, 1):
        for _ in range(50):
            line = np.repeat(rng.random((1, 3)), 60, 0)
            line[:, feature] = np.linspace(0, 1, 60)
            assert (np.diff(trees.score(line)) <= 1e-12).all()
    free = quality.grow(x, y, falling=[])
    assert ((free.score(x) > 0.5) == (y > 0.5)).mean() > 0.9


def test_subsequence_kernel():
    alphabet = toxicity.Alphabet("abcdefgh")
    words = ["abcd", "axbcd", "hgfe", "abab", "a.b.c"]

    def plain(s, t):
        total = 0.0
        for u in ("".join(p) for p in __import__("itertools").product("^abcdefgh", repeat=3)):
            value = []
            for w in (f"^{s}", f"^{t}"):
                value.append(
                    sum(
                        toxicity.DECAY ** (k - i + 1)
                        for i in range(len(w)) for j in range(i + 1, len(w)) for k in range(j + 1, len(w))
                        if w[i] + w[j] + w[k] == u
                    )
                )
            total += value[0] * value[1]
        return total

    features, _ = toxicity._features([w for w in words if "x" not in w], alphabet, None)
    kept = [w for w in words if "x" not in w]
    for i, s in enumerate(kept):
        for j, t in enumerate(kept):
            want = plain(s, t) / (plain(s, s) * plain(t, t)) ** 0.5
            assert abs(float(features[i] @ features[j]) - want) < 1e-5


def test_margins_of_a_machine_are_kernel_sums():
    alphabet = toxicity.Alphabet("abcdefgh")
    rng = np.random.default_rng(2)
    machine = toxicity.Machine(alphabet, rng.normal(size=toxicity.LETTERS**3), 0.0)
    machine.floor = -1e9
    words = ["abcd", "hgfeabc", "abab", "a.b.c", "abcdefgh" * 3]
    dense, columns = toxicity._features(words, alphabet, None)
    want = dense @ machine.weights[columns]
    assert np.allclose(machine.margins(*toxicity._coded(words, alphabet)), want, atol=1e-5)


def test_sketch_estimates():
    rng = np.random.default_rng(8)
    for share in (0.5, 0.8, 0.95):
        pool = rng.integers(0, 2**63, 2000).astype(np.uint64)
        both = int(1000 * share)
        one, two = pool[:1000], np.concatenate([pool[:both], pool[1000 : 2000 - both]])
        true = both / (2000 - both)
        guess = minhash.estimate(np.sort(one)[: minhash.K].tobytes(), np.sort(two)[: minhash.K].tobytes(), 1000, 1000)
        assert abs(guess - true) < 0.18
    small = np.sort(pool[:100])
    assert minhash.estimate(small[:90].tobytes(), small.tobytes(), 90, 100) == 0.9


def test_overlap_of_linked_sketches():
    """Pairs at the threshold share more of their sketches than ``least_overlap`` asks for."""
    rng = np.random.default_rng(9)
    for size in (5, 20, 100, 128, 140, 300, 2000):
        both = -(-8 * size // 9)
        asked = int(minhash.least_overlap(np.array([size]))[0])
        for _ in range(200):
            pool = rng.permutation(2 * size - both).astype(np.uint64) + np.uint64(rng.integers(0, 10**9))
            pool = minhash.mix(pool)
            one, two = np.sort(pool[:size])[: minhash.K], np.sort(pool[size - both :])[: minhash.K]
            assert len(np.intersect1d(one, two)) >= asked


@pytest.mark.parametrize("size", [5, 100, 104, 128, 150, 200, 212, 213, 500, 2000, 50000])
def test_overlap_of_contained_sketches(size):
    """Of a set and a whole that holds it, the sketches share what is the set's in the whole's."""
    whole = size + size // 4
    shared = np.random.default_rng(size).hypergeometric(size, whole - size, min(whole, minhash.K), 1_000_000)
    assert shared.min() >= minhash.least_overlap(np.array([size, whole])).max()
    if whole > minhash.K:
        assert shared.min() / minhash.K >= minhash.PASS


def test_splitters_meet_their_goals(spark):
    rng = np.random.default_rng(3)
    rows = [(int(h), int(d), int(s)) for h, d, s in zip(rng.integers(0, sharding.TOP, 3000), rng.integers(0, sharding.TOP, 3000), rng.integers(8, 60, 3000))]
    rows += [(12345, int(d), 20) for d in rng.integers(0, sharding.TOP, 2000)]  # one text's copies
    keys = spark.createDataFrame(rows, "_h long, _d long, size long")
    cuts = sharding.splitters(keys, 8, 0.0)
    rows.sort()
    whole = sum(r[2] for r in rows)
    for i, cut in enumerate(cuts, 1):
        assert abs(sum(r[2] for r in rows if r[:2] < cut) - whole * i // 8) <= 60


def test_bits_of_sketches_bound_what_they_share():
    rng = np.random.default_rng(5)
    pool = np.sort(rng.choice(np.iinfo(np.int64).max, 400, replace=False).astype(np.uint64))
    pool = np.sort(minhash.mix(pool))
    for size, both in ((128, 0), (128, 75), (128, 128), (40, 35), (1, 1)):
        one, two = pool[:size], pool[size - both : 2 * size - both]
        owner = np.repeat([0, 1], size)
        a, b = minhash.sketch_bits(np.concatenate([one, two]), owner, 2)
        assert a.shape == (minhash.BITS,)
        alone = max(int(np.bitwise_count(a & ~b).sum()), int(np.bitwise_count(b & ~a).sum()))
        assert size - alone >= both
        if size == 128 and not both:  # texts that share nothing have no room
            assert size - alone < minhash.OVERLAP


def test_pieces_forgotten_are_encoded_again(monkeypatch):
    import tiktoken
    from public_tokenizers import PATTERN

    ranks = bpe.read_ranks(bpe.default_path())
    own = bpe.Codec(ranks)
    theirs = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=own.ids, special_tokens={})
    monkeypatch.setattr(bpe, "KEPT", 40)
    rng = random.Random(11)
    words = ["".join(rng.choice("abcxyzé中") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    for _ in range(30):
        text = " ".join([*rng.choices(words, k=25), *words[:5]])
        data = text.encode()
        tokens, cuts = own.encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert tokens.tolist() == theirs.encode_ordinary(text)
        assert own.decode(tokens, cuts) == [data]
        assert len(own.known) <= 40 and len(own.older) <= 40


def test_remembered_pieces_are_small():
    import gc
    import tracemalloc

    own = bpe.Codec(bpe.read_ranks(bpe.default_path()))
    rng = random.Random(12)
    data = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(20000)).encode()
    gc.collect()
    tracemalloc.start()
    try:
        first = own.encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist()
        gc.collect()
        held = tracemalloc.get_traced_memory()[0] - sum(map(sys.getsizeof, first))
    finally:
        tracemalloc.stop()
    assert len(own.known) > 19000 and held < 100 * len(own.known)
    assert own.encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist() == first


def test_components_of_later_links(spark):
    rng = random.Random(4)

    def least(edges):
        up = {}

        def root(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in edges:
            one, two = sorted((root(a), root(b)))
            up[two] = one
        return {x: root(x) for x in up}

    def labels(df):
        rows = [tuple(r) for r in df.select("node", "label").collect()]
        assert len(rows) == len(dict(rows))
        return dict(rows)

    def table(edges):
        return spark.createDataFrame(edges, "a long, b long")

    first = [(rng.randint(-40, 40), rng.randint(-40, 40)) for _ in range(25)]
    second = [(rng.randint(-60, 60), rng.randint(-60, 60)) for _ in range(20)]
    first, second = ([(a, b) for a, b in edges if a != b] for edges in (first, second))
    known = minhash.components(table(first))
    assert labels(known) == least(first)
    assert labels(minhash.joined(table(second), known)) == least(first + second)
    # Links inside components, and none at all, change nothing.
    inside = [(x, y) for x, y in least(first).items() if x != y]
    assert labels(minhash.joined(table(inside), known)) == least(first)
    assert labels(minhash.joined(table([]), known)) == least(first)
    # From no component at all.
    assert labels(minhash.joined(table(second), minhash.components(table([])))) == least(second)


def test_components_of_more_edges_than_a_task_takes(spark, monkeypatch):
    monkeypatch.setattr(minhash, "EDGES", 9)
    test_components_of_later_links(spark)
    chain = [(x + 1, x) for x in range(20)]
    labels = minhash.components(spark.createDataFrame(chain, "a long, b long").repartition(4))
    assert sorted(map(tuple, labels.collect())) == [(x, 0) for x in range(21)]


def test_components_of_a_task():
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (260, 2))] + [(x, 1000) for x in range(1001, 1500)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], ["a", "b"]) for part in (edges[:99], edges[99:])]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(near):
        todo = [] if x in want else [x]
        while todo:
            if (y := todo.pop()) not in want:
                want[y] = x
                todo += near[y]
    (found,) = minhash._forest(iter(batches))
    assert dict(zip(*(found.column(c).to_pylist() for c in ("node", "label")))) == want
    assert list(minhash._forest(iter([]))) == []


def test_rounds_of_suffix_ranks_sort_tied_suffixes_alone(monkeypatch):
    draw = np.random.default_rng(5)
    sorted_at_once = []
    ranked = pfp_substrings._ranked
    monkeypatch.setattr(pfp_substrings, "_ranked", lambda key: sorted_at_once.append(len(key)) or ranked(key))
    for high in (2, 3, 300):
        text = draw.integers(0, high, 400)
        text[draw.integers(0, 400, 9)] = -1
        text[-1] = -1
        sorted_at_once.clear()
        ranks = pfp_substrings.suffix_ranks(text, 50)
        keys = []
        for i in range(400):
            own = text[i : i + 64].tolist()
            keys.append(own[: own.index(-1) + 1] if -1 in own else own)
        places = {tuple(k): i for i, k in enumerate(sorted(keys), 1)}
        first = {k: i - sum(tuple(x) == k for x in keys) + 1 for k, i in places.items()}
        assert ranks.tolist() == [first[tuple(k)] for k in keys]
        assert sorted_at_once[0] == 400 and sum(sorted_at_once[1:]) < 400


def test_hashes_of_all_grams():
    buf = np.random.default_rng(6).integers(0, 256, 300).astype(np.uint8)
    for m in (1, 8, 20, 300):
        first = np.arange(len(buf) - m + 1)
        assert gram_hashes(buf, m).tolist() == segment_hashes(prefix_sums(buf), first, first + m).tolist()


def test_suffix_ranks_of_few_symbols():
    for n in range(1, 10):
        for text in (list(range(n)), [0] * n, [3, -1] * (n // 2) + [5] * (n % 2)):
            keys = [text[i:][: (text[i:] + [-1]).index(-1) + 1] for i in range(n)]
            assert pfp_substrings.suffix_ranks(np.array(text), 50).tolist() == [1 + sum(k < own for k in keys) for own in keys]


def test_an_engine_call_of_one_short_run():
    draw = np.random.default_rng(7)
    for n in [*range(50, 130)] * 2:
        text = draw.integers(97, 123, n).astype(np.uint8)
        assert pfp_substrings.least_documents(text, np.array([0, n]), np.array([5])).tolist() == [5] * (n - 49)


def grouped(tables, key):
    """The rows of several tables by their key, as Spark hands them to a function of groups."""
    whole = pa.concat_tables(tables)
    keys = whole.column(key).to_numpy()
    return {int(k): whole.filter(pa.array(keys == k)) for k in np.unique(keys)}


@pytest.mark.parametrize("crowd, part", [(1 << 14, 1 << 20), (4, 1 << 20), (1 << 14, 400), (4, 400)])
@pytest.mark.parametrize("module, k, m", [(fm_substrings, 13, 5), (pfp_substrings, 50, 20)])
def test_runs_of_crowded_anchors(monkeypatch, module, k, m, crowd, part):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "PART", part)
    rnd = random.Random(k)
    phrase, line = "all of the rights to it are reserved by us", " ".join(f"word{i}" for i in range(30))
    docs = []
    for i in range(60):
        words = [rnd.choice(["so", "on", "many", "x", "other", "texts"]) + rnd.choice("abcde") for _ in range(60)]
        words[40:40], words[20:20], words[5:5] = [phrase], [line] * (i % 4 == 0), [phrase]
        docs.append(" ".join(words))
    docs += [docs[3], docs[4] + " end", "ab " * 300, "ab " * 200, "q" * 900, "q" * 700, "z " * 40, ""]
    rows = [(rnd.randrange(1000), text) for text in docs]
    units = module.word_units if module is fm_substrings else module.byte_units
    sizes = []

    def engine(values, cuts, ids):
        sizes.append(len(values))
        return module.least_documents(values, cuts, ids, k)

    names = {"block": pa.int32(), "row": pa.int64(), "doc_id": pa.int64(), "text": pa.string()}
    blocks = {b: [(b, n, *rows[n]) for n in range(b, len(rows), 4)] for b in range(4)}
    tables = {b: pa.table([pa.array(c, t) for c, t in zip(zip(*r), names.values())], list(names)) for b, r in blocks.items()}
    asked = grouped([repeats._ask(units, k, m, 3)(t) for t in tables.values()], "shard")
    replies = grouped([repeats._reply(t) for t in asked.values()], "block")
    assert any(t.column("crowded").to_pylist() != [b""] * t.num_rows for t in replies.values()) == (crowd == 4)
    sent = grouped([repeats._send(units, k, m, 3)(tables[b], t) for b, t in replies.items()], "shard")
    dtype = np.uint64 if module is fm_substrings else np.uint8
    found = [repeats._solve(engine, k, m, dtype)(t) for t in sent.values()]
    back = grouped(found, "block")
    got = {}
    for b, t in tables.items():
        for place, _, cuts, gone in repeats.marked(t, back.get(b, found[0].slice(0, 0)), units, k, m):
            for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
                got[b + 4 * int(place[i])] = gone[x:y].tolist()
    split = brute.words if module is fm_substrings else str.encode
    assert [got[n] for n in range(len(rows))] == [lost for _, _, lost in brute.gone(rows, split, k)]
    assert max(sizes) <= part
