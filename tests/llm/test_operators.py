"""Every operator on a table with all that can go wrong, on random texts, and on an empty table."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from ledgerweave.llm import arrays, bpe, exact_dedup, fm_substrings, minhash, mixing, pfp_substrings, quality, repeats
from ledgerweave.llm import sharding, token_counts, toxicity
import brute

# Columns that clash with names used inside, and with outputs.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        *(T.StructField(c, T.StringType()) for c in ("node", "block", "size", "kept", "copy", "value", "digest", "_y")),
        *(T.StructField(c, T.StringType()) for c in ("rate", "_stay", "_one", "_id", "_cell", "_h", "_source", "_doc")),
    ]
)


def table(spark, docs):
    rows = [(d, t, f"s{i % 3}" if i % 5 else None, *"abcdefgh", *"ijklmnop") for i, (d, t) in enumerate(docs)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def texts():
    rnd = random.Random(7)
    vocabulary = ["the", "of", "größe", "naïve", "Été", "x", "it's", "中文", "<|endoftext|>", "a-b", "12", "THE"]
    vocabulary += ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 9))) for _ in range(400)]

    def words(n):
        return [rnd.choice(vocabulary) for _ in range(n)]

    def joined(w):
        return "".join(x + rnd.choice([" ", " ", " ", "\n", "  ", "\t"]) for x in w)

    passage, base = words(30), words(120)
    docs = [None, "", " \n\t ", "one", "One", "two words", "a b c", "  spaced   out ", "z" * 3000]
    docs += [joined(words(n)) for n in (5, 13, 14, 40, 60, 200, 9000)]
    for _ in range(14):
        docs.append(joined(words(rnd.randint(0, 30)) + passage + words(rnd.randint(0, 30))))
    for edits in range(14):  # near copies, farther and farther from their base
        near = list(base)
        for _ in range(edits):
            near[rnd.randrange(len(near))] = rnd.choice(vocabulary)
        docs.append(" ".join(near))
    docs += [" ".join(base), "\n".join(base), " ".join(base).upper(), joined(passage) * 4]
    one, two = "a", "b"  # equal under any polynomial hash modulo 2**64
    for _ in range(11):
        one, two = one + two, two + one
    docs += [f"{one}\n{two}", one, two, " ".join(one), " ".join(two)]
    docs += ["Enon " * 400, "Enon " * 300, "line of text here\n" * 30, "ab" * 200]
    ids = list(range(len(docs)))
    rnd.shuffle(ids)
    rows = list(zip(ids, docs))
    rows += [rows[20], rows[20], (None, docs[21]), (None, "one"), (None, None), (rows[12][0], docs[30])]
    return rows


DOCS = texts()


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def expected(rows):
    return sorted(rows, key=repr)


def test_words_without_repeats(spark):
    df = fm_substrings.without_repeats(table(spark, DOCS))
    assert got(df, "doc_id", "n_words", "n_removed", "kept_sha256") == expected(brute.substrings_of_words(DOCS))
    row = df.filter("n_removed > 0 and n_removed < n_words").first()
    assert row.n_removed == sum(b - a for a, b in row.spans)
    assert brute.sha(row.kept_text.encode()) == row.kept_sha256


def test_bytes_without_repeats(spark):
    df = pfp_substrings.without_repeats(table(spark, DOCS))
    want = expected(brute.substrings_of_bytes(DOCS))
    assert got(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    row = df.filter("n_spans > 0").first()
    assert len(row.spans) == row.n_spans and brute.sha(row.kept) == row.kept_sha256


def test_one_short_passage_in_two_documents(spark):
    passage = "abcdefghijklmnopqrstuvwxyz0123456789 and so on, and on"
    rows = [(0, passage), (1, passage)]
    df = pfp_substrings.without_repeats(table(spark, rows))
    want = expected(brute.substrings_of_bytes(rows))
    assert got(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert sum(r[2] for r in want) == len(passage)


def test_shards_number_with_the_bytes_of_text(spark, monkeypatch):
    size = sum(len((text or "").encode()) for _, text in DOCS)
    assert repeats.shards_for(table(spark, DOCS)) == 3 and repeats.shards_for(table(spark, DOCS).limit(0)) == 3
    monkeypatch.setattr(repeats, "SHARE", size // 20)
    assert repeats.shards_for(table(spark, DOCS)) == 21
    df = pfp_substrings.without_repeats(table(spark, DOCS))
    want = expected(brute.substrings_of_bytes(DOCS))
    assert got(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_quality(spark):
    good = [(i, " ".join(f"w{i * 7 + j} ab{j % 9}cd{i}" for j in range(60))) for i in range(100, 130)]
    junk = [(i, " ".join(f"w{i * 7 + j}&&& $$$" for j in range(60))) for i in range(130, 160)]
    docs = DOCS + good + junk
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk] + [(None, 1, 0), (5, None, 0), (9999, 1, 1)]
    known = spark.createDataFrame(labels + labels[:3], "doc_id long, quality int, toxic int")
    df = quality.judged(table(spark, docs), quality.fit(table(spark, docs), known))
    want = expected((d, *brute.statistics(t)) for d, t in docs)
    assert got(df, "doc_id", *quality.BASE, "base_failed") == want
    kept = {r.doc_id: r.kept for r in df.select("doc_id", "kept").collect()}
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i, _ in junk)
    assert "kept" in df.columns and len(set(df.columns)) == len(df.columns)
    # Without labels the base rules decide alone.
    free = quality.judged(table(spark, docs), quality.fit(table(spark, docs), known.limit(0)))
    assert got(free, "doc_id", "kept") == expected((d, not brute.statistics(t)[5]) for d, t in docs)


def test_byte_pairs(spark):
    import tiktoken
    from public_tokenizers import PATTERN

    ranks = bpe.codec(bpe.read_ranks(bpe.default_path())).ids
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = [library.encode_ordinary(t or "") for _, t in DOCS]
    want = expected(
        (d, len(i), hashlib.sha256(struct.pack(f"<{len(i)}I", *i)).hexdigest(), brute.sha((t or "").encode()))
        for (d, t), i in zip(DOCS, ids)
    )
    assert got(bpe.round_trip(table(spark, DOCS)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    back = bpe.decoded(bpe.encoded(table(spark, DOCS)))
    rows = back.select("doc_id", "text", "decoded", "n_tokens", "node").collect()
    assert len(rows) == len(DOCS) and all(r.decoded == bytearray((r.text or "").encode()) for r in rows)


def test_shards(spark):
    docs = DOCS + [(1000 + i, "copy of one text") for i in range(150)]
    df = sharding.sharded(table(spark, docs), shards=5).drop("node")
    rows = df.select("doc_id", "text", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert len(rows) == len(docs)
    assert all(r.size == len((r.text or "").encode()) + 8 for r in rows)
    assert all(r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in rows)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    whole = sum(r.size for r in rows)
    largest = max(r.size for r in rows)
    for shard in range(5):
        own = [r for r in rows if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - whole / 5) <= 2 * largest
    # Equal texts stand together: their shards follow one another.
    shards = sorted({r.shard for r in rows if r.text == "copy of one text"})
    assert shards == list(range(shards[0], shards[-1] + 1))


def test_even_shards_where_rows_are_small(spark):
    docs = [(i, "t" if i % 3 else f"{i:08d}") for i in range(6000)]
    sizes = {}
    for r in sharding.sharded(table(spark, docs), shards=6).groupBy("shard").agg({"size": "sum"}).collect():
        sizes[r[0]] = r[1]
    assert set(sizes) == set(range(6)) and max(sizes.values()) - min(sizes.values()) < 200


def test_toxicity(spark):
    rnd = random.Random(3)
    clean = ["".join(rnd.choice(["an", "er", "th", "in", "re", "on"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]

    def text(bad):
        words = [rnd.choice(clean) for _ in range(40)]
        if bad:
            words[rnd.randrange(40)] = rnd.choice(["blockhead", "dumblug", "gobsquat"])
        return " ".join(words) + "."

    docs = DOCS + [(1000 + i, text(i % 4 == 0)) for i in range(600)]
    labels = spark.createDataFrame(
        [(1000 + i, 0, int(i % 4 == 0)) for i in range(600)] + [(None, 1, 1), (3, 1, None), (77777, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    machine = toxicity.fit(table(spark, docs), labels)
    df = toxicity.scored(table(spark, docs), machine)
    score = {r.doc_id: r.score for r in df.filter("doc_id >= 1000").select("doc_id", "score").collect()}
    held = [i for i in range(600) if brute.is_held_out(1000 + i)]
    assert len(held) > 100 and all((score[1000 + i] >= toxicity.CUT) == (i % 4 == 0) for i in held)
    assert df.count() == len(docs) and df.filter("score is null or score < 0 or score > 1").count() == 0
    spelled = ["a b.l.o.c.k.h.e.a.d here", "what a dumb*lug", "g o b s q u a t", "re dummblug on", "an inner there"]
    asked = toxicity.scored(spark.createDataFrame(list(enumerate(spelled)), "doc_id long, text string"), machine)
    said = [r.score >= toxicity.CUT for r in asked.orderBy("doc_id").collect()]
    assert said == [True, True, True, True, False]
    rest = toxicity.without_toxic(table(spark, docs), machine)
    assert rest.columns == SCHEMA.names and rest.filter("doc_id >= 1000").count() == 450
    one_kind = toxicity.fit(table(spark, docs), labels.filter("toxic = 0"))
    assert toxicity.scored(table(spark, docs), one_kind).filter("score <> 0").count() == 0


def test_toxicity_never_learns_from_held_out_labels(spark):
    docs = [(i, f"word{i} blockhead" if i % 2 else f"word{i}") for i in range(400)]
    rows = [(i, 0, i % 2) for i, _ in docs if brute.is_held_out(i)]
    machine = toxicity.fit(table(spark, docs), spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
    assert isinstance(machine, toxicity.Constant)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_path())


def counts(library, docs):
    return expected(
        (d, len((t or "").encode()), n, n > 512)
        for (d, t), n in zip(docs, [len(library.encode(t or "", add_special_tokens=False)) for _, t in docs])
    )


def test_token_counts_and_cache(spark, library, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    want = counts(library, DOCS)
    assert got(token_counts.counted(table(spark, DOCS), cache), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in DOCS})
    # Known texts are not encoded again; new ones are appended.
    sent = []
    real = token_counts.encode_counts
    monkeypatch.setattr(token_counts, "encode_counts", lambda df, *a: sent.append(df.count()) or real(df, *a))
    more = DOCS[:10] + [(500, "something new"), (501, "something new")]
    assert got(token_counts.counted(table(spark, more), cache), "doc_id", "n_bytes", "n_tokens", "over_limit") == counts(
        library, more
    )
    assert sent == [1] and spark.read.parquet(cache).count() == stored.count() + 1
    # Another tokenizer's counts do not mix in.
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    other = token_counts.counted(table(spark, more), cache, path)
    assert got(other, "doc_id", "n_tokens") == expected((d, len(pieces.encode(t or ""))) for d, t in more)


def test_exact_copies(spark):
    df = exact_dedup.exact_groups(table(spark, DOCS)).selectExpr(
        "doc_id", "keep_id", "group_size", "kept", "lower(hex(digest)) AS sha"
    )
    assert got(df, *df.columns) == expected(brute.exact(DOCS))
    kept = exact_dedup.deduplicated(table(spark, DOCS))
    assert kept.columns == SCHEMA.names
    want = {(d, t) for (d, t), r in zip(DOCS, brute.exact(DOCS)) if r[3]}
    assert {(r.doc_id, r.text) for r in kept.collect()} == want


def test_near_copies(spark):
    df = minhash.near_duplicates(table(spark, DOCS))
    assert got(df, "doc_id", "n_shingles", "component_id", "kept") == expected(brute.near(DOCS))
    kept = minhash.deduplicated(table(spark, DOCS))
    assert kept.columns == SCHEMA.names and kept.count() == sum(r[3] for r in brute.near(DOCS))


def crowd(seed, size=90):
    """Near copies of one text, some linked, some only close, so that their lists are crowded."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
    docs = []
    for i in range(size):
        text = list(base)
        for _ in range(rnd.choice([0, 2, 5, 8, 9, 12, 16])):
            text[rnd.randrange(len(text))] = f"v{rnd.randrange(10**6)}"
        docs.append((i, " ".join(text[: rnd.choice([150, 150, 130])])))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_crowded_lists_lose_no_link(spark, seed, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 8)
    docs = crowd(seed)
    df = minhash.near_duplicates(table(spark, docs))
    assert got(df, "doc_id", "n_shingles", "component_id", "kept") == expected(brute.near(docs))


def test_near_copies_take_few_tasks(spark):
    """Small steps count by their tasks: these take disk and the driver's memory, whatever the rows."""
    context = spark.sparkContext
    context.setJobGroup("near", "near copies")
    try:
        assert minhash.near_duplicates(table(spark, crowd(1, 70))).count() == 70
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            context.setLocalProperty(name, None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("near") for s in tracker.getJobInfo(j).stageIds}
    assert 0 < sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i) < 180


SAME = [
    *[(1, "one two three")] * 3,  # rows in full
    (1, "one  two three"),  # one doc_id, more code points
    (1, " one two three"),
    *[(None, "no name here")] * 2,
    (None, "no  name here"),
    (2, "alone it is"),
    *[(3, None), (3, ""), (None, " "), (None, None)],
]


def test_one_row_of_each_group_of_copies(spark):
    kept = exact_dedup.deduplicated(table(spark, SAME))
    assert kept.columns == SCHEMA.names
    rows = [(r.doc_id, (r.text or "").split()) for r in kept.collect()]
    want = [(1, ["one", "two", "three"]), (None, ["no", "name", "here"]), (2, ["alone", "it", "is"]), (None, [])]
    assert sorted(map(str, rows)) == sorted(map(str, want))
    again = exact_dedup.deduplicated(table(spark, SAME).repartition(5))
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect()))


def test_one_row_of_each_component(spark):
    kept = minhash.one_of_each_component(table(spark, SAME))
    assert kept.columns == SCHEMA.names
    rows = [(r.doc_id, (r.text or "").split()) for r in kept.collect()]
    # Texts without shingles are linked with nothing.
    want = [(1, ["one", "two", "three"]), (None, ["no", "name", "here"]), (2, ["alone", "it", "is"]), *[(3, [])] * 2, *[(None, [])] * 2]
    assert sorted(map(str, rows)) == sorted(map(str, want))


def test_pipeline_stages_leave_no_copies(spark):
    import corpus_pipeline

    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        texts = [" ".join(r.text.split()) for r in stage(spark, table(spark, SAME), "").collect() if (r.text or "").strip()]
        assert sorted(texts) == ["alone it is", "no name here", "one two three"]


@pytest.mark.parametrize("seed", [1844, 2499])
def test_cut_copies_are_linked(spark, seed):
    """The cut text's sketch shares 86 and 87 values with the whole's, and the rest with none."""
    rnd = random.Random(seed)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(2001)]
    docs = [(0, " ".join(words)), (1, " ".join(words[:1601]))]
    df = minhash.near_duplicates(table(spark, docs))
    assert got(df, "doc_id", "n_shingles", "component_id", "kept") == expected(brute.near(docs))
    assert [r.component_id for r in df.collect()] == [0, 0]


def test_mixing(spark):
    docs = [(i, "x" * 99) for i in range(3000)]
    rows = spark.createDataFrame([(i, t, "a" if i % 3 else "b", i) for i, t in docs], "doc_id long, text string, source string, copy int")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    df = mixing.mixed(rows, weights)
    n = {r.source: r["count"] for r in df.groupBy("source").count().collect()}
    assert abs(n["a"] - 750) < 110 and abs(n["b"] - 2250) < 190  # four deviations
    assert df.filter("copy > copies or copy < 1").count() == 0
    assert got(df, "doc_id", "copy", "order_key") == got(mixing.mixed(rows.repartition(7), weights), "doc_id", "copy", "order_key")
    heavy = mixing.mixed(rows.limit(40), epochs=500.0).groupBy("doc_id").count().collect()
    assert len(heavy) == 40 and abs(sum(r["count"] for r in heavy) / 40 - 500) < 40
    edge = mixing.mixed(table(spark, DOCS))
    assert edge.filter("source is null").count() > 0 and set(SCHEMA.names) < set(edge.columns)
    assert mixing.mixed(rows, weights.filter("source = 'a'")).filter("source = 'b'").count() == 0


def test_copies_follow_the_distribution(spark):
    table_ = spark.createDataFrame([("a", 0.7), ("b", 3.0), ("c", 130.0)], "_source string, rate double")
    import math

    for r in mixing.with_distribution(table_).collect():
        mean = r.rate / r._parts
        want = [sum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(n + 1)) for n in range(20)]
        assert all(abs(a - b) < 1e-12 for a, b in zip(r._cdf, want))


def test_empty_tables(spark):
    none = table(spark, DOCS[:1]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        fm_substrings.without_repeats(none),
        pfp_substrings.without_repeats(none),
        quality.judged(none, quality.fit(none, labels)),
        bpe.round_trip(none),
        bpe.decoded(bpe.encoded(none)),
        sharding.sharded(none),
        toxicity.scored(none, toxicity.fit(none, labels)),
        token_counts.counted(none),
        exact_dedup.exact_groups(none),
        minhash.near_duplicates(none),
        mixing.mixed(none),
    ):
        assert df.collect() == []


def test_workers_give_back_what_a_stage_freed(spark):
    def idle(batches):
        """MB that the allocator of this worker holds without use; they are given back."""
        import ctypes
        import re
        import time

        import pyarrow as pa

        def held():
            with open("/proc/self/smaps_rollup") as file:
                return int(re.search(r"\nAnonymous:\s+(\d+)", file.read())[1]) / 1024

        for _ in batches:
            pass
        before = held()
        ctypes.CDLL("libc.so.6").malloc_trim(0)
        time.sleep(0.5)  # tasks beside this one get workers of their own
        yield pa.RecordBatch.from_pydict({"mb": [before - held()]})

    def most():
        return max(r.mb for r in spark.range(0, 8, 1, 8).mapInArrow(idle, "mb double").collect())

    rnd = random.Random(5)
    lines = [(i, " ".join(f"{rnd.getrandbits(rnd.choice((8, 16, 24))):x}" for _ in range(400))) for i in range(2500)]
    documents = table(spark, lines).coalesce(1)
    most()
    machine = toxicity.Machine(toxicity.Alphabet("abcdef"), np.ones(toxicity.LETTERS**3), 0.0)
    for df in (bpe.round_trip(documents), toxicity.scored(documents, machine), minhash.sets(documents)):
        df.write.format("noop").mode("overwrite").save()
        assert most() < 20


def test_workers_forget_the_codec_when_another_operator_follows(spark):
    def codecs(batches):
        import gc
        import time

        import pyarrow as pa

        for _ in batches:
            pass
        time.sleep(0.5)  # tasks beside this one get workers of their own
        held = sum((type(x).__module__, type(x).__name__) == ("ledgerweave.llm.bpe", "Codec") for x in gc.get_objects())
        yield pa.RecordBatch.from_pydict({"held": [held]})

    def most(run):
        return max(r.held for r in spark.range(0, 8, 1, 8).mapInArrow(run, "held long").collect())

    bpe.round_trip(table(spark, DOCS).repartition(16)).collect()
    assert most(codecs) == 1
    assert most(arrays.lean(codecs, "bpe")) == 1
    assert most(arrays.lean(codecs)) == 0
    assert most(codecs) == 0


def test_exact_dedup_runs_no_stage_twice(spark, monkeypatch):
    # An eager checkpoint runs a stage for its rows and once more for their files.
    def refused(self, eager=True):
        raise AssertionError("a checkpoint")

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", refused)
    assert exact_dedup.exact_groups(table(spark, DOCS)).count() == len(DOCS)
    assert exact_dedup.deduplicated(table(spark, DOCS)).count() == len({r[4] for r in brute.exact(DOCS)})
