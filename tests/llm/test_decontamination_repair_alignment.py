"""Decontamination, conversation repair and token alignment: plain versions, edges, hot keys."""

import os
import random

import brute
import pytest
from pyspark.sql import functions as F

from ledgerweave.llm import alignment, conversations, winnowing
from ledgerweave.llm.queries import QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def expected(rows):
    return sorted(rows, key=repr)


# -- Decontamination ---------------------------------------------------------------


def some_texts():
    rnd = random.Random(5)
    vocabulary = ["the", "of", "größe", "Été", "THE", "x", "中文", "12", "a-b", "it's"] + [f"w{i}" for i in range(60)]

    def words(n):
        return [rnd.choice(vocabulary) for _ in range(n)]

    phrase = words(12)
    items = [(i, " ".join(words(rnd.randint(10, 60)))) for i in range(12)]
    items += [(i, " ".join(words(3)) + " " + " ".join(phrase)) for i in range(12, 30)]  # share a phrase
    items += [(30, None), (31, ""), (32, "...!"), (33, "One"), (34, "two Words"), (35, " ".join(words(9)))]
    items += [(None, " ".join(words(20))), (3, "a second text of item three that is long enough to count here")]
    items += [(40, "again " * 30), (41, items[2][1].upper())]
    docs = [None, "", " \n ", "one", "two words", "?!", "z" * 5000, "again " * 500, "y" * 300 + " " + "é" * 200]
    for item, text in items:
        w = (text or "").split()
        docs.append("\n".join(words(5) + w + words(7)))
        docs.append(" ,".join(w[:9] + words(2)))  # a word short of a window
        docs.append(" -- ".join(words(3) + w[len(w) // 3 :]).title())
    docs.append(" ".join(words(9000)) + " " + items[4][1])
    rows = list(enumerate(docs))
    return rows + [rows[20], (None, docs[21]), (None, docs[25]), (20, docs[22]), (None, None)], items


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ("digest", "items", "spans", "n_words", "high", "print")
    return df.withColumns({c: F.lit(c) for c in clash}).repartition(3)


def benchmark(spark, items):
    df = spark.createDataFrame(items, "item_id long, text string")
    return df.withColumns({c: F.lit(c) for c in ("doc_id", "size", "items", "low")}).repartition(2)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("block", [1_000_000, 100])
def test_windows_of_items_are_found(spark, block):
    docs, items = some_texts()
    found = winnowing.contaminated(documents(spark, docs), benchmark(spark, items), block=block)
    assert got(winnowing.digests(found), *COLUMNS) == expected(brute.contaminated(docs, items))
    assert found.filter("size(items) = 0 and size(spans) > 0").count() == 0


def test_windows_of_other_sizes(spark):
    docs, items = some_texts()
    found = winnowing.contaminated(documents(spark, docs), benchmark(spark, items), window=6, gram=3)
    assert got(winnowing.digests(found), *COLUMNS) == expected(brute.contaminated(docs, items, 6))


def test_texts_that_collide_under_a_polynomial_are_told_apart(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    docs, items = [(1, a), (2, b)], [(1, b)]
    found = winnowing.digests(winnowing.contaminated(documents(spark, docs), benchmark(spark, items)))
    assert got(found, "doc_id", "contaminated") == [(1, False), (2, True)]


def test_nothing_to_decontaminate(spark):
    docs, items = some_texts()
    none = winnowing.contaminated(documents(spark, docs[:5]), benchmark(spark, items).limit(0))
    assert got(winnowing.digests(none), "doc_id", "n_hit") == [(i, 0) for i in range(5)]
    empty = winnowing.contaminated(documents(spark, docs).limit(0), benchmark(spark, items))
    assert winnowing.digests(empty).count() == 0


# -- Conversation repair --------------------------------------------------------------


REPAIR = (
    "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256",
)


def some_conversations():
    rnd = random.Random(11)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", " "]
    texts = ["Yes.", "No!", "Why?", "and so", "", " \n", None, "Well. ", "é", "ok. ", "a\nb."]
    rows = []
    for conv in range(150):
        for turn in range(rnd.randint(1, 12)):
            role = ("user", "assistant")[turn % 2] if rnd.random() < 0.6 else rnd.choice(roles)
            text = f"Text {rnd.random()}." if rnd.random() < 0.5 else rnd.choice(texts)
            rows.append((conv, rnd.choice([turn, turn, turn, turn * 3, None]), role, text))
    rows += [(None, t, "user", "Same.") for t in range(5)] + [rows[3]] * 4 + [(7, 2, None, None)] * 3
    for turn in range(2500):  # one conversation with a third of all rows and more
        rows.append((1000, turn, rnd.choice(["user", "assistant"]), f"T {turn}."))
    rows += [(1001, t, "user", "Again and again.") for t in range(700)]  # copies of one row
    rows += [(1002, t, "user", f"{t}?") for t in range(701)]  # only users: vectors never agree
    rows += [(1003, 5, "user", "One turn.")] * 300
    return rows


def conversation_table(spark, rows, parts):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit(c) for c in ("part", "copies", "order", "first")}).repartition(parts)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_conversations_are_repaired(spark, parts):
    rows = some_conversations()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = conversations.repaired(conversations.damaged(conversation_table(spark, rows, 3)))
        assert got(found, *REPAIR) == expected(brute.repaired(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_no_conversations(spark):
    none = conversation_table(spark, [(1, 1, "user", "a")], 1).limit(0)
    assert conversations.repaired(conversations.damaged(none)).count() == 0


def test_repair_of_the_table(spark):
    table = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op12_viterbi_conversation_repair"](spark, FOLDER), *REPAIR) == expected(brute.repaired(rows))


def test_speculative_chunks_give_the_vectors_of_one_run():
    rnd = random.Random(3)
    steps = conversations.Steps()
    for weights in ([1] * 16, [0, 1] + [0] * 14, [1, 1] + [0] * 14, [0] * 8 + [1] * 8):
        codes = bytes(rnd.choices(range(16), weights, k=rnd.randint(20, 400)))
        behind = conversations.plain(conversations.END)[0]
        vectors, first, _ = steps.run(codes, behind)
        cut = sorted(rnd.sample(range(len(codes)), 3))
        for a, b in zip([0, *cut], [*cut, len(codes)]):
            true = vectors[b - 1] if b else behind
            want = vectors[a - 1] if a else first
            if a < b:
                assert conversations.through(steps.matrix(codes[a:b]), true) == want


# -- Token alignment -------------------------------------------------------------------


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def odd_texts():
    rnd = random.Random(2)
    alphabet = "abcdeé ß中文😀\n\t\u2581.,'0123  "
    texts = [None, "", " ", "a", "<|endoftext|> and <s>", "z" * 4000, "zé" * 900, "\u2581", "a\u00a0b", "e\u0301", "ﬁ"]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 300))) for _ in range(80)]
    texts += ["The quick brown fox isn't here. " * 20] * 7 + ["Straße über naïve Ägäis " * 50, "中文" * 700]
    rows = list(enumerate(texts))
    return rows + [rows[4], (None, texts[4]), (None, None), (5, "another text")]


@pytest.mark.parametrize("block", [2_000_000, 300])
def test_tokens_are_aligned(spark, block):
    rows = odd_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({c: F.lit(c) for c in ("pairs", "n_best", "times")}).repartition(3)
    assert got(alignment.cross_aligned(df, block=block), *ALIGNED) == expected(brute.aligned(rows))
    assert alignment.cross_aligned(df.limit(0)).count() == 0


def test_alignment_of_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op13_diagonal_alignment"](spark, FOLDER), *ALIGNED) == expected(brute.aligned(docs))


def test_groups_of_any_two_cuts():
    rnd = random.Random(9)
    for _ in range(300):
        n = rnd.randint(1, 300)
        shared = {e for e in range(1, n) if rnd.random() < rnd.choice([0.0, 0.5, 0.98])} | {n}
        a, b = (sorted(shared | {e for e in range(1, n) if rnd.random() < rnd.choice([0, 0.1])}) for _ in range(2))
        both = sorted(set(a) & set(b))
        until_a, until_b = alignment.diagonal_groups(a, b)
        assert until_a.tolist() == [a.index(e) + 1 for e in both]
        assert until_b.tolist() == [b.index(e) + 1 for e in both]


def test_wide_groups_are_counted_by_distinct_ids(spark, monkeypatch):
    texts = [t for _, t in odd_texts()]
    own = alignment.aligner(*[alignment._read(p) for p in alignment.default_paths()])
    want = own.aligned(texts)
    monkeypatch.setattr(alignment, "WIDE", 1)
    assert own.aligned(texts) == want
