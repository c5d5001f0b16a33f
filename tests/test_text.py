import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerweave.functions import text as t


def value(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], ", ".join(
        f"{name} {'array<string>' if isinstance(v, list) else 'string'}" for name, v in given.items()
    ))
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "raw, plain",
    [
        ("write_off_flag", "write off flag"),
        ("write-off  flag", "write off flag"),
        ("IFRS/stage-3_impaired", "ifrs stage 3 impaired"),
        ("  a\u00a0\u2003b\x1cc\n", "a b c"),
        ("__--//", ""),
        (None, ""),
    ],
)
def test_normalize(spark, raw, plain):
    assert value(spark, t.normalize(F.col("s")), s=raw) == plain


@pytest.mark.parametrize(
    "answer, signals, missing",
    [
        ("There are 15 loans with the write-off flag set.", ["write_off_flag", "loan"], []),
        ("The BORROWER has annual_income > 100000", ["borrower", "annual_income"], []),
        ("only borrower", ["borrower", "collateral", "Loan", "collateral"],
         ["collateral", "Loan", "collateral"]),
        ("anything", [], []),
        (None, ["x"], ["x"]),
    ],
)
def test_signals(spark, answer, signals, missing):
    prepared = t.prepared_signals(F.col("w"))
    given = {"a": answer, "w": signals}
    assert value(spark, t.missing_signals(F.col("a"), prepared), **given) == missing
    matched = [s for s in signals if s not in missing]
    halves = value(spark, t.split_signals(F.col("a"), prepared), **given)
    assert (halves.matched, halves.missing) == (matched, missing)
    assert value(spark, t.signals_met(F.col("a"), F.col("w")), **given) is (not missing)
    verdict = value(spark, t.signal_verdict(F.col("a"), F.col("w")), **given)
    assert verdict is (None if not signals else not missing)


@pytest.mark.parametrize(
    "text, found",
    [
        ("2024-01-05", [2024.0, -1.0, -5.0]),
        ("1e3", [1.0, 3.0]),
        ("$535,587,727.72 and -$3.50, 7.", [535587727.72, -3.5, 7.0]),
        ("1,,2 .5 $", [12.0, 5.0]),
        ("٣٤ or 1٫5", [34.0, 1.0, 5.0]),
        ("none", []),
        (None, []),
    ],
)
def test_numbers(spark, text, found):
    assert value(spark, t.numbers(F.col("s")), s=text) == found


@pytest.mark.parametrize(
    "text, gold, pct, near",
    [
        ("The NPE ratio is 17.52%.", 17.52, 2.0, True),
        ("The NPE ratio is 16.13%.", 17.52, 2.0, False),
        ("Total EAD is $535,587,727.72.", 535587727.72, 1.0, True),
        ("Total EAD is $546,085,518.10.", 535587727.72, 1.0, False),
        ("cannot be computed", 17.52, 2.0, False),
        ("0.4", 0.0, 0.5, True),
        ("0.6", 0.0, 0.5, False),
        ("-101", -100.0, 1.0, True),
    ],
)
def test_near_gold(spark, text, gold, pct, near):
    assert value(spark, t.near_gold(F.col("s"), F.lit(gold), F.lit(pct)), s=text) is near


@pytest.mark.parametrize(
    "given, said",
    [
        ((True, None, None), "yes"),
        ((False, "yes", None), "no"),
        ((None, " TRUE ", None), "yes"),
        (("", "maybe", "Unclear"), "unclear"),
        ((None, 1, None), "yes"),
        ((0, "yes", None), "no"),
        ((None, None, None), ""),
    ],
)
def test_verdict(spark, given, said):
    columns = [F.lit(g) if g is not None else F.lit(None).cast("string") for g in given]
    assert value(spark, t.verdict(*columns), s="") == said


@pytest.mark.parametrize(
    "text, said",
    [
        ("__critic_verdict__=yes\nanswer", "yes"),
        ("so __critic_verdict__= No \r\nx", "no"),
        ("__critic_verdict__=unclear", "unclear"),
        ("__critic_verdict__=maybe\n", None),
        ("__critic_verdict__=\nyes", None),
        ("__critic_verdict__=no\n__critic_verdict__=yes", "no"),
        ("none", None),
        (None, None),
    ],
)
def test_marked_verdict(spark, text, said):
    assert value(spark, t.marked_verdict(F.col("s")), s=text) == said


@pytest.mark.parametrize(
    "text, known, names",
    [
        ("SELECT * FROM p_loan l JOIN p_borrower b", ["p_loan", "p_borrower", "p_collateral"],
         ["p_borrower", "p_loan"]),
        ("from lake.dbo.Loan join x.", [], ["", "Loan"]),
        ("the LOAN table, not loans or my_loan", ["loan", "Loan"], ["Loan", "loan"]),
        ("éfrom a, uberjoin b", [], []),
        ("a.b and a.b.c", ["a.b", "b.c", "loan"], ["a.b", "b.c"]),
        ("", ["x"], []),
    ],
)
def test_mentioned_tables(spark, text, known, names):
    assert value(spark, t.mentioned_tables(F.col("s"), known), s=text) == names


def test_mentioned_relationships(spark):
    text = "(l:Loan)-[:`has_borrower`]->(b) -[ :x ]- [r:hidden] and knows, Likes"
    found = value(spark, t.mentioned_relationships(F.col("s"), ["knows", "likes", "x"]), s=text)
    assert found == ["has_borrower", "knows", "x"]


def test_hints(spark):
    ask = "This is ambiguous, could you CLARIFY?"
    assert value(spark, t.has_hint(F.col("s"), t.AMBIGUITY_HINTS), s=ask) is True
    assert value(spark, t.has_hint(F.col("s"), t.AMBIGUITY_HINTS), s="clear") is False
    for text, policy in [
        ("I recommend collecting the papers.", "recommend_only"),
        ("I recommend it and I will start.", "execute"),
        ("Nothing to say.", "execute"),
        (None, "execute"),
    ]:
        assert value(spark, t.action_policy(F.col("s")), s=text) == policy


def test_scanned_text(spark):
    given = {"a": "x", "b": "", "c": None, "d": "y"}
    assert value(spark, t.scanned_text(*map(F.col, given)), **given) == "x\ny"


def test_printing(spark):
    for raw, shown in [("a", "'a'"), ("it's", '"it\'s"'), ("'\"", "'\\'\"'"), ("\\", "'\\\\'")]:
        assert raw.__repr__() == shown
        assert value(spark, t.quoted(F.col("s")), s=raw) == shown
    assert value(spark, t.quoted_list(F.col("w")), w=["a", "b"]) == "['a', 'b']"
    for number in (535587727.72, 2.0, 17.52, 0.5, 0.0, 100.0, 123456789012.25):
        assert value(spark, t.plain_number(F.lit(number)), s="") == repr(number)


def test_message_text(spark):
    parts = F.array(
        F.struct(F.lit("text").alias("type"), F.lit("a").alias("value")),
        F.struct(F.lit("image").alias("type"), F.lit("i").alias("value")),
        F.struct(F.lit("text").alias("type"), F.lit("b").alias("value")),
    )
    assert value(spark, t.message_text(parts), s="") == "a\nb"


def test_texts_stay_in_the_engine(spark):
    """No Python worker in the plan, and a text is normalised once however many
    signals there are."""
    df = spark.createDataFrame([("a", ["x"])], "s string, w array<string>")
    plan = df.select(
        t.missing_signals(F.col("s"), t.prepared_signals(F.col("w"))),
        t.numbers(F.col("s")),
        t.mentioned_tables(F.col("s"), ["a", "b"]),
    )._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_same_as_python_on_random_texts(spark):
    """Blanks, digits and words of many scripts, against Python's own idea of them."""
    draw = random.Random(5)
    bits = list("aZé_ßЖ-/.,$019٣𝟏 \t\n\x0b\x1c\x85\xa0\u2003\u2028\u3000\u200b[]:`") + [
        "from ", "JOIN\t", " join", "xfrom ", "loan", "Loan", "my_loan", "[:has_x]", "[ :`y` ]", "[r:z]",
    ]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(25))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    s = F.col("s")
    found = df.select(
        "i",
        t.normalize(s).alias("plain"),
        t.stripped(s).alias("bare"),
        t.numbers(s).alias("numbers"),
        t.mentioned_tables(s, ["loan"]).alias("tables"),
        t.mentioned_relationships(s, ["loan"]).alias("relations"),
    ).collect()
    for row in found:
        text = texts[row.i]
        assert row.bare == text.strip()
        assert row.plain == " ".join(re.split(r"[\s_/-]+", text.lower())).strip()
        tokens = re.findall(r"-?\$?\d[\d,]*(?:\.\d+)?", text)
        assert row.numbers == [float(re.sub("[,$]", "", n)) for n in tokens]
        names = {n.split(".")[-1] for n in re.findall(r"\b(?:from|join)\s+([a-z0-9_.]+)", text, re.I)}
        names |= {"loan"} if re.search(r"\bloan\b", text, re.I) else set()
        assert row.tables == sorted(names), text
        links = set(re.findall(r"\[\s*:`?([a-zA-Z_][a-zA-Z0-9_]*)`?\s*\]", text))
        links |= {"loan"} if re.search(r"\bloan\b", text) else set()
        assert row.relations == sorted(links), text
