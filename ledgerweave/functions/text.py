"""Features of free-text answers, as built-in expressions over whole texts."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hint words, marker and patterns that decide the verdicts.
AMBIGUITY_HINTS = (
    "ambigu",
    "clarif",
    "unclear",
    "could mean",
    "two interpretations",
    "which definition",
    "please specify",
    "depends on which",
)
RECOMMEND_HINTS = (
    "recommend",
    "you may want to",
    "consider ",
    "suggest",
    "the option",
    "the options",
    "decision is yours",
)
EXECUTE_HINTS = ("i will ", "i've ", "i have ", "executed", "initiated", "started the")
VERDICT_MARKER = "__critic_verdict__="
VERDICTS = ("yes", "no", "unclear")
POSITIVE_VERDICTS = ("yes", "true", "1")
NEGATIVE_VERDICTS = ("no", "false", "0")
EMPTY_ANSWER = "<empty>"

# Every blank there is, spelled out: the shorthand with the Unicode flag is slow. The
# range around the rare ones lets a letter be told from a blank in one comparison.
RARE_BLANKS = (
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
)
OTHER_BLANKS = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0" + RARE_BLANKS
BLANK = f"[ {OTHER_BLANKS}]"
# A run of separators and blanks, unless it is a single space already.
SEPARATORS = r"_\-/"
FOLDABLE = f"[ {SEPARATORS}{OTHER_BLANKS}]"
FOLDED = f"[{SEPARATORS}{OTHER_BLANKS}]{FOLDABLE}*| {FOLDABLE}+"
LINE_END = r"\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}"
NUMBER = r"-?\$?\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?"
# A whole word has no letter, digit or underscore next to it. The digit from beyond the
# basic plane makes Java look back by whole characters, not by halves of a pair.
WORD_CHAR = r"[\p{L}\p{N}_" + chr(0x1D7CF) + "]"
# FROM or JOIN in any case, then looking back whether a word starts there; then a
# name, of which the last dotted part counts. Names are ASCII letters in any case
# (four other letters fold to those).
NAME_CHAR = r"a-zA-Z0-9_\x{130}\x{131}\x{17f}\x{212a}"
TABLE_AFTER = (
    r"[fFjJ](?:(?<=[fF])[rR][oO][mM]|(?<=[jJ])[oO][iI][nN])(?<!"
    + WORD_CHAR
    + r".{4})"
    + BLANK
    + f"+(?=[{NAME_CHAR}.])(?:[{NAME_CHAR}.]*[.])?([{NAME_CHAR}]*)"
)
RELATIONSHIP = r"\[" + BLANK + r"*:`?([a-zA-Z_][a-zA-Z0-9_]*)`?" + BLANK + r"*\]"
BLANK_CHARS = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E),
        *range(0x1C, 0x21),
        0x85,
        0xA0,
        0x1680,
        *range(0x2000, 0x200B),
        0x2028,
        0x2029,
        0x202F,
        0x205F,
        0x3000,
    )
)

# Decimal digits of other scripts, by the Unicode rule, to their ASCII twins.
_OTHER_DIGITS = [
    chr(c)
    for c in range(128, sys.maxunicode + 1)
    if unicodedata.category(chr(c)) == "Nd"
]
_ASCII_TWINS = "".join(str(unicodedata.decimal(c)) for c in _OTHER_DIGITS)
_OTHER_DIGITS = "".join(_OTHER_DIGITS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row, also inside lambdas."""
    return F.transform(F.array(value), body).getItem(0)


def stripped(text: Column) -> Column:
    """The text without blanks of any kind around it.

    Nearly every text is done once the plain spaces are off; only those that then
    begin or end with something else than a visible ASCII character go on.
    """
    bare = F.trim(text)
    done = F.left(bare, F.lit(1)).between("!", "~") & F.right(bare, F.lit(1)).between("!", "~")
    return F.when(done, bare).otherwise(F.btrim(text, F.lit(BLANK_CHARS)))


def normalize(text: Column) -> Column:
    """Lower case; separators and blank runs become one space; NULL is ''."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(lowered, FOLDED, " "))


def prepared_signals(signals: Column) -> Column:
    """array<struct<raw, norm>>: the signals, normalised once ahead of any answer."""
    return F.transform(signals, lambda s: F.struct(s.alias("raw"), normalize(s).alias("norm")))


def split_signals(answer: Column, prepared: Column) -> Column:
    """struct(matched, missing): the signals that do and do not occur, in input order."""

    def raw(signals: Column) -> Column:
        return F.transform(signals, lambda s: s["raw"])

    def halves(text: Column) -> Column:
        return F.struct(
            raw(F.filter(prepared, lambda s: F.contains(text, s["norm"]))).alias("matched"),
            raw(F.filter(prepared, lambda s: ~F.contains(text, s["norm"]))).alias("missing"),
        )

    return let(normalize(answer), halves)


def missing_signals(answer: Column, prepared: Column) -> Column:
    """The signals that do not occur in the answer, in input order."""

    def absent(text: Column) -> Column:
        return F.filter(prepared, lambda s: ~F.contains(text, s["norm"]))

    return F.transform(let(normalize(answer), absent), lambda s: s["raw"])


def signals_met(answer: Column, signals: Column) -> Column:
    """All signals present; true when none are asked for."""
    return F.size(missing_signals(answer, prepared_signals(signals))) == 0


def signal_verdict(answer: Column, signals: Column) -> Column:
    """All signals present; NULL (not applicable) when none are asked for."""
    return F.when(F.size(F.coalesce(signals, F.array())) > 0, signals_met(answer, signals))


def numbers(text: Column) -> Column:
    """Every number-like token of the text as a double, in order."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))

    def value(token: Column) -> Column:
        plain = F.translate(F.regexp_replace(token, "[$,]", ""), _OTHER_DIGITS, _ASCII_TWINS)
        return plain.try_cast("double")

    return F.filter(F.transform(tokens, value), lambda n: n.isNotNull())


def near_gold(text: Column, gold: Column, tolerance_pct: Column) -> Column:
    """Some number of the text lies within the tolerance of the gold value."""
    reach = F.when(gold == 0, F.abs(tolerance_pct)).otherwise(
        F.abs(gold) * (tolerance_pct / F.lit(100.0))
    )
    return F.exists(numbers(text), lambda n: F.abs(n - gold) <= reach)


def verdict(*judgements: Column) -> Column:
    """yes / no / unclear from the first judgement that says one of them, else ''."""

    def read(judgement: Column) -> Column:
        said = F.lower(stripped(judgement.cast("string")))
        return (
            F.when(said.isin(*POSITIVE_VERDICTS), "yes")
            .when(said.isin(*NEGATIVE_VERDICTS), "no")
            .when(said == "unclear", "unclear")
        )

    return F.coalesce(*[read(j) for j in judgements], F.lit(""))


def marked_verdict(text: Column) -> Column:
    """The verdict behind the first marker, up to the end of its line, or NULL."""
    line = F.regexp_extract(text, re.escape(VERDICT_MARKER) + f"([^{LINE_END}]*)", 1)
    said = F.lower(stripped(line))
    return F.when(said.isin(*VERDICTS), said)


def scanned_text(*parts: Column) -> Column:
    """The parts one below the other; empty ones are left out."""
    return F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts])


def _named_words(text: Column, names: Sequence[str]) -> list[Column]:
    """For each name, whether it occurs in the text as a whole word.

    A plain substring search goes first; only texts that hold the name pay for
    looking at what is next to it.
    """
    found = []
    for name in names:
        plain = re.escape(name)
        word = f"{plain}(?<!{WORD_CHAR}{plain})(?!{WORD_CHAR})"
        found.append(F.contains(text, F.lit(name)) & text.rlike(word))
    return found


# Lists are put together without lambdas here: what stands below a lambda function is
# not compiled, and not shared with the rest of the projection.
NO_NAMES = "array<string>"


def _those(names: Sequence[str], found: Sequence[Column]) -> list[Column]:
    nothing = F.array().cast(NO_NAMES)
    return [F.when(f, F.array(F.lit(n))).otherwise(nothing) for n, f in zip(names, found)]


def _names(captured: Column, possible: Column, known: list[Column]) -> Column:
    nothing = F.array().cast(NO_NAMES)
    captured = F.when(possible, captured).otherwise(nothing)
    return F.sort_array(F.array_distinct(F.concat(captured, *known)))


def mentioned_tables(text: Column, known: Sequence[str] = ()) -> Column:
    """Names after FROM or JOIN (last dotted part) and known names, sorted."""
    lowered = F.lower(text)
    return _names(
        F.regexp_extract_all(text, F.lit(TABLE_AFTER), F.lit(1)),
        F.contains(lowered, F.lit("from")) | F.contains(lowered, F.lit("join")),
        _those(known, _named_words(lowered, [name.lower() for name in known])),
    )


def mentioned_relationships(text: Column, known: Sequence[str] = ()) -> Column:
    """Names in anonymous ``[:name]`` brackets and known names, sorted; case counts."""
    return _names(
        F.regexp_extract_all(text, F.lit(RELATIONSHIP), F.lit(1)),
        F.contains(text, F.lit("[")),
        _those(known, _named_words(text, known)),
    )


def has_hint(text: Column, hints: Sequence[str]) -> Column:
    """Some hint occurs in the text, whatever its case."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for hint in hints:
        found = found | F.contains(lowered, F.lit(hint))
    return found


def action_policy(
    text: Column,
    execute: Sequence[str] = EXECUTE_HINTS,
    recommend: Sequence[str] = RECOMMEND_HINTS,
) -> Column:
    """What the text claims to do: words of doing win over words of advice."""
    return (
        F.when(has_hint(text, execute), "execute")
        .when(has_hint(text, recommend), "recommend_only")
        .otherwise("execute")
    )


def message_text(parts: Column) -> Column:
    """The text parts of one message, array<struct<type, value>>, line by line."""
    texts = F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["value"])
    return F.concat_ws("\n", texts)


def quoted(text: Column) -> Column:
    """The text in quotes, the way score notes print it."""
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.when(
        double, F.concat(F.lit('"'), F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'))
    ).otherwise(F.concat(F.lit("'"), escaped, F.lit("'")))


def quoted_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", F.transform(items, quoted)), F.lit("]"))


def plain_number(number: Column) -> Column:
    """A double without exponent and with at least one decimal: 535587727.72, 2.0."""
    digits = number.cast("string").try_cast("decimal(38,16)").cast("string")
    short = F.regexp_replace(F.regexp_replace(digits, r"0+$", ""), r"\.$", ".0")
    return F.coalesce(short, number.cast("string"))
