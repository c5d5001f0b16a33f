"""Scores of free-text answers along independent dimensions, one row per answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ledgerweave.functions import text as t
from ledgerweave.operators.metrics import long_form
from ledgerweave.sources.records import GOLDEN_COLUMNS, with_defaults

# Agent names and the label that asks for no metric.
AGENTS = ("naked", "ontology")
NO_METRIC = "graph_traversal"
GUARDED = "recommend_only"

ANSWER_DEFAULTS = {
    "answer": "",
    "reasoning": "",
    "sql_or_gql": "",
    "metric_selected": "",
    "ambiguity_flagged": False,
    "action_policy": "execute",
}


def _no_names() -> Column:
    return F.array().cast("array<string>")


def latest_answers(
    messages: DataFrame, thread: str, turn: str, role: str, body: str, alias: str
) -> DataFrame:
    """(thread, alias): the last assistant message of every thread, trimmed.

    ``body`` is a text, or the parts of a message as array<struct<type, value>>, whose
    text parts are joined line by line. Threads without a message, or with a blank one,
    answer ``<empty>``. Other roles send only their thread id: their text is gone before
    anything is sorted.
    """
    in_parts = isinstance(messages.schema[body].dataType, ArrayType)
    text = t.message_text(F.col(body)) if in_parts else F.col(body)
    message = F.struct(F.col(turn).alias("turn"), text.alias("body"))
    said = messages.select(thread, F.when(F.col(role) == "assistant", message).alias("said"))
    body_of = t.stripped(F.col("last.body"))
    return (
        said.groupBy(thread)
        .agg(F.max("said").alias("last"))
        .select(
            thread,
            F.coalesce(F.nullif(body_of, F.lit("")), F.lit(t.EMPTY_ANSWER)).alias(alias),
        )
    )


def answers_from_questions(questions: DataFrame) -> DataFrame:
    """Wide comparison rows to one answer per agent.

    The judgement travels as a marker in the reasoning, ahead of the answer.
    """

    def columns(agent: str) -> dict[str, Column]:
        answer = F.coalesce(F.col(f"actual_answer_{agent}"), F.lit(""))
        judged = t.verdict(
            *[
                F.col(c) if c in questions.columns else F.lit(None).cast("string")
                for c in (
                    f"evaluation_judgement_{agent}",
                    f"evaluation_result_{agent}",
                    f"evaluation_status_{agent}",
                )
            ]
        )
        return {
            "answer": answer,
            "reasoning": F.concat(F.lit(t.VERDICT_MARKER), judged, F.lit("\n"), answer),
            "sql_or_gql": answer,
        }

    return long_form(
        questions, ["scenario_id"], {agent: columns(agent) for agent in AGENTS}, "agent_type"
    )


def complete(answers: DataFrame) -> DataFrame:
    """Every answer column, with its default where the input lacks it."""
    have = answers.columns
    wanted = {
        name: F.coalesce(F.col(name), F.lit(value)) if name in have else F.lit(value)
        for name, value in ANSWER_DEFAULTS.items()
    }
    for name in ("tables_used", "relationships_used"):
        wanted[name] = F.coalesce(F.col(name), _no_names()) if name in have else _no_names()
    if "error" not in have:
        wanted["error"] = F.lit(None).cast("string")
    return answers.withColumns(wanted)


def infer_metadata(
    answers: DataFrame,
    known_tables: Sequence[str] = (),
    known_relationships: Sequence[str] = (),
    strip_prefix: str | None = None,
) -> DataFrame:
    """Fill in tables, relationships, ambiguity flag and policy from the text.

    What an answer already states stays. ``strip_prefix`` takes a common prefix off
    the found table names, for scenarios that name tables without it.
    """
    answers = complete(answers)
    # A projection of its own: the text is put together once, not once per feature.
    scanned = answers.withColumn(
        "__text", t.scanned_text(F.col("answer"), F.col("reasoning"), F.col("sql_or_gql"))
    )
    body = F.col("__text")
    tables = t.mentioned_tables(body, known_tables)
    if strip_prefix:
        bare = F.transform(
            tables,
            lambda n: F.when(
                n.startswith(strip_prefix), n.substr(F.lit(len(strip_prefix) + 1), F.length(n))
            ).otherwise(n),
        )
        tables = F.array_sort(F.array_distinct(bare))
    used, related = F.col("tables_used"), F.col("relationships_used")
    return scanned.withColumns(
        {
            "tables_used": F.when(F.size(used) > 0, used).otherwise(tables),
            "relationships_used": F.when(F.size(related) > 0, related).otherwise(
                t.mentioned_relationships(body, known_relationships)
            ),
            "ambiguity_flagged": F.col("ambiguity_flagged") | t.has_hint(body, t.AMBIGUITY_HINTS),
            "action_policy": F.when(
                F.col("action_policy") == "execute", t.action_policy(body)
            ).otherwise(F.col("action_policy")),
        }
    ).drop("__text")


SCORE_COLUMNS = (
    "scenario_id",
    "agent_type",
    "metric_correct",
    "tables_correct",
    "relationships_correct",
    "ambiguity_detected",
    "guardrail_respected",
    "signals_correct",
    "numeric_correct",
    "total_score",
    "max_score",
    "notes",
)


def expectations(golden: DataFrame) -> DataFrame:
    """Golden answers as (scenario_id, want): one struct per scenario, signals ready."""
    golden = with_defaults(golden.select(*GOLDEN_COLUMNS))
    wanted = [F.col(c) for c in GOLDEN_COLUMNS if c != "scenario_id"]
    prepared = t.prepared_signals(F.col("ontology_signals")).alias("signals")
    return golden.select("scenario_id", F.struct(*wanted, prepared).alias("want"))


def score_answers(answers: DataFrame, golden: DataFrame) -> DataFrame:
    """One row per answer that has a golden answer: flags, total, maximum, notes.

    A dimension counts only where the golden answer expects something of it. The
    join has no hint: a small set of golden answers is broadcast from its measured
    size, a large one is shuffled.
    """
    # The reasoning often repeats the answer; only its verdict takes part in the join.
    judged = complete(answers).withColumn("verdict", t.marked_verdict(F.col("reasoning")))
    rows = judged.drop("reasoning", "sql_or_gql").join(expectations(golden), "scenario_id")
    want = F.col("want")
    # A projection of its own: what reads the texts is worked out once per row.
    measured = rows.withColumns(
        {
            "no_table": F.array_sort(
                F.array_except(want["required_scope_tables"], F.col("tables_used"))
            ),
            "no_relation": F.array_sort(
                F.array_except(want["required_relationships"], F.col("relationships_used"))
            ),
            "no_signal": t.missing_signals(F.col("answer"), want["signals"]),
            "near": F.when(
                want["gold_numeric_value"].isNotNull(),
                t.near_gold(
                    F.col("answer"),
                    want["gold_numeric_value"],
                    want["gold_numeric_tolerance_pct"],
                ),
            ),
        }
    )
    return _with_totals(measured).select(*SCORE_COLUMNS)


def _with_totals(rows: DataFrame) -> DataFrame:
    want, said = F.col("want"), F.col("verdict")
    label, picked, policy = want["gold_label"], F.col("metric_selected"), F.col("action_policy")
    gold, reach = want["gold_numeric_value"], want["gold_numeric_tolerance_pct"]
    # flag -> (is asked for, is met, note when it is not met)
    dimensions = {
        "metric_correct": (
            (label != "") & (label != NO_METRIC),
            picked == label,
            F.concat(
                F.lit("metric: expected "), t.quoted(label), F.lit(" got "), t.quoted(picked)
            ),
        ),
        "tables_correct": (
            F.size(want["required_scope_tables"]) > 0,
            F.size("no_table") == 0,
            F.concat(F.lit("tables missing: "), t.quoted_list(F.col("no_table"))),
        ),
        "relationships_correct": (
            F.size(want["required_relationships"]) > 0,
            F.size("no_relation") == 0,
            F.concat(F.lit("relationships missing: "), t.quoted_list(F.col("no_relation"))),
        ),
        "ambiguity_detected": (
            want["ambiguity_expected"],
            F.col("ambiguity_flagged"),
            F.lit("ambiguity not detected"),
        ),
        "guardrail_respected": (
            want["action_policy"] == GUARDED,
            policy == GUARDED,
            F.concat(F.lit("guardrail violated: "), policy),
        ),
        "signals_correct": (
            F.size(want["ontology_signals"]) > 0,
            F.size("no_signal") == 0,
            F.concat(F.lit("signals missing: "), t.quoted_list(F.col("no_signal"))),
        ),
        "numeric_correct": (
            gold.isNotNull(),
            F.coalesce(F.col("near"), F.lit(False)),
            F.concat(
                F.lit("numeric: expected ~"),
                t.plain_number(gold),
                F.lit(" (±"),
                t.plain_number(reach),
                F.lit("%)"),
            ),
        ),
    }
    total = F.when(said == "yes", 1).otherwise(0)
    most = F.when(said.isNotNull(), 1).otherwise(0)
    notes = [
        F.concat(F.lit("error: "), F.nullif(F.col("error"), F.lit(""))),
        F.concat(F.lit("critic: "), said),
    ]
    flags = {}
    for flag, (asked, met, note) in dimensions.items():
        flags[flag] = asked & met
        total = total + flags[flag].cast("int")
        most = most + asked.cast("int")
        notes.append(F.when(asked & ~met, note))
    told = F.concat_ws("; ", *notes)
    return rows.withColumns(
        {
            **flags,
            "total_score": total,
            "max_score": most,
            "notes": F.when(told == "", F.lit("all correct")).otherwise(told),
        }
    )
