"""From answers to a comparison, and from a comparison to its scorecard."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions import text as t
from ledgerweave.plans import scorecard as cards
from ledgerweave.plans import scoring
from ledgerweave.plans.scoring import AGENTS
from ledgerweave.sources.records import golden_answers, questions_of, scenarios_of


def question_rows(scenarios: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per scenario with both answers and their first, lexical judgement.

    ``answers`` holds (scenario_id, agent_type, answer), one per scenario and agent.
    The judgement says whether all signals occur; without signals it is NULL, since
    there is nothing to judge. Scenarios without an answer keep their row.
    """
    asked = scenarios.select(
        "scenario_id",
        "domain",
        F.col("user_question").alias("question"),
        F.col("gold_label").alias("expected_answer"),
        "ontology_signals",
        t.prepared_signals(F.col("ontology_signals")).alias("signals"),
    )
    # Answers are grouped once and meet their scenario once; they are judged after that.
    wide = answers.groupBy("scenario_id").agg(
        *[F.max(F.when(F.col("agent_type") == a, F.struct("answer"))).alias(f"said_{a}") for a in AGENTS]
    )
    met = asked.join(wide, "scenario_id", "left")
    found = met.select(
        "*",
        *[
            F.when(
                F.col(f"said_{a}").isNotNull(), t.split_signals(F.col(f"said_{a}.answer"), F.col("signals"))
            ).alias(f"found_{a}")
            for a in AGENTS
        ],
    )
    judged = found.select(
        "*",
        *[
            F.struct(
                F.col(f"said_{a}.answer").alias("answer"),
                F.when(F.size("signals") > 0, F.size(F.col(f"found_{a}.missing")) == 0).alias("judgement"),
                F.col(f"found_{a}.matched").alias("matched"),
                F.col(f"found_{a}.missing").alias("missing"),
            ).alias(a)
            for a in AGENTS
        ],
    )
    columns: list[Column] = []
    for agent in AGENTS:
        columns += [
            F.col(agent)["answer"].alias(f"actual_answer_{agent}"),
            F.col(agent)["judgement"].alias(f"evaluation_judgement_{agent}"),
            F.col(agent)["matched"].alias(f"matched_signals_{agent}"),
            F.col(agent)["missing"].alias(f"missing_signals_{agent}"),
        ]
    return judged.select(
        "scenario_id", "domain", "question", "expected_answer", "ontology_signals", *columns
    )


def agent_summary(questions: DataFrame) -> DataFrame:
    """(agent, correct, scored, na, total, accuracy_pct) of the lexical judgements."""
    rows = scoring.long_form(
        questions,
        ["scenario_id"],
        {a: {"judgement": F.col(f"evaluation_judgement_{a}").cast("boolean")} for a in AGENTS},
        "agent",
    )
    return cards.agent_accuracy(rows, "agent", "judgement")


@dataclass(frozen=True)
class Evaluation:
    scores: DataFrame
    card: DataFrame
    totals: DataFrame
    note: str | None = None


def evaluate(
    comparison: DataFrame,
    known_tables: Sequence[str] = (),
    known_relationships: Sequence[str] = (),
    scenarios: DataFrame | None = None,
    override: bool = False,
    strip_prefix: str | None = None,
) -> Evaluation:
    """Check a comparison and score it.

    The scenarios are those that travel with the comparison. Other ones are taken
    only if their payload is the same, or on request with ``override``; the result
    then carries a note. Missing, repeated or unknown scenario ids stop the job.
    """
    embedded = scenarios_of(comparison)
    note = None
    if scenarios is None:
        if embedded.isEmpty():
            raise ValueError("the comparison holds no scenarios; name them and override")
        scenarios = embedded
    else:
        note = cards.require_same_payload(
            cards.fingerprint(embedded), cards.fingerprint(scenarios), override
        )
    done = evaluate_questions(
        questions_of(comparison), scenarios, known_tables, known_relationships, strip_prefix
    )
    return replace(done, note=note)


def evaluate_questions(
    questions: DataFrame,
    scenarios: DataFrame,
    known_tables: Sequence[str] = (),
    known_relationships: Sequence[str] = (),
    strip_prefix: str | None = None,
) -> Evaluation:
    """Score asked questions against scenarios, both of any size."""
    for rows in (scenarios, questions):
        cards.require_sound_ids(
            cards.id_anomalies(rows, "scenario_id", scenarios, "scenario_id")
        )
    answers = scoring.infer_metadata(
        scoring.answers_from_questions(questions), known_tables, known_relationships, strip_prefix
    )
    scores = scoring.score_answers(answers, golden_answers(scenarios))
    card = cards.scorecard(scores, scenarios)
    return Evaluation(scores, card, cards.scorecard_totals(card))
