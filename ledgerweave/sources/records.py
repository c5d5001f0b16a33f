"""Scenario, golden-answer and comparison records from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The record layouts and the defaults of absent keys.
SCENARIO_SCHEMA = """
    scenario_id STRING,
    domain STRING,
    user_question STRING,
    required_scope_tables ARRAY<STRING>,
    gold_label STRING,
    explanation STRING,
    action_policy STRING,
    ambiguity_expected BOOLEAN,
    required_relationships ARRAY<STRING>,
    expected_join_hops INT,
    naked_agent_trap STRING,
    ontology_signals ARRAY<STRING>,
    gold_numeric_value DOUBLE,
    gold_numeric_tolerance_pct DOUBLE,
    gold_numeric_description STRING
"""
SCENARIO_DEFAULTS = {
    "required_scope_tables": [],
    "gold_label": "",
    "explanation": "",
    "action_policy": "recommend_only",
    "ambiguity_expected": False,
    "required_relationships": [],
    "expected_join_hops": 0,
    "naked_agent_trap": "",
    "ontology_signals": [],
    "gold_numeric_tolerance_pct": 1.0,
    "gold_numeric_description": "",
}
GOLDEN_COLUMNS = (
    "scenario_id",
    "gold_label",
    "ambiguity_expected",
    "action_policy",
    "required_scope_tables",
    "required_relationships",
    "ontology_signals",
    "gold_numeric_value",
    "gold_numeric_tolerance_pct",
)
QUESTION_SCHEMA = """
    scenario_id STRING,
    domain STRING,
    question STRING,
    expected_answer STRING,
    ontology_signals ARRAY<STRING>,
    actual_answer_naked STRING,
    evaluation_judgement_naked STRING,
    evaluation_result_naked STRING,
    evaluation_status_naked STRING,
    matched_signals_naked ARRAY<STRING>,
    missing_signals_naked ARRAY<STRING>,
    actual_answer_ontology STRING,
    evaluation_judgement_ontology STRING,
    evaluation_result_ontology STRING,
    evaluation_status_ontology STRING,
    matched_signals_ontology ARRAY<STRING>,
    missing_signals_ontology ARRAY<STRING>
"""
COMPARISON_SCHEMA = f"""
    runAtUtc STRING,
    stage STRING,
    scoringMethod STRING,
    scenariosSha256 STRING,
    scenariosPayload ARRAY<STRUCT<{SCENARIO_SCHEMA}>>,
    perQuestion ARRAY<STRUCT<{QUESTION_SCHEMA}>>
"""
COMPARISON_COLUMNS = (
    "runAtUtc",
    "stage",
    "scoringMethod",
    "scenariosSha256",
    "scenariosPayload",
    "perQuestion",
)


def _default(value) -> Column:
    return F.array().cast("array<string>") if value == [] else F.lit(value)


def with_defaults(records: DataFrame) -> DataFrame:
    """Fill the keys a record leaves out."""
    return records.withColumns(
        {
            name: F.coalesce(F.col(name), _default(value))
            for name, value in SCENARIO_DEFAULTS.items()
            if name in records.columns
        }
    )


def parse_scenarios(payloads: DataFrame, column: str) -> DataFrame:
    """Scenarios out of JSON texts, one object each; unknown keys are dropped."""
    record = F.from_json(F.col(column), SCENARIO_SCHEMA).alias("record")
    return with_defaults(payloads.select(record).select("record.*"))


def read_scenarios(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Scenarios from files that hold one JSON array each, or with ``lines`` one
    object per line, which large sets need: those files can be split."""
    reader = spark.read.schema(SCENARIO_SCHEMA).option("multiLine", not lines)
    return with_defaults(reader.json(path))


def golden_answers(scenarios: DataFrame) -> DataFrame:
    """The expectations of each scenario."""
    return scenarios.select(*GOLDEN_COLUMNS)


def read_golden_answers(spark: SparkSession, path: str) -> DataFrame:
    return golden_answers(read_scenarios(spark, path))


def parse_comparisons(payloads: DataFrame, column: str) -> DataFrame:
    """Comparison records out of JSON texts, one record each; other columns stay beside them.

    A text that is no such record has NULL in all of them. Many payloads are many rows, which
    tasks share; what a payload holds is exploded where it is.
    """
    record = F.from_json(F.col(column), COMPARISON_SCHEMA).alias("record")
    rest = [c for c in payloads.columns if c != column]
    return payloads.select(*rest, record).select(*rest, "record.*")


def read_comparison(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Comparison records from files of one record each, or with ``lines`` one record per line."""
    payloads = spark.read.text(path, wholetext=not lines)
    return parse_comparisons(payloads.where(F.trim("value") != ""), "value")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Asked questions, one JSON object per line. A comparison is one row and so the work of
    one task; sets of any size come this way."""
    return spark.read.schema(QUESTION_SCHEMA).json(path)


def questions_of(comparison: DataFrame) -> DataFrame:
    """One row per asked question, both agents side by side."""
    own = [c for c in comparison.columns if c not in COMPARISON_COLUMNS]
    return comparison.select(*own, F.explode("perQuestion").alias("asked")).select(*own, "asked.*")


def scenarios_of(comparison: DataFrame) -> DataFrame:
    """The scenario payload that travels with a comparison."""
    own = [c for c in comparison.columns if c not in COMPARISON_COLUMNS]
    scenarios = comparison.select(*own, F.explode("scenariosPayload").alias("scenario"))
    return with_defaults(scenarios.select(*own, "scenario.*"))


def write_records(records: DataFrame, path: str, by: str | None = None) -> None:
    """Records as JSON lines, one folder per value of ``by``."""
    writer = records.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def write_table(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Rows as Parquet, one folder per value of ``by``."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
