"""The text tables as answers to scenarios.

Two documents answer one scenario, one per agent. What the documents lack, a
judgement, a query text, is put together from their labels and other columns.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.text import VERDICT_MARKER

SIGNALS = {
    "en": ("the", "of", "and_"),
    "fr": ("la", "que"),
    "de": ("der", "un-d"),
    "es": ("el", "licencia"),
}
KNOWN_TABLES = ("the", "und", "src3", "src30", "en_docs")
KNOWN_RELATIONSHIPS = ("has_fr", "la", "The", "has_xx")


def signals_for(lang: Column) -> Column:
    found = None
    for name, words in SIGNALS.items():
        listed = F.array(*map(F.lit, words))
        found = F.when(lang == name, listed) if found is None else found.when(lang == name, listed)
    return found.otherwise(F.array().cast("array<string>"))


def scenario_of(doc_id: str = "doc_id") -> Column:
    return F.concat(F.lit("S"), F.expr(f"{doc_id} div 2").cast("string"))


def agent_of(doc_id: str = "doc_id") -> Column:
    return F.when(F.col(doc_id) % 2 == 0, "naked").otherwise("ontology")


def query_text() -> Column:
    return F.concat(
        F.lit("SELECT * FROM lake."),
        F.col("source"),
        F.lit(" JOIN "),
        F.col("lang"),
        F.lit("_docs; MATCH (a)-[:`has_"),
        F.col("lang"),
        F.lit("`]->(b)<-[ :"),
        F.col("source"),
        F.lit(" ]-(c)-[r:hidden]->(d)"),
    )


def remark() -> Column:
    return (
        F.when(F.col("quality") == 1, "I recommend a review.")
        .when(F.col("quality") == 0, "I will start; please specify.")
        .otherwise("")
    )


def judgement() -> Column:
    return (
        F.when(F.col("toxic") == 1, "unclear")
        .when(F.col("quality") == 1, "yes")
        .when(F.col("quality") == 0, "no")
        .otherwise("")
    )


def labelled(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Documents with their labels where there are any."""
    return tables["documents"].join(
        tables["labels"].select("doc_id", "quality", "toxic"), "doc_id", "left"
    )


def answers(tables: Mapping[str, DataFrame]) -> DataFrame:
    return labelled(tables).select(
        "doc_id",
        scenario_of().alias("scenario_id"),
        agent_of().alias("agent_type"),
        F.col("text").alias("answer"),
        F.concat(F.lit(VERDICT_MARKER), judgement(), F.lit("\n"), remark()).alias("reasoning"),
        query_text().alias("sql_or_gql"),
        F.col("source").alias("metric_selected"),
    )


def golden(tables: Mapping[str, DataFrame]) -> DataFrame:
    """What each scenario expects, from the languages and sources of its documents."""
    per_scenario = (
        tables["documents"]
        .groupBy(scenario_of().alias("scenario_id"))
        .agg(F.min("lang").alias("lang"), F.min("source").alias("source"))
    )
    lang = F.col("lang")
    nothing = F.array().cast("array<string>")
    return per_scenario.select(
        "scenario_id",
        lang.alias("domain"),
        F.when(lang == "fr", "graph_traversal")
        .when(lang == "de", "")
        .otherwise(F.col("source"))
        .alias("gold_label"),
        (lang == "es").alias("ambiguity_expected"),
        F.when(lang == "de", "execute").otherwise("recommend_only").alias("action_policy"),
        F.array("source", F.concat(lang, F.lit("_docs"))).alias("required_scope_tables"),
        F.when(lang == "en", F.array(F.lit("has_en"), F.lit("has_fr")))
        .when(lang == "fr", F.array(F.lit("has_fr")))
        .otherwise(nothing)
        .alias("required_relationships"),
        signals_for(lang).alias("ontology_signals"),
        F.when(lang == "en", F.lit(100.0)).when(lang == "de", F.lit(0.0)).alias(
            "gold_numeric_value"
        ),
        F.lit(50.0).alias("gold_numeric_tolerance_pct"),
    )
