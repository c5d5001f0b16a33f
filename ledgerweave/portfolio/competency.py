"""The eleven competency queries on the portfolio graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators.graph import Graph
from ledgerweave.operators.patterns import To, expand, match, top
from ledgerweave.plans import shapes


def total_nodes(graph: Graph) -> DataFrame:
    return shapes.node_total(graph, "total_nodes")


def borrowers_by_type(graph: Graph) -> DataFrame:
    return shapes.nodes_by(graph, "Borrower", "borrower_type", "borrower_type", "borrower_count")


def borrowers_of_non_performing_loans(graph: Graph) -> DataFrame:
    return shapes.linked_targets(
        graph, "has_borrower", F.col("is_non_performing"), "npe_borrower_count"
    )


def property_backed_loans(graph: Graph) -> DataFrame:
    rows = match(
        graph,
        "Collateral",
        "c",
        ["latest_valuation_amount"],
        follow={"l": To("collateral_concerns_loan")},
    )
    rows = expand(
        graph,
        rows,
        "c",
        "pc",
        To("property_collateral_references_collateral", ["city", "country_code"]),
        reverse=True,
    )
    rows = rows.select(
        F.col("l").alias("loan_id"),
        F.col("pc_city").alias("city"),
        F.col("pc_country_code").alias("country_code"),
        F.col("c_latest_valuation_amount").alias("latest_valuation_amount"),
        "pc",
    )
    return top(rows, 25, F.asc("loan_id"), F.asc("pc")).drop("pc")


def forbearances_by_country(graph: Graph) -> DataFrame:
    return shapes.sources_by_target(
        graph,
        "forbearance_concerns_borrower",
        "country_of_residence",
        "country_of_residence",
        "forbearance_count",
    )


def loans_by_group(graph: Graph) -> DataFrame:
    return shapes.rollup_of_members(
        graph, "cp_is_part_of_group", "has_borrowed_loan", "group_name", "group_name", "loan_count"
    )


def recoveries_by_agent(graph: Graph) -> DataFrame:
    """The cash lies in the row that holds the reference, so no event is joined."""
    rows = match(
        graph,
        "ExternalCollection",
        "ec",
        ["cash_recoveries"],
        follow={"ca": To("collection_is_undertaken_by")},
    )
    per_agent = rows.groupBy("ca").agg(F.sum("ec_cash_recoveries").alias("n"))
    agents = match(graph, "CollectionAgent", "ca", ["legal_name"])
    return (
        per_agent.join(agents, "ca")
        .groupBy(F.col("ca_legal_name").alias("agent_name"))
        .agg(F.sum("n").alias("total_recoveries"))
        .orderBy(F.desc("total_recoveries"), "agent_name")
    )


def enforcements_with_practitioner(graph: Graph) -> DataFrame:
    rows = match(
        graph,
        "Enforcement",
        "e",
        follow={
            "l": To("enforcement_concerns_loan"),
            "p": To("enforcement_references_insolvency_practitioner", ["full_name"]),
        },
    )
    rows = rows.select(
        F.col("l").alias("loan_id"),
        F.col("p_full_name").alias("practitioner_name"),
        F.col("e").alias("enforcement_id"),
    )
    return top(rows, 25, F.asc("loan_id"), F.asc("enforcement_id"))


def non_performing_principal(graph: Graph) -> DataFrame:
    return shapes.conditional_sums(
        graph.nodes("Loan"),
        F.col("principal_balance"),
        {"total_exposure": None, "npe_exposure": F.col("is_non_performing")},
    )


def stage_3_principal(graph: Graph) -> DataFrame:
    return shapes.conditional_sums(
        graph.nodes("Loan"),
        F.col("principal_balance"),
        {
            "total_principal": None,
            "stage_3_principal": F.col("ifrs_stage") == "ifrs_stage_3_impaired",
        },
    )


def loans_by_co_borrowers(graph: Graph) -> DataFrame:
    return shapes.busiest_sources(
        graph,
        "has_borrower",
        F.col("role_type") == "co_borrower",
        "loan_id",
        "co_borrower_count",
        25,
    )


COMPETENCY: dict[str, Callable[[Graph], DataFrame]] = {
    "cq01": total_nodes,
    "cq02": borrowers_by_type,
    "cq03": borrowers_of_non_performing_loans,
    "cq04": property_backed_loans,
    "cq05": forbearances_by_country,
    "cq06": loans_by_group,
    "cq07": recoveries_by_agent,
    "cq08": enforcements_with_practitioner,
    "cq09": non_performing_principal,
    "cq10": stage_3_principal,
    "cq11": loans_by_co_borrowers,
}
