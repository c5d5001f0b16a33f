"""The eighteen portfolio questions, answered from the tables.

Three have a published gold value; see ``GOLD``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators import metrics
from ledgerweave.operators.graph import Graph
from ledgerweave.operators.pairs import shared_pairs
from ledgerweave.operators.patterns import To, expand, match
from ledgerweave.portfolio import competency

# Fixed values: (gold value, tolerance in percent) of the questions that have one.
GOLD = {"Q13": (17.52, 2.0), "Q14": (535587727.72, 1.0), "Q15": (17.58, 2.0)}

IMPAIRED = "ifrs_stage_3_impaired"


def exposure():
    return (
        F.col("principal_balance")
        + F.col("accrued_interest_on_book")
        + F.col("accrued_interest_off_book")
    )


def written_off(g: Graph) -> DataFrame:
    return metrics.count_where(g.tables["loan"], F.col("write_off_flag"), "write_off_count")


def high_income_borrowers(g: Graph) -> DataFrame:
    return g.tables["borrower"].where(F.col("annual_income") > 100000).select(
        "borrower_id", "full_name", "annual_income"
    )


def originated_in_2024(g: Graph) -> DataFrame:
    return metrics.count_where(
        g.tables["loan"], metrics.in_year("origination_date", 2024), "loans_originated_2024"
    )


def borrowers_of_loans(g: Graph) -> DataFrame:
    return metrics.role_fanout(
        g.tables["loan_borrower_link"],
        g.tables["loan"],
        g.tables["borrower"],
        "loan_id",
        "borrower_id",
        "role_type",
    )


def loans_with_several_co_borrowers(g: Graph) -> DataFrame:
    return metrics.role_counts(
        g.tables["loan_borrower_link"],
        "loan_id",
        "borrower_id",
        F.col("role_type") == "co_borrower",
        "co_borrower_count",
        1,
    )


def property_valuations(g: Graph) -> DataFrame:
    rows = match(
        g,
        "Collateral",
        "c",
        ["latest_valuation_amount"],
        where=F.col("collateral_type") == "property",
        follow={"l": To("collateral_concerns_loan")},
    )
    rows = expand(
        g,
        rows,
        "c",
        "pc",
        To("property_collateral_references_collateral", ["address_line", "city"]),
        reverse=True,
    )
    return rows.select(
        F.col("l").alias("loan_id"),
        F.col("pc_address_line").alias("address_line"),
        F.col("pc_city").alias("city"),
        F.col("c_latest_valuation_amount").alias("latest_valuation_amount"),
    )


def individuals_with_forbearance(g: Graph) -> DataFrame:
    people = g.tables["borrower"].where(F.col("borrower_type") == "individual")
    return metrics.present(
        people, "borrower_id", g.tables["forbearance_event"], "borrower_id"
    ).select("borrower_id", "full_name")


def enforcements_with_practitioner(g: Graph) -> DataFrame:
    rows = match(
        g,
        "Enforcement",
        "e",
        follow={
            "l": To("enforcement_concerns_loan"),
            "p": To("enforcement_references_insolvency_practitioner", ["full_name"]),
        },
    )
    return rows.select(
        F.col("e").alias("enforcement_id"),
        F.col("l").alias("loan_id"),
        F.col("p_full_name").alias("practitioner_name"),
    )


def cross_country_practitioners(g: Graph) -> DataFrame:
    """Enforcement -> loan <- collateral <- property against loan -> borrower.

    Countries are compared per loan, as least and greatest value of each side.
    """
    properties = match(
        g,
        "PropertyCollateral",
        "pc",
        ["country_code"],
        follow={"c": To("property_collateral_references_collateral")},
    )
    collateral = g.edges("collateral_concerns_loan").select(
        F.col("src").alias("c"), F.col("dst").alias("loan")
    )
    located = properties.join(collateral, "c").select("loan", F.col("pc_country_code").alias("at"))
    homes = g.nodes("Borrower").select(F.col("node_id").alias("b"), "country_of_residence")
    parties = (
        g.edges("has_borrower")
        .select(F.col("src").alias("loan"), F.col("dst").alias("b"))
        .distinct()
        .join(homes, "b")
        .select("loan", F.col("country_of_residence").alias("lives"))
    )
    loans = metrics.conflicting_keys(
        located.dropna(), parties.dropna(), "loan", "at", "lives"
    )
    handled = match(
        g,
        "Enforcement",
        "e",
        follow={
            "loan": To("enforcement_concerns_loan"),
            "p": To("enforcement_references_insolvency_practitioner"),
        },
    )
    handlers = handled.join(loans, "loan", "left_semi").select("p").distinct()
    names = match(g, "InsolvencyPractitioner", "p", ["full_name"])
    return handlers.join(names, "p").select(
        F.col("p").alias("insolvency_practitioner_id"), F.col("p_full_name").alias("full_name")
    )


def borrower_pairs(g: Graph) -> DataFrame:
    return shared_pairs(g.tables["loan_borrower_link"], "loan_id", "borrower_id", "shared_loans")


def uncollateralised_loans(g: Graph) -> DataFrame:
    return metrics.absent(
        g.tables["loan"], "loan_id", g.tables["collateral"], "concerns_loan_id"
    ).select("loan_id")


def npe_ratio(g: Graph) -> DataFrame:
    return metrics.share_pct(
        g.tables["loan"], exposure(), F.col("is_non_performing"), "npe_ratio_pct", 4
    )


def ead_of_defaulted(g: Graph) -> DataFrame:
    return metrics.total_where(
        g.tables["loan"],
        F.col("balance_at_default"),
        F.col("default_date").isNotNull(),
        "total_ead_defaulted",
    )


def stage_3_share(g: Graph) -> DataFrame:
    return metrics.share_pct(
        g.tables["loan"],
        F.col("principal_balance"),
        F.col("ifrs_stage") == IMPAIRED,
        "ifrs_stage3_share_pct",
        4,
    )


def bad_loan_definitions(g: Graph) -> DataFrame:
    return metrics.side_by_side(
        g.tables["loan"],
        {
            "non_performing": F.col("is_non_performing"),
            "stage_3": F.col("ifrs_stage") == IMPAIRED,
            "in_default": F.col("default_date").isNotNull(),
            "written_off": F.col("write_off_flag"),
        },
    )


def borrower_exposures(g: Graph) -> DataFrame:
    return metrics.exposures(
        g.tables["loan_borrower_link"],
        g.tables["loan"],
        "loan_id",
        "borrower_id",
        F.col("role_type") != "guarantor",
        {
            "principal": F.col("principal_balance"),
            "ead": F.when(F.col("default_date").isNotNull(), F.col("balance_at_default")),
            "with_interest": exposure(),
        },
    )


def foreclosure_preconditions(g: Graph) -> DataFrame:
    """What has to be known before a foreclosure; nothing is set in motion."""
    collateral = (
        g.tables["collateral"]
        .join(
            g.tables["property_collateral"].select("collateral_id", F.lit(1).alias("is_property")),
            "collateral_id",
            "left",
        )
        .select(
            F.col("concerns_loan_id").alias("loan_id"), "latest_valuation_amount", "is_property"
        )
        .where(F.col("loan_id").isNotNull())
    )
    enforcement = g.tables["enforcement_event"].where(F.col("loan_id").isNotNull())
    loans = g.tables["loan"].select(
        "loan_id",
        "is_non_performing",
        "ifrs_stage",
        "default_date",
        "days_past_due",
        "write_off_flag",
    )
    report = metrics.with_side_totals(
        loans,
        "loan_id",
        [
            (
                collateral,
                [
                    F.count("*").alias("collateral_rows"),
                    F.count("is_property").alias("property_rows"),
                    F.sum("latest_valuation_amount").alias("collateral_value"),
                ],
            ),
            (
                enforcement,
                [
                    F.count("*").alias("enforcements"),
                    F.countDistinct("insolvency_practitioner_id").alias("practitioners"),
                ],
            ),
        ],
    )
    return report.na.fill(
        0, ["collateral_rows", "property_rows", "collateral_value", "enforcements", "practitioners"]
    )


QUESTIONS: Mapping[str, Callable[[Graph], DataFrame]] = {
    "Q01": written_off,
    "Q02": high_income_borrowers,
    "Q03": originated_in_2024,
    "Q04": borrowers_of_loans,
    "Q05": loans_with_several_co_borrowers,
    "Q06": property_valuations,
    "Q07": individuals_with_forbearance,
    "Q08": enforcements_with_practitioner,
    "Q09": competency.loans_by_group,
    "Q10": cross_country_practitioners,
    "Q11": borrower_pairs,
    "Q12": uncollateralised_loans,
    "Q13": npe_ratio,
    "Q14": ead_of_defaulted,
    "Q15": stage_3_share,
    "Q16": bad_loan_definitions,
    "Q17": borrower_exposures,
    "Q18": foreclosure_preconditions,
}
