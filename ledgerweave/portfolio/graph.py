"""The portfolio as a graph.

Fixed values: node labels, their tables and the edge names must equal those the
queries use. References without a name here are called by the default rule.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from ledgerweave.operators.graph import (
    EdgeSpec,
    Graph,
    GraphSpec,
    link_edges,
    node_specs,
    reference_edges,
)
from ledgerweave.portfolio.contracts import PORTFOLIO

LABELS = {
    "Borrower": "borrower",
    "Loan": "loan",
    "Collateral": "collateral",
    "PropertyCollateral": "property_collateral",
    "CounterpartyGroup": "counterparty_group",
    "Forbearance": "forbearance_event",
    "Enforcement": "enforcement_event",
    "ExternalCollection": "external_collection_event",
    "CollectionAgent": "collection_agent",
    "InsolvencyPractitioner": "insolvency_practitioner",
    "InsuranceProvider": "insurance_provider",
    "Receiver": "receiver",
    "RatingAgency": "rating_agency",
}
EDGE_NAMES = {
    ("borrower", "group_id"): "cp_is_part_of_group",
    ("collateral", "concerns_loan_id"): "collateral_concerns_loan",
    ("collateral", "concerns_borrower_id"): "collateral_concerns_borrower",
    ("forbearance_event", "loan_id"): "forbearance_concerns_loan",
    ("forbearance_event", "borrower_id"): "forbearance_concerns_borrower",
    ("enforcement_event", "loan_id"): "enforcement_concerns_loan",
    ("external_collection_event", "collection_agent_id"): "collection_is_undertaken_by",
}
# The link table carries both directions of the loan-borrower relation; all its
# columns are edge properties.
LINK_PROPERTIES = {"role_type": "role_type", "linked_at": "linked_at"}
LINKS = {
    "has_borrower": EdgeSpec(
        "Loan", "Borrower", "loan_borrower_link", ("loan_id",), ("borrower_id",), LINK_PROPERTIES
    ),
    "has_borrowed_loan": EdgeSpec(
        "Borrower", "Loan", "loan_borrower_link", ("borrower_id",), ("loan_id",), LINK_PROPERTIES
    ),
}

SPEC = GraphSpec(
    node_specs(PORTFOLIO, LABELS),
    {
        **LINKS,
        **reference_edges(PORTFOLIO, LABELS, EDGE_NAMES),
        **link_edges(PORTFOLIO, LABELS, LINKS),
    },
)


def portfolio_graph(tables: Mapping[str, DataFrame], verified: Iterable[str] = ()) -> Graph:
    return Graph(SPEC, tables, verified)
