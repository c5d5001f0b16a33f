import datetime as dt
import decimal
import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from pyspark.sql import types as T  # noqa: E402

from ledgerweave.portfolio.contracts import PORTFOLIO  # noqa: E402
from ledgerweave.portfolio.graph import portfolio_graph  # noqa: E402
from ledgerweave.session import local_session  # noqa: E402

STAMP = dt.datetime(2024, 1, 1)
FILLERS = {
    T.LongType: 1,
    T.IntegerType: 1,
    T.StringType: "x",
    T.BooleanType: False,
    T.DateType: dt.date(2024, 1, 1),
    T.TimestampType: STAMP,
    T.DecimalType: decimal.Decimal("0"),
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = local_session(
        "tests",
        "4",
        **{
            "spark.sql.shuffle.partitions": "3",
            "spark.sql.warehouse.dir": str(folder / "warehouse"),
            "spark.checkpoint.dir": str(folder / "checkpoints"),
        },
    )
    yield session
    session.stop()


def rows(df):
    """All rows as tuples, sorted by their text."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def build(spark, table, *records):
    """A table from partial records: what a record leaves out is filled in."""
    contract = PORTFOLIO[table]
    data = []
    for record in records:
        assert set(record) <= set(contract.columns), record
        data.append(
            tuple(
                convert(record[f.name], f.type)
                if f.name in record
                else (FILLERS[type(f.type)] if f.required else None)
                for f in contract.fields
            )
        )
    return spark.createDataFrame(data, contract.struct())


def convert(value, to):
    if value is not None and isinstance(to, T.DecimalType):
        return decimal.Decimal(str(value))
    if isinstance(value, str) and isinstance(to, T.DateType):
        return dt.date.fromisoformat(value)
    return value


def _loan(loan_id, principal, stage="ifrs_stage_1", **more):
    return {
        "loan_id": loan_id,
        "principal_balance": principal,
        "ifrs_stage": stage,
        "origination_date": "2023-05-01",
        "maturity_date": "2030-01-01",
        "current_maturity_date": "2030-01-01",
        "loan_type": "personal",
        "amortisation_type": "linear",
        "interest_rate_type": "fixed",
        "code_of_conduct_status": "active",
        **more,
    }


def _person(borrower_id, kind, country, group=None, income=None):
    return {
        "borrower_id": borrower_id,
        "borrower_type": kind,
        "full_name": f"B{borrower_id}",
        "country_of_residence": country,
        "group_id": group,
        "annual_income": income,
    }


def _link(loan, borrower, role):
    return {"loan_id": loan, "borrower_id": borrower, "role_type": role}


def _collected(event, agent, cash):
    return {
        "external_collection_event_id": event,
        "collection_agent_id": agent,
        "cash_recoveries": cash,
    }


@pytest.fixture(scope="session")
def tables(spark):
    """A portfolio that exercises every rule: one pair with two roles on a loan, two
    co-borrowers on a loan, a pair that shares two loans, a loan without collateral
    and one with cash only, a property abroad, both impaired stages, a default whose
    balance differs from the principal, a borrower without group or country."""
    return {
        "counterparty_group": build(
            spark,
            "counterparty_group",
            {"counterparty_group_id": 1, "group_name": "Alpha"},
            {"counterparty_group_id": 2, "group_name": "Beta"},
        ),
        "borrower": build(
            spark,
            "borrower",
            _person(1, "individual", "ES", 1, 150000),
            _person(2, "individual", "PT", 1, 100000),
            _person(3, "corporate", "ES", 2),
            _person(4, "individual", None, None, 99999),
            _person(5, "corporate", "DE", 2, 500000),
        ),
        "loan": build(
            spark,
            "loan",
            _loan(1, 100, accrued_interest_on_book=10, accrued_interest_off_book=5),
            _loan(2, 200, "ifrs_stage_3_impaired", is_non_performing=True,
                  default_date="2024-02-01", balance_at_default=250, write_off_flag=True),
            _loan(3, 300, "other_impaired", is_non_performing=True, origination_date="2024-01-01"),
            _loan(4, 400, origination_date="2024-12-31"),
            _loan(5, 500, "ifrs_stage_2", default_date="2024-05-01", balance_at_default=None,
                  origination_date="2025-01-01"),
            _loan(6, 600, write_off_flag=True, balance_at_default=999),
        ),
        "loan_borrower_link": build(
            spark,
            "loan_borrower_link",
            _link(1, 1, "primary"),
            _link(1, 2, "co_borrower"),
            _link(1, 3, "co_borrower"),
            _link(2, 1, "primary"),
            _link(2, 1, "guarantor"),
            _link(2, 2, "guarantor"),
            _link(3, 3, "primary"),
            _link(4, 4, "primary"),
            _link(5, 5, "primary"),
            _link(6, 5, "guarantor"),
            _link(7, 5, "primary"),
        ),
        "collection_agent": build(
            spark,
            "collection_agent",
            {"collection_agent_id": 1, "legal_name": "A1"},
            {"collection_agent_id": 2, "legal_name": "A2"},
            {"collection_agent_id": 3, "legal_name": "A1"},
        ),
        "insurance_provider": build(spark, "insurance_provider", {"insurance_provider_id": 1}),
        "insolvency_practitioner": build(
            spark,
            "insolvency_practitioner",
            {"insolvency_practitioner_id": 1, "full_name": "P1"},
            {"insolvency_practitioner_id": 2, "full_name": "P2"},
        ),
        "receiver": build(spark, "receiver", {"receiver_id": 1}),
        "rating_agency": build(spark, "rating_agency", {"rating_agency_id": 1}),
        "collateral": build(
            spark,
            "collateral",
            {"collateral_id": 1, "collateral_type": "property", "concerns_loan_id": 1,
             "latest_valuation_amount": 1000},
            {"collateral_id": 2, "collateral_type": "property", "concerns_loan_id": 2,
             "latest_valuation_amount": 2000},
            {"collateral_id": 3, "collateral_type": "cash", "concerns_loan_id": 3,
             "latest_valuation_amount": 30},
            {"collateral_id": 4, "collateral_type": "guarantee", "concerns_borrower_id": 4,
             "latest_valuation_amount": 40},
            {"collateral_id": 5, "collateral_type": "property", "concerns_loan_id": 3,
             "latest_valuation_amount": 3000, "insurance_provider_id": 1},
        ),
        "property_collateral": build(
            spark,
            "property_collateral",
            {"property_collateral_id": 1, "collateral_id": 1, "city": "Madrid",
             "country_code": "ES", "address_line": "a1"},
            {"property_collateral_id": 2, "collateral_id": 2, "city": "Paris",
             "country_code": "FR", "address_line": "a2"},
            {"property_collateral_id": 3, "collateral_id": 5, "city": "Cadiz",
             "country_code": "ES", "address_line": "a3"},
        ),
        "forbearance_event": build(
            spark,
            "forbearance_event",
            {"forbearance_event_id": 1, "borrower_id": 1},
            {"forbearance_event_id": 2, "borrower_id": 1},
            {"forbearance_event_id": 3, "borrower_id": 3, "loan_id": 3},
            {"forbearance_event_id": 4, "loan_id": 4},
            {"forbearance_event_id": 5, "borrower_id": 4},
        ),
        "enforcement_event": build(
            spark,
            "enforcement_event",
            {"enforcement_event_id": 1, "loan_id": 2, "insolvency_practitioner_id": 1,
             "receiver_id": 1},
            {"enforcement_event_id": 2, "loan_id": 3, "insolvency_practitioner_id": 2},
            {"enforcement_event_id": 3, "loan_id": 2},
            {"enforcement_event_id": 4, "borrower_id": 4, "insolvency_practitioner_id": 2},
        ),
        "external_collection_event": build(
            spark,
            "external_collection_event",
            _collected(1, 1, "10.10"),
            _collected(2, 1, "20.20"),
            _collected(3, 2, "5"),
            _collected(4, 3, "1"),
        ),
    }


@pytest.fixture(scope="session")
def graph(tables):
    return portfolio_graph(tables)
