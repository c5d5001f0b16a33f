"""Contracts of the loan portfolio tables.

Fixed values: table names, column names, types, keys, references, value lists
and defaults must equal those of the files that are loaded.
"""

from __future__ import annotations

from ledgerweave.schema import (
    AREA,
    DAY,
    FLAG,
    INSTANT,
    INT,
    LONG,
    MONEY,
    RATE,
    TEXT,
    Field,
    TableContract,
)

CREATED = Field("created_at", INSTANT, required=True)


def _register(table: str, key: str, name: str, *more: Field) -> TableContract:
    """A register of third parties: key, name, optional number, country."""
    return TableContract(
        table,
        (
            Field(key, LONG, key=True),
            Field(name, TEXT, required=True),
            *more,
            Field("country_code", TEXT, required=True),
            CREATED,
        ),
    )


REGISTRATION = Field("registration_number", TEXT, required=True)

COUNTERPARTY_GROUP = TableContract(
    "counterparty_group",
    (
        Field("counterparty_group_id", LONG, key=True),
        Field("group_name", TEXT, required=True),
        Field("sponsor_name", TEXT),
        Field(
            "sponsor_type",
            TEXT,
            one_of=("financial", "industrial", "public", "private_equity", "other"),
        ),
        Field("industry_segment", TEXT, required=True),
        Field("country_code", TEXT, required=True),
        CREATED,
    ),
)

BORROWER = TableContract(
    "borrower",
    (
        Field("borrower_id", LONG, key=True),
        Field("borrower_type", TEXT, required=True, one_of=("individual", "corporate")),
        Field("full_name", TEXT, required=True),
        Field("country_of_residence", TEXT),
        Field("city_of_residence", TEXT),
        Field("annual_income", MONEY),
        Field("annual_revenue", MONEY),
        Field("annual_ebit", MONEY),
        Field("is_deceased", FLAG, required=True, default=False),
        Field("current_internal_credit_rating", TEXT, required=True),
        Field("current_external_credit_rating", TEXT),
        Field("external_credit_scoring", INT),
        Field("date_of_birth", DAY),
        Field("incorporation_date", DAY),
        Field("group_id", LONG, references=("counterparty_group", "counterparty_group_id")),
        CREATED,
    ),
)

LOAN = TableContract(
    "loan",
    (
        Field("loan_id", LONG, key=True),
        Field("loan_type", TEXT, required=True, one_of=("personal", "corporate")),
        Field("origination_date", DAY, required=True),
        Field("maturity_date", DAY, required=True),
        Field("current_maturity_date", DAY, required=True),
        Field("currency_code", TEXT, required=True),
        Field("channel_of_origination", TEXT, required=True),
        Field("amortisation_type", TEXT, required=True, one_of=("annuity", "bullet", "linear")),
        Field("principal_balance", MONEY, required=True, non_negative=True),
        Field("accrued_interest_on_book", MONEY, required=True, non_negative=True, default=0),
        Field("accrued_interest_off_book", MONEY, required=True, non_negative=True, default=0),
        Field("balance_at_default", MONEY, non_negative=True),
        Field(
            "ifrs_stage",
            TEXT,
            required=True,
            one_of=(
                "ifrs_stage_1",
                "ifrs_stage_2",
                "ifrs_stage_3_impaired",
                "other_impaired",
                "other_not_impaired",
                "fair_value_pnl",
            ),
        ),
        Field("days_past_due", INT, required=True, non_negative=True, default=0),
        Field("default_date", DAY),
        Field("current_interest_rate", RATE, required=True),
        Field("current_interest_margin", RATE, required=True),
        Field("interest_rate_type", TEXT, required=True, one_of=("fixed", "floating", "mixed")),
        Field("product_code", TEXT, required=True),
        Field(
            "code_of_conduct_status",
            TEXT,
            required=True,
            one_of=("active", "waived", "not_applicable"),
        ),
        Field("is_non_performing", FLAG, required=True),
        Field("write_off_flag", FLAG, required=True, default=False),
        CREATED,
    ),
    ordered=(
        ("origination_date", "maturity_date"),
        ("origination_date", "current_maturity_date"),
        ("origination_date", "default_date"),
    ),
)

LOAN_BORROWER_LINK = TableContract(
    "loan_borrower_link",
    (
        Field("loan_id", LONG, required=True, key=True, references=("loan", "loan_id")),
        Field("borrower_id", LONG, required=True, key=True, references=("borrower", "borrower_id")),
        Field(
            "role_type",
            TEXT,
            required=True,
            key=True,
            one_of=("primary", "co_borrower", "guarantor"),
        ),
        Field("linked_at", INSTANT, required=True),
    ),
)

COLLECTION_AGENT = _register("collection_agent", "collection_agent_id", "legal_name", REGISTRATION)
INSURANCE_PROVIDER = _register(
    "insurance_provider", "insurance_provider_id", "legal_name", REGISTRATION
)
INSOLVENCY_PRACTITIONER = _register(
    "insolvency_practitioner", "insolvency_practitioner_id", "full_name", REGISTRATION
)
RECEIVER = _register("receiver", "receiver_id", "full_name", REGISTRATION)
RATING_AGENCY = _register("rating_agency", "rating_agency_id", "legal_name")

COLLATERAL = TableContract(
    "collateral",
    (
        Field("collateral_id", LONG, key=True),
        Field(
            "collateral_type",
            TEXT,
            required=True,
            one_of=("property", "guarantee", "cash", "other"),
        ),
        Field("concerns_loan_id", LONG, references=("loan", "loan_id")),
        Field("concerns_borrower_id", LONG, references=("borrower", "borrower_id")),
        Field("valuation_date", DAY, required=True),
        Field("latest_valuation_amount", MONEY, required=True, non_negative=True),
        Field("collateral_currency", TEXT, required=True),
        Field("collateral_insured", FLAG, required=True, default=False),
        Field("insurance_coverage_amount", MONEY, non_negative=True),
        Field(
            "insurance_provider_id",
            LONG,
            references=("insurance_provider", "insurance_provider_id"),
        ),
        Field("activation_of_guarantee", FLAG, required=True, default=False),
        Field("configuration", TEXT),
        CREATED,
    ),
    any_of=(("concerns_loan_id", "concerns_borrower_id"),),
)

PROPERTY_COLLATERAL = TableContract(
    "property_collateral",
    (
        Field("property_collateral_id", LONG, key=True),
        Field(
            "collateral_id",
            LONG,
            required=True,
            unique=True,
            references=("collateral", "collateral_id"),
        ),
        Field("address_line", TEXT, required=True),
        Field("city", TEXT, required=True),
        Field("country_code", TEXT, required=True),
        Field("postal_code", TEXT),
        Field("building_area_m2", AREA),
        Field("lettable_area_m2", AREA),
        Field("occupied_area_m2", AREA),
        Field("condition_of_property", TEXT, one_of=("excellent", "good", "fair", "poor")),
        Field("completion_status", TEXT, one_of=("completed", "under_construction", "planned")),
        Field("current_market_status", TEXT, one_of=("liquid", "normal", "illiquid")),
        Field("current_annual_passing_rent", MONEY),
        Field("valuation_currency", TEXT, required=True),
        Field("initial_valuation_date", DAY, required=True),
        Field("latest_valuation_date", DAY, required=True),
        CREATED,
    ),
    ordered=(("initial_valuation_date", "latest_valuation_date"),),
)

# Events concern a loan, a borrower or both.
CONCERNS_LOAN = Field("loan_id", LONG, references=("loan", "loan_id"))
CONCERNS_BORROWER = Field("borrower_id", LONG, references=("borrower", "borrower_id"))


def _amount(name: str) -> Field:
    return Field(name, MONEY, required=True, default=0)


FORBEARANCE_EVENT = TableContract(
    "forbearance_event",
    (
        Field("forbearance_event_id", LONG, key=True),
        CONCERNS_LOAN,
        CONCERNS_BORROWER,
        Field("start_date", DAY, required=True),
        Field("end_date", DAY),
        Field("forbearance_clause", TEXT, required=True),
        _amount("principal_forgiveness_amount"),
        _amount("repayment_step_up_amount"),
        Field("interest_rate_under_forbearance", RATE),
        Field("clause_to_stop_forbearance", FLAG, required=True, default=False),
        Field("description_of_forbearance", TEXT),
        Field("type_identifier", TEXT, required=True),
        CREATED,
    ),
    ordered=(("start_date", "end_date"),),
    any_of=(("loan_id", "borrower_id"),),
)

ENFORCEMENT_EVENT = TableContract(
    "enforcement_event",
    (
        Field("enforcement_event_id", LONG, key=True),
        CONCERNS_LOAN,
        CONCERNS_BORROWER,
        Field(
            "insolvency_practitioner_id",
            LONG,
            references=("insolvency_practitioner", "insolvency_practitioner_id"),
        ),
        Field("receiver_id", LONG, references=("receiver", "receiver_id")),
        Field("contracted_date", DAY, required=True),
        Field("repossessed_date", DAY),
        _amount("amount_outstanding_liabilities"),
        _amount("costs_accrued_to_buyer"),
        _amount("costs_at_end_of_sale"),
        Field("court_appraisal_amount", MONEY),
        Field("reserve_price_first_auction", MONEY),
        Field("reserve_price_last_auction", MONEY),
        Field("reserve_price_next_auction", MONEY),
        Field("annual_insurance_payment", MONEY),
        Field("type_identifier", TEXT, required=True),
        CREATED,
    ),
    ordered=(("contracted_date", "repossessed_date"),),
    any_of=(("loan_id", "borrower_id"),),
)

EXTERNAL_COLLECTION_EVENT = TableContract(
    "external_collection_event",
    (
        Field("external_collection_event_id", LONG, key=True),
        CONCERNS_LOAN,
        CONCERNS_BORROWER,
        Field(
            "collection_agent_id",
            LONG,
            required=True,
            references=("collection_agent", "collection_agent_id"),
        ),
        Field("date_sent_to_agent", DAY, required=True),
        Field("date_returned_from_agent", DAY),
        _amount("balance_amount_sent_to_agent"),
        _amount("quantity_returned_from_agent"),
        _amount("cash_recoveries"),
        _amount("costs_accrued"),
        Field("repayment_plan", TEXT),
        _amount("principal_forgiveness"),
        Field("registration_number", TEXT),
        CREATED,
    ),
    ordered=(("date_sent_to_agent", "date_returned_from_agent"),),
)

PORTFOLIO = {
    c.name: c
    for c in (
        COUNTERPARTY_GROUP,
        BORROWER,
        LOAN,
        LOAN_BORROWER_LINK,
        COLLECTION_AGENT,
        INSURANCE_PROVIDER,
        INSOLVENCY_PRACTITIONER,
        RECEIVER,
        RATING_AGENCY,
        COLLATERAL,
        PROPERTY_COLLATERAL,
        FORBEARANCE_EVENT,
        ENFORCEMENT_EVENT,
        EXTERNAL_COLLECTION_EVENT,
    )
}
