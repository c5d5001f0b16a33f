import datetime as dt

from conftest import build, rows
from pyspark.sql import functions as F

from ledgerweave.operators import quality
from ledgerweave.portfolio.contracts import PORTFOLIO


def found(df):
    return {r.check_name: r.violations for r in df.collect()}


def test_sound_portfolio_has_the_planted_faults_only(tables):
    faults = {k: v for k, v in found(quality.check_contracts(PORTFOLIO, tables)).items() if v}
    assert faults == {
        "loan_borrower_link.loan_id.references.loan": 1,
        "loan.default_date.not_before.origination_date": 1,
    }


def test_row_rules(spark):
    loan = {
        "loan_type": "personal",
        "amortisation_type": "linear",
        "interest_rate_type": "fixed",
        "code_of_conduct_status": "active",
        "ifrs_stage": "ifrs_stage_1",
    }
    table = build(
        spark,
        "loan",
        {"loan_id": 1, **loan},
        {"loan_id": 2, **loan, "principal_balance": -1, "ifrs_stage": "stage 9"},
        {"loan_id": 3, **loan, "maturity_date": "2020-01-01", "default_date": "2020-01-01"},
        {"loan_id": 4, **loan, "balance_at_default": None, "default_date": None},
    )
    rules = quality.row_rules(PORTFOLIO["loan"])
    faults = {k: v for k, v in found(quality.count_violations(table, rules)).items() if v}
    assert faults == {
        "loan.principal_balance.non_negative": 1,
        "loan.ifrs_stage.one_of": 1,
        "loan.maturity_date.not_before.origination_date": 1,
        "loan.default_date.not_before.origination_date": 1,
    }
    bad = quality.violating_rows(table, rules).select("loan_id", F.size("violations"))
    assert rows(bad) == [(2, 2), (3, 2)]


def test_null_holds_but_not_null_is_a_rule_of_its_own(spark):
    df = spark.createDataFrame(
        [(None, None, None), ("x", -1, dt.date(2020, 1, 1))], "a string, b int, c date"
    )
    rules = {
        "in": quality.not_in(F.col("a"), ["y"]),
        "neg": quality.negative(F.col("b")),
        "order": quality.out_of_order(F.lit(dt.date(2021, 1, 1)), F.col("c")),
        "any": quality.none_set(F.col("a"), F.col("b")),
        "set": F.col("a").isNull(),
    }
    assert found(quality.count_violations(df, rules)) == {
        "in": 1,
        "neg": 1,
        "order": 1,
        "any": 1,
        "set": 1,
    }


def test_keys(spark):
    link = build(
        spark,
        "loan_borrower_link",
        *[{"loan_id": 1, "borrower_id": 1, "role_type": r} for r in ("primary", "primary", "guarantor")],
    )
    prop = build(
        spark,
        "property_collateral",
        {"property_collateral_id": 1, "collateral_id": 5},
        {"property_collateral_id": 2, "collateral_id": 5},
    )
    dup = quality.duplicate_keys(link, PORTFOLIO["loan_borrower_link"].primary_key)
    assert rows(dup) == [(1, 1, "primary", 2)]
    checks = quality.key_rules(PORTFOLIO["property_collateral"], {"property_collateral": prop})
    assert [found(c) for c in checks] == [
        {"property_collateral.primary_key": 0},
        {"property_collateral.collateral_id.unique": 1},
    ]


def test_orphans_are_counted_by_row(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "fk long")
    parent = spark.createDataFrame([(2,)], "id long")
    assert rows(quality.orphans(child, "fk", parent, "id")) == [(1, 2)]
    assert rows(quality.orphan_count("x", child, "fk", parent, "id")) == [("x", 2)]
    whole = quality.orphan_count("x", child.where("fk = 2"), "fk", parent, "id")
    assert rows(whole) == [("x", 0)]


def test_defaults(spark):
    table = spark.createDataFrame([(None, None), (True, 7)], "clause_to_stop_forbearance boolean, loan_id long")
    filled = quality.fill_defaults(table, PORTFOLIO["forbearance_event"])
    assert rows(filled) == [(False, None), (True, 7)]
