"""The competency queries and the questions on the small portfolio, with the
wrong answers that come close."""

import random
from decimal import Decimal as D

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerweave.operators import metrics
from ledgerweave.plans import shapes
from ledgerweave.portfolio.competency import COMPETENCY
from ledgerweave.portfolio.graph import portfolio_graph
from ledgerweave.portfolio.questions import QUESTIONS, exposure


@pytest.mark.parametrize(
    "name, expected",
    [
        ("cq01", [(42,)]),
        ("cq02", [("individual", 3), ("corporate", 2)]),
        ("cq03", [(3,)]),
        (
            "cq04",
            [
                (1, "Madrid", "ES", D("1000.00")),
                (2, "Paris", "FR", D("2000.00")),
                (3, "Cadiz", "ES", D("3000.00")),
            ],
        ),
        ("cq05", [("ES", 3), (None, 1)]),
        ("cq06", [("Beta", 4), ("Alpha", 2)]),
        ("cq07", [("A1", D("31.30")), ("A2", D("5.00"))]),
        ("cq08", [(2, "P1", 1), (3, "P2", 2)]),
        ("cq09", [(D("2100.00"), D("500.00"))]),
        ("cq10", [(D("2100.00"), D("200.00"))]),
        ("cq11", [(1, 2)]),
    ],
)
def test_competency(graph, name, expected):
    assert [tuple(r) for r in COMPETENCY[name](graph).collect()] == expected


@pytest.mark.parametrize(
    "name, expected",
    [
        ("Q01", [(2,)]),
        ("Q02", [(1, "B1", D("150000.00")), (5, "B5", D("500000.00"))]),
        ("Q03", [(2,)]),
        ("Q05", [(1, 2)]),
        (
            "Q06",
            [
                (1, "a1", "Madrid", D("1000.00")),
                (2, "a2", "Paris", D("2000.00")),
                (3, "a3", "Cadiz", D("3000.00")),
            ],
        ),
        ("Q07", [(1, "B1"), (4, "B4")]),
        ("Q08", [(1, 2, "P1"), (2, 3, "P2")]),
        ("Q09", [("Alpha", 2), ("Beta", 4)]),
        ("Q10", [(1, "P1")]),
        ("Q11", [(1, 2, 2)]),
        ("Q12", [(4,), (5,), (6,)]),
        ("Q13", [(23.6407,)]),
        ("Q14", [(D("250.00"),)]),
        ("Q15", [(9.5238,)]),
        ("Q16", [(2, 1, 2, 2)]),
    ],
)
def test_question(graph, name, expected):
    assert rows(QUESTIONS[name](graph)) == expected


def test_every_link_shows_with_every_role(graph):
    found = rows(QUESTIONS["Q04"](graph).select("loan_id", "borrower_id", "role_type"))
    assert len(found) == 10  # all links but the one to the loan that does not exist
    assert (2, 1, "guarantor") in found and (2, 1, "primary") in found


def test_exposure_counts_a_loan_once_per_borrower(graph):
    found = {r.borrower_id: r.asDict() for r in QUESTIONS["Q17"](graph).collect()}
    assert found[1]["principal_all_roles"] == D("300.00")
    assert found[1]["with_interest_all_roles"] == D("315.00")
    assert found[1]["ead_all_roles"] == D("250.00")
    assert found[2]["principal_full_roles"] == D("100.00")
    assert found[5]["principal_all_roles"] == D("1100.00")
    assert found[5]["things_n"] == 2


def test_preconditions_do_not_multiply(graph):
    found = {r.loan_id: r.asDict() for r in QUESTIONS["Q18"](graph).collect()}
    assert len(found) == 6
    assert found[3]["collateral_rows"] == 2 and found[3]["property_rows"] == 1
    assert found[3]["collateral_value"] == D("3030.00")
    assert found[2]["enforcements"] == 2 and found[2]["practitioners"] == 1
    assert found[6]["collateral_rows"] == 0 and found[6]["collateral_value"] == 0


def test_traps_give_other_numbers(graph):
    loans = graph.tables["loan"]
    by_count = 100.0 * loans.where("is_non_performing").count() / loans.count()
    assert round(by_count, 4) != QUESTIONS["Q13"](graph).first()[0]
    lumped = metrics.share_pct(
        loans,
        F.col("principal_balance"),
        F.col("ifrs_stage").isin("ifrs_stage_3_impaired", "other_impaired"),
        "pct",
        4,
    )
    assert lumped.first()[0] != QUESTIONS["Q15"](graph).first()[0]
    principal = metrics.total_where(
        loans, F.col("principal_balance"), F.col("default_date").isNotNull(), "ead"
    )
    assert principal.first()[0] != QUESTIONS["Q14"](graph).first()[0]
    not_property = graph.tables["collateral"].where("collateral_type != 'property'")
    wrong = {r.concerns_loan_id for r in not_property.collect()}
    assert wrong != {r.loan_id for r in QUESTIONS["Q12"](graph).collect()}


def test_ratio_of_nothing_is_null(graph):
    none = graph.tables["loan"].where(F.lit(False))
    assert metrics.share_pct(none, exposure(), F.col("is_non_performing"), "r", 2).first()[0] is None


def test_conflicts_without_pairs(spark):
    draw = random.Random(3)

    def side(name):
        data = [
            (draw.randrange(30), draw.choice(["a", "b", None]) if draw.random() < 0.4 else "a")
            for _ in range(45)
        ]
        return data, spark.createDataFrame(data, f"k int, {name} string")

    (ours, one), (theirs, other) = side("v"), side("w")
    expected = {k for k, v in ours for q, w in theirs if k == q and v and w and v != w}
    found = metrics.conflicting_keys(one, other, "k", "v", "w")
    assert {r.k for r in found.collect()} == expected and expected


def test_links_of_unknown_sources_do_not_count(graph, tables):
    count = shapes.sources_by_target(graph, "has_borrower", "full_name", "name", "n")
    assert dict(rows(count))["B5"] == 2  # not the link of the loan that does not exist
    trusting = portfolio_graph(tables, verified=["has_borrower"])
    count = shapes.sources_by_target(trusting, "has_borrower", "full_name", "name", "n")
    assert dict(rows(count))["B5"] == 3


def test_verified_edges_need_no_look_at_the_far_end(graph, tables):
    trusting = portfolio_graph(tables, verified=["has_borrowed_loan"])
    found = {r[0]: r[1] for r in COMPETENCY["cq06"](trusting).collect()}
    assert found["Beta"] == 5  # the link to the missing loan now counts
    plan = COMPETENCY["cq06"](trusting)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan
