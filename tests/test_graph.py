import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerweave.operators.graph import (
    EdgeSpec,
    Graph,
    GraphSpec,
    SeriesSpec,
    coverage,
    covered_references,
    current_snapshot,
    declared_references,
    derived_graph,
    distinct_pairs,
    inverse,
    link_edges,
    parallel_edges,
    reference_edges,
    snake,
    snapshot,
    target_edge,
    versions,
)
from ledgerweave.operators.metrics import latest_values
from ledgerweave.operators.patterns import To, expand, match, top
from ledgerweave.portfolio.competency import COMPETENCY
from ledgerweave.portfolio.contracts import PORTFOLIO
from ledgerweave.portfolio.graph import EDGE_NAMES, LABELS, LINKS, SPEC


def test_labels_and_edges():
    assert len(SPEC.nodes) == 13
    assert len(SPEC.edges) == 16
    for edge in SPEC.edges.values():
        assert edge.table in PORTFOLIO
        assert edge.source in SPEC.nodes and edge.target in SPEC.nodes
    ends = [
        (e.source, e.target, e.table, e.source_key, e.target_key) for e in SPEC.edges.values()
    ]
    assert len(set(ends)) == len(ends)
    for name in (
        "property_collateral_references_collateral",
        "enforcement_references_receiver",
        "enforcement_references_insolvency_practitioner",
        "collateral_concerns_borrower",
        "forbearance_concerns_loan",
    ):
        assert name in SPEC.edges


def test_audit_columns_are_no_properties():
    assert "created_at" not in SPEC.nodes["Loan"].properties
    assert SPEC.nodes["Loan"].display == "loan_id"


def test_two_references_to_one_label_need_a_name():
    with pytest.raises(ValueError):
        reference_edges(
            PORTFOLIO,
            LABELS,
            {("collateral", "concerns_loan_id"): "x", ("collateral", "concerns_borrower_id"): "x"},
        )


def test_link_tables_without_a_named_edge():
    assert link_edges(PORTFOLIO, LABELS, SPEC.edges) == {}
    found = link_edges(PORTFOLIO, LABELS, {})
    assert set(found) == {"borrower_links_loan", "loan_links_borrower"}
    there = found["loan_links_borrower"]
    assert (there.source_key, there.target_key) == (("loan_id",), ("borrower_id",))
    assert set(there.properties) == {"role_type", "linked_at"}


def test_snake():
    assert snake("ExternalCollection") == "external_collection"
    assert snake("NPLoan") == "np_loan"


def test_unset_reference_is_no_edge(graph):
    assert rows(graph.edges("enforcement_concerns_loan")) == [(1, 2), (2, 3), (3, 2)]


def test_composite_key_is_a_struct(graph, tables):
    links = graph.edges("has_borrower")
    assert links.columns == ["src", "dst", "role_type", "linked_at"]
    assert links.count() == 11


def test_inverse_and_parallel_edges(graph):
    there, back = graph.edges("has_borrower"), graph.edges("has_borrowed_loan")
    assert rows(inverse(there).select("src", "dst")) == rows(back.select("src", "dst"))
    assert distinct_pairs(there).count() == 10
    twice = parallel_edges(there).where("multiplicity > 1")
    assert rows(twice) == [(2, 1, 2)]


def test_all_nodes(graph):
    assert graph.all_nodes().count() == 42


def test_edge_summary(graph):
    found = {r.edge: (r.n, r.targets) for r in graph.edge_summary().collect()}
    assert found["has_borrower"] == (11, 5)
    assert found["enforcement_references_receiver"] == (1, 1)
    assert found["external_collection_references_loan"] == (0, 0)


def test_expand_both_ways(graph):
    loans = match(graph, "Loan", "l", where=F.col("loan_id") == 1)
    there = expand(
        graph,
        loans,
        "l",
        "b",
        To("has_borrower", ["full_name"]),
        edge_props=["role_type"],
        edge_where=F.col("role_type") == "co_borrower",
    )
    assert rows(there.select("b", "b_full_name", "has_borrower_role_type")) == [
        (2, "B2", "co_borrower"),
        (3, "B3", "co_borrower"),
    ]
    back = expand(graph, loans, "l", "c", To("collateral_concerns_loan"), reverse=True)
    assert rows(back.select("l", "c")) == [(1, 1)]


def test_reference_in_the_row_of_the_target(tables):
    secured = EdgeSpec("Loan", "Collateral", "collateral", ("concerns_loan_id",), ("collateral_id",))
    graph = Graph(GraphSpec(SPEC.nodes, {"secured_by": secured}), tables)
    assert rows(graph.edges("secured_by")) == [(1, 1), (2, 2), (3, 3), (3, 5)]
    loans = match(graph, "Loan", "l", where=F.col("loan_id") == 3)
    found = expand(graph, loans, "l", "c", To("secured_by", ["collateral_type"]))
    assert rows(found) == [(3, 3, "cash"), (3, 5, "property")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_series(spark):
    spec = GraphSpec({}, {}, {"s": SeriesSpec("Loan", "t", ("loan",), "at", {"rate": "r"})})
    t = spark.createDataFrame(
        [(1, 5, 0.1), (1, 7, 0.2), (1, 7, 0.3), (2, None, 0.4), (None, 1, 0.5)],
        "loan long, at int, r double",
    )
    readings = Graph(spec, {"t": t}).series("s")
    assert rows(readings) == [(1, 5, 0.1), (1, 7, 0.2), (1, 7, 0.3)]
    named = readings.withColumn("prop", F.lit("rate"))
    assert rows(latest_values(named, "node_id", "prop", "instant", "rate")) == [(1, "rate", 7, 0.3)]


def test_follow_a_link_table(graph):
    rows_ = match(graph, "Loan", "l", where=F.col("loan_id") == 3, follow={"b": To("has_borrower")})
    assert rows(rows_) == [(3, 3)]
    with pytest.raises(ValueError):
        match(graph, "Loan", "l", follow={"g": To("cp_is_part_of_group")})


def test_top_settles_ties(spark):
    df = spark.createDataFrame([(i, 1) for i in range(50)], "k int, n int")
    assert [r.k for r in top(df, 3, F.desc("n"), F.asc("k")).collect()] == [0, 1, 2]


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_snapshot_keeps_what_was(spark, graph, tmp_path):
    graph.write_snapshot(str(tmp_path / "v1"))
    kept = snapshot(spark, SPEC, str(tmp_path / "v1"))
    for name, ask in COMPETENCY.items():
        assert rows(ask(kept)) == rows(ask(graph))
        assert joins(ask(kept)) == joins(ask(graph))
    for name in SPEC.series:
        assert rows(kept.series(name)) == rows(graph.series(name))
    for name in SPEC.edges:
        assert rows(kept.edges(name)) == rows(graph.edges(name))
    sound = snapshot(spark, SPEC, str(tmp_path / "v1"), verified=list(SPEC.edges))
    assert sound.verified == frozenset(SPEC.edges)
    with pytest.raises(Exception, match="already exists"):
        graph.write_snapshot(str(tmp_path / "v1"))


def test_a_refresh_shows_when_it_is_whole(spark, tables, tmp_path):
    folder = str(tmp_path / "versions")
    spec = GraphSpec({"Loan": SPEC.nodes["Loan"]}, {})
    loans = tables["loan"]
    with pytest.raises(ValueError, match="no published"):
        current_snapshot(spark, spec, folder)
    Graph(spec, {"loan": loans.limit(1)}).publish_snapshot(folder, "a")
    assert current_snapshot(spark, spec, folder).nodes("Loan").count() == 1
    broken = loans.withColumn("loan_type", F.concat("loan_type", F.raise_error(F.lit("stop"))))
    with pytest.raises(Exception, match="stop"):
        Graph(spec, {"loan": broken}).publish_snapshot(folder, "b")
    assert current_snapshot(spark, spec, folder).nodes("Loan").count() == 1
    Graph(spec, {"loan": loans}).publish_snapshot(folder, "b")  # the version that failed, again
    assert current_snapshot(spark, spec, folder).nodes("Loan").count() == loans.count()
    assert snapshot(spark, spec, f"{folder}/a").nodes("Loan").count() == 1
    found = [(r.number, r.version, r.tables[0].n_rows) for r in versions(spark, folder).orderBy("number").collect()]
    assert found == [(1, "a", 1), (2, "b", loans.count())]
    with pytest.raises(ValueError, match="is published"):
        Graph(spec, {"loan": loans}).publish_snapshot(folder, "b")


def test_edges_follow_from_what_named_edges_leave_open(tables):
    names = EDGE_NAMES | {("collateral", "concerns_loan_id"): "collateral_references_loan"}
    none = derived_graph(PORTFOLIO, LABELS, {}, names)
    declared = declared_references(PORTFOLIO, LABELS)
    assert covered_references(declared, LABELS, none.edges) == set(declared)
    assert derived_graph(PORTFOLIO, LABELS, LINKS, EDGE_NAMES).edges == SPEC.edges
    assert derived_graph(PORTFOLIO, LABELS, SPEC.edges, EDGE_NAMES).edges == SPEC.edges
    # One that lies in its target's row covers its reference as well.
    back = target_edge(PORTFOLIO, LABELS, "collateral", "concerns_loan_id")
    assert (back.source, back.target, back.source_key) == ("Loan", "Collateral", ("concerns_loan_id",))
    named = {"loan_has_collateral": back}
    spec = derived_graph(PORTFOLIO, LABELS, named, names)
    assert set(none.edges) - set(spec.edges) == {"collateral_references_loan"}
    graph = Graph(spec, tables)
    loans = match(graph, "Loan", "l", where=F.col("loan_id") == 3)
    assert rows(expand(graph, loans, "l", "c", To("loan_has_collateral"))) == [(3, 3), (3, 5)]
    found = coverage(PORTFOLIO, LABELS, named, tables).collect()
    report = {(r.table, r.column): (r.covered, r.n_set) for r in found}
    assert set(report) == set(declared) and report["collateral", "concerns_loan_id"] == (True, 4)
    assert sum(covered for covered, _ in report.values()) == 1


def test_edges_of_one_name_are_refused():
    edge = SPEC.edges["cp_is_part_of_group"]
    with pytest.raises(ValueError, match="two edges"):
        derived_graph(PORTFOLIO, LABELS, {"collateral_concerns_loan": edge}, EDGE_NAMES)
