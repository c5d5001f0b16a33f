import random

import pytest
from conftest import rows

from ledgerweave.operators import taxonomy as tx


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "child string, parent string")


def chain(spark, n):
    return edges(spark, *[(f"n{i}", f"n{i + 1}") for i in range(n)])


@pytest.mark.parametrize("n", [1, 2, 3, 7, 9])
def test_closure_of_a_chain(spark, n):
    expected = sorted(
        ((f"n{i}", f"n{j}", j - i) for i in range(n) for j in range(i + 1, n + 1)), key=repr
    )
    assert rows(tx.closure(chain(spark, n))) == expected


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_forest(spark, seed):
    """Closure, roots and inheritance against walking up in Python."""
    draw = random.Random(seed)
    parent = {n: draw.randrange(n) for n in range(1, 60) if draw.random() < 0.93}
    own = {(n, a): f"{n}{a}" for n in range(60) for a in "xy" if draw.random() < 0.15}

    def upward(n):
        while n in parent:
            n = parent[n]
            yield n

    tree = spark.createDataFrame([(str(c), str(p)) for c, p in parent.items()], "child string, parent string")
    assert rows(tx.closure(tree)) == sorted(
        ((str(n), str(a), i + 1) for n in parent for i, a in enumerate(upward(n))), key=repr
    )
    assert rows(tx.root_of(tree)) == sorted(
        ((str(n), str(list(upward(n))[-1])) for n in parent), key=repr
    )
    attributes = spark.createDataFrame(
        [(str(n), a, v) for (n, a), v in own.items()], "node string, name string, value string"
    )
    best = {}
    for n in range(60):
        for a in "xy":
            found = [own[m, a] for m in (n, *upward(n)) if (m, a) in own]
            if found:
                best[str(n), a] = found[0]
    assert rows(tx.effective_attributes(tree, attributes)) == sorted(
        ((n, a, v) for (n, a), v in best.items()), key=repr
    )


def test_cycles_are_reported(spark):
    with pytest.raises(ValueError, match="own ancestor"):
        tx.closure(edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")))
    with pytest.raises(ValueError, match="own ancestor"):
        tx.closure(edges(spark, ("a", "a"), ("b", "a")))


TREE = [
    ("IndividualBorrower", "Borrower"),
    ("CorporateBorrower", "Borrower"),
    ("Borrower", "Counterparty"),
    ("Receiver", "Counterparty"),
    ("PersonalLoan", "Loan"),
    ("CorporateLoan", "Loan"),
    ("Loan", None),
]


def test_children_and_descendants(spark):
    tree = edges(spark, *TREE)
    assert rows(tx.children_of(tree, "Loan")) == [("CorporateLoan",), ("PersonalLoan",)]
    assert rows(tx.descendants_of(tree, "Counterparty")) == [
        ("Borrower", 1),
        ("CorporateBorrower", 2),
        ("IndividualBorrower", 2),
        ("Receiver", 1),
    ]


@pytest.mark.parametrize("root, rounds", [("top", 14), ("c0", 13), ("plain", 2)])
def test_a_cycle_stops_the_walk_in_the_round_it_closes(spark, monkeypatch, root, rounds):
    links = [(f"c{(i + 1) % 12}", f"c{i}") for i in range(12)] + [("c0", "top")]
    links += [(f"leaf{i}", "plain") for i in range(27)]
    calls = []
    cut = tx.cut_lineage
    monkeypatch.setattr(tx, "cut_lineage", lambda df: calls.append(1) or cut(df))
    tree = edges(spark, *links)
    if root == "plain":
        assert tx.descendants_of(tree, root).count() == 27
    else:
        with pytest.raises(ValueError, match="c[01] is met twice"):
            tx.descendants_of(tree, root)
    assert len(calls) - 1 <= rounds


def test_two_parents_stop_the_walk(spark):
    tree = edges(spark, ("a", "r"), ("b", "r"), ("c", "a"), ("c", "b"))
    with pytest.raises(ValueError, match="c is met twice"):
        tx.descendants_of(tree, "r")
    assert tx.descendants_of(tree, "c").count() == tx.descendants_of(tree, "nobody").count() == 0


def test_nearest_attribute_wins(spark):
    attributes = spark.createDataFrame(
        [
            ("Counterparty", "name", "top"),
            ("Counterparty", "country", "top"),
            ("Borrower", "country", "middle"),
            ("CorporateBorrower", "country", "own"),
            ("Alone", "x", "1"),
        ],
        "node string, name string, value string",
    )
    found = rows(tx.effective_attributes(edges(spark, *TREE), attributes))
    assert ("Borrower", "name", "top") in found
    assert ("IndividualBorrower", "country", "middle") in found
    assert ("CorporateBorrower", "country", "own") in found
    assert ("Receiver", "country", "top") in found
    assert ("Alone", "x", "1") in found
    assert len(found) == len({r[:2] for r in found}) == 11


def test_flatten(spark):
    tree = edges(spark, *TREE)
    chosen = spark.createDataFrame([("Borrower", 0), ("Loan", 1)], "root string, position int")
    homes = tx.root_of(tree, chosen)
    names = spark.createDataFrame(
        [(n,) for n in {x for p in TREE for x in p if x}], "name string"
    )
    assert rows(tx.flatten_classes(names, homes)) == [
        ("Borrower",),
        ("Counterparty",),
        ("Loan",),
        ("Receiver",),
    ]
    attributes = spark.createDataFrame(
        [("PersonalLoan", "rate", "b"), ("Loan", "rate", "a"), ("IndividualBorrower", "born", "d")],
        "node string, name string, value string",
    )
    assert rows(tx.flatten_attributes(attributes, homes)) == [
        ("Borrower", "born", "d"),
        ("Loan", "rate", "a"),
    ]
    relations = spark.createDataFrame(
        [("has", "PersonalLoan", "IndividualBorrower"), ("has", "Loan", "Borrower")],
        "name string, domain string, range string",
    )
    assert rows(tx.flatten_relations(relations, homes)) == [("has", "Loan", "Borrower")]


def test_last_of_nested_roots_wins(spark):
    tree = edges(spark, *TREE)
    for order, home in ((("Counterparty", "Borrower"), "Borrower"), (("Borrower", "Counterparty"), "Counterparty")):
        chosen = spark.createDataFrame(list(zip(order, (0, 1))), "root string, position int")
        found = dict(rows(tx.root_of(tree, chosen)))
        assert found["CorporateBorrower"] == home and found["Borrower"] == "Counterparty"


def test_topmost_roots(spark):
    assert dict(rows(tx.root_of(edges(spark, *TREE))))["CorporateBorrower"] == "Counterparty"


BASE = "http://example.org/risk#"


@pytest.fixture(scope="module")
def triples(spark):
    def a(kind):
        return tx.RDF_TYPE, tx.OWL + kind

    data = [
        (BASE + "Party", *a("Class")),
        (BASE + "Party", tx.RDFS + "subClassOf", tx.OWL + "Thing"),
        (BASE + "Person", *a("Class")),
        (BASE + "Person", tx.RDFS + "subClassOf", BASE + "Party"),
        (BASE + "Person", tx.RDFS + "comment", "someone"),
        ("http://example.org/Plain", *a("Class")),
        (BASE + "owns", *a("ObjectProperty")),
        (BASE + "owns", *a("FunctionalProperty")),
        (BASE + "owns", tx.RDFS + "domain", BASE + "Person"),
        (BASE + "owns", tx.RDFS + "range", BASE + "Party"),
        (BASE + "owns", tx.OWL + "inverseOf", BASE + "ownedBy"),
        (BASE + "age", *a("DatatypeProperty")),
        (BASE + "owns", tx.OWL + "propertyDisjointWith", BASE + "rents"),
        (BASE + "owns", tx.OWL + "propertyDisjointWith", BASE + "leases"),
        (BASE + "owns", tx.OWL + "propertyDisjointWith", BASE + "leases"),
        (BASE + "age", tx.RDFS + "comment", "EBA 1.2"),
        (BASE + "age", tx.RDFS + "comment", "in years"),
        (BASE + "age", tx.RDFS + "comment", "with decimals"),
        (BASE + "mood", tx.RDFS + "comment", "EBA 12.4"),
        (BASE + "mood", tx.RDFS + "comment", "EBA 12.3"),
        (BASE + "age", tx.RDFS + "domain", BASE + "Person"),
        (BASE + "age", tx.RDFS + "range", tx.XSD + "integer"),
        (BASE + "mood", *a("DatatypeProperty")),
        (BASE + "mood", tx.RDFS + "domain", BASE + "Person"),
        (BASE + "mood", tx.RDFS + "range", "_:enumeration"),
        (BASE + "loose", *a("DatatypeProperty")),
        (BASE + "Critical", *a("DatatypeProperty")),
        (BASE + "Critical", tx.RDFS + "domain", BASE + "Person"),
        ("_:r", *a("Restriction")),
        ("_:u", tx.OWL + "unionOf", "_:list"),
        (BASE + "owns", *a("TransitiveProperty")),
        (BASE + "owns", tx.RDFS + "subPropertyOf", BASE + "has"),
    ]
    return spark.createDataFrame(data, "s string, p string, o string")


def test_classes_from_triples(triples):
    assert rows(tx.classes(triples)) == [
        ("Party", None, ""),
        ("Person", "Party", "someone"),
        ("Plain", None, ""),
    ]


def test_properties_from_triples(spark, triples):
    found = tx.object_properties(triples)
    assert rows(found) == [("owns", "Person", "Party", "ownedBy", True, ["leases", "rents"])]
    assert rows(tx.datatype_properties(triples)) == [
        ("age", "Person", "xsd:integer", "BigInt", "in years"),
        ("mood", "Person", "xsd:string", "String", "EBA 12.3"),
    ]
    back = spark.createDataFrame([("leases", ["owns"]), ("rents", [])], "name string, disjoint_with array<string>")
    both = found.select("name", "disjoint_with").union(back)
    assert rows(tx.disjoint_pairs(both)) == [("leases", "owns"), ("owns", "rents")]


def test_unsupported(triples):
    assert dict(rows(tx.unsupported_uses(triples))) == {
        tx.OWL + "Restriction": 1,
        tx.OWL + "TransitiveProperty": 1,
        tx.OWL + "unionOf": 1,
        tx.RDFS + "subPropertyOf": 1,
    }


def test_mapping_report(spark):
    def names(*values):
        return spark.createDataFrame([(v,) for v in values], "name string")

    relations = spark.createDataFrame(
        [("r1", "A", "B"), ("r2", "A", "Z"), ("r3", "B", "A")],
        "name string, domain string, range string",
    )
    report = tx.mapping_report(names("A", "B", "C"), relations, names("A", "B"), names("r1"))
    assert rows(report) == [
        ("unmapped_class", "C"),
        ("unmapped_relation", "r2"),
        ("unresolved_context", "r3"),
    ]
    with pytest.raises(ValueError, match="unmapped_class C"):
        tx.require_clean(report)
    tx.require_clean(report.where("issue = 'none'"))
