"""Class hierarchies as tables: closure, inheritance, flattening, triples.

In a taxonomy most nodes are leaves. The iterative work is done on the nodes that
have children; every leaf then takes one join with what its parent already knows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.schema import XSD_TO_VALUE_TYPE, looked_up
from ledgerweave.session import cut_lineage


def children_of(links: DataFrame, parent: str) -> DataFrame:
    return links.where(F.col("parent") == parent).select("child")


def _links(edges: DataFrame) -> DataFrame:
    return edges.select("child", "parent").where(
        F.col("child").isNotNull() & F.col("parent").isNotNull()
    )


def _upward(links: DataFrame) -> DataFrame:
    """(node, ancestor, depth) for every node with children, itself at depth 0.

    Each round doubles the distance covered. A node that turns up among its own
    ancestors would never end the loop; it is reported instead.
    """
    parents = links.select(F.col("parent").alias("node")).distinct()
    reach = cut_lineage(
        links.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"))
        .join(parents, "node", "left_semi")
        .withColumn("depth", F.lit(1))
    )
    _no_cycle(reach)
    span = 1
    while True:
        longest = reach.where(F.col("depth") == span)
        further = reach.select(
            F.col("node").alias("ancestor"),
            F.col("ancestor").alias("beyond"),
            F.col("depth").alias("more"),
        )
        found = cut_lineage(
            longest.join(further, "ancestor").select(
                "node",
                F.col("beyond").alias("ancestor"),
                (F.col("depth") + F.col("more")).alias("depth"),
            )
        )
        if found.isEmpty():
            break
        _no_cycle(found)
        reach = cut_lineage(reach.unionByName(found))
        span *= 2
    own = parents.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    return own.unionByName(reach)


def _no_cycle(reach: DataFrame) -> None:
    loop = reach.where(F.col("node") == F.col("ancestor")).select("node").first()
    if loop is not None:
        raise ValueError(f"{loop.node} is its own ancestor")


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth) from (child, parent), any depth; one parent per child."""
    links = _links(edges)
    upward = _upward(links).withColumnRenamed("node", "parent")
    return links.join(upward, "parent").select(
        F.col("child").alias("node"), "ancestor", (F.col("depth") + 1).alias("depth")
    )


def descendants_of(edges: DataFrame, root: str) -> DataFrame:
    """(node, depth) below ``root``, walked down level by level from it.

    Each level is looked up among all that was met before, so the rounds number with the levels.
    A child has one parent; a node that is met twice, as on a cycle, stops the walk at once.
    """
    links = cut_lineage(_links(edges).distinct())
    start = links.where(F.col("parent") == root).select(F.col("parent").alias("node")).distinct()
    levels = [start.withColumn("depth", F.lit(0))]
    while True:
        frontier = levels[-1].select(F.col("node").alias("parent"))
        met = links.join(frontier, "parent").groupBy(F.col("child").alias("node")).agg(F.count("*").alias("times"))
        seen = reduce(DataFrame.unionByName, levels).select("node", F.lit(True).alias("before"))
        level = cut_lineage(met.join(seen, "node", "left"))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels).where(F.col("depth") > 0)
        twice = level.where(F.col("before") | (F.col("times") > 1)).select("node").first()
        if twice is not None:
            raise ValueError(f"{twice.node} is met twice below {root}: it is its own ancestor or has two parents")
        levels.append(level.select("node", F.lit(len(levels)).alias("depth")))


def effective_attributes(edges: DataFrame, attributes: DataFrame) -> DataFrame:
    """(node, name, value): own attributes and inherited ones, the nearest wins.

    ``attributes`` holds (node, name, value). Several values of one node count as
    the least of them.
    """
    links = _links(edges)
    known = (
        _upward(links)
        .join(attributes.withColumnRenamed("node", "ancestor"), "ancestor")
        .groupBy("node", "name")
        .agg(F.min(F.struct("depth", "value"))["value"].alias("value"))
    )
    inherited = links.join(known.withColumnRenamed("node", "parent"), "parent").select(
        F.col("child").alias("node"), F.lit(1).alias("rank"), "name", "value"
    )
    own = attributes.select("node", F.lit(0).alias("rank"), "name", "value")
    return (
        own.unionByName(inherited)
        .groupBy("node", "name")
        .agg(F.min(F.struct("rank", "value"))["value"].alias("value"))
    )


def roots(edges: DataFrame) -> DataFrame:
    """(root, position): the nodes without a parent."""
    links = _links(edges)
    tops = links.select(F.col("parent").alias("root")).distinct()
    tops = tops.join(links.select(F.col("child").alias("root")), "root", "left_anti")
    return tops.withColumn("position", F.lit(0))


def root_of(edges: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(node, root) for every descendant of a root.

    ``chosen`` holds (root, position); with nested roots the one of the highest
    position wins. Without it the topmost nodes are the roots.
    """
    links = cut_lineage(_links(edges).distinct())
    chosen = roots(edges) if chosen is None else chosen
    # One row per node with children: the best root seen so far, itself included, and the
    # node as far up as rounds have come. Each round doubles that distance.
    inner = links.select(F.col("parent").alias("node")).distinct()
    named = chosen.select(F.col("root").alias("node"), F.struct("position", F.col("root").alias("name")).alias("best"))
    named = named.groupBy("node").agg(F.max("best").alias("best"))
    above = links.select(F.col("child").alias("node"), F.col("parent").alias("up"))
    seen = cut_lineage(inner.join(named, "node", "left").join(above, "node", "left"))
    distance, size = 1, seen.count()
    while (open_ := seen.where(F.col("up").isNotNull()).select("up").first()) is not None:
        if distance > size:
            raise ValueError(f"{open_.up} is its own ancestor")
        higher = seen.select(
            F.col("node").alias("up"), F.col("best").alias("higher"), F.col("up").alias("further")
        )
        seen = cut_lineage(
            seen.join(higher, "up", "left").select(
                "node", F.greatest("best", "higher").alias("best"), F.col("further").alias("up")
            )
        )
        distance *= 2
    known = seen.where(F.col("best").isNotNull()).groupBy(F.col("node").alias("parent"))
    known = cut_lineage(known.agg(F.max("best")["name"].alias("root")))
    # Two plain tables: Spark can split a parent with very many children.
    return links.join(known, "parent").select(F.col("child").alias("node"), "root")


def _homed(rows: DataFrame, column: str, homes: DataFrame) -> DataFrame:
    """``column`` replaced by its root where it has one."""
    to_root = homes.select(F.col("node").alias(column), F.col("root").alias("__root"))
    return rows.join(to_root, column, "left").withColumn(
        column, F.coalesce("__root", column)
    ).drop("__root")


def flatten_classes(classes: DataFrame, homes: DataFrame) -> DataFrame:
    """The classes that remain when every descendant of a root is folded into it."""
    return classes.join(homes.select(F.col("node").alias("name")), "name", "left_anti")


def flatten_attributes(attributes: DataFrame, homes: DataFrame) -> DataFrame:
    """(node, name, value) at the roots, one row per (node, name)."""
    return (
        _homed(attributes, "node", homes)
        .groupBy("node", "name")
        .agg(F.min("value").alias("value"))
    )


def flatten_relations(relations: DataFrame, homes: DataFrame) -> DataFrame:
    """(name, domain, range) with both ends at the roots, each once."""
    return _homed(_homed(relations, "domain", homes), "range", homes).select(
        "name", "domain", "range"
    ).distinct()


# -- Triples -----------------------------------------------------------------

# Vocabulary of the triples, and names that only annotate others.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
ANNOTATION_NAMES = (
    "DataAttribute",
    "Confidentiality",
    "Confidential",
    "NonConfidential",
    "VariableConfidentiality",
    "Importance",
    "Critical",
    "Important",
    "Moderate",
    "Temporality",
    "Current",
    "Future",
    "Historical",
    "Variability",
    "Dynamic",
    "Static",
)
REFERENCE_COMMENT = "EBA"
UNSUPPORTED_PREDICATES = (
    OWL + "Restriction",
    OWL + "intersectionOf",
    OWL + "unionOf",
    OWL + "complementOf",
    OWL + "equivalentClass",
    RDFS + "subPropertyOf",
)
UNSUPPORTED_TYPES = (
    OWL + "Restriction",
    OWL + "intersectionOf",
    OWL + "unionOf",
    OWL + "complementOf",
    OWL + "equivalentClass",
    OWL + "TransitiveProperty",
    OWL + "SymmetricProperty",
    OWL + "AsymmetricProperty",
    OWL + "ReflexiveProperty",
    OWL + "IrreflexiveProperty",
)


def local_name(iri: Column) -> Column:
    """What follows the last '#', or the last '/' when there is no '#'."""
    return F.when(F.contains(iri, F.lit("#")), F.substring_index(iri, "#", -1)).otherwise(
        F.substring_index(iri, "/", -1)
    )


def subject_rows(
    triples: DataFrame,
    predicates: Mapping[str, str],
    required: Sequence[str] = (),
    lists: Mapping[str, str] | None = None,
    rather_not: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per subject of (s, p, o), one column per predicate.

    Of several objects the least is taken; where ``rather_not`` gives a column a prefix, the
    least that does not begin with it, or else the least. ``lists`` are columns that keep all
    objects, sorted, each once, and none as an empty list. Subjects without a ``required``
    column are left out. The predicates are given, so the data is not scanned for them.
    """
    lists, rather_not = lists or {}, rather_not or {}

    def least(column: str, predicate: str) -> Column:
        ours = F.col("p") == predicate
        found = F.min(F.when(ours, F.col("o")))
        if column in rather_not:
            wanted = ours & ~F.startswith("o", F.lit(rather_not[column]))
            found = F.coalesce(F.min(F.when(wanted, F.col("o"))), found)
        return found.alias(column)

    every = {c: F.sort_array(F.collect_set(F.when(F.col("p") == p, F.col("o")))) for c, p in lists.items()}
    rows = (
        triples.where(F.col("p").isin(*predicates.values(), *lists.values()))
        .groupBy(F.col("s").alias("subject"))
        .agg(*[least(c, p) for c, p in predicates.items()], *[v.alias(c) for c, v in every.items()])
    )
    return rows.dropna(subset=list(required)) if required else rows


def _typed_subjects(triples: DataFrame, kind: str) -> DataFrame:
    is_kind = (F.col("p") == RDF_TYPE) & (F.col("o") == OWL + kind)
    return triples.where(is_kind).select(F.col("s").alias("subject")).distinct()


def _described(triples: DataFrame, kind: str, predicates: Mapping[str, str], **more) -> DataFrame:
    rows = _typed_subjects(triples, kind).join(subject_rows(triples, predicates, **more), "subject", "left")
    return rows.withColumn("name", local_name(F.col("subject"))).where(F.col("name") != "")


def classes(triples: DataFrame) -> DataFrame:
    """(name, parent, comment); the universal class is no parent."""
    rows = _described(
        triples, "Class", {"parent": RDFS + "subClassOf", "comment": RDFS + "comment"}
    )
    parent = F.when(~F.contains("parent", F.lit("owl#Thing")), local_name(F.col("parent")))
    return rows.where(~F.col("name").startswith("http")).select(
        "name", parent.alias("parent"), F.coalesce("comment", F.lit("")).alias("comment")
    )


def object_properties(triples: DataFrame) -> DataFrame:
    """(name, domain, range, inverse, is_functional, disjoint_with); the last is a sorted list of names."""
    rows = _described(
        triples,
        "ObjectProperty",
        {"domain": RDFS + "domain", "range": RDFS + "range", "inverse": OWL + "inverseOf"},
        lists={"disjoint": OWL + "propertyDisjointWith"},
    )
    functional = _typed_subjects(triples, "FunctionalProperty").withColumn("f", F.lit(True))
    disjoint = F.coalesce("disjoint", F.array().cast("array<string>"))
    return rows.join(functional, "subject", "left").select(
        "name",
        local_name(F.col("domain")).alias("domain"),
        local_name(F.col("range")).alias("range"),
        local_name(F.col("inverse")).alias("inverse"),
        F.coalesce("f", F.lit(False)).alias("is_functional"),
        F.array_sort(F.array_distinct(F.transform(disjoint, local_name))).alias("disjoint_with"),
    )


def disjoint_pairs(properties: DataFrame) -> DataFrame:
    """(one, other) of properties declared disjoint, from either side, each pair once."""
    pairs = properties.select("name", F.explode("disjoint_with").alias("with"))
    return pairs.select(F.least("name", "with").alias("one"), F.greatest("name", "with").alias("other")).distinct()


def datatype_properties(triples: DataFrame) -> DataFrame:
    """(name, domain, xsd, value_type, comment); annotations and properties without a domain are no data.

    A comment that says something is preferred to one that only refers to a document.
    """
    rows = _described(
        triples,
        "DatatypeProperty",
        {"domain": RDFS + "domain", "range": RDFS + "range", "comment": RDFS + "comment"},
        rather_not={"comment": REFERENCE_COMMENT},
    )
    xsd = F.when(
        F.col("range").startswith(XSD), F.concat(F.lit("xsd:"), F.substring_index("range", "#", -1))
    ).otherwise(F.lit("xsd:string"))
    rows = rows.where(F.col("domain").isNotNull() & ~F.col("name").isin(*ANNOTATION_NAMES))
    return rows.select(
        "name",
        local_name(F.col("domain")).alias("domain"),
        xsd.alias("xsd"),
        looked_up(XSD_TO_VALUE_TYPE, xsd, "String").alias("value_type"),
        F.coalesce("comment", F.lit("")).alias("comment"),
    )


def predicate_uses(triples: DataFrame) -> DataFrame:
    """(predicate, uses)."""
    return triples.groupBy(F.col("p").alias("predicate")).agg(F.count("*").alias("uses"))


def unsupported_uses(triples: DataFrame) -> DataFrame:
    """(construct, uses) of constructs that tables cannot carry, in one pass."""
    is_type = F.col("p") == RDF_TYPE
    construct = F.when(F.col("p").isin(*UNSUPPORTED_PREDICATES), F.col("p")).when(
        is_type & F.col("o").isin(*UNSUPPORTED_TYPES), F.col("o")
    )
    return (
        triples.select(construct.alias("construct"))
        .where(F.col("construct").isNotNull())
        .groupBy("construct")
        .agg(F.count("*").alias("uses"))
    )


# -- Coverage of a mapping ----------------------------------------------------


def unmapped(names: DataFrame, known: DataFrame, issue: str) -> DataFrame:
    """(issue, name): the names that no known one matches; both have column ``name``."""
    known = known.select("name").distinct()
    missing = names.select("name").distinct().join(known, "name", "left_anti")
    return missing.select(F.lit(issue).alias("issue"), "name")


def mapping_report(
    class_names: DataFrame, relations: DataFrame, mapped: DataFrame, with_context: DataFrame
) -> DataFrame:
    """(issue, name) of classes without a table, relations with an end that has none,
    and relations between mapped classes that no table holds.

    ``mapped`` lists each class once. It joins the ends as it is: between two plain
    shuffles Spark can split the share of a class that most relations end at.
    """
    here = mapped.select("name")
    ends = relations.select("name", F.explode(F.array("domain", "range")).alias("end"))
    loose = ends.join(here.withColumnRenamed("name", "end"), "end", "left_anti")
    whole = relations.select("name").distinct().join(
        loose.select("name").distinct(), "name", "left_anti"
    )
    return (
        unmapped(class_names, here, "unmapped_class")
        .unionByName(
            loose.select(F.lit("unmapped_relation").alias("issue"), "name").distinct()
        )
        .unionByName(unmapped(whole, with_context, "unresolved_context"))
    )


def require_clean(report: DataFrame) -> None:
    """Strict mode: any issue stops the job; all are counted, the first few are named."""
    issues = report.orderBy("issue", "name").limit(20).collect()
    if issues:
        listed = "; ".join(f"{i.issue} {i.name}" for i in issues)
        raise ValueError(f"mapping is incomplete, {report.count()} issues: {listed}")
