"""The recurring query shapes over a graph, free of any one domain's names.

What can be counted or made distinct before a shuffle is: a hub node then costs
each task one row instead of all its edges.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators.graph import Graph
from ledgerweave.operators.patterns import To, match, top


def node_total(graph: Graph, alias: str) -> DataFrame:
    """How many nodes there are, all labels together; no keys are read."""
    counts = [
        graph.nodes(label).groupBy().agg(F.count("*").alias("n")) for label in graph.spec.nodes
    ]
    return reduce(DataFrame.unionByName, counts).agg(F.sum("n").alias(alias))


def nodes_by(graph: Graph, label: str, prop: str, by: str, alias: str) -> DataFrame:
    """Nodes per property value; a missing value is a group of its own."""
    return (
        graph.nodes(label)
        .groupBy(F.col(prop).alias(by))
        .agg(F.count("*").alias(alias))
        .orderBy(F.desc(alias), by)
    )


def linked_targets(graph: Graph, edge: str, where: Column, alias: str) -> DataFrame:
    """How many different targets the sources that satisfy ``where`` link to."""
    spec = graph.spec.edges[edge]
    sources = graph.nodes(spec.source).where(where).select(F.col("node_id").alias("src"))
    targets = graph.edges(edge).join(sources, "src", "left_semi").select("dst").distinct()
    if edge not in graph.verified:
        known = graph.nodes(spec.target).select(F.col("node_id").alias("dst"))
        targets = targets.join(known, "dst", "left_semi")
    return targets.agg(F.count("*").alias(alias))


def _matched_edges(graph: Graph, edge: str) -> DataFrame:
    """Edges whose source is a node. A reference column proves its own node; the rows
    of a link table are looked up."""
    edges = graph.edges(edge)
    if graph.spec.in_source_row(edge) or edge in graph.verified:
        return edges
    sources = graph.nodes(graph.spec.edges[edge].source).select(F.col("node_id").alias("src"))
    return edges.join(sources, "src", "left_semi")


def sources_by_target(graph: Graph, edge: str, prop: str, by: str, alias: str) -> DataFrame:
    """Sources per property value of the node they point to."""
    per_target = _matched_edges(graph, edge).groupBy("dst").agg(F.count("*").alias("n"))
    return _by_target(graph, edge, per_target, prop, by, alias)


def sum_by_target(
    graph: Graph, edge: str, measure: Column, prop: str, by: str, alias: str
) -> DataFrame:
    """Sum of an edge measure per property value of the target node."""
    per_target = _matched_edges(graph, edge).groupBy("dst").agg(F.sum(measure).alias("n"))
    return _by_target(graph, edge, per_target, prop, by, alias)


def _by_target(
    graph: Graph, edge: str, per_target: DataFrame, prop: str, by: str, alias: str
) -> DataFrame:
    target = graph.nodes(graph.spec.edges[edge].target).select(
        F.col("node_id").alias("dst"), F.col(prop).alias(by)
    )
    return (
        per_target.join(target, "dst")
        .groupBy(by)
        .agg(F.sum("n").alias(alias))
        .orderBy(F.desc(alias), by)
    )


def rollup_of_members(
    graph: Graph, membership: str, link: str, prop: str, by: str, alias: str
) -> DataFrame:
    """Different things linked to the members of each group.

    ``membership`` leads from member to group, ``link`` from member to thing.
    Pairs are made distinct before the things are looked up, so neither a huge
    group nor a thing with very many links makes a hot join key.
    """
    spec = graph.spec
    member = spec.edges[membership].source
    members = match(graph, member, "src", follow={"g": To(membership, [prop])})
    pairs = (
        graph.edges(link)
        .join(members, "src")
        .select(F.col(f"g_{prop}").alias(by), F.col("dst"))
        .distinct()
    )
    if link not in graph.verified:
        things = graph.nodes(spec.edges[link].target).select(F.col("node_id").alias("dst"))
        pairs = pairs.join(things, "dst", "left_semi")
    return pairs.groupBy(by).agg(F.count("*").alias(alias)).orderBy(F.desc(alias), by)


def conditional_sums(
    rows: DataFrame, measure: Column, parts: Mapping[str, Column | None]
) -> DataFrame:
    """Several sums of one measure in one pass; a part without condition is the total."""
    zero = F.lit(0)
    return rows.agg(
        *[
            F.sum(measure if when is None else F.when(when, measure).otherwise(zero)).alias(alias)
            for alias, when in parts.items()
        ]
    )


def busiest_sources(
    graph: Graph, edge: str, edge_where: Column, by: str, alias: str, n: int
) -> DataFrame:
    """The ``n`` sources with the most edges that satisfy ``edge_where``.

    Edges are counted per (source, target) first; the targets are then looked up
    once per pair and not once per edge.
    """
    spec = graph.spec.edges[edge]
    pairs = graph.edges(edge).where(edge_where).groupBy("src", "dst").agg(F.count("*").alias("n"))
    if edge not in graph.verified:
        targets = graph.nodes(spec.target).select(F.col("node_id").alias("dst"))
        pairs = pairs.join(targets, "dst", "left_semi")
    counts = pairs.groupBy(F.col("src").alias(by)).agg(F.sum("n").alias(alias))
    if edge not in graph.verified:
        sources = graph.nodes(spec.source).select(F.col("node_id").alias(by))
        counts = counts.join(sources, by, "left_semi")
    return top(counts, n, F.desc(alias), F.asc(by))
