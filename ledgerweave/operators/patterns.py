"""Pattern matching over a graph: rows of variable bindings, joined hop by hop.

A variable ``x`` is a column ``x`` with the node key; its properties are columns
``x_<property>``. Filters run on the node or edge table before any join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators.graph import Graph, all_set, key_of


@dataclass(frozen=True)
class To:
    """Where a hop leads: the edge and what is wanted of the far node."""

    edge: str
    props: Sequence[str] = ()
    where: Column | None = None


def _bound(var: str, props: Sequence[str]) -> list[Column]:
    return [F.col("node_id").alias(var), *[F.col(p).alias(f"{var}_{p}") for p in props]]


def _rows_with_ends(
    graph: Graph, label: str, ends: Mapping[str, tuple[str, ...]], where: Column | None
) -> DataFrame:
    """Nodes of ``label`` with the nodes that their own reference columns lead to.

    ``ends`` maps a name to those columns. Rows that lack a reference are left out.
    """
    home = graph.spec.nodes[label]
    table = graph.tables[home.table]
    far = []
    for end, columns in ends.items():
        table = table.where(all_set(columns))
        far.append(key_of(columns).alias(f"__{end}"))
    rows = table.select(
        key_of(home.key).alias("node_id"),
        *[F.col(c).alias(name) for name, c in home.properties.items()],
        *far,
    )
    return rows if where is None else rows.where(where)


def _arrive(
    graph: Graph, rows: DataFrame, edge: str, label: str, var: str, to: To
) -> DataFrame:
    """Keep rows whose ``var`` is a node of ``label``; add its properties."""
    if not to.props and to.where is None:
        if edge in graph.verified:
            return rows
        return rows.join(graph.nodes(label).select(F.col("node_id").alias(var)), var, "left_semi")
    return rows.join(match(graph, label, var, to.props, to.where), var)


def match(
    graph: Graph,
    label: str,
    var: str,
    props: Sequence[str] = (),
    where: Column | None = None,
    follow: Mapping[str, To] | None = None,
) -> DataFrame:
    """Nodes of one label, and the edges in ``follow`` (variable -> hop) out of them.

    Edges that are reference columns of the node's own table are read off the same
    row, so several of them cost one scan and no self-join. A node without one of
    the edges yields no row.
    """
    follow = follow or {}
    for to in follow.values():
        if graph.spec.edges[to.edge].source != label:
            raise ValueError(f"{to.edge} does not start at {label}")
    near = {end: to for end, to in follow.items() if graph.spec.in_source_row(to.edge)}
    ends = {end: graph.spec.edges[to.edge].target_key for end, to in near.items()}
    rows = _rows_with_ends(graph, label, ends, where)
    rows = rows.select(*_bound(var, props), *[F.col(f"__{end}").alias(end) for end in near])
    for end, to in follow.items():
        if end in near:
            rows = _arrive(graph, rows, to.edge, graph.spec.edges[to.edge].target, end, to)
        else:
            rows = expand(graph, rows, var, end, to)
    return rows


def expand(
    graph: Graph,
    rows: DataFrame,
    at: str,
    var: str,
    to: To,
    reverse: bool = False,
    edge_props: Sequence[str] = (),
    edge_where: Column | None = None,
) -> DataFrame:
    """Follow an edge from variable ``at`` to variable ``var``.

    Edge properties become columns ``<edge>_<property>``. Where the far node's own
    row holds the reference, its properties come along without another join.
    """
    edge = graph.spec.edges[to.edge]
    near, far = ("dst", "src") if reverse else ("src", "dst")
    label = edge.source if reverse else edge.target
    in_far_row = graph.spec.in_source_row if reverse else graph.spec.in_target_row
    if in_far_row(to.edge) and not edge_props and edge_where is None:
        back = edge.target_key if reverse else edge.source_key
        hops = _rows_with_ends(graph, label, {at: back}, to.where)
        return rows.join(hops.select(F.col(f"__{at}").alias(at), *_bound(var, to.props)), at)
    hops = graph.edges(to.edge)
    hops = hops if edge_where is None else hops.where(edge_where)
    hops = hops.select(
        F.col(near).alias(at),
        F.col(far).alias(var),
        *[F.col(p).alias(f"{to.edge}_{p}") for p in edge_props],
    )
    return _arrive(graph, rows.join(hops, at), to.edge, label, var, to)


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows; end ``order`` with a key so that ties are settled."""
    return rows.orderBy(*order).limit(n)
