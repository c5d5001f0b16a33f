"""A typed property graph over tables: nodes and edges are lazy projections."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.schema import TableContract


@dataclass(frozen=True)
class NodeSpec:
    """A node label: its table, key columns and properties (name -> column)."""

    table: str
    key: tuple[str, ...]
    properties: Mapping[str, str]

    @property
    def display(self) -> str:
        return self.key[0]


@dataclass(frozen=True)
class EdgeSpec:
    """A directed edge: the table that holds it and its key columns at both ends."""

    source: str
    target: str
    table: str
    source_key: tuple[str, ...]
    target_key: tuple[str, ...]
    properties: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class SeriesSpec:
    """Readings of a node over time: the table, the key of the node they belong to,
    the instant, and the read properties (name -> column)."""

    label: str
    table: str
    key: tuple[str, ...]
    instant: str
    properties: Mapping[str, str]


@dataclass(frozen=True)
class GraphSpec:
    nodes: Mapping[str, NodeSpec]
    edges: Mapping[str, EdgeSpec]
    series: Mapping[str, SeriesSpec] = field(default_factory=dict)

    def in_source_row(self, edge: str) -> bool:
        """The edge is a reference column of its source node's own table."""
        spec = self.edges[edge]
        home = self.nodes[spec.source]
        return spec.table == home.table and spec.source_key == home.key

    def in_target_row(self, edge: str) -> bool:
        spec = self.edges[edge]
        home = self.nodes[spec.target]
        return spec.table == home.table and spec.target_key == home.key


def key_of(columns: Iterable[str]) -> Column:
    names = list(columns)
    return F.col(names[0]) if len(names) == 1 else F.struct(*names)


def all_set(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


class Graph:
    """A graph spec bound to tables.

    ``verified`` names edges whose references were checked and found whole; their
    far ends need no join unless a property is asked for.
    """

    def __init__(
        self,
        spec: GraphSpec,
        tables: Mapping[str, DataFrame],
        verified: Iterable[str] = (),
    ):
        self.spec = spec
        self.tables = tables
        self.verified = frozenset(verified)

    def nodes(self, label: str) -> DataFrame:
        """(node_id, properties...) of one label."""
        spec = self.spec.nodes[label]
        return self.tables[spec.table].select(
            key_of(spec.key).alias("node_id"),
            *[F.col(c).alias(name) for name, c in spec.properties.items()],
        )

    def edges(self, name: str) -> DataFrame:
        """(src, dst, properties...); a reference that is not set is no edge."""
        spec = self.spec.edges[name]
        return (
            self.tables[spec.table]
            .where(all_set(spec.source_key) & all_set(spec.target_key))
            .select(
                key_of(spec.source_key).alias("src"),
                key_of(spec.target_key).alias("dst"),
                *[F.col(c).alias(p) for p, c in spec.properties.items()],
            )
        )

    def series(self, name: str) -> DataFrame:
        """(node_id, instant, properties...) of one time series."""
        spec = self.spec.series[name]
        return (
            self.tables[spec.table]
            .where(all_set(spec.key) & F.col(spec.instant).isNotNull())
            .select(
                key_of(spec.key).alias("node_id"),
                F.col(spec.instant).alias("instant"),
                *[F.col(c).alias(p) for p, c in spec.properties.items()],
            )
        )

    def all_nodes(self) -> DataFrame:
        """(label, node_id as text) of every label."""
        views = [
            self.nodes(label).select(
                F.lit(label).alias("label"), F.col("node_id").cast("string").alias("node_id")
            )
            for label in self.spec.nodes
        ]
        return reduce(DataFrame.unionByName, views)

    def label_summary(self) -> DataFrame:
        """(label, n, least, greatest) per label that has nodes; aggregated label by label,
        so no key is sorted or shuffled."""
        found = []
        for label in self.spec.nodes:
            node = F.col("node_id").cast("string")
            ends = self.nodes(label).agg(
                F.count("*").alias("n"), F.min(node).alias("least"), F.max(node).alias("greatest")
            )
            found.append(ends.where(F.col("n") > 0).select(F.lit(label).alias("label"), "n", "least", "greatest"))
        return reduce(DataFrame.unionByName, found)

    def edge_summary(self) -> DataFrame:
        """(edge, n, targets) per edge; counted per target before anything moves."""
        counts = []
        for name in self.spec.edges:
            per_target = self.edges(name).groupBy("dst").agg(F.count("*").alias("n"))
            counts.append(
                per_target.agg(
                    F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("targets")
                ).select(F.lit(name).alias("edge"), "n", "targets")
            )
        return reduce(DataFrame.unionByName, counts)

    def write_snapshot(self, folder: str) -> None:
        """The columns that nodes, edges and series take, as Parquet below a new ``folder``.

        Every table is written once, so references stay in their node's row and hops cost
        what they cost on the live tables. Every refresh writes a folder of its own, so
        readers of the one before are not disturbed and a failed refresh replaces nothing.
        """
        for table, columns in _used_columns(self.spec).items():
            self.tables[table].select(*columns).write.parquet(f"{folder}/{table}")


    def publish_snapshot(self, folder: str, version: str) -> None:
        """A snapshot below ``folder`` that becomes the current one when all of it is written.

        The tables go to ``<folder>/<version>``; the last thing written is a row of the
        manifest that names the version, with the rows of each table as read back. Until then,
        and after a write that fails, readers of the current version go on with the one before;
        the same version can then be written again, unless it has become current.
        """
        spark = next(iter(self.tables[t] for t in _used_columns(self.spec))).sparkSession
        known = versions(spark, folder).agg(F.max("number").alias("last"), F.collect_set("version").alias("names")).first()
        if version in known.names:
            raise ValueError(f"{version} is published; a refresh takes a new version")
        sizes = []
        for table, columns in _used_columns(self.spec).items():
            path = f"{folder}/{version}/{table}"
            self.tables[table].select(*columns).write.mode("overwrite").parquet(path)
            sizes.append((table, spark.read.parquet(path).count()))
        row = [((known.last or 0) + 1, version, sizes)]
        spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


MANIFEST = "number long, version string, tables array<struct<table:string,n_rows:long>>"


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """``MANIFEST`` rows of the published snapshots; none before the first."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], MANIFEST)


def current_snapshot(spark: SparkSession, spec: GraphSpec, folder: str, verified: Iterable[str] = ()) -> Graph:
    """The graph of the version that was published last."""
    last = versions(spark, folder).agg(F.max_by("version", "number").alias("version")).first().version
    if last is None:
        raise ValueError(f"{folder} has no published snapshot")
    return snapshot(spark, spec, f"{folder}/{last}", verified)


def _used_columns(spec: GraphSpec) -> dict[str, list[str]]:
    used: dict[str, dict[str, None]] = {}
    for node in spec.nodes.values():
        used.setdefault(node.table, {}).update(dict.fromkeys([*node.key, *node.properties.values()]))
    for edge in spec.edges.values():
        ends = [*edge.source_key, *edge.target_key, *edge.properties.values()]
        used.setdefault(edge.table, {}).update(dict.fromkeys(ends))
    for series in spec.series.values():
        taken = [*series.key, series.instant, *series.properties.values()]
        used.setdefault(series.table, {}).update(dict.fromkeys(taken))
    return {table: list(columns) for table, columns in used.items()}


def snapshot(spark: SparkSession, spec: GraphSpec, path: str, verified: Iterable[str] = ()) -> Graph:
    """The graph as it was when the snapshot was written."""
    tables = {table: spark.read.parquet(f"{path}/{table}") for table in _used_columns(spec)}
    return Graph(spec, tables, verified)


def inverse(edges: DataFrame) -> DataFrame:
    """The same pairs the other way round."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def distinct_pairs(edges: DataFrame) -> DataFrame:
    """One row per (src, dst), however many parallel edges there are."""
    return edges.select("src", "dst").distinct()


def parallel_edges(edges: DataFrame, *by: str) -> DataFrame:
    """(src, dst, by..., multiplicity): how often each edge occurs."""
    return edges.groupBy("src", "dst", *by).agg(F.count("*").alias("multiplicity"))


def snake(name: str) -> str:
    """ExternalCollection -> external_collection."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def node_specs(
    contracts: Mapping[str, TableContract], labels: Mapping[str, str]
) -> dict[str, NodeSpec]:
    """Node labels (label -> table); audit columns are no properties."""
    return {
        label: NodeSpec(
            table, contracts[table].primary_key, {c: c for c in contracts[table].properties}
        )
        for label, table in labels.items()
    }


def reference_edges(
    contracts: Mapping[str, TableContract],
    labels: Mapping[str, str],
    names: Mapping[tuple[str, str], str],
) -> dict[str, EdgeSpec]:
    """An edge for every declared reference between labelled tables.

    ``names`` gives (table, column) its edge name; the others are called
    ``<source>_references_<target>``.
    """
    label_of = {table: label for label, table in labels.items()}
    edges: dict[str, EdgeSpec] = {}
    for label, table in labels.items():
        contract = contracts[table]
        for reference in contract.foreign_keys:
            target = label_of.get(reference.table)
            if target is None:
                continue
            name = names.get(
                (table, reference.column), f"{snake(label)}_references_{snake(target)}"
            )
            if name in edges:
                raise ValueError(f"two edges are called {name}; name one of them")
            edges[name] = EdgeSpec(
                label, target, table, contract.primary_key, (reference.column,)
            )
    return edges


def link_edges(
    contracts: Mapping[str, TableContract],
    labels: Mapping[str, str],
    named: Mapping[str, EdgeSpec],
) -> dict[str, EdgeSpec]:
    """An edge per direction for every link table, unless ``named`` has it already.

    A link table has no label of its own and references to labelled tables. Each of
    these is the target of an edge from the first other one, ``<source>_links_<target>``;
    the remaining columns are its properties.
    """
    label_of = {table: label for label, table in labels.items()}
    taken = {(e.table, e.source_key, e.target_key) for e in named.values()}
    edges: dict[str, EdgeSpec] = {}
    for table, contract in contracts.items():
        ends = [r for r in contract.foreign_keys if r.table in label_of]
        if table in label_of or len(ends) < 2:
            continue
        for target in ends:
            source = next(r for r in ends if r is not target)
            columns = (source.column,), (target.column,)
            name = f"{snake(label_of[source.table])}_links_{snake(label_of[target.table])}"
            if (table, *columns) in taken or name in edges:
                continue
            rest = {c: c for c in contract.columns if (c,) not in columns}
            edges[name] = EdgeSpec(
                label_of[source.table], label_of[target.table], table, *columns, rest
            )
    return edges


def target_edge(
    contracts: Mapping[str, TableContract], labels: Mapping[str, str], table: str, column: str
) -> EdgeSpec:
    """A declared reference read the other way: from the row it names to the row that holds it."""
    label_of = {own: label for label, own in labels.items()}
    contract = contracts[table]
    reference = next(r for r in contract.foreign_keys if r.column == column)
    return EdgeSpec(label_of[reference.table], label_of[table], table, (column,), contract.primary_key)


def declared_references(
    contracts: Mapping[str, TableContract], labels: Mapping[str, str]
) -> dict[tuple[str, str], str]:
    """(table, column) -> the labelled table it refers to, for tables that make edges.

    These are the labelled tables, and link tables: those with references to two or more.
    """
    labelled = set(labels.values())
    found = {}
    for table, contract in contracts.items():
        ends = [r for r in contract.foreign_keys if r.table in labelled]
        if table in labelled or len(ends) > 1:
            found |= {(table, r.column): r.table for r in ends}
    return found


def covered_references(
    declared: Mapping[tuple[str, str], str], labels: Mapping[str, str], edges: Mapping[str, EdgeSpec]
) -> set[tuple[str, str]]:
    """The declared references at an end of an edge that has the label they refer to, whether the
    edge lies in its source's row, its target's, or a link table."""
    found = set()
    for edge in edges.values():
        for label, key in ((edge.source, edge.source_key), (edge.target, edge.target_key)):
            end = edge.table, key[0]
            if len(key) == 1 and end in declared and declared[end] == labels.get(label):
                found.add(end)
    return found


def derived_graph(
    contracts: Mapping[str, TableContract],
    labels: Mapping[str, str],
    named: Mapping[str, EdgeSpec],
    names: Mapping[tuple[str, str], str] | None = None,
) -> GraphSpec:
    """All nodes of ``labels``, the ``named`` edges, and an edge for every reference they do not cover.

    What is not covered is the declared references less those at an end of a named edge, in
    whichever row that edge lies.
    """
    declared = declared_references(contracts, labels)
    open_ = set(declared) - covered_references(declared, labels, named)
    found = dict(named)
    for made in (reference_edges(contracts, labels, names or {}), link_edges(contracts, labels, named)):
        for name, edge in made.items():
            if open_ & covered_references(declared, labels, {name: edge}):
                if name in found:
                    raise ValueError(f"two edges are called {name}; name one of them")
                found[name] = edge
    return GraphSpec(node_specs(contracts, labels), found)


def coverage(
    contracts: Mapping[str, TableContract],
    labels: Mapping[str, str],
    named: Mapping[str, EdgeSpec],
    tables: Mapping[str, DataFrame],
) -> DataFrame:
    """(table, column, refers_to, covered, n_set) of every declared reference, with the rows that set it."""
    declared, found = declared_references(contracts, labels), []
    covered = covered_references(declared, labels, named)
    for table in dict.fromkeys(t for t, _ in declared):
        columns = {c: target for (t, c), target in declared.items() if t == table}
        counts = tables[table].agg(*[F.count(c).alias(c) for c in columns])  # one pass a table
        report = [
            F.struct(
                F.lit(table).alias("table"),
                F.lit(c).alias("column"),
                F.lit(target).alias("refers_to"),
                F.lit((table, c) in covered).alias("covered"),
                F.col(c).alias("n_set"),
            )
            for c, target in columns.items()
        ]
        found.append(counts.select(F.inline(F.array(*report))))
    return reduce(DataFrame.unionByName, found)
