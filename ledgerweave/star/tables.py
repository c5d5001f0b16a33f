"""The star schema as tables, contracts and a graph."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.operators.graph import EdgeSpec, Graph, GraphSpec, NodeSpec, SeriesSpec, derived_graph, target_edge
from ledgerweave.schema import DAY, FLAG, INSTANT, INT, LONG, MONEY, TEXT, Field, TableContract


class Tables(Mapping):
    """Parquet tables of one folder, read when asked for."""

    names = (
        "region",
        "nation",
        "customer",
        "supplier",
        "part",
        "orders",
        "lineitem",
        "events",
        "documents",
        "embeddings",
        "pages",
        "benchmark",
        "labels",
        "conversations",
    )

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __iter__(self):
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


def money(column: str) -> Column:
    """Prices have two decimals; as decimals their sums are exact in any order."""
    return F.col(column).cast("decimal(18,2)")


def wide_money(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(38,2)")


def _node(table: str, key: str | tuple[str, ...], **properties: str) -> NodeSpec:
    return NodeSpec(table, (key,) if isinstance(key, str) else key, properties)


def _edge(source: str, target: str, table: str, src, dst: str, **properties: str) -> EdgeSpec:
    return EdgeSpec(
        source, target, table, (src,) if isinstance(src, str) else src, (dst,), properties
    )


LINE_KEY = ("l_orderkey", "l_linenumber")

SPEC = GraphSpec(
    nodes={
        "Region": _node("region", "r_regionkey", name="r_name"),
        "Nation": _node("nation", "n_nationkey", name="n_name"),
        "Customer": _node(
            "customer", "c_custkey", name="c_name", segment="c_mktsegment", balance="c_acctbal"
        ),
        "Supplier": _node("supplier", "s_suppkey", name="s_name"),
        "Part": _node("part", "p_partkey", name="p_name", kind="p_type"),
        "Order": _node(
            "orders",
            "o_orderkey",
            status="o_orderstatus",
            priority="o_orderpriority",
            total="o_totalprice",
        ),
        "Event": _node("events", "event_id", kind="event_type", value="value"),
        "Line": _node("lineitem", LINE_KEY, role="l_returnflag", state="l_linestatus"),
    },
    edges={
        "nation_in_region": _edge("Nation", "Region", "nation", "n_nationkey", "n_regionkey"),
        "customer_in_nation": _edge(
            "Customer", "Nation", "customer", "c_custkey", "c_nationkey"
        ),
        "supplier_in_nation": _edge(
            "Supplier", "Nation", "supplier", "s_suppkey", "s_nationkey"
        ),
        "order_has_customer": _edge("Order", "Customer", "orders", "o_orderkey", "o_custkey"),
        "order_has_supplier": _edge(
            "Order",
            "Supplier",
            "lineitem",
            "l_orderkey",
            "l_suppkey",
            role="l_returnflag",
        ),
        "supplier_has_order": _edge(
            "Supplier", "Order", "lineitem", "l_suppkey", "l_orderkey", role="l_returnflag"
        ),
        "line_has_supplier": _edge(
            "Line", "Supplier", "lineitem", LINE_KEY, "l_suppkey", amount="l_extendedprice"
        ),
        "line_has_part": _edge("Line", "Part", "lineitem", LINE_KEY, "l_partkey"),
        "event_concerns_customer": _edge("Event", "Customer", "events", "event_id", "user_id"),
    },
    series={
        "customer_events": SeriesSpec(
            "Customer", "events", ("user_id",), "ts", {"kind": "event_type", "value": "value"}
        ),
    },
)


def star_graph(tables: Mapping[str, DataFrame], verified: Iterable[str] = ()) -> Graph:
    return Graph(SPEC, tables, verified)


# Contracts. Some rules are stricter than the data, so that there is something to find.
CONTRACTS = {
    c.name: c
    for c in (
        TableContract("nation", (Field("n_nationkey", INT, key=True), Field("n_name", TEXT))),
        TableContract(
            "customer",
            (
                Field("c_custkey", LONG, key=True, references=("events", "user_id")),
                Field("c_nationkey", INT, required=True, references=("nation", "n_nationkey")),
                Field("c_acctbal", MONEY, non_negative=True),
                Field(
                    "c_mktsegment", TEXT, one_of=("BUILDING", "MACHINERY", "HOUSEHOLD")
                ),
            ),
        ),
        TableContract(
            "orders",
            (
                Field("o_orderkey", LONG, key=True),
                Field("o_custkey", LONG, required=True, references=("customer", "c_custkey")),
                Field("o_orderstatus", TEXT, required=True, one_of=("F", "O")),
                Field("o_totalprice", MONEY, required=True, non_negative=True),
            ),
        ),
        TableContract(
            "lineitem",
            (
                Field("l_orderkey", LONG, key=True, references=("orders", "o_orderkey")),
                Field("l_linenumber", INT, key=True),
                Field("l_suppkey", LONG, required=True, references=("supplier", "s_suppkey")),
                Field("l_returnflag", TEXT, required=True, one_of=("A", "N")),
            ),
        ),
        TableContract(
            "documents",
            (Field("doc_id", LONG, key=True, references=("labels", "doc_id")),),
        ),
        TableContract(
            "labels",
            (
                Field("doc_id", LONG, key=True, references=("documents", "doc_id")),
                Field("quality", INT),
                Field("toxic", INT, required=True, default=0),
            ),
        ),
    )
}

# The keys and references alone, from which a graph follows.
REFERENCES = {
    c.name: c
    for c in (
        TableContract("region", (Field("r_regionkey", INT, key=True), Field("r_name", TEXT))),
        TableContract(
            "nation",
            (
                Field("n_nationkey", INT, key=True),
                Field("n_name", TEXT),
                Field("n_regionkey", INT, references=("region", "r_regionkey")),
            ),
        ),
        TableContract(
            "customer",
            (
                Field("c_custkey", LONG, key=True),
                Field("c_nationkey", INT, references=("nation", "n_nationkey")),
            ),
        ),
        TableContract(
            "supplier",
            (
                Field("s_suppkey", LONG, key=True),
                Field("s_name", TEXT, unique=True),
                Field("s_nationkey", INT, references=("nation", "n_nationkey")),
            ),
        ),
        TableContract("part", (Field("p_partkey", LONG, key=True),)),
        TableContract(
            "orders",
            (
                Field("o_orderkey", LONG, key=True),
                Field("o_custkey", LONG, references=("customer", "c_custkey")),
            ),
        ),
        TableContract(
            "lineitem",
            (
                Field("l_orderkey", LONG, key=True, references=("orders", "o_orderkey")),
                Field("l_linenumber", INT, key=True),
                Field("l_suppkey", LONG, references=("supplier", "s_suppkey")),
                Field("l_partkey", LONG, references=("part", "p_partkey")),
                Field("l_returnflag", TEXT),
            ),
        ),
        TableContract(
            "events",
            (
                Field("event_id", LONG, key=True),
                Field("user_id", LONG, references=("customer", "c_custkey")),
            ),
        ),
    )
}
LABELS = {
    "Region": "region",
    "Nation": "nation",
    "Customer": "customer",
    "Supplier": "supplier",
    "Part": "part",
    "Order": "orders",
    "Event": "events",
}
# One edge is named, and lies in its target's row; the others follow from the contracts.
NAMED = {"customer_places_order": target_edge(REFERENCES, LABELS, "orders", "o_custkey")}


def contract_graph(tables: Mapping[str, DataFrame]) -> Graph:
    return Graph(derived_graph(REFERENCES, LABELS, NAMED), tables)


# The orders as a catalog of declared columns would name their types.
DECLARED = (
    ("orders", "o_orderkey", "BIGINT"),
    ("orders", "o_custkey", "INTEGER"),
    ("orders", "o_totalprice", "NUMERIC(18, 2)"),
    ("orders", "o_orderdate", "DATE"),
    ("orders", "placed_at", "TIMESTAMPTZ"),
    ("orders", "is_final", "BOOLEAN"),
    ("orders", "o_orderpriority", "CHAR(15)"),
)

# The orders as a text file would hold them, for the ingest.
ORDER_FILE = TableContract(
    "order_file",
    (
        Field("o_orderkey", LONG, key=True),
        Field("o_custkey", INT, required=True),
        Field("o_totalprice", MONEY, required=True),
        Field("o_orderdate", DAY),
        Field("placed_at", INSTANT),
        Field("is_final", FLAG),
        Field("o_orderpriority", TEXT),
        Field("clerk", TEXT),
    ),
)
