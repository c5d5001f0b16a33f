"""Portfolio graph analytics on Spark DataFrames."""

from ledgerweave.operators.graph import EdgeSpec, Graph, GraphSpec, NodeSpec, SeriesSpec
from ledgerweave.schema import Field, ForeignKey, TableContract

__all__ = [
    "EdgeSpec",
    "Field",
    "ForeignKey",
    "Graph",
    "GraphSpec",
    "NodeSpec",
    "SeriesSpec",
    "TableContract",
]
