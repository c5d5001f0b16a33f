"""Load the portfolio from a folder of text tables into the catalog, and use it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ledgerweave.operators.graph import Graph
from ledgerweave.portfolio.contracts import PORTFOLIO
from ledgerweave.portfolio.graph import portfolio_graph
from ledgerweave.schema import TableContract
from ledgerweave.sources.text_tables import empty_table, load_table


def load_portfolio(
    spark: SparkSession,
    folder: str,
    prefix: str,
    contracts: Mapping[str, TableContract] = PORTFOLIO,
    rejects: str | None = None,
    multi_line: bool = False,
) -> dict[str, bool]:
    """Load ``<folder>/<table>.csv`` into ``<prefix><table>`` for every contract.

    Tables without a file are left out and reported as False. ``rejects`` is the
    folder for fields that do not fit; without one they stop the load. ``multi_line``
    says that fields may hold line breaks.
    """
    return {
        name: load_table(
            spark,
            f"{folder}/{name}.csv",
            contract,
            f"{prefix}{name}",
            f"{rejects}/{name}" if rejects else None,
            multi_line,
        )
        for name, contract in contracts.items()
    }


def catalog_tables(
    spark: SparkSession, prefix: str, contracts: Mapping[str, TableContract] = PORTFOLIO
) -> dict[str, DataFrame]:
    """The loaded tables by contract name; one that was not loaded is empty."""
    return {
        name: spark.table(f"{prefix}{name}")
        if spark.catalog.tableExists(f"{prefix}{name}")
        else empty_table(spark, contract)
        for name, contract in contracts.items()
    }


def catalog_graph(spark: SparkSession, prefix: str, verified: Iterable[str] = ()) -> Graph:
    return portfolio_graph(catalog_tables(spark, prefix), verified)
