"""Contract checks as violation counts and violating rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.schema import TableContract

# A rule on NULL holds: only FALSE is a violation.


def not_in(column: Column, allowed: Sequence) -> Column:
    return ~column.isin(*allowed)


def negative(column: Column) -> Column:
    return ~(column >= 0)


def out_of_order(earlier: Column, later: Column) -> Column:
    return ~(later >= earlier)


def none_set(*columns: Column) -> Column:
    return reduce(lambda a, b: a & b, [c.isNull() for c in columns])


def row_rules(contract: TableContract) -> dict[str, Column]:
    """Check name -> violation condition, for every rule that concerns one row."""
    rules: dict[str, Column] = {}
    for f in contract.fields:
        column = F.col(f.name)
        if f.required or f.key:
            rules[f"{contract.name}.{f.name}.not_null"] = column.isNull()
        if f.one_of:
            rules[f"{contract.name}.{f.name}.one_of"] = not_in(column, f.one_of)
        if f.non_negative:
            rules[f"{contract.name}.{f.name}.non_negative"] = negative(column)
    for earlier, later in contract.ordered:
        rules[f"{contract.name}.{later}.not_before.{earlier}"] = out_of_order(
            F.col(earlier), F.col(later)
        )
    for group in contract.any_of:
        rules[f"{contract.name}.any_of.{'.'.join(group)}"] = none_set(*map(F.col, group))
    return rules


def count_violations(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(check_name, violations) for all rules in one pass over the rows."""
    counts = [
        F.count(F.when(broken, True)).alias(f"r{i}") for i, broken in enumerate(rules.values())
    ]
    found = [
        F.struct(F.lit(name).alias("check_name"), F.col(f"r{i}").alias("violations"))
        for i, name in enumerate(rules)
    ]
    return (
        rows.agg(*counts).select(F.explode(F.array(*found)).alias("found")).select("found.*")
    )


def violating_rows(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """The rows that break a rule, with the names of the rules they break."""
    broken = [F.when(condition, F.lit(name)) for name, condition in rules.items()]
    return rows.withColumn("violations", F.array_compact(F.array(*broken))).where(
        F.size("violations") > 0
    )


def duplicate_keys(rows: DataFrame, key: Sequence[str], alias: str = "n") -> DataFrame:
    """Key values that occur more than once; counted before they are shuffled."""
    return rows.groupBy(*key).agg(F.count("*").alias(alias)).where(F.col(alias) > 1)


def orphans(child: DataFrame, column: str, parent: DataFrame, target: str) -> DataFrame:
    """(column, n): referenced values that the parent lacks, with their row counts.

    Both sides are reduced to one row per value before the join, so a value that a
    third of all rows of either hold is a single row there.
    """
    used = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    known = parent.select(F.col(target).alias(column)).distinct()
    return used.join(known, column, "left_anti")


def orphan_count(
    name: str, child: DataFrame, column: str, parent: DataFrame, target: str
) -> DataFrame:
    """(check_name, violations): rows whose reference leads nowhere."""
    return orphans(child, column, parent, target).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("violations")
    ).select(F.lit(name).alias("check_name"), "violations")


def key_rules(
    contract: TableContract, tables: Mapping[str, DataFrame]
) -> list[DataFrame]:
    """(check_name, violations) frames for keys, unique columns and references."""
    rows = tables[contract.name]
    found = []

    def duplicates(name: str, key: Sequence[str]) -> DataFrame:
        return duplicate_keys(rows.dropna(subset=list(key)), key).agg(
            F.count("*").alias("violations")
        ).select(F.lit(name).alias("check_name"), "violations")

    if contract.primary_key:
        found.append(duplicates(f"{contract.name}.primary_key", contract.primary_key))
    for f in contract.fields:
        if f.unique:
            found.append(duplicates(f"{contract.name}.{f.name}.unique", [f.name]))
    for reference in contract.foreign_keys:
        if reference.table in tables:
            found.append(
                orphan_count(
                    f"{contract.name}.{reference.column}.references.{reference.table}",
                    rows,
                    reference.column,
                    tables[reference.table],
                    reference.target,
                )
            )
    return found


def check_contracts(
    contracts: Mapping[str, TableContract], tables: Mapping[str, DataFrame]
) -> DataFrame:
    """(check_name, violations) of every rule of every table at hand."""
    found = []
    for name, contract in contracts.items():
        if name not in tables:
            continue
        rules = row_rules(contract)
        if rules:
            found.append(count_violations(tables[name], rules))
        found.extend(key_rules(contract, tables))
    return reduce(DataFrame.unionByName, found)


def fill_defaults(rows: DataFrame, contract: TableContract) -> DataFrame:
    """Declared defaults in place of NULLs."""
    return rows.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(value).cast(contract.field(name).type))
            for name, value in contract.defaults.items()
            if name in rows.columns
        }
    )
