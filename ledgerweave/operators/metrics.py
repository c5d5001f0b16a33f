"""Portfolio questions as functions of DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_where(rows: DataFrame, condition: Column, alias: str) -> DataFrame:
    return rows.where(condition).agg(F.count("*").alias(alias))


def in_year(column: str, year: int) -> Column:
    """Half-open date range, which the file statistics can prune; year() cannot."""
    start, end = (F.lit(f"{y}-01-01").cast("date") for y in (year, year + 1))
    return (F.col(column) >= start) & (F.col(column) < end)


def share_pct(rows: DataFrame, weight: Column, part: Column, alias: str, places: int) -> DataFrame:
    """Weight of ``part`` in the weight of all rows, in percent."""
    sums = rows.agg(
        F.sum(F.when(part, weight).otherwise(F.lit(0))).alias("part"), F.sum(weight).alias("whole")
    )
    ratio = F.lit(100.0) * F.col("part").cast("double") / F.nullif(
        F.col("whole").cast("double"), F.lit(0.0)
    )
    return sums.select(F.round(ratio, places).alias(alias))


def total_where(rows: DataFrame, amount: Column, condition: Column, alias: str) -> DataFrame:
    return rows.where(condition).agg(F.sum(amount).alias(alias))


def side_by_side(rows: DataFrame, definitions: Mapping[str, Column]) -> DataFrame:
    """How many rows each definition catches, in one pass."""
    return rows.agg(*[F.count(F.when(c, True)).alias(alias) for alias, c in definitions.items()])


def present(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key occurs among ``others``; the key is meant to be that of ``rows``."""
    return rows.join(_keys(others, other_key, key), key, "left_semi")


def absent(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key occurs nowhere among ``others``; a NULL key occurs nowhere."""
    return rows.join(_keys(others, other_key, key), key, "left_anti")


def _keys(rows: DataFrame, column: str, alias: str) -> DataFrame:
    """Distinct keys. The join that follows reuses their partitioning, and a key
    that fills a third of ``rows`` reaches it as a single row."""
    return rows.where(F.col(column).isNotNull()).select(F.col(column).alias(alias)).distinct()


def role_counts(
    links: DataFrame, thing: str, party: str, condition: Column, alias: str, more_than: int
) -> DataFrame:
    """Things with more than ``more_than`` different parties in the wanted role."""
    return (
        links.where(condition)
        .groupBy(thing)
        .agg(F.countDistinct(party).alias(alias))
        .where(F.col(alias) > more_than)
    )


def role_fanout(
    links: DataFrame,
    things: DataFrame | None,
    parties: DataFrame | None,
    thing: str,
    party: str,
    role: str,
) -> DataFrame:
    """(thing, party, role) of every link, all roles, whose both ends exist.

    Pass None for an end whose references are known to be whole, to save its join.
    """
    found = links.select(thing, party, role).distinct()
    for end, key in ((parties, party), (things, thing)):
        if end is not None:
            found = found.join(end.select(key), key, "left_semi")
    return found


def conflicting_keys(
    one: DataFrame, other: DataFrame, key: str, value: str, other_value: str
) -> DataFrame:
    """Keys with some ``value`` on one side that differs from some on the other.

    Each side is reduced to its least and greatest value per key. All values are
    equal exactly when least and greatest agree crosswise, so no pairs are formed
    however many rows a key has.
    """
    ours = one.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    theirs = other.groupBy(key).agg(
        F.min(other_value).alias("other_lo"), F.max(other_value).alias("other_hi")
    )
    return (
        ours.join(theirs, key)
        .where((F.col("lo") != F.col("other_hi")) | (F.col("hi") != F.col("other_lo")))
        .select(key)
    )


def exposures(
    links: DataFrame,
    things: DataFrame,
    thing: str,
    party: str,
    full_role: Column,
    amounts: Mapping[str, Column],
) -> DataFrame:
    """Sums per party under several definitions, with and without minor roles.

    A party that holds several roles in one thing counts it once. Columns are
    ``<name>_all_roles`` and ``<name>_full_roles`` per amount, plus ``things_n``.
    """
    once = links.groupBy(thing, party).agg(F.max(full_role).alias("full"))
    priced = once.join(
        things.select(thing, *[a.alias(f"a_{name}") for name, a in amounts.items()]), thing
    )
    sums = []
    for name in amounts:
        sums.append(F.sum(f"a_{name}").alias(f"{name}_all_roles"))
        sums.append(F.sum(F.when(F.col("full"), F.col(f"a_{name}"))).alias(f"{name}_full_roles"))
    return priced.groupBy(party).agg(*sums, F.count("*").alias("things_n"))


def with_side_totals(
    rows: DataFrame, key: str, sides: Sequence[tuple[DataFrame, Sequence[Column]]]
) -> DataFrame:
    """Left joins with sides that are totalled per key first, so rows never multiply."""
    for side, totals in sides:
        rows = rows.join(side.groupBy(key).agg(*totals), key, "left")
    return rows


def latest_values(
    series: DataFrame, entity: str, prop: str, instant: str, value: str
) -> DataFrame:
    """(entity, prop, instant, value) of the last reading; of equal instants the
    greater value counts."""
    last = F.max(F.struct(instant, value)).alias("last")
    return series.groupBy(entity, prop).agg(last).select(
        entity, prop, F.col(f"last.{instant}").alias(instant), F.col(f"last.{value}").alias(value)
    )


def long_form(
    rows: DataFrame, keys: Sequence[str], variants: Mapping[str, Mapping[str, Column]], tag: str
) -> DataFrame:
    """One row per variant: ``tag`` names it, its columns come from the wide row."""
    structs = [
        F.struct(F.lit(name).alias(tag), *[c.alias(alias) for alias, c in columns.items()])
        for name, columns in variants.items()
    ]
    return rows.select(*keys, F.explode(F.array(*structs)).alias("__row")).select(*keys, "__row.*")
