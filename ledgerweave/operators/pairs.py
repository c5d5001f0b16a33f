"""Pairs of members that share several groups, without all pairs of any large group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.session import cut_lineage

#: Pairs that one task counts, about; tasks number with the pairs.
TASK = 1 << 20
#: Members of a crowded group that travel in one row, about.
CHUNK = 1024


def shared_pairs(
    links: DataFrame,
    group: str,
    member: str,
    alias: str,
    min_shared: int = 2,
    wide: int = 256,
    hub: int = 256,
) -> DataFrame:
    """(member_a < member_b, alias) for pairs with at least ``min_shared`` groups in common.

    Repeated links count once. Groups of up to ``wide`` members are paired
    directly, at most ``wide`` members per link. Nothing is dropped for larger ones:

    * a pair whose common groups are all crowded shares two of them, so members
      are matched on pairs of crowded groups; every row is a wanted pair,
    * members of more than ``hub`` crowded groups are few, and are matched with
      the members of those groups one by one,
    * pairs already seen in a small group look their crowded groups up.

    A pair belongs to its lesser member. Pairs travel once, as one row per member and
    group with an array of the others, and are counted where they arrive.
    """
    if min_shared < 2:
        raise ValueError("pairs that share a single group are a plain self-join")
    memberships = (
        links.select(F.col(group).alias("g"), F.col(member).alias("m"))
        .where(F.col("g").isNotNull() & F.col("m").isNotNull())
        .distinct()
    )
    sizes = _sizes(memberships)
    known = sizes.agg(F.sum("size").alias("links"), F.max("size").alias("most")).first()
    tasks = _tasks(links, known.links)
    if (known.most or 0) <= wide:
        groups = _groups(memberships, tasks)
        counts = _counted(_within_groups(groups), _weights(groups))
    else:
        memberships = cut_lineage(memberships)
        crowded = cut_lineage(_sizes(memberships).where(F.col("size") > wide))
        counts = _with_crowded_groups(memberships, crowded, hub, tasks)
    return counts.where(F.col("n") >= min_shared).select(
        F.col("a").alias(f"{member}_a"), F.col("b").alias(f"{member}_b"), F.col("n").alias(alias)
    )


def _sizes(memberships: DataFrame) -> DataFrame:
    return memberships.groupBy("g").agg(F.count("*").alias("size"))


def _weights(groups: DataFrame) -> DataFrame:
    """(m, weight): no fewer than the pairs that belong to a member, one per group of both."""
    members = groups.select(F.explode("ms").alias("m"), (F.size("ms") - 1).alias("others"))
    return members.groupBy("m").agg(F.sum("others").alias("weight"))


def _tasks(df: DataFrame, number: int | None) -> int:
    """Tasks for so many rows or pairs: no fewer than Spark would take, and more the more there are."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-(number or 0) // TASK))


def _groups(memberships: DataFrame, tasks: int) -> DataFrame:
    """(ms): the members of each group in rising order, for groups that are not crowded."""
    dealt = memberships.repartition(tasks, "g").groupBy("g")
    return dealt.agg(F.sort_array(F.collect_list("m")).alias("ms")).select("ms")


def _within_groups(groups: DataFrame) -> DataFrame:
    """(a, bs, n): every member of a group with the greater ones, each met once."""
    members = groups.select("ms", F.posexplode("ms").alias("at", "a"))
    return members.where(F.col("at") + 1 < F.size("ms")).select(
        "a", F.slice("ms", F.col("at") + 2, F.size("ms")).alias("bs"), F.lit(1).cast("long").alias("n")
    )


def _counted(owned: DataFrame, weights: DataFrame) -> DataFrame:
    """(a, b, n): sums of n over the rows (a, bs, n) in which a meets b.

    All rows of a member go to one task, but for those of members with more pairs than a task
    counts: of these there are at most as many as tasks, and their pairs are dealt one by one.
    """
    heavy = weights.where(F.col("weight") > TASK)
    total = weights.agg(F.sum("weight").alias("pairs"), F.count_if(F.col("weight") > TASK).alias("heavy")).first()
    tasks = _tasks(owned, total.pairs)
    by_pair = None
    if total.heavy:
        heavy = F.broadcast(cut_lineage(heavy.select(F.col("m").alias("a"))))
        by_pair = _summed(owned.join(heavy, "a", "left_semi"))
        owned = owned.join(heavy, "a", "left_anti")
    counts = _summed(owned.repartition(tasks, "a"))
    return counts if by_pair is None else counts.unionByName(by_pair)


def _summed(owned: DataFrame) -> DataFrame:
    pairs = owned.select("a", F.explode("bs").alias("b"), "n")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _with_hubs(hubs: DataFrame, plain: DataFrame) -> DataFrame:
    """(a, bs, n): hubs with the greater members of their groups, others with the greater hubs."""

    def met(links: DataFrame, others: DataFrame) -> DataFrame:
        # Chunks get a shuffle of their own by group, which Spark can split.
        chunk = F.pmod(F.hash("m"), F.ceil(F.col("size") / CHUNK).cast("int")).alias("chunk")
        chunks = others.groupBy("g", chunk).agg(F.sort_array(F.collect_list("m")).alias("ms"))
        found = links.join(chunks, "g").select(
            F.col("m").alias("a"), F.filter("ms", lambda x: x > F.col("m")).alias("bs")
        )
        return found.where(F.size("bs") > 0).withColumn("n", F.lit(1).cast("long"))

    return met(hubs, hubs.unionByName(plain)).unionByName(met(plain, hubs))


def _with_crowded_groups(memberships: DataFrame, crowded: DataFrame, hub: int, tasks: int) -> DataFrame:
    # Worked out once; as plain tables they also get shuffles of their own, which Spark can
    # split where a group or a member is hot.
    small = cut_lineage(memberships.join(crowded, "g", "left_anti"))
    large = cut_lineage(memberships.join(crowded, "g"))
    degree = large.groupBy("m").agg(F.count("*").alias("k"))
    hubs = cut_lineage(degree.where(F.col("k") > hub).select("m"))
    of_hubs = cut_lineage(large.join(hubs, "m", "left_semi"))
    plain = cut_lineage(large.join(hubs, "m", "left_anti"))

    groups = _groups(small, tasks)
    parts = _within_groups(groups).unionByName(_with_hubs(of_hubs, plain))
    if not plain.isEmpty():
        known = _groups(small.join(plain.select("m").distinct(), "m", "left_semi"), tasks)
        for alone in (_on_pairs_of_groups(plain), _in_one_crowded_group(known, plain)):
            parts = parts.unionByName(alone.select("a", F.array("b").alias("bs"), "n"))
    beside = plain.join(_sizes(of_hubs).withColumnRenamed("size", "hubs"), "g")
    weights = _weights(groups).unionByName(of_hubs.select("m", F.col("size").alias("weight")))
    weights = weights.unionByName(beside.select("m", F.col("hubs").alias("weight")))
    return _counted(parts, cut_lineage(weights.groupBy("m").agg(F.sum("weight").alias("weight"))))


def _on_pairs_of_groups(plain: DataFrame) -> DataFrame:
    """(a, b, n): c common pairs of crowded groups come from n groups with c = n (n - 1) / 2."""
    group_pairs = (
        plain.select("m", F.col("g").alias("g1"))
        .join(plain.select("m", F.col("g").alias("g2")), "m")
        .where(F.col("g1") < F.col("g2"))
    )
    return (
        group_pairs.select("g1", "g2", F.col("m").alias("a"))
        .join(group_pairs.select("g1", "g2", F.col("m").alias("b")), ["g1", "g2"])
        .where(F.col("a") < F.col("b"))
        .groupBy("a", "b")
        .agg(F.count("*").alias("c"))
        .select("a", "b", F.round((1 + F.sqrt(1 + 8 * F.col("c"))) / 2).cast("long").alias("n"))
    )


def _in_one_crowded_group(groups: DataFrame, plain: DataFrame) -> DataFrame:
    """(a, b, n): pairs of a small group with exactly one crowded group in common."""
    pairs = _within_groups(groups).select("a", F.explode("bs").alias("b")).distinct()
    return (
        pairs.join(plain.select(F.col("m").alias("a"), "g"), "a")
        .join(plain.select(F.col("m").alias("b"), "g"), ["b", "g"], "left_semi")
        .groupBy("a", "b")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") == 1)
    )
