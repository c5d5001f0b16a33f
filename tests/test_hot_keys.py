"""Joins at hot keys: with broadcasts off and low thresholds, AQE splits them."""

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import quality, taxonomy
from ledgerweave.operators.pairs import shared_pairs


@pytest.fixture
def eager_to_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield spark
    for name in settings:
        spark.conf.unset(name)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_roots_of_a_parent_with_most_children(eager_to_split):
    spark = eager_to_split
    wide = spark.range(60000).select(F.concat(F.lit("c"), "id").alias("child"), F.lit("p").alias("parent"))
    chains = spark.range(2000).select(
        F.concat(F.lit("n"), F.col("id") + 1).alias("child"), F.concat(F.lit("n"), "id").alias("parent")
    )
    top = spark.createDataFrame([("p", "r")], "child string, parent string")
    edges = wide.repartition(8).union(chains).union(top)
    found = taxonomy.root_of(edges)
    assert "skew=true" in final_plan(found)
    assert found.groupBy("root").count().orderBy("root").collect() == [("n0", 2000), ("r", 60001)]


def test_a_hot_parent_value_is_one_row(eager_to_split):
    spark = eager_to_split
    child = spark.range(100).select(F.col("id").alias("k"))
    parent = spark.range(50000).select(F.when(F.col("id") < 49990, 7).otherwise(F.col("id")).alias("v"))
    plan = quality.orphans(child, "k", parent, "v")
    assert {r.k for r in plan.collect()} == set(range(100)) - {7}
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


def test_a_crowded_group_is_split(eager_to_split):
    spark = eager_to_split
    crowd = spark.range(4000).select(F.lit(0).alias("g"), F.col("id").alias("m"))
    hub = spark.range(400).select((F.col("id") * 1000 + 1).alias("g"), F.lit(5).cast("long").alias("m"))
    with_hub = spark.range(400).crossJoin(spark.range(3).withColumnRenamed("id", "x")).select(
        (F.col("id") * 1000 + 1).alias("g"), (F.col("x") + 10).alias("m")
    )
    links = crowd.union(hub).union(with_hub).repartition(8)
    pairs = shared_pairs(links, "g", "m", "n", wide=2, hub=100)
    want = {(a, b, 401) for a in (5, 10, 11, 12) for b in (5, 10, 11, 12) if a < b}
    assert {tuple(r) for r in pairs.collect()} == want
    assert "skew=true" in final_plan(pairs)
