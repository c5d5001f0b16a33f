import itertools
import random
from collections import Counter

import pytest
from conftest import rows

from ledgerweave.operators import pairs
from ledgerweave.operators.pairs import shared_pairs


def brute(links, min_shared=2):
    groups = {}
    for g, m in links:
        if g is not None and m is not None:
            groups.setdefault(g, set()).add(m)
    found = Counter(p for ms in groups.values() for p in itertools.combinations(sorted(ms), 2))
    return sorted(((a, b, n) for (a, b), n in found.items() if n >= min_shared), key=repr)


@pytest.mark.parametrize("wide, hub", [(2, 1), (3, 2), (4, 100), (1000, 1000), (1, 3)])
@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, wide, hub, seed):
    draw = random.Random(seed)
    links = [(draw.randrange(12), draw.randrange(25)) for _ in range(60)]
    links += [(0, m) for m in range(20)] + [(1, m) for m in range(5, 25)]  # crowded groups
    links += [(g, 7) for g in range(12)] + [(None, 3), (4, None)]  # a hub, loose ends
    links += links[:10]
    df = spark.createDataFrame(links, "g long, m long")
    for least in (2, 3):
        assert rows(shared_pairs(df, "g", "m", "n", least, wide, hub)) == brute(links, least)


def test_single_shared_group_is_not_offered(spark):
    with pytest.raises(ValueError):
        shared_pairs(spark.createDataFrame([(1, 1)], "g long, m long"), "g", "m", "n", 1)


def test_heavy_members_and_chunked_groups(spark, monkeypatch):
    """Members with more pairs than a task counts, and crowded groups that travel in several rows."""
    monkeypatch.setattr(pairs, "TASK", 40)
    monkeypatch.setattr(pairs, "CHUNK", 3)
    links = [(g, m) for g in range(12) for m in range(g % 3, 14 + g % 4)] + [(20, 1), (20, 2), (21, 2)]
    df = spark.createDataFrame(links, "g long, m long")
    for wide, hub in ((100, 1), (15, 3), (15, 100)):
        assert rows(shared_pairs(df, "g", "m", "n", 2, wide, hub)) == brute(links)


def test_tasks_grow_with_the_pairs_and_pairs_travel_once(spark, monkeypatch):
    """No task counts many more pairs than ``TASK``, and no row of a shuffle is a single pair."""
    monkeypatch.setattr(pairs, "TASK", 100)
    df = spark.range(4000).selectExpr("id div 10 as g", "(id * 7) % 500 as m")
    found = shared_pairs(df, "g", "m", "n")
    plan = found._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert "hashpartitioning(a#" in moved[0] and "REPARTITION_BY_NUM" in moved[0]
    assert found.rdd.getNumPartitions() >= 4000 * 9 // 100
    assert not any("a#" in line and "b#" in line for line in moved)
