"""Connected components against union-find."""

import random

import pytest

from millrace.llm.components import components


def least_reached(links):
    above = {}

    def top(x):
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        above[y] = x
    return {x: top(x) for x in above}


def found(spark, links):
    rows = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


def test_long_chain_of_shuffled_names(spark):
    r = random.Random(5)
    name = [r.randrange(-(1 << 63), 1 << 63) for _ in range(3001)]
    links = list(zip(name, name[1:]))
    r.shuffle(links)
    assert found(spark, links) == dict.fromkeys(name, min(name))


def test_mixed_shapes(spark):
    r = random.Random(6)
    name = [r.randrange(-(1 << 63), 1 << 63) for _ in range(400)]
    star = [(name[0], x) for x in name[1:80]]
    sparse = [(r.choice(name[100:300]), r.choice(name[100:300])) for _ in range(130)]
    ladder = [(name[i], name[i + d]) for i in range(300, 390) for d in (1, 2, 3)]
    links = [x for x in star + sparse + ladder if x[0] != x[1]] + [ladder[0], ladder[0][::-1], (name[399], name[399])]
    assert found(spark, links) == least_reached(links)
    assert found(spark, []) == {}


def test_unfinished_is_an_error(spark):
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a bigint, b bigint"), rounds=1)


def test_hot_keys_stay_where_they_are(spark, monkeypatch):
    """A star, a chain and copies give the same whether or not some keys count as hot."""
    from millrace.llm import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    r = random.Random(7)
    name = [r.randrange(-(1 << 63), 1 << 63) for _ in range(260)]
    links = [(name[0], x) for x in name[1:100]] + [(x, name[1]) for x in name[100:140]] + list(zip(name[140:], name[141:]))
    for keys in (1 << 14, 20):  # total / 20 leaves the star's middle hot, the chain's nodes not
        monkeypatch.setattr(skew, "HOT_KEYS", keys)
        assert found(spark, links) == least_reached(links)


def test_join_spread(spark, monkeypatch):
    """Each row of a hot key, of others and of none, against a plain join; a null key matches nothing."""
    from collections import Counter

    from pyspark.sql import functions as F

    from millrace.llm import skew

    keys = [None] * 30 + ["hot"] * 500 + ["warm"] * 40 + ["cold", "cold", "alone"]
    rows = spark.createDataFrame(list(enumerate(keys)), "i int, k string").repartition(4)
    table = spark.createDataFrame([(k, n, f"of {k}") for k, n in Counter(keys).items() if k not in (None, "alone")], "k string, n bigint, v string")
    want = sorted((i, f"of {k}") for i, k in enumerate(keys) if k not in (None, "alone"))
    for least in (1, 100, 1000):  # all keys hot, one, none
        monkeypatch.setattr(skew, "HOT_ROWS", least)
        got = skew.join_spread(rows, table, "k", "n", len(keys))
        assert sorted(map(tuple, got.select("i", "v").collect())) == want
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    plan = skew.join_spread(rows, table, "k", "n", len(keys))
    shuffled = plan.where(F.col("k") == "hot").count()
    assert shuffled == 500 and "BroadcastHashJoin" in plan._jdf.queryExecution().toString()
    assert skew.join_spread(rows.limit(0), table, "k", "n", 0).count() == 0
