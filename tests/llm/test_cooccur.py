import random
from collections import Counter
from itertools import combinations

import pytest

from paperlens.llm.cooccur import cooccurrence, normalise_tag
from pyspark.sql import functions as F


def brute(rows, least=1):
    baskets = {}
    for b, i in rows:
        if b is not None:
            baskets.setdefault(b, set())
            if i is not None:
                baskets[b].add(i)
    items = Counter(i for s in baskets.values() for i in s)
    pairs = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    return {(a, b, n, items[a], items[b], len(baskets)) for (a, b), n in pairs.items() if n >= least}


@pytest.mark.parametrize("block, wide", [(1024, 100_000), (3, 100_000), (1024, 2), (4, 3)])
def test_against_brute_force(spark, block, wide):
    rng = random.Random(1)
    rows = [(rng.randrange(30), rng.choice("abcdefghijklm") * rng.choice((1, 2))) for _ in range(250)]
    rows += [(1, None), (None, "a"), (99, None), (2, "a"), (2, "a"), (3, "")] + [(7, f"only{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "basket int, item string")
    for least in (1, 3):
        got = {tuple(r)[:6] for r in cooccurrence(df, "basket", "item", least, block=block, wide=wide).collect()}
        assert got == brute(rows, least)


def test_score_and_names(spark):
    df = spark.createDataFrame([(b, i, "x") for b, s in enumerate(["ab", "ab", "ab", "c", "d", "a"]) for i in s], "n_ab int, n string, ratio string")
    got = {(r.item_a, r.item_b): r for r in cooccurrence(df, "n_ab", "n").collect()}
    assert got.keys() == {("a", "b")}
    assert got["a", "b"].ratio == pytest.approx(3 * 6 / (4 * 3)) and got["a", "b"].llr > 0
    assert cooccurrence(df.limit(0), "n_ab", "n").count() == 0


def test_tags(spark):
    df = spark.createDataFrame([("  Graph \t  Learning ",), ("GRAPH LEARNING",)], "t string")
    assert {r[0] for r in df.select(normalise_tag(F.col("t"))).collect()} == {"graph learning"}


def test_stripes_travel_whole(spark):
    """No pair is formed before the stripes of an item have met."""
    df = spark.createDataFrame([(i % 7, f"t{i % 5}") for i in range(70)], "b int, i string")
    plan = cooccurrence(df, "b", "i")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("RepartitionByExpression")]
    assert "Generate" not in plan[plan.index("RepartitionByExpression") :].split("MapInArrow")[0] and above.count("MapInArrow") == 1
