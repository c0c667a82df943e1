"""Related papers: results against a plain search of all pairs, and what travels."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from paperlens.catalog import Tables
from paperlens.functions.nearest import blocks, nearest
from paperlens.operators import tags


class _Given(Tables):
    tags = deleted = None

    def __init__(self, tags, deleted):
        self.tags, self.deleted = tags, deleted


def _plain(mine, theirs, k, full):
    """{paper: [(similarity, other)]} of all pairs."""
    out = {}
    for a, x in mine.items():
        n1, sims = sum(w * w for w in x.values()), []
        for b, y in theirs.items():
            both = x.keys() & y.keys() - {None}
            n2 = sum(y[t] ** 2 for t in (y if full else both))
            if a != b and both and n1 > 0 and n2 > 0 and (sim := round(sum(x[t] * y[t] for t in both) / (math.sqrt(n1) * math.sqrt(n2)), 9)) > 0:
                sims.append((-sim, b))
        if sims:
            out[a] = [(-s, b) for s, b in sorted(sims)[:k]]
    return out


def _papers(rng, n, weights, popular, rare):
    papers = {}
    for i in range(n):
        own = {f"p{j}": rng.choice(weights) for j in range(popular) if rng.random() < 0.6}
        own |= {f"r{rng.randrange(n)}": rng.choice(weights) for _ in range(rng.randrange(rare + 1))}
        papers[f"{rng.choice('Zaé检')}{i}"] = own or {None: 1.0}
    return papers


@pytest.mark.parametrize("full", [False, True])
@pytest.mark.parametrize("weights", [(1.0,), (1.0, 2.0, 9.5), tuple(x / 8 for x in range(1, 80)), (0.0, 1.0, 3.0), (-2.0, 1.0, 3.0)])
def test_nearest_is_the_search_of_all_pairs(full, weights):
    rng = random.Random(5)
    for popular in (0, 1, 2):
        for rare in (0, 1, 4):
            papers = _papers(rng, 120, weights, popular, rare)
            rows = [{"paper_id": p, "tags": list(t), "weights": list(t.values())} for p, t in papers.items()]
            rng.shuffle(rows)
            table = pa.Table.from_pylist(rows, pa.schema([("paper_id", pa.string()), ("tags", pa.list_(pa.string())), ("weights", pa.list_(pa.float64()))]))
            got = {}
            for r in nearest(table, table, 5, full).to_pylist():
                if r["n2"] > 0 and (sim := round(r["dot"] / (math.sqrt(r["n1"]) * math.sqrt(r["n2"])), 9)) > 0:
                    got.setdefault(r["paper_id"], []).append((-sim, r["other_id"]))
            assert {p: [(-s, b) for s, b in sorted(x)[:5]] for p, x in got.items()} == _plain(papers, papers, 5, full)


def _shuffled(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("full", [False, True])
def test_pairs_of_a_popular_tag_stay_where_they_are(spark, full):
    rng = random.Random(6)
    papers = {p: {("hot" if t == "p0" else t): w for t, w in own.items()} for p, own in _papers(rng, 900, (1.0, 2.0, 3.5), 1, 3).items()}
    rows = [(p, t, None if t is None else w) for p, own in papers.items() for t, w in own.items()]
    gone = sorted(papers)[::50]
    given = _Given(spark.createDataFrame(rows, "paper_id string, tag string, weight double"), spark.createDataFrame([(p,) for p in gone], "id string"))
    of = spark.createDataFrame([(p,) for p in papers], "paper_id string")
    before = _shuffled(spark)
    got = {}
    for r in tags.related(given, of, 3, full).collect():
        got.setdefault(r.paper_id, []).append((r["rank"], r.sim, r.other_id))
    pairs = sum("hot" in own for own in papers.values()) ** 2
    assert _shuffled(spark) - before < pairs / 10
    known = {p: {t: w for t, w in own.items() if t is not None} for p, own in papers.items()}
    want = _plain(known, {p: own for p, own in known.items() if p not in gone}, 3, full)
    assert {p: [(n, b) for n, _, b in sorted(x)] for p, x in got.items()} == {p: [(n, b) for n, (_, b) in enumerate(x, 1)] for p, x in want.items()}
    assert all(abs(s - want[p][n - 1][0]) < 1e-6 for p, x in got.items() for n, s, _ in x)


SCHEMA = pa.schema([("paper_id", pa.string()), ("tags", pa.list_(pa.string())), ("weights", pa.list_(pa.float64()))])


def _table(papers):
    return pa.Table.from_pylist([{"paper_id": p, "tags": list(t), "weights": list(t.values())} for p, t in papers.items()], SCHEMA)


@pytest.mark.parametrize("full", [False, True])
@pytest.mark.parametrize("weights", [(1.0,), (1.0, 2.0, 9.5), (0.0, 1.0, 3.0), (-2.0, 1.0, 3.0)])
def test_blocks_one_after_another_give_what_one_block_gives(full, weights):
    rng = random.Random(7)
    for popular, rare in ((0, 4), (1, 0), (1, 3), (2, 2)):
        papers = _papers(rng, 150, weights, popular, rare)
        table, least, got = _table(papers), np.full(150, -1.0), {}
        for others in blocks(iter(table.to_batches(max_chunksize=17)), 40):
            assert others.num_rows == 40 or others.num_rows == 150 % 40
            for r in nearest(table, others, 5, full, least).to_pylist():
                if r["n2"] > 0 and (sim := round(r["dot"] / (math.sqrt(r["n1"]) * math.sqrt(r["n2"])), 9)) > 0:
                    got.setdefault(r["paper_id"], []).append((-sim, r["other_id"]))
        assert {p: [(-s, b) for s, b in sorted(x)[:5]] for p, x in got.items()} == _plain(papers, papers, 5, full)


@pytest.mark.parametrize("full", [False, True])
def test_what_travels_is_the_same_for_any_block(spark, full):
    rng = random.Random(8)
    papers = _papers(rng, 900, (1.0, 2.0, 3.5), 1, 3)
    rows = [(p, t, None if t is None else w) for p, own in papers.items() for t, w in own.items()]
    given = _Given(spark.createDataFrame(rows, "paper_id string, tag string, weight double"), spark.createDataFrame([], "id string"))
    of = spark.createDataFrame([(p,) for p in papers], "paper_id string")
    moved, results = [], []
    for block in (1000, 60):
        before = _shuffled(spark)
        results.append(sorted(map(tuple, tags.related(given, of, 3, full, block=block).collect())))
        moved.append(_shuffled(spark) - before)
    assert results[0] == results[1] and results[0]
    assert moved[1] < 1.2 * moved[0]


def test_any_number_of_chunks_gives_the_same(spark):
    papers = _papers(random.Random(9), 300, (1.0, 2.0, 3.5), 1, 3)
    given = _Given(spark.createDataFrame([(p, t, w) for p, own in papers.items() for t, w in own.items()], "paper_id string, tag string, weight double"), spark.createDataFrame([], "id string"))
    of = spark.createDataFrame([(p,) for p in sorted(papers)[::2]], "paper_id string")
    whole, parts = (sorted(map(tuple, tags.related(given, of, 3, chunk=chunk).collect())) for chunk in (5000, 40))
    assert whole == parts and len({r[0] for r in whole}) > 100
    assert tags.related(given, of.where("false"), 3).count() == 0
