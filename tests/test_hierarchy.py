import random

from pyspark.sql import functions as F

from paperlens.operators.components import components
from paperlens.operators.hierarchy import descendants, hierarchy, latest, paths


def brute(parent):
    """kind, path from the root, by walking up."""
    out = {}
    for start in parent:
        chain, seen, at = [], set(), start
        while True:
            if at not in parent:
                kind = "dangling"
                break
            if at in seen:
                kind = "cycle" if at == start else "below_cycle"
                break
            seen.add(at)
            chain.append(at)
            if parent[at] is None:
                kind = "root" if at == start else "node"
                break
            at = parent[at]
        out[start] = (kind, chain[::-1])
    return out


def check(spark, parent, rows=None, **options):
    df = spark.createDataFrame(rows or list(parent.items()), "id long, parent_id long")
    nodes = hierarchy(df, **options)
    got = {r.id: r for r in nodes.collect()}
    way = {r.id: r.path for r in paths(nodes, chunk=4).collect()}
    want = brute(parent)
    assert got.keys() == want.keys()
    below = {}
    for node, (kind, chain) in want.items():
        r = got[node]
        assert r.kind == kind, (node, r.kind, kind)
        if kind in ("cycle", "below_cycle"):
            assert r.root is None and r.depth is None and node not in way
            continue
        assert (r.root, r.depth) == (chain[0], len(chain) - 1)
        assert way[node] == chain
        for a in chain[:-1]:
            below.setdefault(a, set()).add(node)
    for node, r in got.items():
        if r.kind in ("root", "node", "dangling"):
            assert r.n_below == len(below.get(node, ()))
            inside = {n for n, x in got.items() if x.root == r.root and x.entry is not None and r.entry < x.entry <= r.exit}
            assert inside == below.get(node, set())
    found = {(r.id, r.below) for r in descendants(nodes, df.select("id")).collect()}
    assert found == {(a, b) for a, s in below.items() for b in s}


def test_shapes(spark):
    check(spark, {1: None})
    check(spark, {1: 1})  # its own parent
    check(spark, {1: 2, 2: 1, 3: 1, 4: 3, 5: 9, 6: 5})  # a cycle, what hangs on it, a dangling chain
    check(spark, {i: i - 1 if i else None for i in range(40)})  # a chain
    check(spark, {i: None if i == 7 else 7 for i in range(30)}, salts=3)  # a star around one parent
    check(spark, {10: 20, 20: 30, 30: 10, 40: None, -5: 40})


def test_random_forests(spark):
    rng = random.Random(5)
    for n in (25, 60):
        ids = rng.sample(range(-1000, 1000), n)
        check(spark, {i: rng.choice([None, rng.choice(ids), rng.choice(ids), rng.choice(ids), 5000]) for i in ids})


def test_nulls_repeats_versions_and_clashes(spark):
    rows = [(1, None), (1, None), (None, 1), (2, 1), (2, 1)]
    check(spark, {1: None, 2: 1}, rows)
    df = spark.createDataFrame([(1, None, 5, "a"), (2, 9, 1, "b"), (2, 1, 7, "c")], "id long, parent_id long, at int, root string")
    got = {r.id: (r.kind, r.root) for r in hierarchy(df, version_col="at").collect()}
    assert got == {1: ("root", 1), 2: ("node", 1)}
    empty = hierarchy(df.limit(0))
    assert empty.count() == 0 and paths(empty).count() == 0


def test_latest(spark):
    df = spark.createDataFrame([(1, 3, "x"), (1, 4, "y"), (2, None, None), (None, 1, "z")], "k int, v int, s string")
    assert {tuple(r) for r in latest(df, "k", "v").collect()} == {(1, 4, "y"), (2, None, None)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)] + [(5, 5)]
    df = spark.createDataFrame(edges, "u long, v long")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    want = {x: find(x) for u, v in edges if u != v for x in (u, v)}
    assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


def test_descendants_of_a_large_tree(spark, tmp_path):
    """A star of 20,000 below a chain: all pairs of the tree would be 400 million."""
    from paperlens.plans.trees import queries

    rows = [(0, None), (1, 0), (2, 1), *[(i, 2) for i in range(3, 20_003)], (30_000, 30_000)]
    df = spark.createDataFrame([(i, p, i) for i, p in rows], "id long, parent_id long, updated_at long")
    df.write.parquet(str(tmp_path / "paper_comments.parquet"))
    got = queries()["p1_descendants"](spark, str(tmp_path))
    assert got.columns == ["id", "below"]
    assert {r.id: (r.n, r.low) for r in got.groupBy("id").agg(F.count("*").alias("n"), F.min("below").alias("low")).collect()} == {0: (20_002, 1), 1: (20_001, 2), 2: (20_000, 3)}
