import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from paperlens.llm.pack import best_fit, local_search, pack


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_local_search_keeps_items(sizes):
    start = best_fit(sizes, 50)
    bins = local_search(sizes, [list(b) for b in start], 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)
    assert len(bins) <= len(start)


def test_swaps_empty_a_bin():
    # 6+6 and 5+5 leave room that only an exchange can use
    sizes = [6, 5, 5, 4, 4, 6]
    bins = local_search(sizes, [[0, 3], [1, 4], [2], [5]], 10)
    assert len(bins) == 3
    # the bin that helps isn't the roomiest one
    assert len(local_search(sizes, [[0, 3], [1, 4], [2], [5]], 10, neighbours=1)) == 3


def test_pack(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice((rng.randrange(1, 40), rng.randrange(1, 400)))) for i in range(400)] + [(900, 0), (901, None), (902, 300), (903, 100), (904, 1000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, n_tokens int, tokens string")
    out = pack(df, [(1, 100), (2, 250)], group=60).collect()
    sizes = {k: n for k, n in rows if n}
    for window, capacity in ((1, 100), (2, 250)):
        fill, parts, homes = defaultdict(int), defaultdict(list), defaultdict(set)
        for r in out:
            if r.window_id == window:
                fill[r.container_id] += r.tokens
                parts[r.doc_id].append((r.piece, r.start, r.tokens))
                homes[r.doc_id].add(r.container_id)
        assert max(fill.values()) <= capacity
        assert parts.keys() == sizes.keys()
        for doc, pieces in parts.items():
            at = 0
            for n, (piece, start, tokens) in enumerate(sorted(pieces)):
                assert (piece, start) == (n, at)
                at += tokens
            assert at == sizes[doc] and (sizes[doc] > capacity or len(homes[doc]) == 1)
        assert len(fill) <= 1.05 * -(-sum(sizes.values()) // capacity) + 1
    assert pack(df.limit(0), [(1, 100)]).count() == 0
