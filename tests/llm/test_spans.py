import random
from collections import defaultdict

import pytest

import numpy as np

import paperlens.llm.spans as spans_module
from paperlens.llm.spans import _chars, _numbers, shared_runs, span_classes, span_pairs, span_shares


def brute(docs, k):
    where = defaultdict(set)
    for d, t in docs.items():
        for i in range(len(t) - k + 1):
            where[t[i : i + k]].add(d)
    pairs = {(a, b) for s in where.values() for a in s for b in s if a < b}
    shares = {}
    for d, t in docs.items():
        cover = [False] * len(t)
        for i in range(len(t) - k + 1):
            if len(where[t[i : i + k]]) > 1:
                cover[i : i + k] = [True] * k
        shares[d] = sum(cover)
    return pairs, shares


@pytest.mark.parametrize("hot", [20_000, 3])
def test_against_brute_force(spark, hot):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abc 中😀") for _ in range(n))
    passages = [word(rng.randrange(15, 60)) for _ in range(6)]
    docs = {i: "".join(rng.choice((word(rng.randrange(30)), rng.choice(passages))) for _ in range(rng.randrange(1, 6))) for i in range(60)}
    docs |= {100: "=" * 300, 101: "=" * 90, 102: "ab" * 100, 103: "", 104: passages[0], 105: passages[0], 106: "x" * 19, 107: "x" * 20, 108: "x" * 20}
    k = 20
    rows = [*docs.items(), (200, None), (None, passages[0]), (104, passages[0])]
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], "doc long, text string, start string")
    pairs, shares = brute(docs, k)
    runs = shared_runs(df, "doc", "text", k, m=8, hot=hot)
    assert {tuple(r) for r in span_pairs(runs, block=3).collect()} == pairs
    got = {r.doc: r for r in span_shares(df, runs, "doc", "text", k).collect()}
    assert {d: r.n_shared for d, r in got.items() if d != 200} == shares
    assert got[200].n_chars == 0 and got[200].share == 0.0


@pytest.mark.parametrize("most", [2_000_000, 50])
def test_parts_of_a_bucket_in_different_calls(spark, most):
    # one gram that all texts share is the minimiser of many different windows, few of which are shared
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    docs = {i: word(14) + "z" * 8 + word(14) for i in range(80)}
    docs |= {100 + i: docs[i] for i in range(5)}
    df = spark.createDataFrame(list(docs.items()), "doc long, text string")
    pairs, shares = brute(docs, 20)
    runs = shared_runs(df, "doc", "text", 20, m=8, hot=4, most=most)
    assert {tuple(r) for r in span_pairs(runs).collect()} == pairs
    assert {r.doc: r.n_shared for r in span_shares(df, runs, "doc", "text", 20).collect()} == shares


def test_empty(spark):
    df = spark.createDataFrame([], "doc long, text string")
    assert span_pairs(shared_runs(df, "doc", "text")).count() == 0


def test_long_text_in_segments(spark, monkeypatch):
    import paperlens.llm.spans as spans

    monkeypatch.setattr(spans, "SEGMENT", 64)
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(1000))
    df = spark.createDataFrame([(1, text), (2, "z" + text[300:700])], "doc long, text string")
    runs = shared_runs(df, "doc", "text", 50, m=16)
    assert [tuple(r) for r in span_pairs(runs).collect()] == [(1, 2)]
    assert {r.doc: r.n_shared for r in span_shares(df, runs, "doc", "text", 50).collect()} == {1: 400, 2: 400}


def test_windows_are_compared_as_text(monkeypatch):
    """Windows with equal hashes and different texts get different numbers."""
    text = "abcdefghij" * 3 + "abcdefghiX"
    chars = _chars(text)
    at = np.arange(len(text) - 4)
    want: dict[str, set[int]] = {}
    for i in at:
        want.setdefault(text[i : i + 5], set()).add(i)
    real = spans_module._gram_hash
    for hashing in (real, lambda chars, n: real(chars, n) % np.uint64(3)):
        monkeypatch.setattr(spans_module, "_gram_hash", hashing)
        got: dict[int, set[int]] = {}
        for i, n in zip(at, _numbers(chars, at, np.zeros(len(at), dtype=np.int64), 5)):
            got.setdefault(int(n), set()).add(int(i))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_hot_bucket_grows_in_proportion(spark):
    """The rows that leave a hot bucket are as many as its windows, not as the square of its strings."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    sizes = []
    for n in (40, 400):
        df = spark.createDataFrame([(h, i.to_bytes(16, "big"), word(14) + "z" * 8 + word(14)) for h in (1,) for i in range(n)], "h long, digest binary, s string")
        sizes.append(df.mapInArrow(spans_module._windows(20), "h long, digest binary, lo long, w binary, token long").count())
    assert sizes[1] == 10 * sizes[0] == 400 * 17


def test_classes(spark):
    df = spark.createDataFrame([(i, "the same passage in all of these texts") for i in range(30)] + [(99, "another text of its own entirely here")], "doc long, text string")
    members, sets = span_classes(shared_runs(df, "doc", "text", 20, m=8))
    assert [r.n for r in sets.collect()] == [30] and members.count() == 30
