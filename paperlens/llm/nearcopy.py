"""Near-copies by min-hash banding over shingles of five words, of whole texts and of their beginnings.

Whole texts share a bucket where they are alike as wholes. A text that was cut is the beginning of another, so each text also has bands for
its beginnings of 32, 64, 128, ... shingles: the longest beginning of a cut text, at least half of it, shares a bucket with the
beginning of that length of its original, however much longer that is.

No bucket is expanded into all its pairs. Buckets of bounded size are; larger ones are dealt into groups of that size, and a text that
ends like a longer one of its group is left out of the next turn, as the longer one stands for both. A family of copies thus
shrinks by a constant factor a turn. What doesn't shrink are texts with endings of their own; those meet block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlens.llm.words import TOKEN
from paperlens.session import discard, materialize

BANDS, ROWS, WORDS = 16, 5, 5
START, START_BANDS, START_ROWS = 32, 4, 4
GROUP = 64
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_MUL = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = _RANDOM.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_BLOCK, _PIECE = 2_048, 512  # a block of hash values stays in the cache of a core
_HELD = 16_384


def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def _ordered(text: str, cache: dict[str, int]) -> np.ndarray:
    """Hashes of the shingles in their order; a text of fewer words is one shingle."""
    words = TOKEN.findall(text.casefold())
    codes = []
    for w in words:
        c = cache.get(w)
        if c is None:
            if len(cache) > 500_000:
                cache.clear()
            c = cache[w] = _word_hash(w)
        codes.append(c)
    x = np.array(codes, dtype=np.uint64)
    n = min(WORDS, len(x))
    out = np.zeros(max(0, len(x) - n + 1) if n else 0, dtype=np.uint64)
    for i in range(n):
        out = out * _STEP + (x[i : len(x) - n + 1 + i] ^ (x[i : len(x) - n + 1 + i] >> np.uint64(29)))
    return out


def _shingles(text: str, cache: dict[str, int]) -> np.ndarray:
    return np.unique(_ordered(text, cache))


def similarity(a: str, b: str) -> float:
    """Jaccard similarity of the sets of shingles."""
    x, y = _shingles(a, {}), _shingles(b, {})
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 0.0


def containment(a: str, b: str, cache: dict[str, int] | None = None) -> float:
    """Share of the shingles of `a` that `b` has, too."""
    cache = {} if cache is None else cache
    x = _shingles(a, cache)
    return len(np.intersect1d(x, _shingles(b, cache), assume_unique=True)) / len(x) if len(x) else 0.0


def _lows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least values of all hash functions over the beginnings of each text: (values, number of the text, shingles of the beginning).

    A text has one row for each beginning of START * 2**i shingles, and its last row is that of the whole; where that is no such
    beginning, the number of shingles is 0.
    """
    piece_starts, segment_of, bounds, owners = [], [], [], []
    offset = 0
    for number, x in enumerate(texts):
        lo, hi = 0, START
        while lo < len(x):
            end = min(hi, len(x))
            for at in range(lo, end, _PIECE):
                piece_starts.append(offset + at), segment_of.append(len(bounds))
            bounds.append(hi if hi <= len(x) else 0), owners.append(number)
            lo, hi = end, hi * 2
        offset += len(x)
    flat = np.concatenate(texts)
    edges = np.array([*piece_starts, len(flat)], dtype=np.int64)
    mins = np.empty((len(piece_starts), BANDS * ROWS), dtype=np.uint64)
    lo = 0
    while lo < len(piece_starts):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + _BLOCK, side="right")) - 1)
        y = flat[edges[lo] : edges[hi], None] * _MUL
        y += _ADD
        mins[lo:hi] = np.minimum.reduceat(y, edges[lo:hi] - edges[lo], axis=0)
        lo = hi
    segment_of_piece = np.array(segment_of)
    lows = np.minimum.reduceat(mins, np.flatnonzero(np.r_[True, segment_of_piece[1:] != segment_of_piece[:-1]]), axis=0)
    owner, bound = np.array(owners), np.array(bounds)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    for a, b in zip(first, np.r_[first[1:], len(owner)]):
        if b - a > 1:
            np.minimum.accumulate(lows[a:b], axis=0, out=lows[a:b])
    return lows, owner, bound


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def bands(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, size, probe, bucket) of every text with at least one word; null texts have none.

    A row with `probe` looks for longer texts in its bucket: those of the whole text and of its longest beginning do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}

        def emit(keys: pa.Array, at: list[int], sizes: list[int], shingles: list[np.ndarray]) -> pa.RecordBatch:
            lows, owner, bound = _lows(shingles)
            whole = np.r_[owner[1:] != owner[:-1], True]
            start = bound > 0
            last = start & (whole | ~np.r_[start[1:], False])  # the longest beginning of a text
            full = (lows[whole].reshape(-1, BANDS, ROWS) * _POWERS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
            part = (lows[start][:, : START_BANDS * START_ROWS].reshape(-1, START_BANDS, START_ROWS) * _POWERS[:START_ROWS]).sum(axis=2, dtype=np.uint64)
            part += np.uint64(1000) * bound[start, None].astype(np.uint64) + np.arange(START_BANDS, dtype=np.uint64)
            who = np.r_[np.repeat(owner[whole], BANDS), np.repeat(owner[start], START_BANDS)]
            probe = np.r_[np.ones(full.size, dtype=bool), np.repeat(last[start], START_BANDS)]
            bucket = _mix(np.r_[full.ravel(), part.ravel()]).view(np.int64)
            return pa.RecordBatch.from_arrays([keys.take(pa.array(np.array(at)[who])), pa.array(np.array(sizes, dtype=np.int32)[who]), pa.array(probe), pa.array(bucket)], [key, "size", "probe", "bucket"])

        for batch in batches:
            at, sizes, shingles, held = [], [], [], 0
            for i, value in enumerate(batch.column(1).to_pylist()):
                x = _ordered(value, cache)
                if not len(x):
                    continue
                at.append(i), sizes.append(len(value.rstrip())), shingles.append(x)
                held += len(x)
                if held >= _HELD:
                    yield emit(batch.column(0), at, sizes, shingles)
                    at, sizes, shingles, held = [], [], [], 0
            if at:
                yield emit(batch.column(0), at, sizes, shingles)

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"{key} {kind}, size int, probe boolean, bucket long")


def _pairs(a: DataFrame, b: DataFrame, key: str, on: list[str]) -> DataFrame:
    """Pairs (key, longer) of the members of a group, the longer one by size, then by key."""
    long = b.select(*on, F.col(key).alias("longer"), F.col("size").alias("top"))
    return a.where("probe").join(long, on).where((F.col("size") < F.col("top")) | (F.col("size") == F.col("top")) & (F.col(key) < F.col("longer"))).select(key, "longer").distinct()


def compare_copies(df: DataFrame, compare: Callable[[DataFrame], DataFrame], key: str = "id", text: str = "text", group: int = GROUP) -> DataFrame:
    """What `compare` makes of the pairs of near-copies: it takes pairs (key, longer) and gives rows (key, longer, outcome).

    The texts are to be different. Outcome `same` means that both end alike, so the longer stands for the other from then on; `cut`, that the
    shorter is settled; anything else, that it must be compared with others, too.
    """
    rows = materialize(bands(df, key, text))
    shared = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max("probe").alias("any")).where("n > 1 and any").select("bucket", "n"))
    live = materialize(rows.join(shared, "bucket"))
    discard(rows)
    small = live.where(f"n <= {group}")
    found = [materialize(compare(_pairs(small, small, key, ["bucket"])))]
    live = live.where(f"n > {group}").drop("n")
    held, turn = live.count(), 0
    while held:
        sizes = live.groupBy("bucket").agg(F.count("*").alias("n"))
        dealt = live.join(sizes, "bucket").withColumn("grp", F.pmod(F.xxhash64(key, F.lit(turn)), F.expr(f"(n - 1) div {group} + 1")))
        now = materialize(compare(_pairs(dealt, dealt, key, ["bucket", "grp"])))
        found.append(now)
        settled = now.where("outcome in ('same', 'cut')").select(F.col(key).alias("_key"), "longer")
        # a text goes where the one that stands for it is in the same bucket
        stands = live.select("bucket", F.col(key).alias("longer"))
        gone = live.join(settled, live[key] == settled["_key"]).select("bucket", key, "longer").join(stands, ["bucket", "longer"], "left_semi").select("bucket", key).distinct()
        live = materialize(live.join(gone, ["bucket", key], "left_anti"))
        left = live.count()
        if left > 0.75 * held:
            # these have endings of their own: every two groups of a bucket meet under a key of their own
            parts = live.join(live.groupBy("bucket").agg(F.count("*").alias("n")), "bucket").withColumn("parts", F.expr(f"(n - 1) div {group} + 1"))
            parts = parts.withColumn("part", F.expr(f"pmod(xxhash64({key}), parts)"))
            every = F.explode(F.expr("sequence(0L, parts - 1)"))
            a = parts.select("bucket", key, "size", "probe", F.col("part").alias("i"), every.alias("j"))
            b = parts.select("bucket", key, "size", "probe", F.col("part").alias("j"), every.alias("i"))
            found.append(materialize(compare(_pairs(a, b, key, ["bucket", "i", "j"]))))
            break
        held, turn = left, turn + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()
