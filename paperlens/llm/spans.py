"""Long exact spans shared between records, by super-k-mers.

A window is `k` successive characters. Its minimiser is the smallest hash of the `m`-grams in it, a function of
its content, so equal windows have equal minimisers. Consecutive windows with one minimiser travel as one packed string, a
super-k-mer, to the bucket of that minimiser, where sorting tells which windows are equal.

Before strings travel, the minimisers alone do: one that occurs in a single record can't be shared, so its strings stay at home.
Within a bucket equal strings are sent once and sorted by the hashes of their windows; windows with equal hashes are compared as
text. A bucket with very many different strings isn't sorted by one task: each of its windows is sent once, as a digest, and
counted by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlens.session import materialize

SEGMENT = 1_000_000
M = 32
HOT = 20_000
MOST = 2_000_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _gram_hash(chars: np.ndarray, n: int) -> np.ndarray:
    """Hash of the `n` characters from each place on (places at the end that have fewer are left out)."""
    level, width = _mix((chars.astype(np.uint64) + np.uint64(1)) * _A), 1
    out, done = None, 0
    while True:
        if n & width:  # the parts of n, the smallest first
            if out is None:
                out = level
            else:
                size = min(len(level), len(out) - width) if len(out) > width else 0
                out = level[:size] * np.uint64(pow(_BASE, done, 1 << 64)) + out[width : width + size]
            done += width
            if done == n:
                return _mix(out)
        size = max(0, len(level) - width)
        level = level[:size] * np.uint64(pow(_BASE, width, 1 << 64)) + level[width : width + size]
        width *= 2


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:]) if len(x) > width else x[:0]
        width *= 2
    rest = n - width
    return np.minimum(x[:-rest], x[rest:]) if rest and len(x) > rest else (x[:0] if rest else x)


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _pieces(texts: list[str], k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers of some texts: minimiser, number of the text, first window, number of windows."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    low = _sliding_min(_gram_hash(_chars("".join(texts)), m), k - m + 1)
    fine = np.zeros(len(low), dtype=bool)
    for at, size in zip(begins, sizes):
        fine[at : at + size - k + 1] = True
    first = np.zeros(len(low), dtype=bool)
    first[begins[begins < len(low)]] = True
    change = fine & (first | np.r_[True, (low[1:] != low[:-1]) | ~fine[:-1]])
    at = np.flatnonzero(change)
    owner = np.searchsorted(begins, at, side="right") - 1
    end = np.minimum(np.r_[at[1:], len(low)], (begins + sizes - k + 1)[owner])
    return low[at].view(np.int64), owner, at - begins[owner], end - at


def super_kmers(df: DataFrame, key: str, text: str, k: int = 200, m: int = M) -> DataFrame:
    """Rows (h, doc, start, windows) for every run of windows with one minimiser; texts shorter than `k` have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(docs: list[int], offsets: list[int], texts: list[str]) -> pa.RecordBatch:
            h, owner, start, windows = _pieces(texts, k, m)
            return pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(np.array(docs, dtype=np.int64)[owner]), pa.array(start + np.array(offsets, dtype=np.int64)[owner]), pa.array(windows)],
                ["h", "doc", "start", "windows"],
            )

        for batch in batches:
            docs, offsets, texts, held = [], [], [], 0
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for lo in range(0, len(value) - k + 1, SEGMENT):
                    piece = value[lo : lo + SEGMENT + k - 1]
                    docs.append(doc), offsets.append(lo), texts.append(piece)
                    held += len(piece)
                    if held >= SEGMENT:
                        yield emit(docs, offsets, texts)
                        docs, offsets, texts, held = [], [], [], 0
            if texts:
                yield emit(docs, offsets, texts)

    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")).where(f"doc is not null and char_length(text) >= {k}")
    return rows.mapInArrow(run, "h long, doc long, start long, windows long")


def _cut(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            h, docs, starts, strings, digests, held = [], [], [], [], [], 0
            for doc, value, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for x in at:
                    s = value[x["start"] : x["start"] + x["windows"] + k - 1]
                    h.append(x["h"]), docs.append(doc), starts.append(x["start"]), strings.append(s)
                    digests.append(hashlib.blake2b(s.encode(), digest_size=16).digest())
                    held += len(s)
                if held > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(strings, pa.string()), pa.array(digests, pa.binary())], ["h", "doc", "start", "s", "digest"])
                    h, docs, starts, strings, digests, held = [], [], [], [], [], 0
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(strings, pa.string()), pa.array(digests, pa.binary())], ["h", "doc", "start", "s", "digest"])

    return run


def _numbers(chars: np.ndarray, at: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """A number for each window (given by its first character), the same for equal windows only.

    Windows are sorted by two hashes. Each is then compared with the one before it in the order as text; in a run of windows
    that repeats another run only the characters that are new need a look.
    """
    hashes, second = _gram_hash(chars, k), _gram_hash(chars[::-1], k)[::-1]
    v, u = hashes[at], second[at]
    order = np.argsort(v, kind="stable")
    if np.any((v[order][1:] == v[order][:-1]) & (u[order][1:] != u[order][:-1])):
        order = np.lexsort((u, v))
    v, u = v[order], u[order]
    same = (v[1:] == v[:-1]) & (u[1:] == u[:-1])
    number = np.empty(len(at), dtype=np.int64)
    number[order] = np.cumsum(np.r_[0, ~same])
    before = np.full(len(at), -1, dtype=np.int64)
    before[order[1:][same]] = at[order[:-1][same]]
    has = before >= 0
    goes_on = np.zeros(len(at), dtype=bool)
    goes_on[1:] = has[1:] & has[:-1] & (at[1:] == at[:-1] + 1) & (owner[1:] == owner[:-1]) & (before[1:] == before[:-1] + 1)
    equal = bool(np.all(chars[at[goes_on] + k - 1] == chars[before[goes_on] + k - 1]))
    fresh = np.flatnonzero(has & ~goes_on)
    reach = np.arange(k)
    for lo in range(0, len(fresh), 20_000):
        part = fresh[lo : lo + 20_000, None]
        equal = equal and bool(np.all(chars[at[part] + reach] == chars[before[part] + reach]))
    if not equal:  # different windows with equal hashes: number them by their text
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(chars[i : i + k].tobytes(), len(known)) for i in at], dtype=np.int64)
    return number


def _token(digests: list[bytes]) -> np.ndarray:
    return _mix(np.frombuffer(b"".join(d[:8] for d in digests), dtype="<u8").astype(np.uint64))


def _bucket(h: list[int], digests: list[bytes], strings: list[str], k: int) -> pa.RecordBatch:
    """Which windows of the strings of some whole buckets are equal.

    Windows with the same set of strings are one class. Gives rows (h, class, digest, lo, windows): a run of windows of a string, by class.
    """
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    chars = _chars("".join(strings))
    fine = np.zeros(len(chars) - k + 1, dtype=bool)
    for at, size in zip(begins, sizes):
        fine[at : at + size - k + 1] = True
    at = np.flatnonzero(fine)
    owner = np.searchsorted(begins, at, side="right") - 1
    window = _numbers(chars, at, owner, k)
    # the set of strings of each window, as a sum of their digests; a window repeated in a string counts once
    pair = np.unique(window * len(strings) + owner)
    token = _token(digests)
    mark = np.zeros(window.max() + 1, dtype=np.uint64)
    np.add.at(mark, pair // len(strings), token[pair % len(strings)])
    group = mark[window]
    run = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)])
    length = np.diff(np.r_[run, len(at)])
    who = owner[run]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(h, dtype=np.int64)[who]), pa.array(group[run].view(np.int64)), pa.array([digests[i] for i in who], pa.binary()), pa.array(at[run] - begins[who]), pa.array(length)],
        ["h", "class", "digest", "lo", "windows"],
    )


def _buckets(k: int, most: int = MOST):
    """Batches come sorted by h; buckets are gathered until they have `most` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[], [], []]
        held, last = 0, None
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if held > most and row[0] != last:
                    yield _bucket(*rows, k)
                    rows, held = [[], [], []], 0
                for column, x in zip(rows, row):
                    column.append(x)
                held += len(row[2])
                last = row[0]
        if rows[0]:
            yield _bucket(*rows, k)

    return run


def _windows(k: int):
    """Every window of the strings of hot buckets: (h, digest, lo, w, token); only the first of equal windows of a string has a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for h, digest, value in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                token, raw, seen = int(_token([digest]).view(np.int64)[0]), value.encode("utf-32-le"), set()
                for first in range(0, len(value) - k + 1, 50_000):
                    count = min(50_000, len(value) - k + 1 - first)
                    marks = [hashlib.blake2b(raw[4 * i : 4 * (i + k)], digest_size=16).digest() for i in range(first, first + count)]
                    tokens = [None if m in seen or seen.add(m) else token for m in marks]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([h] * count, pa.int64()), pa.array([digest] * count, pa.binary()), pa.array(range(first, first + count), pa.int64()), pa.array(marks, pa.binary()), pa.array(tokens, pa.int64())],
                        ["h", "digest", "lo", "w", "token"],
                    )

    return run


def _hot_runs(strings: DataFrame, k: int) -> DataFrame:
    """The runs of hot buckets, as `_bucket` gives them, from one row for each window."""
    rows = materialize(strings.select("h", "digest", "s").mapInArrow(_windows(k), "h long, digest binary, lo long, w binary, token long"))
    classes = rows.groupBy("h", "w").agg(F.bit_xor("token").alias("class"))
    marked = rows.select("h", "w", "digest", "lo").join(classes, ["h", "w"])
    along = Window.partitionBy("h", "digest", "class").orderBy("lo")  # a string has few windows beside its length
    island = marked.withColumn("island", F.col("lo") - F.row_number().over(along))
    return island.groupBy("h", "class", "digest", "island").agg(F.min("lo").alias("lo"), F.count("*").alias("windows")).select("h", "class", "digest", "lo", "windows")


def shared_runs(df: DataFrame, key: str, text: str, k: int = 200, m: int = M, hot: int = HOT, most: int = MOST) -> DataFrame:
    """Runs of windows that occur in more than one record: rows (h, class, doc, start, windows).

    All records with a row of one (h, class) share every window of it with one another; `start` counts code points from 0.
    Null keys, null texts and texts shorter than `k` have no rows; rows that repeat a key are one record.
    """
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    places = materialize(super_kmers(docs, "doc", "text", k, m))
    shared = places.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("h")
    # the places of a text in lists by segment, so no list is longer than a segment
    kept = places.join(shared, "h", "left_semi").groupBy("doc", F.expr(f"start div {SEGMENT}").alias("segment")).agg(F.collect_list(F.struct("h", "start", "windows")).alias("at"))
    cut = docs.where(f"doc is not null and char_length(text) >= {k}").join(kept, "doc").select("doc", "text", "at")
    pieces = materialize(cut.mapInArrow(_cut(k), "h long, doc long, start long, s string, digest binary"))
    strings = pieces.groupBy("h", "digest").agg(F.first("s").alias("s"))
    size = materialize(pieces.groupBy("h").agg(F.approx_count_distinct("digest").alias("n")).where(f"n > {hot}").select("h"))
    some = not size.isEmpty()
    cool = strings.join(size, "h", "left_anti") if some else strings
    runs = cool.repartition("h").sortWithinPartitions("h").select("h", "digest", "s").mapInArrow(_buckets(k, most), "h long, class long, digest binary, lo long, windows long")
    if some:
        runs = runs.unionByName(_hot_runs(strings.join(size, "h", "left_semi"), k))
    where = pieces.select("h", "digest", "doc", "start").distinct()
    found = materialize(runs.join(where, ["h", "digest"]).select("h", "class", "doc", (F.col("start") + F.col("lo")).alias("start"), "windows"))
    several = found.groupBy("h", "class").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("h", "class")
    return found.join(several, ["h", "class"], "left_semi")


def span_classes(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets of records that share something: members (h, class, doc) and sets (h, class, n).

    Classes with one set of records, as the many windows of a copy have, are one: sets are told apart by their size and two
    independent sums of hashes.
    """
    members = materialize(runs.select("h", "class", "doc").distinct())
    sets = members.groupBy("h", "class").agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc").cast("decimal(20,0)")).alias("x"), F.sum(F.xxhash64("doc", F.lit(7)).cast("decimal(20,0)")).alias("y"), F.min("doc").alias("low"))
    one = materialize(sets.groupBy("n", "x", "y", "low").agg(F.min(F.struct("h", "class")).alias("c")).select(F.col("c.h").alias("h"), F.col("c.class").alias("class"), "n"))
    return members.join(one.select("h", "class"), ["h", "class"], "left_semi"), one


def span_pairs(runs: DataFrame, block: int = 1000) -> DataFrame:
    """Pairs of records that share a window: rows doc_a < doc_b.

    A set of more than `block` records is cut into blocks, and each two of them are a unit of work with a key of its own. The
    result itself grows with the square of a set; `span_classes` gives the same as sets and members.
    """
    members, one = span_classes(runs)
    kept = members.join(one.withColumn("parts", F.expr(f"cast((n - 1) div {block} + 1 as int)")), ["h", "class"]).withColumn("part", F.expr("pmod(xxhash64(doc), parts)"))
    every = F.explode(F.expr("sequence(0, parts - 1)"))
    a = kept.select("h", "class", F.col("doc").alias("doc_a"), F.col("part").cast("int").alias("i"), every.alias("j"))
    b = kept.select("h", "class", F.col("doc").alias("doc_b"), F.col("part").cast("int").alias("j"), every.alias("i"))
    return a.join(b, ["h", "class", "i", "j"]).where("doc_a < doc_b").select("doc_a", "doc_b").distinct()


def span_shares(df: DataFrame, runs: DataFrame, key: str, text: str, k: int = 200) -> DataFrame:
    """For every record: its length, the characters that lie in a span found elsewhere, and their share.

    Rows (doc, n_chars, n_shared, share). A null or empty text has 0 characters and a share of 0.
    """
    spans = runs.select("doc", F.col("start").alias("lo"), (F.col("start") + F.col("windows") + (k - 1)).alias("hi")).distinct()
    # union of intervals: one that begins after all before it have ended opens a new island
    before = Window.partitionBy("doc").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    reach = spans.withColumn("reach", F.coalesce(F.max("hi").over(before), F.col("lo")))
    covered = reach.groupBy("doc").agg(F.sum(F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", "reach"))).alias("n_shared"))
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.coalesce(F.char_length(f"`{text}`"), F.lit(0)).cast("long").alias("n_chars")).where("doc is not null").distinct()
    out = docs.join(covered, "doc", "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)).cast("long"))
    return out.select("doc", "n_chars", "n_shared", F.when(F.col("n_chars") > 0, F.col("n_shared") / F.col("n_chars")).otherwise(0.0).alias("share"))
