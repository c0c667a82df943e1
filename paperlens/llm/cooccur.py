"""Items that appear together: stripes of co-occurring neighbours, merged by key, with log-likelihood ratios.

Before any pair is formed, items in fewer baskets than a pair must have are dropped, which loses no pair (a pair is at most
as frequent as either of its items). Each task then keeps, for each item, an associative array of the items that followed
it in its baskets with their counts, and sends the arrays on only when it has read a bounded number of pairs. The arrays
travel as they are, keyed by item and block of neighbours, and those of one key are merged array by array; pairs appear only after that.
A stripe has as many blocks as its item has `wide` baskets, so that of a hot item is merged by several tasks. A basket of more
than `block` items is cut into blocks, too, and each two of its blocks are one unit of work with a key of its own.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlens.session import materialize

FLUSH = 4_000_000


def normalise_tag(tag: Column) -> Column:
    """Lower case, no outer blanks, each inner run of blanks (spaces and tabs) as one space."""
    return F.trim(F.regexp_replace(F.lower(tag), "[ \\t]+", " "))


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(one, parts, two, parts_two): sorted item lists with the numbers of blocks of their stripes; pairs within `one`, or between
    `one` and `two` where that isn't null. Gives (item, part, neighbours, counts)."""
    words: dict[str, int] = {}
    names: list[str] = []
    parts: list[int] = []
    codes: list[np.ndarray] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        pair, count = np.unique(np.concatenate(codes), return_counts=True)
        a, b = pair >> 32, pair & 0xFFFFFFFF
        many = np.array(parts, dtype=np.int64)
        if many.max() > 1:
            spot = np.array([zlib.crc32(x.encode()) for x in names], dtype=np.int64)[b] % many[a]
            order = np.lexsort((b, spot, a))
            a, b, count, spot = a[order], b[order], count[order], spot[order]
        else:
            spot = np.zeros(len(a), dtype=np.int64)
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (spot[1:] != spot[:-1])])
        offsets = np.r_[starts, len(a)].astype(np.int32)
        dictionary = pa.array(names, pa.string())
        step = 20_000  # stripes in a batch
        for lo in range(0, len(starts), step):
            at = offsets[lo : lo + step + 1]
            inner = slice(at[0], at[-1])
            lists = [pa.ListArray.from_arrays(pa.array(at - at[0]), x) for x in (dictionary.take(pa.array(b[inner])), pa.array(count[inner].astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([dictionary.take(pa.array(a[at[:-1]])), pa.array(spot[at[:-1]].astype(np.int32)), *lists], ["item", "part", "neighbours", "counts"])

    def code(items: list[str], sizes: list[int]) -> np.ndarray:
        out = np.empty(len(items), dtype=np.int64)
        for i, x in enumerate(items):
            n = words.get(x)
            if n is None:
                n = words[x] = len(names)
                names.append(x), parts.append(sizes[i])
            out[i] = n
        return out

    for batch in batches:
        for one, sizes, two, sizes_two in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            a = code(one, sizes)
            if two is None:
                i, j = np.triu_indices(len(a), 1)
                left, right = a[i], a[j]
            else:
                b = code(two, sizes_two)
                left, right = np.repeat(a, len(b)), np.tile(b, len(a))
                ordered = np.array([x < y for x in one for y in two], dtype=bool)
                left, right = np.where(ordered, left, right), np.where(ordered, right, left)
            codes.append(left << 32 | right)
            held += len(left)
            if held >= FLUSH:
                yield from flush()
                words.clear(), names.clear(), parts.clear(), codes.clear()
                held = 0
    if held:
        yield from flush()


def _merge(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stripes sorted by (item, part): those of one key are added up, and the pairs of at least `least` baskets given out."""
        here, stripe = None, Counter()
        out: list[list] = [[], [], []]

        def close() -> None:
            for neighbour, n in stripe.items():
                if n >= least:
                    out[0].append(here[0]), out[1].append(neighbour), out[2].append(n)
            stripe.clear()

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["item_a", "item_b", "n_ab"])
            for column in out:
                column.clear()
            return made

        for batch in batches:
            for item, part, neighbours, counts in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if here != (item, part):
                    close()
                    here = (item, part)
                    if len(out[0]) >= 50_000:
                        yield batch_of()
                if stripe:
                    for x, n in zip(neighbours, counts):
                        stripe[x] += n
                else:
                    stripe.update(dict(zip(neighbours, counts)))
        close()
        if out[0]:
            yield batch_of()

    return run


def cooccurrence(df: DataFrame, basket: str, item: str, min_count: int = 1, min_share: float = 0.0, block: int = 1024, wide: int = 100_000) -> DataFrame:
    """Pairs of items that occur together in at least `min_count` baskets and `min_share` of all baskets.

    Returns item_a < item_b (by code point), n_ab, n_a, n_b, n (baskets in the table), ratio (n_ab n / (n_a n_b), how much more often than
    by chance) and llr, the log-likelihood ratio of independence, negative where the pair is rarer than by chance.

    An item counts once in a basket, however often it is repeated. Rows with a null item count for n only, with a null basket not at
    all. The empty string is an item like others. An empty table gives an empty result.
    """
    rows = materialize(df.select(F.col(f"`{basket}`").alias("basket"), F.col(f"`{item}`").alias("item")).where("basket is not null").distinct())
    n = rows.select(F.countDistinct("basket")).first()[0]
    least = max(1, min_count, int(np.ceil(round(min_share * n, 9))))
    items = rows.where("item is not null")
    often = materialize(items.groupBy("item").agg(F.count("*").alias("n_item")).where(F.col("n_item") >= least))
    kept = materialize(items.join(often.withColumn("parts", F.expr(f"cast(1 + n_item div {wide} as int)")).select("item", "parts"), "item"))
    # Baskets in blocks. A basket is counted before it is collected, and no list is longer than a few blocks' average.
    sized = kept.groupBy("basket").agg(F.count("*").alias("k")).where("k > 1")
    pieces = kept.join(sized, "basket").withColumn("blocks", F.expr(f"(k - 1) div {block} + 1")).withColumn("block", F.expr("pmod(xxhash64(item), blocks)"))
    lists = pieces.groupBy("basket", "block", "blocks").agg(F.sort_array(F.collect_list(F.struct("item", "parts"))).alias("x"))
    lists = lists.select("basket", "block", "blocks", F.col("x.item").alias("one"), F.col("x.parts").alias("parts"))
    single = lists.select("one", "parts", F.lit(None).cast("array<string>").alias("two"), F.lit(None).cast("array<int>").alias("parts_two"))
    # of a large basket each block meets all later ones, under keys of their own
    large = lists.where("blocks > 1")
    ahead = large.where("block < blocks - 1").withColumn("other", F.explode(F.expr("sequence(block + 1, blocks - 1)")))
    later = large.select("basket", F.col("block").alias("other"), F.col("one").alias("two"), F.col("parts").alias("parts_two"))
    cross = ahead.join(later, ["basket", "other"]).select("one", "parts", "two", "parts_two")
    stripes = single.unionByName(cross).mapInArrow(_stripes, "item string, part int, neighbours array<string>, counts array<long>")
    merged = stripes.repartition("item", "part").sortWithinPartitions("item", "part").mapInArrow(_merge(least), "item_a string, item_b string, n_ab long")
    out = merged.join(often.select(F.col("item").alias("item_a"), F.col("n_item").alias("n_a")), "item_a").join(often.select(F.col("item").alias("item_b"), F.col("n_item").alias("n_b")), "item_b")
    out = out.withColumn("n", F.lit(n).cast("long"))

    def part(k: str, row: str, col: str) -> str:
        return f"case when ({k}) > 0 then ({k}) * ln(double({k}) * n / (double({row}) * ({col}))) else 0 end"

    llr = "2 * (" + " + ".join([part("n_ab", "n_a", "n_b"), part("n_a - n_ab", "n_a", "n - n_b"), part("n_b - n_ab", "n - n_a", "n_b"), part("n - n_a - n_b + n_ab", "n - n_a", "n - n_b")]) + ")"
    return out.select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", "n", F.expr("double(n_ab) * n / (double(n_a) * n_b)").alias("ratio"),
        F.expr(f"case when double(n_ab) * n < double(n_a) * n_b then -1 else 1 end * {llr}").alias("llr"),
    )
