"""Filling containers of fixed capacity, by swap-based local search.

Records are dealt at random to groups of bounded size, which are packed apart. A group starts from a best-fit packing; then
the emptiest bin gives its records to other underfull bins, by moves, by exchanges of one record for one, or of two for one, each of
which makes a fuller bin fuller still and so increases the sum of squared fills, until the bin is empty or nothing helps.
What stays underfull in the groups, by however little, is pooled and packed again in other company, until it is one group or a turn
saves no more than one container in a thousand.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlens.session import materialize

GROUP = 5000
NEIGHBOURS = 64
GAIN = 0.001


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes, by best fit in decreasing order of size; ties by index."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            free, b = capacity - sizes[i], len(bins) - 1
        else:
            free, b = room.pop(at)
            bins[b].append(i)
            free -= sizes[i]
        if free:
            insort(room, (free, b))
    return bins


def local_search(sizes: list[int], bins: list[list[int]], capacity: int, neighbours: int = NEIGHBOURS) -> list[list[int]]:
    """Empty underfull bins by moves, one-for-one and two-for-one exchanges with other underfull bins.

    The others are tried from the roomiest on, `neighbours` at a time; further ones only where those don't help, but then all of them.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    order = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: (fill[b], b))
    settled: set[int] = set()
    for source in order:
        if not bins[source]:
            continue
        others = [b for b in order if b != source and bins[b] and b not in settled and fill[b] < capacity]
        # emptying it needs at least its fill of room elsewhere
        if sum(capacity - fill[b] for b in others) < fill[source]:
            settled.add(source)
            continue
        progress = True
        while bins[source] and progress:
            progress = False
            for i in sorted(bins[source], key=lambda i: -sizes[i]):
                x, best = sizes[i], None
                for tried, b in enumerate(others):
                    if tried % neighbours == 0 and best is not None:
                        break
                    free = capacity - fill[b]
                    if free >= x:
                        cost = (0, free - x)
                        if best is None or cost < best[0]:
                            best = (cost, b, ())
                        continue
                    if best is not None and best[0][0] == 0 or free == 0 or fill[b] < fill[source]:
                        continue
                    inside = bins[b]
                    for p, j in enumerate(inside):  # x for one that is smaller by at most the room
                        y = sizes[j]
                        if x > y >= x - free and (best is None or (1, y) < best[0]):
                            best = ((1, y), b, (j,))
                        elif y < x - free:
                            for q in range(p):  # x for two
                                both = y + sizes[inside[q]]
                                if x > both >= x - free and (best is None or (1, both) < best[0]):
                                    best = ((1, both), b, (j, inside[q]))
                if best is None:
                    continue
                _, b, back = best
                given = sum(sizes[j] for j in back)
                bins[source].remove(i)
                bins[b] = [j for j in bins[b] if j not in back] + [i]
                bins[source].extend(back)
                fill[source] += given - x
                fill[b] += x - given
                progress = True
                break
        if bins[source]:
            settled.add(source)
    return [b for b in bins if b]


def _packer(turn: int, last: bool, neighbours: int):
    """Packs one group of one window; bins with room are open for the next turn. `head` marks one row of each bin."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
        sizes = pdf["tokens"].tolist()
        capacity, window, grp = int(pdf["capacity"].iloc[0]), pdf["window_id"].iloc[0], pdf["grp"].iloc[0]
        name, free, head = [""] * len(sizes), [0] * len(sizes), [False] * len(sizes)
        for k, b in enumerate(local_search(sizes, best_fit(sizes, capacity), capacity, neighbours)):
            room = capacity - sum(sizes[i] for i in b)
            head[b[0]] = True
            for i in b:
                name[i], free[i] = f"{turn}-{window}-{grp}-{k}", room
        pdf["container_id"], pdf["open"], pdf["head"] = name, [not last and f > 0 for f in free], head
        return pdf[["window_id", "capacity", "container_id", "doc_id", "piece", "start", "tokens", "grp", "open", "head"]]

    return run


def pack(items: DataFrame, windows: list[tuple[int, int]], group: int = GROUP, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Containers for items(doc_id, n_tokens): rows (window_id, container_id, doc_id, piece, start, tokens).

    windows: (window_id, capacity). An item above the capacity fills containers of its own with pieces of just that capacity; the rest
    of it, and any other item, lies in one container whole. Items with null or less than one token are left out. Equal keys are
    items of their own. `piece` counts from 0, `start` is the piece's first token.
    """
    there = items.where("n_tokens > 0").select("doc_id", F.col("n_tokens").cast("long").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("window_id"), F.lit(c).cast("long").alias("capacity")) for w, c in windows])).alias("w")
    sized = there.select("doc_id", "n", each).select("doc_id", "n", "w.*").withColumn("full", F.expr("case when n > capacity then n div capacity else 0 end"))
    whole = sized.where("full > 0").select("window_id", "doc_id", "capacity", F.explode(F.expr("sequence(0L, full - 1)")).alias("piece")).select(
        "window_id", F.concat_ws("-", F.lit("whole"), "window_id", "doc_id", "piece").alias("container_id"), "doc_id", F.col("piece").cast("int"), (F.col("piece") * F.col("capacity")).alias("start"), F.col("capacity").alias("tokens"))
    rest = sized.select("window_id", "capacity", "doc_id", F.col("full").cast("int").alias("piece"), (F.col("full") * F.col("capacity")).alias("start"), (F.col("n") - F.col("full") * F.col("capacity")).alias("tokens")).where("tokens > 0")
    total = there.count()
    done, count = [whole], max(1, -(-total // group))
    todo, turn, before = rest.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(count))), 0, None
    schema = "window_id int, capacity long, container_id string, doc_id long, piece int, start long, tokens long, grp long, open boolean, head boolean"
    columns = ["window_id", "container_id", "doc_id", "piece", "start", "tokens"]
    while True:
        last = count == 1
        out = materialize(todo.select("window_id", "capacity", "doc_id", "piece", "start", "tokens", F.col("grp").cast("long")).groupBy("window_id", "grp").applyInPandas(_packer(turn, last, neighbours), schema))
        done.append(out.where("not open").select(columns))
        if last:
            break
        bins, underfull = out.agg(F.sum(F.col("head").cast("int")), F.sum((F.col("head") & F.col("open")).cast("int"))).first()
        left = out.where("open")
        if not underfull:
            break
        if before is not None and before - bins <= GAIN * before:  # the same records in other company needed hardly fewer containers
            done.append(left.select(columns))
            break
        # groups keep their bounded size, so what was open in many of them meets in few
        pool = left.groupBy("window_id").count().agg(F.max("count")).first()[0]
        before, count, turn = underfull, max(1, -(-pool // group)), turn + 1
        todo = left.drop("container_id", "open", "head").withColumn("grp", F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(count)))
    result = done[0].withColumn("window_id", F.col("window_id").cast("int"))
    for part in done[1:]:
        result = result.unionByName(part)
    return result
