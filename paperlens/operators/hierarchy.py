"""Parent-child links to full hierarchies, by Euler tours and parallel list ranking.

Every node v has two arcs, *down* (entered) and *up* (left). The successor of an arc is fixed by the children of a node, so
all tours of all trees form one set of linked lists, which pointer doubling ranks in log2(longest tour) rounds, whatever the
depth. Doubling also sums +1/-1 along the tour, which is the depth, and carries the last arc, which is the root.

Leaves are peeled in the same rounds instead of level by level (a chain of n nodes would need n levels). A component whose
parent links close a cycle has no end to its tour: its arcs run on exactly two closed tours, one on either side of the cycle.
An edge with both arcs on one tour is part of a tree hanging on the cycle, which peeling would remove; the edges with an
arc on each are what peeling leaves, the cycle itself.

No step groups by parent or root alone: siblings are linked through salted buckets, and list elements have one
predecessor, so the joins of the rounds have no skew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlens.session import discard, materialize, materialize_counted


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key, that with the latest version; ties are broken by a hash of the whole row, null keys are dropped."""
    rest = [c for c in df.columns if c != key]
    order = F.struct(F.col(version), F.xxhash64(*rest))
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(F.struct(*rest), order).alias("_row"))
        .select(key, *[F.col("_row").getField(c).alias(c) for c in rest])
    )


def _arc(node: Column, up: bool) -> Column:
    return node * 2 + (1 if up else 0)


def _tour(nodes: DataFrame, salts: int) -> DataFrame:
    """nodes(id, up): the linked list (e, nxt) of all arcs. Among siblings the larger id comes first."""
    kids = nodes.where("up is not null").select("id", "up", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    inside = Window.partitionBy("up", "salt").orderBy(F.desc("id"))
    chained = kids.withColumn("sib", F.lead("id").over(inside))
    heads = kids.groupBy("up", "salt").agg(F.max("id").alias("head"), F.min("id").alias("tail"))
    along = Window.partitionBy("up").orderBy("salt")  # at most `salts` rows for a parent
    heads = heads.withColumn("after", F.lead("head").over(along)).withColumn("rank", F.row_number().over(along))
    bridge = heads.where("after is not null").select(F.col("tail").alias("id"), "after")
    first = heads.where("rank = 1").select(F.col("up").alias("id"), F.col("head").alias("child"))
    linked = (
        nodes.join(chained.select("id", "sib"), "id", "left").join(bridge, "id", "left").join(first, "id", "left")
        .withColumn("sib", F.coalesce("sib", "after"))
    )
    down = F.struct(_arc(F.col("id"), False).alias("e"), F.coalesce(_arc(F.col("child"), False), _arc(F.col("id"), True)).alias("nxt"), F.lit(1).cast("long").alias("turn"))
    up = F.struct(_arc(F.col("id"), True).alias("e"), F.coalesce(_arc(F.col("sib"), False), _arc(F.col("up"), True)).alias("nxt"), F.lit(-1).cast("long").alias("turn"))
    return linked.select(F.inline(F.array(down, up)))


def _rank(arcs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rank lists (e, nxt, turn) by pointer doubling.

    Returns the arcs of the lists that end (e, len, dep, last), and those on closed tours (e, low) or None.
    A round joins the arcs still under way with the arcs they point at. Arcs at their end that none points at are never
    pointed at later, so a round carries on only what it has just read.
    """
    way_left = {"left": F.count_if(F.col("nxt").isNotNull())}
    start, seen = materialize_counted(arcs.select("e", "nxt", F.lit(1).cast("long").alias("len"), F.col("turn").alias("dep"), F.when(F.col("nxt").isNull(), F.col("e")).alias("last"), F.col("e").alias("low")), **way_left)
    columns = ["e", "nxt", "len", "dep", "last", "low"]
    ended, tables, reach = [start.where("nxt is null").select(columns)], [start], 1
    way = start.where("nxt is not null").select(columns)
    behind = ended[0]
    count = seen["left"]
    while count:
        target = way.unionByName(behind).select(*[F.col(c).alias(f"t_{c}") for c in columns])
        step = way.join(target, way["nxt"] == target["t_e"]).select(
            "e", F.col("t_nxt").alias("nxt"), (F.col("len") + F.col("t_len")).alias("len"), (F.col("dep") + F.col("t_dep")).alias("dep"), F.col("t_last").alias("last"), F.least("low", "t_low").alias("low"),
            *[F.when(F.col("t_nxt").isNull(), F.col(f"t_{c}")).alias(f"p_{c}") for c in columns],
        )
        step, seen = materialize_counted(step, **way_left)
        tables.append(step)
        reach *= 2
        left = seen["left"]
        ended.append(step.where("nxt is null").select(columns))
        way = step.where("nxt is not null").select(columns)
        behind = step.where("p_e is not null").select(*[F.col(f"p_{c}").alias(c) for c in columns]).unionByName(ended[-1])
        if left == count and reach >= count:  # no list has ended: what is left is closed, and each arc has seen its whole tour
            break
        count = left
    done = ended[0]
    for part in ended[1:]:
        done = done.unionByName(part)
    done = materialize(done.select("e", "len", "dep", "last"))
    closed = materialize(way.select("e", "low")) if count else None
    for t in tables:
        discard(t)
    return done, closed


def hierarchy(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", version_col: str | None = None, salts: int = 64) -> DataFrame:
    """All hierarchies of a table of parent-child rows.

    Returns one row per id: id, parent_id, kind, root, depth, entry, exit, n_below.
    kind is `root`, `node`, `dangling` (the chain ends at an id that isn't there), `cycle` or `below_cycle`.
    entry numbers the nodes of a tree in preorder (siblings by salt bucket, then id); all nodes below v are those of the same root with
    v.entry < entry <= v.exit, its ancestors those with entry < v.entry and exit >= v.exit. For a dangling node, root is the
    topmost node that is there. For the nodes of cyclic components root, depth, entry, exit and n_below are null.

    Rows with a null id are dropped. Of rows with one id the latest by `version_col` counts, else the greatest parent. An empty
    table gives an empty result. Other columns are ignored, whatever their names. Ids must lie within 62 bits.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{parent_col}`").cast("long").alias("parent_id"), (F.col(f"`{version_col}`") if version_col else F.lit(0)).alias("version"))
    one = rows.where("id is not null").groupBy("id").agg(F.max(F.struct("version", "parent_id")).alias("m")).select("id", F.col("m.parent_id").alias("parent_id"))
    there = one.select(F.col("id").alias("up"))
    nodes = materialize(one.join(there, one["parent_id"] == there["up"], "left").select("id", "parent_id", "up"))
    done, closed = _rank(_tour(nodes.select("id", "up"), salts))
    pair = F.col("e") % 2 != 0
    at = done.select(F.shiftright("e", 1).alias("id"), pair.alias("is_up"), "len", "dep", "last")
    trees = at.groupBy("id").agg(
        F.max(F.when(~F.col("is_up"), F.col("len"))).alias("len_down"), F.max(F.when(F.col("is_up"), F.col("len"))).alias("len_up"),
        F.max(F.when(~F.col("is_up"), -F.col("dep"))).alias("depth"), F.max(F.shiftright("last", 1)).alias("root"),
    )
    trees = trees.select(
        "id", "root", "depth", F.expr("(len_up - 1 + depth) div 2").alias("entry"), F.expr("(len_down - len_up + 1) div 2 - 1").alias("n_below")
    )
    if closed is None:
        loops = nodes.sparkSession.createDataFrame([], "id long, on_cycle boolean")
    else:
        loops = closed.groupBy(F.shiftright("e", 1).alias("id")).agg((F.min("low") != F.max("low")).alias("on_cycle"))
    out = nodes.join(trees, "id", "left").join(loops, "id", "left")
    # The topmost node of a dangling chain has a parent that isn't there. Topmost nodes with such a parent are few, but not
    # bounded, so this is an ordinary join on the root.
    lost = nodes.where("parent_id is not null and up is null").select(F.col("id").alias("root"), F.lit(True).alias("lost"))
    kind = (
        F.when(F.col("on_cycle"), "cycle").when(F.col("on_cycle").isNotNull(), "below_cycle").when(F.col("lost"), "dangling")
        .when(F.col("parent_id").isNull(), "root").otherwise("node")
    )
    return out.join(lost, "root", "left").select("id", "parent_id", kind.alias("kind"), "root", "depth", "entry", (F.col("entry") + F.col("n_below")).alias("exit"), "n_below")


def roots(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", version_col: str | None = None) -> DataFrame:
    """(id, root, depth) of every node whose chain of parents ends at a node without one, by doubling along the parent links.

    That is the part of `hierarchy` that needs no tours: log2(depth) rounds of one row a node. Nodes of other chains have no row.
    Each round drops what is settled; many nodes may point at one, which a round only reads.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{parent_col}`").cast("long").alias("up"), (F.col(f"`{version_col}`") if version_col else F.lit(0)).alias("version"))
    one = rows.where("id is not null").groupBy("id").agg(F.max(F.struct("version", "up")).alias("m")).select("id", F.col("m.up").alias("at"))
    left = {"left": F.count_if(F.col("at").isNotNull())}
    now, seen = materialize_counted(one.select("id", "at", F.when(F.col("at").isNull(), F.col("id")).alias("root"), F.col("at").isNotNull().cast("long").alias("depth")), **left)
    count, reach = seen["left"], 1
    while count:
        ahead = now.select(F.col("id").alias("at"), F.col("at").alias("t_at"), F.col("root").alias("t_root"), F.col("depth").alias("t_depth"))
        done = now.where("at is null")
        # an inner join drops the chains that end at an id that isn't there
        way = now.where("at is not null").join(ahead, "at").select("id", F.col("t_at").alias("at"), F.col("t_root").alias("root"), (F.col("depth") + F.col("t_depth")).alias("depth"))
        step, seen = materialize_counted(done.unionByName(way), **left)
        discard(now)
        now, reach = step, reach * 2
        if seen["left"] == count and reach > count:  # nothing has ended, and no chain is that long: these run in circles
            break
        count = seen["left"]
    return now.where("at is null").select("id", "root", "depth")


def paths(nodes: DataFrame, chunk: int = 4096) -> DataFrame:
    """The path from the root of every node of `hierarchy`: id, path (array of ids, the root first, the node last).

    Tours are cut into chunks of `chunk` entries, so a tree of any size is spread over tasks. Each chunk gets, besides its own
    nodes, the ancestors that are open where it begins, found by their intervals; one pass with a stack gives all paths.
    Nodes of cyclic components have no path and no row.
    """
    tree = nodes.where("entry is not null").select("id", "root", "depth", "entry", "exit")
    own = tree.withColumn("part", F.expr(f"entry div {chunk}"))
    open_ = tree.where(F.expr(f"exit div {chunk} > entry div {chunk}")).withColumn("part", F.explode(F.expr(f"sequence(entry div {chunk} + 1, exit div {chunk})")))
    rows = own.withColumn("own", F.lit(True)).unionByName(open_.withColumn("own", F.lit(False)))
    rows = rows.repartition("root", "part").sortWithinPartitions("root", "part", "entry")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, stack = None, np.zeros(1024, dtype=np.int64)
        for pdf in batches:
            out_id, out_path = [], []
            columns = (pdf["root"].to_numpy(), pdf["part"].to_numpy(), pdf["id"].to_numpy(), pdf["depth"].to_numpy(), pdf["own"].to_numpy())
            for root, part, node, depth, mine in zip(*columns):
                if here != (root, part):
                    here = (root, part)
                if depth >= len(stack):
                    stack = np.concatenate([stack, np.zeros(max(len(stack), depth), dtype=np.int64)])
                stack[depth] = node
                if mine:
                    out_id.append(node)
                    out_path.append(stack[: depth + 1].copy())
                    if len(out_id) >= 2000:
                        yield pd.DataFrame({"id": out_id, "path": out_path})
                        out_id, out_path = [], []
            if out_id:
                yield pd.DataFrame({"id": out_id, "path": out_path})

    return rows.select("root", "part", "id", "depth", "own", "entry").mapInPandas(walk, "id long, path array<long>")


def descendants(nodes: DataFrame, of: DataFrame | None = None, chunk: int = 4096) -> DataFrame:
    """All nodes below each id, or each id of `of`(id): rows (id, below), from the ancestors that `paths` gives of every node."""
    every = paths(nodes, chunk).where("size(path) > 1").select(F.explode(F.expr("slice(path, 1, size(path) - 1)")).alias("id"), F.col("id").alias("below"))
    return every if of is None else every.join(of.select("id").distinct(), "id", "left_semi")
