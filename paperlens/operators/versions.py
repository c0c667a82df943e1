"""Versions of texts: backups, restoring, clearing, patches with normalisers, and changes of state from event rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlens.catalog import ANALYZING, REVIEWING, valid_insight

FIELDS = ("insight", "processed_at", "review", "reviewed_at")


def back_up(backups: DataFrame, rows: DataFrame, at: Column) -> DataFrame:
    """Backups(paper_id, insight, processed_at, review, reviewed_at, backup_at) with those of the valid insights of `rows` added. It only grows."""
    return backups.unionByName(rows.where(valid_insight(F.col("insight"))).select("paper_id", *FIELDS, at.alias("backup_at")))


def newest(backups: DataFrame) -> DataFrame:
    """The newest backup of each paper; ties by text."""
    rest = [c for c in backups.columns if c != "paper_id"]
    order = F.struct("backup_at", "insight", *[c for c in rest if c not in ("backup_at", "insight")])
    return backups.groupBy("paper_id").agg(F.max_by(F.struct(*rest), order).alias("m")).select("paper_id", *[F.col(f"m.{c}").alias(c) for c in rest])


def restore(current: DataFrame, backups: DataFrame, ids: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(current, backups): the newest backup in place of what `ids`(paper_id) have now, which is backed up first."""
    asked = ids.select("paper_id").distinct()
    kept = back_up(backups, current.join(asked, "paper_id", "left_semi"), at)
    old = newest(backups).join(asked, "paper_id", "left_semi").select("paper_id", *[F.col(c).alias(f"_b_{c}") for c in FIELDS], F.lit(True).alias("_there"))
    out = current.join(old, "paper_id", "left")
    for c in FIELDS:
        out = out.withColumn(c, F.when(F.col("_there"), F.col(f"_b_{c}")).otherwise(F.col(c)))
    return out.select(*current.columns), kept


def clear(current: DataFrame, backups: DataFrame, ids: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(current, backups, outcome): texts and reviews of `ids` emptied, after a backup of the valid ones.

    outcome(paper_id, status): cleared, refused (checked ones stay as they are) or unknown.
    """
    asked = ids.select("paper_id").distinct().withColumn("_asked", F.lit(True))
    marked = current.join(asked, "paper_id", "left")
    open_ = F.coalesce(F.col("_asked") & F.col("checked_at").isNull(), F.lit(False))
    kept = back_up(backups, marked.where(open_), at)
    out = marked
    for c in ("insight", "review"):
        out = out.withColumn(c, F.when(open_, "").otherwise(F.col(c)))
    for c in ("processed_at", "reviewed_at"):
        out = out.withColumn(c, F.when(~open_, F.col(c)))
    state = asked.join(current.select("paper_id", "checked_at", F.lit(True).alias("_there")), "paper_id", "left")
    outcome = state.select("paper_id", F.when(F.col("_there").isNull(), "unknown").when(F.col("checked_at").isNotNull(), "refused").otherwise("cleared").alias("status"))
    return out.select(*current.columns), kept, outcome


def patch_with(base: DataFrame, changes: DataFrame, key: str, normalisers: dict[str, Callable[[Column], Column]], content: list[str], checked: str) -> tuple[DataFrame, DataFrame]:
    """(table, outcome): values of `changes` that aren't null, normalised per column, in place of those of `base`.

    A row that is checked keeps its content: if a change touches a column of `content` there, the whole change is refused.
    """
    fields = [c for c in changes.columns if c != key]
    new = changes.select(key, *[normalisers.get(c, lambda x: x)(F.col(c)).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_asked"))
    both = base.join(new, key, "left")
    touched = F.lit(False)
    for c in fields:
        if c in content:
            touched = touched | F.coalesce(F.col(f"_new_{c}").isNotNull() & ~F.col(f"_new_{c}").eqNullSafe(F.col(c)), F.lit(False))
    both = both.withColumn("_refused", F.coalesce(F.col("_asked") & F.col(checked).isNotNull() & touched, F.lit(False)))
    outcome = both.where("_asked").select(key, F.when(F.col("_refused"), "refused").otherwise("patched").alias("status"))
    out = both
    for c in fields:
        out = out.withColumn(c, F.when(F.col("_refused"), F.col(c)).otherwise(F.coalesce(f"_new_{c}", c)))
    return out.select(*base.columns), outcome


def transitions(base: DataFrame, events: DataFrame, key: str, state: str, allowed: list[tuple[str, str, str]]) -> DataFrame:
    """States after a series of events(key, at, event): adds to `base` the state reached and the number of events that didn't fit, `ignored`.

    allowed: (state, event, next state). The events of a key are folded in order of time, ties by event; one key has few.
    """
    table = F.create_map(*[F.lit(x) for a, e, b in allowed for x in (f"{a}\n{e}", b)])
    series = events.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "event"))), lambda x: x["event"]).alias("_events"))
    start = F.struct(F.col(state).alias("s"), F.lit(0).cast("long").alias("ignored"))

    def step(done: Column, event: Column) -> Column:
        to = F.try_element_at(table, F.concat_ws("\n", done["s"], event))
        return F.struct(F.coalesce(to, done["s"]).alias("s"), (done["ignored"] + F.when(to.isNull(), 1).otherwise(0)).alias("ignored"))

    folded = base.join(series, key, "left").withColumn("_f", F.aggregate(F.coalesce("_events", F.array().cast("array<string>")), start, step))
    return folded.withColumn(state, F.col("_f.s")).withColumn("ignored", F.col("_f.ignored")).select(*base.columns, "ignored")


def running(current: DataFrame) -> DataFrame:
    """Papers whose text or review is being made, the earliest first: (paper_id, what, since)."""
    what = F.when(F.col("insight") == ANALYZING, "analyzing").when(F.col("review") == REVIEWING, "reviewing")
    return current.select("paper_id", what.alias("what"), F.coalesce("processed_at", "reviewed_at").alias("since")).where("what is not null").orderBy(F.asc_nulls_first("since"), "paper_id")


def relaid(texts: DataFrame, key: str, text: Column, write: bool) -> tuple[DataFrame, DataFrame]:
    """(rows that change, rows to write): a new layout of texts; without `write` nothing is to be written, the changes are only shown."""
    changed = texts.select(key, F.col("insight").alias("before"), text.alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))
    return changed, changed.select(key, F.col("after").alias("insight")).where(F.lit(write))


def latest_by_time(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Versions in order, the newest first, with their place: adds `version`."""
    return rows.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at))).cast("long"))
