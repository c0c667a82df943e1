"""Neighbours, progress and versions of insights; roll-ups by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlens.catalog import ANALYZING, REVIEWING, Tables, valid_insight
from paperlens.session import materialize


def valid(tables: Tables) -> DataFrame:
    """(id, title, source_type) of live papers with a valid insight."""
    ok = tables.insights.where(valid_insight(F.col("insight"))).select(F.col("paper_id").alias("id"))
    return tables.live(tables.papers).join(ok, "id", "left_semi").select("id", "title", "source_type")


def neighbours(tables: Tables) -> DataFrame:
    """The ids before and after each, in order of id.

    A window over all rows would put them into one task. Ids are cut into ranges of like size, whatever their form, and ordered within
    each; the ends of the ranges, as few as there are partitions, are linked by a second window.
    """
    ids = valid(tables).select("id").repartitionByRange("id").sortWithinPartitions("id")
    ids = materialize(ids.withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy("id")
    near = ids.withColumn("prev_in", F.lag("id").over(inside)).withColumn("next_in", F.lead("id").over(inside))
    ends = ids.groupBy("part").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    along = Window.orderBy("first")
    ends = ends.select("part", F.lag("last").over(along).alias("prev_out"), F.lead("first").over(along).alias("next_out"))
    return near.join(ends, "part").select("id", F.coalesce("prev_in", "prev_out").alias("prev_id"), F.coalesce("next_in", "next_out").alias("next_id"))


def recent(tables: Tables, limit: int) -> DataFrame:
    """The insights completed last, by their own time or else the paper's; ties by id."""
    rows = tables.live(tables.papers).select("id", "title", F.col("processed_at").alias("paper_at")).join(tables.insights.where(valid_insight(F.col("insight"))).select(F.col("paper_id").alias("id"), "processed_at"), "id")
    return rows.select("id", "title", F.coalesce("processed_at", "paper_at").alias("done_at")).orderBy(F.desc("done_at"), F.desc("id")).limit(limit)


def in_progress(tables: Tables) -> DataFrame:
    rows = tables.insights.where((F.col("insight") == ANALYZING) | (F.col("review") == REVIEWING))
    return tables.live(tables.papers).select("id", "title").join(rows.select(F.col("paper_id").alias("id"), (F.col("insight") == ANALYZING).alias("analyzing"), (F.col("review") == REVIEWING).alias("reviewing")), "id")


def status_counts(tables: Tables) -> DataFrame:
    """How many insights are in each state."""
    state = F.when(F.col("insight") == "", "empty").when(F.col("insight") == ANALYZING, "analyzing").when(valid_insight(F.col("insight")), "valid").otherwise("failed")
    return tables.insights.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def latest_version(versions: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Per key the newest version; ties by the greater `tie`."""
    rank = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return versions.withColumn("_rn", F.row_number().over(rank)).where("_rn = 1").drop("_rn")


def date_rollup(tables: Tables) -> DataFrame:
    """Papers per year, month and day of publication, with totals of each level: (level, y, m, d, n)."""
    days = tables.live(tables.papers).select(F.year("published").alias("y"), F.month("published").alias("m"), F.dayofmonth("published").alias("d"))
    rolled = days.rollup("y", "m", "d").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 0, "day").when(F.col("g") == 1, "month").when(F.col("g") == 3, "year").otherwise("all")
    return rolled.select(level.alias("level"), "y", "m", "d", "n")


def date_tree(tables: Tables) -> DataFrame:
    """Per year one row with its months (descending) and their days (ascending), as nested lists."""
    days = tables.live(tables.papers).groupBy(F.date_format("published", "yyyy").alias("y"), F.date_format("published", "MM").alias("m"), F.date_format("published", "dd").alias("d")).agg(F.count("*").alias("n"))
    months = days.groupBy("y", "m").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.col("d").alias("label"), F.col("n").alias("count")))).alias("children"))
    return months.groupBy("y").agg(F.sum("n").alias("count"), F.sort_array(F.collect_list(F.struct(F.col("m").alias("label"), F.col("n").alias("count"), "children")), asc=False).alias("children")).withColumnRenamed("y", "label")


def by_date(tables: Tables, prefix: str, limit: int = 5000) -> DataFrame:
    """The best-scored papers of a year, month or day, with their tags."""
    tags = tables.tags.groupBy("paper_id").agg(F.count("*").alias("n_tags"), F.max_by("tag", F.struct("weight", F.col("tag"))).alias("top_tag")).withColumnRenamed("paper_id", "id")
    rows = tables.live(tables.papers).where(F.date_format("published", "yyyy-MM-dd").startswith(prefix)).select("id", "title", F.col("score").cast("double").alias("score"))
    return rows.orderBy(F.desc("score"), "id").limit(limit).join(tags, "id", "left")
