"""Filtered, sorted and paged listings of papers: every filter is a semi or anti join or a pushed predicate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlens.catalog import ANALYZING, REVIEWING, Tables, valid_insight

SORTS = {"published": "published", "processed_at": "processed_at", "score": "score", "checked": "checked_at"}
SEARCHED = ("id", "title", "summary", "abstract_zh", "insight", "review")


@dataclass
class ListSpec:
    search: str | None = None
    mark: str | None = None  # a mark, or none
    insight: str | None = None  # has, none
    tag: str | None = None
    checked: str | None = None  # checked | has, unchecked | none
    source_type: str | None = None
    date_prefix: str | None = None
    ids: list[str] = field(default_factory=list)
    sort: str = "published"
    descending: bool = True
    page: int = 1
    page_size: int = 10


def joined(tables: Tables) -> DataFrame:
    """Live papers left-joined to their insights."""
    insights = tables.insights.withColumnRenamed("processed_at", "insight_processed_at").withColumnRenamed("paper_id", "id")
    return tables.live(tables.papers).join(insights, "id", "left")


def authors_text(authors: Column) -> Column:
    """The text form of a list of names, which searches look into: ["A", "B"]."""
    return F.concat(F.lit('["'), F.array_join(authors, '", "'), F.lit('"]'))


def filtered(tables: Tables, spec: ListSpec) -> DataFrame:
    """The rows that `spec` selects, unordered. Wildcards in the search text keep their meaning."""
    df = joined(tables)
    if spec.mark == "none":
        df = df.join(tables.marks.select(F.col("paper_id").alias("id")), "id", "left_anti")
    elif spec.mark:
        df = df.join(tables.marks.where(F.col("mark") == spec.mark).select(F.col("paper_id").alias("id")), "id", "left_semi")
    if spec.insight == "has":
        df = df.where(valid_insight(F.col("insight")))
    elif spec.insight == "none":
        df = df.where(~F.coalesce(valid_insight(F.col("insight")), F.lit(False)))
    if spec.tag:
        df = df.join(tables.raw("paper_tags").where(F.col("tag") == spec.tag).select(F.col("paper_id").alias("id")), "id", "left_semi")
    if spec.checked in ("checked", "has"):
        df = df.where("checked_at is not null")
    elif spec.checked in ("unchecked", "none"):
        df = df.where("checked_at is null")
    if spec.source_type:
        df = df.where(F.col("source_type") == spec.source_type)
    if spec.date_prefix:
        df = df.where(F.date_format("published", "yyyy-MM-dd").startswith(spec.date_prefix))
    if spec.ids:
        df = df.where(F.col("id").isin(spec.ids))
    if spec.search:
        like = f"%{spec.search}%"
        hits = tables.raw("paper_tags").where(F.col("tag").ilike(like)).select(F.col("paper_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
        found = F.coalesce(F.col("_hit"), F.lit(False))
        for c in SEARCHED:
            found = found | F.coalesce(F.col(c).ilike(like), F.lit(False))
        found = found | F.coalesce(authors_text(F.col("authors")).ilike(like), F.lit(False))
        df = df.join(hits, "id", "left").where(found).drop("_hit")
    return df


def light(df: DataFrame) -> DataFrame:
    """Without long texts, which four flags stand for; a flag of a missing insight is false."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    return df.select(
        "id", "title", "published", "score", "paper_type", "source_type", "checked_at",
        flag(F.col("insight") == ANALYZING).alias("is_analyzing"), flag(F.col("review") == REVIEWING).alias("is_reviewing"),
        flag((F.col("insight") != "") & (F.col("insight") != ANALYZING)).alias("has_insight"),
        flag((F.col("review") != "") & (F.col("review") != REVIEWING)).alias("has_review"),
    )


def ordered(df: DataFrame, spec: ListSpec) -> DataFrame:
    """By the sort column, then id, both in one direction; nulls first when descending, last when ascending."""
    column = F.col(SORTS.get(spec.sort, "published"))
    keys = (column.desc_nulls_first(), F.col("id").desc()) if spec.descending else (column.asc_nulls_last(), F.col("id").asc())
    return df.orderBy(*keys)


def page(df: DataFrame, spec: ListSpec) -> DataFrame:
    """One page; page numbers begin at 1, a page has 1 to 200 rows."""
    size = min(200, max(1, spec.page_size))
    return ordered(df, spec).offset((max(1, spec.page) - 1) * size).limit(size)


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("id").alias("n"))
