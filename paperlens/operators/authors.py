"""Statistics and reputation of authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlens.catalog import Tables

LISTED = 20  # authors of a paper that count


def rebuild(tables: Tables) -> DataFrame:
    """Per name over the first 20 authors of live papers: papers, mean score, critical papers. A name twice in a list counts twice."""
    marks = tables.marks.where("mark = 'critical'").select(F.col("paper_id").alias("id"), F.lit(1).alias("critical"))
    names = tables.live(tables.papers).join(marks, "id", "left").select("id", F.col("score").cast("double").alias("score"), "critical", F.explode(F.slice("authors", 1, LISTED)).alias("name"))
    names = names.withColumn("name", F.trim("name")).where(F.octet_length("name") >= 2)
    return names.groupBy("name").agg(F.count("*").alias("paper_count"), F.round(F.avg("score"), 6).alias("avg_score"), F.count("critical").alias("critical_count"))


def export_names(tables: Tables) -> DataFrame:
    """All distinct trimmed names, in order."""
    return tables.papers.select(F.explode("authors").alias("name")).select(F.trim("name").alias("name")).where("name <> ''").distinct().orderBy("name")


def estimate(stats: DataFrame) -> DataFrame:
    """Where no paper is counted, estimate paper_count and avg_score from the h-index."""
    h = F.col("h_index")
    todo = (F.col("paper_count") == 0) & h.isNotNull()
    papers = F.when(h >= 50, h * 6).when(h >= 20, h * 5).when(h >= 10, h * 4).when(h > 0, h * 3).otherwise(0)
    score = F.when(h >= 50, 7.0).when(h >= 20, 6.5).when(h >= 10, 6.0).when(h > 0, 5.5).otherwise(5.0)
    return stats.withColumn("avg_score", F.when(todo, score).otherwise(F.col("avg_score"))).withColumn("paper_count", F.when(todo, papers).otherwise(F.col("paper_count")))


def quality(papers: Column, score: Column, critical: Column, citations: Column, h: Column) -> Column:
    """Of one author: own record plus external reputation. Nulls of an unknown author give 0."""
    own = F.when(papers > 0, (score - 5.0) * 0.10 + F.least(critical.cast("double"), F.lit(5.0)) * 0.1 + F.log1p(papers.cast("double")) * 0.10).otherwise(0.0)
    outside = F.when(h >= 50, 0.5).when(h >= 20, 0.3).when(h >= 10, 0.15).when(h.isNull() & (citations >= 10000), 0.4).when(h.isNull() & (citations >= 1000), 0.2).otherwise(0.0)
    return own + outside


def boost(tables: Tables) -> DataFrame:
    """Per live paper the boost of its first three authors (weights 4, 3, 2) and, of more than three, the last (2.5) unless among them; within -1.5 and 5."""
    listed = tables.live(tables.papers).select("id", F.transform("authors", lambda a: F.trim(a)).alias("authors"))
    last = F.element_at("authors", -1)
    extra = F.when((F.size("authors") > 3) & ~F.array_contains(F.slice("authors", 1, 3), last), F.array(F.struct(F.lit(2.5).alias("w"), last.alias("name")))).otherwise(F.array().cast("array<struct<w:double,name:string>>"))
    three = F.transform(F.slice("authors", 1, 3), lambda a, i: F.struct(F.when(i == 0, 4.0).when(i == 1, 3.0).otherwise(2.0).alias("w"), a.alias("name")))
    rows = listed.where(F.size("authors") > 0).select("id", F.inline(F.concat(three, extra)))
    stats = tables.authors
    score = F.col("w") * F.coalesce(quality(F.col("paper_count"), F.col("avg_score").cast("double"), F.col("critical_count"), F.col("citation_count"), F.col("h_index")), F.lit(0.0))
    total = rows.join(stats, "name", "left").groupBy("id").agg(F.sum(score).alias("b"))
    return total.select("id", F.round(F.greatest(F.lit(-1.5), F.least(F.lit(5.0), F.col("b"))), 6).alias("boost"))


def without_external(tables: Tables, limit: int) -> DataFrame:
    """The names with most papers that have neither citations nor an h-index; ties by name."""
    return tables.authors.where("citation_count is null and h_index is null").orderBy(F.desc("paper_count"), "name").limit(limit).select("name", "paper_count")


def running(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge new observations (name, score, critical) into running statistics (name, paper_count, avg_score, critical_count)."""
    fresh = new.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("score").cast("double")).alias("s"), F.count_if("critical").alias("k"))
    both = old.select("name", "paper_count", "avg_score", "critical_count").join(fresh, "name", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    count = zero("paper_count") + zero("n")
    return both.select("name", count.alias("paper_count"), ((zero("avg_score") * zero("paper_count") + zero("s")) / count).alias("avg_score"), (zero("critical_count") + zero("k")).alias("critical_count"))
