"""The tables of a corpus, as the operators read them.

Delivered tables repeat rows; `Tables` gives each with one row per key. Nothing is read before it is used, and only the columns
that a query uses are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlens.operators.hierarchy import latest

# Working marks and beginnings of error texts that stand in place of a text.
ANALYZING, REVIEWING = "__ANALYZING__", "__REVIEWING__"
ERROR_PREFIXES = ("Figure extraction failed", "Insight failed", "MinerU API not configured")
STRICT_PREFIXES = (*ERROR_PREFIXES, "Insight analysis failed", "Figure extraction validation failed", "Review failed")


def valid_insight(text: Column, strict: bool = False) -> Column:
    """Whether a text is an insight: not empty, no working mark, no error text. Null for null."""
    ok = (text != "") & (text != ANALYZING)
    for prefix in STRICT_PREFIXES if strict else ERROR_PREFIXES:
        ok = ok & ~text.startswith(prefix)
    return ok


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def papers(self) -> DataFrame:
        """One row per id; rows delivered twice are alike."""
        return self.raw("papers").dropDuplicates(["id"])

    @property
    def insights(self) -> DataFrame:
        return self.raw("paper_insights").dropDuplicates(["paper_id"])

    @property
    def marks(self) -> DataFrame:
        return self.raw("paper_marks").dropDuplicates(["paper_id"])

    @property
    def tags(self) -> DataFrame:
        """(paper_id, tag) once, with its greatest weight; tags as they are."""
        return self.raw("paper_tags").groupBy("paper_id", "tag").agg(F.max("weight").cast("double").alias("weight"))

    @property
    def deleted(self) -> DataFrame:
        return self.raw("deleted_papers").select("id").distinct()

    def comments(self, *columns: str) -> DataFrame:
        """The latest state of every comment: id and the columns asked for. No other column is read, or travels to the choice."""
        return latest(self.raw("paper_comments").select("id", "updated_at", *columns), "id", "updated_at").drop("updated_at")

    @property
    def preferences(self) -> DataFrame:
        return self.raw("user_tag_preferences").select("tag", "preference_type").distinct()

    @property
    def authors(self) -> DataFrame:
        return self.raw("author_stats").dropDuplicates(["name"])

    def live(self, df: DataFrame, key: str = "id") -> DataFrame:
        """Without the rows of deleted papers."""
        gone = self.deleted.select(F.col("id").alias("_gone"))
        return df.join(gone, df[key] == F.col("_gone"), "left_anti")

    @property
    def live_tags(self) -> DataFrame:
        return self.live(self.tags, "paper_id")


#: The same views in SQL, for the oracle: put before a query that names them.
VIEWS = {
    "p": "p as (select distinct on (id) * from papers)",
    "pi": "pi as (select distinct on (paper_id) * from paper_insights)",
    "m": "m as (select distinct on (paper_id) * from paper_marks)",
    "t": "t as (select paper_id, tag, cast(max(weight) as double) as weight from paper_tags group by paper_id, tag)",
    "d": "d as (select distinct id from deleted_papers)",
    "c": "c as (select distinct on (id) * from paper_comments order by id, updated_at desc)",
    "pref": "pref as (select distinct tag, preference_type from user_tag_preferences)",
    "live": "live as (select * from p where id not in (select id from d))",
    "lt": "lt as (select * from t where paper_id not in (select id from d))",
}


def with_views(sql: str, *names: str) -> str:
    """`sql` behind the views it uses, in the order in which they depend on one another."""
    used = set(names)
    if "live" in used:
        used |= {"p", "d"}
    if "lt" in used:
        used |= {"t", "d"}
    head = ", ".join(VIEWS[n] for n in VIEWS if n in used)
    return f"with {head} {sql}" if not sql.lstrip().startswith(",") else f"with {head}{sql}"
