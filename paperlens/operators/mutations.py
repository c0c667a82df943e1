"""Changes to tables, as functions that return the changed table; the caller writes it as a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlens.operators.components import components
from paperlens.operators.tags import top_tags
from paperlens.session import materialize


def upsert(base: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """`base` with the rows of `new` put in or in place of those with their keys; of several new rows the one latest by `version`, else any."""
    if version:
        rank = Window.partitionBy(*keys).orderBy(F.desc(version))
        new = new.withColumn("_rn", F.row_number().over(rank)).where("_rn = 1").drop("_rn")
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*base.columns))


def patch(base: DataFrame, changes: DataFrame, keys: list[str], guard: Column | None = None) -> DataFrame:
    """Columns of `changes` that aren't null in place of those of `base`, where `guard` (over the columns of `base`) holds."""
    fields = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields])
    ok = F.lit(True) if guard is None else F.coalesce(guard, F.lit(False))
    out = base.join(renamed, keys, "left").withColumn("_ok", ok)
    for c in fields:
        out = out.withColumn(c, F.when(F.col("_ok"), F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)))
    return out.select(*base.columns)


def replace_group(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the groups in `new` in place of those of `base`."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def demoted_tags(gone: DataFrame, preferences: DataFrame, top: int = 2) -> DataFrame:
    """The heaviest tags of deleted papers, without those of interest: (tag)."""
    kept = preferences.where("preference_type = 'interest'").select("tag")
    return top_tags(gone, top).select("tag").distinct().join(kept, "tag", "left_anti")


def soft_delete(deleted: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Tombstones with those of `ids`(id) added; the time of an earlier deletion is replaced."""
    return upsert(deleted, ids.select("id", at.alias("deleted_at")), ["id"])


def restore(deleted: DataFrame, ids: DataFrame) -> DataFrame:
    return deleted.join(ids.select("id"), "id", "left_anti")


def set_mark(marks: DataFrame, new: DataFrame, domain: tuple[str, ...] = ("critical", "supporting", "marginal")) -> DataFrame:
    """Marks with those of `new`(paper_id, mark) set, or cleared where the mark is null; marks outside the domain are left out."""
    cleared = marks.join(new.where("mark is null").select("paper_id"), "paper_id", "left_anti")
    return upsert(cleared, new.where(F.col("mark").isin(*domain)), ["paper_id"])


def cascade_delete(rows: DataFrame, doomed: Column, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """Rows without the doomed ones and everything below them.

    Links into doomed rows are cut off from their parents, so what is below a doomed row is its component: logarithmic rounds, whatever the depth.
    """
    base = materialize(rows.withColumn("_doomed", F.coalesce(doomed, F.lit(False))))
    links = base.where(~F.col("_doomed") & F.col(parent).isNotNull()).select(F.col(key).alias("u"), F.col(parent).alias("v"))
    parts = materialize(components(links))
    where = base.select(key, "_doomed").join(parts, F.col(key) == F.col("node"), "left").select(key, "_doomed", F.coalesce("component", key).alias("component"))
    bad = where.where("_doomed").select("component").distinct()
    gone = where.join(bad, "component", "left_semi").select(key)
    return base.join(gone, key, "left_anti").drop("_doomed")
