"""Queries p1_: the replies of paper_comments as hierarchies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlens.operators.hierarchy import descendants, hierarchy, paths
from paperlens.session import table


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(table(spark, sf_dir, "paper_comments"), "id", "parent_id", "updated_at")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).where(F.col("kind").isin("cycle", "below_cycle", "dangling")).select("id", "kind")


def p1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("id", "kind", "root", "depth", "n_below")


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(_nodes(spark, sf_dir)).select("id", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(_nodes(spark, sf_dir))


_LATEST = "with recursive c as (select distinct id, parent_id from paper_comments where id is not null)"
_DOWN = """, down as (
  select id, id as root, 0 as depth, parent_id is not null as lost, cast(id as varchar) as path from c
  where parent_id is null or parent_id not in (select id from c)
  union all
  select c.id, down.root, down.depth + 1, down.lost, down.path || '/' || cast(c.id as varchar) from c join down on c.parent_id = down.id
)"""
_LOOP = """, loose as (select * from c where id not in (select id from down)), walk as (
  select id as origin, parent_id as pos from loose union select walk.origin, loose.parent_id from walk join loose on walk.pos = loose.id
), looped as (select distinct origin as id from walk where origin = pos)"""
_FOUND = """select id, 'dangling' as kind from down where lost
  union all select id, case when id in (select id from looped) then 'cycle' else 'below_cycle' end from loose"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_paths": p1_paths, "p1_descendants": p1_descendants}


def oracle_sql() -> dict[str, str]:
    below = """, up as (select id, parent_id as pos from c where id in (select id from down) and parent_id in (select id from c)
      union all select up.id, c.parent_id from up join c on up.pos = c.id where c.parent_id in (select id from c)),
      below as (select pos as id, count(*) as n from up group by pos)"""
    return {
        "p1_found": f"{_LATEST}{_DOWN}{_LOOP} {_FOUND}",
        "p1_hierarchy": f"""{_LATEST}{_DOWN}{_LOOP}{below}
          select d.id, case when lost then 'dangling' when depth = 0 then 'root' else 'node' end as kind, root, cast(depth as bigint) as depth, coalesce(n, 0) as n_below
          from down d left join below b on d.id = b.id
          union all select id, kind, null, null, null from ({_FOUND}) where kind <> 'dangling'""",
        "p1_descendants": f"""{_LATEST}{_DOWN}, up as (select id, parent_id as pos from c where id in (select id from down) and parent_id in (select id from c)
          union all select up.id, c.parent_id from up join c on up.pos = c.id where c.parent_id in (select id from c)) select pos as id, id as below from up""",
        "p1_paths": f"{_LATEST}{_DOWN} select id, path from down",
    }
