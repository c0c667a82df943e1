"""Queries of page layout operators, on boxes made from lineitem: an order is a paper, its lines are blocks on two pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlens.functions import geometry as g
from paperlens.functions.geometry import Box
from paperlens.operators import grouping, layout

Query = Callable[[SparkSession, str], DataFrame]
_BOXES = """select cast(l_orderkey as varchar) as paper_id, cast(l_linenumber % 2 as int) as page_idx, cast(l_linenumber as int) as pos, case when l_returnflag = 'R' then 'table' else 'image' end as block_type,
  cast(l_partkey % 500 as double) as x0, cast((l_suppkey * 7) % 600 as double) as y0, cast(l_partkey % 500 as double) + 20 + l_quantity * 4 as x1, cast((l_suppkey * 7) % 600 as double) + 20 + l_quantity * 3 as y1,
  case when l_linestatus = 'O' then 'image on page 1' else 'Figure ' || l_linenumber || '. Text' end as desc, case when l_linestatus = 'O' then null else case when l_returnflag = 'R' then 'T:' else 'F:' end || (l_partkey % 6 + 1) end as caption_number from lineitem"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem_boxes")
    return spark.sql(_BOXES.replace("from lineitem", "from lineitem_boxes").replace("as varchar", "as string").replace(" as desc", " as `desc`"))


def l_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.overlaps(boxes(spark, sf_dir), 0.1).select("paper_id", "page_idx", "a", "b", F.round("iou", 6).alias("iou"), "contains")


def l_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.extents(boxes(spark, sf_dir))


def l_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Box.of()
    return boxes(spark, sf_dir).select("paper_id", "pos", g.is_noise(b, F.col("desc")).alias("noise"), g.plausible_figure(b).alias("figure"), g.plausible_fill(b).alias("fill"))


def l_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.columns(boxes(spark, sf_dir).withColumn("page_idx", F.lit(0)))


def l_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.panels(boxes(spark, sf_dir))


def l_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.figures(boxes(spark, sf_dir)).select("paper_id", "page_idx", "figure", "x0", "y0", "x1", "y1", "parts")


def l_unique_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.propagate_unique(boxes(spark, sf_dir)).select("paper_id", "pos", "caption_number")


def l_propagated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.propagate_captions(boxes(spark, sf_dir)).select("paper_id", "page_idx", "pos", "caption_number")


def l_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds are turned round on every third block, so that captions are of the other kind."""
    turned = F.when(F.col("pos") % 3 == 0, F.when(F.col("block_type") == "table", "image").otherwise("table")).otherwise(F.col("block_type"))
    return layout.swap_captions(boxes(spark, sf_dir).withColumn("block_type", turned)).select("paper_id", "pos", "caption_number")


def l_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = F.when(F.col("pos") % 3 == 0, F.when(F.col("block_type") == "table", "image").otherwise("table")).otherwise(F.col("block_type"))
    return layout.settle_captions(boxes(spark, sf_dir).withColumn("block_type", turned)).select("paper_id", "page_idx", "pos", "caption_number")


def l_post_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passes over the pages: noise, spreading, grouping, repairs, and the edges of the text."""
    blocks = boxes(spark, sf_dir)
    return grouping.post_process(blocks, edges=layout.extents(blocks)).select("paper_id", "page_idx", "figure", "x0", "y0", "x1", "y1", "caption_number", "parts")


def l_missing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.missing_numbers(boxes(spark, sf_dir))


def l_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = boxes(spark, sf_dir)
    return layout.validate(layout.figures(blocks), blocks.select("paper_id", "caption_number"))


def l_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_clusters(boxes(spark, sf_dir), 30.0).select("paper_id", "page_idx", "cluster", "y0", "y1", "n")


def l_largest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.largest_gap(boxes(spark, sf_dir))


def l_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.distinct_boxes(boxes(spark, sf_dir).withColumn("score", Box.of().area)).select("paper_id", "page_idx", "pos")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (l_overlaps, l_extents, l_noise, l_columns, l_panels, l_figures, l_unique_captions, l_propagated, l_swapped, l_settled, l_post_processed, l_missing_numbers, l_validate, l_clusters, l_largest_gap, l_distinct)}


def oracle_sql() -> dict[str, str]:
    b = f"with b as ({_BOXES})"
    pairs = f"""{b}, p as (select a.paper_id, a.page_idx, a.pos as a, c.pos as b, greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) as both_,
      (a.x1 - a.x0) * (a.y1 - a.y0) as area_a, (c.x1 - c.x0) * (c.y1 - c.y0) as area_b, a.x0 <= c.x0 and a.x1 >= c.x1 and a.y0 <= c.y0 and a.y1 >= c.y1 as contains
      from b a join b c on a.paper_id = c.paper_id and a.page_idx = c.page_idx and a.pos < c.pos)"""
    return {
        "l_overlaps": f"{pairs} select paper_id, page_idx, a, b, round(both_ / (area_a + area_b - both_), 6) as iou, contains from p where both_ / (area_a + area_b - both_) > 0.1",
        "l_extents": f"{b} select paper_id, page_idx, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from b group by 1, 2",
        "l_noise": f"{b}, s as (select *, x1 - x0 as w, y1 - y0 as h from b) select paper_id, pos, regexp_matches(\"desc\", '^(image|chart|table) on page') and ((w < 40 and h < 40) or greatest(w, h) / greatest(least(w, h), 1) > 10 or (w > 300 and h < 55 and greatest(w, h) / greatest(least(w, h), 1) > 6) or w * h < 1200) as noise, w * h >= 800 and w / h between 1.0 / 15 and 15 as figure, w * h > 3000 and w > 100 and h > 10 as fill from s",
        "l_columns": f"""{b}, m as (select paper_id, 0 as page_idx, x0 as s, x1 as e, count(*) over (partition by paper_id) as total, max(x1) over (partition by paper_id order by x0, x1 rows between unbounded preceding and 1 preceding) as before from b),
          i as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by paper_id order by s, e rows unbounded preceding) as island from m where total >= 4), r as (select paper_id, page_idx, island, min(s) as s, max(e) as e from i group by 1, 2, 3),
          n as (select *, lead(s) over w as ns, lead(e) over w as ne, greatest(max(e) over (partition by paper_id) - min(s) over (partition by paper_id), 1) as span from r window w as (partition by paper_id order by island))
          select paper_id, page_idx, (e + ns) / 2 as boundary from n where ns - e >= 12 and e - s >= 0.2 * span and ne - ns >= 0.2 * span""",
        "l_panels": f"{b} select paper_id, page_idx, pos, caption_number, substr('{layout.LETTERS}', row_number() over (partition by paper_id, page_idx, caption_number order by round(y0 / 20), x0, pos), 1) as panel from b where caption_number is not null",
        "l_figures": f"{b} select paper_id, page_idx, coalesce(caption_number, 'pos:' || pos) as figure, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, count(*) as parts from b group by 1, 2, 3",
        "l_unique_captions": f"{b}, k as (select *, case when block_type = 'table' then 'T' else 'F' end as kind from b), u as (select paper_id, page_idx, kind, min(caption_number) as one from k where starts_with(caption_number, kind) group by 1, 2, 3 having count(distinct caption_number) = 1) select k.paper_id, pos, coalesce(caption_number, one) as caption_number from k left join u on k.paper_id = u.paper_id and k.page_idx = u.page_idx and k.kind = u.kind",
        "l_swapped": f"""{b}, k as (select *, case when pos % 3 = 0 then case block_type when 'table' then 'image' else 'table' end else block_type end as kind from b),
          w as (select *, coalesce(starts_with(caption_number, 'F') and kind = 'table', false) as ft, coalesce(starts_with(caption_number, 'T') and kind = 'image', false) as tf from k),
          p as (select *, count(*) filter (ft) over g = 1 and count(*) filter (tf) over g = 1 as one, max(case when ft then caption_number end) over g as f, max(case when tf then caption_number end) over g as t from w window g as (partition by paper_id, page_idx))
          select paper_id, pos, case when one and ft then t when one and tf then f else caption_number end as caption_number from p""",
        "l_missing_numbers": f"{b}, n as (select distinct paper_id, substr(caption_number, 1, 1) as kind, cast(substr(caption_number, 3) as int) as number from b where caption_number is not null), t as (select paper_id, kind, unnest(range(1, max(number) + 1)) as number from n group by paper_id, kind) select paper_id, kind, cast(number as int) as number from t where (paper_id, kind, number) not in (select paper_id, kind, number from n)",
        "l_clusters": f"{b}, m as (select *, case when y0 - lag(y1) over w >= 30 then 1 else 0 end as opens from b window w as (partition by paper_id, page_idx order by y0, x0, pos)), c as (select *, cast(sum(opens) over (partition by paper_id, page_idx order by y0, x0, pos rows unbounded preceding) as bigint) as cluster from m) select paper_id, page_idx, cluster, min(y0) as y0, max(y1) as y1, count(*) as n from c group by 1, 2, 3",
        "l_validate": f"""{b}, f as (select paper_id, page_idx, coalesce(caption_number, 'pos:' || pos) as figure, any_value(caption_number) as caption_number, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from b group by all),
          g as (select *, row_number() over (partition by paper_id, page_idx order by figure) as pos from f), o as (select a.paper_id, a.pos as i, c.pos as j, greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) as both_,
          (a.x1 - a.x0) * (a.y1 - a.y0) as area_a, (c.x1 - c.x0) * (c.y1 - c.y0) as area_b from g a join g c on a.paper_id = c.paper_id and a.page_idx = c.page_idx and a.pos < c.pos)
          select paper_id, 'duplicate' as error, caption_number as detail from f where caption_number is not null group by paper_id, caption_number having count(*) > 1
          union all select paper_id, 'overlap', i || '-' || j from o where both_ > 0 and both_ > 0.5 * least(area_a, area_b)""",
        "l_largest_gap": f"{b}, m as (select paper_id, page_idx, y0 - lag(y1) over (partition by paper_id, page_idx order by y0, x0, pos) as gap, y0 from b) select paper_id, page_idx, max(gap) as gap, max_by(y0, (gap, -y0)) as \"at\" from m where gap is not null group by 1, 2",
    }
