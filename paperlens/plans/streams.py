"""Queries of the streams over events, run over what is there, and their batch equals in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlens.streaming import flows


def _events(spark: SparkSession, sf_dir: str, stream: bool) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    if stream:
        rows = spark.readStream.schema(rows.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def z2_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flows.drain(spark, flows.progress(_events(spark, sf_dir, True), "user_id", "event_type"), "progress", "update")
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("total", "completed", "failed"), "epoch").alias("r"))
    return last.select("user_id", "r.*")


def z_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of an hour that a watermark of ten minutes has closed."""
    rows = flows.drain(spark, flows.windowed(_events(spark, sf_dir, True), "1 hour", "10 minutes"), "windows")
    return rows.select(_stamp("start").alias("start"), "event_type", "n", F.round("v", 4).alias("v"))


def z_windows_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.windowed(_events(spark, sf_dir, False), "1 hour").select(_stamp("start").alias("start"), "event_type", "n", F.round("v", 4).alias("v"))


def z_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.sessions(_events(spark, sf_dir, False), "30 minutes").select("user_id", _stamp("start").alias("start"), "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (z2_progress, z_windows, z_windows_batch, z_sessions)}


def oracle_sql() -> dict[str, str]:
    hour = "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as v from events"
    return {
        "z2_progress": "select user_id, count(*) as total, count(*) filter (event_type = 'purchase') as completed, count(*) filter (event_type = 'error') as failed from events group by user_id",
        "z_windows": f"{hour} where time_bucket(interval 1 hour, ts) + interval 1 hour <= (select max(ts) - interval 10 minute from events) group by 1, 2",
        "z_windows_batch": f"{hour} group by 1, 2",
        "z_sessions": "with x as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as o from events window w as (partition by user_id order by ts)), y as (select *, sum(o) over (partition by user_id order by ts rows unbounded preceding) as s from x) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from y group by user_id, s",
    }
