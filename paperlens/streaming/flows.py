"""Streams of papers, chunks and events."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperlens.session import work_dir

CHUNK = "id string, seq long, kind string, text string"


def accumulate(chunks: DataFrame, idle: str | None = None, most: int = 64 << 20) -> DataFrame:
    """Texts that arrive in chunks (id, seq, kind, text): chunk appends, reset begins anew, done gives out the text.

    Rows (id, status, text): `done` with the whole text, `open` with what has come so far when a micro-batch ends, or `lost` with
    what had come where nothing did for `idle` or the text exceeds `most` characters; either ends the state. A stream that runs on needs `idle`, or
    texts that are never done are kept for ever; one that is drained must not have it, as it would wait for its timers.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text = state.get[0] if state.exists else ""
        status = "open"
        if state.hasTimedOut:
            status = "lost"
        else:
            rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
            for kind, piece in zip(rows["kind"], rows["text"]):
                if kind == "reset":
                    text = ""
                elif kind == "chunk":
                    text += piece or ""
                elif kind == "done":
                    status = "done"
            if status == "open" and len(text) > most:
                status = "lost"
        if status == "open":
            state.update((text,))
            if wait:
                state.setTimeoutDuration(wait)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"id": [key[0]], "status": [status], "text": [text]})

    return chunks.groupBy("id").applyInPandasWithState(step, "id string, status string, text string", "text string", "update", GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout)


def progress(events: DataFrame, run: str, kind: str) -> DataFrame:
    """Per run how many events came, were completed and failed; for streams in update mode, and for tables."""
    return events.groupBy(run).agg(F.count("*").alias("total"), F.count_if(F.col(kind) == "purchase").alias("completed"), F.count_if(F.col(kind) == "error").alias("failed"))


def windowed(events: DataFrame, width: str, delay: str | None = None) -> DataFrame:
    """Events and their values per window and type."""
    late = events.withWatermark("ts", delay) if delay else events
    return late.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "v")


def sessions(events: DataFrame, gap: str, delay: str | None = None) -> DataFrame:
    late = events.withWatermark("ts", delay) if delay else events
    return late.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def admit(papers: DataFrame, deleted: DataFrame, key: str = "id", at: str | None = None, within: str = "7 days") -> DataFrame:
    """A stream of papers without those seen before and without deleted ones.

    With a time column `at`, a key is kept in mind for `within` and then forgotten, so the state is bounded; what comes again later
    is met by the upsert of the table it is written to. Without one all keys are kept, which only a bounded stream can afford.
    """
    if at is None:
        once = papers.dropDuplicates([key])
    else:
        once = papers.withWatermark(at, within).dropDuplicatesWithinWatermark([key])
    return once.join(deleted.select(key), key, "left_anti")


def next_run(cron: str, after: datetime, offset_hours: int = 8) -> datetime:
    """The next time (UTC) a five-field cron line names after `after` (UTC), in a zone of a fixed offset.

    Fields: minute, hour, day, month, weekday (0 or 7 is Sunday); `*`, lists, ranges and steps. A day is named by either of day and weekday
    where both are given. ValueError for a bad line, or one that names no time within eight years.
    """
    bounds = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
    fields = cron.split()
    if len(fields) == 6:  # a leading field of seconds
        fields = fields[1:]
    if len(fields) != 5:
        raise ValueError(f"not a cron line: {cron!r}")

    def values(field: str, low: int, high: int) -> set[int]:
        out: set[int] = set()
        for part in field.split(","):
            body, _, step = part.partition("/")
            first, _, last = (str(low), "", str(high)) if body == "*" else body.partition("-")
            top = int(last) if last else (high if step else int(first))
            if not low <= int(first) <= top <= high:
                raise ValueError(f"not a cron line: {cron!r}")
            out.update(range(int(first), top + 1, int(step or 1)))
        return out

    minutes, hours, days, months, weekdays = (values(f, *b) for f, b in zip(fields, bounds))
    weekdays = {d % 7 for d in weekdays}
    zone = timedelta(hours=offset_hours)
    at = (after + zone).replace(second=0, microsecond=0) + timedelta(minutes=1)
    end = at + timedelta(days=8 * 366)
    either = fields[2] != "*" and fields[4] != "*"
    while at < end:
        by_day, by_week = at.day in days, (at.weekday() + 1) % 7 in weekdays
        if at.month not in months or not (by_day or by_week if either else by_day and by_week):
            at = at.replace(hour=0, minute=0) + timedelta(days=1)
        elif at.hour not in hours:
            at = at.replace(minute=0) + timedelta(hours=1)
        elif at.minute not in minutes:
            at += timedelta(minutes=1)
        else:
            return at - zone
    raise ValueError(f"names no time: {cron!r}")


def drain(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into a table in the shared folder, and return the table.

    In update mode each micro-batch writes its rows to a folder of its number, `epoch`, in place of what an earlier attempt at it has left.
    """
    import uuid

    base = f"{work_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    out = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = out.format("parquet").option("path", f"{base}/out").start()
    else:
        query = out.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")).start()
    query.awaitTermination()
    schema = stream.schema if mode == "append" else stream.schema.add("epoch", "long")
    return spark.read.schema(schema).parquet(f"{base}/out")
