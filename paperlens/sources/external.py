"""What lies outside: pages fetched with retries, jobs that are polled, tools that turn files into text, and models of text.

Each is an object that the caller supplies and that is shipped to the tasks; here are the distribution, the retries and the parsing.
Calls run in as many tasks as `concurrency` says. Nothing sleeps longer than its limit, and every input row gives a row, failed or not.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = "key string, status int, body string, attempts int, error string"


class TextModel(Protocol):
    """A model that answers a list of (role, content) turns."""

    def answer(self, turns: list[tuple[str, str]]) -> str: ...


class Echo:
    """A stand-in for tests: it gives back the last turn of the user, so its answers are the same everywhere."""

    def answer(self, turns: list[tuple[str, str]]) -> str:
        return next((content for role, content in reversed(turns) if role == "user"), "")


def doubling(attempt: int, status: int) -> float:
    """Seconds to wait after a failed attempt (from 1): doubled each time, at most a minute."""
    return min(2.0**attempt, 60.0)


def by_status(attempt: int, status: int) -> float:
    """Five seconds an attempt where there were too many requests, else doubled each time."""
    return 5.0 * attempt if status == 429 else 2.0**attempt


def fetch(df: DataFrame, get: Callable[[str], tuple[int, str]], key: str = "key", concurrency: int = 4, attempts: int = 5, wait: Callable[[int, int], float] = doubling, pause: Callable[[float], None] = time.sleep, cache: DataFrame | None = None) -> DataFrame:
    """Pages by key: rows (key, status, body, attempts, error). What `cache`(key, body) has isn't fetched.

    Too many requests (429) and failures of the server (500 and above) are tried again; any other status of 400 and above is final.
    An exception of `get` counts as a failure of the server. Keys are fetched once, however often they come; null keys are dropped.
    """
    asked = df.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k in pdf["key"]:
                status, body, error, n = 0, None, None, 0
                for n in range(1, attempts + 1):
                    try:
                        status, body = get(k)
                        error = None if status < 400 else f"status {status}"
                    except Exception as failure:  # a lost connection is no answer
                        status, body, error = 599, None, str(failure)
                    if status < 400 or 400 <= status < 500 and status != 429:
                        break
                    if n < attempts:
                        pause(wait(n, status))
                rows.append((k, status, body if error is None else None, n, error))
            yield pd.DataFrame(rows, columns=["key", "status", "body", "attempts", "error"])

    if cache is None:
        return asked.repartition(concurrency).mapInPandas(run, PAGE)
    have = cache.select("key", "body")
    hit = asked.join(have, "key").select("key", F.lit(200).alias("status"), "body", F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))
    return hit.unionByName(asked.join(have, "key", "left_anti").repartition(concurrency).mapInPandas(run, PAGE))


def lookup_authors(df: DataFrame, get: Callable[[str], tuple[int, str]], name: str, normalise: Callable[[Column], Column], **options: object) -> DataFrame:
    """Of each name the first result that is of the same name: (name, found, h_index, citations); nulls where there is none.

    Pages are JSON: {"data": [{"name", "hIndex", "citationCount"}, ...]}.
    """
    pages = fetch(df, get, name, attempts=3, wait=by_status, **options)  # type: ignore[arg-type]
    people = F.from_json("body", "data array<struct<name:string,hIndex:long,citationCount:long>>")["data"]
    same = F.get(F.filter(people, lambda p: normalise(p["name"]) == normalise(F.col("key"))), F.lit(0))
    return pages.select(F.col("key").alias("name"), same["name"].alias("found"), same["hIndex"].alias("h_index"), same["citationCount"].alias("citations"))


class Job(Protocol):
    """A job of a remote service: made for a key, polled until it is done, then downloaded."""

    def create(self, key: str) -> str: ...
    def poll(self, job: str) -> str: ...
    def download(self, job: str) -> str: ...


def run_jobs(df: DataFrame, service: Job, key: str = "key", concurrency: int = 4, polls: int = 600, every: float = 3.0, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """Jobs by key: rows (key, state, body, polls). state is done, failed or late (not done after `polls` looks)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k in pdf["key"]:
                state, body, n = "failed", None, 0
                try:
                    job, state = service.create(k), "late"
                    for n in range(1, polls + 1):
                        seen = service.poll(job)
                        if seen in ("done", "failed"):
                            state, body = seen, service.download(job) if seen == "done" else None
                            break
                        pause(every)
                except Exception:
                    state, body = "failed", None
                rows.append((k, state, body, n))
            yield pd.DataFrame(rows, columns=["key", "state", "body", "polls"])

    return df.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct().repartition(concurrency).mapInPandas(run, "key string, state string, body string, polls int")


def tool_output(files: DataFrame, tool: Callable[[bytes], tuple[int, str]], least: int = 1, strict: bool = False) -> DataFrame:
    """What a tool makes of files(path, content): rows (path, text). Its exit code counts only if `strict`; an output of fewer than `least`
    characters, blanks apart, is none (null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for content in pdf["content"]:
                code, text = tool(content)
                texts.append(text if len((text or "").strip()) >= least and not (strict and code) else None)
            yield pd.DataFrame({"path": pdf["path"], "text": texts})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def data_urls(files: DataFrame) -> DataFrame:
    """(path, url) of PNG images, as URLs that hold their data."""
    return files.where(F.hex(F.substring("content", 1, 4)) == "89504E47").select("path", F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64("content"), "\\s", "")).alias("url"))


def merge_roles(turns: DataFrame, key: str, order: str) -> DataFrame:
    """Turns(key, order, role, content) with neighbours of one role as one turn, a blank line between their contents: (key, turn, role, content)."""
    along = Window.partitionBy(key).orderBy(order)
    changed = F.when(F.col("role").eqNullSafe(F.lag("role").over(along)), 0).otherwise(1)
    runs = turns.withColumn("_new", changed).withColumn("turn", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("content").alias("c")))), lambda x: x["c"])
    return runs.groupBy(key, "turn", "role").agg(F.array_join(parts, "\n\n").alias("content"))


def conversations(turns: DataFrame, key: str, order: str, system: str = "") -> DataFrame:
    """One row a key: its turns in order, neighbours of one role merged, behind those of the system: (key, turns: array of (role, content))."""
    merged = merge_roles(turns, key, order)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    head = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))) if system else F.array().cast("array<struct<role:string,content:string>>")
    return merged.groupBy(key).agg(F.concat(head, listed).alias("turns"))


def answers(talks: DataFrame, model: TextModel, key: str) -> DataFrame:
    """Answers of a model to conversations(key, turns): rows (key, answer, error)."""
    kind = talks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, turns in zip(pdf[key], pdf["turns"]):
                try:
                    rows.append((k, model.answer([(t["role"], t["content"]) for t in turns]), None))
                except Exception as failure:
                    rows.append((k, None, str(failure)))
            yield pd.DataFrame(rows, columns=[key, "answer", "error"])

    return talks.select(key, "turns").mapInPandas(run, f"{key} {kind}, answer string, error string")


def stream_deltas(lines: DataFrame, key: str, order: str, value: str = "value") -> DataFrame:
    """Texts that came as server-sent events, one line in a row: (key, text, failed).

    Both usual forms of a piece of text are known, a choice's delta and a text delta; `[DONE]` and other events add nothing. `failed` tells
    that an event was an error or that no text came, so that the request is to be made again.
    """
    data = F.regexp_extract(value, "^data:\\s*(.*)$", 1)
    piece = F.coalesce(F.get_json_object(data, "$.choices[0].delta.content"), F.when(F.get_json_object(data, "$.delta.type") == "text_delta", F.get_json_object(data, "$.delta.text")), F.lit(""))
    error = F.get_json_object(data, "$.error").isNotNull() | (F.get_json_object(data, "$.type") == "error")
    rows = lines.where(F.col(value).startswith("data:")).select(key, order, piece.alias("_p"), F.coalesce(error, F.lit(False)).alias("_e"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_p").alias("p")))), lambda x: x["p"])
    made = rows.groupBy(key).agg(F.array_join(parts, "").alias("text"), F.max("_e").alias("_e"))
    return made.select(key, "text", (F.col("_e") | (F.trim("text") == "")).alias("failed"))


def round_robin(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Adds `api_key`: the keys in turn, by a hash of the row, so that each gets a like share whatever the order of rows."""
    return df.withColumn("api_key", F.element_at(F.array(*[F.lit(k) for k in keys]), (F.pmod(F.xxhash64(by), F.lit(len(keys))) + 1).cast("int")))


def file_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files(path, content) that are new, changed or gone since: (path, change)."""
    both = before.select("path", F.sha2("content", 256).alias("a")).join(now.select("path", F.sha2("content", 256).alias("b")), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def to_json_lines(talks: DataFrame, key: str) -> DataFrame:
    """Conversations as requests, one JSON text a row: (key, request)."""
    return talks.select(key, F.to_json(F.struct(F.col("turns").alias("messages"))).alias("request"))


def parse_request(text: str) -> list[tuple[str, str]]:
    return [(m["role"], m["content"]) for m in json.loads(text)["messages"]]
