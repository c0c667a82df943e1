"""Readers of papers from feeds, records, pages, notes, archives and lists, and a page cache with a time to live."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlens.functions.text import trim_all
from paperlens.schemas import ATOM_ENTRY, LAYOUT, OAI_RECORD


def normalize_id(c: Column) -> Column:
    """An id without its version: the text before the first v."""
    return F.element_at(F.split(c, "v"), 1)


def _squeeze(c: Column) -> Column:
    return trim_all(F.regexp_replace(c, "\\s+", " "))


def atom(spark: SparkSession, path: str) -> DataFrame:
    """Papers of Atom feeds; the file source splits feeds at their entries."""
    entries = spark.read.format("xml").option("rowTag", "entry").schema(ATOM_ENTRY).load(path)
    number = normalize_id(F.element_at(F.split("id", "/abs/"), -1))
    return entries.select(
        number.alias("id"), _squeeze(F.col("title")).alias("title"), F.transform("author", lambda a: a["name"]).alias("authors"), _squeeze(F.col("summary")).alias("summary"),
        F.concat(F.lit("https://arxiv.org/pdf/"), number).alias("pdf_url"), F.try_to_timestamp("published").alias("published"),
        F.lit("arxiv").alias("source_type"), F.concat(F.lit("https://arxiv.org/abs/"), number).alias("source_url"), number.alias("external_id"),
    )


def oai_records(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Papers of OAI records, one record in a row; without title and authors there is none."""
    r = F.from_xml(F.col(xml), OAI_RECORD)
    people = F.transform("r.authors.author", lambda a: F.concat_ws(" ", a["forenames"], a["keyname"]))
    rows = df.select(r.alias("r")).select(F.col("r.id").alias("id"), _squeeze(F.col("r.title")).alias("title"), F.coalesce(people, F.array().cast("array<string>")).alias("authors"), _squeeze(F.col("r.abstract")).alias("summary"), F.to_timestamp(F.col("r.created"), "yyyy-MM-dd").alias("published"))
    return rows.where("coalesce(title, '') <> '' or size(authors) > 0")


def between(c: Column, start: str, end: str) -> Column:
    """The text between two markers, the first of each; null without both."""
    at = F.instr(c, start)
    rest = F.substr(c, at + len(start))
    stop = F.instr(rest, end)
    return F.when((at > 0) & (stop > 0), F.substr(rest, F.lit(1), stop - 1))


def dateline(c: Column) -> Column:
    """The day of `Submitted on 21 Jan 2025` or `[v1] Tue, 21 Jan 2025 ...`."""
    day = F.regexp_extract(c, "(\\d{1,2} [A-Z][a-z]{2} \\d{4})", 1)
    return F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit("d MMM yyyy"))


def html_pages(df: DataFrame, html: str = "html") -> DataFrame:
    """(title, authors, summary, published) of abstract pages."""
    c = F.col(html)
    plain = lambda x: _squeeze(F.regexp_replace(x, "<[^>]+>", " "))
    title = F.regexp_replace(plain(between(c, '<h1 class="title', "</h1>")), "^[^>]*>\\s*(?:Title:\\s*)?", "")
    people = F.transform(F.regexp_extract_all(between(c, '<div class="authors">', "</div>"), F.lit("<a[^>]*>([^<]+)</a>"), 1), lambda a: F.trim(a))
    summary = F.regexp_replace(plain(between(c, '<blockquote class="abstract', "</blockquote>")), "^[^>]*>\\s*(?:Abstract:\\s*)?", "")
    return df.select("*", title.alias("title"), people.alias("authors"), summary.alias("summary"), dateline(between(c, '<div class="dateline">', "</div>")).alias("published"))


def variant_string(c: Column, path: str) -> Column:
    """A field that is a scalar or an object with a value."""
    return F.coalesce(F.get_json_object(c, f"$.{path}.value"), F.get_json_object(c, f"$.{path}"))


def notes(df: DataFrame, note: str = "note", year: int = 1970) -> DataFrame:
    """Papers of conference notes, one JSON note in a row; notes with an empty title are left out."""
    c = F.col(note)
    key = F.coalesce(F.get_json_object(c, "$.forum"), F.get_json_object(c, "$.id"))
    pdf = variant_string(c, "content.pdf")
    at = F.coalesce(F.get_json_object(c, "$.pdate"), F.get_json_object(c, "$.cdate"), F.get_json_object(c, "$.tcdate")).try_cast("long")
    rows = df.select(
        key.alias("id"), variant_string(c, "content.title").alias("title"), F.coalesce(F.from_json(variant_string(c, "content.authors"), "array<string>"), F.array().cast("array<string>")).alias("authors"),
        F.coalesce(variant_string(c, "content.abstract"), F.lit("")).alias("summary"), F.when(pdf.startswith("/"), F.concat(F.lit("https://openreview.net"), pdf)).otherwise(pdf).alias("pdf_url"),
        F.coalesce(F.timestamp_millis(at), F.to_timestamp(F.lit(f"{year}-01-01"))).alias("published"), F.lit("openreview").alias("source_type"), F.concat(F.lit("https://openreview.net/forum?id="), key).alias("source_url"), key.alias("external_id"),
    )
    return rows.where("coalesce(trim(title), '') <> ''")


def paper_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Papers of a file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty trimmed lines: (value)."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified, valid) of PDF files; only the first bytes tell whether one is valid."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime", (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("valid"))


def png_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height) of PNG images, from their headers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A")
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("long")
    return files.select("path", number(17).alias("width"), number(21).alias("height"))


def archives(spark: SparkSession, path: str, most: int = 256 << 20) -> DataFrame:
    """Members of zip archives that lie within them: (archive, name, size, text); text only of .json and .md members.

    Names that lead out of the archive are left out. A member that says it is larger than `most` bytes, or turns out to be, has a null text, so
    what an archive unpacks to is bounded. Members are given out one by one, not an archive at a time; a broken archive gives one row without a name.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select("path", "content")

    def text(z: zipfile.ZipFile, info: zipfile.ZipInfo) -> str | None:
        if not info.filename.endswith((".json", ".md")) or info.file_size > most:
            return None
        with z.open(info) as f:
            body = f.read(most + 1)
        return body.decode("utf-8", "replace") if len(body) <= most else None

    def members(archive: str, content: bytes) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for info in z.infolist():
                    name = info.filename
                    if not (info.is_dir() or name.startswith(("/", "\\")) or ".." in name.replace("\\", "/").split("/")):
                        yield archive, name, info.file_size, text(z, info)
        except zipfile.BadZipFile:
            yield archive, None, None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, held = [], 0
            for archive, content in zip(pdf["path"], pdf["content"]):
                for row in members(archive, content):
                    rows.append(row)
                    held += len(row[3] or "")
                    if held > 16 << 20 or len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=["archive", "name", "size", "text"])
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["archive", "name", "size", "text"])

    return files.mapInPandas(run, "archive string, name string, size long, text string")


def layouts(members: DataFrame) -> DataFrame:
    """(archive, page) of the layout files of archives."""
    doc = F.from_json("text", LAYOUT)
    return members.where(F.col("name").endswith("layout.json")).select("archive", F.explode(doc["pdf_info"]).alias("page"))


# the page cache
def cache_key(url: Column) -> Column:
    return F.sha2(url, 256)


def fresh(cache: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """Cached pages (url, body, written_at) that haven't expired; hours are kept within 1 and 8760. Expired ones stay in the cache."""
    hours = min(8760, max(1, hours))
    return cache.where(F.col("written_at") > now - F.expr(f"interval {hours} hours"))


def missing(ids: DataFrame, found: DataFrame) -> DataFrame:
    """Ids that a first source didn't give, for a second one to look up."""
    return ids.join(found.select("id"), "id", "left_anti")


def configured(archives: DataFrame, split: list[str]) -> DataFrame:
    """Cached archives(split_figures, ...) that were made with the same figures kept apart, in any order."""
    return archives.where(F.sort_array(F.coalesce("split_figures", F.array().cast("array<string>"))) == F.array_sort(F.array(*[F.lit(x) for x in split]) if split else F.array().cast("array<string>")))


def listed(names: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Names(name) in order from `offset` on, `limit` of them: a page of a folder's listing."""
    out = names.orderBy("name").offset(offset)
    return out if limit is None else out.limit(limit)


# a paged source
def pages(spark: SparkSession, path: str, page_size: int = 100, max_results: int | None = None) -> DataFrame:
    """Papers (id, title, published, page, place) of files page-00000.json, page-00001.json ... of a folder, each an array of papers.

    The scan ends with the first page that is shorter than `page_size` or isn't there; what lies beyond is left out, and so is what exceeds
    `max_results`. The files are read by Spark, from wherever it reads.
    """
    raw = spark.read.text(f"{path}/page-*.json", wholetext=True).select(F.regexp_extract(F.input_file_name(), "page-(\\d+)\\.json$", 1).cast("long").alias("page"), F.from_json("value", "array<struct<id:string,title:string,published:string>>").alias("papers"))
    size = F.coalesce(F.size("papers"), F.lit(0))
    # one row a page: the first that isn't full, or the first gap, ends the scan
    sizes = raw.select("page", size.alias("n"))
    short = sizes.where(F.col("n") < page_size).select("page")
    gap = sizes.select((F.col("page") + 1).alias("page")).join(sizes.select("page"), "page", "left_anti")
    end = short.unionByName(gap).agg(F.min("page").alias("end"))
    rows = raw.join(end, F.col("page") <= F.col("end")).select("page", F.posexplode("papers").alias("place", "p"))
    rows = rows.where(F.col("place") < page_size)
    if max_results is not None:
        rows = rows.where(F.col("page") * page_size + F.col("place") < max_results)
    return rows.select("p.id", "p.title", "p.published", "page", "place")
