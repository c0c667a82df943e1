"""Two states of extracted entries: alignment, differences and their classes; hashes and logs of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ("paper_id",)


def _first_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first entry of each key by `idx`."""
    return rows.groupBy(*keys).agg(F.min("idx").alias("idx"))


def align(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries(paper_id, idx, caption, page_idx, x0, y0) of two states side by side: (paper_id, old_idx, new_idx, by).

    The first entry of a caption in either state is matched by caption. Of the rest (without a caption, or repeating one) those of one page and
    corner are matched: of several the last old one with the first new one. `by` is caption, place, missing (old only) or added (new only).
    An entry with a caption that only one state has isn't matched by place. Nulls in a corner count as one place.
    """
    def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        named = _first_of(df.where("caption is not null and caption <> ''"), ["paper_id", "caption"])
        return named, df.join(named.select("paper_id", "idx"), ["paper_id", "idx"], "left_anti")

    (a, a_rest), (b, b_rest) = split(old), split(new)
    by_caption = a.withColumnRenamed("idx", "old_idx").join(b.withColumnRenamed("idx", "new_idx"), ["paper_id", "caption"]).select("paper_id", "old_idx", "new_idx", F.lit("caption").alias("by"))
    place = [F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in ("page_idx", "x0", "y0")]
    spot = ["paper_id", "page_idx", "x0", "y0"]
    a_last = a_rest.select("paper_id", "idx", *place).groupBy(*spot).agg(F.max("idx").alias("old_idx"))
    b_first = b_rest.select("paper_id", "idx", *place).groupBy(*spot).agg(F.min("idx").alias("new_idx"))
    by_place = a_last.join(b_first, spot).select("paper_id", "old_idx", "new_idx", F.lit("place").alias("by"))
    pairs = by_caption.unionByName(by_place)
    missing = old.select("paper_id", F.col("idx").alias("old_idx")).join(pairs.select("paper_id", "old_idx"), ["paper_id", "old_idx"], "left_anti").select("paper_id", "old_idx", F.lit(None).cast("int").alias("new_idx"), F.lit("missing").alias("by"))
    added = new.select("paper_id", F.col("idx").alias("new_idx")).join(pairs.select("paper_id", "new_idx"), ["paper_id", "new_idx"], "left_anti").select("paper_id", F.lit(None).cast("int").alias("old_idx"), "new_idx", F.lit("added").alias("by"))
    return pairs.select("paper_id", F.col("old_idx").cast("int").alias("old_idx"), F.col("new_idx").cast("int").alias("new_idx"), "by").unionByName(missing.withColumn("old_idx", F.col("old_idx").cast("int"))).unionByName(added.withColumn("new_idx", F.col("new_idx").cast("int")))


def verdict(old_n: Column, new_n: Column, changed: Column) -> Column:
    """identical, improved, neutral or regressed, from the numbers of entries and whether one has changed."""
    fewer, more = new_n < old_n, new_n > old_n
    return F.when(~changed & (old_n == new_n), "identical").when(fewer, "regressed").when(more, "improved").when(changed, "improved").otherwise("neutral")


def report(old: DataFrame, new: DataFrame, fields: list[str], threshold: float = 1.0) -> DataFrame:
    """Per paper (n_old, n_new, n_changed, verdict): an aligned entry has changed if a field differs, a number by `threshold` or more."""
    pairs = align(old, new).where("by in ('caption', 'place')")
    kinds = dict(old.dtypes)

    def differs(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        return F.abs(a - b) >= threshold if kinds[c] in ("int", "bigint", "float", "double") else ~a.eqNullSafe(b)

    o, n = old.withColumnRenamed("idx", "old_idx").alias("o"), new.withColumnRenamed("idx", "new_idx").alias("n")
    changed = F.lit(False)
    for c in fields:
        changed = changed | F.coalesce(differs(c), F.lit(True))
    p = pairs.alias("p")
    seen = p.join(o, (F.col("p.paper_id") == F.col("o.paper_id")) & (F.col("p.old_idx") == F.col("o.old_idx"))).join(n, (F.col("p.paper_id") == F.col("n.paper_id")) & (F.col("p.new_idx") == F.col("n.new_idx")))
    moved = seen.select(F.col("p.paper_id").alias("paper_id"), changed.alias("c")).groupBy("paper_id").agg(F.count_if("c").alias("n_changed"))
    sizes = old.select("paper_id", F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select("paper_id", F.lit(0).alias("o"), F.lit(1).alias("n"))).groupBy("paper_id").agg(F.sum("o").alias("n_old"), F.sum("n").alias("n_new"))
    out = sizes.join(moved, "paper_id", "left").withColumn("n_changed", F.coalesce("n_changed", F.lit(0)))
    return out.withColumn("verdict", verdict(F.col("n_old"), F.col("n_new"), F.col("n_changed") > 0))


def verdict_counts(reports: DataFrame) -> DataFrame:
    return reports.groupBy("verdict").agg(F.count("*").alias("n"))


def hash_list(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, hash) of a list of lines `hash figures/source/paper/name`."""
    parts = F.split(F.trim("value"), "\\s+")
    where = F.split(parts[1], "/")
    return spark.read.text(path).where(F.size(parts) >= 2).where(F.size(where) >= 3).select(where[2].alias("paper_id"), parts[0].alias("hash")).distinct()


def image_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, hash) of the image files below a folder; the paper is the folder they lie in."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower("path").rlike("\\.(jpg|jpeg|png)$"))
    return files.select(F.element_at(F.split("path", "/"), -2).alias("paper_id"), F.sha2("content", 256).alias("hash")).distinct()


def log_marks(lines: DataFrame, value: str = "value") -> DataFrame:
    """How many lines of a log are errors, warnings and failures, by marks of the line and not by words in it: one row."""
    low = F.lower(value)

    def count(word: str) -> Column:
        return F.count_if(low.contains(f"[{word}]") | low.contains(f" {word}:") | F.ltrim(low).startswith(f"{word} ")).alias(word)

    return lines.agg(count("failed"), count("error"), count("warn"))


def log_tail(lines: DataFrame, n: int = 300, value: str = "value") -> DataFrame:
    """The last n lines of a log, in order. Line numbers follow the order in which files are read."""
    numbered = lines.select(F.col(value).alias("value"), F.monotonically_increasing_id().alias("line"))
    return numbered.orderBy(F.desc("line")).limit(n).orderBy("line").select("value")


def latest_asset(files: DataFrame) -> DataFrame:
    """The version of some files(modificationTime): the latest time in seconds, as a hexadecimal number."""
    return files.agg(F.lower(F.hex(F.max(F.unix_timestamp("modificationTime")))).alias("version"))


def first_match(values: DataFrame, name: Column, variants: dict[str, str], default: str) -> DataFrame:
    """Adds `variant`: that of the first key, in order of the keys, which a name contains in any case, else the default."""
    out = F.lit(default)
    for key in sorted(variants, reverse=True):
        out = F.when(F.instr(F.lower(name), key.lower()) > 0, F.lit(variants[key])).otherwise(out)
    return values.withColumn("variant", out)


def ordered(figs: DataFrame) -> DataFrame:
    """Figures in reading order: figures, then tables, then others; by number, page and place. Adds `rank` within the paper."""
    kind = F.when(F.col("caption_number").startswith("F:"), 0).when(F.col("caption_number").startswith("T:"), 1).otherwise(2)
    number = F.regexp_extract("caption_number", "(\\d+(?:\\.\\d+)?)", 1).try_cast("double")
    order = Window.partitionBy("paper_id").orderBy(kind, F.asc_nulls_last(number), "page_idx", "pos")
    return figs.withColumn("rank", F.row_number().over(order).cast("long"))


def median_edge(lines: DataFrame) -> DataFrame:
    """The right edge in the middle of a page's lines in order, the upper one of two: (paper_id, page_idx, edge)."""
    edges = F.sort_array(F.collect_list("x1"))  # a page has few lines
    return lines.groupBy("paper_id", "page_idx").agg(edges.alias("e")).select("paper_id", "page_idx", F.get("e", F.floor(F.size("e") / 2).cast("int")).alias("edge"))


def by_confidence(candidates: DataFrame) -> DataFrame:
    """Candidates of a page, the surest first; ties by place. Adds `rank`."""
    order = Window.partitionBy("paper_id", "page_idx").orderBy(F.desc("score"), "pos")
    return candidates.withColumn("rank", F.row_number().over(order).cast("long"))


def absorbed_above(lines: DataFrame, gap: float) -> DataFrame:
    """How far a box grows upwards over the lines above it: each line that ends at most `gap` above what has been reached is taken in.

    lines(paper_id, page_idx, top, y0, y1): the lines above a box whose upper edge is `top`. Rows (paper_id, page_idx, top, reached).
    """
    above = F.sort_array(F.collect_list(F.struct(F.col("y1").alias("y1"), F.col("y0").alias("y0"))), asc=False)  # a page has few lines
    grouped = lines.where("y1 <= top").groupBy("paper_id", "page_idx", "top").agg(above.alias("above"))
    reached = F.aggregate("above", F.col("top"), lambda at, x: F.when(at - x["y1"] <= gap, F.least(at, x["y0"])).otherwise(at))
    return grouped.select("paper_id", "page_idx", "top", reached.alias("reached"))


def figure_files(figs: DataFrame, sharp: DataFrame, plain: DataFrame) -> DataFrame:
    """The file of each figure(paper_id, name): the sharp image, else the plain one; `kind` is sharp, plain or none."""
    a, b = sharp.select("paper_id", "name", F.col("path").alias("_sharp")), plain.select("paper_id", "name", F.col("path").alias("_plain"))
    out = figs.join(a, ["paper_id", "name"], "left").join(b, ["paper_id", "name"], "left")
    return out.withColumn("path", F.coalesce("_sharp", "_plain")).withColumn("kind", F.when(F.col("_sharp").isNotNull(), "sharp").when(F.col("_plain").isNotNull(), "plain").otherwise("none")).drop("_sharp", "_plain")


def paths(source: Column, id_: Column) -> Column:
    """Where the files of a paper lie: struct (pdf, text, figures)."""
    return F.struct(F.format_string("pdfs/%s/%s.pdf", source, id_).alias("pdf"), F.format_string("texts/%s/%s.txt", source, id_).alias("text"), F.format_string("figures/%s/%s", source, id_).alias("figures"))


def tag_groups(tags: DataFrame, interest: DataFrame, disinterest: DataFrame) -> DataFrame:
    """Tags that are of no interest, as `neutral` or `disinterest`: (tag, side)."""
    left = tags.select("tag").distinct().join(interest.select("tag"), "tag", "left_anti")
    marked = left.join(disinterest.select("tag").distinct().withColumn("_d", F.lit(True)), "tag", "left")
    return marked.select("tag", F.when(F.col("_d"), "disinterest").otherwise("neutral").alias("side"))


def zipped(df: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """Parallel arrays of a row as rows, by place: (key, place, one column an array); nulls where an array is shorter."""
    return df.select(key, F.posexplode(F.arrays_zip(*arrays)).alias("place", "z")).select(key, "place", "z.*")
