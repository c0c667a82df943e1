"""Queries p2_ to p8_ over the tables of the project, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlens.llm.answers import judge
from paperlens.llm.cooccur import cooccurrence, normalise_tag
from paperlens.llm.encode import decode_column, encode_column
from paperlens.llm.names import entities, name_pairs
from paperlens.llm.pack import pack
from paperlens.llm.spans import shared_runs, span_classes, span_pairs, span_shares
from paperlens.llm.truncation import cut_copies, settle, terminality
from paperlens.operators.hierarchy import latest
from paperlens.session import materialize, table


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "paper_tags").select("paper_id", normalise_tag(F.col("tag")).alias("tag"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurrence(_tags(spark, sf_dir), "paper_id", "tag", min_count=4, min_share=0.001)
    return pairs.where("n_ab * n >= 6 * n_a * n_b").select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurrence(_tags(spark, sf_dir), "paper_id", "tag")
    return pairs.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_ab", "n_a", "n_b", F.round("ratio", 4).alias("ratio"), (F.round("llr", 3) + 0.0).alias("llr"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_pairs(p3_entities(spark, sf_dir))


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(table(spark, sf_dir, "author_stats"), table(spark, sf_dir, "name_forms"))


# Working marks, and what begins a text of an error that is stored in place of an insight.
MARKS = ("__ANALYZING__", "__REVIEWING__")
ERRORS = r"^(?:(?:Insight|Review|Figure|Summary|Translation|PDF|LLM|MinerU)\b[^\n]{0,60}?\b(?:failed|error|timed out|not configured)\b|Error\b|Exception\b|Traceback\b)"


def _insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of insights that are texts, one row per paper; of rows that differ the last processed counts."""
    rows = table(spark, sf_dir, "paper_insights").select("paper_id", "insight", "processed_at")
    one = rows.where("paper_id is not null").groupBy("paper_id").agg(F.max_by("insight", F.struct("processed_at", "insight")).alias("text"))
    # max_by skips no row: where processed_at is null its row comes first in order, so it counts only if there is no other
    short = (F.length("text") < 200) & F.col("text").rlike(ERRORS)
    return one.where(F.col("text").isNotNull() & ~F.trim("text").isin("", *MARKS) & ~short)


def _answered(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """Of every comment the latest state, if that is answered. The texts of other states needn't travel."""
    rows = table(spark, sf_dir, "paper_comments")
    answered = F.coalesce(F.col("is_ai") & F.col("ai_status").isin("completed", "applied", "rejected"), F.lit(False))
    texts = [F.when(answered, F.col(c)).alias(c) for c in columns]
    return latest(rows.select("id", "updated_at", "paper_id", answered.alias("answered"), *texts), "id", "updated_at").where("answered")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts that may be cut: id, field, record_id, paper_id, text, comment (empty for insights)."""
    insights = _insights(spark, sf_dir).select(F.lit("insight").alias("field"), F.col("paper_id").alias("record_id"), "paper_id", "text", F.lit("").alias("comment"))
    replies = _answered(spark, sf_dir, ["ai_reply", "comment"]).where("length(trim(ai_reply)) > 0").select(
        F.lit("ai_reply").alias("field"), F.col("id").cast("string").alias("record_id"), "paper_id", F.col("ai_reply").alias("text"), F.coalesce("comment", F.lit("")).alias("comment"))
    return materialize(insights.unionByName(replies).withColumn("id", F.monotonically_increasing_id()))


def _cut(texts: DataFrame) -> DataFrame:
    """(id, by) of the cut texts; `by` tells what showed it."""
    judged = materialize(judge(texts, "id", {"text": (F.col("text"), False)}, F.col("comment"), F.lit(""), speech=False))
    other = judged.where("defect not in ('truncated', 'open')").select("id")
    copies = materialize(cut_copies(texts).join(other, "id", "left_anti"))
    # closing words score what has no near-copy that tells
    closing = settle(judged.where("defect = 'open'").join(copies, "id", "left_anti"), terminality(texts)).where("cut")
    parts = [copies.withColumn("by", F.lit("copy")), judged.where("defect = 'truncated'").join(copies, "id", "left_anti").select("id", F.lit("structure").alias("by")), closing.select("id", F.lit("closing word").alias("by"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).dropDuplicates(["id"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    return texts.select("id", "field", "record_id").join(_cut(texts), "id", "left_semi").select("field", "record_id")


def p4_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of cut texts by field and by what showed that they are."""
    texts = _texts(spark, sf_dir)
    return texts.select("id", "field").join(_cut(texts), "id").groupBy("field", "by").agg(F.count("*").alias("n"))


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per field and source_type: texts, cut texts and their share; `none` stands for papers that are gone."""
    texts = _texts(spark, sf_dir)
    sources = table(spark, sf_dir, "papers").groupBy(F.col("id").alias("paper_id")).agg(F.max("source_type").alias("source_type"))
    rows = texts.select("id", "field", "paper_id").join(_cut(texts).select("id", F.lit(1).alias("cut")), "id", "left").join(sources, "paper_id", "left")
    return rows.groupBy("field", F.coalesce("source_type", F.lit("none")).alias("source_type")).agg(F.count("*").alias("n"), F.count("cut").alias("n_cut"), F.round(F.count("cut") / F.count("*"), 6).alias("share"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = materialize(_answered(spark, sf_dir, ["comment", "ai_reply", "ai_old_text", "ai_new_text"]))
    answers = {"ai_reply": (F.col("ai_reply"), False), "ai_new_text": (F.col("ai_new_text"), True)}
    judged = materialize(judge(comments, "id", answers, F.coalesce("comment", F.lit("")), F.coalesce("ai_old_text", F.lit(""))))
    texts = comments.select(F.explode(F.array("ai_reply", "ai_new_text")).alias("text")).where("text is not null")
    open_ = settle(judged.where("defect = 'open'"), terminality(texts)).select("id", "answer", F.when(F.col("cut"), "truncated").otherwise(F.col("other")).alias("defect"))
    return judged.where("defect <> 'open'").select("id", "answer", "defect").unionByName(open_.where("defect <> ''"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(table(spark, sf_dir, "documents"), "doc_id", "text", "byte_bpe_50k")


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, decoded from its ids."""
    return decode_column(p6_ids(spark, sf_dir), "doc_id", "ids", "byte_bpe_50k")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = table(spark, sf_dir, "context_windows").select("window_id", "tokenizer", "capacity").collect()  # a fixed table of 3 rows
    documents, out = table(spark, sf_dir, "documents"), None
    for tokenizer in sorted({w["tokenizer"] for w in windows}):
        sizes = materialize(encode_column(documents, "doc_id", "text", tokenizer, counts_only=True))
        one = pack(sizes, [(w["window_id"], w["capacity"]) for w in windows if w["tokenizer"] == tokenizer])
        out = one if out is None else out.unionByName(one)
    return out


def p7_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every packing: documents packed, documents packed otherwise than once and whole, containers above their capacity,
    documents split without need, and whether the containers are at most a hundredth more than their least possible number."""
    windows = table(spark, sf_dir, "context_windows").select("window_id", F.col("capacity").cast("long").alias("capacity"))
    rows = materialize(p7_containers(spark, sf_dir))
    docs = rows.groupBy("window_id", "doc_id").agg(F.sum("tokens").alias("n"), F.count("*").alias("pieces"), F.max("piece").alias("last"), F.max(F.col("start") + F.col("tokens")).alias("end")).join(windows, "window_id")
    each = docs.groupBy("window_id").agg(
        F.count("*").alias("n_documents"), F.sum(((F.col("n") != F.col("end")) | (F.col("pieces") != F.col("last") + 1)).cast("int")).alias("n_wrong"), F.sum(((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity"))).cast("int")).alias("n_split"), F.sum("n").alias("total"))
    bins = rows.groupBy("window_id", "container_id").agg(F.sum("tokens").alias("fill")).join(windows, "window_id")
    bins = bins.groupBy("window_id").agg(F.count("*").alias("n"), F.sum((F.col("fill") > F.col("capacity")).cast("int")).alias("n_over"), F.max("capacity").alias("capacity"))
    tight = F.col("n") <= 1.01 * F.ceil(F.col("total") / F.col("capacity")) + 1
    return each.join(bins, "window_id").select("window_id", "n_documents", "n_wrong", "n_split", "n_over", tight.alias("tight"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_pairs(shared_runs(table(spark, sf_dir, "documents"), "doc_id", "text"))


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each set of documents with a passage in common: its documents and their number. A set is named by its least document and a hash."""
    members, sets = span_classes(shared_runs(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return members.join(sets, ["h", "class"]).select(F.concat_ws("-", "h", "class").alias("class_id"), F.col("doc").alias("doc_id"), F.col("n").alias("n_documents"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return span_shares(documents, shared_runs(documents, "doc_id", "text"), "doc_id", "text").select(F.col("doc").alias("doc_id"), "n_chars", "n_shared", F.round("share", 6).alias("share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_pairs, p3_found, p3_entities, p4_found, p4_shares, p4_evidence, p5_found, p6_ids, p6_texts, p7_containers, p7_valid, p8_found, p8_classes, p8_shares)}


def oracle_sql() -> dict[str, str]:
    tags = """with t as (select distinct paper_id, trim(regexp_replace(lower(tag), '[ \t]+', ' ', 'g')) as tag from paper_tags where tag is not null and paper_id is not null),
      n as (select count(distinct paper_id) as n from paper_tags), c as (select tag, count(*) as k from t group by tag),
      p as (select a.tag as tag_a, b.tag as tag_b, count(*) as n_ab from t a join t b on a.paper_id = b.paper_id and a.tag < b.tag group by a.tag, b.tag),
      x as (select tag_a, tag_b, n_ab, a.k as n_a, b.k as n_b, n from p join c a on a.tag = tag_a join c b on b.tag = tag_b, n)"""

    def part(k: str, row: str, col: str) -> str:
        return f"case when ({k}) > 0 then ({k}) * ln(cast({k} as double) * n / (cast({row} as double) * ({col}))) else 0 end"

    llr = " + ".join([part("n_ab", "n_a", "n_b"), part("n_a - n_ab", "n_a", "n - n_b"), part("n_b - n_ab", "n - n_a", "n_b"), part("n - n_a - n_b + n_ab", "n - n_a", "n - n_b")])
    # the distinct windows of every document, and the sets of documents that have one in common
    windows = """with w as (select doc_id, i, md5(substring(text, i, 200)) as s from (select doc_id, text, unnest(range(1, length(text) - 198)) as i from documents where length(text) >= 200)),
      g as (select distinct list_sort(list(distinct doc_id)) as ds from w group by s having count(distinct doc_id) > 1)"""
    return {
        # an exact round trip
        "p6_texts": "select doc_id, coalesce(text, '') as text from documents",
        # every text that isn't empty has tokens
        "p7_valid": "select window_id, (select count(*) from documents where text <> '') as n_documents, 0 as n_wrong, 0 as n_split, 0 as n_over, true as tight from context_windows",
        "p8_found": f"{windows}, x as (select ds, unnest(ds) as doc_a from g), y as (select doc_a, unnest(ds) as doc_b from x) select distinct doc_a, doc_b from y where doc_a < doc_b",
        "p8_shares": f"""{windows}, m as (select s from w group by s having count(distinct doc_id) > 1), k as (select doc_id, i from w where s in (select s from m)),
          c as (select doc_id, cast(sum(n) as bigint) as n from (select doc_id, least(200, coalesce(lead(i) over (partition by doc_id order by i) - i, 200)) as n from k) group by doc_id)
          select d.doc_id, coalesce(length(text), 0) as n_chars, coalesce(n, 0) as n_shared, round(case when length(text) > 0 then coalesce(n, 0) / length(text) else 0 end, 6) as share
          from documents d left join c on c.doc_id = d.doc_id""",
        "p2_found": f"{tags} select tag_a, tag_b from x where n_ab >= 4 and n_ab * 1000 >= n and n_ab * n >= 6 * n_a * n_b",
        "p2_pairs": f"""{tags} select tag_a, tag_b, n_ab, n_a, n_b, round(cast(n_ab as double) * n / (cast(n_a as double) * n_b), 4) as ratio,
          round((case when cast(n_ab as double) * n < cast(n_a as double) * n_b then -1 else 1 end) * 2 * ({llr}), 3) + 0.0 as llr from x""",
    }
