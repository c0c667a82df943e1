"""Queries of the text, caption, section and Markdown functions over documents, insights and comments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlens.catalog import Tables, with_views
from paperlens.functions import markdown, text

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_CAPTIONS = "doc_kind = 'caption' and text is not null"
_OUTPUTS = "doc_kind = 'model_output' and text is not null"


def query(name: str, sql: str | None = None, *views: str) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            _SQL[name] = with_views(sql, *views) if views else sql
        return f

    return register


def _docs(t: Tables, where: str = "text is not null") -> DataFrame:
    return t.raw("documents").where(where)


_UNI = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{b}]"


@query("t1_normalize", f"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'),
  '\\)([\\x{{4e00}}-\\x{{9fff}}])', ') \\1', 'g'), '^{_UNI}+', ''), '{_UNI}+$', ''), '([\\x{{4e00}}-\\x{{9fff}}])([A-Za-z0-9])', '\\1 \\2', 'g'), '([A-Za-z0-9])([\\x{{4e00}}-\\x{{9fff}}])', '\\1 \\2', 'g')) as digest from documents where text is not null""")  # fmt: skip
def t1_normalize(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("digest"))


@query("t2_quotes")
def t2_quotes(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", F.md5(text.convert_quotes(F.col("text"))).alias("digest"))


@query("t3_headings", "select doc_id, regexp_replace(text, '^\\s*# ', '> ') as text from documents where doc_kind = 'insight' and text is not null")
def t3_headings(t: Tables) -> DataFrame:
    return _docs(t, "doc_kind = 'insight' and text is not null").select("doc_id", text.normalize_heading(F.col("text")).alias("text"))


@query("t8_think", f"select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<think(?:ing)?>.*?</think(?:ing)?>', '', 'g'), '^{_UNI}+', ''), '{_UNI}+$', '')) as digest from documents where text is not null")
def t8_think(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", F.md5(text.strip_think(F.col("text"))).alias("digest"))


@query("t9_score", f"with x as (select doc_id, try_cast(nullif(regexp_extract(text, 'Score[:\\s]*(\\d{{1,2}}(?:\\.\\d+)?)', 1), '') as double) as s from documents where {_OUTPUTS}) select doc_id, case when s between 0 and 8 then s when s is not null then 8 end as score from x")
def t9_score(t: Tables) -> DataFrame:
    return _docs(t, _OUTPUTS).select("doc_id", text.parse_score(F.col("text")).alias("score"))


@query("t11_type", f"select doc_id, nullif(trim(regexp_extract(text, 'Type[:\\s]*([^\\n]+)', 1), ' '), '') as paper_type from documents where {_OUTPUTS}")
def t11_type(t: Tables) -> DataFrame:
    return _docs(t, _OUTPUTS).select("doc_id", text.parse_type(F.col("text")).alias("paper_type"))


@query("t10_summary", f"select doc_id, md5(regexp_replace(regexp_extract(text, '(?s)Summary[:\\s]*(?:Score[:\\s]*\\d{{1,2}}(?:\\.\\d+)?(?:/10(?:\\.00)?)?\\s*)?(.*)', 1), '{_UNI}+$', '')) as digest from documents where {_OUTPUTS} and contains(text, 'Summary')")
def t10_summary(t: Tables) -> DataFrame:
    return _docs(t, f"{_OUTPUTS} and contains(text, 'Summary')").select("doc_id", F.md5(text.parse_summary(F.col("text"))).alias("digest"))


@query("t12_tags", f"""with s as (select doc_id, regexp_extract(text, '(?s)Tags[:\\s]*\\n(.*)', 1) as body from documents where {_OUTPUTS}), l as (select doc_id, unnest(string_split(replace(body, chr(13), ''), chr(10))) as line, generate_subscripts(string_split(replace(body, chr(13), ''), chr(10)), 1) as i from s),
  m as (select doc_id, i, trim(regexp_extract(trim(line, ' '), '^\\s*[-*]\\s*([^:]+)[:\\s]*(\\d{{1,2}}(?:\\.\\d+)?)\\s*$', 1), ' ') as tag, try_cast(regexp_extract(trim(line, ' '), '^\\s*[-*]\\s*([^:]+)[:\\s]*(\\d{{1,2}}(?:\\.\\d+)?)\\s*$', 2) as double) as w from l where regexp_matches(trim(line, ' '), '^\\s*[-*]\\s*([^:]+)[:\\s]*(\\d{{1,2}}(?:\\.\\d+)?)\\s*$')),
  r as (select *, row_number() over (partition by doc_id order by i) as rn from m where tag <> '' and w > 0) select doc_id, tag, least(w, 10.0) as weight from r where rn <= 5""")  # fmt: skip
def t12_tags(t: Tables) -> DataFrame:
    return _docs(t, _OUTPUTS).select("doc_id", F.inline(text.parse_tags(F.col("text"))))


@query("t16_history", "select id, trim(regexp_replace(comment, '^@AGENT', ''), chr(32) || chr(9) || chr(10)) as message from c", "c")
def t16_history(t: Tables) -> DataFrame:
    return t.comments("comment").select("id", text.clean_history(F.col("comment")).alias("message"))


# a quotation from each insight: thirty characters of it that hold more than blanks, wherever else they stand
_QUOTED = ", q as (select paper_id, insight, substring(insight, 11, 30) as q from pi where length(insight) > 60), o as (select *, (length(insight) - length(replace(insight, q, ''))) // length(q) as n from q where trim(q, ' ' || chr(10) || chr(9)) <> '')"


def _quoted(t: Tables) -> DataFrame:
    return t.insights.where("char_length(insight) > 60").select("paper_id", "insight", F.substring("insight", 11, 30).alias("q")).where("trim(' \\n\\t' from q) <> ''")


@query("t17_quotes", f"{_QUOTED} select paper_id, n from o", "pi")
def t17_quotes(t: Tables) -> DataFrame:
    """How often a quotation stands in its insight."""
    return _quoted(t).select("paper_id", F.size(markdown.quote_places(F.col("insight"), F.col("q"))).cast("long").alias("n"))


@query("t18_edits", f"{_QUOTED} select paper_id, case when n = 1 then 'applied' else 'ambiguous' end as status, md5(case when n = 1 then replace(insight, q, '[edited]') else insight end) as digest from o", "pi")
def t18_edits(t: Tables) -> DataFrame:
    """Insights after an edit of a quotation, which is refused where that stands in several places."""
    edit = markdown.apply_edit(F.col("insight"), F.col("q"), F.lit("[edited]"))
    return _quoted(t).select("paper_id", F.inline(F.array(edit))).select("paper_id", "status", F.md5("text").alias("digest"))


@query("t20_fingerprint", ", k as (select paper_id, id // 1000 as chunk, md5(string_agg(id || ':' || ai_status, '|' order by id)) as mark from c group by all) select paper_id, md5(string_agg(mark, '|' order by chunk)) as mark from k group by paper_id", "c")
def t20_fingerprint(t: Tables) -> DataFrame:
    """The state of a paper's comments, by chunks of a thousand ids, so that a popular paper's comments are never in one list."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("id", "ai_status"))), lambda x: F.concat_ws(":", x["id"], x["ai_status"]))
    chunks = t.comments("paper_id", "ai_status").groupBy("paper_id", F.expr("id div 1000").alias("chunk")).agg(F.md5(F.array_join(rows, "|")).alias("mark"))
    marks = F.transform(F.sort_array(F.collect_list(F.struct("chunk", "mark"))), lambda x: x["mark"])
    return chunks.groupBy("paper_id").agg(F.md5(F.array_join(marks, "|")).alias("mark"))


@query("t22_levenshtein", "select name, levenshtein(regexp_replace(lower(name), '[^a-z ]', '', 'g'), 'susannah') as d from author_stats")
def t22_levenshtein(t: Tables) -> DataFrame:
    return t.authors.select("name", F.levenshtein(F.regexp_replace(F.lower("name"), "[^a-z ]", ""), F.lit("susannah")).cast("long").alias("d"))


_NUMBER = "[A-Z]\\.[0-9]+(?:\\.[0-9]+)?|[0-9]+(?:\\.[0-9]+)?|[ivxlcdm]+"


# captions in SQL: the exact pattern, else the first word with one wrong letter
_NUMBERED = f"""select doc_id, text, replace(text, '_', ' ') as s, regexp_extract(replace(text, '_', ' '), '(?i)\\b(?:fig(?:ure)?|table|tbl)\\.?\\s*({_NUMBER})\\b', 1) as n, lower(regexp_extract(replace(text, '_', ' '), '(?i)\\b(fig(?:ure)?|table|tbl)\\.?\\s*({_NUMBER})\\b', 1)) as w,
  lower(regexp_extract(replace(text, '_', ' '), '^\\s*([^\\s:]*)', 1)) as f, regexp_extract(replace(text, '_', ' '), '(?i)^\\s*[^\\s:]*[\\s:]*({_NUMBER})\\b', 1) as m from documents where """
_NUMBERED_AS = "case when n <> '' then case when w in ('table', 'tbl') then 'T:' else 'F:' end || upper(n) when m <> '' and (levenshtein(f, 'figure') = 1 or levenshtein(f, 'fig') = 1) then 'F:' || upper(m) when m <> '' and (levenshtein(f, 'table') = 1 or levenshtein(f, 'tbl') = 1) then 'T:' || upper(m) end"


@query("t25_captions", f"with x as ({_NUMBERED}{_CAPTIONS}) select doc_id, {_NUMBERED_AS} as number from x")
def t25_captions(t: Tables) -> DataFrame:
    return _docs(t, _CAPTIONS).select("doc_id", text.caption_number(F.col("text")).alias("number"))


def _one_of(word: str, wrong: int) -> str:
    return "(" + " or ".join(f"levenshtein({word}, '{w}') <= {wrong}" for w in ("figure", "fig", "table", "tbl")) + ")"


_HEADER = "^\\s*([^\\s:.]*)\\s*\\.*\\s*:*\\s*(?i:[0-9]+|[ivxlcdm]+)(?:[:.]|\\s+[A-Z])"


@query("t23_caption_kinds", f"""with x as ({_NUMBERED}text is not null), y as (select *, regexp_replace(f, '[.,0-9]+$', '') as g, lower(regexp_extract(text, '{_HEADER}', 1)) as h from x)
  select doc_id, regexp_matches(text, '^\\([a-zA-Z0-9]+\\)(?:\\s+|$)') or {_one_of("g", 0)} or ({_one_of("g", 1)} and regexp_matches(s, '^\\s*[^\\s:]*[\\s:]*[0-9]')) as caption, regexp_matches(text, '{_HEADER}') and {_one_of("h", 1)} as header,
  regexp_matches(text, '^\\([a-zA-Z0-9]+\\)\\s*') as panel, {_NUMBERED_AS} as number from y""")  # fmt: skip
def t23_caption_kinds(t: Tables) -> DataFrame:
    c = F.col("text")
    return _docs(t).select("doc_id", text.looks_like_caption(c).alias("caption"), text.looks_like_caption_header(c).alias("header"), text.panel_label(c).alias("panel"), text.caption_number(c).alias("number"))


_LABELS = " or ".join(f"contains(lower(text), '{x}')" for x in text.STRUCTURE_LABELS)


@query("t27_labels", f"select doc_id, regexp_matches(trim(text, ' '), '^\\d+\\.\\s+\\w+') as numbered, regexp_matches(text, '\\b(?:SYSTEM|USER|ASSISTANT)\\b') or regexp_matches(text, '(?i)\\bdemonstrations?\\b') or {_LABELS} as structure from documents where text is not null")
def t27_labels(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", text.numbered_label(F.col("text")).alias("numbered"), text.structure_label(F.col("text")).alias("structure"))


@query("t30_image_names", "select id, substr('0123456789abcdefghijklmnopqrstuvwxyz', cast(('0x' || substr(sha1(id), 1, 2)) as int) // 36 + 1, 1) || substr('0123456789abcdefghijklmnopqrstuvwxyz', cast(('0x' || substr(sha1(id), 1, 2)) as int) % 36 + 1, 1) as name from p", "p")
def t30_image_names(t: Tables) -> DataFrame:
    return t.papers.select("id", text.base36_of_byte(F.sha1("id")).alias("name"))


_TRIM = lambda x: f"regexp_replace(regexp_replace({x}, '^{_UNI}+', ''), '{_UNI}+$', '')"
_SECTIONS = f"""with d as (select doc_id, text from documents where doc_kind in ('section', 'insight') and text is not null),
  l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as k from d), tl as (select *, {_TRIM("line")} as t from l),
  g as (select *, sum(case when t = '' then 1 else 0 end) over (partition by doc_id order by k) as b from tl), q as (select doc_id, b, trim(string_agg(t, ' ' order by k), ' ') as s from g where t <> '' group by doc_id, b),
  p as (select doc_id, s, lower(s) as low, row_number() over (partition by doc_id order by b) - 1 as i, count(*) over (partition by doc_id) as n from q),
  sc as (select *, (case when regexp_matches(low, '{text.INTRO}') then 1.0 when regexp_matches(low, 'introduction|background') then 0.6 when regexp_matches(low, 'related work|overview|motivation') then 0.45 else 0.0 end)::double * (1 - i::double / n * 0.5) as a,
    (case when regexp_matches(low, '{text.CONCLUSION}') then 1.0 when regexp_matches(low, 'conclusion|discussion') then 0.6 when regexp_matches(low, 'summary|future work|limitations') then 0.45 else 0.0 end)::double * (0.5 + i::double / n * 0.5) as z, regexp_matches(low, '{text.STOP}') as stops from p),
  f as (select doc_id, max(n) as n, min_by(i, (-a, i)) filter (a > 0) as first, min_by(i, (-z, i)) filter (z > 0) as last from sc group by doc_id),
  e as (select f.*, coalesce((select min(i) from sc where sc.doc_id = f.doc_id and stops and i >= first + 1), n) as s1, coalesce((select min(i) from sc where sc.doc_id = f.doc_id and stops and i >= last + 1), n) as s2 from f),
  w as (select *, case when first is null then 0 else first end as ia, case when first is null then ceil(n * 0.15) else greatest(least(case when last > first then last else n end, s1), first + 1) end as ib,
    case when last is null then n - ceil(n * 0.12) else last end as ca, case when last is null then n else greatest(s2, last + 1) end as cb from e),
  o as (select w.doc_id, string_agg(s, chr(10) || chr(10) order by i) filter (i >= ia and i < ib) as intro, string_agg(s, chr(10) || chr(10) order by i) filter (i >= ca and i < cb) as conclusion from w join sc on w.doc_id = sc.doc_id group by w.doc_id),
  h as (select doc_id, coalesce(min(k) filter (regexp_matches(lower(t), '{text.HEAD}') or regexp_matches(lower(t), '{text.INTRO}')), least(count(*), 30)) as k0 from tl group by doc_id),
  hd as (select tl.doc_id, substring(string_agg(regexp_replace(line, '\\r+$', ''), chr(10) order by k) filter (k < k0), 1, 5000) as header from tl join h on tl.doc_id = h.doc_id group by tl.doc_id)
  select hd.doc_id, coalesce(intro, '') as intro, coalesce(conclusion, '') as conclusion, coalesce(header, '') as header from hd left join o on o.doc_id = hd.doc_id"""


@query("t31_sections", _SECTIONS)
def t31_sections(t: Tables) -> DataFrame:
    # a generator computes the struct once, where three fields of a column would each compute it
    return _docs(t, "doc_kind in ('section', 'insight') and text is not null").select("doc_id", F.inline(F.array(text.sections(F.col("text")))))


@query("m4_images", ", x as (select paper_id, unnest(regexp_extract_all(insight, '!\\[([^\\]]*)\\]\\(([^)\\s]+)\\)', 2)) as url from pi) select paper_id, url from x", "pi")
def m4_images(t: Tables) -> DataFrame:
    return t.insights.select("paper_id", F.explode(markdown.images(F.col("insight"))).alias("i")).select("paper_id", "i.url")


@query("m13_formatted", "select paper_id, regexp_matches(insight, '!\\[[^\\]]*\\]\\([^)\\s]+\\s*(=|left|right)[^)]*\\)') as formatted from pi", "pi")
def m13_formatted(t: Tables) -> DataFrame:
    return t.insights.select("paper_id", markdown.is_formatted(F.col("insight")).alias("formatted"))


@query("m6_headings", ", x as (select paper_id, regexp_replace(insight, '(?s)```.*?(?:```|$)', '', 'g') as s from pi) select paper_id, len(regexp_extract_all(s, '(?m)^#{1,6}[ \\t]+[^\\n]+$')) as n from x", "pi")
def m6_headings(t: Tables) -> DataFrame:
    return t.insights.select("paper_id", F.size(markdown.headings(F.col("insight"))).cast("long").alias("n"))


@query("m2_math", "select paper_id, len(regexp_extract_all(insight, '\\$\\$[^$]+\\$\\$')) as n from pi", "pi")
def m2_math(t: Tables) -> DataFrame:
    return t.insights.select("paper_id", F.regexp_count("insight", F.lit("\\$\\$[^$]+\\$\\$")).cast("long").alias("n"))


@query("m1_html")
def m1_html(t: Tables) -> DataFrame:
    made = t.insights.select("paper_id", markdown.render(F.col("insight")).alias("r"))
    return made.select("paper_id", "r.html", F.size("r.toc").alias("n_headings"))


@query("m10_relayout")
def m10_relayout(t: Tables) -> DataFrame:
    """Insights with their images laid out by their sizes. The tables hold no images, so a size is made from the address of each: from 200 to 1,999 wide, from 150 to 1,349 high."""
    found = t.insights.select("paper_id", "insight", markdown.images(F.col("insight")).alias("i"))
    size = lambda u: F.array((F.crc32(u.cast("binary")) % 1800 + 200).cast("double"), (F.crc32(F.reverse(u).cast("binary")) % 1200 + 150).cast("double"))
    sizes = F.to_json(F.map_from_entries(F.transform(F.array_distinct(F.transform("i", lambda x: x["url"])), lambda u: F.struct(u, size(u)))))
    return found.select("paper_id", markdown.relayout(F.col("insight"), sizes).alias("text"))


@query("d4_days", "select strftime(published, '%Y-%m-%d') as day, count(*) as n from live group by 1", "live")
def d4_days(t: Tables) -> DataFrame:
    return t.live(t.papers).groupBy(F.date_format("published", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
