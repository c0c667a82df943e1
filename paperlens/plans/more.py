"""Queries of snapshots, versions, conversations, vector drawings and term spellings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlens.catalog import Tables, with_views
from paperlens.functions import svg, terms, text
from paperlens.operators import mutations, snapshots, versions
from paperlens.plans.pages import _BOXES, boxes
from paperlens.sources import external

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_VALID = "insight <> '' and insight <> '__ANALYZING__' and not starts_with(insight, 'Figure extraction failed') and not starts_with(insight, 'Insight failed') and not starts_with(insight, 'MinerU API not configured')"


def query(name: str, sql: str | None = None, *views: str) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            _SQL[name] = with_views(sql, *views) if views else sql
        return f

    return register


def _boxes(t: Tables) -> DataFrame:
    return boxes(t.spark, t.dir)


# two states of a layout: in the second, every seventh box has lost its caption, every fifth is gone, and every third has moved
_OLD = f"with b as ({_BOXES}), o as (select paper_id, pos as idx, caption_number as caption, page_idx, x0, y0 from b), n as (select paper_id, pos as idx, case when x0::int % 7 = 0 then null else caption_number end as caption, page_idx, x0 + case when x0::int % 3 = 0 then 2 else 0 end as x0, y0 from b where y0::int % 5 <> 0)"
_ALIGNED = f"""{_OLD}, oc as (select paper_id, caption, min(idx) as old_idx from o where caption is not null group by all), nc as (select paper_id, caption, min(idx) as new_idx from n where caption is not null group by all),
  p1 as (select paper_id, old_idx, new_idx, 'caption' as by from oc join nc using (paper_id, caption)), orest as (select o.* from o left join oc on o.paper_id = oc.paper_id and o.idx = oc.old_idx where oc.old_idx is null), nrest as (select n.* from n left join nc on n.paper_id = nc.paper_id and n.idx = nc.new_idx where nc.new_idx is null),
  p2 as (select a.paper_id, old_idx, new_idx, 'place' as by from (select paper_id, page_idx, x0, y0, max(idx) as old_idx from orest group by all) a join (select paper_id, page_idx, x0, y0, min(idx) as new_idx from nrest group by all) b using (paper_id, page_idx, x0, y0)), p as (select * from p1 union all select * from p2)"""


def _states(t: Tables) -> tuple[DataFrame, DataFrame]:
    b = _boxes(t)
    old = b.select("paper_id", F.col("pos").alias("idx"), F.col("caption_number").alias("caption"), "page_idx", "x0", "y0")
    new = old.where(F.col("y0").cast("int") % 5 != 0).select("paper_id", "idx", F.when(F.col("x0").cast("int") % 7 != 0, F.col("caption")).alias("caption"), "page_idx", (F.col("x0") + F.when(F.col("x0").cast("int") % 3 == 0, 2).otherwise(0)).alias("x0"), "y0")
    return old, new


@query("j21_aligned", f"{_ALIGNED} select * from p union all select paper_id, idx, null, 'missing' from o where (paper_id, idx) not in (select (paper_id, old_idx) from p) union all select paper_id, null, idx, 'added' from n where (paper_id, idx) not in (select (paper_id, new_idx) from p)")
def j21_aligned(t: Tables) -> DataFrame:
    return snapshots.align(*_states(t))


@query("a23_verdicts", f"""{_ALIGNED}, ch as (select p.paper_id, count(*) filter (abs(o.x0 - n.x0) >= 1 or o.caption is distinct from n.caption) as k from p join o on p.paper_id = o.paper_id and p.old_idx = o.idx join n on p.paper_id = n.paper_id and p.new_idx = n.idx group by p.paper_id),
  s as (select paper_id, sum(a) as n_old, sum(c) as n_new from (select paper_id, 1 as a, 0 as c from o union all select paper_id, 0, 1 from n) group by paper_id), r as (select s.*, coalesce(k, 0) as k from s left join ch using (paper_id))
  select case when k = 0 and n_old = n_new then 'identical' when n_new < n_old then 'regressed' when n_new > n_old or k > 0 then 'improved' else 'neutral' end as verdict, count(*) as n from r group by 1""")
def a23_verdicts(t: Tables) -> DataFrame:
    return snapshots.verdict_counts(snapshots.report(*_states(t), ["x0", "caption"]))


@query("r10_ordered", f"with b as ({_BOXES}) select paper_id, pos, row_number() over (partition by paper_id order by case when caption_number like 'F:%' then 0 when caption_number like 'T:%' then 1 else 2 end, try_cast(substr(caption_number, 3) as double) nulls last, page_idx, pos) as rank from b")
def r10_ordered(t: Tables) -> DataFrame:
    return snapshots.ordered(_boxes(t)).select("paper_id", "pos", "rank")


@query("r11_confidence", f"with b as ({_BOXES}) select paper_id, pos, row_number() over (partition by paper_id, page_idx order by (x1 - x0) * (y1 - y0) desc, pos) as rank from b")
def r11_confidence(t: Tables) -> DataFrame:
    return snapshots.by_confidence(_boxes(t).withColumn("score", F.expr("(x1 - x0) * (y1 - y0)"))).select("paper_id", "pos", "rank")


@query("a19_median_edge", f"with b as ({_BOXES}), r as (select paper_id, page_idx, x1, row_number() over (partition by paper_id, page_idx order by x1) - 1 as i, count(*) over (partition by paper_id, page_idx) as n from b) select paper_id, page_idx, x1 as edge from r where i = n // 2")
def a19_median_edge(t: Tables) -> DataFrame:
    return snapshots.median_edge(_boxes(t))


@query("w9_absorbed", f"""with recursive b as ({_BOXES}), l as (select paper_id, page_idx, y0, y1, row_number() over (partition by paper_id, page_idx order by y1 desc, y0 desc) as i from b where y1 <= 500),
  w as (select paper_id, page_idx, i, case when 500.0 - y1 <= 60 then least(500.0, y0) else 500.0 end as reached from l where i = 1 union all select l.paper_id, l.page_idx, l.i, case when reached - y1 <= 60 then least(reached, y0) else reached end from w join l on l.paper_id = w.paper_id and l.page_idx = w.page_idx and l.i = w.i + 1)
  select paper_id, page_idx, cast(500.0 as double) as top, cast(max_by(reached, i) as double) as reached from w group by paper_id, page_idx""")
def w9_absorbed(t: Tables) -> DataFrame:
    return snapshots.absorbed_above(_boxes(t).withColumn("top", F.lit(500.0)), 60.0)


_KINDS = {"Net": "network", "lite": "small", "Bench": "benchmark"}


@query("f18_variants", "select id, case when contains(lower(title), 'bench') then 'benchmark' when contains(lower(title), 'net') then 'network' when contains(lower(title), 'lite') then 'small' else 'other' end as variant from p", "p")
def f18_variants(t: Tables) -> DataFrame:
    return snapshots.first_match(t.papers, F.col("title"), _KINDS, "other").select("id", "variant")


@query("f22_sides", ", i as (select tag from pref where preference_type = 'interest'), x as (select distinct tag from pref where preference_type = 'disinterest') select distinct tag, case when tag in (select tag from x) then 'disinterest' else 'neutral' end as side from t where tag not in (select tag from i)", "t", "pref")
def f22_sides(t: Tables) -> DataFrame:
    p = t.preferences
    return snapshots.tag_groups(t.tags, p.where("preference_type = 'interest'"), p.where("preference_type = 'disinterest'"))


@query("f29_paths", "select id, 'pdfs/' || source_type || '/' || id || '.pdf' as pdf, 'figures/' || source_type || '/' || id as figures from p", "p")
def f29_paths(t: Tables) -> DataFrame:
    return t.papers.select("id", snapshots.paths(F.col("source_type"), F.col("id")).alias("x")).select("id", "x.pdf", "x.figures")


@query("j23_zipped", "select id, i - 1 as place, authors[i] as a, len(authors[i]) as b from (select id, authors, unnest(range(1, len(authors) + 1)) as i from p)", "p")
def j23_zipped(t: Tables) -> DataFrame:
    rows = t.papers.select("id", F.col("authors").alias("a"), F.transform("authors", F.length).alias("b"))
    return snapshots.zipped(rows, "id", ["a", "b"]).select("id", F.col("place").cast("long").alias("place"), "a", F.col("b").cast("long").alias("b"))


@query("r3_ids", "select id from live where published is not null", "live")
def r3_ids(t: Tables) -> DataFrame:
    return t.live(t.papers).where("published is not null").orderBy(F.desc("published"), F.desc("id")).select("id")


@query("f10_listed", "select id, title from live where id in (select paper_id from m)", "live", "m")
def f10_listed(t: Tables) -> DataFrame:
    return t.live(t.papers).join(t.marks.select(F.col("paper_id").alias("id")), "id", "left_semi").select("id", "title")


@query("f13_points", "select paper_id, mark from m where paper_id = (select min(paper_id) from m)", "m")
def f13_points(t: Tables) -> DataFrame:
    m = t.marks
    return m.join(m.agg(F.min("paper_id").alias("paper_id")), "paper_id").select("paper_id", "mark")


# versions
def _at() -> Column:
    return F.to_timestamp(F.lit("2026-01-01 00:00:00"))


def _backups(t: Tables) -> DataFrame:
    """Each valid insight was backed up twice, a day apart, the second time with a mark of its own."""
    one = versions.back_up(t.spark.createDataFrame([], "paper_id string, insight string, processed_at timestamp_ntz, review string, reviewed_at timestamp_ntz, backup_at timestamp"), t.insights, _at())
    return one.unionByName(one.withColumn("insight", F.concat("insight", F.lit(" (2)"))).withColumn("backup_at", F.col("backup_at") + F.expr("interval 1 day")))


@query("u9_restored", f", gone as (select paper_id from m where mark = 'critical'), ok as (select * from pi where {_VALID}) select paper_id, case when paper_id in (select paper_id from gone) and paper_id in (select paper_id from ok) then insight || ' (2)' else insight end as insight from pi", "pi", "m")
def u9_restored(t: Tables) -> DataFrame:
    ids = t.marks.where("mark = 'critical'").select("paper_id")
    return versions.restore(t.insights, _backups(t), ids, _at())[0].select("paper_id", "insight")


@query("u9_backups", f", ok as (select * from pi where {_VALID}) select paper_id, 2 + case when paper_id in (select paper_id from m where mark = 'critical') then 1 else 0 end as n from ok", "pi", "m")
def u9_backups(t: Tables) -> DataFrame:
    ids = t.marks.where("mark = 'critical'").select("paper_id")
    return versions.restore(t.insights, _backups(t), ids, _at())[1].groupBy("paper_id").agg(F.count("*").cast("int").alias("n"))


@query("u15_cleared", ", x as (select paper_id, mark from m) select x.paper_id, case when pi.paper_id is null then 'unknown' when checked_at is not null then 'refused' else 'cleared' end as status, case when checked_at is null and pi.paper_id is not null then '' else insight end as insight from x left join pi on pi.paper_id = x.paper_id", "pi", "m")
def u15_cleared(t: Tables) -> DataFrame:
    current, _, outcome = versions.clear(t.insights, _backups(t), t.marks, _at())
    return outcome.join(current.select("paper_id", "insight"), "paper_id", "left").select("paper_id", "status", "insight")


@query("u19_patched", ", c2 as (select p.id, p.title, checked_at, trim(p.title) || '\n\n\n\nB' as new from p left join pi on p.id = pi.paper_id) select id, case when checked_at is null then trim(title) || '\n\nB' else title end as title from c2", "p", "pi")
def u19_patched(t: Tables) -> DataFrame:
    base = t.papers.select("id", F.col("title")).join(t.insights.select(F.col("paper_id").alias("id"), "checked_at"), "id", "left")
    changes = t.papers.select("id", F.concat(F.trim("title"), F.lit("\n\n\n\nB")).alias("title"))
    normal = {"title": lambda c: F.regexp_replace(c, "\\n{3,}", "\n\n")}
    return versions.patch_with(base, changes, "id", normal, ["title"], "checked_at")[0].select("id", "title")


@query("u11_states", ", e as (select id, case when ai_status = '' then '' else ai_status end as s, id % 3 as k from c where is_ai) select id, case when k = 0 and s = 'pending' then 'applied' when k = 1 and s = 'completed' then 'rejected' when k = 0 and s = 'completed' then 'applied' when k = 1 and s = 'pending' then 'completed' when k = 2 and s = 'pending' then 'failed' else s end as ai_status from e", "c")
def u11_states(t: Tables) -> DataFrame:
    """Comments with an answer by a model after two events each: it is completed and applied, completed and (only then) rejected, or failed."""
    base = t.comments("ai_status", "is_ai").where("is_ai").select("id", "ai_status")
    k = F.col("id") % 3
    first = F.when(k == 2, "fail").when(k == 1, F.when(F.col("ai_status") == "completed", "reject").otherwise("complete")).otherwise("complete")
    second = F.when(k == 0, "apply").otherwise("complete")
    events = base.select("id", F.inline(F.array(F.struct(F.lit(1).alias("at"), first.alias("event")), F.struct(F.lit(2).alias("at"), second.alias("event")))))
    allowed = [("pending", "complete", "completed"), ("pending", "fail", "failed"), ("completed", "apply", "applied"), ("completed", "reject", "rejected")]
    return versions.transitions(base, events, "id", "ai_status", allowed).select("id", "ai_status")


@query("r5_running", ", x as (select paper_id, case when insight = '__ANALYZING__' then 'analyzing' when review = '__REVIEWING__' then 'reviewing' end as what from pi) select * from x where what is not null", "pi")
def r5_running(t: Tables) -> DataFrame:
    return versions.running(t.insights).select("paper_id", "what")


_B36 = "substr('0123456789abcdefghijklmnopqrstuvwxyz', {} + 1, 1)"
_BYTE = "cast(('0x' || substr(sha1(id), 1, 2)) as int)"


@query("t29_spelled", f"select id, case when s >= 3600 then (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' when s >= 60 then (s // 60) || 'm ' || (s % 60) || 's' else s || 's' end as took, substr(id, 1, 4) || '...' || right(id, 4) as mask, 'ab' || lpad(cast(s % 90 as varchar), 2, '0') || {_B36.format(_BYTE + ' // 36')} || {_B36.format(_BYTE + ' % 36')} as image from (select id, length(title) * 97 as s from p)", "p")
def t29_spelled(t: Tables) -> DataFrame:
    """Seconds as hours, minutes and seconds, masked keys and names of images, made from ids and titles."""
    rows = t.papers.select("id", (F.char_length("title") * 97).cast("long").alias("s"))
    return rows.select("id", text.spell_seconds(F.col("s")).alias("took"), text.masked(F.col("id")).alias("mask"), text.image_name(F.lit("ab"), F.col("s") % 90, F.col("id")).alias("image"))


@query("j14_listed", ", g as (select paper_id, string_agg(tag, '; ' order by weight desc, tag) as tags from lt group by paper_id) select live.id, title, mark, tags from live left join m on live.id = m.paper_id left join g on live.id = g.paper_id", "live", "m", "lt")
def j14_listed(t: Tables) -> DataFrame:
    """Live papers with their mark and their tags, the heaviest first."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "tag"))), lambda x: x["tag"])
    of = t.live_tags.groupBy(F.col("paper_id").alias("id")).agg(F.array_join(listed, "; ").alias("tags"))
    return t.live(t.papers).select("id", "title").join(t.marks.select(F.col("paper_id").alias("id"), "mark"), "id", "left").join(of, "id", "left")


@query("u6_marks", "select paper_id, 'marginal' as mark from m where mark = 'critical' union all select paper_id, mark from m where mark = 'marginal' union all select id, 'supporting' from (select min(id) as id from p where id not in (select paper_id from m))", "m", "p")
def u6_marks(t: Tables) -> DataFrame:
    """Critical marks made marginal, supporting ones cleared, one set anew, and one that isn't known left out."""
    m = t.marks
    fresh = t.papers.select(F.col("id").alias("paper_id")).join(m.select("paper_id"), "paper_id", "left_anti").agg(F.min("paper_id").alias("paper_id"))
    change = m.where("mark <> 'marginal'").select("paper_id", F.when(F.col("mark") == "critical", "marginal").alias("mark"))
    odd = m.where("mark = 'marginal'").select("paper_id", F.lit("odd").alias("mark"))
    return mutations.set_mark(m, change.unionByName(fresh.withColumn("mark", F.lit("supporting"))).unionByName(odd)).select("paper_id", "mark")


@query("u12_deleted_by_tag", ", x as (select tag from t group by tag order by count(*) desc, tag limit 1) select id from live where id not in (select paper_id from t where tag in (select tag from x))", "live", "t")
def u12_deleted_by_tag(t: Tables) -> DataFrame:
    """Papers that are left when all of the commonest tag are deleted."""
    top = t.tags.groupBy("tag").count().orderBy(F.desc("count"), "tag").limit(1).select("tag")
    gone = t.tags.join(top, "tag", "left_semi").select(F.col("paper_id").alias("id")).distinct()
    deleted = mutations.soft_delete(t.raw("deleted_papers").select("id", F.col("deleted_at").cast("timestamp").alias("deleted_at")), gone, _at())
    return t.papers.join(deleted.select("id"), "id", "left_anti").select("id")


@query("u16_boxes", f"with b as ({_BOXES}) select paper_id, pos, case when pos = 1 then x0 - 5 else x0 end as x0, case when pos = 1 then x1 + 5 else x1 end as x1 from b where pos <> 2 union all select paper_id, 99, min(x0), max(x1) from b where pos in (3, 4) group by paper_id")
def u16_boxes(t: Tables) -> DataFrame:
    """Boxes after changes by hand: the first is widened, the second deleted, and one is added around the third and fourth."""
    b = _boxes(t).select("paper_id", "pos", "x0", "x1")
    wider = b.where("pos = 1").select("paper_id", "pos", (F.col("x0") - 5).alias("x0"), (F.col("x1") + 5).alias("x1"))
    added = b.where("pos in (3, 4)").groupBy("paper_id").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).select("paper_id", F.lit(99).alias("pos"), "x0", "x1")
    return mutations.upsert(b.where("pos <> 2"), wider.unionByName(added), ["paper_id", "pos"])


# conversations
@query("x_merged_roles", ", s as (select paper_id, id, case when is_ai then 'assistant' else 'user' end as role, coalesce(comment, '') as content from c), f as (select *, case when role is distinct from lag(role) over (partition by paper_id order by id) then 1 else 0 end as opens from s), r as (select *, cast(sum(opens) over (partition by paper_id order by id) as bigint) as turn from f) select paper_id, turn, role, md5(string_agg(content, '\n\n' order by id)) as digest from r group by paper_id, turn, role", "c")
def x_merged_roles(t: Tables) -> DataFrame:
    turns = t.comments("paper_id", "is_ai", "comment").select("paper_id", "id", F.when(F.col("is_ai"), "assistant").otherwise("user").alias("role"), F.coalesce("comment", F.lit("")).alias("content"))
    return external.merge_roles(turns, "paper_id", "id").select("paper_id", "turn", "role", F.md5("content").alias("digest"))


@query("z11_deltas", "select doc_id, text, trim(text, ' ') = '' as failed from documents where text <> '' and doc_kind = 'caption'")
def z11_deltas(t: Tables) -> DataFrame:
    """Captions as they would come in pieces of five characters, put together again."""
    rows = t.raw("documents").where("text <> '' and doc_kind = 'caption'").select("doc_id", "text", F.explode(F.expr("sequence(0, (char_length(text) - 1) div 5)")).alias("seq"))
    piece = F.expr("substring(text, seq * 5 + 1, 5)")
    event = F.to_json(F.struct(F.array(F.struct(F.struct(piece.alias("content")).alias("delta"))).alias("choices")))
    return external.stream_deltas(rows.select("doc_id", "seq", F.concat(F.lit("data: "), event).alias("value")), "doc_id", "seq")


@query("x_answers", ", s as (select distinct on (paper_id) paper_id, id, coalesce(comment, '') as content from c where not is_ai order by paper_id, id desc) select count(*) as n, count(distinct paper_id) as papers from s", "c")
def x_answers(t: Tables) -> DataFrame:
    """Conversations of papers, answered by the stand-in for a model, which gives back what the user said last."""
    turns = t.comments("paper_id", "is_ai", "comment").where("not is_ai").select("paper_id", "id", F.lit("user").alias("role"), F.coalesce("comment", F.lit("")).alias("content"))
    made = external.answers(external.conversations(turns, "paper_id", "id", "Be brief."), external.Echo(), "paper_id")
    return made.where("error is null").agg(F.count("answer").alias("n"), F.count_distinct("paper_id").alias("papers"))


# drawings, made of boxes
@query("g7_clips", f"with b as ({_BOXES}), s as (select paper_id, pos, x0, 800 - y1 as y0, x1, 800 - y0 as y1 from b) select * from s where (x1 - x0) * (y1 - y0) >= 2000 and (x1 - x0) / (y1 - y0) between 1.0 / 12 and 12")
def g7_clips(t: Tables) -> DataFrame:
    page = F.format_string('<svg><clipPath id="c%d"><path transform="matrix(1,0,0,-1,0,800)" d="M %s %s H %s V %s h %s Z"/></clipPath></svg>', "pos", "x0", "y0", "x1", "y1", F.col("x0") - F.col("x1"))
    return _boxes(t).select("paper_id", "pos", F.explode(svg.clip_boxes(page)).alias("box")).select("paper_id", "pos", "box.*")


@query("g8_fills", f"with b as ({_BOXES}), s as (select paper_id, pos, x0 + 1 as x0, 700 - 2 * y1 as y0, x1 + 1 as x1, 700 - 2 * y0 as y1 from b) select * from s where (x1 - x0) * (y1 - y0) > 3000 and x1 - x0 > 100 and y1 - y0 > 10")
def g8_fills(t: Tables) -> DataFrame:
    trace = F.format_string('<page number="1" mediabox="0 0 600 700">\n<fill_path transform="1 0 0 2 1 0">\n<moveto x="%s" y="%s"/>\n<lineto x="%s" y="%s"/>\n</fill_path></page>', "x0", "y0", "x1", "y1")
    return _boxes(t).select("paper_id", "pos", F.explode(svg.fill_boxes(trace, F.lit(842))).alias("box")).select("paper_id", "pos", "box.*")


# spellings: terms of English texts without formulas and code, where SQL has the same notion of a word
_TERMS = {"baseline": "reference", "loss": "objective", "training steps": "updates"}
_PLAIN = "text not like '%$%' and text not like '%`%' and regexp_matches(text, '^[\\x00-\\x7f]*$')"


@query("t21_terms", f"select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\\btraining[\\s-]+steps\\b', 'updates', 'g'), '(?i)\\bbaseline\\b', 'reference', 'g'), '(?i)\\bloss\\b', 'objective', 'g')) as digest from documents where {_PLAIN} and text not like '%\\_%' escape '\\'")
def t21_terms(t: Tables) -> DataFrame:
    plain = t.raw("documents").where(~F.col("text").contains("$") & ~F.col("text").contains("`") & ~F.col("text").contains("_") & F.col("text").rlike("^[\\x00-\\x7f]*$"))
    return plain.select("doc_id", F.md5(terms.normalise_terms(F.col("text"), _TERMS)["text"]).alias("digest"))


@query("a22_term_counts")
def a22_term_counts(t: Tables) -> DataFrame:
    return terms.term_counts(t.insights, F.col("insight"), _TERMS)


@query("t34_truncated", "select doc_id, length(substring(text, 1, 30000)) as n from documents where text is not null")
def t34_truncated(t: Tables) -> DataFrame:
    """Texts as they are handed to a model, of at most 30,000 characters, which is what it takes."""
    return t.raw("documents").where("text is not null").select("doc_id", F.char_length(F.substring("text", 1, 30_000)).cast("long").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
