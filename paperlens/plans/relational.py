"""Queries over papers, insights, tags, marks, comments and authors, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperlens.catalog import Tables, valid_insight, with_views
from paperlens.operators import authors, insights, listing, mutations, setops, tags
from paperlens.operators.listing import ListSpec

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_VALID = "insight <> '' and insight <> '__ANALYZING__' and not starts_with(insight, 'Figure extraction failed') and not starts_with(insight, 'Insight failed') and not starts_with(insight, 'MinerU API not configured')"
_JOINED = "joined as (select live.*, pi.insight, pi.review, pi.checked_at, pi.reviewed_at, pi.processed_at as insight_processed_at from live left join pi on live.id = pi.paper_id)"


def query(name: str, sql: str | None = None, *views: str) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a query on the tables and its SQL behind the views it names."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            _SQL[name] = with_views(sql, *views) if views else sql
        return f

    return register


def _listing(name: str, spec: ListSpec, where: str) -> None:
    """A filter as a query of ids with a score."""
    sql = f", {_JOINED} select id, round(cast(score as double), 4) as score from joined where {where}"
    query(name, sql, "live", "pi", *(["m"] if " m " in where else []))(lambda t: listing.filtered(t, spec).select("id", F.round(F.col("score").cast("double"), 4).alias("score")))


# filters
_listing("f1_live", ListSpec(), "true")
_listing("f2_mark", ListSpec(mark="critical"), "id in (select paper_id from m where mark = 'critical')")
_listing("f3_mark_none", ListSpec(mark="none"), "id not in (select paper_id from m )")
_listing("f4_insight_has", ListSpec(insight="has"), _VALID)
_listing("f5_insight_none", ListSpec(insight="none"), f"insight is null or not ({_VALID})")
_listing("f6_tag", ListSpec(tag="retrieval"), "id in (select paper_id from paper_tags where tag = 'retrieval')")
_listing("f7_checked", ListSpec(checked="checked"), "checked_at is not null")
_listing("f7_unchecked", ListSpec(checked="none"), "checked_at is null")
_listing("f8_source", ListSpec(source_type="openreview"), "source_type = 'openreview'")
_SEARCH = "id ilike '{0}' or title ilike '{0}' or summary ilike '{0}' or abstract_zh ilike '{0}' or insight ilike '{0}' or review ilike '{0}' or '[\"' || array_to_string(authors, '\", \"') || '\"]' ilike '{0}' or id in (select paper_id from paper_tags where tag ilike '{0}')"
_listing("f9_search", ListSpec(search="Graph"), _SEARCH.format("%Graph%"))
_listing("f9_search_zh", ListSpec(search="检索"), _SEARCH.format("%检索%"))
_listing("f12_year", ListSpec(date_prefix="2023"), "strftime(published, '%Y-%m-%d') like '2023%'")
_listing("f12_month", ListSpec(date_prefix="2023-05"), "strftime(published, '%Y-%m-%d') like '2023-05%'")
_listing("f_combined", ListSpec(insight="has", source_type="arxiv", checked="none", tag="retrieval"), f"{_VALID} and source_type = 'arxiv' and checked_at is null and id in (select paper_id from paper_tags where tag = 'retrieval')")


@query("f11_light", f", {_JOINED} select id, title, coalesce(insight = '__ANALYZING__', false) as is_analyzing, coalesce(review = '__REVIEWING__', false) as is_reviewing, coalesce(insight <> '' and insight <> '__ANALYZING__', false) as has_insight, coalesce(review <> '' and review <> '__REVIEWING__', false) as has_review from joined", "live", "pi")
def f11_light(t: Tables) -> DataFrame:
    return listing.light(listing.joined(t)).select("id", "title", "is_analyzing", "is_reviewing", "has_insight", "has_review")


@query("f14_status", ", x as (select id, title, insight = '__ANALYZING__' as analyzing, review = '__REVIEWING__' as reviewing from live join pi on id = paper_id) select * from x where analyzing or reviewing", "live", "pi")
def f14_status(t: Tables) -> DataFrame:
    return insights.in_progress(t)


@query("f14_pending", "select id, paper_id from c where is_ai and ai_status = 'pending'", "c")
def f14_pending(t: Tables) -> DataFrame:
    return t.comments("paper_id", "is_ai", "ai_status").where("is_ai and ai_status = 'pending'").select("id", "paper_id")


@query("f15_with_insight", "select paper_id from pi where insight <> '' and insight <> '__ANALYZING__'", "pi")
def f15_with_insight(t: Tables) -> DataFrame:
    return t.insights.where("insight <> '' and insight <> '__ANALYZING__'").select("paper_id")


@query("f16_deleted", "select distinct id from deleted_papers")
def f16_deleted(t: Tables) -> DataFrame:
    return t.deleted


@query("f19_arxiv_ids", "select id, contains(id, '.') or contains(id, '/') as is_arxiv from p", "p")
def f19_arxiv_ids(t: Tables) -> DataFrame:
    return t.papers.select("id", (F.col("id").contains(".") | F.col("id").contains("/")).alias("is_arxiv"))


@query("f20_short_texts", "select doc_id, strlen(text) >= 200 as accepted from documents where text is not null")
def f20_short_texts(t: Tables) -> DataFrame:
    return t.raw("documents").where("text is not null").select("doc_id", (F.octet_length("text") >= 200).alias("accepted"))


@query("f21_frequent_tags", ", x as (select *, row_number() over (partition by paper_id order by weight desc, tag) as rn from lt) select tag, count(*) as cnt from x where rn <= 3 group by tag having count(*) > 10", "lt")
def f21_frequent_tags(t: Tables) -> DataFrame:
    return tags.ranking(t).where("cnt > 10")


@query("f27_urls", "select id, case source_type when 'arxiv' then coalesce(external_id, id) when 'openreview' then coalesce(external_id, source_url) else source_url end as target from p", "p")
def f27_urls(t: Tables) -> DataFrame:
    kind = F.col("source_type")
    target = F.when(kind == "arxiv", F.coalesce("external_id", "id")).when(kind == "openreview", F.coalesce("external_id", "source_url")).otherwise(F.col("source_url"))
    return t.papers.select("id", target.alias("target"))


# joins
@query("j1_left", ", x as (select live.id, pi.paper_id is not null as has_row, length(coalesce(insight, '')) as len from live left join pi on live.id = pi.paper_id) select * from x", "live", "pi")
def j1_left(t: Tables) -> DataFrame:
    return listing.joined(t).select("id", F.col("insight").isNotNull().alias("has_row"), F.length(F.coalesce("insight", F.lit(""))).cast("long").alias("len"))


@query("j3_inner", "select live.id, pi.checked_at is not null as checked from live join pi on live.id = pi.paper_id", "live", "pi")
def j3_inner(t: Tables) -> DataFrame:
    return t.live(t.papers).join(t.insights.select(F.col("paper_id").alias("id"), F.col("checked_at").isNotNull().alias("checked")), "id").select("id", "checked")


@query("j6_without_marks", "select id from live where id not in (select paper_id from m)", "live", "m")
def j6_without_marks(t: Tables) -> DataFrame:
    return t.live(t.papers).join(t.marks.select(F.col("paper_id").alias("id")), "id", "left_anti").select("id")


@query("j6_without_tags", "select id from live where id not in (select paper_id from paper_tags)", "live")
def j6_without_tags(t: Tables) -> DataFrame:
    return t.live(t.papers).join(t.raw("paper_tags").select(F.col("paper_id").alias("id")), "id", "left_anti").select("id")


@query("j10_matching_tags", ", x as (select distinct tag from lt) select x.tag, pref.tag as ptag from x join pref on preference_type = 'interest' and x.tag like '%' || pref.tag || '%'", "lt", "pref")
def j10_matching_tags(t: Tables) -> DataFrame:
    return tags.matching_tags(t, "interest")


_ORPHANS = ", shared as (select tag from t group by tag having count(distinct paper_id) > 1), orphan as (select distinct paper_id from lt where paper_id not in (select paper_id from lt join shared using (tag)))"


@query("j12_orphans", _ORPHANS + " select paper_id from orphan", "lt")
def j12_orphans(t: Tables) -> DataFrame:
    return tags.orphans(t)


_COHORT = ", coh as (select distinct paper_id, preference_type as kind from lt join pref on lt.tag like '%' || pref.tag || '%'), unint as (select paper_id from coh where kind = 'disinterest' and paper_id not in (select paper_id from coh where kind = 'interest'))"


@query("j13_uninteresting", _COHORT + " select distinct paper_id from unint", "lt", "pref")
def j13_uninteresting(t: Tables) -> DataFrame:
    return tags.uninteresting(t)


@query("j15_threads", "with recursive cc as (select distinct on (id) * from paper_comments order by id, updated_at desc), th as (select id, id as root, paper_id, 0 as depth from cc where parent_id is null union all select cc.id, th.root, th.paper_id, th.depth + 1 from cc join th on cc.parent_id = th.id) select root, count(*) as n, cast(max(depth) as bigint) as deepest from th group by root")
def j15_threads(t: Tables) -> DataFrame:
    from paperlens.operators.hierarchy import roots

    nodes = roots(t.raw("paper_comments"), "id", "parent_id", "updated_at")
    return nodes.groupBy("root").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


@query("j16_critical_tags", "select distinct tag from t where paper_id in (select paper_id from m where mark = 'critical')", "t", "m")
def j16_critical_tags(t: Tables) -> DataFrame:
    return t.tags.join(t.marks.where("mark = 'critical'").select("paper_id"), "paper_id", "left_semi").select("tag").distinct()


@query("j22_names", "select name, regexp_replace(trim(regexp_replace(regexp_replace(lower(name), '[^\\p{L}\\s]', '', 'g'), '\\s+', ' ', 'g')), '^ | $', '', 'g') as norm from author_stats")
def j22_names(t: Tables) -> DataFrame:
    from paperlens.functions.text import normalize_name

    return t.authors.select("name", normalize_name(F.col("name")).alias("norm"))


# aggregates
@query("a1_count", "select count(distinct id) as n from live", "live")
def a1_count(t: Tables) -> DataFrame:
    return listing.count(listing.filtered(t, ListSpec()))


_RANKED = ", x as (select *, row_number() over (partition by paper_id order by weight desc, tag) as rn from lt)"


@query("a2_tag_ranking", _RANKED + " select tag, count(*) as cnt from x where rn <= 3 group by tag", "lt")
def a2_tag_ranking(t: Tables) -> DataFrame:
    return tags.ranking(t)


@query("a3_papers_per_tag", "select tag, count(distinct paper_id) as cnt from paper_tags group by tag")
def a3_papers_per_tag(t: Tables) -> DataFrame:
    return tags.papers_per_tag(t)


@query("a4_orphan_count", _ORPHANS + " select count(*) as n from orphan", "lt")
def a4_orphan_count(t: Tables) -> DataFrame:
    return tags.orphans(t).agg(F.count("*").alias("n"))


@query("a5_uninteresting_count", _COHORT + " select count(distinct paper_id) as n from unint", "lt", "pref")
def a5_uninteresting_count(t: Tables) -> DataFrame:
    return tags.uninteresting(t).agg(F.count("*").alias("n"))


@query("a6_disinterest", _COHORT + " select pref.tag, count(distinct lt.paper_id) as cnt from lt join pref on preference_type = 'disinterest' and lt.tag like '%' || pref.tag || '%' where lt.paper_id not in (select paper_id from coh where kind = 'interest') group by pref.tag", "lt", "pref")
def a6_disinterest(t: Tables) -> DataFrame:
    return tags.disinterest_counts(t)


@query("a7_date_rollup", "select case grouping(year(published), month(published), day(published)) when 0 then 'day' when 1 then 'month' when 3 then 'year' else 'all' end as level, cast(year(published) as int) as y, cast(month(published) as int) as m, cast(day(published) as int) as d, count(*) as n from live group by rollup (year(published), month(published), day(published))", "live")
def a7_date_rollup(t: Tables) -> DataFrame:
    return insights.date_rollup(t)


@query("a7_date_tree", ", days as (select strftime(published, '%Y') as y, strftime(published, '%m') as m, count(*) as n, count(distinct strftime(published, '%d')) as k from live group by 1, 2) select y as label, cast(sum(n) as bigint) as count, count(*) as months, cast(sum(k) as bigint) as days from days group by y", "live")
def a7_date_tree(t: Tables) -> DataFrame:
    days = F.aggregate(F.transform("children", lambda m: F.size(m["children"])), F.lit(0), lambda a, b: a + b)
    return insights.date_tree(t).select("label", "count", F.size("children").cast("long").alias("months"), days.cast("long").alias("days"))


@query("a8_author_stats", ", names as (select cast(score as double) as score, id in (select paper_id from m where mark = 'critical') as crit, trim(unnest(authors[1:20]), ' ') as name from live) select name, count(*) as paper_count, round(avg(score), 6) as avg_score, count(*) filter (crit) as critical_count from names where strlen(name) >= 2 group by name", "live", "m")
def a8_author_stats(t: Tables) -> DataFrame:
    return authors.rebuild(t)


@query("a9_running_stats", ", names as (select cast(score as double) as score, trim(unnest(authors), ' ') as name from p), fresh as (select name, count(*) as n, sum(score) as s from names group by name) select a.name, paper_count + coalesce(n, 0) as paper_count, round((cast(avg_score as double) * paper_count + coalesce(s, 0)) / (paper_count + coalesce(n, 0)), 6) as avg_score from author_stats a left join fresh on a.name = fresh.name where paper_count + coalesce(n, 0) > 0", "p")
def a9_running_stats(t: Tables) -> DataFrame:
    new = t.papers.select(F.explode("authors").alias("name"), "score").select(F.trim("name").alias("name"), "score", F.lit(False).alias("critical"))
    old = t.authors
    merged = authors.running(old.withColumn("avg_score", F.col("avg_score").cast("double")), new).join(old.select("name"), "name", "left_semi")
    return merged.where("paper_count > 0").select("name", "paper_count", F.round("avg_score", 6).alias("avg_score"))


@query("a10_preferences", "select preference_type, count(*) as n from pref group by preference_type", "pref")
def a10_preferences(t: Tables) -> DataFrame:
    return t.preferences.groupBy("preference_type").agg(F.count("*").alias("n"))


@query("a11_tags_of", ", o as (select paper_id, string_agg(tag, '; ' order by weight desc, tag) as tags, count(*) as n from t group by paper_id) select * from o", "t")
def a11_tags_of(t: Tables) -> DataFrame:
    return tags.tags_of(t)


@query("a13_by_source", "select source_type, count(*) as n, strftime(min(published), '%Y-%m-%d') as first, strftime(max(published), '%Y-%m-%d') as last, round(avg(cast(score as double)), 6) as mean from live group by source_type", "live")
def a13_by_source(t: Tables) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t.live(t.papers).groupBy("source_type").agg(F.count("*").alias("n"), day(F.min("published")).alias("first"), day(F.max("published")).alias("last"), F.round(F.avg(F.col("score").cast("double")), 6).alias("mean"))


@query("a_status_counts", f"select case when insight = '' then 'empty' when insight = '__ANALYZING__' then 'analyzing' when {_VALID} then 'valid' else 'failed' end as state, count(*) as n from pi group by 1", "pi")
def a_status_counts(t: Tables) -> DataFrame:
    return insights.status_counts(t)


@query("a_dashboard", f"{_RANKED}{_ORPHANS}{_COHORT} select (select count(distinct tag) from x where rn <= 3) as tags, (select count(*) from orphan) as orphans, (select count(distinct paper_id) from unint) as uninteresting, (select count(*) from pref where preference_type = 'interest') as interest_tags, (select count(*) from pref where preference_type = 'disinterest') as disinterest_tags", "lt", "pref")
def a_dashboard(t: Tables) -> DataFrame:
    return tags.dashboard(t)


@query("a_comments_per_paper", "select paper_id, count(*) as n, count(*) filter (is_ai) as n_ai, count(*) filter (parent_id is not null) as replies from c group by paper_id", "c")
def a_comments_per_paper(t: Tables) -> DataFrame:
    return t.comments("paper_id", "is_ai", "parent_id").groupBy("paper_id").agg(F.count("*").alias("n"), F.count_if("is_ai").alias("n_ai"), F.count("parent_id").alias("replies"))


# windows
@query("w1_top_tags", _RANKED + " select paper_id, tag, rn from x where rn <= 3", "lt")
def w1_top_tags(t: Tables) -> DataFrame:
    return tags.top_tags(t.live_tags, 3).select("paper_id", "tag", "rn")


@query("w2_neighbours", f", v as (select live.id from live join pi on live.id = pi.paper_id where {_VALID}) select id, lag(id) over (order by id) as prev_id, lead(id) over (order by id) as next_id from v", "live", "pi")
def w2_neighbours(t: Tables) -> DataFrame:
    return insights.neighbours(t)


@query("w3_latest_comment", ", x as (select paper_id, id, row_number() over (partition by paper_id order by created_at desc, id desc) as rn from c) select paper_id, id from x where rn = 1", "c")
def w3_latest_comment(t: Tables) -> DataFrame:
    return insights.latest_version(t.comments("paper_id", "created_at"), "paper_id", "created_at", "id").select("paper_id", "id")


@query("w4_sessions", "with x as (select user_id, event_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as opens from events), y as (select *, sum(opens) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from x) select user_id, cast(session as bigint) as session, count(*) as n from y group by user_id, session")
def w4_sessions(t: Tables) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    opens = F.when(F.col("ts") - F.lag("ts").over(order) <= F.expr("interval 30 minutes"), 0).otherwise(1)
    marked = t.raw("events").select("user_id", "event_id", "ts", opens.alias("opens"))
    numbered = marked.withColumn("session", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n"))


# order and limits
def _paged(name: str, spec: ListSpec, order: str) -> None:
    size = min(200, max(1, spec.page_size))
    sql = f", {_JOINED} select id, title from joined order by {order} limit {size} offset {(max(1, spec.page) - 1) * size}"
    query(name, sql, "live", "pi")(lambda t: listing.page(listing.filtered(t, spec), spec).select("id", "title"))


_paged("r1_published", ListSpec(), "published desc nulls first, id desc")
_paged("r1_score_asc", ListSpec(sort="score", descending=False, page_size=50), "score asc nulls last, id asc")
_paged("r1_checked", ListSpec(sort="checked", page_size=100), "checked_at desc nulls first, id desc")
_paged("r2_page3", ListSpec(sort="processed_at", page=3, page_size=20), "processed_at desc nulls first, id desc")


@query("r4_recent", f"select live.id, title from live join pi on live.id = pi.paper_id where {_VALID} order by coalesce(pi.processed_at, live.processed_at) desc, live.id desc limit 20", "live", "pi")
def r4_recent(t: Tables) -> DataFrame:
    return insights.recent(t, 20).select("id", "title")


@query("r6_by_date", ", tt as (select paper_id, count(*) as n_tags, max_by(tag, (weight, tag)) as top_tag from t group by paper_id), b as (select id, title, cast(score as double) as score from live where strftime(published, '%Y-%m-%d') like '2024%' order by score desc, id limit 5000) select b.*, n_tags, top_tag from b left join tt on id = paper_id", "live", "t")
def r6_by_date(t: Tables) -> DataFrame:
    return insights.by_date(t, "2024").select("id", "title", "score", "n_tags", "top_tag")


def _related(full: bool) -> str:
    n2 = "(select sum(weight * weight) from lt z where z.paper_id = dots.other_id)" if full else "shared"
    return f""", mine as (select t.* from t where paper_id in (select id from p where cast('0x' || substr(md5(id), 1, 8) as bigint) % 20 = 0)), dots as (select mine.paper_id, lt.paper_id as other_id, sum(mine.weight * lt.weight) as dot, sum(lt.weight * lt.weight) as shared from mine join lt on mine.tag = lt.tag and mine.paper_id <> lt.paper_id group by 1, 2),
      norms as (select paper_id, sum(weight * weight) as n1 from mine group by paper_id), sims as (select dots.paper_id, other_id, round(dot / (sqrt(n1) * sqrt({n2})), 9) as sim from dots join norms on dots.paper_id = norms.paper_id where n1 > 0 and {n2} > 0),
      ranked as (select *, row_number() over (partition by paper_id order by sim desc, other_id) as rank from sims where sim > 0) select paper_id, other_id, round(sim, 6) as sim, rank from ranked where rank <= 5"""


# Queries of a search are a stated set of rows, against all rows: those whose id is divisible by 20, where the number of an id that is a
# string is the first half of the first half of its digest.
_ASKED = "cast(conv(substr(md5(id), 1, 8), 16, 10) as bigint) % 20 = 0"


@query("r7_related", _related(False), "lt", "p")
def r7_related(t: Tables) -> DataFrame:
    return tags.related(t, t.papers.where(_ASKED).select(F.col("id").alias("paper_id")), 5)


@query("r7_related_full", _related(True), "lt", "p")
def r7_related_full(t: Tables) -> DataFrame:
    return tags.related(t, t.papers.where(_ASKED).select(F.col("id").alias("paper_id")), 5, full=True)


@query("r8_without_external", "select name, paper_count from author_stats where citation_count is null and h_index is null order by paper_count desc, name limit 50")
def r8_without_external(t: Tables) -> DataFrame:
    return authors.without_external(t, 50)


@query("s24_export_names", ", n as (select trim(unnest(authors), ' ') as name from p) select distinct name from n where name <> ''", "p")
def s24_export_names(t: Tables) -> DataFrame:
    return authors.export_names(t)


@query("s26_report", "select id, case when len(authors) > 6 then array_to_string(authors[1:6], ', ') || ' et al.' else array_to_string(authors, ', ') end as names from p", "p")
def s26_report(t: Tables) -> DataFrame:
    from paperlens.functions.text import truncate_authors

    return t.papers.select("id", truncate_authors(F.col("authors")).alias("names"))


@query("g10_boost", None)
def g10_boost(t: Tables) -> DataFrame:
    return authors.boost(t)


_BOOST = """, l as (select id, list_transform(authors, lambda a: trim(a, ' ')) as authors from live where len(authors) > 0),
  r as (select id, unnest([{'w': 4.0, 'name': authors[1]}, {'w': 3.0, 'name': authors[2]}, {'w': 2.0, 'name': authors[3]}, {'w': 2.5, 'name': case when len(authors) > 3 and not list_contains(authors[1:3], authors[-1]) then authors[-1] end}]) as x from l),
  q as (select name, case when paper_count > 0 then (cast(avg_score as double) - 5.0) * 0.10 + least(critical_count, 5.0) * 0.1 + ln(1 + paper_count) * 0.10 else 0 end +
    case when h_index >= 50 then 0.5 when h_index >= 20 then 0.3 when h_index >= 10 then 0.15 when h_index is null and citation_count >= 10000 then 0.4 when h_index is null and citation_count >= 1000 then 0.2 else 0 end as q from author_stats)
  select id, round(cast(greatest(-1.5, least(5.0, sum(x.w * coalesce(q, 0)))) as double), 6) as boost from r left join q on x.name = q.name where x.name is not null group by id"""
_SQL["g10_boost"] = with_views(_BOOST, "live")


@query("g11_estimate", "select name, case when paper_count = 0 and h_index is not null then (case when h_index >= 50 then h_index * 6 when h_index >= 20 then h_index * 5 when h_index >= 10 then h_index * 4 when h_index > 0 then h_index * 3 else 0 end) else paper_count end as paper_count from author_stats")
def g11_estimate(t: Tables) -> DataFrame:
    return authors.estimate(t.authors).select("name", "paper_count")


# set operations
@query("x_difference", "select distinct tag from t where tag not in (select tag from pref)", "t", "pref")
def x_difference(t: Tables) -> DataFrame:
    return setops.difference(t.tags.select("tag"), t.preferences.select("tag"))


@query("x_union", "select tag from t union select tag from pref", "t", "pref")
def x_union(t: Tables) -> DataFrame:
    return setops.union_distinct(t.tags.select("tag"), t.preferences.select("tag"))


@query("x_intersection", "select tag from t intersect select tag from pref", "t", "pref")
def x_intersection(t: Tables) -> DataFrame:
    return setops.intersection(t.tags.select("tag"), t.preferences.select("tag"))


# mutations, as functions from tables to tables
@query("u1_upsert", ", n as (select paper_id, tag, weight + 1 as weight from t where weight < 2) select coalesce(n.paper_id, t.paper_id) as paper_id, coalesce(n.tag, t.tag) as tag, round(coalesce(n.weight, t.weight), 4) as weight from t full join n on t.paper_id = n.paper_id and t.tag = n.tag", "t")
def u1_upsert(t: Tables) -> DataFrame:
    new = t.tags.where("weight < 2").withColumn("weight", F.col("weight") + 1)
    return mutations.upsert(t.tags, new, ["paper_id", "tag"]).withColumn("weight", F.round("weight", 4))


@query("u2_patch", ", n as (select id, upper(title) as title from p where score > 7) select p.id, case when pi.checked_at is null then coalesce(n.title, p.title) else p.title end as title from p left join n on p.id = n.id left join pi on p.id = pi.paper_id", "p", "pi")
def u2_patch(t: Tables) -> DataFrame:
    base = t.papers.select("id", "title").join(t.insights.select(F.col("paper_id").alias("id"), F.col("checked_at").isNull().alias("open")), "id", "left").withColumn("open", F.coalesce("open", F.lit(True)))
    patch = t.papers.where("score > 7").select("id", F.upper("title").alias("title"))
    return mutations.patch(base, patch, ["id"], guard=F.col("open")).select("id", "title")


@query("u3_replace_tags", ", n as (select paper_id, 'single' as tag from t group by paper_id having count(*) = 1) select paper_id, tag from t where paper_id not in (select paper_id from n) union all select * from n", "t")
def u3_replace_tags(t: Tables) -> DataFrame:
    new = t.tags.groupBy("paper_id").agg(F.count("*").alias("n")).where("n = 1").select("paper_id", F.lit("single").alias("tag"))
    return mutations.replace_group(t.tags.select("paper_id", "tag"), new, ["paper_id"])


@query("u4_soft_delete", ", x as (select *, row_number() over (partition by paper_id order by weight desc, tag) as rn from t where paper_id in (select id from d)) select distinct x.tag from x where rn <= 2 and tag not in (select tag from pref where preference_type = 'interest')", "t", "d", "pref")
def u4_soft_delete(t: Tables) -> DataFrame:
    gone = t.tags.join(t.deleted.withColumnRenamed("id", "paper_id"), "paper_id", "left_semi")
    return mutations.demoted_tags(gone, t.preferences)


@query("u5_cleanup", "select paper_id, tag from t where paper_id in (select id from live)", "t", "live")
def u5_cleanup(t: Tables) -> DataFrame:
    return t.tags.select("paper_id", "tag").join(t.live(t.papers).select(F.col("id").alias("paper_id")), "paper_id", "left_semi")


@query("u7_sync_interest", "select distinct tag, 'interest' as preference_type from t where paper_id in (select paper_id from m where mark = 'critical') union select tag, preference_type from pref where tag not in (select tag from t where paper_id in (select paper_id from m where mark = 'critical'))", "t", "m", "pref")
def u7_sync_interest(t: Tables) -> DataFrame:
    new = j16_critical_tags(t).withColumn("preference_type", F.lit("interest"))
    return mutations.replace_group(t.preferences, new, ["tag"])


@query("u11_cascade", "with recursive cc as (select distinct on (id) * from paper_comments order by id, updated_at desc), gone as (select id from cc where ai_status = 'rejected' union select cc.id from cc join gone on cc.parent_id = gone.id) select id from cc where id not in (select id from gone)")
def u11_cascade(t: Tables) -> DataFrame:
    return mutations.cascade_delete(t.comments("parent_id", "ai_status"), F.col("ai_status") == "rejected").select("id")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["oracle_sql", "queries", "valid_insight"]
