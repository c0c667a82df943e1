"""Operators on small tables: defined results for nulls, repeats, ties and empty tables."""

import datetime as dt
import json
import zipfile

from pyspark.sql import functions as F

from paperlens.functions import geometry as g
from paperlens.functions.geometry import Box
from paperlens.operators import authors, layout, mutations, setops, tags
from paperlens.sources import readers
from paperlens.streaming import flows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_mutations(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(mutations.upsert(base, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    versions = spark.createDataFrame([(2, "old", 1), (2, "new", 2)], "k int, v string, at int")
    assert rows(mutations.upsert(base, versions, ["k"], "at")) == [(1, "a"), (2, "new")]
    assert rows(mutations.patch(base, spark.createDataFrame([(1, None), (2, "x")], "k int, v string"), ["k"])) == [(1, "a"), (2, "x")]
    assert rows(mutations.patch(base, spark.createDataFrame([(2, "x")], "k int, v string"), ["k"], guard=F.col("v") == "a")) == [(1, "a"), (2, "b")]
    assert rows(mutations.replace_group(base, spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), ["k"])) == [(1, "x"), (1, "y"), (2, "b")]
    marks = spark.createDataFrame([("p", "critical"), ("q", "marginal")], "paper_id string, mark string")
    change = spark.createDataFrame([("p", None), ("r", "supporting"), ("s", "wrong")], "paper_id string, mark string")
    assert rows(mutations.set_mark(marks, change)) == [("q", "marginal"), ("r", "supporting")]
    tree = spark.createDataFrame([(1, None, False), (2, 1, True), (3, 2, False), (4, 3, False), (5, 1, False), (6, 6, False)], "id long, parent_id long, bad boolean")
    assert [r[0] for r in mutations.cascade_delete(tree, F.col("bad")).orderBy("id").collect()] == [1, 5, 6]
    assert mutations.cascade_delete(tree.limit(0), F.col("bad")).count() == 0


def test_sets(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    assert rows(setops.difference(a, b)) == [(1,)] and rows(setops.union_distinct(a, b)) == [(1,), (2,), (3,)] and rows(setops.intersection(a, b)) == [(2,)]


def test_top_tags_break_ties(spark):
    df = spark.createDataFrame([("p", "b", 1.0), ("p", "a", 1.0), ("p", "c", 2.0)], "paper_id string, tag string, weight double")
    assert [(r.tag, r.rn) for r in tags.top_tags(df, 2).orderBy("rn").collect()] == [("c", 1), ("a", 2)]


def test_author_quality(spark):
    df = spark.createDataFrame([(0, 0.0, 0, None, None), (200, 8.5, 50, 376000, 134)], "p long, s double, c long, n long, h long")
    q = [r.q for r in df.select(authors.quality(*(F.col(c) for c in "pscnh")).alias("q")).collect()]
    assert q[0] == 0.0 and q[1] * 4 > 1.0
    old = spark.createDataFrame([("a", 1, 4.0, 0)], "name string, paper_count long, avg_score double, critical_count long")
    new = spark.createDataFrame([("a", 8.0, True), ("b", 2.0, False)], "name string, score double, critical boolean")
    assert rows(authors.running(old, new)) == [("a", 2, 6.0, 1), ("b", 1, 2.0, 0)]


BOXES = "paper_id string, page_idx int, pos int, block_type string, x0 double, y0 double, x1 double, y1 double, desc string, caption_number string"


def block(pos, box, number=None, kind="image"):
    return ("p", 0, pos, kind, *map(float, box), "image on page 1" if number is None else number, number)


def test_propagation(spark):
    numbers = lambda bs: [r.caption_number for r in layout.propagate_captions(spark.createDataFrame(bs, BOXES)).orderBy("pos").collect()]
    assert numbers([block(0, (333, 72, 421, 143)), block(1, (416, 72, 534, 143), "F:5")]) == ["F:5", "F:5"]
    assert numbers([block(0, (97, 69, 250, 171)), block(1, (261, 69, 410, 171)), block(2, (416, 70, 496, 171), "F:6")]) == ["F:6"] * 3
    assert numbers([block(0, (86, 70, 249, 209), "T:3", "table"), block(1, (332, 69, 417, 144))]) == ["T:3", None]
    assert layout.propagate_captions(spark.createDataFrame([], BOXES)).count() == 0


def test_rebinding_and_swaps(spark):
    blocks = spark.createDataFrame([block(0, (0, 0, 100, 100)), block(1, (300, 0, 400, 100)), block(2, (0, 300, 100, 400), kind="table"), block(3, (0, 500, 10, 510), "F:1")], BOXES)
    loose = [("p", 0, 0.0, 105.0, 100.0, 115.0, "Figure 2", "F:2"), ("p", 0, 0.0, 285.0, 100.0, 295.0, "Table 1", "T:1"), ("p", 0, 900.0, 900.0, 950.0, 910.0, "Figure 9", "F:9"), ("q", 0, 0.0, 0.0, 1.0, 1.0, "Figure 1", "F:1")]
    orphans = spark.createDataFrame(loose, "paper_id string, page_idx int, x0 double, y0 double, x1 double, y1 double, desc string, caption_number string")
    got = {r.pos: (r.caption_number, r.desc) for r in layout.rebind_captions(blocks, orphans).collect()}
    assert got == {0: ("F:2", "Figure 2"), 1: (None, "image on page 1"), 2: ("T:1", "Table 1"), 3: ("F:1", "F:1")}
    wrong = spark.createDataFrame([block(0, (0, 0, 9, 9), "T:1"), block(1, (0, 0, 9, 9), "F:2", "table"), block(2, (0, 0, 9, 9), "F:3")], BOXES)
    assert {r.pos: r.caption_number for r in layout.swap_captions(wrong).collect()} == {0: "F:2", 1: "T:1", 2: "F:3"}


def test_layout_document(spark):
    line = lambda s: {"bbox": [0, 0, 1, 1], "spans": [{"type": "text", "content": s}]}
    doc = {"pdf_info": [{"page_idx": 3, "page_size": [600, 800], "para_blocks": [
        {"type": "image", "bbox": [0, 0, 100, 130], "blocks": [{"type": "image_body", "bbox": [0, 0, 100, 100]}, {"type": "image_caption", "bbox": [0, 100, 100, 130], "lines": [line("Figure 4:"), line("words")]}]},
        {"type": "table", "bbox": [5, 5, 50, 60]}, {"type": "text", "lines": [line("body")]}]}]}
    pages = spark.createDataFrame([("a", json.dumps(doc))], "archive string, text string").select(F.lit("layout.json").alias("name"), "*")
    pages = readers.layouts(pages).withColumnRenamed("archive", "paper_id")
    got = layout.raw_blocks(pages).orderBy("pos").collect()
    assert [(r.block_type, r.x1, r.y1, r.desc, r.caption_number) for r in got] == [("image", 100.0, 100.0, "Figure 4: words", "F:4"), ("table", 50.0, 60.0, "table on page 4", None)]
    assert [r.text for r in layout.page_lines(pages).collect()] == ["body"]


def test_validation_and_grouping(spark):
    blocks = spark.createDataFrame([block(0, (0, 0, 100, 100), "F:1"), block(1, (110, 0, 200, 100), "F:1"), block(2, (0, 200, 100, 300), "F:4"), block(3, (10, 210, 90, 290))], BOXES)
    figs = layout.figures(blocks)
    assert {(r.figure, r.parts, r.x1) for r in figs.collect()} == {("F:1", 2, 200.0), ("F:4", 1, 100.0), ("pos:3", 1, 90.0)}
    assert rows(layout.missing_numbers(figs)) == [("p", "F", 2), ("p", "F", 3)]
    known = spark.createDataFrame([("p", "F:1"), ("p", "F:2")], "paper_id string, caption_number string")
    assert {(r.error, r.detail) for r in layout.validate(figs, known).collect()} == {("absent", "F:2"), ("unknown", "F:4"), ("gap", "F:2"), ("overlap", "2-3")}
    assert {(r.pos, r.panel) for r in layout.panels(blocks).collect()} == {(0, "a"), (1, "b"), (2, "a")}
    near = layout.distinct_boxes(blocks.withColumn("score", F.lit(1.0) * F.col("pos")))
    assert {r.pos for r in near.collect()} == {0, 1, 3}
    titles = spark.createDataFrame([("p", 0, 0.0, 180.0, 100.0, 195.0)], "paper_id string, page_idx int, x0 double, y0 double, x1 double, y1 double")
    assert {(r.figure, r.y0) for r in layout.absorb_titles(figs, titles).collect()} == {("F:1", 0.0), ("F:4", 180.0), ("pos:3", 180.0)}
    assert rows(layout.match_boxes(blocks, blocks).select("pos", "other")) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert [len(r.figures) for r in layout.overlay(figs, spark.createDataFrame([("p", 2)], "paper_id string, n_pages int")).orderBy("page_idx").collect()] == [3, 0]


def test_geometry(spark):
    a, b = Box(*map(F.lit, (0.0, 0.0, 10.0, 10.0))), Box(*map(F.lit, (5.0, 0.0, 15.0, 10.0)))
    r = spark.range(1).select(g.iou(a, b), g.overlap_ratio(a, b), g.contains(a, b), g.horizontal_overlap(a, b), g.aligned(a, b), g.union(a, b).area, g.svg_matrix(F.lit("matrix(.5,0,0,-.5,2 3)"))).first()
    assert (round(r[0], 6), *r[1:6]) == (0.333333, 0.5, False, 0.5, True, 150.0) and r[6] == [0.5, 0.0, 0.0, -0.5, 2.0, 3.0]


def test_sources(spark, tmp_path):
    feed = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2301.00001v2</id><title>A
      title</title><summary> S </summary><published>2023-01-01T00:00:00Z</published><author><name>A B</name></author><author><name>C</name></author></entry></feed>"""
    (tmp_path / "feed.xml").write_text(feed)
    r = readers.atom(spark, str(tmp_path / "feed.xml")).first()
    assert (r.id, r.title, r.authors, r.pdf_url, r.published) == ("2301.00001", "A title", ["A B", "C"], "https://arxiv.org/pdf/2301.00001", dt.datetime(2023, 1, 1))
    oai = "<arXiv><id>1</id><created>2020-02-03</created><title>T</title><abstract> a </abstract><authors><author><keyname>Doe</keyname><forenames>J</forenames></author></authors></arXiv>"
    r = readers.oai_records(spark.createDataFrame([(oai,), ("<arXiv><id>2</id></arXiv>",)], "xml string")).collect()
    assert [(x.id, x.authors, x.published) for x in r] == [("1", ["J Doe"], dt.datetime(2020, 2, 3))]
    page = '<h1 class="title mathjax"><span>Title:</span>On X</h1><div class="authors"><a href="1">A B</a>, <a href="2">C</a></div><blockquote class="abstract mathjax"><span>Abstract:</span> Text </blockquote><div class="dateline">[v1] Tue, 21 Jan 2025 10:00</div>'
    r = readers.html_pages(spark.createDataFrame([(page,), ("",)], "html string")).collect()
    assert (r[0].title, r[0].authors, r[0].summary, r[0].published) == ("On X", ["A B", "C"], "Text", dt.datetime(2025, 1, 21)) and r[1].title is None
    note = json.dumps({"id": "i", "forum": "f", "pdate": 1700000000000, "content": {"title": {"value": "T"}, "authors": {"value": ["A"]}, "pdf": {"value": "/pdf/1"}}})
    r = readers.notes(spark.createDataFrame([(note,), ('{"id":"x","content":{"title":""}}',)], "note string")).collect()
    assert [(x.id, x.title, x.authors, x.pdf_url) for x in r] == [("f", "T", ["A"], "https://openreview.net/pdf/1")]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/layout.json", '{"pdf_info": [{"page_idx": 0}]}')
        z.writestr("../evil.json", "{}")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    got = {r.name: r.text for r in readers.archives(spark, str(tmp_path)).collect()}
    assert got == {"d/layout.json": '{"pdf_info": [{"page_idx": 0}]}', None: None}
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "y.pdf").write_bytes(b"<html>")
    assert sorted((r.path[-5:], r.valid) for r in readers.pdfs(spark, f"{tmp_path}/*.pdf").collect()) == [("x.pdf", True), ("y.pdf", False)]
    (tmp_path / "i.png").write_bytes(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\1\0\0\0\0\x20")
    assert [(r.width, r.height) for r in readers.png_sizes(spark, f"{tmp_path}/i.png").collect()] == [(256, 32)]
    for n, size in enumerate((2, 1)):
        (tmp_path / f"page-{n:05d}.json").write_text(json.dumps([{"id": f"{n}-{i}", "title": "t"} for i in range(size)]))
    assert readers.pages(spark, str(tmp_path), 2, 10).count() == 3
    assert readers.pages(spark, str(tmp_path), 2, 1).count() == 1 and readers.pages(spark, str(tmp_path), 3).count() == 2
    cache = spark.createDataFrame([("u", "b", dt.datetime(2024, 1, 1)), ("v", "b", dt.datetime(2024, 1, 9))], "url string, body string, written_at timestamp")
    assert [r.url for r in readers.fresh(cache, F.lit(dt.datetime(2024, 1, 10))).collect()] == ["v"]


def test_chunks_accumulate(spark, tmp_path):
    one = [("a", 1, "chunk", "Hel"), ("b", 1, "chunk", "x"), ("a", 2, "chunk", "lo")]
    two = [("a", 3, "done", None), ("b", 2, "reset", None), ("b", 3, "chunk", "y")]
    for n, part in enumerate((one, two)):
        spark.createDataFrame(part, flows.CHUNK).coalesce(1).write.json(str(tmp_path / "in" / f"{n}"))
    stream = spark.readStream.schema(flows.CHUNK).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = flows.drain(spark, flows.accumulate(stream), "chunks", "update")
    last = {r.id: (r.m.status, r.m.text) for r in got.groupBy("id").agg(F.max_by(F.struct("status", "text"), "epoch").alias("m")).collect()}
    assert last == {"a": ("done", "Hello"), "b": ("open", "y")}


def test_admission(spark, tmp_path):
    spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "id string").write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("id string").parquet(str(tmp_path / "p"))
    assert rows(flows.drain(spark, flows.admit(stream, spark.createDataFrame([("b",)], "id string")), "admit")) == [("a",), ("c",)]
