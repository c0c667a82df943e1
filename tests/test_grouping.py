import random

from pyspark.sql import functions as F

from paperlens.operators import grouping as G

SCHEMA = "paper_id string, page_idx int, pos int, block_type string, x0 double, y0 double, x1 double, y1 double, desc string, caption_number string"


def block(box, caption=None, kind="image", desc=None, body=None, said=None):
    return G.Block(tuple(map(float, box)), tuple(map(float, body or box)), kind, desc or f"{kind} on page 1", caption, said, bool(said), (0,))


def page(spark, rows):
    made = [("p", 0, i, kind, *map(float, box), desc or f"{kind} on page 1", caption) for i, (caption, box, kind, desc) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA)


def test_figure_beside_a_table(spark):
    rows = [("T:3", (86, 70, 249, 209), "table", None), (None, (332, 69, 417, 144), "image", None), ("F:5", (416, 72, 534, 143), "image", None)]
    got = {r.caption_number: r for r in G.post_process(page(spark, rows)).collect()}
    assert got.keys() == {"T:3", "F:5"} and got["F:5"].x0 <= 333 and got["F:5"].x1 >= 534 and got["F:5"].parts == 2


def test_a_figure_in_the_gap_of_another(spark):
    rows = [(None, (106, 86, 287, 251), "image", None), (None, (323, 86, 504, 251), "image", None), ("F:12", (106, 317, 286, 486), "image", None), (None, (324, 317, 503, 486), "image", None), (None, (106, 506, 286, 675), "image", None), ("F:13", (325, 510, 503, 675), "image", None)]
    got = G.post_process(page(spark, rows)).collect()
    foreign = next(r for r in got if r.caption_number == "F:13")
    for r in got:
        if r.caption_number == "F:12":
            assert not (r.x0 <= foreign.x0 and r.y0 <= foreign.y0 and r.x1 >= foreign.x1 and r.y1 >= foreign.y1)


def test_rules():
    named = block((0, 0, 200, 100), "F:1", desc="Figure 1. x", said="F:1")
    below = block((0, 110, 50, 150))
    assert G.barrier(named, below) and not G.barrier(named, block((0, 110, 180, 150))) and not G.barrier(below, named)
    assert not G.barrier(named, block((0, 110, 50, 150), "F:1"))
    a, b = block((0, 0, 100, 100)), block((110, 0, 210, 100))
    assert G.belong(a, b, 600, 800) and not G.belong(block((0, 0, 100, 100), "F:1"), block((110, 0, 210, 100), "F:2"), 600, 800)
    assert not G.belong(block((0, 0, 100, 100), "F:1"), b, 600, 800, frozenset({"F:1"}))
    equation = block((10, 10, 50, 20), kind="interline_equation")
    assert G.belong(named, equation, 600, 800) and not G.belong(a, equation, 600, 800)
    assert G.neighbours(a, b, 600) and not G.neighbours(a, block((0, 400, 100, 500)), 600)
    assert not G.neighbours(a, block((0, 150, 300, 400), kind="table"), 600)


def test_together():
    a, b = block((0, 0, 10, 10)), block((5, 5, 30, 20), "F:2", desc="Figure 2. y", said="F:2")
    both = G.together(a, b)
    assert both.box == (0, 0, 30, 20) and both.caption == "F:2" and both.desc == "Figure 2. y"
    assert G.together(block((0, 0, 9, 9), desc="left"), block((0, 0, 9, 9), desc="right side")).desc == "left; right side"
    assert G.together(block((0, 0, 9, 9), kind="chart"), block((0, 0, 9, 9))).kind == "image"


def test_a_box_that_ran_over_a_caption():
    outer = block((0, 0, 200, 400), body=(0, 0, 200, 90))
    inner = block((20, 100, 180, 200), "F:3", desc="Figure 3. z", said="F:3")
    cut = G.clipped(outer, inner)
    assert cut.box == (0, 0, 200, 200) and cut.caption == "F:3"
    assert G.clipped(inner, outer) is None and G.clipped(block((0, 0, 200, 220), body=(0, 0, 200, 90)), inner) is None
    assert [b.box for b in G._repair([outer, inner])] == [(0, 0, 200, 200)]


def test_edges_apart_and_odd_pages(spark):
    rows = [("F:1", (60, 100, 290, 200), "image", "Figure 1. a"), (None, (300, 100, 530, 200), "image", None)]
    df = page(spark, rows)
    edges = spark.createDataFrame([("p", 0, 50.0, 540.0)], "paper_id string, page_idx int, x0 double, x1 double")
    one = G.post_process(df, edges=edges).collect()
    assert [(r.x0, r.x1, r.parts) for r in one] == [(50.0, 540.0, 2)]
    assert sorted(r.caption_number for r in G.post_process(df, apart=("F:1",)).collect()) == ["F:1", "F:1"]
    assert G.post_process(df.limit(0)).count() == 0
    nulls = df.withColumn("desc", F.lit(None).cast("string")).withColumn("caption_number", F.lit(None).cast("string"))
    assert G.post_process(nulls).count() >= 1


def test_every_block_is_in_one_figure():
    rng = random.Random(4)
    for _ in range(200):
        blocks = [block((x, y, x + rng.randrange(20, 200), y + rng.randrange(20, 150)), rng.choice((None, None, "F:1", "F:2")), rng.choice(("image", "chart", "table"))) for x, y in ((rng.randrange(400), rng.randrange(600)) for _ in range(rng.randrange(9)))]
        made = G.group_page(blocks)
        assert sorted(i for b in made for i in b.parts) == list(range(len(blocks)))


def test_captions_settled(spark):
    from paperlens.operators import layout

    rows = [("F:1", (0, 0, 90, 50), "table", "Figure 1"), ("T:1", (0, 60, 90, 100), "image", "Table 1"), ("F:2", (0, 110, 90, 150), "table", "Figure 2"), (None, (0, 400, 90, 450), "image", None), (None, (0, 160, 90, 200), "chart", None)]
    got = {r.pos: (r.caption_number, r.desc) for r in layout.settle_captions(page(spark, rows)).collect()}
    assert got == {0: ("T:1", "Table 1"), 1: ("F:1", "Figure 1"), 2: (None, "table on page 1"), 3: (None, "image on page 1"), 4: ("F:2", "Figure 2")}
    assert {r.caption_number for r in layout.settle_captions(page(spark, rows), apart=("F:2",)).where("pos = 2").collect()} == {"F:2"}


def test_captions_one_block_too_low(spark):
    from paperlens.operators import layout

    rows = [(None, (0, 0, 90, 50), "image", None), (None, (0, 80, 90, 130), "image", None), ("T:1", (0, 160, 90, 200), "table", "Table 1")]
    orphans = spark.createDataFrame([("p", 0, 0.0, 60.0, 90.0, 70.0, "Figure 1. a", "F:1"), ("p", 0, 0.0, 140.0, 90.0, 150.0, "Figure 2. b", "F:2")], "paper_id string, page_idx int, x0 double, y0 double, x1 double, y1 double, desc string, caption_number string")
    assert {r.pos: r.caption_number for r in layout.rebind_captions(page(spark, rows), orphans).collect()} == {0: "F:1", 1: "F:2", 2: "T:1"}
