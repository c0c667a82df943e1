import pytest
from pyspark.sql import functions as F

from paperlens.functions import markdown, text


def each(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", function(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows)]


def test_normalize(spark):
    cases = {
        "Qwen Team (Alibaba Group)完成了": "Qwen Team (Alibaba Group) 完成了", "foo (bar) baz": "foo (bar) baz", "a\r\n\r\n\r\nb": "a\n\nb", "　 模型GPT4好 ": "模型 GPT4 好", "": "", "中a中": "中 a 中", "中文x": "中文 x",
    }
    assert each(spark, text.normalize_text, [*cases, None]) == [*cases.values(), None]
    once = each(spark, text.normalize_text, list(cases))
    assert each(spark, text.normalize_text, once) == once


def test_quotes(spark):
    cases = {'"compute-optimal"': "「compute-optimal」", "“x”": "「x」", '称"计算最优"策略': "称「计算最优」策略", '<div style="text-align:right">"a"': '<div style="text-align:right">「a」', None: None, '"open': "「open"}
    assert each(spark, text.convert_quotes, list(cases)) == list(cases.values())


def test_model_output(spark):
    out = "<think>hm</think>Tags:\n- 标签: 8.0\n* b c: 12\n- none: 0\n- d: 1\n- e: 2\n- f: 3\n- g: 4\nScore: 2.5/5.0\nType: 研究 \nSummary:\nText here.\n"
    assert each(spark, text.parse_score, [out, "Score: 9.5", "none", None]) == [2.5, 8.0, None, None]
    assert each(spark, text.parse_type, [out, ""]) == ["研究", None]
    assert each(spark, text.parse_summary, [out]) == ["Text here."]
    assert [(t.tag, t.weight) for t in each(spark, text.parse_tags, [out])[0]] == [("标签", 8.0), ("b c", 10.0), ("d", 1.0), ("e", 2.0), ("f", 3.0)]
    assert each(spark, text.strip_think, ["<thinking>a\nb</thinking> c"]) == ["c"]
    assert each(spark, text.parse_qualified, ["x\nQUALIFIED: false\nQUALIFIED: true", "QUALIFIED: false", "x"]) == [True, False, True]
    assert each(spark, text.strip_qualified, ["x\nQUALIFIED: true\nQUALIFIED: false"]) == ["x"]
    call = '{"tool_calls":[{"function":{"name":"other","arguments":"{}"}},{"function":{"name":"edit_text","arguments":"{\\"old_text\\":\\"a\\",\\"new_text\\":\\"b\\"}"}}]}'
    assert tuple(each(spark, text.tool_edit, [call])[0]) == ("a", "b")


@pytest.mark.parametrize("caption, number", [
    ("Figure 5. A deeper...", "F:5"), ("Fig. 5. Something", "F:5"), ("Figure 5(a). Left", "F:5"), ("Figure 2.1: Our proposed...", "F:2.1"), ("Fig. 3.4 caption", "F:3.4"), ("Table 4.2: Results", "T:4.2"),
    ("Figure B.1: x", "F:B.1"), ("Figure b.1: lower", "F:B.1"), ("Table A.1: x", "T:A.1"), ("Figure I. Roman", "F:I"), ("Table 7. Results", "T:7"), ("Tbl. 2. Data", "T:2"), ("image on page 6", None), ("", None), ("cigure 5: x", "F:5"), ("Fig._9 x", "F:9"),
])
def test_caption_numbers(spark, caption, number):
    assert each(spark, text.caption_number, [caption]) == [number]


def test_caption_forms(spark):
    assert each(spark, text.looks_like_caption, ["(a) x", "Figure 1", "table2 x", "future work 3", "cigure 5:", "cigure five", "The text"]) == [True, True, True, False, True, False, False]
    assert each(spark, text.looks_like_caption_header, ["Table 2 evaluates whether", "Table 2: x", "Fig. 5 A panel", "Figure IV. x", "Text 1: x"]) == [False, True, True, True, False]
    assert each(spark, text.structure_label, ["[USER] hi", "The user experience", "SYSTEM: x", "Demonstrations follow"]) == [True, False, True, True]
    assert each(spark, text.numbered_label, ["1. Baseline (AdaLoRA):", "3. Output format", "x 1. y"]) == [True, True, False]


def test_scores(spark):
    assert each(spark, text.intro_score, ["1 Introduction", "An introduction to...", "Related work section", "Random title"]) == [1.0, 0.6, 0.45, 0.0]
    assert each(spark, text.conclusion_score, ["5 Conclusions", "In conclusion", "A brief summary"]) == [1.0, 0.6, 0.45]


def test_sections(spark):
    paper = "A Title\nAuthors\n\nAbstract\n\nWe do.\n\n1 Introduction\n\nWhy we do.\n\n2 Methods\n\nHow.\n\n5 Conclusion\n\nDone.\n\nReferences\n\n[1] X"
    s = each(spark, text.sections, [paper, "one\n\ntwo", "", None])
    assert s[0].intro == "1 Introduction\n\nWhy we do." and s[0].conclusion == "5 Conclusion\n\nDone." and s[0].header == "A Title\nAuthors\n"
    assert s[1].intro == "one" and s[1].conclusion == "two" and s[2].intro == "" and s[3].intro is None


def test_queries_and_templates(spark):
    assert text.search_query("cat:cs.AI", [], []) == "(cat:cs.AI)" and text.search_query("", ["cs.AI", "cs.CL"], []) == "cat:(cs.AI OR cs.CL)"
    assert text.search_query("", [], ["transformer", "large language model"]) == '(all:transformer OR all:"large language model")' and text.search_query("", [], []) == ""
    assert each(spark, lambda c: text.render_template(c, {"a": "1"}), ["{a} {b}"]) == ["1 {b}"]
    assert each(spark, text.prompt_sections, ["[SYSTEM]\nBe kind.\n\n[USER]\nHello {x}\n"]) == [{"SYSTEM": "Be kind.", "USER": "Hello {x}"}]
    assert each(spark, text.clean_history, ["@AGENT  hi", "hi @AGENT"]) == ["hi", "hi @AGENT"]
    assert each(spark, lambda c: text.split_csv(c), ["a, b,,c "]) == [["a", "b", "c"]]
    assert each(spark, text.normalize_name, ["Dr. Émile  O'Neil-3"]) == ["dr émile oneil"]
    assert each(spark, text.normalize_heading, ["# Title\nx", "## no"]) == ["> Title\nx", "## no"]


def test_images(spark):
    got = each(spark, markdown.images, ["x ![desc](figure/foo.png =80% center) y ![](http://a/b.png)"])[0]
    assert [tuple(i) for i in got] == [("![desc](figure/foo.png =80% center)", "desc", "figure/foo.png", "80%", "center"), ("![](http://a/b.png)", "", "http://a/b.png", None, None)]
    assert markdown.rebuild_image("desc", "figure/foo.png", "50%", "right") == "![desc](figure/foo.png =50% right)"
    assert each(spark, markdown.is_formatted, ["![a](figure/1 =50%)", "![a](figure/1)", "![a](https://x =50%)", ""]) == [True, False, False, False]
    sizes = {"a": [300, 200], "b": [300, 200], "w": [4000, 100], "c": [2500, 2000]}
    assert markdown.relayout_text("![](a) ![](b) ![](w) ![](a) ![](c) ![](?)", sizes) == "![](a =50% right) ![](b =50% center) ![](w) ![](a =50% right) ![](c =95% center) ![](?)"


def test_headings_and_html(spark):
    md = "# A\n\n## B\n\ntext **bold** `x<y` $a_1$ and $$b$$\n\n### C\n\n## D\n\n- one\n- two\n\n| h | i |\n|---|---|\n| 1 | <b> |\n\n```py\n# no heading\n```\n\n[link](javascript:x) [ok](https://a.b)"
    assert [(h.level, h.text, h.num) for h in each(spark, markdown.headings, [md])[0]] == [(1, "A", "1"), (2, "B", "1.1"), (3, "C", "1.1.1"), (2, "D", "1.2")]
    html, toc = markdown.render_html(md)
    assert [t[3] for t in toc] == ["1", "1.1", "1.1.1", "1.2"]
    for piece in ("<strong>bold</strong>", "<code>x&lt;y</code>", "<li>one</li>", "<th>h</th>", "<td>&lt;b&gt;</td>", 'class="language-py"', '<a href="https://a.b">ok</a>', "\\(a_1\\)", "\\[b\\]"):
        assert piece in html
    assert "javascript" not in html and "# no heading" in html
    assert each(spark, markdown.render, [None, ""])[0].html is None


def test_edits(spark):
    df = spark.createDataFrame([("a  b c", "a b", "X"), ("aa", "a", "X"), ("abc", "z", "X"), (None, "a", "b"), ("x", "", "y")], "t string, o string, n string")
    got = [(r.e.status, r.e.text) for r in df.select(markdown.apply_edit("t", "o", "n").alias("e")).collect()]
    assert got == [("applied", "X c"), ("ambiguous", "aa"), ("missing", "abc"), ("missing", None), ("missing", "x")]


def test_caption_number_anywhere_in_a_document(spark, tmp_path):
    from paperlens.plans.texts import queries

    spark.createDataFrame([(1, "word " * 200 + "see Table 7."), (2, "no number " * 50), (3, "Figure 2: x")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.number for r in queries()["t23_caption_kinds"](spark, str(tmp_path)).collect()} == {1: "T:7", 2: None, 3: "F:2"}
