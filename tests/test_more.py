"""Terms, drawings, snapshots, versions, what lies outside, and the plans of hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from paperlens.functions import svg, terms, text
from paperlens.operators import hierarchy, snapshots, tags, versions
from paperlens.session import work_dir
from paperlens.sources import external


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f(F.col("v")).alias("out")).collect()]


def test_terms(spark):
    words = {"large language model": "LLM", "large language models": "LLMs", "token": "Token", "fine tuning": "finetuning"}
    run = terms.normaliser(words)
    assert run("Large-language  models use TOKEN, `token`, $token$, ```\ntoken\n``` and tokens.") == ("LLMs use Token, `token`, $token$, ```\ntoken\n``` and tokens.", {"large language models": 1, "token": 1})
    assert run("x$$token\ntoken$$ large $a$ language model") == ("x$$token\ntoken$$ large $a$ language model", {})
    assert run("") == ("", {}) and run("nothing") == ("nothing", {})
    df = spark.createDataFrame([("a token",), (None,), ("Fine-tuning a token",)], "text string")
    assert {(r.term, r.n) for r in terms.term_counts(df, F.col("text"), words).collect()} == {("token", 2), ("fine tuning", 1)}


def test_drawings(spark):
    points = column(spark, ["M 10 20 H 30 V 5 l -1 -2 3 4 z", "M100 200h50v50H100Z", "10 20 30", "", None, "m 1 1 2 2 X 9 M -1.5 2"], svg.path_points)
    assert [p and [tuple(x) for x in p] for p in points] == [[(10, 20), (30, 20), (30, 5), (29, 3), (32, 7)], [(100, 200), (150, 200), (150, 250), (100, 250)], [(10, 20)], [], None, [(1, 1), (3, 3), (-1.5, 2)]]
    assert column(spark, ["matrix(1, 0,0,-1,0,100)", "matrix(1,2)", "rotate(3)", None], svg.matrix) == [[1, 0, 0, -1, 0, 100], None, None, None]
    assert column(spark, ["<svg></svg>", None], svg.clip_boxes) == [[], None]
    page = '<page mediabox="0 0 600 800"><fill_path transform="1 0 0 1 0 0">\n<m x="10" y="700"/>\n<l x="310" y="760"/>\n<l x="5"/>\n</fill_path><fill_path transform="1 0">\n<m x="1" y="1"/>\n</fill_path></page>'
    assert [[tuple(b) for b in x] for x in column(spark, [page], lambda c: svg.fill_boxes(c, F.lit(1)))] == [[(10, 40, 310, 100)]]


def quotes(s):
    out, inside, opened = [], False, False
    for ch in s:
        if ch in "<>":
            inside = ch == "<" or (inside and ch != ">")
        elif not inside and ch in "“”\"":
            opens = ch == "“" or ch == '"' and not opened
            ch, opened = ("「", True) if opens else ("」", False)
        out.append(ch)
    return "".join(out)


def test_quotes(spark):
    rng = random.Random(1)
    rows = ["".join(rng.choice('ab"“”<> \n中') for _ in range(rng.randrange(30))) for _ in range(300)] + ["", 'say "yes" and <a href="x">"no"</a>']
    got = column(spark, rows, text.convert_quotes)
    assert got == [quotes(r) for r in rows]
    assert column(spark, [None], text.convert_quotes) == [None]


def test_roots(spark):
    rng = random.Random(2)
    parent = {i: (None if rng.random() < 0.1 else rng.randrange(-3, 120)) for i in range(120)}
    parent |= {200: 201, 201: 202, 202: 200, 203: 200, 300: None} | {i: i - 1 for i in range(301, 360)}
    want = {}
    for node in parent:
        at, depth = node, 0
        while parent.get(at) is not None and depth <= len(parent):
            at, depth = parent[at], depth + 1
        if at in parent and parent[at] is None:
            want[node] = (at, depth)
    df = spark.createDataFrame([(*x, "x") for x in [*parent.items(), (300, None)]], "id long, parent_id long, root string")
    assert {r.id: (r.root, r.depth) for r in hierarchy.roots(df).collect()} == want
    assert hierarchy.roots(df.limit(0)).count() == 0


def test_snapshots(spark):
    lines = spark.createDataFrame([("[ERROR] x",), ("Training error",), ("2026 warn: y",), ("failed to read",), (" ERROR z",), ("",)], "value string")
    assert tuple(snapshots.log_marks(lines).first()) == (1, 2, 1)
    assert [r.value for r in snapshots.log_tail(lines.coalesce(1), 2).collect()] == [" ERROR z", ""]
    figs = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c")], "paper_id string, name string")
    sharp, plain = spark.createDataFrame([("p", "a", "s/a")], "paper_id string, name string, path string"), spark.createDataFrame([("p", "a", "j/a"), ("p", "b", "j/b")], "paper_id string, name string, path string")
    assert {(r.name, r.path, r.kind) for r in snapshots.figure_files(figs, sharp, plain).collect()} == {("a", "s/a", "sharp"), ("b", "j/b", "plain"), ("c", None, "none")}
    entries = spark.createDataFrame([], "paper_id string, idx int, caption string, page_idx int, x0 double, y0 double")
    assert snapshots.align(entries, entries).count() == 0


def test_files(spark, tmp_path):
    for name, body in (("p1/a.png", b"\x89PNG\r\n\x1a\nx"), ("p1/b.jpg", b"j"), ("p2/c.txt", b"t")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    (tmp_path / "list.txt").write_text("h1 figures/arxiv/p1/a.png\nbroken\nh2 figures/arxiv/p1/b.jpg\n")
    assert {(r.paper_id, r.hash) for r in snapshots.hash_list(spark, str(tmp_path / "list.txt")).collect()} == {("p1", "h1"), ("p1", "h2")}
    assert {r.paper_id for r in snapshots.image_hashes(spark, str(tmp_path)).collect()} == {"p1"}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    assert [r.url[:22] for r in external.data_urls(files).collect()] == ["data:image/png;base64,"]
    assert snapshots.latest_asset(files).first().version.isalnum()
    made = external.tool_output(files, lambda content: (1, content.decode("latin-1") * 2), least=3)
    assert {r.path.rsplit("/", 1)[-1]: r.text for r in made.collect()}["b.jpg"] is None
    now = files.where("path not like '%list.txt'").withColumn("content", F.when(F.col("path").endswith("b.jpg"), F.lit(b"new")).otherwise(F.col("content")))
    assert {(r.path.rsplit("/", 1)[-1], r.change) for r in external.file_changes(files, now).collect()} == {("list.txt", "gone"), ("b.jpg", "changed")}


def test_fetch(spark):
    calls = spark.sparkContext.accumulator(0)

    def get(key):
        calls.add(1)
        if key == "lost":
            raise OSError("lost")
        return {"ok": (200, "body"), "gone": (404, ""), "busy": (429, "")}[key]

    df = spark.createDataFrame([(k, k) for k in ("ok", "ok", "gone", "busy", "lost", None, "have")], "key string, body string")
    cache = spark.createDataFrame([("have", "kept")], "key string, body string")
    got = {r.key: (r.status, r.body, r.attempts) for r in external.fetch(df, get, attempts=3, pause=lambda s: None, cache=cache).collect()}
    assert got == {"ok": (200, "body", 1), "gone": (404, None, 1), "busy": (429, None, 3), "lost": (599, None, 3), "have": (200, "kept", 0)}
    assert [external.doubling(n, 500) for n in (1, 5, 9)] == [2.0, 32.0, 60.0] and external.by_status(2, 429) == 10.0 and external.by_status(2, 500) == 4.0

    def people(name):
        return 200, '{"data": [{"name": "Other", "hIndex": 1}, {"name": "ANA  Ruiz", "hIndex": 7, "citationCount": 9}]}'

    found = external.lookup_authors(spark.createDataFrame([("Ana Ruiz",), ("Nobody",)], "name string"), people, "name", text.normalize_name, pause=lambda s: None)
    assert {(r.name, r.h_index, r.citations) for r in found.collect()} == {("Ana Ruiz", 7, 9), ("Nobody", None, None)}


def test_jobs(spark):
    class Service:
        def create(self, key):
            if key == "bad":
                raise ValueError
            return key

        def poll(self, job):
            return {"slow": "pending", "wrong": "failed"}.get(job, "done")

        def download(self, job):
            return job * 2

    df = spark.createDataFrame([("a",), ("slow",), ("wrong",), ("bad",)], "key string")
    got = {r.key: (r.state, r.body, r.polls) for r in external.run_jobs(df, Service(), polls=4, pause=lambda s: None).collect()}
    assert got == {"a": ("done", "aa", 1), "slow": ("late", None, 4), "wrong": ("failed", None, 1), "bad": ("failed", None, 0)}


def test_conversations(spark):
    rows = [("k", 1, "user", "a"), ("k", 2, "user", "b"), ("k", 3, "assistant", "c"), ("k", 4, "user", "d"), ("l", 1, "assistant", "x")]
    talks = external.conversations(spark.createDataFrame(rows, "key string, at int, role string, content string"), "key", "at", "Be brief.")
    assert {r.key: [tuple(t) for t in r.turns] for r in talks.collect()} == {"k": [("system", "Be brief."), ("user", "a\n\nb"), ("assistant", "c"), ("user", "d")], "l": [("system", "Be brief."), ("assistant", "x")]}
    assert {(r.key, r.answer) for r in external.answers(talks, external.Echo(), "key").collect()} == {("k", "d"), ("l", "")}
    lines = [("a", 1, 'data: {"choices":[{"delta":{"content":"Hel"}}]}'), ("a", 2, 'data: {"choices":[{"delta":{"content":"lo"}}]}'), ("a", 3, "data: [DONE]"), ("b", 1, "event: x"), ("b", 2, 'data: {"type":"content_block_delta","delta":{"type":"text_delta","text":"Hi"}}'), ("b", 3, 'data: {"type":"error","error":{"message":"m"}}'), ("c", 1, "data: {}")]
    got = external.stream_deltas(spark.createDataFrame(lines, "key string, at int, value string"), "key", "at")
    assert {(r.key, r.text, r.failed) for r in got.collect()} == {("a", "Hello", False), ("b", "Hi", True), ("c", "", True)}
    assert {r.api_key for r in external.round_robin(spark.range(50), ["x", "y"], "id").collect()} == {"x", "y"}
    assert external.parse_request(external.to_json_lines(talks.where("key = 'l'"), "key").first().request) == [("system", "Be brief."), ("assistant", "x")]


def test_versions(spark):
    schema = "paper_id string, insight string, processed_at timestamp, review string, reviewed_at timestamp, checked_at timestamp"
    current = spark.createDataFrame([("a", "one", None, "r", None, None), ("b", "two", None, "", None, None), ("c", "__ANALYZING__", None, "", None, None)], schema).withColumn("checked_at", F.when(F.col("paper_id") == "b", F.current_timestamp()))
    none = spark.createDataFrame([], "paper_id string, insight string, processed_at timestamp, review string, reviewed_at timestamp, backup_at timestamp")
    at = F.to_timestamp(F.lit("2026-01-01"))
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("x",), ("a",)], "paper_id string")
    now, kept, outcome = versions.clear(current, none, ids, at)
    assert {r.paper_id: r.insight for r in now.collect()} == {"a": "", "b": "two", "c": ""}
    assert [(r.paper_id, r.insight) for r in kept.collect()] == [("a", "one")]
    assert {r.paper_id: r.status for r in outcome.collect()} == {"a": "cleared", "b": "refused", "c": "cleared", "x": "unknown"}
    back, more = versions.restore(now, kept, ids, at)
    assert {r.paper_id: r.insight for r in back.collect()} == {"a": "one", "b": "two", "c": ""} and more.count() == 2
    states = spark.createDataFrame([(1, "new"), (2, "new"), (3, "odd")], "id int, state string")
    events = spark.createDataFrame([(1, 1, "go"), (1, 2, "end"), (2, 1, "end"), (2, 2, "go")], "id int, at int, event string")
    done = versions.transitions(states, events, "id", "state", [("new", "go", "open"), ("open", "end", "shut")])
    assert {(r.id, r.state, r.ignored) for r in done.collect()} == {(1, "shut", 0), (2, "open", 1), (3, "odd", 0)}
    changed, written = versions.relaid(current, "paper_id", F.upper("insight"), False)
    assert changed.count() == 2 and written.count() == 0


def test_popular_tag_in_blocks(spark, data):
    from paperlens.catalog import Tables

    t = Tables(spark, data)
    of = t.papers.select(F.col("id").alias("paper_id"))
    assert sorted(map(tuple, tags.related(t, of, 3, block=3).collect())) == sorted(map(tuple, tags.related(t, of, 3).collect()))


def test_shared_folder_is_asked_for(spark):
    class Elsewhere:
        conf = spark.conf

        class sparkContext:  # noqa: N801
            master = "spark://somewhere"

            @staticmethod
            def getConf():
                return spark.sparkContext.getConf()

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(RuntimeError):
            work_dir(Elsewhere())


def test_cron():
    from datetime import datetime

    from paperlens.streaming.flows import next_run

    at = datetime(2026, 1, 31, 15, 59, 30)  # 23:59:30 in the zone
    assert next_run("0 8 * * *", at) == datetime(2026, 2, 1, 0, 0)
    assert next_run("0 0 8 * * *", at) == datetime(2026, 2, 1, 0, 0)
    assert next_run("*/15 * * * *", at) == datetime(2026, 1, 31, 16, 0)
    assert next_run("30 9-10 * * 1,3", at) == datetime(2026, 2, 2, 1, 30)
    assert next_run("0 0 29 2 *", at) == datetime(2028, 2, 28, 16, 0)
    assert next_run("0 0 1 * 0", at) == datetime(2026, 1, 31, 16, 0) and next_run("0 0 1 * 0", datetime(2026, 1, 31, 16, 0)) == datetime(2026, 2, 7, 16, 0)
    for bad in ("", "* * * *", "61 * * * *", "0 0 31 2 *", "x * * * *"):
        with pytest.raises(ValueError):
            next_run(bad, at)


def test_archives_are_bounded(spark, tmp_path):
    import zipfile

    from paperlens.sources import readers

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, body in (("x.md", "short"), ("y.json", "9" * 500), ("../z.md", "out"), ("p.png", "n")):
            z.writestr(name, body)
    (tmp_path / "b.zip").write_bytes(b"broken")
    got = {(r.archive.rsplit("/", 1)[-1], r.name, r.text) for r in readers.archives(spark, str(tmp_path), most=100).collect()}
    assert got == {("a.zip", "x.md", "short"), ("a.zip", "y.json", None), ("a.zip", "p.png", None), ("b.zip", None, None)}
    names = spark.createDataFrame([("c",), ("a",), ("b",)], "name string")
    assert [r.name for r in readers.listed(names, 1, 1).collect()] == ["b"]
    cached = spark.createDataFrame([("p", ["F:2", "F:1"]), ("q", None)], "paper_id string, split_figures array<string>")
    assert [r.paper_id for r in readers.configured(cached, ["F:1", "F:2"]).collect()] == ["p"] and [r.paper_id for r in readers.configured(cached, []).collect()] == ["q"]


def test_late_papers(spark, tmp_path):
    from paperlens.streaming import flows

    df = spark.createDataFrame([("a", "2026-01-01"), ("a", "2026-01-01"), ("b", "2026-01-02")], "id string, day string").withColumn("at", F.to_timestamp("day"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = flows.drain(spark, flows.admit(stream, spark.createDataFrame([("b",)], "id string"), at="at"), "late")
    assert [r.id for r in out.collect()] == ["a"]
