"""The queries p2_ to p8_ on the smallest tables."""

import glob
import os

import pytest

from paperlens.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, data, name):
    df = q.queries()[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    columns = {
        "p2_found": ["tag_a", "tag_b"], "p3_found": ["name_a", "name_b"], "p4_found": ["field", "record_id"], "p5_found": ["id", "answer", "defect"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_a", "doc_b"],
    }
    if name in columns:
        assert df.columns == columns[name]
        if name != "p6_ids":
            assert len(rows) == len(set(rows))
        if name in ("p2_found", "p3_found", "p8_found"):
            assert all(a < b for a, b in rows)
    if name == "p5_found":
        assert {r[2] for r in rows} <= {"empty", "truncated", "refusal", "copy", "language"} and len({r[:2] for r in rows}) == len(rows)
    sql = q.oracle_sql().get(name)
    if sql:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for path in glob.glob(f"{data}/*.parquet"):
            con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        order = [names.index(c) for c in df.columns]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_empty_tables(spark, data, tmp_path):
    for path in glob.glob(f"{data}/*.parquet"):
        df = spark.read.parquet(path)
        fixed = os.path.basename(path) in ("context_windows.parquet", "name_forms.parquet", "user_tag_preferences.parquet")
        (df if fixed else df.limit(0)).write.parquet(str(tmp_path / os.path.basename(path)))
    for name, f in q.queries().items():
        assert f(spark, str(tmp_path)).count() == 0, name
