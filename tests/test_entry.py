"""The registered queries run, and give what their SQL gives."""

import glob
import importlib.util
import os
import shutil
import sys

import pytest


def _norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_norm, v))
    return v


def _core():
    from paperlens.plans import pages, relational, streams, texts, trees

    return {n: (f, m.oracle_sql().get(n)) for m in (relational, pages, streams, texts, trees) for n, f in m.queries().items()}


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(_core()))
def test_query(spark, data, duck, name):
    f, sql = _core()[name]
    df = f(spark, data)
    rows = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if sql is None:
        return
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    at, to = sorted(range(len(names)), key=lambda i: df.columns[i]), sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(repr(tuple(_norm(r[i]) for i in at)) for r in rows) == sorted(repr(tuple(_norm(r[i]) for i in to)) for r in want.fetchall())


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_" for n in (1,)} <= {name[:3] for name in entry.queries()}


def test_without_the_subpackage(tmp_path):
    """The rest imports where the subpackage llm isn't there, and nothing of it names that package."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(f"{root}/paperlens"):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(f"{folder}/{name}", encoding="utf-8") as f:
                    assert "paperlens.llm" not in f.read(), name
    shutil.copytree(f"{root}/paperlens", tmp_path / "paperlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    import subprocess

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('p2_') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
    assert done.stdout.split()[1] == "False"
    assert importlib.util.find_spec("paperlens") is not None
