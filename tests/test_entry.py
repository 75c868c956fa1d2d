"""The driver's contract; it must hold without the text subpackage too."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

DATA = Path("/root/testdata/sf0.001")


def test_every_detection_query_has_sql():
    names = [q for q in __spark_entry__.queries() if q.startswith("q_")]
    assert len(names) > 40 and set(names) <= set(__spark_entry__.oracle_sql())


def test_works_without_the_text_subpackage(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        part = p.relative_to(root)
        if "llm" not in part.parts and part.name != "corpus_pipeline.py":
            (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / part).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith(('op', 'pipeline'))]; assert e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_detection_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in (q for q in queries if q.startswith("q_")):
        got, want = queries[name](spark, str(DATA)), con.sql(sql[name])
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns, name
        rows = sorted(map(repr, got.select(*columns).toPandas().astype(object).values.tolist()))
        assert rows == sorted(map(repr, want.df()[columns].astype(object).values.tolist())), name
    assert __spark_entry__.entry(spark).schema == queries["q_events"](spark, str(DATA)).schema
    assert queries["q_events"](spark, str(DATA)).count() == 3
