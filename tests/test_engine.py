import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheaf.operators import catalog, retrieve, snapshot
from sheaf.plans.registry import ORACLE_SQL, QUERIES
from sheaf.streaming import audit

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    plain = lambda v: "" if pd.isna(v) else repr(round(float(v), 9)) if isinstance(v, (int, float)) else str(v)
    return sorted(tuple(map(plain, r)) for r in df.astype("object").values.tolist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, duck, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        expected = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows(found) == rows(expected)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


FILES = [("s", "s/a.md", "one\ntwo needle\nthree\n", 1), ("s", "s/b.md", "Needle needle\n", 2), ("t", "t/needle.md", "x", 3), ("u", "u/empty.md", "", 4)]
SCHEMA = "source string, path string, content string, ord long"


def test_retrieval(spark):
    df = spark.createDataFrame(FILES, SCHEMA)
    assert [(r.path, r.ln) for r in retrieve.grep(df, "needle").collect()] == [("s/a.md", 2), ("s/b.md", 1)]
    assert [(r.ln, r.hit) for r in retrieve.grep(df.where("path = 's/a.md'"), "needle", context=1).collect()] == [(1, False), (2, True), (3, False)]
    assert retrieve.format_matches(retrieve.grep(df, "needle"), "needle").where("path = 's/b.md'").first().text == "s/b.md\n  1: **Needle** **needle**"
    assert [(r.path, r["rank"]) for r in retrieve.search_files(df, "needle").collect()] == [("t/needle.md", 0), ("s/a.md", 1), ("s/b.md", 1)]
    assert [r.path for r in retrieve.find(df, "*.md", "s").collect()] == ["s/a.md", "s/b.md"]
    assert [r.line for r in retrieve.read(df, "s/a.md", 1, 2).collect()] == ["two needle"]
    assert [r.ln for r in retrieve.read(df, "s/a.md", offset=-3).orderBy("ln").collect()] == [1, 2, 3]
    assert retrieve.count_matches(df, "needle").first().n_lines == 2
    assert {r.source: r.n_files for r in retrieve.sources_total(df).collect()}[None] == 4
    assert retrieve.search(spark.createDataFrame([], "path string, title string, summary string"), df, "zzz").count() == 0


def test_snapshots(spark, tmp_path):
    old, new = spark.createDataFrame([("s", "a", "1", 1), ("s", "b", "1", 1), ("s", "c", "1", 1)], SCHEMA), spark.createDataFrame([("s", "a", "1", 1), ("s", "b", "2", 1), ("s", "d", "1", 1), ("s", "d", "2", 2)], SCHEMA)
    new = snapshot.last_write_wins(new)
    assert snapshot.diff(new, old).first()[1:] == (1, 1, 1, 1)
    assert [r.path for r in snapshot.orphans(new, old).collect()] == ["c"]
    path = str(tmp_path / "snap")
    assert snapshot.load_snapshot(spark, path, old.schema).count() == 0
    snapshot.write_snapshot(old.unionByName(spark.createDataFrame([("t", "x", "1", 1)], SCHEMA)), path)
    snapshot.write_snapshot(new.select("source", "path", "content", "ord"), path)
    assert {(r.source, r.path) for r in snapshot.load_snapshot(spark, path, old.schema).collect()} == {("s", "a"), ("s", "b"), ("s", "d"), ("t", "x")}


def test_guards_and_freshness(spark):
    df = spark.createDataFrame([("s", "a", "", 1)] * 3 + [("t", "a", "", 1)], SCHEMA)
    stamps = spark.createDataFrame([("s", 10)], "source string, file_count long")
    assert {r.source: r.ok for r in snapshot.regressions(df, stamps).collect()} == {"s": False, "t": True}
    assert all(r.ok for r in snapshot.regressions(df, stamps, share=0).collect())
    shas = spark.createDataFrame([("a" * 40, "a" * 40), ("a" * 9, "a" * 40), ("b" * 9, "a" * 40), (None, "a" * 40)], "s string, r string")
    assert [r.x for r in shas.select(snapshot.git_fresh(F.col("s"), F.col("r")).alias("x")).collect()] == [True, True, False, False]
    heads = spark.createDataFrame([(True, "e", "e", "x", "y"), (True, "e", "f", "x", "x"), (True, None, "f", "x", "x"), (True, None, None, None, "x"), (False, "e", "e", None, None)], "ok boolean, a string, b string, c string, d string")
    assert [r.x for r in heads.select(snapshot.http_fresh(*(F.col(c) for c in ("ok", "a", "b", "c", "d"))).alias("x")).collect()] == [True, False, True, False, False]


def test_catalogue(spark):
    rows = spark.createDataFrame([("a", "https://h", "http"), ("a", "", "git"), (" ", "u", "ftp")], "name string, url string, type string")
    assert catalog.invalid_sources(rows).count() == 3
    assert catalog.invalid_files(spark.createDataFrame([("/a",), (" ",), ("b",)], "path string")).count() == 2
    found = json.loads(catalog.sources_json(spark.createDataFrame([("b-api",), ("a",), ("a",), ("_x",)], "source string")).first().json)
    assert found == {"docs": [{"name": "a", "count": 2}], "api": [{"name": "b-api", "count": 1}]}


def test_audit_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    lines = [{"ts": f"2024-01-01T00:{m:02d}:00Z", "type": "exec", "client": "c", "cmd": "ls", "exit": 0, "dur_s": 1, "cached": m % 2 == 0} for m in (1, 2, 7, 40)]
    (log / "a.json").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    events = audit.read_log(spark, str(log))
    assert events.count() == 4
    assert audit.windows(events).where("n = 2").first().n_cached == 1
    audit.start_windows(spark, str(log), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    # the last window is still open: its end is not behind the watermark
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
