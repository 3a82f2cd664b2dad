"""What a run keeps: stamps through failures, the index as text, the audit log, listed URLs; converters and roots."""

import pytest
from pyspark.sql import functions as F

from sheaf.functions import normalise as N
from sheaf.operators import catalog, discover, index, snapshot
from sheaf.streaming import audit


def stamps(spark, **counts):
    return spark.createDataFrame([(s, None, None, None, None, n) for s, n in counts.items()], snapshot.STAMPS)


def kept(spark, path):
    return {r.source: r.file_count for r in snapshot.load_stamps(spark, path).collect()}


class Stop(Exception):
    pass


@pytest.mark.parametrize("at", ["write", "clear", "aside", "rename", "done"])
def test_stamps_survive_a_failure_at_any_step(spark, tmp_path, at):
    path = str(tmp_path / "stamps")
    assert kept(spark, path) == {}
    for n in (1, 2):
        snapshot.write_stamps(stamps(spark, a=n, b=9), path)
        assert kept(spark, path) == {"a": n, "b": 9}

    def step(name):
        if name == at:
            raise Stop

    with pytest.raises(Stop):
        snapshot.write_stamps(stamps(spark, a=3), path, step)
    assert kept(spark, path) == ({"a": 3} if at == "done" else {"a": 2, "b": 9})
    # a new set that is made from what is there
    snapshot.write_stamps(snapshot.merged_stamps(snapshot.load_stamps(spark, path), stamps(spark, c=4), spark.createDataFrame([("c", "ok")], "source string, status string")), path)
    assert kept(spark, path)["c"] == 4 and kept(spark, path)["a"] in (2, 3)


def test_the_index_as_text(spark, tmp_path):
    rows = [("b/2.md", 'say "x"', ""), ("a/1.md", "é", "two words"), ("c.md", "", "")]
    index.write_index(spark.createDataFrame(rows, "path string, title string, summary string"), str(tmp_path / "i"))
    lines = [x.value for x in spark.read.text(str(tmp_path / "i")).collect()]
    assert sorted(lines) == ["\t".join(r) for r in sorted(rows)]


def test_the_audit_log_is_appended_to(spark, tmp_path):
    path = str(tmp_path / "log")
    events = spark.createDataFrame([("2024-01-01 00:00:00", "read", "c1", "cat", 0, 3, True), ("2024-01-01 00:01:00", "grep", None, "rg", 1, None, None)], "ts string, type string, client string, cmd string, exit int, dur_s long, cached boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    for n in (2, 4):
        audit.append_log(events.withColumn("more", F.lit("left out")), path)
        assert audit.read_log(spark, path).count() == n
    assert {(r.type, r.n, r.n_clients) for r in audit.summarise(audit.read_log(spark, path)).collect()} == {("read", 2, 1), ("grep", 2, 0)}


def test_listed_urls(spark):
    rows = [("a", "https://a", ["https://a/1", "https://a/2", "https://a/1"]), ("b", "https://b", []), ("c", "https://c", None), (None, None, None)]
    found = discover.explicit(spark.createDataFrame(rows, "source string, url string, urls array<string>")).collect()
    assert sorted((str(r.source), str(r.url), r.ord) for r in found) == [("None", "None", 0), ("a", "https://a/1", 0), ("a", "https://a/2", 1), ("b", "https://b", 0), ("c", "https://c", 0)]


def test_a_converter_of_ones_own(spark):
    shout = N.Converter("shout", ("loud",), ("txt", "mdx"), lambda t: F.when(t != "no", F.upper(t)), r"\.txt\z")
    rows = [("s", None, "a.txt", "hey", 1), ("s", "loud", "b.md", "hey", 1), ("s", "html", "c.txt", "<p>hey</p>", 1), ("s", None, "d.txt", "no", 1), ("s", None, "e.mdx", "hey", 1)]
    df = spark.createDataFrame(rows, "source string, format string, path string, content string, ord long")
    got = {r.path: r.content for r in N.normalise(df, (shout, *N.CONVERTERS)).collect()}
    assert got == {"a.md": "HEY", "b.md": "HEY", "c.txt": "hey", "d.txt": "no", "e.mdx": "HEY"}


def test_a_refused_page_keeps_its_text_and_name(spark):
    long = "<html><body>" + "<script>x</script>" * 200 + "<p>.</p></body></html>"
    rows = [("s", None, "a.html", long, 1), ("s", "html", "b", "<head><title>T</title></head><p>Text</p>", 1)]
    got = {r.path: r.content for r in N.normalise(spark.createDataFrame(rows, "source string, format string, path string, content string, ord long")).collect()}
    assert got["a.html"] == long and got["b"] == "# T\n\nText"


def test_roots_and_versions(spark):
    f = lambda rows: spark.createDataFrame(rows, "source string, path string, content string")
    got = catalog.of_roots({"x": f([("s", "p", "1"), ("s", "q", "2"), ("t", "p", "3")]), "y": f([("s", "p", "4"), ("s", "p", "5")]), "z": f([("u", "p", None)])}).collect()
    assert sorted((r.source, r.path, str(r.content), r.root) for r in got) == [("s", "p", "4", "y"), ("s", "p", "5", "y"), ("s", "q", "2", "x"), ("t", "p", "3", "x"), ("u", "p", "None", "z")]
    specs = spark.createDataFrame([("a", "1", "x"), ("a", "2", "z"), ("a", "2", "y"), ("a", None, "w"), ("b", None, "2"), ("b", None, "1"), (None, "1", "n")], "service string, version string, path string")
    assert sorted(map(str, map(tuple, catalog.latest_versions(specs).collect()))) == sorted(map(str, [("a", "2", "y"), ("b", None, "1"), (None, "1", "n")]))


def test_a_catalogue_is_loaded_with_its_types(spark, tmp_path):
    import json

    rows = [{"name": "a", "type": "git", "url": "https://a", "paths": ["docs"], "tags": ["x"]}, {"name": "b", "url": "https://b", "urls": ["https://b/1"]}, {"name": "c", "url": " "}, {"name": "d", "url": "https://d", "type": "ftp"}, {"name": "e", "url": "u"}, {"name": "e", "url": "v"}, {"url": "https://n"}]
    for k, text in enumerate((json.dumps(rows), "\n".join(map(json.dumps, rows)))):
        (tmp_path / str(k)).mkdir()
        path = tmp_path / str(k) / "sources.json"
        path.write_text(text)
        if k:  # an object on each line
            [(tmp_path / str(k) / f"{i}.json").write_text(json.dumps(r)) for i, r in enumerate(rows)]
            path.unlink()
        sources, problems = catalog.load_sources(spark, str(tmp_path / str(k)))
        found = {r.name: (r.type, r.paths, r.urls, r.discovery) for r in sources.collect()}
        assert found == {"a": ("git", ["docs"], [], "none"), "b": ("http", [], ["https://b/1"], None)}
        assert sorted((str(r.name), tuple(r.problems)) for r in problems.collect()) == [("None", ("blank name",)), ("c", ("blank url",)), ("d", ("unknown type",)), ("e", ("name is taken",)), ("e", ("name is taken",))]
