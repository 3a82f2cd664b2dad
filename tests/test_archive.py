"""Archives and folders as data sources: equal to plain unpacking, read by several tasks, with filters pushed down."""

import io
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from sheaf.sources import archive, files


@pytest.fixture(scope="module")
def pushed(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def pack(path, entries, mode="w"):
    with tarfile.open(path, mode) as tar:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
                tar.addfile(info)
            else:
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))


def entries(seed, n=60):
    rng = random.Random(seed)
    out = [("root", None), ("root/docs", None)]
    for i in range(n):
        name = f"root/docs/{rng.choice(['a', 'b c', 'é' * 40, 'd' * 120])}/f{i}.{rng.choice(['md', 'mdx', 'html', 'json'])}"
        out.append((name, rng.randbytes(rng.choice([0, 5, 3000])).hex().encode()))
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w") as tar:  # an archive within the archive has headers of its own
        info = tarfile.TarInfo("fake/inside.md")
        info.size = 4
        tar.addfile(info, io.BytesIO(b"fake"))
    return [*out, ("root/nested.md", inner.getvalue()), ("root/LICENSE", b"no"), ("root/docs/bad.md", b"\xff\xfe ok"), ("./root/dot.md", b"dot"), ("root/twice.md", b"first"), ("root/twice.md", b"last")]


def unpacked(found, extensions):
    want = {}
    for name, data in found:
        if data is not None and name.rsplit("/", 1)[-1] not in files.SKIPPED_NAMES and (extensions is None or name.rsplit("/")[-1].rsplit(".")[-1] in extensions):
            want[name.removeprefix("./").removeprefix("root/")] = data.decode("utf-8", "replace")
    return want


@pytest.mark.parametrize("mode", ["w", "w:gz", "w:bz2"])
@pytest.mark.parametrize("extensions", [("md", "mdx"), None])
def test_archives_give_what_unpacking_gives(spark, pushed, tmp_path, mode, extensions):
    pack(tmp_path / "one.tar", entries(1), mode)
    found = archive.read_archives(spark, str(tmp_path), "s", extensions, share=20_000)
    rows = {r.path: r.content for r in found.collect()}
    assert rows == unpacked(entries(1), extensions) and found.count() == len(rows)


def test_one_archive_is_read_by_several_tasks(spark, pushed, tmp_path):
    pack(tmp_path / "big.tar", [(f"root/f{i:03}.md", b"x" * 20_000) for i in range(200)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = archive.read_archives(spark, str(tmp_path / "big.tar"), "s", share=500_000).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 200


def test_filters_are_pushed_down(spark, pushed, tmp_path):
    pack(tmp_path / "one.tar", entries(2))
    rows = archive.members(spark, str(tmp_path)).where("path LIKE 'root/docs/a/%' AND extension IN ('md', 'html') AND size > 0")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0].replace("(size", "").replace("Filter", "", 1), plan  # only the size is tested above the scan
    want = {n for n, d in entries(2) if d and n.startswith("root/docs/a/") and n.rsplit(".", 1)[-1] in ("md", "html")}
    assert {r.path for r in rows.collect()} == want
    reader = archive.FileReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert list(reader.pushFilters([EqualTo(("extension",), "tar"), GreaterThan(("path",), "x")])) == [GreaterThan(("path",), "x")] and len(reader.partitions()[0].paths) == 1


def test_folders(spark, pushed, tmp_path):
    want = {}
    for name, text in [("a.md", "A"), ("sub/b.mdx", "é"), ("sub/deep/c d.md", ""), ("x.txt", "no"), ("LICENSE.md", "no")]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
        if not name.startswith(("x", "L")):
            want[name] = text
    assert {r.path: r.content for r in archive.scan_files(spark, str(tmp_path), "s").collect()} == want
    # Spark's text source has no row for an empty file
    assert {p: t for p, t in want.items() if t} == {r.path: r.content for r in files.scan_directory(spark, str(tmp_path), "s").collect()}
    assert {r.path for r in archive.scan_files(spark, f"file://{tmp_path}", "s", None).collect()} == {*want, "x.txt"}
    spark.read.format("document_files").option("path", str(tmp_path)).option("share", "1").load().count()
