"""Versioned snapshots and the incremental index: failures at every step, concurrent writers, and random changes against a rebuild."""

import random

import pytest
from pyspark.sql import functions as F

from sheaf.operators import catalog, index, publish, snapshot
from sheaf.sources.versioned import Conflict, VersionedTable

REMOTE = "source string, etag string, last_modified string, head_sha string"
T0 = 1_700_000_000


def frame(spark, files):
    return spark.createDataFrame([(p.split("/")[0], p, t) for p, t in files.items()], publish.FILES)


def remote(spark, *sources):
    return spark.createDataFrame([(s, f"e-{s}", None, None) for s in sources], REMOTE)


def state(store):
    return sorted(map(tuple, store.files().collect())), sorted((r.source, r.file_count, r.etag) for r in store.stamps().collect())


def test_a_run_takes_effect_as_a_whole(spark, tmp_path):
    store = publish.Snapshots(spark, str(tmp_path / "s"))
    assert state(store) == ([], [])
    first = {f"a/{i}.md": f"text {i}" for i in range(6)} | {"b/x.md": "b", "c d/é.md": "c"}
    report = {r.source: (r.status, r.added, r.modified, r.removed, r.unchanged) for r in store.update(frame(spark, first), remote(spark, "a", "b"), F.timestamp_seconds(F.lit(T0))).collect()}
    assert report == {"a": ("ok", 6, 0, 0, 0), "b": ("ok", 1, 0, 0, 0), "c d": ("ok", 1, 0, 0, 0)}
    assert state(store) == (sorted((p.split("/")[0], p, t) for p, t in first.items()), [("a", 6, "e-a"), ("b", 1, "e-b"), ("c d", 1, None)])
    # a loses more than half and is refused; b changes; c d is not in the run; d is new; e couldn't be read
    second = {"a/0.md": "text 0", "b/x.md": "b2", "b/y.md": "", "d/z.md": None}
    failed = spark.createDataFrame([("e", "timed out")], "source string, error string")
    rows = store.update(frame(spark, second), remote(spark, "b", "d"), F.timestamp_seconds(F.lit(T0)), failed=failed).collect()
    assert {r.source: (r.status, r.added, r.modified, r.removed, r.unchanged) for r in rows} == {"a": ("error", 0, 0, 0, 0), "b": ("ok", 1, 1, 0, 0), "d": ("ok", 1, 0, 0, 0), "e": ("error", 0, 0, 0, 0)}
    assert {r.source: r.error for r in rows if r.error} == {"a": "regression: 1 files after 6", "e": "timed out"}
    now = {k: v for k, v in first.items() if k[0] in "ac"} | {k: v for k, v in second.items() if k[0] in "bd"}
    assert state(store) == (sorted(((p.split("/")[0], p, t) for p, t in now.items()), key=str), [("a", 6, "e-a"), ("b", 2, "e-b"), ("c d", 1, None), ("d", 1, "e-d")])
    # the version before is still there
    assert store.files(1).count() == 8 and store.stamps(1).count() == 3


class Stop(Exception):
    pass


@pytest.mark.parametrize("at", ["data", "state", "manifest", "rename"])
def test_a_failure_at_any_step_leaves_the_former_snapshot(spark, tmp_path, at):
    store = publish.Snapshots(spark, str(tmp_path / "s"))
    store.update(frame(spark, {"a/1.md": "one", "b/1.md": "b"}), remote(spark, "a", "b"), F.timestamp_seconds(F.lit(T0))).count()
    before = state(store)

    def step(name):
        if name == at:
            raise Stop

    with pytest.raises(Stop):
        store.update(frame(spark, {"a/1.md": "other", "a/2.md": "two"}), remote(spark, "a"), F.timestamp_seconds(F.lit(T0)), step=step)
    assert state(store) == before and store.table.versions() == [1]
    # the next run goes on from there, and what was left can be removed
    store.update(frame(spark, {"a/1.md": "other", "a/2.md": "two"}), remote(spark, "a"), F.timestamp_seconds(F.lit(T0))).count()
    after = state(store)
    assert [t for _, p, t in after[0] if p.startswith("a/")] == ["other", "two"]
    gone = store.table.vacuum(keep=1)
    assert state(store) == after and gone and store.table.versions() == store.table.versions()[-1:]


def test_of_two_writers_one_fails(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "source", publish.FILES)
    table.commit(frame(spark, {"a/1.md": "one"}))

    def other(name):
        if name == "rename":
            VersionedTable(spark, table.root, "source", publish.FILES).commit(frame(spark, {"b/1.md": "other"}))

    with pytest.raises(Conflict):
        table.commit(frame(spark, {"a/1.md": "late"}), step=other)
    assert sorted(r.content for r in table.read().collect()) == ["one", "other"]
    with pytest.raises(Exception, match="null or empty"):
        table.commit(spark.createDataFrame([(None, "p", "t")], publish.FILES))
    assert table.read(keys=["b"]).count() == 1 and "source=a" not in str(table.read(keys=["b"]).inputFiles())


def text_of(rng, i):
    return rng.choice(["", f"# Topic {i}\n\nSome words here\n", f"---\ntitle: T{i}\n---\nBody text of it\n", f"plain {i}\n"])


def test_random_changes_against_a_rebuild(spark, tmp_path):
    rng = random.Random(7)
    files = {f"s{i % 4}/f{i}{rng.choice(['.md', '.md', '.html'])}": text_of(rng, i) for i in range(60)}
    store = publish.IndexStore(spark, str(tmp_path / "i"), buckets=8)
    store.build(frame(spark, files))
    rebuilt = lambda: sorted(map(tuple, index.build_index(frame(spark, files)).collect()))
    assert sorted(map(tuple, store.rows().collect())) == rebuilt()
    health = lambda: catalog.health(frame(spark, files), index.build_index(frame(spark, files))).select("n_md", "n_html", "n_indexed", "n_titled", "n_untitled")
    counts = health()
    for turn in range(4):
        before, old_rows = dict(files), store.rows(store.table.version())
        for _ in range(rng.randrange(1, 5)):
            name = rng.choice(sorted(files))
            files.pop(name) if rng.random() < 0.4 else files.update({name: text_of(rng, 100 + turn)})
        files[f"s9/new{turn}.md"] = text_of(rng, turn)
        changes = snapshot.compare(frame(spark, files), frame(spark, before)).where("change <> 'unchanged'")
        touched = {r.b for r in changes.select(F.pmod(F.xxhash64("path"), F.lit(8)).alias("b")).collect()}
        version = store.apply(changes, frame(spark, files))
        assert sorted(map(tuple, store.rows().collect())) == rebuilt()
        # only buckets with a change were written
        assert {r.bucket for r in store.table.state().where(F.col("v") == version).collect()} <= touched
        paths = changes.select("path")
        counts = publish.health_after(counts, changes, old_rows.join(paths, "path", "left_semi"), store.rows().join(paths, "path", "left_semi"))
        assert counts.collect() == health().collect()
        counts = spark.createDataFrame(counts.collect(), counts.schema)
    assert store.apply(changes.where("false"), frame(spark, files)) == version
    assert store.rows(1).count() > 0  # the versions before can still be read


def test_a_stream_of_changes(spark, tmp_path):
    files = {f"s/{i}.md": f"# T{i}\n" for i in range(10)}
    store = publish.IndexStore(spark, str(tmp_path / "i"), buckets=4)
    store.build(frame(spark, files))
    schema = "path string, change string"
    (tmp_path / "feed").mkdir()
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "feed"))
    for turn in range(3):
        files.pop(f"s/{turn}.md", None)
        files[f"s/{turn + 5}.md"] = f"# New {turn}\n"
        files[f"t/{turn}.md"] = "# Added\n"
        rows = [(f"s/{turn}.md", "removed"), (f"s/{turn + 5}.md", "modified"), (f"t/{turn}.md", "added")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "feed"))
        store.follow(feed, lambda: frame(spark, files), str(tmp_path / "check")).awaitTermination()
        assert sorted(map(tuple, store.rows().collect())) == sorted(map(tuple, index.build_index(frame(spark, files)).collect()))
