"""Snapshots of sources: differences, orphans, last write wins, freshness, regression guard, run reports, state tables."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.sources.workspace import hadoop_path

KEYS = ["source", "path"]
REGRESSION, MAX_AGE = 0.5, 86_400


def last_write_wins(files: DataFrame) -> DataFrame:
    """files(source, path, content, ord): one row for each source and path, the one with the largest ord."""
    return files.groupBy(*KEYS).agg(F.max_by("content", "ord").alias("content"), F.max("ord").alias("ord"))


def compare(now: DataFrame, before: DataFrame) -> DataFrame:
    """(source, path, change): added, modified, removed or unchanged. Only digests of the texts are shuffled."""
    sides = [x.select(*KEYS, F.struct(F.length("content"), F.md5(F.col("content").cast("binary"))).alias(name)) for x, name in ((now, "__now"), (before, "__before"))]
    met = sides[0].join(sides[1], KEYS, "full_outer")
    change = F.when(F.col("__before").isNull(), "added").when(F.col("__now").isNull(), "removed").when(F.col("__now") == F.col("__before"), "unchanged").otherwise("modified")
    return met.select(*KEYS, change.alias("change"))


def diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """Counts of changes by source."""
    counts = [F.count_if(F.col("change") == x).alias(x) for x in ("added", "modified", "removed", "unchanged")]
    return compare(now, before).groupBy("source").agg(*counts)


def orphans(now: DataFrame, before: DataFrame) -> DataFrame:
    """Paths that were there and are gone."""
    return before.select(*KEYS).join(now.select(*KEYS), KEYS, "left_anti")


def regressions(files: DataFrame, stamps: DataFrame, share: float = REGRESSION) -> DataFrame:
    """(source, n_files, previous, ok): not ok if fewer than `share` of the previous files are left. No stamp, or a share of 0, is ok."""
    counts = files.groupBy("source").agg(F.count("*").alias("n_files"))
    met = counts.join(stamps.select("source", F.col("file_count").alias("previous")), "source", "left")
    bad = (F.lit(share) > 0) & (F.coalesce("previous", F.lit(0)) > 0) & (F.col("n_files") / F.col("previous") < share)
    return met.select("source", "n_files", "previous", (~F.coalesce(bad, F.lit(False))).alias("ok"))


def git_fresh(stamp: Column, remote: Column) -> Column:
    """Same commit; a shortened one counts if the full one begins with it."""
    same = (remote == stamp) | ((F.length(stamp) < 40) & remote.startswith(stamp))
    return F.coalesce((stamp != "") & (remote != "") & same, F.lit(False))


def http_fresh(ok: Column, etag: Column, remote_etag: Column, modified: Column, remote_modified: Column) -> Column:
    """The entity tag decides if both have one, else the modification date; without either the source is stale."""
    tags, dates = (etag != "") & (remote_etag != ""), (modified != "") & (remote_modified != "")
    known = F.when(F.coalesce(tags, F.lit(False)), etag == remote_etag).when(F.coalesce(dates, F.lit(False)), modified == remote_modified).otherwise(False)
    return F.coalesce(ok, F.lit(False)) & known


def freshness(stamps: DataFrame, remote: DataFrame, now: Column, max_age: int = MAX_AGE) -> DataFrame:
    """stamps(source, type, fetched_at, etag, last_modified, git_sha) and remote(source, ok, ...) -> (source, status): skipped or fetch."""
    r = remote.select("source", "ok", F.col("etag").alias("r_etag"), F.col("last_modified").alias("r_modified"), F.col("head_sha").alias("r_sha"))
    met = stamps.join(r, "source", "left")
    same = F.when(F.col("type") == "git", git_fresh(F.col("git_sha"), F.col("r_sha"))).otherwise(http_fresh(F.col("ok"), F.col("etag"), F.col("r_etag"), F.col("last_modified"), F.col("r_modified")))
    young = F.lit(max_age > 0) & (F.unix_seconds(now) - F.unix_seconds("fetched_at") < max_age)
    return met.select("source", F.when(F.coalesce(young & same, F.lit(False)), "skipped").otherwise("fetch").alias("status"))


def run_report(states: DataFrame, changes: DataFrame) -> DataFrame:
    """states(source, status, version, error) and changes as of diff() -> the report row of each source."""
    none = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("added", "modified", "removed", "unchanged")]
    return states.join(changes, "source", "left").select("source", "status", *none, "version", "error")


def summary(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count("*").alias("n"))


def write_snapshot(files: DataFrame, path: str, sources: list[str] | None = None) -> None:
    """Replace the partitions of the sources in files; other sources stay. Sources named that have no file any more lose their partition."""
    spark = files.sparkSession
    files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
    if sources:
        left = {r.source for r in files.where(F.col("source").isin(sources)).select("source").distinct().collect()}
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for entry in system.listStatus(root):
            if unquote(entry.getPath().getName()).removeprefix("source=") in set(sources) - left:
                system.delete(entry.getPath(), True)


def exists(spark, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def load_snapshot(spark, path: str, schema) -> DataFrame:
    """The snapshot written before; an empty one if there is none."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


STAMPS = "source string, fetched_at timestamp, etag string, last_modified string, git_sha string, file_count long"


def stamp(files: DataFrame, remote: DataFrame, fetched_at: Column) -> DataFrame:
    """The state row of each source after a successful run."""
    counts = files.groupBy("source").agg(F.count("*").alias("file_count"))
    return counts.join(remote, "source", "left").select("source", fetched_at.alias("fetched_at"), "etag", "last_modified", F.col("head_sha").alias("git_sha"), "file_count")


def merged_stamps(before: DataFrame, new: DataFrame, report: DataFrame) -> DataFrame:
    """The stamps after a run: new ones of sources whose report(source, status) says ok, the ones before of all others."""
    done = new.join(report.where("status = 'ok'").select("source"), "source", "left_semi")
    return before.join(done.select("source"), "source", "left_anti").unionByName(done)


def load_stamps(spark, path: str) -> DataFrame:
    """The stamps written before; none if there are none. Those before them where a writer ended in between."""
    return load_snapshot(spark, path if exists(spark, path) else f"{path}.old", STAMPS)


def write_stamps(stamps: DataFrame, path: str, step=lambda name: None) -> None:
    """Write the merged stamps, one row per source, in place of the ones before.

    They are written beside them and then change places with them by renaming, so that at any moment load_stamps finds the ones before or the new
    ones, whole. step is told the name of each step before it is done.
    """
    spark = stamps.sparkSession
    step("write")
    stamps.write.mode("overwrite").parquet(f"{path}.new")
    system, place = hadoop_path(spark, path)
    new, old = (hadoop_path(spark, f"{path}.{x}")[1] for x in ("new", "old"))
    if system.exists(place):
        step("clear")
        system.delete(old, True)
        step("aside")
        if not system.rename(place, old):
            raise OSError(f"{path} can't be renamed")
    step("rename")
    if not system.rename(new, place):
        raise OSError(f"{path}.new can't be renamed")
    step("done")
    system.delete(old, True)
