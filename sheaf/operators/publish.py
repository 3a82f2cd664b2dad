"""Snapshots and the search index as versioned tables: a run takes effect as a whole or not at all, and work follows the changes.

`Snapshots` keeps files by source. A run brings the files of some sources; sources that lost more than the guard allows keep their former files and
stamp and are reported as errors, the others' files and stamps change together, by one rename.
`IndexStore` keeps the search index by buckets of paths. A change feed (path, change) rebuilds the rows of added and modified files alone and rewrites
the buckets that have a change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.operators import index, snapshot
from sheaf.sources.versioned import VersionedTable

FILES = T.StructType([T.StructField("source", T.StringType()), T.StructField("path", T.StringType()), T.StructField("content", T.StringType())])
STAMP = T.StructType([T.StructField(c, t) for c, t in (("fetched_at", T.TimestampType()), ("etag", T.StringType()), ("last_modified", T.StringType()), ("git_sha", T.StringType()), ("file_count", T.LongType()))])
INDEX = T.StructType([T.StructField("bucket", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("path", "title", "summary"))])


class Snapshots:
    """The snapshot and stamps of all sources below root."""

    def __init__(self, spark: SparkSession, root: str):
        self.table = VersionedTable(spark, root, "source", FILES, STAMP)

    def files(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def stamps(self, version: int | None = None) -> DataFrame:
        """source, fetched_at, etag, last_modified, git_sha, file_count."""
        return self.table.state(version).drop("v")

    def update(self, files: DataFrame, remote: DataFrame, fetched_at: Column, share: float = snapshot.REGRESSION, failed: DataFrame | None = None, step: Callable[[str], None] = lambda name: None) -> DataFrame:
        """A run's files(source, path, content) and remote(source, etag, last_modified, head_sha) -> the report: source, status, added, modified, removed, unchanged, error.

        Sources without files in the run stay. failed(source, error): sources that couldn't be read; they stay too, and are reported.
        """
        base = self.table.version()
        before, stamps = self.files(base), self.stamps(base)
        guard = snapshot.regressions(files, stamps, share)
        new = self.table.commit(files, extra=snapshot.stamp(files, remote, fetched_at), accept=lambda written, _: written.join(guard.where("ok"), "source", "left_semi"), step=step)
        # what was written by this version took effect
        done = self.table.state(new).where(F.col("v") == new).select("source", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))
        few = F.format_string("regression: %d files after %d", "n_files", "previous")
        refused = guard.where("NOT ok").select("source", F.lit("error").alias("status"), few.alias("error"))
        states = done.unionByName(refused)
        if failed is not None:
            states = states.unionByName(failed.select("source", F.lit("error").alias("status"), "error"))
        changes = snapshot.diff(self.files(new).join(done, "source", "left_semi"), before.join(done, "source", "left_semi"))
        return snapshot.run_report(states.withColumn("version", F.lit(new).cast("string")), changes)


class IndexStore:
    """The search index below root, in buckets of paths."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256):
        self.table, self.buckets = VersionedTable(spark, root, "bucket", INDEX), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int").alias("bucket")

    def rows(self, version: int | None = None) -> DataFrame:
        """path, title, summary."""
        return self.table.read(version).drop("bucket")

    def build(self, files: DataFrame) -> int:
        """Index all files(path, content) anew."""
        return self.table.commit(index.build_index(files).select(self.bucket(), "path", "title", "summary"), removed=self.table.state())

    def apply(self, changes: DataFrame, files: DataFrame) -> int:
        """Bring the index up to date with changes(path, change) of files(path, content), the files as they are now. The new version.

        Only files that were added or modified are indexed, and only buckets with a change are read and written again.
        """
        changes = changes.where("change <> 'unchanged'").select(self.bucket(), "path", "change")
        # one number for each bucket at most
        touched = sorted(r.bucket for r in changes.select("bucket").distinct().collect())
        if not touched:
            return self.table.version()
        fresh = files.select("path", "content").join(changes.where("change IN ('added', 'modified')").select("path"), "path", "left_semi")
        kept = self.table.read(keys=touched).join(changes.select("path"), "path", "left_anti")
        rows = kept.unionByName(index.build_index(fresh).select(self.bucket(), "path", "title", "summary"))
        return self.table.commit(rows, removed=changes.select("bucket"))

    def follow(self, feed: DataFrame, files: Callable[[], DataFrame], checkpoint: str):
        """Apply a stream of changes(path, change), batch by batch; the later change of a path counts. files() gives the files as they are."""

        def batch(rows: DataFrame, _: int) -> None:
            rows = rows.withColumn("__at", F.monotonically_increasing_id())
            self.apply(rows.groupBy("path").agg(F.max_by("change", "__at").alias("change")), files())

        return feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def health_after(before: DataFrame, changes: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The health counts(n_md, n_html, n_indexed, n_titled, n_untitled), one row, after changes(path, change) that took `removed` and put `added` index rows."""
    delta = lambda end: F.count_if((F.col("change") == "added") & F.endswith("path", F.lit(end))) - F.count_if((F.col("change") == "removed") & F.endswith("path", F.lit(end)))
    files = changes.agg(delta(".md").alias("d_md"), delta(".html").alias("d_html"))
    rows = added.select("title", F.lit(1).alias("w")).unionByName(removed.select("title", F.lit(-1).alias("w")))
    counts = rows.agg(*(F.coalesce(F.sum(F.when(cond, F.col("w"))), F.lit(0)).alias(c) for c, cond in (("d_indexed", F.lit(True)), ("d_titled", F.col("title") != ""), ("d_untitled", F.col("title") == ""))))
    met = before.join(files, how="cross").join(counts, how="cross")  # one row each
    return met.select(*((F.col(f"n_{c}") + F.col(f"d_{c}")).alias(f"n_{c}") for c in ("md", "html", "indexed", "titled", "untitled")))
