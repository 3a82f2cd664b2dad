"""Tables that change by whole groups of rows, atomically: versioned data folders and a manifest that one rename commits.

A table's rows belong to groups, the values of a key column (a source, a bucket), which is neither null nor empty. A commit writes the new rows of some groups beside all
others, then the state (for each group, the version that holds its rows, and what else is known of it), then the manifest, renamed to
its number. Until that rename readers see the version before; what a run that failed has left is never looked at, and removed by vacuum. Two writers
that start from one version can't both commit: the second rename fails.

    root/data/v=<n>/<key>=.../*.parquet    rows written by version n
    root/state/v=<n>/*.parquet             key, data version, other columns: one row for each group
    root/manifests/<n>.json                committed versions
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.sources.workspace import hadoop_path


class Conflict(RuntimeError):
    """Another writer has committed since."""


@dataclass
class VersionedTable:
    """A table below root; key: its groups' column; schema: its rows (key included); extra: further columns of the state, a row for each group."""

    spark: SparkSession
    root: str
    key: str
    schema: T.StructType
    extra: T.StructType = field(default_factory=T.StructType)

    # --- reading
    def versions(self) -> list[int]:
        """The committed versions, in order."""
        system, place = hadoop_path(self.spark, f"{self.root}/manifests")
        if not system.exists(place):
            return []
        names = [s.getPath().getName() for s in system.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def version(self) -> int:
        """The latest committed version, 0 for none."""
        return max(self.versions(), default=0)

    def state(self, version: int | None = None) -> DataFrame:
        """key, v (the version that wrote the group's rows), and the extra columns."""
        version = self.version() if version is None else version
        fields = T.StructType([self.schema[self.key], T.StructField("v", T.IntegerType()), *self.extra.fields])
        return self.spark.read.schema(fields).parquet(f"{self.root}/state/v={version}") if version else self.spark.createDataFrame([], fields)

    def read(self, version: int | None = None, keys: list | None = None) -> DataFrame:
        """The rows of a version (the latest); of these keys alone, if given: other groups' folders aren't read."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        state = self.state(version)
        if keys is not None:
            state = state.where(F.col(self.key).isin(keys))
        # versions that are still in use, a few of all
        used = sorted(r.v for r in state.select("v").distinct().collect())
        fields = T.StructType([*self.schema.fields, T.StructField("v", T.IntegerType())])
        rows = self.spark.read.schema(fields).option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/v={v}" for v in used]) if used else self.spark.createDataFrame([], fields)
        if keys is not None:
            rows = rows.where(F.col(self.key).isin(keys))
        return rows.join(state.select(self.key, "v"), [self.key, "v"], "left_semi").select(*self.schema.names)

    # --- writing
    def commit(self, rows: DataFrame, removed: DataFrame | None = None, extra: DataFrame | None = None, accept: Callable[[DataFrame, DataFrame], DataFrame] | None = None, step: Callable[[str], None] = lambda name: None) -> int:
        """Put the groups of rows in place of those before; groups of removed(key) go; others stay. The new version.

        extra(key, ...): the state's further columns of the groups written. accept(written, before): of the states, the keys of the written groups that
        may take effect; the others keep what they had. step is told the name of each step before it is done.
        """
        base = self.version()
        new = max([base, *self._leftovers()]) + 1
        key, names = self.key, self.schema.names
        step("data")
        named = F.col(key).isNotNull() & (F.col(key).cast("string") != "")
        rows = rows.select(*(F.when(named, F.col(key)).otherwise(F.raise_error(F.lit(f"{key} is null or empty"))).alias(key) if c == key else F.col(c) for c in names))
        # small groups share a task, large ones have several
        rows.hint("rebalance", key).write.option("compression", "zstd").partitionBy(key).parquet(f"{self.root}/data/v={new}")
        step("state")
        before = self.state(base)
        kinds = {f.name: f.dataType for f in self.extra.fields}
        written = self.spark.read.schema(self.schema).parquet(f"{self.root}/data/v={new}").select(key).distinct().withColumn("v", F.lit(new))
        written = written.join(extra.select(key, *kinds), key, "left") if extra is not None else written.select("*", *(F.lit(None).cast(t).alias(c) for c, t in kinds.items()))
        if accept is not None:
            written = written.join(accept(written, before).select(key), key, "left_semi")
        kept = before.join(written.select(key), key, "left_anti")
        if removed is not None:
            kept = kept.join(removed.select(key).distinct(), key, "left_anti")
        kept.unionByName(written).coalesce(8).write.parquet(f"{self.root}/state/v={new}")
        step("manifest")
        self._publish(new, base, step)
        return new

    def _publish(self, new: int, base: int, step: Callable[[str], None]) -> None:
        system, place = hadoop_path(self.spark, f"{self.root}/manifests/{new}.json")
        _, beside = hadoop_path(self.spark, f"{self.root}/manifests/.{new}-{uuid.uuid4().hex}")
        out = system.create(beside)
        out.write(bytearray(json.dumps({"version": new, "base": base}).encode()))
        out.close()
        step("rename")
        if self.version() != base or system.exists(place) or not system.rename(beside, place):
            system.delete(beside, False)
            raise Conflict(f"version {self.version()} was committed after {base}, from which this run started")

    def _leftovers(self) -> list[int]:
        """Versions of which there is data or state, committed or not."""
        out = []
        for part in ("data", "state"):
            system, place = hadoop_path(self.spark, f"{self.root}/{part}")
            if system.exists(place):
                out += [int(s.getPath().getName().removeprefix("v=")) for s in system.listStatus(place) if s.getPath().getName().startswith("v=")]
        return out

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove folders that none of the last `keep` versions (1 at least) uses, failed runs' included; not while a writer is at work. What went."""
        versions = self.versions()
        kept = versions[-max(1, keep) :]
        used = {r.v for v in kept for r in self.state(v).select("v").distinct().collect()}
        gone = []
        for part, stay in (("data", used), ("state", set(kept))):
            system, place = hadoop_path(self.spark, f"{self.root}/{part}")
            for s in system.listStatus(place) if system.exists(place) else ():
                name = s.getPath().getName()
                if name.startswith("v=") and int(name[2:]) not in stay:
                    system.delete(s.getPath(), True)
                    gone.append(f"{part}/{name}")
        system, place = hadoop_path(self.spark, f"{self.root}/manifests")
        for s in system.listStatus(place) if system.exists(place) else ():
            name = s.getPath().getName()
            if name.startswith(".") and not name.endswith(".crc") or name.endswith(".json") and name[0] != "." and int(name.removesuffix(".json")) not in kept:
                system.delete(s.getPath(), False)
                gone.append(f"manifests/{name}")
        return sorted(gone)
