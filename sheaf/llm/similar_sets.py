"""Similarity of shingle sets: checks of candidate pairs, and all similar pairs among some sets, exactly.

Two sets are alike if their Jaccard similarity is ALIKE at least. Sets are sorted distinct 64-bit hashes, as bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import cut, join_by, releasing, stored
from sheaf.llm.components import joined

#: Least similarity, as a fraction of whole numbers.
ALIKE = (4, 5)
#: Shingles of a block of members that are compared with another block: 4 MB.
BLOCK = 1 << 19
#: Nodes of a shingle whose pairs are looked at in one go; cells of the table of rarity.
GROUP, CELLS = 256, 1 << 18


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose shingle sets are similar enough."""

    def check(batches):
        least, of = ALIKE
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * of >= least * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(releasing(check), "a long, b long")


def checkable(pairs: DataFrame) -> DataFrame:
    """pairs(a, na, b, nb) once each and without those whose sizes alone rule out the similarity."""
    least, of = ALIKE
    near = pairs.where((F.col("a") != F.col("b")) & (F.least("na", "nb") * of >= F.greatest("na", "nb") * least))
    return near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def still_apart(rows: DataFrame, parts: DataFrame, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows(key, node, n) with the part of each node, the keys (key, many, size, main) whose members are in several parts; main: the part of most)."""
    apart = cut(rows.select("key", "node", "n").join(parts, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("part")), n)
    per = apart.groupBy("key", "part").agg(F.count("*").alias("many"), F.sum(F.col("n") + 1).alias("shingles"))
    keys = per.groupBy("key").agg(F.count("*").alias("parts"), F.sum("many").alias("many"), F.max(F.struct("many", "part")).alias("main"), F.sum("shingles").alias("all"), F.max_by("shingles", F.struct("many", "part")).alias("of_main"))
    size = [F.col("many").alias("many"), F.col("many").alias("size"), F.col("main.part").alias("main")]
    blocks = [F.ceil(F.col(x) / BLOCK).cast("long").alias(y) for x, y in (("all", "rights"), ("rest", "lefts"))]
    return apart, cut(keys.where("parts > 1").withColumn("rest", F.col("all") - F.col("of_main")).select("key", *size, *blocks), n)


def block_links(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect what all similar pairs within a group of apart(key, node, n, part, main, lefts, rights) connect.

    Members outside of the group's main part are compared with all: blocks of them with blocks of all, each of about BLOCK shingles, so a task
    holds two blocks. Rows are members times blocks, not pairs, and only links are returned.
    """
    deal = lambda blocks: F.pmod(F.xxhash64(F.lit("block"), "node"), F.col(blocks))
    rest = apart.where("part <> main").select("key", "node", "part", F.lit(True).alias("left"), F.lit(True).alias("rest"), deal("lefts").alias("l"), F.explode(F.expr("sequence(0L, rights - 1)")).alias("r"))
    every = apart.select("key", "node", "part", F.lit(False).alias("left"), (F.col("part") != F.col("main")).alias("rest"), F.explode(F.expr("sequence(0L, lefts - 1)")).alias("l"), deal("rights").alias("r"))
    rows = rest.unionByName(every).join(sets, "node")

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("left")
        left, right = table.filter(side), table.filter(pc.invert(side))
        nodes, of_rest, parts = (right.column(x).to_numpy() for x in ("node", "rest", "part"))
        asking, own_parts, parts = left.column("node").to_pylist(), left.column("part").to_numpy().copy(), parts.copy()
        found = [np.frombuffer(x, np.uint64) for x in right.column("shingles").to_pylist()]
        sizes = np.array([len(x) for x in found], np.int64)
        hashes = np.concatenate([np.zeros(0, np.uint64), *found])
        owner = np.repeat(np.arange(len(found)), sizes)
        least, of = ALIKE
        links = []
        for k, raw in enumerate(left.column("shingles").to_pylist()):
            own = np.frombuffer(raw, np.uint64)
            both = np.zeros(len(nodes), np.int64)
            if len(own):
                hit = own[np.minimum(np.searchsorted(own, hashes), len(own) - 1)] == hashes
                both = np.bincount(owner[hit], minlength=len(nodes))
            near = both * of >= least * (sizes + len(own) - both)
            # of two members outside of the main part, the larger one asks
            near &= ~of_rest | (nodes < asking[k])
            for i in np.flatnonzero(near).tolist():
                if (here := own_parts[k]) != (there := parts[i]):
                    links.append((asking[k], int(nodes[i])))
                    own_parts[own_parts == here] = there
                    parts[parts == here] = there
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return rows.groupBy("key", "l", "r").applyInArrow(compare, "a long, b long")


def rarity(sets: DataFrame) -> np.ndarray:
    """How often shingles occur in sets(shingles), by CELLS cells: any order of cells is one that the prefix filter may use."""

    def count(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                np.add.at(total, (np.frombuffer(raw, np.uint64) % np.uint64(CELLS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    found = sets.select("shingles").mapInArrow(releasing(count), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    out = np.zeros(CELLS, np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


def least_overlap(nx: int, ny: int) -> int:
    """Shingles that two sets of these sizes share at least if they are alike."""
    least, of = ALIKE
    return -(-(nx + ny) * least // (least + of))


def rare_shingles(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """sets(node, part, shingles) -> shingle, node, part, n, place, small: the rarest shingles of each set; small: also looked up as the smaller of two sets."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    least, of = ALIKE

    def scan(batches):
        counts = shared.value
        for batch in batches:
            out = []
            for node, part, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(raw, np.uint64)
                n = len(own)
                if not n:
                    continue
                order = np.lexsort((own, counts[(own % np.uint64(CELLS)).astype(np.int64)]))[: n - -(-n * least // of) + 1]
                place = np.arange(len(order), dtype=np.int64)
                out.append((own[order].view(np.int64), np.full(len(order), node), np.full(len(order), part), np.full(len(order), n), place, place <= n - least_overlap(n, n)))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "node", "part", "n", "place", "small"])

    return sets.select("node", "part", "shingles").mapInArrow(releasing(scan), "shingle long, node long, part long, n long, place long, small boolean")


def meeting(batches):
    """members of a shingle -> the pairs of different parts that sizes and places allow to be alike."""
    least, of = ALIKE
    for batch in batches:
        out = {c: [] for c in ("a", "na", "b", "nb")}
        for members in batch.column(0):
            node, part, n, place, small = (members.values.field(c).to_numpy(zero_copy_only=False) for c in ("node", "part", "n", "place", "small"))
            for i in np.flatnonzero(small):
                larger = (n > n[i]) | (n == n[i]) & (node > node[i])
                need = -(-(n + n[i]) * least // (least + of))
                ok = larger & (part != part[i]) & (n * least <= n[i] * of) & (np.minimum(n - place, n[i] - place[i]) >= need)
                k = int(ok.sum())
                for c, v in (("a", node[ok]), ("na", n[ok]), ("b", np.full(k, node[i])), ("nb", np.full(k, n[i]))):
                    out[c].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else np.zeros(0, np.int64)) for v in out.values()], names=list(out))


def exact_links(nodes: DataFrame, sets: DataFrame, parts: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (a, b) that, with what the parts(node, component) connect, connect all pairs among nodes(node) that are alike. sets(node, shingles) has all of them."""
    own = stored(sets.join(nodes, "node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("part"), "shingles"), "open")
    rows = stored(rare_shingles(own, rarity(own)), "rare")
    per = rows.groupBy("shingle").agg(F.count("*").alias("many"), F.min("part").alias("lo"), F.max("part").alias("hi"), F.max("small").alias("small"))
    per = stored(per.where("lo < hi AND small").select("shingle", "many"), "meet")
    few = rows.join(per.where(F.col("many") <= group).select("shingle"), "shingle")
    few = few.groupBy(F.concat_ws(" ", "shingle").alias("one")).agg(F.collect_list(F.struct("node", "part", "n", "place", "small")).alias("members"))
    pairs = few.select("members").mapInArrow(releasing(meeting), "a long, na long, b long, nb long")
    links = cut(alike(checkable(pairs), own.select("node", "shingles")))
    heavy = per.where(F.col("many") > group)
    if heavy.isEmpty():
        return links
    parts = joined(parts, links)
    held = cut(join_by(rows.select("shingle", "node", "n"), heavy, ["shingle"], "many", rows.count()).withColumnRenamed("shingle", "key"))
    apart, open_ = still_apart(held, parts)
    return links.unionByName(cut(block_links(cut(join_by(apart, open_, ["key"], "many", held.count())), own.select("node", "shingles"))))
