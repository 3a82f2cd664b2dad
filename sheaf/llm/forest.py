"""MinHash near-duplicate detection with an LSH forest.

A document is the set of its runs of SHINGLE words; documents are linked if their sets have a Jaccard similarity of similar_sets.ALIKE (0.8) at least.
Equal sets are one node. A node's signature has TREES * DEPTH minima of permuted shingle hashes. Tree t orders all nodes by the signature as it
reads from its t-th run of DEPTH minima on: a region is what agrees in those first DEPTH minima (a pair of similarity 0.8 shares one with a
probability of 1 - (1 - 0.8^DEPTH)^TREES = 0.99997), and within it LABEL more minima, a byte of each, go on with the order. So every order is one sort by
ranges over the cluster, however many nodes agree, and near sets stand side by side.

1. Neighbours in an order are candidates. Each node is checked with the neighbour it shares the longest prefix with, over all trees, then with
   those others that it isn't connected with yet.
2. A region is settled at the depth where its neighbours are connected; a region of two is settled by its pair. In a region that falls apart, neighbours
   may hide a pair: its nodes are compared once more, exactly. Two similar sets share one of their rarest shingles (the prefix filter: a fifth of the larger
   set, a ninth of the smaller one, less what the places of the shared shingle rule out), rarity being counted over these nodes in
   a table of fixed size. Texts that share most of a template and differ in the rest have only their own shingles there and never meet.
   Shingles that many nodes hold there have their nodes compared by blocks (similar_sets.block_links), unless they are connected already.
3. Every link is checked on the full shingle sets. Links connect what all pairs would; no group is expanded into pairs, capped or sampled.

Defined cases: texts without words (null ones too) have an empty set and are linked with nothing; texts of fewer than SHINGLE words have one shingle. Rows that
repeat an id are one document: what is linked with one of them is linked with all, and each row has the size of its own set. Documents with a null id
link nothing, have a null component and are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.llm.common import SEED, cut, join_by, marked, read, releasing, stored, text_steps
from sheaf.llm.components import connected_components, joined
from sheaf.llm.near_copies import shingle_set
from sheaf.llm.similar_sets import alike, checkable, exact_links

SHINGLE, TREES, DEPTH, LABEL = 4, 20, 4, 8
#: Shingles whose permuted hashes are made at once.
CHUNK = 1024


def permutations() -> tuple[np.ndarray, np.ndarray]:
    a, b = np.random.default_rng(SEED).integers(0, 1 << 64, (2, TREES * DEPTH, 1), np.uint64)
    return a | np.uint64(1), b


def signature(shingles: np.ndarray, permuted: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = permuted
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), CHUNK):
        np.minimum(least, ((shingles[i : i + CHUNK] ^ b) * a).min(axis=1), out=least)
    return least


def orders(least: np.ndarray) -> tuple[list[int], list[int]]:
    """(region, label) of a signature in each tree, as signed integers: the first DEPTH minima from the tree's place on, hashed, and a byte of each of the next LABEL."""
    twice = np.concatenate((least, least))
    raw, low = twice.tobytes(), (twice & np.uint64(0xFF)).astype(np.uint8).tobytes()
    regions = [xxhash.xxh64_intdigest(raw[8 * t : 8 * (t + DEPTH)], t) for t in range(0, TREES * DEPTH, DEPTH)]
    labels = [int.from_bytes(low[t + DEPTH : t + DEPTH + LABEL], "big", signed=True) for t in range(0, TREES * DEPTH, DEPTH)]
    return np.array(regions, np.uint64).view(np.int64).tolist(), labels


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id long, digest of the shingle set, n its size, regions and labels array<long> (null for an empty set)."""

    def scan(batches):
        permuted = permutations()
        for batch in batches:
            digests, sizes, regions, labels = [], [], [], []
            for _, texts in text_steps(batch, "text"):
                for text in texts:
                    own = shingle_set(text, shingle)
                    digests.append(xxhash.xxh3_128_digest(own.tobytes(), SEED))
                    sizes.append(len(own))
                    r, b = orders(signature(own, permuted)) if len(own) else (None, None)
                    regions.append(r)
                    labels.append(b)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(regions, lists), pa.array(labels, lists)], names=["doc_id", "digest", "n", "regions", "labels"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(scan), "doc_id long, digest binary, n long, regions array<long>, labels array<long>")


def neighbours(nodes: DataFrame) -> DataFrame:
    """nodes(node, n, regions, labels) -> region, a, na, b, nb, shared (minima after the region's that agree): neighbours in the trees' orders."""
    rows = nodes.select("node", "n", F.explode(F.arrays_zip("regions", "labels")).alias("at")).select(F.col("at.regions").alias("region"), F.col("at.labels").alias("label"), "node", "n")
    order = ["region", "label", "node"]
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def scan(batches):
        part = TaskContext.get().partitionId()
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            region, label, node, n = (c.to_numpy() for c in batch.columns)
            if last is None:
                yield given(part, 0, region[:1], node[:1], n[:1], label[:1])
            else:
                region, label, node, n = (np.concatenate(x) for x in zip(last, (region, label, node, n), strict=True))
            same = np.flatnonzero(region[1:] == region[:-1])
            apart = (label[same] ^ label[same + 1]).view(np.uint64)
            shared = sum((apart >> np.uint64(64 - 8 * k) == 0).astype(np.int32) for k in range(1, LABEL)) + (apart == 0).astype(np.int32)
            pairs = [region[same], node[same], n[same], node[same + 1], n[same + 1], shared, np.zeros(len(same), np.int64), np.full(len(same), -1, np.int32), np.full(len(same), -1, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs], names=NAMES)
            last = region[-1:], label[-1:], node[-1:], n[-1:]
        if last is not None:
            yield given(part, 1, last[0], last[2], last[3], last[1])

    def given(part, end, region, node, n, label):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (region, node, n, node, n, np.zeros(1, np.int32), label, np.array([part], np.int32), np.array([end], np.int32))], names=NAMES)

    form = "region long, a long, na long, b long, nb long, shared int, label long, part int, end int"
    NAMES = [x.split()[0] for x in form.split(", ")]
    found = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("region", "label", "node", "n").mapInArrow(releasing(scan), form), "orders")
    # the first and last row of each partition: two of each meet where partitions do
    before = Window.orderBy("part", "end")
    edges = found.where("part >= 0").select("part", "end", "region", "label", F.col("a").alias("b"), F.col("na").alias("nb"), *(F.lag(c).over(before).alias(f"_{c}") for c in ("region", "label", "a", "na", "end")))
    alike_bytes = sum((F.shiftrightunsigned(F.col("label").bitwiseXOR(F.col("_label")), 64 - 8 * k) == 0).cast("int") for k in range(1, LABEL)) + (F.col("label") == F.col("_label")).cast("int")
    met = edges.where("end = 0 AND _end = 1 AND region = _region").select("region", F.col("_a").alias("a"), F.col("_na").alias("na"), "b", "nb", alike_bytes.cast("int").alias("shared"))
    return found.where("part < 0").select("region", "a", "na", "b", "nb", "shared").unionByName(met)


def best(pairs: DataFrame) -> DataFrame:
    """Of pairs(a, na, b, nb, shared), each node's pair of the longest common prefix (ties: the largest node)."""
    ways = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("na").alias("nx"), "shared", F.col("b").alias("y"), F.col("nb").alias("ny")), F.struct(F.col("b").alias("x"), F.col("nb").alias("nx"), "shared", F.col("a").alias("y"), F.col("na").alias("ny")))).alias("p")).select("p.*")
    top = ways.groupBy("x").agg(F.max(F.struct("shared", "y", "ny")).alias("top"), F.first("nx").alias("nx"))
    return top.select(F.col("x").alias("a"), F.col("nx").alias("na"), F.col("top.y").alias("b"), F.col("top.ny").alias("nb"))


def with_parts(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """pairs(a, b, ...) with pa and pb, the parts that a and b belong to."""
    for x in ("a", "b"):
        pairs = pairs.join(parts.select(F.col("node").alias(x), F.col("component").alias(f"_{x}")), x, "left").withColumn(f"p{x}", F.coalesce(f"_{x}", x)).drop(f"_{x}")
    return pairs


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """The shingle sets of wanted(node, doc_id, digest): (node, shingles binary). Texts are read where they are; only the sets are shuffled."""

    def scan(batches):
        for batch in batches:
            sets = [shingle_set(t, shingle).tobytes() for _, texts in text_steps(batch, "text") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(s, SEED) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "digest", "shingles"])

    rows, _ = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted.select("doc_id"), ["doc_id"])
    found = rows.mapInArrow(releasing(scan), "doc_id long, digest binary, shingles binary").join(wanted, ["doc_id", "digest"])
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


def forest_parts(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """The components (node, component) of nodes(node, doc_id, digest, n, regions, labels) that all pairs that are alike make; nodes without a link may be missing."""
    n = nodes.count()
    pairs = stored(neighbours(nodes), "neighbours", TREES * n)
    wanted = cut(nodes.select("node", "doc_id", "digest").join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"), n)
    sets = stored(shingle_sets(docs, wanted, shingle), "sets", 10 * n)
    parts = connected_components(alike(checkable(best(pairs)), sets))
    # the neighbours that aren't connected by these
    rest = with_parts(checkable(pairs), parts).where("pa <> pb").select("a", "b")
    parts = joined(parts, alike(rest, sets))
    apart = with_parts(pairs, parts).where("pa <> pb").select("region").distinct()
    counts = pairs.groupBy("region").agg(F.count("*").alias("many")).where("many > 1")
    open_ = cut(counts.join(apart, "region"), n)
    if open_.isEmpty():
        return parts
    several = join_by(pairs, open_, ["region"], "many", pairs.count())
    return joined(parts, exact_links(cut(several.select(F.explode(F.array("a", "b")).alias("node")).distinct(), n), sets, parts))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text) -> one row per document: doc_id, n_shingles, component_id (the smallest id it is connected with)."""
    known = stored(sketches(docs, shingle), "sketches")
    named = known.where("doc_id IS NOT NULL")
    nodes = named.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "regions", "labels")))
    n = known.count()
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes", 10 * n)
    # an id that comes with several sets joins them
    several = named.where("n > 0").select("doc_id", "digest").distinct().groupBy("doc_id").agg(F.count("*").alias("sets")).where("sets > 1")
    again = named.select("doc_id", "digest").distinct().join(several, "doc_id").join(nodes.select("digest", "node"), "digest")
    again = again.join(again.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b")
    parts = joined(forest_parts(docs, nodes, shingle), again)
    of = nodes.join(parts, "node", "left").select("digest", "copies", "doc_id", F.coalesce("component", "node").alias("part"))
    first = of.groupBy("part").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("many"))
    classes = stored(join_by(of, stored(first, "firsts", n), ["part"], "many", n).select("digest", "copies", "component_id"), "classes", n)
    linked = join_by(named.where("n > 0").select("doc_id", "digest", "n"), classes, ["digest"], "copies", n).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    # without words a document is alone, but for the other rows of its id
    alone = known.where("doc_id IS NULL OR n = 0").select("doc_id", F.col("n").alias("n_shingles"))
    same = linked.join(alone.where("doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    alone = alone.join(same, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return linked.unionByName(alone)


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT d.doc_id, count(h) AS n FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS z FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.z = l.a),
m AS (SELECT doc_id, min(z) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, n.n AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m JOIN n ON m.doc_id = n.doc_id
"""
