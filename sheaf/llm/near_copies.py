"""Near copies by the similarity of word shingles: the near-dedup stage of the pipeline.

Two documents are near copies if the sets of their runs of SHINGLE words have a Jaccard similarity of ALIKE at least.
1. SimHash fingerprints of the sets are linked by pigeonring filtering (simhash.near_links): that finds exact copies and those that differ little.
   At a similarity of 0.8 about ten of 64 bits differ, and pigeonring with ten or more leaves segments of a few bits to be equal, so
2. what isn't linked yet is compared where two sets agree in one of BANDS bands of ROWS minima of permuted shingle hashes (a pair of similarity s does with
   1 - (1 - s^ROWS)^BANDS: 0.9996 at 0.8).
Every link is checked on the shingle sets themselves.

Members of a band's group are checked against two of them. Those of groups that are still in several parts then are compared exactly
(similar_sets.exact_links), by the rarest shingles of each: copies of copies are in one part by then, and texts that share most of a template
have only their own shingles there. So groups of many copies cost rows in proportion to their size, no pairs are emitted, and nothing is capped or dropped.

Defined cases: texts without words are copies of each other; texts of fewer than SHINGLE words have one shingle; repeated rows and repeated ids are one
node; documents with a null id link nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import SEED, cut, join_by, marked, releasing, stored, text_steps
from sheaf.llm.components import connected_components, joined
from sheaf.llm.simhash import near_links as pigeonring_links
from sheaf.llm.simhash import shingle_digests
from sheaf.llm.similar_sets import alike, checkable, exact_links, still_apart

SHINGLE, BANDS, ROWS = 5, 20, 5
#: Shingles whose permuted hashes are made at once.
CHUNK = 1024


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the word shingles of a text, sorted."""
    found = [np.unique(np.frombuffer(raw, ">u8").astype(np.uint64)) for raw in shingle_digests(text, shingle)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def simhash(shingles: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(shingles), 1 << 16):
        ones += np.unpackbits(shingles[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(shingles)).tobytes(), "big", signed=True)


def permutations() -> tuple[np.ndarray, np.ndarray]:
    a, b = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
    return a | np.uint64(1), b


def band_keys(shingles: np.ndarray, permuted: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """One key for each band: a hash of its minima and number, as a signed integer."""
    a, b = permuted
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), CHUNK):
        np.minimum(least, ((shingles[i : i + CHUNK] ^ b) * a).min(axis=1), out=least)
    raw, size = least.tobytes(), 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(raw[i * size : (i + 1) * size], i) for i in range(BANDS)], np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id long, digest binary of the shingle set, n long its size, fp long its SimHash, bands array<long>)."""

    def scan(batches):
        permuted = permutations()
        for batch in batches:
            digests, sizes, fps, bands = [], [], [], []
            for _, texts in text_steps(batch, "text"):
                for text in texts:
                    own = shingle_set(text)
                    digests.append(xxhash.xxh3_128_digest(own.tobytes(), SEED))
                    sizes.append(len(own))
                    fps.append(simhash(own))
                    bands.append(band_keys(own, permuted))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "digest", "n", "fp", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(scan), "doc_id long, digest binary, n long, fp long, bands array<long>")


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The shingle sets of nodes(node, digest): (node long, shingles binary). Texts are read where they are; only the sets are shuffled, once."""

    def scan(batches):
        for batch in batches:
            sets = [shingle_set(t).tobytes() for _, texts in text_steps(batch, "text") for t in texts]
            found = [xxhash.xxh3_128_digest(s, SEED) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array(sets, pa.binary())], names=["node", "found", "shingles"])

    rows, _ = marked(docs.select(F.col("doc_id").cast("long").alias("node"), "text"), nodes.select("node"), ["node"])
    found = rows.mapInArrow(releasing(scan), "node long, found binary, shingles binary")
    # an id may come with several texts and repeated rows
    return found.join(nodes, "node").where("found = digest").groupBy("node").agg(F.first("shingles").alias("shingles"))


def fingerprint_pairs(nodes: DataFrame, n: int) -> DataFrame:
    """pairs(a, na, b, nb) of nodes(node, n, fp) with equal fingerprints, or with near ones that pigeonring filtering finds."""
    of = cut(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("many")), n)
    equal = join_by(nodes.select("fp", "node", "n"), of.where("many > 1"), ["fp"], "many", n)
    equal = equal.select(F.col("first.node").alias("a"), F.col("first.n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb"))
    firsts = of.select("first.node", "first.n", "fp")
    near = pigeonring_links(firsts.select("node", "fp"))
    near = near.join(firsts.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(firsts.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    return equal.unionByName(near.select("a", "na", "b", "nb"))


def near_parts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The components (node, component) that the pairs of similarity ALIKE among nodes(node, digest, n, fp, bands) make; nodes without a link may be missing."""
    rows = nodes.select("node", "n", F.explode("bands").alias("key"))
    order = [F.struct("node", "n"), F.struct(F.xxhash64("node"), "node", "n")]
    n = nodes.count()
    shared = cut(rows.groupBy("key").agg(F.count("*").alias("many"), F.min(order[0]).alias("one"), F.min(order[1]).alias("two")).where("many > 1"), n)
    rows = cut(join_by(rows, shared, ["key"], "many", n * BANDS), n)
    lead = [rows.select(F.col(f"{x}.node").alias("a"), F.col(f"{x}.n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb")) for x in ("one", "two")]
    pairs = cut(checkable(fingerprint_pairs(nodes, n).unionByName(lead[0]).unionByName(lead[1])), n)
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(rows.select("node")).distinct()
    sets = stored(shingle_sets(docs, cut(nodes.select("node", "digest").join(wanted, "node", "left_semi"), n)), "shingles")
    parts = connected_components(alike(pairs, sets))
    apart, open_ = still_apart(rows, parts, n)
    if open_.isEmpty():
        return parts
    several = join_by(apart, open_, ["key"], "many", rows.count()).select("node").distinct()
    return joined(parts, exact_links(cut(several, n), sets, parts))


def near_copies(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, component_id), without null ids; an id's class is the smallest id it is connected with."""
    known = stored(sketches(docs.where("doc_id IS NOT NULL")), "sketches")
    n = known.count()
    nodes = cut(known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    # an id that comes with several sets joins them
    several = known.select("doc_id", "digest").distinct().groupBy("doc_id").count().where("count > 1")
    again = known.join(several.select("doc_id"), "doc_id", "left_semi").join(nodes.select("digest", "node"), "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    parts = joined(near_parts(docs, nodes), again)
    classes = stored(nodes.join(parts, "node", "left").select("digest", "copies", F.coalesce("component", "node").alias("component_id")), "classes", n)
    return join_by(known.select("doc_id", "digest"), classes, ["digest"], "copies", n).select("doc_id", "component_id")
