"""SimHash near-duplicate detection with pigeonring candidate filtering.

Fingerprints that differ in at most TAU bits are linked. The 64 bits form a ring of M consecutive segments. If two
fingerprints differ in at most TAU bits, some segment starts a chain whose differences, added up over its first l
segments, stay within the proportional budget l * TAU / M for every l up to M. For the first segments that
budget is below one bit, so they are equal: they are the join key, and the rest of the chain is checked
before the full Hamming distance. With M = 5 and TAU = 2 two segments, about 26 bits, have to be equal.

Candidate groups are never expanded into pairs: each group yields a spanning set of links between its members. A
group of more than GROUP fingerprints is dealt again by exact parts of its other bits: cut into TAU + 1 parts, one
part is equal in any pair that counts. As fingerprints are distinct, every level fixes more bits and groups shrink until they fit;
nothing is capped or dropped.

Defined cases: null and empty texts and texts without words have fingerprint zero and are linked like others; repeated
rows and repeated ids are one node; documents with a null id have a component of null and link nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.llm.common import LOWER, SEED, cut, fresh, join_by, marked, parts, read, stored, text_steps
from sheaf.llm.components import connected_components

SHINGLE, TAU, M, GROUP = 3, 2, 5, 2048
#: Bytes of a long text that are hashed at once.
PART = 1 << 18
#: First bit of each segment of the ring, and the end.
CUTS = [round(64 * i / M) for i in range(M + 1)]


def shingle_digests(text: bytes, shingle: int):
    """Yield the XXH64 digests (big-endian bytes, one after the other) of the word shingles of a text; a shorter text is one shingle. Long texts come in parts."""
    digest, n = xxhash.xxh64_digest, 0
    for first, part in parts(text.translate(LOWER), PART, shingle - 1):
        words = part.split()
        n = first + len(words)
        if len(words) < shingle:
            short = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        yield b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)])
    if 0 < n < shingle:
        yield digest(b" ".join(short), SEED)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of the word shingles of a text, as a signed integer."""
    n, ones = 0, np.zeros(64, np.int64)
    for raw in shingle_digests(text, shingle):
        rows = np.frombuffer(raw, np.uint8).reshape(-1, 8)
        n += len(rows)
        for a in range(0, len(rows), 1 << 16):
            ones += np.unpackbits(rows[a : a + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text) -> (doc_id long, fp long)."""

    def scan(batches):
        for batch in batches:
            out = [fingerprint(t, shingle) for _, texts in text_steps(batch, "text") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def masks(tau: int, m: int) -> tuple[list[int], list[int]]:
    """For each start of a chain, the mask of its segments that have to be equal, and of each of the m segments."""
    cuts = [round(64 * i / m) for i in range(m + 1)]
    segment = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(m)]
    equal = next(n - 1 for n in range(1, m + 1) if n * tau // m >= 1) if tau else m
    return [sum(segment[(i + j) % m] for j in range(equal)) for i in range(m)], segment


def chain_holds(diff: np.ndarray, start: int, segment: list[int], tau: int) -> np.ndarray:
    """Whether the differences of consecutive segments from `start` on stay within the proportional budget."""
    m, total, ok = len(segment), np.zeros(len(diff), np.int64), np.ones(len(diff), bool)
    for n in range(1, m + 1):
        total += popcount(diff & np.uint64(segment[(start + n - 1) % m]))
        ok &= total <= n * tau // m
    return ok


def group_links(fps: np.ndarray, start: int, tau: int, m: int) -> list[tuple[int, int]]:
    """Links (i, j) that connect the members of one candidate group as all pairs within tau bits would."""
    segment, seen, links = masks(tau, m)[1], np.zeros(len(fps), bool), []
    for first in range(len(fps)):
        if seen[first]:
            continue
        seen[first], front = True, [first]
        while front:
            i = front.pop()
            left = np.flatnonzero(~seen)
            if not len(left):
                break
            diff = fps[left] ^ fps[i]
            ok = chain_holds(diff, start, segment, tau)
            near = left[ok][popcount(diff[ok]) <= tau]
            seen[near] = True
            links += [(i, int(j)) for j in near]
            front += near.tolist()
    return links


def near_links(nodes: DataFrame, tau: int = TAU, m: int = M, group: int = GROUP) -> DataFrame:
    """nodes(node long, fp long), fp distinct -> links (a, b) between nodes, at most tau bits apart, that connect what all such pairs connect."""
    keys, _ = masks(tau, m)
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    rows = nodes.select("node", "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("ring"), F.col("fp").bitwiseAND(F.lit(k)).alias("key"), F.lit(k).alias("fixed")) for i, k in enumerate(signed)])).alias("k"))
    rows = rows.select("node", "fp", "k.ring", "k.key", "k.fixed")
    found, n = [], m * nodes.count()
    while True:
        rows = cut(rows, n)
        counts = rows.groupBy("ring", "key", "fixed").count().where("count > 1")
        few = cut(counts, n)
        light = rows.join(few.where(F.col("count") <= group).drop("count"), ["ring", "key", "fixed"])
        # a key of its own, so that Spark may split what the join gathers for a heavy one before the groups are put together
        light = light.groupBy(F.concat_ws(" ", "ring", "key", "fixed").alias("one")).agg(F.first("ring").alias("ring"), F.collect_list(F.struct("fp", "node")).alias("members"))
        found.append(light.select("ring", "members").mapInArrow(linker(tau, m), "a long, b long"))
        heavy = few.where(F.col("count") > group)
        if heavy.isEmpty():
            break
        rows = refine(join_by(rows, heavy, ["ring", "key", "fixed"], "count", rows.count()), tau)
        n *= tau + 1
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def refine(rows: DataFrame, tau: int) -> DataFrame:
    """Rows of too large groups, dealt by each of tau + 1 parts of the bits that aren't fixed yet."""

    def deal(batches):
        for batch in batches:
            node, fp, ring, fixed = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("node", "fp", "ring", "fixed"))
            out = {c: [] for c in ("node", "fp", "ring", "key", "fixed")}
            for mask in np.unique(fixed).tolist():
                own = fixed == mask
                free = [b for b in range(64) if not mask >> b & 1]
                for part in range(tau + 1):
                    add = sum(1 << b for b in free[part :: tau + 1])
                    full = (mask | add) if mask >= 0 else (mask + (1 << 64)) | add
                    full = full - (1 << 64) if full >> 63 else full
                    for c, v in (("node", node[own]), ("fp", fp[own]), ("ring", ring[own]), ("key", fp[own] & np.int64(full)), ("fixed", np.full(own.sum(), full, np.int64))):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out.values()], names=list(out))

    return rows.select("node", "fp", "ring", "fixed").mapInArrow(deal, "node long, fp long, ring int, key long, fixed long")


def linker(tau: int, m: int):
    def link(batches):
        for batch in batches:
            a, b = [], []
            for ring, members in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                fps = members.values.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                node = members.values.field("node").to_numpy(zero_copy_only=False)
                for i, j in group_links(fps, ring, tau, m):
                    a.append(int(node[i]))
                    b.append(int(node[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return link


def near_duplicates(docs: DataFrame, tau: int = TAU, m: int = M, shingle: int = SHINGLE, group: int = GROUP) -> DataFrame:
    """docs(doc_id, text) -> one row per document: doc_id, fp, component_id."""
    fps = stored(fingerprints(docs, shingle), "simhash")
    named = fps.where("doc_id IS NOT NULL")
    n = named.count()
    nodes = cut(named.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), n)
    # an id that comes with several fingerprints joins them
    same = named.distinct().groupBy("doc_id").agg(F.count("*").alias("sets")).where("sets > 1").drop("sets")
    again = fps.join(same, "doc_id").join(nodes.drop("n"), "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    parts = connected_components(near_links(nodes.drop("n"), tau, m, group).unionByName(again))
    classes = stored(nodes.join(parts, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component_id")), "classes", n)
    # a fingerprint that very many documents have (none of whose texts has a word, say) meets them where they are
    known = join_by(named, classes, ["fp"], "n", n).select("doc_id", "fp", "component_id")
    return known.unionByName(fps.where("doc_id IS NULL").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without all but the first document of each class; columns stay. Rows that repeat a kept id are dropped but for one."""
    return keep_first(docs, near_duplicates(docs, **options))


def keep_first(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """docs without all but the first document of each class of classes(doc_id, component_id), like keep_one.

    Only documents that may go are shuffled: those of a class that begins with another one, and those whose id comes again.
    """
    known = docs.where("doc_id IS NOT NULL")
    gone = cut(classes.where("doc_id <> component_id").select("doc_id").distinct())
    again = known.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").count().where("count > 1").select("doc_id")
    some, others = marked(known, gone.unionByName(again), ["doc_id"])
    place = fresh(docs, "__place")
    kept = some.join(gone, "doc_id", "left_anti").withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))).where(F.col(place) == 1)
    return kept.select(*docs.columns).unionByName(others).unionByName(docs.where("doc_id IS NULL"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
