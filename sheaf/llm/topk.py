"""Exact top-k inner products by no-random-access (NRA) aggregation of sorted lists.

Vectors become integers, floor(SCALE * x). Candidates stand in blocks of lists: a block of rows has one list per dimension, its components in
order of value. The lists are written once and read by every block of queries.

A query reads the lists of a block sequentially, all in step, STEPS entries of a block's lists at a time; each list from the end that suits the sign of the
query's component: there stand the largest products. After each step every candidate's score is bounded: below, with unread components at the
list's far end; above, with unread components at the entry read last. The k-th best lower bound is the bar; it starts from the scores of
the block of queries among each other and grows from block to block. A query stops when no more than RESOLVED rows of the block can still reach
the bar; their scores are resolved exactly, and nothing else is read. Where lists are flat (no end tells more than the other) all of a
list is read: that is the method's worst case, and share_read() says how much was read. The bounds of all queries that still read are matrix products.

Queries are taken in blocks of QUERY_BLOCK, each broadcast (a proven bound) and read against all candidates; per
partition and query k rows go on to the final ranking. The work is that of queries times candidates, here a fiftieth of the square of the rows.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id; shorter vectors
are padded with zeros; rows that repeat an id are candidates each, and as a query an id's smallest vector counts; a candidate
with the query's id is left out; ties go to the smaller id; with fewer than k candidates all are returned; scores beyond a long are held to its range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import read, stored

K, SCALE, EVERY, QUERY_BLOCK, TOGETHER = 5, 256, 50, 4096, 256
#: Numbers in a block of lists; parts in which a list is read; rows of a block that a query resolves at most before its lists end.
LIST_NUMBERS, STEPS, RESOLVED = 1 << 18, 16, 40
#: Sums of products up to here are exact in single and in double precision.
EXACT = {np.float32: 1 << 24, np.float64: 1 << 53}
LONG = (1 << 63) - 1


def integers(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding) -> the usable rows, with components floor(SCALE * x) as doubles."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform("embedding", lambda x: x.cast("double") * SCALE)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & fine).select("vec_id", scaled.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of `width` floored values; shorter lists end in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False))
    out = np.zeros((len(column), max(width, int(lengths.max(initial=0)))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def kind_of(*tables: np.ndarray):
    """The smallest float type that is exact for inner products of rows of the tables; None if there is none."""
    most = max([1.0, *(np.abs(t).max(initial=0) for t in tables)])
    width = max(t.shape[1] for t in tables)
    return next((k for k, limit in EXACT.items() if most * most * width < limit), None)


def make_lists(ids: np.ndarray, values: np.ndarray) -> dict:
    """A row of the table of lists: for each dimension the values in ascending order, and which candidate each belongs to."""
    order = np.argsort(values, axis=0, kind="stable")
    return {"ids": ids.tolist(), "width": values.shape[1], "sorted": np.take_along_axis(values, order, axis=0).astype("<f8").tobytes(), "order": order.astype("<i4").tobytes()}


LISTS = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("width", T.IntegerType()), T.StructField("sorted", T.BinaryType()), T.StructField("order", T.BinaryType())])


def sorted_lists(rows: DataFrame) -> DataFrame:
    """integers() rows -> blocks of lists (ids, width, sorted, order)."""

    def scan(batches):
        for batch in batches:
            ids, lengths = batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy())
            a = 0
            while a < len(ids):
                size = max(1, LIST_NUMBERS // max(1, int(lengths[a : a + LIST_NUMBERS].max(initial=1))))
                block = make_lists(ids[a : a + size], matrix(batch.column(1).slice(a, size), 0))
                kinds = (pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(block.values(), kinds, strict=True)], names=list(block))
                a += size

    return rows.mapInArrow(scan, LISTS)


class Lists:
    """A block of candidates as a sorted list per dimension."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, order: np.ndarray, width: int):
        n = len(ids)
        self.ids, self.order = ids, np.pad(order, ((0, 0), (0, width - order.shape[1])), constant_values=0)
        self.order[:, order.shape[1] :] = np.arange(n)[:, None]
        self.sorted = np.pad(values, ((0, 0), (0, width - values.shape[1])))

    def rows(self) -> np.ndarray:
        """The candidates' vectors."""
        out = np.empty_like(self.sorted)
        np.put_along_axis(out, self.order, self.sorted, axis=0)
        return out

    def survivors(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, query) of all pairs that may be among the query's k best, if the k-th best so far is floor, and the entries that each query read."""
        n, d = self.sorted.shape
        kind = self.sorted.dtype
        # weights of both ends of the lists; a query has weight at one of them
        ends = np.hstack((np.maximum(queries, 0), np.minimum(queries, 0))).T.astype(kind)
        far = np.concatenate((self.sorted[0], self.sorted[-1]))[:, None] * ends
        known = np.zeros((n, len(queries)), kind)
        seen = np.zeros((n, 2 * d), kind)
        read, open_ = np.zeros(len(queries), np.int64), np.arange(len(queries))
        left, used, depth = [], (queries != 0).sum(axis=1), 0
        while len(open_):
            to = min(n, depth + max(1, -(-n // STEPS)))
            # the next entries of each list, from its upper and its lower end
            new = np.zeros((n, 2 * d), kind)
            np.put_along_axis(new[:, :d], self.order[n - to : n - depth], self.sorted[n - to : n - depth], axis=0)
            np.put_along_axis(new[:, d:], self.order[depth:to], self.sorted[depth:to], axis=0)
            np.put_along_axis(seen[:, :d], self.order[n - to : n - depth], kind.type(1), axis=0)
            np.put_along_axis(seen[:, d:], self.order[depth:to], kind.type(1), axis=0)
            depth = to
            known += new @ ends[:, open_]
            # unread components stand between the far end of the list and the entry read last
            last = np.concatenate((self.sorted[n - depth], self.sorted[depth - 1]))[:, None] * ends[:, open_]
            low = known - seen @ far[:, open_] + far[:, open_].sum(axis=0)
            up = known - seen @ last + last.sum(axis=0)
            same = self.ids[:, None] == own[None, open_]
            low[same] = up[same] = -np.inf
            bar = floor[open_]
            if n >= k:
                bar = np.maximum(bar, np.partition(low, n - k, axis=0)[n - k])
            can = (up >= bar[None, :]) & ~same
            done = (can.sum(axis=0) <= max(RESOLVED, 2 * k)) | (depth == n)
            read[open_[done]] = depth * used[open_[done]]
            row, q = np.nonzero(can[:, done])
            left.append((row, open_[done][q]))
            open_, known = open_[~done], known[:, ~done]
        return *(np.concatenate(x) for x in zip(*left, strict=True)), read


def first_floor(names: np.ndarray, table: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of each query's k-th best score: that among the other queries, which are candidates too."""
    out = np.full(len(names), -np.inf)
    kind = kind_of(table)
    if kind is None or len(names) <= k:
        return out
    table = table.astype(kind)
    for a in range(0, len(names), TOGETHER):
        scores = table[a : a + TOGETHER] @ table.T
        scores[np.arange(len(scores)), a + np.arange(len(scores))] = -np.inf
        out[a : a + TOGETHER] = np.partition(scores, len(names) - k, axis=1)[:, len(names) - k]
    return out


def exact(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of integers of any size, held to the range of a long."""
    out = [sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in values]
    return np.array([max(-LONG, min(LONG, x)) for x in out], dtype=np.int64)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """vectors(vec_id, embedding), queries(vec_id, embedding) -> query_id, rank, vec_id, score."""
    found = scanned(vectors, queries, k, query_block).where("vec_id IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def share_read(vectors: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, share): the part of all list entries that a query read before it could stop."""
    found = scanned(vectors, queries, k, query_block).where("vec_id IS NULL")
    return found.groupBy("query_id").agg((F.sum("read") / F.greatest(F.sum("score"), F.lit(1))).alias("share"))


def scanned(vectors: DataFrame, queries: DataFrame, k: int, query_block: int) -> DataFrame:
    """query_id, vec_id, score of the best rows of each partition; and where vec_id is null: entries read, and in score those there are."""
    spark = vectors.sparkSession
    lists = stored(sorted_lists(integers(vectors)), "lists")
    asked = integers(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // query_block))
    found = None
    for b in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()
        width = max([0, *(len(r.v) for r in got)])
        table = np.zeros((len(got), width))
        for i, r in enumerate(got):
            table[i, : len(r.v)] = np.floor(r.v)
        shared = spark.sparkContext.broadcast((np.array([r.vec_id for r in got], np.int64), table))
        part = lists.mapInArrow(reader(shared, k), "query_id long, vec_id long, score long, read long")
        found = part if found is None else found.unionByName(part)
    return found


def merged(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query; ties go to the smaller id."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.searchsorted(query, query, side="left")
    keep = np.arange(len(query)) - first < k
    return query[keep], ids[keep], scores[keep]


def reader(shared, k: int):
    def scan(batches):
        names, table = shared.value
        query, found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        floor, read, entries = first_floor(names, table, k), np.zeros(len(names), np.int64), 0
        for batch in batches:
            for row in batch.to_pylist() if len(names) else ():
                ids, d = np.array(row["ids"], np.int64), row["width"]
                values = np.frombuffer(row["sorted"], "<f8").reshape(len(ids), d)
                width = max(d, table.shape[1])
                asked = np.pad(table, ((0, 0), (0, width - table.shape[1])))
                kind = kind_of(values, asked)
                lists = Lists(ids, values.astype(kind or np.float64), np.frombuffer(row["order"], "<i4").reshape(len(ids), d), width)
                vectors = lists.rows()
                entries += len(ids) * d
                for a in range(0, len(names), TOGETHER):
                    some, own = asked[a : a + TOGETHER], names[a : a + TOGETHER]
                    if kind:
                        at, q, n = lists.survivors(some.astype(kind), own, k, floor[a : a + TOGETHER].astype(kind))
                        read[a : a + TOGETHER] += n
                        score = np.concatenate([np.einsum("ij,ij->i", vectors[at[i : i + 65536]], some[q[i : i + 65536]]) for i in range(0, len(at), 65536)] or [np.zeros(0)]).astype(np.int64)
                    else:  # beyond exact floats: all scores by whole numbers
                        at, q = np.nonzero(ids[:, None] != own[None, :])
                        order = np.argsort(q, kind="stable")
                        at, q = at[order], q[order]
                        read[a : a + TOGETHER] += len(ids) * d
                        score = np.concatenate([exact(vectors[at[q == i]], some[i]) for i in range(len(own))])
                    query, found, scores = merged(np.concatenate((query, q + a)), np.concatenate((found, ids[at])), np.concatenate((scores, score)), k)
                n = np.bincount(query, minlength=len(names))
                last = np.cumsum(n) - 1
                full = n >= k
                floor[full] = np.maximum(floor[full], scores[last[full]])
        if len(names):
            yield pa.RecordBatch.from_arrays([pa.array(names[query]), pa.array(found), pa.array(scores), pa.array(np.zeros(len(query), np.int64))], names=["query_id", "vec_id", "score", "read"])
            none = pa.array([None] * len(names), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(names), none, pa.array(np.full(len(names), entries, np.int64)), pa.array(read)], names=["query_id", "vec_id", "score", "read"])

    return scan


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
