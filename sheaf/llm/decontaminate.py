"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items: `window` consecutive words, or all words of a shorter item. A word is one
symbol. For patterns of one length m, a shift table over blocks of two words (one, if m is 1) tells how far the search
position may move without missing an occurrence; where the shift is 0, the hash bucket of that suffix block names the few patterns that can
end here, and they are compared word by word.

Tables are compiled for blocks of about `BLOCK_WINDOWS` pairs of a window and an item that has it, each broadcast to all tasks: their size is bounded by
that parameter, however many items share a window, and more pairs mean more passes over the documents, not larger tables. Each pass writes what it has
found, by the text's SHA-256, before the next one's tables are made.

Defined cases: null and empty texts have no words; an item without words has no window; null item ids mark hits but aren't
listed; repeated items and repeated windows count once per id; repeated documents are each reported.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import ALNUM, cut, fresh, marked, read, releasing, stored, text_steps

WINDOW = 10
BLOCK_WINDOWS = 200_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


class WuManber:
    """Search tables for patterns (tuples of words) of one length."""

    def __init__(self, patterns: list[tuple[bytes, ...]]):
        self.m = m = len(patterns[0])
        self.block = b = min(2, m)
        self.default = m - b + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for p in patterns:
            for end in range(b, m + 1):
                key, far = (p[end - 2], p[end - 1]) if b == 2 else p[end - 1], m - end
                if far < self.shift.get(key, self.default):
                    self.shift[key] = far
            self.bucket[key].append(p)
        #: Last words of the blocks: for most positions a look here is enough.
        self.ends = {k[1] if b == 2 else k for k in self.shift}

    def find(self, words: list[bytes]):
        """Yield (first word, pattern) of every occurrence."""
        m, n, ends, default, pairs = self.m, len(words), self.ends, self.default, self.block == 2
        shift, i = self.shift.get, self.m - 1
        while i < n:
            w = words[i]
            if w not in ends:
                i += default  # no block ends in this word: at most a pattern's first word is here
                continue
            key = (words[i - 1], w) if pairs else w
            far = shift(key, default)
            if far:
                i += far
                continue
            for p in self.bucket.get(key, ()):
                start = i - m + 1
                if tuple(words[start : i + 1]) == p:
                    yield start, p
            i += 1


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """Rows (item_id, words array) of each distinct window of each item."""
    out = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("window", T.ArrayType(T.BinaryType()))])

    def cut_up(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, texts in text_steps(batch, "text"):
                for item, text in zip(ids[i:], texts, strict=False):
                    w = words_of(text)
                    found = {tuple(w[k : k + window]) for k in range(max(1, len(w) - window + 1))} if w else set()
                    found = sorted(found)
                    for k in range(0, len(found), 2000):
                        part = found[k : k + 2000]
                        yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array([list(x) for x in part], pa.list_(pa.binary()))], names=["item_id", "window"])

    return items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(cut_up, out)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs(doc_id, text, ...) with n_words long, hits (ranges of hit words as [first, end) pairs) and item_ids (sorted).

    Returns all columns of docs that don't clash, then these three.
    """
    spark = docs.sparkSession
    clash = [c for c in docs.columns if c.lower() in ("n_words", "hits", "item_ids")]
    docs = docs.drop(*clash)
    pairs = cut(windows_of(items, window).distinct())
    n = pairs.count()
    blocks = max(1, -(-n // block_windows))
    if blocks == 1:
        schema = T.StructType([*docs.schema.fields, *FOUND.fields])
        return docs.mapInArrow(releasing(scanner(tables_of(pairs, 0, 1), schema)), schema)
    # block after block: what is found is written before the next block's tables are made, so no task ever holds two of them
    held, parts = fresh(docs, "__digest"), None
    for k in range(blocks):
        tables = tables_of(pairs, k, blocks)
        found = docs.select("text").mapInArrow(releasing(finder(tables)), "digest binary, hits array<long>, item_ids array<string>")
        found = stored(found.groupBy("digest").agg(F.first("hits").alias("hits"), F.first("item_ids").alias("item_ids")), "hits")
        tables.destroy()
        parts = found if parts is None else parts.unionByName(found)
    merged = stored(parts.groupBy("digest").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids")), "found")
    merged = merged.withColumnsRenamed({"digest": held})
    some, others = marked(docs.withColumn(held, F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))), merged, [held])
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)).cast("long").alias("n_words")
    none = [F.array().cast("array<bigint>").alias("hits"), F.array().cast("array<string>").alias("item_ids")]
    met = some.join(merged, held, "left").select(*docs.columns, n_words, joined_ranges(F.coalesce("hits", F.array().cast("array<bigint>"))).alias("hits"), F.coalesce("item_ids", none[1]).alias("item_ids"))
    return met.unionByName(others.select(*docs.columns, n_words, *none))


#: A word as a Java pattern, upper case included.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.LongType())), T.StructField("item_ids", T.ArrayType(T.StringType()))])


def joined_ranges(ends: Column) -> Column:
    """[first, end, first, end, ...] of ranges in any order -> the same of their union."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(ends) - 2, F.lit(2)), lambda k: F.struct(F.get(ends, k).alias("a"), F.get(ends, k + 1).alias("b"))))

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (r["a"] <= last), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.greatest(last, r["b"])))).otherwise(F.concat(acc, F.array(r["a"], r["b"])))

    return F.when(F.size(ends) == 0, ends).otherwise(F.aggregate(pairs, F.array().cast("array<bigint>"), lambda acc, r: F.when(F.size(acc) == 0, F.array(r["a"], r["b"])).otherwise(step(acc, r))))


def tables_of(pairs: DataFrame, k: int, blocks: int):
    """The search tables of block k of pairs(item_id, window), as a broadcast: (machines by length, items of each window)."""
    ids_of: dict = defaultdict(list)
    for row in pairs.where(F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks)) == k).toLocalIterator():
        ids_of[tuple(bytes(x) for x in row.window)] += [row.item_id] if row.item_id is not None else []
    by_length: dict = defaultdict(list)
    for p in ids_of:
        by_length[len(p)].append(p)
    return pairs.sparkSession.sparkContext.broadcast(([WuManber(x) for x in by_length.values()], dict(ids_of)))


def search(text: bytes, machines, ids_of) -> tuple[int, list[int], list[str]]:
    """(number of words, ends of the ranges of hit words, items found) of a text."""
    words = words_of(text)
    spans = [(s, p) for x in machines if len(words) >= x.m for s, p in x.find(words)]
    if not spans:
        return len(words), [], []
    marked_, found = np.zeros(len(words) + 1, np.int8), set()
    for s, p in spans:
        marked_[s : s + len(p)] = 1
        found.update(ids_of[p])
    edge = np.diff(np.concatenate(([0], marked_)))
    return len(words), np.sort(np.concatenate((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))).tolist(), sorted(found)


def scanner(tables, schema: T.StructType):
    """Batches of docs -> the same with FOUND."""

    def scan(batches):
        machines, ids_of = tables.value
        for batch in batches:
            found = [search(text, machines, ids_of) for _, texts in text_steps(batch, "text") for text in texts]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return scan


def finder(tables):
    """Batches of texts -> (digest of the text, hits, item_ids) of those with a hit."""

    def scan(batches):
        machines, ids_of = tables.value
        for batch in batches:
            for _, texts in text_steps(batch, "text"):
                found = [(hashlib.sha256(text).digest(), *search(text, machines, ids_of)[1:]) for text in texts]
                found = [f for f in found if f[1]]
                columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "hits", "item_ids"])

    return scan


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: x - a)  # b1-a1 + b2-a2 ..., as alternating sums
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(decontaminate(docs, read(spark, sf_dir, "benchmark").select("item_id", "text")))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win
      FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
o AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT doc_id, o.m, i, item_id FROM o JOIN p ON o.win = p.win AND o.m = p.m),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
"""
