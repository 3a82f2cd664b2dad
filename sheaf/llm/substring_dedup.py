"""Substring deduplication: exact removal of passages that another document has before, behind a count-min prefilter.

A window is WINDOW consecutive words. It stands for repeated text if its word sequence also starts in a document with a smaller id.

Windows are counted by anchors: the GRAM-word sequence with the least hash within a window is its anchor, and equal
windows have equal anchors at the same place. Neighbouring windows mostly share one, so a text has about
2 / (WINDOW - GRAM + 2) anchors per word. A window can't begin in more places than its anchor stands in, so a count of
anchors is an upper bound of the count of each window.
1. One scan of the texts writes the anchors, each with the digest of its region: all words of the windows that share this occurrence of it.
2. The anchors are counted in a count-min sketch whose blocks of CELLS cells are dealt over the cluster: each partition counts its anchors,
   block by block, and the partial sketches are merged cell by cell. There are as many blocks as anchors call for (ANCHORS for each), so the sketch is as sharp
   at any size. Anchors meet their block where both are shuffled to; nothing is broadcast. Counts are never underestimated.
   Anchors that one step of STEP bytes has twice needn't be looked up.
3. A second pass keeps only anchors counted twice or more. Equal regions are grouped exactly: in all but the first document the whole region is repeated.
4. An anchor that occurs in several different regions is looked at window by window, in the first document of each region: that loses no repeated window,
   as its first document is the first one of some region.
What the sketch lets through wrongly has a count of one and falls away in the exact grouping; nothing repeated is lost however full it is.

Passages that very many documents share are keys with very many rows: these rows meet their key by broadcast (common.join_by), of a proven number of keys.
Texts are only shuffled for documents that have something to compare or to remove; these are marked in bitmaps of bounded size (a bit
may be shared, which costs a comparison and changes no result). A word counts by the 128 bits of XXH3 of its bytes, whatever its length; digests of word sequences
are made of two sums over the halves of these. Long texts are worked on in parts that overlap by a window:
a region may be cut between parts, which makes it two regions and changes no result.

Defined cases: null texts have no words; texts of fewer than WINDOW words keep all of them; documents with a null id are left as
they are and count for no other; rows that repeat an id aren't compared with each other, and each is judged by its own text.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import SEED, join_by, marked, parts, read, releasing, run_ranges, stored, text_steps

WINDOW, GRAM, ROWS = 50, 8, 2
#: Cells of a block of the sketch (ROWS rows of them), and the anchors that a block is made for.
CELLS, ANCHORS = 1 << 15, 1 << 13
#: Cells that a task counts before it gives them away.
HELD = 1 << 20
STEP = 512 << 10
U = np.uint64
_STEP = 0xD1342543DE82EF95


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ U(seed)
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


@functools.cache
def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and its inverse mod 2**64, for k below size."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.ones(size, U)
        p[1:] = U(b)
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def sized(n: int) -> int:
    return 1 << max(16, (n + 1).bit_length())


class Words:
    """The words of several texts: a hash of each, the text it is in, and the sums that give digests of word sequences."""

    def __init__(self, texts: list[bytes]):
        words = [t.split() for t in texts]
        self.n = np.fromiter(map(len, words), np.int64, len(words))
        #: number of each text's first word, and one past all
        self.first = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.n)))
        self.text = np.repeat(np.arange(len(texts)), self.n)
        digest = xxhash.xxh3_128_digest
        raw = np.frombuffer(b"".join([digest(w, SEED) for own in words for w in own]), "<u8").reshape(-1, 2)
        #: two independent 64-bit hashes of each word's bytes
        self.hashes = [mix(raw[:, 0], 1), mix(raw[:, 1], 2)]
        self.up, self.down = powers(_STEP, sized(len(self.text)))
        self.sums = [np.concatenate((np.zeros(1, U), np.cumsum(h * self.up[: len(h)], dtype=U))) for h in self.hashes]

    def digest(self, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        """A 64-bit digest of the words from start up to end."""
        d = (self.sums[which][ends] - self.sums[which][starts]) * self.down[starts]
        return mix(d ^ (ends - starts).astype(U), 3 + which)

    def anchors(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first window, last window) of each run of windows that share an occurrence of their anchor."""
        n = len(self.text)
        none = np.zeros(0, np.int64)
        if n < window:
            return none.astype(U), none, none
        at = np.arange(n - gram + 1)
        value = self.digest(at, at + gram, 0)
        place, span, width = at, 1, window - gram + 1
        # least value, and its leftmost place, over 2, 4, 8 ... grams, then over all of a window
        while span * 2 <= width:
            value, place = least(value[:-span], place[:-span], value[span:], place[span:])
            span *= 2
        if rest := width - span:
            value, place = least(value[:-rest], place[:-rest], value[rest:], place[rest:])
        start = np.flatnonzero(self.text[: n - window + 1] == self.text[window - 1 :])
        if not len(start):
            return none.astype(U), none, none
        value, place = value[start], place[start]
        new = np.concatenate(([True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)))
        head = np.flatnonzero(new)
        return value[head], start[head], start[np.append(head[1:], len(start)) - 1]


def least(a, at, b, bt):
    """Pairwise smaller value with its place; the left one of equals."""
    take = b < a
    return np.where(take, b, a), np.where(take, bt, at)


def blocks_of(size: int, window: int, gram: int, anchors: int = ANCHORS) -> int:
    """Blocks of the sketch for texts of so many bytes: one for each `anchors` expected anchors."""
    return max(1, math.ceil(size / 6 * 2 / (window - gram + 2) / anchors))


def block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), "anchor"), F.lit(blocks))


def cells_of() -> list[Column]:
    """An anchor's cell in each row of its block."""
    return [(F.pmod(F.xxhash64(F.lit(r), "anchor"), F.lit(CELLS)) + r * CELLS).cast("int") for r in range(ROWS)]


def texts_of(batch: pa.RecordBatch):
    """Yield (rows, first words, texts): steps of the batch's texts, long ones in parts that overlap by a window; `batch` has text as its last column."""
    for i, texts in text_steps(batch, batch.schema.names[-1], STEP):
        if len(texts) == 1 and len(texts[0]) > STEP:
            for first, part in parts(texts[0], STEP, WINDOW - 1):
                yield np.array([i]), np.array([first]), [part]
        else:
            yield np.arange(i, i + len(texts)), np.zeros(len(texts), np.int64), texts


def anchor_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """docs(doc_id, th, text) -> all anchors: doc_id, th, first and last window, anchor, digest r1, r2 of the region, here: whether the task saw the anchor twice at a time."""

    def scan(batches):
        for batch in batches:
            ids, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows, words_before, texts in texts_of(batch):
                w = Words(texts)
                anchor, s1, s2 = w.anchors(window, gram)
                text = w.text[s1]
                base = w.first[text] - words_before[text]
                _, at, n = np.unique(anchor, return_inverse=True, return_counts=True)
                columns = [ids[rows[text]], th[rows[text]], (s1 - base).astype(np.int32), (s2 - base).astype(np.int32), anchor.view(np.int64), *(w.digest(s1, s2 + window, k).view(np.int64) for k in (0, 1)), n[at] > 1]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "th", "s1", "s2", "anchor", "r1", "r2", "here"])

    return docs.mapInArrow(releasing(scan), "doc_id long, th long, s1 int, s2 int, anchor long, r1 long, r2 long, here boolean")


def sketch(found: DataFrame, blocks: int) -> DataFrame:
    """The merged count-min sketch of found(anchor): block, bits (array of long; a bit for each cell: counted twice or more)."""

    def count(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held += [batch.column(0).to_numpy() * (ROWS * CELLS) + batch.column(1 + r).to_numpy() for r in range(ROWS)]
                size += batch.num_rows
            if size >= HELD:
                yield from given(held)
                held, size = [], 0
        if held:
            yield from given(held)

    def given(held):
        at, n = np.unique(np.concatenate(held), return_counts=True)
        block = at // (ROWS * CELLS)
        edges = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(at)]
        for a in range(0, len(edges) - 1, 256):
            some = list(zip(edges[a : a + 256], edges[a + 1 : a + 257], strict=False))
            cells = [(at[i:j] % (ROWS * CELLS) << 1 | (n[i:j] > 1)).astype("<u4").tobytes() for i, j in some]
            yield pa.RecordBatch.from_arrays([pa.array(block[[i for i, _ in some]]), pa.array(cells, pa.binary())], names=["block", "cells"])

    def merge(batches):
        block, total = None, None
        for batch in batches:
            for b, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != block:
                    if block is not None:
                        yield full(block, total)
                    block, total = b, np.zeros(ROWS * CELLS, np.uint8)
                own = np.frombuffer(own, "<u4")
                at = own >> 1
                total[at] = np.minimum(2, total[at] + 1 + (own & 1).astype(np.uint8))
        if block is not None:
            yield full(block, total)

    def full(block, total):
        bits = np.packbits(total >= 2, bitorder="little").view("<i8").astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bits], pa.list_(pa.int64()))], names=["block", "bits"])

    merged = found.select(block_of(blocks).alias("block"), *(c.alias(f"c{r}") for r, c in enumerate(cells_of()))).mapInArrow(count, "block long, cells binary").repartition("block").sortWithinPartitions("block")
    return merged.mapInArrow(merge, "block long, bits array<long>")


def estimated_repeated(found: DataFrame, bits: DataFrame, blocks: int) -> DataFrame:
    """The rows of found whose anchor the sketch counts twice or more."""
    test = F.lit(True)
    for c in cells_of():
        test = test & (F.getbit(F.element_at("bits", F.shiftright(c, 6) + 1), c.bitwiseAND(63)) == 1)
    out = ("doc_id", "th", "s1", "s2", "anchor", "r1", "r2")
    looked_up = found.where("NOT here").withColumn("block", block_of(blocks)).join(bits.hint("shuffle_hash"), "block").where(test)
    return found.where("here").select(*out).unionByName(looked_up.select(*out))


def occurrences(docs: DataFrame, window: int, gram: int, anchors: int = ANCHORS) -> DataFrame:
    """docs(doc_id, th, text) -> the anchors counted twice or more: doc_id, th, first and last window, anchor, digest r1, r2 of the region."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = blocks_of(size, window, gram, anchors)
    found = stored(anchor_rows(docs, window, gram), "anchors")
    return stored(estimated_repeated(found, stored(sketch(found, blocks), "sketch"), blocks), "repeated")


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, anchors: int = ANCHORS) -> DataFrame:
    """docs(doc_id, th, text), no null ids -> doc_id, th, a, b: ranges of words that repeat a smaller document's windows."""
    region = ["anchor", "r1", "r2"]
    found = occurrences(docs, window, gram, anchors)
    n_found = found.count()
    regions = stored(found.groupBy(*region).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "regions")
    several = stored(regions.groupBy("anchor").agg(F.count("*").alias("regions"), F.min("first").alias("lo"), F.max("first").alias("hi")).where("regions > 1 AND lo < hi").select("anchor", "regions"), "several")
    whole = join_by(found, regions.where("n > 1"), region, "n", n_found)
    whole = whole.where("first < doc_id").select("doc_id", "th", F.col("s1").alias("a"), (F.col("s2") + window).alias("b"))
    # the first documents of regions whose anchor has several
    odd = join_by(regions.drop("n"), several, ["anchor"], "regions", regions.count()).select(*region, F.col("first").alias("doc_id"))
    odd = stored(found.join(odd, [*region, "doc_id"]).select("doc_id", "th", "s1", "s2"), "ranges")
    some, _ = marked(docs, odd, ["doc_id", "th"])
    ranges = odd.groupBy("doc_id", "th").agg(F.collect_list(F.struct("s1", "s2")).alias("ranges"))
    rows = some.join(ranges, ["doc_id", "th"]).select("doc_id", "th", "ranges", "text")
    windows = stored(rows.mapInArrow(windower(window), "doc_id long, th long, at int, w1 long, w2 long"), "windows")
    first = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").select("w1", "w2", "first", "n")
    single = join_by(windows, stored(first, "firsts"), ["w1", "w2"], "n", windows.count())
    return whole.unionByName(single.where("first < doc_id").select("doc_id", "th", F.col("at").alias("a"), (F.col("at") + window).alias("b")))


def windower(window: int):
    def scan(batches):
        for batch in batches:
            ids, th, ranges = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for rows, words_before, texts in texts_of(batch):
                w = Words(texts)
                windows = np.maximum(w.n - window + 1, 0)
                # of each range, the windows that begin in this part of the text
                own = [(k, max(r["s1"], before), min(r["s2"], before + last - 1)) for k, (row, before, last) in enumerate(zip(rows.tolist(), words_before.tolist(), windows.tolist(), strict=True)) for r in ranges[row]]
                text, s1, s2 = (np.array(x, np.int64) for x in zip(*own, strict=True)) if own else (np.zeros(0, np.int64),) * 3
                n = np.maximum(s2 - s1 + 1, 0)
                at, text = np.repeat(s1, n) + run_ranges(n), np.repeat(text, n)
                begin = at - words_before[text] + w.first[text]
                row = rows[text]
                columns = [ids[row], th[row], at.astype(np.int32), *(w.digest(begin, begin + window, k).view(np.int64) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "th", "at", "w1", "w2"])

    return scan


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, anchors: int = ANCHORS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept (the words that stay, joined by a space; binary)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    ranges = stored(repeated_ranges(rows.where("doc_id IS NOT NULL"), window, gram, anchors), "repeats")
    some, others = marked(rows.where("doc_id IS NOT NULL"), ranges, ["doc_id", "th"])
    per = ranges.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("ranges"))
    with_ranges = some.join(per, ["doc_id", "th"], "left").select("doc_id", "ranges", "text")
    none: Column = F.lit(None).cast(per.schema["ranges"].dataType)
    plain = others.unionByName(rows.where("doc_id IS NULL")).select("doc_id", none.alias("ranges"), "text")
    return with_ranges.mapInArrow(remover, KEPT).unionByName(plain.mapInArrow(remover, KEPT))


KEPT = "doc_id long, n_words long, n_removed long, kept binary"


def remover(batches):
    for batch in batches:
        ranges = batch.column(1).to_pylist()
        for i, texts in text_steps(batch, "text", STEP):
            out, removed, n = [], [], []
            for text, own in zip(texts, ranges[i : i + len(texts)], strict=True):
                kept, words, gone = kept_words(text, own or ())
                out.append(kept)
                n.append(words)
                removed.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])


def kept_words(text: bytes, ranges) -> tuple[bytes, int, int]:
    """(the words outside the ranges, sorted by their begin, joined by a space; the number of words; that of removed ones)."""
    joined = []
    for a, b in ((r["a"], r["b"]) for r in ranges):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    done, n, gone, k = [], 0, 0, 0
    for first, part in parts_of_words(text):
        at, last, left = first, first + len(part), []
        while k < len(joined) and joined[k][0] < last:
            a, b = max(joined[k][0], first), min(joined[k][1], last)
            left += part[at - first : a - first]
            gone += b - a
            at = b
            if joined[k][1] > last:
                break
            k += 1
        left += part[at - first :]
        n = last
        if left:
            done.append(b" ".join(left))
    return b" ".join(done), n, gone


def parts_of_words(text: bytes):
    """Yield (number of the first word, words) of parts of a text."""
    n = 0
    for _, part in parts(text, STEP):
        words = part.split()
        yield n, words
        n += len(words)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
f AS (SELECT h, min(doc_id) AS first FROM s GROUP BY h),
r AS (SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT s.doc_id, unnest(range(i, i + {WINDOW})) AS k FROM s JOIN f ON s.h = f.h WHERE f.first < s.doc_id) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept, count(*) AS n FROM (SELECT d.doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) u
      WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(gone) AS g FROM r) z WHERE z.doc_id = u.doc_id AND z.g = u.i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
