"""Search that doesn't read everything: texts in blocks, with a posting index of their trigrams.

A store has its texts in blocks of about `block_bytes`, by path, one folder each, and for every trigram the places, within blocks, of the files that have it,
sorted by trigram. What a regular expression needs its texts to hold (`required`) is looked up there, the lists are intersected and united within each
block, and only blocks with a file left are read; the expression itself then decides. So results are those of a scan.

Trigrams are of three characters of one line, in the folding by which Java's (?iu) compares characters; characters outside of the basic plane and control characters
have none. Patterns that need no trigram, or that Python's parser doesn't read as Java does, get a scan of all blocks.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cache
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 64 << 20
#: Strings that a part of a pattern may stand for before it is cut; trigrams asked for at once; files of candidates that are joined by broadcast.
MOST_STRINGS, MOST_GRAMS, MOST_FILES = 64, 24, 1 << 20
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
#: Entries of postings that a task holds.
HELD = 1 << 20
#: Syntax that Java and Python read differently, or that changes what follows.
DIFFERENT = re.compile(r"&&|\[[^\]]*\[|\\0|\\N|\\v|\(\?[a-zA-Z]*x|\\Q|\\h|\\k")


@cache
def folding() -> np.ndarray:
    """For each character of the basic plane the one it is compared as: upper case, then lower case, where these are single characters; 0 for none."""
    out = np.zeros(1 << 16, np.uint32)
    for c in range(32, 1 << 16):
        if not 0x7F <= c < 0xA0 and not 0xD800 <= c < 0xE000:
            upper = chr(c).upper()
            upper = upper if len(upper) == 1 else chr(c)
            lower = upper.lower()
            out[c] = ord(lower) if len(lower) == 1 and ord(lower) < 1 << 16 else ord(upper) if ord(upper) < 1 << 16 else c
    out[0x130] = ord("i")  # the one letter whose single lower case Python gives as two
    return out


def grams_of(text: str) -> np.ndarray:
    """The different trigrams of a text as numbers, sorted."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = np.where(code < 1 << 16, folding()[np.minimum(code, 0xFFFF)], 0).astype(np.int64)
    if len(folded) < 3:
        return np.zeros(0, np.int64)
    a, b, c = folded[:-2], folded[1:-1], folded[2:]
    return np.unique((a << 32 | b << 16 | c)[(a > 0) & (b > 0) & (c > 0)])


# --- what a pattern requires
# A formula is a trigram, ("and", formulas) or ("or", formulas); ("and", ()) is always true.
ANY = ("and", ())


def both(parts: list) -> tuple | int:
    flat = [q for p in parts for q in (p[1] if isinstance(p, tuple) and p[0] == "and" else (p,))]
    flat = tuple(dict.fromkeys(flat))
    return flat[0] if len(flat) == 1 else ("and", flat)


def either(parts: list) -> tuple | int:
    parts = tuple(dict.fromkeys(parts))
    return ANY if ANY in parts else parts[0] if len(parts) == 1 else ("or", parts)


class Reader:
    """Reads a parsed pattern: the strings that its present run of characters may be, and what has been required so far."""

    def __init__(self):
        self.strings, self.needs = {""}, []

    def cut(self) -> None:
        """The run ends here: one of its strings must be in the text."""
        if all(len(s) >= 3 for s in self.strings):
            self.needs.append(either([both([int(g) for g in grams_of(s)]) for s in sorted(self.strings)]))
        self.strings = {""}

    def add(self, choices: set[str] | None) -> None:
        """The next characters are one of choices; None: anything."""
        if not choices:
            self.cut()
        else:
            if len(self.strings) * len(choices) > MOST_STRINGS:
                self.cut()
            if len(choices) <= MOST_STRINGS:
                self.strings = {s + c for s in self.strings for c in choices}

    def read(self, items) -> Reader:
        for op, value in items:
            if op is sre.LITERAL:
                self.add({folded(value)} if folded(value) else None)
            elif op is sre.IN:
                self.add(members(value))
            elif op is sre.SUBPATTERN:
                self.read(value[3])
            elif op is sre.ATOMIC_GROUP:
                self.read(value)
            elif op is sre.BRANCH:
                self.branch(value[1])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
                least, most, inner = value
                if least:
                    self.read(inner)
                if (least, most) != (1, 1):
                    self.cut()
            elif op not in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):  # these take no characters
                self.cut()
        return self

    def branch(self, ways) -> None:
        readers = [Reader().read(way) for way in ways]
        if all(exact(way) for way in ways) and not any(r.needs for r in readers) and sum(len(r.strings) for r in readers) <= MOST_STRINGS // 4:
            self.add(set().union(*(r.strings for r in readers)))
            return
        self.cut()
        for r in readers:
            r.cut()
        self.needs.append(either([both(r.needs) for r in readers]))


def exact(items) -> bool:
    """Whether a sequence stands for literal characters and small sets of them alone."""
    return all(op is sre.LITERAL and folded(v) or op is sre.IN and members(v) or op is sre.SUBPATTERN and exact(v[3]) for op, v in items)


def folded(code: int) -> str:
    """The character that one is compared as; empty if it has no trigrams."""
    return chr(folding()[code]) if code < 1 << 16 and folding()[code] else ""


def members(items) -> set[str] | None:
    """The characters of a small class; None for others."""
    out = set()
    for op, value in items:
        codes = [value] if op is sre.LITERAL else range(value[0], value[1] + 1) if op is sre.RANGE and value[1] - value[0] < 16 else [-1]
        for c in codes:
            if c < 0 or not folded(c):
                return None
            out.add(folded(c))
    return out if len(out) <= 16 else None


def required(pattern: str):
    """The formula of trigrams that hold in every line in which the pattern, read as (?iu), is found; ANY if there is none to be had."""
    if DIFFERENT.search(pattern):
        return ANY
    try:
        parsed = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return ANY
    if parsed.state.flags & re.VERBOSE:
        return ANY
    reader = Reader().read(parsed)
    reader.cut()
    return thinned(both(reader.needs))


def thinned(formula):
    """The formula with MOST_GRAMS trigrams at most: of what all have to hold, some evenly chosen ones will do."""
    if not isinstance(formula, tuple):
        return formula
    op, parts = formula
    if op == "or":
        parts = tuple(thinned(p) for p in parts)
        return ANY if len(names_of((op, parts))) > 4 * MOST_GRAMS else (op, parts)
    grams, rest = [p for p in parts if not isinstance(p, tuple)], [thinned(p) for p in parts if isinstance(p, tuple)]
    step = max(1, math.ceil(len(grams) / MOST_GRAMS))
    return both([*grams[::step], *rest])


def names_of(formula) -> list[int]:
    """The trigrams of a formula."""
    return sorted({g for p in formula[1] for g in names_of(p)}) if isinstance(formula, tuple) else [formula]


def places(formula, lists: dict[int, Column]) -> Column:
    """The places within a block that a formula leaves, of the lists of its trigrams."""
    if not isinstance(formula, tuple):
        return lists[formula]
    parts = [places(p, lists) for p in formula[1]]
    out = parts[0]
    for p in parts[1:]:
        out = F.array_intersect(out, p) if formula[0] == "and" else F.array_union(out, p)
    return out


# --- the store
BLOCKS, GRAMS = "block int, n_files long, n_bytes long", "gram long, block int, places array<long>"


@dataclass
class TextStore:
    """A store written by write_store: path, and its session."""

    spark: SparkSession
    root: str

    def texts(self) -> DataFrame:
        """block int, place long, path string, content string, and what other columns the files had."""
        schema = self.spark.read.parquet(f"{self.root}/schema").schema
        return self.spark.read.schema(schema).parquet(f"{self.root}/texts")

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCKS).parquet(f"{self.root}/blocks")

    def candidates(self, formula) -> DataFrame:
        """(block, places array<long>) of files that a formula leaves; the trigrams are pushed down to the sorted postings."""
        grams = names_of(formula)
        rows = self.spark.read.schema(GRAMS).parquet(f"{self.root}/grams").where(F.col("gram").isin(grams))
        per = rows.groupBy("block").agg(*(F.flatten(F.collect_list(F.when(F.col("gram") == g, F.col("places")))).alias(f"g{g}") for g in grams))
        return per.select("block", F.array_distinct(places(formula, {g: F.col(f"g{g}") for g in grams})).alias("places")).where(F.size("places") > 0)

    def matching(self, pattern: str) -> DataFrame:
        """The texts among which all are that a line matching the pattern is in: blocks without a candidate aren't read."""
        formula = required(pattern)
        if formula == ANY:
            return self.texts()
        found = self.candidates(formula)
        # one row for each block of the store
        sizes = {r.block: r.n for r in found.select("block", F.size("places").alias("n")).collect()}
        texts = self.texts().where(F.col("block").isin(sorted(sizes)))
        if sum(sizes.values()) > MOST_FILES:
            return texts
        return texts.join(F.broadcast(found.select("block", F.explode("places").alias("place"))), ["block", "place"], "left_semi")

    def share_read(self, pattern: str) -> DataFrame:
        """One row: blocks and bytes of the store, and those of the blocks that a search for the pattern reads; files left as candidates (null: a scan)."""
        formula = required(pattern)
        blocks = self.blocks()
        if formula == ANY:
            met = blocks.select("*", F.lit(True).alias("hit"), F.lit(None).cast("long").alias("n"))
        else:
            met = blocks.join(self.candidates(formula).select("block", F.size("places").cast("long").alias("n"), F.lit(True).alias("hit")), "block", "left")
        return met.agg(F.count("*").alias("n_blocks"), F.count("hit").alias("blocks_read"), F.sum("n_bytes").alias("n_bytes"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n_bytes"))), F.lit(0)).alias("bytes_read"), F.sum("n").alias("candidates"))


def write_store(files: DataFrame, root: str, block_bytes: int = BLOCK_BYTES) -> TextStore:
    """Write files(path, content, ...) as a store below root. Null contents are kept and match nothing."""
    spark = files.sparkSession
    size = files.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    rows = files.drop("block", "place").repartitionByRange(blocks, "path").sortWithinPartitions("path")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the row's number within its partition
    rows = rows.withColumns({"block": F.spark_partition_id(), "place": place})
    spark.createDataFrame([], rows.schema).coalesce(1).write.mode("overwrite").parquet(f"{root}/schema")
    rows.write.mode("overwrite").partitionBy("block").parquet(f"{root}/texts")
    store = TextStore(spark, root)
    texts = store.texts()
    texts.groupBy("block").agg(F.count("*").alias("n_files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("n_bytes")).write.mode("overwrite").parquet(f"{root}/blocks")
    # texts are handed to Python workers a few MB at a time; the session's own setting comes back
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        postings(texts).repartitionByRange("gram").sortWithinPartitions("gram", "block").write.mode("overwrite").parquet(f"{root}/grams")
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return store


def postings(texts: DataFrame) -> DataFrame:
    """texts(block, place, content) -> gram, block, places: what a task has of each trigram, HELD entries at a time."""

    def given(held):
        gram = np.concatenate([own for own, _, _ in held])
        sizes = [len(own) for own, _, _ in held]
        # texts come in order of block and place, which a stable sort keeps
        order = np.argsort(gram, kind="stable")
        gram = gram[order]
        block = np.repeat(np.array([b for _, b, _ in held], np.int32), sizes)[order]
        place = np.repeat(np.array([p for _, _, p in held], np.int64), sizes)[order]
        edge = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (block[1:] != block[:-1]))))
        for a in range(0, len(edge), 1 << 14):
            own = edge[a : a + (1 << 14)]
            end = edge[a + (1 << 14)] if a + (1 << 14) < len(edge) else len(gram)
            lists = pa.ListArray.from_arrays(pa.array(np.append(own, end) - own[0], pa.int32()), pa.array(place[own[0] : end]))
            yield pa.RecordBatch.from_arrays([pa.array(gram[own]), pa.array(block[own]), lists], names=["gram", "block", "places"])

    def scan(batches):
        held, size = [], 0
        for batch in batches:
            for block, place, text in zip(*batch.columns, strict=True):
                own = grams_of(text.as_py() or "")
                if len(own):
                    held.append((own, block.as_py(), place.as_py()))
                    size += len(own)
                if size > HELD:
                    yield from given(held)
                    held, size = [], 0
        if held:
            yield from given(held)

    return texts.select("block", "place", "content").mapInArrow(scan, GRAMS)
