"""Token-ID output: documents as token ids in rANS-coded block files, in ascending order of id, and the way back.

1. Each text is encoded by the tokenizers library. Texts are cut at ASCII white space, over which no token of this
   kind of tokenizer reaches, and the different pieces of a few MB of text are looked up in bounded tables; the library encodes each piece that isn't there.
2. The ids are counted over the whole corpus; the counts (a row for each id of the vocabulary) become the shared frequency table.
3. Documents are range-partitioned and sorted by id, and runs of whole documents with about BLOCK_IDS ids become blocks:
   interleaved rANS streams with checkpoints and a checksum (see rans.py). The files are Parquet containers of blocks, so any store that Spark reaches can hold them.

A vocabulary that isn't cut at white space (a pre-tokenizer that keeps spaces) is refused.

Defined cases: null text is empty and gives the end id alone; null ids come first; rows that repeat an id stand next to
each other, in order of a hash of their ids; an empty table gives no files and no rows.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm import rans
from sheaf.llm.common import read, releasing, shared_path, steps, stored

BLOCK_IDS, CACHE = 1 << 19, 600_000
#: Bytes of text that are encoded at once; pre-tokens that the model gets at once, and the characters of the longest of them.
ENCODE_BYTES, CALL, SHORT = 8 << 20, 1024, 64
END_ID, VOCABULARY = 1, "word_bpe_49k.json"
#: Latin letters beyond ASCII, up to U+024F, that lower-case to one letter of this range: the closed set that the pre-tokens below are right for.
BEYOND = "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and len(c.lower()) == 1 and 0xC0 <= ord(c.lower()) < 0x250)
LATIN = f"A-Za-z{BEYOND}"
UNUSUAL = re.compile(f"[^\\x00-\\x7f{LATIN}]")
#: The pre-tokens of PLAIN_SPLIT in lower-cased text of such letters and ASCII.
PIECE = f"('s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^\\t-\\r 0-9{LATIN}]+)"
#: Words that go to the library whole.
OTHER = f"{UNUSUAL.pattern}|<\\|"
#: The settings of the vocabulary file that the pre-tokens above follow from.
PLAIN_SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
PLAIN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}


#: How the library's byte-level models spell bytes, by their number: printable ones of Latin-1 as themselves, the others by the letters from U+0100 on. A space parts words.
OWN_LETTERS = frozenset((*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)))
BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in OWN_LETTERS)}
SPELLED = np.array([b if b == 0x20 else BYTE_LETTERS.get(b, b) for b in range(256)], "<u2")


def spelled(text: str) -> str:
    return SPELLED[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")


@functools.cache
def library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Recent(dict):
    """Keys -> values, which make(keys) gives, kept for the keys asked for lately: when half of `most` are held, those not asked for since the last such turn go."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.before, self.half = make, {}, most // 2

    def of(self, keys: list[str]) -> list[bytes]:
        """The values of different keys."""
        if len(self) > self.half:
            self.before = dict(self)
            self.clear()
        values = list(map(self.get, keys))
        lacking = [i for i, v in enumerate(values) if v is None]
        for i in lacking:
            values[i] = self.before.get(keys[i])
        new = [i for i in lacking if values[i] is None]
        for i, v in zip(new, self.make([keys[i] for i in new]), strict=True):
            values[i] = v
        self.update((keys[i], values[i]) for i in lacking)
        return values


def joined(values: pa.BinaryArray, ends: np.ndarray) -> pa.BinaryArray:
    """Runs of values, each joined to one: run k ends before value ends[k + 1], and ends[0] is 0."""
    at = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at[ends]), values.buffers()[2] or pa.py_buffer(b"")])


def listed(words: pa.StringArray) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


class Pieces:
    """Texts -> their ids, as bytes of the array type `kind`.

    The different words between white space of the texts that are given at once are worked on. Those that have only ASCII and Latin letters are lower-cased
    and cut into the vocabulary's own pre-tokens, of which few are different; the library's model encodes those that aren't known, many at a time, and the library
    any other word as it is.
    """

    def __init__(self, path: str, kind: str, most: int = CACHE):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.kind = library(path), np.dtype(kind).newbyteorder("<")
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        settings = json.load(open(path, encoding="utf-8"))
        self.plain = settings["pre_tokenizer"] == PLAIN_SPLIT and settings["normalizer"] == PLAIN_NORMALIZER
        self.words, self.parts = Recent(self.by_library, most), Recent(self.by_model, most)

    def by_library(self, words: list[str]) -> list[bytes]:
        return [np.array(self.library.encode_batch_fast([w], add_special_tokens=False)[0].ids, self.kind).tobytes() for w in words]

    def by_model(self, parts: list[str]) -> list[bytes]:
        """The ids of pre-tokens of PLAIN_SPLIT, which go to the model as they are, spelled in BYTE_LETTERS: short ones many at a time, long ones alone."""
        short, out = [p for p in parts if 0 < len(p) <= SHORT], []
        for k in range(0, len(short), CALL):
            some = short[k : k + CALL]
            found = self.model.encode(spelled(" ".join(some)), add_special_tokens=False)
            ids = np.array(found.ids, self.kind).tobytes()
            ends = np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(some))) * self.kind.itemsize
            out += [ids[i:j] for i, j in itertools.pairwise((0, *ends.tolist()))]
        each, tokenize = iter(out), self.library.model.tokenize
        return [b"" if not p else next(each) if len(p) <= SHORT else np.array([t.id for t in tokenize(spelled(p))], self.kind).tobytes() for p in parts]

    def plain_ids(self, words: pa.StringArray) -> pa.BinaryArray:
        """The ids of words of ASCII and Latin letters."""
        words = pc.utf8_lower(words)
        mixed = pc.invert(pc.utf8_is_alpha(words))
        cut = pc.split_pattern(pc.replace_with_mask(words, mixed, pc.replace_substring_regex(words.filter(mixed), PIECE, "\\1 ")), " ")
        parts = cut.values.dictionary_encode()
        ids = pa.array(self.parts.of(listed(parts.dictionary)), pa.binary()).take(parts.indices)
        return joined(ids, cut.offsets.to_numpy())

    def ids_of(self, words: pa.StringArray) -> pa.BinaryArray:
        """The ids of different words."""
        other = pc.match_substring_regex(words, OTHER) if self.plain else pa.array(np.ones(len(words), bool))
        odd = words.filter(other)
        if not len(odd):
            return self.plain_ids(words)
        ids = [pa.array(self.words.of(listed(odd)), pa.binary())]
        if len(odd) < len(words):
            ids.append(self.plain_ids(words.filter(pc.invert(other))))
        place = np.empty(len(words), np.int64)
        place[np.argsort(~other.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(words))
        return pa.concat_arrays(ids).take(pa.array(place))

    def encode_column(self, texts: pa.StringArray, end: bytes) -> pa.BinaryArray:
        """The ids of each text, and `end` after them."""
        cut = pc.ascii_split_whitespace(texts)
        words, ends = cut.values.dictionary_encode(), cut.offsets.to_numpy()
        ids = pa.concat_arrays([self.ids_of(words.dictionary), pa.array([end], pa.binary())])
        places = np.insert(words.indices.to_numpy(), ends[1:], len(ids) - 1)
        return joined(ids.take(pa.array(places)), ends + np.arange(len(ends)))

    def encode(self, texts: list[bytes], end: bytes) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.binary()).cast(pa.string()), end).to_pylist()


@functools.cache
def pieces(path: str, kind: str) -> Pieces:
    return Pieces(path, kind)


def runs_of_texts(batches, most: int = ENCODE_BYTES):
    """Batches of doc_id and text -> (ids, texts, null as empty) of about `most` bytes of text, whatever the batches' sizes are."""
    held, size = [], 0
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        sizes = pc.binary_length(texts).to_numpy()
        for i, j in steps(sizes, most):
            held.append((batch.column(0).slice(i, j - i), texts.slice(i, j - i)))
            size += int(sizes[i:j].sum())
            if size >= most:
                yield tuple(map(pa.concat_arrays, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield tuple(map(pa.concat_arrays, zip(*held, strict=True)))


def tokenize(docs: DataFrame, path: str, end_id: int | None = END_ID) -> tuple[DataFrame, str, int]:
    """docs(doc_id, text) -> (rows (doc_id long, ids binary), numpy type of the ids, size of the vocabulary)."""
    size = library(path).get_vocab_size(with_added_tokens=True)
    probe = [x.ids for x in library(path).encode_batch(["a b", "a  \n b", "a", "b"], add_special_tokens=False)]
    if probe[0] != probe[1] or probe[0] != probe[2] + probe[3]:
        raise ValueError("this tokenizer has tokens that reach over white space")
    kind = "<u2" if size <= 1 << 16 else "<u4"
    end = np.array([] if end_id is None else [end_id], kind).tobytes()
    code = "H" if size <= 1 << 16 else "I"

    def scan(batches):
        coder = pieces(path, code)
        for docs, texts in runs_of_texts(batches):
            ids = coder.encode_column(texts, end)
            for i, j in steps(pc.binary_length(ids).to_numpy(), 1 << 20):
                yield pa.RecordBatch.from_arrays([docs.slice(i, j - i), ids.slice(i, j - i)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(scan), "doc_id long, ids binary"), kind, size


def count_ids(rows: DataFrame, kind: str, size: int) -> np.ndarray:
    """Occurrences of each id of the vocabulary over all rows(ids)."""

    def scan(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(all_ids(batch.column(0), kind), minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for row in rows.select("ids").mapInArrow(scan, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row.id] = row.n
    return out


def all_ids(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


BLOCK_SCHEMA = T.StructType([
    T.StructField(c, t) for c, t in (
        ("part", T.LongType()), ("block", T.LongType()), ("offset", T.LongType()), ("doc_ids", T.ArrayType(T.LongType())), ("lengths", T.ArrayType(T.LongType())),
        ("lanes", T.IntegerType()), ("words", T.BinaryType()), ("places", T.ArrayType(T.LongType())), ("states", T.ArrayType(T.BinaryType())), ("checksum", T.LongType()),
    )
])


def encode_blocks(rows: DataFrame, table: rans.Table, kind: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """rows(doc_id, ids), any order -> blocks in ascending order of doc_id."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    # rows that repeat an id may be dealt over several parts
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]
    width = np.dtype(kind).itemsize

    def scan(batches):
        table, part, number, offset = shared.value, TaskContext.get().partitionId(), 0, 0
        held_ids, held, size = [], [], 0

        def block():
            nonlocal number, offset, held_ids, held, size
            ids = np.frombuffer(b"".join(held), kind)
            b = rans.encode(ids, table)
            row = [part, number, offset, held_ids, [len(x) // width for x in held], b.lanes, b.words, [p for p, _ in b.checkpoints], [s for _, s in b.checkpoints], b.checksum]
            number, offset, held_ids, held, size = number + 1, offset + b.n, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, ARROW, strict=True)], names=BLOCK_SCHEMA.names)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held_ids.append(doc)
                held.append(ids)
                size += len(ids) // width
                if size >= block_ids:
                    yield block()
        if held:
            yield block()

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(releasing(scan), BLOCK_SCHEMA)


ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.int64()]


def blocks_of(batch: pa.RecordBatch):
    """Yield (row, Block) of a batch of block rows."""
    for row in batch.to_pylist():
        yield row, rans.Block(sum(row["lengths"]), row["lanes"], row["words"], list(zip(row["places"], row["states"], strict=True)), row["checksum"])


def sections(block: rans.Block, table: rans.Table):
    """The ids of a block, from checkpoint to checkpoint: each section is decoded on its own."""
    for k in range(len(block.checkpoints)):
        yield rans.decode(block, table, k, k + 1).astype("<u4")


def checksums(parts, lengths: list[int], whole: int, kept: list | None = None) -> list[int]:
    """crc32 of the ids of each document of a block, of which parts come one by one; an error if the block's own isn't `whole`."""
    out, crc, total, k, left = [], 0, 0, 0, lengths[0] if lengths else 0
    for ids in parts:
        if kept is not None:
            kept.append(ids.astype(np.int64))
        raw, at = memoryview(ids.tobytes()), 0
        total = zlib.crc32(raw, total)
        while k < len(lengths) and (left <= (len(raw) - at) // 4):
            crc = zlib.crc32(raw[at : at + 4 * left], crc)
            at += 4 * left
            out.append(crc)
            k, crc = k + 1, 0
            left = lengths[k] if k < len(lengths) else 0
        if at < len(raw):
            crc = zlib.crc32(raw[at:], crc)
            left -= (len(raw) - at) // 4
    out += [0] * (len(lengths) - len(out))  # documents without ids at the end
    if total != whole:
        raise ValueError("checksum of a block of ids doesn't match")
    return out


def write_corpus(docs: DataFrame, vocabulary: str, path: str, end_id: int | None = END_ID) -> rans.Table:
    """Encode docs(doc_id, text) with the tokenizer file and write the block files to path. -> the shared frequency table"""
    spark = docs.sparkSession
    rows, kind, size = tokenize(docs, vocabulary, end_id)
    rows = stored(rows, "ids")
    table = rans.Table.of(count_ids(rows, kind, size))
    spark.createDataFrame([(table.precision, table.freq.astype("<u4").tobytes(), kind)], "precision int, freq binary, kind string").coalesce(1).write.parquet(f"{path}/table")
    encode_blocks(rows, table, kind).write.option("compression", "none").parquet(f"{path}/blocks")
    return table


def read_table(spark: SparkSession, path: str) -> rans.Table:
    row = spark.read.parquet(f"{path}/table").first()
    freq = np.frombuffer(bytes(row.freq), "<u4").astype(np.int64)
    return rans.Table(row.precision, freq.astype(rans.U), (np.cumsum(freq) - freq).astype(rans.U), np.repeat(np.arange(len(freq), dtype=np.uint32), freq))


def read_corpus(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode the block files: doc_id, start, n_tokens, ids_crc32, and ids (array) if asked."""
    shared = spark.sparkContext.broadcast(read_table(spark, path))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    # one row per part: how many ids come before it
    lengths = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = blocks.select("part", F.when(F.col("block") == 0, F.col("doc_ids")[0]).alias("first"), F.when((F.col("block") == 0) & F.col("doc_ids")[0].isNull(), 1).alias("null_first"), lengths.alias("n"))
    parts = parts.groupBy("part").agg(F.min("first").alias("first"), F.max("null_first").alias("null_first"), F.sum("n").alias("n"))
    order = Window.orderBy(F.col("null_first").desc_nulls_last(), "first", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))

    def scan(batches):
        table = shared.value
        for batch in batches:
            for row, block in blocks_of(batch):
                kept = [] if with_ids else None
                crc = checksums(sections(block, table), row["lengths"], block.checksum, kept)
                n = np.array(row["lengths"], np.int64)
                ends = np.cumsum(n)
                out = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(n), pa.int64()), pa.array(row["offset"] + ends - n), pa.array(n), pa.array(crc, pa.int64())]
                if with_ids:
                    ids = np.concatenate([np.zeros(0, np.int64), *kept])
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(out, names=names)

    names = ["doc_id", "part", "within", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    rows = blocks.mapInArrow(releasing(scan), "doc_id long, part long, within long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return rows.join(parts, "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"), *names[3:])


def token_output(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """Write docs to block files and read them back."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "corpus")
    write_corpus(docs, vocabulary, path, end_id)
    return read_corpus(spark, path)


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(VOCABULARY))
