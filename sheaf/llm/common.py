"""Helpers shared by the training-data operators: shared storage, Arrow iteration, word scanning."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 42
#: UTF-8 bytes of text that one numpy step works on; bounds a worker's memory apart from single long texts.
STEP_BYTES = 4 << 20
SPACES = b"\t\n\v\f\r "
#: Spark/Java pattern of words between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of rows that Spark hands to a Python worker at once, unless the session says otherwise: Arrow buffers stand beside the heap.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hand Python workers batches of BATCH_BYTES, where the session has Spark's own default. The registered queries call it."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB") == str(64 << 20):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all machines share. Where none is set: a temporary folder for a local master, on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not found and sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc._jsc.sc().getCheckpointDir().get()
    if not found and re.match(r"local(\[|$)", sc.master):
        found = "file://" + tempfile.mkdtemp(prefix="sheaf-checkpoint-")
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


#: Paths that stored tables were written to, by application.
_written: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/sheaf-{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean(spark: SparkSession) -> int:
    """Remove the tables that this application's operators wrote to the shared folder; results that weren't written elsewhere go with them."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in map(hadoop, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


#: Rows, about, for which a written copy gets a file.
FILE_ROWS = 1 << 13


def in_files(df: DataFrame, rows: int | None) -> DataFrame:
    """df in a file for each FILE_ROWS of its `rows`, if it would have more: many small files cost more than they hold."""
    return df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and go on from the written copy; its lineage ends there. `rows`: about how many there are at most, if known."""
    shared_dir(df.sparkSession)
    return in_files(df, rows).checkpoint(eager=True)


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Like cut, as compressed Parquet: columns can be pruned and the copy is small."""
    path = shared_path(df.sparkSession, name)
    in_files(df, rows).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc32_mod(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo divisor."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % divisor


def steps(sizes: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with up to `most` bytes together, one row at least."""
    i, n = 0, len(sizes)
    ends = np.cumsum(sizes)
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield i, j
        i = j


def utf8(column: pa.Array) -> pa.Array:
    """A string column as binary, null as empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def text_steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP_BYTES):
    """Yield (first row, texts as bytes) for slices of the batch of about `most` bytes."""
    texts = utf8(batch.column(batch.schema.get_field_index(column)))
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    for i, j in steps(sizes, most):
        yield i, texts.slice(i, j - i).to_pylist()


def table_of_bytes(keep: bytes, lower: bool, rest: int | None = 0x20) -> bytes:
    """A translation that keeps given bytes, lower-cases A-Z if asked, and turns what isn't kept into `rest`."""
    out = bytearray(range(256))
    for b in range(256):
        if b not in keep:
            out[b] = rest
        elif lower and 0x41 <= b <= 0x5A:
            out[b] = b + 32
    return bytes(out)


#: Maximal runs of 0-9, a-z (after lower-casing) and bytes of non-ASCII characters.
ALNUM = table_of_bytes(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]), lower=True)
#: Lower-cases A-Z and changes nothing else.
LOWER = table_of_bytes(bytes(range(256)), lower=True)


def run_ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of lengths, one after the other."""
    total = int(lengths.sum())
    starts = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(starts, lengths)


def hash64(name: str, *columns: Column | str) -> Column:
    return F.xxhash64(F.lit(name), *columns)


_WHITE = re.compile(rb"[\t-\r ]")


def character_end(text: bytes, at: int) -> int:
    """The first place from `at` on where a UTF-8 character begins, or the end."""
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return at


def parts(text: bytes, size: int = 1 << 19, overlap: int = 0, within: bool = False) -> Iterator[tuple[int, bytes]]:
    """A text in parts of about `size` bytes that end where words end: (number of the part's first word, part).

    Each part begins with the last `overlap` words of what came before. A single longer word stays whole, or `within` words too
    parts end after `size` bytes, between characters. A short text is one part, as it is.
    """
    if len(text) <= size:
        yield 0, text
        return
    at, seen, carry = 0, 0, []
    while at < len(text):
        edge = _WHITE.search(text, at + size, at + 2 * size if within else len(text)) if at + size < len(text) else None
        end = edge.start() if edge else character_end(text, at + size) if within else len(text)
        part = text[at:end]
        if overlap:
            words = part.split()
            yield seen - len(carry), b" ".join((*carry, part))
            carry = (carry + words)[-overlap:]
            seen += len(words)
        else:
            yield seen, part
        at = end


def releasing(scan):
    """A function for mapInArrow that, at the end of its batches, gives memory back to the system: workers live on, beside the executor's heap."""

    def run(batches):
        yield from scan(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return run


#: Keys with more than 1 / HEAVY of all rows (and LEAST_HEAVY rows) are joined by broadcast. There are fewer than HEAVY of them, whatever the data.
HEAVY, LEAST_HEAVY = 1 << 16, 10_000


def join_by(rows: DataFrame, per_key: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """rows joined with per_key(keys, n, ...), one row for each key, which n of the `total` rows have; n is left out. per_key should be a written table.

    No task gathers a heavy key's rows: they meet their key, one of HEAVY at most, where they are. Where no key is heavy it is a plain join.
    """
    heavy = F.col(n) > max(LEAST_HEAVY, total // HEAVY)
    if total <= LEAST_HEAVY or per_key.where(heavy).isEmpty():
        return rows.join(per_key.drop(n), keys)
    many, few = per_key.where(heavy).drop(n), per_key.where(~heavy).drop(n)
    names = F.broadcast(many.select(*keys))
    return rows.join(F.broadcast(many), keys).unionByName(rows.join(names, keys, "left_anti").join(few, keys))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Bounds of the bits of a bitmap of rows: 32 MB at most.
LEAST_MARKS, MOST_MARKS = 1 << 20, 1 << 28


def marked(rows: DataFrame, ids: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that may be among ids(*keys), rows that are surely not), without a shuffle of rows: by a bitmap of 8 bits for each id, within bounds.

    Where the bound is reached more rows are told to be looked at; which ones really are among ids is for a join to say.
    """
    n = ids.agg(F.approx_count_distinct(F.struct(*keys))).first()[0]
    size = min(MOST_MARKS, max(LEAST_MARKS, 1 << (8 * n).bit_length()))
    bucket, bits, hit = (fresh(rows, x) for x in ("__bucket", "__bits", "__hit"))
    at = F.pmod(F.xxhash64(F.lit("mark"), *keys), F.lit(size))
    place = at % 32768
    maps = cut(ids.select((at / 32768).cast("int").alias(bucket), place.alias(hit)).groupBy(bucket).agg(F.bitmap_construct_agg(hit).alias(bits)))
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place.cast("int"), 3) + 1, F.lit(1))), 16, 10).cast("int")
    # at most MOST_MARKS / 32768 rows of 4 kB
    met = rows.withColumn(bucket, (at / 32768).cast("int")).join(F.broadcast(maps), bucket, "left")
    met = met.withColumn(hit, F.coalesce(F.getbit(byte, place.cast("int").bitwiseAND(7)) == 1, F.lit(False)))
    return tuple(met.where(F.col(hit) == want).select(*rows.columns) for want in (True, False))
