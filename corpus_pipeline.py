"""The corpus pipeline: documents -> language ID -> near-dedup -> decontamination -> mixing -> token ids.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import decontaminate, langid, mixing, near_copies, simhash, token_store
from sheaf.llm.common import bounded_batches, fresh, read, shared_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or in which no language explains langid.LEAST_SHARE of the words, go."""
    bounded_batches(spark)
    model = langid.fit(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    pred, share = fresh(docs, "__pred"), fresh(docs, "__share")
    found = langid.identify(docs, model, (pred, share))
    return found.where((F.col(pred) != "und") & (F.col(share) >= langid.LEAST_SHARE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies: five-word shingles, a similarity of 0.8 at least."""
    bounded_batches(spark)
    return simhash.keep_first(docs, near_copies.near_copies(docs.select("doc_id", "text")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    bounded_batches(spark)
    new = ("n_words", "hits", "item_ids")
    held = {c: fresh(docs, f"__{c}") for c in docs.columns if c.lower() in new}
    found = decontaminate.decontaminate(docs.withColumnsRenamed(held), read(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.where(F.size("hits") == 0).drop(*new).withColumnsRenamed({v: k for k, v in held.items()}).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in rANS files, and what the files hold: doc_id, start, n_tokens, ids_crc32."""
    bounded_batches(spark)
    import public_tokenizers

    return token_store.token_output(docs.select("doc_id", "text"), public_tokenizers.path(token_store.VOCABULARY))


STAGES = [
    ("language ID", language_id),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID output", token_ids),
]

#: Several stages have no SQL form; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
