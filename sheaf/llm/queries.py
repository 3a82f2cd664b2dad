"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import conversations, decontaminate, forest, langid, line_dedup, mixing, simhash, substring_dedup, token_count, token_store, topk, toxicity, whitening
from sheaf.llm.common import bounded_batches

def prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """query, with batches for Python workers that their memory bears."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: prepared(f)
    for f in (
        line_dedup.op1_line_dedup,
        toxicity.op2_toxicity,
        token_count.op3_token_counts,
        topk.op4_exact_topk,
        decontaminate.op5_benchmark_decontamination,
        substring_dedup.op6_substring_dedup,
        token_store.op7_token_output,
        simhash.op8_simhash_near_dedup,
        mixing.op9_mixing,
        langid.op10_language_id,
        whitening.op11_embedding_whitening,
        conversations.op12_conversation_repair,
        forest.op13_minhash_near_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op4_exact_topk": topk.SQL,
    "op5_benchmark_decontamination": decontaminate.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op12_conversation_repair": conversations.SQL,
    "op13_minhash_near_dedup": forest.SQL,
}
