"""Token counts of documents by a compiled finite-state tokenizer (see transducer.py).

Defined cases: null text is empty and has 0 bytes and tokens; texts of any length are read in pieces; repeated rows are
counted each; the vocabulary has to be a byte-level BPE file whose merges are all different.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sheaf.llm.common import read, text_steps, utf8

LIMIT, VOCABULARY = 512, "byte_bpe_50k.json"


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """docs with text, and three columns more: n_bytes, n_tokens, over_limit."""
    new = ("n_bytes", "n_tokens", "over_limit")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def scan(batches):
        from sheaf.llm.transducer import count_tokens, counter

        c = counter(vocabulary)
        for batch in batches:
            n = [k for _, texts in text_steps(batch, "text") for k in count_tokens(texts, c).tolist()]
            size = pc.binary_length(utf8(batch.column(batch.schema.get_field_index("text")))).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, size, pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], names=schema.names)

    return docs.mapInArrow(scan, schema)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path(VOCABULARY)).select("doc_id", "n_bytes", "n_tokens", "over_limit")
