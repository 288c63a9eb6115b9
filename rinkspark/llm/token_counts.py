"""Token counts of whole texts, by rank-synchronous merging of ragged arrays (``bpe.Bpe``)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.llm.bpe import bpe_of
from rinkspark.llm.common import text_of

#: The fullest sequence that the report calls within its limit.
LIMIT = 512


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    ``vocabulary`` is the file of a byte-level BPE; it is opened by the workers, so each host has it.
    A NULL text is the empty text: 0 bytes, 0 tokens. Equal rows give equal rows; a NULL id stays NULL.
    No shuffle, no size bound on a text: long ones are read window by window. Other columns are not read.
    """
    narrow = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = pa.array(bpe.counts_of(texts), pa.int64())
            sizes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, n], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    counted = narrow.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
