"""Token counts: an Arrow function that returns lengths only.

Arrow batches are cut by bytes of text, not by rows, so that a few long documents do not make one call
large; each text is split at safe boundaries (see ``encode``) and counts are sums over its pieces.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows
each get a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import byte_chunks, table, text_of, utf8
from tracelake.llm.encode import id_encoder, length_encoder

BATCH_BYTES = 2 << 20
LIMIT = 4096


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    limit: int = LIMIT, batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit for each row.

    ``path``: a sentencepiece model, or a ``tokenizers`` file (``.json``, byte-level).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = id_encoder(path, True) if path.endswith(".json") else length_encoder(path)
        for chunk in byte_chunks(batches, "text", batch_bytes):
            raw, offsets = utf8(chunk.column("text"))
            if path.endswith(".json"):
                lengths = np.diff(encoder(raw, offsets)[1])
            else:
                lengths = np.array([sum(x) for x in encoder(chunk.column("text").to_pylist())], np.int64)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("id"), pa.array(np.diff(offsets)), pa.array(lengths), pa.array(lengths > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
