"""Token-id output as ORC: run-length encoded ids, row indexes and Bloom filters on document ids.

Documents are range-partitioned by id before they are encoded, so that only text is shuffled and each
task writes its range in order. A reader prunes stripes by the row index and the Bloom filter of the id
column and reads stripes in parallel. The start of a document in the whole sequence of ids is the sum of
its file's predecessors (one number a file) and a running sum within its file.

Defined results: a null text is empty and has the end id alone; a null id sorts first; rows that repeat an
id stay, in the order of their texts' hashes; an empty table gives no rows; other columns are not written.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import byte_chunks, table, text_of, utf8, work_path
from tracelake.llm.encode import id_encoder

BATCH_BYTES = 4 << 20
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1000
SCHEMA = "doc_id long, n_tokens long, ids array<int>"


def encoded(docs: DataFrame, path: str, end_id: int, keeps_space: bool, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_tokens and ids (with ``end_id``) of each row of ``docs`` (doc_id, text), in the rows' order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = id_encoder(path, keeps_space)
        for chunk in byte_chunks(batches, "text", batch_bytes):
            ids, bounds = encoder(*utf8(chunk.column("text")), end_id)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(np.diff(bounds)), lists], names=["doc_id", "n_tokens", "ids"])

    return docs.mapInArrow(encode, SCHEMA)


def write_token_ids(
    docs: DataFrame, target: str, path: str, end_id: int, keeps_space: bool,
    id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None,
) -> None:
    """Writes the ids of every text to ORC files under ``target`` in ascending order of ``id_col``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # hashes and places of reading split an id that many rows have; rows of one id and text are alike, so their order is free
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), F.spark_partition_id().alias("p"))
    placed = keyed.repartitionByRange(parts, "doc_id", "h", "p").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    (
        encoded(placed, path, end_id, keeps_space)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", INDEX_ROWS)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(target)
    )


def read_token_ids(spark: SparkSession, target: str, doc_ids: list[int] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids from the files; the filters reach the ORC reader, which skips stripes and row groups."""
    df = spark.read.schema(SCHEMA).orc(target)
    if doc_ids is not None:
        df = df.filter(F.col("doc_id").isin(doc_ids))
    if low is not None:
        df = df.filter(F.col("doc_id") >= low)
    if high is not None:
        df = df.filter(F.col("doc_id") <= high)
    return df


def part_number(file: str) -> int:
    """The number of a part file; names alone do not sort by it beyond five digits."""
    found = re.match(r"part-(\d+)", file)
    return int(found[1]) if found else -1


def token_layout(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the ids read back from ``target``."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(ids[a:b].data) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("row"), batch.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(np.array(crc, np.int64))],
                names=["file", "row", "doc_id", "n_tokens", "ids_crc32"],
            )

    stored = read_token_ids(spark, target)
    # one number a file: bounded by the files, not by the documents
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    sums = stored.groupBy(name.alias("file")).agg(F.sum("n_tokens").alias("n")).collect()
    before, base = 0, []
    for file, n in sorted(sums, key=lambda r: (part_number(r["file"]), r["file"])):  # part numbers ascend with the ranges of ids
        base.append((file, before))
        before += n
    bases = spark.createDataFrame(base, "file string, base long")
    rows = stored.select(name.alias("file"), F.monotonically_increasing_id().alias("row"), "doc_id", "ids").mapInArrow(
        digest, "file string, row long, doc_id long, n_tokens long, ids_crc32 long"
    )
    ahead = Window.partitionBy("file").orderBy(F.asc_nulls_first("doc_id"), "row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)))
        .join(F.broadcast(bases), "file")
        .select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
    )


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    target = work_path(spark, "token-ids")
    write_token_ids(table(spark, sf_dir, "documents"), target, public_tokenizers.path("word_bpe_49k.json"), 1, False)
    return token_layout(spark, target)
