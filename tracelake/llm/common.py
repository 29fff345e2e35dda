"""Helpers shared by the corpus operators: inputs, shared work folders and Arrow text access."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str, **options: str) -> DataFrame:
    return spark.read.options(**options).parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The cluster names the folder in ``spark.checkpoint.dir``; only where that is unset (one machine,
    as in tests) a temporary folder is made and remembered in the session.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tracelake-")
        spark.conf.set(CHECKPOINT_KEY, base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: While a table is written: shuffle files go once they are read, and Python workers get batches of at most 8 MB, whatever the texts' lengths.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def materialise(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut and lost executors cost nothing.

    What was shuffled for it is not needed once it is written.
    """
    spark, path = df.sparkSession, work_path(df.sparkSession, label)
    before = {key: spark.conf.get(key, None) for key in WRITING}
    try:
        for key, value in WRITING.items():
            spark.conf.set(key, value)
        df.select("*").write.option("compression", codec).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the tables of ``materialise`` that ``df`` reads, once nothing else reads them."""
    spark = df.sparkSession
    for folder in sorted({file.rsplit("/", 1)[0] for file in df.inputFiles()}):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(col: str = "text"):
    """The column as a string, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_1``, ``name_2``, ... that ``df`` has not (names compare without case)."""
    taken, out, k = {c.lower() for c in df.columns}, name, 0
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets into them; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each holds about ``limit`` bytes of ``text`` (one row at least)."""
    for batch in batches:
        _, offsets = utf8(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; bijective."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RANDOM = np.random.default_rng(20240229)
_BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    known = _POWERS.get(name)
    if known is None or len(known) < n:
        values = np.full(max(n, 1 << 16), np.uint64(base % 2**64))
        values[0] = 1
        known = _POWERS[name] = np.multiply.accumulate(values)
    return known[:n]


def rolling(raw: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """Prefix sums C such that (C[j] - C[i]) * inverse_power(i) depends on the bytes i..j alone."""
    values = _BYTE_VALUES if fold is None else _BYTE_VALUES[fold]
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * _powers("up", _BASE, len(raw)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes start..stop of the text behind ``prefix``."""
    down = _powers("down", pow(_BASE, -1, 2**64), len(prefix))
    return mix64((prefix[stop] - prefix[start]) * down[start])


def ascii_lower() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and stops of the maximal runs of word bytes, and for each text the index of its first word (n+1)."""
    flag = is_word[raw]
    if not len(flag):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(flag) + 1, bool)
    edge[offsets] = True
    start = flag.copy()
    start[1:] &= ~flag[:-1] | edge[1:-1]
    stop = flag.copy()
    stop[:-1] &= ~flag[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def word_codes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, key: bytes) -> np.ndarray:
    """64-bit keyed hashes of the words start..stop; words are told apart by their bytes, each distinct one is hashed once."""
    words = spans(raw, start, stop).dictionary_encode()
    codes = b"".join([hashlib.blake2b(w, digest_size=8, key=key).digest() for w in words.dictionary.to_numpy(zero_copy_only=False)])
    return np.frombuffer(codes, np.uint64)[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)


def spans(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The bytes of the ascending, disjoint spans start..stop as an Arrow array."""
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[start] += 1
    edge[stop] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    ends = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(raw[inside])])


def keyed_multipliers(key: bytes, n: int) -> list[np.uint64]:
    """Odd 64-bit numbers that follow from ``key``."""
    return [np.uint64(int.from_bytes(hashlib.blake2b(bytes([j % 256, j // 256]), digest_size=8, key=key).digest(), "little") | 1) for j in range(n)]


def let(value, body):
    """``body`` of a value that is computed once: a lambda variable holds it."""
    return F.element_at(F.transform(F.array(value), body), 1)
