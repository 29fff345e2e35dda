"""Mixture-controlled packing: deficit round-robin over source queues, planned in closed form.

Every window of ``window`` tokens gives each source its share of the target mixture. A source's deficit
after a window is the fraction of a token that it is still owed; with integer weights w_s of sum W the
tokens that the round-robin has served to sources 1..j after t tokens are floor(t * (w_1 + ... + w_j) / W),
so shares, deficits and places in every window follow from t alone. Deficits thereby carry across windows
and across partitions without any task having to see its predecessor's state. Where a queue runs out, a
new phase begins with the weights of the sources left.

A source's queue is its documents by the partition they are read in, then by place in it. Tokens are
written once (16 bits an id where the vocabulary allows); the rest reads that table. Nothing is shuffled
but one row for each partition and source.

The stream is cut every ``length`` tokens; what is left at the end is cut into powers of two, which need
no padding.

Defined results: a null text is empty and has its end id alone; null sources form one queue; repeated
rows are packed each; an empty table gives no pieces; other columns pass unread.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import byte_chunks, discard, materialise, table, text_of, utf8
from tracelake.llm.encode import MEMO, id_encoder

BATCH_BYTES = 4 << 20
LENGTH = 1024
WINDOW = 64 * LENGTH
#: Rows of partition offsets that may be broadcast (about 50 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 200_000
PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window_id long"


def tokenised(docs: DataFrame, path: str, end_id: int, keeps_space: bool = True, memo: int = MEMO) -> DataFrame:
    """doc_id, source, part, local_start (tokens of the source before it in the partition), n_tokens, ids (binary)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = id_encoder(path, keeps_space, memo)
        part, seen = TaskContext.get().partitionId(), {}
        for chunk in byte_chunks(batches, "text", BATCH_BYTES):
            ids, bounds = encoder(*utf8(chunk.column("text")), end_id)
            sizes, starts = np.diff(bounds), []
            for source, size in zip(chunk.column("source").to_pylist(), sizes.tolist()):
                starts.append(seen.get(source, 0))
                seen[source] = starts[-1] + size
            kind = "<u2" if ids.max() < 65536 else "<u4"
            each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds.astype(np.int64) * int(kind[2])), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), chunk.column("source"), pa.array([part] * len(sizes), pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes), each],
                names=["doc_id", "source", "part", "local_start", "n_tokens", "ids"],
            )

    return docs.mapInArrow(encode, "doc_id long, source string, part long, local_start long, n_tokens long, ids binary")


class Plan:
    """Where the token at place x of a source's queue goes. Integers only."""

    def __init__(self, totals: dict, targets: dict | None = None, window: int = WINDOW, length: int = LENGTH):
        self.window, self.length, self.total = window, length, sum(totals.values())
        left = {s: n for s, n in sorted(totals.items(), key=lambda x: (x[0] is not None, x[0] or "")) if n}
        weight = {s: (int(round(10**9 * targets.get(s, 0))) if targets else n) for s, n in left.items()}
        taken, at = dict.fromkeys(left, 0), 0
        self.phases: list[tuple[int, int, dict, int]] = []  # start, tokens, source -> (before, weight), sum
        self.queue: dict = {s: ([], []) for s in left}  # the source's tokens served before each phase; phases
        while left:
            active = {s: weight[s] for s in left if weight[s]} or dict.fromkeys(left, 1)
            total = sum(active.values())
            if len(active) == len(left) and all(w * sum(left.values()) == left[s] * total for s, w in active.items()):
                tokens = sum(left.values())
            else:
                tokens = min((left[s] - 1) * total // w for s, w in active.items())
                if tokens <= 0:  # the last token of a queue
                    s = min(active, key=lambda s: left[s] * total // active[s])
                    active, total, tokens = {s: 1}, 1, left[s]
            shares, before = {}, 0
            for s, w in active.items():
                shares[s] = (before, w)
                self.queue[s][0].append(taken[s])
                self.queue[s][1].append(len(self.phases))
                before += w
            self.phases.append((at, tokens, shares, total))
            for s, (b, w) in shares.items():
                got = tokens * (b + w) // total - tokens * b // total
                taken[s] += got
                left[s] -= got
                if not left[s]:
                    del left[s]
            at += tokens
        self.tail = self.total - self.total % length

    def place(self, source, x: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(stream place, tokens, window) of tokens x..x+n of the source's queue, in turn."""
        starts, phases = self.queue[source]
        i = bisect.bisect_right(starts, x) - 1
        while n:
            at, tokens, shares, total = self.phases[phases[i]]
            b, w = shares[source]
            size = self.window

            def served(t: int) -> int:
                return t * (b + w) // total - t * b // total

            inner = x - starts[i]
            if inner >= served(tokens):
                i += 1
                continue
            k = inner * total // (w * size)
            while served(min(k * size, tokens)) > inner:
                k -= 1
            while served(min((k + 1) * size, tokens)) <= inner:
                k += 1
            low, high = k * size, min((k + 1) * size, tokens)
            first = served(low)
            many = min(n, served(high) - inner)
            ahead = high * b // total - low * b // total
            yield at + low + ahead + inner - first, many, at + low
            x, n = x + many, n - many

    def cuts(self, g: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(sequence, offset, tokens) of the stream's tokens g..g+n."""
        while n:
            if g < self.tail:
                seq, off = divmod(g, self.length)
                room = self.length - off
            else:
                rest, seq, off = self.total - self.tail, self.tail // self.length, g - self.tail
                bit = 1 << (rest.bit_length() - 1)
                while True:
                    if rest & bit:
                        if off < bit:
                            break
                        off, seq = off - bit, seq + 1
                    bit >>= 1
                room = bit - off
            many = min(n, room)
            yield seq, off, many
            g, n = g + many, n - many


def pack(docs: DataFrame, path: str, end_id: int = 0, targets: dict | None = None, length: int = LENGTH, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_ids: bool = False, memo: int = MEMO) -> DataFrame:
    """One row for each piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, window_id (and ids).

    ``targets``: source -> proportion of tokens; None: the sources' own proportions, so that all queues end together.
    ``memo``: pieces that a Python worker remembers; workers outlive the stage, so it also bounds what later stages find taken.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))
    tokens = materialise(tokenised(rows, path, end_id, memo=memo), "packing-tokens")
    sums = materialise(tokens.groupBy("part", "source").agg(F.sum("n_tokens").alias("n")), "packing-sums")
    totals = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # a row a source
    plan = Plan(totals, targets, window, length)
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("part").alias("p"), F.col("source").alias("s"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    if sums.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    placed = tokens.join(base, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", (F.col("base") + F.col("local_start")).alias("x"), "n_tokens", "ids")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PIECES.split(", ")] + ["ids"] * with_ids
        for chunk in byte_chunks_of_ids(batches):
            out: list[list] = [[] for _ in names]
            for doc, source, x, n, ids in zip(*(chunk.column(c).to_pylist() for c in ("doc_id", "source", "x", "n_tokens", "ids"))):
                values = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4", copy=False)
                start = 0
                for g, many, win in plan.place(source, x, n):
                    for seq, off, size in plan.cuts(g, many):
                        own = values[start : start + size]
                        row = (doc, source, start, size, zlib.crc32(own.data), n, seq, off, win // window)
                        for col, v in zip(out, row):
                            col.append(v)
                        if with_ids:
                            out[-1].append(own.tolist())
                        start += size
            kinds = [pa.int64(), pa.string()] + [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return placed.mapInArrow(pieces, PIECES + ", ids array<int>" * with_ids)


def byte_chunks_of_ids(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Pieces remembered where packing has the executors to itself.
PACKING_MEMO = 1_600_000


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), memo=PACKING_MEMO)
