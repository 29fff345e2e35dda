"""Benchmark decontamination by suffix arrays over shards of documents.

A shard is a slice of a partition of about ``SHARD_BYTES`` of text. Its words become numbers in the
benchmark's vocabulary; a suffix can only match a window if it begins with as many words in a row, each
pair of neighbours known to the benchmark, as the shortest window has, so only such suffixes are sorted.
The array is sorted to the depth of a window. Every benchmark suffix that holds a whole window is looked
up by binary search; the range of the suffix array that it finds are its places in the shard, and each
match is followed to its full length. Documents are never shuffled: a match does not cross documents.

The benchmark is a stated query set. It is broadcast in blocks of at most ``BLOCK_BYTES``; a larger one
takes more passes over the documents, and each pass but the last is written. Words are told apart by their bytes.

Words: ASCII letters are lower-cased; a word is a run of letters, digits and bytes over 0x7F.
Defined results: null or empty text has no words, no hits and is clean; an item without words never
matches; an item of null id is searched and hits like any other, but the list of items leaves it out; repeated rows are judged each; empty tables give no rows or no hits; other columns are kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import ascii_lower, byte_chunks, free_name, materialise, spans, table, text_of, utf8, word_spans

WINDOW = 13
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 32 << 20

_FOLD = ascii_lower()
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words, the number of each word among them, and the first word of each text (n+1)."""
    start, stop, first = word_spans(raw, offsets, _IS_WORD)
    coded = spans(_FOLD[raw], start, stop).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64), first


class Queries:
    """The suffixes of benchmark items that hold a window, as keys for binary search."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        raw, offsets = utf8(pa.array([text for _, text in items], pa.large_string()))
        known, ids, first = _words(raw, offsets)
        self.vocabulary = {w: k + 1 for k, w in enumerate(known)}
        self.ids = np.append(ids + 1, 0)
        self.ends = first[1:]
        self.window = window
        pairs = self.ids[:-2] * (len(self.vocabulary) + 1) + self.ids[1:-1]
        inside = np.ones(max(len(self.ids) - 1, 0), bool)
        inside[first[1:][first[1:] > 0] - 1] = False  # an item's last word has no successor
        self.pairs = np.unique(pairs[inside[: len(pairs)]]) if len(pairs) else np.zeros(0, np.int64)
        rows = []  # item, place in the item's words, words of the window
        for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
            if b > a:
                rows += [(k, p, min(window, b - a)) for p in range(a, max(a, b - window) + 1)]
        self.item, self.place, size = (np.array(x, np.int64) for x in (zip(*rows) if rows else ((), (), ())))
        keys = self._keys(self.ids, self.place, size)
        self.keys, self.same = np.unique(keys, return_inverse=True) if len(keys) else (keys, np.zeros(0, np.int64))
        self.order = np.argsort(self.same, kind="stable")
        self.group = np.searchsorted(self.same[self.order], np.arange(len(self.keys) + 1))
        self.size = np.zeros(len(self.keys), np.int64)
        self.size[self.same] = size
        self.least = int(size.min()) if len(size) else 0
        upper = np.frombuffer(self.keys.tobytes(), np.uint8).reshape(len(self.keys), 4 * window).copy()
        upper[np.arange(4 * window)[None, :] >= 4 * self.size[:, None]] = 255
        self.upper = upper.view(f"S{4 * window}").ravel() if len(upper) else self.keys

    def _keys(self, ids: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The first ``window`` numbers of each suffix, at most ``size`` of them, big-endian and side by side."""
        steps = np.arange(self.window)
        at = np.minimum(place[:, None] + steps[None, :], len(ids) - 1)
        out = np.where(steps[None, :] < size[:, None], ids[at], 0).astype(">u4")
        return np.ascontiguousarray(out).view(f"S{4 * self.window}").ravel() if len(out) else np.zeros(0, f"S{4 * self.window}")

    def search(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[set[str]], np.ndarray]:
        """First word of each text (n+1), which words are hit, the items of each text, and its longest match:
        words, item, first word in the text, first word in the item (-1 where none)."""
        known, words, first = _words(raw, offsets)
        n, docs = len(words), len(offsets) - 1
        items: list[set[str]] = [set() for _ in range(docs)]
        best = np.full((docs, 4), -1, np.int64)
        best[:, 0] = 0
        if not n or not len(self.keys):
            return first, np.zeros(n, bool), items, best
        ids = np.append(np.array([self.vocabulary.get(w, 0) for w in known], np.int64)[words], 0)
        last = np.zeros(n, bool)
        last[first[1:][first[1:] > 0] - 1] = True
        follows = np.zeros(n, bool)  # the next word continues a run that the benchmark knows
        if len(self.pairs):
            code = ids[:-1] * (len(self.vocabulary) + 1) + ids[1:]
            near = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            follows = (self.pairs[near] == code) & (ids[:-1] > 0) & ~last
        ends = np.flatnonzero(~follows)
        run = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1
        places = np.flatnonzero((run >= self.least) & (ids[:-1] > 0))
        if not len(places):
            return first, np.zeros(n, bool), items, best
        keys = self._keys(ids, places, run[places])
        order = np.argsort(keys, kind="stable")  # the shard's suffix array, to the depth of a window
        array, keys = places[order], keys[order]
        low, high = np.searchsorted(keys, self.keys, "left"), np.searchsorted(keys, self.upper, "right")
        found = np.flatnonzero(high > low)
        count = (high - low)[found]
        query = np.repeat(found, count)
        step = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        at = array[np.repeat(low[found], count) + step]
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + self.size[query], -1)
        hit = np.cumsum(cover[:-1]) > 0
        # each match with every item and place that has its window
        many = np.diff(self.group)[query]
        pick = np.repeat(np.arange(len(query)), many)
        step = np.arange(len(pick)) - np.repeat(np.cumsum(many) - many, many)
        own = self.order[self.group[query[pick]] + step]
        at, item, place = at[pick], self.item[own], self.place[own]
        doc = np.searchsorted(first, at, "right") - 1
        for d, k in np.unique(np.stack([doc, item], 1), axis=0).tolist():
            if self.names[k] is not None:
                items[d].add(self.names[k])
        length, going = self.size[query[pick]].copy(), np.arange(len(pick))
        while len(going):  # follow each match to its full length
            i, j = at[going] + length[going], place[going] + length[going]
            more = (i < first[doc[going] + 1]) & (j < self.ends[item[going]])
            more[more] = ids[i[more]] == self.ids[j[more]]
            going = going[more]
            length[going] += 1
        longest = np.lexsort((at, -length, doc))
        lead = longest[np.unique(doc[longest], return_index=True)[1]]
        start_of = np.append(0, self.ends)[item[lead]]
        best[doc[lead]] = np.stack([length[lead], item[lead], at[lead] - first[doc[lead]], place[lead] - start_of], 1)
        return first, hit, items, best


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items, a bounded block at a time."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), text_of(text_col).alias("t")).filter(F.col("t") != "")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    count = max(1, math.ceil(total / limit))
    for k in range(count):
        yield [tuple(r) for r in (rows if count == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k)).collect()]


_HITS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("hit", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest_match", T.LongType()), T.StructField("longest_item", T.StringType()),
    T.StructField("longest_at_word", T.LongType()), T.StructField("longest_item_word", T.LongType()),
])
_ARROW = pa.struct([
    ("n_words", pa.int64()), ("hit", pa.binary()), ("items", pa.list_(pa.string())), ("longest_match", pa.int64()),
    ("longest_item", pa.string()), ("longest_at_word", pa.int64()), ("longest_item_word", pa.int64()),
])


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
            window: int = WINDOW, out: str | None = None, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of what the suffix arrays find (bits of hit words, items, longest match); its name."""
    name = out or free_name(docs, "benchmark_hits")
    result: DataFrame | None = None
    for items in _blocks(benchmark, item_col, item_text, block_bytes):
        before = docs if result is None else materialise(result, "decontamination-pass")
        result = _pass(before, items, text_col, window, name)
    return result, name


def _pass(docs: DataFrame, items: list[tuple[str | None, str]], text_col: str, window: int, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    earlier = name in docs.columns
    place = docs.columns.index(text_col)
    plain = [f for f in docs.schema.fields if f.name != name]
    ready: list[Queries] = []

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not ready:
            ready.append(Queries(shared.value, window))
        queries = ready[0]
        for batch in batches:
            for chunk in byte_chunks(iter([_by_number(batch)]), str(place), SHARD_BYTES):
                raw, offsets = utf8(chunk.column(place))
                first, hit, found, best = queries.search(raw, offsets)
                before = chunk.column(len(plain)).to_pylist() if earlier else [None] * chunk.num_rows
                rows = []
                for k, old in enumerate(before):
                    own = hit[first[k] : first[k + 1]]
                    b = best[k].tolist()
                    row = {"n_words": len(own), "hit": np.packbits(own).tobytes() if own.any() else b"", "items": sorted(found[k]),
                           "longest_match": b[0], "longest_item": queries.names[b[1]] if b[1] >= 0 else None,
                           "longest_at_word": b[2] if b[0] else None, "longest_item_word": b[3] if b[0] else None}
                    if old is not None:
                        if old["longest_match"] > b[0]:
                            row |= {c: old[c] for c in ("longest_match", "longest_item", "longest_at_word", "longest_item_word")}
                        row["items"] = sorted({*row["items"], *old["items"]})
                        if old["hit"] and row["hit"]:
                            row["hit"] = (np.frombuffer(old["hit"], np.uint8) | np.frombuffer(row["hit"], np.uint8)).tobytes()
                        row["hit"] = row["hit"] or old["hit"]
                    rows.append(row)
                columns = [chunk.column(i) for i in range(len(plain))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, _ARROW)], names=[*(f.name for f in plain), name])

    ordered = docs.select(*[F.col(f"`{f.name}`") for f in plain], *([F.col(f"`{name}`")] if earlier else []))
    return ordered.mapInArrow(find, T.StructType([*plain, T.StructField(name, _HITS)]))


def _by_number(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(batch.columns, names=[str(i) for i in range(batch.num_columns)])


def hit_words(name: str):
    """Number of hit words, from the bits of the struct column ``name``."""
    bits = F.hex(F.col(f"`{name}`.hit"))
    kept = F.translate
    total = F.lit(0).cast("long")
    for digits, ones in (("1248", 1), ("3569AC", 2), ("7BDE", 3), ("F", 4)):
        others = "".join(c for c in "0123456789ABCDEF" if c not in digits)
        total = total + F.length(kept(bits, others, "")) * F.lit(ones)
    return total


def contaminated(name: str):
    """The rule: some word is hit and hits are a twentieth of the words or more."""
    return (hit_words(name) > 0) & (hit_words(name) * 20 >= F.col(f"`{name}`.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns of ``docs``."""
    found, name = matches(docs, benchmark, text_col, window=window)
    return found.filter(~contaminated(name)).drop(name)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, name = matches(docs, table(spark, sf_dir, "benchmark"))
    hits = F.col(name)
    return found.select(
        "doc_id", hits["n_words"].alias("n_words"), hit_words(name).alias("n_hit"), F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(hits["items"]), ","), 256).alias("items_sha256"), contaminated(name).alias("contaminated"),
        hits["longest_match"].alias("longest_match"), hits["longest_item"].alias("longest_item"),
        hits["longest_at_word"].alias("longest_at_word"), hits["longest_item_word"].alias("longest_item_word"),
    )
