"""Removal of repeated byte strings by suffix arrays that are sorted in two stages.

Every string of ``length`` bytes belongs to its anchor, the ``ANCHOR``-byte string inside it with the
smallest hash. Equal strings have equal anchors, so the strings of the corpus fall into shards by anchor that
can be sorted apart; neighbouring strings mostly share their anchor and travel as one context of bytes.
Equal contexts of an anchor travel once, with their number. A shard's text is sorted in two stages: suffixes
smaller than their successors are sorted directly, the others are induced by one scan over the buckets of
first bytes. Neighbours in the array with a common prefix of ``length`` bytes mark repeated strings.

Anchors that occur once are never fetched. The strings of an anchor with more than ``BLOCK_CONTEXTS`` different
contexts are split by where the anchor stands in them, ``STEP`` places together. Strings of such a range have
all but ``STEP - 1`` of their bytes in common, the core, and equal strings have equal cores; so each range
is known by the hash of its core and the bytes beside it, and grouped counts of these find the repeated
strings. No task holds a whole hot group, and the work grows with the contexts, not with their pairs.

Contexts and cores are told apart by keyed hashes whose key is drawn anew for each run; strings that are
sorted, and the bytes beside a core, are compared as they are.

Defined results: a null text is empty; texts shorter than ``length`` keep all bytes; rows that repeat an id
and text each count, so their texts repeat; an empty table gives no rows. Texts are judged as UTF-8 bytes, so
what is kept may cut a character; ``kept`` is binary, ``text`` is the same without what is left of cut characters.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import byte_chunks, discard, materialise, rolling, span_hash, table, text_of, utf8

LENGTH = 400
ANCHOR = 160
#: A worker's arrays take some 80 bytes for each byte of a chunk, a shard's sort keys up to some 400.
CHUNK_BYTES = 1 << 18
SHARD_BYTES = 1 << 18
#: Different contexts of an anchor that are sorted together; those of larger groups are split by the anchor's place.
BLOCK_CONTEXTS = 200
STEP = 16
#: Vectored reads take a column chunk of a row group, however large, outside the heap; plain reads take parts of 8 MB.
PLAIN_READS = {"parquet.hadoop.vectored.io.enabled": "false"}
#: Entries (about 60 bytes each, some 3 MB in all) that may be broadcast to the documents; beyond, the join shuffles,
#: so that what the driver holds does not grow with the documents.
BROADCAST_ENTRIES = 50_000


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours, by prefix and suffix minima of blocks."""
    n = len(x) - w + 1
    pad = -len(x) % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchored(raw: np.ndarray, offsets: np.ndarray, length: int, anchor: int, key: bytes) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: text, first start in it, further starts, anchor hash, its place after the first start, keyed hash of the run's bytes."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64, np.int64))
    if len(raw) < length:
        return none
    prefix = rolling(raw)
    at = np.arange(len(raw) - anchor + 1)
    grams = span_hash(prefix, at, at + anchor)
    low = np.uint64((1 << 24) - 1)
    least = _sliding_min((grams & ~low) | at.astype(np.uint64), length - anchor + 1)
    place = (least & low).astype(np.int64)
    starts = np.arange(len(place))
    doc = np.searchsorted(offsets, starts, "right") - 1
    fits = starts + length <= offsets[doc + 1]
    starts, place, doc = starts[fits], place[fits], doc[fits]
    if not len(starts):
        return none
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(starts)) - 1
    p, q = starts[head], starts[last]
    data = raw.tobytes()
    code = b"".join([_digest(data[i:j], key) for i, j in zip(p.tolist(), (q + length).tolist())])
    return doc[head], p - offsets[doc[head]], q - p, grams[place[head]], place[head] - p, np.frombuffer(code, np.int64)


def _digest(data: bytes, key: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8, key=key).digest()


def two_stage(text: bytes, want: np.ndarray, depth: int) -> np.ndarray:
    """The wanted suffixes of ``text`` (ascending starts) in order, exact to ``depth`` bytes.

    Stage one sorts the suffixes that are smaller than their successor; stage two induces the rest, which are
    greater than their successor, by a scan over the buckets of first bytes in ascending order.
    """
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    if not len(want):
        return want
    change = np.flatnonzero(t[1:] != t[:-1])  # the end of each run of equal bytes
    slot = np.searchsorted(change, np.arange(n))
    ends = np.append(change, n - 1)[slot]
    small = np.zeros(n, bool)
    inner = ends < n - 1
    small[inner] = t[ends[inner]] < t[ends[inner] + 1]
    need = np.zeros(n + 1, bool)
    need[want] = True
    # every greater suffix needs its successors up to the first smaller one (or the end of the text)
    seeds = np.append(np.flatnonzero(small), n - 1)
    stop = seeds[np.searchsorted(seeds, want)]
    mark = np.zeros(n + 2, np.int64)
    np.add.at(mark, want, 1)
    np.add.at(mark, stop + 1, -1)
    need[: n] |= np.cumsum(mark[:n]) > 0
    direct = [int(i) for i in np.flatnonzero(need[:n] & small)]
    if need[n - 1] and not small[n - 1]:
        direct.append(n - 1)  # the last suffix has no successor to be induced from
    direct.sort(key=lambda i: text[i : i + depth])
    greater = (need[:n] & ~small).tolist()
    greater[n - 1] = False
    sorted_of: list[list[int]] = [[] for _ in range(256)]
    for i in direct:
        sorted_of[text[i]].append(i)
    induced: list[list[int]] = [[] for _ in range(256)]
    out: list[int] = []
    for c in range(256):
        bucket = induced[c]
        k = 0
        tail = sorted_of[c]
        # a suffix of length one is smaller than all others of its bucket
        if tail and tail[0] == n - 1 and not small[n - 1]:
            bucket.insert(0, tail.pop(0))
        while k < len(bucket):  # grows while suffixes of the same first byte are induced
            i = bucket[k]
            if i and greater[i - 1]:
                induced[text[i - 1]].append(i - 1)
            k += 1
        for i in tail:
            if i and greater[i - 1]:
                induced[text[i - 1]].append(i - 1)
        out += bucket
        out += tail
    order = np.array(out, np.int64)
    keep = np.zeros(n, bool)
    keep[want] = True
    return order[keep[order]]


def common_prefixes(text: bytes, order: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of each suffix with its predecessor in ``order``, up to ``limit``."""
    t = np.frombuffer(text + b"\0" * (limit + 8), np.uint8)
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for k in range(limit):
        if not len(live):
            break
        live = live[t[order[live] + k] == t[order[live - 1] + k]]
        out[live] += 1
    return out


def repeated_starts(contexts: list[bytes], extra: list[int], copies: list[int], length: int) -> list[np.ndarray]:
    """For each context the starts 0..extra whose string of ``length`` bytes occurs again in the contexts or their copies."""
    text = b"".join(contexts)
    ends = np.cumsum([len(c) for c in contexts])
    base = ends - [len(c) for c in contexts]
    want = np.concatenate([np.arange(b, b + e + 1) for b, e in zip(base, extra)])
    order = two_stage(text, want, length)
    same = common_prefixes(text, order, length) >= length
    hit = same.copy()
    hit[:-1] |= same[1:]
    again = np.zeros(len(text), bool)
    again[order[hit]] = True
    return [np.arange(e + 1) if c > 1 else np.flatnonzero(again[b : b + e + 1]) for b, e, c in zip(base, extra, copies)]


def _intervals(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive numbers: first and last."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist()))


_FOUND = {"a": pa.int64(), "b": pa.int64(), "first": pa.int64(), "extra": pa.int64(), "anchor": pa.int64(), "rel": pa.int64(), "code": pa.int64()}


def _occurrences(docs: DataFrame, length: int, anchor: int, key: bytes) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in byte_chunks(batches, "text", CHUNK_BYTES):
            raw, offsets = utf8(chunk.column("text"))
            run = _long if len(raw) >= LONG_BYTES else anchored
            doc, first, extra, gram, rel, code = run(raw, offsets, length, anchor, key)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("a").take(take), chunk.column("b").take(take), *(pa.array(x) for x in (first, extra, gram.view(np.int64), rel, code))], names=list(_FOUND)
            )

    return docs.mapInArrow(find, ", ".join(f"{c} long" for c in _FOUND))


#: Texts from here on are taken in parts, so that no text decides about a worker's memory. More than ``CHUNK_BYTES``, as a chunk
#: in parts must be one text, and at most 2^24, as places of anchors have 24 bits.
LONG_BYTES = CHUNK_BYTES * 2


def _long(raw: np.ndarray, offsets: np.ndarray, length: int, anchor: int, key: bytes) -> tuple[np.ndarray, ...]:
    """As ``anchored`` for one very long text, in overlapping parts that hold every string once."""
    parts, size = [], LONG_BYTES // 2
    for at in range(0, max(1, len(raw) - length + 1), size):
        own = raw[at : at + size + length - 1]
        doc, first, *others = anchored(own, np.array([0, len(own)]), length, anchor, key)
        parts.append((doc, first + at, *others))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _attach(docs: DataFrame, rows: DataFrame, entries: str, kind: str) -> DataFrame:
    """``docs`` joined to ``rows`` by (a, b); rows whose arrays ``entries`` are few in all are broadcast, more are shuffled and hashed, so that no texts are sorted."""
    total = rows.agg(F.coalesce(F.sum(F.size(entries) + 1), F.lit(0))).first()[0]
    return docs.join(rows.hint("broadcast" if total <= BROADCAST_ENTRIES else "shuffle_hash"), ["a", "b"], kind)


def _ranges(rows: dict, length: int, step: int, key: bytes, data: bytes) -> pa.RecordBatch:
    """The contexts of hot anchors by ranges of the anchor's place: core, the bytes before and after it, first and last start."""
    out: list[tuple] = []
    for anchor, code, extra, copies, base, rel in zip(*(rows[c].tolist() for c in ("anchor", "code", "extra", "copies", "base", "rel"))):
        at = base + rel
        for part in range((rel - extra) // step, rel // step + 1):
            low, high, core = max(rel - extra, part * step), min(rel, part * step + step - 1), at - part * step
            end = core - step + 1 + length
            out.append((anchor, code, extra, copies, part, int.from_bytes(_digest(data[core:end], key), "little", signed=True), data[at - high : core], data[end : at - low + length], rel - high, rel - low))
    kinds = [pa.int64()] * 6 + [pa.binary()] * 2 + [pa.int64()] * 2
    names = ["anchor", "code", "extra", "copies", "part", "core", "left", "right", "lo", "hi"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * len(kinds), kinds)], names=names)


def _hot_marks(ranges: DataFrame, step: int) -> DataFrame:
    """(anchor, code, extra, spans) of the repeated strings of hot anchors, by grouped counts over the rows of ``_ranges``.

    Strings are made only of the different sides of a core, at most ``step`` of each; contexts take what was found for their sides.
    """
    core, sides = ["anchor", "part", "core"], ["left", "right"]
    kinds = materialise(ranges.groupBy(*core, *sides).agg(F.sum("copies").alias("c")), "repeats-sides")
    cores = kinds.groupBy(*core).agg(F.sum("c").alias("total"), F.count("*").alias("d")).filter("total > 1")
    cores = materialise(cores.select(*core, (F.col("d") > 1).alias("differ")), "repeats-cores")
    judged = materialise(ranges.join(cores, core), "repeats-judged")
    alike = judged.filter("not differ").select("anchor", "code", "extra", F.array(F.struct("lo", "hi")).alias("spans"))

    # one row for each place of the anchor: of its string, the bytes beside the core
    top, least = F.col("part") * step + F.octet_length("left"), (F.col("part") + 1) * step - 1 - F.octet_length("right")
    rows = kinds.join(cores.filter("differ"), core).withColumn("top", top).withColumn("at", F.explode(F.sequence(least, top)))
    before, after = F.col("at") - F.col("part") * step, (F.col("part") + 1) * step - 1 - F.col("at")
    own = lambda c, start, size: F.substring(F.hex(c), (start * 2 + 1).cast("int"), (size * 2).cast("int"))
    strings = rows.withColumn("edge", F.concat(own("left", F.octet_length("left") - before, before), own("right", F.lit(0), after)))

    again = strings.groupBy(*core, "at", "edge").agg(F.sum("c").alias("total")).filter("total > 1").select(*core, "at", "edge")
    again = materialise(again, "repeats-again")
    # starts after the first of the sides, as those of the contexts are after lo
    found = strings.join(again, [*core, "at", "edge"]).groupBy(*core, *sides).agg(F.sort_array(F.collect_list(F.col("top") - F.col("at"))).alias("starts"))
    found = materialise(found, "repeats-found")
    shifted = F.transform("starts", lambda x: F.struct((F.col("lo") + x).alias("lo"), (F.col("lo") + x).alias("hi")))
    each = judged.filter("differ").join(found, [*core, *sides]).select("anchor", "code", "extra", shifted.alias("spans"))
    marks = materialise(alike.union(each), "repeats-hot-marks")
    for done in (kinds, cores, judged, again, found):
        discard(done)
    return marks


def merged(rows: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """``rows`` (keys, spans) with spans in order, those that begin at most ``gap`` after the end of another as one."""
    row = 1 << 40  # spans of different rows are set apart by this

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            flat, own = lists.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())) * row
            lo, hi = flat.field("lo").to_numpy() + own, flat.field("hi").to_numpy() + own
            order = np.argsort(lo, kind="stable")
            lo, top = lo[order], np.maximum.accumulate(hi[order])
            first = np.flatnonzero(np.append(True, lo[1:] > top[:-1] + gap))
            last = np.append(first[1:], len(lo)) - 1
            offsets = np.searchsorted(lo[first] // row, np.arange(batch.num_rows + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(lo[first] % row), pa.array(top[last] % row)], names=["lo", "hi"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.ListArray.from_arrays(pa.array(offsets), spans)], names=[*keys, "spans"])

    return rows.mapInArrow(merge, ", ".join(f"{c} long" for c in keys) + ", spans array<struct<lo:long,hi:long>>")


def repeats(texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(a, b, spans): for each text key the first and last starts of runs of repeated strings. ``texts``: a, b, text."""
    spark, key, limit = texts.sparkSession, secrets.token_bytes(16), BLOCK_CONTEXTS
    step = max(1, min(STEP, length // 2))
    found = materialise(_occurrences(texts, length, anchor, key), "repeats-anchors")
    kinds = materialise(found.groupBy("anchor", "code", "extra").agg(F.count("*").alias("copies"), F.min(F.struct("a", "b", "first", "rel")).alias("at")), "repeats-contexts")
    groups = kinds.groupBy("anchor").agg(F.sum("copies").alias("total"), F.count("*").alias("g")).filter("total > 1").select("anchor", "g")
    shared = materialise(kinds.join(groups, "anchor").select("anchor", "code", "extra", "copies", "g", "at.*"), "repeats-shared")
    discard(kinds)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = ["anchor", "code", "extra", "copies", "first", "rel"]

    def fetched(hot: bool, schema: str, label: str) -> DataFrame | None:
        """The contexts of hot or other anchors, with their bytes or ranges."""
        own = shared.filter(F.col("g") > limit if hot else F.col("g").between(2, limit))
        if not own.limit(1).count():
            return None
        wanted = materialise(own.groupBy("a", "b").agg(F.collect_list(F.struct(*fields)).alias("w")), "repeats-wanted")

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in byte_chunks(batches, "text", CHUNK_BYTES):
                raw, offsets = utf8(chunk.column("text"))
                lists = chunk.column("w")
                flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
                rows = {c: flat.field(c).to_numpy() for c in fields}
                rows["base"] = np.repeat(offsets[:-1], sizes) + rows["first"]
                data = raw.tobytes()
                if hot:
                    yield _ranges(rows, length, step, key, data)
                else:
                    stop = rows["base"] + rows["extra"] + length
                    cut = pa.array([data[i:j] for i, j in zip(rows["base"].tolist(), stop.tolist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(rows[c]) for c in fields[:4]] + [cut], names=[*fields[:4], "bytes"])

        out = materialise(_attach(texts, wanted, "w", "inner").select("text", "w").mapInArrow(fetch, schema), label)
        discard(wanted)
        return out

    contexts = fetched(False, "anchor long, code long, extra long, copies long, bytes binary", "repeats-fetched")
    ranges = fetched(True, "anchor long, code long, extra long, copies long, part long, core long, left binary, right binary, lo long, hi long", "repeats-ranges")
    # the only context of an anchor, with copies, needs no comparison
    alone = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("extra").alias("hi"))).alias("spans")
    marks = materialise(shared.filter("g = 1").select("anchor", "code", "extra", alone), "repeats-alone")
    discard(shared)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, now = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            got = repeated_starts([h[4] for h in held], [h[2] for h in held], [h[3] for h in held], length)
            rows = [(*h[:3], lo, hi) for h, starts in zip(held, got) for lo, hi in _intervals(starts)]
            held.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["anchor", "code", "extra", "lo", "hi"])

        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != now and size >= SHARD_BYTES:
                    yield from flush()
                    size = 0
                now = row[0]
                held.append(row)
                size += len(row[4])
        if held:
            yield from flush()

    if contexts is not None:
        sorted_marks = materialise(contexts.repartition(parts, "anchor").sortWithinPartitions("anchor", "code", "extra").mapInArrow(sort, "anchor long, code long, extra long, lo long, hi long"), "repeats-marks")
        discard(contexts)
        marks = marks.union(sorted_marks.select("anchor", "code", "extra", F.array(F.struct("lo", "hi")).alias("spans")))
    if ranges is not None:
        marks = marks.union(_hot_marks(ranges, step))
        discard(ranges)
    # one row for each context, so that the join makes no more rows than there are contexts' places
    context = ["anchor", "code", "extra"]
    joined = materialise(merged(marks.groupBy(*context).agg(F.flatten(F.collect_set("spans")).alias("spans")), context, 1), "repeats-joined")
    shifted = F.transform("spans", lambda x: F.struct((F.col("first") + x["lo"]).alias("lo"), (F.col("first") + x["hi"]).alias("hi")))
    spans = found.join(joined, context).groupBy("a", "b").agg(F.flatten(F.collect_set(shifted)).alias("spans"))
    spans = materialise(merged(spans, ["a", "b"], length), "repeats-spans")
    discard(joined)
    discard(found)
    discard(marks)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, kept: bool = True) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (binary; left out if not ``kept``), its kept_sha256 and what is left as ``text`` for each row.

    The rows are a work table, as all before: what a caller writes runs under the caller's size of Arrow batches, which may hold a whole partition.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("a"), F.xxhash64(text).alias("b"), text.alias("text"))
    spans = repeats(rows.select("a", "b", "text"), length, anchor)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in byte_chunks(batches, "text", CHUNK_BYTES):
            raw, offsets = utf8(chunk.column("text"))
            out = []
            for k, own in enumerate(chunk.column("spans").to_pylist()):
                data = raw[offsets[k] : offsets[k + 1]]
                gone = np.zeros(len(data), bool)
                for s in own or ():
                    gone[s["lo"] : s["hi"] + length] = True
                left = data[~gone].tobytes()
                edges = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                out.append((len(data), int(gone.sum()), edges, left, hashlib.sha256(left).hexdigest(), left.decode(errors="ignore")))
            columns = list(zip(*out)) or [()] * 6
            arrays = [chunk.column("id"), *(pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.binary()] + [pa.string()] * 2))]
            yield pa.RecordBatch.from_arrays([arrays[k] for k in given], names=[fields[k][0] for k in given])

    fields = [(id_col, "long"), ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "binary"), ("kept_sha256", "string"), ("text", "string")]
    given = [k for k in range(len(fields)) if kept or k != 4]
    schema = ", ".join(f"`{fields[k][0]}` {fields[k][1]}" for k in given)
    out = materialise(_attach(rows, spans, "spans", "left").select("id", "text", "spans").mapInArrow(cut, schema), "repeats-removed")
    discard(spans)
    return out


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", **PLAIN_READS), kept=False)
