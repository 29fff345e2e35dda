"""Exact n-gram Jaccard join by parity sketches, as connected components.

A document's set of word shingles is hashed into a sketch whose bits are parities: every shingle flips one
bit, so the Hamming distance of two sketches is at most the size of the sets' symmetric difference. For
a threshold t that size is at most (1-t)/(1+t) of the sizes' sum, d. A band holds the sizes that can link;
its sketches are cut into D = d + 1 + slack blocks, so at least 1 + slack blocks of a linked pair are equal
(pigeonhole). Blocks have 2**32 virtual bits each and are kept as the XOR of their set bits' codes. An
equal block without bits tells nothing: a set with more than ``slack // 2`` empty blocks emits these too.
So a linked pair has at least 1 + spare keys in common, spare = slack - slack // 2.

Equal sets are found first by fingerprints; one document of each set goes on. Block keys are shuffled once;
a task streams over its sorted keys. A key of up to ``HOT`` documents links each of them to the first, its hub.
Of the keys of more documents every document leaves out the ``spare`` most frequent: the rarest key that a
linked pair has in common is never left out, so no link is lost, and what many texts share - a line, a passage -
makes no large groups. Documents are then grouped by hub instead of by key: a pair meets once for a hub,
not once for each of its keys.

Each document is verified against its best hub, judged by Hamming distance of 2048-bit sketches. Groups whose
documents are still in different components are compared inside tasks, in blocks of ``BLOCK_ROWS`` sketches:
each document emits its k nearest candidates in each other component, these are verified, and components merge.
A group with more candidates comes again with eight times k; all others are done. Verification counts
common shingles exactly; a hub's pairs are cut into tiles, and a set is sent once to each tile that needs it.

Words are runs of other signs than the six ASCII white-space characters, ASCII letters lower-cased; fewer
words than a shingle make one shingle of all. Words are told apart by their bytes; their codes are keyed
hashes, and the key is drawn anew for each run, so no text can be made to collide.
Defined results: no words or a null text: an empty set, linked with nothing; a null id is linked with
nothing; rows that repeat an id are one document, which has the text with the smallest hash; equal texts link;
an empty table gives no rows.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import ascii_lower, byte_chunks, discard, free_name, keyed_multipliers, materialise, mix64, table, text_of, utf8, word_codes, word_spans

BATCH_BYTES = 2 << 20
SKETCH_WORDS = 32
#: Documents of a key that are linked to their hub at once; of larger keys each document leaves its most frequent out.
HOT = 64
#: Sketches of a group that one task compares with each other or with another such block.
BLOCK_ROWS = 4096
#: Pairs of sketches that are compared at once.
PAIRS = 1 << 17
#: Ids of documents that may be broadcast (about 50 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 500_000
#: Shingles (8 bytes each) of a block of documents; a task that verifies pairs holds the sets of two blocks.
TILE = 1 << 20
#: Shingles that are looked up in a set at once.
COMPARED = 1 << 18

_FOLD = ascii_lower()
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int, key: bytes) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its ``n``-word shingles."""
    start, stop, first = word_spans(raw, offsets, _IS_WORD)
    words = word_codes(_FOLD[raw], start, stop, key)
    codes = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for j, factor in enumerate(keyed_multipliers(key, n)):
            codes[: max(0, len(words) - j)] += words[j:] * factor
        codes = mix64(codes)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(codes[a : b - n + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = mix64(np.array([h ^ w], np.uint64))[0] + np.uint64(1)
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Bands:
    """Size bands and their numbers of blocks for the threshold num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [1]

    def _start(self, k: int) -> int:
        while len(self.low) <= k:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        return self.low[k]

    def of(self, size: int) -> int:
        while self._start(len(self.low) - 1) <= size:
            self._start(len(self.low))
        return int(np.searchsorted(self.low, size, "right")) - 1

    def blocks(self, k: int) -> tuple[int, int]:
        """(blocks, slack) of the band that joins sizes of bands ``k`` and ``k + 1``."""
        d = (self.den - self.num) * (self._start(k + 1) - 1 + self._start(k + 2) - 1) // (self.den + self.num)
        slack = d // 8 + (d > 0)
        return d + 1 + slack, slack

    def spare(self, size: int, odd: int) -> int:
        """Keys that a set of ``size`` may leave out in its band of even or odd number."""
        k = self.of(size)
        band = k if k % 2 == odd else k - 1
        slack = self.blocks(band)[1] if band >= 0 else 0
        return slack - slack // 2

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """The block keys of a set in the bands that it belongs to; the last bit tells odd bands."""
        if not len(codes):
            return np.zeros(0, np.uint64)
        k, out = self.of(len(codes)), []
        total = np.zeros(len(codes) + 1, np.uint64)
        np.bitwise_xor.accumulate(mix64(codes), out=total[1:])
        high = codes >> np.uint64(32)
        for band in (k - 1, k) if k else (k,):
            many, slack = self.blocks(band)
            edges = np.searchsorted(high, (np.arange(many + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(many))
            edges[-1] = len(codes)
            values = total[edges[1:]] ^ total[edges[:-1]]
            filled = np.diff(edges) > 0
            if many - filled.sum() > slack // 2:
                filled[:] = True
            block = np.arange(many, dtype=np.uint64)
            tag = np.uint64(band) << np.uint64(32)
            out.append(mix64(values + mix64(tag + block + np.uint64(1)))[filled] >> np.uint64(1) << np.uint64(1) | np.uint64(band & 1))
        return np.concatenate(out)


def sketch(codes: np.ndarray) -> np.ndarray:
    """2048 parities: bit i is the parity of the shingles that hash to it."""
    bits = np.bincount((codes & np.uint64(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, n: int, num: int, den: int, key: bytes) -> DataFrame:
    """id, h, size, two fingerprints of the set, its sketch and spare keys in even and odd bands, for rows (id, h, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for chunk in byte_chunks(batches, "text", BATCH_BYTES):
            sets = shingle_sets(*utf8(chunk.column("text")), n, key)
            marks = [int(np.bitwise_xor.reduce(mix64(s ^ np.uint64(77)))) if len(s) else 0 for s in sets]
            sums = [int(s.sum(dtype=np.uint64)) for s in sets]
            sketches = np.concatenate([sketch(s) for s in sets])
            spare = [pa.array([bands.spare(len(s), odd) if len(s) else 0 for s in sets], pa.int64()) for odd in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("id"), chunk.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array(marks, np.uint64).view(np.int64)), pa.array(np.array(sums, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SKETCH_WORDS), pa.array(sketches)), *spare,
                ],
                names=["id", "h", "n", "f1", "f2", "sketch", "even", "odd"],
            )

    return docs.select("id", "h", "text").mapInArrow(sign, "id long, h long, n long, f1 long, f2 long, sketch array<long>, even long, odd long")


def block_keys(docs: DataFrame, n: int, num: int, den: int, key: bytes) -> DataFrame:
    """(key, id): the block keys of rows (id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for chunk in byte_chunks(batches, "text", BATCH_BYTES):
            keys = [bands.keys(s) for s in shingle_sets(*utf8(chunk.column("text")), n, key)]
            ids = np.repeat(chunk.column("id").to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(ids)], names=["key", "id"])

    return docs.select("id", "text").mapInArrow(cut, "key long, id long")


def shared_keys(rows: DataFrame) -> DataFrame:
    """From (key, id): (null, hub, id) for each document but the first of keys of up to ``HOT``, (key, null, id) for the rows of larger ones."""

    def batch_of(key, hub, ids) -> pa.RecordBatch:
        none = pa.nulls(len(ids), pa.int64())
        return pa.RecordBatch.from_arrays([none if key is None else pa.array(key), none if hub is None else pa.array(hub), pa.array(ids)], names=["key", "hub", "id"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        key, ids = empty, empty  # the last key's rows so far
        hot, last = None, None  # a key whose rows already went out, and the last of them
        pairs: list[np.ndarray] = []

        def distinct() -> Iterator[pa.RecordBatch]:
            both = np.concatenate(pairs, axis=1)
            pairs.clear()
            both = both[:, np.lexsort(both)]
            fresh = np.ones(both.shape[1], bool)
            fresh[1:] = (both[:, 1:] != both[:, :-1]).any(0)
            yield batch_of(None, both[1][fresh], both[0][fresh])

        def whole(key: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Groups that end here."""
            sizes = np.diff(np.append(starts, len(key)))
            heads, g = np.repeat(ids[starts], sizes), np.repeat(sizes, sizes)
            cold = (g <= HOT) & (ids != heads)
            if cold.any():
                pairs.append(np.stack([ids[cold], heads[cold]]))
            if (g > HOT).any():
                yield batch_of(key[g > HOT], None, ids[g > HOT])
            if sum(p.shape[1] for p in pairs) > 500_000:
                yield from distinct()

        for batch in batches:
            key = np.append(key, batch.column("key").to_numpy())
            ids = np.append(ids, batch.column("id").to_numpy())
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
            key, ids = key[fresh], ids[fresh]
            if hot is not None and len(key):
                many = int(np.searchsorted(key, hot, "right"))
                own = ids[:many][ids[:many] > last]
                if len(own):
                    yield batch_of(np.full(len(own), hot), None, own)
                    last = own[-1]
                key, ids = key[many:], ids[many:]
                hot = hot if not len(key) else None
            if not len(key):
                continue
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            end = starts[-1]
            yield from whole(key[:end], ids[:end], starts[:-1])
            key, ids = key[end:], ids[end:]
            if len(key) > HOT:
                yield batch_of(key, None, ids)
                hot, last = int(key[0]), ids[-1]
                key, ids = empty, empty
        if len(key):
            yield from whole(key, ids, np.zeros(1, np.int64))
        if pairs:
            yield from distinct()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key", "id").mapInArrow(groups, "key long, hub long, id long")


def hubs(shared: DataFrame, info: DataFrame) -> DataFrame:
    """(hub, id) of all documents that are not their key's hub; each leaves its ``spare`` most frequent large keys out."""
    large = shared.filter("key is not null").select("key", "id")
    cold = shared.filter("key is null").select("hub", "id")
    sizes = materialise(large.groupBy("key").agg(F.count("*").alias("g")), "jaccard-large")
    many = sizes.count()
    if not many:
        return materialise(cold.distinct(), "jaccard-hubs")
    placed = large.join(F.broadcast(sizes) if many <= BROADCAST_IDS else sizes, "key").join(info.select("id", "even", "odd"), "id")
    parity = F.col("key").bitwiseAND(1)
    own = Window.partitionBy("id", parity).orderBy(F.desc("g"), "key")
    rank = placed.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") > F.when(parity == 0, F.col("even")).otherwise(F.col("odd")))
    kept = materialise(rank.select("key", "id"), "jaccard-kept")
    first = kept.groupBy("key").agg(F.min("id").alias("hub"))
    warm = kept.join(first, "key").filter("id <> hub").select("hub", "id")
    out = materialise(cold.union(warm).distinct(), "jaccard-hubs")
    discard(kept)
    discard(sizes)
    return out


def hamming(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def may_link(n1, n2, distance, num: int, den: int):
    """Whether sizes and a lower bound of the symmetric difference allow a link."""
    return (distance * (den + num) <= (n1 + n2) * (den - num)) & (F.least(n1, n2) * den >= F.greatest(n1, n2) * num)


def among(docs: DataFrame, ids: DataFrame, how: str, on: list[str]) -> DataFrame:
    """``docs`` that are (not) among ``ids``, which are broadcast if they are few."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def _compare(num: int, den: int):
    """(a, b, linked) of rows (hub, i, j, id, s, partners) sorted by (hub, i, j): each id's set against its partners' in the tile."""

    def judge(sets: dict, partners: dict) -> Iterator[pa.RecordBatch]:
        for a, own in partners.items():
            sa, at = sets[a], 0
            while at < len(own):
                some, size = [], 0
                while at < len(own) and (not some or size < COMPARED):
                    some.append(sets[own[at]])
                    size += len(some[-1])
                    at += 1
                flat = np.concatenate(some)
                place = np.searchsorted(sa, flat)
                hit = sa[np.minimum(place, len(sa) - 1)] == flat
                sizes = np.array([len(s) for s in some])
                common = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), a)), pa.array(own[at - len(some) : at]), pa.array(common * (den + num) >= (sizes + len(sa)) * num)], names=["a", "b", "linked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, sets, partners = None, {}, {}
        for batch in batches:
            ids, s, others = batch.column("id").to_numpy(), batch.column("s"), batch.column("partners")
            ends, values = s.offsets.to_numpy(), s.values.to_numpy().view(np.uint64)
            cuts, towards = others.offsets.to_numpy(), others.values.to_numpy()
            for k, at in enumerate(zip(*(batch.column(c).to_pylist() for c in ("hub", "i", "j")))):
                if at != tile:
                    yield from judge(sets, partners)
                    tile, sets, partners = at, {}, {}
                if ids[k] in sets:  # a repeated row
                    continue
                sets[ids[k]] = values[ends[k] : ends[k + 1]].copy()
                if cuts[k + 1] > cuts[k]:
                    partners[ids[k]] = towards[cuts[k] : cuts[k + 1]].copy()
        yield from judge(sets, partners)

    return run


def verified(pairs: DataFrame, docs: DataFrame, info: DataFrame, n: int, num: int, den: int, key: bytes) -> DataFrame:
    """(a, b, linked) for distinct pairs (a, b) of ``pairs`` (hub, a, b), from the exact shingle sets of the texts of ``docs`` (id, text).

    A hub's documents are dealt to blocks of about ``TILE`` shingles (``info``: id, n) and its pairs to tiles of two blocks. A set is
    shuffled once for each tile that needs it, not once for each pair, and a task holds the sets of one tile.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = materialise(pairs.select("hub", F.explode(F.array("a", "b")).alias("id")).distinct(), "jaccard-members")
    ids = materialise(members.select("id").distinct(), "jaccard-ids")
    sizes = members.join(info.select("id", "n"), "id").groupBy("hub").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("blocks")).filter("blocks > 1")
    sizes = materialise(sizes, "jaccard-blocks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in byte_chunks(batches, "text", BATCH_BYTES):
            each = shingle_sets(*utf8(chunk.column("text")), n, key)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in each])]).astype(np.int32)
            flat = np.concatenate(each).view(np.int64)
            yield pa.RecordBatch.from_arrays([chunk.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "s"])

    block = lambda c: F.pmod(F.xxhash64(c), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = pairs.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS else sizes, "hub", "left").select("hub", block("a").alias("i"), block("b").alias("j"), "a", "b")
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")), F.struct(F.col("b").alias("id"), F.lit(None).cast("long").alias("to"))))
    # a document's partners in a tile are documents of one block, so their list is bounded by the block
    needs = dealt.select("hub", "i", "j", ends.alias("x")).groupBy("hub", "i", "j", "x.id").agg(F.collect_list("x.to").alias("partners"))
    found = among(docs, ids, "left_semi", ["id"]).select("id", "text").mapInArrow(sets, "id long, s array<long>")
    tiles = needs.join(found, "id").select("hub", "i", "j", "id", "s", "partners").repartition(parts, "hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    out = materialise(tiles.mapInArrow(_compare(num, den), "a long, b long, linked boolean"), "jaccard-checked")
    for done in (members, ids, sizes):
        discard(done)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of ``edges`` (a, b); root: the smallest id of its component.

    Each round points nodes to their smallest neighbour, follows the pointers to their ends by doubling, and
    contracts the edges.
    """
    edges = materialise(edges.select("a", "b").filter("a <> b").distinct(), "cc-edges")
    roots: DataFrame | None = None
    while True:
        both = edges.union(edges.select("b", "a"))
        up = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "cc-up")
        while True:
            above = up.select(F.col("id").alias("root"), F.col("root").alias("above"))
            nxt = materialise(up.join(above, "root", "left").select("id", F.coalesce("above", "root").alias("root"), (F.coalesce("above", "root") != F.col("root")).alias("moved")), "cc-up")
            discard(up)
            moved = nxt.filter("moved").limit(1).count()
            up = nxt.drop("moved")
            if not moved:
                break
        left, right = up.select(F.col("id").alias("a"), F.col("root").alias("ra")), up.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        rest = materialise(edges.join(left, "a").join(right, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "cc-edges")
        discard(edges)
        edges = rest
        if roots is None:
            roots = up
        else:
            ends = up.select(F.col("id").alias("r"), F.col("root").alias("end"))
            nearer = materialise(roots.join(ends, roots["root"] == ends["r"], "left").select("id", F.coalesce("end", "root").alias("root")), "cc-roots")
            discard(roots)
            discard(up)
            roots = nearer
        if not edges.limit(1).count():
            discard(edges)
            return roots


def _cross(num: int, den: int, k: int):
    """Candidate pairs of sorted rows (hub, i, j, side, id, comp, n, sketch): of different components and not ruled out by
    the Hamming bound; of each document the ``k`` nearest in each other component. Emits (hub, a, b, more); more: there are others."""

    def pairs_of(rows: dict, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Groups of rows cut[g]..cut[g + 1]; each row meets all of its group, so it is done at once."""
        ids, comp, n, side, whole, bits = (rows[c] for c in ("id", "comp", "n", "side", "whole", "sketch"))
        size = np.repeat(np.diff(cut), np.diff(cut))
        head = np.repeat(cut[:-1], np.diff(cut))
        total = np.concatenate([[0], np.cumsum(size)])
        at = 0
        while at < len(ids):
            stop = min(len(ids), max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1))
            x = np.repeat(np.arange(at, stop), size[at:stop])
            y = head[x] + np.arange(len(x)) - np.repeat(total[at:stop] - total[at], size[at:stop])
            at = stop
            good = (comp[x] != comp[y]) & (whole[x] | (side[x] != side[y]))
            good &= np.minimum(n[x], n[y]) * den >= np.maximum(n[x], n[y]) * num
            x, y = x[good], y[good]
            d = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
            good = d * (den + num) <= (n[x] + n[y]) * (den - num)
            x, y, d = x[good], y[good], d[good]
            if not len(x):
                continue
            order = np.lexsort((ids[y], d, comp[y], x))
            x, y = x[order], y[order]
            lead = np.append(True, (x[1:] != x[:-1]) | (comp[y[1:]] != comp[y[:-1]]))
            rank = np.arange(len(x)) - np.maximum.accumulate(np.where(lead, np.arange(len(x)), 0))
            near, over = rank < k, rank == k
            more = np.zeros(len(x), bool)
            more[np.flatnonzero(over) - 1] = True
            x, y, more = x[near], y[near], more[near]
            yield pa.RecordBatch.from_arrays([pa.array(rows["hub"][x]), pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y])), pa.array(more)], names=["hub", "a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # whole groups wait here, with the beginning of the last one

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            get = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("hub", "i", "j", "id", "comp", "n", "side")}
            fresh = np.ones(rows.num_rows, bool)
            fresh[1:] = (get["hub"][1:] != get["hub"][:-1]) | (get["i"][1:] != get["i"][:-1]) | (get["j"][1:] != get["j"][:-1])
            cut = np.append(np.flatnonzero(fresh), rows.num_rows)
            end = rows.num_rows if final else int(cut[-2])
            waiting.clear()
            if end < rows.num_rows:
                waiting.append(rows.slice(end))
            if not end:
                return
            own = {c: v[:end] for c, v in get.items()}
            own["whole"] = own["i"] == own["j"]
            own["sketch"] = rows.column("sketch").slice(0, end).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(end, SKETCH_WORDS)
            yield from pairs_of(own, cut[cut <= end])

        size = 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch.num_rows
                if size >= 50_000:
                    yield from flush(False)
                    size = sum(w.num_rows for w in waiting) // 2  # a long group is not cut again at once
        if waiting:
            yield from flush(True)

    return run


def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """id, n_shingles, component_id of each row: sets of ``n``-word shingles link at Jaccard similarity num/den or more."""
    found, _ = _linked(docs, id_col, text_col, n, num, den)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _linked(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(id, h, n, component) of each row, and (id, root) of the documents that are linked; h is the hash of the text."""
    spark, key = docs.sparkSession, secrets.token_bytes(16)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    meta = materialise(signatures(texts, n, num, den, key), "jaccard-signatures")

    # one row for each id, and of equal sets the smallest id
    one = meta.filter("id is not null").groupBy("id").agg(F.min(F.struct("h", "n", "f1", "f2", "sketch", "even", "odd")).alias("x")).select("id", "x.*")
    one = materialise(one, "jaccard-documents")
    reps = materialise(one.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep")), "jaccard-reps")
    info = materialise(one.join(reps, ["n", "f1", "f2"]), "jaccard-sets")
    twins = info.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    info = info.filter("id = rep").select("id", "h", "n", "sketch", "even", "odd")
    others = materialise(meta.filter("id is not null").join(info, ["id", "h"], "left_anti").select("id", "h").distinct(), "jaccard-others")
    chosen = among(texts.filter("id is not null"), others, "left_anti", ["id", "h"])

    shared = materialise(shared_keys(block_keys(chosen, n, num, den, key)), "jaccard-shared")
    stars = hubs(shared, info)
    discard(shared)

    # each document against its best hub
    of = lambda side: info.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "sketch")])
    measured = stars.select(F.col("hub").alias("a"), F.col("id").alias("b")).join(of("b"), "b").join(of("a"), "a").withColumn("d", hamming(F.col("sketch_a"), F.col("sketch_b")))
    measured = measured.filter(may_link(F.col("n_a"), F.col("n_b"), F.col("d"), num, den))
    best = materialise(measured.groupBy("b").agg(F.min(F.struct("d", "a")).alias("x")).select(F.col("x.a").alias("hub"), "x.a", "b"), "jaccard-best")
    tested = verified(best, chosen, info, n, num, den, key)
    discard(best)
    roots = components(tested.filter("linked"))

    # groups that are still in several components
    k, active = 1, stars.union(stars.select("hub", F.col("hub").alias("id")).distinct())
    while True:
        placed = active.join(roots, "id", "left").select("hub", "id", F.coalesce("root", "id").alias("comp"))
        mixed = placed.groupBy("hub").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("g")).filter("low <> high").select("hub", "g")
        rows = placed.join(mixed, "hub").join(info.select("id", "n", "sketch"), "id")
        blocks = F.ceil(F.col("g") / BLOCK_ROWS).cast("int")
        rows = rows.withColumn("side", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        rows = rows.select("hub", F.least("side", "other").cast("long").alias("i"), F.greatest("side", "other").cast("long").alias("j"), "side", "id", "comp", "n", "sketch")
        found = rows.repartition(parts, "hub", "i", "j").sortWithinPartitions("hub", "i", "j", "id").mapInArrow(_cross(num, den, k), "hub long, a long, b long, more boolean")
        found = materialise(found, "jaccard-found")
        pairs = materialise(found.groupBy("a", "b").agg(F.min("hub").alias("hub")).join(tested.select("a", "b"), ["a", "b"], "left_anti"), "jaccard-pairs")
        if pairs.limit(1).count():
            fresh = verified(pairs, chosen, info, n, num, den, key)
            links = fresh.filter("linked").select("a", "b")
            if links.limit(1).count():
                merged = components(roots.select(F.col("root").alias("a"), F.col("id").alias("b")).union(links))
                discard(roots)
                roots = merged
            tested = tested.union(fresh)
        # a group whose candidates all went out is done: components only merge
        open_hubs = materialise(found.filter("more").select("hub").distinct(), "jaccard-open")
        discard(found)
        discard(pairs)
        if not open_hubs.limit(1).count():
            break
        k, active = 8 * k, materialise(active.join(open_hubs, "hub", "left_semi"), "jaccard-active")

    # a set's smallest id stands for it, so a component's root is its smallest id
    linked = twins.join(roots.withColumnRenamed("id", "a"), "a", "left").select(F.col("b").alias("id"), F.coalesce("root", "a").alias("root")).union(roots)
    linked = materialise(linked, "jaccard-linked")
    found = materialise(meta.join(linked, "id", "left").select("id", "h", "n", F.coalesce("root", "id").alias("component")), "jaccard-result")
    for done in (meta, one, reps, info, others, stars, tested, roots):
        discard(done)
    return found, linked


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group of linked ones, that with the smallest id; of rows that repeat an id one, of the text that stands for it.

    Rows of null ids stay.
    """
    found, linked = _linked(docs, id_col, text_col, n, num, den)
    ident = F.col(f"`{id_col}`").cast("long")
    drop = linked.filter("id <> root").select("id")
    drop = F.broadcast(drop) if drop.count() <= BROADCAST_IDS else drop
    name = free_name(docs, "id")
    kept = docs.join(drop.withColumnRenamed("id", name), ident == F.col(name), "left_anti")
    again = materialise(found.filter("id is not null").groupBy("id").agg(F.count("*").alias("m"), F.min("h").alias("h")).filter("m > 1").select("id"), "jaccard-repeated")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if not again.limit(1).count():
        return kept.select(*columns)
    again = again.withColumnRenamed("id", name)
    order, place = Window.partitionBy(ident).orderBy(F.xxhash64(text_of(text_col))), free_name(docs, "place")
    several = kept.join(again, ident == F.col(name), "left_semi").withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1)
    return kept.join(again, ident == F.col(name), "left_anti").select(*columns).union(several.select(*columns))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)
