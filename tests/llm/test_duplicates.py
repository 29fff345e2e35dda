"""Jaccard components, suffix dedup and decontamination against brute force."""

import collections
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest

from tracelake.llm import decontaminate, jaccard, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


def shingles(t, n):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, num, den):
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            common = len(sets[a] & sets[b])
            if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in sets.items())


@pytest.fixture(scope="module")
def near():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    rows, k = [(1, None), (2, ""), (3, " \n "), (4, "a"), (5, "A"), (6, "a b"), (7, "a b c d"), (8, "A b c D")], 100
    for size in (3, 8, 20, 60, 150):
        base = [rng.choice(vocab) for _ in range(size)]
        for _ in range(15):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                w[rng.randrange(size)] = rng.choice(vocab)
            rows.append((k, " ".join(w)))
            k += 1
    passage = " ".join(rng.choice(vocab) for _ in range(40))
    rows += [(k + i, passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 30)))) for i in range(25)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n, num", [(4, 85), (5, 80)])
def test_components(spark, near, n, num):
    df = spark.createDataFrame(near, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in jaccard.linked_components(df, n=n, num=num).collect())
    assert got == brute_components(near, n, num, 100)


def test_groups_in_blocks(spark, near, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)
    df = spark.createDataFrame(near, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.linked_components(df, n=4, num=85).collect()) == brute_components(near, 4, 85, 100)


def test_pairs_in_tiles(spark, near, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 100)  # a block of two or three documents
    df = spark.createDataFrame(near, "doc_id long, text string").repartition(3)
    for n, num in ((4, 85), (3, 50)):
        assert sorted(tuple(r) for r in jaccard.linked_components(df, n=n, num=num).collect()) == brute_components(near, n, num, 100)


def test_frequent_keys_are_left_out(spark, near, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 2)
    df = spark.createDataFrame(near, "doc_id long, text string").repartition(4)
    for n, num in ((4, 85), (5, 80), (3, 50)):
        assert sorted(tuple(r) for r in jaccard.linked_components(df, n=n, num=num).collect()) == brute_components(near, n, num, 100)


def test_keys_that_run_over_batches(spark, monkeypatch):
    rows = [(k, i) for k in range(-20, 20) for i in range((k * 7) % 23) for _ in range(1 + i % 2)]
    monkeypatch.setattr(jaccard, "HOT", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = jaccard.shared_keys(spark.createDataFrame(rows, "key long, id long").repartition(3)).distinct().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ids = {k: sorted({i for q, i in rows if q == k}) for k in {k for k, _ in rows}}
    want = {(None, v[0], i) for v in ids.values() if len(v) <= 5 for i in v[1:]} | {(k, None, i) for k, v in ids.items() if len(v) > 5 for i in v}
    assert {tuple(r) for r in got} == want


def thue_morse(first, second, size=1024):
    """Two words that polynomial hashes modulo 2**64 cannot tell apart."""
    bits = [bin(k).count("1") & 1 for k in range(size)]
    return "".join(first if b else second for b in bits), "".join(second if b else first for b in bits)


def test_words_with_equal_polynomials_are_not_linked(spark):
    one, two = thue_morse("a", "b")
    df = spark.createDataFrame([(1, one), (2, two), (3, f"x y {one} z q"), (4, f"x y {two} z q"), (5, two)], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.linked_components(df, n=4, num=85).collect()) == [(1, 1, 1), (2, 1, 2), (3, 2, 3), (4, 2, 4), (5, 1, 2)]


def test_rows_that_repeat_an_id_are_one_document(spark, near):
    words = [t for _, t in near if t and len(t) > 200]
    rows = [(1, words[0]), (1, words[1]), (1, words[1]), (2, words[1]), (3, words[0]), (4, words[2]), (4, words[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stands = min(words[:2], key=lambda t: df.sparkSession.range(1).selectExpr(f"xxhash64('{t}')").first()[0])
    root = {1: 1, 2: 1 if stands == words[1] else 2, 3: 1 if stands == words[0] else 3, 4: 4}
    got = sorted(tuple(r) for r in jaccard.linked_components(df, n=4, num=85).collect())
    assert got == sorted((i, len(shingles(t, 4)), root[i]) for i, t in rows)
    kept = sorted(tuple(r) for r in jaccard.keep_one(df, n=4, num=85).collect())
    assert [i for i, _ in kept] == sorted(set(root.values()))


def test_chains_contract(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    roots = {r.id: r.root for r in jaccard.components(edges).collect()}
    assert set(roots.values()) == {0, 100} and len(roots) == 63


def test_one_of_each_group_stays(spark, near):
    df = spark.createDataFrame([(i, t, "x") for i, t in near] + [(None, "a b c d", "x")], "doc_id long, text string, root string")
    kept = jaccard.keep_one(df)
    want = {i for i, _, root in brute_components(near, 5, 80, 100) if i == root}
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == want | {None}
    assert jaccard.keep_one(df.limit(0)).count() == 0


def test_two_stage_order():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 60)
        t = bytes(rng.choice(b"abc"[: rng.randint(1, 3)]) for _ in range(n))
        want = np.array(sorted(rng.sample(range(n), rng.randint(1, n))))
        order = suffix_dedup.two_stage(t, want, 200)
        assert order.tolist() == sorted(want.tolist(), key=lambda i: t[i:])
        for a, b, got in zip(order[:-1], order[1:], suffix_dedup.common_prefixes(t, order, 10)[1:]):
            assert got == next((k for k in range(10) if t[a + k : a + k + 1] != t[b + k : b + k + 1] or a + k >= n or b + k >= n), 10)


def brute_repeats(rows, size):
    count, texts = collections.Counter(), [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        count.update(b[p : p + size] for p in range(len(b) - size + 1))
    out = []
    for i, b in texts:
        gone = [0] * len(b)
        for p in range(len(b) - size + 1):
            if count[b[p : p + size]] > 1:
                gone[p : p + size] = [1] * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(g and (not p or not gone[p - 1]) for p, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("block, shard", [(400, 1 << 20), (5, 2000)])
def test_repeats(spark, monkeypatch, block, shard):
    monkeypatch.setattr(suffix_dedup, "BLOCK_CONTEXTS", block)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, rows = text(70), []
    for k in range(60):
        a = text(rng.randint(0, 120))
        rows.append((k, a[: len(a) // 2] + passage[rng.randint(0, 20) : rng.randint(40, 70)] + a[len(a) // 2 :] if k % 2 else a))
    rows += [(900, "a" * 200), (901, "ab" * 80), (902, None), (903, ""), (904, rows[5][1]), (905, rows[5][1]), (906, "x" * 39)]
    rows += [(905, rows[5][1]), (None, rows[7][1]), (None, rows[7][1]), (None, None)]
    df = spark.createDataFrame([(i, t, "y") for i, t in rows], "doc_id long, text string, spans string").repartition(3)
    out = suffix_dedup.remove_repeats(df, length=40, anchor=16)
    order = lambda r: (r[0] is not None, r)
    assert sorted((tuple(r) for r in out.drop("kept", "text").collect()), key=order) == brute_repeats(rows, 40)
    assert all(r.text.encode() == bytes(r.kept) for r in out.collect())
    assert suffix_dedup.remove_repeats(df.limit(0), length=40, anchor=16).count() == 0


def test_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LONG_BYTES", 4096)
    rng = random.Random(4)
    shared = "".join(rng.choice("abcdefgh") for _ in range(300))
    long = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(1, long(2000) + shared + long(4000) + shared[:90] + long(500)), (2, shared[100:] + long(50)), (3, long(9000) + "\u00e9" + shared[50:200])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffix_dedup.remove_repeats(df, length=40, anchor=16)
    assert sorted(tuple(r) for r in out.drop("kept", "text").collect()) == brute_repeats(rows, 40)


def test_memory_of_a_long_text():
    raw = np.random.default_rng(1).integers(97, 123, 4 << 20).astype(np.uint8)
    tracemalloc.start()
    run = suffix_dedup._long if len(raw) >= suffix_dedup.LONG_BYTES else suffix_dedup.anchored
    extra = run(raw, np.array([0, len(raw)]), 400, 160, b"k")[2]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (extra + 1).sum() == len(raw) - 399  # every string once
    assert peak < 64 << 20


def test_last_step_is_a_work_table(spark, tmp_path):
    spark.createDataFrame([(1, "a" * 900), (2, "b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for out in (suffix_dedup.remove_repeats(spark.read.parquet(str(tmp_path / "documents.parquet"))), suffix_dedup.op9_suffix_dedup(spark, str(tmp_path))):
        # its texts went to Python in bounded batches, not in those of whoever reads the rows
        assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.n_removed for r in out.collect()) == [0, 900]
    assert "kept" not in out.columns


def test_documents_are_read_in_parts(spark, monkeypatch):
    asked, docs = {}, spark.createDataFrame([(1, "a" * 900), (2, "b")], "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "table", lambda *_, **options: asked.update(options) or docs)
    assert suffix_dedup.op9_suffix_dedup(spark, "").count() == 2
    assert asked == {"parquet.hadoop.vectored.io.enabled": "false"}


def test_hot_marks_have_a_row_for_each_range(spark, monkeypatch):
    """Many contexts that end alike and begin apart: strings are made of their different sides alone, not again for each context."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_CONTEXTS", 5)
    rng, kept, materialise = random.Random(8), {}, suffix_dedup.materialise

    def counted(df, label, *more):
        out = materialise(df, label, *more)
        kept[label] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "materialise", counted)
    text = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    passage, ends = text(60), [text(30) for _ in range(3)]
    rows = [(k, text(40) + passage + ends[k % 3]) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffix_dedup.remove_repeats(df, length=40, anchor=16)
    assert sorted(tuple(r) for r in out.drop("kept", "text").collect()) == brute_repeats(rows, 40)
    assert 0 < kept["repeats-hot-marks"] <= kept["repeats-ranges"]


def test_many_entries_are_not_broadcast(spark):
    docs = spark.createDataFrame([(1, 2, "x"), (3, 4, "y")], "a long, b long, text string")
    for n, kind in ((10, "BroadcastHashJoin"), (60_000, "ShuffledHashJoin")):
        rows = spark.range(1, 2).selectExpr("id AS a", "id + 1 AS b", f"sequence(1, {n}) AS w")
        out = suffix_dedup._attach(docs, rows, "w", "left")
        assert kind in out._jdf.queryExecution().executedPlan().toString()
        assert {(r.text, r.n) for r in out.selectExpr("text", "coalesce(size(w), -1) AS n").collect()} == {("x", n), ("y", -1)}


def brute_contamination(docs, items, window=13):
    rx, low = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    words = lambda t: rx.findall((t or "").encode().translate(low))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for p in range(max(0, len(w) - window) + 1 if w else 0):
            wins[tuple(w[p : p + window])].add(str(i))
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = [0] * len(w), set()
        for size in {len(k) for k in wins}:
            for p in range(len(w) - size + 1):
                if tuple(w[p : p + size]) in wins:
                    found |= wins[tuple(w[p : p + size])]
                    hit[p : p + size] = [1] * size
        out.append((d, len(w), sum(hit), sorted(found), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_contamination(spark, limit):
    items = [(1, "a b c d"), (2, "x y"), (3, None), (4, "!!"), (5, " ".join(f"w{i}" for i in range(20))), (6, "X y"), (7, "é, Ä z")]
    docs = [(1, "A b c d e x Y"), (2, None), (3, ""), (4, " ".join(f"w{i}" for i in range(3, 30))), (5, "a b c x"), (6, "x"), (7, "y z x y"), (8, "é ä z é Ä z"), (8, "é ä z é Ä z"), (9, "q " * 50 + "x y")]
    d = spark.createDataFrame([(i, t, "h") for i, t in docs], "doc_id long, text string, benchmark_hits string")
    b = spark.createDataFrame(items, "item_id int, text string")
    found, name = decontaminate.matches(d, b, block_bytes=limit)
    assert name == "benchmark_hits_1"
    got = [(r.doc_id, r.n_words, r.n_hit, r.items, r.bad) for r in found.selectExpr("doc_id", f"{name}.n_words", f"{name}.items", f"{name} as h").withColumns({"n_hit": decontaminate.hit_words("h"), "bad": decontaminate.contaminated("h")}).collect()]
    assert sorted(got) == sorted(brute_contamination(docs, items))
    if limit > 40:
        kept = decontaminate.decontaminate(d, b)
        assert kept.columns == d.columns and kept.count() == sum(not x[4] for x in got)
        assert decontaminate.decontaminate(d, b.limit(0)).count() == len(docs) and decontaminate.decontaminate(d.limit(0), b).count() == 0
        long = next(r for r in found.select("doc_id", name).collect() if r.doc_id == 4)[1]
        assert (long.longest_match, long.longest_item, long.longest_at_word, long.longest_item_word) == (17, "5", 0, 3)


def test_items_of_null_id_hit(spark):
    named, unnamed = (" ".join(f"{k}{i}" for i in range(20)) for k in "nu")
    d = spark.createDataFrame([(1, "x " + unnamed + " y"), (2, named + " z " + unnamed), (3, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(7, named), (None, unnamed)], "item_id long, text string")
    for limit in (1 << 20, 40):
        found, name = decontaminate.matches(d, b, block_bytes=limit)
        got = {r.doc_id: (r.n, r["items"], r.longest_match, r.bad) for r in found.select("doc_id", decontaminate.hit_words(name).alias("n"), f"{name}.items", f"{name}.longest_match", decontaminate.contaminated(name).alias("bad")).collect()}
        assert got == {1: (20, [], 20, True), 2: (40, ["7"], 20, True), 3: (0, [], 0, False)}
    assert [r.doc_id for r in decontaminate.decontaminate(d, b).collect()] == [3]
