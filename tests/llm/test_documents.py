"""Quality rules, personal data, tool calls, site quality and the pipeline."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tracelake.llm import pii, quality, site_quality, tool_calls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(t):
    t = t or ""
    w = WORD.findall(t)
    seen, hit = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), [0] * len(w)
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            hit[i : i + 5] = [1] * 5
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(hit)


def test_measures(spark):
    rng = random.Random(1)
    texts = [None, "", " \n ", "a b c d e a b c d e", "a " * 3000, "x\ny\n\nx\nx \n y", "é #* ünï x", "a\x0bb\x1cc"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(150)] + ["".join(rng.choice("ab \n\t") for _ in range(80)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = [tuple(r.m) for r in df.orderBy("i").select(quality.measures(quality.text_of()).alias("m")).collect()]
    assert got == [measures(t) for t in texts]


def test_cascade_keeps_what_no_rule_rejects(spark):
    clean = "The quick brown fox jumps over the lazy dog while seven clever owls watch from an old oak tree."
    rows = [(1, clean), (2, "short"), (3, None), (4, clean.upper()), (5, "a %%% b &&& c ### d $$$ e *** f ||| g <<< h"), (6, "go on " * 40), (7, clean), (8, "Wow!! Yes!! No!! So!! Go!! He!! It!! Me!! We!! Us!! Do!!")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, rejected_by string")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 7]
    judged, name = quality.cascade(df)
    assert name == "rejected_by_1" and quality.keep_good(df.limit(0)).count() == 0
    forward, backward = ([r[0] for r in df.select(quality.first_rejection(F.col("text"), list(o)).isNull()).collect()] for o in (quality.RULES, quality.RULES[::-1]))
    assert forward == backward
    assert [r.name for r, _, _ in quality.estimate(df)] != []


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20\-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(t):
    out = []
    for k, kind in enumerate(PATTERNS):
        for m in re.finditer(PATTERNS[kind], t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_base_spans(spark):
    rng = random.Random(3)
    texts = [None, "", "a@b.c_d@e.f", "a@b.c.@d.e x@-.y", "256.1.1.1.1 001.2.3.4", "4111 1111 1111 1111", "+1 (017) 555-7713 4111-1111-1111-1111 " * 400, "a@b.cc " * 700, "a" * 2000, "1" * 2000, "+1" + "(" * 2000]
    texts += ["".join(rng.choice("a.b@-_%+ 12()0é\x01\n") for _ in range(rng.randint(0, 60))) for _ in range(600)] + ["".join(rng.choice("0123 -.+()@a") for _ in range(50)) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = [r.s for r in pii.extracted(df, keep=("i",)).orderBy("i").select(pii.written(F.col("base")).alias("s")).collect()]
    assert got == [base(t) for t in texts]


def test_weak_supervision_adds_spans_and_redaction_keeps_the_rest(spark):
    rows = [(1, 'é call +1 (017) 555-7713 or mail a.b@c.de. ok 97.51.17.173', "k"), (2, None, "k"), (3, "clean text only", "k")]
    rows += [(10 + i, f'x token = "{hashlib.sha1(str(i).encode()).hexdigest()}" y', "k") for i in range(40)] + [(100 + i, f"see commit {hashlib.sha1(str(i).encode()).hexdigest()} z", "k") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[1] == "é call <PHONE> or mail <EMAIL>. ok <IP>" and out[2] is None and out[3] == "clean text only"
    assert out[12] == 'x <SECRET>" y'
    assert pii.redact(df.limit(0)).columns == df.columns and pii.redact(df.limit(0)).count() == 0
    assert not pii.train(pii.extracted(df.limit(0)), "cands").weights


def test_long_secrets_are_whole_candidates(spark):
    rng = random.Random(6)
    token, key, letters = ("".join(rng.choice(signs) for _ in range(n)) for signs, n in (("abcXYZ019_-.", 5000), ("0123456789abcdef", 512), ("abcdef", 30)))
    texts = [f"x token = {token} y", f"key {key} z", f"see {letters} here", f"no {key}g here", "1" * 100_000 + "g", "token=" + "z" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = [[(c.shape, c.s, c.e) for c in r.c] for r in df.orderBy("i").select(pii.candidates(F.col("text")).alias("c")).collect()]
    assert got == [[("assigned", 2, 5010)], [("hex", 4, 516)], [("hex", 4, 34)], [], [], [("assigned", 0, 100_006)]]


def test_candidates_find_the_base_spans_themselves(spark):
    df = spark.createDataFrame([("token = 10.20.30.40x", ), ("token = abcdef123456xyz", )], "text string")
    own, given = pii.candidates(F.col("text")), pii.candidates(F.col("text"), pii.base_spans(F.col("text")))
    got = [[[(c.shape, c.s, c.e) for c in x] for x in r] for r in df.select(own, given).collect()]
    assert got == [[[], []], [[("assigned", 0, 23)]] * 2]


def test_redaction_leaves_nothing_of_long_secrets(spark):
    key = hashlib.sha512(b"k").hexdigest() * 3
    rows = [(i, f"x token = {hashlib.sha1(str(i).encode()).hexdigest()} y") for i in range(40)] + [(100 + i, f"see commit {hashlib.sha1(str(i).encode()).hexdigest()} z") for i in range(10)] + [(200, f"x token = {key} y")]
    out = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[12] == out[200] == "x <SECRET> y"


def test_em_finds_the_reliable_labeler():
    rng = random.Random(2)
    counts = collections.Counter()
    for _ in range(4000):
        y = rng.random() < 0.5
        vote = lambda right: int(y) if rng.random() < right else 1 - int(y)  # noqa: B023, E731
        counts[(vote(0.95), vote(0.9), vote(0.55), pii.ABSTAIN, pii.ABSTAIN)] += 1
    post, reliability = pii.em(counts)
    assert post[(1, 1, 0, 2, 2)] > 0.9 > 0.1 > post[(0, 0, 1, 2, 2)]
    assert reliability["shape"][0] > 0.85 > reliability["gazetteer"][0]


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [("a", 1, "reply", '{"turn": 1, "text":"xé\\"\\n"}', None), ("b", 2, "reply", '{"text":"","turn":1}', "a"), ("c", 3, "x", "{bad", "b"), ("d", 4, "reply", '{"text":"q","turn":1.5,"z":1}', "e"), ("e", 5, "reply", None, "d"), (None, 6, "reply", '{"text":"q","turn":1}', "zz")],
        "call_id string, position long, name string, arguments string, waits_for string",
    )
    results = spark.createDataFrame([("a", 2, "r2"), ("a", 1, "r1"), (None, 1, "n"), ("q", 1, "o")], "call_id string, position long, content string")
    got = {r.call_id: r for r in tool_calls.link_calls(calls, results, tool_calls.REPLY).collect()}
    assert {k: (r.level, r.linked, r.valid) for k, r in got.items()} == {"a": (0, True, True), "b": (1, False, False), "c": (2, False, False), "d": (None, False, False), "e": (None, False, False), None: (None, False, True)}
    assert got["a"].canonical == '{"arguments":{"text":"xé\\"\\n","turn":1},"id":"a","level":0,"name":"reply","result":"r1"}'
    assert tool_calls.link_calls(calls.limit(0), results, tool_calls.REPLY).count() == 0
    twice = tool_calls.link_calls(calls.union(calls).withColumn("level", F.lit("own")).withColumn("content", F.lit("own")), results, tool_calls.REPLY)
    assert twice.count() == 12 and {r.call_id: r.level for r in twice.collect()} == {k: r.level for k, r in got.items()}
    chain = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(70)], "call_id string, waits_for string")
    assert {int(r.call_id): r.level for r in tool_calls.levels(chain).collect()} == {i: i for i in range(70)}


def plain_levels(waits):
    """Levels by repeated peeling; ids left over lie on or behind cycles."""
    known, out = {c: {w for w in ws if w in waits} for c, ws in waits.items()}, {}
    while ready := [c for c in known if c not in out and all(w in out for w in known[c])]:
        out |= {c: max([out[w] + 1 for w in known[c]], default=0) for c in ready}
    return {c: out.get(c) for c in waits}


@pytest.mark.parametrize("seed,back", [(1, 0.0), (2, 0.03), (3, 0.2)])
def test_levels_with_several_dependencies(spark, seed, back):
    rng = random.Random(seed)
    waits = {}
    for i in range(120):
        pool = [str(rng.randrange(120)) if rng.random() < back else str(rng.randrange(max(0, i - 6), i)) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]) if i else 0)]
        waits[str(i)] = set(pool)
    rows = [(c, [*sorted(ws), None, "unknown"]) for c, ws in waits.items()] + [(None, ["1"]), ("0", None)]
    # a repeated call adds its own dependencies
    rows += [("119", ["5", "5"])]
    waits["119"] = waits["119"] | {"5"}
    got = tool_calls.levels(spark.createDataFrame(rows, "call_id string, waits_for array<string>")).collect()
    assert len(got) == 120 and {r.call_id: r.level for r in got} == plain_levels(waits)


def test_schemas_reach_into_objects_and_arrays(spark):
    schemas = {
        "t": {
            "a.b": {"type": "integer", "required": True}, "it's \"x\"?": {"type": "string", "pattern": "^v[0-9]+$"},
            "o": {"type": "object", "properties": {"k": {"type": "string", "required": True, "enum": ["x", "y"]}}},
            "l": {"type": "array", "maxItems": 2, "items": {"type": "object", "additional": True, "properties": {"n": {"type": "number", "minimum": 0, "required": True}}}},
        },
        "none": {},
    }
    cases = [
        ("t", '{"a.b":1}', True), ("t", '{"a":{"b":1}}', False), ("t", '{"a.b":"1"}', False), ("t", '{"a.b":null}', False), ("t", '{"a.b":1,"it\'s \\"x\\"?":"v12"}', True),
        ("t", '{"a.b":1,"it\'s \\"x\\"?":"w"}', False), ("t", '{"a.b":1,"o":{"k":"x"}}', True), ("t", '{"a.b":1,"o":{"k":"z"}}', False), ("t", '{"a.b":1,"o":{"k":"x","q":1}}', False),
        ("t", '{"a.b":1,"o":{}}', False), ("t", '{"a.b":1,"o":[1]}', False), ("t", '{"a.b":1,"l":[]}', True), ("t", '{"a.b":1,"l":[{"n":1.5},{"n":0,"z":[]}]}', True), ("t", '{"a.b":1,"l":[{"n":-1}]}', False),
        ("t", '{"a.b":1,"l":[{"n":1},{"n":1},{"n":1}]}', False), ("t", '{"a.b":1,"l":[3]}', False), ("t", "[]", False), ("t", "null", False), ("t", None, False), ("t", "", False),
        ("none", "{}", True), ("none", '{"x":1}', False), ("none", "1", False), ("u", "{}", False), (None, "{}", False),
    ]
    df = spark.createDataFrame([(i, n, a) for i, (n, a, _) in enumerate(cases)], "i long, name string, args string")
    got = [r.ok for r in df.orderBy("i").select(tool_calls.valid_arguments(F.col("name"), F.col("args"), schemas).alias("ok")).collect()]
    assert got == [ok for *_, ok in cases]


def test_tool_query_agrees_with_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(tool_calls.OP2_SQL).fetchdf().sort_values("call_id").astype(str).values.tolist()
    got = tool_calls.op2_tool_calls(spark, sf).toPandas().sort_values("call_id").astype(str).values.tolist()
    assert got == want


def test_site_quality_is_accurate_and_shrinks(spark):
    rng = random.Random(7)
    good, bad = [f"g{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        q = int(rng.random() < 0.7)
        words = [rng.choice(good if q or rng.random() < 0.5 else bad) for _ in range(40)] + ["alpha" if q else "omega"]
        rows.append((i, " ".join(w + "x" * rng.randint(0, 1) for w in words), f"h{i % 5}", None if i % 50 == 0 else "en"))
        if i % 2:
            labels.append((i, q, 0))
    df = spark.createDataFrame([*rows, (1000, None, "rare", "en")], "doc_id long, text string, source string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in site_quality.score(df, lab).collect()}
    truth = {i: int("alpha" in t.replace("x", "")) for i, t, _, _ in rows}
    held = [i for i in truth if i % 2 == 0]
    assert sum((out[i].quality_posterior >= 0.5) == bool(truth[i]) for i in held) / len(held) > 0.95
    rate = sum(q for _, q, _ in labels) / len(labels)
    assert out[1000].quality_site == pytest.approx(rate, abs=0.01) and len(out) == 601
    none = site_quality.score(df.limit(3), lab.limit(0)).collect()
    assert all(r.quality_posterior == 0.5 and r.quality_evidence == 0 for r in none)
    assert site_quality.score(df.limit(0), lab).count() == 0


def test_a_path_without_labels_has_its_hosts_posterior(spark):
    rows = [(i, "a", f"h{i % 4}", f"p{i // 4 % 5}") for i in range(400)] + [(1000 + i, "a", h, p) for i, (h, p) in enumerate([("h0", "new"), ("h1", "new"), ("h0", None), (None, "p0"), ("other", "p0")])]
    labels = [(i, int(i % 4 > 0), 0) for i in range(400)]
    out = {r.doc_id: r for r in site_quality.score(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(out) == len(rows)
    top = (300 + 0.5) / (400 + 1)
    assert out[1000].quality_site < 0.1 < 0.9 < out[1001].quality_site and out[1002].quality_site == out[1000].quality_site
    assert out[1000].quality_posterior < out[1003].quality_posterior < out[1001].quality_posterior
    assert out[1003].quality_site == out[1004].quality_site == pytest.approx(top)


def test_every_feature_of_a_long_document_counts(spark):
    rng = random.Random(8)
    foul, clean, plain = ([f"{k}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)] for k in "fcp")
    rows, labels = [], []
    for i in range(1200):
        t = i % 2
        rows.append((i, " ".join(rng.sample(foul, 8 if t else 1) + rng.sample(clean[3:], 1 if t else 8) + rng.sample(plain, 10) + (clean[:3] if not t else [])), "h", "p"))
        labels.append((i, 1, t))
    long = " ".join(foul * 3 + clean[:3] + plain)  # dozens of foul words and the three strongest clean ones
    rows += [(2000, long, "h", "p"), (2001, " ".join(clean + foul[:3] + plain), "h", "p")]
    out = {r.doc_id: r for r in site_quality.score(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert out[2000].toxic_posterior > 0.9 and out[2001].toxic_posterior < 0.1
    import numpy as np

    bits, y = np.packbits(np.repeat([[0], [1]], 1000, 0).astype(bool), axis=1), np.tile([1, 0, 0, 0], 500).astype(float)
    y[1000:] = 1 - y[1000:]
    offset, w = site_quality.logistic(bits, y, 1, 0.0)
    assert offset == pytest.approx(-1.0986, abs=0.02) and w[0] == pytest.approx(2.197, abs=0.03)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    vocab = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = text(30)
    a = text(120)
    rows = [(1, a), (2, a + " extra"), (3, text(100) + " mail me@site.org now"), (4, item + " " + text(60)), (5, "too short"), (6, None), (7, text(90))]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, str(tmp_path))
        kept[name] = {r.doc_id for r in d.collect()}
        assert name == "packing" or d.columns == docs.columns
    assert list(kept.values()) == [{1, 2, 3, 4, 7}, {1, 3, 4, 7}, {1, 3, 7}, {1, 3, 7}, {1, 3, 7}]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.collect()} == {1, 3, 7}
