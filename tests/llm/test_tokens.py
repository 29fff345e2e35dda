"""Token operators against the libraries on odd, empty, long and planted texts."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelake.llm import encode, packing, token_counts, token_output
from tracelake.llm.common import utf8, work_path

ODD = [
    None, "", "  ", " a", "a ", "a  b", "x\n y", "x \ny", "a\tb c", "▁ a ▁b", "<|endoftext|> hi <|endoftext|>", "<s> x</s>", "don't  stop 'll, ok. Yes.", "a b", "é ́x",
    "\n\n\n", " \n", "1 2  3", "a\x1c b\x85 c", "ΑΣ ΟΔΟΣ", "word " * 5000, "z" * 3000, "same", "same", "x), y. Z,a",
]
DDL = "doc_id long, text string, source string, n_tokens string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, [None, "a", "a", "b"][i % 4], "clash") for i, t in enumerate(ODD)], DDL).repartition(3)


def path(name):
    return public_tokenizers.path(name)


def ids_of(name, end):
    t = Tokenizer.from_file(path(name))
    return [np.asarray(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4") for x in ODD]


def test_counts(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    got = sorted(token_counts.token_counts(docs, path("piece_bpe_32k.model"), limit=100).collect())
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 100) for i, t in enumerate(ODD)]
    assert [tuple(r) for r in got] == want
    own = [len(x) - 1 for x in ids_of("byte_bpe_50k.json", 0)]
    assert [r.n_tokens for r in sorted(token_counts.token_counts(docs, path("byte_bpe_50k.json")).collect())] == own
    assert token_counts.token_counts(docs.limit(0), path("piece_bpe_32k.model")).count() == 0


def test_output_round_trip_and_pruning(spark, docs):
    target = work_path(spark, "ids")
    token_output.write_token_ids(docs, target, path("word_bpe_49k.json"), 1, False, partitions=3)
    ids = ids_of("word_bpe_49k.json", 1)
    back = sorted(token_output.read_token_ids(spark, target).collect())
    assert [list(r.ids) for r in back] == [x.tolist() for x in ids]
    start = np.cumsum([0] + [len(x) for x in ids])
    got = [tuple(r) for r in sorted(token_output.token_layout(spark, target).collect())]
    assert got == [(i, int(start[i]), len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)]
    one = token_output.read_token_ids(spark, target, doc_ids=[7])
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in one._jdf.queryExecution().toString()
    assert token_output.read_token_ids(spark, target, low=3, high=5).count() == 3


def test_output_of_nothing_and_of_repeated_ids(spark, docs):
    target = work_path(spark, "ids")
    token_output.write_token_ids(docs.limit(0), target, path("word_bpe_49k.json"), 1, False, partitions=2)
    assert token_output.token_layout(spark, target).count() == 0
    rows = [(None, "one two", "a", ""), (None, None, None, ""), *[(3, f"text {i % 7}", "a", "") for i in range(40)], (2, "x", "a", "")]
    target = work_path(spark, "ids")
    token_output.write_token_ids(spark.createDataFrame(rows, DDL).repartition(3), target, path("word_bpe_49k.json"), 1, False, partitions=4)
    got = sorted(token_output.token_layout(spark, target).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 2] + [3] * 40
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    ids = [np.asarray(Tokenizer.from_file(path("word_bpe_49k.json")).encode(t or "", add_special_tokens=False).ids + [1], "<u4") for _, t, _, _ in rows]
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(x.tobytes()) for x in ids)


def test_part_files_sort_by_number():
    names = ["part-100000-x.orc", "part-10001-x.orc", "part-00002-x.orc"]
    assert sorted(names, key=token_output.part_number) == names[::-1]


@pytest.mark.parametrize("name,keeps_space", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
@pytest.mark.parametrize("memo", [6, 800_000])
def test_encoder_gives_the_ids_of_the_library(name, keeps_space, memo):
    parts = [
        "'s", "'S", "\u03a3", "\u0391\u03a3", "\u0130", "\u0130$", "\u00e9", "e\u0301", "\u0301", "<|endoftext|>", "<|EndOfText|>", "<", "|", "\u00d7.", "\u00f7.", "\t", "\r",
        "\u00a0", "\u200b", "\u1c80", "a", "The", "foo.", "x$$$", "A.B", "9", "12,", "e\u0338", "<\u0338", "\ufb01", "\x1c", "\x85", "\u00df", "\u1e9e", "_", "\u4f60", "\ud55c", "\u1112\u1161", "don't", "a)", "", "\x00",
    ]
    rng = np.random.default_rng(3)
    texts = ["".join(parts[rng.integers(len(parts))] + ["", " ", " ", "\n", "  "][rng.integers(5)] for _ in range(rng.integers(25))) for _ in range(3000)]
    texts += [" ".join(["One.", "two,\nThree", "four!?", "a\n\nb.", "'s.", "x\n'll", "e\n", "<|endoftext|>\nB", "b.\n<|endoftext|>"][k] for k in rng.integers(9, size=4)) for _ in range(500)]
    encoder = encode.IdEncoder(path(name), keeps_space, memo)
    library = Tokenizer.from_file(path(name))
    for at in range(0, len(texts), 100):
        ids, bounds = encoder(*utf8(pa.array(texts[at : at + 100])))
        got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts[at : at + 100]]


@pytest.mark.parametrize("targets", [None, {"a": 0.8, "b": 0.1}])
def test_packing(docs, targets):
    ids = ids_of("byte_bpe_50k.json", 0)
    rows = packing.pack(docs, path("byte_bpe_50k.json"), targets=targets, length=64, window=256, with_ids=True).collect()
    for i, x in enumerate(ids):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [t for r in own for t in r.ids] == x.tolist() and all(r.doc_tokens == len(x) for r in own)
        assert all(r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) for r in own)
    sizes = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sizes.get(r.sequence_id, 0)
        sizes[r.sequence_id] = r.offset + r.length
    assert sorted(sizes) == list(range(len(sizes))) and all(n == 64 or n & (n - 1) == 0 for n in sizes.values())


def test_shares_hold_in_every_window():
    plan = packing.Plan({"a": 3000, "b": 1000, None: 2000}, window=600, length=100)
    served = {s: [0] * 10 for s in plan.queue}
    for s, n in (("a", 3000), ("b", 1000), (None, 2000)):
        for g, many, win in plan.place(s, 0, n):
            served[s][win // 600] += many
    assert served == {"a": [300] * 10, "b": [100] * 10, None: [200] * 10}


def test_packing_of_nothing(docs):
    assert packing.pack(docs.limit(0), path("byte_bpe_50k.json")).count() == 0


def test_a_clashing_name_is_no_problem(docs):
    assert packing.pack(docs.withColumn("sequence_id", F.lit("x")), path("byte_bpe_50k.json"), length=64).count() > 0
