import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexiquarry.llm import packing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, extra string, ids string"


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_encoder_equals_tokenizers(spark, reference):
    encode = packing.Encoder(packing.default_vocabulary())
    rng = random.Random(1)
    parts = ["word", "it's", " ", "  ", "\n", "\t", " ", "é", "日本", "!!", "12", "'ll", "<|endoftext|>", "\x00", "x\ny", " 's", "\r\n", "\x85", "\x1c", "🙂", "ß."]
    texts = ["", " ", "a", "a b", "a <|endoftext|> b", "<|endoftext|>", " <|endoftext|><|endoftext|>x", "<|endoftext", "a\x00b \x00c", "a\nb c", " a", "a ", "I'm sure they'll\ncome 100%"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == reference(t), repr(t)


def check(rows, want, capacity=2048):
    """rows have each wanted (doc_id, ids) once, whole, in gapless sequences."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, ids in want.items():
        n = len(ids)
        pieces = sorted(by_doc.pop(doc))
        assert [p[0] for p in pieces] == list(range(len(pieces))) and len(pieces) == -(-n // capacity)
        at = 0
        for k, start, length, crc in pieces:
            assert start == at and (k == 0 or length == capacity)
            assert crc == zlib.crc32(np.asarray(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == n
    assert not by_doc
    return len(by_sequence)


def test_query(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: [*reference(r["text"] or ""), 0] for r in docs}
    n = check(packing.op1_packing(spark, SF).collect(), want)
    assert n <= 1.02 * sum(map(len, want.values())) / 2048 + 2


def test_hard_rows(spark, reference, tmp_path):
    rows = [(1, None, "x", "y"), (2, "", None, None), (3, "long " * 9000, "x", "y"), (None, "no id", "x", "y"), (5, "twice", "x", "y"), (5, "twice", "x", "y")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = packing.pack(frame).collect()
    assert sorted((str(r["doc_id"]), r["piece"]) for r in got) == sorted([("1", 0), ("2", 0), *(("3", k) for k in range(-(-(len(reference(rows[2][1])) + 1) // 2048))), ("None", 0), ("5", 0), ("5", 0)])
    assert all(len(r["ids"]) == 4 * r["length"] for r in got)
    assert packing.pack(frame.limit(0)).count() == 0


def test_tree_meets_few_bins(spark):
    """Sizes that fit only across partitions: the count doesn't follow from how the table is split."""
    rows = [(k, 1500 if k < 200 else 500) for k in range(400)]
    for n in (4, 8, 16):
        items = packing.stash(spark.createDataFrame(rows, "item_id long, length long").repartitionByRange(n, "item_id"), "items")
        out = packing.assign(items, fan_in=4).collect()
        assert len(out) == 400 and len({r["sequence_id"] for r in out}) == 200


def test_many_leaves_and_groups(spark):
    """Leaves and groups of the tree far smaller than the table: every item once, gapless, and nearly as few sequences."""
    rng = random.Random(3)
    rows = [(k << 3, rng.randrange(1, 2049)) for k in range(6000)]
    length, least = dict(rows), sum(n for _, n in rows) / 2048
    items = packing.stash(spark.createDataFrame(rows, "item_id long, length long"), "items")
    for leaf, group in ((100, 500_000), (100, 50)):
        by = defaultdict(list)
        for r in packing.assign(items, fan_in=4, leaf_items=leaf, group_items=group).collect():
            by[r["sequence_id"]].append((r["offset"], r["item_id"]))
        assert sorted(i for x in by.values() for _, i in x) == sorted(length)
        for parts in by.values():
            at = 0
            for offset, i in sorted(parts):
                assert offset == at
                at += length[i]
            assert at <= 2048
        assert len(by) <= 1.1 * least  # bins of so small leaves close early


def test_best_fit_is_best():
    lengths = np.asarray([1000, 600, 448, 1400, 648, 2048, 1])
    into, offset, fills = packing.best_fit(lengths, 2048)
    assert fills.sum() == lengths.sum() and fills.max() <= 2048 and len(fills) <= 4
    for b in range(len(fills)):
        spans = sorted((offset[i], lengths[i]) for i in np.flatnonzero(into == b))
        assert all(a + n == c for (a, n), (c, _) in zip(spans, spans[1:]))
