import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from netloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY = open(PATH, encoding="utf-8").read()
SF = "/root/testdata/sf0.001"


def plain_ids(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoder_equals_library():
    rng = random.Random(1)
    odd = [" ", "\n", "\t", "  ", " ", "\x1c", "　", "\x85", "a", "B7", "it's", "é", "!", "!\x1c", "中文", "😀", "<|endoftext|>", "\r\n", "", "\0"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(12))) for _ in range(3000)]
    texts += ["", " ", "a " * 50_000, "x" * 70_000, ("ab\ncd " * 20_000).strip(), " lead", "trail ", "a  b   c \n d"]
    ids, sizes = packing.Encoder(VOCABULARY).encode(pa.array(texts))
    for got, want in zip(np.split(ids, np.cumsum(sizes)[:-1]), plain_ids(texts), strict=True):
        assert got.tolist() == want


def test_other_vocabularies_go_by_the_library():
    """Ids that don't follow the merges, or another split, leave all pieces to the library."""
    whole = json.loads(VOCABULARY)
    assert packing._short_encoder(whole) is not None
    assert packing._short_encoder(whole | {"pre_tokenizer": {"type": "Whitespace"}}) is None
    model = whole["model"] | {"merges": whole["model"]["merges"][1:] + whole["model"]["merges"][:1]}
    assert packing._short_encoder(whole | {"model": model}) is None
    other = packing.Encoder(VOCABULARY)
    other.short = None
    texts = ["One two, three.", " four"]
    assert other.encode(pa.array(texts))[0].tolist() == sum(plain_ids(texts), [])


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    encoder = packing.Encoder(VOCABULARY)
    for texts in (["one two three four"], ["five six one two"], ["one two", None], []):
        assert encoder.encode(pa.array(texts, pa.string()))[0].tolist() == sum(plain_ids(texts), [])


@pytest.mark.parametrize("sizes", [[], [1], [2048], [2049, 2047], [1500] * 40, [1] * 5000, [257] * 9, [100_000, 3], [i * 7919 % 5000 + 1 for i in range(700)]])
def test_pack(sizes):
    found = packing.pack(sizes)
    seen = defaultdict(list)
    for pieces in found:
        n = sum(p[2] for p in pieces)
        assert n <= 2048 and n & (n - 1) == 0
        for d, at, k in pieces:
            seen[d].append((at, k))
    assert sorted(seen) == list(range(len(sizes)))
    for d, parts in seen.items():
        at = 0
        for start, k in sorted(parts):
            assert start == at and k > 0
            at += k
        assert at == sizes[d]
    small = [sum(p[2] for p in pieces) for pieces in found if sum(p[2] for p in pieces) < 256]
    assert len(small) == len(set(small))  # only the last ones
    whole = sum(len(p) == 1 for p in seen.values())
    if len(sizes) > 500 and max(sizes) > 2048:  # most documents that fit a window stay in one piece
        assert whole > 0.6 * sum(n <= 2048 for n in sizes)


def test_tiers_are_checked():
    for bad in ((1000,), (256, 512), (512, 512)):
        with pytest.raises(ValueError):
            packing.pack([3], bad)


def held(rows, texts):
    """Every document's pieces hold its ids once, sequences are gapless; the sequences' tier and step."""
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0 and {r.tier for r in pieces} == {at} and len({r.step for r in pieces}) == 1
    assert by_doc.keys() == texts.keys()
    for (d, text), ids in zip(texts.items(), plain_ids(texts.values())):
        at, ids = 0, np.array(ids, "<u4")
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return by_seq


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    held(packing.op11_packing(spark, SF).collect(), texts)


def test_steps_are_balanced(spark):
    rng = random.Random(3)
    rows = [(i, "word " * rng.choice([3, 90, 400, 1500, 5000]), "x") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tier string").repartition(3)
    found = packing.pack_documents(docs, VOCABULARY, batch_tokens=50_000, step_tokens=16_384).collect()
    by_seq = held(found, {r[0]: r[1] for r in rows})
    steps = defaultdict(list)
    for pieces in by_seq.values():
        steps[pieces[0].tier, pieces[0].step].append(sum(r.length**2 for r in pieces))
    for tier in {t for t, _ in steps}:
        numbers = sorted(s for t, s in steps if t == tier)
        assert numbers == list(range(len(numbers)))
        assert all(len(steps[tier, s]) * tier == 16_384 for s in numbers[:-1])
        assert all(max(steps[tier, a]) <= min(steps[tier, b]) for a, b in zip(numbers, numbers[1:]))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (None, "a b"), (3, "same"), (3, "same"), (4, "long " * 9000)]
    docs = spark.createDataFrame([(d, t, "s", 7) for d, t in rows], "doc_id long, text string, sequence_id string, offset int")
    got = packing.pack_documents(docs, VOCABULARY).collect()
    assert sum(r.length for r in got) == sum(map(len, plain_ids([t for _, t in rows])))
    assert sorted((r.doc_tokens for r in got if r.doc_id in (1, 2))) == [1, 1]
    assert sum(r.length for r in got if r.doc_id is None) == 2 * len(plain_ids(["a b"])[0])
    assert packing.pack_documents(docs.filter("false"), VOCABULARY).collect() == []
    named = spark.createDataFrame([("x", "one")], "doc_id string, text string")
    assert [r.doc_id for r in packing.pack_documents(named, VOCABULARY).collect()] == ["x"] * len(packing.pack([len(plain_ids(["one"])[0])]))
