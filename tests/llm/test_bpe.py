import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from netloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.load_ranks(PATH)
    return bpe.ByteBpe(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "Hello world", "aaaa" * 50, "a" * 5000, "é" * 777, "don't  stop\n\n\nnow\t x", "日本語テキスト🙂🙂", "x\u0085y\u001cz  w", "12345 67 a1b2", "***$$$ ### !!", "<|endoftext|> é́"]


def test_matches_library(both):
    own, lib = both
    rng = random.Random(5)
    mixed = ["".join(rng.choice("abcde éß日\n\t 12#'s") for _ in range(rng.randrange(400))) for _ in range(200)]
    long_word = "".join(rng.choice("abcdefghij") for _ in range(30_000))
    for text in [*TEXTS, *mixed, long_word]:
        ids = own.encode(text)
        assert ids == lib.encode_ordinary(text)
        assert own.decode(ids).decode() == text


def test_documents(spark, both):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, "x"), (2, TEXTS[2], "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode_documents(docs, bpe.load_ranks(PATH), public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        text = {i: t for i, t, _ in rows}[r.doc_id] or ""
        ids = both[1].encode_ordinary(text)
        assert (r.n_tokens, list(r.token_ids)) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(docs, bpe.load_ranks(PATH), public_tokenizers.PATTERN).collect() == []
