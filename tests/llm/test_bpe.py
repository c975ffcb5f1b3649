import hashlib
import random
import time

import pytest
import tiktoken
from pyspark.sql import functions as F

from layoutlens.llm import bpe


@pytest.fixture(scope="module")
def tools():
    path, pattern = bpe.default_vocabulary()
    ranks = bpe.read_ranks(path)
    return bpe.Codec(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_matches_the_library_and_round_trips(tools):
    codec, library = tools
    rng = random.Random(2)
    texts = ["", " ", "it's we'll 'd", "<|endoftext|>", "aaaa" * 40, "日本語 текст عربى", "  \n\n\t x  ", "émigré—naïve 12345 $$%"]
    texts += ["".join(rng.choices("ab cdeé'\n1!日😀", k=rng.randrange(60))) for _ in range(300)]
    ids = codec.encode(texts)
    assert ids.to_pylist() == [library.encode_ordinary(t) for t in texts]
    assert codec.decode(ids) == [t.encode() for t in texts]


def test_long_matches(tools):
    """One match of 200,000 characters in seconds, whether or not it can be cut, equal to the library's ids."""
    codec, library = tools
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)), "a" * 200_001, "ab" * 20_000, "=" * 30_001, "".join(rng.choices(["the", "of", "question", "a", "aa", "tion"], k=800)), " " * 9_001 + "x"]
    began = time.time()
    ids = codec.encode(texts)
    assert time.time() - began < 60
    assert ids.to_pylist() == [library.encode_ordinary(t) for t in texts] and codec.decode(ids) == [t.encode() for t in texts]


@pytest.mark.parametrize("letters", ["ab", "acgt", "aeinst", "01", "=-", " \u00a0"])
def test_long_matches_of_few_letters(tools, letters):
    """Merges that lower ones may overtake: 200,000 random letters in seconds, equal to the library's ids."""
    codec, library = tools
    text = "".join(random.Random(7).choices(letters, k=200_000))
    began = time.time()
    ids = codec.encode([text])
    assert time.time() - began < 30
    assert ids.to_pylist() == [library.encode_ordinary(text)] and codec.decode(ids) == [text.encode()]


def test_repetitions_beside_random_letters(tools):
    """Windows that have no token in common are encoded together, long ones in windows that begin with a token of the last."""
    codec, library = tools
    rng, texts = random.Random(3), []
    for _ in range(40):
        parts = [rng.choice(["a", "ab", "abc", "=", "the", "aab", "x" * 7]) * rng.randrange(1, 400) if rng.random() < 0.5 else "".join(rng.choices("abt", k=rng.randrange(1, 300))) for _ in range(rng.randrange(1, 6))]
        texts.append("".join(parts))
    texts += ["ab" * 20_000 + "".join(rng.choices("ab", k=500)) + "ba" * 9_000, "-" * 50_000 + "x", " " * 40_000 + "y"]
    assert codec.encode(texts).to_pylist() == [library.encode_ordinary(t) for t in texts]


def test_texts_of_megabytes(tools, monkeypatch):
    """5 and 20 MB, one of a single match, and one million letters: in bounded steps, decoded to the same bytes."""
    codec, library = tools
    rng = random.Random(8)
    texts = ["Some words, 123 and more of them! " * 160_000, "".join(rng.choices("abcdefghij", k=1_000_000)), " " * 5_000_000]
    ids = codec.encode(texts)
    assert codec.decode(ids) == [t.encode() for t in texts]
    assert ids[0].as_py() == library.encode_ordinary(texts[0]) and ids[1].as_py() == library.encode_ordinary(texts[1])
    largest = "naïve words, 4711 and then some. " * 600_000
    assert codec.decode(codec.encode([largest])) == [largest.encode()]
    assert max(map(len, codec.cache)) <= 4 * bpe.LONG


def test_query_columns(spark, tools):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = {r.doc_id: r for r in bpe.op10(spark, "/root/testdata/sf0.001").collect()}
    assert found.keys() == texts.keys()
    for doc_id, r in found.items():
        ids = tools[1].encode_ordinary(texts[doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[doc_id].encode()).hexdigest()


def test_whole_table_matches_the_library(spark, tools):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in bpe.encode_documents(documents).collect():
        assert r.ids == tools[1].encode_ordinary(texts[r.doc_id] or "") and bytes(r.decoded) == (texts[r.doc_id] or "").encode()


def test_edge_cases(make_documents):
    rows = [(None, None), (1, ""), (2, "same"), (2, "same"), (3, "long words " * 60_000), (4, "five megabytes " * 350_000)]
    found = bpe.encode_documents(make_documents(rows).withColumn("ids", F.lit(1))).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in found) == [(r[0] or 0, r[1] or "") for r in rows]
    assert bpe.encode_documents(make_documents([])).count() == 0
