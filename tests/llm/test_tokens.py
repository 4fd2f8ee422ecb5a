"""Operators 1 and 4 against the libraries, over whole texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from glyphmill.llm import bpe, queries, wavelet
from tests.llm.helpers import ODD, SF, documents

PATH = public_tokenizers.path(queries.BYTE_RANKS)
WORDS = public_tokenizers.path(queries.WORD_VOCABULARY)


@pytest.fixture(scope="module")
def byte_library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def word_library():
    tok = Tokenizer.from_file(WORDS)
    tok.encode_special_tokens = True
    return tok


def random_texts(alphabet, n, size, seed=1):
    pick = random.Random(seed)
    return ["".join(pick.choice(alphabet) for _ in range(pick.randrange(size))) for _ in range(n)]


def test_byte_ids_equal_the_library(byte_library):
    texts = [t or "" for t in ODD] + random_texts(" \n\t ab1.,é's", 500, 60) + random_texts("abcdeth", 3, 20_000) + ["aaa " * 50, "ab" * 3000, "it's don't we'll"]
    enc = bpe.BytePairEncoder(bpe.load_ranks(PATH), public_tokenizers.PATTERN)
    for text, ids in zip(texts, enc.encode_batch(texts)):
        assert ids.tolist() == byte_library.encode_ordinary(text)
        assert enc.decode(ids.tolist()) == text.encode()


def test_leftmost_minimum_rank_of_a_small_vocabulary():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259, b"aaa": 255 + 5}
    enc = bpe.BytePairEncoder(ranks, r"\S+")
    brute = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for text in random_texts("abc", 300, 30) + random_texts("ab", 3, 900):
        assert enc.encode_batch([text])[0].tolist() == brute.encode_ordinary(text)


def test_long_and_short_merging_agree():
    enc = bpe.BytePairEncoder(bpe.load_ranks(PATH), public_tokenizers.PATTERN)
    for text in random_texts("abcdefghijklmnop", 40, 120, seed=5):
        if text:
            assert enc.merge_long(text.encode()) == enc.merge_rows([text.encode()])[0]


def test_round_trip_query(spark, byte_library):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, ODD[3]), (None, "null id")]
    docs = documents(spark, rows).withColumnRenamed("source", "n_tokens")
    got = bpe.bpe_round_trip(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    want = sorted((str(k), len(i := byte_library.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.bpe_round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_word_ids_equal_the_library(word_library):
    enc = wavelet.WordEncoder(WORDS, 1)
    texts = [t or "" for t in ODD] + random_texts(" \n.,abé1)ß-×'", 1500, 40) + random_texts(" \n\t ab1.,é'śΣA", 1500, 40) + ["<|endoftext|> x", "a ́b\ńc", "foo. Bar,\nbaz."]
    for text, ids in zip(texts, enc.encode_batch(texts)):
        assert ids.tolist() == [*word_library.encode(text, add_special_tokens=False).ids, 1], text


def test_wavelet_matrix_queries():
    x = np.random.default_rng(0).integers(0, 300, 2000)
    w = wavelet.WaveletMatrix.build(x)
    w = wavelet.WaveletMatrix.from_bytes(w.n, len(w.planes), w.to_bytes())
    assert w.decode().tolist() == x.tolist() == [w.access(i) for i in range(len(x))]
    for v in (*range(0, 310, 7), -1, 512):
        at = np.flatnonzero(x == v)
        assert w.count(v) == len(at)
        assert w.count(v, 100, 900) == ((at >= 100) & (at < 900)).sum()
        assert [w.select(v, k) for k in range(len(at))] == at.tolist() and w.select(v, len(at)) == -1
    assert wavelet.WaveletMatrix.build(np.zeros(0, np.uint32)).decode().size == 0


def test_shards_read_back(spark, word_library):
    rows = [(100 - k, t) for k, t in enumerate(ODD)] + [(None, "first of all"), (50, "twice"), (50, "twice")]
    shards = wavelet.write_shards(documents(spark, rows), WORDS, 1, shard_tokens=40)
    got = wavelet.read_documents(shards).orderBy("start").collect()
    ids = {k: [*word_library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in rows}
    at = 0
    for r, key in zip(got, sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0)), strict=True):
        want = np.array(ids[key], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    assert sum(r.n for r in wavelet.find_token(shards, 1).collect()) == len(rows)
    empty = wavelet.write_shards(documents(spark, rows).limit(0), WORDS)
    assert wavelet.read_documents(empty).count() == 0


def test_wavelet_query(spark, word_library):
    got = {r.doc_id: r for r in queries.op4_wavelet_ids(spark, SF).collect()}
    at = 0
    for doc in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*word_library.encode(doc.text or "", add_special_tokens=False).ids, 1], "<u4")
        r = got[doc.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
