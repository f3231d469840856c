"""Token files and byte-level BPE against the libraries' own whole-text results."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F

from specforge.llm import byte_bpe, queries, token_files
from specforge.llm.common import work_dir

WORDS, RANKS = path("word_bpe_49k.json"), path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def whole_words():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(WORDS)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def whole_bytes():
    import tiktoken
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda s: e.encode_ordinary(s or "")


def bits(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_code_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = token_files.pack(v)
        assert (token_files.unpack(control, data)[:n] == v).all() and len(control) == (n + 3) // 4


def test_words_encode_as_whole_texts(whole_words):
    rng = random.Random(1)
    parts = ["a", "The", "don't", "I'LL", ",", ".", "!?", " ", "\n", "\t", "é", "É", "漢字", "\x1c", "́", "x^y", "^", "<|endoftext|>",
             "<|ENDOFTEXT|>", "İ", "Σ", "12", "٣", "J̌", " ", "end.", "(so)", "#5;", "…", "😀", "\xa0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)]
    encoder = token_files.Encoder(WORDS)
    assert encoder.words
    ids, at = encoder(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [whole_words(t) for t in texts]


def expected(rows, encode):
    """Rows of op1 from (doc_id, text): null first, repeated ids by checksum."""
    made = [(i, encode(t) + [1]) for i, t in rows]
    made.sort(key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(bits(r[1]))))
    out, start = [], 0
    for i, ids in made:
        out.append((i, start, len(ids), zlib.crc32(bits(ids))))
        start += len(ids)
    return sorted(out, key=repr)


def test_token_files_edges(docs, whole_words):
    got = token_files.round_trip(docs.withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(1)), WORDS, 1)
    want = expected([(r.doc_id, r.text) for r in docs.collect()], whole_words)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_token_files_blocks_and_hot_id(spark, whole_words, monkeypatch):
    """Several blocks a shard; one id with most rows takes several shards."""
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 200)
    rows = [(7 if i % 3 else i, f"text number {i} of the pile") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    folder = work_dir(spark)
    got = token_files.round_trip(df, WORDS, 1, folder)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows, whole_words)
    assert spark.read.parquet(f"{folder}/blocks").where("doc_ids is not null").select("shard").distinct().count() > 3


def test_token_files_empty(nothing):
    assert token_files.round_trip(nothing, WORDS, 1).collect() == []


def test_op1(spark, sf, whole_words):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.QUERIES["op1_token_files"](spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows, whole_words)


def test_pieces_encode_as_whole_texts(whole_bytes):
    rng = random.Random(2)
    encoding = byte_bpe.load(RANKS, PATTERN)
    parts = ["a", "B", "'s", "'", "  ", "\n", "\t", " ", "　", "é", "1", "٣", "!", "漢", "\x1c", "́", " x", "😀", "\x85"]
    for _ in range(500):
        s = "".join(rng.choice(parts) for _ in range(50))
        cut = list(byte_bpe.pieces(s, 3))
        assert "".join(cut) == s
        assert [i for p in cut for i in encoding.encode_ordinary(p)] == whole_bytes(s)


def test_bpe_edges(docs, whole_bytes, nothing):
    for r in byte_bpe.digests(docs.withColumn("n_tokens", F.lit("x")), RANKS, PATTERN, ["doc_id", "text"]).collect():
        ids = whole_bytes(r.text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(bits(ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    both = byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert all(bytes(r.bytes).decode() == (r.text or "") for r in both.collect())
    assert byte_bpe.encode(nothing, RANKS, PATTERN).collect() == []


def test_op4(spark, sf, whole_bytes):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op4_byte_bpe"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids_sha256 == hashlib.sha256(bits(whole_bytes(rows[r.doc_id]))).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((rows[r.doc_id] or "").encode()).hexdigest()
