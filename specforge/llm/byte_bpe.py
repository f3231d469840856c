"""Byte-level BPE encoding and decoding with tiktoken and a local rank file (operator 4).

Each text is cut at boundaries that no match of the split pattern can span, the
pieces go through the library, and the ids are decoded to raw bytes (a token may
hold part of a character, so decoding to text is left to the caller).

Null text: encoded as the empty text (no ids).  Empty tables give empty results.
Repeated rows stay repeated rows.  Extra columns are carried through only by
`encode`; columns of its own names are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from specforge.llm.common import batch_of, chunks, column, strings

# Texts above this many characters are cut before they are encoded.
PIECE_CHARS = 1 << 16
CHUNK_BYTES = 4 << 20   # text whose results are held at once

# A cut is safe where a printable ASCII character or a letter or digit is followed
# by an ASCII blank: in the split pattern a blank can only open a match or stand in
# a run of blanks, and nothing looks behind.
SAFE = regex.compile(r"(?<=[!-~\p{L}\p{N}])(?=[ \n\t\r])")


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of at least `size` characters that encode independently.

    A run without a safe boundary stays one piece, so nothing is ever cut inside it.
    """
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def load(path: str, pattern: str):
    """The encoding of a rank file, once per Python worker."""
    key = (path, pattern)
    if key not in _LOADED:
        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank)
                     for token, rank in (line.split() for line in lines if line.strip())}
        _LOADED[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks,
                                         special_tokens={})
    return _LOADED[key]


_LOADED: dict = {}


def encode_text(encoding, text: str) -> np.ndarray:
    """Ids of one whole text as 32-bit integers."""
    parts = [encoding.encode_ordinary(p) for p in pieces(text)]
    ids = parts[0] if len(parts) == 1 else [i for p in parts for i in p]
    return np.array(ids, dtype="<u4")


def decode_ids(encoding, ids: np.ndarray) -> bytes:
    return encoding.decode_bytes(ids.tolist())


def _mapped(df: DataFrame, keep: list[str], text: str, path: str, pattern: str,
            own: list[pa.Field], rows: Callable) -> DataFrame:
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
    source = df.select(*keep, text) if text not in keep else df.select(*keep)
    kept = [f for f in to_arrow_schema(source.schema) if f.name in keep]
    schema = pa.schema(kept + own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(path, pattern)
        for batch in batches:
            texts = strings(batch, text)
            for a, b in chunks(texts, CHUNK_BYTES):
                made = rows(encoding, (t.as_py() for t in texts.slice(a, b - a)))
                yield batch_of(schema, [column(batch, f.name).slice(a, b - a).cast(f.type) for f in kept] + made)

    return source.mapInArrow(run, from_arrow_schema(schema))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """All columns and `ids`, the token ids of the whole text as an array of ints."""
    keep = [c for c in df.columns if c.lower() != "ids"]

    def rows(encoding, texts):
        return [pa.array([encode_text(encoding, t).astype(np.int32) for t in texts],
                         type=pa.list_(pa.int32()))]

    return _mapped(df, keep, text, path, pattern, [pa.field("ids", pa.list_(pa.int32()))], rows)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """All columns and `bytes`, the raw bytes of the ids; null ids give null."""
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
    source = df.drop("bytes")
    schema = to_arrow_schema(source.schema).append(pa.field("bytes", pa.binary()))

    def run(batches):
        encoding = load(path, pattern)
        for batch in batches:
            out = [None if x is None else encoding.decode_bytes(x)
                   for x in column(batch, ids).to_pylist()]
            yield batch_of(schema, [*batch.columns, out])

    return source.mapInArrow(run, from_arrow_schema(schema))


OWN = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()),
       pa.field("decoded_sha256", pa.string())]


def _digest(encoding, ids: np.ndarray) -> tuple[int, str, str]:
    return (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
            hashlib.sha256(decode_ids(encoding, ids)).hexdigest())


def digests(df: DataFrame, path: str, pattern: str, keys: list[str],
            text: str = "text") -> DataFrame:
    """Keys, n_tokens, and SHA-256 of the ids and of the bytes decoded from them.

    Ids of one text at a time are in memory.
    """
    def rows(encoding, texts):
        made = [_digest(encoding, encode_text(encoding, t)) for t in texts]
        return [[m[k] for m in made] for k in range(3)]

    return _mapped(df, keys, text, path, pattern, OWN, rows)


def encoded(df: DataFrame, path: str, pattern: str, keys: list[str], text: str = "text") -> DataFrame:
    """Keys, the ids as little-endian unsigned 32-bit integers, and their digests."""
    def rows(encoding, texts):
        ids = [encode_text(encoding, t) for t in texts]
        made = [_digest(encoding, i) for i in ids]
        return [[i.tobytes() for i in ids], *([m[k] for m in made] for k in range(3))]

    return _mapped(df, keys, text, path, pattern, [pa.field("ids", pa.binary()), *OWN], rows)
