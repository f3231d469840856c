"""Token ids in binary shards: frequency ranks in byte-aligned variable-length coding (operator 1).

Ids are renumbered by their frequency in the corpus, so frequent ones take one
byte.  Values lie in groups of four: one control byte holds their lengths (two
bits each, 1 to 4 bytes), the value bytes follow in a stream of their own.  A
reader turns control bytes into lengths by one numpy table lookup, and lengths
into positions by a running sum.

File format (a folder written by Spark's committer, so a lost task leaves nothing):
  ranks      `token`, `count`; a token's rank is its place by count (largest first), then id
  blocks     `shard`, `block`, `first_token` (in the shard), `n_docs`, `n_tokens`, `doc_ids`
             (8 bytes each), `has_id` (1 byte each), `lengths` (4 bytes each), `control`, `data`
Documents are in ascending doc_id order over shards, blocks and rows (null ids first,
repeated ids by the checksum of their tokens); each document's values are padded to a multiple of
four with zeros.

Null text: the empty text, only the end id.  An empty table gives empty files.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from specforge.llm.common import batch_of, chunks, column, shuffle_parts, strings, work_dir

CHUNK_BYTES = 16 << 20   # text handled at once
ROWS = 32                # texts given to the tokenizer at once
SLICE_BYTES = 4 << 20    # ids counted or coded at once
JOINED = 256             # distinct words given to the tokenizer as one text
MARKS = "^~`|#"          # words are told apart by the first of these that is one id
# A word with marks behind its last letter or digit (0130 is left out: in lower case it ends with a mark).
CORE = r"^(?P<core>.*[A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}])(?P<rest>[.,!?;:]+)$"
BLOCK_BYTES = 4 << 20    # coded bytes of a block, but for a longer document

# Lengths of the four values of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


# --- the code -------------------------------------------------------------------------

def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of 32-bit values, padded to groups of four."""
    control, data = pack_all(values, np.array([len(values)]))
    return control[0], data[0]


def pack_all(values: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of documents of the given sizes, each padded to groups of four."""
    padded = -(-sizes // 4) * 4
    starts = np.cumsum(padded) - padded
    v = np.zeros(int(padded.sum()), dtype="<u4")
    v[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(values))] = values
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = (size - 1).reshape(-1, 4)
    control = (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes()
    used = np.arange(4, dtype=np.uint8) < size[:, None]
    data = v.view(np.uint8).reshape(-1, 4)[used].tobytes()
    groups = np.concatenate([starts, [len(v)]]) // 4
    ends = np.concatenate([[0], np.cumsum(four.sum(1, dtype=np.int64) + 4)])[groups].tolist()
    groups = groups.tolist()
    return ([control[x:y] for x, y in zip(groups[:-1], groups[1:], strict=True)],
            [data[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)])


def unpack(control: bytes, data: bytes) -> np.ndarray:
    """All values of a block, padding included."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()
    start = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if len(more) == 0:
            break
        out[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# --- encoding -------------------------------------------------------------------------

def by_word(path: str) -> bool:
    """Whether texts may be encoded word by word: the file's split pattern keeps
    only matches without white space, and added tokens hold none."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = spec.get("pre_tokenizer") or {}
    first = (steps.get("pretokenizers") or [steps])[0]
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(" \t\r\n.,!?;:"))
                and t["content"].startswith("<") for t in spec.get("added_tokens", []))
    return (plain and first.get("type") == "Split" and first.get("behavior") == "Removed"
            and bool(first.get("invert")) and r"[^\s" in first["pattern"].get("Regex", ""))


def _ascii(units: pa.Array) -> pa.Array:
    """ASCII strings that hold no added token."""
    return pc.and_not(pc.string_is_ascii(units), pc.match_substring(units, "<"))


def _gather(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ranges laid in a row, and where each range ends there."""
    ends = np.cumsum(sizes, dtype=np.int64)
    at = np.repeat((starts - (ends - sizes)).astype(np.int32), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return at, ends


class Encoder:
    """Ids of many texts at once; distinct words go through the tokenizer once a chunk.

    White space separates matches of the split pattern and is dropped, so a text's
    ids are those of its words in a row (see `by_word`); other files encode whole texts.
    """

    def __init__(self, path: str):
        # Threads of the library would each keep their own memory; Spark runs the tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.words = by_word(path)
        if self.words:
            # For lower-case ASCII words the normalizer changes nothing.
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = None
            self.mark, self.mark_id = next(
                (c, ids[1]) for c in MARKS
                if len(ids := self.tokenizer.encode(f"a {c} a", add_special_tokens=False).ids) == 3)

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given one by one, and how many each has."""
        done = [e.ids for at in range(0, len(units), ROWS)
                for e in self.tokenizer.encode_batch_fast(units[at:at + ROWS], add_special_tokens=False)]
        return (np.array([i for ids in done for i in ids], dtype=np.uint32),
                np.array([len(ids) for ids in done], dtype=np.int64))

    def _joined(self, tokenizer, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words without the mark: many at once, a mark after each."""
        rows = [f" {self.mark} ".join([*units[at:at + JOINED], ""]) for at in range(0, len(units), JOINED)]
        done = [np.array(e.ids, dtype=np.uint32) for at in range(0, len(rows), ROWS)
                for e in tokenizer.encode_batch_fast(rows[at:at + ROWS], add_special_tokens=False)]
        ids = np.concatenate(done) if done else np.zeros(0, np.uint32)
        ends = np.flatnonzero(ids == self.mark_id)
        sizes = np.diff(ends, prepend=-1) - 1
        if len(sizes) != len(units):
            raise ValueError("the mark is not an id of its own")
        return np.delete(ids, ends), sizes

    def _distinct(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct strings without white space; where each one's ids start, how many."""
        marked = pc.match_substring(units, self.mark)
        plain = pc.and_(_ascii(units), pc.equal(pc.ascii_lower(units), units))
        parts = [(marked, self._encode),
                 (pc.and_not(plain, marked), lambda u: self._joined(self.plain, u)),
                 (pc.invert(pc.or_(plain, marked)), lambda u: self._joined(self.tokenizer, u))]
        sizes = np.zeros(len(units), dtype=np.int64)
        starts = np.zeros(len(units), dtype=np.int64)
        every, total = [], 0
        for mask, encode in parts:
            ids, n = encode(units.filter(mask).to_pylist())
            rows = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
            sizes[rows], starts[rows] = n, total + np.cumsum(n) - n
            every.append(ids)
            total += len(ids)
        return np.concatenate(every), starts, sizes

    def _vocabulary(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for words, by their cores (lower case where ASCII) and the marks behind them.

        A match of the split pattern ends where a letter or digit meets such a mark,
        so both parts encode independently and far fewer strings are distinct.
        """
        cut = pc.extract_regex(units, CORE)
        core = pc.if_else(cut.is_valid(), cut.field("core"), units)
        core = pc.if_else(_ascii(core), pc.ascii_lower(core), core)
        rest = pc.if_else(cut.is_valid(), cut.field("rest"), "")
        coded = pc.dictionary_encode(pa.concat_arrays([core, rest]))
        ids, starts, sizes = self._distinct(coded.dictionary)
        which = coded.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T.ravel()
        at, ends = _gather(starts[which], sizes[which])
        ends = ends[1::2]
        return ids[at], np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text starts (one more than texts)."""
        if not self.words:
            ids, sizes = self._encode(texts.to_pylist())
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        split = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(split.flatten())
        ids, starts, sizes = self._vocabulary(coded.dictionary)
        which = coded.indices.to_numpy(zero_copy_only=False)
        at, ends = _gather(starts[which], sizes[which])
        first = split.offsets.to_numpy(zero_copy_only=False)
        return ids[at], np.concatenate([[0], ends])[first - first[0]]


def encode_table(df: DataFrame, path: str, end_id: int, doc: str, text: str) -> DataFrame:
    """doc_id and the ids of the whole text with the end id, as little-endian bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            docs, texts = column(batch, "doc_id"), strings(batch, "text")
            for a, b in chunks(texts, CHUNK_BYTES):
                ids, bounds = encoder(texts.slice(a, b - a))
                rows = [np.append(ids[s:e], np.uint32(end_id)).astype("<u4").tobytes()
                        for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                yield batch_of(schema, [docs.slice(a, b - a), rows])

    return df.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")) \
        .mapInArrow(run, "doc_id bigint, ids binary")


# --- writing --------------------------------------------------------------------------

def _slices(rows: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of some rows at once, and how many each row has; a longer row stands alone."""
    for a, b in chunks(rows, SLICE_BYTES):
        part = rows.slice(a, b - a)
        sizes = pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        yield np.frombuffer(b"".join(part.to_pylist()), "<u4"), sizes


def id_counts(coded: DataFrame) -> DataFrame:
    """How often each id occurs: one row per id and task, then the sum."""
    schema = pa.schema([("token", pa.int64()), ("count", pa.int64())])

    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for ids, _ in _slices(column(batch, "ids")):
                seen = np.bincount(ids)
                if len(seen) > len(total):
                    total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
                total[:len(seen)] += seen
        tokens = np.flatnonzero(total)
        yield batch_of(schema, [pa.array(tokens), pa.array(total[tokens])])

    return (coded.select("ids").mapInArrow(run, "token bigint, count bigint")
            .groupBy("token").agg(F.sum("count").alias("count")))


def ranked(counts: DataFrame) -> np.ndarray:
    """Ids by rank.  At most one row per vocabulary entry comes to the driver."""
    return np.array([r.token for r in counts.orderBy(F.desc("count"), "token").select("token").collect()],
                    dtype=np.uint32)


PACKED = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("n", pa.int32()),
                    ("control", pa.binary()), ("data", pa.binary())])


def bounds(coded: DataFrame, shards: int) -> list[int]:
    """Where shards end, by approximate quantiles of doc_id (null as the smallest).

    A doc_id that holds more than a shard's share of rows is there several times.
    """
    at = F.percentile_approx(_order("doc_id"), [k / shards for k in range(1, shards)], 100 * shards)
    return coded.select(at).first()[0] or [] if shards > 1 else []


def _order(doc: str) -> Column:
    return F.coalesce(F.col(doc), F.lit(-1 << 63))


def _pack_rows(tokens: np.ndarray, ends: list[int]) -> Callable:
    """Coded documents with their shard; rows of a frequent doc_id are dealt to its
    shards in the order of their ids' checksums."""
    def run(batches):
        rank = np.zeros(int(tokens.max()) + 1 if len(tokens) else 1, dtype=np.uint32)
        rank[tokens] = np.arange(len(tokens), dtype=np.uint32)
        for batch in batches:
            docs, rows = column(batch, "doc_id"), column(batch, "ids")
            made = [x for ids, sizes in _slices(rows) for x in zip(sizes.tolist(), *pack_all(rank[ids], sizes), strict=True)]
            tie = np.array([zlib.crc32(x.as_buffer()) for x in rows], dtype=np.int64)
            key = pc.fill_null(docs, -1 << 63).to_numpy(zero_copy_only=False)
            first, last = np.searchsorted(ends, key, "left"), np.searchsorted(ends, key, "right")
            shard = first + (tie * (last - first + 1) >> 32)
            yield batch_of(PACKED, [shard.astype(np.int32), docs, tie, *([m[k] for m in made] for k in range(3))])
    return run


BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()),
                   ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()),
                   ("has_id", pa.binary()), ("lengths", pa.binary()), ("control", pa.binary()),
                   ("data", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted documents as blocks of one shard; one block is in memory."""
    shard, number, first = -1, 0, 0
    rows: list[tuple] = []
    size = 0

    def close():
        nonlocal number, first, rows, size
        lengths = np.array([r[1] for r in rows], dtype="<i4")
        tokens = int(lengths.sum())
        row = [shard, number, first, len(rows), tokens,
               np.array([r[0] or 0 for r in rows], dtype="<i8").tobytes(),
               np.array([r[0] is not None for r in rows], dtype=np.uint8).tobytes(),
               lengths.tobytes(), b"".join(r[2] for r in rows), b"".join(r[3] for r in rows)]
        number, first, rows, size = number + 1, first + tokens, [], 0
        return batch_of(BLOCK, [[v] for v in row])

    for batch in batches:
        for of, doc, _, n, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and (of != shard or size + len(control) + len(data) > BLOCK_BYTES):
                yield close()
            if of != shard:
                shard, number, first = of, 0, 0
            rows.append((doc, n, control, data))
            size += len(control) + len(data)
    if rows:
        yield close()


def write(df: DataFrame, path: str, folder: str, end_id: int, doc: str = "doc_id",
          text: str = "text") -> None:
    """Encode every text with the tokenizer file at `path` and write the shards to `folder`.

    The ids are kept once beside the shards (they are counted and then coded), so
    the tokenizer runs once per text; only coded bytes are shuffled, by shards of doc_id.
    """
    spark = df.sparkSession
    raw = f"{folder}/ids"
    encode_table(df, path, end_id, doc, text).write.option("compression", "zstd").parquet(raw)
    coded = spark.read.schema("doc_id bigint, ids binary").parquet(raw)
    counts = f"{folder}/ranks"
    id_counts(coded).repartition(1).write.parquet(counts)      # summed in parallel; one row per vocabulary entry
    tokens = ranked(spark.read.parquet(counts))
    shards = shuffle_parts(spark)
    (coded.mapInArrow(_pack_rows(tokens, bounds(coded, shards)), from_arrow_schema(PACKED))
     .repartitionById(shards, F.col("shard"))
     .sortWithinPartitions("shard", _order("doc_id"), "tie", "n", "control", "data")
     .mapInArrow(_blocks, from_arrow_schema(BLOCK))
     .write.option("compression", "none").parquet(f"{folder}/blocks"))


# --- reading --------------------------------------------------------------------------

def read(spark: SparkSession, folder: str, schema: pa.Schema, rows: Callable) -> DataFrame:
    """Decode each block; `rows(start, doc_id, ids)` makes a result row per document."""
    tokens = ranked(spark.read.parquet(f"{folder}/ranks"))
    blocks = spark.read.schema(from_arrow_schema(BLOCK)).parquet(f"{folder}/blocks")
    # One number per shard: as many as the writer had partitions.
    sizes = {r.shard: r.n for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    before, total = {}, 0
    for shard in sorted(sizes):
        before[shard] = total
        total += sizes[shard]

    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                values = unpack(b["control"], b["data"])
                lengths = np.frombuffer(b["lengths"], "<i4").astype(np.int64)
                places = np.cumsum((lengths + 3) // 4 * 4) - (lengths + 3) // 4 * 4
                starts = before[b["shard"]] + b["first_token"] + np.cumsum(lengths) - lengths
                docs = np.frombuffer(b["doc_ids"], "<i8")
                known = np.frombuffer(b["has_id"], np.uint8)
                made = [rows(int(s), int(d) if k else None, tokens[values[p:p + n]])
                        for s, d, k, p, n in zip(starts, docs, known, places, lengths, strict=True)]
                yield batch_of(schema, list(map(list, zip(*made, strict=True))))

    return blocks.mapInArrow(run, from_arrow_schema(schema))


def checks(start: int, doc_id: int | None, ids: np.ndarray) -> tuple:
    """A digest row of `read`."""
    return doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())


CHECKS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                    ("ids_crc32", pa.int64())])


def round_trip(df: DataFrame, path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write the shards and read the digests of every document back from them."""
    folder = folder or work_dir(df.sparkSession)
    write(df, path, folder, end_id)
    return read(df.sparkSession, folder, CHECKS, checks)
