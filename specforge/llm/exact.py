"""Exact duplicates through an extendible-hash index on shared files (operator 11).

Texts are compared without their ASCII white space.  A scan folds equal texts of a
task by their bytes and writes, per row, which text it holds; only the first row of
each text carries the bytes.  The index addresses texts by the upper bits of a
64-bit key: a directory of 2**depth slots points to buckets, a bucket over its
capacity is split by its next bit, and the directory doubles when that bit is not
in it yet.  So a bucket is a range of keys.  Owner tasks take whole buckets in key
order; texts with one key form a chain, in which each is compared byte by byte.

Texts whose key nothing else has are alone and are not moved; a bitmap of fixed size
holds back most of them.  A key that more tasks hold than a chain should have is
first folded in salted parts.  A bucket that a single key fills stays whole: it is
read as a stream, with only its distinct texts in memory.

Null text: empty.  Texts without any character but white space are equal to the
empty one.  Of equal texts the row with most code points in the original stays, then
the smallest doc_id (null last); of rows that agree in both, exactly one.  An empty
table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specforge.llm.bitmap import bitmap, passes
from specforge.llm.common import batch_of, chunks, column, shuffle_parts, stored, strings

WHITE = b" \t\n\x0b\x0c\r"
CHUNK_BYTES = 4 << 20
FOLD_BYTES = 32 << 20      # texts a task holds to fold later equal ones
CAPACITY = 32 << 20        # bytes of texts in a bucket
DEPTH = 20                 # bits of a key that the directory may use
STEP = 6                   # bits that one count of the index looks ahead
CHAIN = 512                # texts of one key from which they are folded in parts first

ROWS = pa.schema([("row", pa.int64()), ("rep", pa.int64()), ("doc_id", pa.int64()), ("chars", pa.int64()),
                  ("sha", pa.binary()), ("key", pa.int64()), ("text", pa.binary())])
ROWS_DDL = "row bigint, rep bigint, doc_id bigint, chars bigint, sha binary, key bigint, text binary"


# --- the scan -------------------------------------------------------------------------

def scan(docs: DataFrame) -> DataFrame:
    """A row per document: its number, that of the first row of its task with the same
    text (`rep`), code points, SHA-256 of the text without white space, key, and for
    first rows that text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        seen: dict[bytes, tuple[int, bytes]] = {}
        held = 0
        for batch in batches:
            texts, ids = strings(batch, "text"), column(batch, "doc_id")
            for a, b in chunks(texts, CHUNK_BYTES):
                part = texts.slice(a, b - a)
                reps, shas, firsts = [], [], []
                for k, raw in enumerate(part.cast(pa.binary()).to_pylist()):
                    text = raw.translate(None, WHITE)
                    known = seen.get(text)
                    if known is None:
                        known = number + k, hashlib.sha256(text).digest()
                        if held + len(text) > FOLD_BYTES:
                            seen, held = {}, 0
                        seen[text] = known
                        held += len(text) + 200
                    reps.append(known[0])
                    shas.append(known[1])
                    firsts.append(text if known[0] == number + k else None)
                keys = np.frombuffer(b"".join(s[:8] for s in shas), ">i8").astype(np.int64)
                yield batch_of(ROWS, [np.arange(number, number + b - a), reps, ids.slice(a, b - a),
                                      pc.utf8_length(part), shas, keys, firsts])
                number += b - a

    return docs.mapInArrow(run, ROWS_DDL)


# --- the directory --------------------------------------------------------------------

class Directory:
    """Slots by the upper bits of a key; each names the bucket that holds its keys.

    At most 2**DEPTH slots; a bucket that would need more stays as full as it is.
    """

    def __init__(self):
        self.depth = 0
        self.slots = np.zeros(1, np.int64)       # bucket of every slot
        self.local = {0: 0}                      # bits that a bucket's keys share
        self.start = {0: 0}                      # those bits

    def range_of(self, bucket: int, depth: int) -> tuple[int, int]:
        """The bucket's numbers among 2**depth ranges of keys."""
        gap = depth - self.local[bucket]
        return self.start[bucket] << gap, (self.start[bucket] + 1) << gap

    def split(self, bucket: int) -> tuple[int, int]:
        """The bucket's two halves by its next bit."""
        if self.local[bucket] == self.depth:
            self.slots = np.repeat(self.slots, 2)
            self.depth += 1
        other = len(self.local)
        self.local[bucket] = self.local[other] = self.local[bucket] + 1
        self.start[bucket] <<= 1
        self.start[other] = self.start[bucket] + 1
        a, b = self.range_of(other, self.depth)
        self.slots[a:b] = other
        return bucket, other

    def look_up(self, df: DataFrame, key: str = "key") -> DataFrame:
        """The frame with `bucket`: an equality join with the slots, whose number is bounded."""
        slots = df.sparkSession.createDataFrame(pa.table({"slot": np.arange(len(self.slots)), "bucket": self.slots}))
        slot = F.shiftrightunsigned(key, 64 - self.depth) if self.depth else F.lit(0).cast("bigint")
        return df.withColumn("slot", slot).join(F.broadcast(slots), "slot").drop("slot")


def fill(keys: DataFrame, capacity: int = CAPACITY) -> Directory:
    """The directory for a table of (key, size), one row per text.

    Every round counts the buckets that are too full, `STEP` bits ahead, and splits
    them by these counts.  Only what a bucket holds besides its heaviest key counts
    as too much: no split parts the texts of one key.
    """
    directory = Directory()
    per_key = keys.groupBy("key").agg(F.sum("size").alias("size"))
    loads = [0]       # buckets to look at
    while loads:
        ahead = min(DEPTH, max(directory.local[b] for b in loads) + STEP)
        wanted = directory.look_up(per_key).where(F.col("bucket").isin(loads)) if directory.depth else per_key
        rows = (wanted.groupBy(F.shiftrightunsigned("key", 64 - ahead).alias("range"))
                .agg(F.sum("size").alias("load"), F.max("size").alias("most")).orderBy("range").toArrow())
        ranges, load, most = (rows.column(c).to_numpy() for c in ("range", "load", "most"))
        todo, loads = loads, []
        while todo:
            bucket = todo.pop()
            a, b = np.searchsorted(ranges, directory.range_of(bucket, ahead))
            if a == b or load[a:b].sum() - most[a:b].max() <= capacity:
                continue
            if directory.local[bucket] < ahead:
                todo += directory.split(bucket)
            elif ahead < DEPTH:
                loads.append(bucket)
    return directory


# --- chains ---------------------------------------------------------------------------

LINKS = pa.schema([("rep", pa.int64()), ("head", pa.int64())])


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, head) of texts in key order: the head is the first of a chain with the same bytes."""
    now: int | None = None
    salt = 0
    chain: list[tuple[bytes, int]] = []
    for batch in batches:
        reps, heads = [], []
        for key, part, rep, text in zip(*(column(batch, c).to_pylist() for c in ("key", "salt", "rep", "text")), strict=True):
            if key != now or part != salt:
                now, salt, chain = key, part, []
            head = next((h for known, h in chain if known == text), None)
            if head is None:
                head = rep
                chain.append((text, rep))
            reps.append(rep)
            heads.append(head)
        yield batch_of(LINKS, [reps, heads])


def owned(texts: DataFrame, owners: int) -> DataFrame:
    """Each owner task takes its buckets, in key order."""
    return (texts.repartitionById(owners, F.pmod(F.col("bucket") + F.col("salt"), F.lit(owners)).cast("int"))
            .sortWithinPartitions("bucket", "key", "salt", "rep")
            .select("key", "salt", "rep", "text").mapInArrow(chained, "rep bigint, head bigint"))


def classes(firsts: DataFrame, capacity: int = CAPACITY, chain: int = CHAIN) -> DataFrame:
    """rep, head for the texts that another one may equal; `firsts` has rep, key, text."""
    sizes = firsts.groupBy("key").agg(F.count("*").alias("texts"))
    shared = stored(sizes.where("texts > 1"))
    bits = firsts.sparkSession.sparkContext.broadcast(bitmap(shared, F.col("key")))
    schema = pa.schema([("rep", pa.int64()), ("key", pa.int64()), ("text", pa.binary())])

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = passes(bits.value, column(batch, "key").to_numpy().view(np.uint64))
            out = batch.filter(pa.array(may))
            if out.num_rows:
                yield batch_of(schema, [column(out, c) for c in schema.names])

    texts = stored(firsts.select("rep", "key", "text").mapInArrow(suspects, "rep bigint, key bigint, text binary"))
    directory = fill(texts.select("key", F.length("text").alias("size")), capacity)
    placed = directory.look_up(texts)
    owners = max(1, min(shuffle_parts(firsts.sparkSession), len(directory.local)))
    # Texts of keys with long chains meet in parts first, and go on as the heads of these.
    hot = shared.where(F.col("texts") > chain).withColumn("parts", F.ceil(F.sqrt("texts")).cast("int"))
    long = (placed.join(hot, "key")
            .withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")))
    parted = stored(owned(long, shuffle_parts(firsts.sparkSession)))
    rest = (placed.join(parted.where("rep <> head").select("rep"), "rep", "left_anti")
            .withColumn("salt", F.lit(0)))
    final = stored(owned(rest, owners))
    return (parted.where("rep <> head")
            .join(final.select(F.col("rep").alias("head"), F.col("head").alias("top")), "head").select("rep", F.col("top").alias("head"))
            .unionAll(final))


# --- the operator ---------------------------------------------------------------------

def deduplicate(df: DataFrame, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, chain: int = CHAIN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    docs = df.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = stored(scan(docs))
    head = classes(rows.where(F.col("row") == F.col("rep")).select("rep", "key", "text"), capacity, chain)
    # The row that stays is the least of these.
    order = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    reps = rows.groupBy("rep").agg(F.count("*").alias("n"), F.min(order).alias("best"))
    named = stored(reps.join(head, "rep", "left").withColumn("head", F.coalesce("head", "rep")))
    groups = named.groupBy("head").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
    verdict = named.select("rep", "head").join(groups, "head").select("rep", "group_size", "best")
    return rows.drop("text", "key", "chars").join(verdict, "rep").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))
