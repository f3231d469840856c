"""Phrase collocations by mergeable Misra-Gries summaries (operator 13).

Phrases of one to five words are hashed per language; the top of the hash names a
partition.  Every task sums its phrases and sends each partition its summary.  A
partition first learns its mass, the sum of all its counts, then merges the
summaries with a capacity above the mass divided by the threshold: when there are
more counters, the next largest is taken off all of them and those at zero go.
What is taken off in all stays below the threshold, so every frequent phrase
survives.  A second pass counts the phrases that a bitmap of the survivors lets
through, by their words, so counts are exact whatever the hashes do; it sends its
counts by the same partitions, so one holds no more phrases than the capacity.

Scores come from equality joins of the frequent phrases with their parts (a part is
at least as frequent as the whole, so it is among them).

Null text: empty, no words.  Null lang: `und`, together with rows that say so.
Repeated rows count as often as they are there.  An empty table or one without
frequent phrases gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specforge.llm.bitmap import bitmap, passes
from specforge.llm.common import batch_of, chunks, column, shuffle_parts, stored, strings

LONGEST = 5
THRESHOLD = 100
TOP = 2_000
ROOM = 4                  # counters per threshold of mass
LOW = 28                  # bits that tell phrases of a partition apart in the first pass
CHUNK_BYTES = 4 << 20     # text handled at once
ENTRIES = 2 << 20         # counters a task holds before it sends them
PENDING = 1 << 20         # counters a partition takes in before it merges
ENDS = r"[.,;:!?\n-\r]+"
NO_LANG = "und"

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MILL = np.uint64(0xBF58476D1CE4E5B9)


# --- words and phrases of a batch -----------------------------------------------------

class Words:
    """The words of some texts as codes, and where pieces and texts end."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        # A mark that ends a piece cannot be in a word, so it stands for an end.
        marked = pc.replace_substring_regex(pc.ascii_lower(texts), ENDS, " . ")
        split = pc.ascii_split_whitespace(marked)
        coded = pc.dictionary_encode(split.flatten())
        self.dictionary, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        words = self.dictionary.to_numpy(zero_copy_only=False)
        end = np.array([w in ("", ".") for w in words], dtype=bool) if len(words) else np.zeros(0, bool)
        self.is_word = ~end[self.codes]
        sizes = np.diff(split.offsets.to_numpy(zero_copy_only=False))
        doc = np.repeat(np.arange(len(texts)), sizes)
        self.piece = np.cumsum(~self.is_word) + doc
        coded = pc.dictionary_encode(langs)
        self.langs, self.lang = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)[doc]
        self.word_hash = _hashes(words)
        self.lang_hash = _hashes(self.langs.to_numpy(zero_copy_only=False))

    def phrases(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, place of the first word, hash) of all phrases, by their length."""
        h = self.word_hash[self.codes]
        g = _mix(self.lang_hash[self.lang] + h) if len(h) else h
        at = np.flatnonzero(self.is_word)
        for n in range(1, LONGEST + 1):
            if n > 1:
                at = at[at + n - 1 < len(h)]
                at = at[self.piece[at] == self.piece[at + n - 1]]
                g[at] = _mix(g[at] * _GOLD + h[at + n - 1])
            yield n, at, g[at]


def _hashes(values: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(values.astype(object), categorize=False) if len(values) else np.zeros(0, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MILL
    return x ^ (x >> np.uint64(32))


def _keys(h: np.ndarray, parts: int) -> np.ndarray:
    """Hashes as partition (upper half) and a number in it (lower half)."""
    part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return (part << np.uint64(32)) | (h & np.uint64((1 << LOW) - 1))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        texts = strings(batch, "text")
        for a, b in chunks(texts, CHUNK_BYTES):
            yield Words(texts.slice(a, b - a), column(batch, "lang").slice(a, b - a))


# --- summaries ------------------------------------------------------------------------

def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key, keys ascending."""
    keys = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def pruned(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """At most `capacity` counters, and what was taken off each."""
    if len(keys) <= capacity:
        return keys, counts, 0
    off = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    keep = counts > off
    return keys[keep], counts[keep] - off, off


def _planes(values: np.ndarray) -> bytes:
    """Compressed little-endian bytes, the lowest of all values first: the upper ones are mostly zero."""
    return pa.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), "zstd", asbytes=True)


def _from_planes(data: bytes, n: int, width: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, n * width, "zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(f"<u{width}").ravel()


SUMMARY = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("mass", pa.int64()), ("n", pa.int32()),
                     ("width", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
SUMMARY_DDL = "part int, kind int, mass bigint, n int, width int, keys binary, counts binary"


def summaries(docs: DataFrame, parts: int) -> DataFrame:
    """Per task and partition: a row with the mass (kind 0) and one with the counters (kind 1)."""
    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        bounds = np.searchsorted((keys >> np.uint64(32)).astype(np.int64), np.arange(parts + 1))
        made: list[tuple] = []
        for p in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[p], bounds[p + 1]
            width = next(w for w in (1, 2, 4, 8) if counts[a:b].max() < 1 << 8 * w)
            steps = np.diff(keys[a:b].astype(np.uint32), prepend=np.uint32(0))
            made += [(p, 0, int(counts[a:b].sum()), 0, 0, None, None),
                     (p, 1, 0, b - a, width, _planes(steps), _planes(counts[a:b].astype(f"<u{width}")))]
        return batch_of(SUMMARY, list(map(list, zip(*made, strict=True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for w in _each(batches):
            keys = _keys(np.concatenate([h for _, _, h in w.phrases()]), parts)
            if len(keys):
                held.append(np.unique(keys, return_counts=True))
            if sum(len(k) for k, _ in held) > ENTRIES:
                yield rows(*merged(held))
                held = []
        if held:
            yield rows(*merged(held))

    return docs.mapInArrow(run, SUMMARY_DDL)


def survivors(sums: DataFrame, parts: int, threshold: int, room: int = ROOM) -> DataFrame:
    """Keys of at least all phrases that occur `threshold` times."""
    schema = pa.schema([("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mass, capacity, off = None, 0, 0, 0
        held: list = []
        pending = 0

        def merge():
            nonlocal held, pending, off
            keys, counts, less = pruned(*merged(held), capacity)
            held, pending, off = [(keys, counts)], 0, off + less

        def close():
            if held:
                merge()
                keys, counts = held[0]
                yield batch_of(schema, [(keys[counts + off >= threshold] | np.uint64(now << 32)).view(np.int64)])

        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != now:
                    yield from close()
                    now, mass, off, held, pending = r["part"], 0, 0, [], 0
                if r["kind"] == 0:
                    mass += r["mass"]
                    capacity = room * mass // threshold + 1
                    continue
                keys = np.cumsum(_from_planes(r["keys"], r["n"], 4), dtype=np.uint64)
                held.append((keys, _from_planes(r["counts"], r["n"], r["width"]).astype(np.int64)))
                pending += r["n"]
                if pending > max(PENDING, capacity):
                    merge()
        yield from close()

    return (sums.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind")
            .mapInArrow(run, "key bigint"))


# --- exact counts ---------------------------------------------------------------------

COUNT = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("f", pa.int64())])
DEALT = pa.schema([("part", pa.int32()), *(pa.field(c.name, pa.list_(c.type)) for c in COUNT)])
DEALT_DDL = "part int, lang array<string>, phrase array<string>, size array<int>, f array<bigint>"
PARTED = pa.schema([("part", pa.int32()), *COUNT])


def _counted(w: Words, n: int, at: np.ndarray, h: np.ndarray, parts: int) -> pa.Table:
    """Phrases at the given places with their counts; equal hashes are held against the words."""
    _, first, group, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    place = at[first]
    other = w.lang[at] != w.lang[place[group]]
    for k in range(n):
        other |= w.codes[at + k] != w.codes[place[group] + k]
    odd = np.flatnonzero(other)     # another phrase with the hash of the first one: a row of its own
    counts = np.concatenate([counts - np.bincount(group[odd], minlength=len(counts)), np.ones(len(odd), np.int64)])
    place = np.concatenate([place, at[odd]])
    part = (_keys(np.concatenate([h[first], h[odd]]), parts) >> np.uint64(32)).astype(np.int32)
    words = [w.dictionary.take(pa.array(w.codes[place + k])) for k in range(n)]
    phrase = words[0] if n == 1 else pc.binary_join_element_wise(*words, " ")
    return pa.Table.from_batches([batch_of(PARTED, [part, w.langs.take(pa.array(w.lang[place])), phrase,
                                                    np.full(len(place), n, np.int32), counts])])


def _summed(tables: list[pa.Table], keys: list[str]) -> pa.Table:
    sums = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("f", "sum")])
    return sums.rename_columns([*keys, "f"])


def phrase_counts(docs: DataFrame, parts: int, words: np.ndarray, threshold: int) -> DataFrame:
    """lang, phrase, size (words), f of all phrases with f of at least `threshold`, and
    a row of size 0 with the number of words of each lang.

    A task sends each partition its phrases and counts as one row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def dealt(table: pa.Table) -> pa.RecordBatch:
        table = table.sort_by("part").combine_chunks()
        part = table.column("part").to_numpy()
        some, first = np.unique(part, return_index=True)
        offsets = pa.array(np.append(first, len(part)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, table.column(c.name).combine_chunks()) for c in COUNT]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *lists], schema=DEALT)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        keys = ["part", "lang", "phrase", "size"]
        held: list[pa.Table] = []
        pending = size = 0      # rows since the last sum, rows that it left
        for w in _each(batches):
            total = np.bincount(w.lang[w.is_word], minlength=len(w.langs))
            none = np.zeros(len(total), np.int32)
            held.append(pa.Table.from_batches([batch_of(PARTED, [none, w.langs, [""] * len(total), none, total])]))
            for n, at, h in w.phrases():
                kept = passes(known, _keys(h, parts))
                if kept.any():
                    held.append(_counted(w, n, at[kept], h[kept], parts))
                    pending += held[-1].num_rows
            if pending > max(PENDING // 2, size):
                held, pending = [_summed(held, keys)], 0
                size = held[0].num_rows
                if size > PENDING:
                    yield dealt(held[0])
                    held, size = [], 0
        if held:
            yield dealt(_summed(held, keys))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["lang", "phrase", "size"]
        held: list[pa.Table] = []
        pending = size = 0
        for batch in batches:
            held.append(pa.table({c.name: column(batch, c.name).flatten() for c in COUNT}))
            pending += held[-1].num_rows
            if pending > max(PENDING, size):
                held, pending = [_summed(held, keys)], 0
                size = held[0].num_rows
        if held:
            sums = _summed(held, keys)
            kept = pc.or_(pc.greater_equal(sums.column("f"), threshold), pc.equal(sums.column("size"), 0))
            yield from sums.filter(kept).cast(COUNT).to_batches()

    return (docs.mapInArrow(count, DEALT_DDL).repartitionById(parts, F.col("part"))
            .mapInArrow(total, "lang string, phrase string, size int, f bigint"))


# --- scores ---------------------------------------------------------------------------

def _part(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def scored(frequent: DataFrame, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the candidates that no longer one covers.

    A longer candidate that occurs as often covers all it holds; then so does one
    with a single word more, since counts never rise with the length.
    """
    words = F.split("phrase", " ")
    wide = frequent.where("size >= 2").withColumn("words", words)
    one, size = F.lit(1), F.col("size")
    covered = (wide.where("size >= 3")
               .select("lang", "f", F.explode(F.array(_part(F.col("words"), one, size - 1),
                                                      _part(F.col("words"), one + 1, size - 1))).alias("phrase"))
               .distinct())
    kept = wide.join(covered, ["lang", "phrase", "f"], "left_anti")
    cuts = (kept.select("lang", "phrase", F.col("f").alias("a"), "words", "size", F.explode(F.sequence(one, size - 1)).alias("k"))
            .select("lang", "phrase", "a", "k", _part(F.col("words"), one, F.col("k")).alias("first"),
                    _part(F.col("words"), F.col("k") + 1, size - F.col("k")).alias("rest")))
    left = frequent.where("size >= 1").select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = left.select("lang", F.col("first").alias("rest"), F.col("l").alias("r"))
    total = frequent.where("size = 0").select("lang", F.col("f").alias("n"))
    score = F.expr("(1000BD * (CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0)))) "
                   "div (CAST(l AS DECIMAL(16,0)) * CAST(r AS DECIMAL(16,0)))")
    best = (cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(total, "lang")
            .withColumn("score", score)
            .groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
            .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = best.withColumn("rank", rank)
    if top is not None:
        out = out.where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(df: DataFrame, threshold: int = THRESHOLD, top: int | None = TOP, text: str = "text",
                 lang: str = "lang", room: int = ROOM) -> DataFrame:
    """Each language's best phrases of two to five words; `top` None gives all candidates."""
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text).alias("text"))
    parts = shuffle_parts(df.sparkSession)
    found = stored(survivors(summaries(docs, parts), parts, threshold, room))
    return scored(stored(phrase_counts(docs, parts, bitmap(found, F.col("key")), threshold)), top)
