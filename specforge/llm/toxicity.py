"""Toxicity by subword-bag embeddings averaged into a linear softmax (operator 9).

A word is the bag of its whole form and its character n-grams, each a hashed row
of an embedding table; a document is the mean of its words' means (a word that
occurs n times counts as the root of n, so repetition does not drown the rest), and
two linear outputs with a softmax give the score.  Table and outputs are trained jointly in
numpy; a misspelling the model has not seen shares most n-grams with the word.

The model is linear after training, so each n-gram has one number, and scoring is
a lookup per distinct word of a batch.  The fit uses at most `toxic_docs` and
`clean_docs` labelled documents (smallest id hashes first), and of them as many as
`entries` n-grams have room for; scoring covers every row.

Null and empty texts are scored by the outputs' offsets alone.  Labels that are
null, or whose document is missing, teach nothing; several labels of a document
count as toxic if one does.  Without labels of both kinds every score is the
share of toxic ones (0 without any).  Repeated rows get equal scores; of rows with
one id and different texts the fit reads one (smallest text hash).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from specforge.llm.common import batch_of, chunks, column, fresh, stored, strings

BITS = 18
BUCKETS = 1 << BITS
GRAMS = (3, 4, 5)
PAD = 40              # empty words each mean has besides its own, so a few words in a short text weigh less
ENTRIES = 128 << 20   # n-grams of the sample: 1 GB; a document of 3,000 characters has at most 12,000
CHUNK_BYTES = 2 << 20
PRIME = np.uint32(16777619)
OPEN, CLOSE = ord("<"), ord(">")


# --- features -------------------------------------------------------------------------

def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' bags, and the word each belongs to.

    All n-grams of all words are hashed at once, as runs in one array of code
    points; runs over a word's end are left out.  Every word has its whole form.
    """
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    text = "".join(words.to_pylist()).encode("utf-32-le", "surrogatepass")
    size = lengths + 2
    ends = np.cumsum(size)
    starts = ends - size
    points = np.empty(int(size.sum()), dtype=np.uint32)
    inner = np.ones(len(points), dtype=bool)
    inner[starts], inner[ends - 1] = False, False
    points[starts], points[ends - 1] = OPEN, CLOSE
    points[inner] = np.frombuffer(text, "<u4")
    word = np.repeat(np.arange(len(size), dtype=np.int32), size)
    left = (ends[word] - np.arange(len(points))).astype(np.int32)   # characters to the word's end
    found, owner = [], []
    for n in GRAMS:
        h = np.full(max(0, len(points) - n + 1), 2166136261 + n, dtype=np.uint32)
        for k in range(n):
            h = (h ^ points[k:len(h) + k]) * PRIME
        # A bag of the whole word stands below; runs of just its length would repeat it.
        fits = np.flatnonzero((left[:len(h)] >= n) & (size[word[:len(h)]] > n))
        found.append(_bucket(h[fits]))
        owner.append(word[fits])
    whole = (points * (np.arange(len(points), dtype=np.uint32) - starts[word].astype(np.uint32) + np.uint32(1)) * PRIME)
    whole = np.add.reduceat(whole ^ (whole >> np.uint32(15)), starts, dtype=np.uint32) if len(starts) else whole[:0]
    found.append(_bucket(whole * PRIME))
    owner.append(np.arange(len(size), dtype=np.int32))
    return np.concatenate(found), np.concatenate(owner)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(16))
    return ((h * np.uint32(2654435769)) >> np.uint32(32 - BITS)).astype(np.int32)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words, the words of all texts as indexes, and the texts' bounds."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    coded = pc.dictionary_encode(lists.flatten())
    first = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), first - first[0]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A document's buckets and their shares (which sum to one, or none)."""
    words, which, _ = split(pa.array([text]))
    full = np.array([w != "" for w in words.to_pylist()], dtype=bool)
    count = np.sqrt(np.bincount(which, minlength=len(words))) * full
    if not count.sum():
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    buckets, owner = grams(words)
    sizes = np.bincount(owner, minlength=len(words))
    share = np.bincount(buckets, (count / np.maximum(sizes, 1))[owner], minlength=BUCKETS) / (count.sum() + PAD)
    used = np.flatnonzero(share)
    return used.astype(np.int32), share[used].astype(np.float32)


# --- the fit --------------------------------------------------------------------------

@dataclass
class Model:
    weight: np.ndarray   # of each bucket in the difference of the two outputs
    offset: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        words, which, bounds = split(texts)
        buckets, owner = grams(words)
        sums = np.bincount(owner, self.weight[buckets], minlength=len(words))
        value = sums / np.maximum(np.bincount(owner, minlength=len(words)), 1)
        full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        pairs = np.repeat(np.arange(len(texts)), np.diff(bounds)) * len(words) + which
        pairs, count = np.unique(pairs, return_counts=True)
        row, word = np.divmod(pairs, max(1, len(words)))
        share = np.sqrt(count) * full[word]
        n = np.bincount(row, share, minlength=len(texts))
        total = np.bincount(row, value[word] * share, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(self.offset + total / (n + PAD), -60, 60)))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = 8, gain: float = 100.0,
        epochs: int = 8, rate: float = 0.05, batch: int = 64, steps: int = 500,
        seed: int = 0) -> Model:
    """Train table and outputs jointly: Adagrad on the softmax loss, rows touched only, for so
    many passes or steps at least.

    `gain` multiplies the mean, so that a few words in hundreds can decide.
    """
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS), 60.0 if share else -60.0)
    # Toxic documents weigh a quarter of the sample at least.
    balance = np.array([1.0, max(1.0, (1 - share) / (3 * share))])
    epochs = max(epochs, -(-steps * batch // len(bags)))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    out = rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
    offset = np.zeros(2, np.float32)
    seen_table = np.full(BUCKETS, 1e-6, np.float32)
    seen_out, seen_offset = np.full_like(out, 1e-6), np.full(2, 1e-6, np.float32)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // batch)):
            sizes = np.array([len(bags[i][0]) for i in at])
            used = np.concatenate([bags[i][0] for i in at])
            share = np.concatenate([bags[i][1] for i in at])
            row = np.repeat(np.arange(len(at)), sizes)
            mean = np.stack([np.bincount(row, table[used, d] * share, minlength=len(at)) for d in range(dim)], 1) * gain
            z = mean @ out + offset
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), labels[at]] -= 1
            p *= balance[labels[at]][:, None] / len(at)
            g_mean = gain * (p @ out.T)
            g_out, g_offset = mean.T @ p, p.sum(0)
            rows, back = np.unique(used, return_inverse=True)
            step = np.stack([np.bincount(back, share * g_mean[row, d], minlength=len(rows)) for d in range(dim)], 1)
            seen_table[rows] += (step ** 2).mean(1)
            table[rows] -= (rate * step / np.sqrt(seen_table[rows])[:, None]).astype(np.float32)
            seen_out += g_out ** 2
            out -= (rate * g_out / np.sqrt(seen_out)).astype(np.float32)
            seen_offset += g_offset ** 2
            offset -= (rate * g_offset / np.sqrt(seen_offset)).astype(np.float32)
    return Model(gain * (table @ (out[:, 1] - out[:, 0])).astype(np.float64), float(offset[1] - offset[0]))


# --- on Spark -------------------------------------------------------------------------

def fold(doc: Column, folds: int = 5) -> Column:
    """A document's fold; 0 is held out.  A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, sizes: tuple[int, int], entries: int, doc: str, text: str,
                  label: str) -> DataFrame:
    """id, toxic, buckets, shares of the sample: the smallest id hashes of either label,
    one text per id, while their n-grams number at most `entries`.

    Only ids are ordered (a top-k); at most the sum of `sizes` rows are broadcast.
    """
    known = (labels.select(F.col(doc).alias("id"), F.col(label).cast("int").alias("toxic"))
             .where("id is not null and toxic is not null").where(fold(F.col("id")) != 0)
             .groupBy("id").agg(F.max("toxic").alias("toxic")))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = known.where("toxic > 0").orderBy(*order).limit(sizes[0]).unionAll(
        known.where("toxic <= 0").orderBy(*order).limit(sizes[1]))
    found = docs.select(F.col(doc).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    once = stored(found.groupBy("id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")))
    # A character opens an n-gram of each length and one word; a bag has no more than all buckets.
    most = F.least(F.lit(BUCKETS), (len(GRAMS) + 1) * F.coalesce(F.length("text"), F.lit(0)))
    upto = F.sum(most).over(Window.partitionBy(F.col("toxic") > 0).orderBy(*order))
    share = F.when(F.col("toxic") > 0, sizes[0]).otherwise(sizes[1]) / sum(sizes)
    room = (once.select("id", "toxic", upto.alias("upto")).where(F.col("upto") <= entries * share).select("id"))
    rows = once.join(F.broadcast(room), "id", "left_semi")
    schema = pa.schema([("id", pa.int64()), ("toxic", pa.int32()), ("buckets", pa.list_(pa.int32())),
                        ("shares", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in enumerate(strings(batch, "text")):
                used, share = bag(t.as_py())
                yield batch_of(schema, [[column(batch, "id")[k].as_py()], [column(batch, "toxic")[k].as_py()],
                                        [used], [share]])

    return rows.select(F.col("id").cast("bigint").alias("id"), "toxic", "text") \
        .mapInArrow(run, from_arrow_schema(schema))


def train(docs: DataFrame, labels: DataFrame, toxic_docs: int = 1500, clean_docs: int = 4000, doc: str = "doc_id",
          text: str = "text", label: str = "toxic", entries: int = ENTRIES) -> Model:
    """Fit on a bounded sample of the labelled documents outside fold 0.

    What reaches the driver is at most `entries` n-grams of 8 bytes.
    """
    sample = training_rows(docs, labels, (toxic_docs, clean_docs), entries, doc, text, label).toArrow()
    order = pc.sort_indices(sample.select(["id", "toxic"]), sort_keys=[("id", "ascending"), ("toxic", "ascending")]).to_pylist()
    toxic = sample.column("toxic").to_numpy()[order].astype(np.int64).clip(0, 1)
    # Views of the sample in that order: it is in memory once.
    bags = [(b.values.to_numpy(), s.values.to_numpy()) for b, s in zip(sample.column("buckets"), sample.column("shares"), strict=True)]
    return fit([bags[i] for i in order], toxic)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text",
          name: str = "score") -> DataFrame:
    """The kept columns and the score of the whole text."""
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != name.lower()]
    read = fresh(docs, "scored_text")
    source = docs.select(*kept, F.col(text).alias(read))
    schema = to_arrow_schema(source.schema).remove(len(kept)).append(pa.field(name, pa.float64()))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 512 kB, whatever the data

    def run(batches):
        for batch in batches:
            texts = strings(batch, read)
            for a, b in chunks(texts, CHUNK_BYTES):
                kept_columns = [c.slice(a, b - a) for c in batch.columns[:-1]]
                yield batch_of(schema, [*kept_columns, shared.value.scores(texts.slice(a, b - a))])

    return source.mapInArrow(run, from_arrow_schema(schema))
