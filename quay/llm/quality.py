"""Quality classifier: supervised subword embeddings.

A document is the mean of the vectors of its words and of their character n-grams (words are runs between white space, in their own
case, with a mark at either end). Vectors live in hashed buckets and are learned together with a softmax output by stochastic
gradient descent in numpy, on a bounded sample of labelled rows. As the output is linear in the mean, a bucket's vector and
the output weights fold into one number, so scoring sums a number per word.

Defined cases: null or empty text has no features and scores what the output's bias gives; labels that are null are not
learned from; without any label to learn from every score is 0.5; repeated rows are scored each; an empty table gives no rows; other columns
are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quay.llm import columns

#: Labelled rows to learn from: those with the least hash of doc_id, at most so many; of these, texts of more bytes are left out.
MAX_TRAIN = 1500
MAX_BYTES = 1 << 20
BUCKET_BITS = 18
SIZES = (3, 4)
SCHEMA = "doc_id long, score double"


def bucket(x: np.ndarray, seed: int) -> np.ndarray:
    """The hash bucket of each 64-bit code."""
    return (columns.mixed(x + np.uint64(seed)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def word_features(vocab: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of all words, and whose they are (places in ``vocab``, ascending)."""
    marked = [f"\x02{w}\x03" for w in vocab]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(vocab)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(chars))  # characters from here to the word's end
    factor = np.uint64(1_000_003)
    powers = np.cumprod(np.concatenate(([1], np.full(64, factor, np.uint64))).astype(np.uint64))
    whole = columns.sums(chars * powers[np.minimum(left, 64)] + columns.mixed(left.astype(np.uint64)) * chars, np.concatenate(([0], np.cumsum(size))))
    found, owners = [bucket(whole, 1)], [np.arange(len(vocab))]
    for n in SIZES:
        at = np.flatnonzero(left >= n)
        code = np.zeros(len(at), np.uint64)
        for k in range(n):
            code = code * factor + chars[at + k]
        found.append(bucket(code, n + 1))
        owners.append(owner[at])
    who = np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return np.concatenate(found)[order], who[order]


@dataclass
class Model:
    """What each bucket adds to the odds (log), and the bias."""

    weight: np.ndarray
    bias: float


def fit(texts: list[str], labels: list[int], *, dims: int = 8, epochs: int = 6, rate: float = 1.0, seed: int = 7) -> Model:
    """Learn vectors and output by stochastic gradient descent, one document at a time."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dims, 1 / dims, (1 << BUCKET_BITS, dims)).astype(np.float32)
    out, bias = np.zeros((dims, 2), np.float32), np.zeros(2, np.float32)
    # one array for all documents' features, filled chunk by chunk: many small arrays would keep much more memory
    parts, held, sizes = [], [], []
    for text in texts:
        split = columns.split(pa.array([text]), columns.whitespace_classes(), lower=False)
        words, counts = split.vocab.to_pylist(), np.bincount(split.index, minlength=len(split.vocab))
        if len(words):
            feature, owner = word_features(words)
            ids, which = np.unique(feature, return_inverse=True)
            share = np.bincount(which, counts[owner].astype(np.float64)).astype(np.float32)
            held.append((ids.astype(np.int32), share / share.sum()))
        sizes.append(len(held[-1][0]) if len(words) else 0)
        if len(held) == 64:
            parts.append(tuple(map(np.concatenate, zip(*held, strict=True))))
            held = []
    parts += [tuple(map(np.concatenate, zip(*held, strict=True)))] if held else []
    all_ids, all_shares = (np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, kind) for k, kind in ((0, np.int32), (1, np.float32)))
    del parts, held
    edges = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    steps, step = max(1, epochs * len(texts)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            span, label = slice(edges[i], edges[i + 1]), labels[i]
            ids, share = all_ids[span], all_shares[span]
            now = rate * (1 - step / steps)
            step += 1
            part = vectors[ids]
            mean = share @ part if len(ids) else np.zeros(dims, np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = out @ p
            out -= now * np.outer(mean, p)
            bias -= now * 0.1 * p
            if len(ids):
                vectors[ids] = part - now * np.outer(share, back) * len(ids) ** 0.5
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN) -> Model:
    """Fit on the texts of at most ``max_train`` rows of ``labels`` (doc_id, quality): those with the least hash of doc_id.

    The labels are chosen first, so the side that is broadcast has at most ``max_train`` rows. A doc_id counts once: of several labels the least, of
    several texts the least. Texts of more than ``MAX_BYTES`` are not learned from, which bounds what the driver gets.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("label"))
    chosen = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= MAX_BYTES)
    rows = sorted(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).collect())
    if not rows:
        return Model(np.zeros(1 << BUCKET_BITS), 0.0)
    return fit([r.text for r in rows], [r.label for r in rows])


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    words = columns.split(texts, columns.whitespace_classes(), lower=False)
    feature, owner = word_features(words.vocab.to_pylist())
    n = len(words.vocab)
    value = np.bincount(owner, model.weight[feature], n)
    size = np.bincount(owner, minlength=n)
    total, features = columns.sums(value[words.index], words.bounds), columns.sums(size[words.index], words.bounds)
    z = total / np.maximum(features, 1) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the probability of label 1, for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB at any size of the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in columns.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(scores(shared.value, rows.column("text")))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, model: Model, *, least: float = 0.5) -> DataFrame:
    """The documents that score at least ``least``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in columns.slices(batch, "text"):
                yield rows.filter(pa.array(scores(shared.value, rows.column("text")) >= least))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows that must not be learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
