"""Packing by power-of-two decomposition.

Every document's ids (with the end id) are cut into as many full pieces as fit and then into one piece for each binary
digit of what remains, from the longest down. A piece is a sequence of its own: sequences of one length form a bucket,
none crosses documents and none needs padding.

Defined cases: null text counts as empty and gives one piece with only the end id; a null doc_id is kept as null; rows that
repeat are packed each; an empty table gives no pieces; columns of the input other than the id and the text are ignored,
so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quay.llm import columns
from quay.llm.tokens import token_cache

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: sequence_id: bucket, partition and number in the partition have so many bits, from the top down.
PARTITION_BITS, ROW_BITS = 24, 34


def decompose(n: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece lengths of documents of n ids, longest first, and the number of pieces of each document."""
    sizes = 1 << np.arange(longest.bit_length() - 1, -1, -1)
    digits = (n[:, None] // sizes) & 1
    digits[:, 0] = n // longest
    return np.repeat(np.tile(sizes, len(n)), digits.ravel()), digits.sum(1)


def pack(docs: DataFrame, tokenizer: str, *, longest: int = 2048, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text", added: bool = False) -> DataFrame:
    """One row per piece; ``ids`` holds its ids as little-endian unsigned 32-bit integers.

    Sequence ids need no shuffle: they join the bucket (so equal lengths are neighbours), the partition and a number.
    ``longest`` must be a power of two; ``added`` as in ``TokenCache``.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, part, made = token_cache(tokenizer, end_id, added), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in columns.slices(batch, "text"):
                ids, bounds = cache.encode(rows.column("text"))
                n = np.diff(bounds)
                length, pieces = decompose(n, longest)
                first = np.concatenate(([0], np.cumsum(length)))
                doc = np.repeat(np.arange(len(n)), pieces)
                bucket = np.log2(length).astype(np.int64)
                seq = (bucket << (PARTITION_BITS + ROW_BITS)) | (part << ROW_BITS) | (made + np.arange(len(length)))
                made += len(length)
                cut = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer((first * 4).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(doc)), *map(pa.array, (first[:-1] - bounds[doc], length, n[doc], seq, np.zeros(len(seq), np.int64))), cut],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return picked.mapInArrow(run, SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The sequences as Parquet, a folder for each length: a training job reads one bucket at a time."""
    pieces.write.partitionBy("length").parquet(path)
