"""Flat token files with 64-bit document offsets, written in parallel and read through memory maps.

A shard is three files: ``.bin`` with the ids as flat unsigned integers (16 bits where the vocabulary allows, else 32),
``.off`` with the 64-bit offsets of its documents (one more than documents) and ``.doc`` with their 64-bit ids. Offsets
count from the shard's start; the shard's base is the prefix sum over the shards before it, kept in the manifest.

Defined cases: null text counts as empty (only the end id); rows with equal doc_id stay neighbours, ordered by text; a
null doc_id comes first and is written as the least 64-bit integer, which reads back as null; an empty table makes
no shards; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quay.llm import columns, shared
from quay.llm.tokens import token_cache

NO_ID = -(2**63)
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


@dataclass
class TokenFile:
    """The manifest: one row per shard, (part, path, docs, tokens, base), and the width of an id in bytes."""

    shards: list[tuple[int, str, int, int, int]]
    width: int


def write(docs: DataFrame, tokenizer: str, path: str, *, end_id: int = 2, vocabulary: int = 49408, partitions: int | None = None, added: bool = False) -> TokenFile:
    """Write all documents in ascending doc_id order below ``path`` (a folder that all executors share).

    A shard's files carry the attempt's own name and only the manifest of the attempt that Spark accepted names them, so a lost or
    repeated task leaves no partial shard behind. The driver holds one manifest row for each shard.
    ``added`` as in ``TokenCache``.
    """
    width = 2 if vocabulary <= 1 << 16 else 4
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    picked = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = picked.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{path}/shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        cache, ends, ids_out, total = token_cache(tokenizer, end_id, added), [np.zeros(1, np.int64)], [], 0
        out = None
        for batch in batches:
            for rows in columns.slices(batch, "text"):
                if out is None:
                    fs, at = shared.filesystem(name)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(at + ".bin")
                ids, bounds = cache.encode(rows.column("text"))
                out.write(ids.astype("<u2" if width == 2 else "<u4").tobytes())
                ends.append(bounds[1:] + total)
                ids_out.append(rows.column("doc_id").to_numpy())
                total += int(bounds[-1])
        if out is None:
            return
        out.close()
        for kind, x in ((".off", np.concatenate(ends).astype("<u8")), (".doc", np.concatenate(ids_out).astype("<i8"))):
            with fs.open_output_stream(at + kind) as f:
                f.write(x.tobytes())
        docs_n = sum(map(len, ids_out))
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [name], "docs": [docs_n], "tokens": [total]})

    found = ordered.mapInArrow(run, "part long, path string, docs long, tokens long").collect()
    shards, base = [], 0
    for r in sorted(found):
        shards.append((r.part, r.path, r.docs, r.tokens, base))
        base += r.tokens
    return TokenFile(shards, width)


def read(spark: SparkSession, file: TokenFile) -> DataFrame:
    """One row per document from the files: its offset in the whole sequence and its ids (little-endian, 32 bits)."""
    width = file.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                yield from _read_shard(shard["path"], shard["base"], width)

    schema = "part long, path string, docs long, tokens long, base long"
    table = spark.createDataFrame(file.shards, schema)
    if file.shards:
        table = table.repartitionByRange(len(file.shards), "part")
    return table.mapInArrow(run, READ_SCHEMA)


def _read_shard(path: str, base: int, width: int) -> Iterator[pa.RecordBatch]:
    fs, at = shared.filesystem(path)

    def mapped(kind: str, dtype: str) -> np.ndarray:
        if isinstance(fs, LocalFileSystem):
            return np.memmap(at + kind, dtype, "r")
        with fs.open_input_file(at + kind) as f:  # a store without local files
            return np.frombuffer(f.read_buffer(), dtype)

    ids, off, doc = mapped(".bin", "<u2" if width == 2 else "<u4"), mapped(".off", "<u8").astype(np.int64), mapped(".doc", "<i8")
    i = 0
    while i < len(doc):
        j = max(i + 1, int(np.searchsorted(off, off[i] + (2 << 20), "right")) - 1)
        wide = np.ascontiguousarray(ids[off[i] : off[j]], "<u4")
        cut = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(((off[i : j + 1] - off[i]) * 4).astype(np.int32)), pa.py_buffer(wide)])
        named = np.array(doc[i:j])
        yield pa.RecordBatch.from_arrays([pa.array(named, mask=named == NO_ID), pa.array(base + off[i:j]), pa.array(np.diff(off[i : j + 1])), cut], ["doc_id", "start", "n_tokens", "ids"])
        i = j


def crc(data: bytes) -> int:
    """Unsigned crc32, as Spark's crc32 gives it."""
    return zlib.crc32(data)
