"""Corpus-wide counts of 64-bit keys, answered block by block.

A block is a run of documents that one task has read. It sends each of its distinct keys once, with the block's own count, to the shard that
the key's upper bits name; the shard adds up all blocks' counts and answers every block with an array that lines up with the keys it
asked for. Nothing is broadcast, each distinct key of a block crosses the network once each way, and a very common key is one entry per
block. What a block needs again later (its tokens) it writes to the shared folder.

Blocks are named by partition and number, so a task that runs again names the same blocks; files also carry the attempt, so a late or
repeated attempt never writes into a file that another reads. This needs input whose partitions hold the same rows in the same order each time they are
computed, which scans of files do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quay.llm import columns, shared

#: Words in a block, about.
BLOCK_WORDS = 2_000_000
REQUEST = "block string, path string, shard int, keys binary, counts binary"
ANSWER = "block string, path string, shard int, counts binary, kinds long, total long"


def squeeze(x: np.ndarray) -> bytes:
    """Integers by byte planes, compressed: planes of zeros vanish."""
    import zstandard

    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def spread(raw: bytes, kind: type) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def spread_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(spread(raw, np.uint64), dtype=np.uint64)


@dataclass
class Block:
    """Documents as word numbers: ``words[bounds[i]:bounds[i + 1]]`` are places in ``hashes``."""

    ids: np.ndarray
    flags: np.ndarray
    hashes: np.ndarray
    words: np.ndarray
    bounds: np.ndarray
    null_ids: np.ndarray

    def take(self, docs: np.ndarray) -> Block:
        """These documents alone."""
        sizes = np.diff(self.bounds)[docs]
        words = self.words[columns.ranges(self.bounds[:-1][docs], sizes)]
        return Block(self.ids[docs], self.flags[docs], self.hashes, words, np.concatenate(([0], np.cumsum(sizes))), self.null_ids[docs])

    def save(self, path: str) -> None:
        fs, at = shared.filesystem(path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        parts = [squeeze(x) for x in (self.ids, self.flags, self.hashes, self.words, self.bounds, self.null_ids)]
        with fs.open_output_stream(at) as f:
            f.write(np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(parts))

    @classmethod
    def load(cls, path: str) -> Block:
        fs, at = shared.filesystem(path)
        with fs.open_input_stream(at) as f:
            raw = f.read()
        sizes, begin, parts = np.frombuffer(raw, "<i8", 6).tolist(), 48, []
        for n, kind in zip(sizes, (np.int64, np.uint8, np.uint64, np.uint32, np.int64, np.uint8), strict=True):
            parts.append(spread(raw[begin : begin + n], kind))
            begin += n
        return cls(*parts)


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_WORDS) -> Iterator[Block]:
    """Batches (doc_id, text, flag) as blocks of about ``limit`` words between white space, A-Z in lower case."""
    table, held, size = columns.whitespace_classes(), [], 0

    def made() -> Block:
        hashes, place = np.unique(np.concatenate([h for _, _, h, _, _ in held]), return_inverse=True)
        words, counts, at = [], [], 0
        for _, _, h, index, n in held:
            words.append(place[at : at + len(h)].astype(np.uint32)[index])
            counts.append(n)
            at += len(h)
        ids = np.concatenate([i.fill_null(0).to_numpy(zero_copy_only=False) for i, *_ in held])
        nulls = np.concatenate([i.is_null().to_numpy(zero_copy_only=False) for i, *_ in held]).astype(np.uint8)
        flags = np.concatenate([f for _, f, *_ in held]).astype(np.uint8)
        return Block(ids, flags, hashes, np.concatenate(words), np.concatenate(([0], np.cumsum(np.concatenate(counts)))), nulls)

    for batch in batches:
        for rows in columns.slices(batch, "text"):
            w = columns.split(rows.column("text"), table)
            flag = rows.column("flag").to_numpy(zero_copy_only=False)
            held.append((rows.column("doc_id"), flag, columns.hashes(w.vocab), w.index, w.counts()))
            size += len(w.index)
            if size >= limit:
                yield made()
                held, size = [], 0
    if held:
        yield made()


def shard_bits(df: DataFrame) -> int:
    """As many shards as shuffle partitions, up to a power of two."""
    return max(3, (parts(df) - 1).bit_length())


def asked(name: str, path: str, keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """The request rows of a block, one for every shard: also where there are no keys."""
    edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
    spans = [slice(edges[s], edges[s + 1]) for s in range(1 << bits)]
    return pa.RecordBatch.from_pydict({
        "block": [name] * len(spans), "path": [path] * len(spans), "shard": pa.array(range(len(spans)), pa.int32()),
        "keys": pa.array([squeeze_sorted(keys[x]) for x in spans], pa.binary()), "counts": pa.array([squeeze(counts[x].astype(np.uint32)) for x in spans], pa.binary()),
    })


def requests(docs: DataFrame, keys_of, folder: str, bits: int) -> DataFrame:
    """``docs``: doc_id long, text string, flag boolean. ``keys_of(block)`` gives ascending distinct keys and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        for k, block in enumerate(blocks(batches)):
            name = f"{task.partitionId()}-{k}"
            path = f"{folder}/{name}-{task.taskAttemptId()}"
            block.save(path)
            yield asked(name, path, *keys_of(block), bits)

    return docs.mapInArrow(run, REQUEST)


def _answer(table: pa.Table) -> pa.Table:
    keys = [spread_sorted(x) for x in table.column("keys").to_pylist()]
    sizes = np.array([len(k) for k in keys])
    flat = np.concatenate(keys)
    counts = np.concatenate([spread(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(flat) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts[order], first) if len(flat) else np.zeros(0, np.int64)
    answer = np.empty(len(flat), np.uint64)
    answer[order] = np.repeat(total, np.diff(np.append(first, len(flat)))).astype(np.uint64)
    ends = np.cumsum(sizes)
    n = len(table)
    # of the even keys, how many have a count and what it adds up to: told once per shard
    even = total[ranked[first] % np.uint64(2) == 0]
    seen = [int((even > 0).sum())] + [0] * (n - 1), [int(even.sum())] + [0] * (n - 1)
    return pa.Table.from_pydict({
        "block": table.column("block"), "path": table.column("path"), "shard": table.column("shard"),
        "counts": pa.array([squeeze(answer[e - s : e]) for s, e in zip(sizes, ends, strict=True)], pa.binary()),
        "kinds": pa.array(seen[0], pa.int64()), "total": pa.array(seen[1], pa.int64()),
    })


def parts(df: DataFrame) -> int:
    """Partitions that the session shuffles into."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Dealt by a key into as many partitions as the session shuffles into: a row here stands for much work, so few bytes must not end up in few tasks."""
    return df.repartition(parts(df), key)


def answers(asked: DataFrame) -> DataFrame:
    return dealt(asked, "shard").groupBy("shard").applyInArrow(_answer, ANSWER)


def per_block(answered: DataFrame, use, schema: str) -> DataFrame:
    """``use(block, counts)`` for every block, with the corpus-wide counts of the keys it asked for, in their order."""

    def run(table: pa.Table) -> pa.Table:
        parts = sorted(zip(table.column("shard").to_pylist(), table.column("counts").to_pylist(), strict=True))
        return use(Block.load(table.column("path")[0].as_py()), np.concatenate([spread(x, np.uint64) for _, x in parts]))

    return dealt(answered.select("block", "path", "shard", "counts"), "block").groupBy("block").applyInArrow(run, schema)


def picked(docs: DataFrame, flag) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), flag.alias("flag"))
