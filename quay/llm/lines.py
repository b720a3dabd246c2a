"""Line deduplication over a sharded minimal perfect hash.

Each distinct line key becomes a 128-bit hash. Shards of the hashes get a minimal perfect hash (levels of bit arrays with ranks) that indexes
three compact arrays: fingerprint, document count and largest doc_id. Documents' line hashes are sent to the shards' arrays and
probe them; lines are never joined with lines. A shard that holds a very common line is copied as often as its
probes need, so the probes of one line spread over many tasks.

A line's key is the line without white space (space, 0x09-0x0D) at its ends, with A-Z in lower case.

Defined cases: null or empty text is one empty line, which has no key of the least length; repeated rows are documents of their own (each counts,
and of rows with the largest doc_id all keep the line); a null doc_id is smaller than any other; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quay.llm import columns, shared

STRIP = " \t\n\x0b\x0c\r"
NO_ID = -(2**63)
#: Distinct lines in a shard, and probes that one copy of a shard takes.
SHARD_LINES, COPY_PROBES = 100_000, 400_000
GAMMA = 1.5  # bits per key in each level


def line_key(line: str) -> bytes:
    return line.strip(STRIP).encode("utf-8", "surrogatepass").translate(columns.LOWER_TABLE)


def line_hash(line: str, least: int) -> bytes | None:
    """The 128-bit hash of a line's key, None below ``least`` code points."""
    import xxhash

    bare = line.strip(STRIP)
    return xxhash.xxh3_128_digest(bare.encode("utf-8", "surrogatepass").translate(columns.LOWER_TABLE)) if len(bare) >= least else None


# -- minimal perfect hash ----------------------------------------------------------------------------------------------


def _slots(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    return (columns.mixed(hi ^ (lo * np.uint64(2 * level + 1))) % np.uint64(size)).astype(np.int64)


def mph_build(hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
    """Bits of each level; a key belongs to the first level where no other key that is left shares its slot."""
    levels = []
    while len(hi):
        size = max(64, int(GAMMA * len(hi)))
        at = _slots(hi, lo, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = ~alone[at]
        hi, lo = hi[left], lo[left]
    return levels


def mph_index(levels: list[np.ndarray], hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The place of each key, -1 for what falls through all levels."""
    out, left, base = np.full(len(hi), -1, np.int64), np.arange(len(hi)), 0
    for k, bits in enumerate(levels):
        at = _slots(hi[left], lo[left], k, len(bits))
        ranks = np.cumsum(bits) - 1
        got = bits[at]
        out[left[got]] = base + ranks[at[got]]
        base += int(bits.sum())
        left = left[~got]
    return out


def pack_levels(levels: list[np.ndarray]) -> tuple[list[int], bytes]:
    return [len(x) for x in levels], b"".join(np.packbits(x).tobytes() for x in levels)


def unpack_levels(sizes: list[int], raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    for n in sizes:
        m = (n + 7) // 8
        out.append(np.unpackbits(np.frombuffer(raw, np.uint8, m, at), count=n).astype(bool))
        at += m
    return out


# -- operator ----------------------------------------------------------------------------------------------------------


def _hashed(docs: DataFrame, least: int, combine: bool) -> DataFrame:
    """Rows (hi, lo, docs, top) summed over some documents, or with ``combine`` off (hi, lo, doc_id): a document's distinct line hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in columns.slices(batch, "text"):
                found, owner = [], []
                for i, text in enumerate(rows.column("text").to_pylist()):
                    mine = {h for line in text.split("\n") if len(line) >= least and (h := line_hash(line, least))}
                    found.extend(mine)
                    owner.extend([i] * len(mine))
                both = np.frombuffer(b"".join(found), ">u8").astype(np.uint64).reshape(-1, 2)
                ids = rows.column("doc_id").to_numpy()[np.array(owner, np.int64)]
                if not combine:
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].view(np.int64)), pa.array(both[:, 1].view(np.int64)), pa.array(ids)], ["hi", "lo", "doc_id"])
                elif len(ids):
                    order = np.lexsort((both[:, 1], both[:, 0]))
                    a, b, ids = both[order, 0], both[order, 1], ids[order]
                    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
                    n = np.diff(np.append(first, len(a)))
                    yield pa.RecordBatch.from_arrays([pa.array(a[first].view(np.int64)), pa.array(b[first].view(np.int64)), pa.array(n), pa.array(np.maximum.reduceat(ids, first))], ["hi", "lo", "docs", "top"])

    return docs.mapInArrow(run, "hi long, lo long, docs long, top long" if combine else "hi long, lo long, doc_id long")


INDEX = "shard long, copies long, sizes array<long>, bits binary, prints binary, counts binary, tops binary"


def _build(table: pa.Table) -> pa.Table:
    """The arrays of one shard."""
    hi, lo, docs, top = (table.column(c).to_numpy() for c in ("hi", "lo", "docs", "top"))
    hi, lo = hi.view(np.uint64), lo.view(np.uint64)
    levels = mph_build(hi, lo)
    at = mph_index(levels, hi, lo)
    prints, counts, tops = np.empty(len(hi), "<u4"), np.empty(len(hi), "<u4"), np.empty(len(hi), "<i8")
    prints[at], counts[at], tops[at] = lo & np.uint64(0xFFFFFFFF), np.minimum(docs, 2**32 - 1), top
    sizes, bits = pack_levels(levels)
    copies = -(-int(docs.sum()) // COPY_PROBES)
    kind = pa.schema([("shard", pa.int64()), ("copies", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("prints", pa.binary()), ("counts", pa.binary()), ("tops", pa.binary())])
    return pa.Table.from_pydict({"shard": [table.column("shard")[0].as_py()], "copies": [copies], "sizes": [sizes], "bits": [bits], "prints": [prints.tobytes()], "counts": [counts.tobytes()], "tops": [tops.tobytes()]}, kind)


def _probe(least_docs: int):
    def run(probes: pa.Table, index: pa.Table) -> pa.Table:
        if not len(probes):
            return pa.Table.from_pydict({"doc_id": pa.array([], pa.int64()), "hash": pa.array([], pa.binary())})
        hi, lo, doc = (probes.column(c).to_numpy() for c in ("hi", "lo", "doc_id"))
        hi, lo = hi.view(np.uint64), lo.view(np.uint64)
        shard = index.slice(0, 1).to_pylist()[0]
        at = mph_index(unpack_levels(shard["sizes"], shard["bits"]), hi, lo)
        prints, counts, tops = np.frombuffer(shard["prints"], "<u4"), np.frombuffer(shard["counts"], "<u4"), np.frombuffer(shard["tops"], "<i8")
        drop = (at >= 0) & (prints[at] == (lo & np.uint64(0xFFFFFFFF))) & (counts[at] >= least_docs) & (tops[at] != doc)
        raw = np.stack([hi[drop], lo[drop]], 1).astype(">u8").tobytes()
        return pa.Table.from_pydict({"doc_id": pa.array(doc[drop]), "hash": pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())})

    return run


def line_dedup(docs: DataFrame, *, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_text.

    Keys of at least ``least_chars`` code points in at least ``least_docs`` documents lose their lines, but for those of the largest
    doc_id among them.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    distinct = shared.stored(_hashed(rows, least_chars, True).groupBy("hi", "lo").agg(F.sum("docs").alias("docs"), F.max("top").alias("top")), "lines")
    shards = max(1, distinct.count() // SHARD_LINES)
    shard = F.pmod(F.col("hi"), F.lit(shards)).alias("shard")
    index = shared.stored(distinct.select("*", shard).groupBy("shard").applyInArrow(_build, INDEX), "index")
    spread = index.select(F.col("shard").alias("at"), F.col("copies").alias("spread")).withColumnRenamed("at", "shard")
    probes = _hashed(rows, least_chars, False).select("*", shard).join(spread, "shard").select("hi", "lo", "doc_id", "shard", F.pmod(F.xxhash64("doc_id"), F.col("spread")).alias("copy"))
    copied = index.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    found = probes.groupBy("shard", "copy").cogroup(copied.groupBy("shard", "copy")).applyInArrow(_probe(least_docs), "doc_id long, hash binary")
    # at most the lines of one document meet here
    drops = found.groupBy("doc_id").agg(F.collect_set("hash").alias("drops"))
    kind = "doc_id long, n_lines long, n_dropped long, kept_text string"
    return rows.join(drops, "doc_id", "left").mapInArrow(_rewrite(least_chars), kind)


def _rewrite(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, drops in zip(batch.column("text").to_pylist(), batch.column("drops").to_pylist(), strict=True):
                lines = text.split("\n")
                n_lines.append(len(lines))
                if drops:
                    gone = set(drops)
                    left = [x for x in lines if len(x) < least or line_hash(x, least) not in gone]
                    n_dropped.append(len(lines) - len(left))
                    text = "\n".join(left)
                else:
                    n_dropped.append(0)
                kept.append(text)
            ids = batch.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])

    return run
