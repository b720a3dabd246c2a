"""Package layout: duplicates, blocks, parts and volumes, as relations.

Files: seq (their order, distinct), root, path, size, sha256, class and ``compressible``. All compressible bytes run through solid blocks one
after the other; every other file is cut into blocks of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quay.functions import fixed, local
from quay.operators import ordered
from quay.operators.staged import staged


def dedup(files: DataFrame) -> DataFrame:
    """Adds ``dup`` and ``original`` (seq): the first of equal content is the original; empty files never are duplicates."""
    # Only sizes that occur twice can repeat; of those the first by seq is a plain aggregate, so no large window is needed.
    f, n = local.free(files, "first", "n")
    first = files.where("size > 0").groupBy("sha256", "size").agg(F.min("seq").alias(f), F.count(F.lit(1)).alias(n)).where(F.col(n) > 1).drop(n)
    joined = files.join(first, ["sha256", "size"], "left")
    dup = F.col(f).isNotNull() & (F.col(f) < F.col("seq"))
    return joined.select(*[files[c] for c in files.columns], dup.alias("dup"), F.when(dup, F.col(f)).otherwise(F.col("seq")).alias("original"))


def same_size(files: DataFrame) -> DataFrame:
    """Files whose size another file has: only these need a hash."""
    sizes = files.groupBy("size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size")
    return files.join(sizes, "size", "left_semi")


def solid_parts(files: DataFrame, block: int) -> DataFrame:
    """Parts of compressible originals: seq, solid (number of the solid block), off, len."""
    rows = ordered.prefix_sum(files.where("compressible and not dup and size > 0").select("seq", "size"), F.col("size"), "pos")
    cut = rows.withColumn("solid", F.explode(F.expr(f"sequence(pos div {block}L, (pos + size - 1) div {block}L)")))
    begin = F.greatest(F.col("pos"), F.col("solid") * block)
    return cut.select("seq", "solid", (begin - F.col("solid") * block).alias("off"), (F.least(F.col("pos") + F.col("size"), (F.col("solid") + 1) * block) - begin).alias("len"))


def stored_parts(files: DataFrame, block: int) -> DataFrame:
    """Parts of stored originals: one block each, seq, k (number in the file), len."""
    rows = files.where("not compressible and not dup and size > 0").select("seq", "size")
    cut = rows.withColumn("k", F.explode(F.expr(f"sequence(0L, (size - 1) div {block}L)")))
    return cut.select("seq", "k", F.least(F.lit(block).cast("long"), F.col("size") - F.col("k") * block).alias("len"))


def layout(files: DataFrame, block: int = fixed.BLOCK_SIZE) -> tuple[DataFrame, DataFrame]:
    """(blocks, parts) of deduplicated files. Blocks: block_id, kind, raw. Parts: seq, block_id, off, len, n; duplicates share their original's.

    Blocks are numbered as they fill: a stored block with its file, a solid one with the file that fills it, the last solid one at the end.
    """
    files = staged(files.select("seq", "size", "compressible", "dup", "original"))  # what follows reads it several times
    solid, stored = staged(solid_parts(files, block)), staged(stored_parts(files, block))
    filled = solid.groupBy("solid").agg(F.max("seq").alias("seq"), F.sum("len").alias("raw"))
    end = files.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("_end"))
    solid_blocks = filled.withColumn("_one", F.lit(1)).join(F.broadcast(end.withColumn("_one", F.lit(1))), "_one").select(
        F.lit("solid").alias("kind"), F.when(F.col("raw") < block, F.col("_end")).otherwise(F.col("seq")).alias("seq"), F.col("solid").alias("k"), F.lit(None).cast("long").alias("file"), "raw"
    )
    stored_blocks = stored.select(F.lit("stored").alias("kind"), "seq", "k", F.col("seq").alias("file"), F.col("len").alias("raw"))
    both = staged(ordered.numbered(solid_blocks.unionByName(stored_blocks), "block_id", ties=("kind", "k")))
    blocks = both.select("block_id", "kind", "raw")
    solid_ids = both.where("kind = 'solid'").select(F.col("k").alias("solid"), "block_id")
    stored_ids = both.where("kind = 'stored'").select(F.col("file").alias("seq"), "k", "block_id")
    parts = solid.join(solid_ids, "solid").select("seq", "block_id", "off", "len").unionByName(
        stored.join(stored_ids, ["seq", "k"]).select("seq", "block_id", F.lit(0).cast("long").alias("off"), "len")
    )
    shared = files.where("size > 0").select("seq", "original").join(parts.withColumnRenamed("seq", "original"), "original").drop("original")
    n = F.row_number().over(Window.partitionBy("seq").orderBy("block_id")) - 1
    return blocks, shared.withColumn("n", n)


def volumes(blocks: DataFrame, parts: DataFrame, *, stored: Column | None = None, volume_size: int = fixed.VOLUME_SIZE, reserve: int = fixed.RESERVE, package: Column | None = None) -> DataFrame:
    """(block_id, volume, pos): next fit in the order of blocks, an empty volume takes any.

    A volume keeps room for its index: so much for each entry that has a part in it and for each block. The choice depends on all choices before, so it is
    a fold over the blocks of one package in order, which are streamed: a row for every block of 32 MiB, and nothing is kept but where the
    volume stands. ``package`` tells packages apart, which are folded in parallel.
    """
    # for each entry of a block: the entry's block before, which tells whether the current volume already counts the entry
    before = F.lag("block_id").over(Window.partitionBy("seq").orderBy("block_id"))
    entries = parts.select("seq", "block_id").distinct().withColumn("prev", F.coalesce(before, F.lit(-1).cast("long"))).groupBy("block_id").agg(F.collect_list("prev").alias("prevs"))
    size = F.col("raw") if stored is None else stored
    rows = blocks.join(entries, "block_id", "left").select(
        (F.lit(0) if package is None else package).alias("package"), F.struct("block_id", size.cast("long").alias("stored"), F.coalesce("prevs", F.array().cast("array<bigint>")).alias("prevs")).alias("b")
    )
    dealt = rows.select("package", "b.*").repartition("package").sortWithinPartitions("package", "block_id")
    kind = dict(rows.dtypes)["package"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = VolumeState(volume_size, reserve)
        for batch in batches:
            columns = (batch.column(c) for c in ("package", "block_id", "stored", "prevs"))
            found = [state.place(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("package"), batch.column("block_id"), pa.array([v for v, _ in found], pa.int32()), pa.array([p for _, p in found], pa.int64())], ["package", "block_id", "volume", "pos"])

    folded = dealt.mapInArrow(fold, f"package {kind}, block_id long, volume int, pos long")
    return folded if package is not None else folded.drop("package")


@dataclass
class VolumeState:
    """Where the volume that is being filled stands."""

    size: int
    reserve: int
    package: object = None
    volume: int = 0
    pos: int = 0
    first: int = 0
    blocks: int = 0
    touched: int = 0

    def place(self, package: object, block: int, stored: int, prevs: list[int]) -> tuple[int, int]:
        """The volume and the position of the next block; ``prevs``: of each entry with a part in it, the block before that has one."""
        if package != self.package or not self.volume:
            self.package, self.volume, self.blocks = package, 0, 0
        need = fixed.BLOCK_HEAD + stored
        if not self.blocks or self.pos + need + self.touched * fixed.PER_ENTRY + self.blocks * fixed.PER_BLOCK + self.reserve > self.size:
            self.volume, self.pos, self.first, self.blocks, self.touched = self.volume + 1, fixed.VOLUME_HEAD, block, 0, 0
        at = self.pos
        self.pos, self.blocks = at + need, self.blocks + 1
        # at its first block a volume counts every entry, later those it has not counted yet
        self.touched += len(prevs) if self.blocks == 1 else sum(p < self.first for p in prevs)
        return self.volume, at


def duplicate_entries(entries: DataFrame) -> DataFrame:
    """(root, path, n) of entries that a package refuses, as it has one of that root and path."""
    return entries.groupBy("root", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def size_mismatches(listed: DataFrame, packed: DataFrame) -> DataFrame:
    """(seq, listed, packed) of files (seq, size) that grew or shrank between the inventory and the package."""
    both = listed.select("seq", F.col("size").alias("listed")).join(packed.select("seq", F.col("size").alias("packed")), "seq")
    return both.where("listed <> packed")


def placed(files: DataFrame, parts: DataFrame, located: DataFrame) -> DataFrame:
    """Adds ``placed``: all bytes of the file lie in blocks that are in a volume."""
    n, inside = local.free(files, "len", "inside")
    have = parts.join(located.select("block_id", "volume"), "block_id", "left").groupBy("seq").agg(F.sum("len").alias(n), F.bool_and(F.coalesce(F.col("volume") > 0, F.lit(False))).alias(inside))
    return files.join(have, "seq", "left").select(*[files[c] for c in files.columns], ((F.col("size") == 0) | (F.coalesce(inside, F.lit(False)) & (F.col(n) == F.col("size")))).alias("placed"))


def volume_table(blocks: DataFrame, located: DataFrame) -> DataFrame:
    """Blocks and bytes of each volume."""
    joined = blocks.join(located, "block_id")
    return joined.groupBy("volume").agg(F.count(F.lit(1)).alias("blocks"), F.sum("raw").alias("raw"), (F.sum(F.col("raw") + fixed.BLOCK_HEAD) + fixed.VOLUME_HEAD).alias("bytes"))


def needed_volumes(parts: DataFrame, located: DataFrame, wanted: DataFrame) -> DataFrame:
    """The volumes that hold a block of the wanted files (seq)."""
    blocks = parts.join(wanted.select("seq"), "seq", "left_semi").select("block_id").distinct()
    return located.join(blocks, "block_id", "left_semi").select("volume").distinct()


def in_volume(files: DataFrame, parts: DataFrame, located: DataFrame) -> DataFrame:
    """(volume, seq) for every file with a part in the volume: what the volume's own index lists."""
    return parts.join(located.select("block_id", "volume"), "block_id").select("volume", "seq").distinct().join(files.select("seq"), "seq", "left_semi")


def saved(files: DataFrame) -> DataFrame:
    """Duplicate files and the bytes they do not take."""
    return files.agg(F.count_if("dup").alias("dups"), F.coalesce(F.sum(F.when(F.col("dup"), F.col("size"))), F.lit(0)).alias("saved_bytes"))
