"""File trees as inventories.

``read_tree`` uses Spark's file index: names, sizes and times without contents, on any store. ``TreeSource`` walks a mounted tree and also tells
symbolic links, folders, errors and what skipped folders hold.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quay.functions import local


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, size, modified of every file below a folder; contents are never read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_contents(spark: SparkSession, root: str) -> DataFrame:
    """path, size and SHA-256 of every file below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return rows.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


@dataclass
class Branch(InputPartition):
    path: str
    deep: bool


class TreeReader(DataSourceReader):
    """Walks one or several roots (``path``, separated by |), a partition for each file or folder of the first ``depth`` levels."""

    def __init__(self, options: dict):
        self.roots = [r for r in options["path"].split("|") if r]
        self.skip = {d.lower() for d in options.get("skip", "").split("|") if d}
        self.depth = int(options.get("depth", 2))

    def partitions(self) -> list[InputPartition]:
        """Folders above ``depth`` are listed here and read on their own, what lies at that depth with all below it."""
        out, open_ = [], [(r, 0) for r in self.roots]
        for path, level in open_:
            plain = os.path.isdir(path) and not os.path.islink(path) and not (level and self.skips(path))
            out.append(Branch(path, not plain or level >= self.depth))
            if plain and level < self.depth:
                try:
                    open_ += [(os.path.join(path, n), level + 1) for n in sorted(os.listdir(path))]
                except OSError:
                    out[-1] = Branch(path, True)  # its reader tells the error
        return out

    def skips(self, path: str) -> bool:
        return os.path.basename(path).lower() in self.skip

    def read(self, partition: Branch) -> Iterator[tuple]:
        yield from self.walk(partition.path, partition.deep)

    def walk(self, path: str, deep: bool = True) -> Iterator[tuple]:
        """Rows in lexical order; links are not followed; folders whose name is skipped give one row with the files and bytes below them."""
        try:
            st = os.lstat(path)
            if os.path.islink(path):
                yield (path, "symlink", 0, 0, None)
            elif os.path.isdir(path):
                if path not in self.roots and self.skips(path):
                    yield (path, "skipped", *self.below(path), None)
                else:
                    yield (path, "root" if path in self.roots else "dir", 0, 0, None)
                    for name in sorted(os.listdir(path)) if deep else ():
                        yield from self.walk(os.path.join(path, name))
            elif os.path.isfile(path):
                yield (path, "file", st.st_size, 1, None)
        except OSError as e:
            yield (path, "error", 0, 0, e.strerror or str(e))

    def below(self, path: str) -> tuple[int, int]:
        """Bytes and files of a subtree; what can't be read counts nothing."""
        size = files = 0
        for folder, _, names in os.walk(path):
            for name in names:
                try:
                    st = os.lstat(os.path.join(folder, name))
                except OSError:
                    continue
                if stat.S_ISREG(st.st_mode):
                    size, files = size + st.st_size, files + 1
        return size, files


class TreeSource(DataSource):
    """``spark.read.format("quay_tree").option("skip", "node_modules|.git").load(root)``: path, kind, size, files, error.

    Several roots are separated by |. ``depth`` (2) levels of folders are partitions of their own, so one large folder is not one task.
    """

    @classmethod
    def name(cls) -> str:
        return "quay_tree"

    def schema(self) -> str:
        return "path string, kind string, size long, files long, error string"

    def reader(self, schema) -> TreeReader:  # noqa: ARG002
        return TreeReader(dict(self.options))


def measure(tree: DataFrame) -> DataFrame:
    """Files, bytes, folders below the roots, links and errors of a walked tree."""
    kept = F.col("kind") != "skipped"
    return tree.agg(
        F.count_if(F.col("kind") == "file").alias("files"), F.coalesce(F.sum(F.when(kept, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(F.col("kind") == "dir").alias("dirs"),
        F.count_if(F.col("kind") == "symlink").alias("symlinks"), F.count_if(F.col("kind") == "error").alias("errors"),
    )


def scan_totals(tree: DataFrame) -> DataFrame:
    """Files, bytes, all folders (roots too), links, errors, and the bytes that skipped folders hold."""
    kept = F.col("kind") != "skipped"
    return tree.agg(
        F.count_if(F.col("kind") == "file").alias("files"), F.coalesce(F.sum(F.when(kept, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(F.col("kind").isin("dir", "root")).alias("dirs"),
        F.count_if(F.col("kind") == "symlink").alias("symlinks"), F.count_if(F.col("kind") == "error").alias("errors"), F.coalesce(F.sum(F.when(~kept, F.col("size"))), F.lit(0)).alias("skipped_bytes"),
    )


def skipped_folders(tree: DataFrame) -> DataFrame:
    """Files and bytes below the folders that each rule leaves out."""
    name = F.lower(F.regexp_extract("path", r"([^/\\]*)$", 1))
    return tree.where("kind = 'skipped'").groupBy(name.alias("rule")).agg(F.sum("files").alias("files"), F.sum("size").alias("bytes"))


#: File systems by their number on Linux, and the largest file of one of them.
FILE_SYSTEMS = {
    0x4D44: "FAT32", 0x2011BAB0: "exFAT", 0x5346544E: "NTFS", 0xEF53: "ext2/3/4", 0x9123683E: "btrfs", 0x58465342: "XFS", 0x2FC12FC1: "ZFS",
    0xF2F52010: "F2FS", 0x01021994: "tmpfs",
}
LARGEST_FILE = {"FAT32": (4 << 30) - 1}


def destinations(volumes: DataFrame) -> DataFrame:
    """Adds ``fs`` and ``max_file`` (0: no limit that matters) to (path, magic, total, free)."""
    kinds = local.table(volumes.sparkSession, [(m, f, LARGEST_FILE.get(f, 0)) for m, f in FILE_SYSTEMS.items()], "magic long, fs string, max_file long")
    return volumes.join(kinds, "magic", "left").withColumns({"fs": F.coalesce("fs", F.lit("unknown")), "max_file": F.coalesce("max_file", F.lit(0))})


def volume_size(destinations: DataFrame, wanted: int) -> DataFrame:
    """Adds ``volume``: the size of volumes there, as much as is wanted and one file may have."""
    limit = F.col("max_file")
    return destinations.withColumn("volume", F.when((limit > 0) & (limit < wanted), limit).otherwise(F.lit(wanted).cast("long")))
