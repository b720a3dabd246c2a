"""Roots: absolute paths as (root, relative path) and back.

``roots``: root, root_path. The longest root that holds a path wins. A path's own ancestors are exploded and joined by equality, so the
match is a hash join whatever the number of roots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quay.functions import local, paths

OTHER = "other"


def split_roots(files: DataFrame, roots: DataFrame, *, os: str = "linux") -> DataFrame:
    """Adds ``root`` and ``rel``; what no root holds gets root ``other`` and its portable absolute path."""
    b, = local.free(files, "best")
    mine = files.select("path").distinct().withColumn("_up", F.explode(paths.ancestors(F.col("path"))))
    held = mine.join(roots.select("root", F.col("root_path").alias("_up")), "_up")
    best = held.groupBy("path").agg(F.max(F.struct(F.length("_up").alias("n"), F.col("_up").alias("up"), F.col("root").alias("root"))).alias(b))
    rel = F.coalesce(paths.under(F.col("path"), F.col(b)["up"]), paths.other_key(F.col("path"), F.lit(os)))
    return files.join(best, "path", "left").select(*files.columns, F.coalesce(F.col(b)["root"], F.lit(OTHER)).alias("root"), rel.alias("rel"))


def join_roots(entries: DataFrame, roots: DataFrame, *, home: str, restored: str = "restored-files") -> DataFrame:
    """Adds ``dest``, the absolute path of (root, rel) here; null where the root does not exist."""
    up, = local.free(entries, "up")
    joined = entries.join(roots.select("root", F.col("root_path").alias(up)), "root", "left")
    base = F.when(F.col("root") == OTHER, F.lit(f"{home}/{restored}")).otherwise(F.col(up))
    dest = F.when(F.col("rel").isin(".", ""), base).otherwise(F.concat(base, F.lit("/"), F.col("rel")))
    return joined.select(*entries.columns, dest.alias("dest"))


def default_roots(candidates: DataFrame) -> DataFrame:
    """Existing folders (path, exists, is_dir) without those inside another one, each once."""
    found = candidates.where("exists and is_dir").select("path").distinct()
    above = found.withColumn("_up", F.explode(paths.ancestors(F.col("path")))).where("_up <> path")
    nested = above.join(found.select(F.col("path").alias("_up")), "_up", "left_semi").select("path").distinct()
    return found.join(nested, "path", "left_anti")


def outside(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows of ``files`` that lie in none of ``folders`` (path)."""
    inside = files.select("path").distinct().withColumn("_up", F.explode(paths.ancestors(F.col("path")))).join(folders.select(F.col("path").alias("_up")), "_up", "left_semi")
    return files.join(inside.select("path").distinct(), "path", "left_anti")


def root_summary(entries: DataFrame) -> DataFrame:
    """Files, bytes and duplicates by root; the roots of applications as one, with their number."""
    app = F.col("root").startswith("apps/")
    return entries.groupBy(F.when(app, "apps").otherwise(F.col("root")).alias("root")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_if("dup").alias("dups"), F.count_distinct(F.when(app, F.col("root"))).alias("app_roots")
    )
