"""Restore plan: names that the target accepts, collisions, conflicts with what is there, totals.

Entries: root, path, size. ``roots``: root, root_path of the target. ``existing``: path, is_dir.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quay.functions import local, paths
from quay.operators import roots as rootmap

SUFFIX = " (kept)"
#: The root of what a package keeps for itself.
META = "meta"
#: Notes, as codes.
NO_PLACE, ADAPTED, COLLIDED = "no-place", "adapted", "collided"


def adapted(entries: DataFrame, roots: DataFrame, os: str) -> DataFrame:
    """Adds ``to_root``, ``clean``, ``renamed``, ``note``: where the entry goes before collisions are looked at."""
    have, r, gone = local.free(entries, "known", "rel", "lost")
    known = entries.join(roots.select("root", F.lit(True).alias(have)), "root", "left")
    lost = F.col(have).isNull() & (F.col("root") != rootmap.OTHER)
    rel = F.when(lost, F.concat("root", F.lit("/"), "path")).otherwise(F.col("path"))
    rows = known.withColumns({r: rel, gone: lost}).withColumn("clean", paths.sanitize(F.col(r), F.lit(os)))
    return rows.select(
        *[F.col(c) for c in entries.columns], F.when(F.col(gone), rootmap.OTHER).otherwise(F.col("root")).alias("to_root"), "clean", (F.col("clean") != F.col(r)).alias("renamed"),
        F.when(F.col("clean") != F.col(r), ADAPTED).when(F.col(gone), NO_PLACE).alias("note"),
    )


def _suffixed(path: str, suffix: str) -> str:
    folder, slash, name = path.rpartition("/")
    stem, dot, ext = name.rpartition(".")
    return folder + slash + (stem + suffix + dot + ext if stem else name + suffix)


def resolve_names(rows: Iterable[tuple[str, str]], os: str) -> Iterator[str]:
    """The names that (name, its fold key) get, one after the other."""
    taken: set[str] = set()
    reached: dict[str, int] = {}  # the last number that was tried for a key: what is taken stays taken
    for name, key in rows:
        final, at, n = name, key, reached.get(key, 1)
        while at in taken:
            n += 1
            final = _suffixed(name, "".join(f" ({i})" for i in range(2, n + 1)))
            at = final.lower() if os == "windows" else final
        reached[key] = n
        taken.add(at)
        yield final


def resolved(rows: DataFrame, os: str) -> DataFrame:
    """Adds ``final``: of names that are one file on the target, the first (by root, path) keeps its own and the k-th gets (2) to (k).

    That is a rank, unless a name with such suffixes may meet another file's own name. Names that reduce to one when suffixes are taken off form a
    family; only families of several names in which some collide are settled in order, as a stream that keeps the names given so far in one family.
    """
    k, f, r, n, keys = local.free(rows, "key", "family", "rank", "n", "keys")
    key = paths.fold_key(F.col("clean"), F.lit(os))
    keyed = rows.withColumns({k: key, f: F.regexp_replace(key, r"( \([0-9]+\))+(?=(\.[^./]*)?$)", "")})
    many = keyed.groupBy("to_root", f).agg(F.count(F.lit(1)).alias(n), F.count_distinct(k).alias(keys)).where((F.col(n) > F.col(keys)) & (F.col(keys) > 1)).select("to_root", f)
    ranked = keyed.join(many, ["to_root", f], "left_anti").withColumn(r, F.row_number().over(Window.partitionBy("to_root", k).orderBy("root", "path")))
    suffix = F.array_join(F.transform(F.sequence(F.lit(2), F.col(r)), lambda i: F.concat(F.lit(" ("), i.cast("string"), F.lit(")"))), "")
    easy = ranked.select(*rows.columns, F.when(F.col(r) == 1, F.col("clean")).otherwise(paths.with_suffix(F.col("clean"), suffix)).alias("final"))
    hard = keyed.join(many, ["to_root", f], "left_semi").repartition("to_root", f).sortWithinPartitions("to_root", f, "root", "path")
    hard = hard.select(*rows.columns, k, f)
    schema = T.StructType([*hard.schema.fields, T.StructField("final", T.StringType())])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, feed, names = None, None, None
        for batch in batches:
            found = []
            for root, family, name, own in zip(*(batch.column(c).to_pylist() for c in ("to_root", f, "clean", k)), strict=True):
                if (root, family) != now:
                    now, feed = (root, family), deque()
                    names = resolve_names(iter(feed.popleft, None), os)
                feed.append((name, own))
                found.append(next(names))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "final"])

    return easy.unionByName(hard.mapInArrow(settle, schema).drop(k, f))


def plan(entries: DataFrame, roots: DataFrame, existing: DataFrame, *, os: str, home: str, policy: str = "keep-both", suffix: str = SUFFIX, restored: str = "restored-files") -> DataFrame:
    """One row per entry: root, path, size, to_root, dest, action (write, next, skip, overwrite), renamed, exists, note."""
    named = resolved(adapted(entries, roots, os), os)
    hit = F.col("final") != F.col("clean")
    rows = named.withColumns({"renamed": F.col("renamed") | hit, "note": F.when(hit, COLLIDED).otherwise(F.col("note"))}).withColumnRenamed("root", "from_root")
    placed = rootmap.join_roots(rows.withColumnRenamed("to_root", "root").withColumnRenamed("final", "rel"), roots, home=home, restored=restored)
    is_dir, = local.free(placed, "there")
    seen = placed.join(existing.select(F.col("path").alias("dest"), F.col("is_dir").alias(is_dir)), "dest", "left")
    exists = F.col(is_dir).isNotNull()
    action = F.when(~exists, "write").when(F.col(is_dir), "next").otherwise({"skip": "skip", "overwrite": "overwrite"}.get(policy, "next"))
    acted = seen.withColumns({"exists": exists, "action": action})
    return acted.select(
        F.col("from_root").alias("root"), "path", "size", F.col("root").alias("to_root"),
        F.when(F.col("action") == "next", paths.with_suffix(F.col("dest"), F.lit(suffix))).otherwise(F.col("dest")).alias("dest"), "action", "renamed", "exists", "note",
    )


def totals(items: DataFrame) -> DataFrame:
    live = F.col("action") != "skip"
    return items.agg(
        F.count_if(live).alias("files"), F.coalesce(F.sum(F.when(live, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if("exists").alias("conflicts"),
        F.count_if("renamed").alias("renamed"), F.count_if(~live).alias("skipped"),
    )


def root_totals(items: DataFrame) -> DataFrame:
    return items.where("action <> 'skip'").groupBy("to_root").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))




def selected(entries: DataFrame, only: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """Entries of the named roots, or of all but the skipped ones; ``apps`` stands for the roots of all applications. A package's own root never is one."""
    name = F.when(F.col("root").startswith("apps/"), "apps").otherwise(F.col("root"))
    rows = entries.where(F.col("root") != META)
    if only is not None:
        rows = rows.where(name.isin(*only) if only else F.lit(False))
    return rows.where(~name.isin(*skip)) if skip else rows
