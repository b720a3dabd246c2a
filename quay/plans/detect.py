"""From sightings of installed software to applications of the database.

Sightings: seq (order of detection), via, package, version, name, desktop (and any machine columns in ``by``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quay.functions import fixed, local, paths
from quay.sources.appdb import AppDb, package_key


def name_prefixes(name: Column) -> Column:
    """The name and its beginnings that end before a blank or an opening bracket: makes the prefix match an equi join."""
    ends = F.filter(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, i, F.lit(1)).isin(" ", "("))
    return F.when(F.length(name) > 0, F.array_union(F.array(name), F.transform(ends, lambda i: F.substring(name, F.lit(1), i - 1)))).otherwise(F.array().cast("array<string>"))


def match(sightings: DataFrame, db: AppDb, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``app_id``, null where the database does not know the sighting.

    Managers that share names are tried one after the other; a display name matches the longest name that is a whole beginning of it.
    """
    key = ["seq", *by]
    asked = F.when(F.col("via").isin("dnf", "zypper"), F.array(F.lit("dnf"), F.lit("zypper"))).when(F.col("via") == "pacman", F.array(F.lit("pacman"), F.lit("aur"))).otherwise(F.array("via", "via"))
    bare = F.when((F.col("via") == "scoop") & F.col("package").contains("/"), F.regexp_extract("package", "^[^/]*/(.*)$", 1)).otherwise(F.col("package"))
    tries = sightings.where("via <> 'registry'").select(*key, F.posexplode(F.arrays_zip(asked.alias("manager"), F.array("package", bare).alias("as"))).alias("prio", "t"))
    tries = tries.select(*key, "prio", F.col("t.manager").alias("manager"), package_key(F.col("t.manager"), F.col("t.as")).alias("key"))
    # an identifier that two entries claim belongs to the first of them
    owners = db.packages.groupBy("manager", "key").agg(F.min("app_id").alias("app_id"))
    found = tries.join(owners, ["manager", "key"]).groupBy(*key).agg(F.min_by("app_id", "prio").alias("app_id"))
    shown = F.lower(F.trim("name"))
    named = sightings.where("via = 'registry'").select(*key, F.explode(name_prefixes(shown)).alias("name"))
    titles = db.names.groupBy("name").agg(F.min("app_id").alias("app_id"))
    longest = named.join(titles, "name").groupBy(*key).agg(F.max_by("app_id", F.length("name")).alias("app_id"))
    return sightings.join(found.unionByName(longest), key, "left")


def reportable() -> Column:
    """Whether an unknown sighting is worth telling."""
    runtime = F.lit(False)
    for p in fixed.RUNTIME_PREFIXES:
        runtime = runtime | F.lower(F.trim(F.coalesce("name", F.lit("")))).startswith(p)
    return F.when(F.col("via").isin(*fixed.DESKTOP_MANAGERS), F.coalesce("desktop", F.lit(False))).when(F.col("via") == "registry", ~runtime).otherwise(True)


def unknown(matched: DataFrame) -> DataFrame:
    return matched.where(F.col("app_id").isNull() & reportable())


def applications(matched: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per application: version (the first that is known) and its sources in order of detection."""
    known = matched.where("app_id is not null")
    return known.groupBy(*by, "app_id").agg(
        F.min_by("version", F.when(F.coalesce("version", F.lit("")) != "", F.col("seq"))).alias("version"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "via", "package"))), lambda s: F.concat_ws(":", s["via"], s["package"])).alias("sources"),
    )


def by_category(apps: DataFrame, db: AppDb) -> DataFrame:
    """Applications (app_id) by category: their number and names in order. A category has as many names as the database has entries of it."""
    named = apps.select("app_id").distinct().join(db.apps.select("app_id", "name", "category"), "app_id")
    return named.groupBy("category").agg(F.count(F.lit(1)).alias("apps"), F.sort_array(F.collect_list("name")).alias("names"))


def resolve(spots: DataFrame, *, home: str, env: dict[str, str] | None = None) -> DataFrame:
    """Adds ``abs`` to (os, variant, sandbox, path): where a database path lies here, null where it can't be told."""
    prefix, under = local.free(spots, "prefix", "base")
    dim = local.table(spots.sparkSession, list(fixed.PREFIXES), f"os string, variant string, {prefix} string, {under} string")
    for name, value in (env or {}).items():
        own = (F.col("variant") == "") & F.col(prefix).isin(f"${name}", f"%{name}%")
        dim = dim.withColumn(under, F.when(own & F.lit(value != ""), F.lit(value)).otherwise(F.col(under)))
    rest = F.regexp_extract("path", "^[^/]*/(.+)$", 1)
    joined = spots.withColumn(prefix, F.when(rest != "", F.regexp_extract("path", "^([^/]*)/", 1))).join(dim, ["os", "variant", prefix], "left")
    base = F.replace(F.replace(F.col(under), F.lit("{home}"), F.lit(home)), F.lit("{app}"), F.coalesce("sandbox", F.lit("")))
    return joined.select(*spots.columns, F.when(F.lit(home != "") & (rest != ""), F.concat(base, F.lit("/"), rest)).alias("abs"))


def config_on_disk(db: AppDb, apps: DataFrame, existing: DataFrame, *, os: str, home: str, env: dict[str, str] | None = None) -> DataFrame:
    """(app_id, key, variant, abs, is_dir) for each location of any application that exists: the native one and those of sandboxes seen.

    ``apps``: app_id, via, package of the sources found here.
    """
    native = db.locations.where(F.col("os") == os).select("app_id", "os", "key", "path", F.lit("").alias("variant"), F.lit("").alias("sandbox"))
    boxes = apps.where(F.col("via").isin("flatpak", "snap")).select("app_id", F.col("via").alias("variant"), F.when(F.col("via") == "snap", F.substring_index("package", " ", 1)).otherwise(F.col("package")).alias("sandbox")).distinct()
    boxed = db.locations.where(F.col("os") == os).join(boxes, "app_id").select("app_id", "os", "key", "path", "variant", "sandbox")
    found = resolve(native.unionByName(boxed), home=home, env=env)
    return found.join(existing.select(F.col("path").alias("abs"), "is_dir"), "abs").select("app_id", "key", "variant", "abs", "is_dir")


def config_filter(files: DataFrame, locations: DataFrame, db: AppDb) -> DataFrame:
    """Drops files that their location's application excludes. locations: app_id, abs. The longest location that holds a file decides."""
    mine = files.select("path").distinct().withColumn("_up", F.explode(paths.ancestors(F.col("path"))))
    held = mine.join(locations.select("app_id", F.col("abs").alias("_up")), "_up").groupBy("path").agg(F.max(F.struct(F.length("_up").alias("n"), F.col("_up").alias("up"), F.col("app_id").alias("app_id"))).alias("b"))
    inside = held.select("path", "b.app_id", paths.under(F.col("path"), F.col("b.up")).alias("rel")).where("rel <> '.'")
    gone = excluded(inside, db).where("excluded").select("path").distinct()
    return files.join(gone, "path", "left_anti")


def excluded(rels: DataFrame, db: AppDb) -> DataFrame:
    """Adds ``excluded`` to (app_id, rel): a pattern with a slash matches the whole path, one without any segment, in any case."""
    rel = F.lower(F.regexp_replace(F.translate("rel", "\\", "/"), "^/+|/+$", ""))
    pats, mine = local.free(rels, "pats", "rel")
    regex = db.excludes.select("app_id", paths.glob_regex(F.lower("pattern")).alias("re"), F.col("pattern").contains("/").alias("whole")).where(paths.glob_valid(F.col("pattern")))
    lists = regex.groupBy("app_id").agg(F.collect_list(F.struct("re", "whole")).alias(pats))  # an entry has a few patterns
    rows = rels.withColumn(mine, rel).join(lists, "app_id", "left")
    hit = F.exists(pats, lambda p: F.when(p["whole"], F.rlike(F.col(mine), p["re"])).otherwise(F.exists(F.split(mine, "/"), lambda s: F.rlike(s, p["re"]))))
    return rows.select(*rels.columns, F.coalesce(hit, F.lit(False)).alias("excluded"))
