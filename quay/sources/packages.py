"""Installed software from the files and outputs of package managers.

Every parser takes a DataFrame of raw text and returns sightings: via, package, version, name, desktop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quay.functions import fixed, local

SIGHTING = ("via", "package", "version", "name", "desktop")


def is_desktop_entry(path: Column) -> Column:
    return F.regexp_replace(path, "^/", "").rlike(r"(?s)^usr/share/applications/.*\.desktop$")


def has_desktop(text: Column) -> Column:
    """Whether a file list, one path a line, has a desktop entry."""
    return F.coalesce(F.exists(F.split(text, r"\r?\n"), lambda line: is_desktop_entry(F.trim(line))), F.lit(False))


def _rows(df: DataFrame, via: Column, package: Column, version: Column | None = None, name: Column | None = None, desktop: Column | None = None) -> DataFrame:
    empty = F.lit(None).cast("string")
    blank = lambda c: empty if c is None else F.nullif(c, F.lit(""))
    return df.select(via.alias("via"), package.alias("package"), blank(version).alias("version"), blank(name).alias("name"), (F.lit(False) if desktop is None else desktop).alias("desktop"))


def _field(text: Column, key: str) -> Column:
    """The last ``key: value`` line of a stanza."""
    return F.trim(F.coalesce(F.element_at(F.regexp_extract_all(text, F.lit(rf"(?m)^{key}:([^\n]*)$"), F.lit(1)), -1), F.lit("")))


def stanzas(files: DataFrame) -> DataFrame:
    """Text files (text) as their blank-line separated stanzas (stanza, n)."""
    return files.select(F.posexplode(F.split("text", r"\r?\n(?:\r?\n)+")).alias("n", "stanza")).where(F.trim("stanza") != "")


def pacman(descs: DataFrame) -> DataFrame:
    """descs: text of ``desc``, files (text of ``files`` or null)."""
    section = lambda s: F.trim(F.regexp_extract("text", rf"(?m)^\s*%{s}%\s*\n[ \t]*([^\s][^\n]*)$", 1))
    return _rows(descs.withColumns({"_p": section("NAME"), "_v": section("VERSION"), "_d": has_desktop(F.col("files"))}).where("_p <> ''"), F.lit("pacman"), F.col("_p"), F.col("_v"), None, F.col("_d"))


def dpkg(status: DataFrame, lists: DataFrame) -> DataFrame:
    """status: text. lists: file (name of a file list), text. Of a package's lists the plain one counts, else the first architecture's."""
    found = stanzas(status).select(_field(F.col("stanza"), "Package").alias("package"), _field(F.col("stanza"), "Version").alias("version"), _field(F.col("stanza"), "Status").alias("status"))
    installed = found.where("package <> '' and status like '% installed'")
    endings = [".list", ":amd64.list", ":arm64.list", ":i386.list", ":all.list"]
    rank = F.lit(None).cast("int")
    owner = F.lit(None).cast("string")
    for i, e in enumerate(endings):
        mine = F.endswith("file", F.lit(e)) & ~F.substring_index("file", ".list", 1).contains(":") if i == 0 else F.endswith("file", F.lit(e))
        rank, owner = F.when(mine, i).otherwise(rank), F.when(mine, F.expr(f"substring(file, 1, length(file) - {len(e)})")).otherwise(owner)
    best = lists.withColumns({"_rank": rank, "package": owner}).where("_rank is not null").groupBy("package").agg(F.min_by(has_desktop(F.col("text")), "_rank").alias("_d"))
    return _rows(installed.join(best, "package", "left"), F.lit("apt"), F.col("package"), F.col("version"), None, F.coalesce("_d", F.lit(False)))


def apk(installed: DataFrame) -> DataFrame:
    """installed: text. A file line belongs to the folder line before it."""
    lines = F.split("stanza", r"\r?\n")
    folded = F.aggregate(
        lines,
        F.struct(F.lit("").alias("dir"), F.lit(False).alias("hit")),
        lambda acc, x: F.struct(
            F.when(x.startswith("F:"), F.substring(x, 3, 1 << 20)).otherwise(acc["dir"]).alias("dir"),
            (acc["hit"] | (x.startswith("R:") & is_desktop_entry(F.concat(acc["dir"], F.lit("/"), F.substring(x, 3, 1 << 20))))).alias("hit"),
        ),
        lambda acc: acc["hit"],
    )
    one = lambda k: F.coalesce(F.element_at(F.regexp_extract_all("stanza", F.lit(rf"(?m)^{k}:([^\n]*)$"), F.lit(1)), -1), F.lit(""))
    rows = stanzas(installed).withColumns({"_p": one("P"), "_v": one("V"), "_d": folded}).where("_p <> ''")
    return _rows(rows, F.lit("apk"), F.col("_p"), F.col("_v"), None, F.col("_d"))


def rpm(lines: DataFrame, owners: DataFrame, via: Column) -> DataFrame:
    """lines: text, ``name<TAB>version``; owners: name, of packages with desktop entries."""
    rows = lines.select(F.trim(F.substring_index("text", "\t", 1)).alias("package"), F.trim(F.when(F.instr("text", "\t") > 0, F.regexp_extract("text", r"\t(.*)$", 1)).otherwise("")).alias("version")).where("package <> ''")
    marked = rows.join(owners.select(F.trim("name").alias("package"), F.lit(True).alias("_d")).distinct(), "package", "left")
    return _rows(marked, via, F.col("package"), F.col("version"), None, F.coalesce("_d", F.lit(False)))


def flatpak(dirs: DataFrame) -> DataFrame:
    """dirs: ord (of the search path), name. An id has a dot; the first folder wins."""
    return _rows(dirs.where(F.col("name").contains(".")).select("name").distinct(), F.lit("flatpak"), F.col("name"))


def snap(dirs: DataFrame) -> DataFrame:
    """dirs: ord, name, yaml (text of snap.yaml or null). Only the first search path that has any snap counts."""
    runtime = F.col("name").isin(*fixed.SNAP_NAMES)
    for p in fixed.SNAP_PREFIXES:
        runtime = runtime | F.col("name").startswith(p)
    rows = dirs.where(~runtime & ~F.col("name").startswith("."))
    first = rows.agg(F.min("ord").alias("ord"))
    version = F.regexp_replace(F.trim(F.regexp_extract("yaml", r"(?m)^\s*version:([^\n]*)$", 1)), "^[\"']+|[\"']+$", "")
    return _rows(rows.join(F.broadcast(first), "ord"), F.lit("snap"), F.col("name"), version)


def uninstall_keys(keys: DataFrame) -> DataFrame:
    """keys: ord, DisplayName, DisplayVersion, SystemComponent, ParentKeyName, ReleaseType. Equal names and versions once, the first."""
    name = F.trim(F.coalesce("DisplayName", F.lit("")))
    shown = (name != "") & (F.coalesce("SystemComponent", F.lit(0)) != 1) & (F.coalesce("ParentKeyName", F.lit("")) == "")
    shown = shown & ~F.coalesce("ReleaseType", F.lit("")).isin("Update", "Hotfix", "Security Update") & ~name.rlike("^(KB|Update for|Security Update for|Hotfix for)")
    rows = keys.where(shown).withColumns({"_n": name, "_v": F.trim(F.coalesce("DisplayVersion", F.lit("")))})
    once = rows.groupBy(F.lower("_n").alias("_a"), F.lower("_v").alias("_b")).agg(F.min_by(F.struct("_n", "_v"), "ord").alias("s"))
    return _rows(once, F.lit("registry"), F.col("s._n"), F.col("s._v"), F.col("s._n"))


def winget(exports: DataFrame) -> DataFrame:
    """exports: text of ``winget export``."""
    kind = "Sources array<struct<Packages: array<struct<PackageIdentifier: string, Version: string>>>>"
    packed = exports.select(F.explode(F.from_json("text", kind)["Sources"]).alias("s")).select(F.explode("s.Packages").alias("p"))
    return _rows(packed.where("p.PackageIdentifier <> ''"), F.lit("winget"), F.col("p.PackageIdentifier"), F.col("p.Version"))


def scoop(dirs: DataFrame) -> DataFrame:
    """dirs: name, install, manifest (JSON texts or null)."""
    bucket = F.get_json_object("install", "$.bucket")
    package = F.when(F.coalesce(bucket, F.lit("")) != "", F.concat(bucket, F.lit("/"), F.col("name"))).otherwise(F.col("name"))
    return _rows(dirs.where("name <> 'scoop'"), F.lit("scoop"), package, F.get_json_object("manifest", "$.version"))


def choco(dirs: DataFrame) -> DataFrame:
    """dirs: name, nuspec (text or null)."""
    return _rows(dirs, F.lit("choco"), F.col("name"), F.trim(F.regexp_extract("nuspec", "<version>([^<]+)</version>", 1)))


def settings(lines: DataFrame) -> DataFrame:
    """``KEY=value`` lines (n, text) as key, value: comments are passed over, quotes go, the last of a key wins."""
    key, value = F.trim(F.substring_index("text", "=", 1)), F.regexp_replace(F.trim(F.regexp_extract("text", "=(.*)$", 1)), "^\"|\"$|^'|'$", "")
    rows = lines.where(F.col("text").contains("=") & ~F.trim("text").startswith("#")).select("n", key.alias("key"), value.alias("value"))
    return rows.groupBy("key").agg(F.max_by("value", "n").alias("value"))


def user_dirs(lines: DataFrame, home: str) -> DataFrame:
    """XDG user folders: kind, path."""
    found = settings(lines).where(F.col("key").rlike("^XDG_[A-Z]+_DIR$"))
    return found.select(F.lower(F.regexp_extract("key", "^XDG_([A-Z]+)_DIR$", 1)).alias("kind"), F.regexp_replace("value", r"^\$HOME", home).alias("path"))


def family(ids: DataFrame) -> DataFrame:
    """ids: pos, id (the distribution, then what it is like). One row: the first family that any names, null if none."""
    dim = local.table(ids.sparkSession, [(i, f) for f, names in fixed.FAMILIES.items() for i in names.split()], "id string, family string")
    return ids.select("pos", F.lower("id").alias("id")).join(dim, "id").agg(F.min_by("family", "pos").alias("family"))
