"""Application database: a folder of JSON entries as relations, with all problems as rows.

Relations: ``apps`` (app_id, name, category, homepage, portability, windows, linux), ``packages`` (app_id, os, manager, ord, package, key),
``names`` (app_id, ord, name), ``locations`` (app_id, os, key, path), ``equivalents`` (app_id, ord, equivalent), ``excludes`` (app_id, pattern).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quay.functions import fixed, local, paths

PLATFORM = "struct<" + ", ".join(f"{m}: array<string>" for m in fixed.MANAGERS) + ", paths: map<string, string>>"
SCHEMA = f"id string, name string, summary string, category string, homepage string, license string, windows {PLATFORM}, linux {PLATFORM}, config struct<portability: string, exclude: array<string>, notes: string>, equivalents array<string>"


@dataclass
class AppDb:
    apps: DataFrame
    packages: DataFrame
    names: DataFrame
    locations: DataFrame
    equivalents: DataFrame
    excludes: DataFrame
    raw: DataFrame


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of a folder; ``file`` is the file's name without its ending."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).json(folder)
    return rows.withColumn("file", F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1))


#: The fields that an entry, its platforms and its configuration may have.
FIELDS = {
    "": ("id", "name", "summary", "category", "homepage", "license", "windows", "linux", "config", "equivalents"),
    "windows": (*fixed.MANAGERS, "paths"), "linux": (*fixed.MANAGERS, "paths"), "config": ("portability", "exclude", "notes"),
}


def unknown_in(texts: DataFrame) -> DataFrame:
    """(file, field) for fields of entries (file, text) that no entry has, at any level."""
    out = []
    for part, known in FIELDS.items():
        inside = F.col("text") if not part else F.get_json_object("text", f"$.{part}")
        keys = F.explode(F.map_keys(F.from_json(inside, "map<string, string>"))).alias("field")
        named = F.concat(F.lit(f"{part}." if part else ""), F.col("field"))
        out.append(texts.select("file", keys).where(~F.col("field").isin(*known)).select("file", named.alias("field")))
    joined = out[0]
    for x in out[1:]:
        joined = joined.unionByName(x)
    return joined


def unknown_fields(spark: SparkSession, folder: str) -> DataFrame:
    """(file, field) of ``unknown_in`` for the entries of a folder."""
    return unknown_in(read_texts(spark, folder))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text) of a folder's entries; ``file`` is the file's name without its ending."""
    return spark.read.text(folder, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("file"), F.col("value").alias("text"))


def from_json(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Entries from JSON strings."""
    rows = local.table(spark, [(t,) for t in texts], "value string").select(F.from_json("value", SCHEMA).alias("e")).select("e.*")
    return rows.withColumn("file", F.col("id"))


#: A relation of at most so many rows is pinned as a constant table.
PINNED_ROWS = 20_000


def pinned(db: AppDb) -> AppDb:
    """The database with its small relations as constants, so that plans over it stay short; larger ones stay as they are."""

    def pin(df: DataFrame) -> DataFrame:
        rows = df.limit(PINNED_ROWS + 1).collect()
        return df if len(rows) > PINNED_ROWS else local.table(df.sparkSession, [tuple(r) for r in rows], ", ".join(f"{n} {k}" for n, k in df.dtypes))

    return AppDb(*map(pin, (db.apps, db.packages, db.names, db.locations, db.equivalents, db.excludes)), raw=db.raw)


def package_key(manager: Column, package: Column) -> Column:
    """How managers compare identifiers: in lower case, a snap's without its flags."""
    return F.lower(F.when(manager == "snap", F.substring_index(package, " ", 1)).otherwise(package))


def normalise(raw: DataFrame) -> AppDb:
    per_os = [raw.where(F.col(os).isNotNull()).select(F.col("id").alias("app_id"), F.lit(os).alias("os"), F.col(os).alias("p")) for os in ("windows", "linux")]
    platforms = per_os[0].unionByName(per_os[1])
    lists = F.array(*[F.struct(F.lit(m).alias("manager"), F.col(f"p.{m}").alias("ids")) for m in fixed.MANAGERS])
    listed = platforms.select("app_id", "os", F.explode(lists).alias("l")).select("app_id", "os", "l.manager", F.posexplode("l.ids").alias("ord", "package"))
    packages = listed.where("manager <> 'registry'").withColumn("key", package_key(F.col("manager"), F.col("package")))
    names = listed.where("manager = 'registry'").select("app_id", "ord", F.lower("package").alias("name"))
    return AppDb(
        apps=raw.select(F.col("id").alias("app_id"), "name", "category", "homepage", F.col("config.portability").alias("portability"), F.col("windows").isNotNull().alias("windows"), F.col("linux").isNotNull().alias("linux")),
        packages=packages,
        names=names,
        locations=platforms.select("app_id", "os", F.explode("p.paths").alias("key", "path")),
        equivalents=raw.select(F.col("id").alias("app_id"), F.posexplode("equivalents").alias("ord", "equivalent")),
        excludes=raw.select(F.col("id").alias("app_id"), F.explode("config.exclude").alias("pattern")),
        raw=raw,
    )


def problems(db: AppDb) -> DataFrame:
    """(app_id, code, detail) for every rule an entry breaks."""
    raw, spot = db.raw, F.col("id").alias("app_id")
    good_id = r"^[a-z0-9][a-z0-9-]{0,63}$"
    out: list[DataFrame] = []

    def rows(df: DataFrame, code: str, detail: Column | None = None) -> None:
        out.append(df.select("app_id", F.lit(code).alias("code"), (F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit(""))).alias("detail")))

    no = lambda c: F.coalesce(~c, F.lit(True))
    tops = raw.select(spot, "*")
    rows(tops.where(no(F.col("id").rlike(good_id))), "id-form", F.col("id"))
    rows(tops.where(F.col("file") != F.col("id")), "id-file", F.col("file"))
    rows(tops.where(F.trim(F.coalesce("name", F.lit(""))) == ""), "no-name")
    rows(tops.where(no(F.col("category").isin(*fixed.CATEGORIES))), "category", F.col("category"))
    rows(tops.where((F.coalesce("homepage", F.lit("")) != "") & ~F.col("homepage").rlike("^https?://")), "homepage", F.col("homepage"))
    rows(tops.where("windows is null and linux is null"), "no-platform")
    rows(tops.where(no(F.col("config.portability").isin(*fixed.PORTABILITIES))), "portability", F.col("config.portability"))
    owner = F.create_map(*[F.lit(x) for m in fixed.MANAGERS.items() for x in m])
    every = db.packages.select("app_id", "os", "manager", "ord", "package").unionByName(
        _registry(raw).select("app_id", "os", "manager", "ord", "package")
    )
    rows(every.where(owner[F.col("manager")] != F.col("os")).select("app_id", "manager").distinct(), "manager-platform", F.col("manager"))
    rows(every.where((F.trim("package") == "") | (F.trim("package") != F.col("package"))), "package-blanks", F.concat_ws(":", "manager", "package"))
    rows(every.where(~F.col("manager").isin("snap", "registry") & F.col("package").rlike("[ \t]")), "package-spaces", F.concat_ws(":", "manager", "package"))
    for os in ("windows", "linux"):
        sizes = [F.coalesce(F.size(F.col(f"{os}.{m}")), F.lit(0)) for m in fixed.MANAGERS]
        empty = sum((F.when(s > 0, 1).otherwise(0) for s in sizes), F.lit(0)) + F.when(F.size(F.coalesce(F.map_keys(f"{os}.paths"), F.array().cast("array<string>"))) > 0, 1).otherwise(0)
        rows(tops.where(F.col(os).isNotNull() & (empty == 0)), "empty-section", F.lit(os))
    spots = db.locations
    rows(spots.where(~F.col("key").rlike(good_id)), "path-key", F.col("key"))
    prefix = {"linux": r"^(~|\$XDG_(CONFIG|DATA|STATE)_HOME)/.", "windows": r"^%(APPDATA|LOCALAPPDATA|USERPROFILE)%/."}
    rows(spots.where(~F.when(F.col("os") == "linux", F.col("path").rlike(prefix["linux"])).otherwise(F.col("path").rlike(prefix["windows"]))), "path-prefix", F.col("path"))
    rows(spots.where(F.col("path").rlike(r"\\|//|/$|/\.\.?/")), "path-form", F.col("path"))
    count = spots.groupBy("app_id").agg(F.count(F.lit(1)).alias("n"))
    held = db.apps.join(count, "app_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows(held.where("portability = 'none' and n > 0"), "none-with-paths")
    rows(held.where("portability <> 'none' and n = 0"), "paths-missing")
    both = spots.groupBy("app_id").agg(F.count_distinct("os").alias("systems"))
    shared = spots.groupBy("app_id", "key").agg(F.count_distinct("os").alias("n")).where("n = 2").select("app_id").distinct()
    rows(db.apps.where("portability = 'identical'").join(both.where("systems = 2"), "app_id").join(shared, "app_id", "left_anti"), "no-shared-key")
    rows(db.excludes.where("pattern = '' or pattern like '/%' or pattern like '%/'"), "exclude-form", F.col("pattern"))
    rows(db.excludes.where(~paths.glob_valid(F.col("pattern"))), "exclude-glob", F.col("pattern"))
    rows(db.equivalents.where("equivalent = app_id"), "own-equivalent")
    rows(db.equivalents.groupBy("app_id", "equivalent").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "equivalent-twice", F.col("equivalent"))
    rows(db.equivalents.join(db.apps.select(F.col("app_id").alias("equivalent")), "equivalent", "left_anti").select("app_id", "equivalent").distinct(), "equivalent-unknown", F.col("equivalent"))
    first = db.packages.groupBy("manager", "key").agg(F.min("app_id").alias("first"))
    claimed = db.packages.join(first, ["manager", "key"]).where("app_id <> first").select("app_id", "manager", "key").distinct()
    rows(claimed, "package-claimed", F.concat_ws(":", "manager", "key"))
    joined = out[0]
    for x in out[1:]:
        joined = joined.unionByName(x)
    return joined


def _registry(raw: DataFrame) -> DataFrame:
    parts = [raw.where(F.col(os).isNotNull()).select(F.col("id").alias("app_id"), F.lit(os).alias("os"), F.lit("registry").alias("manager"), F.posexplode(f"{os}.registry").alias("ord", "package")) for os in ("windows", "linux")]
    return parts[0].unionByName(parts[1])


def load_folder(spark: SparkSession, folder: str, *, strict: bool = True) -> AppDb:
    """The database in a folder of JSON files; fields that no entry has are problems too."""
    return load(read(spark, folder), strict=strict, unknown=unknown_fields(spark, folder))


def load(raw: DataFrame, *, strict: bool = True, unknown: DataFrame | None = None) -> AppDb:
    """The database; with any problem ``strict`` refuses it, otherwise links to missing entries are left out."""
    db = normalise(raw)
    if strict:
        rows = problems(db)
        if unknown is not None:
            rows = rows.unionByName(unknown.select(F.col("file").alias("app_id"), F.lit("unknown-field").alias("code"), F.col("field").alias("detail")))
        found = rows.limit(20).collect()
        if found:
            raise ValueError("; ".join(f"{r.app_id}: {r.code} {r.detail}".strip() for r in found))
    else:
        db.equivalents = db.equivalents.join(db.apps.select(F.col("app_id").alias("equivalent")), "equivalent", "left_semi").select("app_id", "ord", "equivalent")
    return db


#: Six invented entries to try things with.
SAMPLE = [
    '{"id":"heron","name":"Heron Browser","summary":"A browser","license":"MIT","category":"browser","windows":{"winget":["Quill.Heron"],"registry":["Heron Browser"],"paths":{"profiles":"%APPDATA%/Quill/Heron"}},"linux":{"pacman":["heron"],"apt":["heron","heron-lts"],"flatpak":["org.quill.heron"],"paths":{"profiles":"~/.heron/main"}},"config":{"portability":"identical","exclude":["cache2"]}}',
    '{"id":"lark","name":"Lark","category":"media-player","windows":{"winget":["Meadow.Lark"],"registry":["Lark media player"],"paths":{"config":"%APPDATA%/lark"}},"linux":{"pacman":["lark"],"apt":["lark"],"paths":{"config":"$XDG_CONFIG_HOME/lark"}},"config":{"portability":"translatable"}}',
    '{"id":"scribble-plus","name":"Scribble+","category":"editor","windows":{"winget":["Scribble.Plus"],"registry":["Scribble+"],"paths":{"config":"%APPDATA%/Scribble+"}},"config":{"portability":"untranslatable"},"equivalents":["kestrel"]}',
    '{"id":"kestrel","name":"Kestrel","category":"editor","windows":{"winget":["Fen.Kestrel"]},"linux":{"pacman":["kestrel"],"apt":["kestrel"],"flatpak":["org.fen.kestrel"],"paths":{"config":"$XDG_CONFIG_HOME/kestrel"}},"config":{"portability":"identical"}}',
    '{"id":"warble","name":"Warble","category":"music","windows":{"winget":["Warble.Warble"]},"linux":{"flatpak":["com.warble.Client"],"snap":["warble"]},"config":{"portability":"none"}}',
    '{"id":"rook","name":"Rook","category":"vcs","windows":{"winget":["Rook.Rook"],"registry":["Rook"],"paths":{"rookconfig":"%USERPROFILE%/.rookconfig"}},"linux":{"pacman":["rook"],"apt":["rook"],"paths":{"rookconfig":"~/.rookconfig"}},"config":{"portability":"identical"}}',
]
