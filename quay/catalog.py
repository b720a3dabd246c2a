"""All registered queries outside the training-data operators, with their DuckDB SQL.

The driver's tables hold no file trees, so ``documents`` is read as an inventory: one file per document, in one of eight folders and with one of eleven
endings by doc_id; its size is the text's bytes, its hash the text's SHA-256. ``events`` stands for journals, sightings of software and command runs,
``pages`` for paths.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quay.functions import codecs, local, paths
from quay.operators import inventory, pack, restore, roots, verify
from quay.operators.staged import staged
from quay.plans import detect, migrate
from quay.sources import appdb

FOLDERS = ["Documents", "Documents/Photos", "proj/node_modules/p", ".ssh", "Downloads", "proj/.git/objects", ".config/app", "proj/Src"]
ENDINGS = [".txt", ".JPG", ".tar.gz", ".json.bak", "", ".so", ".xyzzy", ".pem", ".docx", ".env", ".md"]
ROOTS = [("documents", "/home/u/Documents"), ("pictures", "/home/u/Documents/Photos"), ("config", "/home/u/.config"), ("apps/demo/settings", "/home/u/.config/app")]
BLOCK = 4096
VOLUME, RESERVE = 200_000, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The virtual inventory: seq, path, size, sha256, text."""
    docs = table(spark, sf_dir, "documents")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.pmod("doc_id", F.lit(n)) + 1).cast("int"))
    path = F.concat(F.lit("/home/u/"), pick(FOLDERS, 8), F.lit("/f"), F.col("doc_id").cast("string"), pick(ENDINGS, 11))
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").alias("seq"), path.alias("path"), F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("sha256"), text.alias("text"))


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.scanned(files(spark, sf_dir).select("seq", "path", "size"), root="/home/u")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory summary and the estimate at every level."""
    return estimate_levels(spark, sf_dir)


# -- inventory -----------------------------------------------------------------------------------------------------------


def file_classes(spark, sf_dir):
    return inventory.classify(files(spark, sf_dir).select("seq", "path")).select("seq", "class")


def class_buckets(spark, sf_dir):
    return inventory.by_class(scan(spark, sf_dir))


def skipped_by_rule(spark, sf_dir):
    return inventory.skipped(scan(spark, sf_dir))


def secret_buckets(spark, sf_dir):
    return inventory.secret_bucket(scan(spark, sf_dir))


def largest_files(spark, sf_dir):
    return inventory.largest(scan(spark, sf_dir)).select("seq", "path", "size", "class")


def composition(spark, sf_dir):
    found = inventory.composition(inventory.by_class(scan(spark, sf_dir)))
    return found.select("class", "files", "bytes", F.round("percent", 6).alias("percent"))


def estimate_levels(spark, sf_dir):
    return inventory.fits(inventory.estimate(inventory.by_class(scan(spark, sf_dir)), workers=8), 10**9)


def human_sizes(spark, sf_dir):
    rows = files(spark, sf_dir).select("seq", "size")
    return rows.select("seq", paths.human_bytes(F.col("size")).alias("shown"), paths.human_count(F.col("size")).alias("counted"))


# -- roots ---------------------------------------------------------------------------------------------------------------


def root_dim(spark: SparkSession) -> DataFrame:
    return local.table(spark, ROOTS, "root string, root_path string")


def root_split(spark, sf_dir):
    return roots.split_roots(files(spark, sf_dir).select("seq", "path"), root_dim(spark)).select("seq", "root", "rel")


def root_join(spark, sf_dir):
    split = roots.split_roots(files(spark, sf_dir).select("seq", "path"), root_dim(spark)).select("seq", "root", "rel")
    return roots.join_roots(split, root_dim(spark), home="/home/u").select("seq", "dest")


def root_summary(spark, sf_dir):
    split = roots.split_roots(pack.dedup(files(spark, sf_dir).drop("text")), root_dim(spark))
    return roots.root_summary(split)


# -- package layout --------------------------------------------------------------------------------------------------------


def package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    classed = inventory.classify(files(spark, sf_dir).drop("text"))
    return pack.dedup(classed).withColumn("compressible", F.col("class").isin("text", "binary"))


def file_dedup(spark, sf_dir):
    return pack.dedup(files(spark, sf_dir).drop("text")).select("seq", "dup", "original")


def same_size_files(spark, sf_dir):
    return pack.same_size(files(spark, sf_dir).select("seq", "size")).select("seq", "size")


def dedup_savings(spark, sf_dir):
    return pack.saved(pack.dedup(files(spark, sf_dir).drop("text")))


def solid_parts(spark, sf_dir):
    return pack.solid_parts(package_files(spark, sf_dir), BLOCK)


def stored_parts(spark, sf_dir):
    return pack.stored_parts(package_files(spark, sf_dir), BLOCK)


def block_ids(spark, sf_dir):
    return pack.layout(package_files(spark, sf_dir), BLOCK)[0]


def block_parts(spark, sf_dir):
    return pack.layout(package_files(spark, sf_dir), BLOCK)[1].select("seq", "block_id", "off", "len", F.col("n").cast("long").alias("n"))


def located(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    blocks, parts = map(staged, pack.layout(package_files(spark, sf_dir), BLOCK))
    return blocks, parts, pack.volumes(blocks, parts, volume_size=VOLUME, reserve=RESERVE)


def volume_fold(spark, sf_dir):
    return located(spark, sf_dir)[2]


def volume_summary(spark, sf_dir):
    blocks, _, where = located(spark, sf_dir)
    return pack.volume_table(blocks, where)


def needed_volumes(spark, sf_dir):
    _, parts, where = located(spark, sf_dir)
    return pack.needed_volumes(parts, where, files(spark, sf_dir).where(F.startswith("path", F.lit("/home/u/Documents/Photos/"))).select("seq"))


def placed_files(spark, sf_dir):
    _, parts, where = located(spark, sf_dir)
    return pack.placed(files(spark, sf_dir).select("seq", "size"), parts, where.where("volume <> 2"))


def volume_index(spark, sf_dir):
    _, parts, where = located(spark, sf_dir)
    return pack.in_volume(files(spark, sf_dir).select("seq"), parts, where)


# -- integrity -------------------------------------------------------------------------------------------------------------


def sums_check(spark, sf_dir):
    rows = files(spark, sf_dir).select("seq", F.col("path").alias("name"), "sha256")
    sums = rows.where("seq % 13 <> 0").select("name", "sha256")
    now = rows.where("seq % 7 <> 3").select("name", F.when(F.col("seq") % 11 == 0, F.upper("sha256")).when(F.col("seq") % 17 == 0, F.lit(None)).otherwise(F.col("sha256")).alias("sha256"))
    return verify.check_sums(sums, now)


#: Lines that are no journal lines, though the third is JSON and the others nearly.
TORN = ['{"t":"vol', '{"t":5}', "5", '{"t":"volume","n":-1}', '{"t":"volume","at":"yesterday"}']


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each event, blank ones and, late, broken ones among them."""
    n = F.col("event_id")
    broken = F.element_at(F.array(*map(F.lit, TORN)), (n % len(TORN) + 1).cast("int"))
    whole = F.concat(F.lit('{"t":"'), "event_type", F.lit('","n":'), n.cast("string"), F.lit(',"extra":[1],"at":"2024-01-02T03:04:05Z"}'))
    return table(spark, sf_dir, "events").select(n.alias("line"), F.when(n % 4001 == 4000, broken).when(n % 10 == 3, "  ").otherwise(whole).alias("text"))


def missing_volumes(spark, sf_dir):
    volumes = table(spark, sf_dir, "events").select(F.col("event_id").alias("volume"))
    sums = volumes.where("volume % 50 <> 7").select(F.format_string("volumes/%05d.vol", "volume").alias("name"))
    return verify.missing_volumes(volumes, sums).select("volume", "name")


def torn_journal(spark, sf_dir):
    return verify.journal_prefix(journal(spark, sf_dir))


def trailer_check(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("volume")).agg(F.count(F.lit(1)).alias("in_stream"))
    rows = rows.withColumn("in_trailer", F.when(F.col("volume") % 9 == 0, F.col("in_stream") + 1).otherwise(F.col("in_stream")))
    found = verify.check_trailers(rows, rows.where("volume % 10 <> 1").select("volume", F.col("in_stream").alias("in_index")))
    return found.withColumn("in_index", F.coalesce("in_index", F.lit(-1).cast("long")))


def reassembly(spark, sf_dir):
    mine = package_files(spark, sf_dir)
    _, parts = pack.layout(mine, BLOCK)
    texts = files(spark, sf_dir).select("seq", F.encode("text", "UTF-8").alias("data"))
    first = F.expr("coalesce(sum(len) over (partition by seq order by n rows between unbounded preceding and 1 preceding), 0)")
    cut = parts.withColumn("_at", first).join(mine.where("not dup").select("seq"), "seq", "left_semi").join(texts, "seq")
    bytes_ = cut.select("block_id", "off", F.expr("substring(data, cast(_at + 1 as int), cast(len as int))").alias("piece"))
    # a block is at most BLOCK bytes
    blocks = bytes_.groupBy("block_id").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", F.hex("piece").alias("h")))), lambda x: x["h"]), "")).alias("data"))
    lost = blocks.where("block_id % 97 <> 5").withColumn("data", F.when(F.col("block_id") % 89 == 3, F.unhex(F.regexp_replace(F.hex("data"), "^..", "00"))).otherwise(F.col("data")))
    return verify.reassemble(parts, lost, mine)


def codec_round_trip(spark, sf_dir):
    rows = files(spark, sf_dir).select(F.col("seq").alias("block_id"), F.encode("text", "UTF-8").alias("d"), F.col("size").alias("raw"), "sha256", F.element_at(F.array(*map(F.lit, codecs.CODECS)), (F.pmod("seq", F.lit(4)) + 1).cast("int")).alias("codec"))
    stored = rows.withColumn("stored", codecs.compress("codec", "d")).drop("d")
    return verify.decode_blocks(stored).select("block_id", "codec", "raw", "ok")


def entropy_class(spark, sf_dir):
    sample = F.encode(F.substring("text", 1, codecs.SAMPLE), "UTF-8")
    return files(spark, sf_dir).select("seq", codecs.compressible(sample).alias("compressible"))


# -- restore ---------------------------------------------------------------------------------------------------------------


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that meet on a system without case: f12.TXT, F12.txt and so on, also with illegal characters."""
    kind = F.pmod("seq", F.lit(5))
    name = F.when(kind == 0, "Report: final?.docx").when(kind == 1, "report: FINAL?.docx").when(kind == 2, "con.txt").when(kind == 3, "notes. ").otherwise("a<b>|c.md")
    root = F.element_at(F.array(*map(F.lit, ["documents", "pictures", "downloads", "other"])), (F.pmod("seq", F.lit(4)) + 1).cast("int"))
    path = F.concat(F.lit("d"), F.expr("seq div 40").cast("string"), F.lit("/x"), F.expr("seq % 3").cast("string"), F.lit("/"), name, F.when(F.col("seq") % 2 == 0, "").otherwise("~"))
    return files(spark, sf_dir).select(root.alias("root"), F.concat(path, F.lit("/"), F.expr("seq div 20").cast("string"), F.when(F.expr("seq % 20 < 10"), ".Txt").otherwise(".txt")).alias("path"), "size").distinct()


def sanitized(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.select("page_id", paths.sanitize(F.col("url"), F.lit("windows")).alias("windows"), paths.sanitize(F.col("url"), F.lit("linux")).alias("linux"), paths.with_suffix(F.col("url"), F.lit(" (2)")).alias("suffixed"))


def restore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = local.table(spark, [("documents", "/home/u/Documents"), ("pictures", "/home/u/Pictures")], "root string, root_path string")
    there = entries(spark, sf_dir).where("root = 'documents' and size % 3 = 0").select(F.concat(F.lit("/home/u/Documents/"), "path").alias("path"), (F.col("size") % 2 == 0).alias("is_dir")).groupBy("path").agg(F.max("is_dir").alias("is_dir"))
    return restore.plan(entries(spark, sf_dir), here, there, os="linux", home="/home/u")


def conflict_actions(spark, sf_dir):
    return restore_plan(spark, sf_dir).select("root", "path", "to_root", "dest", "action", "renamed", "exists", "note")


def restore_totals(spark, sf_dir):
    return restore.totals(restore_plan(spark, sf_dir))


def restore_roots(spark, sf_dir):
    return restore.root_totals(restore_plan(spark, sf_dir))


def collision_rename(spark, sf_dir):
    here = local.table(spark, [("documents", "/d"), ("pictures", "/p"), ("downloads", "/w")], "root string, root_path string")
    return restore.resolved(restore.adapted(entries(spark, sf_dir), here, "windows"), "windows").select("root", "path", "clean", "final")


# -- applications ------------------------------------------------------------------------------------------------------------

TITLES = ["Heron Browser (x64 de)", "RookHub Bench", "Rook", "Lark media player", "Scribble+ (64-bit)", "Microsoft Visual C++ 2019 x64", "Rookery"]
PACKAGES = [("pacman", "heron"), ("apt", "Heron-LTS"), ("flatpak", "com.warble.Client"), ("snap", "warble --classic"), ("winget", "Fen.Kestrel"), ("dnf", "heron"), ("scoop", "extras/kestrel"), ("apt", "libplum")]


_DB: dict[str, appdb.AppDb] = {}


def db(spark: SparkSession) -> appdb.AppDb:
    """The sample database, loaded once in a session."""
    key = spark.sparkContext.applicationId
    if key not in _DB:
        _DB.clear()
        _DB[key] = appdb.pinned(appdb.load(appdb.from_json(spark, appdb.SAMPLE), strict=False))
    return _DB[key]


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is a machine and each event one sighting of software."""
    k = F.pmod("event_id", F.lit(15)).cast("int")
    one = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), n)
    title = k >= 8
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("machine"), F.col("event_id").alias("seq"), F.when(title, "registry").otherwise(one([v for v, _ in PACKAGES], F.least(k + 1, F.lit(8)))).alias("via"),
        F.when(title, one(TITLES, F.greatest(k - 7, F.lit(1)))).otherwise(one([p for _, p in PACKAGES], F.least(k + 1, F.lit(8)))).alias("package"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("1."), F.col("event_id").cast("string"))).alias("version"), F.when(title, one(TITLES, F.greatest(k - 7, F.lit(1)))).alias("name"), (F.col("event_id") % 2 == 0).alias("desktop"),
    )
    return rows


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.match(sightings(spark, sf_dir), db(spark), ("machine",))


def package_match(spark, sf_dir):
    return matched(spark, sf_dir).select("seq", "via", "package", "app_id")


def unknown_apps(spark, sf_dir):
    return detect.unknown(matched(spark, sf_dir)).groupBy("via", "package").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("machine").alias("machines"))


def found_apps(spark, sf_dir):
    found = detect.applications(matched(spark, sf_dir), ("machine",))
    return found.select("machine", "app_id", "version", F.array_join("sources", ",").alias("sources"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any machine has, as one list."""
    apps = matched(spark, sf_dir).where("app_id is not null").groupBy("app_id").agg(F.min("seq").alias("pos"))
    ghost = local.table(spark, [("ghost", -1)], "app_id string, pos long")
    return apps.select("app_id", "pos").unionByName(ghost).select("pos", "app_id", F.initcap("app_id").alias("name"), F.lit(False).alias("config_only"))


def target(spark: SparkSession) -> migrate.Target:
    have = local.table(spark, [(0, "rook", "pacman", "rook"), (1, "kestrel", "flatpak", "org.fen.kestrel")], "seq long, app_id string, via string, package string")
    return migrate.Target("linux", ["pacman", "apt"], have, home="/home/u")


def install_plan(spark, sf_dir):
    found = migrate.decided(manifest(spark, sf_dir), db(spark), target(spark))
    return found.select("app_id", "bucket", "target_id", "via", "manager", "package", F.array_join("needs", ",").alias("needs"), "stands_in", "reason")


def config_plan(spark, sf_dir):
    # each location in three copies, as from three builds of the application
    copies = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("ord"), F.lit(v).alias("variant")) for i, v in enumerate(("flatpak", "", "snap"))]))
    one = db(spark).locations.where("os = 'windows'").select("app_id", "key", copies.alias("c")).select("app_id", "c.ord", "key", "c.variant")
    return migrate.config_plan(manifest(spark, sf_dir), one, db(spark), target(spark), "windows")


def install_commands(spark, sf_dir):
    t = target(spark)
    items = migrate.items(migrate.decided(manifest(spark, sf_dir), db(spark), t), "install")
    return migrate.commands(items, t).select("n", "manager", F.array_join("argv", " ").alias("argv"), F.array_join("env", " ").alias("env"), "prep", "batch")


def command_outcomes(spark, sf_dir):
    steps = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", F.col("event_type").alias("manager"), F.col("event_id").alias("n"), (F.col("event_id") % 10 == 0).alias("prep"), (F.col("event_id") % 20 == 0).cast("int").alias("exit"))
    return migrate.outcomes(steps).select("n", "outcome")


#: Entries that break many rules.
BROKEN = [
    '{"id":"Bad Id","name":" ","category":"nope","homepage":"ftp://x","config":{"portability":"maybe"},"equivalents":["Bad Id","lark","lark","ghost"]}',
    '{"id":"dup","name":"Dup","category":"utility","linux":{"apt":["lark"," x"],"winget":["A B"],"paths":{"K":"/etc/x","k2":"~/a//b/"}},"config":{"portability":"none","exclude":["/a","[b"]}}',
]


def appdb_problems(spark, sf_dir):
    return appdb.problems(appdb.normalise(appdb.from_json(spark, [*appdb.SAMPLE, *BROKEN])))


def resolved_paths(spark, sf_dir):
    box = F.pmod("page_id", F.lit(3))
    prefix = F.element_at(F.array(*map(F.lit, ["~", "$XDG_CONFIG_HOME", "$XDG_DATA_HOME", "$XDG_STATE_HOME", "%APPDATA%"])), (F.pmod("page_id", F.lit(5)) + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.lit("linux").alias("os"), F.when(box == 0, "").when(box == 1, "flatpak").otherwise("snap").alias("variant"), F.lit("org.x").alias("sandbox"), F.concat(prefix, F.lit("/app/"), F.col("page_id").cast("string")).alias("path"))
    return detect.resolve(rows, home="/home/u", env={"XDG_DATA_HOME": "/data"}).select("page_id", "abs")


#: Patterns of one entry: some with brackets, negated or with an escape, one malformed.
GLOBS = ["f?", "*.JPG", "documents/*/f1*", "*[7-9].md", "*[^0-9].so", "*[^2-9].so", r"f\1*x", r"f1\2.*", "*[0-3].e?v", "[*]", "[a", "documents/f[^1-8]*"]


def excluded_globs(spark, sf_dir):
    entry = json.dumps({"id": "x", "name": "X", "category": "utility", "linux": {"apt": ["x"], "paths": {"c": "~/x"}}, "config": {"portability": "identical", "exclude": GLOBS}})
    rows = files(spark, sf_dir).select("seq", F.lit("x").alias("app_id"), F.expr("substring(path, 9)").alias("rel"))
    return detect.excluded(rows, appdb.normalise(appdb.from_json(spark, [entry]))).select("seq", "excluded")


# -- registry --------------------------------------------------------------------------------------------------------------

QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    file_classes, class_buckets, skipped_by_rule, secret_buckets, largest_files, composition, estimate_levels, human_sizes,
    root_split, root_join, root_summary, file_dedup, same_size_files, dedup_savings, solid_parts, stored_parts, block_ids, block_parts,
    volume_fold, volume_summary, needed_volumes, placed_files, volume_index, sums_check, missing_volumes, torn_journal, trailer_check, reassembly,
    codec_round_trip, entropy_class, sanitized, conflict_actions, restore_totals, restore_roots, collision_rename,
    package_match, unknown_apps, found_apps, install_plan, config_plan, install_commands, command_outcomes, appdb_problems, resolved_paths, excluded_globs,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quay import registry

    return {f.__name__: f for f in [*QUERIES, *registry.QUERIES]}


def oracle_sql() -> dict[str, str]:
    from quay import oracle, registry

    return oracle.sql() | registry.sql()
