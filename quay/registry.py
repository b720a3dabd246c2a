"""More registered queries: what package managers list, walks, headers, retries, totals; each beside the DuckDB SQL that says the same.

The raw texts (file lists, exports, settings) are written from the driver's tables, so what a parser must find again is known to SQL as a relation.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quay import catalog
from quay.catalog import table
from quay.functions import fixed, local, paths
from quay.operators import inventory, pack, restore, roots, verify
from quay.oracle import values
from quay.plans import detect, migrate
from quay.sources import appdb, files, package, packages

def text(*parts) -> object:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))


# -- package managers ----------------------------------------------------------------------------------------------------


def pacman_sightings(spark, sf_dir):
    k = F.col("k")
    desc = F.when(k % 11 == 5, text("%DESC%\nno name ", k, "\n")).otherwise(text("%NAME%\npkg-", k, "\n\n%VERSION%\n1.", k, "-1\n\n%DESC%\nx\n"))
    listed = F.when(k % 3 == 0, text("%FILES%\nusr/bin/p", k, "\nusr/share/applications/p", k, ".desktop\n")).when(k % 3 == 1, text("%FILES%\nusr/share/applications\nusr/share/doc/p.desktop\n"))
    return packages.pacman(customers(spark, sf_dir).select(desc.alias("text"), listed.alias("files"))).select("via", "package", "version", "desktop")


def dpkg_sightings(spark, sf_dir):
    k = F.col("k")
    stanza = text("Package: pkg-", k, "\nStatus: ", F.when(k % 7 == 2, "deinstall ok config-files").otherwise("install ok installed"), "\nVersion: 0\nDescription: of ", k, "\n Version: not this\nVersion: 2:", k, "\n")
    # a status file for every 40 packages
    group = customers(spark, sf_dir).select(F.floor(k / 40).alias("g"), F.struct("k", stanza.alias("s")).alias("x")).groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "\n").alias("text"))
    ending = F.when(k % 5 == 0, ".list").when(k % 5 == 1, ":amd64.list").when(k % 5 == 2, ":all.list")
    lists = customers(spark, sf_dir).where(ending.isNotNull()).select(text("pkg-", k, ending).alias("file"), F.when(k % 2 == 0, "/usr/share/applications/a/b.desktop\n").otherwise("/usr/bin/x\n").alias("text"))
    second = customers(spark, sf_dir).where(k % 5 == 0).select(text("pkg-", k, ":i386.list").alias("file"), F.lit("/usr/share/applications/c.desktop\n").alias("text"))
    return packages.dpkg(group, lists.unionByName(second)).select("via", "package", "version", "desktop")


def apk_sightings(spark, sf_dir):
    k = F.col("k")
    folder = F.when(k % 4 == 0, "usr/share/applications").when(k % 4 == 1, "usr/share").otherwise("usr/bin")
    stanza = text("C:x\nP:", F.when(k % 13 == 6, "").otherwise(text("pkg-", k)), "\nV:", k, ".0-r1\nF:usr/lib\nR:lib.so\nF:", folder, "\nR:p", k, ".desktop\nZ:y\n")
    group = customers(spark, sf_dir).select(F.floor(k / 40).alias("g"), F.struct("k", stanza.alias("s")).alias("x")).groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "\n").alias("text"))
    return packages.apk(group).select("via", "package", "version", "desktop")


def rpm_sightings(spark, sf_dir):
    k = F.col("k")
    lines = customers(spark, sf_dir).select(F.when(k % 9 == 4, F.lit("\t3")).when(k % 9 == 5, text("pkg-", k)).otherwise(text(" pkg-", k, "\t", k, "-2.fc40 ")).alias("text"))
    owners = customers(spark, sf_dir).where(k % 6 == 0).select(text("pkg-", k, " ").alias("name"))
    return packages.rpm(lines, owners, F.lit("dnf")).select("via", "package", "version", "desktop")


def flatpak_sightings(spark, sf_dir):
    k = F.col("k")
    return packages.flatpak(customers(spark, sf_dir).select((k % 2).cast("int").alias("ord"), F.when(k % 10 == 0, text("repo", k)).otherwise(text("org.x", F.floor(k / 2), ".App")).alias("name"))).select("via", "package")


def snap_sightings(spark, sf_dir):
    k = F.col("k")
    name = F.when(k % 12 == 0, text(fixed.SNAP_PREFIXES[0], k)).when(k % 12 == 1, text(".hidden", k)).when(k % 12 == 2, F.lit(fixed.SNAP_NAMES[0])).otherwise(text("snap-", k))
    yaml = F.when(k % 5 != 0, text("name: s\nversion: '", k, ".1'\n"))
    return packages.snap(customers(spark, sf_dir).select((k % 2 + 1).cast("int").alias("ord"), name.alias("name"), yaml.alias("yaml"))).select("via", "package", "version")


def uninstall_sightings(spark, sf_dir):
    k = F.col("k")
    name = F.when(k % 8 == 3, F.lit(" ")).when(k % 8 == 4, text("KB", k)).when(k % 8 == 5, text("Security Update for ", k)).when(k % 2 == 0, text("Tool ", F.floor(k / 4))).otherwise(text("TOOL ", F.floor(k / 4)))
    rows = customers(spark, sf_dir).select(
        k.cast("int").alias("ord"), name.alias("DisplayName"), (k % 3).cast("string").alias("DisplayVersion"), F.when(k % 17 == 0, 1).alias("SystemComponent"), F.when(k % 19 == 0, "parent").alias("ParentKeyName"), F.when(k % 23 == 0, "Hotfix").alias("ReleaseType"),
    )
    return packages.uninstall_keys(rows).select("via", "package", "version", "name")


def winget_sightings(spark, sf_dir):
    k = F.col("k")
    one = F.struct(F.when(k % 7 == 0, "").otherwise(text("Maker.App", k)).alias("PackageIdentifier"), text("1.", k).alias("Version"))
    group = customers(spark, sf_dir).groupBy(F.floor(k / 30).alias("g")).agg(F.collect_list(F.when(k % 2 == 0, one)).alias("a"), F.collect_list(F.when(k % 2 == 1, one)).alias("b"))
    sources = F.array(F.struct(F.col("a").alias("Packages")), F.struct(F.col("b").alias("Packages")))
    return packages.winget(group.select(F.to_json(F.struct(sources.alias("Sources"))).alias("text"))).select("via", "package", "version")


def scoop_sightings(spark, sf_dir):
    k = F.col("k")
    rows = customers(spark, sf_dir).select(F.when(k % 20 == 0, "scoop").otherwise(text("tool-", k)).alias("name"), F.when(k % 3 == 0, F.lit('{"bucket":"extras"}')).when(k % 3 == 1, F.lit('{"bucket":""}')).alias("install"), F.when(k % 4 != 0, text('{"version":"', k, '.0"}')).alias("manifest"))
    return packages.scoop(rows).select("via", "package", "version")


def choco_sightings(spark, sf_dir):
    k = F.col("k")
    return packages.choco(customers(spark, sf_dir).select(text("tool-", k).alias("name"), F.when(k % 4 != 0, text("<package><version> ", k, ".0 </version></package>")).alias("nuspec"))).select("via", "package", "version")


def release_settings(spark, sf_dir):
    k = F.col("k")
    line = F.when(k % 9 == 0, text("# KEY", k, "=no")).when(k % 9 == 1, text("no setting ", k)).when(k % 2 == 0, text("KEY", k % 50, '="v ', k, '"')).otherwise(text("KEY", k % 50, "='w=", k, "'"))
    return packages.settings(customers(spark, sf_dir).select(k.alias("n"), line.alias("text")))


def user_folders(spark, sf_dir):
    k = F.col("k")
    line = F.when(k % 5 == 0, F.lit("# none")).when(k % 5 == 1, text("OTHER_DIR=", k)).otherwise(text("XDG_", F.element_at(F.array(*map(F.lit, ["MUSIC", "VIDEOS", "DESKTOP", "PICTURES"])), (k % 4 + 1).cast("int")), '_DIR="$HOME/d', k, '"'))
    return packages.user_dirs(customers(spark, sf_dir).select(k.alias("n"), line.alias("text")), "/home/u")


FAMILY_IDS = ["plan9", "zorin", "ubuntu", "arch", "fedora", "unknown", "opensuse", "alpine", "debian", "rhel"]


def distro_family(spark, sf_dir):
    first = int(table(spark, sf_dir, "customer").agg(F.count(F.lit(1))).first()[0]) % len(FAMILY_IDS)
    ids = customers(spark, sf_dir).where("k <= 10").select(F.col("k").alias("pos"), F.upper(F.element_at(F.array(*map(F.lit, FAMILY_IDS)), ((F.col("k") + first) % len(FAMILY_IDS) + 1).cast("int"))).alias("id"))
    return packages.family(ids)


# -- rules, roots, walks -------------------------------------------------------------------------------------------------


def allowed_rules(spark, sf_dir):
    mine = catalog.files(spark, sf_dir).select("seq", "path", "size")
    return inventory.skipped(inventory.scanned(mine, rules=inventory.rule_dim(spark, ("NODE_MODULES", "nothing")), root="/home/u"))


def folder_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders at three depths, some missing, some files."""
    k = F.col("k")
    path = F.when(k % 4 == 0, text("/r/a", k % 40)).when(k % 4 == 1, text("/r/a", (k * 3) % 40, "/b", k)).when(k % 4 == 2, text("/r/a", k % 40, "x")).otherwise(text("/q", k))
    return customers(spark, sf_dir).select(path.alias("path"), (k % 7 != 0).alias("exists"), (k % 9 != 0).alias("is_dir"))


def default_folders(spark, sf_dir):
    return roots.default_roots(folder_candidates(spark, sf_dir))


def outside_folders(spark, sf_dir):
    inside = local.table(spark, [("/home/u/Documents",), ("/home/u/proj/.git",)], "path string")
    return roots.outside(catalog.files(spark, sf_dir).select("seq", "path"), inside).select("seq")


def walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk as a reader gives it: a row for each path, its kind, and what skipped folders hold."""
    k = F.col("k")
    kind = F.element_at(F.array(*map(F.lit, ["root", "dir", "file", "file", "symlink", "skipped", "error"])), (k % 7 + 1).cast("int"))
    name = F.when(k % 2 == 0, "node_modules").otherwise(".Cache")
    size, held = F.when(kind.isin("file", "skipped"), k * 10).otherwise(0), F.when(kind == "file", 1).when(kind == "skipped", k % 5).otherwise(0)
    return customers(spark, sf_dir).select(text("/r/", k, "/", name).alias("path"), kind.alias("kind"), size.cast("long").alias("size"), held.cast("long").alias("files"))


def walk_totals(spark, sf_dir):
    return files.scan_totals(walked(spark, sf_dir))


def walk_skipped(spark, sf_dir):
    return files.skipped_folders(walked(spark, sf_dir))


def file_system_limits(spark, sf_dir):
    magic = F.element_at(F.array(*[F.lit(m).cast("long") for m in [*files.FILE_SYSTEMS, 12345]]), (F.col("k") % (len(files.FILE_SYSTEMS) + 1) + 1).cast("int"))
    found = files.volume_size(files.destinations(customers(spark, sf_dir).select("k", magic.alias("magic"))), 10 << 30)
    return found.select("k", "fs", "max_file", "volume")


def fold_keys(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select("page_id", F.upper("url").alias("url"))
    return urls.select("page_id", paths.fold_key(F.col("url"), F.lit("windows")).alias("windows"), paths.fold_key(F.col("url"), F.lit("linux")).alias("linux"))


def app_roots(spark, sf_dir):
    k = F.col("k")
    made = paths.app_root(text("app", k), text("key", k % 3), F.when(k % 2 == 0, "").otherwise("snap"))
    root = F.when(k % 5 == 0, F.lit("documents")).when(k % 5 == 1, text("apps/", k)).otherwise(made)
    parts = customers(spark, sf_dir).select("k", root.alias("root"), paths.split_app_root(root).alias("p"))
    return parts.select("k", "root", F.col("p.id").alias("app_id"), F.col("p.key").alias("key"), F.col("p.variant").alias("variant"))


def passphrases(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.passphrase_ok(text(" ", F.substring("url", 9, 3), F.repeat(F.lit("é"), (F.col("page_id") % 9).cast("int")), "\t\n")).alias("ok"))


def shown_durations(spark, sf_dir):
    ns = F.col("k") * F.col("k") * 10_000_000
    rows = customers(spark, sf_dir).select("k", paths.human_duration(ns).alias("took"), paths.human_range(F.col("k") * 7, F.col("k") * 7 + F.col("k") % 2).alias("range"), paths.pad(F.col("k").cast("string"), 6).alias("padded"))
    return rows


# -- packages ------------------------------------------------------------------------------------------------------------


def verified_counts(spark, sf_dir):
    blocks, _, where = catalog.located(spark, sf_dir)
    return verify.verify_counts(blocks, where)


def header_problems(spark, sf_dir):
    k = F.col("k")
    rows = customers(spark, sf_dir).select(
        k.alias("volume"), F.when(k % 11 == 0, "XXXX").otherwise("VOLM").alias("magic"), F.when(k % 13 == 0, 2).otherwise(1).alias("format"), F.when(k % 17 == 0, "other").otherwise("mine").alias("package"),
        F.lit("mine").alias("package_id"), F.when(k % 19 == 0, k + 1).otherwise(k).alias("number"),
    )
    return verify.check_headers(rows, magic="VOLM", newest=1)


def incomplete_packages(spark, sf_dir):
    k = F.col("k")
    return verify.incomplete(customers(spark, sf_dir).select(k.alias("id"), F.when(k % 3 != 0, k % 5 == 0).alias("complete")))


def listed_twice(spark, sf_dir):
    k = F.col("k")
    return pack.duplicate_entries(customers(spark, sf_dir).select(F.when(k % 2 == 0, "documents").otherwise("music").alias("root"), text("f", F.floor(k / 3)).alias("path")))


def changed_sizes(spark, sf_dir):
    k = F.col("k")
    listed = customers(spark, sf_dir).select(k.alias("seq"), (k * 5).alias("size"))
    return pack.size_mismatches(listed, customers(spark, sf_dir).where(k % 4 != 0).select(k.alias("seq"), (k * 5 + F.when(k % 6 == 1, 1).otherwise(0)).alias("size")))


def chosen_entries(spark, sf_dir):
    split = roots.split_roots(catalog.files(spark, sf_dir).select("seq", "path", "size"), catalog.root_dim(spark))
    return restore.selected(split, ["documents", "apps", "other"], ["other"]).groupBy("root").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def result_documents(spark, sf_dir):
    """The totals of a scan, by class, as one JSON document for each class."""
    found = inventory.by_class(catalog.scan(spark, sf_dir))
    return found.select("class", F.to_json(F.struct("class", "files", "bytes")).alias("document"))


def sum_lines(spark, sf_dir):
    line = F.when(F.col("seq") % 31 == 7, F.lit("nonsense")).when(F.col("seq") % 31 == 8, F.concat(F.substring("sha256", 1, 9), F.lit("  "), F.col("path"))).otherwise(F.concat_ws("  ", "sha256", "path"))
    return package.parsed_sums(catalog.files(spark, sf_dir).select(F.concat(line, F.lit(" ")).alias("value")))


def manifest_problems(spark, sf_dir):
    k = F.col("k")
    document = F.when(k % 7 == 0, text('{"x":', k, "}")).otherwise(text('{"id":"p', k, '","format":', k % 3, "}"))
    return package.manifests(customers(spark, sf_dir).select("k", document.alias("value")), "value").select("k", "id", "problem")


def listed_apps(spark, sf_dir):
    k = F.col("k")
    app = F.struct(text("app", k).alias("id"), text("App ", k).alias("name"), F.when(k % 3 == 0, F.lit(True)).alias("config_only"))
    docs = customers(spark, sf_dir).groupBy(F.floor(k / 25).alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", app.alias("a")))), lambda x: x["a"]).alias("apps"))
    return package.read_app_manifest(docs.select(F.to_json(F.struct((F.col("g") % 4).alias("format"), "apps")).alias("text"))).select("pos", "app_id", "name", "config_only")


# -- applications --------------------------------------------------------------------------------------------------------


def apps_by_category(spark, sf_dir):
    found = detect.by_category(catalog.manifest(spark, sf_dir), catalog.db(spark))
    return found.select("category", "apps", F.array_join("names", "|").alias("names"))


def placed_locations(spark, sf_dir):
    return migrate.placed_roots(catalog.config_plan(spark, sf_dir))


def installed_config(spark, sf_dir):
    """Which configuration locations of the database exist: some native, some of sandboxes that were seen."""
    apps = local.table(spark, [("heron", "flatpak", "org.quill.heron"), ("lark", "snap", "lark --classic"), ("rook", "pacman", "rook")], "app_id string, via string, package string")
    have = [("/home/u/.heron/main", True), ("/home/u/.var/app/org.quill.heron/.heron/main", True), ("/home/u/.rookconfig", False), ("/home/u/snap/lark/current/.config/lark", True), ("/home/u/.config/ghost", True)]
    return detect.config_on_disk(catalog.db(spark), apps, local.table(spark, have, "path string, is_dir boolean"), os="linux", home="/home/u")


def configured_files(spark, sf_dir):
    """Files below configuration locations without those that the location's application excludes."""
    entry = '{"id":"x","name":"X","category":"utility","linux":{"apt":["x"],"paths":{"c":"~/x"}},"config":{"portability":"identical","exclude":["*.MD","app/f*[02468].*"]}}'
    spots = local.table(spark, [("x", "/home/u/.config"), ("x", "/home/u/Documents"), ("y", "/home/u/Documents/Photos")], "app_id string, abs string")
    return detect.config_filter(catalog.files(spark, sf_dir).select("seq", "path"), spots, appdb.normalise(appdb.from_json(spark, [entry]))).select("seq")


def elevation(spark, sf_dir):
    cmds = catalog.install_commands(spark, sf_dir)
    out = None
    for admin in (False, True):
        for tool in ("", "sudo"):
            one = migrate.needs_elevation(cmds, migrate.Target("linux", [], cmds, is_admin=admin, elevator=tool)).select(F.lit(admin).alias("is_admin"), F.lit(tool).alias("elevator"), "needs_elevation")
            out = one if out is None else out.unionByName(one)
    return out


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each user's events are the commands of a run: batches of one to three packages; failed batches are tried again one by one."""
    e, n = F.col("event_id"), F.expr("event_id % 3 + 1")
    names = F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: text("p", e, "-", i))
    prep = e % 10 == 0
    steps = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("manager"), e.alias("n"), prep.alias("prep"), (~prep & (e % 4 != 1)).alias("batch"), names.alias("packages"), F.when(e % 4 == 0, 1).when(e % 20 == 3, 2).otherwise(0).alias("exit"))
    singles = steps.where("exit <> 0 and batch and size(packages) > 1").select("run", "n", F.posexplode("packages").alias("i", "package")).select("run", "n", "package", F.when((F.col("n") + F.col("i")) % 3 == 0, 1).otherwise(0).alias("exit"))
    return steps, singles


def retried_batches(spark, sf_dir):
    return migrate.retried(*runs(spark, sf_dir)).select("n", "outcome", F.array_join("failed", ",").alias("failed"), "ok")


STRANGE = [
    '{"id":"a","name":"A","summary":"s","license":"MIT","category":"x","config":{"portability":"none"}}', '{"id":"b","nmae":"B","config":{"portability":"none","why":1},"linux":{"apt":["b"],"yum":["b"]}}',
    '{"id":"c","windows":{"winget":["c"],"path":{}},"extra":{"deep":1}}',
]


def strange_fields(spark, sf_dir):
    return appdb.unknown_in(local.table(spark, list(zip("abc", STRANGE, strict=True)), "file string, text string"))


QUERIES = [
    pacman_sightings, dpkg_sightings, apk_sightings, rpm_sightings, flatpak_sightings, snap_sightings, uninstall_sightings, winget_sightings, scoop_sightings, choco_sightings,
    release_settings, user_folders, distro_family, allowed_rules, default_folders, outside_folders, walk_totals, walk_skipped, file_system_limits, fold_keys, app_roots, passphrases, shown_durations,
    verified_counts, header_problems, incomplete_packages, listed_twice, changed_sizes, chosen_entries, result_documents, sum_lines, manifest_problems, listed_apps, apps_by_category,
    placed_locations, installed_config, configured_files, elevation, retried_batches, strange_fields,
]


# -- the same in SQL -----------------------------------------------------------------------------------------------------

C = "WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer)"


def _family() -> str:
    dim = values([(i, f) for f, names in fixed.FAMILIES.items() for i in names.split()])
    ids = values([(i, x) for i, x in enumerate(FAMILY_IDS)])
    return f"{C}, p AS (SELECT k AS pos, (k + (SELECT count(*) FROM c) % {len(FAMILY_IDS)}) % {len(FAMILY_IDS)} AS i FROM c WHERE k <= 10) SELECT arg_min(family, pos) AS family FROM p JOIN {ids} AS t(i, id) USING (i) JOIN {dim} AS d(id, family) USING (id)"


def _fields() -> str:
    known = {part: names for part, names in appdb.FIELDS.items()}
    rows = []
    for name, doc in zip("abc", STRANGE, strict=True):
        entry = json.loads(doc)
        for part in known:
            inside = entry if not part else entry.get(part, {})
            rows += [(name, part, key) for key in inside]
    dim = values([(part, key) for part, names in known.items() for key in names])
    return f"SELECT file, CASE WHEN part = '' THEN key ELSE part || '.' || key END AS field FROM {values(rows)} AS t(file, part, key) ANTI JOIN {dim} AS d(part, key) USING (part, key)"


def sql() -> dict[str, str]:
    from quay import oracle

    scan, split_, plan, volumes = f"WITH {oracle._scan()}", f"WITH {oracle._roots()}", f"WITH {oracle._manifest()}", f"WITH {oracle._volumes(catalog.BLOCK, catalog.VOLUME, catalog.RESERVE)}"
    files_ = f"WITH {oracle._files()}"
    fs = values([(i, f, files.LARGEST_FILE.get(f, 0)) for i, f in enumerate([*files.FILE_SYSTEMS.values(), "unknown"])])
    n_fs, most = len(files.FILE_SYSTEMS) + 1, 10 << 30
    human = oracle._human
    root_managers = ", ".join(f"'{m}'" for m in fixed.ROOT_MANAGERS)
    order = "CASE WHEN event_id % 10 = 0 AND CASE WHEN event_id % 4 = 0 OR event_id % 20 = 3 THEN 1 ELSE 0 END = 1 THEN 1 ELSE 0 END"
    return {
        "pacman_sightings": f"{C} SELECT 'pacman' AS via, 'pkg-' || k AS package, '1.' || k || '-1' AS version, k % 3 = 0 AS desktop FROM c WHERE k % 11 <> 5",
        "dpkg_sightings": f"{C} SELECT 'apt' AS via, 'pkg-' || k AS package, '2:' || k AS version, k % 5 <= 2 AND k % 2 = 0 AS desktop FROM c WHERE k % 7 <> 2",
        "apk_sightings": f"{C} SELECT 'apk' AS via, 'pkg-' || k AS package, k || '.0-r1' AS version, k % 4 = 0 AS desktop FROM c WHERE k % 13 <> 6",
        "rpm_sightings": f"{C} SELECT 'dnf' AS via, 'pkg-' || k AS package, CASE WHEN k % 9 <> 5 THEN k || '-2.fc40' END AS version, k % 6 = 0 AS desktop FROM c WHERE k % 9 <> 4",
        "flatpak_sightings": f"{C} SELECT DISTINCT 'flatpak' AS via, 'org.x' || (k // 2) || '.App' AS package FROM c WHERE k % 10 <> 0",
        "snap_sightings": f"{C}, s AS (SELECT k, k % 2 + 1 AS ord FROM c WHERE k % 12 > 2) SELECT 'snap' AS via, 'snap-' || k AS package, CASE WHEN k % 5 <> 0 THEN k || '.1' END AS version FROM s WHERE ord = (SELECT min(ord) FROM s)",
        "uninstall_sightings": f"""{C}, s AS (SELECT k, CASE WHEN k % 2 = 0 THEN 'Tool ' ELSE 'TOOL ' END || (k // 4) AS name, CAST(k % 3 AS VARCHAR) AS v FROM c WHERE k % 8 NOT IN (3, 4, 5) AND k % 17 <> 0 AND k % 19 <> 0 AND k % 23 <> 0)
            SELECT 'registry' AS via, arg_min(name, k) AS package, v AS version, arg_min(name, k) AS name FROM s GROUP BY lower(name), v""",
        "winget_sightings": f"{C} SELECT 'winget' AS via, 'Maker.App' || k AS package, '1.' || k AS version FROM c WHERE k % 7 <> 0",
        "scoop_sightings": f"{C} SELECT 'scoop' AS via, CASE WHEN k % 3 = 0 THEN 'extras/' ELSE '' END || 'tool-' || k AS package, CASE WHEN k % 4 <> 0 THEN k || '.0' END AS version FROM c WHERE k % 20 <> 0",
        "choco_sightings": f"{C} SELECT 'choco' AS via, 'tool-' || k AS package, CASE WHEN k % 4 <> 0 THEN k || '.0' END AS version FROM c",
        "release_settings": f"{C}, s AS (SELECT k, 'KEY' || (k % 50) AS key, CASE WHEN k % 2 = 0 THEN 'v ' ELSE 'w=' END || k AS value FROM c WHERE k % 9 > 1) SELECT key, arg_max(value, k) AS value FROM s GROUP BY key",
        "user_folders": f"{C}, s AS (SELECT k, (['music', 'videos', 'desktop', 'pictures'])[k % 4 + 1] AS kind FROM c WHERE k % 5 > 1) SELECT kind, '/home/u/d' || max(k) AS path FROM s GROUP BY kind",
        "distro_family": _family(),
        "allowed_rules": f"{scan}, r2 AS (SELECT seq, arg_min(dir, pos) AS rule FROM segs JOIN rules ON rules.seg = lower(segs.seg) WHERE rules.seg <> 'node_modules' GROUP BY seq) SELECT rule, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM r2 JOIN files USING (seq) GROUP BY rule",
        "default_folders": f"""{C}, p AS (SELECT DISTINCT CASE k % 4 WHEN 0 THEN '/r/a' || (k % 40) WHEN 1 THEN '/r/a' || ((k * 3) % 40) || '/b' || k WHEN 2 THEN '/r/a' || (k % 40) || 'x' ELSE '/q' || k END AS path FROM c WHERE k % 7 <> 0 AND k % 9 <> 0)
            SELECT path FROM p ANTI JOIN (SELECT DISTINCT i.path FROM p i JOIN p o ON starts_with(i.path, o.path || '/')) AS inner_ USING (path)""",
        "outside_folders": f"{files_} SELECT seq FROM files WHERE NOT starts_with(path, '/home/u/Documents/') AND NOT starts_with(path, '/home/u/proj/.git/')",
        "walk_totals": f"""{C} SELECT count(*) FILTER (k % 7 IN (2, 3)) AS files, CAST(coalesce(sum(k * 10) FILTER (k % 7 IN (2, 3)), 0) AS BIGINT) AS bytes, count(*) FILTER (k % 7 IN (0, 1)) AS dirs, count(*) FILTER (k % 7 = 4) AS symlinks, count(*) FILTER (k % 7 = 6) AS errors,
            CAST(coalesce(sum(k * 10) FILTER (k % 7 = 5), 0) AS BIGINT) AS skipped_bytes FROM c""",
        "walk_skipped": f"{C} SELECT CASE WHEN k % 2 = 0 THEN 'node_modules' ELSE '.cache' END AS rule, CAST(sum(k % 5) AS BIGINT) AS files, CAST(sum(k * 10) AS BIGINT) AS bytes FROM c WHERE k % 7 = 5 GROUP BY 1",
        "file_system_limits": f"{C} SELECT k, fs, CAST(m AS BIGINT) AS max_file, CASE WHEN m > 0 AND m < {most} THEN m ELSE {most} END AS volume FROM c JOIN {fs} AS t(i, fs, m) ON i = k % {n_fs}",
        "fold_keys": "SELECT page_id, lower(upper(url)) AS windows, upper(url) AS linux FROM pages",
        "app_roots": f"""{C} SELECT k, CASE k % 5 WHEN 0 THEN 'documents' WHEN 1 THEN 'apps/' || k ELSE 'apps/app' || k || '/key' || (k % 3) || CASE WHEN k % 2 = 0 THEN '' ELSE '@snap' END END AS root,
            CASE WHEN k % 5 > 1 THEN 'app' || k END AS app_id, CASE WHEN k % 5 > 1 THEN 'key' || (k % 3) END AS key, CASE WHEN k % 5 > 1 THEN CASE WHEN k % 2 = 0 THEN '' ELSE 'snap' END END AS variant FROM c""",
        "passphrases": "SELECT page_id, length(trim(url[9:11] || repeat('é', page_id % 9), ' ' || chr(9) || chr(10))) >= 8 AS ok FROM pages",
        "shown_durations": rf"""{C}, d AS (SELECT k, k * k * 10000000 AS ns FROM c), m AS (SELECT k, ns, CAST(floor(ns / 6e10 + 0.5) AS BIGINT) AS mins, CAST(floor(ns / 3.6e12) AS BIGINT) AS h FROM d)
            SELECT k, CASE WHEN ns < 1e9 THEN 'under a second' WHEN ns < 6e10 THEN '~' || CAST(floor(ns / 1e9 + 0.5) AS BIGINT) || ' sec' WHEN ns < 3.6e12 THEN '~' || mins || ' min' WHEN mins - h * 60 = 0 THEN '~' || h || ' h' ELSE '~' || h || ' h ' || (mins - h * 60) || ' min' END AS took,
              CASE WHEN k % 2 = 0 THEN {human('(k * 7)')} ELSE {human('(k * 7)')} || ' – ' || {human('(k * 7 + 1)')} END AS range, rpad(CAST(k AS VARCHAR), CAST(greatest(6, length(CAST(k AS VARCHAR))) AS INTEGER), ' ') AS padded FROM m""",
        "verified_counts": f"{volumes} SELECT count(*) AS blocks, CAST(coalesce(sum(raw), 0) AS BIGINT) AS bytes, count(DISTINCT volume) AS volumes FROM located JOIN blocks USING (block_id)",
        "header_problems": f"{C} SELECT k AS volume, CASE WHEN k % 11 = 0 THEN 'not a volume' WHEN k % 13 = 0 THEN 'newer format' WHEN k % 17 = 0 THEN 'other package' ELSE 'wrong number' END AS problem FROM c WHERE k % 11 = 0 OR k % 13 = 0 OR k % 17 = 0 OR k % 19 = 0",
        "incomplete_packages": f"{C} SELECT k AS id, 'incomplete' AS problem FROM c WHERE k % 3 = 0 OR k % 5 <> 0",
        "listed_twice": f"{C} SELECT CASE WHEN k % 2 = 0 THEN 'documents' ELSE 'music' END AS root, 'f' || (k // 3) AS path, count(*) AS n FROM c GROUP BY 1, 2 HAVING count(*) > 1",
        "changed_sizes": f"{C} SELECT k AS seq, k * 5 AS listed, k * 5 + 1 AS packed FROM c WHERE k % 4 <> 0 AND k % 6 = 1",
        "chosen_entries": f"{split_} SELECT root, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM split WHERE root = 'documents' OR starts_with(root, 'apps/') GROUP BY root",
        "result_documents": f"""{scan} SELECT class, '{{"class":"' || class || '","files":' || files || ',"bytes":' || bytes || '}}' AS document FROM buckets""",
        "sum_lines": f"{files_} SELECT CASE WHEN seq % 31 = 7 THEN '' ELSE path END AS name, CASE seq % 31 WHEN 7 THEN 'nonsense' WHEN 8 THEN sha256[1:9] ELSE sha256 END AS sha256, seq % 31 IN (7, 8) AS bad FROM files",
        "manifest_problems": f"{C} SELECT k, CASE WHEN k % 7 <> 0 THEN 'p' || k END AS id, CASE WHEN k % 7 = 0 THEN 'not a package' WHEN k % 3 > 1 THEN 'newer format' END AS problem FROM c",
        "listed_apps": f"{C} SELECT row_number() OVER (PARTITION BY k // 25 ORDER BY k) - 1 AS pos, 'app' || k AS app_id, 'App ' || k AS name, k % 3 = 0 AS config_only FROM c WHERE (k // 25) % 4 <= 1",
        "apps_by_category": f"{plan}, n AS (SELECT * FROM {values([(json.loads(x)['id'], json.loads(x)['name'], json.loads(x)['category']) for x in appdb.SAMPLE])} AS t(app_id, name, category)) SELECT category, count(*) AS apps, string_agg(name, '|' ORDER BY name) AS names FROM manifest JOIN n USING (app_id) GROUP BY category",
        "placed_locations": f"SELECT 'apps/' || app_id || '/' || key || CASE WHEN variant = '' THEN '' ELSE '@' || variant END AS root, dest AS root_path FROM ({oracle.sql()['config_plan']}) AS p WHERE action = 'place'",
        "installed_config": "SELECT * FROM (VALUES ('heron', 'profiles', '', '/home/u/.heron/main', true), ('heron', 'profiles', 'flatpak', '/home/u/.var/app/org.quill.heron/.heron/main', true), ('rook', 'rookconfig', '', '/home/u/.rookconfig', false), ('lark', 'config', 'snap', '/home/u/snap/lark/current/.config/lark', true)) AS t(app_id, key, variant, abs, is_dir)",
        "configured_files": rf"""{files_}, l AS (SELECT seq, path, CASE WHEN starts_with(path, '/home/u/Documents/Photos/') THEN 'y' WHEN starts_with(path, '/home/u/Documents/') THEN lower(path[19:]) WHEN starts_with(path, '/home/u/.config/') THEN lower(path[17:]) END AS rel,
            starts_with(path, '/home/u/.config/') OR (starts_with(path, '/home/u/Documents/') AND NOT starts_with(path, '/home/u/Documents/Photos/')) AS mine FROM files)
            SELECT seq FROM l WHERE NOT (mine AND (len(list_filter(string_split(rel, '/'), lambda s: ends_with(s, '.md'))) > 0 OR regexp_full_match(rel, 'app/f[^/]*[02468]\.[^/]*')))""",
        "elevation": f"SELECT a AS is_admin, e AS elevator, any_ AND NOT a AND e = '' AS needs_elevation FROM (SELECT coalesce(bool_or(manager IN ({root_managers})), false) AS any_ FROM ({oracle.sql()['install_commands']}) AS i), (VALUES (false), (true)) AS x(a), (VALUES (''), ('sudo')) AS y(e)",
        "retried_batches": f"""WITH s AS (SELECT event_id AS n, event_id % 10 = 0 AS prep, event_id % 10 <> 0 AND event_id % 4 <> 1 AS batch, event_id % 4 = 0 OR event_id % 20 = 3 AS bad, event_id % 3 + 1 AS k,
              coalesce(max({order}) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS gone FROM events),
            f AS (SELECT *, bad AND NOT gone AND NOT prep AS tried, list_transform(range(1, k + 1), lambda i: 'p' || n || '-' || i) AS names, list_filter(range(1, k + 1), lambda i: (n + i - 1) % 3 = 0) AS again FROM s)
            SELECT n, CASE WHEN gone THEN 'skipped' WHEN bad THEN 'failed' ELSE 'ok' END AS outcome,
              CASE WHEN NOT tried THEN '' WHEN batch AND k > 1 THEN coalesce(array_to_string(list_transform(again, lambda i: 'p' || n || '-' || i), ','), '') ELSE array_to_string(names, ',') END AS failed,
              CASE WHEN tried AND batch AND k > 1 THEN len(again) = 0 ELSE NOT gone AND NOT bad END AS ok FROM f""",
        "strange_fields": _fields(),
    }
