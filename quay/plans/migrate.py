"""What to install on a target, where each configuration goes, and the commands for it.

``manifest``: pos, app_id, name, config_only. ``configs``: app_id, ord, key, variant, file. ``target``: a Target. Every application of the
manifest ends in exactly one of install, present, no_source, missing; configuration that only comes along (config_only) in none.

All steps are joins with ranks. Which equivalent stands in does not depend on what else is planned: it is the first in the entry's order that is
on the platform and is installed or can be installed, so the sources it stands in for are a plain aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quay.functions import fixed, local
from quay.plans.detect import resolve
from quay.sources.appdb import AppDb

#: Reasons, as codes.
NOT_HERE, NO_EQUIVALENT, NONE_USABLE = "unknown-app", "no-equivalent", "no-usable-equivalent"
NO_VERSION, NO_LOCATION, TRANSLATE, BOUND, STAYS, ABSENT, UNRESOLVED, OTHER_COPY = "no-version", "no-location", "needs-translation", "platform-bound", "does-not-travel", "app-absent", "unresolved-location", "other-copy-placed"


@dataclass
class Target:
    """os, managers in order of preference, installed software (seq, app_id, via, package)."""

    os: str
    managers: list[str]
    installed: DataFrame
    home: str = "/home/u"
    env: dict[str, str] | None = None
    aur_helper: str = "paru"
    is_admin: bool = False
    elevator: str = "sudo"


def _managers(spark: SparkSession, names: list[str]) -> DataFrame:
    return local.table(spark, [(m, i) for i, m in enumerate(names)], "manager string, rank int")


def picks(db: AppDb, target: Target) -> DataFrame:
    """(app_id, manager, package): the first usable manager of the target and its first identifier."""
    usable = [m for m in target.managers if m not in fixed.DETECTS_ONLY]
    here = db.packages.where(F.col("os") == target.os).join(_managers(db.apps.sparkSession, usable), "manager")
    best = here.groupBy("app_id").agg(F.min(F.struct("rank", "ord", "manager", "package")).alias("b"))
    return best.select("app_id", "b.manager", "b.package")


def needs(db: AppDb, target: Target) -> DataFrame:
    """(app_id, needs): managers of the platform that could install the application, in canonical order."""
    able = [m for m, os in fixed.MANAGERS.items() if os == target.os and m not in fixed.DETECTS_ONLY]
    here = db.packages.where(F.col("os") == target.os).join(_managers(db.apps.sparkSession, able), "manager").select("app_id", "manager", "rank").distinct()
    return here.groupBy("app_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "manager"))), lambda x: x["manager"]).alias("needs"))


def first_source(installed: DataFrame) -> DataFrame:
    return installed.groupBy("app_id").agg(F.min_by("via", "seq").alias("via"))


def decided(manifest: DataFrame, db: AppDb, target: Target) -> DataFrame:
    """One row per manifest row: bucket, target_id, via or manager, package, needs, reason."""
    here = first_source(target.installed)
    pick, need = picks(db, target), needs(db, target)
    on = db.apps.select("app_id", F.lit(True).alias("known"), F.col(target.os).alias("on"))
    eq = db.equivalents.join(db.apps.where(F.col(target.os)).select(F.col("app_id").alias("equivalent")), "equivalent")
    eq = eq.join(here.select(F.col("app_id").alias("equivalent"), F.col("via").alias("e_via")), "equivalent", "left")
    eq = eq.join(pick.select(F.col("app_id").alias("equivalent"), F.col("manager").alias("e_manager"), F.col("package").alias("e_package")), "equivalent", "left")
    eq = eq.where("e_via is not null or e_manager is not null").groupBy("app_id").agg(F.min_by(F.struct("equivalent", "e_via", "e_manager", "e_package"), "ord").alias("e"))
    listed = db.equivalents.select("app_id", F.lit(True).alias("listed")).distinct()
    rows = manifest.where("not config_only")
    for other in (on, here, pick, need, eq, listed):
        rows = rows.join(other, "app_id", "left")
    known, via, is_on = F.col("known").isNotNull(), F.col("via").isNotNull(), F.coalesce("on", F.lit(False))
    bucket = (
        F.when(~known, "missing").when(via, "present").when(is_on & F.col("manager").isNotNull(), "install").when(is_on, "no_source")
        .when(F.col("e.e_via").isNotNull(), "present").when(F.col("e").isNotNull(), "install").otherwise("missing")
    )
    stands_in = known & ~via & ~is_on & F.col("e").isNotNull()
    reason = F.when(~known, NOT_HERE).when(bucket == "missing", F.when(F.col("listed"), NONE_USABLE).otherwise(NO_EQUIVALENT))
    return rows.select(
        "pos", "app_id", "name", bucket.alias("bucket"), F.when(stands_in, F.col("e.equivalent")).otherwise(F.col("app_id")).alias("target_id"),
        F.when(stands_in, F.col("e.e_via")).otherwise(F.col("via")).alias("via"), F.when(stands_in, F.col("e.e_manager")).otherwise(F.col("manager")).alias("manager"),
        F.when(stands_in, F.col("e.e_package")).otherwise(F.col("package")).alias("package"), F.when(bucket == "no_source", F.col("needs")).alias("needs"), stands_in.alias("stands_in"), reason.alias("reason"),
    )


def items(decisions: DataFrame, bucket: str) -> DataFrame:
    """Install or present items, each application once, with the sources it stands in for (in order)."""
    rows = decisions.where(F.col("bucket") == bucket)
    extra = ("manager", "package") if bucket == "install" else ("via",)
    return rows.groupBy("target_id").agg(
        F.min("pos").alias("pos"), *[F.first(c, True).alias(c) for c in extra],
        F.transform(F.array_sort(F.collect_list(F.when(F.col("stands_in"), F.struct("pos", "app_id")))), lambda x: x["app_id"]).alias("for"),
    )


def installed_variant(installed: DataFrame) -> DataFrame:
    """(app_id, variant, sandbox): native if any native source is there, else the first sandbox; the registry says nothing."""
    box = F.col("via").isin("flatpak", "snap")
    name = F.when(F.col("via") == "snap", F.substring_index("package", " ", 1)).otherwise(F.col("package"))
    sums = installed.groupBy("app_id").agg(F.bool_or(~box & (F.col("via") != "registry")).alias("native"), F.min_by(F.struct(F.col("via").alias("v"), name.alias("s")), F.when(box, F.col("seq"))).alias("b"))
    inside = ~F.col("native") & F.col("b").isNotNull()
    return sums.select("app_id", F.when(inside, F.col("b.v")).otherwise("").alias("variant"), F.when(inside, F.col("b.s")).otherwise("").alias("sandbox"))


def config_plan(manifest: DataFrame, configs: DataFrame, db: AppDb, target: Target, source_os: str) -> DataFrame:
    """app_id, ord, key, variant, action (place, aside), dest, reason for every configuration location of the manifest."""
    plan = items(decided(manifest, db, target), "install").select(F.col("target_id").alias("app_id"), "manager", F.col("package").alias("i_package"))
    have = installed_variant(target.installed).select("app_id", F.col("variant").alias("h_variant"), F.col("sandbox").alias("h_sandbox"))
    apps = db.apps.select("app_id", "portability", F.col(target.os).alias("on"))
    there = db.locations.where(F.col("os") == target.os).select("app_id", "key", "path")
    rows = configs.join(apps, "app_id", "left").join(there, ["app_id", "key"], "left").join(have, "app_id", "left").join(plan, "app_id", "left")
    boxed = F.when(F.col("manager").isin("flatpak", "snap"), F.col("manager")).otherwise("")
    want = F.when(F.col("h_variant").isNotNull(), F.col("h_variant")).otherwise(boxed)
    sandbox = F.when(F.col("h_variant").isNotNull(), F.col("h_sandbox")).when(boxed == "snap", F.substring_index("i_package", " ", 1)).when(boxed == "flatpak", F.col("i_package")).otherwise("")
    rows = rows.withColumnRenamed("variant", "from_variant").withColumns({"os": F.lit(target.os), "variant": want, "sandbox": sandbox})
    rows = resolve(rows, home=target.home, env=target.env)
    crossing = F.lit(source_os != target.os)
    reason = (
        F.when(F.col("on").isNull(), NOT_HERE).when(~F.col("on"), NO_VERSION)
        .when(F.col("path").isNull(), NO_LOCATION)
        .when(crossing & (F.col("portability") == "translatable"), TRANSLATE)
        .when(crossing & (F.col("portability") == "untranslatable"), BOUND)
        .when(crossing & (F.col("portability") != "identical"), STAYS)
        .when(F.col("h_variant").isNull() & F.col("manager").isNull(), ABSENT)
        .when(F.col("abs").isNull(), UNRESOLVED)
    )
    rank = F.when(F.col("from_variant") == F.col("variant"), 0).when(F.col("from_variant") == "", 1).otherwise(2)
    rows = rows.withColumns({"reason": reason, "_rank": rank})
    best = rows.groupBy("app_id", "key").agg(F.min_by("ord", F.struct("_rank", "ord")).alias("_best"))
    chosen = F.col("reason").isNull() & (F.col("ord") == F.col("_best"))
    return rows.join(best, ["app_id", "key"]).select(
        "app_id", "ord", "key", F.col("from_variant").alias("variant"), F.when(chosen, "place").otherwise("aside").alias("action"), F.when(chosen, F.col("abs")).alias("dest"),
        F.when(~chosen, F.coalesce("reason", F.lit(OTHER_COPY))).alias("reason"),
    )


def placed_roots(plan: DataFrame) -> DataFrame:
    """(root, root_path) of every configuration location that is placed: what a restore adds to the target's roots."""
    from quay.functions import paths

    return plan.where("action = 'place'").select(paths.app_root(F.col("app_id"), F.col("key"), F.col("variant")).alias("root"), F.col("dest").alias("root_path"))


#: Commands by manager, before the packages; what runs first; which take one package at a time.
COMMANDS = {
    "pacman": "pacman -Syu --needed --noconfirm", "aur": "{helper} -S --needed --noconfirm", "apt": "apt-get install -y", "dnf": "dnf install -y",
    "zypper": "zypper --non-interactive install", "apk": "apk add", "flatpak": "flatpak install -y --noninteractive flathub", "snap": "snap install",
    "winget": "winget install --id", "choco": "choco install -y", "scoop": "scoop install",
}
FIRST = {"apt": "apt-get update", "apk": "apk update", "flatpak": "flatpak remote-add --if-not-exists flathub https://dl.flathub.org/repo/flathub.flatpakrepo"}
ONE_BY_ONE = {"snap": "", "winget": " --exact --source winget --accept-package-agreements --accept-source-agreements --disable-interactivity --silent"}
ENVIRONMENT = {"apt": "DEBIAN_FRONTEND=noninteractive"}


def commands(install: DataFrame, target: Target) -> DataFrame:
    """The commands in order: n, manager, argv, env, packages, prep, batch. ``install``: pos, manager, package."""
    spark = install.sparkSession
    order = [*target.managers, *(m for m in fixed.MANAGERS if m not in target.managers)]
    root = "" if target.is_admin or not target.elevator else target.elevator + " "
    dim = [(m, i, (root if m in fixed.ROOT_MANAGERS else "") + COMMANDS[m].replace("{helper}", target.aur_helper or "paru"), (root if m in fixed.ROOT_MANAGERS else "") + FIRST[m] if m in FIRST else None, ENVIRONMENT.get(m), m in ONE_BY_ONE, ONE_BY_ONE.get(m, "")) for i, m in enumerate(order) if m in COMMANDS]
    table = local.table(spark, dim, "manager string, rank int, head string, first string, env string, single boolean, tail string")
    rows = install.join(table, "manager")
    words = lambda c: F.split(c, " ")
    env = F.when(F.col("env").isNotNull(), F.array("env")).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    prep = rows.where("first is not null").select("manager", "rank", "first", "env").distinct().select("rank", F.lit(0).alias("step"), F.lit(0).cast("long").alias("pos"), "manager", words(F.col("first")).alias("argv"), env.alias("env"), none.alias("packages"), F.lit(True).alias("prep"), F.lit(False).alias("batch"))
    # a target's whole list for one manager is one command line
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "package"))), lambda x: x["package"])
    batch = rows.where("not single").groupBy("manager", "rank", "head", "env").agg(listed.alias("packages")).select("rank", F.lit(1).alias("step"), F.lit(0).cast("long").alias("pos"), "manager", F.concat(words(F.col("head")), "packages").alias("argv"), env.alias("env"), "packages", F.lit(False).alias("prep"), F.lit(True).alias("batch"))
    argv = F.filter(F.concat(words(F.col("head")), F.when(F.col("manager") == "snap", F.split("package", r"\s+")).otherwise(F.array("package")), words(F.trim("tail"))), lambda x: x != "")
    single = rows.where("single").select("rank", F.lit(1).alias("step"), F.col("pos").cast("long").alias("pos"), "manager", argv.alias("argv"), env.alias("env"), F.array("package").alias("packages"), F.lit(False).alias("prep"), F.lit(False).alias("batch"))
    every = prep.unionByName(batch).unionByName(single)
    n = F.expr("row_number() over (order by rank, step, pos)") - 1  # a few commands for one target
    return every.withColumn("n", n).select("n", "manager", "argv", "env", "packages", "prep", "batch")


def needs_elevation(cmds: DataFrame, target: Target) -> DataFrame:
    able = target.is_admin or bool(target.elevator)
    return cmds.agg(F.coalesce(F.bool_or(F.col("manager").isin(*fixed.ROOT_MANAGERS)), F.lit(False)).alias("any")).select((F.col("any") & F.lit(not able)).alias("needs_elevation"))


def retried(steps: DataFrame, singles: DataFrame) -> DataFrame:
    """``outcomes`` with ``failed``, the packages that failed, and ``ok``.

    steps: run, manager, n, prep, batch, packages, exit. singles: run, n, package, exit of a batch's packages tried one by one, which a failed batch of
    several packages is; it is ok if all of them are.
    """
    rows = outcomes(steps).withColumnRenamed("packages", "listed")
    alone = singles.groupBy("run", "n").agg(F.array_sort(F.collect_list(F.when(F.col("exit") != 0, F.col("package")))).alias("again"))
    tried = (F.col("outcome") == "failed") & ~F.col("prep")
    several = F.col("batch") & (F.size("listed") > 1)
    none = F.array().cast("array<string>")
    failed = F.when(tried & several, F.coalesce("again", none)).when(tried, F.col("listed")).otherwise(none)
    joined = rows.join(alone, ["run", "n"], "left").withColumn("failed", failed)
    ok = F.when(tried & several, F.size("failed") == 0).otherwise(F.col("outcome") == "ok")
    return joined.select("run", "manager", "n", "outcome", "failed", ok.alias("ok"))


def outcomes(steps: DataFrame, by: Column | str = "run") -> DataFrame:
    """What becomes of commands (run, manager, n, prep, exit): after a failed preparation the manager's later commands are skipped."""
    from pyspark.sql import Window

    before = Window.partitionBy(by, "manager").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.coalesce(F.max(F.when(F.col("prep") & (F.col("exit") != 0), 1).otherwise(0)).over(before), F.lit(0)) == 1
    return steps.withColumn("outcome", F.when(failed, "skipped").when(F.col("exit") == 0, "ok").otherwise("failed"))
