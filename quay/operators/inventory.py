"""Inventory of files: exclusion, secrets, classes, summaries and the size estimate.

An inventory is a DataFrame with ``path`` and ``size`` (and any other columns, which stay as they are; a column that a step adds
replaces one of that name). All dimension tables here have a fixed number of rows
(the largest has some 230), so broadcasting them is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quay.functions import fixed, local, paths


def _dim(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return local.table(spark, rows, schema)


def class_dim(spark: SparkSession) -> DataFrame:
    return _dim(spark, sorted(fixed.class_table().items()), "ext string, class string")


def rule_dim(spark: SparkSession, allow: tuple[str, ...] = ()) -> DataFrame:
    """The exclusion rules without the allowed ones (in any case)."""
    allowed = {a.lower() for a in allow}
    return _dim(spark, [(d.lower(), d, h) for d, h in fixed.rules() if d.lower() not in allowed], "seg string, dir string, heavy boolean")


def classify(files: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Adds ``class``: by extension, else by whole name, else by the extension before a last unknown one."""
    spark = files.sparkSession
    known = classes if classes is not None else class_dim(spark)
    name = F.lower(paths.base_name(F.col("path")))
    hidden = name.startswith(".") & (F.instr(F.substring(name, 2, 1 << 20), ".") == 0)
    last = paths.last_ext(name)
    rest = F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)
    first = F.when(hidden, F.substring(name, 2, 1 << 20)).otherwise(F.nullif(last, F.lit("")))
    second = F.when(~hidden & (last != "") & rest.contains("."), paths.last_ext(rest))
    n, h, e1, e2, c1, c2, c3 = local.free(files, "name", "hidden", "e1", "e2", "c1", "c2", "c3")
    rows = files.withColumns({n: F.when(~hidden, name), h: hidden, e1: first, e2: second})
    by = lambda key, col: known.select(F.col("ext").alias(key), F.col("class").alias(col))
    names = _dim(spark, [(x, "text") for x in fixed.TEXT_NAMES], f"{n} string, {c3} string")
    rows = rows.join(by(e1, c1), e1, "left").join(by(e2, c2), e2, "left").join(names, n, "left")
    found = F.when(F.col(h), F.coalesce(c1, F.lit("text"))).otherwise(F.coalesce(c1, c3, c2, F.lit("unknown")))
    return rows.withColumn("class", found).select(*files.columns, *([] if "class" in files.columns else ["class"]))


def excluded(files: DataFrame, rules: DataFrame | None = None, root: str | None = None) -> DataFrame:
    """Adds ``rule``: the outermost folder of the path (below ``root``) that a rule names, null where none does."""
    spark = files.sparkSession
    rules = rules if rules is not None else rule_dim(spark)
    below = F.col("path") if root is None else F.coalesce(paths.under(F.col("path"), F.lit(root)), F.col("path"))
    folders = F.transform(F.slice(paths.segments(below), F.lit(1), F.greatest(F.size(paths.segments(below)) - 1, F.lit(0))), F.lower)
    # The rules as one row of a bounded table: a file's folders are looked up without a join that multiplies rows.
    f, r, one = local.free(files, "folders", "rules", "one")
    named = F.broadcast(rules.agg(F.map_from_entries(F.collect_list(F.struct("seg", "dir"))).alias(r)).withColumn(one, F.lit(1)))
    with_rules = files.withColumn(f, folders).withColumn(one, F.lit(1)).join(named, one, "left")
    first = F.try_element_at(F.filter(F.transform(f, lambda s: F.col(r)[s]), lambda d: d.isNotNull()), F.lit(1))
    return with_rules.withColumn("rule", first).select(*files.columns, *([] if "rule" in files.columns else ["rule"]))


def secrets(files: DataFrame) -> DataFrame:
    """Adds ``secret``, the reason why a file is secret: by name, then extension, then .env, then any segment."""
    spark = files.sparkSession
    name = F.lower(paths.base_name(F.col("path")))
    n, e, segs, r1, r2 = local.free(files, "name", "ext", "segs", "r1", "r2")
    rows = files.withColumns({n: name, e: paths.last_ext(name), segs: F.transform(paths.segments(F.col("path")), F.lower)})
    names = _dim(spark, sorted(fixed.SECRET_NAMES.items()), f"{n} string, {r1} string")
    exts = _dim(spark, sorted(fixed.SECRET_EXTS.items()), f"{e} string, {r2} string")
    env = F.when((F.col(n) == ".env") | F.col(n).startswith(".env."), fixed.SECRET_ENV)
    first = F.try_element_at(F.filter(segs, lambda s: s.isin(*fixed.SECRET_DIRS)), F.lit(1))
    folder = F.lit(None).cast("string")
    for d, why in fixed.SECRET_DIRS.items():
        folder = F.when(first == d, why).otherwise(folder)
    rows = rows.join(names, n, "left").join(exts, e, "left")
    return rows.withColumn("secret", F.coalesce(r1, r2, env, folder)).select(*files.columns, *([] if "secret" in files.columns else ["secret"]))


def scanned(files: DataFrame, *, rules: DataFrame | None = None, root: str | None = None) -> DataFrame:
    """``rule``, ``secret`` and ``class`` of every file."""
    return classify(secrets(excluded(files, rules, root)))


def by_class(scan: DataFrame, *, with_secrets: bool = False) -> DataFrame:
    """Files and bytes by class of what enters the package."""
    kept = scan.where("rule is null" if with_secrets else "rule is null and secret is null")
    return kept.groupBy("class").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def skipped(scan: DataFrame) -> DataFrame:
    """Files and bytes that each rule leaves out."""
    return scan.where("rule is not null").groupBy("rule").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def secret_bucket(scan: DataFrame) -> DataFrame:
    """Files and bytes by reason of secrecy, of what no rule leaves out."""
    return scan.where("rule is null and secret is not null").groupBy("secret").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def largest(scan: DataFrame, n: int = 15, seq: str = "seq") -> DataFrame:
    """The n largest files; of equal ones the earlier."""
    return scan.where("rule is null and secret is null").orderBy(F.desc("size"), seq).limit(n)


def composition(classes: DataFrame) -> DataFrame:
    """Adds each class's share of all bytes, in percent."""
    t, one = local.free(classes, "total", "one")
    total = classes.agg(F.sum("bytes").alias(t)).withColumn(one, F.lit(1))
    return classes.withColumn(one, F.lit(1)).join(F.broadcast(total), one).withColumn("percent", F.when(F.col(t) > 0, 100.0 * F.col("bytes") / F.col(t)).otherwise(0.0)).drop(t, one)


def estimate(classes: DataFrame, *, workers: int = 1, volume_size: int = fixed.VOLUME_SIZE, override: dict[str, float] | None = None) -> DataFrame:
    """Size and time of a package at every level, from files and bytes by class.

    Bytes are cut to whole numbers by class before they are added up.
    """
    spark = classes.sparkSession
    ratio = []
    for level, table in fixed.RATIOS.items():
        for c, (lo, hi) in table.items():
            if override and c in override:
                lo, hi = (override[c] * m for m in fixed.MARGIN)
            ratio.append((level, c, lo, hi, float(fixed.SPEED[level] if c in ("text", "binary") else fixed.STORED_SPEED)))
    dim = _dim(spark, ratio, "level int, class string, lo double, hi double, speed double")
    size = F.col("bytes").cast("double")
    sums = dim.join(classes, "class", "left").groupBy("level").agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("raw"),
        F.coalesce(F.sum(F.floor(size * F.col("lo"))), F.lit(0)).cast("long").alias("min_bytes"),
        F.coalesce(F.sum(F.floor(size * F.col("hi"))), F.lit(0)).cast("long").alias("max_bytes"),
        F.coalesce(F.sum(size / F.col("speed")), F.lit(0.0)).alias("_sec"),
    )
    volumes = F.expr(f"(max_bytes + {volume_size - 1}L) div {volume_size}L").cast("int")
    return sums.select("level", "raw", "min_bytes", "max_bytes", volumes.alias("volumes"), F.round(F.col("_sec") / max(workers, 1) * fixed.SERIAL_FACTOR, 6).alias("seconds"), F.lit(bool(override)).alias("sampled"))


def fits(estimates: DataFrame, free: int) -> DataFrame:
    return estimates.withColumns({"fits": F.col("max_bytes") <= free, "left_over": F.lit(free) - F.col("max_bytes")})
