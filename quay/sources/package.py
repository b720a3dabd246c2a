"""A package's tables, sums, manifest and journal on a store, through Spark's own writers (whose commit makes each write whole or absent)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "format int, id string, created timestamp, source struct<os: string, name: string, version: string, arch: string>, cipher string, level int, volumes int, files long, raw_bytes long, stored_bytes long, secrets_included boolean, complete boolean, tool string"


def write_tables(folder: str, entries: DataFrame, parts: DataFrame, blocks: DataFrame, located: DataFrame) -> None:
    """entries, parts and blocks as Parquet; blocks by volume, so a reader of some volumes prunes the rest."""
    entries.write.parquet(f"{folder}/entries")
    parts.write.parquet(f"{folder}/parts")
    blocks.join(located, "block_id").write.partitionBy("volume").parquet(f"{folder}/blocks")


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("entries", "parts", "blocks")}


def write_sums(sums: DataFrame, path: str) -> None:
    """``hash  name`` lines in order of name; one line for each file of a package's folder, so one part is enough."""
    sums.select("name", F.concat_ws("  ", "sha256", "name").alias("value")).orderBy("name").coalesce(1).select("value").write.text(path)


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    """``parsed_sums`` of a file."""
    return parsed_sums(spark.read.text(path))


def parsed_sums(texts: DataFrame) -> DataFrame:
    """name, sha256, bad of lines (value): those without two blanks or a hash of 64 digits are bad."""
    lines = texts.select(F.trim("value").alias("v")).where("v <> ''")
    sha, name = F.substring_index("v", "  ", 1), F.regexp_extract("v", "^.*?  (.*)$", 1)
    return lines.select(name.alias("name"), sha.alias("sha256"), (~F.col("v").contains("  ") | ~sha.rlike("^[0-9a-fA-F]{64}$")).alias("bad"))


def manifest(entries: DataFrame, located: DataFrame, blocks: DataFrame, *, package: str, os: str, level: int, complete: bool = True) -> DataFrame:
    """One row that tells nothing of names, paths or users."""
    counts = entries.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("raw_bytes"), F.coalesce(F.bool_or("secret"), F.lit(False)).alias("secrets_included")).withColumn("_one", F.lit(1))
    volumes = located.join(blocks, "block_id").agg(F.count_distinct("volume").cast("int").alias("volumes"), F.coalesce(F.sum("raw"), F.lit(0)).alias("stored_bytes")).withColumn("_one", F.lit(1))
    return counts.join(volumes, "_one").select(
        F.lit(1).alias("format"), F.lit(package).alias("id"), F.struct(F.lit(os).alias("os")).alias("source"), F.lit("none").alias("cipher"), F.lit(level).alias("level"),
        "volumes", "files", "raw_bytes", "stored_bytes", "secrets_included", F.lit(complete).alias("complete"),
    )


def write_manifest(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.json(path)


def read_manifest(spark: SparkSession, path: str, newest: int = 1) -> DataFrame:
    """The manifest with ``problem``: not a package, or of a newer format."""
    return judged(spark.read.schema(MANIFEST).option("multiLine", True).json(path), newest)


def manifests(texts: DataFrame, column: str, newest: int = 1) -> DataFrame:
    """The same of manifests that are JSON texts in a column, beside the other columns."""
    others = [c for c in texts.columns if c != column]
    return judged(texts.select(*others, F.from_json(column, MANIFEST).alias(column)).select(*others, f"{column}.*"), newest)


def judged(rows: DataFrame, newest: int) -> DataFrame:
    return rows.withColumn("problem", F.when(F.col("id").isNull(), "not a package").when(F.col("format") > newest, "newer format"))


def append_journal(lines: DataFrame, path: str) -> None:
    """Journal rows (t, n, bytes, sha256, at) as JSON lines behind what is there."""
    lines.write.mode("append").json(path)


def read_app_manifest(texts: DataFrame, newest: int = 1) -> DataFrame:
    """The application manifest (text) as rows: pos, app_id, name, config_only, of formats up to ``newest``."""
    kind = "format int, os string, apps array<struct<id: string, name: string, config_only: boolean>>"
    doc = texts.select(F.from_json("text", kind).alias("d")).where(F.col("d.format") <= newest)
    return doc.select(F.posexplode("d.apps").alias("pos", "a")).select(F.col("pos").cast("long").alias("pos"), F.col("a.id").alias("app_id"), "a.name", F.coalesce("a.config_only", F.lit(False)).alias("config_only"))
