"""Integrity of packages: sums, volumes, blocks, the journal, reassembly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quay.functions import local


def check_sums(sums: DataFrame, files: DataFrame) -> DataFrame:
    """Problems (name, problem) between ``sums`` (name, sha256) and ``files`` (name, sha256; null where a file can't be read)."""
    both = sums.withColumnRenamed("sha256", "want").join(files.select("name", F.col("sha256").alias("have"), F.lit(True).alias("there")), "name", "full_outer")
    problem = F.when(F.col("want").isNotNull() & F.col("have").isNull(), "unreadable").when(F.col("want") != F.col("have"), "checksum mismatch").when(F.col("want").isNull(), "not in the sums")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def missing_volumes(volumes: DataFrame, sums: DataFrame, pattern: str = "volumes/%05d.vol") -> DataFrame:
    """Volumes of the index whose file the sums do not list."""
    named = volumes.select("volume", F.format_string(pattern, "volume").alias("name"))
    return named.join(sums.select("name"), "name", "left_anti")


def check_trailers(streams: DataFrame, index: DataFrame) -> DataFrame:
    """Volumes whose blocks in the stream, the trailer and the index differ: volume, in_stream, in_trailer, in_index."""
    both = streams.join(index, "volume", "full_outer")
    return both.where("not (in_stream <=> in_trailer and in_stream <=> in_index)").select("volume", "in_stream", "in_trailer", "in_index")


def check_headers(headers: DataFrame, *, magic: str, newest: int) -> DataFrame:
    """Problems of volume headers (volume, magic, format, package, number) of a package whose id is ``package_id``."""
    problem = F.when(F.col("magic") != magic, "not a volume").when(F.col("format") > newest, "newer format").when(F.col("package") != F.col("package_id"), "other package").when(F.col("number") != F.col("volume"), "wrong number")
    return headers.select("volume", problem.alias("problem")).where("problem is not null")


#: What the fields of a journal line must be, as far as a line has them.
JOURNAL = {"t": "STRING", "n": "BIGINT", "bytes": "BIGINT", "sha256": "STRING", "at": "STRING"}
#: A time as RFC 3339 has it.
TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"


def is_journal_line(text: Column) -> Column:
    """Whether a text is a JSON object (or null) whose known fields have the journal's types or are null."""
    # the parser stops behind a first value: in both kinds of brackets no more than one value can stand
    listed, held = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}")))
    line = F.when(held.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull(), F.try_variant_get(listed, "$[0]", "variant"))
    whole = F.schema_of_variant(line)
    good = whole.startswith("OBJECT<") | (whole == "VOID")
    for name, kind in JOURNAL.items():
        found = F.schema_of_variant(F.try_variant_get(line, f"$.{name}", "variant"))
        good = good & (found.isNull() | found.isin(kind, "VOID"))
    number = F.try_variant_get(line, "$.n", "long")
    good = good & (number.isNull() | number.between(0, 2**32 - 1))
    at, digest = (F.try_variant_get(line, f"$.{x}", "string") for x in ("at", "sha256"))
    good = good & (at.isNull() | at.rlike(TIME)) & (digest.isNull() | digest.rlike("^[0-9a-fA-F]{64}$"))
    return line.isNotNull() & F.coalesce(good, F.lit(False))


def journal_prefix(lines: DataFrame) -> DataFrame:
    """The journal (line, text) up to its first line that is none; blank lines are passed over.

    The first such line is one aggregate, so no window runs over the whole journal.
    """
    torn, one = local.free(lines, "torn", "one")
    full = F.trim(F.coalesce("text", F.lit(""))) != ""
    first = lines.where(full & ~is_journal_line(F.col("text"))).agg(F.min("line").alias(torn)).withColumn(one, F.lit(1))
    kept = lines.where(full).withColumn(one, F.lit(1)).join(F.broadcast(first), one, "left")
    return kept.where(F.col(torn).isNull() | (F.col("line") < F.col(torn))).select(*lines.columns)


def incomplete(manifests: DataFrame) -> DataFrame:
    """(id, problem) of packages whose manifest says that writing was not finished."""
    return manifests.where(~F.coalesce("complete", F.lit(False))).select("id", F.lit("incomplete").alias("problem"))


def verify_counts(blocks: DataFrame, located: DataFrame) -> DataFrame:
    return blocks.join(located, "block_id").agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("raw"), F.lit(0)).alias("bytes"), F.count_distinct("volume").alias("volumes"))


def reassemble(parts: DataFrame, content: DataFrame, files: DataFrame) -> DataFrame:
    """seq and status (ok, damaged, incomplete) of files from their parts (seq, block_id, off, len, n) and blocks' bytes (block_id, data).

    A file's pieces are hashed one after the other as they stream by, so no file is ever held as a whole; a damaged or missing block fails only its files.
    """
    pieces = parts.join(content.select("block_id", "data"), "block_id", "left").select(F.col("seq").cast("long").alias("seq"), "n", F.expr("substring(data, cast(off + 1 as int), cast(len as int))").alias("piece"))
    whole = pieces.repartition("seq").sortWithinPartitions("seq", "n").select("seq", "piece").mapInArrow(_hashed, "seq long, length long, digest string, gone boolean")
    digest, gone, length = local.free(files, "digest", "gone", "length")
    joined = files.select("seq", "size", "sha256").join(whole.select("seq", F.col("digest").alias(digest), F.col("gone").alias(gone), F.col("length").alias(length)), "seq", "left")
    empty = F.col(gone).isNull() & (F.col("size") == 0) & (F.col("sha256") == F.sha2(F.lit(""), 256))
    good = (F.col(length) == F.col("size")) & (F.col(digest) == F.col("sha256"))
    return joined.select("seq", F.when(F.col(gone) | (F.col(gone).isNull() & (F.col("size") > 0)), "incomplete").when(good | empty, "ok").otherwise("damaged").alias("status"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, length, digest, gone) of runs of pieces (seq, piece); gone: a piece is missing."""
    now, length, gone, hasher = None, 0, False, hashlib.sha256()
    out: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)], ["seq", "length", "digest", "gone"])

    for batch in batches:
        for seq, piece in zip(batch.column("seq").to_pylist(), batch.column("piece"), strict=True):
            if seq != now:
                if now is not None:
                    out.append((now, length, hasher.hexdigest(), gone))
                now, length, gone, hasher = seq, 0, False, hashlib.sha256()
            if piece.is_valid:
                data = piece.as_buffer()
                hasher.update(data)
                length += len(data)
            else:
                gone = True
        if out:
            yield made()
            out = []
    if now is not None:
        out.append((now, length, hasher.hexdigest(), gone))
        yield made()


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """Adds ``data`` and ``ok`` to blocks (block_id, codec, raw, sha256, stored): decoded length and hash must agree."""
    from quay.functions.codecs import decompress

    data = decompress(F.col("codec"), F.col("stored"), F.col("raw"))
    rows = blocks.withColumn("data", data)
    return rows.withColumn("ok", F.coalesce((F.octet_length("data") == F.col("raw")) & (F.sha2("data", 256) == F.col("sha256")), F.lit(False)))
