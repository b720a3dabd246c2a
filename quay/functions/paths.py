"""Functions of paths and names, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quay.functions import fixed


def base_name(path: Column) -> Column:
    """What follows the last / or \\."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, r"[/\\]"), lambda s: s != "")


def last_ext(name: Column) -> Column:
    """What follows the last dot, lower-cased; null without a dot."""
    return F.when(name.contains("."), F.lower(F.regexp_extract(name, r"([^.]*)$", 1)))


def with_suffix(path: Column, suffix: Column) -> Column:
    """The suffix before the extension; a leading dot starts no extension."""
    folder = F.regexp_extract(path, r"^((?:.*/)?)[^/]*$", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)
    return F.when(stem == "", F.concat(path, suffix)).otherwise(F.concat(folder, stem, suffix, F.substring(name, F.length(stem) + 1, F.length(name))))


def _clean_windows(seg: Column) -> Column:
    plain = F.regexp_replace(seg, '[\\x00-\\x1f<>:"\\\\|?*�]', "_")
    bare = F.rtrim(plain, F.lit(". "))
    filled = F.when(bare == "", "_").otherwise(bare)
    stem = F.when(F.instr(filled, ".") > 1, F.substring_index(filled, ".", 1)).otherwise(filled)
    return F.when(F.lower(stem).isin(fixed.RESERVED_NAMES), F.concat(F.lit("_"), filled)).otherwise(filled)


def sanitize(rel: Column, os: Column) -> Column:
    """A relative path that the target system accepts."""

    def clean(seg: Column) -> Column:
        other = F.when(os == "windows", _clean_windows(seg)).otherwise(F.translate(seg, "\x00", "_"))
        return F.when((seg == "") | (seg == "."), seg).when(seg == "..", "_..").otherwise(other)

    return F.array_join(F.transform(F.split(rel, "/"), clean), "/")


def fold_key(rel: Column, os: Column) -> Column:
    return F.when(os == "windows", F.lower(rel)).otherwise(rel)


def other_key(path: Column, os: Column) -> Column:
    """An absolute path as a key: forward slashes, no drive colon, no leading slash."""
    drive = F.regexp_replace(F.translate(path, "\\", "/"), r"^([A-Za-z]):", "$1")
    return F.regexp_replace(F.when(os == "windows", drive).otherwise(path), "^/+", "")


def app_root(app_id: Column, key: Column, variant: Column) -> Column:
    return F.concat(F.lit("apps/"), app_id, F.lit("/"), key, F.when(variant != "", F.concat(F.lit("@"), variant)).otherwise(""))


def split_app_root(root: Column) -> Column:
    """struct(id, key, variant), null for a root that is not an application's."""
    part = lambda k: F.regexp_extract(root, r"(?s)^apps/([^/]+)/(?=.)([^@]*)(?:@(.*))?$", k)
    return F.when(root.rlike(r"(?s)^apps/[^/]+/."), F.struct(part(1).alias("id"), part(2).alias("key"), part(3).alias("variant")))


def under(path: Column, folder: Column) -> Column:
    """The path relative to a folder, "." for the folder itself, null outside."""
    return F.when(path == folder, ".").when(F.startswith(path, F.concat(folder, F.lit("/"))), F.substring(path, F.length(folder) + 2, F.length(path)))


def ancestors(path: Column) -> Column:
    """The path and all folders above it, without the root: makes a longest-prefix match an equi join."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


#: What a glob is made of: a bracket, an escape, any other character.
GLOB_TOKEN = r"(?s)\[\^?+(?:\\.|[^\]\\])+\]|\\.|."
#: Punctuation that may have a meaning in a regular expression.
_PUNCTUATION = r"([!-/:-@\[-`{-~])"


def _plain(c: Column) -> Column:
    """A character for a regular expression, without any meaning."""
    return F.regexp_replace(c, _PUNCTUATION, r"\\$1")


def glob_regex(pattern: Column) -> Column:
    """A glob (*, ?, [..], [^..], backslash escapes) as an anchored regular expression: * and ? don't cross a slash."""

    def bracket(t: Column) -> Column:
        inside = F.regexp_extract(t, r"(?s)^\[\^?(.*)\]$", 1)
        member = lambda m: F.when(m == "-", "-").when(m.startswith("\\"), _plain(F.substring(m, 2, 1))).otherwise(_plain(m))
        members = F.array_join(F.transform(F.regexp_extract_all(inside, F.lit(r"(?s)\\.|."), F.lit(0)), member), "")
        return F.concat(F.when(t.startswith("[^"), "[^").otherwise("["), members, F.lit("]"))

    def one(t: Column) -> Column:
        return (
            F.when(t == "*", "[^/]*").when(t == "?", "[^/]").when((F.length(t) > 1) & t.startswith("["), bracket(t))
            .when((F.length(t) > 1) & t.startswith("\\"), _plain(F.substring(t, 2, 1))).otherwise(_plain(t))
        )

    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(F.regexp_extract_all(pattern, F.lit(GLOB_TOKEN), F.lit(0)), one), ""), F.lit("$"))


def glob_valid(pattern: Column) -> Column:
    """Whether brackets close, hold something, have whole ranges, and no escape hangs."""
    found = F.regexp_extract_all(pattern, F.lit(GLOB_TOKEN), F.lit(0))
    bad_range = r"(?s)^\[\^?(?:(?:\\.|[^\\])-(?:\\.|[^\\-])|(?:\\.|[^\\-]))*-\]$|^\[\^?-"
    return ~F.exists(found, lambda t: t.isin("[", "\\") | t.rlike(bad_range))


def human_bytes(n: Column) -> Column:
    """1536 as 1,5 KiB: steps of 1024, a decimal comma below 100."""
    size = F.abs(n)
    out = F.format_string("%d B", size)
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        value = size.cast("double") / float(1024**i)
        shown = F.when(value >= 100, F.format_string("%.0f", F.bround(value, 0))).otherwise(F.translate(F.format_string("%.1f", F.bround(value, 1)), ".", ","))
        out = F.when(size >= 1024**i, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 0, F.concat(F.lit("−"), out)).otherwise(out)


def human_range(lo: Column, hi: Column) -> Column:
    return F.when(lo == hi, human_bytes(lo)).otherwise(F.concat(human_bytes(lo), F.lit(" – "), human_bytes(hi)))


def human_count(n: Column) -> Column:
    """412883 as 412 883."""
    spaced = F.regexp_replace(F.abs(n).cast("string"), r"(?<=[0-9])(?=([0-9]{3})+$)", " ")
    return F.when(n < 0, F.concat(F.lit("−"), spaced)).otherwise(spaced)


def human_duration(ns: Column) -> Column:
    """Nanoseconds as a rough duration."""
    sec, minutes = F.floor(ns / 1e9 + 0.5).cast("long"), F.floor(ns / 6e10 + 0.5).cast("long")
    hours = F.floor(ns / 3.6e12).cast("long")
    left = minutes - hours * 60
    long = F.when(left == 0, F.format_string("~%d h", hours)).otherwise(F.format_string("~%d h %d min", hours, left))
    return F.when(ns < 1e9, "under a second").when(ns < 6e10, F.format_string("~%d sec", sec)).when(ns < 3.6e12, F.format_string("~%d min", minutes)).otherwise(long)


def pad(text: Column, width: int) -> Column:
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))


#: Fixed value: characters that a passphrase has at least, without white space at its ends.
LEAST_PASSPHRASE = 8


def passphrase_ok(text: Column) -> Column:
    """Whether a passphrase is long enough to encrypt with."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")) >= LEAST_PASSPHRASE
