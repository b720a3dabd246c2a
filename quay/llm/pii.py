"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are what four patterns find: e-mail and IP addresses, card and phone numbers. The words beside an identifier are lexical patterns
(the word to the left, to the right, both). Patterns and instances form a graph that is scored in rounds: a pattern's confidence for a
kind is the mean score of its instances, an instance's score what its confident patterns say together. Instances are all words
with a digit or an at sign, so a pattern that also stands beside other numbers stays weak; numbers that are written with blanks or
brackets in them are one instance each. At the end, what stands beside a pattern of
high confidence and has the kind's shape is personal data too, though no seed pattern matches it. What a round finds so
supports further patterns in the next, as seeds do.

The seed patterns are written so that matching is linear in the text (possessive, and starting where a run of characters starts), with
the same matches as the plain forms. Spark gives no positions of matches, so they follow from the lengths of the matches and of the
pieces between them.

Defined cases: null text counts as empty and has no spans; repeated rows are searched each, and an identifier that repeats counts once in the
graph; a null doc_id is returned as null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quay.llm import shared

KINDS = ("email", "ip", "card", "phone")
#: Seed patterns as Java regular expressions.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A word with a digit or an at sign.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Digits that belong to a run: not to a word with letters (but for an extension), a short date or time, or an address.
_DIGITS = r"(?![0-9]{1,2}[/:][0-9])[0-9]++(?!(?!x[0-9])[\p{L}_])(?![^\s@]{0,64}+@)"
#: A maximal run of digits with blanks, brackets, points and hyphens between them.
RUN = rf"(?:(?<![0-9])[+(]|(?<![\p{{L}}0-9_@(+]))(?<![0-9][().:/-]){_DIGITS}(?:[ ().-]++{_DIGITS})*+"
#: Beside other numbers in a run: four or more numbers with points, which are an address of their own.
POINTED = r"(?:^|[ (])[0-9]++(?:\.[0-9]++){3,7}(?![.0-9-])"
#: What is not part of a word at its edges.
EDGES = ".,;:!?\"'()[]{}<>"
#: Shapes that an unseen identifier of a kind may have.
SHAPES = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^[0-9A-Fa-f]+([.:][0-9A-Fa-f]*){3,7}$",
    "card": r"^([0-9][ -]?){12,19}$",
    "phone": r"^[+(]?[0-9]([ ().-]*[0-9]){6,14}$",
}
#: Code points beside a span in which its neighbour words are looked for.
REACH = 64
#: Code points of a piece of a text: what stands at a place is looked for in its piece, not from the text's beginning.
PIECE = 4096
#: Pieces in a group.
GROUP = 16
#: Matches whose positions are added up in one run.
RUN_LENGTH = 64


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(x)
    one = lambda i: F.substring(x, i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when((n - i) % 2 == 0, one(i)).otherwise(twice(one(i)))) % 10 == 0


def valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(digits(x)).between(13, 19) & F.when(F.length(digits(x)).between(13, 19), luhn(digits(x))).otherwise(False)
    if kind == "phone":
        return F.length(digits(x)).between(9, 15)
    return F.lit(True)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where it is used within a function over array elements: the optimizer moves no column in there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern as structs (start, end, value), in code points.

    Positions are sums of lengths: first of each run of RUN_LENGTH matches, then within the runs, so no array is copied once for each match.
    """
    kind = "array<struct<start: int, end: int, value: string>>"
    hits, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.arrays_zip(hits.alias("hit"), F.slice(between, F.lit(1), F.size(hits)).alias("gap"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value")))).alias("out"))

    def inside(run: Column, at: Column) -> Column:
        return F.aggregate(run, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])

    def runs(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(all_) - 1) / RUN_LENGTH).cast("int")), lambda k: F.slice(all_, k * RUN_LENGTH + 1, F.lit(RUN_LENGTH)))

    def bases(parts: Column) -> Column:
        """Where each run begins."""
        length = lambda run: F.aggregate(run, F.lit(0), lambda acc, x: acc + F.length(x["gap"]) + F.length(x["hit"]))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(parts, start, lambda acc, run: F.struct((acc["at"] + length(run)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    many = lambda parts: F.flatten(F.transform(F.arrays_zip(parts.alias("run"), bases(parts).alias("at")), lambda x: inside(x["run"], x["at"])))
    return let(both, lambda all_: F.when(F.size(all_) <= RUN_LENGTH, inside(all_, F.lit(0))).otherwise(let(runs(all_), many)))


def pieces_of(text: Column) -> Column:
    """The text in pieces of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(pieces: Column, start: Column, end: Column) -> Column:
    """The code points [start, end) of a text in pieces, at most PIECE of them."""
    first = (start / PIECE).cast("int")
    one = F.coalesce(F.try_element_at(pieces, first + 1), F.lit(""))
    both = F.when(end > (first + 1) * PIECE, F.concat(one, F.coalesce(F.try_element_at(pieces, first + 2), F.lit("")))).otherwise(one)
    return F.substring(both, start - first * PIECE + 1, end - start)


def by_piece(spans: Column, pieces: Column) -> Column:
    """For each piece the spans that reach into it; they are dealt to groups of pieces first."""

    def within(some: Column, size: int):
        return lambda k: F.filter(some, lambda b: (b["start"] < (k + 1) * size) & (b["end"] > k * size))

    groups = F.transform(F.sequence(F.lit(0), F.greatest(((F.size(pieces) - 1) / GROUP).cast("int"), F.lit(0))), within(spans, GROUP * PIECE))
    return let(groups, lambda all_: F.transform(pieces, lambda _, k: within(F.element_at(all_, (k / GROUP).cast("int") + 1), PIECE)(k)))


def worded(near: Column) -> Column:
    """White space as blanks, and blanks for what between it is of ``EDGES`` alone."""
    return F.regexp_replace(F.regexp_replace(near, r"\s", " "), rf"(?<![^ ])[{re.escape(EDGES)}]++(?![^ ])", " ")


def neighbour(pieces: Column, start: Column, end: Column, left: bool) -> Column:
    """The word before or behind a span, in lower case and without its edges; empty where there is none."""
    if left:
        near = between(pieces, F.greatest(start - REACH, F.lit(0)), start)
        word = F.element_at(F.split(F.rtrim(worded(near)), " "), -1)
    else:
        near = between(pieces, end, end + REACH)
        word = F.element_at(F.split(F.ltrim(worded(near)), " "), 1)
    return F.lower(F.btrim(word, F.lit(EDGES)))


def found(docs: DataFrame) -> DataFrame:
    """One row per document: row, doc_id, base (spans with their kind's number) and seen: base spans and candidates (runs of digits, other words) with neighbours."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    none = F.array().cast("array<struct<start: int, end: int, value: string>>")
    text = F.col("text")
    digit, at = F.col("_digit"), F.col("_at")
    needs = {"email": at, "ip": digit & text.contains("."), "card": digit, "phone": digit & text.contains("+")}
    rows = rows.withColumn("_at", text.contains("@")).withColumn("_digit", text.rlike("[0-9]"))

    def passing(kind: str) -> Column:
        return F.filter(F.when(needs[kind], located(text, PATTERNS[kind])).otherwise(none), lambda x: valid(kind, x["value"]))

    def numbered(kind: str) -> Column:
        number = F.lit(KINDS.index(kind))
        return F.transform(kind, lambda x: F.struct(number.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    rows = rows.withColumns({k: passing(k) for k in KINDS})
    base = F.concat(*map(numbered, KINDS))
    rows = rows.withColumn("base", base).withColumn("words", F.when(at | digit, located(text, CANDIDATE)).otherwise(none))
    rows = rows.withColumn("pieces", F.when((F.size("words") > 0) | (F.size("base") > 0), pieces_of(text)))
    pieces = F.col("pieces")

    def blanked(piece: Column, k: Column, spans: Column) -> Column:
        """The piece with line ends where spans are."""
        low, high = lambda b: F.greatest(b["start"] - k * PIECE, F.lit(0)), lambda b: F.least(b["end"] - k * PIECE, F.length(piece))
        return F.aggregate(spans, piece, lambda acc, b: F.concat(F.substring(acc, F.lit(1), low(b)), F.repeat(F.lit("\n"), high(b) - low(b)), F.substring(acc, high(b) + 1, F.lit(PIECE))))

    # runs end where a base span begins
    zipped = F.arrays_zip(pieces.alias("p"), by_piece(F.col("base"), pieces).alias("b"))
    hidden = F.array_join(F.transform(zipped, lambda x, k: blanked(x["p"], k, x["b"])), "")
    rows = rows.withColumn("_left", F.when(digit, F.when(F.size("base") > 0, hidden).otherwise(text)))

    def run(w: Column) -> Column:
        """The run without an opening bracket that only its surroundings close."""
        lead = F.when(w["value"].startswith("(") & ~w["value"].contains(")"), 1).otherwise(0)
        return F.struct(F.lit(-1).alias("kind"), (w["start"] + lead).alias("start"), w["end"].alias("end"), F.substring(w["value"], lead + 1, F.length(w["value"])).alias("value"))

    def whole(w: Column) -> Column:
        """Whether a run has the shape of one identifier; else its words are candidates."""
        return (w["value"].rlike(SHAPES["phone"]) | w["value"].rlike(SHAPES["card"])) & ~(w["value"].contains(" ") & w["value"].rlike(POINTED))

    rows = rows.withColumn("runs", F.filter(F.transform(F.when(digit, located(F.col("_left"), RUN)).otherwise(none), run), whole))

    def bare(w: Column) -> Column:
        lead = F.length(w["value"]) - F.length(F.ltrim(w["value"], F.lit(EDGES)))
        core = F.btrim(w["value"], F.lit(EDGES))
        return F.struct(F.lit(-1).alias("kind"), (w["start"] + lead).alias("start"), (w["start"] + lead + F.length(core)).alias("end"), core.alias("value"))


    def apart(w: Column, taken: Column) -> Column:
        """Whether a word is not in a span that is known; ``taken``: those by piece."""
        first = (w["start"] / PIECE).cast("int")
        near = F.slice(taken, first + 1, ((w["end"] - 1) / PIECE).cast("int") - first + 1)
        return (w["value"] != "") & ~F.exists(near, lambda spans: F.exists(spans, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))

    left_over = let(by_piece(F.concat("base", "runs"), pieces), lambda taken: F.filter(F.transform("words", bare), lambda w: apart(w, taken)))
    every = F.concat("base", "runs", left_over)

    def beside(x: Column, parts: Column) -> Column:
        return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), neighbour(parts, x["start"], x["end"], True).alias("left"), neighbour(parts, x["start"], x["end"], False).alias("right"))

    seen = let(pieces, lambda parts: F.transform(every, lambda x: beside(x, parts)))
    rows = rows.withColumn("seen", F.when(F.size("words") + F.size("base") + F.size("runs") > 0, seen))
    plain = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", plain.alias("base"), "seen")


def occurrences(table: DataFrame) -> DataFrame:
    """A row for each span of ``seen`` and each of its lexical patterns."""
    one = table.where("seen is not null").select("row", F.explode("seen").alias("s")).select("row", "s.*")
    pattern = F.array(F.concat(F.lit("L "), F.col("left")), F.concat(F.lit("R "), F.col("right")), F.concat_ws(" ", F.lit("B"), "left", "right"))
    return one.withColumn("pattern", F.explode(pattern)).where("not (pattern in ('L ', 'R ') or (pattern like 'B %' and (left = '' or right = '')))")


def has_shape(value: str, kind: str) -> Column:
    """Whether a column of values has the shape of the kind whose number another column holds."""
    found = F.lit(False)
    for i, k in enumerate(KINDS):
        found = found | ((F.col(kind) == i) & F.col(value).rlike(SHAPES[k]))
    return found


def scored(edges: DataFrame, *, rounds: int, confident: float, support: int) -> DataFrame:
    """(pattern, kind, confidence) of the confident patterns. ``edges``: pattern, value, kind (-1: no seed), each once.

    Sums over patterns and over values are partial aggregates, so a pattern or value that is everywhere is no hot spot.
    """
    totals = edges.groupBy("pattern").agg(F.countDistinct("value").alias("total"))
    seeds = edges.where("kind >= 0").select("pattern", "value", "kind", F.lit(1.0).alias("score"), F.lit(1).alias("seed"))
    fresh = edges.where("kind < 0").select("pattern", "value")
    known = seeds
    for k in range(rounds):
        sums = known.groupBy("pattern", "kind").agg(F.sum("score").alias("score"), F.sum("seed").alias("seeds"))
        patterns = sums.where(F.col("seeds") >= support).join(totals, "pattern").select("pattern", "kind", (F.col("score") / F.col("total")).alias("confidence")).where(F.col("confidence") >= confident)
        patterns = shared.stored(patterns, "patterns")
        if k == rounds - 1:
            return patterns
        # a value's score: that not all its confident patterns are wrong
        value = fresh.join(patterns, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("score"))
        value = value.withColumn("seed", ((F.col("score") >= confident) & has_shape("value", "kind")).cast("int"))
        both = seeds.unionByName(fresh.join(value, "value").select("pattern", "value", "kind", "score", "seed"))
        # a value that is a seed in one place and none in another counts once
        known = both.groupBy("pattern", "value", "kind").agg(F.max("score").alias("score"), F.max("seed").alias("seed"))
    raise ValueError("rounds must be at least 1")


def extract(docs: DataFrame, *, rounds: int = 3, confident: float = 0.8, support: int = 5) -> DataFrame:
    """One row per document: doc_id, base and spans, arrays of (kind, start, end) in order of kind and start.

    A pattern needs ``support`` different seeds beside it, or from the second round on instances of so high a score, and a confidence of at least ``confident``.
    """
    table = shared.stored(found(docs), "spans")
    all_seen = shared.stored(occurrences(table), "seen")
    edges = all_seen.select("pattern", "value", "kind").distinct()
    patterns = scored(edges, rounds=rounds, confident=confident, support=support)
    new = all_seen.where("kind < 0").join(patterns.withColumnRenamed("kind", "of"), "pattern").where(has_shape("value", "of"))
    best = new.groupBy("row", "start", "end").agg(F.max(F.struct("confidence", (-F.col("of")).alias("minus"))).alias("best"))
    added = best.select("row", F.struct((-F.col("best.minus")).alias("kind"), "start", "end").alias("span")).groupBy("row").agg(F.collect_list("span").alias("added"))
    joined = table.select("row", "doc_id", "base").join(added, "row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind: int, start: int, end: int>>"))))
    return joined.select("doc_id", F.array_sort("base").alias("base"), every.alias("spans"))


def count_of(spans: Column, kind: str) -> Column:
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
