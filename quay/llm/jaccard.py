"""N-gram Jaccard join: size-aware, heavy and light.

Documents are sets of shingles of five words; two link when their Jaccard similarity is at least 0.8. Equal sets are one class from the
start. The classes are split by size:

* light (small) sets enumerate their subsets of each fixed size that a partner may share; all who hold one subset of c shingles meet at it,
  and the smallest of them links exactly those sets that c shared shingles suffice for, so no pair is listed twice and
  nothing needs checking;
* heavy (large) sets scan inverted lists: only of the rarest fifth of their shingles, and only of shingles that a second document holds.

The boundary is the size up to which enumeration costs less than the lists, both counted over the data.

A list is not turned into all its pairs. Rounds take pivots from every list, from its largest component first, and compare each with those of
its list that are in other components; a list closes when all that is left of it is one component, so every link between
different components is found, however long the list. Comparing uses the exact shared shingles.

Defined cases: null or empty text and text of white space only have an empty set and link with nothing; texts of fewer than five words are one
shingle; rows with one doc_id are one document whose links are joined; a null doc_id counts as the least 64-bit integer and is
returned as null; an empty table gives no rows; other columns are ignored by ``classes`` and kept by ``kept_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quay.llm import columns, graph, keycounts, shared

WIDTH = 5
NO_ID = -(2**63)
#: Sizes for which enumeration is weighed against the lists.
MOST_LIGHT = 15
#: Shingles of all sets that are compared in one group, about: some 8 MB.
BUCKET_SHINGLES = 1_500_000
#: Pairs of a list that one task looks at, about.
LOOKS = 1_000_000
#: Members of subsets that are listed at a time.
SUBSETS = 1_000_000
#: Words of a block: its shingles are twice as wide as words, and sorted.
BLOCK_WORDS = 1_000_000
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def least_overlap(n: int) -> int:
    """What a set of n shares at least with any set it links with: ceil(0.8 n)."""
    return -(-4 * n // 5)


def sets(block: keycounts.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle keys of the block, ascending; documents' sets as places in them, with their bounds."""
    h, n = block.hashes[block.words], np.diff(block.bounds)
    doc = np.repeat(np.arange(len(n)), n)
    if len(h) >= WIDTH:
        m = len(h) - WIDTH + 1
        code = np.zeros(m, np.uint64)
        for k in range(WIDTH):
            code += columns.mixed(h[k : k + m] + FACTORS[k]) * FACTORS[k]
        inside = doc[:m] == doc[WIDTH - 1 :]
        code, owner = columns.mixed(code[inside]), doc[:m][inside]
    else:
        code, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < WIDTH))
    if len(short):
        own = [columns.mixed(np.array([sum(int(x) * int(FACTORS[k]) for k, x in enumerate(h[block.bounds[i] : block.bounds[i + 1]])) + int(n[i]) & (2**64 - 1)], np.uint64))[0] for i in short]
        code, owner = np.concatenate((code, np.array(own, np.uint64))), np.concatenate((owner, short))
    keys, place = np.unique(code, return_inverse=True)
    both = np.unique((owner.astype(np.int64) << 32) | place)
    return keys, both & 0xFFFFFFFF, np.searchsorted(both >> 32, np.arange(len(n) + 1))


def short_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper 48 bits of the keys, distinct, and where each key's are. Shingles are only ranked by what is counted for these: a
    clash makes a count too large, never too small."""
    upper = (keys >> np.uint64(16)) << np.uint64(16)
    new = np.concatenate(([True], upper[1:] != upper[:-1])) if len(upper) else np.zeros(0, bool)
    return upper[new], np.cumsum(new) - 1


SIGNED = "block string, path string, pos int, doc_id long, n long, hi long, lo long"


def signed(docs: DataFrame, folder: str) -> DataFrame:
    """Set sizes and 128-bit signatures of all documents, and where their words are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        for k, block in enumerate(keycounts.blocks(batches, BLOCK_WORDS)):
            name = f"{task.partitionId()}-{k}"
            path = f"{folder}/{name}-{task.taskAttemptId()}"
            block.save(path)
            keys, member, bounds = sets(block)
            n = np.diff(bounds)
            hi = columns.sums(columns.mixed(keys)[member], bounds) + n.astype(np.uint64)
            lo = columns.sums(columns.mixed(keys ^ FACTORS[1])[member], bounds)
            ids = np.where(block.null_ids.astype(bool), NO_ID, block.ids)
            yield pa.RecordBatch.from_pydict({
                "block": [name] * len(n), "path": [path] * len(n), "pos": pa.array(range(len(n)), pa.int32()), "doc_id": pa.array(ids), "n": pa.array(n),
                "hi": pa.array(hi.view(np.int64)), "lo": pa.array(lo.view(np.int64)),
            })

    return docs.mapInArrow(run, SIGNED)


def asked(reps: DataFrame, folder: str, bits: int) -> DataFrame:
    """What blocks ask for their class representatives alone, so that copies do not make a shingle look frequent."""

    def run(table: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        name = table.column("block")[0].as_py()
        path = f"{folder}/{name}-{TaskContext.get().taskAttemptId()}"
        block = keycounts.Block.load(table.column("path")[0].as_py()).take(np.sort(table.column("pos").to_numpy()))
        block.save(path)
        return pa.Table.from_batches([keycounts.asked(name, path, *request(block), bits)])

    return keycounts.dealt(reps.select("block", "path", "pos"), "block").groupBy("block").applyInArrow(run, keycounts.REQUEST)


def request(block: keycounts.Block) -> tuple[np.ndarray, np.ndarray]:
    keys, member, _ = sets(block)
    upper, at = short_keys(keys)
    return upper, np.bincount(at[member], minlength=len(upper))


#: Words of 64 bits in a set's parity bitmap.
BITMAP = 8
BITS = [f"b{i}" for i in range(BITMAP)]
SET_SCHEMA = f"cid long, n long, {', '.join(f'{b} long' for b in BITS)}, prefix array<struct<key: long, pos: long>>, cost long, common binary"


def parities(keys: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """A row of BITMAP words for each set: the bit that a shingle's key names is flipped once for each shingle. Two sets differ in at least as many shingles
    as their bitmaps in bits."""
    flat = np.zeros(docs * BITMAP, np.uint64)
    slot = keys & np.uint64(64 * BITMAP - 1)
    np.bitwise_xor.at(flat, doc * BITMAP + (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
    return flat.view(np.int64).reshape(docs, BITMAP)


def described(block: keycounts.Block, counts: np.ndarray) -> pa.Table:
    """Of sets that may have a partner: the rarest shared shingles with their places in the set's order, and all shared ones."""
    keys, member, bounds = sets(block)
    _, at = short_keys(keys)
    df = counts[at].astype(np.int64) if len(keys) else np.zeros(0, np.int64)
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    ours = df[member] >= 2
    alone = np.bincount(doc[~ours], minlength=len(n))  # these come first in the set's order and lead to nobody
    room = n + (-4 * n // 5) + 1 - alone
    at = np.flatnonzero(ours & (room[doc] > 0))
    who, what = doc[at], member[at]
    edges = np.searchsorted(who, np.arange(len(n) + 1))
    order = np.lexsort((what, df[what], who))
    rank = np.arange(len(at)) - edges[who]
    taken = rank < room[who]
    first = order[taken]  # the order keeps documents together, so ranks line up
    cuts = np.concatenate(([0], np.cumsum(np.minimum(np.maximum(room, 0), np.diff(edges)))))
    spots = pa.StructArray.from_arrays([pa.array(keys[what[first]].view(np.int64)), pa.array((alone[who] + rank)[taken])], ["key", "pos"])
    full = np.diff(edges) > 0
    common = [keycounts.squeeze_sorted(keys[what[a:b]]) for a, b in zip(edges[:-1][full].tolist(), edges[1:][full].tolist(), strict=True)]
    ids = np.where(block.null_ids.astype(bool), NO_ID, block.ids)
    bits = parities(keys[member], doc, len(n))
    out = pa.Table.from_pydict({
        "cid": pa.array(ids), "n": pa.array(n), **{b: pa.array(np.ascontiguousarray(bits[:, i])) for i, b in enumerate(BITS)}, "prefix": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spots), "cost": pa.array(columns.sums(df[what[first]], cuts)),
    })
    return out.filter(pa.array(full)).append_column("common", pa.array(common, pa.binary()))


# -- light sets ----------------------------------------------------------------------------------------------------------


def enumerations(n: int) -> int:
    return sum(comb(n, c) for c in range(least_overlap(n), n + 1))


def boundary(reps: DataFrame) -> int:
    """The largest size up to which enumerating subsets costs less than scanning lists."""
    costs = {r.n: (r.sets * enumerations(r.n), r.cost) for r in reps.where(F.col("n") <= MOST_LIGHT).groupBy("n").agg(F.count(F.lit(1)).alias("sets"), F.sum("cost").alias("cost")).collect()}
    best, listing, scanning = 0, 0, 0
    for n in range(1, MOST_LIGHT + 1):
        a, b = costs.get(n, (0, 0))
        listing, scanning = listing + a, scanning + b
        if listing <= scanning:
            best = n
    return best


def subsets(cid: np.ndarray, n: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All subsets that a partner may share of sets of one size, a row of ``keys`` each: (subset, c, cid, n), a bounded number at a time."""
    for c in range(least_overlap(n), min(n, keys.shape[1]) + 1):
        chosen = np.array(list(combinations(range(keys.shape[1]), c)))
        step = max(1, SUBSETS // chosen.size)
        for at in range(0, len(cid), step):
            code = columns.mixed(columns.mixed(keys[at : at + step])[:, chosen].sum(axis=2, dtype=np.uint64).ravel()).view(np.int64)
            owner = np.repeat(cid[at : at + step], len(chosen))
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.full(len(code), c, np.int64)), pa.array(owner), pa.array(np.full(len(code), n, np.int64))], ["subset", "c", "cid", "n"])


def light_links(reps: DataFrame, bound: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike: dict[tuple[int, int], tuple[list, list]] = {}
            for cid, n, raw in zip(*(batch.column(c).to_pylist() for c in ("cid", "n", "common")), strict=True):
                keys = keycounts.spread_sorted(raw)
                cids, rows = alike.setdefault((n, len(keys)), ([], []))
                cids.append(cid)
                rows.append(keys)
            for (n, _), (cids, rows) in alike.items():
                yield from subsets(np.array(cids, np.int64), n, np.array(rows, np.uint64))

    rows = reps.where(F.col("n") <= bound).select("cid", "n", "common")
    held = shared.stored(rows.mapInArrow(run, "subset long, c long, cid long, n long"), "subsets")
    best = held.groupBy("subset", "c").agg(F.min(F.struct("n", "cid")).alias("best"), F.count(F.lit(1)).alias("holders")).where("holders > 1")
    met = held.join(best, ["subset", "c"]).where("cid <> best.cid and 9 * c >= 4 * (n + best.n)")
    return met.select(F.col("cid").alias("u"), F.col("best.cid").alias("v")).distinct()


# -- heavy sets ----------------------------------------------------------------------------------------------------------


def compared(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of the distinct pairs (u, v, n_u, n_v) that link.

    Pairs are dealt over buckets of about equal weight, whatever set they hold; a bucket gets each set that its pairs name once.
    """
    weight = pairs.agg(F.sum(F.col("n_u") + F.col("n_v"))).first()[0] or 0
    buckets = max(weight // BUCKET_SHINGLES + 1, keycounts.parts(pairs))

    def run(rows: pa.Table) -> pa.Table:
        named = rows.filter(rows.column("common").is_valid())
        sets = {u: keycounts.spread_sorted(x) for u, x in zip(named.column("u").to_pylist(), named.column("common").to_pylist(), strict=True)}
        rows = rows.filter(rows.column("v").is_valid())
        u, v, n, m = (rows.column(c).to_pylist() for c in ("u", "v", "n_u", "n_v"))
        keep = np.zeros(len(rows), bool)
        for i in range(len(rows)):
            both = len(np.intersect1d(sets[u[i]], sets[v[i]], assume_unique=True))
            keep[i] = 9 * both >= 4 * (n[i] + m[i])
        return rows.select(["u", "v"]).filter(pa.array(keep))

    dealt = pairs.select(F.pmod(F.xxhash64("u", "v"), F.lit(buckets)).alias("bucket"), "u", "v", "n_u", "n_v")
    names = dealt.select("bucket", F.explode(F.array("u", "v")).alias("cid")).distinct()
    needed = names.join(reps.select("cid", "common"), "cid").select("bucket", F.col("cid").alias("u"), "common")
    return keycounts.dealt(dealt.unionByName(needed, allowMissingColumns=True), "bucket").groupBy("bucket").applyInArrow(run, "u long, v long")


#: What goes with a set in a list: its size, the largest partner that the key can be the first common one of, its bitmap.
WITH = ["n", "room", *BITS]


def of(side: str, names: list[str] = WITH) -> list[Column]:
    """The same of side x under another side's names."""
    return [F.col(f"{c}_x").alias(f"{c}_{side}") for c in names]


def may_link(a: str, b: str) -> Column:
    """Whether two sets whose first common shingle is the list's can share enough: what a set has from there on bounds the size of the other, and the bits in
    which their bitmaps differ bound what they share."""
    differ = sum((F.bit_count(F.col(f"{x}_{a}").bitwiseXOR(F.col(f"{x}_{b}"))) for x in BITS), F.lit(0))
    return (F.col(f"n_{a}") <= F.col(f"room_{b}")) & (F.col(f"n_{b}") <= F.col(f"room_{a}")) & (9 * differ <= F.col(f"n_{a}") + F.col(f"n_{b}"))


def ordered(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs (u, v, n_u, n_v), u the lesser, each once."""
    swap, x, y = F.col(a) > F.col(b), F.struct(F.col(a).alias("c"), F.col(f"n_{a}").alias("n")), F.struct(F.col(b).alias("c"), F.col(f"n_{b}").alias("n"))
    low, high = F.when(swap, y).otherwise(x), F.when(swap, x).otherwise(y)
    return rows.select(low["c"].alias("u"), high["c"].alias("v"), low["n"].alias("n_u"), high["n"].alias("n_v")).distinct()


def inverted(reps: DataFrame, bound: int) -> DataFrame:
    """The lists: key, x (a set) and what goes with it, without those who can have no partner in their list."""
    room = F.floor((5 * F.col("n") - 9 * F.col("p.pos")) / 4).alias("room_x")
    posted = reps.where(5 * F.col("n") > 4 * bound).select(F.explode("prefix").alias("p"), "cid", "n", *BITS)
    posted = posted.select("p.key", F.col("cid").alias("x"), F.col("n").alias("n_x"), room, *(F.col(b).alias(f"{b}_x") for b in BITS))
    sizes = posted.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("n_x").alias("least"), F.max("room_x").alias("most")).where("size > 1 and most >= least")
    return posted.join(sizes, "key").where("room_x >= least and n_x <= most").drop("size", "least", "most")


def joined_components(reps: DataFrame, bound: int, links: DataFrame) -> DataFrame:
    """Components (u, label) by ``links`` and all links that the lists add between what would be different components.

    Each round compares, in every list, pivots with those of other components: at first the least set of the list, then sets of the component that has
    most of the list. So what links is joined after a few comparisons each, and what is left of a list are the pairs between its components.
    Once these are few beside the lists, or pivots don't make them much fewer, they are looked at all at once, and that is the end.
    """
    lists = shared.stored(inverted(reps, bound), "lists")
    budget = lists.count()
    first = lists.groupBy("key").agg(F.min(F.struct("x", *(f"{c}_x" for c in WITH))).alias("f"))
    first = first.select("key", F.col("f.x").alias("p"), *(F.col(f"f.{c}_x").alias(f"{c}_p") for c in WITH))
    pairs = shared.stored(ordered(lists.join(first, "key").where((F.col("x") != F.col("p")) & may_link("x", "p")), "x", "p"), "pairs")
    left, take, before = lists.join(first.select("key", "p"), "key").where("x <> p").drop("p"), 1, float("inf")
    last = False
    while True:
        # the stars so far stand for all links so far
        labels = graph.components(links.unionByName(compared(pairs, reps)))
        if last:
            return labels
        links = labels.withColumnRenamed("label", "v")
        named = left.join(labels.withColumnRenamed("u", "x"), "x", "left").withColumn("label_x", F.coalesce("label", "x")).drop("label")
        named = shared.stored(named, "named")
        groups = named.groupBy("key", "label_x").agg(F.count(F.lit(1)).alias("size"))
        still = groups.groupBy("key").agg(F.sum("size").alias("all"), F.sum(F.col("size") * F.col("size")).alias("same"), F.max(F.struct("size", "label_x")).alias("top")).where("all * all > same")
        looks = F.col("all") * (F.col("all") - F.col("top.size"))
        still = still.select("key", ((F.col("all") * F.col("all") - F.col("same")) / 2).alias("apart"), F.col("top.label_x").alias("top"), F.ceil(F.sqrt(looks / LOOKS)).cast("int").alias("grid"))
        still = shared.stored(still, "open")
        apart = still.agg(F.sum("apart")).first()[0] or 0
        if not apart:
            return labels
        left = shared.stored(named.join(still.drop("apart"), "key"), "left")
        last, before = apart <= budget or apart > 0.8 * before, apart
        if last:  # who is not of the list's largest component, with everyone of another; a long list's are dealt over the cells of a grid
            cell = lambda x: F.pmod(F.xxhash64(x), F.col("grid")).cast("int")
            every = F.explode(F.sequence(F.lit(0), F.col("grid") - 1))
            met = left.where("label_x <> top").select("key", F.col("x").alias("p"), *of("p", [*WITH, "label"]), every.alias("i"), cell("x").alias("j"))
            met = left.select("*", cell("x").alias("i"), every.alias("j")).join(met, ["key", "i", "j"]).where((F.col("label_x") == F.col("top")) | (F.col("x") < F.col("p")))
        else:  # the best of each salt, then of the list
            salt = F.pmod(F.xxhash64("x"), F.lit(32))
            inner, outer = (F.expr(f"row_number() over (partition by {k} order by label_x <> top, label_x, x)") for k in ("key, salt", "key"))
            best = left.withColumn("salt", salt).withColumn("r", inner).where(F.col("r") <= take).withColumn("r", outer).where(F.col("r") <= take)
            chosen = shared.stored(best.select("key", F.col("x").alias("p"), *of("p", [*WITH, "label"])), "pivots")
            met = left.join(chosen, "key")
        met = met.where((F.col("label_x") != F.col("label_p")) & may_link("x", "p"))
        pairs = shared.stored(ordered(met, "x", "p"), "pairs")
        if not last:
            left = left.join(chosen.select("key", F.col("p").alias("x")), ["key", "x"], "left_anti").drop("label_x", "top", "grid")
            take *= 2


# -- operator ------------------------------------------------------------------------------------------------------------


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id that links reach)."""
    spark, bits = docs.sparkSession, keycounts.shard_bits(docs)
    found = shared.stored(signed(keycounts.picked(docs, F.lit(False)), shared.scratch(spark, "words")), "signed")
    same = found.where("n > 0").groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "block", "path", "pos")).alias("r"))
    firsts = shared.stored(same.select("hi", "lo", F.col("r.doc_id").alias("cid"), "r.block", "r.path", "r.pos"), "firsts")
    replies = keycounts.answers(asked(firsts, shared.scratch(spark, "classes"), bits))
    reps = shared.stored(keycounts.per_block(replies, described, SET_SCHEMA), "sets")
    bound = boundary(reps)
    labels = joined_components(reps, bound, light_links(reps, bound)).withColumnRenamed("u", "cid")
    named = found.select("doc_id", "n", "hi", "lo").join(firsts.select("hi", "lo", "cid"), ["hi", "lo"], "left").join(labels, "cid", "left")
    null = lambda c: F.when(c != NO_ID, c)
    own = F.when(F.col("n") > 0, F.coalesce("label", "cid")).otherwise(F.col("doc_id"))
    return named.select(null(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), null(own).alias("component_id"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """Of each component the document with the least doc_id, with all its columns."""
    gone = shared.unused(docs, "gone")
    others = classes(docs).where("not (doc_id <=> component_id)").select(F.coalesce("doc_id", F.lit(NO_ID)).alias(gone)).distinct()
    return docs.join(others, F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == F.col(gone), "left_anti")
