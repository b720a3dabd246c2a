"""Clashing names, globs, torn journals, streams of blocks and pieces, walks of several roots, retries."""

import fnmatch
import hashlib
import json
import random
import re
import time
import types

import pytest
from pyspark.sql import functions as F
from quay import catalog, oracle, registry
from quay.functions import fixed, paths
from quay.operators import inventory, ordered, pack, restore, roots, staged, verify
from quay.plans import migrate
from quay.sources import appdb, files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


HELPERS = "name hidden e1 e2 c1 c2 c3 folders rules one ext segs r1 r2 _name _ext _segs _one _rules _e1 best up cell range base first n total key family rank len inside".split()


def test_users_columns_stay(spark):
    plain = spark.createDataFrame([(0, "/h/a/node_modules/x.JPG", 5, "aa"), (1, "/h/.env", 7, "bb"), (2, "/h/a/t.txt", 5, "aa")], "seq long, path string, size long, sha256 string")
    odd = plain.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("seq").cast("string")) for c in HELPERS})
    dim = spark.createDataFrame([("home", "/h/a")], "root string, root_path string")
    steps = {
        "classify": inventory.classify, "excluded": inventory.excluded, "secrets": inventory.secrets, "scanned": inventory.scanned, "dedup": pack.dedup, "split": lambda d: roots.split_roots(d, dim),
        "sums": lambda d: ordered.prefix_sum(d, F.col("size"), "before"), "join": lambda d: roots.join_roots(d.withColumns({"root": F.lit("home"), "rel": F.lit("x")}), dim, home="/h"),
    }
    for name, step in steps.items():
        out, bare = step(odd), step(plain)
        new = [c for c in bare.columns if c not in plain.columns]
        assert rows(out.select("seq", *new)) == rows(bare.select("seq", *new)), name
        assert all(r[c] == f"{c}:{r.seq}" for r in out.collect() for c in HELPERS), name
    again = inventory.classify(inventory.classify(plain))
    assert again.columns.count("class") == 1


def test_globs(spark):
    cases = {
        ("[^a]b", "xb"): True, ("[^a]b", "ab"): False, (r"a\*b", "a*b"): True, (r"a\*b", "axb"): False, ("[*]", "*"): True, ("[*]", "x"): False, ("[?.]x", ".x"): True, ("[?.]x", "ax"): False, ("a.b", "axb"): False,
        ("a+b|c", "a+b|c"): True, ("[a-c]*", "bzz"): True, ("[a-c]*", "d"): False, (r"[\]a]", "]"): True, (r"[\-z]", "-"): True, ("*", "a/b"): False, ("?", "/"): False, ("é?", "é😀"): True, ("(x)", "(x)"): True, ("[&&a]", "&"): True,
        ("{x}$^", "{x}$^"): True, ("", ""): True, (r"\d", "d"): True, (r"\d", "5"): False,
    }
    frame = spark.createDataFrame([(p, t) for p, t in cases], "p string, t string")
    got = {(r.p, r.t): r.m for r in frame.select("p", "t", F.rlike("t", paths.glob_regex(F.col("p"))).alias("m")).collect()}
    assert got == cases
    assert {k: bool(re.fullmatch(oracle.glob_regex(k[0]), k[1], re.S)) for k in cases if "&&" not in k[0]} == {k: v for k, v in cases.items() if "&&" not in k[0]}
    bad = ["[a", "a\\", "[]", "[^]", "[]a]", "[a-]", "[-a]"]
    good = ["[a-b]", "a]b", r"\[", "[ab]c", r"[\]]", "[a-cx-z]"]
    valid = {r.p: r.v for r in spark.createDataFrame([(p,) for p in bad + good], "p string").select("p", paths.glob_valid(F.col("p")).alias("v")).collect()}
    assert valid == {p: False for p in bad} | {p: True for p in good}
    rng = random.Random(1)
    random_cases = [("".join(rng.choice(["a", "b", "*", "?", ".", "[ab]", "[a-c]"]) for _ in range(rng.randrange(6))), "".join(rng.choice("abc.d") for _ in range(rng.randrange(6)))) for _ in range(400)]
    found = spark.createDataFrame(random_cases, "p string, t string").select("p", "t", F.rlike("t", paths.glob_regex(F.col("p"))).alias("m")).collect()
    assert all(r.m == fnmatch.fnmatchcase(r.t, r.p) for r in found)


def test_torn_journals(spark):
    good = ['{"t":"volume","n":1,"bytes":5,"at":"2024-01-02T03:04:05.123Z"}', '{"t":null}', "{}", "null", '{"t":"x","other":{"deep":[1]}}', f'{{"sha256":"{"a" * 64}"}}', '{"at":"2024-01-02T03:04:05+02:00"}']
    bad = ["5", '{"t":5}', '"x"', "[]", '{"t":"vol', '{"n":"1"}', '{"n":1.5}', '{"n":-1}', '{"at":"yesterday"}', '{"sha256":"ab"}', '{"bytes":true}', "{} {}", "true"]
    frame = spark.createDataFrame([(t, t in good) for t in good + bad], "text string, want boolean")
    wrong = frame.where(verify.is_journal_line(F.col("text")) != F.col("want"))
    assert [r.text for r in wrong.collect()] == []
    lines = spark.createDataFrame([(0, good[0], "x"), (1, " ", "x"), (2, None, "x"), (3, good[1], "x"), (4, "5", "x"), (5, good[0], "x")], "line long, text string, torn string")
    assert [r.line for r in verify.journal_prefix(lines).orderBy("line").collect()] == [0, 3]


def brute_volumes(blocks, prevs, size, reserve):
    out, volume, pos, first, count, touched = [], 0, 0, 0, 0, 0
    for b, raw in blocks:
        fit = count and pos + fixed.BLOCK_HEAD + raw + touched * fixed.PER_ENTRY + count * fixed.PER_BLOCK + reserve <= size
        if not fit:
            volume, pos, first, count, touched = volume + 1, fixed.VOLUME_HEAD, b, 0, 0
        out.append((b, volume, pos))
        touched += len([p for p in prevs.get(b, []) if p < first])
        pos, count = pos + fixed.BLOCK_HEAD + raw, count + 1
    return out


def test_volume_fold_is_linear(spark):
    n = 60_000
    blocks = spark.range(n).select(F.col("id").alias("block_id"), (F.col("id") * 7919 % 5000 + 1).alias("raw"))
    parts = spark.range(n).select(F.expr("id div 3").alias("seq"), F.col("id").alias("block_id"))
    began = time.monotonic()
    got = rows(pack.volumes(blocks, parts, volume_size=200_000, reserve=4096).select("block_id", "volume", "pos"))
    took = time.monotonic() - began
    prevs = {b: [b - 1 if b % 3 else -1] for b in range(n)}
    assert got == brute_volumes([(b, b * 7919 % 5000 + 1) for b in range(n)], prevs, 200_000, 4096)
    assert took < 30
    two = blocks.withColumn("block_id", F.col("block_id"))
    split = pack.volumes(two, parts, volume_size=200_000, reserve=4096, package=F.col("block_id") % 2)
    assert {r.package for r in split.select("package").distinct().collect()} == {0, 1}
    for p in (0, 1):
        mine = [(b, b * 7919 % 5000 + 1) for b in range(p, n, 2)]
        assert rows(split.where(f"package = {p}").select("block_id", "volume", "pos")) == brute_volumes(mine, prevs, 200_000, 4096)


def test_ranges_follow_rows_not_values(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 50)
    rng = random.Random(2)
    values = sorted(rng.sample(range(10**12), 400)) + list(range(10**12, 10**12 + 300))
    frame = spark.createDataFrame([(v, i % 5) for i, v in enumerate(values)], "seq long, w long")
    got = {r.seq: r.before for r in ordered.prefix_sum(frame, F.col("w"), "before").collect()}
    total, want = 0, {}
    for i, v in enumerate(values):
        want[v] = total
        total += i % 5
    assert got == want
    ranges = ordered._ranges(frame, "seq", F.col("w"))
    assert ranges.select("range").distinct().count() < ranges.count()
    assert ordered.prefix_sum(frame.limit(0), F.col("w"), "before").count() == 0


def test_reassembly_streams_pieces(spark):
    rng = random.Random(3)
    data = {s: rng.randbytes(rng.choice([0, 1, 500, 3000])) for s in range(30)}
    parts, blocks = [], {}
    for s, d in data.items():
        for n, at in enumerate(range(0, len(d), 700)):
            piece, block = d[at : at + 700], len(blocks)
            blocks[block] = b"pad" + piece
            parts.append((s, block, 3, len(piece), n))
    lost, broken = {1, 5}, {8}
    content = [(b, bytearray(b"pad" + bytes(len(d) - 3) if b in broken else d)) for b, d in blocks.items() if b not in lost]
    listed = spark.createDataFrame([(s, len(d), hashlib.sha256(d).hexdigest(), "x") for s, d in data.items()], "seq long, size long, sha256 string, gone string")
    got = dict(rows(verify.reassemble(spark.createDataFrame(parts, "seq long, block_id long, off long, len long, n int"), spark.createDataFrame(content, "block_id long, data binary"), listed)))
    holders = {b: s for s, b, *_ in parts}
    assert got == {s: "incomplete" if s in {holders[b] for b in lost} else "damaged" if s in {holders[b] for b in broken} else "ok" for s in data}


def brute_names(entries):
    """Names given one after the other, by (root, path), as long as each is taken trying the next number."""
    out, taken = {}, set()
    for root, path in sorted(entries):
        name, n = path, 2
        while (root, name.lower()) in taken:
            stem, dot, ext = name.rpartition(".")
            name = f"{stem} ({n}){dot}{ext}" if stem else f"{name} ({n})"
            n += 1
        taken.add((root, name.lower()))
        out[root, path] = name
    return out


def test_names_settle_as_if_one_by_one(spark):
    rng = random.Random(4)
    entries = {("documents", "".join(rng.choice("aA") for _ in range(3)) + rng.choice(["", " (2)", " (2) (3)", " (3)"]) + rng.choice([".txt", ".TXT", ""])) for _ in range(150)}
    frame = spark.createDataFrame([(r, p, 1, "own") for r, p in entries], "root string, path string, size long, family string")
    here = spark.createDataFrame([("documents", "/d")], "root string, root_path string")
    got = {(r.root, r.path): r.final for r in restore.resolved(restore.adapted(frame, here, "windows"), "windows").collect()}
    assert got == brute_names(entries)
    many = spark.createDataFrame([("documents", f"{'A' if i % 2 else 'a'}.txt", i) for i in range(400)], "root string, path string, size long")
    finals = [r.final for r in restore.resolved(restore.adapted(many, here, "windows"), "windows").collect()]
    assert len(set(finals)) == 400


def test_walk_of_several_roots(spark, tmp_path):
    spark.dataSource.register(files.TreeSource)
    for name, size in (("a/x.txt", 5), ("a/node_modules/p/q.js", 70), ("a/node_modules/r.js", 30), ("a/deep/er/est/z.bin", 9), ("b/y.txt", 3), ("b/Node_Modules/s.js", 11)):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    (tmp_path / "b/link").symlink_to(tmp_path / "a")
    tree = spark.read.format("quay_tree").option("skip", "node_modules").load(f"{tmp_path}/a|{tmp_path}/b")
    assert tuple(files.scan_totals(tree).first()) == (3, 17, 5, 1, 0, 111)
    assert rows(files.skipped_folders(tree)) == [("node_modules", 3, 111)]
    assert tree.select("path").distinct().count() == tree.count()
    shallow = spark.read.format("quay_tree").option("skip", "node_modules").option("depth", 0).load(f"{tmp_path}/a|{tmp_path}/b")
    assert rows(shallow.drop("error")) == rows(tree.drop("error"))
    assert tree.rdd.getNumPartitions() > 6


def test_destinations(spark):
    frame = spark.createDataFrame([(0x4D44, "usb"), (0xEF53, "disk"), (1, "odd")], "magic long, path string")
    got = {r.path: (r.fs, r.volume) for r in files.volume_size(files.destinations(frame), 8 << 30).collect()}
    assert got == {"usb": ("FAT32", (4 << 30) - 1), "disk": ("ext2/3/4", 8 << 30), "odd": ("unknown", 8 << 30)}


def test_batches_are_retried_one_by_one(spark):
    steps = [("r", "apt", 0, True, False, [], 0), ("r", "apt", 1, False, True, ["a", "b"], 1), ("r", "snap", 2, False, False, ["c"], 1), ("r", "apk", 3, True, False, [], 1), ("r", "apk", 4, False, True, ["d", "e"], 1), ("r", "dnf", 5, False, True, ["f"], 1), ("r", "aur", 6, False, True, ["g", "h"], 2)]
    singles = [("r", 1, "a", 0), ("r", 1, "b", 0), ("r", 6, "g", 0), ("r", 6, "h", 4)]
    got = migrate.retried(spark.createDataFrame(steps, "run string, manager string, n int, prep boolean, batch boolean, packages array<string>, exit int"), spark.createDataFrame(singles, "run string, n int, package string, exit int"))
    assert {r.n: (r.outcome, r.failed, r.ok) for r in got.collect()} == {
        0: ("ok", [], True), 1: ("failed", [], True), 2: ("failed", ["c"], False), 3: ("failed", [], False), 4: ("skipped", [], False), 5: ("failed", ["f"], False), 6: ("failed", ["h"], False),
    }


def test_unknown_fields_and_strict_folders(spark, tmp_path):
    entry = json.loads(appdb.SAMPLE[0])
    (tmp_path / "heron.json").write_text(json.dumps(entry))
    assert appdb.load_folder(spark, str(tmp_path)).apps.count() == 1
    entry["linux"]["yum"] = ["x"]
    (tmp_path / "heron.json").write_text(json.dumps(entry))
    with pytest.raises(ValueError, match="unknown-field linux.yum"):
        appdb.load_folder(spark, str(tmp_path))
    assert appdb.load_folder(spark, str(tmp_path), strict=False).apps.count() == 1


def test_roots_are_chosen(spark):
    entries = spark.createDataFrame([(r,) for r in ("documents", "apps/x/y", "music", "meta", "other")], "root string")
    pick = lambda **o: {r.root for r in restore.selected(entries, **o).collect()}
    assert pick() == {"documents", "apps/x/y", "music", "other"}
    assert pick(only=["apps", "meta"]) == {"apps/x/y"} and pick(only=[]) == set() and pick(skip=["apps", "other"]) == {"documents", "music"}


def test_unset_folder_is_refused_on_a_cluster():
    sc = types.SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    frame = types.SimpleNamespace(sparkSession=types.SimpleNamespace(sparkContext=sc, conf={}))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staged.staged(frame)


def test_every_query_but_one_has_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"entropy_class"}
    assert {f.__name__ for f in registry.QUERIES} <= set(catalog.oracle_sql())
