from pyspark.sql import functions as F
from quay.functions import paths
from quay.operators import restore, roots

HERE = [("documents", "/home/x/Documents"), ("pictures", "/home/x/Documents/Photos"), ("config", "/home/x/.config")]


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_roots(spark):
    here = spark.createDataFrame(HERE, "root string, root_path string")
    want = {
        "/home/x/Documents/a/b.txt": ("documents", "a/b.txt"), "/home/x/Documents/Photos/summer.jpg": ("pictures", "summer.jpg"), "/home/x/Documents": ("documents", "."),
        "/home/x/.config/app/set.ini": ("config", "app/set.ini"), "/home/x/project/main.go": ("other", "home/x/project/main.go"), "/etc/hosts": ("other", "etc/hosts"), "/home/x/Documentsx/a": ("other", "home/x/Documentsx/a"),
    }
    got = roots.split_roots(spark.createDataFrame([(p,) for p in want], "path string"), here)
    assert {r.path: (r.root, r.rel) for r in got.collect()} == want
    back = roots.join_roots(spark.createDataFrame([("documents", "a/b.txt"), ("other", "etc/hosts"), ("videos", "x")], "root string, rel string"), here, home="/home/x", restored="back")
    assert {r.root: r.dest for r in back.collect()} == {"documents": "/home/x/Documents/a/b.txt", "other": "/home/x/back/etc/hosts", "videos": None}
    assert one(spark, [(r"C:\Users\x\a.txt", "windows")], "p string, os string", paths.other_key(F.col("p"), F.col("os"))) == ["C/Users/x/a.txt"]
    found = roots.default_roots(spark.createDataFrame([("/a/b", True, True), ("/a", True, True), ("/c", False, False), ("/a", True, True)], "path string, exists boolean, is_dir boolean"))
    assert [r.path for r in found.collect()] == ["/a"]


def test_app_roots(spark):
    codec = lambda r: paths.split_app_root(F.col("r"))
    got = one(spark, [("apps/vlc/config",), ("apps/vlc/config@flatpak",), ("apps/a/b/c",), ("apps/",), ("apps/x",), ("apps/x/",), ("apps//k",), ("documents",)], "r string", codec(None))
    assert [tuple(x) if x else None for x in got] == [("vlc", "config", ""), ("vlc", "config", "flatpak"), ("a", "b/c", ""), None, None, None, None, None]
    assert one(spark, [("a", "k", "snap"), ("a", "k", "")], "i string, k string, v string", paths.app_root(F.col("i"), F.col("k"), F.col("v"))) == ["apps/a/k@snap", "apps/a/k"]


def test_names(spark):
    windows = {
        "report: final.docx": "report_ final.docx", "a/b<c>d.txt": "a/b_c_d.txt", "con.txt": "_con.txt", "CON": "_CON", "lpt1.log": "_lpt1.log", "name.": "name", "name  ": "name", "../escape": "_../escape",
        "normal/file.txt": "normal/file.txt", "diacritics ăîș.md": "diacritics ăîș.md", "...": "_", "a//b": "a//b", "a\x01b": "a_b",
    }
    assert one(spark, [(n,) for n in windows], "n string", paths.sanitize(F.col("n"), F.lit("windows"))) == list(windows.values())
    same = ["report: final.docx", "con.txt", "name."]
    assert one(spark, [(n,) for n in same], "n string", paths.sanitize(F.col("n"), F.lit("linux"))) == same
    assert one(spark, [("a\x00b",)], "n string", paths.sanitize(F.col("n"), F.lit("linux"))) == ["a_b"]
    suffix = {"report.docx": "report (K).docx", "dir/report.docx": "dir/report (K).docx", "no-extension": "no-extension (K)", ".bashrc": ".bashrc (K)", "archive.tar.gz": "archive.tar (K).gz", "d.x/name": "d.x/name (K)"}
    assert one(spark, [(n,) for n in suffix], "n string", paths.with_suffix(F.col("n"), F.lit(" (K)"))) == list(suffix.values())


def plan(spark, entries, existing=(), os="linux", **options):
    here = spark.createDataFrame([("documents", "/home/u/Documents"), ("pictures", "/home/u/Pictures")], "root string, root_path string")
    there = spark.createDataFrame(list(existing), "path string, is_dir boolean")
    return restore.plan(spark.createDataFrame(entries, "root string, path string, size long"), here, there, os=os, home="/home/u", **options)


def test_restore_plan(spark):
    entries = [("documents", "report.txt", 10), ("documents", "sub/notes.md", 20), ("pictures", "photo.jpg", 30), ("downloads", "installer.sh", 40), ("other", "etc/hosts", 50)]
    there = [("/home/u/Documents/report.txt", False)]
    rows = {r.path: r for r in plan(spark, entries, there, suffix=" (K)", restored="back").collect()}
    assert rows["report.txt"].dest == "/home/u/Documents/report (K).txt" and rows["report.txt"].action == "next"
    assert rows["installer.sh"].dest == "/home/u/back/downloads/installer.sh" and rows["installer.sh"].note == restore.NO_PLACE
    assert rows["etc/hosts"].dest == "/home/u/back/etc/hosts"
    total = restore.totals(plan(spark, entries, there)).first()
    assert (total.files, total.conflicts, total.skipped) == (5, 1, 0)
    assert restore.totals(plan(spark, entries, there, policy="skip")).first().skipped == 1
    assert {r.action for r in plan(spark, entries, there, policy="overwrite").collect()} == {"write", "overwrite"}
    assert {r.action for r in plan(spark, entries[:1], [("/home/u/Documents/report.txt", True)], policy="overwrite").collect()} == {"next"}


def test_collisions(spark):
    names = ["Report.txt", "report.txt", "REPORT.txt", "a (2).txt", "A.txt", "a.txt", "b.txt", "c"]
    rows = plan(spark, [("documents", n, 1) for n in names], os="windows").collect()
    want = dict(zip(sorted(names), restore.resolve_names([(n, n.lower()) for n in sorted(names)], "windows"), strict=True))
    assert {r.path: r.dest.removeprefix("/home/u/Documents/") for r in rows} == want
    assert want["Report.txt"] == "Report (2).txt" and want["report.txt"] == "report (2) (3).txt"
    assert len({r.dest.lower() for r in rows}) == len(names)
