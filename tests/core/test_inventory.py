import pytest
from pyspark.sql import functions as F
from quay.functions import paths
from quay.operators import inventory

TREE = [
    ("Documents/report.txt", 5000), ("Documents/lease.docx", 20000), ("Pictures/holiday.jpg", 900000), ("Pictures/sketch.bmp", 40000), ("work/main.go", 3000),
    ("work/node_modules/parcel/a.js", 700000), ("work/.git/objects/abc", 250000), (".cache/browser/blob", 400000), (".ssh/id_rsa", 2000), (".env", 300),
]


@pytest.fixture(scope="module")
def scan(spark):
    return inventory.scanned(spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(TREE)], "seq long, path string, size long")).cache()


def test_small_tree(spark, scan):
    classes = {r["class"]: (r.files, r.bytes) for r in inventory.by_class(scan).collect()}
    assert classes == {"incompressible": (2, 920000), "text": (3, 48000)}
    assert sum(b for _, b in classes.values()) == 968000
    assert sum(r.bytes for r in inventory.skipped(scan).collect()) == 1350000
    assert sum(r.files for r in inventory.secret_bucket(scan).collect()) == 2
    assert sum(r.files for r in inventory.by_class(scan, with_secrets=True).collect()) == 7
    top = inventory.largest(scan, 3).collect()
    assert [r.path for r in top][0] == "Pictures/holiday.jpg" and len(top) == 3
    allowed = inventory.scanned(scan.select("seq", "path", "size"), rules=inventory.rule_dim(spark, ("NODE_MODULES",)))
    assert sum(r.files for r in inventory.by_class(allowed).collect()) == 6


CLASSES = {
    "incompressible": "photo.jpg|PHOTO.JPEG|/home/x/Videos/movie.mkv|song.flac|bundle.tar.gz|report.docx|book.epub|manual.pdf|photo.jpg.orig|dir\\file.jpg",
    "binary": "tool.exe|libc.so|disk.iso|machine.qcow2|old.doc|font.ttf",
    "text": "memo.txt|main.go|rows.json|diary.log|tables.sql|drawing.svg|shot.bmp|sound.wav|Makefile|README|/home/x/.bashrc|/home/x/.gitignore|config.json.bak|x.ts",
    "unknown": "odd-thing|rows.xyzzy|a.|.env.local",
}


def test_classes(spark):
    want = {n: c for c, names in CLASSES.items() for n in names.split("|")}
    rows = spark.createDataFrame([(n,) for n in want], "path string")
    assert {r.path: r["class"] for r in inventory.classify(rows).collect()} == want


def test_secrets_and_rules(spark):
    secret = "/home/x/.ssh/id_rsa /home/x/.ssh/config /home/x/.gnupg/secring.gpg /home/x/.aws/credentials /home/x/work/.env /home/x/work/.env.local /home/x/server.pem /home/x/cert.pfx /home/x/secrets.kdbx /home/x/.netrc C:\\Users\\x\\.kube\\config".split()
    safe = "/home/x/Documents/report.docx /home/x/environment.txt /home/x/env.md /home/x/photos/key.jpg /home/x/Documents/keymemo.txt".split()
    rows = spark.createDataFrame([(p,) for p in secret + safe], "path string")
    found = {r.path: r.secret for r in inventory.secrets(rows).collect()}
    assert all(found[p] for p in secret) and not any(found[p] for p in safe)
    dirs = spark.createDataFrame([(f"{d}/x",) for d in ("node_modules", "NODE_MODULES", ".cache", "steamapps", ".git", "Documents")] + [("a/.git",), ("Temp/.git/x",)], "path string")
    ruled = {r.path: r.rule for r in inventory.excluded(dirs).collect()}
    assert ruled["NODE_MODULES/x"] == "node_modules" and ruled["Documents/x"] is None and ruled["a/.git"] is None and ruled["Temp/.git/x"] == "Temp"


def estimate(spark, rows, **options):
    frame = spark.createDataFrame(rows, "class string, files long, bytes long")
    return {r.level: r for r in inventory.estimate(frame, **options).collect()}


def test_estimate(spark):
    gib = 1 << 30
    stored = estimate(spark, [("incompressible", 1, 12 * gib)])
    assert stored[3].min_bytes == stored[3].max_bytes == stored[3].raw and stored[2].volumes == 4
    mixed = estimate(spark, [("text", 1, 4 * gib), ("binary", 1, 2 * gib), ("incompressible", 1, 6 * gib)])
    assert all(r.min_bytes <= r.max_bytes <= r.raw for r in mixed.values())
    assert mixed[1].max_bytes > mixed[2].max_bytes > mixed[3].max_bytes and mixed[1].seconds < mixed[2].seconds < mixed[3].seconds
    measured = estimate(spark, [("text", 1, gib)], override={"text": 0.05})
    assert measured[2].sampled and measured[2].max_bytes < estimate(spark, [("text", 1, gib)])[2].min_bytes
    assert estimate(spark, [("text", 1, 8 * gib)], workers=8)[3].seconds < estimate(spark, [("text", 1, 8 * gib)])[3].seconds
    empty = estimate(spark, [])
    assert empty[1].max_bytes == 0 and empty[1].volumes == 0


def test_formats(spark):
    cases = [(0, "0 B"), (1023, "1023 B"), (1024, "1,0 KiB"), (1536, "1,5 KiB"), (1280, "1,2 KiB"), (200 * 1024, "200 KiB"), (5 << 30, "5,0 GiB"), (-2048, "−2,0 KiB")]
    got = [r.s for r in spark.createDataFrame([(n,) for n, _ in cases], "n long").select(paths.human_bytes(F.col("n")).alias("s")).collect()]
    assert got == [s for _, s in cases]
    one = spark.createDataFrame([(412883, 90_000_000_000)], "n long, d long").select(paths.human_count(F.col("n")).alias("c"), paths.human_duration(F.col("d")).alias("d"), paths.human_range(F.lit(5), F.lit(5)).alias("r"), paths.pad(F.lit("é"), 3).alias("p")).first()
    assert tuple(one) == ("412 883", "~2 min", "5 B", "é  ")
