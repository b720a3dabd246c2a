import hashlib
import io
import os

from pyspark.sql import functions as F
from quay.functions import codecs
from quay.operators import inventory
from quay.sources import container, files, package
from quay.streaming import journal


def test_tree(spark, tmp_path):
    for name, size in (("a/x.txt", 100), ("a/node_modules/y.js", 7), ("b.md", 5)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"z" * size)
    os.symlink(tmp_path / "b.md", tmp_path / "link1")
    os.symlink(tmp_path / "missing", tmp_path / "a/link2")
    spark.dataSource.register(files.TreeSource)
    tree = spark.read.format("quay_tree").option("skip", "node_modules").load(str(tmp_path))
    assert tuple(files.measure(tree).first()) == (2, 105, 1, 2, 0)
    one = spark.read.format("quay_tree").load(str(tmp_path / "b.md"))
    assert [(r.kind, r["size"]) for r in one.collect()] == [("file", 5)]
    listed = files.read_tree(spark, str(tmp_path))
    assert "content" not in listed.columns and listed.agg(F.sum("size")).first()[0] >= 112
    assert {r.sha256 for r in files.read_contents(spark, str(tmp_path / "a")).where("path like '%x.txt'").collect()} == {hashlib.sha256(b"z" * 100).hexdigest()}
    scan = inventory.scanned(listed.select(F.regexp_replace("path", "^file:", "").alias("path"), "size"), root=str(tmp_path))
    assert {r.rule for r in scan.collect()} == {None, "node_modules"}


def volume(blocks, **more):
    out = io.BytesIO()
    container.write_volume(lambda b: out.write(b) and None, blocks, magic=b"QUA", volume=1, package=b"\1" * 16, **more)
    return out.getvalue()


def test_container(spark, tmp_path):
    data = [b"first block " * 50, os.urandom(300), b""]
    blocks = [(c, hashlib.sha256(d).digest(), codecs.encode(c, d), len(d)) for c, d in zip(("zstd", "stored", "xz"), data, strict=True)]
    whole = volume([*blocks, ("index", bytes(32), b"{}", 2)])
    (tmp_path / "1.vol").write_bytes(whole)
    (tmp_path / "2.vol").write_bytes(whole[:-40])
    (tmp_path / "3.vol").write_bytes(b"nothing")
    (tmp_path / "4.vol").write_bytes(whole[:4] + b"\x09" + whole[5:])
    spark.dataSource.register(container.VolumeSource)
    rows = spark.read.format("quay_volumes").option("magic", "QUA").load(str(tmp_path)).collect()
    first = [r for r in rows if r.path.endswith("1.vol")]
    assert [r.codec for r in first] == ["zstd", "stored", "xz", "index"] and not any(r.problem for r in first)
    assert [codecs.decode(r.codec, bytes(r.stored), r.raw) for r in first[:3]] == data
    assert first[1].pos == 32 + 56 + first[0].stored_size
    problems = {r.path[-5:]: r.problem for r in rows if r.problem}
    assert set(problems) == {"2.vol", "3.vol", "4.vol"} and problems["3.vol"] == "not a volume" and problems["4.vol"] == "newer format"
    bare = spark.read.format("quay_volumes").option("magic", "QUA").option("content", "false").load(str(tmp_path)).where("stored is not null")
    assert bare.count() == 0


def test_package_files(spark, tmp_path):
    sums = spark.createDataFrame([("b", "0" * 64), ("a", "1" * 64)], "name string, sha256 string")
    package.write_sums(sums, str(tmp_path / "sums"))
    text = "".join(p.read_text() for p in (tmp_path / "sums").glob("part-*"))
    assert text == f"{'1' * 64}  a\n{'0' * 64}  b\n"
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.txt").write_text(f"{'1' * 64}  a b\nnonsense\n\n")
    assert sorted((r.name, r.bad) for r in package.read_sums(spark, str(tmp_path / "bad")).collect()) == [("", True), ("a b", False)]
    entries = spark.createDataFrame([(1, 10, False), (2, 20, True)], "seq long, size long, secret boolean")
    blocks = spark.createDataFrame([(0, "solid", 30)], "block_id long, kind string, raw long")
    located = spark.createDataFrame([(0, 1, 32)], "block_id long, volume int, pos long")
    parts = spark.createDataFrame([(1, 0, 0, 10), (2, 0, 10, 20)], "seq long, block_id long, off long, len long")
    package.write_tables(str(tmp_path / "p"), entries, parts, blocks, located)
    back = package.read_tables(spark, str(tmp_path / "p"))
    assert back["entries"].count() == 2 and back["blocks"].where("volume = 1").first().raw == 30
    package.write_manifest(package.manifest(entries, located, blocks, package="ab", os="linux", level=2), str(tmp_path / "m"))
    row = package.read_manifest(spark, str(tmp_path / "m")).first()
    assert (row.files, row.raw_bytes, row.volumes, row.secrets_included, row.problem) == (2, 30, 1, True, None)
    apps = spark.createDataFrame([('{"format":1,"os":"linux","apps":[{"id":"git","name":"Git"},{"id":"vlc","config_only":true}]}',), ('{"format":9,"apps":[{"id":"x"}]}',)], "text string")
    assert [(r.app_id, r.config_only) for r in package.read_app_manifest(apps).collect()] == [("git", False), ("vlc", True)]


def test_streams(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/1.jsonl").write_text('{"t":"open"}\n{"t":"block","n":3}\n{"t":"vol')
    query = journal.journal_stream(spark, str(tmp_path / "j")).writeStream.format("memory").queryName("lines").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.t for r in spark.table("lines").collect()) == ["block", "open"]
    events = spark.sql("select timestamp_ntz '2024-01-01 00:10:00' as ts, 'a' as event_type, 2.0D as value union all select timestamp_ntz '2024-01-01 00:50:00', 'a', 3.0D")
    assert tuple(journal.event_counts(events).first())[1:] == ("a", 2, 5.0)
