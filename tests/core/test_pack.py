import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F
from quay.functions import codecs
from quay.operators import pack, verify

SIZES = [("text", 150), ("text", 1), ("incompressible", 300), ("incompressible", 300), ("binary", 60), ("text", 0), ("text", 70), ("incompressible", 128), ("text", 64)]
BLOCK = 64


@pytest.fixture(scope="module")
def laid(spark):
    rows = [(i, size, "same" if i in (2, 3) else f"h{i}", c) for i, (c, size) in enumerate(SIZES)]
    files = pack.dedup(spark.createDataFrame(rows, "seq long, size long, sha256 string, class string")).withColumn("compressible", F.col("class") != "incompressible")
    blocks, parts = pack.layout(files, BLOCK)
    return files.cache(), blocks.cache(), parts.cache()


def simulate():
    """Blocks as they fill, one file after the other."""
    blocks, parts, solid, open_parts = [], {}, 0, []
    for i, (c, size) in enumerate(SIZES):
        if i == 3:
            continue
        if c == "incompressible":
            for at in range(0, size, BLOCK):
                n = min(BLOCK, size - at)
                parts.setdefault(i, []).append((len(blocks), 0, n))
                blocks.append(("stored", n))
        else:
            left = size
            while left:
                n = min(BLOCK - solid, left)
                open_parts.append((i, solid, n))
                solid, left = solid + n, left - n
                if solid == BLOCK:
                    for j, off, m in open_parts:
                        parts.setdefault(j, []).append((len(blocks), off, m))
                    blocks.append(("solid", BLOCK))
                    solid, open_parts = 0, []
    for j, off, m in open_parts:
        parts.setdefault(j, []).append((len(blocks), off, m))
    if open_parts:
        blocks.append(("solid", solid))
    parts[3] = parts[2]
    return blocks, parts


def test_layout(laid):
    files, blocks, parts = laid
    assert {r.seq: (r["dup"], r.original) for r in files.collect()}[3] == (True, 2)
    want_blocks, want_parts = simulate()
    assert [(r.kind, r.raw) for r in blocks.orderBy("block_id").collect()] == want_blocks
    got = {}
    for r in parts.orderBy("seq", "n").collect():
        got.setdefault(r.seq, []).append((r.block_id, r.off, r.len))
    assert got == {k: sorted(v) for k, v in want_parts.items()}


def test_volumes(laid):
    files, blocks, parts = laid
    per_block = {}
    for r in parts.collect():
        per_block.setdefault(r.block_id, set()).add(r.seq)
    for size, reserve in ((900, 0), (3000, 100), (10**6, 0)):
        want, volume, pos, inside, n = {}, 0, 0, set(), 0
        for r in blocks.orderBy("block_id").collect():
            need = 56 + r.raw
            if not n or pos + need + 320 * len(inside) + 128 * n + reserve > size:
                volume, pos, inside, n = volume + 1, 32, set(), 0
            want[r.block_id] = (volume, pos)
            pos, n = pos + need, n + 1
            inside |= per_block[r.block_id]
        found = pack.volumes(blocks, parts, volume_size=size, reserve=reserve)
        assert {r.block_id: (r.volume, r.pos) for r in found.collect()} == want
    touch = pack.volumes(blocks, parts, volume_size=900, reserve=0).cache()
    lost = pack.placed(files, parts, touch.where("volume <> 1"))
    assert {r.seq for r in lost.where("not placed").collect()} == {r.seq for r in pack.in_volume(files, parts, touch).where("volume = 1").collect()}
    assert pack.needed_volumes(parts, touch, files.where("seq = 1").select("seq")).count() == 1
    assert pack.saved(files).first().saved_bytes == 300


def test_codecs(spark):
    rng = random.Random(5)
    noise, line = rng.randbytes(2000), b"one line and again " * 200
    assert codecs.looks_compressible(noise[:511]) and not codecs.looks_compressible(noise) and codecs.looks_compressible(line)
    for codec in codecs.CODECS:
        for data in (b"", noise, line):
            stored = codecs.encode(codec, data)
            assert codecs.decode(codec, stored, len(data)) == data
            assert codecs.decode(codec, stored, len(data) + 1) is None
    assert codecs.decode("zstd", b"nonsense", 5) is None and codecs.decode("xz", b"", 5) is None
    rows = [(i, c, len(line), hashlib.sha256(line).hexdigest() if i % 2 else "x", codecs.encode(c, line)) for i, c in enumerate(codecs.CODECS)]
    got = verify.decode_blocks(spark.createDataFrame(rows, "block_id long, codec string, raw long, sha256 string, stored binary"))
    assert {r.block_id: r.ok for r in got.collect()} == {0: False, 1: True, 2: False, 3: True}


def test_sums_and_journal(spark):
    sums = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "name string, sha256 string")
    files = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", None), ("e", "5")], "name string, sha256 string")
    assert {r.name: r.problem for r in verify.check_sums(sums, files).collect()} == {"b": "checksum mismatch", "c": "unreadable", "d": "unreadable", "e": "not in the sums"}
    lines = ['{"t":"a"}', "", '{"t":"b","n":1}', '{"t":', '{"t":"c"}']
    rows = spark.createDataFrame(list(enumerate(lines)), "line long, text string")
    assert [r.line for r in verify.journal_prefix(rows).orderBy("line").collect()] == [0, 2]
    assert verify.journal_prefix(rows.where("line < 3")).count() == 2


def test_reassembly(spark):
    data = {i: os.urandom(100 + 37 * i) for i in range(4)} | {4: b""}
    files = spark.createDataFrame([(i, len(d), hashlib.sha256(d).hexdigest()) for i, d in data.items()], "seq long, size long, sha256 string")
    blocks, parts = [], []
    for i, d in data.items():
        for n, at in enumerate(range(0, len(d), 64)):
            parts.append((i, len(blocks), 0, len(d[at : at + 64]), n))
            blocks.append((len(blocks), d[at : at + 64]))
    blocks[0] = (0, b"\0" + blocks[0][1][1:])
    del blocks[3]
    got = verify.reassemble(spark.createDataFrame(parts, "seq long, block_id long, off long, len long, n long"), spark.createDataFrame(blocks, "block_id long, data binary"), files)
    assert {r.seq: r.status for r in got.collect()} == {0: "damaged", 1: "incomplete", 2: "ok", 3: "ok", 4: "ok"}
