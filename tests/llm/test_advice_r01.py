"""What the review of round 1 found missing."""

import collections
import functools
import math
import random
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from quay.llm import keycounts, lm, pii, quality, queries, tokenfile
from tokenizers import Tokenizer


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def spans(spark, seen, new):
    rows = pii.extract(frame(spark, [*seen, *new])).where(f"doc_id >= {len(seen)}").orderBy("doc_id").collect()
    return [[t[s.start : s.end] for s in r.spans if s not in r.base] for r, t in zip(rows, new, strict=True)]


def test_identifiers_with_blanks_and_brackets(spark):
    seen = [f"some words phone: +1 555 010 {1000 + i} and more" for i in range(40)] + [f"his card is 4111 1111 1111 {x} now" for x in ("1111", "1129", "1137", "1145", "1152", "1160")]
    cases = {
        "call phone: (555) 010-7777 and wait": ["(555) 010-7777"],
        "call phone: 020 7946 0018 and wait": ["020 7946 0018"],
        "call phone: (020 7946 0019), and wait": ["020 7946 0019"],
        'call phone : "555-010-7778", and wait': ["555-010-7778"],
        "call phone ( 555.010.7779 ) and wait": ["555.010.7779"],
        "call phone:020 7946 0020 and wait": ["020 7946 0020"],
        "call tel(555) 010-7781 and wait": ["(555) 010-7781"],
        "his card is 4111 1111 1111 1112 now": ["4111 1111 1111 1112"],
        "his card is 4111 1111 1111 1113 12/27 now": ["4111 1111 1111 1113"],
        "from 10.0.0.1 phone 020 7946 0021x5 and wait": ["020 7946 0021"],
        "call phone: 555-010-7783 2nd floor": ["555-010-7783"],
        "call phone: 555-010-7784 555-010-7785 555-010-7786 end": ["555-010-7784"],
        "it was 020 7946 0022 apples": [],
    }
    assert dict(zip(cases, spans(spark, seen, list(cases)), strict=True)) == cases


def test_instances_found_in_one_round_support_patterns_of_the_next(spark):
    seen = [f"a{i} phone: +1 555 010 {1000 + i} b{i}" for i in range(150)] + [f"a{i} phone: 555-020-{1000 + i} b{i}" for i in range(30)]
    seen += [f"c{i} Tel: 555-020-{1000 + i} d{i}" for i in range(30)] + [f"c{i} Tel: +1 555 010 {1000 + i} d{i}" for i in range(4)]
    # beside "Size" stand values that follow "phone" too, but none has a phone's shape
    seen += [f"e{i} phone: {i}k f{i}" for i in range(6)] + [f"g{i} Size: {i}k h{i}" for i in range(6)]
    assert spans(spark, seen, ["please Tel: 555-010-7777 end", "please Size: 555-010-7778 end"]) == [["555-010-7777"], []]


SPECIAL = ["hello <|endoftext|> x", "plain text", None, "<|startoftext|>", "", "a<|endoftext|>b <|ENDOFTEXT|>\n<|endoftext|> it's", "end"]


def library(text, end):
    return [*Tokenizer.from_file(queries.TOKENIZER).encode(text or "", add_special_tokens=False).ids, end]


def test_strings_of_added_tokens_are_encoded_as_by_the_library(spark, tmp_path):
    df = frame(spark, SPECIAL).withColumns({"lang": F.lit("en"), "source": F.lit("x"), "n_chars": F.lit(1)})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    crc = {d: zlib.crc32(np.array(library(t, 2), "<u4").tobytes()) for d, t in enumerate(SPECIAL)}
    got = queries.op8_token_file(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == crc
    assert [r.start for r in got] == np.cumsum([0, *[len(library(t, 2)) for t in SPECIAL[:-1]]]).tolist()
    assert {r.doc_id: r.doc_tokens for r in queries.op1_packing(spark, str(tmp_path)).collect()} == {d: len(library(t, 1)) for d, t in enumerate(SPECIAL)}
    packed = corpus_pipeline.packing_stage(spark, df, str(tmp_path)).orderBy("doc_id", "start").collect()
    assert {d: np.frombuffer(b"".join(r.ids for r in packed if r.doc_id == d), "<u4").tolist() for d in range(len(SPECIAL))} == {d: library(t, 1) for d, t in enumerate(SPECIAL)}


def test_plain_paths_are_memory_mapped(tmp_path, monkeypatch):
    for kind, x in ((".bin", np.array([5, 6, 2, 2], "<u2")), (".off", np.array([0, 3, 4], "<u8")), (".doc", np.array([1, 7], "<i8"))):
        (tmp_path / f"shard{kind}").write_bytes(x.tobytes())
    real, mapped = np.memmap, []
    monkeypatch.setattr(np, "memmap", lambda path, *a, **k: mapped.append(path) or real(path, *a, **k))
    for path in (f"{tmp_path}/shard", f"file://{tmp_path}/shard"):
        (batch,) = tokenfile._read_shard(path, 10, 2)
        assert batch.column("doc_id").to_pylist() == [1, 7] and batch.column("start").to_pylist() == [10, 13]
    assert mapped == [f"{tmp_path}/shard{k}" for k in (".bin", ".off", ".doc")] * 2


def test_language_model_of_order_three(spark, monkeypatch):
    monkeypatch.setattr(keycounts, "BLOCK_WORDS", 50)
    rng = random.Random(3)
    texts = ["", None, "a", *(" ".join(rng.choice("abcde") if rng.random() < 0.9 else f"r{rng.randrange(50)}" for _ in range(rng.randrange(40))) for _ in range(60))]
    words = [["\0begin", *(t or "").split(), "\0end"] for t in texts]
    c, left, n, kinds = collections.Counter(), collections.Counter(), 0, set()
    for d, x in enumerate(words):
        if d % 3 != 1:
            n, kinds = n + len(x) - 1, kinds | set(x[1:])
            for i in range(1, len(x)):
                for k in range(min(i, 2) + 1):
                    c[tuple(x[i - k : i + 1])] += 1
                    left[tuple(x[i - k : i])] += 1

    @functools.cache
    def p(u, w):
        return (c[(*u, w)] + lm.PRIOR * p(u[1:], w)) / (left[u] + lm.PRIOR) if u else (c[(w,)] + 1) / (n + len(kinds) + 1)

    want = [round(sum(math.log10(p(tuple(x[max(0, i - 2) : i]), x[i])) for i in range(1, len(x))), 6) for x in words]
    got = lm.lm_scores(frame(spark, texts), F.col("doc_id") % 3 == 1, order=3).orderBy("doc_id").collect()
    assert [round(r.score, 6) for r in got] == want
    for u in (("a", "b"), ("\0begin", "a"), ("never", "seen")):
        assert abs(sum(p(u, w) for w in kinds) + p(u, "unknown") - 1) < 1e-9


def test_quality_learns_in_six_passes():
    texts, labels = ["a good river stone", "BAD!! noise", "green river walks", "noise BAD"] * 3, [1, 0, 1, 0] * 3
    got, six = quality.fit(texts, labels), quality.fit(texts, labels, epochs=6)
    assert got.bias == six.bias and (got.weight == six.weight).all()
