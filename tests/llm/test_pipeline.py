"""The pipeline on a small fixture, each stage against a brute-force version."""

import collections

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from quay.llm import quality, queries
from test_jaccard import brute
from test_ops import brute_hits
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, written and read again as a cluster run would."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    nulls = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "x", 0), (10**6 + 1, "", "en", "x", 0)], docs.schema)
    docs, out = docs.unionByName(nulls), []
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, docs))
        stage(spark, docs, SF).write.parquet(f"{folder}/{len(out)}")
        docs = spark.read.parquet(f"{folder}/{len(out)}")
    return [*out, ("end", docs)]


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_names_and_columns(stages):
    assert [n for n, _ in stages[:-1]] == ["quality classifier", "exact dedup", "near duplicates", "benchmark decontamination", "packing"]
    assert len({tuple(df.columns) for _, df in stages[:-1]}) == 1
    assert corpus_pipeline.ORACLE_SQL is None


def test_quality_keeps_what_scores(spark, stages):
    before, after = stages[0][1], stages[1][1]
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~quality.held_out(F.col("doc_id")))
    model = quality.learn(before, labels)
    kept = {r.doc_id for r in quality.score(before, model).where("score >= 0.5").collect()}
    assert {d for d, _ in rows(after)} == kept and len(kept) > 100


def test_exact(stages):
    before, after = rows(stages[1][1]), rows(stages[2][1])
    best = {}
    for d, t in before:
        best[t or ""] = max(d, best.get(t or "", d))
    assert collections.Counter(after) == collections.Counter((d, t) for d, t in before if best[t or ""] == d)


def test_near(stages):
    before, after = rows(stages[2][1]), rows(stages[3][1])
    keep = {d for d, _, c in brute(before) if d == c}
    assert {d for d, _ in after} == keep


def test_decontaminated(spark, stages):
    before, after = rows(stages[3][1]), dict(rows(stages[4][1]))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = 0
    for d, n, hit, _ in brute_hits(before, items, 10):
        text = dict(before)[d]
        if not hit:
            assert after[d] == text
        elif 2 * hit > n:
            assert d not in after
            gone += 1
        else:
            assert len(after[d]) < len(text)
    assert len(after) == len({d for d, _ in before}) - gone
    assert all(hit == 0 for *_, hit, _ in brute_hits(list(after.items()), items, 10))
    changed = {d for d, t in before if d in after and after[d] != t}
    assert changed and all(r.n_chars == len(r.text) for r in stages[4][1].where(F.col("doc_id").isin(*changed)).collect())


def test_packed(stages):
    before, pieces = rows(stages[4][1]), stages[5][1].collect()
    plain = Tokenizer.from_file(queries.TOKENIZER)
    want = collections.Counter()
    for d, t in before:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        while at < len(ids):
            size = min(2048, 1 << (len(ids) - at).bit_length() - 1)
            want[d, at, b"".join(i.to_bytes(4, "little") for i in ids[at : at + size])] += 1
            at += size
    assert collections.Counter((r.doc_id, r.start, bytes(r.ids)) for r in pieces) == want
    assert len({r.sequence_id for r in pieces}) == len(pieces) and all(r.offset == 0 and r.length <= 2048 for r in pieces)
