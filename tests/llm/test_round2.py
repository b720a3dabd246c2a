"""What the review of the first round asked for: clashing names, hot groups, long texts, registered queries against brute force."""

import collections
import math
import random
import re
import time
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quay.llm import decontam, exact, jaccard, keycounts, lm, pii, quality, queries, shared
from test_jaccard import brute, run, shingles
from test_ops import brute_hits, brute_spans
from tokenizers import Tokenizer

UP = {c: c + 32 for c in range(65, 91)}
SF = "/root/testdata/sf0.001"


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# -- names and places ----------------------------------------------------------------------------------------------------


def test_helper_names_may_be_columns(spark):
    texts = ["a b c d e f", "a b c d e f", "z"]
    df = frame(spark, texts).withColumns({c: F.col("doc_id") for c in ("_id", "id", "ID_", "digest", "_digest", "gone", "_gone", "salt", "at", "hot", "cold", "keep_id")})
    for kept, ids in ((exact.kept_documents(df), {1, 2}), (jaccard.kept_documents(df), {0, 2})):
        assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == ids
    bench = spark.createDataFrame([(1, "a b c d e f", "x")], "item_id long, text string, n_hit string")
    odd = df.withColumns({c: F.lit(1) for c in ("n_hit", "spans", "items")})
    cleaned = decontam.clean(odd, bench, window=6)
    assert cleaned.columns == odd.columns and {r.doc_id: r.text for r in cleaned.collect()} == {2: "z"}


def test_unset_folder_is_refused_on_a_cluster():
    there = types.SimpleNamespace(conf={}, sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(there)
    there.sparkContext.master = "local-cluster[3,2,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(there)


def test_hot_groups_and_rare_ones(spark, monkeypatch):
    monkeypatch.setattr(exact, "HOT", 3)
    rng = random.Random(1)
    texts = ["hot"] * 300 + [f"t{rng.randrange(60)}" for _ in range(100)] + [None, ""] * 3
    df = frame(spark, texts).unionByName(spark.createDataFrame([(None, "hot"), (5, "hot")], "doc_id long, text string"))
    want, groups = [], collections.defaultdict(list)
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    for d, t in rows:
        groups[t].append(-1 if d is None else d)
    want = sorted((-1 if d is None else d, max(groups[t]), len(groups[t])) for d, t in rows)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.keep_id, r.group_size) for r in exact.exact_dedup(df).collect())
    assert got == want


# -- Jaccard join --------------------------------------------------------------------------------------------------------


def test_subsets_of_small_sets():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 2**63, (5, 6)).astype(np.uint64), axis=1)
    got = [r for b in jaccard.subsets(np.arange(5), 7, keys) for r in b.to_pylist()]
    assert collections.Counter((r["cid"], r["c"]) for r in got) == {(i, 6): 1 for i in range(5)}
    assert len({r["subset"] for r in got}) == 5
    some = [r for b in jaccard.subsets(np.arange(2), 6, keys[:2]) for r in b.to_pylist()]
    assert collections.Counter((r["cid"], r["c"]) for r in some) == {(i, c): math.comb(6, c) for i in range(2) for c in (5, 6)}


def test_bitmaps_bound_what_sets_share():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 300, 200).astype(np.uint64)) for _ in range(2))
        x, y = (jaccard.parities(k, np.zeros(len(k), np.int64), 1)[0].view(np.uint64) for k in (a, b))
        assert sum(int(i).bit_count() for i in x ^ y) <= len(np.setxor1d(a, b))


def test_shared_passage_that_links_nobody(spark, monkeypatch):
    """3,000 documents hold one passage and some words of their own: so many that no two link, or links only some."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(100)]
    docs = []
    for i in range(3000):
        at = rng.randrange(101)
        docs.append((i, " ".join([*passage[:at], *(f"u{i}x{k}" for k in range(rng.choice([14, 16, 20]))), *passage[at:]])))
    docs += [(5000 + i, docs[i][1] + " tail") for i in range(10)]
    seen = []
    real = jaccard.compared

    def counted(pairs, reps):
        seen.append(pairs.count())
        return real(pairs, reps)

    monkeypatch.setattr(jaccard, "compared", counted)
    got = {d: c for d, _, c in run(spark, docs)}
    assert got == {d: (d - 5000 if d >= 5000 else d) for d, _ in docs}
    assert sum(seen) < 30_000  # of 4.5 million pairs


def test_chain_of_near_copies_without_a_hub(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(250):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            words[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    assert run(spark, docs) == brute(docs)


# -- decontamination -----------------------------------------------------------------------------------------------------


def test_cutting_goes_on_until_nothing_is_hit(spark, monkeypatch):
    items = [(1, "one two three four"), (2, "red green blue black"), (3, "w x y z")]
    own = " ".join(f"own{i}" for i in range(40))
    texts = [f"{own} red green one two three four blue black {own}", f"{own} w x red green one two three four blue black y z {own}", own, None]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (200_000, 4):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
        got = {r.doc_id: r.text for r in decontam.clean(frame(spark, texts), bench, window=4).collect()}
        assert set(got) == {0, 1, 2, 3} and all(hit == 0 for _, _, hit, _ in brute_hits(list(got.items()), items, 4))
        assert got[0].split() == got[1].split() == own.split() * 2 and got[2] == own and got[3] is None


# -- personal data -------------------------------------------------------------------------------------------------------


def test_spans_of_long_texts(spark):
    rng = random.Random(3)
    bits = ["word", "😀", "user1@example.com", "10.0.0.1", "+1 (555) 010-7777", "4111 1111 1111 1111", "é", "x12", "\n", ".", "(", "2024", "999.1.1.1"]
    texts = [" ".join(rng.choice(bits) for _ in range(n)) for n in (10, 300, 1000, 4000)] + ["a" * 4090 + " a@b.cd " + "+1234567890" * 2 + " " + "5" * 5000, "1 " * 6000]
    got = {r.doc_id: r.b for r in pii.extract(frame(spark, texts)).select("doc_id", pii.listed(F.col("base")).alias("b")).collect()}
    assert got == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_words_beside_spans_are_found_wherever_they_stand(spark):
    """The same lines at any place of a long text have the same added spans."""
    seen = [f"some words phone: +1 555 010 {1000 + i} and more" for i in range(40)]
    line = "please phone: (555) 010-7777 and wait"
    texts = [*seen, *("x" * k + " filler words " * j + line + " filler" * 900 for j, k in ((0, 1), (290, 3), (290, 20), (291, 26), (600, 0), (1200, 5)))]
    rows = pii.extract(frame(spark, texts)).where("doc_id >= 40").collect()
    assert len(rows) == 6
    for r in rows:
        assert [texts[r.doc_id][s.start : s.end] for s in r.spans] == ["(555) 010-7777"]


def test_long_texts_take_linear_time(spark):
    rng = random.Random(4)
    text = " ".join(rng.choice([f"w{rng.randrange(10**4)}", f"user{rng.randrange(99)}@example.com", "plain", f"10.0.0.{rng.randrange(99)}"]) for _ in range(60_000))
    assert len(text) > 5 * 10**5
    pii.extract(frame(spark, ["warm 1.2.3.4 up"])).count()
    began = time.monotonic()
    pii.extract(frame(spark, [text])).agg(F.sum(F.size("spans"))).collect()
    assert time.monotonic() - began < 60  # minutes, were it not linear


def brute_confident(edges, rounds, confident, support):
    """Patterns by kind, scored with plain dictionaries."""
    totals = collections.defaultdict(set)
    for p, v, _ in edges:
        totals[p].add(v)
    known = {(p, v, k): (1.0, 1) for p, v, k in edges if k >= 0}
    fresh = {(p, v) for p, v, k in edges if k < 0}
    for r in range(rounds):
        score, seeds = collections.Counter(), collections.Counter()
        for (p, _, k), (s, one) in known.items():
            score[p, k] += s
            seeds[p, k] += one
        found = {pk: score[pk] / len(totals[pk[0]]) for pk in score if seeds[pk] >= support and score[pk] / len(totals[pk[0]]) >= confident}
        if r == rounds - 1:
            return found
        wrong = collections.defaultdict(float)
        for p, v in fresh:
            for (q, k), c in found.items():
                if p == q:
                    wrong[v, k] += math.log(max(1 - c, 1e-6))
        known = {(p, v, k): (1.0, 1) for p, v, k in edges if k >= 0}
        for (v, k), w in wrong.items():
            s = 1 - math.exp(w)
            one = int(s >= confident and bool(re.search(pii.SHAPES[pii.KINDS[k]], v)))
            for p, x in fresh:
                if x == v:
                    old = known.get((p, v, k), (0.0, 0))
                    known[p, v, k] = (max(old[0], s), max(old[1], one))
    return None


def test_scoring_rounds_against_brute_force(spark):
    rng = random.Random(12)
    for _ in range(3):
        edges = set()
        for _ in range(400):
            p, v = f"L p{rng.randrange(8)}", f"555010{rng.randrange(7000, 7090)}"
            seed = hash(v) % 2 == 0 or int(v) % 3 != 0
            edges.add((p, v, 3 if seed and rng.random() < 0.97 else -1))
        got = {(r.pattern, r.kind): r.confidence for r in pii.scored(spark.createDataFrame(sorted(edges), "pattern string, value string, kind int"), rounds=3, confident=0.7, support=5).collect()}
        want = brute_confident(edges, 3, 0.7, 5)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


# -- quality -------------------------------------------------------------------------------------------------------------


def slow_buckets(word):
    chars = [ord(c) for c in f"\x02{word}\x03"]
    mask, factor = 2**64 - 1, 1_000_003

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    power = lambda k: pow(factor, k, 2**64)
    n = len(chars)
    whole = sum(c * power(min(n - i, 64)) + mixed(n - i) * c for i, c in enumerate(chars)) & mask
    out = [mixed(whole + 1 & mask) >> 64 - quality.BUCKET_BITS]
    for size in quality.SIZES:
        for i in range(n - size + 1):
            code = 0
            for c in chars[i : i + size]:
                code = (code * factor + c) & mask
            out.append(mixed(code + size + 1 & mask) >> 64 - quality.BUCKET_BITS)
    return out


def test_scores_against_a_slow_mean_and_softmax():
    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(size=1 << quality.BUCKET_BITS), 0.3)
    texts = ["", None, "one", "a b a", "Ünï  code x 😀", "long" * 40 + " x\ty\nz", "  "]
    got = quality.scores(model, pa.array(texts))
    for t, s in zip(texts, got, strict=True):
        found = [b for w in re.split("[ \t\n\x0b\x0c\r]+", t or "") if w for b in slow_buckets(w)]
        z = np.array([0.0, (np.mean(model.weight[found]) if found else 0.0) + model.bias])
        p = np.exp(z - z.max())
        assert abs(s - p[1] / p.sum()) < 1e-9, t


def test_training_splits_words_as_scoring_does():
    good, bad = "calm river stone", "LOUD noise here"
    model = quality.fit([good, bad] * 30, [1, 0] * 30)
    found = quality.scores(model, pa.array([good, bad]))
    assert found[0] > 0.9 and found[1] < 0.1


def test_repeated_ids_and_long_texts_do_not_grow_the_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "MAX_BYTES", 100)
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, "c"), (3, "x" * 101)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    kept = []
    monkeypatch.setattr(quality, "fit", lambda texts, labels: kept.append((texts, labels)))
    quality.learn(docs, labels)
    assert kept == [(["a", "c"], [0, 1])]


# -- registered queries --------------------------------------------------------------------------------------------------


def test_op1_and_op8_queries(spark):
    docs, plain = documents(spark), Tokenizer.from_file(queries.TOKENIZER)
    found = {d: plain.encode(t or "", add_special_tokens=False).ids for d, t in docs}
    ids = {d: np.array([*found[d], 1], "<u4") for d, _ in docs}
    pieces, lengths = collections.defaultdict(list), collections.Counter()
    for r in queries.op1_packing(spark, SF).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        lengths[r.sequence_id] += r.length
        assert r.offset == 0 and r.length <= 2048 and r.length & (r.length - 1) == 0
    for d, x in ids.items():
        at = 0
        for start, length in sorted(pieces[d]):
            assert start == at
            at += length
        assert at == len(x)
    assert max(lengths.values()) <= 2048
    start, want = 0, {}
    for d in sorted(found):
        own = np.array([*found[d], 2], "<u4")
        want[d] = (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op8_token_file(spark, SF).collect()} == want


def test_op4_query(spark):
    import hashlib

    texts = dict(documents(spark))
    rows = queries.op4_pii(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        want = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        kinds = collections.Counter(s.split(":")[0] for s in want.split(",") if s)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in pii.KINDS)
        assert not set(filter(None, want.split(","))) - set(r.spans.split(","))


def test_op6_query(spark):
    docs = documents(spark)
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*(x for x in re.split("[ \t\n\x0b\x0c\r]+", (t or "").translate(UP)) if x), "\0end"]
    train = [tokens(t) for d, t in docs if not held(d)]
    grams = [collections.Counter() for _ in range(3)]
    left = [collections.Counter() for _ in range(3)]
    for x in train:
        y = ["\0begin", *x]
        for i in range(len(x)):
            for n in range(3):
                if i + 1 - n >= 0:
                    gram = tuple(y[i + 1 - n : i + 2])
                    grams[n][gram] += 1
                    if n:
                        left[n][gram[:-1]] += 1
    total, kinds = sum(grams[0].values()), len(grams[0])

    def p(context, w):
        if not context:
            return (grams[0][w,] + 1) / (total + kinds + 1)
        n = len(context)
        return (grams[n][(*context, w)] + lm.PRIOR * p(context[1:], w)) / (left_of(context) + lm.PRIOR)

    def left_of(context):
        return sum_of.get(context, 0)

    sum_of = collections.Counter()
    for n in (1, 2):
        sum_of.update(left[n])
    rows = {r.doc_id: r for r in queries.op6_lm(spark, SF).collect()}
    assert set(rows) == {d for d, _ in docs}
    for d, t in docs[:80]:
        x = tokens(t)
        y = ["\0begin", *x]
        r = rows[d]
        assert r.held_out == held(d) and r.n_tokens == len(x) and r.train_tokens == total and r.n_known == sum(grams[0][w,] > 0 for w in x)
        base = sum(math.log10((grams[0][w,] + 1) / (total + kinds + 1)) for w in x)
        score = sum(math.log10(p(tuple(y[max(0, i - 1) : i + 1]), w)) for i, w in enumerate(x))
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and abs(r.score - score) < 1e-6 * max(1, abs(score))


def test_op7_query(spark):
    docs = documents(spark)
    rows = {r.doc_id: r for r in queries.op7_quality(spark, SF).collect()}
    assert set(rows) == {d for d, _ in docs}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    mine = sorted((d, t or "") for d, t in docs if labels.get(d) in (0, 1) and zlib.crc32(str(d).encode()) % 3 != 1)
    model = quality.fit([t for _, t in mine], [int(labels[d]) for d, _ in mine])
    want = quality.scores(model, pa.array([t for _, t in docs]))
    for (d, _), s in zip(docs, want, strict=True):
        r = rows[d]
        assert abs(r.score - s) < 1e-9 and r.predicted == int(s >= 0.5) and r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1)


def test_blocks_of_any_size_give_the_same_sets(spark, monkeypatch):
    docs = [(i, " ".join(f"w{(i // 3) * 50 + k}" for k in range(40)) + (f" x{i}" if i % 3 else "")) for i in range(60)]
    monkeypatch.setattr(jaccard, "BLOCK_WORDS", 100)
    assert run(spark, docs) == brute(docs)
    assert all(len(shingles(t)) == n for (_, t), (_, n, _) in zip(docs, run(spark, docs), strict=True))
    assert keycounts.parts(frame(spark, ["a"])) == 4
