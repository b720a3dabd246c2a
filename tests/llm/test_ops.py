"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quay.llm import chat, decontam, exact, keycounts, lines, lm, packing, pii, quality, shared, tokenfile
from quay.llm.tokens import TokenCache
from tokenizers import Tokenizer

UP = {c: c + 32 for c in range(65, 91)}
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " \n\t ", "a", "Don't STOP, it's 3.14!! x-y's (a) 'quoted' <|endoftext|> end", "École été ÉTÉ naïve Straße İstanbul ΑΣ ας ﬁ é Å ½ 日本語 한국 😀😀  x　y", "word " * 3000, "x" * 5000, "a.b,c;d!'e'\x00\x0b\x85 z", "the the the"]


def frame(spark, texts, extra=True):
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(None, "null id", None, None), (0, "again", "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long")
    return df.withColumns({c: F.lit(1) for c in ("path", "flag", "ids", "length", "score", "digest", "shard")}) if extra else df


def documents(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def reference_ids(text):
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_cached_tokens_equal_the_library():
    rng = random.Random(0)
    letters = "abcXYZéÉßñÇİΣσ'.,-! 0129\n\t😀́你"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    cache = TokenCache(TOKENIZER, 1, size=50)
    ids, bounds = cache.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*reference_ids(t), 1], repr(t)


def test_packing(spark):
    df = frame(spark, ODD)
    got = collections.defaultdict(list)
    pieces = packing.pack(df, TOKENIZER, longest=64).collect()
    for r in pieces:
        assert len(r.ids) == 4 * r.length and r.length in (1, 2, 4, 8, 16, 32, 64) and r.offset == 0
        got[r.doc_id, r.doc_tokens].append((r.start, r.ids))
    assert len({r.sequence_id for r in pieces}) == len(pieces)
    by_bucket = sorted((r.sequence_id, r.length) for r in pieces)
    assert [n for _, n in by_bucket] == sorted(n for _, n in by_bucket)
    want = collections.Counter((d, np.array([*reference_ids(t), 1], "<u4").tobytes()) for d, t in documents(df))
    joined = collections.Counter((d, b"".join(x for _, x in sorted(v))) for (d, _), v in got.items())
    assert joined == want
    assert packing.pack(df.limit(0), TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, TOKENIZER, longest=100)


def test_token_file_round_trip(spark):
    df = frame(spark, ODD)
    file = tokenfile.write(df, TOKENIZER, shared.scratch(spark, "t"), end_id=2, partitions=3)
    rows = tokenfile.read(spark, file).orderBy("start").collect()
    want = sorted(((tokenfile.NO_ID if d is None else d), t or "") for d, t in documents(df))
    at = 0
    for r, (d, t) in zip(rows, want, strict=True):
        ids = [*reference_ids(t), 2]
        assert (tokenfile.NO_ID if r.doc_id is None else r.doc_id, r.start, r.n_tokens) == (d, at, len(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)
    empty = tokenfile.write(df.limit(0), TOKENIZER, shared.scratch(spark, "t"))
    assert empty.shards == [] and tokenfile.read(spark, empty).count() == 0


def test_exact_dedup(spark):
    df = frame(spark, [*ODD, "a", "A", "the the the", None])
    docs = documents(df)
    groups = collections.defaultdict(list)
    for d, t in docs:
        groups[t or ""].append(-1 if d is None else d)
    want = sorted((-1 if d is None else d, max(groups[t or ""]), len(groups[t or ""]), (-1 if d is None else d) == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in docs)
    got = sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_dedup(df, salts=3).collect())
    assert got == want
    kept = exact.kept_documents(df)
    assert kept.columns == df.columns and kept.count() == sum(k for *_, k, _ in want)
    assert exact.exact_dedup(df.limit(0)).count() == 0


def test_exact_dedup_compares_content_when_digests_clash(spark, monkeypatch):
    real = exact.prepared
    monkeypatch.setattr(exact, "prepared", lambda docs, normal=None: real(docs, normal).withColumn("digest", F.lit("same")))
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in exact.exact_dedup(df).collect()) == [(1, 2, 2), (2, 2, 2), (3, 5, 2), (4, 4, 1), (5, 5, 2)]


def brute_lines(docs, least, need):
    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate(UP)

    holders = collections.defaultdict(list)
    for d, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k].append(-1 if d is None else d)
    out = []
    for d, t in docs:
        ls = (t or "").split("\n")
        left = [x for x in ls if not (len(key(x)) >= least and len(holders[key(x)]) >= need and max(holders[key(x)]) != (-1 if d is None else d))]
        out.append((-1 if d is None else d, len(ls), len(ls) - len(left), "\n".join(left)))
    return sorted(out)


def test_line_dedup(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_LINES", 20)
    rng = random.Random(1)
    common = [f" Common LINE number {i} that is long enough\t" for i in range(8)]
    texts = ["\n".join(rng.choice([*common, f"own {rng.random()} line", "short", "", "é" * 20]) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    df = frame(spark, [*ODD, *texts])
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in lines.line_dedup(df, least_chars=20, least_docs=4).collect())
    assert got == brute_lines(documents(df), 20, 4)
    assert lines.line_dedup(df.limit(0)).count() == 0


def test_minimal_perfect_hash():
    rng = np.random.default_rng(0)
    hi, lo = rng.integers(0, 2**64, (2, 5000), np.uint64)
    levels = lines.mph_build(hi, lo)
    again = lines.unpack_levels(*lines.pack_levels(levels))
    assert sorted(lines.mph_index(again, hi, lo).tolist()) == list(range(5000))
    assert lines.mph_build(hi[:0], lo[:0]) == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(texts, items, window):
    words = lambda t: WORD.findall((t or "").translate(UP))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for d, t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [200_000, 12])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    rng = random.Random(2)
    item = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(i, item(rng.choice([1, 2, 3, 5, 6, 9, 14]))) for i in range(3, 12)] + [(1, "Zeta Beta-gamma"), (2, None), (30, "..."), (None, "kappa kappa kappa"), (1, "other one")]
    texts = [*ODD, *[" ".join(rng.choice(["a", "B", "c", "d", "e", "d.", "zeta", "é"]) for _ in range(rng.randrange(60))) for _ in range(40)], "zeta beta gamma kappa kappa kappa kappa"]
    df, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    key = lambda x: (-1 if x[0] is None else x[0], *x[1:])
    got = sorted(key((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in decontam.scan(df, bench, window=5).collect())
    assert got == sorted(map(key, brute_hits(documents(df), items, 5)))
    assert decontam.scan(df, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontam.scan(df.limit(0), bench).count() == 0


def test_cleaning(spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Start here. One, two THREE four five six! And the end of it all", 63, "en"), (2, "one two three four five six", 27, "en"), (3, None, None, None), (4, "clean text", 10, "fr")], "doc_id long, text string, n_chars long, lang string")
    got = {r.doc_id: r for r in decontam.clean(docs, bench, window=6).collect()}
    assert set(got) == {1, 3, 4} and got[1].text == "Start here. ! And the end of it all" and got[1].n_chars == len(got[1].text) and got[4].n_chars == 10 and got[3].text is None


def test_automaton_on_random_words():
    rng = random.Random(4)
    for _ in range(200):
        items = [(str(i), [rng.choice("ab") for _ in range(rng.randrange(1, 12))]) for i in range(4)]
        text = [rng.choice("abc") for _ in range(50)]
        a = decontam.Automaton.build(items, 4)
        runs, found = a.stream([a.words.get(w, -1) for w in text])
        (_, _, n, want), = brute_hits([(0, " ".join(text))], [(i, " ".join(w)) for i, w in items], 4)
        assert sum(y - x for x, y in decontam.merged(runs)) == n and sorted(found) == want


def test_chat(spark):
    logs = {1: "abc", 2: "ab", 3: "abc", 4: "abd", 5: "a", 6: "x", None: "xyz", 8: ""}
    turns = [(c, i, "user" if i % 2 == 0 else "assistant", t) for c, text in logs.items() for i, t in enumerate(text)] + [(6, 0, "user", "x"), (9, 0, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"whole": F.lit(1), "copies": F.lit(2)})
    got = {r.conv_id: (r.n_turns, r.copies) for r in chat.chat_format(df).collect()}
    assert got == {1: (3, 2), 4: (3, 1), None: (3, 1), 9: (1, 1)}
    assert chat.chat_format(df.limit(0)).count() == 0
    # boundaries between role and text count: "a"+"bc" is not "ab"+"c"
    tricky = spark.createDataFrame([(1, 0, "a", "bc"), (2, 0, "ab", "c"), (2, 1, "x", "y")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id for r in chat.chat_format(tricky).collect()} == {1, 2}


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(keycounts, "BLOCK_WORDS", 50)
    rng = random.Random(6)
    df = frame(spark, [*ODD, *[" ".join(rng.choice(["the", "The", "of", "x", "y", f"r{rng.randrange(99)}"]) for _ in range(rng.randrange(40))) for _ in range(60)]])
    held = F.col("doc_id") % 3 == 1
    docs = documents(df)
    tokens = lambda t: [*(x for x in re.split("[ \t\n\x0b\x0c\r]+", (t or "").translate(UP)) if x), "\0end"]
    train = [tokens(t) for d, t in docs if d is None or d % 3 != 1]
    one = collections.Counter(w for x in train for w in x)
    two = collections.Counter(p for x in train for p in zip(["\0begin", *x], x, strict=False))
    left = collections.Counter(p for x in train for p in ["\0begin", *x[:-1]])
    n, kinds = sum(one.values()), len(one)
    root = lambda w: (one[w] + 1) / (n + kinds + 1)
    want = []
    for d, t in docs:
        x = tokens(t)
        score = sum(math.log10((two[u, w] + lm.PRIOR * root(w)) / (left[u] + lm.PRIOR)) for u, w in zip(["\0begin", *x], x, strict=False))
        want.append((-1 if d is None else d, len(x), sum(w in one for w in x), round(sum(math.log10(root(w)) for w in x), 6), round(score, 6)))
    rows = lm.lm_scores(df, held).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in rows) == sorted(want)
    assert {r.train_tokens for r in rows} == {n}
    # every state's probabilities sum to 1
    for u in ["the", "\0begin", "never"]:
        total = sum((two[u, w] + lm.PRIOR * root(w)) / (left[u] + lm.PRIOR) for w in one) + lm.PRIOR * root("unknown") / (left[u] + lm.PRIOR)
        assert abs(total - 1) < 1e-9
    assert lm.lm_scores(df.limit(0), held).count() == 0


def test_quality(spark):
    rng = random.Random(7)
    good = lambda: " ".join(rng.choice(["river", "stone", "and", "the", "green", "walks"]) for _ in range(30))
    texts = [(i, good() if i % 2 else good().upper().replace(" ", "!! ")) for i in range(300)]
    docs = spark.createDataFrame([*texts, (900, None), (901, ""), (None, good()), (3, good())], "doc_id long, text string").withColumns({"quality": F.lit(0), "score": F.lit(9)})
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(201, None), (9999, 1)], "doc_id long, quality int")
    model = quality.learn(docs, labels, max_train=150)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    right = [(got[i] >= 0.5) == bool(i % 2) for i in range(200, 300)]
    assert sum(right) >= 97 and 0 <= got[900] == got[901] <= 1
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id and r.doc_id < 300} == {i for i in range(300) if got[i] >= 0.5}
    blind = quality.learn(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, blind).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_spans(text):
    out = []
    for k, p in PII.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (k == "email") or (k == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (k == "card" and 13 <= len(d) <= 19 and luhn(d)) or (k == "phone" and 9 <= len(d) <= 15):
                out.append(f"{k}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data(spark):
    rng = random.Random(8)
    odd = [
        "a@b.c_d@e.f x@y@z.com a..b@c.d. 1.2.3.4.5.6.7.8 0001.2.3.255 1.2.3.256 999999999999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111, 41111111111111112 5 6  7 +1((((((2 +12345678 +1 (555) 555-5555.",
        "é😀 mail ü@x.y 😀a@b.cd é 10.0.0.1😀", "1" * 5000 + " " + "a" * 5000 + "@" + "b" * 3000 + " " + "1 " * 4000,
    ]
    odd += ["".join(rng.choice("ab1240@.-+ ()é_") for _ in range(rng.randrange(80))) for _ in range(300)]
    df = frame(spark, [*ODD, *odd])
    got = {(r.doc_id, r.b) for r in pii.extract(df).select("doc_id", pii.listed(F.col("base")).alias("b")).collect()}
    assert got == {(d, brute_spans(t)) for d, t in documents(df)}
    assert pii.extract(df.limit(0)).count() == 0


def test_personal_data_by_context(spark):
    seen = [f"some words here phone: +1 555 010 {1000 + i} and more" for i in range(12)] + [f"write mail to user{i}@example.com today" for i in range(12)]
    new = ["please phone: 555-010-7777 and wait", "write mail to boss@localhost today", "it was 555-010-7777 apples"]
    got = [r.s for r in pii.extract(frame(spark, [*seen, *new], extra=False)).where(f"doc_id >= {len(seen)}").orderBy("doc_id").select(pii.listed(F.col("spans")).alias("s")).collect()]
    assert got == ["phone:14:26", "email:14:28", ""]
    base = pii.extract(frame(spark, [*seen, *new], extra=False)).where("not forall(base, b -> array_contains(spans, b))")
    assert base.count() == 0


def test_held_out_rule(spark):
    rows = spark.range(50).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)
