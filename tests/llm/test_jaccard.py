import collections
import random
import re

import pytest
from quay.llm import graph, jaccard

UP = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", (text or "").translate(UP)) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """Component of every document by comparing all pairs."""
    sets, up = {}, {}
    for d, t in docs:
        sets.setdefault(d, []).append(shingles(t))
        up[d] = d

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    items = [(d, s) for d, many in sets.items() for s in many if s]
    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                up[hi] = lo
    return sorted((d, len(shingles(t)), find(d)) for d, t in docs)


def run(spark, docs):
    got = jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string"))
    return sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect())


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = f"z{rng.randrange(10**6)}"
        elif kind == 1:
            out.insert(i, f"z{rng.randrange(10**6)}")
        elif len(out) > 1:
            del out[i]
    return out


@pytest.mark.parametrize("seed", [1])
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "One"), (5, "a b c d"), (6, "A b  c d"), (7, "a b c d e")]
    passage = [f"p{i}" for i in range(60)]
    for family in range(14):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 9, 12, 14, 18, 25, 60, 200]))]
        for _ in range(rng.choice([2, 5, 12])):
            docs.append((len(docs), " ".join(edited(rng, words, rng.choice([0, 0, 1, 2, 3])))))
    for _ in range(40):  # one passage in many documents that are else their own, or almost nothing but the passage
        own = [f"q{rng.randrange(10**6)}" for _ in range(rng.choice([3, 8, 12, 15, 80]))]
        docs.append((len(docs), " ".join(passage + own)))
    line = " ".join(f"l{i}" for i in range(7))
    docs += [(len(docs) + i, " ".join([line] * (i % 5 + 1))) for i in range(10)]
    docs.append((2, "a b c d e f g"))  # a doc_id twice
    rng.shuffle(docs)
    assert run(spark, docs) == brute(docs)


def test_hot_group_of_near_copies(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join(edited(rng, words, 1))) for i in range(150)] + [(1000 + i, " ".join(f"u{i}x{k}" for k in range(50))) for i in range(20)]
    assert run(spark, docs) == brute(docs)


def test_empty_table_and_other_columns(spark):
    assert run(spark, []) == []
    rows = spark.createDataFrame([(1, "a b c d e f", "x", 5), (2, "a b c d e f", "y", 6), (3, "z", None, None)], "doc_id long, text string, component_id string, n long")
    kept = jaccard.kept_documents(rows)
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "a b c d e f", "x", 5), (3, "z", None, None)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (300, 200), (200, 300)]
    got = {r.u: r.label for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(1, 61)} | {101: 100, 102: 100, 300: 200}
    assert got == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_boundary_counts_costs():
    assert [jaccard.enumerations(n) for n in (1, 4, 5, 10)] == [1, 1, 6, 56]
    assert collections.Counter(map(jaccard.least_overlap, range(1, 11))) == collections.Counter([1, 2, 3, 4, 4, 5, 6, 7, 8, 8])
