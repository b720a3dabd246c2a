"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items go into one automaton over words. Each document's words stream through it; the length of the longest
match that ends at a word says whether a window of an item ends there, and the state says of which items. Hit words form spans;
cleaning cuts the spans out, again until no window is left (the two sides of a cut may form one), and drops documents of which too large
a share is hit to begin with.

Only stretches whose neighbouring words follow each other in some item are streamed: elsewhere a match is one word long.

Defined cases: null or empty text has no words and is clean; items without words have no windows; an item of fewer words than the
window is one window; items with one id count as one; an item with a null id counts under the empty id; repeated documents are
judged each; empty tables give no rows, or clean documents; other columns are ignored by ``scan`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quay.llm import columns

#: Words of the benchmark in one automaton; a larger benchmark is taken in blocks.
BLOCK_WORDS = 200_000
#: With several blocks a task builds one automaton after the other for about so many bytes of text.
GROUP_BYTES = 64 << 20
#: Bits of the table of word pairs (a filter; the automaton decides).
PAIR_BITS = 22

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCAN_SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"


def item_words(text: str | None) -> list[str]:
    return [w.translate(_LOWER) for w in WORD.findall(text or "")]


_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass
class Automaton:
    """States are sets of ends; ``arcs[s]`` leads on by word, ``link[s]`` to the state of the longest shorter suffix."""

    window: int
    words: dict[str, int] = field(default_factory=dict)
    arcs: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    longest: list[int] = field(default_factory=lambda: [0])
    full: dict[int, frozenset[str]] = field(default_factory=dict)  # state of a window's length: its items
    short: dict[int, list[tuple[int, frozenset[str]]]] = field(default_factory=dict)  # whole short items that end here, by length
    least: int = 1 << 30

    def _state(self, longest: int, arcs: dict[int, int], link: int) -> int:
        self.longest.append(longest)
        self.arcs.append(arcs)
        self.link.append(link)
        return len(self.arcs) - 1

    def _branch(self, p: int, word: int, q: int) -> int:
        """The state for exactly the words of p and this one, split off q if q also holds longer ones."""
        if self.longest[q] == self.longest[p] + 1:
            return q
        twin = self._state(self.longest[p] + 1, dict(self.arcs[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.arcs[p].get(word) == q:
            self.arcs[p][word] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, word: int) -> int:
        if word in self.arcs[last]:
            return self._branch(last, word, self.arcs[last][word])
        new, p = self._state(self.longest[last] + 1, {}, 0), last
        while p >= 0 and word not in self.arcs[p]:
            self.arcs[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._branch(p, word, self.arcs[p][word])
        return new

    def holder(self, state: int, length: int) -> int:
        """The state on the way to the root that holds the suffix of this length."""
        while self.longest[self.link[state]] >= length:
            state = self.link[state]
        return state

    @classmethod
    def build(cls, items: list[tuple[str, list[str]]], window: int) -> Automaton:
        a = cls(window)
        coded = [(i, [a.words.setdefault(w, len(a.words)) for w in ws]) for i, ws in items if ws]
        for _, ids in coded:
            last = 0
            for w in ids:
                last = a._extend(last, w)
        full: dict[int, set[str]] = {}
        short: dict[tuple[int, int], set[str]] = {}
        for item, ids in coded:
            state, n = 0, min(window, len(ids))
            a.least = min(a.least, n)
            for k, w in enumerate(ids, 1):
                state = a.arcs[state][w]
                if k >= n:
                    at = a.holder(state, n)
                    (full.setdefault(at, set()) if n == window else short.setdefault((at, n), set())).add(item)
        a.full = {s: frozenset(x) for s, x in full.items()}
        for (s, n), x in sorted(short.items()):
            a.short.setdefault(s, []).append((n, frozenset(x)))
        return a

    def pairs(self) -> np.ndarray:
        """The table of pairs of words that follow each other in an item, by ``pair_slots``."""
        table = np.zeros(1 << PAIR_BITS, bool)
        first = {w: s for w, s in self.arcs[0].items()}
        for w, s in first.items():
            if self.arcs[s]:
                table[pair_slots(np.full(len(self.arcs[s]), w), np.fromiter(self.arcs[s], np.int64))] = True
        return table

    def stream(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit runs of words [first, behind last) and the items whose windows occur."""
        arcs, link, longest, n = self.arcs, self.link, self.longest, self.window
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        state = length = 0
        for i, w in enumerate(ids):
            while state and w not in arcs[state]:
                state = link[state]
                length = longest[state]
            if w not in arcs[state]:
                continue
            state, length = arcs[state][w], length + 1
            begin = i + 1
            if length >= n:
                begin = i + 1 - n
                items |= self.full.get(self.holder(state, n), ())
            if self.short:
                up = state
                while up > 0:
                    for size, whose in self.short.get(up, ()):
                        if size <= length:
                            begin = min(begin, i + 1 - size)
                            items |= whose
                    up = link[up]
            if begin <= i:
                if runs and runs[-1][1] >= begin:
                    runs[-1] = (min(runs[-1][0], begin), i + 1)
                else:
                    runs.append((begin, i + 1))
        return runs, items


def pair_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint32) * np.uint32(2654435761)) ^ (b.astype(np.uint32) * np.uint32(2246822519))) >> np.uint32(32 - PAIR_BITS)


class Matcher:
    def __init__(self, automaton: Automaton):
        self.automaton, self.pairs = automaton, automaton.pairs()
        self.words = pa.array(list(automaton.words), pa.string())

    def hits(self, words: columns.Words) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """By document: hit runs of its words, and items."""
        a = self.automaton
        known = pc.index_in(words.vocab, self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        ids = known[words.index]
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return {}
        mine = ids[at]
        joined = np.zeros(len(at), bool)
        joined[1:] = (at[1:] == at[:-1] + 1) & self.pairs[pair_slots(mine[:-1], mine[1:])]
        doc = np.searchsorted(words.bounds, at, "right") - 1
        joined[1:] &= doc[1:] == doc[:-1]
        begin = np.flatnonzero(~joined)
        size = np.diff(np.append(begin, len(at)))
        found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for b, n in zip(begin[size >= a.least].tolist(), size[size >= a.least].tolist(), strict=True):
            runs, items = a.stream(mine[b : b + n].tolist())
            if runs:
                base = int(at[b] - words.bounds[doc[b]])
                have = found.setdefault(int(doc[b]), ([], set()))
                have[0].extend((base + x, base + y) for x, y in runs)
                have[1].update(items)
        return found


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for x, y in sorted(runs):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def automata(benchmark: DataFrame, window: int) -> list:
    """Broadcast blocks of items, each of at most BLOCK_WORDS words (or one item). Workers build the automata; the driver holds one block at a time."""
    sc = benchmark.sparkSession.sparkContext
    out, block, size = [], [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    for r in rows.toLocalIterator():
        words = item_words(r.text)
        if block and size + len(words) > BLOCK_WORDS:
            out.append(sc.broadcast((window, block)))
            block, size = [], 0
        block.append((r.item_id, words))
        size += len(words)
    return [*out, sc.broadcast((window, block))]


class Matchers:
    """The matchers of a task, one in memory at a time."""

    def __init__(self, blocks: list):
        self.blocks, self.at, self.now = blocks, -1, None

    def get(self, k: int) -> Matcher:
        if k != self.at:
            self.now = None
            window, items = self.blocks[k].value
            self.at, self.now = k, Matcher(Automaton.build(items, window))
            if len(self.blocks) > 1:
                del self.blocks[k]._value
        return self.now

    def found(self, texts: list[columns.Words]) -> list[dict]:
        """For each of some slices: by document, hit runs of words and items."""
        out: list[dict] = [{} for _ in texts]
        for k in range(len(self.blocks)):
            matcher = self.get(k)
            for words, hits in zip(texts, out, strict=True):
                for d, (runs, items) in matcher.hits(words).items():
                    have = hits.setdefault(d, ([], set()))
                    have[0].extend(runs)
                    have[1].update(items)
        return [{d: (merged(runs), items) for d, (runs, items) in hits.items()} for hits in out]

    def groups(self, batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        """Slices of rows to take together: one, or with several blocks as many as have GROUP_BYTES."""
        held, size = [], 0
        for batch in batches:
            for rows in columns.slices(batch, "text"):
                held.append(rows)
                size += columns.text_buffer(rows.column("text"))[1][-1]
                if len(self.blocks) == 1 or size >= GROUP_BYTES:
                    yield held
                    held, size = [], 0
        if held:
            yield held


def split(texts: pa.Array) -> columns.Words:
    return columns.split(texts, columns.alnum_classes())


def char_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as code points [start, end)."""
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[x][0], at[y - 1][1]) for x, y in runs]


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """One row per document: its words, the hit ones, the items whose windows occur (sorted) and the hit spans in code points."""
    blocks = automata(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Matchers(blocks)
        for group in ready.groups(batches):
            texts = [split(rows.column("text")) for rows in group]
            for rows, words, found in zip(group, texts, ready.found(texts), strict=True):
                n = rows.num_rows
                hit, items, spans = np.zeros(n, np.int64), [[]] * n, [[]] * n
                for d, (runs, whose) in found.items():
                    hit[d] = sum(y - x for x, y in runs)
                    items[d] = sorted(whose)
                    spans[d] = [{"start": x, "end": y} for x, y in char_spans(rows.column("text")[d].as_py(), runs)]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(words.counts()), pa.array(hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, kind)], ["doc_id", "n_words", "n_hit", "items", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCAN_SCHEMA)


def cut_until_clean(ready: Matchers, texts: list[str], hits: list[list[tuple[int, int]]]) -> list[str]:
    """The texts without their hit runs of words, cut again as long as what then stands side by side is hit."""
    texts, open_ = list(texts), list(range(len(texts)))
    while open_:
        for i, runs in zip(open_, hits, strict=True):
            for x, y in reversed(char_spans(texts[i], runs)):
                texts[i] = texts[i][:x] + texts[i][y:]
        found = ready.found([split(pa.array([texts[i] for i in open_], pa.large_string()))])[0]
        open_, hits = [open_[k] for k in sorted(found)], [found[k][0] for k in sorted(found)]
    return texts


def clean(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """The documents with hit spans cut out until none is left; those with more than ``max_coverage`` of their words hit before any cut go. Columns stay
    as they are, but ``n_chars``, where there is one, follows the text."""
    blocks = automata(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Matchers(blocks)
        for group in ready.groups(batches):
            texts = [split(rows.column("text")) for rows in group]
            for rows, words, found in zip(group, texts, ready.found(texts), strict=True):
                if not found:
                    yield rows
                    continue
                n_words, keep = words.counts(), np.ones(rows.num_rows, bool)
                for d, (runs, _) in found.items():
                    keep[d] = sum(y - x for x, y in runs) <= max_coverage * n_words[d]
                column = rows.column("text").to_pylist()
                part = sorted(d for d in found if keep[d])
                for d, text in zip(part, cut_until_clean(ready, [column[d] for d in part], [found[d][0] for d in part]), strict=True):
                    column[d] = text
                out = rows.set_column(rows.schema.get_field_index("text"), rows.schema.field("text"), pa.array(column, rows.schema.field("text").type))
                if "n_chars" in rows.schema.names:
                    field_ = rows.schema.field("n_chars")
                    now = pc.if_else(pa.array([d in found for d in range(rows.num_rows)]), pc.utf8_length(out.column("text")).cast(field_.type), rows.column("n_chars"))
                    out = out.set_column(rows.schema.get_field_index("n_chars"), field_, now)
                yield out.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
