"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram of a given order over words between white space (A-Z in lower case) and an end token. A state is the words before, at
most order - 1 of them; an arc of state u reads w with log10 P(w|u) if u w occurs in training, otherwise the state's failure arc leads to
the state without u's first word, at the cost of its backoff weight, and the root's arc reads w. With c counts in training, N
tokens, V kinds and v for u without its first word:

    root:     P(w)   = (c(w) + 1) / (N + V + 1)                 (one arc for all unknown words)
    arc:      P(w|u) = (c(u w) + m P(w|v)) / (c(u) + m)
    failure:  b(u)   = m / (c(u) + m)

so every state's probabilities sum to 1. Counts cover all training documents, without any cut-off; they live in shards
(see ``keycounts``), and each block of documents gets just the states and arcs its texts can reach. The arc that a token is read by names the
state of the next, so states are carried from left to right level by level, for all documents of a block at once.

Defined cases: null or empty text is only the end token; a null doc_id is trained on; repeated rows count each; an empty table
gives no rows; without training documents every probability is the root's; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quay.llm import columns, keycounts, shared

END, BEGIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
PRIOR = 100.0
ORDER = 2
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def traced(block: keycounts.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with the end and the begin behind them; for every token its word, the word before and its document."""
    hashes = np.concatenate((block.hashes, [END, BEGIN]))
    end, begin = len(hashes) - 2, len(hashes) - 1
    docs = len(block.ids)
    word = np.insert(block.words.astype(np.int64), block.bounds[1:], end)
    before = np.insert(block.words.astype(np.int64), block.bounds[:-1], begin)
    return hashes, word, before, np.repeat(np.arange(docs), np.diff(block.bounds) + 1)


def word_keys(hashes: np.ndarray) -> np.ndarray:
    """Even keys: ``keycounts`` sums these up."""
    return columns.mixed(hashes ^ np.uint64(0xA0761D6478BD642F)) & ~np.uint64(1)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return columns.mixed(a * np.uint64(0xE7037ED1A0B428DB) + columns.mixed(b)) | np.uint64(1)


@dataclass
class Arcs:
    """The arcs of all states of one length that a block's texts take."""

    keys: np.ndarray
    state: np.ndarray  # the arc's state: an arc of one word less, or a word for states of one word
    word: np.ndarray
    lower: np.ndarray  # the arc that reads the same word after the failure arc (none for states of one word)
    tokens: np.ndarray  # the tokens that have so many words, or the begin, before them
    arc: np.ndarray  # the arc of each of them


def levels(block: keycounts.Block, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[Arcs]]:
    """Hashes, words and documents as ``traced`` gives them, and the arcs of states of 1, 2, ... order - 1 words."""
    hashes, word, before, doc = traced(block)
    place = np.arange(len(word)) - (block.bounds[:-1] + np.arange(len(block.ids)))[doc]
    out, names, state, tokens = [], hashes, before, np.arange(len(word))
    for n in range(1, order):
        kinds, first, arc = np.unique(state * len(hashes) + word[tokens], return_index=True, return_inverse=True)
        a, b = np.divmod(kinds, len(hashes))
        lower = out[-1].arc[np.searchsorted(out[-1].tokens, tokens[first])] if out else np.zeros(0, np.int64)
        names = pair_keys(names[a], hashes[b])
        out.append(Arcs(names, a, b, lower, tokens, arc))
        if n < order - 1:
            more = place[tokens] >= n
            # the arc that read the token before is the state of this one
            state, tokens = arc[np.searchsorted(tokens, tokens[more] - 1)], tokens[more]
    return hashes, word, doc, out


def request(block: keycounts.Block, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """All words and arcs of the block, counted over its training documents (flag 0)."""
    hashes, word, doc, found = levels(block, order)
    learned = block.flags[doc] == 0
    counts = [np.bincount(word[learned], minlength=len(hashes))[:-1]]
    counts += [np.bincount(x.arc[learned[x.tokens]], minlength=len(x.keys)) for x in found]
    keys = np.concatenate((word_keys(hashes[:-1]), *(x.keys for x in found)))
    order_of = np.argsort(keys)
    return keys[order_of], np.concatenate(counts)[order_of]


def reader(tokens: int, kinds: int, prior: float, order: int = ORDER) -> Callable[[keycounts.Block, np.ndarray], pa.Table]:
    def read(block: keycounts.Block, counts: np.ndarray) -> pa.Table:
        hashes, word, doc, arcs = levels(block, order)
        keys = np.concatenate((word_keys(hashes[:-1]), *(x.keys for x in arcs)))
        found = np.empty(len(keys), np.float64)
        found[np.argsort(keys)] = counts
        one, *more = np.split(found, np.cumsum([len(hashes) - 1, *(len(x.keys) for x in arcs[:-1])])) if arcs else (found,)
        root = (one + 1) / (tokens + kinds + 1)
        left = np.append(one, one[-1])  # how often each state was left; a text begins as often as one ends
        base = np.log10(root)
        score = base[word]
        for n, (x, count) in enumerate(zip(arcs, more, strict=True)):
            lower = value[x.lower] if n else base[x.word]  # noqa: F821
            total = left[x.state] + prior
            value = np.where(count > 0, np.log10((count + prior * 10**lower) / total), np.log10(prior / total) + lower)
            score[x.tokens] = value[x.arc]
            left = count
        edges = np.concatenate(([0], np.cumsum(np.diff(block.bounds) + 1)))
        total_of = lambda x: columns.sums(x, edges)
        ids = pa.array(block.ids, mask=block.null_ids.astype(bool))
        return pa.Table.from_pydict({
            "doc_id": ids, "held_out": pa.array(block.flags.astype(bool)), "n_tokens": pa.array(np.diff(edges)),
            "n_known": pa.array(total_of((one > 0).astype(np.int64)[word])), "base_score": pa.array(total_of(base[word])), "score": pa.array(total_of(score)),
        })

    return read


def lm_scores(docs: DataFrame, held_out: Column, *, prior: float = PRIOR, order: int = ORDER) -> DataFrame:
    """Scores of all documents by a model of those that are not held out; ``train_tokens`` is N. ``order`` is at least 1."""
    folder = shared.scratch(docs.sparkSession, "lm")
    rows = keycounts.picked(docs, F.coalesce(held_out, F.lit(False)))
    keys_of = lambda block: request(block, order)
    answered = shared.stored(keycounts.answers(keycounts.requests(rows, keys_of, folder, keycounts.shard_bits(docs))), "counts")
    n = answered.agg(F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    return keycounts.per_block(answered, reader(n.total, n.kinds, prior, order), SCHEMA).withColumn("train_tokens", F.lit(n.total))
