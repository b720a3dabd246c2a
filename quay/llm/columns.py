"""Vectorised word splitting over Arrow string columns.

A table of 256 byte classes says how bytes group into words; UTF-8 continuation bytes always belong to the
class of words, so no character is ever cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text is taken in slices of about so many bytes, which bounds the size of the temporary arrays.
SLICE_BYTES = 6 << 20

BLANK, WORD, LETTER, PUNCT = 0, 1, 2, 3

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_TABLE = LOWER.tobytes()


def whitespace_classes() -> np.ndarray:
    """Words are runs of anything but space and 0x09-0x0D."""
    table = np.full(256, WORD, np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = BLANK
    return table


def alnum_classes() -> np.ndarray:
    """Words are runs of 0-9, A-Z, a-z and all characters beyond ASCII."""
    table = np.full(256, BLANK, np.uint8)
    table[0x80:] = table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = WORD
    return table


@dataclass
class Words:
    """The words of some documents: ``index[k]`` is the place in ``vocab`` of the k-th word."""

    vocab: pa.Array
    index: np.ndarray
    bounds: np.ndarray  # words of document i: bounds[i]:bounds[i + 1]

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text, one row at least."""
    if batch.num_rows == 0:
        return
    _, offsets = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def split(column: pa.Array, classes: np.ndarray, lower: bool = True) -> Words:
    """Split every text of ``column`` into words.

    With classes LETTER and PUNCT in the table a word also ends between such two bytes.
    """
    raw, offsets = text_buffer(column)
    n = len(raw)
    data = raw.tobytes()
    kind = np.frombuffer(data.translate(classes.tobytes()), np.uint8)
    inside = kind != BLANK
    begins = np.empty(n, bool)
    begins[:1] = True
    np.logical_not(inside[:-1], out=begins[1:])
    if (classes == PUNCT).any():
        begins[1:] |= (kind[1:] == PUNCT) & (kind[:-1] == LETTER)
    begins[offsets[:-1][offsets[:-1] < n]] = True
    begins &= inside
    starts = np.flatnonzero(begins)
    kept = np.frombuffer(data.translate(LOWER_TABLE) if lower else data, np.uint8)[inside]
    # where each word starts once blanks are gone
    before = np.empty(len(starts) + 1, np.int32)
    before[:-1] = np.flatnonzero(begins[inside])
    before[-1] = len(kept)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(before), pa.py_buffer(kept))
    coded = words.dictionary_encode()
    bounds = np.searchsorted(starts, offsets)
    return Words(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), bounds)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... lengths[0] of them, then those of the next."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 2**31 and (not len(starts) or int(starts.max()) < 2**31 - total) else np.int64
    return np.arange(total, dtype=kind) + np.repeat((starts - (ends - lengths)).astype(kind), lengths)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i, 0 for empty runs."""
    out = np.zeros(len(bounds) - 1, values.dtype)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full])
    return out


def hashes(vocab: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every string."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w, seed) for w in vocab.cast(pa.binary()).to_pylist()), np.uint64, len(vocab))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
