"""Token ids of whole texts by a public tokenizer, with a bounded cache of words.

The tokenizer drops white space and never merges across it, nor from an ASCII letter into ASCII punctuation
(other than the apostrophe), so the ids of a text are those of its pieces between such places. Each distinct piece is
encoded by the library once; two generations of a dictionary bound what a worker remembers. Texts that hold the string of an added
token (rare) are encoded whole by the library where such strings are to be those tokens.
"""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quay.llm import columns

#: Pieces in each of the two generations of the cache.
CACHE_PIECES = 220_000

#: The printable character that stands for each byte in a byte-level vocabulary: bytes that print stand for
#: themselves, the others follow from 256 on in order.
_PRINTS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = [b for b in range(256) if b not in _PRINTS]
BYTE_CHARS = {b: b for b in _PRINTS} | {b: 256 + i for i, b in enumerate(_HIDDEN)}


def piece_classes() -> np.ndarray:
    table = columns.whitespace_classes()
    table[0x41:0x5B] = table[0x61:0x7B] = columns.LETTER
    for low, high in ((0x21, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x7F)):
        table[low:high] = columns.PUNCT
    table[0x27] = columns.WORD
    return table


class TokenCache:
    """Encodes Arrow string columns with one tokenizer file.

    With ``added`` the strings of added tokens in a text are those tokens, as the library has it by default; else they are ordinary text.
    """

    def __init__(self, path: str, end_id: int, size: int = CACHE_PIECES, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.added = list(self.tokenizer.get_added_tokens_decoder().values()) if added else []
        self.end_id, self.size, self.young, self.old = end_id, size, {}, {}
        self.classes = piece_classes()

    def _encode(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, np.uint32).tobytes() for e in found]

    def _encode_letters(self, pieces: list[str]) -> list[bytes]:
        """Pieces of Latin letters are one pre-token each, so the library's model can take them as they are."""
        model, pack = self.tokenizer.model.tokenize, struct.pack
        out = []
        for p in pieces:
            found = model(p if p.isascii() else p.lower().encode().decode("latin-1").translate(BYTE_CHARS))
            out.append(pack(f"<{len(found)}I", *[x.id for x in found]))
        return out

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        got: list = [young.get(p) for p in pieces]
        missing = [i for i, x in enumerate(got) if x is None]
        letters, rest = [], []
        for i in missing:
            p = pieces[i]
            x = old.get(p)
            if x is not None:
                got[i] = young[p] = x
            else:
                (letters if p.isalpha() and (p.isascii() or (max(p) < "\u0250" and "\u0130" not in p)) else rest).append(i)
        for where, encode in ((letters, self._encode_letters), (rest, self._encode)):
            if where:
                for i, x in zip(where, encode([pieces[i] for i in where]), strict=True):
                    got[i] = young[pieces[i]] = x
        if len(young) > self.size:
            self.old, self.young = young, {}
        return got

    def _holding(self, column: pa.Array) -> np.ndarray:
        """Places of the texts that hold the string of an added token."""
        normal, found = None, np.zeros(len(column), bool)
        for token in self.added:
            content, texts = token.content, column
            if token.normalized and self.tokenizer.normalizer:
                change = self.tokenizer.normalizer.normalize_str
                normal = pa.array([change(t or "") for t in column.to_pylist()]) if normal is None else normal
                content, texts = change(content), normal
            found |= pc.fill_null(pc.match_substring(texts, content), False).to_numpy(zero_copy_only=False)
        return np.flatnonzero(found)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id behind each document, and the documents' bounds."""
        whole = self._holding(column)
        if len(whole):
            texts = column.take(pa.array(whole)).to_pylist()
            mask = np.zeros(len(column), bool)
            mask[whole] = True
            column = pc.if_else(pa.array(mask), pa.scalar("", column.type), column)
        words = columns.split(column, self.classes)
        known = self.ids_of(words.vocab.to_pylist())
        lengths = np.fromiter(map(len, known), np.int32, len(known)) >> 2
        flat = np.frombuffer(b"".join(known), np.uint32)
        starts = np.cumsum(lengths, dtype=np.int32) - lengths
        per_word = lengths[words.index]
        out_len = columns.sums(per_word, words.bounds).astype(np.int64)
        body = flat[columns.ranges(starts[words.index], per_word)]
        ends = np.cumsum(out_len)
        if len(whole):
            extra = [np.frombuffer(x, np.uint32) for x in self._encode(texts)]
            sizes = np.array(list(map(len, extra)))
            body = np.insert(body, np.repeat(ends[whole], sizes), np.concatenate(extra))
            out_len[whole] = sizes
            ends = np.cumsum(out_len)
        return np.insert(body, ends, self.end_id), np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))


_CACHES: dict[tuple, TokenCache] = {}


def token_cache(path: str, end_id: int, added: bool = False) -> TokenCache:
    """The worker's cache for this tokenizer; workers are reused between tasks."""
    if (path, end_id, added) not in _CACHES:
        _CACHES.clear()
        _CACHES[path, end_id, added] = TokenCache(path, end_id, added=added)
    return _CACHES[path, end_id, added]
