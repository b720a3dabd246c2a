"""Codecs as vectorised functions: there is no built-in for these formats."""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODECS = ("stored", "deflate", "zstd", "xz")
#: Codec by level of a package.
LEVEL_CODEC = {1: "deflate", 2: "zstd", 3: "xz"}
#: No block is larger than this when decoded.
MOST_RAW = 256 << 20
SAMPLE = 256 << 10


def encode(codec: str, data: bytes) -> bytes:
    if codec == "deflate":
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        return c.compress(data) + c.flush()
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=9).compress(data)
    if codec == "xz":
        return lzma.compress(data, preset=6)
    return data


def decode(codec: str, data: bytes, raw: int) -> bytes | None:
    """The decoded bytes, None where they do not come to ``raw`` or can't be decoded."""
    if not 0 <= raw <= MOST_RAW:
        return None
    try:
        if codec == "deflate":
            out = zlib.decompressobj(-15).decompress(data, raw + 1)
        elif codec == "zstd":
            import zstandard

            out = zstandard.ZstdDecompressor().decompress(data, max_output_size=raw + 1)
        elif codec == "xz":
            out = lzma.LZMADecompressor().decompress(data, raw + 1)
        else:
            out = data
    except Exception:  # noqa: BLE001  any decoder's own error: the block is damaged
        return None
    return out if len(out) == raw else None


def looks_compressible(sample: bytes) -> bool:
    """Whether a fast compression of the sample saves a tenth; under 512 bytes always."""
    if len(sample) < 512:
        return True
    import zstandard

    return len(zstandard.ZstdCompressor(level=1).compress(sample[:SAMPLE])) < len(sample[:SAMPLE]) * 9 // 10


@F.pandas_udf(T.BinaryType())
def compress(codecs: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else encode(c, bytes(d)) for c, d in zip(codecs, data, strict=True)])


@F.pandas_udf(T.BinaryType())
def decompress(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for codecs, data, raw in batches:
        yield pd.Series([None if d is None else decode(c, bytes(d), int(r)) for c, d, r in zip(codecs, data, raw, strict=True)])


@F.pandas_udf(T.BooleanType())
def compressible(samples: pd.Series) -> pd.Series:
    return pd.Series([looks_compressible(bytes(s or b"")) for s in samples])
