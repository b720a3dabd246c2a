"""Binary package volumes as rows.

A volume is a head, blocks (a fixed head, then the stored bytes) and a tail, all little-endian. Reading is a Python data source with one partition for each
volume; bytes come in one block at a time. Volumes whose stream is encrypted can't be read here: there is no library for it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The layout. Magic: three letters that are the format's own, then V, B or T.
HEAD = struct.Struct("<4sHI16sBB4x")  # magic, format, volume, package, level, cipher
BLOCK = struct.Struct("<4sBBxxqq32s")  # magic, kind, flags, raw size, stored size, SHA-256 of the raw bytes
TAIL = struct.Struct("<4sIqq8x")  # magic, blocks, position of the index, bytes before the tail
INDEX_KIND = 255
KINDS = {0: "stored", 1: "deflate", 2: "zstd", 3: "xz", INDEX_KIND: "index"}
MOST_RAW, MOST_STORED, NEWEST = 256 << 20, 257 << 20, 1

SCHEMA = "path string, volume long, package string, level int, block int, pos long, codec string, raw long, stored_size long, sha256 string, stored binary, problem string"


@dataclass
class VolumePartition(InputPartition):
    path: str


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.magic = options["path"], options["magic"].encode()
        self.content = options.get("content", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, at = _filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(at, recursive=True))
        return [VolumePartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file] or [VolumePartition("")]

    def read(self, partition: VolumePartition) -> Iterator[tuple]:
        if not partition.path:
            return
        system, _ = _filesystem(self.path)
        with system.open_input_stream(partition.path) as f:
            yield from read_volume(partition.path, f.read, self.magic, self.content)


def _filesystem(uri: str):
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def read_volume(path: str, take, magic: bytes, content: bool = True) -> Iterator[tuple]:
    """Rows of one volume; what is wrong with it is the ``problem`` of its last row."""

    def bad(problem: str, pos: int = 0) -> tuple:
        return (path, None, None, None, None, pos, None, None, None, None, None, problem)

    head = take(HEAD.size)
    if len(head) < HEAD.size or head[:4] != magic + b"V":
        yield bad("not a volume")
        return
    _, version, volume, package, level, cipher = HEAD.unpack(head)
    if version > NEWEST:
        yield bad("newer format")
        return
    if cipher:
        yield bad("encrypted")
        return
    pos, n, last = HEAD.size, 0, False
    while True:
        start = take(4)
        if start == magic + b"T" or last:
            rest = start + take(TAIL.size - 4)
            if len(rest) < TAIL.size or rest[:4] != magic + b"T":
                yield bad("trailer missing or damaged", pos)
                return
            _, blocks, _, length = TAIL.unpack(rest)
            if length != pos or blocks != n:
                yield bad("trailer does not fit the stream", pos)
            return
        raw_head = start + take(BLOCK.size - 4)
        if len(raw_head) < BLOCK.size or raw_head[:4] != magic + b"B":
            yield bad("block head damaged", pos)
            return
        _, kind, _, raw, stored, sha = BLOCK.unpack(raw_head)
        if not 0 <= raw <= MOST_RAW or not 0 <= stored <= MOST_STORED:
            yield bad("impossible sizes", pos)
            return
        data = take(stored)
        if len(data) < stored:
            yield bad("block cut off", pos)
            return
        yield (path, volume, package.hex(), level, n, pos, KINDS.get(kind, "unknown"), raw, stored, sha.hex(), bytes(data) if content else None, None)
        last = kind == INDEX_KIND
        n, pos = n + (kind != INDEX_KIND), pos + BLOCK.size + stored


def write_volume(put, blocks: list[tuple[str, bytes, bytes, int]], *, magic: bytes, volume: int, package: bytes, level: int = 2) -> int:
    """Write (codec, SHA-256, stored bytes, raw size) blocks, the last of which may be the index; gives the bytes written."""
    numbers = {name: k for k, name in KINDS.items()}
    pos, n, index = put(HEAD.pack(magic + b"V", NEWEST, volume, package, level, 0)) or HEAD.size, 0, 0
    for codec, sha, stored, raw in blocks:
        if codec == "index":
            index = pos
        put(BLOCK.pack(magic + b"B", numbers[codec], 0, raw, len(stored), sha))
        put(stored)
        n, pos = n + (codec != "index"), pos + BLOCK.size + len(stored)
    put(TAIL.pack(magic + b"T", n, index, pos))
    return pos + TAIL.size


class VolumeSource(DataSource):
    """``spark.read.format("quay_volumes").option("magic", ...).load(folder)``; ``content=false`` leaves out the bytes."""

    @classmethod
    def name(cls) -> str:
        return "quay_volumes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VolumeReader:  # noqa: ARG002
        return VolumeReader(dict(self.options))
