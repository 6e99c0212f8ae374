"""Token-id files of shuffled planes.

A file holds one run of documents. Their ids, 32 bits each, are cut into
blocks of a fixed number of ids. A block is transposed into byte planes (or
bit planes), so that all lowest bytes stand together, then the next ones, and
each plane is compressed with zstandard by itself. The index at the end gives
every block's place, its number of ids and its planes' sizes, so any run of
ids can be read without the rest::

    magic | planes of block 0 | planes of block 1 | ... | doc ids | lengths |
    index | place of doc ids, lengths, index; documents, ids, block ids, mode | magic

Readers hold one block in memory, writers at most one block and one document.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"PLANES01"
BLOCK_IDS = 1 << 16
_TAIL = struct.Struct("<7Q8s")
#: The doc id written for null.
NO_ID = -(1 << 63)


def open_store(path: str):
    """(file system, path) of a plain path or of any URI pyarrow knows."""
    from pyarrow import fs
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Byte or bit planes of the ids, the lowest first."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    unpacked = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(unpacked[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if not bits:
        raw = np.empty((n, 4), np.uint8)
        for k in range(4):
            raw[:, k] = np.frombuffer(planes[k], np.uint8)
    else:
        unpacked = np.empty((n, 32), np.uint8)
        for k in range(32):
            unpacked[:, k] = np.unpackbits(np.frombuffer(planes[k], np.uint8), count=n, bitorder="little")
        raw = np.packbits(unpacked, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


class Writer:
    """Writes one file under a name of its own, then moves it into place, so a
    lost or repeated task leaves either the whole file or none."""

    def __init__(self, path: str, attempt: str, bits: bool = False,
                 block_ids: int = BLOCK_IDS, level: int = 3):
        import zstandard
        self.fs, self.path = open_store(path)
        self.temp = f"{self.path}.{attempt}"
        self.out = self.fs.open_output_stream(self.temp)
        self.squeeze = zstandard.ZstdCompressor(level=level).compress
        self.bits, self.block_ids = bits, block_ids
        self.wait: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.index: list[int] = []
        self.doc_ids: list[int] = []
        self.lengths: list[int] = []
        self.out.write(MAGIC)
        self.at = len(MAGIC)

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def add(self, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> None:
        """Documents, their numbers of ids, and all their ids in a row."""
        self.doc_ids += [NO_ID if d is None else d for d in doc_ids]
        self.lengths += lengths
        self.total += len(ids)
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block_ids:
            have = np.concatenate(self.wait)
            whole = len(have) - len(have) % self.block_ids
            for lo in range(0, whole, self.block_ids):
                self._block(have[lo:lo + self.block_ids])
            self.wait, self.waiting = [have[whole:].copy()], len(have) - whole

    def _block(self, ids: np.ndarray) -> None:
        place = self.at
        self.index += [place, len(ids), *[self._put(self.squeeze(p)) for p in to_planes(ids, self.bits)]]

    def close(self) -> None:
        rest = np.concatenate(self.wait) if self.wait else np.zeros(0, np.uint32)
        if len(rest):
            self._block(rest)
        places = []
        for data in (np.array(self.doc_ids, "<i8"), np.array(self.lengths, "<u8"), np.array(self.index, "<u8")):
            places.append(self.at)
            self._put(self.squeeze(data.tobytes()))
        self._put(_TAIL.pack(*places, len(self.doc_ids), self.total, self.block_ids, int(self.bits), MAGIC))
        self.out.close()
        self.fs.move(self.temp, self.path)


class Reader:
    def __init__(self, path: str):
        import zstandard
        self.fs, path = open_store(path)
        self.file = self.fs.open_input_file(path)
        self.expand = zstandard.ZstdDecompressor().decompress
        end = self.file.size()
        tail = self._get(end - _TAIL.size, _TAIL.size)
        docs, lens, index, self.n_docs, self.n_ids, self.block_ids, bits, magic = _TAIL.unpack(tail)
        if magic != MAGIC or self._get(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is not a file of planes")
        self.bits = bool(bits)
        stop = end - _TAIL.size
        load = lambda lo, hi, kind: np.frombuffer(self.expand(self._get(lo, hi - lo)), kind)
        self.doc_ids = load(docs, lens, "<i8")
        self.lengths = load(lens, index, "<u8").astype(np.int64)
        self.index = load(index, stop, "<u8").astype(np.int64).reshape(-1, 2 + (32 if self.bits else 4))

    def _get(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> np.ndarray:
        place, n, *sizes = self.index[k].tolist()
        planes, raw, at = [], self._get(place, sum(sizes)), 0
        for s in sizes:
            planes.append(self.expand(raw[at:at + s]))
            at += s
        return from_planes(planes, n, self.bits)

    def ids(self, start: int, count: int) -> Iterator[np.ndarray]:
        """The ids [start, start + count), in runs that lie in one block each."""
        while count > 0:
            k, skip = divmod(start, self.block_ids)
            run = self.block(k)[skip:skip + count]
            yield run
            start += len(run)
            count -= len(run)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(doc id, number of ids, crc32 of the ids) in the order of the file."""
        k, have = -1, np.zeros(0, "<u4")
        at = 0
        for doc, n in zip(self.doc_ids.tolist(), self.lengths.tolist()):
            crc, left = 0, n
            while left:
                if at == len(have):
                    k, at = k + 1, 0
                    have = self.block(k)
                part = have[at:at + left]
                crc = zlib.crc32(part.tobytes(), crc)
                at += len(part)
                left -= len(part)
            yield (None if doc == NO_ID else doc), n, crc

    def close(self) -> None:
        self.file.close()
