"""A file of token ids: independent Zstandard frames, an index frame and a seek table.

    frame 0 .. frame n-1   each: the ids of some consecutive documents, little-endian, unsigned, 2 or 4 bytes
    index frame            header, then a row for each document: id, null flag, frame, tokens before it in the frame, tokens
    seek table             a skippable frame as in the published seekable format of Zstandard:
                           per frame compressed size, size and checksum (low 32 bits of XXH64), then the footer

Every frame also carries Zstandard's own content checksum. The table stands last, so a reader takes the
last 9 bytes, the table, the index frame, and then only the frames of the documents that it wants.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import xxhash
import zstandard

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
FOOTER = struct.Struct("<IBI")
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])

HEADER = struct.Struct("<4sBxxxIIQ")  # kind, bytes an id, partition, file of the partition, documents
KIND = b"LST1"
ROW = np.dtype([("doc", "<i8"), ("null", "u1"), ("frame", "<u4"), ("start", "<u4"), ("n", "<u4")])


class Corrupt(ValueError):
    """The bytes are not a whole token file."""


class Writer:
    """Collects documents and packs them; a frame is closed once it holds frame_ids ids."""

    def __init__(self, part: int, number: int, width: int, frame_ids: int = 65536, level: int = 1):
        if width not in (2, 4):
            raise ValueError("an id takes 2 or 4 bytes")
        self.part, self.number, self.width, self.frame_ids = part, number, width, frame_ids
        self._pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        self._frames: list[bytes] = []
        self._entries: list[tuple[int, int, int]] = []
        self._open: list[np.ndarray] = []
        self._open_ids = 0
        self._rows: list[tuple] = []
        self.ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._rows.append((doc_id or 0, doc_id is None, len(self._frames), self._open_ids, len(ids)))
        self._open.append(ids)
        self._open_ids += len(ids)
        self.ids += len(ids)
        if self._open_ids >= self.frame_ids:
            self._close_frame()

    def _put(self, raw: bytes) -> None:
        packed = self._pack(raw)
        self._frames.append(packed)
        self._entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def _close_frame(self) -> None:
        self._put(np.concatenate(self._open).astype(f"<u{self.width}").tobytes())
        self._open, self._open_ids = [], 0

    def bytes(self) -> bytes:
        if self._open:
            self._close_frame()
        self._put(HEADER.pack(KIND, self.width, self.part, self.number, len(self._rows)) + np.array(self._rows, ROW).tobytes())
        table = np.array(self._entries, ENTRY).tobytes()
        skippable = struct.pack("<II", SKIPPABLE_MAGIC, len(table) + FOOTER.size)
        return b"".join([*self._frames, skippable, table, FOOTER.pack(len(self._entries), HAS_CHECKSUMS, FOOTER_MAGIC)])


class Reader:
    """Reads a token file through read(offset, length), so a whole file need not be in memory."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        if size < FOOTER.size:
            raise Corrupt("shorter than a footer")
        frames, flags, magic = FOOTER.unpack(read(size - FOOTER.size, FOOTER.size))
        length = frames * ENTRY.itemsize + FOOTER.size
        if magic != FOOTER_MAGIC or flags != HAS_CHECKSUMS or frames < 1 or length + 8 > size:
            raise Corrupt("no seek table at the end")
        head = read(size - length - 8, 8)
        if struct.unpack("<II", head) != (SKIPPABLE_MAGIC, length):
            raise Corrupt("the seek table has no skippable frame")
        self.entries = np.frombuffer(read(size - length, frames * ENTRY.itemsize), ENTRY)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries["packed"].astype(np.int64))])
        if int(self.offsets[-1]) + 8 + length != size:
            raise Corrupt("the frames don't fill the file")
        self._read, self._unpack = read, zstandard.ZstdDecompressor()
        self.unpacked = 0
        index = self.frame(frames - 1)
        kind, self.width, self.part, self.number, n = HEADER.unpack_from(index)
        if kind != KIND or len(index) != HEADER.size + n * ROW.itemsize:
            raise Corrupt("the index frame is not whole")
        self.rows = np.frombuffer(index, ROW, offset=HEADER.size)

    @classmethod
    def of(cls, content: bytes) -> Reader:
        return cls(lambda at, n: content[at : at + n], len(content))

    def frame(self, k: int) -> bytes:
        size, check = int(self.entries["size"][k]), int(self.entries["check"][k])
        try:
            raw = self._unpack.decompress(self._read(int(self.offsets[k]), int(self.entries["packed"][k])), max_output_size=size)
        except zstandard.ZstdError as bad:
            raise Corrupt(f"frame {k}: {bad}") from bad
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise Corrupt(f"frame {k} doesn't agree with its checksum")
        self.unpacked += 1
        return raw

    def documents(self, wanted: Iterable[int | None] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(id, ids) of all documents in order, or of the wanted ones; only their frames are unpacked."""
        want, at, ids = None if wanted is None else set(wanted), -1, np.empty(0)
        for doc, null, frame, start, n in self.rows.tolist():
            doc = None if null else doc
            if want is not None and doc not in want:
                continue
            if frame != at:
                at, ids = frame, np.frombuffer(self.frame(frame), f"<u{self.width}")
            yield doc, ids[start : start + n]
