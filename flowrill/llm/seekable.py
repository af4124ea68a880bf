"""Zstandard files made of independent frames with a seek table behind them.

The layout is the public seekable format: frames one after the other, then a skippable frame that
lists compressed size, decompressed size and checksum (lower half of XXH64) of each, so a reader
finds and decompresses any frame alone. Other zstd readers see one ordinary stream.
"""

from __future__ import annotations

import struct
import uuid

import pyarrow.fs as pafs
import xxhash
import zstandard

# Fixed values of the format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
_ENTRY = struct.Struct("<III")
_FOOTER = struct.Struct("<IBI")
_HEADER = struct.Struct("<II")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it."""
    return pafs.FileSystem.from_uri(uri)


def new_file(folder: str, part: int, suffix: str) -> str:
    """A name no other attempt of the same task uses; only names in the manifest count."""
    return f"{folder.rstrip('/')}/part-{part:05d}-{uuid.uuid4().hex}{suffix}"


class SeekableWriter:
    """Writes frames to a new file and the seek table on close."""

    def __init__(self, uri: str, level: int = 3) -> None:
        system, path = file_system(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self._out = system.open_output_stream(path, compression=None)  # frames are packed already
        self._zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._entries: list[tuple[int, int, int]] = []

    def write_frame(self, data: bytes) -> int:
        """Append one frame; its number."""
        frame = self._zstd.compress(data)
        self._out.write(frame)
        self._entries.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        return len(self._entries) - 1

    def close(self) -> None:
        table = b"".join(_ENTRY.pack(*e) for e in self._entries)
        table += _FOOTER.pack(len(self._entries), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self._out.write(_HEADER.pack(SKIPPABLE_MAGIC, len(table)) + table)
        self._out.close()


class SeekableReader:
    """Reads single frames of a file."""

    def __init__(self, uri: str) -> None:
        system, path = file_system(uri)
        self._in = system.open_input_file(path)
        size = self._in.size()
        n, flags, magic = _FOOTER.unpack(self._in.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError(f"{uri} has no seek table")
        start = size - _FOOTER.size - n * _ENTRY.size
        table = self._in.read_at(n * _ENTRY.size, start)
        self._frames, at = [], 0
        for entry in _ENTRY.iter_unpack(table):
            self._frames.append((at, *entry))
            at += entry[0]

    def __len__(self) -> int:
        return len(self._frames)

    def read_frame(self, number: int) -> bytes:
        at, packed, size, checksum = self._frames[number]
        data = zstandard.ZstdDecompressor().decompress(
            self._in.read_at(packed, at), max_output_size=size
        )
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {number} is damaged")
        return data

    def close(self) -> None:
        self._in.close()


class FrameCache:
    """The last frame of the last file read; for reads in file and frame order."""

    def __init__(self) -> None:
        self._file, self._reader, self._number, self._data = None, None, None, b""

    def get(self, file: str, number: int) -> bytes:
        if file != self._file:
            if self._reader:
                self._reader.close()
            self._file, self._reader, self._number = file, SeekableReader(file), None
        if number != self._number:
            self._number, self._data = number, self._reader.read_frame(number)
        return self._data
