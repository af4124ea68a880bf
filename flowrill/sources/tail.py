"""Streaming source that follows growing capture files.

The built-in file source never reads a file twice, so rows appended to a daily capture would be
missed. Here a file's progress is a byte position, kept in the streaming checkpoint; a batch is
the bytes between two positions, cut into ranges that executors read independently. Only whole
lines are taken: a half-written last line waits for its end.

The source hands out raw lines. Parsing, typing and scoring are ordinary expressions on the JVM.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Executors get the classes by value, whether or not this package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "source_file string, position bigint, header_ok boolean, line string"
FORGOTTEN = "/forgotten"  # no file name holds a slash
_BLOCK = 1 << 20
_SAMPLES, _SAMPLE_BYTES = 64, 1024


def _filesystem(path: str):
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _fingerprint(stream, size: int) -> int:
    """Checksum of the first ``size`` bytes of a file: of all if they are few, else of blocks spread
    evenly over them, the first and the last included."""
    import zlib

    if size <= _SAMPLES * _SAMPLE_BYTES:
        return zlib.crc32(stream.read_at(size, 0))
    places = [i * (size - _SAMPLE_BYTES) // (_SAMPLES - 1) for i in range(_SAMPLES)]
    return zlib.crc32(b"".join(stream.read_at(_SAMPLE_BYTES, place) for place in places))


class ByteRange(InputPartition):
    """Lines of ``path`` that start in ``[low, high)``; ``first`` is where the batch starts."""

    def __init__(self, path: str, low: int, high: int, first: int):
        self.path, self.low, self.high, self.first = path, low, high, first


class CaptureTailReader(DataSourceStreamReader):
    """Offsets are ``{file name: [whole-line bytes, fingerprint of these bytes]}``.

    A file that shrank, or whose bytes read so far have another fingerprint now, was created anew
    and is read from its start. With ``max_bytes_per_trigger`` a batch takes at most so many bytes
    (one line that is longer is taken alone), files in the order of their names. What was planned
    last is then kept in the folder ``plan_log``, from where a restarted job goes on; it belongs to
    the checkpoint. Files with a date in their name can be forgotten after ``max_age_days``, which bounds
    the offset; a forgotten file must not grow any more. Up to which day files are forgotten is
    part of the offset (under ``FORGOTTEN``), and a batch that would forget a file not read to its
    end fails. A job that starts with old files there ignores them.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.suffix = options.get("suffix", ".csv")
        self.range_bytes = int(options.get("rangebytes", 64 << 20))
        self.max_age_days = int(options["maxagedays"]) if "maxagedays" in options else None
        self.today = options.get("today")
        self.columns = json.loads(options["columns"]) if "columns" in options else None
        self.max_bytes = int(options["maxbytespertrigger"]) if "maxbytespertrigger" in options else None
        self.plan_log = options.get("planlog")
        if self.max_bytes is not None and not self.plan_log:
            raise ValueError("max_bytes_per_trigger needs a plan_log")
        self.planned: dict | None = None
        self.plans = 0
        self.seen: dict = {}

    def _last_plan(self) -> dict:
        """The offset planned last, by this process or one before; an unfinished entry is no plan."""
        from pyarrow import fs

        if self.planned is None:
            self.planned = {}
            filesystem, root = _filesystem(self.plan_log)
            names = sorted(i.base_name for i in filesystem.get_file_info(fs.FileSelector(root, allow_not_found=True)))
            for name in names:
                self.plans = max(self.plans, int(name) + 1)
                with filesystem.open_input_stream(f"{root}/{name}") as entry:
                    try:
                        self.planned = json.loads(entry.read())
                    except ValueError:
                        continue
        return self.planned

    def _log_plan(self, end: dict) -> None:
        """Remember an offset that the checkpoint holds; the entry before stays."""
        self._last_plan()
        if end == self.planned:
            return
        filesystem, root = _filesystem(self.plan_log)
        filesystem.create_dir(root, recursive=True)
        with filesystem.open_output_stream(f"{root}/{self.plans:012d}") as entry:
            entry.write(json.dumps(end).encode())
        old = f"{root}/{self.plans - 2:012d}"
        if self.plans >= 2 and filesystem.get_file_info(old).is_file:
            filesystem.delete_file(old)
        self.planned, self.plans = end, self.plans + 1

    def initialOffset(self) -> dict:
        return {}

    def _last_forgotten(self) -> int | None:
        """Number of the newest day whose files are forgotten."""
        import datetime as dt

        if self.max_age_days is None:
            return None
        today = dt.date.fromisoformat(self.today) if self.today else dt.date.today()
        return today.toordinal() - self.max_age_days - 1

    @staticmethod
    def _day(name: str) -> int | None:
        import datetime as dt

        try:
            return dt.date.fromisoformat(name[:10]).toordinal()
        except ValueError:
            return None

    def _recent(self, name: str) -> bool:
        last, day = self._last_forgotten(), self._day(name)
        return last is None or day is None or day > last

    def _check_forgotten(self, start: dict, end: dict) -> None:
        """Fail if a file forgotten between two offsets has rows that were never read."""
        from pyarrow import fs

        if FORGOTTEN not in start or FORGOTTEN not in end or start[FORGOTTEN] == end[FORGOTTEN]:
            return
        filesystem, root = _filesystem(self.path)
        for info in filesystem.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            name, day = info.base_name, self._day(info.base_name)
            if day is None or not name.endswith(self.suffix):
                continue
            if start[FORGOTTEN][0] < day <= end[FORGOTTEN][0]:
                now = self._whole_lines(filesystem, info.path, info.size)
                if now is not None and start.get(name) != now:
                    raise ValueError(f"{name} is older than max_age_days but was not read to its end")

    def latestOffset(self) -> dict:
        from pyarrow import fs

        filesystem, root = _filesystem(self.path)
        infos = filesystem.get_file_info(fs.FileSelector(root, allow_not_found=True))
        offset = {}
        if (last := self._last_forgotten()) is not None:
            offset[FORGOTTEN] = [last, 0]
        left, before = self.max_bytes, self._last_plan() if self.max_bytes is not None else {}
        for info in sorted(infos, key=lambda i: i.base_name):
            name = info.base_name
            if not info.is_file or not name.endswith(self.suffix) or not self._recent(name):
                continue
            if left is not None:
                now, left = self._admitted(filesystem, info, before.get(name), left)
                if now is not None:
                    offset[name] = now
                continue
            known = self.seen.get(name)
            stamp = [info.size, info.mtime_ns]
            if known is None or known[0] != stamp:
                known = (stamp, self._whole_lines(filesystem, info.path, info.size))
                self.seen[name] = known
            if known[1] is not None:
                offset[name] = known[1]
        return offset

    def _admitted(self, filesystem, info, planned: list | None, left: int) -> tuple[list | None, int]:
        """A file's new offset, and how many bytes later files may still give."""
        stamp = [info.size, info.mtime_ns]
        if left <= 0 or (planned is not None and self.seen.get(info.base_name) == [stamp, planned]):
            return planned, left  # the latter: read to its end, and unchanged since
        done = planned[0] if planned is not None and self._same(filesystem, info.path, planned) else 0
        now = self._whole_lines(filesystem, info.path, info.size, done, left)
        if now is None or now[0] == done:
            self.seen[info.base_name] = [stamp, planned]
            return planned, left
        if now[0] - done > left < self.max_bytes:
            return planned, 0  # its next line is for a batch of its own
        return now, left - (now[0] - done) if done + left >= info.size else 0

    def _same(self, filesystem, path: str, known: list) -> bool:
        """Whether a file still starts with the bytes of an offset."""
        with filesystem.open_input_file(path) as stream:
            return stream.size() >= known[0] and _fingerprint(stream, known[0]) == known[1]

    def _whole_lines(self, filesystem, path: str, size: int, done: int = 0, limit: int | None = None):
        """[bytes up to the last line end, their fingerprint], None before the first data line.

        With a ``limit`` at most so many bytes after ``done``, but one line at least.
        """
        with filesystem.open_input_file(path) as stream:
            least = self._line_end(stream, size, self._line_end(stream, size, 0)) if done == 0 else done
            if least is None:
                return None
            end = size if limit is None else min(size, done + limit)
            while end > least:
                low = max(least, end - 65536)
                at = stream.read_at(end - low, low).rfind(b"\n")
                if at >= 0:
                    return [low + at + 1, _fingerprint(stream, low + at + 1)]
                end = low
            if done and limit is not None and size > done + limit:
                least = self._line_end(stream, size, done) or done  # a line longer than the limit
            return [least, _fingerprint(stream, least)]

    @staticmethod
    def _line_end(stream, size: int, start: int | None) -> int | None:
        """Where the line that starts at ``start`` ends, None if it has no end yet."""
        while start is not None and start < size:
            block = stream.read_at(min(_BLOCK, size - start), start)
            at = block.find(b"\n")
            if at >= 0:
                return start + at + 1
            if not block:
                return None
            start += len(block)
        return None

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        ranges: list[InputPartition] = []
        self._check_forgotten(start, end)
        if self.max_bytes is not None:
            self._log_plan(end)
        filesystem, root = _filesystem(self.path)
        for name, (stop, mark) in sorted(end.items()):
            if name == FORGOTTEN or start.get(name) == [stop, mark]:
                continue
            known = start.get(name)
            grown = known is not None and known[0] <= stop and self._same(filesystem, f"{root.rstrip('/')}/{name}", known)
            first = known[0] if grown else 0
            path = f"{self.path.rstrip('/')}/{name}"
            for low in range(first, stop, self.range_bytes):
                ranges.append(ByteRange(path, low, min(low + self.range_bytes, stop), first))
        return ranges

    def read(self, partition: ByteRange) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        filesystem, path = _filesystem(partition.path)
        schema = pa.schema(
            [("source_file", pa.string()), ("position", pa.int64()), ("header_ok", pa.bool_()), ("line", pa.string())]
        )
        with filesystem.open_input_file(path) as stream:
            size = stream.size()
            head = b""
            while b"\n" not in head and len(head) < size:
                head += stream.read_at(_BLOCK, len(head))
            header_end = head.index(b"\n") + 1
            header = head[: header_end - 1].rstrip(b"\r").decode("utf-8", "replace")
            names = [name.replace('"', "").strip() for name in header.split(",")]
            header_ok = self.columns is None or names == self.columns

            at = partition.low
            if at > partition.first:
                # A range starts at its first line start; the byte before tells where that is.
                at -= 1
                skip = True
            else:
                skip = False
                if at == 0:
                    at = header_end
            rest = b""
            while True:
                start_of_rest = at - len(rest)
                if not skip and start_of_rest >= partition.high:
                    return
                block = stream.read_at(_BLOCK, at)
                if not block:
                    return
                at += len(block)
                data = rest + block
                base = at - len(data)
                if skip:
                    cut = data.find(b"\n")
                    if cut < 0:
                        rest = b""
                        continue
                    data, base, skip = data[cut + 1 :], base + cut + 1, False
                lines = data.split(b"\n")
                rest = lines.pop()
                if not lines:
                    continue
                lengths = np.fromiter((len(x) for x in lines), np.int64, len(lines)) + 1
                starts = base + np.concatenate(([0], np.cumsum(lengths)[:-1]))
                wanted = int(np.searchsorted(starts, partition.high))
                # A line end is the same byte in the decoded text, so the block is decoded at once.
                text = b"\n".join(lines[:wanted]).decode("utf-8", "replace")
                texts = pc.utf8_rtrim(pa.array(text.split("\n"), pa.string()), "\r")
                texts = texts[:wanted]
                places = pa.array(starts[:wanted])
                full = pc.and_(pc.greater(pc.utf8_length(texts), 0), pc.greater_equal(places, header_end))
                texts, places = texts.filter(full), places.filter(full)
                n = len(texts)
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([partition.path] * n, pa.string()), places,
                            pa.array([header_ok] * n, pa.bool_()), texts,
                        ],
                        schema=schema,
                    )
                if wanted < len(lines):
                    return


class CaptureTailSource(DataSource):
    """``spark.readStream.format("capture_tail").option("path", folder)``."""

    @classmethod
    def name(cls) -> str:
        return "capture_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CaptureTailReader({k.lower(): v for k, v in self.options.items()})


def tail_captures(spark: SparkSession, folder: str, columns: list[str] | None = None, **options):
    """Streaming DataFrame of the raw lines appended to the captures of a folder.

    ``header_ok`` tells whether a line's file has the header ``columns`` (true if none are given);
    it is found once per range, and the header itself does not travel with the lines. ``options``
    are those of the source, as ``max_bytes_per_trigger`` and ``plan_log``.
    """
    spark.dataSource.register(CaptureTailSource)
    reader = spark.readStream.format("capture_tail").option("path", folder)
    if columns is not None:
        reader = reader.option("columns", json.dumps(columns))
    for key, value in options.items():
        reader = reader.option(key.replace("_", ""), value)
    return reader.load()
