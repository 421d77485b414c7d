"""String tables and archives as Spark data sources that read ranges of files.

``register(spark)`` adds two formats. Planning reads the headers of files alone; a partition is a range of a file's
entries, and a task reads its slice of the entry table and the bytes that these entries name. So a file is never held
whole, may exceed what one row can hold, and one large file is read by many tasks. Comparisons of the entry number with
constants are pushed down and narrow the ranges.

Both formats write as well: a task fills a file for each value of ``file`` among its rows, under a name that only the
commit makes final, so that failed and repeated tasks leave nothing behind. Paths are those that pyarrow opens: local
paths and the schemes of its file systems.

Options: ``entries`` (a partition has at most so many, 65,536), ``data`` (``false``: archives without their members'
bytes). A file whose header or table does not fit gives one row with ``reason``, and all else null but its path.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..shipping import ship
from .binary import _MEMBER, _STRING, _name

ENTRIES = 65_536
#: Bytes of one batch that a reader hands on, and of the gaps that one read may span beyond what it needs.
BATCH_BYTES = 8 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The file, or the files of the folder, but for hidden ones."""
    store, place = _open(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(place))
    return sorted(f"{path.rstrip('/')}/{x.base_name}" for x in found if x.type == fs.FileType.File and x.base_name[0] not in "._")


@dataclass
class Entries(InputPartition):
    path: str
    start: int
    stop: int
    table_at: int
    data_at: int
    length: int
    reason: str | None = None


class _RangeReader(DataSourceReader):
    """What both formats share: partitions by entry number, narrowed by pushed comparisons of column ``number``."""

    number = ""
    entry: np.dtype

    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("entries", ENTRIES))
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters):
        for f in filters:
            at = getattr(f, "attribute", None) == (self.number,) and isinstance(getattr(f, "value", None), int)
            if at and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
            elif at and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif at and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            yield f  # Spark applies all of them again, so that rows of rejected files go by the same rule

    def header(self, raw: bytes) -> tuple[int, int, int]:
        """Entries, where their table begins and where data begins; raises ValueError or struct.error."""
        raise NotImplementedError

    def partitions(self):
        out = []
        for path in _files(self.path):
            store, place = _open(path)
            with store.open_input_file(place) as f:
                length, raw = f.size(), f.read(32)
            try:
                count, table_at, data_at = self.header(raw)
                if table_at + count * self.entry.itemsize > length:
                    raise ValueError("table exceeds the file")
            except (ValueError, struct.error) as e:
                out.append(Entries(path, 0, 0, 0, 0, length, str(e)))
                continue
            low, high = max(0, self.low), min(count, self.high)
            out += [Entries(path, k, min(k + self.most, high), table_at, data_at, length) for k in range(low, high, self.most)]
        return out or [Entries("", 0, 0, 0, 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        if partition.reason is not None:
            yield self.batch(partition, [], partition.reason)
            return
        store, place = _open(partition.path)
        with store.open_input_file(place) as f:
            f.seek(partition.table_at + partition.start * self.entry.itemsize)
            table = np.frombuffer(f.read((partition.stop - partition.start) * self.entry.itemsize), self.entry)
            yield from self.rows(f, table, partition)

    def rows(self, f, table: np.ndarray, partition: Entries) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def batch(self, partition: Entries, rows: list[tuple], reason: str | None = None) -> pa.RecordBatch:
        raise NotImplementedError


def _slices(f, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, pieces): the pieces of entries from..to, a bounded number of bytes at a time; neighbouring pieces in one read."""
    at = 0
    while at < len(starts):
        to, low, high = at + 1, int(starts[at]), int(starts[at] + lengths[at])
        while to < len(starts):
            a, b = min(low, int(starts[to])), max(high, int(starts[to] + lengths[to]))
            if b - a > BATCH_BYTES:
                break
            low, high, to = a, b, to + 1
        f.seek(low)
        raw = f.read(high - low)
        yield at, to, [raw[int(s) - low : int(s) - low + int(n)] for s, n in zip(starts[at:to], lengths[at:to], strict=True)]
        at = to


STRINGS = "path string, strref bigint, flags int, text string, sound_resref string, reason string"
_STRINGS_ARROW = pa.schema([("path", pa.string()), ("strref", pa.int64()), ("flags", pa.int32()), ("text", pa.string()), ("sound_resref", pa.string()), ("reason", pa.string())])


class StringsReader(_RangeReader):
    number, entry = "strref", _STRING

    def header(self, raw):
        if raw[:4].decode("latin-1").strip() != "TLK":
            raise ValueError(f"bad signature {raw[:4]!r}")
        count, data_at = struct.unpack_from("<2I", raw, 10)
        return count, 18, data_at

    def rows(self, f, table, partition):
        starts, lengths = table["offset"].astype(np.int64) + partition.data_at, table["length"].astype(np.int64)
        starts = np.where(lengths == 0, partition.data_at, starts)
        outside = starts + lengths > partition.length
        starts, lengths = np.where(outside, partition.data_at, starts), np.where(outside, 0, lengths)
        for a, b, pieces in _slices(f, starts, lengths):
            rows = []
            for k in range(a, b):
                flags, sound = int(table["flags"][k]), _name(bytes(table["sound"][k]))
                text = None if outside[k] else pieces[k - a].decode("utf-8", "replace")
                rows.append((partition.start + k, flags, text, sound if flags & 2 and sound else None, "string data exceeds the file" if outside[k] else None))
            yield self.batch(partition, rows)

    def batch(self, partition, rows, reason=None):
        if reason is not None:
            rows = [(None, None, None, None, reason)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(columns, _STRINGS_ARROW.types[1:], strict=True))], schema=_STRINGS_ARROW)


MEMBERS = "path string, entry bigint, member int, offset bigint, size bigint, type int, data binary, reason string"
_MEMBERS_ARROW = pa.schema([("path", pa.string()), ("entry", pa.int64()), ("member", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("type", pa.int32()), ("data", pa.binary()), ("reason", pa.string())])


class MembersReader(_RangeReader):
    number, entry = "entry", _MEMBER

    def __init__(self, options):
        super().__init__(options)
        self.data = options.get("data", "true").lower() != "false"

    def header(self, raw):
        if raw[:4] != b"BIFF":
            raise ValueError(f"bad signature {raw[:4]!r}")
        count, at = struct.unpack_from("<I4xI", raw, 8)
        return count, at, 0

    def rows(self, f, table, partition):
        starts, lengths = table["offset"].astype(np.int64), table["size"].astype(np.int64)
        outside = starts + lengths > partition.length
        told = lambda a, b, pieces: self.batch(
            partition,
            [(partition.start + k, int(table["locator"][k]) & 0x3FFF, int(starts[k]), int(lengths[k]), int(table["type"][k]), pieces[k - a] if pieces and not outside[k] else None, "data exceeds the file" if outside[k] else None) for k in range(a, b)],
        )
        if not self.data:
            yield told(0, len(table), None)
            return
        for a, b, pieces in _slices(f, np.where(outside, 0, starts), np.where(outside, 0, lengths)):
            yield told(a, b, pieces)

    def batch(self, partition, rows, reason=None):
        if reason is not None:
            rows = [(None,) * 6 + (reason,)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(columns, _MEMBERS_ARROW.types[1:], strict=True))], schema=_MEMBERS_ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _FileWriter(DataSourceWriter):
    """A file for each run of equal ``file`` among a task's rows; give rows grouped by file and ordered within."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite

    def content(self, rows: list) -> bytes:
        raise NotImplementedError

    def write(self, iterator):
        done, name, rows = [], None, []

        def close():
            if name is not None:
                store, place = _open(f"{self.path}/_{uuid.uuid4().hex}-{name}")
                store.create_dir(_open(self.path)[1], recursive=True)
                with store.open_output_stream(place) as f:
                    f.write(self.content(rows))
                done.append((place, _open(f"{self.path}/{name}")[1]))

        for row in iterator:
            if row.file != name:
                close()
                name, rows = row.file, []
            rows.append(row)
        close()
        return Written(done)

    def commit(self, messages):
        store, place = _open(self.path)
        store.create_dir(place, recursive=True)
        fresh = [x for m in messages if m for x in m.files]
        if len({to for _, to in fresh}) < len(fresh):
            raise ValueError("rows of one file came from several tasks: deal rows out by file")
        if self.overwrite:
            for old in _files(self.path):
                store.delete_file(_open(old)[1])
        for there, to in fresh:
            store.move(there, to)

    def abort(self, messages):
        for there, _ in (x for m in messages if m for x in m.files):
            _open(self.path)[0].delete_file(there)


class StringsWriter(_FileWriter):
    """Rows (file, strref, flags, text, sound_resref), strref from 0 without gaps; a null text has no bytes."""

    def content(self, rows):
        table, data = np.zeros(len(rows), _STRING), bytearray()
        for k, r in enumerate(rows):
            if r.strref != k:
                raise ValueError(f"{r.file}: string {r.strref} in place {k}")
            raw = (r.text or "").encode()
            table[k] = (r.flags, (r.sound_resref or "").encode("latin-1", "replace"), 0, 0, len(data), len(raw))
            data += raw
        return struct.pack("<8sHII", b"TLK V1  ", 0, len(rows), 18 + table.nbytes) + table.tobytes() + bytes(data)


class MembersWriter(_FileWriter):
    """Rows (file, member, type, data); a null counts as no bytes."""

    def content(self, rows):
        table, data = np.zeros(len(rows), _MEMBER), bytearray()
        begin = 20 + table.nbytes
        for k, r in enumerate(rows):
            raw = bytes(r.data or b"")
            table[k] = (r.member, begin + len(data), len(raw), r.type, 0)
            data += raw
        return struct.pack("<8sIII", b"BIFFV1  ", len(rows), 0, 20) + table.tobytes() + bytes(data)


class Strings(DataSource):
    """Format ``voxloom_strings``."""

    @classmethod
    def name(cls):
        return "voxloom_strings"

    def schema(self):
        return STRINGS

    def reader(self, schema):
        return StringsReader(self.options)

    def writer(self, schema, overwrite):
        return StringsWriter(self.options, overwrite)


class Members(DataSource):
    """Format ``voxloom_members``."""

    @classmethod
    def name(cls):
        return "voxloom_members"

    def schema(self):
        return MEMBERS

    def reader(self, schema):
        return MembersReader(self.options)

    def writer(self, schema, overwrite):
        return MembersWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Add both formats to the session, and let Spark push filters to Python sources."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Strings)
    spark.dataSource.register(Members)
