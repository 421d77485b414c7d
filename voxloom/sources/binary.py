"""Binary and text resources as DataFrames.

Files are read with Spark's ``binaryFile`` source, so that any store that Spark reads will do. Headers and fixed records
are decoded in numpy inside ``mapInArrow``; each function returns a row for each record. A file with a wrong signature,
or with a table that reaches beyond its end, gives one row in ``rejected`` and none elsewhere.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import locator
from ..functions.text import ascii_lower
from ..shipping import ship

NONE = 0xFFFFFFFF
#: Rows, and bytes of files, that are decoded before they go back to Spark as one batch: small files share one.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20
# Resource type codes by file extension.
TYPES = {"bmp": 0x001, "wav": 0x004, "dlg": 0x3F3, "2da": 0x3F4, "cre": 0x3F1, "ids": 0x3F0, "itm": 0x3ED, "spl": 0x3EE, "bcs": 0x3EF, "are": 0x3F2, "sto": 0x3F6}
AUDIO = ("wav", "ogg", "acm")


class Rejected(ValueError):
    """A file that can't be read as its format."""


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path, length, content of each file."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "length", "content")


def type_code(extension: Column) -> Column:
    """The code of an extension, else null."""
    known = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    return F.try_element_at(known, ascii_lower(extension))


def extension(code: Column) -> Column:
    """The extension of a code, else null."""
    known = F.create_map(*(F.lit(x) for k, v in TYPES.items() for x in (v, k)))
    return F.try_element_at(known, code)


def _decode(files: DataFrame, decode: Callable[[bytes], Iterable[tuple]], schema: str) -> DataFrame:
    """A row (path, *fields) for each record that ``decode`` finds in each file; files without a record give none."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(files.sparkSession)
    spark_schema = _parse_datatype_string(f"path string, {schema}")
    target = to_arrow_schema(spark_schema)

    def packed(paths, rows):
        for i in range(0, len(rows), BATCH_ROWS):
            columns = [paths[i : i + BATCH_ROWS], *zip(*rows[i : i + BATCH_ROWS], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    def run(batches):
        paths, rows, held = [], [], 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_py()
                try:
                    found = list(decode(raw))
                except (Rejected, struct.error):
                    continue
                paths += [path] * len(found)
                rows += found
                held += len(raw)
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield from packed(paths, rows)
                    paths, rows, held = [], [], 0
        yield from packed(paths, rows)

    return files.select("path", "content").mapInArrow(run, spark_schema)


def rejected(files: DataFrame, decode: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    """path and reason of each file that ``decode`` can't read."""

    def check(content: bytes) -> list[tuple]:
        try:
            for _ in decode(content):
                pass
        except (Rejected, struct.error) as e:
            return [(str(e),)]
        return []

    return _decode(files, check, "reason string")


def _signature(raw: bytes, want: str) -> None:
    if raw[:4].decode("latin-1").strip() != want:
        raise Rejected(f"bad signature {raw[:4]!r}")


def _table(raw: bytes, offset: int, count: int, dtype: np.dtype) -> np.ndarray:
    if offset + count * dtype.itemsize > len(raw):
        raise Rejected("table exceeds the file")
    return np.frombuffer(raw, dtype, count, offset)


def _records(raw: bytes, offset: int, count: int, kind: struct.Struct) -> Iterable[tuple]:
    """As _table, in plain numbers; for tables of a few records, where an array costs more than it saves."""
    if offset + count * kind.size > len(raw):
        raise Rejected("table exceeds the file")
    return kind.iter_unpack(raw[offset : offset + count * kind.size])


def _name(raw: bytes) -> str:
    """Up to the first NUL, trimmed, lower case."""
    return raw.split(b"\0")[0].decode("latin-1").strip().lower()


_KEY_ARCHIVE = np.dtype([("length", "<u4"), ("name_at", "<u4"), ("name_length", "<u2"), ("place", "<u2")])
_KEY_RESOURCE = np.dtype([("name", "S8"), ("type", "<u2"), ("locator", "<u4")])
_MEMBER = np.dtype([("locator", "<u4"), ("offset", "<u4"), ("size", "<u4"), ("type", "<u2"), ("unknown", "<u2")])
_STRING = np.dtype([("flags", "<u2"), ("sound", "S8"), ("volume", "<u4"), ("pitch", "<u4"), ("offset", "<u4"), ("length", "<u4")])
_STATE = struct.Struct("<4I")  # text, first, count, trigger
_TRANSITION = struct.Struct("<5I8sI")  # flags, text, journal, trigger, action, next, next_state


def decode_key(raw: bytes):
    _signature(raw, "KEY")
    n_archives, n_resources, archives_at, resources_at = struct.unpack_from("<4I", raw, 8)
    archives = _table(raw, archives_at, n_archives, _KEY_ARCHIVE)
    names = [raw[a["name_at"] : a["name_at"] + a["name_length"]].split(b"\0")[0].decode("latin-1") for a in archives]
    for r in _table(raw, resources_at, n_resources, _KEY_RESOURCE):
        at = int(r["locator"])
        yield _name(r["name"]), int(r["type"]), at, names[at >> 20] if at >> 20 < len(names) else None


def scan_key(files: DataFrame) -> DataFrame:
    """Path, resref, type, locator, archive name, and the locator's three parts."""
    found = _decode(files, decode_key, "resref string, type int, locator bigint, archive string")
    return found.select("*", locator(F.col("locator")).alias("at"))


def locate(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Index rows of (resref, type) pairs in any case."""
    asked = wanted.select(ascii_lower(F.col("resref")).alias("resref"), "type").distinct()
    return index.join(asked, ["resref", "type"])


def names_of_type(index: DataFrame, code: int) -> DataFrame:
    """In the order of names."""
    return index.where(F.col("type") == code).select("resref").orderBy("resref")


def decode_members(raw: bytes):
    _signature(raw, "BIFF")
    count, at = struct.unpack_from("<I4xI", raw, 8)
    for m in _table(raw, at, count, _MEMBER):
        yield int(m["locator"]) & 0x3FFF, int(m["offset"]), int(m["size"]), int(m["type"])


def scan_members(files: DataFrame) -> DataFrame:
    """Path, member, offset, size, type of an archive's entries; compressed archives are rejected."""
    return _decode(files, decode_members, "member int, offset bigint, size bigint, type int")


def read_members(files: DataFrame) -> DataFrame:
    """scan_members with the bytes of each member; null where they reach beyond the file."""
    inside = F.col("offset") + F.col("size") <= F.col("length")
    found = scan_members(files).join(files, "path")
    return found.select("path", "member", "offset", "size", "type", F.when(inside, F.substring("content", (F.col("offset") + 1).cast("int"), F.col("size").cast("int"))).alias("data"))


def overlay(archived: DataFrame, loose: DataFrame) -> DataFrame:
    """(resref, type, data, origin): a loose file takes the place of an archived one of the same name and type."""
    a = archived.select(ascii_lower(F.col("resref")).alias("resref"), "type", F.col("data").alias("a"))
    b = loose.select(ascii_lower(F.col("resref")).alias("resref"), "type", F.col("data").alias("b"))
    return a.join(b, ["resref", "type"], "full").select("resref", "type", F.coalesce("b", "a").alias("data"), F.when(F.col("b").isNotNull(), "override").otherwise("archive").alias("origin"))


def resolve_sounds(wanted: DataFrame, available: DataFrame, extensions: tuple[str, ...] = AUDIO) -> DataFrame:
    """For each wanted resref the file (resref, extension, path) whose extension comes first in the list, or null."""
    rank = F.array_position(F.array(*(F.lit(e) for e in extensions)), F.lower("extension"))
    best = available.select(ascii_lower(F.col("resref")).alias("resref"), "path", rank.alias("rank")).where("rank > 0").groupBy("resref").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    return wanted.select(ascii_lower(F.col("resref")).alias("resref")).distinct().join(best, "resref", "left")


def decode_strings(raw: bytes):
    _signature(raw, "TLK")
    count, texts_at = struct.unpack_from("<2I", raw, 10)
    for i, e in enumerate(_table(raw, 18, count, _STRING)):
        start = texts_at + int(e["offset"])
        if start + int(e["length"]) > len(raw):
            raise Rejected("string data exceeds the file")
        flags, sound = int(e["flags"]), _name(e["sound"])
        yield i, flags, raw[start : start + int(e["length"])].decode("utf-8", "replace"), sound if flags & 2 and sound else None


def scan_strings(files: DataFrame) -> DataFrame:
    """Path, strref, flags, text, sound_resref (only with the sound flag and a name)."""
    return _decode(files, decode_strings, "strref bigint, flags int, text string, sound_resref string")


def decode_dialogue(raw: bytes):
    _signature(raw, "DLG")
    n_states, states_at, n_transitions, transitions_at = struct.unpack_from("<4I", raw, 8)
    for i, (text, first, count, trigger) in enumerate(_records(raw, states_at, n_states, _STATE)):
        yield "state", i, None if text == NONE else text, first, count, None, None, None, trigger != NONE
    for i, (flags, text, _, _, _, following, state) in enumerate(_records(raw, transitions_at, n_transitions, _TRANSITION)):
        ends = bool(flags & 8)
        yield "transition", i, text if flags & 1 else None, None, None, flags, None if ends else _name(following) or None, None if ends else state, bool(flags & 2)


def scan_dialogues(files: DataFrame) -> DataFrame:
    """Nodes and edges of dialogue graphs: kind ``state`` or ``transition``, index, text_strref (null if none),
    first and count of a state's transitions, flags, next_dlg and next_state of a transition (null where it ends)."""
    return _decode(files, decode_dialogue, "kind string, index int, text_strref bigint, first int, count int, flags bigint, next_dlg string, next_state bigint, has_trigger boolean")


def decode_creature(raw: bytes):
    _signature(raw, "CRE")
    if raw[4:8] != b"V1.0" or len(raw) < 0x2D4:
        raise Rejected("not a whole V1.0 creature")
    strref = lambda at: next((v for v in struct.unpack_from("<I", raw, at) if v != NONE), None)
    slots = [v for v in struct.unpack_from("<100I", raw, 0xA4) if v and v != NONE]
    byte = lambda at: raw[at]
    yield strref(8), strref(0xC), byte(0x237), byte(0x275), byte(0x271), byte(0x272), byte(0x273), byte(0x274), byte(0x270), byte(0x27B), struct.unpack_from(">I", raw, 0x244)[0], _name(raw[0x2CC:0x2D4]) or None, slots


def scan_creatures(files: DataFrame) -> DataFrame:
    """One row for each creature record of version 1.0."""
    fields = "long_name_strref bigint, short_name_strref bigint, sex int, gender int, general int, race int, class int, specific int, ea int, alignment int, kit bigint, dialog_resref string, sound_slots array<bigint>"
    return _decode(files, decode_creature, fields)


def decode_table(raw: bytes):
    text = raw.removeprefix(b"\xef\xbb\xbf").replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    if text[:2] == b"\xff\xff":
        raise Rejected("encrypted table")
    lines = [x.split() for x in text.decode("latin-1").split("\n")]
    lines = [x for x in lines if x]
    if len(lines) < 3 or lines[0][0].upper() != "2DA":
        raise Rejected("not a table")
    default, columns = lines[1][0], lines[2]
    for k, line in enumerate(lines[3:]):
        label, cells = line[0], line[1:]
        if len(cells) < len(columns):
            cells += [default] * (len(columns) - len(cells))
        for column, cell in zip(columns, cells, strict=False):
            yield k, label, column, cell


def scan_tables(files: DataFrame) -> DataFrame:
    """Row, label, column, value of each cell of white-space tables; missing cells have the table's default."""
    return _decode(files, decode_table, "row int, label string, column string, value string")


def cell(cells: DataFrame, label: str, column: str) -> DataFrame:
    """The cells of a label and column in any case."""
    return cells.where((F.upper("label") == label.upper()) & (F.upper("column") == column.upper())).select("path", "value")


def scan_ids(lines: DataFrame) -> DataFrame:
    """Id and label from (line_no, value) lines ``<int> <label>``; comments go, the last of equal ids stays."""
    plain = F.trim(F.regexp_replace("value", "//.*$", ""))
    number, label = F.regexp_extract(plain, r"^(0[xX][0-9a-fA-F]+|-?\d+)\s+(\S.*)$", 1), F.regexp_extract(plain, r"^(0[xX][0-9a-fA-F]+|-?\d+)\s+(\S.*)$", 2)
    value = F.when(F.lower(number).startswith("0x"), F.conv(F.substring(number, F.lit(3), F.length(number)), 16, 10).try_cast("bigint")).otherwise(number.try_cast("bigint"))
    return lines.select("line_no", value.alias("id"), label.alias("label")).where("id IS NOT NULL").groupBy("id").agg(F.max_by("label", "line_no").alias("label"))


def label_ids(rows: DataFrame, ids: DataFrame, column: str, out: str) -> DataFrame:
    """``out`` is the label of an id, ``#id`` where none is known."""
    known = ids.select(F.col("id").alias("_id"), F.col("label").alias(out))
    return rows.join(known, F.col(column) == F.col("_id"), "left").withColumn(out, F.coalesce(out, F.concat(F.lit("#"), F.col(column).cast("string")))).drop("_id")


def decode_wave(raw: bytes):
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise Rejected("not a wave file")
    at, kind, data = 12, None, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt ":
            kind = struct.unpack_from("<HHIIHH", raw, at + 8)
        elif name == b"data":
            data = raw[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if kind is None or data is None or (kind[0], kind[1], kind[5]) != (1, 1, 16):
        raise Rejected("not mono 16-bit PCM")
    yield kind[2], (np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.float32) / 32768).tolist()


def scan_waves(files: DataFrame) -> DataFrame:
    """Path, rate, samples between -1 and 1 of mono 16-bit wave files."""
    return _decode(files, decode_wave, "rate int, samples array<float>")


def valid_vorbis(content: Column, rate: int = 22_050) -> Column:
    """An Ogg file whose first packet says Vorbis, mono, at this rate. The packet follows the page's lacing values."""
    lacing = F.conv(F.hex(F.substring(content, 27, 1)), 16, 10).cast("int")
    at = lambda k: F.lit(28 + k) + lacing
    packet = F.substring(content, at(0), F.lit(7))
    rate_hex = F.hex(F.substring(content, at(12), F.lit(4)))
    found = F.conv(F.concat(*(F.substring(rate_hex, 2 * k + 1, 2) for k in (3, 2, 1, 0))), 16, 10).cast("bigint")
    ok = (F.hex(F.substring(content, 1, 4)) == "4F676753") & (F.hex(packet) == "01766F72626973") & (F.hex(F.substring(content, at(11), F.lit(1))) == "01") & (found == rate)
    return F.coalesce(ok, F.lit(False))
