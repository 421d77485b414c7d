"""Bytes of binary records as Column expressions, for files that are made from tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def little(value: Column, width: int) -> Column:
    """An unsigned number below 2**62 as ``width`` bytes, the least first."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width)))))


def signed16(value: Column) -> Column:
    """A number from -32768 to 32767 in two bytes, the least first."""
    return little(F.pmod(value.cast("bigint"), F.lit(65536)), 2)


def padded(text: Column, width: int) -> Column:
    """Latin letters, filled up with zero bytes."""
    return F.unhex(F.rpad(F.hex(text), 2 * width, "0"))


def record(length: int, fields: Sequence[tuple[int, int, Column]]) -> Column:
    """``length`` bytes with (offset, width, bytes) fields, given in order of offset, and zero bytes between."""
    parts, at = [], 0
    for offset, width, value in fields:
        if offset > at:
            parts.append(F.unhex(F.lit("00" * (offset - at))))
        parts.append(value)
        at = offset + width
    return F.concat(*parts, F.unhex(F.lit("00" * (length - at))))


def joined(pieces: Column) -> Column:
    """An array of binaries as one."""
    return F.unhex(F.array_join(F.transform(pieces, F.hex), ""))
