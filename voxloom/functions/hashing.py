"""Hashes, encodings, JSON fields and render settings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import trim


def text_hash(c: Column) -> Column:
    """SHA-256 of the text without Unicode white space at its ends."""
    return F.sha2(trim(c), 256)


def state_hash(*parts: Column) -> Column:
    """SHA-256 of values joined by ``|``; nulls are empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def pool_salt(ids: Column) -> Column:
    """A hash of an array of ids that depends on their order."""
    return F.xxhash64(ids)


def stable_index(n: Column, *keys: Column) -> Column:
    """An index below n that depends on the keys alone; null for an empty pool."""
    return F.when(n > 0, F.pmod(F.xxhash64(*keys), n.cast("bigint")).cast("int"))


def base36(c: Column, width: int) -> Column:
    """Upper-case base 36, the last ``width`` digits; negative numbers count as 0, null stays null."""
    number = F.when(c.isNotNull(), F.greatest(c.cast("bigint"), F.lit(0)))
    return F.right(F.lpad(F.conv(number.cast("string"), 10, 36), 13, "0"), F.lit(width))


def is_generated_name(c: Column) -> Column:
    """Eight characters, Z first, ASCII letters and digits."""
    return F.coalesce(F.upper(c).rlike("^Z[0-9A-Z]{7}$"), F.lit(False))


def unique_names(lines: DataFrame, taken: DataFrame, key: str = "strref", order: Sequence[str] = ("strref",)) -> DataFrame:
    """``name`` for each row: Z, five base-36 digits of the key, and the first free suffixes 00 to ZZ.

    ``taken`` (name) are names that exist, in any case. Rows of one base take free suffixes in the given order; a row for
    which none is left gets null. Only taken names of the same base matter, so suffixes are found by joining on the base:
    the k-th row takes the k-th suffix that is free.
    """
    base = F.concat(F.lit("Z"), base36(F.col(key), 5))
    used = taken.select(F.upper("name").alias("name")).where("length(name) = 8").select(F.left("name", F.lit(6)).alias("base"), F.conv(F.right("name", F.lit(2)), 36, 10).cast("int").alias("n")).groupBy("base").agg(F.collect_set("n").alias("used"))
    ranked = lines.withColumn("base", base).withColumn("rank", F.row_number().over(Window.partitionBy("base").orderBy(*order)))
    free = F.array_except(F.sequence(F.lit(0), F.lit(36 * 36 - 1)), F.coalesce("used", F.array().cast("array<int>")))
    first = F.when(F.col("used").isNull(), F.when(F.col("rank") <= 36 * 36, F.col("rank") - 1)).otherwise(F.get(free, F.col("rank") - 1))
    named = ranked.join(used, "base", "left").withColumn("suffix", first)
    return named.withColumn("name", F.concat("base", base36(F.col("suffix"), 2))).drop("base", "rank", "used", "suffix")


def json_field(c: Column, path: str, default: object = None) -> Column:
    """A field as text; invalid JSON and missing fields give the default."""
    return F.coalesce(F.get_json_object(c, path), F.lit(default))


def is_automatic(provenance: Column) -> Column:
    """eligibility ``automatic``, or none stated."""
    return json_field(provenance, "$.eligibility", "automatic") == "automatic"


def flag_count(diagnostics: Column) -> Column:
    """Number of flags; 0 where there are none or the JSON is invalid."""
    return F.coalesce(F.json_array_length(F.get_json_object(diagnostics, "$.flags")), F.lit(0))


def provenance(**fields: Column) -> Column:
    """A JSON object of the fields that aren't null."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def locator(c: Column) -> Column:
    """(archive, tileset, member): 12, 6 and 14 bits from the top."""
    n = c.cast("bigint")
    return F.struct(
        F.shiftright(n, 20).bitwiseAND(F.lit(0xFFF)).cast("int").alias("archive"),
        F.shiftright(n, 14).bitwiseAND(F.lit(0x3F)).cast("int").alias("tileset"),
        n.bitwiseAND(F.lit(0x3FFF)).cast("int").alias("member"),
    )


def unsigned(c: Column, offset: int, size: int, big_endian: bool = False) -> Column:
    """An unsigned integer of ``size`` bytes of a binary column."""
    part = F.substring(c, offset + 1, size)
    digits = F.hex(part)
    if not big_endian:
        digits = F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))))
    return F.conv(digits, 16, 10).cast("bigint")


def _in_order(c: Column, kind: T.DataType) -> Column:
    """The value with the fields of its structs, and the keys of its maps, in order at every depth."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*(_in_order(c.getField(f.name), f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _in_order(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(e["key"].alias("key"), _in_order(e["value"], kind.valueType).alias("value"))
        pairs = F.transform(F.map_entries(c), entry)
        return F.map_from_entries(F.array_sort(pairs, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return c


def canonical_json(c: Column, kind: T.DataType) -> Column:
    """A struct, array or map of type ``kind`` as JSON without spaces, names in order at every depth, nulls written.

    Numbers are written as Spark writes them; a null value is ``null``.
    """
    return F.coalesce(F.to_json(_in_order(c, kind), {"ignoreNullFields": "false"}), F.lit("null"))


def canonical_text(c: Column) -> Column:
    """JSON text in the same form, by way of a variant; numbers by value, so that 2.0 is 2. Null if it is no JSON."""
    return F.to_json(F.try_parse_json(c))


def settings_hash(settings: Column, kind: T.DataType | None = None) -> Column:
    """SHA-256 of a struct as JSON with its fields in the order of their names at every depth, nulls written.

    With its type the JSON is that of canonical_json, else that of canonical_text.
    """
    told = canonical_json(settings, kind) if kind is not None else canonical_text(F.to_json(settings, {"ignoreNullFields": "false"}))
    return F.sha2(told, 256)


# ---- SipHash over 64-bit words

#: The four constants of the published algorithm.
_SIP = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)


def siphash(words: Sequence[np.ndarray], keys: tuple[int, int] = (0, 0), rounds: tuple[int, int] = (1, 3)) -> np.ndarray:
    """SipHash of messages of 64-bit words, one array for each word: rounds for each word and at the end, SipHash-1-3 by
    default. All messages are hashed together."""
    v = [np.full(len(words[0]) if words else 1, c ^ keys[i % 2], np.uint64) for i, c in enumerate(_SIP)]
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    def mix(times: int) -> None:
        for _ in range(times):
            v[0] = v[0] + v[1]
            v[2] = v[2] + v[3]
            v[1] = turn(v[1], 13) ^ v[0]
            v[3] = turn(v[3], 16) ^ v[2]
            v[0] = turn(v[0], 32)
            v[2] = v[2] + v[1]
            v[0] = v[0] + v[3]
            v[1] = turn(v[1], 17) ^ v[2]
            v[3] = turn(v[3], 21) ^ v[0]
            v[2] = turn(v[2], 32)

    for word in [*words, np.full(len(v[0]), (8 * len(words) & 0xFF) << 56, np.uint64)]:
        v[3] = v[3] ^ word
        mix(rounds[0])
        v[0] = v[0] ^ word
    v[2] = v[2] ^ np.uint64(0xFF)
    mix(rounds[1])
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def _words(values: pd.Series) -> np.ndarray:
    return values.to_numpy(np.int64).view(np.uint64)


@F.pandas_udf(T.LongType())
def sip_salt(ids: pd.Series) -> pd.Series:
    """SipHash-1-3 of an array of ids, 0 for null; as a signed number of the same 64 bits."""
    out = np.zeros(len(ids), np.int64)
    lists = [np.asarray([] if x is None else x, np.int64) for x in ids]
    lengths = np.array([len(x) for x in lists], np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        held = np.stack([lists[i] for i in at]).view(np.uint64)
        out[at] = np.broadcast_to(siphash([np.ascontiguousarray(held[:, k]) for k in range(n)]), len(at)).view(np.int64) if n else siphash([]).view(np.int64)[0]
    return pd.Series(out)


@F.pandas_udf(T.IntegerType())
def sip_index(speaker: pd.Series, project: pd.Series, salt: pd.Series, size: pd.Series) -> pd.Series:
    """SipHash-1-3 of speaker, project and salt, modulo the size of a pool; null for an empty one. Give no nulls: pandas
    would turn a batch that holds one into floating point, which loses the last bits of all."""
    some = size.fillna(0).to_numpy(np.int64) > 0
    out = pd.Series([None] * len(size), dtype="Int32")
    if some.any():
        held = siphash([_words(x[some].fillna(0)) for x in (speaker, project, salt)])
        out[some] = (held % size[some].to_numpy(np.int64).astype(np.uint64)).astype(np.int32)
    return out


def merge_settings(names: Sequence[str], *layers: str) -> list[Column]:
    """For each setting the value of the first layer (a struct column) that states one."""
    return [F.coalesce(*(F.col(f"{layer}.{n}") for layer in layers)).alias(n) for n in sorted(names)]
