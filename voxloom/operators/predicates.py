"""Filters: facets, search, length bounds, eligibility and reasons.

Each returns a Column, so that several fold into one filter that Spark pushes down, or a DataFrame where another table
decides. Optional parts are left out when their parameter is empty.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import is_generated_name
from ..functions.text import TOKEN_BITS, ascii_lower, search_form, speakable_dialogue, trim


def all_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def selected(column: Column, values: Sequence) -> Column:
    """one of the values; no values pass all, null passes only then."""
    return F.coalesce(column.isin(list(values)), F.lit(False)) if values else F.lit(True)


def facets(wanted: Mapping[str, Sequence]) -> Column:
    """each facet's column is one of its values."""
    return all_of([selected(F.col(k), v) for k, v in wanted.items() if v])


def facets_with(wanted: Mapping[str, Sequence], own: Mapping[tuple[str, str], Column]) -> Column:
    """as facets, where a (facet, value) may have a predicate of its own; within a facet any match passes."""
    return all_of([any_of([own.get((k, v), F.col(k).eqNullSafe(F.lit(v))) for v in values]) for k, values in wanted.items() if values])


def search(query: str, *fields: Column) -> Column:
    """the query, in any case, is part of one of the fields; an empty one passes all."""
    q = query.strip()[:200].lower()
    return any_of([F.coalesce(F.lower(f.cast("string")).contains(q), F.lit(False)) for f in fields]) if q else F.lit(True)


def bound(text: str | None) -> int | None:
    """a bound from a text field: a whole number from 0 on, else none."""
    t = (text or "").strip()
    return int(t) if t.isdecimal() and t.isascii() else None


def byte_length(column: Column, least: str | None = None, most: str | None = None) -> Column:
    """UTF-8 bytes within inclusive bounds; F23 counts UTF-16 units, see utf16_length."""
    n = F.octet_length(column)
    return all_of([n >= b for b in [bound(least)] if b is not None] + [n <= b for b in [bound(most)] if b is not None])


def utf16_length(column: Column) -> Column:
    """length in UTF-16 units, as browsers count."""
    return F.octet_length(F.encode(column, "UTF-16BE")) / 2


def passes_speakable(status: Column, text: Column) -> Column:
    """blocked and skipped lines pass; others need something to speak."""
    return status.isin("blocked", "skipped") | speakable_dialogue(text)


def render_facets(generated: Column, voice_changed: Column, text_changed: Column) -> Column:
    """missing, or generated with what has changed since."""
    return F.array_compact(F.array(F.when(~generated, "missing"), F.when(generated, "generated"), F.when(generated & voice_changed, "voice_changed"), F.when(generated & text_changed, "text_changed")))


def has_facet(column: Column, wanted: Sequence[str]) -> Column:
    """one of the wanted is among an array's values."""
    return F.arrays_overlap(column, F.array(*(F.lit(w) for w in wanted))) if wanted else F.lit(True)


def pack_audio(is_voiced: Column, generated: Column) -> Column:
    """F09."""
    return F.when(generated, "pack").when(is_voiced, "game").otherwise("none")


def blocked_reason(kind: Column, voiced: Column, has_tokens: Column, shared: Column, attributed: Column) -> Column:
    """The first reason in this order why a line is blocked."""
    named = F.when(voiced, "already voiced").when(has_tokens | (kind == "token"), "dynamic token").when(kind.isin("transition", "script"), "not a state line")
    return named.when(shared, "shared (different voice)").when(~attributed, "unattributed").otherwise("other")


def line_status(excluded: Column, voiced: Column, has_tokens: Column, deferred: Column, attributed: Column, spoken: Column, player: Column) -> Column:
    """F12."""
    return F.when(excluded | player | ~spoken, "skipped").when(attributed & ~voiced & ~has_tokens & ~deferred, "ready").otherwise("blocked")


def generatable(voiced: Column, sound: Column) -> Column:
    """without audio, or with audio that a pack of ours added."""
    return ~voiced | is_generated_name(sound)


def is_player(name: Column) -> Column:
    """F16: stands for the player, in any case."""
    return F.coalesce(ascii_lower(trim(name)) == "<charname>", F.lit(False))


def usable_dialogue(name: Column) -> Column:
    """Neither blank, NONE nor asterisks only."""
    return F.coalesce(~trim(name).rlike(r"(?i)^(none|\**)$"), F.lit(False))


def defer_reason(columns: Mapping[str, Column]) -> Column:
    """the first of the given (reason, holds) pairs that holds, in their order; null if the row is eligible."""
    return reduce(lambda acc, kv: acc.when(kv[1], F.lit(kv[0])), columns.items(), F)


def export_reasons(strings: int) -> dict[str, Column]:
    """for ``defer_reason``, why a finished line (kind, has_tokens, text, voiced, sound, speaker, excluded, resolution,
    on_disk, strref) stays out of a pack for a target of so many strings."""
    c = F.col
    # The reasons' wording.
    return {
        "not an NPC dialogue state (transition/script/token kind)": c("kind") != "state",
        "line has dynamic tokens (<PRO_*>/<CHARNAME>/...)": c("has_tokens"),
        "line is intentionally silent (no speakable dialogue text)": ~F.coalesce(speakable_dialogue(c("text")), F.lit(False)),
        "line is already voiced in the target": ~generatable(c("voiced"), c("sound")),
        "line has no uniquely attributed speaker": c("speaker").isNull(),
        "speaker excluded from pack": c("excluded"),
        "shared strref with a different/unknown voice (deferred)": c("resolution") == "defer_diff_voice",
        "generated clip is missing on disk": ~c("on_disk"),
        "strref is not present in the target dialog.tlk": ~c("strref").between(0, strings - 1),
    }


def provenance_origin(provenance: Column) -> Column:
    """where a sample comes from, read from its JSON."""
    return F.get_json_object(provenance, "$.origin")


def cross_identity_reason(owners: Column, own_stem: Column, foreign_stems: Column, sound_stem: Column) -> Column:
    """1 if a sound has several owners, 2 if its stem is another creature's; null otherwise."""
    foreign = (F.length(sound_stem) >= 4) & (sound_stem != own_stem) & F.array_contains(foreign_stems, sound_stem)
    return F.when(owners > 1, 1).when(foreign, 2)


def exists_in(rows: DataFrame, other: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """``flag`` says whether ``other`` has the row's keys; for predicates that OR several such tests."""
    keys = other.select(*on).dropna().distinct().withColumn(flag, F.lit(True))
    return rows.join(keys, list(on), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def eligible(lines: DataFrame, tests: Mapping[str, tuple[DataFrame, Sequence[str]]], excluded: DataFrame, on: Sequence[str]) -> DataFrame:
    """lines that are ready or pass one of the membership tests, and whose keys aren't in ``excluded``."""
    for flag, (other, keys) in tests.items():
        lines = exists_in(lines, other, keys, flag)
    kept = lines.where(any_of([F.col("status") == "ready", *(F.col(f) for f in tests)])).drop(*tests)
    return kept.join(excluded.select(*on).distinct(), list(on), "left_anti")


def having_at_most(keys: DataFrame, events: DataFrame, on: str, most: int) -> DataFrame:
    """keys with at most so many events, none included."""
    counts = events.groupBy(on).agg(F.count("*").alias("_n"))
    return keys.join(counts, on, "left").where(F.coalesce("_n", F.lit(0)) <= most).drop("_n")


def without(rows: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose keys the other table lacks."""
    return rows.join(other.select(*on), list(on), "left_anti")


def expand_identities(keys: DataFrame, members: DataFrame) -> DataFrame:
    """member ids of identity keys (column key) in any of their forms: ``id:sex``, ``id`` and ``ungrouped:speaker``."""
    named = F.when(F.col("name_id").isNotNull(), F.concat_ws(":", "name_id", "sex"))
    forms = F.array(named, F.col("name_id").cast("string"), F.concat_ws(":", F.lit("ungrouped"), "id"))
    spread = members.select("id", F.explode(F.array_distinct(F.filter(forms, lambda x: x.isNotNull()))).alias("key"))
    return spread.join(keys.select("key").distinct(), "key", "left_semi").select("id").distinct()


def token_total(rows: DataFrame) -> Column:
    """Lines with tokens, as an aggregate."""
    return F.count_if(F.col("token_mask").bitwiseAND(F.lit(sum(TOKEN_BITS.values()))) != 0)


def in_project(project: int | None) -> Column:
    """an optional parameter."""
    return F.col("project_id") == project if project is not None else F.lit(True)


__all__ = [n for n in dir() if not n.startswith("_")] + ["search_form"]
