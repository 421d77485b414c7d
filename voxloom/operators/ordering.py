"""Named orders, paging and options."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import search

LINE_ORDERS = {
    "speaker_asc": lambda: [F.lower(F.coalesce("display_name", "name")), F.col("dialogue"), F.col("state"), F.col("strref")],
    "strref_asc": lambda: [F.col("strref")],
    "text_len_desc": lambda: [F.octet_length("text").desc(), F.col("dialogue"), F.col("state")],
    "dialogue_asc": lambda: [F.col("dialogue"), F.col("state"), F.col("strref")],
}


def text_key(c: Column) -> Column:
    """Compares without case and accents."""
    return F.collate(c, "UNICODE_CI_AI")


def ordered(rows: DataFrame, orders: Mapping[str, Sequence[Column]], name: str, unique: str) -> DataFrame:
    """By the order of that name, else by the first; ends in a unique column."""
    chosen = orders.get(name) or next(iter(orders.values()))
    return rows.orderBy(*chosen, F.col(unique))


def page(rows: DataFrame, order: Sequence[Column], offset: int, limit: int, most: int = 200) -> DataFrame:
    """Rows of a page; the limit is held between 1 and ``most``."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def _bins(column: str, edges: list) -> Column:
    """2 i for values between edge i - 1 and edge i, 2 i + 1 for edge i itself; a search tree of comparisons."""
    c = F.col(column)

    def search(a: int, b: int) -> Column:
        if a == b:
            return F.lit(2 * a)
        m = (a + b) // 2
        return F.when(c == F.lit(edges[m]), 2 * m + 1).when(c < F.lit(edges[m]), search(a, m)).otherwise(search(m + 1, b))

    return search(0, len(edges))


def deep_page(rows: DataFrame, keys: Sequence[tuple[str, bool]], offset: int, limit: int, most: int = 200, edges: int = 127, enough: int = 100_000) -> DataFrame:
    """The page that ``page`` gives, at any depth. ``keys``: (column, whether ascending), unique as a whole;
    nulls come first in ascending order and last in descending order, as Spark has it.

    A page is found by counting: the first key's range is cut at ``edges`` values of a sample, rows are counted in each
    bin, and only bins that the page overlaps are kept, with the offset less by what lies before. This goes on within
    these bins, and with the next key where a bin is one value, until ``enough`` rows are left, and only those are sorted.
    Each step is a scan with a count; no step sorts or shuffles the table. The limit is held as in ``page``.
    """
    offset, limit, keys = max(0, offset), min(max(1, limit), most), list(keys)
    order = [F.col(c).asc() if up else F.col(c).desc() for c, up in keys]
    left = None
    while keys and (left is None or left > enough):
        column, up = keys[0]
        sample = rows.where(F.col(column).isNotNull()).select(column).orderBy(F.xxhash64(column, *(c for c, _ in keys[1:]))).limit(4 * edges)
        found = [r[0] for r in sample.distinct().orderBy(column).collect()]
        found = found[:: max(1, -(-len(found) // edges))]
        bin_ = F.when(F.col(column).isNull(), -1).otherwise(_bins(column, found))
        counts = {r["b"]: r["count"] for r in rows.groupBy(bin_.alias("b")).count().collect()}
        total, kept, before = 0, [], 0  # nulls are the least value: first upwards, last downwards
        for b in sorted(counts, reverse=not up):
            if total + counts[b] > offset and total < offset + limit:
                before = total if not kept else before
                kept.append(b)
            total += counts[b]
        if not kept:
            return rows.limit(0)
        rows, offset = rows.where(bin_.isin(kept)), offset - before
        now = sum(counts[b] for b in kept)
        if len(kept) == 1 and (kept[0] == -1 or kept[0] % 2):
            keys.pop(0)  # one value: the next key decides
        elif now == left:
            break  # a sample that tells nothing apart
        left = now
    return rows.orderBy(*order).offset(offset).limit(limit)


def key_page(rows: DataFrame, key: str, after: int, limit: int, keep: Column | None = None) -> DataFrame:
    """The next rows by key after a cursor. The filter comes before the limit, so a short page is the last."""
    beyond = rows.where(F.col(key) > after)
    return (beyond if keep is None else beyond.where(keep)).orderBy(key).limit(limit)


def options(rows: DataFrame, value: str) -> DataFrame:
    """Distinct values that aren't empty, with counts, in order."""
    return rows.where(F.coalesce(F.trim(value), F.lit("")) != "").groupBy(value).agg(F.count("*").alias("n")).orderBy(value)


def labelled_options(rows: DataFrame, value: str, label: str, order: str) -> DataFrame:
    """One label for each value, the last in order, sorted by label."""
    return rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.max_by(label, order).alias(label)).orderBy(text_key(F.col(label)), value)


def library_order() -> list[Column]:
    """Harvested voices last, then by name and id."""
    return [(F.col("origin") == "harvested").asc(), text_key(F.col("name")), F.col("id")]


def _by_name(*first: Column) -> list[Column]:
    return [*first, text_key(F.col("name"))]


def needs_approval() -> Column:
    return (F.col("samples") > 0) & (F.col("approved") == 0)


# Orders of identities (name, lines, samples, approved, status, excluded) by their names
IDENTITY_ORDERS = {
    "name_asc": lambda: _by_name(),
    "lines_desc": lambda: _by_name(F.col("lines").desc()),
    "binding_gap": lambda: _by_name((~F.col("excluded") & (F.col("status") == "unbound")).desc()),
    "clone_failed": lambda: _by_name((F.col("status") == "failed").desc()),
}
HARVEST_ORDERS = {
    "name_asc": lambda: _by_name(),
    "name_desc": lambda: [text_key(F.col("name")).desc()],
    "lines_desc": lambda: _by_name(F.col("lines").desc()),
    "samples_desc": lambda: _by_name(F.col("samples").desc()),
    "needs_approval": lambda: _by_name(needs_approval().desc()),
}


def identity_facets() -> dict[tuple[str, str], Column]:
    """For ``facets_with``, the values of facets that are no value of a column; voice_match and demographic_match are
    match, mismatch or null."""
    c, kept = F.col, ~F.col("excluded")
    own = {("status", "needs_binding"): (c("approved") > 0) & kept & (c("status") == "unbound"), ("status", "has_approved"): c("approved") > 0}
    for facet in ("voice_match", "demographic_match"):
        own |= {(facet, "mismatch"): kept & (c(facet) == "mismatch"), (facet, "match"): c(facet) == "match"}
    return own


def harvest_facets() -> dict[tuple[str, str], Column]:
    """As identity_facets, for the facet ``review``."""
    found = {"needs_approval": needs_approval(), "has_approved": F.col("approved") > 0, "no_samples": F.col("samples") == 0, "multi_variant": F.col("variants") > 1}
    return {("review", k): v for k, v in found.items()}


def _place() -> list[Column]:
    return [F.coalesce("dialogue", F.lit("")), F.col("state").asc_nulls_last(), F.col("strref")]


BLOCKED_ORDERS = {
    "dlg_state": _place,
    "strref_asc": lambda: [F.col("strref")],
    "strref_desc": lambda: [F.col("strref").desc()],
    "text_asc": lambda: [F.lower("text"), *_place()],
    "text_desc": lambda: [F.lower("text").desc(), *_place()],
    "reason": lambda: [F.col("reason"), *_place()],
}


def blocked_page(lines: DataFrame, offset: int = 0, limit: int = 100, query: str = "", reason: str = "all", sort: str = "dlg_state") -> tuple[DataFrame, DataFrame]:
    """(a page of blocked lines, with a column reason; a row of total, the lines that pass the filters, and token_total,
    the lines with tokens among all). Query and reason come before the page; the limit is held between 1 and 200."""
    place = F.concat_ws(":", F.coalesce("dialogue", F.lit("")), F.coalesce(F.col("state").cast("string"), F.lit("")))
    wanted = F.lit(True) if reason in ("", "all") else F.col("reason") == reason
    passes = F.coalesce(wanted & search(query, F.col("strref"), place, F.col("text")), F.lit(False))
    totals = lines.agg(F.count_if(passes).alias("total"), F.count_if(F.col("reason") == "dynamic token").alias("token_total"))
    return page(lines.where(passes), [*BLOCKED_ORDERS.get(sort, _place)(), F.col("id")], offset, limit), totals
