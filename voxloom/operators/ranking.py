"""Best rows by key, representatives and bounded top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; ``order`` must end in a unique column."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")


def best(rows: DataFrame, keys: Sequence[str], by: Column) -> DataFrame:
    """One row of each key, the one with the largest value of ``by`` (a number or struct of ascending parts).

    max_by aggregates before the shuffle, so a key with very many rows costs no more than others; use ``top`` where a
    text must sort descending.
    """
    row = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.max_by(row, by).alias("_row")).select("_row.*")


def representative(rows: DataFrame, dialogue: str, name: str, named: str, voiced: str) -> DataFrame:
    """The owner of each dialogue: its name equals it > has a long name > has a voice > the least name; and how many own it."""
    same = F.lower(name) == F.lower(dialogue)
    order = [same.desc(), F.col(named).desc(), F.col(voiced).desc(), F.lower(name).asc(), F.col(name).asc()]
    counted = rows.withColumn("owners", F.count("*").over(Window.partitionBy(F.lower(dialogue))))
    keyed = counted.withColumn("_key", F.lower(dialogue))
    return top(keyed, ["_key"], order).drop("_key")


def source_rank(source: Column, ready: Column) -> Column:
    """Override > default > generic > follow, ready first among equals."""
    return F.coalesce(*(F.when(source == s, r) for s, r in (("override", 8), ("default", 6), ("generic", 4), ("follow", 2))), F.lit(0)) + ready.cast("int")


def decision_rank(decision: Column) -> Column:
    """Approved > pending > rejected."""
    return F.coalesce(*(F.when(decision == s, r) for s, r in (("approved", 3), ("pending", 2), ("rejected", 1))), F.lit(0))


def best_sample(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Automatic > local stem > overall > low id, of approved samples."""
    order = F.struct("automatic", "local_stem", "overall", (-F.col("id")).alias("low"))
    return best(samples.where("decision = 'approved'"), keys, order)


def approve_best(samples: DataFrame, least_seconds: float = 0.6) -> DataFrame:
    """``samples`` with the best usable automatic sample of each identity approved.

    Of automatic samples long enough and with speech, the largest overall and then the lowest id wins; samples without
    speech are rejected; other decisions stay.
    """
    usable = F.col("automatic") & (F.col("duration_secs") >= least_seconds) & (F.col("speech") > 0)
    order = Window.partitionBy("identity", "_usable").orderBy(F.col("overall").desc(), F.col("id"))
    ranked = samples.withColumn("_usable", F.coalesce(usable, F.lit(False))).withColumn("_rank", F.row_number().over(order))
    decision = F.when(F.col("_usable") & (F.col("_rank") == 1), "approved").when(F.col("automatic") & (F.col("speech") <= 0), "rejected").otherwise(F.col("decision"))
    return ranked.withColumn("decision", decision).drop("_usable", "_rank")


def approve_manual_gaps(samples: DataFrame) -> DataFrame:
    """Where an identity has neither an approved nor an automatic sample, the best manual one by (priority, overall, id)."""
    who = Window.partitionBy("identity")
    gap = ~F.bool_or((F.col("decision") == "approved") | F.col("automatic")).over(who)
    order = Window.partitionBy("identity").orderBy(F.col("priority").desc(), F.col("overall").desc(), F.col("id"))
    ranked = samples.withColumn("_gap", gap).withColumn("_rank", F.row_number().over(order))
    return ranked.withColumn("decision", F.when(F.col("_gap") & (F.col("_rank") == 1), "approved").otherwise(F.col("decision"))).drop("_gap", "_rank")


def latest(rows: DataFrame, keys: Sequence[str], value: str, ident: str = "id") -> DataFrame:
    """The value of the row with the highest id."""
    return rows.groupBy(*keys).agg(F.max_by(value, ident).alias(value), F.max(ident).alias(ident))


def donors(target: dict, pool: DataFrame, least_category_match: bool = False) -> list[Column]:
    """An order of donors for one target: another category and another race last, best quality first, then the id."""
    return [(F.col("category") != target["category"]).asc(), (F.col("race") != target["race"]).asc(), F.col("quality").desc(), F.col("id").asc()]


def distinct_sounds(candidates: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, existing: DataFrame | None = None) -> DataFrame:
    """The first candidate of each sound, then the first n of each key; sounds that exist already don't count."""
    if existing is not None:
        candidates = candidates.join(existing.select(*keys, F.lower("sound").alias("sound")), [*keys, "sound"], "left_anti")
    return top(top(candidates, [*keys, "sound"], order), keys, order, n)


def first_source(tables: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of several tables in order of precedence the first row of each key."""
    staged = [t.withColumn("_source", F.lit(k)) for k, t in enumerate(tables)]
    union = staged[0]
    for t in staged[1:]:
        union = union.unionByName(t)
    return top(union, keys, [F.col("_source"), *order]).drop("_source")


def majority(scores: DataFrame, key: str, option: str, value: str) -> DataFrame:
    """The option with the largest value of each key; keys whose largest is shared by two options are left out."""
    most = scores.groupBy(key, option).agg(F.max(value).alias("_v"))
    # the first and the last option by (value, option) and by (value, reversed order) differ only if several share the value
    found = most.groupBy(key).agg(F.max(F.struct("_v", option)).alias("_a"), F.min(F.struct((-F.col("_v")).alias("_v"), option)).alias("_b"))
    return found.where(F.col(f"_a.{option}") == F.col(f"_b.{option}")).select(key, F.col(f"_a.{option}").alias(option))


def uniform(value: Column) -> Column:
    """The value that all rows have, else null; an aggregate."""
    return F.when(F.min(value) == F.max(value), F.min(value))
