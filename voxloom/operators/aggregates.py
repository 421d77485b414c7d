"""Roll-ups, conditional counts and folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cuts import durable
from ..functions.text import collapse
from ..shipping import ship


def unique_texts(lines: DataFrame, ident: str, key: str, text: str = "text") -> DataFrame:
    """For each text trimmed of spaces the least id and key and how many lines have it."""
    return lines.where(F.trim(text) != "").groupBy(F.trim(text).alias("text")).agg(F.min(ident).alias("first_id"), F.min(key).alias("first_key"), F.count("*").alias("shared_count"))


def page_after(groups: DataFrame, cursor: int, limit: int) -> DataFrame:
    """The first groups whose id is beyond the cursor."""
    return groups.where(F.col("first_id") > cursor).orderBy("first_id").limit(limit)


def counts(rows: DataFrame, conditions: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """How many rows meet each condition, in one pass."""
    return rows.groupBy(*keys).agg(*(F.count_if(c).alias(k) for k, c in conditions.items()))


def bit_counts(rows: DataFrame, mask: str, bits: Mapping[str, int]) -> DataFrame:
    """How many masks have each bit."""
    return counts(rows, {k: F.col(mask).bitwiseAND(F.lit(b)) != 0 for k, b in bits.items()})


def demographics(tables: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Counts of several tables by the same keys; the first names the groups, missing counts are 0."""
    (first, base), *rest = tables.items()
    out = base.groupBy(*keys).agg(F.count("*").alias(first))
    for name, other in rest:
        out = out.join(other.groupBy(*keys).agg(F.count("*").alias(name)), list(keys), "left")
    return out.na.fill(0, [name for name, _ in rest])


def shared_groups(lines: DataFrame, key: str = "strref", speaker: str = "speaker_id") -> DataFrame:
    """A10: keys that several lines share: reuse if all have one speaker, else defer; one unknown speaker defers."""
    found = lines.groupBy(key).agg(F.count("*").alias("lines"), F.count_distinct(speaker).alias("speakers"), F.count_if(F.col(speaker).isNull()).alias("unknown")).where("lines > 1")
    return found.select(key, "lines", F.when((F.col("speakers") == 1) & (F.col("unknown") == 0), "reuse_same_voice").otherwise("defer_diff_voice").alias("resolution"))


def conflicting(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Keys with more than one text, white space aside."""
    return rows.groupBy(key).agg(F.count_distinct(collapse(F.col(text))).alias("texts")).where("texts > 1")


def fold_in_order(rows: DataFrame, keys: Sequence[str], order: str, source: str, status: str) -> DataFrame:
    """(source, status) of each group, from its members in order: the first ready one, else the first with a source."""
    ready = F.min(F.when(F.col(status) == "ready", F.struct(order, source, status)))
    some = F.min(F.when(F.col(source).isNotNull(), F.struct(order, source, status)))
    return rows.groupBy(*keys).agg(F.coalesce(ready, some).alias("_b")).select(*keys, F.col(f"_b.{source}").alias(source), F.col(f"_b.{status}").alias(status))


def relabel_collisions(groups: DataFrame, name: str, key: str) -> DataFrame:
    """``label``: the name, with its key where another group has the same one in any case."""
    n = F.count("*").over(Window.partitionBy(F.lower(name)))
    return groups.withColumn("label", F.when(n > 1, F.concat(F.col(name), F.lit(" ("), F.col(key).cast("string"), F.lit(")"))).otherwise(F.col(name)))


def group_rollup(members: DataFrame, key: str) -> DataFrame:
    """Totals of a group's members: lines, approved, samples, variants, whether all are excluded, and its resource names."""
    return members.groupBy(key).agg(
        F.sum("lines").alias("lines"), F.sum("approved").alias("approved"), F.sum("samples").alias("samples"), F.count("*").alias("variants"),
        F.bool_and("excluded").alias("excluded"), F.sort_array(F.collect_set("name")).alias("names"),
    )


def unanimous_decisions(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pending samples take the decision that the others of their keys agree on; conflicts stay."""
    who = Window.partitionBy(*keys)
    decided = F.when(F.col("decision") != "pending", F.col("decision"))
    agreed = F.when(F.min(decided).over(who) == F.max(decided).over(who), F.min(decided).over(who))
    return samples.withColumn("decision", F.when(F.col("decision") == "pending", F.coalesce(agreed, F.lit("pending"))).otherwise(F.col("decision")))


def dedup_jobs(jobs: DataFrame, ident: str, text: str, settings: str) -> DataFrame:
    """Of jobs with equal text (white space aside) and settings the first renders, for all of them."""
    return jobs.groupBy(collapse(F.col(text)).alias("text"), settings).agg(F.min(ident).alias("leader"), F.count("*").alias("jobs"))


def rule_hits(texts: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """For each rule how many texts it matches; the rules are a short list, so one pass counts all of them."""
    found = texts.agg(*(F.count_if(c).alias(k) for k, c in rules.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").alias("texts")) for k in rules))
    return found.select(F.explode(pairs).alias("p")).select("p.*")


def preferences(trials: DataFrame, key: str, winner: str) -> DataFrame:
    """Wins, losses, ties and the rate of wins among decided trials, null without any."""
    out = counts(trials, {"wins": F.col(winner) == "variant", "losses": F.col(winner) == "baseline", "ties": F.col(winner) == "tie"}, [key])
    return out.withColumn("rate", F.round(F.try_divide("wins", F.col("wins") + F.col("losses")), 6))


def append_numbers(existing: DataFrame, new: DataFrame, key: str, order: Sequence[str], number: str = "sort_order") -> DataFrame:
    """Numbers for new rows that go on from the largest of their key, from 0 where there is none."""
    largest = existing.groupBy(key).agg(F.max(number).alias("_max"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return new.withColumn("_rank", rank).join(largest, key, "left").withColumn(number, F.coalesce(F.col("_max") + F.col("_rank"), F.col("_rank") - 1)).drop("_max", "_rank")


def referenced_groups(groups: DataFrame, lines: DataFrame) -> DataFrame:
    """How many groups (id, resolution) the lines (shared_group_id) refer to, and how many of them are deferred."""
    used = groups.join(lines.select(F.col("shared_group_id").alias("id")), "id", "left_semi")
    return used.agg(F.count("*").alias("shared_groups"), F.count_if(F.col("resolution") == "defer_diff_voice").alias("deferred_groups"))


def shared_by_members(rows: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """Whether a value of a group belongs to more than one of its members."""
    return rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count_distinct(member).alias("_n")).groupBy(group).agg(F.bool_or(F.col("_n") > 1).alias("shares"))


def _exits(chars: np.ndarray, size: int, budget: int) -> list[tuple[int, int, int]]:
    """(held, total, batches) at the end of a run of jobs if a batch begins at its first, second, ... job, for as many of
    these as an open batch can reach: how full the last batch is, and how many began after the first."""
    n = len(chars)
    sums = np.concatenate(([0], np.cumsum(chars)))
    # where the next batch begins: a batch has one job, and more while both bounds hold
    fits = np.searchsorted(sums, sums[:-1] + budget, "right") - 1
    then = np.maximum(np.arange(1, n + 1), np.minimum(np.arange(n) + size, fits))
    last, batches = np.arange(n), np.zeros(n, np.int64)
    for i in range(n - 1, -1, -1):
        if then[i] < n:
            last[i], batches[i] = last[then[i]], batches[then[i]] + 1
    return [(n - int(last[k]), int(sums[n] - sums[last[k]]), int(batches[k])) for k in range(min(size, n))]


def _entries(runs: list, size: int, budget: int) -> dict[int, tuple]:
    """For each partition that goes on with the group of the one before: (group, number, held, total) of the open batch.

    ``runs``: what a partition's first and last group are like, in order; two rows a partition at most.
    """
    entries, now, part = {}, None, None
    for run in runs:
        goes_on = now is not None and run.first and run.part != part and now[0] == run.group
        part = run.part
        if not goes_on:
            held, total, batches = run.exits[0]
            now = (run.group, batches, held, total)
            continue
        entries[run.part] = now
        _, number, held, total = now
        for k, c in enumerate(run.heads):
            if held >= size or total + c > budget:
                held, total, batches = run.exits[k]
                number += 1 + batches
                break
            held, total = held + 1, total + c
        now = (run.group, number, held, total)
    return entries


def pack_batches(jobs: DataFrame, group: str, order: Sequence[str], size: int = 8, budget: int = 800, chars: str = "chars", parts: int | None = None) -> DataFrame:
    """``jobs`` with ``batch``, numbered from 0 within each group.

    In the given order a batch takes jobs until it has ``size`` of them or the next would exceed ``budget`` characters; a
    longer job is a batch of its own. Jobs are dealt by range of (group, order) over ``parts`` partitions, so that a
    group of any size is spread over tasks. How a partition ends depends on the jobs before it only by the open batch that
    it goes on with, which ends within ``size`` jobs; so each partition tells how it would end for each place where the
    first new batch can begin. These maps, two for each partition, are composed, which gives each partition the batch
    that is open at its start, and a second pass numbers its jobs. Jobs that are equal in group and order stay together
    and may be numbered in either order; a null number of characters counts as 0.
    """
    spark = jobs.sparkSession
    ship(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = jobs.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).withColumn("_part", F.spark_partition_id())
    dealt = durable(dealt)  # ranges are drawn by sample, so both passes must see the same ones
    kind, columns = jobs.schema[group].dataType.simpleString(), jobs.columns

    def summarise(batches):
        part, runs = None, []  # of each run of one group: its name and its lengths; those between first and last are dropped
        for batch in batches:
            names = batch.column(0).to_pylist()
            lengths = np.asarray(batch.column(1).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            begins = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
            for k, end in zip(begins, [*begins[1:], len(names)], strict=True):
                part = batch.column(2)[0].as_py()
                if runs and runs[-1][0] == names[k]:
                    runs[-1][1].append(lengths[k:end])
                else:
                    runs = [*runs[:1], (names[k], [lengths[k:end]])]
        rows = []
        for k, (name, pieces) in enumerate(runs):
            whole = np.concatenate(pieces)
            rows.append({"part": part, "first": k == 0, "group": name, "heads": whole[:size].tolist(), "exits": [list(x) for x in _exits(whole, size, budget)]})
        fields = [("part", pa.int32()), ("first", pa.bool_()), ("group", batch.schema.field(0).type), ("heads", pa.list_(pa.int64())), ("exits", pa.list_(pa.list_(pa.int64())))] if runs else None
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    told = dealt.select(F.col(group), F.col(chars).cast("bigint"), "_part").mapInArrow(summarise, f"part int, first boolean, group {kind}, heads array<bigint>, exits array<array<bigint>>")
    entries = _entries(sorted(told.collect(), key=lambda r: (r.part, not r.first)), size, budget)

    def number(batches):
        now, count, held, total = object(), 0, 0, 0
        fresh = True
        for batch in batches:
            out = []
            if fresh and batch.num_rows:
                fresh = False
                now, count, held, total = entries.get(batch.column("_part")[0].as_py(), (now, 0, 0, 0))
            for g, n in zip(batch.column(group).to_pylist(), batch.column(chars).to_pylist(), strict=True):
                n = n or 0
                if g != now:
                    now, count, held, total = g, 0, 0, 0
                elif held >= size or (held and total + n > budget):
                    count, held, total = count + 1, 0, 0
                held, total = held + 1, total + n
                out.append(count)
            kept = batch.select(columns)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.int32())], [*kept.schema.names, "batch"])

    return dealt.mapInArrow(number, T.StructType([*jobs.schema.fields, T.StructField("batch", T.IntegerType())]))


def _packed_lengths(groups: pd.DataFrame, group: str, size: int, budget: int) -> pd.DataFrame:
    """For each length of one group, in order, with the number of its jobs: how many still join the batch that is open
    (``joining``) and its number (``open``), the number of the first batch after it (``fresh``) and how many jobs each of
    these holds (``each``)."""
    out, number, held, total = [], 0, 0, 0
    for n, count in groups.sort_values("chars")[["chars", "count"]].itertuples(index=False):
        fit = count if n == 0 else max(0, budget - total) // n
        joining = int(min(count, size - held, fit)) if held else 0
        each, rest = (size if n == 0 else max(1, min(size, budget // n))), count - joining
        fresh = number + 1 if held or number else number
        out.append((n, joining, number, fresh, each))
        if rest:
            number, last = fresh + (rest - 1) // each, (rest - 1) % each + 1
            held, total = last, last * n
        else:
            held, total = held + joining, total + joining * n
    found = pd.DataFrame(out, columns=["chars", "joining", "open", "fresh", "each"])
    found.insert(0, group, groups[group].iloc[0])
    return found


def pack_by_length(jobs: DataFrame, group: str, ident: str, size: int = 8, budget: int = 800, edges: int = 256) -> DataFrame:
    """``jobs`` with ``batch``, as pack_batches numbers them in the order of (chars, ``ident``), ids being numbers.

    Jobs of one length are alike, so only the histogram of lengths is walked, which has a row for each length of a group;
    a job finds its batch by arithmetic from its rank within its length. Ranks are counted in ``edges`` + 1 ranges of ids
    and joined with the counts of the ranges before, so no task holds all jobs of a group or a length.
    """
    cuts = jobs.approxQuantile(ident, [(k + 1) / (edges + 1) for k in range(edges)], 0.001)
    kind = jobs.schema[ident].dataType
    bucket = F.size(F.filter(F.array(*(F.lit(int(c)).cast(kind) for c in sorted(set(cuts)))), lambda e: e < F.col(ident))) if cuts else F.lit(0)
    rows = jobs.withColumn("_bucket", bucket)
    ranges = rows.groupBy(group, "chars", "_bucket").agg(F.count("*").alias("count"))
    before = Window.partitionBy(group, "chars").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(F.col(group).alias("_g"), F.col("chars").alias("_c"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    histogram = ranges.groupBy(group, "chars").agg(F.sum("count").alias("count"))
    ship(jobs.sparkSession)
    schema = T.StructType([jobs.schema[group], jobs.schema["chars"], *(T.StructField(n, T.LongType()) for n in ("joining", "open", "fresh", "each"))])
    packed = histogram.groupBy(group).applyInPandas(lambda one: _packed_lengths(one, group, size, budget), schema).withColumnRenamed(group, "_pg").withColumnRenamed("chars", "_pc")
    local = F.row_number().over(Window.partitionBy(group, "chars", "_bucket").orderBy(ident)) - 1
    ranked = rows.withColumn("_local", local)
    ranked = ranked.join(offsets, ranked[group].eqNullSafe(F.col("_g")) & ranked["chars"].eqNullSafe(F.col("_c")) & (ranked["_bucket"] == F.col("_b")))
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_local"))
    placed = ranked.join(packed, ranked[group].eqNullSafe(F.col("_pg")) & ranked["chars"].eqNullSafe(F.col("_pc")))
    batch = F.when(F.col("_rank") < F.col("joining"), F.col("open")).otherwise(F.col("fresh") + F.floor((F.col("_rank") - F.col("joining")) / F.col("each")))
    return placed.select(*jobs.columns, batch.cast("int").alias("batch"))
