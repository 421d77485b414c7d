"""The next version of a table: merges, upserts, deletes and their counters.

Tables are Parquet, so an update is a function from a table's version to the next one; write the result elsewhere and
swap, never onto the path that is read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cuts import durable


def _same(a: str, b: str, on: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in on])


def merge(old: DataFrame, new: DataFrame, on: Sequence[str], keep: Sequence[str] = ("id",), delete_missing: bool = True) -> DataFrame:
    """``new`` by natural key, with the columns of ``keep`` from the row that was there; null keys equal null.

    Rows that the new table lacks go, or stay with ``delete_missing=False``.
    """
    kept = F.col
    joined = new.alias("n").join(old.alias("o"), _same("n", "o", on), "left")
    out = joined.select(*(F.coalesce(kept(f"o.{c}"), kept(f"n.{c}")).alias(c) if c in keep and c in old.columns else kept(f"n.{c}").alias(c) for c in new.columns))
    return out if delete_missing else out.unionByName(missing(old, new, on).select(*new.columns))


def missing(old: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``old`` whose keys ``new`` lacks, null keys equal to null."""
    return old.alias("o").join(new.alias("n"), _same("o", "n", on), "left_anti")


def changes(old: DataFrame, new: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Counts of inserted, updated, unchanged and deleted rows of a merge."""
    a = old.select(*on, F.struct(*values).alias("_a"), F.lit(1).alias("_o"))
    b = new.select(*on, F.struct(*values).alias("_b"), F.lit(1).alias("_n"))
    both = a.alias("a").join(b.alias("b"), _same("a", "b", on), "full")
    return both.agg(
        F.count_if(F.col("_o").isNull()).alias("inserted"), F.count_if(F.col("_o").isNotNull() & F.col("_n").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("updated"),
        F.count_if(F.col("_o").isNotNull() & F.col("_n").isNotNull() & F.col("_a").eqNullSafe(F.col("_b"))).alias("unchanged"), F.count_if(F.col("_n").isNull()).alias("deleted"),
    )


def upsert(table: DataFrame, rows: DataFrame, on: Sequence[str], guard: Column | None = None) -> DataFrame:
    """Rows take the place of those with their keys; a guard names table rows that stay."""
    if guard is not None:
        held = table.where(guard)
        rows = rows.join(held.select(*on), list(on), "left_anti")
    return table.join(rows.select(*on), list(on), "left_anti").unionByName(rows.select(*table.columns))


def insert_new(table: DataFrame, rows: DataFrame, on: Mapping[str, Column] | Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The rows whose keys (columns or expressions) the table lacks, each key once: of rows with equal keys
    the first by ``order`` and then by all columns; null keys equal null."""
    return _offered(table, rows, on, order).where("NOT _there AND NOT _again").select(*rows.columns)


def _offered(table: DataFrame, rows: DataFrame, on: Mapping[str, Column] | Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with _there (the table has its key) and _again (an earlier row of the batch has it).

    Keys are counted before the table meets them, and all rows of a key but the least need no more than a comparison, so
    that a key with very many rows is never gathered.
    """
    keys = on if isinstance(on, Mapping) else {k: F.col(k) for k in on}
    named = [f"_k_{k}" for k in keys]
    staged = rows.withColumn("_row", F.monotonically_increasing_id()).select("*", *(v.alias(n) for n, v in zip(named, keys.values(), strict=True)))
    staged = durable(staged)  # numbers of rows must not change between the two uses
    rank = F.struct(*order, *(c for c in rows.columns if c not in order and not c.startswith("_k_") and _orderable(rows.schema[c].dataType)), "_row")
    first = durable(staged.groupBy(*named).agg(F.min(rank)["_row"].alias("_first")))
    there = table.select(*(v.alias(n) for n, v in zip(named, keys.values(), strict=True))).distinct().withColumn("_known", F.lit(True))
    told = first.alias("a").join(there.alias("b"), _same("a", "b", named), "left").select("_first", F.coalesce("_known", F.lit(False)).alias("_new_there"), *(F.col(f"a.{n}").alias(n) for n in named))
    marked = staged.alias("a").join(told.alias("b"), _same("a", "b", named))
    return marked.select(*(F.col(f"a.{c}").alias(c) for c in rows.columns), F.col("_new_there").alias("_there"), (F.col("a._row") != F.col("_first")).alias("_again"))


def _orderable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))


def append_counted(table: DataFrame, rows: DataFrame, on: Mapping[str, Column] | Sequence[str], path: str, order: Sequence[str] = ()) -> dict[str, int]:
    """Append what insert_new keeps to the Parquet table at ``path``; how many rows were offered, added,
    there already and repeated in the batch. The counts are taken while the rows are written, without a second scan."""
    seen = Observation("append")
    marked = _offered(table, rows, on, order)
    watched = marked.observe(
        seen, F.count(F.lit(1)).alias("offered"), F.count_if(~F.col("_there") & ~F.col("_again")).alias("added"), F.count_if("_there").alias("there"), F.count_if(~F.col("_there") & F.col("_again")).alias("repeated")
    )
    watched.where("NOT _there AND NOT _again").select(*rows.columns).write.mode("append").parquet(path)
    return seen.get


def number_rows(rows: DataFrame, order: Sequence[str], column: str = "id", after: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """``rows`` with gapless numbers in ``order``, from 1 or from the largest ``column`` of ``after`` on.

    Rows are dealt by range and kept, so that a task that runs again numbers alike; ranges are counted and a row's number
    is the rows of the ranges before and its place within its own. No task sees more than a range, and the driver one
    count for each range. Rows that are equal in ``order`` stand in either order. Null keys come first.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    placed = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    start = 0 if after is None else after.agg(F.max(column)).first()[0] or 0
    offsets, total = [], start
    for part in sorted(counts):
        offsets.append((part, total))
        total += counts[part]
    before = F.broadcast(spark.createDataFrame(offsets, "_p int, _before long"))
    return placed.join(before, F.col("_part") == F.col("_p")).select((F.col("_before") + F.col("_at") + 1).alias(column), *(c for c in rows.columns if c != column))


def cascade(child: DataFrame, parent: DataFrame, fk: str, pk: str = "id", set_null: bool = False) -> DataFrame:
    """Children whose parent is there; or all of them, with the key of a parent that isn't set to null."""
    ids = parent.select(F.col(pk).alias("_pk"))
    if not set_null:
        return child.join(ids, child[fk] == F.col("_pk"), "left_semi")
    joined = child.join(ids, child[fk] == F.col("_pk"), "left")
    return joined.withColumn(fk, F.when(F.col("_pk").isNotNull(), F.col(fk))).drop("_pk")


def violations(table: DataFrame, checks: Mapping[str, Column], unique: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Constraint and number of rows that break it; a check that is null holds."""
    out = [table.agg(F.count_if(~c).alias("rows")).select(F.lit(name).alias("constraint"), "rows") for name, c in checks.items()]
    for keys in unique:
        out.append(table.groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).select(F.lit("unique(" + ", ".join(keys) + ")").alias("constraint"), "rows"))
    return reduce(DataFrame.union, out)


def mark(table: DataFrame, keys: DataFrame, on: Sequence[str], column: str, value: object) -> DataFrame:
    """A column set on the rows with given keys."""
    hit = keys.select(*on).distinct().withColumn("_hit", F.lit(True))
    return table.join(hit, list(on), "left").withColumn(column, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(column))).drop("_hit")


def set_json(column: Column, fields: Mapping[str, Column], schema: str) -> Column:
    """Fields of a JSON object set; invalid JSON becomes an object of these fields alone."""
    parsed = F.from_json(column, schema)
    for k, v in fields.items():
        parsed = parsed.withField(k, v)
    return F.coalesce(F.to_json(parsed), F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))))


def replace_prefix(column: Column, old: str, new: str) -> Column:
    """A path's prefix, if it ends at a separator."""
    return F.when(column.startswith(f"{old}/"), F.concat(F.lit(new), F.substring(column, F.lit(len(old) + 1), F.length(column)))).otherwise(column)


def replace_member(members: Column, old: Column, new: Column) -> Column:
    """An ordered array with one member replaced, each member once."""
    return F.array_distinct(F.transform(members, lambda m: F.when(m == old, new).otherwise(m)))


def split_import(rows: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Overrides (rows with a text) and reviewed (blank ones)."""
    blank = F.nullif(F.trim(text), F.lit(""))
    return rows.where(blank.isNotNull()), rows.where(blank.isNull())


def resume(jobs: DataFrame, done: DataFrame, fingerprint: Sequence[str]) -> DataFrame:
    """The jobs that aren't done with all the same fingerprints."""
    return missing(jobs, done, fingerprint)


def invalidated(cache: DataFrame, project: int | None = None) -> DataFrame:
    """The cache without a project's rows, or without any."""
    return cache.where(~F.col("project_id").eqNullSafe(F.lit(project))) if project is not None else cache.limit(0)


def rebuilt(cache: DataFrame, version: int, build) -> DataFrame:
    """The cached rows if they all have this version, else what ``build`` makes; the test reads two numbers."""
    lowest, highest = cache.agg(F.min("version"), F.max("version")).first()
    return cache if lowest == highest == version else build()
