"""Sharding by balanced label propagation.

Documents with equal texts are linked. They start in even shards by hash; what a group has in one shard is a piece. In
each round a piece learns by join how the rest of its group is spread and asks to move to the shard that holds most of
it, and a shard admits pieces in an order by hash while their running total stays within its room: as many rows as it
has unlinked documents to give up. In the end unlinked documents level the shards, so that their sizes in rows differ
by one at most, whatever the links. Rounds work on pieces, of which there are no more than linked groups times shards;
documents are read again once, after the last round, and unlinked ones take no part in any join.

A group is split only if it exceeds a shard, by hash into as few blocks as shards can hold. Blocks larger than an eighth
of a shard are few; the driver gives each a shard with room for all of it, the largest first, before anything else is
placed, and they stay there. All ranks and running totals are counted in hash buckets of bounded size, to which large
groups are dealt by row, joined with running totals of buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table, written

SHARDS, ROUNDS = 40, 4
#: Rows that one bucket of a ranking holds, on average.
BUCKET_ROWS = 50_000


def _lookup(values: list[int], shard: str = "shard") -> Column:
    """The value for each shard; one small array."""
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col(shard) + 1)


def _before(rows: DataFrame, group: str, weight: Column, *order: Column) -> DataFrame:
    """``before``: the sum of ``weight`` over the rows of the same ``group`` that come first in the order of ``bucket`` and
    then ``order``, which must tell the rows of a bucket apart or leave them alike."""
    rows = rows.withColumn("_weight", weight)
    sums = rows.groupBy(group, "bucket").agg(F.sum("_weight").alias("sum"))
    earlier = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(group, "bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("_offset"))
    local = F.coalesce(F.sum("_weight").over(Window.partitionBy(group, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_local", local).join(offsets, [group, "bucket"]).withColumn("before", F.col("_offset") + F.col("_local")).drop("_weight", "_offset", "_local", "bucket")


def ask(pieces: DataFrame, room: list[int]) -> DataFrame:
    """(block, shard, target, count): the moves that pieces (block, start, count, shard) ask for.

    All that a block has in a shard asks for the shard that holds most of the block, of those with room. It does not
    leave a shard that holds more.
    """
    spread = pieces.groupBy("block", "shard").agg(F.sum("count").alias("count"))
    best = F.max(F.struct("count", F.xxhash64("block", "shard").alias("tie"), "shard")).alias("best")
    target = spread.where(_lookup(room) > 0).groupBy("block").agg(best).select("block", F.col("best.shard").alias("target"), F.col("best.count").alias("there"))
    return spread.join(target, "block").where("shard <> target AND there >= count").select("block", "shard", "target", "count")


def admit(asks: DataFrame, room: list[int], salt: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of ``asks`` whose running total, within a target and in an order by hash, is within the target's room."""
    buckets = max(1, asks.count() // bucket_rows)
    lot = F.xxhash64("block", "shard", F.lit(salt))
    ordered = _before(asks.withColumn("bucket", F.pmod(F.shiftright(lot, 20), F.lit(buckets))), "target", F.col("count"), lot, F.col("block"), F.col("shard"))
    return ordered.where(F.col("before") + F.col("count") <= _lookup(room, "target")).select("block", "shard", "target", "count")


def propagate(pieces: DataFrame, held: list[int], capacity: list[int], rounds: int) -> DataFrame:
    """``pieces`` after some rounds of moves; ``held`` are the rows of each shard that stay there in any case."""
    shards = range(len(capacity))
    for k in range(rounds):
        loads = {r["shard"]: r["n"] for r in pieces.groupBy("shard").agg(F.sum("count").alias("n")).collect()}
        room = [max(0, capacity[s] - held[s] - loads.get(s, 0)) for s in shards]
        moves = durable(admit(durable(ask(pieces, room)), room, k))
        if moves.isEmpty():
            break
        pieces = durable(pieces.join(moves.select("block", "shard", "target"), ["block", "shard"], "left").select("block", "start", "count", F.coalesce("target", "shard").alias("shard")))
    return pieces


def _homes(sizes: dict[int, int], capacity: list[int]) -> tuple[dict[int, int], list[int]]:
    """A shard for each block and the rows left free in each shard: the largest block first, in the tightest place that
    holds it, or else in the widest."""
    free, homes = list(capacity), {}
    for block in sorted(sizes, key=lambda b: (-sizes[b], b)):
        fit = [s for s, f in enumerate(free) if f >= sizes[block]]
        homes[block] = min(fit, key=lambda s: (free[s], s)) if fit else max(range(len(free)), key=lambda s: (free[s], -s))
        free[homes[block]] = max(0, free[homes[block]] - sizes[block])
    return homes, free


def _counts(rows: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}
    return [found.get(s, 0) for s in range(shards)]


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, linked and group of each row, in shards that differ by at most one row.

    size is the text's UTF-8 bytes and 16; slot numbers the rows of a shard from 0 without gaps; group is a hash of the
    text, which linked rows share. A null text has no bytes, the checksum of the empty text, and equals other null or
    empty texts. Rows that repeat an id and a text, or lack ids, are told apart by a number. With fewer rows than shards some shards
    are empty; an empty table gives an empty result. Further columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group"))
    rows = durable(rows.withColumn("_row", F.monotonically_increasing_id()))
    n = rows.count()
    capacity = [n // shards + (s < n % shards) for s in range(shards)]
    buckets = max(1, n // bucket_rows)
    # cut here, so that the join below is between two plain shuffles, whose hot group Spark can split
    groups = durable(rows.groupBy("group").count().where("count > 1"))
    block_rows, small = max(2, n // shards), max(2, n // shards // 8)
    # a row's hash is that of its id and text, and of its number only where these repeat
    again = durable(rows.groupBy(F.col("doc_id").alias("_id"), F.col("group").alias("_text")).agg(F.count("*").alias("again")).where("again > 1"))
    rows = rows.join(again, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("group") == F.col("_text")), "left")
    copy = F.xxhash64("doc_id", "group", F.when(F.col("again").isNotNull(), F.col("_row")))
    part = F.pmod(F.xxhash64(copy, F.lit(3)), F.ceil(F.col("count") / block_rows))
    block = F.when(F.col("count") > 1, F.xxhash64("group", part))
    linked = durable(rows.join(groups, "group", "left").select("doc_id", "size", "text_crc32", "group", block.alias("block"), copy.alias("copy"), F.coalesce("count", F.lit(1)).alias("count")))
    large = (F.col("count") > small) & F.col("block").isNotNull()
    homes, free = _homes({r["block"]: r["count"] for r in linked.where(large).groupBy("block").count().collect()}, capacity)
    home = F.broadcast(docs.sparkSession.createDataFrame(list(homes.items()), "block long, home int"))  # 8 blocks a shard at most
    # all else starts by hash, in proportion to the room that is left
    ends = F.array(*(F.lit(sum(free[: s + 1])).cast("long") for s in range(shards)))
    at = F.pmod("copy", F.lit(max(1, sum(free))))
    start = F.least(F.size(F.filter(ends, lambda e: e <= at)), F.lit(shards - 1))
    placed = durable(linked.join(home, "block", "left").withColumn("start", F.coalesce("home", start).cast("int")).drop("home"))
    moving = F.col("block").isNotNull() & ~large
    pieces = durable(placed.where(moving).groupBy("block", "start").count().withColumn("shard", F.col("start")))
    pieces = propagate(pieces, _counts(placed.where(large).withColumnRenamed("start", "shard"), shards), capacity, rounds)
    moved = placed.where(moving).join(pieces.select("block", "start", "shard"), ["block", "start"]).select(*placed.columns, "shard")
    placed = moved.unionByName(placed.where(~moving).withColumn("shard", F.col("start")))
    # linked documents come first in a shard, so the unlinked ones level it
    lot = F.xxhash64("block", F.pmod("copy", F.ceil(F.col("count") / bucket_rows)))
    bucket = F.when(F.col("block").isNull(), F.pmod(F.shiftright("copy", 20), F.lit(buckets))).when(large, F.pmod("copy", F.lit(buckets)) - 2 * buckets).otherwise(F.pmod(lot, F.lit(buckets)) - buckets)
    ranked = durable(_before(placed.withColumn("bucket", bucket), "shard", F.lit(1), F.col("block"), F.col("copy"), F.col("doc_id")).withColumnRenamed("before", "rank"))
    load = _counts(ranked, shards)
    over, free = [max(0, a - c) for a, c in zip(load, capacity, strict=True)], [max(0, c - a) for a, c in zip(load, capacity, strict=True)]
    # rows beyond a shard's capacity are numbered through, and so are the free places
    first_over, first_free = [sum(over[:s]) for s in range(shards)], [sum(free[:s]) for s in range(shards)]
    number = F.col("rank") - _lookup(capacity) + _lookup(first_over)
    fits = F.array(*(F.lit(f).cast("long") for f in first_free))
    beyond = F.col("rank") >= _lookup(capacity)
    # the last shard whose first free place is not beyond the number; shards without a free place come before it
    there = F.size(F.filter(fits, lambda f: f <= F.col("number"))) - 1
    out = ranked.withColumn("number", F.when(beyond, number)).withColumn("to", F.when(beyond, there))
    held = F.element_at(F.array(*(F.lit(min(a, c)).cast("long") for a, c in zip(load, capacity, strict=True))), F.col("to") + 1)
    slot = F.when(beyond, held + F.col("number") - F.element_at(fits, F.col("to") + 1)).otherwise(F.col("rank"))
    return out.select("doc_id", "size", "text_crc32", F.coalesce("to", "shard").alias("shard"), slot.cast("long").alias("slot"), F.col("block").isNotNull().alias("linked"), "group")


def cut_links(placed: DataFrame) -> DataFrame:
    """rows (of a group), groups, links and cut: the links between equal texts, and those that lie across shards, by the
    size of the group."""
    pairs = lambda n: n * (n - 1) / 2
    held = placed.where("linked").groupBy("group", "shard").count()
    groups = held.groupBy("group").agg(F.sum("count").alias("rows"), F.sum(pairs(F.col("count"))).alias("whole"))
    return groups.groupBy("rows").agg(F.count("*").alias("groups"), F.sum(pairs(F.col("rows"))).alias("links"), F.sum(pairs(F.col("rows")) - F.col("whole")).alias("cut")).orderBy("rows")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write ``docs`` with shard and slot, one folder for each shard, in the order of slots.

    Every row is written once, whatever its id: rows are numbered first. Columns of ``docs`` that are called shard or
    slot give way.
    """
    numbered = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered-rows")
    placed = shard_documents(numbered.select(F.col("_row").alias("doc_id"), "text"), shards).select(F.col("doc_id").alias("_row"), "shard", "slot")
    rows = numbered.select("_row", *(c for c in docs.columns if c not in ("_row", "shard", "slot"))).join(placed, "_row").drop("_row")
    rows.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
