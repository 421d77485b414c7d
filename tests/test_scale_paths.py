import random

import pytest
from pyspark.sql import functions as F

from voxloom.operators import ordering, state
from voxloom.streaming import incremental

SCHEMA = "k long, kind string, v long"


def test_streams_add_what_the_target_lacks_over_restarts(spark, tmp_path):
    target, source, memory = (str(tmp_path / n) for n in ("target", "source", "memory"))
    rng = random.Random(1)
    have = [(k, "old", 0) for k in range(0, 40, 3)] + [(None, "old", 0)]
    spark.createDataFrame(have, SCHEMA).write.parquet(target)
    offered = []
    for turn in range(3):
        fresh = [(rng.choice([None, *range(60)]), f"b{turn}", rng.randrange(1000)) for _ in range(80)]
        spark.createDataFrame(fresh, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        offered.append(fresh)
        stream = incremental.read_stream(spark, source, spark.createDataFrame([], SCHEMA))
        incremental.append_new(stream, target, memory, ["k"], ["v", "kind"]).awaitTermination()
    got = sorted(map(tuple, incremental.read_target(spark, target, spark.createDataFrame([], SCHEMA).schema).collect()), key=str)
    # the batch form, one batch after the other
    want = list(have)
    for fresh in offered:
        table = spark.createDataFrame(want, SCHEMA)
        want += [tuple(r) for r in state.insert_new(table, spark.createDataFrame(fresh, SCHEMA), ["k"], ["v", "kind"]).collect()]
    assert got == sorted(want, key=str)


def test_keys_are_forgotten_once_the_watermark_has_passed(spark, tmp_path):
    target, source, memory = (str(tmp_path / n) for n in ("target", "source", "memory"))
    like = spark.createDataFrame([], "k long, ts timestamp, n long")
    for turn, rows in enumerate([[(1, "2024-01-01 00:00:00")], [(2, "2024-01-03 00:00:00")], [(3, "2024-01-03 01:00:00"), (4, "2023-12-31 00:00:00")], [(1, "2024-01-03 02:00:00"), (2, "2024-01-03 02:00:00")]]):
        frame = spark.createDataFrame([(k, t, turn) for k, t in rows], "k long, ts string, n long").withColumn("ts", F.col("ts").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = incremental.read_stream(spark, source, like)
        incremental.append_new(stream, target, memory, ["k"], ["ts"], "ts", "1 hours").awaitTermination()
    got = sorted((r.k, r.n) for r in incremental.read_target(spark, target, like.schema).collect())
    assert (4, 2) not in got  # too late
    assert (1, 0) in got and (1, 3) in got and (2, 1) in got and (3, 2) in got  # 1 was forgotten, 2 was not
    assert (2, 3) not in got


def test_insert_new_takes_the_first_by_order_and_counts_while_writing(spark, tmp_path):
    table = spark.createDataFrame([(1, "t", 0), (None, "t", 0)], SCHEMA)
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 9), (2, "c", 3), (2, "c", 3), (3, "d", None), (3, "e", 0), (None, "f", 1)], SCHEMA).repartition(3)
    assert sorted(map(tuple, state.insert_new(table, rows, ["k"], ["v"]).collect())) == [(2, "c", 3), (3, "d", None)]
    path = str(tmp_path / "out")
    counts = state.append_counted(table, rows, ["k"], path, ["v"])
    assert counts == {"offered": 7, "added": 2, "there": 2, "repeated": 3} and spark.read.parquet(path).count() == counts["added"]


def test_counts_do_not_read_the_rows_again(spark, tmp_path):
    """One more job than the write itself would be a second scan; the tracker counts the jobs of the write."""
    table, rows = spark.createDataFrame([(1, "t", 0)], SCHEMA), spark.createDataFrame([(k, "x", k) for k in range(100)], SCHEMA)
    marked = state._offered(table, rows, ["k"], [])
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("plain", "")
    marked.where("NOT _there AND NOT _again").write.parquet(str(tmp_path / "a"))
    plain = len(tracker.getJobIdsForGroup("plain"))
    seen = state.Observation("again")
    sc.setJobGroup("seen", "")
    marked.observe(seen, F.count(F.lit(1)).alias("n")).where("NOT _there AND NOT _again").write.parquet(str(tmp_path / "b"))
    assert seen.get == {"n": 100} and len(tracker.getJobIdsForGroup("seen")) == plain
    sc.setLocalProperty("spark.jobGroup.id", None)


def test_numbers_go_on_without_gaps(spark):
    rng = random.Random(2)
    names = [f"n{k:04d}" for k in rng.sample(range(5000), 700)]
    rows = spark.createDataFrame([(n, 1) for n in names], "name string, x int").repartition(6)
    old = spark.createDataFrame([(17,), (90,)], "id long")
    got = state.number_rows(rows, ["name"], after=old, parts=9)
    assert [tuple(r) for r in got.orderBy("id").select("id", "name").collect()] == [(91 + k, n) for k, n in enumerate(sorted(names))]
    assert state.number_rows(rows.limit(0), ["name"]).collect() == []
    many = state.number_rows(spark.createDataFrame([(1, k) for k in range(50)], "a int, b int"), ["a"])
    assert sorted(r.id for r in many.collect()) == list(range(1, 51))


@pytest.mark.parametrize("enough", [5, 60])
def test_deep_pages_equal_sorted_ones(spark, enough):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, rng.randrange(900)]), rng.choice([None, "a", "b", "ä", f"s{rng.randrange(50)}"]), k) for k in range(1500)]
    frame = spark.createDataFrame(rows, "a long, b string, id long").repartition(4)
    for keys in ([("a", True), ("b", False), ("id", True)], [("b", True), ("a", False), ("id", False)], [("id", False)]):
        order = [F.col(c).asc() if up else F.col(c).desc() for c, up in keys]
        whole = [r.id for r in frame.orderBy(*order).collect()]
        for offset in (0, 3, 777, 1490, 1500, 2000):
            got = ordering.deep_page(frame, keys, offset, 25, edges=9, enough=enough)
            assert [r.id for r in got.collect()] == whole[offset : offset + 25], (keys, offset)
    plan = ordering.deep_page(frame, keys, 700, 25, edges=9, enough=enough)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
    assert ordering.deep_page(frame.limit(0), keys, 5, 5).collect() == []
