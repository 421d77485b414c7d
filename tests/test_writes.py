import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import signal
from voxloom.operators import aggregates, graph, predicates, ranking
from voxloom.plans import pipelines, writes
from voxloom.streaming import incremental


def packed_plainly(lengths, size, budget):
    out, number, held, total = [], 0, 0, 0
    for n in lengths:
        if held and (held >= size or total + n > budget):
            number, held, total = number + 1, 0, 0
        held, total = held + 1, total + n
        out.append(number)
    return out


@pytest.mark.parametrize(("size", "budget", "parts"), [(8, 800, 9), (3, 40, 30), (1, 10, 5), (50, 300, 40), (4, 0, 7)])
def test_packing_over_many_tasks_equals_one_walk(spark, size, budget, parts):
    """One group that most partitions share, small groups beside it, and partitions shorter than an open batch."""
    rng = random.Random(parts)
    rows = [("m", i, rng.choice([0, 0, 3, 12, rng.randrange(900)])) for i in range(700)] + [(rng.choice(["a", "b", "c", None, "z"]), i, rng.choice([None, 5, 70])) for i in range(700, 900)]
    jobs = spark.createDataFrame(rows, "voice string, id long, chars int").repartition(4)
    got = {r.id: r.batch for r in aggregates.pack_batches(jobs, "voice", ["id"], size, budget, parts=parts).collect()}
    want = {}
    for voice in {r[0] for r in rows}:
        mine = sorted((i, n or 0) for v, i, n in rows if v == voice)
        want |= dict(zip([i for i, _ in mine], packed_plainly([n for _, n in mine], size, budget), strict=True))
    assert got == want
    assert aggregates.pack_batches(jobs.limit(0), "voice", ["id"]).count() == 0


@pytest.mark.parametrize(("size", "budget"), [(8, 800), (3, 40), (1, 10)])
def test_packing_by_length_equals_the_walk(spark, size, budget):
    rng = random.Random(size)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([0, 5, 12, 12, 12, rng.randrange(900)])) for i in rng.sample(range(5000), 400)]
    jobs = spark.createDataFrame(rows, "id long, voice string, chars int")
    walked = {r.id: r.batch for r in aggregates.pack_batches(jobs, "voice", ["chars", "id"], size, budget).collect()}
    assert {r.id: r.batch for r in aggregates.pack_by_length(jobs, "voice", "id", size, budget, edges=7).collect()} == walked
    assert aggregates.pack_by_length(jobs.limit(0), "voice", "id").count() == 0


def test_generation_plan_has_no_task_for_a_whole_voice(spark):
    jobs = spark.createDataFrame([(i, "v", f"text {i}", "{}") for i in range(50)], "id long, voice string, text string, settings string")
    plan = pipelines.plan_generation(jobs)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and plan.count("FlatMapGroupsInPandas") >= 1
    assert pipelines.plan_generation(jobs).groupBy("batch").count().agg(F.max("count")).first()[0] == 8


def test_a_fault_in_looking_for_the_target_appends_nothing(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows.write.parquet(source)

    def run(name):
        query = incremental.append_new(incremental.read_stream(spark, source, rows), target, str(tmp_path / name), ["id"])
        query.awaitTermination()

    run("c1")
    assert spark.read.option("recursiveFileLookup", True).parquet(target).count() == 2
    real = incremental.exists

    def broken(session, path):
        raise OSError("the file system is away")

    monkeypatch.setattr(incremental, "exists", broken)
    with pytest.raises(Exception, match="away"):
        run("c2")
    assert spark.read.option("recursiveFileLookup", True).parquet(target).count() == 2
    monkeypatch.setattr(incremental, "exists", real)
    run("c3")
    assert spark.read.option("recursiveFileLookup", True).parquet(target).count() == 2


def test_pool_fallback_matches_brute_force(spark):
    rng = random.Random(3)
    kind = lambda: (rng.randrange(3), rng.randrange(4), rng.randrange(4))
    speakers, donors = [(i, *kind(), None) for i in range(60)], [(100 + i, *kind(), float(rng.randrange(4))) for i in range(25)]
    got = pipelines.assign_pools(
        spark.createDataFrame(speakers, "id long, sex int, race int, category int, explicit long"),
        spark.createDataFrame([], "sex int, race int, category int, members array<long>"),
        spark.createDataFrame(donors, "id long, sex int, race int, category int, quality double"),
    )
    want = {}
    for i, sex, race, category, _ in speakers:
        fit = [((c == category) * 4 + (r == race) * 2, q, -d) for d, s, r, c, q in donors if s == sex and sex]
        want[i] = -max(fit)[2] if fit else None
    assert {r.id: r.voice for r in got.collect()} == want


def test_chains_that_go_round_or_end_late(spark):
    follow = [(i, "follow", i + 1) for i in range(12)] + [(12, "override", None), (20, "follow", 21), (21, "follow", 20), (30, "follow", 31), (40, "follow", None)]
    got = {r.speaker: (r.at, r.hops, r.status) for r in graph.effective(spark.createDataFrame(follow, "speaker long, source string, follows long")).collect()}
    assert got[20][2] == got[21][2] == "cycle" and got[0] == (8, 8, "depth") and got[5] == (12, 7, "own") and got[30][2] == got[40][2] == "missing"
    ends = {r.speaker: r.status for r in graph.walk(spark.createDataFrame(follow, "speaker long, source string, follows long")).collect()}
    assert {k: v[2] if v[2] != "cycle" else "depth" for k, v in got.items()} == ends


def test_majority_leaves_ties_out(spark):
    rows = [("a", "x", 1.0), ("a", "y", 2.0), ("a", "y", 0.5), ("b", "x", 2.0), ("b", "y", 2.0), ("c", "z", 1.0), ("d", "x", 3.0), ("d", "y", 3.0), ("d", "z", 1.0)]
    got = ranking.majority(spark.createDataFrame(rows, "key string, option string, value double"), "key", "option", "value").collect()
    assert {(r.key, r.option) for r in got} == {("a", "y"), ("c", "z")}


def test_pitch_does_not_depend_on_chunks(monkeypatch):
    rate = 8000
    t = np.arange(rate * 3) / rate
    clip = (0.3 * np.sin(2 * np.pi * 150 * t) + 0.01 * np.random.default_rng(0).normal(size=len(t))).astype(np.float32)
    whole = signal.pitch(clip, rate)
    monkeypatch.setattr(signal, "FRAMES", 7)
    assert signal.pitch(clip, rate) == whole and abs(whole[0] - 150) < 3


def test_persist_keeps_other_projects(spark):
    line = spark.createDataFrame([(1, 10, 5, "d", 0, "old"), (2, 11, 5, "d", 0, "other"), (1, 12, 6, "d", 1, "gone")], "project_id int, id int, strref int, dialogue string, state int, text string")
    speaker = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "project_id int, id int, name string")
    profile = spark.createDataFrame([(1, 1, "harvested"), (1, 2, "imported"), (2, 3, "harvested")], "project_id int, id int, origin string")
    pool = spark.createDataFrame([(1, 1), (2, 2)], "project_id int, id int")
    old = {"line": line, "speaker": speaker, "profile": profile, "pool": pool}
    new = {"line": spark.createDataFrame([(1, 99, 5, "d", 0, "new")], line.schema), "speaker": speaker.where("project_id = 1")}
    rows = lambda df: sorted(map(tuple, df.collect()))
    merged, wiped = writes.persist(old, new, 1, "merge"), writes.persist(old, new, 1, "wipe")
    assert rows(merged["line"]) == [(1, 10, 5, "d", 0, "new"), (2, 11, 5, "d", 0, "other")] and rows(merged["pool"]) == rows(pool) and rows(merged["profile"]) == rows(profile)
    assert rows(wiped["line"]) == [(1, 99, 5, "d", 0, "new"), (2, 11, 5, "d", 0, "other")] and rows(wiped["pool"]) == [(2, 2)] and rows(wiped["profile"]) == [(1, 2, "imported"), (2, 3, "harvested")]
    with pytest.raises(ValueError, match="neither"):
        writes.persist(old, new, 1, "other")


def test_audio_of_a_pack_counts_as_none(spark):
    rows = spark.createDataFrame([(True, "Z00001AB"), (True, "VOICE"), (True, None), (False, "VOICE")], "voiced boolean, sound string")
    assert [r[0] for r in rows.select(predicates.generatable(F.col("voiced"), F.col("sound"))).collect()] == [True, False, False, True]
