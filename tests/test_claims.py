import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import hashing, signal, text
from voxloom.operators import bindings, ordering, predicates, state
from voxloom.plans import pipelines
from voxloom.sources import tables
from voxloom.streaming import incremental


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# ---- clips


def tone(hz, seconds, rate=8000, loud=0.3):
    return (loud * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)).astype(np.float32).tolist()


def test_composites_have_silence_between(spark):
    clips = spark.createDataFrame([([[1.0, 2.0], [3.0], [4.0]],), ([[5.0]],), ([],)], "clips array<array<float>>")
    got = [r[0] for r in clips.select(signal.build_composite(F.col("clips"), 10, 0.2)).collect()]
    assert got == [[1.0, 2.0, 0, 0, 3.0, 0, 0, 4.0], [5.0], []]


def test_rendered_levels(spark):
    loud, quiet = [32767, -32760] * 80, [0] * 160
    clips = spark.createDataFrame([(1, loud + quiet, 8000), (2, [], 8000), (3, None, None)], "id int, samples array<int>, rate int")
    got = {r.id: r.m for r in clips.select("id", signal.render_levels("samples", "rate").alias("m")).collect()}
    assert got[1].silence_ratio == 0.5 and got[1].clipped_samples == 160 and abs(got[1].peak_dbfs) < 0.001
    assert got[2].peak_dbfs == -120 and got[2].silence_ratio == 1 and got[3].clipped_samples == 0


def test_peaks_and_rates(spark):
    clips = spark.createDataFrame([([0.1, -0.5],), ([0.0],), ([],)], "s array<float>")
    got = [r[0] for r in clips.select(signal.normalize_peak(F.col("s"))).collect()]
    assert np.allclose(got[0], [0.2 * 10**-0.05, -(10**-0.05)], atol=1e-6) and got[1:] == [[0.0], []]
    moved = spark.createDataFrame([(tone(200, 0.5), 8000, 16000), (tone(200, 0.5), 8000, 4000), ([], 8000, 4000)], "s array<float>, r int, t int").select(signal.resample("s", "r", "t")).collect()
    assert np.allclose(moved[0][0], tone(200, 0.5, 16000), atol=0.01) and np.allclose(moved[1][0], tone(200, 0.5, 4000), atol=0.01) and moved[2][0] == []


def test_harvest_and_speech(spark):
    candidates = spark.createDataFrame([(1, "a", "dialogue_state", 1.0, "Well met, my friend. What brings you here?"), (2, "b", "sound_slot", 0.5, "Ugh."), (3, "lost", "sound_slot", 1.0, "x")], "id int, sound string, origin string, confidence double, text string")
    clips = spark.createDataFrame([("A", tone(150, 2), 8000), ("b", tone(150, 1), 8000)], "sound string, samples array<float>, rate int")
    scored = pipelines.harvest(candidates, clips)
    before = {r.id: r.scores for r in scored.collect()}
    assert set(before) == {1, 2} and before[1].provenance == 1.0 and before[2].attribution == 0.5 and abs(before[1].duration_secs - 2) < 1e-9
    for s in before.values():
        assert abs(s.overall - sum(w * s[k] for k, w in signal.WEIGHTS.items())) < 1e-9
    after = {r.id: r.scores for r in pipelines.verify_speech(scored, spark.createDataFrame([(1, 0.25)], "id int, ratio double")).collect()}
    assert after[2] == before[2] and abs(after[1].speech - 0.5) < 1e-9
    assert abs(after[1].overall - before[1].overall - signal.WEIGHTS["speech"] * (0.5 - before[1].speech)) < 1e-9


def test_diagnostics_of_rendered_clips(spark):
    clips = spark.createDataFrame([(0.2, 0.7, 0.03, 0.1), (1.0, 0.1, 0.0, -1.0)], "duration_secs double, silence_fraction double, clipping_fraction double, voiced_fraction double")
    assert [r[0] for r in clips.select(signal.diagnostics()).collect()] == [["short", "mostly_silent", "clipping", "low_speech"], []]


# ---- texts and hashes


def test_effective_text_resolves_anew(spark):
    df = spark.createDataFrame([("Hail, <CHARNAME>!", "old"), ("No token", "stored"), ("", "a <SIRMAAM>"), (None, "kept")], "o string, s string")
    assert [r[0] for r in df.select(text.effective_spoken_text(F.col("o"), F.col("s"))).collect()] == ["Hail, friend!", "stored", "a friend", "kept"]


def test_lines_of_states(spark):
    states = spark.createDataFrame([("bjan", 3, 10, "Hail, <CHARNAME>!"), ("bjan", 4, 11, "Plain.")], "dialogue string, state int, strref int, text string")
    lines = pipelines.line_of(states)
    got = {r.state: r for r in lines.collect()}
    assert got[3].token_mask > 0 and got[3].spoken == "Hail, friend!" and got[4].token_mask == 0 and got[4].spoken == "Plain."
    assert json.loads(got[3].provenance) == {"origin": "dialogue_state", "dialogue": "bjan", "state": 3}
    assert lines.agg(predicates.token_total(lines)).first()[0] == 1


def test_settings_hash(spark):
    got = one(spark, hashing.settings_hash(F.struct(F.lit(1).alias("a"), F.lit("x").alias("b"))))[0]
    assert got == hashlib.sha256(b'{"a":1,"b":"x"}').hexdigest()


# ---- state and trials


def test_caches(spark):
    cache = spark.createDataFrame([(1, 7), (2, 7), (None, 7)], "project_id int, version int")
    assert rows(state.invalidated(cache, 1).select(F.coalesce("project_id", F.lit(0)))) == [(0,), (2,)] and state.invalidated(cache).count() == 0
    fresh = lambda: cache.limit(1)
    assert state.rebuilt(cache, 7, fresh).count() == 3 and state.rebuilt(cache, 8, fresh).count() == 1 and state.rebuilt(cache.limit(0), 7, fresh).count() == 1


def test_blind_trials_are_stable_and_mixed(spark):
    cases = spark.range(200).selectExpr("id AS line", "explode(array(0, 1, 2)) AS experiment").withColumn("clip", F.concat_ws("-", "line", "experiment"))
    got = rows(pipelines.blind_trials(cases, 42))
    assert got == rows(pipelines.blind_trials(cases.repartition(5), 42)) and got != rows(pipelines.blind_trials(cases, 43))
    assert len(got) == 400 and 150 < sum(side == "a" for *_, side in got) < 250
    for line, experiment, a, b, side in got:
        assert ((a, b) if side == "a" else (b, a)) == (f"{line}-0", f"{line}-{experiment}")


def test_own_binding_of_an_identity(spark):
    members = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 9), ("b", 4, 1), ("c", 5, 1), ("d", 6, 2), ("d", 7, 1)], "identity string, speaker int, lines int")
    held = spark.createDataFrame([(1, "override", "ready", 10), (2, "override", "pending", None), (3, "override", "ready", 11), (4, "generic", "ready", 12), (6, "generic", "ready", 13), (7, None, "pending", None)], "speaker int, source string, status string, sample int")
    got = bindings.personal_binding(members, held)
    assert {r.identity: r.speaker for r in got.collect()} == {"a": 1, "b": 4, "d": 7}
    assert {r.identity: r.speaker for r in bindings.personal_binding(members, held.where("speaker <> 1 OR source = 'generic'").withColumn("status", F.lit("x"))).collect()} == {"a": 2, "b": 4, "d": 7}
    assert bindings.personal_binding(members.limit(0), held).count() == 0


# ---- lists


def test_blocked_page_counts_beyond_the_page(spark):
    lines = spark.createDataFrame([(i, 100 + i, "D" if i % 2 else None, i if i % 3 else None, f"Text {i}", "dynamic token" if i < 4 else "other") for i in range(10)], "id int, strref int, dialogue string, state int, text string, reason string")
    page, totals = ordering.blocked_page(lines, 1, 2, query="TEXT", reason="other", sort="strref_desc")
    assert [r.id for r in page.collect()] == [8, 7] and tuple(totals.first()) == (6, 4)
    page, totals = ordering.blocked_page(lines, limit=0, sort="unknown")
    assert [r.id for r in page.collect()] == [2] and tuple(totals.first()) == (10, 4)
    assert ordering.blocked_page(lines.limit(0))[1].first()[:] == (0, 0)


def test_names_sort_without_case_and_accents(spark):
    people = spark.createDataFrame([(1, "zed"), (2, "Éa"), (3, "eb")], "id int, name string")
    assert [r.id for r in ordering.ordered(people, {k: f() for k, f in ordering.HARVEST_ORDERS.items()}, "nothing", "id").collect()] == [2, 3, 1]


def test_reasons_to_stay_out_of_a_pack(spark):
    good = {"kind": "state", "has_tokens": False, "text": "Well met.", "voiced": False, "sound": None, "speaker": 1, "excluded": False, "resolution": "single", "on_disk": True, "strref": 5}
    bad = [{}, {"kind": "token"}, {"has_tokens": True}, {"text": "***"}, {"text": None}, {"voiced": True, "sound": None}, {"voiced": True, "sound": "Z00001AB"}, {"speaker": None}, {"excluded": True}, {"resolution": "defer_diff_voice"}, {"on_disk": False}, {"strref": 10}, {"strref": -1}]
    df = spark.createDataFrame([tuple((good | b).values()) + (i,) for i, b in enumerate(bad)], "kind string, has_tokens boolean, text string, voiced boolean, sound string, speaker int, excluded boolean, resolution string, on_disk boolean, strref int, i int")
    reasons = predicates.export_reasons(10)
    got = [list(reasons).index(r[0]) if r[0] else None for r in df.orderBy("i").select(predicates.defer_reason(reasons)).collect()]
    assert got == [None, 0, 1, 2, 2, 3, None, 4, 5, 6, 7, 8, 8]


# ---- sources and runs


def test_files_and_corpora(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('[{"id": 1},\n {"id": 2}]')
    (tmp_path / "y.json").write_text('[{"id": 3}]')
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in tables.files_of(spark, str(tmp_path)).orderBy("path").collect()] == [("x.json", 23), ("y.json", 11)]
    assert rows(tables.read_json_batch(spark, str(tmp_path / "a"), "id int")) == [(1,), (2,)]
    paths = spark.createDataFrame([("en_us", "/e"), ("de_DE", "/d")], "locale string, path string")
    assert [tables.choose_locale(paths, x).first().path for x in ("DE_de", "fr_FR")] == ["/d", "/e"] and tables.choose_locale(paths.where("path = '/d'"), "fr_FR").first() is None
    voices = spark.range(4)
    lines = spark.range(20).select("id", (F.col("id") % 4).alias("voice_id"), F.when(F.col("id") % 2 == 0, "calm").otherwise("angry").alias("category"))
    assert tables.corpus_errors(voices, lines, ("calm", "angry")) == []
    assert tables.corpus_errors(voices.limit(3), lines.where("id > 0"), ("calm", "sad")) == ["3 voices, 4 needed", "19 lines, 20 needed", "no line of category sad", f"{lines.where('id > 0').join(voices.limit(3).select(F.col('id').alias('voice_id')), 'voice_id', 'left_anti').count()} lines of unknown voices"]
    stored = spark.createDataFrame([("k", "  "), ("l", " v ")], "key string, value string")
    assert [tables.setting(stored, k).first()[0] for k in "kl"] == [None, "v"]


def test_progress_and_tags(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(str(tmp_path / "in"))
    progress = incremental.Progress()
    spark.streams.addListener(progress)
    try:
        stream = incremental.read_stream(spark, str(tmp_path / "in"), spark.range(1), 1)
        query = stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        for _ in range(50):
            if sum(sum(x) for x in progress.rows.values()) == 30:
                break
            query.exception()
            spark.range(10_000).count()
    finally:
        spark.streams.removeListener(progress)
    assert sum(progress.rows[str(query.id)]) == 30
    with incremental.cancellable(spark, "scan"):
        assert "scan" in spark.getTags()
        assert spark.range(5).count() == 5
    assert "scan" not in spark.getTags()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_sessions_end_after_a_gap(spark, zone):
    events = spark.createDataFrame([("2024-01-01 00:00:00", 1), ("2024-01-01 00:29:59", 1), ("2024-01-01 00:59:59", 1), ("2024-01-01 01:30:00", 1), ("2024-01-01 00:10:00", 2)], "ts string, user_id int")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert sorted((r.user_id, r.n) for r in incremental.sessions(events).collect()) == [(1, 1), (1, 3), (2, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


# ---- larger tables


def oracle(spark, name, tables):
    """Rows of a query, and of its SQL, over tables given as frames."""
    import tempfile

    import duckdb

    import __spark_entry__

    folder, engine = tempfile.mkdtemp(prefix="run-", dir="/tmp"), duckdb.connect()
    for table, frame in tables.items():
        frame.write.parquet(f"{folder}/{table}.parquet")
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = __spark_entry__.queries()[name](spark, folder)
    want = engine.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=str), sorted(want, key=str)


def suppliers(spark, keys):
    return spark.createDataFrame([(k, f"Supplier#{k:09d}", k % 25) for k in keys], "s_suppkey long, s_name string, s_nationkey int")


def test_companions_meet_one_line_of_each_sound(spark):
    lines = spark.createDataFrame([("D1", "A", k) for k in range(3, 2003)] + [("d1", "a", None), ("D1", "B", None), ("d2", "a", 2), ("d2", " ", 1), ("d9", "a", 0)], "dialogue string, sound string, strref long")
    companions = spark.createDataFrame([(f"d{d}", c) for c in range(40) for d in (1, 2) if d == 1 or c < 2] + [("D1", 0)], "dialogue string, creature long")
    found = bindings.companion_sources(lines, companions)
    assert rows(found.select("creature", "sound", "strref", "dialogue")) == sorted([(c, "a", 2 if c < 2 else 3, "d2" if c < 2 else "d1") for c in range(40)] + [(c, "b", None, "d1") for c in range(40)])
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    lines = spark.createDataFrame([(k, k % 100, ("1-URGENT", "5-LOW")[k % 2]) for k in range(1000)], "o_orderkey long, o_custkey long, o_orderpriority string")
    got, want = oracle(spark, "companion_sources", {"orders": lines, "supplier": suppliers(spark, range(1, 120))})
    assert got == want and len(got) == 119


def test_names_of_large_keys(spark):
    keys = [0, 1, 35, 36, 1295, 1296, 1297, 46655, 46656, 60466175, 60466176, 60466177]
    got, want = oracle(spark, "names_and_keys", {"supplier": suppliers(spark, keys)})
    assert got == want and [r[3] for r in sorted(got)] == ["00000", "00001", "0000Z", "00010", "000ZZ", "00100", "00101", "00ZZZ", "01000", "ZZZZZ", "00000", "00001"]


def test_no_name_where_no_suffix_is_free(spark):
    got, want = oracle(spark, "unique_names", {"supplier": suppliers(spark, range(1, 5300)), "nation": spark.createDataFrame([(k,) for k in range(25)], "n_nationkey int")})
    assert got == want and sum(name is None for _, name in got) == 5299 - 4 * 1295
    lines, none = spark.createDataFrame([(7, k) for k in range(1300)], "strref long, id long"), spark.createDataFrame([], "name string")
    names = [r.name for r in hashing.unique_names(lines, none, order=["id"]).orderBy("id").collect()]
    assert names[0] == "Z0000700" and names[1295] == "Z00007ZZ" and names[1296:] == [None] * 4


def test_voices_of_large_pools_are_looked_up_by_place(spark):
    speakers = spark.createDataFrame([(k, k % 3, 0, 0, 0, None) for k in range(300)], "id long, sex long, race long, category long, class long, explicit long")
    pool = spark.createDataFrame([(0, 0, 0, list(range(1000, 6000))), (1, 0, 0, [])], "sex long, race long, category long, members array<long>")
    other = spark.createDataFrame([(0, 0, 0, [1]), (1, 0, 0, list(range(77)))], pool.schema)
    donors = spark.createDataFrame([(9, 2, 0, 0, 0)], "id long, sex long, race long, category long, class long")
    found = pipelines.assign_voices(speakers, pool, other, donors)

    def pick(members, speaker):
        salt = hashing.siphash([np.array([m], np.int64).view(np.uint64) for m in members])
        words = [np.array([w], np.int64).view(np.uint64) for w in (speaker, 1)]
        return members[int(hashing.siphash([*words, salt])[0] % np.uint64(len(members)))]

    got = {r.id: (r.source, r.profile, r.donor) for r in found.collect()}
    assert len(got) == 300 and {v[0] for v in got.values()} == {"profile", "pool", "fallback"}
    for k in range(0, 30, 3):
        assert got[k] == ("profile", pick(list(range(1000, 6000)), k), None)
        assert got[k + 1] == ("pool", None, pick(list(range(77)), k + 1))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "get(_profile" not in plan and "posexplode" in plan


def test_pairs_without_a_gap_meet_in_no_join_of_steps(spark, monkeypatch):
    from voxloom.operators import graph

    bound = spark.createDataFrame([(k, "follow" if k < 20 else "own", k + 1 if k < 20 else None) for k in range(21)], "speaker long, source string, follows long")
    pairs = spark.createDataFrame([(-1, k) for k in range(21)] + [(20 - k, 20 - 2 * k) for k in range(9)] + [(k, 20) for k in range(20)], "speaker long, target long")
    kept, real = [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df: kept.append(real(df)) or kept[-1])
    got = rows(graph.would_cycle(bound, pairs))
    longer = lambda t: 20 - t > 8
    assert got == sorted((s, t, s == t or longer(t) or 0 <= t <= s) for s, t in [tuple(r) for r in pairs.collect()])
    walked = [df.count() for df in kept if "gap" in df.columns]
    assert len(walked) == 5 and walked[0] == 50 and set(walked[1:]) == {4}
