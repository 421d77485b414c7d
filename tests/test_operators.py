import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from voxloom.functions import signal
from voxloom.operators import aggregates, bindings, graph, ordering, predicates, ranking, state
from voxloom.plans import pipelines
from voxloom.sources import binary, tables
from voxloom.streaming import incremental

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- batches


@pytest.mark.parametrize(("chars", "size", "budget", "want"), [([1] * 5, 2, 1000, [0, 0, 1, 1, 2]), ([60, 60, 30], 99, 100, [0, 1, 1]), ([50, 500, 40], 8, 100, [0, 1, 2])])
def test_packing(spark, chars, size, budget, want):
    jobs = spark.createDataFrame([(g, i, n) for g in "ab" for i, n in enumerate(chars)], "g string, i int, chars int")
    assert rows(aggregates.pack_batches(jobs, "g", ["i"], size, budget).select("g", "i", "batch")) == [(g, i, b) for g in "ab" for i, b in enumerate(want)]


# ---- follow chains


def test_follow_chains(spark):
    follow = lambda a, b: (a, "follow", b)
    data = [follow(1, 2), follow(2, 3), (3, "default", None), follow(4, 5), follow(5, 4), follow(6, 99), follow(7, None)] + [follow(i, i + 1) for i in range(20, 31)] + [(31, "override", None)]
    bindings = spark.createDataFrame(data, "speaker int, source string, follows int")
    got = {r.speaker: (r["at"], r.hops, r.status) for r in graph.effective(bindings).collect()}
    assert got[1] == (3, 2, "own") and got[3] == (3, 0, "own") and got[6] == (6, 0, "missing") and got[7] == (7, 0, "missing")
    assert got[4][1:] == (8, "cycle") and got[5][1:] == (8, "cycle") and got[20] == (28, 8, "depth") and got[23] == (31, 8, "own")
    pairs = spark.createDataFrame([(3, 1), (1, 3), (9, 9)], "speaker int, target int")
    assert rows(graph.would_cycle(bindings, pairs)) == [(1, 3, False), (3, 1, True), (9, 9, True)]


def resolved_plainly(table, speaker, most=8):
    """Hop by hop, with the list of those met."""
    seen, at = [], speaker
    for _ in range(most + 1):
        if at in seen:
            return "cycle"
        seen.append(at)
        if at not in table:
            return "missing"
        source, to = table[at]
        if source != "follow":
            return "own"
        if to is None:
            return "missing"
        at = to
    return "depth"


def refused_plainly(table, speaker, target, most=8):
    if speaker == target:
        return True
    seen, at = [speaker], target
    for _ in range(most + 1):
        if at in seen:
            return True
        seen.append(at)
        if at not in table or table[at][0] != "follow" or table[at][1] is None:
            return False
        at = table[at][1]
    return True


@pytest.mark.parametrize("seed", range(4))
def test_chains_match_a_walk_hop_by_hop(spark, seed):
    """Random graphs, sparse and dense, with long chains, long rings and tails that run into rings."""
    rng = random.Random(seed)
    n = 60
    table = {k: ("follow", rng.randrange(n + 5) if rng.random() < 0.95 else None) if rng.random() < (0.6, 0.9, 0.97, 1.0)[seed] else (rng.choice(["default", "override"]), None) for k in range(n)}
    table |= {k: ("follow", k + 1) for k in range(100, 130)} | {130: ("override", None)}
    table |= {k: ("follow", k + 1) for k in range(200, 220)} | {220: ("follow", 205)}
    table |= {300: ("follow", 301), 301: ("follow", 300), 302: ("follow", 301), 400: ("follow", 400)}
    bindings = spark.createDataFrame([(k, s, f) for k, (s, f) in table.items()], "speaker long, source string, follows long").repartition(3)
    got = {r.speaker: r for r in graph.effective(bindings).collect()}
    assert {k: r.status for k, r in got.items()} == {k: resolved_plainly(table, k) for k in table}
    for k, r in got.items():
        at = k
        for _ in range(r.hops):
            at = table[at][1]
        assert at == r["at"] and r.hops <= 8
    for most in (0, 1, 3, 5, 12):
        assert {r.speaker: r.status for r in graph.effective(bindings, most).collect()} == {k: resolved_plainly(table, k, most) for k in table} or most == 0
    pairs = [(rng.choice([*table, 900, 61, 62]), rng.choice([*table, 900])) for _ in range(300)] + [(k, table[k][1]) for k in table if table[k][1] is not None] + [(table[k][1], k) for k in table if table[k][1] is not None]
    pairs = sorted(set(pairs))
    refused = graph.would_cycle(bindings, spark.createDataFrame(pairs, "speaker long, target long")).collect()
    assert {(r.speaker, r.target): r.cycle for r in refused} == {p: refused_plainly(table, *p) for p in pairs}


def test_facts_of_rings_and_tails(spark):
    table = [(k, "follow", k + 1) for k in range(40)] + [(40, "follow", 10), (50, "follow", 50), (60, "follow", 61), (61, "default", None)]
    got = {r.speaker: (r["at"], r.hops, r.kind, r.ring) for r in graph.Chains(spark.createDataFrame(table, "speaker long, source string, follows long")).facts().collect()}
    assert got == {k: (max(k, 10), max(10 - k, 0), "ring", 31) for k in range(41)} | {50: (50, 0, "ring", 1), 60: (61, 1, "own", None), 61: (61, 0, "own", None)}


def test_several_follows_of_one_call_close_no_ring(spark):
    b = spark.createDataFrame([(1, "default", None), (2, "default", None), (3, "default", None), (4, "follow", 3)], "speaker long, source string, follows long")
    # 1 and 2 would close a ring and are refused; 3 and 5 only led into it
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (5, 3), (5, 4), (6, 77)], "speaker long, target long")
    got = {r.speaker: (r.source, r.follows) for r in bindings.follow(b, pairs).collect()}
    assert got == {1: ("default", None), 2: ("default", None), 3: ("follow", 1), 4: ("follow", 3), 5: ("follow", 3)}


def test_voice_changed(spark):
    c = F.col
    data = [(1, None, 1, None, True, "h", False), (1, None, 2, None, True, "h", True), (None, 5, None, 5, True, "h", False), (None, None, None, 5, True, "h", True), (1, None, 1, None, False, "h", True), (1, None, 1, None, True, None, True)]
    df = spark.createDataFrame(data, "sp int, ss int, p int, s int, ready boolean, h string, want boolean")
    assert df.where(graph.voice_changed(c("sp"), c("ss"), c("p"), c("s"), c("ready"), c("h")) != c("want")).count() == 0


# ---- state


def test_merge_is_idempotent_and_null_safe(spark):
    schema = "id int, key string, sub int, v string"
    old = spark.createDataFrame([(1, "a", None, "x"), (2, "b", 1, "y"), (3, "c", 1, "z")], schema)
    new = spark.createDataFrame([(10, "a", None, "x2"), (11, "b", 1, "y"), (12, "d", 1, "n")], schema)
    merged = state.merge(old, new, ["key", "sub"])
    assert rows(merged) == [(1, "a", None, "x2"), (2, "b", 1, "y"), (12, "d", 1, "n")]
    assert rows(state.merge(merged, merged, ["key", "sub"])) == rows(merged)
    assert rows(state.changes(old, new, ["key", "sub"], ["v"])) == [(1, 1, 1, 1)]
    assert len(rows(state.merge(old, new, ["key", "sub"], delete_missing=False))) == 4


def test_insert_new_and_json(spark):
    table = spark.createDataFrame([("Foo", 1)], "find string, n int")
    new = spark.createDataFrame([("foo", 2), ("bar", 3), ("BAR", 4)], "find string, n int")
    assert [r[0].lower() for r in state.insert_new(table, new, {"find": F.lower("find")}).collect()] == ["bar"]
    js = spark.createDataFrame([('{"a":1}',), ("bad",), (None,)], "j string")
    assert sorted(r[0] for r in js.select(state.set_json(F.col("j"), {"b": F.lit("x")}, "a int, b string")).collect()) == ['{"a":1,"b":"x"}', '{"b":"x"}', '{"b":"x"}']
    assert spark.range(1).select(state.replace_member(F.array(*map(F.lit, "abc")), F.lit("b"), F.lit("c"))).first()[0] == ["a", "c"]
    assert spark.range(1).select(state.replace_prefix(F.lit("/a/b"), "/a", "/z"), state.replace_prefix(F.lit("/ab"), "/a", "/z")).first()[:] == ("/z/b", "/ab")


# ---- predicates and orders


def test_predicates(spark):
    df = spark.createDataFrame([(1, "é", "a"), (2, "ab", None), (3, "abc", "b")], "id int, t string, f string")
    keep = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert keep(predicates.byte_length(F.col("t"), "2", "2")) == [1, 2]
    assert keep(predicates.byte_length(F.col("t"), "x", None)) == [1, 2, 3]
    assert keep(predicates.selected(F.col("f"), ["a"])) == [1] and keep(predicates.selected(F.col("f"), [])) == [1, 2, 3]
    assert keep(predicates.search(" B ", F.col("t"))) == [2, 3] and keep(predicates.search("", F.col("t"))) == [1, 2, 3]
    assert keep(predicates.utf16_length(F.col("t")) == 1) == [1]
    assert [r.id for r in ordering.page(df, [F.col("id").desc()], 1, 1).collect()] == [2]
    assert [r.f for r in ordering.options(df, "f").collect()] == ["a", "b"]


def test_ranking_ties(spark):
    df = spark.createDataFrame([("k", 3, 1.0), ("k", 2, 1.0), ("k", 1, 0.5)], "k string, id int, v double")
    assert ranking.best(df, ["k"], F.struct("v", -F.col("id"))).first().id == 2
    scores = spark.createDataFrame([("s", "m", 1), ("s", "f", 1), ("t", "m", 2), ("t", "f", 1)], "sound string, sex string, v int")
    assert rows(ranking.majority(scores, "sound", "sex", "v")) == [("t", "m")]


def test_pools_are_stable_and_spread(spark):
    speakers = spark.range(600).select("id", F.lit(1).alias("sex"), F.lit(1).alias("race"), F.lit(1).alias("category"), F.lit(None).cast("int").alias("explicit"))
    pools = spark.createDataFrame([(1, 1, 1, [7, 8, 9])], "sex int, race int, category int, members array<int>")
    donors = spark.createDataFrame([(50, 1, 2, 1, 0.5), (51, 1, 1, 2, 0.1), (52, 2, 1, 1, 0.9)], "id int, sex int, race int, category int, quality double")
    one = rows(pipelines.assign_pools(speakers, pools, donors))
    assert one == rows(pipelines.assign_pools(speakers.repartition(7), pools, donors))
    counts = [sum(v == m for _, v, _ in one) for m in (7, 8, 9)]
    assert min(counts) > 100 and sum(counts) == 600
    assert {r[1:] for r in rows(pipelines.assign_pools(speakers, pools.limit(0), donors))} == {(50, "fallback")}


# ---- bindings


def test_binding_rewrites(spark):
    b = spark.createDataFrame([(1, "override", None, 10, "ready"), (2, "generic", None, 11, "ready"), (3, "follow", 1, None, "ready"), (4, "override", None, 12, "ready")], "speaker int, source string, follows int, profile int, status string")
    members = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "speaker int, identity string")
    profiles = spark.createDataFrame([(10, "harvested", 4), (12, "imported", 9), (13, "harvested", 1)], "profile int, origin string, owner int")
    samples = spark.createDataFrame([(2, "pending")], "speaker int, decision string")
    stale = bindings.stale_personal(b, profiles, samples, members)
    assert rows(stale) == [(1, "a")]
    assert [r[0] for r in rows(bindings.clear_stale(b, stale, members).select("speaker"))] == [3, 4]
    assert {r.speaker: r.profile for r in bindings.repair_mismatched(b, profiles).collect()} == {1: 13, 2: 11, 3: None, 4: 12}
    assert {r.speaker: r.profile for r in bindings.sync_pool_voice(b, 11, 99).collect()}[2] == 99
    followed = bindings.follow(b, spark.createDataFrame([(1, 3), (2, 1), (4, 77)], "speaker int, target int"))
    assert {r.speaker: (r.source, r.follows) for r in followed.collect()} == {1: ("override", None), 2: ("follow", 1), 3: ("follow", 1), 4: ("override", None)}
    counts, left, pools = bindings.delete_profile(10, b, spark.createDataFrame([(1, [10, 11]), (2, [10])], "key int, members array<int>"))
    assert counts.first()[:] == (1, 2) and left.count() == 3 and rows(pools) == [(1, [11])]
    assert rows(bindings.has_personal(members, b)) == [("a",), ("c",)]


def test_reviews_and_overrides(spark):
    cache = spark.createDataFrame([("h1", 1, 1), ("h2", 2, 256), ("h3", 3, 16)], "text_hash string, first_id int, mask int")
    reviews = spark.createDataFrame([("h1",), ("h3",)], "text_hash string")
    none = spark.createDataFrame([], "text_hash string")
    assert rows(bindings.reconcile_reviews(reviews, cache, none, F.col("mask") == 16)) == [("h1",)]
    assert rows(bindings.review_plain(reviews, cache, F.col("mask") == 256)) == [("h1",), ("h2",), ("h3",)]
    texts = spark.createDataFrame([(1, "Hello there.", "[sigh] Hello there."), (2, "Hello there.", "Hello you."), (3, "Noooo way", "No way"), (4, "Hi", "--db x")], "first_id int, text string, override string")
    assert [(r.first_id, r.reason) for r in bindings.suspicious_overrides(texts, 0, 9).collect()] == [(2, "words differ"), (4, "command fragment")]


def test_companion_passes(spark):
    states = spark.createDataFrame([("BJAHEI", 0, 10, "a"), ("BJAHEI", 1, 11, "b"), ("OTHER", 0, 10, "c"), ("NONE", 0, 12, "d")], "dialogue string, state int, strref int, text string")
    creatures = spark.createDataFrame([("OTHER", "other", True, False), ("other2", "OTHER", True, True)], "name string, dialogue string, named boolean, voiced boolean")
    cells = spark.createDataFrame([("JAHEIRA", "FILE", "bjahei"), ("KHALID", "25FILE", "bjahei"), ("X", "FILE", "none")], "label string, column string, value string")
    lines, groups = pipelines.scan_attribution(states, creatures, cells, ["FILE", "25FILE"])
    assert sorted((r.dialogue, r.state, r.owner, r.confidence, r.origin) for r in lines.collect()) == [("bjahei", 0, "jaheira", 0.4, "companion"), ("bjahei", 1, "jaheira", 0.4, "companion"), ("other", 0, "OTHER", 0.4, "attributed")]
    assert [(r.strref, r.resolution) for r in groups.collect()] == [(10, "defer_diff_voice")]


# ---- signals


def test_levels_and_scores(spark):
    rate = 44_100
    voice = (0.2 * np.sin(2 * np.pi * 150 * np.arange(rate) / rate) * (0.55 + 0.45 * np.sin(2 * np.pi * 4 * np.arange(rate) / rate))).astype(np.float32)
    scream = (0.9 * np.sign(np.sin(2 * np.pi * 320 * np.arange(rate) / rate))).astype(np.float32)
    clips = [("half", [0.5] * rate), ("none", []), ("voice", voice.tolist()), ("scream", scream.tolist())]
    df = spark.createDataFrame([(n, s, rate, "dialogue_state", 1.0, "This is a fine and ordinary line of dialogue.") for n, s in clips], "name string, samples array<float>, rate int, origin string, attribution double, text string")
    got = {r.name: r for r in signal.score(signal.measure(df)).collect()}
    assert (got["half"].duration_secs, got["half"].rms, got["half"].peak, got["half"].silence_fraction) == (1.0, 0.5, 0.5, 0.0)
    assert (got["none"].duration_secs, got["none"].silence_fraction, got["none"].voiced_fraction) == (0.0, 1.0, -1.0)
    assert abs(got["voice"].pitch_hz - 150) < 3 and abs(got["scream"].pitch_hz - 320) < 8
    assert got["voice"].dynamic_range_db > 10 > got["scream"].dynamic_range_db
    assert got["voice"].scores.overall > got["scream"].scores.overall > got["none"].scores.overall
    by_origin = [signal.ORIGINS[k] for k in ("dialogue_state", "attribution_voiced", "companion_dialogue", "sound_slot")]
    assert by_origin == sorted(by_origin, reverse=True)


def test_composite(spark):
    clips = spark.createDataFrame([("g", i, s, i) for i, s in enumerate([5.0, 2.0, 4.5, 9.0])] + [("h", 9, 1.0, 0)], "g string, id int, seconds double, rank int")
    assert [(r.g, list(r.ids)) for r in signal.composite(clips, "g").collect()] == [("g", [0, 1])]


# ---- binary resources


def tlk(entries):
    table, texts = b"", b""
    for flags, text, sound in entries:
        raw = text.encode()
        table += struct.pack("<H8sIIII", flags, sound.encode(), 0, 0, len(texts), len(raw))
        texts += raw
    return b"TLK V1  " + struct.pack("<HII", 0, len(entries), 18 + len(table)) + table + texts


def test_binary_sources(spark, tmp_path):
    (tmp_path / "dialog.tlk").write_bytes(tlk([(3, "Héllo", "ABC01"), (1, "x", "DEF"), (2, "", "")]))
    (tmp_path / "bad.tlk").write_bytes(b"NOPE")
    (tmp_path / "short.tlk").write_bytes(b"TLK V1  " + struct.pack("<HII", 0, 99, 18))
    files = binary.read_files(spark, str(tmp_path))
    assert [tuple(r)[1:] for r in binary.scan_strings(files).orderBy("strref").collect()] == [(0, 3, "Héllo", "abc01"), (1, 1, "x", None), (2, 2, "", None)]
    assert binary.rejected(files, binary.decode_strings).count() == 2

    states = struct.pack("<4I", 7, 0, 1, 0xFFFFFFFF) + struct.pack("<4I", 0xFFFFFFFF, 1, 1, 0)
    edges = struct.pack("<5I8sI", 1, 9, 0, 0, 0, b"NEXT", 3) + struct.pack("<5I8sI", 8, 9, 0, 0, 0, b"NEXT", 3)
    dlg = tmp_path / "d"
    dlg.mkdir()
    (dlg / "a.dlg").write_bytes(b"DLG V1.0" + struct.pack("<4I", 2, 24, 2, 24 + len(states)) + states + edges)
    got = binary.scan_dialogues(binary.read_files(spark, str(dlg))).orderBy("kind", "index").collect()
    assert [(r.kind, r.text_strref, r.next_dlg, r.next_state) for r in got] == [("state", 7, None, None), ("state", None, None, None), ("transition", 9, "next", 3), ("transition", None, None, None)]

    cre = bytearray(0x2D4)
    cre[:8] = b"CRE V1.0"
    struct.pack_into("<2I", cre, 8, 12, 0xFFFFFFFF)
    struct.pack_into(">I", cre, 0x244, 0x4000)
    struct.pack_into("<3I", cre, 0xA4, 5, 0xFFFFFFFF, 6)
    cre[0x237], cre[0x2CC:0x2D4] = 2, b"BODHI\0\0\0"
    c = tmp_path / "c"
    c.mkdir()
    (c / "x.cre").write_bytes(bytes(cre))
    one = binary.scan_creatures(binary.read_files(spark, str(c))).first()
    assert (one.long_name_strref, one.short_name_strref, one.sex, one.kit, one.dialog_resref, list(one.sound_slots)) == (12, None, 2, 0x4000, "bodhi", [5, 6])


def test_archives_and_waves(spark, tmp_path):
    body = b"hello" + b"world!"
    at = 20 + 2 * 16
    bif = b"BIFFV1  " + struct.pack("<III", 2, 0, 20) + struct.pack("<IIIHH", 0, at, 5, 4, 0) + struct.pack("<IIIHH", 1 | 3 << 20, at + 5, 6, 4, 0) + body
    names = b"data\\one.bif\0"
    key = b"KEY V1  " + struct.pack("<4I", 1, 1, 24, 24 + 12 + len(names)) + struct.pack("<IIHH", len(bif), 36, len(names), 1) + names + struct.pack("<8sHI", b"VOICE1", 4, 1)
    (tmp_path / "chitin.key").write_bytes(key)
    (tmp_path / "one.bif").write_bytes(bif)
    k = binary.scan_key(binary.read_files(spark, str(tmp_path / "chitin.key"))).first()
    assert (k.resref, k.type, k.archive, k["at"].member) == ("voice1", 4, "data\\one.bif", 1)
    assert [(r.member, bytes(r.data)) for r in binary.read_members(binary.read_files(spark, str(tmp_path / "one.bif"))).orderBy("member").collect()] == [(0, b"hello"), (1, b"world!")]
    pcm = np.array([0, 16384, -32768], "<i2").tobytes()
    wav = b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 22050, 44100, 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm
    w = tmp_path / "w"
    w.mkdir()
    (w / "a.wav").write_bytes(wav)
    clip = binary.scan_waves(binary.read_files(spark, str(w))).first()
    assert clip.rate == 22050 and list(clip.samples) == [0.0, 0.5, -1.0]
    ogg = b"OggS" + bytes(22) + b"\x01\x1e" + b"\x01vorbis" + struct.pack("<IBI", 0, 1, 22050) + bytes(14)
    df = spark.createDataFrame([(ogg,), (b"OggS" + bytes(40),), (b"",)], "content binary")
    assert [r[0] for r in df.select(binary.valid_vorbis(F.col("content"))).collect()] == [True, False, False]


def test_tables_and_dictionaries(spark, tmp_path):
    (tmp_path / "t.2da").write_bytes(b"\xef\xbb\xbf2DA V1.0\r\n*\r\n  COL1 COL2\r\nROW1 a b\r\nROW2 c\r\n")
    cells = binary.scan_tables(binary.read_files(spark, str(tmp_path)))
    assert rows(cells.select("label", "column", "value")) == [("ROW1", "COL1", "a"), ("ROW1", "COL2", "b"), ("ROW2", "COL1", "c"), ("ROW2", "COL2", "*")]
    assert binary.cell(cells, "row2", "col1").first().value == "c"
    lines = spark.createDataFrame(list(enumerate(["IDS V1.0", "1 HUMAN // x", "0x10 ELF", "1 MAN", "junk"])), "line_no int, value string")
    ids = binary.scan_ids(lines)
    assert rows(ids) == [(1, "MAN"), (16, "ELF")]
    assert [r.race for r in binary.label_ids(spark.createDataFrame([(1,), (7,)], "r bigint"), ids, "r", "race").orderBy("r").collect()] == ["MAN", "#7"]
    a = spark.createDataFrame([("A", 1, b"x"), ("b", 1, b"y")], "resref string, type int, data binary")
    assert [(r.resref, bytes(r.data), r.origin) for r in binary.overlay(a, a.where("resref = 'A'").withColumn("data", F.lit(b"z"))).orderBy("resref").collect()] == [("a", b"z", "override"), ("b", b"y", "archive")]


def test_chunks_and_manifest(spark, tmp_path):
    docs = spark.range(1200).select("id", F.lit("x").alias("text"))
    tables.write_chunks(docs, str(tmp_path / "out"), "id", 500)
    assert tables.read_json_lines(spark, str(tmp_path / "out"), "id bigint, text string").count() == 1200
    assert all(sum(1 for _ in p.open()) <= 500 for p in (tmp_path / "out").glob("part-*"))
    lines = spark.createDataFrame([(1, "a~b\x01", "zab"), (2, "c", None)], "n int, t string, s string")
    assert [r[0] for r in lines.select(tables.string_lines(lines, "n", "t", "s")).collect()] == ["@1 = ~a%TILDE%b~ [ZAB]", "@2 = ~c~"]


# ---- streams


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = incremental.read_stream(spark, str(tmp_path / "in"), events, 1)
    incremental.append_new(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["event_id"]).awaitTermination()
    assert incremental.read_target(spark, str(tmp_path / "out"), events.schema).count() == events.select("event_id").distinct().count()
    query = incremental.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == events.count()


# ---- contract


def test_entry_and_queries(spark):
    assert __spark_entry__.entry(spark).count() > 0
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    for name in ("corpus_audit_flags", "clip_scores", "generation_plan", "follow_status", "assigned_pools"):
        assert queries[name](spark, SF).count() > 0
