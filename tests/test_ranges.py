import struct

import pytest
from pyspark.sql import functions as F

from voxloom.sources import binary, ranges


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Three string tables of 0, 1 and 1,000 strings, and one that is none."""
    ranges.register(spark)
    folder = tmp_path_factory.mktemp("strings")
    rows = [("b.tlk", 0, 1, "only ü", None)] + [("c.tlk", k, 3 if k % 3 else 1, f"text {k} " * (k % 7) + "äß", "SOUND" + str(k % 9) if k % 2 else None) for k in range(1000)]
    frame = spark.createDataFrame(rows, "file string, strref long, flags int, text string, sound_resref string")
    frame.repartition("file").sortWithinPartitions("file", "strref").write.format("voxloom_strings").mode("append").save(str(folder))
    (folder / "a.tlk").write_bytes(struct.pack("<8sHII", b"TLK V1  ", 0, 0, 18))
    (folder / "d.tlk").write_bytes(b"no such thing")
    (folder / "_hidden").write_bytes(b"x")
    return folder


def test_strings_equal_the_decoder_over_several_partitions(spark, tables):
    got = spark.read.format("voxloom_strings").option("entries", 300).load(str(tables))
    assert got.rdd.getNumPartitions() == 6  # four of c, one of b, and the rejected file
    good = got.where("reason IS NULL").select(F.element_at(F.split("path", "/"), -1).alias("file"), "strref", "flags", "text", "sound_resref")
    want = binary.scan_strings(binary.read_files(spark, str(tables / "*.tlk"))).select(F.element_at(F.split("path", "/"), -1).alias("file"), "strref", "flags", "text", "sound_resref")
    assert sorted(map(tuple, good.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and good.count() == 1001
    bad = got.where("reason IS NOT NULL").collect()
    assert len(bad) == 1 and bad[0].path.endswith("d.tlk") and "signature" in bad[0].reason and bad[0].strref is None


def test_comparisons_narrow_the_ranges(spark, tables):
    read = lambda: spark.read.format("voxloom_strings").option("entries", 100).load(str(tables / "c.tlk"))
    some = read().where("strref >= 250 AND strref < 320")
    assert [r.strref for r in some.select("strref").orderBy("strref").collect()] == list(range(250, 320))
    assert some.rdd.getNumPartitions() == 1 and read().rdd.getNumPartitions() == 10
    assert [r.text for r in read().where("strref = 7").collect()] == ["äß"] and read().where("strref > 5000").count() == 0


def test_strings_beyond_the_file_are_told(spark, tmp_path):
    ranges.register(spark)
    entries = struct.pack("<H8sIIII", 1, b"", 0, 0, 0, 3) + struct.pack("<H8sIIII", 1, b"", 0, 0, 1, 99)
    (tmp_path / "x.tlk").write_bytes(struct.pack("<8sHII", b"TLK V1  ", 0, 2, 70) + entries + b"abc")
    (tmp_path / "y.tlk").write_bytes(struct.pack("<8sHII", b"TLK V1  ", 0, 9, 70) + entries)
    got = {(r.path[-5], r.strref): (r.text, r.reason) for r in spark.read.format("voxloom_strings").load(str(tmp_path)).collect()}
    assert got == {("x", 0): ("abc", None), ("x", 1): (None, "string data exceeds the file"), ("y", None): (None, "table exceeds the file")}


def test_members_are_read_by_range(spark, tmp_path, monkeypatch):
    ranges.register(spark)
    rows = [("a.bif", k, 0x3F3 + k % 2, bytes([k % 256]) * (k * 37 % 500)) for k in range(500)] + [("b.bif", 9, 1, None)]
    spark.createDataFrame(rows, "file string, member int, type int, data binary").repartition("file").sortWithinPartitions("file", "member").write.format("voxloom_members").mode("append").save(str(tmp_path / "x"))
    got = spark.read.format("voxloom_members").option("entries", 150).load(str(tmp_path / "x"))
    assert got.rdd.getNumPartitions() == 5
    assert sorted((r.path[-5:], r.member, r.type, bytes(r.data)) for r in got.collect()) == [(f, m, t, d or b"") for f, m, t, d in rows]
    want = binary.read_members(binary.read_files(spark, str(tmp_path / "x")))
    assert sorted((r.path[-5:], r.member, r.offset, r.size, bytes(r.data)) for r in want.collect()) == sorted((r.path[-5:], r.member, r.offset, r.size, bytes(r.data)) for r in got.collect())
    bare = spark.read.format("voxloom_members").option("data", "false").load(str(tmp_path / "x"))
    assert bare.where("data IS NOT NULL").count() == 0 and bare.agg(F.sum("size")).first()[0] == sum(len(d or b"") for *_, d in rows)
    (tmp_path / "x" / "c.bif").write_bytes(b"BIFFV1  " + struct.pack("<III", 1, 0, 20) + struct.pack("<IIIHH", 3, 30, 1000, 1, 0))
    late = got.where("reason IS NOT NULL").collect()
    assert [(r.member, r.data, r.reason) for r in late] == [(3, None, "data exceeds the file")]


def test_overwriting_and_files_split_over_tasks(spark, tmp_path):
    ranges.register(spark)
    rows = lambda n: spark.createDataFrame([("a.tlk", k, 1, str(k), None) for k in range(n)], "file string, strref long, flags int, text string, sound_resref string")
    for n in (5, 3):
        rows(n).coalesce(1).sortWithinPartitions("strref").write.format("voxloom_strings").mode("overwrite").save(str(tmp_path))
        assert spark.read.format("voxloom_strings").load(str(tmp_path)).count() == n
    with pytest.raises(Exception, match="in place|several tasks"):
        rows(8).repartition(4).sortWithinPartitions("strref").write.format("voxloom_strings").mode("append").save(str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir() if p.name[0] not in "._") == ["a.tlk"]
