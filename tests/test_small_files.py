import struct

import pyarrow as pa

import __spark_entry__
from voxloom.sources import binary


class Decoded:
    """Stands for a table of files; keeps the batches that a decoder makes of them."""

    def __init__(self, spark, files):
        self.sparkSession, self.files, self.made = spark, files, []

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        parts = [self.files[i : i + 100] for i in range(0, len(self.files), 100)]
        batches = [pa.RecordBatch.from_arrays([pa.array([p for p, _ in x]), pa.array([c for _, c in x], pa.binary())], ["path", "content"]) for x in parts]
        self.made = list(run(iter(batches)))
        return self

    def rows(self):
        return [tuple(r.values()) for b in self.made for r in b.to_pylist()]


def test_small_tables_share_a_batch(spark):
    files = [(f"p{k}", b"2DA V1.0\n**\nA B\n" + b"x 1\n" * (k % 3) if k % 7 else b"no") for k in range(1000)]
    found = binary.scan_tables(Decoded(spark, files))
    assert found.rows() == [(f"p{k}", i, "x", c, v) for k in range(1000) if k % 7 for i in range(k % 3) for c, v in (("A", "1"), ("B", "**"))]
    assert len(found.made) == 1
    large = binary.scan_tables(Decoded(spark, [("p", b"2DA V1.0\n**\nA B\n" + b"x 1 2\n" * 30_000)] * 2))
    assert len(large.rows()) == 120_000 and max(b.num_rows for b in large.made) == binary.BATCH_ROWS
    long = [("p", b"2DA V1.0\n**\nA\nx " + b"y" * binary.BATCH_BYTES)] * 3
    assert len(binary.scan_tables(Decoded(spark, long)).made) == 3


def test_small_dialogues_share_a_batch(spark):
    none = binary.NONE
    state, way = struct.pack("<4I", 5, 0, 1, none), struct.pack("<5I8sI", 3, 7, 0, none, none, b"D1\0x", 2)
    end = struct.pack("<5I8sI", 8, 7, 0, none, none, b"D1", 2)
    whole = struct.pack("<8s4I", b"DLG V1.0", 1, 24, 2, 40) + state + way + end
    cut = whole[:-1]  # its states are whole, but nothing of it counts
    found = binary.scan_dialogues(Decoded(spark, [("a", whole), ("b", cut)] * 300))
    rows = [("a", "state", 0, 5, 0, 1, None, None, None, False), ("a", "transition", 0, 7, None, None, 3, "d1", 2, True), ("a", "transition", 1, None, None, None, 8, None, None, False)]
    assert found.rows() == rows * 300 and len(found.made) == 1


def test_creatures_are_dealt_and_share_a_batch(spark, tmp_path):
    customers = spark.createDataFrame([(k, k % 25) for k in range(1, 2001)], "c_custkey long, c_nationkey int").coalesce(1)
    customers.write.parquet(str(tmp_path / "customer.parquet"))
    found = __spark_entry__.queries()["creature_records"](spark, str(tmp_path))
    assert "Exchange hashpartitioning(c_custkey" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.long_name_strref for r in found.select("long_name_strref").collect()) == list(range(1, 2001))
    raw = bytearray(0x2D4)
    raw[:8] = b"CRE V1.0"
    made = Decoded(spark, [(f"c{k}", bytes(raw)) for k in range(500)])
    assert len(binary.scan_creatures(made).rows()) == 500 and len(made.made) == 1
