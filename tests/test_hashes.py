import json
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions import hashing
from voxloom.plans import pipelines

MASK = (1 << 64) - 1


def plain_sip(words, c=1, d=3, k0=0, k1=0):
    """The published algorithm on Python's whole numbers."""
    v0, v1, v2, v3 = k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573
    left = lambda x, n: (x << n | x >> (64 - n)) & MASK

    def rounds(n):
        nonlocal v0, v1, v2, v3
        for _ in range(n):
            v0, v2 = v0 + v1 & MASK, v2 + v3 & MASK
            v1, v3 = left(v1, 13) ^ v0, left(v3, 16) ^ v2
            v0, v2 = left(v0, 32) + v3 & MASK, v2 + v1 & MASK
            v1, v3 = left(v1, 17) ^ v2, left(v3, 21) ^ v0
            v2 = left(v2, 32)

    for m in [*words, (8 * len(words) & 255) << 56]:
        v3 ^= m
        rounds(c)
        v0 ^= m
    v2 ^= 255
    rounds(d)
    return v0 ^ v1 ^ v2 ^ v3


def test_published_vectors():
    """Of SipHash-2-4 with key 00..0f over 0, 8 and 16 bytes 00, 01, ..."""
    keys = (0x0706050403020100, 0x0F0E0D0C0B0A0908)
    words = [0x0706050403020100, 0x0F0E0D0C0B0A0908]
    for n, want in ((0, 0x726FDB47DD0E0E31), (1, 0x93F5F5799A932462), (2, 0x3F2ACC7F57C29BDB)):
        got = hashing.siphash([np.full(3, w, np.uint64) for w in words[:n]], keys, (2, 4))
        assert all(int(x) == want for x in got) and plain_sip(words[:n], 2, 4, *keys) == want


def test_index_and_salt_bit_for_bit(spark):
    rng = random.Random(6)
    rows = [(k, rng.randrange(-5, 10**12), [rng.randrange(-(2**62), 2**62) for _ in range(rng.randrange(5))] if k % 9 else None) for k in range(200)]
    frame = spark.createDataFrame(rows, "k int, id long, members array<long>").withColumn("salt", hashing.sip_salt("members"))
    got = frame.withColumn("at", hashing.sip_index("id", F.lit(3).cast("bigint"), "salt", F.coalesce(F.size("members"), F.lit(0)))).collect()
    for r in got:
        salt = plain_sip([m & MASK for m in r.members or []])
        assert r.salt & MASK == salt
        assert r["at"] == (plain_sip([r.id & MASK, 3, salt]) % len(r.members) if r.members else None)


def test_canonical_json_is_that_of_sorted_keys(spark):
    inner = T.StructType([T.StructField("z", T.LongType()), T.StructField("a", T.StringType())])
    kind = T.StructType([T.StructField("b", T.ArrayType(inner)), T.StructField("Big", T.MapType(T.StringType(), inner)), T.StructField("a", T.DoubleType()), T.StructField("n", inner)])
    values = [{"b": [{"z": 1, "a": 'ü"\\'}, None], "Big": {"y": {"z": None, "a": "q"}, "x": None}, "a": 2.0, "n": None}, {"b": None, "Big": {}, "a": None, "n": {"z": 5, "a": None}}]
    frame = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("s", kind)]))
    got = [r[0] for r in frame.select(hashing.canonical_json(F.col("s"), kind)).collect()]
    assert got == [json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for v in values]
    text = spark.createDataFrame([('{"b": 1, "a": {"d": null, "c": [1, {"z": 0, "y": 1}]}}',), ("no json",)], "t string")
    assert [r[0] for r in text.select(hashing.canonical_text(F.col("t"))).collect()] == ['{"a":{"c":[1,{"y":1,"z":0}],"d":null},"b":1}', None]


def test_hashes_tell_nulls_apart(spark):
    row = spark.range(1).select(F.struct(F.lit(1).alias("a"), F.lit(2).alias("b")).alias("x"), F.struct(F.lit(2).alias("b"), F.lit(1).alias("a")).alias("y"), F.struct(F.lit(1).alias("a"), F.lit(2).alias("b"), F.lit(None).cast("int").alias("c")).alias("z"))
    x, y, z = row.select(*(hashing.settings_hash(F.col(c), row.schema[c].dataType) for c in "xyz")).first()
    assert x == y != z
    assert row.select(*(hashing.settings_hash(F.col(c)) for c in "xyz")).first()[:] == (x, y, z)


def test_voices_match_a_comparison_with_every_donor(spark):
    rng = random.Random(4)
    draw = lambda: tuple(rng.randrange(n) for n in (3, 4, 3, 3))  # noqa: E731  sex, race, category, class
    speakers = [(k, *draw(), -7 if k % 11 == 0 else None) for k in range(150)]
    donors = [(1000 + k, *draw()) for k in range(12)]
    profiles = {(s, 0, c): [50 + s, 60 + c] for s in range(3) for c in range(2)} | {(0, 1, 0): []}
    pools = {(s, 1, c): [1000, 1003, 1005 + c] for s in range(2) for c in range(3)}
    table = lambda t: spark.createDataFrame([(*k, m) for k, m in t.items()], "sex int, race int, category int, members array<long>")
    people = spark.createDataFrame(speakers, "id long, sex int, race int, category int, class int, explicit long")
    others = spark.createDataFrame(donors, "id long, sex int, race int, category int, class int")
    got = {r.id: tuple(r)[1:] for r in pipelines.assign_voices(people, table(profiles), table(pools), others, 9).collect()}
    pick = lambda i, members: members[plain_sip([i, 9, plain_sip(members)]) % len(members)]
    for i, sex, race, category, class_, own in speakers:
        key = (sex, race, category)
        if own is not None:
            want = ("override", own, None, None)
        elif profiles.get(key):
            want = ("profile", pick(i, profiles[key]), None, None)
        elif pools.get(key):
            want = ("pool", None, pick(i, pools[key]), None)
        else:
            score, low = max(((s == sex) * 8 + (c == category) * 4 + (r == race) * 2 + (k == class_), -d) for d, s, r, c, k in donors)
            want = ("fallback", None, -low, score)
        assert got[i] == want
    bare = pipelines.assign_voices(people, table(profiles), table(pools), others, 9, fallback=False).groupBy("source").count().collect()
    assert {r.source for r in bare} == {"override", "profile", "pool", "none"}
