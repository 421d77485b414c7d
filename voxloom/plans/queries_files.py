"""Queries that make binary files from tables and read them back, with SQL over what went in."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..cuts import checkpoint_folder
from ..functions import signal
from ..sources import binary, encode, ranges, tables
from .registry import query


def _folder(t, name: str) -> str:
    """A new folder in the shared one, which goes when the application ends."""
    path = f"{checkpoint_folder(t.spark)}/{name}-{uuid.uuid4().hex}"
    place = t.spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def _files(rows, path, content):
    """Rows as files: path, length and content, without a detour over a store."""
    return rows.select(path.alias("path"), content.alias("content")).withColumn("length", F.length("content").cast("bigint"))


NUMBERED = "SELECT 'f' || (doc_id // 500) || '.tlk' AS file, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) - 1 AS k, * FROM documents"


def numbered(t, extension: str):
    """Documents with file and number: a file holds the documents of 500 ids."""
    bucket = F.floor(F.col("doc_id") / 500)
    number = F.row_number().over(Window.partitionBy(bucket).orderBy("doc_id")) - 1
    return t.documents.select("*", F.concat(F.lit("f"), bucket.cast("string"), F.lit(extension)).alias("file"), number.cast("bigint").alias("k"))


@query(f"SELECT file, k AS strref, (CASE WHEN coalesce(text, '') <> '' THEN 1 ELSE 0 END + 2)::INT AS flags, left(source, 8) AS sound_resref, length(coalesce(text, ''))::INT AS chars, sha256(coalesce(text, '')) AS sha FROM ({NUMBERED})")
def strings_read_back(t):
    """String tables of all documents, written by file and read by ranges of 200 strings."""
    ranges.register(t.spark)
    path = _folder(t, "strings")
    flags = F.when(F.coalesce("text", F.lit("")) != "", 1).otherwise(0) + 2
    rows = numbered(t, ".tlk").select("file", F.col("k").alias("strref"), flags.alias("flags"), "text", F.upper(F.substring("source", 1, 8)).alias("sound_resref"))
    rows.repartition("file").sortWithinPartitions("file", "strref").write.format("voxloom_strings").mode("append").save(path)
    found = t.spark.read.format("voxloom_strings").option("entries", 200).load(path).where("reason IS NULL")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "strref", "flags", "sound_resref", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha"))


@query(f"SELECT replace(file, '.tlk', '.bif') AS file, k::INT AS member, CASE lang WHEN 'en' THEN 1011 WHEN 'fr' THEN 1009 ELSE 4 END AS type, octet_length(encode(coalesce(text, '')))::BIGINT AS size, sha256(coalesce(text, '')) AS sha FROM ({NUMBERED})")
def members_read_back(t):
    """Archives of all documents as members, written by file and read by ranges of 100 members."""
    ranges.register(t.spark)
    path = _folder(t, "members")
    extension = F.when(F.col("lang") == "en", "dlg").when(F.col("lang") == "fr", "cre").otherwise("wav")
    rows = numbered(t, ".bif").select("file", F.col("k").cast("int").alias("member"), binary.type_code(extension).alias("type"), F.col("text").cast("binary").alias("data"))
    rows.repartition("file").sortWithinPartitions("file", "member").write.format("voxloom_members").mode("append").save(path)
    found = t.spark.read.format("voxloom_members").option("entries", 100).load(path).where("reason IS NULL")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "member", "type", "size", F.sha2("data", 256).alias("sha"))


@query(
    "SELECT 'k' || s_nationkey AS path, 's' || s_suppkey AS resref, CASE WHEN s_suppkey % 2 = 0 THEN 1011 ELSE 4 END AS type, (s_suppkey % 3) * 1048576 + s_suppkey % 16384 AS locator, CASE s_suppkey % 3 WHEN 0 THEN 'data/one.bif' WHEN 1 THEN 'data/two.bif' END AS archive, (s_suppkey % 16384)::BIGINT AS file_index FROM supplier"
)
def key_index(t):
    """An index for each nation, of its suppliers as resources in two archives and one that is not there."""
    k = F.col("s_suppkey")
    kind = F.when(k % 2 == 0, 0x3F3).otherwise(4)
    place = F.concat(encode.padded(F.concat(F.lit("S"), k.cast("string")), 8), encode.little(kind, 2), encode.little((k % 3) * 1048576 + k % 16384, 4))
    rows = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("n"), encode.joined(F.sort_array(F.collect_list(place))).alias("places"))
    names = "data/one.bif\0data/two.bif\0"
    archive = lambda at: F.concat(encode.little(F.lit(7), 4), encode.little(F.lit(at), 4), encode.little(F.lit(13), 2), encode.little(F.lit(1), 2))
    head = F.concat(F.lit("KEY V1  ").cast("binary"), encode.little(F.lit(2), 4), encode.little(F.col("n"), 4), encode.little(F.lit(24), 4), encode.little(F.lit(48 + len(names)), 4))
    content = F.concat(head, archive(48), archive(48 + 13), F.lit(names).cast("binary"), F.col("places"))
    found = binary.scan_key(_files(rows, F.concat(F.lit("k"), F.col("s_nationkey").cast("string")), content))
    return found.select("path", "resref", "type", "locator", "archive", (F.col("locator") % 16384).alias("file_index"))


@query(
    "WITH l AS (SELECT 'o' || l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS i, l_partkey AS p, l_linenumber AS n, l_suppkey AS s FROM lineitem) "
    "SELECT path, 'state' AS kind, i::INT AS index, CASE WHEN p % 5 > 0 THEN p END AS text_strref, i::INT AS first, 1 AS count, NULL::BIGINT AS flags, NULL AS next_dlg, NULL::BIGINT AS next_state, n % 2 = 0 AS has_trigger FROM l "
    "UNION ALL SELECT path, 'transition', i::INT, CASE WHEN n % 2 = 1 THEN s END, NULL, NULL, (n % 2 + 8 * (p % 4 = 0)::INT)::BIGINT, CASE WHEN p % 4 <> 0 THEN 'd' || s END, CASE WHEN p % 4 <> 0 THEN n END, false FROM l"
)
def dialogue_records(t):
    """A dialogue for each order, a state and a transition for each of its lines."""
    n, p, s, none = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.lit(binary.NONE)
    first = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")) - 1
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", first.alias("i"))
    state = F.concat(encode.little(F.when(p % 5 > 0, p).otherwise(none), 4), encode.little(F.col("i"), 4), encode.little(F.lit(1), 4), encode.little(F.when(n % 2 == 0, 0).otherwise(none), 4))
    flags = n % 2 + F.when(p % 4 == 0, 8).otherwise(0)
    transition = F.concat(encode.little(flags, 4), encode.little(s, 4), encode.little(F.lit(0), 4), encode.little(none, 4), encode.little(none, 4), encode.padded(F.concat(F.lit("D"), s.cast("string")), 8), encode.little(n, 4))
    parts = lines.select("l_orderkey", "i", state.alias("state"), transition.alias("transition")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("i", "state", "transition"))).alias("x"))
    many = F.size("x")
    head = F.concat(F.lit("DLG V1.0").cast("binary"), encode.little(many, 4), encode.little(F.lit(24), 4), encode.little(many, 4), encode.little(24 + 16 * many, 4))
    content = F.concat(head, encode.joined(F.transform("x", lambda r: r["state"])), encode.joined(F.transform("x", lambda r: r["transition"])))
    return binary.scan_dialogues(_files(parts, F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), content))


@query(
    "SELECT 'c' || c_custkey AS path, c_custkey AS long_name_strref, CASE WHEN c_custkey % 3 > 0 THEN c_custkey + 1 END AS short_name_strref, (c_nationkey % 3)::INT AS sex, (c_nationkey % 7)::INT AS race, (c_custkey % 200)::INT AS class, (c_custkey * 65537 % 4294967296)::BIGINT AS kit, CASE WHEN c_nationkey > 0 THEN 'd' || c_nationkey END AS dialog_resref, "
    "CASE WHEN c_custkey % 2 = 0 THEN [c_custkey + 5, 9] ELSE [9] END AS sound_slots FROM customer"
)
def creature_records(t):
    """A creature record for each customer; customers are dealt first, as a small table is read by a task or two."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    customers = t.customer.select(k, n).repartition(k)
    number = lambda v, w=4: encode.little(v, w)
    none = F.lit(binary.NONE)
    kit = F.unhex(F.lpad(F.hex(k * 65537 % 4294967296), 8, "0"))
    content = encode.record(
        0x2D4,
        [
            (0, 8, F.lit("CRE V1.0").cast("binary")), (8, 4, number(k)), (0xC, 4, number(F.when(k % 3 > 0, k + 1).otherwise(none))),
            (0xA4, 4, number(F.when(k % 2 == 0, k + 5).otherwise(none))), (0xA8, 4, number(F.lit(9))), (0xAC, 4, number(none)),
            (0x237, 1, number(n % 3, 1)), (0x244, 4, kit), (0x272, 1, number(n % 7, 1)), (0x273, 1, number(k % 200, 1)),
            (0x2CC, 8, encode.padded(F.when(n > 0, F.concat(F.lit("D"), n.cast("string"))).otherwise(""), 8)),
        ],
    )
    found = binary.scan_creatures(_files(customers, F.concat(F.lit("c"), k.cast("string")), content))
    return found.select("path", "long_name_strref", "short_name_strref", "sex", "race", "class", "kit", "dialog_resref", "sound_slots")


@query(
    "WITH l AS (SELECT 'o' || l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS r, * FROM lineitem) SELECT path, r::INT AS row, 'L' || l_linenumber AS label, u.c AS column, CASE u.c WHEN 'PART' THEN l_partkey::VARCHAR WHEN 'SUPP' THEN l_suppkey::VARCHAR ELSE CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE '****' END END AS value FROM l, (VALUES ('PART'), ('SUPP'), ('FLAG')) u(c) WHERE u.c <> 'SUPP' OR r = 0"
)
def table_cells(t):
    """A white-space table for each order, with odd spaces, line ends and missing cells; one column by look-up of
    the label L1."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    line = F.concat(F.lit("L"), F.col("l_linenumber").cast("string"), F.lit("\t "), F.col("l_partkey").cast("string"), F.lit("   "), F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" "), F.col("l_returnflag"))).otherwise(""))
    rows = t.lineitem.select("l_orderkey", F.row_number().over(by).alias("i"), line.alias("line")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("i", "line"))).alias("x"))
    content = F.concat(F.lit("2da V1.0\r\n  ****\n\nPART SUPP FLAG\r"), F.array_join(F.transform("x", lambda r: r["line"]), "\r\n")).cast("binary")
    found = binary.scan_tables(_files(rows, F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), content))
    return found.where("`column` <> 'SUPP' OR row = 0")


@query(
    "WITH i AS (SELECT p_size AS id, max_by(p_brand || ' ' || p_type, p_partkey) AS label FROM part WHERE p_partkey % 4 < 3 AND p_size % 7 > 0 GROUP BY 1) SELECT p_partkey, coalesce(label, '#' || p_size) AS size_name FROM part LEFT JOIN i ON p_size = id"
)
def named_sizes(t):
    """Identifiers from lines in decimal or hexadecimal, with comments and lines that are none; the last stays."""
    p = t.part
    number = F.when(p.p_partkey % 2 == 0, F.concat(F.lit("0x"), F.hex("p_size"))).otherwise(F.col("p_size").cast("string"))
    told = F.concat(number, F.lit(" \t"), "p_brand", F.lit(" "), "p_type", F.lit(" // size"))
    value = F.when(p.p_partkey % 4 == 3, F.concat(F.lit("// "), told)).when(p.p_size % 7 == 0, F.concat(F.lit("IDS "), told)).otherwise(told)
    ids = binary.scan_ids(p.select(F.col("p_partkey").alias("line_no"), value.alias("value")))
    return binary.label_ids(p.select("p_partkey", F.col("p_size").cast("bigint").alias("p_size")), ids, "p_size", "size_name").select("p_partkey", "size_name")


@query(
    "WITH v AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 22050 WHEN 1 THEN 44100 ELSE 8000 END AS rate, [CAST(trunc(x::DOUBLE * 8000) AS BIGINT) FOR x IN embedding] AS s FROM embeddings) SELECT 'v' || vec_id AS path, rate, len(s)::INT AS n, list_sum(s)::BIGINT AS total, list_max([abs(x) FOR x IN s])::BIGINT AS peak, "
    "CASE WHEN rate <> 22050 THEN 'wrong sample rate' WHEN len(s) = 0 THEN 'no samples' WHEN len(s) / rate < 1.0 THEN 'too short' WHEN list_max([abs(x) FOR x IN s]) / 32768 < 0.02 THEN 'silent' END AS reason FROM v"
)
def wave_records(t):
    """A wave file for each vector, with a chunk that is skipped, read back and judged."""
    k = F.col("vec_id")
    rate = F.when(k % 3 == 0, 22050).when(k % 3 == 1, 44100).otherwise(8000)
    data = encode.joined(F.transform("embedding", lambda x: encode.signed16((x.cast("double") * 8000).cast("bigint"))))
    size = 2 * F.size("embedding")
    form = F.concat(encode.little(F.lit(1), 2), encode.little(F.lit(1), 2), encode.little(rate, 4), encode.little(rate * 2, 4), encode.little(F.lit(2), 2), encode.little(F.lit(16), 2))
    text = lambda s: F.lit(s).cast("binary")
    content = F.concat(text("RIFF"), encode.little(size + 46, 4), text("WAVEfmt "), encode.little(F.lit(16), 4), form, text("LIST"), encode.little(F.lit(1), 4), text("x\0"), text("data"), encode.little(size, 4), data)
    found = binary.scan_waves(_files(t.embeddings, F.concat(F.lit("v"), k.cast("string")), content))
    whole = F.transform("samples", lambda x: F.round(x.cast("double") * 32768).cast("bigint"))
    told = found.select("path", "rate", whole.alias("s"))
    peak = F.array_max(F.transform("s", F.abs))
    n = F.size("s")
    return told.select("path", "rate", n.alias("n"), F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), peak.alias("peak"), signal.rejected(F.col("rate"), n / F.col("rate"), peak / 32768).alias("reason"))


@query("SELECT e.event_id, user_id % 3 = 0 AND event_id % 4 > 0 AND event_id % 5 <> 1 AS valid FROM events e")
def vorbis_heads(t):
    """The first page of an Ogg file for each event, of other rates, channels and packets."""
    e = F.col("event_id")
    text = lambda s: F.lit(s).cast("binary")
    lacing = (e % 3).cast("int") + 1
    packet = F.concat(F.when(e % 4 > 0, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("03"))), text("vorbis"), encode.little(F.lit(0), 4), encode.little(F.when(e % 5 == 1, 2).otherwise(1), 1), encode.little(F.when(F.col("user_id") % 3 == 0, 22050).otherwise(44100), 4))
    content = F.concat(text("OggS"), F.unhex(F.lit("00" * 22)), encode.little(lacing, 1), F.unhex(F.repeat(F.lit("FF"), lacing)), packet, text("tail"))
    return t.events.select("event_id", binary.valid_vorbis(content).alias("valid"))


@query("SELECT c_custkey AS key, '@' || c_custkey || ' = ~' || c_name || '~' || CASE WHEN c_custkey % 3 = 0 THEN ' [' || upper(c_mktsegment) || ']' ELSE '' END AS line FROM customer")
def string_table_lines(t):
    """K09."""
    named = t.customer.withColumn("sound", F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")))
    return named.select(F.col("c_custkey").alias("key"), tables.string_lines(named, "c_custkey", "c_name", "sound").alias("line"))


@query("SELECT n_regionkey, '{\"n_regionkey\":' || n_regionkey || ',\"entries\":[' || string_agg('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || '}', ',' ORDER BY n_name) || ']}' AS manifest FROM nation GROUP BY 1")
def manifests(t):
    """K11."""
    return tables.manifest(t.nation.select("n_regionkey", "n_name", "n_nationkey"), "n_regionkey")
