"""Queries over tables' next versions, bindings, exports and rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import aggregates, bindings, ordering, predicates, state
from . import pipelines, writes
from .registry import query

def scan(t):
    """Speakers, lines and shared groups of a scan, from suppliers and orders."""
    speakers = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"), F.when(F.col("s_nationkey") == 3, "<CharName> ").otherwise(F.col("s_name")).alias("display_name"))
    o = t.orders
    lines = o.select(
        o.o_orderkey.alias("id"), F.when(o.o_orderkey % 3 == 0, o.o_orderkey % 5000).otherwise(-o.o_orderkey).alias("strref"), F.concat(F.lit("s"), (o.o_custkey % 120).cast("string")).alias("speaker"), (o.o_orderstatus == "F").alias("voiced"),
        F.when(o.o_custkey % 4 == 0, "Z00001AB").when(o.o_custkey % 4 == 1, "VOICE1").alias("sound"), (o.o_orderpriority == "5-LOW").alias("has_tokens"), (o.o_orderpriority != "1-URGENT").alias("text_spoken"),
        F.when(o.o_custkey % 3 == 0, 1.0).otherwise(0.4).alias("confidence"),
    )
    return speakers, lines, aggregates.shared_groups(lines, "strref", "speaker")


SCAN = """WITH l AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5000 ELSE -o_orderkey END AS strref, 's' || (o_custkey % 120) AS speaker, o_orderstatus = 'F' AS voiced, CASE o_custkey % 4 WHEN 0 THEN 'Z00001AB' WHEN 1 THEN 'VOICE1' END AS sound,
  o_orderpriority = '5-LOW' AS has_tokens, o_orderpriority <> '1-URGENT' AS spoken, CASE WHEN o_custkey % 3 = 0 THEN 1.0 ELSE 0.4 END AS confidence FROM orders),
g AS (SELECT strref, count(DISTINCT speaker) > 1 AS deferred FROM l GROUP BY 1 HAVING count(*) > 1),
s AS (SELECT 's' || s_suppkey AS name, s_nationkey = 3 AS player FROM supplier)"""


@query(SCAN + " SELECT id, CASE WHEN name IS NOT NULL AND NOT player THEN speaker END AS speaker, CASE WHEN coalesce(player, false) OR NOT spoken THEN 'skipped' WHEN name IS NOT NULL AND NOT player AND (NOT voiced OR coalesce(sound = 'Z00001AB', false)) AND NOT has_tokens AND NOT coalesce(deferred, false) THEN 'ready' ELSE 'blocked' END AS status FROM l LEFT JOIN g USING (strref) LEFT JOIN s ON speaker = name")
def written_attribution(t):
    """Lines of a scan as they are stored."""
    return writes.write_attribution(*scan(t))[1].select("id", "speaker", "status")


@query(SCAN + " SELECT id, lower(sound) AS sound FROM l LEFT JOIN g USING (strref) WHERE voiced AND sound IS NOT NULL AND confidence >= 1 AND sound <> 'Z00001AB' AND NOT coalesce(deferred, false) AND speaker IN (SELECT name FROM s WHERE NOT player)")
def gap_fill_voiced_lines(t):
    """F15, F13."""
    speakers, lines, groups = scan(t)
    stored = writes.write_attribution(speakers, lines, groups)[0]
    return writes.gap_fill_voiced(lines, groups, stored.select(F.col("name").alias("speaker"))).select("id", "sound")


def versions(t, mode: str):
    """What is stored of two projects, and a scan of the second that lacks some lines and has some new ones."""
    o = t.orders
    line = o.select((o.o_orderkey % 2 + 1).alias("project_id"), o.o_orderkey.alias("id"), o.o_custkey.alias("strref"), o.o_orderpriority.alias("dialogue"), o.o_orderkey.alias("state"), o.o_orderstatus.alias("text"))
    fresh = o.where("o_orderkey % 2 = 1 AND o_orderkey % 3 <> 0").select(F.lit(2).cast("bigint").alias("project_id"), (o.o_orderkey + 10_000_000).alias("id"), o.o_custkey.alias("strref"), o.o_orderpriority.alias("dialogue"), F.when(o.o_orderkey % 5 == 0, -o.o_orderkey).otherwise(o.o_orderkey).alias("state"), F.lit("new").alias("text"))
    speaker = t.supplier.select((F.col("s_suppkey") % 2 + 1).alias("project_id"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    profile = t.part.select((F.col("p_partkey") % 2 + 1).alias("project_id"), F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, "harvested").when(F.col("p_size") > 10, "imported").otherwise("designed").alias("origin"))
    pool = t.nation.select((F.col("n_nationkey") % 2 + 1).cast("bigint").alias("project_id"), F.col("n_nationkey").alias("id"))
    return writes.persist({"speaker": speaker, "line": line, "profile": profile, "pool": pool}, {"speaker": speaker.where("project_id = 2 AND id % 3 = 0"), "line": fresh}, 2, mode)


FRESH = "SELECT o_orderkey + 10000000 AS id, CASE WHEN o_orderkey % 5 = 0 THEN -o_orderkey ELSE o_orderkey END AS state FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 <> 0"


@query(f"WITH f AS ({FRESH}) SELECT o_orderkey AS id, o_orderkey AS state, o_orderstatus AS text FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT coalesce(o_orderkey, id), state, 'new' FROM f LEFT JOIN orders ON o_orderkey = state")
def merged_lines(t):
    """Lines of a merge; those of another project stay, known ones keep their ids."""
    return versions(t, "merge")["line"].select("id", "state", "text")


@query(f"SELECT 'line' AS kind, id FROM ({FRESH}) UNION ALL SELECT 'line', o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'speaker', s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 UNION ALL SELECT 'profile', p_partkey FROM part WHERE p_partkey % 2 = 0 OR p_size <= 25 UNION ALL SELECT 'pool', n_nationkey FROM nation WHERE n_nationkey % 2 = 0")
def wiped_tables(t):
    """What is left of four tables after a wipe of one project, and what the scan brings."""
    found = versions(t, "wipe")
    kinds = [found[k].select(F.lit(k).alias("kind"), F.col("id").cast("bigint").alias("id")) for k in ("line", "speaker", "profile", "pool")]
    return kinds[0].union(kinds[1]).union(kinds[2]).union(kinds[3])


def harvest_tables(t, preserve: bool, whole: bool):
    s = t.lineitem
    key = F.concat(F.lit("Snd"), (s.l_partkey % 300).cast("string"))
    old = s.where("l_linenumber <= 2").groupBy(s.l_suppkey.alias("speaker"), F.lower(key).alias("sound")).agg(F.max(F.when(s.l_returnflag == "R", "rejected").when(s.l_returnflag == "A", "approved").otherwise("pending")).alias("decision"))
    new = s.where("l_linenumber >= 2 AND l_suppkey % 3 <> 0").select(F.concat(F.lit("SUPPLIER#"), s.l_suppkey.cast("string")).alias("name"), key.alias("sound")).distinct()
    names = t.supplier.where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Supplier#"), F.col("s_suppkey").cast("string")).alias("name"))
    refs = s.where("l_linenumber = 1 AND l_tax < 0.02").select((s.l_orderkey % 1000).alias("binding"), s.l_suppkey.alias("speaker"), key.alias("sound")).distinct()
    return writes.persist_harvest(old, new, names, refs, preserve, whole)


HARVEST = """WITH old AS (SELECT l_suppkey AS speaker, 'snd' || (l_partkey % 300) AS sound, max(CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'approved' ELSE 'pending' END) AS decision FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2),
new AS (SELECT DISTINCT l_suppkey AS speaker, 'snd' || (l_partkey % 300) AS sound FROM lineitem WHERE l_linenumber >= 2 AND l_suppkey % 3 <> 0 AND l_suppkey % 7 <> 0),
refs AS (SELECT DISTINCT l_orderkey % 1000 AS binding, l_suppkey AS speaker, 'snd' || (l_partkey % 300) AS sound FROM lineitem WHERE l_linenumber = 1 AND l_tax < 0.02)"""


@query(HARVEST + ", held AS (SELECT DISTINCT speaker, sound, true AS held FROM refs) SELECT speaker, sound, CASE WHEN held THEN coalesce(decision, 'pending') ELSE 'pending' END AS decision FROM new LEFT JOIN old USING (speaker, sound) LEFT JOIN held USING (speaker, sound) UNION ALL SELECT speaker, sound, decision FROM old WHERE speaker NOT IN (SELECT speaker FROM new)")
def partial_harvest(t):
    """A partial harvest that resets decisions but for those that a binding refers to."""
    return harvest_tables(t, False, False)[0].select("speaker", "sound", "decision")


@query(HARVEST + " SELECT speaker, sound, coalesce(decision, 'pending') AS decision FROM new LEFT JOIN old USING (speaker, sound)")
def full_harvest(t):
    """A full harvest that carries decisions across by sound."""
    return harvest_tables(t, True, True)[0].select("speaker", "sound", "decision")


@query(HARVEST + " SELECT DISTINCT binding FROM refs ANTI JOIN new USING (speaker, sound)")
def lost_references(t):
    """Bindings that a full harvest leaves without a sample that they refer to."""
    return harvest_tables(t, True, True)[1]


SETTLED = """WITH x AS (SELECT o_orderkey AS k, o_custkey AS speaker, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 7 END AS strref, CASE WHEN o_orderkey % 11 > 0 THEN 's' || (o_orderkey % 3) END AS sound, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'approved' END AS decision, o_orderkey % 4 <> 1 AS filed FROM orders),
old AS (SELECT *, k AS id FROM x WHERE k % 2 = 0), new AS (SELECT *, k + 1000000 AS id FROM x WHERE k % 3 > 0 AND speaker % 5 > 0 AND decision = 'approved' AND filed),
ref AS (SELECT (speaker + k % 2) % 400 AS binding, k AS sample, max(k % 13) AS place FROM x WHERE k % 4 = 0 OR k % 4 = 3 GROUP BY 1, 2), b AS (SELECT c_custkey AS id, c_custkey AS speaker, CASE WHEN c_custkey % 3 > 0 THEN c_custkey * 2 END AS primary_, CASE c_custkey % 4 WHEN 0 THEN 'pending' ELSE 'ready' END AS status FROM customer),
gone AS (SELECT * FROM old WHERE {whole} OR speaker % 5 > 0 AND speaker IN (SELECT speaker FROM x WHERE k % 3 > 0)),
linked AS (SELECT binding, n.id AS sample, max(place) AS place FROM ref JOIN gone ON sample = gone.id JOIN (SELECT speaker, strref, sound, min(id) AS id FROM new GROUP BY ALL) n ON n.speaker = gone.speaker AND n.strref IS NOT DISTINCT FROM gone.strref AND n.sound IS NOT DISTINCT FROM gone.sound GROUP BY 1, 2),
fresh AS (SELECT binding, sample, place FROM ref WHERE sample NOT IN (SELECT id FROM gone) UNION ALL SELECT binding, sample, place FROM linked),
heads AS (SELECT binding, arg_min(sample, (place, sample)) AS head FROM fresh WHERE binding IN (SELECT binding FROM linked) GROUP BY 1)"""


def settled(t, whole):
    k = F.col("o_orderkey")
    x = t.orders.select(
        k.alias("id"), F.col("o_custkey").alias("speaker"), F.when(k % 5 > 0, k % 7).alias("strref"), F.when(k % 11 > 0, F.concat(F.lit("s"), (k % 3).cast("string"))).alias("sound"),
        F.when(F.col("o_orderstatus") == "O", "pending").otherwise("approved").alias("decision"), F.when(k % 4 != 1, "file").alias("path"),
    )
    brought = x.where("id % 3 > 0 AND speaker % 5 > 0")
    old, new = x.where("id % 2 = 0"), brought.withColumn("id", F.col("id") + 1_000_000)
    references = x.where("id % 4 = 0 OR id % 4 = 3").groupBy(((F.col("speaker") + F.col("id") % 2) % 400).alias("binding"), F.col("id").alias("sample")).agg(F.max(F.col("id") % 13).alias("place"))
    c = F.col("c_custkey")
    made = t.customer.select(c.alias("id"), c.alias("speaker"), F.when(c % 3 > 0, c * 2).alias("primary"), F.when(c % 4 == 0, "pending").otherwise("ready").alias("status"))
    clips = t.orders.select(k.alias("id"), (F.col("o_custkey") % 600).alias("binding"), F.lit("done").alias("status"), F.col("o_orderpriority").alias("fingerprint"))
    pools = t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("donor"))
    return writes.settle_harvest(old, new, made, references, clips, pools, brought.select("speaker"), whole)


@query(SETTLED.replace("{whole}", "true") + " SELECT binding, sample, place FROM fresh")
def linked_references(t):
    """References after a full harvest, linked anew by speaker, string and sound."""
    return settled(t, True)["reference"].select("binding", "sample", "place")


@query(SETTLED.replace("{whole}", "true") + " SELECT b.id, CASE WHEN head IS NOT NULL THEN head WHEN primary_ NOT IN (SELECT id FROM gone) THEN primary_ END AS head, CASE WHEN head IS NOT NULL OR coalesce(primary_ IN (SELECT id FROM gone), false) THEN 'pending' ELSE status END AS status FROM b LEFT JOIN heads ON b.id = heads.binding")
def pending_bindings(t):
    """Bindings after a full harvest."""
    return settled(t, True)["binding"].select("id", F.col("primary").alias("head"), "status")


@query(SETTLED.replace("{whole}", "false") + ", f AS (SELECT b.*, head, status <> 'pending' AND speaker % 5 > 0 AND speaker IN (SELECT speaker FROM x WHERE k % 3 > 0) OR coalesce(primary_ IN (SELECT id FROM gone), false) AS falls FROM b LEFT JOIN heads ON b.id = heads.binding) SELECT id, CASE WHEN head IS NOT NULL THEN head WHEN NOT falls THEN primary_ END AS head, CASE WHEN head IS NOT NULL OR falls THEN 'pending' ELSE status END AS status FROM f")
def pending_bindings_in_part(t):
    """Bindings after a partial harvest."""
    return settled(t, False)["binding"].select("id", F.col("primary").alias("head"), "status")


@query(SETTLED.replace("{whole}", "false") + " SELECT o_orderkey AS id, CASE WHEN heads.binding IS NULL THEN 'done' ELSE 'pending' END AS status, CASE WHEN heads.binding IS NULL THEN o_orderpriority END AS fingerprint FROM orders LEFT JOIN heads ON o_custkey % 600 = heads.binding")
def pending_generations(t):
    """Clips whose binding a partial harvest linked anew."""
    return settled(t, False)["generation"].select("id", "status", "fingerprint")


@query("SELECT c_custkey AS id, c_name AS manifest FROM customer UNION ALL SELECT max(c_custkey) + 1, '{\"lines\":' || (SELECT count(*) FROM orders) || '}' FROM customer")
def recorded_export(t):
    """An audit table with one row more."""
    exports = t.customer.select(F.col("c_custkey").alias("id"), F.lit(1).alias("project_id"), F.lit(2).alias("fingerprint_id"), F.col("c_name").alias("manifest"), F.lit("pack").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    n = t.orders.agg(F.count("*").alias("n")).scalar()  # a subquery: nothing runs while the plan is made
    return writes.record_export(exports, 1, 2, F.to_json(F.struct(n.alias("lines"))), "pack", F.lit("2024-01-02").cast("timestamp")).select("id", "manifest")


@query("WITH r AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN upper(n_name) ELSE lower(n_name) END AS find, CASE WHEN s_suppkey % 3 = 0 THEN 'tag' ELSE 'word' END AS kind, s_suppkey % 5 <> 0 AS enabled, s_suppkey % 4 = 0 AS own FROM supplier JOIN nation ON s_nationkey = n_nationkey), k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY lower(find), kind ORDER BY own DESC, id) = 1) SELECT id, find, kind, row_number() OVER (ORDER BY length(find) DESC, id)::INT AS place FROM k WHERE enabled")
def rules_in_force(t):
    """User rules shadow defaults, even those that are off; the longest first."""
    r = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    rules = r.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.upper("n_name")).otherwise(F.lower("n_name")).alias("find"), F.when(F.col("s_suppkey") % 3 == 0, "tag").otherwise("word").alias("kind"), F.lit("x").alias("speak_as"), (F.col("s_suppkey") % 5 != 0).alias("enabled"))
    return writes.enabled_rules(rules.where("id % 4 = 0"), rules.where("id % 4 <> 0")).select("id", "find", "kind", "place")


@query("SELECT n_name AS find, n_name || ' \"x\"' AS speak_as, CASE WHEN n_nationkey % 2 = 0 THEN 'tag' ELSE 'word' END AS kind, n_nationkey % 3 = 0 AS enabled FROM nation")
def rules_read_back(t):
    """Rules written as JSON and read again, among lines that are none."""
    n = F.col("n_nationkey")
    rules = t.nation.select(F.col("n_name").alias("find"), F.concat("n_name", F.lit(' "x"')).alias("speak_as"), F.when(n % 2 == 0, "tag").alias("kind"), (n % 3 == 0).alias("enabled"))
    return writes.import_rules(writes.export_rules(rules).union(t.region.select(F.lit("{").alias("value"))))


@query("WITH j AS (SELECT o_orderkey AS strref, CASE WHEN o_orderstatus = 'F' THEN 'already_voiced' WHEN o_orderpriority = '5-LOW' THEN 'stale' WHEN o_totalprice < 50000 THEN 'too_short' END AS reason FROM orders) SELECT strref, reason FROM j WHERE reason IS NOT NULL")
def deferred_lines(t):
    """Lines that wait, with the first reason that holds."""
    lines = t.orders.select(F.col("o_orderkey").alias("strref"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    reasons = {"already_voiced": F.col("o_orderstatus") == "F", "stale": F.col("o_orderpriority") == "5-LOW", "too_short": F.col("o_totalprice") < 50000}
    return pipelines.assemble(lines, t.region.select(F.lit("Z0000000").alias("name")), reasons)[1].select("strref", "reason")


BOUND = "WITH RECURSIVE b AS (SELECT s_suppkey AS speaker, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey > 0 THEN s_suppkey // 3 END AS follows FROM supplier), w AS (SELECT speaker, speaker AS here, follows FROM b UNION ALL SELECT w.speaker, b.speaker, b.follows FROM w JOIN b ON b.speaker = w.follows), v AS (SELECT speaker, here AS voice FROM (SELECT *, count(*) OVER (PARTITION BY speaker) AS n, row_number() OVER (PARTITION BY speaker ORDER BY CASE WHEN follows IS NULL OR follows NOT IN (SELECT speaker FROM b) THEN 0 ELSE 1 END) AS r FROM w) WHERE r = 1)"


def export_tables(t):
    o = t.orders
    generations = o.select((o.o_orderkey * 2).alias("generation"), o.o_orderkey.alias("line"), F.when(o.o_orderstatus != "P", "done").otherwise("queued").alias("status"))
    lines = o.select(o.o_orderkey.alias("id"), (o.o_custkey % 130).alias("speaker"), (o.o_orderkey % 4000).alias("strref"))
    s = F.col("s_suppkey")
    bound = t.supplier.select(s.alias("speaker"), F.when((s % 3 == 0) & (s > 0), "follow").otherwise("override").alias("source"), F.when((s % 3 == 0) & (s > 0), F.floor(s / 3)).alias("follows"))
    speakers = t.supplier.select(s.alias("id"), (F.col("s_nationkey") == 1).alias("excluded"))
    shared = aggregates.shared_groups(lines, "strref", "speaker")
    return generations, lines, speakers, bound, shared


@query(BOUND + ", l AS (SELECT o_orderkey, o_orderstatus, o_custkey % 130 AS speaker, o_orderkey % 4000 AS strref FROM orders), g AS (SELECT strref, CASE WHEN count(DISTINCT speaker) = 1 THEN 'reuse_same_voice' ELSE 'defer_diff_voice' END AS resolution FROM l GROUP BY 1 HAVING count(*) > 1) SELECT o_orderkey * 2 AS generation, voice, coalesce(s_nationkey = 1, false) AS excluded, coalesce(resolution, 'single') AS resolution FROM l LEFT JOIN v USING (speaker) LEFT JOIN supplier ON s_suppkey = l.speaker LEFT JOIN g ON g.strref = l.strref WHERE o_orderstatus <> 'P'")
def exportable_generations(t):
    """J02, J03, G01."""
    return bindings.export_candidates(*export_tables(t)).select("generation", "voice", "excluded", "resolution")


@query("SELECT s_suppkey AS speaker, max(l_orderkey * 10 + l_linenumber) AS sample, any_value(s_nationkey) AS race FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'A' GROUP BY 1")
def donors_with_samples(t):
    """J07, W07."""
    s = t.lineitem.select(F.col("l_suppkey").alias("speaker"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("overall"), F.when(F.col("l_returnflag") == "A", "approved").otherwise("pending").alias("decision"))
    return bindings.donor_pool(s, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("race")), ["race"]).select("speaker", "sample", "race")


@query("SELECT c_nationkey AS identity, sum(c_custkey)::BIGINT AS lines, count(*) AS variants, bool_and(c_acctbal < 0) AS excluded, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS names, max(shared) AS shares FROM customer LEFT JOIN (SELECT c_nationkey AS k, c_mktsegment AS m, count(DISTINCT c_custkey) > 1 AS shared FROM customer GROUP BY 1, 2) ON k = c_nationkey AND m = c_mktsegment GROUP BY 1")
def identity_rollups(t):
    """Totals of identities, and whether a value belongs to several members."""
    c = t.customer
    members = c.select(c.c_nationkey.alias("identity"), c.c_custkey.alias("lines"), F.lit(1).alias("approved"), F.lit(2).alias("samples"), (c.c_acctbal < 0).alias("excluded"), c.c_mktsegment.alias("name"))
    rolled = aggregates.group_rollup(members, "identity")
    shares = aggregates.shared_by_members(c, "c_nationkey", "c_custkey", "c_mktsegment").withColumnRenamed("c_nationkey", "identity")
    return rolled.join(shares, "identity", "left").select("identity", "lines", "variants", "excluded", F.array_join("names", ",").alias("names"), "shares")


@query("SELECT count(*) AS identities, sum(n)::BIGINT AS lines, count(*) FILTER (low < -900) AS bound, count(*) FILTER (NOT low < -900 AND n > 0) AS unbound FROM (SELECT c_nationkey, count(*) AS n, min(c_acctbal) AS low FROM customer GROUP BY 1)")
def identity_sums(t):
    """V04."""
    return bindings.identity_totals(t.customer.groupBy("c_nationkey").agg(F.count("*").alias("lines"), (F.min("c_acctbal") < -900).alias("bound")))


@query("SELECT s_suppkey AS id FROM supplier WHERE (s_nationkey <> 0 AND s_nationkey || ':' || (s_suppkey % 3) IN (SELECT n_nationkey || ':' || (n_nationkey % 3) FROM nation WHERE n_nationkey < 12)) OR (s_nationkey <> 0 AND s_nationkey IN (13, 14)) OR s_suppkey IN (SELECT n_nationkey FROM nation)")
def expanded_identities(t):
    """Members of identity keys in all their forms."""
    n = F.col("n_nationkey").cast("string")
    keys = t.nation.where("n_nationkey < 12").select(F.concat_ws(":", n, (F.col("n_nationkey") % 3).cast("string")).alias("key")).union(t.nation.where("n_nationkey IN (13, 14)").select(n)).union(t.nation.select(F.concat(F.lit("ungrouped:"), n)))
    members = t.supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") != 0, F.col("s_nationkey")).alias("name_id"), (F.col("s_suppkey") % 3).alias("sex"))
    return predicates.expand_identities(keys, members)


@query("WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS id, lower(l_shipmode) AS sound FROM (SELECT *, 'S' || (l_partkey % 400) AS l_shipmode FROM lineitem)), o AS (SELECT 's' || (l_partkey % 400) AS sound, count(DISTINCT l_suppkey % 3) AS owners FROM lineitem GROUP BY 1) SELECT id, CASE WHEN owners > 1 THEN 'manual_only' ELSE 'automatic' END AS eligibility, CASE WHEN owners > 1 THEN owners END AS shared, CASE WHEN owners > 1 THEN 1 END AS reason, 'slot' AS origin FROM s JOIN o USING (sound)")
def demoted_samples(t):
    """Automatic samples of sounds with several owners."""
    s = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("S"), (F.col("l_partkey") % 400).cast("string")).alias("sound"), F.lit('{"origin": "slot"}').alias("provenance"))
    owners = pipelines.sound_owners(t.lineitem.select(F.concat(F.lit("S"), (F.col("l_partkey") % 400).cast("string")).alias("sound"), (F.col("l_suppkey") % 3).alias("identity")))
    out = bindings.demote_conflicts(s, owners, "origin string, eligibility string, shared_source_count bigint")
    reasons = owners.select(F.col("sound").alias("_s"), predicates.cross_identity_reason(F.col("owners"), F.lit("own"), F.array(F.lit("foreign")), text.stem(F.col("sound"))).alias("reason"))
    joined = out.join(reasons, F.lower("sound") == F.col("_s"))
    return joined.select("id", hashing.json_field(F.col("provenance"), "$.eligibility", "automatic").alias("eligibility"), hashing.json_field(F.col("provenance"), "$.shared_source_count").cast("bigint").alias("shared"), "reason", predicates.provenance_origin(F.col("provenance")).alias("origin"))


@query("WITH m AS (SELECT c_custkey AS speaker, c_nationkey AS identity FROM customer), lead AS (SELECT speaker, identity FROM m WHERE speaker <= 10 QUALIFY row_number() OVER (PARTITION BY identity ORDER BY speaker) = 1) SELECT m.speaker, CASE WHEN lead.speaker IS NULL THEN 'generic' ELSE 'override' END AS source, CASE WHEN lead.speaker IS NULL THEN m.speaker ELSE lead.speaker + 1000 END AS profile FROM m LEFT JOIN lead USING (identity) WHERE lead.speaker IS NOT NULL OR m.speaker % 2 = 0")
def propagated_bindings(t):
    """leaders' bindings for all of their groups."""
    members = t.customer.select(F.col("c_custkey").alias("speaker"), F.col("c_nationkey").alias("identity"))
    lead = members.where("speaker <= 10").groupBy("identity").agg(F.min("speaker").alias("speaker")).select("speaker", F.lit("override").alias("source"), (F.col("speaker") + 1000).alias("profile"))
    there = members.where("speaker % 2 = 0").select("speaker", F.lit("generic").alias("source"), F.col("speaker").alias("profile"))
    return bindings.propagate(there, lead, members)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' OR o_orderkey % 7 IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 3) THEN 'done' ELSE 'failed' END AS status FROM orders")
def recovered_generations(t):
    """Generations whose file is there are done."""
    path = F.concat(F.lit("out/"), (F.col("o_orderkey") % 7).cast("string"))
    generations = t.orders.select(F.col("o_orderkey").alias("id"), path.alias("output_path"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("failed").alias("status"))
    files = t.nation.where("n_nationkey < 3").select(F.concat(F.lit("out/"), F.col("n_nationkey").cast("string")).alias("path"))
    return bindings.recover_files(generations, files).select("id", "status")


@query("SELECT l_suppkey AS binding, sha256(string_agg((l_orderkey * 10 + l_linenumber) || chr(1) || l_linestatus || chr(1) || sha256(l_returnflag), chr(2) ORDER BY l_linenumber, l_orderkey * 10 + l_linenumber, l_linestatus, sha256(l_returnflag))) AS fingerprint, count(*)::INT AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1")
def reference_fingerprints(t):
    """Ordered members of bindings and what they are made of."""
    s = t.lineitem
    rows = s.select(s.l_suppkey.alias("binding"), s.l_linenumber.alias("sort_order"), (s.l_orderkey * 10 + s.l_linenumber).alias("id"), s.l_linestatus.alias("text"), s.l_returnflag.cast("binary").alias("content"), F.when(s.l_quantity > 40, "approved").otherwise("pending").alias("decision"))
    return bindings.references(rows).select("binding", "fingerprint", F.size("ids").alias("n"))


@query(r"WITH o AS (SELECT min(doc_id) AS doc_id, sha256(trim(text, E' \n\t\r')) AS h FROM documents GROUP BY 2), k AS (SELECT h, doc_id FROM o WHERE doc_id % 3 = 0) SELECT d.doc_id, CASE WHEN k.h IS NULL THEN 'mapped' ELSE 'override' END AS source, CASE WHEN k.h IS NULL THEN NULL ELSE 'stored ' || k.doc_id END AS stored FROM documents d LEFT JOIN k ON sha256(trim(d.text, E' \n\t\r')) = k.h")
def effective_sources(t):
    """Texts that an override replaces, by the hash of the text."""
    first = t.documents.groupBy(hashing.text_hash(F.col("text")).alias("text_hash")).agg(F.min("doc_id").alias("id")).where("id % 3 = 0")
    overrides = first.select("text_hash", F.concat(F.lit("stored "), F.col("id").cast("string")).alias("text"))
    found = pipelines.effective_texts(t.documents.select("doc_id", "text"), overrides, [("the", "thee")])
    return found.select("doc_id", "source", F.when(F.col("source") == "override", F.col("spoken")).alias("stored"))


@query(r"SELECT o_orderkey AS id, o_orderstatus = 'O' OR o_custkey % 2 = 0 AS stale FROM orders")
def reset_generations(t):
    """Generations of a project's lines are stale."""
    lines = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 2).alias("project_id"), F.col("c_name").alias("text"))
    generations = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("line_id"), (F.col("o_orderstatus") == "O").alias("stale"))
    overrides = t.customer.select(hashing.text_hash(F.col("c_name")).alias("text_hash"))
    return pipelines.reset_agent_state(overrides, generations, lines.where(predicates.in_project(0)), 0)[1].select("id", "stale")


@query("SELECT 'override' AS kind, count(*) AS n FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'reviewed', count(*) FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'left', count(*) FROM customer WHERE c_custkey % 3 = 0 OR c_acctbal < 0")
def imported_rows(t):
    """An import split by blank texts, and what a resumed job still has to do."""
    rows = t.customer.select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name")).alias("text"))
    overrides, reviewed = state.split_import(rows)
    done = overrides.where("c_acctbal >= 0")
    counted = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return counted(overrides, "override").union(counted(reviewed, "reviewed")).union(counted(state.resume(rows, done, ["c_custkey", "text"]), "left"))


@query("WITH refs AS (SELECT l_orderkey AS k, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_linenumber, l_suppkey) AS r FROM lineitem GROUP BY 1), p AS (SELECT r, min(k) AS profile FROM refs WHERE k % 2 = 0 GROUP BY 1) SELECT k AS key, profile FROM refs LEFT JOIN p USING (r)")
def profiles_with_same_references(t):
    """The least profile with the same ordered references."""
    refs = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("refs"))
    return pipelines.same_references(refs.where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("profile"), "refs"), refs.select(F.col("l_orderkey").alias("key"), "refs"))


@query("SELECT c_custkey AS id, c_custkey % 4 AS flags, c_custkey % 65536 AS little, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'own' END, CASE WHEN c_custkey % 3 = 0 THEN 'group' END, 'all') AS preset FROM customer")
def decoded_fields(t):
    """Counts in JSON, integers in bytes, settings of the first layer that states one."""
    k = F.col("c_custkey")
    flags = F.to_json(F.struct(F.array_repeat(F.lit("x"), (k % 4).cast("int")).alias("flags")))
    raw = F.unhex(F.lpad(F.hex(k), 8, "0"))
    own, group, all_ = (F.struct(v.alias("preset")).alias(n) for n, v in (("own", F.when(k % 2 == 0, "own")), ("grp", F.when(k % 3 == 0, "group")), ("every", F.lit("all"))))
    layered = t.customer.select(k.alias("id"), flags.alias("json"), raw.alias("raw"), own, group, all_)
    return layered.select("id", hashing.flag_count(F.col("json")).cast("bigint").alias("flags"), hashing.unsigned(F.col("raw"), 2, 2, big_endian=True).alias("little"), *hashing.merge_settings(["preset"], "own", "grp", "every"))


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'pack' WHEN c_custkey % 2 = 0 THEN 'game' ELSE 'none' END AS audio, c_acctbal >= 0 OR c_custkey % 3 = 0 AS wanted, lower(c_mktsegment) <> 'building' AS usable, c_mktsegment || ' (' || c_custkey || ')' AS label, starts_with(c_mktsegment, 'MACHINE') OR starts_with(c_mktsegment, 'FUR') AS prefixed, regexp_full_match(c_mktsegment, '[A-Z]+') AS token FROM customer")
def judged_rows(t):
    """F07, F08, F09, B18, T02, T47, T49."""
    k = F.col("c_custkey")
    generated, segment = F.col("c_acctbal") < 0, F.col("c_mktsegment")
    facets = predicates.render_facets(generated, k % 3 == 0, F.lit(False))
    named = F.when(segment == "BUILDING", " None ").otherwise(segment)
    return t.customer.where(predicates.passes_speakable(F.lit("ready"), segment)).select(
        k.alias("id"), predicates.pack_audio(k % 2 == 0, generated).alias("audio"), predicates.has_facet(facets, ["missing", "voice_changed"]).alias("wanted"), predicates.usable_dialogue(named).alias("usable"),
        text.option_label(segment, k).alias("label"), text.shares_prefix(segment, F.array(F.lit("MACHINE"), F.lit("FUR"))).alias("prefixed"), text.is_token_name(segment).alias("token"),
    )


@query("SELECT p_partkey AS id FROM part WHERE lower(p_name) LIKE '%1%' OR lower(p_brand) LIKE '%1%'")
def found_rules(t):
    """Rules that hold a query in one of the fields."""
    rules = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("find"), F.col("p_brand").alias("speak_as"), (F.col("p_size") > 9).alias("enabled"))
    return bindings.rule_search(rules, " 1 ", ["find", "speak_as"], "enabled").select("id")


@query("SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_nationkey = 2, s_suppkey)::INT AS place FROM supplier")
def library_places(t):
    """Harvested voices last."""
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("name").alias("name"), F.when(F.col("s_nationkey") == 2, "harvested").otherwise("imported").alias("origin"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(*ordering.library_order()))).select("id", "place")
