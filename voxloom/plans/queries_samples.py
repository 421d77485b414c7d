"""Queries over arrays of numbers, batches and pools: measurements, scores, packing and assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal
from ..operators import aggregates, ranking
from . import pipelines
from .registry import query


def clips(t):
    return t.embeddings.select("vec_id", F.col("embedding").alias("samples"), F.lit(400).alias("rate"), "label")


@query("SELECT vec_id, len(embedding) / 400 AS duration_secs, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 6) AS rms, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS peak, len(list_filter(embedding, lambda x: abs(x) < 0.005::FLOAT)) / len(embedding) AS silence_fraction FROM embeddings")
def clip_levels(t):
    """M01."""
    found = clips(t).select("vec_id", *signal.level(F.col("samples"), F.col("rate")))
    return found.select("vec_id", "duration_secs", F.round("rms", 6).alias("rms"), "peak", "silence_fraction")


@query()
def clip_scores(t):
    """All measurements and the overall score; checked against numpy and hand-made clips in the tests."""
    told = clips(t).select("*", F.lit("dialogue_state").alias("origin"), F.lit(1.0).alias("attribution"), F.lit("This is a fine and ordinary line of dialogue.").alias("text"))
    return signal.score(signal.measure(told)).select("vec_id", "scores.overall", "scores.duration", "scores.loudness", "scores.pitch")


@query("SELECT event_id, CASE WHEN v >= 0.4 THEN 1.0 WHEN v <= 0.1 THEN 0.0 ELSE round((v - 0.1) / 0.3, 6) END::DOUBLE AS speech FROM (SELECT event_id, (event_id % 100) / 100.0::DOUBLE AS v FROM events)")
def vad_scores(t):
    """M06."""
    ratio = (F.col("event_id") % 100) / F.lit(100.0)
    return t.events.select("event_id", F.round(signal.vad_score(ratio), 6).alias("speech"))


@query("WITH RECURSIVE j AS (SELECT conv_id, turn, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), w AS (SELECT conv_id, turn, i, 0 AS batch, 1 AS held, chars AS total FROM j WHERE i = 1 UNION ALL SELECT j.conv_id, j.turn, j.i, CASE WHEN w.held >= 3 OR w.total + j.chars > 800 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.held >= 3 OR w.total + j.chars > 800 THEN 1 ELSE w.held + 1 END, CASE WHEN w.held >= 3 OR w.total + j.chars > 800 THEN j.chars ELSE w.total + j.chars END FROM w JOIN j ON j.conv_id = w.conv_id AND j.i = w.i + 1) SELECT conv_id, turn, batch FROM w")
def packed_batches(t):
    """W16."""
    jobs = t.conversations.select("conv_id", "turn", F.length("text").alias("chars"))
    return aggregates.pack_batches(jobs, "conv_id", ["turn"], 3, 800).select("conv_id", "turn", "batch")


@query()
def assigned_pools(t):
    """A voice for each speaker; where it lands in a pool is by hash, tests check stability and spread."""
    speakers = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3).alias("sex"), F.col("c_nationkey").alias("race"), (F.col("c_custkey") % 5).alias("category"), F.when(F.col("c_custkey") % 10 == 0, F.lit(-1).cast("bigint")).alias("explicit"))
    pools = t.supplier.where("s_suppkey % 2 = 0").groupBy((F.col("s_suppkey") % 3).alias("sex"), F.col("s_nationkey").alias("race"), (F.col("s_suppkey") % 5).alias("category")).agg(F.sort_array(F.collect_list("s_suppkey")).alias("members"))
    donors = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 3).alias("sex"), F.col("s_nationkey").alias("race"), (F.col("s_suppkey") % 5).alias("category"), F.col("s_acctbal").alias("quality"))
    return pipelines.assign_pools(speakers, pools, donors)


@query(
    "WITH s AS (SELECT c_custkey AS id, c_custkey % 3 AS sex, c_nationkey AS race, c_custkey % 5 AS category, c_custkey % 4 AS class, CASE WHEN c_custkey % 10 = 0 THEN -1 END AS explicit FROM customer), d AS (SELECT s_suppkey AS id, s_suppkey % 3 AS sex, s_nationkey AS race, s_suppkey % 7 AS category, s_suppkey % 4 AS class FROM supplier), "
    "p AS (SELECT p_size % 3 AS sex, p_size % 25 AS race, p_size % 5 AS category, list(p_partkey) AS members FROM part WHERE p_size % 4 = 0 GROUP BY 1, 2, 3), o AS (SELECT sex, race, category, list(id) AS members FROM d WHERE id % 2 = 0 GROUP BY 1, 2, 3), "
    "f AS (SELECT s.id, max((8 * (d.sex = s.sex)::INT + 4 * (d.category = s.category)::INT + 2 * (d.race = s.race)::INT + (d.class = s.class)::INT, -d.id)) AS best FROM s, d GROUP BY 1) "
    "SELECT s.id, CASE WHEN explicit IS NOT NULL THEN 'override' WHEN p.members IS NOT NULL THEN 'profile' WHEN o.members IS NOT NULL THEN 'pool' ELSE 'fallback' END AS source, CASE WHEN explicit IS NULL AND p.members IS NULL AND o.members IS NULL THEN -best[2] END AS donor, CASE WHEN explicit IS NULL AND p.members IS NULL AND o.members IS NULL THEN best[1] END AS score, true AS member FROM s LEFT JOIN p USING (sex, race, category) LEFT JOIN o USING (sex, race, category) JOIN f ON f.id = s.id"
)
def assigned_voices(t):
    """Explicit voices, pools of profiles, pools of donors, best donors; of a voice picked by hash, whether it
    is a member of its pool."""
    k = F.col("c_custkey")
    speakers = t.customer.select(k.alias("id"), (k % 3).alias("sex"), F.col("c_nationkey").cast("bigint").alias("race"), (k % 5).alias("category"), (k % 4).alias("class"), F.when(k % 10 == 0, F.lit(-1).cast("bigint")).alias("explicit"))
    d = F.col("s_suppkey")
    donors = t.supplier.select(d.alias("id"), (d % 3).alias("sex"), F.col("s_nationkey").cast("bigint").alias("race"), (d % 7).alias("category"), (d % 4).alias("class"))
    pools = donors.where("id % 2 = 0").groupBy("sex", "race", "category").agg(F.sort_array(F.collect_list("id")).alias("members"))
    size = F.col("p_size").cast("bigint")
    profiles = t.part.where("p_size % 4 = 0").groupBy((size % 3).alias("sex"), (size % 25).alias("race"), (size % 5).alias("category")).agg(F.sort_array(F.collect_list("p_partkey")).alias("members"))
    found = pipelines.assign_voices(speakers, profiles, pools, donors).join(speakers, "id")
    keys = ["sex", "race", "category"]
    held = lambda t, member, there: t.select(*keys, F.explode("members").alias(member)).distinct().withColumn(there, F.lit(True))
    told = found.join(held(profiles, "profile", "_a"), [*keys, "profile"], "left").join(held(pools, "donor", "_b"), [*keys, "donor"], "left")
    member = F.when(F.col("source") == "profile", F.coalesce("_a", F.lit(False))).when(F.col("source") == "pool", F.coalesce("_b", F.lit(False))).otherwise(True)
    return told.select("id", "source", F.when(F.col("source") == "fallback", F.col("donor")).alias("donor"), "score", member.alias("member"))


@query("SELECT l_suppkey AS identity, arg_max(l_orderkey * 10 + l_linenumber, (l_tax < 0.03, l_returnflag = 'N', l_quantity, -(l_orderkey * 10 + l_linenumber))) AS id FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def best_samples(t):
    """W05, W06."""
    s = t.lineitem.select(F.col("l_suppkey").alias("identity"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_tax") < 0.03).alias("automatic"), (F.col("l_returnflag") == "N").alias("local_stem"), F.col("l_quantity").alias("overall"), F.when(F.col("l_linestatus") == "O", "approved").otherwise("pending").alias("decision"))
    return ranking.best_sample(s, ["identity"]).select("identity", "id")


def samples(t):
    s = t.lineitem
    return s.select((s.l_orderkey * 10 + s.l_linenumber).alias("id"), s.l_suppkey.alias("identity"), (s.l_tax < 0.05).alias("automatic"), (s.l_quantity / 20).alias("duration_secs"), s.l_discount.alias("speech"), s.l_quantity.alias("overall"), F.lit("pending").alias("decision"), (s.l_linenumber % 3).alias("priority"))


@query("SELECT id, CASE WHEN usable AND r = 1 THEN 'approved' WHEN automatic AND speech <= 0 THEN 'rejected' ELSE 'pending' END AS decision FROM (SELECT *, row_number() OVER (PARTITION BY identity, usable ORDER BY overall DESC, id) AS r FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS identity, l_tax < 0.05 AS automatic, l_discount AS speech, l_quantity AS overall, l_tax < 0.05 AND l_quantity / 20 >= 0.6 AND l_discount > 0 AS usable FROM lineitem))")
def approved_samples(t):
    """W03."""
    return ranking.approve_best(samples(t)).select("id", "decision")


@query("SELECT id, CASE WHEN gap AND r = 1 THEN 'approved' ELSE 'pending' END AS decision FROM (SELECT id, NOT bool_or(automatic) OVER (PARTITION BY identity) AS gap, row_number() OVER (PARTITION BY identity ORDER BY priority DESC, overall DESC, id) AS r FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS identity, l_tax < 0.01 AS automatic, l_quantity AS overall, l_linenumber % 3 AS priority FROM lineitem))")
def approved_gaps(t):
    """W04."""
    s = t.lineitem
    rows = s.select((s.l_orderkey * 10 + s.l_linenumber).alias("id"), s.l_partkey.alias("identity"), (s.l_tax < 0.01).alias("automatic"), s.l_quantity.alias("overall"), (s.l_linenumber % 3).alias("priority"), F.lit("pending").alias("decision"))
    return ranking.approve_manual_gaps(rows).select("id", "decision")


@query("SELECT id, CASE WHEN decision = 'pending' AND lo = hi THEN lo ELSE decision END AS decision FROM (SELECT *, min(nullif(decision, 'pending')) OVER (PARTITION BY sound) AS lo, max(nullif(decision, 'pending')) OVER (PARTITION BY sound) AS hi FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS sound, CASE WHEN l_quantity > 45 THEN 'approved' WHEN l_quantity < 4 THEN 'rejected' ELSE 'pending' END AS decision FROM lineitem))")
def unanimous_decisions(t):
    """A23."""
    s = t.lineitem
    rows = s.select((s.l_orderkey * 10 + s.l_linenumber).alias("id"), s.l_partkey.alias("sound"), F.when(s.l_quantity > 45, "approved").when(s.l_quantity < 4, "rejected").otherwise("pending").alias("decision"))
    return aggregates.unanimous_decisions(rows, ["sound"]).select("id", "decision")


@query("SELECT sound, count(*) AS characters, bool_or(bound) AS bound, arg_max(id, (overall, -id)) AS representative FROM (SELECT l_partkey AS sound, l_suppkey, bool_or(l_tax < 0.02) AS bound, arg_max(l_orderkey * 10 + l_linenumber, (l_tax < 0.02, l_quantity, -(l_orderkey * 10 + l_linenumber))) AS id, arg_max(l_quantity, (l_tax < 0.02, l_quantity, -(l_orderkey * 10 + l_linenumber))) AS overall FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def sound_usage(t):
    """A21, A29, J21."""
    s = t.lineitem
    rows = s.select(s.l_partkey.alias("sound"), s.l_suppkey.alias("identity"), (s.l_orderkey * 10 + s.l_linenumber).alias("id"), s.l_quantity.alias("overall"), (s.l_tax < 0.02).alias("bound"))
    return pipelines.sound_usage(rows).select("sound", "characters", "bound", "representative")


@query("WITH b AS (SELECT o_custkey AS identity, count(DISTINCT o_orderkey % 3) AS n, min(o_orderkey % 3) AS own FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), s AS (SELECT o_custkey AS identity, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey AS identity, CASE WHEN n > 1 THEN NULL WHEN n = 1 THEN own ELSE best END AS sample, CASE WHEN n > 1 THEN 'skip' WHEN n = 1 THEN 'keep' WHEN best IS NOT NULL THEN 'bind' ELSE 'none' END AS action FROM customer LEFT JOIN b ON b.identity = c_custkey LEFT JOIN s ON s.identity = c_custkey")
def auto_bindings(t):
    """P10, B01."""
    o = t.orders
    bound = o.where("o_orderpriority = '1-URGENT'").select(o.o_custkey.alias("identity"), F.lit("override").alias("source"), (o.o_orderkey % 3).alias("sample"))
    found = o.where("o_orderstatus = 'F'").select(o.o_custkey.alias("identity"), o.o_orderkey.alias("id"), F.lit(True).alias("automatic"), F.lit(True).alias("local_stem"), o.o_totalprice.alias("overall"), F.lit("approved").alias("decision"))
    return pipelines.auto_bind(t.customer.select(F.col("c_custkey").alias("identity")), found, bound)


@query(r"WITH RECURSIVE j AS (SELECT role AS voice, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line, min(conv_id * 1000 + turn) AS id, count(*) AS jobs FROM conversations GROUP BY 1, 2), k AS (SELECT *, length(line)::INT AS chars, row_number() OVER (PARTITION BY voice ORDER BY length(line), id) AS i FROM j), w AS (SELECT id, voice, jobs, chars, i, 0 AS batch, 1 AS held, chars AS total FROM k WHERE i = 1 UNION ALL SELECT k.id, k.voice, k.jobs, k.chars, k.i, CASE WHEN w.held >= 8 OR w.total + k.chars > 800 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.held >= 8 OR w.total + k.chars > 800 THEN 1 ELSE w.held + 1 END, CASE WHEN w.held >= 8 OR w.total + k.chars > 800 THEN k.chars ELSE w.total + k.chars END FROM w JOIN k ON k.voice = w.voice AND k.i = w.i + 1) SELECT id, voice, jobs, chars, batch FROM w")
def generation_plan(t):
    """Deduplicated jobs of each voice, packed in order of length."""
    jobs = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("voice"), "text", F.lit("{}").alias("settings"))
    return pipelines.plan_generation(jobs).select("id", "voice", "jobs", "chars", "batch")
