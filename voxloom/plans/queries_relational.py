"""Queries over the star tables: joins, roll-ups, ranking, paging, sets and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import aggregates, bindings, graph, ordering, predicates, ranking, state
from . import pipelines
from .registry import query

CENTS = lambda c: F.round(F.col(c) * 100).cast("bigint")


@query("SELECT o_orderkey, c_name, n_name, r_name, s.suppliers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND r_name IN ('ASIA', 'EUROPE')")
def scope_rows(t):
    """A chain of inner and left joins with pushed-down facets."""
    suppliers = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    where = t.region.where(predicates.facets({"r_name": ["ASIA", "EUROPE"]}))
    joined = t.orders.where("o_orderstatus = 'F'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(where, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.join(suppliers, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name", "suppliers")


@query("SELECT o.o_orderkey, coalesce(l.lines, 0) AS lines, coalesce(l.returned, 0) AS returned FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey AND o_orderstatus = 'O'")
def filtered_on_join(t):
    """The condition on one side belongs to the join, not to a filter after it."""
    lines = aggregates.counts(t.lineitem, {"lines": F.lit(True), "returned": F.col("l_returnflag") == "R"}, ["l_orderkey"])
    joined = t.orders.join(lines, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("o_orderstatus") == "O"), "left")
    return joined.select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("returned", F.lit(0)).alias("returned"))


@query("SELECT c_custkey, max(o_orderkey) AS latest, max_by(o_orderpriority, o_orderkey) AS priority FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def latest_order(t):
    """The row with the highest id of each key."""
    latest = ranking.latest(t.orders, ["o_custkey"], "o_orderpriority", "o_orderkey")
    return t.customer.join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_orderkey").alias("latest"), F.col("o_orderpriority").alias("priority"))


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON upper(substr(c_name, 10)) = upper(substr(s_name, 10))")
def folded_join(t):
    """J08."""
    return t.customer.join(t.supplier, F.upper(F.expr("substr(c_name, 10)")) == F.upper(F.expr("substr(s_name, 10)"))).select("c_custkey", "s_suppkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def semi_and_anti(t):
    """J12, J13, F20, F21."""
    having = t.customer.join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return predicates.without(having, t.supplier.where("s_acctbal < 0").withColumnRenamed("s_nationkey", "c_nationkey"), ["c_nationkey"]).select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE (c_mktsegment = 'BUILDING' OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT') OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 400000)) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def eligible_customers(t):
    """One of several memberships, and not excluded."""
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    rows = t.customer.withColumn("status", F.when(F.col("c_mktsegment") == "BUILDING", "ready").otherwise("other"))
    tests = {"urgent": (orders.where("o_orderpriority = '1-URGENT'"), ["c_custkey"]), "large": (orders.where("o_totalprice > 400000"), ["c_custkey"])}
    excluded = t.nation.where("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey"))
    return predicates.eligible(rows, tests, excluded, ["c_nationkey"]).select("c_custkey")


@query("SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey WHERE coalesce(n, 0) <= 2")
def few_finished(t):
    """F14."""
    return predicates.having_at_most(t.customer.select("c_custkey"), t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", 2)


@query("SELECT n_nationkey AS nation, n_name, c.customers, coalesce(s.suppliers, 0) AS suppliers, coalesce(o.orders, 0) AS orders FROM nation JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey AS k, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) o ON o.k = n_nationkey")
def demographic_rollup(t):
    """Counts of several tables by one key."""
    per = aggregates.demographics({
        "customers": t.customer.select(F.col("c_nationkey").alias("nation")), "suppliers": t.supplier.select(F.col("s_nationkey").alias("nation")),
        "orders": t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation")),
    }, ["nation"])
    return per.join(t.nation, F.col("nation") == F.col("n_nationkey")).select("nation", "n_name", "customers", "suppliers", "orders")


@query("SELECT c_nationkey, count(*) AS customers, bool_and(c_acctbal > -900) AS solvent, max_by(c_custkey, (c_acctbal, -c_custkey)) AS richest, count(DISTINCT c_mktsegment) AS segments, CASE WHEN min(c_mktsegment) = max(c_mktsegment) THEN min(c_mktsegment) END AS uniform FROM customer GROUP BY 1")
def nation_groups(t):
    """A07, A28, A32, W14."""
    return t.customer.groupBy("c_nationkey").agg(
        F.count("*").alias("customers"), F.bool_and(F.col("c_acctbal") > -900).alias("solvent"), F.max_by("c_custkey", F.struct("c_acctbal", (-F.col("c_custkey")).alias("low"))).alias("richest"),
        F.count_distinct("c_mktsegment").alias("segments"), ranking.uniform(F.col("c_mktsegment")).alias("uniform"),
    )


@query("SELECT l_partkey AS strref, count(*) AS lines, CASE WHEN count(DISTINCT l_suppkey) = 1 AND count(l_suppkey) = count(*) THEN 'reuse_same_voice' ELSE 'defer_diff_voice' END AS resolution FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def shared_parts(t):
    """A10."""
    return aggregates.shared_groups(t.lineitem.select(F.col("l_partkey").alias("strref"), F.col("l_suppkey").alias("speaker_id")))


@query("SELECT s_suppkey, CASE WHEN count(*) OVER (PARTITION BY s_nationkey) > 1 THEN s_nationkey || ' (' || s_suppkey || ')' ELSE s_nationkey::VARCHAR END AS label FROM supplier")
def relabelled(t):
    """A09."""
    rows = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("string").alias("name"))
    return aggregates.relabel_collisions(rows, "name", "s_suppkey").select("s_suppkey", "label")


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') IS NOT NULL AS some, coalesce(min(o_orderkey) FILTER (o_orderstatus = 'F'), min(o_orderkey)) AS first_key FROM orders GROUP BY 1")
def ordered_fold(t):
    """From members in order, the first ready one, else the first."""
    rows = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("source"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("open").alias("status"))
    folded = aggregates.fold_in_order(rows, ["o_custkey"], "o_orderkey", "source", "status")
    return folded.select("o_custkey", (F.col("status") == "ready").alias("some"), F.col("source").alias("first_key"))


@query("SELECT user_id, event_type, count(*) AS n, count(*) FILTER (event_type = 'error' OR value < 10) AS low, max_by(event_id, (value, -event_id)) AS top FROM events GROUP BY 1, 2")
def event_counts(t):
    """A03, A15."""
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if((F.col("event_type") == "error") | (F.col("value") < 10)).alias("low"), F.max_by("event_id", F.struct("value", (-F.col("event_id")).alias("low"))).alias("top"))


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase') AS wins, count(*) FILTER (event_type = 'error') AS losses, count(*) FILTER (event_type = 'view') AS ties, round(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type IN ('purchase', 'error')), 0), 6) AS rate FROM events GROUP BY 1")
def preference_rates(t):
    """A27."""
    winner = F.when(F.col("event_type") == "purchase", "variant").when(F.col("event_type") == "error", "baseline").when(F.col("event_type") == "view", "tie")
    return aggregates.preferences(t.events.withColumn("winner", winner), "user_id", "winner")


@query("SELECT p_brand, max(p_type) AS p_type FROM (SELECT p_brand, p_type, m, max(m) OVER (PARTITION BY p_brand) AS top FROM (SELECT p_brand, p_type, max(p_size * 100000 + p_partkey % 3) AS m FROM part GROUP BY 1, 2)) WHERE m = top GROUP BY p_brand HAVING count(*) = 1")
def majority_types(t):
    """The option with the largest score, ties left out."""
    rows = t.part.withColumn("score", F.col("p_size") * 100000 + F.col("p_partkey") % 3)
    return ranking.majority(rows, "p_brand", "p_type", "score")


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem WHERE l_discount >= 0.05) WHERE r <= 12")
def top_lines(t):
    """The first 12 of each key after a gate."""
    rows = t.lineitem.where("l_discount >= 0.05").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return ranking.top(rows, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 12).drop("l_extendedprice")


@query("WITH s AS (SELECT l_suppkey, l_partkey AS sound, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_suppkey = l.l_suppkey AND x.l_partkey = l.l_partkey AND x.l_returnflag = 'R')), u AS (SELECT s.l_suppkey, s.sound, l.l_orderkey, l.l_linenumber, row_number() OVER (PARTITION BY s.l_suppkey ORDER BY l_extendedprice DESC, l.l_orderkey, l.l_linenumber) AS k FROM s JOIN lineitem l ON s.l_orderkey = l.l_orderkey AND s.l_linenumber = l.l_linenumber AND s.sound = l.l_partkey AND s.l_suppkey = l.l_suppkey WHERE s.r = 1) SELECT l_suppkey, sound::VARCHAR AS sound, l_orderkey, l_linenumber FROM u WHERE k <= 8")
def gap_fill_lines(t):
    """Distinct sounds of each key that don't exist yet, the first 8."""
    rows = t.lineitem.select("l_suppkey", F.col("l_partkey").cast("string").alias("sound"), "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    return ranking.distinct_sounds(rows, ["l_suppkey"], order, 8, rows.where("l_returnflag = 'R'")).select("l_suppkey", "sound", "l_orderkey", "l_linenumber")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 WHEN 'O' THEN 1 ELSE 0 END DESC, o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def best_decision(t):
    """By rank of decision, then score, then low id; without a window, as each key is aggregated before the shuffle."""
    decision = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "rejected")
    by = F.struct(ranking.decision_rank(decision).alias("rank"), F.col("o_totalprice"), (-F.col("o_orderkey")).alias("low"))
    return ranking.best(t.orders, ["o_custkey"], by).select("o_custkey", "o_orderkey")


@query("SELECT conv_id, arg_max(turn, (CASE role WHEN 'assistant' THEN 9 WHEN 'user' THEN 5 ELSE 0 END, -turn)) AS turn FROM conversations GROUP BY 1")
def binding_sources(t):
    """Rank of source, ready first among equals."""
    source = F.when(F.col("role") == "assistant", "override").when(F.col("role") == "user", "generic")
    by = F.struct(ranking.source_rank(source, F.col("role").isin("assistant", "user")).alias("rank"), (-F.col("turn")).alias("low"))
    return ranking.best(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], by).select("conv_id", "turn")


@query("SELECT s_suppkey, row_number() OVER (ORDER BY (s_nationkey <> 3), (s_suppkey % 5 <> 1), s_acctbal DESC, s_suppkey)::INT AS place FROM supplier WHERE s_suppkey % 2 = 1")
def donor_order(t):
    """Every donor of a target's sex with its place by likeness and quality."""
    pool = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("category"), (F.col("s_suppkey") % 5).alias("race"), F.col("s_acctbal").alias("quality"), F.col("s_suppkey").alias("id"))
    same_sex = pool.where("s_suppkey % 2 = 1").withColumn("sex", F.lit(1))
    order = ranking.Window.partitionBy("sex").orderBy(*ranking.donors({"category": 3, "race": 1}, pool))  # one target's list
    return same_sex.select("s_suppkey", F.row_number().over(order).alias("place"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 50")
def key_page(t):
    """O05, O08, F27."""
    return ordering.key_page(t.customer, "c_custkey", 100, 50).select("c_custkey", "c_name")


@query("SELECT c_mktsegment, max_by(c_name, c_custkey) AS c_name FROM customer GROUP BY 1")
def segment_options(t):
    """O16, V10."""
    return ordering.labelled_options(t.customer, "c_mktsegment", "c_name", "c_custkey")


@query("SELECT k, n FROM (SELECT o_custkey AS k, 1 AS n FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey, 2 FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey, 3 FROM customer WHERE c_acctbal < 0)")
def union_of_consumers(t):
    """U03, U08."""
    a = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.lit(1).alias("n"))
    b = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.lit(2).alias("n"))
    return a.union(b).union(t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("k"), F.lit(3).alias("n"))).distinct()


@query("SELECT k, source FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source, v) AS r FROM (SELECT o_custkey AS k, 'a' AS source, o_orderkey AS v FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, 'b', o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey, 'c', c_custkey FROM customer)) WHERE r = 1")
def first_of_sources(t):
    """Of several sources in order of precedence the first row of each key."""
    part = lambda df, k, v, s: df.select(F.col(k).alias("k"), F.lit(s).alias("source"), F.col(v).alias("v"))
    tables = [part(t.orders.where("o_orderstatus = 'P'"), "o_custkey", "o_orderkey", "a"), part(t.orders.where("o_orderstatus = 'F'"), "o_custkey", "o_orderkey", "b"), part(t.customer, "c_custkey", "c_custkey", "c")]
    return ranking.first_source(tables, ["k"], [F.col("v")]).select("k", "source")


@query("SELECT count(*) AS both FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def common_parts(t):
    """U04."""
    parts = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select("l_partkey")
    return parts("R").intersect(parts("A")).agg(F.count("*").alias("both"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey + 1000 ELSE s_suppkey END AS nation FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT s_suppkey + 100000, 1 FROM supplier WHERE s_suppkey % 11 = 0")
def merged_suppliers(t):
    """A keyed merge that keeps ids, updates values, inserts and deletes."""
    old = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").cast("string").alias("key"), F.col("s_suppkey").alias("nation"))
    kept = old.where("id % 7 <> 0").select((F.col("id") + 5_000_000).alias("id"), "key", F.when(F.col("id") % 3 == 0, F.col("nation") + 1000).otherwise(F.col("nation")).alias("nation"))
    new = kept.unionByName(old.where("id % 11 = 0").select((F.col("id") + 100000).alias("id"), F.concat(F.lit("new"), "key").alias("key"), F.lit(1).cast("bigint").alias("nation")))
    return state.merge(old, new, ["key"]).select("id", "nation")


@query("SELECT count(*) FILTER (s_suppkey % 11 = 0) AS inserted, count(*) FILTER (s_suppkey % 7 <> 0 AND s_suppkey % 3 = 0) AS updated, count(*) FILTER (s_suppkey % 7 <> 0 AND s_suppkey % 3 <> 0) AS unchanged, count(*) FILTER (s_suppkey % 7 = 0) AS deleted FROM supplier")
def merge_counters(t):
    """D10."""
    old = t.supplier.select(F.col("s_suppkey").alias("key"), F.lit(0).alias("v"))
    new = old.where("key % 7 <> 0").select("key", F.when(F.col("key") % 3 == 0, 1).otherwise(0).alias("v")).union(old.where("key % 11 = 0").select(-F.col("key") - 1, F.lit(2)))
    return state.changes(old, new, ["key"], ["v"])


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'kept' WHEN n_nationkey % 2 = 0 THEN 'new' ELSE n_name END AS name FROM nation UNION ALL SELECT n_nationkey + 100, 'new' FROM nation WHERE n_nationkey % 5 = 0")
def guarded_upsert(t):
    """D01, D03."""
    table = t.nation.select("n_nationkey", F.when(F.col("n_regionkey") == 2, "kept").otherwise(F.col("n_name")).alias("name"))
    rows = t.nation.where("n_nationkey % 2 = 0").select("n_nationkey", F.lit("new").alias("name")).union(t.nation.where("n_nationkey % 5 = 0").select(F.col("n_nationkey") + 100, F.lit("new")))
    return state.upsert(table, rows, ["n_nationkey"], F.col("name") == "kept").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "name")


@query("SELECT o_orderkey, CASE WHEN c_acctbal >= 0 THEN o_custkey END AS o_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
def cascade_set_null(t):
    """D04."""
    return state.cascade(t.orders.select("o_orderkey", "o_custkey"), t.customer.where("c_acctbal >= 0"), "o_custkey", "c_custkey", set_null=True)


@query("SELECT * FROM (SELECT 'positive' AS \"constraint\", count(*) FILTER (NOT l_quantity > 10) AS rows FROM lineitem UNION ALL SELECT 'unique(l_orderkey, l_linenumber)', coalesce((SELECT sum(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)), 0)::BIGINT)")
def constraint_violations(t):
    """D05."""
    return state.violations(t.lineitem, {"positive": F.col("l_quantity") > 10}, [["l_orderkey", "l_linenumber"]])


@query("SELECT o_orderkey, o_custkey, 10 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sort_order FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 FROM orders WHERE o_custkey % 2 = 1")
def appended_numbers(t):
    """A31."""
    existing = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(10).cast("bigint").alias("sort_order"))
    return aggregates.append_numbers(existing, t.orders.select("o_orderkey", "o_custkey"), "o_custkey", ["o_orderkey"]).select("o_orderkey", "o_custkey", F.col("sort_order").cast("bigint").alias("sort_order"))


FOLLOWS = "SELECT c_custkey AS speaker, CASE WHEN c_custkey % 4 = 0 THEN 'default' ELSE 'follow' END AS source, CASE WHEN c_custkey % 4 <> 0 THEN CASE WHEN c_custkey % 97 = 1 THEN c_custkey + 1 WHEN c_custkey % 97 = 2 THEN c_custkey - 1 ELSE c_custkey + 1 END END AS follows FROM customer"


def follows(t):
    k = F.col("c_custkey")
    target = F.when(k % 4 != 0, F.when(k % 97 == 2, k - 1).otherwise(k + 1))
    return t.customer.select(k.alias("speaker"), F.when(k % 4 == 0, "default").otherwise("follow").alias("source"), target.alias("follows"))


@query(f"WITH RECURSIVE b AS ({FOLLOWS}), w AS (SELECT speaker, speaker AS \"at\", source, follows, 0 AS hops FROM b UNION ALL SELECT w.speaker, b.speaker, b.source, b.follows, w.hops + 1 FROM w JOIN b ON w.follows = b.speaker WHERE w.source = 'follow' AND w.hops < 8) SELECT speaker, max_by(w.at, hops) AS \"at\", max(hops) AS hops FROM w GROUP BY 1")
def resolved_voices(t):
    """The end of each follow chain within 8 hops."""
    return graph.resolved_voices(follows(t))


#: Chains are walked to their end, or until a speaker comes again, whatever the length; only then is the bound applied.
WALKED = """w AS (SELECT speaker AS s, [speaker] AS path, source, follows, false AS again FROM b
  UNION ALL SELECT w.s, list_append(path, n.speaker), n.source, n.follows, list_contains(path, n.speaker) FROM w JOIN b n ON w.follows = n.speaker WHERE w.source = 'follow' AND NOT again),
e AS (SELECT s, path, source, follows, again FROM w WHERE again OR source <> 'follow' OR follows IS NULL OR follows NOT IN (SELECT speaker FROM b)),
told AS (SELECT s AS speaker, path, CASE WHEN again THEN CASE WHEN len(path) - 1 <= 8 THEN 'cycle' ELSE 'depth' END WHEN source <> 'follow' THEN CASE WHEN len(path) - 1 <= 8 THEN 'own' ELSE 'depth' END
  WHEN len(path) - 1 + (follows IS NOT NULL)::INT <= 8 THEN 'missing' ELSE 'depth' END AS status FROM e)"""


@query(f"WITH RECURSIVE b AS ({FOLLOWS}), {WALKED} SELECT status, count(*) AS count FROM told GROUP BY 1")
def follow_status(t):
    """Own, missing, depth or cycle."""
    return graph.effective(follows(t)).groupBy("status").count()


CHAINED = "SELECT o_orderkey AS speaker, CASE WHEN later IS NULL AND o_custkey % 3 = 0 THEN 'default' ELSE 'follow' END AS source, CASE WHEN later IS NOT NULL THEN later WHEN o_custkey % 3 = 1 THEN CASE WHEN o_custkey % 2 = 0 THEN third ELSE first END WHEN o_custkey % 3 = 2 AND o_custkey % 2 = 0 THEN -1 END AS follows FROM (SELECT o_orderkey, o_custkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS later, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first, lag(o_orderkey, 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS third FROM orders)"


def chained(t):
    """Orders that follow the next one of their customer; the last has a binding of its own, follows nobody, a speaker
    without one, the first (a ring of all) or the third before it (a tail into a ring of four)."""
    by, c = Window.partitionBy("o_custkey").orderBy("o_orderkey"), F.col("o_custkey")
    o = t.orders.select("o_orderkey", "o_custkey", F.lead("o_orderkey").over(by).alias("later"), F.min("o_orderkey").over(Window.partitionBy("o_custkey")).alias("first"), F.lag("o_orderkey", 3).over(by).alias("third"))
    last = F.when(c % 3 == 1, F.when(c % 2 == 0, F.col("third")).otherwise(F.col("first"))).when((c % 3 == 2) & (c % 2 == 0), F.lit(-1))
    return o.select(F.col("o_orderkey").alias("speaker"), F.when(F.col("later").isNull() & (c % 3 == 0), "default").otherwise("follow").alias("source"), F.coalesce("later", last).alias("follows"))


@query(f"WITH RECURSIVE b AS ({CHAINED}), {WALKED} SELECT speaker, status, path[least(len(path), 9)] AS \"at\", least(len(path) - 1, 8)::INT AS hops FROM told WHERE status <> 'cycle' UNION ALL SELECT speaker, status, NULL, NULL FROM told WHERE status = 'cycle'")
def chain_ends(t):
    """Each chain's status and end; chains and rings of up to some forty orders."""
    known = F.col("status") != "cycle"
    return graph.effective(chained(t)).select("speaker", "status", F.when(known, F.col("at")).alias("at"), F.when(known, F.col("hops")).alias("hops"))


@query(
    f"WITH RECURSIVE b AS ({CHAINED}), {WALKED}, p AS (SELECT o_orderkey AS speaker, target FROM (SELECT o_orderkey, lag(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS target FROM orders UNION ALL SELECT o_orderkey, o_orderkey + 1 FROM orders UNION ALL SELECT -1, o_orderkey FROM orders) WHERE target IS NOT NULL) "
    "SELECT p.speaker, p.target, coalesce(told.status IN ('cycle', 'depth') OR list_contains(told.path, p.speaker) OR e.follows = p.speaker, false) OR p.speaker = p.target AS cycle FROM p LEFT JOIN told ON told.speaker = p.target LEFT JOIN e ON e.s = p.target"
)
def refused_follows(t):
    """Whether an order may follow the second before it, the next key, or, as a speaker without a binding, any."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = t.orders
    back = o.select(F.col("o_orderkey").alias("speaker"), F.lag("o_orderkey", 2).over(by).alias("target")).where("target IS NOT NULL")
    other = o.select(F.col("o_orderkey").alias("speaker"), (F.col("o_orderkey") + 1).alias("target"))
    absent = o.select(F.lit(-1).cast("long").alias("speaker"), F.col("o_orderkey").alias("target"))
    return graph.would_cycle(chained(t), back.unionByName(other).unionByName(absent))


@query("SELECT s_suppkey, CASE WHEN n < 1296 THEN 'Z0000' || (s_suppkey % 4) || substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', (n // 36)::INT + 1, 1) || substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', (n % 36)::INT + 1, 1) END AS name FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey % 4 ORDER BY s_suppkey) AS n FROM supplier)")
def unique_names(t):
    """Free suffixes where 00 is taken."""
    lines = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 4).alias("strref"))
    taken = t.nation.where("n_nationkey < 4").select(F.concat(F.lit("z"), hashing.base36(F.col("n_nationkey"), 5), F.lit("00")).alias("name"))
    return hashing.unique_names(lines, taken, "strref", ["s_suppkey"]).select("s_suppkey", "name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_shipdate DESC, l_extendedprice, l_orderkey DESC, l_linenumber, l_partkey, l_suppkey LIMIT 150 OFFSET (SELECT count(*) * 2 // 3 FROM lineitem)")
def page_in_the_deep(t):
    """A page at two thirds of all lines, by day downwards and price upwards."""
    keys = [("l_shipdate", False), ("l_extendedprice", True), ("l_orderkey", False), ("l_linenumber", True), ("l_partkey", True), ("l_suppkey", True)]
    rows = t.lineitem.select(*(c for c, _ in keys))
    return ordering.deep_page(rows, keys, rows.count() * 2 // 3, 150, enough=10_000).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY c_name) AS id, c_name AS name FROM customer")
def numbers_that_go_on(t):
    """New rows get gapless numbers from the largest there is, by name."""
    old = t.part.select(F.col("p_partkey").alias("id"))
    return state.number_rows(t.customer.select(F.col("c_name").alias("name")), ["name"], after=old)


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT * FROM (SELECT min(o_custkey + 7), 'order', max(o_totalprice) FROM orders WHERE (o_custkey + 7) NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY o_custkey + 7)")
def added_once(t):
    """A batch in which keys repeat, of which the dearest row is added if the table lacks the key."""
    table = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    batch = t.orders.select((F.col("o_custkey") + 7).alias("id"), F.lit("order").alias("name"), F.col("o_totalprice").alias("balance"), (-F.col("o_totalprice")).alias("dear"))
    fresh = state.insert_new(table.withColumn("dear", F.lit(0.0)), batch, ["id"], ["dear"])
    return table.unionByName(fresh.drop("dear"))


@query("SELECT lines, count(*) AS dialogues FROM (SELECT conv_id, count(*) AS lines FROM conversations GROUP BY 1) GROUP BY 1")
def dialogue_sizes(t):
    """A14."""
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("lines")).groupBy("lines").agg(F.count("*").alias("dialogues"))


@query("WITH c AS (SELECT 'd' || (s_suppkey % 30) AS dialogue, s_name AS name, s_nationkey % 3 = 0 AS named, s_nationkey % 2 = 0 AS voiced FROM supplier), o AS (SELECT *, row_number() OVER (PARTITION BY dialogue ORDER BY named DESC, voiced DESC, lower(name)) AS r, count(*) OVER (PARTITION BY dialogue) AS n FROM c) SELECT c_custkey AS state, o.name AS owner, CASE WHEN o.n IS NULL THEN 0.0 WHEN o.n = 1 THEN 1.0 ELSE 0.2 END::DOUBLE AS confidence FROM customer LEFT JOIN o ON o.dialogue = 'd' || (c_custkey % 40) AND o.r = 1")
def attributed_states(t):
    """P01, W02, A12, J16."""
    creatures = t.supplier.select(F.concat(F.lit("d"), (F.col("s_suppkey") % 30).cast("string")).alias("dialogue"), F.col("s_name").alias("name"), (F.col("s_nationkey") % 3 == 0).alias("named"), (F.col("s_nationkey") % 2 == 0).alias("voiced"))
    states = t.customer.select(F.concat(F.lit("D"), (F.col("c_custkey") % 40).cast("string")).alias("dialogue"), F.col("c_custkey").alias("state"))
    return pipelines.attribute(states, creatures).select("state", "owner", "confidence")


@query("SELECT CASE WHEN n = 3 THEN 'listed' WHEN starts_with(lower(c_mktsegment), 'b') THEN 'prefixed' ELSE 'other' END AS kind, count(*) AS dialogues, sum(lines)::BIGINT AS lines FROM (SELECT c_mktsegment, count(*) AS lines, CASE WHEN c_mktsegment = 'MACHINERY' THEN 3 END AS n FROM customer GROUP BY 1) GROUP BY 1")
def dialogue_totals(t):
    """A13, J17."""
    listed = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_mktsegment").alias("dialogue")).distinct()
    return pipelines.dialogue_totals(t.customer.select(F.col("c_mktsegment").alias("dialogue")), listed, ["B"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'already voiced' WHEN o_orderkey % 7 = 0 THEN 'dynamic token' WHEN o_orderkey % 7 IN (1, 2) THEN 'not a state line' WHEN o_orderpriority = '5-LOW' THEN 'shared (different voice)' WHEN o_custkey % 5 = 0 THEN 'unattributed' ELSE 'other' END AS reason FROM orders")
def blocked_reasons(t):
    """ordered reasons."""
    o = t.orders
    n = o.o_orderkey % 7
    kind = F.when(n == 0, "token").when(n == 1, "transition").when(n == 2, "script").otherwise("state")
    return o.select("o_orderkey", predicates.blocked_reason(kind, o.o_orderstatus == "F", F.lit(False), o.o_orderpriority == "5-LOW", o.o_custkey % 5 != 0).alias("reason"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'skipped' WHEN o_custkey % 5 <> 0 AND o_orderpriority <> '5-LOW' THEN 'ready' ELSE 'blocked' END AS status FROM orders")
def line_statuses(t):
    """F12."""
    o, no = t.orders, F.lit(False)
    return o.select("o_orderkey", predicates.line_status(o.o_orderstatus == "F", no, no, o.o_orderpriority == "5-LOW", o.o_custkey % 5 != 0, F.lit(True), no).alias("status"))


@query("SELECT sound, count(DISTINCT identity) AS owners, min(identity) AS owner FROM (SELECT l_partkey::VARCHAR AS sound, l_suppkey AS identity FROM lineitem UNION ALL SELECT p_partkey::VARCHAR, p_size FROM part) GROUP BY 1")
def sound_owners(t):
    """A19, U07, F17."""
    return pipelines.sound_owners(t.lineitem.select(F.col("l_partkey").cast("string").alias("sound"), F.col("l_suppkey").alias("identity")), t.part.select(F.col("p_partkey").cast("string").alias("sound"), F.col("p_size").cast("bigint").alias("identity")))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 3 THEN 'unbound' WHEN n_regionkey = 0 THEN 'unknown' WHEN n_nationkey % 4 = 0 THEN 'unknown' WHEN n_regionkey = n_nationkey % 4 THEN 'match' ELSE 'mismatch' END AS match FROM nation")
def voice_matches(t):
    """P19, P20."""
    voice = F.when(F.col("n_nationkey") % 4 != 3, F.col("n_nationkey") % 4)
    return t.nation.select("n_nationkey", pipelines.voice_match(F.col("n_regionkey"), voice).alias("match"))


@query("SELECT n_nationkey, e AS experiment FROM nation, (SELECT unnest([0, 1, 2])::INT AS e)")
def experiment_matrix(t):
    """P16."""
    return pipelines.matrix(t.nation, [{"steps": 16}, {"steps": 32}, {"guidance": 2.0}]).select("n_nationkey", "experiment")


@query(f"WITH RECURSIVE b AS ({FOLLOWS}), w AS (SELECT speaker, speaker AS a, source, follows, 0 AS hops FROM b UNION ALL SELECT w.speaker, b.speaker, b.source, b.follows, w.hops + 1 FROM w JOIN b ON w.follows = b.speaker WHERE w.source = 'follow' AND w.hops < 8), r AS (SELECT speaker, max_by(a, hops) AS donor FROM w GROUP BY 1) SELECT c.c_custkey AS id, b.source, f.c_name AS follow_name, d.c_name AS donor_name FROM customer c LEFT JOIN b ON b.speaker = c.c_custkey LEFT JOIN r ON r.speaker = c.c_custkey LEFT JOIN customer f ON f.c_custkey = b.follows LEFT JOIN customer d ON d.c_custkey = r.donor")
def effective_bindings(t):
    """Self-joins for whom a speaker follows and whose voice that is in the end."""
    speakers = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return bindings.effective_bindings(speakers, follows(t).withColumn("status", F.lit("ready"))).select("id", "source", "follow_name", "donor_name")


@query("SELECT s_suppkey AS id, min(c_custkey) AS line FROM supplier JOIN customer ON trim(c_mktsegment) = trim(CASE s_suppkey % 3 WHEN 0 THEN ' BUILDING ' WHEN 1 THEN 'MACHINERY' ELSE 'x' END) GROUP BY 1")
def text_owners(t):
    """J09."""
    sources = t.supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, " BUILDING ").when(F.col("s_suppkey") % 3 == 1, "MACHINERY").otherwise("x").alias("source_text"))
    return bindings.text_owners(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("text")), sources)


@query("SELECT c_custkey, coalesce(n_name, 'unknown') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def lookups(t):
    """J15, J22."""
    table = t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return bindings.lookup(t.customer, table, "c_nationkey", "n_name", "nation", "unknown").select("c_custkey", "nation")


@query("WITH d AS (SELECT s_suppkey AS id, s_suppkey % 3 AS sex, s_nationkey AS race, s_suppkey % 5 AS category, s_acctbal AS quality FROM supplier), g AS (SELECT DISTINCT c_custkey % 3 AS sex, c_nationkey AS race, c_custkey % 5 AS category FROM customer) SELECT g.sex, g.race, g.category, coalesce((SELECT arg_max(id, (quality, -id)) FROM d WHERE d.sex = g.sex AND d.race = g.race AND d.category = g.category), (SELECT arg_max(id, (quality, -id)) FROM d WHERE d.sex = g.sex AND g.sex <> 0)) AS donor FROM g")
def configured_pools(t):
    """D23."""
    groups = t.customer.select((F.col("c_custkey") % 3).alias("sex"), F.col("c_nationkey").alias("race"), (F.col("c_custkey") % 5).alias("category"))
    donors = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 3).alias("sex"), F.col("s_nationkey").alias("race"), (F.col("s_suppkey") % 5).alias("category"), F.col("s_acctbal").alias("quality"))
    return bindings.configure_pools(groups, donors)


@query("SELECT c_nationkey::VARCHAR AS name, list_sort(list_distinct(list(lower(c_mktsegment)))) AS sounds FROM customer GROUP BY 1")
def sounds_by_name(t):
    """A22."""
    return bindings.sounds_by_name(t.customer.select(F.col("c_nationkey").cast("string").alias("name"), F.col("c_mktsegment").alias("sound")))


@query("SELECT (SELECT count(*) FROM customer) AS speakers, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') AS ready, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'P') AS marked, (SELECT count(*) FROM customer) - count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') AS \"left\" FROM orders")
def binding_progress(t):
    """A18."""
    of = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    return bindings.progress(t.customer.select(F.col("c_custkey").alias("id")), of("F"), of("P"))


@query("SELECT c_nationkey AS identity, count(*) AS generations FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def identity_generations(t):
    """A30."""
    lines = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("speaker"))
    return bindings.generations_of(t.lineitem.select(F.col("l_orderkey").alias("line")), lines, t.customer.select(F.col("c_custkey").alias("speaker"), F.col("c_nationkey").alias("identity")))


@query("SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_orderkey * 10 + l_linenumber IN (SELECT l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_partkey % 2 = 0) AND l_quantity / 20 >= 0.6 THEN 'approved' ELSE 'pending' END AS decision FROM lineitem")
def guarded_decisions(t):
    """D14."""
    s = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey", (F.col("l_quantity") / 20).alias("duration_secs"), F.lit("pending").alias("decision"))
    return bindings.set_decision(s, s.where("l_partkey % 2 = 0").select("id"), "approved").select("id", "decision")


@query("SELECT creature, sound, strref FROM (SELECT s_suppkey AS creature, lower(o_orderpriority) AS sound, o_orderkey AS strref, row_number() OVER (PARTITION BY s_suppkey, lower(o_orderpriority) ORDER BY o_orderkey) AS r FROM orders JOIN supplier ON o_custkey % 50 = s_suppkey % 50) WHERE r = 1")
def companion_sources(t):
    """B17."""
    lines = t.orders.select(F.concat(F.lit("D"), (F.col("o_custkey") % 50).cast("string")).alias("dialogue"), F.col("o_orderpriority").alias("sound"), F.col("o_orderkey").alias("strref"))
    companions = t.supplier.select(F.concat(F.lit("d"), (F.col("s_suppkey") % 50).cast("string")).alias("dialogue"), F.col("s_suppkey").alias("creature"))
    return bindings.companion_sources(lines, companions).select("creature", "sound", "strref")


@query("SELECT c.c_mktsegment || c.c_custkey AS sound, n.name FROM customer c JOIN (SELECT DISTINCT lower(c_mktsegment) || (c_nationkey % 3) AS name, lower(c_mktsegment) AS stem FROM customer) n ON lower(c.c_mktsegment) = n.stem")
def stem_owners(t):
    """J19."""
    sounds = t.customer.select(F.concat("c_mktsegment", F.col("c_custkey").cast("string")).alias("sound"))
    names = t.customer.select(F.concat(F.lower("c_mktsegment"), (F.col("c_nationkey") % 3).cast("string")).alias("name"))
    return pipelines.stem_owners(sounds, names)
