"""Queries of bindings, profiles and reviews over tables that are made from customers, suppliers and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bindings, state
from .registry import query

HELD = """WITH b AS (SELECT c_custkey AS speaker, ['override', 'generic', 'follow', 'override'][c_custkey % 4 + 1] AS source, CASE WHEN c_custkey % 4 = 2 OR c_custkey % 20 = 3 THEN c_custkey + 1 END AS follows, CASE WHEN c_custkey % 7 > 0 THEN 1000 + c_custkey % 50 END AS profile, CASE WHEN c_custkey % 5 > 0 THEN 'ready' ELSE 'pending' END AS status FROM customer),
m AS (SELECT c_custkey AS speaker, 'g' || (c_custkey // 3) AS identity FROM customer), p AS (SELECT 1000 + p_partkey AS profile, ['harvested', 'imported', 'designed', 'harvested'][p_partkey % 4 + 1] AS origin, p_partkey * 4 AS owner FROM part WHERE p_partkey < 50),
s AS (SELECT s_suppkey * 2 AS speaker, CASE WHEN s_suppkey % 3 = 0 THEN 'approved' ELSE 'pending' END AS decision FROM supplier),
stale AS (SELECT b.speaker, identity FROM b JOIN m USING (speaker) WHERE source = 'override' AND follows IS NULL AND (profile IS NULL OR profile NOT IN (SELECT profile FROM p WHERE origin <> 'harvested')) AND identity NOT IN (SELECT identity FROM s JOIN m USING (speaker) WHERE decision = 'approved'))"""


def held(t):
    """Bindings, members of identities, profiles and samples."""
    c, k = t.customer, F.col("c_custkey")
    source = F.get(F.array(*map(F.lit, ("override", "generic", "follow", "override"))), (k % 4).cast("int"))
    b = c.select(k.alias("speaker"), source.alias("source"), F.when((k % 4 == 2) | (k % 20 == 3), k + 1).alias("follows"), F.when(k % 7 > 0, 1000 + k % 50).alias("profile"), F.when(k % 5 > 0, "ready").otherwise("pending").alias("status"))
    m = c.select(k.alias("speaker"), F.concat(F.lit("g"), F.floor(k / 3).cast("string")).alias("identity"))
    q = F.col("p_partkey")
    origin = F.get(F.array(*map(F.lit, ("harvested", "imported", "designed", "harvested"))), (q % 4).cast("int"))
    p = t.part.where("p_partkey < 50").select((1000 + q).alias("profile"), origin.alias("origin"), (q * 4).alias("owner"))
    s = t.supplier.select((F.col("s_suppkey") * 2).alias("speaker"), F.when(F.col("s_suppkey") % 3 == 0, "approved").otherwise("pending").alias("decision"))
    return b, m, p, s


@query(HELD + " SELECT speaker, identity FROM stale")
def stale_bindings(t):
    """B02."""
    b, m, p, s = held(t)
    return bindings.stale_personal(b, p, s, m)


@query(HELD + " SELECT speaker, source, profile FROM b JOIN m USING (speaker) WHERE identity NOT IN (SELECT identity FROM stale)")
def bindings_without_stale(t):
    """B03, D16."""
    b, m, p, s = held(t)
    return bindings.clear_stale(b, bindings.stale_personal(b, p, s, m), m).select("speaker", "source", "profile")


@query(HELD + " SELECT speaker, CASE WHEN source = 'generic' AND profile = 1009 THEN 77 ELSE profile END AS profile FROM b")
def synced_pool_voice(t):
    """B04."""
    return bindings.sync_pool_voice(held(t)[0], 1009, 77).select("speaker", "profile")


@query(HELD + " SELECT b.speaker, CASE WHEN source = 'override' AND h.owner <> b.speaker THEN own.profile ELSE b.profile END AS profile FROM b LEFT JOIN p h ON b.profile = h.profile AND h.origin = 'harvested' LEFT JOIN (SELECT owner, min(profile) AS profile FROM p WHERE origin = 'harvested' GROUP BY 1) own ON own.owner = b.speaker")
def repaired_profiles(t):
    """B05."""
    b, _, p, _ = held(t)
    return bindings.repair_mismatched(b, p).select("speaker", "profile")


POOLED = "pools AS (SELECT p_size AS key, list(DISTINCT 1000 + p_partkey % 50) AS members FROM part WHERE p_partkey % 9 < 4 GROUP BY 1)"


@query(HELD + f", {POOLED} SELECT key, list_sort([x FOR x IN members IF x <> 1008]) AS members, (SELECT count(*) FROM b WHERE profile = 1008) AS bindings, (SELECT count(*) FROM pools WHERE list_contains(members, 1008)) AS pools FROM pools WHERE members <> [1008]")
def deleted_profile(t):
    """Pools without a profile, beside the counts of what depended on it."""
    b = held(t)[0]
    pools = t.part.where("p_partkey % 9 < 4").groupBy(F.col("p_size").alias("key")).agg(F.sort_array(F.collect_set(1000 + F.col("p_partkey") % 50)).alias("members"))
    counts, _, left = bindings.delete_profile(1008, b, pools)
    return left.join(counts, how="cross")  # one row


@query(HELD + " SELECT DISTINCT identity FROM m JOIN b USING (speaker) WHERE source = 'override' AND status = 'ready'")
def groups_with_own_voice(t):
    """B13."""
    b, m, _, _ = held(t)
    return bindings.has_personal(m, b)


@query("SELECT p_partkey AS first_id, CASE WHEN p_partkey % 5 = 1 THEN 'command fragment' ELSE 'words differ' END AS reason FROM part WHERE p_partkey > 40 AND (p_partkey % 5 = 1 OR p_partkey % 7 = 3) ORDER BY 1 LIMIT 500")
def suspicious_texts(t):
    """Overrides with other words or with a command's option, a page of them."""
    k = F.col("p_partkey")
    changed = F.concat(F.upper("p_name"), F.when(k % 5 == 1, " --batch").otherwise("!"), F.when(k % 7 == 3, " more").otherwise(""))
    rows = t.part.select(k.alias("first_id"), F.col("p_name").alias("text"), changed.alias("override"))
    return bindings.suspicious_overrides(rows, 40, 500).select("first_id", "reason")


REVIEWED = "WITH c AS (SELECT doc_id AS text_hash, doc_id % 3 = 0 AS plain, doc_id % 4 = 1 AS needs FROM documents), r AS (SELECT doc_id AS text_hash FROM labels WHERE quality = 1), o AS (SELECT doc_id AS text_hash FROM labels WHERE toxic = 1)"


def reviewed(t):
    k = F.col("doc_id")
    cache = t.documents.select(k.alias("text_hash"), (k % 3 == 0).alias("plain"), (k % 4 == 1).alias("needs"))
    return t.labels.where("quality = 1").select(k.alias("text_hash")), cache, t.labels.where("toxic = 1").select(k.alias("text_hash"))


@query(REVIEWED + " SELECT text_hash FROM r WHERE text_hash NOT IN (SELECT text_hash FROM c WHERE needs AND text_hash NOT IN (SELECT text_hash FROM o))")
def reconciled_reviews(t):
    """D11."""
    reviews, cache, overrides = reviewed(t)
    return bindings.reconcile_reviews(reviews, cache, overrides, F.col("needs"))


@query(REVIEWED + " SELECT text_hash FROM r UNION SELECT text_hash FROM c WHERE plain")
def plain_reviews(t):
    """D12."""
    reviews, cache, _ = reviewed(t)
    return bindings.review_plain(reviews, cache, F.col("plain"))


@query("SELECT doc_id, 2 AS version, length(text)::INT AS chars FROM documents")
def rebuilt_cache(t):
    """A cache of which a row has an old version is built anew."""
    old = t.documents.select("doc_id", F.when(F.col("doc_id") % 50 == 0, 1).otherwise(2).alias("version"), F.lit(-1).alias("chars"))
    return state.rebuilt(old, 2, lambda: t.documents.select("doc_id", F.lit(2).alias("version"), F.length("text").alias("chars")))
