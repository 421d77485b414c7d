"""Queries over lists of identities and lines, plans with reasons, look-ups of resources, documents and event sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import hashing, signal
from ..operators import aggregates, bindings, ordering, predicates, state
from ..sources import binary, tables
from ..streaming import incremental
from . import pipelines
from .registry import query


def identities(t):
    """Suppliers as identities."""
    s = F.col("s_suppkey")
    status = F.element_at(F.array(*map(F.lit, ("unbound", "personal", "failed", "pending"))), (F.col("s_nationkey") % 4 + 1).cast("int"))
    match = F.when(s % 5 == 0, "mismatch").when(s % 5 == 1, "match")
    return t.supplier.select(s.alias("id"), F.col("s_name").alias("name"), (s % 7).alias("lines"), (s % 5).alias("samples"), (s % 3).alias("approved"), (s % 2 + 1).alias("variants"), status.alias("status"), (s % 11 == 0).alias("excluded"), match.alias("voice_match"), F.when(s % 6 == 0, "match").alias("demographic_match"))


IDENTITIES = "WITH i AS (SELECT s_suppkey AS id, s_name AS name, s_suppkey % 7 AS lines, s_suppkey % 5 AS samples, s_suppkey % 3 AS approved, s_suppkey % 2 + 1 AS variants, ['unbound', 'personal', 'failed', 'pending'][s_nationkey % 4 + 1] AS status, s_suppkey % 11 = 0 AS excluded, CASE s_suppkey % 5 WHEN 0 THEN 'mismatch' WHEN 1 THEN 'match' END AS voice_match, CASE s_suppkey % 6 WHEN 0 THEN 'match' END AS demographic_match FROM supplier) "


def pages(rows, orders):
    """The first page of 30 by each order, a feature of the list."""
    chosen = {k: columns() for k, columns in orders.items()}
    firsts = [ordering.ordered(rows, chosen, k, "id").limit(30).select(F.lit(k).alias("sort"), "id") for k in orders]
    return reduce(lambda a, b: a.union(b), firsts)


def _pages_sql(orders: dict[str, str]) -> str:
    return IDENTITIES + " UNION ALL ".join(f"SELECT '{k}' AS sort, id FROM (SELECT id FROM i ORDER BY {o} LIMIT 30)" for k, o in orders.items())


@query(_pages_sql({"name_asc": "name, id", "lines_desc": "lines DESC, name, id", "binding_gap": "(NOT excluded AND status = 'unbound') DESC, name, id", "clone_failed": "(status = 'failed') DESC, name, id"}))
def identity_pages(t):
    """V01, O01, O14, O03."""
    return pages(identities(t), ordering.IDENTITY_ORDERS)


@query(_pages_sql({"name_asc": "name, id", "name_desc": "name DESC, id", "lines_desc": "lines DESC, name, id", "samples_desc": "samples DESC, name, id", "needs_approval": "(samples > 0 AND approved = 0) DESC, name, id"}))
def harvest_pages(t):
    """V06."""
    return pages(identities(t), ordering.HARVEST_ORDERS)


@query(IDENTITIES + "SELECT id, (approved > 0 AND NOT excluded AND status = 'unbound') OR status = 'failed' AS binding, coalesce(NOT excluded AND voice_match = 'mismatch', false) AS mismatch, coalesce(status = 'pending' AND demographic_match = 'match', false) AS matches, (samples > 0 AND approved = 0) OR samples = 0 AS review, variants > 1 AS several FROM i")
def identity_facet_values(t):
    """Which identities pass some selections of facets."""
    wanted = {
        "binding": ({"status": ["needs_binding", "failed"]}, ordering.identity_facets()),
        "mismatch": ({"voice_match": ["mismatch"]}, ordering.identity_facets()),
        "matches": ({"status": ["pending"], "demographic_match": ["match"]}, ordering.identity_facets()),
        "review": ({"review": ["needs_approval", "no_samples"]}, ordering.harvest_facets()),
        "several": ({"review": ["multi_variant"], "status": []}, ordering.harvest_facets()),
    }
    return identities(t).select("id", *(F.coalesce(predicates.facets_with(*w), F.lit(False)).alias(k) for k, w in wanted.items()))


def blocked(t):
    """Orders as blocked lines."""
    o = t.orders
    n = o.o_orderkey % 7
    kind = F.when(n == 0, "token").when(n == 1, "transition").when(n == 2, "script").otherwise("state")
    reason = predicates.blocked_reason(kind, o.o_orderstatus == "F", o.o_orderkey % 13 == 0, o.o_orderpriority == "5-LOW", o.o_custkey % 5 != 0)
    return o.select(o.o_orderkey.alias("id"), o.o_orderkey.alias("strref"), o.o_orderpriority.alias("dialogue"), F.when(o.o_custkey % 9 != 0, o.o_custkey).alias("state"), F.concat(o.o_orderstatus, F.lit(" "), o.o_orderpriority).alias("text"), reason.alias("reason"))


BLOCKED = "WITH b AS (SELECT o_orderkey AS id, o_orderkey AS strref, o_orderpriority AS dialogue, CASE WHEN o_custkey % 9 <> 0 THEN o_custkey END AS state, o_orderstatus || ' ' || o_orderpriority AS text, CASE WHEN o_orderstatus = 'F' THEN 'already voiced' WHEN o_orderkey % 13 = 0 OR o_orderkey % 7 = 0 THEN 'dynamic token' WHEN o_orderkey % 7 IN (1, 2) THEN 'not a state line' WHEN o_orderpriority = '5-LOW' THEN 'shared (different voice)' WHEN o_custkey % 5 = 0 THEN 'unattributed' ELSE 'other' END AS reason FROM orders) "
_PLACE = "dialogue, state NULLS LAST, strref, id"


@query(BLOCKED + f"SELECT 'all' AS list, id FROM (SELECT id FROM b ORDER BY reason, {_PLACE} LIMIT 200 OFFSET 50) UNION ALL SELECT 'tokens', id FROM (SELECT id FROM b WHERE reason = 'dynamic token' AND (contains(strref::VARCHAR, '1-urg') OR contains(lower(dialogue || ':' || coalesce(state::VARCHAR, '')), '1-urg') OR contains(lower(text), '1-urg')) ORDER BY lower(text) DESC, {_PLACE} LIMIT 100)")
def blocked_pages(t):
    """Pages of blocked lines."""
    rows = blocked(t)
    every, some = ordering.blocked_page(rows, 50, 1000, sort="reason")[0], ordering.blocked_page(rows, query=" 1-URG ", reason="dynamic token", sort="text_desc")[0]
    return every.select(F.lit("all").alias("list"), "id").union(some.select(F.lit("tokens"), "id"))


@query(BLOCKED + "SELECT count(*) FILTER (reason = 'unattributed' AND (contains(strref::VARCHAR, '42') OR contains(lower(dialogue || ':' || coalesce(state::VARCHAR, '')), '42') OR contains(text, '42'))) AS total, count(*) FILTER (reason = 'dynamic token') AS token_total FROM b")
def blocked_totals(t):
    """Totals of all lines, whatever the page."""
    return ordering.blocked_page(blocked(t), query="42", reason="unattributed")[1]


@query("SELECT count(*) AS shared_groups, count(*) FILTER (p_size > 25) AS deferred_groups FROM part WHERE p_partkey IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 20)")
def referenced_groups(t):
    """A04."""
    groups = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, "defer_diff_voice").otherwise("reuse_same_voice").alias("resolution"))
    return aggregates.referenced_groups(groups, t.lineitem.select(F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 20), F.col("l_partkey")).alias("shared_group_id")))


@query("WITH m AS (SELECT c_nationkey AS identity, c_custkey AS speaker, c_custkey % 17 AS lines FROM customer), b AS (SELECT s_suppkey * 3 AS speaker, CASE WHEN s_nationkey % 3 = 0 THEN 'generic' ELSE 'override' END AS source, CASE WHEN s_suppkey % 4 = 0 THEN 'ready' ELSE 'pending' END AS status, CASE WHEN s_suppkey % 8 <> 0 THEN s_suppkey END AS sample FROM supplier), r AS (SELECT identity, arg_max(speaker, (lines, -speaker)) AS main FROM m GROUP BY 1), h AS (SELECT m.identity, b.*, source <> 'generic' AS own, coalesce(source <> 'generic' AND status = 'ready' AND sample IS NOT NULL, false) AS ready, b.speaker = main AS is_main FROM m JOIN b USING (speaker) JOIN r USING (identity)) SELECT identity, arg_max(speaker, (own, ready, is_main, -speaker)) AS speaker FROM h WHERE own OR is_main GROUP BY 1")
def personal_bindings(t):
    """W15."""
    s = F.col("s_suppkey")
    members = t.customer.select(F.col("c_nationkey").alias("identity"), F.col("c_custkey").alias("speaker"), (F.col("c_custkey") % 17).alias("lines"))
    held = t.supplier.select((s * 3).alias("speaker"), F.when(F.col("s_nationkey") % 3 == 0, "generic").otherwise("override").alias("source"), F.when(s % 4 == 0, "ready").otherwise("pending").alias("status"), F.when(s % 8 != 0, s).alias("sample"))
    return bindings.personal_binding(members, held).select("identity", "speaker")


@query("SELECT o_orderkey AS strref, CASE WHEN o_orderkey % 7 = 0 THEN 'not an NPC dialogue state (transition/script/token kind)' WHEN o_orderkey % 13 = 0 THEN 'line has dynamic tokens (<PRO_*>/<CHARNAME>/...)' WHEN o_orderkey % 17 = 0 THEN 'line is intentionally silent (no speakable dialogue text)' WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'line is already voiced in the target' WHEN o_custkey % 5 = 0 THEN 'line has no uniquely attributed speaker' WHEN o_custkey % 7 = 0 THEN 'speaker excluded from pack' WHEN o_orderpriority = '5-LOW' THEN 'shared strref with a different/unknown voice (deferred)' WHEN o_orderpriority = '1-URGENT' THEN 'generated clip is missing on disk' WHEN o_orderkey >= 40000 THEN 'strref is not present in the target dialog.tlk' END AS reason FROM orders")
def export_plan(t):
    """The lines of a pack, and those that wait with their reason."""
    o = t.orders
    candidates = o.select(
        o.o_orderkey.alias("strref"), F.when(o.o_orderkey % 7 == 0, "script").otherwise("state").alias("kind"), (o.o_orderkey % 13 == 0).alias("has_tokens"), F.when(o.o_orderkey % 17 == 0, "...").otherwise("Well met.").alias("text"),
        (o.o_orderstatus == "F").alias("voiced"), F.when(o.o_custkey % 2 == 0, "VOICE1").otherwise("Z00001AB").alias("sound"), F.when(o.o_custkey % 5 != 0, o.o_custkey).alias("speaker"), (o.o_custkey % 7 == 0).alias("excluded"),
        F.when(o.o_orderpriority == "5-LOW", "defer_diff_voice").otherwise("single").alias("resolution"), (o.o_orderpriority != "1-URGENT").alias("on_disk"),
    )
    planned, deferred = pipelines.assemble(candidates, t.region.select(F.lit("Z0000000").alias("name")), predicates.export_reasons(40_000))
    return planned.select("strref", F.lit(None).cast("string").alias("reason")).union(deferred.select("strref", "reason"))


@query("SELECT s_suppkey, list_filter([CASE WHEN s_suppkey % 3 = 0 THEN 'sample_owner_mismatch' END, CASE WHEN s_suppkey % 4 IN (1, 2) THEN 'foreign_sound_stem' END, CASE WHEN s_suppkey % 4 = 1 AND s_suppkey % 5 = 0 THEN 'crowd_with_companion_stem' END, CASE WHEN s_suppkey % 6 = 0 THEN 'manual_only_primary' END, CASE WHEN s_nationkey >= 2 THEN 'shared_source' END], lambda x: x IS NOT NULL) AS hints FROM supplier")
def suspicious_bindings(t):
    """P14."""
    s = F.col("s_suppkey")
    sound = F.element_at(F.array(*map(F.lit, ("GAVIN12", "jaheir62", "KYLIA01", "x1"))), (s % 4 + 1).cast("int"))
    rows = t.supplier.select(s, F.when(s % 5 == 0, " Boy").otherwise("Gavin").alias("display_name"), F.lit("GAVIN2").alias("name"), s.alias("speaker"), F.when(s % 3 == 0, s + 1).when(s % 3 == 1, s).alias("sample_owner"), sound.alias("sound"), F.array(F.lit("gavin"), F.lit("gav9")).alias("members"), F.array(F.lit("kylia")).alias("foreign_stems"), (s % 6 != 0).alias("automatic"), F.col("s_nationkey").alias("shared"))
    return pipelines.binding_hints(rows).select("s_suppkey", "hints")


@query("SELECT c_custkey AS binding, 'b' || c_nationkey AS speaker, coalesce(n, 0)::INT AS n, coalesce(listed, '') AS listed FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, string_agg(o_orderkey || '=' || o_orderstatus, ',' ORDER BY o_orderkey % 10, o_orderkey) AS listed FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def binding_documents(t):
    """P15, B11."""
    held = t.customer.select(F.col("c_custkey").alias("binding"), F.concat(F.lit("b"), F.col("c_nationkey").cast("string")).alias("speaker"), F.lit("override").alias("source"), F.lit("ready").alias("status"))
    samples = t.orders.select(F.col("o_custkey").alias("binding"), (F.col("o_orderkey") % 10).cast("int").alias("sort_order"), F.col("o_orderkey").alias("sample"), F.col("o_orderstatus").alias("sound"))
    found = pipelines.binding_document(held, samples)
    listed = F.array_join(F.transform("samples", lambda x: F.concat(x["sample"].cast("string"), F.lit("="), x["sound"])), ",")
    return found.select("binding", "detail.speaker", F.size("samples").alias("n"), listed.alias("listed"))


@query("WITH c AS (SELECT p_name || p_partkey % 3 AS name, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS long_name, p_size > 20 AS usable, p_partkey FROM part), l AS (SELECT DISTINCT p_name AS label, p_name || CASE WHEN length(p_name) % 2 = 0 THEN '1' ELSE '' END AS prefix FROM part), h AS (SELECT label, name, usable, long_name, lower(name) = lower(prefix) AS exact FROM l JOIN c ON starts_with(lower(name), lower(prefix)) WHERE long_name IS NOT NULL), w AS (SELECT *, count(*) OVER g AS n, max(exact) OVER g AS any_exact, min(name) OVER g AS least FROM h WINDOW g AS (PARTITION BY label, long_name)) SELECT label, name FROM w QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, any_exact DESC, least, exact DESC, usable DESC, name) = 1")
def dominant_creatures(t):
    """Few labels, each with the creatures whose names start with it."""
    p = F.col("p_partkey")
    creatures = t.part.select(F.concat("p_name", (p % 3).cast("string")).alias("name"), F.when(p % 7 != 0, F.col("p_brand")).alias("long_name"), (F.col("p_size") > 20).alias("usable"))
    labels = t.part.select(F.col("p_name").alias("label"), F.concat("p_name", F.when(F.length("p_name") % 2 == 0, "1").otherwise("")).alias("prefix")).distinct()
    return pipelines.dominant_creature(creatures, labels)


@query("WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, ['jaheir', 'Jan', 'minsc', 'MINS'][l_suppkey % 4 + 1] || l_linenumber AS name, ['JAHEIR62', 'minsca2', 'jan3'][l_partkey % 3 + 1] AS sound, l_linenumber - 3 AS hits FROM lineitem), y AS (SELECT id, hits, regexp_replace(lower(name), '[0-9]+$', '') AS own, lower(sound) AS low FROM x) SELECT id, (greatest(hits, 0) + CASE WHEN own = regexp_replace(low, '[0-9]+$', '') THEN 100 WHEN length(own) >= 4 AND starts_with(low, own) THEN 50 ELSE 0 END)::INT AS score FROM y")
def owner_scores(t):
    """M08."""
    s = t.lineitem
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    rows = s.select((s.l_orderkey * 10 + s.l_linenumber).alias("id"), F.concat(pick(("jaheir", "Jan", "minsc", "MINS"), s.l_suppkey % 4), s.l_linenumber.cast("string")).alias("name"), pick(("JAHEIR62", "minsca2", "jan3"), s.l_partkey % 3).alias("sound"), (s.l_linenumber - 3).alias("hits"))
    return rows.select("id", signal.owner_score(F.col("sound"), F.col("name"), F.col("hits")).cast("int").alias("score"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = c_custkey % 3 THEN 8 ELSE 0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 4 ELSE 0 END + CASE WHEN coalesce(o_orderkey % 25 = c_nationkey, false) THEN 2 ELSE 0 END AS likeness FROM orders JOIN customer ON o_custkey = c_custkey")
def demographic_likeness(t):
    """M09."""
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    one = F.struct((F.col("o_custkey") % 2).alias("sex"), F.lit("BUILDING").alias("category"), (F.col("o_orderkey") % 25).alias("race"))
    other = F.struct((F.col("c_custkey") % 3).alias("sex"), F.col("c_mktsegment").alias("category"), F.col("c_nationkey").alias("race"))
    return joined.select("o_orderkey", one.alias("a"), other.alias("b")).select("o_orderkey", signal.demographic_similarity("a", "b").alias("likeness"))


@query("SELECT user_id, CASE WHEN max(value) > 0 THEN round(least(sum(value) / (max(value) * 20), 1.0), 6) ELSE 0.0 END AS ratio FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS value FROM events) GROUP BY 1")
def speech_ratios(t):
    """M15."""
    length = F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value"))
    spans = t.events.groupBy("user_id").agg(F.collect_list(F.struct(F.lit(0.0).alias("start"), length.alias("end"))).alias("segments"), F.max(length).alias("most"))
    return spans.select("user_id", F.round(signal.speech_ratio(F.col("segments"), F.col("most") * 20), 6).alias("ratio"))


@query("SELECT o_orderkey AS first_id, o_orderstatus AS override, o_orderpriority AS text FROM orders WHERE o_orderkey > 100 AND o_orderkey % 3 = 0 ORDER BY 1 LIMIT 50")
def override_rows(t):
    """A page by key."""
    o = t.orders
    digest = hashing.text_hash(o.o_orderkey.cast("string"))
    cache = o.select(digest.alias("text_hash"), o.o_orderkey.alias("first_id"), o.o_orderpriority.alias("text"))
    return bindings.override_page(o.where("o_orderkey % 3 = 0").select(digest.alias("text_hash"), o.o_orderstatus.alias("override")), cache, 100, 50).select("first_id", "override", "text")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'calm' END AS preset, sha256('{\"manual\":' || CASE o_orderkey % 3 WHEN 0 THEN 'true' ELSE 'false' END || ',\"preset\":\"' || o_orderpriority || '\",\"steps\":' || o_custkey || '}') AS settings_hash FROM orders")
def preset_patches(t):
    """B20, H16, H18."""
    n = F.col("o_orderkey")
    rows = t.orders.select("o_orderkey", F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("manual"), F.col("o_orderpriority").alias("preset"), "o_custkey")
    settings = F.struct(F.coalesce("manual", F.lit(False)).alias("manual"), "preset", F.col("o_custkey").alias("steps"))
    return bindings.preset_patch(rows.withColumn("settings_hash", hashing.settings_hash(settings)), "calm").select("o_orderkey", "preset", "settings_hash")


@query(
    "SELECT o_orderkey, sha256('{\"Zeta\":[{\"a\":' || o_custkey || ',\"b\":null}],\"alpha\":{\"deep\":{\"x\":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'null' END || ',\"y\":\"' || o_orderpriority || '\"}},\"map\":{\"a\":' || o_orderkey || ',\"b\":null}}') AS settings_hash, true AS same FROM orders"
)
def canonical_settings(t):
    """Nested settings in two orders of fields, with nulls, have one hash, and text that says the same has it too."""
    part, key = F.struct(F.lit(None).cast("int").alias("b"), F.col("o_custkey").alias("a")), F.col("o_orderkey")
    flag = F.when(key % 2 == 0, True).alias("x")
    words = F.create_map(F.lit("b"), F.lit(None).cast("bigint"), F.lit("a"), key)
    one = F.struct(words.alias("map"), F.struct(F.struct(F.col("o_orderpriority").alias("y"), flag).alias("deep")).alias("alpha"), F.array(part).alias("Zeta"))
    two = F.struct(F.array(F.struct(F.col("o_custkey").alias("a"), F.lit(None).cast("int").alias("b"))).alias("Zeta"), F.struct(F.struct(flag, F.col("o_orderpriority").alias("y")).alias("deep")).alias("alpha"), words.alias("map"))
    rows = t.orders.select("o_orderkey", one.alias("one"), two.alias("two"))
    a, b = (hashing.settings_hash(F.col(c), rows.schema[c].dataType) for c in ("one", "two"))
    return rows.select("o_orderkey", a.alias("settings_hash"), ((a == b) & (a == hashing.settings_hash(F.col("one")))).alias("same"))


def resources(t):
    """Parts as an index of resources: brands by type."""
    codes = list(binary.TYPES)[:4]
    kind = F.element_at(F.array(*map(F.lit, codes)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select(F.col("p_partkey").alias("id"), F.lower("p_brand").alias("resref"), binary.type_code(kind).alias("type"))


KINDS = ", ".join(f"'{k}'" for k in list(binary.TYPES)[:4])


@query(f"SELECT p_partkey AS id, [{KINDS}][p_partkey % 4 + 1] AS extension FROM part WHERE p_partkey % 4 = 1 AND p_brand IN (SELECT 'Brand#' || n_nationkey FROM nation)")
def located_resources(t):
    """S02, S20."""
    wanted = t.nation.select(F.concat(F.lit("BRAND#"), F.col("n_nationkey").cast("string")).alias("resref"), binary.type_code(F.lit("WAV")).alias("type"))
    return binary.locate(resources(t), wanted).select("id", binary.extension(F.col("type")).alias("extension"))


@query("SELECT lower(p_brand) AS resref FROM part WHERE p_partkey % 4 = 2")
def names_of_type(t):
    """S03."""
    return binary.names_of_type(resources(t), binary.TYPES["dlg"])


@query("SELECT resref, arg_min(path, (rank, path)) AS path FROM (SELECT 'sound' || o_custkey AS resref FROM orders GROUP BY 1) LEFT JOIN (SELECT 'sound' || p_partkey % 900 AS name, p_name || p_partkey AS path, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS rank FROM part WHERE p_partkey % 4 <> 3) ON name = resref GROUP BY 1")
def resolved_sounds(t):
    """S08."""
    p = F.col("p_partkey")
    files = t.part.select(F.concat(F.lit("SOUND"), (p % 900).cast("string")).alias("resref"), F.element_at(F.array(*map(F.lit, ("acm", "OGG", "wav", "mp3"))), (p % 4 + 1).cast("int")).alias("extension"), F.concat("p_name", p.cast("string")).alias("path"))
    return binary.resolve_sounds(t.orders.select(F.concat(F.lit("Sound"), F.col("o_custkey").cast("string")).alias("resref")), files)


@query("SELECT c_custkey AS id, nullif(trim(c_mktsegment), '') AS value FROM customer WHERE c_nationkey = 3")
def project_rows(t):
    """S23, S24."""
    rows = t.customer.select(F.col("c_nationkey").alias("project_id"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"), F.lit("segment").alias("key"))
    own = tables.ordered_scan(rows, 3)
    return own.select("id", F.nullif(F.trim("value"), F.lit("")).alias("value"))


@query("SELECT o_orderkey, o_custkey % 4 AS project_id FROM orders WHERE o_custkey % 4 <> 2")
def invalidated_cache(t):
    """D06."""
    return state.invalidated(t.orders.select("o_orderkey", (F.col("o_custkey") % 4).alias("project_id")), 2)


@query("WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 30 MINUTE, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 1800000000 AS ends, count(*) AS n FROM n GROUP BY user_id, s")
def event_sessions(t):
    """The stream's sessions over a table, with times as microseconds."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return incremental.sessions(utc(t.events)).select("user_id", us("start").alias("start"), us("end").alias("ends"), "n")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(t):
    """The stream's windows over a table."""
    return incremental.windowed_counts(utc(t.events)).select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def utc(events):
    """Times without a zone, taken as UTC whatever the session's zone is."""
    return events.withColumn("ts", F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts").cast("timestamp_ntz")).cast("timestamp"))
