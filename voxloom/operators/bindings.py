"""Voice bindings: effective bindings, stale ones, profiles, pools and reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, trim
from . import graph, ranking, state


def lookup(rows: DataFrame, table: DataFrame, on: str, value: str, out: str, default: object = None) -> DataFrame:
    """A value by natural key, or a default."""
    keyed = table.select(F.col(on).alias("_k"), F.col(value).alias("_v"))
    return rows.join(keyed, F.col(on) == F.col("_k"), "left").withColumn(out, F.coalesce("_v", F.lit(default))).drop("_k", "_v")


def text_owners(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """For each source (id, source_text) the least line whose text is the same but for spaces around."""
    a, b = lines.select(F.trim("text").alias("_t"), F.col("id").alias("line")), sources.select("id", F.trim("source_text").alias("_t"))
    return b.join(a.groupBy("_t").agg(F.min("line").alias("line")), "_t").select("id", "line")


def completed(generations: DataFrame, lines: DataFrame, bindings: DataFrame) -> DataFrame:
    """Finished generations with their line, binding and the end of the binding's follow chain."""
    done = generations.where("status = 'done'")
    voices = graph.resolved_voices(bindings.select("speaker", "source", "follows")).select(F.col("speaker").alias("_s"), F.col("at").alias("voice"))
    return done.join(lines.withColumnRenamed("id", "line"), "line").join(voices, F.col("speaker") == F.col("_s"), "left").drop("_s")


def export_candidates(generations: DataFrame, lines: DataFrame, speakers: DataFrame, bindings: DataFrame, shared: DataFrame) -> DataFrame:
    """Finished generations with all that decides on their export, absent parts as stated defaults."""
    found = completed(generations, lines, bindings)
    named = found.join(speakers.select(F.col("id").alias("speaker"), "excluded"), "speaker", "left").join(shared.select("strref", "resolution"), "strref", "left")
    return named.withColumn("excluded", F.coalesce("excluded", F.lit(False))).withColumn("resolution", F.coalesce("resolution", F.lit("single")))


def effective_bindings(speakers: DataFrame, bindings: DataFrame) -> DataFrame:
    """Each speaker (id, name) with its binding, whom it follows, and the speaker at the end of the chain, by name."""
    named = speakers.select("id", "name")
    own = bindings.select(F.col("speaker").alias("_s"), "source", "follows", "status")
    voices = graph.resolved_voices(bindings).select(F.col("speaker").alias("_v"), F.col("at").alias("donor"))
    joined = named.join(own, F.col("id") == F.col("_s"), "left").join(voices, F.col("id") == F.col("_v"), "left").drop("_s", "_v")
    for column, out in (("follows", "follow_name"), ("donor", "donor_name")):
        joined = joined.join(named.select(F.col("id").alias("_i"), F.col("name").alias(out)), F.col(column) == F.col("_i"), "left").drop("_i")
    return joined


def donor_pool(samples: DataFrame, speakers: DataFrame, demographics: Sequence[str] = ("sex", "race", "category")) -> DataFrame:
    """Each speaker's latest approved sample, with its demographics."""
    last = ranking.latest(samples.where("decision = 'approved'"), ["speaker"], "overall")
    return last.join(speakers.select(F.col("id").alias("speaker"), *demographics), "speaker").withColumnRenamed("id", "sample")


def progress(speakers: DataFrame, ready: DataFrame, marked: DataFrame) -> DataFrame:
    """Speakers, how many are ready, marked, and left, in one pass over a flagged join."""
    flags = speakers.select("id").join(ready.select("id").distinct().withColumn("_r", F.lit(1)), "id", "left").join(marked.select("id").distinct().withColumn("_m", F.lit(1)), "id", "left")
    return flags.agg(F.count("*").alias("speakers"), F.count("_r").alias("ready"), F.count("_m").alias("marked")).withColumn("left", F.greatest(F.col("speakers") - F.col("ready"), F.lit(0)))


def sounds_by_name(samples: DataFrame) -> DataFrame:
    """The sounds that each resource name has, in any case, once each and in order."""
    return samples.groupBy(ascii_lower(F.col("name")).alias("name")).agg(F.sort_array(F.collect_set(ascii_lower(F.col("sound")))).alias("sounds"))


def generations_of(generations: DataFrame, lines: DataFrame, members: DataFrame) -> DataFrame:
    """How many generations the members of each identity have."""
    return generations.join(lines.select(F.col("id").alias("line"), "speaker"), "line").join(members, "speaker").groupBy("identity").agg(F.count("*").alias("generations"))


def stale_personal(bindings: DataFrame, profiles: DataFrame, samples: DataFrame, members: DataFrame) -> DataFrame:
    """Speakers whose personal binding has nothing behind it: an override that follows nobody, whose profile wasn't
    imported or designed, in a display group without an approved sample."""
    own = bindings.where("source = 'override' AND follows IS NULL")
    made = profiles.where(F.col("origin").isin("imported", "designed")).select("profile")
    approved = samples.where("decision = 'approved'").join(members, "speaker").select("identity").distinct()
    return own.join(made, "profile", "left_anti").join(members, "speaker").join(approved, "identity", "left_anti").select("speaker", "identity")


def clear_stale(bindings: DataFrame, stale: DataFrame, members: DataFrame) -> DataFrame:
    """Bindings without those of all members of the stale speakers' groups."""
    gone = members.join(stale.select("identity").distinct(), "identity", "left_semi").select("speaker")
    return bindings.join(gone, "speaker", "left_anti")


def sync_pool_voice(bindings: DataFrame, old: int, new: int) -> DataFrame:
    """Generic bindings of one profile move to another."""
    return bindings.withColumn("profile", F.when((F.col("source") == "generic") & (F.col("profile") == old), F.lit(new)).otherwise(F.col("profile")))


def repair_mismatched(bindings: DataFrame, profiles: DataFrame) -> DataFrame:
    """A personal binding whose harvested profile belongs to another speaker takes the speaker's own, or loses it."""
    owned = profiles.where("origin = 'harvested'")
    owner = owned.select("profile", F.col("owner").alias("_owner"))
    own = owned.groupBy(F.col("owner").alias("_speaker")).agg(F.min("profile").alias("_own"))
    joined = bindings.join(owner, "profile", "left").join(own, F.col("speaker") == F.col("_speaker"), "left")
    wrong = (F.col("source") == "override") & F.col("_owner").isNotNull() & (F.col("_owner") != F.col("speaker"))
    return joined.withColumn("profile", F.when(wrong, F.col("_own")).otherwise(F.col("profile"))).select(bindings.columns)


def delete_profile(profile: int, bindings: DataFrame, pools: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts of what depends on a profile, bindings without it, pools (key, members) without it)."""
    hit = F.coalesce(F.col("profile") == profile, F.lit(False))
    in_pool = F.array_contains("members", profile)
    counts = bindings.agg(F.count_if(hit).alias("bindings")).crossJoin(pools.agg(F.count_if(in_pool).alias("pools")))  # one row each
    return counts, bindings.where(~hit), pools.withColumn("members", F.array_remove("members", profile)).where(F.size("members") > 0)


def references(samples: DataFrame, binding: str = "binding") -> DataFrame:
    """For each binding its approved members in order, and a fingerprint of their ids, transcripts and bytes."""
    kept = samples.where("decision = 'approved'")
    part = F.struct("sort_order", "id", "text", F.sha2("content", 256).alias("sha"))
    listed = kept.groupBy(binding).agg(F.sort_array(F.collect_list(part)).alias("members"))
    told = F.array_join(F.transform("members", lambda m: F.concat_ws("\u0001", m["id"].cast("string"), m["text"], m["sha"])), "\u0002")
    return listed.select(binding, F.transform("members", lambda m: m["id"]).alias("ids"), F.sha2(told, 256).alias("fingerprint"))


def follow(bindings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Bindings where each (speaker, target) follows, but for pairs that would go round or lack a bound target.

    Pairs of one call are judged together (see graph.closes_ring); of pairs of one speaker the least target counts.
    """
    once = pairs.groupBy("speaker").agg(F.min("target").alias("target"))
    fine = graph.closes_ring(bindings, once).where("NOT cycle").select("speaker", "target")
    bound = fine.join(bindings.select(F.col("speaker").alias("target")), "target", "left_semi")
    fresh = bound.select("speaker", F.lit("follow").alias("source"), F.col("target").alias("follows"))
    return state.upsert(bindings.select("speaker", "source", "follows"), fresh, ["speaker"])


def has_personal(members: DataFrame, bindings: DataFrame) -> DataFrame:
    """Identities of which a member has a ready personal binding."""
    ready = bindings.where("source = 'override' AND status = 'ready'").select("speaker")
    return members.join(ready, "speaker", "left_semi").select("identity").distinct()


def personal_binding(members: DataFrame, bindings: DataFrame) -> DataFrame:
    """For each identity (members: identity, speaker, lines) the binding that counts as its own: of bindings that are not
    generic the ready ones with a sample, else any; of these the representative's (most lines, then the least speaker)
    and then the least speaker's. Without such a binding the representative's, whatever it is, if there is one."""
    main = members.groupBy("identity").agg(F.max_by("speaker", F.struct("lines", (-F.col("speaker")).alias("low"))).alias("main"))
    held = members.join(bindings, "speaker").join(main, "identity").withColumn("_main", F.col("speaker") == F.col("main"))
    own = F.coalesce(F.col("source") != "generic", F.lit(True))
    ready = own & (F.col("status") == "ready") & F.col("sample").isNotNull()
    choice = held.where(own | F.col("_main")).withColumn("_own", own).withColumn("_ready", F.coalesce(ready, F.lit(False)))
    return ranking.best(choice, ["identity"], F.struct("_own", "_ready", "_main", (-F.col("speaker")).alias("low"))).select("identity", *bindings.columns)


def override_page(overrides: DataFrame, cache: DataFrame, after: int, limit: int) -> DataFrame:
    """Overrides with their cached texts, by least line id after a cursor."""
    return overrides.join(cache.select("text_hash", "first_id", "text"), "text_hash").where(F.col("first_id") > after).orderBy("first_id").limit(limit)


def suspicious_overrides(overrides: DataFrame, after: int, limit: int) -> DataFrame:
    """Overrides (first_id, text, override) whose words differ or that look like a tool's output, with the reason; filtered before the limit."""
    from ..functions.text import artifact_reason, same_words

    reason = F.coalesce(artifact_reason(F.col("override")), F.when(~same_words(F.col("text"), F.col("override")), "words differ"))
    return overrides.withColumn("reason", reason).where((F.col("first_id") > after) & F.col("reason").isNotNull()).orderBy("first_id").limit(limit)


def companion_sources(lines: DataFrame, companions: DataFrame) -> DataFrame:
    """Voiced lines of companions' dialogues, each sound once for each creature, the lowest strref first.

    A dialogue's lines are brought down to one for each sound before companions meet them, so the join makes a row for each
    companion and sound, however many lines a dialogue has and companions share it. A null strref comes last.
    """
    voiced = lines.where(F.coalesce(trim(F.col("sound")), F.lit("")) != "").withColumns({"dialogue": F.lower("dialogue"), "sound": F.lower("sound")})
    found = _lowest(voiced, ["dialogue", "sound"]).join(companions.select(F.lower("dialogue").alias("dialogue"), "creature").distinct(), "dialogue")
    return _lowest(found, ["creature", "sound"])


def _lowest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of the lowest strref of each key, aggregated before the shuffle."""
    by = F.struct(F.col("strref").isNull().alias("none"), "strref")
    further = [F.min_by(c, by).alias(c) for c in rows.columns if c not in keys and c != "strref"]
    return rows.groupBy(*keys).agg(F.min("strref").alias("strref"), *further).select(rows.columns)


def preset_patch(settings: DataFrame, preset: str) -> DataFrame:
    """The preset on rows without manual settings."""
    return settings.withColumn("preset", F.when(F.coalesce(F.col("manual"), F.lit(False)), F.col("preset")).otherwise(F.lit(preset)))


def reconcile_reviews(reviews: DataFrame, cache: DataFrame, overrides: DataFrame, attention: Column) -> DataFrame:
    """Reviews without those whose text now needs attention and has no override."""
    open_ = cache.where(attention).select("text_hash").join(overrides.select("text_hash"), "text_hash", "left_anti")
    return reviews.join(open_, "text_hash", "left_anti")


def review_plain(reviews: DataFrame, cache: DataFrame, plain: Column) -> DataFrame:
    """Reviews with those of plain texts that lack one."""
    return state.insert_new(reviews, cache.where(plain).select(*reviews.columns), ["text_hash"]).unionByName(reviews)


def set_decision(samples: DataFrame, ids: DataFrame, decision: str, least_seconds: float = 0.6) -> DataFrame:
    """A decision on the given samples; approval only if a sample is long enough."""
    allowed = F.lit(True) if decision != "approved" else F.coalesce(F.col("duration_secs") >= least_seconds, F.lit(False))
    hit = samples.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumn("decision", F.when(F.col("_hit") & allowed, F.lit(decision)).otherwise(F.col("decision"))).select(samples.columns)


def demote_conflicts(samples: DataFrame, owners: DataFrame, schema: str) -> DataFrame:
    """Automatic samples of sounds with several owners become ``manual_only`` in their provenance."""
    many = owners.where("owners > 1").select(F.col("sound").alias("_sound"), "owners")
    joined = samples.join(many, F.lower("sound") == F.col("_sound"), "left")
    changed = state.set_json(F.col("provenance"), {"eligibility": F.lit("manual_only"), "shared_source_count": F.col("owners")}, schema)
    return joined.withColumn("provenance", F.when(F.col("_sound").isNotNull(), changed).otherwise(F.col("provenance"))).select(samples.columns)


def propagate(bindings: DataFrame, leader: DataFrame, members: DataFrame) -> DataFrame:
    """The leaders' bindings (speaker, source, profile) for all members of their groups."""
    group = leader.join(members, "speaker").select("identity", "source", "profile")
    return state.upsert(bindings, members.join(group, "identity").select("speaker", "source", "profile"), ["speaker"])


def recover_files(generations: DataFrame, files: DataFrame) -> DataFrame:
    """Generations that aren't done but whose output file exists become done."""
    there = files.select(F.col("path").alias("output_path")).distinct().withColumn("_f", F.lit(True))
    joined = generations.join(there, "output_path", "left")
    return joined.withColumn("status", F.when(F.col("_f"), "done").otherwise(F.col("status"))).select(generations.columns)


def configure_pools(groups: DataFrame, donors: DataFrame) -> DataFrame:
    """For each group (sex, race, category) the best donor of exactly these, else of its sex; never of another known sex.

    One aggregate for each way of matching, so a sex with very many donors is not joined pair by pair.
    """
    keys = ["sex", "race", "category"]
    by = F.struct("quality", (-F.col("id")).alias("low"))
    exact = donors.groupBy(*keys).agg(F.max_by("id", by).alias("exact"))
    same_sex = donors.where("sex <> 0").groupBy("sex").agg(F.max_by("id", by).alias("same_sex"))
    joined = groups.select(*keys).distinct().join(exact, keys, "left").join(same_sex, "sex", "left")
    return joined.select(*keys, F.coalesce("exact", "same_sex").alias("donor"))


def identity_totals(groups: DataFrame) -> DataFrame:
    """Sums over identities."""
    return groups.agg(F.count("*").alias("identities"), F.sum("lines").alias("lines"), F.count_if("bound").alias("bound"), F.count_if(~F.col("bound") & (F.col("lines") > 0)).alias("unbound"))


HARVEST_FACETS = {
    "none_approved": lambda: (F.col("samples") > 0) & (F.col("approved") == 0), "approved": lambda: F.col("approved") > 0,
    "no_samples": lambda: F.col("samples") == 0, "variants": lambda: F.col("variants") > 1,
}
"""V05."""


def rule_search(rules: DataFrame, query: str, fields: Sequence[str], order: str) -> DataFrame:
    """Rules that hold the query in one of the fields; enabled ones first, or by a field."""
    from .predicates import search

    by = [F.col("enabled").desc(), F.lower(fields[0])] if order == "enabled" else [F.lower(order)]
    return rules.where(search(query, *(F.col(f) for f in fields))).orderBy(*by, "id")
