"""The next versions of a project's tables after a scan, a harvest or an export.

Each function takes tables and returns their next versions; write these elsewhere and swap (see operators.state).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import predicates, ranking, state

LINE_KEY, SPEAKER_KEY = ("strref", "dialogue", "state"), ("name",)


def write_attribution(speakers: DataFrame, lines: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(speakers, lines) of a scan, as they are stored.

    ``speakers`` (name, display_name, ...) lose those that stand for the player. ``lines`` (strref, speaker, text_spoken,
    voiced, sound, has_tokens, ...) get their shared group's resolution, whether their speaker is stored, and a status;
    audio that a pack of ours added counts as none. ``groups`` (strref, resolution) come from ``shared_groups``.
    """
    stored = speakers.where(~predicates.is_player(F.col("display_name")))
    names = speakers.select(F.col("name").alias("_name"), predicates.is_player(F.col("display_name")).alias("_player"))
    judged = lines.join(groups.select(F.col("strref").alias("_strref"), "resolution"), F.col("strref") == F.col("_strref"), "left").join(names, F.col("speaker") == F.col("_name"), "left")
    attributed = F.col("_name").isNotNull() & ~F.col("_player")
    status = predicates.line_status(
        F.lit(False), ~predicates.generatable(F.col("voiced"), F.col("sound")), F.col("has_tokens"), F.coalesce(F.col("resolution") == "defer_diff_voice", F.lit(False)),
        attributed, F.col("text_spoken"), F.coalesce("_player", F.lit(False)),
    )
    return stored, judged.withColumn("status", status).withColumn("speaker", F.when(attributed, F.col("speaker"))).drop("_strref", "_name", "_player")


def persist(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame], project: int, mode: str) -> dict[str, DataFrame]:
    """The tables speaker, line, profile and pool (each with project_id) after a scan of one project.

    ``new`` has speaker and line. ``merge`` updates rows by their natural keys, keeps their ids and status columns that
    the scan does not have, and drops what the scan lacks; profiles and pools stay. ``wipe`` takes the scan as it is, and
    the project's pools and harvested profiles go; imported and designed profiles stay. Other projects' rows stay.
    """
    mine = F.col("project_id") == project
    others = {k: t.where(~F.coalesce(mine, F.lit(False))) for k, t in old.items()}
    if mode == "wipe":
        kept = old["profile"].where(mine & (F.col("origin") != "harvested"))
        return {"speaker": others["speaker"].unionByName(new["speaker"]), "line": others["line"].unionByName(new["line"]), "profile": others["profile"].unionByName(kept), "pool": others["pool"]}
    if mode != "merge":
        raise ValueError(f"mode {mode!r} is neither merge nor wipe")
    merged = {k: others[k].unionByName(state.merge(old[k].where(mine), new[k], key)) for k, key in (("speaker", SPEAKER_KEY), ("line", LINE_KEY))}
    return {**merged, "profile": old["profile"], "pool": old["pool"]}


def persist_harvest(samples: DataFrame, harvested: DataFrame, speakers: DataFrame, references: DataFrame, preserve_decisions: bool, authoritative: bool) -> tuple[DataFrame, DataFrame]:
    """(samples, bindings that lose a reference) after a harvest.

    ``samples`` (speaker, sound, decision, ...), ``harvested`` (name, sound, ...) of ``speakers`` (id, name) in any case,
    ``references`` (binding, speaker, sound). A full harvest (``authoritative``) replaces the samples of all speakers,
    a partial one those of the speakers it has. A new sample takes the decision of the old one of its speaker and sound
    if a binding refers to it or decisions are preserved, else it is pending. Samples of unknown names are left out.
    """
    fresh = harvested.join(speakers.select(F.col("id").alias("speaker"), F.lower("name").alias("_n")), F.lower("name") == F.col("_n")).drop("_n", "name")
    fresh = fresh.withColumn("sound", F.lower("sound"))
    held = references.select("speaker", F.lower("sound").alias("sound")).distinct().withColumn("_held", F.lit(True))
    before = samples.withColumn("sound", F.lower("sound")).groupBy("speaker", "sound").agg(F.max_by("decision", ranking.decision_rank(F.col("decision"))).alias("_before"))
    known = fresh.join(before, ["speaker", "sound"], "left").join(held, ["speaker", "sound"], "left")
    carried = F.lit(True) if preserve_decisions else F.coalesce("_held", F.lit(False))
    fresh = known.withColumn("decision", F.when(carried, F.coalesce("_before", F.lit("pending"))).otherwise("pending"))
    rest = samples.limit(0) if authoritative else samples.join(fresh.select("speaker").distinct(), "speaker", "left_anti")
    kept = rest.unionByName(fresh.select(*samples.columns))
    lost = references.withColumn("sound", F.lower("sound")).join(kept.select("speaker", F.lower("sound").alias("sound")), ["speaker", "sound"], "left_anti")
    return kept, lost.select("binding").distinct()


def settle_harvest(
    before: DataFrame, after: DataFrame, bindings: DataFrame, references: DataFrame, generations: DataFrame, pools: DataFrame, speakers: DataFrame, authoritative: bool
) -> dict[str, DataFrame]:
    """The tables reference, binding, generation and pool as a harvest leaves them, when samples have new ids.

    ``before`` and ``after`` (id, speaker, strref, sound, decision, path) are the samples, ``speakers`` (speaker) those that
    the harvest brought; a full one (``authoritative``) counts for all. ``references`` (binding, sample, place) to samples
    that went are linked anew to the least approved sample with a file of the same speaker, string and sound, null equal
    to null, or go with them. ``bindings`` (id, speaker, primary, status) that are linked anew get the first of their
    references as primary and are pending, as are all their ``generations`` (id, binding, status, fingerprint), which lose
    their fingerprint. Others that were not pending lose their primary and become pending if it went, or, in a partial
    harvest, if they belong to a speaker that it brought. A full harvest clears ``pools``.
    """
    gone = before.select(F.col("id").alias("_id"), "speaker", "strref", "sound")
    if not authoritative:
        gone = gone.join(speakers.select("speaker").distinct(), "speaker", "left_semi")
    usable = after.where("decision = 'approved' AND path IS NOT NULL").groupBy("speaker", "strref", "sound").agg(F.min("id").alias("_fresh"))
    touched = references.join(gone, F.col("sample") == F.col("_id"))
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    linked = touched.alias("a").join(usable.alias("b"), same("speaker") & same("strref") & same("sound"))
    linked = linked.groupBy("binding", F.col("_fresh").alias("sample")).agg(F.max("place").alias("place"))
    kept = references.join(gone, F.col("sample") == F.col("_id"), "left_anti").select("binding", "sample", "place")
    fresh = kept.unionByName(linked)
    first = fresh.join(linked.select("binding").distinct(), "binding", "left_semi").groupBy(F.col("binding").alias("_b")).agg(F.min(F.struct("place", "sample"))["sample"].alias("_first"))
    lost = gone.select(F.col("_id").alias("_p"), F.lit(True).alias("_lost")).distinct()
    brought = speakers.select(F.col("speaker").alias("_s"), F.lit(not authoritative).alias("_brought")).distinct()
    told = bindings.join(first, F.col("id") == F.col("_b"), "left").join(lost, F.col("primary") == F.col("_p"), "left").join(brought, F.col("speaker") == F.col("_s"), "left")
    linked_anew, lost_it = F.col("_b").isNotNull(), F.coalesce("_lost", F.lit(False))
    falls = lost_it | (F.coalesce("_brought", F.lit(False)) & (F.col("status") != "pending"))
    primary = F.when(linked_anew, F.col("_first")).when(~falls, F.col("primary"))
    status = F.when(linked_anew | falls, "pending").otherwise(F.col("status"))
    settled = told.select("id", "speaker", primary.alias("primary"), status.alias("status"))
    again = generations.join(first.select("_b"), F.col("binding") == F.col("_b"), "left")
    made = again.select("id", "binding", F.when(F.col("_b").isNotNull(), "pending").otherwise(F.col("status")).alias("status"), F.when(F.col("_b").isNull(), F.col("fingerprint")).alias("fingerprint"))
    return {"reference": fresh, "binding": settled, "generation": made, "pool": pools.limit(0) if authoritative else pools}


def gap_fill_voiced(lines: DataFrame, groups: DataFrame, speakers: DataFrame) -> DataFrame:
    """voiced lines of the given speakers (speaker) whose audio may serve as a reference: of certain attribution, with
    a sound of the game's own, and not shared between voices."""
    sound = F.coalesce(F.trim("sound"), F.lit(""))
    own = lines.where(F.col("voiced") & (sound != "") & (F.col("confidence") >= 1.0) & ~predicates.generatable(F.col("voiced"), F.col("sound")))
    shared = groups.select("strref", (F.col("resolution") == "reuse_same_voice").alias("_same"))
    return own.join(shared, "strref", "left").where(F.coalesce("_same", F.lit(True))).drop("_same").join(speakers.select("speaker"), "speaker", "left_semi").withColumn("sound", F.lower("sound"))


def record_export(exports: DataFrame, project: int, fingerprint: int, manifest: Column, path: str, at: Column) -> DataFrame:
    """``exports`` (id, project_id, fingerprint_id, manifest, path, created_at) with one row more, of the next id."""
    row = exports.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select("id", F.lit(project).alias("project_id"), F.lit(fingerprint).alias("fingerprint_id"), manifest.alias("manifest"), F.lit(path).alias("path"), at.alias("created_at"))
    return exports.unionByName(row)


def enabled_rules(user: DataFrame, defaults: DataFrame) -> DataFrame:
    """The rules (id, find, kind, speak_as, enabled) in force: a user's rule shadows the default with its find (in any
    case) and kind, even if it is off; enabled ones with their place, the longest first."""
    keyed = ranking.first_source([t.withColumn("_find", F.lower("find")) for t in (user, defaults)], ["_find", "kind"], [F.col("id")])
    sized = keyed.where("enabled").drop("_find").withColumn("_shorter", -F.length("find"))
    return state.number_rows(sized, ["_shorter", "id"], "place").drop("_shorter").withColumn("place", F.col("place").cast("int"))


def export_rules(rules: DataFrame) -> DataFrame:
    """Rules as JSON, one a line."""
    return rules.select(F.to_json(F.struct("find", "speak_as", "kind", "enabled")).alias("value"))


def import_rules(lines: DataFrame) -> DataFrame:
    """Rules from JSON lines; lines that are no rule are left out, a missing kind is ``word``, missing enabled is true."""
    read = lines.select(F.from_json("value", "find string, speak_as string, kind string, enabled boolean").alias("r")).where("r.find IS NOT NULL AND r.speak_as IS NOT NULL")
    return read.select("r.find", "r.speak_as", F.coalesce("r.kind", F.lit("word")).alias("kind"), F.coalesce("r.enabled", F.lit(True)).alias("enabled"))
