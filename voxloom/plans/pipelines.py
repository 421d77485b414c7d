"""Composite pipelines over dialogue corpora."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import aggregates, ranking


def corpus_audit(lines: DataFrame, ident: str, key: str, column: str = "text") -> DataFrame:
    """One row for each distinct trimmed text: its least id and key, count, hash, mapped text, audit mask and flags."""
    unique = aggregates.unique_texts(lines, ident, key, column)
    # a generator hands its result on as it is; a projection would be merged into all expressions that use it
    mapped = unique.select("*", F.explode(F.array(text.map_cues(F.col("text")))).alias("mapped"))
    audited = mapped.withColumn("mask", text.audit_mask(F.col("text"), F.col("mapped")))
    return audited.withColumn("text_hash", hashing.text_hash(F.col("text"))).withColumn("flags", text.mask_labels(F.col("mask"), text.AUDIT_BITS)).withColumn("attention", text.needs_attention(F.col("mask")))


def effective_texts(lines: DataFrame, overrides: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``spoken`` and its source: the override stored under the text's hash, else rules, cues and word tags."""
    stored = overrides.select(F.col("text_hash").alias("_h"), F.col("text").alias("_o"))
    mapped = text.apply_tags(text.apply_rules(F.col("text"), rules))
    joined = lines.withColumn("text_hash", hashing.text_hash(F.col("text"))).join(stored, F.col("text_hash") == F.col("_h"), "left")
    return joined.withColumn("spoken", F.coalesce("_o", mapped)).withColumn("source", F.when(F.col("_o").isNotNull(), "override").otherwise("mapped")).drop("_h", "_o")


def attribute(states: DataFrame, creatures: DataFrame) -> DataFrame:
    """Each dialogue state with its owner and how sure that is.

    ``states`` (dialogue, state, ...), ``creatures`` (name, dialogue, named, voiced). A sole owner is certain (1.0); of
    several the representative owns with 0.4, or 0.2 if none is named as the dialogue; without an owner 0.0.
    """
    owners = ranking.representative(creatures.where(F.coalesce("dialogue", F.lit("")) != ""), "dialogue", "name", "named", "voiced")
    sure = F.when(F.col("owners") == 1, 1.0).when(F.lower("name") == F.lower("dialogue"), 0.4).otherwise(0.2)
    keyed = owners.select(F.lower("dialogue").alias("_d"), F.col("name").alias("owner"), sure.alias("confidence"))
    return states.join(keyed, F.lower(states.dialogue) == F.col("_d"), "left").drop("_d").na.fill(0.0, ["confidence"])


def dialogue_totals(states: DataFrame, dialogues: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Lines by kind of dialogue: listed in ``dialogues``, with one of the prefixes, or other."""
    sizes = states.groupBy(F.lower("dialogue").alias("dialogue")).agg(F.count("*").alias("lines"))
    listed = dialogues.select(F.lower("dialogue").alias("dialogue")).distinct().withColumn("_in", F.lit(True))
    prefixed = F.exists(F.array(*(F.lit(p.lower()) for p in prefixes)), lambda p: F.col("dialogue").startswith(p)) if prefixes else F.lit(False)
    kind = F.when(F.col("_in"), "listed").when(prefixed, "prefixed").otherwise("other")
    return sizes.join(listed, "dialogue", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("dialogues"), F.sum("lines").alias("lines"))


def sound_owners(*sources: DataFrame) -> DataFrame:
    """For each sound (in any case) how many identities have it in any of the tables (sound, identity), and the least of them."""
    union = sources[0].select(F.lower("sound").alias("sound"), "identity")
    for s in sources[1:]:
        union = union.union(s.select(F.lower("sound").alias("sound"), "identity"))
    return union.groupBy("sound").agg(F.count_distinct("identity").alias("owners"), F.min("identity").alias("owner"))


def candidates(dialogue: DataFrame, companion: DataFrame, slots: DataFrame, existing: DataFrame, least_confidence: float = 0.4, most: int = 12) -> DataFrame:
    """Reference clips to decode: of each identity's sounds from three sources (dialogue before companion before
    slots) the first of each sound, owned by it alone, not there yet, at most ``most`` in order of confidence."""
    first = ranking.first_source([dialogue.where(F.col("confidence") >= least_confidence), companion, slots], ["identity", "sound"], [F.col("confidence").desc(), F.col("strref")])
    owners = sound_owners(first).where("owners = 1").select("sound")
    usable = first.withColumn("sound", F.lower("sound")).join(owners, "sound", "left_semi").where(text.usable_reference(F.col("text")))
    return ranking.distinct_sounds(usable, ["identity"], [F.col("confidence").desc(), F.col("strref")], most, existing)


def auto_bind(identities: DataFrame, samples: DataFrame, bindings: DataFrame) -> DataFrame:
    """Identity, sample and action of each identity: ``keep`` what one explicit choice says, ``skip`` where
    several differ, ``bind`` the best approved sample, ``none`` without one."""
    chosen = bindings.where("source = 'override'").groupBy("identity").agg(F.count_distinct("sample").alias("_n"), F.min("sample").alias("_own"))
    found = ranking.best_sample(samples, ["identity"]).select("identity", F.col("id").alias("_best"))
    joined = identities.select("identity").distinct().join(chosen, "identity", "left").join(found, "identity", "left")
    action = F.when(F.col("_n") > 1, "skip").when(F.col("_n") == 1, "keep").when(F.col("_best").isNotNull(), "bind").otherwise("none")
    return joined.select("identity", F.when(F.coalesce("_n", F.lit(0)) <= 1, F.coalesce("_own", "_best")).alias("sample"), action.alias("action"))


def assign_pools(speakers: DataFrame, pools: DataFrame, donors: DataFrame) -> DataFrame:
    """A variation of ``assign_voices`` that prefers quality: a voice for each speaker without one: a member of the pool of its sex, race and category, else the
    best donor of its sex by category (4), race (2) and quality; sex 0 gets no donor. Explicit voices stay.

    Pools are a row for each (sex, race, category) with an ordered array ``members``. The best donor by quality, then by
    the least id, is found once at each level of likeness: same sex, category and race; same category; same race; same
    sex. A speaker takes the first level that has one, so donors are aggregated and never paired with speakers.
    """
    keys = ["sex", "race", "category"]
    kinds = speakers.select(*keys).distinct().where("sex <> 0")
    finest = donors.groupBy("sex", "category", "race").agg(F.max(F.struct("quality", (-F.col("id")).alias("low"))).alias("best"))
    levels = (["sex", "category", "race"], ["sex", "category"], ["sex", "race"], ["sex"])
    found = kinds
    for k, level in enumerate(levels):
        found = found.join(finest.groupBy(*level).agg(F.max("best").alias(f"_l{k}")), level, "left")
    fallback = found.select(*keys, (-F.coalesce(*(F.col(f"_l{k}.low") for k in range(len(levels))))).alias("_donor"))
    joined = speakers.join(pools.select(*keys, "members"), keys, "left").join(fallback, keys, "left")
    member = F.when(F.size("members") > 0, F.get("members", hashing.stable_index(F.size("members"), F.col("id"), hashing.pool_salt(F.col("members")))))
    voice = F.coalesce("explicit", member, "_donor")
    source = F.when(F.col("explicit").isNotNull(), "override").when(member.isNotNull(), "generic").when(F.col("_donor").isNotNull(), "fallback").otherwise("none")
    return joined.select("id", voice.alias("voice"), source.alias("source"))


#: What a donor can have in common with a speaker, and what each is worth: more than all that follow together.
LIKENESS = {"sex": 8, "category": 4, "race": 2, "class": 1}


def best_donors(kinds: DataFrame, donors: DataFrame) -> DataFrame:
    """For each kind (sex, category, race, class) the donor that has most in common with it, weighed by LIKENESS, of
    equals the least id; with score.

    The least donor is found once for each of the 16 sets of attributes that may agree. A kind takes the first set, in
    the order of their weight, in which it finds one; so no kind is paired with all donors, and nothing is gathered.
    """
    names = list(LIKENESS)
    finest = donors.groupBy(*names).agg(F.min("id").alias("id"))
    sets = sorted(([n for k, n in enumerate(names) if bits >> k & 1] for bits in range(16)), key=lambda s: -sum(LIKENESS[n] for n in s))
    found = kinds
    for k, some in enumerate(sets):
        if some:
            found = found.join(finest.groupBy(*some).agg(F.min("id").alias(f"_d{k}")), some, "left")
        else:
            found = found.join(finest.agg(F.min("id").alias(f"_d{k}")), how="left")
    score = F.coalesce(*(F.when(F.col(f"_d{k}").isNotNull(), sum(LIKENESS[n] for n in some)) for k, some in enumerate(sets)))
    return found.select(*names, F.coalesce(*(f"_d{k}" for k in range(len(sets)))).alias("donor"), score.alias("score"))


def assign_voices(speakers: DataFrame, profiles: DataFrame, pools: DataFrame, donors: DataFrame, project: int = 1, fallback: bool = True) -> DataFrame:
    """Id, source, profile, donor and score of each of ``speakers`` (id, sex, race, category,
    class, explicit).

    A voice of the speaker's own stays (``override``). Else a member of the pool of profiles of its sex, race and category
    (``profile``), else of the pool of donors (``pool``), each picked by hash, stable for speaker, project and pool; else,
    with ``fallback``, the donor that has most in common with it (``fallback``); else ``none``. ``profiles`` and ``pools``
    have a row for each (sex, race, category) with an array ``members``; an empty one counts as none.
    """
    keys = ["sex", "race", "category"]
    some = lambda t: t.where(F.size("members") > 0)
    salted = lambda t, name: some(t).select(*keys, F.size("members").alias(f"{name}_size"), hashing.sip_salt("members").alias(f"{name}_salt"))
    joined = speakers.join(salted(profiles, "_profile"), keys, "left").join(salted(pools, "_pool"), keys, "left")
    kinds = speakers.select(*LIKENESS).distinct()
    joined = joined.join(best_donors(kinds, donors), list(LIKENESS), "left") if fallback else joined.withColumns({"donor": F.lit(None).cast("bigint"), "score": F.lit(None).cast("int")})
    # no nulls go to the hash: a batch that holds one would turn all its numbers into floating point
    place = lambda name: hashing.sip_index(F.coalesce(F.col("id").cast("bigint"), F.lit(0)), F.lit(project).cast("bigint"), F.coalesce(f"{name}_salt", F.lit(0)), F.coalesce(f"{name}_size", F.lit(0)))
    # members are looked up by their place, so that no speaker carries its pool's whole array through a shuffle
    picked = joined.withColumns({"_profile_at": place("_profile"), "_pool_at": place("_pool")})
    for t, name in ((profiles, "_profile"), (pools, "_pool")):
        picked = picked.join(some(t).select(*keys, F.posexplode("members").alias(f"{name}_at", name)), [*keys, f"{name}_at"], "left")
    source = F.when(F.col("explicit").isNotNull(), "override").when(F.col("_profile").isNotNull(), "profile").when(F.col("_pool").isNotNull(), "pool").when(F.col("donor").isNotNull(), "fallback").otherwise("none")
    told = picked.withColumn("source", source)
    is_ = lambda s: F.col("source") == s
    donor = F.when(is_("pool"), F.col("_pool")).when(is_("fallback"), F.col("donor"))
    return told.select("id", "source", F.when(is_("override"), F.col("explicit")).when(is_("profile"), F.col("_profile")).alias("profile"), donor.alias("donor"), F.when(is_("fallback"), F.col("score")).alias("score"))


def plan_generation(jobs: DataFrame, size: int = 8, budget: int = 800) -> DataFrame:
    """Jobs (id, voice, text, settings) grouped by voice, deduplicated, in order of length, packed in batches."""
    unique = jobs.groupBy("voice", text.collapse(F.col("text")).alias("text"), "settings").agg(F.min("id").alias("id"), F.count("*").alias("jobs"))
    return aggregates.pack_by_length(unique.withColumn("chars", F.length("text")), "voice", "id", size, budget)


def assemble(lines: DataFrame, taken: DataFrame, reasons: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(planned lines with a unique name, deferred lines with a reason)."""
    from ..operators.predicates import defer_reason

    judged = lines.withColumn("reason", defer_reason(reasons))
    return hashing.unique_names(judged.where("reason IS NULL").drop("reason"), taken), judged.where("reason IS NOT NULL")


# Names that a crowd shares, and stems of sounds that belong to one well-known character.
CROWD_NAMES = (
    "boy", "girl", "child", "guard", "slave", "beggar", "merchant", "commoner", "peasant", "man", "woman", "soldier", "captain", "servant", "worker", "farmer", "sailor",
    "thug", "bandit", "priest", "mage", "wizard", "knight", "noble", "lady", "lord", "prostitute", "harlot", "flirt", "bartender", "innkeeper", "customer", "townsperson", "villager",
)
COMPANION_STEMS = (
    "jaheir", "minsc", "aerie", "anomen", "cernd", "edwin", "haer", "imos", "imoen", "jan", "keldor", "korgan", "mazzy",
    "nalia", "valyg", "vicon", "yosh", "sarev", "bodhi", "iren", "elles", "khalid", "dynah", "monta", "xzar", "jahe",
)


def binding_hints(rows: DataFrame) -> DataFrame:
    """Codes of what looks wrong with a personal binding (columns display_name, name, speaker, sample_owner, sound, members,
    foreign_stems, automatic, shared): a sample of another speaker, a sound named after another character, a crowd's
    member with a companion's sound, a sample not found automatically, or one that several characters share."""
    sound = text.ascii_lower(F.trim(F.coalesce("sound", F.lit(""))))
    stem, own = text.stem(sound), text.stem(F.col("name"))
    member = F.exists("members", lambda m: (F.length(text.stem(m)) >= 4) & ((stem == text.stem(m)) | sound.startswith(text.stem(m)) | (stem == own) | sound.startswith(own)))
    known = (F.length(stem) >= 4) & F.exists(F.array(*(F.lit(c) for c in COMPANION_STEMS)), lambda c: stem.startswith(c) | c.startswith(stem))
    crowd = text.ascii_lower(F.trim("display_name")).isin(*CROWD_NAMES)
    hints = F.array_compact(F.array(
        F.when(F.col("sample_owner") != F.col("speaker"), "sample_owner_mismatch"),
        F.when((F.length(stem) >= 4) & ~member & (F.array_contains("foreign_stems", stem) | known), "foreign_sound_stem"),
        F.when(crowd & known & ~member, "crowd_with_companion_stem"), F.when(~F.col("automatic"), "manual_only_primary"), F.when(F.col("shared") >= 2, "shared_source"),
    ))
    return rows.withColumn("hints", hints)


def sound_usage(samples: DataFrame) -> DataFrame:
    """For each sound its characters (best sample of each identity), whether any is bound, and counts."""
    one = ranking.best(samples, ["sound", "identity"], F.struct("bound", "overall", (-F.col("id")).alias("low")))
    return one.groupBy("sound").agg(F.count("*").alias("characters"), F.bool_or("bound").alias("bound"), F.max_by("id", F.struct("overall", (-F.col("id")).alias("low"))).alias("representative"), F.sort_array(F.collect_list(F.struct("identity", "id", "overall"))).alias("members"))


def matrix(lines: DataFrame, experiments: Sequence[Mapping[str, object]]) -> DataFrame:
    """Every line with every experiment of a short list."""
    cases = F.array(*(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in e.items()))) for e in experiments))
    return lines.select("*", F.posexplode(cases).alias("experiment", "settings"))


def blind_trials(cases: DataFrame, seed: int) -> DataFrame:
    """Each variant clip of a line with the baseline clip, on sides that the seed and the line decide."""
    base = cases.where("experiment = 0").select("line", F.col("clip").alias("baseline"))
    pairs = cases.where("experiment > 0").join(base, "line")
    left = F.pmod(F.xxhash64(F.lit(seed), "line", "experiment"), F.lit(2)) == 0
    return pairs.select("line", "experiment", F.when(left, F.col("baseline")).otherwise(F.col("clip")).alias("a"), F.when(left, F.col("clip")).otherwise(F.col("baseline")).alias("b"), F.when(left, "a").otherwise("b").alias("baseline_side"))


def voice_match(speaker: Column, voice: Column, unknown: int = 0) -> Column:
    """Match, mismatch, unknown (either side) or unbound (no voice)."""
    return F.when(voice.isNull(), "unbound").when((speaker == unknown) | (voice == unknown) | speaker.isNull(), "unknown").when(speaker == voice, "match").otherwise("mismatch")


def binding_document(bindings: DataFrame, samples: DataFrame) -> DataFrame:
    """A nested document for each binding, with its ordered samples."""
    listed = samples.groupBy("binding").agg(F.sort_array(F.collect_list(F.struct("sort_order", "sample", "sound"))).alias("samples"))
    return bindings.join(listed, "binding", "left").select("binding", F.struct("speaker", "source", "status").alias("detail"), F.coalesce("samples", F.array().cast("array<struct<sort_order:int,sample:bigint,sound:string>>")).alias("samples"))


def same_references(profiles: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (key, refs) the least profile whose ordered references are the same, else null."""
    keyed = profiles.groupBy("refs").agg(F.min("profile").alias("profile"))
    return wanted.join(keyed, "refs", "left").select("key", "profile")


def dominant_creature(creatures: DataFrame, labels: DataFrame) -> DataFrame:
    """For each label (label, prefix) the creature that bears it: of those whose name starts with the prefix the most
    frequent long name, then the one named so exactly, with a usable dialogue, with the least name."""
    starts = F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.left(F.lower("name"), n))  # names are short, so this is a join of equals
    spread = creatures.where("name <> ''").withColumn("_start", F.explode(starts))
    hits = labels.where("prefix <> ''").join(spread, F.lower("prefix") == F.col("_start"))
    exact = F.lower("name") == F.lower("prefix")
    named = hits.where("long_name IS NOT NULL").withColumn("_exact", exact)
    size = F.count("*").over(Window.partitionBy("label", "long_name"))
    any_exact, least = F.max("_exact").over(Window.partitionBy("label", "long_name")), F.min("name").over(Window.partitionBy("label", "long_name"))
    staged = named.select("label", "name", "_exact", "usable", *(o.alias(f"_o{i}") for i, o in enumerate((size, any_exact, least))))
    return ranking.top(staged, ["label"], [F.col("_o0").desc(), F.col("_o1").desc(), F.col("_o2"), F.col("_exact").desc(), F.col("usable").desc(), F.col("name")]).select("label", "name")


def line_of(states: DataFrame) -> DataFrame:
    """Dialogue states (dialogue, state, strref, text) with token mask, spoken text and provenance."""
    resolved = text.resolve_tokens(F.col("text"))
    return states.withColumn("token_mask", text.token_mask(F.col("text"))).withColumn("spoken", resolved).withColumn("provenance", hashing.provenance(origin=F.lit("dialogue_state"), dialogue=F.col("dialogue"), state=F.col("state")))


def companion_lines(cells: DataFrame, files: Sequence[str], states: DataFrame, existing: DataFrame) -> DataFrame:
    """States of the dialogues that a table (label, column, value) lists for each label in the given columns,
    without states that other passes have; a dialogue listed twice counts for the first column."""
    rank = F.array_position(F.array(*(F.lit(f.upper()) for f in files)), F.upper("column"))
    listed = cells.select(F.lower(F.trim("label")).alias("label"), F.lower(F.trim("value")).alias("dialogue"), rank.alias("_rank")).where("_rank > 0 AND dialogue NOT IN ('', '*', '****', 'none')")
    first = ranking.top(listed, ["dialogue"], [F.col("_rank"), F.col("label")])
    found = states.withColumn("dialogue", F.lower("dialogue")).join(first.drop("_rank"), "dialogue")
    return found.join(existing.select(F.lower("dialogue").alias("dialogue"), "state"), ["dialogue", "state"], "left_anti")


def scan_attribution(states: DataFrame, creatures: DataFrame, cells: DataFrame, files: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(lines with owner, confidence and origin; groups of shared strings): owned states first, then listed ones."""
    owned = attribute(states, creatures).where("confidence > 0").select(*states.columns, "owner", "confidence", F.lit("attributed").alias("origin"))
    extra = companion_lines(cells, files, states, owned).select(*states.columns, F.col("label").alias("owner"), F.lit(0.4).alias("confidence"), F.lit("companion").alias("origin"))
    lines = owned.withColumn("dialogue", F.lower("dialogue")).unionByName(extra)
    return lines, aggregates.shared_groups(lines, "strref", "owner")


def harvest(candidates: DataFrame, clips: DataFrame) -> DataFrame:
    """Candidates (sound, origin, confidence, text) joined with decoded clips (sound, samples, rate), measured and scored."""
    from ..functions import signal

    joined = candidates.withColumn("attribution", F.col("confidence")).join(clips.select(F.lower("sound").alias("sound"), "samples", "rate"), "sound")
    return signal.score(signal.measure(joined)).drop("samples")


def verify_speech(scored: DataFrame, ratios: DataFrame) -> DataFrame:
    """Scores recomputed where a voice activity ratio (id, ratio) is known."""
    from ..functions import signal

    joined = scored.join(ratios.select("id", F.col("ratio").alias("_ratio")), "id", "left")
    fresh = signal.with_vad(joined, "_ratio")
    old = joined.where("_ratio IS NULL").drop("_ratio")
    return fresh.where("_ratio IS NOT NULL").drop("_ratio").unionByName(old)


def reset_agent_state(overrides: DataFrame, generations: DataFrame, lines: DataFrame, project: int) -> tuple[DataFrame, DataFrame]:
    """Overrides without those of a project's texts, and generations with the project's lines marked stale."""
    own = lines.where(F.col("project_id") == project)
    hashes = own.select(hashing.text_hash(F.col("text")).alias("text_hash")).distinct()
    stale = own.select(F.col("id").alias("line_id"))
    marked = generations.join(stale.withColumn("_hit", F.lit(True)), "line_id", "left").withColumn("stale", F.coalesce(F.col("_hit"), F.col("stale"))).drop("_hit")
    return overrides.join(hashes, "text_hash", "left_anti"), marked


def stem_owners(sounds: DataFrame, creatures: DataFrame, least: int = 4) -> DataFrame:
    """(sound, name) of creatures whose name has the sound's stem, of ``least`` characters or more."""
    a = sounds.select("sound", text.stem(F.col("sound")).alias("_stem")).where(F.length("_stem") >= least).distinct()
    b = creatures.select("name", text.stem(F.col("name")).alias("_stem")).distinct()
    return a.join(b, "_stem").select("sound", "name")
