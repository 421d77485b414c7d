"""Follow chains: resolution, change flags, cycles.

A speaker hands on to at most one other, so the bindings are a graph in which every node has one way out. Chains are
walked by pointer doubling: a table of jumps joined with itself has jumps of twice the length, so hops cost a number of
joins that grows with their logarithm. Each table of jumps is cut from its plan by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cuts import durable

MOST_HOPS = 8


def _double(jumps: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """``jumps`` (speaker, at, hops, kind; kind is null where the chain goes on) followed by those of ``by``, else by
    themselves. Only rows that go on are joined, and keep their further columns."""
    then = (jumps if by is None else by).select(F.col("speaker").alias("_s"), F.col("at").alias("_at"), F.col("hops").alias("_hops"), F.col("kind").alias("_kind"))
    moved = jumps.where("kind IS NULL").join(then, F.col("at") == F.col("_s"))
    fresh = {"at": F.col("_at"), "hops": F.col("hops") + F.col("_hops"), "kind": F.col("_kind")}
    return jumps.where("kind IS NOT NULL").unionByName(moved.select(*(fresh.get(c, F.col(c)).alias(c) for c in jumps.columns)))


class Chains:
    """The follow chains of ``bindings`` (speaker, source, follows), of which a speaker has one row at most.

    A row of source ``follow`` hands on to the speaker it follows, if that has a row. A chain's kind is ``own`` where it
    ends in another source (or none), ``untargeted`` in a follow of nobody, ``unbound`` in a follow of a speaker without
    a row, and ``ring`` where it goes round.
    """

    def __init__(self, bindings: DataFrame):
        rows = bindings.select("speaker", "source", "follows")
        known = rows.select(F.col("speaker").alias("_s"))
        follows = F.coalesce(F.col("source") == "follow", F.lit(False))
        kind = F.when(~follows, "own").when(F.col("follows").isNull(), "untargeted").when(F.col("_s").isNull(), "unbound")
        self.rows = durable(rows.join(known, follows & (F.col("follows") == F.col("_s")), "left").select("speaker", "follows", kind.alias("kind")))
        goes_on = F.col("kind").isNull()
        still = self.rows.select("speaker", F.when(goes_on, F.col("follows")).otherwise(F.col("speaker")).alias("at"), goes_on.cast("int").alias("hops"), "kind")
        ends = self.rows.where("kind IS NOT NULL").select(F.col("speaker").alias("_s"), F.col("kind").alias("_kind"))
        one = still.join(ends, goes_on & (F.col("at") == F.col("_s")), "left").select("speaker", "at", "hops", F.coalesce("kind", "_kind").alias("kind"))
        self._jumps = [durable(one)]

    def jumps(self, k: int) -> DataFrame:
        """speaker, at, hops, kind: where each chain is after 2**k hops, or where it ended before."""
        while len(self._jumps) <= k:
            self._jumps.append(durable(_double(self._jumps[-1])))
        return self._jumps[k]

    def after(self, hops: int) -> DataFrame:
        """The same after any number of hops: the jumps of its binary digits, one join for each further digit."""
        digits = [k for k in range(hops.bit_length()) if hops >> k & 1]
        if not digits:
            return self.rows.select("speaker", F.col("speaker").alias("at"), F.lit(0).alias("hops"), "kind")
        now = self.jumps(digits[0])
        for k in digits[1:]:
            now = durable(_double(now, self.jumps(k)))
        return now

    def facts(self) -> DataFrame:
        """speaker, at (the chain's end, or the first speaker of its ring), hops (to it), kind and ring (its length).

        Exact for chains and rings of any length. Doublings end when one of them changes neither the number of chains that
        go on nor that of the speakers they are at: then a jump takes these speakers onto themselves, so all are on rings.
        """
        k, before = 0, None
        while True:
            going = self.jumps(k).where("kind IS NULL")
            now = going.agg(F.count("*"), F.count_distinct("at")).first()
            if now[0] == 0 or now == before:
                break
            k, before = k + 1, now
        found = self.jumps(k)
        ended = found.where("kind IS NOT NULL").withColumn("ring", F.lit(None).cast("long"))
        if not now[0]:
            return ended
        round_ = found.where("kind IS NULL")
        on_ring = durable(round_.select(F.col("at").alias("_r")).distinct())  # every speaker of a ring is where another's jump ends
        lengths = self._rings(on_ring)
        first = self.jumps(0).join(round_.select("speaker"), "speaker", "left_semi").join(on_ring, F.col("speaker") == F.col("_r"), "left")
        way = first.select("speaker", F.when(F.col("_r").isNull(), F.col("at")).otherwise(F.col("speaker")).alias("at"), F.when(F.col("_r").isNull(), 1).otherwise(0).alias("hops"))
        way = durable(way.join(on_ring, F.col("at") == F.col("_r"), "left").select("speaker", "at", "hops", F.when(F.col("_r").isNotNull(), "ring").alias("kind")))
        while not way.where("kind IS NULL").isEmpty():
            way = durable(_double(way))
        return ended.unionByName(way.join(lengths, F.col("at") == F.col("_r")).select("speaker", "at", "hops", "kind", "ring"))

    def _rings(self, on_ring: DataFrame) -> DataFrame:
        """_r and ring: the length of each ring speaker's ring. The least speaker of the next 2**k names the ring once
        another doubling changes nothing: then windows of 2**k, one behind the other around the ring, agree."""
        now = self.jumps(0).join(on_ring, F.col("speaker") == F.col("_r")).select("speaker", "at", F.col("speaker").alias("least"))
        while True:
            then = now.select(F.col("speaker").alias("_s"), F.col("at").alias("_at"), F.col("least").alias("_least"))
            moved = durable(now.join(then, F.col("at") == F.col("_s")).select("speaker", F.col("_at").alias("at"), F.least("least", "_least").alias("least"), (F.col("_least") < F.col("least")).alias("fell")))
            now = moved.drop("fell")
            if moved.where("fell").isEmpty():
                break
        sizes = durable(now.groupBy("least").agg(F.count("*").alias("ring")))
        return now.join(sizes, "least").select(F.col("speaker").alias("_r"), "ring")


def _missing(hops: Column, kind: Column, most: int) -> Column:
    """Whether a chain ends without a binding within ``most`` hops; the hop to a speaker without a row counts."""
    return (kind == "untargeted") & (hops <= most) | (kind == "unbound") & (hops < most)


def walk(bindings: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """speaker, at, hops and status of the end of each speaker's chain, or of where it is after ``most`` hops.

    ``bindings`` (speaker, source, follows) has at most one row for each speaker. status is ``own`` where a chain ends in
    a binding of its own, ``missing`` where it ends in a follow without a target or with one that has no binding,
    ``depth`` where neither is reached within ``most`` hops.
    """
    return _status(Chains(bindings).after(most), most).select("speaker", "at", "hops", "status")


def _status(found: DataFrame, most: int) -> DataFrame:
    kind, hops = F.col("kind"), F.col("hops")
    own = F.coalesce((kind == "own") & (hops <= most), F.lit(False))
    return found.withColumn("status", F.when(own, "own").when(F.coalesce(_missing(hops, kind, most), F.lit(False)), "missing").otherwise("depth"))


def resolved_voices(bindings: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """Speaker, at and hops of every chain's end, whatever its status."""
    return walk(bindings, most).select("speaker", "at", "hops")


def _told(chains: Chains, most: int) -> DataFrame:
    """facts with status: as walk, and ``cycle`` where a speaker comes again within ``most`` hops."""
    found = _status(chains.facts(), most)
    cycle = (F.col("kind") == "ring") & (F.col("hops") + F.col("ring") <= most)
    return durable(found.withColumn("status", F.when(cycle, "cycle").otherwise(F.col("status"))))


def effective(bindings: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """Like walk, where status is ``cycle`` if the chain meets a speaker again within ``most`` hops, on whatever tail
    and ring; a chain that does not, and is still going, exceeds the bound: ``depth``."""
    chains = Chains(bindings)
    told = _told(chains, most).select(F.col("speaker").alias("_s"), "status")
    return chains.after(most).join(told, F.col("speaker") == F.col("_s")).select("speaker", "at", "hops", "status")


def would_cycle(bindings: DataFrame, pairs: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """For each (speaker, target) whether the speaker can't follow the target.

    True if they are one, if the speaker comes on the target's chain, if that chain meets any speaker again, or if it is
    longer than ``most`` hops. Each pair is judged by itself, against the bindings as they are.
    """
    chains = Chains(bindings)
    told = _told(chains, most).select(F.col("speaker").alias("_s"), F.col("at").alias("end"), "hops", "kind", "status")
    nobody = chains.rows.where("kind = 'unbound'").select(F.col("speaker").alias("_e"), F.col("follows").alias("absent"))
    ahead = pairs.select("speaker", "target").join(told, F.col("target") == F.col("_s"), "left").drop("_s").join(nobody, F.col("end") == F.col("_e"), "left").drop("_e")
    own = told.select(F.col("_s").alias("_o"), F.col("end").alias("own_end"), F.col("hops").alias("own_hops"))
    met = ahead.join(own, F.col("speaker") == F.col("_o"), "left").drop("_o")
    # the speaker is on the chain if the target gets to it in the hops that it is ahead of it
    gap = F.when((F.col("end") == F.col("own_end")) & F.col("status").isin("own", "missing"), F.col("hops") - F.col("own_hops"))
    now = durable(met.withColumn("gap", F.when(gap >= 0, gap)).withColumn("at", F.col("target")).select("speaker", "target", "status", "absent", "gap", "at"))
    # only pairs that go on are joined, at each digit; the others would all meet in one task, under a null key
    still, walking = now.where("gap IS NULL OR gap = 0"), now.where("gap > 0")
    for k in range(most.bit_length()):
        step = chains.jumps(k).select(F.col("speaker").alias("_s"), F.col("at").alias("_at"))
        takes = F.col("gap").bitwiseAND(F.lit(1 << k)) > 0
        moved = walking.where(takes).join(step, F.col("at") == F.col("_s"), "left").withColumn("at", F.col("_at")).select(walking.columns)
        walking = durable(moved.unionByName(walking.where(~takes)))
    now = still.unionByName(walking)
    on_way = F.col("gap").isNotNull() & (F.col("at") == F.col("speaker")) | (F.col("absent") == F.col("speaker"))
    cycle = (F.col("speaker") == F.col("target")) | F.coalesce(F.col("status").isin("cycle", "depth"), F.lit(False)) | F.coalesce(on_way, F.lit(False))
    return now.select("speaker", "target", cycle.alias("cycle"))


def closes_ring(bindings: DataFrame, pairs: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """(speaker, target, cycle) of pairs that are to be followed together, one for each speaker.

    With all of them in force, the pairs of speakers on a ring are refused, and the others are judged again without them,
    until no pair is on a ring; then those are refused whose target's chain goes round all the same or is longer than
    ``most`` hops. So several pairs never close a ring, and a pair that only led into one is kept.
    """
    left = durable(pairs.select("speaker", "target"))
    while True:
        fresh = left.select("speaker", F.lit("follow").alias("source"), F.col("target").alias("follows"))
        old = bindings.select("speaker", "source", "follows").join(fresh.select("speaker"), "speaker", "left_anti")
        told = _told(Chains(old.unionByName(fresh)), most)
        on_ring = told.where("kind = 'ring' AND hops = 0").select("speaker")
        kept = durable(left.join(on_ring, "speaker", "left_anti"))
        if kept.count() == left.count():
            break
        left = kept
    unsound = told.where("status IN ('cycle', 'depth')").select(F.col("speaker").alias("target"))
    fine = left.join(unsound, "target", "left_anti").select(F.col("speaker").alias("_s"), F.col("target").alias("_t"))
    return pairs.select("speaker", "target").join(fine, (F.col("speaker") == F.col("_s")) & (F.col("target") == F.col("_t")), "left").select("speaker", "target", F.col("_s").isNull().alias("cycle"))


def voice_changed(snapshot_profile: Column, snapshot_sample: Column, profile: Column, sample: Column, ready: Column, fingerprint: Column) -> Column:
    """What a clip was made with is not what its speaker's voice is now; null-safe."""
    by_profile = profile.isNotNull() & ~snapshot_profile.eqNullSafe(profile)
    by_sample = profile.isNull() & ~F.coalesce(snapshot_sample == sample, F.lit(False))
    return ~F.coalesce(ready, F.lit(False)) | fingerprint.isNull() | by_profile | by_sample
