import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import minhash

from . import brute

CLASHING = "doc_id long, text string, root long, node long, key long, cell long"


def copies_with_edits(seed=11, edits=(0, 1, 2, 3, 4, 5, 6, 7, 8)):
    """Copies with changed words, on both sides of both similarities, short texts, repeated rows and texts without words."""
    rng = random.Random(seed)
    rows = [(900, "four words and more"), (901, "Four words AND more"), (902, "four words and fewer"), (903, None), (904, ""), (905, " \n\t"), (906, "Ünïcode wörds ÄÖ"), (907, "ünïcode wörds äö")]
    for i in range(0, 180, len(edits)):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([30, 60, 200, 900]))]
        for k, n in enumerate(edits):
            other = list(base)
            for _ in range(n * len(base) // 250):
                other[rng.randrange(len(base))] = f"x{rng.randrange(500)}"
            rows.append((i + k, " ".join(other)))
    return [*rows, rows[20]]


def plain(rows, percent):
    """Least id that each id reaches; the empty set links with nothing."""
    sets = {d: brute.shingle_set(t) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, brute.components(set(sets), links)


def found(spark, rows, percent):
    got = minhash.minhash_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent=percent).collect()
    least = {}
    for r in got:
        if r.size:
            least[r.root] = min(r.doc_id, least.get(r.root, r.doc_id))
    assert len(got) == len(rows)
    return {r.doc_id: (r.size, least[r.root] if r.size else r.doc_id) for r in got}


@pytest.mark.parametrize(("percent", "cell", "stars", "broadcast"), [(85, 2, 2, 0), (85, 256, 64, 200_000), (80, 256, 64, 200_000), (80, 2, 1, 0)])
def test_components_match_brute_force(spark, monkeypatch, percent, cell, stars, broadcast):
    monkeypatch.setattr(minhash, "CELL", cell)
    monkeypatch.setattr(minhash, "CELL_SHINGLES", cell * 1000)
    monkeypatch.setattr(minhash, "STAR", stars)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", broadcast)
    rows = copies_with_edits()
    sets, want = plain(rows, percent)
    assert found(spark, rows, percent) == {d: (len(sets[d]), want[d]) for d in sets}
    assert len(set(want.values())) < 0.6 * len(rows)


def test_links_that_no_representative_shows(spark):
    """Chains, whose ends are unlike, hang together by their middle alone."""
    rng = random.Random(5)
    rows, words = [], [f"w{i}" for i in range(300)]
    for d in range(40):
        rows.append((d, " ".join(words)))
        words = words[6:] + [f"n{d}-{rng.randrange(9)}" for _ in range(6)]
    sets, want = plain(rows, 85)
    assert len(set(want.values())) == 1
    assert found(spark, rows, 85) == {d: (len(sets[d]), want[d]) for d in sets}


def test_a_large_family_is_written_a_few_times(spark, monkeypatch):
    """4,000 near copies: after they have met their representatives hardly any is left to be dealt in cells."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(4000):
        other = list(base)
        other[rng.randrange(400)] = f"x{d}"
        rows.append((d, " ".join(other)))
    seen = []
    dealt = minhash._dealt
    monkeypatch.setattr(minhash, "_dealt", lambda *a: seen.append(dealt(*a)) or seen[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert minhash.minhash_components(docs).select("root").distinct().count() == 1
    assert len(seen) == 2 and seen[1].count() < 2 * len(rows)


def test_sketches_fill_and_agree_as_often_as_sets():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 125, 5000):
        assert minhash.sketch(rng.integers(0, 1 << 63, n, np.uint64)).max() < np.iinfo(np.uint64).max
    assert (minhash.sketch(np.empty(0, np.uint64)) == np.iinfo(np.uint64).max).all()
    for n in (20, 300, 4000):
        share, tries = [], 60
        for _ in range(tries):
            both = rng.integers(0, 1 << 63, n, np.uint64)
            a, b = np.append(both, rng.integers(0, 1 << 63, n // 4, np.uint64)), np.append(both, rng.integers(0, 1 << 63, n // 4, np.uint64))
            share.append((minhash.sketch(np.unique(a)) == minhash.sketch(np.unique(b))).mean())
        s = n / (n + 2 * (n // 4))
        assert abs(np.mean(share) - s) < 4 * math.sqrt(s * (1 - s) / minhash.BINS / tries) + 0.01
        assert np.std(share) < 1.3 * math.sqrt(s * (1 - s) / minhash.BINS)


def test_a_sketch_does_not_depend_on_the_rounds_taken_at_once():
    """Round by round, stopping as soon as all bins are filled."""
    rng = np.random.default_rng(4)
    for n in (1, 3, 40, 300):
        hashes = rng.integers(0, 1 << 63, n, np.uint64)
        out = np.full(minhash.BINS, np.iinfo(np.uint64).max, np.uint64)
        for i in range(2 * minhash.BINS):
            for h in hashes:
                mixed = int(minhash._mixed(np.array([h ^ minhash._SEEDS[i]]))[0])
                bin_ = (mixed >> 32) * minhash.BINS >> 32 if i < minhash.BINS else i - minhash.BINS
                out[bin_] = min(int(out[bin_]), i << 32 | mixed & 0xFFFFFFFF)
            if out.max() < np.iinfo(np.uint64).max:
                break
        assert (out == minhash.sketch(hashes)).all()


def test_missed_shares():
    assert minhash.missed(0.85) < 1e-6 and minhash.missed(0.8) < 1e-4


def test_odd_rows_and_clashing_names(spark):
    rows = [(None, "a b c d e f g h i j", 1, 1, 1, 1), (None, None, 1, 1, 1, 1), (2, "A b c d e f g h i j", 1, 1, 1, 1), (2, "A b c d e f g h i j", 1, 1, 1, 1), (3, "word " * 60_000, 1, 1, 1, 1), (4, "", 1, 1, 1, 1)]
    docs = spark.createDataFrame(rows, CLASHING)
    got = minhash.minhash_components(docs).collect()
    assert len(got) == 6 and len({r.root for r in got if r.size == 6}) == 1 and {r.size for r in got} == {0, 1, 6}
    assert minhash.minhash_components(docs.limit(0)).collect() == []


def test_query_names_the_least_id(spark, tmp_path):
    rows = [*copies_with_edits(12), (None, "four words and more"), (None, "only here and once"), (None, None), (None, "only here and once")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = minhash.op13_minhash(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    sets, want = plain([r for r in rows if r[0] is not None], 85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {d: (len(sets[d]), want[d], want[d] == d) for d in sets}
    assert sorted((r.n_shingles, r.component_id or 0, r.kept) for r in got if r.doc_id is None) == [(0, 0, True), (1, 0, True), (1, 0, True), (1, 900, False)]
    assert spark.read.parquet(str(tmp_path / "documents.parquet")).where(F.col("doc_id").isNull()).count() == 4
