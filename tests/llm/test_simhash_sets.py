"""The pipeline's stage simhash_dedup: SimHash candidates, sets that decide."""

import random

import numpy as np
import pytest

import corpus_pipeline
from voxloom.llm import minhash, simhash_sets

from .test_minhash import CLASHING, copies_with_edits, plain


def found(spark, rows):
    got = simhash_sets.set_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    least = {}
    for r in got:
        if r.size:
            least[r.root] = min(r.doc_id, least.get(r.root, r.doc_id))
    assert len(got) == len(rows)
    return {r.doc_id: (r.size, least[r.root] if r.size else r.doc_id) for r in got}


def test_the_stage_goes_by_fingerprints(spark, monkeypatch):
    def no_sketches(*_):
        raise AssertionError("MinHash in the stage of SimHash")

    monkeypatch.setattr(minhash, "minhash_links", no_sketches)
    monkeypatch.setattr(minhash, "signatures", no_sketches)
    asked = []
    near = simhash_sets.near_links
    monkeypatch.setattr(simhash_sets, "near_links", lambda keyed: asked.append(near(keyed)) or asked[0])
    rows = copies_with_edits()
    _, want = plain(rows, 80)
    got = {r.doc_id for r in corpus_pipeline.dedup_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    wordless = {d for d, t in rows if not (t or "").split()}
    assert got == set(want.values()) - wordless | {min(wordless)}
    assert asked[0].count() > 50


@pytest.mark.parametrize(("crowd", "cell", "stars", "broadcast"), [(2, 1, 1, 0), (10, 8, 2, 200_000), (simhash_sets.CROWD, simhash_sets.CELL, 64, 200_000)])
def test_components_match_brute_force(spark, monkeypatch, crowd, cell, stars, broadcast):
    monkeypatch.setattr(simhash_sets, "CROWD", crowd)
    monkeypatch.setattr(simhash_sets, "CELL", cell)
    monkeypatch.setattr(minhash, "CELL_SHINGLES", crowd * 1000)
    monkeypatch.setattr(minhash, "STAR", stars)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", broadcast)
    rows = copies_with_edits()
    sets, want = plain(rows, 80)
    assert found(spark, rows) == {d: (len(sets[d]), want[d]) for d in sets}
    assert len(set(want.values())) < 0.6 * len(rows)


def pair(rng, n):
    """Two texts' hashes with a similarity as little above 0.8 as n shingles allow."""
    common = -(-4 * n // 5)
    drawn = rng.integers(0, 1 << 63, n, np.uint64)
    own = common + rng.integers(0, n - common + 1)
    return np.unique(drawn[:own]), np.unique(np.append(drawn[:common], drawn[own:]))


def test_pairs_at_the_similarity_share_a_key_and_are_near():
    rng = np.random.default_rng(2)
    for n, trials in ((5, 1500), (9, 500), (15, 500), (30, 500), (300, 300), (5000, 20)):
        a, b = (np.stack(x) for x in zip(*((simhash_sets.fingerprint(p), simhash_sets.fingerprint(q)) for p, q in (pair(rng, n) for _ in range(trials))), strict=True))
        differ = np.unpackbits((a ^ b).view(np.uint8), axis=1, bitorder="little")
        verify, rest = differ[:, : simhash_sets.VERIFY_BITS], differ[:, simhash_sets.VERIFY_BITS :]
        near = (verify.sum(axis=1) <= simhash_sets.MOST_BITS) & (verify[:, :64].sum(axis=1) <= simhash_sets.FIRST_BITS)
        keys = simhash_sets.choices(9)[: None if n <= simhash_sets.SMALL else simhash_sets.keys_needed(simhash_sets.DIFFERENT, 9)]
        shared = np.any([~rest[:, c].any(axis=1) for c in keys], axis=0)
        assert (~(near & shared)).sum() <= 1 + trials // 500, n
    assert simhash_sets.missed(simhash_sets.DIFFERENT, 9, simhash_sets.keys_needed(simhash_sets.DIFFERENT, 9)) <= simhash_sets.MISSED


def test_a_fingerprint_is_the_majority_of_each_bit():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 600):
        hashes = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        words = [[int(minhash._mixed(np.array([h ^ s]))[0]) for s in simhash_sets._SEEDS] for h in hashes]
        for lane in (0, 3, 15):
            want = 0
            for bit in range(64):
                on = [w[lane] >> bit & 1 for w in words]
                want |= (2 * sum(on) > len(on) or (2 * sum(on) == len(on) and on[0])) << bit
            assert int(simhash_sets.fingerprint(hashes)[lane]) == want


def test_a_large_family_and_many_others(spark, monkeypatch):
    """Near copies crowd the keys, and other texts meet in them by chance; cells stay a small part of all pairs."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(2000):
        other = list(base)
        other[rng.randrange(300)] = f"x{d}"
        rows.append((d, " ".join(other)))
    rows += [(d, " ".join(f"y{rng.randrange(10**6)}" for _ in range(40))) for d in range(2000, 3000)]
    monkeypatch.setattr(simhash_sets, "CROWD", 500)
    seen = []
    dealt = minhash._dealt
    monkeypatch.setattr(minhash, "_dealt", lambda *a: seen.append(dealt(*a)) or seen[-1])
    roots = simhash_sets.set_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert len({r.root for r in roots}) == 1001
    assert len({r.root for r in roots if r.doc_id < 2000}) == 1
    assert seen[-1].count() < 2 * len(rows)


def test_odd_rows_and_clashing_names(spark):
    rows = [(None, "a b c d e f g h i j", 1, 1, 1, 1), (None, None, 1, 1, 1, 1), (2, "A b c d e f g h i j", 1, 1, 1, 1), (2, "A b c d e f g h i j", 1, 1, 1, 1), (3, "word " * 60_000, 1, 1, 1, 1), (4, "", 1, 1, 1, 1)]
    docs = spark.createDataFrame(rows, CLASHING)
    got = simhash_sets.set_components(docs).collect()
    assert len(got) == 6 and len({r.root for r in got if r.size == 6}) == 1 and {r.size for r in got} == {0, 1, 6}
    assert simhash_sets.set_components(docs.limit(0)).collect() == []
