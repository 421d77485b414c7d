import random

import numpy as np
import pytest

import corpus_pipeline
from voxloom.llm import line_dedup, simhash
from voxloom.llm.components import connected_components

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, root long, first string"


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(40)] + [(5, 5), (None, 4)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if None not in e and e[0] != e[1]]
    assert got == brute.components({n for e in real for n in e}, real)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def linked(spark, fps, cell=1024):
    links = simhash.near_links(spark.createDataFrame([(int(f),) for f in fps], "fp long"), cell).collect()
    assert all((r.a ^ r.b) & (1 << 64) - 1 and bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 3 for r in links)
    return brute.components({int(f) for f in fps}, [(r.a, r.b) for r in links])


@pytest.mark.parametrize("cell", [8, 1024])
def test_near_links_connect_what_all_pairs_connect(spark, cell):
    rng = random.Random(cell)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps)[:20]:
        for _ in range(12):
            g = f
            for _ in range(rng.randrange(6)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    fps = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    pairs = [(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3]
    assert linked(spark, fps, cell) == brute.components(set(fps), pairs)


def test_blocks_share_a_key_within_three_bits():
    rng = random.Random(4)
    for _ in range(500):
        bits = sum(1 << b for b in rng.sample(range(64), 3))
        level = [m for m in simhash.masks() if bits & m & (1 << 64) - 1 == 0]
        assert level
        for _ in range(simhash.LEVELS):
            level = [f for m in level for f in simhash.finer_masks(m) if bits & f & (1 << 64) - 1 == 0]
            assert level and len({bin(f & (1 << 64) - 1).count("1") for f in level}) < 4


def test_a_key_of_very_many_fingerprints_is_split(spark):
    """10^5 distinct fingerprints agree in two blocks; every planted pair is found, and cells stay small."""
    rng = np.random.default_rng(8)
    fixed = np.uint64(simhash.masks()[0] & (1 << 64) - 1)
    fps = np.unique(rng.integers(0, 1 << 63, 100_000, np.uint64) * np.uint64(2) & ~fixed)
    planted = fps[::100] ^ np.uint64(0b111 << 50)
    fps = np.unique(np.concatenate((fps, planted))).view(np.int64)
    rows = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    compared = simhash.shared_cells(rows).groupBy("cell").count().selectExpr("sum(count * count)").first()[0]
    assert compared < 20 * len(fps) * simhash.CELL  # at most; without finer keys 10^10
    links = simhash.near_links(rows).collect()
    roots = brute.components(set(fps.tolist()), [(r.a, r.b) for r in links])
    wanted = [(int(a), int(b)) for a, b in zip((planted ^ np.uint64(0b111 << 50)).view(np.int64), planted.view(np.int64), strict=True)]
    assert all(roots[a] == roots[b] for a, b in wanted)


def near_docs():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = [(None, "null id"), (1, None), (2, ""), (3, " \t\n"), (4, "ONE two"), (5, "one TWO"), (6, "word " * 3000), (6, "word " * 3000)]
    for i in range(10, 40, 3):
        base = [rng.choice(words) for _ in range(120)]
        other = list(base)
        other[rng.randrange(120)] = "changed"
        rows += [(i, " ".join(base)), (i + 1, " ".join(base)), (i + 2, " ".join(other))]
    return [(d, t, None, None, None, 1, "x") for d, t in rows]


def test_simhash_matches_brute_force(spark):
    rows = near_docs()
    fps = {t: brute.simhash(t) for _, t, *_ in rows}
    pairs = [(a, b) for a in fps.values() for b in fps.values() if a < b and bin(a ^ b).count("1") <= 3]
    roots = brute.components(set(fps.values()), pairs)
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[roots[fps[t]]] = min(d, least.get(roots[fps[t]], d))
    want = sorted((d or -1, fps[t], least.get(roots[fps[t]], -1)) for d, t, *_ in rows)
    got = simhash.simhash_components(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or -1, r.fp & (1 << 64) - 1, r.component_id or -1) for r in got) == want


@pytest.mark.parametrize("few", [simhash.BROADCAST_ROWS, 0])
def test_keep_first_keeps_one_of_each_group(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", few)
    docs = spark.createDataFrame(near_docs(), DOCS)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(set(got)) and {1, 4, 6, None} <= set(got) and not {2, 3, 5} & set(got)
    components = simhash.simhash_components(docs).select("root").distinct().count()
    assert len(got) == components
    clashing = docs.selectExpr("doc_id", "text", "1 as _row", "2 as _id", "3 as _hash", "4 as _doc", "5 as first", "6 as gone")
    assert sorted(map(str, simhash.keep_first(clashing).select("doc_id").collect())) == sorted(str(r) for r in simhash.keep_first(docs).select("doc_id").collect())


def test_keep_first_of_ties_and_repeated_rows(spark):
    rows = [(1, "same words here", "a"), (1, "same words here", "a"), (1, "SAME words here", "b"), (None, "same words here", "c"), (None, None, "d"), (None, None, "d"), (None, "", "e"), (2, "x " * 200_000, "f")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(kept) == 3 and {r.doc_id for r in kept} == {1, 2, None}
    assert all(not r.text for r in kept if r.doc_id is None)


def test_simhash_of_a_very_long_text(spark):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "something else entirely")], "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    assert got[1].fp == got[2].fp or bin((got[1].fp ^ got[2].fp) & (1 << 64) - 1).count("1") <= 3
    assert got[1].component_id == got[2].component_id == 1 and got[3].component_id == 3
    assert got[1].fp & (1 << 64) - 1 == brute.simhash(text)


def test_simhash_of_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.simhash_components(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def copies_with_edits():
    """Copies with 1 to 12 changed words, on both sides of a similarity of 0.8; most lie beyond 3 bits."""
    rng = random.Random(11)
    rows = [(900, "four words and more"), (901, "Four words AND more"), (902, "four words and fewer"), (903, None), (904, "")]
    for i in range(0, 160, 8):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([60, 200, 900]))]
        for k in range(8):
            other = list(base)
            for _ in range(k * len(base) // 200):
                other[rng.randrange(len(base))] = f"x{rng.randrange(500)}"
            rows.append((i + k, " ".join(other)))
    return rows


def test_pipeline_drops_what_brute_force_finds(spark):
    rows = copies_with_edits()
    sets = {d: brute.shingle_set(t) for d, t in rows}
    want = brute.components(set(sets), [(a, b) for a in sets for b in sets if a < b and brute.jaccard(sets[a], sets[b]) >= 0.8])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.dedup_documents(spark, docs, "").collect()} == set(want.values())
    assert corpus_pipeline.dedup_documents(spark, docs.limit(0), "").count() == 0


def line_docs():
    rng = random.Random(3)
    base = ["The quick brown fox jumps over it", "Eine Zeile mit Umlauten äöü und mehr", "short", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "All rights reserved by nobody"]
    rows = [(None, "short\nnull id line that is long"), (0, None), (1, ""), (2, "\n \n\t"), (3, "Short\nshor"), (4, "The  QUICK brown\tfox jumps over it")]
    for d in range(5, 40):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            x = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(x))
                x[at : at + rng.randrange(2)] = rng.choice(["", "z", "é", "a"])
            lines.append("".join(x))
        rows.append((d, "\n".join(lines)))
    return rows + [rows[-1]]


def test_line_dedup_matches_brute_force(spark):
    rows = line_docs()
    docs = spark.createDataFrame([(d, t, None, None, len(t) if t else None, 1, "x") for d, t in rows], DOCS)
    order = {d: (d is None, d or 0) for d, _ in rows}
    gone = brute.dropped_lines([(order[d], t) for d, t in rows])
    got = line_dedup.dedup_lines(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, tuple(r.dropped)) for r in got) == sorted((*order[d], tuple(sorted(i for k, i in gone if k == order[d]))) for d, _ in rows)
    for r in got:
        text = next(t for d, t in rows if d == r.doc_id)
        assert r.text == (None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in r.dropped))
        assert r.n_lines == (0 if text is None else len(text.split("\n")))
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[0] is None and texts[1] == "" and texts[2] == "\n \n\t"
    assert set(texts) == {r.doc_id for r in got if not r.n_dropped or r.text.strip()}
    assert all(r.n_chars is None or r.n_chars == len(r.text) for r in kept.collect())


@pytest.mark.parametrize("near_chars", [0, 1, 4])
def test_line_dedup_of_short_lines_matches_brute_force(spark, near_chars):
    rng = random.Random(near_chars)
    rows = [(d, "\n".join("".join(rng.choice("abc ") for _ in range(rng.randrange(7))) for _ in range(3))) for d in range(30)]
    got = line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), near_chars).collect()
    assert {(r.doc_id, r.line_no) for r in got} == brute.dropped_lines(rows, near_chars)


def test_line_dedup_of_long_lines_and_clashing_names(spark):
    long = "".join(random.Random(2).choice("abcdefgh ") for _ in range(20_000))
    rows = [(1, long + "\nend of the first one"), (2, long[:9_000] + "z" + long[9_001:]), (3, "\n".join(f"line {i} of a very long text" for i in range(2_000)))]
    docs = spark.createDataFrame([(*r, 7, "h1") for r in rows], "doc_id long, text string, _drop int, h1 string")
    kept = {r.doc_id: r for r in line_dedup.without_repeated_lines(docs).collect()}
    assert set(kept) == {1, 3} and kept[1].text == rows[0][1] and kept[1]._drop == 7 and kept[1].h1 == "h1"
    # lines 0 to 9 differ from an earlier one by one character, and so do 10 to 99 and so on
    assert kept[3].text.split("\n")[0] == "line 0 of a very long text" and len(kept[3].text) < len(rows[2][1])


def test_line_dedup_without_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(line_docs(), "doc_id long, text string")
    want = sorted(map(str, line_dedup.dedup_lines(docs).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert sorted(map(str, line_dedup.dedup_lines(docs).collect())) == want


def test_variant_hashes_are_those_of_the_shorter_lines():
    for line in ("a", "abca", "äöü ß日本", "aaaa"):
        found = line_dedup.variant_hashes(line).tolist()
        assert len(found) == len(line) + 1
        assert found[1:] == [int(line_dedup.variant_hashes(line[:i] + line[i + 1 :])[0]) for i in range(len(line))]
    some = {w: int(line_dedup.variant_hashes(w)[0]) for w in ("", "a", "b", "ab", "ba", "aa", "aab", "aba", "baa")}
    assert len(set(some.values())) == len(some)
    assert len(line_dedup.variant_hashes("x" * 2_000_000)) == 2_000_001


def test_finer_blocks_lose_no_match(spark):
    rng = random.Random(5)
    bases = ["".join(rng.choice("ab ") for _ in range(n)) for n in (20, 23, 24, 40)]
    lines = set()
    for base in bases:
        for _ in range(12):
            at = rng.randrange(len(base))
            lines.add(base[:at] + rng.choice(["", "c", base[at] + "d"]) + base[at + 1 :])
    lines |= {"".join(rng.choice("xyz") for _ in range(30)) for _ in range(20)}
    near = spark.createDataFrame([(i, t) for i, t in enumerate(sorted(lines))], "h1 long, norm string")
    kept = {r.norm for r in line_dedup._close(near).collect()}
    assert {a for a in lines for b in lines if a != b and brute.edit_distance(a, b) == 1} <= kept


def test_line_dedup_of_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.without_repeated_lines(empty).count() == 0


def test_every_pair_within_one_edit_is_found(spark):
    rng = random.Random(11)
    base = "".join(rng.choice("abc") for _ in range(21))
    rows = [(0, base)]
    for i in range(21):
        rows += [(3 * i + 1, base[:i] + "d" + base[i:]), (3 * i + 2, base[:i] + base[i + 1 :]), (3 * i + 3, base[:i] + "e" + base[i + 1 :])]
    gone = {r.doc_id for r in line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), near_chars=20).collect()}
    assert gone == {d for d, _ in brute.dropped_lines(rows)} == set(range(1, 64))
