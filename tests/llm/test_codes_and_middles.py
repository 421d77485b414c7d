import hashlib
import random
import re

import numpy as np
import pytest

from voxloom.llm import fill_in_middle as fim
from voxloom.llm import vector_codes as vc

# -- fill in the middle


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    seed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(seed[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def fim_rows():
    rng = random.Random(2)
    pieces = ["word", "Über", " ", "\n", "<", "P>", "<P", ">", "S>", "<S>", "M", "7", "\r\n", "\U0001f600", "é", "é", "\x00", "it's"]
    rows = [(d, "".join(rng.choices(pieces, k=rng.randrange(30)))) for d in range(300)]
    return [*rows, (None, "no id here"), (None, None), (7, None), (8, ""), (9, "<P"), (10, "<M>"), (11, "x" * 300_000 + " " + "y z" * 100_000), rows[3]]


def test_fill_in_middle_matches_brute_force_and_is_restored(spark):
    rows = fim_rows()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, output string, n int").repartition(3)
    got = fim.fill_in_middle(docs)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted([tuple(r) for r in got.collect()], key=key) == sorted([(d, *plain_fim(d, t)) for d, t in rows], key=key)
    back = fim.restored(got).collect()
    assert sorted((r.doc_id or -1, r.restored) for r in back) == sorted((d if d else -1, t or "") for d, t in rows)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


def test_fill_in_middle_digests(spark, tmp_path):
    rows = fim_rows()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(d, *(x := plain_fim(d, t))[:4], sha(x[4]), sha(t or "")) for d, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted([tuple(r) for r in fim.op11_fill_in_middle(spark, str(tmp_path)).collect()], key=key) == sorted(want, key=key)


def test_restored_of_null(spark):
    made = spark.createDataFrame([(None, "psm"), ("x", None), ("x", "plain")], "output string, form string")
    assert [r.restored for r in fim.restored(made).collect()] == [None, None, "x"]


# -- vector codes


def ints(v):
    return [int(np.floor(np.float64(x) * 4096)) for x in v]


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label)."""
    kept = [(i, ints(v), label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: r[0])
    w = len(order[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in order[:entries]] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(best(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, members in groups.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out, labels = [], {}
    for i, v, label in kept:
        found = [best(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        labels[label] = labels.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, c, e, labels[label], digest) for i, c, e, label in out)


def vector_rows(n=150, dims=16, seed=1, grid=None):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dims).astype(np.float32)
        v = np.round(v * grid) / grid if grid else v
        rows.append((int(1000 - 3 * i), [float(np.float32(x)) for x in v], int(rng.integers(0, 3)) if i % 7 else None))
    rows += [(2000, None, 1), (2001, [float("nan")] + [0.0] * (dims - 1), 1), (2002, [None] + [0.0] * (dims - 1), 2), (2003, [float("-inf")] * dims, 2), (-9000, [float("inf")] * dims, 2)]
    rows += [(3000 + i, [0.25] * dims, 5) for i in range(40)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("grid", [None, 2])
def test_vector_codes_match_brute_force(spark, tmp_path, grid):
    """grid: rounded components, so that many distances tie."""
    rows = vector_rows(grid=grid)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = vc.op12_vector_codes(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == plain_codes(rows)


def test_trees_find_what_a_full_comparison_finds():
    rng = np.random.default_rng(0)
    for entries, spread, width in ((1, 5, 3), (2, 3, 1), (5, 2, 2), (16, 3, 2), (16, 4000, 8), (40, 100_000, 4)):
        book = rng.integers(-spread, spread + 1, (entries, width))
        rows = np.concatenate((rng.integers(-spread, spread + 1, (3000, width)), book))
        found, best, compared = vc.nearest(rows, book, vc.build_tree(book))
        square = ((rows[:, None] - book[None]) ** 2).sum(axis=2)
        assert (found == square.argmin(axis=1)).all() and (best == square.min(axis=1)).all()
        if entries == 40:  # rows close to entries leave out most of the others
            assert vc.nearest(book + 5, book, vc.build_tree(book))[2] < len(book) * entries * 0.5 and compared < len(rows) * entries


def test_trees_with_far_entries_and_great_numbers():
    most = vc.greatest_component(64)
    book = np.array([[most] * 8, [-most] * 8, [most - 1] * 8, [0] * 8])
    rows = np.concatenate((book, book - 1, book // 2))
    found, best, _ = vc.nearest(rows, book, vc.build_tree(book))
    square = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)) for e in book] for r in rows]
    assert found.tolist() == [s.index(min(s)) for s in square] and best.tolist() == [min(s) for s in square]


def test_vector_codes_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vc.encode_vectors(empty, vc.learn_codebooks(empty)).collect() == []
    rows = [(1, [1.0] * 16, 1), (None, [2.0] * 16, None), (2, [3.0] * 8, 1), (2, [], 1), (3, [1e30] * 16, 1), (1, [1.0] * 16, 1)]
    some = spark.createDataFrame([(i, v, label, "x", 0) for i, v, label in rows], f"{SCHEMA}, codes string, error int")
    books = vc.learn_codebooks(some, entries=2, rounds=1)
    assert books.shape == (8, 2, 2)
    got = vc.with_label_errors(vc.encode_vectors(some, books).cache()).collect()
    assert len(got) == 6 and sorted(str(r.vec_id) for r in got if r.codes is None) == ["2", "2"]
    assert all(len(r.codes) == 8 for r in got if r.codes is not None) and {r.label_error for r in got if r.label is None} == {r.error for r in got if r.label is None}
    back = vc.decode_vectors(vc.encode_vectors(some, books), books).collect()
    assert all((r.approximation is None) == (r.codes is None) and (r.codes is None or len(r.approximation) == 16) for r in back)


def test_codebooks_do_not_depend_on_partitions(spark):
    some = spark.createDataFrame(vector_rows(), SCHEMA)
    one, many = (vc.learn_codebooks(some.repartition(n)) for n in (1, 7))
    assert (one == many).all()
