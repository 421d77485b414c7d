import gc
import hashlib
import random
import tracemalloc
import weakref
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm import bpe, decontamination, language_id, quality_classifier, quality_rules

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string, features string"
SF = "/root/testdata/sf0.01"


def table(spark, rows):
    return spark.createDataFrame([(d, t, lang, None, None, "x", "y", "z") for d, t, lang in rows], DOCS)


ODD = [(None, "a null id, with words enough to go on and on", None), (1, None, "en"), (2, "", "en"), (3, " \n\t ", "fr"), (4, "12 34 !!", "de"), (5, "x" * 300_000, "en"), (6, "same text", "en"), (6, "same text", "en"), (7, "日本語 текст é́", None)]


# ---- language identification


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.learn_languages(language_id.training_rows(docs))
    assert model[0] == ["de", "en", "es", "fr"]
    rows = language_id.op3_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(held) > 100
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    docs = table(spark, ODD)
    got = {(r.doc_id, r.lang_pred != "und") for r in language_id.predict_languages(docs, language_id.learn_languages(docs)).collect()}
    assert {(1, False), (2, False), (3, False), (4, False), (5, True), (6, True), (7, True), (None, True)} == got
    nothing = language_id.learn_languages(docs.where("lang = 'xx'"))
    assert {r.lang_pred for r in language_id.predict_languages(docs, nothing).collect()} == {"und"}
    assert language_id.keep_known_languages(docs, nothing).count() == 0
    assert language_id.keep_known_languages(docs, language_id.learn_languages(docs)).columns == docs.columns
    assert language_id.predict_languages(docs.limit(0), nothing).count() == 0


def test_language_matches_brute_force(spark):
    """Letter by letter in whole numbers, without the operator's tables; and however rows are dealt."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    texts = {r.doc_id: r for r in docs.collect()}
    space = language_id.LetterSpace()

    def vector(text):
        s = [0] + [int(space.symbol[ord(c)]) for c in (text or "").lower()] + [0]
        s = [x for k, x in enumerate(s) if k == 0 or x or s[k - 1]]
        if not any(s):
            return None
        total = np.zeros(language_id.DIMENSIONS, np.int64)
        for k in range(len(s) - 2):
            total += np.roll(space.placed[2][s[k]], 2).astype(np.int64) * np.roll(space.placed[2][s[k + 1]], 1) * space.placed[2][s[k + 2]]
        return total / np.sqrt(float((total**2).sum()))

    vectors = {d: vector(r.text) for d, r in texts.items()}
    learning = [d for d, r in texts.items() if r.lang is not None and vectors[d] is not None and zlib.crc32(str(d).encode()) % 5]
    names = sorted({texts[d].lang for d in learning})
    prototypes = np.array([sum(np.rint(vectors[d] * language_id.UNIT) for d in learning if texts[d].lang == x) for x in names])
    prototypes /= np.sqrt((prototypes**2).sum(axis=1, keepdims=True))
    seen = set()
    for n in (1, 5):
        dealt = docs.repartition(n, "text")
        found = language_id.predict_languages(dealt, language_id.learn_languages(language_id.training_rows(dealt)))
        seen.add(tuple(sorted((r.doc_id, r.lang_pred, r.score) for r in found.collect())))
    assert len(seen) == 1
    for d, lang, score in seen.pop():
        if vectors[d] is None:
            assert (lang, score) == ("und", 0)
        else:
            cosines = prototypes @ vectors[d]
            assert lang == names[int(cosines.argmax())] and score == pytest.approx(max(0, cosines.max()), abs=2e-6)


def test_language_ties_go_to_the_first_name(spark):
    docs = spark.createDataFrame([(1, "un mot", "fr"), (2, "un mot", "es"), (3, "un mot", None)], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang_pred) for r in language_id.predict_languages(docs, language_id.learn_languages(docs)).collect()} == {(1, "es"), (2, "es"), (3, "es")}


def test_bound_trigrams_are_nearly_orthogonal():
    space = language_id.LetterSpace()
    v = space.bind(np.array([65 * 64 + 3, 3 * 4096 + 70, 70 * 64]))
    assert np.abs(v @ v.T / v.shape[1] - np.eye(3)).max() < 0.2


def test_bundle_is_the_sum_of_bound_trigrams():
    space = language_id.LetterSpace()
    found, counts = space.trigrams("Abc abd")
    want = (space.bind(found) * counts[:, None]).sum(axis=0)
    got, n = space.bundle("Abc abd")
    assert n == counts.sum()
    assert np.allclose(got, want / np.linalg.norm(want), atol=1e-5)


def test_bundle_of_very_many_trigrams_takes_little_memory():
    """More distinct trigrams than are kept; their vectors are never floats all at once."""
    space, rng = language_id.LetterSpace(), random.Random(4)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz \u00e9\u0436", k=200_000))
    found, counts = space.trigrams(text)
    assert len(found) > language_id.KEPT_TRIGRAMS and space.kept.nbytes <= 16 << 20
    want = sum(counts[i : i + 1000].astype(float) @ space.bind(found[i : i + 1000]) for i in range(0, len(found), 1000))
    tracemalloc.start()
    got = [space.bundle(text)[0] for _ in range(2)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((v == want / np.sqrt((want * want).sum())).all() for v in got)
    assert space.n == language_id.KEPT_TRIGRAMS and most < 16 << 20


def test_a_worker_holds_the_model_of_one_stage():
    """Workers go on to the next stage; what the last one looked up in must not stay beside what this one does."""
    make = [language_id._space, lambda: bpe.tokenizer(bpe.vocabulary_path()), lambda: decontamination._windows(part)]
    part = decontamination.Part(SimpleNamespace(value=[("a", "one two three")]))
    for one in make:
        held = weakref.ref(one())
        assert one() is held()
        make[make.index(one) - 1]()
        gc.collect()
        assert held() is None


# ---- quality classifier


def test_quality_held_out_auc(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [r for r in quality_classifier.op4_quality_classifier(spark, SF).join(labels, "doc_id").collect() if r.held_out]
    good, bad = (np.array([r.score for r in rows if r.quality == q]) for q in (1, 0))
    assert (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2 > 0.97
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_quality_of_odd_rows(spark):
    docs = table(spark, ODD)
    features = quality_classifier.document_statistics(docs)
    labels = spark.createDataFrame([(4, 0, 0), (6, 1, 0), (5, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    trees = quality_classifier.fit_quality(features, labels)
    got = quality_classifier.score_quality(features, trees).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    none = quality_classifier.fit_quality(features, labels.limit(0))
    assert {r.score for r in quality_classifier.score_quality(features, none).collect()} == {0.5}
    assert quality_classifier.score_quality(features.limit(0), none).count() == 0


def test_trees_walk_like_one_row_at_a_time():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    trees = quality_classifier.fit_trees(x, y, rounds=20)
    score = trees.score(x)
    assert ((score >= 0.5) == y).mean() > 0.97
    for row, got in list(zip(x, score, strict=True))[:50]:
        total = trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + int(row[feature[at]] > threshold[at])
            total += leaf[at - len(feature)]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


def test_training_rows_are_bounded_however_they_repeat(spark):
    features = spark.range(6000).selectExpr("id % 3 AS doc_id", "array_repeat(cast(id as double), 18) AS features").unionAll(spark.range(3000).selectExpr("4L AS doc_id", "array_repeat(0D, 18) AS features"))
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, 1), (4, 1), (4, 0), (5, None)], "doc_id long, quality int")
    assert quality_classifier.training_sample(features, labels, 10_000).count() == 6002
    assert 300 < quality_classifier.training_sample(features, labels, 500).count() < 700
    many = spark.range(5000).selectExpr("id AS doc_id", "array_repeat(cast(id as double), 18) AS features")
    assert 300 < quality_classifier.training_sample(many, many.selectExpr("doc_id", "1 AS quality"), 500).count() < 700


def plain_split(x, y, bins, least, ridge):
    """The best split of the root, over all features and thresholds, by the gain written out."""
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = (1e-6, None, None)
    for j in range(x.shape[1]):
        for t in np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])):
            left = x[:, j] <= t
            if h[left].sum() < least or h[~left].sum() < least:
                continue
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + ridge) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + ridge)
            if gain > best[0] + 1e-9:
                best = (gain, j, t)
    return best


def test_fit_matches_splits_written_out():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 5)), 1)
    y = (x[:, 1] + 0.5 * x[:, 3] + rng.normal(size=300) * 0.3 > 0).astype(float)
    trees = quality_classifier.fit_trees(x, y, rounds=1, depth=1, bins=16)
    gain, j, t = plain_split(x, y, 16, 4.0, 1.0)
    assert gain > 0 and (trees.feature[0, 0], trees.threshold[0, 0]) == (j, t)
    p, right = y.mean(), x[:, j] > t
    want = [-0.2 * (p - y[s]).sum() / (s.sum() * p * (1 - p) + 1.0) for s in (~right, right)]
    assert trees.leaf[0] == pytest.approx(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["word", "Two", "3.", "#!", "é", "\n", "same line.\n", " \t"]), max_size=30).map(" ".join))
def test_statistics_written_out(text):
    raw, words = text.encode(), text.encode().split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    got = dict(zip(quality_classifier.FEATURES, quality_classifier.statistics(text), strict=True))
    share = lambda some: sum(b in some for b in raw) / len(raw) if raw else 0
    assert got["log_bytes"] == pytest.approx(np.log1p(len(raw))) and got["log_words"] == pytest.approx(np.log1p(len(words)))
    assert got["upper"] == pytest.approx(share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) and got["digits"] == pytest.approx(share(b"0123456789")) and got["code_marks"] == pytest.approx(share(b"#*$%&|<>"))
    assert got["high_bytes"] == pytest.approx(share(range(128, 256)))
    assert got["distinct_words"] == pytest.approx(len(set(words)) / len(words) if words else 0) and got["distinct_lines"] == pytest.approx(len(set(lines)) / len(lines) if lines else 0)
    assert got["top_word"] == pytest.approx(max(map(words.count, words), default=0) / max(len(words), 1))


# ---- quality rules


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", "|", "\n", "same line here it is\n", "x\x0by", "\xa0"]), max_size=60))
def test_repetition_base_matches_brute_force(parts):
    text = " ".join(parts)
    assert quality_rules.measure(text)[:6] == brute.repetition(text)


def test_repeated_passages_are_caught_and_clean_text_stays(spark):
    rng = random.Random(2)
    clean = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
    rows = [*ODD, (20, clean, None), (21, (clean[:300] + "\n") * 5, None), (22, clean + " " + clean[:500], None)]
    got = {r.doc_id: r for r in quality_rules.judge_repetition(table(spark, rows)).collect()}
    assert got[20].kept and not got[21].kept and not got[22].kept
    assert got[1].n_words == 0 and got[1].base_failed and not got[2].kept
    assert quality_rules.judge_repetition(table(spark, rows).limit(0)).count() == 0


def test_few_repeated_lines_count_by_their_characters():
    long = [" ".join(f"{a}{i}" for i in range(30)) for a in "abc"]
    assert quality_rules.measure("\n".join(["Title", *long, "Title", "Title"]))[6]
    three = quality_rules.measure("\n".join(["some short line of seven words here", long[0][:60], "some short line of seven words here"]))
    assert three[7] == ["repeated_lines", "repeated_line_characters"] or not three[6]


# ---- byte-pair encoding

LETTERS = st.sampled_from(["a", "the", "Z", "'s", "'", "'ll", "é", "́", "0", "²", " ", "\n", "#", "日", "Ж", "Σ", "İ", "🙂", "<|endoftext|>", "<|start", "\x1f", "\x85", " ", "ß", "ŉ"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(LETTERS, max_size=20).map("".join)))
def test_bpe_equals_the_library(text):
    ours = bpe.tokenizer(bpe.vocabulary_path())
    want = ours.library.encode(text, add_special_tokens=False).ids
    ids = ours.encode(text)
    assert ids == b"".join(i.to_bytes(4, "little") for i in want)
    assert ours.decode(ids) == ours.library.decode(want, skip_special_tokens=False)


def test_files_that_split_in_another_way_are_refused():
    with pytest.raises(ValueError, match="normalizer.*pre_tokenizer"):
        bpe.ForcedBoundaryBPE(bpe.vocabulary_path("byte_bpe_50k.json"))


def test_forced_boundaries_never_split_a_token():
    ours = bpe.tokenizer(bpe.vocabulary_path())
    assert all(len(ours.fragments(t.removesuffix("</w>"))) == 1 for t in list(ours.vocab)[::17] if t != "</w>")
    assert sum(len(ours.fragments(w)) for w in ["qqxzjv", "wzqx"]) > 2


def test_encode_documents_of_odd_rows(spark):
    got = {(r.doc_id, r.n_tokens, tuple(r.ids)) for r in bpe.encode_documents(table(spark, ODD), ids=True).collect()}
    library = bpe.tokenizer(bpe.vocabulary_path()).library
    assert got == {(d, len(ids), tuple(ids)) for d, t, _ in ODD for ids in [library.encode(t or "", add_special_tokens=False).ids]}
    digests = {r.doc_id: r.ids_sha256 for r in bpe.encode_documents(table(spark, ODD)).collect()}
    assert digests[1] == digests[2] == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_documents(table(spark, ODD).limit(0)).count() == 0


# ---- decontamination


def benchmark_case(spark):
    rng = random.Random(9)
    words = ["Alpha", "beta", "GAMMA", "é", "9", "x-y"]
    some = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [(1, some(14)), (2, "beta é"), (10, some(10)), (3, None), (4, " -- "), (5, "Unseen"), (None, "gamma 9 é beta alpha alpha gamma"), (1, some(11)), (6, some(70)), (7, "beta é 9 9 beta")]
    items.append((8, " ".join(items[8][1].split()[20:45])))
    rows = [*ODD, *((100 + i, some(rng.randrange(60)) + (items[i % 11][1] or "" if i % 3 == 0 else ""), None) for i in range(60)), (300, items[8][1] + " then " + items[0][1] + items[2][1], None)]
    return items, rows, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("most_words", [decontamination.AUTOMATON_WORDS, 60])
def test_decontamination_matches_brute_force(spark, most_words):
    items, rows, benchmark = benchmark_case(spark)
    if most_words == 60:
        assert len([0 for _ in decontamination.load_parts(benchmark, 60)]) > 2
    got = decontamination.find_contamination(table(spark, rows), benchmark, most_words).collect()
    keyed = [("" if i is None else i, t) for i, t in items]
    want, spans = [], {}
    for d, t, _ in rows:
        n, hit, found = brute.contamination(t, keyed)
        want.append((d or -1, n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), tuple(found), bool(hit)))
        at = decontamination.word_spans(t or "")
        runs = decontamination.merge([(i, i + 1) for i in hit])
        spans[d or -1] = [(at[a][0], at[b - 1][1]) for a, b in runs]
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, tuple(r["items"]), r.contaminated) for r in got) == sorted(want)
    assert {r.doc_id or -1: [tuple(x) for x in r.spans] for r in got} == spans
    clean = decontamination.without_contaminated(table(spark, rows), benchmark, most_words)
    assert clean.columns == table(spark, rows).columns
    assert sorted(r.doc_id or -1 for r in clean.collect()) == sorted(w[0] for w in want if not w[-1])


def test_windows_of_repeated_words_match_brute_force():
    rng = random.Random(1)
    for t in range(200):
        voc = ["a", "b", "c", "d"][: rng.randrange(1, 5)]
        items = [(str(i), " ".join(rng.choice(voc) for _ in range(rng.choice([3, 5, 8, 10, 12, 25, 40])))) for i in range(rng.randrange(1, 6))]
        text = " ".join(rng.choice(voc + ["z"] * (t % 2)) for _ in range(rng.randrange(80)))
        n, ranges, found = decontamination.Windows(items).scan(text)
        want, hit, names = brute.contamination(text, items)
        assert (n, sorted(found), {x for a, b in ranges for x in range(a, b)}) == (want, names, set(hit))


def test_decontamination_without_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = table(spark, ODD)
    assert not any(r.contaminated for r in decontamination.find_contamination(docs, none).collect())
    assert decontamination.without_contaminated(docs, none).count() == len(ODD)
    assert decontamination.find_contamination(docs.limit(0), none).count() == 0
