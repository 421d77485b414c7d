import random
import re

import pytest
from pyspark.sql import functions as F

from voxloom.functions import text
from voxloom.operators import rules

WORDS = ["the", "The", "cat", "Cat's", "dog", "über", "ÜBER", "straße", "o'clock", "x1", "1", "a-b", "Noooo", "İs", "is", "K", "k", "don't"]


def plain(source, table):
    """One rule after the other, longest first, then least id."""
    done = []
    for ident, find, speak in sorted(table, key=lambda r: (-len(r[1].strip()), r[0])):
        pattern = re.compile(rf"(?<![\w'])(?<!_){re.escape(find.strip())}(?![\w'])", re.IGNORECASE)
        if pattern.search(source):
            source, done = pattern.sub(lambda _, s=speak: s, source), [*done, ident]
    return source, done


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_rules_of_a_table_equal_one_after_the_other(spark, monkeypatch, broadcast):
    monkeypatch.setattr(rules, "BROADCAST_RULES", broadcast)
    monkeypatch.setattr(rules, "BROADCAST_TEXTS", broadcast)
    rng = random.Random(3)
    finds = ["the", "the cat", "cat", "Cat's", "dog", "ÜBER", "o'clock", "x1", "a-b", "noooo", "thee", "thy", "don't", "...", "--", "dog!", "is"]
    table = [(k, f, s) for k, (f, s) in enumerate(zip(finds, ["thee", "thy pet", "feline", "$1\\2", "hound the", "over", "oh", "ex one", "a b", "no", "ye thy", "cat", "do not", " pause ", "-", "hound", "be"], strict=True))]
    texts = [(i, " ".join(rng.choice([*WORDS[:13], "...", "--", "dog!", "is", "thee", "don't"]) + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(25)))) for i in range(200)]
    rows = spark.createDataFrame([*texts, (5, None), (None, "the cat is mine"), (None, "nothing")], "id long, body string")
    got = rules.apply_rule_table(rows, "id", "body", spark.createDataFrame(table, "id long, find string, speak_as string")).collect()
    assert len(got) == 203
    for r in got:
        assert (r.spoken, r.applied) == ((None, []) if r.body is None else plain(r.body, table)), r.body


def test_rules_of_a_table_equal_expressions(spark):
    table = [("the", "thee"), ("Über", "over"), ("İs", "be"), ("k", "kay"), ("straße", "street"), ("a-b", "c")]
    rows = spark.createDataFrame([(i, f"{a} {b}, {a}-{b}") for i, (a, b) in enumerate((a, b) for a in WORDS for b in WORDS)], "id long, body string")
    want = {r.id: r.w for r in rows.select("id", text.apply_rules(F.col("body"), table).alias("w")).collect()}
    got = rules.apply_rule_table(rows, "id", "body", spark.createDataFrame([(k, f, s) for k, (f, s) in enumerate(table)], "id long, find string, speak_as string"))
    assert {r.id: r.spoken for r in got.collect()} == want


def test_five_thousand_rules_have_a_plan_of_constant_size(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, " ".join(f"word{rng.randrange(9000)}" for _ in range(40))) for i in range(300)], "id long, body string")
    sizes = []
    for n in (50, 5000):
        table = [(k, f"WORD{k}", f"said{k}") for k in range(n)]
        got = rules.apply_rule_table(rows, "id", "body", spark.createDataFrame(table, "id long, find string, speak_as string"))
        sizes.append(len(got._jdf.queryExecution().optimizedPlan().toString()))
        for r in got.collect():
            words = r.body.split()
            assert r.spoken == " ".join(f"said{w[4:]}" if int(w[4:]) < n else w for w in words)
            assert sorted(r.applied) == sorted({int(w[4:]) for w in words if int(w[4:]) < n})
    assert abs(sizes[0] - sizes[1]) < 300
    counts = {r.id: r.texts for r in rules.rule_counts(rows, "body", spark.createDataFrame(table, "id long, find string, speak_as string")).collect()}
    assert len(counts) == 5000 and all(n == sum(f"word{k}" in r.body.split() for r in got.collect()) for k, n in counts.items() if k < 3)


def test_no_rules_and_no_texts(spark):
    none = spark.createDataFrame([], "id long, find string, speak_as string")
    rows = spark.createDataFrame([(1, "the cat")], "id long, body string")
    assert [tuple(r) for r in rules.apply_rule_table(rows, "id", "body", none).collect()] == [(1, "the cat", "the cat", [])]
    assert rules.apply_rule_table(rows.limit(0), "id", "body", none).collect() == []


def test_plain_words_are_counted_without_a_pattern(spark, monkeypatch):
    monkeypatch.setattr(rules, "whole_words", lambda find: F.lit("(?!)"))  # a pattern that matches nothing
    rows = spark.createDataFrame([("The the THE cat-dog",), ("dog's dog",), ("thee",), (None,)], "body string")
    table = spark.createDataFrame([(1, "the"), (2, "Dog"), (3, "dog's"), (4, "no")], "id long, find string")
    assert {r.id: r.texts for r in rules.rule_counts(rows, "body", table).collect()} == {1: 1, 2: 2, 3: 1, 4: 0}


def test_other_words_are_counted_by_pattern(spark):
    rows = spark.createDataFrame([("stra\u00dfe STRASSE",), ("strasse",), ("\u212aay kay",), ("\u212aay",), ("a cat",), ("A  cat",)], "body string")
    table = spark.createDataFrame([(1, "strasse"), (2, "stra\u00dfe"), (3, "kay"), (4, "a cat")], "id long, find string")
    assert {r.id: r.texts for r in rules.rule_counts(rows, "body", table).collect()} == {1: 2, 2: 1, 3: 2, 4: 1}


def test_rules_of_one_word_are_folded_over_words_not_texts(spark, monkeypatch):
    table = [(1, "the", "thee"), (2, "cat", "a-b, c"), (3, "dog", "")]
    rows = spark.createDataFrame([(1, " The cat;the dog. "), (2, "cat"), (2, "the dog"), (None, "cat the"), (3, "thee")], "id long, body string")
    want = sorted(((r.id, *plain(r.body, table)) for r in rows.collect()), key=str)
    # a pattern that matches a word alone, and none within a text
    monkeypatch.setattr(rules, "whole_words", lambda find: F.concat(F.lit("(?iu)^"), find, F.lit("$")))
    got = rules.apply_rule_table(rows, "id", "body", spark.createDataFrame(table, "id long, find string, speak_as string"))
    assert sorted(((r.id, r.spoken, r.applied) for r in got.collect()), key=str) == want
