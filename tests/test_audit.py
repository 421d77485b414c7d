"""The corpus audit computes each value of a text once."""

from pyspark.sql import functions as F

from voxloom.functions import text
from voxloom.plans import pipelines


def test_the_audit_looks_for_spellings_once(spark):
    lines = spark.createDataFrame([(1, 1, "a *sigh* b")], "doc_id long, n_chars long, text string")
    audited = pipelines.corpus_audit(lines, "doc_id", "n_chars").select("mask")
    plan = audited._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ssz|(ha|he|ho|ah|wa)") == 1 and plan.count("regexp_count") < 3
    assert [r.mask for r in audited.collect()] == [text.AUDIT_BITS["mapped_ok"]]


def test_many_cues_of_one_text(spark):
    """The first of equal cues stays, in order; 30,000 of them in one text."""
    inner = [f"{'Cue' if k % 3 else 'cUE'}{k % 10_000}" for k in range(30_000)]
    want = {}
    for x in inner:
        want.setdefault(x.lower(), x)
    rows = spark.createDataFrame([(" ".join(f"* {x}*" for x in inner),), ("none",), (None,)], "c string")
    got = [r[0] for r in rows.select(text.cues(F.col("c"))).collect()]
    assert got == [list(want.values()), [], None]


def test_spellings_with_hyphens(spark):
    words = ["b-b-but", "a-b-c", "x-ray", "so-called", "w-w-", "-w-w", "to--t-tell", "Haa", "mmm"]
    rows = spark.createDataFrame([(f"say {w} now", w) for w in words], "c string, w string")
    assert all(r[0] == r[1] for r in rows.select(text.unfriendly_spelling(F.col("c")), text.unfriendly_token(F.col("w"))).collect())
