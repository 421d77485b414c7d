"""Fill-in-the-middle: a text's middle goes to its end, behind prefix and suffix, with marks between.

A text is a run of units, each a run of ASCII letters or one other character. Seeds drawn from the document's id cut it at
two unit ends and choose the form. Everything happens in one Arrow-batched pandas UDF: the ends of the units are gathered
in a compact array, so that a long text costs four bytes a unit, and two look-ups give the slices.
"""

from __future__ import annotations

from array import array
from hashlib import sha256

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import bounded_batches, table

UNIT = regex.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Hundredths of the texts that stay plain, and of the others that put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20


def seeds(doc_id: object, salt: str = "1") -> list[int]:
    """Four unsigned 32-bit numbers drawn from an id; a null id counts as the empty text."""
    digest = sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def unit_ends(text: str) -> array:
    """Where each unit ends, in code points."""
    return array("I", (m.end() for m in UNIT.finditer(text)))


def transform(text: str, drawn: list[int], plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """n units, form, code points of prefix and of middle, and the output."""
    ends = unit_ends(text)
    n = len(ends)
    a, b, c, d = drawn
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or c % 100 >= 100 - plain:
        return n, "plain", None, None, text
    at, to = sorted((a % (n + 1), b % (n + 1)))
    at, to = (ends[k - 1] if k else 0 for k in (at, to))
    before, middle, after = text[:at], text[at:to], text[to:]
    if d % 100 < suffix_first:
        return n, "spm", at, to - at, f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{middle}"
    return n, "psm", at, to - at, f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that ``transform`` made an output of. Marks can't arise where text meets a mark, as a mark begins with
    its only ``<`` and ends with its only ``>``, so the first of each is the one that was put in."""
    if form == "plain":
        return output
    outer, middle = output.split(MIDDLE, 1)
    if form == "spm":
        after, before = outer.removeprefix(SUFFIX).split(PREFIX, 1)
    else:
        before, after = outer.removeprefix(PREFIX).split(SUFFIX, 1)
    return before + middle + after


_FIELDS = "n long, form string, prefix_chars long, middle_chars long"


def _transformer(with_text: bool, plain: int, suffix_first: int):
    columns = ["n", "form", "prefix_chars", "middle_chars", *(["output"] if with_text else ["output_sha256", "restored_sha256"])]

    def rows(ids: pd.Series, texts: pd.Series):
        for doc_id, text in zip(ids, texts, strict=True):
            n, form, before, middle, output = transform(text, seeds(doc_id), plain, suffix_first)
            if with_text:
                yield n, form, before, middle, output
            else:
                yield n, form, before, middle, sha256(output.encode()).hexdigest(), sha256(restore(output, form).encode()).hexdigest()

    def apply(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame(list(rows(ids, texts)), columns=columns)
        return found.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return F.pandas_udf(apply, f"{_FIELDS}, " + ("output string" if with_text else "output_sha256 string, restored_sha256 string"))


def _applied(docs: DataFrame, with_text: bool, plain: int, suffix_first: int) -> Column:
    ship(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    return _transformer(with_text, plain, suffix_first)(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))


def fill_in_middle(docs: DataFrame, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of each row.

    A null text counts as empty; an empty text, and one that holds a mark, stays plain. A null id draws its seeds from the
    empty text. Rows that repeat an id draw the same seeds; a text of any length is cut as a whole. Further columns are
    ignored, whatever they are called; an empty table gives an empty result. One map pass, no shuffle.
    """
    made = docs.select("doc_id", _applied(docs, True, plain, suffix_first).alias("made"))
    return made.select("doc_id", "made.*")


def restored(outputs: DataFrame) -> DataFrame:
    """``outputs`` (output and form, and any other columns but ``restored``) with the texts from which they were made.

    A null output or form gives null.
    """
    ship(outputs.sparkSession)
    bounded_batches(outputs.sparkSession)

    @F.pandas_udf("string")
    def rebuilt(output: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else restore(o, f) for o, f in zip(output, form, strict=True)], dtype=object)

    return outputs.withColumn("restored", rebuilt("output", "form"))


def digests(docs: DataFrame, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """As fill_in_middle, with the digests of the output and of what ``restore`` makes of it in place of the output."""
    return docs.select("doc_id", _applied(docs, False, plain, suffix_first).alias("made")).select("doc_id", "made.*")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS seed FROM documents),
units AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u,
         ('0x' || seed[1:8])::BIGINT AS h1, ('0x' || seed[9:16])::BIGINT AS h2, ('0x' || seed[17:24])::BIGINT AS h3, ('0x' || seed[25:32])::BIGINT AS h4 FROM drawn),
cuts AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cuts)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts
"""
