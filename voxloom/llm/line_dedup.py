"""Line dedup with a deletion-neighbourhood join.

Lines are compared in a normal form (lower case, single spaces). Two lines within one edit (insertion, deletion or
substitution of a character) share a variant: one of the lines itself, or both without the character at one place. So
lines emit hashed keys of all variants with one deletion, lines with an equal key are joined, the edit distance of each
match is verified on the texts, and of matching lines the earliest stays.

Emitting every variant of every line would write as many keys as the corpus has characters. A cheap pigeonhole comes
first: one edit leaves the first or the last half of a line as it is, so a line whose halves no other line of about its
length shares has no partner and emits nothing; nor does one that differs from all others in more than one of eight
blocks. Neither step loses a match.

Only hashes, ids and line numbers are shuffled for all lines, texts only to look up and to cut lines. Equal lines are
one row from their first aggregation on, and of a key that many lines share only the earliest line is joined to the
others, so no group's pairs are ever listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kind, map_batches, table, texts, two_hashes, written

#: Characters in the normal form from which lines within one edit match; shorter lines match only if equal.
NEAR_CHARS = 20
#: Lines that are looked up by a broadcast; beyond it by a shuffle. About 100 bytes each.
BROADCAST_LINES = 200_000
#: White space within a line.
SPACES = r"[ \t\r\f\x0B\xA0]"


def normal_form(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACES + "+", " ")))


def _positions(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, norm of each line whose normal form is not empty."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "text_hash", "line_no", normal_form(F.col("line")).alias("norm")).where("norm <> ''")


def _half_keys() -> Column:
    """Keys of the first and last characters, half a line or a little less, that one edit leaves as they are.

    How many characters depends on the class of a line's length, four lengths wide. A line whose length starts a class has
    the keys of the class below too, so that lines whose lengths differ by one always have a class in common.
    """
    n, s = F.length("norm"), F.col("norm")

    def keys(c: Column) -> list[Column]:
        return [F.xxhash64(F.lit("first"), c, F.left(s, 2 * c)), F.xxhash64(F.lit("last"), c, F.right(s, 2 * c))]

    c = F.floor(n / 4).cast("int")
    return F.when(n % 4 == 0, F.array(*keys(c), *keys(c - 1))).otherwise(F.array(*keys(c)))


_STEP = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_STEP, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def variant_hashes(line: str) -> np.ndarray:
    """Hashes of a line, and of the line without each of its characters, in time proportional to its length.

    A text's hash is the sum of its characters' numbers times powers of a step; without one character, those after it
    move down by one power.
    """
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(0, len(codes) - 1), _STEP, np.uint64))))[: len(codes)]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(codes + np.uint64(1)) * powers)))
    cut = sums[:-1] + (sums[-1] - sums[1:]) * _BACK
    lengths = np.full(len(codes) + 1, max(0, len(codes) - 1), np.uint64)
    lengths[0] = len(codes)
    return _mix(np.concatenate((sums[-1:], cut)) ^ (lengths * np.uint64(_STEP)))


def _variants(batch: pa.RecordBatch):
    """For each line (first, norm) the hashes of itself, at place -1, and without each of its characters, by place."""
    row, places, keys, held = [], [], [], 0

    def out():
        at, place, key = np.concatenate(row), np.concatenate(places), np.concatenate(keys).view(np.int64)
        for i in range(0, len(at), 50_000):
            part = slice(i, i + 50_000)
            first = batch.column("first").take(pa.array(at[part]))
            yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(place[part]), first], ["v", "place", "first"])

    for k, norm in enumerate(texts(batch, "norm")):
        keys.append(variant_hashes(norm))
        n = len(keys[-1])
        row.append(np.full(n, k, np.int32))
        places.append(np.arange(-1, n - 1, dtype=np.int32))
        held += n
        if held >= 50_000:
            yield from out()
            row, places, keys, held = [], [], [], 0
    if held:
        yield from out()


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h1, h2, first, norm of the wanted lines, from the text in which each stands first.

    If few lines are wanted, at most BROADCAST_LINES, they are broadcast and no text is shuffled; else both sides are
    shuffled by document.
    """
    by_text = written(wanted.groupBy("w_id", "w_hash").agg(F.collect_list(F.struct("w_no", "h1", "h2", "first")).alias("wants")), "wanted-lines")
    if (by_text.agg(F.sum(F.size("wants"))).first()[0] or 0) <= BROADCAST_LINES:
        by_text = F.broadcast(by_text)
    source = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = source.join(by_text, source.doc_id.eqNullSafe(by_text.w_id) & (source.text_hash == by_text.w_hash))
    parts = found.select(F.split("text", "\n").alias("parts"), F.explode("wants").alias("want"))
    return parts.select("want.h1", "want.h2", "want.first", normal_form(F.get("parts", F.col("want.w_no"))).alias("norm")).dropDuplicates(["h1", "h2"])


def _shared(keyed: DataFrame) -> DataFrame:
    """h1 of the rows (h1, key) whose key another h1 has too. The keys are cut from their aggregation, so that Spark can
    split a key that very many lines share."""
    shared = written(keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a < b").select("key"), "shared-keys")
    return keyed.join(shared, "key", "left_semi").select("h1").distinct()


def _close(near: DataFrame, blocks: int = 8) -> DataFrame:
    """The lines (h1, norm, ...) that agree with another one outside of one of ``blocks`` blocks, at lengths that fit.

    The same pigeonhole, finer, for the few lines whose texts are at hand: an edit lies in one block of the shorter line,
    and leaves what comes before and after it.
    """

    def keys(length: Column) -> list[Column]:
        q = F.floor(length / blocks).cast("int")
        ends = [F.lit(0) if b == blocks - 1 else length - (b + 1) * q for b in range(blocks)]
        return [F.xxhash64(F.lit(b), length, F.left("norm", b * q), F.right("norm", ends[b])) for b in range(blocks)]

    n = F.length("norm")
    keyed = near.select("h1", F.explode(F.array(*keys(n), *keys(n - 1))).alias("key"))
    return near.join(_shared(keyed), "h1", "left_semi")


def _earlier_neighbours(near: DataFrame) -> DataFrame:
    """h1, h2, best: for lines (h1, h2, first, norm) within one edit of an earlier one the earliest of these.

    A variant's lines lie together; as lines are distinct there are at most as many as characters can be put back in. All
    that lack the same place are a substitution apart, and the line that is the variant is an insertion away from each
    that has it by a deletion; so minima over a variant find each line's earliest neighbour without listing pairs.
    """
    emitted = map_batches(near.select("first", "norm"), _variants, f"v long, place int, first {kind(near, 'first')}")
    every, same_place = Window.partitionBy("v"), Window.partitionBy("v", "place")
    whole, cut = F.min(F.when(F.col("place") < 0, F.col("first"))), F.min(F.when(F.col("place") >= 0, F.col("first")))
    seen = emitted.select("first", "place", F.min("first").over(same_place).alias("swap"), whole.over(every).alias("whole"), cut.over(every).alias("cut"))
    best = F.when(F.col("place") < 0, F.col("cut")).otherwise(F.least("swap", "whole"))
    pairs = seen.select("first", best.alias("best")).where("best < first").distinct()
    one, other = near.select("h1", "h2", "first", "norm"), near.select(F.col("first").alias("best"), F.col("norm").alias("other"))
    checked = pairs.join(one, "first").join(other, "best").where(F.levenshtein("norm", "other", 1) >= 0)
    return checked.groupBy("h1", "h2").agg(F.min("best").alias("best"))


def duplicate_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """doc_id, text_hash, line_no and kept_id, kept_line of each line that repeats an earlier one.

    Lines are the parts of a text between line feeds. Earlier means a lower (doc_id, line_no), null ids last. A line
    repeats an earlier one if their normal forms are equal or, from ``near_chars`` characters on, within one edit;
    kept_id and kept_line say where the earliest such line is (which may itself repeat an earlier one). Lines of white
    space repeat nothing, nor do null and empty texts. Rows that repeat an id and a text are one document.
    """
    h1, h2 = two_hashes(F.col("norm"))
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")
    lines = written(_positions(docs).select("doc_id", "text_hash", "line_no", h1.alias("h1"), h2.alias("h2"), F.when(F.length("norm") >= near_chars, _half_keys()).alias("halves")), "lines")
    forms = written(lines.groupBy("h1", "h2").agg(F.min(F.struct(at.alias("at"), "text_hash")).alias("stands"), F.count("*").alias("n"), F.first("halves").alias("halves")), "line-forms")
    # from here on a line is one row, however often it stands
    paired = _shared(forms.select("h1", F.explode("halves").alias("key")))
    forms = forms.select("h1", "h2", "n", F.col("stands.at").alias("first"), F.col("stands.text_hash").alias("w_hash"))
    wanted = forms.join(paired, "h1").select("h1", "h2", "first", F.col("first.doc_id").alias("w_id"), "w_hash", F.col("first.line_no").alias("w_no"))
    near = written(_close(written(_fetch(docs, wanted), "near-lines")), "close-lines")
    earlier = _earlier_neighbours(near)
    judged = forms.join(earlier, ["h1", "h2"], "left").where("n > 1 OR best IS NOT NULL").select("h1", "h2", F.least("first", F.coalesce("best", "first")).alias("kept"))
    judged = written(judged, "judged-lines")  # cut here, so that Spark can split a hot line in the join of two plain shuffles
    rows = lines.select("doc_id", "text_hash", "line_no", "h1", "h2", at.alias("at"))
    return rows.join(judged, ["h1", "h2"]).where("kept < at").select("doc_id", "text_hash", "line_no", F.col("kept.doc_id").alias("kept_id"), F.col("kept.line_no").alias("kept_line"))


def _judged(docs: DataFrame, near_chars: int) -> DataFrame:
    """_row (all columns of docs), _drop (the numbers of its lines that go) and, if any go, _parts (its lines). The lines
    that go grow with the corpus, so texts are shuffled once, at every size."""
    gone = duplicate_lines(docs, near_chars).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias("drop"))
    gone = written(gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "drop"), "dropped-lines")
    packed = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text_hash"))
    joined = packed.join(gone.hint("merge"), F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    found = joined.select("_row", F.coalesce("drop", F.expr("array()").cast("array<int>")).alias("_drop"))
    # a generator hands its parts on as they are; a projection would be merged into the expression that looks them up
    return found.select("_row", "_drop", F.explode(F.array(F.when(F.size("_drop") > 0, F.split("_row.text", "\n")))).alias("_parts"))


def _kept_text() -> Column:
    kept = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_drop"))
    return F.when(F.size("_drop") == 0, F.col("_row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_parts", i)), "\n"))


def dedup_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """doc_id, text without the lines that repeat an earlier one, n_lines, n_dropped and dropped (line numbers from 0).

    A row for each row of ``docs``. A null text stays null, with no lines; see duplicate_lines for what repeats. The
    order of the lines that stay is kept; columns other than doc_id and text are ignored; an empty table gives an
    empty result.
    """
    judged = _judged(docs.select("doc_id", "text"), near_chars)
    n_lines = F.coalesce(F.size(F.split("_row.text", "\n")), F.lit(0))
    return judged.select("_row.doc_id", _kept_text().alias("text"), F.when(F.col("_row.text").isNull(), 0).otherwise(n_lines).alias("n_lines"), F.size("_drop").alias("n_dropped"), F.col("_drop").alias("dropped"))


def without_repeated_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """``docs``, all columns, with the repeated lines cut from text (and n_chars, if there, counted anew).

    A document that loses every line that is not white space repeats earlier ones throughout and goes. Null, empty and
    white texts lose nothing and stay. Equal lines of one document: the first stays. Rows that repeat an id and a text
    are one document and stay or go alike; a null id comes last. An empty table gives an empty result; columns of any
    name are passed on.
    """
    judged = _judged(docs, near_chars).withColumn("_text", _kept_text()).where((F.size("_drop") == 0) | F.col("_text").rlike(r"[^\n" + SPACES[1:]))
    changed = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return judged.select(*(changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", "dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE_SQL = r"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS xs FROM documents),
lines AS (SELECT doc_id, i - 1 AS line_no, lower(trim(regexp_replace(xs[i], '[ \t\r\f\x0B\xA0]+', ' ', 'g'))) AS norm FROM (SELECT doc_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM parts)),
forms AS (SELECT norm, length(norm) AS n, min((doc_id, line_no)) AS first FROM lines WHERE norm <> '' GROUP BY norm),
near AS (
  SELECT a.norm, b.first FROM forms a JOIN forms b ON a.n = b.n AND a.n >= 20 AND b.first < a.first AND levenshtein(a.norm, b.norm) = 1
  UNION ALL SELECT a.norm, b.first FROM forms a JOIN forms b ON a.n = b.n + 1 AND b.n >= 20 AND b.first < a.first AND levenshtein(a.norm, b.norm) = 1
  UNION ALL SELECT a.norm, b.first FROM forms a JOIN forms b ON a.n + 1 = b.n AND a.n >= 20 AND b.first < a.first AND levenshtein(a.norm, b.norm) = 1
),
judged AS (SELECT forms.norm, least(any_value(forms.first), coalesce(min(near.first), any_value(forms.first))) AS kept FROM forms LEFT JOIN near ON forms.norm = near.norm GROUP BY forms.norm),
gone AS (SELECT doc_id, list(line_no::INT ORDER BY line_no) AS dropped FROM lines JOIN judged ON lines.norm = judged.norm WHERE judged.kept < (doc_id, line_no) GROUP BY doc_id)
SELECT p.doc_id, len(xs)::INT AS n_lines, coalesce(len(dropped), 0)::INT AS n_dropped, coalesce(dropped, []::INT[]) AS dropped,
       sha256(array_to_string([xs[i] FOR i IN range(1, len(xs) + 1) IF NOT list_contains(coalesce(dropped, []::INT[]), (i - 1)::INT)], chr(10))) AS text_sha256
FROM parts p LEFT JOIN gone ON p.doc_id = gone.doc_id
"""
