"""Quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths, in numpy, find the n-grams that occur twice or more; the rules bound
the share of characters that lie inside repeats, and the shares of repeated lines and of their characters.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import kind, map_batches, table, texts

#: Largest share of word characters inside later occurrences of an n-gram, by n; published thresholds for web text.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest shares of lines, and of line characters, that equal an earlier line. Too many repeated lines are a fault only
#: with half of the characters that would be one by themselves: of the 10,000 documents of sf0.1 14 that pass all else have
#: a third of their lines, but under a tenth of their characters, in one or two short repeats; all 6 with a label are good.
LINE_LIMIT, LINE_CHARS_LIMIT = 0.30, 0.20
#: Largest share of code points of symbols in words.
SYMBOL_LIMIT = 0.10
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_STEP = np.uint64(0x9E3779B97F4A7C15)

COLUMNS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(),
    "failed_rules": pa.list_(pa.string()), "repeat_share": pa.float64(), "dup_line_share": pa.float64(), "dup_line_char_share": pa.float64(),
}


def _mix(ids: np.ndarray) -> np.ndarray:
    """Spread word numbers over 64 bits."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a window of n words from any of the starts."""
    ends = np.zeros(size + 1, np.int64)
    np.add.at(ends, starts, 1)
    np.subtract.at(ends, starts + n, 1)
    return ends[:-1].cumsum() > 0


def repeats(ids: np.ndarray, lengths: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By n: the starts of n-grams that occur twice or more, and of those that equal an earlier one."""
    words = _mix(ids)
    out, rolled = {}, words
    for n in range(1, max(lengths) + 1):
        if n > 1:
            if len(words) < n:
                out.update({k: (np.empty(0, np.int64),) * 2 for k in lengths if k >= n})
                break
            rolled = rolled[:-1] * _STEP + words[n - 1 :]
        if n in lengths:
            order = np.argsort(rolled, kind="stable")
            same = np.flatnonzero(rolled[order[1:]] == rolled[order[:-1]])
            out[n] = (np.unique(np.concatenate((order[same], order[same + 1]))), order[same + 1])
    return out


def measure(text: str) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at the same six white space characters as the contract's words
    seen = np.frombuffer(raw, np.uint8)
    chars = np.array([len(w) for w in words], np.int64)
    if not raw.isascii():
        chars = np.array([len(w.decode("utf-8", "surrogatepass")) for w in words], np.int64)
    n, n_chars, n_symbols = len(words), int(chars.sum()), int(_SYMBOLS[seen].sum())
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    found = Counter(lines)
    dup_lines = len(lines) - len(found)
    dup_chars = sum((c - 1) * len(x) for x, c in found.items() if c > 1)
    line_chars = sum(map(len, lines))
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    again = repeats(ids, list(NGRAM_LIMITS)) if n else {k: (np.empty(0, np.int64),) * 2 for k in NGRAM_LIMITS}
    in_repeats = int(_covered(again[5][0], 5, n).sum())
    shares = {k: float(chars[_covered(later, k, n)].sum()) / max(n_chars, 1) for k, (_, later) in again.items()}
    base_failed = n < 10 or 100 * in_repeats > 20 * n
    failed = [f"repeated_{k}grams" for k, most in NGRAM_LIMITS.items() if shares[k] > most]
    if dup_lines > LINE_LIMIT * len(lines) and dup_chars > LINE_CHARS_LIMIT / 2 * line_chars:
        failed.append("repeated_lines")
    if dup_chars > LINE_CHARS_LIMIT * line_chars:
        failed.append("repeated_line_characters")
    if n_symbols > SYMBOL_LIMIT * n_chars:
        failed.append("symbols")
    return n, n_chars, n_symbols, dup_lines, in_repeats, base_failed, not base_failed and not failed, failed, shares[5], dup_lines / max(len(lines), 1), dup_chars / max(line_chars, 1)


def judge_repetition(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and verdict, ``kept``, the rules that failed and the shares measured, for each row.

    A null or empty text has no words: it fails the base rule and is not kept. Repeated rows are judged alike, an empty
    table gives an empty result, and columns other than doc_id and text are ignored.
    """

    def work(batch: pa.RecordBatch):
        rows = list(zip(*map(measure, texts(batch)), strict=True)) or [[]] * len(COLUMNS)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(r, t) for r, t in zip(rows, COLUMNS.values(), strict=True))], ["doc_id", *COLUMNS])

    types = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, failed_rules array<string>, repeat_share double, dup_line_share double, dup_line_char_share double"
    return map_batches(docs.select("doc_id", "text"), work, f"doc_id {kind(docs, 'doc_id')}, {types}")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_repetition(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, i, len(w) AS n, length(w[i]) AS chars FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT unnest([5, 6, 7, 8, 9, 10]) AS k))),
again AS (SELECT doc_id, k, i, count(*) OVER (PARTITION BY doc_id, k, gram) > 1 AS repeated, row_number() OVER (PARTITION BY doc_id, k, gram ORDER BY i) > 1 AS later FROM grams),
covered AS (SELECT DISTINCT doc_id, k, unnest(range(i, i + k)) AS i FROM again WHERE later),
repeat_words AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM again WHERE k = 5 AND repeated) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(chars) AS chars FROM words GROUP BY doc_id),
shares AS (SELECT doc_id, max(chars / total > limits) AS failed FROM (
  SELECT c.doc_id, c.k, sum(words.chars)::DOUBLE AS chars, any_value(sums.chars)::DOUBLE AS total, [0.15, 0.14, 0.13, 0.12, 0.11, 0.10][c.k - 4]::DOUBLE AS limits
  FROM covered c JOIN words ON c.doc_id = words.doc_id AND c.i = words.i JOIN sums ON c.doc_id = sums.doc_id GROUP BY c.doc_id, c.k) GROUP BY doc_id),
lines AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
dups AS (SELECT doc_id, sum(n) AS lines, sum(n - 1) AS dup, sum((n - 1) * strlen(line)) AS dup_chars, sum(n * strlen(line)) AS chars FROM lines GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(sums.chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(shares.failed, false) AS grams_failed,
         coalesce(dup_chars > 0.20::DOUBLE * dups.chars OR (dup > 0.30::DOUBLE * lines AND dup_chars > 0.10::DOUBLE * dups.chars), false) AS lines_failed
  FROM d LEFT JOIN sums ON d.doc_id = sums.doc_id LEFT JOIN repeat_words r ON d.doc_id = r.doc_id LEFT JOIN shares ON d.doc_id = shares.doc_id LEFT JOIN dups ON d.doc_id = dups.doc_id
), failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR grams_failed OR lines_failed OR n_symbols > 0.10::DOUBLE * word_chars) AS kept FROM failed
"""
