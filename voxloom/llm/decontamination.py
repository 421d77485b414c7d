"""Benchmark decontamination with an Aho-Corasick automaton over word numbers.

The words of the benchmark are numbered. Every item is cut into blocks of five words from its start, and the blocks of
all items make one automaton, which has about one node for each word of the benchmark. Ten consecutive words of an item
hold at least one whole block within their last nine words, so a text is scanned once for blocks, and each block found
names the few windows that can lie there; a window counts if its ten words are found in the table of windows. Items of
fewer than ten words are patterns of their own. Hit words lead back to spans of the original text.

A benchmark that exceeds one automaton is dealt over several, which are loaded one after the other. What they hit is
united as ranges of words before anything is derived from it, so the result does not depend on their number.
"""

from __future__ import annotations

import uuid
from math import isqrt

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_few, kind, map_batches, only_model, table, texts, two_hashes, written

WINDOW = 10
#: Words of benchmark in one automaton, which takes a worker about 0.2 kB each; see the README for figures.
AUTOMATON_WORDS = 1_000_000
#: Words of one piece of an item; longer items are cut into pieces that overlap by a window less one word.
PIECE_WORDS = 50_000
#: Documents known to be contaminated, as two longs each, that are looked up by broadcast.
BROADCAST_ROWS = 2_000_000
#: Lower-cases A-Z and turns all other ASCII characters but digits and letters into spaces.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

HITS = "ranges array<struct<a:long,b:long,start:long,end:long>>, items array<string>"
_RANGE = pa.struct([(n, pa.int64()) for n in ("a", "b", "start", "end")])


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """Spread numbers over 64 bits."""
    x = (x.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


class Windows:
    """The automaton over blocks of the items' words, and the table of windows of ``n`` words with their items."""

    def __init__(self, items: list[tuple[str, str]], n: int = WINDOW):
        self.n, self.block = n, n // 2
        self.numbers: dict[bytes, int] = {}
        number = self.numbers
        numbered = [(item, [number.setdefault(w, len(number) + 1) for w in words_of(text)]) for item, text in items]
        owners: dict[tuple[int, ...], list[str]] = {}
        for item, words in numbered:
            if 0 < len(words) < n:
                owners.setdefault(tuple(words), []).append(item)
        blocks = {tuple(words[i : i + self.block]) for _, words in numbered if len(words) >= n for i in range(0, len(words) - self.block + 1, self.block)}
        #: Length, items (of a short one) and whether it is a block, for each pattern.
        self.patterns: list[tuple[int, list[str], bool]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        # the automaton searches a node's branches one by one, so a word is two symbols of about as many values each
        self.base = isqrt(len(number)) + 1
        for words in blocks | owners.keys():
            self.automaton.add_word(self.symbols(np.array(words, np.int32)), len(self.patterns))
            self.patterns.append((len(words), owners.get(words, []), words in blocks))
        del blocks
        if self.patterns:
            self.automaton.make_automaton()
        self._fill([(item, np.array(words, np.int32)) for item, words in numbered if len(words) >= n])

    def symbols(self, words: np.ndarray) -> tuple[int, ...]:
        """Two symbols for each word, of two alphabets, so that no match starts within a word."""
        return tuple(np.stack((words % self.base, self.base + words // self.base), axis=1).ravel().tolist())

    def _fill(self, numbered: list[tuple[str, np.ndarray]]) -> None:
        n = self.n
        self.names = sorted({item for item, _ in numbered})
        at = {item: k for k, item in enumerate(self.names)}
        self.words = np.concatenate([w for _, w in numbered]) if numbered else np.empty(0, np.int32)
        sizes = [len(w) for _, w in numbered]
        starts = np.concatenate([np.arange(s - n + 1) + e for s, e in zip(sizes, np.cumsum([0, *sizes[:-1]]), strict=True)]) if numbered else np.empty(0, np.int64)
        owners = np.concatenate([np.full(s - n + 1, at[i], np.int32) for (i, _), s in zip(numbered, sizes, strict=True)]) if numbered else np.empty(0, np.int32)
        for seed in range(64):  # until no two different windows have one hash
            self.seed = seed
            hashes = self.hashes(self.words, starts)
            order = np.lexsort((owners, hashes))
            ordered = hashes[order]
            first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(order) else np.empty(0, np.int64)
            self.keys, self.place = ordered[first], starts[order[first]]
            same = np.repeat(self.place, np.diff(np.append(first, len(order))))
            if all((self.words[same + k] == self.words[starts[order] + k]).all() for k in range(n)):
                break
        else:
            raise RuntimeError("no seed tells all windows apart")
        self.owners, self.ends = owners[order], np.append(first, len(order))

    def hashes(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        total = np.zeros(len(starts), np.uint64)
        for k in range(self.n):
            total = (total + _mix(words[starts + k], self.seed)) * np.uint64(0xD6E8FEB86659FD93)
        return total

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, ranges of hit words (from, to), in order and apart, and the items found."""
        words = words_of(text)
        if len(words) == 0 or not self.patterns:
            return len(words), [], set()
        known = self.numbers.get
        row = np.array([known(w, 0) for w in words], np.int32)
        items: set[str] = set()
        ranges, blocks = [], []
        for last, k in self.automaton.iter(self.symbols(row)):
            end = last // 2
            length, owners, block = self.patterns[k]
            if owners:
                items.update(owners)
                ranges.append((end + 1 - length, end + 1))
            if block:
                blocks.append(end + 1 - length)
        if blocks:
            starts = np.unique((np.array(blocks)[:, None] - np.arange(self.block)).ravel())
            starts = starts[(starts >= 0) & (starts + self.n <= len(row))]
            found = np.searchsorted(self.keys, hashes := self.hashes(row, starts))
            found[found == len(self.keys)] = 0
            sure = self.keys[found] == hashes if len(self.keys) else np.zeros(len(starts), bool)
            for k in range(self.n):
                sure[sure] = self.words[self.place[found[sure]] + k] == row[starts[sure] + k]
            ranges += [(s, s + self.n) for s in starts[sure].tolist()]
            for k in np.unique(found[sure]).tolist():
                items.update(self.names[i] for i in np.unique(self.owners[self.ends[k] : self.ends[k + 1]]).tolist())
        return len(words), merge(ranges), items


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that overlap or touch made one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def word_spans(text: str) -> np.ndarray:
    """Start and end of each word in the original text, in characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.concatenate(([False], (codes >= 128) | np.isin(codes, np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)), [False]))
    return np.stack((np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])), axis=1)


class Part:
    """Some pieces of items, sent to the workers; a worker builds their automaton once and holds one part at a time."""

    def __init__(self, told: Broadcast):
        self.told, self.token = told, uuid.uuid4().hex


def _windows(part: Part) -> Windows:
    return only_model(f"windows {part.token}", lambda: Windows(part.told.value))


def pieces(benchmark: DataFrame, piece_words: int = PIECE_WORDS, n: int = WINDOW) -> DataFrame:
    """item, words and text of each piece of an item: all of it, or stretches that share n - 1 words, so that every
    window lies in one. Null texts and texts without words have none; a null item_id counts as the empty text."""

    def cut(batch: pa.RecordBatch):
        out = []
        for item, text in zip(batch.column("item").to_pylist(), texts(batch), strict=True):
            words = words_of(text)
            for i in range(0, max(1, len(words) - n + 1) if words else 0, piece_words):
                part = words[i : i + piece_words + n - 1]
                out.append((item, len(part), b" ".join(part).decode("utf-8", "surrogatepass")))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], ["item", "words", "text"])

    told = benchmark.where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return map_batches(told, cut, "item string, words long, text string")


def load_parts(benchmark: DataFrame, most_words: int):
    """The benchmark in parts of at most ``most_words`` words (or one piece), by hash, one at a time.

    The driver and the workers hold one part only: a part is withdrawn when the next is asked for.
    """
    told = written(pieces(benchmark, min(PIECE_WORDS, max(WINDOW, most_words // 4))), "benchmark-pieces")
    total, longest = told.agg(F.sum("words"), F.max("words")).first()
    parts = -(-(total or 0) // most_words) or 1
    while True:
        part = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
        most = told.groupBy(part.alias("part")).agg(F.sum("words").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= max(most_words, longest or 0) or parts >= (total or 0):
            break
        parts = parts + max(1, parts // 4)
    for p in range(parts):
        rows = sorted((r["item"], r["text"]) for r in told.where(part == p).collect())
        sent = told.sparkSession.sparkContext.broadcast(rows)
        yield p, parts, Part(sent)
        if parts > 1:
            sent.unpersist()


def _hits(windows: Windows, text: str) -> tuple[int, list[dict], list[str]]:
    n, ranges, found = windows.scan(text)
    at = word_spans(text) if ranges else None
    return n, [{"a": a, "b": b, "start": int(at[a, 0]), "end": int(at[b - 1, 1])} for a, b in ranges], sorted(found)


def _united(batch: pa.RecordBatch):
    """Ranges of all parts of a benchmark made one list, and their items."""
    out = []
    for ranges, items in zip(batch.column("ranges").to_pylist(), batch.column("items").to_pylist(), strict=True):
        start, end = {r["a"]: r["start"] for r in ranges}, {r["b"]: r["end"] for r in ranges}
        out.append(([{"a": a, "b": b, "start": start[a], "end": end[b]} for a, b in merge([(r["a"], r["b"]) for r in ranges])], sorted(set(items))))
    columns = list(zip(*out, strict=True)) or [[], []]
    yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(columns[0], pa.list_(_RANGE)), pa.array(columns[1], pa.list_(pa.string()))], ["row", "ranges", "items"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, most_words: int = AUTOMATON_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items and spans of each row.

    items are the ids of the items found, sorted as texts; spans are the (start, end) characters of the original text
    from the first to the last word of each run of hit words. A null or empty text has no words. Without windows
    nothing is contaminated. Repeated rows and items count as they stand; an empty table gives an empty result; further
    columns are ignored. A benchmark of more than ``most_words`` words is scanned for in several passes, with the same
    result.
    """
    base, rows = f"doc_id {kind(docs, 'doc_id')}", docs.select("doc_id", "text")

    def scanner(part: Part, keys: list[str], hits_only: bool):
        def work(batch: pa.RecordBatch):
            out = [_hits(_windows(part), t) for t in texts(batch)]
            columns = [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 3, (pa.int64(), pa.list_(_RANGE), pa.list_(pa.string())), strict=True)]
            found = pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *columns], [*keys, "n_words", "ranges", "items"])
            yield found.filter(pa.array([bool(x[1]) for x in out], pa.bool_())) if hits_only else found

        return work

    scanned = None
    for p, parts, part in load_parts(benchmark, most_words):
        if parts == 1:
            scanned = map_batches(rows, scanner(part, ["doc_id"], False), f"{base}, n_words long, {HITS}")
            break
        if p == 0:
            rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "numbered-texts")
        keys = ["row", "doc_id"] if p == 0 else ["row"]
        found = written(map_batches(rows.select(*keys, "text"), scanner(part, keys, p > 0), f"row long, {f'{base}, ' * (p == 0)}n_words long, {HITS}"), "benchmark-hits")
        first, every = (found, found.select("row", "ranges", "items")) if p == 0 else (first, every.unionByName(found.select("row", "ranges", "items")))
        if p == parts - 1:
            each = every.where(F.size("ranges") > 0).groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("items")).alias("items"))
            united = map_batches(each, _united, f"row long, {HITS}").withColumnRenamed("row", "_row")
            # a row without united ranges has none in the first part either
            plain = first.select("row", "doc_id", "n_words", F.struct("ranges", "items").alias("first"))
            scanned = plain.join(united, plain.row == united._row, "left").select("doc_id", "n_words", *(F.coalesce(c, f"first.{c}").alias(c) for c in ("ranges", "items")))
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])
    spans = F.transform("ranges", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    return scanned.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("ranges") > 0).alias("contaminated"), "items", spans.alias("spans"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, most_words: int = AUTOMATON_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no window of the benchmark occurs.

    Null and empty texts hold no window and stay, as does every row if the benchmark is empty or has no words. Repeated
    rows stay or go alike; null and repeated ids do not matter; an empty table gives an empty result; columns of any
    name are passed on.
    """
    bad = None
    for _, parts, part in load_parts(benchmark, most_words):
        told = docs.select("text") if parts > 1 else docs

        def clean(batch: pa.RecordBatch, part=part, keep=parts == 1):
            yield batch.filter(pa.array([(not _windows(part).scan(t)[1]) == keep for t in texts(batch)], pa.bool_()))

        found = map_batches(told, clean, told.schema)
        if parts == 1:
            return found
        hashes = written(found.select(*(h.alias(n) for n, h in zip(("_b1", "_b2"), two_hashes(F.col("text")), strict=True))).distinct(), "contaminated-texts")
        bad = hashes if bad is None else bad.union(hashes)
    bad = broadcast_if_few(written(bad.distinct(), "contaminated-texts"), BROADCAST_ROWS)
    h1, h2 = two_hashes(F.col("text"))
    return docs.join(bad, (h1 == bad["_b1"]) & (h2 == bad["_b2"]), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS words FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows))),
found AS (SELECT doc_id, i, grams.n, item_id FROM grams JOIN windows ON grams.n = windows.n AND grams.words = windows.words),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id::VARCHAR) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
