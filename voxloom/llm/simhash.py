"""SimHash near-duplicates with pigeonhole blocks.

A 64-bit fingerprint is split into 5 blocks. Fingerprints that differ in at most 3 bits agree in at least 2 blocks, so
each fingerprint gets one key for each of the 10 pairs of blocks, and only fingerprints with a common key are compared.
Equal fingerprints are one node from the start. A key that very many fingerprints share is split by the same pigeonhole
over its other bits: of four further blocks one agrees, so each fingerprint gets four finer keys in its place, and so on
twice; only what agrees in all of these bits is dealt out as a grid of cells of bounded size. Within a cell a forest of
links is kept instead of all pairs, which links the same components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import broadcast_if_few, durable, kind, map_batches, table, texts, written
from .components import connected_components

MOST_BITS, BLOCKS = 3, 5
#: Fingerprints of a key from which it is split by further bits, at most LEVELS times, and of one side of a cell then.
CELL, LEVELS = 1024, 2
#: Crowded keys, or documents that go, that are looked up by broadcast; some 20 bytes each.
BROADCAST_ROWS = 1_000_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of a text's word shingles, repeats included; 0 if it has no word."""
    found = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return digest(b" ".join(found), seed)
    grams = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False))
    hashes = np.fromiter((digest(g, seed) for g in grams), np.uint64, len(found) - words + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_hash (of the whole text, null as empty) and fp (the fingerprint as a signed long) of each row."""

    def work(batch: pa.RecordBatch):
        fps = np.array([fingerprint(t, words) for t in texts(batch)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    hashed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return map_batches(hashed, work, f"doc_id {kind(docs, 'doc_id')}, text_hash long, fp long")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def masks(blocks: int = BLOCKS, agree: int = BLOCKS - MOST_BITS) -> list[int]:
    """Bits of each choice of ``agree`` blocks out of ``blocks``, as signed longs."""
    ends = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:], strict=False)]
    return [_signed(sum(c)) for c in combinations(parts, agree)]


def finer_masks(mask: int) -> list[int]:
    """``mask`` with one more block of the other bits, cut into MOST_BITS + 1 blocks: fingerprints that agree in ``mask``
    and differ in at most MOST_BITS bits agree in one of these too."""
    rest = [b for b in range(64) if not mask >> b & 1]
    ends = [len(rest) * k // (MOST_BITS + 1) for k in range(MOST_BITS + 2)]
    return [_signed(mask & (1 << 64) - 1 | sum(1 << b for b in rest[i:j])) for i, j in zip(ends, ends[1:], strict=False)]


def forest(cell: np.ndarray, fp: np.ndarray, most_bits: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of equal ``cell`` (given in order) that differ in at most ``most_bits``: enough of them to
    connect what all such pairs connect. Compares rows at distance 1, 2, ... and leaves out what is linked by then."""
    label, left, right = np.arange(len(fp)), [], []
    at = np.arange(len(fp) - 1)
    step = 1
    while len(at := at[at + step < len(fp)]) and len(at := at[cell[at] == cell[at + step]]):
        i = at[(np.bitwise_count(fp[at] ^ fp[at + step]) <= most_bits) & (label[at] != label[at + step])]
        if len(i):
            left.append(i), right.append(i + step)
            a, b = label[i], label[i + step]
            while (a != b).any():
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label[label] != label).any():
                    label = label[label]
                a, b = label[a], label[b]
            label = label[label]
        step += 1
    return (fp[np.concatenate(left)], fp[np.concatenate(right)]) if left else (fp[:0], fp[:0])


def _link_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the cells of a partition whose rows come ordered by cell; only the last cell is carried over."""
    rest = np.empty((0, 2), np.int64)

    def linked(rows: np.ndarray) -> pa.RecordBatch:
        a, b = forest(rows[:, 0], rows[:, 1].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        rows = np.concatenate((rest, np.stack([c.to_numpy() for c in batch.columns], axis=1)))
        if not len(rows):
            continue
        whole = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # cells are signed longs in ascending order
        yield linked(np.ascontiguousarray(rows[:whole]))
        rest = rows[whole:]
    if len(rest):
        yield linked(np.ascontiguousarray(rest))


def _keyed(rows: DataFrame, keys: Column) -> DataFrame:
    """fp, mask and key (a hash of the mask and of the fingerprint's bits in it) for each of an array of masks."""
    return rows.select("fp", F.explode(keys).alias("mask")).select("fp", "mask", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))


def shared_cells(fps: DataFrame, cell_size: int = CELL, levels: int = LEVELS) -> DataFrame:
    """(cell, fp): cells such that any two of the distinct longs ``fp`` at most MOST_BITS apart have one in common.

    Rows of a key that more than ``cell_size`` fingerprints share get finer keys instead, up to ``levels`` times; what is
    still too many is dealt out as pairs of parts.
    """
    level, cells = masks(), []
    keyed = _keyed(fps, F.array(*map(F.lit, level)))
    for k in range(levels + 1):
        keyed = written(keyed, "fingerprint-keys")
        crowded = written(keyed.groupBy("key").count().where(F.col("count") > cell_size), "crowded-keys")
        if crowded.isEmpty():
            cells.append(keyed.select(F.col("key").alias("cell"), "fp"))
            break
        crowded = broadcast_if_few(crowded, BROADCAST_ROWS)
        cells.append(keyed.join(crowded, "key", "left_anti").select(F.col("key").alias("cell"), "fp"))
        hot = keyed.join(crowded, "key")
        if k == levels:
            hot = hot.withColumn("n", F.ceil(F.col("count") / cell_size).cast("int")).withColumn("part", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("n")).cast("int"))
            hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            cells.append(hot.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), "fp"))
            break
        finer = {m: finer_masks(m) for m in level}
        table = F.create_map(*(x for m, ms in finer.items() for x in (F.lit(m), F.array(*map(F.lit, ms)))))
        keyed = _keyed(hot, F.element_at(table, F.col("mask")))
        level = [m for ms in finer.values() for m in ms]
    return reduce(DataFrame.union, cells)


def near_links(fps: DataFrame, cell_size: int = CELL) -> DataFrame:
    """(a, b): links between the distinct longs ``fp`` of ``fps`` at most MOST_BITS apart, a forest within each cell."""
    ship(fps.sparkSession)
    return shared_cells(fps, cell_size).repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_link_cells, "a long, b long")


def simhash_components(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_hash, fp, root and component_id of each row: rows link if their fingerprints differ in at most 3 bits.

    component_id is the least non-null doc_id reachable, root the least fingerprint. A null or empty text, or one
    without words, has fingerprint 0. A null doc_id keeps its row but names no component unless all ids of it are null.
    Repeated rows give repeated results; an empty table gives an empty result; further columns are ignored.
    """
    rows = durable(fingerprints(docs, words))
    distinct = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_links(distinct.select("fp")))
    rooted = durable(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # cut from its aggregation, so that Spark can split a component of very many fingerprints in the join
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least-ids")
    return rows.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_first(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: of each component the document with the least id stays.

    ``found``: doc_id, text_hash and root of each row, by fingerprints if not given. Null ids come last; among equal ids
    the text with the least hash stays. Rows that repeat an id and a text are one document, of which one row stays, the
    columns of which are those of any of them. Null and empty texts and those without words are alike: one of them stays.
    An empty table gives an empty result; columns of any name are passed on.

    Only ids and hashes are grouped. The rows that go are looked up by broadcast if they are few, so that texts are not
    shuffled, else by a join of two plain shuffles.
    """
    found = simhash_components(docs) if found is None else found
    told = durable(found.groupBy("doc_id", "text_hash", "root").agg((F.count("*") > 1).alias("again")))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = durable(told.groupBy("root").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1"))
    gone = told.join(first, "root").where(rank != F.col("first")).select("doc_id", "text_hash").withColumn("gone", F.lit(True))
    again = told.where("again").select("doc_id", "text_hash").withColumn("gone", F.lit(False))
    marked = written(gone.unionByName(again).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.max("gone").alias("_gone")), "repeated-documents")
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"))
    same = lambda some: F.col("_doc").eqNullSafe(some["_id"]) & (F.col("_text") == some["_hash"])
    special = broadcast_if_few(marked, BROADCAST_ROWS)
    kept = packed.join(special, same(special), "left_anti").select("_row.*")
    copies = marked.where("NOT _gone")
    if copies.isEmpty():
        return kept
    few = broadcast_if_few(written(copies, "repeated-rows"), BROADCAST_ROWS)
    once = packed.join(few, same(few), "left_semi").groupBy("_doc", "_text").agg(F.first("_row").alias("_row"))
    return kept.union(once.select("_row.*"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
