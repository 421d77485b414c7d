"""SimHash candidates for a set similarity: long fingerprints, blocks of bits, Hamming distance, exact verification.

At a similarity of 0.8 two fingerprints differ in about 15 % of their bits, too many for the pigeonhole of ``simhash``. So a
fingerprint here has 1,024 bits over the distinct word shingles of a text: KEY_BITS of them make keys and VERIFY_BITS are
left for the Hamming distance.

* A key is a choice of some of the key bits; the more texts, the more bits (CELL texts share one by chance), and so many
  keys that pairs at the similarity have none in common in ``MISSED`` of cases only. Texts with a common key whose other
  bits differ by at most MOST_BITS, and FIRST_BITS in the first word, are near. Unlike texts differ in half of them and are practically never near.
* A key that very many texts share is settled by a representative: what is near to it is one class, and only the rest is
  compared with all others, in cells of bounded size. There is no cap.
* Texts that near pairs connect are compared by their sets of shingles, as in ``minhash``: with a representative first, and
  what is not in the largest class by then with all others. Only counts of common shingles decide about a link.
"""

from __future__ import annotations

from functools import cache
from math import lgamma, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import minhash
from .common import broadcast_if_few, durable, kind, map_batches, texts, written
from .components import connected_components

LANES, VERIFY_LANES = 16, 3
VERIFY_BITS, KEY_BITS = 64 * VERIFY_LANES, 64 * (LANES - VERIFY_LANES)
#: The largest share of bits in which two sets at a similarity of 0.8 differ, for sets of more than SMALL shingles and of
#: fewer (4 of 5 are common); by trial over all sizes up to 60.
DIFFERENT, SMALL_DIFFERENT, SMALL = 0.162, 0.19, 7
#: Bits that may differ in all words that verify, and in the first.
MOST_BITS, FIRST_BITS = 56, 26
MISSED = 1e-4
#: Texts that share a key by chance, and texts of a key from which it is settled by a representative.
CELL, CROWD = 2048, 8192
_SEEDS = np.random.default_rng(6).integers(1, 1 << 62, LANES, np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """LANES words of bits: each is set in over half the distinct shingles; of a tie the first shingle decides."""
    counts, n = np.zeros(64 * LANES, np.int64), len(hashes)
    if not n:
        return np.zeros(LANES, np.uint64)
    for i in range(0, n, 1 << 12):
        mixed = minhash._mixed(hashes[i : i + (1 << 12), None] ^ _SEEDS)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        if not i:
            counts += bits[0] * (n % 2 == 0)  # half a shingle more, in halves
        for j in range(0, len(bits), 255):
            counts += 2 * bits[j : j + 255].sum(axis=0, dtype=np.uint8).astype(np.int64)
    return np.packbits(counts > n, bitorder="little").view(np.uint64)


def missed(different: float, bits: int, keys: int) -> float:
    """The share of pairs that have none of so many keys in common, if each bit differs with that probability."""
    d = np.arange(KEY_BITS + 1)
    weight = np.exp([lgamma(KEY_BITS + 1) - lgamma(x + 1) - lgamma(KEY_BITS - x + 1) + x * log(different) + (KEY_BITS - x) * log(1 - different) for x in d])
    agree = np.prod([np.clip((KEY_BITS - d - i) / (KEY_BITS - i), 0, None) for i in range(bits)], axis=0)
    return float((weight * (1 - agree) ** keys).sum())


@cache
def keys_needed(different: float, bits: int) -> int:
    keys = 1
    while missed(different, bits, keys) > MISSED:
        keys += 1 + keys // 50
    return keys


@cache
def choices(bits: int) -> np.ndarray:
    """The key bits of each key: a row for each of as many keys as small sets need."""
    rng = np.random.default_rng(bits)
    return np.stack([rng.choice(KEY_BITS, bits, replace=False) for _ in range(keys_needed(SMALL_DIFFERENT, bits))])


def key_bits(n: int) -> int:
    """Bits of a key for ``n`` texts."""
    return max(4, int(np.ceil(np.log2(max(n, 1) / CELL))))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, node (hash of the shingle set, 0 if empty), size (of the set) and fp (the fingerprint)."""

    def work(batch: pa.RecordBatch):
        nodes, sizes, fps = [], [], []
        for text in texts(batch):
            found = minhash.shingles(text, words)
            nodes.append(xxhash.xxh64_intdigest(found.tobytes(), 42) if len(found) else 0)
            sizes.append(len(found))
            fps.append(fingerprint(found).tobytes())
        columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "size", "fp"])

    hashed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return map_batches(hashed, work, f"doc_id {kind(docs, 'doc_id')}, text_hash long, node long, size long, fp binary")


def _keys(distinct: DataFrame, bits: int) -> DataFrame:
    """node, the words v0 to v2 of its bits to verify, and keys."""

    def work(batch: pa.RecordBatch):
        fps = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64).reshape(-1, LANES)
        chosen, usual = choices(bits), keys_needed(DIFFERENT, bits)
        size = batch.column("size").to_numpy()
        set_bits = np.unpackbits(np.ascontiguousarray(fps[:, VERIFY_LANES:]).view(np.uint8), axis=1, bitorder="little")
        weights = np.int64(1) << np.arange(bits, dtype=np.int64)
        # the number of a key stands above its bits
        keys = np.stack([set_bits[:, c] @ weights | np.int64(k << bits) for k, c in enumerate(chosen)], axis=1)
        wanted = np.arange(len(chosen)) < np.where(size <= SMALL, len(chosen), usual)[:, None]
        ends = np.append(0, wanted.sum(axis=1).cumsum())
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[wanted]))
        columns = [batch.column("node"), *(pa.array(fps[:, k].copy().view(np.int64)) for k in range(VERIFY_LANES)), lists]
        yield pa.RecordBatch.from_arrays(columns, ["node", *(f"v{k}" for k in range(VERIFY_LANES)), "keys"])

    return map_batches(distinct.select("node", "size", "fp"), work, f"node long, {''.join(f'v{k} long, ' for k in range(VERIFY_LANES))}keys array<long>")


def _near_rows(v: np.ndarray) -> np.ndarray:
    """For each row the least row that near pairs connect it with."""
    label, left, right = np.arange(len(v)), [], []
    first = np.ascontiguousarray(v[:, 0])
    for i in range(0, len(v), 128):
        a, b = np.nonzero(np.bitwise_count(first[i : i + 128, None] ^ first[None, i:]) <= FIRST_BITS)
        a, b = a[a < b] + i, b[a < b] + i
        near = np.bitwise_count(v[a] ^ v[b]).sum(axis=1, dtype=np.int64) <= MOST_BITS
        left.append(a[near]), right.append(b[near])
    a, b = np.concatenate(left), np.concatenate(right)
    while len(a):
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _link_cells(rows: pa.RecordBatch) -> pa.RecordBatch:
    node, cell = rows.column("node").to_numpy(), rows.column("cell").to_numpy()
    v = np.stack([rows.column(f"v{k}").to_numpy() for k in range(VERIFY_LANES)], axis=1).view(np.uint64)
    ends = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)]
    least = np.concatenate([i + _near_rows(v[i:j]) for i, j in zip(ends, ends[1:], strict=False)])
    linked = np.flatnonzero(least != np.arange(len(least)))
    return pa.RecordBatch.from_arrays([pa.array(node[least[linked]]), pa.array(node[linked])], ["a", "b"])


def _distance(others: list[str]) -> Column:
    return sum((F.bit_count(F.col(f"v{k}").bitwiseXOR(F.col(o))) for k, o in enumerate(others)), F.lit(0))


def near_links(keyed: DataFrame) -> DataFrame:
    """Links (a, b) that connect what near pairs with a common key connect."""
    values = [f"v{k}" for k in range(VERIFY_LANES)]
    each = keyed.select("node", *values, F.explode("keys").alias("key"))
    crowded = written(each.groupBy("key").count().where(F.col("count") > CROWD), "crowded-keys")
    if crowded.isEmpty():
        return written(minhash._by_cell(each.withColumnRenamed("key", "cell"), _link_cells, ("node",)).distinct(), "near-links")
    few = broadcast_if_few(crowded, minhash.BROADCAST_ROWS)
    hot = written(each.join(few, "key"), "crowded-nodes")
    # the representative of a key is the node that most others share keys with
    scored = hot.withColumn("score", F.sum("count").over(Window.partitionBy("node")))
    rank = F.struct((-F.col("score")).alias("s"), F.xxhash64("node").alias("h"), F.col("node").alias("rep"), *(F.col(v).alias(f"r{v}") for v in values))
    heads = written(scored.groupBy("key").agg(F.min(rank).alias("first")).select("key", "first.rep", *(f"first.r{v}" for v in values)), "crowd-heads")
    met = hot.join(broadcast_if_few(heads, minhash.BROADCAST_ROWS), "key").withColumn("root", F.when(_distance([f"r{v}" for v in values]) <= MOST_BITS, F.col("rep")).otherwise(F.col("node")))
    met = written(met.select("key", "node", "root", *values), "crowd-classes")
    dealt = minhash._dealt(met, "key", F.lit(1), CROWD).select("node", *values, "cell")
    plain = each.join(few, "key", "left_anti").select("node", *values, F.col("key").alias("cell"))
    found = minhash._by_cell(plain.union(dealt), _link_cells, ("node",))
    return written(found.union(met.where("root <> node").select("root", "node")).distinct(), "near-links")


def _by_set(rows: pa.RecordBatch, percent: int):
    """Passes rows whose bits to verify are near and whose sets are alike."""
    v = np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint64).reshape(-1, LANES)[:, :VERIFY_LANES]
    near = lambda i, j: np.bitwise_count(v[i] ^ v[j]).sum(axis=1, dtype=np.int64) <= MOST_BITS
    return minhash.exact_test(rows, percent, near)


def set_links(docs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes of ``rows`` (see signatures) that connect what all pairs of similar sets connect."""
    distinct = durable(rows.where("size > 0").groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("size").alias("size"), F.first("fp").alias("fp")))
    keyed = written(_keys(distinct, key_bits(distinct.count())), "fingerprint-keys")
    groups = durable(connected_components(near_links(keyed))).select("node", F.col("root").alias("near"))
    met = durable(distinct.join(groups, "node"))
    # cut from its aggregation, so that Spark can split a large group in the joins
    common = keyed.select("node", F.explode("keys").alias("key")).join(groups, "node").select("node", F.xxhash64("key", "near").alias("key"))
    shared = written(common.groupBy("key").count().where("count > 1"), "shared-keys")
    common = written(common.join(broadcast_if_few(shared, minhash.BROADCAST_ROWS), "key"), "keyed-nodes")
    sets = minhash._fetch_sets(docs, written(met.select("node", "text_hash"), "wanted-sets"), words)
    links = durable(minhash._star_links(minhash._star_pairs(common), sets, percent))
    together = durable(met.select("node", "near", "size", "fp").join(minhash._classes(met.select("node"), links), "node"))
    cells = written(minhash._dealt(together, "near", F.col("size"), minhash.CELL_SHINGLES), "set-cells")
    exact = minhash._forest_links(cells.join(sets, "node").select("cell", "node", "root", "rest", "fp", "shingles"), _by_set, percent)
    return links.union(exact)


def set_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, size (of the shingle set), node and root of each row: rows link if 100 times their common word
    shingles is at least ``percent`` (80 or more) times all of them.

    A null or empty text, or one without words, has the empty set and node 0, and links with nothing; such rows share a
    root all the same, so callers say what they are (size is 0). Repeated rows give repeated results; null ids keep their
    rows; an empty table gives an empty result; further columns are ignored, whatever they are called.
    """
    if percent < 80:
        raise ValueError("keys are made for a similarity of 0.8 or more")
    rows = durable(signatures(docs.select("doc_id", "text"), words))
    roots = durable(connected_components(set_links(docs, rows, words, percent))).withColumnRenamed("node", "_node")
    told = rows.select("doc_id", "text_hash", "size", "node").join(roots, F.col("node") == F.col("_node"), "left")
    return told.select("doc_id", "text_hash", "size", "node", F.coalesce("root", "node").alias("root"))
