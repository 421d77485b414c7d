"""MinHash near-duplicates: fast similarity sketches, banding, exact verification.

A sketch has one coordinate for each of many bins. In round i each shingle hash is placed in one bin and offers i plus a
fraction there; a bin keeps the least offer, so an earlier round always beats a later one. As many rounds as bins place by
hash; in as many again round i offers to one bin alone, so that every coordinate is filled whatever the size of the set,
and rounds end when all are. A large set fills its sketch in a round or two, so a sketch takes time in proportion to the
set and not to set times coordinates, and two sketches agree in a coordinate with the probability of their similarity,
concentrated as with independent permutations.

Sets at the similarity share the key of one of 25 bands of 5 coordinates in all but a share of cases that ``missed`` gives
(0.85: 4 in 10 million; 0.8: 5 in 100,000). Texts with equal sets are one node. What shares a key is settled in two steps:

* Every node is compared with one other, the representative of a key (the node whose keys most others share), of those
  the one with which it shares most keys. A family of near copies hangs together after this, at the cost of each set
  written once, whatever its size. Nodes that are linked with one representative are a class.
* Keys that hold nodes of more than one class are compared by sketch, with a wide margin, and what the sketches leave
  together is compared by sets, each node outside the largest class with all others.

Only counts of common shingles decide about a link; sketches only propose. All of a key's nodes are compared: there is no
cap. Keys and proposals that very many nodes share are dealt over cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import bounded_batches, broadcast_if_few, durable, give_back, kind, map_batches, table, texts, written
from .components import connected_components
from .simhash import _LOWER

WORDS, PERCENT = 5, 85
BANDS, BAND_ROWS = 25, 5
BINS = BANDS * BAND_ROWS
#: Sketches, and shingles, that one side of a cell holds, on average; members that one copy of a representative meets.
CELL, CELL_SHINGLES, STAR = 256, 1 << 16, 64
#: Nodes and keys that are looked up by broadcast; some 20 bytes each.
BROADCAST_ROWS = 200_000
_SEEDS = np.random.default_rng(13).integers(1, 1 << 62, 4 * BINS, np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # constants of a published 64-bit finaliser


def missed(similarity: float) -> float:
    """The share of pairs at a similarity that have no key in common."""
    return (1 - similarity**BAND_ROWS) ** BANDS


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's word shingles in ascending order; a shorter text is one shingle."""
    found = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    grams = set(map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False))) or {b" ".join(found)}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams)))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _M1
    values = (values ^ (values >> np.uint64(27))) * _M2
    return values ^ (values >> np.uint64(31))


def sketch(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The least offer of each bin, as round << 32 | fraction; of an empty set all ones.

    Rounds are taken several at a time where the set is small; offers of rounds that were not needed change nothing.
    """
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    if not len(hashes):
        return out
    i, at_once = 0, max(1, 2048 // len(hashes))
    while i < 2 * bins and out.max() == np.iinfo(np.uint64).max:
        rounds = np.arange(i, min(i + at_once, 2 * bins), dtype=np.uint64)
        for part in range(0, len(hashes), 1 << 16):
            mixed = _mixed(hashes[None, part : part + (1 << 16)] ^ _SEEDS[rounds.astype(np.int64)][:, None])
            offers = (rounds[:, None] << np.uint64(32)) | (mixed & np.uint64(0xFFFFFFFF))
            placed = ((mixed >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
            placed = np.where(rounds[:, None] < bins, placed, rounds[:, None] % np.uint64(bins)).astype(np.int64)
            np.minimum.at(out, placed.ravel(), offers.ravel())
        i += at_once
    return out


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, node (hash of the shingle set, 0 if empty), size (of the set), bands (its keys) and sketch (a byte
    of each coordinate)."""

    def work(batch: pa.RecordBatch):
        nodes, sizes, bands, sketches, ends = [], [], [], [], [0]
        for text in texts(batch):
            found = shingles(text, words)
            drawn = sketch(found)
            nodes.append(xxhash.xxh64_intdigest(found.tobytes(), 42) if len(found) else 0)
            sizes.append(len(found))
            bands += [xxhash.xxh64_intdigest(drawn[k * BAND_ROWS : (k + 1) * BAND_ROWS].tobytes(), k) for k in range(BANDS)] if len(found) else []
            ends.append(len(bands))
            sketches.append(drawn.astype(np.uint8).tobytes())
        signed = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))
        keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), signed(bands))
        columns = [batch.column("doc_id"), batch.column("text_hash"), signed(nodes), pa.array(sizes, pa.int64()), keys, pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "size", "bands", "sketch"])

    hashed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return map_batches(hashed, work, f"doc_id {kind(docs, 'doc_id')}, text_hash long, node long, size long, bands array<long>, sketch binary")


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 times the common shingles is at least ``percent`` times all shingles of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def forest(cell: np.ndarray, root: np.ndarray, tested: Callable[[np.ndarray, np.ndarray], np.ndarray], both: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows i and j of equal ``cell`` (given in order) and unlike ``root`` that pass: enough links to connect what all such
    pairs and equal roots connect. Compares rows at distance 1, 2, ... and leaves out what is linked by then.

    ``both``: rows that need only be compared with rows where it is true.
    """
    _, first = np.unique(np.stack([cell, root]), axis=1, return_inverse=True)
    first = first.ravel()
    label = np.full(first.max() + 1 if len(first) else 0, len(cell))
    np.minimum.at(label, first, np.arange(len(cell)))
    label, left, right = label[first], [], []
    at = np.arange(len(cell) - 1)
    step = 1
    while len(at := at[at + step < len(cell)]) and len(at := at[cell[at] == cell[at + step]]):
        i = at[label[at] != label[at + step]]
        if both is not None:
            i = i[both[i] | both[i + step]]
        if len(i) and len(i := i[tested(i, i + step)]):
            left.append(i), right.append(i + step)
            a, b = label[i], label[i + step]
            while (a != b).any():
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label[label] != label).any():
                    label = label[label]
                a, b = label[a], label[b]
            label = label[label]
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (at[:0], at[:0])


def _by_sketch(rows: pa.RecordBatch, percent: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Passes a share of equal bytes less than 4.5 standard deviations below the similarity."""
    s = percent / 100
    least = int(BINS * s - 4.5 * (BINS * s * (1 - s)) ** 0.5)
    drawn = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.concatenate([(drawn[i[k : k + 65536]] == drawn[j[k : k + 65536]]).sum(axis=1) >= least for k in range(0, len(i), 65536)])

    return near


def exact_test(rows: pa.RecordBatch, percent: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Passes what ``near`` passes if the sets (column shingles) are alike."""
    ends, values = rows.column("shingles").offsets.to_numpy(), rows.column("shingles").values.to_numpy()

    def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        passed = near(i, j)
        for m in np.flatnonzero(passed):
            passed[m] = alike(*(values[ends[x] : ends[x + 1]] for x in (i[m], j[m])), percent)
        return passed

    return exact


def _by_set(rows: pa.RecordBatch, percent: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return exact_test(rows, percent, _by_sketch(rows, percent))


def _by_cell(cells: DataFrame, linked: Callable[[pa.RecordBatch], pa.RecordBatch], order: tuple[str, ...]) -> DataFrame:
    """(a, b) of ``linked`` for the rows of each cell; a partition carries over only its last cell."""
    spark = cells.sparkSession
    ship(spark)
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            start = int(np.searchsorted(cell, cell[-1]))  # cells are signed longs in ascending order
            if rest and (start or rest[-1].column("cell")[-1].as_py() != cell[0]):
                yield linked(pa.concat_batches([*rest, batch.slice(0, start)]))
                rest = [batch.slice(start)]
            elif start:
                yield linked(batch.slice(0, start))
                rest = [batch.slice(start)]
            else:
                rest.append(batch)
        if rest:
            yield linked(pa.concat_batches(rest))
        del rest
        give_back()

    return cells.repartition("cell").sortWithinPartitions("cell", *order).mapInArrow(run, "a long, b long")


def _forest_links(cells: DataFrame, test: Callable, percent: int) -> DataFrame:
    def linked(rows: pa.RecordBatch) -> pa.RecordBatch:
        node = rows.column("node").to_numpy()
        i, j = forest(rows.column("cell").to_numpy(), rows.column("root").to_numpy(), test(rows, percent), rows.column("rest").to_numpy(zero_copy_only=False))
        return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["a", "b"])

    return _by_cell(cells, linked, ("node",))


def _dealt(rows: DataFrame, key: str, weight: Column, most: int) -> DataFrame:
    """``rows`` (key, node, root) with cell and rest: any two rows of a key of which one is outside the key's largest
    component (rest is true) have a cell in common.

    A key of weight ``most`` is one cell. A heavier one has its nodes dealt over parts, and a cell for each part of the
    rest with each part; what has one component only has no cell. Counts are cut from their aggregation, so that Spark
    can split a hot key in the joins.
    """
    each = rows.groupBy(key, "root").agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))
    whole = each.groupBy(key).agg(F.count("*").alias("roots"), F.sum("weight").alias("weight"), F.max(F.struct("weight", "root")).alias("top"))
    whole = whole.where("roots > 1").select(
        F.col(key).alias("_key"), F.col("top.root").alias("top"), F.ceil(F.col("weight") / most).cast("int").alias("parts"),
        F.ceil((F.col("weight") - F.col("top.weight")) / most).cast("int").alias("rest_parts"),
    )
    whole = broadcast_if_few(written(whole, "cells"), BROADCAST_ROWS)
    dealt = rows.join(whole, F.col(key) == F.col("_key")).withColumn("rest", F.col("root") != F.col("top"))
    part = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    own = F.struct(part("rest_parts", 7).alias("r"), part("parts", 9).alias("p"))
    # a node of the rest goes to all cells of its own part of the rest, every node to those of its part for all parts of the rest
    every = F.transform(F.sequence(F.lit(0), F.col("rest_parts") - 1), lambda r: F.struct(r.alias("r"), own["p"].alias("p")))
    across = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(own["r"].alias("r"), p.alias("p")))
    places = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("r"), F.lit(0).alias("p")))).when(F.col("rest"), F.array_distinct(F.concat(every, across))).otherwise(every)
    dealt = dealt.withColumn("_at", F.explode(places))
    return dealt.withColumn("cell", F.when(F.col("parts") == 1, F.col(key)).otherwise(F.xxhash64(key, "_at.r", "_at.p"))).drop("_key", "top", "parts", "rest_parts", "_at")


def _star_pairs(keyed: DataFrame) -> DataFrame:
    """(rep, node): each node with the representative with which it shares most keys. ``keyed`` has node, key and the
    count of nodes with that key; a node has as many rows as bands at most."""
    scored = keyed.withColumn("score", F.sum("count").over(Window.partitionBy("node")))
    rank = F.struct((-F.col("score")).alias("s"), F.xxhash64("node").alias("h"), F.col("node").alias("rep"))
    first = written(scored.groupBy("key").agg(F.min(rank)["rep"].alias("rep")), "representatives")
    shared = keyed.select("node", "key").join(first, "key").where("node <> rep").groupBy("node", "rep").count()
    return shared.groupBy("node").agg(F.max(F.struct("count", "rep"))["rep"].alias("rep"))


def _classes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node and root: nodes linked with one representative have it as root, as has the representative itself."""
    reps = links.select(F.col("a").alias("_node"), F.col("a").alias("_root")).distinct()
    others = links.select(F.col("b").alias("_node"), F.col("a").alias("_root")).join(reps.select("_node"), "_node", "left_anti")
    told = reps.unionByName(others)
    return durable(nodes.join(told, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("_root", "node").alias("root")))


def _star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the pairs whose sets are alike. A representative's set is copied once for STAR members or so; each
    member's set is written once."""
    pairs = written(pairs, "star-pairs")
    copies = written(pairs.groupBy("rep").agg(F.ceil(F.count("*") / STAR).cast("int").alias("copies")), "star-copies")
    sets = sets.select("node", "shingles")
    salted = broadcast_if_few(written(pairs.join(copies, "rep").select("node", "rep", F.pmod(F.xxhash64("node", F.lit(5)), F.col("copies")).cast("int").alias("copy")), "salted-pairs"), BROADCAST_ROWS)
    members = sets.join(salted, "node").select("rep", "copy", "node", F.lit(True).alias("member"), "shingles")
    few = broadcast_if_few(copies, BROADCAST_ROWS)
    heads = sets.join(few, sets.node == few.rep).select("rep", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "node", F.lit(False).alias("member"), "shingles")
    cells = members.unionByName(heads).select(F.xxhash64("rep", "copy").alias("cell"), "rep", "node", "member", "shingles")

    def linked(rows: pa.RecordBatch) -> pa.RecordBatch:
        rep, node, member = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "node", "member"))
        ends, values = rows.column("shingles").offsets.to_numpy(), rows.column("shingles").values.to_numpy()
        of = lambda k: values[ends[k] : ends[k + 1]]
        head, a, b = None, [], []
        for k in range(len(rep)):
            if not member[k]:
                head = k
            elif alike(of(head), of(k), percent):
                a.append(rep[k]), b.append(node[k])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _by_cell(cells, linked, ("rep", "member"))


def _fetch_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and shingles of each row of ``wanted`` (node, text_hash): one text of each node is read again."""
    few = broadcast_if_few(wanted, BROADCAST_ROWS)
    again = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text").join(few, "text_hash").dropDuplicates(["node"])

    def work(batch: pa.RecordBatch):
        found = [pa.array(shingles(t, words).view(np.int64)) for t in texts(batch)]
        ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        sets = pa.ListArray.from_arrays(ends, pa.concat_arrays(found) if found else pa.array([], pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("node"), sets], ["node", "shingles"])

    return written(map_batches(again.select("node", "text"), work, "node long, shingles array<long>"), "shingle-sets")


def minhash_links(docs: DataFrame, rows: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between nodes of ``rows`` (see signatures) that connect what all pairs of similar sets connect."""
    distinct = durable(rows.where("size > 0").groupBy("node").agg(F.min("text_hash").alias("text_hash"), *(F.first(c).alias(c) for c in ("size", "bands", "sketch"))))
    keyed = distinct.select("node", F.explode("bands").alias("key"))
    # cut from its aggregation, so that Spark can split a hot key in the join
    shared = written(keyed.groupBy("key").count().where("count > 1"), "shared-bands")
    keyed = written(keyed.join(broadcast_if_few(shared, BROADCAST_ROWS), "key"), "keyed-nodes")
    nodes = durable(keyed.select("node").distinct())
    met = distinct.join(nodes, "node").select("node", "text_hash", "size", "sketch")
    sets = _fetch_sets(docs, written(met.select("node", "text_hash"), "wanted-sets"), words)
    links = durable(_star_links(_star_pairs(keyed), sets, percent))
    roots = _classes(nodes, links)
    # what still shares a key: by sketch first, then by sets within what the sketches and the links leave together
    open_keys = _dealt(keyed.select("node", "key").join(roots, "node"), "key", F.lit(1), CELL).join(met.select("node", "sketch"), "node")
    nearby = written(_forest_links(open_keys.select("cell", "node", "root", "rest", "sketch"), _by_sketch, percent).union(links), "near-nodes")
    groups = connected_components(nearby).select("node", F.col("root").alias("near"))
    together = durable(met.join(roots, "node").join(groups, "node").select("node", "near", "root", "size", "sketch"))
    cells = written(_dealt(together, "near", F.col("size"), CELL_SHINGLES), "set-cells")
    exact = _forest_links(cells.join(sets, "node").select("cell", "node", "root", "rest", "sketch", "shingles"), _by_set, percent)
    return links.union(exact)


def minhash_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, size (of the shingle set), node and root of each row: rows link if 100 times their common word
    shingles is at least ``percent`` times all of them.

    A null or empty text, or one without words, has the empty set and node 0, and links with nothing; such rows share a
    root all the same, so callers say what they are (size is 0). Repeated rows give repeated results; null ids keep their
    rows; an empty table gives an empty result; further columns are ignored, whatever they are called.
    """
    rows = durable(signatures(docs.select("doc_id", "text"), words))
    roots = durable(connected_components(minhash_links(docs, rows, words, percent))).withColumnRenamed("node", "_node")
    told = rows.select("doc_id", "text_hash", "size", "node").join(roots, F.col("node") == F.col("_node"), "left")
    return told.select("doc_id", "text_hash", "size", "node", F.coalesce("root", "node").alias("root"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null id has no component of its own: it takes the least id of its links, if any. Rows that repeat an id and a text
    have equal results. Of rows with the empty set each is by itself."""
    found = durable(minhash_components(table(spark, sf_dir, "documents"), WORDS, PERCENT))
    full = found.where("size > 0")
    least = written(full.groupBy(F.col("root").alias("_root")).agg(F.min("doc_id").alias("least")), "least-ids")
    named = full.join(least, F.col("root") == F.col("_root")).select("doc_id", "size", F.col("least").alias("component_id"))
    alone = found.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    return named.unionByName(alone).select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id, d.doc_id = m AS kept
FROM documents d JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) r ON d.doc_id = r.x LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""
