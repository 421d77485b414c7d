"""Vector codes: product quantisation with integer codebooks, nearest entries found in vantage-point trees.

Components become integers floor(4096 x); a vector is cut into equal parts, and each part position has a codebook of a
few entries. Nearest entries are found in a vantage-point tree over the codebook: each node holds an entry and the least
and greatest distance from it to the entries of its inner and its outer side. Rows first go down the tree to a near
entry, then visit every side that could hold one at most as far. Bounds are computed in floating point and rounded
outwards, a side is visited if its bound equals the best distance too, and entries are compared by integer squared
distances, so that results and ties are those of a comparison with all entries.

Rounds of refinement add up the parts of each entry: per batch in numpy, then by Spark, so that a round sends the driver
one row for each entry of each part, whatever the number of vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_few, kind, map_batches, table, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Labels whose sums are looked up by broadcast; some 20 bytes each.
BROADCAST_ROWS = 1_000_000
#: Outward rounding of bounds; distances are square roots of integers below 2**63, with a relative error of about 2**-52.
_SLACK = 2.0**-40


def greatest_component(length: int) -> int:
    """The greatest scaled component of a vector of so many for which squared distances stay within 64 bits."""
    return int((2**62 / max(1, length)) ** 0.5 / 2)


def scaled(values: np.ndarray, length: int) -> np.ndarray:
    """floor(4096 x) of finite x. Beyond greatest_component it is clamped to that: 2**27 for 64 components, an x of 32768."""
    most = greatest_component(length)
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -most, most).astype(np.int64)


def _sound(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Which lists of a batch are neither null nor hold a null or non-finite value, and the lengths of all (0 if null)."""
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten()  # leaves out what null lists cover
    values = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)  # null becomes not a number
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    ends = np.cumsum(lengths)
    return column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - lengths]), lengths


def vectors(batch: pa.RecordBatch, column: str, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are kept, which of these have ``length`` components, and the scaled components of those."""
    lists = batch.column(column)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    kept, lengths = _sound(lists)
    coded = kept & (lengths == length) & (length > 0)
    values = np.asarray(lists.filter(pa.array(coded)).flatten().to_numpy(zero_copy_only=False))
    return kept, coded[kept], scaled(values, length).reshape(-1, length) if length else np.empty((0, 0), np.int64)


@dataclass
class Tree:
    """Nodes in arrays. Node k holds ``entry[k]``; ``child[k]`` are its inner and outer side (-1: none), ``low[k]`` and
    ``high[k]`` the least and greatest distance from it to what is in either, rounded outwards."""

    entry: list[int]
    child: list[tuple[int, int]]
    low: list[tuple[float, float]]
    high: list[tuple[float, float]]


def build_tree(entries: np.ndarray) -> Tree:
    """A vantage-point tree: the first entry is the point, the nearer half of the others goes inside."""
    tree = Tree([], [], [], [])

    def grow(members: list[int]) -> int:
        if not members:
            return -1
        k, point, rest = len(tree.entry), members[0], members[1:]
        tree.entry.append(point), tree.child.append((-1, -1)), tree.low.append((0.0, 0.0)), tree.high.append((0.0, 0.0))
        if rest:
            away = np.sqrt(((entries[rest] - entries[point]) ** 2).sum(axis=1).astype(np.float64))
            order = np.argsort(away, kind="stable")
            sides = order[: (len(rest) + 1) // 2], order[(len(rest) + 1) // 2 :]
            tree.low[k] = tuple(away[s].min() * (1 - _SLACK) if len(s) else 0.0 for s in sides)
            tree.high[k] = tuple(away[s].max() * (1 + _SLACK) if len(s) else 0.0 for s in sides)
            tree.child[k] = tuple(grow([rest[i] for i in s]) for s in sides)
        return k

    grow(list(range(len(entries))))
    return tree


def nearest(rows: np.ndarray, entries: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray, int]:
    """The entry nearest to each row (ties to the lower index), its squared distance, and how many were compared."""
    best, found = np.full(len(rows), np.iinfo(np.int64).max), np.zeros(len(rows), np.int64)
    compared = 0

    def meet(k: int, at: np.ndarray) -> np.ndarray:
        nonlocal compared
        compared += len(at)
        square = ((rows[at] - entries[tree.entry[k]]) ** 2).sum(axis=1)
        better = (square < best[at]) | ((square == best[at]) & (tree.entry[k] < found[at]))
        best[at[better]], found[at[better]] = square[better], tree.entry[k]
        return np.sqrt(square.astype(np.float64))

    def down(k: int, at: np.ndarray) -> None:
        """To one entry for each row, on the side that it is nearer to."""
        away = meet(k, at)
        gap = [np.maximum(tree.low[k][s] - away, away - tree.high[k][s]) if c >= 0 else np.full(len(at), np.inf) for s, c in enumerate(tree.child[k])]
        for side, child in enumerate(tree.child[k]):
            nearer = gap[side] <= gap[1 - side] if side == 0 else gap[side] < gap[1 - side]
            if child >= 0 and nearer.any():
                down(child, at[nearer])

    def bound(k: int, at: np.ndarray) -> None:
        away = meet(k, at)
        for side, child in enumerate(tree.child[k]):
            if child < 0:
                continue
            gap = np.maximum(tree.low[k][side] - away * (1 + _SLACK), away * (1 - _SLACK) - tree.high[k][side])
            visit = at[gap * (1 - _SLACK) <= np.sqrt(best[at].astype(np.float64)) * (1 + _SLACK)]
            if len(visit):
                bound(child, visit)

    if len(rows):
        down(0, np.arange(len(rows)))
        bound(0, np.arange(len(rows)))
    return found, best, compared


def _assigned(found: np.ndarray, books: np.ndarray, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (row, part) and error of each row."""
    parts, _, width = books.shape
    each = [nearest(np.ascontiguousarray(found[:, p * width : (p + 1) * width]), books[p], trees[p])[:2] for p in range(parts)]
    return np.stack([c for c, _ in each], axis=1), np.sum([e for _, e in each], axis=0)


def first_vectors(embeddings: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> np.ndarray:
    """The scaled vectors of the smallest kept ids, in order; among equal ids by hash of the vector, null ids last.

    The first of them whose length the parts divide sets the length; only vectors of that length count.
    """
    kept = map_batches(embeddings.select("vec_id", "embedding"), _keep, f"vec_id {kind(embeddings, 'vec_id')}, embedding array<float>, length long")
    order = [F.col("vec_id").isNull(), "vec_id", F.xxhash64("embedding")]
    usable = kept.where((F.col("length") > 0) & (F.col("length") % parts == 0))
    head = usable.orderBy(*order).limit(1).collect()
    if not head:
        return np.empty((0, 0), np.int64)
    length = head[0].length
    rows = usable.where(F.col("length") == length).orderBy(*order).limit(entries).collect()
    return scaled(np.array([r.embedding for r in rows], np.float64), length)


def _keep(batch: pa.RecordBatch):
    lists = batch.column("embedding")
    kept, lengths = _sound(lists)
    mask = pa.array(kept)
    yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(mask), lists.filter(mask).cast(pa.list_(pa.float32())), pa.array(lengths[kept])], ["vec_id", "embedding", "length"])


def learn_codebooks(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Integer codebooks (part, entry, position): the first vectors, refined over all vectors in each round.

    Fewer vectors than entries give fewer entries; none give none. Sums are whole numbers, so the books do not depend on
    how rows are dealt, nor on tasks that run again.
    """
    first = first_vectors(embeddings, entries, parts)
    length = first.shape[1]
    width = length // parts
    books = np.stack([first[:, p * width : (p + 1) * width] for p in range(parts)]) if length else np.empty((parts, 0, 0), np.int64)
    for _ in range(rounds if length else 0):
        trees = [build_tree(b) for b in books]

        def summed(batch: pa.RecordBatch, books=books, trees=trees):
            _, _, found = vectors(batch, "embedding", length)
            codes, _ = _assigned(found, books, trees)
            cells, counts, sums = [], [], []
            for p in range(parts):
                used, at = np.unique(codes[:, p], return_inverse=True)
                total = np.zeros((len(used), width), np.int64)
                np.add.at(total, at, found[:, p * width : (p + 1) * width])
                cells += (p * entries + used).tolist()
                counts += np.bincount(at, minlength=len(used)).tolist()
                sums += total.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["cell", "n", "sums"])

        each = map_batches(embeddings.select("embedding"), summed, "cell int, n long, sums array<long>")
        # one row for each entry of each part, by position: sums beyond 64 bits stay exact as decimals
        exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
        for row in each.groupBy("cell").agg(F.sum("n").alias("n"), *exact).collect():
            books[row.cell // entries, row.cell % entries] = [int(row[f"s{i}"]) // row.n for i in range(width)]
    return books


def encode_vectors(embeddings: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, codes (array of entry numbers by part) and error (sum of squared distances) of each kept row.

    Rows whose vector is null or holds a null or non-finite component are dropped. A vector of another length than the
    codebooks' has null codes and error. Null and repeated ids keep their rows; further columns are ignored; an empty
    table gives an empty result. One map pass, no shuffle.
    """
    parts, _, width = books.shape
    length, trees = parts * width, [build_tree(b) for b in books]

    def work(batch: pa.RecordBatch):
        kept, coded, found = vectors(batch, "embedding", length)
        mask = pa.array(kept)
        codes, error = np.zeros((len(coded), parts), np.int32), np.zeros(len(coded), np.int64)
        if len(found):
            codes[coded], error[coded] = _assigned(found, books, trees)
        ends = np.concatenate(([0], np.cumsum(np.where(coded, parts, 0)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(codes[coded].reshape(-1)), mask=pa.array(~coded))
        columns = [batch.column("vec_id").filter(mask), batch.column("label").filter(mask), lists, pa.array(error, mask=~coded)]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "codes", "error"])

    schema = f"vec_id {kind(embeddings, 'vec_id')}, label {kind(embeddings, 'label')}, codes array<int>, error long"
    return map_batches(embeddings.select("vec_id", "label", "embedding"), work, schema)


def decode_vectors(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``codes`` (codes, and any other columns but ``approximation``) with the vectors that they stand for."""
    parts, _, width = books.shape
    table = [[[float(x) / SCALE for x in entry] for entry in book] for book in books]
    book = F.array(*(F.array(*(F.array(*map(F.lit, entry)) for entry in b)) for b in table))
    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.get(F.get(book, p), F.get("codes", p))))
    return codes.withColumn("approximation", F.when(F.col("codes").isNotNull(), whole))


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimals, by part, entry and position, joined by commas."""
    return sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded``, a written table, with label_error: the error summed over rows of equal label, null labels together."""
    each = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    each = broadcast_if_few(written(each, "label-errors"), BROADCAST_ROWS)
    return coded.join(each, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    books = learn_codebooks(embeddings)
    coded = with_label_errors(written(encode_vectors(embeddings, books), "vector-codes"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same rounds in SQL, one set of common table expressions for each, comparing with all entries."""
    steps = [
        """WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"piece AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p))",
        f"first AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries})",
        "book0 AS MATERIALIZED (SELECT p, e, x FROM piece JOIN first USING (r))",
    ]
    for k in range(rounds + 1):
        away = f"SELECT r, piece.p, e, list_sum([(a[1] - a[2]) * (a[1] - a[2]) FOR a IN list_zip(piece.x, b.x)])::BIGINT AS d FROM piece JOIN book{k} b ON piece.p = b.p"
        steps.append(f"near{k} AS MATERIALIZED (SELECT r, p, min((d, e)) AS best FROM ({away}) GROUP BY r, p)")
        if k < rounds:
            steps.append(
                f"sums{k} AS (SELECT p, e, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM (SELECT piece.p, best[2] AS e, x, unnest(range(1, len(x) + 1)) AS i FROM piece JOIN near{k} USING (r, p)) GROUP BY p, e, i)"
            )
            steps.append(f"means{k} AS (SELECT p, e, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS x FROM sums{k} GROUP BY p, e)")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN means{k} m ON b.p = m.p AND b.e = m.e)")
    steps += [
        f"coded AS (SELECT r, string_agg(lpad(printf('%x', best[2]), 2, '0'), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near{rounds} GROUP BY r)",
        f"digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})",
    ]
    return ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), digest"


ORACLE_SQL = _oracle_sql()
