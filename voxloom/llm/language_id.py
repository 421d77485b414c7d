"""Language ID with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram binds the vectors of its letters, each permuted (rotated) by
its place, by elementwise product; a text bundles its trigrams by summing them; a language's prototype bundles the
normalised vectors of its training texts. A text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bucket, kind, map_batches, only_model, table, texts

DIMENSIONS, SYMBOLS, KEPT_TRIGRAMS = 1024, 64, 16384
#: Trigrams of a text that are turned into floats and summed at once.
SUMMED_TRIGRAMS = 512
#: Texts' vectors are added up in whole multiples of 1 / UNIT, so that sums do not depend on the order of rows.
UNIT = 1 << 24
#: Training texts taken for each language; a sample by hash of about this many rows.
TEXTS_PER_LANGUAGE = 3000
#: The cosine asked of a long text, and the number of trigrams from which half of it is asked. Of the documents of sf0.1
#: the lowest cosines are 0.03 below 20 trigrams, 0.10 from 20, 0.19 from 40; of 1,000 random strings of letters and digits
#: 98 % are below what is asked at 99 characters, about two in three at 20.
LEAST_COSINE, HALF_WAY = 0.15, 40


class LetterSpace:
    """Letter vectors, and the trigram vectors bound from them so far (the most frequent come first and are kept)."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 11):
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))
        self.placed = [np.roll(letters, k, axis=1) for k in (2, 1, 0)]
        self.slot = np.full(SYMBOLS**3, -1, np.int32)
        self.kept = np.empty((KEPT_TRIGRAMS, dimensions), np.int8)
        self.n = 0
        #: Symbol of each code point: 0 for what is no letter, 1 to 26 for a to z, other letters share the rest by hash.
        self.symbol = np.zeros(0x110000, np.uint8)
        other = np.fromiter((c for c in range(0x110000) if chr(c).isalpha()), np.int64)
        self.symbol[other] = 27 + (other * 2654435761 >> 7) % (SYMBOLS - 27)
        self.symbol[97:123] = np.arange(1, 27)

    def _signs(self, trigrams: np.ndarray) -> np.ndarray:
        a, b, c = trigrams // SYMBOLS**2, trigrams // SYMBOLS % SYMBOLS, trigrams % SYMBOLS
        return self.placed[0][a] * self.placed[1][b] * self.placed[2][c]

    def bind(self, trigrams: np.ndarray) -> np.ndarray:
        return self._signs(trigrams).astype(np.float32)

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The distinct trigrams of a text over letters and single gaps, and their counts; empty if it has no letter."""
        s = self.symbol[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        if not s.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        s = np.concatenate(([0], s, [0])).astype(np.int32)
        s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
        return np.unique((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], return_counts=True)

    def bundle(self, text: str) -> tuple[np.ndarray | None, int]:
        """The unit vector of a text, None if it has no letter, and the number of its trigrams."""
        found, counts = self.trigrams(text)
        if not len(found):
            return None, 0
        # sums of whole numbers, exact in floats of this width whatever the order of the trigrams
        exact = np.float32 if counts.sum() < 1 << 24 else np.float64
        weights, total = counts.astype(exact), np.zeros(self.kept.shape[1], exact)
        for i in range(0, len(found), SUMMED_TRIGRAMS):
            some = found[i : i + SUMMED_TRIGRAMS]
            new = some[self.slot[some] < 0]
            bound, room = self._signs(new), KEPT_TRIGRAMS - self.n
            slots = np.arange(self.n, self.n + len(new[:room]))
            self.kept[slots], self.slot[new[:room]] = bound[:room], slots
            self.n += len(slots)
            at = self.slot[some]
            vectors = self.kept[at]
            vectors[at < 0] = bound[room:]
            total += weights[i : i + SUMMED_TRIGRAMS] @ vectors.astype(exact)
        total = total.astype(np.float64)
        return total / max(float(np.sqrt((total * total).sum())), 1e-9), int(counts.sum())


def _space() -> LetterSpace:
    return only_model("letters", LetterSpace)


def learn_languages(docs: DataFrame, per_language: int = TEXTS_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """The languages of the rows (doc_id, text, lang) and a unit prototype for each, in the languages' order.

    About ``per_language`` texts of each language are read, all if it has fewer: a documented bound, drawn by hash of
    id and text. Rows with null text or lang teach nothing. Sums of vectors leave the tasks, one for each language; they
    are whole numbers, so the model does not depend on how rows are dealt or on tasks that run again.
    """
    docs = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not counts:
        return [], np.zeros((0, DIMENSIONS))
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))))
    drawn = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)) < F.element_at(share, F.col("lang"))

    def sums(batch: pa.RecordBatch):
        out: dict[str, np.ndarray] = {}
        for text, lang in zip(texts(batch), batch.column("lang").to_pylist(), strict=True):
            if (v := _space().bundle(text)[0]) is not None:
                out[lang] = out.get(lang, 0) + np.rint(v * UNIT).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"lang": list(out), "total": list(out.values())}, schema=pa.schema([("lang", pa.string()), ("total", pa.list_(pa.int64()))]))

    parts = map_batches(docs.where(drawn).select("text", "lang"), sums, "lang string, total array<long>")
    summed = parts.select("lang", F.posexplode("total").alias("dim", "x")).groupBy("lang", "dim").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("xs")).orderBy("lang").collect()
    found = np.array([[x["x"] for x in r["xs"]] for r in rows], np.float64).reshape(len(rows), -1)
    return [r["lang"] for r in rows], found / np.maximum(np.sqrt((found * found).sum(axis=1, keepdims=True)), 1e-9)


def classify(all_texts: list[str], languages: list[str], prototypes: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The language of each text, its cosine, no less than 0, and the number of its trigrams."""
    names, scores, lengths = ["und"] * len(all_texts), np.zeros(len(all_texts)), np.zeros(len(all_texts), np.int64)
    for i, text in enumerate(all_texts):
        v, lengths[i] = _space().bundle(text)
        if languages and v is not None:
            cosines = np.round((prototypes * v).sum(axis=1), 6)
            k = int(cosines.argmax())
            names[i], scores[i] = languages[k], min(1.0, max(0.0, float(cosines[k])))
    return names, scores, lengths


def predict_languages(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score (the cosine, 0 to 1) of each row.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if nothing was learned. Equal
    cosines go to the first language by name. Repeated rows, ids and texts of any length are allowed, an empty table
    gives an empty result, and columns other than doc_id and text are ignored.
    """

    def work(batch: pa.RecordBatch):
        names, scores, _ = classify(texts(batch), *model)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select("doc_id", "text"), work, f"doc_id {kind(docs, 'doc_id')}, lang_pred string, score double")


def keep_known_languages(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = LEAST_COSINE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learned language.

    ``und`` goes: null and empty texts, texts without a letter, and all texts if nothing was learned. So does a text whose
    cosine is below ``least`` times n / (n + HALF_WAY), n its trigrams: the fewer, the less a low cosine tells. Repeated
    rows stay or go alike; null and repeated ids do not matter; equal cosines go to the first language by name; an empty
    table gives an empty result; columns of any name are passed on.
    """

    def work(batch: pa.RecordBatch):
        names, scores, lengths = classify(texts(batch), *model)
        yield batch.filter(pa.array((np.array(names) != "und") & (scores >= least * lengths / (lengths + HALF_WAY)), pa.bool_()))

    return map_batches(docs, work, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(id_bucket("doc_id", 5) != 0).select("doc_id", "text", "lang")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predicted = predict_languages(docs, learn_languages(training_rows(docs)))
    return predicted.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
