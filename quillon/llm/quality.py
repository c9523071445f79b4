"""A quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Each word of a text gives two names, its own bytes and its shape (its runs of small letters, capitals, digits and each
other ASCII character, runs counted as one; bytes of other characters count as small letters).  Features are the hashed
n-grams of either name, n = 1 and 2; a text's values are the square roots of their counts, scaled to length 1.  Only the
text is an input: no id, language, source or label.

The model is fitted on a bounded sample of the labelled training rows: those of least hash of their id, up to `rows`
rows and, where texts are very long, up to `most` feature values in all (at least one row).  Features are made on the
executors and written; what reaches the driver is no more than that, and comes in pieces of about `PIECE` values, for
the driver's JVM holds each piece several times over.
Scores are sparse dot products in numpy, a map over the partitions with the weights broadcast (2**bits floats).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .tables import written
from .words import GOLD, LOWER, U64, Texts, blocks, hashes, mix, split, sums

BITS = 18
#: Labelled rows that the model is fitted on, at most.
ROWS = 6000
#: Feature values that the model is fitted on, at most, of 8 bytes each.
MOST = 40_000_000
#: Feature values that are sent to the driver at a time, about.
PIECE = 1_000_000
#: The class of each byte in a word's shape: small letter, capital, digit, or the byte itself.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = SHAPE[128:] = 97
SHAPE[65:91] = 65
SHAPE[48:58] = 48


def features(texts: Texts, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct feature numbers of each text, where each text's begin, and their values."""
    found = split(texts)
    own = hashes(LOWER[texts.data], found.start, found.end)
    shape = SHAPE[texts.data]
    begins = np.zeros(len(shape) + 1, bool)
    begins[found.start] = True
    new = begins[:-1].copy()
    new[1:] |= shape[1:] != shape[:-1]
    at = np.flatnonzero(new)
    runs = shape[at]
    form = hashes(runs, np.searchsorted(at, found.start), np.searchsorted(at, found.end))
    count = np.diff(found.first)
    pairs = np.maximum(count - 1, 0)
    lead = np.repeat(found.first[:-1], pairs) + np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    values, text_of = [], []
    one = np.repeat(np.arange(len(count)), count)
    two = np.repeat(np.arange(len(count)), pairs)
    for salt, name in enumerate((own, form)):
        values += [mix(name ^ U64(salt + 1)), mix(name[lead] * GOLD + name[lead + 1] + U64(salt + 1))]
        text_of += [one, two]
    value = np.concatenate(values) >> U64(64 - bits)
    of = np.concatenate(text_of)
    key = np.sort((of.astype(np.int64) << bits) | value.astype(np.int64))
    first = np.searchsorted(key >> bits, np.arange(len(count) + 1))
    index, first, times = distinct_sorted(key, first, bits)
    weight = np.sqrt(times)
    norm = np.sqrt(sums(times.astype(np.float64), first))
    return index, first, weight / np.repeat(np.maximum(norm, 1.0), np.diff(first))


def distinct_sorted(key: np.ndarray, first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(key):
        return key, np.zeros(len(first), np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[at] & ((1 << bits) - 1), np.searchsorted(at, first), np.diff(np.append(at, len(key)))


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    bits: int

    def scores(self, texts: Texts) -> np.ndarray:
        index, first, value = features(texts, self.bits)
        margin = sums(self.weights[index].astype(np.float64) * value, first) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, updates: int = 24_000, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01) -> Model:
    """FTRL-proximal with one learning rate for each feature; examples: feature numbers, values, label 0 or 1.

    All examples are passed eight times, or as often as it takes for so many updates.  Without examples the weights are 0 and the bias too: every score is 0.5.
    """
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = bias = 0.0
    order = np.random.default_rng(7)

    def weights(i) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, (np.sign(z[i]) * l1 - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(max(8, -(-updates // max(len(examples), 1)))):
        for k in order.permutation(len(examples)):
            i, x, y = examples[k]
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x + bias, -35, 35)))
            g = (p - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
            gb = p - y
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / alpha * bias
            nb += gb * gb
            bias = -zb / ((beta + np.sqrt(nb)) / alpha + l2)
    return Model(weights(slice(None)).astype(np.float32), float(bias), bits)


def train(labelled: DataFrame, label: str, rows: int = ROWS, bits: int = BITS, key: str = "doc_id", text: str = "text", most: int = MOST) -> Model:
    """A model of labelled rows: those whose key has the least hash, at most `rows` of them with at most `most` feature
    values together.  Rows whose label is null are left out; a null text is an empty one.  Only feature vectors travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "__text"):
            index, first, value = features(texts, bits)
            cut = range(batch.num_rows)
            made = [pa.array([a[first[k] : first[k + 1]].astype(kind).tobytes() for k in cut], pa.binary()) for a, kind in ((index, "<i4"), (value, "<f4"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["h", "y", "i", "x"])

    read = labelled.where(F.col(label).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(label).cast("int").alias("y"), F.col(text).cast("string").alias("__text"))
    vectors = written(read.mapInArrow(run, "h long, y int, i binary, x binary"))
    order = ["h", "y", "i", "x"]
    sizes = vectors.select("h", (F.octet_length("i") / 4).cast("long").alias("n")).orderBy("h", "n").limit(rows).collect()
    total, last = 0, None
    for r in sizes:
        total += r.n
        if last is not None and total > most and r.h != last:
            break
        last = r.h
    chosen = vectors.where(F.col("h") <= F.lit(last)).orderBy(*order).limit(rows).repartition(total // PIECE + 1) if sizes else None
    made = sorted((r.h, r.y, bytes(r.i), bytes(r.x)) for r in chosen.toLocalIterator()) if sizes else []
    return fit([(np.frombuffer(i, "<i4"), np.frombuffer(x, "<f4"), int(y == 1)) for _, y, i, x in made], bits)


def sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, rows: int = ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with their label, of at most `rows` labelled ids that may_learn holds for: those of least hash.  The ids
    are few by that bound and so are broadcast; texts are read once and not shuffled."""
    ids = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).where(may_learn).select(key, F.col(label).cast("int").alias("__label"))
    ids = ids.groupBy(key).agg(F.min("__label").alias("__label")).orderBy(F.xxhash64(key), key).limit(rows)
    return docs.select(key, text).join(F.broadcast(ids), key).withColumnRenamed("__label", label)


def scored(docs: DataFrame, model: Model, text: str = "text", least: float = 0.3, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs, all columns, with a score (0 to 1; higher: likelier label 1) and predicted (1 if score >= least).

    Columns of docs that have these two names are replaced.  A null or empty text has the score of no features, which
    is that of the bias alone; repeated texts have equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (score, predicted)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, text):
            p = shared.value.scores(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= least).astype(np.int32))], [*kept, score, predicted])

    fields = [docs.schema[c] for c in kept] + [T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())]
    return docs.select(*kept).mapInArrow(run, T.StructType(fields))
