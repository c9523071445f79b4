"""I-Match document fingerprints.

A term is a word in lower case (A-Z).  Document frequencies of all terms are counted over all documents.  The lexicon
is the terms whose frequency is within a band; as a term of the band is in at least low * D documents, the lexicon has at
most U / low terms, where U is the mean number of distinct terms of a document, whatever the size of the corpus.  Each
of K subsets of the lexicon takes every term with a chance of its own (the first all, then 1/4 ... 1/512 in turns), by hash.  A document's
distinct terms of the lexicon are sorted, and those of each subset are hashed: K parts of 8 hex digits make the
fingerprint.  A part without terms is `--------`; a document without terms of the lexicon is hashed over all its terms.

The likeness of two fingerprints is the share of equal parts among those where either has terms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from .tables import even_keys, partitions
from .words import U64, Texts, blocks, column, distinct, mix, mix_int, sums, word_hashes

PARTS = 32
LOW, HIGH = 0.0005, 0.02
#: Terms of a lexicon, at most; a band that lets in more is refused, as the lexicon is broadcast.
MOST_TERMS = 4_000_000
EMPTY = "-" * 8
#: Ranges of ids for each task of the shuffle.
RANGES_A_TASK = 4


def frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """term (64-bit hash), df: in how many rows each term stands.  A task adds up its own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def add() -> None:
            nonlocal terms, counts, waiting
            both = np.concatenate([terms, *waiting])
            weight = np.concatenate([counts, np.ones(len(both) - len(terms), np.int64)])
            order = np.argsort(both)
            both, weight = both[order], weight[order]
            at = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
            terms, counts, waiting = both[at], np.add.reduceat(weight, at) if len(at) else weight, []

        def out() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(terms), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(terms[k : k + (1 << 16)].view(np.int64)), pa.array(counts[k : k + (1 << 16)])], ["term", "n"])

        for _, texts in blocks(batches, "__text"):
            found, hashed = word_hashes(texts, lower=True)
            waiting.append(distinct(hashed, found.first)[0])
            if sum(map(len, waiting)) > 1 << 20:
                add()
                if len(terms) > 1 << 21:
                    yield from out()
                    terms, counts = terms[:0], counts[:0]
        add()
        yield from out()

    return docs.select(F.col(text).cast("string").alias("__text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> np.ndarray:
    """The sorted hashes of the terms in at least 2 and low * D, and at most max(2, high * D) of all D documents."""
    n = docs.count()
    band = frequencies(docs, text).where((F.col("df") >= max(2, low * n)) & (F.col("df") <= max(2, high * n)))
    found = band.select("term").limit(MOST_TERMS + 1).toArrow()["term"].to_numpy()
    if len(found) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms in the band: raise low")
    return np.sort(found.astype(np.int64).view(U64))


def fingerprints(texts: Texts, known: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """A row of parts for each text; 0 is a part without terms."""
    found, hashed = word_hashes(texts, lower=True)
    terms, first, _ = distinct(hashed, found.first)
    at = np.searchsorted(known, terms)
    inside = known[np.minimum(at, len(known) - 1)] == terms if len(known) else np.zeros(len(terms), bool)
    before = np.append(0, np.cumsum(inside))[first]
    own, own_first = terms[inside], before
    none = np.diff(own_first) == 0
    out = np.zeros((len(first) - 1, parts), U64)
    for j in range(parts):
        h = mix(own ^ U64(mix_int(j + 1)))
        chosen = h >> U64(64 - j % 8 - 2) == 0 if j else np.ones(len(h), bool)
        kept = np.append(0, np.cumsum(chosen))[own_first]
        value = mix(sums(mix(h[chosen] + U64(j)), kept))
        out[:, j] = np.where(np.diff(kept) > 0, value | U64(1 << 32), 0)
    if none.any():
        whole = mix(sums(mix(terms), first)[none, None] ^ np.arange(1, parts + 1, dtype=U64))
        out[none] = whole | U64(1 << 32)
    return np.where(out > 0, (out & U64(0xFFFFFFFF)) | U64(1 << 32), 0)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of parts, 0 to 1."""
    either = ((a > 0) | (b > 0)).sum(axis=1)
    return ((a == b) & (a > 0)).sum(axis=1) / np.maximum(either, 1)


def shown(rows: np.ndarray) -> list[str]:
    return ["".join(EMPTY if v == 0 else f"{v & 0xFFFFFFFF:08x}" for v in row) for row in rows.tolist()]


def fingerprinted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", known: np.ndarray | None = None) -> DataFrame:
    """doc_id and fingerprint of each row; a map over partitions.  A null text counts as empty: no terms at all."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text) if known is None else known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "__text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown(fingerprints(texts, shared.value)))], [doc_id, "fingerprint"])

    schema = T.StructType([docs.schema[doc_id], T.StructField("fingerprint", T.StringType())])
    return docs.select(doc_id, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def _placed(ids: DataFrame, buckets: int) -> tuple[np.ndarray, dict[int, int]]:
    """Upper bounds of ranges of ids, about equal in rows, and for the largest id of each range that has any, the range
    above it that has any, in a ring.  Both are as many as there are ranges, and gathered on the driver."""
    cuts = ids.approxQuantile("id", [k / buckets for k in range(1, buckets)], 0.25 / buckets) if buckets > 1 else []
    bounds = np.unique(np.array(cuts, np.float64).astype(np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, int] = {}
        for batch in batches:
            own = batch.column(0).to_numpy()
            for b, i in zip(np.searchsorted(bounds, own, "left").tolist(), own.tolist(), strict=True):
                most[b] = max(most.get(b, i), i)
        if most:
            yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int64()), pa.array(list(most.values()), pa.int64())], ["range", "id"])

    tops = ids.mapInArrow(place, "range long, id long").groupBy("range").agg(F.max("id").alias("id")).orderBy("range").collect()
    return bounds, {r["id"]: tops[(k + 1) % len(tops)]["range"] for k, r in enumerate(tops)}


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", known: np.ndarray | None = None) -> DataFrame:
    """A row for each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document's, by descending doc_id; after the last comes the first.  Rows of equal id follow each other by a hash of their text, and a
    single document is its own next.  A null text counts as empty; rows without id come last, by descending hash of their
    text, so that they are dealt to ranges as ids are.  Ids are integers of up to 53 bits.

    Texts are dealt to ranges of ids once, compressed; a range also gets the first document of the range below.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon(docs, text) if known is None else known)
    least = -(1 << 62)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    nameless = F.lit(least) + F.shiftrightunsigned(F.xxhash64(whole), 4)
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), nameless).alias("id"), F.xxhash64(whole).alias("key"), whole.alias("__text"))
    n = partitions(spark)
    bounds, heads = _placed(own.select("id"), n * RANGES_A_TASK)
    tasks = np.array(even_keys(spark, n))
    names_dealt = ["task", "range", "guest", "id", "key", "text"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch, texts in blocks(batches, "__text"):
            ids = batch.column(0).to_numpy()
            place = np.searchsorted(bounds, ids, "left")
            packed = pa.array([press(texts.text(k)) for k in range(len(ids))], pa.binary())
            columns = [batch.column(0), batch.column(1), packed]
            yield pa.RecordBatch.from_arrays([pa.array(tasks[place % n]), pa.array(place), pa.array(np.zeros(len(ids), bool)), *columns], names_dealt)
            guests = [k for k, i in enumerate(ids.tolist()) if i in heads]
            if guests:
                to = np.array([heads[int(ids[k])] for k in guests])
                yield pa.RecordBatch.from_arrays([pa.array(tasks[to % n]), pa.array(to), pa.array([True] * len(guests)), *[c.take(pa.array(guests)) for c in columns]], names_dealt)

    def finish(rows: list[tuple[int, str]], following: list[str]) -> pa.RecordBatch:
        new = []
        for (_, t), after in zip(rows, following, strict=True):
            k = len(t) // 3
            new.append(t[: len(t) - k] + after[:k])
        prints = [fingerprints(column(pa.array(x, pa.large_string())), shared.value) for x in ([t for _, t in rows], new, following)]
        ids = pa.array([None if i < least // 2 else i for i, _ in rows], pa.int64())
        made = [pa.array([len(t) for _, t in rows], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new])]
        made += [pa.array(shown(p)) for p in prints[:2]] + [pa.array(likeness(prints[0], p)) for p in prints[1:]]
        return pa.RecordBatch.from_arrays([ids, *made], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, str]] = []
        following: list[str] = []
        place, size, closed = None, 0, False
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for where, guest, i, _, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = open_(data).decode()
                if where != place:
                    # The last document of a range has its next from the guest, so all rows are complete here.
                    place, closed = where, False
                    following.extend([""] * (len(rows) - len(following)))
                elif not closed and len(following) < len(rows):
                    following.append(t)
                if guest:
                    closed = True
                    continue
                rows.append((i, t))
                size += len(t)
                if size > 2 << 20 and len(rows) > 1:
                    yield finish(rows[:-1], following)
                    rows, following, size = rows[-1:], [], len(t)
        if rows:
            yield finish(rows, following)

    names = [doc_id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType()]
    dealt = own.mapInArrow(deal, "task long, range long, guest boolean, id long, key long, text binary")
    dealt = dealt.repartition(n, "task").sortWithinPartitions("range", "guest", F.desc("id"), "key").drop("task")
    return dealt.mapInArrow(run, T.StructType([T.StructField(a, b) for a, b in zip(names, kinds, strict=True)]))
