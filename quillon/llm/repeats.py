"""Substring dedup: super-k-mer partitioning of windows of words.

A window's minimiser is the least hash of its runs of four words.  Consecutive windows of a text that share a minimiser
travel together, as one packed string of their words, to the bucket of that minimiser, so all windows of equal words
meet there, and sorting them by hash finds each window's earliest start.  Windows count as equal if two 64-bit hashes
made in different ways from their words' hashes are equal.

Each block of texts that a map task works on first sorts its own windows: only the earliest of equal ones travels, the
others are marked at once.  So a bucket gets at most one copy of a window from each block, however often it stands in
the corpus.  Marks go back, as runs of window starts, to the rows of their text, where covered words are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from .tables import partitions, written
from .words import GOLD, U64, Texts, blocks, hashes, mix, split

NO_ID = np.iinfo(np.int64).max
RUN = 4
#: Buckets for each task of the shuffle; a task works on one at a time.
BUCKETS_A_TASK = 8
#: Text bytes whose windows a map task sorts at once.
SEND_BYTES = 2 << 20


def _rolled(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of n words, over text ends too, by doubling; one for each run start."""
    parts = {1: mix(words ^ U64(salt)) if salt else words}
    size = 1
    while size * 2 <= n:
        h = parts[size]
        parts[size * 2] = mix(h[: len(h) - size] * GOLD + h[size:]) if len(h) > size else h[:0]
        size *= 2
    out, done = parts[size], size
    for part in sorted((p for p in parts if p < size), reverse=True):
        if n - done >= part:
            k = len(words) - done - part + 1
            out = mix(out[: max(k, 0)] * GOLD + parts[part][done : done + max(k, 0)])
            done += part
    return out


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each run of n values."""
    size = 1
    while size * 2 <= n:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    rest = n - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def window_starts(first: np.ndarray, window: int) -> np.ndarray:
    """Word numbers at which a window within a text starts."""
    count = np.maximum(np.diff(first) - window + 1, 0)
    return np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())


def repeated(h: np.ndarray, second, order: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether an equal window has a smaller (order, start).  second(which) gives other hashes of some windows."""
    by = np.argsort(h, kind="stable")
    same = h[by[1:]] == h[by[:-1]]
    met = by[np.append(same, False) | np.append(False, same)] if len(h) else by
    out = np.zeros(len(h), bool)
    if not len(met):
        return out
    other = second(met)
    by = np.lexsort((start[met], order[met], other, h[met]))
    met, other = met[by], other[by]
    new = np.append(True, (h[met[1:]] != h[met[:-1]]) | (other[1:] != other[:-1]))
    lead = met[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out[met] = (order[met] != order[lead]) | (start[met] != start[lead])
    return out


def _runs(of: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, ordered, as runs of consecutive ones: their text, first start and number."""
    new = np.append(True, (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1)) if len(of) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return of[at], start[at], np.diff(np.append(at, len(of)))


def _marks(ids: np.ndarray, keys: np.ndarray, of: np.ndarray, start: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(id, key, runs) for each text with marked windows."""
    if not len(of):
        return []
    of, first, n = _runs(of, start)
    cut = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    pair = np.stack([first, n], axis=1).astype("<i8")
    return [(int(ids[of[a]]), int(keys[of[a]]), pair[a:b].tobytes()) for a, b in zip(cut, np.append(cut[1:], len(of)), strict=True)]


def _pick(texts: Texts, start: np.ndarray, end: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words [start, end) joined by one blank each within the groups that begin at `cut` (one more than groups):
    the bytes of all groups, and where each begins; a group's bytes end in one blank more."""
    to = np.append(0, np.cumsum(end - start + 1))
    out = np.empty(to[-1], np.uint8)
    a = 0
    while a < len(start):  # a part at a time, as the places of bytes take eight times their room
        b = min(max(int(np.searchsorted(to, to[a] + (1 << 20), "right")) - 1, a + 1), len(start))
        at = np.repeat(start[a:b] - to[a:b], np.diff(to[a : b + 1])) + np.arange(to[a], to[b])
        out[to[a] : to[b]] = texts.data[np.minimum(at, len(texts.data) - 1)]
        a = b
    out[to[1:] - 1] = 32
    return out, to[cut]


def _send(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch, texts in blocks(batches, "__text", SEND_BYTES):
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = split(texts)
            at = window_starts(found.first, window)
            if not len(at):
                continue
            words = hashes(texts.data, found.start, found.end)
            whole = _rolled(words, window)
            of = np.searchsorted(found.first, at, "right") - 1
            start = at - found.first[of]

            def second(which: np.ndarray, words=words, at=at) -> np.ndarray:
                return _rolled(words, window, 0x1234567)[at[which]]

            dup = repeated(whole[at], second, ids[of], start)
            # Marks only pass through; those of copies of a text are spread by their ids.
            rows = [((key + int(GOLD) * i) % buckets, None, i, key, data) for i, key, data in _marks(ids, keys, of[dup], start[dup])]
            # An equal window at the same place of a row with the same id travels once for each text.
            go = np.flatnonzero(~dup)  # at least one: the earliest window of the block
            least = _least(_rolled(words, RUN), window - RUN + 1)[at[go]] if window > RUN else whole[at[go]]
            new = np.append(True, (of[go[1:]] != of[go[:-1]]) | (at[go[1:]] != at[go[:-1]] + 1) | (least[1:] != least[:-1]))
            head = np.flatnonzero(new)
            n = np.diff(np.append(head, len(go)))
            bucket = (mix(least[head]) % U64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            head, n, bucket = head[by], n[by], bucket[by]
            first, length = at[go[head]], n + window - 1
            to = np.append(0, np.cumsum(length))
            word = np.repeat(first - to[:-1], length) + np.arange(to[-1])
            text, where = _pick(texts, found.start[word], found.end[word], to)
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for a, b in zip(cut, np.append(cut[1:], len(bucket)), strict=True):
                o = of[go[head[a:b]]]
                table = np.stack([ids[o], keys[o], start[go[head[a:b]]], length[a:b]]).astype("<i8")
                rows.append((int(bucket[a]), press.compress(np.int64(b - a).tobytes() + table.tobytes() + text[where[a] : where[b]].tobytes()), None, None, None))
            for a in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[a : a + 256]], schema)

    schema = pa.schema([("bucket", pa.int32()), ("payload", pa.binary()), ("id", pa.int64()), ("key", pa.int64()), ("marks", pa.binary())])
    return run


def _meet(window: int):
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("marks", pa.binary())])

    def settle(payloads: list[bytes]) -> list[tuple[int, int, bytes]]:
        open_, heads, texts = zstandard.ZstdDecompressor(), [], []
        for p in payloads:
            raw = open_.decompress(p)
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            heads.append(np.frombuffer(raw, "<i8", 4 * n, 8).reshape(4, n))
            texts.append(np.frombuffer(raw, np.uint8, -1, 8 + 32 * n))
        ids, keys, begin, length = np.concatenate(heads, axis=1)
        data = np.concatenate(texts)
        found = split(Texts(data, np.array([0, len(data)])))
        words = hashes(data, found.start, found.end)
        first = np.append(0, np.cumsum(length))
        at = window_starts(first, window)
        of = np.searchsorted(first, at, "right") - 1
        start = at - first[of] + begin[of]
        dup = repeated(_rolled(words, window)[at], lambda which: _rolled(words, window, 0x1234567)[at[which]], ids[of], start)
        o, s = of[dup], start[dup]
        by = np.lexsort((s, keys[o], ids[o]))
        o, s = o[by], s[by]
        # Pieces of one text count as one: they are numbered by the first of them.
        pair = np.stack([ids[o], keys[o]], axis=1) if len(o) else np.zeros((0, 2), np.int64)
        new = np.append(True, (pair[1:] != pair[:-1]).any(axis=1)) if len(o) else np.zeros(0, bool)
        text = np.cumsum(new) - 1
        lead = o[new] if len(o) else o
        return _marks(ids[lead], keys[lead], text, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None

        def out(rows):
            for a in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[a : a + 4096]], schema)

        for batch in batches:
            marked = pa.compute.is_valid(batch.column(4))
            done = batch.filter(marked)
            if done.num_rows:
                yield pa.RecordBatch.from_arrays(done.columns[2:], schema=schema)
            sent = batch.filter(pa.compute.invert(marked))
            for b, p in zip(sent.column(0).to_pylist(), sent.column(1).to_pylist(), strict=True):
                if held and b != bucket:
                    yield from out(settle(held))
                    held = []
                bucket = b
                held.append(p)
        if held:
            yield from out(settle(held))

    return run


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """id, key, marks: for each row with windows that also start earlier, runs (first start, number) of those windows, as
    pairs of little-endian longs, possibly in several rows.  id is doc_id as a long, NO_ID for null; key is xxhash64 of
    the text."""
    if window < 2:
        raise ValueError("a window has two words or more")
    n = partitions(docs.sparkSession)
    sent = _keyed(docs, doc_id, text).mapInArrow(_send(window, n * BUCKETS_A_TASK), "bucket int, payload binary, id long, key long, marks binary")
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(window), "id long, key long, marks binary")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(int(NO_ID))).alias("id"), F.xxhash64(whole).alias("key"), whole.alias("__text"), F.col(doc_id).isNull().alias("__none"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, with_text: bool = False) -> DataFrame:
    """A row for each row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one blank) and, if wanted,
    kept_text.

    A word is removed if a window of `window` words that covers it also starts earlier: in a text of smaller doc_id, or
    earlier in the same one.  Windows are judged on the input.  A null text has no words; a text shorter than a window
    keeps all.  Rows without id come last in this order and count as one document's rows; rows of equal id and start do
    not precede each other, so repeated rows keep or lose the same words.  Ids are integers.
    """
    # The packed windows are most of the disk: their shuffle goes before that of the texts begins.
    marks = written(repeats(docs, doc_id, text, window).groupBy("id", "key").agg(F.collect_list("marks").alias("marks")), free=True)
    joined = _keyed(docs, doc_id, text).join(marks, ["id", "key"], "left").select("id", "__text", "marks", "__none")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "__text"):
            found = split(texts)
            lost = np.zeros(len(found.start) + 1, np.int64)
            for k, parts in enumerate(batch.column(2).to_pylist()):
                for part in parts or ():
                    first, n = np.frombuffer(part, "<i8").reshape(-1, 2).T
                    np.add.at(lost, found.first[k] + first, 1)
                    np.add.at(lost, found.first[k] + first + n + window - 1, -1)
            gone = np.append(0, np.cumsum(np.cumsum(lost[:-1]) > 0))
            keep = np.flatnonzero(np.diff(gone) == 0)
            data, at = _pick(texts, found.start[keep], found.end[keep], np.searchsorted(keep, found.first))
            raw = [data[a : max(b - 1, a)].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            ids = pa.compute.if_else(batch.column(3), pa.scalar(None, pa.int64()), batch.column(0))
            columns = [ids, pa.array(np.diff(found.first)), pa.array(np.diff(gone[found.first])), pa.array([hashlib.sha256(r).hexdigest() for r in raw])]
            if with_text:
                columns.append(pa.array([r.decode() for r in raw]))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [doc_id, "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]
    fields = [T.StructField(c, T.LongType()) for c in names[:3]] + [T.StructField(c, T.StringType()) for c in names[3:]]
    return joined.mapInArrow(run, T.StructType(fields))
