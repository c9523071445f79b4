"""Language-model scoring: a Katz backoff bigram model of the corpus, and the log10 probability of every text.

Tokens are words (lower-case A-Z) and one end for each text; a text's first token has a start as its context.  Counts
are of the training rows.  Counts r of 1 to 5 are discounted by Good-Turing estimates from the numbers n_r of n-grams
that occur r times; larger ones are kept.  The probability of a token w after h is evaluated recursively:

    P(w | h) = d_r r / c(h)          if h w occurs r > 0 times
               a(h) P(w)             if not, and h occurs
               P(w)                  if h does not occur
    P(w)     = d_c c(w) / N          if w occurs, and else the mass that all unknown words share

a(h) = (1 - sum of P(w | h) over seen w) / (1 - sum of P(w) over seen w), so each context's probabilities sum to 1.  A
context all of whose counts are above 5 would leave nothing: its counts are taken over c(h) + 1.

How it runs: texts are cut into blocks and written once as word numbers with the block's vocabulary.  Vocabularies are
dealt to buckets by ranges of word hash, which add up the counts (the unigram table, written by bucket) and return them.
Each block then sends its distinct bigrams, with the documents that hold them, to buckets by context; contexts of more
than a fair share of all tokens are spread by their words too.  A bucket holds all counts of its bigrams, and returns for
each document a sum and what its backed-off tokens still need: the discounts are only known when all buckets are done.
A bigram that very many documents of a block hold is sent without them, once; they stay with the block.

Words are known by 64-bit hashes until they are counted, and then by numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .tables import partitions, work_dir, written
from .words import U64, blocks, mix, mix_int, release, word_hashes

MOST = 5
BLOCK = 6 << 20
#: Documents of a block that hold the same bigram and are named to its bucket, at most.
NAMED = 48
#: Buckets of bigrams for each task; a task works on one at a time.
BUCKETS_A_TASK = 4
END, START = U64(mix_int(0xE0D)), U64(mix_int(0x57A47))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes: whole numbers in the least width that holds them, all first bytes before all second
    ones and so on, which leaves the upper ones easy to compress."""
    head, body = [len(arrays)], []
    for a in arrays:
        if a.dtype != np.float64:
            top = int(a.max()) if len(a) else 0
            a = a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))
            head += [len(a), a.itemsize]
            body.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
        else:
            head += [len(a), -8]
            body.append(a.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(np.array(head, "<i8").tobytes() + b"".join(body))


def unpack(data: bytes) -> list[np.ndarray]:
    """What pack() was given; whole numbers as int64, or as uint64 where they needed eight bytes."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2).tolist()
    out, at = [], 8 + 16 * n
    for size, width in head:
        if width < 0:
            a = np.frombuffer(raw, np.float64, size, at)
        else:
            planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
            a = np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()
            a = a if width == 8 else a.astype(np.int64)
        out.append(a)
        at += size * abs(width)
    return out


class Discounts(NamedTuple):
    """d[r] for r = 0 .. 5 (d[0] unused), from how often counts of 1 .. 6 occur."""

    d: np.ndarray

    @staticmethod
    def of(n: list[int]) -> Discounts:
        """n[r] is the number of n-grams that occur r times, r up to 6.  Where these do not give discounts between 0 and
        1, each r is less a constant D = n_1 / (n_1 + 2 n_2), or 1/2 where n_1 or n_2 is 0."""
        d = np.ones(MOST + 1)
        common = (MOST + 1) * n[MOST + 1] / n[1] if n[1] else 1.0
        if all(n[1 : MOST + 1]) and common < 1:
            good = np.array([((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, MOST + 1)])
            if ((good > 0) & (good < 1)).all():
                d[1:] = good
                return Discounts(d)
        less = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d[1:] = [(r - less) / r for r in range(1, MOST + 1)]
        return Discounts(d)

    def times(self, c: np.ndarray) -> np.ndarray:
        return np.where(c <= MOST, self.d[np.minimum(c, MOST)], 1.0) * c


class Unigrams(NamedTuple):
    """Totals of the training tokens and the probability of a word by its count."""

    tokens: int
    distinct: int
    texts: int
    discounts: Discounts
    kept: float

    @staticmethod
    def of(tokens: int, distinct: int, texts: int, n: list[int]) -> Unigrams:
        d = Discounts.of(n)
        less = sum((1 - d.d[r]) * r * n[r] for r in range(1, MOST + 1))
        return Unigrams(tokens, distinct, texts, d, tokens if less else tokens + 1.0)

    def unknown(self, n: list[int]) -> float:
        less = sum((1 - self.discounts.d[r]) * r * n[r] for r in range(1, MOST + 1))
        return (less or 1.0) / self.kept

    def probability(self, c: np.ndarray, unknown: float) -> np.ndarray:
        return np.where(c > 0, self.discounts.times(c) / self.kept, unknown)


def _blocks_table(docs: DataFrame, doc_id: str, text: str, held_out: Column) -> DataFrame:
    """block, ids, held, first (where texts begin in tokens), vocabulary (sorted hashes), tokens (numbers in it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 32, 0
        for batch, texts in blocks(batches, "__text", BLOCK):
            found, hashed = word_hashes(texts, lower=True)
            count = np.diff(found.first)
            first = found.first + np.arange(len(found.first))
            flat = np.full(first[-1], END, U64)
            flat[np.arange(len(hashed)) + np.repeat(np.arange(len(count)), count)] = hashed
            vocabulary, number = np.unique(flat, return_inverse=True)
            ids = batch.column(0).fill_null(0).to_numpy().view(U64)
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = [base + k, pack(ids, held, first, none), pack(vocabulary), pack(number)]
            k += 1
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["block", "texts", "vocabulary", "tokens"])

    read = docs.select(F.col(doc_id).cast("long").alias("__id"), F.coalesce(held_out, F.lit(False)).alias("__held"), F.col(text).cast("string").alias("__text"))
    return read.mapInArrow(run, "block long, texts binary, vocabulary binary, tokens binary")


def _ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of hashes begins in sorted keys."""
    edges = np.array([(k << 64) // n for k in range(n)], U64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def _row(kind: int, block: int = 0, bucket: int = 0, data: bytes = b"") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int64()), pa.array([bucket], pa.int64()), pa.array([data], pa.binary())], ["kind", "block", "bucket", "data"])


ROWS = "kind int, block long, bucket long, data binary"
RETURN, TABLE, STATS, HOT, SUMS, TEXTS = range(6)


def _by_bucket(work: Callable[[int, list[int], list[bytes]], Iterator[pa.RecordBatch]]):
    """work(bucket, blocks, payloads) for each bucket of rows that are sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, whose, held = None, [], []
        for batch in batches:
            for bucket, block, data in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                if held and bucket != at:
                    yield from work(at, whose, held)
                    whose, held = [], []
                at = bucket
                whose.append(block)
                held.append(data)
        if held:
            yield from work(at, whose, held)
        release()

    return run


def _send_words(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts, vocabulary, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (_, held, first, _), (keys,), (number,) = unpack(texts), unpack(vocabulary), unpack(tokens)
                train = np.repeat(held == 0, np.diff(first))
                counts = np.bincount(number[train], minlength=len(keys))
                at = _ranges(keys, n)
                full = [b for b in range(n) if at[b] < at[b + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([block] * len(full), pa.int64()), pa.array([pack(keys[at[b] : at[b + 1]], counts[at[b] : at[b + 1]]) for b in full], pa.binary())], ["bucket", "block", "data"])

    return run


def _count_words(bucket: int, whose: list[int], payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
    parts = [unpack(p) for p in payloads]
    keys, number = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.bincount(number, np.concatenate([p[1] for p in parts]).astype(np.float64), len(keys)).astype(np.int64)
    rank = np.empty(len(keys), np.int64)
    rank[np.lexsort((keys, -counts))] = np.arange(len(keys))
    at = 0
    for block, (own, _) in zip(whose, parts, strict=True):
        mine = number[at : at + len(own)]
        yield _row(RETURN, block, bucket, pack(counts[mine], rank[mine]))
        at += len(own)
    seen = counts > 0
    yield _row(TABLE, 0, bucket, pack(keys[seen], counts[seen]))
    ends = counts[keys == END].sum()
    yield _row(STATS, 0, bucket, np.array([*(int((counts == r).sum()) for r in range(1, MOST + 2)), counts.sum(), seen.sum(), ends], "<i8").tobytes())


def _stats(rows: DataFrame) -> np.ndarray:
    """The sum of the buckets' statistics: as many rows as buckets, of a few numbers each."""
    found = rows.where(F.col("kind") == STATS).select("data").collect()
    return sum((np.frombuffer(r.data, "<i8") for r in found), np.zeros(MOST + 4, np.int64))


def _send_bigrams(words: Unigrams, unknown: float, word_buckets: int, n: int):
    hot = words.tokens / (4 * n)

    def one(block: int, texts: bytes, vocabulary: bytes, tokens: bytes, counted: list) -> Iterator[pa.RecordBatch]:
        (ids, held, first, none), (keys,), (number,) = unpack(texts), unpack(vocabulary), unpack(tokens)
        counted = sorted(counted, key=lambda x: x["bucket"])
        back = [unpack(x["data"]) for x in counted]
        count = np.concatenate([c for c, _ in back])
        # A number for each word of the corpus, from its bucket and its rank there: low for frequent words; 0 is the start.
        word = np.concatenate([*[rank * word_buckets + x["bucket"] + 1 for x, (_, rank) in zip(counted, back, strict=True)], [0]])
        size = np.diff(first)
        of = np.repeat(np.arange(len(size)), size)
        c = count[number]
        sums = lambda v: np.bincount(of, v, len(size))
        base = sums(np.log10((c + 1) / (words.tokens + words.distinct + 1)))
        known = sums((c > 0).astype(np.float64)).astype(np.int64)
        before = np.empty(len(number), np.int64)
        before[1:] = number[:-1]
        before[first[:-1]] = len(keys)
        context_count = np.append(count, words.texts)
        # After a context that never occurs, the word's own probability is the answer.
        lone = context_count[before] == 0
        direct = sums(np.where(lone, np.log10(words.probability(c, unknown)), 0.0))
        pick = np.flatnonzero(~lone)
        pair = before[pick] * (len(keys) + 1) + number[pick]
        order = np.argsort(pair, kind="stable")
        pair, doc = pair[order], of[pick][order]
        new = np.append(True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])) if len(pair) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(pair)))
        pair, doc = pair[at], doc[at]
        gram = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else at
        holders = np.diff(np.append(gram, len(pair)))
        trained = np.add.reduceat(np.where(held[doc] == 0, times, 0), gram) if len(gram) else gram
        h, w = pair[gram] // (len(keys) + 1), pair[gram] % (len(keys) + 1)
        # Bigrams of very many documents are sent as one further document each, which stands for its list here.
        many = holders > NAMED
        stay = np.repeat(many, holders)
        lists = (doc[stay], times[stay], holders[many])
        stands = len(size) + np.cumsum(many) - 1
        named = np.where(many, 1, holders)
        to = np.append(0, np.cumsum(named))
        keep = ~stay
        first_of = np.zeros(len(pair), bool)
        first_of[gram[many]] = True
        doc = np.where(first_of, np.repeat(stands, holders), doc)[keep | first_of]
        times = np.where(first_of, 1, times)[keep | first_of]
        yield _row(TEXTS, block, int(block % n), pack(ids, held, size, known, base, direct, *lists, np.array([words.tokens]), none))
        hashes = np.append(keys, START)
        ch = context_count[h]
        bucket = (mix(hashes[h] ^ np.where(ch > hot, mix(hashes[w]), U64(0))) % U64(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(n + 1))
        for b in range(n):
            g = order[edge[b] : edge[b + 1]]
            if not len(g):
                continue
            hb = h[g]
            lead = np.flatnonzero(np.append(True, hb[1:] != hb[:-1]))
            span = named[g]
            where = np.repeat(to[g] - (np.cumsum(span) - span), span) + np.arange(span.sum())
            yield _row(-1, block, b, pack(word[hb[lead]], ch[g][lead], np.diff(np.append(lead, len(g))), word[w[g]], count[w[g]], trained[g], span, doc[where], times[where]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from one(*row)
        release()

    return run


def _score_bigrams(words: Unigrams, unknown: float, n: int):
    hot = words.tokens / (4 * n)

    Parts = dict[int, list[tuple]]

    def work(bucket: int, whose: list[int], payloads: list[bytes], parts_of: Parts) -> Iterator[pa.RecordBatch]:
        parts = [unpack(p) for p in payloads]
        h = np.concatenate([np.repeat(p[0], p[2]) for p in parts])
        ch = np.concatenate([np.repeat(p[1], p[2]) for p in parts])
        w, cw, trained = (np.concatenate([p[k] for p in parts]) for k in (3, 4, 5))
        order = np.lexsort((w, h))
        new = np.append(True, (h[order[1:]] != h[order[:-1]]) | (w[order[1:]] != w[order[:-1]]))
        lead = order[np.flatnonzero(new)]
        group = np.empty(len(h), np.int64)
        group[order] = np.cumsum(new) - 1
        r = np.bincount(group, trained, len(lead)).astype(np.int64)
        turn = np.append(True, h[lead[1:]] != h[lead[:-1]])
        context = np.cumsum(turn) - 1
        head = lead[turn]
        seen = r > 0
        total = np.bincount(context, np.where(seen, words.probability(cw[lead], unknown), 0.0), len(head))
        hist = np.stack([np.bincount(context, r == k, len(head)) for k in range(1, MOST + 1)], axis=1).astype(np.int64)
        is_hot = ch[head] > hot
        yield _row(STATS, 0, bucket, np.array([*(int((r == k).sum()) for k in range(1, MOST + 2)), 0, 0, 0], "<i8").tobytes())
        if is_hot.any():
            yield _row(HOT, 0, bucket, pack(h[head][is_hot], ch[head][is_hot], *hist[is_hot].T, total[is_hot]))
        rg, cg = r[group], context[group]
        bare = (hist.sum(axis=1) == 0) & ~is_hot
        value = np.where(rg > 0, np.log10(np.maximum(rg, 1) / (ch + bare[cg])), np.log10(words.probability(cw, unknown)))
        at = 0
        for block, p in zip(whose, parts, strict=True):
            g = np.repeat(np.arange(at, at + len(p[6])), p[6])
            at += len(p[6])
            docs, number = np.unique(p[7], return_inverse=True)
            times = p[8]
            add = lambda v, number=number, k=len(docs): np.bincount(number, v, k)
            low = [add(np.where(rg[g] == k, times, 0)).astype(np.int64) for k in range(1, MOST + 1)]
            # What depends on a context as a whole: tokens backed off from it, and, of a hot one, tokens seen after it.
            ask = np.flatnonzero((rg[g] == 0) | is_hot[cg[g]])
            code = (number[ask] * len(head) + cg[g[ask]]) * 2 + (rg[g[ask]] > 0)
            code, back = np.unique(code, return_inverse=True)
            many = np.bincount(back, times[ask], len(code)).astype(np.int64)
            asked, which = np.unique(code // 2 % len(head), return_inverse=True)
            table = (h[head][asked], ch[head][asked], *hist[asked].T, total[asked], is_hot[asked].astype(np.int64))
            parts_of.setdefault(block, []).append(((docs, add(value[g] * times), *low), (docs[code // 2 // len(head)], which, code % 2, many), table))

    def added(parts: list[tuple]) -> bytes:
        """A task's results for a block, of all its buckets, as one."""
        sums, asks, tables = zip(*parts, strict=True)
        docs, number = np.unique(np.concatenate([x[0] for x in sums]), return_inverse=True)
        value, *low = (np.bincount(number, np.concatenate([x[k] for x in sums]), len(docs)) for k in range(1, MOST + 2))
        before = np.cumsum([0, *[len(t[0]) for t in tables]])
        who, which, seen, many = (np.concatenate([x[k] + (before[i] if k == 1 else 0) for i, x in enumerate(asks)]) for k in range(4))
        table = [np.concatenate([t[k] for t in tables]) for k in range(len(tables[0]))]
        return pack(docs, value, *[x.astype(np.int64) for x in low], np.searchsorted(docs, who), which, seen, many, *table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_of: Parts = {}
        rest: list[pa.RecordBatch] = []

        def sent() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = pa.array(batch.column(3).to_numpy() == TEXTS)
                rest.append(batch.filter(own))
                yield batch.filter(pa.compute.invert(own))

        def through() -> Iterator[pa.RecordBatch]:
            while rest:
                part = rest.pop()
                yield pa.RecordBatch.from_arrays([part.column(3), part.column(1), part.column(0), part.column(2)], ["kind", "block", "bucket", "data"])

        for out in _by_bucket(lambda bucket, whose, payloads: work(bucket, whose, payloads, parts_of))(sent()):
            yield out
            yield from through()
        yield from through()
        for block, parts in parts_of.items():
            yield _row(SUMS, block, 0, added(parts))

    return run


def _backoff(d: Discounts, ch: np.ndarray, hist: list[np.ndarray], total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 a(h), and whether no count of the context is discounted."""
    less = sum((1 - d.d[k + 1]) * (k + 1) * n for k, n in enumerate(hist)) + np.zeros(len(ch))
    bare = less <= 0
    left = np.where(bare, 1 / (ch + 1.0), less / ch)
    return np.log10(left) - np.log10(np.maximum(1 - total, 1e-15)), bare


HOT_SUMS = [*(f"n{k}" for k in range(1, MOST + 1)), "total"]
_HOT = "h long, ch long, " + ", ".join(f"{c} {'double' if c == 'total' else 'long'}" for c in HOT_SUMS)


def _hot_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            *whole, total = unpack(data)
            yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in whole), pa.array(total)], ["h", "ch", *HOT_SUMS])


def _finish(d: Discounts, hot: dict[int, tuple[float, bool]]):
    def work(block: int, kinds: list[int], payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, held, size, known, base, direct, doc, times, holders, tokens, none = unpack(payloads[kinds.index(TEXTS)])
        score = np.zeros(len(size) + len(holders))
        score[: len(size)] = direct
        for kind, data in zip(kinds, payloads, strict=True):
            if kind != SUMS:
                continue
            p = unpack(data)
            docs, value, low = p[0], p[1], p[2 : 2 + MOST]
            number, which, seen, many, h, ch = p[2 + MOST : 8 + MOST]
            hist, total, is_hot = p[8 + MOST : 8 + 2 * MOST], p[8 + 2 * MOST], p[9 + 2 * MOST]
            value = value + sum(n * np.log10(d.d[k + 1]) for k, n in enumerate(low))
            back, _ = _backoff(d, ch, hist, total)
            fix = np.zeros(len(ch))
            for k in np.flatnonzero(is_hot):
                back[k], undiscounted = hot[int(h[k])]
                fix[k] = np.log10(ch[k] / (ch[k] + 1.0)) if undiscounted else 0.0
            extra = many * np.where(seen > 0, fix[which], back[which])
            score[docs] += value + np.bincount(number, extra, len(docs))
        if len(holders):
            score[: len(size)] += np.bincount(doc, times * np.repeat(score[len(size) :], holders), len(size))
        i = ids.view(np.int64) if ids.dtype == U64 else ids
        n = len(size)
        yield pa.RecordBatch.from_arrays([pa.array(i, mask=none > 0), pa.array(held > 0), pa.array(size), pa.array(known), pa.array(np.full(n, tokens[0])), pa.array(base), pa.array(score[:n])], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _by_bucket(work)


def _counted(corpus: DataFrame, n: int) -> DataFrame:
    """What the buckets of words and bigrams say of each block of the corpus, written."""
    sent = corpus.mapInArrow(_send_words(n), "bucket long, block long, data binary")
    counted = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_by_bucket(_count_words), ROWS)
    counted = written(counted, "uncompressed")
    stats = _stats(counted)
    hist = [0, *stats[: MOST + 1].tolist()]
    words = Unigrams.of(int(stats[MOST + 1]), int(stats[MOST + 2]), int(stats[MOST + 3]), hist)
    unknown = words.unknown(hist)
    back = counted.where(F.col("kind") == RETURN).groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias("counted"))
    m = n * BUCKETS_A_TASK
    grams = corpus.join(back, "block").mapInArrow(_send_bigrams(words, unknown, n, m), ROWS)
    grams = grams.select("bucket", "block", "data", "kind").repartition(n, "bucket").sortWithinPartitions("bucket", "block")
    return written(grams.mapInArrow(_score_bigrams(words, unknown, m), ROWS), "uncompressed")


def scores(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row: doc_id, held_out, n_tokens, n_known (of a word that occurs in training), train_tokens,
    base_score (add-one unigram log10 probability) and score (the Katz model's log10 probability).

    held_out: rows that the model does not learn from; null counts as false.  A null text counts as empty: its end is its
    one token.  Repeated rows count as often as they stand there.  Without training rows every token has probability 1
    as the one unknown word.  Ids are integers.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    corpus = _blocks_table(docs, doc_id, text, held_out)
    name = f"quillon_blocks_{work_dir(spark).rsplit('-', 1)[1]}"
    corpus.write.bucketBy(n, "block").option("path", work_dir(spark)).option("compression", "uncompressed").saveAsTable(name)
    try:
        done = _counted(spark.table(name).select("block", "texts", "vocabulary", "tokens"), n)
    finally:
        spark.sql(f"DROP TABLE {name}")
    d = Discounts.of([0, *_stats(done)[: MOST + 1].tolist()])
    # Hot contexts have more than 1 / (4 m) of all tokens each, so there are fewer than 4 m + 1; their parts in the buckets
    # are added up by executors.
    rows = done.where(F.col("kind") == HOT).select("data").mapInArrow(_hot_parts, _HOT).groupBy("h", "ch").agg(*(F.sum(c).alias(c) for c in HOT_SUMS)).collect()
    hot = {}
    for r in rows:
        log, bare = _backoff(d, np.array([r["ch"]]), [np.array([r[f"n{k}"]]) for k in range(1, MOST + 1)], np.array([r["total"]]))
        hot[r["h"]] = (float(log[0]), bool(bare[0]))
    last = done.where(F.col("kind").isin(SUMS, TEXTS)).select("block", F.col("kind").cast("long").alias("kind"), "data")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = last.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_finish(d, hot), schema)
    return out.withColumnRenamed("doc_id", doc_id)
