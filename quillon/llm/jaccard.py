"""N-gram Jaccard join by chosen paths.

A text's set is the hashes of its runs of five words (of all its words, where it has fewer).  Texts with equal sets are
copies: one of them, that of least id, stands for all.

Chosen paths: at each node of a run, a set takes every one of its tokens whose hash with the node's path is below
1 / (threshold * size), and goes on to that token's child.  Two sets of at least the threshold share more than one such
child on average at each level, so they meet at the second level with more than chance 0.46 a run and at the last with
0.31; runs are repeated until the chance to have met at the last level is the target recall.  Buckets of up to `small` sets are compared by brute force; larger
ones are split on to the next level, and what is still large at the last level is compared in blocks, pair of blocks by
pair of blocks, so no bucket is capped.

Sets are first compared by sketches (one-permutation minima, a byte for each of 128 bins) with a margin of four standard
deviations; buckets yield a spanning forest of what passes, never all pairs.  The components of those links, the groups,
are then compared exactly: the sets of a group's members are made again from the texts and intersected by matrix products
in blocks of `block` sets, which counts every link within the group and yields a spanning forest of exact links, whose
components are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components, local_components
from .tables import partitions, written
from .words import GOLD, U64, blocks, distinct, mix, mix_int, release, shingles, sums, word_hashes

BINS = 128
LEVELS = 4
#: Rows of a table of a few numbers each that a join broadcasts, at most; a larger one is shuffled.
BROADCAST_ROWS = 500_000


def runs_for(recall: float, threshold: float, levels: int = 2) -> int:
    """Runs after which two sets of the threshold have met at that level with chance `recall`, in the worst case, where
    one set holds the other: then they share one child on average."""
    miss = 0.0
    for _ in range(levels):
        miss = math.exp(-(1 - miss))
    return max(1, math.ceil(math.log(1 - recall) / math.log(miss)))


def _paths(tokens: np.ndarray, first: np.ndarray, threshold: float, runs: int) -> list[list[np.ndarray]]:
    """For each level from 2: the set and the path of each chosen node, ordered by set, and its parent's place among the
    nodes of its set one level up (0 at level 2)."""
    size = np.diff(first)
    limit = np.full(len(size), np.iinfo(np.uint64).max, U64)
    big = size * threshold > 1
    limit[big] = (2.0**64 / (size[big] * threshold)).astype(U64)
    found: list[list[list[np.ndarray]]] = [[] for _ in range(LEVELS - 1)]
    counts = np.zeros((LEVELS - 1, len(size)), np.int64)
    full = np.flatnonzero(size)
    for run in range(runs):
        sets, path, place = full, np.full(len(full), mix_int(run + 1), U64), np.zeros(len(full), np.int64)
        for level in range(1, LEVELS + 1):
            n = size[sets]
            of = np.repeat(np.arange(len(sets)), n)
            at = np.arange(len(of)) + np.repeat(first[sets] - (np.cumsum(n) - n), n)
            h = mix(tokens[at] ^ path[of])
            taken = np.flatnonzero(h < limit[sets][of])
            parent, sets, path = place[of[taken]], sets[of[taken]], mix(h[taken] + GOLD)
            if level >= 2:
                seen = counts[level - 2]
                place = seen[sets] + np.arange(len(sets)) - np.searchsorted(sets, sets)
                seen += np.bincount(sets, minlength=len(size))
                found[level - 2].append([sets, path, parent])
            else:
                place = np.zeros(len(sets), np.int64)
    out = []
    for parts in found:
        sets, path, parent = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(sets, kind="stable")
        out.append([sets[order], path[order], parent[order]])
    return out


def sketches(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of bytes for each set: of each bin's least hash, or 0 where no token falls in the bin."""
    h = mix(tokens ^ U64(0x5851F42D4C957F2D))
    cell = np.repeat(np.arange(len(first) - 1), np.diff(first)) * BINS + (h & U64(BINS - 1)).astype(np.int64)
    least = np.full((len(first) - 1) * BINS, np.iinfo(np.uint64).max, U64)
    np.minimum.at(least, cell, h)
    return np.where(least == np.iinfo(np.uint64).max, 0, (least >> U64(8)) % U64(255) + U64(1)).astype(np.uint8).reshape(-1, BINS)


def alike(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether rows of sketches may be of sets of the threshold, up to four standard deviations."""
    same = ((x == y) & (x > 0)).sum(axis=1)
    used = np.maximum(((x > 0) | (y > 0)).sum(axis=1), 1)
    return same >= threshold * used - 4 * np.sqrt(threshold * (1 - threshold) * used)


def _digests(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return sums(mix(tokens), first).view(np.int64), sums(mix(tokens ^ GOLD), first).view(np.int64)


def _sets(batch_texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    found, hashed = word_hashes(batch_texts)
    runs, starts = shingles(hashed, found.first, n)
    tokens, first, _ = distinct(runs, starts)
    return tokens, first


def described(docs: DataFrame, doc_id: str, text: str, threshold: float, runs: int, n: int) -> DataFrame:
    """id, set digest, sketch and chosen paths of each row; a map over partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "__text", 1 << 20):
            tokens, first = _sets(texts, n)
            d1, d2 = _digests(tokens, first)
            sketch = sketches(tokens, first)
            columns = [batch.column(0), pa.array(d1), pa.array(d2), pa.array([r.tobytes() for r in sketch], pa.binary())]
            for sets, path, parent in _paths(tokens, first, threshold, runs):
                where = pa.array(np.searchsorted(sets, np.arange(batch.num_rows + 1)).astype(np.int32))
                columns += [pa.ListArray.from_arrays(where, x) for x in (pa.array(path.view(np.int64)), pa.array(parent.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "d1", "d2", "sketch"] + [f"{x}{level}" for level in range(2, LEVELS + 1) for x in ("path", "up")]
    schema = "id long, d1 long, d2 long, sketch binary, " + ", ".join(f"{x} array<{'long' if x[0] == 'p' else 'int'}>" for x in names[4:])
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def _small(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is counted to be small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _leaves(stand: DataFrame, small: int) -> DataFrame:
    """(key, id, n): the buckets that sets are compared in, of n >= 2 sets each; at most `small`, but at the last level.

    A set's node goes on where its parent's bucket is large.  Each large bucket is one row of that join, so no node goes on
    twice; what goes on is written, as it is both counted and kept."""
    out, large = None, None
    for level in range(2, LEVELS + 1):
        if large is None:
            rows = stand.select("id", F.explode(f"path{level}").alias("key"))
        else:
            up = F.expr(f"transform(up{level}, u -> get(path{level - 1}, u))")
            rows = stand.select("id", F.explode(F.arrays_zip(F.col(f"path{level}").alias("key"), up.alias("up"))).alias("x")).select("id", "x.key", "x.up")
            rows = written(rows.join(_small(large), "up").select("key", "id"))
        counts = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
        fit = counts if level == LEVELS else counts.where(F.col("n") <= small)
        found = rows.join(_small(fit), "key")
        out = found if out is None else out.union(found)
        if level < LEVELS:
            large = counts.where(F.col("n") > small).select(F.col("key").alias("up"))
            if large.isEmpty():
                break
    return out


def _dealt(rows: DataFrame, key: str, n: str, id_: str, block: int) -> DataFrame:
    """rows, each with the pairs of blocks (bi <= bj) of its group that it is compared in; groups of up to `block` rows
    are one block.  Larger ones are cut into blocks of at most `block`, and of down to a quarter of that, so that there is
    a pair of them for each task.  `mine` is the row's own block."""
    spread = math.ceil(math.sqrt(2 * partitions(rows.sparkSession)))
    few, many = F.ceil(F.col(n) / F.lit(block)), F.ceil(F.col(n) * 4 / F.lit(block))
    count = F.when(F.col(n) <= block, 1).otherwise(F.greatest(few, F.least(many, F.lit(spread)))).cast("int")
    rows = rows.withColumn("nb", count).withColumn("mine", F.pmod(F.xxhash64(id_), F.col("nb")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least(F.col("mine"), o).alias("bi"), F.greatest(F.col("mine"), o).alias("bj")))
    return rows.withColumn("pair", F.explode(pairs)).select("*", "pair.bi", "pair.bj").drop("pair", "nb")


def _grouped(rows: DataFrame, keys: list[str], work: Callable, schema: str) -> DataFrame:
    """work(table of whole groups) for the groups of keys; a task holds a run of whole groups at a time."""
    order = [F.col(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(k)[batch.num_rows - 1] for k in range(len(keys))]
            start = batch.num_rows
            same = np.ones(batch.num_rows, bool)
            for k in range(len(keys)):
                same &= batch.column(k).to_numpy(zero_copy_only=False) == last[k].as_py()
            start = int(np.flatnonzero(same)[0])
            if start or (held and any(held[-1].column(k)[0] != last[k] for k in range(len(keys)))):
                whole = pa.Table.from_batches([*held, batch.slice(0, start)], batch.schema)
                yield from work(whole)
                held = []
            held.append(batch.slice(start))
        if held:
            yield from work(pa.Table.from_batches(held))
        release()

    named = rows.select(*keys, *[c for c in rows.columns if c not in keys])
    return named.repartition(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _starts(table: pa.Table, keys: int) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for k in range(keys):
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _sketch_links(threshold: float) -> Callable:
    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        starts = _starts(table, 3)
        bi, bj, mine = (table["bi"].to_numpy(), table["bj"].to_numpy(), table["mine"].to_numpy())
        ids = table["id"].to_numpy()
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)
        size = np.diff(starts)
        lo, hi = [], []
        for n in np.unique(size[(size > 1) & (size <= 64)]):
            i, j = np.triu_indices(n, 1)
            at = starts[:-1][size == n]
            lo.append((at[:, None] + i).ravel())
            hi.append((at[:, None] + j).ravel())
        for g in np.flatnonzero(size > 64):
            i, j = np.triu_indices(size[g], 1)
            lo.append(starts[g] + i)
            hi.append(starts[g] + j)
        if not lo:
            return
        lo, hi = np.concatenate(lo), np.concatenate(hi)
        apart = (mine[lo] != mine[hi]) | (bi[lo] == bj[lo])
        lo, hi = lo[apart], hi[apart]
        near = np.concatenate([alike(sketch[lo[k : k + 50_000]], sketch[hi[k : k + 50_000]], threshold) for k in range(0, len(lo), 50_000)] or [np.zeros(0, bool)])
        known, node = np.unique(ids, return_inverse=True)
        label = local_components(node[lo[near]], node[hi[near]], len(known))
        linked = np.flatnonzero(label != np.arange(len(known)))
        yield pa.RecordBatch.from_arrays([pa.array(known[linked]), pa.array(known[label[linked]])], ["a", "b"])

    return work


def _exact_links(threshold: float) -> Callable:
    def one(ids, copies, mine, cross, sets) -> tuple[np.ndarray, np.ndarray]:
        """Links of each set, by copies, and the least set of each one's component."""
        n = len(ids)
        size = np.array([len(s) for s in sets], np.float64)
        flat = np.concatenate(sets) if n else np.zeros(0, U64)
        of = np.repeat(np.arange(n), size.astype(np.int64))
        _, token, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[token] > 1
        rank = np.cumsum(times > 1) - 1
        token, of = rank[token[shared]], of[shared]
        both = np.zeros((n, n))
        order = np.argsort(token, kind="stable")
        token, of = token[order], of[order]
        for c in range(0, int(rank[-1]) + 1 if len(rank) else 0, 4096):
            a, b = np.searchsorted(token, [c, c + 4096])
            m = np.zeros((n, 4096), np.float32)
            m[of[a:b], token[a:b] - c] = 1
            both += m @ m.T
        near = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
        np.fill_diagonal(near, False)
        if cross:
            near &= mine[:, None] != mine[None, :]
        i, j = np.nonzero(np.triu(near))
        return near @ copies, local_components(i, j, n)

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        starts = _starts(table, 3)
        ids, copies, mine = (table[c].to_numpy() for c in ("id", "copies", "mine"))
        bi, bj = table["bi"].to_numpy(), table["bj"].to_numpy()
        sets = table["tokens"]
        a, b, links = [], [], []
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            _, keep = np.unique(ids[s:e], return_index=True)
            keep = s + keep
            own = [np.frombuffer(sets[int(k)].as_py(), U64) for k in keep]
            count, label = one(ids[keep], copies[keep], mine[keep], bi[s] != bj[s], own)
            a.append(ids[keep])
            b.append(ids[keep][label])
            links.append(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(links).astype(np.int64))], ["a", "b", "links"])

    return work


def _members_sets(docs: DataFrame, doc_id: str, text: str, n: int, ids: DataFrame) -> DataFrame:
    """id, d1, d2, tokens of the rows whose id may be in ids: those whose bit is set in a map of hashed ids.

    The map has 8 bits or more for each id, and at most 2**28 (32 MB), so it is broadcast; where ids outnumber that, more
    rows pass, and the join that follows drops them."""
    bits = min(max(1 << 18, 1 << (8 * max(ids.count(), 1) - 1).bit_length()), 1 << 28)
    spot = F.pmod(F.xxhash64("id"), F.lit(bits))
    parts = ids.select(F.floor(spot / 32768).cast("long").alias("part"), F.pmod(spot, F.lit(32768)).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("map")).collect()
    whole = np.zeros((bits >> 15, 4096), np.uint8)
    for r in parts:
        whole[r["part"]] = np.frombuffer(r["map"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(np.unpackbits(whole.ravel(), bitorder="little") if bits <= 1 << 23 else whole.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            at = batch.column(1).to_numpy()
            may = known[at] > 0 if len(known) == bits else known[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
            for part, texts in blocks(iter([batch.filter(pa.array(may))]), "__text", 1 << 20):
                flat, first = _sets(texts, n)
                d1, d2 = _digests(flat, first)
                cut = pa.array([flat[first[k] : first[k + 1]].tobytes() for k in range(part.num_rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(d1), pa.array(d2), cut], ["id", "d1", "d2", "tokens"])

    read = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("__text")).where("id IS NOT NULL")
    return read.select("id", spot.alias("at"), "__text").mapInArrow(run, "id long, d1 long, d2 long, tokens binary")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, recall: float = 0.999, n: int = 5, small: int = 128, block: int = 256) -> DataFrame:
    """A row for each row of docs: doc_id, class_id (the least doc_id of its class) and n_links (how many other rows have
    similarity of at least the threshold with it, copies included).

    A null text counts as empty; texts without words are copies of each other and of no other.  Rows that repeat an id
    count as separate texts.  A row without id has no class_id unless a copy of it has an id, and is not compared beyond
    its copies.  No rows, no rows.  Ids are integers.
    """
    runs = runs_for(recall, threshold, LEVELS)
    made = written(described(docs, doc_id, text, threshold, runs, n))
    copies = written(made.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    paths = [c for c in made.columns if c.startswith(("path", "up"))]
    stand = written(made.join(copies.where("id IS NOT NULL").select("id", "d1", "d2"), ["id", "d1", "d2"], "left_semi").dropDuplicates(["id", "d1", "d2"]).select("id", "sketch", *paths))
    leaves = written(_leaves(stand, small))
    ids = _small(written(leaves.select("id").distinct()))
    members = leaves.join(written(stand.select("id", "sketch").join(ids, "id", "left_semi")), "id")
    near = _grouped(_dealt(members, "key", "n", "id", 4 * block).drop("n"), ["key", "bi", "bj"], _sketch_links(threshold), "a long, b long")
    groups = written(components(near))
    sized = groups.join(groups.groupBy("component").agg(F.count("*").alias("n")), "component").select(F.col("node").alias("id"), "component", "n")
    chosen = written(sized.join(copies, "id"))

    sets = _members_sets(docs, doc_id, text, n, chosen.select("id")).join(_small(chosen), ["id", "d1", "d2"])
    sets = sets.select("id", "component", "n", "copies", "tokens")
    compared = written(_grouped(_dealt(sets, "component", "n", "id", block).drop("n"), ["component", "bi", "bj"], _exact_links(threshold), "a long, b long, links long"))
    found = components(compared.select("a", "b"))
    links = compared.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    per_set = copies.join(found.select(F.col("node").alias("id"), "component"), "id", "left").join(links, "id", "left")
    per_set = written(per_set.select("d1", "d2", F.coalesce("component", "id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    return made.select("id", "d1", "d2").join(per_set, ["d1", "d2"]).select(F.col("id").alias(doc_id), "class_id", "n_links")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs, all columns, without the documents that are not the first (by id) of their class.  Rows that repeat the id
    of a document that stays are one document; rows without id stay."""
    found = classes(docs, doc_id, text, **options).where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id"))
    found = written(found.agg(F.bool_or(F.col(doc_id) == F.col("class_id")).alias("__first"), F.count("*").alias("__n")).where("NOT __first OR __n > 1"))
    # Only what goes, or stands several times, is joined with the texts: by broadcast, if it is counted to be small.
    others = docs.join(_small(found.select("__id")), docs[doc_id] == F.col("__id"), "left_anti")
    again = found.where("__first").select("__id")
    if again.isEmpty():
        return others
    return others.union(docs.join(again, docs[doc_id] == F.col("__id"), "left_semi").dropDuplicates([doc_id]))
