"""Heavy hitters by a Count-Min sketch, and by the built-in estimator."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import hashed, positions
from ..functions.params import CountMinParams
from ..plans.ordered import folded
from ..sources.states import State
from . import countmin


def candidates(df: DataFrame, col: str, state: State, k: int) -> DataFrame:
    """obj, n: the k distinct values of df with the highest estimates by the sketch, ties by the larger value."""
    if k < 1:
        raise ValueError("k must be greater than 0")
    scored = countmin.query(state, df, col, "n").withColumnRenamed(col, "obj")
    return scored.orderBy(F.desc("n"), F.desc("obj")).limit(k)


def top_k(df: DataFrame, col: str, params: CountMinParams, k: int) -> DataFrame:
    """candidates() by the sketch of df itself, in ascending order.  This scores every distinct value at the end, so it
    does not depend on the order of rows; top_k_sequentially() does what a bounded heap does."""
    return candidates(df, col, countmin.build(df, col, params), k).orderBy("n", "obj")


def merged_top_k(a: DataFrame, sketch_a: State, b: DataFrame, sketch_b: State, k: int) -> tuple[DataFrame, State]:
    """Of two sets of candidates (obj, n): the sketches are added, and all candidates scored anew."""
    both = countmin.merge(sketch_a, sketch_b)
    return candidates(a.select("obj").union(b.select("obj")), "obj", both, k), both


class Heap:
    """At most k objects with exact counters since they came in; a newcomer needs a higher estimate than the least."""

    def __init__(self, k: int):
        self.k, self.n = k, {}

    def add(self, obj, estimate: int) -> None:
        if obj in self.n:
            self.n[obj] += 1
        elif len(self.n) < self.k:
            self.n[obj] = 1
        else:
            least = min(self.n, key=lambda o: (self.n[o], o))
            if estimate > self.n[least]:
                del self.n[least]
                self.n[obj] = estimate


class _Fold:
    """A heap and a sketch, fed a batch of rows (group, seq, obj, at) at a time."""

    def __init__(self, params: CountMinParams, k: int):
        self.heap, self.last = Heap(k), None
        self.cells = np.zeros((params.d, params.w), np.int64)

    def add(self, batch: pa.RecordBatch) -> None:
        self.last = batch.slice(0, 1)
        at = batch.column("at").flatten().to_numpy().reshape(batch.num_rows, -1)
        estimates = np.min([_added(cells, at[:, i]) for i, cells in enumerate(self.cells)], axis=0)
        for obj, estimate in zip(batch.column("obj").to_pylist(), estimates.tolist(), strict=True):
            self.heap.add(obj, estimate)

    def end(self) -> pa.RecordBatch:
        n = self.heap.n
        found = sorted(n, key=lambda o: (n[o], o))
        group, kind = self.last.column("group"), self.last.column("obj").type
        ranks = pa.array(range(1, len(found) + 1), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(group.to_pylist() * len(found), group.type), ranks, pa.array(found, kind)], ["group", "rank", "obj"])


def _added(cells: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What a row of a sketch's cells holds at each place of at once that place is counted, one after the other."""
    order = np.argsort(at, kind="stable")
    placed = at[order]
    first = np.flatnonzero(np.append(True, placed[1:] != placed[:-1]))
    sizes = np.diff(np.append(first, len(placed)))
    counts = np.empty_like(order)
    counts[order] = cells[placed] + np.arange(1, len(placed) + 1) - np.repeat(first, sizes)
    cells[placed[first]] += sizes
    return counts


def top_k_sequentially(df: DataFrame, col: str, seq: str, group: str, params: CountMinParams, k: int) -> DataFrame:
    """group, rank (from the least), obj: a heap and a sketch for each group, fed row by row in the order of seq.  One task
    reads a group, a batch at a time."""
    rows = df.where(F.col(col).isNotNull()).select(F.col(group).cast("string").alias("group"), F.col(seq).alias("seq"), F.col(col).alias("obj"), positions(col, params.w, params.d, params.family).alias("at"))
    return folded(rows, lambda: _Fold(params, k), f"group string, rank int, obj {dict(df.dtypes)[col]}")


def _part(col: str, n: int) -> Column:
    return F.pmod(hashed(col), F.lit(n)).alias("__part")


def _parts(df: DataFrame, col: str, max_items: int) -> int:
    """Into how many parts by hash the values of df are to be dealt, so that none has more than max_items distinct ones.
    The first try aims at half of that by an estimate; the parts are then counted exactly."""
    n = max(1, math.ceil(2 * df.agg(F.approx_count_distinct(col)).first()[0] / max_items))
    while True:
        sizes = df.select(F.col(col), _part(col, n)).distinct().groupBy("__part").count()
        most = sizes.agg(F.max("count")).first()[0] or 0
        if most <= max_items:
            return n
        n *= math.ceil(2 * most / max_items)


def approx_top_k(df: DataFrame, col: str, k: int, max_items: int = 10_000) -> DataFrame:
    """obj, n by the built-in sketch, ties by the larger value.  A sketch counts up to max_items distinct values exactly,
    and of more it may return too few or none; so the values are dealt by hash to as many sketches as that takes, and the
    highest of all are kept.  NULL counts as a value, as it does for the built-in sketch."""
    found = df.groupBy(_part(col, _parts(df, col, max_items))).agg(F.expr(f"approx_top_k({col}, {int(k)}, {int(max_items)})").alias("x"))
    found = found.select(F.explode("x").alias("x")).select(F.col("x.item").alias("obj"), F.col("x.count").alias("n"))
    return found.orderBy(F.desc("n"), F.desc("obj")).limit(k)
