"""Cuckoo filters as a multiset of (fingerprint, unordered pair of buckets).

Two stored copies with equal fingerprints meet in a bucket only if they have the same pair, as the partner of a bucket is
that bucket xor a hash of the fingerprint; so membership, deletion, length and union need no slots.  Slots only decide
whether a filter is full.  `insert_sequentially` places copies slot by slot, with random kicks, where that is asked.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import hashed, whole
from ..functions.params import CuckooParams
from ..plans.ordered import folded
from ..sources.states import State, check_same

#: How often a copy is moved on before a filter counts as full.
MAX_KICKS = 500
KEY = ["fp", "b_lo", "b_hi"]


class CuckooFilterFull(Exception):
    """No room for an element; the state from before stays as it was."""


def fingerprint(col: str | Column, params: CuckooParams) -> Column:
    """1 + hash mod (2^l - 1), never 0; of 64 bits, the upper one is the sign."""
    bits = params.l_fingerprint
    if bits < 64:
        return F.pmod(hashed(col, 0, params.family), F.lit((1 << bits) - 1)) + 1
    h = whole(col, 0, params.family)
    return F.when(h == -1, F.lit(1)).when(h == (1 << 63) - 1, F.lit(-(1 << 63))).otherwise(h + 1)


def keyed(df: DataFrame, col: str, params: CuckooParams) -> DataFrame:
    """df with fp, i1, b_lo, b_hi; NULLs where col is NULL."""
    mask = F.lit(params.n_buckets - 1)
    out = df.withColumn("fp", fingerprint(col, params)).withColumn("i1", hashed(col, 1, params.family).bitwiseAND(mask))
    out = out.withColumn("__i2", F.col("i1").bitwiseXOR(hashed("fp", 1, params.family).bitwiseAND(mask)))
    return out.withColumn("b_lo", F.least("i1", "__i2")).withColumn("b_hi", F.greatest("i1", "__i2")).drop("__i2")


def _checked(state: State) -> State:
    """Raise if the copies cannot fit: more than all slots, or more of one key than its two buckets hold."""
    p = state.params
    room = F.when(F.col("b_lo") == F.col("b_hi"), p.bucketsize).otherwise(2 * p.bucketsize)
    found = state.table.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n"), F.max(F.col("cnt") > room).alias("over")).first()
    if found["n"] > p.bucketsize * p.n_buckets or found["over"]:
        raise CuckooFilterFull("the filter is full")
    return state


def build(df: DataFrame, col: str, params: CuckooParams, type_tag: str = "any", check: bool = True) -> State:
    """fp, b_lo, b_hi, cnt of all values that are not NULL; repeated values are stored again."""
    rows = keyed(df.where(F.col(col).isNotNull()), col, params)
    state = State(rows.groupBy(*KEY).agg(F.count("*").alias("cnt")), params, type_tag)
    return _checked(state) if check else state


def union(a: State, b: State, check: bool = True) -> State:
    """All copies of both; where that is too many, both stay as they were."""
    check_same(a, b)
    out = a.with_table(a.table.unionByName(b.table).groupBy(*KEY).agg(F.sum("cnt").alias("cnt")))
    return _checked(out) if check else out


def delete(state: State, df: DataFrame, col: str) -> State:
    """Without one copy for each row of df whose value is stored."""
    gone = keyed(df.where(F.col(col).isNotNull()), col, state.params).groupBy(*KEY).agg(F.count("*").alias("__gone"))
    left = state.table.join(gone, KEY, "left").withColumn("cnt", F.col("cnt") - F.coalesce("__gone", F.lit(0))).where("cnt > 0")
    return state.with_table(left.select(*KEY, "cnt"))


def query(state: State, df: DataFrame, col: str, name: str = "known") -> DataFrame:
    """df with whether each value may be in the filter; NULL for NULL."""
    rows = keyed(df, col, state.params).join(state.table.select(*KEY, F.lit(True).alias("__known")), KEY, "left")
    return rows.withColumn(name, F.when(F.col(col).isNotNull(), F.coalesce("__known", F.lit(False)))).select(*df.columns, name)


def length(state: State) -> int:
    """The number of stored copies."""
    return state.table.agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]


class Slots:
    """Buckets of slots with kicks, for filters that one task holds."""

    def __init__(self, params: CuckooParams, seed: int = 0):
        self.params, self.rnd = params, random.Random(seed)
        self.buckets: dict[int, list[int]] = {}

    def insert(self, fp: int, i1: int, i2: int, partner) -> bool | None:
        """True where placed in i1, False where in i2 or by kicks, None where full; then nothing has changed."""
        size = self.params.bucketsize
        for place, answer in ((i1, True), (i2, False)):
            slots = self.buckets.setdefault(place, [])
            if len(slots) < size:
                slots.append(fp)
                return answer
        undo, place = [], self.rnd.choice((i1, i2))
        for _ in range(MAX_KICKS):
            slot = self.rnd.randrange(size)
            undo.append((place, slot, self.buckets[place][slot]))
            fp, self.buckets[place][slot] = self.buckets[place][slot], fp
            place = partner(place, fp)
            slots = self.buckets.setdefault(place, [])
            if len(slots) < size:
                slots.append(fp)
                return False
        for place, slot, old in reversed(undo):
            self.buckets[place][slot] = old
        return None


class Chain:
    """The filters of a group, of which the last takes new copies.  further: where that is full, another of the same
    parameters follows; nothing moves in the ones before, so they are not held."""

    def __init__(self, params: CuckooParams, seed: int = 0, further: bool = False):
        self.params, self.seed, self.further, self.number = params, seed, further, -1
        self._open()

    def _open(self) -> None:
        # The partner of a kicked fingerprint needs its own hash, so the xor of its two buckets is kept.
        self.slots, self.xor, self.number = Slots(self.params, self.seed), {}, self.number + 1

    def _place(self, fp: int, i1: int, x: int) -> bool | None:
        self.xor[fp] = x
        return self.slots.insert(fp, i1, i1 ^ x, lambda place, f: place ^ self.xor[f])

    def insert(self, fp: int, i1: int, x: int) -> tuple[bool | None, int | None]:
        """What Slots.insert answers, and which filter took the copy."""
        placed = self._place(fp, i1, x)
        if placed is None and self.further:
            self._open()
            placed = self._place(fp, i1, x)
        return placed, None if placed is None else self.number


class _Fold:
    """A chain, fed a batch of rows (group, seq, fp, i1, x) at a time."""

    def __init__(self, chain: Chain):
        self.chain = chain

    def add(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        placed = [self.chain.insert(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("fp", "i1", "x")), strict=True)]
        answers = [pa.array([p for p, _ in placed], pa.bool_()), pa.array([n for _, n in placed], pa.int32())]
        return pa.RecordBatch.from_arrays([batch.column("group"), batch.column("seq"), *answers], ["group", "seq", "placed", "filter"])

    def end(self) -> None:
        return None


def insert_sequentially(df: DataFrame, col: str, seq: str, group: str, params: CuckooParams, seed: int = 0, further: bool = False) -> DataFrame:
    """group, seq, placed, filter: for each group a filter of its own, filled row by row in the order of seq.  placed is
    true for the first bucket, false for the second or after kicks, and NULL where the filter was full; or, with further,
    the row and those after it go to another filter (0, 1, ...), and none is left out.  One task reads a group, a batch at
    a time."""
    rows = keyed(df.where(F.col(col).isNotNull()), col, params)
    rows = rows.select(F.col(group).cast("string").alias("group"), F.col(seq).cast("long").alias("seq"), "fp", "i1", F.col("b_lo").bitwiseXOR(F.col("b_hi")).alias("x"))

    return folded(rows, lambda: _Fold(Chain(params, seed, further)), "group string, seq long, placed boolean, filter int")
