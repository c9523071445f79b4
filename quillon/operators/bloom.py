"""Bloom filters: the bits of a filter are the distinct positions of its elements, 64 to a row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import positions
from ..functions.params import BloomParams
from ..sources.states import State, check_same

#: Rows of a state (64 bits each) that a query broadcasts, at most: 2**20 rows are 2**26 bits, about 16 MB.
BROADCAST_ROWS = 1 << 20


def build(df: DataFrame, col: str | Column, params: BloomParams, type_tag: str = "any") -> State:
    """The state of all values of col: word, bits.  Map tasks OR their bits before the shuffle.  NULLs are ignored."""
    spots = df.select(F.explode(positions(col, params.m, params.k, params.family)).alias("pos"))
    words = spots.groupBy(F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pos & 63 AS INT))")).alias("bits"))
    return State(words, params, type_tag)


def ones(state: State) -> DataFrame:
    """The positions of the bits that are set: pos."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(63)))
    return state.table.select("word", "bits", bit.alias("b")).where(F.expr("(shiftrightunsigned(bits, b) & 1) = 1")).select((F.col("word") * 64 + F.col("b")).alias("pos"))


def union(a: State, b: State) -> State:
    """As if all elements of b had been added to a."""
    check_same(a, b)
    return a.with_table(a.table.unionByName(b.table).groupBy("word").agg(F.bit_or("bits").alias("bits")))


def n_ones(state: State) -> int:
    return state.table.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))).first()[0]


def estimated_len(ones_: int, params: BloomParams) -> int | None:
    """A guess of how many elements a filter with so many bits set holds; None where all are set."""
    if ones_ >= params.m:
        return None
    return int(-params.m / params.k * math.log(1 - ones_ / params.m))


def length(state: State) -> int | None:
    return estimated_len(n_ones(state), state.params)


def insert_flags(df: DataFrame, col: str, seq: str, params: BloomParams, name: str = "is_new") -> DataFrame:
    """df with a flag: whether inserting the row's value, in the order of the unique column seq, sets a new bit.  A row
    does so if it is the first at one of its positions.  NULL gives NULL and sets nothing."""
    spots = df.select(F.col(seq).alias("__s"), F.explode(F.array_distinct(positions(col, params.m, params.k, params.family))).alias("__p"))
    firsts = spots.groupBy("__p").agg(F.min("__s").alias("__s")).select("__s").distinct().withColumn("__new", F.lit(True))
    out = df.join(firsts, df[seq] == F.col("__s"), "left")
    return out.withColumn(name, F.when(F.col(col).isNotNull(), F.coalesce("__new", F.lit(False)))).drop("__s", "__new")


def query(state: State, df: DataFrame, col: str, name: str = "known") -> DataFrame:
    """df with whether each value may be in the filter; no value that was added is missed.  NULL gives NULL.

    A filter of up to BROADCAST_ROWS * 64 bits is joined by broadcast, once for each hash function, within one stage.
    Beyond that, the distinct values' positions are joined with it by shuffle.
    """
    p = state.params
    if p.m <= BROADCAST_ROWS * 64:
        out = df.withColumn("__at", positions(col, p.m, p.k, p.family))
        known = F.lit(True)
        for i in range(p.k):
            words = F.broadcast(state.table.select(F.col("word").alias(f"__w{i}"), F.col("bits").alias(f"__b{i}")))
            out = out.join(words, F.shiftright(F.col("__at")[i], 6) == F.col(f"__w{i}"), "left")
            known &= F.expr(f"coalesce((shiftrightunsigned(__b{i}, cast(__at[{i}] & 63 AS INT)) & 1) = 1, false)")
        return out.withColumn(name, F.when(F.col(col).isNotNull(), known)).select(*df.columns, name)
    values = df.select(F.col(col).alias("__v")).where("__v IS NOT NULL").distinct()
    spots = values.select("__v", F.explode(F.array_distinct(positions("__v", p.m, p.k, p.family))).alias("__p"))
    hit = spots.join(state.table, F.shiftright("__p", 6) == F.col("word"), "left")
    per = hit.groupBy("__v").agg(F.min(F.expr("coalesce(shiftrightunsigned(bits, cast(__p & 63 AS INT)) & 1, 0)")).alias("__all"))
    return df.join(per, df[col] == per["__v"], "left").withColumn(name, F.col("__all") == 1).select(*df.columns, name)


def prefiltered_join(probe: DataFrame, build_side: DataFrame, probe_key: str, build_key: str, params: BloomParams) -> DataFrame:
    """The inner join on equal keys, where rows of the probe side that the filter of the build side rules out are dropped
    before the shuffle."""
    state = build(build_side, build_key, params)
    kept = query(state, probe, probe_key, "__may").where("__may").drop("__may")
    return kept.join(build_side, kept[probe_key] == build_side[build_key])


def running_len(df: DataFrame, col: str, seq: str, params: BloomParams, name: str = "ones") -> DataFrame:
    """df with how many bits are set once each row is added, in the order of seq.  One sorted pass over the distinct
    positions' first rows; meant for streams that fit in one task."""
    spots = df.select(F.col(seq).alias("__s"), F.explode(positions(col, params.m, params.k, params.family)).alias("__p"))
    new = spots.groupBy("__p").agg(F.min("__s").alias("__s")).groupBy("__s").agg(F.count("*").alias("__n"))
    out = df.join(new, df[seq] == F.col("__s"), "left")
    w = Window.orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn(name, F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__s", "__n")
