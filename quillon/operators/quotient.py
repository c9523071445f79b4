"""Quotient filters: the stored set is the distinct fingerprints, cut into quotient and remainder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import hashed, whole
from ..functions.params import QuotientParams
from ..sources.states import State, check_same

KEY = ["quotient", "remainder"]


class QuotientFilterFull(Exception):
    """More fingerprints than slots; the state from before stays as it was."""


def keyed(df: DataFrame, col: str, params: QuotientParams) -> DataFrame:
    """df with quotient and remainder: of the low bits of the hash, the upper and the lower ones."""
    r = params.bits_remainder
    h = (whole if params.bits_quotient + r > 60 else hashed)(col, 0, params.family)
    quotient = F.shiftrightunsigned(h, r).bitwiseAND(F.lit((1 << params.bits_quotient) - 1))
    return df.withColumn("quotient", quotient).withColumn("remainder", h.bitwiseAND(F.lit((1 << r) - 1)))


def _checked(state: State) -> State:
    if state.table.count() > 1 << state.params.bits_quotient:
        raise QuotientFilterFull("the filter is full")
    return state


def build(df: DataFrame, col: str, params: QuotientParams, type_tag: str = "any", check: bool = True) -> State:
    """quotient, remainder of all values that are not NULL."""
    state = State(keyed(df.where(F.col(col).isNotNull()), col, params).select(*KEY).distinct(), params, type_tag)
    return _checked(state) if check else state


def union(a: State, b: State, check: bool = True) -> State:
    check_same(a, b)
    out = a.with_table(a.table.unionByName(b.table).distinct())
    return _checked(out) if check else out


def length(state: State) -> int:
    return state.table.count()


def insert_flags(df: DataFrame, col: str, seq: str, params: QuotientParams, name: str = "is_new") -> DataFrame:
    """df with whether the row is the first, by the unique column seq, with its fingerprint; NULL for NULL."""
    rows = keyed(df, col, params)
    firsts = rows.where(F.col(col).isNotNull()).groupBy(*KEY).agg(F.min(seq).alias("__s")).select("__s").withColumn("__new", F.lit(True))
    out = df.join(firsts, df[seq] == F.col("__s"), "left")
    return out.withColumn(name, F.when(F.col(col).isNotNull(), F.coalesce("__new", F.lit(False)))).drop("__s", "__new")


def query(state: State, df: DataFrame, col: str, name: str = "known") -> DataFrame:
    """df with whether each value may be in the filter; NULL for NULL."""
    rows = keyed(df, col, state.params).join(state.table.withColumn("__known", F.lit(True)), KEY, "left")
    return rows.withColumn(name, F.when(F.col(col).isNotNull(), F.coalesce("__known", F.lit(False)))).select(*df.columns, name)
