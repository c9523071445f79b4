"""The exact set, with the operations of a filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.states import State, check_same


def build(df: DataFrame, col: str, type_tag: str = "any") -> State:
    """value: the distinct values that are not NULL."""
    return State(df.select(F.col(col).alias("value")).where("value IS NOT NULL").distinct(), (), type_tag)


def insert_flags(df: DataFrame, col: str, seq: str, name: str = "is_new") -> DataFrame:
    """df with whether the row is the first, by the unique column seq, with its value; NULL for NULL."""
    firsts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("__v")).agg(F.min(seq).alias("__s")).select("__s").withColumn("__new", F.lit(True))
    out = df.join(firsts, df[seq] == F.col("__s"), "left")
    return out.withColumn(name, F.when(F.col(col).isNotNull(), F.coalesce("__new", F.lit(False)))).drop("__s", "__new")


def union(a: State, b: State) -> State:
    if a.type_tag != b.type_tag:
        check_same(a, b)
    return a.with_table(a.table.union(b.table).distinct())


def length(state: State) -> int:
    return state.table.count()


def query(state: State, df: DataFrame, col: str, name: str = "known") -> DataFrame:
    """df with whether each value is in the set; NULL for NULL."""
    known = state.table.select(F.col("value").alias("__v"), F.lit(True).alias("__known"))
    out = df.join(known, df[col] == F.col("__v"), "left")
    return out.withColumn(name, F.when(F.col(col).isNotNull(), F.coalesce("__known", F.lit(False)))).select(*df.columns, name)
