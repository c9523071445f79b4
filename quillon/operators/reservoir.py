"""Uniform samples of fixed size: the k rows of least hash, which any task can keep and any two samples can be merged by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import hashed
from ..functions.params import ReservoirParams
from ..sources.states import State, check_same


def _key(id_: str, seed: int, family: str) -> Column:
    return hashed(F.col(id_), 1_000 + seed, family)


def sample(df: DataFrame, k: int, id_: str, seed: int = 0, family: str = "xxhash64") -> DataFrame:
    """min(k, n) rows, each subset as likely as any other, in the order of the unique column id_.  Every task keeps its k
    least, so only those are shuffled."""
    if k < 1:
        raise ValueError("k must be greater than 0")
    return df.withColumn("__h", _key(id_, seed, family)).orderBy("__h", id_).limit(k).drop("__h").orderBy(id_)


def sample_by(df: DataFrame, k: int, id_: str, by: list[str], seed: int = 0, family: str = "xxhash64") -> DataFrame:
    """The same for each group; of a large group, Spark keeps the first k of each task before the shuffle."""
    if k < 1:
        raise ValueError("k must be greater than 0")
    w = Window.partitionBy(*by).orderBy("__h", id_)
    return df.withColumn("__h", _key(id_, seed, family)).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__h", "__rn")


def merge(a: DataFrame, b: DataFrame, k: int, id_: str, seed: int = 0, family: str = "xxhash64") -> DataFrame:
    """The sample of the union of what two samples were drawn from (with the same k, seed and family)."""
    return sample(a.unionByName(b), k, id_, seed, family)


def state(df: DataFrame, params: ReservoirParams, type_tag: str = "any") -> State:
    """The sample as a state: its rows, and in each `seen`, how many rows it was drawn from."""
    rows = sample(df, params.k, params.id, params.seed, params.family)
    return State(rows.crossJoin(F.broadcast(df.agg(F.count("*").alias("seen")))), params, type_tag)


def extended(a: State, df: DataFrame) -> State:
    """The sample after more rows."""
    return merged(a, state(df, a.params, a.type_tag))


def merged(a: State, b: State) -> State:
    """ValueError for samples of different k, id, seed or family."""
    check_same(a, b)
    both = a.table.unionByName(b.table)
    counts = [x.table.agg(F.coalesce(F.max("seen"), F.lit(0)).alias("s")) for x in (a, b)]
    seen = counts[0].union(counts[1]).agg(F.sum("s").alias("seen"))
    rows = sample(both.drop("seen"), a.params.k, a.params.id, a.params.seed, a.params.family)
    return a.with_table(rows.crossJoin(F.broadcast(seen)))
