"""HyperLogLog: a register is the largest rank of the hashes that fall in it.

The raw estimate is too high for few elements; its bias is taken from the six nearest points of a curve.  The curve is
made by rule: with n elements in m registers, each gets a Poisson number of them, which gives the mean of 2^-register and
so the raw estimate to expect.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import BITS, hashed
from ..functions.params import HllParams
from ..sources.states import State, check_same

# Below these counts, for b = 4 .. 18, linear counting is preferred.
THRESHOLDS = [10, 20, 40, 80, 220, 400, 900, 1800, 3100, 6500, 11500, 20000, 50000, 120000, 350000]
NEIGHBORS = 6


def register_and_rank(col: str | Column, params: HllParams) -> tuple[Column, Column]:
    """The low b bits of the hash, and one more than the zeros that lead the rest of it."""
    h = hashed(col, 0, params.family)
    return register_and_rank_of(h, params, BITS[params.family])


def register_and_rank_of(h: Column, params: HllParams, bits: int) -> tuple[Column, Column]:
    """The same of a hash of `bits` bits that was made elsewhere."""
    rest = F.shiftrightunsigned(h, params.b)
    width = bits - params.b
    rank = F.when(rest == 0, F.lit(width + 1)).otherwise(F.lit(width + 1) - F.length(F.bin(rest)))
    return h.bitwiseAND(F.lit(params.m - 1)), rank.cast("int")


def build(df: DataFrame, col: str, params: HllParams, by: list[str] | None = None, type_tag: str = "any", is_hash: bool = False) -> State:
    """by, j, r: the registers above 0, of all values that are not NULL, for each group.  Map tasks take the largest rank
    before the shuffle.  is_hash: col holds 64-bit hashes already."""
    j, r = register_and_rank_of(F.col(col), params, 64) if is_hash else register_and_rank(col, params)
    rows = df.where(F.col(col).isNotNull()).select(*(by or []), j.alias("j"), r.alias("r"))
    return State(rows.groupBy(*(by or []), "j").agg(F.max("r").alias("r")), params, type_tag)


def merge(a: State, b: State, by: list[str] | None = None) -> State:
    check_same(a, b)
    return a.with_table(a.table.unionByName(b.table).groupBy(*(by or []), "j").agg(F.max("r").alias("r")))


def alpha(m: int) -> float:
    # The constants for few registers.
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))


@lru_cache(maxsize=16)
def bias_curve(b: int, points: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Raw estimates to expect for up to 5 m elements, ascending, and their biases."""
    m = 1 << b
    n = np.linspace(0, 5.2 * m, points)
    k = np.arange(1, 61)[:, None]
    load = n / m
    mean = np.exp(-load) + (2.0**-k * (np.exp(-load * 2.0**-k) - np.exp(-load * 2.0 ** -(k - 1)))).sum(axis=0)
    raw = alpha(m) * m / mean
    return raw, raw - n


def neighbors(raw: np.ndarray, e: float, k: int = NEIGHBORS) -> slice:
    """Where the k values of an ascending array that are nearest to e stand; a tie goes left."""
    right = int(np.searchsorted(raw, e))
    left = right
    while right - left < min(k, len(raw)):
        if left > 0 and (right == len(raw) or e - raw[left - 1] <= raw[right] - e):
            left -= 1
        else:
            right += 1
    return slice(left, right)


def estimate(b: int, inverse_sum: float, zeros: int) -> int:
    """The count of a sketch with that sum of 2^-register over all m registers, `zeros` of which are 0."""
    m = 1 << b
    e = alpha(m) * m * m / inverse_sum
    if e <= 5 * m:
        raw, bias = bias_curve(b)
        e -= float(bias[neighbors(raw, e)].mean())
    h = m * math.log(m / zeros) if zeros else e
    return int(h if h <= THRESHOLDS[b - 4] else e)


def estimates(b: int, inverse_sum: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """estimate() of each pair."""
    m = 1 << b
    e = alpha(m) * m * m / inverse_sum
    raw, bias = bias_curve(b)
    # The neighbours are a run of the curve that begins at `at`: the first run whose next value would be farther away.
    at = np.minimum(np.searchsorted((raw[:-NEIGHBORS] + raw[NEIGHBORS:]) / 2, e, "left"), len(raw) - NEIGHBORS)
    total = np.append(0.0, np.cumsum(bias))
    e = np.where(e <= 5 * m, e - (total[at + NEIGHBORS] - total[at]) / NEIGHBORS, e)
    h = np.where(zeros > 0, m * np.log(m / np.maximum(zeros, 1)), e)
    return np.where(h <= THRESHOLDS[b - 4], h, e).astype("int64")


def summary(state: State, by: list[str] | None = None) -> DataFrame:
    """by, inverse_sum, zeros of each group."""
    m = state.params.m
    agg = state.table.groupBy(*(by or [])).agg(F.sum(F.pow(F.lit(2.0), -F.col("r"))).alias("__s"), F.count("r").alias("__n"))
    return agg.select(*(by or []), (F.coalesce("__s", F.lit(0.0)) + m - F.col("__n")).alias("inverse_sum"), (F.lit(m) - F.col("__n")).alias("zeros"))


def count(state: State, by: list[str] | None = None, name: str = "estimate") -> DataFrame:
    """by, estimate: the number of distinct values of each group."""
    b = state.params.b

    @F.pandas_udf("bigint")
    def estimated(s: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series(estimates(b, s.to_numpy(float), z.to_numpy("int64")))

    return summary(state, by).select(*(by or []), estimated("inverse_sum", "zeros").alias(name))


def approx_distinct(df: DataFrame, col: str, b: int, by: list[str] | None = None, name: str = "estimate") -> DataFrame:
    """The built-in estimator with 2 ** b registers: no state is kept, all is compiled."""
    rsd = 1.106 / 2 ** (b / 2) + 1e-12
    return df.groupBy(*(by or [])).agg(F.approx_count_distinct(col, rsd).alias(name))


def to_json(state: State) -> str:
    """One ungrouped sketch as JSON with registers, b and buildhasher."""
    m = state.params.m
    row = state.table.agg(F.collect_list(F.struct("j", "r")).alias("x")).first()["x"]  # at most 2 ** 18 registers
    registers = [0] * m
    for x in row:
        registers[x["j"]] = x["r"]
    return pd.Series({"registers": registers, "b": state.params.b, "buildhasher": state.params.family}).to_json()


def from_json(spark, text: str) -> State:
    """ValueError where a field is missing, unknown or does not fit."""
    import json

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("duplicate field")
        return dict(pairs)

    data = json.loads(text, object_pairs_hook=once)
    if missing := {"registers", "b", "buildhasher"} - set(data):
        raise ValueError(f"missing field {sorted(missing)[0]}")
    if unknown := set(data) - {"registers", "b", "buildhasher"}:
        raise ValueError(f"unknown field {sorted(unknown)[0]}")
    params = HllParams(data["b"], data["buildhasher"])
    if len(data["registers"]) != params.m:
        raise ValueError("registers must have length of 2^b")
    rows = [(j, r) for j, r in enumerate(data["registers"]) if r]
    return State(spark.createDataFrame(rows, "j bigint, r int"), params)
