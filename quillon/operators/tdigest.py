"""t-digests: centroids whose size a scale function bounds, for quantiles and distribution functions.

Tasks make a digest of each run of their rows and merge these; the partial digests, a few hundred centroids each, are
shuffled by parts of groups and merged, and these by group and merged once more.  Merging two digests is compressing their centroids together.  Finding where a
centroid ends is a binary search in the running sum of weights, so compressing costs a sort and a step for each centroid.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.params import TDigestParams
from ..sources.states import State, check_same

#: Parts of a group whose digests are merged before the group's are.
BRANCHES = 64


class Scale(Protocol):
    """How finely quantiles near q are kept: a centroid spans at most 1 in k = f(q)."""

    delta: float

    def f(self, q: float, n: int) -> float: ...

    def f_inv(self, k: float, n: int) -> float: ...


def _unit(q: float) -> float:
    return min(max(q, 0.0), 1.0)


@dataclass(frozen=True)
class _Delta:
    delta: float

    def __post_init__(self) -> None:
        if not (self.delta > 1 and math.isfinite(self.delta)):
            raise ValueError(f"delta ({self.delta}) must be greater than 1 and finite")


class K0(_Delta):
    """Uniform."""

    def f(self, q: float, n: int = 0) -> float:
        return self.delta / 2 * _unit(q)

    def f_inv(self, k: float, n: int = 0) -> float:
        return min(max(k, 0.0), self.delta / 2) * 2 / self.delta


class K1(_Delta):
    """Finer towards both ends, by the arc sine."""

    def f(self, q: float, n: int = 0) -> float:
        return self.delta / (2 * math.pi) * math.asin(2 * _unit(q) - 1)

    def f_inv(self, k: float, n: int = 0) -> float:
        k = min(max(k, -self.delta / 4), self.delta / 4)
        return (math.sin(k * 2 * math.pi / self.delta) + 1) / 2


class _Log(_Delta):
    shift = 24.0

    def x(self, n: int) -> float:
        """The factor; its divisor is kept at 1 or more, as very few elements would make it negative."""
        return self.delta / max(4 * math.log(max(n, 1) / self.delta) + self.shift, 1.0)


class K2(_Log):
    """Finer towards both ends, by the logarithm of the odds."""

    def f(self, q: float, n: int = 1) -> float:
        q = _unit(q)
        return -math.inf if q == 0 else math.inf if q == 1 else self.x(n) * math.log(q / (1 - q))

    def f_inv(self, k: float, n: int = 1) -> float:
        if math.isinf(k):
            return float(k > 0)
        z = k / self.x(n)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


class K3(_Log):
    """Finer towards both ends, by the logarithm of the distance to the nearer one."""

    shift = 21.0

    def f(self, q: float, n: int = 1) -> float:
        q = _unit(q)
        if q <= 0.5:
            return -math.inf if q == 0 else self.x(n) * math.log(2 * q)
        return math.inf if q == 1 else -self.x(n) * math.log(2 * (1 - q))

    def f_inv(self, k: float, n: int = 1) -> float:
        if math.isinf(k):
            return float(k > 0)
        z = k / self.x(n)
        return math.exp(z) / 2 if z <= 0 else 1 - math.exp(-z) / 2


def scale_columns(kind: str, delta: float, q: Column, n: int = 1) -> Column:
    """f of K0 or K1 as a column expression, or of K2 or K3 for q strictly between 0 and 1."""
    q = F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0))
    if kind == "K0":
        return F.lit(delta / 2) * q
    if kind == "K1":
        return F.lit(delta / (2 * math.pi)) * F.asin(2 * q - 1)
    x = {"K2": K2, "K3": K3}[kind](delta).x(n)
    if kind == "K2":
        return F.lit(x) * F.log(q / (1 - q))
    return F.when(q <= 0.5, F.lit(x) * F.log(2 * q)).otherwise(-F.lit(x) * F.log(2 * (1 - q)))


@dataclass(frozen=True)
class Digest:
    """Means and weights of centroids in order, how many elements came in, and the least and the largest."""

    scale: Scale
    means: np.ndarray
    weights: np.ndarray
    n: int = 0
    least: float = math.inf
    most: float = -math.inf

    @staticmethod
    def empty(scale: Scale) -> Digest:
        return Digest(scale, np.zeros(0), np.zeros(0))

    def add(self, values: np.ndarray, weights: np.ndarray | None = None) -> Digest:
        """With more elements; a weight of 0 counts for nothing.  ValueError for values that are not finite, and weights
        that are negative or not finite."""
        values = np.asarray(values, float)
        weights = np.ones(len(values)) if weights is None else np.asarray(weights, float)
        if not np.isfinite(values).all():
            raise ValueError("x must be finite")
        if not np.isfinite(weights).all() or (weights < 0).any():
            raise ValueError("w must be finite and greater or equal than zero")
        values, weights = values[weights > 0], weights[weights > 0]
        if not len(values):
            return self
        return self._compressed(values, weights, len(values), values.min(), values.max())

    def merge(self, other: Digest) -> Digest:
        return self._compressed(other.means, other.weights, other.n, other.least, other.most) if other.n else self

    def _compressed(self, means, weights, n, least, most) -> Digest:
        means, weights = np.concatenate([self.means, means]), np.concatenate([self.weights, weights])
        order = np.argsort(means, kind="stable")
        means, weights = means[order], weights[order]
        n += self.n
        total = np.cumsum(weights)
        s, at, cuts = total[-1], 0, []
        while at < len(means):
            cuts.append(at)
            q = (total[at - 1] if at else 0.0) / s
            limit = self.scale.f_inv(self.scale.f(q, n) + 1, n)
            at = max(at + 1, int(np.searchsorted(total, limit * s * (1 + 1e-12), "right")))
        w = np.add.reduceat(weights, cuts)
        return replace(self, means=np.add.reduceat(means * weights, cuts) / w, weights=w, n=n, least=min(self.least, float(least)), most=max(self.most, float(most)))

    @property
    def count(self) -> float:
        return float(self.weights.sum())

    @property
    def sum(self) -> float:
        return float((self.means * self.weights).sum())

    @property
    def mean(self) -> float:
        return self.sum / self.count if self.n else math.nan

    @property
    def n_centroids(self) -> int:
        return len(self.means)

    def _curve(self) -> tuple[np.ndarray, np.ndarray]:
        """Values and the weight up to each: the ends, and between them each centroid with half of its own weight."""
        half = np.cumsum(self.weights) - self.weights / 2
        return np.concatenate([[self.least], self.means, [self.most]]), np.concatenate([[0.0], half, [self.count]])

    def quantile(self, q: float) -> float:
        """Linear between the points of the curve; NaN if empty."""
        if not 0 <= q <= 1:
            raise ValueError("q must be in [0, 1]")
        if not self.n:
            return math.nan
        x, w = self._curve()
        return float(np.interp(q * self.count, w, x))

    def cdf(self, v: float) -> float:
        """The share of the weight up to v; 0 if empty."""
        if math.isnan(v):
            raise ValueError("x must not be NaN")
        if not self.n or v < self.least:
            return 0.0
        if v >= self.most:
            return 1.0
        x, w = self._curve()
        k = int(np.searchsorted(x, v, "right"))  # x[k - 1] <= v < x[k]
        part = (v - x[k - 1]) / (x[k] - x[k - 1])
        return float((w[k - 1] + part * (w[k] - w[k - 1])) / self.count)


STATE = "means array<double>, weights array<double>, n bigint, least double, most double"


def _row(d: Digest) -> dict:
    return {"means": d.means.tolist(), "weights": d.weights.tolist(), "n": d.n, "least": d.least, "most": d.most}


def _digest(scale: Scale, row) -> Digest:
    return Digest(scale, np.asarray(row["means"], float), np.asarray(row["weights"], float), int(row["n"]), float(row["least"]), float(row["most"]))


def build(df: DataFrame, col: str, scale: Scale, weight: str | None = None, by: str | None = None, max_backlog: int = 10_000) -> DataFrame:
    """g, means, weights, n, least, most: a digest for each value of `by` (as text; one group, '', without it).  NULL
    values and weights are left out; groups of NULL are one group.  What a task holds is a digest for each group it meets;
    where these are very many, it passes them on early.  max_backlog: rows of a group that are taken in at once."""
    weight_col = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    group = F.lit("") if by is None else F.col(by).cast("string")
    rows = df.select(group.alias("g"), F.col(col).cast("double").alias("x"), weight_col.alias("w")).where("x IS NOT NULL AND w IS NOT NULL")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, Digest] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"g": g, **_row(d)} for g, d in held.items()], schema)

        for batch in batches:
            pdf = batch.to_pandas()
            for g, part in pdf.groupby("g", dropna=False):
                g = None if g is None or g != g else g
                for at in range(0, len(part), max_backlog):
                    held[g] = held.get(g, Digest.empty(scale)).add(part["x"].to_numpy()[at : at + max_backlog], part["w"].to_numpy()[at : at + max_backlog])
            if len(held) > 10_000:
                yield out()
                held.clear()
        if held:
            yield out()

    schema = pa.schema([("g", pa.string()), ("means", pa.list_(pa.float64())), ("weights", pa.list_(pa.float64())), ("n", pa.int64()), ("least", pa.float64()), ("most", pa.float64())])
    return merge(rows.mapInArrow(partial, f"g string, {STATE}"), scale)


def merge(states: DataFrame, scale: Scale) -> DataFrame:
    """One digest for each g of any number of states.  A group has a row from each task that made states; these are merged
    in two steps, of BRANCHES parts of the group first, so that no task holds them all."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = Digest.empty(scale)
        for row in pdf.sort_values(["least", "n"]).to_dict("records"):
            d = d.merge(_digest(scale, row))
        return pd.DataFrame([{"g": pdf["g"].iloc[0], **_row(d)}])

    schema = f"g string, {STATE}"
    dealt = states.withColumn("__part", F.pmod(F.xxhash64("n", "least", "most", "means"), F.lit(BRANCHES)))
    return dealt.groupBy("g", "__part").applyInPandas(lambda pdf: run(pdf), schema).groupBy("g").applyInPandas(run, schema)


SCALES = {"K0": K0, "K1": K1, "K2": K2, "K3": K3}


def state(df: DataFrame, col: str, params: TDigestParams, weight: str | None = None, by: str | None = None, type_tag: str = "any") -> State:
    """build() as a state that knows its parameters, for saving and merging."""
    return State(build(df, col, SCALES[params.scale](params.delta), weight, by, params.max_backlog), params, type_tag)


def merged(a: State, b: State) -> State:
    """ValueError for states of different scales, deltas or backlogs."""
    check_same(a, b)
    return a.with_table(merge(a.table.unionByName(b.table), SCALES[a.params.scale](a.params.delta)))


def evaluated(states: DataFrame, scale: Scale, quantiles: list[float] | None = None, values: list[float] | None = None) -> DataFrame:
    """g, kind (quantile or cdf), at, value for each digest and each point asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                d = _digest(scale, row)
                out += [(row["g"], "quantile", q, d.quantile(q)) for q in quantiles or ()]
                out += [(row["g"], "cdf", x, d.cdf(x)) for x in values or ()]
            yield pd.DataFrame(out, columns=["g", "kind", "at", "value"])

    return states.mapInPandas(run, "g string, kind string, at double, value double")


def k0_clusters(df: DataFrame, col: str, id_: str, delta: float) -> DataFrame:
    """cluster, n, least, most: rows dealt to clusters by K0 of their mid rank, floored.  A relational cousin of the
    digest, whose clusters begin at fixed quantiles; ranks are by col, then the unique column id_."""
    from ..plans.numbering import numbered

    rows = numbered(df.select(id_, F.col(col).alias("x")).where("x IS NOT NULL"), "x", id_, name="__r")
    n = rows.count()
    q = (F.col("__r") - F.lit(0.5)) / F.lit(max(n, 1))
    return rows.groupBy(F.floor(F.lit(delta / 2) * q).alias("cluster")).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
