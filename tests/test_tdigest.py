import math

import numpy as np
import pytest

from quillon.functions.params import TDigestParams
from quillon.operators import tdigest as td
from quillon.operators.tdigest import K0, K1, K2, K3, Digest
from quillon.sources import states


def digest(values, weights=None, scale=None):
    return Digest.empty(scale or K1(100.0)).add(np.array(values, float), weights)


def test_empty():
    d = Digest.empty(K1(100.0))
    assert math.isnan(d.quantile(0.5)) and d.cdf(1.0) == 0 and math.isnan(d.mean) and d.count == 0 and d.n_centroids == 0
    assert d.least == math.inf and d.most == -math.inf


def test_single():
    d = digest([13.37])
    assert [d.quantile(q) for q in (0, 0.5, 1)] == [13.37] * 3
    assert d.cdf(13.36) == 0 and d.cdf(13.37) == 1


def test_two():
    d = digest([10, 20])
    assert [d.quantile(q) for q in (0.25, 0.375, 0.5, 0.625, 0.75)] == [10, 12.5, 15, 17.5, 20]
    assert [d.cdf(x) for x in (10, 12.5, 15, 17.5, 20)] == [0.25, 0.375, 0.5, 0.625, 1]
    d = digest([10, 20], np.array([1.0, 9.0]))
    assert np.allclose([d.quantile(q) for q in (0.05, 0.175, 0.3, 0.425, 0.55)], [10, 12.5, 15, 17.5, 20])
    assert d.mean == 19


def test_compressed_to_one():
    d = digest([10, 20] + [15] * 100, scale=K1(2.0))
    assert d.n_centroids == 1
    assert np.allclose([d.quantile(q) for q in (0.125, 0.25, 0.5, 0.75, 0.875, 1)], [11.25, 12.5, 15, 17.5, 18.75, 20])
    assert digest(np.random.default_rng(1).normal(size=10_000), scale=K1(1.1)).n_centroids == 1


@pytest.mark.parametrize("scale", [K1(100.0), K2(100.0), K3(100.0)])
def test_normal(scale):
    from statistics import NormalDist

    d, data = Digest.empty(scale), np.random.default_rng(3).normal(size=100_000)
    for part in np.split(data, 100):
        d = d.add(part)
    for q in (0.1, 0.25, 0.5, 0.75, 0.9):
        assert abs(d.quantile(q) - NormalDist().inv_cdf(q)) < 0.02
    assert d.n_centroids < 200 and d.count == 100_000
    assert d.quantile(0) == data.min() and d.quantile(1) == data.max()


def test_invalid():
    d = digest([1.0])
    for bad in (math.nan, math.inf, -math.inf):
        with pytest.raises(ValueError, match="x must be finite"):
            d.add(np.array([bad]))
        with pytest.raises(ValueError, match="w must be finite"):
            d.add(np.array([1.0]), np.array([bad]))
    with pytest.raises(ValueError):
        d.add(np.array([1.0]), np.array([-1.0]))
    for q in (-0.1, 1.1):
        with pytest.raises(ValueError):
            d.quantile(q)
    with pytest.raises(ValueError):
        d.cdf(math.nan)
    assert d.add(np.array([5.0]), np.array([0.0])) is d
    for kind in (K0, K1, K2, K3):
        for delta in (1.0, math.inf, math.nan):
            with pytest.raises(ValueError):
                kind(delta)


@pytest.mark.parametrize("kind", [K0, K1, K2, K3])
@pytest.mark.parametrize("delta", [1.5, 1.7, 2.0, 10.0])
def test_scales_go_back(kind, delta):
    s = kind(delta)
    for q in (0, 0.1, 0.5, 0.7, 1):
        assert abs(s.f_inv(s.f(q, 1000), 1000) - q) < 1e-9
    assert s.f(-0.1, 1000) == s.f(0, 1000) and s.f(1.1, 1000) == s.f(1, 1000)
    assert s.f(0.2, 1) <= s.f(0.3, 1)


def test_in_spark(spark):
    data = np.random.default_rng(5).normal(size=2000)
    df = spark.createDataFrame([(float(x), "a" if x < 0 else None) for x in data] + [(None, "a")], "x double, g string").repartition(3)
    scale = K1(100.0)
    rows = {r["at"]: r["value"] for r in td.evaluated(td.build(df, "x", scale), scale, quantiles=[0.0, 0.5, 1.0]).collect()}
    assert rows[0.0] == data.min() and rows[1.0] == data.max() and abs(rows[0.5] - np.median(data)) < 0.05
    by = {r["g"]: r["n"] for r in td.build(df, "x", scale, by="g").collect()}
    assert by == {"a": int((data < 0).sum()), None: int((data >= 0).sum())}
    assert td.build(df.where("x > 100"), "x", scale).count() == 0


def test_states(spark, tmp_path):
    df = spark.createDataFrame([(float(x), 1.0 + x % 3) for x in range(300)], "x double, w double").repartition(7)
    p = TDigestParams("K1", 50.0, 20)
    a, b = (td.state(df.where(f"x % 2 = {k}"), "x", p, "w") for k in (0, 1))
    states.save(a, str(tmp_path))
    a = states.load(spark, str(tmp_path), TDigestParams)
    row = td.merged(a, b).table.first()
    assert row["n"] == 300 and (row["least"], row["most"]) == (0.0, 299.0) and abs(sum(row["weights"]) - 600) < 1e-9 and len(row["means"]) <= 50
    assert td.merged(a, a.cleared()).table.first()["n"] == 150 and a.cleared().is_empty()
    for other in (TDigestParams("K2", 50.0, 20), TDigestParams("K1", 60.0, 20), TDigestParams("K1", 50.0, 21)):
        with pytest.raises(ValueError, match="must be equal"):
            td.merged(a, td.state(df, "x", other))
    for bad in (("K4", 10.0, 1), ("K0", 1.0, 1), ("K0", 10.0, 0)):
        with pytest.raises(ValueError):
            TDigestParams(*bad)
