"""Sizes and checks of the sketches' parameters; all are computed on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class BloomParams:
    """m bits and k hash functions."""

    m: int
    k: int
    family: str = "xxhash64"

    def __post_init__(self) -> None:
        _need(self.m >= 1 and self.k >= 1, "m and k must be greater than 0")

    @staticmethod
    def for_properties(n: int, p: float, family: str = "xxhash64") -> BloomParams:
        """For n elements and a false positive rate p; k and m are cut to whole numbers, but at least 1."""
        _need(n > 0, "n must be greater than 0")
        _need(0 < p < 1, "p must be greater than 0 and smaller than 1")
        return BloomParams(max(1, int(-n * math.log(p) / math.log(2) ** 2)), max(1, int(-math.log2(p))), family)


#: Bits of each hash family that a fingerprint can use.
HASH_BITS = {"xxhash64": 64, "md5_60": 60, "sip13": 64}


@dataclass(frozen=True)
class CuckooParams:
    """Buckets of `bucketsize` slots, and fingerprints of `l_fingerprint` bits."""

    bucketsize: int
    n_buckets: int
    l_fingerprint: int
    family: str = "xxhash64"

    def __post_init__(self) -> None:
        _need(self.bucketsize >= 2, "bucketsize must be greater or equal than 2")
        _need(self.n_buckets >= 2 and self.n_buckets & (self.n_buckets - 1) == 0, "n_buckets must be a power of 2 and greater or equal than 2")
        most = HASH_BITS[self.family]
        _need(1 < self.l_fingerprint <= most, f"l_fingerprint must be greater than 1 and at most {most}")

    @staticmethod
    def for_properties(false_positive_rate: float, n: int, bucketsize: int = 4, family: str = "xxhash64") -> CuckooParams:
        """For n elements; buckets of 4 or 8 slots, filled up to .95 or .98."""
        _need(0 < false_positive_rate < 1, "false_positive_rate must be greater than 0 and smaller than 1")
        _need(n > 0, "n must be greater than 0")
        load = {4: 0.95, 8: 0.98}.get(bucketsize)
        _need(load is not None, "bucketsize must be 4 or 8")
        buckets = max(2, 1 << max(0, math.ceil(n / load) - 1).bit_length())
        return CuckooParams(bucketsize, buckets, math.ceil(math.log2(2 * bucketsize / false_positive_rate)), family)


@dataclass(frozen=True)
class QuotientParams:
    """2 ** bits_quotient slots of bits_remainder bits."""

    bits_quotient: int
    bits_remainder: int
    family: str = "xxhash64"

    def __post_init__(self) -> None:
        _need(self.bits_quotient > 0, "bits_quotient must be greater than 0")
        _need(self.bits_remainder > 0, "bits_remainder must be greater than 0")
        most = HASH_BITS[self.family]
        _need(self.bits_quotient + self.bits_remainder <= most, f"bits_quotient + bits_remainder must be at most {most}")


@dataclass(frozen=True)
class CountMinParams:
    """w columns and d rows."""

    w: int
    d: int
    family: str = "xxhash64"

    def __post_init__(self) -> None:
        _need(self.w >= 1 and self.d >= 1, "w and d must be greater than 0")

    @staticmethod
    def for_point_queries(epsilon: float, delta: float, family: str = "xxhash64") -> CountMinParams:
        """An estimate is at most epsilon * N too high with a chance over 1 - delta."""
        _need(epsilon > 0, "epsilon must be greater than 0")
        _need(0 < delta < 1, "delta must be greater than 0 and smaller than 1")
        return CountMinParams(math.ceil(math.e / epsilon), math.ceil(math.log(1 / delta)), family)


@dataclass(frozen=True)
class HllParams:
    """2 ** b registers."""

    b: int
    family: str = "xxhash64"

    def __post_init__(self) -> None:
        _need(4 <= self.b <= 18, "b must be at least 4 and at most 18")

    @property
    def m(self) -> int:
        return 1 << self.b

    @property
    def relative_error(self) -> float:
        return math.sqrt(3 * math.log(2) - 1) / math.sqrt(self.m)


@dataclass(frozen=True)
class LossyParams:
    """Windows of `width` elements; epsilon is the error share."""

    epsilon: float
    width: int

    @staticmethod
    def with_epsilon(epsilon: float) -> LossyParams:
        _need(0 < epsilon < 1, "epsilon must be greater than 0 and smaller than 1")
        return LossyParams(epsilon, math.ceil(1 / epsilon))

    @staticmethod
    def with_width(width: int) -> LossyParams:
        _need(width > 0, "width must be greater than 0")
        return LossyParams(1 / width, width)


@dataclass(frozen=True)
class TDigestParams:
    """A scale function by name (K0, K1, K2, K3), its delta, and how many rows are taken in between compressions."""

    scale: str = "K1"
    delta: float = 100.0
    max_backlog: int = 10_000

    def __post_init__(self) -> None:
        _need(self.scale in ("K0", "K1", "K2", "K3"), "scale must be K0, K1, K2 or K3")
        _need(self.delta > 1 and math.isfinite(self.delta), f"delta ({self.delta}) must be greater than 1 and finite")
        _need(self.max_backlog > 0, "max_backlog must be greater than 0")


@dataclass(frozen=True)
class ReservoirParams:
    """k rows, known by the unique column id; samples of equal seed and family can be merged."""

    k: int
    id: str
    seed: int = 0
    family: str = "xxhash64"

    def __post_init__(self) -> None:
        _need(self.k >= 1, "k must be greater than 0")
