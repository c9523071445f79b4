"""Hash families and double hashing as column expressions.

A family gives non-negative hashes H(i, x) of a column for salts i:

* ``xxhash64``: 63 bits, compiled by Catalyst; the default.
* ``md5_60``: the first 60 bits of md5("<i>:<text of x>"), which other SQL engines can compute too.  For integers and
  strings; cast doubles to decimals first, as their text differs between engines.
* ``sip13``: SipHash-1-3 with a zero key over 64 bits, by an Arrow function in numpy, for integers as little-endian
  bytes; kept for comparing with published counts.

Every family hashes NULL to NULL, so that aggregates ignore it and membership of it is unknown.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

BITS = {"xxhash64": 63, "md5_60": 60, "sip13": 64}


def canonical(col: Column | str, kind: str | None = None) -> Column:
    """A column in one type, so that equal values of both sides of a join hash alike.  kind: a type to cast to first."""
    col = F.col(col) if isinstance(col, str) else col
    return col.cast(kind) if kind else col


def hashed(col: Column | str, salt: int = 0, family: str = "xxhash64") -> Column:
    """H(salt, col), or NULL for NULL."""
    col = canonical(col)
    if family == "xxhash64":
        value = F.xxhash64(F.lit(salt), col).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
    elif family == "md5_60":
        text = F.concat(F.lit(f"{salt}:"), col.cast("string"))
        value = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    elif family == "sip13":
        value = sip13(col.cast("bigint"), F.lit(salt))
    else:
        raise ValueError(f"no hash family {family}")
    return F.when(col.isNotNull(), value)


def whole(col: Column | str, salt: int = 0, family: str = "xxhash64") -> Column:
    """H(salt, col) with all of the family's bits: of 64, the upper one is the sign."""
    col = canonical(col)
    return F.when(col.isNotNull(), F.xxhash64(F.lit(salt), col)) if family == "xxhash64" else hashed(col, salt, family)


def constant(salt: int, family: str = "xxhash64") -> Column:
    """H(salt) of no element, which is the empty string, or 0 where only integers are hashed."""
    return hashed(F.lit(0 if family == "sip13" else ""), salt, family)


def constant_md5(salt: int) -> int:
    """constant(salt, "md5_60") as a number."""
    return int(hashlib.md5(f"{salt}:".encode()).hexdigest()[:15], 16)


def positions(col: Column | str, m: int, k: int, family: str = "xxhash64") -> Column:
    """k positions in [0, m) by enhanced double hashing: (h1 + i h2 + f(i)) mod m, where f(i) does not depend on the
    element.  Positions may repeat.  NULL for NULL."""
    if m < 1 or k < 1:
        raise ValueError("m and k must be greater than 0")
    h1, h2 = (F.pmod(hashed(col, s, family), F.lit(m)) for s in (0, 1))
    spots = [F.pmod(h1 + F.lit(i % m) * h2 + F.pmod(constant(i + 2, family), F.lit(m)), F.lit(m)) for i in range(k)]
    return F.when(canonical(col).isNotNull(), F.array(*spots))


def typed(col: Column, type_name: str) -> Column:
    """A value that carries its type, for sketches of several types: equal values of different types hash differently,
    and NULL stays NULL."""
    return F.when(col.isNotNull(), F.concat(F.lit(f"{type_name}|"), col.cast("string")))


def sip13_of(data: np.ndarray, width: int) -> np.ndarray:
    """SipHash-1-3 with key 0 of each row: `data` holds little-endian 8-byte words (rows by words), of which the first
    `width` bytes count and the rest are 0."""
    u = np.uint64

    def turn(x: np.ndarray, n: int) -> np.ndarray:
        return (x << u(n)) | (x >> u(64 - n))

    # The words that the hash starts from, for a zero key.
    v0, v1, v2, v3 = (np.full(len(data), c, u) for c in (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573))

    def rounds(n: int) -> None:
        nonlocal v0, v1, v2, v3
        for _ in range(n):
            v0 = v0 + v1
            v1 = turn(v1, 13) ^ v0
            v0 = turn(v0, 32)
            v2 = v2 + v3
            v3 = turn(v3, 16) ^ v2
            v0 = v0 + v3
            v3 = turn(v3, 21) ^ v0
            v2 = v2 + v1
            v1 = turn(v1, 17) ^ v2
            v2 = turn(v2, 32)

    full = width // 8
    last = u((width & 0xFF) << 56)
    words = [data[:, i] for i in range(full)] + [(data[:, full] if width % 8 else np.zeros(len(data), u)) | last]
    for m in words:
        v3 = v3 ^ m
        rounds(1)
        v0 = v0 ^ m
    v2 = v2 ^ u(0xFF)
    rounds(3)
    return v0 ^ v1 ^ v2 ^ v3


def _sip13(value: pd.Series, width: pd.Series) -> pd.Series:
    v = value.fillna(0).to_numpy(np.int64).view(np.uint64)
    w = int(width.iloc[0]) if len(width) else 8
    if w == 4:
        out = sip13_of((v & np.uint64(0xFFFFFFFF)).reshape(-1, 1), 4)
    elif w == 8:
        out = sip13_of(v.reshape(-1, 1), 8)
    else:
        out = sip13_of(np.stack([np.full(len(v), w, np.uint64), v], axis=1), 16)
    return pd.Series(out.view(np.int64)).where(value.notna().to_numpy())


def sip13(value: Column, width: Column) -> Column:
    """SipHash-1-3 of integers, 4 or 8 bytes wide, as a signed long; any other `width` is a salt that is hashed before an
    8-byte integer."""
    return F.pandas_udf(_sip13, "bigint")(value, width)
