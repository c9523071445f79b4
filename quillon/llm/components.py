"""Connected components of a table of links, by alternating large and small stars.

Each round writes its links to the shared folder, so lineage stays short; nothing is gathered on the driver but counts.
The least neighbours of all nodes are written before they are joined back: both sides of that join are then plain
shuffles, which Spark splits where one node has very many links.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .tables import written


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, of n nodes and the links a[i] - b[i]."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, before[a], least)
        np.minimum.at(label, before[b], least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (u, v) to the least neighbour of u: of its larger neighbours (large), or of u and its smaller ones."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """node, component (the least node of its component) for every node that has a link to another one.

    Links may repeat, run either way, or be loops; those with a null end are left out.  No links, no rows."""
    now = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = written(now)
    seal = None
    for _ in range(rounds):
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not found["n"] or (found["n"], found["h"]) == seal:
            break
        seal = (found["n"], found["h"])
        now = written(_star(written(_star(now, True)), False))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
