"""Lossy counting as windows over pre-added counts.

Elements come in windows of `width`.  An item's entry (f, delta) starts in window b with delta = b - 1, and is dropped at
the end of a window w where f + delta <= w.  Let S be an item's count before window b and g = S - b.  Then an entry that
began in window s is gone when the item comes again in window b exactly if g(b) <= g(s); so entries begin exactly where g
is not above any earlier g, and the entry at the end began at the last place of the least g.  Counts are added up by item
and window before anything is ordered, and items never interact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.params import LossyParams

#: Counting windows of a run: an item's are ordered run by run, so that a frequent item is not one task.
RUN_WINDOWS = 4096


def _windows(df: DataFrame, col: str, seq: str, params: LossyParams, last: int) -> DataFrame:
    """item, b, cnt, first (the first seq), before (the item's count before), starts (whether an entry begins here)."""
    b = F.ceil(F.col(seq) / F.lit(params.width)).cast("bigint")
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("item"), b.alias("b")).agg(F.count("*").alias("cnt"), F.min(seq).alias("first"))
    within = Window.partitionBy("item").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    if last // params.width < RUN_WINDOWS:
        made = counts.withColumn("before", F.coalesce(F.sum("cnt").over(within), F.lit(0))).withColumn("g", F.col("before") - F.col("b"))
        least = F.min("g").over(within)
        return made.withColumn("starts", least.isNull() | (F.col("g") <= least))
    counts = counts.withColumn("run", F.floor(F.col("b") / RUN_WINDOWS))
    runs = Window.partitionBy("item").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("item", "run").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)

    def earlier(rows: DataFrame, of: str, how, name: str) -> DataFrame:
        """rows with how(of) of the item's earlier windows: of the runs before, and of those within the run."""
        whole = rows.groupBy("item", "run").agg(how(of).alias("__run"))
        whole = whole.select("item", "run", how("__run").over(runs).alias("__before"))
        return rows.withColumn("__within", how(of).over(within)).join(whole, ["item", "run"]).withColumn(name, how_both[how](F.col("__before"), F.col("__within"))).drop("__before", "__within")

    how_both = {F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), F.min: F.least}
    made = earlier(counts, "cnt", F.sum, "before").withColumn("g", F.col("before") - F.col("b"))
    return earlier(made, "g", F.min, "__least").withColumn("starts", F.col("__least").isNull() | (F.col("g") <= F.col("__least"))).drop("__least", "run")


def state(df: DataFrame, col: str, seq: str, params: LossyParams, n: int | None = None) -> DataFrame:
    """item, f, delta after all rows.  seq numbers the rows 1, 2, ... without gaps (see plans.numbering); n is the last
    number, if it is known.  NULL items are left out, but keep their number."""
    last = df.agg(F.max(seq)).first()[0] if n is None else n
    rows = _windows(df, col, seq, params, last or 0)
    total = rows.groupBy("item").agg(F.sum("cnt").alias("total"), F.max(F.when(F.col("starts"), F.struct("b", "before"))).alias("s"))
    out = total.select("item", (F.col("total") - F.col("s.before")).alias("f"), (F.col("s.b") - 1).alias("delta"))
    return out.where(F.col("f") + F.col("delta") > (last or 0) // params.width)


def query(entries: DataFrame, threshold: float, params: LossyParams, n: int) -> DataFrame:
    """The entries whose f is at least (threshold - epsilon) * n, rounded up, and at least 0."""
    import math

    return entries.where(F.col("f") >= max(0, math.ceil(round((threshold - params.epsilon) * n, 9))))


def was_new(df: DataFrame, col: str, seq: str, params: LossyParams, name: str = "is_new") -> DataFrame:
    """df with whether adding the row starts an entry; NULL for a NULL item."""
    last = df.agg(F.max(seq)).first()[0] or 0
    starts = _windows(df, col, seq, params, last).where("starts").select(F.col("first").alias("__s"), F.lit(True).alias("__new"))
    out = df.join(starts, df[seq] == F.col("__s"), "left")
    return out.withColumn(name, F.when(F.col(col).isNotNull(), F.coalesce("__new", F.lit(False)))).drop("__s", "__new")
