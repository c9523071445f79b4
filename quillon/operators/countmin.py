"""Count-Min sketches: cells are sums over the elements that fall in them, one column in each of d rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import positions
from ..functions.params import CountMinParams
from ..plans.numbering import numbered
from ..sources.states import State, check_same

#: Cells of a state that a query broadcasts, at most.
BROADCAST_CELLS = 1 << 20
#: Rows of a run of running().
RUN_ROWS = 1 << 20


def _cells(df: DataFrame, col: str | Column, params: CountMinParams, *keep: Column) -> DataFrame:
    return df.select(*keep, F.posexplode(positions(col, params.w, params.d, params.family)).alias("row", "col"))


def build(df: DataFrame, col: str, params: CountMinParams, n: str | None = None, type_tag: str = "any") -> State:
    """row, col, cnt of all values that are not NULL, each counted once or n times.  Values are added up before their
    cells are, so a frequent value shuffles little.  A sum beyond a long raises."""
    times = F.count("*") if n is None else F.sum(F.col(n).cast("bigint"))
    values = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("__v")).agg(times.alias("__n"))
    cells = _cells(values, "__v", params, F.col("__n")).groupBy("row", "col").agg(F.sum("__n").alias("cnt"))
    return State(cells, params, type_tag)


def merge(a: State, b: State) -> State:
    check_same(a, b)
    return a.with_table(a.table.unionByName(b.table).groupBy("row", "col").agg(F.sum("cnt").alias("cnt")))


def query(state: State, df: DataFrame, col: str, name: str = "estimate") -> DataFrame:
    """The distinct values of df that are not NULL with their estimated counts: the least of their d cells."""
    p = state.params
    values = df.select(F.col(col)).where(F.col(col).isNotNull()).distinct()
    table = F.broadcast(state.table) if p.w * p.d <= BROADCAST_CELLS else state.table
    found = _cells(values, col, p, F.col(col)).join(table, ["row", "col"], "left")
    return found.groupBy(col).agg(F.min(F.coalesce("cnt", F.lit(0))).alias(name))


def running(df: DataFrame, col: str, seq: str, params: CountMinParams, n: str | None = None, name: str = "estimate") -> DataFrame:
    """seq, estimate: what adding each row returns, in the order of seq (unique): the least of its cells' sums so far; rows
    whose value is NULL are left out.  Of up to RUN_ROWS rows, a cell's are one window.  More are numbered and cut into
    runs of RUN_ROWS; a cell's sums of whole runs are added up first, and then its rows within each run, so no window is
    longer than a run or than there are runs."""
    times = F.lit(1) if n is None else F.col(n).cast("bigint")
    rows = df.where(F.col(col).isNotNull()).select(F.col(col).alias("__v"), F.col(seq), times.alias("__n"))
    if rows.count() <= RUN_ROWS:
        cells = _cells(rows, "__v", params, F.col(seq), F.col("__n"))
        w = Window.partitionBy("row", "col").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
        return cells.withColumn("__sum", F.sum("__n").over(w)).groupBy(seq).agg(F.min("__sum").alias(name))
    rows = numbered(rows, seq, name="__seq").withColumn("__run", F.floor((F.col("__seq") - 1) / RUN_ROWS))
    cells = _cells(rows, "__v", params, F.col(seq), F.col("__seq"), F.col("__run"), F.col("__n"))
    runs = cells.groupBy("row", "col", "__run").agg(F.sum("__n").alias("__all"))
    earlier = Window.partitionBy("row", "col").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("row", "col", "__run", F.coalesce(F.sum("__all").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy("row", "col", "__run").orderBy("__seq").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.withColumn("__sum", F.sum("__n").over(within)).join(runs, ["row", "col", "__run"])
    return sums.groupBy(seq).agg(F.min(F.col("__before") + F.col("__sum")).alias(name))
