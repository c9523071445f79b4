"""Groups read row by row in an order, without any of them whole in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame


def _runs(groups: pa.Array) -> Iterator[tuple[str | None, int, int]]:
    """Each group of a sorted batch with where it begins and how many rows it has."""
    if groups[0].as_py() == groups[-1].as_py():
        yield groups[0].as_py(), 0, len(groups)
        return
    begin = 0
    for group, same in groupby(groups.to_pylist()):
        n = sum(1 for _ in same)
        yield group, begin, n
        begin += n


def folded(rows: DataFrame, fold: Callable[[], object], schema: str) -> DataFrame:
    """rows (group, seq and others) by group in the order of seq through an object that fold() makes for each group: its
    add(batch) takes an Arrow batch of the group's rows, and its end() follows the last; both return a batch or None.  One
    task reads a group, and Spark's sort, which spills, puts it in order: Python holds a batch and the object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            for group, begin, n in _runs(batch.column("group")):
                if state is None or group != at:
                    if state is not None and (out := state.end()) is not None:
                        yield out
                    state, at = fold(), group
                if (out := state.add(batch.slice(begin, n))) is not None:
                    yield out
        if state is not None and (out := state.end()) is not None:
            yield out

    return rows.repartition("group").sortWithinPartitions("group", "seq").mapInArrow(run, schema)
