"""Sketch states as tables with their parameters: saved as Parquet, read back, and checked before they are merged."""

from __future__ import annotations

import dataclasses
import json
import uuid
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

PUBLISHED = "number bigint, folder string, sketch string, params string"


@dataclasses.dataclass(frozen=True)
class State:
    """A state table, the parameters it was made with, and the type of its elements."""

    table: DataFrame
    params: Any
    type_tag: str = "any"

    def with_table(self, table: DataFrame) -> State:
        return dataclasses.replace(self, table=table)

    def is_empty(self) -> bool:
        return self.table.isEmpty()

    def cleared(self) -> State:
        """The state of nothing, with the same parameters."""
        return self.with_table(self.table.where(F.lit(False)))


def check_same(a: State, b: State) -> None:
    """Raise ValueError unless states may be merged."""
    if type(a.params) is not type(b.params):
        raise ValueError("states are of different sketches")
    for field in dataclasses.fields(a.params) if dataclasses.is_dataclass(a.params) else ():
        x, y = getattr(a.params, field.name), getattr(b.params, field.name)
        if x != y:
            raise ValueError(f"{field.name} must be equal (left={x}, right={y})")
    if a.type_tag != b.type_tag:
        raise ValueError(f"element types must be equal (left={a.type_tag}, right={b.type_tag})")


def save(state: State, path: str) -> None:
    """A new version of the state in the folder path.  Its table is written to a folder of its own; then one row with its
    parameters and that folder's name is added to the published versions.  A job that fails between leaves the version
    from before as it was."""
    spark = state.table.sparkSession
    meta = json.dumps({"type_tag": state.type_tag, **dataclasses.asdict(state.params)})
    try:
        number = spark.read.schema(PUBLISHED).parquet(f"{path}/published").agg(F.max("number")).first()[0] or 0
    except AnalysisException:
        number = 0
    folder = f"table-{uuid.uuid4().hex}"
    state.table.write.parquet(f"{path}/{folder}")
    row = [(number + 1, folder, type(state.params).__name__, meta)]
    spark.createDataFrame(row, PUBLISHED).coalesce(1).write.mode("append").parquet(f"{path}/published")


def load(spark: SparkSession, path: str, params_type: type) -> State:
    """The last saved version of a state; ValueError where it is of another sketch."""
    row = spark.read.schema(PUBLISHED).parquet(f"{path}/published").orderBy(F.desc("number"), "folder").first()
    if row["sketch"] != params_type.__name__:
        raise ValueError(f"{path} holds a state of {row['sketch']}")
    meta = json.loads(row["params"])
    tag = meta.pop("type_tag")
    return State(spark.read.parquet(f"{path}/{row['folder']}"), params_type(**meta), tag)
