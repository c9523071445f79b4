"""Sketches of streams: each micro-batch is a partial state, merged into a state table; and windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import countmin, hll
from ..plans.numbering import shared_folder
from ..sources.states import State


def merged(stream: DataFrame, build: Callable[[DataFrame], State], merge: Callable[[State, State], State], path: str) -> State:
    """The state of everything that the stream has now, kept as versions below path: version i + 1 is version i merged
    with micro-batch i.  A batch that is run again after a failure writes its version again, from the same one before."""
    spark = stream.sparkSession
    made: list[State] = []

    def step(batch: DataFrame, number: int) -> None:
        state = build(batch)
        if number:
            state = merge(state.with_table(spark.read.parquet(f"{path}/{number - 1}")), state)
        state.table.write.mode("overwrite").parquet(f"{path}/{number}")
        made[:] = [state.with_table(spark.read.parquet(f"{path}/{number}"))]

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not made:
        raise ValueError("the stream has no rows")
    return made[0]


def replayed(spark: SparkSession, table: DataFrame, files: int = 4) -> DataFrame:
    """A static table as a stream of one file a micro-batch."""
    path = shared_folder(spark)
    table.repartition(files).write.parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)


def hll_of(stream: DataFrame, col: str, params, by: list[str] | None = None) -> State:
    path = shared_folder(stream.sparkSession)
    return merged(stream, lambda b: hll.build(b, col, params, by), lambda x, y: hll.merge(x, y, by), path)


def countmin_of(stream: DataFrame, col: str, params) -> State:
    path = shared_folder(stream.sparkSession)
    return merged(stream, lambda b: countmin.build(b, col, params), countmin.merge, path)


def windowed_distinct(stream: DataFrame, ts: str, col: str, window: str, late: str, rsd: float = 0.05) -> DataFrame:
    """start, estimate: distinct values in tumbling windows, dropped from memory once `late` has passed."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    found = timed.groupBy(F.window("__ts", window)).agg(F.approx_count_distinct(col, rsd).alias("estimate"))
    return found.select(F.col("window.start").alias("start"), "estimate")
