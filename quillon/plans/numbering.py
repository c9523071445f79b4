"""Row numbers 1, 2, ... over a whole table, without a single task for all rows."""

from __future__ import annotations

import tempfile
import uuid
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir; where that is unset and one process does all, as in tests, below a
    folder of this machine.  RuntimeError where it is unset on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quillon-{uuid.uuid4().hex}"


def numbered(df: DataFrame, *order: str, name: str = "seq") -> DataFrame:
    """df with the place of each row in the order of the given columns, which together are unique.

    Rows are dealt to ranges, numbered within them and written; the sizes of the ranges, as many as tasks, are gathered
    on the driver and added up."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    path = shared_folder(spark)
    ranged.write.parquet(path)
    ranged = spark.read.parquet(path)
    sizes = {r["__p"]: r["count"] for r in ranged.groupBy("__p").count().collect()}
    places = sorted(sizes)
    offsets = list(zip(places, [0, *accumulate(sizes[p] for p in places)][: len(places)], strict=True))
    starts = F.broadcast(spark.createDataFrame(offsets, "__p int, __o bigint"))
    return ranged.join(starts, "__p").withColumn(name, F.col("__o") + F.col("__i") + 1).drop("__p", "__i", "__o")
