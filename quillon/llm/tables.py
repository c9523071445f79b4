"""Where intermediate tables of the operators are written, and other plumbing that they share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows that join_few() broadcasts, at most.
BROADCAST_ROWS = 200_000
#: Spark's setting (tried on 4.1.2) by which a statement's shuffle files are deleted as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders named by work_dir(), for clear().
_made: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder that the cluster names in spark.checkpoint.dir.  Only where that is
    unset and one process does all, as in tests, a folder of this machine is set; RuntimeError where it is unset on a
    cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/quillon-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables that this process has made so far.  Call it when the results are written: results
    are DataFrames that read those tables."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, codec: str = "zstd", free: bool = False) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends there, and a lost executor costs no earlier work.
    With free, the shuffle files that it was made from are deleted as soon as it is written; else they stay until the
    driver's JVM happens to collect garbage."""
    spark = df.sparkSession
    path = work_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    if free:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if free and before is None:
            spark.conf.unset(CLEANUP)
        elif free:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def join_few(left: DataFrame, few: DataFrame, key: str, spread: Column, salts: int = 16) -> DataFrame:
    """left, left-joined on key with a written table that is expected to be small: by broadcast, if it is counted to have
    up to BROADCAST_ROWS rows of a few numbers and short texts each; beyond, shuffled by key and by salts of `spread`, so
    that a key of very many rows is several tasks."""
    if few.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(few), key, "left")
    few = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("__salt", F.pmod(spread, F.lit(salts)).cast("int")).join(few, [key, "__salt"], "left").drop("__salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession, least: int = 1) -> int:
    """How many tasks a shuffle has; the cluster sets it to suit the size of its inputs."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_remainder(name: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, mod modulus; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(name).cast("string"), F.lit("")), "UTF-8")) % modulus


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n numbers that hash partitioning sends to n different tasks, the k-th to task k.

    Numbers of buckets would meet in some tasks and leave others without any; a bucket's row carries one of these."""
    tries = 16 * n + 64
    while True:
        found = spark.range(tries).groupBy(F.expr(f"pmod(hash(id), {n})").alias("task")).agg(F.min("id").alias("id")).orderBy("task").collect()
        if len(found) == n:
            return [r["id"] for r in found]
        tries *= 2
