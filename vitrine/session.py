"""Session helpers: where durable intermediate results go, and when a written table counts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a session whose executors run inside the driver (local
    master) gets a folder of its own; on a cluster the setting must be given."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current is None:
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = sc.getCheckpointDir()
    return named or current


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor cannot make
    a re-run of a sampled (range) exchange give other partition bounds."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def write_table(df: DataFrame, name: str, cluster_by: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` to a fresh path in the shared folder and read it back.

    ``cluster_by`` range-partitions and sorts the rows, so that Parquet statistics prune
    reads of one key and a huge key still fills many files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}/{name}"
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    writer = df.write.mode("errorifexists")
    (writer.option("compression", codec) if codec else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` as a table of ``buckets`` buckets of ``key``, each one file sorted by it, and read it back.

    Tables with equally many buckets are joined and grouped by the key without an exchange. The key must be even: all its rows
    lie in one bucket."""
    spark = df.sparkSession
    table, path = f"{name}_{uuid.uuid4().hex}", f"{shared_dir(spark)}/tables"
    # the hash of this exchange is that of the buckets, so each task writes one file
    rows = df.repartition(buckets, key).sortWithinPartitions(key)
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", f"{path}/{table}").saveAsTable(table)
    return spark.table(table)


def is_done(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def write_once(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write unless it was: readers may know the files of a finished table."""
    if not is_done(df.sparkSession, path):
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def latest_done(spark: SparkSession, folder: str) -> int:
    """Highest n of the finished tables ``folder/n=...``; 0 if there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(root)] if fs.exists(root) else []
    return max((n for n in numbers if is_done(spark, f"{folder}/n={n}")), default=0)


def commit_tables(spark: SparkSession, store: str, tables: dict[str, DataFrame]) -> int:
    """Write ``tables`` as the next version of ``store``. Its commit record comes last: a version without one doesn't count, and
    the next try takes its place."""
    version = latest_done(spark, f"{store}/commits") + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{store}/{name}/n={version}")
    spark.createDataFrame([(version, sorted(tables))], "version INT, tables ARRAY<STRING>").coalesce(1).write.mode("overwrite").parquet(f"{store}/commits/n={version}")
    return version


def committed_tables(spark: SparkSession, store: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of the latest version of ``store``; empty ones before the first."""
    version = latest_done(spark, f"{store}/commits")
    return {name: spark.read.schema(schema).parquet(f"{store}/{name}/n={version}") if version else spark.createDataFrame([], schema)
            for name, schema in schemas.items()}
