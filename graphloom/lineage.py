"""Cutting lineage: tables written to the folder that the session names in spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import atexit
import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, whatever its working folder. On a cluster without that
    path, give the package to spark-submit as --py-files."""
    here, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark runs in one process, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        at = spark._jvm.org.apache.hadoop.fs.Path(found)
        if at.toUri().getScheme() is None:  # what Spark takes it for, said in full for those who open files themselves
            whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
            found = found if whole.getScheme() == "file" else whole.toString()
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"/tmp/checkpoints/graphloom-{os.getpid()}"
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df and read it back: a lost executor then costs its own tasks, not the plan's history."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_buckets: list[tuple[SparkSession, str]] = []


def dealt(df: DataFrame, key: str, name: str = "dealt") -> DataFrame:
    """Write df in as many buckets of `key` as shuffles have partitions, sorted within: tables dealt by keys of one type join on them without a shuffle.
    A table of the session's catalog whose files lie in the shared folder."""
    spark, n = df.sparkSession, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path, table = new_path(spark, name), f"graphloom_{uuid.uuid4().hex}"
    # One file per bucket: rows are dealt by the hash that names the buckets.
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    _buckets.append((spark, table))
    return spark.table(table)


#: Bytes of input files for each partition of a shuffle, where partitions are as many as the input asks for.
PER_PARTITION = 32 << 20


def share(*inputs: DataFrame) -> int:
    """So many partitions that one has no more than its share of the files behind `inputs`, each file counted once."""
    sizes = {}
    for df in inputs:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        for leaf in (leaves.apply(i) for i in range(leaves.size())):
            sizes[leaf.semanticHash()] = int(str(leaf.stats().sizeInBytes()))
    return -(-sum(x for x in sizes.values() if x < 1 << 60) // PER_PARTITION)  # larger: Spark doesn't know


@contextmanager
def spread(*inputs: DataFrame):
    """Within it, shuffles and dealt() have so many partitions that one has no more than its share of the files behind `inputs`, if the session has fewer: a task's memory doesn't grow with the input."""
    spark = inputs[0].sparkSession
    before, bytes_ = spark.conf.get("spark.sql.shuffle.partitions"), 0
    for df in inputs:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        bytes_ += sum(x for x in sizes if x < 1 << 60)  # larger: Spark doesn't know
    spark.conf.set("spark.sql.shuffle.partitions", str(max(int(before), -(-bytes_ // PER_PARTITION))))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def release(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing will read again."""
    for df in tables:
        for path in df.inputFiles()[:1]:
            remove(df.sparkSession, path.rpartition("/")[0])


def remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended; the folder is then the cluster's to clean
        pass


@atexit.register
def _remove_all() -> None:
    for spark, table in _buckets:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # as below
            pass
    for spark, path in _made:
        remove(spark, path)
