"""What the operators need from the session: spreading of rows, and a folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a scan out when it has fewer splits than there are cores.

    A Parquet file of one row group is one task however large the cluster. Where the scan has splits enough, which is
    always so at scale, nothing is shuffled. Counting splits is planning only; a plan that shuffles is left as it is, for
    to count its partitions would be to run it.
    """
    plan = df._jdf.queryExecution()
    if plan.executedPlan().toString().startswith("AdaptiveSparkPlan"):
        return df
    n = cores(df.sparkSession)
    return df if plan.toRdd().getNumPartitions() >= n else df.repartition(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset and the session has no executors elsewhere."""
    found = spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    own = getattr(spark.sparkContext, "_loamline_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="loamline-")
        spark.sparkContext._loamline_dir = own
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


_written: list[str] = []


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes tables that ``cut`` has written: these, or all of this process. Results that still read them can't be used any more."""
    for path in list(_written) if paths is None else paths:
        if path in _written:
            _written.remove(path)
            delete(spark, path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``cut`` that nothing reads any more, because what was made from them has been written."""
    for t in tables:
        release(t.sparkSession, [t._cut_path])


def cut(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: a lineage of one scan, which a lost executor can't break.

    Parquet keeps it columnar, so later readers still prune columns. ``by``: a column by which the rows are laid in folders.
    """
    path = f"{shared_dir(df.sparkSession)}/loamline-{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _written.append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


