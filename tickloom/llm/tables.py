"""Tables of a data folder and the shared folder for intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that ``stored`` has written and ``release`` hasn't deleted, by application.
_written: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.  Where none is set a temporary one is made, but only for a master that runs in this one process."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if sc._jsc.sc().getCheckpointDir().isDefined():
            return sc._jsc.sc().getCheckpointDir().get()
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tickloom-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """Writes df to the shared folder and reads it back: a cut of the lineage that outlives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder through Spark's own file system, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(spark: SparkSession) -> int:
    """How many tables ``stored`` has written that are still there."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0) -> int:
    """Deletes what ``stored`` has written (after the first ``since``); results still to be computed from it must have been written before."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    gone, paths[since:] = paths[since:], []
    for path in gone:
        delete(spark, path)
    return len(gone)
