"""Session helpers: where shared files go, and how lineage is cut."""

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from yearweave.errors import ParameterFailure


@functools.cache
def _local_base(application: str) -> str:
    return tempfile.mkdtemp(prefix="yearweave-")


def shared_base(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local master, where driver and executors are one process, may go without: a temporary
    folder stands in. Anywhere else the rows would be missing on read, so it is an error.
    The session's settings are read, never written.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ParameterFailure(f"set spark.checkpoint.dir to a shared folder: master is {master}")
        base = _local_base(spark.sparkContext.applicationId)
    return base.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_base(spark)}/yearweave-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages survive the loss of any executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """Write a table once to the shared folder and read it from there."""
    path = f"{shared_dir(df.sparkSession)}/staged"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
