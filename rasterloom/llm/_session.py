"""Session settings that the operators need."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset on one machine, as in tests, a folder of this process."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="checkpoints-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def prepared(spark: SparkSession) -> SparkSession:
    """The session with a checkpoint folder, and Arrow batches of few rows: texts may be long."""
    folder = shared_folder(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return spark


def discarded_at_exit(spark: SparkSession, path: str) -> None:
    """Has the file system remove a folder that exists when the session's JVM ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def saved(df: DataFrame) -> DataFrame:
    """df as compressed Parquet in the shared folder: cuts the lineage, and later reads take only the columns they need."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    discarded_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def half(column: str) -> Column:
    """A second key that sums aren't dealt by: both sides of a join are dealt anew, so Spark can split hot keys."""
    return F.shiftrightunsigned(column, 32).alias("half")
