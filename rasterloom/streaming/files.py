"""The row-wise pipeline on files as they arrive: a deployment mode, without state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, glob: str | None = None, per_batch: int = 1000) -> DataFrame:
    """(path, modificationTime, length, content) of new files below a folder."""
    read = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch)
    if glob:
        read = read.option("pathGlobFilter", glob)
    return read.load(folder)


def run(files: DataFrame, stages: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes stages(files) as Parquet, each batch once; once: what is there now, then stop."""
    write = stages(files).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (write.trigger(availableNow=True) if once else write).start()
