"""Tables between the steps of a job, in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Local mode has one machine, whose own temporary folder serves where none is named; a cluster
    without a shared folder is an error, as executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = spark.sparkContext._jvm.java.nio.file.Files.createTempDirectory(
        "foliomill-", spark.sparkContext._gateway.new_array(spark._jvm.java.nio.file.attribute.FileAttribute, 0)
    ).toString()
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one; the folder goes when the application ends."""
    path = f"{shared_folder(spark)}/foliomill-{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: lineage ends here, and sizes are known.

    The table goes when the application ends, or earlier by forget().
    """
    spark = df.sparkSession
    path = own_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables made by written() that nothing will read again, lost executors included."""
    for frame in frames:
        spark = frame.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(frame.written_to)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Rows of a written table that may go to every executor.
SENT_ROWS = 100_000


def sent(frame: DataFrame) -> DataFrame:
    """A written table of short rows, marked for every executor while it has few of them, else as it is."""
    return F.broadcast(frame) if frame.count() <= SENT_ROWS else frame
