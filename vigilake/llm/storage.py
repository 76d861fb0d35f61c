"""Tables written to the shared checkpoint folder, to cut lineage and to survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session, as in tests, gets a temporary one
    of its own; on a cluster, whose machines share no temporary folder, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_already = spark.sparkContext.getCheckpointDir()
        if set_already:
            return set_already
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vigilake-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def written(frame: DataFrame, name: str) -> DataFrame:
    """`frame`, computed once into Parquet under the shared folder and read from there."""
    path = f"{shared_dir(frame.sparkSession).rstrip('/')}/vigilake/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Delete the files of a table made by `written`; nothing may read it after."""
    spark = frame.sparkSession
    for file in frame.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
