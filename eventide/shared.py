"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting for deleting the shuffle files of a query when it is over.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_folder(spark: SparkSession) -> str:
    """The name of a new folder below the one of spark.checkpoint.dir. Only a session on one machine may name none, and
    then gets a temporary one: on a cluster, no other machine could read what is written there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, and every executor can read the result. tidy:
    the shuffle files of the write go when it is over, not when the driver next collects its garbage."""
    spark = df.sparkSession
    path, before = new_folder(spark), spark.conf.get(TIDY)
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.set(TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote. Only for tables on which nothing depends any more that isn't written itself."""
    delete(df.sparkSession, df.folder)
