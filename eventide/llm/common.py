"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the session names in spark.checkpoint.dir. Only a session on one machine may name
    none, and then gets a temporary one: on a cluster, no other machine could read what is written there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, and every executor can read the result. tidy:
    the shuffle files of the write go when it is over, not when the driver next collects its garbage."""
    spark, setting = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = shared_folder(spark), spark.conf.get(setting)
    if tidy:
        spark.conf.set(setting, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.set(setting, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote. Only for tables on which nothing depends any more that isn't written itself."""
    delete(df.sparkSession, df.folder)


def free_name(name: str, taken: Iterable[str]) -> str:
    """name, with underscores behind it until no column of taken has it; column names don't tell case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one struct: carried so, they can't clash with those that an operator makes."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def order_hash(*cols: Column | str) -> Column:
    """A fixed pseudo-random order of rows."""
    return F.xxhash64(*cols)
