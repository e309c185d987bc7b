"""Readers of annotation tables, manifests, lists and nested JSON. All take explicit schemas and fail on rows that don't
fit them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREDICTION_HEADER = ["Audiofilename", "Starttime", "Endtime"]
SELECTION_NAMES = {"Begin Time (s)": "begin_s", "End Time (s)": "end_s", "Annotation": "annotation", "Low Freq (Hz)": "low_hz", "High Freq (Hz)": "high_hz", "Channel": "channel", "Original Filename": "original_file"}
SELECTION_TYPES = {"begin_s": "double", "end_s": "double", "low_hz": "double", "high_hz": "double", "channel": "int"}


class HeaderError(ValueError):
    """A file's columns are not those that were asked for."""


def delimited(spark: SparkSession, path, schema, sep: str = ",", header: bool = True) -> DataFrame:
    """A delimited file of a given schema (CSV, TSV, semicolons; without a header the names are the schema's)."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, mode="FAILFAST", enforceSchema=True)


def as_text(spark: SparkSession, path, sep: str = ",") -> DataFrame:
    """All columns as they are written; names from the header."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=False)


def predictions(spark: SparkSession, path) -> DataFrame:
    """file_id, begin_s, end_s of prediction files, whose header must be exactly PREDICTION_HEADER."""
    raw = as_text(spark, path)
    if raw.columns != PREDICTION_HEADER:
        raise HeaderError(f"{raw.columns} instead of {PREDICTION_HEADER}")
    return raw.select(F.col("Audiofilename").alias("file_id"), F.col("Starttime").cast("double").alias("begin_s"), F.col("Endtime").cast("double").alias("end_s"))


def first_file(spark: SparkSession, path) -> str | None:
    """A file below a folder, by one listing for each level; None if path is no single folder or has none. With its header
    as the schema, Spark needn't list all files a second time to find one."""
    if not isinstance(path, str):
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    while system.exists(at) and system.getFileStatus(at).isDirectory():
        found, following = system.listStatusIterator(at), None
        while following is None and found.hasNext():
            entry = found.next()
            if entry.getPath().getName()[0] not in "._" and (entry.isDirectory() or entry.getLen()):
                following = entry.getPath()
        if following is None:
            return None
        at = following
    return at.toString() if system.exists(at) else None


def selection_table(spark: SparkSession, path, default_channel: int | None = None) -> DataFrame:
    """A tab-separated selection table with short names; the path it came from is file_path."""
    first = first_file(spark, path)
    names = None if first is None else as_text(spark, first, sep="\t").schema
    raw = as_text(spark, path, sep="\t") if names is None else spark.read.csv(path, schema=names, sep="\t", header=True)
    named = raw.select(*(F.col(f"`{c}`").alias(SELECTION_NAMES.get(c, c)) for c in raw.columns), F.col("_metadata.file_path").alias("file_path"))
    for column, kind in SELECTION_TYPES.items():
        if column in named.columns:
            named = named.withColumn(column, F.col(column).cast(kind))
    return named if default_channel is None or "channel" in named.columns else named.withColumn("channel", F.lit(default_channel))


def text_list(spark: SparkSession, path) -> DataFrame:
    """The lines of a text file without the blanks around them; blank ones are left out."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def interval_json(json: Column) -> Column:
    """{file: [{start, end, label}]} as an array of rows, times in milliseconds."""
    parsed = F.from_json(json, "map<string, array<struct<start: double, end: double, label: string>>>")
    return F.flatten(F.transform(F.map_entries(parsed), lambda e: F.transform(e["value"], lambda x: F.struct(e["key"].alias("file_id"), (x["start"] / 1000).alias("begin_s"), (x["end"] / 1000).alias("end_s"), x["label"].alias("label")))))


def interval_json_file(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.inline(interval_json(F.col("value"))))


def set_metadata(spark: SparkSession, path) -> DataFrame:
    """dataset, set_id, class, file_id of {dataset: {set: {class: [file]}}}."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, map<string, array<string>>>>").alias("m"))
    sets = raw.select(F.explode("m").alias("dataset", "sets")).select("dataset", F.explode("sets").alias("set_id", "classes"))
    return sets.select("dataset", "set_id", F.explode("classes").alias("class", "files")).select("dataset", "set_id", "class", F.explode("files").alias("file_id"))


def report_scores(spark: SparkSession, path) -> DataFrame:
    """file_id and scores of a report's scores_per_audiofile."""
    kind = "scores_per_audiofile map<string, map<string, double>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("r"))
    return raw.select(F.explode("r.scores_per_audiofile").alias("file_id", "scores"))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, folder and name of the files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))


def subsets(listed: DataFrame) -> DataFrame:
    """file (folder/name) and subset of a listing: the folder tells the subset (key=value folders: the value)."""
    return listed.select(F.concat_ws("/", "folder", "name").alias("file"), F.regexp_replace("folder", "^[^=]*=", "").alias("subset")).distinct()


def unpivot_classes(wide: DataFrame, keys: list[str], fixed: list[str]) -> DataFrame:
    """Wide annotations (a column a class) as keys, class, q."""
    classes = [c for c in wide.columns if c not in (*keys, *fixed)]
    return wide.unpivot(keys, classes, "class", "q")


def embeddings(spark: SparkSession, path) -> DataFrame:
    """path, segment and embedding of Parquet files of clip embeddings."""
    return spark.read.schema(T.StructType([T.StructField("path", T.StringType()), T.StructField("segment", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])).parquet(path)
