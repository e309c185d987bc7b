"""Writers of tables, selection tables, lists, reports and clip files. Every one writes by Spark, below a folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.shared import delete, new_folder  # noqa: F401
from eventide.sources.readers import SELECTION_NAMES


def table(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "error") -> None:
    df.write.csv(path, header=header, sep=sep, mode=mode)


#: What Spark escapes in the names of folders.
UNSAFE = re.compile(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]")


def folder_of(by: str, value: str | None) -> str:
    """by=value as Spark names and reads the folders of a partitioned table."""
    said = "__HIVE_DEFAULT_PARTITION__" if value in (None, "") else UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", value)
    return f"{by}={said}"


def small_files(lines: DataFrame, by: str, line: str, path: str, mode: str, suffix: str, head: str = "") -> None:
    """The lines of each value of `by` as a file in a folder of its own. Many small files take their time for being opened,
    not for their bytes: so they are dealt to as many tasks as the session shuffles to, and written straight to the end of
    a short name of their own, without Spark's moves by task and job. A file that is there is complete; a task that is run
    again writes the same names."""
    from eventide.sources.ranges import opened

    spark = lines.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(root)
    if there and mode in ("error", "errorifexists"):
        raise FileExistsError(path)
    if there and mode == "ignore":
        return
    if there and mode == "overwrite":
        delete(spark, path)
    run = uuid.uuid4().hex[:8]

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = opened(path)
        part = TaskContext.get().partitionId()
        out, temporary, final, known, n = None, "", "", None, 0

        def done() -> None:
            if out is not None:
                out.close()
                system.move(temporary, final)

        for batch in batches:
            for value, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None or value != known:
                    done()
                    known, folder = value, f"{at}/{folder_of(by, value)}"
                    system.create_dir(folder, recursive=True)
                    temporary, final = f"{folder}/.{uuid.uuid4().hex}", f"{folder}/part-{part:05d}-{run}{suffix}"
                    out = system.open_output_stream(temporary, compression=None)
                    out.write(head.encode())
                    n += 1
                out.write(((text or "") + "\n").encode())
        done()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.select(F.col(by).cast("string").alias("by"), F.col(line).alias("line")).repartition(tasks, "by").sortWithinPartitions("by")
    dealt.mapInArrow(save, "n long").agg(F.sum("n")).collect()
    system, at = opened(path)
    system.create_dir(at, recursive=True)
    system.open_output_stream(f"{at}/_SUCCESS").close()


def documents(df: DataFrame, name: str, text: str, path: str, mode: str = "error") -> None:
    """A folder of its own for the text of each row, name=<its name>: for JSON documents that are read whole."""
    small_files(df.select(name, F.col(text).cast("string").alias("value")), name, "value", path, mode, ".txt")


def resumable(rows: DataFrame, key: str, path: str, shares: int, make: Callable[[DataFrame], DataFrame]) -> int:
    """Write make(rows) as Parquet in shares (by a hash of key), and return how many were made now: those that an earlier
    run has finished are left as they are, so a long job that was stopped goes on where it was."""
    spark = rows.sparkSession
    share, made = F.pmod(F.xxhash64(key), F.lit(shares)), 0
    for i in range(shares):
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/share={i}/_SUCCESS")
        if not done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done):
            make(rows.where(share == i)).write.mode("overwrite").parquet(f"{path}/share={i}")
            made += 1
    return made


def excerpt_table(events: DataFrame, begin: str, end: str, start, length) -> DataFrame:
    """The events that touch the excerpt from start on of a length, cut at its ends, with times from its start."""
    inside = events.where((F.col(begin) < start + length) & (F.col(end) > start))
    return inside.withColumn(begin, F.greatest(F.col(begin), start) - start).withColumn(end, F.least(F.col(end), start + length) - start)


def selection_tables(events: DataFrame, path: str, by: str = "file_id", mode: str = "error") -> None:
    """A folder of tab-separated selection tables for each value of `by`."""
    long = {v: k for k, v in SELECTION_NAMES.items()}
    named = [F.col(c).alias(long.get(c, c)) for c in events.columns if c != by]
    head = "\t".join(long.get(c, c) for c in events.columns if c != by) + "\n"
    small_files(events.select(by, F.to_csv(F.struct(*named), {"sep": "\t"}).alias("_line")), by, "_line", path, mode, ".csv", head)


def text_list(df: DataFrame, column: str, path: str, mode: str = "error") -> None:
    df.select(F.col(column).cast("string")).write.mode(mode).text(path)


def report_json(overall: DataFrame, by_set: DataFrame, by_file: DataFrame, team: str, set_name: str) -> DataFrame:
    """One row with the text of a report: overall scores, and scores by set and by file (keys and score columns). The text
    is one document, so it is for as many files as one row can hold (some millions); keep larger results as tables."""

    def entries(df: DataFrame, key: str, name: str) -> DataFrame:
        scores = F.struct(*(c for c in df.columns if c != key))
        return df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), scores.alias("v"))))).alias(name))

    whole = overall.select(F.struct(*overall.columns).alias("overall_scores")).join(entries(by_set, by_set.columns[0], "scores_per_subset")).join(entries(by_file, by_file.columns[0], "scores_per_audiofile"))
    date = F.date_format(F.current_timestamp(), "dd/MM/yyyy HH:mm:ss")
    return whole.select(F.to_json(F.struct(F.lit(team).alias("team_name"), F.lit(set_name).alias("set_name"), date.alias("report_date"), *whole.columns)).alias("value"))


def commands(rows: DataFrame, template: str, columns: list[str]) -> DataFrame:
    """A line of text for each row: the template filled with columns."""
    return rows.select(F.format_string(template, *(F.col(c) for c in columns)).alias("value"))


def clips(excerpts: DataFrame, rate: int) -> DataFrame:
    """path and content (a WAV file) of excerpts (path, samples)."""
    from eventide.sources.audio import encode

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "content": [encode(np.asarray(x, float), rate) for x in part["samples"]]})

    return excerpts.select("path", "samples").mapInPandas(make, "path string, content binary")


def matrices(rows: DataFrame, by: str, order: str, vector: str, folder: str) -> DataFrame:
    """Write the vectors of each value of `by`, in an order, as a matrix <by>.npy of float32, and return by and n. All
    vectors of a matrix have one length. The task of a file holds a batch of rows at a time."""
    from eventide.sources.ranges import opened

    sizes = rows.groupBy(by).agg(F.count("*").alias("_n"), F.max(F.size(vector)).alias("_width"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        out, said = None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                name, said, width = (batch.column(c)[0].as_py() for c in (0, 2, 3))
                temporary, first = f"{path}/.{name}.{uuid.uuid4().hex}", batch.slice(0, 1)
                out, left = system.open_output_stream(temporary, compression=None), said * width
                head = repr({"descr": "<f4", "fortran_order": False, "shape": (said, width)}).encode()
                head += b" " * (-(len(head) + 11) % 64) + b"\n"
                out.write(b"\x93NUMPY\x01\x00" + len(head).to_bytes(2, "little") + head)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4")
            out.write(x.tobytes())
            left -= len(x)
        if out is not None:
            out.close()
            if left:
                raise ValueError(f"{name}: {said * width - left} numbers instead of {said} rows of {width}")
            system.move(temporary, f"{path}/{name}.npy")
            yield pa.RecordBatch.from_arrays([first.column(0), first.column(2)], names=[by, "n"])

    # Grouped, and not only repartitioned: the plan may pass over a repartition, but not over what a group needs.
    ready = rows.join(sizes, by).repartition(by).sortWithinPartitions(by, order).select(by, vector, "_n", "_width")
    return ready.groupBy(by).applyInArrow(save, f"{by} {rows.schema[by].dataType.simpleString()}, n long")
