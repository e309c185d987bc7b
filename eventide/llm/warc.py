"""WARC archives, and a two-level index of their captures.

Records are gzip members of their own, in files that tasks write to a shared folder. A payload that stands elsewhere
already becomes a revisit record, which refers to the record that has it. The index has a line for each record, sorted by
the url with its host reversed ("net,example,www)/path"), in compressed blocks; the directory of a shard has the first key
of each of its blocks. A lookup finds its shards by their bounds, its blocks by binary search in their directories, then
reads only those blocks, and of the archives only the ranges that their lines name.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import delete, discard, materialize, shared_folder, table

#: Payloads of fewer bytes are always written in full.
LEAST_BYTES = 1000
#: Bytes after which a task begins a new archive; lines of an index block; most shards of an index, as their bounds go to all tasks.
FILE_BYTES, BLOCK_LINES, MOST_SHARDS = 1 << 28, 3000, 4096
#: Ranges of an archive that are read at once: at most so far apart, and so many bytes in all.
GAP, READ_BYTES = 1 << 16, 1 << 23
NAME = "urn:page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "surt string, date string, url string, digest string, file string, offset long, length long"
RECORD = "key long, url string, date string, record_type string, payload_digest string, payload_bytes long, refers_to long"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file, and its path there: a local path, or one of file, hdfs, viewfs, s3 or gs."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))


def plain_url(url: str | None) -> str:
    """url as one word: white space and control characters are percent-encoded; null is empty."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url or "")


def surt(url: str | None) -> str:
    """The key of a url: its host in lower case with the labels reversed, a bracket, and what follows the host as far as
    the fragment. Scheme and user are left out; a url without "://" has no host."""
    _, found, rest = plain_url(url).partition("://")
    if not found:
        return ")" + plain_url(url).partition("#")[0]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, port, number = rest[:end].rpartition("@")[2].lower().partition(":")
    return ",".join(reversed(host.split("."))) + port + number + ")" + rest[end:].partition("#")[0]


def packed(data: bytes) -> bytes:
    """data as one gzip member."""
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def record(key: int | None, url: str | None, date: str, digest: str, size: int, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record with the headers of the response only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{NAME}{'' if key is None else key}>", f"WARC-Target-URI: {plain_url(url)}", f"WARC-Date: {date}"]
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <{NAME}{refers_to}>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple:
    """The fields of RECORD, and the payload, of a record. The digest of a response is that of its payload, and must be the
    one that its header names."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix(f"<{NAME}").removesuffix(">")) else None
    size = int(next(line.split(": ")[1] for line in http.decode().split("\r\n") if line.startswith("Content-Length: ")))
    kind = fields["WARC-Type"]
    if kind == "response":
        if len(payload) != size or (digest := hashlib.sha1(payload).hexdigest()) != said:
            raise ValueError(f"the record of {fields['WARC-Record-ID']} is damaged")
        said = digest
    return number("WARC-Record-ID"), fields["WARC-Target-URI"], fields["WARC-Date"], kind, said, size, number("WARC-Refers-To"), payload


@dataclass(frozen=True)
class Archive:
    """captures: a row of CAPTURE for each record; shards: first and last key, index file and directory file of each."""

    folder: str
    captures: DataFrame
    shards: list[tuple[str, str, str, str]]


def decided(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """key, url, payload, size, digest and refers_to of every row. Of rows with equal payloads of LEAST_BYTES or more, those
    of the largest key keep it; the others have no payload and refer to that key.

    Payloads are told apart by their SHA-256. Whole rows meet their decision by key and sum, so that many copies of one
    payload don't come to one task; of the sums only small rows are shuffled, and counted before that."""
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sum", F.unhex(F.sha2("payload", 256)))
    large = rows.where(F.col("size") >= LEAST_BYTES).select("key", "sum")
    kept = large.groupBy("sum").agg(F.max("key").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    again = large.join(kept, "sum").where("key is null or key < refers_to").distinct().select(F.col("key").alias("k"), F.col("sum").alias("s"), "refers_to")
    found = rows.join(again, F.col("key").eqNullSafe(F.col("k")) & (F.col("sum") == F.col("s")), "left")
    return found.select("key", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", F.sha1("payload").alias("digest"), "refers_to")


def written(rows: DataFrame, folder: str, date: str) -> DataFrame:
    """Write a record for each of rows (key, url, payload, size, digest, refers_to); a row of CAPTURE for each.

    A task that is run again writes files of other names: only those that its rows name count."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        out, name, at, stamp = None, "", 0, "".join(c for c in date if c.isdigit())[:14]
        for batch in batches:
            lines = []
            for i in range(batch.num_rows):
                key, url, payload, size, digest, refers_to = (batch.column(c)[i].as_py() for c in range(6))
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, info = system.open_output_stream(f"{path}/{name}", compression=None), b"software: eventide\r\nformat: WARC File Format 1.1\r\n"
                    first = packed(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
                    out.write(first)
                    at = len(first)
                data = packed(record(key, url, date, digest, size, (payload or "").encode(), refers_to))
                out.write(data)
                lines.append((surt(url), stamp, plain_url(url), digest, name, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines, strict=True) if lines else [[]] * 7, [pa.string()] * 5 + [pa.int64()] * 2, strict=True)], names=[c.split()[0] for c in CAPTURE.split(", ")])
        if out is not None:
            out.close()

    return rows.select("key", "url", "payload", "size", "digest", "refers_to").mapInArrow(save, CAPTURE)


def indexed(captures: DataFrame, folder: str, shards: int) -> list[tuple[str, str, str, str]]:
    """Write the lines of captures, sorted, as shards of compressed blocks with their directories. One url may fill many
    blocks and shards: lines are dealt out by all that they are sorted by."""
    order = ["surt", "date", "file", "offset"]

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        name, at, held, blocks, out, last = uuid.uuid4().hex, 0, [], [], None, ""

        def flush() -> None:
            nonlocal at
            data = packed("".join(f"{x}\n" for x in held).encode())
            out.write(data)
            blocks.append(f"{held[0].partition(' ')[0]} {at} {len(data)}\n")
            at += len(data)
            held.clear()

        for batch in batches:
            out = out or system.open_output_stream(f"{path}/{name}.cdx.gz", compression=None)
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(" ".join(map(str, line)))
                last = line[0]
                if len(held) == BLOCK_LINES:
                    flush()
        if out is not None:
            if held:
                flush()
            out.close()
            with system.open_output_stream(f"{path}/{name}.idx") as to:
                to.write("".join(blocks).encode())
            if blocks:
                yield pa.RecordBatch.from_pydict({"first": [blocks[0].partition(" ")[0]], "last": [last], "file": [f"{name}.cdx.gz"], "directory": [f"{name}.idx"]})

    sorted_ = captures.select(*(c.split()[0] for c in CAPTURE.split(", "))).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    made = materialize(sorted_.mapInArrow(save, "first string, last string, file string, directory string"))
    out = [tuple(r) for r in made.orderBy("first", "last", "file").collect()]
    discard(made)
    return sorted(out, key=lambda r: (r[0].encode(), r[1].encode()))


def write(pages: DataFrame, key: str, url: str, payload: str, folder: str, date: str = "1970-01-01T00:00:00Z", shards: int | None = None) -> Archive:
    """Archives of pages with their index, in a folder that all executors share.

    Each row gives a record. Null payloads are empty, null urls too; keys are whole numbers. Of equal rows, and rows that
    repeat a key with one payload, each has a record of its own, a response if the key is the largest of that payload. Rows
    without a key refer to the largest key that has their payload, and are responses if there is none. Columns may have any
    names. No rows give no files. shards is the number of the index's shards (the session's shuffle partitions), at most
    MOST_SHARDS, whose bounds are brought to the driver.
    """
    spark = pages.sparkSession
    captures = materialize(written(decided(pages, key, url, payload), folder, date))
    number = tasks(spark) if shards is None else shards
    return Archive(folder, captures, indexed(captures, folder, max(1, min(number, MOST_SHARDS))))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks_of(archive: Archive, keys: DataFrame) -> DataFrame:
    """surt, and file, offset and length of each index block that may have it, for keys (surt)."""
    shards, folder = archive.shards, archive.folder
    firsts, lasts = [s[0].encode() for s in shards], [s[1].encode() for s in shards]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k) for k in batch.column(0).to_pylist() for i in range(bisect_left(lasts, k.encode()), bisect_right(firsts, k.encode()))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([k for _, k in rows], pa.string())], names=["shard", "surt"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        known, heads, places = None, [], []
        for batch in batches:
            rows = []
            for shard, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != known:
                    with system.open_input_stream(f"{path}/{shards[shard][3]}") as data:
                        lines = [x.split(b" ") for x in data.read().split(b"\n")[:-1]]
                    known, heads, places = shard, [x[0] for x in lines], [(int(x[1]), int(x[2])) for x in lines]
                k = key.encode()
                # A key may begin in the block before the first that starts with it.
                rows += [(key, shards[shard][2], *places[i]) for i in range(max(0, bisect_left(heads, k) - 1), bisect_right(heads, k))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, [pa.string(), pa.string(), pa.int64(), pa.int64()], strict=True)], names=["surt", "file", "offset", "length"])

    routed = keys.mapInArrow(route, "shard int, surt string")
    return routed.repartitionByRange("shard", "surt").sortWithinPartitions("shard", "surt").mapInArrow(search, "surt string, file string, offset long, length long")


def lookup(archive: Archive, urls: DataFrame, url: str) -> DataFrame:
    """The captures, as rows of CAPTURE, of all urls of a column: those whose keys (see surt()) are equal. Repeated urls
    count once. A url with very many captures is read by as many tasks as its blocks are dealt to."""

    def to_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column(0).to_pylist()], pa.string())], names=["surt"])

    folder = archive.folder

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        known, lines, keys = None, [], []
        for batch in batches:
            rows = []
            for key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, offset) != known:
                    with system.open_input_file(f"{path}/{file}") as data:
                        lines = zlib.decompress(data.read_at(length, offset), 31).split(b"\n")[:-1]
                    known, keys = (file, offset), [x.partition(b" ")[0] for x in lines]
                k = key.encode()
                rows += [x.decode().split(" ") for x in lines[bisect_left(keys, k) : bisect_right(keys, k)]]
            columns = [[r[i] for r in rows] for i in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns[:5]] + [pa.array(map(int, c), pa.int64()) for c in columns[5:]], names=[c.split()[0] for c in CAPTURE.split(", ")])

    keys = urls.select(F.col(f"`{url}`").alias("url")).distinct().mapInArrow(to_keys, "surt string").distinct()
    # A small row stands for a block: the number of tasks is given, as sizes of rows would bring all to one.
    return blocks_of(archive, keys).repartition(tasks(urls.sparkSession), "file", "offset").sortWithinPartitions("file", "offset", "surt").mapInArrow(scan, CAPTURE)


def read(archive: Archive, captures: DataFrame, payload: bool = False) -> DataFrame:
    """The records that captures (file, offset, length) name, as rows of RECORD, and with their payload (null for revisits)
    if it is asked for. Ranges of an archive that lie near each other are read at once. payload_bytes and payload_digest
    are those of the full payload for revisits too."""
    folder = archive.folder

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)

        def groups(batch: pa.RecordBatch) -> Iterator[tuple[str, list[tuple[int, int]]]]:
            held: list[tuple[int, int]] = []
            name = ""
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (file != name or offset > sum(held[-1]) + GAP or offset + length - held[0][0] > READ_BYTES):
                    yield name, held
                    held = []
                name = file
                held.append((offset, length))
            if held:
                yield name, held

        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()][: 7 + payload]
        labels = [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * payload
        for batch in batches:
            for file, ranges in groups(batch):
                start = ranges[0][0]
                with system.open_input_file(f"{path}/{file}") as data:
                    got = data.read_at(sum(ranges[-1]) - start, start)
                rows = [parsed(zlib.decompress(got[o - start : o - start + n], 31)) for o, n in ranges]
                columns = [[r[i] for r in rows] for i in range(7)] + ([[r[7] if r[3] == "response" else None for r in rows]] if payload else [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=labels)

    ranges = captures.select("file", "offset", "length").repartition(tasks(captures.sparkSession), "file", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(load, RECORD + (", payload binary" if payload else ""))


def remove(spark: SparkSession, archive: Archive) -> None:
    """Delete an archive with its index."""
    delete(spark, archive.folder)
    discard(archive.captures)


def op12_warc(spark, sf_dir: str) -> DataFrame:
    """All pages, written as WARC records, looked up by their urls and read again."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archive = write(pages, "page_id", "url", "html", shared_folder(spark))
    found = materialize(read(archive, lookup(archive, pages, "url")))
    remove(spark, archive)
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), k AS (
  SELECT page_id, html, n, max(page_id) OVER (PARTITION BY html) AS best FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= {LEAST_BYTES} AND page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST_BYTES} AND page_id < best THEN best END AS refers_to FROM k
"""
