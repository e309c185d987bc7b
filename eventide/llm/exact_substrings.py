"""Removal of repeated substrings, by suffix arrays.

A string of LENGTH bytes is known by the least hash among its GRAM-byte substrings, its anchor: equal strings have equal
anchors. Consecutive places of a document whose strings have one anchor make a segment. Segments whose anchor occurs
once can repeat nothing. The rest meet at the tasks that hold their anchors; there, equal segments become one, the bytes
of the different ones are brought into suffix order, and neighbours with LENGTH common bytes are repeats of the first
of them in the order of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm import suffixes
from eventide.llm.common import materialize, table
from eventide.llm.wordhash import _VALUES, Powers, chunks, mixed

LENGTH, GRAM = 100, 32
#: Bits of an anchor that are kept; anchors that agree by chance only meet, and are told apart by their bytes.
ANCHOR_BITS = 48
#: Bytes of segments whose suffixes are sorted at once.
SORTED_BYTES = 4 << 20


def sliding(values: np.ndarray, span: int, pick=np.minimum) -> np.ndarray:
    """The least (or what pick gives) of every `span` values in a row."""
    width = 1
    while width < span:
        step = min(width, span - width)
        values = pick(values[: len(values) - step], values[step:])
        width += step
    return values


def segments(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: number of the text, anchor, first and last start of the strings of each segment, and whether the
    segment may repeat itself, as periodic text does: its anchor stands there twice, within reach of one string."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (*(np.zeros(0, np.int64),) * 4, np.zeros(0, bool))
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * up[: len(data)])])
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    span = LENGTH - GRAM + 1
    least = sliding(grams, span)
    none = np.zeros(span - 1, np.uint64)
    chosen = np.flatnonzero(sliding(np.concatenate([none, least, none]), span, np.maximum) == grams)
    near = (grams[chosen[1:]] == grams[chosen[:-1]]) & (np.diff(chosen) <= span)
    owner = np.repeat(np.arange(len(texts)), sizes)[:n]
    inside = np.arange(n) + LENGTH <= ends[owner]
    first = np.ones(n, bool)
    first[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | ~inside[:-1]
    at = np.flatnonzero(first & inside)
    stop = np.ones(n, bool)
    stop[:-1] = first[1:] | ~inside[1:]
    last = np.flatnonzero(stop & inside)
    base = (ends - sizes)[owner[at]]
    periodic = np.isin(least[at], grams[chosen[:-1][near]]) if near.any() else np.zeros(len(at), bool)
    return owner[at], least[at].view(np.int64), at - base, last - base, periodic


def anchored(docs: DataFrame) -> DataFrame:
    """anchor, key and place of all segments of docs (key, text). place packs the first start (from bit 32 on), how many
    more there are (from bit 1 on), and whether the segment is periodic (bit 0)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                owner, anchor, lo, hi, periodic = segments(texts, powers)
                keys = batch.column(0).slice(first, len(texts)).take(pa.array(owner))
                place = lo << 32 | (hi - lo) << 1 | periodic
                yield pa.RecordBatch.from_arrays([pa.array(anchor & ((1 << ANCHOR_BITS) - 1)), keys, pa.array(place)], names=["anchor", "key", "place"])

    return docs.mapInArrow(cut, "anchor long, key long, place long")


def with_bytes(found: DataFrame) -> DataFrame:
    """anchor, key, lo, periodic and bytes of the segments of found (key, text, segments)."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lists = part.column(2)
                flat = lists.flatten()
                anchor, place = flat.field(0), flat.field(1).to_numpy()
                lo, more, periodic = place >> 32, (place & 0xFFFFFFFF) >> 1, (place & 1).astype(bool)
                number = pa.compute.list_parent_indices(lists)
                texts = [t.encode() for t in part.column(1).to_pylist()]
                cut = [texts[d][a : a + m + LENGTH] for d, a, m in zip(number.to_pylist(), lo.tolist(), more.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([anchor, part.column(0).take(number), pa.array(lo.astype(np.int32)), pa.array(periodic), pa.array(cut, pa.binary())], names=["anchor", "key", "lo", "periodic", "data"])

    return found.select("key", "text", "segments").mapInArrow(take, "anchor long, key long, lo int, periodic boolean, data binary")


def repeats(anchor: np.ndarray, key: np.ndarray, lo: np.ndarray, periodic: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, first and last start of the strings that also start earlier, among segments that hold all of their anchors."""
    order = np.lexsort((lo, key))
    anchor, key, lo, periodic, data = anchor[order], key[order], lo[order], periodic[order], [data[i] for i in order]
    kind, firsts = pd.factorize(pd.Series(data, dtype=object))
    strings = np.array([len(d) - LENGTH + 1 for d in data], np.int64)
    seen = np.zeros(len(firsts), np.int64)
    seen[kind[::-1]] = np.arange(len(kind))[::-1]  # the first segment of each kind, in order
    copy = seen[kind] != np.arange(len(kind))
    out = [(key[copy], lo[copy], (lo + strings - 1)[copy])]
    names, kinds = np.unique(anchor[seen], return_inverse=True)
    several = np.bincount(kinds, minlength=len(names)) > 1
    several[kinds[periodic[seen]]] = True
    open_ = seen[several[kinds]]
    if len(open_):
        text = np.frombuffer(b"".join(data[i] for i in open_), np.uint8)
        sizes = np.array([len(data[i]) for i in open_], np.int64)
        owner = np.repeat(np.arange(len(open_)), sizes)
        within = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        words = suffixes.loads(text, LENGTH + suffixes.WORD)
        places = suffixes.suffix_order(text, words, LENGTH)
        places = places[within[places] + LENGTH <= sizes[owner[places]]]
        common = suffixes.common_prefixes(words, places, LENGTH)
        group = np.flatnonzero(common < LENGTH)
        place_key, place_start = key[open_][owner[places]], lo[open_][owner[places]] + within[places]
        rank = np.empty(len(places), np.int64)
        rank[np.lexsort((place_start, place_key))] = np.arange(len(places))
        earliest = np.repeat(np.minimum.reduceat(rank, group), np.diff(np.append(group, len(places))))
        again = np.flatnonzero(rank != earliest)
        if len(again):
            again = again[np.lexsort((place_start[again], place_key[again]))]
            k, s = place_key[again], place_start[again]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1] + 1)])
            at = np.flatnonzero(new)
            out.append((k[at], s[at], s[np.append(at[1:], len(s)) - 1]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def repeated(with_data: DataFrame) -> DataFrame:
    """key, lo and hi of the runs of string starts that are repeats; rows come sorted by anchor in each partition."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def work(parts: list[tuple]) -> pa.RecordBatch:
            found = repeats(*(np.concatenate([p[i] for p in parts]) for i in range(4)), [x for p in parts for x in p[4]])
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1].astype(np.int32)), pa.array(found[2].astype(np.int32))], names=["key", "lo", "hi"])

        for batch in batches:
            anchor, key, lo, periodic = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            data = batch.column(4).to_pylist()
            cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            if held and anchor[0] != held[-1][0][-1]:
                cut = np.insert(cut, 0, 0)
            size += sum(map(len, data))
            if size >= SORTED_BYTES and len(cut):
                end = cut[-1]
                if end:
                    held.append((anchor[:end], key[:end], lo[:end], periodic[:end], data[:end]))
                yield work(held)
                held = [(anchor[end:], key[end:], lo[end:], periodic[end:], data[end:])]
                size = sum(map(len, data[end:]))
            else:
                held.append((anchor, key, lo, periodic, data))
        if held:
            yield work(held)

    return with_data.mapInArrow(search, "key long, lo int, hi int")


def kept_parts(size: int, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """What is left of size bytes without the strings that start from lo to hi of each run."""
    out, at = [], 0
    for a, b in sorted(zip(lo.tolist(), hi.tolist(), strict=True)):
        if a > at:
            out.append((at, a))
        at = max(at, b + LENGTH)
    return [*out, (at, size)] if at < size else out


RESULT = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
RUNS = "array<struct<lo:int,hi:int>>"


def described(found: DataFrame) -> DataFrame:
    """The columns of RESULT of found (key, text, runs of string starts to remove)."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = []
                for doc, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    whole = doc.encode()
                    lo, hi = (np.array([r[x] for r in found or []], np.int64) for x in ("lo", "hi"))
                    left = kept_parts(len(whole), lo, hi)
                    kept = b"".join(whole[a:b] for a, b in left)
                    edges = [0, *(x for p in left for x in p), len(whole)]
                    spans = sum(a < b for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((len(whole), len(whole) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[f.split()[0] for f in RESULT.split(", ")])

    return found.select("key", "text", "runs").mapInArrow(finish, RESULT)


def whole() -> Column:
    """The run that takes all of text, if it is long enough."""
    size = F.octet_length("text")
    return F.when(size >= LENGTH, F.array(F.struct(F.lit(0).alias("lo"), (size - LENGTH).cast("int").alias("hi")))).cast(RUNS)


def to_remove(texts: DataFrame) -> DataFrame:
    """key, text and runs of texts (key, text), whose keys are distinct and give the order of the texts."""
    texts = texts.withColumn("digest", F.unhex(F.sha2("text", 256)))
    # Of equal texts the first is searched; the others are repeats as a whole.
    firsts = texts.groupBy("digest").agg(F.min("key").alias("key")).select("key", F.lit(True).alias("first"))
    searched = texts.select("key", "text").join(firsts, "key", "left_semi")
    own = anchored(searched)
    often = own.groupBy("anchor").agg(F.sum(1 + F.col("place").bitwiseAND(1)).alias("n")).where("n > 1").select("anchor")
    hits = own.join(often, "anchor", "left_semi").groupBy("key").agg(F.collect_list(F.struct("anchor", "place")).alias("segments"))
    data = with_bytes(hits.join(searched, "key")).repartition("anchor").sortWithinPartitions("anchor")
    runs = repeated(data).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    known = texts.join(firsts, "key", "left").join(runs, "key", "left")
    return known.select("key", "text", F.when(F.col("first"), F.col("runs")).otherwise(whole()).alias("runs"))


def removed(docs: DataFrame, key: str, text: str, return_text: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 (and kept, the remaining bytes) of every row.

    Removed is every byte of a LENGTH-byte string that also starts earlier: in a row of a smaller key, or before in the
    same one. Null texts are empty; texts under LENGTH bytes lose nothing. Keys are whole numbers. Rows that repeat a key
    are documents of their own, in the order of the SHA-256 of their texts; of equal ones all but one are repeats. Rows
    without a key are compared with nothing, lose nothing, and keep their number. No rows give none.
    """
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    unknown = docs.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(None).cast(RUNS).alias("runs"))
    if texts.groupBy("key").count().where("count > 1").isEmpty():
        out = described(to_remove(texts).unionByName(unknown))
    else:
        rows = texts.withColumn("digest", F.unhex(F.sha2("text", 256))).groupBy("key", "digest").agg(F.min("text").alias("text"), F.count("*").alias("n"))
        numbers = materialize(rows.select("key", "digest").orderBy("key", "digest").withColumn("number", F.monotonically_increasing_id()))
        own = materialize(rows.join(numbers, ["key", "digest"]).drop("digest"))
        first = described(to_remove(own.select(F.col("number").alias("key"), "text"))).withColumnRenamed("key", "number")
        more = own.where("n > 1").select("key", "text", whole().alias("runs"), F.explode(F.sequence(F.lit(2).cast("long"), "n")).alias("nth")).drop("nth")
        out = first.join(own.select("number", "key"), "number").drop("number").unionByName(described(more.unionByName(unknown)))
    out = out.withColumnRenamed("key", key)
    return out if return_text else out.drop("kept")


def op6_exact_substrings(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without the 100-byte strings that stand earlier in the corpus."""
    return removed(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
