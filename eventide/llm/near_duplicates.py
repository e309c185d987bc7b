"""Near-duplicate documents by SuperMinHash.

Equal shingle sets make a class. Every class gets a SuperMinHash signature: each shingle draws a random permutation of
the slots and a rank in each, and a slot keeps the least rank. Signatures are cut into bands; classes that agree in a
band become candidates, their full sets are compared, and linked classes are joined by union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm.common import discard, materialize, table
from eventide.llm.wordhash import Powers, chunks, mixed, shingles, words

#: Slots of a signature: BANDS bands of ROWS slots. A link at similarity 0.8 shares no band with probability 3e-6.
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
#: Classes of a bucket that are all compared with each other; in larger buckets see candidates().
SMALL = 24
_STEP = 0x9E3779B97F4A7C15


def draw(seeds: np.ndarray, nth: int) -> np.ndarray:
    """The nth 64 random bits of each seed."""
    return mixed(seeds + np.uint64(_STEP * (nth + 1) % 2**64))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The SuperMinHash signature of each set, a row each; infinity for empty sets.

    In step j each shingle draws its jth slot, by a Fisher-Yates shuffle of the slots, and offers it the rank j + r
    with r uniform in [0, 1). Once every slot of a set holds a rank below j, later steps can't change it: the set
    stops there, most after one step.
    """
    out = np.full((len(sets), SLOTS), np.inf)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    seeds = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    slots = None
    for j in range(SLOTS):
        if j:
            going = (out.max(1) >= j) & (sizes > 0)
            if not going.any():
                break
            kept = going[owner]
            if not kept.all():
                owner, seeds = owner[kept], seeds[kept]
                slots = slots[kept]
        bits = draw(seeds, j)
        rank = (bits >> np.uint64(32)).astype(np.float64) / 2**32
        pick = j + ((bits & np.uint64(0xFFFFFFFF)) % np.uint64(SLOTS - j)).astype(np.int64)
        if j == 0:
            slot = pick
            busy = owner  # the shuffles are only needed from the second step on: start them for sets that go on
            flat = out.reshape(-1)
            np.minimum.at(flat, busy * SLOTS + slot, rank)
            going = (out.max(1) >= 1) & (sizes > 0)
            kept = going[owner]
            owner, seeds, slot = owner[kept], seeds[kept], slot[kept]
            slots = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(seeds), 1))
            rows = np.arange(len(seeds))
            slots[rows, slot] = slots[rows, 0]
            continue
        rows = np.arange(len(seeds))
        slot = slots[rows, pick].astype(np.int64)
        slots[rows, pick] = slots[rows, j]
        np.minimum.at(out.reshape(-1), owner * SLOTS + slot, rank + j)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A hash of each band of each signature."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), BANDS, ROWS)
    out = np.zeros((len(signature), BANDS), np.uint64)
    for i in range(ROWS):
        out = mixed(out + np.uint64(_STEP) + bits[:, :, i])
    return mixed(out + np.arange(BANDS, dtype=np.uint64))


def sketches(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key, size, d1, d2 (128 bits that tell sets apart) and bands of the shingle set of every row."""
    schema = T.StructType([docs.schema[key], T.StructField("size", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                sets = shingles(*words(texts, powers), width)
                hashed = bands(signatures(sets)).view(np.int64)
                digest = [np.array([mixed(s * np.uint64(f)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for f in (3, 5)]
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, hashed.size + 1, BANDS, dtype=np.int32)), pa.array(hashed.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(sizes), pa.array(digest[0]), pa.array(digest[1]), flat], names=schema.fieldNames())

    return docs.select(key, text).mapInArrow(sketch, schema)


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """The rows of buckets (bucket, id, size) of several classes, with their number n and the bucket's first class hub."""
    counted = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("id", "size")).alias("hub"))
    return buckets.join(counted.where("n > 1"), "bucket")


def candidates(shared: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of classes that share a bucket.

    All pairs of a bucket of SMALL classes; in a larger one, each class with the bucket's first class. What that
    leaves open in large buckets is settled by rest().
    """
    star = shared.where((F.col("n") > SMALL) & (F.col("id") != F.col("hub.id"))).select(F.col("hub.id").alias("a"), F.col("id").alias("b"), F.col("hub.size").alias("sa"), F.col("size").alias("sb"))
    small = shared.where(F.col("n") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("id", "size"))).alias("m"))
    pairs = small.select("m", F.posexplode("m").alias("i", "x")).select("x", F.explode(F.slice("m", F.col("i") + 2, SMALL)).alias("y"))
    return star.unionByName(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.size").alias("sa"), F.col("y.size").alias("sb")))


def rest(shared: DataFrame, component: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of large buckets that candidates() left out and that could still join two components: those of each
    class outside a bucket's first component with classes of other components.

    Large buckets hold variants of one text, and most pairs of them are not alike. So the classes meet by prefixes: each
    class's shingles are ordered, the rarest among these classes first. If the first common shingle of two sets has so
    many before it that what is left can't be enough, the sets are not alike; else it stands early in both.
    """
    large = shared.where(F.col("n") > SMALL).select("bucket", "id", "size")
    own = large.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parted = own.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "id").alias("main")).where("low < high")
    classes = own.join(parted.select("bucket", "main"), "bucket").groupBy("id", "size", "component").agg(F.max(F.col("component") != F.col("main")).alias("stray"))
    grams = sets.join(classes, "id").select("id", "size", "component", "stray", F.explode("set").alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("n", "gram")) - 1
    early = grams.join(often, "gram").withColumn("place", place).where((F.col("n") > 1) & (100 * (F.col("size") - F.col("place")) >= percent * F.col("size"))).drop("n")
    x = early.where("stray").select("gram", F.col("id").alias("x"), F.col("size").alias("sx"), F.col("component").alias("cx"), F.col("place").alias("px"))
    enough = (100 + percent) * F.least(F.col("sx") - F.col("px"), F.col("size") - F.col("place")) >= percent * (F.col("sx") + F.col("size"))
    once = ~F.col("stray") | (F.col("x") < F.col("id"))
    met = x.join(early, (x["gram"] == early["gram"]) & (F.col("cx") != F.col("component")) & once & enough).select("x", "sx", "id", "size").distinct()
    first = F.col("x") < F.col("id")
    return met.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b"), F.when(first, F.col("sx")).otherwise(F.col("size")).alias("sa"), F.when(first, F.col("size")).otherwise(F.col("sx")).alias("sb"))


def alike(percent: int, a, b, both):
    """Whether sets of sizes a and b with `both` common shingles have that Jaccard similarity, in whole numbers."""
    return 100 * both >= percent * (a + b - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike; pairs whose sizes rule it out are not compared."""
    small, large = F.least("sa", "sb"), F.greatest("sa", "sb")
    wanted = pairs.where(alike(percent, F.lit(0), large, small)).select("a", "b").distinct()
    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return wanted.join(left, "a").join(right, "b").where(alike(percent, F.size("x"), F.size("y"), both)).select("a", "b")


def rooted(edges: DataFrame) -> DataFrame:
    """Union-find on each partition's edges: every node with the least node that it reaches there."""

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        kept = [(x, find(x)) for x in parent if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array([r for _, r in kept], pa.int64()), pa.array([x for x, _ in kept], pa.int64())], names=["a", "b"])

    return edges.mapInArrow(union, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id and component, the least id that it reaches, of every node of edges (a, b) that isn't itself the least.

    Each round joins what its tasks hold by union-find, then hangs every node's neighbours on the least of them
    (large star, small star), until every node hangs on its component's least. Rounds are written to the shared folder.
    """
    edges = materialize(rooted(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low"))
        large = both.join(least, "a").where("b > a").select(F.least("low", "a").alias("a"), "b")
        down = large.where("a < b").distinct()
        first = down.groupBy("b").agg(F.min("a").alias("low"))
        small = down.join(first, "b").select(F.col("low").alias("a"), F.when(F.col("a") == F.col("low"), F.col("b")).otherwise(F.col("a")).alias("b"))
        before, edges = edges, materialize(small.where("a < b").distinct())
        discard(before)
        inner = edges.select("b").join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        twice = edges.groupBy("b").count().where("count > 1").limit(1).count()
        if not inner and not twice:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))


def repeats(docs: DataFrame, key: str) -> bool:
    """Whether a key other than null stands in several rows."""
    return not docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty()


def group(docs: DataFrame, key: str, text: str, width: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component (the least key reachable over links) and kept (whether it is the row's own key).

    Texts are lower-cased (A-Z) and cut at ASCII white space; a text with fewer words than width has one shingle, all
    its words; null, empty and blank texts have none and are linked with nothing. Links are sets with 100 * common >=
    percent * union. Rows without a key are grouped with nothing: null component, and kept. Of rows that repeat a key,
    each is returned, with the key's component; their texts are all linked to it. Keys must be whole numbers. Key and text
    may be named as any of the columns that are made here; other columns are not looked at.
    """
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    made = materialize(sketches(docs.where("key is not null"), "key", "text", width))
    classes = made.where("size > 0").groupBy("d1", "d2", "size").agg(F.min("key").alias("id"), F.first("bands").alias("bands"))
    shared = materialize(shared_buckets(classes.select("id", "size", F.explode("bands").alias("bucket"))))
    texts = docs.withColumnRenamed("key", "id").join(shared.select("id").distinct(), "id", "left_semi")
    repeated = repeats(made, "key")
    if repeated:
        texts = texts.distinct()
    sets = materialize(shingle_sets(texts, width))
    tried = verified(candidates(shared), sets, percent)
    if repeated:  # a key may stand in several classes, which it links: then keys are in the graph beside classes
        copies = made.where("size > 0").join(classes.select("d1", "d2", "size", "id"), ["d1", "d2", "size"]).where("key <> id")
        tried = tried.unionByName(copies.select(F.col("id").alias("a"), F.col("key").alias("b"))).distinct()
    links = materialize(tried)
    found = components(links)
    more = materialize(verified(rest(shared, found, sets, percent), sets, percent))
    if not more.isEmpty():
        found = components(links.unionByName(more))
    for done in (shared, sets, links, more):
        discard(done)
    if repeated:
        out = made.select("key", F.col("size").alias("n_shingles")).join(found.withColumnRenamed("id", "key"), "key", "left")
    else:  # only classes are in the graph, and their copies follow them
        own = classes.join(found, "id", "left").select("d1", "d2", "size", F.coalesce("component", "id").alias("component"))
        out = made.join(own, ["d1", "d2", "size"], "left").select("key", F.col("size").alias("n_shingles"), "component")
    own = F.coalesce("component", "key")
    known = out.select(F.col("key").alias(key), "n_shingles", own.alias("component"), (own == F.col("key")).alias("kept"))
    unknown = sketches(docs.where("key is null"), "key", "text", width).select(F.col("key").alias(key), F.col("size").alias("n_shingles"), F.lit(None).cast(known.schema["component"].dataType).alias("component"), F.lit(True).alias("kept"))
    return known.unionByName(unknown)


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """id and the full shingle set of texts (columns id, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for first, part in chunks(batch.column(1)):
                sets = shingles(*words(part, powers), width)
                at = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["id", "set"])

    return texts.select("id", "text").mapInArrow(make, "id long, set array<long>")


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of four-word shingles are alike to four fifths."""
    found = group(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", width=4, percent=80)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "kept")
