"""Collocations of words, by hierarchical naming of pairs.

Frequent words get numbers, which come back to the chunks of numbers that texts are held as. The name of a pair of words is
made of their two numbers, so that every chunk knows it and none has to come back. A phrase of three words is a pair of such
names one word apart, a phrase of four a pair two words apart. At each level chunks count their pairs and the counts meet by
pair in a global table; a sieve of the frequent ones tells chunks which pairs can be part of longer phrases. Above four words
names are numbers again that come back, at every second level. Pointers lead from a phrase to the two that are a word
shorter, for cuts and for subsumption.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import discard, shared_folder, table
from eventide.llm.common import materialize as stored

#: Occurrences that a phrase needs; words of the longest; the share of its occurrences, in hundredths, within one longer
#: phrase that makes a phrase superfluous; phrases returned for each language.
LEAST, LONGEST, COVERED, BEST = 30, 4, 80, 2000
#: Bytes of text of a chunk, and of all that a task holds.
CHUNK_BYTES, HELD_BYTES = 2 << 20, 8 << 20
#: Parts of a language that are ranked apart before the best of them are.
SALTS = 64
#: Parts of the pairs with one left side.
PARTS = 16
#: Flags that tell most pairs of a chunk that can't be frequent before any join, and what spreads pairs over them.
SIEVE_BITS, _BUCKET = 1 << 26, 1 << 15
#: Bits of a word's number within the name of a pair of words, and how many words may be frequent for that: with more, names
#: of pairs are numbers that come back to the chunks.
HALF, MOST_WORDS = 32, 1 << 31
#: Bits of a row's number below that of its part in ids that Spark gives.
_ROWS = 33
_FACTORS = {"left": 1_000_003, "right": 69_069}
UNKNOWN = "und"
_BREAKS, _SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_PLAIN = bytes.maketrans(_BREAKS + _SPACES + bytes(range(65, 91)), b"\n" * len(_BREAKS) + b"  " + bytes(range(97, 123)))


def settled(df: DataFrame) -> DataFrame:
    """df written and read again, without its shuffle files: those of all levels together are far more than the input."""
    return stored(df, tidy=True)


def pressed(codes: np.ndarray) -> bytes:
    """Codes as they are stored and shuffled: about half of what the columns' own compression makes of them."""
    return zstandard.ZstdCompressor(level=3).compress(codes.astype(np.int32).tobytes())


def opened(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.int32)


def coded(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of texts, and all words as their numbers, with -1 between pieces."""
    data = b"\n".join(texts).translate(_PLAIN)
    known: dict[bytes, int] = defaultdict(count().__next__)
    words = data.split()
    codes = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
    raw = np.frombuffer(data, np.uint8)
    apart = (raw == 32) | (raw == 10)
    first = ~apart
    first[1:] &= apart[:-1]
    piece = np.cumsum(raw == 10)[first]
    return list(known), np.insert(codes, np.flatnonzero(piece[1:] != piece[:-1]) + 1, -1)


def paired(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of neighbours in codes (numbers below size; -1: none), left and right, how often each occurs, and
    codes with the pair that starts at each place instead. Of places without a pair one is left between two others."""
    both = (codes[:-1] >= 0) & (codes[1:] >= 0)
    at = np.flatnonzero(both)
    kinds, own, n = np.unique(codes[:-1][at].astype(np.int64) * size + codes[1:][at], return_inverse=True, return_counts=True)
    out = np.insert(own.astype(np.int32), np.flatnonzero(np.diff(at) > 1) + 1, -1)
    return kinds // max(size, 1), kinds % max(size, 1), n, out


def word_chunks(docs: DataFrame) -> DataFrame:
    """Two rows for each chunk, the texts of one language, of docs (lang, text): chunk, lang and items (struct of word and
    n), and chunk and codes. A task gathers texts of each language up to CHUNK_BYTES, and of all up to HELD_BYTES."""

    def packed(lang: str, texts: list[bytes], chunk: int) -> Iterator[pa.RecordBatch]:
        words, codes = coded(texts)
        if words:
            n = np.bincount(codes[codes >= 0], minlength=len(words))
            items = pa.StructArray.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)], names=["word", "n"])
            lists = pa.ListArray.from_arrays(pa.array([0, len(words), len(words)], pa.int32()), items)
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * 2), pa.array([lang, None]), lists, pa.array([None, pressed(codes)], pa.binary()), pa.array(["items", "codes"])], names=["chunk", "lang", "items", "codes", "kind"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 33)
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                lang, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py().encode()
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                while sizes and (sizes[lang] >= CHUNK_BYTES or sum(sizes.values()) >= HELD_BYTES):
                    full = max(sizes, key=sizes.get)
                    del sizes[full]
                    yield from packed(full, held.pop(full), next(number))
                    if lang not in sizes:
                        break
        for lang, texts in held.items():
            yield from packed(lang, texts, next(number))

    return docs.select("lang", "text").mapInArrow(make, "chunk long, lang string, items array<struct<word:string,n:long>>, codes binary, kind string")


def stored_chunks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items and the codes of word_chunks(), written in one go to folders of their own."""
    spark, path = docs.sparkSession, shared_folder(docs.sparkSession)
    word_chunks(docs).write.partitionBy("kind").parquet(path)
    out = []
    for kind, schema in (("items", "chunk long, lang string, items array<struct<word:string,n:long>>"), ("codes", "chunk long, codes binary")):
        found = spark.read.schema(schema + ", kind string").parquet(path).where(F.col("kind") == kind).drop("kind")
        found.folder = f"{path}/kind={kind}"
        out.append(found)
    return out[0], out[1]


def thinned(codes: np.ndarray, kept: np.ndarray, size: int) -> np.ndarray:
    """codes (numbers below size) by their places in kept, -1 for others, with one -1 between two others."""
    new = np.full(size + 1, -1, np.int32)  # the last is for -1
    new[kept] = np.arange(len(kept))
    codes = new[codes]
    return codes[np.append(True, (codes[1:] >= 0) | (codes[:-1] >= 0))] if len(codes) else codes


def pairs(named: DataFrame, schema: str, emit: Callable[..., pa.RecordBatch], sieves: list[Broadcast], packed: bool) -> DataFrame:
    """What emit makes of each chunk of named (chunk, names: struct of place and id, codes). There is a level for each of
    sieves, at which only pairs are kept that pass it, and one more, at which all are; the items of one level make the pairs
    of the next. emit gets the chunk as an array and of the pairs of the last level left and right (names of the phrases
    that they begin and end with), mid (the name one before right), how often each occurs, and the new codes. Names are ids,
    or with packed (ids of words) those that the pairs of the first level make."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names = batch.column(1)[i].values
                places, ids = names.field(0).to_numpy(), names.field(1).to_numpy()
                codes = opened(batch.column(2)[i].as_py())
                codes = thinned(codes, places, max(codes.max(initial=-1), places.max(initial=-1)) + 1)
                first = last = ids
                for level, shared in enumerate([*sieves, None]):
                    left, right, n, codes = paired(codes, len(first))
                    first, mid, last = first[left], last[left], last[right]
                    if shared is not None:
                        kept = np.flatnonzero(sieved(shared.value, first, last))
                        codes = thinned(codes, kept, len(first))
                        first, last = first[kept], last[kept]
                        if packed and level == 0:
                            first = last = first << HALF | last
                yield emit(batch.column(0).slice(i, 1), first, last, mid, n, codes)

    return named.select("chunk", "names", "codes").mapInArrow(make, schema)


def pair_counts(named: DataFrame, sieves: list[Broadcast], packed: bool) -> DataFrame:
    """left, part, right, mid and n of the pairs of all chunks, each summed up there and in order. mid follows from left and
    right, and is null where it is left. Pairs meet by their left side, in PARTS parts by the right one: so rows that follow
    each other in a shuffle have most of their bytes in common, and a very frequent left side is still many tasks' work."""
    apart = len(sieves) > int(packed)

    def emit(chunk: pa.Array, left: np.ndarray, right: np.ndarray, mid: np.ndarray, n: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(mid) if apart else pa.nulls(len(mid), pa.int64()), pa.array(n)], names=["left", "right", "mid", "n"])

    rows = pairs(named, "left long, right long, mid long, n long", emit, sieves, packed)
    return rows.select("left", F.pmod("right", F.lit(PARTS)).alias("part"), "right", "mid", "n").repartition("left", "part")


def sieve(found: DataFrame) -> np.ndarray:
    """SIEVE_BITS flags, set where a pair of found falls: of fixed size, whatever there is. A pair whose flag is not set is
    not in found; the others are told by a join."""
    mark = lambda c: F.pmod(F.col(c), F.lit(1 << HALF)) * F.lit(_FACTORS[c]) + F.shiftright(c, HALF) * F.lit(_FACTORS[c] + 1)
    bit = F.pmod(mark("left") + mark("right"), F.lit(SIEVE_BITS)) + 1  # Spark's bitmaps count bits and buckets of 4096 bytes from 1
    rows = found.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(SIEVE_BITS, bool)
    for r in rows:
        at = (r["bucket"] - 1) * _BUCKET
        out[at : at + _BUCKET] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
    return np.packbits(out, bitorder="little")


def sieved(flags: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the flags of pairs are set."""
    bit = sum((x % (1 << HALF)) * _FACTORS[c] + (x >> HALF) * (_FACTORS[c] + 1) for c, x in (("left", left), ("right", right))) % SIEVE_BITS
    return (flags[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def pair_chunks(named: DataFrame, sieves: list[Broadcast], packed: bool) -> DataFrame:
    """chunk, items (struct of left and right) and codes of named: the pairs that may be frequent, by the last of sieves."""
    *below, shared = sieves

    def emit(chunk: pa.Array, left: np.ndarray, right: np.ndarray, mid: np.ndarray, n: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        kept = np.flatnonzero(sieved(shared.value, left, right))
        codes = thinned(codes, kept, len(left))
        items = pa.StructArray.from_arrays([pa.array(left[kept]), pa.array(right[kept])], names=["left", "right"])
        return pa.RecordBatch.from_arrays([chunk, pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), items), pa.array([pressed(codes)], pa.binary())], names=["chunk", "items", "codes"])

    return pairs(named, "chunk long, items array<struct<left:long,right:long>>, codes binary", emit, below, packed)


def frequent(items: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys, f and a number id of the items (keys, n) of all chunks that occur often enough."""
    return items.groupBy(*keys).agg(F.sum("n").alias("f")).where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id())


def numbered(found: DataFrame) -> DataFrame:
    """found, as written by frequent(), with ids from 0 on without gaps. The sizes of its parts are few rows."""
    part, row = F.shiftright("id", _ROWS), F.col("id").bitwiseAND(F.lit((1 << _ROWS) - 1))
    starts = found.groupBy(part.alias("of")).count().select("of", (F.sum("count").over(Window.orderBy("of")) - F.col("count")).alias("start"))
    return found.withColumn("of", part).join(F.broadcast(starts), "of").withColumn("id", F.col("start") + row).drop("of", "start")


def named(held: DataFrame, codes: DataFrame, keys: list[str], names: DataFrame) -> DataFrame:
    """chunk, names (places of frequent items of the chunk with their ids; no more than its words) and codes of the chunks
    that have any. Names are written before they meet the codes, so that the items and their shuffle are gone by then;
    then the codes go too."""
    items = held.select("chunk", *(k for k in keys if k == "lang"), F.posexplode("items").alias("place", "x")).select("chunk", "place", *(k if k == "lang" else F.col("x")[k].alias(k) for k in keys))
    met = settled(items.join(names.select(*keys, "id"), keys).groupBy("chunk").agg(F.collect_list(F.struct("place", "id")).alias("names")))
    if codes is not held:
        discard(held)
    out = settled(met.join(codes.select("chunk", "codes"), "chunk"))
    discard(met)
    discard(codes)
    return out


def exact(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def phrases(docs: DataFrame, least: int, longest: int) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases of 1 to longest words, a table for each, and the words of each language. id, lang, phrase, last (its
    last word), f, left and right (ids of the phrases without its last and first word), before and after: how often
    its first 1, 2, ... words occur, and its last ones."""
    held, codes = stored_chunks(docs)
    items = held.select("lang", F.explode("items").alias("x")).select("lang", F.col("x.word").alias("word"), F.col("x.n").alias("n"))
    totals = settled(items.groupBy("lang").agg(F.sum("n").alias("n")))
    none = F.array().cast("array<long>")
    raw = settled(frequent(items, ["lang", "word"], least))
    found = settled(numbered(raw))
    discard(raw)
    packed = found.count() <= MOST_WORDS
    out = [settled(found.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), none.alias("before"), none.alias("after")))]
    held = named(held, codes, ["lang", "word"], found)
    discard(found)
    sieves: list[Broadcast] = []
    for k in range(2, longest + 1):
        found = settled(frequent(pair_counts(held, sieves, packed), ["left", "part", "right", "mid"], least))
        whole = found.withColumn("id", F.shiftleft("left", HALF).bitwiseOR(F.col("right"))) if k == 2 and packed else found
        shorter = out[-1]
        one, two = shorter.select(F.col("id").alias("one"), "lang", "phrase", F.col("f").alias("fl"), "before"), shorter.select(F.col("id").alias("two"), "last", F.col("f").alias("fr"), "after")
        if k > 2 and k % 2 == 0:
            # left and right are two words apart: the phrases between are pairs of one of them and mid.
            to_one, to_two = shorter.select(F.col("id").alias("one"), "left", F.col("right").alias("mid")), shorter.select(F.col("id").alias("two"), F.col("left").alias("mid"), "right")
            whole = whole.join(to_one, ["left", "mid"]).join(to_two, ["mid", "right"]).drop("left", "right")
        else:
            whole = whole.withColumnsRenamed({"left": "one", "right": "two"})
        both = whole.join(one, "one").join(two, "two")
        out.append(settled(both.select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", F.col("one").alias("left"), F.col("two").alias("right"), F.concat("before", F.array("fl")).alias("before"), F.concat("after", F.array("fr")).alias("after"))))
        if k < longest:
            sieves.append(found.sparkSession.sparkContext.broadcast(sieve(found)))
            if k % 2 == 0 and not (k == 2 and packed):
                last, held = held, settled(pair_chunks(held, sieves, packed))
                discard(last)
                held = named(held, held, ["left", "right"], found)
                sieves, packed = [], False
        discard(found)
    discard(held)
    return out, totals


def scored(found: list[DataFrame], covered: int) -> DataFrame:
    """lang, phrase, a, l, r and score of the phrases of two words or more that no longer one covers.

    A phrase is covered if a longer one has enough of its occurrences; then one that is longer by a word has too, as it
    occurs no less often: only the pointers of one level are looked at."""
    parts = []
    for k in range(1, len(found)):
        own = found[k]
        cuts = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.struct(i.alias("k"), F.element_at("before", i).alias("l"), F.element_at("after", k + 1 - i).alias("r")))
        scores = F.transform(cuts, lambda c: F.struct(F.call_function("div", F.lit(2000000).cast("decimal(18,0)") * exact(F.col("f")), exact(c["l"]) + exact(c["r"])).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))
        if k + 1 < len(found):
            longer = found[k + 1]
            most = longer.select(F.col("left").alias("id"), "f").unionByName(longer.select(F.col("right").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("most"))
            own = own.join(most, "id", "left").where(F.col("most").isNull() | (100 * exact(F.col("most")) < covered * exact(F.col("f"))))
        parts.append(own.select("lang", "phrase", F.col("f").alias("a"), F.array_min(scores).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def mine(docs: DataFrame, text: str, lang: str, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, best: int | None = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the best phrases of each language, or with best = None all that are left.

    Texts are lower-cased (A-Z) and cut into pieces at `.,;:!?` and line ends, these into words at spaces and tabs. Of a
    phrase of 2 to longest (at least 2) words within a piece that occurs at least `least` times (a, overlaps included), the
    cut into first part (l) and rest (r) counts that has the lowest score, floor(2000000 * a / (l + r)) (ties: the shortest
    first part). Phrases go that lie in a longer one with covered hundredths of their occurrences or more. Ranks go by score
    and a, descending, then by the bytes of the phrase. n counts the words of the language.

    Null languages are "und", null texts are empty; repeated rows count each time. Columns may have any names; others are
    not looked at. No rows, or no frequent phrases, give none. Tables between the levels lie in the shared folder and are
    deleted at the end.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    found, totals = phrases(rows, least, longest)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    left = scored(found, covered)
    if best is not None:
        # The best of a language are among the best of each of its parts.
        left = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        left = left.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= best)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if best is not None:
        left = left.where(F.col("rank") <= best)
    out = settled(left.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    for done in (*found, totals):
        discard(done)
    return out


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all documents."""
    return mine(table(spark, sf_dir, "documents").select("lang", "text"), "text", "lang")


OP11_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS w FROM p
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) AS ws FROM w, (SELECT unnest(range(1, {LONGEST + 1})) AS k)
), f AS (
  SELECT lang, k, ws, count(*)::HUGEINT AS f FROM g GROUP BY lang, k, ws HAVING count(*) >= {LEAST}
), n AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), cuts AS (
  SELECT c.lang, c.k, c.ws, c.f AS a, x.k AS cut, x.f AS l, y.f AS r, 2000000 * c.f // (x.f + y.f) AS score FROM f c
  JOIN f x ON x.lang = c.lang AND x.k < c.k AND x.ws = c.ws[1 : x.k] JOIN f y ON y.lang = c.lang AND y.k = c.k - x.k AND y.ws = c.ws[x.k + 1 : c.k] WHERE c.k > 1
), b AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) = 1
), parts AS (
  SELECT lang, len(x.part) AS k, x.part AS ws, max(f) AS most FROM (
    SELECT lang, f, unnest(flatten(list_transform(range(2, k), lambda j: list_transform(range(1, k - j + 2), lambda i: struct_pack(part := ws[i : i + j - 1]))))) AS x FROM f WHERE k > 2) GROUP BY lang, x.part
), kept AS (
  SELECT b.* FROM b LEFT JOIN parts USING (lang, ws) WHERE most IS NULL OR 100 * most < {COVERED} * a
), ranked AS (
  SELECT *, array_to_string(ws, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(ws, ' '))) AS rank FROM kept
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= {BEST}
"""
