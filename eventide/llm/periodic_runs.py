"""Periodic runs of words, from the longest previous factors of each text.

The suffix array of a text, by doubling, and the common prefixes of its neighbours give at every word the longest factor
that also starts earlier. Blocks of longest previous factors cut the text. A run that touches the border of a block is
found there by extending both sides of the border (Main); a run inside a block is the copy of one inside the block's
source, and is copied from the bucket of its start there.

Only runs of at least MIN_LENGTH words and MIN_POWER periods are asked for. In such a run the word after the first period
starts a previous factor of LEAST words or more, so shorter factors may count as single words: a run then still touches
a block of at least LEAST words, or lies inside one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm.common import table
from eventide.llm.wordhash import chunks, mixed

#: What a run needs: words, and periods.
MIN_LENGTH, MIN_POWER = 6, 4
#: Words of the previous factor that such a run has after its first period: MIN_LENGTH - 1 at a period of 1, more at others.
LEAST = min(MIN_LENGTH - 1, (MIN_POWER - 1) * 2)
#: Words at each side of a border that are compared before extensions are measured.
PEEK = 4
#: Bytes of texts that are cut into words at once, and words that are sorted at once.
CHUNK_BYTES, SORTED_WORDS = 1 << 20, 1 << 17
_FACTORS = [np.uint64(f) for f in np.random.default_rng(LEAST).integers(1, 1 << 63, LEAST, np.uint64) * np.uint64(2) + np.uint64(1)]


def names(words: np.ndarray) -> list[np.ndarray]:
    """At level k, for each place, the rank of the 2**k words from there on among all such; places without twins keep the
    rank of the level before. The last level has no equal ranks. Ranks of a level are equal where its words are."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    start = np.concatenate([[True], words[order][1:] != words[order][:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int32)
    rank[order] = np.flatnonzero(start)[np.cumsum(start) - 1]
    levels, width = [rank], 1
    while True:
        tied = ~start
        tied[:-1] |= ~start[1:]
        ix = np.flatnonzero(tied)
        if not len(ix):
            return levels
        places = order[ix]
        after = places + width
        key = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        group = rank[places]
        again = np.lexsort((key, group))
        places, key = places[again], key[again]
        order[ix] = places
        start[ix[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
        rank = rank.copy()
        firsts = np.where(start[ix], ix, 0)
        rank[places] = np.maximum.accumulate(firsts)
        levels.append(rank)
        width *= 2


def ahead(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common words from places a and b on; a and b differ."""
    n = len(levels[0])
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(a, b) < n
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        step = same.astype(np.int64) << k
        a, b, out = a + step, b + step, out + step
    return out


def behind(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common words before places a and b, which differ."""
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.minimum(a, b) >= 1 << k
        same = inside & (levels[k][np.maximum(a - (1 << k), 0)] == levels[k][np.maximum(b - (1 << k), 0)])
        step = same.astype(np.int64) << k
        a, b, out = a - step, b - step, out + step
    return out


def previous_factors(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Length of the longest factor at each place that also starts earlier, and where; 0 where it has under LEAST words."""
    n = len(levels[0])
    length, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
    suffixes = np.argsort(levels[-1])
    common = np.zeros(n, np.int64)
    common[1:] = ahead(levels, suffixes[:-1], suffixes[1:])
    common[common < LEAST] = 0
    near = common > 0
    near[:-1] |= common[1:] > 0
    ix = np.flatnonzero(near)
    if not len(ix):
        return length, source
    # Places leave the suffix order from the last to the first: the neighbours that one still has stand earlier.
    at = suffixes[ix].tolist()
    low = common[ix].tolist() + [0]
    left, right = list(range(-1, len(ix) - 1)), list(range(1, len(ix) + 2))  # one more: what -1 has on its right
    for x in np.argsort(-suffixes[ix]).tolist():
        a, b, i = left[x], right[x], at[x]
        before, after = low[x], low[b]
        if before >= after:
            length[i], source[i] = before, at[a] if before else 0
        else:
            length[i], source[i] = after, at[b]
        low[b] = min(before, after)
        right[a] = b
        if b < len(ix):
            left[b] = a
    return length, source


def blocks(length: np.ndarray) -> np.ndarray:
    """Starts of the blocks of at least LEAST words; words between them are blocks of one."""
    long, out, i = np.flatnonzero(length), [], 0
    for x, size in zip(long.tolist(), length[long].tolist(), strict=True):
        if x >= i:
            out.append(x)
            i = x + size
    return np.array(out, np.int64)


def at_borders(words: np.ndarray, levels: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of the runs that touch the border of a block, once for each period that they have.

    Where a run crosses border b between blocks of sizes x and y (LEAST, if that is more), a period is under a third of
    x + y: else the block before b would not end there. One side of b has two whole periods."""
    n = len(words)
    ends = starts + sizes
    before = np.ones(len(starts), np.int64)
    before[1:][starts[1:] == ends[:-1]] = sizes[:-1][starts[1:] == ends[:-1]]
    free = np.append(ends[:-1] != starts[1:], True)
    border = np.concatenate([starts, ends[free]])
    most = (np.concatenate([sizes + before, sizes[free] + LEAST]) - 1) // (MIN_POWER - 1)
    out = []
    for lo in range(0, len(border), 4096):
        b, m = border[lo : lo + 4096], most[lo : lo + 4096]
        period = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + 1
        b = np.repeat(b, m)
        for right in (True, False):
            keep = (b + 2 * period <= n) if right else (b - 2 * period >= 0)
            x, p = b[keep], period[keep]
            for j in range(PEEK):
                at = x + j if right else x - 1 - j - p
                # beyond one period there is nothing that must be equal
                same = (words[np.minimum(at, n - 1)] == words[np.minimum(at + p, n - 1)]) | (p <= j)
                x, p = x[same], p[same]
            first = x if right else x - p
            start, end = first - behind(levels, first, first + p), first + p + ahead(levels, first, first + p)
            good = end - start >= np.maximum(MIN_LENGTH, MIN_POWER * p)
            out.append(np.stack([start[good], end[good], p[good]], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def smallest_periods(runs: np.ndarray) -> np.ndarray:
    """One row for each start and end, with the least period, sorted; a run has all multiples of its period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[new]


def copied(found: np.ndarray, n: int, starts: np.ndarray, sizes: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """found and the copies of runs inside the sources of blocks. Runs lie in buckets by their starts; a block that overlaps
    its source is filled in parts that don't."""
    buckets: dict[int, list[tuple[int, int]]] = {}
    filled = np.zeros(n, bool)
    for s, e, p in found.tolist():
        buckets.setdefault(s, []).append((e, p))
        filled[s] = True
    if not buckets:
        return found
    for c, size, source in zip(starts.tolist(), sizes.tolist(), sources.tolist(), strict=True):
        if not filled[source + 1 : source + size].any():
            continue
        shift = c - source
        for x in range(0, size, shift):
            low, high = source + max(x, 1), source + min(x + shift, size)
            for s in (np.flatnonzero(filled[low:high]) + low).tolist():
                for e, p in list(buckets[s]):
                    if e < source + size:
                        own = buckets.setdefault(s + shift, [])
                        if (e + shift, p) not in own:
                            own.append((e + shift, p))
                        filled[s + shift] = True
    return np.array(sorted((s, e, p) for s, own in buckets.items() for e, p in own), np.int64).reshape(-1, 3)


def runs_of(words: np.ndarray) -> np.ndarray:
    """Rows (start, end, smallest period) of all runs of words (numbers), sorted by start, end."""
    if len(words) < MIN_LENGTH:
        return np.zeros((0, 3), np.int64)
    levels = names(words)
    length, source = previous_factors(levels)
    starts = blocks(length)
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    found = smallest_periods(at_borders(words, levels, starts, length[starts]))
    return smallest_periods(copied(found, len(words), starts, length[starts], source[starts]))


def twice(words: np.ndarray) -> np.ndarray:
    """Whether LEAST words from a place on stand twice (or seem to, by their hashes); without any there is no block."""
    grams = np.zeros(max(0, len(words) - LEAST + 1), np.uint64)
    for i, f in enumerate(_FACTORS):
        grams += words[i : i + len(grams)].astype(np.uint64) * f
    grams = mixed(grams)
    order = np.argsort(grams)
    same = grams[order][1:] == grams[order][:-1]
    out = np.zeros(len(words), bool)
    out[order[1:][same]] = True
    return out


def coded(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of all texts, the same as numbers one after another, and where each text starts. No two texts have a
    number in common, so that nothing is equal across their borders."""
    cut, codes, base = [], [], 0
    for text in texts:
        words = text.split()
        known = dict.fromkeys(words)
        for i, w in enumerate(known):
            known[w] = base + i
        base += len(known)
        cut.append(words)
        codes.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
    return cut, np.concatenate(codes) if codes else np.zeros(0, np.int64), np.cumsum([0, *map(len, cut)])


def found_in(texts: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and runs of each text."""
    cut, codes, bounds = coded(texts)
    repeats = np.zeros(len(texts), bool)
    repeats[np.searchsorted(bounds, np.flatnonzero(twice(codes)), "right") - 1] = True
    runs = [np.zeros((0, 3), np.int64)] * len(texts)
    open_ = np.flatnonzero(repeats)
    sizes = (bounds[1:] - bounds[:-1])[open_]
    for some in np.split(open_, np.flatnonzero(np.diff(np.cumsum(sizes) // SORTED_WORDS)) + 1) if len(open_) else []:
        found = runs_of(np.concatenate([codes[bounds[i] : bounds[i + 1]] for i in some]))
        at = np.cumsum([0, *(bounds[some + 1] - bounds[some])])
        owner = np.searchsorted(at, found[:, 0], "right") - 1
        for k, i in enumerate(some.tolist()):
            own = found[owner == k]
            runs[i] = own - [at[k], at[k], 0]
    yield from zip(cut, runs, strict=True)


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def find(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_words, runs (array of start, length and period, by start, then period) and collapsed (the text with one
    period left of each run, as words with one space between) of every row.

    Words are runs of characters other than ASCII white space, numbered from 0. A run is a stretch of words with a
    smallest period q, of MIN_LENGTH words and MIN_POWER periods or more, that no neighbouring word extends. A word goes
    if a run has it after its first q words. Null, empty and blank texts have no words and no runs. Keys are carried as
    they are: null and repeated ones too, a result for each row; other columns are not looked at, and key and text may
    have any names. No rows give none. A text is one task's work; its arrays take some 60 bytes a word, and 4 more for
    each doubling of its longest repeat.
    """
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(1), CHUNK_BYTES):
                sizes, lists, left = [], [], []
                for words, runs in found_in(texts):
                    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
                    sizes.append(len(words))
                    lists.append([{"start": s, "length": e - s, "period": p} for s, e, p in runs.tolist()])
                    if len(runs):
                        change = np.zeros(len(words) + 1, np.int64)
                        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
                        np.add.at(change, runs[:, 1], -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
                    left.append(b" ".join(words))
                kinds = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(sizes, pa.int64()), pa.array(lists, kinds), pa.array(left, pa.binary()).cast(pa.string())], names=schema.fieldNames())

    found = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(search, schema)
    return found.withColumnRenamed("key", key)


def described(found: DataFrame, key: str) -> DataFrame:
    """key, n_runs, start, length, period and exponent_milli of the longest run (ties: the first, then the least period;
    nulls without runs), and SHA-256 of all runs and of the collapsed text, of what find() gives."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    length = -best["less"]
    exponent = F.call_function("div", 1000 * length, best["period"])
    return found.select(
        F.col(f"`{key}`").alias(key), F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), length.alias("length"), best["period"].alias("period"),
        exponent.alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_tail(text: Column, doc_id: Column) -> Column:
    """text; where h = crc32 of the decimal doc_id is a multiple of 10, its words from a on are replaced by those that
    repeat with period p: a = g % n and p = 1 + floor((n - a) / (3 + g % 8)) of n words, for g = floor(h / 10)."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def changed(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, (a + F.pmod(i - a, p)).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " "))

    # The words are bound as the one element of an array: a lambda would cut the text anew for each of them.
    chosen = F.coalesce(F.pmod(h, F.lit(10)) == 0, F.lit(False))
    return F.when(chosen, F.coalesce(F.transform(F.array(words_of(text)), changed)[0], text)).otherwise(text)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents, of which a tenth get a periodic tail first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", with_tail(F.col("text"), F.col("doc_id")).alias("text"))
    return described(find(docs, "doc_id", "text"), "doc_id")


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda r, x: xor(xor(r, x) >> 1, 3988292384 * (xor(r, x) & 1))), 4294967295) AS h0 FROM documents
), c AS (
  SELECT doc_id, w, len(w)::BIGINT AS n, h0 AS h, h0 // 10 AS g FROM d
), t AS (
  SELECT doc_id, n, w, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM c
), m AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_concat(w[1 : a], list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1])) END AS w FROM t
), k AS (
  SELECT doc_id, n, unnest(list_transform(range(n - 4), lambda i: struct_pack(i := i, gram := w[i + 1 : i + 5]))) AS k FROM m WHERE n >= 6
), grams AS (
  SELECT doc_id, n, k.i AS i, hash(k.gram) AS x, k.gram AS gram FROM k
), same AS (
  SELECT x.doc_id, y.i - x.i AS p, x.i FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.x = y.x AND x.gram = y.gram AND x.i < y.i AND 4 * (y.i - x.i) <= x.n
), isles AS (
  SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS isle FROM same
), runs AS (
  SELECT doc_id, s, e, min(p) AS p FROM (SELECT doc_id, p, min(i) AS s, max(i) + 5 + p AS e FROM isles GROUP BY doc_id, p, isle) WHERE e - s >= greatest(6, 4 * p) GROUP BY doc_id, s, e
), gone AS (
  SELECT doc_id, list_sort(list_distinct(flatten(list(range(s + p, e))))) AS gone FROM runs GROUP BY doc_id
), r AS (
  SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := s, e := e, p := p), struct_pack(l := s - e, s := s, p := p)) AS b, string_agg(s || ',' || (e - s) || ',' || p || chr(10), '' ORDER BY s, p) AS lines FROM runs GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM m) u
  ANTI JOIN (SELECT doc_id, unnest(gone) AS i FROM gone) o USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, (b.e - b.s)::BIGINT AS length, b.p::BIGINT AS period, (1000 * (b.e - b.s) // b.p)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM m LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
