"""Detection by templates: the first events of each recording, correlated with the rest of it.

Recordings are spectrograms in chunks of frames. Templates are rows of a table, a few for each recording, and meet each
other and the recording's chunks by joins, so thresholds and detections of all recordings are one job. Peaks of a template
that are too close to each other compete; they fall into islands that share no conflict, and each island is settled alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions.signal import painted_segments
from eventide.operators.scans import islands, sliced
from eventide.shared import materialize

#: Bins by which a template may be moved up and down; it lacks as many at each end.
SHIFT = 2
#: Frames, about, that are searched at once: shorter chunks are put together first.
TOGETHER = 1024


def moved_correlation(frames: np.ndarray, template: np.ndarray, most: int) -> np.ndarray:
    """Normalised cross-correlation of a template (frames by bins) with every stretch of frames of its length, moved by 0
    to `most` bins; the best of these for each stretch."""
    w, bins = template.shape
    n = len(frames) - w + 1
    if n < 1 or not w:
        return np.zeros(0)
    t = template - template.mean()
    size, best = (t**2).sum(), np.full(n, -np.inf)
    for k in range(most + 1):
        x = frames[:, k : k + bins]
        windows = np.lib.stride_tricks.sliding_window_view(x, w, axis=0)
        dots = np.einsum("nbw,wb->n", windows, t)
        sums, squares = (np.concatenate([[0.0], np.cumsum(v.sum(1))]) for v in (x, x**2))
        total = sums[w:] - sums[:-w]
        spread = np.maximum(0, squares[w:] - squares[:-w] - total**2 / (w * bins)) * size
        best = np.maximum(best, np.divide(dots, np.sqrt(spread), out=np.zeros(n), where=spread > 1e-18))
    return best


def cut(chunks: DataFrame, spans: DataFrame, by: str, keys: list[str], first: str, end: str, size: int) -> DataFrame:
    """by, keys and frames from first to end (exclusive) of each span, out of the chunks that it reaches."""
    reached = spans.where(F.col(end) > F.col(first)).select(by, *keys, first, end, F.explode(F.sequence(F.floor(F.col(first) / size), F.floor((F.col(end) - 1) / size))).alias("chunk"))
    low = F.greatest(F.lit(0).cast("long"), F.col(first) - F.col("chunk") * size)
    n = F.least(F.size("frames").cast("long"), F.col(end) - F.col("chunk") * size) - low
    parts = reached.join(chunks, [by, "chunk"]).where(n > 0).select(by, *keys, "chunk", F.slice("frames", (low + 1).cast("int"), n.cast("int")).alias("x"))
    return parts.groupBy(by, *keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "x"))), lambda p: p["x"])).alias("frames"))


def as_matrix(x: object) -> np.ndarray:
    return np.stack([np.asarray(row, float) for row in x])


def thresholds(templates: DataFrame, by: str) -> DataFrame:
    """by and threshold: the best correlation of any template with another of its recording that is at least as long.
    Recordings with a single template are out. templates: by, event and frames (inner bins); a few for each recording."""
    other = templates.select(by, F.col("event").alias("other"), F.col("frames").alias("wide"))
    pairs = templates.join(other, by).where((F.col("event") != F.col("other")) & (F.size("wide") >= F.size("frames")))

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[[by]].assign(score=[moved_correlation(as_matrix(y), as_matrix(x), 0).max() for x, y in zip(part["frames"], part["wide"], strict=True)])

    kind = templates.schema[by].dataType.simpleString()
    return pairs.select(by, "frames", "wide").mapInPandas(compare, f"{by} {kind}, score double").groupBy(by).agg(F.max("score").alias("threshold"))


def with_following(chunks: DataFrame, by: str, size: int, frames: int, before: int = 1) -> DataFrame:
    """by, chunk, frames: each chunk with `frames` frames of those behind it and `before` of those ahead of it, and lead, how
    many of the latter there are."""
    to, i = F.col("_to"), F.col("chunk")
    sent = chunks.select(by, "chunk", "frames", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), i - -(-frames // size)), i + -(-before // size))).alias("_to"))
    low = F.greatest(F.lit(0).cast("long"), to * size - before - i * size)
    high = F.least(F.size("frames").cast("long"), (to + 1) * size + frames - i * size)
    parts = sent.select(by, "_to", "chunk", low.alias("low"), F.slice("frames", (low + 1).cast("int"), F.greatest(F.lit(0).cast("long"), high - low).cast("int")).alias("x"))
    met = parts.groupBy(by, "_to").agg(F.sort_array(F.collect_list(F.struct("chunk", "x"))).alias("p"))
    own = F.exists("p", lambda q: q["chunk"] == F.col("_to"))
    lead = F.aggregate("p", F.lit(0), lambda s, q: s + F.when(q["chunk"] < F.col("_to"), F.size(q["x"])).otherwise(0))
    return met.where(own).select(by, F.col("_to").alias("chunk"), F.flatten(F.transform("p", lambda q: q["x"])).alias("frames"), lead.alias("lead"))


def candidates(chunks: DataFrame, templates: DataFrame, limits: DataFrame, by: str, size: int, longest: int, shift: int) -> DataFrame:
    """by, event, frame, score and length of the local maxima of each template's correlation with its recording from frame
    `start` on (a column of limits, beside threshold), as high as the threshold."""
    many = max(1, TOGETHER // size)
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "frames"))), lambda c: c["frames"]))
    chunks = chunks.select(by, F.floor(F.col("chunk") / many).alias("block"), "chunk", "frames").groupBy(by, "block").agg(whole.alias("frames")).withColumnRenamed("block", "chunk")
    size *= many
    wide = with_following(chunks, by, size, longest)
    meet = wide.join(limits, by).join(templates.withColumnRenamed("frames", "template"), by)

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, event, chunk, frames, lead, template, start, threshold in part.itertuples(index=False):
                t, origin = as_matrix(template), chunk * size - lead
                c = moved_correlation(as_matrix(frames), t, 2 * shift)[max(0, start - origin) :]
                origin = max(origin, start)
                # What lies outside is no neighbour: the ends of the searched part are no peaks.
                at = np.flatnonzero((c[1:-1] > c[:-2]) & (c[1:-1] >= c[2:]) & (c[1:-1] >= threshold)) + 1
                at = at[(at + origin >= chunk * size) & (at + origin < (chunk + 1) * size)]
                rows += [(key, event, int(i + origin), float(c[i]), len(t)) for i in at]
            yield pd.DataFrame(rows, columns=[by, "event", "frame", "score", "length"])

    kinds = ", ".join(f"{c} {templates.schema[c].dataType.simpleString()}" for c in (by, "event"))
    return meet.select(by, "event", "chunk", "frames", "lead", "template", "start", "threshold").mapInPandas(search, f"{kinds}, frame long, score double, length long")


def suppressed(peaks: DataFrame, by: list[str], distance: Column) -> DataFrame:
    """The peaks (frame, score) of each group that are left when the higher of any two that are closer than a distance (one
    for each group) wins; the earlier of two as high. Where no peak is closer than the distance to the next, another island
    begins, and nothing in it depends on the last."""
    cut_ = islands(sliced(peaks.withColumn("_near", distance.cast("long")), by, "frame"), "frame", "frame", F.col("_near") - 1)

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("frame")
        frames, near = part["frame"].to_numpy(), part["_near"].iloc[0]
        left, right = np.searchsorted(frames, frames - near, "right"), np.searchsorted(frames, frames + near, "left")
        out, kept = np.zeros(len(part), bool), np.zeros(len(part), bool)
        for i in np.lexsort((frames, -part["score"].to_numpy())):
            if not out[i]:
                kept[i] = True
                out[left[i] : right[i]] = True
        return part[kept]

    rows = cut_.select(*peaks.columns, "_near", "_island")
    return rows.groupBy(*by, "_island").applyInPandas(settle, rows.schema).drop("_near", "_island")


def detect(chunks: DataFrame, supports: DataFrame, by: str, size: int, rate: int, hop: int, longest: int, shift: int = SHIFT) -> DataFrame:
    """by, begin_s and end_s of what the templates of each recording find in the frames behind them.

    chunks: by, chunk (from 0) and frames (arrays of bins; size of them, but for the last chunk); supports: by, event, first
    and end (frames, exclusive), a few for each recording and at most `longest` frames long. A recording's threshold is the
    best correlation between its own templates; one with a single template has none, and is out. A template lacks `shift`
    bins at each end and is moved by so many up and down. Its peaks are as far apart as it is long; each paints the frames
    of its template but the last. The search begins behind the last support.
    """
    inner = F.transform("frames", lambda x: F.slice(x, shift + 1, F.size(x) - 2 * shift))
    own = cut(chunks, supports, by, ["event"], "first", "end", size).withColumn("frames", inner)
    limits = thresholds(own, by).join(supports.groupBy(by).agg(F.max("end").alias("start")), by)
    # Peaks are written: islands read their rows several times, and would search the recordings as often.
    found = materialize(candidates(chunks, own, limits, by, size, longest, shift))
    kept = materialize(suppressed(found, [by, "event"], F.col("length")))
    return painted_segments(kept.withColumnRenamed("length", "frames"), by, rate, hop)
