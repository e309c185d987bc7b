"""Run-length operators. A mask is a table of runs (by, run_begin, run_end), ends exclusive; frames count from 0."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.operators.scans import islands, sliced
from eventide.shared import materialize


def runs(frames: DataFrame, by: str, frame: str, on: Column) -> DataFrame:
    """Runs of frames where `on` holds, with n, the number of frames of the group."""
    sizes = frames.groupBy(by).agg((F.max(frame) + 1).alias("n"))
    kept = frames.where(on).select(by, F.col(frame).alias("run_begin"), (F.col(frame) + 1).alias("run_end"))
    found = islands(sliced(kept, [by], "run_begin"), "run_begin", "run_end")
    return found.groupBy(by, "_island").agg(F.min("run_begin").alias("run_begin"), F.max("run_end").alias("run_end")).drop("_island").join(sizes, by)


def exported(rows: DataFrame) -> DataFrame:
    """Runs as they are written to label files: one that is still open at the end stops at the last frame."""
    return rows.withColumn("run_end", F.least("run_end", F.col("n") - 1))


def filled(rows: DataFrame, by: list[str], most: Column | int) -> DataFrame:
    """Runs with the holes of at most `most` frames between them closed. Groups are cut into slices by the first of by, if
    rows don't come with slices already."""
    others = [c for c in rows.columns if c not in (*by, "run_begin", "run_end", "_by", "_slice")]
    cut = islands(rows if "_slice" in rows.columns else sliced(rows, by[:1], "run_begin"), "run_begin", "run_end", most, by[1:])
    return cut.groupBy(*by, "_island").agg(F.min("run_begin").alias("run_begin"), F.max("run_end").alias("run_end"), *(F.first(c).alias(c) for c in others)).drop("_island")


def long_enough(rows: DataFrame, least: Column | int) -> DataFrame:
    """Runs of `least` frames or more; those that touch the first or the last frame are always dropped."""
    return rows.where((F.col("run_end") - F.col("run_begin") >= least) & (F.col("run_begin") > 0) & (F.col("run_end") < F.col("n")))


def pooled(frames: DataFrame, by: str, frame: str, value: str, size: int) -> DataFrame:
    """The largest value of every `size` frames; a last group that isn't full is dropped."""
    pool = F.floor(F.col(frame) / size)
    return frames.groupBy(by, pool.alias("pool")).agg(F.max(value).alias(value), F.count("*").alias("_n")).where(F.col("_n") == size).drop("_n")


def windows(frames: DataFrame, frame: str, size: int) -> DataFrame:
    """frames with the windows (half a window apart) that hold them, and the place in each."""
    half = size // 2
    last = F.floor(F.col(frame) / half)
    first = F.greatest(F.lit(0).cast("long"), last - 1)
    return frames.withColumn("window", F.explode(F.sequence(first, last))).withColumn("place", F.col(frame) - F.col("window") * half)


def whole_windows(frames: DataFrame, by: str, frame: str, size: int) -> DataFrame:
    """windows() without those that run over the end of their group."""
    sizes = frames.groupBy(by).agg((F.max(frame) + 1).alias("_n"))
    return windows(frames, frame, size).join(sizes, by).where(F.col("window") * (size // 2) + size <= F.col("_n")).drop("_n")


def stitched(windowed: DataFrame, by: str, size: int) -> DataFrame:
    """One row for each frame of overlapping windows: the middle half of each window, and the outer quarters of the
    first and the last one."""
    last = windowed.groupBy(by).agg(F.max("window").alias("_last"))
    quarter = size // 4
    middle = (F.col("place") >= quarter) & (F.col("place") < size - quarter)
    ends = ((F.col("window") == 0) & (F.col("place") < quarter)) | ((F.col("window") == F.col("_last")) & (F.col("place") >= size - quarter))
    return windowed.join(last, by).where(middle | ends).drop("_last")


#: The grid of logits that adaptive thresholds are taken from, and the probabilities they stand for.
LOGITS = [round(-2 + 0.05 * i, 2) for i in range(81)]
THRESHOLDS = [1 / (1 + math.exp(-t)) for t in LOGITS]
FRAME_RATE = 25


#: What a slice of a group tells of each grid point: how many islands of runs it has, the first and the last of them, and
#: whether the slice begins and ends within one; of those between, how many are long enough, and what their fits add up to.
PART = "islands array<long>, first_begin array<long>, first_end array<long>, last_begin array<long>, last_end array<long>, starts array<boolean>, open array<boolean>, kept array<long>, fit array<double>"


def fits(begin: np.ndarray, end: np.ndarray, n: int, mean: float, std: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Which islands count (long enough, and not at an end of the group), and how well the length of each fits."""
    counted = (end - begin >= least) & (begin > 0) & (end < n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return counted, np.exp(-0.5 * (((end - begin) / FRAME_RATE - mean) / std) ** 2)


def best_point(kept: np.ndarray, fit: np.ndarray) -> tuple[float | None, float]:
    """The best score above 0.1, the first of equal ones, and its logit; else null and 0. NaN is more than any number."""
    with np.errstate(divide="ignore", invalid="ignore"):
        score = fit / kept * np.exp(-0.5 * np.square(LOGITS))
    score = np.where(kept > 0, np.where(np.isnan(score), np.inf, score), -np.inf)
    at = int(np.argmax(score))
    return (float(score[at]) if np.isfinite(score[at]) else math.nan, LOGITS[at]) if score[at] > 0.1 else (None, 0.0)


def slice_islands(frame: np.ndarray, level: np.ndarray, hole: float) -> tuple[np.ndarray, ...]:
    """point, begin and end of the islands of runs of all grid points, in this order, of frames in order with the number of
    grid points that each reaches; an island that is still open ends behind the last frame."""
    on = np.zeros((len(LOGITS), len(frame) + 2), bool)
    on[:, 1:-1] = np.arange(len(LOGITS))[:, None] < level
    point, first = np.nonzero(on[:, 1:] & ~on[:, :-1])
    _, last = np.nonzero(~on[:, 1:] & on[:, :-1])
    ends = np.append(frame, frame[-1] + 1)
    begin, end = ends[first], ends[last]
    apart = np.ones(len(begin) + 1, bool)
    apart[1:-1] = (point[1:] != point[:-1]) | (begin[1:] - end[:-1] > hole - 1)
    return point[apart[:-1]], begin[apart[:-1]], end[apart[1:]]


def told(table: pa.Table) -> dict:
    """The columns of one row of a group that all its rows have alike."""
    return {c: table.column(c)[0].as_py() for c in ("n", "rows", "mean_s", "std_s", "hole", "least")}


def slice_scores(table: pa.Table) -> dict:
    """Of a whole group score and logit, of a slice of a longer one PART (as a row)."""
    x, points = told(table), len(LOGITS)
    frame, p = table.column("frame").to_numpy(), table.column("p").fill_null(-math.inf).to_numpy()
    order = np.argsort(frame, kind="stable")
    frame, level = frame[order], np.searchsorted(THRESHOLDS, p[order], "right")
    point, begin, end = slice_islands(frame, level, x["hole"])
    if x["rows"] == len(frame):
        counted, fit = fits(begin, end, x["n"], x["mean_s"], x["std_s"], x["least"])
        score, logit = best_point(np.bincount(point[counted], minlength=points), np.bincount(point[counted], fit[counted], points))
        return {"score": score, "logit": logit}
    number = np.bincount(point, minlength=points)
    low = np.cumsum(number) - number
    inner = np.ones(len(point), bool)
    inner[low[number > 0]] = inner[(low + number - 1)[number > 0]] = False
    counted, fit = fits(begin, end, x["n"], x["mean_s"], x["std_s"], x["least"])
    counted &= inner
    pick = lambda v, at: np.append(v, 0)[np.where(number > 0, at, len(v))]
    out = {"islands": number, "first_begin": pick(begin, low), "first_end": pick(end, low), "last_begin": pick(begin, low + number - 1), "last_end": pick(end, low + number - 1)}
    reached = np.arange(points)
    out |= {"starts": reached < level[0], "open": reached < level[-1], "kept": np.bincount(point[counted], minlength=points), "fit": np.bincount(point[counted], fit[counted], points)}
    return {"first": int(frame[0]), **{k: v.tolist() for k, v in out.items()}}


def joined_scores(table: pa.Table) -> tuple[float | None, float]:
    """Score and logit of a group from its slices in order: the last island of each may go on in the next."""
    x, rows = told(table), sorted(table.select(["_slice", "first", *(c.split()[0] for c in PART.split(", "))]).to_pylist(), key=lambda r: r["_slice"])
    points = len(LOGITS)
    kept, total = np.zeros(points, np.int64), np.zeros(points)
    held, is_open, begin, end = np.zeros(points, bool), np.zeros(points, bool), np.zeros(points, np.int64), np.zeros(points, np.int64)

    def settle(at: np.ndarray, b: np.ndarray, e: np.ndarray) -> None:
        counted, fit = fits(b, e, x["n"], x["mean_s"], x["std_s"], x["least"])
        counted &= at
        kept[counted] += 1
        total[counted] += fit[counted]

    for row in rows:
        r = {k: np.array(v) for k, v in row.items() if isinstance(v, list)}
        end = np.where(held & is_open & ~r["starts"], row["first"], end)
        is_open = is_open & r["starts"]
        some, one = r["islands"] > 0, r["islands"] == 1
        joined = held & some & (is_open | (r["first_begin"] - end <= x["hole"] - 1))
        settle(held & some & ~joined, begin, end)
        settle(some & ~one, np.where(joined, begin, r["first_begin"]), r["first_end"])
        kept += r["kept"]
        total += r["fit"]
        begin = np.where(some, np.where(joined & one, begin, r["last_begin"]), begin)
        end, is_open, held = np.where(some, r["last_end"], end), np.where(some, r["open"], is_open), held | some
    settle(held, begin, np.where(is_open, x["n"], end))
    return best_point(kept, total)


def adaptive_threshold(frames: DataFrame, support: DataFrame, by: str) -> DataFrame:
    """by, score and logit: the grid point whose runs last most as the support events do.

    support has by, mean_s, std_s and min_s of the support events' durations. A grid point scores the mean likelihood of
    its runs' durations (after holes are closed and short runs dropped) times a normal prior on the logit. The first of
    the best wins; if none is above 0.1, or std_s is null, logit 0 does.

    Only frames are shuffled, never frames by grid points: a group, or a slice of a long one, goes over the whole grid at
    once, and a slice leaves a row.
    """
    rules = support.select(by, "mean_s", "std_s", F.floor(FRAME_RATE * F.least(F.greatest(0.5 * F.col("min_s"), F.lit(0.0)), F.lit(1.0))).cast("double").alias("hole"), F.floor(FRAME_RATE * F.least(F.lit(0.5), 0.5 * F.col("min_s"))).cast("double").alias("least"))
    sizes = frames.groupBy(by).agg((F.max("frame") + 1).alias("n"), F.count("*").alias("rows"))
    known = rules.dropna().join(sizes, by)
    cut = sliced(frames.select(by, F.col("frame").cast("long").alias("frame"), F.col("p").cast("double").alias("p")), [by], "frame").join(known, by)
    names = ["n", "rows", "mean_s", "std_s", "hole", "least"]
    kind = frames.schema[by].dataType.simpleString()
    schema = f"{by} {kind}, _slice int, n long, rows long, mean_s double, std_s double, hole double, least double, score double, logit double, first long, {PART}"
    fields = pa.schema([(c.split()[0], {"array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<boolean>": pa.list_(pa.bool_())}[c.split()[1]]) for c in PART.split(", ")])

    def slices(table: pa.Table) -> pa.Table:
        found = slice_scores(table)
        own = [table.column(c).slice(0, 1).combine_chunks() for c in (by, "_slice", *names)]
        own += [pa.array([found.get(c)], t) for c, t in (("score", pa.float64()), ("logit", pa.float64()), ("first", pa.int64()))]
        return pa.Table.from_arrays(own + [pa.array([found.get(f.name)], f.type) for f in fields], names=[by, "_slice", *names, "score", "logit", "first", *fields.names])

    def together(table: pa.Table) -> pa.Table:
        score, logit = joined_scores(table)
        return pa.Table.from_arrays([table.column(by).slice(0, 1).combine_chunks(), pa.array([score], pa.float64()), pa.array([logit])], names=[by, "score", "logit"])

    parts = materialize(cut.select(by, "_by", "_slice", "frame", "p", *names).groupBy("_by", "_slice").applyInArrow(slices, schema))
    best = parts.where("logit is not null").select(by, "score", "logit")
    best = best.unionByName(parts.where("logit is null").groupBy(by).applyInArrow(together, f"{by} {kind}, score double, logit double"))
    return support.select(by).join(best, by, "left").select(by, "score", F.coalesce("logit", F.lit(0.0)).alias("logit"))
