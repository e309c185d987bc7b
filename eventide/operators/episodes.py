"""Plans of training episodes, and supports chosen for detectors. Every draw is a hash of (episode, purpose)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.operators.curate import shared_hash, weighted_choice

#: What makes an episode special, besides the normal one.
SCENARIOS = ["normal", "disjunction_cross_species", "disjunction_within_species", "fine_grained_snr", "fine_grained_pitch", "generalization_within_species"]


def uniform(key: str, seed: int) -> Column:
    return shared_hash(key, seed) / 4294967296.0


def plan(spark: SparkSession, episodes: int, clips: DataFrame, cluster: str, clip: str, support: int, query: int, seed: int = 0) -> DataFrame:
    """episode, scenario, source, role (support or query), slot and clip of each episode.

    Every episode draws a cluster by drawing a clip, so that large clusters are drawn more often, and then clips of the
    cluster with replacement. clips has an integer clip and its cluster. Clips are numbered in hash order, overall and
    in their cluster, and draws meet them by number.
    """
    total = clips.count()
    if not total:
        return spark.createDataFrame([], "episode long, scenario string, source string, role string, slot int, clip long")
    clips = clips.select(F.col(clip).cast("long").alias("clip"), F.col(cluster).alias("cluster"))
    order = [shared_hash("clip", seed), F.col("clip")]
    # Numbers run through hash ranges, so that no task orders all clips.
    banded = clips.withColumn("_band", F.floor(shared_hash("clip", seed) / (1 << 22)))
    own = F.row_number().over(Window.partitionBy("_band").orderBy(*order)) - 1
    sizes = banded.groupBy("_band").agg(F.count("*").alias("_m"))  # 1024 rows at most
    before = sizes.withColumn("_before", F.coalesce(F.sum("_m").over(Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_m")
    overall = banded.withColumn("_own", own).join(F.broadcast(before), "_band").select((F.col("_own") + F.col("_before")).alias("number"), "cluster")
    within = clips.select("cluster", "clip", (F.row_number().over(Window.partitionBy("cluster").orderBy(*order)) - 1).cast("long").alias("place"))
    counts = clips.groupBy("cluster").agg(F.count("*").alias("_size"))
    scenario = F.element_at(F.lit(SCENARIOS), (F.floor(uniform("episode", seed + 1) * len(SCENARIOS)) + 1).cast("int"))
    source = weighted_choice(uniform("episode", seed + 2), [("foreground", 0.2), ("background", 0.2), ("mixed", 0.6)])
    drawn = spark.range(episodes).select(F.col("id").alias("episode"), scenario.alias("scenario"), source.alias("source"))
    drawn = drawn.withColumn("number", F.floor(uniform("episode", seed + 3) * total))
    slots = F.explode(F.sequence(F.lit(0), F.lit(support + query - 1)))
    rows = drawn.join(overall, "number").join(counts, "cluster").withColumn("slot", slots).withColumn("_draw", F.col("episode") * (support + query) + F.col("slot"))
    rows = rows.withColumn("place", F.floor(uniform("_draw", seed + 4) * F.col("_size")))
    found = rows.join(within, ["cluster", "place"])
    return found.select("episode", "scenario", "source", F.when(F.col("slot") < support, "support").otherwise("query").alias("role"), "slot", "clip")


def hard_supports(chunks: DataFrame, by: str, budget: int) -> DataFrame:
    """Chunks with events (n_events > 0), all of them, and those without events that a first pass scored highest (p), up
    to budget in total; ties go to the later chunk."""
    full = F.col("n_events") > 0
    nth = F.row_number().over(Window.partitionBy(by, full).orderBy(F.desc("p"), F.desc("chunk")))
    hits = F.sum(full.cast("long")).over(Window.partitionBy(by))
    return chunks.withColumn("_n", nth).withColumn("_hits", hits).where(full | (F.col("_n") <= F.greatest(F.lit(0), budget - F.col("_hits")))).drop("_n", "_hits")


Scorer = Callable[[np.ndarray, int], np.ndarray]


def energy_scorer(samples: np.ndarray, per_frame: int) -> np.ndarray:
    """A stand-in for a trained model: the share of the largest frame power."""
    n = len(samples) // per_frame
    power = np.square(samples[: n * per_frame].reshape(n, per_frame)).mean(1) if n else np.zeros(0)
    return power / power.max() if n and power.max() > 0 else power


def score(chunks: DataFrame, keys: list[str], samples: str, per_frame: int, scorer: Scorer = energy_scorer) -> DataFrame:
    """keys, frame and p of every chunk of samples; the scorer is any function of samples and samples per frame."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row, x in zip(part[keys].itertuples(index=False), part[samples], strict=True):
                p = scorer(np.asarray(x, float), per_frame)
                yield pd.DataFrame({**{k: [v] * len(p) for k, v in zip(keys, row, strict=True)}, "frame": np.arange(len(p)), "p": p})

    kinds = ", ".join(f"{k} {chunks.schema[k].dataType.simpleString()}" for k in keys)
    return chunks.select(*keys, samples).mapInPandas(run, f"{kinds}, frame long, p double")


def extracted(rows: DataFrame, key: str, samples: str, rate: int, hole_s: float = 0.1, least_s: float = 0.03, pad_s: float = 0.05) -> DataFrame:
    """key, begin and end (samples) of the clips in every signal: where the envelope is high, short gaps closed, short
    runs dropped, and a little put on both sides."""
    from eventide.functions.signal import above
    from eventide.operators.runs import filled, long_enough, runs

    mask = above(rows, [key], samples, rate, max(1, rate // 100))
    found = long_enough(filled(runs(mask, key, "frame", F.col("on")), [key], int(hole_s * rate) - 2), int(least_s * rate))
    pad = int(pad_s * rate)
    return found.select(key, F.greatest(F.lit(0).cast("long"), F.col("run_begin") - pad).alias("begin"), F.least(F.col("run_end") + pad, F.col("n")).alias("end"))


def painted(events: DataFrame, by: str, frame_us: int) -> DataFrame:
    """by, frame and label of every frame that an event covers: 2 for positive events, else 1; the larger one where they
    overlap. Frames are [begin div frame, end div frame)."""
    last = F.floor(F.col("end_us") / frame_us) - 1
    first = F.floor(F.col("begin_us") / frame_us)
    rows = events.where(last >= first).select(by, F.explode(F.sequence(first, last)).alias("frame"), F.when(F.col("q") == "POS", 2).otherwise(1).alias("label"))
    return rows.groupBy(by, "frame").agg(F.max("label").alias("label"))
