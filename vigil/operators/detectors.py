"""Detectors over gap-free bars, and their candidates and episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vigil import constants
from vigil.functions.rolling import rolling_stats
from vigil.operators.cooldown import apply_cooldown


def volume_zscore(grid: DataFrame, *, time: str = "open_time", sum_rows: int = constants.Z_SUM_MINUTES, trail_rows: int = constants.Z_TRAIL_MINUTES, scope: str = "continuous", day: str = "day") -> DataFrame:
    """Adds score: how many deviations the volume of the last sum_rows bars lies above those before it.

    Mean and deviation are those of the trail_rows earlier sums, without the present one; score is null until
    there are as many, and where the deviation is zero.  scope "day" starts anew every day, in
    which case a day of 1440 bars has no score at all; "continuous" goes on over midnight.
    """
    if scope not in ("continuous", "day"):
        raise ValueError(f"unknown scope {scope}")
    keys = ["pair", *([day] if scope == "day" else [])]
    short = Window.partitionBy(*keys).orderBy(time).rowsBetween(-(sum_rows - 1), 0)  # a few rows
    table = grid.withColumn("_v", F.when(F.count("quote_volume").over(short) == sum_rows, F.sum("quote_volume").over(short)))
    table = rolling_stats(table, ["_v"], trail_rows, keys, time, behind=1)
    return table.withColumn("score", F.when(F.col("_v_sd") > 0, F.try_divide(F.col("_v") - F.col("_v_mean"), F.col("_v_sd")))).drop("_v", "_v_mean", "_v_sd")


def price_jump(grid: DataFrame, *, time: str = "open_time", rows: int = constants.JUMP_MINUTES) -> DataFrame:
    """Adds score: the change of the close against that of rows bars before."""
    before = F.lag("close", rows).over(Window.partitionBy("pair").orderBy(time))
    return grid.withColumn("score", F.try_divide("close", F.when(before != 0, before)) - 1)


def above(scored: DataFrame, threshold: float, *, inclusive: bool = False) -> DataFrame:
    """Rows whose score exceeds the threshold, or also equals it; NaN and null never do."""
    score = F.col("score")
    return scored.where(~F.isnan(score) & ((score >= threshold) if inclusive else (score > threshold)))


def candidates(scored: DataFrame, detector: str, *, ts: str, frequency: str = "", floor: float | None = None) -> DataFrame:
    """pair, ts_utc, detector, frequency, score, day of the rows at or above the detector's floor.

    Forest scores may equal the floor; the others must exceed it.
    """
    least = constants.FLOORS[detector] if floor is None else floor
    rows = above(scored, least, inclusive=detector == "upstream_rf")
    return rows.select("pair", F.col(ts).alias("ts_utc"), F.lit(detector).alias("detector"), F.lit(frequency).alias("frequency"), "score", F.date_format(ts, "yyyy-MM-dd").alias("day"))


def on_day(hits: DataFrame, day: str, *, ts: str = "ts_utc", carried: DataFrame | None = None, cooldown: int = constants.COOLDOWN_SECONDS) -> DataFrame:
    """Episodes of one day alone: scores come from all bars before it, the cooldown only from what was carried over."""
    start = F.to_timestamp_ntz(F.lit(day))
    own = hits.where((F.col(ts) >= start) & (F.col(ts) < start + F.expr("interval 1 day")))
    kept = apply_cooldown(own, ["pair", "detector", "frequency"], ts=ts, seconds=cooldown, carried=carried)
    return kept.withColumn("day", F.date_format(ts, "yyyy-MM-dd"))


def forest_thresholds(frequency: str) -> dict[str, float]:
    return {"tau_anchor": constants.ANCHOR, "tau_star": constants.STAR[frequency]}


def episodes(found: DataFrame, thresholds: dict[str, float], *, inclusive: bool, seconds_available: int, cooldown: int = constants.COOLDOWN_SECONDS, carried: DataFrame | None = None) -> DataFrame:
    """Episodes of candidates for each labelled threshold, each with a cooldown of its own."""
    spark = found.sparkSession
    labels = F.broadcast(spark.createDataFrame(list(thresholds.items()), "threshold_label string, threshold double"))
    passes = (F.col("score") >= F.col("threshold")) if inclusive else (F.col("score") > F.col("threshold"))
    hits = found.join(labels, passes & ~F.isnan("score"))
    keys = ["pair", "detector", "frequency", "threshold_label", "threshold"]
    kept = apply_cooldown(hits, keys, seconds=cooldown, carried=carried)
    available = (F.col("ts_utc") + F.make_interval(secs=F.lit(seconds_available))).alias("ts_available_utc")
    return kept.withColumn("day", F.date_format("ts_utc", "yyyy-MM-dd")).select("*", available).select(*constants.EPISODE_COLUMNS)
