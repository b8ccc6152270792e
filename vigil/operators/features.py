"""The rolling feature matrix of trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from vigil import constants
from vigil.functions.numeric import cycle, finite, known, relative_change, round_even
from vigil.functions.rolling import rolling_stats
from vigil.operators.timegrid import bin_start, buys, chunks


def mean_of_last(x: str, size: int, order: Window) -> Column:
    """The mean of the last few rows, null until there are as many."""
    frame = order.rowsBetween(-(size - 1), 0)
    return F.when(F.count(x).over(frame) == size, known(F.avg(F.col(x).cast("double")).over(frame)))


def feature_matrix(trades: DataFrame, seconds: int, size: int, *, price_size: int = constants.PRICE_CHUNKS, digits: int | None = constants.ROUND_DIGITS, same: Column | None = None) -> DataFrame:
    """pair, date and the twelve features, for each chunk with all of them.

    All rolling statistics are changes against the row before.  Rows with a missing feature go,
    then values are rounded; infinite ones stay, for drop_nonfinite() to count.
    """
    order = Window.partitionBy("pair").orderBy("bin")
    rolled = rolling_stats(chunks(trades, seconds, same=same), ["rush_sum", "trade_count", "volume_sum", "price_mean"], size, ["pair"], "bin")
    parts = {
        "std_rush_order": F.col("rush_sum_sd"), "avg_rush_order": F.col("rush_sum_mean"), "std_trades": F.col("trade_count_sd"), "std_volume": F.col("volume_sum_sd"), "avg_volume": F.col("volume_sum_mean"),
        "std_price": F.col("price_mean_sd"), "avg_price": mean_of_last("price_mean", price_size, order), "avg_price_max": mean_of_last("price_max", price_size, order),
    }
    table = rolled.select("pair", "bin", *(x.alias(name) for name, x in parts.items()))
    changes = [relative_change(F.col(c), F.lag(c).over(order)).alias(c) for c in parts]
    hour, minute = cycle(F.hour("bin"), 23), cycle(F.minute("bin"), 59)
    out = table.select("pair", F.col("bin").alias("date"), *changes, hour[0].alias("hour_sin"), hour[1].alias("hour_cos"), minute[0].alias("minute_sin"), minute[1].alias("minute_cos")).na.drop(subset=list(constants.FEATURES))
    return out if digits is None else out.withColumns({c: round_even(F.col(c), digits) for c in constants.FEATURES})


def all_finite(columns: tuple[str, ...] = constants.FEATURES) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & finite(F.col(c))
    return out


def drop_nonfinite(frame: DataFrame, columns: tuple[str, ...] = constants.FEATURES) -> DataFrame:
    return frame.where(all_finite(columns))


def drop_nonfinite_counted(frame: DataFrame, columns: tuple[str, ...] = constants.FEATURES) -> tuple[DataFrame, Observation]:
    """drop_nonfinite(), and how many rows were dropped and kept: known after the first action on the frame, which counts on its way."""
    seen = Observation()
    watched = frame.observe(seen, F.count_if(~all_finite(columns)).alias("dropped"), F.count_if(all_finite(columns)).alias("kept"))
    return drop_nonfinite(watched, columns), seen


def count_nonfinite(frame: DataFrame, columns: tuple[str, ...] = constants.FEATURES) -> DataFrame:
    return frame.agg(F.count_if(~all_finite(columns)).alias("dropped"), F.count_if(all_finite(columns)).alias("kept"))


def scorable(trades: DataFrame, archive_days: DataFrame, seconds: int, size: int, *, warmup_days: int = constants.WARMUP_DAYS) -> DataFrame:
    """pair, bin for the chunks that a build of their own day can score.

    archive_days (pair, day) tells which days there are.  A build takes its day and earlier ones,
    nearest first and without a gap, until it has size chunks before the day or warmup_days days.  So a chunk is scorable
    if the chunk size rows before it lies in the same run of days, no more than warmup_days back.
    """
    by_day = Window.partitionBy("pair").orderBy("day")
    runs = archive_days.distinct().withColumn("_new", F.when(F.datediff("day", F.lag("day").over(by_day)) == 1, 0).otherwise(1))
    runs = runs.select("pair", "day", F.sum("_new").over(by_day.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    bins = buys(trades).select("pair", bin_start(F.col("ts"), seconds).alias("bin")).distinct().withColumn("day", F.to_date("bin")).join(runs, ["pair", "day"])
    order = Window.partitionBy("pair", "run").orderBy("bin")
    first = F.lag("day", size).over(order)
    return bins.withColumn("_first", first).where(F.datediff("day", "_first") <= warmup_days).select("pair", "bin")
