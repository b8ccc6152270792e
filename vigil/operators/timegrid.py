"""Time bins of trades and gap-free time grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def bin_start(ts: Column, seconds: int) -> Column:
    """The start of the bin that holds ts; bins count from the epoch, so they also start each day."""
    whole = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(whole - F.pmod(whole, F.lit(seconds * 1_000_000))).cast("timestamp_ntz")


def buys(trades: DataFrame) -> DataFrame:
    return trades.where(F.col("side") == "buy")


def bin_trades(trades: DataFrame, seconds: int) -> DataFrame:
    """Per pair and non-empty bin of buys: trades, volume, mean and highest price."""
    volume = F.sum(F.col("quote_volume").cast("decimal(28,8)")).cast("double")
    return buys(trades).groupBy("pair", bin_start(F.col("ts"), seconds).alias("bin")).agg(
        F.count("price").alias("trade_count"), volume.alias("volume_sum"), F.avg("price").alias("price_mean"), F.max("price").alias("price_max")
    )


def rush_orders(trades: DataFrame, seconds: int, *, same: Column | None = None) -> DataFrame:
    """Per pair and bin of buys: at how many times (of same, the time itself by default) more than one trade stands."""
    keyed = buys(trades).groupBy("pair", bin_start(F.col("ts"), seconds).alias("bin"), (F.col("ts") if same is None else same).alias("same")).count()
    return keyed.groupBy("pair", "bin").agg(F.sum(F.when(F.col("count") > 1, 1.0).otherwise(0.0)).alias("rush_sum"))


def nonempty_bins(trades: DataFrame, seconds: int) -> DataFrame:
    """Per pair: the number of bins with a buy."""
    return buys(trades).groupBy("pair").agg(F.count_distinct(bin_start(F.col("ts"), seconds)).alias("chunks"))


def chunks(trades: DataFrame, seconds: int, *, same: Column | None = None) -> DataFrame:
    """bin_trades and rush_orders together; a bin without volume ends the job, since its parts cannot be aligned."""
    both = bin_trades(trades, seconds).join(rush_orders(trades, seconds, same=same), ["pair", "bin"])
    checked = F.assert_true(F.col("volume_sum") != 0, F.lit("a chunk has no volume"))
    return both.where(checked.isNull())


def complete_grid(bars: DataFrame, spine: DataFrame, *, day: Column) -> DataFrame:
    """Bars on every time of the spine (pair, open_time).

    The close of a missing bar is the last one of the same day, and open, high and low are that
    close; its volumes and trades are zero.  filled marks it.  Before the first bar of a day the close stays
    null.  A time that stands twice for a pair ends the job.
    """
    unique = bars.withColumn("_n", F.count("*").over(Window.partitionBy("pair", "open_time")))
    unique = unique.where(F.assert_true(F.col("_n") == 1, F.lit("a bar time stands twice")).isNull()).drop("_n")
    joined = spine.join(unique.withColumn("_here", F.lit(True)), ["pair", "open_time"], "left")
    order = Window.partitionBy("pair", day).orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)
    joined = joined.withColumn("filled", F.col("_here").isNull()).withColumn("close", F.last("close", ignorenulls=True).over(order))
    prices = {c: F.when(F.col("filled"), F.col("close")).otherwise(F.col(c)) for c in ("open", "high", "low")}
    amounts = {c: F.coalesce(c, F.lit(0.0)) for c in ("volume", "quote_volume", "trades") if c in bars.columns}
    return joined.withColumns(prices | amounts).drop("_here")


def day_spine(pairs: DataFrame, first: str, last: str) -> DataFrame:
    """pair, day for every pair and every day from first to last."""
    days = F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 day"))
    return pairs.select("pair", F.explode(days).alias("day"))


def minute_spine(pair_days: DataFrame, minutes: int = 1440) -> DataFrame:
    """pair, day, open_time for every minute of pair_days (pair, day)."""
    start = F.col("day").cast("timestamp_ntz")
    times = F.sequence(start, start + F.make_interval(mins=F.lit(minutes - 1)), F.expr("interval 1 minute"))
    return pair_days.select("pair", "day", F.explode(times).alias("open_time"))
