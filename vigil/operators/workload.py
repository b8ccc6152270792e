"""Endpoints: what the alerts of each stream cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vigil import constants
from vigil.operators.cooldown import count_kept_at
from vigil.plans.guard import endpoint

STREAM = ["detector", "frequency", "threshold_label"]


def canonical(episodes: DataFrame) -> DataFrame:
    """An absent frequency is the empty text."""
    return episodes.withColumn("frequency", F.coalesce("frequency", F.lit("")))


def restrict_to_monitored(episodes: DataFrame, monitored: DataFrame) -> DataFrame:
    """Episodes of monitored (day, symbol)."""
    keys = monitored.select(F.col("day").cast("string").alias("day"), F.col("symbol").alias("pair"))
    return episodes.join(keys, ["day", "pair"], "left_semi").select(episodes.columns)


@endpoint
def alerts_per_day(episodes: DataFrame, days: DataFrame) -> DataFrame:
    """Alerts of each stream on each of the days, also where there are none.  A stream without any alert has no rows."""
    counted = episodes.groupBy(*STREAM, "day").agg(F.count("*").alias("alerts"))
    streams = episodes.select(*STREAM).distinct()
    spine = streams.crossJoin(F.broadcast(days.select(F.col("day").cast("string").alias("day"))))  # streams and days are few
    return spine.join(counted, [*STREAM, "day"], "left").select(*STREAM, "day", F.coalesce("alerts", F.lit(0)).alias("alerts"))


@endpoint
def distribution(per_day: DataFrame) -> DataFrame:
    """Of each stream's alerts a day: number, mean, deviation, quantiles and total."""
    q = lambda p: F.percentile("alerts", F.lit(p))
    return per_day.groupBy(*STREAM).agg(
        F.count("*").alias("n_days"), F.avg("alerts").alias("mean"), F.stddev_samp("alerts").alias("sd"), F.min("alerts").alias("min"), q(0.25).alias("p25"), q(0.5).alias("median"),
        q(0.75).alias("p75"), q(0.9).alias("p90"), F.max("alerts").alias("max"), F.sum("alerts").alias("total"),
    )


@endpoint
def rate_per_1000_hours(episodes: DataFrame, hours: float) -> DataFrame:
    if not hours > 0:
        raise ValueError("no pair-hours")
    return episodes.groupBy(*STREAM).agg(F.count("*").alias("alerts")).withColumn("pair_hours", F.lit(float(hours))).withColumn("rate", F.col("alerts") * constants.RATE_SCALE / F.lit(float(hours)))


@endpoint
def threshold_curve(candidates: DataFrame, thresholds: DataFrame, *, seconds: int = constants.COOLDOWN_SECONDS) -> DataFrame:
    """Alerts that a cooldown leaves at or above each threshold, per detector and frequency, also where none does.

    Thresholds that name detector and frequency hold for that stream, and give rows also where it has no candidate.
    """
    if {"detector", "frequency"} <= set(thresholds.columns):
        every = thresholds.select("detector", "frequency", F.col("threshold").cast("double").alias("threshold")).distinct()
        own: dict[tuple, list[float]] = {}
        for r in every.collect():  # a few hundred
            own.setdefault((r["detector"], r["frequency"]), []).append(r["threshold"])
        levels = lambda key: own.get(key[:2], [])
    else:
        grid = thresholds.select(F.col("threshold").cast("double").alias("threshold")).distinct()
        every = candidates.select("detector", "frequency").distinct().crossJoin(F.broadcast(grid))  # a few dozen
        same = [r[0] for r in grid.collect()]
        levels = lambda key: same
    kept = count_kept_at(candidates, ["detector", "frequency", "pair"], levels, seconds=seconds).groupBy("detector", "frequency", "threshold").agg(F.sum("kept").alias("alerts"))
    return every.join(kept, ["detector", "frequency", "threshold"], "left").withColumn("alerts", F.coalesce("alerts", F.lit(0)))


@endpoint
def stratified(episodes: DataFrame, strata: DataFrame, monitored: DataFrame, *, parts: int = constants.STRATA) -> DataFrame:
    """Per stream and stratum (and unassigned): alerts, pair-hours and rate; the rate is null without hours."""
    lookup = strata.select(F.col("day").cast("string").alias("day"), F.col("symbol").alias("pair"), F.col("stratum").cast("string").alias("stratum"))
    name = F.coalesce("stratum", F.lit("unassigned"))
    alerts = episodes.join(lookup, ["day", "pair"], "left").groupBy(*STREAM, name.alias("stratum")).agg(F.count("*").alias("alerts"))
    hours = monitored.select(F.col("day").cast("string").alias("day"), F.col("symbol").alias("pair")).join(lookup, ["day", "pair"], "left").groupBy(name.alias("stratum")).agg((F.count("*") * constants.HOURS_A_PAIR_DAY).alias("pair_hours"))
    names = F.explode(F.array(*(F.lit(str(k)) for k in range(1, parts + 1)), F.lit("unassigned")))
    every = episodes.select(*STREAM).distinct().select(*STREAM, names.alias("stratum"))
    out = every.join(alerts, [*STREAM, "stratum"], "left").join(hours, "stratum", "left")
    out = out.withColumns({"alerts": F.coalesce("alerts", F.lit(0)), "pair_hours": F.coalesce("pair_hours", F.lit(0.0))})
    return out.withColumn("rate", F.when(F.col("pair_hours") > 0, F.col("alerts") * constants.RATE_SCALE / F.col("pair_hours")))


@endpoint
def agreement(episodes: DataFrame, *, seconds: int = constants.COOLDOWN_SECONDS) -> DataFrame:
    """For each ordered pair of streams: alerts of the first, and those with one of the second on the same pair within seconds.

    The alerts of a pair are sorted by time once forwards and once backwards, and running extremes tell each of them
    the last and the next alert of every stream: no alert is copied or compared with more than these.
    """
    at, width = F.unix_micros(F.col("ts_utc").cast("timestamp")), seconds * 1_000_000
    streams = sorted((tuple(r) for r in episodes.select(*STREAM).distinct().collect()), key=str)  # one row a stream: nine at most
    rows = episodes.select("pair", *STREAM, at.alias("t")).distinct()
    of = lambda s: F.col("detector").eqNullSafe(s[0]) & F.col("frequency").eqNullSafe(s[1]) & F.col("threshold_label").eqNullSafe(s[2])
    upto = lambda w: w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    forwards, backwards = upto(Window.partitionBy("pair").orderBy("t")), upto(Window.partitionBy("pair").orderBy(F.desc("t")))
    last = {f"_last{i}": F.max(F.when(of(s), F.col("t"))).over(forwards) for i, s in enumerate(streams)}
    later = {f"_next{i}": F.min(F.when(of(s), F.col("t"))).over(backwards) for i, s in enumerate(streams)}
    near = lambda i: (F.col("t") - F.col(f"_last{i}") <= width) | (F.col(f"_next{i}") - F.col("t") <= width)
    counts = rows.withColumns(last).withColumns(later).groupBy(*STREAM).agg(F.count("*").alias("alerts"), F.array(*(F.count_if(near(i)) for i in range(len(streams)))).alias("_matched"))
    names = [F.struct(*(F.lit(v).cast("string").alias(f"{c}_b") for c, v in zip(STREAM, s, strict=True)), F.get("_matched", F.lit(i)).alias("matched")) for i, s in enumerate(streams)]
    empty = "array<struct<detector_b: string, frequency_b: string, threshold_label_b: string, matched: long>>"
    pairs = counts.select(*(F.col(c).alias(f"{c}_a") for c in STREAM), "alerts", F.inline(F.array(*names) if names else F.array().cast(empty)))
    other = ~F.struct(*(f"{c}_a" for c in STREAM)).eqNullSafe(F.struct(*(F.col(f"{c}_b").alias(f"{c}_a") for c in STREAM)))
    return pairs.where(other).withColumn("share", F.col("matched") / F.col("alerts"))


def threshold_grid(spark, *, step: float = 0.05, extra: tuple[float, ...] = (constants.ANCHOR, *constants.STAR.values())) -> DataFrame:
    """Multiples of step below one, and the extra thresholds."""
    n = round(1 / step)
    regular = spark.range(1, n).select(F.round(F.col("id") * step, 10).alias("threshold"))
    return regular.unionByName(spark.createDataFrame([(float(x),) for x in extra], "threshold double")).distinct()


def score_grid(candidates: DataFrame, *, step: float = 0.05, extra: tuple[float, ...] = (constants.ANCHOR, *constants.STAR.values())) -> DataFrame:
    """detector, frequency, threshold: the multiples of step between the lowest and the highest score of each stream's candidates, and the extra thresholds."""
    ends = candidates.groupBy("detector", "frequency").agg(F.ceil(F.min("score") / step).alias("first"), F.floor(F.max("score") / step).alias("last"))
    regular = F.when(F.col("first") <= F.col("last"), F.transform(F.sequence("first", "last"), lambda k: F.round(k * step, 10))).otherwise(F.array().cast("array<double>"))
    levels = F.array_distinct(F.concat(regular, F.array(*(F.lit(float(x)) for x in extra)).cast("array<double>")))
    return ends.select("detector", "frequency", F.explode(levels).alias("threshold"))


def stream_thresholds(spark, frequencies: list[str]) -> DataFrame:
    """The thresholds of the burden curves: detector, frequency and threshold, for the forest at each frequency and the two baselines."""
    forest = sorted({*(round(k * 0.05, 4) for k in range(1, 20)), constants.ANCHOR, *constants.STAR.values()})
    grids = [("upstream_rf", f, forest) for f in frequencies]
    grids += [("volume_zscore", "", [k * 0.5 for k in range(4, 21)]), ("price_jump", "", [round(k * 0.005, 4) for k in range(2, 31)])]
    return spark.createDataFrame([(d, f, t) for d, f, grid in grids for t in grid], "detector string, frequency string, threshold double")
