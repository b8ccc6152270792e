"""Builds of feature rows day by day: their log and its roll-up, samples of pair-days and events, and checks that keep no rows."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from vigil import constants
from vigil.functions.positions import with_position
from vigil.operators.timegrid import bin_start, buys


def build_log(trades: DataFrame, seconds: int, size: int, *, warmup_days: int = constants.WARMUP_DAYS) -> DataFrame:
    """Per pair and day with a buy: its rows, those that have size earlier rows within warmup_days, and trades and buys of the day."""
    bought = buys(trades).select("pair", bin_start(F.col("ts"), seconds).alias("bin")).distinct().withColumn("day", F.to_date("bin"))
    first = F.lag("day", size).over(Window.partitionBy("pair").orderBy("bin"))
    rows = bought.withColumn("_first", first).groupBy("pair", "day").agg(F.count("*").alias("n_rows_target_day"), F.count_if(F.datediff("day", "_first") <= warmup_days).alias("n_rows_scored"))
    counts = trades.groupBy("pair", F.to_date("ts").alias("day")).agg(F.count("*").alias("n_trades_target_day"), F.count_if(F.col("side") == "buy").alias("n_buy_trades_target_day"))
    out = rows.join(counts, ["pair", "day"]).withColumn("warmup_sufficient", F.col("n_rows_scored") > 0)
    return out.withColumn("warmup_days_requested", F.lit(warmup_days)).withColumnRenamed("pair", "symbol")


def with_units(log: DataFrame, units: DataFrame) -> DataFrame:
    """Adds unit, that of the first record of the day's archive (symbol, day, unit), or the empty text."""
    return log.join(units, ["symbol", "day"], "left").withColumn("unit", F.coalesce("unit", F.lit("")))


def rollup(log: DataFrame) -> DataFrame:
    """Per frequency of a build log with units: builds, sums of rows, the most of one build, whether all had warm-up, builds without rows, and the distinct units."""
    return log.groupBy("frequency").agg(
        F.count("*").alias("builds"), F.sum("n_rows_target_day").alias("n_rows_target_day"), F.sum("n_rows_scored").alias("n_rows_scored"), F.max("n_rows_target_day").alias("most_rows"),
        F.bool_and("warmup_sufficient").alias("all_sufficient"), F.count_if(F.col("n_rows_scored") == 0).alias("builds_without_rows"), F.sum("n_trades_target_day").alias("n_trades"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("unit") != "", F.col("unit")))), ",").alias("units"),  # four at most
    )


def drawn_places(total: int, n: int, seed: int, generator: str) -> list[int]:
    """n of total places (from 0) without replacement: by numpy's choice in ascending order, or by Python's random.sample in the order of the draw."""
    size = min(n, total)
    if generator == "python":
        return random.Random(seed).sample(range(total), size)
    if generator == "numpy":
        return np.sort(np.random.default_rng(seed).choice(total, size=size, replace=False)).tolist() if total else []
    raise ValueError(f"unknown generator {generator}")


def sample_rows(rows: DataFrame, order: list[str], *, n: int, seed: int, generator: str = "md5") -> DataFrame:
    """n rows of the sorted table with sample_id from 1.

    The generators "numpy" and "python" give places, of which the driver holds n, in the order of drawn_places(); "md5", which SQL can repeat, takes
    the places with the lowest md5 of seed and place, in the table's order.
    """
    placed = with_position(rows, *order, name="place")
    if generator == "md5":
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("place").cast("string")))
        picked = placed.orderBy(digest, "place").limit(n)
        return picked.withColumn("sample_id", F.row_number().over(Window.orderBy("place"))).drop("place")
    places = drawn_places(placed.count(), n, seed, generator)
    picks = rows.sparkSession.createDataFrame([(i + 1, p) for i, p in enumerate(places)], "sample_id int, place long")
    return placed.join(F.broadcast(picks), "place").drop("place")  # n rows


def sample_pair_days(monitored: DataFrame, *, n: int = constants.STRUCTURAL_SAMPLE, seed: int = constants.SAMPLE_SEED, generator: str = "md5") -> DataFrame:
    """A seeded sample of the sorted pair-days."""
    return sample_rows(monitored.select("day", "pair").distinct(), ["day", "pair"], n=n, seed=seed, generator=generator)


def episode_checks() -> dict[str, Column]:
    """What every row of an episode table must pass."""
    known = F.col("detector").isin(*constants.FLOORS)
    return {"timed": F.col("ts_utc").isNotNull(), "known_detector": known, "above_threshold": F.col("score") >= F.col("threshold"), "available_later": F.col("ts_available_utc") >= F.col("ts_utc")}


def validate(rows: DataFrame, checks: dict[str, Column] | None = None) -> DataFrame:
    """One row of booleans: whether every row passes each check.  Nothing else of the rows is kept."""
    return rows.agg(F.count("*").alias("rows"), *(F.coalesce(F.bool_and(F.coalesce(test, F.lit(False))), F.lit(True)).alias(name) for name, test in (checks or episode_checks()).items()))


def validate_once(rows: DataFrame, keys: list[str], *, seconds: int = constants.COOLDOWN_SECONDS, path: str | None = None) -> DataFrame:
    """One row of booleans, as validate() and whether each key's gaps reach the cooldown, observed while the rows are computed once.

    With path the same pass writes the rows there as Parquet; without, nothing of them is kept.
    """
    seen, checks = Observation(), episode_checks()
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = micros(F.col("ts_utc")) - micros(F.lag("ts_utc").over(Window.partitionBy(*keys).orderBy("ts_utc")))
    marked = rows.withColumn("_gap", gap)
    every = {name: F.coalesce(test, F.lit(False)) for name, test in checks.items()} | {"respected": F.coalesce(F.col("_gap") >= seconds * 1_000_000, F.lit(True))}
    watched = marked.observe(seen, F.count("*").alias("rows"), *(F.bool_and(test).alias(name) for name, test in every.items())).drop("_gap")
    watched.write.format("noop").mode("overwrite").save() if path is None else watched.write.parquet(path)
    facts = seen.get
    names = ["rows", *every]
    row = tuple(facts.get(n) if facts.get(n) is not None else (0 if n == "rows" else True) for n in names)
    return rows.sparkSession.createDataFrame([row], ", ".join(f"{n} {'long' if n == 'rows' else 'boolean'}" for n in names))
