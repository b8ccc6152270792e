"""The driver's tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigil.operators.detectors import above, price_jump, volume_zscore
from vigil.operators.cooldown import apply_cooldown
from vigil.operators.timegrid import complete_grid, day_spine
from vigil.operators.universe import rank_table

DAY = 86_400
COOLDOWN_DAYS, Z_DAYS, Z_HIT, JUMP_HIT = 3, 7, 1.5, 0.5
STREAMS = {"volume_zscore": "volume_zscore", "price_jump": "price_jump"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades: a user is a pair, purchases and views are buys, and the value is price and volume."""
    side = F.when(F.col("event_type").isin("purchase", "view"), "buy").otherwise("sell")
    return table(spark, sf_dir, "events").where("value > 0").select(F.col("user_id").cast("string").alias("pair"), F.date_trunc("millisecond", "ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"), F.col("value").alias("quote_volume"), side.alias("side"), "event_id")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = trades(spark, sf_dir).groupBy("pair", F.to_date("ts").alias("open_time"))
    return own.agg(F.sum(F.col("price").cast("decimal(18,2)")).cast("double").alias("quote_volume"), F.max_by("price", F.struct("ts", "event_id")).alias("close"), F.max("price").alias("high"), F.min("price").alias("low"), F.min_by("price", F.struct("ts", "event_id")).alias("open"))


def daily_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars on every day of the table, for every pair."""
    bars = daily_bars(spark, sf_dir)
    first, last = bars.agg(F.min("open_time").cast("string"), F.max("open_time").cast("string")).first()
    spine = day_spine(bars.select("pair").distinct(), first or "2024-01-01", last or "2024-01-01").withColumnRenamed("day", "open_time")
    return complete_grid(bars, spine, day=F.lit(0))


def hits(spark: SparkSession, sf_dir: str, *, z: float = Z_HIT, jump: float = JUMP_HIT) -> DataFrame:
    """pair, detector, ts_utc, score of days above the thresholds."""
    grid = daily_grid(spark, sf_dir)
    found = [("volume_zscore", above(volume_zscore(grid, sum_rows=1, trail_rows=Z_DAYS), z)), ("price_jump", above(price_jump(grid, rows=1), jump))]
    parts = [df.select("pair", F.lit(name).alias("detector"), F.col("open_time").cast("timestamp_ntz").alias("ts_utc"), "score") for name, df in found]
    return parts[0].unionByName(parts[1])


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = apply_cooldown(hits(spark, sf_dir), ["pair", "detector"], seconds=COOLDOWN_DAYS * DAY)
    return kept.withColumns({"frequency": F.lit(""), "threshold_label": F.lit("fixed"), "day": F.date_format("ts_utc", "yyyy-MM-dd")})


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as symbols, ranked each quarter by their orders of the 90 days before."""
    span, day = _span(spark, sf_dir, "quarter"), F.to_date("o_orderdate")
    later = F.add_months(F.trunc(day, "quarter"), 3)  # a quarter has 90 days or more: an order counts for the next one's table alone
    dated = table(spark, sf_dir, "orders").withColumn("table_date", later).where(day >= F.date_sub("table_date", 90)).join(F.broadcast(span), later.between(F.col("first"), F.col("last")))  # one row
    volumes = dated.groupBy("table_date", F.concat(F.lit("C"), "o_custkey").alias("symbol")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("volume"))
    return rank_table(volumes)


def _span(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    """One row: the first and the last order's quarter or week."""
    at = lambda of: F.to_date(F.date_trunc(unit, of("o_orderdate")))
    return table(spark, sf_dir, "orders").agg(at(F.min).alias("first"), at(F.max).alias("last"))


def weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span(spark, sf_dir, "week").select(F.explode(F.sequence("first", "last", F.expr("interval 7 day"))).alias("day"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as fetched files, two an order, by the week of the order."""
    both = table(spark, sf_dir, "orders").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    date, symbol = F.to_date(F.date_trunc("week", "o_orderdate")), F.concat(F.lit("C"), "o_custkey")
    kind = F.when(F.col("k") == 0, "-aggTrades-").otherwise("-1m-")
    status = F.element_at(F.array(*map(F.lit, ("ok", "skipped", "404", "failed"))), ((F.col("o_orderkey") + F.col("k")) % 4 + 1).cast("int"))
    mod = (F.col("o_orderkey") * 7 + F.col("k") * 3) % 5
    return both.select(
        (F.col("o_orderkey") * 2 + F.col("k")).alias("seq"), date.alias("date"), symbol.alias("symbol"), F.concat(symbol, kind, date.cast("string"), F.lit(".zip")).alias("file"), F.col("o_orderkey").alias("bytes"), status.alias("status"),
        F.when((F.col("o_orderkey") + F.col("k")) % 3 == 0, "").otherwise(F.md5(F.col("o_orderkey").cast("string"))).alias("sha256"), F.when(mod == 0, "0").when(mod == 1, "").otherwise("1").alias("source_checksum_ok"),
    )


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as daily bars of their brand."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    price = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2).cast("decimal(18,2)")
    joined = lines.where("l_quantity > 0").join(parts, lines["l_partkey"] == parts["p_partkey"]).select("p_brand", F.to_date("l_shipdate").alias("day"), price.alias("price"), F.col("l_extendedprice").cast("decimal(18,2)").alias("paid"))
    return joined.groupBy(F.col("p_brand").alias("pair"), F.col("day").cast("timestamp_ntz").alias("open_time")).agg(F.max("price").cast("double").alias("high"), F.min("price").cast("double").alias("low"), F.round(F.sum("price").cast("double") / F.count("*"), 2).alias("close"), F.sum("paid").cast("double").alias("quote_volume"))
