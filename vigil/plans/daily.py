"""What a day of ingestion has to do, without the network: days to pull, files to fetch, membership tables to write, days to pull again.

python -m vigil.plans.daily --data DIR --out DIR --today YYYY-MM-DD [--url URL] [--symbols A,B] [--limit N]
python -m vigil.plans.daily --data DIR --today YYYY-MM-DD --update-universe   # from DIR/exchange/symbols and DIR/exchange/daily
python -m vigil.plans.daily --data DIR --requeue-day YYYY-MM-DD
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigil import constants
from vigil.functions.numeric import flag
from vigil.operators import manifest as logs, universe as members
from vigil.sources import archives, sinks


def plan(spark: SparkSession, data: str, today: str, *, url: str, symbols: list[str] | None = None, limit: int | None = None, first: str = constants.STREAM_START) -> dict[str, DataFrame]:
    """Outstanding days up to the publication lag, and the two files of each governed symbol that the manifest does not have."""
    last = (dt.date.fromisoformat(today) - dt.timedelta(days=constants.PUBLICATION_LAG_DAYS)).isoformat()
    done = archives.read_days(spark, f"{data}/manifests/days_completed.txt")
    days = logs.outstanding_days(first, max(first, last), done).where(F.col("day") <= last).orderBy("day")
    days = days.limit(limit) if limit else days
    governed = members.governed(days, archives.read_universe(spark, f"{data}/universe"))
    if symbols:
        governed = governed.where(F.col("symbol").isin(symbols))
    targets = logs.archive_targets(governed.select("symbol", "day"), url=url).withColumn("file", F.element_at(F.split("path", "/"), -1))
    present = archives.read_manifest(spark, f"{data}/manifests/pull_manifest.csv").select(F.col("date").alias("day"), "file").distinct()
    return {"days": days, "targets": targets.join(present, ["day", "file"], "left_anti").select("day", "symbol", "url", "path")}


def update_universe(spark: SparkSession, data: str, today: str) -> int:
    """Ranks the eligible symbols by their trailing volume and writes the table of today; 1 if there is one already, which stays.

    data/exchange/symbols has symbol, status, quote_asset, base_asset and spot_allowed, data/exchange/daily symbol, day and volume.
    Symbols without a candle have no volume and come last.
    """
    path = f"{data}/universe/universe_{today}.csv"
    if sinks.exists(spark, path):
        print(f"{path} is there already", file=sys.stderr)
        return 1
    symbols = spark.read.csv(f"{data}/exchange/symbols", header=True).withColumn("spot_allowed", flag(F.col("spot_allowed")))
    candles = spark.read.csv(f"{data}/exchange/daily", header=True).select("symbol", F.to_date("day").alias("day"), F.col("volume").cast("decimal(28,8)").alias("volume"))
    volumes = members.eligible(symbols).join(members.trailing_volume(candles), "symbol", "left").select("symbol", F.coalesce("volume", F.lit(0)).cast("decimal(28,8)").alias("volume"))
    ranked = members.rank_table(volumes.withColumn("table_date", F.to_date(F.lit(today))))
    sinks.write_universe(ranked.select("symbol", F.col("volume").alias("vol30d"), "rank", F.col("included").cast("int").alias("included")), path)
    return 0


def requeue_day(spark: SparkSession, data: str, day: str) -> int:
    """Takes a day off the completed ones, so that the next plan has it again; a day that is not among them changes nothing."""
    dt.date.fromisoformat(day)
    path = f"{data}/manifests/days_completed.txt"
    done = archives.read_days(spark, path)
    left = sorted(str(r["day"]) for r in sinks.requeue(done, day).collect())  # one row a day
    if len(left) < done.count():
        sinks.replace_text(spark, left, path)
    else:
        print(f"{day} is not among the completed days")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--data", required=True)
    parser.add_argument("--out", default="")
    parser.add_argument("--today", default=dt.datetime.now(dt.UTC).date().isoformat())
    parser.add_argument("--url", default="https://archive.invalid")
    parser.add_argument("--symbols", default="")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--update-universe", action="store_true")
    parser.add_argument("--requeue-day", default="")
    args = parser.parse_args(argv)
    if not (args.out or args.update_universe or args.requeue_day):
        parser.error("a plan needs --out")
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.requeue_day:
        return requeue_day(spark, args.data, args.requeue_day)
    if args.update_universe:
        return update_universe(spark, args.data, args.today)
    found = plan(spark, args.data, args.today, url=args.url, symbols=[s for s in args.symbols.upper().split(",") if s], limit=args.limit)
    for name, df in found.items():
        sinks.write_table(df, f"{args.out}/{name}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
