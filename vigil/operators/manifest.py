"""Pull manifests and coverage logs: what was fetched, and which pair-days it verifies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigil import constants
from vigil.operators import universe

RULES = ("verified-archive", "universe-membership")


def keep_last(log: DataFrame, keys: list[str], *, seq: str = "seq") -> DataFrame:
    """The last row of each key, in the order of seq."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("x")).select(*keys, "x.*")


def without_dates(log: DataFrame, dates: tuple[str, ...] = constants.EXCLUDED_DATES) -> DataFrame:
    return log.where(~F.col("date").cast("string").isin(*dates))


def trades_file(symbol: Column, day: Column) -> Column:
    return F.concat(symbol, F.lit("-aggTrades-"), day.cast("string"), F.lit(".zip"))


def bars_file(symbol: Column, day: Column) -> Column:
    return F.concat(symbol, F.lit("-1m-"), day.cast("string"), F.lit(".zip"))


def archive_targets(pair_days: DataFrame, *, url: str, root: str = "raw") -> DataFrame:
    """url and path of the two archives of each pair-day (symbol, day)."""
    s, d = F.col("symbol"), F.col("day").cast("string")
    of = lambda kind, file: F.struct(F.concat_ws("/", F.lit(url), F.lit(kind), s, file).alias("url"), F.concat_ws("/", F.lit(root), F.lit(kind), d, file).alias("path"))
    both = F.array(of("aggTrades", trades_file(s, d)), of("klines", bars_file(s, d)))
    return pair_days.select("symbol", "day", F.inline(both))


def verified_pair_days(manifest: DataFrame) -> DataFrame:
    """date, symbol whose two files both last came with a checksum that was right."""
    last = keep_last(manifest.select("date", "file", "symbol", "source_checksum_ok", "seq"), ["date", "file"]).where(F.col("source_checksum_ok") == "1")
    has = lambda file: F.bool_or(F.col("file") == file(F.col("symbol"), F.col("date")))
    return last.groupBy("date", "symbol").agg(has(trades_file).alias("a"), has(bars_file).alias("b")).where("a and b").select("date", "symbol")


def monitored_pair_days(governed: DataFrame, verified: DataFrame, rule: str = RULES[0]) -> DataFrame:
    """The governed (day, symbol), and under the first rule only those that are verified."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    return governed if rule == RULES[1] else governed.join(verified.withColumnRenamed("date", "day"), ["day", "symbol"], "left_semi")


def monitored_of_days(days: DataFrame, tables: DataFrame, verified: DataFrame, rule: str = RULES[0], **reinstating) -> DataFrame:
    """monitored_pair_days of governed(days, tables), where what is verified meets the tables before they are repeated for each of their days."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    return universe.governed(days, tables, **reinstating, only=None if rule == RULES[1] else verified.withColumnRenamed("date", "day"))


def pair_hours_by_day(monitored: DataFrame, days: DataFrame) -> DataFrame:
    """Hours of each day; days without any pair have none."""
    counted = monitored.groupBy("day").agg(F.count("*").alias("pairs"))
    return days.join(counted, "day", "left").select("day", F.coalesce("pairs", F.lit(0)).alias("pairs"), (F.coalesce("pairs", F.lit(0)) * constants.HOURS_A_PAIR_DAY).alias("hours"))


def pair_hours_by_pair(monitored: DataFrame) -> DataFrame:
    return monitored.groupBy("symbol").agg((F.count("*") * constants.HOURS_A_PAIR_DAY).alias("hours"))


def manifest_rows_wanted(rows: DataFrame, present: DataFrame) -> DataFrame:
    """Rows to append: what is ok, and what was skipped but has a digest and no entry (date, file) yet."""
    skipped = rows.where((F.col("status") == "skipped") & (F.col("sha256") != "")).join(present, ["date", "file"], "left_anti")
    return rows.where("status = 'ok'").unionByName(skipped.select(rows.columns))


def pull_statistics(log: DataFrame) -> DataFrame:
    """Per date: files of each status and bytes."""
    of = lambda s, name: F.count_if(F.col("status") == s).alias(name)
    return log.groupBy("date").agg(of("ok", "ok"), of("skipped", "skipped"), of("404", "missing"), of("failed", "failed"), F.sum("bytes").alias("bytes"))


def completion(statistics: DataFrame, today: str, *, deadline: int = constants.LISTING_GAP_DAYS) -> DataFrame:
    """Adds state: retry if nothing is there, or something is missing before the deadline, or a file failed; else complete."""
    age = F.datediff(F.to_date(F.lit(today)), F.col("date"))
    nothing = (F.col("missing") > 0) & (F.col("ok") + F.col("skipped") + F.col("failed") == 0)
    state = F.when(nothing, "retry").when((F.col("failed") == 0) & (F.col("missing") > 0) & (age < deadline), "retry").when(F.col("failed") == 0, "complete").otherwise("retry")
    return statistics.withColumn("state", state)


def taxonomy(status: Column, date: Column, today: str, *, deadline: int = constants.LISTING_GAP_DAYS) -> Column:
    """A missing file is pending before the deadline and a listing gap from then on."""
    pending = F.datediff(F.to_date(F.lit(today)), date) < deadline
    return F.when(status != "404", status).when(pending, "pending").otherwise("listing gap")


def checksum_states(files: DataFrame, published: DataFrame, *, key: str = "file") -> DataFrame:
    """Adds source_checksum_ok to files (key, sha256): 1 if published (key, published) has the same digest, 0 if another, empty if none."""
    state = F.when(F.coalesce("published", F.lit("")) == "", "").when(F.lower("published") == F.lower("sha256"), "1").otherwise("0")
    return files.join(published, key, "left").withColumn("source_checksum_ok", state).drop("published")


def fetch_status(expected: DataFrame, found: DataFrame, published: DataFrame, before: DataFrame) -> DataFrame:
    """Status of each expected file: skipped if it was there before, ok if found with the digest published or none, else failed or 404.

    found has file and sha256, published file and published, before file.
    """
    states = checksum_states(found.select("file", "sha256"), published)
    joined = expected.select("file").join(states, "file", "left").join(before.select("file", F.lit(True).alias("there")), "file", "left")
    status = F.when(F.col("there"), "skipped").when(F.col("sha256").isNull(), "404").when(F.col("source_checksum_ok") == "0", "failed").otherwise("ok")
    return joined.select("file", status.alias("status"), F.coalesce("sha256", F.lit("")).alias("sha256"), F.coalesce("source_checksum_ok", F.lit("")).alias("source_checksum_ok"))


def missing_files(expected: DataFrame, present: DataFrame, *, examples: int = 10) -> DataFrame:
    """The first of the expected files that are not there."""
    return expected.join(present, "file", "left_anti").select("file").orderBy("file").limit(examples)


def outstanding_days(first: str, last: str, done: DataFrame) -> DataFrame:
    """Days from first to last that are not done."""
    spark = done.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    return days.join(done.select("day"), "day", "left_anti")


def _by_rule(governed: DataFrame, verified: DataFrame, monitored: DataFrame | None) -> dict[str, DataFrame]:
    return {rule: monitored if monitored is not None and rule == RULES[0] else monitored_pair_days(governed, verified, rule) for rule in RULES}


def denominator_report(governed: DataFrame, verified: DataFrame, days: DataFrame, *, monitored: DataFrame | None = None) -> DataFrame:
    """Per rule: pair-days, hours and distinct pairs over the days.  monitored: those of the first rule, if they are known."""
    out = None
    for rule, own in _by_rule(governed, verified, monitored).items():
        own = own.join(F.broadcast(days), "day", "left_semi")  # one row a day
        row = own.agg(F.lit(rule).alias("rule"), F.count("*").alias("pair_days"), (F.count("*") * constants.HOURS_A_PAIR_DAY).alias("pair_hours"), F.count_distinct("symbol").alias("pairs"))
        out = row if out is None else out.unionByName(row)
    return out


def denominators_by_day(governed: DataFrame, verified: DataFrame, days: DataFrame, *, monitored: DataFrame | None = None) -> DataFrame:
    """Per rule and day: pairs and hours, also where there are none.  monitored: the pair-days of the first rule, if they are known."""
    parts = [pair_hours_by_day(own, days).withColumn("rule", F.lit(rule)) for rule, own in _by_rule(governed, verified, monitored).items()]
    return parts[0].unionByName(parts[1]).select("rule", "day", "pairs", "hours")


def excluded_rows(log: DataFrame, dates: tuple[str, ...] = constants.EXCLUDED_DATES) -> DataFrame:
    """How many rows of the log each excluded date has."""
    return log.where(F.col("date").cast("string").isin(*dates)).groupBy("date").agg(F.count("*").alias("rows"))


def in_order(bars: DataFrame, *, seq: str = "seq") -> DataFrame:
    """Per pair: whether times never fall in the order of the archive."""
    before = F.lag("open_time").over(Window.partitionBy("pair").orderBy(seq))
    return bars.select("pair", (F.col("open_time") >= before).alias("up")).groupBy("pair").agg(F.coalesce(F.bool_and("up"), F.lit(True)).alias("monotonic"))


def bar_coverage(grid: DataFrame, bars: DataFrame) -> DataFrame:
    """Per pair: minutes, filled minutes, first and last time, and bars that repeat a time."""
    twice = bars.groupBy("pair", "open_time").count().groupBy("pair").agg(F.sum(F.col("count") - 1).alias("repeated"))
    facts = grid.groupBy("pair").agg(F.count("*").alias("minutes"), F.count_if("filled").alias("filled_minutes"), F.min("open_time").alias("first_time"), F.max("open_time").alias("last_time"))
    return facts.join(twice, "pair", "left").withColumn("repeated", F.coalesce("repeated", F.lit(0)))
