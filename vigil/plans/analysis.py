"""The two runs: a structural check that tells no result, and the full analysis.

python -m vigil.plans.analysis --data DIR --out DIR [--partial-structural-check] [...]
"""

from __future__ import annotations

import argparse
import functools
import json
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from vigil import constants
from vigil.operators import bootstrap, builds, detectors, features, manifest as logs, model, signatures, timegrid, universe as members, workload
from vigil.plans.provenance import provenance
from vigil.sources import archives, sinks


def window_days(spark: SparkSession, first: str = constants.STREAM_START, n: int = constants.STREAM_DAYS) -> DataFrame:
    return spark.range(n).select(F.date_add(F.to_date(F.lit(first)), F.col("id").cast("int")).alias("day"))


def missing_days(spark: SparkSession, done: DataFrame, days: DataFrame) -> int:
    return days.join(done, "day", "left_anti").count()


def inputs(spark: SparkSession, data: str, *, rule: str, reinstate: bool) -> dict[str, DataFrame]:
    raw = archives.read_manifest(spark, f"{data}/manifests/pull_manifest.csv")
    tables, days = archives.read_universe(spark, f"{data}/universe"), window_days(spark)
    governed = members.governed(days, tables, reinstated=constants.REINSTATED if reinstate else ())
    monitored = logs.monitored_pair_days(governed, logs.verified_pair_days(logs.without_dates(raw)), rule)
    return {"tables": tables, "days": days, "governed": governed, "monitored": monitored.withColumnRenamed("symbol", "pair"), "manifest": raw}


def grids(spark: SparkSession, data: str, monitored: DataFrame) -> DataFrame:
    """Minute bars of the monitored pair-days without gaps; days without an archive have none."""
    bars = archives.read_bars(spark, f"{data}/raw/klines", keep=archives.ranges_of(monitored)).drop("day")
    present = bars.select("pair", F.to_date("open_time").alias("day")).distinct()
    spine = timegrid.minute_spine(monitored.select("pair", "day").join(present, ["pair", "day"], "left_semi"))
    return timegrid.complete_grid(bars, spine, day=F.col("day"))


def baseline_candidates(grid: DataFrame, *, scope: str) -> DataFrame:
    scored = {"volume_zscore": detectors.volume_zscore(grid, scope=scope), "price_jump": detectors.price_jump(grid)}
    return functools.reduce(DataFrame.unionByName, (detectors.candidates(s, name, ts="open_time") for name, s in scored.items()))


def baseline_episodes(found: DataFrame) -> DataFrame:
    """Episodes of the two baselines from their candidates."""
    thresholds = {"volume_zscore": constants.Z_THRESHOLD, "price_jump": constants.JUMP_THRESHOLD}
    made = (detectors.episodes(found.where(F.col("detector") == name), {"fixed": t}, inclusive=False, seconds_available=60) for name, t in thresholds.items())
    return functools.reduce(DataFrame.unionByName, made)


def forest_candidates(spark: SparkSession, data: str, matrix_root: str, frequency: str, monitored: DataFrame, *, warmup_days: int = constants.WARMUP_DAYS) -> tuple[DataFrame, Observation]:
    """Candidates of the forest, and the rows that were dropped and kept as non-finite or not, which are known once the candidates are written."""
    path, keep = f"{data}/raw/aggTrades", archives.ranges_of(monitored, before=warmup_days)
    trades = archives.read_trades(spark, path, columns=("ts", "price", "quote_volume", "side"), keep=keep).drop("day")
    seconds, size = constants.BIN_SECONDS[frequency], constants.ROLLING_CHUNKS[frequency]
    days = archives.read_heads(spark, path, keep=keep).select("pair", "day").distinct()  # also those of archives without a buy
    matrix = features.feature_matrix(trades, seconds, size).withColumn("day", F.to_date("date")).join(monitored, ["pair", "day"], "left_semi").drop("day")
    scorable = features.scorable(trades, days, seconds, size, warmup_days=warmup_days).withColumnRenamed("bin", "date")
    finite, dropped = features.drop_nonfinite_counted(matrix.join(scorable, ["pair", "date"], "left_semi"))
    fitted = model.fit(archives.read_matrix(spark, f"{matrix_root}/features_{frequency}.csv.gz", constants.FEATURES))
    return detectors.candidates(model.score(fitted, finite), "upstream_rf", ts="date", frequency=frequency), dropped


def forest_episodes(found: DataFrame, frequency: str) -> DataFrame:
    own = found.where((F.col("detector") == "upstream_rf") & (F.col("frequency") == frequency))
    return detectors.episodes(own, detectors.forest_thresholds(frequency), inclusive=True, seconds_available=constants.BIN_SECONDS[frequency])


def sensitivity_rates(made: DataFrame, monitored: DataFrame, rule: str) -> DataFrame:
    """The rates of all episodes under another rule of pair-hours, whose pair-days are monitored."""
    own = workload.restrict_to_monitored(made, monitored)
    return workload.rate_per_1000_hours(own, monitored.count() * constants.HOURS_A_PAIR_DAY).withColumn("pair_hours_rule", F.lit(rule))


def unverified(spark: SparkSession, path: str, frequencies: list[str]) -> list[str]:
    """The frequencies for which a published table (frequency, fraction, tau_star) does not have the frozen threshold exactly once."""
    published = spark.read.csv(path, header=True).select("frequency", F.col("fraction").cast("double").alias("fraction"), F.col("tau_star").cast("double").alias("threshold"))
    verified = {r["frequency"] for r in model.verify_thresholds(published).where("verified").collect()}  # one row a frequency
    return [f for f in frequencies if f not in verified]


def full_analysis(spark: SparkSession, args: argparse.Namespace) -> int:
    done = archives.read_days(spark, f"{args.data}/manifests/days_completed.txt")
    tables = inputs(spark, args.data, rule=args.pair_hours_rule, reinstate=not args.exclude_amendment2_pairs)
    if missing := missing_days(spark, done, tables["days"]):
        print(f"{missing} days of the window are not complete", file=sys.stderr)
        return 2
    if args.published_thresholds and (wrong := unverified(spark, args.published_thresholds, args.frequencies)):
        print(f"the published thresholds of {', '.join(wrong)} are not the frozen ones", file=sys.stderr)
        return 3
    stamp = provenance("full")
    monitored = tables["monitored"].select("pair", "day").persist()
    grid = grids(spark, args.data, monitored)
    found, dropped, out = baseline_candidates(grid, scope=args.grid_scope), {}, args.out
    for frequency in args.frequencies:
        more, dropped[frequency] = forest_candidates(spark, args.data, args.matrix, frequency, monitored, warmup_days=args.warmup_days)
        found = found.unionByName(more)
    sinks.write_candidates(found, f"{out}/candidates", format="parquet", provenance=None)
    found = spark.read.parquet(f"{out}/candidates")  # features and scores are computed once, for the candidates
    made = functools.reduce(DataFrame.unionByName, (forest_episodes(found, f) for f in args.frequencies), baseline_episodes(found))
    sinks.write_episodes(made, f"{out}/episodes", format="parquet", provenance=None)
    made = spark.read.parquet(f"{out}/episodes")
    own = workload.restrict_to_monitored(made, monitored.withColumnRenamed("pair", "symbol"))
    hours = monitored.groupBy("pair").agg((F.count("*") * constants.HOURS_A_PAIR_DAY).alias("hours"))
    per_day = workload.alerts_per_day(own, tables["days"])
    streams = F.concat_ws("|", *workload.STREAM)
    names = [r[0] for r in own.select(streams).distinct().collect()]  # one name a stream: nine at most
    by_pair = hours.join(own.withColumn("s", streams).groupBy("pair").pivot("s", names or ["none"]).count(), "pair", "left").na.fill(0)
    strata = members.strata(tables["governed"])
    total = hours.agg(F.sum("hours")).first()[0] or 0
    curves = workload.threshold_curve(found, workload.stream_thresholds(spark, args.frequencies))
    other = next(r for r in logs.RULES if r != args.pair_hours_rule)
    monitored_otherwise = inputs(spark, args.data, rule=other, reinstate=not args.exclude_amendment2_pairs)["monitored"].select("day", F.col("pair").alias("symbol"))
    evaluated = signatures.evaluate(own, grid, signatures.rules_table(spark))
    results = {
        "alerts_per_day": per_day, "distribution": workload.distribution(per_day), "rates": workload.rate_per_1000_hours(own, total),
        "stratified": workload.stratified(own, strata, monitored.withColumnRenamed("pair", "symbol")), "agreement": workload.agreement(own),
        "curves": curves.withColumn("pair_hours", F.lit(float(total))).withColumn("rate", F.col("alerts") * constants.RATE_SCALE / F.lit(float(total))),
        "rates_sensitivity_rule": sensitivity_rates(made, monitored_otherwise, other),
        "signatures": evaluated, "precision": signatures.summarise(evaluated), "sample": bootstrap.draw_sample(own, n=args.manual_sample),
    }
    if dropped:
        results["nonfinite"] = spark.createDataFrame([(f, o.get["dropped"], o.get["kept"]) for f, o in dropped.items()], "frequency string, dropped long, kept long")
    if names:
        results["intervals"] = bootstrap.bootstrap_ratio(by_pair, "pair", names, "hours", generator="numpy" if by_pair.count() <= bootstrap.MOST_SHARED else "tree")
    if os.path.isdir(f"{args.data}/raw/aggTrades") or "://" in args.data:
        results["feature_build_log"] = build_logs(spark, args, monitored)
    for name, df in results.items():
        sinks.write_table(df, f"{out}/{name}", stamp)
    monitored.unpersist()
    return 0


def build_logs(spark: SparkSession, args: argparse.Namespace, monitored: DataFrame) -> DataFrame:
    """The build log of the monitored pair-days at all frequencies, with the unit of time of each day's archive."""
    path, keep = f"{args.data}/raw/aggTrades", archives.ranges_of(monitored, before=args.warmup_days)
    trades = archives.read_trades(spark, path, columns=("ts", "side"), keep=keep).drop("day")
    logs_ = [builds.build_log(trades, constants.BIN_SECONDS[f], constants.ROLLING_CHUNKS[f], warmup_days=args.warmup_days).withColumn("frequency", F.lit(f)) for f in args.frequencies]
    keys = monitored.select(F.col("pair").alias("symbol"), "day")
    log = functools.reduce(DataFrame.unionByName, logs_).join(keys, ["symbol", "day"], "left_semi")
    units = archives.epoch_units(spark, path, keep=archives.ranges_of(monitored)).select(F.col("pair").alias("symbol"), "day", F.when(~F.col("headed"), F.col("unit")).otherwise("").alias("unit"))
    return builds.with_units(log, units)


def structural_check(spark: SparkSession, args: argparse.Namespace) -> int:
    """Facts about inputs and form, without any endpoint."""
    os.environ["VIGIL_STRUCTURAL_ONLY"] = "1"
    tables = inputs(spark, args.data, rule=args.pair_hours_rule, reinstate=not args.exclude_amendment2_pairs)
    monitored = tables["monitored"].select("pair", "day")
    days, governed = tables["days"], tables["governed"]
    verified = logs.verified_pair_days(logs.without_dates(tables["manifest"]))
    sample = builds.sample_pair_days(monitored, n=args.sample_pair_days, generator=args.draws)

    def files() -> DataFrame:
        pairs = monitored.select("pair", F.col("day").cast("string").alias("day"))
        need = pairs.select(F.explode(F.array(logs.trades_file(F.col("pair"), F.col("day")), logs.bars_file(F.col("pair"), F.col("day")))).alias("file"))
        return logs.missing_files(need, archives.present_files(spark, f"{args.data}/raw"))

    @functools.cache
    def facts() -> DataFrame:
        """All checks of the episodes, which are computed once for them."""
        made = baseline_episodes(baseline_candidates(grids(spark, args.data, sample), scope=args.grid_scope))
        return builds.validate_once(made, ["pair", "detector", "threshold_label"])

    stages: dict[str, Callable[[], DataFrame]] = {
        "membership": lambda: members.membership_sizes(tables["tables"]),
        "pair_days": lambda: monitored.agg(F.count("*").alias("pair_days"), F.count_distinct("pair").alias("pairs")),
        "denominators": lambda: logs.denominator_report(governed, verified, days),
        "denominators_by_day": lambda: logs.denominators_by_day(governed, verified, days).orderBy("rule", "day"),
        "excluded": lambda: logs.excluded_rows(tables["manifest"]), "missing_files": files, "sample": lambda: sample,
    }
    if not args.skip_detectors:
        bars = f"{args.data}/raw/klines"
        stages |= {
            "coverage": lambda: logs.bar_coverage(grids(spark, args.data, sample), archives.read_bars(spark, bars, columns=(), keep=archives.ranges_of(sample))),
            "builds": lambda: builds.rollup(build_logs(spark, args, sample)), "facts": lambda: facts().drop("respected"),
            "cooldown": lambda: facts().select("respected"),
        }
    stamp, done, errors = provenance("structural"), {}, []
    for name, make in stages.items():
        try:
            sinks.write_table(make(), f"{args.out}/{name}", stamp)
            done[name] = spark.read.csv(f"{args.out}/{name}", header=True)
        except Exception as error:  # one broken archive must not hide the other facts
            errors.append((name, repr(error)[:1000]))
    failed = spark.createDataFrame(errors, "stage string, error string")
    sinks.write_table(failed, f"{args.out}/errors", stamp)
    sinks.markdown({**done, "errors": failed}, f"{args.out}/summary", title="Structural check")
    print(json.dumps({**stamp, "errors": len(errors)}))
    return 0


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--data", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--matrix", default="")
    parser.add_argument("--partial-structural-check", action="store_true")
    parser.add_argument("--pair-hours-rule", choices=logs.RULES, default=logs.RULES[0])
    parser.add_argument("--frequencies", nargs="*", choices=list(constants.BIN_SECONDS), default=list(constants.BIN_SECONDS))
    parser.add_argument("--grid-scope", choices=("continuous", "day"), default="continuous")
    parser.add_argument("--skip-detectors", action="store_true")
    parser.add_argument("--exclude-amendment2-pairs", action="store_true")
    parser.add_argument("--warmup-days", type=int, default=constants.WARMUP_DAYS)
    parser.add_argument("--sample-pair-days", type=int, default=constants.STRUCTURAL_SAMPLE)
    parser.add_argument("--draws", choices=("md5", "numpy"), default="md5", help="of the sampled pair-days")
    parser.add_argument("--published-thresholds", default="", help="CSV table to check the frozen thresholds against")
    parser.add_argument("--manual-sample", type=int, default=constants.SAMPLE_SIZE)
    args = parser.parse_args(argv)
    args.frequencies = args.frequencies or list(constants.BIN_SECONDS)
    if not args.partial_structural_check and not args.matrix:
        parser.error("the full analysis fits the forest and needs --matrix")
    return args


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return structural_check(spark, args) if args.partial_structural_check else full_analysis(spark, args)


if __name__ == "__main__":
    sys.exit(main())
