"""Universe, manifests, endpoints, bootstrap, signatures and the guard."""

import collections
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil import constants
from vigil.operators import bootstrap, manifest as logs, signatures, universe, workload
from vigil.plans import analysis
from vigil.plans.guard import EndpointsSuppressed

D = dt.date
STREAM = ("volume_zscore", "", "fixed")


def days(spark, *names):
    return spark.createDataFrame([(D.fromisoformat(n),) for n in names], "day date")


def tables(spark, rows):
    return spark.createDataFrame([(D.fromisoformat(t), s, r, r > skip) for t, s, r, skip in rows], "table_date date, symbol string, rank int, included boolean")


def test_governing_table_is_strictly_earlier(spark):
    t = tables(spark, [("2026-07-23", "A", 1, 0), ("2026-07-31", "A", 1, 0)])
    got = {r["day"].isoformat(): str(r["table_date"]) for r in universe.governing_table(days(spark, "2026-07-23", "2026-07-24", "2026-07-31", "2026-08-01"), t).collect()}
    assert got == {"2026-07-23": "None", "2026-07-24": "2026-07-23", "2026-07-31": "2026-07-23", "2026-08-01": "2026-07-31"}


def test_reinstated_pairs_come_last_and_only_under_defective_tables(spark):
    t = tables(spark, [("2026-07-23", "A", 1, 0), ("2026-08-07", "A", 1, 0), ("2026-08-07", "JUPUSDT", 2, 0)])
    got = {(r["day"].isoformat(), r["symbol"], r["rank"]) for r in universe.governed(days(spark, "2026-07-24", "2026-08-08"), t).collect()}
    assert got == {("2026-07-24", "A", 1), ("2026-07-24", "JUPUSDT", None), ("2026-07-24", "SYRUPUSDT", None), ("2026-08-08", "A", 1), ("2026-08-08", "JUPUSDT", 2)}


@pytest.mark.parametrize(("n", "sizes"), [(6, [2, 2, 2]), (4, [1, 2, 1]), (1, [0, 1, 0])])
def test_strata_are_cut_at_rounded_places(spark, n, sizes):
    rows = spark.createDataFrame([(D(2026, 8, 1), f"S{i}", i + 51) for i in range(n)] + [(D(2026, 8, 1), "X", None)], "day date, symbol string, rank int")
    got = universe.strata(rows).collect()
    assert [sum(r["stratum"] == k for r in got) for k in (1, 2, 3)] == sizes and [r["symbol"] for r in got if r["stratum"] is None] == ["X"]


def test_rank_eligibility_volume_and_churn(spark):
    v = spark.createDataFrame([(D(2026, 8, 1), "B", 5), (D(2026, 8, 1), "A", 5), (D(2026, 8, 1), "C", 9)], "table_date date, symbol string, volume int")
    assert [(r["symbol"], r["included"]) for r in universe.rank_table(v, excluded=2).orderBy("rank").collect()] == [("C", False), ("A", False), ("B", True)]
    s = spark.createDataFrame([("AUSDT", "A", "USDT", "TRADING", True), ("BUSDT", "B", "USDT", "BREAK", True), ("CUSDT", "C", "USDT", "TRADING", None), ("UPUSDT", "UP", "USDT", "TRADING", True), ("ABTC", "A", "BTC", "TRADING", True)], "symbol string, base_asset string, quote_asset string, status string, spot_allowed boolean")
    assert [r[0] for r in universe.eligible(s, excluded_bases=["UP"]).collect()] == ["AUSDT"]
    fixed = spark.createDataFrame([(b + "USDT", b, "USDT", "TRADING", True) for b in ("JUP", "SYRUP", "BTCUP", "EUR", "AAA")], "symbol string, base_asset string, quote_asset string, status string, spot_allowed boolean")
    assert [r[0] for r in universe.eligible(fixed).collect()] == ["AAAUSDT", "JUPUSDT", "SYRUPUSDT"]
    daily = spark.createDataFrame([("A", D(2026, 7, 1) + dt.timedelta(i), 1000.0 if i == 30 else 1.0) for i in range(31)], "symbol string, day date, volume double")
    assert float(universe.trailing_volume(daily).first()["volume"]) == 30.0
    t = tables(spark, [("2026-07-23", "A", 1, 0), ("2026-07-23", "B", 2, 0), ("2026-07-31", "B", 1, 0), ("2026-07-31", "C", 2, 0)])
    assert tuple(universe.churn(t).first())[1:] == (1, 1, 1)


def manifest(spark, rows):
    return spark.createDataFrame([(i, D.fromisoformat(d), s, f"{s}-{k}-{d}.zip", ok, "ok", "x", 1) for i, (d, s, k, ok) in enumerate(rows)], "seq long, date date, symbol string, file string, source_checksum_ok string, status string, sha256 string, bytes long")


def test_denominators(spark):
    m = manifest(spark, [("2026-09-02", "A", "aggTrades", "0"), ("2026-09-02", "A", "aggTrades", "1"), ("2026-09-02", "A", "1m", "1"), ("2026-09-03", "A", "aggTrades", "1"), ("2026-09-03", "A", "1m", ""), ("2026-09-02", "B", "aggTrades", "1"), ("2026-09-02", "B", "1m", "1")])
    verified = logs.verified_pair_days(m)
    assert {tuple(r) for r in verified.collect()} == {(D(2026, 9, 2), "A"), (D(2026, 9, 2), "B")}
    spine = days(spark, "2026-09-02", "2026-09-03")
    governed = universe.governed(spine, tables(spark, [("2026-09-01", "A", 51, 50), ("2026-09-01", "B", 52, 50), ("2026-09-01", "C", 1, 50)]), reinstated=())
    hours = lambda rule: [r["hours"] for r in logs.pair_hours_by_day(logs.monitored_pair_days(governed, verified, rule), spine).orderBy("day").collect()]
    assert hours("verified-archive") == [48.0, 0.0] and hours("universe-membership") == [48.0, 48.0]
    with pytest.raises(ValueError, match="rule"):
        hours("other")
    report = {r["rule"]: r["pair_hours"] for r in logs.denominator_report(governed, verified, spine).collect()}
    assert report == {"verified-archive": 48.0, "universe-membership": 96.0}


def spread_tables(spark):
    """Tables of eight symbols and more, one without an included symbol, and days under each."""
    rows = [("2026-07-23", f"S{i}", i, 2) for i in range(1, 9)] + [("2026-07-30", "S1", 1, 2)] + [("2026-08-06", f"S{i}", 12 - i, 2) for i in range(1, 12)]
    return days(spark, "2026-07-23", "2026-07-24", "2026-07-29", "2026-08-01", "2026-08-07", "2026-08-08"), tables(spark, rows)


REINSTATED = {"reinstated": ("S1", "S4"), "last_defective": "2026-07-30"}


def test_what_is_verified_meets_tables_before_their_days(spark):
    spine, t = spread_tables(spark)
    verified = spark.createDataFrame([(D.fromisoformat(d), s) for d in ("2026-07-24", "2026-08-01", "2026-08-08", "2026-09-01") for s in ("S1", "S3", "S4", "S9", "none")], "date date, symbol string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    for rule in logs.RULES:
        want = rows(logs.monitored_pair_days(universe.governed(spine, t, **REINSTATED), verified, rule).select("day", "table_date", "symbol", "rank"))
        assert want and rows(logs.monitored_of_days(spine, t, verified, rule, **REINSTATED)) == want
    assert rows(universe.governed(spine, t, **REINSTATED, only=verified.select(F.col("date").alias("day"), "symbol").unionByName(verified.select(F.col("date").alias("day"), "symbol")))) == rows(logs.monitored_of_days(spine, t, verified, **REINSTATED))
    with pytest.raises(ValueError, match="rule"):
        logs.monitored_of_days(spine, t, verified, "other")


def test_strata_of_tables_are_those_of_their_days(spark):
    spine, t = spread_tables(spark)
    rows = lambda df: sorted((tuple(r) for r in df.select("day", "symbol", "stratum").collect()), key=str)
    want = rows(universe.strata(universe.governed(spine, t, **REINSTATED)))
    assert {r[2] for r in want} == {1, 2, 3, None} and rows(universe.governed(spine, universe.table_strata(t), **REINSTATED)) == want


def test_log_states(spark):
    log = spark.createDataFrame([(D(2026, 8, 1), "404"), (D(2026, 8, 8), "404"), (D(2026, 8, 8), "ok"), (D(2026, 8, 2), "ok"), (D(2026, 8, 3), "failed"), (D(2026, 8, 3), "ok"), (D(2026, 8, 4), "ok"), (D(2026, 8, 4), "404")], "date date, status string").withColumn("bytes", F.lit(1))
    got = {r["date"].day: r["state"] for r in logs.completion(logs.pull_statistics(log), "2026-08-10").collect()}
    assert got == {1: "retry", 8: "retry", 2: "complete", 3: "retry", 4: "complete"}
    kinds = {(r["date"].day, r["k"]) for r in log.select("date", logs.taxonomy(F.col("status"), F.col("date"), "2026-08-10").alias("k")).collect()}
    assert (1, "listing gap") in kinds and (8, "pending") in kinds
    m = manifest(spark, [("2026-09-02", "A", "1m", "1")] * 3).withColumn("status", F.element_at(F.array(F.lit("ok"), F.lit("skipped"), F.lit("404")), (F.col("seq") + 1).cast("int")))
    assert logs.manifest_rows_wanted(m, m.limit(0).select("date", "file")).count() == 2
    assert logs.manifest_rows_wanted(m, m.select("date", "file")).count() == 1
    done = days(spark, "2026-08-02")
    assert [r["day"].day for r in logs.outstanding_days("2026-08-01", "2026-08-03", done).orderBy("day").collect()] == [1, 3]


def episodes(spark, rows):
    """rows: (pair, seconds, detector)."""
    made = [(p, dt.datetime(2026, 8, 1) + dt.timedelta(seconds=s), d, "", "fixed", str((dt.datetime(2026, 8, 1) + dt.timedelta(seconds=s)).date())) for p, s, d in rows]
    return spark.createDataFrame(made, "pair string, ts_utc timestamp_ntz, detector string, frequency string, threshold_label string, day string")


def test_endpoints(spark):
    own = episodes(spark, [("A", 0, "z"), ("A", 90_000, "z"), ("B", 10, "z"), ("A", 1800, "j"), ("B", 1811, "j")])
    per_day = workload.alerts_per_day(own, days(spark, "2026-08-01", "2026-08-02", "2026-08-03"))
    assert sorted(r["alerts"] for r in per_day.where("detector = 'z'").collect()) == [0, 1, 2]
    d = workload.distribution(per_day).where("detector = 'z'").first()
    assert (d["n_days"], d["mean"], d["sd"], d["median"], d["p90"], d["total"]) == (3, 1.0, 1.0, 1.0, pytest.approx(1.8), 3)
    assert workload.rate_per_1000_hours(own, 48.0).where("detector = 'z'").first()["rate"] == pytest.approx(62.5)
    with pytest.raises(ValueError, match="pair-hours"):
        workload.rate_per_1000_hours(own, 0.0)
    got = {(r["detector_a"], r["detector_b"]): (r["alerts"], r["matched"]) for r in workload.agreement(own).collect()}
    assert got == {("z", "j"): (3, 1), ("j", "z"): (2, 1)}  # 1800 seconds count, 1801 do not
    monitored = spark.createDataFrame([(D(2026, 8, 1), "A")], "day date, symbol string")
    assert workload.restrict_to_monitored(own, monitored).count() == 2
    strata = spark.createDataFrame([(D(2026, 8, 1), "A", 1)], "day date, symbol string, stratum int")
    rows = {r["stratum"]: (r["alerts"], r["pair_hours"], r["rate"]) for r in workload.stratified(own, strata, monitored).where("detector = 'z'").collect()}
    assert rows["1"] == (1, 24.0, pytest.approx(1000 / 24)) and rows["2"] == (0, 0.0, None) and rows["unassigned"] == (2, 0.0, None)


def test_threshold_curve_repeats_the_cooldown(spark):
    own = episodes(spark, [("A", 600 * i, "z") for i in range(6)]).withColumn("score", F.expr("case when minute(ts_utc) % 20 = 0 then 2.0 else 1.0 end"))
    got = {r["threshold"]: r["alerts"] for r in workload.threshold_curve(own, spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "threshold double")).collect()}
    assert got == {1.0: 2, 2.0: 2, 9.0: 0}
    assert workload.threshold_grid(spark).count() == 22


def test_full_analysis_covers_all_streams(spark):
    args = ["--data", "d", "--out", "o", "--matrix", "m"]
    assert analysis.arguments(args).frequencies == analysis.arguments([*args, "--frequencies"]).frequencies == ["25S", "15S", "5S"]
    with pytest.raises(SystemExit):
        analysis.arguments(args[:4])
    own = episodes(spark, [("A", 0, "volume_zscore"), ("A", 9000, "volume_zscore")]).withColumn("score", F.expr("case when hour(ts_utc) % 2 = 0 then 9.0 else 2.5 end")).withColumn("frequency", F.lit(""))
    scores = [r["score"] for r in own.collect()]
    got = collections.defaultdict(dict)
    for r in workload.threshold_curve(own, workload.stream_thresholds(spark, ["25S", "5S"])).collect():
        got[r["detector"], r["frequency"]][r["threshold"]] = r["alerts"]
    assert {k: (len(v), min(v), max(v)) for k, v in got.items()} == {("upstream_rf", "25S"): (22, 0.05, 0.95), ("upstream_rf", "5S"): (22, 0.05, 0.95), ("volume_zscore", ""): (17, 2.0, 10.0), ("price_jump", ""): (29, 0.01, 0.15)}
    assert got["volume_zscore", ""] == {t: sum(s >= t for s in scores) for t in got["volume_zscore", ""]} and set(got["price_jump", ""].values()) == {0}
    monitored = spark.createDataFrame([(D(2026, 8, 1), "A"), (D(2026, 8, 1), "B")], "day date, symbol string")
    rate = analysis.sensitivity_rates(own, monitored, logs.RULES[1]).first()
    assert (rate["alerts"], rate["pair_hours"], rate["rate"], rate["pair_hours_rule"]) == (2, 48.0, pytest.approx(2000 / 48), "universe-membership")


def test_bootstrap(spark):
    rows = spark.createDataFrame([("a", 10, 24.0), ("b", 0, 24.0)], "pair string, n int, hours double")
    one, two = (bootstrap.bootstrap_ratio(rows, "pair", ["n"], "hours", n_draws=300).first() for _ in range(2))
    assert one == two and {one["low"], one["high"]} <= {0.0, 10000 / 48, 20000 / 48}
    values = np.array([3.0, 1.0, 0.0, 7.0])
    index = np.random.default_rng(5).integers(0, 4, (50, 4))
    low, high = np.percentile(values[index].mean(axis=1), [2.5, 97.5])
    got = bootstrap.bootstrap_mean(spark.createDataFrame([(f"p{i}", float(v)) for i, v in enumerate(values)], "pair string, v double"), "pair", "v", n_draws=50, seed=5).first()
    assert (got["low"], got["high"]) == (pytest.approx(low), pytest.approx(high))
    with pytest.raises(ValueError, match="clusters"):
        bootstrap.bootstrap_mean(rows.limit(0), "pair", "n")


def test_sample_is_seeded(spark):
    own = episodes(spark, [(f"p{i}", 60 * i, "z") for i in range(50)])
    one, two = (bootstrap.draw_sample(own, n=10).orderBy("sample_id").collect() for _ in range(2))
    assert one == two and len(one) == 10 and {r["verdict"] for r in one} == {""}
    picks = np.sort(np.random.default_rng(constants.SAMPLE_SEED).choice(50, size=10, replace=False))
    assert [r["pair"] for r in one] == [f"p{i}" for i in picks]


def grid(spark, volume=1500.0, top=1.30, peak=1, low=1.10, low_at=20, after=120, trail=40):
    n = trail + 1 + after
    rows = []
    for i in range(n):
        held = peak and trail + peak <= i
        price = top if held else 1.0
        rows.append(("A", dt.datetime(2026, 8, 1) + dt.timedelta(minutes=i), price, low if peak and i == trail + peak + low_at else price, price if i != trail else 1.0, volume if trail < i <= trail + peak else 100.0))
    return spark.createDataFrame(rows, "pair string, open_time timestamp_ntz, high double, low double, close double, quote_volume double")


def judge(spark, at=40, **shape):
    alert = spark.createDataFrame([("A", dt.datetime(2026, 8, 1) + dt.timedelta(minutes=at, seconds=30), "z", "", "fixed")], "pair string, ts_utc timestamp_ntz, detector string, frequency string, threshold_label string")
    return {r["rule"]: r for r in signatures.evaluate(alert, grid(spark, **shape), signatures.rules_table(spark), trail=40).collect()}


@pytest.mark.parametrize(
    ("shape", "matching"),
    [({}, {"primary", "loose", "window10"}), ({"volume": 600.0}, {"loose"}), ({"top": 1.5, "volume": 2500.0}, {"primary", "loose", "strict", "window10"}), ({"peak": 8}, {"window10"}), ({"low": 1.30}, set()), ({"low_at": 61}, set()), ({"low_at": 60}, {"primary", "loose", "window10"})],
)
def test_signatures(spark, shape, matching):
    assert {k for k, r in judge(spark, **shape).items() if r["matched"]} == matching


def test_signature_boundaries_and_reasons(spark):
    assert not judge(spark, top=1.25)["primary"]["gain_ok"]
    assert judge(spark, at=39)["primary"]["reason"] == "too little before"
    assert judge(spark, at=500)["primary"]["reason"] == "time absent"
    assert judge(spark, after=3)["primary"]["reason"] == "gain window cut off"
    assert judge(spark, after=30)["primary"]["reason"] == "retrace window cut off"
    status = signatures.verdict_status(spark.createDataFrame([(" Match",), ("unclear",), ("",)], "verdict string")).first()
    assert (status["match"], status["no_match"], status["unclear"], status["complete"]) == (1, 0, 1, False)


def test_guard(spark, monkeypatch):
    monkeypatch.setenv("VIGIL_STRUCTURAL_ONLY", "1")
    with pytest.raises(EndpointsSuppressed):
        workload.rate_per_1000_hours(None, 1.0)
    with pytest.raises(EndpointsSuppressed):
        signatures.summarise(None)
