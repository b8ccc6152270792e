"""Archives, tables, writers, streams and the command line."""

import datetime as dt
import gzip
import os
import random
import zipfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil import constants
from vigil.operators import cooldown, manifest, timegrid
from vigil.plans import analysis, daily, queries
from vigil.sources import archives, sinks
from vigil.streaming.streams import stream_bins, stream_cooldown

DATA = "/root/testdata/sf0.001"


def _zip(folder, name, *members):
    os.makedirs(folder, exist_ok=True)
    with zipfile.ZipFile(f"{folder}/{name}", "w") as z:
        for i, text in enumerate(members):
            z.writestr(f"m{i}.csv", text)


TRADES = "1,2.0,3.0,10,10,1784851201570704,True,True\n2,2.5,1.0,11,11,1784851201570904,False,True\n3,3.0,2.0,12,12,1784851201573000,False,True\n"


def test_trades_archives(spark, tmp_path):
    _zip(tmp_path / "a", "币安-aggTrades-2026-07-24.zip", TRADES)
    _zip(tmp_path / "a", "B-aggTrades-2026-07-24.zip", ",".join(archives.TRADES) + "\n" + TRADES)
    _zip(tmp_path / "a", "C-aggTrades-2026-07-24.zip", "")
    got = archives.read_trades(spark, str(tmp_path / "a")).orderBy("pair", "seq").collect()
    assert [r["side"] for r in got] == ["sell", "buy", "buy"] * 2 and {r["pair"] for r in got} == {"币安", "B"}
    assert got[0]["quote_volume"] == 6.0 and len({r["ts"] for r in got}) == 2 and got[0]["ts"].microsecond == 570000
    assert {r["unit"] for r in archives.epoch_units(spark, str(tmp_path / "a")).collect()} == {"us"}
    _zip(tmp_path / "b", "D-aggTrades-2026-07-24.zip", TRADES, TRADES)
    with pytest.raises(Exception, match="2 members"):
        archives.read_trades(spark, str(tmp_path / "b")).collect()
    _zip(tmp_path / "c", "E-aggTrades-2026-07-24.zip", "1,2\n")
    with pytest.raises(Exception, match="2 fields"):
        archives.read_trades(spark, str(tmp_path / "c")).collect()


def test_tables_and_writers(spark, tmp_path):
    os.makedirs(tmp_path / "u")
    (tmp_path / "u/universe_2026-07-23.csv").write_text("symbol,vol30d,rank,included\nAUSDT,1.50000000,1,0\nBUSDT,1.0,51,1\n")
    (tmp_path / "days.txt").write_text("2026-07-24\n2026-07-25  2026-07-24\n")
    got = archives.read_universe(spark, str(tmp_path / "u")).orderBy("rank").collect()
    assert [(str(r["table_date"]), r["symbol"], r["included"]) for r in got] == [("2026-07-23", "AUSDT", False), ("2026-07-23", "BUSDT", True)]
    assert archives.read_days(spark, str(tmp_path / "days.txt")).count() == 2
    rows = spark.createDataFrame([("A", dt.datetime(2026, 8, 1), "z", 4.0, 5.0, "fixed", "", dt.datetime(2026, 8, 1, 0, 1), "2026-08-01")], "pair string, ts_utc timestamp_ntz, detector string, threshold double, score double, threshold_label string, frequency string, ts_available_utc timestamp_ntz, day string")
    sinks.write_episodes(rows, str(tmp_path / "episodes"))
    assert archives.read_episodes(spark, str(tmp_path / "episodes")).collect() == rows.collect()
    sinks.append_new(rows, rows, "pair", str(tmp_path / "more"))
    assert sinks.stamp(rows, {"run_id": "r"}).first()["run_id"] == "r"
    assert len(archives.file_digests(spark, str(tmp_path / "u")).first()["sha256"]) == 64
    (tmp_path / "verdicts.csv").write_text("sample_id,verdict\n1,match\n2,maybe\n")
    with pytest.raises(Exception, match="unknown verdict"):
        archives.read_verdicts(spark, str(tmp_path / "verdicts.csv")).collect()


def _stream(spark, df, path):
    df.repartition(1).sortWithinPartitions(df.columns[1]).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_streams_equal_batch(spark, tmp_path):
    rows = [(f"p{i % 3}", dt.datetime(2026, 8, 1) + dt.timedelta(seconds=i * i % 9000), "z", float(i)) for i in range(200)]
    hits = spark.createDataFrame(rows, "pair string, ts_utc timestamp_ntz, detector string, score double")
    out = stream_cooldown(_stream(spark, hits, str(tmp_path / "h")))
    run = out.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    kept = spark.read.schema("pair string, detector string, ts_utc timestamp_ntz, score double").parquet(str(tmp_path / "o"))
    expected = cooldown.apply_cooldown(hits, ["pair", "detector"])
    assert {(r["pair"], r["ts_utc"]) for r in kept.collect()} == {(r["pair"], r["ts_utc"]) for r in expected.collect()}
    trades = hits.select("pair", F.col("ts_utc").cast("timestamp").alias("ts"), F.col("score").alias("price"), F.col("score").alias("quote_volume"), F.lit("buy").alias("side"))
    binned = stream_bins(_stream(spark, trades, str(tmp_path / "t")), 600)
    run = binned.writeStream.format("memory").queryName("bins").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("bins").count() == timegrid.bin_trades(trades, 600).count()


@pytest.fixture
def archive_folder(spark, tmp_path):
    """Two days of one pair with a rise in volume and price on the second, and labelled matrices for the forest."""
    data, rng = tmp_path / "data", random.Random(3)
    for folder in ("universe", "manifests", "matrix"):
        os.makedirs(data / folder)
    (data / "universe/universe_2026-07-23.csv").write_text("symbol,vol30d,rank,included\nA,1.0,51,1\nB,0.5,52,1\n")
    lines = [f"2026-07-{d},A,A-{k}-2026-07-{d}.zip,1,x,1" for d in (24, 25) for k in ("aggTrades", "1m")]
    (data / "manifests/pull_manifest.csv").write_text("date,symbol,file,bytes,sha256,source_checksum_ok\n" + "\n".join(lines) + "\n")
    start = 1784851200000
    for d in range(2):
        bars = []
        for i in range(1440):
            hot = d == 1 and 600 <= i < 605
            close = 1 + (0.5 if hot else 0) + rng.random() * 0.01
            bars.append(f"{start + 86400000 * d + 60000 * i},1,{close + 0.01},{close - 0.01},{close},5,0,{(5000 if hot else 100) + rng.random()},3,0,0,0")
        _zip(data / f"raw/klines/2026-07-{24 + d}", f"A-1m-2026-07-{24 + d}.zip", "\n".join(bars) + "\n")
        at = [start + 86400000 * d + 25000 * i + k * (i * 7 % 3) for i in range(3456) for k in range(2 + i % 2)]  # in every third bin all at one time
        trades = [f"{i},{1 + rng.random() * 0.1},{1 + rng.random()},1,1,{t},False,True" for i, t in enumerate(at)]
        _zip(data / f"raw/aggTrades/2026-07-{24 + d}", f"A-aggTrades-2026-07-{24 + d}.zip", "\n".join(trades) + "\n")
    for f in ("25S",):
        rows = [[rng.gauss(0, 0.01) for _ in constants.FEATURES] for _ in range(80)]
        text = ",".join(("symbol", *constants.FEATURES, "gt")) + "\n" + "\n".join(",".join(map(str, ["A", *r, int(r[0] > 0)])) for r in rows)
        with gzip.open(data / f"matrix/features_{f}.csv.gz", "wt") as out:
            out.write(text)
    return data


def test_full_analysis(spark, archive_folder, tmp_path, monkeypatch):
    monkeypatch.setenv("VIGIL_STRUCTURAL_ONLY", "0")
    monkeypatch.setitem(constants.FOREST, "numTrees", 5)
    days = archive_folder / "manifests/days_completed.txt"
    days.write_text("2026-07-24\n")
    arguments = ["--data", str(archive_folder), "--out", str(tmp_path / "full"), "--matrix", str(archive_folder / "matrix"), "--manual-sample", "5", "--frequencies", "25S"]
    assert analysis.main(arguments) == 2  # days are missing
    days.write_text("\n".join(str(dt.date(2026, 7, 24) + dt.timedelta(days=k)) for k in range(84)))
    assert analysis.main(arguments) == 0
    table = lambda name: spark.read.csv(str(tmp_path / "full" / name), header=True).toPandas()
    made = spark.read.parquet(str(tmp_path / "full/episodes")).toPandas()
    assert set(made["detector"]) == {"volume_zscore", "price_jump", "upstream_rf"} and set(made["frequency"]) == {"", "25S"}
    spike = made[made["detector"] == "volume_zscore"]["ts_utc"]
    assert list(map(str, spike)) == ["2026-07-25 10:00:00"]
    assert len(table("alerts_per_day")) == 84 * len(table("rates")) and float(table("rates")["pair_hours"].iloc[0]) == 48.0
    assert set(table("rates_sensitivity_rule")["pair_hours_rule"]) == {"universe-membership"} and len(table("sample")) == 5
    assert set(table("feature_build_log")["frequency"]) == {"25S"} and len(table("intervals")) == len(table("rates"))
    assert set(table("precision")["rule"]) == {r[0] for r in constants.RULES} and {"curves", "stratified", "agreement", "signatures", "distribution"} <= set(os.listdir(tmp_path / "full"))


def test_structural_check_and_daily_plan(spark, archive_folder, tmp_path, monkeypatch):
    monkeypatch.setenv("VIGIL_STRUCTURAL_ONLY", "0")
    (archive_folder / "manifests/days_completed.txt").write_text("2026-07-24\n")
    assert analysis.main(["--data", str(archive_folder), "--out", str(tmp_path / "out"), "--partial-structural-check"]) == 0
    table = lambda name: spark.read.csv(str(tmp_path / "out" / name), header=True).collect()
    assert table("errors") == [] and table("cooldown")[0]["respected"] == "true" and table("cooldown")[0]["run_id"]
    assert table("missing_files") == [] and {r["pairs"] for r in table("denominators")} == {"1", "4"} and len(table("builds")) == 3
    assert all(table("facts")[0][c] == "true" for c in ("timed", "known_detector", "above_threshold", "available_later"))
    assert "## coverage" in spark.read.text(str(tmp_path / "out/summary"), wholetext=True).first()[0]
    os.remove(archive_folder / "raw/klines/2026-07-25/A-1m-2026-07-25.zip")
    _zip(archive_folder / "raw/klines/2026-07-25", "A-1m-2026-07-25.zip", "1,2\n")
    monkeypatch.setenv("VIGIL_STRUCTURAL_ONLY", "0")
    assert analysis.main(["--data", str(archive_folder), "--out", str(tmp_path / "broken"), "--partial-structural-check", "--sample-pair-days", "1"]) == 0
    assert {r["stage"] for r in spark.read.csv(str(tmp_path / "broken/errors"), header=True).collect()} == {"coverage", "facts", "cooldown"}
    assert daily.main(["--data", str(archive_folder), "--out", str(tmp_path / "plan"), "--today", "2026-07-28"]) == 0
    plan = lambda name: spark.read.csv(str(tmp_path / "plan" / name), header=True).collect()
    assert [r["day"] for r in plan("days")] == ["2026-07-25", "2026-07-26"]
    assert {(r["day"], r["symbol"]) for r in plan("targets")} == {("2026-07-25", s) for s in ("B", "JUPUSDT", "SYRUPUSDT")} | {("2026-07-26", s) for s in ("A", "B", "JUPUSDT", "SYRUPUSDT")}


def test_logs_keep_the_order_of_appends(spark, tmp_path):
    row = lambda ok: spark.createDataFrame([("2026-07-24", "A", "f.zip", 1, "x", ok), ("2026-07-24", "A", "g.zip", 1, "x", ok)], "date string, symbol string, file string, bytes long, sha256 string, source_checksum_ok string")
    for ok in ("0", "1", "0", "1"):
        sinks.append_log(row(ok), str(tmp_path / "log"))
    log = archives.read_manifest(spark, str(tmp_path / "log"))
    assert log.count() == 8 and {r["source_checksum_ok"] for r in manifest.keep_last(log, ["date", "file"]).collect()} == {"1"}
    universe = spark.createDataFrame([("A", "1.0", 1, 0)], "symbol string, vol30d string, rank int, included int")
    sinks.write_universe(universe, str(tmp_path / "universe"))
    assert len(spark.read.text(str(tmp_path / "universe.sha256")).first()[0].split("  ")[0]) == 64
    with pytest.raises(Exception, match="exist"):
        sinks.write_universe(universe, str(tmp_path / "universe"))
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file string, sha256 string")
    side = spark.createDataFrame([("a", "1"), ("b", "9")], "file string, published string")
    expected = spark.createDataFrame([(f,) for f in "abcde"], "file string")
    states = manifest.fetch_status(expected, files, side, spark.createDataFrame([("e",)], "file string")).collect()
    assert {r["file"]: (r["status"], r["source_checksum_ok"]) for r in states} == {"a": ("ok", "1"), "b": ("failed", "0"), "c": ("ok", ""), "d": ("404", ""), "e": ("skipped", "")}
    up = spark.createDataFrame([("p", 1, 0), ("p", 2, 1), ("q", 2, 0), ("q", 1, 1)], "pair string, open_time long, seq long")
    assert {r["pair"]: r["monotonic"] for r in manifest.in_order(up).collect()} == {"p": True, "q": False}


def _plain(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda v: None if pd.isna(v) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(cell(v.item() if hasattr(v, "item") else v) for v in row) for row in frame.itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and _plain(got) == _plain(want)
