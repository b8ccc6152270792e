"""Which archives are opened, and how much of them; commands that write membership tables and days."""

import datetime as dt
import io
import os
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil import constants
from vigil.functions import numeric
from vigil.operators import builds, detectors, model, universe
from vigil.plans import analysis, daily
from vigil.sources import archives, sinks, zip_source

RECORD = "{},2.0,3.0,10,10,1784851201570704,True,True\n"


def put(folder, name, text, members=1):
    os.makedirs(folder, exist_ok=True)
    with zipfile.ZipFile(f"{folder}/{name}", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(members):
            z.writestr(f"m{i}.csv", text)


@pytest.fixture
def folder(tmp_path):
    """Two pairs on three days; what is not asked for is no archive at all, so that opening it ends the job."""
    for day in ("2026-07-24", "2026-07-25", "2026-07-26"):
        for pair in ("A", "币B"):
            put(tmp_path / day, f"{pair}-aggTrades-{day}.zip", "".join(RECORD.format(i) for i in range(3)))
    for name in ("2026-07-24/币B-aggTrades-2026-07-24.zip", "2026-07-26/A-aggTrades-2026-07-26.zip"):
        (tmp_path / name).write_bytes(b"not a ZIP")
    return str(tmp_path)


def day(text):
    return dt.date.fromisoformat(text)


WANTED = [("A", day("2026-07-24"), day("2026-07-25")), ("币B", day("2026-07-25"), day("2026-07-26"))]


@pytest.mark.parametrize("store", ["arrow", "hadoop"])
def test_only_wanted_archives_are_opened(spark, folder, monkeypatch, store):
    if store == "hadoop":  # a store that only Spark's own readers know
        monkeypatch.setattr(zip_source, "file_system", lambda uri: None)
    got = archives.read_trades(spark, folder, keep=WANTED)
    assert {(r["pair"], str(r["day"])) for r in got.collect()} == {("A", "2026-07-24"), ("A", "2026-07-25"), ("币B", "2026-07-25"), ("币B", "2026-07-26")}
    assert got.count() == 12 and {r["seq"] for r in got.collect()} == {0, 1, 2}
    with pytest.raises(Exception, match="(?i)not a zip"):
        archives.read_trades(spark, folder).collect()
    assert archives.read_trades(spark, folder, keep=[]).count() == 0
    assert {(r["pair"], r["unit"]) for r in archives.epoch_units(spark, folder, keep=WANTED[:1]).collect()} == {("A", "us")}
    # A frame used with and without a filter of its own reads what each use asks for.
    own = got.where("day = DATE'2026-07-25'").select("pair").unionByName(got.select("pair"))
    assert own.count() == 2 * 3 + 12


def test_partitions_hold_only_wanted_archives_and_several_small_ones(folder):
    reader = zip_source.ArchiveReader({"path": "file:" + folder, "columns": "a", "keep": '[["A", "2026-07-24", "2026-07-24"]]'}, archives.StructType.fromDDL("file string"))
    assert [[os.path.basename(f) for f in p.paths] for p in reader.partitions()] == [["A-aggTrades-2026-07-24.zip"]]
    each = zip_source.ArchiveReader({"path": "file://" + folder, "columns": "a", "partitionbytes": "1"}, archives.StructType.fromDDL("file string"))
    assert len(each.partitions()) == 6
    together = zip_source.ArchiveReader({"path": "file://" + folder, "columns": "a"}, archives.StructType.fromDDL("file string"))
    assert [len(p.paths) for p in together.partitions()] == [6]


def test_only_wanted_columns_are_parsed(spark, tmp_path):
    put(tmp_path, "A-aggTrades-2026-07-24.zip", "1,2.0,no number,10,10,1784851201570704,True,True\n")
    assert archives.read_trades(spark, str(tmp_path), columns=("ts", "price")).select("price").first()[0] == 2.0
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        archives.read_trades(spark, str(tmp_path)).collect()
    assert archives.read_bars(spark, str(tmp_path), columns=()).columns == ["pair", "day", "open_time"]


@pytest.mark.parametrize(
    ("text", "rows", "error"),
    [
        ("h,e,a,d,e,r,x,y\n" + RECORD.format(1), 1, None), ("\n\n" + RECORD.format(1) + "\n", 1, None), ("h,e,a,d,e,r,x,y\n", 0, None), ("  \n \n", 0, None), ("", 0, None),
        ("h,e,a,d,e,r,x,y\nbroken,record\n" + RECORD.format(1), None, "2 fields"), ("h,e,a,d,e,r,x,y\nb,r,o,k,e,n,x,y\n" + RECORD.format(1), None, "CAST_INVALID_INPUT|cannot be cast"),
        (RECORD.format(1) + "1,2,3\n", None, "3 fields"), (RECORD.format(1).strip() + ",9\n", None, "9 fields"),
    ],
)
def test_only_the_first_line_may_be_a_header(spark, tmp_path, text, rows, error):
    put(tmp_path, "A-aggTrades-2026-07-24.zip", text)
    if error:
        with pytest.raises(Exception, match=error):
            archives.read_trades(spark, str(tmp_path)).collect()
    else:
        assert archives.read_trades(spark, str(tmp_path)).count() == rows


class Counted(io.BytesIO):
    """Bytes that tell how many of them were read."""

    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_heads_do_not_read_the_archive():
    rng, taken = random.Random(1), []
    for lines in (10_000, 300_000):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("m.csv", "".join(RECORD.format(rng.randrange(10**9)) for _ in range(lines)))
        file = Counted(raw.getvalue())
        headed, first = zip_source.head("x", file)
        assert not headed and len(first) == 8
        taken.append((file.taken, len(raw.getvalue())))
    (small, _), (large, size) = taken
    assert large <= small + 10_000 and large < size / 20
    assert zip_source.head("x", _archive("h,e\n" + RECORD.format(7)))[0] is True
    assert zip_source.head("x", _archive("")) == (False, [])
    with pytest.raises(ValueError, match="0 members"):
        zip_source.head("x", _archive())


def _archive(*members):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for i, text in enumerate(members):
            z.writestr(f"m{i}", text)
    raw.seek(0)
    return raw


def test_names_paths_and_ranges(spark, tmp_path):
    assert zip_source.pair_and_day("/a/b/币B-1m-2026-07-24.zip") == ("币B", day("2026-07-24"))
    assert zip_source.pair_and_day("A-other.zip") == ("A", None) and zip_source.pair_and_day("x.csv") == (None, None)
    assert zip_source.qualified(spark, "/a/b") == "file:/a/b" and zip_source.file_system("file:/a/b")[1] == "/a/b"
    assert zip_source.file_system("viewfs://c/a") is None
    days = spark.createDataFrame([("A", d) for d in ("2026-07-01", "2026-07-02", "2026-07-02", "2026-07-05")] + [("B", "2026-07-09")], "pair string, day string").withColumn("day", F.to_date("day"))
    assert sorted(archives.ranges_of(days, before=1)) == [("A", day("2026-06-30"), day("2026-07-02")), ("A", day("2026-07-04"), day("2026-07-05")), ("B", day("2026-07-08"), day("2026-07-09"))]


def test_rollup_has_the_distinct_units(spark):
    log = spark.createDataFrame([("25S", s, "d", 5, 2, 7, True) for s in "abcd"] + [("5S", "a", "d", 1, 0, 1, False)], "frequency string, symbol string, day string, n_rows_target_day long, n_rows_scored long, n_trades_target_day long, warmup_sufficient boolean")
    units = spark.createDataFrame([("a", "d", "us"), ("b", "d", "ms"), ("c", "d", ""), ("a", "e", "ns")], "symbol string, day string, unit string")
    got = {r["frequency"]: r for r in builds.rollup(builds.with_units(log, units)).collect()}
    assert got["25S"]["units"] == "ms,us" and got["5S"]["units"] == "us" and got["25S"]["builds"] == 4 and got["5S"]["builds_without_rows"] == 1


# Commands


def test_membership_table_is_ranked_and_written_once(spark, tmp_path):
    os.makedirs(tmp_path / "exchange/symbols")
    os.makedirs(tmp_path / "exchange/daily")
    symbols = [f"S{i:02d}USDT,TRADING,USDT,S{i:02d},true" for i in range(60)] + ["BTCUPUSDT,TRADING,USDT,BTCUP,true", "XUSDT,HALT,USDT,X,true", "YUSDT,TRADING,USDT,Y,false"]
    (tmp_path / "exchange/symbols/a.csv").write_text("symbol,status,quote_asset,base_asset,spot_allowed\n" + "\n".join(symbols) + "\n")
    candles = [f"S{i:02d}USDT,2026-07-{d},{(i + 1) * (1000 if d == 28 else 1)}.5" for i in range(59) for d in range(20, 29)]  # the last day still runs
    (tmp_path / "exchange/daily/a.csv").write_text("symbol,day,volume\n" + "\n".join(candles) + "\n")
    arguments = ["--data", str(tmp_path), "--today", "2026-07-28", "--update-universe"]
    assert daily.main(arguments) == 0
    got = archives.read_universe(spark, str(tmp_path / "universe")).orderBy("rank").collect()
    assert [r["symbol"] for r in got] == [f"S{i:02d}USDT" for i in (*range(58, -1, -1), 59)]
    assert [r["included"] for r in got] == [False] * 50 + [True] * 10 and {str(r["table_date"]) for r in got} == {"2026-07-28"}
    assert float(got[0]["vol30d"]) == 8 * 59.5 and float(got[-1]["vol30d"]) == 0
    assert daily.main(arguments) == 1  # a table that is there stays
    assert universe.latest_table(archives.read_universe(spark, str(tmp_path / "universe"))).count() == 60


def test_requeued_day_is_outstanding_again(spark, tmp_path, capsys):
    os.makedirs(tmp_path / "manifests")
    path = tmp_path / "manifests/days_completed.txt"
    path.write_text("2026-07-24\n2026-07-25\n")
    assert daily.main(["--data", str(tmp_path), "--requeue-day", "2026-07-24"]) == 0
    left = lambda: [str(r["day"]) for r in archives.read_days(spark, str(path)).collect()]
    assert left() == ["2026-07-25"]
    assert daily.main(["--data", str(tmp_path), "--requeue-day", "2026-07-20"]) == 0 and "not among" in capsys.readouterr().out
    assert left() == ["2026-07-25"]
    assert daily.main(["--data", str(tmp_path), "--requeue-day", "2026-07-25"]) == 0 and left() == []
    with pytest.raises(ValueError):
        daily.main(["--data", str(tmp_path), "--requeue-day", "yesterday"])
    with pytest.raises(SystemExit):
        daily.main(["--data", str(tmp_path)])


def test_appends_continue_the_sequence(spark, tmp_path):
    rows = lambda *files: spark.createDataFrame([("s", f) for f in files], "symbol string, file string")
    for files in (("b", "a"), ("c",), ("e", "d")):
        sinks.append_log(rows(*files), str(tmp_path / "log"))
    got = spark.read.csv(str(tmp_path / "log"), header=True)
    assert [r["file"] for r in got.orderBy(F.col("seq").cast("int")).collect()] == list("abcde")
    assert sorted(int(r["seq"]) for r in got.collect()) == [0, 1, 2, 3, 4]
    os.makedirs(tmp_path / "plain")
    for i in range(2):
        (tmp_path / f"plain/{i}.csv").write_text("date,symbol,file,bytes,sha256,source_checksum_ok\n2026-07-24,A,f,1,x,1\n")
    with pytest.raises(ValueError, match="several files"):
        archives.read_manifest(spark, str(tmp_path / "plain"))


# Published thresholds, draws, carried state, stored candidates


def test_published_thresholds_must_be_the_frozen_ones(spark, tmp_path):
    rows = [(f, 0.8, t) for f, t in constants.STAR.items()] + [(f, 0.5, 0.1) for f in constants.STAR]
    good = spark.createDataFrame(rows, "frequency string, fraction double, threshold double")
    assert {r["frequency"]: r["verified"] for r in model.verify_thresholds(good).collect()} == dict.fromkeys(constants.STAR, True)
    for f, wrong in (("25S", [("25S", 0.8, constants.STAR["25S"])]), ("5S", [("5S", 0.8 + 1e-9, 0.3)])):
        bad = spark.createDataFrame(rows + wrong, "frequency string, fraction double, threshold double")  # twice, or another one beside it
        assert [r["frequency"] for r in model.verify_thresholds(bad).where("not verified").collect()] == [f]
    near = spark.createDataFrame([(f, 0.8, t + 2e-12) for f, t in constants.STAR.items()], "frequency string, fraction double, threshold double")
    assert model.verify_thresholds(near).where("verified").count() == 0
    (tmp_path / "p.csv").write_text("frequency,fraction,tau_star\n25S,0.80," + repr(constants.STAR["25S"]) + "\n5S,0.8,0.5\n")
    assert analysis.unverified(spark, str(tmp_path / "p.csv"), ["25S", "15S", "5S"]) == ["15S", "5S"]


def test_values_are_close_by_absolute_or_relative_distance(spark):
    got = spark.createDataFrame([(1.0, 1.0 + 1e-5), (1.0, 1.00003), (0.0, 1e-9), (0.0, 1e-7), (1e6, 1e6 + 5)], "a double, b double").select(numeric.close_to(F.col("b"), F.col("a")).alias("c"), numeric.close_to(F.col("a"), 1.0).alias("one")).collect()
    assert [r["c"] for r in got] == [bool(np.isclose(b, a)) for a, b in [(1.0, 1.0 + 1e-5), (1.0, 1.00003), (0.0, 1e-9), (0.0, 1e-7), (1e6, 1e6 + 5)]]
    assert [r["one"] for r in got] == [True, True, False, False, False]


@pytest.mark.parametrize("n", [7, 30, 500])
def test_draws_are_those_of_their_generators(spark, n):
    rows = spark.createDataFrame([(f"s{i % 40:02d}", i) for i in range(200)], "symbol string, id int")
    ordered = sorted((f"s{i % 40:02d}", i) for i in range(200))
    take = lambda generator: [(r["symbol"], r["id"]) for r in builds.sample_rows(rows.repartition(5), ["symbol", "id"], n=n, seed=20260723, generator=generator).orderBy("sample_id").collect()]
    assert take("python") == random.Random(20260723).sample(ordered, min(n, 200))
    assert take("numpy") == [ordered[p] for p in sorted(np.random.default_rng(20260723).choice(200, size=min(n, 200), replace=False))]
    assert len(take("md5")) == min(n, 200)
    assert builds.sample_rows(rows.limit(0), ["symbol"], n=n, seed=1, generator="numpy").count() == 0
    with pytest.raises(ValueError, match="unknown generator"):
        builds.sample_rows(rows, ["symbol"], n=n, seed=1, generator="dice")


def test_a_day_starts_from_the_carried_alert(spark):
    at = lambda h, m: dt.datetime(2026, 8, 2) + dt.timedelta(hours=h, minutes=m)
    hits = spark.createDataFrame([("A", "z", "", t, 5.0) for t in (at(-1, 0), at(0, 10), at(0, 21), at(0, 40), at(24, 0))] + [("B", "z", "", at(0, 10), 5.0)], "pair string, detector string, frequency string, ts_utc timestamp_ntz, score double")
    carried = spark.createDataFrame([("A", "z", "", at(-1, 50)), ("C", "z", "", at(0, 0))], "pair string, detector string, frequency string, last timestamp_ntz")
    got = detectors.on_day(hits, "2026-08-02", carried=carried).collect()
    assert sorted((r["pair"], r["ts_utc"]) for r in got) == [("A", at(0, 21)), ("B", at(0, 10))]
    assert sorted((r["pair"], r["ts_utc"]) for r in detectors.on_day(hits, "2026-08-02").collect()) == [("A", at(0, 10)), ("A", at(0, 40)), ("B", at(0, 10))]


def test_candidates_come_back_with_an_empty_frequency(spark, tmp_path):
    rows = spark.createDataFrame([("A", dt.datetime(2026, 8, 1), "volume_zscore", "", 2.5, "2026-08-01"), ("A", dt.datetime(2026, 8, 1), "upstream_rf", "5S", 0.5, "2026-08-01")], "pair string, ts_utc timestamp_ntz, detector string, frequency string, score double, day string")
    sinks.write_candidates(rows, str(tmp_path / "c"))
    assert sorted(map(tuple, archives.read_candidates(spark, str(tmp_path / "c")).collect())) == sorted(map(tuple, rows.collect()))
    days = spark.createDataFrame([(day("2026-08-01"),), (day("2026-08-02"),)], "day date")
    assert [str(r["day"]) for r in sinks.requeue(days, "2026-08-01").collect()] == ["2026-08-02"]
