"""Scalars, grids, features, cooldown and detectors."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil import constants
from vigil.functions import numeric
from vigil.operators import cooldown, detectors, features, timegrid

T0 = dt.datetime(2026, 7, 24)
SEC = lambda n: T0 + dt.timedelta(seconds=n)


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_constants():
    assert constants.ROLLING_CHUNKS == {"25S": 900, "15S": 900, "5S": 700}
    assert (constants.COOLDOWN_SECONDS, constants.Z_THRESHOLD, constants.JUMP_THRESHOLD) == (1800, 4.0, 0.05)
    assert constants.STAR["5S"] == 0.3382249603958512 and len(constants.FEATURES) == 12


def test_scalars(spark):
    df = spark.createDataFrame([(1784851201,), (1784851201570,), (1784851201570704,), (1784851201570704000,)], "v long")
    got = values(df, numeric.epoch_unit(F.col("v")), numeric.epoch_to_timestamp(F.col("v")))
    assert [u for u, _ in got] == ["s", "ms", "us", "ns"]
    assert [t.microsecond for _, t in got] == [0, 570000, 570000, 570000]
    df = spark.createDataFrame([(0.0005, 1.0, 0.0), (0.0015, 0.0, 0.0), (-0.0001, 2.0, 1.0), (float("inf"), -1.0, 0.0)], "x double, a double, b double")
    got = values(df, numeric.round_even(F.col("x")), numeric.relative_change(F.col("a"), F.col("b")), numeric.finite(F.col("x")))
    assert got == [(0.0, math.inf, True), (0.002, None, True), (0.0, 1.0, True), (math.inf, -math.inf, False)]
    assert math.copysign(1, got[2][0]) == 1
    df = spark.createDataFrame([(" btc, eth ,BTC,,",)], "s string")
    assert values(df, numeric.symbol_list(F.col("s"))) == [(["BTC", "ETH"],)]
    df = spark.createDataFrame([(x,) for x in ("True", "1", " t ", "YES", "no", "0")], "s string")
    assert [r[0] for r in values(df, numeric.flag(F.col("s")))] == [True] * 4 + [False] * 2


def _trades(spark, spec):
    """spec: (chunk, offset in ms, price, quote volume, side) of 25-second chunks."""
    rows = [("A", T0 + dt.timedelta(seconds=25 * c, milliseconds=ms), float(p), float(q), side) for c, ms, p, q, side in spec]
    return spark.createDataFrame(rows, "pair string, ts timestamp_ntz, price double, quote_volume double, side string")


def _varied(n):
    for c in range(n):
        for j in range(c % 3 + 1):
            price = 1 + 0.05 * c + 0.01 * j
            yield c, 0 if c % 2 == 0 else 100 * j, price, price * (5 + c + 2 * j), "buy"


def test_feature_matrix_against_plain_python(spark):
    spec = list(_varied(14))
    own = _trades(spark, spec + [(c, 900, 999.0, 1000.0, "sell") for c in range(14)])
    got = {r["date"]: r for r in features.feature_matrix(own, 25, 3, price_size=3, digits=None).collect()}
    by = [[x for x in spec if x[0] == c] for c in range(14)]
    rush = [sum(1.0 for t in {x[1] for x in ch} if sum(x[1] == t for x in ch) > 1) for ch in by]
    series = {"rush": rush, "n": [len(ch) for ch in by], "v": [sum(x[3] for x in ch) for ch in by], "m": [np.mean([x[2] for x in ch]) for ch in by], "h": [max(x[2] for x in ch) for ch in by]}
    roll = lambda k, what: [None if i < 2 else (np.std(series[k][i - 2 : i + 1], ddof=1) if what == "s" else np.mean(series[k][i - 2 : i + 1])) for i in range(14)]
    parts = {"std_rush_order": ("rush", "s"), "avg_rush_order": ("rush", "m"), "std_trades": ("n", "s"), "std_volume": ("v", "s"), "avg_volume": ("v", "m"), "std_price": ("m", "s"), "avg_price": ("m", "m"), "avg_price_max": ("h", "m")}
    seen = 0
    for i in range(3, 14):
        expected = {}
        for name, (k, what) in parts.items():
            now, before = roll(k, what)[i], roll(k, what)[i - 1]
            expected[name] = None if now == before == 0 else math.inf if before == 0 else now / before - 1
        if None in expected.values():
            assert SEC(25 * i) not in got
            continue
        seen += 1
        for name, x in expected.items():
            assert got[SEC(25 * i)][name] == pytest.approx(x, abs=1e-9), name
        assert got[SEC(25 * i)]["minute_cos"] == pytest.approx(math.cos(2 * math.pi * SEC(25 * i).minute / 59))
    assert seen == len(got) > 5


def test_chunk_without_volume_ends_the_job(spark):
    own = _trades(spark, [(c, 0, 1.0, 0.0 if c == 6 else 1.0, "buy") for c in range(12)])
    with pytest.raises(Exception, match="no volume"):
        timegrid.chunks(own, 25).collect()


def test_nonfinite_rows_are_counted(spark):
    rows = [tuple([x] + [0.1] * 11) for x in (math.inf, -math.inf, math.nan, 0.1, 0.1)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in constants.FEATURES))
    assert tuple(features.count_nonfinite(df).first()) == (3, 2) and features.drop_nonfinite(df).count() == 2


def test_warmup_needs_an_unbroken_run_of_days(spark):
    rows = [("A", T0 + dt.timedelta(days=d, hours=h), 1.0, 1.0, "buy") for d in (0, 1, 3, 4) for h in (0, 1)]
    own = spark.createDataFrame(rows, "pair string, ts timestamp_ntz, price double, quote_volume double, side string")
    days = own.select("pair", F.to_date("ts").alias("day"))
    got = [r["bin"] for r in features.scorable(own, days, 3600, 2).orderBy("bin").collect()]
    assert got == [T0 + dt.timedelta(days=d, hours=h) for d in (1, 4) for h in (0, 1)]
    assert features.scorable(own, days, 3600, 2, warmup_days=0).count() == 0


def _bars(spark, closes, volumes=None, step=60):
    volumes = volumes or [100.0] * len(closes)
    rows = [("A", SEC(step * i), float(c), float(c), float(c), float(c), float(v), SEC(step * i).date()) for i, (c, v) in enumerate(zip(closes, volumes, strict=True)) if c is not None]
    return spark.createDataFrame(rows, "pair string, open_time timestamp_ntz, open double, high double, low double, close double, quote_volume double, day date")


def test_grid_fills_gaps_within_the_day(spark):
    bars = _bars(spark, [None, 2.0, 2.0, None, 3.0]).drop("day")
    spine = spark.createDataFrame([("A", SEC(60 * i), T0.date()) for i in range(6)], "pair string, open_time timestamp_ntz, day date")
    got = values(timegrid.complete_grid(bars, spine, day=F.col("day")).orderBy("open_time"), "close", "high", "quote_volume", "filled")
    assert got == [(None, None, 0.0, True), (2.0, 2.0, 100.0, False), (2.0, 2.0, 100.0, False), (2.0, 2.0, 0.0, True), (3.0, 3.0, 100.0, False), (3.0, 3.0, 0.0, True)]
    with pytest.raises(Exception, match="twice"):
        timegrid.complete_grid(bars.union(bars), spine, day=F.col("day")).collect()


def _hits(spark, offsets, scores=None):
    rows = [("A", SEC(o), float(s)) for o, s in zip(offsets, scores or range(len(offsets)), strict=True)]
    return spark.createDataFrame(rows, "pair string, ts_utc timestamp_ntz, score double")


@pytest.mark.parametrize(("offsets", "kept"), [((0, 600, 1799, 1800, 1860, 3600, 3601), (0, 1800, 3600)), ((1800, 0, 600), (0, 1800)), ((), ()), ((0, 1200, 2400), (0, 2400)), ((5, 5, 5), (5,))])
def test_cooldown_cases(spark, offsets, kept):
    got = cooldown.apply_cooldown(_hits(spark, offsets), ["pair"])
    assert sorted(r["ts_utc"] for r in got.collect()) == [SEC(k) for k in kept]


def test_cooldown_carries_over_midnight(spark):
    late = T0 + dt.timedelta(hours=23, minutes=50)
    hits = spark.createDataFrame([("A", late + dt.timedelta(minutes=m), 1.0) for m in (20, 31)], "pair string, ts_utc timestamp_ntz, score double")
    carried = spark.createDataFrame([("A", late)], "pair string, last timestamp_ntz")
    assert [r["ts_utc"].minute for r in cooldown.apply_cooldown(hits, ["pair"], carried=carried).collect()] == [21]


def test_cooldown_against_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(f"p{p}", SEC(int(t)), float(i)) for p in range(6) for i, t in enumerate(np.cumsum(rng.integers(1, 900, 150)))]
    hits = spark.createDataFrame(rows, "pair string, ts_utc timestamp_ntz, score double")
    expected = set()
    for p in {r[0] for r in rows}:
        last = None
        for _, t, _ in sorted(r for r in rows if r[0] == p):
            if last is None or (t - last).total_seconds() >= 1800:
                expected.add((p, t))
                last = t
    kept = cooldown.apply_cooldown(hits, ["pair"])
    assert {(r["pair"], r["ts_utc"]) for r in kept.collect()} == expected
    assert sum(r["kept"] for r in cooldown.count_kept(hits, ["pair"]).collect()) == len(expected)
    audit = cooldown.gap_audit(kept, ["pair"]).collect()
    assert all(r["respected"] for r in audit) and min(r["shortest_gap"] for r in audit) >= 1800


def test_zscore_against_numpy_and_scopes(spark):
    v = np.random.default_rng(7).integers(80, 120, 400).astype(float)
    bars = _bars(spark, [1.0] * 400, v.tolist())
    got = {r["open_time"]: r["score"] for r in detectors.volume_zscore(bars, trail_rows=300).collect()}
    v5 = np.array([np.nan] * 4 + [v[i - 4 : i + 1].sum() for i in range(4, 400)])
    for i in range(400):
        trail = v5[max(0, i - 300) : i]
        want = None if i < 304 else (v5[i] - trail.mean()) / trail.std(ddof=1)
        assert got[SEC(60 * i)] == (None if want is None else pytest.approx(want, rel=1e-10)), i
    day = _bars(spark, [1.0] * 1440, np.random.default_rng(1).integers(1, 9, 1440).astype(float).tolist())
    assert detectors.volume_zscore(day, scope="day").where("score is not null").count() == 0
    assert detectors.volume_zscore(_bars(spark, [1.0] * 60), trail_rows=20).where("score is not null").count() == 0
    with pytest.raises(ValueError, match="scope"):
        detectors.volume_zscore(day, scope="week")


def test_price_jump_is_strict(spark):
    closes = [1.0] * 14 + [1.06] + [1.06] * 4 + [1.06 * 1.049]
    fired = detectors.above(detectors.price_jump(_bars(spark, closes)), 0.05)
    assert [r["open_time"] for r in fired.orderBy("open_time").collect()][0] == SEC(60 * 14)
    assert SEC(60 * 19) not in [r["open_time"] for r in fired.collect()]
    edge = spark.createDataFrame([(4.0,), (float("nan"),), (None,), (4.1,)], "score double")
    assert detectors.above(edge, 4.0).count() == 1 and detectors.above(edge, 4.0, inclusive=True).count() == 2


def test_forest_episodes_per_threshold(spark):
    rows = [("A", SEC(600 * i), s) for i, s in enumerate((0.9, 0.9, 0.9, 0.6, 0.2, 0.9))]
    found = detectors.candidates(spark.createDataFrame(rows, "pair string, ts timestamp_ntz, score double"), "upstream_rf", ts="ts", frequency="25S")
    made = detectors.episodes(found, detectors.forest_thresholds("25S"), inclusive=True, seconds_available=25)
    by = {}
    for r in made.collect():
        by.setdefault(r["threshold_label"], []).append((r["ts_utc"] - T0).seconds // 60)
        assert r["ts_available_utc"] - r["ts_utc"] == dt.timedelta(seconds=25)
    assert {k: sorted(v) for k, v in by.items()} == {"tau_anchor": [0, 30], "tau_star": [0, 50]}
    assert tuple(made.columns) == constants.EPISODE_COLUMNS
