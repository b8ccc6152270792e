"""Every operator over the driver's tables, and the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigil.functions import numeric
from vigil.operators import bootstrap, builds, cooldown, detectors, features, manifest as logs, model, signatures, timegrid, universe as members, workload
from vigil.plans import sql
from vigil.plans.tables import COOLDOWN_DAYS, DAY, JUMP_HIT, Z_HIT, alerts, brand_bars, daily_bars, daily_grid, hits, manifest, table, trades, universe, weeks
from vigil.sources.shared import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SIX_HOURS = 21_600
CURVE = (0.5, 1.0, 1.5, 2.0, 3.0, 5.0, 50.0)
RULES = (("a", 0.10, 1.5, 0.5, 5, 20), ("b", 0.25, 2.0, 0.4, 5, 20), ("c", 0.05, 1.2, 0.6, 10, 20), ("d", 0.10, 1.5, 0.3, 10, 30))
TRAIL, TODAY = 60, "1997-01-10"


def query(text: str | None = None) -> Callable[[Query], Query]:
    def add(work: Query) -> Query:
        QUERIES[work.__name__] = work
        if text:
            SQL[work.__name__] = text
        return work

    return add


def _day(column: str = "ts_utc") -> F.Column:
    return F.date_format(column, "yyyy-MM-dd")


def _six(column: str) -> F.Column:
    return F.round(column, 6)


# Time bins and features


@query(f"WITH {sql.BINS} SELECT pair, bin::varchar AS bin, trade_count, volume_sum, round(price_mean, 6) AS price_mean, price_max FROM bins")
def time_bin_agg(spark, sf):
    return timegrid.bin_trades(trades(spark, sf), SIX_HOURS).select("pair", F.date_format("bin", "yyyy-MM-dd HH:mm:ss").alias("bin"), "trade_count", "volume_sum", _six("price_mean").alias("price_mean"), "price_max")


@query(f"WITH {sql.BINS} SELECT pair, bin::varchar AS bin, rush_sum FROM rush")
def rush_order(spark, sf):
    found = timegrid.rush_orders(trades(spark, sf), SIX_HOURS, same=F.date_trunc("hour", "ts"))
    return found.select("pair", F.date_format("bin", "yyyy-MM-dd HH:mm:ss").alias("bin"), "rush_sum")


@query(f"WITH {sql.BINS} SELECT pair, count(*) AS chunks FROM bins GROUP BY pair")
def nonempty_chunks(spark, sf):
    return timegrid.nonempty_bins(trades(spark, sf), SIX_HOURS)


_PARTS = (("std_rush_order", "rush_sum", 5, "std"), ("avg_rush_order", "rush_sum", 5, "avg"), ("std_trades", "trade_count", 5, "std"), ("std_volume", "volume_sum", 5, "std"), ("avg_volume", "volume_sum", 5, "avg"), ("std_price", "price_mean", 5, "std"), ("avg_price", "price_mean", 3, "avg"), ("avg_price_max", "price_max", 3, "avg"))


def _rolled(name: str, x: str, n: int, what: str) -> str:
    value = f"avg({x}) OVER w{n}" if what == "avg" else f"CASE WHEN max({x}) OVER w{n} = min({x}) OVER w{n} THEN 0 ELSE stddev_samp({x}) OVER w{n} END"
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN {value} END AS {name}"


def _changed(name: str) -> str:
    p = f"lag({name}) OVER w"
    return f"CASE WHEN {p} = 0 AND {name} = 0 THEN NULL WHEN {p} = 0 THEN 'inf'::double * sign({name}) ELSE {name} / {p} - 1 END AS {name}"


_MATRIX = (
    f"WITH {sql.BINS}, rolled AS (SELECT pair, bin, {', '.join(_rolled(*p) for p in _PARTS)} FROM bins JOIN rush USING (pair, bin)"
    " WINDOW w5 AS (PARTITION BY pair ORDER BY bin ROWS 4 PRECEDING), w3 AS (PARTITION BY pair ORDER BY bin ROWS 2 PRECEDING)),"
    f" changed AS (SELECT pair, bin, {', '.join(_changed(p[0]) for p in _PARTS)} FROM rolled WINDOW w AS (PARTITION BY pair ORDER BY bin)),"
    f" complete AS (SELECT * FROM changed WHERE {' AND '.join(f'{p[0]} IS NOT NULL' for p in _PARTS)})"
)
_ROUND = lambda x, name: f"round_even(({x}) * 1000, 0) / 1000 + 0.0 AS {name}"
_CYCLES = (("sin(2 * pi() * hour(bin) / 23.0)", "hour_sin"), ("cos(2 * pi() * hour(bin) / 23.0)", "hour_cos"), ("sin(2 * pi() * minute(bin) / 59.0)", "minute_sin"), ("cos(2 * pi() * minute(bin) / 59.0)", "minute_cos"))
_FINITE = " AND ".join(f"isfinite({p[0]})" for p in _PARTS)


def _matrix(spark, sf):
    return features.feature_matrix(trades(spark, sf), SIX_HOURS, 5, price_size=3, same=F.date_trunc("hour", "ts"))


@query(f"{_MATRIX} SELECT pair, bin::varchar AS date, {', '.join(_ROUND(p[0], p[0]) for p in _PARTS)}, {', '.join(_ROUND(*c) for c in _CYCLES)} FROM complete WHERE {_FINITE}")
def rolling_feature_matrix(spark, sf):
    return features.drop_nonfinite(_matrix(spark, sf)).withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss"))


@query(f"{_MATRIX} SELECT count(*) FILTER (NOT ({_FINITE})) AS dropped, count(*) FILTER ({_FINITE}) AS kept FROM complete")
def nonfinite_drop(spark, sf):
    return features.count_nonfinite(_matrix(spark, sf))


@query(
    f"WITH {sql.BINS}, days AS (SELECT DISTINCT pair, ts::date AS day FROM trades), runs AS (SELECT pair, day, sum(new) OVER (PARTITION BY pair ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM ("
    "SELECT pair, day, CASE WHEN day - lag(day) OVER (PARTITION BY pair ORDER BY day) = 1 THEN 0 ELSE 1 END AS new FROM days)),"
    " firsts AS (SELECT b.pair, bin, r.day, lag(r.day, 3) OVER (PARTITION BY b.pair, run ORDER BY bin) AS first FROM bins b JOIN runs r ON b.pair = r.pair AND b.bin::date = r.day)"
    " SELECT pair, bin::varchar AS bin FROM firsts WHERE day - first <= 14"
)
def warmup_scorable(spark, sf):
    own = trades(spark, sf)
    days = own.select("pair", F.to_date("ts").alias("day")).distinct()
    return features.scorable(own, days, SIX_HOURS, 3).select("pair", F.date_format("bin", "yyyy-MM-dd HH:mm:ss").alias("bin"))


@query(f"WITH {sql.TRADES} SELECT event_id, " + ", ".join(f"round({e.replace('bin', 'ts')}, 9) + 0.0 AS {n}" for e, n in _CYCLES) + " FROM trades")
def cyclical_time(spark, sf):
    hour, minute = numeric.cycle(F.hour("ts"), 23), numeric.cycle(F.minute("ts"), 59)
    return trades(spark, sf).select("event_id", *((F.round(c, 9) + F.lit(0.0)).alias(n) for c, n in zip((*hour, *minute), ("hour_sin", "hour_cos", "minute_sin", "minute_cos"), strict=True)))


_EPOCH = "(epoch_us(ts) * 1000) // (CASE event_id % 4 WHEN 0 THEN 1000000000 WHEN 1 THEN 1000000 WHEN 2 THEN 1000 ELSE 1 END)"


def _epoch() -> F.Column:
    """The time of an event as a number, in a unit that its id decides."""
    by = F.element_at(F.array(*(F.lit(10**p) for p in (9, 6, 3, 0))), (F.col("event_id") % 4 + 1).cast("int"))
    nanos = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return ((nanos - F.pmod(nanos, by)).cast("decimal(20,0)") / by).cast("long")


@query(
    f"SELECT event_id, CASE WHEN v >= 100000000000000000 THEN 'ns' WHEN v >= 100000000000000 THEN 'us' WHEN v >= 100000000000 THEN 'ms' ELSE 's' END AS unit,"
    " (CASE event_id % 4 WHEN 0 THEN v * 1000 WHEN 1 THEN v WHEN 2 THEN v // 1000 ELSE v // 1000000 END) AS millis"
    f" FROM (SELECT event_id, {_EPOCH} AS v FROM events)"
)
def epoch_units(spark, sf):
    rows = table(spark, sf, "events").select("event_id", _epoch().alias("v"))
    return rows.select("event_id", numeric.epoch_unit(F.col("v")).alias("unit"), F.unix_millis(numeric.epoch_to_timestamp(F.col("v")).cast("timestamp")).alias("millis"))


# Grids and detectors


@query(f"WITH {sql.GRID} SELECT pair, day::varchar AS day, quote_volume, close, CASE WHEN filled THEN close ELSE op END AS open, CASE WHEN filled THEN close ELSE hi END AS high, CASE WHEN filled THEN close ELSE lo END AS low, filled FROM grid")
def gap_fill_grid(spark, sf):
    return daily_grid(spark, sf).select("pair", F.col("open_time").cast("string").alias("day"), "quote_volume", "close", "open", "high", "low", "filled")


@query(f"WITH {sql.GRID} SELECT pair, count(*) AS minutes, count(*) FILTER (filled) AS filled_minutes, min(day)::varchar AS first_time, max(day)::varchar AS last_time, 0 AS repeated FROM grid GROUP BY pair")
def bar_coverage(spark, sf):
    out = logs.bar_coverage(daily_grid(spark, sf), daily_bars(spark, sf))
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_time", "last_time")})


@query(f"WITH {sql.SCORED} SELECT pair, day::varchar AS day, round(score, 6) AS score FROM zs")
def zscore_daily(spark, sf):
    return detectors.volume_zscore(daily_grid(spark, sf), sum_rows=1, trail_rows=7).select("pair", F.col("open_time").cast("string").alias("day"), _six("score").alias("score"))


@query(f"WITH {sql.SCORED} SELECT pair, day::varchar AS day, round(score, 6) AS score FROM js")
def price_jump(spark, sf):
    return detectors.price_jump(daily_grid(spark, sf), rows=1).select("pair", F.col("open_time").cast("string").alias("day"), _six("score").alias("score"))


@query(f"WITH RECURSIVE {sql.ALERTS} SELECT pair, detector, day::varchar AS day, round(score, 6) AS score FROM alerts")
def cooldown_alerts(spark, sf):
    return alerts(spark, sf).select("pair", "detector", "day", _six("score").alias("score"))


@query(
    f"WITH RECURSIVE {sql.SCORED}, levels AS (SELECT * FROM (VALUES ('low', 1.0), ('high', 2.0)) t(threshold_label, threshold)), marked AS (SELECT z.pair, z.day, z.score, threshold_label, threshold FROM zs z JOIN levels ON score >= threshold),"
    " kept AS (SELECT pair, threshold_label, min(day) AS day FROM marked GROUP BY ALL UNION ALL SELECT m.pair, m.threshold_label, min(m.day) FROM kept k JOIN marked m ON m.pair = k.pair AND m.threshold_label = k.threshold_label AND m.day >= k.day + 3 GROUP BY m.pair, m.threshold_label, k.day)"
    " SELECT pair, 'upstream_rf' AS detector, '25S' AS frequency, threshold_label, threshold::double AS threshold, day::varchar AS day, round(score, 6) AS score, strftime(day + INTERVAL 25 SECOND, '%Y-%m-%d %H:%M:%S') AS available FROM kept JOIN marked USING (pair, threshold_label, day)"
)
def labelled_episodes(spark, sf):
    scored = detectors.volume_zscore(daily_grid(spark, sf), sum_rows=1, trail_rows=7).withColumn("ts", F.col("open_time").cast("timestamp_ntz"))
    found = detectors.candidates(scored, "upstream_rf", ts="ts", frequency="25S")
    out = detectors.episodes(found, {"low": 1.0, "high": 2.0}, inclusive=True, seconds_available=25, cooldown=COOLDOWN_DAYS * DAY)
    return out.select("pair", "detector", "frequency", "threshold_label", "threshold", "day", _six("score").alias("score"), F.date_format("ts_available_utc", "yyyy-MM-dd HH:mm:ss").alias("available"))


@query(f"WITH {sql.SCORED} SELECT pair, detector, '' AS frequency, day::varchar AS day, round(score, 6) AS score FROM scored WHERE score > CASE detector WHEN 'volume_zscore' THEN 2.0 ELSE 0.01 END")
def candidates_floor(spark, sf):
    grid = daily_grid(spark, sf).withColumn("ts", F.col("open_time").cast("timestamp_ntz"))
    both = detectors.candidates(detectors.volume_zscore(grid, sum_rows=1, trail_rows=7), "volume_zscore", ts="ts").unionByName(detectors.candidates(detectors.price_jump(grid, rows=1), "price_jump", ts="ts"))
    return both.select("pair", "detector", "frequency", "day", _six("score").alias("score"))


@query(f"WITH RECURSIVE {sql.ALERTS} SELECT pair, detector, count(*) AS alerts, min(gap) * 86400.0 AS shortest_gap, coalesce(bool_and(gap >= 3), true) AS respected FROM (SELECT *, day - lag(day) OVER (PARTITION BY pair, detector ORDER BY day) AS gap FROM alerts) GROUP BY pair, detector")
def cooldown_gap_audit(spark, sf):
    return cooldown.gap_audit(alerts(spark, sf), ["pair", "detector"], seconds=COOLDOWN_DAYS * DAY)


@query(f"WITH RECURSIVE {sql.ALERTS} SELECT count(*) AS episodes, bool_and(score > 0.5) AS above_threshold, bool_and(day IS NOT NULL) AS timed, bool_and(detector IN ('volume_zscore', 'price_jump')) AS known_detectors FROM alerts")
def structural_facts(spark, sf):
    score = F.col("score")
    return alerts(spark, sf).agg(F.count("*").alias("episodes"), F.bool_and(score > 0.5).alias("above_threshold"), F.bool_and(F.col("ts_utc").isNotNull()).alias("timed"), F.bool_and(F.col("detector").isin("volume_zscore", "price_jump")).alias("known_detectors"))


@query(
    f"WITH RECURSIVE {sql.ALERTS} SELECT count(*) AS rows, true AS timed, true AS known_detector, bool_and(score >= CASE detector WHEN 'volume_zscore' THEN 1.5 ELSE 0.5 END) AS above_threshold, true AS available_later, bool_and(coalesce(gap >= 3, true)) AS respected"
    " FROM (SELECT *, day - lag(day) OVER (PARTITION BY pair, detector ORDER BY day) AS gap FROM alerts)"
)
def observed_validation(spark, sf):
    threshold = F.when(F.col("detector") == "volume_zscore", Z_HIT).otherwise(JUMP_HIT)
    made = alerts(spark, sf).withColumns({"threshold": threshold, "ts_available_utc": F.col("ts_utc") + F.expr("interval 60 seconds")})
    return builds.validate_once(made, ["pair", "detector"], seconds=COOLDOWN_DAYS * DAY)


# Endpoints

_STREAM = "detector, '' AS frequency, 'fixed' AS threshold_label"


def _days(spark, sf):
    return daily_bars(spark, sf).select(F.col("open_time").alias("day")).distinct()


_PER_DAY = f"WITH RECURSIVE {sql.ALERTS}, days AS (SELECT DISTINCT day FROM d), per_day AS (SELECT s.detector, x.day, count(a.pair) AS alerts FROM (SELECT DISTINCT detector FROM alerts) s CROSS JOIN days x LEFT JOIN alerts a ON a.detector = s.detector AND a.day = x.day GROUP BY ALL)"


@query(f"{_PER_DAY} SELECT {_STREAM}, day::varchar AS day, alerts FROM per_day")
def alerts_per_day(spark, sf):
    return workload.alerts_per_day(alerts(spark, sf), _days(spark, sf))


@query(
    f"{_PER_DAY} SELECT {_STREAM}, count(*) AS n_days, round(avg(alerts), 6) AS mean, round(stddev_samp(alerts), 6) AS sd, min(alerts) AS min, quantile_cont(alerts, 0.25) AS p25, quantile_cont(alerts, 0.5) AS median,"
    " quantile_cont(alerts, 0.75) AS p75, round(quantile_cont(alerts, 0.9), 6) AS p90, max(alerts) AS max, sum(alerts)::bigint AS total FROM per_day GROUP BY detector"
)
def alerts_distribution(spark, sf):
    out = workload.distribution(workload.alerts_per_day(alerts(spark, sf), _days(spark, sf)))
    return out.withColumns({c: _six(c) for c in ("mean", "sd", "p90")})


@query(f"WITH RECURSIVE {sql.ALERTS}, h AS (SELECT 24.0 * count(*) AS hours FROM grid) SELECT {_STREAM}, count(*) AS alerts, hours::double AS pair_hours, round(count(*) * 1000.0 / hours, 6) AS rate FROM alerts, h GROUP BY detector, hours")
def rate_per_1000(spark, sf):
    return workload.rate_per_1000_hours(alerts(spark, sf), 24.0 * daily_grid(spark, sf).count()).withColumn("rate", _six("rate"))


@query(
    f"WITH RECURSIVE {sql.SCORED}, levels AS (SELECT unnest([{', '.join(map(str, CURVE))}])::double AS threshold), cand AS (SELECT * FROM hits), marked AS (SELECT c.pair, c.detector, c.day, threshold FROM cand c JOIN levels ON score >= threshold),"
    " kept AS (SELECT pair, detector, threshold, min(day) AS day FROM marked GROUP BY ALL UNION ALL SELECT m.pair, m.detector, m.threshold, min(m.day) FROM kept k JOIN marked m ON m.pair = k.pair AND m.detector = k.detector AND m.threshold = k.threshold AND m.day >= k.day + 3 GROUP BY m.pair, m.detector, m.threshold, k.day)"
    " SELECT s.detector, '' AS frequency, l.threshold, count(k.pair) AS alerts FROM (SELECT DISTINCT detector FROM cand) s CROSS JOIN levels l LEFT JOIN kept k ON k.detector = s.detector AND k.threshold = l.threshold GROUP BY s.detector, l.threshold"
)
def threshold_curve(spark, sf):
    levels = spark.createDataFrame([(x,) for x in CURVE], "threshold double")
    return workload.threshold_curve(hits(spark, sf).withColumn("frequency", F.lit("")), levels, seconds=COOLDOWN_DAYS * DAY)


_ENDS = "SELECT detector, ceil(min(round(score, 6)) / 0.05)::bigint AS lo, floor(max(round(score, 6)) / 0.05)::bigint AS hi FROM hits GROUP BY detector"


@query(
    f"WITH {sql.SCORED}, ends AS ({_ENDS}) SELECT detector, '' AS frequency, round(unnest(generate_series(lo, hi)) * 0.05, 10) AS threshold FROM ends"
    " UNION SELECT detector, '', unnest([0.5, 0.7036605405579714, 0.5059013502406946, 0.3382249603958512])::double FROM ends"
)
def threshold_grid(spark, sf):
    return workload.score_grid(hits(spark, sf).select("detector", F.lit("").alias("frequency"), _six("score").alias("score")))


@query(
    f"WITH RECURSIVE {sql.ALERTS}, s AS (SELECT DISTINCT detector FROM alerts), m AS (SELECT DISTINCT a.detector AS x, b.detector AS y, a.pair, a.day FROM alerts a JOIN alerts b ON a.pair = b.pair AND a.detector <> b.detector AND abs(a.day - b.day) <= 1)"
    " SELECT a.detector AS detector_a, '' AS frequency_a, 'fixed' AS threshold_label_a, b.detector AS detector_b, '' AS frequency_b, 'fixed' AS threshold_label_b, (SELECT count(*) FROM alerts t WHERE t.detector = a.detector) AS alerts,"
    " (SELECT count(*) FROM m WHERE m.x = a.detector AND m.y = b.detector) AS matched, round((SELECT count(*) FROM m WHERE m.x = a.detector AND m.y = b.detector) / (SELECT count(*) FROM alerts t WHERE t.detector = a.detector), 6) AS share FROM s a, s b WHERE a.detector <> b.detector"
)
def detector_agreement(spark, sf):
    return workload.agreement(alerts(spark, sf), seconds=DAY).withColumn("share", _six("share"))


_BY_PAIR = f"WITH RECURSIVE {sql.ALERTS}, c AS (SELECT p.pair, count(*) FILTER (a.detector = 'volume_zscore') AS z, count(*) FILTER (a.detector = 'price_jump') AS j, 720.0 AS hours FROM (SELECT DISTINCT pair FROM trades) p LEFT JOIN alerts a USING (pair) GROUP BY p.pair), n AS (SELECT *, row_number() OVER (ORDER BY pair) - 1 AS position, (SELECT count(*) FROM c) AS k FROM c)"
_DRAWS = "draws AS (SELECT b AS draw, ('0x' || substr(md5('20260722|' || b || '|' || i), 1, 8))::bigint % (SELECT count(*) FROM c) AS position FROM range(2000) t(b), (SELECT unnest(range((SELECT count(*) FROM c))) AS i))"


def _by_pair(spark, sf):
    found = alerts(spark, sf).groupBy("pair").agg(F.count_if(F.col("detector") == "volume_zscore").alias("z"), F.count_if(F.col("detector") == "price_jump").alias("j"))
    pairs = trades(spark, sf).select("pair").distinct().join(found, "pair", "left")
    return pairs.select("pair", F.coalesce("z", F.lit(0)).alias("z"), F.coalesce("j", F.lit(0)).alias("j"), F.lit(720.0).alias("hours"))


@query(
    f"{_BY_PAIR}, {_DRAWS}, s AS (SELECT draw, sum(z) AS z, sum(j) AS j, sum(hours) AS h FROM draws JOIN n USING (position) GROUP BY draw), v AS (SELECT 'z' AS stream, z * 1000.0 / h AS value FROM s UNION ALL SELECT 'j', j * 1000.0 / h FROM s)"
    " SELECT stream, round((SELECT sum(CASE v.stream WHEN 'z' THEN z ELSE j END) * 1000.0 / sum(hours) FROM c), 6) AS rate, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, count(*) AS n_draws FROM v GROUP BY stream"
)
def bootstrap_rate(spark, sf):
    out = bootstrap.bootstrap_ratio(_by_pair(spark, sf), "pair", ["z", "j"], "hours", generator="md5")
    return out.withColumns({c: _six(c) for c in ("rate", "low", "high")})


@query(f"{_BY_PAIR}, {_DRAWS}, s AS (SELECT draw, sum(z)::double / max(k) AS value FROM draws JOIN n USING (position) GROUP BY draw) SELECT round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, count(*) AS n_draws FROM s")
def bootstrap_mean(spark, sf):
    return bootstrap.bootstrap_mean(_by_pair(spark, sf), "pair", "z", generator="md5").withColumns({c: _six(c) for c in ("low", "high")})


@query()
def bootstrap_rate_numpy(spark, sf):
    return bootstrap.bootstrap_ratio(_by_pair(spark, sf), "pair", ["z", "j"], "hours")


@query()
def bootstrap_rate_tree(spark, sf):
    return bootstrap.bootstrap_ratio(_by_pair(spark, sf), "pair", ["z", "j"], "hours", generator="tree")


@query(
    f"WITH RECURSIVE {sql.ALERTS}, o AS (SELECT *, row_number() OVER (ORDER BY day, pair, detector) - 1 AS place FROM alerts), picked AS (SELECT * FROM o ORDER BY md5('20260722|' || place), place LIMIT 100)"
    " SELECT (row_number() OVER (ORDER BY place))::int AS sample_id, pair, day::varchar AS day, detector, '' AS verdict FROM picked"
)
def manual_sample(spark, sf):
    return bootstrap.draw_sample(alerts(spark, sf), generator="md5").select("sample_id", "pair", _day().alias("day"), "detector", "verdict")


# Ingestion and builds


@query(f"WITH {sql.UNIVERSE} SELECT symbol, rank FROM universe WHERE table_date = (SELECT max(table_date) FROM universe) AND rank > 50")
def latest_table(spark, sf):
    return members.included_symbols(members.latest_table(universe(spark, sf)))


_KNOWN = f"WITH {sql.MANIFEST}, expected AS (SELECT file, sha256, CASE WHEN seq % 5 = 0 THEN '' WHEN seq % 7 = 0 THEN 'other' ELSE sha256 END AS side FROM manifest WHERE status <> '404')"


@query(f"{_KNOWN} SELECT file, sha256, CASE WHEN side = '' THEN '' WHEN side = sha256 THEN '1' ELSE '0' END AS source_checksum_ok FROM expected")
def checksum_states(spark, sf):
    rows = manifest(spark, sf).where("status <> '404'").withColumn("key", F.col("seq"))
    files = rows.select("file", "sha256", "key")
    side = rows.where("seq % 5 <> 0").select("key", F.when(F.col("seq") % 7 == 0, "other").otherwise(F.col("sha256")).alias("published"))
    return logs.checksum_states(files, side, key="key").drop("key")


@query(f"WITH {sql.MONITORED} SELECT rule, day::varchar AS day, count(symbol) AS pairs, 24.0 * count(symbol) AS hours FROM (SELECT 'verified-archive' AS rule, day, symbol FROM weeks LEFT JOIN monitored USING (day) UNION ALL SELECT 'universe-membership', day, symbol FROM weeks LEFT JOIN governed USING (day)) GROUP BY ALL")
def denominators_by_day(spark, sf):
    tables = universe(spark, sf)
    return logs.denominators_by_day(_governed(spark, sf, tables=tables), logs.verified_pair_days(manifest(spark, sf)), weeks(spark, sf), monitored=_monitored(spark, sf, tables)).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {sql.MANIFEST} SELECT date::varchar AS date, count(*) AS rows FROM manifest WHERE date IN (DATE '1996-07-22', DATE '1997-03-03') GROUP BY date")
def excluded_rows(spark, sf):
    return logs.excluded_rows(manifest(spark, sf), ("1996-07-22", "1997-03-03")).withColumn("date", F.col("date").cast("string"))


_BUILDS = (
    f"WITH {sql.BINS}, b AS (SELECT pair AS symbol, bin::date AS day, bin, lag(bin::date, 5) OVER (PARTITION BY pair ORDER BY bin) AS first FROM bins),"
    " per AS (SELECT symbol, day, count(*) AS rows, count(*) FILTER (day - first <= 14) AS scorable FROM b GROUP BY ALL)"
)


@query(f"{_BUILDS} SELECT symbol, day::varchar AS day, rows AS n_rows_target_day, scorable AS n_rows_scored, scorable > 0 AS warmup_sufficient FROM per")
def build_log(spark, sf):
    out = builds.build_log(trades(spark, sf), SIX_HOURS, 5, warmup_days=14)
    return out.withColumn("day", F.col("day").cast("string")).select("symbol", "day", "n_rows_target_day", "n_rows_scored", "warmup_sufficient")


@query(
    f"{_BUILDS}, u AS (SELECT pair, ts::date AS day, arg_min(CASE WHEN v >= 100000000000000000 THEN 'ns' WHEN v >= 100000000000000 THEN 'us' WHEN v >= 100000000000 THEN 'ms' ELSE 's' END, (ts, event_id)) AS unit"
    f" FROM (SELECT pair, ts, event_id, {_EPOCH} AS v FROM trades) GROUP BY ALL)"
    " SELECT 'six hours' AS frequency, count(*) AS builds, sum(rows)::bigint AS n_rows_target_day, sum(scorable)::bigint AS n_rows_scored, max(rows) AS most_rows, bool_and(scorable > 0) AS all_sufficient, count(*) FILTER (scorable = 0) AS builds_without_rows,"
    " string_agg(DISTINCT unit, ',' ORDER BY unit) AS units FROM per JOIN u ON per.symbol = u.pair AND per.day = u.day"
)
def build_rollup(spark, sf):
    own = trades(spark, sf)
    first = F.min_by(numeric.epoch_unit(_epoch()), F.struct("ts", "event_id")).alias("unit")
    units = own.groupBy(F.col("pair").alias("symbol"), F.to_date("ts").alias("day")).agg(first)
    out = builds.with_units(builds.build_log(own, SIX_HOURS, 5, warmup_days=14), units).withColumn("frequency", F.lit("six hours"))
    return builds.rollup(out).select("frequency", "builds", "n_rows_target_day", "n_rows_scored", "most_rows", "all_sufficient", "builds_without_rows", "units")


@query(f"WITH {sql.SCORED}, f AS (SELECT pair, detector, min(day) AS day FROM hits WHERE day >= DATE '2024-01-15' AND day < DATE '2024-01-16' GROUP BY ALL) SELECT pair, detector, day::varchar AS day FROM f")
def target_day_episodes(spark, sf):
    own = hits(spark, sf).withColumns({"frequency": F.lit(""), "day": F.date_format("ts_utc", "yyyy-MM-dd")})
    return detectors.on_day(own, "2024-01-15").select("pair", "detector", "day")


@query("SELECT (row_number() OVER (ORDER BY place))::int AS sample_id, event_id FROM (SELECT * FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM events) ORDER BY md5('20260723|' || place), place LIMIT 30)")
def gate_events(spark, sf):
    return builds.sample_rows(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], n=30, seed=20260723).select("sample_id", "event_id")


@query()
def gate_events_python(spark, sf):
    """The same with the places of Python's random.sample."""
    events = table(spark, sf, "events").select("event_id", "ts")
    return builds.sample_rows(events, ["ts", "event_id"], n=30, seed=20260723, generator="python").select("sample_id", "event_id")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events")
def json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", numeric.json_fields(F.col("props"), "k bigint")["k"].alias("k"))


# Universe and manifests


@query(f"WITH {sql.UNIVERSE} SELECT table_date::varchar AS table_date, symbol, volume::double AS volume, rank, rank > 50 AS included FROM universe")
def universe_rank(spark, sf):
    return universe(spark, sf).select(F.col("table_date").cast("string").alias("table_date"), "symbol", F.col("volume").cast("double").alias("volume"), "rank", "included")


@query(f"WITH {sql.GOVERNED} SELECT day::varchar AS day, table_date::varchar AS table_date FROM governing")
def governing_table_asof(spark, sf):
    return members.governing_table(weeks(spark, sf), universe(spark, sf)).select(F.col("day").cast("string").alias("day"), F.col("table_date").cast("string").alias("table_date"))


_REINSTATED = {"reinstated": ("C1", "C2"), "last_defective": "1996-07-01"}


def _governed(spark, sf, tables=None, only=None):
    return members.governed(weeks(spark, sf), universe(spark, sf) if tables is None else tables, **_REINSTATED, only=only)


def _monitored(spark, sf, tables=None):
    return logs.monitored_of_days(weeks(spark, sf), universe(spark, sf) if tables is None else tables, logs.verified_pair_days(manifest(spark, sf)), **_REINSTATED)


@query(f"WITH {sql.GOVERNED} SELECT day::varchar AS day, symbol, rank FROM governed")
def governed_symbols(spark, sf):
    return _governed(spark, sf).select(F.col("day").cast("string").alias("day"), "symbol", "rank")


@query(f"WITH {sql.MONITORED} SELECT day::varchar AS day, symbol FROM monitored")
def monitored_pair_days(spark, sf):
    return _monitored(spark, sf).select(F.col("day").cast("string").alias("day"), "symbol")


_STRATA = f"WITH {sql.MONITORED}, strata AS (SELECT day, symbol, CASE WHEN rank IS NULL THEN NULL WHEN p <= round_even(n / 3.0, 0) THEN 1 WHEN p <= round_even(n * 2 / 3.0, 0) THEN 2 ELSE 3 END AS stratum FROM (SELECT *, count(rank) OVER (PARTITION BY day) AS n, row_number() OVER (PARTITION BY day ORDER BY rank NULLS LAST) AS p FROM governed))"


@query(f"{_STRATA} SELECT day::varchar AS day, symbol, stratum FROM strata")
def activity_tertiles(spark, sf):
    return _governed(spark, sf, tables=members.table_strata(universe(spark, sf))).select(F.col("day").cast("string").alias("day"), "symbol", "stratum")


def _order_alerts(spark, sf):
    """Large orders as alerts, by the week of the order."""
    week = F.to_date(F.date_trunc("week", "o_orderdate")).cast("string")
    return table(spark, sf, "orders").where("o_totalprice > 200000").select(F.concat(F.lit("C"), "o_custkey").alias("pair"), week.alias("day"), F.lit("large_order").alias("detector"), F.lit("").alias("frequency"), F.lit("fixed").alias("threshold_label"))


_ORDER_ALERTS = "oa AS (SELECT 'C' || o_custkey AS pair, date_trunc('week', o_orderdate)::date AS day FROM orders WHERE o_totalprice > 200000)"


@query(f"WITH {sql.MONITORED}, {_ORDER_ALERTS} SELECT pair, oa.day::varchar AS day, 'large_order' AS detector, '' AS frequency, 'fixed' AS threshold_label FROM oa SEMI JOIN monitored m ON m.day = oa.day AND m.symbol = oa.pair")
def restrict_to_monitored(spark, sf):
    return workload.restrict_to_monitored(_order_alerts(spark, sf), _monitored(spark, sf))


@query(
    f"{_STRATA}, {_ORDER_ALERTS}, names AS (SELECT unnest(['1', '2', '3', 'unassigned']) AS stratum), al AS (SELECT coalesce(s.stratum::varchar, 'unassigned') AS stratum, count(*) AS alerts FROM oa LEFT JOIN strata s ON s.day = oa.day AND s.symbol = oa.pair GROUP BY ALL),"
    " ho AS (SELECT coalesce(stratum::varchar, 'unassigned') AS stratum, 24.0 * count(*) AS hours FROM monitored LEFT JOIN strata USING (day, symbol) GROUP BY ALL)"
    " SELECT 'large_order' AS detector, '' AS frequency, 'fixed' AS threshold_label, stratum, coalesce(alerts, 0) AS alerts, coalesce(hours, 0)::double AS pair_hours, CASE WHEN hours > 0 THEN round(coalesce(alerts, 0) * 1000.0 / hours, 6) END AS rate FROM names LEFT JOIN al USING (stratum) LEFT JOIN ho USING (stratum)"
)
def stratified_rates(spark, sf):
    found, tables = _order_alerts(spark, sf), members.table_strata(universe(spark, sf))
    own = written(_monitored(spark, sf, tables))
    keys = found.select(F.to_date("day").alias("day"), F.col("pair").alias("symbol")).unionByName(own.select("day", "symbol"))
    return workload.stratified(found, _governed(spark, sf, tables=tables, only=keys), own).withColumn("rate", _six("rate"))


@query(f"WITH {sql.UNIVERSE} SELECT table_date::varchar AS table_date, count(*) AS total, count(*) FILTER (rank > 50) AS included_count FROM universe GROUP BY ALL")
def membership_sizes(spark, sf):
    return members.membership_sizes(universe(spark, sf)).withColumn("table_date", F.col("table_date").cast("string"))


@query(
    f"WITH {sql.UNIVERSE}, steps AS (SELECT table_date, lag(table_date) OVER (ORDER BY table_date) AS before FROM (SELECT DISTINCT table_date FROM universe)), old AS (SELECT s.table_date, symbol, rank AS old_rank FROM universe u JOIN steps s ON u.table_date = s.before),"
    " now AS (SELECT u.table_date, symbol, rank FROM universe u JOIN steps s ON u.table_date = s.table_date WHERE before IS NOT NULL)"
    " SELECT table_date::varchar AS table_date, count(*) FILTER (old_rank IS NULL) AS added, count(*) FILTER (rank IS NULL) AS dropped, count(*) FILTER (rank <> old_rank) AS moved FROM now FULL JOIN old USING (table_date, symbol) GROUP BY ALL"
)
def churn(spark, sf):
    return members.churn(universe(spark, sf)).withColumn("table_date", F.col("table_date").cast("string"))


@query("SELECT symbol, sum(volume)::double AS volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS r FROM (SELECT 'S' || l_suppkey AS symbol, l_shipdate::date AS day, sum(l_extendedprice::decimal(18,2)) AS volume FROM lineitem GROUP BY ALL)) WHERE r BETWEEN 2 AND 31 GROUP BY symbol")
def trailing_volume(spark, sf):
    daily = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("S"), "l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("day")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("volume"))
    return members.trailing_volume(daily).withColumn("volume", F.col("volume").cast("double"))


@query("SELECT 'C' || c_custkey AS symbol FROM customer WHERE c_acctbal > 0 AND c_nationkey % 3 = 0 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def eligible_symbols(spark, sf):
    rows = table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("symbol"), F.col("c_mktsegment").alias("base_asset"), F.when(F.col("c_nationkey") % 3 == 0, "USDT").otherwise("BTC").alias("quote_asset"), F.when(F.col("c_acctbal") > 0, "TRADING").otherwise("BREAK").alias("status"), F.lit(True).alias("spot_allowed"))
    return members.eligible(rows, excluded_bases=["BUILDING", "MACHINERY"])


@query(f"WITH {sql.LAST} SELECT seq, date::varchar AS date, symbol, file, bytes, status, sha256, source_checksum_ok FROM last")
def dedupe_keep_last(spark, sf):
    return logs.keep_last(manifest(spark, sf), ["date", "file"]).withColumn("date", F.col("date").cast("string"))


@query(f"WITH {sql.VERIFIED} SELECT date::varchar AS date, symbol FROM verified")
def verified_division(spark, sf):
    return logs.verified_pair_days(manifest(spark, sf)).withColumn("date", F.col("date").cast("string"))


@query(f"WITH {sql.MONITORED} SELECT w.day::varchar AS day, count(m.symbol) AS pairs, 24.0 * count(m.symbol) AS hours FROM weeks w LEFT JOIN monitored m USING (day) GROUP BY ALL")
def pair_hours_by_day(spark, sf):
    return logs.pair_hours_by_day(_monitored(spark, sf), weeks(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {sql.MONITORED} SELECT symbol, 24.0 * count(*) AS hours FROM monitored GROUP BY symbol")
def pair_hours_by_pair(spark, sf):
    return logs.pair_hours_by_pair(_monitored(spark, sf))


@query(f"WITH {sql.MONITORED}, both_rules AS (SELECT 'verified-archive' AS rule, day, symbol FROM monitored UNION ALL SELECT 'universe-membership', day, symbol FROM governed) SELECT rule, count(symbol) AS pair_days, 24.0 * count(symbol) AS pair_hours, count(DISTINCT symbol) AS pairs FROM (SELECT unnest(['verified-archive', 'universe-membership']) AS rule) LEFT JOIN both_rules USING (rule) GROUP BY rule")
def denominator_report(spark, sf):
    tables = universe(spark, sf)
    return logs.denominator_report(_governed(spark, sf, tables=tables), logs.verified_pair_days(manifest(spark, sf)), weeks(spark, sf), monitored=_monitored(spark, sf, tables))


@query(f"WITH {sql.MANIFEST}, present AS (SELECT DISTINCT date, file FROM manifest WHERE seq % 3 = 0) SELECT seq FROM manifest m WHERE status = 'ok' OR status = 'skipped' AND sha256 <> '' AND NOT EXISTS (SELECT 1 FROM present p WHERE p.date = m.date AND p.file = m.file)")
def manifest_wanted(spark, sf):
    rows = manifest(spark, sf)
    return logs.manifest_rows_wanted(rows, rows.where("seq % 3 = 0").select("date", "file").distinct()).select("seq")


_PULLS = f"WITH {sql.MANIFEST}, pulls AS (SELECT date, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = '404') AS missing, count(*) FILTER (status = 'failed') AS failed, sum(bytes)::bigint AS bytes FROM manifest WHERE date <> DATE '1996-07-22' GROUP BY date)"


@query(f"{_PULLS} SELECT date::varchar AS date, ok, skipped, missing, failed, bytes, CASE WHEN missing > 0 AND ok + skipped + failed = 0 THEN 'retry' WHEN failed = 0 AND missing > 0 AND DATE '{TODAY}' - date < 5 THEN 'retry' WHEN failed = 0 THEN 'complete' ELSE 'retry' END AS state FROM pulls")
def pull_statistics(spark, sf):
    return logs.completion(logs.pull_statistics(logs.without_dates(manifest(spark, sf), ("1996-07-22",))), TODAY).withColumn("date", F.col("date").cast("string"))


@query(f"WITH {sql.LAST} SELECT CASE WHEN status <> '404' THEN status WHEN DATE '{TODAY}' - date < 5 THEN 'pending' ELSE 'listing gap' END AS state, count(*) AS files FROM last GROUP BY ALL")
def status_taxonomy(spark, sf):
    last = logs.keep_last(manifest(spark, sf), ["date", "file"])
    return last.groupBy(logs.taxonomy(F.col("status"), F.col("date"), TODAY).alias("state")).agg(F.count("*").alias("files"))


@query(f"WITH {sql.MANIFEST}, done AS (SELECT DISTINCT date AS day FROM manifest WHERE status = 'ok') SELECT day::varchar AS day FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::date AS day FROM manifest) ANTI JOIN done USING (day)")
def outstanding_days(spark, sf):
    done = manifest(spark, sf).where("status = 'ok'").select(F.col("date").alias("day")).distinct()
    first, last = manifest(spark, sf).agg(F.min("date").cast("string"), F.max("date").cast("string")).first()
    return logs.outstanding_days(first, last, done).select(F.col("day").cast("string").alias("day"))


@query(f"WITH {sql.MANIFEST}, days AS (SELECT DISTINCT date, symbol FROM manifest), need AS (SELECT symbol || '-aggTrades-' || date::varchar || '.zip' AS file FROM days UNION ALL SELECT symbol || '-1m-' || date::varchar || '.zip' FROM days) SELECT file FROM need WHERE file NOT IN (SELECT file FROM manifest WHERE status = 'ok') ORDER BY file LIMIT 10")
def missing_examples(spark, sf):
    rows = manifest(spark, sf)
    days = rows.select(F.col("date").cast("string").alias("day"), "symbol").distinct()
    need = days.select(F.explode(F.array(logs.trades_file(F.col("symbol"), F.col("day")), logs.bars_file(F.col("symbol"), F.col("day")))).alias("file"))
    return logs.missing_files(need, rows.where("status = 'ok'").select("file").distinct())


@query(f"WITH {sql.MANIFEST}, days AS (SELECT DISTINCT symbol, date AS day FROM manifest) SELECT symbol, day::varchar AS day, 'https://archive.invalid/aggTrades/' || symbol || '/' || symbol || '-aggTrades-' || day::varchar || '.zip' AS url, 'raw/aggTrades/' || day::varchar || '/' || symbol || '-aggTrades-' || day::varchar || '.zip' AS path FROM days UNION ALL SELECT symbol, day::varchar, 'https://archive.invalid/klines/' || symbol || '/' || symbol || '-1m-' || day::varchar || '.zip', 'raw/klines/' || day::varchar || '/' || symbol || '-1m-' || day::varchar || '.zip' FROM days")
def archive_targets(spark, sf):
    days = manifest(spark, sf).select("symbol", F.col("date").cast("string").alias("day")).distinct()
    return logs.archive_targets(days, url="https://archive.invalid")


# Signatures, verdicts, gate, model


def _evaluations(spark, sf):
    bars = brand_bars(spark, sf)
    found = detectors.above(detectors.price_jump(bars, rows=5), 0.3).select("pair", F.col("open_time").alias("ts_utc"), F.lit("price_jump").alias("detector"), F.lit("").alias("frequency"), F.lit("fixed").alias("threshold_label"))
    return signatures.evaluate(found, bars, signatures.rules_table(spark, RULES), trail=TRAIL, cut="day")


_B = "FROM bars b WHERE b.pair = c.pair AND b.pos BETWEEN"
_EVALUATED = (
    f"WITH {sql.BARS}, rules AS (SELECT * FROM (VALUES {', '.join(str(r) for r in RULES)}) t(rule, gain, factor, retrace, g, r)), sizes AS (SELECT pair, count(*) AS n FROM bars GROUP BY pair),"
    " c AS (SELECT j.pair, j.day, j.pos, j.ref, n, rules.* FROM jumps j JOIN sizes USING (pair) CROSS JOIN rules WHERE j.score > 0.3),"
    f" f AS (SELECT c.*, (SELECT max(high) {_B} c.pos + 1 AND c.pos + c.g) AS peak, (SELECT max(quote_volume) {_B} c.pos + 1 AND c.pos + c.g) AS volume, (SELECT quantile_cont(quote_volume, 0.5) {_B} c.pos - {TRAIL} AND c.pos - 1) AS median,"
    f" (SELECT arg_min(b.pos, (-b.high, b.pos)) {_B} c.pos + 1 AND c.pos + c.g) AS peak_pos FROM c),"
    f" t AS (SELECT c.*, (SELECT min(low) {_B} c.peak_pos + 1 AND c.peak_pos + c.r) AS trough FROM f c),"
    f" v AS (SELECT *, CASE WHEN pos + g >= n THEN 'gain window cut off' WHEN pos < {TRAIL} THEN 'too little before' WHEN ref IS NULL OR ref <= 0 THEN 'reference close not positive' WHEN median IS NULL OR median <= 0 THEN 'median volume not positive' WHEN peak_pos + r >= n THEN 'retrace window cut off' ELSE '' END AS reason FROM t),"
    " e AS (SELECT pair, day, rule, reason = '' AS evaluable, reason, reason = '' AND coalesce(peak / ref - 1 > gain, false) AS gain_ok, reason = '' AND coalesce(volume > factor * median, false) AS volume_ok, reason = '' AND coalesce(trough <= peak - retrace * (peak - ref), false) AS retrace_ok FROM v)"
)


@query(f"{_EVALUATED} SELECT pair, day::varchar AS day, rule, evaluable, reason, gain_ok, volume_ok, retrace_ok, gain_ok AND volume_ok AND retrace_ok AS matched FROM e")
def signature_eval(spark, sf):
    return _evaluations(spark, sf).select("pair", _day().alias("day"), "rule", "evaluable", "reason", "gain_ok", "volume_ok", "retrace_ok", "matched")


@query(f"{_EVALUATED} SELECT 'price_jump' AS detector, '' AS frequency, 'fixed' AS threshold_label, rule, count(*) AS n_alerts, count(*) FILTER (evaluable) AS n_evaluable, count(*) FILTER (gain_ok AND volume_ok AND retrace_ok) AS n_matching, round(CASE WHEN count(*) FILTER (evaluable) > 0 THEN count(*) FILTER (gain_ok AND volume_ok AND retrace_ok) / count(*) FILTER (evaluable) END, 6) AS ratio FROM e GROUP BY rule")
def precision_summary(spark, sf):
    return signatures.summarise(_evaluations(spark, sf)).withColumn("ratio", _six("ratio"))


@query("SELECT count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS match, count(*) FILTER (quality = 0) AS no_match, count(*) FILTER (quality = 1 AND toxic = 1) AS unclear, true AS complete FROM labels")
def verdict_counts(spark, sf):
    verdict = F.when(F.col("quality") == 0, " No-Match").when(F.col("toxic") == 1, "unclear").otherwise("MATCH ")
    return signatures.verdict_status(table(spark, sf, "labels").select(verdict.alias("verdict")))


@query("SELECT count(*) AS events, sum(cleared)::bigint AS cleared, round(avg(cleared), 6) AS cleared_share, sum(a)::bigint AS north_total, sum(b)::bigint AS south_total, sum(c)::bigint AS west_total, avg(cleared) >= 0.6 AS go FROM (SELECT *, (a + b + c >= 2)::int AS cleared FROM (SELECT (s_acctbal > 0)::int AS a, (s_nationkey % 2)::int AS b, (s_suppkey % 3 = 0)::int AS c FROM supplier))")
def gate_clearance(spark, sf):
    probes = table(spark, sf, "supplier").select((F.col("s_acctbal") > 0).alias("north_available"), (F.col("s_nationkey") % 2 == 1).alias("south_available"), (F.col("s_suppkey") % 3 == 0).alias("west_available"))
    return signatures.gate(probes, ["north", "south", "west"]).withColumn("cleared_share", _six("cleared_share"))


@query()
def forest_scores(spark, sf):
    """Held-out scores: a forest fitted on four fifths of the pairs, whose label is whether the mean volume has grown, scores the rest."""
    matrix = features.drop_nonfinite(_matrix(spark, sf)).withColumn("gt", (F.col("avg_volume") > 0.1).cast("int"))
    held_out = F.crc32("pair") % 5 == 0
    fitted = model.fit(matrix.where(~held_out))
    return model.score(fitted, matrix.where(held_out)).select("pair", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "gt", _six("score").alias("score"))
