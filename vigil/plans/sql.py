"""The same roles in SQL: common table expressions that the SQL of queries starts with."""

from __future__ import annotations

TRADES = """trades AS (
  SELECT user_id::varchar AS pair, date_trunc('millisecond', ts) AS ts, value AS price, value AS quote_volume,
    CASE WHEN event_type IN ('purchase', 'view') THEN 'buy' ELSE 'sell' END AS side, event_id
  FROM events WHERE value > 0)"""
BINS = (
    TRADES
    + """,
binned AS (SELECT *, make_timestamp((epoch_us(ts) // 21600000000) * 21600000000) AS bin FROM trades WHERE side = 'buy'),
rush AS (SELECT pair, bin, sum(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END)::double AS rush_sum FROM (
  SELECT pair, bin, date_trunc('hour', ts) AS same, count(*) AS n FROM binned GROUP BY ALL) GROUP BY ALL),
bins AS (SELECT pair, bin, count(price) AS trade_count, sum(quote_volume::decimal(28,8))::double AS volume_sum,
  avg(price) AS price_mean, max(price) AS price_max FROM binned GROUP BY ALL)"""
)
GRID = (
    TRADES
    + """,
d AS (SELECT pair, ts::date AS day, sum(price::decimal(18,2))::double AS qv, arg_max(price, (ts, event_id)) AS px,
  arg_min(price, (ts, event_id)) AS op, max(price) AS hi, min(price) AS lo FROM trades GROUP BY pair, ts::date),
spine AS (SELECT pair, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::date AS day
  FROM (SELECT DISTINCT pair FROM trades), (SELECT min(ts)::date AS lo, max(ts)::date AS hi FROM trades)),
grid AS (SELECT s.pair, s.day, coalesce(qv, 0) AS quote_volume, qv IS NULL AS filled, op, hi, lo,
  last_value(px IGNORE NULLS) OVER (PARTITION BY s.pair ORDER BY s.day ROWS UNBOUNDED PRECEDING) AS close
  FROM spine s LEFT JOIN d ON s.pair = d.pair AND s.day = d.day)"""
)
SCORED = (
    GRID
    + """,
zs AS (SELECT pair, day, CASE WHEN n = 7 AND hi7 > lo7 AND s > 0 THEN (quote_volume - m) / s END AS score FROM (
  SELECT *, count(*) OVER w AS n, avg(quote_volume) OVER w AS m, stddev_samp(quote_volume) OVER w AS s,
    max(quote_volume) OVER w AS hi7, min(quote_volume) OVER w AS lo7 FROM grid
  WINDOW w AS (PARTITION BY pair ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))),
js AS (SELECT pair, day, close / nullif(lag(close) OVER (PARTITION BY pair ORDER BY day), 0) - 1 AS score FROM grid),
scored AS (SELECT pair, 'volume_zscore' AS detector, day, score FROM zs UNION ALL SELECT pair, 'price_jump', day, score FROM js),
hits AS (SELECT * FROM scored WHERE score > CASE detector WHEN 'volume_zscore' THEN 1.5 ELSE 0.5 END)"""
)
KEPT = """kept AS (
  SELECT pair, detector, min(day) AS day FROM hits GROUP BY pair, detector
  UNION ALL
  SELECT h.pair, h.detector, min(h.day) FROM kept a JOIN hits h ON h.pair = a.pair AND h.detector = a.detector AND h.day >= a.day + 3
  GROUP BY h.pair, h.detector, a.day)"""
ALERTS = SCORED + ", " + KEPT + ", alerts AS (SELECT k.*, h.score FROM kept k JOIN hits h USING (pair, detector, day))"
UNIVERSE = """dates AS (SELECT unnest(generate_series(date_trunc('quarter', min(o_orderdate)), date_trunc('quarter', max(o_orderdate)), INTERVAL 3 MONTH))::date AS table_date FROM orders),
volumes AS (SELECT table_date, 'C' || o_custkey AS symbol, sum(o_totalprice::decimal(18,2)) AS volume FROM orders
  JOIN dates ON o_orderdate::date >= table_date - 90 AND o_orderdate::date < table_date GROUP BY ALL),
universe AS (SELECT *, row_number() OVER (PARTITION BY table_date ORDER BY volume DESC, symbol) AS rank FROM volumes)"""
MANIFEST = """manifest AS (SELECT o_orderkey * 2 + k AS seq, date_trunc('week', o_orderdate)::date AS date, 'C' || o_custkey AS symbol,
  'C' || o_custkey || CASE k WHEN 0 THEN '-aggTrades-' ELSE '-1m-' END || (date_trunc('week', o_orderdate)::date)::varchar || '.zip' AS file,
  o_orderkey AS bytes, (['ok', 'skipped', '404', 'failed'])[((o_orderkey + k) % 4 + 1)::int] AS status,
  CASE WHEN (o_orderkey + k) % 3 = 0 THEN '' ELSE md5(o_orderkey::varchar) END AS sha256,
  CASE (o_orderkey * 7 + k * 3) % 5 WHEN 0 THEN '0' WHEN 1 THEN '' ELSE '1' END AS source_checksum_ok
  FROM orders, (SELECT unnest([0, 1]) AS k))"""
GOVERNED = (
    UNIVERSE
    + """,
weeks AS (SELECT unnest(generate_series(date_trunc('week', min(o_orderdate)), date_trunc('week', max(o_orderdate)), INTERVAL 7 DAY))::date AS day FROM orders),
governing AS (SELECT day, max(table_date) AS table_date FROM weeks LEFT JOIN (SELECT DISTINCT table_date FROM universe) ON table_date < day GROUP BY day),
listed AS (SELECT g.day, g.table_date, symbol, rank FROM governing g JOIN universe u ON g.table_date = u.table_date WHERE rank > 50),
governed AS (SELECT * FROM listed UNION ALL
  SELECT g.day, g.table_date, x.symbol, NULL FROM governing g, (SELECT unnest(['C1', 'C2']) AS symbol) x
  WHERE g.table_date <= DATE '1996-07-01' AND NOT EXISTS (SELECT 1 FROM listed l WHERE l.day = g.day AND l.symbol = x.symbol))"""
)
LAST = MANIFEST + ", last AS (SELECT * FROM manifest QUALIFY row_number() OVER (PARTITION BY date, file ORDER BY seq DESC) = 1)"
VERIFIED = (
    LAST
    + """,
verified AS (SELECT date, symbol FROM last WHERE source_checksum_ok = '1' GROUP BY date, symbol
  HAVING bool_or(file = symbol || '-aggTrades-' || date::varchar || '.zip') AND bool_or(file = symbol || '-1m-' || date::varchar || '.zip'))"""
)
MONITORED = GOVERNED + ", " + VERIFIED + ", monitored AS (SELECT g.* FROM governed g SEMI JOIN verified v ON g.day = v.date AND g.symbol = v.symbol)"
BARS = """bars AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY day) - 1 AS pos FROM (
  SELECT p_brand AS pair, l_shipdate::date AS day, max(price)::double AS high, min(price)::double AS low,
    round(sum(price)::double / count(*), 2) AS close, sum(paid)::double AS quote_volume
  FROM (SELECT p_brand, l_shipdate, round(l_extendedprice / l_quantity, 2)::decimal(18,2) AS price, l_extendedprice::decimal(18,2) AS paid
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0) GROUP BY ALL)),
jumps AS (SELECT pair, day, pos, close AS ref, close / lag(close, 5) OVER (PARTITION BY pair ORDER BY day) - 1 AS score FROM bars)"""
