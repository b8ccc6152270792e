"""Signature rules: whether what follows an alert looks as a rule says."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from vigil import constants
from vigil.functions.numeric import finite
from vigil.plans.guard import endpoint

ALERT = ["pair", "ts_utc", "detector", "frequency", "threshold_label"]


def rules_table(spark: SparkSession, rules: tuple = constants.RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule string, gain double, volume_factor double, retrace double, gain_window int, retrace_window int")


_FACTS = "pair string, at long, rule string, any_bars boolean, matches int, before long, after long, ref double, median double, peak double, peak_at int, volume double, trough double"
#: Bars of a pair that are kept before those that no alert needs are dropped.
KEPT_BARS = 50_000


class _Bars:
    """The latest bars of a pair, in order, with the place of the first of them."""

    def __init__(self):
        self.first, self.parts, self.count = 0, [], 0
        self.values = np.empty((4, 0))

    def add(self, values: np.ndarray) -> None:
        self.parts.append(values)
        self.count += values.shape[1]

    def window(self, begin: int, end: int) -> np.ndarray:
        """High, low, close and volume of the places from begin up to end."""
        if self.parts:
            self.values, self.parts = np.concatenate([self.values, *self.parts], axis=1), []
        return self.values[:, max(begin - self.first, 0) : max(end - self.first, 0)]

    def drop_before(self, place: int) -> None:
        n = max(0, min(place, self.count) - self.first)
        self.window(0, 0)
        self.values, self.first = self.values[:, n:], self.first + n


def _extreme(x: np.ndarray, what: Callable) -> float | None:
    x = x[~np.isnan(x)]
    return float(what(x)) if len(x) else None


def _judge(bars: _Bars, place: int, gain_window: int, retrace_window: int) -> tuple:
    """peak, its distance, volume and trough of the windows behind place."""
    ahead = bars.window(place + 1, place + 1 + gain_window + retrace_window)
    high, volume = ahead[0, :gain_window], ahead[3, :gain_window]
    missing = np.isnan(high)
    peak = _extreme(high, np.max)
    at = None if not len(high) else int(np.argmax(missing)) + 1 if missing.any() else int(np.argmax(high)) + 1
    return peak, at, _extreme(volume, np.max), None if at is None else _extreme(ahead[1, at : at + retrace_window], np.min)


def _sweep(windows: list[tuple[str, int, int]], trail: int):
    """Facts of each asked time by rule, from bars (kind 0) and asked times (kind 1) of each pair in order."""
    longest = max((g + r for _, g, r in windows), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, bars, latest, waiting, out = None, _Bars(), [], [], []

        def judge(at: int, matches: int, place: int) -> None:
            if matches != 1:
                out.extend((pair, at, rule, bars.count > 0, matches, *[None] * 8) for rule, _, _ in windows)
                return
            volumes = bars.window(place - trail, place)[3]
            median = _extreme(volumes, np.median)
            ref = float(bars.window(place, place + 1)[2, 0])
            for rule, g, r in windows:
                peak, peak_at, volume, trough = _judge(bars, place, g, r)
                out.append((pair, at, rule, True, 1, place, bars.count - 1 - place, None if np.isnan(ref) else ref, median, peak, peak_at, volume, trough))

        def settle(last: bool) -> None:
            """Judges what has all its bars; before a pair's first bar nothing is known."""
            while waiting and (last or bars.count and (waiting[0][1] != 1 or waiting[0][2] + longest < bars.count)):
                judge(*waiting.pop(0))
            if not last and bars.count - bars.first > KEPT_BARS:
                bars.drop_before((waiting[0][2] if waiting else bars.count) - trail - 1)

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("pair").dictionary_encode()
            codes, known = names.indices.to_numpy(), names.dictionary.to_pylist()
            at, kind = batch.column("at").to_numpy(), batch.column("kind").to_numpy()
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("high", "low", "close", "quote_volume")])
            borders = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for i, end in zip(borders, borders[1:], strict=False):
                own = known[codes[i]]
                if own != pair:
                    settle(True)
                    pair, bars, latest = own, _Bars(), []
                place = i
                for ask in [*(np.flatnonzero(kind[i:end] == 1) + i).tolist(), end]:
                    if ask > place:
                        bars.add(values[:, place:ask])
                        tail = at[place:ask]
                        latest = [*latest, *tail[-2:].tolist()][-2:]  # times of the last two bars tell how many an asked time has
                    if ask < end:
                        matches = latest.count(at[ask])
                        waiting.append((int(at[ask]), matches, bars.count - 1))
                    place = ask + 1
                settle(False)
            if out:
                yield _facts(out)
                out.clear()
        settle(True)
        if out:
            yield _facts(out)

    return run


def _facts(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.int32(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in _FACTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


@endpoint
def evaluate(episodes: DataFrame, bars: DataFrame, rules: DataFrame, *, trail: int = constants.SIGNATURE_TRAIL, cut: str = "minute") -> DataFrame:
    """Per alert and rule: whether it can be judged, why not, and the rule's parts.

    bars (pair, open_time, high, low, close, quote_volume) are numbered per pair, and windows count
    bars, not time.  The reference close is that of the alert's bar.  The peak is the highest high of the
    gain window, at its first place (a missing high counts as the peak's place, not as its height);
    volume is compared with the median of the trail bars before; retracement with the lowest low of the
    retrace window after the peak.  NaN is missing.  The reasons are tried in a fixed order.  Bars and the times of alerts are sorted by pair once, and one pass over them
    keeps no more bars than the windows of the alerts that it has yet to judge.
    """
    minute = F.date_trunc(cut, F.col("ts_utc")).cast("timestamp_ntz")
    alerts = episodes.select(*ALERT).withColumn("minute", minute)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp_ntz").cast("timestamp"))
    numbers = [F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "quote_volume")]
    asked = alerts.select("pair", micros("minute").alias("at")).distinct()
    rows = bars.select("pair", micros("open_time").alias("at"), F.lit(0).alias("kind"), *numbers).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True).where("pair is not null and at is not null")
    windows = [tuple(r) for r in rules.select("rule", "gain_window", "retrace_window").collect()]  # a handful
    facts = rows.repartition("pair").sortWithinPartitions("pair", "at", "kind").mapInArrow(_sweep(windows, trail), _FACTS).join(F.broadcast(rules), "rule")
    reason = (
        F.when(~F.col("any_bars"), "no bars of the pair")
        .when(F.col("matches") == 0, "time absent")
        .when(F.col("matches") > 1, "time ambiguous")
        .when(F.col("after") < F.col("gain_window"), "gain window cut off")
        .when(F.col("before") < trail, "too little before")
        .when(~finite(F.col("ref")) | (F.col("ref") <= 0), "reference close not positive")
        .when(~finite(F.col("median")) | (F.col("median") <= 0), "median volume not positive")
        .when(F.col("after") - F.col("peak_at") < F.col("retrace_window"), "retrace window cut off")
    )
    judged = facts.withColumn("reason", F.coalesce(reason, F.lit(""))).withColumn("evaluable", F.col("reason") == "")
    when = lambda test: F.col("evaluable") & F.coalesce(test, F.lit(False))
    judged = judged.withColumns({
        "gain_ok": when(F.try_divide("peak", F.when(F.col("ref") != 0, F.col("ref"))) - 1 > F.col("gain")),
        "volume_ok": when(F.col("volume") > F.col("volume_factor") * F.col("median")),
        "retrace_ok": when(F.col("trough") <= F.col("peak") - F.col("retrace") * (F.col("peak") - F.col("ref"))),
    }).withColumn("matched", F.col("gain_ok") & F.col("volume_ok") & F.col("retrace_ok"))
    judged = judged.withColumn("minute", F.timestamp_micros("at").cast("timestamp_ntz"))
    return alerts.join(judged.select("pair", "minute", "rule", "evaluable", "reason", "gain_ok", "volume_ok", "retrace_ok", "matched"), ["pair", "minute"]).drop("minute")


@endpoint
def summarise(evaluations: DataFrame) -> DataFrame:
    """Per stream and rule: alerts, those that can be judged, those that match, and the share of the latter."""
    keys = ["detector", "frequency", "threshold_label", "rule"]
    out = evaluations.groupBy(*keys).agg(F.count("*").alias("n_alerts"), F.count_if("evaluable").alias("n_evaluable"), F.count_if("matched").alias("n_matching"))
    return out.withColumn("ratio", F.when(F.col("n_evaluable") > 0, F.col("n_matching") / F.col("n_evaluable")))


@endpoint
def verdict_status(sample: DataFrame) -> DataFrame:
    """How many rows have each verdict, and whether all have one."""
    verdict = F.lower(F.trim("verdict"))
    counts = [F.count_if(verdict == v).alias(v.replace("-", "_")) for v in constants.VERDICTS]
    return sample.agg(F.count("*").alias("n"), *counts, F.coalesce(F.bool_and(F.coalesce(verdict.isin(*constants.VERDICTS), F.lit(False))), F.lit(False)).alias("complete"))


def gate(probes: DataFrame, venues: list[str], *, least: int = constants.GATE_VENUES, share: float = constants.GATE_SHARE) -> DataFrame:
    """How many events are available on enough venues, per venue counts, and whether their share reaches the bar."""
    n = sum((F.col(f"{v}_available").cast("int") for v in venues), F.lit(0))
    rows = probes.withColumn("cleared", (n >= least).cast("int"))
    totals = [F.sum(F.col(f"{v}_available").cast("int")).alias(f"{v}_total") for v in venues]
    return rows.agg(F.count("*").alias("events"), F.sum("cleared").alias("cleared"), F.avg("cleared").alias("cleared_share"), *totals).withColumn("go", F.col("cleared_share") >= share)
