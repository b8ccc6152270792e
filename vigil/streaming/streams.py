"""Streaming forms of the time bins and of the cooldown."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigil import constants


def stream_bins(trades: DataFrame, seconds: int, *, late: str = "2 days") -> DataFrame:
    """bin_trades over a stream (pair, ts, price, quote_volume, side); a bin is final when the watermark has passed it."""
    bought = trades.where("side = 'buy'").withWatermark("ts", late)
    out = bought.groupBy("pair", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("price").alias("trade_count"), F.sum("quote_volume").alias("volume_sum"), F.avg("price").alias("price_mean"), F.max("price").alias("price_max"))
    return out.select("pair", F.col("w.start").alias("bin"), "trade_count", "volume_sum", "price_mean", "price_max")


def stream_cooldown(hits: DataFrame, *, seconds: int = constants.COOLDOWN_SECONDS) -> DataFrame:
    """The cooldown over a stream of hits (pair, ts_utc, detector, score), with the last alert kept as state.

    Hits are put in order within a micro-batch.  One that comes after a later one was kept is
    judged against that one and so never kept: order across micro-batches is the source's.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts_utc", "score"], kind="stable")
        keep = []
        for i, at in enumerate((rows["ts_utc"] - pd.Timestamp(0)) // pd.Timedelta(microseconds=1)):
            if last is None or at - last >= seconds * 1_000_000:
                keep.append(i)
                last = int(at)
        if last is not None:
            state.update((last,))
        yield rows.iloc[keep][["pair", "detector", "ts_utc", "score"]]

    return hits.groupBy("pair", "detector").applyInPandasWithState(run, "pair string, detector string, ts_utc timestamp_ntz, score double", "last long", "append", GroupStateTimeout.NoTimeout)


class _OrderedCooldown(StatefulProcessor):
    """Keeps a key's hits until the watermark has passed them, and then judges them by time."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last, self.waiting = handle.getValueState("last", "at long"), handle.getListState("waiting", "at long, score double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            at = (frame["ts_utc"].dt.tz_localize(None) - pd.Timestamp(0)) // pd.Timedelta(microseconds=1)
            self.waiting.appendList([(int(t), None if pd.isna(s) else float(s)) for t, s in zip(at, frame["score"], strict=True)])
            for millis in {-(-int(t) // 1000) for t in at}:
                self.handle.registerTimer(millis)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((w for w in waiting if w[0] <= passed), key=lambda w: (w[0], w[1] is not None, w[1]))
        if not ready:
            return
        rest, last, keep = [tuple(w) for w in waiting if w[0] > passed], self.last.get()[0] if self.last.exists() else None, []
        for at, score in ready:
            if last is None or at - last >= self.width:
                keep.append((at, score))
                last = at
        self.last.update((last,))
        self.waiting.put(rest) if rest else self.waiting.clear()
        times = pd.to_datetime([at for at, _ in keep], unit="us")
        yield pd.DataFrame({"pair": key[0], "detector": key[1], "ts_utc": times, "score": [s for _, s in keep]})


def stream_cooldown_by_time(hits: DataFrame, *, seconds: int = constants.COOLDOWN_SECONDS, late: str = "2 days") -> DataFrame:
    """The cooldown over a stream of hits (pair, ts_utc, detector, score) in the order of their times, whatever order they come in.

    A hit waits until the watermark, late behind the latest time, has passed it; hits within that lateness are judged as a
    batch would.  Later ones are dropped, and counted by Spark as such.  The state of a key is its waiting hits and its last alert, in
    RocksDB, which the session's spark.sql.streaming.stateStore.providerClass must name.
    """
    timed = hits.where("ts_utc is not null").withColumn("ts_utc", F.col("ts_utc").cast("timestamp")).withWatermark("ts_utc", late)
    return (
        timed.groupBy("pair", "detector")
        .transformWithStateInPandas(_OrderedCooldown(seconds * 1_000_000), "pair string, detector string, ts_utc timestamp_ntz, score double", "append", "EventTime")
    )
