"""Greedy cooldown: an alert is kept if the last one kept lies at least the cooldown back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


def apply_cooldown(hits: DataFrame, keys: list[str], *, ts: str = "ts_utc", score: str = "score", seconds: int = 1800, carried: DataFrame | None = None) -> DataFrame:
    """keys, ts and score of the hits kept, in each key by time and, at equal times, by score.

    carried (keys, last) gives the time of the last alert kept before these hits; it never resets
    at midnight.  A null time is no hit.
    """
    rows = hits.where(F.col(ts).isNotNull()).select(*keys, ts, score)
    if carried is not None:
        rows = rows.join(carried.select(*keys, "last"), keys, "left").where(F.col("last").isNull() | (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp")) >= seconds * 1_000_000)).drop("last")
    return _in_order(rows, keys, ts, score).mapInArrow(_fold(keys, [*keys, ts, score], seconds * 1_000_000), rows.schema)


def _in_order(rows: DataFrame, keys: list[str], ts: str, score: str) -> DataFrame:
    """Rows of a key together and by time, _at in microseconds: one shuffle and one sort, which spills."""
    return rows.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).repartition(*keys).sortWithinPartitions(*keys, "_at", score)


def _stretches(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """Key, begin and end of each run of rows with one key."""
    new = np.zeros(batch.num_rows, dtype=bool)
    for c in keys:
        codes = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    starts = [0, *np.flatnonzero(new).tolist()] if batch.num_rows else []
    for i, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield tuple(batch.column(c)[i].as_py() for c in keys), i, end


def _kept(at: np.ndarray, last: int | None, width: int) -> Iterator[int]:
    """Places of the times that are kept: each is found by one search from the one before."""
    i = 0
    while i < len(at):
        if last is not None:  # the first hit that lies far enough behind
            i += int(np.searchsorted(at[i:], last + width))
            if i == len(at):
                return
        yield i
        last = int(at[i])
        i += 1


def _fold(keys: list[str], columns: list[str], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keeps hits of sorted rows, with the key and time of the last one kept as all its state."""
        key = last = None
        for batch in batches:
            at, keep = batch.column("_at").to_numpy(), []
            for own, i, end in _stretches(batch, keys):
                last, key = (last if own == key else None), own
                keep += (here := [i + k for k in _kept(at[i:end], last, width)])
                last = int(at[here[-1]]) if here else last
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in columns], names=columns)

    return run


def count_kept(hits: DataFrame, keys: list[str], *, ts: str = "ts_utc", seconds: int = 1800) -> DataFrame:
    """keys and the number of hits that a cooldown keeps, without making their list."""
    every = hits.withColumn("_score", F.lit(0.0))
    return count_kept_at(every, keys, lambda key: [0.0], ts=ts, score="_score", seconds=seconds).drop("threshold")


def count_kept_at(hits: DataFrame, keys: list[str], thresholds: Callable[[tuple], list[float]], *, ts: str = "ts_utc", score: str = "score", seconds: int = 1800) -> DataFrame:
    """keys, threshold and kept: how many hits a cooldown keeps of those at or above each threshold of the key, if any.

    thresholds gives a key's thresholds.  All are counted in one pass over the hits, sorted once: the state is one time and one number for each of them.
    """
    out = hits.select(*keys, F.lit(0.0).alias("threshold"), F.lit(0).cast("long").alias("kept")).schema
    rows = hits.where(F.col(ts).isNotNull()).select(*keys, ts, score)
    return _in_order(rows, keys, ts, score).mapInArrow(_count(keys, score, thresholds, seconds * 1_000_000), out)


def _count(keys: list[str], score: str, thresholds: Callable[[tuple], list[float]], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, levels, last, kept, out, schema = None, [], [], [], [], None

        def finish() -> None:
            out.extend((*key, t, n) for t, n in zip(levels, kept, strict=True) if n)

        def batch_of() -> pa.RecordBatch:
            columns, names = list(zip(*out, strict=True)), [*schema.names]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], names=names)

        for batch in batches:
            schema = pa.schema([*(batch.schema.field(c) for c in keys), ("threshold", pa.float64()), ("kept", pa.int64())])
            at, scores = batch.column("_at").to_numpy(), batch.column(score).cast(pa.float64()).to_numpy(zero_copy_only=False)
            for own, i, end in _stretches(batch, keys):
                if own != key:
                    if key is not None:
                        finish()
                    key, levels = own, thresholds(own)
                    last, kept = [None] * len(levels), [0] * len(levels)
                for k, level in enumerate(levels):
                    times = at[i:end][scores[i:end] >= level]
                    for place in _kept(times, last[k], width):
                        kept[k] += 1
                        last[k] = int(times[place])
            if out:
                yield batch_of()
        if key is not None:
            finish()
        if out:
            yield batch_of()

    return run


def gap_audit(episodes: DataFrame, keys: list[str], *, ts: str = "ts_utc", seconds: int = 1800) -> DataFrame:
    """Per key: alerts, the shortest gap in seconds, and whether every gap reaches the cooldown."""
    order = Window.partitionBy(*keys).orderBy(ts)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(order).cast("timestamp"))) / 1_000_000
    return episodes.withColumn("_gap", gap).groupBy(*keys).agg(F.count("*").alias("alerts"), F.min("_gap").alias("shortest_gap"), F.coalesce(F.bool_and(F.col("_gap") >= seconds), F.lit(True)).alias("respected"))
