"""Cluster bootstraps and seeded samples.

No row is made for a draw of a cluster.  With the generators "numpy" (one stream of numpy's generator, in the order draw by draw) and "md5"
(of seed, draw and place, which any SQL engine can repeat) the clusters' values, up to MOST_SHARED of them, are broadcast, and each
task sums up draws of its own.  With "tree", for any number of clusters, these stay where they are: the times that a draw hits a
block of clusters come from binomial splits down a tree of blocks, which every task repeats for its own path, and
those of each cluster are drawn within its block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigil import constants
from vigil.functions.numeric import finite
from vigil.functions.positions import with_position
from vigil.operators.builds import sample_rows
from vigil.plans.guard import endpoint
from vigil.sources.shared import written

#: Clusters that are broadcast at most; clusters in a block of the tree; draws that a task sums up at once.
MOST_SHARED, BLOCK, DRAWS = 1_000_000, 4_096, 64
GENERATORS = ("numpy", "md5", "tree")


def numpy_places(n: int, seed: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """Draws first to last (exclusive) of the stream that gives n places a draw.  Numbers before them are made and passed over, which is far cheaper than summing."""
    rng = np.random.default_rng(seed)
    for draw in range(last):
        places = rng.integers(0, n, n)
        if draw >= first:
            yield draw, places


def md5_places(n: int, seed: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """Draws first to last: place i of a draw is the first 32 bits of md5("seed|draw|i"), modulo n."""
    for draw in range(first, last):
        yield draw, np.fromiter((int.from_bytes(hashlib.md5(b"%d|%d|%d" % (seed, draw, i)).digest()[:4], "big") % n for i in range(n)), dtype=np.int64, count=n)


def block_counts(sizes: list[int], block: int, n_draws: int, seed: int) -> np.ndarray:
    """How often each draw of as many clusters as all sizes together hits one block.

    Down the tree of blocks, each node's hits are split over its halves by a binomial law, with a generator that seed and node alone fix.
    """
    low, high, counts = 0, len(sizes), np.full(n_draws, sum(sizes), dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left, both = sum(sizes[low:middle]), sum(sizes[low:high])
        here = np.random.default_rng([seed, low, high]).binomial(counts, left / both)
        low, high, counts = (low, middle, here) if block < middle else (middle, high, counts - here)
    return counts


def block_sums(values: np.ndarray, counts: np.ndarray, seed: int, block: int) -> np.ndarray:
    """For each draw the sums of values (a row a cluster) over counts clusters drawn with replacement: weights times values."""
    rng, n = np.random.default_rng([seed, block]), len(values)
    out = np.empty((len(counts), values.shape[1]))
    for a in range(0, len(counts), DRAWS):
        own = counts[a : a + DRAWS]
        which = np.repeat(np.arange(len(own)), own) * n + rng.integers(0, n, own.sum())
        out[a : a + DRAWS] = np.bincount(which, minlength=len(own) * n).reshape(len(own), n) @ values
    return out


def draw_sums(clusters: DataFrame, key: str, columns: list[str], *, n_draws: int, seed: int, generator: str) -> tuple[DataFrame, int]:
    """draw and the sum of each column over as many clusters drawn with replacement as there are, and their number.  clusters is read several times."""
    if generator not in GENERATORS:
        raise ValueError(f"unknown generator {generator}")
    spark = clusters.sparkSession
    own = clusters.select(key, *(F.col(c).cast("double").alias(c) for c in columns))
    n = own.count()
    if n < 1:
        raise ValueError("no clusters")
    out = "draw int, " + ", ".join(f"`{c}` double" for c in columns)
    if generator == "tree":
        parts = _tree_sums(own, key, columns, n, n_draws, seed, out)
        return parts.groupBy("draw").agg(*(F.sum(F.col(c).cast("decimal(38,9)")).cast("double").alias(c) for c in columns)), n
    if n > MOST_SHARED:
        raise ValueError(f'{n} clusters are too many to share; take the generator "tree"')
    values = spark.sparkContext.broadcast(own.orderBy(key).select(*columns).toPandas().to_numpy(dtype=np.float64))  # MOST_SHARED rows at most
    places = numpy_places if generator == "numpy" else md5_places
    return spark.range(0, n_draws, 1, min(n_draws, max(1, spark.sparkContext.defaultParallelism))).mapInArrow(_shared_sums(values, places, seed, ["draw", *columns]), out), n


def _shared_sums(values, places: Callable, seed: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = values.value
        for batch in batches:
            ids = batch.column(0).to_numpy()  # a range: consecutive
            if len(ids):
                found = [(draw, x[at].sum(axis=0)) for draw, at in places(len(x), seed, int(ids[0]), int(ids[-1]) + 1)]
                sums = np.stack([s for _, s in found])
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int32()), *(pa.array(c) for c in sums.T)], names=names)

    return run


def _tree_sums(own: DataFrame, key: str, columns: list[str], n: int, n_draws: int, seed: int, out: str) -> DataFrame:
    sizes = [min(BLOCK, n - a) for a in range(0, n, BLOCK)]

    def run(group: tuple, table: pa.Table) -> pa.Table:
        block, order = group[0].as_py(), table.sort_by("position")
        values = np.column_stack([order.column(c).to_numpy() for c in columns])
        sums = block_sums(values, block_counts(sizes, block, n_draws, seed), seed, block)
        return pa.table([pa.array(np.arange(n_draws, dtype=np.int32)), *(pa.array(c) for c in sums.T)], names=["draw", *columns])

    placed = with_position(own, key)
    return placed.groupBy(F.expr(f"position div {BLOCK}").alias("block")).applyInArrow(run, out)


def _interval(values: DataFrame, by: list[str], alpha: float) -> DataFrame:
    value = F.col("value")
    p = lambda q: F.percentile(value, F.lit(q))
    return values.where(finite(value)).groupBy(*by).agg(p(alpha / 2).alias("low"), p(1 - alpha / 2).alias("high"), F.count("*").alias("n_draws"))


@endpoint
def bootstrap_mean(clusters: DataFrame, key: str, value: str, *, n_draws: int = constants.BOOTSTRAP_DRAWS, seed: int = constants.BOOTSTRAP_SEED, alpha: float = constants.BOOTSTRAP_ALPHA, generator: str = "numpy") -> DataFrame:
    """The percentile interval of the mean of one value for each cluster."""
    sums, n = draw_sums(written(clusters.select(key, value)), key, [value], n_draws=n_draws, seed=seed, generator=generator)
    return _interval(sums.select("draw", (F.col(value) / n).alias("value")), [], alpha)


@endpoint
def bootstrap_ratio(clusters: DataFrame, key: str, numerators: list[str], denominator: str, *, scale: float = constants.RATE_SCALE, n_draws: int = constants.BOOTSTRAP_DRAWS, seed: int = constants.BOOTSTRAP_SEED, alpha: float = constants.BOOTSTRAP_ALPHA, generator: str = "numpy") -> DataFrame:
    """Per numerator: scale times its sum over that of the denominator, and its interval; all use the same draws."""
    clusters = written(clusters.select(key, *numerators, denominator))  # one row a cluster
    sums, _ = draw_sums(clusters, key, [*numerators, denominator], n_draws=n_draws, seed=seed, generator=generator)
    ratio = lambda c: F.when(F.col(denominator) != 0, F.col(c) * scale / F.col(denominator))
    values = sums.select("draw", F.inline(F.array(*(F.struct(F.lit(c).alias("stream"), ratio(c).alias("value")) for c in numerators))))
    total = lambda c: F.sum(F.col(c).cast("decimal(28,6)")).cast("double").alias(c)
    whole = clusters.agg(*(total(c) for c in [*numerators, denominator])).select(F.inline(F.array(*(F.struct(F.lit(c).alias("stream"), ratio(c).alias("rate")) for c in numerators))))
    return whole.join(_interval(values, ["stream"], alpha), "stream")


@endpoint
def draw_sample(episodes: DataFrame, *, n: int = constants.SAMPLE_SIZE, seed: int = constants.SAMPLE_SEED, generator: str = "numpy") -> DataFrame:
    """A seeded sample without replacement, in canonical order, with empty columns for a verdict.

    By numpy's choice of places, or by md5 the n places with the lowest digests of seed and place.
    """
    columns = ["pair", "ts_utc", "detector", "frequency", "threshold_label"]
    order = ["ts_utc", "pair", "detector", F.col("frequency").asc_nulls_last(), "threshold_label"]
    picked = sample_rows(episodes.select(*columns), order, n=n, seed=seed, generator=generator)
    blank = {c: F.lit("") for c in ("verdict", "verifier", "verified_at_utc", "evidence_citation", "notes")}
    return picked.withColumns(blank).select("sample_id", *columns, *blank)
