"""Largest inner products by vantage-point trees.

Vectors get one more component, so that all have the norm of the longest; among these, the nearest
to a query, whose own further component is zero, have the largest inner products, and the
triangle inequality holds.

A vantage-point tree on a bounded sample cuts the space into shards; every row goes down it to its
shard.  A query goes to each shard that may hold a near enough row, as far as the distances to
the vantage points on the way tell.  Each shard, or part of a large one, has a tree of its own, which its task builds once and
then streams the queries through; a query enters a branch on the same condition.  With a factor above one, a part is skipped although its bound is only that
much below the distance to beat; factor one gives exact results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .vectors import matrix, usable

LEAF = 256
#: Rows in a shard, or in one of the parts that a large shard is split into; shards that the sample is cut into at most.
SHARD_ROWS, MAX_SHARDS = 8_192, 1_024
#: Rounding of one operation.
UNIT = 2.0**-53


@dataclass
class Node:
    """A vantage point with the parts within and beyond its radius, or a leaf with rows."""

    point: np.ndarray | None = None
    radius: float = 0.0
    inner: Node | None = None
    outer: Node | None = None
    rows: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    number: int = 0


def build(x: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> Node:
    """A tree over x[rows]; rows that lie equally far from the point are never split without end."""
    if len(rows) <= leaf:
        return Node(rows=rows)
    point = x[rng.choice(rows)]
    d = np.linalg.norm(x[rows] - point, axis=1)
    radius = float(np.median(d))
    near = d <= radius
    if near.all():
        near = d < radius
    if not near.any() or near.all():
        return Node(rows=rows)
    radius = float(d[near].max())
    return Node(point, radius, build(x, rows[near], leaf, rng), build(x, rows[~near], leaf, rng))


def leaves(node: Node, bounds: tuple = ()) -> list[tuple[Node, tuple]]:
    """All leaves with the (point, radius, is inner) that lead to them."""
    if node.point is None:
        return [(node, bounds)]
    return leaves(node.inner, (*bounds, (node.point, node.radius, True))) + leaves(node.outer, (*bounds, (node.point, node.radius, False)))


def product_error(dimensions: int, query_norms: np.ndarray, longest: float) -> np.ndarray:
    """By how much two ways to add up an inner product may differ at most, doubled."""
    return 8 * (dimensions + 4) * UNIT * query_norms * longest


def to_beat(least: np.ndarray, squares: np.ndarray, longest: float, dimensions: int) -> np.ndarray:
    """A distance that no row beyond has an inner product of least or more, with room for the rounding of products, lengths and distances."""
    base, part = squares + longest**2, 16 * (dimensions + 4) * UNIT
    least = least - product_error(dimensions, np.sqrt(squares), longest)
    return np.sqrt(np.maximum(0, base - 2 * least) + part * base) + part * np.sqrt(base)


def augment(x: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0, longest**2 - (x * x).sum(axis=1)))])


class _Search:
    """Descends a tree with many queries at once and keeps the pairs that may be among the k best."""

    def __init__(self, x: np.ndarray, own: np.ndarray, queries: np.ndarray, least: np.ndarray, own_rows: np.ndarray, longest: float, k: int, factor: float):
        self.x, self.own, self.q, self.k, self.factor = x, own, queries, k, factor
        self.own_rows = own_rows  # each query's own row here, or -1
        self.best = np.repeat(least[:, None], k, axis=1)
        self.longest, self.squares = longest, (queries * queries).sum(axis=1)
        self.error = product_error(queries.shape[1], np.sqrt(self.squares), longest)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.compared = 0  # inner products taken

    def beat(self, who: np.ndarray) -> np.ndarray:
        """The distance of the k-th best so far."""
        return to_beat(self.best[who].min(axis=1), self.squares[who], self.longest, self.q.shape[1])

    def visit(self, node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if node.point is None:
            s = self.q[who] @ self.own[node.rows].T
            self.compared += s.size
            s[node.rows[None, :] == self.own_rows[who][:, None]] = -np.inf
            both = np.concatenate([self.best[who], s], axis=1)
            self.best[who] = -np.partition(-both, self.k - 1, axis=1)[:, : self.k]
            a, b = np.nonzero(s >= (self.best[who].min(axis=1) - self.error[who])[:, None])
            self.pairs.append((who[a], node.rows[b]))
            return
        # A query's own point has no further component, the vantage point may have one.
        d = np.sqrt(((self.q[who] - node.point[:-1]) ** 2).sum(axis=1) + node.point[-1] ** 2)
        first = d <= node.radius
        self.visit(node.inner, who[first])
        self.visit(node.outer, who[~first])
        self.visit(node.outer, who[first][(node.radius - d[first]) * self.factor <= self.beat(who[first])])
        self.visit(node.inner, who[~first][(d[~first] - node.radius) * self.factor <= self.beat(who[~first])])


class Part:
    """The tree of a part's rows.

    Rows with the same vector enter it once, with the k + 1 smallest ids: no more can be among the best.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, longest: float, k: int):
        order = np.argsort(ids, kind="stable")
        self.ids, x, self.longest, self.k = ids[order], np.ascontiguousarray(x[order]) + 0.0, longest, k
        _, first, of = np.unique(x.view([("", x.dtype)] * x.shape[1]).ravel(), return_index=True, return_inverse=True)
        self.by = np.argsort(of, kind="stable")
        self.begin = np.searchsorted(of[self.by], np.arange(len(first)))
        self.size = np.minimum(np.diff(np.append(self.begin, len(self.by))), k + 1)
        self.vectors = x[first]
        self.wide = augment(self.vectors, longest)
        # A vector is a query's own only where no other row has it.
        self.position = {int(i): int(u) for i, u in zip(self.ids[first[self.size == 1]].tolist(), np.flatnonzero(self.size == 1).tolist(), strict=True)}
        self.tree = build(self.wide, np.arange(len(self.vectors)), LEAF, np.random.default_rng(5))

    def best(self, query_ids: np.ndarray, q: np.ndarray, least: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, row id, inner product) of at most k rows for each query."""
        own_rows = np.array([self.position.get(int(i), -1) for i in query_ids.tolist()], dtype=np.int64)
        search = _Search(self.wide, self.vectors, q, least, own_rows, self.longest, self.k, factor)
        search.visit(self.tree, np.arange(len(q)))
        self.compared = search.compared
        if not search.pairs:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        who, what = (np.concatenate(c) for c in zip(*search.pairs, strict=True))
        score = np.zeros(len(who))
        for d in range(q.shape[1]):  # one component after the other, as any plain loop adds them
            score += q[who, d] * self.vectors[what, d]
        keep = score >= search.best[who].min(axis=1) - search.error[who]
        who, what, score = who[keep], what[keep], score[keep]
        n = self.size[what]
        at = np.repeat(self.begin[what] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        who, row, score = np.repeat(who, n), self.ids[self.by[at]], np.repeat(score, n)
        other = row != query_ids[who]
        who, row, score = who[other], row[other], score[other]
        order = np.lexsort((row, -score, who))
        who, row, score = who[order], row[order], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        return query_ids[who[rank < self.k]], row[rank < self.k], score[rank < self.k]


def _stretches(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Borders of the runs in which all columns stay the same."""
    new = np.ones(len(columns[0]), dtype=bool)
    for c in columns:
        new[1:] &= c[1:] == c[:-1]
    new[1:] = ~new[1:]
    begins = np.flatnonzero(new).tolist()
    return list(zip(begins, [*begins[1:], len(new)], strict=True))


def nearest(embeddings: DataFrame, *, every: int = 20, k: int = 20, factor: float = 1.05, sample_rows: int = 4_096) -> DataFrame:
    """For each row whose vec_id is divisible by every: its k rows with the largest inner products.

    Returns query_id, rank (from 1), vec_id, score, ties by smaller vec_id, all candidates if there are fewer.
    Rows with a null vec_id or with a vector that is null, zero, of another length than
    most, or not finite take no part.  Vectors are scaled by one power of two, so that neither squares nor products of large ones
    overflow; a product that does is infinite in score, but ranked by its size.  A row is never compared with rows of its own vec_id; repeated
    queries with one vector are answered once, and those with several together.  Further columns are ignored
    and an empty table gives an empty table.
    sample_rows: rows that the cut into shards is made from; all rows are in shards.
    """
    spark = embeddings.sparkSession
    rows = embeddings.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(usable("v"))
    size = F.array_max(F.transform("v", F.abs))
    norm = size * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x / size * (x / size)))
    out = "query_id long, rank int, vec_id long, score double"
    lengths = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max(size).alias("largest"), F.max(norm / 2).alias("half")).orderBy(F.desc("n"), F.desc("size")).first()
    if not lengths:
        return spark.createDataFrame([], out)
    scale = math.frexp(lengths["largest"])[1]
    rows, n, longest = rows.where(F.size("v") == lengths["size"]), lengths["n"], 2 * math.ldexp(lengths["half"], -scale)
    half = [math.ldexp(1.0, -scale // 2), math.ldexp(1.0, -scale - -scale // 2)]  # 2**-scale alone may overflow
    rows = rows.select("vec_id", F.transform("v", lambda x: x * half[0] * half[1]).alias("v"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
    sample_ids, sample_x = sample["vec_id"].to_numpy(), np.array(sample["v"].tolist(), dtype=np.float64)
    wide = augment(sample_x, longest)
    n_leaves = min(MAX_SHARDS, max(1, -(-n // SHARD_ROWS)))
    tree = build(wide, np.arange(len(wide)), max(1, -(-len(wide) // n_leaves)), np.random.default_rng(3))
    cut = leaves(tree)
    for i, (leaf, _) in enumerate(cut):
        leaf.number = i
    shared = spark.sparkContext.broadcast((tree, cut, sample_ids, sample_x))  # bounded by sample_rows and MAX_SHARDS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value[0]
        for batch in batches:
            x = augment(matrix(batch.column("v")), longest)
            shard = np.zeros(len(x), dtype=np.int32)

            def down(node: Node, who: np.ndarray) -> None:
                if node.point is None:
                    shard[who] = node.number
                elif len(who):
                    near = np.linalg.norm(x[who] - node.point, axis=1) <= node.radius
                    down(node.inner, who[near])
                    down(node.outer, who[~near])

            down(tree, np.arange(len(x)))
            yield batch.append_column("shard", pa.array(shard))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cut, sample_ids, sample_x = shared.value
        for batch in batches:
            q, ids = matrix(batch.column("v")), batch.column("vec_id").to_numpy()
            if not len(q):
                continue
            # Rows of the sample are rows of the table: the k-th best of them is a bound.
            s = np.where(sample_ids[None, :] == ids[:, None], -np.inf, q @ sample_x.T)
            least = -np.partition(-s, k - 1, axis=1)[:, k - 1] if s.shape[1] >= k else np.full(len(q), -np.inf)
            beat = to_beat(least, (q * q).sum(axis=1), longest, q.shape[1])
            go = np.ones((len(q), len(cut)), dtype=bool)
            for i, (_, bounds) in enumerate(cut):
                for point, radius, inner in bounds:
                    d = np.sqrt(((q - point[:-1]) ** 2).sum(axis=1) + point[-1] ** 2)
                    go[:, i] &= ((d - radius) if inner else (radius - d)) * factor <= beat
            shards = pa.array([np.flatnonzero(r).astype(np.int32) for r in go], pa.list_(pa.int32()))
            yield batch.append_column("least", pa.array(least)).append_column("shards", shards)

    placed = rows.mapInArrow(place, "vec_id long, v array<double>, shard int")
    counts = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}  # at most MAX_SHARDS
    parts = F.create_map(*(x for s, c in counts.items() for x in (F.lit(s), F.lit(-(-c // SHARD_ROWS)))))
    in_part = F.pmod(F.xxhash64("vec_id"), F.element_at(parts, F.col("shard"))).cast("int")
    held = placed.select("shard", in_part.alias("part"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(0.0).alias("least"))
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    asked = queries.mapInArrow(route, "vec_id long, v array<double>, least double, shards array<int>").withColumn("shard", F.explode("shards")).where(F.map_contains_key(parts, F.col("shard")))
    asked = asked.select("shard", F.explode(F.sequence(F.lit(0), F.element_at(parts, F.col("shard")) - 1)).alias("part"), F.lit(1).alias("kind"), "vec_id", "v", "least")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each part's rows and then its queries, a batch at a time."""
        key, rows, tree = None, [], None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("shard", "part", "kind")]
            for a, b in _stretches(*columns) if batch.num_rows else ():
                own, kind = (columns[0][a], columns[1][a]), columns[2][a]
                if own != key:
                    key, rows, tree = own, [], None
                ids, x = batch.column("vec_id").to_numpy()[a:b], matrix(batch.column("v").slice(a, b - a))
                if kind == 0:
                    rows.append((ids, x))
                elif rows:
                    tree = tree or Part(*(np.concatenate(c) for c in zip(*rows, strict=True)), longest, k)
                    found = tree.best(ids, x, batch.column("least").to_numpy()[a:b], factor)
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2])], names=["query_id", "vec_id", "score"])

    together = held.unionByName(asked).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "part").sortWithinPartitions("shard", "part", "kind", "vec_id")
    found = together.mapInArrow(search, "query_id long, vec_id long, score double")
    back = [math.ldexp(1.0, scale // 2), math.ldexp(1.0, scale - scale // 2)]
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", (F.col("score") * back[0] * back[1] * back[0] * back[1]).alias("score"))
