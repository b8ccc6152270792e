"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within them.

Equal vectors with equal labels form a class first.  Each class has a home cell, that of the
centre with the largest cosine.  Two unit vectors of cosine c lie within r = sqrt(2 - 2 c) of each
other; if their homes differ, the plane between these is crossed on the way, so one of the two lies within
r / 2 of it.  Each class is therefore a guest in every cell whose plane is that near, and a pair is found where
one is at home and the other is at home or a guest.  Cells lose no link, and a pair that meets twice counts in
the lower cell.  The members of a cell with one label are cut into blocks, and each task compares two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import storage
from .components import components
from .vectors import matrix, usable_rows

#: Members in a block of a cell; sampled vectors for each centre at least; parts that the rows of a cell are dealt over.
BLOCK_ROWS, SAMPLE_A_CENTRE, SALTS = 2_048, 8, 16
_NO_ID = -(2**63)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x  # keeps very small and large vectors in range
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k unit centres of unit vectors."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = np.argmax(x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1)
        centres[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return np.unique(centres, axis=0)


def _assign(centres: np.ndarray, least: float):
    """Adds cells, a class's home and then those it is a guest in."""
    half = math.sqrt(2 - 2 * least) / 2 + 1e-9
    at_once = max(1, 4_000_000 // len(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for at in range(0, batch.num_rows, at_once):
                s = _unit(matrix(batch.column("v").slice(at, at_once))) @ centres.T
                home = np.argmax(s, axis=1)
                between = np.sqrt(np.maximum(0, 2 - 2 * centres[home] @ centres.T))
                guest = s.max(axis=1)[:, None] - s <= half * between + 1e-9
                guest[np.arange(len(s)), home] = False
                cells += [[int(h), *np.flatnonzero(g).tolist()] for h, g in zip(home, guest, strict=True)]
            yield batch.append_column("cells", pa.array(cells, pa.list_(pa.int32())))

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component, for links a[i] - b[i] of n things."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _linked(u: np.ndarray, v: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of u and v with a cosine of least or more; what the blocked product puts close to it is decided by one pair at a time."""
    i, j = np.nonzero(u @ v.T >= least - 1e-9)
    exact = np.concatenate([(u[i[k : k + 65536]] * v[j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)]) if len(i) else np.empty(0)
    return i[exact >= least], j[exact >= least]


def _compare(least: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """For each member its number of linked rows, and links that span the components found here."""
        _, cell, low, high = (k.as_py() for k in key)
        node, weight, own, place = (table.column(c).to_numpy() for c in ("node", "n", "own", "place"))
        cells, listed = table.column("cells").combine_chunks(), table.column("cells").combine_chunks().flatten().to_numpy()
        first = cells.offsets.to_numpy()[:-1] - cells.offsets[0].as_py()
        width = int(listed.max()) + 1
        members = np.repeat(np.arange(len(node)), np.diff(cells.offsets.to_numpy())) * width + listed  # who is in which cell
        unit = _unit(matrix(table.column("v")))
        n_links, found = np.zeros(len(node), dtype=np.int64), []
        left, right, home = np.flatnonzero(own == low), np.flatnonzero(own == high), place == 0
        sides = [(left, right[home[right]])] if low == high else [(left, right[home[right]]), (left[home[left]], right[~home[right]])]
        for rows, others in sides:  # at least one of two is at home
            i, j = _linked(unit[rows], unit[others], least)
            i, j = rows[i], others[j]
            mixed = home[i] != home[j]
            # The guest of a pair is at home elsewhere; if the other is a guest there, the lower cell has the pair.
            there, host = listed[first[np.where(home[i], j, i)]], np.where(home[i], i, j)
            once = np.where(mixed, (there > cell) | ~np.isin(host * width + there, members), (i < j) | (low != high))
            i, j = i[once], j[once]
            np.add.at(n_links, i, weight[j])
            np.add.at(n_links, j, weight[i])
            found.append((i, j))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(node, kind="stable")
        rank = np.empty(len(node), dtype=np.int64)
        rank[order] = np.arange(len(node))
        root = order[_roots(len(node), rank[i], rank[j])]  # by rank: the least node of each component
        spans = np.flatnonzero((root != order) | (n_links[order] > 0))
        return pa.table({"node": node[order[spans]], "root": node[root[spans]], "n_links": n_links[order[spans]]})

    return run


def near_duplicates(embeddings: DataFrame, *, least: float = 0.98, sample_rows: int = 20_000) -> DataFrame:
    """Groups vectors of one label with a cosine of least or more.

    Returns a row for each row: vec_id, n_links, component_id, kept.  n_links counts the other rows
    linked directly, component_id is the smallest vec_id reachable and kept says that the row has
    it.  Rows whose label is null, or whose vector is null, zero, of another length than most, or
    not finite link with nothing.  Repeated rows link with each other.  Rows that share vec_id but not vector or label
    are vectors of their own.  Rows without vec_id count as smaller than all others, and so have a null
    component_id with all that link to them.  Further columns are ignored and an empty table gives an empty table.
    sample_rows: distinct vectors that the centres are fitted on; every vector is in a cell.  There are as many cells as the
    cube root of the number of classes of the largest label, or one for four blocks of them if these are more, up to an eighth of
    sample_rows.  Vectors without clusters are guests in about a tenth of all cells, so more cells would cost more than they save.
    """
    rows = embeddings.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.col("label"), F.col("embedding").cast("array<double>").alias("v"))
    usable = usable_rows(rows.where("label is not null"), "v")
    grouped = usable.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = storage.materialise(grouped.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")
    sample = matrix(classes.orderBy(F.xxhash64("v"), "node").limit(sample_rows).select("v").toArrow().column("v"))
    if not len(sample):
        named = rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    else:
        largest = classes.groupBy("label").count().agg(F.max("count")).first()[0]
        centres = spherical_kmeans(_unit(sample), max(1, min(max(math.ceil(largest ** (1 / 3)), largest // (4 * BLOCK_ROWS)), len(sample) // SAMPLE_A_CENTRE)))
        numbered = classes.select(F.col("label").cast("string").alias("label"), "v", "n", "node")
        placed = storage.materialise(numbered.mapInArrow(_assign(centres, least), "label string, v array<double>, n long, node long, cells array<int>"), "cells")
        members = placed.select("label", "v", "n", "node", "cells", F.posexplode("cells").alias("place", "cell"))
        sizes = placed.select("label", F.explode("cells").alias("cell")).groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
        # Dealt over several tasks, since a cell can hold a third of all members.
        salt, every = F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
        members = members.select("*", salt).join(sizes.select("*", every), ["label", "cell", "salt"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
        members = members.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({"i": F.least("own", "with"), "j": F.greatest("own", "with")})
        key = ["label", "cell", "i", "j"]
        pairs = members.select(*key, "own", "place", "node", "n", "cells", "v").groupBy(key)
        found = storage.materialise(pairs.applyInArrow(_compare(least), "node long, root long, n_links long"), "links")
        groups = components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
        counts = found.groupBy("node").agg(F.sum("n_links").alias("linked"))
        of_class = classes.join(counts, "node", "left").join(groups, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
        first = of_class.groupBy("group").agg(F.min("rep").alias("component"))
        of_class = of_class.join(first, "group").select("label", "v", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component")
        key = [rows["label"].eqNullSafe(of_class["label"]), rows["v"].eqNullSafe(of_class["v"])]
        named = rows.join(of_class, key, "left").select(rows["id"], F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", rows["id"]).alias("component"))
    real = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return named.select(real("id").alias("vec_id"), "n_links", real("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
