"""Removal of word passages that stand earlier in the corpus, behind a count-min prefilter.

A window is a run of consecutive words of one document.  Each window has a seed: the shingle of
its words that hashes lowest.  Equal windows have equal seeds, and neighbouring windows mostly
share one, so there are far fewer seeds than windows and a seed's count is never below that of
any window that it stands for.

1. Every partition of the corpus makes a count-min sketch of its seeds.  The sketch is cut into shards by seed, as wide together as the
   bytes of the corpus ask for, so that no task or broadcast holds it whole; of each shard a partition sends the cells
   that it has counted in.  These are added up cell by cell where the shard is.
2. Behind them come the seeds with the keys of their documents, a batch at a time, and a shard holds nothing but its merged sketch while it
   answers which of them it estimates at two or more.  Windows with
   such a seed are grouped exactly; all others are unique and go nowhere.  Within a batch the
   first occurrence alone goes to the shuffle: the later ones are known to be repeats at once,
   so a passage that a third of all documents share is one row a batch.
3. Every window but the first of its group marks its words; documents take their marks by a join.

Windows meet in the task of their seed, run by run.  A seed that stands very often, such as that of a line
in many contexts, is cut: its windows each go to a task of their own hash.  Two windows are equal
if seed and window hash are, which come from independent halves of the words' digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from . import storage
from .textblocks import Words, mix, windows_hash, word_blocks

#: Words in the shingle that stands for a window, if windows are long enough.
SEED_WORDS = 8
#: Cells in each of the two rows of the sketch, for each seed that the corpus has by its bytes; more cells pass fewer unique seeds.
CELLS_A_SEED = 4.0
#: Bytes of text for each seed: usual words have six, and every seventh shingle is the lowest of some window.
BYTES_A_SEED = 42
_ROWS = 2
#: Counted cells that a partition holds before it sends them on; cells of a shard in each row at most.
HELD_CELLS, SHARD_CELLS = 4_000_000, 1 << 22
#: A seed is cut from this count on, or from a millionth of all counts, so that at most a million are.
HOT_SEED, HOT_SEEDS = 1_000, 1_000_000
#: The smallest id, for rows without one: they count as standing before all others.
_NO_ID = -(2**63)


def _seeds(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start word and seed of all windows of a block, and the hashes of all its shingles."""
    seed_words = min(SEED_WORDS, length)
    shingles = windows_hash(words.hashes(0), seed_words)
    doc = np.repeat(np.arange(len(words.first) - 1), words.counts())
    n = len(doc) - length + 1
    starts = np.flatnonzero(doc[:n] == doc[length - 1 :]) if n > 0 else np.empty(0, dtype=np.int64)
    if not len(starts):
        return starts, np.empty(0, dtype=np.uint64), shingles
    return starts, _sliding(np.minimum, shingles, length - seed_words + 1)[starts], shingles


def _occurrences(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The seeds of a block's windows, each as often as it stands there for some window, and their documents."""
    starts, low, shingles = _seeds(words, length)
    if not len(starts):
        return low, starts
    span = length - min(SEED_WORDS, length) + 1
    padded = np.zeros(len(shingles) + span - 1, dtype=np.uint64)
    padded[starts + span - 1] = low
    at = np.flatnonzero(_sliding(np.maximum, padded, span) == shingles)
    return shingles[at], np.searchsorted(words.first, at, side="right") - 1

def _sliding(of, values: np.ndarray, span: int) -> np.ndarray:
    """Minimum or maximum of every span neighbours, by doubling: that of a stretch is that of two in it."""
    n, out, reach = len(values) - span + 1, values, 1
    while reach * 2 <= span:
        out = of(out[:-reach], out[reach:])
        reach *= 2
    return of(out[:n], out[span - reach : span - reach + n])


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values of a sorted array begin, and their sizes."""
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    begins = np.flatnonzero(new)
    return begins, np.diff(np.append(begins, len(values)))


#: Of a partition's sketch (kind 0): for one row of it cells and their counts.  Of a batch's seeds (kind 1): seeds that stand in it once, with the key of their document, and others likewise.
_SHARE = "shard int, kind int, row int, cells binary, counts binary, ones binary, keys binary, known binary, known_keys binary"
_SHARE_SCHEMA = pa.schema([*((c, pa.int32()) for c in ("shard", "kind", "row")), *((c, pa.binary()) for c in ("cells", "counts", "ones", "keys", "known", "known_keys"))])


class _Sketch:
    """A partition's count-min sketch: the cells that it has counted in, as shard and cell in one number, for each row."""

    def __init__(self, width: int):
        self.width, self.size = width, 0
        self.parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(_ROWS)]

    def add(self, seeds: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> None:
        for r in range(_ROWS):
            self.parts[r].append((shard.astype(np.int64) << 40 | _cells(seeds, r, self.width), counts))
        self.size += len(seeds)

    def rows(self) -> Iterator[dict]:
        """What it holds, added up, as a row for each shard and row of the sketch; it is empty then."""
        for r, parts in enumerate(self.parts):
            if not parts:
                continue
            at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(at, kind="stable")
            at = at[order]
            begins, _ = _groups(at)
            n, at = np.add.reduceat(n[order], begins) if len(begins) else n[:0], at[begins]
            first, size = _groups(at >> 40)
            for i, k in zip(first.tolist(), size.tolist(), strict=True):
                yield {"shard": int(at[i] >> 40), "kind": 0, "row": r, "cells": (at[i : i + k] & (2**40 - 1)).astype("<u4").tobytes(), "counts": np.minimum(n[i : i + k], 2**32 - 1).astype("<u4").tobytes()}
        self.parts, self.size = [[] for _ in range(_ROWS)], 0


def _shares(length: int, n_shards: int, width: int):
    """A partition's sketch, cut into shards, and its batches' seeds.

    Seeds that stand once in a batch go with the key of their document, which wants to know whether others have them
    (ones, keys); who has the rest is known already (known, known_keys).
    """

    def shard_of(x: np.ndarray) -> np.ndarray:
        return ((mix(x) >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = _Sketch(width)
        for batch in batches:
            keys, parts = batch.column("doc_key").to_numpy(), []
            for i, j, words in word_blocks(batch.column("text")):
                seeds, doc = _occurrences(words, length)
                parts.append((seeds, keys[i:j][doc]))
            if not parts:
                continue
            seeds, owner = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((owner, seeds))
            seeds, owner = seeds[order], owner[order]
            begins, sizes = _groups(seeds)
            sketch.add(seeds[begins], sizes, shard_of(seeds[begins]))
            once = begins[sizes == 1]
            have = np.repeat(sizes > 1, sizes)
            have[1:] &= (seeds[1:] != seeds[:-1]) | (owner[1:] != owner[:-1])
            rows: dict[int, dict] = {}
            for part in ({"ones": seeds[once], "keys": owner[once]}, {"known": seeds[have], "known_keys": owner[have]}):
                shard = shard_of(next(iter(part.values())))
                order = np.argsort(shard, kind="stable")
                shard = shard[order]
                at, size = _groups(shard)
                for a, n in zip(at.tolist(), size.tolist(), strict=True):
                    rows.setdefault(int(shard[a]), {}).update({c: v[order[a : a + n]].astype("<i8" if v.dtype == np.int64 else "<u8").tobytes() for c, v in part.items()})
            yield pa.RecordBatch.from_pylist([{"shard": k, "kind": 1} | v for k, v in rows.items()], schema=_SHARE_SCHEMA)
            if sketch.size >= HELD_CELLS:
                yield pa.RecordBatch.from_pylist(list(sketch.rows()), schema=_SHARE_SCHEMA)
        yield pa.RecordBatch.from_pylist(list(sketch.rows()), schema=_SHARE_SCHEMA)

    return run


_REPLY = "doc_key long, seed long, n long"
_REPLY_SCHEMA = pa.schema([("doc_key", pa.int64()), ("seed", pa.int64()), ("n", pa.int64())])


def _replies(keys: np.ndarray | None, seeds: np.ndarray, n: np.ndarray | None) -> pa.RecordBatch:
    empty = pa.nulls(len(seeds), pa.int64())
    return pa.RecordBatch.from_arrays([empty if keys is None else pa.array(keys), pa.array(seeds.view(np.int64)), empty if n is None else pa.array(n)], schema=_REPLY_SCHEMA)


def _cells(seeds: np.ndarray, row: int, cells: int) -> np.ndarray:
    return ((mix(seeds + np.uint64(0x9E3779B97F4A7C15 * (row + 1) % 2**64)) >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)


def _estimate(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard and kind: adds a shard's sketches up, then tells documents which of their seeds may stand twice, and which seeds are frequent.

        Replies have doc_key and seed, frequent seeds seed and n, and one row n alone: the counts of the whole shard.
        """
        shard, sketch, told = None, None, set()
        for row in (r for batch in batches for r in batch.to_pylist()):
            if row["shard"] != shard:
                shard, sketch, told = row["shard"], np.zeros((_ROWS, width), dtype=np.int64), set()
            if row["kind"] == 0:
                counts = np.frombuffer(row["counts"], dtype="<u4")
                sketch[row["row"], np.frombuffer(row["cells"], dtype="<u4")] += counts  # distinct cells
                if row["row"] == 0:
                    yield _replies(None, np.zeros(1, dtype=np.uint64), np.array([int(counts.sum())])).set_column(1, "seed", pa.nulls(1, pa.int64()))
                continue
            estimate = lambda seeds: np.minimum.reduce([sketch[r, _cells(seeds, r, width)] for r in range(_ROWS)])  # noqa: E731, B023
            ones, known = (np.frombuffer(row[c] or b"", dtype="<u8") for c in ("ones", "known"))
            n = estimate(ones)
            hit = n > 1
            yield _replies(np.frombuffer(row["keys"] or b"", dtype="<i8")[hit], ones[hit], None)
            yield _replies(np.frombuffer(row["known_keys"] or b"", dtype="<i8"), known, None)
            often = np.unique(np.concatenate([ones[n >= HOT_SEED], known[estimate(known) >= HOT_SEED]]))
            if fresh := [x for x in often.tolist() if x not in told]:  # a frequent seed has so many counts: they are few beside them
                told.update(fresh)
                fresh = np.array(fresh, dtype=np.uint64)
                yield _replies(None, fresh, estimate(fresh))

    return run


_FOUND = "kind int, part long, seed long, doc_id long, doc_key long, start int, data binary"
_FOUND_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("seed", pa.int64()), ("doc_id", pa.int64()), ("doc_key", pa.int64()), ("start", pa.int32()), ("data", pa.binary())])


def _mark_rows(doc_ids: np.ndarray, doc_keys: np.ndarray, starts: np.ndarray) -> dict[str, list]:
    """Rows of kind 1: for each document the starts of its repeated windows, as ranges."""
    order = np.lexsort((starts, doc_keys, doc_ids))
    d, k, s = doc_ids[order], doc_keys[order], starts[order]
    same = np.ones(len(d), dtype=bool)
    same[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    cut = same.copy()
    cut[1:] |= s[1:] > s[:-1] + 1
    begins = np.flatnonzero(cut)
    ends = np.append(begins[1:], len(d)) - 1 if len(d) else begins
    ranges = np.stack([s[begins], s[ends]], axis=1).astype("<i4") if len(d) else np.empty((0, 2), dtype="<i4")
    at = np.append(np.flatnonzero(same[begins]), len(begins)) if len(d) else np.zeros(1, dtype=np.int64)
    docs = begins[at[:-1]]
    return {"kind": [1] * len(docs), "part": k[docs].tolist(), "seed": [None] * len(docs), "doc_id": d[docs].tolist(), "doc_key": k[docs].tolist(), "start": [0] * len(docs), "data": [ranges[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]}


def _first_of_group(a: np.ndarray, b: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether (doc_id, start) is the lowest of the rows that share a and b."""
    order = np.lexsort((starts, doc_ids, b, a))
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    leader = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(a) else order
    out = np.empty(len(a), dtype=bool)
    out[order] = (doc_ids[order] == doc_ids[leader]) & (starts[order] == starts[leader])
    return out


def _find(length: int, hot: Broadcast):
    """The windows of documents that may stand twice, but for those that stand in the batch before: these are marked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = hot.value
        for batch in batches:
            ids, keys, text = batch.column("doc_id").to_numpy(), batch.column("doc_key").to_numpy(), batch.column("row").field("text")
            parts = []
            for i, j, words in word_blocks(text):
                starts, seeds, _ = _seeds(words, length)
                asked = np.unique(batch.column("seeds").slice(i, j - i).flatten().to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)
                if not len(starts) or not len(asked):
                    continue
                keep = np.isin(seeds, asked)
                starts, seeds = starts[keep], seeds[keep]
                whole = windows_hash(words.hashes(1), length)[starts]
                doc = np.searchsorted(words.first, starts, side="right") - 1
                parts.append((ids[i:j][doc], keys[i:j][doc], starts - words.first[doc], whole, seeds))
            if not parts:
                continue
            d, k, s, whole, seeds = (np.concatenate(x) for x in zip(*parts, strict=True))
            first = _first_of_group(seeds, whole, d, s)
            yield pa.RecordBatch.from_pydict(_mark_rows(d[~first], k[~first], s[~first]), schema=_FOUND_SCHEMA)
            d, k, s, whole, seeds = d[first], k[first], s[first], whole[first], seeds[first]
            cut = np.isin(seeds, frequent)
            part = np.where(cut, mix(whole ^ seeds), seeds)
            new = np.ones(len(d), dtype=bool)  # where a run of neighbouring windows of one part begins
            new[1:] = (part[1:] != part[:-1]) | (np.diff(s) != 1) | (d[1:] != d[:-1]) | (k[1:] != k[:-1])
            begins = np.flatnonzero(new)
            raw, at = whole.astype("<u8").tobytes(), np.append(begins, len(d)) * 8
            data = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(begins), dtype=np.int32)), pa.array(part[begins].view(np.int64)), pa.array(seeds[begins].view(np.int64)), pa.array(d[begins]), pa.array(k[begins]), pa.array(s[begins].astype(np.int32)), pa.array(data, pa.binary())], schema=_FOUND_SCHEMA)

    return run


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: marks the windows that are not the first of their kind, and lets marks through.

    Rows of the last part of a batch wait for the next one, since more of them may follow.
    """
    held: list[pa.RecordBatch] = []

    def marks(table: pa.Table) -> pa.RecordBatch:
        size = np.fromiter((len(x) // 8 for x in table.column("data").to_pylist()), dtype=np.int64, count=table.num_rows)
        whole = np.frombuffer(b"".join(table.column("data").to_pylist()), dtype="<u8")
        inner = np.arange(len(whole)) - np.repeat(np.cumsum(size) - size, size)
        d, k, seeds, s = (np.repeat(table.column(c).to_numpy(), size) for c in ("doc_id", "doc_key", "seed", "start"))
        s = s + inner
        late = ~_first_of_group(seeds, whole, d, s)
        return pa.RecordBatch.from_pydict(_mark_rows(d[late], k[late], s[late]), schema=_FOUND_SCHEMA)

    for batch in batches:
        known = batch.column("kind").to_numpy() == 1
        if known.any():
            yield batch.filter(pa.array(known))
            batch = batch.filter(pa.array(~known))
        if not batch.num_rows:
            continue
        parts = batch.column("part").to_numpy()
        cut = int(np.searchsorted(parts, parts[-1], side="left"))
        if cut:
            yield marks(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield marks(pa.Table.from_batches(held))


def _covered(n: int, ranges: list[bytes] | None, length: int) -> np.ndarray:
    """Which of n words lie in a marked window."""
    out = np.zeros(n + 1, dtype=np.int64)
    for data in ranges or ():
        for a, b in np.frombuffer(data, dtype="<i4").reshape(-1, 2).tolist():
            out[a] += 1
            out[min(n, b + length)] -= 1
    return np.cumsum(out[:-1]) > 0


def _hot_seeds(replies: DataFrame) -> Broadcast:
    """Seeds that a millionth of all counts or more falls to; their number has that bound."""
    told = replies.where("doc_key is null")
    total = told.where("seed is null").agg(F.sum("n")).first()[0] or 0
    rows = told.where(F.col("seed").isNotNull() & (F.col("n") >= max(HOT_SEED, total // HOT_SEEDS))).select("seed").toArrow()
    return replies.sparkSession.sparkContext.broadcast(np.sort(rows.column("seed").to_numpy().astype(np.int64).view(np.uint64)))


def remove_repeats(docs: DataFrame, *, length: int = 20, cells_a_seed: float = CELLS_A_SEED) -> DataFrame:
    """Removes each word that a window covers which also starts earlier in the corpus.

    Earlier is a smaller doc_id, or the same and an earlier start; windows are those of the
    input.  Returns docs with the columns n_words, n_removed and kept_text (the words kept, joined
    by one space) added, in place of any of these names that docs has.  A null or empty text has no
    words and keeps the empty text.  Rows that share doc_id and start are equally early: neither
    takes words from the other, so repeated rows are all treated alike.  Rows without doc_id
    count as earlier than all others.  An empty table gives an empty table.
    cells_a_seed: the width of the sketch; it decides how many unique windows go to the exact pass, never the result.
    """
    own = docs.drop("n_words", "n_removed", "kept_text")
    text = F.col("text").cast("string")
    rows = own.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64("doc_id", "text").alias("doc_key"))
    n_shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = own.agg(F.sum(F.octet_length(text))).first()[0] or 0
    cells = int(cells_a_seed * size / BYTES_A_SEED)
    sketches = max(n_shards, -(-cells // SHARD_CELLS))
    width = max(8, cells // sketches)
    shares = own.select(text.alias("text"), F.xxhash64("doc_id", "text").alias("doc_key")).mapInArrow(_shares(length, sketches, width), _SHARE)
    together = shares.repartition(n_shards, "shard").sortWithinPartitions("shard", "kind")
    replies = storage.materialise(together.mapInArrow(_estimate(width), _REPLY), "seeds")
    asked = replies.where("doc_key is not null").groupBy("doc_key").agg(F.collect_list("seed").alias("seeds"))
    # Sorted, so that a task that runs again has the same batches.
    sought = rows.join(asked, "doc_key").select("row", "doc_id", "doc_key", "seeds").sortWithinPartitions("doc_key")
    found = sought.mapInArrow(_find(length, _hot_seeds(replies)), _FOUND)
    marks = found.repartition(n_shards, "part").sortWithinPartitions("part").mapInArrow(_group, _FOUND)
    # doc_id is compared as a difference, so that both joins deal rows by doc_key and share one shuffle of the texts.
    marks = marks.select(F.col("doc_key").alias("marked"), F.col("doc_id").alias("marked_id"), "data").repartition("marked").groupBy("marked", "marked_id").agg(F.collect_list("data").alias("ranges"))
    joined = rows.join(marks, (F.col("doc_key") == F.col("marked")) & (F.col("doc_id").bitwiseXOR(F.col("marked_id")) == 0), "left").select("row", "ranges")
    return joined.mapInArrow(_apply(length), own.selectExpr("*", "0L n_words", "0L n_removed", "'' kept_text").schema)


def _apply(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges, row = batch.column("ranges").to_pylist(), pa.RecordBatch.from_struct_array(batch.column("row"))
            n_words, n_removed, kept = [], [], []
            for i, _, words in word_blocks(row.column("text")):
                for doc, n in enumerate(words.counts().tolist()):
                    gone = _covered(n, ranges[i + doc], length)
                    n_words.append(n)
                    n_removed.append(int(gone.sum()))
                    kept.append(words.joined(doc, ~gone))
            added = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*row.columns, *added], names=[*row.schema.names, "n_words", "n_removed", "kept_text"])

    return run
