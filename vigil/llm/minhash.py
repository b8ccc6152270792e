"""Near-duplicate documents by one-permutation MinHash with optimal densification.

1. A scan gives every document its number of shingles, a digest of the shingle set and the keys
   of its signature's bands.  Documents of one digest form a class, which is a node from then on.
2. A bucket (one band, one key) links its members to a centre, that which shares the most buckets
   with others: star-shaped edges, as many as members.  An edge is confirmed on the full sets of both
   texts.
3. A star can miss a link between two members that do not link to the centre.  So the members of
   buckets that still hold several components are joined once more, exactly: two sets that are
   similar enough share one of their rarest shingles, at places that leave enough of both sets.
   A shingle of many sets is joined block by block, so that no task holds all of them.

A shingle has two independent hashes.  A set's digest covers both, and a link must hold by either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import storage
from .components import components
from .textblocks import Words, mix, windows_hash, word_blocks

#: Bands and rows of the signature: at a similarity of 0.8 a pair shares no band once in 80,000.
BANDS, ROWS = 48, 7
_BINS = BANDS * ROWS
#: For every bin the order in which an empty one asks the others.
_PROBES = np.argsort(np.random.default_rng(9).random((_BINS, _BINS)), axis=0)
#: Stands for a missing doc_id.
NO_ID = -(2**63)
#: Sets in a block of a shingle that many have; parts that the rows of a shingle are dealt over to meet a table of shingles.
BLOCK_SETS, SALTS = 1_024, 16


def shingle_sets(words: Words, size: int, half: int = 0) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a block, by one half of the words' digests."""
    hashes = words.hashes(half)
    shingles = windows_hash(hashes, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(shingles[a : b - size + 1]))
        else:
            out.append(windows_hash(hashes[a:b], b - a) if b > a else hashes[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation signatures, a row for each set; those of empty sets are zero.

    The hash range is cut into bins and each keeps its least hash.  An empty bin takes the value of
    the first one with a value, in its own fixed random order of all bins.
    """
    n = len(sets)
    out, full = np.zeros((n, _BINS), dtype=np.uint64), np.zeros((n, _BINS), dtype=bool)
    if not n or not (total := sum(map(len, sets))):
        return out
    values, doc = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    values, bins = values, ((values >> np.uint64(32)) * np.uint64(_BINS) >> np.uint64(32)).astype(np.int64)
    first = np.ones(total, dtype=bool)  # sets are sorted, so the first hash in a bin is its least
    first[1:] = (bins[1:] != bins[:-1]) | (doc[1:] != doc[:-1])
    out[doc[first], bins[first]] = values[first]
    full[doc[first], bins[first]] = True
    d, b = np.nonzero(~full & full.any(axis=1)[:, None])
    for probe in _PROBES:
        if not len(d):
            break
        ask = probe[b]
        hit = full[d, ask]
        out[d[hit], b[hit]] = out[d[hit], ask[hit]]
        d, b = d[~hit], b[~hit]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A key for each band of each row."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for r in range(ROWS):
        keys = mix(keys ^ parts[:, :, r]) * np.uint64(0x9FB21C651E98DF25)
    return keys.view(np.int64)


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in word_blocks(batch.column("text"), lower=True):
                sets = shingle_sets(words, size)
                keys = band_keys(signatures(sets))
                second = shingle_sets(words, size, 1)
                digests = [hashlib.blake2b(s.tobytes() + t.tobytes(), digest_size=16).digest() if len(s) else None for s, t in zip(sets, second, strict=True)]
                counts = np.fromiter((max(len(s), len(t)) for s, t in zip(sets, second, strict=True)), dtype=np.int64, count=len(sets))
                bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("text_key").slice(i, j - i), pa.array(counts), pa.array(digests, pa.binary()), bands], names=["doc_id", "text_key", "n_shingles", "digest", "bands"])

    return run


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(p, q, assume_unique=True))
    return shared > 0 and 100 * shared >= percent * (len(p) + len(q) - shared)


def _confirm(size: int, percent: int):
    """Of pairs with both texts, those whose sets share enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pa.concat_arrays([part.column("text_a").cast(pa.large_string()), part.column("text_b").cast(pa.large_string())])
                unique = texts.dictionary_encode()
                sets = [s for _, _, words in word_blocks(unique.dictionary, lower=True) for s in zip(*(shingle_sets(words, size, half) for half in (0, 1)), strict=True)]
                index, n = unique.indices.to_pylist(), part.num_rows
                linked = [all(_similar(p, q, percent) for p, q in zip(sets[x], sets[y], strict=True)) for x, y in zip(index[:n], index[n:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def _shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in word_blocks(batch.column("text"), lower=True):
                sets = shingle_sets(words, size)
                flat = np.concatenate(sets).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i), lists], names=["node", "shingles"])

    return run


def _meet(rows: DataFrame, table: DataFrame, key: str = "shingle") -> DataFrame:
    """The join of rows (node, key) and a table with one row a key, without all rows of a key in one task."""
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    return rows.select("*", salt).join(table.select("*", every), [key, "salt"]).drop("salt")


def _rarest_first(open_: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that may be similar enough.

    open_ has node, n_shingles and component.  With the shingles of every set ordered by how many of
    these sets have them, two sets of the least overlap start their overlap within the first
    n - percent n + 1 places, and the places at which it starts bound how large it can be.
    """
    sets = texts.join(open_.select("node"), "node", "left_semi").mapInArrow(_shingles(size), "node long, shingles array<long>")
    tokens = storage.materialise(sets.select("node", F.explode("shingles").alias("shingle")), "tokens")
    common = tokens.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    # Shingles that one set alone has come first in it and match nothing: only their number matters.
    ordered = _meet(tokens, common).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("tokens"))
    ordered = ordered.join(open_, "node").withColumn("alone", F.col("n_shingles") - F.size("tokens"))
    prefix = F.expr(f"cast(n_shingles - ceil({percent} * n_shingles / 100) + 1 - alone as int)")
    starts = ordered.where(prefix > 0).select("node", "n_shingles", "component", "alone", F.posexplode(F.slice("tokens", F.lit(1), prefix)).alias("place", "token"))
    starts = storage.materialise(starts.select("node", "n_shingles", "component", (F.col("place") + F.col("alone")).alias("place"), F.col("token.shingle").alias("shingle")), "prefixes")
    # A shingle whose sets are all of one component joins nothing.
    counts = starts.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / BLOCK_SETS).alias("blocks"))
    x = _meet(starts, counts.where("low < high").select("shingle", "blocks")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    x = x.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({"i": F.least("own", "with"), "j": F.greatest("own", "with")}).drop("with", "blocks")
    y = x.select("shingle", "i", "j", *(F.col(c).alias(f"other_{c}") for c in ("node", "n_shingles", "component", "place", "own")))
    fits = F.expr(
        f"node < other_node and component <> other_component and (i = j or own <> other_own)"
        f" and least(n_shingles - place, other_n_shingles - other_place) * {100 + percent} >= {percent} * (n_shingles + other_n_shingles)"
        f" and 100 * least(n_shingles, other_n_shingles) >= {percent} * greatest(n_shingles, other_n_shingles)"
    )
    return x.join(y, ["shingle", "i", "j"]).where(fits).select(F.col("node").alias("a"), F.col("other_node").alias("b")).distinct()


def near_groups(docs: DataFrame, *, shingle_words: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """A row for each document: doc_id, text_key, n_shingles, and the first document of its group.

    exact: also joins all sets that the buckets leave in different components, rarest shingles first, so that no link is left to
    chance; without, a pair at the bound shares no bucket about once in 80,000.
    text_key is xxhash64(text).  first is the struct (doc_id, text_key) of the group's document that comes
    first by both, and null without a word.  Missing doc_ids are the smallest long here.
    """
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    described = storage.materialise(slim.mapInArrow(_describe(shingle_words), "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>"), "minhash")
    found = described.where("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"))
    classes = storage.materialise(found.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")
    members = classes.select("node", "n_shingles", F.explode("bands").alias("key"))
    crowded = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = storage.materialise(members.join(crowded, "key"), "buckets")
    degree = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    centre = F.max(F.struct("degree", F.bitwise_not("node").alias("reversed"), "n_shingles")).alias("c")
    centres = shared.join(degree, "node").groupBy("key").agg(centre).select("key", F.bitwise_not("c.reversed").alias("centre"), F.col("c.n_shingles").alias("n_centre"))
    near = F.expr(f"100 * least(n_shingles, n_centre) >= {percent} * greatest(n_shingles, n_centre)")  # no other pair can link
    stars = shared.join(centres, "key").where(F.col("node") != F.col("centre")).where(near)
    stars = storage.materialise(stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "pairs")
    wanted = (classes if exact else classes.join(degree.select("node"), "node", "left_semi")).select("node", "first.doc_id", "first.text_key")
    texts = storage.materialise(slim.join(wanted, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("node", "text"), "texts")

    def links(pairs: DataFrame) -> DataFrame:
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
        judged = both.mapInArrow(_confirm(shingle_words, percent), "a long, b long, linked boolean")
        return storage.materialise(judged.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")), "links")

    linked = links(stars)
    groups = components(linked)
    component = F.coalesce("component", "node").alias("component")
    if exact:
        open_ = classes.join(groups, "node", "left").select("node", "n_shingles", component)
    else:
        labelled = shared.where("n > 2").join(groups, "node", "left").select("key", "node", "n_shingles", component)
        mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        open_ = labelled.join(mixed, "key", "left_semi").select("node", "n_shingles", "component").distinct()
    open_ = storage.materialise(open_, "open")
    rest = _rarest_first(open_, texts, shingle_words, percent).join(stars, ["a", "b"], "left_anti")
    groups = components(linked.unionByName(links(rest)))
    first = classes.select("node", "first").join(groups, "node").groupBy("component").agg(F.min("first").alias("its_first"))
    to_first = _meet(groups, first, "component").select("node", "its_first")
    named = classes.select("digest", "node", "first").join(to_first, "node", "left").select("digest", F.coalesce("its_first", "first").alias("first"))
    return described.select("doc_id", "text_key", "n_shingles", "digest").join(named, "digest", "left").drop("digest")


def near_duplicates(docs: DataFrame, *, shingle_words: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """Groups documents whose shingle sets have a Jaccard similarity of percent / 100 or more.

    Returns a row for each document: doc_id, n_shingles, component_id, kept.  Words are those of
    textblocks, with A-Z lower-cased; a text of fewer words than a shingle is one shingle, and a
    null text or one without words has no set and links with nothing.  component_id is the
    smallest doc_id reachable over links and kept says that the row has it.  Repeated rows share
    a class and are all kept or not; rows that share doc_id but not text are judged each by its
    text, and links of one are none of the other.  Rows without doc_id count as smaller than all others, and so have a
    null component_id with all that link to them.  Further columns are ignored and an empty table gives
    an empty table.  exact is that of near_groups().
    """
    out = near_groups(docs, shingle_words=shingle_words, percent=percent, exact=exact)
    component = F.coalesce("first.doc_id", "doc_id")
    real = lambda c: F.when(c != NO_ID, c)
    return out.select(real(F.col("doc_id")).alias("doc_id"), "n_shingles", real(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"))
