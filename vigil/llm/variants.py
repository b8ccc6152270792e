"""Groups of spelling variants by bands of letter-parity masks.

Each letter has one of 63 bits, and a word's mask tells which bits occur an odd number of times.  Inserting or
deleting a letter flips one bit, replacing one flips two (none, if both share a bit).  So of three bands of the mask one at least stays equal
under one edit, and two do if the length changes.  Words of one length meet where a band is equal, words whose lengths differ
by one where two bands are: they go to one key, where a task compares the masks of all in blocks of numbers, and compares
the letters of those few whose masks differ in no more bits than an edit flips.

A bucket of more than BLOCK words is dealt into blocks, and each pair of blocks is a key of its own: no task takes a
whole bucket, and no pair leaves a task but those that are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import storage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of one bucket that meet in one key; from so many pairs on, a group is compared as a matrix, so many rows at once.
BLOCK, LARGE, STRIPE = 2_048, 2_000, 256
# Letters of Latin texts, the usual first, so that each band gets as many usual ones.
_USUAL = "etaoinsrhldcumfpgwybvkxjqz"


def letter_bit(letter: Column) -> Column:
    """The bit of a lower-case letter a to z (0 to 25), or of a character from U+00C0 to U+00FF (26 to 62, some share one)."""
    code = F.ascii(letter)
    return F.when(code < 0x80, code - ord("a")).otherwise((code - 0xC0) % 37 + 26)


def bands() -> list[int]:
    """Three masks that have each of the 63 bits once."""
    out = [0, 0, 0]
    for place, bit in enumerate([*(ord(c) - ord("a") for c in _USUAL), *range(26, 63)]):
        out[(0, 1, 2, 2, 1, 0)[place % 6]] |= 1 << bit
    return out


def parity_mask(word: Column) -> Column:
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), letter_bit(c).cast("int"))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda mask, c: mask.bitwiseXOR(bit(c)))


def count_words(docs: DataFrame, *, least_letters: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """word, n: the distinct words of whole texts with their occurrences.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case.  Where every divides the CRC-32 of
    `<doc_id>:<word>`, h, the word misses its letter number h % length.  Words of fewer than least_letters letters or
    least_count occurrences are left out.  A null text has no words; a null doc_id stands as the empty text; repeated rows count each.
    """
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit("[a-zÀ-ÿ]+"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("w"))
    rows = rows.where(F.char_length("w") >= least_letters).withColumn("h", F.crc32(F.concat_ws(":", "d", "w")))
    at = (F.col("h") % F.char_length("w")).cast("int")
    shorter = F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.char_length("w")))
    words = rows.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("w")).alias("word")).where(F.char_length("word") >= least_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _letters(words: list[str], length: int) -> np.ndarray:
    """Words of one length as a matrix; all letters are below U+0100."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), length)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of a and b, of equal length or b one longer, differ by one replaced or one inserted letter."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    begin = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    end = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return begin + end >= n


def _within(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of x and y whose masks differ in at most so many bits."""
    found = []
    for i in range(0, len(x), STRIPE):
        at, to = np.nonzero(np.bitwise_count(x[i : i + STRIPE, None] ^ y[None, :]) <= most)
        found.append((at + i, to))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _candidates(masks: np.ndarray, groups: list[tuple[int, int, int, int]], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs whose masks are near, from groups (left begin, left end, right begin, right end): small groups many at once."""
    small, pairs = [], 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        g = np.array(small)
        left, right = g[:, 1] - g[:, 0], g[:, 3] - g[:, 2]
        n = left * right
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(right, n)
        a, b = np.repeat(g[:, 0], n) + within // width, np.repeat(g[:, 2], n) + within % width
        near = np.bitwise_count(masks[a] ^ masks[b]) <= most
        return a[near], b[near]

    for group in groups:
        a, b, c, d = group
        if (b - a) * (d - c) > LARGE:
            at, to = _within(masks[a:b], masks[c:d], most)
            yield at + a, to + c
            continue
        small.append(group)
        pairs += (b - a) * (d - c)
        if pairs > 200 * LARGE:
            yield flush()
            small, pairs = [], 0
    if small:
        yield flush()


def _compare(parts: list[int]):
    """Near pairs among rows that are sorted by key and side: 0 with 1, and 2 among themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            borders = _borders(table)
            yield from compare(table.slice(0, borders[-2]), borders[:-1])
            rest = table.slice(borders[-2])
        if rest is not None:
            yield from compare(rest, _borders(rest))

    def _borders(table: pa.Table) -> list[int]:
        new = np.zeros(len(table), dtype=bool)
        for c in ("letters", "band", "value", "i", "j"):
            x = table.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return [0, *np.flatnonzero(new).tolist(), len(table)]

    def compare(table: pa.Table, borders: list[int]) -> Iterator[pa.RecordBatch]:
        if not len(table):
            return
        masks = table.column("mask").to_numpy().view(np.uint64)
        side, band, letters = (table.column(c).to_numpy() for c in ("side", "band", "letters"))
        begins = np.array(borders[:-1])
        shape = band[begins] // 3 + 2 * letters[begins].astype(np.int64)  # whether lengths differ, and the shorter length
        for own in np.unique(shape).tolist():
            longer, length = own % 2, own // 2
            groups = []
            for k in np.flatnonzero(shape == own).tolist():
                a, d = borders[k], borders[k + 1]
                right, both = (a + int(np.searchsorted(side[a:d], s)) for s in (1, 2))
                groups += [g for g in ((a, right, right, both), (both, d, both, d)) if g[1] > g[0] and g[3] > g[2]]
            if groups:
                yield from verify(table, masks, side, band, groups, longer, length)

    def verify(table, masks, side, band, groups, longer, length) -> Iterator[pa.RecordBatch]:
        first, last = groups[0][0], max(g[3] for g in groups)
        words = table.column("word").slice(first, last - first).to_pylist()
        matrix = np.zeros((2, len(words)), dtype=np.int64)  # a word's row in the letters of its length
        lengths = np.array([len(w) for w in words])
        own = [_letters([w for w in words if len(w) == length + k], length + k) for k in range(longer + 1)]
        for k in range(longer + 1):
            at = lengths == length + k
            matrix[k, at] = np.arange(at.sum())
        for a, b in _candidates(masks, groups, 1 if longer else 2):
            if not longer:  # once: in one order among themselves, and in the first band that is equal
                differ = masks[a] ^ masks[b]
                keep = (side[a] != 2) | (a < b)
                for k in (1, 2):
                    for before in range(k):
                        keep &= (band[a] != k) | (differ & np.uint64(parts[before]) != 0)
                a, b = a[keep], b[keep]
            for i in range(0, len(a), step := max(1, 8_000_000 // (length + 1))):
                x, y = a[i : i + step], b[i : i + step]
                near = _one_edit(own[0][matrix[0, x - first]], own[longer][matrix[longer, y - first]])
                x, y = pa.array(x[near]), pa.array(y[near])
                if len(x):
                    yield pa.RecordBatch.from_arrays([_take(table, "word", x), _take(table, "n", x), _take(table, "word", y), _take(table, "n", y)], names=["a", "n_a", "b", "n_b"])

    def _take(table: pa.Table, column: str, at: pa.Array) -> pa.Array:
        return table.column(column).combine_chunks().take(at)

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each pair of words that one inserted, deleted or replaced letter turns into each other, once.

    words (word, n) has distinct words of the letters that count_words() gives, and is read twice.
    """
    parts, block = bands(), BLOCK
    kept = [*parts, *(sum(parts) - b for b in parts)]  # a band alone, or both others
    rows = words.select("word", "n", parity_mask(F.col("word")).alias("mask"), F.char_length("word").alias("length"))
    key = lambda k, letters, side: F.struct(letters.alias("letters"), F.lit(k).alias("band"), F.col("mask").bitwiseAND(F.lit(kept[k])).alias("value"), F.lit(side).alias("side"))
    keys = [*(key(k, F.col("length"), 2) for k in range(3)), *(key(k, F.col("length"), 0) for k in range(3, 6)), *(key(k, F.col("length") - 1, 1) for k in range(3, 6))]
    keyed = rows.select("word", "n", "mask", F.inline(F.array(*keys)))
    own = ["letters", "band", "value"]
    sizes = keyed.groupBy(*own).agg(F.count_if(F.col("side") != 1).alias("left"), F.count_if(F.col("side") != 0).alias("right")).where((F.greatest("left", "right") > block) & (F.least("left", "right") > 0))
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    dealt = keyed.join(sizes.select(*own, blocks("left").alias("rows"), blocks("right").alias("columns")), own, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("rows", "columns")})
    number = F.pmod(F.xxhash64("word"), F.when(F.col("side") == 1, F.col("columns")).otherwise(F.col("rows"))).cast("int")
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    cells = (
        F.when(F.col("side") == 0, F.transform(upto("columns"), lambda j: cell(F.col("at"), j, F.lit(0))))
        .when(F.col("side") == 1, F.transform(upto("rows"), lambda i: cell(i, F.col("at"), F.lit(1))))
        .otherwise(F.transform(upto("rows"), lambda k: cell(F.least("at", k), F.greatest("at", k), F.when(k > F.col("at"), 0).when(k < F.col("at"), 1).otherwise(2))))
    )
    placed = dealt.withColumn("at", number).select("word", "n", "mask", *own, F.inline(cells))
    spark = words.sparkSession
    order = [*own, "i", "j"]
    together = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order, "side")
    return together.mapInArrow(_compare(parts), "a string, n_a long, b string, n_b long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for each (word, form): the last word that following forms leads to.

    Each round doubles the steps taken.  A form occurs several times as often as its word, so chains are short and have no circles.
    """
    now = storage.materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = storage.materialise(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        storage.release_table(now)
        now = joined.select("word", "root")
        if not joined.where("moved").limit(1).count():
            return now


def group_variants(docs: DataFrame, *, least_letters: int = 6, least_count: int = 5, ratio: int = 5, every: int = 199) -> DataFrame:
    """Per word of count_words(): word, n, n_near, form, form_n, root.

    n_near: words that differ by one inserted, deleted or replaced letter.  form: the one of these with
    the largest n, of several the first by code points, if it occurs at least ratio times as often as
    the word; else null, as form_n.  root: where following forms ends, or the word itself.  Only doc_id and text
    are read; an empty table gives an empty table.
    """
    words = storage.materialise(count_words(docs, least_letters=least_letters, least_count=least_count, every=every), "words")
    pairs = near_pairs(words)
    way = lambda a, b: F.struct(F.col(a).alias("word"), F.col(f"n_{a}").alias("n"), F.col(b).alias("near"), F.col(f"n_{b}").alias("near_n"))
    links = pairs.select(F.inline(F.array(way("a", "b"), way("b", "a"))))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    found = links.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = -F.col("best.less") >= ratio * F.col("n")
    found = found.select("word", "n_near", F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
    found = storage.materialise(found, "variants")
    ends = roots(found.where("form is not null"))
    out = words.join(found, "word", "left").join(ends, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
