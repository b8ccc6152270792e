"""Packing of token sequences by minimum bin slack.

A task holds the remaining pieces as a multiset of lengths.  For each sequence it takes the longest piece, and a bitset of all sums
that the other lengths can make up, built length by length with their counts in powers of two, tells which multiset of
lengths leaves the least room; the counts are read off the bitsets backwards.  The choice is used again as long as the counts
allow it.  Room that no multiset fills is filled by the front of one more piece, whose rest stays.

What a task cannot fill, less than one sequence, goes on with its ids to groups of tasks and then to groups of groups, and is packed
there in the same way.  The very last remainder is cut at powers of two, at which sequences are not padded.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import storage
from .packing import _byte_letters

#: Tokens of the pieces that a task packs together; tasks or groups of them whose rests are packed together.
WINDOW_TOKENS, FAN_IN = 4_000_000, 256
_ROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.int32()), ("ids", pa.binary()),
])
_ROW_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source int, ids binary"

#: (doc_id, start, ids as little-endian 32-bit integers, tokens of the document)
Piece = tuple[int | None, int, bytes, int]


class ByteTokenizer:
    """Ids of texts by a byte-level BPE file of the tokenizers library, with add_special_tokens=False.

    Merges of such a file are in the order of their ids, so its vocabulary serves as ranks, which are merged faster; the literal
    content of an added token takes that token's id in both.  Texts that this way cannot split (very long white space) go
    through the library.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            written = json.load(file)
        added = {t["content"]: t["id"] for t in written["added_tokens"]}
        letters = {letter: byte for byte, letter in _byte_letters().items()}
        ranks = {bytes(letters[c] for c in token): i for token, i in written["model"]["vocab"].items() if token not in added}
        self.library = Tokenizer.from_file(path)
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def ids(self, text: str) -> bytes:
        try:
            ids = self.ranks.encode(text, allowed_special="all")
        except ValueError:
            ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()


def least_slack(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (at most counts of each) whose sum is nearest to room from below, longer ones first."""
    reach, goal, all_sums, steps = 1, 1 << room, (1 << room + 1) - 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left and not reach & goal:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= reach << length * part & all_sums
            left, part = left - part, 2 * part
        if reach & goal:
            break
    at, chosen = reach.bit_length() - 1, defaultdict(int)
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] += part
            at -= length * part
    return dict(chosen)


class Window:
    """The remaining pieces by length, none longer than capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.tokens = capacity, 0
        self.pieces: dict[int, list[Piece]] = defaultdict(list)

    def add(self, piece: Piece) -> None:
        self.pieces[len(piece[2]) // 4].append(piece)
        self.tokens += len(piece[2]) // 4

    def _take(self, length: int) -> Piece:
        own = self.pieces[length]
        piece = own.pop()
        if not own:
            del self.pieces[length]
        self.tokens -= length
        return piece

    def sequences(self) -> Iterator[list[Piece]]:
        """Full sequences, until less than capacity remains."""
        while self.tokens >= self.capacity:
            longest = max(self.pieces)
            counts = {n: len(p) for n, p in self.pieces.items()}
            counts[longest] -= 1
            chosen = least_slack(counts, self.capacity - longest)
            gap = self.capacity - longest - sum(n * c for n, c in chosen.items())
            chosen[longest] = chosen.get(longest, 0) + 1
            # With a gap, the front of one more piece is cut off, and the counts are others afterwards.
            for _ in range(1 if gap else min(len(self.pieces[n]) // c for n, c in chosen.items())):
                sequence = [self._take(n) for n, c in chosen.items() for _ in range(c)]
                if gap:
                    doc_id, start, ids, n = self._take(max(self.pieces))
                    sequence.append((doc_id, start, ids[: 4 * gap], n))
                    self.add((doc_id, start + gap, ids[4 * gap :], n))
                yield sequence

    def rest(self) -> list[Piece]:
        return [p for n in sorted(self.pieces, reverse=True) for p in self.pieces[n]]


def powers_of_two(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """Cuts pieces into sequences that each have a power of two of tokens, the largest first."""
    left = sum(len(p[2]) // 4 for p in pieces)
    pieces = pieces[::-1]
    while left:
        size = 1 << left.bit_length() - 1
        left, sequence = left - size, []
        while size:
            doc_id, start, ids, n = pieces.pop()
            here = min(size, len(ids) // 4)
            sequence.append((doc_id, start, ids[: 4 * here], n))
            if 4 * here < len(ids):
                pieces.append((doc_id, start + here, ids[4 * here :], n))
            size -= here
        yield sequence


class _Rows:
    """Rows of sequences numbered from first, and of pieces without one, in batches."""

    def __init__(self, first: int, source: int):
        self.next, self.source, self.rows = first, source, []

    def sequence(self, pieces: list[Piece]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, self.next, offset, self.source, None))
            offset += len(ids) // 4
        self.next += 1

    def remainder(self, pieces: list[Piece]) -> None:
        self.rows += [(doc_id, start, len(ids) // 4, None, n, None, None, self.source, ids) for doc_id, start, ids, n in pieces]

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) or [[] for _ in _ROW]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROW, strict=True)], schema=_ROW)


def _pack(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, window, task = ByteTokenizer(path), Window(capacity), TaskContext.get().partitionId()
        end, out = np.array([end_id], dtype="<u4").tobytes(), _Rows(task << 36, task)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tokenizer.ids(text or "") + end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    window.add((doc_id, at, ids[4 * at : 4 * (at + capacity)], n))
                if window.tokens >= WINDOW_TOKENS:
                    for sequence in window.sequences():
                        out.sequence(sequence)
                    yield out.batch()
        for sequence in window.sequences():
            out.sequence(sequence)
        out.remainder(window.rest())
        yield out.batch()

    return run


def _pack_rests(capacity: int, level: int, last: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        group, window = key[0].as_py(), Window(capacity)
        out = _Rows((level << 60) + (group << 36), group)
        order = table.sort_by([("source", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        for doc_id, start, ids, n in zip(*(order.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
            window.add((doc_id, start, ids, n))
        for sequence in window.sequences():
            out.sequence(sequence)
        if last:
            for sequence in powers_of_two(window.rest()):
                out.sequence(sequence)
        else:
            out.remainder(window.rest())
        return pa.Table.from_batches([out.batch()])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Packs every document's tokens into sequences of at most capacity (a power of two) tokens, without padding.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  All sequences are full but for a few of
    the last task, whose lengths are different powers of two.  A document is its ids and then end_id, so that a null or
    empty text is one token.  Documents above capacity are cut into pieces of it and a rest; besides, a piece is cut where
    nothing else fills a sequence.  Repeated rows are packed each on its own, rows without doc_id too; further columns are
    ignored; an empty table gives an empty table.  Each level is written before the next one reads it, so that a lost executor cannot place a piece twice.
    """
    if capacity & capacity - 1:
        raise ValueError("capacity must be a power of two")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    levels = [storage.materialise(rows.mapInArrow(_pack(tokenizer_path, capacity, end_id), _ROW_DDL), "slack")]
    while True:
        left = levels[-1].where("sequence_id is null")
        sources = (left.agg(F.max("source")).first()[0] or 0) + 1
        last = sources <= FAN_IN
        grouped = left.groupBy(F.expr(f"source div {FAN_IN}").alias("group"))
        levels.append(storage.materialise(grouped.applyInArrow(_pack_rests(capacity, len(levels), last), _ROW_DDL), "slack"))
        if last:
            break
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.where("sequence_id is not null").drop("source", "ids")
