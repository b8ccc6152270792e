"""Best-fit packing of token sequences by hierarchical residual packing.

Each input partition turns its documents into token counts and packs these best-fit decreasing,
locally and without a shuffle.  Bins that are full but for a few tokens are final.  The others go
on as items, one row a bin, to ever fewer groups, where best-fit packs them again, until one group
is left or packing gains nothing.  Only underfull bins are ever shuffled, and no group holds more
than a fixed number of them.
"""

from __future__ import annotations

import bisect
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import storage

_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("offset", pa.int32())])
_BINS = pa.schema([("bin", pa.int64()), ("fill", pa.int32()), ("done", pa.bool_()), ("members", pa.list_(_MEMBER))])
_BINS_DDL = "bin long, fill int, done boolean, members array<struct<doc_id: long, piece: int, start: long, length: int, ids_crc32: long, offset: int>>"
#: Bins in a group of one round at most; pieces that a partition packs together at most.
GROUP_BINS, LOCAL_PIECES = 50_000, 200_000
FAN_IN = 8
#: Below it, all versions of Unicode agree on what letters are and on their lower case.
_SETTLED = "\u0530"
#: Entries of a worker's word tables, which are emptied beyond it.
KNOWN = 400_000


def _byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the rest for U+0100 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """A normalised word to its ids."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KNOWN:
            self.clear()
        tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        self[word] = out = np.array([t.id for t in tokens], dtype="<u4").tobytes()
        return out


class WordTokenizer(dict):
    """Ids of texts by a word-level BPE file of the tokenizers library, with add_special_tokens=False.

    White space only separates words there, so the ids of a text are those of its chunks between
    white space; each chunk is encoded when it first comes, and each of its words likewise.
    Chunks and texts whose normal form depends on more than that go through the library whole,
    and so do texts with the content of an added token, which the library gives that token's id.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(self.tokenizer.model)
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.odd = regex.compile(r"[\x1c-\x1f]").search
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= KNOWN:
            self.clear()
        if (chunk.isascii() or max(chunk) < _SETTLED and "Σ" not in chunk and unicodedata.is_normalized("NFC", chunk)) and len(chunk) < 1000:
            out = b"".join([self.words[w] for w in self.split(chunk.lower())])
        else:
            out = self.whole(chunk)
        self[chunk] = out
        return out

    def ids(self, text: str) -> bytes:
        return self.whole(text) if self.odd(text) or any(t in text for t in self.added) else b"".join(map(self.__getitem__, text.split()))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: for each size its bin (from 0) and its place in it.  Ties go in input order."""
    bins, places = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by the room they have left
    rooms: list[int] = []  # the sorted rooms that open bins have
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        k = bisect.bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                del rooms[k]
        else:
            b, room, n = n, capacity, n + 1
        bins[i], places[i] = b, capacity - room
        left = room - size
        if left:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins, places


def _bins(items: list[tuple[int, list[dict]]], capacity: int, slack: int, first_id: int) -> pa.Table:
    """Packs items (size, members) and returns a row for each bin."""
    bins, places = best_fit(np.fromiter((n for n, _ in items), dtype=np.int64, count=len(items)), capacity)
    fill = np.zeros(int(bins.max()) + 1 if len(bins) else 0, dtype=np.int64)
    members: list[list[dict]] = [[] for _ in fill]
    for (size, own), b, place in zip(items, bins.tolist(), places.tolist(), strict=True):
        fill[b] += size
        members[b] += own if not place else [m | {"offset": m["offset"] + place} for m in own]
    return pa.table({"bin": first_id + np.arange(len(fill)), "fill": fill.astype(np.int32), "done": fill > capacity - slack, "members": pa.array(members, pa.list_(_MEMBER))}, schema=_BINS)


def _pack_locally(path: str, capacity: int, end_id: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, items, first = WordTokenizer(path), [], TaskContext.get().partitionId() << 32
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tokenizer.ids(text or "") + end
                for piece, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    n = len(part) // 4
                    items.append((n, [{"doc_id": doc_id, "piece": piece, "start": at, "length": n, "ids_crc32": zlib.crc32(part), "offset": 0}]))
            if len(items) >= LOCAL_PIECES:
                done = _bins(items, capacity, slack, first)
                first, items = first + done.num_rows, []
                yield from done.to_batches()
        if items:
            yield from _bins(items, capacity, slack, first).to_batches()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1, slack: int = 16) -> DataFrame:
    """Packs every document's tokens into sequences of at most capacity tokens.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    A document is its ids and then end_id, so that a null or empty text is one piece of one token.
    Only documents above capacity are cut, into pieces of capacity tokens and a rest.  Repeated
    rows are packed each on its own, rows without doc_id too; further columns are ignored; an
    empty table gives an empty table.  Which of several equally long pieces goes where is open,
    but the written rounds fix it, so that a lost executor cannot place a piece twice.
    slack: a bin with less room than that is final, and is the only space given up knowingly.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rounds = [storage.materialise(rows.mapInArrow(_pack_locally(tokenizer_path, capacity, end_id, slack), _BINS_DDL), "pack")]
    groups, before, last = None, None, False
    while not last:
        left = rounds[-1].where("not done")
        n = left.count()
        groups = max(-(-n // GROUP_BINS), 1 if groups is None else -(-groups // FAN_IN))
        if groups == 1 or before is not None and n > 0.98 * before and groups == -(-n // GROUP_BINS):
            last = True
        if not n:
            break
        rounds.append(storage.materialise(_pack_again(left, groups, capacity, 0 if not last else capacity + 1, slack, len(rounds)), "pack"))
        before = n
    out = rounds[0].where("done")
    for later in rounds[1:]:
        out = out.unionByName(later.where("done"))
    return out.select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m")).select(
        "m.doc_id", "m.piece", "m.start", F.col("m.length").cast("long").alias("length"), "m.ids_crc32", "sequence_id", F.col("m.offset").cast("long").alias("offset")
    )


def _pack_again(left: DataFrame, groups: int, capacity: int, all_from: int, slack: int, number: int) -> DataFrame:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = table.sort_by("bin")
        items = list(zip(order.column("fill").to_pylist(), order.column("members").to_pylist(), strict=True))
        return _bins(items, capacity, all_from or slack, (number << 56) + (key[0].as_py() << 32))

    return left.groupBy(F.pmod(F.xxhash64("bin"), F.lit(groups)).alias("g")).applyInArrow(run, _BINS_DDL)
