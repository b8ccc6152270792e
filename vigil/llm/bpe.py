"""Byte-level BPE over a corpus: every distinct pre-token is encoded once.

A scan turns each block of documents into the list of its distinct pre-tokens and, for each
document, the positions of these in the text as slot numbers.  The distinct pre-tokens go in
one shuffle to buckets by hash, so that all occurrences of a word meet; a bucket encodes each of
its words once.  The ids return to their block, where they are joined to the slots in order of
position.  What is shuffled grows with the distinct words of the blocks, not with the tokens, and
a word that stands everywhere is one entry a block.
"""

from __future__ import annotations

import base64
import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import storage

#: Bytes of text in a block; a longer document is a block alone.
BLOCK_BYTES = 10_000_000
#: Below it, all versions of Unicode agree on what letters are.
_HIGH = re.compile("[\u0530-\U0010ffff]").search
_AMBIGUOUS = re.compile(r"\s (?:\s|\Z)")
_BLOCK_SCHEMA = "block long, bucket int, docs array<long>, counts array<int>, payload array<binary>"
_BLOCK_TYPES = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()))


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _pack(array: np.ndarray) -> bytes:
    """Integers, compressed by byte planes."""
    return zstandard.compress(np.ascontiguousarray(array.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


#: Ranks below SHORT take one byte, most others two, and the rest have their upper part aside.
_SHORT = 192


def _pack_ranks(ranks: np.ndarray) -> list[bytes]:
    """Numbers that are mostly small, in three streams."""
    over = ranks.astype(np.int64) - _SHORT
    upper = over >> 8
    head = np.where(over < 0, ranks, _SHORT + np.minimum(upper, 255 - _SHORT)).astype(np.uint8)
    low = (over[over >= 0] & 255).astype(np.uint8)
    return [zstandard.compress(head.tobytes(), 6), zstandard.compress(low.tobytes(), 6), _pack(upper[upper >= 255 - _SHORT])]


def _unpack_ranks(parts: list[bytes]) -> np.ndarray:
    head = np.frombuffer(zstandard.decompress(parts[0]), dtype=np.uint8).astype(np.int64)
    long = np.flatnonzero(head >= _SHORT)
    upper = head[long] - _SHORT
    upper[upper == 255 - _SHORT] = _unpack(parts[2])
    head[long] = _SHORT + (upper << 8) + np.frombuffer(zstandard.decompress(parts[1]), dtype=np.uint8)
    return head


def _pack_words(words: list[bytes]) -> list[bytes]:
    """Words, each without the start that it shares with the one before."""
    shared, rests, before = np.zeros(len(words), dtype="<u4"), [], b""
    for i, word in enumerate(words):
        n = 0
        for x, y in zip(before, word, strict=False):
            if x != y:
                break
            n += 1
        shared[i] = n
        rests.append(word[n:])
        before = word
    return [_pack(shared), _pack(np.fromiter(map(len, rests), dtype=np.int64, count=len(rests))), zstandard.compress(b"".join(rests), 6)]


def _unpack_words(parts: list[bytes]) -> Iterator[bytes]:
    rests, at, word = zstandard.decompress(parts[2]), 0, b""
    for n, size in zip(_unpack(parts[0]).tolist(), _unpack(parts[1]).tolist(), strict=True):
        word = word[:n] + rests[at : at + size]
        at += size
        yield word


@functools.cache
def _newer_letters() -> re.Pattern:
    """Letters and numbers of a newer Unicode than tiktoken's, which takes them for neither."""
    ranks = {bytes([i]): i for i in range(256)} | {b"a" + bytes([i]): 256 + i for i in range(256)}
    # Here a and the first byte of a character become one token only if the pattern keeps them together.
    probe = tiktoken.Encoding("probe", pat_str=r"a[\p{L}\p{N}]|[\s\S]", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    here = regex.compile(r"[\p{L}\p{N}]").match
    unassigned = (chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cn")
    found = [c for c in unassigned if here(c) and len(probe("a" + c)) > len(c.encode())]
    starts = [c for c, before in zip(found, ["", *found], strict=False) if not before or ord(c) != ord(before) + 1]
    ends = [c for c, after in zip(found, [*found[1:], ""], strict=True) if not after or ord(after) != ord(c) + 1]
    return re.compile(f"[{''.join(f'{a}-{b}' for a, b in zip(starts, ends, strict=True))}]" if found else r"(?!)")


def splitter(pattern: str):
    """The pre-tokens of a text, as tiktoken finds them."""
    plain = regex.compile(pattern)

    def split(text: str) -> list[str]:
        if text.isascii() or not _HIGH(text) or not _newer_letters().search(text):
            return plain.findall(text)
        return [text[m.start() : m.end()] for m in plain.finditer(_newer_letters().sub("\ue000", text))]

    return split


class _Slots(dict):
    """Pre-token to slot, numbered as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class _Chunks(dict):
    """A text between two spaces, with the space before it, to the slots of its pre-tokens.

    A pre-token never reaches over a space that has no white space on one of its sides, but at its start.
    """

    def __init__(self, split, slots: _Slots):
        super().__init__()
        self.split, self.slots = split, slots

    def __missing__(self, chunk: str) -> bytes:
        self[chunk] = out = np.array([self.slots[w] for w in self.split(" " + chunk)], dtype="<u4").tobytes()
        return out


def _slots_of(text: str, split, slots: _Slots, chunks: _Chunks) -> bytes:
    if _AMBIGUOUS.search(text):
        return np.array([slots[w] for w in split(text)], dtype="<u4").tobytes()
    head, *rest = text.split(" ")
    return np.array([slots[w] for w in split(head)], dtype="<u4").tobytes() + b"".join(map(chunks.__getitem__, rest))


def _to_blocks(pattern: str, n_buckets: int):
    split = splitter(pattern)

    def flush(number: int, docs: list, streams: list[bytes], slots: _Slots) -> pa.RecordBatch:
        """Row -1 of a block has the documents; the others have the words of one bucket each.

        Slots are ranked by count, bucket and word.  A bucket's words stand in the same order, so
        the buckets of the ranks are all that is needed to put their ids in place.
        """
        words = [w.encode() for w in slots]
        stream = np.frombuffer(b"".join(streams), dtype="<u4")
        counts = np.bincount(stream, minlength=len(words))
        buckets = np.fromiter((zlib.crc32(w) % n_buckets for w in words), dtype=np.int64, count=len(words))
        order = np.lexsort((np.argsort(np.argsort(np.array(words, dtype=object))), buckets, -counts)) if words else np.empty(0, dtype=np.int64)
        rank = np.empty(len(words), dtype=np.int64)
        rank[order] = np.arange(len(words))
        ranked = buckets[order]
        number += TaskContext.get().partitionId() << 32
        rows = [(number, -1, docs, [len(s) // 4 for s in streams], [_pack(ranked), *_pack_ranks(rank[stream])])]
        by_bucket = np.argsort(ranked, kind="stable")
        for mine in np.split(by_bucket, np.flatnonzero(np.diff(ranked[by_bucket])) + 1) if words else ():
            rows.append((number, int(ranked[mine[0]]), None, None, _pack_words([words[i] for i in order[mine].tolist()])))
        return pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*rows, strict=True), _BLOCK_TYPES, strict=True)], names=["block", "bucket", "docs", "counts", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, docs, streams, size, slots = 0, [], [], 0, _Slots()
        chunks = _Chunks(split, slots)
        for batch in (whole.slice(i, 200) for whole in batches for i in range(0, whole.num_rows, 200)):
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append(row)
                streams.append(_slots_of(text or "", split, slots, chunks))
                size += len(text or "")
                if size >= BLOCK_BYTES:
                    del chunks
                    yield flush(number, docs, streams, slots)
                    number, docs, streams, size, slots = number + 1, [], [], 0, _Slots()
                    chunks = _Chunks(split, slots)
        del chunks
        if docs:
            yield flush(number, docs, streams, slots)

    return run


def _encode_bucket(ranks_broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A pattern that takes the whole string, since the words are pre-tokens already.
        encode = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks_broadcast.value, special_tokens={}).encode_ordinary
        known: dict[bytes, bytes] = {}
        bucket = None
        for batch in batches:
            out = []
            for b, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if b != bucket:
                    bucket, known = b, {}
                lengths, ids = [], []
                for word in _unpack_words(payload):
                    if (got := known.get(word)) is None:
                        known[word] = got = np.array(encode(word.decode()), dtype="<u4").tobytes()
                    lengths.append(len(got) // 4)
                    ids.append(got)
                out.append([_pack(np.array(lengths)), _pack(np.frombuffer(b"".join(ids), dtype="<u4"))])
            yield batch.set_column(batch.schema.get_field_index("payload"), "payload", pa.array(out, type=_BLOCK_TYPES[-1]))

    return run


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """The pieces flat[starts[p]:starts[p]+lengths[p]] for every p of picks, one after another."""
    n = lengths[picks]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[picks] - (ends - n), n) + np.arange(total)]


def _reassemble(table: pa.Table, tokens: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> pa.Table:
    """One block: its documents' slots, and the ids of its words from all buckets; with token bytes also decoded."""
    rows = dict(zip(table.column("bucket").to_pylist(), table.column("payload").to_pylist(), strict=True))
    main = table.filter(pc.equal(table.column("bucket"), -1))
    ranked, *stream = rows.pop(-1)
    ranked, stream = _unpack(ranked), _unpack_ranks(stream)
    lengths, starts, flat, base = np.zeros(len(ranked), dtype=np.int64), np.zeros(len(ranked), dtype=np.int64), [], 0
    for bucket, (sizes, ids) in rows.items():
        mine, sizes = ranked == bucket, _unpack(sizes).astype(np.int64)
        lengths[mine], starts[mine] = sizes, base + np.cumsum(sizes) - sizes
        flat.append(_unpack(ids))
        base += len(flat[-1])
    flat = np.concatenate(flat) if flat else np.empty(0, dtype="<u4")
    docs, ids, decoded, at = main.column("docs")[0].as_py(), [], [], 0
    for n in main.column("counts")[0].as_py():
        own = gather(flat, starts, lengths, stream[at : at + n])
        ids.append(own.tobytes())
        at += n
        if tokens:
            decoded.append(gather(*tokens, own).tobytes())
    out = {"doc_id": pa.array(docs, pa.int64()), "ids": pa.array(ids, pa.binary())}
    return pa.table(out | ({"decoded": pa.array(decoded, pa.binary())} if tokens else {}))


def _token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in order of their ids, and where each begins and how long it is."""
    by_id = {i: token for token, i in ranks.items()}
    tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, with_decoded: bool = False) -> DataFrame:
    """Token ids of every document: doc_id, ids (little-endian unsigned 32-bit integers).

    with_decoded adds what decode() would add, in the same task.

    A null text counts as empty and an empty text has no ids.  Every input row gives one row, so
    repeated rows and rows without doc_id are kept; further columns are ignored.  An empty table
    gives an empty table.  Texts are never cut; one document is always in one block.
    """
    spark = docs.sparkSession
    n_buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))  # the vocabulary file: fixed size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = storage.materialise(rows.mapInArrow(_to_blocks(pattern, n_buckets), _BLOCK_SCHEMA), "bpe")
    words = blocks.where("bucket >= 0").repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
    both = blocks.where("bucket < 0").unionByName(words.mapInArrow(_encode_bucket(ranks), _BLOCK_SCHEMA))

    def join(table: pa.Table) -> pa.Table:
        return _reassemble(table, _token_bytes(ranks.value) if with_decoded else None)

    return both.groupBy("block").applyInArrow(join, "doc_id long, ids binary" + ", decoded binary" * with_decoded)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds decoded, the bytes of ids, by a join with the table of token bytes.

    The table has one row for each id of the vocabulary file, so its size is fixed; it is sent to
    all executors, and each document's ids pick their rows in order.
    """
    spark = encoded.sparkSession
    table = spark.sparkContext.broadcast(_token_bytes(read_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                decoded = [gather(*table.value, np.frombuffer(x, dtype="<u4")).tobytes() for x in part.column("ids").to_pylist()]
                yield part.append_column("decoded", pa.array(decoded, pa.binary()))

    return encoded.mapInArrow(run, encoded.selectExpr("*", "cast(null as binary) decoded").schema)
