"""Word boundaries and word hashes of many texts at once, as numpy arrays over one Arrow column.

A word is a maximal run of bytes other than space and U+0009 to U+000D.  Those separators are
single bytes in UTF-8, so the byte view finds the same words as the character view.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[ord("A") : ord("Z") + 1] += 32

#: Bytes of text whose arrays are held in memory together; one longer document is a block alone.
BLOCK_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Words of up to this many bytes fit a 128-bit block with their length.
_SHORT = 15
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_ROUNDS = tuple(np.uint64(int.from_bytes(hashlib.blake2b(bytes([k]), digest_size=8).digest(), "little")) for k in range(6))


def word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The halves of a 128-bit digest of every word, as two rows.

    The bytes and the length of a short word are a block, and its digest is a permutation of that, so
    two short words never share both halves.  Longer words take BLAKE2b, each distinct one once.
    """
    sizes = ends - starts
    padded = np.zeros(len(data) + 16, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 9,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place
    short = np.minimum(sizes, _SHORT)
    low = eight[starts] & _MASKS[np.minimum(short, 8)]
    high = eight[starts + np.minimum(8, sizes)] & _MASKS[np.maximum(short, 8) - 8] | short.astype(np.uint64) << np.uint64(56)
    for a, b in zip(_ROUNDS[::2], _ROUNDS[1::2], strict=True):
        low = low + mix(high ^ a)
        high = high + mix(low ^ b)
    out = np.stack([low, high])
    long = np.flatnonzero(sizes > _SHORT)
    if len(long):
        offsets = np.zeros(len(long) + 1, dtype=np.int64)
        np.cumsum(sizes[long], out=offsets[1:])
        letters = data[np.arange(offsets[-1]) + np.repeat(starts[long] - offsets[:-1], sizes[long])]
        words = pa.Array.from_buffers(pa.large_binary(), len(long), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        table = b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in words.dictionary.to_pylist()])
        out[:, long] = np.frombuffer(table, dtype="<u8").reshape(-1, 2)[words.indices.to_numpy()].T
    return out


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0x9FB21C651E98DF25) + right)


def windows_hash(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of hashes[i:i+length] for every i, by doubling; windows may run over document borders."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, done, part, size = None, 0, hashes, 1
    while done < length:
        if length & size:
            here = part[done : done + n]
            out, done = here if out is None else _pair(out, here), done + size
        if done < length:
            part, size = _pair(part[:-size], part[size:]), 2 * size
    return out


@dataclass
class Words:
    """The words of some documents.  Document i has words first[i] to first[i+1]."""

    data: np.ndarray  # the documents' bytes
    offsets: np.ndarray  # document borders in data
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @functools.cached_property
    def digests(self) -> np.ndarray:
        return word_digests(self.data, self.starts, self.ends)

    def hashes(self, half: int = 0) -> np.ndarray:
        """One half of each word's digest; the halves are independent of each other."""
        return self.digests[half]

    def joined(self, doc: int, keep: np.ndarray | None = None) -> bytes:
        """A document's words (those marked in keep, one mark a word), with one space between them."""
        a, b = self.first[doc], self.first[doc + 1]
        pick = slice(a, b) if keep is None else np.flatnonzero(keep) + a
        raw, s, e = self.data, self.starts[pick], self.ends[pick]
        return b" ".join([raw[i:j].tobytes() for i, j in zip(s.tolist(), e.tolist(), strict=True)])


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row borders; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> Words:
    word = ~separator[data]
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner], after[inner - 1] = False, False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def word_blocks(column: pa.Array | pa.ChunkedArray, *, lower: bool = False, limit: int = BLOCK_BYTES, separator: np.ndarray = SEPARATOR) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words), covering the column in order."""
    data, offsets = column_bytes(column)
    for i, j in blocks(offsets, limit):
        part = data[offsets[i] : offsets[j]]
        yield i, j, find_words(LOWER_ASCII[part] if lower else part, offsets[i : j + 1] - offsets[i], separator)
