"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is good or bad.  Its score comes from its own features and those of the
lines before and after it, and a transition score links neighbours.  Forward-backward gives
each line's marginal; a document's quality is the mean of these, weighted by length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textblocks import Words, column_bytes, find_words, blocks, mix

FEATURES = ("length", "words", "word_length", "upper", "digits", "symbols", "stops", "symbol_ends", "distinct", "same_as_last", "repeated_line", "non_ascii", "alone")
#: Classes of bytes.
_LOWER, _UPPER, _DIGIT, _STOP, _SYMBOL, _LEAD, _OTHER = range(7)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[0x21:0x7F] = _SYMBOL
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = _LOWER, _UPPER, _DIGIT
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = _STOP
_CLASS[0xC0:] = _LEAD
_BINS = 10


def _repeats(group: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether an equal hash stands in the same group before."""
    key = mix(hashes + (group.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    out = np.ones(len(key), dtype=bool)
    out[np.unique(key, return_index=True)[1]] = False
    return out


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every line with a word: its document, its length in bytes, its features, and its place among all lines of the document."""
    none = np.empty(0, dtype=np.int64)
    empty = none, none, np.empty((0, len(FEATURES)), dtype=np.float32), none
    words: Words = find_words(data, offsets)
    if not len(words.starts):
        return empty
    breaks = np.flatnonzero(data == 10) + 1
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks[breaks < len(data)]]))
    line_starts = line_starts[line_starts < len(data)]
    line_of_word = np.searchsorted(line_starts, words.starts, side="right") - 1
    lines, first_word, n_words = np.unique(line_of_word, return_index=True, return_counts=True)
    line = np.repeat(np.arange(len(lines)), n_words)
    doc = np.searchsorted(offsets, line_starts[lines], side="right") - 1
    start, end = words.starts[first_word], words.ends[first_word + n_words - 1]
    kinds = _CLASS[data]
    count = lambda kind: np.diff(np.concatenate([[0], np.cumsum(kinds == kind, dtype=np.int64)])[np.stack([start, end], axis=1)], axis=1)[:, 0]
    lower, upper, digits, stops, symbols, lead = map(count, range(6))
    seen = np.maximum(1, lower + upper + digits + stops + symbols + lead)
    hashes = words.hashes()
    last = np.zeros(len(hashes), dtype=bool)
    last[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    per_line = lambda x: np.bincount(line, weights=x, minlength=len(lines)) / n_words
    ends = data[words.ends - 1]
    before = data[np.maximum(words.ends - 2, words.starts)]
    odd_end = (_CLASS[ends] == _SYMBOL) | (ends == before) & (_CLASS[ends] == _STOP)
    line_hash = np.zeros(len(lines), dtype=np.uint64)
    np.add.at(line_hash, line, hashes * mix(np.arange(len(hashes), dtype=np.uint64) - first_word.astype(np.uint64)[line] + np.uint64(7)))
    n_lines = np.bincount(doc, minlength=len(offsets) - 1)[doc]
    columns = [np.log1p(end - start), np.log1p(n_words), (seen / n_words), upper / np.maximum(1, lower + upper), digits / seen, symbols / seen, stops / seen, per_line(odd_end), 1 - per_line(_repeats(line, hashes)), per_line(last), _repeats(doc, line_hash), lead / seen, n_lines == 1]
    return doc, end - start, np.stack(columns, axis=1).astype(np.float32), lines - np.searchsorted(line_starts, offsets[:-1])[doc]


def _neighbours(doc: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """A line's bins, those of the line before and of the line after; without one the bin is that of no line."""
    n = bins.shape[1]
    out = np.full((len(bins), 3 * n), _BINS, dtype=np.int64)
    out[:, :n] = bins
    same = doc[1:] == doc[:-1]
    out[1:, n : 2 * n][same] = bins[:-1][same]
    out[:-1, 2 * n :][same] = bins[1:][same]
    return out + np.arange(3 * n) * (_BINS + 1)


class _Chain:
    """Documents' lines laid out by place, so that one step handles all documents at once."""

    def __init__(self, doc: np.ndarray):
        first = np.ones(len(doc), dtype=bool)
        first[1:] = doc[1:] != doc[:-1]
        self.starts = np.flatnonzero(first)
        lengths = np.diff(np.append(self.starts, len(doc)))
        order = np.argsort(-lengths, kind="stable")
        self.starts, lengths = self.starts[order], lengths[order]
        self.active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right").tolist()
        self.inner = np.flatnonzero(~first[1:]) if len(doc) else first

    def messages(self, score: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of good against bad from the lines up to each one, and from those after it."""
        ahead, back = np.array(score, dtype=float), np.zeros(len(score))
        for place in range(1, len(self.active)):
            at = self.starts[: self.active[place]] + place
            a = ahead[at - 1]
            ahead[at] += np.logaddexp(t[1, 1] + a, t[0, 1]) - np.logaddexp(t[1, 0] + a, t[0, 0])
        for place in range(len(self.active) - 2, -1, -1):
            at = self.starts[: self.active[place + 1]] + place
            b = score[at + 1] + back[at + 1]
            back[at] = np.logaddexp(t[1, 1] + b, t[1, 0]) - np.logaddexp(t[0, 1] + b, t[0, 0])
        return ahead, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Field:
    """A fitted field: bin borders, line weights, transitions and the scale of document scores."""

    edges: list[np.ndarray]
    weights: np.ndarray
    transitions: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)

    def _bins(self, features: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, features[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)

    def marginals(self, doc: np.ndarray, features: np.ndarray) -> np.ndarray:
        """The probability of good for each line."""
        score = self.weights[_neighbours(doc, self._bins(features))].sum(axis=1) + self.weights[-1]
        ahead, back = _Chain(doc).messages(score, self.transitions)
        return _sigmoid(ahead + back)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The quality of each document, 0 without a word; and of each line its document, its place there and how likely it is good."""
        n = len(offsets) - 1
        out, good, (doc, length, features, line) = np.zeros(n), np.empty(0), line_features(data, offsets)
        if len(doc):
            good = self.marginals(doc, features)
            total = np.bincount(doc, weights=length, minlength=n)
            mean = np.bincount(doc, weights=length * good, minlength=n)[total > 0] / total[total > 0]
            out[total > 0] = _sigmoid(self.scale[0] * _logit(mean) + self.scale[1])
        return out, doc, line, good


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _adam(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return x


def fit(documents: list[tuple[np.ndarray, np.ndarray, int]], *, steps: int = 100, penalty: float = 1e-4, stretch: int = 128) -> Field:
    """Fits a field to (line lengths, line features, label) of some documents.

    At first a document's lines all have its label.  A bad document may hold good lines, so the
    field is fitted again with those of its lines good that the first fit finds so, all but its
    worst one.  Long documents are learnt as chains of stretch lines, so that the cost does not follow
    the longest one.  Without documents every score is 0.5.
    """
    width = 3 * len(FEATURES) * (_BINS + 1) + 1
    if not documents:
        return Field([np.array([]) for _ in FEATURES], np.zeros(width), np.zeros((2, 2)))
    features = np.concatenate([f for _, f, _ in documents])
    length = np.concatenate([n for n, _, _ in documents])
    sizes = [len(f) for _, f, _ in documents]
    doc, label = np.repeat(np.arange(len(documents)), sizes), np.array([y for _, _, y in documents], dtype=float)
    y = label[doc]
    edges = [np.unique(np.quantile(features[:, i], np.arange(1, _BINS) / _BINS)) for i in range(len(FEATURES))]
    field = Field(edges, np.zeros(width), np.zeros((2, 2)))
    place = np.arange(len(doc)) - np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    index, chain, n = _neighbours(doc, field._bins(features)), _Chain(doc * (len(doc) + 1) + place // stretch), len(doc)
    both = [(y[chain.inner] == u) & (y[chain.inner + 1] == v) for u in (0, 1) for v in (0, 1)]

    def gradient(x: np.ndarray) -> np.ndarray:
        w, t = x[:-4], x[-4:].reshape(2, 2)
        score = w[index].sum(axis=1) + w[-1]
        ahead, back = chain.messages(score, t)
        off = _sigmoid(ahead + back) - y
        g = np.bincount(index.ravel(), weights=np.repeat(off, index.shape[1]), minlength=width)
        g[-1] = off.sum()
        # Pairs of neighbours: what the field expects less what the labels have.
        i = chain.inner
        a, b = ahead[i], score[i + 1] + back[i + 1]
        logs = np.stack([t[0, 0] + 0 * a, t[0, 1] + b, t[1, 0] + a, t[1, 1] + a + b], axis=1)
        p = np.exp(logs - logs.max(axis=1, keepdims=True)) if len(i) else logs
        p /= p.sum(axis=1, keepdims=True)
        gt = p.sum(axis=0) - [pair.sum() for pair in both]
        return np.concatenate([g, gt]) / n + penalty * x

    x = _adam(gradient, np.zeros(width + 4), steps, 0.1)
    good = Field(edges, x[:-4], x[-4:].reshape(2, 2)).marginals(doc, features)
    worst = np.minimum.reduceat(good, np.cumsum([0, *sizes[:-1]]))[doc]
    y = np.where(label[doc] == 1, 1.0, (good > 0.5) & (good > worst))
    both = [(y[chain.inner] == u) & (y[chain.inner + 1] == v) for u in (0, 1) for v in (0, 1)]
    x = _adam(gradient, x, steps, 0.1)
    field = Field(edges, x[:-4], x[-4:].reshape(2, 2))
    total = np.bincount(doc, weights=length, minlength=len(documents))
    z = _logit(np.bincount(doc, weights=length * field.marginals(doc, features)) / total)
    s = _adam(lambda s: np.array([((p := _sigmoid(s[0] * z + s[1]) - label) * z).mean(), p.mean()]) + 1e-4 * s, np.array([1.0, 0.0]), 300, 0.05)
    field.scale = (max(float(s[0]), 0.05), float(s[1]))
    return field


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        for i, j in blocks(offsets):
            doc, length, features, _ = line_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            cuts = np.searchsorted(doc, np.arange(j - i + 1))
            parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("place", "text_key", "label")), pa.array(np.diff(cuts)), pa.array([length[a:b].astype("<i8").tobytes() for a, b in parts], pa.binary()), pa.array([features[a:b].astype("<f4").tobytes() for a, b in parts], pa.binary())], names=["place", "text_key", "label", "n", "length", "features"])


def train(docs: DataFrame, labels: DataFrame, *, max_documents: int = 8000, max_lines: int = 200_000) -> Field:
    """Fits a field on labelled documents: labels has doc_id and label (0 or 1; other values are left out).

    At most max_documents labelled rows are used, those whose id has the lowest hashes, and of
    these, in that order, the first max_lines lines, whatever document they end in, so what reaches the driver has a fixed bound and
    does not depend on how the tables are cut.  A doc_id of several rows or labels gives a document for each pair of them.
    """
    order = F.xxhash64("doc_id")
    sample = labels.where("label in (0, 1) and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label")).orderBy(order, "doc_id", "label").limit(max_documents)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("label", "text", order.alias("place"), F.xxhash64("text").alias("text_key"))
    found = rows.mapInArrow(_line_rows, "place long, text_key long, label int, n long, length binary, features binary").where("n > 0")
    taken, lines = [], 0
    for r in found.orderBy("place", "text_key", "label").toLocalIterator():
        n = min(r["n"], max_lines - lines)
        taken.append((np.frombuffer(r["length"], dtype="<i8")[:n], np.frombuffer(r["features"], dtype="<f4").reshape(-1, len(FEATURES))[:n], r["label"]))
        lines += n
        if lines == max_lines:
            break
    return fit(taken)


def score(docs: DataFrame, field: Field, *, lines: bool = False) -> DataFrame:
    """docs with score, from 0 to 1, added in place of any column of that name.

    With lines, also line_labels: for every line with a word its number of lines from the top, its probability of being good,
    and whether it is.  A null text or one without words scores 0 and has no lines.  Rows are scored each on its own, so
    repeated rows and rows without doc_id are no special case, and an empty table gives an empty table.
    """
    own = docs.drop("score", "line_labels") if lines else docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = pa.RecordBatch.from_struct_array(batch.column("row"))
            data, offsets = column_bytes(row.column("text"))
            parts = [shared.value.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets)]
            out = row.append_column("score", pa.array(np.concatenate([p for p, *_ in parts]) if parts else [], pa.float64()))
            if lines:
                labels = [x for p, doc, at, good in parts for x in _by_document(doc, at, good, len(p))]
                out = out.append_column("line_labels", pa.array(labels, pa.list_(pa.struct([("line", pa.int32()), ("probability", pa.float64()), ("good", pa.bool_())]))))
            yield out

    added = ["0D score", *(["array(named_struct('line', 0, 'probability', 0D, 'good', true)) line_labels"] if lines else [])]
    return own.select(F.struct("*").alias("row")).mapInArrow(run, own.selectExpr("*", *added).schema)


def _by_document(doc: np.ndarray, line: np.ndarray, good: np.ndarray, n: int) -> Iterator[list[dict]]:
    cuts = np.searchsorted(doc, np.arange(n + 1)).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield [{"line": k, "probability": p, "good": p >= 0.5} for k, p in zip(line[a:b].tolist(), good[a:b].tolist(), strict=True)]
