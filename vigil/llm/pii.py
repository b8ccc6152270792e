"""Personal data: patterns find the protected values, and corpus statistics the terms that reveal them.

A term reveals a protected value as far as it tells which value it is.  With N documents, n(e) that
hold the value, n(t) that hold the term and n(t, e) that hold both, the information of t about e is
log2(n(t, e) N / (n(t) n(e))), and the share of what there is to know, log2(N / n(e)), is at most
one.  Terms whose share is at or above a threshold are generalised, and those above a higher one removed, wherever they stand in a document
that holds the value.  All counts are over all documents, wherever in them value and term stand.

Terms are words, and names: two or three capitalised words in a row.  A word must stand with the value in several documents, since nearly every text has
words that no other has.  A name need not: it is estimated with half an imagined document besides, which holds the value as often as any,
so that (n(t, e) + n(e) / 2N) / (n(t) + 1/2) stands in the place of n(t, e) / n(t).  A term is generalised in two steps: to its initials, or, from halfway
between the two thresholds on, to what kind of term it is.

As n(t, e) is at most n(e), a term in more than n(e) (N / n(e)) ** (1 - threshold) documents is below
the threshold for e.  This bound leaves out most pairs before they are counted, and loses none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from . import storage
from .textblocks import LOWER_ASCII, find_words, word_blocks

KINDS = ("email", "ip", "card", "phone", "term", "name")
#: What stands in the place of a span; removed terms leave nothing.
PLACEHOLDERS = ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>", "<TERM>", "<NAME>")
#: What is done to a term: its initials stay, or its kind, or nothing.
INITIALS, KIND, REMOVED = 1, 2, 3
#: Documents that are imagined with each name.
IMAGINED = 0.5

_AT = re.compile("@")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "".join(map(chr, [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])) + "._%+-"
# A match can only begin where a run of digits does, which keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile("[A-Za-z\u0080-\U0010ffff]{3,}")
_NOT_DIGIT = re.compile("[^0-9]+")
_CAPITALISED = re.compile("[A-Z\u00c0-\u00d6\u00d8-\u00de][a-z\u00df-\u00f6\u00f8-\u00ff]+")
_NAMES = re.compile(rf"(?<![^\W\d_]){_CAPITALISED.pattern}(?: {_CAPITALISED.pattern})+")
#: Terms are runs of letters and non-ASCII characters.
_TERM_SEPARATOR = np.ones(256, dtype=bool)
_TERM_SEPARATOR[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all pattern matches, leftmost and without overlap in each kind."""
    out, end, at = [], 0, 0
    for m in _AT.finditer(text):
        p = m.start()
        left = text[max(end, at) : p]
        start, at = p - len(left) + len(left.rstrip(_LOCAL)), p + 1
        if start < p and (domain := _DOMAIN.match(text, p)):
            end = domain.end()
            out.append((start, 0, end))
    for m in _IP.finditer(text):
        if all(len(part := x.lstrip("0")) < 4 and int(part or 0) < 256 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _entity(kind: int, value: str) -> int:
    value = value.lower() if kind == 0 else value if kind == 1 else _NOT_DIGIT.sub("", value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def names_in(text: str) -> Iterator[tuple[str, int, int]]:
    """(name, start, end) of all names of the text: of longer runs of capitalised words, each two and three neighbours."""
    for run in _NAMES.finditer(text):
        words = [m.span() for m in _CAPITALISED.finditer(run[0])]
        for n in (2, 3):
            for (a, _), (_, b) in zip(words, words[n - 1 :], strict=False):
                yield run[0][a:b], run.start() + a, run.start() + b


def terms_outside(text: str, spans: list[tuple[int, int, int]], found: Iterator[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """(term, start, end) of all words of the text, or of what is found in it by start, that touch no value."""
    cover: list[list[int]] = []
    for start, _, end in spans:
        if cover and start <= cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], end)
        else:
            cover.append([start, end])
    out, k = [], 0
    for term, a, b in ((m[0], *m.span()) for m in _TERM.finditer(text)) if found is None else found:
        while k < len(cover) and cover[k][1] <= a:
            k += 1
        if k == len(cover) or cover[k][0] >= b:
            out.append((term, a, b))
    return out


def _hash_terms(terms: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(terms).encode(), dtype=np.uint8)
    return find_words(LOWER_ASCII[data], np.array([0, len(data)]), _TERM_SEPARATOR).hashes() & _WORD


#: Hashes of words are even and those of names odd.
_WORD = np.uint64(2**64 - 2)


def _hash_names(names: list[str]) -> np.ndarray:
    return np.fromiter((int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") | 1 for x in names), dtype=np.uint64, count=len(names))


#: held has the text of documents with a value, for their terms.
_SPANS = "base array<struct<start: int, kind: int, end: int>>, entities array<long>, held string"


def _scan_schema(row: DataType) -> StructType:
    ddl = StructType.fromDDL
    return StructType([*ddl("kind int, rid long"), StructField("row", row), *ddl(f"{_SPANS}, bucket int, terms binary, counts binary")])


_BASE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_MARKS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("removed", pa.bool_()), ("level", pa.int32())]))
_MARKS_DDL = "array<struct<start: int, kind: int, end: int, removed: boolean, level: int>>"


def _structs(kind: pa.ListType, rows: list[list[tuple]]) -> pa.Array:
    flat = [x for r in rows for x in r]
    fields = list(kind.value_type)
    columns = list(zip(*flat, strict=True)) if flat else [[] for _ in fields]
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values).cast(kind)


def _document_terms(text: pa.Array, n_buckets: int) -> list[tuple[int, bytes, bytes]]:
    """For each bucket of hashes: the terms of a batch and in how many of its documents they stand."""
    seen = []
    for _, _, words in word_blocks(text, lower=True, separator=_TERM_SEPARATOR):
        hashes = words.hashes() & _WORD
        doc = np.repeat(np.arange(len(words.first) - 1, dtype=np.uint64), words.counts())
        _, once = np.unique(hashes + (doc + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
        seen.append(hashes[once])
    for own in ({name for name, _, _ in names_in(x)} for x in text.to_pylist() if x):
        if own:
            seen.append(_hash_names(list(own)))
    terms, counts = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))
    bucket = ((terms >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    return [(int(b[0]), t.astype("<u8").tobytes(), c.astype("<u4").tobytes()) for b, t, c in zip(np.split(bucket, cuts), np.split(terms, cuts), np.split(counts, cuts), strict=True) if len(b)]


def _scan(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            row_type = batch.schema.field("row").type
            schema = pa.schema([("kind", pa.int32()), ("rid", pa.int64()), ("row", row_type), ("base", _BASE), ("entities", pa.list_(pa.int64())), ("held", pa.string()), ("bucket", pa.int32()), ("terms", pa.binary()), ("counts", pa.binary())])
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n = part.num_rows
                texts = part.column("text").to_pylist()
                spans = [base_spans(x) if x else [] for x in texts]
                entities = [sorted({_entity(kind, x[a:b]) for a, kind, b in s}) for x, s in zip(texts, spans, strict=True)]
                held = [x if s else None for x, s in zip(texts, spans, strict=True)]
                nulls = [pa.nulls(n, t) for t in (pa.int32(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, dtype=np.int32)), pa.array(np.arange(rid, rid + n)), part.column("row"), _structs(_BASE, spans), pa.array(entities, pa.list_(pa.int64())), pa.array(held, pa.string()), *nulls], schema=schema)
                rid += n
            packs = _document_terms(batch.column("text"), n_buckets)
            n = len(packs)
            columns = [pa.array(c, t) for c, t in zip(zip(*packs, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)] if packs else [pa.array([], t) for t in (pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, dtype=np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, row_type), pa.nulls(n, _BASE), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.string()), *columns], schema=schema)

    return run


def names_outside(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    return terms_outside(text, spans, iter(sorted(names_in(text), key=lambda x: x[1:])))


def _held_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, term and most of the distinct terms of each document, but for those in more than most documents of a batch.

    most_word and most_name are the bounds of a document's words and names.
    """
    for batch in batches:
        rids, bounds = batch.column("rid").to_numpy(), np.stack([batch.column(c).to_numpy() for c in ("most_word", "most_name")])
        docs, terms = [], []
        for i, (text, base) in enumerate(zip(batch.column("held").to_pylist(), batch.column("base").to_pylist(), strict=True)):
            spans = [(s["start"], s["kind"], s["end"]) for s in base]
            words = _hash_terms([t for t, _, _ in terms_outside(text, spans)]) if bounds[0, i] else np.empty(0, dtype=np.uint64)
            own = np.unique(np.concatenate([words, _hash_names([t for t, _, _ in names_outside(text, spans)])]))
            docs.append(np.full(len(own), i))
            terms.append(own)
        if docs:
            doc, term = np.concatenate(docs), np.concatenate(terms)
            _, which, counts = np.unique(term, return_inverse=True, return_counts=True)
            most = bounds[(term & np.uint64(1)).astype(np.int64), doc]
            keep = counts[which] <= most
            yield pa.RecordBatch.from_arrays([pa.array(rids[doc[keep]]), pa.array(term[keep].view(np.int64)), pa.array(most[keep])], names=["rid", "term", "most"])


def _frequencies(support: int):
    def run(packs: pa.Table, wanted: pa.Table) -> pa.Table:
        """In how many documents the wanted terms of a bucket stand, words from support on, up to most."""
        want = wanted.column("term").to_numpy().view(np.uint64)
        order = np.argsort(want)
        want, most = want[order], wanted.column("most").to_numpy()[order]
        total = np.zeros(len(want), dtype=np.int64)
        for terms, counts in zip(packs.column("terms").to_pylist(), packs.column("counts").to_pylist(), strict=True):
            terms = np.frombuffer(terms, dtype="<u8")
            at = np.minimum(np.searchsorted(terms, want), len(terms) - 1)
            hit = terms[at] == want
            total[hit] += np.frombuffer(counts, dtype="<u4")[at[hit]]
        keep = (total >= np.where(want & np.uint64(1), 1, support)) & (total <= most)
        return pa.table({"term": pa.array(want[keep].view(np.int64)), "n_term": pa.array(total[keep])})

    return run


def _with_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds every occurrence of a document's disclosing terms to its spans."""
    for batch in batches:
        spans = []
        for text, base, found in zip(batch.column("held").to_pylist(), batch.column("base").to_pylist(), batch.column("found").to_pylist(), strict=True):
            own = [(s["start"], s["kind"], s["end"], False, KIND) for s in base]
            if found:
                level, values = {f["term"]: f["level"] for f in found}, [s[:3] for s in own]
                words, names = terms_outside(text, values), names_outside(text, values)
                for kind, terms, hashes in ((4, words, _hash_terms([t for t, _, _ in words])), (5, names, _hash_names([t for t, _, _ in names]))):
                    own += [(a, kind, b, level[h] == REMOVED, level[h]) for (_, a, b), h in zip(terms, hashes.view(np.int64).tolist(), strict=True) if h in level]
                own.sort()
            spans.append(own)
        yield pa.RecordBatch.from_arrays([batch.column("row"), _structs(_MARKS, spans)], names=["row", "spans"])


def _judged(docs: DataFrame, carry: list[str] | None, generalise_at: float, remove_at: float, support: int) -> tuple[DataFrame, DataFrame]:
    """The rows without a value (row, base), and those with one: row, held, base and the terms found for them."""
    spark = docs.sparkSession
    n_buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in carry or docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    scan = storage.materialise(rows.mapInArrow(_scan(n_buckets), _scan_schema(rows.schema["row"].dataType)), "pii")
    found = scan.where("kind = 0").select("rid", "row", "base", "entities", "held")
    n = found.count()
    held = found.select("rid", F.explode("entities").alias("entity"))
    entities = held.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") < n)
    # A little more than the bound, for rounding.
    most = F.col("n_entity") * F.pow(F.lit(float(max(n, 1))) / F.col("n_entity"), F.lit(1.0 - generalise_at)) * (1 + 1e-9)
    known = storage.materialise(held.join(entities, "entity").withColumn("bound", most), "pii")
    bounds = known.groupBy("rid").agg(F.coalesce(F.max(F.when(F.col("n_entity") >= support, F.col("bound"))), F.lit(0.0)).alias("most_word"), F.max("bound").alias("most_name"))
    own = storage.materialise(found.select("rid", "held", "base").where("held is not null").join(bounds, "rid").mapInArrow(_held_terms, "rid long, term long, most double"), "pii")
    # The bucket of a term is that of its hash as an unsigned number, as in the scan.
    wanted = own.groupBy("term").agg(F.max("most").alias("most")).withColumn("bucket", F.expr(f"cast(shiftrightunsigned(shiftrightunsigned(term, 32) * {n_buckets}L, 32) as int)"))
    packs = scan.where("kind = 1").select("bucket", "terms", "counts")
    terms = packs.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(_frequencies(support), "term long, n_term long")
    rare = own.join(terms, "term").where(F.col("n_term") <= F.col("most")).select("rid", "term", "n_term")
    is_name, every = F.col("term").bitwiseAND(F.lit(1)) == 1, F.lit(float(max(n, 1)))
    least = F.when(is_name, 1).otherwise(support)
    pairs = storage.materialise(rare.join(known, "rid").where((F.col("n_term") <= F.col("bound")) & (F.col("n_entity") >= least)).drop("bound"), "pii")
    joint = pairs.groupBy("term", "entity", "n_term", "n_entity").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= least)
    told = F.when(is_name, (F.col("n_both") + IMAGINED * F.col("n_entity") / every) / (F.col("n_term") + IMAGINED)).otherwise(F.col("n_both") / F.col("n_term"))
    share = 1 + F.log2(told) / F.log2(every / F.col("n_entity"))
    level = F.when(F.col("share") >= remove_at, REMOVED).when(F.col("share") >= (generalise_at + remove_at) / 2, KIND).otherwise(INITIALS)
    disclosed = joint.withColumn("share", share).where(F.col("share") >= generalise_at).select("term", "entity", level.alias("level"))
    hits = pairs.select("rid", "term", "entity").join(disclosed, ["term", "entity"]).groupBy("rid", "term").agg(F.max("level").alias("level"))
    hits = hits.groupBy("rid").agg(F.collect_list(F.struct("term", "level")).alias("found"))
    # Rows without a value are most of them and need no join.
    return found.where("held is null").select("row", "base"), found.where("held is not null").join(hits, "rid", "left").select("row", "held", "base", "found")


def find(docs: DataFrame, *, carry: list[str] | None = None, generalise_at: float = 0.8, remove_at: float = 0.95, support: int = 2) -> DataFrame:
    """Finds values and revealing terms: row (the columns in carry, or all of docs), base and spans.

    base and spans are arrays of (start, kind, end, removed, level) by start and kind, in code points with
    the end exclusive; kind counts in KINDS.  base has the pattern matches, spans these and the
    terms, which may overlap.  A null or empty text has neither.  Repeated rows each keep their spans and count as
    documents of their own; doc_id is not used.  An empty table gives an empty table.
    generalise_at, remove_at: the shares of a value's information from which a term goes.
    support: in how many documents a word must stand with a value.  With 1, every word that no other
    document has tells a value that no other document has.  Names have no such bound.
    """
    plain, held = _judged(docs, carry, generalise_at, remove_at, support)
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(False).alias("removed"), F.lit(KIND).alias("level")))
    marked = StructType([StructField("row", held.schema["row"].dataType), *StructType.fromDDL(f"spans {_MARKS_DDL}")])
    joined = held.mapInArrow(_with_terms, marked)
    return plain.select("row", base.alias("base"), base.alias("spans")).unionByName(joined.select("row", F.filter("spans", lambda s: s["kind"] < 4).alias("base"), "spans"))


def as_text(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.RecordBatch.from_struct_array(batch.column("row"))
        at = rows.schema.get_field_index("text")
        texts = [redact(x, s) if s else x for x, s in zip(rows.column(at).to_pylist(), batch.column("spans").to_pylist(), strict=True)]
        yield rows.set_column(at, rows.schema.field(at), pa.array(texts, rows.schema.field(at).type))


def redact(text: str, spans: list[dict]) -> str:
    """The text with placeholders for its spans; of overlapping spans the first kind stands for all."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["kind"])):
        if s["start"] >= at:
            here = text[s["start"] : s["end"]]
            out += [text[at : s["start"]], "" if s["removed"] else PLACEHOLDERS[s["kind"]] if s["level"] == KIND else " ".join(w[0] + "." for w in here.split(" "))]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _redact(_with_terms(batches))


def sanitise(docs: DataFrame, *, generalise_at: float = 0.8, remove_at: float = 0.95, support: int = 2) -> DataFrame:
    """docs with every span of find() replaced in text; texts without spans stay as they are.

    Rows without a value go through no Python, and the others through one function: two in a row would take two workers a task, which
    stay for all that follows.
    """
    plain, held = _judged(docs, None, generalise_at, remove_at, support)
    return plain.select("row.*").unionByName(held.mapInArrow(_cleaned, docs.schema))
