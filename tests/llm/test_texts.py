"""Operators on documents against brute force."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import tokenizers
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vigil.llm import bpe, minhash, packing, pii, quality, substrings
from vigil.llm.textblocks import column_bytes, find_words, word_blocks

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def collected(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]


def empty(documents):
    return documents.limit(0)


# Words


@given(st.lists(st.text(alphabet=" \t\n\x0b\x0cabé\x1c ", max_size=30), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words_equal_the_pattern(texts):
    import pyarrow as pa

    got = [w.joined(d).decode().split(" ") if n else [] for _, _, w in word_blocks(pa.array(texts, pa.string()), limit=7) for d, n in enumerate(w.counts())]
    assert got == [WORD.findall(t) for t in texts]
    data, offsets = column_bytes(pa.array([*texts, *texts], pa.string()))
    words = find_words(data, offsets)
    hashes = words.hashes()
    n = sum(len(WORD.findall(t)) for t in texts)
    assert (hashes[:n] == hashes[n:]).all() and len(set(hashes[:n].tolist())) == len({w for t in texts for w in WORD.findall(t)})


# Byte-level BPE


def test_bpe_round_trip_and_ids(spark, documents):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter((d, np.array(encoder.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t in collected(documents))
    encoded = bpe.encode(documents, RANKS, public_tokenizers.PATTERN)
    assert collections.Counter((r[0], bytes(r[1]), bytes(r[2])) for r in bpe.decode(encoded, RANKS).collect()) == want
    both = bpe.encode(documents, RANKS, public_tokenizers.PATTERN, with_decoded=True)
    assert collections.Counter((r[0], bytes(r[1]), bytes(r[2])) for r in both.collect()) == want
    assert bpe.encode(empty(documents), RANKS, public_tokenizers.PATTERN).count() == 0


@given(st.lists(st.integers(0, 300_000), max_size=50), st.lists(st.binary(max_size=6), unique=True, max_size=30))
@settings(max_examples=80, deadline=None)
def test_bpe_packed_forms(ranks, words):
    array = np.array(ranks, dtype=np.int64)
    assert bpe._unpack_ranks(bpe._pack_ranks(array)).tolist() == ranks
    assert bpe._unpack(bpe._pack(array)).tolist() == ranks
    assert list(bpe._unpack_words(bpe._pack_words(sorted(words)))) == sorted(words)


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40) | st.text(alphabet=" \n\t'sabÉ1.̀ ", max_size=40))
@settings(max_examples=300, deadline=None)
def test_chunks_split_as_the_whole_text(text):
    split, own = bpe.splitter(public_tokenizers.PATTERN), test_chunks_split_as_the_whole_text
    slots = bpe._Slots()
    got = np.frombuffer(bpe._slots_of(text, split, slots, bpe._Chunks(split, slots)), dtype="<u4")
    words = list(slots)
    assert [words[i] for i in got] == split(text)
    assert [i for w in split(text) for i in own.encoder.encode_ordinary(w)] == own.encoder.encode_ordinary(text)


test_chunks_split_as_the_whole_text.encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


# Packing


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=30) | st.text(alphabet=" \n\x1c'sABCÉßİΣ1.̀ ", max_size=30))
@settings(max_examples=300, deadline=None)
def test_word_tokenizer_equals_the_library(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_FILE)
    whole.encode_special_tokens = True
    assert np.frombuffer(test_word_tokenizer_equals_the_library.own.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


test_word_tokenizer_equals_the_library.own = packing.WordTokenizer(WORD_FILE)


@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "|>", " ", "\n", "\x1c", "Hello", "É", "Σ", "it's 1"]), max_size=8))
@settings(max_examples=300, deadline=None)
def test_word_tokenizer_equals_the_library_on_added_tokens(parts):
    text, own = "".join(parts), test_word_tokenizer_equals_the_library_on_added_tokens
    assert np.frombuffer(own.own.ids(text), "<u4").tolist() == own.whole.encode(text, add_special_tokens=False).ids


test_word_tokenizer_equals_the_library_on_added_tokens.own = packing.WordTokenizer(WORD_FILE)
test_word_tokenizer_equals_the_library_on_added_tokens.whole = tokenizers.Tokenizer.from_file(WORD_FILE)


@pytest.mark.parametrize("letters", ["a", "é", "Σ", "ж", "a'", "字", "1a"])
def test_long_chunks_have_the_ids_of_the_library(letters):
    own, library = packing.WordTokenizer(WORD_FILE), tokenizers.Tokenizer.from_file(WORD_FILE)
    for n in (998, 999, 1000, 1001, 2500):
        text = f"x {(letters * n)[:n]} y"
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_of_added_tokens(spark):
    texts = ["hello <|endoftext|> world", "<|startoftext|>a b", "no such token", None]
    got = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORD_FILE).collect()
    library = tokenizers.Tokenizer.from_file(WORD_FILE)
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert 49407 in ids[0] and 49406 in ids[1]
    assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in got) == [(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in enumerate(ids)]


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(spark, documents, capacity):
    own = packing.WordTokenizer(WORD_FILE)
    got = packing.pack_documents(documents.repartition(3), WORD_FILE, capacity=capacity).collect()
    want = []
    for d, t in collected(documents):
        ids = np.append(np.frombuffer(own.whole(t or ""), "<u4"), 1).astype("<u4")
        want += [(d, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == collections.Counter(want)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(w[3] for w in want)
    assert len(bins) <= -(-total // capacity) + 2
    assert packing.pack_documents(empty(documents), WORD_FILE).count() == 0


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=100, deadline=None)
def test_best_fit(sizes):
    bins, places = packing.best_fit(np.array(sizes, dtype=np.int64), 50)
    by = collections.defaultdict(list)
    for s, b, p in zip(sizes, bins.tolist(), places.tolist(), strict=True):
        by[b].append((p, s))
    assert all(sum(s for _, s in v) <= 50 and [p for p, _ in sorted(v)] == np.cumsum([0] + [s for _, s in sorted(v)][:-1]).tolist() for v in by.values())
    assert len(by) <= 11 / 9 * -(-sum(sizes) // 50) + 1 or len(by) <= sum(s > 25 for s in sizes) + 11 / 9 * sum(s <= 25 for s in sizes) + 1


# Substrings


def brute_repeats(rows, length):
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    key = lambda d: -(2**63) if d is None else d
    for (d, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - length + 1):
            at, k = (key(d), s), tuple(w[s : s + length])
            first[k] = min(first.get(k, at), at)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] != (key(d), s):
                gone[s : s + length] = [True] * length
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return collections.Counter(out)


@pytest.mark.parametrize("length", [20, 3])
def test_substrings(spark, documents, length):
    docs = documents.where("length(text) < 40000 or text is null")
    got = substrings.remove_repeats(docs.repartition(3).withColumn("n_words", F.lit("mine")), length=length)
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()) == brute_repeats(collected(docs), length)
    assert {"digest", "row", "text"} <= set(got.columns)
    assert substrings.remove_repeats(empty(documents)).count() == 0


def test_substrings_on_periodic_texts(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["a", "b"], rng.integers(1, 60)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substrings.remove_repeats(docs, length=5)
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()) == brute_repeats(rows, 5)


def test_a_small_sketch_loses_nothing(spark, documents):
    docs = documents.where("length(text) < 40000")
    got = substrings.remove_repeats(docs, cells_a_seed=0.01)
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()) == brute_repeats(collected(docs), 20)


def _swapped(n):
    """Two different words of 2 ** n letters whose polynomial hashes modulo 2 ** 64 are equal in any base."""
    a = "a"
    for _ in range(n):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_merged_sketches_never_undercount():
    """Partitions' sketches add up to counts of at least what stands in all of them, and pass more unique seeds the fuller they are."""
    rng = np.random.default_rng(6)
    unique, twice = rng.integers(0, 2**63, 20_000, dtype=np.uint64), rng.integers(0, 2**63, 500, dtype=np.uint64)
    parts = [np.unique(np.concatenate([own, twice])) for own in np.array_split(unique, 4)]
    passed = {}
    for load in (0.1, 1, 6):
        width = int(len(unique) / load)
        rows = []
        for seeds in parts:
            sketch = substrings._Sketch(width)
            for some in np.array_split(seeds, 3):  # batches
                sketch.add(some, np.ones(len(some), dtype=np.int64), np.zeros(len(some), dtype=np.int32))
            rows += list(sketch.rows())
            assert not list(sketch.rows())
        rows = sorted(({"shard": 0, "kind": 1, "ones": s.astype("<u8").tobytes(), "keys": np.zeros(len(s), "<i8").tobytes()} if isinstance(s, np.ndarray) else s for s in [*rows, *parts]), key=lambda r: r["kind"])
        got = pa.Table.from_batches(substrings._estimate(width)(iter([pa.RecordBatch.from_pylist(rows, schema=substrings._SHARE_SCHEMA)]))).to_pylist()
        asked = {r["seed"] for r in got if r["doc_key"] is not None}
        assert set(twice.view(np.int64).tolist()) <= asked
        assert sum(r["n"] for r in got if r["seed"] is None) == sum(map(len, parts))
        passed[load] = (len(asked) - 500) / len(unique)
    assert passed[0.1] < 0.02 < passed[1] < 0.55 < passed[6]


def test_words_built_to_collide_stay_apart(spark):
    words, (a, b) = [f"w{i}" for i in range(19)], _swapped(10)
    docs = spark.createDataFrame([(1, " ".join([*words, a])), (2, " ".join([*words, b])), (3, a), (4, b)], "doc_id long, text string")
    assert {r["n_removed"] for r in substrings.remove_repeats(docs).collect()} == {0}
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs.where("doc_id > 2")).collect()} == {3: 3, 4: 4}


def test_a_line_in_many_contexts_is_cut(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_SEED", 5)
    rng = np.random.default_rng(4)
    line = " ".join(f"l{i}" for i in range(14))
    around = lambda: " ".join(f"c{x}" for x in rng.integers(0, 900, 24))
    rows = [(i, f"{around()} {line} {around()}") for i in range(60)] + [(100 + i, f"{around()} {line} {line}") for i in range(20)]
    rows += [(200, rows[3][1]), (201, rows[9][1] + " more")]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()) == brute_repeats(rows, 20)


# Near-duplicates


def brute_components(rows, size, percent):
    sets, ids = [], [-(2**63) if d is None else d for d, _ in rows]
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {r: min(ids[k] for k in range(len(rows)) if root[k] == r) for r in root}
    real = lambda x: None if x == -(2**63) else x
    return collections.Counter((real(ids[k]), len(sets[k]), real(least[root[k]]), ids[k] == least[root[k]]) for k in range(len(rows)))


def test_near_duplicates(spark, documents):
    for size in (2, 5):
        got = minhash.near_duplicates(documents.repartition(3), shingle_words=size)
        assert collections.Counter(map(tuple, got.collect())) == brute_components(collected(documents), size, 80)
    assert minhash.near_duplicates(empty(documents)).count() == 0


def test_near_duplicates_of_many_edits(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(220):
        own = list(base) if i % 2 else [f"x{i // 20}y{k}" for k in range(60)]
        for k in rng.choice(len(own), rng.integers(0, 8), replace=False):
            own[k] = f"e{rng.integers(0, 40)}"
        rows.append((1000 - i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = collections.Counter(map(tuple, minhash.near_duplicates(docs, shingle_words=2).collect()))
    assert got == brute_components(rows, 2, 80)


def test_exact_near_duplicates_leave_nothing_to_buckets(spark, documents):
    """At a low bound few linked pairs share a bucket; the exact setting finds all of them."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(90):
        own = [f"x{i // 6}y{k}" for k in range(60)]
        for k in rng.choice(60, 9, replace=False):
            own[k] = f"e{rng.integers(0, 400)}"
        rows.append((i, " ".join(own)))
    rows += [(200, None), (201, ""), (202, "one"), (203, "one"), (None, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_components(rows, 2, 35)
    found = lambda **o: collections.Counter(map(tuple, minhash.near_duplicates(docs, shingle_words=2, percent=35, **o).collect()))
    assert found(exact=True) == want != found()
    assert minhash.near_duplicates(empty(documents), exact=True).count() == 0


def test_hot_shingles_are_joined_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SETS", 8)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):  # a family whose pairs lie on both sides of the bound
        own = list(base)
        for k in rng.choice(60, rng.integers(2, 6), replace=False):
            own[k] = f"e{rng.integers(0, 500)}"
        rows.append((int(i // 2) if i % 7 else None, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = collections.Counter(map(tuple, minhash.near_duplicates(docs, shingle_words=2).collect()))
    assert got == brute_components(rows, 2, 80)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    whole = np.unique(rng.integers(0, 2**64, 1200, dtype=np.uint64))
    a, b = np.sort(whole[:900]), np.sort(whole[100:1000])
    s = minhash.signatures([a, b, a[:0], a[:1]])
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.08 and not s[2].any() and (s[3] == a[0]).all()


# Personal data

PATTERNS = (
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda t, d: True), (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda t, d: all(int(x) <= 255 for x in t.split("."))),
    (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda t, d: 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0), (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda t, d: 10 <= len(d) <= 15),
)


def brute_spans(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PATTERNS) for m in p.finditer(text) if ok(m[0], re.sub("[^0-9]", "", m[0])))


@given(st.text(alphabet="0123456789..@@ab-+ ()%é\n", max_size=60))
@settings(max_examples=400, deadline=None)
def test_pattern_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_disclosing_terms_go_and_clean_texts_stay(spark, documents):
    secret = "Contact {n} Zanzibar at jo.doe@mail.example.org or 4111 1111 1111 1111 today"
    rows = [(100 + i, secret.format(n=n)) for i, n in enumerate(("Quillon", "Quillon", "Other"))] + [(200 + i, "Contact the office today, or at any other time") for i in range(30)] + [(300, "Zanzibar is far")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(documents.select("doc_id", "text"))
    found = {r["doc_id"]: r for r in pii.find(docs).select("row.doc_id", pii.as_text("base").alias("base"), pii.as_text("spans").alias("spans")).collect()}
    assert found[100]["base"] == "email:28:51,card:55:74" and "term:8:15" in found[100]["spans"] and found[300]["spans"] == "" and found[200]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "Quillon" not in clean[100] and "<EMAIL>" in clean[100] and "<CARD>" in clean[100] and "jo.doe" not in clean[100]
    assert clean[300] == "Zanzibar is far" and clean[200] == rows[3][1]
    assert pii.find(documents.limit(0)).count() == 0 and pii.sanitise(documents).columns == documents.columns
    odd = documents.withColumn("a.b c", F.lit(1))
    assert pii.sanitise(odd).columns == odd.columns and pii.sanitise(odd).count() == odd.count()
    before = collections.Counter(map(tuple, documents.collect()))
    assert collections.Counter(map(tuple, pii.sanitise(documents).collect())) == before  # nothing to protect


def brute_disclosing(rows, support=2):
    """Document number to (start, end, removed) of the terms that tell a value of it, by counting all pairs."""
    values, outside, every = [], [], []
    for text in rows:
        spans = pii.base_spans(text)
        values.append({pii._entity(k, text[a:b]) for a, k, b in spans})
        outside.append([m for m in pii._TERM.finditer(text) if not any(a < m.end() and m.start() < b for a, _, b in spans)])
        every.append({m[0].lower() for m in pii._TERM.finditer(text)})
    out = collections.defaultdict(set)
    for d, text in enumerate(rows):
        for m in outside[d]:
            shares = []
            for e in values[d]:
                n_entity = sum(e in v for v in values)
                both = sum(e in v and any(x[0].lower() == m[0].lower() for x in o) for v, o in zip(values, outside, strict=True))
                if both >= support and n_entity < len(rows):
                    shares.append(1 + np.log2(both / sum(m[0].lower() in t for t in every)) / np.log2(len(rows) / n_entity))
            if shares and max(shares) >= 0.8:
                out[d].add((m.start(), m.end(), max(shares) >= 0.95))
    return out


def test_redaction_takes_one_python_worker_a_task(spark, documents):
    """Chained Python steps would take two workers a task."""
    rows = [(1000 + i, f"Write to {n} Zanzibar at jo.doe@mail.example.org or 10.0.0.{i % 3} today") for i, n in enumerate(("Quillon", "Quillon", "Other", "Other"))] + [(2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(documents.select("doc_id", "text"))
    clean = pii.sanitise(docs)
    assert clean._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = [(r["row"]["doc_id"], pii.redact(r["row"]["text"], [s.asDict() for s in r["spans"]]) if r["spans"] else r["row"]["text"]) for r in pii.find(docs).collect()]
    assert collections.Counter((r["doc_id"], r["text"]) for r in clean.collect()) == collections.Counter(want)


def test_terms_far_from_a_value_disclose_it(spark):
    filler = "the office answers on every other day " * 20
    far = [f"Dr Quillon writes. {filler} Mail: jo.doe@mail.example.org. {filler} Yours, QUILLON and {n}" for n in ("Bramwell", "Ostrander")]
    rng = np.random.default_rng(3)
    mixed = [" ".join(rng.choice(["amber", "birch", "cedar", "a@x.example.org", "b@x.example.org", "+44 20 7946 0958", *(f"w{c * 3}" for c in "abcdefghij")], 9)) for _ in range(60)]
    rows = [*far, *mixed, *[filler] * 30]
    found = pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)).select("row.doc_id", "spans").collect()
    got = {r["doc_id"]: {(s["start"], s["end"], s["removed"]) for s in r["spans"] if s["kind"] == 4} for r in found}
    assert {d: s for d, s in got.items() if s} == brute_disclosing(rows) and len(found) == len(rows)
    assert {far[0][a:b] for a, b, _ in got[0]} == {"Quillon", "QUILLON", "writes", "Mail", "Yours", "and"}


def brute_names(rows):
    """Document number to (start, end, level) of the names that tell a value of it, by counting all pairs."""
    part = "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"

    def names(text):
        words = [m.span() for m in re.finditer(rf"(?<![^\W\d_]){part}", text)]
        for n in (2, 3):
            for own in zip(*(words[k:] for k in range(n)), strict=False):
                if all(text[a[1] : b[0]] == " " for a, b in zip(own, own[1:], strict=False)):
                    yield text[own[0][0] : own[-1][1]], own[0][0], own[-1][1]

    values, outside, every = [], [], []
    for text in rows:
        spans = pii.base_spans(text)
        values.append({pii._entity(k, text[a:b]) for a, k, b in spans})
        outside.append([x for x in names(text) if not any(a < x[2] and x[1] < b for a, _, b in spans)])
        every.append({x[0] for x in names(text)})
    out, n = collections.defaultdict(set), len(rows)
    for d in range(n):
        for name, a, b in outside[d]:
            shares = []
            for e in values[d]:
                n_entity = sum(e in v for v in values)
                both = sum(e in v and name in {x[0] for x in o} for v, o in zip(values, outside, strict=True))
                if n_entity < n:
                    shares.append(1 + np.log2((both + 0.5 * n_entity / n) / (sum(name in t for t in every) + 0.5)) / np.log2(n / n_entity))
            if shares and max(shares) >= 0.8:
                out[d].add((a, b, 3 if max(shares) >= 0.95 else 2 if max(shares) >= 0.875 else 1))
    return out


def test_names_beside_a_value_of_one_document_go(spark):
    rng = np.random.default_rng(8)
    first, last = "Quillon Amber Élise Otto Mara Jean Ute Noor".split(), "Bramwell Ostrander Zürn Okafor Lindqvist Ávila Moss".split()
    one = "Dr Quillon Bramwell of Ostrander Lane writes from jo.doe@mail.example.org in spring."
    mixed = [" ".join(f"{rng.choice(first)} {rng.choice(last)} {rng.choice(['says', 'Senior says', 'met', 'Mc Moss'])}" for _ in range(3)) + rng.choice(["", " at a@x.example.org", " on +44 20 7946 0958", f" at p{i}@x.example.org"]) for i in range(80)]
    rows = [one, "Dr Otto Moss is here", *mixed, *["the office answers on every other day"] * 300]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: {(s["start"], s["end"], s["level"]) for s in r["spans"] if s["kind"] == 5} for r in pii.find(df).select("row.doc_id", "spans").collect()}
    want = brute_names(rows)
    assert {d: s for d, s in got.items() if s} == {d: s for d, s in want.items() if s}
    assert {x[2] for s in want.values() for x in s} == {1, 2, 3}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert not any(w in clean[0] for w in ("Quillon", "Bramwell", "Ostrander Lane", "jo.doe")) and "writes from <EMAIL> in spring." in clean[0]
    assert all(clean[i] == t for i, t in enumerate(rows) if not pii.base_spans(t))  # texts without a value stay


def test_levels_of_generalisation():
    text = "So Jo Ann Lee met Bo."
    span = lambda level, kind=5: [{"start": 3, "end": 13, "kind": kind, "removed": level == 3, "level": level}]
    assert pii.redact(text, span(1)) == "So J. A. L. met Bo." and pii.redact(text, span(2)) == "So <NAME> met Bo." and pii.redact(text, span(3)) == "So  met Bo."
    assert pii.redact(text, span(2, 0)) == "So <EMAIL> met Bo."


# Quality


def corpus(spark, n=240):
    rng = np.random.default_rng(1)
    words = "the of and river stone walks under quiet morning light over green hills".split()
    line = lambda: " ".join(rng.choice(words, 12)).capitalize() + "."
    junk = lambda: " ".join(w.upper() + "!!" for w in rng.choice(words, 12))
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        rows.append((i, "\n".join(junk() if bad and k % 4 else line() for k in range(8)), int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_quality(spark, documents):
    own = corpus(spark)
    field = quality.train(own.where("doc_id % 5 <> 0").select("doc_id", "text"), own.select("doc_id", "label"))
    got = quality.score(own.withColumn("score", F.lit("mine")), field).where("doc_id % 5 = 0").collect()
    assert np.mean([(r["score"] >= 0.3) == (r["label"] == 1) for r in got]) > 0.95
    scores = {r["row"]: r["score"] for r in quality.score(documents, field).collect()}
    assert scores[0] == scores[1] == scores[2] == 0.0 and all(0 <= s <= 1 for s in scores.values()) and len(scores) == 16
    assert quality.score(empty(documents), field).count() == 0
    none = quality.train(own.limit(0), own.select("doc_id", "label").limit(0))
    assert {r["score"] for r in quality.score(own, none).collect()} == {0.5}


def test_line_labels_and_scores(spark, documents):
    own = corpus(spark)
    field = quality.train(own.select("doc_id", "text"), own.select("doc_id", "label"))
    again = quality.train(own.select("doc_id", "text").repartition(7), own.select("doc_id", "label").repartition(2))
    assert (field.weights == again.weights).all() and field.scale == again.scale  # however the tables are cut
    few = quality.train(own.select("doc_id", "text"), own.select("doc_id", "label"), max_lines=400)
    assert (few.weights == quality.train(own.select("doc_id", "text").repartition(5), own.select("doc_id", "label"), max_lines=400).weights).all()
    clean = []
    for r in quality.score(own.withColumn("line_labels", F.lit("mine")), field, lines=True).collect():
        lines = r["text"].split("\n")
        assert [x["line"] for x in r["line_labels"]] == list(range(len(lines)))
        mean = sum(x["probability"] * len(t) for x, t in zip(r["line_labels"], lines, strict=True)) / sum(map(len, lines))
        assert abs(quality._sigmoid(field.scale[0] * quality._logit(np.array(mean)) + field.scale[1]) - r["score"]) < 1e-9
        if r["label"] == 0:  # every fourth line is as those of good documents
            assert all(x["good"] == (x["probability"] >= 0.5) for x in r["line_labels"]) and min(r["line_labels"], key=lambda x: x["probability"])["line"] % 4
            clean.append(np.mean([x["probability"] for x in r["line_labels"] if x["line"] % 4 == 0]) - np.mean([x["probability"] for x in r["line_labels"] if x["line"] % 4]))
    assert np.mean(clean) > 0
    odd = {r["row"]: r["line_labels"] for r in quality.score(documents, field, lines=True).collect()}
    assert odd[0] == odd[1] == odd[2] == [] and [x["line"] for x in odd[13]] == [0, 2] and len(odd) == 16
    assert quality.score(empty(documents), field, lines=True).count() == 0


def test_the_cost_of_training_does_not_follow_the_longest_document():
    rng = np.random.default_rng(2)
    lines = [(rng.integers(10, 90, n), rng.normal(size=(n, len(quality.FEATURES))).astype(np.float32), int(n % 2)) for n in (20_001, 30, 31)]
    chain = quality._Chain
    steps = []
    try:
        quality._Chain = lambda doc: steps.append(chain(doc)) or steps[-1]
        quality.fit(lines, steps=1)
    finally:
        quality._Chain = chain
    assert len(steps[0].active) == 128


def test_chain_equals_enumeration():
    rng = np.random.default_rng(6)
    doc = np.repeat([0, 1, 2], [1, 4, 3])
    score, t = rng.normal(size=8), rng.normal(size=(2, 2))
    ahead, back = quality._Chain(doc).messages(score, t)
    for d in range(3):
        at = np.flatnonzero(doc == d)
        total, good = 0.0, np.zeros(len(at))
        for code in range(2 ** len(at)):
            y = [(code >> i) & 1 for i in range(len(at))]
            w = np.exp(sum(score[a] * v for a, v in zip(at, y, strict=True)) + sum(t[u, v] for u, v in zip(y, y[1:], strict=False)))
            total += w
            good += w * np.array(y)
        assert np.allclose(quality._sigmoid((ahead + back)[at]), good / total)
