"""Spelling variants, minimum-bin-slack packing and Lloyd clustering against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vigil.llm import lloyd, slack_packing, variants

# Spelling variants


def brute_words(rows, every, least_letters=6, least_count=5):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least_letters
    return {w: c for w, c in n.items() if c >= least_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words, ratio=5):
    links, out = collections.defaultdict(list), {}
    for a, b in itertools.combinations(words, 2):
        if near(a, b):
            links[a].append(b)
            links[b].append(a)
    form = {w: min(o, key=lambda x: (-words[x], x)) for w, o in links.items()}
    form = {w: f for w, f in form.items() if words[f] >= ratio * words[w]}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (words[w], len(links[w]), form.get(w), words.get(form.get(w)), root)
    return out


def chained(rng):
    """Words of few letters in which forms have forms themselves, in texts with other characters between."""
    base = ["aaaaaa", "baaaaa", "bbaaaa", "bbbaaa", "abcabc", "acbabc", "éacabc", "ÀÉßabc", "àÉßabc", "×÷abcabc", "abcabcabc"]
    pool = [(w, (7, 40, 220, 1200)[i % 4]) for i, w in enumerate(base)] + [("".join(rng.choice("abcé") for _ in range(rng.randrange(5, 9))), rng.randrange(1, 12)) for _ in range(400)]
    words = [w.upper() if rng.random() < 0.2 and w.isascii() else w for w, n in pool for _ in range(n)]
    rng.shuffle(words)
    return words


@pytest.mark.parametrize(("block", "every"), [(4_096, 199), (7, 3)])
def test_variants_equal_brute_force(spark, monkeypatch, block, every):
    monkeypatch.setattr(variants, "BLOCK", block)  # small blocks: each bucket is dealt over pairs of blocks
    rng = random.Random(block)
    words = chained(rng)
    texts = [rng.choice([" ", "-", "9", "\n", "日", "ā"]).join(words[i : i + 40]) for i in range(0, len(words), 40)]
    rows = [(None if i == 3 else i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "long " * 20_000 + "abcabc"), (4, texts[4]), (5, "x" * 100_000)]
    docs = spark.createDataFrame([(*r, "clash", 1, "a") for r in rows], "doc_id long, text string, word string, n int, key string")
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in variants.group_variants(docs, every=every).collect()}
    want = brute_variants(brute_words(rows, every))
    assert got == want and len(want) > 100
    assert sum(v[2] is not None for v in want.values()) > 3 and any(v[2] and v[4] != v[2] for v in want.values())
    assert variants.group_variants(docs.limit(0)).count() == 0


def test_bands_cover_all_letters_once():
    a, b, c = variants.bands()
    assert a | b | c == 2**63 - 1 and not a & b and not a & c and not b & c


def test_masks_tell_what_an_edit_flips(spark):
    letters = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))]
    rng = random.Random(3)
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    edited = [w[:1] + rng.choice(letters) + w[1 + rng.randrange(2) :] for w in words]
    df = spark.createDataFrame(list(zip(words, edited, strict=True)), "a string, b string")
    rows = df.select("a", "b", F.bit_count(variants.parity_mask(F.col("a")).bitwiseXOR(variants.parity_mask(F.col("b")))).alias("flips")).collect()
    assert len(rows) == 300
    for r in rows:
        assert r["flips"] == 1 if len(r["a"]) != len(r["b"]) else r["flips"] in (0, 2)


def test_chains_of_forms_end_at_their_last_word(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "y")]
    got = dict(variants.roots(spark.createDataFrame(forms, "word string, form string")).collect())
    assert got == {f"w{i}": "w37" for i in range(37)} | {"x": "y"}


# Minimum bin slack


def test_least_slack_is_the_best_sum():
    rng = random.Random(11)
    for _ in range(300):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(0, 60)
        chosen = slack_packing.least_slack(counts, room)
        sums = {sum(n * c for n, c in zip(counts, use, strict=True)) for use in itertools.product(*(range(c + 1) for c in counts.values()))}
        assert sum(n * c for n, c in chosen.items()) == max(s for s in sums if s <= room)
        assert all(0 < c <= counts[n] for n, c in chosen.items())


def test_windows_are_full_and_cut_little():
    rng, window, whole = random.Random(12), slack_packing.Window(64), collections.Counter()
    for i in range(500):
        n = rng.choice([1, 2, 3, 17, 33, 40, 63, 64])
        window.add((i, 0, bytes(4 * n), n))
        whole[i] += n
    full = list(window.sequences())
    assert all(sum(len(p[2]) // 4 for p in s) == 64 for s in full)
    rest = window.rest()
    assert sum(len(p[2]) // 4 for p in rest) == window.tokens < 64
    last = list(slack_packing.powers_of_two(rest))
    sizes = [sum(len(p[2]) // 4 for p in s) for s in last]
    assert sizes == sorted(set(sizes), reverse=True) and all(n & n - 1 == 0 for n in sizes)
    got = collections.Counter()
    for doc, _, ids, _ in itertools.chain(*full, *last):
        got[doc] += len(ids) // 4
    assert got == whole
    assert sum(len(s) for s in full) + len(rest) <= 500 + len(full)  # a sequence cuts one piece at most


def check_packed(rows, texts, capacity):
    """Every id in exactly one piece, gapless sequences, no padding."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
    want = collections.Counter((d, ids(t)) for d, t in texts)
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for doc_id in {d for d, _ in texts}:
        pieces = []
        for (d, own), copies in want.items():
            if d == doc_id:
                pieces += [(own, copies)]
        assert sum(len(own) // 4 * c for own, c in pieces) == sum(n for _, n, _, _ in by_doc[doc_id])
        if len(pieces) == 1 and pieces[0][1] == 1:
            own, at = pieces[0][0], 0
            for start, n, crc, tokens in sorted(by_doc[doc_id]):
                assert start == at and tokens == len(own) // 4 and zlib.crc32(own[4 * start : 4 * (start + n)]) == crc
                at += n
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    fills = []
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        fills.append(at)
    short = [n for n in fills if n != capacity]
    assert all(n < capacity and n & n - 1 == 0 for n in short) and len(set(short)) == len(short)


@pytest.mark.parametrize("fan_in", [256, 2])
def test_slack_packing_equals_the_library(spark, documents, monkeypatch, fan_in):
    monkeypatch.setattr(slack_packing, "FAN_IN", fan_in)  # 2: several levels of rests
    rng = random.Random(fan_in)
    more = [(100 + i, " ".join(rng.choice("alpha beta é 文 9 <|endoftext|> !".split()) for _ in range(rng.randrange(200))), "x", i) for i in range(300)] + [(500, " " * 1_500_000, "x", 1)]
    docs = documents.withColumn("length", F.lit("clash")).unionByName(spark.createDataFrame(more, documents.schema).withColumn("length", F.lit(None).cast("string"))).repartition(9)
    got = slack_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=512).collect()
    check_packed(got, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 512)


def test_slack_packing_of_nothing(spark, documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert slack_packing.pack_documents(documents.limit(0), path).count() == 0
    one = slack_packing.pack_documents(spark.createDataFrame([(None, None)], "doc_id long, text string"), path).collect()
    assert [(r["doc_id"], r["length"], r["offset"], r["ids_crc32"]) for r in one] == [(None, 1, 0, zlib.crc32(b"\1\0\0\0"))]
    with pytest.raises(ValueError, match="power of two"):
        slack_packing.pack_documents(documents, path, capacity=1000)


# Lloyd


def brute_lloyd(rows, k, rounds, size):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in first[:k]]
    distance = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    assign = lambda: [min((distance(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        members = collections.defaultdict(list)
        for (_, v), (_, j) in zip(kept, assign(), strict=True):
            members[j].append(v)
        centroids = [[sum(c) // len(members[j]) for c in zip(*members[j], strict=True)] if members[j] else centroid for j, centroid in enumerate(centroids)]
    last = assign()
    inertia = collections.Counter()
    for d, j in last:
        inertia[j] += d
    digest = lambda j: hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()
    return collections.Counter((i, j, d, inertia[j], sum(inertia.values()), digest(j)) for (i, _), (d, j) in zip(kept, last, strict=True))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_lloyd_equals_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    rows = [(int(i), v.tolist()) for i, v in enumerate(rng.normal(size=(400, 6)).astype(np.float32) + rng.integers(-3, 4, (400, 1)))]
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, rows[3][1]), (500, None), (501, []), (502, [1.0] * 5), (503, [1.0] * 7), (504, [float("nan")] * 6), (505, [1.0, None, 1, 1, 1, 1]), (506, [float("inf")] * 6), (507, [0.0] * 6), (508, [-0.001] * 6)]
    rows += [(600 + i, [0.5] * 6) for i in range(30)] + [(700, [400_000.0, -400_000.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v if v is None else [x if x is None else float(x) for x in v], "clash", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string, x int").repartition(5)
    got = collections.Counter(map(tuple, lloyd.cluster(df, k=9, rounds=5, size=6).collect()))
    assert got == brute_lloyd(rows, 9, 5, 6) and len({r[1] for r in got}) > 3


def test_lloyd_of_few_equal_or_too_large_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1e7, 0.0]), (4, [1e300, 0.0])], schema)
    got = {r["vec_id"]: (r["cluster"], r["distance"]) for r in lloyd.cluster(few, k=40, size=2).collect()}
    assert got[1] == got[2] and got[1][1] == 0 and 4 not in got and set(got) <= {1, 2, 3}
    for none in (few.limit(0), spark.createDataFrame([(1, None), (2, [1.0])], schema), spark.createDataFrame([(None, [1.0, 2.0])], schema)):
        assert lloyd.cluster(none, size=2).count() == 0
