"""Operators on pages and embeddings, and the pipeline, against brute force."""

import collections
import io
import random
import struct
import zipfile

import numpy as np
import public_tokenizers
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vigil.llm import components as components_module, embedding_dedup, packing, pii, storage, urls, vptree, warc_zip
from vigil.llm.components import components
from vigil.llm.queries import URL_RULES

# URLs


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:end], rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text), default=None)


def test_url_rules_and_trees(spark):
    rng = random.Random(5)
    odd = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x=1#y", "x://É.com/en/\n9", "http://com/en/", "http://xcom/en/1", "http://a.net?/de/", "a://b://c.org/es/x", "http://u.example.net/de/8#", "http://q.example.com/en/7" + "z" * 20_000]
    made = [f"https://{rng.choice('abcd')}{rng.choice(['.example.com', '.example.net', '.example.org'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(90)}{rng.choice(['', '?p=1&q=2', '#top'])}" for _ in range(300)]
    rows = [(i if i else None, u, 1) for i, u in enumerate(odd + made + made[:3])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host int")
    got = collections.Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in urls.judge(pages, URL_RULES).collect())
    assert got == collections.Counter((i, *brute_rule(u)[:2], brute_rule(u)[2].text if brute_rule(u)[2] else None) for i, u, _ in rows)
    for r in urls.judge(pages, URL_RULES).collect():
        assert r["verdict"] == next((x.verdict for x in URL_RULES if x.text == r["rule"]), "block" if r["blocked"] >= 0.5 else "allow")
    assert urls.judge(pages.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, URL_RULES[:1]).collect()} == {"block"}  # one class to learn from


def test_trees_learn_held_out_urls(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1200):
        bad = rng.random() < 0.5
        path = f"/{'ads' if bad else 'en'}/{rng.randrange(10**8 if bad else 100)}" + ("?a=1&b=2&c=3" if bad and rng.random() < 0.8 else "")
        rows.append((f"https://{rng.choice('abc')}.{'spam.example' if bad else 'good.example'}{path}", "block" if bad else "allow"))
    df = spark.createDataFrame(rows, "url string, verdict string").withColumn("host", urls.host_of(F.col("url"))).withColumn("path", urls.path_of(F.col("url")))
    model = urls.train(df.limit(800))
    scored = model.score(df.select("url", "host", "path", "verdict")).collect()[800:]
    assert np.mean([(r["blocked"] >= 0.5) == (r["verdict"] == "block") for r in scored]) > 0.95


def test_copies_of_one_url_do_not_fill_the_sample(spark):
    rows = [("http://a.com/en/1", "block")] * 3000 + [(f"http://h{i}.net/de/{i}", "allow") for i in range(300)] + [(f"http://h{i}.com/en/{i}", "block") for i in range(300)]
    df = spark.createDataFrame(rows, "url string, verdict string").withColumn("host", urls.host_of(F.col("url"))).withColumn("path", urls.path_of(F.col("url")))
    model = urls.train(df, max_rows=200)
    assert model.trees is not None and abs(model.prior - 3300 / 3600) < 1e-9
    scored = model.score(df.dropDuplicates(["url"]).select("url", "host", "path", "verdict")).collect()
    assert np.mean([(r["blocked"] >= 0.5) == (r["verdict"] == "block") for r in scored]) > 0.99
    counts = model.counts.value
    assert counts[: urls.BUCKETS].sum(axis=0).tolist() == [3600, 3300] == counts[urls.BUCKETS :].sum(axis=0).tolist()


# WARC


def pages_table(spark):
    html = ["<p>x</p>", "<p>x</p>", None, "", "é" * 5000, "<p>x</p>", "long " * 300_000, "a\r\n\r\nb"]
    rows = [(i + 1, f"https://e.example/{i}\r\nX: y", h, i) for i, h in enumerate(html)] + [(None, None, "<p>x</p>", 9), (None, None, "only", 9)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest int")


FIVE = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def brute_warc(rows, least):
    out, best = [], {}
    for p, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if p is None else p)
    for p, h in rows:
        b = (h or "").encode()
        response = len(b) < least or (-1 if p is None else p) == best[h or ""]
        first = best[h or ""]
        out.append((p, len(b), warc_zip.base32_sha1(b), "response" if response else "revisit", None if response else first))
    return collections.Counter(out)


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    pages = pages_table(spark)
    got = warc_zip.read(warc_zip.write(pages.repartition(3), storage.new_path(spark, "w"), least_bytes=least))
    records = got.collect()
    named = {r["record_id"]: r for r in records}
    assert len(named) == len(records) and all(named[r["refers_to_id"]]["payload_digest"] == r["payload_digest"] and named[r["refers_to_id"]]["record_type"] == "response" for r in records if r["record_type"] == "revisit")
    assert collections.Counter(bytes(r["payload"]).decode() for r in records if r["payload"]) == collections.Counter(h for h in {r["html"] for r in pages.collect()} if h)
    assert collections.Counter(map(tuple, got.select(*FIVE).collect())) == brute_warc([(r["page_id"], r["html"]) for r in pages.collect()], least)
    assert warc_zip.read(warc_zip.write(pages.limit(0), storage.new_path(spark, "w"))).count() == 0


def test_repeated_pages_have_one_response(spark):
    pages = spark.createDataFrame([(7, "u", "same")] * 3 + [(3, "u", "same")], "page_id long, url string, html string")
    got = warc_zip.read(warc_zip.write(pages, storage.new_path(spark, "w"))).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["refers_to"]) == [(3, "revisit", 7), (7, "revisit", 7), (7, "revisit", 7)] and len(got) == 4


def test_zip64_directory_and_missing_index(tmp_path):
    data = [warc_zip.record(i, f"u{i}", b"p" * i, warc_zip.base32_sha1(b"p" * i)) for i in range(4)]
    import gzip

    member = b"".join(gzip.compress(d) for d in data)
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("records.warc.gz", member)
        z.comment = b"a comment"
    raw = plain.getvalue()
    end = raw.rfind(b"PK\x05\x06")
    count, size, start = struct.unpack_from("<HII", raw, end + 10)
    entry = bytearray(raw[start : start + size])
    packed, full = struct.unpack_from("<II", entry, 20)
    offset = struct.unpack_from("<I", entry, 42)[0]
    entry[20:28], entry[42:46] = b"\xff" * 8, b"\xff" * 4
    extra = struct.pack("<HHQQQ", 1, 24, full, packed, offset)
    entry[30:32] = struct.pack("<H", len(extra))
    entry += extra
    record64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, len(entry), start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, start + len(entry), 1)
    tail = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    for name, content in (("plain.zip", raw), ("big.zip", raw[:start] + bytes(entry) + record64 + locator + tail)):
        (tmp_path / name).write_bytes(content)
        archive = warc_zip._Range(f"file://{tmp_path}/{name}")
        ranges = list(warc_zip.record_ranges(archive))
        assert [warc_zip.parse(gzip.decompress(archive.read(a, n)))[4::3] for a, n in ranges] == [(i, i) for i in range(4)]
    with zipfile.ZipFile(tmp_path / "packed.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("records.warc.gz", b"a" * 1000)
    for name in ("packed.zip", "none.zip"):
        (tmp_path / "none.zip").write_bytes(b"nothing here")
        with pytest.raises(ValueError):
            warc_zip.members(warc_zip._Range(f"file://{tmp_path}/{name}"))
    assert pyarrow.fs.FileSystem.from_uri(f"file://{tmp_path}")


@pytest.mark.parametrize("few", [200_000, 0])
def test_one_payload_on_many_pages(spark, monkeypatch, few):
    monkeypatch.setattr(warc_zip, "BROADCAST_ROWS", few)
    rows = [(i, f"u{i}", "same" if i % 3 else None if i % 2 else f"own {i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    written = warc_zip.write(pages, storage.new_path(spark, "w"))
    assert max(r["records"] for r in written.collect()) < 200  # equal payloads stay in their partitions
    assert collections.Counter(map(tuple, warc_zip.read(written).select(*FIVE).collect())) == brute_warc([(i, h) for i, _, h in rows], 0)


@pytest.mark.parametrize("packed", [True, False])
def test_archives_of_another_writer(spark, tmp_path, packed):
    import gzip

    head = lambda kind, n, *more: ("\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{n:032d}>", "WARC-Date: 2020-01-01T00:00:00Z", *more])).encode()
    whole = lambda start, block: start + f"\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    records = [
        whole(head("warcinfo", 1, "Content-Type: application/warc-fields"), b"software: other\r\n"),
        whole(head("request", 2, "Content-Type: application/http;msgtype=request"), b"GET / HTTP/1.1\r\n\r\n"),
        whole(head("response", 3, "WARC-Target-URI: http://a.example/", "Content-Type: application/http; msgtype=response"), http + b"body"),
        whole(head("revisit", 4, "WARC-Refers-To: <urn:uuid:3>", "Content-Type: application/http;msgtype=response"), http),
        whole(head("metadata", 5), b"x"), whole(head("response", 6, "WARC-Payload-Digest: sha256:00", "Content-Type: application/http"), http),
    ]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("data.warc.gz" if packed else "data.warc", b"".join(map(gzip.compress, records) if packed else records))
        z.writestr("data.cdx", "com,example)/ 2020 http://a.example/ text/html 200 AAAA - - 10 20 data.warc.gz\n")
        z.writestr("readme.txt", "no records")
    got = warc_zip.read(spark.createDataFrame([(f"file://{tmp_path}/a.zip",)], "path string")).orderBy("record_id").collect()
    assert [(r["record_id"][-2], r["record_type"], r["payload_bytes"], r["page_id"], r["refers_to_id"]) for r in got] == [("3", "response", 4, None, None), ("4", "revisit", None, None, "<urn:uuid:3>"), ("6", "response", 0, None, None)]
    assert got[0]["payload_digest"] == warc_zip.base32_sha1(b"body") and bytes(got[0]["payload"]) == b"body" and got[1]["payload_digest"] is None


# Vectors


def vectors_table(spark, n=400, dims=8):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, dims))
    x[50:90] = x[0]
    x[90:130] = x[1] + rng.normal(scale=0.03, size=(40, dims))
    x[130:150] *= 5
    rows = [(i, [float(v) for v in r], i % 3 if i >= 130 else 1, 0) for i, r in enumerate(x.astype(np.float32))]
    bad = [(400, None, 1, 0), (420, [0.0] * dims, 1, 0), (440, [float("nan")] + [1.0] * (dims - 1), 1, 0), (460, [None] + [1.0] * (dims - 1), 1, 0), (480, [float("inf")] * dims, 1, 0), (500, [1.0] * 3, 1, 0), (520, [1.0] * dims, None, 0), (521, [1.0] * dims, None, 0)]
    rows += bad + [rows[60], rows[0]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank int"), dims


def usable(rows, dims):
    ok = [(r["vec_id"], np.array(r["embedding"], dtype=float), r["label"]) for r in rows if r["embedding"] is not None and len(r["embedding"]) == dims and None not in r["embedding"]]
    return [(i, v, y) for i, v, y in ok if np.isfinite(v).all() and v.any()]


@pytest.mark.parametrize(("factor", "recall"), [(1.0, 1.0), (1.05, 0.9)])
def test_vptree_search(spark, factor, recall, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 90)
    table, dims = vectors_table(spark)
    own = usable(table.collect(), dims)
    got = collections.defaultdict(list)
    for r in vptree.nearest(table.repartition(3), every=20, k=20, factor=factor, sample_rows=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for q, v, _ in own:
        if q % 20 == 0:
            want = sorted(((-float((v * w).sum()), i) for i, w, _ in own if i != q))[:20]
            assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
            if factor == 1.0:
                assert [i for i, _ in got[q]] == [i for _, i in want] and np.allclose([s for _, s in got[q]], [-s for s, _ in want], rtol=1e-12)
            hits += sum(s >= -want[-1][0] - 1e-12 for _, s in got[q])
            total += len(want)
    assert hits >= recall * total and set(got) == {q for q, _, _ in own if q % 20 == 0}
    assert vptree.nearest(table.limit(0)).count() == 0
    few = vptree.nearest(table.where("vec_id in (100, 140, 141)").limit(3)).collect()
    assert all(r["vec_id"] != r["query_id"] for r in few)


def brute_links(rows, dims, least=0.98):
    own = [(k, np.array(r["embedding"], dtype=float), r["label"]) for k, r in enumerate(rows) if r["label"] is not None and usable([r], dims)]
    ids, links = [-(2**63) if r["vec_id"] is None else r["vec_id"] for r in rows], collections.Counter()
    groups = {k: {k} for k in range(len(rows))}
    for a, (k, v, y) in enumerate(own):
        for m, w, z in own[:a]:
            if y == z and (v * w).sum() / np.linalg.norm(v) / np.linalg.norm(w) >= least:
                links[k] += 1
                links[m] += 1
                both = groups[k] | groups[m]
                for x in both:
                    groups[x] = both
    real = lambda x: None if x == -(2**63) else x
    low = [min(ids[x] for x in groups[k]) for k in range(len(rows))]
    return collections.Counter((r["vec_id"], links[k], real(low[k]), ids[k] == low[k]) for k, r in enumerate(rows))


@pytest.mark.parametrize("block", [16, 2048])
def test_embedding_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    table, dims = vectors_table(spark)
    assert collections.Counter(map(tuple, embedding_dedup.near_duplicates(table.repartition(3)).collect())) == brute_links(table.collect(), dims)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("block", [40, 2048])
def test_links_across_cells(spark, monkeypatch, block):
    """Vectors of three dimensions in 20 cells, with links over all their borders, ids that repeat and rows without one."""
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(420, 3)).astype(np.float32)
    rows = [(None if i % 50 == 7 else i // 2 if i % 9 == 0 else i, [float(v) for v in r], i % 2 if i > 400 else 0, 5) for i, r in enumerate(x)]
    table = spark.createDataFrame([*rows, rows[3], rows[4]], "vec_id long, embedding array<float>, label int, cell int")
    for least in (0.98, 0.999):
        got = collections.Counter(map(tuple, embedding_dedup.near_duplicates(table.repartition(3), least=least, sample_rows=160).collect()))
        assert got == brute_links(table.collect(), 3, least)


@pytest.mark.parametrize("hub", [256, 3])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(components_module, "HUB_EDGES", hub)
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, int(x)) for x in range(101, 160)] + [tuple(map(int, e)) for e in rng.integers(200, 260, (40, 2))]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {n: n for e in edges for n in e}
    while True:
        before = dict(root)
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
        if before == root:
            break
    linked = {n for u, v in edges if u != v for n in (u, v)}
    assert got == {n: root[n] for n in linked}


# Pipeline


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in "ba co di fu ge hi".split() for b in "lor men sat ver ning pot".split()]
    line = lambda: " ".join(rng.choice(words, 14)).capitalize() + "."
    texts = ["\n".join(line() for _ in range(6)) for _ in range(90)]
    passage = " ".join(rng.choice(words, 60))
    texts[10], texts[11] = texts[10] + "\n" + passage + ".", texts[11] + "\n" + passage + "."
    texts[20] = texts[21] + " And more."
    texts[30] += "\nWrite to ann.lee@mail.example.org at once."
    junk = [" ".join(w.upper() + "!!" for w in rng.choice(words, 80)) for _ in range(45)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts + junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 90), 0) for i in range(135) if i % 3], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        kept = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen[name] = {r["doc_id"]: r["text"] for r in kept.collect()} if "text" in kept.columns else kept.collect()
        assert k == 4 or kept.columns == docs.columns
    quality, near, passages, private, packed = (seen[n] for n, _ in corpus_pipeline.STAGES)
    assert set(quality) <= set(range(90)) and len(quality) >= 88
    assert set(quality) - set(near) == {21} and 20 in near
    assert passage.split()[30] and passage in passages[10] and passage not in passages[11] and passages[40] == texts[40]
    assert "ann.lee" not in private[30] and "<EMAIL>" in private[30] and private[40] == texts[40]
    own = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r["length"] for r in packed) == sum(len(own.whole(t)) // 4 + 1 for t in private.values())
    assert collections.Counter((r["doc_id"], r["length"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == collections.Counter((r["doc_id"], r["length"]) for r in packed)
    assert pii.KINDS[4] == "term"


def test_near_dedup_of_clashing_and_missing_ids(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    text = lambda k, *more: " ".join([f"{w}k{k}" for w in words] + list(more))
    rows = [(1, text(1)), (2, text(1, "end")), (2, text(2)), (3, text(3)), (3, text(3)), (None, text(4)), (None, text(5)), (9, text(5, "end")), (7, None), (7, None), (7, ""), (8, text(8)), (8, text(8, "more"))]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, goes string")
    kept = corpus_pipeline.near_dedup(spark, docs.repartition(3), str(tmp_path)).collect()
    left = collections.Counter((r["doc_id"], r["text"]) for r in kept)
    eight = [k for k in left if k[0] == 8]
    assert len(eight) == 1 and left - collections.Counter(eight) == collections.Counter([rows[0], rows[2], rows[3], rows[5], rows[6], rows[8], rows[9], rows[10]])


def test_a_cluster_needs_the_shared_folder(spark, monkeypatch):
    class Elsewhere:
        master, applicationId = "spark://host:7077", "none"

    class Session:
        conf, sparkContext = spark.conf, Elsewhere()

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.shared_dir(Session())


def test_stages_on_empty_documents(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


# Searches at all sizes of vectors


@pytest.mark.parametrize(("norm", "dimensions"), [(1e-3, 64), (1e4, 64), (1e4, 8), (1e3, 768), (1e150, 64)])
def test_search_returns_all_neighbours_at_every_norm(spark, norm, dimensions):
    rng, n, k, every = np.random.default_rng(dimensions), 1_000, 20, 50
    x = rng.normal(size=(n, dimensions)) * norm * rng.choice([1e-3, 1.0], (n, 1))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    score = np.zeros((n // every, n))
    for d in range(dimensions):
        score += x[::every, d][:, None] * x[:, d][None, :]
    want = {}
    for i in range(0, n, every):
        others = [j for j in np.lexsort((np.arange(n), -score[i // every])).tolist() if j != i][:k]
        want |= {(i, r + 1): (j, score[i // every, j]) for r, j in enumerate(others)}
    got = vptree.nearest(df, every=every, k=k, factor=1.0, sample_rows=100).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Columns that operators add under the same names are not the table's own."""
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in "ba co di fu ge hi".split() for b in "lor men sat ver ning pot".split()]
    line = lambda: " ".join(rng.choice(words, 14)).capitalize() + "."
    texts = ["\n".join(line() for _ in range(6)) for _ in range(40)] + [" ".join(w.upper() + "!!" for w in rng.choice(words, 80)) for _ in range(20)]
    passage = " ".join(rng.choice(words, 40))
    texts[1], texts[2], texts[3] = texts[1] + "\n" + passage, texts[2] + "\n" + passage, texts[3] + " Mail to bo@mail.example.org."
    own = ["score", "line_labels", "n_words", "n_removed", "kept_text", "row", "spans", "goes", "first", "base", "rid"]
    rows = [(i, t, *[f"{c}{i}" for c in own], len(t)) for i, t in enumerate(texts)] + [(None, None, *["x"] * len(own), 0), (70, "", *["y"] * len(own), 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in own) + ", n_chars long")
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{k}"))
        if k == 4:
            break
        got = spark.read.parquet(str(tmp_path / f"s{k}"))
        assert got.schema == docs.schema, name
        left = {r["doc_id"]: r for r in got.collect()}
        assert len(left) > 35 and all(left[i][c] == f"{c}{i}" for i in left if i is not None and i < 60 for c in own), name
        assert all(r["n_chars"] == len(r["text"] or "") for r in left.values()), name
        assert (None in left, 70 in left) == ((False, False) if k == 0 else (True, True)), name
    assert {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "s4")).collect()} == {r[0] for r in rows}


# Where archives go


def test_archives_go_where_hadoop_points(spark, tmp_path):
    assert storage.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    assert warc_zip.store(f"file:{tmp_path}")[1] == str(tmp_path) and warc_zip.store(f"file://{tmp_path}")[1] == str(tmp_path)
    assert warc_zip.arrow_uri("s3a://bucket/a/b") == "s3://bucket/a/b" and warc_zip.arrow_uri("hdfs://name:8020/a") == "hdfs://name:8020/a"
    with pytest.raises(ValueError, match="cannot be in viewfs"):
        warc_zip.store("viewfs://cluster/a")
    pages = spark.createDataFrame([(1, "http://a.b/", "x"), (2, "http://a.b/2", "x")], "page_id long, url string, html string")
    written = warc_zip.write(pages, str(tmp_path / "plain"))  # without a scheme
    paths = [r["path"] for r in written.collect()]
    assert paths and all(p.startswith("file:/") for p in paths)
    bare = spark.createDataFrame([(p.removeprefix("file:"),) for p in paths], "path string")
    for archives in (written, bare):
        assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc_zip.read(archives).collect()} == {(1, "revisit", 2), (2, "response", None)}


def test_labelled_text_above_the_bound_is_learnt_from(spark):
    """The bound cuts the document that crosses it; shorter ones behind it do not take its place."""
    from vigil.llm import quality

    long = "\n".join(f"A fine line number {i} of many words." for i in range(300))
    docs = spark.createDataFrame([(i, long if i % 2 else "BAD!! 000\n" * 300) for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, label int")
    seen = []
    fitted = quality.fit
    try:
        quality.fit = lambda taken: seen.append([len(x[0]) for x in taken]) or fitted(taken)
        quality.train(docs, labels, max_lines=450)
    finally:
        quality.fit = fitted
    assert seen == [[300, 150]]


def test_url_statistics_do_not_tell_a_row_its_own_label(spark):
    """Each URL alone on its host: within the data its host's rate is its label, out of fold the prior."""
    rows = [(f"https://h{i}.only{i}.example/en/{i}", "block" if i % 2 else "allow") for i in range(200)]
    df = spark.createDataFrame(rows, "url string, verdict string").withColumn("host", F.lit("").cast("string")).withColumn("host", urls.host_of(F.col("url"))).withColumn("path", urls.path_of(F.col("url")))
    model = urls.train(df)
    n = len(urls.lexical("", "", ""))
    labelled = df.select("url", "host", "path", (F.col("verdict") == "block").cast("int").alias("label"))
    rate = lambda **o: np.array([(r["features"][n], r["features"][n + 1], r["label"]) for r in model.features(labelled, **o).collect()])
    inside, outside = rate(), rate(out_of_fold=True)
    assert np.corrcoef(inside[:, 0], inside[:, 2])[0, 1] > 0.2 > abs(np.corrcoef(outside[:, 0] + 1e-9 * np.arange(200), outside[:, 2])[0, 1])
    assert (inside[:, 1] >= outside[:, 1]).all()
