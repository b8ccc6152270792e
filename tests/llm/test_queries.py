"""The registered queries over the driver's smallest tables, against SQL where there is any."""

import base64
import collections
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers

from vigil.llm import queries

DATA = "/root/testdata/sf0.001"
CONTRACTS = {
    "op1_quality_crf": ("documents", "doc_id held_out score predicted"), "op2_url_filter": ("pages", "page_id host path rule verdict"),
    "op3_byte_bpe": ("documents", "doc_id n_tokens ids_sha256 decoded_sha256"), "op8_pii": ("documents", "doc_id n_email n_ip n_card n_phone base_sha256 spans"),
}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([row[i] for i in order]) for row in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, DATA), con.execute(queries.ORACLE_SQL[name])
    columns, rows = [c[0] for c in want.description], got.collect()
    assert sorted(got.columns) == sorted(columns) and rows and rows_of(rows, got.columns) == rows_of(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_query_has_a_row_for_each_input_row(spark, name):
    table, columns = CONTRACTS[name]
    got = queries.QUERIES[name](spark, DATA)
    assert set(columns.split()) <= set(got.columns)
    key = columns.split()[0]
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in queries.table(spark, DATA, table).select(key).collect())


def test_packing_query_covers_every_document(spark):
    got = queries.op4_best_fit_packing(spark, DATA).toPandas()
    assert set(got["doc_id"]) == {r[0] for r in queries.table(spark, DATA, "documents").select("doc_id").collect()}
    assert got.groupby("sequence_id")["length"].sum().max() <= 4096


def test_slack_packing_query_pads_nothing(spark):
    got = queries.op12_slack_packing(spark, DATA).toPandas()
    assert set(got["doc_id"]) == {r[0] for r in queries.table(spark, DATA, "documents").select("doc_id").collect()}
    fills = got.groupby("sequence_id")["length"].sum()
    assert fills.max() == 2048 and sum(n != 2048 for n in fills) <= 11 and all(n & n - 1 == 0 for n in fills.tolist())
    assert (got.groupby("doc_id")["length"].sum() == got.groupby("doc_id")["doc_tokens"].first()).all()


# Whole contents of queries that SQL cannot express


def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in queries.table(spark, DATA, "documents").select("doc_id", "text").collect()}


def test_byte_bpe_query_equals_the_library(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = {}
    for doc_id, text in documents(spark).items():
        ids = library.encode_ordinary(text)
        want[doc_id] = (len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(text.encode()))
    got = queries.op3_byte_bpe(spark, DATA).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize(("query", "file", "capacity"), [("op4_best_fit_packing", "word_bpe_49k.json", 4096), ("op12_slack_packing", "byte_bpe_50k.json", 2048)])
def test_packed_pieces_are_the_ids_of_the_library(spark, query, file, capacity):
    library, pieces = tokenizers.Tokenizer.from_file(public_tokenizers.path(file)), collections.defaultdict(list)
    for r in queries.QUERIES[query](spark, DATA).collect():
        pieces[r["doc_id"]].append(r)
    texts = documents(spark)
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        ids, at = np.array([*library.encode(text, add_special_tokens=False).ids, 1], dtype="<u4").tobytes(), 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and 0 < r["length"] <= capacity and r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert 4 * at == len(ids)


def test_pii_query_has_the_spans_of_the_patterns(spark):
    digits = lambda t: re.sub("[^0-9]", "", t)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 14 <= len(digits(t)) <= 19 and luhn(digits(t))), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 10 <= len(digits(t)) <= 15),
    }
    want = {}
    for doc_id, text in documents(spark).items():
        own = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(patterns.values()) for m in re.finditer(p, text) if ok(m[0]))
        line = ",".join(f"{list(patterns)[k]}:{a}:{b}" for a, k, b in own)
        want[doc_id] = (*(sum(k == j for _, k, _ in own) for j in range(4)), hashlib.sha256(line.encode()).hexdigest(), set(line.split(",")) - {""})
    for r in queries.op8_pii(spark, DATA).collect():
        *counts, digest, spans = want.pop(r["doc_id"])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts and r["base_sha256"] == digest
        assert spans <= set(r["spans"].split(",")) and (bool(spans) or not r["spans"])
    assert not want


def test_url_query_finds_hosts_paths_and_rules(spark):
    rules = {(r.host, r.path): r for r in queries.URL_RULES}
    urls = {r["page_id"]: r["url"] for r in queries.table(spark, DATA, "pages").select("page_id", "url").collect()}
    for r in queries.op2_url_filter(spark, DATA).collect():
        found = re.match(r"(?s)(?:.*?)://([^/?#]*)([^?#]*)", urls.pop(r["page_id"]) or "")
        host, path = (found[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), found[2]) if found else ("", "")
        fits = [x for (h, p), x in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x.text), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best.text if best else None) and r["verdict"] in ("block", "allow")
        assert best is None or r["verdict"] == best.verdict
    assert not urls
