"""Registered queries as a whole against plain computations: token files, fingerprints, URLs with planted links."""

import re
import zlib

import numpy as np
import pytest
import xxhash

from curatrix.llm import simhash, tokens, urls

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_token_files_of_all_documents(spark, tok):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tok("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want, start = {}, 0
    for k in sorted(docs):
        ids = np.array([*t.encode(docs[k], add_special_tokens=False).ids, 0], "<u4")
        want[k] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.op2_token_files(spark, SF).collect()} == want


def test_fingerprints_and_groups_of_all_documents(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    marks = {}
    for k, text in docs.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = np.array([xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles], np.uint64)
        marks[k] = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h)) if len(h) else 0
    low = {k: k for k in docs}
    while True:  # smallest id reachable, by plain rounds over all pairs
        new = {k: min(low[j] for j in docs if (marks[k] ^ marks[j]).bit_count() <= 2) for k in docs}
        if new == low:
            break
        low = new
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op3_simhash(spark, SF).collect()}
    assert got == {k: (f"{marks[k]:016x}", low[k]) for k in docs}


def test_urls_follow_planted_links(spark, tmp_path):
    tag = lambda u: f'<html><head><link rel="canonical" href="{u}"></head><body>{"x" * 200_000}</body>'
    pages = [
        (1, "http://a.org/x", tag("http://bad.net/y")),  # an alias of a blocked page
        (2, "http://a.org/fr/x", tag("//bad.net/y")),  # its own rule allows it
        (3, "http://b.org/1", '<meta http-equiv="refresh" content="0; url=/2">'),
        (4, "http://b.org/2", tag("http://c.org/3")),
        (5, "http://c.org/3", '<META http-equiv=refresh content="5;url=https://example.com/de/z">'),  # the end of a chain of three
        (6, "http://d.org/1", tag("http://d.org/2")),
        (7, "no address", tag("http://bad.net/y")),
        (8, None, None),
        (9, "http://bad.net/y?q#f", ""),
        (10, "http://example.net/en/a", tag("http://other.net/b")),
        (1, "http://a.org/x", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as verdict", "3 as node")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r["page_id"], r["rule"] or "", r["verdict"], r["spread"]) for r in urls.op10_urls(spark, str(tmp_path)).collect())
    assert got == [
        (1, "", "block", True), (1, "", "block", True), (2, "org/fr/", "allow", False), (3, "", "block", True), (4, "", "block", True), (5, "", "block", True),
        (6, "", "allow", False), (7, "", "allow", False), (8, "", "allow", False), (9, "net/", "block", False), (10, "example.net/en/", "allow", False),
    ]
