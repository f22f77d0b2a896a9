"""The ten operators against brute force, on small tables with every odd row, and on the smallest driver tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from curatrix.llm import bpe, encoding, graph, mixing, quality_model, queries, rules, sharding, simhash, tokens, toxicity, urls, vectors

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def union_find(n, pairs):
    p = list(range(n))

    def find(a):
        while p[a] != a:
            p[a] = p[p[a]]
            a = p[a]
        return a

    for a, b in pairs:
        p[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 470)] + [(500, 500 + i) for i in range(1, 90)] + [(7, 7)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    root = union_find(600, edges)
    low = defaultdict(lambda: 10**9)
    for i, r in enumerate(root):
        low[r] = min(low[r], i)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: low[root[i]] for i in touched}
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()


# 1
def test_mix_oracle(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    got, want = mixing.op1_mixing(spark, SF).toPandas(), con.execute(mixing.OP1_SQL).df()
    assert sorted(map(tuple, got[cols].values)) == sorted(map(tuple, want[cols].values))
    total = got["size"].sum()
    assert got.taken.sum() <= 1.5 * total and (got.taken <= 2 * got["size"]).all()
    assert abs(got.taken.sum() - 1.5 * total) <= got["size"].max()


def test_mix_odd_rows(spark, docs, empty):
    got = mixing.mix(docs)
    assert got.columns[: len(docs.columns)] == docs.columns and got.columns[-1] == "mix_copies_"
    rows = got.collect()
    assert len(rows) == 10 and all(0 <= r.mix_copies_ <= 2 for r in rows)
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(empty).isEmpty()


def test_mix_targets(spark):
    sizes = spark.createDataFrame([("a", 1, 100), ("b", 1, 100), (None, 1, 100)], "source string, source_rows long, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 200 and got["b"] == pytest.approx(250 / 3) and got[None] == pytest.approx(500 / 3)


# 2
@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    for n in (0, 1, 63, 64, 65, 1000):
        a = np.random.default_rng(n).integers(0, 2**bits, n).astype(np.uint32)
        assert (tokens.unpack(tokens.pack(a, bits), bits, n) == a).all() and len(tokens.pack(a, bits)) == -(-n // 64) * bits * 8


def test_token_files(spark, docs, tok, tmp_path):
    folder, path = f"file://{tmp_path}", tok("byte_bpe_50k.json")
    got = tokens.read_tokens(tokens.write_tokens(docs, path, folder, block=100), folder).collect()
    t = encoding.load(path)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want = Counter((r.doc_id, len(i := [*t.encode(r.text or "", add_special_tokens=False).ids, 0]), zlib.crc32(np.array(i, "<u4").tobytes())) for r in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    one = max(got, key=lambda r: r.n_tokens)
    reader = tokens.FileReader(f"{folder}/{one.file}")
    whole = reader.read(one.file_start, one.file_start + one.n_tokens)
    assert (reader.read(one.file_start + 205, one.file_start + 411) == whole[205:411]).all() and whole[-1] == 0


def test_token_files_empty(spark, empty, tok, tmp_path):
    folder = f"file://{tmp_path}"
    assert tokens.read_tokens(tokens.write_tokens(empty, tok("byte_bpe_50k.json"), folder), folder).isEmpty()


PIECES = ["a", "the", "'s", "é", "é", "́", "İ", "ß", "12", "!!", " ", "  ", "\n", "\n\n", " \n", "\t", " ", "<|endoftext|>", "<|end", "中", "😀", "THE", ".", ",", "_", "word.", "\nx", "­", "\x1c"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60))
def test_encoders_equal_the_library(parts):
    import public_tokenizers

    text = "".join(parts)
    path = public_tokenizers.path("byte_bpe_50k.json")
    e = tokens.encoder(path)
    assert list(tokens.encode(e, text)) == e[0].whole(text)
    c = bpe.coder(public_tokenizers.path("word_bpe_49k.json"))
    ids = c.whole(text)
    assert c.described(c.encode(text), True)[3:] == (" ".join(map(str, ids)), c.tokenizer.decode(ids, skip_special_tokens=False))
    for leaf in (3, 16, 50):
        c.leaf = leaf
        assert [i for unit in c.encode(text * 3).ids for i in unit] == c.whole(text * 3)
    c.leaf = bpe.LEAF


# 3
def hamming_components(ids, prints, radius):
    x = [int(f, 16) for f in prints]
    root = union_find(len(x), [(i, j) for i in range(len(x)) for j in range(i) if (x[i] ^ x[j]).bit_count() <= radius])
    low = {}
    for i, r in zip(ids, root, strict=True):
        low[r] = min(low.get(r, i), i)
    return [low[r] for r in root]


def test_fingerprint():
    import xxhash

    text = "Ab CD ef\x0bgh  ij"
    hs = [xxhash.xxh64_intdigest(s, 42) for s in (b"ab cd ef", b"cd ef gh", b"ef gh ij")]
    want = sum((2 * sum(h >> b & 1 for h in hs) > 3) << b for b in range(64))
    assert simhash.fingerprint(text) == (want.to_bytes(8, "big"), 3)
    assert simhash.fingerprint("")[0] == bytes(8) and simhash.fingerprint("A b")[0] == xxhash.xxh64_digest(b"a b", 42)
    assert simhash.fingerprint("x " * 900, bits=256)[0][:8] == simhash.fingerprint("x " * 900)[0]


def test_simhash_query(spark):
    got = simhash.op3_simhash(spark, SF).toPandas()
    assert list(got.component_id) == hamming_components(list(got.doc_id), list(got.fingerprint), 2)


@pytest.mark.parametrize("radius,leaf,sample,leaves", [(2, 40, 4096, 6), (9, 40, 4096, 0), (2, 7, 4096, 20), (2, 7, 100, 8)])
def test_vantage_tree_finds_every_link(spark, radius, leaf, sample, leaves):
    """The last case has room for 6 leaves a level, so leaves get trees of their own."""
    rng = np.random.default_rng(radius)
    base = [int(b) for b in rng.integers(0, 2**63, 40)]
    x = sorted({b ^ sum(1 << k for k in {int(k) for k in rng.integers(0, 64, rng.integers(0, 6))}) for b in base for _ in range(15)})
    df = spark.createDataFrame([(bytearray(int(v).to_bytes(8, "big") + bytes(8)),) * 2 for v in x], "id binary, data binary")
    seats = simhash.seats(df, simhash.Rule(64, radius, leaf=leaf), sample)
    assert seats.filter("not visitor").count() == len(x) and seats.select("cell").distinct().count() > leaves
    got = {bytes(r.id): bytes(r.component) for r in simhash.linked(df, simhash.Rule(64, radius, leaf=leaf), sample).collect()}
    want = hamming_components(list(map(int, x)), [f"{int(v):x}" for v in x], radius)
    full = {int(v): w for v, w in zip(x, want, strict=True)}
    sizes = Counter(want)
    assert {int.from_bytes(k[:8], "big"): int.from_bytes(v[:8], "big") for k, v in got.items()} == {k: v for k, v in full.items() if sizes[v] > 1}


def test_simhash_odd_rows(spark, docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert Counter(r.component_id for r in got if r.doc_id in (1, 5)) == {1: 3}
    assert all(r.component_id == 2 for r in got if r.doc_id in (2, 3)) and len(got) == 10
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "6", "7", "None"]
    assert simhash.near_duplicates(empty).isEmpty() and simhash.deduplicate(empty).isEmpty()


# 4 and 6
def auc(score, y):
    r = np.argsort(np.argsort(score))
    return (r[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize("name,label,least", [("op4_toxicity", "toxic", 0.9), ("op6_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = queries.queries()[name](spark, sf).toPandas()
    y = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    m = got.merge(y, on="doc_id")
    m = m[m.held_out]
    assert len(got) == 1000 and got.score.between(0, 1).all() and list(got.held_out) == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]
    assert auc(m.score.to_numpy(), m[label].to_numpy()) > least


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_classifier_odd_rows(spark, docs, empty, module):
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (5, 1, 1), (5, 0, 0), (None, 1, 1), (6, None, None), (99, 0, 0)], "doc_id long, quality int, toxic int")
    got = module.classify(docs, labels)
    assert got.columns[: len(docs.columns)] == docs.columns and "score_" in got.columns
    assert got.count() == 10 and got.filter("score_ is null or score_ < 0 or score_ > 1").isEmpty()
    assert module.classify(empty, labels).isEmpty()
    blind = {r.text: r.score_ for r in module.classify(docs, labels.limit(0)).collect()}
    assert blind[""] == blind["x"] == blind["y" * 3000]


def test_offending_sentences():
    y = np.array([0] * 12 + [1] * 12)
    texts = [f"nice words {i}. calm day here. more text {i * 7}!" for i in range(12)] + [f"nice words {i}. you utter blorb face. more text {i * 5}!" for i in range(12)]
    j = toxicity.Judge(*toxicity.train(texts, y))
    hit = j.offending(texts[-1])
    assert [texts[-1][h["start"] : h["end"]].strip() for h in hit] == ["you utter blorb face."] and j.score(texts[-1]) > 0.7 > 0.3 > j.score(texts[0])


# 5
def test_shards(spark, docs, empty):
    got = sharding.op5_sharding(spark, SF).toPandas()
    src = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    assert len(got) == len(src) and got.shard.between(0, 23).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    n = got.groupby("shard").size()
    assert n.max() - n.min() <= 1
    assert all(r.text_crc32 == zlib.crc32((src.text[r.doc_id] or "").encode()) and r.size == len((src.text[r.doc_id] or "").encode()) + 8 for r in got.itertuples())
    # brute force: rank in source by md5, order by fractional rank
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    k = {i: md5(f"{i}#{sharding.SEED}#{md5(src.text[i] or '')}") for i in src.index}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    oracle = con.execute(sharding.OP5_SQL).df()
    cols = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sorted(map(tuple, got[cols].values)) == sorted(map(tuple, oracle[cols].values))
    part, names = {}, sorted(src.source.unique())
    for no, s in enumerate(names):
        ids = sorted(src.index[src.source == s], key=k.get)
        part |= {i: ((r + 1 - 0.5) / len(ids), no) for r, i in enumerate(ids)}
    want = {i: p * 24 // len(part) for p, i in enumerate(sorted(part, key=part.get))}
    assert dict(zip(got.doc_id, got.shard, strict=True)) == want
    odd = sharding.shard(docs, 3)
    assert odd.columns[-2:] == ["shard_", "slot"] and sorted(Counter(r.shard_ for r in odd.collect()).values()) == [3, 3, 4]
    assert sharding.shard(empty).isEmpty()


def test_one_id_on_many_rows_is_spread(spark):
    """A third of the rows without an id and a third with one: no bucket of running totals holds more than a few times its share."""
    from curatrix.llm import ranks
    from pyspark.sql import functions as F

    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("s").alias("source"), F.col("id").cast("string").alias("text"))
    key = ranks.position(ranks.seeded_key(F.col("doc_id"), 1, F.xxhash64("doc_id", "text")))
    sizes = [r["count"] for r in df.groupBy(F.floor(key * 16 / F.lit(2**32)).alias("b")).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 6000 / 16
    n = Counter(r.shard for r in sharding.shard(df, 7).collect())
    assert max(n.values()) - min(n.values()) <= 1 and sum(n.values()) == 6000
    assert mixing.mix(df).agg(F.sum("mix_copies")).first()[0] == 9000


# 7
def library(tok, texts):
    """(n_tokens, ids_sha256, decoded_sha256) of each text by the library."""
    t, sha = encoding.load(tok("word_bpe_49k.json")), lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    return [(len(i), sha(" ".join(map(str, i))), sha(t.decode(i, skip_special_tokens=False))) for i in ids]


def test_bpe_query(spark, tok):
    got = bpe.op7_bpe(spark, SF).toPandas().sort_values("doc_id")
    src = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id")
    assert list(got.doc_id) == list(src.doc_id)
    assert list(zip(got.n_tokens, got.ids_sha256, got.decoded_sha256, strict=True)) == library(tok, src.text)


def test_bpe_joins_on_documents(spark, tok):
    """Texts above a leaf come out of joins, at many places, and equal the library's."""
    c = bpe.Coder(tok("word_bpe_49k.json"), leaf=256)
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t in texts:
        assert [i for unit in c.encode(t).ids for i in unit] == c.whole(t)
    assert c.joins > sum(len(t) > 256 for t in texts) > 100
    unsplit = "".join(random.Random(4).choice("abcdeé中yz'.,!") for _ in range(20_000))
    before = c.joins
    assert [i for unit in c.encode(unsplit).ids for i in unit] == c.whole(unsplit) and c.joins - before > 70


@pytest.mark.parametrize("spread", [1 << 16, 40])
def test_bpe_odd_rows(spark, docs, empty, tok, spread):
    path = tok("word_bpe_49k.json")
    t = encoding.load(path)
    got = bpe.encode_decode(docs, path, spread=spread)
    assert "n_tokens_" in got.columns and got.columns[: len(docs.columns)] == docs.columns
    rows = got.collect()
    assert sorted(map(str, got.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    for r in rows:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens_, r.ids, r.decoded) == (len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))
    assert bpe.encode_decode(empty, path, spread=spread).isEmpty()


# 8
def features(text):
    w = WORD.findall(text or "")
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {i + k for i in range(len(w) - 2) for k in range(3) if tri[tuple(w[i : i + 3])] > 1}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def test_rules_query(spark):
    got = rules.op8_rules(spark, SF).toPandas()
    src = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id").text
    for r in got.itertuples():
        f = features(src[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == f
        assert r.base_failed == (f[0] < 50 or 100 * f[4] > 50 * f[0]) and not (r.base_failed and r.kept)
    y = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(got, on="doc_id")
    y = y[~y.base_failed]
    assert (y.kept == (y.quality == 1)).mean() > 0.97


@pytest.mark.parametrize("share,rounds", [(0.1, 200), (0.2, 200), (0.5, 200), (0.85, 25), (0.9, 200)])
def test_em_against_numpy(spark, share, rounds):
    """The posterior of a plain numpy EM over the same votes, whatever share of the documents is good; and that share is found."""
    rng = np.random.default_rng(3)
    good = rng.random(4000) < share
    names = ["a", "b", "c"]
    acc = [0.95, 0.9, 0.85]
    votes = np.stack([np.where(rng.random(4000) < 0.15, 0, np.where((rng.random(4000) < p) == good, 1, -1)) for p in acc], 1)
    counts = Counter(map(tuple, votes.tolist()))
    df = spark.createDataFrame([(*map(int, k), float(n)) for k, n in counts.items()], "v_a int, v_b int, v_c int, n double").coalesce(1).cache()
    t = rules.estimate(df, names, rounds=rounds)
    prior, g, b = 0.5, np.full(3, 0.9), np.full(3, 0.6)
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + np.where(votes == 1, np.log(g / (1 - b)), np.where(votes == -1, np.log((1 - g) / b), 0)).sum(1)
        p = 1 / (1 + np.exp(-odds))
        prior = (p.sum() + 1) / (4000 + 2)
        g = np.clip([((votes[:, j] == 1) @ p + 1) / ((votes[:, j] != 0) @ p + 2) for j in range(3)], 0.5, 0.999)
        b = np.clip([((votes[:, j] == -1) @ (1 - p) + 1) / ((votes[:, j] != 0) @ (1 - p) + 2) for j in range(3)], 0.2, 0.999)
    assert t.prior == pytest.approx(prior, abs=2e-3) and list(t.good.values()) == pytest.approx(list(g), abs=2e-3) and list(t.bad.values()) == pytest.approx(list(b), abs=2e-3)
    assert abs(t.prior - good.mean()) < 0.04
    assert ((p >= 0.5) != good).mean() < 0.06


def test_rules_odd_rows(spark, docs, empty):
    got = {(r.doc_id, r.n_tokens): r for r in rules.measured(docs, "text").collect()}
    assert len(got) == 10
    for r in got.values():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == features(r.text)
    assert rules.keep_good(docs).columns == docs.columns and rules.keep_good(empty).isEmpty()
    clash = docs.selectExpr("doc_id", "text", "1 as n_words", "2 as _lines", "true as kept")
    assert rules.keep_good(clash).columns == clash.columns
    got = rules.measured(clash.select("doc_id", "text", "_lines"), "text")
    assert got.columns == ["doc_id", "text", "_lines", *rules.FEATURES] and {r._lines for r in got.collect()} == {2}
    with pytest.raises(ValueError):
        rules.measured(clash, "text")


# 9
def test_vectors_of_one_id_and_of_extreme_size(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (7, [1e200, -0.0]), (8, [1e200, 1e199]), (9, [1e-200, -1e-200]), (6, [2e-200, -2e-200]), (9, [-1e300, 1e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as component_id", "2 as n_links", "3 as cls")
    got = sorted(map(tuple, vectors.near_duplicates(df).collect()))
    unit = np.array([np.array(v) / np.abs(v).max() for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    hit = unit @ unit.T >= 0.95
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if hit[i, j]]
    root = union_find(len(rows), pairs)
    low = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in root}
    assert got == sorted((k, int(hit[i].sum()) - 1, low[root[i]], k == low[root[i]]) for i, (k, _) in enumerate(rows))


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 8))
    x = [list(map(float, np.float32(b + rng.normal(size=8) * 0.12))) for b in base for _ in range(12)]
    rows = list(enumerate([*x, x[0], x[0], [0.0] * 8, None, [float("nan")] * 8, [1.0, None] * 4, [float("inf")] * 8, [1.0, 2.0], [2.0, 4.0], []])) + [(None, x[3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    ok = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(ok)
    cos = lambda a, b: len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95
    pairs = [(i, j) for i in ids for j in ids if i < j and cos(ok[i], ok[j])]
    links = Counter(v for p in pairs for v in p)
    at = {v: k for k, v in enumerate(ids)}
    root = union_find(len(ids), [(at[a], at[b]) for a, b in pairs])
    low = {}
    for v in ids:
        low.setdefault(root[at[v]], v)
    assert len(got) == len(rows)
    for i, _ in rows[:-1]:
        assert (got[i].n_links, got[i].component_id) == ((links[i], low[root[at[i]]]) if i in ok else (0, i)), i
        assert got[i].kept == (got[i].component_id == i)
    assert got[None].n_links == 0 and vectors.near_duplicates(df.limit(0)).isEmpty()


def test_vectors_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_PIVOT", 40)
    got = vectors.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), 0.5).toPandas().sort_values("vec_id")
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.stack(v.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert list(got.n_links) == list((x @ x.T >= 0.5).sum(1) - 1)


def test_vectors_query(spark, tmp_path):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(12, 6))
    rows = [(100 - k, list(map(float, base[k % 12] + rng.normal(size=6) * 0.1))) for k in range(60)]
    rows += [(200, rows[0][1]), (7, rows[5][1]), (201, [0.0] * 6), (202, None), (203, [float("nan")] * 6), (204, [1.0, None] * 3), (205, [1.0, 2.0]), (206, [2.0, 4.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    for sf, file in ((str(tmp_path), f"{tmp_path}/embeddings.parquet/*.parquet"), (SF, f"{SF}/embeddings.parquet")):
        con.execute(f"create or replace view embeddings as select * from '{file}'")
        got, want = vectors.op9_vectors(spark, sf).toPandas(), con.execute(vectors.OP9_SQL).df()
        key = lambda df: sorted(tuple(r) for r in df[["vec_id", "n_links", "component_id", "kept"]].astype(int).values.tolist())
        assert list(got.columns) == list(want.columns) and key(got) == key(want)
        assert sf == SF or got.n_links.sum() > 60


# 10
def test_url_query(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    got, want = urls.op10_urls(spark, SF).toPandas(), con.execute(urls.OP10_SQL).df()
    cols = ["page_id", "host", "path", "rule", "verdict", "spread"]
    key = lambda df: sorted(tuple(map(str, r)) for r in df[cols].fillna("-").astype(object).values)
    assert key(got) == key(want)


def test_url_equivalence(spark):
    canon = lambda u: f'<html><head><link href="{u}" rel="canonical"></head></html>'
    rows = [
        (1, "http://A.example.ORG/de/1?x=1#top", canon("https://b.example.net/de/9")),  # alias of a blocked URL outside the table
        (2, "https://c.example.org/de/2", '<META HTTP-EQUIV="refresh" content="0; url=//a.example.org/de/1?x=1">'),
        (3, "https://www.example.net/en/3", canon("https://c.example.org/de/2")),  # explicit allow stays
        (4, "https://d.example.org/fr/4", canon("/de/5")),  # allowed by its rule; its canonical is an alias only
        (5, "https://d.example.org/de/5", None),
        (6, "https://x.net/q", ""), (7, None, canon("https://b.example.net/z")), (8, "no scheme", "x"), (9, "https://e.example.com/de/1", canon("f")), (10, "https://e.example.com/fr/f", "x"), (10, "https://e.example.com/fr/f", "x"), (11, "https://e.example.com/de/f", None), (12, "ftp://NET", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df).collect()}
    assert got[1] == ("a.example.org", "/de/1", None, "block") and got[2][2:] == (None, "block")
    assert got[3][2:] == ("example.net/en/", "allow") and got[4][2:] == ("org/fr/", "allow") and got[5][2:] == (None, "allow")
    assert got[6][2:] == ("net/", "block") and got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[9][3] == "block" and got[10][3] == "allow" and got[11][3] == "block" and got[12] == ("net", "", None, "allow")
    more = spark.createDataFrame([("https://d.example.org/de/5", "https://x.net/q")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in urls.filter_urls(df, more).collect()}[5] == "block"
    assert urls.filter_urls(df.limit(0)).isEmpty()
    assert len(urls.filter_urls(df).collect()) == len(rows)
