"""The pipeline's near-duplicates against brute force where similarity is neither high nor low."""

import random

import numpy as np
import pytest
import xxhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from curatrix.llm import rangejoin, simhash  # noqa: E402

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) / max(1, len(a | b))


def lowest(rows):
    """The ids brute force keeps: the lowest of each component of pairs with similarity 0.8 or more."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]) >= 0.8 and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    low = {}
    for (doc, _), r in zip(rows, root, strict=True):
        low[r] = min(low.get(r, doc), doc)
    return set(low.values())


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def kept(spark, rows):
    return {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}


def test_middle_band(spark):
    rng, rows, seen = random.Random(5), [], []
    for _ in range(160):  # a text and its copy with another end: similarity 0.5 to 0.95
        n, share = rng.choice([9, 30, 120, 400]), rng.uniform(0.67, 0.98)
        w = words(rng, n)
        cut = round(share * n)
        a, b = " ".join(w), " ".join(w[:cut] + words(rng, n - cut))
        seen.append(alike(shingles(a), shingles(b)))
        rows += [(len(rows), a), (len(rows) + 1, b)]
    chain = words(rng, 300)
    for k in range(12):  # each like the next, the ends not alike
        rows.append((len(rows), " ".join(chain[10 * k : 10 * k + 150])))
    assert sum(0.6 < s < 0.8 for s in seen) > 30 and sum(0.8 <= s < 0.9 for s in seen) > 20
    assert kept(spark, rows) == lowest(rows)


def test_repeats_count_once(spark):
    rng = random.Random(6)
    w, line = words(rng, 300), words(rng, 25)
    long = words(rng, 300)
    texts = [w, w + w[100:200], line * 8 + words(rng, 300), line * 8 + words(rng, 300), long, long + long[50:150] * 3]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    assert alike(*(shingles(t) for _, t in rows[:2])) > 0.9 > 0.1 > alike(*(shingles(t) for _, t in rows[2:4]))
    assert kept(spark, rows) == lowest(rows) == {0, 2, 3, 4}


def test_null_ids_and_repeated_rows(spark):
    rng = random.Random(7)
    w = words(rng, 60)
    a, b, c = " ".join(w), " ".join(w[:57]), " ".join(w[:40])
    rows = [(None, a), (None, a), (None, b), (3, b), (3, b), (5, c), (None, c), (9, None), (8, "")]
    assert kept(spark, rows) == {3, 5, 8}
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows[:3] * 2, SCHEMA), "").count() == 1


def test_documents(spark):
    """All documents of a table against all pairs that have a shingle in common: recall and precision of the links are 1."""
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect())
    sets = [shingles(t) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bare = [i for i, s in enumerate(sets) if not s]
    pairs = {(a, b) for ids in where.values() for a in ids for b in ids if a < b} | set(zip(bare, bare[1:], strict=False))
    links = [(a, b) for a, b in pairs if alike(sets[a], sets[b]) >= 0.8 or not sets[a] | sets[b]]
    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert len(links) > 20 and kept(spark, rows) == {rows[i][0] for i in range(len(rows)) if find(i) == i}


def test_no_link_is_lost_to_min_hash_bands(spark):
    """Two long texts of similarity 0.88 that differ in a minimum of each of 36 bands of five: an index of such bands never lets them meet."""
    rng = random.Random(8)
    w = words(rng, 3000)
    grams = [xxhash.xxh64_intdigest(" ".join(w[i : i + 5]), 42) for i in range(len(w) - 4)]
    masks, factors = np.random.default_rng(5).integers(0, 2**64, (2, 36 * 5, 1), np.uint64) | np.uint64(1)
    lowest_at = ((np.array(grams, np.uint64) ^ masks) * factors).argmin(1)
    other = list(w)
    for at in lowest_at[::5]:  # a word of the first minimum's shingle
        other[at] = words(rng, 1)[0]
    rows = [(0, " ".join(w)), (1, " ".join(other))]
    assert 0.85 < alike(*(shingles(t) for _, t in rows)) < 0.92
    assert kept(spark, rows) == lowest(rows) == {0}


def test_candidates_come_out_of_the_tree(spark, monkeypatch):
    """Texts of many sizes in leaves of a few points: splits by size and chunks lose no link."""
    rng, rows, trees = random.Random(9), [], []
    for n in range(8, 320, 2):
        w = words(rng, n)
        for cut in rng.sample([0, 0, n // 40, n // 8, n // 5], 2):
            rows.append((len(rows), " ".join(w[: n - cut] + words(rng, rng.choice([0, cut])))))
    grow = simhash.VantageTree.__init__
    monkeypatch.setattr(simhash.VantageTree, "__init__", lambda self, *a: (grow(self, *a), trees.append(self.leaves))[0])
    rule = simhash.Rule(bits=256, radius=76, ratio=0.8, leaf=16, exact=True)
    got = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, SCHEMA), 5, rule).collect()}
    assert got == lowest(rows) and len(rows) / 2 < len(got) < len(rows) and max(trees) > 4


def test_prefixes_of_like_sets_meet():
    """Sets of similarity 0.8 or little more that differ in the very shingles which the order takes first."""
    rng = np.random.default_rng(10)
    for n in (*range(1, 40), 99, 400):
        for _ in range(20):
            h = np.sort(rng.integers(0, 2**63, n + n // 4 + 1).astype(np.uint64))
            order = rng.permutation(h)[: rng.integers(0, len(h) + 1)]
            last = np.sort(order), np.argsort(order)
            ranked = [x for x in h if x not in set(order)] + list(order)
            most = n - int(np.ceil(0.8 * n))  # of n shingles
            a, b = np.sort(ranked[:n]), np.sort(ranked[most:n])
            assert len(a) and len(b) >= 0.8 * len(a) and set(simhash.prefix(a, last, 0.8)) & set(simhash.prefix(b, last, 0.8))
            more = n // 9  # both ways: n - more in common, more of each alone
            a, b = np.sort(ranked[:more] + ranked[2 * more : n + more]), np.sort(ranked[more : n + more])
            assert alike(set(a), set(b)) >= 0.8 and set(simhash.prefix(a, last, 0.8)) & set(simhash.prefix(b, last, 0.8))


def seats(spark, monkeypatch, rows, leaf):
    """What deduplicate keeps, and the seats (homes, visits) that its leaves were joined on."""
    made, chunks = [], rangejoin.chunks
    monkeypatch.setattr(rangejoin, "chunks", lambda *a: made.append(chunks(*a)) or made[-1])
    rule = simhash.Rule(bits=256, radius=76, ratio=0.8, leaf=leaf, exact=True)
    got = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, SCHEMA), 5, rule).collect()}
    monkeypatch.undo()
    visits = made[0].filter("visitor").count()
    return got, made[0].count() - visits, visits


def test_visits_grow_as_the_links(spark, monkeypatch):
    """Texts of one size, which no split of the tree keeps apart, a tenth of them with a near copy, all with one line: a point goes to the chunk of its
    copy, not to all chunks, whose number grows with the points."""
    rng, line = random.Random(11), words(random.Random(12), 12)
    for n in (300, 1200):
        rows = []
        for k in range(n):
            w = words(rng, 60) + line
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[:-1] + words(rng, 1)))][: 2 if k % 10 == 0 else 1]
        got, homes, visits = seats(spark, monkeypatch, rows, 16)
        assert got == lowest(rows) and len(got) == n and homes == len(rows)
        assert visits <= n // 10


def test_near_copies_that_fill_chunks(spark, monkeypatch):
    """A large group of near copies in many chunks, beside texts of one very frequent line: every link is found across chunks."""
    rng, base, line = random.Random(13), words(random.Random(14), 80), words(random.Random(15), 20)
    rows = []
    for k in range(240):
        w = list(base) if k % 2 else words(rng, 12) + line
        w[rng.randrange(len(w))] = words(rng, 1)[0]
        w[rng.randrange(len(w))] = words(rng, 1)[0]
        rows.append((k, " ".join(w)))
    got, homes, visits = seats(spark, monkeypatch, rows, 16)
    assert got == lowest(rows) and homes == 240 and visits > 0


def test_visits_do_not_grow_with_shared_passages(spark, monkeypatch):
    """Texts put together from passages that many have, so that prefixes hold shared shingles but few texts are candidates: a point visits where it
    has one, not every chunk that holds its passage."""
    rng = random.Random(16)
    pool = [words(rng, 20) for _ in range(60)]
    rows = [(k, " ".join(w for p in rng.sample(pool, 4) for w in p)) for k in range(400)]
    got, homes, visits = seats(spark, monkeypatch, rows, 16)
    assert got == lowest(rows) and homes == 400 and visits <= 400
