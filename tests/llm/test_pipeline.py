"""The pipeline's stages on their own input: rows of tables, and odd rows. What a stage decides is computed anew here, without the operators:
the posterior from votes on plainly counted features, the classifier's scores word by word, groups of near-duplicates from sets of
shingles (test_near_duplicates.py holds them against all pairs), the mix from its SQL, tokens from the library."""

import hashlib
import re

import duckdb
import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from curatrix.llm import encoding, features, mixing, quality_model, rules, toxicity  # noqa: E402
from curatrix.llm.common import labelled_sample, table  # noqa: E402
from test_near_duplicates import alike, shingles  # noqa: E402

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF, "documents").collect()


def quality_numbers(spark):
    """The trained model of the stage: it is fitted on labels alone, whatever the stage's input."""
    sample = labelled_sample(table(spark, SF, "documents"), table(spark, SF, "labels"), "quality", quality_model.PER_CLASS).toPandas().sort_values("doc_id")
    return quality_model.train(list(sample["text"]), sample["y"].to_numpy(np.int64))


def plain_quality(model, text):
    """Average over words, their n-grams and repeats, without a memo or sums in one number."""
    numbers, again, bias = model
    numbers = numbers.astype(np.float32)
    words, values = text.split(), []
    for i, w in enumerate(words):
        values += [float(numbers[f]) for f in features.word_features(w, quality_model.GRAMS, quality_model.BUCKETS)]
        if i and w == words[i - 1]:
            values.append(again)
    z = (sum(values) / len(values) if values else 0.0) + bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_quality_rules(spark, documents):
    docs = table(spark, SF, "documents")
    got = {r.doc_id for r in STAGES["quality_rules"](spark, docs, SF).collect()}
    for r in documents:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        if len(words) < 50:
            assert r.doc_id not in got
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    long = [r.doc_id for r in documents if len((r.text or "").split()) >= 50 and r.doc_id in y]
    assert np.mean([(i in got) == (y[i] == 1) for i in long]) > 0.95


def test_quality_classifier(spark, documents):
    docs, model = table(spark, SF, "documents"), quality_numbers(spark)
    got = {r.doc_id for r in STAGES["quality_classifier"](spark, docs, SF).collect()}
    scores = {r.doc_id: plain_quality(model, r.text or "") for r in documents}
    sure = {i for i, s in scores.items() if abs(s - 0.5) > 1e-4}
    assert got & sure == {i for i in sure if scores[i] >= 0.5} and 0 < len(got) < len(documents)


def test_scores_of_queries(spark, documents):
    """op6 and op4, the registered queries, against plain scoring of the same models."""
    model = quality_numbers(spark)
    for r in quality_model.op6_quality(spark, SF).collect():
        text = next(d.text for d in documents if d.doc_id == r.doc_id)
        assert r.score == pytest.approx(plain_quality(model, text or ""), abs=1e-5)
    sample = labelled_sample(table(spark, SF, "documents"), table(spark, SF, "labels"), "toxic", toxicity.PER_CLASS).toPandas().sort_values("doc_id")
    weights, bias = toxicity.train(list(sample["text"]), sample["y"].to_numpy(np.int64))
    weights = weights.astype(np.float32)
    for r in toxicity.op4_toxicity(spark, SF).collect():
        text = next(d.text for d in documents if d.doc_id == r.doc_id) or ""
        clean, found = 1.0, False
        for sentence in re.split(r"[.!?\n]+", text.lower()):
            if words := set(re.findall(r"\w+", sentence)):
                z = bias + sum(float(weights[f]) for w in words for f in features.word_features(w, toxicity.GRAMS, toxicity.BUCKETS))
                clean, found = clean * (1 - 1 / (1 + np.exp(-np.clip(z, -30, 30)))), True
        assert r.score == pytest.approx(1 - clean if found else 1 / (1 + np.exp(-bias)), abs=1e-4)


def test_near_duplicates(spark, documents):
    got = {r.doc_id for r in STAGES["near_duplicates"](spark, table(spark, SF, "documents"), SF).collect()}
    sets = {r.doc_id: shingles(r.text) for r in documents}
    for i, s in sets.items():
        lower = [o for o in sets if o < i and alike(s, sets[o]) >= 0.8]
        if lower:
            assert i not in got
        elif not any(alike(s, sets[o]) >= 0.8 for o in sets if o != i) and s:
            assert i in got


def test_mixture(spark, documents):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = {r[0]: r[4] for r in con.execute(mixing.OP1_SQL).fetchall()}
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in documents}
    rows = STAGES["mixture"](spark, table(spark, SF, "documents"), SF).collect()
    # the stage shuffles by a hash of the whole row, the query by one of the text: sums agree by source, not by document
    took, meant = {}, {}
    for r in rows:
        took[r.source] = took.get(r.source, 0) + words[r.doc_id]
    for r in documents:
        meant[r.source] = meant.get(r.source, 0) + want[r.doc_id]
    longest = max(words.values())
    assert all(abs(took.get(s, 0) - n) <= 2 * longest for s, n in meant.items())
    assert abs(sum(took.values()) - 1.5 * sum(words.values())) <= longest
    assert all(r.text == next(d.text for d in documents if d.doc_id == r.doc_id) for r in rows[:50])


def test_tokens(spark, documents, tok):
    t, sha = encoding.load(tok("word_bpe_49k.json")), lambda s: hashlib.sha256(s.encode()).hexdigest()
    text = {r.doc_id: r.text or "" for r in documents}
    rows = STAGES["tokens"](spark, table(spark, SF, "documents"), SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        ids = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


@pytest.mark.parametrize("name", STAGES)
def test_odd_rows(spark, docs, empty, name):
    """Nulls, empty and long texts, repeated rows, clashing names and empty tables go through every stage."""
    out = STAGES[name](spark, docs, SF)
    rows = out.collect()
    assert len(rows) <= 2 * docs.count() and STAGES[name](spark, empty, SF).isEmpty()
    if name == "tokens":
        assert len(rows) == docs.count()
    else:
        assert out.columns == docs.columns and {str(r) for r in rows} <= {str(r) for r in docs.collect()}
    if name == "near_duplicates":  # the rows of ids 1 and 5 are alike, so are empty and null texts, three differ
        assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "4", "6", "7", "None"]
    if name == "quality_rules":  # only the long text has 50 words
        assert {r.doc_id for r in rows} <= {4}


def test_rules_posterior_is_the_trust_in_votes(spark):
    """A document's posterior by hand from the trust and its votes."""
    t = rules.Trust(0.8, {"a": 0.9, "b": 0.7}, {"a": 0.6, "b": 0.9})
    df = spark.createDataFrame([(1, -1), (0, 1), (-1, -1)], "v_a int, v_b int")
    odds = [0.8 / 0.2 * (0.9 / 0.4) * (0.3 / 0.9), 0.8 / 0.2 * (0.7 / 0.1), 0.8 / 0.2 * (0.1 / 0.6) * (0.3 / 0.9)]
    assert [r.p for r in df.select(t.posterior().alias("p")).collect()] == pytest.approx([o / (1 + o) for o in odds])


def test_run(spark):
    assert not corpus_pipeline.run(spark, SF).isEmpty()
