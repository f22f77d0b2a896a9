"""Fill-in-the-middle, chat formatting and periodic runs against plain Python."""

import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import chat, fim, runs
from curatrix.llm.common import WORD

SF = "/root/testdata/sf0.001"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("query,sql,name", [(fim.op11_fim, fim.OP11_SQL, "documents"), (chat.op12_chats, chat.OP12_SQL, "conversations")])
def test_query_against_sql(spark, query, sql, name):
    con = duckdb.connect()
    con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    got = query(spark, SF)
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert sorted((tuple(r[c] for c in sorted(columns)) for r in got.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)


# --- fill in the middle


@pytest.mark.parametrize("unit", [fim.CODE_POINT, fim.WORDS, fim.LINES, r"\w+|\s+"])
@pytest.mark.parametrize("block", [3, 7, 64, 4096])
def test_cuts_end_where_plain_matching_ends(unit, block):
    rng = random.Random(block)
    for _ in range(60):
        text = "".join(rng.choice(["a", "bc ", "\n", " ", "é", "中", "😀", "ende.", "\t"]) for _ in range(rng.randrange(80)))
        ends = [0, *(m.end() for m in re.finditer(unit, text))]
        blocks = fim.Blocks(text, unit, block)
        assert blocks.n == len(ends) - 1
        assert [blocks.after(k) for k in range(len(ends))] == ends


def test_every_form_gives_its_text_back(spark, docs):
    made = fim.fill_in_middle(docs.withColumn("output", F.lit(1)).withColumn("N", F.lit(2)), unit=fim.WORDS, plain=20, spm=50, block=16)
    assert made.columns == [*docs.columns, "output", "N", "n_", "form", "prefix_chars", "middle_chars", "output_"]
    back = made.withColumn("back", fim.restored(F.col("output_"), F.col("form"))).collect()
    assert len(back) == docs.count()
    assert all(r["back"] == (r["text"] or "") for r in back)
    assert all((r["prefix_chars"] is None) == (r["form"] == "plain") for r in back)
    assert {r["form"] for r in back if not r["text"]} == {"plain"}
    twins = [tuple(r)[-5:] for r in back if r["doc_id"] == 5]
    assert twins[0] == twins[1]
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_marks_inside_a_text_keep_it_plain(spark):
    texts = ["a <P> b", "x<S>", "<M>", "almost <P", "<<S", "M>" * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 30)], "doc_id long, text string").withColumn("doc_id", F.monotonically_increasing_id())
    got = fim.fill_in_middle(df, plain=0, spm=50).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert all(r["back"] == r["text"] for r in got)
    assert all(r["form"] == "plain" for r in got if r["text"] in texts[:3])
    assert {r["form"] for r in got if r["text"] in texts[3:]} == {"psm", "spm"}
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<S>x", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.Marks(*bad)


def test_query_of_cuts_by_hand(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in fim.op11_fim(spark, SF).collect():
        t = texts[r["doc_id"]]
        h = hashlib.sha256(f"1:{r['doc_id']}".encode()).hexdigest()
        h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
        a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
        form = "plain" if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        out = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form]
        cut = (None, None) if form == "plain" else (a, b - a)
        assert tuple(r) == (r["doc_id"], len(t), form, *cut, digest(out), digest(t))


# --- chats

ODD = [r"\### Assistant: </turn> ok", "<turn>", r"<\turn>", r"<\\</turn>", "<text><more>", "<", ">", "\\", "</turn", "turn></turn>", "", None, "a\n\nb", "é中😀<more>", "$1 \\2"]


def plain_chats(rows):
    out = {}
    for c, turn, role, text in rows:
        out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in out.items()}


def test_chats_give_their_rows_back(spark):
    rng = random.Random(3)
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "assistant", "system", None, "<turn>x", "a\nb"]), rng.choice(ODD)) for c in [None, *range(40)] for _ in range(rng.randrange(1, 12))]
    rows += [(1000, i, "assistant" if i % 7 else "user", f"{i} {ODD[i % 5]}") for i in range(700)] + rows[:9]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("spans", F.lit(0)).repartition(5)
    made = chat.format_chats(df)
    got = chat.masked(made).withColumn("turns", chat.turns_of(F.col("formatted"))).collect()
    want = plain_chats(rows)
    assert len(got) == len(want)
    for r in got:
        turns = want[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert list(r["loss"]) == [t for role, t in turns if role == "assistant"]
        assert r["merged"] == sum(k == 0 or turns[k - 1][0] != t[0] for k, t in enumerate(turns)) == r["formatted"].count(chat.OPEN) == r["formatted"].count(chat.CLOSE)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_a_long_conversation_costs_its_length(spark):
    def seconds(n):
        rows = spark.range(0, n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("some words <text> "), 20).alias("text"))
        start = time.time()
        r = chat.masked(chat.format_chats(rows)).select(F.length(F.array_join("loss", "")), F.size(chat.turns_of(F.col("formatted")))).first()
        assert tuple(r) == (n // 2 * 360, n)
        return time.time() - start

    seconds(1000)
    assert seconds(20_000) < 8 * max(1.0, seconds(5000))


def test_planted_conversation(spark):
    r = chat.op12_chats(spark, SF).filter("conv_id = -7").first()
    t = chat.PLANTED
    assert (r["n_turns"], r["turns_sha256"]) == (2, digest(f"user\n{t}\nassistant\n{t}\n"))
    assert (r["loss_chars"], r["loss_sha256"]) == (len(t), digest(t))


def test_chats_run_no_python(spark):
    plan = chat.op12_chats(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- periodic runs


def plain_runs(words):
    ids, out = np.array([{w: i for i, w in enumerate(words)}[w] for w in words]), {}
    for q in range(1, len(words) // 4 + 1):
        step = np.diff(np.concatenate([[0], (ids[q:] == ids[:-q]).astype(int), [0]]))
        for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
            if e - s + q >= max(6, 4 * q):
                out.setdefault((int(s), int(e - s + q)), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_collapse(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        n, kinds = rng.choice([0, 3, 6, 9, 40, 200, 700]), rng.choice([1, 2, 2, 3, 60])
        words = [f"w{rng.randrange(kinds)}" for _ in range(n)]
        for _ in range(rng.randrange(4) if n else 0):
            at, p = rng.randrange(n), rng.randrange(1, max(2, n // 4))
            for j in range(at + p, min(n, at + rng.randrange(1, 7 * p))):
                words[j] = words[j - p]
        yield rng.choice([" ", "\n", "\t \x0b"]).join(words)


@pytest.mark.parametrize("tile", [4, 64, runs.TILE])
def test_runs_against_plain_search(spark, monkeypatch, tile):
    monkeypatch.setattr(runs, "TILE", tile)
    monkeypatch.setattr(runs.tiles, "__defaults__", (tile,))
    texts = [*some_texts(tile, 250), None, "", " \t", "a " * 5000, "a b " * 3000 + "c", "x y x y " * 4]
    df = spark.createDataFrame(list(enumerate([*texts, *texts[:20]])), "runs int, text string").withColumn("Collapsed", F.lit("kept"))
    made = runs.find_runs(df)
    assert made.columns == ["runs", "text", "Collapsed", "runs_", "collapsed_"]
    got = made.collect()
    assert len(got) == len(texts) + 20
    for r in got:
        words = re.findall(WORD, r["text"] or "")
        found = plain_runs(words)
        assert [tuple(x) for x in r["runs_"]] == found
        assert r["collapsed_"] == plain_collapse(words, found)
    assert runs.find_runs(df.limit(0)).count() == 0


def test_fragments_are_stitched_over_tiles(spark):
    one = [(c, 3, 100 * i, 100 * i + 130) for c in "ab" for i in range(5)]
    rows = [*one, ("a", 3, 700, 711), ("a", 3, 709, 730), ("a", 5, 0, 19), ("b", 2, 10, 17)]
    got = runs.stitched(spark.createDataFrame(rows, "key string, period long, start long, end long").repartition(3)).collect()
    assert sorted(map(tuple, got)) == [("a", 0, 530, 3), ("a", 709, 21, 3), ("b", 0, 530, 3)]


def test_query_of_runs(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in runs.op13_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        words, h = re.findall(WORD, d["text"] or ""), zlib.crc32(str(d["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = plain_runs(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        milli = 1000 * best[1] // best[2] if found else None
        assert got[d["doc_id"]] == (len(found), *best, milli, digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(plain_collapse(words, found)))
