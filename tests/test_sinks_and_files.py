"""Incremental sinks, version pointers, copies, image headers, responses and their retries against plain Python."""

import json
import struct
import threading
import time

import pytest
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.operators import match as M
from curatrix.operators import parse as P
from curatrix.sources import blobs, files
from curatrix.streaming import incremental as I

# --- pointers


def test_readers_never_miss_a_table(spark, tmp_path):
    at, stop, seen, errors = str(tmp_path / "t"), threading.Event(), [], []
    I.replace_atomically(spark.range(3).withColumn("v", F.lit(0)), at)

    def read():
        while not stop.is_set():
            try:
                rows = I.read_current(spark, at).collect()
                seen.append((len(rows), {r.v for r in rows}))
            except Exception as e:  # noqa: BLE001
                errors.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for v in range(1, 6):
        I.replace_atomically(spark.range(3 + v).withColumn("v", F.lit(v)), at, keep=4)
    time.sleep(1)
    stop.set()
    reader.join()
    assert not errors and len(seen) > 3
    assert all(n == 3 + v and len(vs) == 1 for n, vs in seen for v in vs)
    assert {v for _, vs in seen for v in vs} <= set(range(6)) and seen[-1] == (8, {5})


def test_a_crash_at_any_step_leaves_a_table(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        I.read_current(spark, at)
    I.replace_atomically(spark.range(1), at)
    with pytest.raises(Exception):  # noqa: B017  while rows are written
        I.replace_atomically(spark.range(2).select(F.raise_error(F.lit("lost"))), at)
    assert I.read_current(spark, at).count() == 1
    real = I._fs
    monkeypatch.setattr(I, "_fs", lambda s, p: (_ for _ in ()).throw(OSError("lost")) if "/current/" in p else real(s, p))
    with pytest.raises(OSError):  # written, but not pointed to
        I.replace_atomically(spark.range(3), at)
    monkeypatch.setattr(I, "_fs", real)
    assert I.read_current(spark, at).count() == 1
    I.replace_atomically(spark.range(4), at)
    assert I.read_current(spark, at).count() == 4 and len(I._pointers(spark, at)) == 2


# --- keyed sink

SCHEMA = "id string, class_name_raw string, archetype string, attempt int"


def _process(rows):
    bad = F.col("id").startswith("bad") | ((F.col("attempt") == 0) & (F.length("id") % 2 == 0))
    return rows.withColumn("extraction_status", F.when(bad, "failed").otherwise("success"))


def _run(spark, at, drops, per_drop=True):
    for rows in drops:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{at}/in")
        if per_drop:
            _go(spark, at)
    if not per_drop:
        _go(spark, at)
    sink = I.read_sink(spark, f"{at}/out", _process(spark.createDataFrame([], SCHEMA)).schema)
    return sorted(map(tuple, I.latest(sink, "id").drop("batch").collect())), I.read_current(spark, f"{at}/stats").first()


def _go(spark, at):
    I.run_incremental(spark, f"{at}/in", SCHEMA, f"{at}/out", f"{at}/cp", _process, "id", "extraction_status", I.counted_stats, f"{at}/stats", by=("class_name_raw", "archetype"), order=("attempt",), buckets=8)


def test_runs_of_drops_equal_one_run(spark, tmp_path):
    ids = [f"k{'x' * (i % 3)}{i}" for i in range(30)] + ["bad1", "bad2"]
    row = lambda i, a, c="c": (i, f"{c}{len(i) % 3}", "tool" if a else None, a)
    first, second = [row(i, 0) for i in ids[:20]] + [row("bad1", 0)], [row(i, 1, "d") for i in ids] + [row(i, 0) for i in ids[5:15]] + [(None, "c", "t", 1)]
    rows, stats = _run(spark, str(tmp_path / "a"), [first, second, second])
    won = {i for i in ids[:20] if len(i) % 2}
    want = {i: (i, f"{'c' if i in won else 'd'}{len(i) % 3}", None if i in won else "tool", 0 if i in won else 1, "failed" if i.startswith("bad") else "success") for i in ids}
    assert rows == sorted(want.values())
    assert tuple(stats) == (32, 30, 2, len({r[1] for r in rows}), "tool")
    again, counts = _run(spark, str(tmp_path / "b"), [first + second], per_drop=False)
    # one batch that holds a failed and a later row of a key takes the later one
    assert [(r[0], r[4]) for r in again] == [(r[0], r[4]) for r in rows] and {r[3] for r in again if r[0] in ids} == {1}
    assert tuple(counts)[:3] == (32, 30, 2)


def test_a_batch_opens_only_its_buckets(spark, tmp_path, monkeypatch):
    at, opened = str(tmp_path), []
    _run(spark, at, [[(f"k{i}", "c", "t", 1) for i in range(60)]])
    real = I.KeyIndex.known

    def known(self, rows, before):
        out = real(self, rows, before)
        opened.extend(out.inputFiles())
        return out

    monkeypatch.setattr(I.KeyIndex, "known", known)
    _, stats = _run(spark, at, [[("k7", "c", "t", 2), ("new", "c", "t", 2)]])
    assert 0 < len({p.split("bucket=")[1].split("/")[0] for p in opened}) <= 2
    assert tuple(stats)[:3] == (61, 61, 0)


def test_a_batch_that_runs_twice_counts_once(spark, tmp_path):
    at, rows = str(tmp_path), [(f"k{i}", "c", "t", 1) for i in range(9)]
    first = _run(spark, at, [rows])
    import shutil

    shutil.rmtree(tmp_path / "cp")  # the batch's number comes again, with its rows
    assert _run(spark, at, [[]]) == first


# --- files


def test_training_set_is_copied(spark, tmp_path):
    (tmp_path / "source.png").write_bytes(b"\x89PNG" + bytes(range(256)) * 9000)
    (tmp_path / "plain").write_bytes(b"x")
    kinds = "pair_id string, record_id string, sample_id string, relative_image_path string, image_path string, class_name_raw string, class_name string, archetype string, canonical_caption string"
    one = ("p0", "r0", "s0", "class_a/source.png", str(tmp_path / "source.png"), "class_a", "class a", "object", "a canonical red square")
    summary = files.materialize_training_set(spark.createDataFrame([one], kinds), str(tmp_path / "out")).first()
    rows = (tmp_path / "out/metadata.jsonl").read_text(encoding="utf-8").strip().splitlines()
    assert summary["num_examples"] == len(rows) == 1 and summary["truncated_copied_file_samples"] is False
    row = json.loads(rows[0])
    assert list(row) == ["file_name", "text", "pair_id", "record_id", "sample_id", "relative_image_path", "class_name", "class_name_raw", "archetype"]
    assert row["file_name"] == "images/000000_class_a__source.png" and row["text"] == "a canonical red square"
    assert (tmp_path / "out" / row["file_name"]).read_bytes() == (tmp_path / "source.png").read_bytes()
    assert json.loads((tmp_path / "out/dataset_summary.json").read_text())["copied_file_samples"] == [str(tmp_path / "out/images/000000_class_a__source.png")]
    many = [(f"p{i}", f"r{i:02d}", None, None, "file:" + str(tmp_path / ("plain" if i % 2 else "source.png")), "c", None, None, None) for i in range(25)]
    summary = files.materialize_training_set(spark.createDataFrame(many, kinds).repartition(4), str(tmp_path / "many")).first()
    names = [json.loads(x)["file_name"] for x in (tmp_path / "many/metadata.jsonl").read_text().splitlines()]
    assert names == [f"images/{i:06d}_{'plain.png' if i % 2 else 'source.png'}" for i in range(25)]
    assert len(summary["copied_file_samples"]) == 20 and summary["truncated_copied_file_samples"] is True
    assert sorted(p.name for p in (tmp_path / "many/images").iterdir()) == [n.removeprefix("images/") for n in names]
    lost = one[:4] + (str(tmp_path / "gone.png"),) + one[5:]
    with pytest.raises(FileNotFoundError, match="gone.png"):
        files.materialize_training_set(spark.createDataFrame([one, lost], kinds), str(tmp_path / "bad"))
    assert not (tmp_path / "bad/metadata.jsonl").exists()


def _images():
    chunk = lambda kind, body: b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBP" + kind + struct.pack("<I", len(body)) + body + bytes(8)
    yield "a.png", (640, 70000), b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 70000) + b"\x08\x02\0\0\0"
    yield "b.bmp", (31, 17), b"BM" + bytes(12) + struct.pack("<Iii", 40, 31, -17) + bytes(20)
    yield "c.bmp", (300, 200), b"BM" + bytes(12) + struct.pack("<IHH", 12, 300, 200) + bytes(20)
    yield "d.webp", (1001, 2), chunk(b"VP8L", b"\x2f" + struct.pack("<I", 1000 | 1 << 14))
    yield "e.webp", (70000, 9), chunk(b"VP8X", bytes(4) + struct.pack("<I", 69999)[:3] + struct.pack("<I", 8)[:3])
    yield "f.webp", (44, 55), chunk(b"VP8 ", bytes(3) + b"\x9d\x01\x2a" + struct.pack("<HH", 44 | 1 << 14, 55))
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 60002) + b"\xff\xc0" * 30000 + b"\xff\xff\xc4\x00\x05abc" + b"\xff\xc1" + struct.pack(">HBHH", 17, 8, 480, 641) + bytes(10)
    yield "g.jpg", (641, 480), jpeg
    for name, bad in (("h.jpg", jpeg[:50]), ("i.png", b"\x89PNG\r\n\x1a\n"), ("j.png", b"x"), ("k.jpg", b"\xff\xd8\xff\xda\x00\x02"), ("l.gif", b"GIF89a" + bytes(30))):
        yield name, (None, None), bad


def test_sizes_from_headers(spark, tmp_path):
    want = {}
    for name, size, content in _images():
        (tmp_path / name).write_bytes(content)
        want[name] = size
    got = {r.path.rsplit("/", 1)[1]: r for r in files.image_size(spark, str(tmp_path)).collect()}
    assert {k: (r.width, r.height) for k, r in got.items()} == want
    assert all((r.error is None) == (r.width is not None) for r in got.values())
    gone = blobs.image_sizes(spark.createDataFrame([(str(tmp_path / "none"),), (None,)], "path string")).collect()
    assert all(r.width is None and "FileNotFoundError" in r.error for r in gone)


def test_index_finds_files(spark):
    rows = [(1, "c::c/a.png", None, "success"), (2, "c::c/b.png", "x/b.png", "success"), (3, "c::c/d.png", "", "success"), (4, "c::c/e.png", "y", "success"), (5, "c::c/e.png", "y", "failed"), (6, "nothing", "z", "success"), (7, "b::b/z::q.png", "n", "success")]
    df = spark.createDataFrame(rows, "line_no long, record_id string, sample_id string, render_status string")
    got = M.pair_index(df, inventory=spark.createDataFrame([("c/a.png",), ("c/a.png",), ("b/z::q.png",)], "sample_id string"), root="/r/").orderBy("idx").collect()
    assert [(r.idx, r.record_id, r.image_path) for r in got] == [(0, "b::b/z::q.png", "/r/b/z::q.png"), (1, "c::c/a.png", "/r/c/a.png"), (2, "c::c/b.png", "/r/x/b.png"), (3, "c::c/d.png", "/r/c/d.png")]
    assert {(r.class_name, r.class_name_raw, r.class_id, r.archetype, r.canonical_caption) for r in got} == {("c", "c", 0, "", ""), ("b", "b", 0, "", "")}
    assert M.pair_index(df.limit(0)).count() == 0


# --- responses

TEXTS = [
    None, "", "{}", '{"a": 1} xyz', "[1, {\"a\": 2}]", "[1]", "5", "x {\"a\": \"}\"} y", "x {'a': 1} y {\"b\": 2}", "{{}", '"archetype": "t" "attributes": { - a: b', '{"archetype": "t", "attributes": {\n - a: "b c",\n- d: e }', '"archetype": "t"\n"attributes": {\n- a: 1\nodd\n}{',
    '"archetype": "t"\n"attributes": {\n - a: 1\r\n - a: 2,,\n\n - b : x }', '"archetype": "" "attributes": {- a: b}', "```json\n{\"a\": 1}\n```", "``` [2] ```", '{"a": "\\u00e9 ß"}', '{"archetype": "t", "attributes": {\n - a: b\n}',
]


def test_one_pass_gives_what_the_ladder_gives(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, raw string")
    made = P.parse_response(df, "raw")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Scan") == 1
    steps = df.withColumn("t", T.strip_fences(F.col("raw"))).withColumn("p", P.parse_strict("t")).withColumn("s", P.salvage_object("t")).withColumn("b", P.parse_bullets(F.col("t")))
    want = {}
    for r in steps.collect():
        if not r.p.broken:
            want[r.i] = ("failed" if r.p.error else "strict", r.p.payload, r.p.error)
        elif r.s.found is not None:
            want[r.i] = ("failed" if r.s.error else "salvage", r.s.payload, r.s.error)
        else:
            whole = None if r.b.error else {"archetype": r.b.archetype, "attributes": dict(r.b.attributes)}
            want[r.i] = ("failed" if r.b.error else "bullets", whole, r.b.error)
    got = {r.i: (r.parse_method, json.loads(r.payload) if r.parse_method == "bullets" else r.payload, r.parse_error) for r in made.collect()}
    assert got == want and {m for m, _, _ in got.values()} == {"strict", "salvage", "bullets", "failed"}


def test_only_what_failed_goes_round_again(spark):
    starts = spark.sparkContext.accumulator(0)

    def flaky(batches):
        starts.add(1)
        turn = {}
        for b in batches:
            raw, errors = [], []
            for k in b["k"]:
                turn[k] = turn.get(k, 0) + 1
                errors.append("out of order" if k % 5 == 4 else None)
                good = turn[k] > k % 5
                raw.append(None if k % 5 == 4 else json.dumps({"attributes": {"a": "x"}}) if good else ['{"a": 5}', "no json", '{"attributes": {"a": " "}}'][turn[k] % 3])
            yield b.assign(raw_response=raw, error_message=errors)

    P.RESPONDERS.add("flaky", flaky)
    df = spark.range(40).select(F.col("id").alias("k"), F.array(F.lit("a"), F.lit("b")).alias("slot_schema")).coalesce(1)
    got = {r.k: r for r in P.respond(df, "flaky", retries=2).collect()}
    assert len(got) == 40 and starts.value == 1
    for k, r in got.items():
        kind = k % 5
        assert r.attempts == min(kind, 2) + 1
        assert (r.error_message is None) == (kind <= 2)
        if kind == 3:  # three wrong answers: the last one is kept
            assert r.raw_response == '{"a": 5}' and r.error_message == "number in a"
        if kind == 4:
            assert r.raw_response is None and r.error_message == "out of order"
    plain = P.respond(df, "flaky").collect()
    assert sum(r.error_message is None and r.raw_response == '{"attributes": {"a": "x"}}' for r in plain) == 8 and not hasattr(plain[0], "attempts")


def test_running_stats_count_every_sample(spark):
    from curatrix.plans import bindings, incremental

    sf = "/root/testdata/sf0.001"
    assert incremental.QUERIES["running_stats"](spark, sf).first().total == bindings.samples(spark, sf).count()
