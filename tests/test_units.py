"""Hand-derived cases: one row a branch of each decision ladder."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.functions import dims
from curatrix.functions import text as T
from curatrix.operators import cluster as K
from curatrix.operators import enrich as E
from curatrix.operators import evaluate as V
from curatrix.operators import match as M
from curatrix.operators import normalize as N
from curatrix.operators import parse as P
from curatrix.operators import render as R
from curatrix.operators import review as W
from curatrix.sources import files as S


def one(spark, fn, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_text(spark):
    assert one(spark, T.clean_value, None, " A_b  C ", "x / y ,z", "STRASSE ß", " q ") == ["unknown", "a b c", "x/y, z", "strasse ss", "q"]
    assert one(spark, T.normalize_relpath, "./a/b", "..\\x\\y", ".hidden/x", None) == ["a/b", "x/y", "hidden/x", None]
    assert one(spark, T.string_or_none, " ", "", None, " a ") == [None, None, None, "a"]
    assert one(spark, T.sanitize_copy_name, "a/b c:d", "", None, "é.jpg") == ["a__b_c_d", "image", "image", "é.jpg"]
    assert one(spark, T.dataset_label, "/d/set/train", "/d/my set/", "train") == ["set_train", "my_set", "train"]
    assert one(spark, T.strip_fences, "```json\n{}\n```", "``` {} ```", "{}") == ["{}", "{}", "{}"]
    assert one(spark, T.cleanup_caption, " a , b . ", "x ,. ") == ["a, b", "x"]
    assert one(spark, T.with_article, "Apple", "red car", "") == ["an Apple", "a red car", ""]
    assert one(spark, E.infer_archetype, "tray", "acorn", "lamp", "Pizza") == ["animal", "plant_or_fungus", "household_object", "food_and_drink"]


def fields(spark, *rows, **kw):
    df = spark.createDataFrame([(str(i), a, s, c, "raw", v, i) for i, (a, s, c, v) in enumerate(rows)], "record_id string, archetype string, slot string, class_name string, class_name_raw string, raw_value string, slot_pos int")
    out = N.normalize_fields(df, **kw).collect()
    return [(r.value, r.status, r.rules, r.reasons) for r in sorted(out, key=lambda r: int(r.record_id))]


def test_normalization_branches(spark):
    got = fields(
        spark,
        ("vehicle", "color", "car", "N/A"), ("vehicle", "color", "car", "Grey"), ("vehicle", "color", "car", "blue/red and blue"), ("tool", "material", "x", "wooden and metallic"),
        ("tool", "material", "x", "wood, unknown"), ("vehicle", "vehicle_type", "Jeep, land rover", "truck"), ("vehicle", "state_or_action", "x", "resting, tilted"), ("vehicle", "state_or_action", "x", "resting, 2 men"),
        ("vehicle", "state_or_action", "x", "Held up high"), ("vehicle", "viewpoint", "x", "rear 45"), ("vehicle", "salient_part_or_accessory", "x", "woman waving"), ("vehicle", "environment", "x", "café"),
        ("food_and_drink", "container_or_context", "x", "plate"), ("vehicle", "environment", "x", "night time"), ("vehicle", "state_or_action", "x", "stationary"),
    )
    assert got[0] == ("unknown", "mapped_to_unknown", ["global.placeholder_to_unknown"], [])
    assert got[1][:3] == ("gray", "canonicalized", ["slot.color.base_color"])
    assert got[2][0] == "blue+red"
    assert got[3][0] == "metal+wood"
    assert got[4] == ("wood, unknown", "unchanged", [], [])
    assert got[5][:3] == ("jeep", "canonicalized", ["slot.anchor_type.from_class_name_first_item"])
    assert got[6][:3] == ("resting", "canonicalized", ["slot.state.primary_clause"])
    assert got[7] == ("resting, 2 men", "review_required", ["review.mixed_state"], ["review.mixed_state"])
    assert got[8][0] == "being held"
    assert got[9][1:] == ("review_required", ["review.misplaced_spec_text"], ["review.misplaced_spec_text"])
    assert got[10][2] == ["slot.person_contamination_to_unknown"]
    assert got[11][2] == ["slot.environment.non_ascii_to_unknown"]
    assert got[12][2] == ["archetype.food_and_drink.container_or_context.to_unknown"]
    assert got[13][:2] == ("outdoor at night", "canonicalized")
    assert got[14] == ("stationary", "unchanged", ["slot.state.low_value_preserved"], [])


def test_normalization_rungs_by_hand(spark):
    """What each rung gives, written down from its description and not from the ladders."""
    cases = [
        ("tool", "material", "Metallic", "metal", ["slot.material.base_material"]),
        ("tool", "material", "wooden/wood", "wooden/wood", []),
        ("tool", "material", "unknown, glass and metallic", "glass+metal", ["slot.material.separator_unify"]),
        ("tool", "color", "golden", "gold", ["slot.color.base_color"]),
        ("tool", "color", "grey and blue", "blue+grey", ["slot.color.separator_unify"]),
        ("tool", "color", "grey/blue", "grey/blue", []),
        ("tool", "color", "red, red", "red, red", []),
        ("tool", "state_or_action", "being held aloft", "being held", ["slot.state.held_family"]),
        ("tool", "state_or_action", "Powered_on  now", "on", ["slot.state.on_family"]),
        ("tool", "state_or_action", "inactive", "off", ["slot.state.off_family"]),
        ("tool", "state_or_action", "at rest", "resting", ["slot.state.canonicalize"]),
        ("tool", "state_or_action", "sitting, " + "x" * 32, "sitting", ["slot.state.primary_clause"]),
        ("tool", "state_or_action", "sitting, " + "x" * 33, "sitting, " + "x" * 33, ["review.mixed_state"]),
        ("tool", "state_or_action", "sitting, a, b", "sitting, a, b", ["review.mixed_state"]),
        ("tool", "state_or_action", "running, fast", "running, fast", ["review.mixed_state"]),
        ("tool", "viewpoint", "Overhead", "top-down", ["slot.viewpoint.canonicalize"]),
        ("tool", "background_or_context", "plain white", "unknown", ["slot.background.low_value_to_unknown"]),
        ("tool", "background_or_context", "Blurred", "unknown", ["slot.background.low_value_to_unknown"]),
        ("tool", "background_or_context", "outdoors", "outdoor", ["slot.background.canonicalize"]),
        ("tool", "salient_part_or_accessory", "numbered", "unknown", ["slot.part.low_value_to_unknown"]),
        ("tool", "shape_or_structure", "object", "object", ["slot.shape.low_value_preserved"]),
        ("tool", "shape_or_structure", "caf\u00e9", "unknown", ["slot.shape_or_structure.non_ascii_to_unknown"]),
        ("tool", "shape_or_structure", "y" * 36 + " with z", "y" * 36 + " with z", ["review.narrative_value"]),
        ("tool", "shape_or_structure", "y" * 33 + " with z", "y" * 33 + " with z", []),
        ("tool", "material", None, "unknown", ["global.placeholder_to_unknown"]),
    ]
    got = fields(spark, *[(a, s, "x", v) for a, s, v, _, _ in cases])
    assert [(g[0], g[2]) for g in got] == [(value, rules) for *_, value, rules in cases]
    # no placeholders: materials still have base names
    assert fields(spark, ("tool", "material", "x", "metallic and wooden"), rules={**dims.RULES, "unknown_like": []})[0][0] == "metal+wood"


def test_type_map_needs_a_plain_type_slot(spark):
    got = fields(spark, ("vehicle", "vehicle_type", "x", "fuel pump"), ("vehicle", "vehicle_type", "x", "crosses"), types=[])
    assert [g[0] for g in got] == ["gas pump", "cross"]


def test_review_policy(spark):
    rows = [("replace_normalized", "low", [dims.RECOVERY]), ("replace_normalized", "low", []), ("replace_normalized", "medium", []), ("set_unknown", "low", []), ("set_unknown", "low", ["review.person_mention"]), ("set_unknown", "high", []), ("defer", "high", [])]
    got = W.apply_policy(spark.createDataFrame(rows, "action string, confidence string, reasons array<string>")).collect()
    assert [r.applied for r in got] == [True, False, True, False, True, True, False]
    assert got[0].application_reason == "accepted_replace_unknown_recovery" and got[3].application_reason == "rejected_low_confidence_set_unknown"


def test_parse_ladder(spark):
    raw = ['{"attributes": {"a": 1}}', "```json\n[1, {\"a\": 2}]\n```", '{"a": 3} tail', '[{"a": "}"}, {"b', '{"archetype": "x", "attributes": {\n- k: v,\n- m: "w"\n}', "{'a': 1}", "[1]", "nothing", '{"archetype": "x", "attributes": {\nk: v }', None]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")
    got = {r.i: (r.parse_method, r.payload and json.loads(r.payload)) for r in P.parse_response(df, "raw").collect()}
    assert got[0] == ("strict", {"attributes": {"a": 1}}) and got[1] == ("strict", {"a": 2}) and got[2] == ("salvage", {"a": 3})
    assert got[3] == ("salvage", {"a": "}"}) and got[4] == ("bullets", {"archetype": "x", "attributes": {"k": "v", "m": "w"}})
    assert [got[i][0] for i in (5, 6, 7, 8, 9)] == ["failed"] * 5


def test_responders(spark):
    df = spark.createDataFrame([("A", ["x", "y"])], "class_name string, slot_schema array<string>")
    assert json.loads(P.respond(df, "mock").first().raw_response) == {"attributes": {"x": "a", "y": "unknown"}}
    P.RESPONDERS.add("later", None)
    with pytest.raises(NotImplementedError):
        P.respond(df, "later")
    with pytest.raises(ValueError):
        P.respond(df, "no such")


def test_render(spark):
    rows = [("1", "vehicle", {"vehicle_type": "jeep", "color": "red+blue", "state_or_action": "on", "environment": "forest", "viewpoint": "front", "salient_part_or_accessory": "object"}, []), ("2", "vehicle", {"vehicle_type": "n/a"}, []), ("3", "instrument", {}, []), ("4", "nope", {}, []), ("", "vehicle", {}, []), ("6", "vehicle", None, [])]
    df = spark.createDataFrame(rows, "record_id string, archetype string, attributes map<string,string>, review array<string>")
    got = {r.record_id: r for r in R.render(df).collect()}
    assert got["1"].canonical_caption == "a red and blue jeep in forest front view"
    assert got["1"].drop_reasons == {"shape_or_structure": "unknown_or_empty", "state_or_action": "bare_on_off_state", "salient_part_or_accessory": "low_value_focus"}
    assert got["2"].error_message == "missing anchor slot: vehicle_type" and got["4"].error_message.startswith("unknown archetype")
    assert got[""].error_message == "missing record_id" and got["6"].error_message == "missing normalized_attributes"
    loose = {r.record_id: r for r in R.render(df, fail_on_missing_anchor=False).collect()}
    assert loose["3"].canonical_caption == "an instrument" and loose["3"].render_warnings == ["template_fallback_anchor_used"]
    token = {r.record_id: r for r in R.render(df, fallback_token="thing").collect()}
    assert token["2"].canonical_caption == "a thing" and token["2"].render_warnings == ["fallback_anchor_used"]


def test_strict_match_raises(spark):
    s = spark.createDataFrame([("c::a", "a", "c", "x")], "record_id string, sample_id string, class_name_raw string, archetype string")
    r = spark.createDataFrame([], "line_no long, record_id string, sample_id string, relative_image_path string, render_status string, canonical_caption string, archetype string, template_family string")
    with pytest.raises(ValueError):
        M.build_pairs(s, r, strict=True)
    assert M.build_pairs(s, r).pairs.isEmpty()


def test_epochs(spark):
    got = spark.createDataFrame([(1, 10), (10, 10), (50, 100), (51, 10), (500, 100), (501, 10)], "n int, c int").select(E.epoch_schedule(F.col("n"), F.col("c"))).collect()
    assert [r[0] for r in got] == [3000, 2000, 1000, 1000, 300, 300]
    e = spark.range(250).select(V.validated(F.col("id"), F.lit(250)).alias("v")).filter("v").count()
    assert e == 126


def blobs(spark, n=40, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(g * 1000 + c * n + i, g, [float(x) for x in rng.normal(0, 0.3, 4) + 10 * np.eye(4)[c]]) for g in (0, 1) for c in range(3) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, cls int, embedding array<float>"), {r[0]: (r[0] % 1000) // n for r in rows}


def same_partition(labels, truth):
    seen = {}
    return all(seen.setdefault((i // 1000, lab), truth[i]) == truth[i] for i, lab in labels.items())


def test_kmeans_and_inertia(spark):
    df, _ = blobs(spark)
    got = K.group_kmeans(df.withColumn("k", F.lit(3)), "cls", "vec_id", "k", rounds=1)
    more = K.group_kmeans(df.withColumn("k", F.lit(3)), "cls", "vec_id", "k", rounds=6)
    a, b = ({r.cls: r.inertia for r in K.inertia(df, x, "cls", "vec_id").collect()} for x in (got, more))
    assert more.count() == 240 and all(b[c] <= a[c] + 1e-9 for c in a)
    again = K.group_kmeans(df.repartition(7).withColumn("k", F.lit(3)), "cls", "vec_id", "k", rounds=6)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, more.collect()))


def test_kmeans_against_lloyd(spark):
    rng = np.random.default_rng(11)
    v = {i: rng.normal(size=4) for i in range(150)}
    df = spark.createDataFrame([(i, i % 2, x.tolist(), 4) for i, x in v.items()], "vec_id long, cls int, embedding array<double>, k int")
    got = {r.vec_id: r.label for r in K.group_kmeans(df, "cls", "vec_id", "k", tolerance=0.0).collect()}
    seeds = K.kmeans_starts(df, "cls", "vec_id", "k", 10).collect()
    assert len(seeds) == 2 * 10 * 4 and len(got) == 150
    for cls in (0, 1):
        ids = [i for i in v if i % 2 == cls]
        x, runs = np.stack([v[i] for i in ids]), []
        for start in range(10):
            c = np.stack([v[r.vec_id] for r in sorted(seeds, key=lambda r: r.label) if (r.cls, r.start) == (cls, start)])
            while True:
                label = np.linalg.norm(x[:, None] - c, axis=2).argmin(1)
                new = np.stack([x[label == j].mean(0) for j in range(4)])
                if np.allclose(new, c, atol=1e-12):
                    break
                c = new
            runs.append((((x - c[label]) ** 2).sum(), label))
        assert max(r[0] for r in runs) > min(r[0] for r in runs) + 1e-6
        assert [got[i] for i in ids] == min(runs, key=lambda r: round(r[0], 4))[1].tolist()


def test_density_modes_find_blobs(spark):
    df, truth = blobs(spark)
    got = {r.vec_id: r.label for r in K.density_modes(df, "cls", "vec_id", 3).collect()}
    assert len(got) == 240 and len({v for v in got.values() if v >= 0}) == 3
    assert same_partition({i: v for i, v in got.items() if v >= 0}, truth) and sum(v < 0 for v in got.values()) < 24


def test_kmeans_over_blocks(spark):
    rng = np.random.default_rng(11)
    rows = [(i, i % 2, rng.normal(size=3).tolist()) for i in range(90)] + [(90, 0, None), (91, 1, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, cls int, embedding array<double>").withColumn("k", F.lit(3))
    label = lambda block: {r.vec_id: r.label for r in K.group_kmeans(df, "cls", "vec_id", "k", rounds=3, starts=3, block=block).collect()}
    one = label(1000)
    assert label(8) == one and set(one) == {i for i, _, v in rows if v}


def test_pca_keeps_variance(spark):
    df, _ = blobs(spark)
    got = {r.vec_id: r.embedding for r in K.group_pca(df, "cls", "vec_id", 2).collect()}
    x = np.array([r.embedding for r in df.filter("cls = 0").orderBy("vec_id").collect()])
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2]
    y = np.array([got[i] for i in sorted(got) if i < 1000])
    assert np.allclose(y.var(0, ddof=1), want, rtol=1e-4)


def test_density_modes_nested_beyond_neighbour_lists(spark):
    rows = []  # three simplexes of 20 rows: two whose rows have all 15 nearest rows at home but stand little farther apart, and one far away
    for k in range(60):
        v = [0.0] * 62
        v[k], v[60], v[61] = 1.0, float(k // 20 == 1), 1000.0 * (k // 20 == 2)
        rows.append((k, 0, v))
    got = {r.vec_id: r.label for r in K.density_modes(spark.createDataFrame(rows, "vec_id long, cls int, embedding array<double>"), "cls", "vec_id", 3).collect()}
    assert got[0] >= 0 and len({got[k] for k in range(40)}) == 1 and len({got[k] for k in range(40, 60)}) == 1 and got[0] != got[59] >= 0


def test_tree_edges_over_blocks(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(90, 3)), 2)
    v[:30] = v[0]  # more equal rows than a neighbour list holds
    df = spark.createDataFrame([(k, 0, x.tolist(), 0.1) for k, x in enumerate(v)], "a long, cls int, v array<double>, core double")
    weight = lambda block: sorted(r.w for r in K.spanning_forest(K.tree_edges(df, "cls", block), "cls").collect())
    one = weight(1000)
    assert len(one) == 89 and weight(20) == one


def test_condensed_labels_without_structure():
    x = np.arange(30.0)
    assert (K.condensed_labels(30, np.arange(29), np.arange(1, 30), np.diff(x), 5) == -1).all()


def test_files(spark, tmp_path):
    for f in ("a/1.JPG", "a/x/2.png", "b/3.webp", "b/readme.txt", "top.jpg"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes(b"x")
    got = {(r.sample_id, r.class_id) for r in S.scan_labeled_files(spark, str(tmp_path)).collect()}
    assert got == {("a/1.JPG", 0), ("a/x/2.png", 0), ("b/3.webp", 1)}


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('﻿{"a": "1"}\n\n{"a": null}\nbroken\n[1]\n', encoding="utf-8")
    rows, errors = S.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a string", strict=False)
    assert [(r.line_no, r.line) for r in errors.orderBy("line_no").collect()] == [(4, "broken"), (5, "[1]")]
    assert [r.a for r in rows.collect()] == ["1", None] and errors.count() == 2
    with pytest.raises(ValueError):
        S.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a string")
    S.write_jsonl(rows, str(tmp_path / "out"))
    assert '{"a":null}' in "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))


def test_side_tables(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": "x", "b": "y"}')
    assert {tuple(r) for r in S.load_string_map(spark, str(tmp_path / "m.json")).collect()} == {("a", "x"), ("b", "y")}
    (tmp_path / "n.json").write_text('{"a": 1}')
    with pytest.raises(ValueError):
        S.load_string_map(spark, str(tmp_path / "n.json"))
    (tmp_path / "t.json").write_text('{"archetypes": [{"name": "n", "definition": "d", "includes": ["1", "2", "3", "4", "5"], "excludes": [], "notes": null}]}')
    t = S.load_taxonomy(spark, str(tmp_path / "t.json"))
    assert "includes: 1, 2, 3, 4\n" in E.taxonomy_prompt(t).first().prompt
    (tmp_path / "r.json").write_text('{"unknown_like_values": ["N/A"], "state_map": {"In_Use": "x"}}')
    assert {tuple(r) for r in S.load_rules(spark, str(tmp_path / "r.json")).collect()} == {("unknown_like_values", "n/a", None), ("state_map", "in use", "x")}


def test_weights_sum_to_one(spark):
    from curatrix.plans.condensation import _med

    w = _med(spark, "/root/testdata/sf0.001").groupBy("cls").agg(F.sum("weight")).collect()
    assert all(math.isclose(r[1], 1, abs_tol=1e-3) for r in w)
