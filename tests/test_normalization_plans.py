"""What the plans of normalization and review may hold, so that their cost follows the rows: ladders once, one pass over fields, no table at the driver."""

from curatrix.functions import dims
from curatrix.operators import enrich as E
from curatrix.operators import normalize as N
from curatrix.operators import review as R

LONG = "record_id string, archetype string, class_name string, class_name_raw string, slot_pos int, slot string, raw_value string"


def long_rows(spark, *rows):
    return spark.createDataFrame([(r, a, "x", "x", i, s, v) for i, (r, a, s, v) in enumerate(rows)], LONG)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_ladder_looks_at_each_condition_once(spark):
    df = N.apply_step(N.begin(long_rows(spark, ("r", "tool", "usage_state", "active"))), "state_pattern")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("StartsWith(") == 4


def test_fields_are_worked_out_and_shuffled_once(spark):
    items = R.review_items(N.normalize_attributes(long_rows(spark, ("r", "weapon", "weapon_type", "x"))))
    plan = physical(items)
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_decisions_are_not_broadcast(spark):
    full = N.normalize_attributes(long_rows(spark, ("r", "weapon", "weapon_type", "x")))
    out = R.apply_review(full, R.apply_policy(R.mock_review(R.review_items(full))))
    assert "Broadcast" not in physical(out)


def test_consistency_of_odd_records(spark):
    """Rows without a record id, a slot that stands twice, archetypes that meet in a record."""
    rows = [
        (None, "food_and_drink", "food_or_drink_type", "mug cake"),
        (None, "food_and_drink", "container_or_context", "mug cake"),
        ("twice", "weapon", "weapon_type", "gun case"),
        ("twice", "weapon", "weapon_type", "axe"),
        ("both", "structure_or_building", "structure_or_building_type", "gothic"),
        ("both", "structure_or_building", "architectural_style_or_form", "gothic"),
        ("both", "animal", "structure_or_building_type", "other"),
        ("alone", "animal", "weapon_type", "gun case"),
    ]
    got = {(r.record_id, r.slot, r.raw_value): r.reasons for r in N.consistency_review(N.normalize_fields(long_rows(spark, *rows), types=[])).collect()}
    conflict, mixed, near = "review.cross_slot_value_conflict", "review.structure_type_style_conflict", "review.weapon_anchor_related_object"
    assert len(got) == 8
    assert got[None, "food_or_drink_type", "mug cake"] == got[None, "container_or_context", "mug cake"] == got["alone", "weapon_type", "gun case"] == []
    assert got["twice", "weapon_type", "gun case"] == got["twice", "weapon_type", "axe"] == [near]
    assert got["both", "structure_or_building_type", "gothic"] == got["both", "structure_or_building_type", "other"] == [conflict, mixed]
    assert got["both", "architectural_style_or_form", "gothic"] == [conflict]


def test_large_tables_of_rules_and_spacing(spark):
    rules = {**dims.RULES, "state": {f"state {i}": f"s{i}" for i in range(500)} | {"same": "same"}}
    values = ["State_499", "\u00a0state   0 ", "same", "a / b ,c", "IN\u2003USE", "STRASSE\u00df"]
    got = N.normalize_fields(long_rows(spark, *[("r", "tool", "usage_state", v) for v in values]), rules).orderBy("slot_pos").collect()
    assert [(r.value, r.rules[:1]) for r in got[:3]] == [("s499", ["slot.state.canonicalize"]), ("s0", ["slot.state.canonicalize"]), ("same", [])]
    assert [r.cleaned for r in got[3:]] == ["a/b, c", "in use", "strassess"]


def test_review_prompts_need_no_table_at_the_driver(spark):
    fields = spark.createDataFrame([("r", "b", "2", ["x"]), ("r", "a", "1", [dims.RECOVERY]), ("s", "a", "3", ["x"]), (None, "a", "4", ["x"])], "record_id string, slot string, value string, reasons array<string>")
    out = E.build_review_prompt(fields)
    assert "Join" not in physical(out) and "Broadcast" not in physical(out)
    got = {(r.record_id, r.slot): r.prompt for r in out.collect()}
    assert got == {("r", "a"): "Recover a value for a: 1\nContext: b=2", ("r", "b"): "Check the value of b: 2\nContext: a=1", ("s", "a"): "Check the value of a: 3\nContext: "}
