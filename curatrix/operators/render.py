"""Canonical captions from normalized attributes.

A record's template slots are handled as one array inside its row: every slot gets its value, its drop reason and its phrase by column
expressions, so a caption needs no shuffle. The ladder of drop reasons is ordered; the first that holds names the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import dims
from curatrix.functions.text import cleanup_caption, fold, squash, with_article

# Words and patterns of the drop and phrase rules.
UNKNOWN_LIKE = ["unknown", "not_applicable", "n/a", "none", "null", ""]
LOW_FOCUS = ["entire fish", "entire body", "entire object", "object", "numbered", "atlas disposal logo"]
LOW_BACKGROUND = ["neutral", "unknown", "indistinct", "dark", "cloth"]
LOW_TRAIT = ["fish", "object", "dumpster-like", "tethered"]
PERSON = r"(?i)\b(person|man|woman|child|children)\b"
NARRATIVE = r"(?i)\b(from|perspective|reflected|showing|set for|with logo|with text|tagged|beachgoers)\b"
FOCUS_SLOTS = ["salient_part_or_focus", "salient_part_or_accessory", "salient_structural_part"]
PLACE_SLOTS = [
    "background_or_habitat", "background_or_context", "environment", "surrounding_environment", "background_or_room_context",
    "background_or_activity_context", "container_or_context", "display_or_usage_context", "vegetation_or_natural_context",
]
STATE_SLOTS = [
    "playing_state_or_pose", "activity_or_usage_state", "usage_state", "operating_state_or_display_state", "state_or_action",
    "usage_or_display_state", "fill_state_or_contents_visibility", "wearing_state_or_pose", "pose_or_state",
]
OBJECTS = ["instrument", "sports_or_toy", "tool", "device_or_appliance", "vehicle", "container", "household_object", "furniture", "weapon"]
VIEWS = {
    "frontal": "front view", "front": "front view", "front view": "front view", "side": "side view", "side view": "side view", "top-down": "top-down view",
    "top": "top-down view", "top-down view": "top-down view", "rear": "rear view", "rear view": "rear view", "close-up": "close-up view",
    "close-up view": "close-up view", "ground level": "ground-level view", "ground level view": "ground-level view", "interior": "interior view",
}
SHAPES = ["body_trait", "shape_or_structure", "shape_or_growth_form", "architectural_style_or_form"]
WORN_SUPPRESSED = ["face", "arms", "wet hair", "formal attire", "underwater"]
PERSON_CONTEXT = ["coral reef", "ocean water", "underwater shipwreck", "wedding setting", "wedding reception", "outdoor garden setting"]
PERSON_EQUIPMENT = ["scuba tank", "bouquet of flowers", "wine bottle"]
SCENE_FEATURES = ["mountain", "mountains", "geothermal area", "sea"]
CONTAINER_FILLS = ["partially filled with white powder", "green smoke", "closed jar", "empty"]
BUSY_HABITAT = "(side|setting)$"


def select_value(c: Column) -> Column:
    """The squashed value, null if it says nothing."""
    t = squash(c)
    return F.when(~fold(t).isin(*UNKNOWN_LIKE), t)


def drop_reason(archetype: Column, slot: Column, value: Column, review: Column) -> Column:
    """Why a selected value isn't said; null if it is."""
    low, ascii_ = fold(value), ~value.rlike(r"[^\x00-\x7F]")
    story = value.rlike(NARRATIVE)
    focus, place, state = slot.isin(*FOCUS_SLOTS), slot.isin(*PLACE_SLOTS), slot.isin(*STATE_SLOTS)
    is_ = lambda a: archetype == a
    ladder = [
        (value.isNull(), "unknown_or_empty"),
        (~ascii_, "non_ascii_noise"),
        (value.rlike(PERSON), "person_or_narrative_noise"),
        (review & focus & low.isin(*LOW_FOCUS), "review_required_low_value_focus"),
        (focus & low.isin(*LOW_FOCUS), "low_value_focus"),
        ((slot == "viewpoint") & story, "narrative_viewpoint"),
        (place & low.isin(*LOW_BACKGROUND), "low_value_background"),
        (place & story, "narrative_background"),
        (is_("animal") & (slot == "background_or_habitat") & low.rlike(BUSY_HABITAT), "complex_background"),
        (is_("animal") & (slot == "pose_or_state") & (low == "stationary"), "animal_pose_suppressed"),
        (state & low.isin("on", "off"), "bare_on_off_state"),
        (archetype.isin(*OBJECTS) & state & (low == "inactive"), "low_value_state"),
        (is_("food_and_drink") & (slot == "preparation_or_serving_style") & story, "food_style_suppressed"),
        (is_("human_or_person") & (slot == "background_or_activity_context") & low.isin(*PERSON_CONTEXT), "human_context_suppressed"),
        (is_("human_or_person") & (slot == "held_object_or_equipment") & low.isin(*PERSON_EQUIPMENT), "human_equipment_suppressed"),
        (is_("natural_scene_or_landform") & slot.isin("vegetation_or_natural_context", "salient_geographic_feature") & story, "narrative_scene_slot"),
        (is_("natural_scene_or_landform") & (slot == "salient_geographic_feature") & low.isin(*SCENE_FEATURES), "scene_feature_suppressed"),
        (is_("container") & (slot == "fill_state_or_contents_visibility") & low.isin(*CONTAINER_FILLS), "container_fill_suppressed"),
        (slot.isin("body_trait", "shape_or_structure", "architectural_style_or_form") & low.isin(*LOW_TRAIT), "low_value_trait"),
        (slot.isin("shape_or_structure", "architectural_style_or_form") & story, "narrative_shape"),
    ]
    out = F.lit(None).cast("string")
    for cond, reason in reversed(ladder):
        out = F.when(cond, reason).otherwise(out)
    return out


def clean_pre_anchor(slot: Column, value: Column) -> Column:
    """What stands before the anchor; null if nothing is left. Suppressed words are looked for before the comma cut."""
    low = fold(value)
    worn = slot.isin("visible_body_trait", "clothing_or_gear")
    joined = F.replace(F.regexp_replace(F.replace(value, F.lit(","), F.lit(" and")), r"\s+and\s+", " and "), F.lit(" and and "), F.lit(" and "))
    plus = lambda c: squash(F.replace(c, F.lit("+"), F.lit(" and ")))
    out = (
        F.when(worn & low.isin(*WORN_SUPPRESSED), F.lit(None))
        .when(worn, F.trim(F.split(value, ",")[0]))
        .when(slot.isin(*SHAPES) & low.isin(*LOW_TRAIT), F.lit(None))
        .when(slot.isin(*SHAPES), plus(joined))
        .when(slot.isin("color", "color_or_pattern"), squash(F.replace(plus(value), F.lit("yellowish"), F.lit("yellow"))))
        .otherwise(value)
    )
    return F.when(out != "", out)


def format_post(slot: Column, value: Column) -> Column:
    """What follows the anchor."""
    low = fold(value)
    view = F.coalesce(*[F.when(low == k, v) for k, v in VIEWS.items()], F.when(low.endswith("view"), value), F.concat(value, F.lit(" view")))
    with_ = slot.isin(*FOCUS_SLOTS, "held_object_or_equipment", "salient_geographic_feature", "weather_or_water_state")
    return (
        F.when(slot == "viewpoint", view)
        .when(slot.isin(*PLACE_SLOTS), F.concat(F.lit("in "), value))
        .when(with_, F.concat(F.lit("with "), value))
        .when(slot.isin("content_or_symbol_type", "visible_part"), F.concat(F.lit("showing "), value))
        .when((slot == "preparation_or_serving_style") & (low == "raw"), "raw")
        .otherwise(value)
    )


def _templates() -> Column:
    """archetype -> struct of its template."""
    text = lambda v: F.lit(v).cast("string")
    one = lambda t: F.struct(text(t[0]).alias("id"), text(t[1]).alias("anchor"), F.array(*map(F.lit, t[2])).alias("pre"), F.array(*map(F.lit, t[3])).alias("post"), text(t[4]).alias("fallback"))
    return F.create_map(*[x for a, t in dims.TEMPLATES.items() for x in (F.lit(a), one(t))])


def render(records: DataFrame, fallback_token: str | None = None, fail_on_missing_anchor: bool = True) -> DataFrame:
    """records (record_id, archetype, attributes map<string,string>, review array<string> of slots under review) plus canonical_caption,
    verbalized_slots, dropped_slots, drop_reasons, render_warnings, render_status, error_message, template_id, anchor_slot."""
    t = records.withColumn("_t", F.try_element_at(_templates(), F.col("archetype")))
    given = select_value(F.try_element_at("attributes", F.col("_t.anchor")))
    spare = F.lit(fallback_token) if fallback_token else F.lit(None).cast("string") if fail_on_missing_anchor else F.col("_t.fallback")
    t = t.withColumns({"_given": given, "_anchor": F.coalesce(given, spare)})
    of = lambda part: F.transform(F.col(f"_t.{part}"), lambda s: F.struct(s.alias("slot"), select_value(F.try_element_at("attributes", s)).alias("value")))
    t = t.withColumn("_in", F.concat(F.transform(of("pre"), lambda x: F.struct(F.lit(True).alias("pre"), x["slot"].alias("slot"), x["value"].alias("value"))), F.transform(of("post"), lambda x: F.struct(F.lit(False).alias("pre"), x["slot"].alias("slot"), x["value"].alias("value")))))

    def said(x: Column) -> Column:
        why = drop_reason(F.col("archetype"), x["slot"], x["value"], F.array_contains("review", x["slot"]))
        phrase = F.when(x["pre"], clean_pre_anchor(x["slot"], x["value"])).otherwise(format_post(x["slot"], x["value"]))
        empty = F.when(phrase.isNull() | (phrase == ""), F.when(x["pre"], "empty_after_cleaning").otherwise("empty_after_formatting"))
        return F.struct(x["pre"].alias("pre"), x["slot"].alias("slot"), F.coalesce(why, empty).alias("why"), phrase.alias("phrase"))

    t = t.withColumn("_said", F.transform("_in", said))
    kept = lambda pre: F.filter("_said", lambda x: (x["pre"] == pre) & x["why"].isNull())
    gone = F.filter("_said", lambda x: x["why"].isNotNull())
    names, phrases = (lambda a: F.transform(a, lambda x: x["slot"])), (lambda a: F.transform(a, lambda x: x["phrase"]))
    noun = F.array_join(F.concat(phrases(kept(True)), F.array("_anchor")), " ")
    caption = cleanup_caption(F.array_join(F.concat(F.array(with_article(noun)), phrases(kept(False))), " "))
    error = (
        F.when(F.coalesce("record_id", F.lit("")) == "", "missing record_id")
        .when(F.coalesce("archetype", F.lit("")) == "", "missing archetype")
        .when(F.col("_t").isNull(), F.concat(F.lit("unknown archetype: "), "archetype"))
        .when(F.col("attributes").isNull(), "missing normalized_attributes")
        .when(F.col("_anchor").isNull(), F.concat(F.lit("missing anchor slot: "), "_t.anchor"))
        .when(caption == "", "empty caption after rendering")
    )
    t = t.withColumns({"error_message": error, "_caption": caption})
    ok = F.col("error_message").isNull()
    warn = F.array_compact(F.array(F.when(F.col("_given").isNull() & F.lit(bool(fallback_token)), "fallback_anchor_used"), F.when(F.size("review") > 0, "normalization_review_required"), F.when(F.col("_given").isNull() & F.lit(not fallback_token), "template_fallback_anchor_used")))
    t = t.withColumns(
        {
            "canonical_caption": F.when(ok, F.col("_caption")),
            "verbalized_slots": F.when(ok, F.concat(names(kept(True)), F.array("_t.anchor"), names(kept(False)))),
            "dropped_slots": F.when(ok, names(gone)),
            "drop_reasons": F.when(ok, F.map_from_entries(F.transform(gone, lambda x: F.struct(x["slot"], x["why"])))),
            "render_warnings": F.when(ok, warn),
            "render_status": F.when(ok, "success").otherwise("failed"),
            "template_id": F.col("_t.id"),
            "anchor_slot": F.col("_t.anchor"),
        }
    )
    new = ["canonical_caption", "verbalized_slots", "dropped_slots", "drop_reasons", "render_warnings", "render_status", "template_id", "anchor_slot", "error_message"]
    return t.select(*records.columns, F.inline(F.array(F.struct(*new))))


def render_summary(rendered: DataFrame) -> DataFrame:
    """(kind, k, v): counts, success rate (0 without rows), mean number of said slots, successes by archetype and template, dropped slots."""
    ok = F.col("render_status") == "success"
    whole = rendered.agg(
        F.count("*").cast("double").alias("rows"), F.count_if(ok).cast("double").alias("success"), F.count_if(~ok).cast("double").alias("failed"),
        F.coalesce(F.count_if(ok) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("rate"), F.coalesce(F.avg(F.when(ok, F.size("verbalized_slots"))), F.lit(0.0)).alias("mean_slots"),
    )
    out = whole.unpivot([], ["rows", "success", "failed", "rate", "mean_slots"], "k", "v").select(F.lit("total").alias("kind"), "k", "v")
    by = rendered.filter(ok).groupingSets([["archetype"], ["template_id"]], "archetype", "template_id").agg(F.count("*").cast("double").alias("v"), F.grouping("archetype").alias("g"))
    out = out.unionByName(by.select(F.when(F.col("g") == 0, "archetype").otherwise("template").alias("kind"), F.coalesce("archetype", "template_id").alias("k"), "v"))
    dropped = rendered.select(F.explode("dropped_slots").alias("k")).groupBy("k").agg(F.count("*").cast("double").alias("v"))
    return out.unionByName(dropped.select(F.lit("dropped").alias("kind"), "k", "v"))


def render_resume(rows: DataFrame, done: DataFrame) -> DataFrame:
    """rows whose record_id (else sample_id) isn't among the successes of done."""
    key = lambda: F.coalesce(F.nullif("record_id", F.lit("")), "sample_id")
    old = done.filter("render_status = 'success'").select(key().alias("_k")).filter("_k is not null").distinct()
    return rows.withColumn("_key", key()).join(old, F.col("_key") == F.col("_k"), "left_anti").drop("_key")
