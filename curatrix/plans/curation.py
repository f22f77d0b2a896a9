"""Queries of enrichment, parsing, rendering, matching and evaluation, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import dims
from curatrix.functions import text as T
from curatrix.operators import enrich as E
from curatrix.operators import evaluate as V
from curatrix.operators import match as M
from curatrix.operators import parse as P
from curatrix.operators import render as R
from curatrix.plans.bindings import ATTRIBUTES_SQL, SAMPLES_SQL, _list, attributes, samples, sql_squash
from curatrix.session import table

QUERIES, SQL = {}, {}


def _add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


C = F.col
_S = f"with {SAMPLES_SQL}"
# projections
_add("record_id", lambda s, d: samples(s, d).select(T.record_id(C("class_name_raw"), C("sample_id"), F.lit("x")).alias("record_id")), f"{_S} select record_id from samples")
_add(
    "sample_metadata",
    lambda s, d: E.sample_metadata(samples(s, d), "/data/set/train").select("record_id", "split", "relative_image_path", "file_name", "archetype"),
    f"{_S} select record_id, 'train' split, sample_id relative_image_path, string_split(sample_id, '/')[-1] file_name, archetype from samples",
)
_ARCH = "case " + " ".join(f"when regexp_matches(lower(class_name), '{'|'.join(w)}') then '{a}'" for a, w in dims.KEYWORDS.items()) + f" else '{dims.DEFAULT_ARCHETYPE}' end"
_add("infer_archetype", lambda s, d: table(s, d, "documents").select("doc_id", E.infer_archetype(C("text")).alias("archetype")), "select doc_id, " + _ARCH.replace("class_name", "text") + " archetype from documents")
_MAP = "(values ('Brand#11', 'Lamp'), ('Brand#12', 'Chair'), ('Brand#31', 'Desk'))"


def _map(s):
    return s.createDataFrame([("Brand#11", "Lamp"), ("Brand#12", "Chair"), ("Brand#31", "Desk")], "key string, value string")


_add("assign_class_name", lambda s, d: M.lookup_join(samples(s, d), _map(s), "class_name_raw", "named", C("class_name_raw")).select("record_id", "named"), f"{_S} select record_id, coalesce(m.v, class_name_raw) named from samples left join {_MAP} m(k, v) on k = class_name_raw")
_add("lookup_join", lambda s, d: M.lookup_join(samples(s, d), _map(s), "class_name_raw", "v", F.lit("none")).groupBy("v").agg(F.count("*").alias("n")), f"{_S} select coalesce(m.v, 'none') v, count(*) n from samples left join {_MAP} m(k, v) on k = class_name_raw group by all")
_add("assign_archetype", lambda s, d: M.lookup_join(samples(s, d), _map(s).withColumn("value", F.lit("furniture")), "class_name_raw", "a", E.infer_archetype(C("class_name"))).select("record_id", "a"), f"{_S} select record_id, case when m.k is not null then 'furniture' else {_ARCH} end a from samples left join {_MAP} m(k, v) on k = class_name_raw")
_add("slot_schema", lambda s, d: samples(s, d).select("record_id", F.array_join(E.slot_schema(C("archetype")), ",").alias("slots")), f"with {ATTRIBUTES_SQL} select record_id, string_agg(slot, ',' order by slot_pos) slots from attributes group by record_id")
_add(
    "build_prompt",
    lambda s, d: samples(s, d).select("record_id", E.build_prompt(C("class_name"), C("archetype")).alias("prompt")),
    f"""with {ATTRIBUTES_SQL} select record_id, 'Class: ' || class_name || chr(10) || 'Archetype: ' || archetype || chr(10) || 'Fill this template:' || chr(10) || '{{' || chr(10) || '  "archetype": "' || archetype || '",' || chr(10) || '  "attributes": {{' || chr(10) ||
string_agg('    "' || slot || '": "' || case slot when 'viewpoint' then 'camera angle' else 'short visible value' end || '"', ',' || chr(10) order by slot_pos) || chr(10) || '  }}' || chr(10) || '}}' || chr(10) || 'Answer with JSON only. Write unknown for what can''t be seen.' prompt
from attributes group by record_id, class_name, archetype""",
)
_add(
    "build_review_prompt",
    lambda s, d: E.build_review_prompt(attributes(s, d).filter("raw_value is not null").select("record_id", "slot", C("raw_value").alias("value"), F.when(C("slot_pos") % 2 == 0, F.array(F.lit(dims.RECOVERY))).otherwise(F.array(F.lit("x"))).alias("reasons"))).select("record_id", "slot", "prompt"),
    f"""with {ATTRIBUTES_SQL}, a as (select * from attributes where raw_value is not null) select x.record_id, x.slot, case when x.slot_pos % 2 = 0 then 'Recover a value for ' else 'Check the value of ' end || x.slot || ': ' || x.raw_value || chr(10) || 'Context: ' ||
coalesce(string_agg(y.slot || '=' || y.raw_value, '; ' order by y.slot) filter (y.slot <> x.slot), '') prompt from a x join a y using (record_id) group by x.record_id, x.slot, x.slot_pos, x.raw_value""",
)
_add("split_record_id", lambda s, d: samples(s, d).select(T.split_record_id(F.when(C("p_partkey") % 5 != 0, C("record_id")).otherwise(C("sample_id"))).alias("p")).filter("p is not null").select(C("p")[0].alias("class_name_raw"), C("p")[1].alias("sample_id")), f"{_S} select class_name_raw, sample_id from samples where p_partkey % 5 <> 0")
_add("normalize_relpath", lambda s, d: table(s, d, "pages").select("page_id", T.normalize_relpath(F.concat(F.lit("./../\\x\\"), F.regexp_replace("url", "^https?:/", ""))).alias("p")), "select page_id, regexp_replace(replace('./../\\x\\' || regexp_replace(url, '^https?:/', ''), '\\', '/'), '^[./]+', '') p from pages")
_add("string_or_none", lambda s, d: attributes(s, d).select("record_id", "slot", T.string_or_none(C("raw_value")).alias("v")), f"with {ATTRIBUTES_SQL} select record_id, slot, nullif(trim(raw_value), '') v from attributes")
_add("sanitize_copy_name", lambda s, d: table(s, d, "pages").select("page_id", T.sanitize_copy_name(C("url")).alias("v")), "select page_id, regexp_replace(replace(replace(url, '/', '__'), ':', '_'), '[^\\p{L}\\p{N}._-]', '_', 'g') v from pages")
_add(
    "dataset_label",
    lambda s, d: table(s, d, "nation").select(T.dataset_label(F.concat(F.lit("/data/"), "n_name", F.when(C("n_nationkey") % 2 == 0, "/train").otherwise(""))).alias("label"), "n_nationkey"),
    "select n_nationkey, trim(regexp_replace(regexp_replace(n_name || case when n_nationkey % 2 = 0 then '_train' else '' end, '[^A-Za-z0-9._-]', '_', 'g'), '_+', '_', 'g'), '._-') as label from nation",
)
_MODES = "(select o_orderkey % 1200 cluster_id, o_orderkey k, o_orderpriority caption, o_orderstatus status from orders)"
_add(
    "generation_plan",
    lambda s, d: E.generation_plan(table(s, d, "orders").select((C("o_orderkey") % 1200).alias("cluster_id"), C("o_orderkey").alias("global_mode_index"), C("o_orderstatus").alias("class_name_raw"), C("o_orderstatus").alias("class_name"), F.when(C("o_orderkey") % 3 == 0, "").otherwise(C("o_orderpriority")).alias("representative_caption"))).select("prompt", "seed", "file_name"),
    f"select case when k % 3 = 0 then status else caption end prompt, 42 + k seed, status || '_mode' || case when cluster_id < 100 then lpad(cast(cluster_id as varchar), 3, '0') else cast(cluster_id as varchar) end || '.png' file_name from {_MODES}",
)
_add("epoch_schedule", lambda s, d: table(s, d, "part").select("p_partkey", E.epoch_schedule(C("p_partkey") % 700 + 1, F.when(C("p_partkey") % 2 == 0, 100).otherwise(10)).alias("epochs")), "with e as (select p_partkey, p_partkey % 700 + 1 n, p_partkey % 2 = 0 h from part), f as (select *, case when n = 1 then 3000 when n <= 10 then 2000 when n <= 50 then 1500 when n <= 200 then 1000 when n <= 500 then 500 else 300 end x from e), g as (select *, case when h then x * 2 // 3 else x end y from f) select p_partkey, cast(y - y % 100 as int) epochs from g")
_add("limit_pairs", lambda s, d: E.limit_pairs(samples(s, d).select("record_id", "archetype"), 25, "record_id"), f"{_S} select record_id, archetype from samples order by record_id limit 25")
_add("class_groups", lambda s, d: samples(s, d).groupBy("class_name_raw").agg(F.count("*").alias("n")), f"{_S} select class_name_raw, count(*) n from samples group by all")
_add("sample_n_per_class", lambda s, d: sample_n_per_class(samples(s, d), "class_name_raw", "sample_id", 3).select("sample_id"), f"{_S} select sample_id from samples qualify row_number() over (partition by class_name_raw order by sample_id) <= 3")


def sample_n_per_class(files, cls, path, n):
    """The first n paths of each class, through a bounded list of minima that is pre-aggregated, not a window over a hot class."""
    from curatrix.sources.files import first_n_per_class

    return first_n_per_class(files, cls, path, n)


# parsing
_ATTRS = """'{"attributes": {"color": " Red  car ", "viewpoint": null, "extra": "x", "blank": " "}}'"""


def _raw(s, d):
    k = C("p_partkey") % 6
    body = F.concat(F.lit('{"archetype": "animal", "attributes": {"color": "'), F.split("p_name", " ")[0], F.lit('"}}'))
    raw = (
        F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("["), body, F.lit(", 1]"))).when(k == 3, F.concat(F.lit("["), body, F.lit(', {"archetype": "an')))
        .when(k == 4, F.concat(F.lit('{\n"archetype": "animal",\n"attributes": {\n - color: '), F.split("p_name", " ")[0], F.lit(',\n'))).otherwise("no json")
    )
    raw = F.when(k == 4, F.concat(raw, F.lit(" - type: x\n"), F.when(C("p_partkey") % 4 == 0, "}").otherwise("bad line }"))).otherwise(raw)
    return samples(s, d).select("record_id", "p_partkey", raw.alias("raw_response"))


_add("parse_strict", lambda s, d: _raw(s, d).withColumn("p", P.parse_strict(T.strip_fences(C("raw_response")))).select("record_id", F.get_json_object("p.payload", "$.attributes.color").alias("color"), C("p.broken").alias("broken")), f"{_S} select record_id, case when p_partkey % 6 < 3 then string_split(p_name, ' ')[1] end color, p_partkey % 6 >= 3 broken from samples")
# the three parsers over every format
_BODY = """'{"archetype": "animal", "attributes": {"color": "' || string_split(p_name, ' ')[1] || '"}}'"""
_BULLETS = """'{' || chr(10) || '"archetype": "animal",' || chr(10) || '"attributes": {' || chr(10) || ' - color: ' || string_split(p_name, ' ')[1] || ',' || chr(10) || ' - type: x' || chr(10) || case when p_partkey % 4 = 0 then '}' else 'bad line }' end"""
_add(
    "strip_fences",
    lambda s, d: _raw(s, d).select("record_id", T.strip_fences(C("raw_response")).alias("t")),
    f"""{_S} select record_id, case p_partkey % 6 when 0 then {_BODY} when 1 then {_BODY} when 2 then '[' || {_BODY} || ', 1]' when 3 then '[' || {_BODY} || ', {{"archetype": "an' when 4 then {_BULLETS} else 'no json' end t from samples""",
)
_add("salvage_object", lambda s, d: _raw(s, d).withColumn("p", P.salvage_object("raw_response")).select("record_id", F.get_json_object("p.payload", "$.attributes.color").alias("color")), f"{_S} select record_id, case when p_partkey % 6 < 4 then string_split(p_name, ' ')[1] end color from samples")
_add(
    "parse_bullets",
    lambda s, d: _raw(s, d).withColumn("p", P.parse_bullets(C("raw_response"))).select("record_id", C("p.attributes")["color"].alias("color"), C("p.error").alias("error")),
    f"{_S} select record_id, case when p_partkey % 6 = 4 and p_partkey % 4 = 0 then string_split(p_name, ' ')[1] end color, case when p_partkey % 6 = 5 then 'missing archetype' when p_partkey % 6 < 4 or p_partkey % 4 <> 0 then 'unsupported attribute line' end error from samples",
)
_add(
    "parse_response",
    lambda s, d: P.parse_response(_raw(s, d), "raw_response").select("record_id", "parse_method", F.get_json_object("payload", "$.attributes.color").alias("color")),
    f"""{_S} select record_id, case when p_partkey % 6 < 3 then 'strict' when p_partkey % 6 = 3 then 'salvage' when p_partkey % 6 = 4 and p_partkey % 4 = 0 then 'bullets' else 'failed' end parse_method,
case when p_partkey % 6 < 4 or (p_partkey % 6 = 4 and p_partkey % 4 = 0) then string_split(p_name, ' ')[1] end color from samples""",
)
_EXPECT = ["k", "z"]
_add("extract_attributes", lambda s, d: table(s, d, "events").select("event_id", F.get_json_object(P.extract_attributes(F.when(C("event_id") % 2 == 0, F.concat(F.lit('{"attributes": '), "props", F.lit("}"))).otherwise(C("props"))), "$.k").alias("k")), "select event_id, json_extract_string(props, '$.k') k from events")
_add("complete_missing", lambda s, d: table(s, d, "events").select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries(P.complete_missing(F.from_json("props", "map<string,string>"), F.array(F.lit("k"), F.lit("z"))))), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("m")), "select event_id, 'k=' || json_extract_string(props, '$.k') || ';z=unknown' m from events")
_KINDS = [None, '{"k": " ", "z": "x"}', '{"k": [1], "z": {"a": 1}}', '{"k": true, "z": null}', '{"k": "x", "z": 1.5}', "[1]"]
_add(
    "validate_payload",
    lambda s, d: table(s, d, "events").select("event_id", P.validate_payload(F.coalesce(F.lit(_KINDS)[(C("event_id") % 6).cast("int")], "props"), F.array(F.lit("k"), F.lit("z"))).alias("errors")),
    "select event_id, case event_id % 6 when 0 then 'number in k; missing z' when 1 then 'empty k' when 2 then 'list in k; object in z' when 3 then 'boolean in k' when 4 then 'number in z' else 'attributes must be an object' end errors from events",
)
_add("project_attributes", lambda s, d: attributes(s, d).groupBy("record_id", "archetype").agg(F.map_from_entries(F.collect_list(F.struct("slot", "raw_value"))).alias("m")).select("record_id", F.explode(P.project_attributes(C("m"), E.slot_schema(C("archetype")))).alias("e")).select("record_id", "e.slot", "e.value"), f"with {ATTRIBUTES_SQL} select record_id, slot, case when raw_value is null then null when {sql_squash('raw_value')} = '' then 'unknown' else {sql_squash('raw_value')} end as value from attributes")
_add(
    "extract_job",
    lambda s, d: P.first_valid_attempt(table(s, d, "conversations").select("conv_id", "turn", (C("role") == "assistant").alias("ok"), F.md5(C("text").cast("binary")).alias("payload"), F.concat(F.lit("bad "), "role").alias("error")), "conv_id", "turn", "ok", "payload", "error", 3),
    """with a as (select * from conversations where turn <= 3) select conv_id, case when bool_or(role = 'assistant') then 'success' else 'failed' end extraction_status, arg_min(md5(text), turn) filter (role = 'assistant') payload,
case when not bool_or(role = 'assistant') then arg_max('bad ' || role, turn) end error_message, min(turn) filter (role = 'assistant') attempt from a group by conv_id""",
)


def _attempts(s, d):
    """Three attempts a record: the formats of _raw, then an object whose color is a number for each fifth record, then one too many."""
    first = _raw(s, d).withColumn("attempt", F.lit(0))
    late = lambda n, c: first.withColumn("attempt", F.lit(n)).withColumn("raw_response", F.concat(F.lit('{"attributes": {"color": '), c, F.lit(', "viewpoint": " from  above "}}')))
    return first.unionByName(late(1, F.when(C("p_partkey") % 5 == 0, "5").otherwise('"late"'))).unionByName(late(2, F.lit('"too late"')))


_add(
    "extract_job_chain",
    lambda s, d: P.extract_job(_attempts(s, d), "record_id", "attempt", "raw_response", F.array(F.lit("color"), F.lit("viewpoint")), 1, keep_raw=True).select(
        "record_id", "extraction_status", "attempt", "error_message", C("payload")[0]["value"].alias("color"), C("payload")[1]["value"].alias("viewpoint"), F.when(F.coalesce("attempt", F.lit(1)) == 1, C("raw_response")).alias("late_response")
    ),
    f"""{_S}, a as (select record_id, case when p_partkey % 6 < 4 or (p_partkey % 6 = 4 and p_partkey % 4 = 0) then 0 when p_partkey % 5 <> 0 then 1 end attempt, string_split(p_name, ' ')[1] word,
'{{"attributes": {{"color": ' || case when p_partkey % 5 = 0 then '5' else '"late"' end || ', "viewpoint": " from  above "}}}}' as second from samples)
select record_id, case when attempt is null then 'failed' else 'success' end extraction_status, attempt, case when attempt is null then 'number in color' end error_message, case attempt when 0 then word when 1 then 'late' end color,
case attempt when 0 then 'unknown' when 1 then 'from above' end viewpoint, case when coalesce(attempt, 1) = 1 then second end late_response from a""",
)
_add("mock_extract", lambda s, d: samples(s, d).select("record_id", F.explode(P.mock_extract(C("class_name"), E.slot_schema(C("archetype")))).alias("e")).select("record_id", "e.slot", "e.value"), f"with {ATTRIBUTES_SQL} select record_id, slot, case when slot_pos = 0 then lower(class_name) else 'unknown' end as value from attributes")
_add("respond_mock", lambda s, d: P.respond(samples(s, d).select("record_id", "class_name", E.slot_schema(C("archetype")).alias("slot_schema")), "mock").select("record_id", F.get_json_object("raw_response", "$.attributes.viewpoint").alias("v"), F.length("raw_response").alias("n")).select("record_id", "v"), f"{_S} select record_id, 'unknown' v from samples")
_add(
    "respond_table",
    lambda s, d: P.respond(_raw(s, d).select("record_id", F.array(F.lit("color")).alias("slot_schema"), C("raw_response").alias("response")), "table", retries=1).select("record_id", C("error_message").isNull().alias("valid"), "attempts", F.md5("raw_response").alias("raw")),
    f"""{_S}, f as (select record_id, p_partkey % 6 k, p_partkey % 4 = 0 whole, {_BODY} body, {_BULLETS} bullets from samples)
select record_id, k < 4 or (k = 4 and whole) valid, cast(case when k < 4 or (k = 4 and whole) then 1 else 2 end as int) attempts,
  md5(case k when 0 then body when 1 then '```json' || chr(10) || body || chr(10) || '```' when 2 then '[' || body || ', 1]' when 3 then '[' || body || ', {{"archetype": "an' when 4 then bullets else 'no json' end) raw from f""",
)
_add("extraction_stats", lambda s, d: P.extraction_stats(samples(s, d).withColumn("extraction_status", F.when(C("p_partkey") % 9 == 0, "failed").otherwise("success"))), f"{_S} select count(*) total, count(*) filter (p_partkey % 9 <> 0) success, count(*) filter (p_partkey % 9 = 0) failed, count(distinct class_name_raw) classes, array_to_string(list_sort(list(distinct archetype)), ',') archetypes from samples")
_add(
    "classify_with_fallback",
    lambda s, d: P.classify_with_fallback(samples(s, d).withColumn("error", F.when(C("p_partkey") % 10 == 0, "boom")), s.createDataFrame([("animal",), ("weapon",)], "label string"), "archetype", "error", "household_object").groupBy("label", "label_status").agg(F.count("*").alias("n")),
    f"{_S} select case when p_partkey % 10 <> 0 and archetype in ('animal', 'weapon') then archetype else 'household_object' end as label, case when p_partkey % 10 = 0 then 'failed_fallback_error' when archetype not in ('animal', 'weapon') then 'failed_fallback_label' else 'success' end label_status, count(*) n from samples group by all",
)


# rendering
def _records(s, d):
    a = attributes(s, d)
    review = F.array_compact(F.collect_list(F.when((C("p_partkey") + C("slot_pos")) % 17 == 0, C("slot"))))
    return a.groupBy("record_id", "class_name_raw", "archetype", "p_partkey").agg(F.map_from_entries(F.collect_list(F.struct("slot", "raw_value"))).alias("attributes"), review.alias("review"))


def _rendered(s, d):
    return R.render(_records(s, d))


def _rx(c, p):
    return f"regexp_matches({c}, '{p}')"


_in = lambda c, v: f"{c} in ({', '.join(chr(39) + x + chr(39) for x in v)})"
_PERSON, _STORY = r"(?i)\b(person|man|woman|child|children)\b", r"(?i)\b(from|perspective|reflected|showing|set for|with logo|with text|tagged|beachgoers)\b"
_POST = [(a, s) for a in dims.SLOTS for s in dims.TEMPLATES[a][3]]
_PRE = [(a, s) for a in dims.SLOTS for s in dims.TEMPLATES[a][2]]
_place = lambda rows: "case " + " ".join(f"when archetype = '{a}' and slot = '{s}' then {dims.TEMPLATES[a][2 if rows is _PRE else 3].index(s)}" for a, s in rows) + " end"
_WHY = f"""case when v is null then 'unknown_or_empty' when {_rx("v", "[^\\x00-\\x7F]")} then 'non_ascii_noise' when {_rx("v", _PERSON)} then 'person_or_narrative_noise'
 when rev and {_in("slot", R.FOCUS_SLOTS)} and {_in("lo", R.LOW_FOCUS)} then 'review_required_low_value_focus' when {_in("slot", R.FOCUS_SLOTS)} and {_in("lo", R.LOW_FOCUS)} then 'low_value_focus'
 when slot = 'viewpoint' and {_rx("v", _STORY)} then 'narrative_viewpoint' when {_in("slot", R.PLACE_SLOTS)} and {_in("lo", R.LOW_BACKGROUND)} then 'low_value_background' when {_in("slot", R.PLACE_SLOTS)} and {_rx("v", _STORY)} then 'narrative_background'
 when archetype = 'animal' and slot = 'background_or_habitat' and (ends_with(lo, 'side') or ends_with(lo, 'setting')) then 'complex_background' when archetype = 'animal' and slot = 'pose_or_state' and lo = 'stationary' then 'animal_pose_suppressed'
 when {_in("slot", R.STATE_SLOTS)} and lo in ('on', 'off') then 'bare_on_off_state' when {_in("archetype", R.OBJECTS)} and {_in("slot", R.STATE_SLOTS)} and lo = 'inactive' then 'low_value_state'
 when archetype = 'food_and_drink' and slot = 'preparation_or_serving_style' and {_rx("v", _STORY)} then 'food_style_suppressed' when archetype = 'container' and slot = 'fill_state_or_contents_visibility' and lo in ('partially filled with white powder', 'green smoke', 'closed jar', 'empty') then 'container_fill_suppressed'
 when slot in ('body_trait', 'shape_or_structure', 'architectural_style_or_form') and {_in("lo", R.LOW_TRAIT)} then 'low_value_trait' when slot in ('shape_or_structure', 'architectural_style_or_form') and {_rx("v", _STORY)} then 'narrative_shape' end"""
_SHAPED = f"trim(regexp_replace(replace(replace(regexp_replace(replace(v, ',', ' and'), '\\s+and\\s+', ' and ', 'g'), ' and and ', ' and '), '+', ' and '), '\\s+', ' ', 'g'))"
_COLORED = "trim(regexp_replace(replace(replace(v, '+', ' and '), 'yellowish', 'yellow'), '\\s+', ' ', 'g'))"
_VIEW = "case lo " + " ".join(f"when '{k}' then '{v}'" for k, v in R.VIEWS.items()) + " else case when ends_with(lo, 'view') then v else v || ' view' end end"
_WITH = [*R.FOCUS_SLOTS, "held_object_or_equipment", "salient_geographic_feature", "weather_or_water_state"]
_RENDER = f"""with {ATTRIBUTES_SQL},
x as (select *, case when lower({sql_squash("raw_value")}) not in ('unknown', 'not_applicable', 'n/a', 'none', 'null', '') then {sql_squash("raw_value")} end v, (p_partkey + slot_pos) % 17 = 0 rev, {_place(_PRE)} pre, {_place(_POST)} post from attributes),
y as (select *, replace(lower(v), 'ß', 'ss') lo from x), z as (select *, {_WHY} why,
  case when pre is not null then case when {_in("slot", R.SHAPES)} then {_SHAPED} when slot in ('color', 'color_or_pattern') then {_COLORED} else v end
       when slot = 'viewpoint' then {_VIEW} when {_in("slot", R.PLACE_SLOTS)} then 'in ' || v when {_in("slot", _WITH)} then 'with ' || v when slot = 'visible_part' then 'showing ' || v else v end phrase from y),
anchor as (select record_id, archetype, slot, v from z where slot_pos = 0),
parts as (select record_id, string_agg(phrase, ' ' order by pre) filter (pre is not null and why is null) pre_text, string_agg(phrase, ' ' order by post) filter (post is not null and why is null) post_text,
  string_agg(slot, ',' order by pre) filter (pre is not null and why is null) pre_said, string_agg(slot, ',' order by post) filter (post is not null and why is null) post_said,
  string_agg(slot || ':' || why, ',' order by case when pre is not null then pre else 10 + post end) filter ((pre is not null or post is not null) and why is not null) dropped from z group by record_id),
noun as (select record_id, archetype, slot, v, pre_said, post_said, dropped, case when pre_text is null then '' else pre_text || ' ' end || v n, post_text from anchor join parts using (record_id)),
rendered as (select record_id, archetype, case when v is not null then trim(replace(replace(trim(regexp_replace(case when regexp_matches(lower(n), '^[aeiou]') then 'an ' else 'a ' end || n || case when post_text is null then '' else ' ' || post_text end, '\\s+', ' ', 'g')), ' ,', ','), ' .', '.'), ' ,.') end canonical_caption,
  case when v is not null then concat_ws(',', pre_said, slot, post_said) end said, case when v is not null then coalesce(dropped, '') end dropped, case when v is null then 'missing anchor slot: ' || slot end error_message from noun)"""
_flat = lambda df: df.select("record_id", "canonical_caption", F.array_join("verbalized_slots", ",").alias("said"), F.array_join(F.transform("dropped_slots", lambda x: F.concat_ws(":", x, C("drop_reasons")[x])), ",").alias("dropped"))
_add("render_captions", lambda s, d: _flat(_rendered(s, d)), f"{_RENDER} select record_id, canonical_caption, said, dropped from rendered")
_add("render_failures", lambda s, d: _rendered(s, d).filter("render_status = 'failed'").select("record_id", "error_message"), f"{_RENDER} select record_id, error_message from rendered where error_message is not null")
_add("select_value", lambda s, d: attributes(s, d).select("record_id", "slot", R.select_value(C("raw_value")).alias("v")), f"{_RENDER} select record_id, slot, v from z")
_add("drop_rule", lambda s, d: attributes(s, d).select("record_id", "slot", R.drop_reason(C("archetype"), C("slot"), R.select_value(C("raw_value")), (C("p_partkey") + C("slot_pos")) % 17 == 0).alias("why")), f"{_RENDER} select record_id, slot, why from z")
_add(
    "format_post",
    lambda s, d: attributes(s, d).select("record_id", "slot", R.format_post(C("slot"), T.squash(C("raw_value"))).alias("p")),
    f"with {ATTRIBUTES_SQL}, y as (select *, {sql_squash('raw_value')} v, lower({sql_squash('raw_value')}) lo from attributes) select record_id, slot, case when slot = 'viewpoint' then {_VIEW} when {_in('slot', R.PLACE_SLOTS)} then 'in ' || v when {_in('slot', _WITH)} then 'with ' || v when slot = 'visible_part' then 'showing ' || v when slot = 'preparation_or_serving_style' and lo = 'raw' then 'raw' else v end p from y",
)
# every value in every slot that has a rule of its own, those of archetypes without samples too
_SLOTS = ["visible_body_trait", "clothing_or_gear", "color", "color_or_pattern", *R.SHAPES]


def _every_slot(s, d):
    return attributes(s, d).select("record_id", C("slot").alias("own"), F.explode(F.array(*map(F.lit, _SLOTS), C("slot"))).alias("slot"), "raw_value").distinct()


_add(
    "clean_pre_anchor",
    lambda s, d: _every_slot(s, d).select("record_id", "own", "slot", R.clean_pre_anchor(C("slot"), T.squash(C("raw_value"))).alias("p")),
    f"""with {ATTRIBUTES_SQL}, y as (select distinct record_id, slot own, unnest([{", ".join(f"'{x}'" for x in _SLOTS)}, slot]) slot, {sql_squash("raw_value")} v, lower({sql_squash("raw_value")}) lo from attributes)
select record_id, own, slot, nullif(case when slot in ('visible_body_trait', 'clothing_or_gear') then case when {_in("lo", R.WORN_SUPPRESSED)} then null else trim(string_split(v, ',')[1]) end
  when slot in ('color', 'color_or_pattern') then {_COLORED} when {_in("slot", R.SHAPES)} then case when {_in("lo", R.LOW_TRAIT)} then null else {_SHAPED} end else v end, '') p from y""",
)
_add("with_article", lambda s, d: samples(s, d).select("record_id", T.with_article(C("p_name")).alias("a")), f"{_S} select record_id, case when regexp_matches(lower(p_name), '^[aeiou]') then 'an ' else 'a ' end || p_name a from samples")
_add("cleanup_caption", lambda s, d: attributes(s, d).select("record_id", "slot", T.cleanup_caption(F.concat(C("raw_value"), F.lit(" , x . "))).alias("c")), f"with {ATTRIBUTES_SQL} select record_id, slot, trim(replace(replace({sql_squash(chr(40) + 'raw_value || ' + chr(39) + ' , x . ' + chr(39) + chr(41))}, ' ,', ','), ' .', '.'), ' ,.') c from attributes")
_add("slot_review_flag", lambda s, d: _records(s, d).select("record_id", (F.size("review") > 0).alias("flag")), f"with {ATTRIBUTES_SQL} select record_id, bool_or((p_partkey + slot_pos) % 17 = 0) flag from attributes group by record_id")
_add(
    "render_summary",
    lambda s, d: R.render_summary(_rendered(s, d)).withColumn("v", F.round("v", 6)),
    f"""{_RENDER}, q as (select *, canonical_caption is not null ok, len(string_split(said, ',')) n from rendered)
select 'total' kind, 'rows' k, cast(count(*) as double) v from q union all select 'total', 'success', count(*) filter (ok) from q union all select 'total', 'failed', count(*) filter (not ok) from q union all select 'total', 'rate', round(count(*) filter (ok) / count(*), 6) from q
union all select 'total', 'mean_slots', round(avg(n) filter (ok), 6) from q union all select 'archetype', archetype, count(*) from q where ok group by archetype union all select 'template', archetype || '_basic_v1', count(*) from q where ok group by archetype
union all select 'dropped', z.slot, count(*) from z join q using (record_id) where ok and why is not null and (pre is not null or post is not null) group by z.slot""",
)
_add("render_success_filter", lambda s, d: _rendered(s, d).filter("render_status = 'success'").select("record_id"), f"{_RENDER} select record_id from rendered where canonical_caption is not null")
_add("render_resume", lambda s, d: R.render_resume(_records(s, d).withColumn("sample_id", C("record_id")), _rendered(s, d).filter("p_partkey % 2 = 0").withColumn("sample_id", C("record_id"))).select("record_id"), f"{_RENDER} select s.record_id from samples s left join rendered r on r.record_id = s.record_id and p_partkey % 2 = 0 and canonical_caption is not null where r.record_id is null")


# matching
def _captions(s, d):
    b = samples(s, d).filter("p_partkey % 7 <> 0")
    rec = lambda line, rid, sid, rel: b.select(
        line.alias("line_no"), rid.alias("record_id"), sid.alias("sample_id"), rel.alias("relative_image_path"), F.when(C("p_partkey") % 3 == 0, "success").alias("render_status"),
        F.when(C("p_partkey") % 19 != 0, F.concat(F.lit("a "), "p_name")).alias("canonical_caption"), F.when(C("p_partkey") % 5 == 0, "weapon").alias("archetype"), F.when(C("p_partkey") % 2 == 0, "tool").alias("template_family"),
    )
    none = F.lit(None).cast("string")
    k = C("p_partkey")
    base = rec(k * 10, F.when((k % 11 != 0) & (k % 17 != 0), C("record_id")), F.when(k % 17 != 0, F.concat(F.lit("./"), "sample_id")), F.when(k % 17 == 0, C("sample_id")))
    twice = rec(k * 10 + 1, C("record_id"), none, none).filter("line_no % 130 = 1").withColumn("canonical_caption", F.lit("second"))
    extra = rec(k * 10 + 2, F.concat(F.lit("other::"), "sample_id"), none, none).filter("line_no % 290 = 2")
    return base.unionByName(twice).unionByName(extra)


_CAPS = f"""with {SAMPLES_SQL}, b as (select * from samples where p_partkey % 7 <> 0),
caps as (select p_partkey * 10 line_no, case when p_partkey % 11 <> 0 and p_partkey % 17 <> 0 then record_id end record_id, case when p_partkey % 17 <> 0 then sample_id end sample_id, case when p_partkey % 17 = 0 then sample_id end relative_image_path,
   case when p_partkey % 19 <> 0 then 'a ' || p_name end caption, case when p_partkey % 5 = 0 then 'weapon' end archetype, case when p_partkey % 2 = 0 then 'tool' end family from b
 union all select p_partkey * 10 + 1, record_id, null, null, 'second', case when p_partkey % 5 = 0 then 'weapon' end, case when p_partkey % 2 = 0 then 'tool' end from b where (p_partkey * 10 + 1) % 130 = 1
 union all select p_partkey * 10 + 2, 'other::' || sample_id, null, null, case when p_partkey % 19 <> 0 then 'a ' || p_name end, case when p_partkey % 5 = 0 then 'weapon' end, case when p_partkey % 2 = 0 then 'tool' end from b where (p_partkey * 10 + 2) % 290 = 2),
good as (select * from caps where caption is not null),
m as (select s.record_id, s.sample_id, s.class_name_raw, s.archetype, coalesce(a.line_no, c.line_no, e.line_no) line_no, case when a.line_no is not null then 'record_id' when c.line_no is not null then 'sample_id' when e.line_no is not null then 'relative_image_path' end matched_via
 from samples s left join (select record_id, min(line_no) line_no from good group by 1) a on a.record_id = s.record_id left join (select sample_id, min(line_no) line_no from good group by 1) c on c.sample_id = s.sample_id
 left join (select relative_image_path, min(line_no) line_no from good group by 1) e on e.relative_image_path = s.sample_id),
pairs as (select m.*, g.caption, coalesce(g.record_id, g.sample_id, g.relative_image_path) used, coalesce(g.archetype, g.family, m.archetype) effective_archetype, g.family from m join good g using (line_no)),
lost as (select coalesce(record_id, sample_id, relative_image_path) k, line_no from good where coalesce(record_id, sample_id, relative_image_path) not in (select used from pairs))"""
_pair = lambda s, d: M.build_pairs(samples(s, d), _captions(s, d))
_add("priority_match", lambda s, d: M.priority_match(samples(s, d), _captions(s, d)).select("record_id", "matched_via", C("match.line_no").alias("line_no")), f"{_CAPS} select record_id, matched_via, line_no from m")
_add("dedupe_first_wins", lambda s, d: M.dedupe_first_wins(_captions(s, d).filter("canonical_caption is not null"), "record_id").select("record_id", "line_no"), f"{_CAPS} select record_id, min(line_no) line_no from good where record_id is not null group by 1")
_add("load_render_records", lambda s, d: M.dedupe_last_wins(_captions(s, d), "record_id").select("record_id", "line_no"), f"{_CAPS} select record_id, max(line_no) line_no from caps where record_id is not null group by 1")
_add("unmatched_left", lambda s, d: _pair(s, d).unmatched_left.select("record_id", "reason"), f"{_CAPS} select record_id, 'no_matching_render_record' reason from m where line_no is null")
_add("unmatched_right", lambda s, d: _pair(s, d).unmatched_right.select("line_no", "reason"), f"{_CAPS} select line_no, 'no_matching_image' reason from lost")
_add("effective_archetype", lambda s, d: _pair(s, d).pairs.select("record_id", "effective_archetype"), f"{_CAPS} select record_id, effective_archetype from pairs")


def _strict(s, d):
    """Strict matching over the samples that have a record, and those records."""
    p = _pair(s, d)
    known = samples(s, d).join(p.unmatched_left.select("record_id"), "record_id", "left_anti")
    used = _captions(s, d).join(p.unmatched_right.select("line_no"), "line_no", "left_anti")
    return M.build_pairs(known, used, strict=True).pairs.select("record_id", "effective_archetype")


_add("strict_match", _strict, f"{_CAPS} select record_id, effective_archetype from pairs")
_add("pairing_manifest", lambda s, d: manifest(_pair(s, d).pairs).select("record_id", "text", "conditioning_target", "matched_via"), f"{_CAPS} select record_id, caption as text, sample_id conditioning_target, matched_via from pairs")
_add(
    "pairing_summary",
    lambda s, d: M.pairing_summary(_pair(s, d)),
    f"""{_CAPS} select 'class' kind, class_name_raw k, count(*) n from pairs group by all union all select 'archetype', effective_archetype, count(*) from pairs group by all union all select 'dataset_archetype', archetype, count(*) from pairs group by all
union all select 'matched_via', matched_via, count(*) from pairs group by all union all select 'template', family, count(*) from pairs group by all union all select 'total', 'pairs', count(*) from pairs union all select 'total', 'unmatched_left', count(*) from m where line_no is null
union all select 'total', 'unmatched_right', count(*) from lost union all select 'total', 'archetype_mismatch', count(*) from pairs where effective_archetype <> archetype""",
)
_add("resume_anti_join", lambda s, d: M.anti_join(samples(s, d).select("record_id"), samples(s, d).filter("p_partkey % 3 = 0"), "record_id"), f"{_S} select record_id from samples where p_partkey % 3 <> 0")
_add("pair_index", lambda s, d: M.pair_index(_rendered(s, d), "p_partkey").select("idx", "record_id"), f"{_RENDER} select row_number() over (order by record_id) - 1 idx, record_id from rendered where canonical_caption is not null")


def manifest(pairs):
    return pairs.withColumns({"text": C("match.canonical_caption"), "conditioning_text": C("match.canonical_caption"), "image": C("sample_id"), "conditioning_target": C("sample_id")})


# evaluation
def _log(s, d):
    e = table(s, d, "events").select((C("user_id") % 3).alias("seed"), (C("event_id") % 5).alias("run"), "ts", "event_id", C("value").alias("acc1"))
    from pyspark.sql import Window

    return e.withColumn("epoch", F.row_number().over(Window.partitionBy("seed", "run").orderBy("ts", "event_id")) - 1).withColumn("acc5", C("acc1") + 1)


_LOG = "with lg as (select user_id % 3 seed, event_id % 5 run, value acc1, value + 1 acc5, row_number() over (partition by user_id % 3, event_id % 5 order by ts, event_id) - 1 epoch from events)"
_BEST = f"{_LOG}, best as (select seed, run, max(acc1) best_acc1, arg_max(acc5, struct_pack(a := acc1, b := -epoch)) best_acc5, arg_max(epoch, struct_pack(a := acc1, b := -epoch)) best_epoch from lg group by all)"
_add("topk_accuracy", lambda s, d: V.topk_accuracy(table(s, d, "embeddings"), C("embedding"), C("label")), "with t as (select len(list_filter(embedding, lambda x: x > embedding[label + 1])) a from embeddings) select round(100 * avg(cast(a < 1 as int)), 4) top1, round(100 * avg(cast(a < 5 as int)), 4) top5 from t")
_add("weighted_mean", lambda s, d: V.weighted_mean(table(s, d, "lineitem"), ["l_returnflag"], C("l_discount"), C("l_quantity")), "select l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 4) mean, sum(l_quantity) n from lineitem group by all")
_add("best_epoch", lambda s, d: V.best_epoch(_log(s, d), ["seed", "run"]), f"{_BEST} select * from best")
_add("running_best", lambda s, d: V.running_best(_log(s, d), ["seed", "run"]).select("seed", "run", "epoch", "best_acc1"), f"{_LOG} select seed, run, epoch, greatest(0.0, max(acc1) over (partition by seed, run order by epoch)) best_acc1 from lg")
_add("repeat_stats", lambda s, d: V.repeat_stats(V.best_epoch(_log(s, d), ["seed", "run"]), ["seed"]), f"{_BEST} select seed, round(avg(best_acc1), 2) mean_acc1, round(stddev_pop(best_acc1), 2) std_acc1, round(avg(best_acc5), 2) mean_acc5, count(*) runs from best group by seed")
_add("arch_summary", lambda s, d: V.repeat_stats(V.best_epoch(_log(s, d), ["run"]), ["run"]), f"{_LOG} select run, round(max(acc1), 2) mean_acc1, cast(0 as double) std_acc1, round(arg_max(acc5, struct_pack(a := acc1, b := -epoch)), 2) mean_acc5, 1 runs from lg group by run")
_add(
    "seed_protocol",
    lambda s, d: V.seed_protocol(table(s, d, "events").groupBy((C("user_id") % 3).alias("seed"), (C("event_id") % 20).alias("eval_id")).agg(F.max("ts").alias("written_at"), F.array_sort(F.collect_list("value")).alias("best"))),
    "with e as (select user_id % 3 seed, event_id % 20 eval_id, max(ts) w, max(value) best from events group by all), n as (select seed, arg_max(best, struct_pack(a := w, b := eval_id)) best from e group by seed) select count(*) seeds, round(avg(best), 4) mean, round(stddev_pop(best), 4) std, round(min(best), 4) low, round(max(best), 4) high from n",
)
_add("distilled_summary", lambda s, d: V.distilled_summary(samples(s, d)), f"{_S} select class_name_raw, count(*) images from samples group by all")
_add("class_count_check", lambda s, d: V.class_count_check(samples(s, d), 10), f"{_S} select count(distinct class_name_raw) found, 10 declared, count(distinct class_name_raw) <> 10 mismatch from samples")
del _list
