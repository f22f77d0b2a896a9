"""Queries of the normalization operators, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import dims
from curatrix.functions.text import clean_key, clean_value
from curatrix.operators import normalize as N
from curatrix.operators import review as R
from curatrix.plans.bindings import ATTRIBUTES_SQL, attributes, sql_clean
from curatrix.session import written


class Duck:
    """Spellings of DuckDB."""

    def matches(self, col: str, pattern: str) -> str:
        return f"regexp_matches({col}, {N.q(pattern)})"

    starts = "starts_with({}, {})"

    def pieces(self, col: str) -> str:
        return f"list_filter(list_transform(string_split({col}, ','), lambda x: trim(x)), lambda x: x <> '')"

    def first_piece(self, col: str) -> str:
        return f"trim(string_split({col}, ',')[1])"

    def joined(self, col: str, drop, base: bool) -> str:
        known = f"list_filter({self.pieces(col)}, lambda x: not ({N.among('x', drop)}))"
        return f"list_sort(list_distinct(list_transform({known}, lambda x: case x when 'metallic' then 'metal' when 'wooden' then 'wood' else x end)))" if base else f"list_sort(list_distinct({known}))"

    size, plus, at, tags = "len({})", "array_to_string({}, '+')", "{}[{}]", "list_filter([{}], lambda x: x is not null)"

    def family(self, name: str) -> str:
        return N.among("slot", dims.FAMILIES[name])

    def mapped(self, cond: str, col: str, table: dict[str, str], tag: str) -> list[N.Rung]:
        return [(f"{cond} and {col} = {N.q(k)}", N.q(x), "canonicalized", N.q(tag)) for k, x in table.items()]


def _chain() -> tuple[str, str]:
    """CTEs of all steps, and the name of the last."""
    out = f"""with {ATTRIBUTES_SQL},
n_0 as (select *, {sql_clean("raw_value")} as cleaned, {sql_clean("class_name")} class_clean, {sql_clean("raw_value")} as value, 'unchanged' status, cast([] as varchar[]) rules from attributes)"""
    name = "n_0"
    for step, rungs in N.steps(Duck()):
        live = [(f"status <> '{N.UNKNOWN}' and ({c})", v, s, t) for c, v, s, t in rungs]
        out += f""",
s_{step} as materialized (select * exclude (value, status, rules), {N.case(live, 1, "value")} as value, {N.case(live, 2, "status")} as status,
  case when {N.case(live, 3, "cast(null as varchar)")} is null then rules else list_append(rules, {N.case(live, 3, "cast(null as varchar)")}) end rules from {name})"""
        name = f"s_{step}"
    out += f""",
r_0 as (select *, case when status <> '{N.UNKNOWN}' then {N.reason_tags(Duck())} else cast([] as varchar[]) end reasons from {name}),
fields as materialized (select * exclude (status, rules), case when len(reasons) > 0 then 'review_required' else status end status,
  list_concat(rules, list_sort(reasons)) rules, len(reasons) > 0 or status <> 'unchanged' or value <> cleaned changed from r_0)"""
    return out, name


CHAIN, _ = _chain()


def _tok(c: str, words: list[str]) -> str:
    return f"len(list_intersect(list_filter(regexp_extract_all(lower({c}), '[a-z]+'), lambda t: length(t) >= 3), [{', '.join(map(N.q, words))}])) > 0"


def _weights(table: dict[str, int], key: str, default: int) -> str:
    return f"case {key} " + " ".join(f"when {N.q(k)} then {w}" for k, w in table.items()) + f" else {default} end"


FULL = f"""{CHAIN},
wide as (select record_id, archetype, {", ".join(f"coalesce(max(case when slot = '{s}' then value end), '') {s}" for s in ("food_or_drink_type", "shape_or_structure", "container_or_context", "structure_or_building_type", "architectural_style_or_form", "weapon_type", "background_or_context"))} from fields group by all),
adds as (
  select record_id, 'food_or_drink_type' slot, 'review.food_anchor_context_drift' reason from wide where archetype = 'food_and_drink' and food_or_drink_type not in ('', 'unknown') and {_tok("food_or_drink_type", dims.VESSELS)}
  union all select record_id, 'food_or_drink_type', 'review.cross_slot_value_conflict' from wide where archetype = 'food_and_drink' and food_or_drink_type not in ('', 'unknown') and food_or_drink_type in (shape_or_structure, container_or_context)
  union all select record_id, 'container_or_context', 'review.food_anchor_context_drift' from wide where archetype = 'food_and_drink' and food_or_drink_type not in ('', 'unknown') and food_or_drink_type = container_or_context
  union all select record_id, 'architectural_style_or_form', 'review.structure_type_style_conflict' from wide where archetype = 'structure_or_building' and architectural_style_or_form not in ('', 'unknown') and {_tok("architectural_style_or_form", dims.BUILDINGS)}
  union all select record_id, 'structure_or_building_type', 'review.structure_type_style_conflict' from wide where archetype = 'structure_or_building' and structure_or_building_type not in ('', 'unknown') and {_tok("structure_or_building_type", dims.STYLES)}
  union all select record_id, unnest(['structure_or_building_type', 'architectural_style_or_form']), 'review.cross_slot_value_conflict' from wide where archetype = 'structure_or_building' and structure_or_building_type not in ('', 'unknown') and structure_or_building_type = architectural_style_or_form
  union all select record_id, 'weapon_type', 'review.weapon_anchor_related_object' from wide where archetype = 'weapon' and weapon_type not in ('', 'unknown') and {_tok("weapon_type", dims.NEAR_WEAPONS)}
  union all select record_id, 'weapon_type', 'review.cross_slot_value_conflict' from wide where archetype = 'weapon' and weapon_type not in ('', 'unknown') and weapon_type = background_or_context
  union all select record_id, 'background_or_context', 'review.weapon_anchor_related_object' from wide where archetype = 'weapon' and weapon_type not in ('', 'unknown') and weapon_type = background_or_context),
more as (select record_id, slot, list_sort(list(reason)) more from adds group by all),
reviewed as materialized (select f.* exclude (status, rules, reasons, changed), case when more is null then status else 'review_required' end status, list_concat(rules, coalesce(more, [])) rules,
  list_concat(reasons, coalesce(more, [])) reasons, changed or more is not null changed from fields f left join more using (record_id, slot)),
scored as materialized (select *, case when status = 'review_required' or len(reasons) > 0 then {_weights(dims.SLOT_WEIGHTS, "slot", 0)} + coalesce(list_sum(list_transform(reasons, lambda r: {_weights(dims.REASON_WEIGHTS, "r", 20)})), 0) else 0 end review_priority from reviewed)"""
_ROW = "record_id, slot, value, status, array_to_string(rules, '|') rules, array_to_string(reasons, '|') reasons"


def _row(df, *more):
    return df.select("record_id", "slot", "value", "status", F.array_join("rules", "|").alias("rules"), F.array_join("reasons", "|").alias("reasons"), *more)


def _step(name):
    def run(spark, sf):
        df = N.begin(attributes(spark, sf))
        for step, _ in N.steps(N.Spark()):
            df = N.apply_step(df, step)
            if step == name:
                break
        df = N.settle(df, ["value", "status", "rules"])
        return df.filter("size(rules) > 0").select("record_id", "slot", "value", "status", F.array_join("rules", "|").alias("rules"))

    return run, f"{CHAIN} select record_id, slot, value, status, array_to_string(rules, '|') rules from s_{name} where len(rules) > 0"


def _full(spark, sf):
    return N.normalize_attributes(attributes(spark, sf))


QUERIES, SQL = {}, {}


def _add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


_add("clean_value", lambda s, d: attributes(s, d).select("record_id", "slot", clean_value(F.col("raw_value")).alias("value")), f"with {ATTRIBUTES_SQL} select record_id, slot, {sql_clean('raw_value')} as value from attributes")
_add("clean_key", lambda s, d: attributes(s, d).select("record_id", "slot", clean_key(F.col("raw_value")).alias("k")), f"with {ATTRIBUTES_SQL} select record_id, slot, regexp_replace(replace(lower(trim(coalesce(raw_value, ''))), '_', ' '), '\\s+', ' ', 'g') k from attributes")
for _name, _ in N.steps(N.Spark()):
    _add(_name, *_step(_name))
_add("review_reasons", lambda s, d: _row(N.normalize_fields(attributes(s, d))).filter("reasons <> ''"), f"{CHAIN} select {_ROW} from fields where len(reasons) > 0")
_add("field_result", lambda s, d: N.normalize_fields(attributes(s, d)).select("record_id", "slot", "cleaned", "value", "changed"), f"{CHAIN} select record_id, slot, cleaned, value, changed from fields")
_add("consistency_review", lambda s, d: _row(N.consistency_review(N.normalize_fields(attributes(s, d)))), f"{FULL} select {_ROW} from reviewed")
_add("review_priority", lambda s, d: _full(s, d).select("record_id", "slot", F.col("review_priority").cast("int").alias("review_priority")), f"{FULL} select record_id, slot, cast(review_priority as int) review_priority from scored")
_add(
    "normalize_attributes",
    lambda s, d: N.to_records(_full(s, d)).select("record_id", F.array_join(F.transform(F.array_sort(F.map_entries("normalized_attributes")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("attrs"), "normalization_review_required"),
    f"{FULL} select record_id, string_agg(slot || '=' || value, ';' order by slot) attrs, bool_or(status = 'review_required' or len(reasons) > 0) normalization_review_required from reviewed group by record_id",
)
_add("normalization_audit", lambda s, d: _row(N.audit(_full(s, d)), F.col("review_priority").cast("int").alias("review_priority")), f"{FULL} select {_ROW}, cast(review_priority as int) review_priority from scored where changed or status = 'review_required' or len(reasons) > 0")
_add("review_queue", lambda s, d: _row(N.review_queue(_full(s, d))), f"{FULL} select {_ROW} from scored where status = 'review_required' or len(reasons) > 0")
_add(
    "normalization_summary",
    lambda s, d: N.normalization_summary(_full(s, d)),
    f"""{FULL} select 'status' kind, null a, status b, count(*) n from scored group by all union all select 'slot', slot, status, count(*) from scored group by all
union all select 'class', class_name_raw, status, count(*) from scored group by all union all select 'rule', a, null, count(*) from (select unnest(rules) a from scored) group by all
union all select 'reason', a, null, count(*) from (select unnest(reasons) a from scored) group by all""",
)
_ITEMS = f"""{FULL},
items as (select *, status = 'review_required' or len(reasons) > 0 flag from scored where status in ('review_required', '{N.UNKNOWN}') or len(reasons) > 0),
ranked as (select record_id, p_partkey, slot, case when flag then reasons else list_append(reasons, '{dims.RECOVERY}') end reasons, case when flag then review_priority else 0 end sort_priority,
  row_number() over (partition by record_id order by case when flag then review_priority else 0 end desc, slot) rnk from items)"""
_add("select_review_items", lambda s, d: R.review_items(_full(s, d)).select("record_id", "slot", F.array_join("reasons", "|").alias("reasons"), F.col("rank").cast("int").alias("rnk")), f"{_ITEMS} select record_id, slot, array_to_string(reasons, '|') reasons, cast(rnk as int) rnk from ranked")
_add("review_limit", lambda s, d: R.review_limit(R.review_items(_full(s, d)), 200, "p_partkey").select("record_id", "slot"), f"{_ITEMS} select record_id, slot from ranked order by p_partkey, rnk limit 200")


# Decisions of a reviewer stand in for model output: a fixed mix of actions and confidences.
def _decisions(s, d, full=None):
    items = R.review_items(_full(s, d) if full is None else full)
    k = F.col("p_partkey") + F.length("slot")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (k % len(v) + 1).cast("int"))
    payload = F.struct(
        pick("replace_normalized", "set_unknown", "keep_normalized", "nonsense", None, "defer", "replace_normalized").alias("action"),
        pick("fine value", None, " other ", "").alias("reviewed_value"),
        pick("High", "medium", "low", None, "sure").alias("confidence"),
        F.when(k % 11 == 0, "other").alias("archetype"),
        F.when(k % 13 == 0, "other").alias("slot"),
        F.lit(None).cast("boolean").alias("needs_manual_followup"),
        pick("seen", None).alias("reason"),
    )
    return items.withColumn("payload", payload)


_K = "(p_partkey + length(slot))"
_PICK = lambda vs: f"[{', '.join('null' if v is None else N.q(v) for v in vs)}][1 + {_K} % {len(vs)}]"
_DECIDED = f"""{_ITEMS},
p as (select r.*, s.archetype, s.value as value, coalesce({_PICK(["replace_normalized", "set_unknown", "keep_normalized", "nonsense", None, "defer", "replace_normalized"])}, 'defer') a0,
  coalesce(trim({_PICK(["fine value", None, " other ", ""])}), '') v0, coalesce(lower({_PICK(["High", "medium", "low", None, "sure"])}), 'low') c0, {_K} % 11 = 0 or {_K} % 13 = 0 broken from ranked r join (select record_id, slot, archetype, value from scored) s using (record_id, slot)),
a as (select *, case when a0 in ('replace_normalized', 'set_unknown', 'keep_normalized', 'defer') then a0 else 'defer' end a1, case when c0 in ('high', 'medium', 'low') then c0 else 'low' end c1 from p),
decided as (select *, case when broken then 'defer' else a1 end as action, case when broken then 'low' else c1 end confidence,
  case when broken or a1 = 'keep_normalized' then value when a1 = 'set_unknown' then 'unknown' when v0 = '' then case when a1 = 'defer' then value else 'unknown' end else v0 end reviewed_value from a),
applied as (select *, list_contains(reasons, '{dims.RECOVERY}') recovery, len(list_intersect(reasons, [{", ".join(map(N.q, dims.SEVERE))}])) > 0 severe from decided),
policy as (select *, case when action = 'replace_normalized' then recovery or confidence in ('high', 'medium') when action = 'set_unknown' then confidence = 'high' or severe else false end applied,
  case when action = 'replace_normalized' and recovery then 'accepted_replace_unknown_recovery' when action = 'replace_normalized' and confidence in ('high', 'medium') then 'accepted_replace'
       when action = 'replace_normalized' then 'rejected_low_confidence_replace' when action = 'set_unknown' and (confidence = 'high' or severe) then 'accepted_set_unknown'
       when action = 'set_unknown' then 'rejected_low_confidence_set_unknown' else 'not_applicable' end application_reason from applied)"""
_add("mock_review", lambda s, d: R.mock_review(R.review_items(_full(s, d))).select("record_id", "slot", "action", "reviewed_value", "confidence"), f"{_ITEMS} select record_id, slot, 'keep_normalized' as action, s.value reviewed_value, 'medium' confidence from ranked join scored s using (record_id, slot)")
_add("parse_review_payload", lambda s, d: R.parse_payload(_decisions(s, d)).select("record_id", "slot", "action", "reviewed_value", "confidence", "needs_manual_followup"), f"{_DECIDED} select record_id, slot, action, reviewed_value, confidence, a1 = 'defer' and a0 is not null and (case when a0 in ('replace_normalized','set_unknown','keep_normalized','defer') then a0 else 'defer' end) = 'defer' or broken needs_manual_followup from decided")
_add("apply_policy", lambda s, d: R.apply_policy(R.parse_payload(_decisions(s, d))).select("record_id", "slot", "applied", "application_reason"), f"{_DECIDED} select record_id, slot, applied, application_reason from policy")


def _apply_review(s, d):
    full = written(_full(s, d), "normalized")
    return R.apply_review(full, R.apply_policy(R.parse_payload(_decisions(s, d, full)))).select("record_id", "slot", "effective_value", "review_status")


_add(
    "apply_review",
    _apply_review,
    f"{_DECIDED} select s.record_id, s.slot, case when p.applied then p.reviewed_value else s.value end effective_value, case when max(p.slot) over (partition by s.record_id) is null then 'not_needed' else 'completed' end review_status from scored s left join policy p using (record_id, slot)",
)
_add(
    "review_summary",
    lambda s, d: R.review_summary(R.apply_policy(R.parse_payload(_decisions(s, d)))),
    f"{_DECIDED} select 'action' kind, action k, count(*) n from policy group by all union all select 'reason', k, count(*) from (select unnest(reasons) k from policy) group by all union all select 'applied', cast(applied as varchar), count(*) from policy group by all",
)
_add(
    "coerce_review_input",
    lambda s, d: R.coerce_input(attributes(s, d).selectExpr("record_id", "case when slot_pos < 2 then sample_id end sample_id", "case when slot_pos <> 1 then class_name end class_name", "case slot_pos when 0 then '12' when 1 then 'x' end class_id")),
    f"with {ATTRIBUTES_SQL} select coalesce(case when slot_pos < 2 then sample_id end, record_id, '') sample_id, coalesce(case when slot_pos <> 1 then class_name end, '') class_name, case when slot_pos = 0 then 12 else 0 end class_id from attributes",
)
