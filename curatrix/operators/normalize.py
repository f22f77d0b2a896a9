"""Attribute normalization: a table-driven rule engine on the long form (one row a record and slot).

Every step is a ladder of (condition, new value, new status, rule tag); the first condition that holds acts, and a value that a step has
mapped to unknown is left alone by the later ones. Ladders are written once, as SQL, and become one CASE a step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import dims
from curatrix.functions.text import clean_value

UNKNOWN = "mapped_to_unknown"
Rung = tuple[str, str, str, str]


# Base words and singulars of the rules.
BASE_MATERIALS = (("metallic", "metal"), ("wooden", "wood"))
BASE_COLORS = (("grey", "gray"), ("golden", "gold"))
SINGULARS = (("golf balls", "golf ball"), ("crosses", "cross"), ("towers", "tower"))


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(col: str, values) -> str:
    return f"{col} in ({', '.join(map(q, values))})" if values else "false"


class Spark:
    """Spellings that differ between SQL engines."""

    def matches(self, col: str, pattern: str) -> str:
        return f"{col} rlike {q(pattern)}".replace("\\", "\\\\")

    starts = "startswith({}, {})"

    def pieces(self, col: str) -> str:
        return f"filter(transform(split({col}, ','), x -> trim(x)), x -> x <> '')"

    def first_piece(self, col: str) -> str:
        return f"trim(split({col}, ',')[0])"

    def joined(self, col: str, drop, base: bool) -> str:
        known = f"filter({self.pieces(col)}, x -> not ({among('x', drop)}))"
        return f"array_sort(array_distinct(transform({known}, x -> case x when 'metallic' then 'metal' when 'wooden' then 'wood' else x end)))" if base else f"array_sort(array_distinct({known}))"

    size, plus, at, tags = "size({})", "array_join({}, '+')", "{}[{}]", "array_compact(array({}))"

    def family(self, name: str) -> str:
        return f"(_families & {1 << list(dims.FAMILIES).index(name)}) <> 0"

    def mapped(self, cond: str, col: str, table: dict[str, str], tag: str) -> list[Rung]:
        """The rungs of a table as one: a hashed set of its keys decides, the map is only read where it acts."""
        pairs = ", ".join(f"{q(k)}, {q(x)}" for k, x in table.items())
        return [(f"{cond} and {among(col, table)}", f"element_at(map({pairs}), {col})", "canonicalized", q(tag))] if table else []


def families() -> str:
    """The slot's families as bits, so that rungs ask for them without comparing texts again."""
    return " | ".join(f"case when {among('slot', slots)} then {1 << i} else 0 end" for i, slots in enumerate(dims.FAMILIES.values()))


def steps(d, rules: dict | None = None, types: list[str] | None = None) -> list[tuple[str, list[Rung]]]:
    """The ladders in their order. d: spellings; types: slots whose value is taken from the class name (default: all anchors)."""
    r, v, _family = rules or dims.RULES, "value", d.family
    anchors = dims.TYPE_SLOTS if types is None else types

    def mapped(family: str, tag: str, table: dict[str, str]) -> list[Rung]:
        return d.mapped(_family(family), v, {k: x for k, x in table.items() if k != x}, tag)

    def unknown(cond: str, tag: str) -> Rung:
        return cond, "'unknown'", UNKNOWN, tag

    has = lambda markers: "(" + " or ".join(f"contains({v}, {q(m)})" for m in markers) + ")" if markers else "false"
    starts = lambda p: d.starts.format(v, q(p))
    slot_maps, seen = [], "false"
    for family in ("viewpoint", "state", "shape", "part", "background"):  # one family a slot, in this order
        slot_maps += [(f"not ({seen}) and {c}", x, s, t) for c, x, s, t in mapped(family, f"slot.{family}.canonicalize", r[family])]
        seen += f" or {_family(family)}"
    two = d.pieces(v)
    first, second = d.at.format(two, d_first := 0 if isinstance(d, Spark) else 1), d.at.format(two, d_first + 1)
    compound = v
    for sep in (" and ", "/"):
        compound = f"replace({compound}, {q(sep)}, ',')"
    materials, colors = d.joined(compound, r["unknown_like"], True), d.joined(compound, [], False)
    many = lambda arr: f"{d.size.format(arr)} >= 2"
    short = f"case when class_name is null then '' else {d.first_piece('class_clean')} end"
    is_material, is_color = _family("material"), f"not ({_family('material')}) and {_family('color')}"
    is_type = f"not ({_family('material')} or {_family('color')}) and {_family('type')}"
    plain_type = f"{is_type} and not ({among('slot', anchors)})"
    return [
        ("unknown_like", [unknown(among(v, r["unknown_like"]), q("global.placeholder_to_unknown"))]),
        ("low_value_contamination", [
            unknown(f"{_family('background')} and {among(v, r['background_colors'])}", q("slot.background.low_value_to_unknown")),
            unknown(f"{_family('person_to_unknown')} and ({among(v, r['person_phrases'])} or {has(r['person_markers'])})", q("slot.person_contamination_to_unknown")),
        ]),
        ("render_awareness", [
            unknown(f"{_family('non_ascii_to_unknown')} and {d.matches(v, '[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')}", "concat('slot.', slot, '.non_ascii_to_unknown')"),
            *[unknown(f"{_family('background')} and {v} = {q(k)}", q("slot.background.low_value_to_unknown")) for k, x in r["background_phrases"].items() if x == "unknown"],
            *mapped("background", "slot.background.canonicalize", {k: x for k, x in r["background_phrases"].items() if x != "unknown"}),
            unknown(f"{_family('background')} and {among(v, r['low_value_background'])}", q("slot.background.low_value_to_unknown")),
            *mapped("state", "slot.state.canonicalize", r["state_phrases"]),
            (f"{_family('state')} and {among(v, r['low_value_state'])}", v, "", q("slot.state.low_value_preserved")),
            (f"{_family('shape')} and {among(v, r['low_value_shape'])}", v, "", q("slot.shape.low_value_preserved")),
            unknown(f"{_family('part')} and {among(v, r['low_value_part'])}", q("slot.part.low_value_to_unknown")),
        ]),
        ("archetype_unknown", [unknown(f"archetype = {q(a)} and slot = {q(s)} and {among(v, vs)}", q(f"archetype.{a}.{s}.to_unknown")) for (a, s), vs in r["archetype_unknown"].items()]),
        ("apply_slot_map", slot_maps),
        ("mixed_state", [(f"{_family('state')} and contains({v}, ',') and {d.size.format(two)} = 2 and {among(first, r['mixed_state_primary'])} and length({second}) <= 32 and not {d.matches(second, '[0-9]')}", first, "canonicalized", q("slot.state.primary_clause"))]),
        ("state_pattern", [
            (f"{_family('state')} and ({starts('held')} or {starts('being held')})", "'being held'", "canonicalized", q("slot.state.held_family")),
            (f"{_family('state')} and ({starts('powered on')} or {v} = 'active')", "'on'", "canonicalized", q("slot.state.on_family")),
            (f"{_family('state')} and ({starts('powered off')} or {v} = 'inactive')", "'off'", "canonicalized", q("slot.state.off_family")),
        ]),
        ("normalize_material", [
            *d.mapped(is_material, v, dict(BASE_MATERIALS), "slot.material.base_material"),
            (f"{is_material} and (contains({v}, ' and ') or contains({v}, '/') or contains({v}, ',')) and {many(materials)}", d.plus.format(materials), "canonicalized", q("slot.material.separator_unify")),
        ]),
        ("normalize_color", [
            *d.mapped(is_color, v, dict(BASE_COLORS), "slot.color.base_color"),
            (f"{is_color} and (contains({v}, ' and ') or contains({v}, ',')) and {many(colors)}", d.plus.format(colors), "canonicalized", q("slot.color.separator_unify")),
        ]),
        ("normalize_type", [
            (f"{is_type} and {among('slot', anchors)} and {short} not in ('', {v})", short, "canonicalized", q("slot.anchor_type.from_class_name_first_item")),
            *d.mapped(plain_type, v, {k: x for k, x in r["type"].items() if k != x}, "slot.type.canonicalize"),
            *d.mapped(plain_type, v, dict(SINGULARS), "slot.type.singularize"),
        ]),
    ]


def reason_tags(d, rules: dict | None = None) -> str:
    """The six detectors as one array, in order."""
    r, v, _family = rules or dims.RULES, "value", d.family
    has = lambda markers: "(" + " or ".join(f"contains({v}, {q(m)})" for m in markers) + ")"
    anchor = " or ".join(f"(archetype = {q(a)} and slot = {q(s)} and {among(v, vs)})" for (a, s), vs in r["archetype_review"].items()) or "false"
    found = [
        (anchor, "review.archetype_anchor_mismatch"),
        (f"({_family('part')} or {_family('state')}) and {has(r['person_markers'])}", "review.person_mention"),
        (f"{_family('background')} and {among(v, r['background_colors'])}", "review.slot_contamination"),
        (f"{_family('viewpoint')} and {d.matches(v, '[0-9]')}", "review.misplaced_spec_text"),
        (f"length({v}) > 40 and {has(r['narrative_markers'])}", "review.narrative_value"),
        (f"{_family('state')} and contains({v}, ',')", "review.mixed_state"),
    ]
    return d.tags.format(", ".join(f"case when {c} then {q(t)} end" for c, t in found))


def case(rungs: list[Rung], part: int, otherwise: str) -> str:
    """One output of a ladder: 1 value, 2 status ('' keeps it), 3 tag."""
    if not rungs:
        return otherwise
    out = lambda r: (q(r[2]) if r[2] else "status") if part == 2 else r[part]
    return "case " + " ".join(f"when {r[0]} then {out(r)}" for r in rungs) + f" else {otherwise} end"


def begin(long: DataFrame) -> DataFrame:
    """long (archetype, slot, class_name, raw_value, ..) plus cleaned, value, status, rules. The class name is only cleaned for anchors."""
    out = long.withColumn("cleaned", clean_value(F.col("raw_value"))).withColumn("_families", F.expr(families()))
    out = out.withColumn("class_clean", F.when(F.expr(Spark().family("type")), clean_value(F.col("class_name"))))
    return out.withColumns({"value": F.col("cleaned"), "status": F.lit("unchanged"), "rules": F.array().cast("array<string>")})


def apply_step(df: DataFrame, name: str, rules: dict | None = None, types: list[str] | None = None) -> DataFrame:
    """One ladder over value, status and rules: its conditions are looked at once and give the number of the rung that acts."""
    rungs = dict(steps(Spark(), rules, types))[name]
    rung = f"case when status = '{UNKNOWN}' then -1 " + " ".join(f"when {r[0]} then {i}" for i, r in enumerate(rungs)) + " else -1 end"
    # out of a generator of one row, which compiles to a method of its own; one with a lambda would be interpreted as a whole
    at = df.withColumn("_rung", F.expr(rung)) if "->" in rung else df.select("*", F.expr(f"inline(array(struct({rung} as _rung)))"))
    pick = lambda part, otherwise: F.expr(case([(f"_rung = {i}", *r[1:]) for i, r in enumerate(rungs)], part, otherwise))
    tag = F.when(F.col("_rung") >= 0, F.concat("rules", F.array(pick(3, "cast(null as string)")))).otherwise(F.col("rules"))
    return at.withColumns({"value": pick(1, "value"), "status": pick(2, "status"), "rules": tag}).drop("_rung")


def settle(df: DataFrame, columns: list[str]) -> DataFrame:
    """Give columns out of a generator of one row, so that filters on them don't repeat the expressions they come from."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns))))


def detect_reasons(df: DataFrame, rules: dict | None = None) -> DataFrame:
    """Reasons, unless the value is unknown by then; any makes the status review_required and follows the rules, sorted."""
    found = F.when(F.col("status") != UNKNOWN, F.expr(reason_tags(Spark(), rules))).otherwise(F.array().cast("array<string>"))
    out = df.withColumn("reasons", found)
    any_ = F.size("reasons") > 0
    once = F.when(F.size("rules") > 1, F.array_distinct("rules")).otherwise(F.col("rules"))
    rules_ = F.when(any_, F.array_distinct(F.concat("rules", F.array_sort(F.array_distinct("reasons"))))).otherwise(once)
    return out.withColumns({"status": F.when(any_, "review_required").otherwise(F.col("status")), "rules": rules_})


def field_result(df: DataFrame) -> DataFrame:
    changed = F.col("status").isin("canonicalized", "class_inferred", UNKNOWN, "review_required") | (F.col("value") != F.col("cleaned"))
    return df.withColumn("changed", changed).withColumn("reasons", F.array_distinct("reasons"))


def normalize_fields(long: DataFrame, rules: dict | None = None, types: list[str] | None = None) -> DataFrame:
    """All steps for every row of long, on its own: no shuffle, so it also runs on a stream."""
    df = begin(long)
    for name, _ in steps(Spark(), rules, types):
        df = apply_step(df, name, rules, types)
    out = field_result(detect_reasons(df, rules)).drop("class_clean", "_families")
    return settle(out, ["cleaned", "value", "status", "rules", "reasons", "changed"])


def _tokens(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1)), lambda t: F.length(t) >= 3)


def consistency_review(fields: DataFrame) -> DataFrame:
    """Cross-slot checks of food, buildings and weapons: a window over the record gives each row the slots that they compare, so fields are
    worked out and shuffled once. Findings follow the row's reasons and rules; a row without a record id has none."""
    looked_at = {
        "food_and_drink": ["food_or_drink_type", "shape_or_structure", "container_or_context"],
        "structure_or_building": ["structure_or_building_type", "architectural_style_or_form"],
        "weapon": ["weapon_type", "background_or_context"],
    }
    record, name = Window.partitionBy("record_id"), "_of_{}".format
    of = {name(s): F.max(F.when((F.col("archetype") == a) & (F.col("slot") == s), F.col("value"))).over(record) for a, slots in looked_at.items() for s in slots}
    wide = fields.withColumns(of)
    at = lambda s: F.coalesce(F.col(name(s)), F.lit(""))
    known = lambda s: ~at(s).isin("", "unknown")
    meets = lambda s, words: F.arrays_overlap(_tokens(at(s)), F.array(*map(F.lit, words)))
    same = lambda a, b: at(a) == at(b)
    food, shape, box, kind, style, gun, back = (s for slots in looked_at.values() for s in slots)
    conflict, drift, mixed, near = "review.cross_slot_value_conflict", "review.food_anchor_context_drift", "review.structure_type_style_conflict", "review.weapon_anchor_related_object"
    found = {  # by slot, reasons in their order
        food: [(conflict, known(food) & (same(food, shape) | same(food, box))), (drift, known(food) & meets(food, dims.VESSELS))],
        box: [(drift, known(food) & same(food, box))],
        kind: [(conflict, known(kind) & same(kind, style)), (mixed, known(kind) & meets(kind, dims.STYLES))],
        style: [(conflict, known(kind) & same(kind, style)), (mixed, known(style) & meets(style, dims.BUILDINGS))],
        gun: [(conflict, known(gun) & same(gun, back)), (near, known(gun) & meets(gun, dims.NEAR_WEAPONS))],
        back: [(near, known(gun) & same(gun, back))],
    }
    more = F.when(F.col("record_id").isNull(), None)
    for slot, checks in found.items():
        more = more.when(F.col("slot") == slot, F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in checks])))
    out = wide.withColumn("more", more).drop(*of)
    any_ = F.coalesce(F.size("more") > 0, F.lit(False))
    both = lambda c: F.when(any_, F.array_distinct(F.concat(c, "more"))).otherwise(F.col(c))
    changed = F.col("changed") | any_
    return out.withColumns({"status": F.when(any_, "review_required").otherwise(F.col("status")), "rules": both("rules"), "reasons": both("reasons"), "changed": changed}).drop("more")


def review_priority(slot: Column, reasons: Column, status: Column) -> Column:
    """Weight of the slot plus those of the reasons (20 for one without); 10 more if review is required without a reason."""
    by = lambda table, key: F.coalesce(*[F.when(key == k, w) for k, w in table.items()])
    base = F.coalesce(by(dims.SLOT_WEIGHTS, slot), F.lit(0)) + F.when((F.size(reasons) == 0) & (status == "review_required"), 10).otherwise(0)
    return F.aggregate(reasons, base.cast("int"), lambda a, r: a + F.coalesce(by(dims.REASON_WEIGHTS, r), F.lit(20)))


def flagged() -> Column:
    return (F.col("status") == "review_required") | (F.size("reasons") > 0)


def normalize_attributes(long: DataFrame, rules: dict | None = None) -> DataFrame:
    """Long table of every record and slot, normalized, with cross-slot findings and review priority (0 if not flagged)."""
    out = consistency_review(normalize_fields(long, rules))
    return out.withColumn("review_priority", F.when(flagged(), review_priority(F.col("slot"), F.col("reasons"), F.col("status"))).otherwise(0))


def to_records(fields: DataFrame) -> DataFrame:
    """One row a record: normalized_attributes, attribute_normalization, normalization_review_required."""
    meta = F.struct(F.col("raw_value"), F.col("value").alias("normalized_value"), "status", F.col("rules").alias("applied_rules"), F.col("reasons").alias("review_reasons"))
    rows = F.array_sort(F.collect_list(F.struct("slot_pos", "slot", "value", meta.alias("meta"))))
    g = fields.groupBy("record_id", "archetype", "class_name", "class_name_raw").agg(rows.alias("r"), F.bool_or(flagged()).alias("normalization_review_required"))
    pairs = lambda f: F.map_from_entries(F.transform("r", lambda x: F.struct(x["slot"], x[f])))
    return g.select("record_id", "archetype", "class_name", "class_name_raw", pairs("value").alias("normalized_attributes"), pairs("meta").alias("attribute_normalization"), "normalization_review_required")


def audit(fields: DataFrame) -> DataFrame:
    return fields.filter(F.col("changed") | flagged())


def review_queue(fields: DataFrame) -> DataFrame:
    return fields.filter(flagged())


def normalization_summary(fields: DataFrame) -> DataFrame:
    """(kind, a, b, n): counts by status, by slot and status, by class and status, by rule and by reason, in one pass over fields."""
    key = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast("string").alias("a"), b.cast("string").alias("b"))
    none, status = F.lit(None), F.col("status")
    whole = F.array(key("status", none, status), key("slot", F.col("slot"), status), key("class", F.col("class_name_raw"), status))
    rules, reasons = F.transform("rules", lambda x: key("rule", x, none)), F.transform("reasons", lambda x: key("reason", x, none))
    return fields.select(F.inline(F.concat(whole, rules, reasons))).groupBy("kind", "a", "b").agg(F.count("*").alias("n"))
