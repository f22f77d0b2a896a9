"""Semi-structured responses: fences, strict JSON, salvage, bullets; then completion, validation and projection of attributes.

Spark's own JSON readers accept trailing text and single quotes, so strict parsing runs Python's json in Arrow batches; the rest is columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import squash, strip_fences, trim


def _first_object(value):
    """A dictionary, or the first one of a list."""
    if isinstance(value, list):
        value = next((v for v in value if isinstance(v, dict)), None)
        if value is None:
            raise ValueError("no object in the list")
    if not isinstance(value, dict):
        raise ValueError(f"expected an object, got {type(value).__name__}")
    return value


def _strict(text: str | None) -> tuple[str | None, str | None, bool]:
    """(payload, error, whether the text was no JSON at all)."""
    if text is None:
        return None, "no text", False
    try:
        value = json.loads(text)
    except ValueError as e:
        return None, str(e), True
    try:
        return json.dumps(_first_object(value), ensure_ascii=False), None, False
    except ValueError as e:
        return None, str(e), False


def balanced_object(text: str) -> str | None:
    """The first {..} whose braces close outside of strings; scanned by json's own decoder rules for strings."""
    start = text.find("{")
    depth, quoted, k = 0, False, start
    while start >= 0 and k < len(text):
        c = text[k]
        if c == "\\" and quoted:
            k += 1
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[start : k + 1]
        k += 1
    return None


def _strict_batch(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_strict(t) for t in texts], columns=["payload", "error", "broken"])


def _salvage_batch(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        found = balanced_object(t or "")
        rows.append((found, *(_strict(found)[:2] if found is not None else (None, None))))
    return pd.DataFrame(rows, columns=["found", "payload", "error"])


def parse_strict(text: Column | str) -> Column:
    """struct(payload, error, broken): JSON text of the object or of a list's first object; broken if the text is no JSON."""
    return F.pandas_udf(_strict_batch, "payload string, error string, broken boolean")(text)


def salvage_object(text: Column | str) -> Column:
    """struct(found, payload, error): the first object whose braces close, and what it parses to."""
    return F.pandas_udf(_salvage_batch, "found string, payload string, error string")(text)


def parse_bullets(text: Column) -> Column:
    """struct(archetype, attributes map, error) from `- key: value` lines in an attributes block."""
    archetype = F.regexp_extract(text, r'"archetype"\s*:\s*"([^"]+)"', 1)
    block = F.regexp_extract(text, r'(?s)"attributes"\s*:\s*\{(.*?)\}', 1)
    has_block = text.rlike(r'(?s)"attributes"\s*:\s*\{.*?\}')
    lines = F.filter(F.transform(F.split(block, r"\r\n|\n|\r"), lambda x: F.regexp_replace(trim(x), ",+$", "")), lambda x: x != "")
    rx = r"^-\s*([A-Za-z0-9_]+)\s*:\s*(.+)$"
    entries = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, rx, 1).alias("key"), F.btrim(trim(F.regexp_extract(x, rx, 2)), F.lit('"')).alias("value")))
    last = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))
    error = F.when(archetype == "", "missing archetype").when(~has_block, "missing attributes block").when(F.exists(lines, lambda x: ~x.rlike(rx)), "unsupported attribute line")
    return F.struct(archetype.alias("archetype"), F.when(error.isNull(), last).alias("attributes"), error.alias("error"))


_HEAD, _BLOCK = re.compile(r'"archetype"\s*:\s*"([^"]+)"'), re.compile(r'"attributes"\s*:\s*\{(.*?)\}', re.DOTALL)
_LINE = re.compile(r"-\s*([A-Za-z0-9_]+)\s*:\s*(.+)$")


def bullet_object(text: str) -> tuple[str | None, str | None]:
    """parse_bullets of one text: (payload, error)."""
    head, block = _HEAD.search(text), _BLOCK.search(text)
    if not head:
        return None, "missing archetype"
    if not block:
        return None, "missing attributes block"
    found = {}
    for line in re.split(r"\r\n|\n|\r", block[1]):
        line = line.strip().rstrip(",")
        if not line:
            continue
        m = _LINE.match(line)
        if not m:
            return None, "unsupported attribute line"
        found[m[1]] = m[2].strip().strip('"')
    return json.dumps({"archetype": head[1], "attributes": found}, ensure_ascii=False), None


def parsed(text: str | None) -> tuple[str, str | None, str | None]:
    """(method, payload, error) of one text without fences: strict JSON; if that is no JSON, the first object that closes; if none does, bullets."""
    payload, error, broken = _strict(text)
    if not broken:
        return ("failed" if error else "strict"), payload, error
    found = balanced_object(text)
    if found is not None:
        payload, error, _ = _strict(found)
        return ("failed" if error else "salvage"), payload, error
    payload, error = bullet_object(text)
    return ("failed" if error else "bullets"), payload, error


def _parsed_batch(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parsed(t) for t in texts], columns=["method", "payload", "error"])


def parse_response(df: DataFrame, raw: str) -> DataFrame:
    """df plus parse_method (strict, salvage, bullets, failed), payload (JSON text) and parse_error, in one pass over the texts: see `parsed`."""
    made = df.withColumn("_p", F.pandas_udf(_parsed_batch, "method string, payload string, error string")(strip_fences(F.col(raw))))
    return made.select(*df.columns, F.col("_p.method").alias("parse_method"), F.col("_p.payload").alias("payload"), F.col("_p.error").alias("parse_error"))


def extract_attributes(payload: Column) -> Column:
    """JSON text of payload.attributes where that key is present (null value too), else of the payload."""
    keys = F.json_object_keys(payload)
    return F.when(F.array_contains(keys, "attributes"), F.coalesce(F.get_json_object(payload, "$.attributes"), F.lit("null"))).otherwise(payload)


def complete_missing(attributes: Column, expected: Column) -> Column:
    """Map of attributes with 'unknown' for the expected slots it lacks."""
    gone = F.array_except(expected, F.map_keys(attributes))
    return F.map_concat(F.map_from_arrays(gone, F.transform(gone, lambda _: F.lit("unknown"))), attributes)


def validate_payload(attributes: Column, expected: Column) -> Column:
    """Errors of JSON text attributes against expected slots, in their order, joined by '; '; empty if there is none. A slot holds a text
    that isn't blank, or null; numbers, booleans, lists and objects are errors that name the kind."""
    keys = F.json_object_keys(attributes)
    values = F.transform_values(F.from_json(attributes, "map<string,variant>"), lambda _, v: F.struct(F.schema_of_variant(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("text")))

    def error(s: Column) -> Column:
        x = F.try_element_at(values, s)
        kind = F.when(x["kind"].startswith("ARRAY"), "list").when(x["kind"].startswith("OBJECT"), "object").when(x["kind"] == "BOOLEAN", "boolean").otherwise("number")
        return (
            F.when(~F.array_contains(keys, s), F.concat(F.lit("missing "), s))
            .when(x.isNull() | x["kind"].isNull() | (x["kind"] == "VOID"), F.lit(None).cast("string"))
            .when(x["kind"] != "STRING", F.concat(kind, F.lit(" in "), s))
            .when(trim(x["text"]) == "", F.concat(F.lit("empty "), s))
        )

    return F.when(keys.isNull(), "attributes must be an object").otherwise(F.array_join(F.array_compact(F.transform(expected, error)), "; "))


def project_attributes(attributes: Column, expected: Column) -> Column:
    """Expected slots in order as entries, squashed; absent ones unknown, blank ones unknown, null stays null."""
    has = lambda s: F.map_contains_key(attributes, s)
    one = lambda s: F.when(~has(s), "unknown").when(squash(attributes[s]) == "", "unknown").otherwise(squash(attributes[s]))
    return F.transform(expected, lambda s: F.struct(s.alias("slot"), one(s).alias("value")))


def first_valid_attempt(attempts: DataFrame, key: str, attempt: str, valid: str, payload: str, error: str, retries: int, raw: str | None = None) -> DataFrame:
    """One row a key from its first retries + 1 attempts: the first valid one, else the last error. raw: a column that is kept as
    raw_response, of the same attempt."""
    ok = F.col(valid)
    g = attempts.filter(F.col(attempt) <= retries).groupBy(key)
    texts = [F.min_by(F.when(ok, F.col(raw)), F.when(ok, F.col(attempt))).alias("_first"), F.max_by(raw, attempt).alias("_last")] if raw else []
    out = g.agg(F.min_by(F.when(ok, F.col(payload)), F.when(ok, F.col(attempt))).alias("payload"), F.max_by(error, attempt).alias("_e"), F.min(F.when(ok, F.col(attempt))).alias("attempt"), F.bool_or(ok).alias("_ok"), *texts)
    kept = [F.when(F.col("_ok"), F.col("_first")).otherwise(F.col("_last")).alias("raw_response")] if raw else []
    return out.select(key, F.when(F.col("_ok"), "success").otherwise("failed").alias("extraction_status"), "payload", F.when(~F.col("_ok"), F.col("_e")).alias("error_message"), "attempt", *kept)


def extract_job(attempts: DataFrame, key: str, attempt: str, raw: str, expected: Column, retries: int, keep_raw: bool = False) -> DataFrame:
    """attempts (key, attempt, raw, what expected needs) -> first_valid_attempt's row a key, payload: expected slots with their values. An
    attempt is valid if its text parses and no expected slot holds a wrong value; absent slots are unknown. keep_raw adds raw_response."""
    rows = attempts.filter(F.col(attempt) <= retries).select(key, attempt, raw, expected.alias("_slots"))
    rows = parse_response(rows, raw).withColumn("_body", extract_attributes(F.col("payload")))
    present = F.coalesce(F.array_intersect("_slots", F.json_object_keys("_body")), F.array().cast("array<string>"))
    rows = rows.withColumn("_error", F.coalesce("parse_error", F.nullif(validate_payload(F.col("_body"), present), F.lit("")))).withColumn("_ok", F.col("_error").isNull())
    rows = rows.withColumn("_made", F.when(F.col("_ok"), project_attributes(F.from_json("_body", "map<string,string>"), F.col("_slots"))))
    return first_valid_attempt(rows, key, attempt, "_ok", "_made", "_error", retries, raw if keep_raw else None)


def mock_extract(class_name: Column, schema: Column) -> Column:
    return F.transform(schema, lambda s, i: F.struct(s.alias("slot"), F.when(i == 0, F.lower(trim(class_name))).otherwise("unknown").alias("value")))


def extraction_stats(rows: DataFrame) -> DataFrame:
    ok = F.col("extraction_status") == "success"
    return rows.agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"), F.count_distinct("class_name_raw").alias("classes"), F.array_join(F.array_sort(F.collect_set("archetype")), ",").alias("archetypes"))


def classify_with_fallback(rows: DataFrame, allowed: DataFrame, predicted: str, error: str, fallback: str) -> DataFrame:
    """rows plus label and label_status: the prediction where allowed (label; a small table), else the fallback."""
    a = allowed.select(F.col("label").alias("_l")).distinct()
    out = rows.join(a, F.col(predicted) == F.col("_l"), "left")
    status = F.when(F.col(error).isNotNull(), "failed_fallback_error").when(F.col("_l").isNull(), "failed_fallback_label").otherwise("success")
    return out.withColumn("label_status", status).withColumn("label", F.when(status == "success", F.col(predicted)).otherwise(fallback)).drop("_l")


class Registry:
    """Responders by name: functions over batches of pandas frames that add raw_response and error_message. A model is loaded once a
    Python worker, where its function first runs."""

    def __init__(self):
        self.known: dict[str, object] = {}

    def add(self, name: str, make) -> None:
        self.known[name] = make

    def create(self, name: str):
        if name not in self.known:
            raise ValueError(f"unknown backend {name}; known: {', '.join(sorted(self.known))}")
        made = self.known[name]
        if made is None:
            raise NotImplementedError(f"backend {name} has no implementation here")
        return made


def _mock(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        made = [json.dumps({"attributes": {s: (str(c).strip().lower() if i == 0 else "unknown") for i, s in enumerate(slots)}}, ensure_ascii=False) for c, slots in zip(b["class_name"], b["slot_schema"], strict=True)]
        yield b.assign(raw_response=made, error_message=pd.Series([None] * len(b), dtype=object, index=b.index))


def _table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(raw_response=b["response"], error_message=pd.Series([None] * len(b), dtype=object, index=b.index))


RESPONDERS = Registry()
RESPONDERS.add("mock", _mock)
RESPONDERS.add("table", _table)


def wrong_values(payload: str, slots) -> str | None:
    """Errors of a parsed payload against the expected slots, as validate_payload tells them; absent slots are none."""
    body = json.loads(payload)
    body = body["attributes"] if "attributes" in body else body
    if not isinstance(body, dict):
        return "attributes must be an object"
    kind = lambda v: "list" if isinstance(v, list) else "object" if isinstance(v, dict) else "boolean" if isinstance(v, bool) else "number"
    found = [f"{kind(v)} in {s}" if not isinstance(v, str) else f"empty {s}" for s in slots if (v := body.get(s)) is not None and not (isinstance(v, str) and v.strip())]
    return "; ".join(found) or None


_FENCES = (re.compile(r"^\s*```(?:json)?\s*", re.IGNORECASE), re.compile(r"\s*```\s*$"))


def response_error(raw: str | None, slots) -> str | None:
    """Why a response is no valid answer for a sample with these slots; null if it is one."""
    if raw is None:
        return "no text"
    _, payload, error = parsed(_FENCES[1].sub("", _FENCES[0].sub("", raw.strip())).strip())
    return error or wrong_values(payload, slots)


def respond(samples: DataFrame, backend: str, retries: int = 0) -> DataFrame:
    """samples (with slot_schema, if retries > 0) plus raw_response, error_message and, with retries, attempts.

    Answers come from the backend's responder, a function over batches that gives a frame for each it takes. With retries, rows of a batch whose answer is an
    error, doesn't parse or holds a wrong value go round again by themselves, `retries` times at most, and the last error and raw text are kept. The
    responder runs on in its worker, so a model is loaded once however often rows go round.
    """
    responder = RESPONDERS.create(backend)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema) + ", raw_response string, error_message string"
    if not retries:
        return samples.mapInPandas(responder, kinds)

    def rounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []

        def feed() -> Iterator[pd.DataFrame]:
            while waiting:
                yield waiting.pop()

        answers = None
        for b in batches:
            b = b.reset_index(drop=True)
            out, left = None, b
            for attempt in range(1, retries + 2):
                waiting.append(left)
                answers = answers or responder(feed())
                got = next(answers).assign(attempts=attempt)
                got.index = left.index
                told = [e if isinstance(e, str) else response_error(r if isinstance(r, str) else None, s) for e, r, s in zip(got["error_message"], got["raw_response"], got["slot_schema"], strict=True)]
                got["error_message"] = pd.Series(told, dtype=object, index=got.index)
                out = got if out is None else pd.concat([out.drop(left.index), got])
                left = b.loc[got.index[got["error_message"].notna()]]
                if not len(left):
                    break
            yield out.sort_index()

    return samples.mapInPandas(rounds, f"{kinds}, attempts int")
