"""Queries of the incremental operators: a table is fed in several drops and must end as if it had come at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.operators import match as M
from curatrix.operators import render as R
from curatrix.operators.enrich import taxonomy_prompt as taxonomy_prompts
from curatrix.plans import curation
from curatrix.plans.bindings import ATTRIBUTES_SQL, attributes, samples
from curatrix.plans.normalization import CHAIN
from curatrix.session import shared_folder, table
from curatrix.sources import files
from curatrix.streaming import incremental as I

QUERIES, SQL = {}, {}
C = F.col


_SOURCE = "record_id string, class_name_raw string, archetype string, p_partkey long, attempt int"


def _folder(spark) -> str:
    return shared_folder(spark, "incremental")


def _extract(rows):
    failed = (F.col("p_partkey") % 5 == 0) & (F.col("attempt") == 0)
    return rows.withColumn("extraction_status", F.when(failed, "failed").otherwise("success"))


def extract_incremental(s, d):
    """Two drops: the second repeats all rows with a higher attempt, so what failed is tried again and nothing else is."""
    at = _folder(s)
    rows = samples(s, d).select("record_id", "class_name_raw", "archetype", "p_partkey")
    for attempt in (0, 1):
        rows.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(f"{at}/in")
        I.run_incremental(s, f"{at}/in", _SOURCE, f"{at}/out", f"{at}/cp", _extract, "record_id", "extraction_status", I.counted_stats, f"{at}/stats", by=("class_name_raw", "archetype"), order=("attempt",))
    out = I.read_sink(s, f"{at}/out", _extract(rows.withColumn("attempt", F.lit(0))).schema)
    return I.latest(out, "record_id").select("record_id", "extraction_status", "attempt")


def running_stats(s, d):
    """After two drops, a third of the rows and then all of them, which mends the first's failures: the counts must have been carried on."""
    at = _folder(s)
    rows = samples(s, d).select("record_id", "class_name_raw", "archetype", "p_partkey")
    for attempt in (0, 1):
        rows.filter(C("p_partkey") % 3 <= 2 * attempt).withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(f"{at}/in")
        I.run_incremental(s, f"{at}/in", _SOURCE, f"{at}/out", f"{at}/cp", _extract, "record_id", "extraction_status", I.counted_stats, f"{at}/stats", by=("class_name_raw", "archetype"), order=("attempt",))
    return I.read_current(s, f"{at}/stats")


def normalize_stream(s, d):
    at = _folder(s)
    rows = attributes(s, d)
    rows.write.parquet(f"{at}/in")
    I.normalize_stream(s, f"{at}/in", rows.schema, f"{at}/out", f"{at}/cp")
    return s.read.parquet(f"{at}/out").select("record_id", "slot", "value", "status")


def atomic_replace(s, d):
    at = _folder(s)
    rows = samples(s, d).select("record_id", "archetype")
    I.replace_atomically(rows.limit(1), f"{at}/t")
    I.replace_atomically(rows, f"{at}/t")
    return I.read_current(s, f"{at}/t")


def read_jsonl(s, d):
    """What write_jsonl writes, read_jsonl reads: null values stay. Each seventh row's line is damaged as well, in one of three ways, and
    comes back as an error with its number in the file."""
    at = _folder(s)
    rows = attributes(s, d).select("record_id", "slot", "raw_value")
    files.write_jsonl(rows, f"{at}/rows")
    lines = s.read.text(f"{at}/rows").select("value", F.pmod(F.crc32(F.col("value").cast("binary")), F.lit(21)).alias("k"))
    damaged = F.when(C("k") == 0, F.replace("value", F.lit('"'), F.lit("'"))).when(C("k") == 7, F.concat("value", F.lit(' junk {"slot": "x"}'))).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    lines.filter("k % 7 = 0").select(damaged.alias("value")).write.text(f"{at}/bad")
    kind = "record_id string, slot string, raw_value string"
    good = files.read_jsonl(s, f"{at}/rows", kind)[0]
    some, errors = files.read_jsonl(s, f"{at}/bad", kind, strict=False)
    numbered = errors.groupBy("file").agg(F.count("*").alias("n"), F.max("line_no").alias("last"), F.count_distinct("line_no").alias("different"))
    wrong = some.unionByName(numbered.filter("n <> last or n <> different").select(F.lit("numbers").alias("record_id"), C("file").alias("slot"), C("n").cast("string").alias("raw_value")))
    return good.unionByName(wrong)  # damaged lines that were read, or misnumbered ones, would be rows too many


def append_jsonl(s, d):
    """A second drop is appended to the first."""
    at = _folder(s)
    rows = table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    files.write_jsonl(rows.filter("c_custkey % 2 = 0"), f"{at}/rows")
    files.write_jsonl(rows.filter("c_custkey % 2 = 1"), f"{at}/rows", append=True)
    return files.read_jsonl(s, f"{at}/rows", "c_custkey long, c_name string, c_mktsegment string")[0]


def scan_labeled_files(s, d):
    """One file a brand in a folder of its own: classes are numbered by folder name."""
    at = _folder(s)
    samples(s, d).select(F.regexp_replace("class_name_raw", "#", "_").alias("cls"), "record_id").repartition("cls").write.partitionBy("cls").parquet(f"{at}/set")
    return files.scan_labeled_files(s, f"{at}/set", ("parquet",)).groupBy("class_name_raw", "class_id").agg(F.count("*").alias("n"))


def write_summary(s, d):
    at = _folder(s)
    files.write_summary(table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")), f"{at}/summary")
    return s.read.schema("l_returnflag string, n long, quantity double").json(f"{at}/summary")


def _text(rows, path):
    rows.coalesce(1).write.text(path)
    return path


def load_string_map(s, d):
    """A map of nations to regions, written as one JSON object."""
    named = table(s, d, "nation").join(table(s, d, "region"), C("n_regionkey") == C("r_regionkey"))
    one = named.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", "r_name")))).alias("value"))
    return files.load_string_map(s, _text(one, f"{_folder(s)}/map"))


def _taxonomy(s, d):
    """Regions as archetypes that include their nations, in order of name."""
    g = table(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("includes"))
    g = table(s, d, "region").join(g, C("n_regionkey") == C("r_regionkey"))
    one = F.struct(C("r_name").alias("name"), F.concat(F.lit("region "), "r_name").alias("definition"), "includes", F.array(F.lit("sea")).alias("excludes"))
    path = _text(g.agg(F.to_json(F.struct(F.collect_list(one).alias("archetypes"))).alias("value")), f"{_folder(s)}/taxonomy")
    return files.load_taxonomy(s, path)


def load_taxonomy(s, d):
    return _taxonomy(s, d).select("name", "definition", F.array_join("includes", ",").alias("includes"), F.size(F.coalesce("notes", F.array())).alias("notes"))


def taxonomy_prompt(s, d):
    return taxonomy_prompts(_taxonomy(s, d)).select("name", "prompt")


def load_rules(s, d):
    """Two sections: a map of part types to their number of parts, a list of market segments."""
    types = table(s, d, "part").groupBy("p_type").agg(F.count("*").cast("string").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("p_type", "n"))).alias("type"))
    segments = table(s, d, "customer").agg(F.collect_set("c_mktsegment").alias("segment"))
    one = types.join(F.broadcast(segments)).select(F.to_json(F.struct("type", "segment")).alias("value"))
    return files.load_rules(s, _text(one, f"{_folder(s)}/rules"))


def write_pairing_artifacts(s, d):
    """The artifacts' row counts, from what was written."""
    at = _folder(s)
    files.write_pairing(curation._pair(s, d), at)
    count = lambda n: s.read.text(f"{at}/{n}").agg(F.count("*").alias("n")).select(F.lit(n).alias("artifact"), "n")
    return count("train_manifest").unionByName(count("unmatched_images")).unionByName(count("unmatched_render_records"))


def render_incremental(s, d):
    """Two drops of records, rendered as they come; rows rendered before aren't rendered again."""
    at = _folder(s)
    rows = curation._records(s, d).withColumn("sample_id", F.col("record_id"))
    done = R.render(rows.filter("p_partkey % 2 = 0"))
    done.write.parquet(f"{at}/batch=0")
    rest = R.render_resume(rows, s.read.parquet(f"{at}/batch=0"))
    R.render(rest).write.parquet(f"{at}/batch=1")
    return I.latest(s.read.option("basePath", at).parquet(at), "record_id").select("record_id", "render_status", "canonical_caption")


def _image(kind, w, h):
    """An image file that is all header: PNG, BMP, lossless WebP or JPEG, of w x h (16 bits each)."""
    hex4 = lambda x: F.lpad(F.hex(x), 4, "0")
    low = lambda x: F.concat(F.substring(hex4(x), 3, 2), F.substring(hex4(x), 1, 2))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D494844520000"), hex4(w), F.lit("0000"), hex4(h), F.lit("0802000000"))
    bmp = F.concat(F.lit("424D" + "00" * 12 + "28000000"), low(w), F.lit("0000"), low(h), F.lit("0000010018000000"))
    webp = F.concat(F.lit("52494646000000005745425056503858" + "0A000000" + "00000000"), low(w - 1), F.lit("00"), low(h - 1), F.lit("00"))
    jpeg = F.concat(F.lit("FFD8FFE00010" + "4A46494600010100000100010000" + "FFFFDB0004" + "C0FF" + "FFC2001108"), hex4(h), hex4(w), F.lit("03" + "00" * 9 + "FFD9"))
    return F.unhex(F.when(kind == 0, png).when(kind == 1, bmp).when(kind == 2, webp).otherwise(jpeg))


def _pictures(s, d):
    """(sample_id, class_name_raw, content): an image a supplier, of its own size; every 50th is damaged."""
    key = C("s_suppkey")
    content = _image(key % 4, (key * 7 % 3000 + 1).cast("int"), (key * 13 % 2000 + 1).cast("int"))
    rel = F.concat(F.lit("n"), "s_nationkey", F.lit("/"), "s_name", F.element_at(F.array(*map(F.lit, (".png", ".bmp", ".webp", ".JPG"))), (key % 4 + 1).cast("int")))
    return table(s, d, "supplier").select("s_suppkey", F.replace(rel, F.lit("#"), F.lit("_")).alias("sample_id"), F.concat(F.lit("n"), "s_nationkey").alias("class_name_raw"), F.when(key % 50 == 49, F.lit("no image").cast("binary")).otherwise(content).alias("content"))


def image_size(s, d):
    at = _folder(s)
    written_files(_pictures(s, d), at)
    found = files.image_size(s, at)
    return found.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("sample_id"), "width", "height", C("error").isNotNull().alias("broken"))


def written_files(pictures, at):
    from curatrix.sources.blobs import write_files

    write_files(pictures.select(F.concat(F.lit(f"{at}/"), "sample_id").alias("target"), "content")).write.format("noop").mode("overwrite").save()


def materialize_training_set(s, d):
    """The metadata of copied images, read back, with the size of each copy and what the summary says."""
    at = _folder(s)
    rows = _pictures(s, d)
    written_files(rows, f"{at}/from")
    path = F.concat(F.lit(f"{at}/from/"), "sample_id")
    pairs = rows.select(path.alias("image_path"), F.concat(F.lit("picture "), "s_suppkey").alias("canonical_caption"), F.concat(F.lit("p"), "s_suppkey").alias("pair_id"), F.concat_ws("::", "class_name_raw", "sample_id").alias("record_id"), "sample_id", C("sample_id").alias("relative_image_path"), F.lit(None).cast("string").alias("class_name"), "class_name_raw", F.lit("tool").alias("archetype"))
    summary = files.materialize_training_set(pairs, f"{at}/to")
    made = s.read.schema("file_name string, text string, pair_id string, record_id string, sample_id string, relative_image_path string, class_name string, class_name_raw string, archetype string").json(f"{at}/to/metadata.jsonl")
    copies = s.read.format("binaryFile").load(f"{at}/to/images").select(F.concat(F.lit("images/"), F.element_at(F.split("path", "/"), -1)).alias("file_name"), "length")
    facts = summary.select("num_examples", F.size("copied_file_samples").alias("shown"), "truncated_copied_file_samples")
    return made.join(copies, "file_name", "left").join(facts, F.lit(True))


def pair_index_files(s, d):
    """Images that are there lie at the id's path; every fourth isn't and is found by its sample_id, or kept as it is without one."""
    rows = samples(s, d).select("record_id", F.when(C("p_partkey") % 8 != 0, F.concat(F.lit("alt/"), "sample_id")).alias("sample_id"), C("p_name").alias("canonical_caption"), "archetype", F.when(C("p_partkey") % 5 == 0, "failed").otherwise("success").alias("render_status"), C("p_partkey").alias("line_no"))
    there = samples(s, d).filter("p_partkey % 4 <> 0").select("sample_id")
    return M.pair_index(rows, inventory=there, root="/data")


QUERIES = {"image_size": image_size, "materialize_training_set": materialize_training_set, "pair_index_files": pair_index_files, "read_jsonl": read_jsonl, "write_pairing_artifacts": write_pairing_artifacts, "render_incremental": render_incremental, "extract_incremental": extract_incremental, "running_stats": running_stats, "normalize_stream": normalize_stream, "atomic_replace": atomic_replace,
    "append_jsonl": append_jsonl, "scan_labeled_files": scan_labeled_files, "write_summary": write_summary, "load_string_map": load_string_map, "load_taxonomy": load_taxonomy, "taxonomy_prompt": taxonomy_prompt, "load_rules": load_rules}
_S = "with " + ATTRIBUTES_SQL
_PICTURES = """pictures as (select s_suppkey k, 'n' || s_nationkey class_name_raw, 'n' || s_nationkey || '/' || replace(s_name, '#', '_') || ['.png', '.bmp', '.webp', '.JPG'][1 + s_suppkey % 4] sample_id from supplier)"""
SQL = {
    "image_size": f"with {_PICTURES} select sample_id, cast(case when k % 50 <> 49 then k * 7 % 3000 + 1 end as int) width, cast(case when k % 50 <> 49 then k * 13 % 2000 + 1 end as int) height, k % 50 = 49 broken from pictures",
    "materialize_training_set": f"""with {_PICTURES} select printf('images/%06d_', cast(row_number() over (order by class_name_raw || '::' || sample_id) - 1 as int)) || replace(sample_id, '/', '__') as file_name, 'picture ' || k as text, 'p' || k pair_id, class_name_raw || '::' || sample_id record_id,
sample_id, sample_id relative_image_path, '' class_name, class_name_raw, 'tool' archetype, cast(case when k % 50 = 49 then 8 else [29, 32, 30, 48][1 + k % 4] end as bigint) as length, count(*) over () num_examples, cast(least(20, count(*) over ()) as int) shown, count(*) over () > 20 truncated_copied_file_samples from pictures""",
    "pair_index_files": f"""{_S} select row_number() over (order by record_id) - 1 idx, record_id, '/data/' || case when p_partkey % 4 = 0 and p_partkey % 8 <> 0 then 'alt/' else '' end || sample_id image_path, p_name canonical_caption, class_name_raw class_name, class_name_raw, cast(0 as int) class_id, archetype from samples where p_partkey % 5 <> 0""",
    "read_jsonl": f"{_S} select record_id, slot, raw_value from attributes",
    "write_pairing_artifacts": f"{curation._CAPS} select 'train_manifest' artifact, count(*) n from pairs union all select 'unmatched_images', count(*) from m where line_no is null union all select 'unmatched_render_records', count(*) from lost",
    "render_incremental": f"{curation._RENDER} select record_id, case when canonical_caption is null then 'failed' else 'success' end render_status, canonical_caption from rendered",
    "extract_incremental": f"{_S} select record_id, 'success' extraction_status, cast(p_partkey % 5 = 0 as int) attempt from samples",
    "running_stats": f"{_S} select count(*) total, count(*) success, cast(0 as bigint) failed, count(distinct class_name_raw) classes, array_to_string(list_sort(list(distinct archetype)), ',') archetypes from samples",
    "normalize_stream": f"{CHAIN} select record_id, slot, value, status from fields",
    "append_jsonl": "select c_custkey, c_name, c_mktsegment from customer",
    "scan_labeled_files": f"{_S} select 'cls=' || replace(class_name_raw, '#', '_') class_name_raw, cast(row_number() over (order by class_name_raw) - 1 as int) class_id, cast(1 as bigint) n from samples group by class_name_raw",
    "write_summary": "select l_returnflag, count(*) n, sum(l_quantity) quantity from lineitem group by 1",
    "load_string_map": "select n_name as key, r_name as value from nation join region on n_regionkey = r_regionkey",
    "load_taxonomy": "select r_name as name, 'region ' || r_name definition, string_agg(n_name, ',' order by n_name) includes, 0 notes from nation join region on n_regionkey = r_regionkey group by r_name",
    "taxonomy_prompt": "select r_name as name, r_name || ': region ' || r_name || chr(10) || 'includes: ' || array_to_string(list(n_name order by n_name)[1:4], ', ') || chr(10) || 'excludes: sea' || chr(10) || 'notes: ' prompt from nation join region on n_regionkey = r_regionkey group by r_name",
    "load_rules": "select 'type' section, lower(p_type) as key, cast(count(*) as varchar) as value from part group by p_type union all select distinct 'segment', lower(c_mktsegment), null from customer",
    "atomic_replace": f"{_S} select record_id, archetype from samples",
}
