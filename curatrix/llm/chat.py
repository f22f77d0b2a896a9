"""Operator 12: chat formatting as relational work: Spark expressions only.

A conversation's turns are collected as structs, sorted, cut into runs of one role with array functions and put together as one string:
`<turn>role<text>text<more>text</turn>`, where `<more>` parts the texts of adjacent turns of a role. Control strings inside roles and texts get one
more backslash after their `<`, which is taken off again on reading, so a formatted conversation gives back its rows exactly. The loss mask is a
list of spans of code points of the output, one a text of the trained roles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import table

#: Words of the control strings.
OPEN, SAYS, MORE, CLOSE = "<turn>", "<text>", "<more>", "</turn>"
CONTROL = r"(/?turn|text|more)>"
#: Lengths whose sums are taken together, so that offsets in very long conversations cost about turns^1.5 additions.
STRIDE = 64
#: Code points of an output that are cut off at a time to be looked into.
CHUNK = 2048


@dataclass(frozen=True)
class Chat:
    """Roles whose texts the loss covers."""

    trained: tuple[str, ...] = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"<(\\*){CONTROL}", r"<$1\\$2>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"<\\(\\*){CONTROL}", "<$1$2>")


def _held(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """df's columns `keep` and those made, through a generator of one row: else an expression would be written into every lambda that names its column,
    and be worked out again for each element."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))))


def _offsets(df: DataFrame, keep: list[str], lengths: str, out: str) -> DataFrame:
    """df plus out: for each place of the array `lengths`, the sum of all before it. Sums of strides are taken once."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    strides = F.transform(F.sequence(F.lit(0), F.ceil(F.size(lengths) / STRIDE).cast("int") - 1), lambda b: total(F.slice(lengths, b * STRIDE + 1, F.lit(STRIDE))))
    df = _held(df, [*keep, lengths], _strides=strides)
    df = _held(df, [*keep, lengths], _before=F.transform("_strides", lambda x, b: total(F.slice("_strides", F.lit(1), b))))
    inside = lambda i: total(F.slice(lengths, i - i % STRIDE + 1, i % STRIDE))
    return _held(df, keep, **{out: F.transform(lengths, lambda x, i: F.get("_before", F.floor(i / STRIDE).cast("int")) + inside(i))})


def format_chats(rows: DataFrame, chat: Chat = Chat()) -> DataFrame:
    """(conv_id, formatted, spans array<struct<start, end>>, merged): a row a conversation of rows (conv_id, turn, role, text).

    Turns stand in order of turn, then role, then text, so ties and repeated rows keep a defined order and all their rows. Adjacent turns of one role are
    merged into one marked turn (merged: how many are left). Null texts and roles are empty; null turns come first; a null conv_id is a conversation; an
    empty table gives no rows; other columns are dropped. spans: code points [start, end) of formatted that are texts (still escaped) of trained roles. One
    conversation is one row of the output, so its turns meet in one task; they are shuffled as partial lists.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    df = rows.groupBy("conv_id").agg(F.collect_list(turn).alias("turns"))
    df = _held(df, ["conv_id"], turns=F.array_sort("turns"))
    role = lambda i: F.get("turns", i)["role"]
    df = _held(df, ["conv_id", "turns"], starts=F.filter(F.transform("turns", lambda t, i: F.when((i == 0) | (role(i - 1) != t["role"]), i)), lambda i: i.isNotNull()))
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.size("turns"))
    run = lambda s, k: F.struct(role(s).alias("role"), F.transform(F.slice("turns", s + 1, end(k) - s), lambda t: escape(t["text"])).alias("texts"))
    df = _held(df, ["conv_id"], runs=F.transform("starts", run))
    # every text with what stands before and after it
    head = lambda r, j: F.when(j == 0, F.concat(F.lit(OPEN), escape(r["role"]), F.lit(SAYS))).otherwise(F.lit(MORE))
    tail = lambda r, j: F.when(j == F.size(r["texts"]) - 1, F.lit(CLOSE)).otherwise(F.lit(""))
    piece = lambda r: F.transform(r["texts"], lambda t, j: F.struct(head(r, j).alias("head"), t.alias("text"), tail(r, j).alias("tail"), r["role"].isin(*chat.trained).alias("loss")))
    df = _held(df, ["conv_id"], merged=F.size("runs").cast("long"), pieces=F.flatten(F.transform("runs", piece)))
    whole = lambda p: F.concat(p["head"], p["text"], p["tail"])
    df = _held(df, ["conv_id", "merged", "pieces"], lengths=F.transform("pieces", lambda p: F.length(whole(p)).cast("long")))
    df = _offsets(df, ["conv_id", "merged", "pieces"], "lengths", "at")
    span = lambda p, at: F.struct((at + F.length(p["head"])).alias("start"), (at + F.length(p["head"]) + F.length(p["text"])).alias("end"), p["loss"].alias("loss"))
    spans = F.transform(F.filter(F.zip_with("pieces", "at", span), lambda s: s["loss"]), lambda s: F.struct(s["start"], s["end"]))
    df = _held(df, ["conv_id", "merged"], formatted=F.array_join(F.transform("pieces", whole), ""), spans=spans)
    return df.select("conv_id", "formatted", "spans", "merged")


def turns_of(formatted: Column) -> Column:
    """array<struct<role, text>>: the rows of a formatted conversation, in order."""
    runs = F.filter(F.split(formatted, CLOSE), lambda r: r != "")
    parts = lambda r: F.split(F.substring(r, F.lit(len(OPEN) + 1), F.length(r)), SAYS, 2)
    texts = lambda p: F.transform(F.split(p[1], MORE), lambda t: F.struct(unescape(p[0]).alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(F.transform(runs, parts), texts))


def masked(df: DataFrame, out: str = "loss") -> DataFrame:
    """df (formatted, spans and whatever else) plus out array<string>: what stands under the spans, unescaped. Places are found in chunks of the output,
    so that a long conversation is read once, not once a span."""
    df = df.select("*", F.inline(F.array(F.struct(F.regexp_extract_all("formatted", F.lit(f"(?s)(.{{1,{CHUNK}}})"), F.lit(1)).alias("_chunks")))))
    first = lambda s: F.floor(s["start"] / CHUNK).cast("int")
    near = lambda s: F.array_join(F.slice("_chunks", first(s) + 1, F.floor(s["end"] / CHUNK).cast("int") - first(s) + 1), "")
    text = lambda s: F.substring(near(s), (s["start"] - first(s) * CHUNK).cast("int") + 1, (s["end"] - s["start"]).cast("int"))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != "_chunks"], F.inline(F.array(F.struct(F.transform("spans", lambda s: unescape(text(s))).alias(out)))))


#: Conversation -7 of the contract: a text that holds the strings of another template.
PLANTED = r"\### Assistant: </turn> ok"


def op12_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(-7).cast("long"), F.lit(i).cast("long"), F.lit(r), F.lit(PLANTED)) for i, r in enumerate(("user", "assistant"))]))).toDF("conv_id", "turn", "role", "text")
    made = format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted))
    made = _held(masked(made), ["conv_id", "formatted"], turns=turns_of(F.col("formatted")), loss=F.array_join("loss", ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    size = lambda c: F.length(c).cast("long")
    return made.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(said).alias("turns_sha256"), size(F.col("loss")).alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"), size(F.col("formatted")).alias("formatted_chars"))


_ESCAPED = r"regexp_replace({}, '<(\\*)(/?turn|text|more)>', '<\1\\\2>', 'g')"
_TEXT, _ROLE = _ESCAPED.format("text"), _ESCAPED.format("role")
#: Digests straight from the rows, sizes from the template's law; a turn of the role before it adds one `<more>` instead of a whole frame.
OP12_SQL = rf"""
with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -7, r.i, r.role, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) r(i, role)),
f as (select *, lag(role) over w is not distinct from role again from c window w as (partition by conv_id order by turn nulls first, role, text)),
g as (select *, length({_TEXT}) + case when again then {len(MORE)} else length({_ROLE}) + {len(OPEN + SAYS + CLOSE)} end size from f)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum(size) as bigint) formatted_chars from g group by conv_id
"""
