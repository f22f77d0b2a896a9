"""Column functions on text. White space is Unicode white space; all of them keep null apart from empty unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def squash(c: Column) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return F.regexp_replace(trim(c), rf"{SPACE}+", " ")


def fold(c: Column) -> Column:
    """Lower case with sharp s as ss; other special case folds are left."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def clean_value(c: Column) -> Column:
    """Null becomes 'unknown'; underscores become spaces, slashes and commas get their usual spacing, case is folded."""
    t = squash(F.replace(trim(c), F.lit("_"), F.lit(" ")))
    t = F.regexp_replace(F.regexp_replace(t, rf"{SPACE}*/{SPACE}*", "/"), rf"{SPACE}*,{SPACE}*", ", ")
    plain = ~c.rlike(r"(?U)[\s_/,]")  # nothing to space
    return F.coalesce(F.when(plain, fold(c)).otherwise(fold(t)), F.lit("unknown"))


def clean_key(c: Column) -> Column:
    """Lookup form of a value; null becomes empty. Only white space at the ends of the text as written is dropped."""
    t = F.replace(fold(trim(F.coalesce(c, F.lit("")))), F.lit("_"), F.lit(" "))
    return F.regexp_replace(t, rf"{SPACE}+", " ")


def string_or_none(c: Column) -> Column:
    t = trim(c)
    return F.when(t != "", t)


def normalize_relpath(c: Column) -> Column:
    """Slashes forward, all leading dots and slashes gone; null stays null."""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^[./]+", "")


def record_id(class_raw: Column, sample_id: Column, file_name: Column) -> Column:
    return F.concat_ws("::", class_raw, F.coalesce(F.when(sample_id != "", sample_id), file_name))


def split_record_id(c: Column) -> Column:
    """[class, sample] split at the first ::, null without one."""
    parts = F.split(c, "::", 2)
    return F.when(F.size(parts) == 2, parts)


def sanitize_copy_name(c: Column) -> Column:
    t = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("__")), F.lit("/"), F.lit("__")), F.lit(":"), F.lit("_"))
    t = F.regexp_replace(t, r"[^\p{L}\p{N}._-]", "_")
    return F.when(F.coalesce(t, F.lit("")) == "", "image").otherwise(t)


#: Names of folders that only say which split they hold.
SPLIT_NAMES = ("train", "val", "valid", "validation", "test", "testing")


def slug(c: Column) -> Column:
    """Runs of anything but letters, digits, dot and minus become one underscore; ends are stripped of ._-"""
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_"), "_+", "_"), F.lit("._-"))


def dataset_label(root: Column) -> Column:
    """The root's last folder; with its parent's name in front if it only names a split."""
    parts = F.filter(F.split(F.replace(root, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    base, parent = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    return slug(F.when(F.lower(base).isin(*SPLIT_NAMES) & parent.isNotNull(), F.concat_ws("_", parent, base)).otherwise(base))


def strip_fences(c: Column) -> Column:
    t = F.regexp_replace(trim(c), "^```(json)?", "")
    return trim(F.regexp_replace(trim(t), "```$", ""))


def with_article(c: Column) -> Column:
    return F.when(squash(c) == "", "").when(F.lower(squash(c)).rlike("^[aeiou]"), F.concat(F.lit("an "), squash(c))).otherwise(F.concat(F.lit("a "), squash(c)))


def cleanup_caption(c: Column) -> Column:
    t = F.replace(F.replace(squash(c), F.lit(" ,"), F.lit(",")), F.lit(" ."), F.lit("."))
    return F.btrim(F.replace(t, F.lit("  "), F.lit(" ")), F.lit(" ,."))
