"""Accessors of message records (messages: array of role and content; images: array of paths)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verisheaf.functions import lexicon as L
from verisheaf.functions.text import let

RECORD = "record_index long, case_id string, synthetic boolean, images array<string>, messages array<struct<role:string,content:string>>"


def first_content(messages: Column, role: str) -> Column:
    """PR1, PR2: content of the first message of a role, empty without one."""
    return F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"], F.lit(""))


def strict_content(messages: Column, role: str) -> Column:
    """PR3: raises without one."""
    found = F.filter(messages, lambda m: m["role"] == role)
    return F.when(F.size(found) > 0, found[0]["content"]).otherwise(F.raise_error(F.lit(f"record without a message of role {role}")))


def first_filled(messages: Column, role: str) -> Column:
    """PR4: the first content that isn't empty."""
    return F.coalesce(F.get(F.filter(messages, lambda m: (m["role"] == role) & (F.coalesce(m["content"], F.lit("")) != "")), F.lit(0))["content"], F.lit(""))


def replace_content(messages: Column, role: str, content: Column) -> Column:
    """PR5: the first message of the role gets another content."""
    place = F.array_position(F.transform(messages, lambda m: m["role"]), role)
    return F.transform(messages, lambda m, i: F.when(i + 1 == place, F.struct(m["role"].alias("role"), content.alias("content"))).otherwise(m))


def pick(*columns: Column) -> Column:
    """PR6: the first that isn't null, as text."""
    return F.coalesce(*[c.cast("string") for c in columns])


def first_or_empty(values: Column) -> Column:
    """PR6, for lists: the first element, empty for an empty list, null for null."""
    return F.when(values.isNotNull(), F.coalesce(F.get(values, F.lit(0)).cast("string"), F.lit("")))


def dotted(json: Column, path: str) -> Column:
    """PR7: null where a level is missing."""
    return F.get_json_object(json, "$." + path)


def case_key(path: Column) -> Column:
    """PR8: the directory of an image, slashes unified; the name itself without one."""
    unified = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(unified.contains("/"), F.regexp_replace(unified, "/[^/]*$", "")).otherwise(unified)


def image_position(path: Column) -> Column:
    """PR9: the one position named in a file name; specific names win over general ones."""
    names = F.array(*map(F.lit, L.POSITIONS["views"]))
    special = lambda named: F.filter(named, lambda p: ~p.isin("上图", "下图"))
    best = lambda named: let(special(named), lambda x: F.when(F.size(x) > 0, x).otherwise(named))
    hits = let(F.element_at(F.split(path, "/"), -1), lambda name: let(F.filter(names, lambda p: F.contains(name, p)), best))
    return let(hits, lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0))))


def preview(text: Column, n: int = 500) -> Column:
    """PR10."""
    return F.substring(text, 1, n)


def record(prompt: Column, answer: Column, images: Column | None = None) -> Column:
    """PR11."""
    said = F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in (("user", prompt), ("assistant", answer))])
    return F.struct(*([images.alias("images")] if images is not None else []), said.alias("messages"))


def prompt_with_images(images: Column, instruction: str) -> Column:
    """PR12."""
    return F.concat(F.repeat(F.lit("<image>"), F.size(images)), F.lit(instruction))


def benchmark_prompt(hint: Column, question: Column, options: dict[str, Column], instruction: str) -> Column:
    """PR13: parts that are null or empty are left out."""
    filled = lambda c: F.when(F.trim(c) != "", c)
    return F.concat_ws("\n", F.concat(F.lit("Hint: "), filled(hint)), F.concat(F.lit("Question: "), question), *[F.concat(F.lit(f"{k}. "), filled(c)) for k, c in options.items()], F.lit(instruction))


def finite(value: Column) -> Column:
    """PR14: a number, or null if it isn't one or isn't finite."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def head(df, ordinal: str, n: int | None):
    """PR15: rows whose ordinal is below n; all without a limit."""
    return df if n is None else df.where(F.col(ordinal) < n)
