"""Nested payloads: fields spread, dropped, collected and replaced, at known paths as Columns and anywhere in open JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids of exercises inside texts.
EXERCISE_ID = re.compile(r"E_\d+_\d+_\d+")


def spread(payload: Column, own: dict[str, Column]) -> dict[str, Column]:
    """Columns ``own`` where the JSON payload doesn't have their key; it overrides them where it has, even by null."""
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    return {k: F.when(F.array_contains(keys, k), F.get_json_object(payload, f"$.{k}")).otherwise(v.cast("string")) for k, v in own.items()}


def without_images(sections: Column) -> Column:
    """An array of sections whose questions have lost ``image_data``."""
    return F.transform(sections, lambda s: s.withField("questions", F.transform(s["questions"], lambda q: q.dropFields("image_data"))))


def _stripped(value, suffix: str):
    if isinstance(value, dict):
        return {k: _stripped(v, suffix) for k, v in value.items() if not k.endswith(suffix)}
    return [_stripped(v, suffix) for v in value] if isinstance(value, list) else value


def _told(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def strip_keys(document: Column, suffix: str = "image_data") -> Column:
    """JSON without any key, however deep, that ends in the suffix; only documents that hold such a key reach Python."""

    @F.pandas_udf(T.StringType())
    def strip(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else _told(_stripped(json.loads(s), suffix)))

    return F.coalesce(strip(F.when(document.contains(f'{suffix}"'), document)), document)


def _collected(value, suffix: str, path: str) -> list[dict[str, str]]:
    found = []
    if isinstance(value, dict):
        for k, v in value.items():
            here = f"{path}.{k}" if path else k
            if k.endswith(suffix) and isinstance(v, str) and v.strip():
                found.append({"path": here, "value": v})
            else:
                found += _collected(v, suffix, here)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            found += _collected(v, suffix, f"{path}[{i}]")
    return found


def collect_keys(document: Column, suffix: str = "image_prompt") -> Column:
    """(path, value) of each non-blank text under a key that ends in the suffix, in document order."""

    @F.pandas_udf("array<struct<path:string,value:string>>")
    def collect(x: pd.Series) -> pd.Series:
        return x.map(lambda s: [] if s is None else _collected(json.loads(s), suffix, ""))

    return F.coalesce(collect(F.when(document.contains(f'{suffix}"'), document)), F.array().cast("array<struct<path:string,value:string>>"))


def _replaced(value, lookup: dict[str, str]):
    if isinstance(value, dict):
        return {k: _replaced(v, lookup) for k, v in value.items()}
    if isinstance(value, list):
        return [_replaced(v, lookup) for v in value]
    if isinstance(value, str):
        for found in EXERCISE_ID.findall(value):
            if found in lookup:
                value = value.replace(found, lookup[found])
    return value


@F.pandas_udf(T.StringType())
def replace_ids(document: pd.Series, lookup: pd.Series) -> pd.Series:
    """JSON with the ids in all of its strings replaced by what ``lookup`` (a JSON object for each row) has for them."""
    return pd.Series([None if d is None else d if m is None else _told(_replaced(json.loads(d), json.loads(m))) for d, m in zip(document, lookup, strict=True)])


def with_lesson_info(plan: Column) -> dict[str, Column]:
    """lesson_type and the fields that a plan may hold at its top or inside lesson_info; the top counts where it has the key."""
    keys = F.coalesce(F.json_object_keys(plan), F.array().cast("array<string>"))
    kind = F.get_json_object(plan, "$.lesson_type")
    out = {"lesson_type": F.when(F.coalesce(kind, F.lit("")) == "", "activity").otherwise(kind)}
    for field in ("subject", "grade", "topic", "duration_minutes"):
        top, inner = F.get_json_object(plan, f"$.{field}"), F.get_json_object(plan, f"$.lesson_info.{field}")
        out[field] = F.when(F.array_contains(keys, field), top).otherwise(inner)
    return out


def valid_questions(questions: Column) -> Column:
    """Worksheet questions with two letters or digits and an answer, with defaults for level and difficulty."""
    told = lambda x: F.coalesce(F.trim(x), F.lit(""))
    letters = lambda q: F.length(F.regexp_replace(told(q["question"]), "[^a-zA-Z0-9]", ""))
    sound = F.filter(questions, lambda q: (letters(q) >= 2) & (F.coalesce(q["answer"], F.lit("")) != ""))
    blank = lambda x, d: F.when(F.coalesce(x, F.lit("")) == "", d).otherwise(x)
    return F.transform(sound, lambda q: q.withField("bloom_level", blank(q["bloom_level"], "remember")).withField("difficulty_tag", blank(q["difficulty_tag"], "medium")))


def recovery_questions(questions: Column) -> Column:
    """Recovery questions with a text, two options where they are multiple choice, and an answer; letters of full options, numbers from 1."""
    choice = lambda q: F.coalesce(q["type"], F.lit("multiple_choice")).isin("multiple_choice", "mcq")
    blank = lambda x: F.coalesce(F.trim(x), F.lit(""))

    def answer(q: Column) -> Column:
        given = F.trim(F.when(blank(q["answer"]) != "", q["answer"]).otherwise(F.coalesce(q["correct_answer"], F.lit(""))))
        first = F.upper(F.substring(given, 1, 1))
        letter = F.when((F.length(given) > 1) & first.isin("A", "B", "C", "D"), first).otherwise(given)
        return F.when(choice(q), F.when(letter == "", "A").otherwise(letter)).otherwise(q["answer"])

    sound = F.filter(questions, lambda q: (blank(q["question"]) != "") & (~choice(q) | (F.coalesce(F.size(q["options"]), F.lit(0)) >= 2)))
    told = F.transform(sound, lambda q: q.withField("answer", answer(q)).withField("type", F.coalesce(q["type"], F.lit("multiple_choice"))))
    kept = F.filter(told, lambda q: F.coalesce(q["answer"], F.lit("")) != "")
    return F.transform(kept, lambda q, i: q.withField("number", i + 1))


def quiz_defaults(questions: Column) -> tuple[Column, Column, Column]:
    """(questions with numbers, points and types, answer key by number, total points) of a quiz."""
    told = F.transform(
        F.coalesce(questions, F.array().cast(questions_type())),
        lambda q, i: q.withField("number", F.coalesce(q["number"], i + 1)).withField("points", F.coalesce(q["points"], F.lit(1))).withField("type", F.coalesce(q["type"], F.lit("multiple_choice"))),
    )
    entries = F.array_sort(
        F.transform(told, lambda q, i: F.struct(q["number"].cast("string").alias("key"), i.alias("i"), F.coalesce(q["correct_answer"], F.lit("")).alias("value")))
    )
    # Of questions with one number the last one has the key: the one whose neighbour in order of numbers has another.
    following = F.slice(entries, F.lit(2), F.size(entries))
    last = F.zip_with(entries, following, lambda e, f: F.when(f.isNull() | (e["key"] != f["key"]), F.struct(e["i"], e["key"], e["value"])))
    kept = F.array_sort(F.filter(last, lambda x: x.isNotNull()))
    return told, F.map_from_entries(F.transform(kept, lambda x: F.struct(x["key"], x["value"]))), F.size(told)


def questions_type() -> str:
    return "array<struct<number:int,points:int,type:string,question:string,correct_answer:string>>"
