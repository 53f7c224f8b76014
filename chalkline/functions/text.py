"""Text functions that return Columns, and the few that need Python."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.functions.json_text import repaired
from chalkline.functions.xml_text import elements, first_element

#: White space as Python's strip sees it.
EDGE = r"(?U)^\s+|\s+$"
#: The same as a class, which Java's and RE2's patterns read alike.
SPACES = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, EDGE, "")


def composed_nfc(x: Column) -> Column:
    """NFC; only texts that aren't ASCII reach Python."""
    return F.coalesce(nfc(F.when(x.rlike(r"[^\x00-\x7F]"), x)), x)


def norm_name(x: Column) -> Column:
    """Lower case without edges and invisible marks; texts that aren't ASCII go through NFC."""
    marks = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}]"
    plain = F.coalesce(x, F.lit(""))
    composed = composed_nfc(plain)
    return F.lower(F.regexp_replace(stripped(composed), marks, ""))


def normalised(x: Column) -> Column:
    """NFC, without zero-width marks, white space as single spaces."""
    bare = F.regexp_replace(composed_nfc(x), r"[\x{200B}-\x{200D}\x{FEFF}]", "")
    return stripped(F.regexp_replace(bare, rf"[{SPACES}]+", " "))


def semantic_name(x: Column) -> Column:
    """Without a leading number and a trailing parenthesis."""
    bare = F.regexp_replace(norm_name(x), r"^\d+\.\s*", "")
    return stripped(F.regexp_replace(bare, r"\s*\([^)]*\)\s*$", ""))


def first_keyword(text: Column, rules: list[tuple[list[str], str]], default: str | None) -> Column:
    """Label of the first rule one of whose words the text holds.

    A rule's words are one literal array: a test for each of them makes methods that the JVM refuses to compile.
    """
    out = None
    for words, label in rules:
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(default))


def all_keywords(text: Column, rules: list[tuple[list[str], str]], default: str) -> Column:
    """Labels of all rules that a text meets, else the default alone."""
    marks = [first_keyword(text, [r], None) for r in rules]
    found = F.filter(F.array(*marks), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def canonical_ids(x: Column, old: Column, new: Column) -> Column:
    """Ids of one chapter number moved to another: T_3_1 becomes T_7_1, C_3 becomes C_7; what is no id stays."""
    parts = F.split(x, "_")
    rest = F.slice(parts, 3, 1000)
    moved = F.concat_ws("_", F.get(parts, F.lit(0)), new.cast("string"), F.when(F.size(rest) > 0, F.array_join(rest, "_")))
    return F.when(F.coalesce(F.get(parts, F.lit(1)) == old.cast("string"), F.lit(False)), moved).otherwise(x)


def strip_fences(x: Column) -> Column:
    return stripped(F.regexp_replace(F.regexp_replace(stripped(x), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def truncated(x: Column, limit: int = 280) -> Column:
    """Cut before an ellipsis; white space of any kind goes at the cut."""
    cut = F.regexp_replace(F.substring(x, 1, limit - 1), rf"[{SPACES}]+\z", "")
    return F.when(F.char_length(x) > limit, F.concat(cut, F.lit("…"))).otherwise(x)


def safe_dirname(x: Column) -> Column:
    return F.lower(F.replace(F.regexp_replace(x, r'[<>:"/\\|?*]', ""), F.lit(" "), F.lit("_")))


def digits_only(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "").try_cast("int")


@F.pandas_udf(T.StringType())
def nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity; not symmetric, so the order of a and b counts."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def repair_json(x: pd.Series) -> pd.Series:
    return x.map(repaired)


def may_reach(a: Column, b: Column, least: float) -> Column:
    """False where the similarity of a and b is surely under ``least``.

    What the ratio matches is a common subsequence, so all letters but twice its length can be deleted and inserted to
    make one text of the other; that is no less than their edit distance. Nor can it be longer than the letters that
    both have, each as often as in the one that has fewer.
    """
    both = F.char_length(a) + F.char_length(b)
    times = lambda x, c: F.char_length(x) - F.char_length(F.replace(x, c, F.lit("")))
    letters = F.array_distinct(F.regexp_extract_all(a, F.lit("(?s)."), F.lit(0)))
    shared = F.aggregate(letters, F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))
    return (F.levenshtein(a, b) <= (1 - least) * both + 1e-9) & (2 * shared >= least * both - 1e-9)


def robust_json(x: Column) -> Column:
    """Valid JSON as it is; the repair gets only what Spark can't parse, and null for the rest."""
    bare = strip_fences(x)
    fine = F.when(F.try_parse_json(bare).isNotNull() & bare.rlike(r"(?s)^[\[{].*[\]}]$"), bare)
    return F.coalesce(fine, repair_json(F.when(fine.isNull(), x)))


@F.pandas_udf(T.StringType())
def repair_xml(x: pd.Series) -> pd.Series:
    return x.map(first_element)


def xml_elements(x: Column, tag: str) -> Column:
    """The elements ``tag`` of a text as an array of (xml, whole), each block well-formed."""

    @F.pandas_udf("array<struct<xml: string, whole: boolean>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"xml": block, "whole": whole} for block, whole in elements(t, tag)])

    return found(x)
