"""Names, grades, subjects and scripts told from text; small rules that prompts and pages share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chalkline.functions.text import digits_only

UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
# Code points of the scripts, first and last.
SCRIPTS = {
    "Telugu": (0x0C00, 0x0C7F),
    "Hindi": (0x0900, 0x097F),
    "Kannada": (0x0C80, 0x0CFF),
    "Tamil": (0x0B80, 0x0BFF),
    "Marathi": (0x0900, 0x097F),
}
# What daily stories teach, in turn.
STORY_VALUES = ["Perseverance", "Empathy", "Courage", "Kindness", "Honesty", "Teamwork", "Creativity", "Resilience", "Patience", "Leadership"]
# Subjects by the words that name them, in the order in which they are tried.
BOOK_SUBJECTS = [(["math"], "Mathematics"), (["science"], "Science"), (["english", "language", "literacy"], "English Language Arts"), (["social", "history"], "Social Studies")]
SUBJECT_LABELS = [(["math"], "Mathematics"), (["science"], "Science"), (["english", "language"], "English Language Arts")]
PLAN_SUBJECTS = [(["math"], "maths"), (["english"], "english"), (["science", "evs"], "evs")]
# Grades in the order in which they are looked for, so that "grade 10" gives 1.
GRADES = ["kg", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10"]
# Shares of the questions of a worksheet, up to a grade.
BLOOM = [
    (2, "~60% Remember, ~30% Understand, ~10% Apply. No Analyse questions for this grade."),
    (4, "~40% Remember, ~35% Understand, ~20% Apply, ~5% Analyse."),
    (None, "~25% Remember, ~30% Understand, ~30% Apply, ~15% Analyse."),
]
# Last grades of the bands that language rules are written for.
BANDS = [(2, "1-2"), (4, "3-4"), (6, "5-6"), (9, "7-9"), (None, "10-12")]


def falsy_default(x: Column, default: Column) -> Column:
    """x, or the default where x is null, an empty text, a number that is zero, false, or an empty list or map; a text "0" is itself."""
    said = x.cast("string")
    nothing = (said == "") | ((F.typeof(x) != "string") & said.rlike(r"^(-?0(\.0+)?(E-?\d+)?|false|\[\]|\{\})$"))
    return F.when(x.isNull() | nothing, default).otherwise(x)


def by_words(text: Column, rules: list[tuple[list[str], str]], default: Column) -> Column:
    """Label of the first rule one of whose words the lower-case text holds, else the default."""
    out = None
    for words, label in rules:
        hit = text.contains(words[0])
        for w in words[1:]:
            hit = hit | text.contains(w)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def by_grade(grade: Column, bands: list[tuple[int | None, str]]) -> Column:
    """Text of the first band whose last grade isn't below this one; the digits of a grade count, 5 where there are none."""
    g = F.coalesce(digits_only(grade.cast("string")), F.lit(5))
    out = F.when(g <= bands[0][0], bands[0][1])
    for last, text in bands[1:-1]:
        out = out.when(g <= last, text)
    return out.otherwise(bands[-1][1])


def grade_of(subject: Column) -> Column:
    """The first grade of GRADES that the text names."""
    low = F.lower(subject)
    tight = F.replace(low, F.lit(" "), F.lit(""))
    out = F.when(tight.contains(f"grade{GRADES[0]}"), GRADES[0])
    for g in GRADES[1:]:
        out = out.when(tight.contains(f"grade{g}") | low.contains(f"grade {g}"), g)
    return out.otherwise("")


def book_name(grade: Column, subject: Column) -> Column:
    """grade{n}_{subject} as books are filed."""
    g = F.trim(F.replace(F.replace(grade.cast("string"), F.lit("Grade "), F.lit("")), F.lit("grade"), F.lit("")))
    s = F.replace(F.replace(F.lower(subject), F.lit(" "), F.lit("_")), F.lit("mathematics"), F.lit("maths"))
    return F.concat(F.lit("grade"), g, F.lit("_"), s)


def inferred_book(grade: Column, subject: Column) -> Column:
    """The book that a plan without one stands for."""
    g = F.trim(F.replace(F.replace(grade.cast("string"), F.lit("Grade "), F.lit("")), F.lit("grade"), F.lit("")))
    low = F.lower(subject)
    return F.concat(F.lit("grade"), g, F.lit("_"), by_words(low, PLAN_SUBJECTS, low))


def in_script(text: Column, language: Column) -> Column:
    """Whether the text has a letter of the language's script; true for English and languages without one here."""
    out = None
    for name, (low, high) in SCRIPTS.items():
        found = text.rlike(rf"[\x{{{low:04X}}}-\x{{{high:04X}}}]")
        out = F.when(language == name, found) if out is None else out.when(language == name, found)
    return out.otherwise(True)


def transliterated(name: Column, language: Column) -> Column:
    """A name in a language other than English of which every visible character is ASCII; an empty one too."""
    return (language != "English") & ~name.rlike(r"[^\x00-\x7F]")


def escaped(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def highlighted(text: Column, needle: str) -> Column:
    """Escaped text with what the needle finds, in any case, between marks; an empty needle finds nothing."""
    if not needle:
        return escaped(text)
    literal = "".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in needle)
    return F.regexp_replace(escaped(text), f"(?i)({literal})", "<mark>$1</mark>")


def rotated(index: Column, values: list[str]) -> Column:
    """The value at an index that goes round."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(F.coalesce(index, F.lit(0)), F.lit(len(values))).cast("int"))
