"""JSON repair in place: a table of faults with what they leave, and one character too many or too few at every place."""

from __future__ import annotations

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from chalkline.functions.json_text import repaired

KNOWN = [
    ('{"a": [1, 2 3], "b": {"c": 1}}', {"a": [1, 2, 3], "b": {"c": 1}}),
    ("{'a': 1, 'b': 'it is'}", {"a": 1, "b": "it is"}),
    ("{'a': 'don't stop', 'b': 1}", {"a": "don't stop", "b": 1}),
    ('{a: 1, b: two, "c": true}', {"a": 1, "b": "two", "c": True}),
    ('{"a": 1,, "b": 2,}', {"a": 1, "b": 2}),
    ('{"a": "He said "hi" to me", "b": 2}', {"a": 'He said "hi" to me', "b": 2}),
    ('{"a": "He said "hi", then left", "b": 2}', {"a": 'He said "hi", then left', "b": 2}),
    ('{"a": "say "yes"", "b": ["p "q" r", "s"]}', {"a": 'say "yes"', "b": ['p "q" r', "s"]}),
    ('{"a": True, "b": None, "c": NaN}', {"a": True, "b": None, "c": "nan"}),
    ('{"a": 1 // note\n, "b": 2 /* x */}', {"a": 1, "b": 2}),
    ('{"a" 1, "b": }', {"a": 1, "b": None}),
    ('{"a": [1, 2}, "b": 3}', {"a": [1, 2], "b": 3}),
    ('{"a": "x\n "b": 1}', {"a": "x", "b": 1}),
    ('{"a": "x, "b": 1}', {"a": "x", "b": 1}),
    ('{“a”: “x”, "b": 1}', {"a": "x", "b": 1}),
    ('{"a": "x" "b": 1}', {"a": "x", "b": 1}),
    ('["a" "b", "c"]', ["a", "b", "c"]),
    ('{"a": "C:\\d\\x"}', {"a": "C:\\d\\x"}),
    ('{"a": "x}', {"a": "x"}),
    ('{"a": "\\ud83d"}', {"a": "\ufffd"}),
    ('{"a": 1, "a": 2', {"a": 2}),
    ('Sure [see below]: {"a": 1} ok', {"a": 1}),
    ('```json\n{"a": 1}\n```', {"a": 1}),
    ('{"a": "http://x.y/z", b: http://q.r}', {"a": "http://x.y/z", "b": "http://q.r"}),
    ('[1 2 true "x" {"a":1} null]', [1, 2, True, "x", {"a": 1}, None]),
    ("[" + "9" * 5000, ["9" * 5000]),
    ("[", []),
    ("{", {}),
]


@pytest.mark.parametrize(("raw", "value"), KNOWN)
def test_what_a_fault_leaves(raw, value):
    found = json.loads(repaired(raw), parse_constant=str.lower)
    assert found == value


def test_nothing_to_repair():
    assert [repaired(x) for x in (None, "", "no json", "[see]")] == [None] * 4


def test_deep_and_long():
    assert len(repaired("[" * 100_000)) == 200_000
    many = json.loads(repaired('{"a": [' + '{"k": 1 "t": "x "y" z"}, ' * 20_000))["a"]
    assert len(many) == 20_000 and all(x == {"k": 1, "t": 'x "y" z'} for x in many)


TOPICS = json.dumps({"topics": [{"id": f"T_{i}", "name": f"name {i}, part", "n": i, "ok": i % 2 == 0, "l": [1, 2, "x"]} for i in range(12)]})


def test_one_character_at_every_place():
    """Whatever character is missing or doubled, the text is read, and nearly always all topics but the damaged one."""
    poor = 0
    for i in range(len(TOPICS)):
        for damaged in (TOPICS[:i] + TOPICS[i + 1 :], TOPICS[:i] + TOPICS[i] + TOPICS[i:]):
            said = json.dumps(json.loads(repaired(damaged)))
            poor += sum(f'"T_{k}"' in said for k in range(12)) < 11
    assert poor <= 0.04 * 2 * len(TOPICS)


@given(st.text(st.sampled_from("{}[]\"',:\\ \na1tu“/#é-.e"), max_size=60))
def test_any_text(text):
    found = repaired("{" + text)
    json.loads(found)
