"""Elements salvaged from broken XML are well-formed, and hold what the text says."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pytest
from hypothesis import given
from hypothesis import strategies as st

from chalkline.functions.xml_text import elements, first_element

KNOWN = [
    ("<c>one</c> then <c>two</c>", [("one", True), ("two", True)]),
    ('<c a="1 < 2">x</c>', [("x", True)]),
    ("<c a=1 b>x</c>", [("x", True)]),
    ("<c>one<c>two", [("one", False), ("two", False)]),
    ("<r><c>a & b &nbsp;&lt;</c><d/><c>z</c>", [("a & b \xa0<", True), ("z", True)]),
    ("<c>1 < 2</c>", [("1 < 2", False)]),
    ("<c><![CDATA[<x> & y]]></c><!-- <c>no</c> --><c/>", [("<x> & y", True), ("", True)]),
    ("<c>a<b>b</c>", [("ab", False)]),
    ("<c>a</b>b</c>", [("ab", False)]),
    ("<c>cut <na", [("cut ", False)]),
    ("<chapter>x</chapter>", []),
    ("none", []),
    (None, []),
]


@pytest.mark.parametrize(("text", "want"), KNOWN)
def test_elements(text, want):
    assert [("".join(ET.fromstring(x).itertext()), whole) for x, whole in elements(text, "c")] == want


def test_first_element_holds_its_like():
    assert first_element("noise <a><b>x & y</b><a>z") == "<a><b>x &amp; y</b><a>z</a></a>"
    assert first_element("<a k='1' k=\"2\" j='\"'>") == '<a k="1" j="&quot;"></a>'


TEXT = "<o>" + "".join(f'<c id="{i}" n="a b"><t>text {i} &amp; more</t><e/></c>' for i in range(20)) + "</o>"


def test_one_character_at_every_place():
    """Whatever character is missing or doubled, all elements but those beside it are there."""
    for i in range(len(TEXT)):
        for damaged in (TEXT[:i] + TEXT[i + 1 :], TEXT[:i] + TEXT[i] + TEXT[i:]):
            found = [ET.fromstring(x) for x, _ in elements(damaged, "c")]
            assert len({x.get("id") for x in found} & {str(k) for k in range(20)}) >= 18


def test_long():
    text = "<c>" + "<b a='" * 50_000 + "<" * 50_000 + "&" * 50_000 + "</c>" * 50_000
    assert [len(elements(text, "c")), len(elements("<c>x</c>" * 50_000, "c"))] == [1, 50_000]


@given(st.text(st.sampled_from("<>/=\"' abc&;!-[]\x00é?"), max_size=60))
def test_any_text(text):
    for x, _ in elements("<c>" + text, "c"):
        ET.fromstring(x)
