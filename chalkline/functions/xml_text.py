"""Salvage of XML that a model wrote: one scan over the tags that gives the elements of a text as well-formed blocks.

Around the elements may stand anything: prose, fences, a root that is cut off or
never opened, other elements. Inside of one, bare ampersands and brackets are
escaped, attributes quoted, tags that lack their end closed where the element
around them ends, and ends without a beginning left out.
"""

from __future__ import annotations

import html
import re

_NAME = r"[A-Za-z_][\w.:\-]*+"
_VALUE = r"""(?:"(?:[^"<]|<(?![/A-Za-z_!?]))*+"|'(?:[^'<]|<(?![/A-Za-z_!?]))*+'|["']?[^\s"'<>/]++)"""
_TAG = re.compile(rf"<(/?)({_NAME})((?:\s++|{_NAME}\s*+=\s*+{_VALUE}|{_NAME}|/(?!>)|[\"'])*+)(/?)>")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<\?.*?(?:\?>|\Z)|<!DOCTYPE[^>]*+>", re.S)
_CDATA = re.compile(r"<!\[CDATA\[(.*?)(?:\]\]>|\Z)", re.S)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:\s*+=\s*+({_VALUE}))?+")
_CUT = re.compile(r"</?[A-Za-z_][^<>]*+\Z|<[/!]?\Z")
_AMPERSAND = re.compile(r"&(#[0-9]+;|#x[0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")
#: The entities that XML has of its own.
_OWN = ("amp;", "lt;", "gt;", "quot;", "apos;")
#: Characters that XML can't hold.
_BAD = re.compile(r"[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def _entity(m: re.Match) -> str:
    if m[1] in _OWN:
        return m[0]
    said = html.unescape(m[0]) if m[1] else m[0]
    return _escaped(said) if said != m[0] else "&amp;" + m[0][1:]


def _escaped(text: str) -> str:
    return _BAD.sub("", text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _text(text: str) -> str:
    return _BAD.sub("", _AMPERSAND.sub(_entity, text)).replace("<", "&lt;")


def _attributes(said: str) -> str:
    """Each name once, the first counts; one without a value has its name for it."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(said):
        quote = value[:1] if value[:1] in ("'", '"') else ""
        bare = value[1:].removesuffix(quote) if quote else value
        found.setdefault(name, _text(bare if value else name).replace('"', "&quot;"))
    return "".join(f' {k}="{v}"' for k, v in found.items())


def elements(text: str | None, tag: str | None = None) -> list[tuple[str, bool]]:
    """(block, whether its tags were whole) of the elements ``tag``, which don't hold their like; without a tag, of the first element there is.

    The last element may be cut off: a tag that breaks off goes, a text stays.
    """
    if text is None:
        return []
    found: list[tuple[str, bool]] = []
    open_: list[str] = []
    out: list[str] = []
    whole, at = True, 0

    def end(least: int, fine: bool) -> None:
        nonlocal whole
        whole = whole and fine
        while len(open_) > least:
            out.append(f"</{open_.pop()}>")
        if not open_:
            found.append(("".join(out), whole))
            out.clear()
            whole = True

    while at < len(text):
        begin = text.find("<", at)
        if open_:
            out.append(_text(text[at : begin if begin >= 0 else len(text)]))
        if begin < 0:
            break
        if m := _TAG.match(text, begin):
            at = m.end()
            closing, name, said, empty = m.groups()
            if closing:
                if name in open_:
                    end(len(open_) - 1 - open_[::-1].index(name), open_[-1] == name)
                elif open_:
                    whole = False
            elif open_ or tag is None or name == tag:
                if open_ and name == tag:
                    end(0, False)
                out.append(f"<{name}{_attributes(said)}>")
                open_.append(name)
                if empty:
                    end(len(open_) - 1, True)
            if tag is None and found:
                return found
        elif m := _CDATA.match(text, begin):
            at = m.end()
            if open_:
                out.append(_escaped(m[1]))
        elif m := _OTHER.match(text, begin):
            at = m.end()
        elif _CUT.match(text, begin):  # a tag that the text breaks off in
            break
        else:
            at = begin + 1
            if open_:
                out.append("&lt;")
                whole = False
    if open_:
        end(0, False)
    return found


def first_element(text: str | None) -> str | None:
    """The first element of a text, mended; null where there is none."""
    found = elements(text)
    return found[0][0] if found else None
