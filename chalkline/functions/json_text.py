"""Repair of JSON that a model wrote: one pass over the text that keeps what it says and mends how it says it.

Mended are missing, doubled and trailing commas, missing colons and values,
single, curly and missing quotes, quotes inside of texts, bare words, words of
other languages for true, false and null, comments, escapes that JSON doesn't
have, brackets that are missing or of the wrong kind, and text that breaks off.
Text before the first bracket and after the last one goes.
"""

from __future__ import annotations

import json
import re

#: Digits that Python reads as a number; more are kept as a text.
LONGEST_INT = 4300
QUOTES = {'"': '"', "'": "'", "“": "”\"", "”": "”\"", "‘": "’'", "`": "`'"}
WORDS = {"true": "true", "false": "false", "null": "null", "none": "null", "undefined": "null", "nan": "NaN", "infinity": "Infinity", "-infinity": "-Infinity"}

_SKIP = re.compile(r"(?:[\s\ufeff]+|//[^\n]*|/\*.*?(?:\*/|\Z)|#[^\n]*)*+", re.S)
_COLON = re.compile(r"\s*+[:=]")
_HALF_KEY = re.compile(r"[^:\n\"]++(?=:)")
_BLANK = re.compile(r"\s*+")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?")
_BARE = re.compile(r"[^,\]}\n]*+")
_BARE_KEY = re.compile(r"[^\s:=,{}\[\]\"']++")
_ESCAPE = re.compile(r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})')
_KEY_NEXT = re.compile(r"""["'“”‘][^"'“”‘’\n]*+["'“”’]\s*+:|[A-Za-z_]\w*+\s*+:""")
_TEXT_NEXT = re.compile(r"""["'“”‘][^"'“”‘’\n]*+["'“”’]\s*+(?:[,\]]|\Z)""")
_ITEM_NEXT = re.compile(r"""["'“”‘{\[\]]|-?\d|\Z|(?:true|false|null|True|False|None)\b""")
_OBJECTS_GO_ON = re.compile(r"\s*+\}\s*+,\s*+\{")
_COMMA = re.compile(r"\s*+,\s*+[\"{\[]")
_STARTS = re.compile(r"""\[\s*+(?:[{\["'“\]]|-?\d|true|false|null|\Z)|\{""")


class _Repair:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.out: list[str] = []
        self.open: list[str] = []  # closing brackets of what is open
        self.filled: list[bool] = []
        self.key: str | None = None

    def run(self) -> str:
        state, loose = "value", False
        while True:
            self.at = _SKIP.match(self.text, self.at).end()
            if self.at >= len(self.text):
                break
            c = self.text[self.at]
            if c in "}]" and self.open:
                if state in ("colon", "value") and self.key is not None:
                    self._put("null")
                self._close(c)
                if not self.open:
                    break
                state, loose = "end", False
            elif c in ",;":
                if state in ("colon", "value") and self.key is not None:
                    self._put("null")
                self.at += 1
                state, loose = self._next(), False
            elif state == "end":
                if c in ":=":
                    self.at += 1
                else:  # a comma is missing
                    state, loose = self._next(), True
            elif state == "key":
                state = self._read_key(c)
            elif state == "colon":
                if c in ":=":
                    self.at += 2 if self.text.startswith("=>", self.at) else 1
                state = "value"
            elif c in "{[":
                self._put(c)
                self.open.append("}" if c == "{" else "]")
                self.filled.append(False)
                self.at += 1
                state, loose = self._next(), False
            else:
                self._read_value(c, loose)
                state, loose = "end", False
        self.out += reversed(self.open)
        return "".join(self.out)

    def _next(self) -> str:
        return "key" if self.open[-1] == "}" else "value"

    def _put(self, value: str) -> None:
        """A member of what is open, or the whole."""
        if self.open:
            if self.filled[-1]:
                self.out.append(", ")
            self.filled[-1] = True
        if self.key is not None:
            self.out += [self.key, ": "]
            self.key = None
        self.out.append(value)

    def _close(self, c: str) -> None:
        """A bracket closes what it fits, with all inside of that; one that fits nothing closes the innermost.

        One after which objects go on is surplus, and so is one that ends the whole before a comma.
        """
        self.at += 1
        if c != self.open[-1] and c == "]" and c in self.open and _OBJECTS_GO_ON.match(self.text, self.at):
            return
        if c in self.open and self.open.index(c) == 0 and len(self.open) - self.open[::-1].index(c) == 1 and _COMMA.match(self.text, self.at):
            if len(self.open) == 1:
                return
            c = ""  # closes the innermost only
        while c in self.open and self.open[-1] != c:
            self.out.append(self.open.pop())
            self.filled.pop()
        self.out.append(self.open.pop())
        self.filled.pop()

    def _read_key(self, c: str) -> str:
        if c in "{[":  # a value without a key
            self.key = '""'
            return "value"
        if c in QUOTES:
            begin = self.at
            if self.text[begin + 1 : begin + 2] == c and self.text[begin + 2 : begin + 3].isalnum():  # the quote is there twice
                begin = self.at = begin + 1
            known, self.key = self._string(c, key=True)
            if ":" in self.key and not _COLON.match(self.text, self.at) and (m := _HALF_KEY.match(self.text, begin + 1)):  # its second quote is missing
                self.at = m.end()
                self.key = json.dumps(m[0].rstrip(), ensure_ascii=False)
                return "colon"
            if not known:  # the text ends in it
                self.key = None
            return "colon"
        if m := _BARE_KEY.match(self.text, self.at):
            self.at = m.end()
            self.key = json.dumps(m[0], ensure_ascii=False)
            return "colon"
        self.at += 1
        return "key"

    def _read_value(self, c: str, loose: bool) -> None:
        if c in QUOTES:
            self._put(self._string(c, key=False)[1])
            return
        m = _NUMBER.match(self.text, self.at)
        after = self.text[m.end() : m.end() + 1] if m else ""
        if m and (after in ",]}" or after.isspace() or after in "/#") and not (after == "" and len(m[0]) == 0):
            self.at = m.end()
            self._put(m[0] if len(m[0]) <= LONGEST_INT else json.dumps(m[0]))
            return
        m = _BARE.match(self.text, self.at)
        said = m[0].split("//")[0].rstrip() if "//" in m[0] and "://" not in m[0] else m[0].rstrip()
        word = WORDS.get(said.lower())
        cut = m.end() >= len(self.text) and (re.fullmatch(r"-?[\d.eE+-]*", said) or any(w.startswith(said) for w in ("true", "false", "null", "True", "False", "None")))
        if word is None and not cut and loose and said[:1].isalpha() and " " in said and re.match(r"(?:true|false|null|True|False|None|-?\d[\d.eE+-]*)(?=\s)", said):
            said = re.match(r"\S+", said)[0]  # values set apart by blanks alone
            word, self.at = WORDS.get(said.lower()), self.at + len(said)
        elif word is None and (m2 := re.match(r"(-?\d+(?:\.\d+)?)\s+(?=[-\d\"'{\[])", said)):
            said, self.at = m2[1], self.at + m2.end()
            word = said
        else:
            self.at = max(m.end(), self.at + 1)
        if word is not None:
            self._put(word)
        elif not cut and not loose and said:
            self._put(json.dumps(said, ensure_ascii=False))
        else:
            self.key = None  # what the text breaks off in, or stands loose beside a value, says nothing

    def _string(self, c: str, key: bool) -> tuple[bool, str]:
        """(whether it is closed, the JSON string) of the text in quotes that begins here."""
        text, ends = self.text, QUOTES[c]
        run = re.compile(rf"[^\\{ends}]++")
        parts, at = ['"'], self.at + 1
        border: tuple[int, int] | None = None  # where a value may have ended whose quote is missing: parts, place
        while at < len(text):
            if m := run.match(text, at):
                parts.append(json.dumps(m[0], ensure_ascii=False)[1:-1])
                at = m.end()
            elif text[at] == "\\":
                if m := _ESCAPE.match(text, at):
                    parts.append(m[0])
                    at = m.end()
                elif at + 1 >= len(text) or (text[at + 1] == "u" and len(text) - at < 6 and re.fullmatch(r"u[0-9a-fA-F]*", text[at + 1 :])):
                    at = len(text)  # breaks off in an escape
                elif text[at + 1] in ends:
                    parts.append(text[at + 1])
                    at += 2
                else:
                    parts.append("\\\\")
                    at += 1
            elif key or self._closes(at):
                self.at = at + 1
                return True, "".join(parts) + '"'
            else:
                after = _BLANK.match(text, at + 1).end()
                if border and text[after : after + 1] == ":":  # this quote ended a key
                    self.at = border[1]
                    return True, "".join(parts[: border[0]]).rstrip() + '"'
                before = text[self.at : at].rstrip()[-1:] if self.open and self.open[-1] == "}" else ""
                gap = re.search(r"[,\n]\s*$", text[max(self.at, at - 64) : at]) if before == "," or text[at - 1 : at].isspace() else None
                if gap:
                    place = max(self.at, at - 64) + gap.start()
                    kept = json.dumps(text[place:at], ensure_ascii=False)[1:-1]
                    if parts[-1].endswith(kept):
                        parts[-1] = parts[-1][: len(parts[-1]) - len(kept)]
                        parts.append(kept)
                        border = (len(parts) - 1, place)
                parts.append('\\"' if text[at] == '"' else text[at])
                at += 1
        self.at = len(text)
        said = "".join(parts)
        closing = "".join(reversed(self.open))
        bare = re.sub(r"\s+", "", said[-4 * len(closing) - 8 :])
        if not key and closing and bare.endswith(closing):  # only the last quote is missing
            for b in reversed(closing):
                said = said.rstrip()
                said = said[: -len(b)].rstrip()
        return False, said + '"'

    def _closes(self, at: int) -> bool:
        """Whether the quote at this place ends a value, by what follows."""
        text = self.text
        after = _SKIP.match(text, at + 1).end()
        c = text[after : after + 1]
        within = self.open[-1] if self.open else ""
        if c in ("", "}", "]"):
            return True
        if c == ",":
            then = _SKIP.match(text, after + 1).end()
            if within == "}":
                return text[then : then + 1] in ("", "}", ",") or bool(_KEY_NEXT.match(text, then)) or not text[then : then + 1].isalnum() and bool(_ITEM_NEXT.match(text, then))
            return text[then : then + 1] in ("", ",") or bool(_ITEM_NEXT.match(text, then))
        if within == "}":
            return bool(_KEY_NEXT.match(text, after))
        return bool(_TEXT_NEXT.match(text, after)) or c in "{["


def repaired(text: str | None) -> str | None:
    """Valid JSON of what a text holds, fenced or not; null where it holds no bracket.

    Of a key that an object has twice the last value counts; half of a pair of
    surrogates becomes U+FFFD.
    """
    if text is None:
        return None
    body = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", text)
    start = _STARTS.search(body)
    if start is None:
        return None
    body = body[start.start() :]
    try:
        value = json.JSONDecoder(strict=False).raw_decode(body)[0]
    except (ValueError, RecursionError):
        mended = _Repair(body).run()
        try:
            value = json.loads(mended, strict=False)
        except RecursionError:  # nested too deeply to be read here
            return mended
    return json.dumps(value, ensure_ascii=False).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
