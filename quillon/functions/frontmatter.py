"""Front matter of pages: the part of YAML that page headers use, as a map of strings.

Scalars are plain, quoted, literal or folded; values may be lists or one level of keys, in
block or flow form.  Values keep their text, so ``20`` and ``2024-01-01`` are what is written;
null values are null.  A list is JSON text, a nested key is written ``parent.child``.  A
header that is not a mapping, or not in this part of YAML, is malformed and gives an empty map.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\-?:,\[\]{}#&*!|>'"%@`][^#:]*?|[\-?:](?=[^\s])[^#:]*?)\s*:(?:\s+|$)(.*)""")
_BLOCK = re.compile(r"([|>])([+-]?)([1-9]?)([+-]?)\s*(?:#.*)?")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "v": "\v", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
_NULLS = {"", "~", "null", "Null", "NULL"}


class Malformed(ValueError):
    pass


def _unquoted(text: str) -> str:
    """The value of one quoted scalar, quotes included in ``text``; a line break in it is a space."""
    body = re.sub(r"[ \t]*\n[ \t]*", lambda m: " ", text[1:-1])
    if text[0] == "'":
        return body.replace("''", "'")

    def escaped(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1][1:], 16))
        if m[2] not in _ESCAPES and m[2] not in '"/\\ ':
            raise Malformed(m[0])
        return _ESCAPES.get(m[2], m[2])

    return re.sub(r"\\(x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})|\\(.)", escaped, body)


def _plain(text: str) -> str | None:
    """A plain scalar without its comment."""
    text = re.sub(r"(?:^|\s)#.*", "", text).strip()
    if text[:1] in tuple("[]{},&*!|>'\"%@`") and text or re.search(r":(?:\s|$)", text) or re.match(r"[-?](?:\s|$)", text):
        raise Malformed(text)
    return None if text in _NULLS else text


class _Flow:
    """A flow list or mapping on one line (or joined lines)."""

    _TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')|([\[\]{},])|(:)(?=\s|[\[\]{},"']|$)|((?:[^\[\]{},:#"'\s]|:(?=[^\s,\[\]{}])|(?<=\S)#|(?<=\S)["'])(?:[^\[\]{},:]|:(?=[^\s,\[\]{}]))*))""")

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            if re.match(r"\s+#", text[at:]) and self._closed():
                break
            m = self._TOKEN.match(text, at)
            if not m or m.end() == at:
                raise Malformed(text)
            self.tokens.append(("q", _unquoted(m[1])) if m[1] else ("m", m[2] or m[3]) if m[2] or m[3] else ("p", _plain(m[4])))
            at = m.end()
        self.at = 0

    def _closed(self) -> bool:
        depth = sum({"[": 1, "{": 1, "]": -1, "}": -1}.get(v, 0) for k, v in self.tokens if k == "m")
        return depth == 0

    def _peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def _take(self, mark: str | None = None):
        kind, value = self._peek()
        if kind is None or mark and (kind, value) != ("m", mark):
            raise Malformed(str(value))
        self.at += 1
        return kind, value

    def value(self):
        kind, value = self._take()
        if kind != "m":
            return value
        out = [] if value == "[" else {} if value == "{" else None
        if out is None:
            raise Malformed(value)
        end = "]" if value == "[" else "}"
        while self._peek() != ("m", end):
            item = self.value()
            if end == "}":
                key, item = item, None
                if self._peek() == ("m", ":"):
                    self._take()
                    item = None if self._peek() in (("m", ","), ("m", "}")) else self.value()
                out[_key(key)] = item
            else:
                out.append(item)
            if self._peek() != ("m", end):
                self._take(",")
        self._take(end)
        return out

    def whole(self):
        got = self.value()
        if self.at != len(self.tokens):
            raise Malformed("more after the end")
        return got


def _key(value) -> str:
    if isinstance(value, (list, dict)):
        raise Malformed("a key that is no scalar")
    return "null" if value is None else value


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _blank(line: str) -> bool:
    return not line.strip() or line.lstrip().startswith("#")


class _Lines:
    """Block form: nested lines are those indented further."""

    def __init__(self, text: str):
        self.lines, self.at = text.split("\n"), 0

    def _skip(self) -> str | None:
        while self.at < len(self.lines) and _blank(self.lines[self.at]):
            self.at += 1
        if self.at == len(self.lines):
            return None
        line = self.lines[self.at]
        if line[_indent(line) :].startswith("\t"):
            raise Malformed("a tab as indentation")
        return line

    def node(self, indent: int):
        """The mapping, list or scalar whose lines start at ``indent``."""
        line = self._skip()
        if re.match(r" *-(?: |$)", line):
            return self._list(indent)
        if _KEY.fullmatch(line.strip()):
            return self._mapping(indent)
        text = line.strip()
        self.at += 1
        return self._scalar(text, indent - 1)

    def _mapping(self, indent: int) -> dict:
        out: dict = {}
        while (line := self._skip()) is not None and _indent(line) >= indent:
            m = _KEY.fullmatch(line.strip())
            if _indent(line) != indent or not m:
                raise Malformed(line)
            key = _unquoted(m[1]) if m[1][0] in "\"'" else m[1]
            self.at += 1
            out[key] = self._value(m[2], indent, lists_at=indent)
        return out

    def _list(self, indent: int) -> list:
        out = []
        while (line := self._skip()) is not None and _indent(line) >= indent:
            m = re.fullmatch(r" *-(?: +(.*)|)", line.rstrip())
            if _indent(line) != indent or not m:
                if _indent(line) == indent:
                    break
                raise Malformed(line)
            rest = m[1] or ""
            if rest and _KEY.fullmatch(rest.strip()) and rest[0] not in "[{":
                # a mapping that begins behind the dash
                inner = line.index(rest, indent + 1)
                self.lines[self.at] = " " * inner + rest
                out.append(self._mapping(inner))
            else:
                self.at += 1
                out.append(self._value(rest, indent, lists_at=indent + 1))
        return out

    def _value(self, rest: str, indent: int, lists_at: int):
        if rest and not rest.lstrip().startswith("#"):
            return self._scalar(rest, indent)
        line = self._skip()
        if line is None or _indent(line) < lists_at or _indent(line) == indent and not re.match(r" *-(?: |$)", line):
            return None
        return self.node(_indent(line))

    def _more(self, indent: int) -> list[str]:
        """Lines that go on with a scalar: blank ones and those indented further."""
        out = []
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or _indent(self.lines[self.at]) > indent):
            out.append(self.lines[self.at])
            self.at += 1
        return out

    def _scalar(self, rest: str, indent: int):
        rest = rest.strip()
        if m := _BLOCK.fullmatch(rest):
            return self._block(m[1], m[2] or m[4], int(m[3] or 0), indent)
        if rest[0] in "\"'":
            text, close = rest, re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')\s*(?:\s#.*)?""", re.S)
            while not (m := close.fullmatch(text)):
                if self.at == len(self.lines) or self.lines[self.at].strip() and _indent(self.lines[self.at]) <= indent:
                    raise Malformed(text)
                text += "\n" + self.lines[self.at]
                self.at += 1
            return _unquoted(m[1])
        if rest[0] in "[{":
            return _Flow(" ".join([rest, *(x.strip() for x in self._more(indent))])).whole()
        more = [x.strip() for x in self._more(indent) if not _blank(x)]
        if more and re.search(r"\s#", rest):
            raise Malformed("a scalar that goes on after a comment")
        return _plain(" ".join([rest, *more]))

    def _block(self, style: str, chomp: str, depth: int, indent: int) -> str:
        lines = self._more(indent)
        inner = max(indent, 0) + depth if depth else next((_indent(x) for x in lines if x.strip()), 0)
        if any(_indent(x) < inner for x in lines if x.strip()):
            raise Malformed("a line of a text block that is indented less than the first")
        text, last, empty = "", "", 0
        for x in lines:
            if not x.strip():
                empty += 1
                continue
            x = x[inner:]
            if not text and not last:
                text = "\n" * empty
            elif style == ">" and last[0] != " " and x[0] != " ":
                text += "\n" * empty or " "
            else:
                text += "\n" * (empty + 1)
            text, last, empty = text + x, x, 0
        if chomp == "-" or not last:
            return text
        # a header's last line has no break after it
        breaks = empty + (self.at < len(self.lines))
        return text + "\n" * (breaks if chomp == "+" else min(1, breaks))


def parse(header: str) -> dict[str, str | None]:
    """The header's keys and values; empty for a malformed one."""
    try:
        lines = _Lines(header.replace("\r\n", "\n"))
        first = lines._skip()
        got = lines.node(_indent(first)) if first is not None else {}
        if lines._skip() is not None or not isinstance(got, dict):
            return {}
    except Malformed:
        return {}
    out: dict[str, str | None] = {}
    for key, value in got.items():
        if isinstance(value, dict):
            out |= {f"{key}.{k}": _text(v) for k, v in value.items()}
        else:
            out[key] = _text(value)
    return out


def _text(value) -> str | None:
    return json.dumps(value, ensure_ascii=False) if isinstance(value, (list, dict)) else value


def header_map(header: Column) -> Column:
    """map<string,string> of a header's text; empty for a malformed or null one."""

    @F.pandas_udf("array<struct<key:string,value:string>>")
    def entries(headers: pd.Series) -> pd.Series:
        return headers.map(lambda h: [{"key": k, "value": v} for k, v in parse(h).items()] if h else [])

    return F.map_from_entries(entries.asNondeterministic()(header))
