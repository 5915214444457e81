"""MDX to Markdown in one pass over a text, for use in tasks.

A stack holds the tags that are open, each with what it holds so far; fences, code spans and escapes go through
as they are, expressions end at their own brace, and nothing is executed: literals are read, everything
else is left out with a warning. What is written carries its place in the source along, so that Markdown
can be traced back.
"""

from __future__ import annotations

import html
import json
import re
from typing import Any, NamedTuple

_FRONT = re.compile(r"---[ \t]*\n(?:.*?\n)?---[ \t]*(?:\n|\Z)", re.S)
_NEXT = re.compile(r"^(?:[ \t]*(?:>|[-*+]|\d+[.)])(?=[ \t]))*[ \t]*(?P<fence>`{3,}(?=[^`\n]*$)|~{3,})|^(?P<module>import|export)\b|(?P<ticks>`+)|(?P<escape>\\[!-/:-@\[-`{-~])|(?P<brace>\{)|(?P<tag><)", re.M)
_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
_PLAIN = re.compile(r"[^\s\"'=<>`]+")
_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_NUMBER = re.compile(r"0[xX][0-9A-Fa-f]+|(?:\d[\d_]*(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?")
_KEY = re.compile(r"[A-Za-z_$][\w$]*")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}
_SPECIAL = re.compile(r"[\\`*_{}\[\]<>|#]")
#: Tags that only lay out, those whose text a static value may hold, and HTML tags without an end.
LAYOUT, STYLED = {"div", "span", "details"}, {"span", "br", "strong", "b", "em", "i", "code"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "cite", "code", "em", "font", "i", "label", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "div", "dl", "fieldset", "figure", "footer", "form", "head", "header", "html", "main", "nav", "ol", "pre", "section", "table", "title", "ul", *(f"h{n}" for n in range(1, 7))}
CLOSED_BY = {"p": BLOCKS | {"p"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
#: The columns of a table of fields that names none.
COLUMNS = [{"key": "name", "label": "名称"}, {"key": "type", "label": "类型"}, {"key": "required", "label": "是否必须"}, {"key": "defaultValue", "label": "默认值"}, {"key": "description", "label": "备注"}, {"key": "extra", "label": "其他信息"}]


class Dynamic(Exception):
    """An expression that isn't a literal."""


class Malformed(Exception):
    """Text that isn't MDX, at a place."""

    def __init__(self, at: int, reason: str) -> None:
        super().__init__(reason)
        self.at, self.reason = at, reason


class Piece(NamedTuple):
    """Written text, and what part of the source it stands for."""

    text: str
    start: int
    end: int


class Normalized(NamedTuple):
    pieces: list[Piece]
    warnings: list[tuple[int, str]]
    error: tuple[int, str] | None


def end_of_braces(text: str, at: int) -> int:
    """The place after the brace that closes the one at ``at``; strings, templates and comments hold none."""
    stack, k = [], at
    while k < len(text):
        c = text[k]
        if stack and stack[-1] == "`":
            if c == "\\":
                k += 1
            elif c == "`":
                stack.pop()
            elif text.startswith("${", k):
                stack.append("{")
                k += 1
        elif c in "\"'" and (m := _STRING.match(text, k)):
            k = m.end() - 1
        elif c == "/" and (m := _COMMENT.match(text, k)):
            k = m.end() - 1
        elif c == "`":
            stack.append(c)
        elif c in "{[(":
            stack.append(c)
        elif c in "}])":
            if not stack or "{[(".index(stack.pop()) != "}])".index(c):
                break
            if not stack:
                return k + 1
        k += 1
    raise Malformed(at, "an expression has no end")


class _Literal:
    """A literal of a JavaScript expression: strings, numbers with signs, true, false, null, arrays, objects with plain
    keys, templates without values, and text in tags that only style it."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def blanks(self) -> str:
        while True:
            while self.at < len(self.text) and self.text[self.at].isspace():
                self.at += 1
            if not (m := _COMMENT.match(self.text, self.at)):
                return self.text[self.at : self.at + 1]
            self.at = m.end()

    def take(self, mark: str) -> bool:
        self.blanks()
        if self.text.startswith(mark, self.at):
            self.at += len(mark)
            return True
        return False

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise Dynamic

    def match(self, pattern: re.Pattern) -> str | None:
        self.blanks()
        if m := pattern.match(self.text, self.at):
            self.at = m.end()
            return m.group()
        return None

    def value(self) -> Any:
        c = self.blanks()
        if c in "+-" and c:
            self.at += 1
            number = self.value()
            if isinstance(number, bool) or not isinstance(number, int | float):
                raise Dynamic
            return -number if c == "-" else number
        if c in "\"'" and c:
            return self.string()
        if c == "`":
            stop = re.compile(r"(?:\\.|[^`\\])*", re.S).match(self.text, self.at + 1).end()
            inner, self.at = self.text[self.at + 1 : stop], stop + 1
            if "${" in inner:
                raise Dynamic
            return _unescaped(inner)
        if c == "[":
            self.at += 1
            out = []
            while not self.take("]"):
                out.append(self.value())
                if not self.take(","):
                    self.need("]")
                    break
            return out
        if c == "{":
            self.at += 1
            fields = {}
            while not self.take("}"):
                key = self.string() if self.blanks() in "\"'" else self.match(_KEY) or self.match(_NUMBER)
                if key is None:
                    raise Dynamic
                self.need(":")
                fields[key] = self.value()
                if not self.take(","):
                    self.need("}")
                    break
            return fields
        if c == "(":
            self.at += 1
            inner = self.value()
            self.need(")")
            return inner
        if c == "<":
            return self.styled()
        if word := self.match(_KEY):
            if word not in ("true", "false", "null"):
                raise Dynamic
            return {"true": True, "false": False}.get(word)
        if number := self.match(_NUMBER):
            number = number.replace("_", "")
            value = int(number, 16) if number[:2].lower() == "0x" else float(number)
            return int(value) if value == int(value) else value
        raise Dynamic

    def string(self) -> str:
        if not (found := self.match(_STRING)):
            raise Dynamic
        return _unescaped(found[1:-1])

    def styled(self) -> str:
        """The text in a tag; values in braces must be literals too."""
        self.need("<")
        name = self.match(_KEY) or ""
        if name and name not in STYLED:
            raise Dynamic
        while self.blanks() not in "/>":
            if self.match(_NAME) is None:
                raise Dynamic
            if self.take("="):
                if self.blanks() == "{":
                    self.at = end_of_braces(self.text, self.at)
                else:
                    self.string()
        if self.take("/"):
            self.need(">")
            return "\n" if name == "br" else ""
        self.need(">")
        out = []
        while not self.text.startswith("</", self.at):
            if self.at >= len(self.text):
                raise Dynamic
            if self.text[self.at] == "<":
                out.append(self.styled())
            elif self.text[self.at] == "{":
                stop = end_of_braces(self.text, self.at)
                inner, self.at = static_value(self.text[self.at + 1 : stop - 1]), stop
                if isinstance(inner, list | dict):
                    raise Dynamic
                out.append("" if inner is None or isinstance(inner, bool) or inner is NOTHING else shown(inner))
            else:
                stop = re.compile(r"[^<{]*").match(self.text, self.at).end()
                out.append(html.unescape(self.text[self.at : stop]))
                self.at = stop
        self.at += 2
        if (self.match(_KEY) or "") != name:
            raise Dynamic
        self.need(">")
        return "\n" if name == "br" else "".join(out)


def _unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        c = m.group(1)
        return chr(int(c[1:].strip("{}"), 16)) if c[0] in "ux" and len(c) > 1 else _ESCAPES.get(c, c)

    return re.sub(r"\\(u\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|.)", one, text, flags=re.S)


#: What an expression without a value (a comment) has.
NOTHING = object()


def static_value(expression: str) -> Any:
    """The value of a literal, NOTHING of comments; anything else raises Dynamic."""
    reader = _Literal(expression)
    if not reader.blanks():
        return NOTHING
    try:
        value = reader.value()
    except (Malformed, RecursionError) as e:
        raise Dynamic from e
    if reader.blanks():
        raise Dynamic
    return value


def shown(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")) if isinstance(value, list | dict) else str(value)


def field_rows(rows: Any, columns: Any = None) -> list[list[str]]:
    """A table of nested fields, its labels first: a row for each field, children after their parent, named by their
    whole path. Cells are Markdown."""
    columns = COLUMNS if columns is None else columns
    if not isinstance(rows, list) or not isinstance(columns, list) or not columns or not all(isinstance(c, dict) and isinstance(c.get("key"), str) and isinstance(c.get("label"), str) for c in columns):
        raise Dynamic
    out = [[c["label"] for c in columns]]
    todo = [(row, "") for row in reversed(rows)]
    while todo:
        row, parent = todo.pop()
        if not isinstance(row, dict) or not isinstance(children := row.get("children", []), list):
            raise Dynamic
        name = row.get("name")
        path = ".".join(x for x in (parent, name if isinstance(name, str) else "") if x)
        out.append([f"`{path}`" if c["key"] == "name" else "" if row.get(c["key"]) is None else shown(row[c["key"]]) for c in columns])
        todo += [(child, path) for child in reversed(children)]
    return out


def table_lines(rows: list[list[str]]) -> str:
    """Rows of cells as a Markdown table, the first being its head; short ones are filled up."""
    width = max(map(len, rows))
    cell = lambda x: re.sub(r"(?<!\\)\|", r"\\|", re.sub(r"\s*\\?\n\s*", " ", x.strip()))
    lines = ["| " + " | ".join([*map(cell, r), *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


class _Tag:
    def __init__(self, name: str, attributes: dict[str, Any], at: int, own_line: bool) -> None:
        self.name, self.attributes, self.at, self.own_line = name, attributes, at, own_line
        self.pieces: list[Piece] = []
        self.rows: list[list[str]] = []


class _Normalizer:
    def __init__(self, text: str, lenient: bool) -> None:
        self.text, self.lenient = text, lenient
        self.stack = [_Tag("", {}, 0, True)]
        self.warnings: list[tuple[int, str]] = []

    def write(self, text: str, start: int, end: int) -> None:
        if text:
            self.stack[-1].pieces.append(Piece(text, start, end))

    def run(self) -> Normalized:
        text = self.text
        at = self.body = m.end() if (m := _FRONT.match(text)) else 0
        try:
            while at < len(text):
                m = _NEXT.search(text, at)
                if not m:
                    break
                begin = m.start(m.lastgroup)
                if m.lastgroup == "module" and not (self._block_begins(begin) and len(self.stack) == 1):
                    self.write(text[at : m.end()], at, m.end())
                    at = m.end()
                    continue
                self.write(text[at:begin], at, begin)
                at = getattr(self, f"_{m.lastgroup}")(m, begin)
            self.write(text[at:], at, len(text))
            while len(self.stack) > 1:
                if not self.lenient:
                    raise Malformed(self.stack[-1].at, "a tag has no end")
                self.close(len(text))
        except Malformed as e:
            return Normalized([], self.warnings, (e.at, e.reason))
        return Normalized(_tidied(self.stack[0].pieces, self.lenient), self.warnings, None)

    def _block_begins(self, at: int) -> bool:
        """Whether a page's program may begin here: first in the text, or after an empty line."""
        line = self.text.rfind("\n", self.body, max(at - 1, self.body)) + 1
        return not self.lenient and (at == self.body or not self.text[max(line, self.body) : at].strip())

    def _fence(self, m: re.Match, begin: int) -> int:
        marks = m.group("fence")
        close = re.compile(rf"^[ \t>]*{marks[0]}{{{len(marks)},}}[ \t]*$", re.M).search(self.text, m.end())
        line = self.text.find("\n", m.end())
        end = close.end() if close and close.start() > line >= 0 else len(self.text)
        self.write(self.text[begin:end], begin, end)
        return end

    def _module(self, m: re.Match, begin: int) -> int:
        """An import or export, up to a blank line outside of its braces."""
        k = begin
        while k < len(self.text) and not re.compile(r"\n[ \t]*(?:\n|\Z)").match(self.text, k):
            k = end_of_braces(self.text, k) if self.text[k] in "{(" else (s.end() if self.text[k] in "\"'" and (s := _STRING.match(self.text, k)) else k + 1)
        return k

    def _ticks(self, m: re.Match, begin: int) -> int:
        size = len(m.group())
        for x in re.compile(r"`+|\n[ \t]*\n").finditer(self.text, m.end()):
            if x.group()[0] == "\n":
                break
            if len(x.group()) == size:
                self.write(self.text[begin : x.end()], begin, x.end())
                return x.end()
        self.write(m.group(), begin, m.end())
        return m.end()

    def _escape(self, m: re.Match, begin: int) -> int:
        self.write(m.group(), begin, m.end())
        return m.end()

    def _brace(self, m: re.Match, begin: int) -> int:
        if self.lenient:
            self.write("{", begin, begin + 1)
            return begin + 1
        end = end_of_braces(self.text, begin)
        try:
            value = static_value(self.text[begin + 1 : end - 1])
            if isinstance(value, list | dict):
                raise Dynamic
            if value is not NOTHING and value is not None and not isinstance(value, bool):
                self.write(_SPECIAL.sub(r"\\\g<0>", shown(value)), begin, end)
        except Dynamic:
            self.warnings.append((begin, "an expression isn't static, its text is left out"))
        return end

    def _tag(self, m: re.Match, begin: int) -> int:
        text, k = self.text, begin + 1
        if self.lenient and (skipped := re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?", re.S).match(text, begin)):
            return skipped.end()
        closing = text.startswith("/", k)
        k += closing
        name = _NAME.match(text, k)
        k = name.end() if name else k
        if not name and text[k : k + 1] != ">":
            if not self.lenient:
                raise Malformed(begin, "a tag has no name")
            self.write("<", begin, begin + 1)
            return begin + 1
        name = name.group() if name else ""
        name = name.lower() if self.lenient else name
        attributes, k, alone = self._attributes(k, begin)
        line = text.rfind("\n", 0, begin) + 1
        own_line = not text[line:begin].strip(" \t")
        if closing:
            self._end(name, begin, k)
            return k
        if name in ("script", "style"):
            stop = None if alone else re.compile(rf"</{name}\s*>", re.I).search(text, k)
            if not alone and not stop and not self.lenient:
                raise Malformed(begin, "a tag has no end")
            if not self.lenient:
                self.warnings.append((begin, "a script or style is left out"))
            return k if alone else stop.end() if stop else len(text)
        if self.lenient:
            # What a block or an item leaves open ends where the next one begins.
            ends = next((k for k, t in enumerate(self.stack[1:], 1) if name in CLOSED_BY.get(t.name, ()) and all(x.name in INLINE for x in self.stack[k + 1 :])), None)
            while ends is not None and len(self.stack) > ends:
                self.close(begin)
        if name == "tr" and (table := self._table()):
            table.rows.append([])
        self.stack.append(_Tag(name, attributes, begin, own_line))
        if alone or (self.lenient and name in VOID):
            self.close(k)
        return k

    def _attributes(self, k: int, begin: int) -> tuple[dict[str, Any], int, bool]:
        """A tag's attributes (true without a value, Dynamic for what isn't static), its end, and whether it ends itself."""
        text, out = self.text, {}
        while True:
            k = re.compile(r"\s*").match(text, k).end()
            if k >= len(text):
                raise Malformed(begin, "a tag isn't closed")
            if text.startswith("/>", k):
                return out, k + 2, True
            if text[k] == ">":
                return out, k + 1, False
            if text[k] == "{" and not self.lenient:
                k = end_of_braces(text, k)
                continue
            m = _NAME.match(text, k)
            if not m:
                if not self.lenient:
                    raise Malformed(k, "a tag has an attribute without a name")
                k += 1
                continue
            name, k = m.group(), m.end()
            if not (equals := re.compile(r"\s*=\s*").match(text, k)):
                out.setdefault(name, True)
                continue
            k = equals.end()
            if text[k : k + 1] in ("'", '"'):
                stop = text.find(text[k], k + 1)
                if stop < 0:
                    raise Malformed(begin, "an attribute has no end")
                out.setdefault(name, html.unescape(text[k + 1 : stop]))
                k = stop + 1
            elif text[k : k + 1] == "{" and not self.lenient:
                stop = end_of_braces(text, k)
                try:
                    value = static_value(text[k + 1 : stop - 1])
                    out.setdefault(name, None if value is NOTHING else value)
                except Dynamic:
                    out.setdefault(name, Dynamic)
                k = stop
            elif self.lenient and (m := _PLAIN.match(text, k)):
                out.setdefault(name, m.group())
                k = m.end()
            else:
                raise Malformed(k, "an attribute has no value")

    def _end(self, name: str, begin: int, end: int) -> None:
        if len(self.stack) > 1 and self.stack[-1].name == name:
            self.close(end)
        elif not self.lenient:
            raise Malformed(begin, "a closing tag doesn't fit the open one")
        elif any(t.name == name for t in self.stack[1:]):
            while self.stack[-1].name != name:
                self.close(begin)
            self.close(end)

    def _table(self) -> _Tag | None:
        return next((t for t in reversed(self.stack) if t.name == "table"), None)

    def attribute(self, tag: _Tag, name: str) -> Any:
        value = tag.attributes.get(name)
        if value is Dynamic:
            self.warnings.append((tag.at, f"attribute {name} isn't static"))
            return None
        return value

    def close(self, end: int) -> None:
        """Ends the innermost tag: what it holds becomes Markdown in the tag around it."""
        tag = self.stack.pop()
        name, inner, at = tag.name, tag.pieces, tag.at
        put = lambda before, pieces, after="": [Piece(before, at, at), *pieces, Piece(after, end, end)]
        block = tag.own_line and not self.text[end:].split("\n", 1)[0].strip(" \t") if end < len(self.text) else tag.own_line
        apart = "\n\n" if block else ""
        if name in ("td", "th") and (table := self._table()):
            if not table.rows:
                table.rows.append([])
            table.rows[-1].append("".join(p.text for p in _inline(inner)))
            return
        if name == "table":
            out = put("\n\n", [Piece(table_lines(tag.rows), at, end)], "\n\n") if tag.rows else []
        elif name == "ExpandableTable":
            out = []
            try:
                if any(tag.attributes.get(x) is Dynamic for x in ("rows", "columns")):
                    raise Dynamic
                out = put("\n\n", [Piece(table_lines(field_rows(tag.attributes.get("rows"), tag.attributes.get("columns"))), at, end)], "\n\n")
            except Dynamic:
                self.warnings.append((at, "a table of fields isn't static"))
        elif name in ("ZoomImage", "img"):
            source, alt = self.attribute(tag, "src"), self.attribute(tag, "alt")
            out = [Piece(f"{apart}![{alt if isinstance(alt, str) else ''}]({_url(source)}){apart}", at, end)] if isinstance(source, str) else []
            if not out:
                self.warnings.append((at, "an image has no static source"))
        elif name == "br":
            line = self.text[self.text.rfind("\n", 0, at) + 1 : at].lstrip()
            out = [Piece(" " if line.startswith("|") else "\n" if self.lenient else "\\\n", at, end)]
        elif name in ("Download", "a"):
            href = self.attribute(tag, "href")
            if isinstance(href, str):
                out = put(f"{apart}[", _inline(inner), f"]({_url(href)}){apart}")
            else:
                out = inner
                self.warnings.append((at, "a link has no static target"))
        elif name == "Callout":
            title = self.attribute(tag, "title")
            held = _prefixed(_trimmed(inner), "> ")
            head = [Piece(f"**{title}**", at, at), *([Piece("\n>\n> ", at, at)] if held else [])] if isinstance(title, str) else []
            out = put("\n\n> ", [*head, *held], "\n\n")
        elif re.fullmatch("h[1-6]", name):
            out = put("\n\n" + "#" * int(name[1]) + " ", _inline(inner), "\n\n")
        elif name in ("p", "summary"):
            out = put("\n\n", _trimmed(inner) if self.lenient else _inline(inner), "\n\n")
        elif name in ("strong", "b", "em", "i"):
            mark = "**" if name in ("strong", "b") else "*"
            held = _inline(inner)
            out = put(mark, held, mark) if held else []
        elif self.lenient and name == "li":
            out = put("\n- ", _trimmed(inner))
        else:
            known = name in LAYOUT or name in ("thead", "tbody", "tfoot", "tr") and self._table()
            if name and not known and not self.lenient:
                self.warnings.append((at, f"component {name} isn't known, what it holds is kept"))
            block = name in BLOCKS if self.lenient else block
            out = put("\n\n", inner, "\n\n") if block else inner
        self.stack[-1].pieces += [p for p in out if p.text]


def _url(url: str) -> str:
    return f"<{url}>" if re.search(r"[\s()]", url) else url


def _trimmed(pieces: list[Piece]) -> list[Piece]:
    """Without white space at both ends."""
    out = [p for p in pieces if p.text]
    while out and not out[0].text.strip():
        out.pop(0)
    while out and not out[-1].text.strip():
        out.pop()
    if out:
        p = out[0]
        cut = len(p.text) - len(p.text.lstrip())
        out[0] = _part(p, cut, len(p.text))
        out[-1] = _part(out[-1], 0, len(out[-1].text.rstrip()))
    return out


def _part(p: Piece, a: int, b: int) -> Piece:
    return Piece(p.text[a:b], p.start + a, p.start + b) if len(p.text) == p.end - p.start else Piece(p.text[a:b], p.start, p.end)


def _prefixed(pieces: list[Piece], mark: str) -> list[Piece]:
    """With ``mark`` before each line but the first, without blanks at the end of empty ones."""
    out: list[Piece] = []
    lines = [_part(p, m.start(), m.end()) for p in pieces for m in re.finditer(r"[^\n]*\n|[^\n]+", p.text)]
    for p, after in zip(lines, [*lines[1:], None], strict=True):
        out.append(p)
        if p.text.endswith("\n"):
            out.append(Piece(mark.rstrip() if after and after.text == "\n" else mark, p.end, p.end))
    return out


def _inline(pieces: list[Piece]) -> list[Piece]:
    """On one line: line ends, and blanks around them, become one blank."""
    out = []
    for p in _trimmed(pieces):
        at = 0
        for m in re.finditer(r"[ \t]*\\?\n\s*", p.text):
            out += [_part(p, at, m.start()), Piece(" ", p.start, p.end)]
            at = m.end()
        out.append(_part(p, at, len(p.text)))
    return [p for p in out if p.text]


def _tidied(pieces: list[Piece], lenient: bool) -> list[Piece]:
    """At most one empty line in a row outside of fences, no white space at both ends; in HTML, entities read."""
    out: list[Piece] = []
    breaks = 2
    for p in pieces:
        if re.match(r"`{3,}|~{3,}", p.text) and "\n" in p.text and len(p.text) == p.end - p.start:
            out.append(p)
            breaks = 0
            continue
        at = 0
        for m in re.finditer(r"[ \t]*\n(?:[ \t]*(?=\n))?" if lenient else r"\n", p.text):
            if m.start() > at:
                breaks = 0
            if breaks < 2:
                out.append(_part(p, at, m.start()))
                out.append(Piece("\n", *_part(p, m.end() - 1, m.end())[1:]))
                breaks += 1
            at = m.end()
        if at < len(p.text):
            rest = _part(p, at, len(p.text))
            if rest.text.strip(" \t"):
                breaks = 0
            out.append(rest)
    if lenient:
        out = [p._replace(text=html.unescape(p.text)) if "&" in p.text else p for p in out]
    return _joined(_trimmed(out))


def _joined(pieces: list[Piece]) -> list[Piece]:
    """Pieces that follow one another here and in the source, as they are, as one."""
    out: list[Piece] = []
    for p in pieces:
        exact = len(p.text) == p.end - p.start
        if out and exact and out[-1].end == p.start and len(out[-1].text) == out[-1].end - out[-1].start and out[-1].text and p.text:
            out[-1] = Piece(out[-1].text + p.text, out[-1].start, p.end)
        elif p.text:
            out.append(p)
    return out


def normalize(text: str, lenient: bool = False) -> Normalized:
    """A text's Markdown in pieces, warnings (place, reason), and the error that kept it from being read, if any.
    ``lenient`` reads HTML: braces are text, tags may be left open, entities are read."""
    return _Normalizer(text, lenient).run()
