"""The structure of one Markdown text, for use in tasks: its blocks, the links and code spans of its lines, its
reference definitions, and its plain text.

A text is gone through once, line by line, with a stack of open containers (quotes, list items,
footnotes), each of which says whether a line goes on with it, and one open leaf (fence, HTML, table, indented
code or paragraph). So a heading counts at the level where it stands, and not inside of a fence or a comment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

_BLANK = " \t\n\x0b\x0c\r"
_ATX = re.compile(r"(#{1,6})(?=[ \t\n]|\Z)")
_CLOSING = re.compile(r"(?:^|[ \t])#+\Z")
_FENCE = re.compile(r"(`{3,})(?=[^`\n]*(?:\n|\Z))|(~{3,})")
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})(?:\n|\Z)")
_SETEXT = re.compile(r"(=+|-+)[ \t]*(?:\n|\Z)")
_ITEM = re.compile(r"([-*+]|(\d{1,9})[.)])(?=[ \t\n]|\Z)")
_NOTE = re.compile(r"\[\^([^\]\s]+)\]:")
_DELIMITERS = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*(?:\n|\Z)")
_LINES = re.compile(r"[^\n]*\n|[^\n]+\Z")
_DEFINITION = re.compile(r"[ ]{0,3}\[((?:\\.|[^\[\]\\]){1,999})\]:[ \t]*\n?[ \t]*(<(?:\\.|[^<>\\\n])*>|[^\s<]\S*)(?:[ \t]*(?:[ \t]|\n[ \t]*)(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\)))?[ \t]*(?:\n|\Z)")
#: How an HTML block begins and what ends it (None: a blank line).
_HTML = tuple(
    (re.compile(begin, re.I), re.compile(end, re.I) if end else None)
    for begin, end in (
        (r"<(?:script|pre|style|textarea)(?=[\s>]|\Z)", r"</(?:script|pre|style|textarea)>"),
        (r"<!--", r"-->"),
        (r"<\?", r"\?>"),
        (r"<![A-Z]", r">"),
        (r"<!\[CDATA\[", r"\]\]>"),
        (r"</?(?:address|article|aside|blockquote|body|center|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|p|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)(?=[\s>]|/>|\Z)", None),
        (r"(?:<[a-z][\w-]*(?:\s+[a-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^'\n]*'|\"[^\"\n]*\"))?)*\s*/?>|</[a-z][\w-]*\s*>)[ \t]*(?:\n|\Z)", None),
    )
)


@dataclass
class Block:
    """A block: kind (root, quote, list, item, footnote, heading, code, html, table, rule, definition, text), lines it
    takes up, where it begins and ends in the text (code points; blank lines after it are left out)."""

    kind: str
    line: int
    start: int
    end: int = 0
    depth: int = 0
    label: str = ""
    text: str = ""
    children: list[Block] = field(default_factory=list)

    def walk(self) -> Iterator[Block]:
        yield self
        for child in self.children:
            yield from child.walk()


class _Line:
    """A line being read: where its text goes on, and at which column."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.column, self.left = text, 0, 0, 0

    def indent(self) -> int:
        n, k = self.left, self.at
        while k < len(self.text) and self.text[k] in " \t":
            n += 1 if self.text[k] == " " else 4 - (self.column + n - self.left) % 4 if self.left == 0 else 4
            k += 1
        return n

    def skip(self, columns: int) -> None:
        """Over so many columns of blanks; a tab may be left in part."""
        while columns > 0:
            if self.left:
                self.left -= 1
                self.column += 1
                columns -= 1
            elif self.at < len(self.text) and self.text[self.at] == "\t":
                self.left = 4 - self.column % 4
                self.at += 1
            elif self.at < len(self.text) and self.text[self.at] == " ":
                self.at += 1
                self.column += 1
                columns -= 1
            else:
                return

    def past(self, characters: int) -> None:
        self.at += characters
        self.column += characters

    def rest(self) -> str:
        return " " * self.left + self.text[self.at :]

    def blank(self) -> bool:
        return not self.text[self.at :].strip(_BLANK)


class _Leaf(NamedTuple):
    """An open leaf: its block, and what ends it (a fence's marks; a pattern, or None for a blank line)."""

    block: Block
    lines: list[str]
    until: object = None
    indent: int = 0


class _Reader:
    def __init__(self) -> None:
        self.root = Block("root", 0, 0)
        self.open: list[Block] = [self.root]
        self.indents: list[int] = [0]
        self.leaf: _Leaf | None = None

    def paragraph(self) -> bool:
        return self.leaf is not None and self.leaf.block.kind == "text"

    def close_to(self, depth: int, item: bool = False) -> None:
        """Closes containers from ``depth`` on, the leaf in them, and a list unless an item comes."""
        if depth < len(self.open):
            self.end_leaf()
            del self.open[depth:], self.indents[depth:]
        if self.open[-1].kind == "list" and not item:
            self.close_to(len(self.open) - 1)

    def end_leaf(self) -> None:
        leaf, self.leaf = self.leaf, None
        if leaf:
            leaf.block.text = "".join(leaf.lines)
            if leaf.block.kind == "text":
                self._definitions(leaf.block)

    def _definitions(self, block: Block) -> None:
        """Definitions at the beginning of a paragraph become blocks of their own."""
        at, found, siblings = 0, [], self.open[-1].children
        while (m := _DEFINITION.match(block.text, at)) and m.group(1).strip(_BLANK):
            found.append(Block("definition", block.line + block.text.count("\n", 0, at), block.start, label=m.group(1), text=m.group(0)))
            at = m.end()
        if found:
            place = next(i for i in range(len(siblings) - 1, -1, -1) if siblings[i] is block)
            block.line, block.text = block.line + block.text.count("\n", 0, at), block.text[at:]
            siblings[place : place + 1] = [*found, *([block] if block.text.strip(_BLANK) else [])]

    def add(self, depth: int, block: Block, until: object = None, indent: int = 0, opens: bool = True) -> None:
        self.close_to(depth)
        self.end_leaf()
        self.open[-1].children.append(block)
        self.leaf = _Leaf(block, [block.text], until, indent) if opens else None

    def enter(self, depth: int, block: Block, indent: int = 0) -> int:
        self.close_to(depth, block.kind in ("list", "item"))
        self.end_leaf()
        self.open[-1].children.append(block)
        self.open.append(block)
        self.indents.append(indent)
        return len(self.open)

    def matched(self, line: _Line) -> int:
        """How many of the open containers the line goes on with."""
        for depth in range(1, len(self.open)):
            kind, indent = self.open[depth].kind, line.indent()
            if kind == "quote":
                if indent > 3 or line.text[line.at :].lstrip(" \t")[:1] != ">":
                    return depth
                line.skip(indent)
                line.past(1)
                line.skip(1)
            elif kind in ("item", "footnote"):
                if line.blank():
                    if kind == "item" and not self.open[depth].children:
                        return depth
                elif indent < self.indents[depth]:
                    return depth
                else:
                    line.skip(self.indents[depth])
        return len(self.open)

    def starts(self, line: _Line, depth: int, no: int, start: int) -> tuple[bool, int]:
        """Enters the containers that begin in the line, and a leaf other than a paragraph. Whether it did the
        latter, and how many containers the line is in."""
        while not line.blank():
            indent, here = line.indent(), self.paragraph() and depth == len(self.open)
            if indent > 3:
                if self.paragraph():
                    return False, depth
                if depth < len(self.open) or not (self.leaf and self.leaf.block.kind == "indented"):
                    self.add(depth, Block("indented", no, start))
                line.skip(4)
                self.leaf.lines.append(line.rest())
                return True, depth
            rest = line.text[line.at :].lstrip(" \t")
            if here and _SETEXT.match(rest):
                block = self.leaf.block
                self.end_leaf()
                if self.open[-1].children[-1] is block and block.kind == "text":
                    block.kind, block.depth, block.text = "heading", 1 if rest[0] == "=" else 2, block.text.strip(_BLANK)
                    return True, depth
            if rest[0] == ">":
                depth = self.enter(depth, Block("quote", no, start))
                line.skip(indent)
                line.past(1)
                line.skip(1)
            elif m := _ATX.match(rest):
                title = _CLOSING.sub("", rest[m.end() :].rstrip(_BLANK)).strip(" \t")
                self.add(depth, Block("heading", no, start, depth=len(m.group(1)), text=title), opens=False)
                return True, depth
            elif m := _FENCE.match(rest):
                marks = m.group(1) or m.group(2)
                self.add(depth, Block("code", no, start, label=rest[len(marks) :].strip(_BLANK)), marks, indent)
                return True, depth
            elif html := next((h for k, h in enumerate(_HTML) if h[0].match(rest) and not (k == 6 and self.paragraph())), None):
                self.add(depth, Block("html", no, start, text=line.rest()), html[1], opens=not (html[1] and html[1].search(rest)))
                return True, depth
            elif _RULE.match(rest):
                self.add(depth, Block("rule", no, start), opens=False)
                return True, depth
            elif m := _NOTE.match(rest):
                depth = self.enter(depth, Block("footnote", no, start, label="^" + m.group(1)), 4)
                line.skip(indent)
                line.past(m.end())
                line.skip(line.indent())
            elif (m := _ITEM.match(rest)) and not (here and (m.group(2) not in (None, "1") or not rest[m.end() :].strip(_BLANK))):
                self.close_to(depth, item=True)
                mark = m.group(1)[-1]
                if self.open[-1].kind == "list" and self.open[-1].label != mark:
                    self.close_to(len(self.open) - 1)
                if self.open[-1].kind != "list":
                    self.enter(len(self.open), Block("list", no, start, label=mark))
                line.skip(indent)
                line.past(m.end())
                gap = line.indent()
                gap = gap if 1 <= gap <= 4 and not line.blank() else 1
                depth = self.enter(len(self.open), Block("item", no, start, label=m.group(1)), indent + m.end() + gap)
                line.skip(gap)
            else:
                return False, depth
        return False, depth

    def read(self, text: str, no: int, start: int) -> None:
        line = _Line(text)
        depth = self.matched(line)
        leaf = self.leaf if depth == len(self.open) else None
        kind = leaf.block.kind if leaf else None
        if kind == "code":
            rest = line.text[line.at :].strip(_BLANK)
            if line.indent() < 4 and len(rest) >= len(leaf.until) and rest == leaf.until[0] * len(rest):
                self.end_leaf()
            else:
                line.skip(min(leaf.indent, line.indent()))
                leaf.lines.append(line.rest())
            return
        if kind == "html" and not (leaf.until is None and line.blank()):
            leaf.lines.append(line.rest())
            if leaf.until and leaf.until.search(text):
                self.end_leaf()
            return
        if line.blank():
            if kind == "indented":
                line.skip(4)
                leaf.lines.append(line.rest())
            else:
                if depth < len(self.open):
                    self.close_to(depth, item=True)
                self.end_leaf()
            return
        done, depth = self.starts(line, depth, no, start)
        if done or line.blank():
            return
        rest = line.text[line.at :].lstrip(" \t")
        # A paragraph goes on even where its containers don't, but for lines that define something.
        if self.paragraph() and (depth == len(self.open) or not _DEFINITION.match(rest)):
            lines = self.leaf.lines
            if depth == len(self.open) and len(lines) == 1 and "|" in lines[0] and _DELIMITERS.match(rest) and len(cells(lines[0])) == len(cells(rest)):
                self.leaf.block.kind = "table"
            lines.append(rest)
        elif kind == "table" and self.leaf is leaf:
            leaf.lines.append(rest)
        else:
            self.add(depth, Block("text", no, start, text=rest))


def cells(row: str) -> list[str]:
    """The cells of a table's row; a bar after a backslash, or in a code span that is closed, parts none."""
    row = row.strip(_BLANK)
    row = row[1:] if row.startswith("|") else row
    out, now, k = [], "", 0
    while k < len(row):
        if row[k] == "\\" and k + 1 < len(row):
            now += row[k : k + 2]
            k += 2
        elif row[k] == "|":
            out.append(now.strip(" \t"))
            now = ""
            k += 1
        else:
            now += row[k]
            k += 1
    if now.strip(" \t") or not out:
        out.append(now.strip(" \t"))
    return out


def outline(text: str) -> Block:
    """The blocks of a text, as a tree. Lines end with line feeds."""
    reader, at, starts = _Reader(), 0, []
    for no, line in enumerate(_LINES.findall(text)):
        starts.append(at)
        reader.read(line, no, at)
        at += len(line)
    reader.close_to(1)
    reader.end_leaf()
    for block in reader.root.walk():
        if block.kind == "indented":
            block.kind, block.text = "code", block.text.rstrip("\n")
        elif block.kind in ("text", "definition"):
            block.start = starts[block.line]
    reader.root.end = at
    for block in reader.root.walk():
        for child, after in zip(block.children, [*block.children[1:], None], strict=False):
            child.end = child.start + len(text[child.start : after.start if after else block.end].rstrip(_BLANK))
    return reader.root


_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+)>")
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_SPACES = re.compile(r"\s*")
_TICKS = re.compile(r"`+")
_TITLE = re.compile(r"\s+(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\))")
_LABEL = re.compile(r"\[((?:\\.|[^\[\]\\])*)\]")
_MARKS = re.compile(r"(\*\*\*|\*\*|\*|~~)(?=\S)(.+?)(?<=\S)\1|(?<!\w)(___|__|_)(?=\S)(.+?)(?<=\S)\3(?!\w)", re.S)


class Inline(NamedTuple):
    """What stands in a line besides text: kind (code, escape, tag, link, image, note), where, what it shows, and
    what it leads to: a url with a title, or the label of a definition."""

    kind: str
    start: int
    end: int
    text: str
    url: str | None = None
    title: str | None = None
    label: str | None = None


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def identifier(label: str) -> str:
    """Labels name the same whatever their case, and however much white space is in them."""
    return re.sub(r"\s+", " ", label).strip().upper()


def _target(text: str, at: int) -> tuple[str, str | None, int] | None:
    """Url, title and end of a parenthesis that begins at ``at``."""
    k = _SPACES.match(text, at + 1).end()
    if text[k : k + 1] == "<":
        stop = re.compile(r"(?:\\.|[^<>\\\n])*").match(text, k + 1).end()
        if text[stop : stop + 1] != ">":
            return None
        url, k = text[k + 1 : stop], stop + 1
    else:
        begin, level = k, 0
        while k < len(text) and not text[k].isspace():
            if text[k] == "\\" and k + 1 < len(text):
                k += 1
            elif text[k] == "(":
                level += 1
            elif text[k] == ")":
                if not level:
                    break
                level -= 1
            k += 1
        if level:
            return None
        url = text[begin:k]
    title = _TITLE.match(text, k)
    k = title.end() if title else k
    k = _SPACES.match(text, k).end()
    return (unescaped(url), unescaped(title.group(1)[1:-1]) if title else None, k + 1) if text[k : k + 1] == ")" else None


def inlines(text: str, defined: set[str] | None = None) -> list[Inline]:
    """What stands in a paragraph's text, in order of where it begins. References count where they name one of
    ``defined``, or all that have a reference's form if that is None. A link holds no link."""
    out: list[Inline] = []
    brackets: list[list] = []
    k, unclosed = 0, set()
    while k < len(text):
        c = text[k]
        if c == "\\" and (m := _ESCAPED.match(text, k)):
            out.append(Inline("escape", k, m.end(), m.group(1)))
            k = m.end()
        elif c == "`":
            m = _TICKS.match(text, k)
            size = len(m.group())
            close = None if size in unclosed else next((x for x in _TICKS.finditer(text, m.end()) if len(x.group()) == size), None)
            if close is None:
                unclosed.add(size)
            if close:
                inner = text[m.end() : close.start()].replace("\n", " ")
                inner = inner[1:-1] if inner.strip(" ") and inner[0] == inner[-1] == " " else inner
                out.append(Inline("code", k, close.end(), inner))
            k = (close or m).end()
        elif c == "<" and (m := _AUTOLINK.match(text, k)):
            out.append(Inline("link", k, m.end(), m.group(1), m.group(1) if ":" in m.group(1) else f"mailto:{m.group(1)}"))
            k = m.end()
        elif c == "<" and (m := _TAG.match(text, k)):
            out.append(Inline("tag", k, m.end(), ""))
            k = m.end()
        elif c == "[" or text.startswith("![", k):
            brackets.append([k, c == "!", True])
            k += 1 + (c == "!")
        elif c == "]" and brackets:
            begin, image, may = brackets.pop()
            k += 1
            if not may:
                continue
            inner, found = text[begin + 1 + image : k - 1], None
            if text[k : k + 1] == "(" and (target := _target(text, k)):
                found = Inline("image" if image else "link", begin, target[2], inner, target[0], target[1])
            elif inner.startswith("^") and not image and re.fullmatch(r"\^[^\[\]\s]+", inner):
                if defined is None or identifier(inner) in defined:
                    found = Inline("note", begin, k, "", label=inner)
            else:
                m = _LABEL.match(text, k)
                label = m.group(1) if m and m.group(1).strip() else inner
                if label.strip() and not re.search(r"(?<!\\)[\[\]]", label) and (defined is None or identifier(label) in defined):
                    found = Inline("image" if image else "link", begin, m.end() if m else k, inner, label=label)
            if found:
                out.append(found)
                k = found.end
                if not image:
                    for b in brackets:
                        b[2] = b[2] and b[1]
        else:
            k += 1
    return sorted(out, key=lambda x: (x.start, -x.end))


def shown(text: str, defined: set[str] | None = None) -> str:
    """A paragraph's text without marks: what links and code spans show, images' descriptions."""
    kept: list[str] = []

    def hold(piece: str) -> str:
        kept.append(piece)
        return f"\ue000{len(kept) - 1}\ue001"

    parts, at = [], 0
    for x in inlines(text, defined):
        if x.start < at:
            continue
        inner = x.text if x.kind in ("code", "escape") else "" if x.kind in ("tag", "note") else shown(x.text, defined)
        parts += [text[at : x.start], hold(inner)]
        at = x.end
    out = "".join([*parts, text[at:]])
    while (less := _MARKS.sub(lambda m: m.group(2) or m.group(4), out)) != out:
        out = less
    out = re.sub(r"(?: {2,}|\\)\n", "\n", out)
    return re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m.group(1))], out)


def plain(block: Block, defined: set[str] | None = None) -> str:
    """What a block says: blocks, items and rows apart by an empty line, cells by tabs, code as it is."""
    if block.kind in ("code", "html"):
        return block.text[:-1] if block.text.endswith("\n") else block.text
    if block.kind in ("text", "heading"):
        return shown(block.text.strip(_BLANK), defined)
    if block.kind == "table":
        rows = block.text.strip("\n").split("\n")
        return "\n\n".join("\t".join(shown(c.replace("\\|", "|"), defined) for c in cells(r)) for k, r in enumerate(rows) if k != 1)
    return "\n\n".join(plain(b, defined) for b in block.children)


def definitions_of(root: Block, text: str) -> dict[str, tuple[str, Block]]:
    """Definitions by identifier (those of footnotes begin with ^): what defines it, and its block. Of equal ones the first."""
    out: dict[str, tuple[str, Block]] = {}
    for block in root.walk():
        if block.kind in ("definition", "footnote"):
            whole = block.text.rstrip(_BLANK) if block.kind == "definition" else text[block.start : block.end]
            out.setdefault(identifier(block.label), (whole, block))
    return out


def used_by(block: Block, defined: set[str]) -> list[str]:
    """Identifiers of ``defined`` that a block refers to, in order, each once."""
    out: dict[str, None] = {}
    for b in block.walk():
        if b.kind in ("text", "heading", "table"):
            out |= dict.fromkeys(identifier(x.label) for x in inlines(b.text, defined) if x.label is not None)
    return list(out)


def closure(blocks: list[Block], found: dict[str, tuple[str, Block]]) -> list[str]:
    """Identifiers that ``blocks`` refer to, and those that the footnotes among these refer to, in order of first use."""
    out: dict[str, None] = {}
    todo, defined = list(blocks), set(found)
    while todo:
        for name in used_by(todo.pop(0), defined):
            if name not in out:
                out[name] = None
                todo.append(found[name][1])
    return list(out)


def links_of(root: Block, found: dict[str, tuple[str, Block]]) -> list[tuple[str, str, str, str | None]]:
    """kind (link, image), text, url and title of links in order of first appearance, equal ones once. Links by
    reference have what the definition says."""
    out: dict[tuple, None] = {}
    defined = set(found)

    def visit(text: str) -> None:
        for x in inlines(text, defined):
            if x.kind in ("link", "image"):
                url, title = x.url, x.title
                if x.label is not None:
                    m = _DEFINITION.match(found[identifier(x.label)][0])
                    url, title = unescaped(m.group(2)[1:-1] if m.group(2)[0] == "<" else m.group(2)), unescaped(m.group(3)[1:-1]) if m.group(3) else None
                out[x.kind, shown(x.text, defined), url, title] = None

    for block in root.walk():
        if block.kind in ("text", "heading"):
            visit(block.text)
        elif block.kind == "table":
            for row in block.text.split("\n"):
                for cell in cells(row):
                    visit(cell)
    return list(out)


def code_of(root: Block) -> list[tuple[str, str, str]]:
    """language, meta and code of fenced and indented code, in order of first appearance, equal blocks once."""
    found = (re.match(r"(\S*)\s*(.*)", b.label, re.S).groups() + (b.text[:-1] if b.text.endswith("\n") else b.text,) for b in root.walk() if b.kind == "code")
    return list(dict.fromkeys(found))
