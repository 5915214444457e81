"""What is done to one row in a task: a document's sections, and a section's blocks packed into texts within a
token budget."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

from tessera.functions.canon import content_hash
from tessera.operators import markdown as md

_BLANK = " \t\n\x0b\x0c\r"
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_NUMBER = re.compile(r"( {0,3})(\d+)")
_SENTENCES = re.compile(r"(?<=[。！？.!?;；])\s*(?=\S)")
_ENDS = re.compile(r"[\s。！？.!?;；]$")

Fits = Callable[[str], bool]


def sections_of(document: str | None, text: str, most: int) -> list[tuple]:
    """A document's sections: index, id, parent_id, depth, title, heading_path, occurrence, first_line,
    start_offset, end_offset, markdown, definitions. Headings within other blocks, or deeper than ``most``, begin
    none. Definitions from elsewhere that a section refers to, directly or through a footnote, stand after its
    text (or before it, if it has a later one of the same name)."""
    root = md.outline(text)
    found = md.definitions_of(root, text)
    parts: list[tuple[int, str | None, int, int, list[md.Block]]] = [(0, None, 0, 0, [])]
    for block in root.children:
        if block.kind == "heading" and block.depth <= most:
            parts.append((block.depth, block.text, block.line, block.start, []))
        parts[-1][-1].append(block)
    out: list[tuple] = []
    around: list[tuple[int, str, str]] = []
    seen: dict[tuple, int] = {}
    for (depth, title, line, start, blocks), after in zip(parts, [*parts[1:], None], strict=True):
        end = after[3] if after else len(text)
        if not depth and not blocks:
            continue
        around = [a for a in around if a[0] < depth]
        ids = [a[1] for a in around]
        name = (ids[-1] if ids else None, depth, title)
        nth = seen[name] = seen.get(name, -1) + 1
        own = "section-" + content_hash([document, ids, depth, title, nth])
        path = [a[2] for a in around] + ([title] if depth else [])
        before, behind = _foreign(blocks, found)
        # Blanks before indented code are part of it.
        mine = text[blocks[0].start : end].rstrip(_BLANK)
        body = "\n\n".join([*before, mine if blocks[0].kind == "code" else mine.lstrip(_BLANK), *behind])
        out.append((len(out), own, ids[-1] if ids else None, depth, title, path, nth, line, start, end, body, [*before, *behind]))
        if depth:
            around.append((depth, own, title))
    return out


def _foreign(blocks: list[md.Block], found: dict[str, tuple[str, md.Block]]) -> tuple[list[str], list[str]]:
    """Definitions that ``blocks`` refer to but don't hold: those that must stand before others of their names, and the rest."""
    if not found:
        return [], []
    held = [b for block in blocks for b in block.walk() if b.kind in ("definition", "footnote")]
    before, behind = [], []
    for name in md.closure(blocks, found):
        text, block = found[name]
        if not any(b is block for b in held):
            (before if any(md.identifier(b.label) == name for b in held) else behind).append(text)
    return before, behind


def source_of(content: str | None, runs: tuple[list[int], ...], start: int, end: int) -> tuple[int | None, int | None, str | None, bool | None]:
    """Where a section (start and end in the Markdown) stands in the document as it came: from, to, the text there, and
    whether the section is that text. ``runs``: starts and stops in the Markdown and in the source, in order."""
    starts, stops, sources, ends = runs
    low, high = bisect_right(stops, start), bisect_left(starts, end)
    if low >= high:
        return None, None, None, None
    copied = [stops[i] - starts[i] == ends[i] - sources[i] for i in range(low, high)]
    first = min(sources[i] + (max(start - starts[i], 0) if copied[i - low] else 0) for i in range(low, high))
    last = max(ends[i] - (max(stops[i] - end, 0) if copied[i - low] else 0) for i in range(low, high))
    return first, last, None if content is None else content[first:last], high - low == 1 and copied[0]


def approximate_count(text: str) -> int:
    """Without a tokenizer: a token for each four bytes, and part of four."""
    return -(-len(text.encode()) // 4)


def joined(pieces: list[str], glue: str, fits: Fits) -> list[str]:
    """Neighbours joined as long as they fit; a piece that doesn't fit alone stays whole."""
    out: list[str] = []
    for piece in pieces:
        if out and fits(longer := out[-1] + glue + piece):
            out[-1] = longer
        else:
            out.append(piece)
    return out


def graphemes(text: str, fits: Fits) -> list[str]:
    """A text in pieces that fit, cut between graphemes, after a blank or a sentence's end where the last half
    of a piece has one. A grapheme that doesn't fit takes the rest with it."""
    import regex

    cells, out, at = regex.findall(r"\X", text), [], 0
    while at < len(cells):
        low, high = 0, len(cells) - at
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if fits("".join(cells[at : at + middle])) else (low, middle - 1)
        size = low or len(cells) - at
        if at + size < len(cells):
            size = next((n for n in range(size, -(-size // 2) - 1, -1) if _ENDS.search(cells[at + n - 1]) and fits("".join(cells[at : at + n]))), size)
        out.append("".join(cells[at : at + size]))
        at += size
    return out


def _atoms(text: str, fits: Fits) -> list[str]:
    """A paragraph in sentences; links, images and code are never cut, and what doesn't fit is cut between graphemes."""
    whole = [(x.start, x.end) for x in md.inlines(text) if x.kind != "escape"]
    cuts = [0, *(m.end() for m in _SENTENCES.finditer(text) if not any(a < m.end() < b for a, b in whole)), len(text)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        sentence = text[a:b]
        if fits(sentence.rstrip()):
            out.append(sentence)
            continue
        at = a
        for start, end in [(x, y) for x, y in whole if a <= x and y <= b] + [(b, b)]:
            if start >= at:
                out += graphemes(text[at:start], fits) if start > at else []
                out += [text[start:end]] if end > start else []
                at = end
    return [x for x in out if x]


def parts(kind: str, text: str, fits: Fits) -> list[str]:
    """A block that doesn't fit in parts: code by line (fences repeated), tables by row (header repeated),
    lists by item (numbers go on), text by sentence, and a sentence that doesn't fit between graphemes. Others
    stay whole."""
    if fits(text):
        return [text]
    lines, head, tail, glue = text.split("\n"), "", "", "\n"
    if kind == "code" and (fence := _FENCE.match(lines[0])):
        marker = fence.group(1)
        closed = len(lines) > 1 and lines[-1].strip().startswith(marker)
        head, pieces, tail = lines[0] + "\n", lines[1 : -1 if closed else None], "\n" + marker
    elif kind == "code":
        pieces = lines
    elif kind == "table":
        head, pieces = "\n".join(lines[:2]) + "\n", lines[2:]
    elif kind == "list":
        items = md.outline(text).children[0].children
        pieces = [text[a.start : b.start if b else len(text)].rstrip("\n") for a, b in zip(items, [*items[1:], None], strict=True)]
        if first := _NUMBER.match(pieces[0]):
            pieces = [_NUMBER.sub(lambda m, n=n: f"{m.group(1)}{int(first.group(2)) + n}", p, count=1) if _NUMBER.match(p) else p for n, p in enumerate(pieces)]
    elif kind == "text":
        glue, pieces = "", _atoms(text, fits)
        return [p.strip() for p in joined(pieces, glue, lambda x: fits(x.strip())) if p.strip()]
    else:
        return [text]
    if len(pieces) < 2:
        return [text]
    return [head + p + tail for p in joined(pieces, glue, lambda x: fits(head + x + tail))]


def packed(markdown: str, max_tokens: int, overlap_tokens: int, count: Callable[[str], int]) -> list[str]:
    """A section's Markdown in texts with the section's heading each, within the budget where its parts allow that.
    Each has the definitions that it refers to after it; they count. See ``sections.chunks``."""
    root = md.outline(markdown)
    found = md.definitions_of(root, markdown)
    blocks = [b for b in root.children if b.kind not in ("definition", "footnote")]
    heading = blocks[:1] if blocks and blocks[0].kind == "heading" else []
    rest = blocks[len(heading) :]
    names: dict[str, list[str]] = {}

    def refers(text: str) -> list[str]:
        if not found or "[" not in text:
            return []
        if text not in names:
            names[text] = md.closure(md.outline(text).children, found)
        return names[text]

    above = [markdown[b.start : b.end] for b in heading]

    def text_of(group: list[str], headed: bool = True) -> str:
        pieces = [*(above if headed else []), *group]
        used = dict.fromkeys(name for p in pieces for name in refers(p))
        return "\n\n".join([*pieces, *(found[name][0] for name in used)])

    def fits(group: list[str]) -> bool:
        return count(text_of(group)) <= max_tokens

    if heading and not fits([]):
        return [text_of([markdown[b.start : b.end] for b in rest])]
    out: list[str] = []
    now: list[str] = []
    for block in rest:
        for part in parts(block.kind, markdown[block.start : block.end], lambda x: fits([x])):
            if not fits([part]):
                out += [text_of(g) for g in (now, [part]) if g]
                now = []
            elif now and not fits([*now, part]):
                out.append(text_of(now))
                kept = len(now)
                while kept and overlap_tokens and count(text_of(now[kept - 1 :], False)) <= overlap_tokens:
                    kept -= 1
                now = now[kept:]
                while now and not fits([*now, part]):
                    now = now[1:]
                now = [*now, part]
            else:
                now = [*now, part]
    if now or (not out and heading):
        out.append(text_of(now))
    return [t.rstrip() for t in out]
