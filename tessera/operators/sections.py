"""Markdown documents as rows of blocks, sections and chunks.

Small functions in the tasks go through a text once (``mdx`` brings MDX and HTML to Markdown, ``markdown`` finds
its blocks) and pack a section's blocks into a token budget, as only a tokenizer can say what fits. All of it happens
in a document's row (documents are bounded), so there is no shuffle, and collections spread over tasks
as they are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import TesseraError
from tessera.functions.canon import hashed, json_array, json_string, json_strings
from tessera.operators import markdown as md
from tessera.operators import mdx
from tessera.operators.batches import sliced, slices
from tessera.operators.packing import approximate_count, packed, sections_of, source_of

_FRONT = re.compile(r"---[ \t]*\n(?:.*?\n)?---[ \t]*(?:\n|\Z)", re.S)
DEPTHS = (1, 2, 3)
MAX_TOKENS = 800


def approximate_tokens(text: Column) -> Column:
    """Without a tokenizer: a token for each four bytes, and part of four."""
    return F.ceil(F.octet_length(text) / 4).cast("int")


def front_matter(content: Column) -> tuple[Column, Column]:
    """What stands between leading --- lines, and the rest."""
    pattern = r"(?s)^---[ \t]*\n(.*?\n)?---[ \t]*(?:\n|$)"
    return F.when(content.rlike(pattern), F.regexp_extract(content, pattern, 1)), F.regexp_replace(content, pattern, "")


def front_matter_fields(block: Column) -> Column:
    """Top-level scalar fields as a map of strings."""
    pairs = F.regexp_extract_all(block, F.lit(r"(?m)^([A-Za-z_][\w-]*):[ \t]*(.*)$"), F.lit(0))
    entries = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^([\w-]+):", 1).alias("k"), F.regexp_replace(F.regexp_replace(p, r"^[\w-]+:[ \t]*", ""), r"""^["']|["']$""", "").alias("v")))
    return F.map_from_entries(F.array_sort(F.array_distinct(entries)))


_PLACE = pa.struct([("line", pa.int32()), ("column", pa.int32()), ("reason", pa.string())])
_RUN = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("source_start", pa.int32()), ("source_stop", pa.int32())])
_NORMAL = pa.struct([("markdown", pa.string()), ("title", pa.string()), ("warnings", pa.list_(_PLACE)), ("error", _PLACE), ("source_map", pa.list_(_RUN))])
_DDL_PLACE = "struct<line:int,column:int,reason:string>"
_NORMAL_DDL = "struct<markdown:string,title:string,warnings:array<struct<line:int,column:int,reason:string>>,error:struct<line:int,column:int,reason:string>,source_map:array<struct<start:int,stop:int,source_start:int,source_stop:int>>>"


def _place(text: str, at: int, reason: str) -> dict:
    """Line and column, from 1, of a place in a text."""
    return {"line": text.count("\n", 0, at) + 1, "column": at - text.rfind("\n", 0, at), "reason": reason}


def first_title(markdown: str) -> str | None:
    """The title of the first heading of depth 1 that isn't inside another block."""
    return next((b.text for b in md.outline(markdown).children if b.kind == "heading" and b.depth == 1), None) or None


def _read(content: str, kind: str) -> dict:
    if kind == "markdown":
        front = _FRONT.match(content)
        at = front.end() if front else 0
        return {"markdown": content[at:], "title": first_title(content[at:]), "warnings": [], "error": None, "source_map": [{"start": 0, "stop": len(content) - at, "source_start": at, "source_stop": len(content)}]}
    found = mdx.normalize(content, lenient=kind == "html")
    warnings = [_place(content, at, reason) for at, reason in found.warnings]
    if found.error:
        return {"markdown": None, "title": None, "warnings": warnings, "error": _place(content, *found.error), "source_map": []}
    text, runs, at = "".join(p.text for p in found.pieces), [], 0
    for p in found.pieces:
        runs.append({"start": at, "stop": at + len(p.text), "source_start": p.start, "source_stop": p.end})
        at += len(p.text)
    return {"markdown": text, "title": first_title(text), "warnings": warnings, "error": None, "source_map": runs}


def _reader(kind: str) -> Callable[[Column], Column]:
    def read(content: pa.Array) -> pa.Array:
        return pa.array([None if c is None else _read(c, kind) for c in content.to_pylist()], _NORMAL)

    # Else the optimizer would let a filter on an error read each text once more.
    return lambda content: F.arrow_udf(sliced(read), _NORMAL_DDL).asNondeterministic()(content)


def _first_title(markdown: pa.Array) -> pa.Array:
    return pa.array([None if m is None else first_title(m) for m in markdown.to_pylist()], pa.string())


#: The formats that are there from the start. MDX is read strictly; HTML as it comes.
FORMATS = ("markdown", "mdx", "html")
ADAPTERS: dict[str, Callable[[Column], Column]] = {}


def register_adapter(name: str, normalize: Callable[[Column], Column]) -> None:
    """Adds a format: a function from a text's column (without front matter) to its Markdown."""
    if is_blank_name(name) or name in ADAPTERS or name in FORMATS:
        raise TesseraError("INVALID_OPTIONS", f"adapter {name} is there already, or has no name")
    ADAPTERS[name] = normalize


def is_blank_name(name: str) -> bool:
    return not isinstance(name, str) or not name.strip()


def normalized(docs: DataFrame, adapter: str, content: str = "content") -> DataFrame:
    """Adds metadata (front matter), markdown, title (front matter's, else the first H1), warnings and error (line,
    column, reason; of the source), source_map (runs of code points of the Markdown and of the source that they
    stand for, in order; equally long ones are copies).

    What can't be brought over without being executed is left out with a warning. A text that isn't MDX has an
    error and no Markdown; other rows aren't affected. Null texts stay null."""
    if adapter not in (*FORMATS, *ADAPTERS):
        raise TesseraError("INVALID_OPTIONS", f"no adapter {adapter}")
    block, body = front_matter(F.col(content))
    if adapter in ADAPTERS:
        df = docs.withColumn("markdown", ADAPTERS[adapter](body)).withColumn("_title", F.arrow_udf(sliced(_first_title), "string")("markdown"))
        none = F.lit(None)
        df = df.withColumns({"warnings": F.array().cast(f"array<{_DDL_PLACE}>"), "error": none.cast(_DDL_PLACE), "source_map": F.array().cast("array<struct<start:int,stop:int,source_start:int,source_stop:int>>")})
    else:
        df = docs.withColumn("_normal", _reader(adapter)(F.col(content)))
        df = df.withColumns({"markdown": F.col("_normal.markdown"), "_title": F.col("_normal.title"), "warnings": F.col("_normal.warnings"), "error": F.col("_normal.error"), "source_map": F.col("_normal.source_map")}).drop("_normal")
    df = df.withColumn("metadata", front_matter_fields(block))
    return df.withColumn("title", F.coalesce(F.try_element_at("metadata", F.lit("title")), F.col("_title"))).drop("_title")


_SECTION = "index int, id string, parent_id string, depth int, title string, heading_path array<string>, occurrence int, first_line int, start_offset int, end_offset int, markdown string, definitions array<string>"
_SOURCE = ", source_start int, source_stop int, source string, exact boolean"


def sections(docs: DataFrame, key: str = "document_id", text: str = "markdown", content: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Sections in order: index, depth (0 before the first heading), title, heading_path, parent_id, id,
    occurrence, first_line, start_offset and end_offset (code points of the text that the section takes up),
    markdown, definitions. Headings of depth 1 to 3, underlined ones too, begin sections where they stand by
    themselves, not inside fences, comments, lists or quotes. Definitions that a section refers to, directly or
    through footnotes, but doesn't hold, are in definitions and at the end of its markdown. Each line belongs to one
    section; blank ones with nothing else to none. A title that repeats under the same parent and depth is told
    apart by its occurrence. Null and empty texts have no section.

    With ``content``, the column of ``normalized`` documents as they came, sections have what ``with_sources`` adds,
    and then the document's columns named in ``keep``. A document is gone through in order, in the task, so nothing is shuffled."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, *(f.split(" ")[0] for f in (_SECTION + (_SOURCE if content else "")).split(", "))]
    kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), *[pa.int32()] * 4, pa.string(), pa.list_(pa.string()))
    kinds += (pa.int32(), pa.int32(), pa.string(), pa.bool_()) if content else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            rows, places = [], []
            sources = _runs(batch.column(-2), batch.column(-1)) if content else None
            for place, (document, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                found = sections_of(document, text or "", max(DEPTHS))
                if sources:
                    came, runs = next(sources)
                    found = [(*f, *source_of(came, runs, f[8], f[9])) for f in found]
                rows += found
                places += [place] * len(found)
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            first, *kept = (c.take(pa.array(places, pa.int64())) for c in (batch.column(0), *batch.columns[3 : 3 + len(keep)]))
            yield pa.RecordBatch.from_arrays([first, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), *kept], [*names, *keep])

    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    given = docs.select(key, F.col(key).cast("string").alias("_document"), F.col(text).alias("_text"), *keep, *([F.col(content).alias("_content"), "source_map"] if content else []))
    return given.mapInArrow(run, f"`{key}` {kind}, {_SECTION}{_SOURCE if content else ''}{kept}")


def _runs(content: pa.Array, source_map: pa.Array) -> Iterator[tuple[str | None, tuple[list[int], ...]]]:
    """Each document as it came, and its runs' starts, stops, source starts and source stops."""
    flat = source_map.flatten()
    columns, at = [flat.field(i).to_pylist() for i in range(4)], 0
    for came, size in zip(content.to_pylist(), source_map.value_lengths().fill_null(0).to_pylist(), strict=True):
        yield came, tuple(c[at : at + size] for c in columns)
        at += size


def with_sources(sections_df: DataFrame, normal: DataFrame, key: str = "document_id", content: str = "content") -> DataFrame:
    """Adds source_start, source_stop (code points of the document as it came), source (the text there) and exact (the
    section is that text as it is) to sections of ``normalized`` documents; null where nothing of a section comes
    from the source. Sections meet the runs of their document that overlap them. ``sections`` with ``content`` has
    the same without joins.

    Sides are merged by sort: what documents take up in files or plans says little about their texts, so none
    is brought to all tasks through the driver."""
    runs = normal.select(key, F.explode("source_map").alias("_run"))
    row = sections_df.select(key, "id", "start_offset", "end_offset")
    met = row.hint("merge").join(runs, key).where((F.col("_run.start") < F.col("end_offset")) & (F.col("_run.stop") > F.col("start_offset")))
    copied = F.col("_run.stop") - F.col("_run.start") == F.col("_run.source_stop") - F.col("_run.source_start")
    first = F.when(copied, F.col("_run.source_start") + F.greatest(F.col("start_offset") - F.col("_run.start"), F.lit(0))).otherwise(F.col("_run.source_start"))
    last = F.when(copied, F.col("_run.source_stop") - F.greatest(F.col("_run.stop") - F.col("end_offset"), F.lit(0))).otherwise(F.col("_run.source_stop"))
    spans = met.groupBy(key, "id").agg(F.min(first).alias("source_start"), F.max(last).alias("source_stop"), ((F.count("*") == 1) & F.bool_and(copied)).alias("exact"))
    # A document's text meets its few spans, not its many runs.
    spans = spans.hint("merge").join(normal.select(key, F.col(content).alias("_content")), key)
    spans = spans.withColumn("source", F.expr("substring(_content, source_start + 1, source_stop - source_start)")).drop("_content")
    return sections_df.join(spans.hint("merge"), [key, "id"], "left")


def section_revision(df: DataFrame, key: str = "document_id") -> DataFrame:
    """Adds revision, a hash of what a section says and where it stands by title; not of paths, lines or order.
    Where ``df`` has them, the document's title and metadata, the section's source and the definitions that it
    refers to are part of it, so that a change in any of them is one of the section."""
    there = set(df.columns)
    given = lambda name, value: value if name in there else F.lit("null")
    fields = F.array_sort(F.map_entries("metadata")) if "metadata" in there else F.lit(None)
    parts = json_array(
        json_string(F.col(key).cast("string")),
        json_string(F.col("title")),
        given("document_title", json_string(F.col("document_title")) if "document_title" in there else None),
        json_strings(F.col("heading_path")),
        given("metadata", F.coalesce(F.to_json(fields), F.lit("null")) if "metadata" in there else None),
        json_string(F.col("markdown")),
        given("source", json_string(F.col("source")) if "source" in there else None),
        given("definitions", json_strings(F.col("definitions")) if "definitions" in there else None),
    )
    return df.withColumn("revision", hashed(parts))


def blocks(sections_df: DataFrame, section: str = "id") -> DataFrame:
    """A section's blocks: block_index, kind (heading, code, table, list, quote, html, rule, definition, footnote, text),
    text. A block ends where another begins that isn't inside it."""

    def read(markdown: pa.Array) -> pa.Array:
        texts = markdown.to_pylist()
        found = [None if t is None else [{"kind": b.kind, "text": t[b.start : b.end]} for b in md.outline(t).children] for t in texts]
        return pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())])))

    return sections_df.select(section, F.posexplode(F.arrow_udf(sliced(read), "array<struct<kind:string,text:string>>")("markdown")).alias("block_index", "b")).select(section, "block_index", "b.kind", "b.text")


def chunks(sections_df: DataFrame, max_tokens: int = MAX_TOKENS, overlap_tokens: int = 0, oversized: str = "keep", tokens: Callable[[str], int] = approximate_count, keep: Sequence[str] = ()) -> DataFrame:
    """Sections (id, title, markdown, ...) in chunks within ``max_tokens``: section_id, index, id,
    markdown, token_count, oversized, previous_chunk_id, next_chunk_id, and the section's columns named in ``keep``.

    The heading is repeated on every chunk and counts, and so do the definitions that a chunk refers to. Blocks over the budget are cut (see ``packing.parts``).
    With overlap, a chunk begins with the trailing parts of the one before, as many whole ones as the overlap
    and the budget hold. A part over the budget is a chunk of its own, which the next one doesn't overlap,
    and, with ``oversized`` "error", fails. A heading that is over the budget leaves its section whole.
    ``tokens`` counts a text's tokens in the task, so any tokenizer will do. A section is packed in its row;
    nothing is shuffled."""
    if not 0 <= overlap_tokens < max_tokens or oversized not in ("keep", "error"):
        raise TesseraError("INVALID_OPTIONS", "token budget")

    names = ["section_id", "index", "id", "markdown", "token_count", "previous_chunk_id", "next_chunk_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows, places = [], []
            for place, (section, markdown) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                texts = packed(markdown or "", max_tokens, overlap_tokens, tokens)
                ids = [None, *(f"{section}#chunk-{i}" for i in range(len(texts))), None]
                rows += [(section, i, ids[i + 1], t, tokens(t), ids[i], ids[i + 2]) for i, t in enumerate(texts)]
                places += [place] * len(texts)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            kept = [c.take(pa.array(places, pa.int64())) for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), *kept], [*names, *keep])

    kept = "".join(f", `{c}` {sections_df.schema[c].dataType.simpleString()}" for c in keep)
    out = sections_df.select("id", "markdown", *keep).mapInArrow(run, f"section_id string, index int, id string, markdown string, token_count int, previous_chunk_id string, next_chunk_id string{kept}")
    out = out.select("section_id", "index", "id", "markdown", "token_count", (F.col("token_count") > max_tokens).alias("oversized"), "previous_chunk_id", "next_chunk_id", *keep)
    if oversized == "error" and not out.where("oversized").isEmpty():
        raise TesseraError("OVERSIZED_CONTENT", "a part that can't be cut is over the token budget")
    return out


def neighbours(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Adds previous_chunk_id and next_chunk_id within the group, null at its ends."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumns({"previous_chunk_id": F.lag(value).over(w), "next_chunk_id": F.lead(value).over(w)})


def _plain(markdown: pa.Array) -> pa.Array:
    def one(text: str) -> str:
        root = md.outline(text)
        return md.plain(root, set(md.definitions_of(root, text))).strip()

    return pa.array([None if t is None else one(t) for t in markdown.to_pylist()], pa.string())


def plain_text(markdown: Column) -> Column:
    """Text without marks: link and image texts, blocks and rows apart by an empty line, cells by tabs, code as it is."""
    return F.arrow_udf(sliced(_plain), "string")(markdown)


def reference_identifier(label: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(label, r"\s+", " ")))


def _code(markdown: pa.Array) -> pa.Array:
    names = ("language", "meta", "code")
    found = [None if t is None else [dict(zip(names, x, strict=True)) for x in md.code_of(md.outline(t))] for t in markdown.to_pylist()]
    return pa.array(found, pa.list_(pa.struct([(n, pa.string()) for n in names])))


def code_blocks(markdown: Column) -> Column:
    """Code blocks in order of first appearance, equal ones once: language, meta, code."""
    return F.arrow_udf(sliced(_code), "array<struct<language:string,meta:string,code:string>>")(markdown)


def _links(markdown: pa.Array) -> pa.Array:
    names = ("kind", "text", "url", "title")

    def one(text: str) -> list[dict]:
        root = md.outline(text)
        return [dict(zip(names, (*x[:3], x[3] or ""), strict=True)) for x in md.links_of(root, md.definitions_of(root, text))]

    return pa.array([None if t is None else one(t) for t in markdown.to_pylist()], pa.list_(pa.struct([(n, pa.string()) for n in names])))


def links(markdown: Column) -> Column:
    """Links and images in order of first appearance, equal ones once: kind, text, url, title. Those by reference lead
    where their definition does; what looks like one in code doesn't count."""
    return F.arrow_udf(sliced(_links), "array<struct<kind:string,text:string,url:string,title:string>>")(markdown)
