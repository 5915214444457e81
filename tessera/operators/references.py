"""Reference definitions and footnotes that sections use, and previews of stages."""

from __future__ import annotations

from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import markdown as md
from tessera.operators.batches import sliced
from tessera.sources.staging import Staging

PREVIEW_ITEMS, PREVIEW_TITLE, PREVIEW_TEXT = 20, 300, 6000


def definitions(docs: DataFrame, key: str = "document_id", text: str = "markdown") -> DataFrame:
    """Link and footnote definitions, whole (those of several lines too): identifier (of footnotes, with ^), definition,
    line_no. Of equal identifiers the first. What has their form in code or comments is none."""

    def read(markdown: pa.Array) -> pa.Array:
        out = []
        for t in markdown.to_pylist():
            found = md.definitions_of(md.outline(t or ""), t or "")
            out.append([{"identifier": name, "definition": whole, "line_no": block.line} for name, (whole, block) in found.items()])
        return pa.array(out, pa.list_(pa.struct([("identifier", pa.string()), ("definition", pa.string()), ("line_no", pa.int32())])))

    return docs.select(key, F.inline(F.arrow_udf(sliced(read), "array<struct<identifier:string,definition:string,line_no:int>>")(text)))


def _used(text: pa.Array) -> pa.Array:
    # A text is looked at as if all labels were defined; which are, a join says.
    out = []
    for t in text.to_pylist():
        blocks = (b for b in md.outline(t or "").walk() if b.kind in ("text", "heading", "table"))
        out.append(list(dict.fromkeys(md.identifier(x.label) for b in blocks for x in md.inlines(b.text) if x.label is not None)))
    return pa.array(out, pa.list_(pa.string()))


def used_identifiers(text: Column) -> Column:
    """What a text refers to: [text][id], [id][], [id] and [^id], but not [text](url), definitions and code."""
    return F.arrow_udf(sliced(_used), "array<string>")(text)


def section_definitions(sections_df: DataFrame, defined: DataFrame, key: str = "document_id", section: str = "id") -> DataFrame:
    """(section, identifier, definition) of all definitions that a section uses, directly or through another
    definition (a footnote with a reference). Each round follows one more step; cycles end it."""
    # Texts are read once; each round reads what the one before wrote.
    stage = Staging(sections_df.sparkSession).stage
    todo = stage("used", lambda: sections_df.select(key, section, F.explode(used_identifiers(F.col("markdown"))).alias("identifier")).distinct())
    found, linked = None, stage("defined", lambda: defined.select(key, "identifier", "definition"))
    for number in count():
        step = todo.join(linked, [key, "identifier"]).select(key, section, "identifier", "definition")
        if found is not None:
            step = step.join(found.select(section, "identifier"), [section, "identifier"], "left_anti").select(key, section, "identifier", "definition")
        step = stage(f"round-{number}", lambda step=step: step)
        if step.isEmpty():
            break
        found = step if found is None else found.unionByName(step)
        body = F.when(F.col("definition").rlike(r"^ {0,3}\[\^"), F.regexp_replace("definition", r"^ {0,3}\[[^\]]+\]:", ""))
        todo = step.select(key, section, F.explode(used_identifiers(body)).alias("identifier")).distinct()
    return sections_df.select(section, F.lit("").alias("identifier"), F.lit("").alias("definition")).where("false") if found is None else found.select(section, "identifier", "definition")


def with_definitions(sections_df: DataFrame, used: DataFrame, section: str = "id") -> DataFrame:
    """Sections with the definitions that they use, but don't hold, appended to their markdown."""
    missing = used.join(sections_df.select(section, "markdown"), section).where(~F.contains(F.col("markdown"), F.col("definition")))
    lists = missing.groupBy(section).agg(F.array_sort(F.collect_list("definition")).alias("_defs"))
    joined = sections_df.join(lists, section, "left")
    return joined.withColumn("markdown", F.concat_ws("\n\n", "markdown", F.array_join("_defs", "\n"))).drop("_defs")


def preview(items: DataFrame, order: str, title: Column, text: Column) -> DataFrame:
    """The first 20 items of a stage for display, titles and texts cut to their limits; truncated says where."""
    first = items.orderBy(order).limit(PREVIEW_ITEMS)
    return first.select(F.substring(title, 1, PREVIEW_TITLE).alias("title"), F.substring(text, 1, PREVIEW_TEXT).alias("text"), ((F.length(text) > PREVIEW_TEXT) | (F.length(title) > PREVIEW_TITLE)).alias("truncated"))


def stage_metrics(sections_df: DataFrame, chunks_df: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame) -> dict[str, int]:
    """Counts of an ingestion; only numbers, never text."""
    counts = {"sections": sections_df.count(), "chunks": chunks_df.count(), "oversized": chunks_df.where("oversized").count()}
    return counts | {"nodes": nodes.count(), "edges": edges.count(), "vectors": vectors.count()}
