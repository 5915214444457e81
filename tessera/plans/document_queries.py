"""The path of documents as queries: MDX to Markdown, sections, definitions, sources, tables of fields, and strict
parsing of model output. Each writes documents from rows of the test tables and runs the operator on them; its SQL
says from the same rows what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import output, sections
from tessera.plans.queries import query, spread, table

_BREAK = "chr(10)"


def _lines(*lines: str) -> str:
    """A SQL expression for lines, each a SQL expression of a text."""
    return f" || {_BREAK} || ".join(f"({x})" for x in lines)


def _parts(spark: SparkSession, sf_dir: str, sql: str, **more: str) -> DataFrame:
    """Documents (document_id, content, path) that a SQL expression makes of parts."""
    made = [F.expr(sql).alias("content"), *(F.expr(x).alias(name) for name, x in more.items())]
    return spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("string").alias("document_id"), *made, F.lit("").alias("path"))


_PAGE = _lines(
    "'---'", "'title: ' || p_name", "'---'", "'import X from \"./x\"'", "''", "'# ' || p_brand", "''", "'<Callout title=\"' || p_type || '\">'", "''", "'size ' || p_size", "''", "'</Callout>'", "''",
    "'```js'", "'<Tag a={1}/> ' || p_size || ' &lt;'", "''", "'import y'", "'```'", "''",
    "'{\"' || p_size || '\"} <Unknown a={1 > 2}>' || p_name || '</Unknown> `<b>{x}</b>` {f(p)}'", "''",
    "'<table><tr><th>a</th><th>b</th></tr><tr><td>' || p_size || '</td><td><b>' || p_brand || '</b></td></tr></table>'",
)


@query(f"""SELECT p_partkey::varchar AS document_id, p_name AS title, 2::int AS n_warnings, {_lines("'# ' || p_brand", "''", "'> **' || p_type || '**'", "'>'", "'> size ' || p_size", "''", "'```js'", "'<Tag a={{1}}/> ' || p_size || ' &lt;'", "''", "'import y'", "'```'", "''", "p_size || ' ' || p_name || ' `<b>{{x}}</b>` '", "''", "'| a | b |'", "'| --- | --- |'", "'| ' || p_size || ' | **' || p_brand || '** |'")} AS markdown FROM part""".replace("{{", "{").replace("}}", "}"))
def mdx_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with components, code, expressions and tables, as Markdown."""
    normal = sections.normalized(_parts(spark, sf_dir, _PAGE), "mdx")
    return normal.select("document_id", "title", F.size("warnings").alias("n_warnings"), "markdown")


@query(f"""SELECT p_partkey::varchar AS document_id, 2 * (p_size % 7) + n AS line, c::int AS "column", r AS reason FROM part, (VALUES (1, 5, 'an expression isn''t static, its text is left out'), (3, 1, 'component Widget isn''t known, what it holds is kept'), (5, 1, 'a script or style is left out')) v(n, c, r) WHERE p_size % 5 <> 0
    UNION ALL SELECT p_partkey::varchar, 2 * (p_size % 7) + 3, 1, 'error: a tag has no end' FROM part WHERE p_size % 5 = 0""")
def mdx_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where and why something is left out, and where a text can't be read."""
    text = _lines("repeat('x' || chr(10) || chr(10), p_size % 7) || 'say {size()}'", "''", "'<Widget>' || p_brand || CASE WHEN p_size % 5 = 0 THEN '' ELSE '</Widget>' END", "''", "'<script>{</script>'")
    normal = sections.normalized(_parts(spark, sf_dir, text), "mdx")
    error = F.array(F.struct("error.line", "error.column", F.concat(F.lit("error: "), "error.reason").alias("reason")))
    return normal.select("document_id", F.inline(F.when(F.col("error").isNull(), F.col("warnings")).otherwise(error)))


@query("""WITH r AS (SELECT n_nationkey AS nation, '| `' || n_name || '` | nation |' AS row, -1 AS k FROM nation
      UNION ALL SELECT c_nationkey, '| `' || n_name || '.' || c_name || '` | ' || c_mktsegment || ' |', c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT nation, row, row_number() OVER (PARTITION BY nation ORDER BY k)::int AS row_no FROM r""")
def field_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their customers as nested static fields: a row for each, named by its path."""
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind")))).alias("children"))
    nations = table(spark, sf_dir, "nation").join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    children = F.coalesce(F.transform("children", lambda c: F.struct(c["name"].alias("name"), c["kind"].alias("kind"))), F.array().cast("array<struct<name:string,kind:string>>"))
    rows = F.to_json(F.array(F.struct(F.col("n_name").alias("name"), F.lit("nation").alias("kind"), children.alias("children"))))
    content = F.concat(F.lit("<ExpandableTable columns={[{key: 'name', label: 'Name'}, {key: 'kind', label: 'Kind'}]}\n rows={"), rows, F.lit("} />"))
    normal = sections.normalized(nations.select(F.col("n_nationkey").alias("nation"), content.alias("content")), "mdx")
    lines = normal.select("nation", F.posexplode(F.split("markdown", "\n")).alias("row_no", "row"))
    return lines.where("row_no > 1").select("nation", "row", (F.col("row_no") - 1).alias("row_no"))


_NESTED = _lines("p_name", "'====='", "''", "'- item'", "'  # in an item'", "''", "'<!--'", "'# hidden'", "'-->'", "''", "'> ## quoted'", "''", "p_brand", "'---'", "''", "'```'", "'### code'", "'```'", "''", "'### ' || p_type", "'#### no section'")


@query(f"""WITH d AS (SELECT p_partkey AS part, p_name, p_brand, p_type, {_NESTED} AS t FROM part),
    p AS (SELECT *, position(chr(10) || p_brand || chr(10) || '---' IN t) AS b, position(chr(10) || '### ' || p_type || chr(10) IN t) AS c FROM d)
    SELECT part::varchar AS document_id, 0::int AS index, 1::int AS depth, p_name AS title, 0::int AS start_offset, b::int AS end_offset FROM p
    UNION ALL SELECT part::varchar, 1, 2, p_brand, b, c FROM p UNION ALL SELECT part::varchar, 2, 3, p_type, c, length(t) FROM p""")
def section_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Underlined headings begin sections; those in items, comments, quotes and code don't."""
    docs = _parts(spark, sf_dir, _NESTED).withColumnRenamed("content", "markdown")
    return sections.sections(docs).select("document_id", "index", "depth", "title", "start_offset", "end_offset")


_REFERRING = _lines("'# A'", "''", "'See [it][Ref] and[^n].'", "''", "'Second ' || p_name || ' [it][ref].'", "''", "'# B'", "''", "'Text.'", "''", "'[ref]:'", "'  /url-' || p_size", "''", "'[^n]: ' || p_brand", "'    more [' || p_type || '](u) and [deep]'", "''", "'[deep]: /deep'")


@query(f"""SELECT p_partkey::varchar AS document_id, 'A' AS title, 0::int AS index, {_lines("'# A'", "''", "'See [it][Ref] and[^n].'", "''", "'[ref]:'", "'/url-' || p_size", "''", "'[^n]: ' || p_brand", "'    more [' || p_type || '](u) and [deep]'", "''", "'[deep]: /deep'")} AS markdown FROM part
    UNION ALL SELECT p_partkey::varchar, 'A', 1, {_lines("'# A'", "''", "'Second ' || p_name || ' [it][ref].'", "''", "'[ref]:'", "'/url-' || p_size")} FROM part
    UNION ALL SELECT p_partkey::varchar, 'B', 0, {_lines("'# B'", "''", "'Text.'")} FROM part""")
def chunk_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the definitions that each refers to, over several lines and through footnotes, in their budget: a
    unit for each paragraph, so that two don't fit."""
    docs = _parts(spark, sf_dir, _REFERRING).withColumnRenamed("content", "markdown")
    split = sections.sections(docs)
    paragraphs = lambda text: text.count("See ") + text.count("Second ") + 1
    return sections.chunks(split, 2, tokens=paragraphs, keep=("document_id", "title")).select("document_id", "title", "index", "markdown")


@query("""WITH s AS (SELECT p_partkey AS part, p_size % 2 = 0 AS url, p_size % 3 = 0 AS field, p_size % 5 = 0 AS below FROM part)
    SELECT part::varchar AS document_id, t AS title FROM s, (VALUES ('A'), ('B'), ('C')) v(t) WHERE field OR (url AND t IN ('A', 'B')) OR (below AND t = 'B')""")
def changed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections whose revision another version of their document changes: by a definition that they refer to, by a
    field of the document, or by their own text. Two lines more above change none."""
    text = lambda url, field, below, above: _lines("'---'", f"'product: ' || {field}", "'---'", f"{above}'# A'", "''", "'[help][ref] of ' || p_name", "''", "'# B'", "''", f"'text ' || {below}", "''", f"'[ref]: ' || {url}", "''", "'# C'", "''", "'other ' || p_brand")
    versions = [text("'/old'", "'v1'", "'x'", ""), text("CASE WHEN p_size % 2 = 0 THEN '/new' ELSE '/old' END", "CASE WHEN p_size % 3 = 0 THEN 'v2' ELSE 'v1' END", "CASE WHEN p_size % 5 = 0 THEN 'y' ELSE 'x' END", "chr(10) || chr(10) || ")]
    revised = []
    for version in versions:
        normal = sections.normalized(_parts(spark, sf_dir, version), "mdx").withColumnRenamed("title", "document_title")
        split = sections.sections(normal, content="content", keep=("document_title", "metadata"))
        revised.append(sections.section_revision(split).select("document_id", "id", "title", "revision"))
    before, after = revised
    both = before.hint("merge").join(after.select("id", F.col("revision").alias("now")), "id")
    return both.where("revision <> now").select("document_id", "title")


_SOURCED = _lines("'---'", "'title: ' || p_name", "'---'", "'import a from \"' || p_brand || '\"'", "''", "'# Guide'", "''", "'<Download href=\"/f\">' || p_type || '</Download>'", "''", "'# Plain'", "''", "p_name")


@query(f"""WITH d AS (SELECT p_partkey AS part, p_name, {_SOURCED} AS t FROM part), p AS (SELECT *, position('# Guide' IN t) - 1 AS a, position('# Plain' IN t) - 1 AS b FROM d)
    SELECT part::varchar AS document_id, 'Guide' AS title, a::int AS source_start, (b - 2)::int AS source_stop, t[a + 1 : b - 2] AS source, false AS exact FROM p
    UNION ALL SELECT part::varchar, 'Plain', b::int, length(t)::int, t[b + 1 : length(t)], true FROM p""")
def section_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections back in the text that they came from, before its components became Markdown."""
    normal = sections.normalized(_parts(spark, sf_dir, _SOURCED), "mdx")
    return sections.sections(normal, content="content").select("document_id", "title", "source_start", "source_stop", "source", "exact")


_LINKED = _lines("'[' || p_brand || '](/a(' || p_size || ')) `[no](x)` ![' || p_type || '][Img]'", "''", "'```'", "'[no](y)'", "'```'", "''", "'- [it][img] [' || p_brand || '](/a(' || p_size || '))'", "''", "'[img]: <' || p_name || '> ''t'''")


@query("""SELECT p_partkey::varchar AS document_id, 0::int AS pos, 'link' AS kind, p_brand AS text, '/a(' || p_size || ')' AS url, '' AS title FROM part
    UNION ALL SELECT p_partkey::varchar, 1, 'image', p_type, p_name, 't' FROM part UNION ALL SELECT p_partkey::varchar, 2, 'link', 'it', p_name, 't' FROM part""")
def links_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and images, also by reference, in order; none of what is code, equal ones once."""
    return _parts(spark, sf_dir, _LINKED).select("document_id", F.posexplode(sections.links(F.col("content"))).alias("pos", "l")).select("document_id", "pos", "l.*")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus FROM orders)
    SELECT 's' || k AS section_id, path, reason FROM o, (VALUES (1, 'JSON', 'invalid-json'), (2, 'root', 'unexpected-field'), (3, 'summary', 'invalid-text'), (4, 'entities[0].id', 'invalid-id'), (4, 'entities[1].evidence', 'empty-evidence'), (5, 'facts[0].nodeIds[1]', 'invalid-text'), (6, 'knowledgeType', 'unsupported-value'), (7, 'keywords', 'missing-field')) v(n, path, reason) WHERE k % 9 = n""")
def output_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs for each order, with a fault of every kind, parsed from their text."""
    k = F.col("o_orderkey") % 9
    text = lambda x: F.to_json(F.struct(x.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(x.alias("v")))) - 6)
    node = lambda id, evidence: F.concat(F.lit('{"id": "'), id, F.lit('", "name": '), text(F.col("o_orderpriority")), F.lit(', "type": "t", "aliases": [], "description": "d", "evidence": '), evidence, F.lit("}"))
    quote = F.lit('["q"]')
    entities = F.concat(F.lit("["), node(F.when(k == 4, "no id").otherwise("e1"), quote), F.lit(", "), node(F.lit("e2"), F.when(k == 4, "[]").otherwise(quote)), F.lit("]"))
    facts = F.concat(F.lit('[{"statement": "f", "nodeIds": ["e1", '), F.when(k == 5, "5").otherwise('"e2"'), F.lit('], "evidence": ["q"]}]'))
    made = F.concat(F.lit('{"summary": '), F.when(k == 3, '" "').otherwise('"s"'), F.when(k == 7, "").otherwise(', "keywords": ["k"]'), F.when(k == 2, ', "more": 1').otherwise(""), F.lit(', "aliases": [], "questions": [], "concepts": [], "relations": [], "entities": '), entities, F.lit(', "facts": '), facts, F.lit(', "knowledgeType": "'), F.when(k == 6, "tutorial").otherwise("guide"), F.when(k == 1, '"').otherwise('"}'))
    return output.output_issues(spread(table(spark, sf_dir, "orders")).select(F.concat(F.lit("s"), "o_orderkey").alias("section_id"), made.alias("output")))
