"""The knowledge graph: nodes and edges with citations, built from sections' contributions.

Everything is a join or a group-by on section, node or edge ids. A node's edges are found with two
equi-joins (as source, as target) and a distinct, never with a condition on either end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import TesseraError
from tessera.functions.canon import edge_id, hashed, node_id, sorted_unique

CITATION = ("document_id", "section_id", "section_revision", "source_path", "heading_path")


def identified_nodes(nodes: DataFrame, contributions: DataFrame, mappings: DataFrame, canonical: DataFrame, knowledge_base: str) -> DataFrame:
    """Local nodes with node_id, and title: the canonical node's where a mapping (section_id,
    section_revision, local_id, canonical_id) is given, else the own name."""
    df = nodes.join(contributions.select("section_id", "section_revision"), "section_id")
    mapped = mappings.select("section_id", "section_revision", F.col("local_id").alias("id"), "canonical_id")
    df = df.join(mapped, ["section_id", "section_revision", "id"], "left")
    titles = canonical.select(F.col("id").alias("canonical_id"), F.col("title").alias("canonical_title"))
    df = df.join(titles, "canonical_id", "left")
    identity = node_id(F.lit(knowledge_base), F.col("section_id"), F.col("section_revision"), F.col("id"), F.col("canonical_id"))
    return df.withColumns({"node_id": identity, "title": F.coalesce("canonical_title", "name")})


def invalid_mappings(mappings: DataFrame, canonical: DataFrame, nodes: DataFrame, contributions: DataFrame) -> DataFrame:
    """Mappings that repeat, refer to another revision, or to nodes that aren't there or of another kind."""
    known = nodes.join(contributions.select("section_id", "section_revision"), "section_id").select("section_id", "section_revision", F.col("id").alias("local_id"), "kind")
    usable = mappings.join(known, ["section_id", "section_revision", "local_id"]).join(canonical.select(F.col("id").alias("canonical_id"), F.col("kind")), ["canonical_id", "kind"])
    keys = ["section_id", "local_id", "canonical_id"]
    bad = mappings.join(usable, keys, "left_anti").select(*keys)
    repeated = mappings.groupBy("section_id", "local_id").count().where("count > 1").select("section_id", "local_id")
    return bad.unionByName(mappings.join(repeated, ["section_id", "local_id"], "left_semi").select(*keys)).distinct()


def _by_section(claims: DataFrame, keys: list[str], contributions: DataFrame) -> DataFrame:
    """Claims (keys, section_id, evidence), a row for each section that makes one, with what is known of the section;
    evidence is merged within a section only."""
    merged = claims.groupBy(*keys, "section_id").agg(sorted_unique(F.flatten(F.collect_list("evidence"))).alias("evidence"))
    return merged.join(contributions.select(*CITATION), "section_id")


def _with_citations(cited: DataFrame, keys: list[str]) -> DataFrame:
    """Claims with their sections as citations. The list of one claim is as long as its sections are many, so what is
    needed of single sections is taken from the rows of ``_by_section`` instead."""
    citation = F.struct("section_id", "document_id", "section_revision", "source_path", "heading_path", "evidence")
    return cited.groupBy(*keys).agg(F.array_sort(F.collect_list(citation)).alias("citations"))


def build_graph(contributions: DataFrame, nodes: DataFrame, relations: DataFrame, facts: DataFrame, knowledge_base: str, mappings: DataFrame, canonical: DataFrame) -> dict[str, DataFrame]:
    """Data frames nodes, edges and links (section_id, section_revision, node_ids); and as rows of single sections
    what nodes hold as lists: claims (node_id, section_id, name, type, aliases, description) and sources
    (node_id, CITATION columns, each once).

    contributions: one row per section (CITATION columns). nodes, relations and facts are sections' own,
    with local ids."""
    local = identified_nodes(nodes, contributions, mappings, canonical, knowledge_base)
    ids = local.select("section_id", F.col("id").alias("local_id"), "node_id").distinct()
    described = local.withColumn("aliases", sorted_unique(F.col("aliases")))
    described = described.withColumn("type", F.when(F.col("kind") == "entity", F.col("type")))
    own = _by_section(described, ["node_id", "name", "type", "aliases", "description"], contributions)
    claims = _with_citations(own, ["node_id", "name", "type", "aliases", "description"])
    descriptions = claims.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("name", "type", "aliases", "description", "citations"))).alias("descriptions"))
    heads = local.groupBy("node_id").agg(F.first("canonical_id", ignorenulls=True).alias("canonical_id"), F.min("kind").alias("kind"), F.min_by("title", F.struct("section_id", "ord")).alias("title"), F.array_sort(F.collect_set("section_id")).alias("section_ids"))

    named = facts.select("section_id", "ord", "statement", "evidence", F.explode("node_ids").alias("local_id")).join(ids, ["section_id", "local_id"])
    about = named.groupBy("section_id", "ord").agg(F.first("statement").alias("statement"), F.first("evidence").alias("evidence"), F.array_sort(F.collect_set("node_id")).alias("node_ids"))
    telling = _by_section(about, ["statement", "node_ids"], contributions)
    claims = _with_citations(telling, ["statement", "node_ids"])
    stated = claims.select(F.explode("node_ids").alias("node_id"), F.struct("statement", "node_ids", "citations").alias("fact"))
    stated = stated.groupBy("node_id").agg(F.array_sort(F.collect_list("fact")).alias("facts"))

    ends = relations
    for end in ("source", "target"):
        ends = ends.join(ids.select("section_id", F.col("local_id").alias(f"{end}_id"), F.col("node_id").alias(f"{end}_node")), ["section_id", f"{end}_id"])
    ends = ends.select("section_id", F.col("source_node").alias("source_id"), F.col("target_node").alias("target_id"), "type", "description", "evidence")
    relating = _by_section(ends, ["source_id", "target_id", "type", "description"], contributions)
    edges = _with_citations(relating, ["source_id", "target_id", "type", "description"])
    edges = edges.withColumn("edge_id", edge_id(F.col("source_id"), F.col("target_id"), F.col("type"), F.col("description")))
    edges = edges.withColumn("revision", hashed(F.to_json(F.struct("edge_id", "citations")))).select("edge_id", "revision", "source_id", "target_id", "type", "description", "citations")

    relation_ids = incident_edges(edges).groupBy("node_id").agg(F.array_sort(F.collect_list("edge_id")).alias("relation_ids"), hashed(F.array_join(F.array_sort(F.collect_list("revision")), "")).alias("_edges"))
    built = heads.join(descriptions, "node_id").join(stated, "node_id", "left").join(relation_ids, "node_id", "left")
    built = built.withColumns({"facts": F.coalesce("facts", F.array().cast(stated.schema["facts"].dataType)), "relation_ids": F.coalesce("relation_ids", F.array().cast("array<string>"))})
    built = built.withColumn("revision", hashed(F.to_json(F.struct("node_id", "kind", "title", "section_ids", "descriptions", "facts", "_edges")))).drop("_edges")
    linked = ids.groupBy("section_id").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))
    links = contributions.select("section_id", "section_revision").join(linked, "section_id", "left").withColumn("node_ids", F.coalesce("node_ids", F.array().cast("array<string>")))
    cited = (own, telling.withColumn("node_id", F.explode("node_ids")), incident_edges(relating))
    sources = cited[0].select("node_id", *CITATION)
    for rows in cited[1:]:
        sources = sources.unionByName(rows.select("node_id", *CITATION))
    claims = own.select("node_id", "section_id", "name", "type", "aliases", "description")
    return {"nodes": built, "edges": edges, "links": links, "claims": claims, "sources": sources.distinct()}


def incident_edges(edges: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """Edges with each of their nodes as node_id; an edge from a node to itself once."""
    return edges.withColumn("node_id", F.col(source)).unionByName(edges.where(F.col(source) != F.col(target)).withColumn("node_id", F.col(target)))


def updated_contributions(previous: DataFrame, waiting: DataFrame, fresh: DataFrame, removed: DataFrame, pending: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contributions and waiting sections after an update; the graph is then built from them again, and
    parts of equal revision can be taken over.

    fresh replaces, removed and pending withdraw; a section is in one of the four only. A fresh
    contribution for another revision than the one waited for is refused. sources change only
    source_path and heading_path of contributions of the same revision."""
    ids = fresh.select("section_id").unionAll(removed.select("section_id")).unionAll(pending.select("section_id")).unionAll(sources.select("section_id"))
    if not ids.groupBy("section_id").count().where("count > 1").isEmpty():
        raise TesseraError("INVALID_INPUT", "a section is changed twice")
    late = fresh.alias("f").join(waiting.alias("w"), "section_id").where("f.section_revision <> w.section_revision")
    if not late.isEmpty():
        raise TesseraError("INVALID_INPUT", "a late result for an old revision")
    gone = fresh.select("section_id").unionAll(removed.select("section_id")).unionAll(pending.select("section_id"))
    kept = previous.join(gone, "section_id", "left_anti").unionByName(fresh)
    still = waiting.select("section_id", "section_revision").join(gone, "section_id", "left_anti").unionByName(pending.select("section_id", "section_revision"))
    moved = sources.select("section_id", F.col("section_revision").alias("_r"), F.col("document_id").alias("_d"), F.col("source_path").alias("_p"), F.col("heading_path").alias("_h"))
    unknown = moved.join(kept, "section_id", "left").join(still.withColumnRenamed("section_revision", "_w"), "section_id", "left").where("NOT (_w <=> _r) AND (section_revision IS NULL OR section_revision <> _r OR document_id <> _d)")
    if not unknown.isEmpty():
        raise TesseraError("INVALID_INPUT", "a source update for another revision")
    columns = kept.columns
    joined = kept.join(moved, "section_id", "left")
    changed = F.col("_r").isNotNull()
    joined = joined.withColumns({"source_path": F.when(changed, F.col("_p")).otherwise(F.col("source_path")), "heading_path": F.when(changed, F.col("_h")).otherwise(F.col("heading_path"))})
    return joined.select(columns), still


def reusable(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys whose revision is the same in both builds: what was rendered for them can be taken over."""
    return new.select(key, "revision").join(old.select(key, "revision"), [key, "revision"], "left_semi").select(key)


def nodes_of_section(graph: dict[str, DataFrame], section_id: str, revision: str) -> DataFrame:
    link = graph["links"].where(F.col("section_id") == section_id)
    if not link.where(F.col("section_revision") != revision).isEmpty():
        raise TesseraError("INVALID_ASSOCIATION", "the section's revision is stale")
    return graph["nodes"].join(link.select(F.explode("node_ids").alias("node_id")), "node_id", "left_semi")


def page_markdown(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A page for each node: its title, descriptions, facts and relations with their quotes."""

    def quoted(citations: Column) -> Column:
        quotes = F.flatten(F.transform(citations, lambda c: F.transform(c["evidence"], lambda e: F.concat(F.lit("> "), F.replace(e, F.lit("\n"), F.lit("\n> "))))))
        return F.array_join(quotes, "\n\n")

    def part(title: str, texts: Column) -> Column:
        return F.when(F.size(texts) > 0, F.concat(F.lit(f"## {title}\n\n"), F.array_join(texts, "\n\n")))

    ends = nodes.select(F.col("node_id").alias("_n"), F.col("title").alias("_t"))
    named = edges.join(ends.select(F.col("_n").alias("source_id"), F.col("_t").alias("source_title")), "source_id").join(ends.select(F.col("_n").alias("target_id"), F.col("_t").alias("target_title")), "target_id")
    line = F.concat_ws("\n\n", F.format_string("%s → %s（%s）：%s", "source_title", "target_title", "type", "description"), quoted(F.col("citations")))
    related = incident_edges(named.withColumn("line", line)).groupBy("node_id").agg(F.array_sort(F.collect_list("line")).alias("related"))
    df = nodes.join(related, "node_id", "left").withColumn("related", F.coalesce("related", F.array().cast("array<string>")))
    described = F.transform("descriptions", lambda d: F.concat_ws("\n\n", d["description"], quoted(d["citations"])))
    stated = F.transform("facts", lambda f: F.concat_ws("\n\n", f["statement"], quoted(f["citations"])))
    page = F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("title")), part("描述与证据", described), part("事实与证据", stated), part("关系与证据", F.col("related")))
    return df.select("node_id", page.alias("markdown"))
