"""More of the engine's operators as queries: extraction, graph, indexing, references and logs. Each calls the
operator itself on rows made from the test tables, and its SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import canon
from tessera.operators import catalog, changes, enrichment, graph, indexing, integrity, logs, references, search, sections
from tessera.plans.queries import query, spread, supply, table

#: A customer's orders as what was extracted from a section; few names, so that many are equal.
_NODES = """nodes AS (SELECT o_custkey::varchar AS section_id, o_orderkey::int AS ord, CASE WHEN o_orderstatus = 'O' THEN 'concept' ELSE 'entity' END AS kind, 'n' || o_orderkey AS id,
      'name ' || (o_orderkey % 2) AS name, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus ELSE '' END AS t, ['alias ' || (o_orderkey % 3), 'any'] AS aliases, o_orderpriority AS quote,
      'n' || min(o_orderkey) OVER (PARTITION BY o_custkey) AS first_id FROM orders),
    heads AS (SELECT section_id, kind, name, t, min(ord) AS ord, arg_min(id, ord) AS id FROM nodes GROUP BY ALL),
    ids AS (SELECT section_id, n.id AS old, h.id AS new FROM nodes n JOIN heads h USING (section_id, kind, name, t))"""


def _extracted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes, and orders with the section's least node as first_id."""
    orders = table(spark, sf_dir, "orders").withColumns({"section_id": F.col("o_custkey").cast("string"), "ord": F.col("o_orderkey").cast("int"), "id": F.concat(F.lit("n"), "o_orderkey")})
    kind = F.when(F.col("o_orderstatus") == "O", "concept").otherwise("entity")
    aliases = F.array(F.concat(F.lit("alias "), F.col("o_orderkey") % 3), F.lit("any"))
    nodes = orders.select("section_id", "ord", kind.alias("kind"), "id", F.concat(F.lit("name "), F.col("o_orderkey") % 2).alias("name"), F.when(kind == "entity", F.col("o_orderstatus")).alias("type"), aliases.alias("aliases"), F.lit("about").alias("description"), F.array("o_orderpriority").alias("evidence"))
    least = orders.groupBy("section_id").agg(F.min("o_orderkey").alias("least"))
    return nodes, orders.join(least, "section_id").withColumn("first_id", F.concat(F.lit("n"), "least"))


@query(f"""WITH {_NODES}, a AS (SELECT section_id, kind, name, t, v, min(ord * 10 + pos) AS p FROM (SELECT *, unnest(aliases) AS v, unnest([0, 1]) AS pos FROM nodes) GROUP BY ALL),
    q AS (SELECT section_id, kind, name, t, quote, min(ord) AS p FROM nodes GROUP BY ALL)
    SELECT section_id, ord, kind, id, name, (SELECT string_agg(v, ',' ORDER BY p) FROM a WHERE (a.section_id, a.kind, a.name, a.t) = (h.section_id, h.kind, h.name, h.t)) AS aliases,
      (SELECT string_agg(quote, ',' ORDER BY p) FROM q WHERE (q.section_id, q.kind, q.name, q.t) = (h.section_id, h.kind, h.name, h.t)) AS evidence FROM heads h""")
def deduplicated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and concepts of a section that say the same, as one with all aliases and quotes."""
    merged, _ = enrichment.deduplicated_nodes(_extracted(spark, sf_dir)[0])
    return merged.select("section_id", "ord", "kind", "id", "name", F.array_join("aliases", ",").alias("aliases"), F.array_join("evidence", ",").alias("evidence"))


@query(f"""WITH {_NODES}, r AS (SELECT n.section_id, n.ord, s.new AS source_id, t.new AS target_id, n.ord % 2 AS k, n.quote FROM nodes n JOIN ids s ON s.section_id = n.section_id AND s.old = n.id JOIN ids t ON t.section_id = n.section_id AND t.old = n.first_id),
    q AS (SELECT section_id, source_id, target_id, k, quote, min(ord) AS p FROM r GROUP BY ALL)
    SELECT section_id, source_id, target_id, 'type ' || k AS type, min(p) AS ord, string_agg(quote, ',' ORDER BY p) AS evidence FROM q GROUP BY section_id, source_id, target_id, k""")
def deduplicated_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of each node to its section's least one, between the nodes that stay."""
    nodes, orders = _extracted(spark, sf_dir)
    relations = orders.select("section_id", "ord", F.col("id").alias("source_id"), F.col("first_id").alias("target_id"), F.concat(F.lit("type "), F.col("o_orderkey") % 2).alias("type"), F.lit("d").alias("description"), F.array("o_orderpriority").alias("evidence"))
    out = enrichment.deduplicated_relations(relations, enrichment.deduplicated_nodes(nodes)[1])
    return out.select("section_id", "source_id", "target_id", "type", "ord", F.array_join("evidence", ",").alias("evidence"))


@query(f"""WITH {_NODES}, f AS (SELECT n.section_id, n.ord, n.quote AS statement, CASE WHEN n.ord % 5 = 0 THEN []::varchar[] WHEN s.new = t.new THEN [s.new] WHEN n.ord % 2 = 0 THEN [t.new, s.new] ELSE [s.new, t.new] END AS about
      FROM nodes n JOIN ids s ON s.section_id = n.section_id AND s.old = n.id JOIN ids t ON t.section_id = n.section_id AND t.old = n.first_id)
    SELECT section_id, statement, min(ord) AS ord, array_to_string(arg_min(about, ord), ',') AS node_ids, string_agg('q' || ord, ',' ORDER BY ord) AS evidence FROM f GROUP BY section_id, statement, list_sort(about)""")
def deduplicated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts about two nodes, in either order, or about none."""
    nodes, orders = _extracted(spark, sf_dir)
    about = F.when(F.col("ord") % 5 == 0, F.array().cast("array<string>")).when(F.col("ord") % 2 == 0, F.array("first_id", "id")).otherwise(F.array("id", "first_id"))
    facts = orders.select("section_id", "ord", F.col("o_orderpriority").alias("statement"), about.alias("node_ids"), F.array(F.concat(F.lit("q"), "ord")).alias("evidence"))
    out = enrichment.deduplicated_facts(facts, enrichment.deduplicated_nodes(nodes)[1])
    return out.select("section_id", "statement", "ord", F.array_join("node_ids", ",").alias("node_ids"), F.array_join("evidence", ",").alias("evidence"))


_BLANK = r"regexp_replace({}, '[\t\n\x0B\f\r \x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]', '', 'g') = ''"


@query(f"""WITH d AS (SELECT doc_id, doc_id::varchar AS section_id, CASE WHEN doc_id % 3 = 0 THEN '~~ nowhere ~~' ELSE substr(text, 3, 20) END AS quote, text, CASE WHEN doc_id % 11 = 0 THEN 'not an id!' ELSE 'n' END AS id FROM documents),
    loose AS (SELECT *, {_BLANK.format("quote")} OR NOT contains(text, quote) AS lost FROM d)
    SELECT * FROM (
      SELECT section_id, 'entity[0]' AS path, CASE WHEN doc_id % 11 = 0 THEN 'invalid_id' WHEN doc_id % 7 = 0 THEN 'invalid_name' WHEN doc_id % 5 = 0 THEN 'invalid_type' WHEN lost THEN 'evidence_not_in_section' END AS reason FROM loose
      UNION ALL SELECT section_id, 'n', CASE WHEN doc_id % 19 = 0 AND doc_id % 11 <> 0 THEN 'duplicate_id' END FROM d
      UNION ALL SELECT section_id, 'entity[1]', CASE WHEN doc_id % 19 = 0 AND lost THEN 'evidence_not_in_section' END FROM loose
      UNION ALL SELECT section_id, 'relation[0]', CASE WHEN doc_id % 11 = 0 AND doc_id % 19 <> 0 THEN 'unresolved_reference' END FROM d
      UNION ALL SELECT section_id, 'relation[0]', CASE WHEN doc_id % 13 = 0 OR (doc_id % 11 = 0 AND doc_id % 19 <> 0) THEN 'unresolved_reference' END FROM d
      UNION ALL SELECT section_id, 'relation[0]', CASE WHEN lost THEN 'evidence_not_in_section' END FROM loose
      UNION ALL SELECT section_id, 'fact[0]', CASE WHEN doc_id % 17 = 0 THEN 'evidence_count' WHEN lost THEN 'evidence_not_in_section' END FROM loose) WHERE reason IS NOT NULL""")
def extraction_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions from documents with wrong ids, names, types, references and quotes among them."""
    docs = table(spark, sf_dir, "documents").withColumn("section_id", F.col("doc_id").cast("string"))
    d, none = F.col("doc_id"), F.array().cast("array<string>")
    quote = F.when(d % 3 == 0, "~~ nowhere ~~").otherwise(F.substring("text", 3, 20))
    nodes = docs.select("section_id", F.lit(0).alias("ord"), F.lit("entity").alias("kind"), F.when(d % 11 == 0, "not an id!").otherwise("n").alias("id"), F.when(d % 7 == 0, " 　").otherwise("x").alias("name"), F.when(d % 5 != 0, "t").alias("type"), none.alias("aliases"), F.lit("d").alias("description"), F.array(quote).alias("evidence"))
    again = docs.where(d % 19 == 0).select("section_id", F.lit(1).alias("ord"), F.lit("entity").alias("kind"), F.lit("n").alias("id"), F.lit("x").alias("name"), F.lit("t").alias("type"), none.alias("aliases"), F.lit("d").alias("description"), F.array(quote).alias("evidence"))
    relations = docs.select("section_id", F.lit(0).alias("ord"), F.lit("n").alias("source_id"), F.when(d % 13 == 0, "zz").otherwise("n").alias("target_id"), F.lit("t").alias("type"), F.lit("d").alias("description"), F.array(quote).alias("evidence"))
    facts = docs.select("section_id", F.lit(0).alias("ord"), F.lit("s").alias("statement"), none.alias("node_ids"), F.when(d % 17 == 0, none).otherwise(F.array(quote)).alias("evidence"))
    return enrichment.violations(nodes.unionByName(again), relations, facts, docs.select("section_id", F.col("text").alias("markdown")))


@query("""WITH s AS (SELECT doc_id AS section_id, sha256(text) AS revision FROM documents WHERE doc_id % 10 <> 0),
    p AS (SELECT doc_id AS section_id, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE sha256(text) END AS revision FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, 'again' FROM documents WHERE doc_id % 13 = 0),
    c AS (SELECT section_id, count(*) AS n, min(revision) AS given FROM p GROUP BY 1)
    SELECT * FROM (SELECT coalesce(s.section_id, c.section_id) AS section_id, CASE WHEN c.n IS NULL THEN 'missing' WHEN s.section_id IS NULL THEN 'unexpected' WHEN n > 1 THEN 'repeated' WHEN given <> revision THEN 'stale' END AS reason
      FROM s FULL JOIN c ON s.section_id = c.section_id) WHERE reason IS NOT NULL""")
def provided_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why enrichment that was prepared elsewhere doesn't fit a document's sections."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("section_id"), F.sha2("text", 256).alias("revision"))
    given = docs.where("section_id % 7 <> 0").withColumn("revision", F.when(F.col("section_id") % 11 == 0, "old").otherwise(F.col("revision")))
    return enrichment.provided_for(docs.where("section_id % 10 <> 0"), given.unionByName(docs.where("section_id % 13 = 0").withColumn("revision", F.lit("again"))))


#: What the suppliers' graph is made of; the ids of its nodes and edges.
_SUPPLY = """counts AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1),
    joined AS (SELECT n_nationkey, n_name, r_regionkey, r_name, n, 'wiki-node-' || sha256('["atlas",["local","nation-' || n_nationkey || '","1","n"]]') AS nation_id, 'wiki-node-' || sha256('["atlas",["canonical","region-' || r_regionkey || '"]]') AS region_id,
      n_name || ' → ' || r_name || '（part of）：lies in the region' AS line FROM nation JOIN region ON n_regionkey = r_regionkey JOIN counts ON s_nationkey = n_nationkey),
    edges AS (SELECT *, 'wiki-edge-' || sha256('["' || nation_id || '","' || region_id || '","part of","lies in the region"]') AS edge_id FROM joined)"""


@query(f"WITH {_SUPPLY} SELECT edge_id, nation_id AS source_id, region_id AS target_id, 'nation-' || n_nationkey AS section_id, n_name AS quote, 1::bigint AS n_citations FROM edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations as edges between nodes, with what cites them."""
    edges = supply(spark, sf_dir)["edges"]
    first = F.get("citations", F.lit(0))
    return edges.select("edge_id", "source_id", "target_id", first["section_id"].alias("section_id"), F.get(first["evidence"], F.lit(0)).alias("quote"), F.size("citations").cast("bigint").alias("n_citations"))


@query(f"""WITH {_SUPPLY}, texts AS (SELECT 'chunk-' || n.n_nationkey AS source_id, CASE WHEN n.n_nationkey % 2 = 0 THEN 'Atlas' ELSE n.n_name END AS title,
      CASE WHEN n.n_nationkey % 2 = 0 THEN '文档：Atlas' || chr(10) || chr(10) ELSE '' END || '章节：' || n.n_name || chr(10) || chr(10) || '原文：' || chr(10) || 'About ' || n.n_name
        || coalesce(chr(10) || chr(10) || '本节知识信息：' || chr(10) || '实体：' || n.n_name || chr(10) || 'nation：' || n || ' suppliers' || chr(10) || chr(10) || '概念：' || r_name || chr(10) || 'a region', '') AS text,
      CASE WHEN j.n IS NULL THEN 0 ELSE 2 END::bigint AS n_nodes, 'ready' AS knowledge_status FROM nation n LEFT JOIN joined j USING (n_nationkey)
      UNION ALL SELECT 'chunk-region-' || r_regionkey, r_name, '章节：' || r_name || chr(10) || chr(10) || '原文：' || chr(10) || 'About ' || r_name, 0::bigint, CASE WHEN r_regionkey % 2 = 0 THEN 'pending' ELSE 'unavailable' END FROM region)
    SELECT 'index-' || sha256('["atlas","chunk","' || source_id || '"]') AS id, source_id, title, text, sha256('[1,' || to_json(text) || ']') AS text_revision, ceil(strlen(text) / 4)::int AS token_count, n_nodes, knowledge_status FROM texts""")
def chunk_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of nations and regions with what the graph knows of their sections: ready, waited for, or not there."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    common = [F.lit("1").alias("section_revision"), F.lit("atlas").alias("document_id"), F.lit("atlas.md").alias("source_path")]
    chunks = nation.select(F.concat(F.lit("chunk-"), key).alias("id"), F.concat(F.lit("nation-"), key).alias("section_id"), *common, F.when(key % 2 == 0, "Atlas").alias("document_title"), F.array("n_name").alias("heading_path"), F.concat(F.lit("About "), "n_name").alias("markdown"))
    waiting = F.concat(F.lit("region-section-"), "r_regionkey")
    others = region.select(F.concat(F.lit("chunk-region-"), "r_regionkey").alias("id"), waiting.alias("section_id"), *common, F.lit(None).cast("string").alias("document_title"), F.array("r_name").alias("heading_path"), F.concat(F.lit("About "), "r_name").alias("markdown"))
    pending = region.where("r_regionkey % 2 = 0").select(waiting.alias("section_id"), F.lit("1").alias("section_revision"))
    docs = indexing.index_documents(chunks.unionByName(others), supply(spark, sf_dir), pending, "atlas").where("kind = 'chunk'")
    return docs.select("id", "source_id", "title", "text", "text_revision", "token_count", F.size("nodes").cast("bigint").alias("n_nodes"), "knowledge_status")


_GAP = "chr(10) || chr(10)"


@query(f"""WITH {_SUPPLY}
    SELECT nation_id AS node_id, '# ' || n_name || {_GAP} || '## 描述与证据' || {_GAP} || n || ' suppliers' || {_GAP} || '> ' || n_name || {_GAP} || '## 事实与证据' || {_GAP} || 'suppliers: ' || n || {_GAP} || '> ' || n_name || {_GAP} || '## 关系与证据' || {_GAP} || line || {_GAP} || '> ' || n_name AS markdown FROM joined
    UNION ALL SELECT region_id, '# ' || r_name || {_GAP} || '## 描述与证据' || {_GAP} || 'a region' || repeat({_GAP} || '> ' || r_name, count(*)) || {_GAP} || '## 关系与证据' || {_GAP} || string_agg(line || {_GAP} || '> ' || n_name, {_GAP} ORDER BY line) FROM joined GROUP BY region_id, r_name""")
def node_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each node of the suppliers' graph."""
    built = supply(spark, sf_dir)
    return graph.page_markdown(built["nodes"], built["edges"])


@query(f"""WITH {_SUPPLY}, lost AS (SELECT * FROM edges WHERE n_nationkey % 5 = 0)
    SELECT 'relations of node and edges' AS reason, nation_id || '/' || edge_id AS id FROM lost UNION ALL SELECT 'relations of node and edges', region_id || '/' || edge_id FROM lost
    UNION ALL SELECT 'waiting section is linked', 'nation-' || n_nationkey FROM nation WHERE n_nationkey < 3
    UNION ALL SELECT 'link without contribution', 'nation-' || n_nationkey || '/1' FROM nation WHERE n_nationkey = 4""")
def graph_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph that lost some edges and a contribution, and of which some sections wait."""
    built, nation = supply(spark, sf_dir), table(spark, sf_dir, "nation")
    lost = F.regexp_extract(F.get("citations", F.lit(0))["section_id"], "[0-9]+", 0).cast("int") % 5 == 0
    section = F.concat(F.lit("nation-"), "n_nationkey").alias("section_id")
    contributions = nation.where("n_nationkey <> 4").select(section, F.lit("1").alias("section_revision"))
    return integrity.graph_problems(built | {"edges": built["edges"].where(~lost)}, contributions, nation.where("n_nationkey < 3").select(section))


@query(f"WITH {_SUPPLY} SELECT nation_id AS node_id, n_name AS title FROM joined WHERE n_nationkey = 1 UNION ALL SELECT region_id, r_name FROM joined WHERE n_nationkey = 1")
def section_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes_of_section(supply(spark, sf_dir), "nation-1", "1").select("node_id", "title")


@query("""SELECT 'nation-' || n_nationkey AS section_id, 'r' AS local_id, 'region-' || CASE WHEN n_nationkey = 3 THEN 99 ELSE n_regionkey END AS canonical_id FROM nation WHERE n_nationkey < 5
    UNION ALL SELECT 'nation-4', 'r', 'region-other'""")
def mapping_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of nations' local nodes: of another kind (0), of another revision (1), of no node (2), to
    nothing (3), twice (4); the rest can be used."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key, section = F.col("n_nationkey"), F.concat(F.lit("nation-"), F.col("n_nationkey")).alias("section_id")
    nodes = nation.where(key != 2).select(section, F.lit("r").alias("id"), F.when(key == 0, "entity").otherwise("concept").alias("kind"))
    canonical = region.select(F.concat(F.lit("region-"), "r_regionkey").alias("id"), F.lit("concept").alias("kind"))
    canonical = canonical.unionByName(region.limit(1).select(F.lit("region-other").alias("id"), F.lit("concept").alias("kind")))
    mappings = nation.select(section, F.when(key == 1, "0").otherwise("1").alias("section_revision"), F.lit("r").alias("local_id"), F.concat(F.lit("region-"), F.when(key == 3, 99).otherwise(F.col("n_regionkey"))).alias("canonical_id"))
    twice = nation.where(key == 4).select(section, F.lit("1").alias("section_revision"), F.lit("r").alias("local_id"), F.lit("region-other").alias("canonical_id"))
    return graph.invalid_mappings(mappings.unionByName(twice), canonical, nodes, nation.select(section, F.lit("1").alias("section_revision")))


@query("""SELECT doc_id::varchar AS section_id, CASE WHEN doc_id % 10 IN (1, 2) THEN '2' ELSE '1' END AS section_revision, CASE WHEN doc_id % 10 = 8 THEN 'moved' WHEN doc_id % 10 IN (1, 2) THEN 'new' ELSE 'old' END AS source_path FROM documents WHERE doc_id % 10 IN (0, 1, 2, 8)
    UNION ALL SELECT doc_id::varchar, CASE WHEN doc_id % 10 IN (5, 6) THEN '3' ELSE '2' END, NULL FROM documents WHERE doc_id % 10 IN (5, 6, 7, 9)""")
def graph_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a graph is made of after an update: even documents were in it, odd ones waited for. By last digit, 1
    and 2 come fresh, 3 and 4 go, 5 and 6 wait for a newer revision, 8 only moves."""
    docs = table(spark, sf_dir, "documents")

    def part(digits: list[int], revision: str, path: str) -> DataFrame:
        return docs.where((F.col("doc_id") % 10).isin(digits)).select(F.col("doc_id").cast("string").alias("section_id"), F.lit(revision).alias("section_revision"), F.col("source").alias("document_id"), F.lit(path).alias("source_path"), F.array(F.lit("H")).alias("heading_path"))

    done, still = graph.updated_contributions(part([0, 2, 4, 6, 8], "1", "old"), part([1, 3, 5, 7, 9], "2", "old"), part([1, 2], "2", "new"), part([3, 4], "1", "old"), part([5, 6], "3", "old"), part([8], "1", "moved"))
    return done.select("section_id", "section_revision", "source_path").unionByName(still.withColumn("source_path", F.lit(None).cast("string")))


@query("SELECT doc_id FROM documents WHERE regexp_replace(text, '[0-9]', '#', 'g') = text")
def reusable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose revision stays when digits are masked."""
    docs = table(spark, sf_dir, "documents")
    masked = docs.select("doc_id", F.sha2(F.regexp_replace("text", "[0-9]", "#"), 256).alias("revision"))
    return graph.reusable(docs.select("doc_id", F.sha2("text", 256).alias("revision")), masked, "doc_id")


@query("""WITH d AS (SELECT doc_id, 'index-' || sha256('["kb","chunk","' || doc_id || '"]') AS id, n_chars FROM documents)
    SELECT doc_id FROM d WHERE doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 OR n_chars > 8000""")
def index_document_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index documents with wrong ids, revisions, statuses, without sources, or over the budget."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").withColumns({"knowledge_base_id": F.lit("kb"), "kind": F.lit("chunk"), "source_id": d.cast("string"), "token_count": F.col("n_chars").cast("int")})
    docs = docs.withColumns(
        {
            "id": F.when(d % 7 == 0, "index-").otherwise(canon.index_id(F.col("knowledge_base_id"), F.col("kind"), F.col("source_id"))),
            "text_revision": F.when(d % 5 == 0, "x").otherwise(canon.text_revision(F.col("text"))),
            "sources": F.when(d % 13 == 0, F.array().cast("array<string>")).otherwise(F.array("source")),
            "knowledge_status": F.when(d % 11 == 0, "lost").otherwise("ready"),
        }
    )
    return indexing.invalid_index_documents(docs).select("doc_id")


@query("""WITH h AS (SELECT CASE WHEN doc_id % 9 = 0 THEN 'other' ELSE 'kb' END AS kb, CASE WHEN doc_id % 2 = 0 THEN 'chunk' ELSE 'wiki' END AS kind, (doc_id % 300)::varchar AS id, text, CASE WHEN doc_id % 50 <> 0 THEN doc_id / 7 END AS score FROM documents)
    SELECT 'candidate' AS reason, id FROM h WHERE kb <> 'kb' OR score IS NULL OR """ + _BLANK.format("text") + """
    UNION ALL SELECT 'conflicting text', id FROM h GROUP BY id HAVING count(DISTINCT text) > 1
    UNION ALL SELECT 'too many', kind FROM h GROUP BY kind HAVING count(*) > 30""")
def candidate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as hits of a search that went wrong in several ways."""
    d = F.col("doc_id")
    hits = table(spark, sf_dir, "documents").select(F.when(d % 9 == 0, "other").otherwise("kb").alias("knowledge_base_id"), F.when(d % 2 == 0, "chunk").otherwise("wiki").alias("kind"), (d % 300).cast("string").alias("id"), "text", F.when(d % 50 != 0, d / 7).alias("score"))
    return search.invalid_candidates(hits, "kb")


@query("SELECT item_id AS ord, 'S' || rank AS label, rank FROM (SELECT item_id, row_number() OVER (ORDER BY length(text) % 7 DESC, item_id)::int AS rank FROM benchmark WHERE item_id % 3 <> 0) WHERE rank <= 8")
def selected_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as candidates, reranked by a score that ties; the best eight with labels."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), "text")
    scores = items.where("ord % 3 <> 0").select("ord", (F.length("text") % 7).cast("double").alias("rerank_score"))
    return search.select_evidence(items, scores, 8).select("ord", "label", "rank")


_ANSWER = "'[S' || (doc_id % 12) || ']See [S1] and [Sx][S' || (doc_id % 3) || ']' || CASE WHEN doc_id % 2 = 0 THEN '.' ELSE '' END"


@query(rf"""SELECT doc_id, array_to_string(regexp_extract_all({_ANSWER}, '\[S[0-9]+\]'), '|') AS citations, array_to_string(list_filter(string_split_regex({_ANSWER}, '\[S[0-9]+\]'), lambda x: x <> ''), '|') AS texts,
    {_ANSWER} AS whole FROM documents""")
def answer_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in citations and the text between; together they are the answer."""
    answer = F.concat(F.format_string("[S%d]See [S1] and [Sx][S%d]", F.col("doc_id") % 12, F.col("doc_id") % 3), F.when(F.col("doc_id") % 2 == 0, ".").otherwise(""))
    df = table(spark, sf_dir, "documents").select("doc_id", search.answer_segments(answer).alias("s"))

    def joined(kind: str) -> Column:
        return F.array_join(F.transform(F.filter("s", lambda x: x["type"] == kind), lambda x: x["value"]), "|")

    return df.select("doc_id", joined("citation").alias("citations"), joined("text").alias("texts"), F.array_join(F.transform("s", lambda x: x["value"]), "").alias("whole"))


@query("SELECT doc_id, 'not labelled' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id + 1, 'unknown' FROM labels WHERE doc_id + 1 NOT IN (SELECT doc_id FROM documents)")
def key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without labels, and labels whose next document isn't there."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    next_ones = labels.select((F.col("doc_id") + 1).alias("doc_id"))
    return changes.difference(docs, labels, "doc_id").withColumn("side", F.lit("not labelled")).unionByName(changes.difference(next_ones, docs, "doc_id").withColumn("side", F.lit("unknown")))


@query("SELECT vec_id AS id, label::bigint AS label FROM embeddings WHERE (label = 1 OR vec_id % 3 = 1) AND (label <> 1 OR vec_id % 3 <> 1)")
def shared_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of document 1 that another document, the id's rest by three, is a source of too."""
    source = lambda c: F.struct(c.cast("string").alias("document_id"))
    records = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("label"), F.array(source(F.col("label")), source(F.col("vec_id") % 3)).alias("sources"))
    return catalog.shared_with_others(records, "1").select("id", "label")


@query("""SELECT user_id::varchar AS id, strftime(a, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS started_at, strftime(b, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS finished_at, round((epoch_us(b) - epoch_us(a)) / 1000)::bigint AS duration_ms
    FROM (SELECT user_id, min_by(ts, event_id) FILTER (event_type <> 'purchase') AS a, min_by(ts, event_id) FILTER (event_type = 'purchase') AS b FROM events GROUP BY user_id)""")
def operation_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as operations, as a service shows them: when they began, ended, and how long they took."""
    status = F.when(F.col("event_type") == "purchase", "succeeded").otherwise("running")
    none = F.lit(None).cast("string")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), status.alias("status"), F.col("ts").alias("at"), none.alias("knowledge_base_id"), none.alias("document_id"))
    return logs.projected(logs.current_state(events)).select("id", "started_at", "finished_at", "duration_ms")


@query("SELECT substr(source, 1, 300) AS title, substr(text, 1, 6000) AS text, length(text) > 6000 OR length(source) > 300 AS truncated FROM documents ORDER BY doc_id LIMIT 20")
def stage_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first items of a stage, as they are shown."""
    return references.preview(table(spark, sf_dir, "documents"), "doc_id", F.col("source"), F.col("text"))


@query(rf"""SELECT doc_id, {_BLANK.format("text")} AS blank, (length(text) + len(regexp_extract_all(text, '[\x{{10000}}-\x{{10FFFF}}]')))::int AS utf16_length, list_aggregate(list_sort(list_distinct([lang, source, 'en'])), 'string_agg', ',') AS names FROM documents""")
def text_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether texts are blank, how long they are in UTF-16, and a sorted set."""
    df = table(spark, sf_dir, "documents")
    return df.select("doc_id", canon.is_blank(F.col("text")).alias("blank"), canon.utf16_length(F.col("text")).alias("utf16_length"), F.array_join(canon.sorted_unique(F.array("lang", "source", F.lit("en"))), ",").alias("names"))


#: Sections that use a definition, a footnote that uses another, and one that is only in a fence.
_REFERRING = "'See [it][ a' || (p_partkey % 50) || '  b] and [^note], not [fenced].'"


@query("""SELECT p_partkey AS id, 'A' || (p_partkey % 50) || ' B' AS identifier, '[a' || (p_partkey % 50) || ' b]: /first' AS definition FROM part
    UNION ALL SELECT p_partkey, '^NOTE', '[^note]: see [deeper]' FROM part WHERE p_partkey % 3 <> 0
    UNION ALL SELECT p_partkey, 'DEEPER', '[deeper]: /deep' FROM part WHERE p_partkey % 3 <> 0""")
def reference_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that sections use, directly or through a footnote; of two for one identifier the first."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("See [it][ a"), k % 50, F.lit("  b] and [^note], not [fenced]."))
    defined = F.concat(F.lit("\n\n[a"), k % 50, F.lit(" b]: /first\n[A"), k % 50, F.lit(" B]: /second\n"), F.when(k % 3 != 0, "[^note]: see [deeper]\n").otherwise(""), F.lit("[deeper]: /deep\n```\n[fenced]: /none\n```\n"))
    parts = spread(table(spark, sf_dir, "part"))
    docs = parts.select(k.alias("document_id"), F.concat(text, defined).alias("markdown"))
    return references.section_definitions(parts.select(k.alias("document_id"), k.alias("id"), text.alias("markdown")), references.definitions(docs))


@query("""SELECT p_partkey AS part, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Heading ' || p_brand END AS title, p_size::varchar AS size, '# Heading ' || p_brand || chr(10) || chr(10) || 'Text of ' || p_type AS markdown FROM part""")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with fields above their text; the title is the field, else the first heading."""
    title = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('title: "'), "p_name", F.lit('"\n'))).otherwise("")
    content = F.concat(F.lit("---\n"), title, F.lit("size: "), "p_size", F.lit("\n---\n# Heading "), "p_brand", F.lit("\n\nText of "), "p_type")
    docs = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("part"), content.alias("content"))
    return sections.normalized(docs, "markdown").select("part", "title", F.element_at("metadata", F.lit("size")).alias("size"), "markdown")


@query("""SELECT p_partkey AS part, 'sql||a ' || p_size || ';c|title=x|' || p_type || CASE WHEN p_size % 2 = 0 THEN '' ELSE ';sql||b' END AS code, p_name || chr(10) || chr(10) || 'bold ' || p_brand || ' link' AS plain FROM part""")
def code_and_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced code, equal blocks once, and the text without marks."""
    fence = lambda head, body: F.concat(F.lit(f"```{head}\n"), body, F.lit("\n```\n"))
    one = fence("sql", F.concat(F.lit("a "), "p_size"))
    markdown = F.concat(one, F.lit("\n"), fence("c title=x", F.col("p_type")), one, F.when(F.col("p_size") % 2 != 0, fence("sql", F.lit("b"))).otherwise(""))
    blocks = F.transform(sections.code_blocks(markdown), lambda b: F.concat_ws("|", b["language"], b["meta"], b["code"]))
    plain = sections.plain_text(F.concat(F.lit("## "), "p_name", F.lit("\n\n**bold** "), "p_brand", F.lit(" [link](/to)")))
    return spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("part"), F.array_join(blocks, ";").alias("code"), plain.alias("plain"))


@query("""WITH g AS (SELECT p_partkey AS part, p_size AS n, unnest(range(0, p_size, 3)) AS i FROM part),
    a AS (SELECT *, 'section-' || sha256('["' || part || '",[],1,"t' || i || '",0]') AS id1 FROM g),
    b AS (SELECT *, 'section-' || sha256('["' || part || '",["' || id1 || '"],2,"t' || (i + 1) || '",0]') AS id2 FROM a),
    c AS (SELECT *, 'section-' || sha256('["' || part || '",["' || id1 || '","' || id2 || '"],3,"t' || (i + 2) || '",0]') AS id3 FROM b)
    SELECT part, i::int AS index, 1 AS depth, 't' || i AS title, 't' || i AS heading, id1 AS id, NULL AS parent_id FROM c
    UNION ALL SELECT part, (i + 1)::int, 2, 't' || (i + 1), 't' || i || ' / t' || (i + 1), id2, id1 FROM c WHERE i + 1 < n
    UNION ALL SELECT part, (i + 2)::int, 3, 't' || (i + 2), 't' || i || ' / t' || (i + 1) || ' / t' || (i + 2), id3, id2 FROM c WHERE i + 2 < n""")
def heading_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with as many headings as their size, one, two and three deep in turn: sections, parents and paths."""
    lines = F.transform(F.sequence(F.lit(0), F.col("p_size") - 1), lambda i: F.concat(F.repeat(F.lit("#"), (i % 3 + 1).cast("int")), F.lit(" t"), i, F.lit("\n\n~~~\n```\n# none\n~~~\n")))
    docs = spread(table(spark, sf_dir, "part")).where("p_size > 0").select(F.col("p_partkey").alias("part"), F.array_join(lines, "\n").alias("markdown"))
    return sections.sections(docs, "part").select("part", "index", "depth", "title", F.array_join("heading_path", " / ").alias("heading"), "id", "parent_id")
