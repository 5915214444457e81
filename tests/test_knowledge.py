import pytest
from pyspark.sql import functions as F

from tessera.errors import TesseraError
from tessera.operators import changes, enrichment, graph, indexing

TEXT = "Atlas 调用 Gateway。生产环境使用 HTTPS。"
CONTRIBUTION = "section_id string, section_revision string, document_id string, source_path string, heading_path array<string>"
MAPPING, CANONICAL = "section_id string, section_revision string, local_id string, canonical_id string", "id string, kind string, title string"


def knowledge(spark, *section_ids):
    nodes, relations, facts = [], [], []
    for s in section_ids:
        nodes += [(s, 0, "entity", "e1", "Atlas", "service", ["A"], "calls", ["Atlas 调用"]), (s, 1, "entity", "e2", "Gateway", "service", [], "is called", ["Gateway"]), (s, 2, "concept", "c1", "HTTPS", None, [], "transport", ["HTTPS"])]
        relations += [(s, 0, "e1", "e2", "calls", "calls it", ["Atlas 调用 Gateway"]), (s, 1, "e1", "c1", "uses", "uses it", ["使用 HTTPS"])]
        facts.append((s, 0, "production uses HTTPS", ["c1"], ["生产环境使用 HTTPS"]))
    return {"nodes": spark.createDataFrame(nodes, enrichment.NODE_SCHEMA), "relations": spark.createDataFrame(relations, enrichment.RELATION_SCHEMA), "facts": spark.createDataFrame(facts, enrichment.FACT_SCHEMA)}


def contributions(spark, *section_ids):
    return spark.createDataFrame([(s, "r1", f"doc-{s}", f"{s}.md", ["H"]) for s in section_ids], CONTRIBUTION)


def built(spark, sections=("s1", "s2"), mapped=True):
    k = knowledge(spark, *sections)
    mappings = [(s, "r1", local, canonical) for s in sections for local, canonical in (("e1", "atlas"), ("c1", "https"))] if mapped else []
    return graph.build_graph(contributions(spark, *sections), k["nodes"], k["relations"], k["facts"], "kb", spark.createDataFrame(mappings, MAPPING), spark.createDataFrame([("atlas", "entity", "Atlas"), ("https", "concept", "HTTPS")], CANONICAL))


def test_canonical_nodes_merge(spark):
    assert built(spark)["nodes"].count() == 4
    assert built(spark, mapped=False)["nodes"].count() == 6


def test_citations_stay_by_section(spark):
    node = built(spark)["nodes"].where("canonical_id = 'https'").first()
    assert node["section_ids"] == ["s1", "s2"]
    assert [c["section_id"] for c in node["facts"][0]["citations"]] == ["s1", "s2"]
    assert len(node["relation_ids"]) == 1 and len(node["descriptions"]) == 1


def test_update_equals_full_build(spark):
    old = contributions(spark, "s1", "s2")
    none = spark.createDataFrame([], "section_id string, section_revision string")
    kept, waiting = graph.updated_contributions(old, none, contributions(spark, "s3"), spark.createDataFrame([("s1",)], "section_id string"), none, spark.createDataFrame([], CONTRIBUTION))
    assert sorted(r["section_id"] for r in kept.collect()) == ["s2", "s3"] and waiting.count() == 0
    a, b = built(spark, ("s2", "s3"), mapped=False), built(spark, ("s3", "s2"), mapped=False)
    assert sorted(map(tuple, a["nodes"].select("node_id", "revision").collect())) == sorted(map(tuple, b["nodes"].select("node_id", "revision").collect()))
    assert graph.reusable(built(spark, mapped=False)["nodes"], a["nodes"], "node_id").count() == 3


def test_late_results_are_refused(spark):
    waiting = spark.createDataFrame([("s1", "r2")], "section_id string, section_revision string")
    empty = waiting.where("false")
    with pytest.raises(TesseraError, match="late"):
        graph.updated_contributions(contributions(spark, "s2"), waiting, contributions(spark, "s1"), empty.select("section_id"), empty, spark.createDataFrame([], CONTRIBUTION))


def test_nodes_of_section(spark):
    g = built(spark)
    assert graph.nodes_of_section(g, "s1", "r1").count() == 3
    with pytest.raises(TesseraError, match="INVALID_ASSOCIATION"):
        graph.nodes_of_section(g, "s1", "old")


def test_invalid_mappings(spark):
    k, c = knowledge(spark, "s1"), contributions(spark, "s1")
    canonical = spark.createDataFrame([("atlas", "entity", "Atlas")], CANONICAL)
    mappings = spark.createDataFrame([("s1", "r1", "e1", "atlas"), ("s1", "r1", "c1", "atlas"), ("s1", "old", "e2", "atlas")], MAPPING)
    assert sorted(r["local_id"] for r in graph.invalid_mappings(mappings, canonical, k["nodes"], c).collect()) == ["c1", "e2"]


def test_deduplication_maps_references(spark):
    rows = [("s", 0, "entity", "e1", "A", "t", ["x"], "d", ["q1"]), ("s", 1, "entity", "e2", "B", "t", [], "d", ["q2"]), ("s", 2, "entity", "e3", "A", "t", ["y"], "d", ["q1", "q3"]), ("s", 3, "entity", "e4", "A", "other", [], "d", ["q4"])]
    nodes, ids = enrichment.deduplicated_nodes(spark.createDataFrame(rows, enrichment.NODE_SCHEMA))
    got = nodes.orderBy("ord").collect()
    assert [r["id"] for r in got] == ["e1", "e2", "e4"]
    assert got[0]["aliases"] == ["x", "y"] and got[0]["evidence"] == ["q1", "q3"]
    relations = spark.createDataFrame([("s", 0, "e1", "e2", "r", "d", ["q"]), ("s", 1, "e3", "e2", "r", "d", ["q", "p"])], enrichment.RELATION_SCHEMA)
    assert [(r["source_id"], r["evidence"]) for r in enrichment.deduplicated_relations(relations, ids).collect()] == [("e1", ["q", "p"])]
    facts = spark.createDataFrame([("s", 0, "f", ["e2", "e3"], ["q"]), ("s", 1, "f", ["e1", "e2"], ["p"])], enrichment.FACT_SCHEMA)
    assert [(r["node_ids"], r["evidence"]) for r in enrichment.deduplicated_facts(facts, ids).collect()] == [(["e2", "e1"], ["q", "p"])]


def test_violations(spark):
    k = knowledge(spark, "s1")
    text = spark.createDataFrame([("s1", TEXT)], "section_id string, markdown string")
    assert enrichment.violations(k["nodes"], k["relations"], k["facts"], text).count() == 0
    bad = k["nodes"].withColumn("evidence", F.when(F.col("id") == "e1", F.array(F.lit("not there"))).otherwise(F.col("evidence"))).where("id <> 'c1'")
    reasons = {(r["path"], r["reason"]) for r in enrichment.violations(bad, k["relations"], k["facts"], text).collect()}
    assert reasons == {("entity[0]", "evidence_not_in_section"), ("relation[1]", "unresolved_reference"), ("fact[0]", "unresolved_reference")}


def test_provided(spark):
    sections = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "section_id string, revision string")
    given = spark.createDataFrame([("a", "1"), ("b", "0"), ("x", "1")], "section_id string, revision string")
    assert {(r[0], r[1]) for r in enrichment.provided_for(sections, given).collect()} == {("b", "stale"), ("c", "missing"), ("x", "unexpected")}


def test_change_plan(spark):
    schema = "section_id string, revision string, detail string"
    before = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("c", "1", "x"), ("d", "1", "x")], schema)
    after = spark.createDataFrame([("new", "1", "x"), ("a", "2", "x"), ("c", "1", "y"), ("d", "1", "x")], schema)
    plan = {r["section_id"]: (r["change"], r["rebuild"], r["invalidate"]) for r in changes.change_plan(before, after).collect()}
    assert plan == {"new": ("added", True, False), "a": ("modified", True, True), "b": ("removed", False, True), "c": ("source_only", False, False), "d": ("unchanged", False, False)}


def test_index_documents(spark):
    g = built(spark)
    chunks = spark.createDataFrame([("s1#chunk-0", "s1", "r1", "doc-s1", "Doc", "s1.md", ["H"], TEXT), ("s9#chunk-0", "s9", "r1", "d9", None, None, ["X", "Y"], "z")], "id string, section_id string, section_revision string, document_id string, document_title string, source_path string, heading_path array<string>, markdown string")
    pending = spark.createDataFrame([], "section_id string, section_revision string")
    docs = indexing.index_documents(chunks, g, pending, "kb")
    rows = {r["source_id"]: r for r in docs.collect()}
    one = rows["s1#chunk-0"]
    assert one["text"].startswith("文档：Doc\n\n章节：H\n\n原文：\n" + TEXT + "\n\n本节知识信息：\n") and one["knowledge_status"] == "ready"
    assert "实体：Atlas\n别名：A\nservice：calls" in one["text"] and len(one["nodes"]) == 3
    assert rows["s9#chunk-0"]["knowledge_status"] == "unavailable" and rows["s9#chunk-0"]["title"] == "X / Y"
    https = next(r for r in rows.values() if r["kind"] == "wiki" and r["title"] == "HTTPS")
    assert "事实：\nproduction uses HTTPS" in https["text"] and "关系：\nAtlas → HTTPS（uses）：uses it" in https["text"]
    assert [s["section_id"] for s in https["sources"]] == ["s1", "s2"]
    assert indexing.invalid_index_documents(docs).count() == 0
    with pytest.raises(TesseraError, match="STALE_SOURCE"):
        indexing.index_documents(chunks.withColumn("section_revision", F.lit("r0")), g, pending, "kb")
    with pytest.raises(TesseraError, match="INPUT_TOO_LARGE"):
        indexing.index_documents(chunks, g, pending, "kb", max_tokens=3)


def test_pages_quote_their_sources(spark):
    g = built(spark)
    pages = [r["markdown"] for r in graph.page_markdown(g["nodes"], g["edges"]).collect()]
    assert any(p.startswith("# HTTPS\n\n## 描述与证据") and "> 生产环境使用 HTTPS" in p for p in pages)


def test_embedding(spark):
    df = spark.createDataFrame([(str(i), f"text {i}", str(i)) for i in range(70)], "id string, text string, text_revision string").coalesce(1)
    out = indexing.embedded(df, indexing.HashEmbedder(16)).collect()
    assert len(out) == 70 and all(len(r["vector"]) == 16 for r in out) and sum(r["usage"] for r in out) == 140

    class Short(indexing.HashEmbedder):
        def embed(self, texts):
            return super().embed(texts[1:])

    with pytest.raises(Exception, match="INVALID_RESPONSE"):
        indexing.embedded(df, Short()).collect()


def test_integrity(spark):
    from tessera.operators import integrity

    g, c = {k: df.cache() for k, df in built(spark).items()}, contributions(spark, "s1", "s2")
    pending = spark.createDataFrame([], "section_id string, section_revision string")
    assert integrity.graph_problems(g, c, pending).count() == 0
    reasons = lambda graph_, c_=c, p_=pending: {r["reason"] for r in integrity.graph_problems(graph_, c_, p_).collect()}
    assert reasons(g, c.where("section_id = 's1'")) == {"link without contribution"}
    assert reasons(g, c, spark.createDataFrame([("s1", "r1")], pending.schema)) == {"waiting section is linked"}
    assert {"edge without node", "relations of node and edges"} <= reasons(g | {"nodes": g["nodes"].where("canonical_id IS NOT NULL")})
    with pytest.raises(TesseraError, match="repeated node"):
        integrity.check_graph(g | {"nodes": g["nodes"].unionByName(g["nodes"])}, c, pending)


def test_facts_without_nodes_stay(spark):
    facts = spark.createDataFrame([("s1", 0, "about none", [], ["e"]), ("s1", 1, "about one", ["a"], ["e"]), ("s1", 2, "about none", [], ["f"]), ("s1", 3, "about both", ["b", "a"], ["e"])], enrichment.FACT_SCHEMA)
    ids = spark.createDataFrame([("s1", "a", "a"), ("s1", "b", "a")], "section_id string, old string, new string")
    rows = enrichment.deduplicated_facts(facts, ids).orderBy("ord").collect()
    assert [(r["statement"], r["node_ids"], r["evidence"]) for r in rows] == [("about none", [], ["e", "f"]), ("about one", ["a"], ["e"]), ("about both", ["a"], ["e"])]


def test_a_node_that_every_section_cites(spark):
    """Linear in the sections of a node: each section's chunk says its own, the node's document cites all."""
    n = 4000
    ids = spark.range(n).select(F.format_string("s%05d", "id").alias("section_id"))
    where = ids.select("section_id", F.lit("r").alias("section_revision"), F.concat(F.lit("d"), "section_id").alias("document_id"), F.lit("p").alias("source_path"), F.array("section_id").alias("heading_path"))
    none = F.array().cast("array<string>")
    nodes = ids.select("section_id", F.lit(0).alias("ord"), F.lit("entity").alias("kind"), F.lit("e").alias("id"), F.lit("Hub").alias("name"), F.lit("t").alias("type"), none.alias("aliases"), F.concat(F.lit("about "), "section_id").alias("description"), F.array(F.lit("q")).alias("evidence"))
    facts = ids.select("section_id", F.lit(0).alias("ord"), F.lit("a fact").alias("statement"), F.array(F.lit("e")).alias("node_ids"), F.array(F.lit("q")).alias("evidence"))
    mappings = ids.select("section_id", F.lit("r").alias("section_revision"), F.lit("e").alias("local_id"), F.lit("hub").alias("canonical_id"))
    canonical = spark.createDataFrame([("hub", "entity", "Hub")], CANONICAL)
    g = graph.build_graph(where, nodes, spark.createDataFrame([], enrichment.RELATION_SCHEMA), facts, "kb", mappings, canonical)
    chunks = where.select(F.concat("section_id", F.lit("#0")).alias("id"), "section_id", "section_revision", "document_id", F.lit("T").alias("document_title"), "source_path", "heading_path", F.lit("text").alias("markdown"))
    pending = spark.createDataFrame([], "section_id string, section_revision string")
    said = indexing.chunk_documents(chunks, g, pending, "kb").select("source_id", "text", F.size("nodes").alias("n")).collect()
    assert len(said) == n and all(r["n"] == 1 and r["text"].endswith(f"本节知识信息：\n实体：Hub\nt：about {r['source_id'][:6]}") for r in said)
    hub = indexing.node_documents(g, "kb").collect()
    assert len(hub) == 1 and [x["section_id"] for x in hub[0]["sources"]] == [f"s{i:05}" for i in range(n)] and hub[0]["text"].count("t：about") == n
