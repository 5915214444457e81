"""Model output as text: what is wrong with it, and what it says."""

import json

import pytest

from tessera.operators import enrichment, output

GOOD = {
    "summary": " s ", "keywords": ["k"], "aliases": [], "questions": ["q"], "knowledgeType": "guide",
    "entities": [{"id": "e1", "name": " Atlas ", "type": "service", "aliases": ["A"], "description": "d", "evidence": ["x"]}],
    "concepts": [{"id": "c1", "name": "HTTPS", "aliases": [], "description": "d", "evidence": ["x", "y"]}],
    "relations": [{"sourceId": "e1", "targetId": "c1", "type": "uses", "description": "d", "evidence": ["x"]}],
    "facts": [{"statement": "f", "nodeIds": ["e1", "c1"], "evidence": ["x"]}],
}


def changed(*steps):
    """GOOD with a value put (or, without one, taken away) at a path."""
    value = json.loads(json.dumps(GOOD))
    path, new = steps[0], steps[1:]
    at = value
    for key in path[:-1]:
        at = at[key]
    if new:
        at[path[-1]] = new[0]
    else:
        del at[path[-1]]
    return json.dumps(value, ensure_ascii=False)


CASES = [
    (json.dumps(GOOD), []),
    ("", [("JSON", "invalid-json")]),
    ("{", [("JSON", "invalid-json")]),
    ("```json\n{}\n```", [("JSON", "invalid-json")]),
    (None, [("JSON", "invalid-json")]),
    ('"' + "x" * 200_000 + '"', [("JSON", "text-too-long")]),
    ("[]", [("root", "invalid-object")]),
    ("null", [("root", "invalid-object")]),
    (changed(["other"], 1), [("root", "unexpected-field")]),
    (changed(["summary"]), [("summary", "missing-field")]),
    (changed(["summary"], None), [("summary", "invalid-text")]),
    (changed(["summary"], 5), [("summary", "invalid-text")]),
    (changed(["summary"], " 　\n"), [("summary", "invalid-text")]),
    (changed(["summary"], "x" * 4000), []),
    (changed(["summary"], "😀" * 2001), [("summary", "text-too-long")]),
    (changed(["keywords"], "k"), [("keywords", "invalid-array")]),
    (changed(["keywords"], ["a", 1, None, {}, ""]), [(f"keywords[{i}]", "invalid-text") for i in (1, 2, 3, 4)]),
    (changed(["keywords"], ["a"] * 101), [("keywords", "too-many-items")]),
    (changed(["knowledgeType"], "tutorial"), [("knowledgeType", "unsupported-value")]),
    (changed(["knowledgeType"], "security-rule"), []),
    (changed(["entities"], {}), [("entities", "invalid-array")]),
    (changed(["entities", 0], 7), [("entities[0]", "invalid-object")]),
    (changed(["entities", 0, "id"], "a b"), [("entities[0].id", "invalid-id")]),
    (changed(["entities", 0, "type"]), [("entities[0].type", "missing-field")]),
    (changed(["concepts", 0, "type"], "t"), [("concepts[0]", "unexpected-field")]),
    (changed(["concepts", 0, "evidence"], []), [("concepts[0].evidence", "empty-evidence")]),
    (changed(["concepts", 0, "evidence"], ["x"] * 11), [("concepts[0].evidence", "too-many-items")]),
    (changed(["concepts", 0, "evidence"], ["x", " "]), [("concepts[0].evidence[1]", "invalid-text")]),
    (changed(["relations", 0, "sourceId"], {}), [("relations[0].sourceId", "invalid-text")]),
    (changed(["facts", 0, "nodeIds"], [1]), [("facts[0].nodeIds[0]", "invalid-text")]),
    ("{}", [(name, "missing-field") for name in output.ROOT]),
]


def test_issues_have_their_path(spark):
    rows = [(f"s{i}", text) for i, (text, _) in enumerate(CASES)]
    got = {}
    for r in output.output_issues(spark.createDataFrame(rows, "section_id string, output string")).collect():
        got.setdefault(r["section_id"], []).append((r["path"], r["reason"]))
    for i, (text, want) in enumerate(CASES):
        assert sorted(got.get(f"s{i}", [])) == sorted(want), text and text[:300]


def test_knowledge_is_what_the_rest_takes(spark):
    found = output.knowledge_of(spark.createDataFrame([("s", json.dumps(GOOD)), ("t", "{")], "section_id string, output string"))
    schemas = {"nodes": enrichment.NODE_SCHEMA, "relations": enrichment.RELATION_SCHEMA, "facts": enrichment.FACT_SCHEMA}
    for name, schema in schemas.items():
        assert [(f.name, f.dataType) for f in found[name].schema] == [(f.name, f.dataType) for f in spark.createDataFrame([], schema).schema]
    assert [tuple(r) for r in found["nodes"].orderBy("ord").collect()] == [("s", 0, "entity", "e1", "Atlas", "service", ["A"], "d", ["x"]), ("s", 100, "concept", "c1", "HTTPS", None, [], "d", ["x", "y"])]
    assert found["summaries"].first()["summary"] == "s" and found["facts"].first()["node_ids"] == ["e1", "c1"]
    text = spark.createDataFrame([("s", "x y")], "section_id string, markdown string")
    assert enrichment.violations(found["nodes"], found["relations"], found["facts"], text).count() == 0


@pytest.mark.parametrize("rows", [[], [("s", None)]])
def test_no_output(spark, rows):
    df = spark.createDataFrame(rows, "section_id string, output string")
    assert output.output_issues(df).count() == len(rows) and output.knowledge_of(df)["nodes"].count() == 0


def test_outputs_are_parsed_in_one_pass(spark):
    df = output.output_issues(spark.range(3).selectExpr("string(id) AS section_id", "concat('{', id) AS output"))
    found = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in found
