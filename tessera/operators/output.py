"""Model output, as text, to rows of knowledge: parsed strictly into VARIANT, every field checked, nothing mended.

Everything is expressions and explodes over the VARIANT, a level at a time: the output's own fields, the
items of its lists, their fields, and the texts in these. What is wrong is a row with its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.canon import trimmed, utf16_length
from tessera.operators.enrichment import ID_PATTERN, KNOWLEDGE_TYPES, MAX_EVIDENCE, MAX_ITEMS, MAX_TEXT

MAX_OUTPUT = 200_000
#: Fields by where they stand, and what each must be: a text, an id, texts, quotes, a list of items, or a type.
ROOT = {"summary": "text", "keywords": "texts", "aliases": "texts", "questions": "texts", "entities": "items", "concepts": "items", "relations": "items", "facts": "items", "knowledgeType": "choice"}
_NODE = {"id": "id", "name": "text", "aliases": "texts", "description": "text", "evidence": "quotes"}
ITEMS = {
    "entities": _NODE | {"type": "text"},
    "concepts": _NODE,
    "relations": {"sourceId": "text", "targetId": "text", "type": "text", "description": "text", "evidence": "quotes"},
    "facts": {"statement": "text", "nodeIds": "texts", "evidence": "quotes"},
}


#: Why a text isn't read at all.
_UNREAD = ("invalid-json", "text-too-long")


def parsed(outputs: DataFrame, output: str = "output") -> DataFrame:
    """section_id, value (VARIANT; null where the text isn't JSON, or is too long) and reason of ``outputs``. Of keys
    that an object repeats none is taken: such text isn't read."""
    text = F.col(output)
    fits = utf16_length(text) <= MAX_OUTPUT
    value = F.when(fits, F.try_parse_json(text))
    reason = F.when(text.isNull(), "invalid-json").when(~fits, "text-too-long").when(value.isNull(), "invalid-json")
    return outputs.select("section_id", value.alias("value"), reason.alias("reason"))


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, ... of a VARIANT; null of what isn't there."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _list(value: Column) -> Column:
    """The members of a VARIANT that is an array, else null."""
    return F.try_variant_get(value, "$", "array<variant>")


def _objects(values: DataFrame) -> DataFrame:
    """section_id, of (root, or the list that holds it), path and value: an output itself, and all items of its lists. Of a
    text that can't be read, of is the reason and path JSON."""
    df = values.withColumn("_fields", F.try_variant_get("value", "$", "map<string,variant>"))
    df = df.withColumns({f"_{name}": _list(F.try_element_at("_fields", F.lit(name))) for name in ITEMS})
    row = lambda of, path, value: F.struct(of.alias("of"), path.alias("path"), value.alias("value"))
    none = F.array().cast("array<struct<of:string,path:string,value:variant>>")
    item = lambda name: lambda x, i: row(F.lit(name), F.format_string(f"{name}[%d]", i), x)
    lists = [F.coalesce(F.transform(f"_{name}", item(name)), none) for name in ITEMS]
    return df.select("section_id", F.inline(F.concat(F.array(row(F.coalesce("reason", F.lit("root")), F.when(F.col("reason").isNull(), "").otherwise("JSON"), F.col("value"))), *lists)))


def _fields(objects: DataFrame) -> DataFrame:
    """section_id, path, rule and value of the fields that objects must have, and of the objects themselves (rule object;
    extra where they have fields that they may not have)."""
    rules = {"root": ROOT} | ITEMS
    expected = F.create_map(*(x for of, fields in rules.items() for x in (F.lit(of), F.array(*(F.struct(F.lit(n).alias("name"), F.lit(r).alias("rule")) for n, r in fields.items())))))
    df = objects.withColumn("_map", F.try_variant_get("value", "$", "map<string,variant>"))
    df = df.withColumn("_expected", F.try_element_at(expected, F.col("of")))
    own = F.when(F.col("path") == "", "root").otherwise(F.col("path"))
    extra = F.size(F.array_except(F.map_keys("_map"), F.transform("_expected", lambda e: e["name"]))) > 0
    itself = F.struct(own.alias("path"), F.when(F.col("_expected").isNull(), F.col("of")).when(F.col("_map").isNull(), "object").when(extra, "extra").otherwise("sound").alias("rule"), F.col("value").alias("value"))
    begin = F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit(".")))
    held = F.transform("_expected", lambda e: F.struct(F.concat(begin, e["name"]).alias("path"), e["rule"].alias("rule"), F.try_element_at("_map", e["name"]).alias("value")))
    return df.select("section_id", F.inline(F.concat(F.array(itself), F.coalesce(F.when(F.col("_map").isNotNull(), held), F.slice(F.array(itself), 1, 0)))))


def output_issues(outputs: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """What is wrong with model outputs (section_id, output): path and reason, a row for each fault. Unknown fields,
    missing ones, wrong types, sizes and lengths count; references and quotes are left to ``violations``. A text
    that isn't JSON has one row, with the path JSON. A text is parsed once; objects, fields and the texts in lists
    are rows of three explodes, without a join or a shuffle."""
    fields = _fields(_objects(parsed(outputs)))
    fields = fields.withColumn("members", F.when(F.col("rule").isin("texts", "quotes", "items"), _list(F.col("value"))))
    whole = F.col("rule").isin("texts", "quotes", "items", "object", "extra", "sound", *_UNREAD)
    # What is inside of lists and objects has rows of its own: no schema of it is wanted.
    kind = F.when(F.col("value").isNull(), None).when(F.col("members").isNotNull(), "ARRAY").when(whole, "OTHER").otherwise(_kind(F.col("value")))
    fields = fields.withColumn("kind", kind)
    member = lambda x, i: F.struct(F.format_string("%s[%d]", F.col("path"), i).alias("path"), F.lit("text").alias("rule"), x.alias("value"), _kind(x).alias("kind"), F.lit(0).alias("size"))
    itself = F.struct("path", "rule", F.when(~whole, F.col("value")).alias("value"), "kind", F.size("members").alias("size"))
    texts = F.when(F.col("rule") != "items", F.transform("members", member))
    rows = fields.select("section_id", F.inline(F.concat(F.array(itself), F.coalesce(texts, F.slice(F.array(itself), 1, 0)))))
    text = F.when(F.col("kind") == "STRING", F.try_variant_get("value", "$", "string"))
    rows = rows.select("section_id", "path", "rule", "kind", "size", text.alias("text")).withColumn("trimmed", trimmed(F.col("text")))
    rule, kind, size = F.col("rule"), F.col("kind"), F.col("size")
    listed, least, most = rule.isin("texts", "quotes", "items"), F.when(rule == "quotes", 1).otherwise(0), F.when(rule == "quotes", MAX_EVIDENCE).otherwise(MAX_ITEMS)
    reason = (
        F.when(rule == "sound", None).when(rule.isin(*_UNREAD), rule).when(rule == "object", "invalid-object").when(rule == "extra", "unexpected-field")
        .when(kind.isNull(), "missing-field")
        .when(listed, F.when(kind != "ARRAY", "invalid-array").when(size < least, "empty-evidence").when(size > most, "too-many-items"))
        .when(kind != "STRING", "invalid-text").when(utf16_length(F.col("text")) > MAX_TEXT, "text-too-long").when(F.length("trimmed") == 0, "invalid-text")
        .when((rule == "id") & ~F.col("trimmed").rlike(ID_PATTERN), "invalid-id")
        .when((rule == "choice") & ~F.col("trimmed").isin(list(types or KNOWLEDGE_TYPES)), "unsupported-value")
    )
    return rows.select("section_id", "path", reason.alias("reason")).where("reason IS NOT NULL")


def _items(values: DataFrame, name: str) -> DataFrame:
    """section_id, ord, path and value of the items of a list of the output."""
    x = F.try_variant_get("value", f"$.{name}", "variant")
    items = F.when(_kind(F.col("value")) == "OBJECT", F.when(_kind(x) == "ARRAY", x.cast("array<variant>")))
    return values.select("section_id", F.posexplode(items).alias("ord", "value")).withColumn("path", F.format_string(f"{name}[%d]", "ord"))


def knowledge_of(outputs: DataFrame) -> dict[str, DataFrame]:
    """nodes, relations and facts (as ``enrichment`` has them) and summaries (section_id, summary, keywords, aliases,
    questions, knowledge_type) of outputs without issues; texts without white space around them."""
    values = parsed(outputs).where("reason IS NULL")
    text = lambda name: trimmed(F.try_variant_get("value", f"$.{name}", "string")).alias(name)
    texts = lambda name: F.transform(F.try_variant_get("value", f"$.{name}", "array<string>"), trimmed).alias(name)
    nodes = None
    # The order of a section's nodes: entities, then concepts.
    for name, kind, first in (("entities", "entity", 0), ("concepts", "concept", MAX_ITEMS)):
        some = _items(values, name).select("section_id", (F.col("ord") + first).alias("ord"), F.lit(kind).alias("kind"), text("id"), text("name"), (text("type") if kind == "entity" else F.lit(None).cast("string").alias("type")), texts("aliases"), text("description"), texts("evidence"))
        nodes = some if nodes is None else nodes.unionByName(some)
    relations = _items(values, "relations").select("section_id", "ord", text("sourceId").alias("source_id"), text("targetId").alias("target_id"), text("type"), text("description"), texts("evidence"))
    facts = _items(values, "facts").select("section_id", "ord", text("statement"), texts("nodeIds").alias("node_ids"), texts("evidence"))
    summaries = values.select("section_id", text("summary"), texts("keywords"), texts("aliases"), texts("questions"), text("knowledgeType").alias("knowledge_type"))
    return {"nodes": nodes, "relations": relations, "facts": facts, "summaries": summaries}
