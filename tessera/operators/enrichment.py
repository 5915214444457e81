"""Validation and deduplication of extracted knowledge: entities, concepts, relations, facts.

Rows carry section_id and ord, the place in the extraction, so that "first" has a meaning without
relying on row order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.canon import is_blank, trimmed, utf16_length

MAX_TEXT, MAX_ITEMS, MAX_EVIDENCE = 4000, 100, 10
ID_PATTERN = r"^[\w-]{1,80}$"
KINDS = ("entity", "concept")
#: Types of knowledge that a section may have, and what they say to a model.
KNOWLEDGE_TYPES = {
    "concept": "概念定义、术语解释、原理",
    "guide": "操作流程、接入步骤、迁移教程",
    "api": "接口、请求参数、返回结构、错误码",
    "example": "代码样例、调用示例、演示",
    "faq": "常见问题与解答",
    "troubleshooting": "问题诊断、故障原因及解决方法",
    "security-rule": "安全要求、权限限制、凭据与隐私规则",
    "configuration": "配置项、环境变量、部署参数",
    "architecture": "系统架构、组件职责、交互与依赖",
    "reference": "枚举、字段表、命令和其他查阅资料",
    "specification": "协议、数据格式、行为规范与约定",
    "decision": "技术方案选择、决策理由与取舍",
    "changelog": "版本变更、发布记录、兼容性变化",
    "incident": "事故记录、影响、处置过程和复盘",
    "overview": "产品介绍、能力概览、文档导航",
    "other": "无法归入现有分类的内容，不推测缺失的信息",
}
_TYPE_KEY = r"^[a-z][a-z0-9]*(-[a-z0-9]+)*$"

NODE_SCHEMA = "section_id string, ord int, kind string, id string, name string, type string, aliases array<string>, description string, evidence array<string>"
RELATION_SCHEMA = "section_id string, ord int, source_id string, target_id string, type string, description string, evidence array<string>"
FACT_SCHEMA = "section_id string, ord int, statement string, node_ids array<string>, evidence array<string>"


def knowledge_types(custom: dict[str, str] | None = None) -> dict[str, str]:
    """The types with descriptions; custom ones, at most 100 in kebab case, come on top."""
    import re

    from tessera.errors import TesseraError

    if custom and (len(custom) > 100 or any(not re.match(_TYPE_KEY, k) for k in custom)):
        raise TesseraError("INVALID_OPTIONS", "knowledge types")
    return KNOWLEDGE_TYPES | (custom or {})


def _reason(*rules: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for bad, reason in reversed(rules):
        out = F.when(bad, reason).otherwise(out)
    return out


def _too_long(c: str) -> Column:
    return utf16_length(F.col(c)) > MAX_TEXT


def violations(nodes: DataFrame, relations: DataFrame, facts: DataFrame, sections: DataFrame) -> DataFrame:
    """What keeps an extraction from being used: section_id, path, reason. Quotes must stand in the section's
    markdown word for word; ids are unique in a section and references resolve in it."""
    text = sections.select(F.col("section_id").alias("_s"), "markdown")
    checked = nodes.join(text, F.col("section_id") == F.col("_s"), "left")
    evidence_rules = (
        (F.size("evidence").between(1, MAX_EVIDENCE) == F.lit(False), "evidence_count"),
        (F.exists("evidence", lambda e: is_blank(e) | ~F.coalesce(F.contains(F.col("markdown"), e), F.lit(False))), "evidence_not_in_section"),
    )
    node_rules = _reason(
        (~F.col("id").rlike(ID_PATTERN), "invalid_id"),
        (is_blank(F.col("name")) | _too_long("name"), "invalid_name"),
        (is_blank(F.col("description")) | _too_long("description"), "invalid_description"),
        ((F.col("kind") == "entity") & is_blank(F.col("type")), "invalid_type"),
        (F.size("aliases") > MAX_ITEMS, "too_many_items"),
        *evidence_rules,
    )
    found = [checked.select("section_id", F.format_string("%s[%d]", F.col("kind"), F.col("ord")).alias("path"), node_rules.alias("reason"))]
    repeated = nodes.groupBy("section_id", "id").count().where("count > 1")
    found.append(repeated.select("section_id", F.col("id").alias("path"), F.lit("duplicate_id").alias("reason")))
    ids = nodes.select(F.col("section_id").alias("_s"), F.col("id").alias("_i")).distinct()
    ends = relations.select("section_id", "ord", F.explode(F.array("source_id", "target_id")).alias("ref"), F.lit("relation").alias("of"))
    ends = ends.unionByName(facts.select("section_id", "ord", F.explode("node_ids").alias("ref"), F.lit("fact").alias("of")))
    loose = ends.join(ids, (F.col("section_id") == F.col("_s")) & (F.col("ref") == F.col("_i")), "left_anti")
    found.append(loose.select("section_id", F.format_string("%s[%d]", F.col("of"), F.col("ord")).alias("path"), F.lit("unresolved_reference").alias("reason")))
    for of, df in (("relation", relations), ("fact", facts)):
        checked = df.join(text, F.col("section_id") == F.col("_s"), "left")
        found.append(checked.select("section_id", F.format_string(f"{of}[%d]", F.col("ord")).alias("path"), _reason(*evidence_rules).alias("reason")))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.where("reason IS NOT NULL")


def missing_evidence(evidence: DataFrame, sections: DataFrame) -> DataFrame:
    """Quotes (section_id, quote) that aren't in their section; the join is on the section's id."""
    return evidence.join(sections.select("section_id", "markdown"), "section_id", "left").where(~F.coalesce(F.contains(F.col("markdown"), F.col("quote")), F.lit(False))).drop("markdown")


#: Characters of the quotes that one pass looks for, about.
QUOTE_CHARACTERS = 16 << 20


def held_quotes(texts: DataFrame, quotes: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, quote) for each text that holds a quote (a column of ``quotes``) word for word. Empty and null
    quotes are in no text; repeated ones count as one.

    Quotes are dealt by hash to passes of about QUOTE_CHARACTERS, each of which becomes an automaton that goes
    over each text once, however many quotes it holds."""
    distinct = quotes.select("quote").where(F.length("quote") > 0).distinct()
    total = distinct.agg(F.sum(F.length("quote"))).first()[0] or 0
    n_passes = 1 if total <= QUOTE_CHARACTERS else -(-2 * total // QUOTE_CHARACTERS)
    dealt = distinct.withColumn("pass", F.pmod(F.xxhash64("quote"), F.lit(n_passes)))
    out = texts.sparkSession.createDataFrame([], f"`{key}` {texts.schema[key].dataType.simpleString()}, quote string")
    for number in range(n_passes):
        found = [r["quote"] for r in dealt.where(F.col("pass") == number).collect()]
        if found:
            out = out.unionByName(_held(texts.select(key, text), found))
    return out


def _held(texts: DataFrame, quotes: list[str]) -> DataFrame:
    key = texts.schema.fields[0]
    shared = texts.sparkSession.sparkContext.broadcast(quotes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for quote in shared.value:
            automaton.add_word(quote, quote)
        automaton.make_automaton()
        for batch in batches:
            hits = [(i, q) for i, t in enumerate(batch.column(1).to_pylist()) for q in sorted({q for _, q in automaton.iter(t or "")})]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in hits], pa.int64())), pa.array([q for _, q in hits], pa.string())], [key.name, "quote"])

    return texts.mapInArrow(run, f"`{key.name}` {key.dataType.simpleString()}, quote string")


def _in_first_order(values: str) -> Column:
    """Distinct members of arrays gathered with their row's place, in order of first appearance."""
    gathered = F.array_sort(F.collect_list(F.struct("ord", F.col(values).alias("v"))))
    return F.array_distinct(F.flatten(F.transform(gathered, lambda x: x["v"])))


def deduplicated_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes equal in name, type and description (concepts: name and description) become the first of
    them, with all aliases and evidence; and (section_id, old, new) for every id."""
    same = ["section_id", "kind", "name", "_type", "description"]
    keyed = nodes.withColumn("_type", F.when(F.col("kind") == "entity", F.coalesce("type", F.lit(""))).otherwise(""))
    merged = keyed.groupBy(*same).agg(F.min("ord").alias("ord"), F.min_by("id", "ord").alias("id"), F.min_by("type", "ord").alias("type"), _in_first_order("aliases").alias("aliases"), _in_first_order("evidence").alias("evidence"))
    ids = keyed.select(*same, F.col("id").alias("old")).join(merged.select(*same, F.col("id").alias("new")), same).select("section_id", "old", "new")
    return merged.select("section_id", "ord", "kind", "id", "name", "type", "aliases", "description", "evidence"), ids


def deduplicated_relations(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Ends mapped to the nodes that stay, then equal relations merged."""
    for end in ("source_id", "target_id"):
        mapped = ids.select("section_id", F.col("old").alias(end), F.col("new").alias("_new"))
        relations = relations.join(mapped, ["section_id", end]).withColumn(end, F.col("_new")).drop("_new")
    return relations.groupBy("section_id", "source_id", "target_id", "type", "description").agg(F.min("ord").alias("ord"), _in_first_order("evidence").alias("evidence"))


def deduplicated_facts(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Node ids mapped; facts of one statement about the same nodes, in any order, merged. A fact may be
    about no node."""
    exploded = facts.select("section_id", "ord", "statement", "evidence", F.posexplode_outer("node_ids").alias("at", "old")).join(ids, ["section_id", "old"], "left")
    nodes = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("new").isNotNull(), F.struct("at", "new")))), lambda x: x["new"]))
    mapped = exploded.groupBy("section_id", "ord").agg(F.first("statement").alias("statement"), F.first("evidence").alias("evidence"), nodes.alias("node_ids"))
    mapped = mapped.withColumn("_same", F.array_sort("node_ids"))
    return mapped.groupBy("section_id", "statement", "_same").agg(F.min("ord").alias("ord"), F.min_by("node_ids", "ord").alias("node_ids"), _in_first_order("evidence").alias("evidence")).drop("_same")


def first_of_each(items: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Exactly equal items once, at their first place."""
    return items.groupBy(*keys).agg(F.min(order).alias(order))


def provided_for(sections: DataFrame, provided: DataFrame) -> DataFrame:
    """Mismatches of prepared enrichment and sections, both (section_id, revision): missing, unexpected,
    repeated or stale ones; no rows if it can be used."""
    counted = provided.groupBy("section_id").agg(F.count("*").alias("n"), F.min("revision").alias("given"))
    joined = sections.select("section_id", "revision", F.lit(True).alias("known")).join(counted, "section_id", "full_outer")
    reason = _reason((F.col("n").isNull(), "missing"), (F.col("known").isNull(), "unexpected"), (F.col("n") > 1, "repeated"), (F.col("given") != F.col("revision"), "stale"))
    return joined.select("section_id", reason.alias("reason")).where("reason IS NOT NULL")


def normalized_text(column: str) -> Column:
    return trimmed(F.col(column))
