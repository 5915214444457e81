"""Checks of a whole graph before it is indexed; every check is an anti-join or a count by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import TesseraError
from tessera.operators.graph import incident_edges


def _differences(a: DataFrame, b: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """Rows of either side that the other lacks, as (reason, id)."""
    left, right = a.select(keys).distinct(), b.select(keys).distinct()
    both = left.join(right, keys, "left_anti").unionByName(right.join(left, keys, "left_anti"))
    return both.select(F.lit(reason).alias("reason"), F.concat_ws("/", *keys).alias("id"))


def graph_problems(graph: dict[str, DataFrame], contributions: DataFrame, pending: DataFrame) -> DataFrame:
    """(reason, id) of what doesn't fit together: repeated ids; links that aren't contributions of the same
    revision; waiting sections that are linked; nodes' sections unlike the links or the citations; relation
    ids unlike the edges at a node; edges without their nodes. No rows for a sound graph."""
    nodes, edges, links = graph["nodes"], graph["edges"], graph["links"]
    found = []
    for name, df, key in (("node", nodes, "node_id"), ("edge", edges, "edge_id"), ("link", links, "section_id"), ("contribution", contributions, "section_id")):
        repeated = df.groupBy(F.col(key).alias("id")).count().where("count > 1")
        found.append(repeated.select(F.lit(f"repeated {name}").alias("reason"), "id"))
    found.append(_differences(links, contributions, ["section_id", "section_revision"], "link without contribution"))
    found.append(links.join(pending, "section_id", "left_semi").select(F.lit("waiting section is linked").alias("reason"), F.col("section_id").alias("id")))
    linked = links.select("section_id", F.explode("node_ids").alias("node_id"))
    placed = nodes.select("node_id", F.explode("section_ids").alias("section_id"))
    found.append(_differences(linked, placed, ["node_id", "section_id"], "sections of node and links"))
    cited = nodes.select("node_id", F.explode("descriptions").alias("d")).select("node_id", F.explode("d.citations").alias("c")).select("node_id", "c.section_id")
    found.append(_differences(cited, placed, ["node_id", "section_id"], "sections of node and citations"))
    related = nodes.select("node_id", F.explode("relation_ids").alias("edge_id"))
    found.append(_differences(related, incident_edges(edges).select("node_id", "edge_id"), ["node_id", "edge_id"], "relations of node and edges"))
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id"))
    found.append(ends.join(nodes, "node_id", "left_anti").select(F.lit("edge without node").alias("reason"), F.col("node_id").alias("id")))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def check_graph(graph: dict[str, DataFrame], contributions: DataFrame, pending: DataFrame) -> None:
    bad = graph_problems(graph, contributions, pending).limit(1).collect()
    if bad:
        raise TesseraError("INVALID_INPUT", bad[0]["reason"], path=bad[0]["id"])
