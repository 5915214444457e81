"""Sharding by longest processing time: groups that must stay together go, in order of size, to the shard
that has the least so far, which a heap tells.

Documents with equal texts form a group. Groups that hold more than one PARTS-th of a shard are at most
shards * PARTS, and each is scheduled by itself. All others are dealt by their checksum to shards * PARTS
bundles, and a bundle is scheduled as one; so what the heap goes through is bounded whatever the number of
groups, and shards differ by about one bundle at most. A group that is larger than a shard's share has
its shard to itself, beside what tops up the others.

Only sizes and checksums are shuffled, never texts. Rows that agree in all of these are counted before
that, so neither a group with a third of all rows nor an id with as many comes to one task.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import TesseraError
from tessera.llm.shared import materialize, table, text_or_empty, unused

SHARDS = 40
#: What each document takes besides its text's bytes.
OVERHEAD = 16
#: Bundles for each shard, and the share of a shard from which a group is scheduled by itself.
PARTS = 250
#: Slots are counted within so many runs of a shard.
RUNS = 1024


def schedule(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item: the largest first (of equal ones the first), each to the shard with the least
    load (of equal ones the first)."""
    loads = [(0, shard) for shard in range(shards)]
    out = [0] * len(sizes)
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, out[item] = loads[0]
        heapq.heapreplace(loads, (load + sizes[item], out[item]))
    return out


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and content (a hash: where it agrees for two texts, they stay together)."""
    text = text_or_empty()
    return docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("content"))


class Plan(NamedTuple):
    """Where groups that are scheduled by themselves go (text_crc32, content, shard), and where the bundles of
    the others go (bundle, shard). Neither table has more rows than there are bundles."""

    alone: DataFrame
    bundled: DataFrame
    bundles: int


def plan_shards(rows: DataFrame, shards: int, parts: int) -> Plan:
    """The schedule of the groups of ``rows`` (text_crc32, content, size)."""
    if shards < 1 or parts < 1:
        raise TesseraError("INVALID_OPTIONS", "shards and parts are positive")
    bundles = shards * parts
    groups = materialize(rows.groupBy("text_crc32", "content").agg(F.sum("size").alias("size")), "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    alone = F.col("size") * bundles > total
    heavy = sorted(tuple(r) for r in groups.where(alone).select("text_crc32", "content", "size").collect())
    light = sorted(tuple(r) for r in groups.where(~alone).groupBy((F.col("text_crc32") % bundles).alias("bundle")).agg(F.sum("size").alias("size")).collect())
    placed = schedule([x[-1] for x in heavy + light], shards)
    columns = [pa.array(c, pa.int64()) for c in ([x[0] for x in heavy], [x[1] for x in heavy], placed[: len(heavy)], [x[0] for x in light], placed[len(heavy) :])]
    tables = (pa.table(columns[:3], ["text_crc32", "content", "shard"]), pa.table(columns[3:], ["bundle", "shard"]))
    return Plan(*(rows.sparkSession.createDataFrame(t) for t in tables), bundles)


def _placed(rows: DataFrame, plan: Plan, crc: str = "text_crc32", content: str = "content") -> DataFrame:
    """``rows`` with their shard, by their text's checksum and hash. The plan is broadcast, as its size is bounded."""
    bundle, a, b = unused(rows, "bundle", "shard_alone", "shard_bundled")
    alone = plan.alone.select(F.col("text_crc32").alias(crc), F.col("content").alias(content), F.col("shard").alias(a))
    bundled = plan.bundled.select(F.col("bundle").alias(bundle), F.col("shard").alias(b))
    out = rows.withColumn(bundle, F.col(crc) % plan.bundles).join(F.broadcast(alone), [crc, content], "left").join(F.broadcast(bundled), bundle, "left")
    return out.withColumn("shard", F.coalesce(a, b).cast("int")).drop(bundle, a, b)


def shard_documents(docs: DataFrame, shards: int = SHARDS, parts: int = PARTS) -> DataFrame:
    """A row for each row of ``docs``: doc_id, size (UTF-8 bytes of the text plus OVERHEAD), text_crc32, law
    ("bytes": shards have nearly equal sizes), shard, slot (0, 1, 2, ... within the shard), grown_shard (null,
    as one more shard would mean another schedule).

    Equal texts share a shard; null texts count as empty ones and form one group with them. Within a shard
    rows stand by a hash of the doc_id, then by doc_id (null ones by their text); rows that repeat get a
    slot each. The schedule depends on sizes and checksums only, so reruns agree. An empty table has no
    rows, and with fewer groups than shards some shards stay empty. Other columns aren't looked at.
    """
    rows = materialize(_rows(docs), "sizes")
    counted = rows.groupBy("doc_id", "size", "text_crc32", "content").agg(F.count("*").alias("n"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text_crc32").cast("string")))
    run = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint") % RUNS
    counted = materialize(_placed(counted, plan_shards(rows, shards, parts)).withColumn("run", run), "placed")
    # Slots from two running sums: over a shard's runs (a bounded number of rows), and within a run.
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = counted.groupBy("shard", "run").agg(F.sum("n").alias("m"))
    runs = runs.select("shard", "run", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size", "content").rowsBetween(Window.unboundedPreceding, -1)
    slotted = counted.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(runs), ["shard", "run"])
    first = F.col("base") + F.col("inner")
    slotted = slotted.withColumn("slot", F.explode(F.sequence(first, first + F.col("n") - 1)))
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, parts: int = PARTS) -> DataFrame:
    """Writes ``docs`` as Parquet below ``path``, a folder ``shard=0``, ``shard=1``, ... for each shard that has
    documents, and returns what can be read there. All columns are kept. Texts are shuffled once, to their
    shards; large shards are split among tasks by their measured size (``spark.sql.adaptive``)."""
    if "shard" in {c.lower() for c in docs.columns}:
        raise TesseraError("INVALID_OPTIONS", "there is a column shard")
    crc, content = unused(docs, "text_crc32", "content")
    text = text_or_empty()
    keyed = docs.withColumns({crc: F.crc32(text.cast("binary")), content: F.xxhash64(text)})
    placed = _placed(keyed, plan_shards(_rows(docs), shards, parts), crc, content)
    placed = placed.select(*docs.columns, "shard")
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(placed.schema).parquet(path)


def op12_shards(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))


#: SQL steps (for DuckDB) that give crc32 of rows (id, t): named as ``checksums(id, crc)``.
CRC32_SQL = """
crc_table AS (SELECT [list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) FOR i IN range(256)] AS t),
checksums AS (SELECT id, xor(list_reduce([('0x' || x)::bigint FOR x IN regexp_extract_all(hex(encode(texts.t)), '..')], lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc FROM texts, crc_table)
"""

ORACLE_SQL = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
texts AS (SELECT min(id) AS id, t FROM docs GROUP BY t), {CRC32_SQL},
sized AS (SELECT d.doc_id, d.t, octet_length(encode(d.t)) + {OVERHEAD} AS size, c.crc FROM docs d JOIN texts x USING (t) JOIN checksums c ON c.id = x.id),
grouped AS (SELECT t, crc, sum(size)::bigint AS size, sum(size) * {SHARDS * PARTS} > (SELECT sum(size) FROM sized) AS alone FROM sized GROUP BY t, crc),
items AS (SELECT crc, t, NULL::bigint AS bundle, size FROM grouped WHERE alone UNION ALL SELECT NULL::bigint, NULL::varchar, crc % {SHARDS * PARTS}, sum(size)::bigint FROM grouped WHERE NOT alone GROUP BY ALL),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY size DESC, bundle NULLS FIRST, crc) AS i FROM items),
heap AS (SELECT 0::bigint AS i, 0 AS shard, list_transform(range({SHARDS}), lambda x: 0::bigint) AS loads
    UNION ALL SELECT o.i, list_position(loads, list_min(loads)) - 1, list_transform(loads, lambda x, k: x + CASE WHEN k = list_position(loads, list_min(loads)) THEN o.size ELSE 0 END)
    FROM heap JOIN ordered o ON o.i = heap.i + 1),
plan AS (SELECT crc, t, bundle, shard FROM ordered JOIN heap USING (i)),
placed AS (SELECT s.*, coalesce(a.shard, b.shard) AS shard FROM sized s LEFT JOIN plan a ON s.t = a.t LEFT JOIN plan b ON b.bundle = s.crc % {SHARDS * PARTS}),
runs AS (SELECT *, ('0x' || sha256(coalesce(doc_id::varchar, 'text ' || crc))[1:8])::bigint % {RUNS} AS run FROM placed)
SELECT doc_id, size::bigint AS size, crc::bigint AS text_crc32, 'bytes' AS law, shard::int AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY run, doc_id NULLS FIRST, crc, size) - 1 AS slot, NULL::int AS grown_shard
FROM runs
"""
