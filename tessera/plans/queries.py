"""The engine's operators as queries over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import canon
from tessera.operators import catalog, changes, enrichment, graph, indexing, logs, search, sections
from tessera.sources.staging import Staging
from tessera.sources.store import SnapshotStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table as it was read, its rows dealt to all cores if its files give fewer tasks than there are; so work on rows
    that is heavy, as reading documents is, isn't left to the tasks of a file of one row group."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as records: even labels are chunks, odd ones nodes."""
    kind = F.when(F.col("label") % 2 == 0, "chunk").otherwise("wiki")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), kind.alias("kind"), F.col("embedding").alias("vector"), "label")


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).first()["embedding"]


_QUERY_VECTOR = "(SELECT embedding::double[] FROM embeddings ORDER BY vec_id LIMIT 1)"


@query(f"""SELECT * FROM (SELECT vec_id AS id, CASE WHEN label % 2 = 0 THEN 'chunk' ELSE 'wiki' END AS kind,
    round(list_cosine_similarity(embedding::double[], {_QUERY_VECTOR}), 5) AS score,
    row_number() OVER (PARTITION BY label % 2 ORDER BY list_cosine_similarity(embedding::double[], {_QUERY_VECTOR}) DESC, vec_id)::int AS rank FROM embeddings) WHERE rank <= 30""")
def dual_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.dual_search(_records(spark, sf_dir), _first_vector(spark, sf_dir))
    return found.select("id", "kind", F.round("score", 5).alias("score"), "rank")


@query(f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::double[], {_QUERY_VECTOR}), 5) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::double[], {_QUERY_VECTOR}) DESC, vec_id LIMIT 5")
def single_route_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(_records(spark, sf_dir), _first_vector(spark, sf_dir)).select("id", F.round("score", 5).alias("score"))


@query("""SELECT query_id, id, round(score, 5) AS score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id,
    list_cosine_similarity(e.embedding::double[], q.embedding::double[]) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::double[], q.embedding::double[]) DESC, e.vec_id)::int AS rank
    FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0) WHERE rank <= 30""")
def batch_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set, every id divisible by 100, against all rows."""
    records = _records(spark, sf_dir)
    queries = records.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    return search.batch_search(records, queries).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


@query("""SELECT label::bigint AS label, count(*) AS vectors, count(*) FILTER (len(embedding) BETWEEN 1 AND 16000) AS sized,
    count(*) FILTER (len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0) AS valid,
    min(len(embedding))::bigint AS least, max(len(embedding))::bigint AS most FROM embeddings GROUP BY label""")
def vector_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    size = F.size("embedding").cast("bigint")
    return df.groupBy(F.col("label").cast("bigint").alias("label")).agg(F.count("*").alias("vectors"), F.count_if(size.between(1, search.MAX_DIMENSIONS)).alias("sized"), F.count_if(search.is_valid_vector(F.col("embedding"))).alias("valid"), F.min(size).alias("least"), F.max(size).alias("most"))


@query("SELECT min(doc_id) AS id, count(*) AS n_matches, sha256(text) AS text_hash, string_agg(doc_id::varchar, ',' ORDER BY doc_id) AS matches FROM documents GROUP BY text")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.lit("chunk").alias("kind"), F.col("doc_id").cast("string").alias("source_id"), F.lit(1.0).alias("score"), "text")
    merged = search.merge_candidates(hits, F.col("id"))
    return merged.select("id", F.size("matches").cast("bigint").alias("n_matches"), F.sha2("text", 256).alias("text_hash"), F.array_join(F.transform("matches", lambda m: m["source_id"]), ",").alias("matches"))


@query("""WITH before AS (SELECT doc_id AS id, sha256(text) AS revision, source AS detail FROM documents),
    after AS (SELECT min(doc_id) AS id, sha256(regexp_replace(text, '[0-9]', '#', 'g')) AS revision, CASE WHEN min_by(lang, doc_id) = 'fr' THEN upper(min_by(source, doc_id)) ELSE min_by(source, doc_id) END AS detail FROM documents GROUP BY text
      UNION ALL SELECT -1 - item_id, sha256(text), 'benchmark' FROM benchmark)
    SELECT coalesce(b.id, a.id) AS section_id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' WHEN a.revision <> b.revision THEN 'modified' WHEN a.detail <> b.detail THEN 'source_only' ELSE 'unchanged' END AS change,
      b.id IS NULL OR (a.id IS NOT NULL AND a.revision <> b.revision) AS rebuild, a.id IS NULL OR (b.id IS NOT NULL AND a.revision <> b.revision) AS invalidate
    FROM before b FULL JOIN after a ON a.id = b.id""")
def section_change_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the documents to their release: first copies only, digits masked, one language's sources renamed, benchmark items added."""
    docs = table(spark, sf_dir, "documents")
    before = docs.select(F.col("doc_id").alias("section_id"), F.sha2("text", 256).alias("revision"), F.col("source").alias("detail"))
    first = docs.groupBy("text").agg(F.min("doc_id").alias("section_id"), F.min_by(F.when(F.col("lang") == "fr", F.upper("source")).otherwise(F.col("source")), "doc_id").alias("detail"))
    after = first.select("section_id", F.sha2(F.regexp_replace("text", "[0-9]", "#"), 256).alias("revision"), "detail")
    items = table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("section_id"), F.sha2("text", 256).alias("revision"), F.lit("benchmark").alias("detail"))
    return changes.change_plan(before, after.unionByName(items))


@query("SELECT e.item_id, d.doc_id FROM benchmark e JOIN documents d ON contains(d.text, e.text)")
def evidence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold a benchmark item word for word."""
    held = enrichment.held_quotes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select(F.col("text").alias("quote")), "doc_id")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return items.join(held, "quote").select("item_id", "doc_id")


def _next_of(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, quote) with next_id, the doc_id just before: within ranges of ids by a window, and the first of
    each range from the last of the range before, of which there is one each."""
    ranged = Staging(rows.sparkSession).stage("ranged", lambda: rows.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.max("doc_id").alias("last"))
    before = ends.select("part", F.lag("last").over(Window.orderBy("part")).alias("before"))
    within = Window.partitionBy("part").orderBy("doc_id")
    return ranged.join(F.broadcast(before), "part").select("doc_id", "quote", F.coalesce(F.lag("doc_id").over(within), "before").alias("next_id"))


@query("""WITH n AS (SELECT doc_id AS section_id, text, substr(text, 3, 40) AS own, lead(substr(text, 3, 40)) OVER (ORDER BY doc_id) AS next FROM documents)
    SELECT section_id, quote FROM (SELECT section_id, text, own AS quote FROM n UNION ALL SELECT section_id, text, next FROM n) WHERE quote IS NOT NULL AND NOT contains(text, quote)""")
def missing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two quotes for each document, one from it and one from the next, those that aren't in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    quote = F.substring("text", 3, 40)
    numbered = _next_of(docs.select("doc_id", quote.alias("quote")))
    quotes = docs.select(F.col("doc_id").alias("section_id"), quote.alias("quote")).unionByName(numbered.where("next_id IS NOT NULL").select(F.col("next_id").alias("section_id"), "quote"))
    return enrichment.missing_evidence(quotes, docs.select(F.col("doc_id").alias("section_id"), F.col("text").alias("markdown"))).select("section_id", "quote")


@query("""SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS started_at, event_type FROM events
    WHERE ts >= (SELECT min(ts) + interval 1 hour FROM events) AND ts < (SELECT max(ts) FROM events) AND event_id < (SELECT max(event_id) FROM events) ORDER BY event_id DESC LIMIT 21""")
def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 20 and the row that says there are more."""
    from datetime import timedelta

    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("started_at"), "event_type")
    low, high, last = df.agg(F.min("started_at"), F.max("started_at"), F.max("id")).first()
    found = logs.page(df, {"from": low + timedelta(hours=1), "to": high, "cursor": last, "limit": 20})
    return found.withColumn("started_at", canon.iso_utc(F.col("started_at")))


@query("SELECT event_type, CASE WHEN count(value) = count(*) THEN round(sum(value), 2) END AS total, count(*) AS n FROM events GROUP BY event_type")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(logs.usage_total(F.col("value")), 2).alias("total"), F.count("*").alias("n"))


@query("SELECT event_type AS knowledge_base_id, user_id::varchar AS document_id FROM events WHERE event_type IS NOT NULL GROUP BY ALL")
def log_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.scopes(table(spark, sf_dir, "events").select(F.col("event_type").alias("knowledge_base_id"), F.col("user_id").cast("string").alias("document_id")))


@query("SELECT user_id, arg_max(event_type, event_id) AS value, max(event_id) AS seq FROM events GROUP BY user_id")
def latest_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("value"))
    return logs.latest_checkpoints(events, "user_id")


@query("SELECT event_id, event_type FROM events WHERE event_type LIKE 'p%'")
def progress_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose type begins with p, as stage entries are told from other checkpoints."""
    return logs.with_prefix(table(spark, sf_dir, "events").select("event_id", "event_type"), "p", "event_type")


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS completed FROM events")
def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_id").alias("seq"))
    return logs.progress(events, "user_id").select("event_id", "user_id", "completed")


@query("""SELECT user_id AS id, min_by(event_type, event_id) FILTER (event_type <> 'purchase') AS type,
    coalesce(min_by('succeeded', event_id) FILTER (event_type = 'purchase'), 'running') AS status FROM events GROUP BY user_id""")
def operation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as operations: the first purchase ends one."""
    status = F.when(F.col("event_type") == "purchase", "succeeded").otherwise("running")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), status.alias("status"), F.col("ts").alias("at"), F.lit(None).cast("string").alias("knowledge_base_id"), F.lit(None).cast("string").alias("document_id"))
    return logs.current_state(events).select("id", "type", "status")


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k")).where("k IS NOT NULL")
    return df.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT source AS knowledge_base_id, '[' || string_agg('{"label":"' || label || '","id":"' || doc_id || '"}', ',' ORDER BY label, doc_id::varchar) || ']' AS documents, count(*) AS document_count
    FROM (SELECT source, doc_id, coalesce(min(nullif(CASE WHEN lang = 'en' THEN '' ELSE lang || '/' || doc_id END, '')), doc_id::varchar) AS label FROM documents GROUP BY source, doc_id) GROUP BY source""")
def catalog_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as knowledge bases; documents of one language have no path and are labelled by id."""
    docs = table(spark, sf_dir, "documents")
    path = F.when(F.col("lang") == "en", "").otherwise(F.concat_ws("/", "lang", "doc_id"))
    records = docs.select(F.col("source").alias("knowledge_base_id"), F.array(F.struct(F.col("doc_id").cast("string").alias("document_id"), path.alias("source_path"))).alias("sources"))
    lists = catalog.document_lists(catalog.attributed_documents(records))
    return lists.select("knowledge_base_id", F.to_json("documents").alias("documents"), F.size("documents").cast("bigint").alias("document_count"))


@query("""SELECT coalesce(d.source, n.n_name) AS knowledge_base_id, coalesce(n_name, '') AS description, coalesce(n, 0)::bigint AS document_count
    FROM (SELECT source, count(DISTINCT doc_id) AS n FROM documents GROUP BY source) d FULL JOIN (SELECT n_name, 'src' || n_nationkey AS source FROM nation) n ON d.source = n.source""")
def catalog_with_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots joined in full with metadata: nations describe the sources of their number."""
    docs = table(spark, sf_dir, "documents")
    records = docs.select(F.col("source").alias("knowledge_base_id"), F.array(F.struct(F.col("doc_id").cast("string").alias("document_id"), F.lit("").alias("source_path"))).alias("sources"))
    spaces = docs.select(F.col("source").alias("knowledge_base_id")).distinct().withColumns({"updated_at": F.lit("2026-01-01").cast("timestamp"), "provider": F.lit("p"), "model": F.lit("m"), "dimensions": F.lit(1)})
    about = table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), "n_nationkey").alias("knowledge_base_id"), F.col("n_name").alias("description"))
    out = catalog.catalog(spaces, records, about)
    # Those without a snapshot go by their description.
    return out.select(F.when(F.col("embedding").isNull(), F.col("description")).otherwise(F.col("knowledge_base_id")).alias("knowledge_base_id"), "description", "document_count")


@query("""SELECT conv_id, turn, conv_id || '#' || turn AS id, lag(conv_id || '#' || turn) OVER w AS previous_chunk_id, lead(conv_id || '#' || turn) OVER w AS next_chunk_id
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def chunk_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("#", "conv_id", "turn").alias("id"))
    return sections.neighbours(df, "conv_id", "turn", "id")


@query("""SELECT page_id, url, min(pos)::bigint AS pos FROM (SELECT page_id, unnest(u) AS url, unnest(range(0, len(u))) AS pos
    FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS u FROM pages)) GROUP BY page_id, url""")
def link_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    items = table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("pos", "url"))
    return enrichment.first_of_each(items, ["page_id", "url"], "pos").select("page_id", "url", F.col("pos").cast("bigint").alias("pos"))


@query("""SELECT CASE WHEN label % 2 = 0 THEN 'chunk' ELSE 'wiki' END AS kind, count(*) AS n FROM (
    SELECT vec_id, label FROM embeddings WHERE label <> 0 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE label = 0) GROUP BY 1""")
def document_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as documents: in a store of all records one document's records are replaced, the others' stay."""
    store, base, records = _stored(spark, sf_dir)
    new = catalog.records_of_document(records, "0").withColumn("id", F.col("id") + 1000000)
    if new.isEmpty():
        return store.records(base).groupBy("kind").agg(F.count("*").alias("n"))
    done = store.replace_document("labels", "0", new, "given", "table", base.revision)
    return store.records(done).groupBy("kind").agg(F.count("*").alias("n"))


def _stored(spark: SparkSession, sf_dir: str):
    """The records of embeddings with their labels as documents, in a new store; its snapshot; and the records."""
    records = _records(spark, sf_dir).withColumn("sources", F.array(F.struct(F.col("label").cast("string").alias("document_id"))))
    store = SnapshotStore(spark, f"{Staging(spark).folder}/store")
    return store, store.replace_snapshot("labels", records, "given", "table", None), records


@query("SELECT CASE WHEN label % 2 = 0 THEN 'chunk' ELSE 'wiki' END AS kind, label::bigint AS label, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id FROM embeddings GROUP BY 1, 2")
def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store holds after a whole knowledge base was written to it."""
    store, done, _ = _stored(spark, sf_dir)
    return store.records(done).groupBy("kind", F.col("label").cast("bigint").alias("label")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("SELECT doc_id, sha256(text) AS fingerprint, sha256('[1,' || to_json(text) || ']') AS text_revision, 'index-' || sha256('[\"kb\",\"chunk\",\"' || doc_id || '\"]') AS index_id FROM documents")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", canon.hashed(F.col("text")).alias("fingerprint"), canon.text_revision(F.col("text")).alias("text_revision"), canon.index_id(F.lit("kb"), F.lit("chunk"), F.col("doc_id").cast("string")).alias("index_id"))


_CITED = "'See [S' || (doc_id % 7) || '] and [S1], [S' || (doc_id % 3) || '].'"


@query(f"SELECT doc_id, list_sort(list_distinct(regexp_extract_all({_CITED}, '\\[(S[0-9]+)\\]', 1)))::varchar AS cited, len(list_filter(regexp_extract_all({_CITED}, '\\[(S[0-9]+)\\]', 1), lambda x: x NOT IN ('S1', 'S2', 'S3', 'S4', 'S5'))) = 0 AS valid FROM documents")
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each document, citing labels that may not be among S1 to S5."""
    answer = F.format_string("See [S%d] and [S1], [S%d].", F.col("doc_id") % 7, F.col("doc_id") % 3)
    labels = F.array(*(F.lit(f"S{i}") for i in range(1, 6)))
    cited = F.array_sort(search.cited_labels(answer))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("["), F.array_join(cited, ", "), F.lit("]")).alias("cited"), search.is_valid_answer(answer, labels).alias("valid"))


@query("""WITH edges AS (SELECT 's' || s_suppkey AS source_id, 'n' || s_nationkey AS target_id FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
    ends AS (SELECT source_id AS node_id, * FROM edges UNION ALL SELECT target_id, * FROM edges WHERE source_id <> target_id)
    SELECT node_id, count(*) AS n_edges, count(*) FILTER (node_id = source_id) AS n_out FROM ends GROUP BY node_id""")
def node_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges at each node, from two equi-joins' worth of rows instead of a join on either end."""
    s, c, n = (table(spark, sf_dir, t) for t in ("supplier", "customer", "nation"))
    pairs = ((s, "s", "s_suppkey", "n", "s_nationkey"), (c, "c", "c_custkey", "n", "c_nationkey"), (n, "n", "n_nationkey", "r", "n_regionkey"))
    parts = [df.select(F.concat(F.lit(a), x).alias("source_id"), F.concat(F.lit(b), y).alias("target_id")) for df, a, x, b, y in pairs]
    edges = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return graph.incident_edges(edges).groupBy("node_id").agg(F.count("*").alias("n_edges"), F.count_if(F.col("node_id") == F.col("source_id")).alias("n_out"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents),
    t AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(line, '[ \t\n\x0B\f\r]+$', ''), '(?:^|[ \t])#+$', ''), '^[ \t]+|[ \t]+$', '', 'g') AS title FROM l),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, title ORDER BY line_no) - 1 AS occurrence FROM t)
    SELECT doc_id, line_no::bigint AS line_no, occurrence, 'section-' || sha256('["' || doc_id || '",[],1,' || to_json(title) || ',' || occurrence || ']') AS id FROM n""")
def heading_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with each line as a heading: their sections' occurrences and ids."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# "))).alias("markdown"))
    return sections.sections(docs, "doc_id").select("doc_id", F.col("first_line").cast("bigint").alias("line_no"), F.col("occurrence").cast("bigint").alias("occurrence"), "id")


def _page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages")).select(F.col("page_id").cast("string").alias("document_id"), F.col("html").alias("content"), F.col("url").alias("path"))
    return sections.section_revision(sections.sections(sections.normalized(pages, "html")))


@query()
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as Markdown sections with identities and revisions."""
    return _page_sections(spark, sf_dir).select("document_id", "index", "id", "parent_id", "depth", "title", F.array_join("heading_path", " / ").alias("heading"), "revision", F.length("markdown").alias("n_chars"))


@query()
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.chunks(_page_sections(spark, sf_dir), max_tokens=120, overlap_tokens=20).drop("markdown")


@query()
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _page_sections(spark, sf_dir)
    return df.select("id", F.posexplode(sections.links(F.col("markdown"))).alias("pos", "link")).select("id", "pos", "link.*")


_SUPPLIES: dict[tuple[str, str], dict[str, DataFrame]] = {}


def supply(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Suppliers' nations as a knowledge graph with citations, built once for an application and its tables."""
    built = (spark.sparkContext.applicationId, sf_dir)
    if built not in _SUPPLIES:
        _SUPPLIES[built] = _supply(spark, sf_dir)
    return _SUPPLIES[built]


def _supply(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    nation, region, supplier = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    section = F.concat(F.lit("nation-"), F.col("n_nationkey"))
    contributions = nation.select(section.alias("section_id"), F.lit("1").alias("section_revision"), F.lit("atlas").alias("document_id"), F.lit("atlas.md").alias("source_path"), F.array("n_name").alias("heading_path"))
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(supplier.groupBy("s_nationkey").count(), F.col("n_nationkey") == F.col("s_nationkey"))
    none = F.array().cast("array<string>")
    nations = joined.select(section.alias("section_id"), F.lit(0).alias("ord"), F.lit("entity").alias("kind"), F.lit("n").alias("id"), F.col("n_name").alias("name"), F.lit("nation").alias("type"), none.alias("aliases"), F.concat_ws(" ", F.col("count"), F.lit("suppliers")).alias("description"), F.array("n_name").alias("evidence"))
    regions = joined.select(section.alias("section_id"), F.lit(1).alias("ord"), F.lit("concept").alias("kind"), F.lit("r").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("type"), none.alias("aliases"), F.lit("a region").alias("description"), F.array("r_name").alias("evidence"))
    relations = joined.select(section.alias("section_id"), F.lit(0).alias("ord"), F.lit("n").alias("source_id"), F.lit("r").alias("target_id"), F.lit("part of").alias("type"), F.lit("lies in the region").alias("description"), F.array("n_name").alias("evidence"))
    facts = joined.select(section.alias("section_id"), F.lit(0).alias("ord"), F.concat_ws(" ", F.lit("suppliers:"), F.col("count")).alias("statement"), F.array(F.lit("n")).alias("node_ids"), F.array("n_name").alias("evidence"))
    canonical = region.select(F.concat(F.lit("region-"), "r_regionkey").alias("id"), F.lit("concept").alias("kind"), F.col("r_name").alias("title"))
    mappings = joined.select(section.alias("section_id"), F.lit("1").alias("section_revision"), F.lit("r").alias("local_id"), F.concat(F.lit("region-"), "r_regionkey").alias("canonical_id"))
    built = graph.build_graph(contributions, nations.unionByName(regions), relations, facts, "atlas", mappings, canonical)
    # Written once; what reads them several times doesn't build them again.
    staging = Staging(spark)
    return {name: staging.stage(name, lambda df=df: df) for name, df in built.items()}


@query("""WITH counts AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1),
    joined AS (SELECT n_nationkey, n_name, r_regionkey, r_name, n FROM nation JOIN region ON n_regionkey = r_regionkey JOIN counts ON s_nationkey = n_nationkey),
    edges AS (SELECT n_nationkey, r_regionkey, n_name || ' → ' || r_name || '（part of）：lies in the region' AS line FROM joined)
    SELECT 'wiki-node-' || sha256('["atlas",["local","nation-' || n_nationkey || '","1","n"]]') AS source_id, n_name AS title,
      '实体：' || n_name || chr(10) || 'nation：' || n || ' suppliers' || chr(10) || chr(10) || '事实：' || chr(10) || 'suppliers: ' || n || chr(10) || chr(10) || '关系：' || chr(10) || line AS text, 1::int AS n_sources
    FROM joined JOIN edges USING (n_nationkey)
    UNION ALL SELECT 'wiki-node-' || sha256('["atlas",["canonical","region-' || r_regionkey || '"]]'), r_name,
      '概念：' || r_name || chr(10) || 'a region' || chr(10) || chr(10) || '关系：' || chr(10) || string_agg(line, chr(10) ORDER BY line), count(*)::int
    FROM joined JOIN edges USING (n_nationkey, r_regionkey) GROUP BY r_regionkey, r_name""")
def supply_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding texts of the nodes of a graph of suppliers."""
    return indexing.node_documents(supply(spark, sf_dir), "atlas").select("source_id", "title", "text", F.size("sources").alias("n_sources"))


@query()
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through the embedder that needs no model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", canon.text_revision(F.col("text")).alias("text_revision"))
    out = indexing.embedded(docs, indexing.HashEmbedder(32))
    return out.select("doc_id", "usage", "embedding_revision", F.round(search.dot(F.col("vector"), F.col("vector")), 3).alias("norm2"))
