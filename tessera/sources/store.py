"""Versioned snapshots of vector records, in Parquet.

A write makes new files beside the old ones and commits them by creating the version's manifest,
which only one writer can. Readers pin the version that is current when they begin. A crash leaves
files that no manifest names, never half a version.

Records lie in buckets by a hash of the least document that they come from. A manifest names, for each
bucket, the part (folder of one write) that holds it, so replacing a document rewrites its bucket only.
The buckets' hash sums are kept too: they add up to the revision.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.errors import TesseraError
from tessera.functions.canon import content_hash
from tessera.operators.changes import check_unique
from tessera.operators.search import dual_search, is_valid_vector, top_k
from tessera.sources import files

MAX_KEY = 256
#: Records of a bucket, about; buckets of a knowledge base, at least and at most.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 100_000, 8, 4096


@dataclass(frozen=True)
class Snapshot:
    knowledge_base_id: str
    version: int
    revision: str
    provider: str
    model: str | None
    dimensions: int | None
    chunks: int
    nodes: int
    n_buckets: int
    #: By bucket: the part that holds it, its numbers of records, chunks and nodes, and its hash sums.
    buckets: dict[str, dict] = field(repr=False)
    #: JSON of the records' schema.
    schema: str = field(repr=False)


def _row_hash(columns: list[str]) -> Column:
    """A record's hash (id, metadata JSON, vector), as hex."""
    return F.sha2(F.concat_ws("\x1f", "id", F.to_json(F.struct(*[c for c in sorted(columns) if c != "vector"])), F.hex(F.concat_ws(",", F.transform("vector", lambda x: x.cast("string"))))), 256)


def _hash_sums(columns: list[str]) -> list[Column]:
    """Four sums over the parts of all records' hashes: order doesn't matter, and no task sees more than its share."""
    return [F.coalesce(F.sum(F.conv(F.substring(_row_hash(columns), 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]


def revision_of(records: DataFrame) -> str:
    """A hash of the set of records."""
    return content_hash([str(x) for x in records.agg(F.count("*"), *_hash_sums(records.columns)).first()])


def _revision(buckets: dict[str, dict]) -> str:
    totals = [sum(b["n"] for b in buckets.values()), *(sum(int(b["sums"][i]) for b in buckets.values()) for i in range(4))]
    return content_hash([str(x) for x in totals])


class SnapshotStore:
    """Knowledge bases under ``root``. Records have id, kind (chunk or wiki), sources, vector and whatever
    else is to be kept."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, knowledge_base: str) -> str:
        return f"{self.root}/{quote(knowledge_base, safe='')}"

    def snapshot(self, knowledge_base: str) -> Snapshot | None:
        """The current version's description, None if there is none."""
        found = [n for n in files.names(self.spark, f"{self._folder(knowledge_base)}/manifests") if n.endswith(".json")]
        if not found:
            return None
        return Snapshot(**json.loads(files.read(self.spark, f"{self._folder(knowledge_base)}/manifests/{max(found)}"))["snapshot"])

    def snapshots(self) -> list[Snapshot]:
        return [s for n in files.names(self.spark, self.root) if (s := self.snapshot(n)) is not None]

    def records(self, snapshot: Snapshot) -> DataFrame:
        """A version's records; a filter on kind reads that kind's files only."""
        return self._read(snapshot, list(snapshot.buckets))

    def _read(self, snapshot: Snapshot, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(snapshot.schema))
        if not buckets:
            return self.spark.createDataFrame([], schema)
        data = f"{self._folder(snapshot.knowledge_base_id)}/data"
        paths = [f"{data}/part={snapshot.buckets[b]['part']}/bucket={b}" for b in buckets]
        return self.spark.read.schema(schema).option("basePath", data).parquet(*paths).select(schema.names)

    def _receipt(self, knowledge_base: str, key: str) -> str:
        return f"{self._folder(knowledge_base)}/receipts/{content_hash(key)}.json"

    def _replay(self, knowledge_base: str, key: str | None, fingerprint: str) -> Snapshot | None:
        """What an earlier write under the key returned; a conflict if that wrote something else."""
        if key is None:
            return None
        if not key.strip() or len(key) > MAX_KEY:
            raise TesseraError("INVALID_INPUT", "write key")
        if (text := files.read(self.spark, self._receipt(knowledge_base, key))) is None:
            return None
        receipt = json.loads(text)
        manifest = files.read(self.spark, f"{self._folder(knowledge_base)}/manifests/{receipt['version']:012d}.json")
        if manifest is None or json.loads(manifest)["write_key"] != key:
            return None
        if receipt["fingerprint"] != fingerprint:
            raise TesseraError("CONFLICT", "the write key stands for another write")
        return Snapshot(**json.loads(manifest)["snapshot"])

    def _write(self, knowledge_base: str, records: DataFrame, n_buckets: int) -> tuple[str, dict[str, dict], int | None]:
        """Write records, evaluated once, as a new part: its name, its buckets and the vectors' dimensions. What
        is written is then checked: bad records and ids that repeat are an error, and the part goes."""
        part, data = f"v-{uuid.uuid4().hex}", f"{self._folder(knowledge_base)}/data"
        path = f"{data}/part={part}"
        bucket = F.pmod(F.xxhash64(F.array_min(F.transform("sources", lambda s: s["document_id"]))), F.lit(n_buckets)).cast("int")
        # A rebalance evens out what tasks write, so no kind or bucket is written by one task alone.
        dealt = records.withColumn("bucket", F.coalesce(bucket, F.lit(0))).hint("rebalance", F.col("bucket"))
        dealt.write.partitionBy("bucket", "kind").parquet(path)
        try:
            written = self.spark.read.schema(StructType([*records.schema.fields, StructField("bucket", IntegerType())])).parquet(path)
            bad = ~is_valid_vector(F.col("vector")) | ~F.col("kind").isin("chunk", "wiki") | F.col("id").isNull()
            size = F.size("vector")
            rows = written.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "chunk").alias("chunks"), F.count_if(F.col("kind") == "wiki").alias("nodes"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"), F.min(size).alias("least"), F.max(size).alias("most"), *_hash_sums(records.columns)).collect()
            sizes = {r[k] for r in rows for k in ("least", "most")}
            if len(sizes) > 1 or any(r["bad"] for r in rows):
                raise TesseraError("INVALID_INPUT", "a record's vector or kind")
            check_unique(written, "id", "INVALID_INPUT")
        except TesseraError:
            files.remove(self.spark, path)
            raise
        buckets = {str(r["bucket"]): {"part": part, "n": r["n"], "chunks": r["chunks"], "nodes": r["nodes"], "sums": [str(r[f"s{i}"]) for i in range(4)]} for r in rows}
        return part, buckets, next(iter(sizes), None)

    def _commit(self, knowledge_base: str, current: Snapshot | None, part: str, buckets: dict[str, dict], n_buckets: int, schema: str, provider: str, model: str | None, dimensions: int | None, key: str | None, fingerprint: str) -> Snapshot:
        version = (current.version if current else 0) + 1
        chunks, nodes = (sum(b[k] for b in buckets.values()) for k in ("chunks", "nodes"))
        empty = chunks + nodes == 0
        done = Snapshot(knowledge_base, version, _revision(buckets), provider, None if empty else model, None if empty else dimensions, chunks, nodes, n_buckets, buckets, schema)
        # The receipt goes first: without its manifest it counts for nothing, and with it the write is done.
        if key is not None:
            files.put(self.spark, self._receipt(knowledge_base, key), json.dumps({"version": version, "fingerprint": fingerprint}))
        try:
            files.create(self.spark, f"{self._folder(knowledge_base)}/manifests/{version:012d}.json", json.dumps({"snapshot": asdict(done), "write_key": key}))
        except TesseraError:
            self._discard(knowledge_base, part)
            raise
        return done

    def _discard(self, knowledge_base: str, part: str) -> None:
        files.remove(self.spark, f"{self._folder(knowledge_base)}/data/part={part}")

    def _current(self, knowledge_base: str, expected_revision: str | None) -> Snapshot | None:
        current = self.snapshot(knowledge_base)
        if (current.revision if current else None) != expected_revision:
            raise TesseraError("CONFLICT", "the snapshot has changed")
        return current

    def replace_snapshot(self, knowledge_base: str, records: DataFrame, provider: str, model: str, expected_revision: str | None, write_key: str | None = None, n_buckets: int | None = None) -> Snapshot:
        """Replace a whole knowledge base; no records clear it. The records are evaluated once. Without
        ``n_buckets`` there are as many buckets as before, or more if the last version was large for them."""
        before = self.snapshot(knowledge_base)
        if n_buckets is None:
            rows = before.chunks + before.nodes if before else 0
            n_buckets = max(before.n_buckets if before else LEAST_BUCKETS, min(MOST_BUCKETS, rows // BUCKET_ROWS))
        part, buckets, dimensions = self._write(knowledge_base, records, n_buckets)
        try:
            fingerprint = content_hash([None, provider, model, _revision(buckets)])
            if done := self._replay(knowledge_base, write_key, fingerprint):
                self._discard(knowledge_base, part)
                return done
            current = self._current(knowledge_base, expected_revision)
        except TesseraError:
            self._discard(knowledge_base, part)
            raise
        return self._commit(knowledge_base, current, part, buckets, n_buckets, records.schema.json(), provider, model, dimensions, write_key, fingerprint)

    def replace_document(self, knowledge_base: str, document_id: str, records: DataFrame, provider: str, model: str, expected_revision: str | None, write_key: str | None = None) -> Snapshot:
        """Replace what one document contributed; all records are of this document, one chunk at least."""
        ids = self.spark.createDataFrame([(document_id,)], "document_id string")
        return self.replace_documents(knowledge_base, ids, records, provider, model, expected_revision, write_key)

    def replace_documents(self, knowledge_base: str, documents: DataFrame, records: DataFrame, provider: str, model: str, expected_revision: str | None, write_key: str | None = None) -> Snapshot:
        """Replace what ``documents`` (document_id) contributed: each has a chunk among the records at least, and
        all records are of one of them. Buckets without one of them stay as they are. The new records are
        evaluated once, into a part of their own that then serves for the checks and the merge."""
        documents = documents.select("document_id").distinct()
        current = self.snapshot(knowledge_base)
        n_buckets = current.n_buckets if current else LEAST_BUCKETS
        fresh_part, fresh, dimensions = self._write(knowledge_base, records, n_buckets)
        staged = Snapshot(knowledge_base, 0, "", provider, model, dimensions, 0, 0, n_buckets, fresh, records.schema.json())
        part = None
        try:
            new = self._read(staged, list(fresh))
            owners = new.select("id", "kind", F.explode_outer("sources.document_id").alias("document_id"))
            several = new.where(F.size(F.array_distinct("sources.document_id")) != 1)
            chunked = documents.join(owners.where("kind = 'chunk'"), "document_id", "left_anti")
            if not several.isEmpty() or not owners.join(documents, "document_id", "left_anti").isEmpty() or not chunked.isEmpty():
                raise TesseraError("INVALID_INPUT", "records of one document, with a chunk")
            ids = documents.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("document_id").cast("decimal(38,0)")), F.lit(0))).first()
            fingerprint = content_hash([[str(x) for x in ids], provider, model, _revision(fresh)])
            if done := self._replay(knowledge_base, write_key, fingerprint):
                self._discard(knowledge_base, fresh_part)
                return done
            current = self._current(knowledge_base, expected_revision)
            if current is None or current.model is None:
                return self._commit(knowledge_base, current, fresh_part, fresh, n_buckets, records.schema.json(), provider, model, dimensions, write_key, fingerprint)
            if (current.provider, current.model, current.dimensions) != (provider, model, dimensions):
                raise TesseraError("INCONSISTENT_SPACE", "another embedding space")
            old = self.records(current).select("id", F.explode("sources.document_id").alias("document_id"))
            mine = old.join(documents, "document_id", "left_semi").select("id").distinct()
            others = old.join(documents, "document_id", "left_anti").select("id")
            if not others.join(mine.unionByName(new.select("id")), "id", "left_semi").isEmpty():
                raise TesseraError("CONFLICT", "a record belongs to several documents")
            hashed = documents.select(F.pmod(F.xxhash64("document_id"), F.lit(current.n_buckets)).cast("int").alias("b")).distinct()
            touched = [str(r["b"]) for r in hashed.collect()]
            grown = current.chunks + current.nodes > 4 * BUCKET_ROWS * current.n_buckets and current.n_buckets < MOST_BUCKETS
            n_buckets = min(MOST_BUCKETS, 4 * current.n_buckets) if grown else current.n_buckets
            again = list(current.buckets) if grown else [b for b in touched if b in current.buckets]
            names = StructType.fromJson(json.loads(current.schema)).names
            kept = self._read(current, again).join(mine, "id", "left_anti").select(names)
            part, merged, _ = self._write(knowledge_base, kept.unionByName(new.select(names)), n_buckets)
            buckets = {b: x for b, x in current.buckets.items() if not grown and b not in touched} | merged
            return self._commit(knowledge_base, current, part, buckets, n_buckets, current.schema, provider, model, dimensions, write_key, fingerprint)
        except TesseraError:
            self._discard(knowledge_base, fresh_part)
            raise
        finally:
            if part is not None:
                self._discard(knowledge_base, fresh_part)

    def _pinned(self, knowledge_base: str, provider: str, model: str, vector: Sequence[float], expected_revision: str | None = None) -> Snapshot | None:
        current = self.snapshot(knowledge_base)
        if expected_revision is not None and (current is None or current.revision != expected_revision):
            raise TesseraError("CONFLICT", "the snapshot has changed")
        if current is None or current.model is None:
            return None
        if (current.provider, current.model, current.dimensions) != (provider, model, len(vector)):
            raise TesseraError("INCONSISTENT_SPACE", "the query's vector is of another space")
        return current

    def search(self, knowledge_base: str, kind: str, provider: str, model: str, vector: Sequence[float], k: int = 5) -> DataFrame | None:
        """The k best records of a kind, None where nothing is stored."""
        current = self._pinned(knowledge_base, provider, model, vector)
        return None if current is None else top_k(self.records(current).where(F.col("kind") == kind), vector, k)

    def search_dual(self, knowledge_base: str, provider: str, model: str, vector: Sequence[float], expected_revision: str, k: int = 30) -> DataFrame | None:
        """Both kinds' best records, of one version."""
        current = self._pinned(knowledge_base, provider, model, vector, expected_revision)
        return None if current is None else dual_search(self.records(current), vector, k)


class KnowledgeBases:
    """Descriptions of knowledge bases, each in a file of its own."""

    MAX_NAME, MAX_DESCRIPTION = 64, 1000

    def __init__(self, store: SnapshotStore):
        self.store, self.spark = store, store.spark

    def _path(self, name: str) -> str:
        return f"{self.store.root}.about/{quote(name, safe='')}.json"

    def _valid(self, name: str, description: str) -> str:
        if not 1 <= len(name.strip()) <= self.MAX_NAME or "\0" in name or len(description) > self.MAX_DESCRIPTION:
            raise TesseraError("INVALID_INPUT", "name or description")
        return json.dumps({"knowledge_base_id": name, "description": description}, ensure_ascii=False)

    def create(self, name: str, description: str = "") -> None:
        text = self._valid(name, description)
        if self.store.snapshot(name) is not None:
            raise TesseraError("CONFLICT", "the name is in use")
        files.create(self.spark, self._path(name), text)

    def describe(self, name: str, description: str) -> None:
        text = self._valid(name, description)
        if files.read(self.spark, self._path(name)) is None and self.store.snapshot(name) is None:
            raise TesseraError("NOT_FOUND", "no such knowledge base")
        files.put(self.spark, self._path(name), text)

    def all(self) -> list[dict[str, str]]:
        folder = f"{self.store.root}.about"
        return [json.loads(files.read(self.spark, f"{folder}/{n}")) for n in files.names(self.spark, folder)]
