"""SimHash fingerprints and near-duplicate groups, searched with BK-trees.

Distinct fingerprints are dealt into buckets such that two of them within the radius meet in one
bucket at least. In each bucket a BK-tree (children keyed by their Hamming distance to the parent)
holds the fingerprints; a search follows only the edges whose key is within the radius of the
distance to the node. A bucket with more fingerprints than ``tree_size`` is cut into shard trees,
and each of its fingerprints is sent to every shard, so no task holds more than one shard tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import connected_components, materialize, table, unused

RADIUS = 3
#: The 64 bits of a signed integer.
_BITS = (1 << 64) - 1


def shingle_hashes(words: list[bytes], shingle_words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``shingle_words`` words, or of all words if there are fewer."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle_words + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)), np.uint64, n)


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """The 64-bit SimHash of a text: words between ASCII white space, A-Z lower-cased, in shingles;
    a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42). No words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = shingle_hashes(words, shingle_words)
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * counts > n)))


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """doc_id and fp, a signed bigint, for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, shingle_words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


class BkTree:
    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int) -> list[int]:
        """Places of all values within the radius."""
        if not self.values:
            return []
        found, todo, radius = [], [0], self.radius
        values, children = self.values, self.children
        while todo:
            i = todo.pop()
            d = ((values[i] ^ value) & _BITS).bit_count()
            if d <= radius:
                found.append(i)
            if edges := children[i]:
                for key, child in edges.items():
                    if -radius <= key - d <= radius:
                        todo.append(child)
        return found

    def add(self, value: int) -> int:
        """Insert a value that isn't there yet; return its place."""
        i = 0
        if self.values:
            while True:
                edges, d = self.children[i], ((self.values[i] ^ value) & _BITS).bit_count()
                if d not in edges:
                    edges[d] = len(self.values)
                    break
                i = edges[d]
        self.values.append(value)
        self.children.append({})
        return len(self.values) - 1


def _search(radius: int):
    """For rows (bucket, shard, fp, member) sorted so that a shard's members come first: star edges
    (a, b) that connect what the links within the bucket connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, roots = None, BkTree(radius), []

        def root(i: int) -> int:
            while roots[i] != i:
                roots[i] = roots[roots[i]]
                i = roots[i]
            return i

        for batch in batches:
            a, b = [], []
            for key, shard, fp, member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, shard) != at:
                    at, tree, roots = (key, shard), BkTree(radius), []
                # One link for each group that the new value touches connects as much as all of them.
                touched = {root(i) for i in tree.near(fp)}
                for i in touched:
                    a.append(fp)
                    b.append(tree.values[i])
                if member:
                    own = tree.add(fp)
                    roots.append(own)
                    for i in touched:
                        roots[i] = own
                elif len(touched) > 1:
                    first = touched.pop()
                    for i in touched:
                        roots[i] = first
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def link_groups(fps: DataFrame, radius: int = RADIUS, tree_size: int = 4096) -> DataFrame:
    """Groups of distinct fingerprints connected by links of at most ``radius`` differing bits.

    ``fps`` has one distinct bigint column fp. Returns (fp, root) for fingerprints that have a link.
    64 bits fall into radius + 1 blocks, one of which two linked fingerprints share; the bits of a
    bucket larger than ``tree_size`` are cut once more in the same way.
    """
    blocks = radius + 1

    def cut(bits: int) -> list[tuple[int, int]]:
        edges = [bits * i // blocks for i in range(blocks + 1)]
        return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]

    def part(value, lo: int, width: int):
        return F.shiftrightunsigned(value, lo).bitwiseAND((1 << width) - 1)

    keys = [F.struct(F.lit(i).alias("block"), part(F.col("fp"), lo, w).alias("value")) for i, (lo, w) in enumerate(cut(64))]
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.block", "k.value")
    sizes = dealt.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1")
    dealt = materialize(dealt.join(sizes, ["block", "value"]), "buckets")
    small = dealt.where(F.col("n") <= tree_size).select(F.xxhash64("block", "value").alias("bucket"), "fp", "n")
    large = dealt.where(F.col("n") > tree_size)
    # The bits outside the shared block, side by side.
    rest = F.lit(None).cast("bigint")
    for i, (lo, w) in enumerate(cut(64)):
        low = F.col("fp").bitwiseAND((1 << lo) - 1)
        high = F.shiftleft(F.shiftrightunsigned("fp", lo + w), lo) if lo + w < 64 else F.lit(0).cast("bigint")
        rest = F.when(F.col("block") == i, low.bitwiseOR(high)).otherwise(rest)
    width = 64 - 64 // blocks
    subkeys = [F.struct(F.lit(i).alias("sub"), part(F.col("rest"), lo, w if i < blocks - 1 else 64 - lo).alias("subvalue")) for i, (lo, w) in enumerate(cut(width))]
    large = large.withColumn("rest", rest).select("fp", F.xxhash64("block", "value").alias("first"), F.explode(F.array(*subkeys)).alias("k"))
    large = large.select("fp", F.xxhash64("first", "k.sub", "k.subvalue").alias("bucket"))
    sizes = large.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    dealt = small.unionByName(large.join(sizes, "bucket").select("bucket", "fp", "n"))
    shards = F.ceil(F.col("n") / tree_size).cast("int")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), shards).cast("int")).select("bucket", "fp", "own", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"))
    dealt = dealt.select("bucket", "shard", "fp", (F.col("shard") == F.col("own")).alias("member"))
    dealt = dealt.repartition("bucket", "shard").sortWithinPartitions("bucket", "shard", F.desc("member"), "fp")
    found = dealt.mapInArrow(_search(radius), "a bigint, b bigint")
    return connected_components(found).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``docs``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; component_id is the
    least doc_id that links lead to, the own one included. Null and empty texts have fingerprint 0
    and link like any other. Rows stay as they are, repeated ones and null doc_ids too (component_id
    is then that of the group, null if the group has no doc_id at all). Extra columns are ignored.
    """
    own = materialize(fingerprints(docs, shingle_words), "fingerprints")
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint")
    groups = link_groups(distinct.select("fp"), radius)
    labelled = distinct.join(groups, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    labelled = labelled.join(least, "root").select("fp", "component_id")
    return own.join(labelled, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with one document of each of ``groups`` (doc_id, component_id), the one with the least
    doc_id; of rows that repeat a doc_id one stays. Rows without doc_id can't be told apart and stay."""
    own, rows = unused(docs, "kept_id", "kept_rows")
    groups = groups.where("doc_id IS NOT NULL")
    kept = groups.groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias(rows), F.min("component_id").alias("first")).where(F.col(own) == F.col("first")).select(own, rows)
    kept = materialize(kept, "kept")
    single = docs.join(kept.where(F.col(rows) == 1), F.col("doc_id") == F.col(own), "left_semi")
    repeated = docs.join(kept.where(F.col(rows) > 1), F.col("doc_id") == F.col(own), "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(repeated).unionByName(docs.where("doc_id IS NULL"))


def keep_first(docs: DataFrame, shingle_words: int = 3, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, as first_of_groups picks it."""
    return first_of_groups(docs, near_duplicates(docs, shingle_words, radius))


def op2_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
