"""Importance resampling towards a target distribution, by counts of hashed word n-grams.

A text's words are joined by single spaces, as bytes. A pattern with look-arounds at the words' borders is
then scanned for with overlapping matches: each match is an n-gram where it stands in those bytes, and its
CRC gives its bucket, so no list of words is built. Buckets are counted over all documents and over the
target texts; what a bucket is worth is the logarithm of its frequency in the target against that in the
documents. A document's weight is the sum over its n-grams, and the highest weights with Gumbel noise are
a draw without replacement.

Texts are read once: what stays of one is its buckets with counts. All that meets in the driver is a
number for each bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from tessera.errors import TesseraError
from tessera.llm.mixing import _running
from tessera.llm.shards import CRC32_SQL
from tessera.llm.shared import materialize, table, text_or_empty, unused

WORDS = 1
BUCKETS = 10_000
#: Share of the documents, in per cent, that is drawn, and the words that a document needs for that.
PERCENT, MIN_WORDS = 10, 20
SEED = 2024
#: N-grams that are hashed at a time.
_BLOCK = 1 << 16
_SEPARATORS = regex.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]++")


def collapsed(text: str) -> bytes:
    """A text's words (digits, a to z, and what isn't ASCII; A to Z lower-cased) joined by single spaces."""
    return _SEPARATORS.sub(b" ", text.encode().lower()).strip(b" ")


def ngram_patterns(most: int) -> list[regex.Pattern]:
    """For 1, ..., ``most`` words, what matches so many between borders of words. To be scanned for with overlaps."""
    return [regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1)) for n in range(1, most + 1)]


def bucket_counts(data: bytes, patterns: list[regex.Pattern], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the n-grams of a collapsed text, in order, and how many fall into each."""
    counts = np.zeros(buckets, np.int64)
    for pattern in patterns:
        found = pattern.finditer(data, overlapped=True)
        hashes = (crc32(data[a:b]) for a, b in (m.span() for m in found))
        while len(block := np.fromiter(islice(hashes, _BLOCK), np.int64)):
            counts += np.bincount(block % buckets, minlength=buckets)
    there = np.flatnonzero(counts)
    return there, counts[there]


def features(df: DataFrame, keys: list[str], most: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """``keys`` of every row of ``df`` (keys, text), with n_words, n_features, buckets and counts. Null and
    empty texts have none."""
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = ngram_patterns(most)
        for batch in batches:
            words, parts = [], []
            for text in batch.column(len(keys)).to_pylist():
                data = collapsed(text or "")
                words.append(data.count(b" ") + 1 if data else 0)
                parts.append(bucket_counts(data, patterns, buckets))
            offsets = pa.array(np.cumsum([0, *(len(b) for b, _ in parts)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int64), *x]), t)) for x, t in zip(zip(*parts, strict=True) if parts else ((), ()), (pa.int32(), pa.int64()), strict=True)]
            sums = pa.array([int(c.sum()) for _, c in parts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(words, pa.int64()), sums, *lists], [*keys, "n_words", "n_features", "buckets", "counts"])

    return df.select(*keys, "text").mapInArrow(run, f"{', '.join([*kinds, ''])}n_words bigint, n_features bigint, buckets array<int>, counts array<bigint>")


def bucket_totals(found: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How many n-grams of all rows fall into each bucket; added up within partitions before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(totals, batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy())
        there = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(totals[there])], ["bucket", "n"])

    partial = found.select("buckets", "counts").mapInArrow(run, "bucket bigint, n bigint")
    out = [0] * buckets
    for r in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: list[int], target: list[int]) -> list[int]:
    """What an n-gram in each bucket is worth: a thousand times the logarithm of its frequency in the target
    against that in the documents, both with one more in each bucket, rounded down."""
    all_raw, all_target = float(sum(raw) + len(raw)), float(sum(target) + len(target))
    return [math.floor(1000 * math.log((t + 1.0) * all_raw / ((s + 1.0) * all_target))) for s, t in zip(raw, target, strict=True)]


def weighed(found: DataFrame, keys: list[str], worth: list[int]) -> DataFrame:
    """``keys``, n_words, n_features and weight, the sum of what a document's n-grams are worth."""
    kinds = [f"`{k}` {found.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.array(worth, np.int64)
        for batch in batches:
            buckets, counts = batch.column(len(keys) + 2), batch.column(len(keys) + 3)
            sums = np.concatenate(([0], np.cumsum(of[buckets.flatten().to_numpy()] * counts.flatten().to_numpy())))
            ends = np.concatenate(([0], np.cumsum(buckets.value_lengths().to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 2], pa.array(np.diff(sums[ends]))], [*keys, "n_words", "n_features", "weight"])

    return found.select(*keys, "n_words", "n_features", "buckets", "counts").mapInArrow(run, f"{', '.join([*kinds, ''])}n_words bigint, n_features bigint, weight bigint")


def _ranked(docs: DataFrame, keys: list[str], target: DataFrame, most: int, buckets: int, percent: int, min_words: int, seed: int) -> DataFrame:
    """Different rows of ``docs`` (keys with doc_id, text) by keys and scores: how often each is there (n), and the
    least rank and number of those of its copies that are drawn (first, drawn; null where none is)."""
    if most < 1 or buckets < 1 or not 0 <= percent <= 100:
        raise TesseraError("INVALID_OPTIONS", "n-grams, buckets and per cent")
    found = materialize(features(docs, keys, most, buckets), "features")
    worth = gains(bucket_totals(found, buckets), bucket_totals(features(target.select("text"), [], most, buckets), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = weighed(found, keys, worth).withColumn("score", F.col("weight") + noise)
    scored = scored.groupBy(*keys, "n_words", "n_features", "weight", "score").agg(F.count("*").alias("n"))
    may = F.col("n_words") >= min_words
    # Range-sorted; ranks are running sums, within partitions and over them.
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), "n_features", *(k for k in keys if k != "doc_id")]
    sums = _running(scored.where(may), order, {"before": F.col("n")})
    drawn = found.where(may).count() * percent // 100
    left = F.least("n", F.lit(drawn) - F.col("before"))
    ranked = sums.withColumns({"first": F.when(left > 0, F.col("before") + 1), "drawn": F.when(left > 0, left)}).drop("before")
    return ranked.unionByName(scored.where(~may), allowMissingColumns=True)


def resample(docs: DataFrame, target: DataFrame, most: int = WORDS, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_features, weight, score, rank (all bigint).

    N-grams of 1 to ``most`` words are counted in ``buckets`` by CRC32, over all ``docs`` and all texts of
    ``target``. Of the N documents of ``min_words`` or more, those with the highest scores, ``percent`` of a
    hundred of N rounded down, are drawn and ranked 1, 2, 3, ...; equal scores go by doc_id, null ones last.
    Others have a null rank. The noise in a score depends on seed and doc_id only, a null one counting as
    empty. Null and empty texts have no n-grams and a weight of 0. Rows that repeat are ranked one after
    the other. Without target texts all buckets count as equally frequent there. Other columns of either
    table aren't looked at.
    """
    rows = _ranked(docs.select("doc_id", "text"), ["doc_id"], target, most, buckets, percent, min_words, seed)
    nth = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))
    rows = rows.select("doc_id", "n_features", "weight", "score", "first", "drawn", nth.alias("nth"))
    return rows.select("doc_id", "n_features", "weight", "score", F.when(F.col("nth") < F.col("drawn"), F.col("first") + F.col("nth")).alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, most: int = WORDS, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """The documents that ``resample`` draws, with all columns of ``docs``, sorted by rank. Rows that agree in
    doc_id and text are copies of one row: as many as are drawn come back, with the other columns of one of
    them, the same in every run."""
    own, content, kept, rank = unused(docs, "own_id", "content", "kept", "rank")
    hashed = F.xxhash64(text_or_empty())
    rows = _ranked(docs.select("doc_id", "text", hashed.alias("content")), ["doc_id", "content"], target, most, buckets, percent, min_words, seed)
    rows = materialize(rows.where("drawn > 0").select(F.col("doc_id").alias(own), F.col("content").alias(content), F.explode(F.sequence("first", F.col("first") + F.col("drawn") - 1)).alias(rank)), "drawn")
    here = docs.withColumn(content, hashed)
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (here[content] == F.col(f"{kept}.{content}"))
    told = [f.name for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))]
    picked = rows.select(own, F.struct(content).alias(kept)).distinct()
    one = here.join(picked, same, "left_semi").groupBy("doc_id", content).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*told)).alias(kept))
    one = one.select(F.col("doc_id").alias(f"{own}_"), F.col(content).alias(f"{content}_"), F.col(kept))
    joined = rows.join(one, F.col(own).eqNullSafe(F.col(f"{own}_")) & (F.col(content) == F.col(f"{content}_")))
    return joined.select(rank, f"{kept}.*").orderBy(rank).select(docs.columns)


def op13_importance_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = rf"""
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
target AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark),
found AS (SELECT r, t, count(*) AS n FROM (SELECT r, unnest(w) AS t FROM raw) GROUP BY r, t), wanted AS (SELECT t, count(*) AS n FROM target GROUP BY t),
texts AS (SELECT row_number() OVER () AS id, t FROM (SELECT t FROM found UNION SELECT t FROM wanted)), {CRC32_SQL},
bucketed AS (SELECT t, crc % {BUCKETS} AS bucket FROM texts JOIN checksums USING (id)),
s AS (SELECT bucket, sum(n) AS n FROM found JOIN bucketed USING (t) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS n FROM wanted JOIN bucketed USING (t) GROUP BY bucket),
worth AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::double
    / ((s.n + 1)::double * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::double)))::bigint AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT r, sum(n * gain)::bigint AS weight FROM found JOIN bucketed USING (t) JOIN worth USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, len(w)::bigint AS n_features, coalesce(weight, 0)::bigint AS weight, r,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5::double) / 4294967296::double))))::bigint AS score FROM raw LEFT JOIN weights USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight DESC, n_features) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""
