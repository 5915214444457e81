"""Mixing sources to target weights along a training curriculum.

Each source has a target number of words and a weight schedule over training time. The schedule's
integral is the source's cumulative demand; inverting it assigns every copy of a document the
training time at which the source has asked for the words before it. Documents are range-sorted by
that position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from tessera.llm.shared import WORD, materialize, table, text_or_empty, unused

WEIGHTS = (5, 2, 1)
#: Words of the mix for each word of the corpus, and the most often that a source's words repeat.
SHARE = 1.5
MOST = 2
#: For each weight, (time, relative weight) at knots with straight lines between: light sources fade out, heavy ones in.
SCHEDULES = {5: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)), 2: ((0.0, 1.0), (1.0, 1.0)), 1: ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5))}
#: Each source's documents are dealt by hash into this many buckets for running sums.
BUCKETS = 4096


def word_count(column: str = "text") -> Column:
    return F.size(F.regexp_extract_all(text_or_empty(column), F.lit(WORD), F.lit(0))).cast("bigint")


def source_targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source (null last): source, source_id, weight, source_size, target.

    Weights repeat along the sources in code point order. Targets are in proportion to weights and
    stop at ``most`` times the source's size; what is left is shared out again until none is above.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = _running(sources, F.asc_nulls_last("source"), {"source_id": F.lit(1)})
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod("source_id", F.lit(len(weights))).cast("int"))
    cap = most * F.col("source_size")
    ranked = numbered.select("source", "source_id", weight.alias("weight"), "source_size")
    ordered = _running(ranked, (cap / F.col("weight")).asc(), {"caps": cap, "weights": F.col("weight")})
    total, all_weights, largest = ordered.agg(F.sum("source_size"), F.sum("weight"), F.max(cap / F.col("weight"))).first()
    budget = share * float(total or 0)
    # In the order of what they hold for a unit of weight, sources stop at their caps until what is left is
    # enough for all that come after.
    capped = cap * (F.lit(float(all_weights or 0)) - F.col("weights")) <= (F.lit(budget) - F.col("caps")) * F.col("weight")
    held, left = ordered.agg(F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("weight")))).first()
    level = (budget - float(held or 0)) / left if left else float(largest or 0)
    target = F.when(F.col("weight") * F.lit(level) >= cap, cap.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return ranked.withColumn("target", target)


def _running(df: DataFrame, order: Column, values: dict[str, Column]) -> DataFrame:
    """Adds, for each of ``values``, its sum over the rows before in that order. Rows are sorted by range
    and summed within partitions, to which the sums of the partitions before are added, so there is no
    one task for all."""
    df = materialize(df.withColumns({f"_{k}": v for k, v in values.items()}).orderBy(order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    df = df.withColumn("_part", F.shiftright("_at", 33))
    parts = df.groupBy("_part").agg(*(F.sum(f"_{k}").alias(f"_sum_{k}") for k in values))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *(F.coalesce(F.sum(f"_sum_{k}").over(earlier), F.lit(0)).alias(f"_before_{k}") for k in values))
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = {k: F.col(f"_before_{k}") + F.coalesce(F.sum(f"_{k}").over(within), F.lit(0)) for k in values}
    df = df.join(parts, "_part").withColumns(sums)
    return df.drop("_part", "_at", *(f"{x}_{k}" for k in values for x in ("", "_before")))


def _inverse(u: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """Time at which the integral of the schedule has reached the share ``u`` of its whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    whole, before = math.fsum(areas), 0.0
    steps = []
    for (a, b), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        slope, need = (b[1] - a[1]) / (b[0] - a[0]), u * F.lit(whole) - F.lit(before)
        # need = w * dt + slope / 2 * dt^2, solved for dt in the form that is stable for small slopes.
        steps.append((before + area, F.lit(a[0]) + F.lit(2.0) * need / (F.lit(a[1]) + F.sqrt(F.greatest(F.lit(a[1] * a[1]) + F.lit(2.0 * slope) * need, F.lit(0.0))))))
        before += area
    out = steps[-1][1]
    for end, value in reversed(steps[:-1]):
        out = F.when(u * F.lit(whole) < F.lit(end), value).otherwise(out)
    return F.round(out, 6)


def _position(copy: Column, words: Column) -> Column:
    """Training time, 0 to 1, of a copy (0, 1, ...) that has so many words in the mix."""
    u = (copy * F.col("source_size") + F.col("before") + words / F.lit(2.0)) / F.col("demand")
    out = F.lit(None).cast("double")
    for weight, knots in SCHEDULES.items():
        out = F.when(F.col("weight") == weight, _inverse(u, knots)).otherwise(out)
    return out


def allotments(sizes: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """How many words of each document the mix takes.

    ``sizes`` has doc_id, source, size. A source's documents stand in the order of a hash of their
    doc_id; the mix passes over them until the target, rounded to a word, is reached, so the last
    pass may end within a document. Adds source_size, target, demand (the rounded target), weight,
    before (words of the source before the document), whole (full copies), extra (words of a last,
    partial copy) and taken.
    """
    sources = materialize(source_targets(sizes, share, most), "targets")
    keyed = sizes.join(sources.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = keyed.withColumn("order", order).withColumn("bucket", F.conv(F.substring("order", 1, 3), 16, 10).cast("int") % BUCKETS)
    keyed = materialize(keyed, "sizes")
    # Running sums in two steps, so that a hot source's documents spread over its buckets.
    totals = keyed.groupBy("source_id", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source_id", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_id", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    df = keyed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(totals, ["source_id", "bucket"])
    df = df.withColumns({"before": F.col("base") + F.col("inner"), "demand": F.least(F.round("target").cast("bigint"), most * F.col("source_size"))})
    df = df.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("demand div source_size")).otherwise(0).cast("bigint"))
    left = F.col("demand") - F.col("whole") * F.col("source_size") - F.col("before")
    df = df.withColumn("extra", F.greatest(F.lit(0), F.least("size", left)))
    return df.withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))


def first_position() -> Column:
    words = F.when(F.col("whole") > 0, F.col("size")).otherwise(F.col("extra"))
    return F.when(F.col("taken") > 0, _position(F.lit(0), words))


def mix_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_position for every row of ``docs``, sorted
    by range of first_position (null, last, for documents that the mix takes nothing of).

    Size is the number of words between ASCII white space; null and empty texts have 0 and take 0.
    A null source is one source, last in order. Repeated rows count as often as they are there.
    """
    sizes = materialize(docs.select("doc_id", "source", word_count().alias("size")), "words")
    df = allotments(sizes).select("doc_id", "size", "source_size", "target", "taken", first_position().alias("first_position"))
    return df.orderBy(F.asc_nulls_last("first_position"), "doc_id")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: every copy that it takes as a row with the columns of ``docs``, range-sorted
    by training position. A partial copy has the words taken, joined by a space, as its text.
    Rows that agree in doc_id, text and source are copies of one row: each is taken as often as the mix asks
    for it, with the other columns of one of them, the same in every run."""
    own, content, partial, n, position = unused(docs, "own_id", "content", "partial", "n_words", "position")
    keys = {own: F.coalesce("doc_id", F.lit(-(1 << 63))), content: F.xxhash64("doc_id", "text", "source")}
    sizes = docs.select("doc_id", "source", word_count().alias("size"), *(c.alias(k) for k, c in zip(("own_id", "content"), keys.values(), strict=True)))
    last = F.when(F.col("extra") > 0, F.col("whole")).otherwise(F.col("whole") - 1)
    taken = allotments(materialize(sizes, "words")).where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    words = F.when(F.col("copy") < F.col("whole"), F.col("size")).otherwise(F.col("extra"))
    copies = taken.select(F.col("own_id").alias(own), F.col("content").alias(content), (words < F.col("size")).alias(partial), words.cast("int").alias(n), _position(F.col("copy"), words).alias(position))
    told = [f.name for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))]
    one = docs.withColumns(keys).groupBy(own, content).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*told)).alias(partial))
    joined = one.select(own, content, f"{partial}.*").join(copies, [own, content])
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col(n)), " ")
    joined = joined.withColumn("text", F.when(F.col(partial), cut).otherwise(F.col("text")))
    return joined.orderBy(position, "doc_id").select(docs.columns)


ORACLE_SQL = """
WITH sizes AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
sources AS (SELECT source, sum(size)::bigint AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sizes GROUP BY source),
ordered AS (SELECT *, 2 * source_size / weight AS ratio FROM sources),
held AS (SELECT a.source, a.ratio <= (1.5 * (SELECT sum(source_size)::double FROM sources) - coalesce(sum(2 * b.source_size) FILTER (b.ratio < a.ratio), 0)::double)
    / sum(b.weight) FILTER (b.ratio >= a.ratio) AS capped FROM ordered a, ordered b GROUP BY a.source, a.ratio),
level AS (SELECT (1.5 * sum(source_size)::double - coalesce(sum(2 * source_size) FILTER (capped), 0)::double) / (sum(weight) FILTER (NOT capped)) AS level
    FROM sources JOIN held ON sources.source IS NOT DISTINCT FROM held.source),
targets AS (SELECT sources.source, source_size, weight, CASE WHEN capped THEN (2 * source_size)::double ELSE weight * level END AS target
    FROM sources JOIN held ON sources.source IS NOT DISTINCT FROM held.source, level),
placed AS (SELECT r, doc_id, size, source_size, weight, target, least(round(target)::bigint, 2 * source_size)::bigint AS demand,
    coalesce(sum(size) OVER (PARTITION BY sizes.source ORDER BY md5(coalesce(doc_id::varchar, '')), doc_id, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before
    FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN demand // source_size ELSE 0 END AS whole FROM placed),
took AS (SELECT *, greatest(0, least(size, demand - whole * source_size - before)) AS extra FROM parts),
spots AS (SELECT *, whole * size + extra AS taken, (before + CASE WHEN whole > 0 THEN size ELSE extra END / 2.0::double) / demand::double AS u FROM took)
SELECT doc_id, size::bigint AS size, source_size::bigint AS source_size, target::double AS target, taken::bigint AS taken,
    CASE WHEN taken > 0 THEN round(CASE weight
        WHEN 5 THEN CASE WHEN u < 0.375 THEN 2.0::double * u / (0.5::double + sqrt(0.25::double + 2.0::double * u)) ELSE 0.5::double + 2.0::double * (u - 0.375::double) / (1.0::double + sqrt(1.0::double + 2.0::double * (u - 0.375::double))) END
        WHEN 2 THEN u
        ELSE CASE WHEN u < 0.625 THEN 2.0::double * u / (1.5::double + sqrt(2.25::double - 2.0::double * u)) ELSE 0.5::double + 2.0::double * (u - 0.625::double) / (1.0::double + sqrt(greatest(1.0::double - 2.0::double * (u - 0.625::double), 0))) END
    END, 6) END AS first_position
FROM spots
"""


def op7_mixing(spark, sf_dir):
    return mix_sizes(table(spark, sf_dir, "documents"))
