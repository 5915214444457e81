"""Quality rules of documents and of their hosts, with built-in functions only.

Each document gets counts and a base verdict from them. Rule failures are then summed by host
(the source column); a host's failure rates are shrunk towards the corpus with an empirical beta
prior, and documents of hosts whose rate is over a bound almost surely, by the posterior that this
gives, are rejected too. So a host with few documents is judged mostly by the prior: all of its three
documents may fail, and whether it goes depends on how the corpus' hosts do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import WORD, materialize, table, text_or_empty, unused

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
SYMBOLS = "#*$%&|<>"
#: A host is rejected with all its documents if its rate of failures of a rule is above this, and that by so
#: many of the posterior's standard deviations (one-sided 95 %).
MAX_HOST_RATE, DEVIATIONS = 0.5, 1.645
#: Rules whose failures are summed by host: name and condition on a document's counts.
HOST_RULES = {
    "base": "base_failed",
    "symbols": "10 * n_symbols > n_words",
    "lines": "3 * n_dup_lines > n_lines",
    "length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (1.0, 1e6)


def document_counts(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` named doc_id and source, with n_words, word_chars, n_symbols,
    n_lines (with a word), n_dup_lines, n_repeat_words and base_failed. A window of five words is
    known by its 64-bit hash within its text. Null texts count as empty."""
    text = text_or_empty()
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    df = docs.select("doc_id", "source", text.alias("t"))
    df = df.withColumns({"w": F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), "l": lines})
    n = F.size("w")

    def window(i: Column) -> Column:
        return F.struct(F.xxhash64(*(F.get("w", i + k) for k in range(WINDOW))).alias("h"), i.alias("i"))

    windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - WINDOW), window))
    df = df.withColumn("s", F.when(n >= WINDOW, windows))
    # Equal windows are neighbours now; keep their places.
    pairs = F.zip_with("s", F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn("p", F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))))
    # Each place covers five words, or those up to the next place.
    covered = F.zip_with("p", F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    repeated = F.coalesce(F.aggregate(covered, F.lit(0), lambda total, x: total + x), F.lit(0))
    df = df.select(
        "doc_id",
        "source",
        n.cast("bigint").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size("l").cast("bigint").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        repeated.cast("bigint").alias("n_repeat_words"),
    )
    return df.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words"))


def host_verdicts(counts: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host (source, null being one): documents, shrunk rate of each rule, rejected.

    The prior's mean is the corpus' rate, but ``max_rate`` at most, so no host is condemned by other hosts'
    documents alone; its weight, in documents, comes from the variance of the hosts' rates, less what
    chance adds to it."""
    failures = {name: F.expr(rule).cast("bigint") for name, rule in HOST_RULES.items()}
    hosts = counts.groupBy("source").agg(F.count("*").alias("documents"), *(F.sum(x).alias(name) for name, x in failures.items()))
    # One row: the corpus' rate of each rule, and the variance of the hosts' rates about it, by document.
    squares = {name: F.sum(F.col(name) * F.col(name) / F.col("documents")) / F.sum("documents") for name in HOST_RULES}
    moments = hosts.agg((F.count("*") / F.sum("documents")).alias("noise"), *(x for name in HOST_RULES for x in ((F.sum(name) / F.sum("documents")).alias(f"{name}_mean"), squares[name].alias(f"{name}_squares")))).first()
    rates, bad = {}, F.lit(False)
    for name in HOST_RULES:
        mean = moments[f"{name}_mean"] or 0.0
        variance = (moments[f"{name}_squares"] or 0.0) - mean * mean - mean * (1 - mean) * (moments["noise"] or 0.0)
        weight = min(max(mean * (1 - mean) / variance - 1 if variance > 0 else PRIOR_WEIGHT[1], PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
        rates[f"{name}_rate"] = rate = (F.col(name) + min(mean, max_rate) * weight) / (F.col("documents") + weight)
        bad = bad | (rate - DEVIATIONS * F.sqrt(rate * (1 - rate) / (F.col("documents") + weight + 1)) > max_rate)
    return hosts.select("source", "documents", *(x.alias(name) for name, x in rates.items()), bad.alias("rejected"))


def quality_verdicts(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Every row's counts, base_failed and kept: false if base_failed or if its host is rejected.

    Null and empty texts have no words and fail. A null source is a host of its own. Repeated rows
    and null doc_ids each keep their row; other columns are ignored; no rows give no rows.
    """
    counts = materialize(document_counts(docs), "quality")
    hosts = host_verdicts(counts, max_rate).select(F.col("source").alias("host"), "rejected")
    joined = counts.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left")
    kept = ~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are. Rows of one doc_id (null
    counts as one) are all kept if one of them is."""
    (own,) = unused(docs, "rejected_id")
    bad = quality_verdicts(docs).groupBy(F.col("doc_id").alias(own)).agg(F.bool_or("kept").alias("kept")).where("NOT kept").select(own)
    # Written first, so that its size decides how it is joined.
    return docs.join(materialize(bad, "rejected"), F.col("doc_id").eqNullSafe(F.col(own)), "left_anti")


def op5_quality_rules(spark, sf_dir):
    return quality_verdicts(table(spark, sf_dir, "documents"))


def _oracle(documents: str = "documents") -> str:
    sums = ", ".join(f"sum(({rule})::int)::double AS {name}" for name, rule in HOST_RULES.items())
    moments = ", ".join(f"sum({name}) / sum(n) AS {name}_mean, sum({name} * {name} / n) / sum(n) AS {name}_squares" for name in HOST_RULES)
    least, most = PRIOR_WEIGHT
    own = ", ".join(f"{name}_mean, {name}_squares - {name}_mean * {name}_mean - {name}_mean * (1 - {name}_mean) * noise AS {name}_var" for name in HOST_RULES)
    weights = ", ".join(f"least({name}_mean, {MAX_HOST_RATE}) AS {name}_mean, least(greatest(CASE WHEN {name}_var > 0 THEN {name}_mean * (1 - {name}_mean) / {name}_var - 1 ELSE {most} END, {least}), {most}) AS {name}_weight" for name in HOST_RULES)
    shrunk = ", ".join(f"({name} + {name}_mean * {name}_weight) / (n + {name}_weight) AS {name}_rate, n + {name}_weight + 1 AS {name}_n" for name in HOST_RULES)
    rates = " OR ".join(f"{name}_rate - {DEVIATIONS} * sqrt({name}_rate * (1 - {name}_rate) / {name}_n) > {MAX_HOST_RATE}" for name in HOST_RULES)
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM {documents}),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
windows AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS five
    FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words WHERE len(w) >= {WINDOW})),
repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, five) > 1),
covered AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS place FROM repeated) GROUP BY r),
counts AS (SELECT doc_id, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words FROM words LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM counts),
hosts AS (SELECT source, count(*)::double AS n, {sums} FROM judged GROUP BY source),
moments AS (SELECT count(*) / sum(n) AS noise, {moments} FROM hosts), between AS (SELECT {own} FROM moments), prior AS (SELECT {weights} FROM between),
shrunk AS (SELECT source, {shrunk} FROM hosts, prior), verdicts AS (SELECT source, {rates} AS rejected FROM shrunk)
SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols, n_dup_lines::bigint AS n_dup_lines,
    n_repeat_words::bigint AS n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""


ORACLE_SQL = _oracle()
