"""Line deduplication with a deletion-neighbourhood join, with built-in functions only.

Lines are sequences of words between ASCII white space. A line goes if an earlier line (smaller
doc_id, or same document and smaller line number) equals it or, for lines of ``min_words`` words or
more, is one word's change, insertion or deletion away. Two such lines share a variant: what is left
of one or both when a word is left out. A variant is keyed by hashes of the words before and after
the gap, so all lines with one key are within the bound of one another; only the earliest of them
is needed, and no pairs within a key are formed.

Equal lines are joined first. A line then takes part only if it shares its first or last half with
another one, as lines within one edit do; it emits the variants whose gap is outside that half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import WORD, materialize, table, text_or_empty, unused

#: One edit in five words or more leaves a similarity of 0.8 at least.
MIN_WORDS = 5
#: A line's place, and the first of its two hashes where rows share its doc_id (else 0, which takes no room).
LINE = ["doc_id", "line_no", "tie"]
#: Values of a join that more than one in HOT rows have, and over SPREAD_ROWS, are spread over tasks.
HOT, SPREAD_ROWS = 10_000, 100_000
#: Hashes are cut to 40 bits so that sums over the words of a line stay within 64.
_SUMMED = (1 << 40) - 1


def _words(line: str | Column) -> Column:
    return F.regexp_extract_all(line, F.lit(WORD), F.lit(0))


def line_occurrences(docs: DataFrame) -> DataFrame:
    """Every line with a word: doc_id, line_no (from 0), line."""
    return docs.select("doc_id", F.posexplode(F.split(text_or_empty(), "\n")).alias("line_no", "line")).where(F.col("line").rlike(WORD))


def distinct_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The first occurrence of each distinct line: LINE and halves, an array of hashes of its first and
    last halves (null for lines shorter than ``min_words``)."""
    lines = line_occurrences(docs).select("doc_id", "line_no", _words("line").alias("w")).withColumn("n", F.size("w"))

    def half(side: str, k: Column) -> Column:
        start = F.lit(1) if side == "first" else F.col("n") - k + 1
        return F.xxhash64(F.lit(side), k, F.slice("w", start, k))

    short, long = F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") + 1) / 2).cast("int")
    halves = F.when(F.col("n") >= min_words, F.array(half("first", short), half("first", long), half("last", short), half("last", long)))
    rows = lines.select(F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), "w").alias("h2"), F.struct("doc_id", "line_no", halves.alias("halves")).alias("at"))
    firsts = materialize(rows.groupBy("h1", "h2").agg(F.min("at").alias("at")).select("h1", "at.*"), "distinct")
    repeated = docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id", F.lit(True).alias("shared"))
    tie = F.when(F.col("shared"), F.col("h1")).otherwise(F.lit(0).cast("bigint"))
    return firsts.join(materialize(repeated, "repeated"), "doc_id", "left").select("doc_id", "line_no", tie.alias("tie"), "halves")


def _gaps(docs: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For the lines of ``near`` (LINE, first, last: a half is shared): their words, and the keys of
    their variants as (LINE, key1, key2)."""
    wanted = near.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "tie", "first", "last")).alias("wanted"))
    texts = docs.select("doc_id", "text").join(wanted, "doc_id")
    picked = texts.select("doc_id", F.split("text", "\n").alias("lines"), "wanted").select("doc_id", "lines", F.explode("wanted").alias("x"))
    picked = picked.select("doc_id", "x.*", _words(F.get("lines", F.col("x.line_no"))).alias("w"))
    # Where rows share a doc_id, only the wanted line of that number counts, and each row's by itself.
    picked = picked.where((F.size("w") > 0) & ((F.col("tie") == 0) | (F.xxhash64("w") == F.col("tie"))))
    picked = materialize(picked.withColumn("row", F.monotonically_increasing_id()), "lines")
    words = picked.select(*LINE, "row", "first", "last", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    # A word's hash with its place from the start, summed over the words before a gap, and with its
    # place from the end, over those after it; a deletion leaves both places as they are.
    words = words.withColumns({"a": F.xxhash64("word", "i").bitwiseAND(_SUMMED), "b": F.xxhash64("word", F.col("i") - F.col("n")).bitwiseAND(_SUMMED)})
    line = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("row").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    words = words.withColumns({"before": F.coalesce(F.sum("a").over(line), F.lit(0)), "after": F.coalesce(F.sum("b").over(rest), F.lit(0))})
    n, i, half = F.col("n"), F.col("i"), F.floor(F.col("n") / 2)
    # Word i left out; nothing left out, with the gap before word i or, at the last word, after it too.
    deleted = F.when((F.col("first") & (i >= half)) | (F.col("last") & (n - 1 - i >= half)), F.struct((n - 1).alias("m"), i.alias("gap"), "before", "after"))
    whole = F.when((F.col("first") & (i >= half)) | (F.col("last") & (n - i >= half)), F.struct(n.alias("m"), i.alias("gap"), F.col("before"), (F.col("after") + F.col("b")).alias("after")))
    end = F.when((i == n - 1) & F.col("first"), F.struct(n.alias("m"), n.alias("gap"), (F.col("before") + F.col("a")).alias("before"), F.lit(0).cast("bigint").alias("after")))
    variants = words.select(*LINE, F.explode(F.array_compact(F.array(deleted, whole, end))).alias("v"))
    keys = variants.select(*LINE, F.xxhash64("v.m", "v.gap", "v.before", "v.after").alias("key1"), F.xxhash64("v.after", "v.before").alias("key2"))
    return picked.select(*LINE, "w").dropDuplicates(LINE), keys


def _within_one_edit(a: str, b: str) -> Column:
    """Whether two arrays of words are one edit apart at most: their common start and end cover all
    words of the longer one but one."""

    def common(x: Column, y: Column) -> Column:
        differs = F.array_position(F.zip_with(x, y, lambda u, v: u.eqNullSafe(v)), False)
        return F.when(differs == 0, F.least(F.size(x), F.size(y))).otherwise(differs - 1)

    longer = F.greatest(F.size(a), F.size(b))
    return common(F.col(a), F.col(b)) + common(F.reverse(a), F.reverse(b)) >= longer - 1


def _spread_join(rows: DataFrame, counted: DataFrame, on: list[str]) -> DataFrame:
    """Join ``rows`` with ``counted`` (on, n: the number of rows with these values, and more), one row for
    each value. Values that over one in HOT of all rows have, HOT at most, are spread over several tasks:
    such a row of ``counted`` is repeated for each."""
    counted = materialize(counted, "counted")
    share = F.greatest(F.ceil(F.lit(counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) / HOT), F.lit(SPREAD_ROWS))
    parts = F.ceil(F.col("n") / share).cast("int")
    # At most HOT rows.
    hot = F.broadcast(counted.where(F.col("n") > share).select(*on, parts.alias("parts")))
    rows = rows.join(hot, on, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(*LINE), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    repeated = counted.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop("n")
    # Merged at every size: what is broadcast at a small one wouldn't be at a large one.
    return rows.join(repeated.hint("merge"), [*on, "part"]).drop("part")


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """LINE of those ``distinct`` lines that have an earlier one within one word edit."""
    halves = distinct.where("halves IS NOT NULL").select(*LINE, F.posexplode("halves").alias("which", "half"))
    # A half's two lengths may coincide, so lines are told apart by their places, not counted by rows.
    counts = halves.groupBy("half").agg(F.count("*").alias("n"), *(f(c).alias(f"{side}_{c}") for c in LINE for side, f in (("least", F.min), ("most", F.max))))
    shared = counts.where(" OR ".join(f"NOT (least_{c} <=> most_{c})" for c in LINE)).select("half", "n")
    near = _spread_join(halves, shared, ["half"]).groupBy(*LINE).agg(F.bool_or(F.col("which") < 2).alias("first"), F.bool_or(F.col("which") >= 2).alias("last"))
    words, keys = _gaps(docs, near)
    keys = materialize(keys, "variants")
    place = F.struct(*LINE)
    earliest = keys.groupBy("key1", "key2").agg(F.count("*").alias("n"), F.min(place).alias("e"), F.max(place).alias("z")).where("e < z").select("key1", "key2", "n", "e")
    found = _spread_join(keys, earliest, ["key1", "key2"]).where((F.col("doc_id") > F.col("e.doc_id")) | ((F.col("doc_id") == F.col("e.doc_id")) & (F.col("line_no") > F.col("e.line_no"))))
    # Every earliest line that a line shares a key with is compared, lest one whose key only collides hide another.
    found = found.select(*LINE, *(F.col(f"e.{c}").alias(f"e_{c}") for c in LINE)).distinct()
    pairs = found.join(words, LINE).withColumnRenamed("w", "own")
    other = words.select(*(F.col(c).alias(f"e_{c}") for c in LINE), F.col("w").alias("other"))
    return pairs.join(other, [f"e_{c}" for c in LINE]).where(_within_one_edit("own", "other")).select(*LINE).distinct()


def kept_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, kept), the sorted numbers of each document's lines that stay, for documents that keep
    one; and the near lines. A doc_id of null ranks before all others and has near lines of its own
    kept. Rows that share a doc_id are alike in rank: neither's line is earlier than the other's of the same
    number, repeated rows keep the same lines, and a line number stays if it does for one of the rows."""
    distinct = distinct_lines(docs, min_words)
    near = materialize(near_lines(docs, distinct), "near")
    kept = distinct.select(*LINE).join(near, LINE, "left_anti")
    return kept.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("kept")), near


def line_verdicts(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """For every row of ``docs``: doc_id, n_lines (with a word), n_kept, n_removed, n_near (removed
    for a line that isn't equal) and kept_lines, the numbers of the lines that stay, joined by commas.

    Null and empty texts, and lines without a word, have nothing to remove. Each of several rows with one
    doc_id has a row of its own here; without rows there is no result. Extra columns are ignored.
    """
    kept, near = kept_lines(docs, min_words)
    nears = near.groupBy("doc_id").agg(F.count_distinct("line_no").alias("n_near"))
    lines = docs.select("doc_id", F.size(F.filter(F.split(text_or_empty(), "\n"), lambda x: x.rlike(WORD))).cast("bigint").alias("n_lines"))
    verdicts = kept.join(nears, "doc_id", "full_outer").select(F.col("doc_id").alias("id"), "kept", "n_near")
    df = lines.join(verdicts, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    n_kept = F.coalesce(F.size("kept"), F.lit(0)).cast("bigint")
    n_kept = F.when(F.col("kept").isNull(), F.lit(0).cast("bigint")).otherwise(n_kept)
    return df.select("doc_id", "n_lines", n_kept.alias("n_kept"), (F.col("n_lines") - n_kept).alias("n_removed"), F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.coalesce(F.array_join("kept", ","), F.lit("")).alias("kept_lines"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the lines that go taken out of text, n_chars (where there is such a column)
    adjusted; lines without a word stay between kept ones. A text that loses all its lines is empty;
    a null text stays null. All rows and other columns stay."""
    own, numbers = unused(docs, "kept_id", "kept_lines")
    kept, _ = kept_lines(docs, min_words)
    joined = docs.join(kept.select(F.col("doc_id").alias(own), F.col("kept").alias(numbers)), F.col("doc_id").eqNullSafe(F.col(own)), "left")
    lines = F.split("text", "\n")
    stays = F.filter(lines, lambda x, i: ~x.rlike(WORD) | F.coalesce(F.array_contains(numbers, i), F.lit(False)))
    n_lines = F.size(F.filter(lines, lambda x: x.rlike(WORD)))
    emptied = F.col(numbers).isNull() & (n_lines > 0)
    text = F.when(emptied, F.lit("")).when(F.size(numbers) == n_lines, F.col("text")).otherwise(F.array_join(stays, "\n"))
    joined = joined.withColumn("text", F.when(F.col("text").isNotNull(), text))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select(docs.columns)


def op9_line_dedup(spark, sf_dir):
    return line_verdicts(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM documents),
lines AS (SELECT doc_id, line_no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
firsts AS (SELECT w, len(w) AS n, array_to_string(w, ' ') AS line, min(doc_id * 1000000 + line_no) AS place FROM lines GROUP BY w),
dels AS (SELECT place, n, i, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM firsts WHERE n >= {MIN_WORDS})),
swapped AS (SELECT place FROM dels QUALIFY place > min(place) OVER (PARTITION BY n, i, v)),
grown AS (SELECT d.place AS big, f.place AS small FROM dels d JOIN firsts f ON f.n >= {MIN_WORDS} AND f.n = d.n - 1 AND f.line = d.v),
near AS (SELECT place FROM swapped UNION SELECT big FROM grown WHERE small < big UNION SELECT small FROM grown WHERE big < small),
kept AS (SELECT place // 1000000 AS doc_id, place % 1000000 AS line_no FROM firsts WHERE place NOT IN (SELECT place FROM near)),
kept_by AS (SELECT doc_id, count(*) AS n_kept, string_agg(line_no::varchar, ',' ORDER BY line_no) AS kept_lines FROM kept GROUP BY doc_id),
near_by AS (SELECT place // 1000000 AS doc_id, count(*) AS n_near FROM near GROUP BY 1),
counts AS (SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::bigint AS n_lines, coalesce(n_kept, 0)::bigint AS n_kept, (coalesce(n_lines, 0) - coalesce(n_kept, 0))::bigint AS n_removed,
    coalesce(n_near, 0)::bigint AS n_near, coalesce(kept_lines, '') AS kept_lines
FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN kept_by USING (doc_id) LEFT JOIN near_by USING (doc_id)
"""
