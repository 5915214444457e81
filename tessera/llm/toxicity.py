"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic
regression.

Terms that mark toxic texts (words and word beginnings) are learned from the labelled rows, as are
the trees and the calibration, on a bounded sample of them: SAMPLE rows in the order of a hash of
their doc_id. Features, scores and everything else cover all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import materialize, table

#: Labelled rows that terms, trees and calibration are fitted on, at most.
SAMPLE = 20_000
#: Learned terms, at most; a term's documents, and how much likelier in toxic ones, at least.
TERMS, MIN_DOCUMENTS, MIN_RATIO = 2_000, 6, 15.0
BEGINNINGS = (4, 5, 6)
TREES, DEPTH = 15, 3
NEAR = 5
FOLDS = 5
#: The share of the uncalibrated score in a score, which orders what calibration ties.
TIE = 0.001
#: Fixed English words, one feature beside the terms that are learned in whatever language the labels cover.
INSULTS = frozenset("idiot moron stupid loser trash pathetic worthless disgusting scum clown dumb fool jerk imbecile hate".split())
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch ti tus usted ustedes vosotros".split())
_LETTERS = re.compile(r"[^\W\d_]+")
_PLAIN = str.maketrans("013457@$!", "oleastasi")
FEATURES = ("words", "term_weight", "term_density", "terms", "strongest", "insults", "aimed", "capitals", "shouted", "exclaimed", "asked", "runs", "obfuscated", "stretched")


def _bare(token: str) -> str:
    return token.strip(".,;:!?\"'()[]{}<>«»¿¡|*-_").lower()


def _terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "+" for n in BEGINNINGS if len(word) > n)]


LONGEST_KEPT = 100


class Reader:
    """Features of texts, given the learned terms and their weights. Keeps what it knows of a bounded number of
    tokens, none of them over LONGEST_KEPT characters."""

    def __init__(self, terms: dict[str, float], cached: int = 300_000):
        self.terms, self.cached, self.known = terms, cached, {}

    def _token(self, token: str) -> tuple | int:
        """0 for a plain token, or (weight, insult, second person, shouted, obfuscated, stretched)."""
        word = _bare(token)
        clean = word if word.isalpha() else word.translate(_PLAIN)
        clean = clean if clean.isalpha() else "".join(_LETTERS.findall(clean))
        disguised = clean != word and any(c.isalpha() for c in word) and bool(clean)
        stretched = any(a == b == c for a, b, c in zip(word, word[1:], word[2:], strict=False))
        weight = max((self.terms.get(t, 0.0) for t in _terms_of(clean)), default=0.0)
        insult = clean in INSULTS
        letters = [c for c in token if c.isalpha()]
        shouted = len(letters) > 2 and all(c.isupper() for c in letters)
        info = (weight, insult, word in SECOND_PERSON, shouted, disguised, stretched)
        info = info if any(info) else 0
        if len(token) <= LONGEST_KEPT:
            if len(self.known) >= self.cached:
                self.known.clear()
            self.known[token] = info
        return info

    def features(self, text: str | None) -> tuple[float, ...]:
        text = text or ""
        tokens, known, token = text.split(), self.known, self._token
        marked = [(i, x) for i, t in enumerate(tokens) if (x := known[t] if t in known else token(t))]
        n = max(1, len(tokens))
        hits = [(i, x[0]) for i, x in marked if x[0]]
        abused = [i for i, x in marked if x[0] or x[1]]
        aimed, persons = 0, [i for i, x in marked if x[2]] if abused else []
        at = 0
        for i in abused:
            while at < len(persons) and persons[at] < i - NEAR:
                at += 1
            aimed += at < len(persons) and persons[at] <= i + NEAR
        size = max(1, len(text))
        capitals = sum(map(str.isupper, text)) if not text.islower() else 0
        return (
            math.log1p(len(tokens)),
            sum(w for _, w in hits),
            100 * sum(w for _, w in hits) / n,
            float(len(hits)),
            max((w for _, w in hits), default=0.0),
            100 * sum(1 for _, x in marked if x[1]) / n,
            100 * aimed / n,
            100 * capitals / size,
            100 * sum(1 for _, x in marked if x[3]) / n,
            100 * text.count("!") / size,
            100 * text.count("?") / size,
            100 * (text.count("!!") + text.count("??")) / size,
            100 * sum(1 for _, x in marked if x[4]) / n,
            100 * sum(1 for _, x in marked if x[5]) / n,
        )


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> DataFrame:
    """doc_id, text, toxic, share (0 to 99, by hash) of at most ``sample`` labelled documents outside fold 0. A
    document with several labels counts as toxic if one says so; of rows that share a doc_id the least
    text is learned from."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = usable.where(F.crc32(F.col("doc_id").cast("string")) % folds != 0)
    usable = usable.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample)
    # At most ``sample`` rows of three numbers.
    chosen = F.broadcast(usable.select("doc_id", "toxic", F.pmod("h", F.lit(100)).alias("share")))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id")
    return materialize(rows.groupBy("doc_id", "toxic", "share").agg(F.min("text").alias("text")), "labelled")


def learned_terms(rows: DataFrame) -> dict[str, float]:
    """Words and word beginnings ("abcd+") by the logarithm of how much likelier they are in a toxic text
    than in another. Equal texts with one label count as one."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = Counter(), Counter()
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[bool(toxic)].update({t for token in set((text or "").split()) if (w := _bare(token)).isalpha() for t in _terms_of(w)})
            terms = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([counts[i][t] for t in terms], pa.int64()) for i in (1, 0))], ["term", "toxic", "other"])

    same = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    texts = rows.select("text", "toxic", *same).dropDuplicates(["h1", "h2", "toxic"])
    texts = materialize(texts.select("text", "toxic"), "distinct")
    sizes = texts.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") == 0)).first()
    terms = texts.mapInArrow(counted, "term string, toxic bigint, other bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    ratio = (F.col("toxic") + 0.5) / (sizes[0] + 1) / ((F.col("other") + 0.5) / (sizes[1] + 1))
    best = terms.where(F.col("toxic") >= MIN_DOCUMENTS).withColumn("ratio", ratio).where(F.col("ratio") >= MIN_RATIO)
    return {r["term"]: math.log(r["ratio"]) for r in best.orderBy(F.desc("ratio"), "term").limit(TERMS).collect()}


def with_features(docs: DataFrame, terms: dict[str, float], *more: str) -> DataFrame:
    """doc_id, the columns ``more``, and FEATURES of each row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    names = ["doc_id", *more, *FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            rows = [reader.features(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names)

    passed = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *more))
    return docs.select("doc_id", *more, "text").mapInArrow(run, f"{passed}, " + ", ".join(f"{f} double" for f in FEATURES))


class Toxicity:
    """A fitted scorer: terms, trees and calibration, or a constant where the labels have one class only."""

    def __init__(self, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
        rows = training_rows(docs, labels, sample)
        counts = rows.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0))).first()
        self.constant = counts[1] / counts[0] if counts[0] and counts[1] in (0, counts[0]) else 0.0 if not counts[0] else None
        if self.constant is not None:
            return
        self.terms = learned_terms(rows)
        self.assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        # Features are computed where the rows are; then 20,000 rows of numbers at most, always in the same order.
        read = materialize(with_features(rows, self.terms, "toxic", "share"), "features")
        read = self.assembler.transform(read.repartition(4, "doc_id").sortWithinPartitions("doc_id"))
        read = read.select("doc_id", "share", F.col("toxic").cast("double").alias("label"), "features").cache()
        self.trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(read.where("share < 70"))
        held = self._raw(read.where("share >= 70")).select("label", "raw")
        # Where a small sample leaves no row to calibrate on, all rows serve.
        held = held if held.where("label > 0").limit(1).count() else self._raw(read).select("label", "raw")
        self.calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(held)
        read.unpersist()

    def _raw(self, df: DataFrame) -> DataFrame:
        return self.trees.transform(df).withColumn("raw", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id and score of every row."""
        if self.constant is not None:
            return docs.select("doc_id", F.lit(float(self.constant)).alias("score"))
        read = self._raw(self.assembler.transform(with_features(docs, self.terms)).select("doc_id", "features"))
        # Calibration has steps; within one, a thousandth of the trees' own score keeps their order.
        score = F.lit(1 - TIE) * F.col("calibrated") + F.lit(TIE) * F.col("raw")
        return self.calibration.transform(read).select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out (crc32 of doc_id as text leaves 0 by FOLDS), score, predicted for every row.

    Learns only from labelled rows that aren't held out; only texts are inputs of a score. Null texts
    count as empty and get a score too; a null doc_id isn't held out; repeated rows keep theirs, and equal
    texts have equal scores. Labels with no row, or one class, give their mean (0 without rows) as every
    score. What is learned doesn't depend on the order or partitions of the rows.
    """
    scored = Toxicity(docs, labels, sample).score(docs)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
