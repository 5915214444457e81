import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import minhash, simhash
from tests.llm.conftest import ODD


def brute_sets(texts):
    words = [t.lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def brute_first(rows):
    """The least doc_id of each row's group, by the Jaccard similarity of all pairs."""
    sets, root = brute_sets([t for _, t in rows]), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


def test_near_dedup_is_brute_force_jaccard(frame):
    """Groups of texts with 0 to 12 of their 60 to 300 words changed, chains among them."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = [(0, "", "s"), (1, " \n", "s"), (2, "One  two", "s"), (3, "one two", "s")]
    for _ in range(25):
        text = [word() for _ in range(rng.randint(60, 300))]
        for _ in range(rng.randint(1, 12)):
            copy = list(text)
            for _ in range(rng.randint(0, 12)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy), "s"))
            text = copy if rng.random() < 0.3 else text
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(None, frame(rows), "").select("doc_id").collect()]
    want = brute_first([(i, t) for i, t, _ in rows])
    assert len(got) == len(set(got)) and set(got) == want and 25 < len(want) < len(rows)


def template_texts(rng, shared=104):
    """Texts around one template, a fifth of the words or a little more being their own, and near copies of some."""
    word = lambda: f"v{rng.randrange(10**6)}"
    template = [word() for _ in range(120)]
    rows = []
    for i in range(60):
        text = template[: shared + i % 3] + [word() for _ in range(14 + i % 5)]
        rows.append((len(rows), " ".join(text), "s"))
        if i % 6 == 0:
            rows.append((len(rows), " ".join([*text[:-1], word()]), "s"))
    return rows


@pytest.mark.parametrize("crowd", [minhash.CROWD, 3])
def test_crowded_buckets_are_brute_force_too(frame, crowd):
    rows = template_texts(random.Random(9))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(rows), crowd).collect()}
    want = brute_first([(i, t) for i, t, _ in rows])
    assert set(got) == {i for i, _, _ in rows} and {i for i, c in got.items() if i == c} == want and 10 < len(want) < len(rows)


def test_what_many_share_brings_no_two_together(frame):
    rows = frame(template_texts(random.Random(9), shared=60))
    signed = minhash.signatures(rows).withColumn("first", F.col("doc_id"))
    sets = minhash._sets(rows, signed.select("id", "first"))
    few = minhash._rare_shingles(signed.select(F.struct("id", "n", "sketch").alias("p"), F.col("id").alias("r")), sets)
    # Copies share their own ending; the template, in all 70, is out of it.
    assert few.groupBy("shingle").count().agg(F.max("count")).first()[0] <= 8


def test_near_dedup_of_odd_rows(odd, nothing):
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(None, odd, "").select("doc_id").collect()]
    assert sorted(i for i in got if i is not None) == [1, 4, 5, 7, 8] and got.count(None) == sum(r[0] is None for r in ODD)
    assert corpus_pipeline.near_dedup(None, nothing, "").count() == 0


def test_what_simhash_links_is_confirmed_without_a_shared_bucket(spark):
    """Buckets that no two sets share leave only the links of fingerprints, of which near ones count."""
    words = [f"w{i}" for i in range(400)]
    texts = {1: words, 2: [*words[:-1], "other"], 3: [f"v{i}" for i in range(400)], 4: words}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id bigint, text string")
    linked = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "doc_id bigint, component_id bigint")
    own = minhash.signatures(docs)
    distinct = own.groupBy("id").agg(F.min("doc_id").alias("first"), F.any_value("n").alias("n"), F.array("id").alias("buckets"), F.any_value("sketch").alias("sketch"))
    of = {r["first"]: r["id"] for r in distinct.collect()}
    assert minhash.link_groups(docs, distinct).count() == 0
    groups = minhash.link_groups(docs, distinct, brought=minhash._brought(own, linked)).collect()
    assert {r["id"] for r in groups} == {of[1], of[2]} and len({r["root"] for r in groups}) == 1


def test_the_pipeline_links_by_simhash_too(spark, monkeypatch):
    asked = []
    real = simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda docs, *more: asked.append(1) or real(docs, *more))
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m n")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3] and asked
