import math
import random
import zlib

import pytest

from tessera.llm import toxicity


def test_texts_that_share_one_word_are_all_learned_from(spark):
    words = [f"w{i}" for i in range(3000)]
    letters = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:04d}")
    least = min(("x" + letters(i) for i in range(3000)), key=lambda w: zlib.crc32(w.encode()))
    rows = [(f"{least} {letters(i)}q {'insulto' if i % 2 else 'fine'}", i % 2) for i in range(60)] + [(f"insulto {words[0]}", 1)] * 2
    frame = spark.createDataFrame(rows, "text string, toxic int")
    assert "insulto" in toxicity.learned_terms(frame)


def test_features_are_what_they_are_called():
    """Each feature next to a count that is made for it alone."""
    rng = random.Random(3)
    vocabulary = ["You", "are", "an", "idiot", "IDIOT", "st0pid", "stupid!!", "what??", "NO", "sooooo", "blabber", "blab", "nice", "\u00e9t\u00e9", "42", "...", "du", "(moron)"]
    terms = {"blab+": 2.0, "nice": 0.5}
    for _ in range(200):
        tokens = [rng.choice(vocabulary) for _ in range(rng.randrange(12))]
        text = " ".join(tokens)
        got = dict(zip(toxicity.FEATURES, toxicity.Reader(terms, cached=3).features(text), strict=True))
        n, size = max(1, len(tokens)), max(1, len(text))
        weight = [2.0 if t == "blabber" else 0.5 if t == "nice" else 0.0 for t in tokens]
        insult = [t.strip("!?()").lower() in ("idiot", "stupid", "moron") for t in tokens]
        person = [t in ("You", "du") for t in tokens]
        abused = [i for i in range(len(tokens)) if weight[i] or insult[i]]
        want = {
            "words": math.log1p(len(tokens)),
            "term_weight": sum(weight),
            "term_density": 100 * sum(weight) / n,
            "terms": sum(w > 0 for w in weight),
            "strongest": max(weight, default=0.0),
            "insults": 100 * sum(insult) / n,
            "aimed": 100 * sum(any(person[j] for j in range(max(0, i - toxicity.NEAR), min(len(tokens), i + toxicity.NEAR + 1))) for i in abused) / n,
            "capitals": 100 * sum(c.isupper() for c in text) / size,
            "shouted": 100 * sum(t == "IDIOT" for t in tokens) / n,
            "exclaimed": 100 * text.count("!") / size,
            "asked": 100 * text.count("?") / size,
            "runs": 100 * (text.count("!!") + text.count("??")) / size,
            "obfuscated": 100 * sum(t == "st0pid" for t in tokens) / n,
            "stretched": 100 * sum(t == "sooooo" for t in tokens) / n,
        }
        assert got == pytest.approx(want), text


def test_reruns_agree_and_order_does_not_matter(spark, frame):
    rng = random.Random(5)
    bad, good = ["vile", "awful", "hateful", "grotty"], ["river", "house", "garden", "music", "bridge"]
    rows = [(i, " ".join(rng.choice(bad if i % 3 == 0 and rng.random() < 0.5 else good) for _ in range(12)), "s") for i in range(400)]
    rows += [(7, "another text of the same number", "s"), rows[3]]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)] + [(9, 1)], "doc_id bigint, toxic int")
    runs = []
    for k in range(2):
        docs = frame(rows if k == 0 else rows[::-1]).repartition(3 + 4 * k)
        runs.append(sorted((r["doc_id"], round(r["score"], 12)) for r in toxicity.score_toxicity(docs, labels).collect()))
    assert runs[0] == runs[1]


def test_very_long_tokens_are_not_kept():
    reader = toxicity.Reader({"bad": 1.0}, cached=10)
    text = " ".join(["bad", "x" * 5000, "BAD" * 2000, "fine"])
    assert reader.features(text) == reader.features(text) == toxicity.Reader({"bad": 1.0}).features(text)
    assert set(reader.known) == {"bad", "fine"}
