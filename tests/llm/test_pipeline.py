import hashlib
from itertools import combinations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import ODD
from tests.llm.test_dedup import brute_lines
from tests.llm.test_text_operators import brute_repeated_words


def brute_similar(texts):
    """The least id that links of five-word Jaccard 0.8 or more lead to, by id."""
    sets = {}
    for i, text in texts.items():
        words = text.encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if 5 * len(x & y) >= 4 * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: find(i) for i in texts}


def test_stages_are_brute_force(spark, tmp_path):
    """Each stage on what the one before kept, against plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 4000")
    rows = {r["doc_id"]: r for r in docs.collect()}
    want = {i: r["text"] for i, r in rows.items() if len(w := r["text"].split()) >= 10 and 100 * brute_repeated_words(w) <= 20 * len(w)}
    stages = dict(corpus_pipeline.STAGES)

    def step(name, given):
        stages[name](spark, given, "").write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    good = step("quality_rules", docs)
    assert good.columns == docs.columns and {r["doc_id"]: r["text"] for r in good.collect()} == want
    kept = brute_lines([(i, t) for i, t in want.items()])
    lined = step("line_dedup", good)
    got = {r["doc_id"]: r["text"] for r in lined.collect()}
    expected = {i: [line.split() for no, line in enumerate(t.split("\n")) if (i, no) in kept] for i, t in want.items()}
    assert {i: [x.split() for x in t.split("\n") if x.split()] for i, t in got.items()} == expected
    groups = brute_similar(got)
    single = step("near_dedup", lined)
    firsts = {r["doc_id"]: r["text"] for r in single.collect()}
    assert firsts == {i: t for i, t in got.items() if groups[i] == i} and single.count() == len(firsts)
    mixed = step("mix", single)
    words = sum(len(t.split()) for t in firsts.values())
    taken = sum(len(r["text"].split()) for r in mixed.collect())
    assert mixed.columns == docs.columns and abs(taken - 1.5 * words) <= 20
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = sorted((r["doc_id"], r["ids_sha256"]) for r in step("encode", mixed).collect())
    encode = lambda t: b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids)
    assert out == sorted((r["doc_id"], hashlib.sha256(encode(r["text"])).hexdigest()) for r in mixed.collect())


def test_run_is_its_stages(spark):
    df = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and df.count() > 100


def test_registered():
    import __spark_entry__ as driver

    names = driver.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.parametrize("rows", ["odd", "nothing"])
def test_stages_take_any_rows(spark, rows, request, tmp_path):
    """Each stage on odd rows and on none, and on what the stage before makes of them."""
    given = request.getfixturevalue(rows)
    chain = given
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, "")
        chain = stage(spark, chain, "")
        chain.write.parquet(f"{tmp_path}/{name}")
        chain = spark.read.parquet(f"{tmp_path}/{name}")
        n = out.count()
        assert n == 0 if rows == "nothing" else n <= 2 * len(ODD)
        if name in ("quality_rules", "line_dedup", "near_dedup", "mix"):
            assert out.columns == given.columns and chain.columns == given.columns
        if rows == "odd" and name == "line_dedup":
            assert n == len(ODD)
