import pytest
from pyspark.sql import functions as F

from tessera.errors import TesseraError
from tessera.functions import canon
from tessera.operators import sections as s

HIERARCHY = "preamble\n\n# 指南\n\n## 安装\n\na\n\n### 配置\n\nb\n\n## 安装\n\nc\n\n# 附录\n\nd"


def split(spark, *texts):
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "document_id string, markdown string")
    return s.section_revision(s.sections(docs)).orderBy("document_id", "index")


def test_canonical_json_and_columns_agree(spark):
    values = ['a"b', "é\n漢", "\\", "x\ty", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(canon.hashed(canon.json_array(canon.json_string(F.col("v")), F.lit("1")))).collect()]
    assert got == [canon.content_hash([v, 1]) for v in values]
    assert canon.canonical_json({"b": 1, "a": [None, "é"]}) == '{"a":[null,"é"],"b":1}'


def test_ids_are_hashes_of_their_parts(spark):
    one = spark.range(1)
    got = one.select(canon.index_id(F.lit("kb"), F.lit("wiki"), F.lit("x")).alias("a"), canon.node_id(F.lit("kb"), F.lit("s"), F.lit("r"), F.lit("e1"), F.lit(None).cast("string")).alias("b"), canon.node_id(F.lit("kb"), F.lit("s"), F.lit("r"), F.lit("e1"), F.lit("atlas")).alias("c")).first()
    assert got["a"] == "index-" + canon.content_hash(["kb", "wiki", "x"])
    assert got["b"] == "wiki-node-" + canon.content_hash(["kb", ["local", "s", "r", "e1"]])
    assert got["c"] == "wiki-node-" + canon.content_hash(["kb", ["canonical", "atlas"]])


def test_trim_and_utf16_length(spark):
    df = spark.createDataFrame([("﻿　 a \n",), ("👨‍👩‍👧a",)], "v string")
    rows = df.select(canon.trimmed(F.col("v")), canon.utf16_length(F.col("v"))).collect()
    assert rows[0][0] == "a" and rows[1][1] == len("👨‍👩‍👧a".encode("utf-16-le")) // 2


def test_hierarchy(spark):
    rows = split(spark, HIERARCHY).collect()
    assert [r["depth"] for r in rows] == [0, 1, 2, 3, 2, 1]
    assert len({r["id"] for r in rows}) == 6
    assert rows[3]["heading_path"] == ["指南", "安装", "配置"]
    assert rows[4]["parent_id"] == rows[1]["id"] and rows[4]["occurrence"] == 1


def test_section_id_formula(spark):
    rows = split(spark, "# A\n\n## B").collect()
    a = "section-" + canon.content_hash(["d0", [], 1, "A", 0])
    assert rows[0]["id"] == a
    assert rows[1]["id"] == "section-" + canon.content_hash(["d0", [a], 2, "B", 0])


def test_insertion_keeps_other_ids(spark):
    before = {r["id"] for r in split(spark, "# A\n\nx\n\n# C\n\ny").collect()}
    after = {r["id"] for r in split(spark, "# A\n\nx\n\n# New\n\nn\n\n# C\n\ny").collect()}
    assert before < after


def test_empty_and_fences(spark):
    assert split(spark, "", "   \n").count() == 0
    assert [r["depth"] for r in split(spark, "```\n# no\n```\n\n# yes").collect()] == [0, 1]


def test_normalize_mdx(spark):
    text = "---\ntitle: 'T'\n---\nimport X from 'x'\n\n<Callout title=\"Note\">be careful</Callout>\n\n<ZoomImage src=\"/a.png\" alt=\"A\" />\n\n{/* hidden */}\n<script>bad()</script>\n<Widget>kept</Widget>"
    row = s.normalized(spark.createDataFrame([("d", text)], "document_id string, content string"), "mdx").first()
    assert row["title"] == "T"
    assert "> **Note**" in row["markdown"] and "![A](/a.png)" in row["markdown"] and "kept" in row["markdown"]
    assert not any(x in row["markdown"] for x in ("import", "hidden", "bad()", "<"))


def test_adapters():
    with pytest.raises(TesseraError):
        s.register_adapter("mdx", lambda c: c)


def chunked(spark, text, **options):
    return s.chunks(split(spark, text), tokens=len, **options).orderBy("index").collect()


def test_chunks_keep_within_budget_and_lose_nothing(spark):
    paragraphs = [f"paragraph {i} " + "x" * 20 for i in range(8)]
    rows = chunked(spark, "# H\n\n" + "\n\n".join(paragraphs), max_tokens=100)
    assert all(r["markdown"].startswith("# H") and not r["oversized"] for r in rows)
    assert [p for r in rows for p in r["markdown"].split("\n\n")[1:]] == paragraphs
    assert rows[0]["previous_chunk_id"] is None and rows[0]["next_chunk_id"] == rows[1]["id"] and rows[-1]["next_chunk_id"] is None


def test_overlap_repeats_whole_parts(spark):
    paragraphs = [f"p{i} " + "x" * 20 for i in range(6)]
    rows = chunked(spark, "# H\n\n" + "\n\n".join(paragraphs), max_tokens=100, overlap_tokens=30)
    for a, b in zip(rows, rows[1:], strict=False):
        assert b["markdown"].split("\n\n")[1] == a["markdown"].split("\n\n")[-1]


def test_code_and_tables_are_cut_by_line(spark):
    code = "```py\n" + "\n".join(f"line_{i} = {i}" for i in range(12)) + "\n```"
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | value |" for i in range(10))
    rows = chunked(spark, f"# H\n\n{code}\n\n{table}", max_tokens=80)
    assert all(len(r["markdown"]) <= 90 for r in rows) and len(rows) > 3
    text = "\n".join(r["markdown"] for r in rows)
    assert all(f"line_{i} = {i}\n" in text for i in range(12)) and all(f"| {i} | value |" in text for i in range(10))
    assert text.count("|---|---|") > 1


def test_oversized(spark):
    quote = "# H\n\n> " + "x" * 200
    assert [r["oversized"] for r in chunked(spark, quote, max_tokens=50)] == [True]
    with pytest.raises(TesseraError, match="OVERSIZED_CONTENT"):
        chunked(spark, quote, max_tokens=50, oversized="error")


def test_long_words_are_cut_between_graphemes(spark):
    family = "\U0001f468\u200d\U0001f469\u200d\U0001f467"
    rows = chunked(spark, "# H\n\n" + (family + "e\u0301") * 30, max_tokens=50)
    bodies = [r["markdown"].removeprefix("# H\n\n") for r in rows]
    assert not any(r["oversized"] for r in rows) and "".join(bodies) == (family + "e\u0301") * 30
    assert all(b.startswith((family, "e\u0301")) and b.endswith((family, "e\u0301")) for b in bodies)


def test_an_oversized_part_stands_alone(spark):
    text = "# H\n\na small one\n\n> " + "x" * 100 + "\n\nanother"
    rows = chunked(spark, text, max_tokens=50, overlap_tokens=30)
    assert [r["oversized"] for r in rows] == [False, True, False] and "small" not in rows[2]["markdown"]


def test_fences_close_by_kind_and_length(spark):
    text = "~~~\n```\n# x\n~~~\n\n# Real\n\n````\n```\n# y\n````\n\n## Next\n\n```\n# open"
    assert [r["title"] for r in split(spark, text).collect()] == [None, "Real", "Next"]


def test_offsets_lead_back_to_the_text(spark):
    rows = split(spark, HIERARCHY).collect()
    assert all(HIERARCHY[r["start_offset"] : r["end_offset"]].strip() == r["markdown"] for r in rows)
    assert [HIERARCHY[: r["start_offset"]].count("\n") for r in rows] == [r["first_line"] for r in rows]


def test_links_and_code(spark):
    text = '![i](/i.png) [a](u "t") [a](u "t") [b](v)\n\n```sh x\nls\n```\n\n```sh x\nls\n```\n'
    row = spark.createDataFrame([(text,)], "m string").select(s.links(F.col("m")), s.code_blocks(F.col("m")), s.plain_text(F.lit("# T\n\n[x](y) **b**"))).first()
    assert [(x["kind"], x["text"], x["url"], x["title"]) for x in row[0]] == [("image", "i", "/i.png", ""), ("link", "a", "u", "t"), ("link", "b", "v", "")]
    assert [(x["language"], x["meta"], x["code"]) for x in row[1]] == [("sh", "x", "ls")]
    assert row[2] == "T\n\nx b"
