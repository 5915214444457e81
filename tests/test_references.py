from pyspark.sql import functions as F

from tessera.operators import references, sections

TEXT = """# A

See [the help][Help] and [^note].

# B

Plain [link](u) only, and [help].

[help]: https://example.com/help
[HELP]: https://example.com/second
[^note]: A note that points to [more] and [^note].
[more]: https://example.com/more
"""


def test_definitions_follow_sections(spark):
    docs = spark.createDataFrame([("d", TEXT)], "document_id string, markdown string")
    split, defined = sections.sections(docs), references.definitions(docs)
    assert {r["identifier"]: r["definition"] for r in defined.collect()}["HELP"] == "[help]: https://example.com/help"
    used = references.section_definitions(split, defined)
    by = {}
    titles = {r["id"]: r["title"] for r in split.collect()}
    for r in used.collect():
        by.setdefault(titles[r["id"]], set()).add(r["identifier"])
    assert by["A"] == {"HELP", "^NOTE", "MORE"} and "HELP" in by["B"]
    a = references.with_definitions(split, used).where("title = 'A'").first()["markdown"]
    assert "[more]: https://example.com/more" in a and a.startswith("# A")


def test_no_references(spark):
    docs = spark.createDataFrame([("d", "# A\n\ntext")], "document_id string, markdown string")
    assert references.section_definitions(sections.sections(docs), references.definitions(docs)).count() == 0


def test_preview(spark):
    df = spark.createDataFrame([(i, f"t{i}", "x" * (6001 if i == 0 else 5)) for i in range(30)], "n int, title string, text string")
    rows = references.preview(df, "n", F.col("title"), F.col("text")).collect()
    assert len(rows) == 20 and rows[0]["truncated"] and len(rows[0]["text"]) == 6000 and not rows[1]["truncated"]
