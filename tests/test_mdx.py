"""MDX and HTML to Markdown: what comes through as it is, what is read, what is left out, and where things come from."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.errors import TesseraError
from tessera.operators import mdx
from tessera.operators import sections as s
from tessera.plans import ingest


def read(spark, *texts, adapter="mdx"):
    rows = [(f"d{i:03}", t, f"p{i}") for i, t in enumerate(texts)]
    out = s.normalized(spark.createDataFrame(rows, "document_id string, content string, path string"), adapter).orderBy("document_id").collect()
    for r, (_, text, _) in zip(out, rows, strict=True):
        runs = r["source_map"] or []
        assert [x["start"] for x in runs] == [0, *(x["stop"] for x in runs)][: len(runs)] and (not runs or runs[-1]["stop"] == len(r["markdown"]))
        for x in runs:
            if x["stop"] - x["start"] == x["source_stop"] - x["source_start"] and x["stop"] - x["start"] > 1:
                assert r["markdown"][x["start"] : x["stop"]] == text[x["source_start"] : x["source_stop"]]
    return out


def one(spark, text, adapter="mdx"):
    return read(spark, text, adapter=adapter)[0]


PAGE = """---
title: Guide
tags: [a, b]
---

import Missing from './not-there.js'
export const x = {
  a: '}',

  b: 1,
}

# Heading

Text **bold** and [it][ref].

[ref]: /reference

<Callout title="Mind">

Kept *text*.

```js
const y = <Tag/> // {1}

import z
```

</Callout>

<ZoomImage src="/image.png" alt="A plan" />

<Download href="/sdk (1).zip">Get it</Download>

| field | what |
| --- | --- |
| id | one<br/>two |

- [x] done <b>now</b>

<span>{"static text"}</span> {/* no */}{1_000}{`t`}{true}{null}
"""


def test_a_page_becomes_markdown(spark):
    r = one(spark, PAGE)
    assert (r["title"], r["warnings"], r["error"]) == ("Guide", [], None)
    assert r["markdown"] == (
        "# Heading\n\nText **bold** and [it][ref].\n\n[ref]: /reference\n\n> **Mind**\n>\n> Kept *text*.\n>\n> ```js\n> const y = <Tag/> // {1}\n>\n> import z\n> ```\n\n"
        "![A plan](/image.png)\n\n[Get it](</sdk (1).zip>)\n\n| field | what |\n| --- | --- |\n| id | one two |\n\n- [x] done **now**\n\nstatic text 1000t"
    )


@pytest.mark.parametrize(
    "code",
    [
        "```\n<Callout>no</Callout> &lt; {x + 1}\nimport y\n\n\n\n</b>\n```",
        "~~~~ts\n```\n<a href={b}>\n~~~\n~~~~",
        "`<b>{x}</b>` and ``{` }``",
        "a \\<b> \\{c\\} &lt;d&gt;",
        "- item\n\n  ```\n  <Open>\n  ```",
        "```\nnever closed <b>",
    ],
)
def test_code_and_escapes_come_through(spark, code):
    r = one(spark, f"# T\n\n{code}\n")
    assert r["markdown"] == f"# T\n\n{code}" and r["warnings"] == [] and r["error"] is None


def test_what_is_left_out_leaves_a_warning_where_it_was(spark):
    text = "---\nt: 1\n---\nexport const x = (() => { throw 1 })()\n\n{(() => {\n throw new Error('run')})()}\n\n<ExpandableTable rows={rows()} />\n\n<script>throw 'run' // {</script>\n\ntext {a.b} {[1]}\n\n<Unknown a={1 > 2} b={'}'}>keep</Unknown> <img alt='x'/> <a>link</a> <a href={f()}>other</a>"
    r = one(spark, text)
    assert r["markdown"].split() == ["text", "keep", "link", "other"]
    assert [(w["line"], w["column"]) for w in r["warnings"]] == [(6, 1), (9, 1), (11, 1), (13, 6), (13, 12), (15, 1), (15, 43), (15, 58), (15, 70), (15, 70)]


@pytest.mark.parametrize("text, line, column", [("<Open>", 1, 1), ("a\n\n<b>x</i>", 3, 5), ("x {y", 1, 3), ("<a href='x", 1, 1), ("# T\n\ntext < 5", 3, 6), ("<p>\n</p></p>", 2, 5), ("{a: [1}", 1, 1), ("<a b=>x</a>", 1, 6)])
def test_what_is_no_mdx_is_located(spark, text, line, column):
    r = one(spark, text)
    assert r["markdown"] is None and (r["error"]["line"], r["error"]["column"]) == (line, column) and text not in r["error"]["reason"]


def test_other_documents_arent_held_up_but_ingestion_says_where(spark):
    rows = read(spark, "# Fine", "a\n<Open>", None, "")
    assert [r["markdown"] for r in rows] == ["# Fine", None, None, ""]
    normal = s.normalized(spark.createDataFrame([("a", "ok"), ("b", "x\n\n{")], "document_id string, content string"), "mdx")
    with pytest.raises(TesseraError) as e:
        ingest.readable(normal)
    assert e.value.code == "PARSE_FAILED" and "b:3:1" in str(vars(e.value))


def test_tables_of_tags(spark):
    r = one(spark, "<h1>Top</h1>\n\n<table><thead><tr><th>A</th><th>B|C</th></tr></thead><tbody><tr><td>1\n2</td><td><b>3</b></td></tr>\n<tr><td>4</td></tr></tbody></table>\n\n<details><summary>More</summary>\n\ninner\n</details>")
    assert r["markdown"] == "# Top\n\n| A | B\\|C |\n| --- | --- |\n| 1 2 | **3** |\n| 4 |  |\n\nMore\n\ninner" and r["title"] == "Top" and r["warnings"] == []


def nested(rng, depth):
    row = {"name": rng.choice(["a", "b_c", "漢"])}
    if rng.random() < 0.8:
        row["type"] = rng.choice(["string", "[l](/u)", 3, 1.5, True, None, {"k": [1, "é"]}])
    if depth and rng.random() < 0.7:
        row["children"] = [nested(rng, depth - 1) for _ in range(rng.randrange(3))]
    return row


def flat(rows, parent=""):
    for row in rows:
        path = ".".join(x for x in (parent, row["name"]) if x)
        value = row.get("type")
        shown = "" if value is None else "true" if value is True else json.dumps(value, ensure_ascii=False, separators=(",", ":")) if isinstance(value, dict) else str(value)
        yield f"| `{path}` | {shown} |"
        yield from flat(row.get("children", []), path)


def test_nested_fields_become_rows_with_whole_paths(spark):
    rng = random.Random(2)
    many = [[nested(rng, 4) for _ in range(rng.randrange(4))] for _ in range(40)]
    texts = [f"<ExpandableTable rows={{{json.dumps(rows, ensure_ascii=False)}}}\n columns={{[{{key: 'name', label: `N`}}, {{'key': \"type\", label: 'T',}},]}} />" for rows in many]
    for rows, r in zip(many, read(spark, *texts), strict=True):
        assert r["markdown"].split("\n") == ["| N | T |", "| --- | --- |", *flat(rows)] and r["warnings"] == []
    r = one(spark, '<ExpandableTable rows={[{name: "d", description: <>who<span style={{color: "red"}}>ever</span><br/>{"x"}</>, children: [{name: "e"}]}]} />')
    assert r["markdown"].split("\n")[2:] == ["| `d` |  |  |  | whoever x |  |", "| `d.e` |  |  |  |  |  |"]
    assert one(spark, "<ExpandableTable rows={[{name: 'a', children: 1}]} />")["warnings"][0]["line"] == 1


@pytest.mark.parametrize("text, value", [("'a\\n\\u00e9\\x41\\u{1F600}'", "a\né" + "A😀"), ("-(+2)", -2), ("0x1F", 31), ("1e3", 1000), (".5", 0.5), ("[1, 'b', [null],]", [1, "b", [None]]), ("{a: 1, 'b c': true, 2: {}}", {"a": 1, "b c": True, "2": {}}), ("`x\\`y`", "x`y"), ("/* c */ 1 // d", 1), ("<>a{1}<br/><b>c</b></>", "a1\nc")])
def test_literals_are_read(text, value):
    assert mdx.static_value(text) == value


@pytest.mark.parametrize("text", ["a", "f()", "1 + 1", "`${a}`", "{...a}", "{[a]: 1}", "{a}", "[1,,2]", "a.b", "-'x'", "() => 1", "undefined", "<Other/>", "<b>{f()}</b>", "{a() {}}", "1 2", "[" * 3000])
def test_nothing_else_is(text):
    with pytest.raises(mdx.Dynamic):
        mdx.static_value(text)


def test_html_is_read_as_it_comes(spark):
    text = "<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style></head><body><!-- <h1>no</h1> --><h1>Top</h1><p>one <b>two<p>three {x} 1 < 2<ul><li>a<li><a href=/u>b</a></ul><img src='/i.png'></div>&copy; <custom>x</custom><table><tr><td>1<td>2<tr><td>3</table>"
    r = one(spark, text, "html")
    assert r["error"] is None and r["warnings"] == [] and r["title"] == "Top"
    assert r["markdown"] == "T & U\n\n# Top\n\none **two**\n\nthree {x} 1 < 2\n\n- a\n- [b](/u)\n\n![](/i.png)© x\n\n| 1 | 2 |\n| --- | --- |\n| 3 |  |"


def test_sections_lead_back_to_their_source(spark):
    text = "---\ntitle: t\n---\nimport a from 'b'\n\n# Guide\n\n<Download href=\"/f\">get</Download>\n\n#### Detail\n\ntext\n\n# Plain\n\nas it is\n\n## Table\n\n<ExpandableTable rows={[{name: 'a'}]} />\n"
    docs = spark.createDataFrame([("d", text, "p"), ("e", "# Only", "p")], "document_id string, content string, path string")
    normal = s.normalized(docs, "mdx")
    rows = {r["title"]: r for r in s.with_sources(s.sections(normal), normal).collect()}
    for r in rows.values():
        whole = "# Only" if r["document_id"] == "e" else text
        assert r["source"] == whole[r["source_start"] : r["source_stop"]]
    assert rows["Guide"]["source"].strip() == text[text.index("# Guide") : text.index("# Plain")].strip() and not rows["Guide"]["exact"] and "<Download" not in rows["Guide"]["markdown"]
    assert rows["Plain"]["source"].strip() == "# Plain\n\nas it is" and rows["Plain"]["exact"] and rows["Only"]["exact"]
    assert rows["Table"]["source"].startswith("## Table") and rows["Table"]["source"].rstrip().endswith("/>")


def test_a_change_elsewhere_changes_what_depends_on_it(spark):
    make = lambda url, field="v1", below="x": f"---\nproduct: {field}\n---\n# A\n\n[help][ref] and[^n]\n\n# B\n\n{below}\n\n[ref]: {url}\n\n[^n]: see [ref]\n\n# C\n\nother"
    texts = {"same": make("/old"), "url": make("/new"), "field": make("/old", "v2"), "below": make("/old", below="y")}
    normal = s.normalized(spark.createDataFrame([(k, t, "p") for k, t in texts.items()], "document_id string, content string, path string"), "mdx")
    rows = ingest.section_rows(normal).withColumn("document_id", F.lit("d"))
    got = {}
    for r in s.section_revision(rows.drop("revision")).join(ingest.section_rows(normal).select("id", F.col("document_id").alias("which")), "id").collect():
        got.setdefault(r["which"], {})[r["title"]] = r["revision"]
    base = got["same"]
    assert {k: sorted(t for t in base if got[k][t] != base[t]) for k in texts} == {"same": [], "url": ["A", "B"], "field": ["A", "B", "C"], "below": ["B"]}
