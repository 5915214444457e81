"""Sections, blocks, chunks and links of documents put together from blocks that are known, and of pages."""

import random
from typing import NamedTuple

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tessera.functions.canon import content_hash
from tessera.operators import indexing, search
from tessera.operators import sections as s


class Made(NamedTuple):
    """A block of a made document: what it is, how it is written, and, of headings, depth and title."""

    kind: str
    text: str
    depth: int = 0
    title: str | None = None


def made_block(rng, before):
    """A block that may stand after one of kind ``before``, with an empty line between."""
    word = lambda: rng.choice(["atlas", "gateway", "port", "漢字", "a_b", "x.", "1st", "été"])
    line = lambda: "w" + " ".join(word() for _ in range(rng.randrange(1, 7)))
    title, n = rng.choice(["A", "B", "C#", "D `#`", "A"]), rng.randrange(1, 7)
    many = [
        Made("heading", " " * (0 if before in ("list", "footnote") else rng.randrange(4)) + "#" * n + " " + title + rng.choice(["", " #", "  ###  "]), n, title),
        Made("heading", "#" * n, n, ""),
        Made("heading", f"{title}\n{rng.choice(['=', '===', '====  '])}", 1, title),
        Made("heading", f"{line()}\n{title}\n{rng.choice(['-', '---'])}", 2, None),
        *[Made("text", "\n".join(line() for _ in range(rng.randrange(1, 4))))] * 4,
        Made("text", f"{line()}\n    # not code, and no heading\n#nor this"),
        Made("code", f"```md\n# no\n\n## none\n{line()}\n```"),
        Made("code", "~~~\n```\n# no\n\nTitle\n=====\n~~~"),
        Made("code", "````\n```\n# no\n```\n[l](u)\n`````"),
        Made("html", "<!--\n# hidden\n\n## more\n-->"),
        Made("html", "<div>\n# in a tag\n</div>"),
        Made("quote", f"> # in a quote\n> {line()}\n{line()}"),
        Made("quote", "> ```\n> # no\n> ```\n>\n> - > ## deep"),
        Made("table", "| a | b\\|c |\n|---|:-:|\n| # d | `e` |"),
        Made("table", "a | b\n:- | -\nc | d"),
        Made("rule", rng.choice(["***", "- - -", "_____"])),
        Made("definition", f"[r{rng.randrange(10**9)}]:\n  /next 'a\n  title'"),
        Made("footnote", f"[^n{rng.randrange(10**9)}]: {line()}\n    more\n\n    # in a note"),
    ]
    if before not in ("list", "footnote"):
        many += [Made("list", "- one\n  # in an item\n\n  more\n- two\nlazy"), Made("list", "1. a\n2. b\n   ## deep\n\n       code"), Made("list", "* # an item that is a heading\n*\n* last")]
        many += [Made("code", "    # code\n\n      more")] * (before != "code")
    return rng.choice(many)


def made_document(rng):
    blocks = []
    for _ in range(rng.randrange(14)):
        blocks.append(made_block(rng, blocks[-1].kind if blocks else ""))
    return [b._replace(title=b.text.rsplit("\n", 1)[0]) if b.kind == "heading" and b.title is None else b for b in blocks]


def sections_by_hand(document, blocks):
    """What is known of a document's sections, and their blocks."""
    text = "\n\n".join(b.text for b in blocks)
    parts, at = [[0, None, 0, []]], 0
    for b in blocks:
        if b.kind == "heading" and b.depth <= 3:
            parts.append([b.depth, b.title, at, []])
        parts[-1][3].append(b)
        at += len(b.text) + 2
    out, open_, seen = [], [], {}
    for k, (depth, title, start, held) in enumerate(parts):
        if not held:
            continue
        end = parts[k + 1][2] if k + 1 < len(parts) else len(text)
        open_ = [o for o in open_ if o[0] < depth]
        name = (tuple(o[1] for o in open_), depth, title)
        nth = seen[name] = seen.get(name, -1) + 1
        own = "section-" + content_hash([document, [o[1] for o in open_], depth, title, nth])
        path = [o[2] for o in open_] + ([title] if depth else [])
        out.append(((len(out), own, open_[-1][1] if open_ else None, depth, title, path, nth, text[:start].count("\n"), start, end, text[start:end].rstrip() if held[0].kind == "code" else text[start:end].strip()), held))
        if depth:
            open_.append((depth, own, title))
    return out


def chunks_by_hand(blocks, limit, overlap):
    """Texts of chunks, tokens being characters; for sections whose blocks all fit alone, or can't be cut."""
    heading = [blocks[0][1]] if blocks and blocks[0][0] == "heading" else []
    parts = [t for _, t in blocks[len(heading) :]]
    size = lambda ps: len("\n\n".join([*heading, *ps]))
    if heading and len(heading[0]) > limit:
        return ["\n\n".join([*heading, *parts])]
    out, now = [], []
    for part in parts:
        if size([part]) > limit:
            out += [now, [part]] if now else [[part]]
            now = []
            continue
        if now and size([*now, part]) > limit:
            out.append(now)
            carried = []
            for old in reversed(now):
                if len("\n\n".join([old, *carried])) > overlap or size([old, *carried, part]) > limit:
                    break
                carried = [old, *carried]
            now = carried
        now = [*now, part]
    if now or not out:
        out.append(now)
    return ["\n\n".join([*heading, *ps]).rstrip() for ps in out]


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(8)
    return {f"d{i}": made_document(rng) for i in range(300)} | {"empty": [], "long": [Made("heading", "# T", 1, "T"), Made("text", "word " * 20_000 + "end")]}


@pytest.fixture(scope="module")
def split(spark, documents):
    rows = [(k, "\n\n".join(b.text for b in blocks)) for k, blocks in documents.items()]
    df = spark.createDataFrame([*rows, ("none", None), ("blank", " \n\n")], "document_id string, markdown string")
    out = s.sections(df).toPandas()
    return out, spark.createDataFrame(out[["document_id", "id", "title", "markdown"]])


def test_sections(documents, split):
    got = {}
    for r in split[0].itertuples(index=False):
        got.setdefault(r.document_id, []).append((r.index, r.id, r.parent_id if isinstance(r.parent_id, str) else None, r.depth, None if r.depth == 0 else r.title, list(r.heading_path), r.occurrence, r.first_line, r.start_offset, r.end_offset, r.markdown))
    n = 0
    for document, blocks in documents.items():
        want = [x for x, _ in sections_by_hand(document, blocks)]
        assert sorted(got.pop(document, [])) == want, "\n\n".join(b.text for b in blocks)
        n += len(want)
    assert n > 400 and not got


def test_blocks(documents, split):
    got = {}
    for r in s.blocks(split[1]).collect():
        got.setdefault(r["id"], []).append((r["block_index"], r["kind"], r["text"].strip(" \t")))
    for document, blocks in documents.items():
        for x, held in sections_by_hand(document, blocks):
            assert [y[1:] for y in sorted(got[x[1]])] == [(b.kind, b.text.strip(" \t")) for b in held], x[-1]


@pytest.mark.parametrize("limit, overlap", [(120, 0), (120, 40), (60, 30), (2000, 0)])
def test_chunks(documents, split, limit, overlap):
    """Sections with blocks that would be cut are left to the tests of cutting."""
    kept = {}
    for document, blocks in documents.items():
        for x, held in sections_by_hand(document, blocks):
            pairs = [(b.kind, b.text.rstrip() if k or b.kind == "code" else b.text.strip()) for k, b in enumerate(held) if b.kind not in ("definition", "footnote")]
            head = len(pairs[0][1]) + 2 if pairs and pairs[0][0] == "heading" else 0
            if pairs and all(kind in ("quote", "heading", "html", "rule") or head + len(text) <= limit for kind, text in pairs):
                kept[x[1]] = pairs
    got = {}
    for r in s.chunks(split[1].where("length(markdown) < 5000"), limit, overlap, tokens=len).where(F.col("section_id").isin(list(kept))).collect():
        got.setdefault(r["section_id"], []).append((r["index"], r["markdown"].lstrip(), r["previous_chunk_id"], r["next_chunk_id"], r["token_count"], r["oversized"]))
    assert len(kept) > 100
    for key, pairs in kept.items():
        rows, want = sorted(got[key]), chunks_by_hand(pairs, limit, overlap)
        assert [x[1] for x in rows] == [w.lstrip() for w in want], pairs
        assert [x[2] for x in rows] == [None, *(f"{key}#chunk-{i}" for i in range(len(want) - 1))]
        assert [x[3] for x in rows] == [*(f"{key}#chunk-{i}" for i in range(1, len(want))), None]
        assert [x[4:] for x in rows] == [(len(w), len(w) > limit) for w in want]


def test_pages_are_taken_up_whole(spark):
    pages = spark.read.parquet(f"{driver.SMALLEST}/pages.parquet").select(F.concat(F.lit("p"), "page_id").alias("document_id"), F.col("html").alias("content"))
    normal = s.normalized(pages, "html")
    texts = {r["document_id"]: r["markdown"] for r in normal.collect()}
    got = {}
    for r in s.sections(normal).collect():
        got.setdefault(r["document_id"], []).append(r)
    assert set(got) == set(texts) and len(got) > 40
    for key, rows in got.items():
        rows.sort(key=lambda r: r["index"])
        assert [r["start_offset"] for r in rows[1:]] == [r["end_offset"] for r in rows[:-1]] and rows[-1]["end_offset"] == len(texts[key])
        assert all(texts[key][r["start_offset"] : r["end_offset"]].strip() == r["markdown"] for r in rows)
        assert not any("<script" in r["markdown"] or "</p>" in r["markdown"] for r in rows)


LINKED = [
    ("[a](b)", [("link", "a", "b", "")]),
    ("`[a](b)` ``[c` (d)`` [e](<f g>)", [("link", "e", "f g", "")]),
    ("[h](i(j)) ![k *l*](m 'n')", [("link", "h", "i(j)", ""), ("image", "k l", "m", "n")]),
    ("\\[no](x) [yes](y\\)z)", [("link", "yes", "y)z", "")]),
    ("[o [p](q) r](s)", [("link", "p", "q", "")]),
    ("[![i](j)](k)", [("link", "i", "k", ""), ("image", "i", "j", "")]),
    ("[R][ Ref  A] [ref a] [ref A][] [other] ![x][ref a]", [("link", "R", "/ref", "t"), ("link", "ref a", "/ref", "t"), ("link", "ref A", "/ref", "t"), ("image", "x", "/ref", "t")]),
    ("<https://z.example> <a@b.example>", [("link", "https://z.example", "https://z.example", ""), ("link", "a@b.example", "mailto:a@b.example", "")]),
    ("```\n[a](b)\n```\n\n    [c](d)\n\n<!-- [e](f) -->\n\n- [g](h) [g](h)\n\n> | [i](j) |\n> |---|\n> | [k](l) |", [("link", "g", "h", ""), ("link", "i", "j", ""), ("link", "k", "l", "")]),
]


def test_links(spark):
    rows = [(i, f"{text}\n\n[ref A]: /ref 't'\n[REF a]: /second\n") for i, (text, _) in enumerate(LINKED)]
    got = spark.createDataFrame(rows, "i int, m string").select("i", s.links(F.col("m")).alias("links")).collect()
    assert {r["i"]: [tuple(x) for x in r["links"]] for r in got} == {i: want for i, (_, want) in enumerate(LINKED)}


def test_plain_text_and_code(spark):
    text = "# T *e* `c`\n\n```py\n# comment\n**x** | y\n```\n\n~~~ sh x=1\n```\n~~~\n\n````\n```\n````\n\n| a | b |\n|---|---|\n| [c](d) | e\\|f |\n\n- one\n- two\n\n[x]: /y\n\n![alt](i) **b _c_** a_b_c \\*d\\* [y][x]\n    last"
    row = spark.createDataFrame([(text,)], "m string").select(s.plain_text(F.col("m")), s.code_blocks(F.col("m"))).first()
    assert row[0] == "T e c\n\n# comment\n**x** | y\n\n```\n\n```\n\na\tb\n\nc\te|f\n\none\n\ntwo\n\n\n\nalt b c a_b_c *d* y\nlast"
    assert [tuple(x) for x in row[1]] == [("py", "", "# comment\n**x** | y"), ("sh", "x=1", "```"), ("", "", "```")]


def test_no_shuffle_from_documents_to_chunks(spark):
    df = spark.createDataFrame([("d", "# T")], "document_id string, markdown string")
    plan = s.chunks(s.section_revision(s.sections(df)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and len(plan) < 60_000


def test_term_hashes_are_polynomials():
    """One running sum gives what each term's own polynomial gives."""
    mask = (1 << 64) - 1

    def own(term, plus):
        h = sum((ord(c) + 1) * pow(int(indexing._BASE), i, 1 << 64) for i, c in enumerate(term)) + plus & mask
        h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & mask
        return h ^ (h >> 29)

    for text in ("", "a", "Ab cd", "  été 漢字　x ", "😀 y" * 50):
        low = text.lower()
        want = sorted([own(w, 7) for w in low.split()] + [own(low[i : i + 3], 0) for i in range(len(low) - 2)])
        got, n_words = indexing.term_hashes(text)
        assert sorted(got.tolist()) == want and n_words == len(low.split())


def test_citations_in_code_and_links_are_text(spark):
    text = "As [S1] says [see [S2]](u) `[S3]` and [S4][S5].\n\n```\n[S6]\n```\n\n- item [S7]\n  ~~~\n  [S8]\n  ~~~\n"
    rows = spark.createDataFrame([(text,), (None,), ("",), ("[S1]",)], "t string").select("t", search.answer_segments(F.col("t")).alias("s")).collect()
    got = {r["t"]: r["s"] for r in rows}
    assert [x["value"] for x in got[text] if x["type"] == "citation"] == ["[S1]", "[S4]", "[S5]", "[S7]"]
    assert "".join(x["value"] for x in got[text]) == text and got[None] is None and got[""] == [] and [tuple(x) for x in got["[S1]"]] == [("citation", "[S1]")]
