"""Fill-in-the-middle transformation with counted quantifiers of one regular expression.

A text is a row of units (a word with the white space before it, or white space at the end). Their
count gives n, the document's hash two cuts a <= b among them, and a pattern of the row's own,
``(unit{a})(unit{b - a})(rest)`` with possessive quantifiers, captures prefix, middle and suffix in one
match, whose replacement is the transformed text. Units can't match in two ways, so nothing is ever
tried again, and the engine repeats a possessive group in a loop: time is linear in the text, and the
stack doesn't grow with it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import TesseraError
from tessera.llm.shared import SPACE, WORD, table, text_or_empty

#: A unit: what separates words and words have no character in common, so each part takes all it can.
UNIT = rf"[{SPACE}]*+{WORD}+|[{SPACE}]++"


class Marks(NamedTuple):
    """What stands before each part of a transformed text. Texts that hold a mark stay plain."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def _checked(marks: Marks) -> Marks:
    """Marks that can be told apart wherever they stand: none overlaps itself or another."""
    for a in marks:
        if not a or sum(a in b for b in marks) > 1 or any(a.endswith(b[:k]) for b in marks for k in range(1, len(b))) or "$" in a or "\\" in a:
            raise TesseraError("INVALID_OPTIONS", f"mark {a!r} can't be told apart from the others")
    return marks


def _draws(seed: int) -> list[Column]:
    """Four unsigned 32-bit integers of a document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_share: int = 80, marks: Marks = Marks()) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n (units), form, prefix_chars, middle_chars, output.

    ``rate`` per cent of the documents are transformed, ``spm_share`` of these to suffix, prefix, middle
    (spm), the others to prefix, suffix, middle (psm); plain ones are the text itself. Both cuts are drawn
    from the n + 1 places between units, so any part may be empty. All is drawn from the seed and the
    doc_id: rows that repeat agree, and a null doc_id draws as an empty one. Null texts count as empty;
    empty texts and those that hold a mark are plain, with null prefix_chars and middle_chars (in code
    points otherwise). Other columns of ``docs`` aren't looked at.
    """
    marks = _checked(marks)
    df = docs.select("doc_id", text_or_empty().alias("t"), F.array(*_draws(seed)).alias("h"))
    df = df.withColumn("n", F.regexp_count("t", F.lit(UNIT)).cast("bigint"))
    cuts = [F.get("h", F.lit(k)) % (F.col("n") + 1) for k in (0, 1)]
    held = F.contains("t", F.lit(marks.prefix)) | F.contains("t", F.lit(marks.suffix)) | F.contains("t", F.lit(marks.middle))
    plain = (F.col("n") == 0) | held | (F.get("h", F.lit(2)) % 100 >= rate)
    form = F.when(plain, "plain").when(F.get("h", F.lit(3)) % 100 < spm_share, "spm").otherwise("psm")
    df = df.select("doc_id", "t", "n", form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))
    units = lambda count: F.concat(F.lit(f"((?:{UNIT}){{"), count.cast("string"), F.lit("}+)"))
    df = df.withColumn("pattern", F.concat(F.lit(r"(?s)\A"), units(F.col("a")), units(F.col("b") - F.col("a")), F.lit("(.*+)")))
    put = {"spm": f"{marks.suffix}$3{marks.prefix}$1{marks.middle}$2", "psm": f"{marks.prefix}$1{marks.suffix}$3{marks.middle}$2"}
    changed = F.regexp_replace("t", F.col("pattern"), F.when(F.col("form") == "spm", put["spm"]).otherwise(put["psm"]))
    df = df.select("doc_id", "n", "form", F.when(F.col("form") == "plain", F.col("t")).otherwise(changed).alias("output"))
    df = df.withColumn("parts", parts(F.col("output"), F.col("form"), marks))
    return df.select("doc_id", "n", "form", F.char_length("parts.prefix").cast("bigint").alias("prefix_chars"), F.char_length("parts.middle").cast("bigint").alias("middle_chars"), "output")


def parts(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """prefix, middle and suffix of a transformed text, told by its form; null for plain ones."""
    p, s, m = marks
    # The marks are in no part, and none overlaps another, so each is found where it was put.
    first, second = F.when(form == "spm", s).otherwise(p), F.when(form == "spm", p).otherwise(s)
    head = F.substring_index(output, m, 1)
    one = F.substr(head, F.char_length(first) + 1)
    return F.when(form == "plain", F.lit(None)).otherwise(
        F.struct(
            F.when(form == "spm", F.split_part(one, second, F.lit(2))).otherwise(F.split_part(one, second, F.lit(1))).alias("prefix"),
            F.substr(output, F.char_length(head) + F.lit(len(m) + 1)).alias("middle"),
            F.when(form == "spm", F.split_part(one, second, F.lit(1))).otherwise(F.split_part(one, second, F.lit(2))).alias("suffix"),
        )
    )


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that ``output`` was made of."""
    found = parts(output, form, marks)
    return F.when(form == "plain", output).otherwise(F.concat(found["prefix"], found["middle"], found["suffix"]))


ORACLE_SQL = r"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::varchar, '')) AS d FROM documents),
units AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, len(u)::bigint AS n,
    [('0x' || d[1 + 8 * k : 8 + 8 * k])::bigint FOR k IN range(4)] AS h FROM drawn),
cut AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT doc_id, t, n, form, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 : n], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::bigint AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::bigint AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""


def op11_fill_in_middle(spark, sf_dir):
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
