"""Canonical JSON, content hashes and identities, as columns and for driver-side values."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that trimming removes: white space and line ends of ECMAScript.
TRIMMED = r"[\t\n\x0B\f\r \xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def canonical_json(value: Any) -> str:
    """Keys sorted, no spaces, non-ASCII characters as they are; array order kept."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def content_hash(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def json_string(value: Column) -> Column:
    """A string as JSON, null as null."""
    # A one-field object less its braces and key; to_json leaves non-ASCII characters as they are.
    whole = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), F.lit("null")).otherwise(whole.substr(F.lit(6), F.length(whole) - 6))


def json_strings(values: Column) -> Column:
    """An array of strings as JSON."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, json_string), ","), F.lit("]"))


def json_array(*parts: Column) -> Column:
    """JSON text of an array whose members are given as JSON text."""
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def hashed(json_text: Column) -> Column:
    return F.sha2(json_text, 256)


def index_id(knowledge_base: Column, kind: Column, source_id: Column) -> Column:
    return F.concat(F.lit("index-"), hashed(json_array(json_string(knowledge_base), json_string(kind), json_string(source_id))))


def text_revision(text: Column) -> Column:
    return hashed(json_array(F.lit("1"), json_string(text)))


def edge_id(source: Column, target: Column, kind: Column, description: Column) -> Column:
    return F.concat(F.lit("wiki-edge-"), hashed(json_array(*map(json_string, (source, target, kind, description)))))


def node_id(knowledge_base: Column, section: Column, revision: Column, local: Column, canonical: Column) -> Column:
    """Of a local node, or of the canonical node it is mapped to where there is one."""
    own = json_array(F.lit('"local"'), json_string(section), json_string(revision), json_string(local))
    mapped = json_array(F.lit('"canonical"'), json_string(canonical))
    identity = F.when(canonical.isNull(), own).otherwise(mapped)
    return F.concat(F.lit("wiki-node-"), hashed(json_array(json_string(knowledge_base), identity)))


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, rf"^{TRIMMED}+|{TRIMMED}+$", "")


def is_blank(value: Column) -> Column:
    return value.isNull() | (F.length(trimmed(value)) == 0)


def utf16_length(value: Column) -> Column:
    """Length in UTF-16 units: code points, and one more for each supplementary one."""
    return F.length(value) + F.regexp_count(value, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def sorted_unique(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def iso_utc(ts: Column) -> Column:
    """Milliseconds, UTC; the session's time zone is taken to be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
