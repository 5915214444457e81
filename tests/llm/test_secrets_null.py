"""The battery's null and recall, and the patterns against a scanner that goes character by character."""

import hashlib
import random
import re
import string
from collections import Counter

import pytest

from tessera.llm import secrets

ENCODINGS = {
    "base62": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/",
    "base64url": string.ascii_letters + string.digits + "-_",
    "base32": string.ascii_uppercase + "234567",
    "upper hex": "0123456789ABCDEF",
    "base36": string.ascii_lowercase + string.digits,
}


def tokens(rng, alphabet, n, count):
    drawn = ("".join(rng.choice(alphabet) for _ in range(n)) for _ in range(10 * count))
    return [t for t in drawn if secrets._mixes(t)][:count]


@pytest.mark.parametrize("n, least", [(20, 0.6), (24, 0.8), (32, 0.85), (40, 0.95), (64, 0.95), (80, 0.95)])
def test_recall_by_length_and_encoding(n, least):
    """100 random tokens of each encoding among 900 joined words, which stay within the false share, about."""
    rng = random.Random(n)
    plain = Counter(secrets._cell(secrets._joined(rng.choices(secrets.COMMON, k=40), n, i % secrets.SHAPES)) for i in range(900))
    found = {name: [secrets._cell(t) for t in tokens(rng, alphabet, n, 100)] for name, alphabet in ENCODINGS.items()}
    reported = set(secrets.reported_cells(plain + Counter(c for cells in found.values() for c in cells), secrets.common_cells()))
    recall = {name: sum(c in reported for c in cells) / len(cells) for name, cells in found.items()}
    assert min(recall.values()) >= least, recall
    assert sum(k for c, k in plain.items() if c in reported) <= 0.1 * 900


def test_words_alone_are_not_reported():
    rng = random.Random(9)
    plain = Counter(secrets._cell(secrets._joined(rng.choices(secrets.COMMON, k=40), n, i % secrets.SHAPES)) for n in (20, 23, 30, 50) for i in range(300))
    reported = set(secrets.reported_cells(plain, secrets.common_cells()))
    assert sum(k for c, k in plain.items() if c in reported) <= 0.02 * sum(plain.values())


def test_every_cell_has_a_null():
    """Each length class and manner has simulated words, whatever the corpus."""
    per = Counter(c // (secrets.LEVELS + 1) for c in secrets.common_cells().elements())
    assert set(per) == set(range(len(secrets.LENGTHS) * secrets.MANNERS)) and min(per.values()) >= 500


def scan(text):
    """Base spans by hand: what each kind's next match is, from each place on."""
    spans, names = [], ("password", "passwd", "secret", "token", "apikey", "api_key")
    value = set(string.ascii_letters + string.digits + "+/_.=-")
    i = 0
    while i < len(text):
        name = next((n for n in names if text[i : i + len(n)].isascii() and text[i : i + len(n)].lower() == n), None)
        if name is None:
            i += 1
            continue
        j = i + len(name)
        j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
        while text[j : j + 1] == " ":
            j += 1
        if text[j : j + 1] not in (":", "="):
            i += 1
            continue
        j += 1
        while text[j : j + 1] == " ":
            j += 1
        j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
        k = j
        while k < len(text) and text[k] in value:
            k += 1
        if k == j:
            i += 1
            continue
        if k - j >= 12:
            spans.append((i, "assign", k))
        i = k
    for kind, head, chars, least in (("access", "AKIA", set(string.ascii_uppercase + string.digits), 18), ("hex", "", set("0123456789abcdef"), 16)):
        i = 0
        while i < len(text):
            k = i + len(head)
            while k < len(text) and text[k] in chars:
                k += 1
            if text[i : i + len(head)] == head and k > i + len(head):
                if k - i >= least:
                    spans.append((i, kind, k))
                i = k
            else:
                i += 1
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(spans, key=lambda s: (s[0], order[s[1]]))


def test_base_spans_on_random_texts(spark, frame):
    rng = random.Random(4)
    pieces = ["password", "PassWd", "secret", "token", "api_key", "apikey", "API_KEY", "'", '"', " ", "  ", ":", "=", "AKIA", "AKIAAKIA", "abc123def456", "ABCDEFGH12345678", "x/y+z.w=", "é", "ſecret", "\n", "0123456789abcdef", "Q", "tokentoken=", "abcdefabcdefabcd"]
    rows = [(i if i % 7 else None, "".join(rng.choice(pieces) for _ in range(rng.randrange(40))), "s") for i in range(400)]
    got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.scan_secrets(frame(rows)).collect())
    want = Counter()
    for i, text, _ in rows:
        spans = scan(text)
        counts = Counter(k for _, k, _ in spans)
        want[(i, counts["assign"], counts["access"], counts["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in spans).encode()).hexdigest())] += 1
    assert got == want and any(k[1] and k[0] is None for k in want)


def test_tokens_are_reported_in_documents(frame):
    """Keys of each encoding in texts of long words, texts without long words, and rows without an id."""
    rng = random.Random(6)
    keys = [t for alphabet in ENCODINGS.values() for t in tokens(rng, alphabet, 40, 5)]
    rows = [(None if i % 5 == 0 else i, f"see {key} there", "s") for i, key in enumerate(keys)] + [(1000 + i, "a b c d " * 5, "s") for i in range(50)]
    got = [r["spans"] for r in secrets.scan_secrets(frame(rows)).where("spans <> ''").collect()]
    assert sum(bool(re.search("random:4:44", s)) for s in got) >= 0.9 * len(keys)
    assert all(s == "random:4:44" for s in got)


@pytest.mark.parametrize("n, least", [(20, 0.6), (24, 0.75), (32, 0.85)])
def test_recall_of_planted_tokens_by_length(frame, n, least):
    """Short keys in documents, as many as joined words that look like keys; what is found of either."""
    rng = random.Random(n)
    keys = [t for alphabet in ENCODINGS.values() for t in tokens(rng, alphabet, n, 20)]
    plain = [t for i in range(400) if secrets._mixes(t := secrets._joined(rng.choices(secrets.COMMON, k=40), n, i % secrets.SHAPES))][: len(keys)]
    rows = [(i, f"see {x} there", "s") for i, x in enumerate([*keys, *plain])]
    hit = {r["doc_id"] for r in secrets.scan_secrets(frame(rows)).where("spans LIKE '%random:4:%'").select("doc_id").collect()}
    assert sum(i in hit for i in range(len(keys))) >= least * len(keys)
    assert sum(i >= len(keys) for i in hit) <= 0.1 * len(plain) and len(plain) > 50


def test_joinings_go_through_whole_texts():
    words = [f"{a}{b}" for a in "abcdefgh" for b in "ijklmnopqrstuvwx" for _ in range(8)]
    first, whole = secrets.joined_cells(iter(words), 5), secrets.all_joined_cells(iter(words), 5)
    assert whole[: len(first)] == first and len(whole) > 4 * len(first)
    assert secrets.all_joined_cells(iter(words), 5) != secrets.all_joined_cells(iter([*words[:-900], *reversed(words[-900:])]), 5)
    assert secrets.all_joined_cells(iter([]), 5) == []
