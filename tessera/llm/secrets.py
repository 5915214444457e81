"""Secret scans: patterns, and a randomness test battery with control of false discoveries.

Patterns find assignments, access keys and hex strings. Other tokens that mix character classes are
read as symbols of the encoding that they seem to be in and tested for uniformity (chi-squared, over
bins of symbols that are about as common in prose), runs and serial correlation (in the order of the
alphabet); the three are combined into one level of randomness, which for random tokens of any length and encoding is spread evenly from 0 to
1. A level's p-value is how often plain words of that length, written in that encoding's manner, look
as random: words that are simulated from a fixed list, so that each cell has a null at every corpus
size, and the corpus' own. Within each length class and manner as many tokens are reported as keep the
expected share of false ones (Benjamini-Hochberg) under a bound. The counts that this takes are a fixed
number of cells, summed over all documents. Tasks test their tokens many at a time, as arrays.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialize, table

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_WORD = re.compile(r"[A-Za-z][a-z]+")
#: Whole tokens that are plain words.
_PLAIN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z][a-z]+(?![A-Za-z0-9+/_=-])")
MIN_ASSIGNED, MIN_ACCESS = 12, 18
#: Length classes start at these; levels of randomness are 0 to LEVELS.
LENGTHS = (20, 22, 24, 28, 32, 40, 48, 64)
LEVELS = 400
#: The most of the reported tokens that may be expected to be false, per length class.
FALSE_SHARE = 0.05
#: Words that are joined to the lengths of each class, so many times a class and manner.
COMMON = "about after again because before between children country different every example family follow government house important language letter might mountain never other people picture place point question school sentence should something started story thought through together under while without world write young aber auch einer haben nicht werden zwischen jeder avec cette comme dans elle entre leurs toujours vous ahora como cuando desde donde entonces mientras nosotros porque siempre también".replace("é", "e").split()
JOINED = 1_500
#: Letters by how common they are in prose, about: plain words crowd at the front of an alphabet.
_LOWER = "etaoinshrdlcumwfgypbvkjxqz"
_UPPER, _DIGITS = _LOWER.upper(), "0123456789"
#: Encodings by alphabet, the narrowest first.
ALPHABETS = (_DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _UPPER + "234567", _LOWER, _LOWER + _DIGITS, _UPPER + _DIGITS, _LOWER + _UPPER, _LOWER + _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS + "+/_-")
#: Manners of writing a token: one case with digits, both cases, with other signs.
MANNERS = 3
#: Characters of tokens that are tested at a time.
PART = 1 << 18


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By ASCII code: bits of what a character is (bit k: not in alphabet k; then lower case, upper case, another sign), and
    for each alphabet its places by how common symbols are, and by code."""
    bits, (common, coded) = np.zeros(128, np.int16), np.zeros((2, len(ALPHABETS) + 1, 128), np.int16)
    for c in map(chr, range(128)):
        bits[ord(c)] = sum(1 << k for k, a in enumerate(ALPHABETS) if c not in a) | c.islower() << len(ALPHABETS) | c.isupper() << len(ALPHABETS) + 1 | (not c.isalnum()) << len(ALPHABETS) + 2
    for k, a in enumerate(ALPHABETS):
        for places, symbols in ((common, a), (coded, "".join(sorted(a)))):
            places[k, [ord(c) for c in symbols]] = range(len(a))
    return bits, common, coded


_BITS, _COMMON, _CODED = _tables()
_LOWER_BIT, _UPPER_BIT, _SIGN_BIT = (1 << len(ALPHABETS) + i for i in range(3))
#: By the bits of alphabets that lack a token's symbols: the first that has them all, or one after the last.
_NARROWEST = np.array([next((k for k in range(len(ALPHABETS)) if not lacking >> k & 1), len(ALPHABETS)) for lacking in range(1 << len(ALPHABETS))])
_SIZES = np.array([*map(len, ALPHABETS), 0], np.int16)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of what the patterns find, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _tail(z: np.ndarray) -> np.ndarray:
    """The normal distribution's share beyond z, twice."""
    return np.array(list(map(math.erfc, (z / math.sqrt(2)).tolist())))


class _Symbols:
    """Many tokens' symbols, one after the other, and what the tests take of them; at least one symbol a token."""

    def __init__(self, tokens: list[str]):
        self.n = np.array(list(map(len, tokens)))
        self.ends = np.cumsum(self.n)
        self.starts = self.ends - self.n
        self.of = np.repeat(np.arange(len(tokens), dtype=np.int32), self.n)
        flat = np.frombuffer("".join(tokens).encode("ascii"), np.uint8)
        self.bits = np.bitwise_or.reduceat(_BITS[flat], self.starts)
        alphabet = _NARROWEST[self.bits & len(_NARROWEST) - 1]
        self.size = _SIZES[alphabet]
        self.common, self.coded = (places[alphabet[self.of], flat] for places in (_COMMON, _CODED))
        if not self.size.all():
            # Tokens beyond all alphabets: their own symbols are one.
            at = np.flatnonzero(self.size[self.of] == 0)
            token, row = np.unique(self.of[at], return_inverse=True)
            there = np.zeros((len(token), 128), bool)
            there[row, flat[at]] = True
            self.size[token] = there.sum(1)
            self.common[at] = self.coded[at] = (np.cumsum(there, 1) - 1)[row, flat[at]]

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts, dtype=np.int64)

    def counts(self, values: np.ndarray, most: int) -> np.ndarray:
        """How many of each token's symbols have each value under ``most``."""
        return np.bincount(self.of * most + values, minlength=len(self.n) * most).reshape(-1, most)

    def chi_squared_p(self) -> np.ndarray:
        """Uniformity over the alphabet, in as many bins as leave three symbols each."""
        bins = np.maximum(2, np.minimum(self.size, self.n // 3)).astype(np.int16)
        most = int(bins.max())
        edges = -(-np.arange(most + 1) * self.size[:, None] // bins[:, None])
        expected = self.n[:, None] * np.diff(edges) / self.size[:, None]
        apart = self.counts(self.common * bins[self.of] // self.size[self.of], most) - expected
        chi = np.where(np.arange(most) < bins[:, None], apart * apart / expected, 0).sum(1)
        dof = bins - 1
        # Wilson and Hilferty's cube root; one-sided.
        return _tail(((chi / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / np.sqrt(2 / (9 * dof))) / 2

    def runs_p(self) -> np.ndarray:
        """Wald and Wolfowitz's runs above and below the median, two-sided."""
        up_to = np.cumsum(self.counts(self.coded, int(self.size.max())), 1)
        twice_median = sum((up_to <= k[:, None]).sum(1) for k in ((self.n - 1) // 2, self.n // 2)).astype(np.int16)
        above = 2 * self.coded > twice_median[self.of]
        turns = np.diff(above, prepend=False)
        turns[self.starts] = False
        a = self.sums(above)
        b, runs = self.n - a, 1 + self.sums(turns)
        mean = 1 + 2 * a * b / self.n
        variance = (mean - 1) * (mean - 2) / (self.n - 1)
        p = np.where(variance > 0, _tail(np.abs(runs - mean) / np.sqrt(variance)), 1)
        return np.where(a * b > 0, p, 0)

    def serial_p(self) -> np.ndarray:
        """Correlation of neighbours, two-sided."""
        n, next_to = self.n.astype(float), self.coded.copy()
        next_to[:-1] *= self.coded[1:]
        next_to[self.ends - 1] = 0
        total, squares, products = (self.sums(x).astype(float) for x in (self.coded, self.coded**2, next_to))
        spread = n * squares - total * total
        inner = 2 * total - self.coded[self.starts] - self.coded[self.ends - 1]
        r = (n * n * products - n * total * inner + (n - 1) * total * total) / (n * spread)
        return np.where(spread > 0, _tail(np.abs(r + 1 / n) * np.sqrt(n)), 0)

    def levels(self) -> np.ndarray:
        """0 (nothing random about it) to LEVELS: Fisher's combination of the three tests' p-values."""
        with np.errstate(all="ignore"):  # what a test doesn't hold for is set aside at its end
            x = -sum(np.log(np.maximum(p, 1e-300)) for p in (self.chi_squared_p(), self.runs_p(), self.serial_p()))
            level = LEVELS * np.exp(-x) * (1 + x + x * x / 2)
        return np.where((self.n >= 4) & (self.size >= 2), level, 0).astype(np.int64)

    def manners(self) -> np.ndarray:
        one_case = (self.bits & _LOWER_BIT > 0) != (self.bits & _UPPER_BIT > 0)
        return np.where(self.bits & _SIGN_BIT, 2, np.where(one_case, 0, 1))


def _bare(token: str) -> str:
    """Without padding; a sign if that is all."""
    return token.rstrip("=") or "="


def randomness_level(token: str) -> int:
    return int(_Symbols([_bare(token)]).levels()[0])


def _mixes(token: str) -> bool:
    """Letters and digits, or both cases otherwise than as a capitalised word."""
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token) or not (token.islower() or token.isupper() or _WORD.fullmatch(token)) and token.isalnum()


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


class Cells:
    """Tokens' cells (length class, manner and level), row by row. Tokens are tested when there are PART characters."""

    def __init__(self):
        self.waiting: list[str] = []
        self.chars = self.tested = 0
        self.parts: list[np.ndarray] = []
        self.offsets = [0]

    def add(self, tokens: Iterable[str]) -> None:
        for token in tokens:
            self.waiting.append(token)
            self.chars += len(token)
            if self.chars >= PART:
                self._test()

    def end_row(self) -> None:
        self.offsets.append(self.tested + len(self.waiting))

    def _test(self) -> None:
        if self.waiting:
            symbols = _Symbols(list(map(_bare, self.waiting)))
            classes = np.searchsorted(LENGTHS, list(map(len, self.waiting)), "right") - 1
            self.parts.append(((classes * MANNERS + symbols.manners()) * (LEVELS + 1) + symbols.levels()).astype(np.int32))
        self.tested += len(self.waiting)
        self.waiting, self.chars = [], 0

    def all(self) -> np.ndarray:
        self._test()
        return np.concatenate([np.empty(0, np.int32), *self.parts])


def cells(tokens: Iterable[str]) -> list[int]:
    found = Cells()
    found.add(tokens)
    return found.all().tolist()


def _cell(token: str) -> int:
    return cells([token])[0]


def _joined(words: list[str], n: int, shape: int) -> str | None:
    """Words joined to n characters in one of six shapes, two of each manner; None if they don't reach."""
    digits = f"{n * 7 % 10}{len(words[0]) % 10}" if words else ""
    case = (str.lower, str.upper, str.capitalize, str.capitalize, str.lower, str.capitalize)[shape]
    text = ("/" if shape == 4 else "_" if shape == 5 else "").join(map(case, words))
    if shape in (2, 4):
        return text[:n] if len(text) >= n else None
    return text[: n - 2] + digits if len(text) >= n - 2 else None


SHAPES = 6


def joined(words: Iterator[str], number: int) -> Iterator[str]:
    """Of each length class, as far as the words reach: words joined to a length of that class, in
    a shape. Consecutive numbers go through all shapes and lengths."""
    for low, high in zip(LENGTHS, [*LENGTHS[1:], 2 * LENGTHS[-1]], strict=True):
        taken, length = [], 0
        n = low + number // SHAPES % (high - low)
        for word in words:
            taken.append(word)
            length += len(word)
            if length >= n:
                break
        else:
            return
        if (token := _joined(taken, n, number % SHAPES)) is not None:
            yield token


def all_joined(words: Iterator[str], number: int) -> Iterator[str]:
    """Joinings of all words to the last, round after round of the classes; each round has the next shape and
    length."""
    for word in words:
        yield from joined(chain((word,), words), number)
        number += 1


def joined_cells(words: Iterator[str], number: int) -> list[int]:
    return cells(joined(words, number))


def all_joined_cells(words: Iterator[str], number: int) -> list[int]:
    return cells(all_joined(words, number))


@cache
def common_cells() -> Counter:
    """The cells of JOINED joinings of common words for each class and manner."""
    rng = random.Random(3)
    return Counter(cells(token for i in range(JOINED * MANNERS) for token in joined(iter(lambda: rng.choice(COMMON), None), i % SHAPES)))


_SCANNED = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("cell", pa.int32())])


def _spans(offsets: list[int], spans: list[tuple[int, int, int]], cells: np.ndarray | None = None) -> pa.Array:
    """Rows of spans (start, kind, end), with their cells or none."""
    columns = [*(pa.array(c, f.type) for c, f in zip(zip(*spans, strict=True) if spans else ([], [], []), _SCANNED, strict=False))]
    columns.append(pa.nulls(len(spans), pa.int32()) if cells is None else pa.array(cells))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_SCANNED)))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[], [], []]
        shas, spans, offsets, mixed = [], [], [0], []
        tokens, words = Cells(), Cells()
        for text in batch.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            for kind in range(3):
                counts[kind].append(sum(k == kind for _, k, _ in base))
            shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest())
            spans += base
            offsets.append(len(spans))
            # Each document adds joinings of all its words, in shapes and lengths that its own length begins.
            words.add(all_joined(map(re.Match.group, _PLAIN.finditer(text)), len(text)))
            for m in _TOKEN.finditer(text):
                token = m.group()
                if _WORD.fullmatch(token):
                    words.add((token,))
                elif _mixes(token) and not any(a < m.end() and m.start() < b for a, _, b in base):
                    mixed.append((m.start(), 3, m.end()))
                    tokens.add((token,))
            tokens.end_row()
            words.end_row()
        word_cells = pa.ListArray.from_arrays(pa.array(words.offsets, pa.int32()), pa.array(words.all()))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), _spans(offsets, spans), _spans(tokens.offsets, mixed, tokens.all()), word_cells], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "tokens", "words"])


def reported_cells(tokens: dict[int, int], words: dict[int, int], false_share: float = FALSE_SHARE) -> list[int]:
    """The cells (length class, manner and level) whose tokens are reported. tokens, words: numbers by cell.

    A level's p-value is the share of plain words of the class and manner at that level or above, one
    added to each number; levels are reported down to the lowest at which p times the number of
    tokens is at most ``false_share`` of those at that level or above."""
    out = []
    for k in range(len(LENGTHS) * MANNERS):
        at = [k * (LEVELS + 1) + level for level in range(LEVELS + 1)]
        all_tokens, all_words = sum(tokens.get(c, 0) for c in at), sum(words.get(c, 0) for c in at)
        found, random_words, lowest = 0, 0, None
        for level in range(LEVELS, -1, -1):
            found, random_words = found + tokens.get(at[level], 0), random_words + words.get(at[level], 0)
            if found and (1 + random_words) / (1 + all_words) * all_tokens <= false_share * found:
                lowest = level
        out += [] if lowest is None else at[lowest:]
    return out


def scan_secrets(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256 (of what the patterns find) and spans,
    ``kind:start:end`` of all secrets by start, joined by commas; places count code points.

    Null and empty texts have none. Repeated rows and null doc_ids keep their rows and count as often as they
    stand there; extra columns are ignored; without rows there is no result.
    """
    scanned = materialize(docs.select("doc_id", "text").mapInArrow(_scan, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, base array<struct<start:bigint,kind:int,end:bigint,cell:int>>, tokens array<struct<start:bigint,kind:int,end:bigint,cell:int>>, words array<int>"), "secrets")
    # A fixed number of cells, however many documents there are.
    both = scanned.select(F.explode(F.concat(F.transform("tokens", lambda t: F.struct(F.lit("token").alias("of"), t["cell"].alias("cell"))), F.transform("words", lambda c: F.struct(F.lit("word").alias("of"), c.alias("cell"))))).alias("x"))
    counted = both.groupBy("x.of", "x.cell").count().collect()
    tokens, words = ({r["cell"]: r["count"] for r in counted if r["of"] == of} for of in ("token", "word"))
    cells = reported_cells(tokens, common_cells() + Counter(words), false_share)
    random = F.filter("tokens", lambda t: t["cell"].isin(cells)) if cells else F.filter("tokens", lambda t: F.lit(False))
    spans = F.array_sort(F.concat("base", random))
    kinds = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"))


def op3_secrets(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))
