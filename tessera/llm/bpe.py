"""BPE encoding and decoding with a published vocabulary whose words end in ``</w>``.

The vocabulary file is small and fixed (a few MB); the driver reads it and broadcasts it.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Unicode's White_Space, which the vocabulary's splitting pattern calls \s.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+")
#: str.split() also parts at these, which White_Space lacks.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE_RUN = re.compile(f"[{_WHITE}]+")
#: A pair of ids in one integer; a heap entry, rank and place, in one integer.
_BITS = 24
_PLACE = 40
_PLACES = (1 << _PLACE) - 1
#: Bytes of a worker's words with their ids; of one of them, besides its characters and ids.
CACHED_BYTES, _ENTRY_BYTES = 192 << 20, 200


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b], spare = chr(spare), spare + 1
    return letters


class Bpe:
    """Encoder and decoder. ``cached`` bounds the bytes, about, that words whose ids are kept take up."""

    def __init__(self, definition: str, cached: int = CACHED_BYTES):
        data = json.loads(definition)
        model = data["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.strings = [""] * (1 + max([*vocab.values(), *(t["id"] for t in data["added_tokens"])]))
        for string, i in vocab.items():
            self.strings[i] = string
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        for string, i in self.added.items():
            self.strings[i] = string
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        letters = _byte_letters()
        self._inner = [vocab[x] for x in letters]
        self._last = [vocab[x + suffix] for x in letters]
        self._ranks: dict[int, int] = {}
        self._pairs: list[int] = []
        self._merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self._pairs.append(vocab[left] << _BITS | vocab[right])
            self._merged.append(vocab[left + right])
            self._ranks[self._pairs[-1]] = rank
        self._words: dict[str, bytes] = {}
        self._cached, self._held = cached, 0

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge neighbours, lowest rank first and leftmost among equals: a heap of (rank, place)
        over a doubly linked list. An entry whose two symbols have changed since is stale."""
        ranks, pairs, merged, n = self._ranks.get, self._pairs, self._merged, len(symbols)
        heap = []
        for i in range(n - 1):
            if (rank := ranks(symbols[i] << _BITS | symbols[i + 1])) is not None:
                heap.append(rank << _PLACE | i)
        if not heap:
            return symbols
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            rank, i = entry >> _PLACE, entry & _PLACES
            j = after[i]
            if j >= n or symbols[i] << _BITS | symbols[j] != pairs[rank]:
                continue
            symbols[i], symbols[j] = symbol, _ = merged[rank], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks(symbol << _BITS | symbols[k])) is not None:
                    heappush(heap, rank << _PLACE | i)
            k = before[i]
            if k >= 0 and (rank := ranks(symbols[k] << _BITS | symbol)) is not None:
                heappush(heap, rank << _PLACE | k)
        return [s for s in symbols if s >= 0]

    def _word(self, word: str) -> bytes:
        """Ids of a stretch without white space, as little-endian 32-bit integers."""
        pieces = [word] if word.isalpha() and word.isascii() else _PIECES.findall(word)
        if len(pieces) != 1 or pieces[0] != word:
            known = self._words.get
            out = b"".join([known(p) or self._word(p) for p in pieces])
        else:
            raw = word.encode()
            symbols = [self._inner[b] for b in raw]
            symbols[-1] = self._last[raw[-1]]
            out = array("I", self.merge(symbols)).tobytes()
        size = _ENTRY_BYTES + 4 * len(word) + len(out)
        if self._held + size > self._cached:
            self._words.clear()
            self._held = 0
        if size <= self._cached:
            self._words[word] = out
            self._held += size
        return out

    def encode_bytes(self, text: str) -> bytes:
        if self._added and any(x in text for x in self.added):
            return b"".join(array("I", [self.added[part]]).tobytes() if part in self.added else self._plain(part) for part in self._added.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        words = _WHITE_RUN.split(text) if _SEPARATORS.search(text) else text.split()
        known, word = self._words.get, self._word
        return b"".join([known(w) or word(w) for w in words])

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_bytes(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings, one after the other; this vocabulary defines no decoder, so a
        space stands between them and word ends stay visible."""
        return " ".join(map(self.strings.__getitem__, ids))


def encode_documents(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Encode each document's whole text, and decode the ids again.

    ``vocabulary`` is the path of a tokenizer definition. Returns doc_id, n_tokens, ids_sha256,
    decoded_sha256 and, ``with_ids``, ids and decoded. Null and empty texts have no tokens; the row
    of every document stays, repeated rows and null doc_ids too; other columns are ignored.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(shared.value)
        for batch in batches:
            counts, shas, decoded_shas, all_ids, all_decoded = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                raw = bpe.encode_bytes(text or "")
                ids = array("I", raw).tolist()
                decoded = bpe.decode(ids)
                counts.append(len(ids))
                shas.append(hashlib.sha256(raw).hexdigest())
                decoded_shas.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                    all_decoded.append(decoded)
            columns = [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded_shas, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    more = ", ids array<int>, decoded string" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")


def op6_bpe(spark, sf_dir):
    import public_tokenizers

    from tessera.llm.shared import table

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
