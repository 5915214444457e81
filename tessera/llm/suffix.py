"""Exact substring deduplication with a logarithmic family of suffix arrays.

A window is ``length`` bytes of a text. Every window is assigned to its anchor, the sub-string of
``ANCHOR`` bytes in it with the least hash (leftmost among equals), so equal windows have equal
anchors, and runs of neighbouring windows with one anchor form a segment. Segments are dealt by
anchor: those whose anchor occurs once can't repeat and go; those equal to an earlier segment repeat
as a whole. Only the first copy of each segment whose anchor also has other segments needs its text.

Anchors are dealt into ranges of about RANGE_WINDOWS windows, so equal windows meet in one range. An
anchor with more than HOT_SEGMENTS different segments (the edge of a passage that very many documents
share) would be a range by itself; its segments are cut into their windows, which are dealt to ranges by
their own hash.

The texts of a range come to a task in order of document, in batches of BATCH_WINDOWS windows. Each
batch gets a suffix array of its windows; neighbours that agree in ``length`` bytes are repeats, and
the batch is merge-scanned against the levels of the range's index, themselves suffix arrays over the
text that they hold, before it is added as a level of its own. Levels of about equal size are merged, so
there are logarithmically many. Levels are kept for one range at a time, so memory is bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialize, table, text_or_empty

LENGTH = 100
ANCHOR = 20
HOT_SEGMENTS = 20_000
#: Windows of a batch, and of a range.
BATCH_WINDOWS, RANGE_WINDOWS = 1 << 15, 1 << 17
#: Windows of a long text are handled in blocks of so many.
BLOCK = 1 << 22
_NO_ID = -(1 << 63)
_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _load(data: np.ndarray, at: int, n: int, order: str = "<") -> np.ndarray:
    """The 64-bit integers that begin at bytes at, at + 1, ..., at + n - 1."""
    return np.ndarray((n,), f"{order}u8", data, at, (1,))


def _hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ANCHOR (20) bytes of ``data``."""
    n = len(data) - ANCHOR + 1
    x = _load(data, 0, n) * _K1
    x ^= x >> np.uint64(32)
    x += _load(data, 8, n)
    x *= _K2
    x ^= x >> np.uint64(29)
    x += _load(data, ANCHOR - 8, n)
    x *= _K3
    x ^= x >> np.uint64(32)
    x *= _K1
    x ^= x >> np.uint64(31)
    return x


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    out, have = keys, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def segments(text: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of a text: anchors' hashes, first windows and numbers of windows of its segments."""
    whole = np.frombuffer(text, np.uint8)
    for block in range(0, len(text) - length + 1, BLOCK):
        data = whole[block : block + BLOCK + length - 1]
        hashes = _hashes(data)
        # The upper half of the hash, then the place: the least is the leftmost of the least hashes.
        keys = hashes >> np.uint64(32) << np.uint64(32) | np.arange(len(hashes), dtype=np.uint64)
        place = _sliding_least(keys, length - ANCHOR + 1) & np.uint64(0xFFFFFFFF)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        yield hashes[place[first]].view(np.int64), first + block, np.diff(np.append(first, len(place)))


def _anchors(length: int):
    """Rows (anchor, content, id, tie, first, n, copy) of the segments of documents (id, tie, text). Within a batch only
    the first segment of each content is left for the shuffle by anchor; the others are known to be copies,
    are joined to stretches of a text and get a key of their own, so that they spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            parts: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for doc_id, tie, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                for hashes, first, n in segments(data, length):
                    ends = (first + n + (length - 1)).tolist()
                    content = np.fromiter((digest(data[a:b]) for a, b in zip(first.tolist(), ends, strict=True)), np.uint64, len(first))
                    for column, values in zip(parts, (hashes, content.view(np.int64), np.full(len(first), doc_id), np.full(len(first), tie), first, n), strict=True):
                        column.append(values)
            if not parts[0]:
                continue
            anchor, content, ids, ties, first, n = map(np.concatenate, parts)
            order = np.lexsort((first, ties, ids, content, anchor))
            a, c, d, t, f = anchor[order], content[order], ids[order], ties[order], first[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
            at = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (d != d[at]) | (t != t[at]) | (f != f[at])
            copy = np.zeros(len(order), bool)
            copy[order[later]] = True
            mine, theirs = np.flatnonzero(~copy), np.flatnonzero(copy)
            # Copies in the order of the texts: a stretch ends where the next one doesn't follow.
            d, t, f, k = ids[theirs], ties[theirs], first[theirs], n[theirs]
            begin = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (f[1:] != f[:-1] + k[:-1])))) if len(theirs) else theirs
            total = np.add.reduceat(k, begin) if len(begin) else k
            d, t, f = d[begin], t[begin], f[begin]
            spread = (d * np.int64(-7046029254386353131)) ^ t ^ (f * np.int64(-4417276706812531889))
            columns = ((anchor[mine], spread), (content[mine], f), (ids[mine], d), (ties[mine], t), (first[mine], f), (n[mine], total), (np.zeros(len(mine), bool), np.ones(len(d), bool)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], ["anchor", "content", "id", "tie", "first", "n", "copy"])

    return run


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (anchor, content, id, tie, first). Yield (id, tie, first, n, anchor, copy): segments
    equal to an earlier one as copies, and the first of each content where an anchor has several. What is
    kept from batch to batch is one row: the content's first segment. Known copies pass through."""
    names = ["id", "tie", "first", "n", "anchor", "copy"]
    anchor = content = begin = None
    pending, several = None, False
    for batch in batches:
        a, c, d, t, f, n, known = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[known]) for x in (d, t, f, n, a, known)], names)
            a, c, d, t, f, n = (x[~known] for x in (a, c, d, t, f, n))
        if not len(a):
            continue
        new_anchor = np.concatenate(([anchor is None or a[0] != anchor], a[1:] != a[:-1]))
        new_content = new_anchor | np.concatenate(([content is None or c[0] != content], c[1:] != c[:-1]))
        starts = np.flatnonzero(new_content)
        # Each row's place in the list of contents, -1 for the one that goes on from before.
        of = np.cumsum(new_content) - 1
        first_d, first_t, first_f = (np.append(x[starts], begin[k] if begin else 0)[of] for k, x in enumerate((d, t, f)))
        copies = np.flatnonzero((d != first_d) | (t != first_t) | (f != first_f))
        # Anchors that begin in this batch, and how many contents each has in it.
        group = np.cumsum(new_anchor[starts]) - 1
        counts = np.bincount(group[group >= 0], minlength=1)
        wanted = starts[np.where(group >= 0, counts[np.maximum(group, 0)] > 1, True)]
        early = int((group < 0).sum())
        rows = [(d[copies], t[copies], f[copies], n[copies], a[copies], np.ones(len(copies), bool))]
        if pending is not None and early:
            rows.append(tuple(np.array([x]) for x in pending) + (np.array([False]),))
            pending, several = None, True
        rows.append((d[wanted], t[wanted], f[wanted], n[wanted], a[wanted], np.zeros(len(wanted), bool)))
        if new_anchor.any():
            last = starts[group == group[-1]]
            several = len(last) > 1
            pending = None if several else tuple(x[last[0]] for x in (d, t, f, n, a))
        elif early:
            several = True
        anchor, content = a[-1], c[-1]
        if len(starts):
            begin = tuple(x[starts[-1]] for x in (d, t, f))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], names)


def suffix_ranks(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Ranks of the windows at ``starts`` in lexicographic order, equal ones alike, by prefix doubling."""
    padded = np.concatenate((data, np.zeros(length + 8, np.uint8)))
    n = len(data)
    ranks = np.unique(_load(padded, 0, n, ">"), return_inverse=True)[1]
    have = 8

    def joined(at: np.ndarray, step: int) -> np.ndarray:
        second = np.append(ranks, np.zeros(step, ranks.dtype))[at + step]
        return np.unique(ranks[at] * np.int64(len(data) + 1) + second, return_inverse=True)[1]

    everywhere = np.arange(n)
    while 2 * have < length:
        ranks, have = joined(everywhere, have), 2 * have
    return joined(starts, length - have)


def suffix_array(data: np.ndarray, windows: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The order of the windows at ``starts``. Where few places of ``data`` begin a window, comparing the
    windows costs less than ranking every place."""
    if 8 * len(starts) < len(data):
        return np.argsort(windows[starts], kind="stable")
    return np.argsort(suffix_ranks(data, starts, length), kind="stable")


class Level(NamedTuple):
    """A text, and the places in it where different windows begin, in the windows' order: a suffix array."""

    data: np.ndarray
    starts: np.ndarray

    def windows(self, length: int) -> np.ndarray:
        return _windows(self.data, length)[self.starts]


def _windows(data: np.ndarray, length: int) -> np.ndarray:
    """A view of the ``length`` bytes at every place."""
    return np.ndarray((max(0, len(data) - length + 1),), f"S{length}", data, 0, (1,))


class LogarithmicIndex:
    """Suffix arrays whose sizes at least halve from level to level. Levels hold texts and places, so a window
    takes up a place and its share of the text; windows are copied for the time of a comparison."""

    def __init__(self, length: int = LENGTH) -> None:
        self.length = length
        self.levels: list[Level] = []

    def _merge_order(self, a: Level, b: Level) -> tuple[np.ndarray, np.ndarray]:
        """The windows of both, and their order; of equal ones that of ``a`` first."""
        both = np.concatenate((a.windows(self.length), b.windows(self.length)))
        # Two sorted runs, which this sort finds and merges in linear time.
        return both, np.argsort(both, kind="stable")

    def scan(self, batch: Level) -> np.ndarray:
        """Which windows of ``batch`` are in some level. A level and the batch are merged; as the windows of
        each differ among themselves, equal neighbours are one of either."""
        found = np.zeros(len(batch.starts), bool)
        for level in self.levels:
            both, order = self._merge_order(level, batch)
            in_order = both[order]
            found[order[1:][in_order[1:] == in_order[:-1]] - len(level.starts)] = True
        return found

    def add(self, batch: Level) -> None:
        if len(batch.starts):
            self.levels.append(batch)
        while len(self.levels) > 1 and 2 * len(self.levels[-1].starts) > len(self.levels[-2].starts):
            b, a = self.levels.pop(), self.levels.pop()
            starts = np.concatenate((a.starts, b.starts + len(a.data)))[self._merge_order(a, b)[1]]
            self.levels.append(Level(np.concatenate((a.data, b.data)), starts))


def _cut(length: int):
    """For documents (id, tie, text, wanted segments) rows (anchor, id, tie, first, bytes, n): segments with their anchor
    or, of hot anchors, windows with their own hash. Of equal windows in a batch only the earliest goes on;
    the others are known to repeat, are joined to stretches of n windows, and come without bytes under a key
    of their own. So a window that all documents share comes to its task once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, deal = xxhash.xxh3_128_intdigest, xxhash.xxh3_64_intdigest
        for batch in batches:
            rows: list[tuple] = []
            hot: list[tuple] = []
            first_of: dict[int, tuple[int, int, int]] = {}
            for doc_id, tie, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                for w in wanted:
                    first, n = w["first"], w["n"]
                    if not w["hot"]:
                        rows.append((w["anchor"], doc_id, tie, first, data[first : first + n + length - 1], n))
                        continue
                    for at in range(first, first + n):
                        key = digest(data[at : at + length])
                        hot.append((doc_id, tie, at, key, data))
                        if key not in first_of or (doc_id, tie, at) < first_of[key]:
                            first_of[key] = (doc_id, tie, at)
            runs: list[list[int]] = []
            for doc_id, tie, at, key, data in sorted(hot, key=lambda x: x[:3]):
                if first_of[key] == (doc_id, tie, at):
                    window = data[at : at + length]
                    rows.append((deal(window) - (1 << 63), doc_id, tie, at, window, 1))
                elif runs and runs[-1][:2] == [doc_id, tie] and runs[-1][2] + runs[-1][3] == at:
                    runs[-1][3] += 1
                else:
                    runs.append([doc_id, tie, at, 1])
            rows += [(deal(f"{doc_id}:{tie}:{at}") - (1 << 63), doc_id, tie, at, None, n) for doc_id, tie, at, n in runs]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["anchor", "id", "tie", "first", "bytes", "n"])

    return run


def _repeats(length: int, batch_windows: int):
    """Rows (range, id, tie, first, bytes, n) sorted so; yield the spans of windows that occur in an earlier row
    of their range, and of rows without bytes, all of whose windows do."""
    names = ["id", "tie", "a", "b"]

    def spans(rows: pa.RecordBatch, index: LogarithmicIndex) -> pa.RecordBatch:
        """Scans a batch against the levels, and adds what is new in it to them."""
        ids, ties, first = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("id", "tie", "first"))
        texts = rows.column("bytes").to_pylist()
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        counts = sizes - (length - 1)
        row = np.repeat(np.arange(len(texts)), counts)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = (np.cumsum(sizes) - sizes)[row] + inner
        windows = _windows(data, length)
        order = suffix_array(data, windows, starts, length)
        repeated = np.zeros(len(starts), bool)
        repeated[order[1:]] = _neighbours_agree(windows, starts[order])
        own = order[~repeated[order]]
        repeated[own] = index.scan(Level(data, starts[own]))
        new = own[~repeated[own]]
        # Of the batch's text only the rows that hold a new window stay.
        holds = np.zeros(len(texts), bool)
        holds[row[new]] = True
        stays = np.repeat(holds, sizes)
        index.add(Level(data[stays], (np.cumsum(stays) - 1)[starts[new]]))
        edge = np.concatenate(([True], (row[1:] != row[:-1]) | (repeated[1:] != repeated[:-1])))
        begin = np.flatnonzero(edge)
        end = np.append(begin[1:], len(row))
        hit = repeated[begin]
        begin, end = begin[hit], end[hit]
        at = first[row[begin]] + inner[begin]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row[begin]], ties[row[begin]], at, at + (end - begin - 1) + length)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, of, last = LogarithmicIndex(length), None, None
        for batch in batches:
            known = batch.filter(batch.column("bytes").is_null())
            if known.num_rows:
                at = known.column("first").to_numpy(zero_copy_only=False)
                ends = at + known.column("n").to_numpy(zero_copy_only=False) + (length - 1)
                yield pa.RecordBatch.from_arrays([*known.select(["id", "tie", "first"]).columns, pa.array(ends)], names)
                batch = batch.filter(batch.column("bytes").is_valid())
            if not batch.num_rows:
                continue
            # A document that repeats sends its rows twice, which is no repeat.
            places = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in ("range", "id", "tie", "first")])
            other = np.concatenate(([not np.array_equal(places[0], last)], np.any(places[1:] != places[:-1], axis=1)))
            last = places[-1]
            batch, ranges = batch.filter(pa.array(other)), places[other, 0]
            if not batch.num_rows:
                continue
            # Cut where a range begins, and each time that so many windows are full.
            windows = np.cumsum(batch.column("n").to_numpy(zero_copy_only=False))
            full = np.flatnonzero(windows[1:] // batch_windows > windows[:-1] // batch_windows) + 1
            cuts = np.unique(np.concatenate(([0], np.flatnonzero(ranges[1:] != ranges[:-1]) + 1, full, [len(ranges)])))
            for begin, end in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                if of is None or ranges[begin] != of:
                    index, of = LogarithmicIndex(length), ranges[begin]
                yield spans(batch.slice(begin, end - begin), index)

    return run


def _neighbours_agree(windows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    in_order = windows[starts]
    return in_order[1:] == in_order[:-1]


def merge_spans(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        b = min(b, size)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _remove(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
_NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def _results(rows: list[tuple], with_bytes: bool) -> list[pa.Array]:
    """rows: (doc_id, bytes or None, spans); columns of the result, null where there are no bytes."""
    out: list[list] = [[], [], [], [], [], []]
    for doc_id, data, spans in rows:
        values = [doc_id, None, None, None, None, None]
        if data is not None:
            spans = merge_spans(spans, len(data))
            kept = _remove(data, spans)
            values = [doc_id, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None]
        for column, value in zip(out, values, strict=True):
            column.append(value)
    return [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_bytes: bool = False, hot_segments: int = HOT_SEGMENTS, batch_windows: int = BATCH_WINDOWS, range_windows: int = RANGE_WINDOWS) -> DataFrame:
    """Remove from each text each byte in a ``length``-byte string that also begins earlier: in a row
    with a smaller doc_id, or further ahead in the same text. Rows that share a doc_id, or have none, come
    one after the other by a hash of their texts; those with equal texts count as one row, so both lose
    what it loses. What repeats is judged on the input.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, ``with_bytes``,
    kept. Null texts are empty; a null doc_id ranks before all others; texts under ``length`` bytes stay
    whole.
    """
    own = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.xxhash64(text_or_empty()).alias("tie"), text_or_empty().alias("text"))
    anchors = own.mapInArrow(_anchors(length), "anchor bigint, content bigint, id bigint, tie bigint, first bigint, n bigint, copy boolean")
    anchors = anchors.withColumns({"first": F.col("first").cast("int"), "n": F.col("n").cast("int")})
    sorted_anchors = anchors.repartition("anchor").sortWithinPartitions("anchor", "content", "id", "tie", "first")
    found = materialize(sorted_anchors.mapInArrow(_classify, "id bigint, tie bigint, first int, n int, anchor bigint, copy boolean"), "segments")

    # One pass over the texts finishes the documents that need no comparison of texts.
    spark, left = docs.sparkSession, found.where("NOT copy").agg(F.sum("n")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), left // range_windows)
    hot = found.where("NOT copy").groupBy("anchor").count().where(F.col("count") > hot_segments)
    hot = materialize(hot.select("anchor", F.lit(True).alias("hot")), "hot_anchors")
    found = found.join(hot, "anchor", "left")
    part = F.struct("first", "n", "anchor", F.coalesce("hot", F.lit(False)).alias("hot"))
    by_doc = found.groupBy("id", "tie").agg(
        F.collect_list(F.when(F.col("copy"), F.struct(F.col("first").alias("a"), (F.col("first") + F.col("n") + (length - 1)).alias("b")))).alias("spans"),
        F.collect_list(F.when(~F.col("copy"), part)).alias("wanted"),
    )

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for doc_id, text, spans, open_ in zip(*(batch.column(i).to_pylist() for i in ("id", "text", "spans", "open")), strict=True):
                rows.append((doc_id, None if open_ else text.encode(), [(s["a"], s["b"]) for s in spans or ()]))
                texts.append(text if open_ else None)
            rest = ["tie", "spans", "wanted"]
            yield pa.RecordBatch.from_arrays([*_results(rows, with_bytes), pa.array(texts, pa.string()), *batch.select(rest).columns], [*_NAMES, "text", *rest])

    joined = own.join(by_doc, ["id", "tie"], "left").select("id", "tie", "text", "spans", "wanted", (F.coalesce(F.size("wanted"), F.lit(0)) > 0).alias("open"))
    more = "text string, tie bigint, spans array<struct<a:int,b:int>>, wanted array<struct<first:int,n:int,anchor:bigint,hot:boolean>>"
    passed = materialize(joined.mapInArrow(first_pass, f"{_RESULT}, {more}"), "passed")
    rest = passed.where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "tie", "text", "spans", "wanted")

    texts = rest.select("id", "tie", "text", "wanted").mapInArrow(_cut(length), "anchor bigint, id bigint, tie bigint, first bigint, bytes binary, n int")
    texts = texts.withColumn("range", F.pmod("anchor", F.lit(ranges))).drop("anchor")
    texts = texts.repartition("range").sortWithinPartitions("range", "id", "tie", "first")
    spans = texts.mapInArrow(_repeats(length, batch_windows), "id bigint, tie bigint, a bigint, b bigint")
    spans = spans.groupBy("id", "tie").agg(F.collect_list(F.struct("a", "b")).alias("more"))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t.encode(), [(s["a"], s["b"]) for s in [*(x or ()), *(y or ())]]) for i, t, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays(_results(rows, with_bytes), _NAMES)

    done = rest.join(spans, ["id", "tie"], "left").select("id", "text", "spans", "more").mapInArrow(second_pass, _RESULT)
    out = passed.where("text IS NULL").select(*_NAMES).unionByName(done).withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID)))
    return out if with_bytes else out.drop("kept")


def op1_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
