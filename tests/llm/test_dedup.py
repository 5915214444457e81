import hashlib
import random

import pytest
import xxhash

from tessera.llm import lines, shared, simhash, suffix
from tests.llm.conftest import ODD


def brute_repeats(rows):
    """(n_bytes, n_removed, n_spans, sha) by doc_id and text of distinct rows in order."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    seen, out = {}, {}
    for doc_id, text in sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42)))):
        data = text.encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.setdefault(data[s : s + 100], (doc_id, s))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(data)))
        out[doc_id, text] = (doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeating_texts(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages)[rng.randint(0, 40) :] if rng.random() < 0.6 else " ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.1:
            parts.append("ab " * rng.randint(20, 120))
        rows.append((i, "\n".join(parts), f"s{i % 3}"))
    return rows + [(n + i, rows[i][1], "s0") for i in range(5)]


@pytest.mark.parametrize("batch, hot, windows", [(10_000, 20_000, 1 << 15), (3, 20_000, 50), (3, 2, 1 << 15), (10_000, 2, 200), (10_000, 20_000, 100)])
def test_suffix_dedup_is_brute_force(spark, frame, batch, hot, windows):
    rows = repeating_texts(60, batch) + [r for r in ODD if r[0] is None and r[1] is None]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = suffix.remove_repeats(frame(rows), with_bytes=True, hot_segments=hot, batch_windows=windows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute_repeats(rows)
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(str(want[r[0], r[1] or ""]) for r in rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_different_texts_of_one_id_lose_nothing_of_each_other(frame, hot):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(150)
    rows = [(7, text(181), "s"), (7, text(500), "s"), (None, passage, "s"), (None, text(60) + passage, "s"), (None, text(500), "s"), (7, text(40) + passage + text(40), "s"), (9, passage, "s"), (9, passage, "s"), (9, text(300), "s")]
    rows += [(i % 3, x, "s") for i, x, _ in repeating_texts(30, 9)] + [(None, x, "s") for _, x, _ in repeating_texts(20, 9)]
    got = suffix.remove_repeats(frame(rows), hot_segments=hot).collect()
    want = brute_repeats(rows)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str(want[r[0], r[1]]) for r in rows)
    assert want[7, rows[0][1]][2] == want[7, rows[1][1]][2] == want[None, rows[4][1]][2] == 0


def test_suffix_dedup_of_odd_rows(odd, nothing):
    got = suffix.remove_repeats(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[5]["n_removed"] == 0 and by[6]["n_removed"] == by[6]["n_bytes"] and by[1]["n_bytes"] == 0
    assert suffix.remove_repeats(nothing).count() == 0


def test_logarithmic_index():
    import numpy as np

    index, rng = suffix.LogarithmicIndex(4), random.Random(1)
    seen = set()
    for _ in range(40):
        data = np.frombuffer(bytes(rng.choice(b"ab\0c") for _ in range(rng.randint(4, 60))), np.uint8)
        windows = [data[i : i + 4].tobytes() for i in range(len(data) - 3)]
        first = {w: i for i, w in reversed(list(enumerate(windows)))}
        batch = sorted(first)
        assert index.scan(suffix.Level(data, np.array([first[w] for w in batch]))).tolist() == [w in seen for w in batch]
        new = [w for w in batch if w not in seen]
        index.add(suffix.Level(data, np.array([first[w] for w in new], np.int64)))
        seen |= set(batch)
    sizes = [len(level.starts) for level in index.levels]
    assert all(2 * b <= a for a, b in zip(sizes, sizes[1:], strict=False)) and sum(sizes) == len(seen)
    for level in index.levels:
        held = [level.data[i : i + 4].tobytes() for i in level.starts]
        assert held == sorted(set(held))


def test_suffix_ranks():
    import numpy as np

    data = b"banana bandana banana ban " * 20
    starts = np.arange(len(data) - 99)
    ranks = suffix.suffix_ranks(np.frombuffer(data, np.uint8), starts)
    windows = [data[s : s + 100] for s in starts]
    assert [sorted(set(windows)).index(w) for w in windows] == ranks.tolist()


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """Least id reachable, by id."""
    ids = [i for i, _ in pairs]
    root = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for i, f in pairs:
            for j, g in pairs:
                if (f ^ g).bit_count() <= 3 and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


def test_simhash_groups(frame):
    rows = repeating_texts(60, 5)
    near = [(1000 + i, r[1] + " tail", "s") for i, r in enumerate(rows[:20])]
    rows += [*near, (2000, "", "s"), (2001, None, "s"), (2002, "  ", "s")]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(rows)).collect()}
    prints = {r[0]: brute_fingerprint(r[1]) for r in rows}
    assert all(int(got[i]["fingerprint"], 16) == f for i, f in prints.items())
    want = brute_components(list(prints.items()))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert want[2002] == 2000


def test_links_in_crowded_buckets(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(40)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    want = brute_components([(signed(p), p) for p in prints])
    for tree_size in (4096, 3):
        got = {r["fp"]: r["root"] for r in simhash.link_groups(fps, tree_size=tree_size).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_bk_tree_finds_all():
    rng = random.Random(4)
    values = [rng.getrandbits(16) for _ in range(300)]
    tree = simhash.BkTree(3)
    for i, v in enumerate(values):
        assert sorted(tree.near(v)) == [j for j in range(i) if (values[j] ^ v).bit_count() <= 3]
        tree.add(v)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (7, 7), (None, 5), (4, 1), (2, 1)]
    got = {r["node"]: r["root"] for r in shared.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10}
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
    assert {r["root"] for r in shared.connected_components(path).collect()} == {0}
    assert shared.connected_components(path.where("false")).count() == 0


def test_near_dedup_of_odd_rows(odd, nothing):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 7, 8] and ids.count(None) == 2
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_first(nothing).count() == 0


def brute_lines(rows):
    """Kept (doc_id, line number) of documents in order."""
    placed = [(i, no, line.split()) for i, text, *_ in sorted(rows) for no, line in enumerate(text.split("\n")) if line.split()]

    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < lines.MIN_WORDS or abs(len(a) - len(b)) > 1:
            return False
        start = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        end = next((k for k in range(min(len(a), len(b))) if a[-1 - k] != b[-1 - k]), min(len(a), len(b)))
        return start + end >= max(len(a), len(b)) - 1

    return {(i, no) for k, (i, no, w) in enumerate(placed) if not any(near(w, v) for _, _, v in placed[:k])}


def test_line_dedup_is_brute_force(frame):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 12))] for _ in range(25)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(base))
            if rng.random() < 0.6:
                at = rng.randrange(len(line) + 1)
                line = rng.choice([line[:at] + [rng.choice(words)] + line[at:], line[:at] + line[at + 1 :], [*line[:at], rng.choice(words), *line[at + 1 :]]])
            text.append("  ".join(line))
        rows.append((i, "\n".join(text), "s"))
    want = brute_lines(rows)
    got = {(r["doc_id"], int(n)) for r in lines.line_verdicts(frame(rows)).collect() for n in r["kept_lines"].split(",") if n}
    assert got == want and 0 < len(want) < sum(len(r[1].split("\n")) for r in rows)
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(frame(rows)).collect()}
    for i, text, _ in rows:
        assert [x.split() for x in out[i].split("\n") if x.split()] == [x.split() for n, x in enumerate(text.split("\n")) if (i, n) in want]


NEAR = [(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon other"), (3, "something else altogether in this line")]


@pytest.mark.parametrize("again", [[], [0], [1], [0, 1], [0, 0, 1, 1, 2]])
def test_repeated_rows_keep_near_links(frame, again):
    rows = NEAR + [NEAR[i] for i in again]
    got = sorted((r["doc_id"], r["n_kept"], r["n_near"], r["kept_lines"]) for r in lines.line_verdicts(frame(rows)).collect())
    kept = {1: (1, 0, "0"), 2: (0, 1, ""), 3: (1, 0, "0")}
    assert got == sorted((i, *kept[i]) for i, _ in rows)
    out = sorted((r["doc_id"], r["text"]) for r in lines.dedup_lines(frame(rows)).collect())
    assert out == sorted((i, "" if i == 2 else text) for i, text in rows)


def test_different_rows_of_one_id_stay_apart(frame):
    rows = [(1, "one two three four five six"), (2, "one two three four five other\nseven eight nine ten eleven"), (2, "a clean line that nobody else has\nseven eight nine ten eleven")]
    out = sorted(r["text"] for r in lines.dedup_lines(frame(rows)).collect() if r["doc_id"] == 2)
    assert out[0].startswith("a clean line") and all("seven eight" in t for t in out)


def test_hot_lines_are_spread(frame, monkeypatch):
    """A template with one changing word, as often as it takes to be spread."""
    monkeypatch.setattr(lines, "HOT", 3)
    monkeypatch.setattr(lines, "SPREAD_ROWS", 5)
    rows = [(i, f"page number {i} of this very long list\nline {i} alone {i * 7} in its {i * 11} document {i * 13}") for i in range(60)]
    got = lines.line_verdicts(frame(rows)).collect()
    assert sorted((r["doc_id"], r["kept_lines"]) for r in got) == [(i, "0,1" if i == 0 else "1") for i in range(60)]


def test_line_dedup_of_odd_rows(odd, nothing):
    got = lines.line_verdicts(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[5]["n_kept"] == 2 and by[6]["n_kept"] == 0 and by[6]["n_removed"] == 2 and by[3]["n_lines"] == 0
    out = lines.dedup_lines(odd)
    texts = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == odd.columns and (6, "") in texts and (1, None) in texts and (2, "") in texts
    assert lines.line_verdicts(nothing).count() == 0 and lines.dedup_lines(nothing).count() == 0
