import hashlib
import math
import random
import zlib

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, lines, media, mixing, pii, quality, secrets, toxicity
from tests.llm.conftest import ODD

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("module, query", [(quality, quality.op5_quality_rules), (mixing, mixing.op7_mixing), (lines, lines.op9_line_dedup)])
def test_same_as_sql(spark, module, query):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    ours, theirs = query(spark, SMALL).toPandas(), con.sql(module.ORACLE_SQL).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert ours[columns].astype(str).sort_values(columns).values.tolist() == theirs[columns].astype(str).sort_values(columns).values.tolist()


# Quality


def brute_repeated_words(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)})


def test_repeated_words(frame):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))), "s") for i in range(40)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.quality_verdicts(frame(rows)).collect()}
    assert got == {i: brute_repeated_words(t.split()) for i, t, _ in rows}


def test_bad_hosts_take_their_documents_along(frame):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, good, f"h{i % 9}") for i in range(180)] + [(1000 + i, "too short" if i % 20 else good, "bad") for i in range(60)]
    rows += [(2000, "short", "tiny")]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality_verdicts(frame(rows)).collect()}
    assert got[0] == (False, True) and got[1000] == (False, False) and got[2000] == (True, False)
    kept = quality.keep_good(frame(rows))
    assert {r["doc_id"] for r in kept.collect()} == set(range(180))


def test_quality_of_odd_rows(odd, nothing):
    got = quality.quality_verdicts(odd).collect()
    assert len(got) == len(ODD) and {r["doc_id"] for r in got if r["base_failed"]} >= {1, 2, 3, 4, 7}
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [5, 6, 6, 8]
    assert quality.quality_verdicts(nothing).count() == 0 and quality.keep_good(nothing).count() == 0


# BPE


def test_bpe_is_the_library(frame):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    rng = random.Random(2)
    pool = "abcdefgABC's'll 've'd!?.,\t\n\x1c\x85 éÉΣσİﬁ漢あ12３😀\x00<|endoftext|>"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["<|endoftext|>a <|startoftext|>", "x" * 3000]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [r for r in ODD if r[0] is not None and r[0] < 3]
    for r in bpe.encode_documents(frame([(i, t, "s") for i, t in enumerate(texts)]), path, with_ids=True).collect():
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert rows


def test_very_long_words_are_not_all_kept():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    with open(path, encoding="utf-8") as f:
        model = bpe.Bpe(f.read(), cached=20_000)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(n)) for n in (60_000, 3000, 7, 1500, 5, 3000, 60_000, 2)]
    for text in [" ".join(words), *words, " ".join(words[2:])]:
        assert model.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert sum(200 + 4 * len(w) + len(ids) for w, ids in model._words.items()) == model._held <= 20_000


def test_bpe_of_odd_rows(odd, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = bpe.encode_documents(odd, path).collect()
    assert len(got) == len(ODD) and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert bpe.encode_documents(nothing, path).count() == 0


def test_stale_entries_are_skipped():
    data = '{"added_tokens": [], "model": {"type": "BPE", "end_of_word_suffix": "", "vocab": %s, "merges": [["a", "b"], ["b", "a"], ["ab", "a"], ["ab", "ab"]]}}'
    vocab = {c: i for i, c in enumerate(bpe._byte_letters())} | {"ab": 300, "ba": 301, "aba": 302, "abab": 303}
    import json

    model = bpe.Bpe(data % json.dumps(vocab))
    a, b = vocab["a"], vocab["b"]
    assert model.merge([a, b, a, b, a]) == [300, 302] and model.merge([b, a, b]) == [b, 300]
    assert model.decode([300, 302]) == "ab aba"


# Mixing


def test_mix_meets_its_targets(frame):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 50))), f"s{min(rng.randint(0, 9), 4)}") for i in range(400)] + [(1000, "x y", None)]
    got = mixing.mix_sizes(frame(rows)).toPandas()
    total = got["size"].sum()
    by = {s: got[got.doc_id.isin([r[0] for r in rows if r[2] == s])] for s in {r[2] for r in rows}}
    for part in by.values():
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 0.5 + 1e-9
        assert part.target.iloc[0] <= 2 * part.source_size.iloc[0] and (part.taken <= 2 * part["size"]).all()
    assert sum(p.target.iloc[0] for p in by.values()) == pytest.approx(1.5 * total)
    assert got.equals(mixing.mix_sizes(frame(rows[::-1])).toPandas())
    assert got.first_position.dropna().is_monotonic_increasing and got.first_position.dropna().between(0, 1).all()
    texts = mixing.mixed(frame(rows)).toPandas()
    taken = texts.groupby("doc_id").text.apply(lambda t: sum(len(x.split()) for x in t))
    assert taken.to_dict() == got[got.taken > 0].set_index("doc_id").taken.to_dict()


def test_positions_invert_the_schedule():
    for knots in mixing.SCHEDULES.values():
        assert knots[0][0] == 0 and knots[-1][0] == 1


def test_inverse_is_the_integral(spark):
    df = spark.range(0, 101).select((F.col("id") / 100.0).alias("u"))
    for knots in mixing.SCHEDULES.values():
        whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
        for u, t in df.select("u", mixing._inverse(F.col("u"), knots)).collect():
            area = 0.0
            for a, b in zip(knots, knots[1:], strict=False):
                x = min(max(t - a[0], 0.0), b[0] - a[0])
                area += x * a[1] + (b[1] - a[1]) / (b[0] - a[0]) * x * x / 2
            assert area / whole == pytest.approx(u, abs=1e-5)


def test_mix_of_odd_rows(odd, nothing):
    got = mixing.mix_sizes(odd).collect()
    assert len(got) == len(ODD) and sum(r["taken"] for r in got) > 0
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).count() > 0
    assert mixing.mix_sizes(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


# Secrets


def random_token(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_secrets(frame):
    rng = random.Random(4)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = [random_token(rng, base62, 40) for _ in range(30)]
    plain = ["".join(rng.choice(["lor", "ipsum", "dolo", "amet", "the", "tion"]) for _ in range(8)) for _ in range(3000)]
    rows = [(i, f"é {k} and {' '.join(plain[100 * i : 100 * i + 100])}", "s") for i, k in enumerate(keys)]
    rows += [(100, 'Password = "abcdefgh12345" tokEn:short api_key: x.y.z=abc1234567', "s"), (101, "AKIAABCDEFGHIJ1234 AKIASHORT deadbeefdeadbeef01 deadbeef", "s"), (102, "zzzzzzzzzz1111111111zzzzzzzzzz1111111111", "s")]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(frame(rows)).collect()}
    assert sum(got[i]["spans"] == f"random:2:{2 + 40}" for i in range(30)) >= 20
    assert got[100]["n_assign"] == 2 and got[100]["spans"].startswith("assign:0:")
    assert (got[101]["n_access"], got[101]["n_hex"]) == (1, 1) and got[101]["spans"] == "access:0:18,hex:29:47"
    assert got[101]["base_sha256"] == hashlib.sha256(b"access:0:18,hex:29:47").hexdigest()
    assert got[102]["spans"] == ""


def test_randomness_tests_tell_apart():
    rng = random.Random(5)
    base62 = secrets.ALPHABETS[8]
    levels = [secrets.randomness_level(random_token(rng, base62, 40)) for _ in range(400)]
    assert 0.35 * secrets.LEVELS < sum(levels) / 400 < 0.65 * secrets.LEVELS
    assert max(secrets.randomness_level(x) for x in ("a1" * 20, "abcdefghijklmnopqrstuvwxyz0123456789", "a" * 30 + "1" * 10)) < 10


def test_reported_cells_bound_false_ones():
    top = secrets.LEVELS
    assert secrets.reported_cells({top: 50, 10: 50}, {5: 1000}) == list(range(6, top + 1))
    assert secrets.reported_cells({top: 50}, {top: 1000}) == [] and secrets.reported_cells({}, {}) == []


def test_secrets_of_odd_rows(odd, nothing):
    got = secrets.scan_secrets(odd).collect()
    assert len(got) == len(ODD) and {r["spans"] for r in got} == {""}
    assert secrets.scan_secrets(nothing).count() == 0


# Media


def test_media_round_trip(spark, odd, nothing, tmp_path):
    got = media.store_and_measure(odd).collect()
    assert len(got) == len(ODD)
    texts = {r[0]: (r[1] or "").encode() for r in ODD}
    for r in got:
        if r["doc_id"] is not None:
            payload = media.pad(texts[r["doc_id"]])
            assert len(payload) % 192 == 0 and payload
            assert (r["n_bytes"], r["payload_bytes"]) == (len(texts[r["doc_id"]]), len(payload))
            assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
            image = media.encode_image(payload)
            assert media.decode_image(image) == payload and r["media_sha256"] == hashlib.sha256(image).hexdigest() and r["media_bytes"] == len(image)
    assert media.store_and_measure(nothing).count() == 0


def test_ranges_and_batches_lose_no_member(spark, frame, tmp_path):
    rows = [(i, "text " * i, "s") for i in range(200)]
    media.write_archives(frame(rows), f"file://{tmp_path}/a", archive_bytes=2000)
    for options in ({"rangeBytes": 300, "batchBytes": 100}, {}):
        df = media.read_archives(spark, f"file://{tmp_path}/a", **options)
        assert sorted(r["doc_id"] for r in df.select("doc_id").collect()) == list(range(200))
    assert len(list((tmp_path / "a").iterdir())) > 3


class Unsteady:
    """A file system whose reads go wrong as ``spoil(offset, data)`` says."""

    def __init__(self, store, spoil):
        self.store, self.spoil, self.reads = store, spoil, []

    def open_input_file(self, path):
        outer, file = self, self.store.open_input_file(path)

        class File:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                file.close()

            def seek(self, at):
                self.at = at
                file.seek(at)

            def read(self, size):
                outer.reads.append((self.at, size))
                return outer.spoil(self.at, file.read(size))

        return File()


@pytest.fixture
def archive(frame, tmp_path):
    media.write_archives(frame([(i, f"text {i} " * (i % 9 + 1), "s") for i in range(60)]).coalesce(1), f"file://{tmp_path}/a")
    reader = media.ArchiveReader({"path": f"file://{tmp_path}/a", "rangeBytes": "1000"})
    return reader, next((tmp_path / "a").glob("*.arch"))


def read_all(reader):
    return [(r["doc_id"], r["offset"], r["media"]) for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]


def unsteady(monkeypatch, spoil):
    real = media._open
    opened = []

    def fake(uri):
        store, path = real(uri)
        opened.append(Unsteady(store, spoil) if uri.endswith(".arch") else store)
        return opened[-1], path

    monkeypatch.setattr(media, "_open", fake)
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    return opened


def test_short_and_spoiled_reads_are_made_again(archive, monkeypatch):
    reader, _ = archive
    want = read_all(reader)
    assert sorted(w[0] for w in want) == list(range(60)) and len(reader.partitions()) > 3
    counts = {}

    def every_other(at, data):
        counts[at, len(data)] = counts.get((at, len(data)), 0) + 1
        return data[:-1] if counts[at, len(data)] == 1 and at % 2 else data[:20] + b"?" + data[21:] if counts[at, len(data)] == 1 and len(data) > 200 else data

    opened = unsteady(monkeypatch, every_other)
    assert read_all(reader) == want
    assert any(isinstance(x, Unsteady) for x in opened)


def test_sound_members_take_long_reads(archive, monkeypatch):
    reader, _ = archive
    opened = unsteady(monkeypatch, lambda at, data: data)
    assert len(read_all(reader)) == 60
    # For each range: footer, index, a block of the directory, and one stretch.
    assert sum(len(x.reads) for x in opened if isinstance(x, Unsteady)) <= 4 * len(reader.partitions())


def test_damage_that_stays_is_an_error(archive):
    reader, file = archive
    whole, want = file.read_bytes(), read_all(reader)
    for at, message in ((want[5][1] + 30, f"at {want[5][1]}"), (len(whole) - 40, "index of"), (len(whole) - 1, "index of"), (want[-1][1] + len(want[-1][2]) + 3, "directory of")):
        file.write_bytes(whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :])
        with pytest.raises(OSError, match=message):
            read_all(reader)
    file.write_bytes(whole)
    assert read_all(reader) == want


def test_range_widths_grow_with_the_folder(tmp_path, monkeypatch):
    (tmp_path / "a.arch").write_bytes(b"x" * 1000)
    monkeypatch.setattr(media, "LEAST_RANGE", 10)
    for ranges, least, most in ((5, 5, 6), (1, 1, 1), (1000, 100, 100)):
        monkeypatch.setattr(media, "RANGES", ranges)
        assert least <= len(media.ArchiveReader({"path": f"file://{tmp_path}"}).partitions()) <= most


def test_members_are_retried_by_offset(tmp_path, monkeypatch):
    reader = media.ArchiveReader({"path": str(tmp_path), "attempts": "3"})
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("gone")
        return b"data"

    assert reader._again(flaky, "x") == b"data"
    with pytest.raises(OSError, match="x at 5"):
        reader._again(lambda: (_ for _ in ()).throw(ValueError("checksum differs")), "x at 5")


# Toxicity


def test_toxicity_is_learned(spark, frame):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    stems = ["qwz", "xyrrt", "vvooq"]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(40)]
        toxic = i % 5 == 1
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(40), rng.choice(stems) + rng.choice(["ing", "ed", "ers"]))
        rows.append((i, " ".join(text), "s"))
        labels.append((i, int(toxic)))
    labelled = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(frame([*rows, (None, None, None), (9999, "", "s")]), labelled).collect()}
    assert len(got) == 602 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [(got[i]["score"], y) for i, y in labels if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    pairs = [(a > b) + 0.5 * (a == b) for a, y in held if y for b, z in held if not z]
    assert sum(pairs) / len(pairs) > 0.9


def test_one_class_and_no_labels(spark, odd, nothing):
    schema = "doc_id bigint, toxic int"
    assert {r["score"] for r in toxicity.score_toxicity(odd, spark.createDataFrame([], schema)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score_toxicity(odd, spark.createDataFrame([(5, 1), (6, 1), (4, None), (None, 1)], schema)).collect()} <= {0.0, 1.0}
    assert toxicity.score_toxicity(nothing, spark.createDataFrame([(1, 1)], schema)).count() == 0


def test_features_of_any_text():
    reader = toxicity.Reader({"abcd+": 2.0})
    for text in (None, "", "!!!", "You ABCDEFG 1d10t cooool " * 3, "é" * 5000):
        assert len(reader.features(text)) == len(toxicity.FEATURES) and all(map(math.isfinite, reader.features(text)))
    named = dict(zip(toxicity.FEATURES, reader.features("you abcdefg and 1d1ot"), strict=True))
    assert named["terms"] == 1 and named["aimed"] > 0 and named["obfuscated"] > 0


# Hosts and sources


def host_counts(spark, failures):
    """Documents of hosts: name to (failing, all)."""
    rows = [(h, i < bad, 0, 100, 500, 10, 0) for h, (bad, n) in failures.items() for i in range(n)]
    return spark.createDataFrame(rows, "source string, base_failed boolean, n_symbols long, n_words long, word_chars long, n_lines long, n_dup_lines long")


def rejected(spark, failures):
    return {r["source"] for r in quality.host_verdicts(host_counts(spark, failures)).where("rejected").collect()}


def test_the_prior_decides_on_small_hosts(spark):
    alike = {f"h{i}": (2, 40) for i in range(30)}
    torn = {f"h{i}": ((38, 40) if i % 2 else (1, 40)) for i in range(30)}
    bad = {f"h{i}" for i in range(1, 30, 2)}
    # Five of five fail: among hosts that all do well that is chance, among hosts of two sorts it isn't.
    assert rejected(spark, alike | {"small": (5, 5)}) == set()
    assert rejected(spark, torn | {"small": (5, 5)}) == bad | {"small"}
    # A single document never does, and many do whatever the others are.
    assert rejected(spark, torn | {"one": (1, 1)}) == bad
    assert rejected(spark, alike | {"large": (900, 1000)}) == {"large"}
    # Hosts without a failure stay where nearly all others fail.
    assert "clean" not in rejected(spark, {f"h{i}": (39, 40) for i in range(30)} | {"clean": (0, 1)})


def test_many_sources_cap_one_after_another(spark):
    rng = random.Random(2)
    for n in (1, 2, 7, 60):
        sizes = {f"s{i:03d}": int(10 ** rng.uniform(0, 6)) for i in range(n)} | {None: 50}
        got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(5)).collect()}
        weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
        capped = set()
        while True:
            left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
            level = left / sum(w for s, w in weights.items() if s not in capped)
            more = {s for s in sizes if s not in capped and weights[s] * level > 2 * sizes[s]}
            if not more:
                break
            capped |= more
        assert got == pytest.approx({s: 2.0 * sizes[s] if s in capped else weights[s] * level for s in sizes})


# Personal data


def test_surrogates(frame):
    a = "Write to ann.lee@mail.example.com or +1 (555) 010-2233, card 4111 1111 1111 1111, host 10.20.30.40."
    b = "Again ann.lee@mail.example.com; Mrs Anna Smith and Mr. Smith met госпожа Иванова, 123-45-6789, DE44 5001 0517 5407 3249 31."
    rows = [(1, a, "s"), (2, b, "s"), (3, "nothing personal, version 1.2.3 of 2024-01-02", "s")]
    got = {r["doc_id"]: r for r in pii.replace_personal_data(frame(rows), "k").collect()}
    one, two = got[1], got[2]
    kinds = [e["value"] for e in one["entities"]]
    assert kinds == ["ann.lee@mail.example.com", "+1 (555) 010-2233", "4111 1111 1111 1111", "10.20.30.40"]
    assert got[3]["text"] == rows[2][1] and got[3]["entities"] is None
    mapped = {e["value"]: e["surrogate"] for r in (one, two) for e in r["entities"]}
    assert one["entities"][0]["surrogate"] == two["entities"][0]["surrogate"] != "ann.lee@mail.example.com"
    shape = lambda s: "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in s)
    for value in ("ann.lee@mail.example.com", "+1 (555) 010-2233", "4111 1111 1111 1111", "123-45-6789", "DE44 5001 0517 5407 3249 31"):
        assert shape(mapped[value]) == shape(value) and mapped[value] != value
    assert mapped["+1 (555) 010-2233"].startswith("+1 (") and mapped["DE44 5001 0517 5407 3249 31"].startswith("DE")
    first = mapped["Mrs Anna Smith"].split()
    assert first[0] == "Mrs" and first[1] in pii.FIRST_NAMES["female", "latin"]
    assert mapped["Mr. Smith"].split()[-1] == first[-1]
    assert all("а" <= c.lower() <= "я" for c in mapped["госпожа Иванова"].split()[1])
    assert all(v not in one["text"] + two["text"] for v in mapped)


def test_colliding_surrogates_are_drawn_again(spark, monkeypatch):
    units = spark.createDataFrame([("ip", f"10.0.{i}.{j}") for i in range(6) for j in range(6)], "kind string, what string")
    # A surrogate with 150 values only, for 36 units.
    monkeypatch.setattr(pii, "drawn_for", lambda kind, what, attempt, key: F.concat(F.lit("x"), F.pmod(F.xxhash64(what, attempt), F.lit(150))))
    moved = pii.redrawn(units, "k")
    final = units.join(moved, ["kind", "what"], "left").select("kind", "what", F.coalesce("attempt", F.lit(0)).alias("attempt"))
    drawn = [r[0] for r in final.select(pii.drawn_for(F.col("kind"), F.col("what"), F.col("attempt"), "k")).collect()]
    assert not moved.isEmpty() and len(set(drawn)) == 36


def test_surrogates_of_odd_rows(odd, nothing):
    got = pii.replace_personal_data(odd, "k")
    assert got.columns == [*odd.columns, "entities"]
    assert rows_of(got.select(odd.columns)) == rows_of(odd)
    assert pii.surrogate_report(odd, "k").count() == len(ODD) and pii.surrogate_report(nothing, "k").count() == 0
