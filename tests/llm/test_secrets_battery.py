"""The battery over arrays of tokens against one that goes token by token, in results and in time."""

import math
import random
import string
import time
from itertools import pairwise

from tessera.llm import secrets


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared(indices, size):
    n, bins = len(indices), max(2, min(size, len(indices) // 3))
    of = [i * bins // size for i in range(size)]
    counts, widths = [0] * bins, [0] * bins
    for k in of:
        widths[k] += 1
    for i in indices:
        counts[of[i]] += 1
    chi = sum((c - n * w / size) ** 2 / (n * w / size) for c, w in zip(counts, widths, strict=True))
    dof = bins - 1
    return tail(((chi / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof)))


def runs(indices):
    n, ordered = len(indices), sorted(indices)
    middle = ordered[(n - 1) // 2] + ordered[n // 2]
    above = [2 * i > middle for i in indices]
    a = sum(above)
    if a in (0, n):
        return 0.0
    mean = 1 + 2 * a * (n - a) / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return 2 * tail(abs(1 + sum(x != y for x, y in pairwise(above)) - mean) / math.sqrt(variance)) if variance > 0 else 1.0


def serial(indices):
    n = len(indices)
    mean = sum(indices) / n
    spread = sum((i - mean) ** 2 for i in indices)
    if not spread:
        return 0.0
    r = sum((x - mean) * (y - mean) for x, y in pairwise(indices)) / spread
    return 2 * tail(abs(r + 1 / n) * math.sqrt(n))


def cell_by_hand(token):
    bare = token.rstrip("=")
    alphabet = next((a for a in secrets.ALPHABETS if set(bare) <= set(a)), "".join(sorted(set(bare))))
    level = 0
    if len(bare) >= 4 and len(alphabet) >= 2:
        coded = list(map(sorted(alphabet).index, bare))
        x = -sum(math.log(max(p, 1e-300)) for p in (chi_squared(list(map(alphabet.index, bare)), len(alphabet)), runs(coded), serial(coded)))
        level = int(secrets.LEVELS * math.exp(-x) * (1 + x + x * x / 2))
    manner = 2 if not bare.isalnum() else 0 if bare.islower() or bare.isupper() else 1
    return ((sum(len(token) >= n for n in secrets.LENGTHS) - 1) * secrets.MANNERS + manner) * (secrets.LEVELS + 1) + level


def test_arrays_agree_with_single_tokens(monkeypatch):
    rng = random.Random(8)
    alphabets = [*secrets.ALPHABETS, secrets.ALPHABETS[-1] + "=", string.ascii_letters + "=", "ab=", "a", "0", "="]
    tokens = ["".join(rng.choice(a) for _ in range(n)) + "=" * rng.choice((0, 0, 1, 2)) for a in alphabets for n in (1, 2, 3, 4, 5, *range(20, 130, 3), 1_000) for _ in range(3)]
    tokens += ["a1" + "=" * 30, "a1" * 20, "a" * 30 + "1" * 10, string.ascii_lowercase + string.digits, string.digits * 5]
    rng.shuffle(tokens)
    want = [cell_by_hand(t) for t in tokens]
    assert secrets.cells(tokens) == want and len(set(want)) > 1_000
    monkeypatch.setattr(secrets, "PART", 50)
    assert secrets.cells(tokens) == want and secrets.cells([]) == []


def test_rows_keep_their_cells():
    rows = [[], ["abcdefghij0123456789"] * 2, [], ["Zx81kPq02mVb77LtYw3sRd"], []]
    found = secrets.Cells()
    for row in rows:
        found.add(row)
        found.end_row()
    values = found.all().tolist()
    assert [values[a:b] for a, b in pairwise(found.offsets)] == [[secrets._cell(t) for t in row] for row in rows]


def seconds(f):
    best = math.inf
    for _ in range(3):
        begun = time.process_time()
        f()
        best = min(best, time.process_time() - begun)
    return best


def test_joinings_of_a_text_cost_few_times_its_words():
    """Token by token the battery took 13 times as long as finding the words."""
    rng = random.Random(2)
    text = " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randrange(3, 10))) for _ in range(60_000))

    def words():
        return (m.group() for m in secrets._PLAIN.finditer(text))

    secrets.all_joined_cells(words(), 7)
    assert seconds(lambda: secrets.all_joined_cells(words(), 7)) < 8 * seconds(lambda: list(words()))
