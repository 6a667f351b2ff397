import hashlib
import random
import zlib

import pytest

from labelwright.llm import runs
from conftest import rows as listed


def slow_lyndon(x):
    out = []
    for i in range(len(x)):
        j = i + 1
        while j < len(x) and x[j:] > x[i:]:
            j += 1
        out.append(j - i)
    return out


def slow_runs(x, least):
    out = []
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            start = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            end = i + q
            if i > start and end - start >= max(least, 2 * q) and not any(p < q and a <= start and a + n >= end for a, n, p in out):
                out.append((start, end - start, q))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def places(x):
    return [[i for i, v in enumerate(x) if v == w] for w in sorted(set(x))]


def some_words(rng):
    x = [rng.randint(0, rng.choice([0, 1, 2, 9])) for _ in range(rng.randint(0, 60))]
    if x and rng.random() < 0.5:
        p, a = rng.randint(1, 12), rng.randint(0, len(x) - 1)
        x[a:] = (x[a : a + p] * 60)[: len(x) - a]
    return x


def test_lyndon_arrays_under_both_orders(monkeypatch):
    rng = random.Random(2)
    for k in range(400):
        if k == 200:
            monkeypatch.setattr(runs, "PACKED", 0)
        x = some_words(rng)
        assert list(runs.lyndon(places(x), len(x))) == slow_lyndon(x)
        assert list(runs.lyndon(places(x)[::-1], len(x))) == slow_lyndon([-v for v in x])


@pytest.mark.parametrize("least", [2, 12])
def test_runs_are_those_of_brute_force(least):
    rng = random.Random(3)
    for _ in range(60):
        texts = [some_words(rng) for _ in range(rng.randint(1, 8))]
        assert runs.find_runs([[b"w%d" % v for v in x] for x in texts], least) == [slow_runs(x, least) for x in texts]


def test_equal_hashes_of_other_words_are_noticed(monkeypatch):
    monkeypatch.setattr(runs, "mix", lambda x: x * 0 + x.dtype.type(1))  # every word has one hash
    texts = [some_words(random.Random(k)) for k in range(40)]
    assert runs.find_runs([[b"w%d" % v for v in x] for x in texts], 4) == [slow_runs(x, 4) for x in texts]


def test_digest_of_whole_table(spark):
    text = " ".join("one two three four five six seven eight nine ten".split() * 3)
    docs = [(k, f"start{k} " + text) for k in range(60)] + [(100, None), (101, ""), (102, "a"), (102, "a " * 5000), (None, text), (103, " \t\n")]
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in docs], "doc_id long, text string, row string, runs int, collapsed int")
    got = listed(runs.digest(runs.periodic_runs(runs.with_period(df))).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))
    want = []
    for doc_id, t in docs:
        w = (t or "").split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = slow_runs(w, 12) if n < 1000 else [(0, n, 1)]
        keep = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in found)]
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        want.append((doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(keep).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert any(r[1] for r in want[:60]) and runs.digest(runs.periodic_runs(df.limit(0))).count() == 0
