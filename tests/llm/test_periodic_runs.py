"""Periodic runs against a scan of every period; the wavelet matrix against sorting; the query on planted texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from vigil.llm import periodic_runs as pr

SF_SMALL = "/root/testdata/sf0.001"


def brute(words, min_length=6, min_exponent=4):
    """(start, length, period) of the runs, by start and period."""
    found = {}
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_exponent * q):
                found.setdefault((i, j + q), q)  # the smallest period of a stretch comes first
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def some_words(rng):
    if rng.random() < 0.4:
        return [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 90))]
    words, n, symbols = [], rng.randint(0, 200), rng.choice([1, 2, 3, 6])
    while len(words) < n:
        # periods that hold shorter periods, so that blocks occur in progressions
        period = [rng.randrange(symbols) for _ in range(rng.randint(1, 40))] if rng.random() < 0.6 else [0] * rng.randint(1, 30) + [1] * rng.randint(0, 3)
        words += period * rng.randint(1, 8) + period[:rng.randint(0, len(period))] + [rng.randrange(9)] * rng.randint(0, 1)
    return words


@pytest.mark.parametrize("seed", range(60))
def test_find_runs(seed):
    rng = random.Random(seed)
    docs = [some_words(rng) for _ in range(rng.randint(1, 12))]
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    ids = np.array([w for d in docs for w in d], np.int64)
    if len(ids):
        lo, hi, period = pr.find_runs(ids, starts, 6, 4)
        assert list(zip(lo.tolist(), (hi - lo).tolist(), period.tolist(), strict=True)) == [(int(starts[i]) + s, n, q) for i, d in enumerate(docs) for s, n, q in brute(d)]


def test_wavelet_matrix():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 100, 300)
    tree = pr.WaveletMatrix(values, 7)
    lo = rng.integers(0, 300, 500)
    hi = np.array([rng.integers(a, 301) for a in lo])
    x = rng.integers(0, 140, 500)
    want = [min((v for v in values[a:b] if v >= y), default=np.iinfo(np.int64).max) for a, b, y in zip(lo, hi, x, strict=True)]
    assert tree.successor(lo, hi, x).tolist() == want


def test_with_runs(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{w}" for w in some_words(rng)) for _ in range(60)]
    texts += [None, "", " \n ", "a a a a a a", "a a a a a", "ñ é\tñ é ñ\né ñ é", texts[0], "long tail " * 30_000 + "end " + "x " * 9]
    frame = spark.createDataFrame([(i if i % 9 else None, t, "clash", 3) for i, t in enumerate(texts)], "doc_id long, text string, runs string, k int").repartition(3)
    got = pr.with_runs(frame)
    assert got.columns == ["doc_id", "k", "n_words", "runs", "kept_text"]
    want = []
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute(words) if len(words) < 1000 else [(0, 60_000, 2), (60_001, 9, 1)]
        want.append((i if i % 9 else None, 3, len(words), runs, " ".join(collapsed(words, runs))))
    assert sorted(((r.doc_id, r.k, r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert pr.with_runs(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pr.with_runs(frame, min_exponent=3)


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r) for r in pr.op13(spark, SF_SMALL).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if len(words) > 2000:
            continue  # the scan of every period is quadratic
        h = zlib.crc32(str(d).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        hashes = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(collapsed(words, runs)))]
        assert got[d] == (d, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), *hashes)
