"""Each operator against brute force on a small corpus with nulls, empty and long texts, repeated rows and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from vigil.llm import decontaminate, lattice_lm, license_scan, near_dedup, packing, quality_rules, sharding, substring_dedup, suffix_dedup, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text) with repeats, near copies, nulls, empty, repeated rows, ties and one long text."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(80)] + ["ñé", "License", "MIT"]
    passages = [[rng.choice(words) for _ in range(rng.randint(10, 60))] for _ in range(10)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [rng.choice(words) for _ in range(rng.randint(0, 10))]
            text += rng.choice(passages)[rng.randint(0, 5):]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(text)))
    # a passage in ever new surroundings, more often than a block lets through unsalted
    rows += [(200 + i, f"a{i} b{i} " + " ".join(passages[0]) + f" c{i}") for i in range(40)]
    rows += [(300, None), (301, ""), (302, rows[5][1]), (None, rows[6][1]), (302, rows[5][1]), (303, " \n "), (304, "long tail " * 20_000), (None, "alone here")]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def frame(spark, corpus):
    """The corpus with an extra column whose name clashes with results and internal names."""
    return spark.createDataFrame([(*r, "x", 1) for r in corpus], "doc_id long, text string, kept string, k1 int")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_suffix_dedup(frame, corpus, empty):
    width = 90
    texts = [(t or "").encode() for _, t in corpus]
    count = Counter(b[i:i + width] for b in texts for i in range(len(b) - width + 1))
    want = []
    for (d, _), b in zip(corpus, texts, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if count[b[i:i + width]] > 1:
                gone[i:i + width] = b"\x01" * width
        runs = len(re.findall(b"\x01+", bytes(gone)))
        want.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    got = suffix_dedup.remove_repeats(frame, width=width)
    assert rows_of(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == sorted(want, key=str)
    assert suffix_dedup.remove_repeats(empty, width=width).count() == 0


def test_difference_cover():
    m = suffix_dedup.MODULUS
    assert {(a - b) % m for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(m))


def test_substring_dedup(frame, corpus, empty):
    window, last = 12, (1 << 63) - 1
    words = [WORD.findall(t or "") for _, t in corpus]
    ids = [last if d is None else d for d, _ in corpus]
    least = {}
    for d, w in zip(ids, words, strict=True):
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            least[k] = min(least.get(k, last), d)
    want = []
    for (d, _), own, w in zip(corpus, ids, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i:i + window])] < own:
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, y in zip(w, gone, strict=True) if not y)
        want.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring_dedup.remove_later_passages(frame, window=window)
    assert rows_of(got.select("doc_id", "n_words", "n_removed", "kept_sha256")) == sorted(want, key=str)
    assert substring_dedup.remove_later_passages(empty).count() == 0


def test_fm_index_matches():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 4, 400)
    index = substring_dedup.FMIndex(np.append(text, 0), 5)
    found = {int(a): index.trim(np.array([r])) for _, at, row in substring_dedup.matching(index, np.append(text, 0), np.array([0]), np.array([400])) for a, r in zip(at, row, strict=True)}
    for at, (lo, hi) in found.items():
        places = {i for i in range(396) if (text[i:i + 5] == text[at:at + 5]).all()}
        assert set(index.suffixes[lo[0]:hi[0]].tolist()) == places
    assert len(found) == 396


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(frame, corpus, empty, size):
    sets = []
    for _, t in corpus:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    top = list(range(len(sets)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    places = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            places[x].append(i)
    for i, s in enumerate(sets):
        for j, c in Counter(j for x in s for j in places[x] if j > i).items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                top[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(corpus):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    want = [(d, len(s), least.get(root(i), d), least.get(root(i), d) == d) for i, ((d, _), s) in enumerate(zip(corpus, sets, strict=True))]
    got = near_dedup.near_duplicates(frame.select("doc_id", "text"), size=size)
    assert rows_of(got) == sorted(want, key=str)
    assert near_dedup.near_duplicates(frame, size=size).count() == len(corpus)
    assert near_dedup.near_duplicates(empty, size=size).count() == 0
    # one document of each component: the least id, or one of those without an id; documents without words all stay
    kinds = {i: root(i) for i, s in enumerate(sets) if s}
    stay = near_dedup.one_of_each(frame, size=size)
    assert stay.columns == frame.columns
    got = [(r.doc_id, r.text) for r in stay.collect()]
    for top_ in set(kinds.values()):
        mine = [corpus[i] for i, k in kinds.items() if k == top_]
        assert len([g for g in got if g in mine]) == 1
        assert [g[0] for g in got if g in mine][0] == least.get(top_)
    assert Counter(g for g in got if not WORD.search(g[1] or "")) == Counter({c for c, s in zip(corpus, sets, strict=True) if not s})
    assert near_dedup.one_of_each(empty, size=size).count() == 0


def test_quality_statistics(frame, corpus, empty):
    want = []
    for d, t in corpus:
        t = t or ""
        w, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        tri, twice = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2)), [False] * len(w)
        for i in range(len(w) - 2):
            if tri[tuple(w[i:i + 3])] > 1:
                twice[i:i + 3] = [True] * 3
        n = sum(twice)
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, n, len(w) < 50 or 100 * n > 50 * len(w)))
    got = quality_rules.judge(frame, [])
    assert rows_of(got.select("doc_id", *quality_rules.BASE, "base_failed")) == sorted(want, key=str)
    assert quality_rules.judge(empty, []).count() == 0


def test_quality_rules_are_learned(spark):
    rng = np.random.default_rng(2)
    n = 3000
    stats = {c: rng.integers(50, 500, n) for c in quality_rules.COUNTS}
    bad = (stats["n_symbols"] > 2 * stats["n_words"]) & (stats["n_words"] < 200)
    rules = quality_rules.learn(stats, bad)
    x = quality_rules.features(stats)
    said = np.zeros(n, bool)
    for r in rules:
        said |= quality_rules._covered(r, x)
    assert (said == bad).mean() > 0.97
    assert quality_rules.learn({c: v[:0] for c, v in stats.items()}, bad[:0]) == []
    df = spark.createDataFrame([tuple(int(stats[c][i]) for c in quality_rules.COUNTS) for i in range(200)], ", ".join(f"{c} long" for c in quality_rules.COUNTS))
    assert [not r[0] for r in df.select(quality_rules.verdict(rules)).collect()] == said[:200].tolist()


def test_license_places(frame, corpus, empty):
    want = []
    for d, t in corpus:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        at = [p[0] for p in places]
        want.append((d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({p[1] for p in places}))))
    got = license_scan.scan_licenses(frame)
    assert rows_of(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == sorted(want, key=str)
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_detections(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "a mitten", "All rights reserved"]
    got = [r.labels for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["apache,apache-2.0", "gpl-3.0", "mit", "cc-by-nc-4.0", "", "proprietary"]
    assert license_scan.resolve([(3, 0, 10, "a"), (2, 0, 12, "b"), (1, 11, 20, "c")]) == [(2, 0, 12, "b"), (1, 11, 20, "c")]
    assert len(license_scan.make_rules()) > 300


def test_lattice_against_all_segmentations():
    names = (b"a", b"b", b"ab", b"ba", b"aba", b"c")
    logp = np.log([0.2, 0.2, 0.2, 0.1, 0.1, 0.2])

    def total(w):
        return 1.0 if not w else sum(math.exp(logp[i]) * total(w[len(p):]) for i, p in enumerate(names) if w.startswith(p))

    words = [b"a", b"abab", b"abacab" * 2]
    lattice = lattice_lm.Lattice(names, logp)
    assert np.allclose(lattice.score(words), [math.log(total(w)) for w in words])
    assert np.allclose(lattice._one(words[2])[-1], lattice.score(words)[2])


@pytest.mark.parametrize("size", [1, 5, 64, 1 << 16])
def test_expected_uses_on_both_sides_of_long(monkeypatch, size):
    names = (b"a", b"b", b"ab", b"ba", b"aba", b"c", b"ccccc", "語".encode(), *[bytes([x]) for x in "語".encode()])
    logp = np.log(np.arange(1, len(names) + 1) / 100)

    def ways(w):
        if not w:
            yield ()
        for i, p in enumerate(names):
            if w.startswith(p):
                yield from ((i, *rest) for rest in ways(w[len(p):]))

    words = [b"ab", b"abab", b"c" * 48, b"abacab" * 2 + b"c" * 2, b"aba" + b"bc" * 25, b"bb" * 20 + "語".encode() * 4, "語".encode() * 9 + b"cab" * 9, b"aba"]
    assert sum(len(w) > lattice_lm.LONG for w in words) >= 3
    count = np.array([1, 2, 3, 1, 4, 2, 5, 0])
    want, score = np.zeros(len(names)), []
    for w, n in zip(words, count, strict=True):
        all_ = list(ways(w)) if w != b"c" * 48 else None
        if all_ is None:  # too many to list: positions of the five-letter piece by recursion
            z, e = [1.0], [np.zeros(len(names))]
            for k in range(1, 49):
                steps = [(5, 1)] + ([(6, 5)] if k >= 5 else [])
                z.append(sum(math.exp(logp[i]) * z[k - m] for i, m in steps))
                e.append(sum(math.exp(logp[i]) * z[k - m] / z[k] * (e[k - m] + np.eye(len(names))[i]) for i, m in steps))
            score.append(math.log(z[48]))
            want += n * e[48]
            continue
        weight = np.exp([sum(logp[i] for i in way) for way in all_])
        score.append(math.log(weight.sum()))
        for way, x in zip(all_, weight / weight.sum(), strict=True):
            want += n * x * np.bincount(way, minlength=len(names))
    monkeypatch.setattr(lattice_lm, "SLICE", size, raising=False)
    lattice = lattice_lm.Lattice(names, logp)
    assert np.allclose(lattice.expected(words, count), want)
    assert np.allclose(lattice.score(words), score)


def test_language_model(frame, corpus, empty):
    tokens = [WORD.findall(lower(t)) + [None] for _, t in corpus]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in corpus]
    c = Counter(x for t, h in zip(tokens, held, strict=True) if not h for x in t)
    n, v = sum(c.values()), len(c)
    want = sorted(((d, h, len(t), sum(c[x] > 0 for x in t), n) for (d, _), t, h in zip(corpus, tokens, held, strict=True)), key=str)
    got = lattice_lm.score_texts(frame).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got), key=str) == want
    base = sorted(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t) for t in tokens)
    assert np.allclose(sorted(r.base_score for r in got), base)
    assert all(r.score <= 0 for r in got)
    assert lattice_lm.score_texts(empty).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://a.NET/x", "http://example.net/en/1?q", "http://www.example.net/en", "http://example.com/de/?x", "x://org/fr/y", "http://a.org/frx", "http://net", "http://badnet/x", "a://b://c.net/"]
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, rule string"), url_filter.RULES).orderBy("page_id").collect()]
    assert got[:3] == [("", "", None, "allow")] * 3
    assert [g[2] for g in got[3:]] == ["net/", "example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None, None]
    assert got[4] == ("example.net", "/en/1", "example.net/en/", "allow")


def test_packing(frame, corpus, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = []
    for d, t in corpus:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(d, k, a, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    got = packing.pack(frame, partition_tokens=10_000).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= packing.lower_bound(np.array([w[3] for w in want]), 2048) + 1
    assert packing.pack(empty).count() == 0


def test_packing_bounds():
    rng = np.random.default_rng(4)
    for _ in range(50):
        sizes = rng.integers(1, 21, rng.integers(1, 60))
        bins = packing.best_fit_decreasing(sizes, 20)
        assert np.bincount(bins, sizes).max() <= 20
        assert packing.lower_bound(sizes, 20) <= bins.max() + 1
    assert packing.lower_bound(np.array([11] * 5), 20) == 5


def test_decontamination(spark, corpus):
    split = lambda s: [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", (s or "").lower()) if w]
    texts = [t for _, t in corpus if t and len(t.split()) > 60]
    items = [(i, " ".join(t.split()[5:5 + n])) for i, (t, n) in enumerate(zip(texts, (6, 20, 30, 40, 12, 3, 1), strict=False))] + [(90, None), (91, ""), (None, " ".join(texts[1].split()[2:30]))]
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r.doc_id: (r.n_items, round(r.similarity, 6)) for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = defaultdict(dict)
    for d, t in corpus:
        w = split(t)
        for item, text in items:
            own = split(text)
            k = min(5, len(own))
            if not own:
                continue
            a, b = [tuple(own[i:i + k]) for i in range(len(own) - k + 1)], [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]
            if not set(a) & set(b):
                continue
            for at in range(len(b) - len(a) + 1):
                common = sum((Counter(a) & Counter(b[at:at + len(a)])).values())
                s = common / (2 * len(a) - common)
                if s >= 0.8:
                    want[d][item] = max(s, want[d].get(item, 0))
    assert set(got) == set(want)
    assert all(got[d] == (len(v), round(max(v.values()), 6)) for d, v in want.items())
    assert decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    # without ids, each text is judged for itself
    bad = {t for d, t in corpus if d in got}
    unnamed = spark.createDataFrame([(None, t) for _, t in corpus], "doc_id long, text string")
    kept = decontaminate.decontaminated(unnamed, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter(r.text for r in kept) == Counter(t for _, t in corpus if t not in bad)


def test_decontamination_of_moved_halves(spark):
    """An item whose halves stand in another order inside a longer document; the first similar window counts."""
    rng = random.Random(8)
    a, b, before, after = ([f"{n}{rng.randrange(10_000)}" for _ in range(k)] for n, k in (("a", 30), ("b", 30), ("c", 100), ("d", 100)))
    item = a + b
    texts = {1: before + b + a + after, 2: before + b + after, 3: before + item + after, 4: before + b[8:] + after + a + b[:8]}
    grams = lambda w: [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    want = {}
    for d, w in texts.items():
        own, all_ = grams(item), grams(w)
        for at in range(len(all_) - len(own) + 1):
            common = sum((Counter(own) & Counter(all_[at:at + len(own)])).values())
            s = common / (2 * len(own) - common)
            if s >= 0.8:
                want[d] = (max(s, want[d][0]), want[d][1]) if d in want else (s, at)
    assert set(want) == {1, 3}
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = decontaminate.contamination(docs, benchmark).collect()
    assert {r.doc_id: (round(r.similarity, 9), r.first_word) for r in got} == {d: (round(s, 9), at) for d, (s, at) in want.items()}
    assert sorted(r.doc_id for r in decontaminate.decontaminated(docs, benchmark).collect()) == [2, 4]


@pytest.mark.parametrize("item_id", [None, 7])
def test_decontamination_with_equal_ids(spark, item_id):
    """Items of one size and id, most of them too far from the text; and a clean and a contaminated text of one id."""
    rng = random.Random(9)
    docs, items = [], []
    for d in range(6):
        own = [f"{d}x{rng.randrange(10_000)}" for _ in range(60)]
        docs += [(d, " ".join(own)), (d, " ".join(own[:30] + [f"{d}y{i}" for i in range(30)]))]
        items.append((item_id, " ".join(own)))
        items += [(item_id, " ".join(own[:48 - k] + [f"{d}z{k}z{i}" for i in range(12 + k)])) for k in range(8)]
    rng.shuffle(items)
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_items, r.similarity) for r in got} == {d: (1, 1.0) for d in range(6)}


def test_sharding(frame, corpus, empty):
    got = sharding.shuffled_shards(frame, 7).collect()
    assert sorted(str(r.text) for r in got) == sorted(str(t) for _, t in corpus)
    for s in range(7):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    sizes = Counter(r.shard for r in got).values()
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shuffled_shards(empty, 7).count() == 0


def test_sharding_bounds_rows_and_whole_rows(spark, monkeypatch):
    """Tables without text are spread too: one file per bucket is written."""
    heavy = spark.range(400).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text", "repeat('x', 500) AS extra")
    got = sharding.shuffled_shards(heavy, 4, bucket_bytes=20_000)
    assert len(got.inputFiles()) >= 10
    assert sorted(r.doc_id for r in got.collect()) == list(range(400))
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50, raising=False)
    light = spark.range(400).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text")
    got = sharding.shuffled_shards(light, 4)
    assert len(got.inputFiles()) == 8
    assert sorted(Counter(r.shard for r in got.collect()).values()) == [100] * 4
