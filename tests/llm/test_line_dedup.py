"""Line de-duplication against counting by hand; the filter and the index under insertions and deletions."""

import random
from collections import Counter

import numpy as np
import pytest

from vigil.llm import line_dedup as ld

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def counted(texts):
    return Counter(k for t in texts for k in {key(line) for line in (t or "").split("\n")} if k)


def brute(text, frequent):
    lines = (text or "").split("\n")
    stay = [line for line in lines if key(line) not in frequent]
    return len(lines), len(lines) - len(stay), "\n".join(stay)


@pytest.fixture
def rows():
    rng = random.Random(4)
    common = ["Menu", " menu\t", "Copyright É", "copyright é", "a", "ÀB", "àb", "x\ry", " ", "  ", "日本"]
    texts = ["\n".join(rng.choice(common) if rng.random() < 0.3 else f"line {rng.randrange(400)}" for _ in range(rng.randint(0, 12))) for _ in range(150)]
    texts += [None, "", "\n", "\n\n", "Menu\r\nMENU\r\nmenu", texts[3], texts[3], "long " * 100_000 + "\nMenu\n" + "tail\n" * 20_000]
    return [(i if i % 10 else None, t, i, "clash") for i, t in enumerate(texts)]


KINDS = "doc_id long, text string, n_lines int, bucket string"


def dropped(index, frame):
    return sorted((tuple(r) for r in index.drop_lines(frame).select("doc_id", "bucket", "n_lines", "n_dropped", "kept_text").collect()), key=str)


def wanted(rows, frequent):
    return sorted(((d, "clash", *brute(t, frequent)) for d, t, _, _ in rows), key=str)


def test_drop_lines(spark, rows, tmp_path):
    frame = spark.createDataFrame(rows, KINDS).repartition(5)
    index = ld.LineIndex.create(spark, str(tmp_path), min_docs=5).insert(frame)
    n = counted(t for _, t, _, _ in rows)
    assert sorted(r.n for r in index.counts().collect()) == sorted(n.values())
    assert dropped(index, frame) == wanted(rows, {k for k, c in n.items() if c >= 5})
    assert index.drop_lines(frame.limit(0)).count() == 0


def test_insert_and_delete(spark, rows, tmp_path):
    """Inserting and deleting comes back to the same index, in both directions over the threshold, and versions stay readable."""
    half, rest = rows[:80], rows[80:]
    a, b = (spark.createDataFrame(x, KINDS) for x in (half, rest))
    empty = ld.LineIndex.create(spark, str(tmp_path), min_docs=5)
    one = empty.insert(a)
    both = one.insert(b)
    again = both.delete(b)
    none = again.delete(a)
    first, whole = counted(r[1] for r in half), counted(r[1] for r in rows)
    for index, n in ((one, first), (both, whole), (again, first), (none, Counter()), (ld.LineIndex.open(spark, str(tmp_path), 2), whole)):
        frequent = {k for k, c in n.items() if c >= 5}
        assert sum(r.n for r in index.counts().collect()) == sum(n.values()) and index.n_names == len(n)
        assert sum(r.held for r in index.filters().collect()) == len(frequent)
        assert dropped(index, a) == wanted(half, frequent)
    assert dropped(empty, b) == wanted(rest, set())
    with pytest.raises(Exception, match="had not been inserted"):
        one.delete(b)


def test_more_shards(spark, rows, tmp_path, monkeypatch):
    """An index that outgrows its shards is dealt out over more, with filters built anew."""
    a, b = (spark.createDataFrame(x, KINDS) for x in (rows[:80], rows[80:]))
    one = ld.LineIndex.create(spark, str(tmp_path), min_docs=5).insert(a)
    monkeypatch.setattr(ld, "SHARD_NAMES", 50)
    both = one.insert(b)
    assert both.n_shards > one.n_shards
    frequent = {k for k, c in counted(r[1] for r in rows).items() if c >= 5}
    assert dropped(both, a) == wanted(rows[:80], frequent)


def test_min_chars(spark, tmp_path):
    frame = spark.createDataFrame([(i, "é\néa\n日本語") for i in range(6)], "doc_id long, text string")
    index = ld.LineIndex.create(spark, str(tmp_path), min_docs=3, min_chars=2).insert(frame)
    assert {r.kept_text for r in index.drop_lines(frame).collect()} == {"é"}
    with pytest.raises(ValueError):
        ld.LineIndex.create(spark, str(tmp_path), min_docs=0)


def test_filter():
    """No name that is held is missed, through kicks, growth and deletions; deleted names are gone but for chance."""
    names = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 6000)
    cuckoo = ld.CuckooFilter.holding(names[:5000])
    assert len(cuckoo) == 5000 and cuckoo.contains(names[:5000]).all()
    assert cuckoo.contains(names[5000:]).mean() < 0.01
    cuckoo = ld.CuckooFilter.read(cuckoo.slots.tobytes())
    cuckoo.delete(names[:2500])
    assert len(cuckoo) == 2500 and cuckoo.contains(names[2500:5000]).all() and cuckoo.contains(names[:2500]).mean() < 0.01
    small = ld.CuckooFilter(4)
    assert not small.insert(names[:50])
    same = np.full(9, names[0])  # nine of a name don't fit two buckets of four
    assert not ld.CuckooFilter(64).insert(same)
