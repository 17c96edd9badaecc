"""The pipeline's stages, each written and read, against brute force on the smallest tables; registered queries and SQL."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from compare import compare, duck
from vigil.llm import decontaminate, quality_rules, queries

SF_SMALL = "/root/testdata/sf0.001"


def without_repeats(texts, width=400):
    """Texts without the strings of width bytes that start more than once."""
    raw = {d: t.encode() for d, t in texts.items()}
    count = Counter(hash(b[i:i + width]) for b in raw.values() for i in range(len(b) - width + 1))
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if count[hash(b[i:i + width])] > 1:
                gone[i:i + width] = b"\x01" * width
        out[d] = bytes(x for x, y in zip(b, gone, strict=True) if not y).decode("utf-8", "ignore")
    return out


def check_packed(texts, rows):
    """Every token is packed once, in gapless sequences of at most 2048."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    size = Counter()
    places = defaultdict(list)
    for r in rows:
        size[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert size == Counter({d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()})
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.fixture
def odd_rows(spark, tmp_path):
    """A folder of tables whose documents have nulls, empty texts, repeated rows and columns named like results."""
    words = [f"word{i}" for i in range(400)]
    prose = [" ".join(words[(i * 7 + j * (i % 5 + 1)) % 400] for j in range(120)) for i in range(12)]
    texts = [*prose, None, "", " \n ", prose[0], prose[0], "tiny"]
    ids = [*range(12), 20, 21, None, None, 0, 23]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, settled string, row string, component_id string"
    rows = [(d, t, None, "s", None, f"kept{i}", "n", None, "row", "c") for i, (d, t) in enumerate(zip(ids, texts, strict=True))]
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, None if d == 3 else int(d % 4 > 0), 0) for d in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, "a passage that stands nowhere else at all in here"), (1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("number", range(5))
def test_odd_rows_and_empty_tables(spark, odd_rows, number):
    docs = spark.read.parquet(f"{odd_rows}/documents.parquet")
    name, stage = corpus_pipeline.STAGES[number]
    got = stage(spark, docs, odd_rows)
    rows = got.collect()
    if number < 4:
        assert got.columns == docs.columns
        given = {r.kept: r for r in docs.collect()}
        assert all(r.kept in given and r.n_words == "n" and r.settled is None and r.row == "row" and r.component_id == "c" for r in rows)
        if number in (0, 1, 3):
            assert all(r == given[r.kept] for r in rows)
        texts = [r.text for r in rows]
        if number == 0:
            assert all(t and len(t.split()) >= 50 for t in texts)
        if number == 1:
            assert len([t for t in texts if t and t == given["kept0"].text]) == 1
            assert len(rows) == len(given) - 3  # two copies, and one of two texts that go round the same words
        if number == 2:
            assert len([r for r in rows if not (r.text or "").strip()]) == 3  # null, empty and blank texts stay; repeated ones are gone
        if number == 3:
            assert len(rows) == len(given)
    else:
        assert sum(r.length == 1 for r in rows) == 3 and len(rows) == docs.count()
    assert stage(spark, docs.limit(0), odd_rows).count() == 0


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_SMALL)
        out.write.parquet(str(tmp_path / str(number)))
        after = spark.read.parquet(str(tmp_path / str(number)))
        before = {r.doc_id: r.text for r in docs.collect()}
        if number < 4:
            assert after.columns == docs.columns
            kept = {r.doc_id: r.text for r in after.collect()}
            assert set(kept) <= set(before) and len(kept) == after.count()
        if number == 0:
            failed = {r.doc_id for r in quality_rules.judge(docs, []).where("base_failed").collect()}
            assert not failed & set(kept)
        if number == 1:
            sets = {}
            for d, t in before.items():
                w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
                sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
            near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
            assert all(any(near(sets[d], sets[o]) for o in sets if o != d) for d in set(before) - set(kept))
            assert not [(a, b) for a in kept for b in kept if a < b and near(sets[a], sets[b])]
        if number == 2:
            want = without_repeats(before)
            assert kept == {d: t for d, t in want.items() if t == before[d] or t.strip(" ")}
            assert all(r.n_chars == len(r.text) for r in after.collect())
        if number == 3:
            bad = {r.doc_id for r in decontaminate.contamination(docs, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).collect()}
            assert set(before) - set(kept) == bad
        if number == 4:
            check_packed(before, after.collect())
        docs = after


def test_registered(spark):
    assert sorted(q.split("_")[0] for q in queries.QUERIES) == sorted(f"op{n}" for n in range(1, 14))
    con = duck(SF_SMALL)
    for name, sql in queries.ORACLE.items():
        assert not compare(queries.QUERIES[name](spark, SF_SMALL), con, sql)[0]
