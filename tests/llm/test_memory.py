"""What Python workers take at once and keep: batches of a few MB are worked in small blocks, and remembered words are bounded."""

import tracemalloc

import pyarrow as pa
import pytest

import corpus_pipeline
from vigil.llm import near_dedup, packing, quality_rules

DOCS = 1000


@pytest.fixture(scope="module")
def batch():
    """A batch of 2.5 MB, as Spark hands it over."""
    texts = [" ".join(f"w{(i * 31 + j * 7) % 5003}" for j in range(450)) for i in range(DOCS)]
    ids = pa.array(range(DOCS), pa.int64())
    return pa.RecordBatch.from_pydict({"k1": ids, "k2": ids, "id": ids, "text": pa.array(texts), "row": pa.array([{"_": 0}] * DOCS)})


@pytest.mark.parametrize("made", [lambda: quality_rules._stats_map(True), lambda: near_dedup._describe(5)], ids=["quality", "near"])
def test_a_batch_is_worked_in_small_blocks(batch, made):
    run = made()
    tracemalloc.start()
    try:
        assert sum(out.num_rows for out in run(iter([batch]))) == DOCS
        assert tracemalloc.get_traced_memory()[1] < 50 << 20
    finally:
        tracemalloc.stop()


def test_remembered_words_are_bounded():
    words = [f"unheard{i}" for i in range(6000)]
    plain = [t.hex() for t in packing.token_ids(None, [[w.encode()] for w in words])]
    found = []
    for at in range(0, len(words), 500):
        found += [t.hex() for t in packing.token_ids(None, [[w.encode()] for w in words[at:at + 500]], cache_words=1000)]
        assert len(packing._CACHE[None]) <= 1500
    assert found == plain


def test_pipeline_bounds_the_words(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(packing, "_tokenize", lambda *a, of=packing._tokenize: asked.append(a[3:]) or of(*a))
    docs = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.piece, r.start) for r in corpus_pipeline.packed(spark, docs, "").collect()) == [(1, 0, 0), (2, 0, 0)]
    assert asked == [(corpus_pipeline.PACK_CACHE_WORDS,)] and corpus_pipeline.PACK_CACHE_WORDS < packing.CACHE_WORDS
