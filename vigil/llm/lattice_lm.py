"""Language-model scores: the marginal probability of a text over all segmentations into the pieces of a given vocabulary.

The pieces come from an existing vocabulary file, with prior scores by their rank in it. The training documents' words, counted
over the corpus, weight all segmentations of every word (forward-backward), which gives the pieces' probabilities. A text's
probability is the product over its words of the sum over the word's segmentations (forward recursion in log space) and of the end.

Texts aren't shuffled. A block of text sends its distinct words with their training counts to the words' buckets; a bucket sums
the counts, runs the recursion once per word and answers each block; the block's documents, kept as lists of word numbers, meet the
answers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as bl
from .near_dedup import LOWER
from .rolling import mix, words

#: Name of the vocabulary among the installed public tokenizers, where no path is given.
VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁".encode()
#: Documents that are left out of training have this remainder of crc32(id as text) by FOLDS.
FOLDS, HELD_OUT = 7, 2
#: Words above this length, in bytes, go through the same recursion one after the other, in slices of SLICE bytes.
LONG, SLICE = 48, 1 << 14


@lru_cache(2)
def pieces(path: str | None) -> tuple[tuple[bytes, ...], np.ndarray]:
    """The vocabulary's pieces as bytes (the 256 single bytes among them) and their prior log probabilities, by rank (Zipf)."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            found.setdefault(model.id_to_piece(i).encode(), 1.0 / (i + 10))
    for b in range(256):
        found.setdefault(bytes([b]), 1e-6)
    weight = np.array(list(found.values()))
    return tuple(found), np.log(weight / weight.sum())


SLOTS = 1 << 22


def _table(parts) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, bytes): the byte strings as rows, filled up with zeros."""
    lengths = np.array([len(p) for p in parts], np.int64)
    width = int(lengths.max(initial=1))
    return lengths, np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(-1, width)


def _logadd(u: float, v: float) -> float:
    if u < v:
        u, v = v, u
    return u if v == -math.inf else u + math.log1p(math.exp(v - u))


class Lattice:
    """All segmentations of words into pieces with log probabilities."""

    def __init__(self, names: tuple[bytes, ...], logp: np.ndarray):
        self.by_piece = {p: i for i, p in enumerate(names)}
        self.logp, self.longest = logp, max(map(len, names))
        # keys of the pieces, and one flag per slot for the keys of all their beginnings: a substring that begins no piece ends its row
        key = np.zeros(len(names), np.uint64)
        self.begins = np.zeros(SLOTS, bool)
        lengths, table = _table(names)
        for c in range(table.shape[1]):
            live = lengths > c
            key[live] = mix(key[live] * np.uint64(257) + table[live, c] + np.uint64(1))
            self.begins[(key[live] % np.uint64(SLOTS)).astype(np.int64)] = True
        self.order = np.argsort(key)
        self.key = key[self.order]

    def _arcs(self, parts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, word numbers, piece numbers) of all arcs, by start and then end; words of up to LONG bytes."""
        lengths, table = _table(parts)
        for a in range(table.shape[1]):
            rows = np.flatnonzero(lengths > a)
            key = np.zeros(len(rows), np.uint64)
            for b in range(a + 1, min(a + self.longest, table.shape[1]) + 1):
                live = lengths[rows] >= b
                rows, key = rows[live], key[live]
                if not len(rows):
                    break
                key = mix(key * np.uint64(257) + table[rows, b - 1] + np.uint64(1))
                live = self.begins[(key % np.uint64(SLOTS)).astype(np.int64)]
                rows, key = rows[live], key[live]
                at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                hit = self.key[at] == key
                if hit.any():
                    yield a, b, rows[hit], self.order[at[hit]]

    def _alpha(self, parts: list[bytes]):
        lengths = np.array([len(p) for p in parts])
        alpha = np.full((len(parts), int(lengths.max(initial=1)) + 1), -np.inf)
        alpha[:, 0] = 0
        arcs = []
        for a, b, rows, piece in self._arcs(parts):
            alpha[rows, b] = np.logaddexp(alpha[rows, b], alpha[rows, a] + self.logp[piece])
            arcs.append((a, b, rows, piece))
        return lengths, alpha, arcs

    def _one(self, word: bytes) -> list[float]:
        alpha = [0.0] + [-np.inf] * len(word)
        for a in range(len(word)):
            for b in range(a + 1, min(a + self.longest, len(word)) + 1):
                i = self.by_piece.get(word[a:b])
                if i is not None:
                    alpha[b] = np.logaddexp(alpha[b], alpha[a] + self.logp[i])
        return alpha

    def _line(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words one after the other, each with one byte behind it for its end, and the places of the ends."""
        return np.frombuffer(b"".join(p + b"\0" for p in parts), np.uint8), np.cumsum([len(p) + 1 for p in parts]) - 1

    def _slice(self, line: np.ndarray, ends: np.ndarray, lo: int):
        """(start - lo, end - lo, piece, word) of the arcs that start in the slice from lo on, by start."""
        at = np.arange(lo, min(lo + SLICE, len(line)))
        word = np.searchsorted(ends, at)
        rows, key, found = np.arange(len(at)), np.zeros(len(at), np.uint64), []
        for n in range(1, self.longest + 1):
            live = at[rows] + n <= ends[word[rows]]
            rows, key = rows[live], key[live]
            if not len(rows):
                break
            key = mix(key * np.uint64(257) + line[at[rows] + n - 1] + np.uint64(1))
            live = self.begins[(key % np.uint64(SLOTS)).astype(np.int64)]
            rows, key = rows[live], key[live]
            place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[place] == key
            found.append((rows[hit], rows[hit] + n, self.order[place[hit]]))
        a, b, piece = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(a, kind="stable")
        return a[order], b[order], piece[order], word[a[order]]

    def _forward(self, line: np.ndarray, ends: np.ndarray, lo: int, carry: list[float], arcs) -> list[float]:
        """alpha from lo to the end of the slice and as far as an arc reaches; carry: what arcs from before lo bring."""
        alpha = carry + [-math.inf] * min(SLICE, len(line) - lo)
        begins = np.concatenate([[0], ends + 1])
        for i in begins[np.searchsorted(begins, lo):np.searchsorted(begins, min(lo + SLICE, len(line)))].tolist():
            alpha[i - lo] = 0.0
        a, b, piece, _ = arcs
        for x, y, w in zip(a.tolist(), b.tolist(), self.logp[piece].tolist(), strict=True):
            alpha[y] = _logadd(alpha[y], alpha[x] + w)
        return alpha

    def _long(self, parts: list[bytes]):
        """Log probability of each word, and of each slice what arcs from before it bring."""
        line, ends = self._line(parts)
        whole, carries, carry = np.zeros(len(parts)), [], [-math.inf] * (self.longest + 1)
        for lo in range(0, len(line), SLICE):
            carries.append(carry)
            alpha = self._forward(line, ends, lo, carry, self._slice(line, ends, lo))
            size = min(SLICE, len(line) - lo)
            i, j = np.searchsorted(ends, [lo, lo + size])
            whole[i:j] = [alpha[e - lo] for e in ends[i:j].tolist()]
            carry = alpha[size:]
        return line, ends, whole, carries

    def _long_expected(self, parts: list[bytes], count: np.ndarray) -> np.ndarray:
        """expected() of long words: the slices from the last to the first, with alpha made again in each."""
        out = np.zeros(len(self.logp))
        line, ends, whole, carries = self._long(parts)
        beyond = [-math.inf] * (self.longest + 1)
        for lo, carry in zip(reversed(range(0, len(line), SLICE)), reversed(carries), strict=True):
            arcs = self._slice(line, ends, lo)
            alpha = self._forward(line, ends, lo, carry, arcs)
            a, b, piece, word = arcs
            size, logp = min(SLICE, len(line) - lo), self.logp[piece]
            beta = [-math.inf] * size + beyond
            for e in ends[np.searchsorted(ends, lo):np.searchsorted(ends, lo + size)].tolist():
                beta[e - lo] = 0.0
            for x, y, w in zip(a[::-1].tolist(), b[::-1].tolist(), logp[::-1].tolist(), strict=True):
                beta[x] = _logadd(beta[x], w + beta[y])
            uses = np.exp(np.array(alpha)[a] + logp + np.array(beta)[b] - whole[word]) * count[word]
            out += np.bincount(piece, uses, minlength=len(out))
            beyond = beta[:self.longest + 1]
        return out

    def score(self, parts: list[bytes]) -> np.ndarray:
        """Log probability of each word over all its segmentations."""
        out = np.zeros(len(parts))
        size = np.array([len(p) for p in parts], np.int64)
        for lo, hi in ((0, 8), (8, 12), (12, 16), (16, 24), (24, LONG)):
            some = np.flatnonzero((size > lo) & (size <= hi))
            for at in range(0, len(some), 20_000):
                rows = some[at:at + 20_000]
                lengths, alpha, _ = self._alpha([parts[i] for i in rows])
                out[rows] = alpha[np.arange(len(rows)), lengths]
        some = np.flatnonzero(size > LONG)
        if len(some):
            out[some] = self._long([parts[i] for i in some])[2]
        return out

    def expected(self, parts: list[bytes], count: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in words that occur count times."""
        out = np.zeros(len(self.logp))
        size = np.array([len(p) for p in parts], np.int64)
        for lo, hi in ((0, 8), (8, 12), (12, 16), (16, 24), (24, LONG)):
            some = np.flatnonzero((size > lo) & (size <= hi) & (count > 0))
            for at in range(0, len(some), 20_000):
                rows = some[at:at + 20_000]
                lengths, alpha, arcs = self._alpha([parts[i] for i in rows])
                beta = np.full_like(alpha, -np.inf)
                beta[np.arange(len(rows)), lengths] = 0
                whole = alpha[np.arange(len(rows)), lengths]
                for a, b, r, piece in reversed(arcs):
                    through = self.logp[piece] + beta[r, b]
                    beta[r, a] = np.logaddexp(beta[r, a], through)
                    np.add.at(out, piece, np.exp(alpha[r, a] + through - whole[r]) * count[rows[r]])
        some = np.flatnonzero((size > LONG) & (count > 0))
        return out + self._long_expected([parts[i] for i in some], count[some]) if len(some) else out


BLOCK = "bucket int, kind int, block binary, counts binary, words binary, ids binary"
BLOCK_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.binary()), ("counts", pa.binary()), ("words", pa.binary()), ("ids", pa.binary())])
DISTINCT, HELD = 0, 1


def _distinct(raw: bytes, data: np.ndarray, starts: np.ndarray):
    """Occurrences of words: (document, word number, names and bytes of the distinct words)."""
    begin, end, doc, name_a = words(data, starts)
    name_b = words(data, starts, 1)[3]
    order, cuts = bl.split_by([name_a, name_b])
    number = np.zeros(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    first = order[cuts[:-1]]
    return doc, number, name_a[first], [raw[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]


def _count_map(n_buckets: int, keep_documents: bool):
    """Each block: its distinct words with training counts, by bucket; with keep_documents also its documents as word numbers.
    Words are numbered by bucket, so that the buckets' answers, one after the other, are in the order of the numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        for batch, data, starts in bl.blocks(batches):
            low = LOWER[data]
            doc, number, name, text = _distinct(low.tobytes(), low, starts)
            bucket = ((name >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            renumber = np.zeros(len(order), np.int64)
            renumber[order] = np.arange(len(order))
            number, text = renumber[number], [text[i] for i in order]
            train = ~np.array(batch.column("held_out").to_pylist(), bool)
            count = np.bincount(number[train[doc]], minlength=len(text)).astype(np.uint32)
            cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1)).tolist()
            serial += 1
            block = f"{task}-{serial}-{len(data)}".encode()  # the same when the task runs again
            out = [(k, DISTINCT, block, count[a:b].tobytes(), b" ".join(text[a:b]), None)
                   for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            if keep_documents:
                distinct, times = np.unique(doc * max(1, len(text)) + number, return_counts=True)
                of, word = np.divmod(distinct, max(1, len(text)))
                ids = pa.record_batch([batch.column("row"), batch.column("held_out")], names=["row", "held_out"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, ids.schema) as writer:
                    writer.write_batch(ids)
                out.append(((task + serial) % n_buckets, HELD, block, np.bincount(of, minlength=batch.num_rows).astype(np.uint32).tobytes(), bl.pack([word.astype(np.uint32), times.astype(np.uint32)]), sink.getvalue().to_pybytes()))
            yield from bl.rows(out, BLOCK_ARROW)

    return run


def _totals(found: list[tuple[bytes, bytes]]):
    """The bucket's words from (counts, words) of its records: for each record's words their numbers, the training counts, and the
    words' bytes in order of their numbers. It holds each different word once and a number for each word of a record."""
    number: dict[bytes, int] = {}
    which = [np.fromiter((number.setdefault(w, len(number)) for w in text.split(b" ")), np.int64) for _, text in found]
    total = np.zeros(len(number), np.int64)
    for (counts, _), w in zip(found, which, strict=True):
        total[w] += np.frombuffer(counts, np.uint32)  # a record has a word once
    return which, total, list(number)


#: Rows of fit()'s buckets that are no pieces: the training words, and how many different ones there are.
TOKENS, KINDS = -1, -2


def fit(documents: DataFrame, train_docs: int, vocabulary: str | None, n_buckets: int) -> tuple[np.ndarray, int, int]:
    """Log probabilities of the vocabulary's pieces and, last, of the end: expected uses over all segmentations of all training
    words, plus one half; the number of training words and of different ones. One number per piece, whatever the size of the corpus."""
    names, prior = pieces(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for batch in batches for r in zip(batch.column("counts").to_pylist(), batch.column("words").to_pylist(), strict=True)]
        if found:
            _, total, text = _totals(found)
            uses = Lattice(names, prior).expected([SPACE + w for w in text], total)
            some = np.flatnonzero(uses)
            piece = np.concatenate([some, [TOKENS, KINDS]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(np.concatenate([uses[some], [total.sum(), (total > 0).sum()]]))], names=["piece", "uses"])

    uses = documents.mapInArrow(_count_map(n_buckets, False), BLOCK).repartitionById(n_buckets, F.col("bucket")).mapInArrow(run, "piece int, uses double")
    sums = {r["piece"]: r["uses"] for r in uses.groupBy("piece").agg(F.sum("uses").alias("uses")).collect()}  # at most one row per piece
    total = np.full(len(names) + 1, 0.5)
    for piece, n in sums.items():
        if piece >= 0:
            total[piece] += n
    total[-1] += train_docs
    return np.log(total / total.sum()), int(sums.get(TOKENS, 0)), int(sums.get(KINDS, 0))


#: Blocks that a bucket answers with one Arrow batch.
ANSWERS = 200
#: Text bytes of a bucket's share of the corpus, at most.
BUCKET_BYTES = 64 << 20
ANSWER = "block binary, kind int, bucket int, counts binary, words binary, ids binary"
ANSWER_ARROW = pa.schema([("block", pa.binary()), ("kind", pa.int32()), ("bucket", pa.int32()), ("counts", pa.binary()), ("words", pa.binary()), ("ids", pa.binary())])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """All rows of docs with: held_out, n_tokens (words and one end), n_known (tokens that training has), train_tokens, base_score (log10 of the
    add-one word model), score (log10 probability of the text under the piece model).

    Null and empty texts are one end. A null id has no remainder and trains. Repeated rows count as often as they occur. An empty
    table gives an empty result. Input columns with the names of results are replaced.
    """
    spark = docs.sparkSession
    bl.prepare(spark)
    new = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rest = [c for c in docs.columns if c not in new and c != text_col]
    out_of = F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(folds)) == held_out, F.lit(False))
    held = docs.select(F.struct(*[f"`{c}`" for c in rest]).alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), out_of.alias("held_out"))
    size = held.agg(F.count_if(~F.col("held_out")).alias("train"), F.sum(F.octet_length("text")).alias("bytes")).first()
    train_docs, n_buckets = size["train"], max(bl.buckets(spark), -(-(size["bytes"] or 0) // BUCKET_BYTES))
    logp, train_words, train_kinds = fit(held.select("text", "held_out"), train_docs, vocabulary, n_buckets)
    names, _ = pieces(vocabulary)
    tokens, kinds = train_words + train_docs, train_kinds + (1 if train_docs else 0)
    end = float(logp[-1])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blocks_, found = TaskContext.get().partitionId(), [], []
        for batch in batches:
            kept = batch.column("kind").to_numpy(zero_copy_only=False) == HELD
            if kept.any():  # documents go on at once, only words are gathered
                yield batch.filter(pa.array(kept)).select(ANSWER_ARROW.names)
            part = batch.filter(pa.array(~kept))
            blocks_ += part.column("block").to_pylist()
            found += zip(part.column("counts").to_pylist(), part.column("words").to_pylist(), strict=True)
        if found:
            which, total, text = _totals(found)
            found.clear()
            score = Lattice(names, logp[:-1]).score([SPACE + w for w in text])
            for at in range(0, len(blocks_), ANSWERS):
                yield from bl.rows([(block, DISTINCT, bucket, None, bl.pack([total[w], score[w]]), None) for block, w in zip(blocks_[at:at + ANSWERS], which[at:at + ANSWERS], strict=True)], ANSWER_ARROW)

    def close(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: (-r["kind"], r["bucket"]))
        block, answers = parts[0], parts[1:]
        total, score = bl.unpack_all([a["words"] for a in answers], "i8 f8")
        ids = pa.ipc.open_stream(block["ids"]).read_all()
        per_doc = np.frombuffer(block["counts"], np.uint32)
        word, times = bl.unpack(block["words"], "u4 u4")
        of, times = np.repeat(np.arange(len(per_doc)), per_doc), times.astype(np.int64)
        sum_of = lambda v: np.bincount(of, v, minlength=len(per_doc))
        n_tokens = sum_of(times).astype(np.int64) + 1
        known = sum_of(times * (total[word] > 0)).astype(np.int64) + (1 if train_docs else 0)
        base_score = sum_of(times * np.log10(total[word] + 1.0)) + np.log10(train_docs + 1.0) - n_tokens * np.log10(tokens + 1.0 * (kinds + 1))
        score = (sum_of(times * score[word]) + end) / np.log(10)
        return pa.table([ids.column("row"), ids.column("held_out"), pa.array(n_tokens), pa.array(known), pa.array(np.full(len(n_tokens), tokens)), pa.array(base_score), pa.array(score)], names=["row", *new])

    kind = held.schema["row"].dataType.simpleString()
    blocks_ = held.mapInArrow(_count_map(n_buckets, True), BLOCK).repartitionById(n_buckets, F.col("bucket")).mapInArrow(answer, ANSWER)
    return blocks_.groupBy("block").applyInArrow(close, f"row {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").select("row.*", *new)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
