"""Language-model scoring with an Elias-Fano n-gram trie.

The model is a bigram model with Dirichlet smoothing towards the unigrams:
p(w | c) = (n(c, w) + k p(w)) / (n(c) + k), p(w) = (n(w) + 1) / (N + V + 1). It
is learned from all training documents and is never in one place: the hash of
the context deals n-grams to buckets, each with a trie of its own. Level 1 holds
the contexts, with monotone pointers to their ranges in level 2, which holds the
successors of each context and the quantised log10 of n(c, w) / (n(c) + k). The
monotone sequences are in Elias-Fano form in a temporary file that is mapped
into memory; a lookup finds the context, then searches the successor among those
relative to it.

Chunks of documents send a bucket their distinct n-grams with training counts,
the bucket's task adds them up, builds the trie and answers the same n-grams
(see `chunks`). Successors of contexts that make up a part of all tokens worth
splitting (there are at most ``1 / HEAVY`` of them) go to many buckets.

Cases: a null or empty text is the end token alone; a row without doc_id counts
as a training row (crc32 of the empty text); without training rows N = V = 0
and every token has probability 1; repeated rows are documents of their own.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiwatch.llm.chunks import buckets_for, chunked, pack, pack_sorted, texts_of, unpack, unpack_sorted, with_answers
from epiwatch.llm.common import Words, mix, read_table, totals, written

END, BEGIN = np.uint64(0x1D0B_5EED_0E4D_0001), np.uint64(0x1D0B_5EED_0E4D_0002)  # hashes of the two ends
SUCCESSOR_BITS = 40  # of a successor's hash, relative to its context
HEAVY = 1 / 200  # share of all tokens from which a context's successors are split
SPLIT = 64
STEP, FLOOR = 0.05, -12.0  # quantisation of log10 probabilities; code 0: not seen


class EliasFano:
    """A monotone sequence of unsigned integers: low bits packed, high bits in
    unary. Arrays go to a file and come back mapped."""

    def __init__(self, values: np.ndarray, file) -> None:
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low_bits = max(0, (top // max(1, self.n)).bit_length() - 1)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        unary = np.zeros(int(high[-1]) + self.n + 1 if self.n else 1, np.uint8)
        unary[high + np.arange(self.n)] = 1
        low = np.empty((self.n, self.low_bits), np.uint8)
        for j in range(self.low_bits):
            low[:, j] = (values >> np.uint64(j)) & np.uint64(1)
        self.high = _mapped(np.packbits(unary), file)
        self.low = _mapped(np.packbits(low.ravel()), file)

    def values(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.uint64)
        high = np.flatnonzero(np.unpackbits(self.high))[:self.n] - np.arange(self.n)
        out = high.astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            for j in range(self.low_bits):
                out |= bits[:, j].astype(np.uint64) << np.uint64(j)
        return out


def _mapped(x: np.ndarray, file) -> np.ndarray:
    if not len(x):
        return x
    at = file.seek(0, 2)
    file.write(x.tobytes())
    file.flush()
    return np.memmap(file, x.dtype, "r", offset=at, shape=x.shape)


class Trie:
    """Two levels: contexts with pointers, successors with codes."""

    def __init__(self, contexts: np.ndarray, context_of: np.ndarray, successor: np.ndarray, code: np.ndarray, file) -> None:
        pointers = np.searchsorted(context_of, np.arange(len(contexts) + 1))
        self.contexts = EliasFano(contexts, file)
        self.pointers = EliasFano(pointers.astype(np.uint64), file)
        # Monotone over the level: the successors of a context follow those of the context before.
        self.successors = EliasFano((context_of.astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | successor, file)
        self.codes = _mapped(code, file)

    def lookup(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of (context, successor); 0 where not seen. Contexts are in level 1."""
        if not self.successors.n:
            return np.zeros(len(context), np.uint8)
        level1, pointers, level2 = self.contexts.values(), self.pointers.values().astype(np.int64), self.successors.values()
        c = np.searchsorted(level1, context)
        want = (c.astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | successor
        at = np.searchsorted(level2, want)  # the next successor of the level
        inside = (at >= pointers[c]) & (at < pointers[c + 1])
        at = np.minimum(at, len(level2) - 1)
        return np.where(inside & (level2[at] == want), np.asarray(self.codes)[at], 0).astype(np.uint8)


def quantised(log10_p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((log10_p - FLOOR) / STEP) + 1, 1, 255).astype(np.uint8)


def restored(code: np.ndarray) -> np.ndarray:
    """Probabilities of codes; 0 for code 0."""
    return np.where(code > 0, 10.0 ** ((code.astype(np.float64) - 1) * STEP + FLOOR), 0.0)


def is_held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


class _Chunk:
    """The tokens and n-grams of a chunk. ``types`` are its distinct tokens in
    hash order, the last context (after them) is the beginning of a text."""

    def __init__(self, row: dict, folds: int, fold: int) -> None:
        w = Words(texts_of(row["size"], row["texts"]), lower=True)
        n = w.count
        self.held_out = np.array([is_held_out(i, folds, fold) for i in row["doc_id"]], bool)
        last = np.cumsum(n + 1) - 1  # place of each text's end token
        token = np.empty(int((n + 1).sum()), np.uint64)
        is_end = np.zeros(len(token), bool)
        is_end[last] = True
        token[is_end], token[~is_end] = END, w.hashes()
        self.first = np.concatenate([[0], last + 1])
        self.trains = np.repeat(~self.held_out, n + 1)
        self.types, self.token = np.unique(token, return_inverse=True)
        self.count = np.bincount(self.token, weights=self.trains, minlength=len(self.types)).astype(np.int64)
        self.context = np.concatenate([[0], self.token[:-1]])
        self.context[self.first[:-1]] = len(self.types)

    def pairs(self, buckets: int, heavy: np.ndarray) -> None:
        """Distinct (context, successor) in the order they are asked, and the
        contexts each bucket is told of."""
        name = np.append(self.types, BEGIN)
        counts = np.append(self.count, int((~self.held_out).sum()))
        shift = np.uint64(64 - (buckets.bit_length() - 1))
        home = (mix(name) >> shift).astype(np.int64)
        is_heavy = np.isin(name, heavy)
        key = (self.context.astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | (self.types[self.token] >> np.uint64(64 - SUCCESSOR_BITS))
        key, which = np.unique(key, return_inverse=True)
        times = np.bincount(which, weights=self.trains, minlength=len(key)).astype(np.uint32)
        context = (key >> np.uint64(SUCCESSOR_BITS)).astype(np.int64)
        successor = key & np.uint64((1 << SUCCESSOR_BITS) - 1)
        bucket = home[context]
        at = np.flatnonzero(is_heavy[context])
        bucket[at] = (mix(name[context[at]] + successor[at] % np.uint64(SPLIT) + np.uint64(1)) >> shift).astype(np.int64)
        rank = np.argsort(np.argsort(name, kind="stable"), kind="stable")  # contexts in hash order
        order = np.lexsort([successor, rank[context], bucket])
        self.pair = np.empty(len(order), np.int64)
        self.pair[order] = np.arange(len(order))
        self.pair = self.pair[which]  # of each token
        self.pair_bucket, self.successor, self.times = bucket[order], successor[order], times[order]
        parts = np.arange(SPLIT, dtype=np.uint64) + np.uint64(1)
        told = [np.arange(len(name)), *(np.full(SPLIT, c) for c in np.flatnonzero(is_heavy))]
        where = [home, *((mix(name[c] + parts) >> shift).astype(np.int64) for c in np.flatnonzero(is_heavy))]
        entry = np.unique((np.concatenate(where).astype(np.uint64) << np.uint64(32)) | rank[np.concatenate(told)].astype(np.uint64))
        by_rank = np.argsort(rank)
        self.entry_context = by_rank[(entry & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        self.entry_bucket = (entry >> np.uint64(32)).astype(np.int64)
        pair_entry = (self.pair_bucket.astype(np.uint64) << np.uint64(32)) | rank[context[order]].astype(np.uint64)
        self.entry_pairs = np.searchsorted(pair_entry, entry, "right") - np.searchsorted(pair_entry, entry)
        self.name, self.counts, self.home = name, counts, home


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


ASKED = "chunk string, bucket int, contexts binary, counts binary, successors binary, n_pairs binary, times binary"
ANSWER = "chunk string, bucket int, totals binary, codes binary, tokens long, types long"


def _learn_and_answer(group: pd.DataFrame, buckets: int, prior: float) -> pd.DataFrame:
    """Adds up a bucket's counts, builds its trie, looks up what was asked."""
    bucket = int(group["bucket"].iloc[0])
    contexts = [unpack_sorted(x) for x in group["contexts"]]
    level1, which = np.unique(np.concatenate(contexts), return_inverse=True)
    count = np.bincount(which, weights=np.concatenate([unpack(x, np.int64) for x in group["counts"]]), minlength=len(level1)).astype(np.int64)
    successors = np.concatenate([unpack(x, np.uint64) for x in group["successors"]])
    context = np.repeat(which, np.concatenate([unpack(x, np.uint32) for x in group["n_pairs"]]))
    times = np.concatenate([unpack(x, np.uint32) for x in group["times"]])
    seen = times > 0
    key, at = np.unique((context[seen].astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | successors[seen], return_inverse=True)
    n = np.bincount(at, weights=times[seen], minlength=len(key))
    of = (key >> np.uint64(SUCCESSOR_BITS)).astype(np.int64)
    with tempfile.TemporaryFile() as file:
        trie = Trie(level1, of, key & np.uint64((1 << SUCCESSOR_BITS) - 1), quantised(np.log10(n / (count[of] + prior))), file)
        code = trie.lookup(level1[context], successors)
    pairs = np.cumsum([len(unpack(x, np.uint32)) for x in group["times"]])[:-1]
    own = (mix(level1) >> np.uint64(64 - (buckets.bit_length() - 1)) == bucket) & (level1 != BEGIN)
    out = pd.DataFrame({"chunk": group["chunk"].to_numpy(), "bucket": bucket,
                        "totals": [pack(x) for x in np.split(count[which], np.cumsum(list(map(len, contexts)))[:-1])],
                        "codes": [pack(x) for x in np.split(code, pairs)], "tokens": 0, "types": 0})
    out.loc[0, ["tokens", "types"]] = int(count[own].sum()), int((count[own] > 0).sum())
    return out


def score(docs: DataFrame, folds: int = 7, fold: int = 2, prior: float = 200.0, chunk_chars: int = 5_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)
    for every row of ``docs``; rows whose crc32(doc_id) mod ``folds`` is
    ``fold`` are not learned from. ``prior`` is k."""
    chunks = chunked(docs, chunk_chars)
    buckets = buckets_for(chunks)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = _Chunk(row, folds, fold)
            n = np.bincount(c.token, minlength=len(c.types))
            some = np.flatnonzero(n > HEAVY / 2 * len(c.token))
            yield pa.RecordBatch.from_arrays([pa.array([0, *c.types[some].view(np.int64).tolist()], pa.int64()), pa.array([len(c.token), *n[some].tolist()], pa.int64())], names=["token", "n"])

    often = chunks.mapInArrow(frequent, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    often = written(often, "frequent")
    every = often.where("token = 0").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    rows = often.where((F.col("n") > HEAVY * every) & (F.col("token") != 0)).select("token").collect()  # 1 / HEAVY rows at most
    heavy = np.array([x[0] for x in rows] + [int(BEGIN.view(np.int64))], np.int64).view(np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = _Chunk(row, folds, fold)
            c.pairs(buckets, heavy)
            e = np.searchsorted(c.entry_bucket, np.arange(buckets + 1)).tolist()
            p = np.searchsorted(c.pair_bucket, np.arange(buckets + 1)).tolist()
            some = [b for b in range(buckets) if e[b] < e[b + 1]]
            of = [c.entry_context[e[b]:e[b + 1]] for b in some]
            cols = [[pack_sorted(c.name[x]) for x in of], [pack(c.counts[x]) for x in of], [pack(c.successor[p[b]:p[b + 1]]) for b in some],
                    [pack(c.entry_pairs[e[b]:e[b + 1]].astype(np.uint32)) for b in some], [pack(c.times[p[b]:p[b + 1]]) for b in some]]
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(some), pa.string()), pa.array(some, pa.int32()), *(pa.array(x, pa.binary()) for x in cols)],
                                             names=[x.split()[0] for x in ASKED.split(", ")])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        return _learn_and_answer(group, buckets, prior)

    answers = written(chunks.mapInArrow(ask, ASKED).groupBy("bucket").applyInPandas(answer, ANSWER), "ngrams")
    learned = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    tokens, types = int(learned[0]), int(learned[1])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = _Chunk(row, folds, fold)
            c.pairs(buckets, heavy)
            total, code = np.zeros(len(c.name), np.int64), np.zeros(len(c.successor), np.uint8)
            e, p = (np.searchsorted(x, np.arange(buckets + 1)) for x in (c.entry_bucket, c.pair_bucket))
            for a in row["a0"]:
                b = a["bucket"]
                total[c.entry_context[e[b]:e[b + 1]]] = unpack(a["totals"], np.int64)
                code[p[b]:p[b + 1]] = unpack(a["codes"], np.uint8)
            known = total[c.token]
            unigram = (known + 1) / (tokens + types + 1)
            p_token = restored(code)[c.pair] + prior / (total[c.context] + prior) * unigram
            sums = [np.add.reduceat(x, c.first[:-1]) for x in (np.log10(unigram), np.log10(p_token))]
            n = np.diff(c.first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_id"], pa.int64()), pa.array(c.held_out), pa.array(n, pa.int64()), pa.array(totals(known > 0, c.first), pa.int64()),
                 pa.array(np.full(len(n), tokens), pa.int64()), pa.array(sums[0]), pa.array(sums[1])],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return with_answers(chunks, answers.select("chunk", "bucket", "totals", "codes")).mapInArrow(
        scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))
