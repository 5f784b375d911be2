"""Alignment of two tokenizers: groups, links and how common each link is.

Both tokenizers cut the same bytes. Where tokens of both end, the text parts
into groups; two tokens are linked if their bytes overlap. The byte ends of a
document are two ascending lists; the shorter one drives a galloping search into
the longer: each end starts there at the place of its rank in proportion, doubles its step
until the end is bracketed, and halves the bracket. The ranks found say all: where the
ends are equal a group ends, and between the ranks of a token's two ends lie the
tokens that it overlaps. The lists of a batch of documents are searched side by
side; a document's ends are offset by those before it, so they stay apart.

How many documents hold a pair of ids linked: a chunk of documents counts its
distinct pairs (each document once), Spark adds these up by pair, takes the
highest count of each id of the first tokenizer, and sends each chunk what it
asked for. A chunk keeps its links as places in its list of pairs, so texts are
tokenised once. A pair has at most a row for each chunk, so none is hot.

Cases: null and empty texts, and texts whose joined token bytes are not a space
and the text, have no tokens: zeros and ''; repeated rows are documents of their
own; a null doc_id stays null; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiwatch.llm.chunks import pack, pack_sorted, unpack, unpack_sorted
from epiwatch.llm.common import id_and_text, in_batches, read_table, totals, written
from epiwatch.llm.token_counts import _byte_of_char

CHUNK_CHARS = 2_500_000
MARK = "▁"
#: Fixed value: the published pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_TEXT = 20_000  # characters


class Tokenizers:
    """A byte-level BPE (of the tokenizers library) and a SentencePiece model,
    with the bytes of every id. The second puts a space before the text; the
    first is given one.

    Where the first's file has its merges in the order of ids, tiktoken with
    this vocabulary gives the same ids faster; texts over ``LONG_TEXT`` go to
    the tokenizers library, whose time does not grow with the square of a long
    run without a break."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        to_byte = _byte_of_char()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(map(to_byte.__getitem__, token)) if to_byte.keys() >= set(token) else token.encode()
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        vocabulary, plain = spec["model"]["vocab"], {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.fast = None
        if (spec["normalizer"] is None and plain.items() <= spec["pre_tokenizer"].items()
                and all(vocabulary["".join(m)] == 256 + k for k, m in enumerate(merges))):
            ranks = {self.a_bytes[i]: i for i in range(256 + len(merges))}
            self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        b = self.b
        self.b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace(MARK, " ").encode()
                        for i in range(b.get_piece_size())]
        self.a_size, self.b_size = (np.array(list(map(len, t)), np.int64) for t in (self.a_bytes, self.b_bytes))

    def encode_a(self, text: str) -> list[int]:
        if self.fast is not None and len(text) <= LONG_TEXT:
            return self.fast.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both; none of a text that is empty or whose bytes they change."""
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for text, ids_b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            spaced = " " + text
            ids_a, raw = self.encode_a(spaced), spaced.encode()
            same = text and all(b"".join(map(t.__getitem__, ids)) == raw for t, ids in ((self.a_bytes, ids_a), (self.b_bytes, ids_b)))
            a.append(np.array(ids_a if same else [], np.int64))
            b.append(np.array(ids_b if same else [], np.int64))
        return a, b


@lru_cache(2)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def gallop(values: np.ndarray, into: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each of ``values`` the first place of the ascending ``into`` that is
    not less, searched from the place ``at``; the last of ``into`` is at least
    as great as every value."""
    low, high = at.copy(), at.copy()
    up = np.flatnonzero(into[at] < values)
    down = np.flatnonzero(into[at] >= values)
    step = 1
    while len(up):  # low is less; high goes on until it is not
        low[up] = high[up]
        high[up] = np.minimum(high[up] + step, len(into) - 1)
        up, step = up[into[high[up]] < values[up]], 2 * step
    step = 1
    while len(down):  # high is not less; low goes back until it is
        high[down] = low[down]
        low[down] = np.maximum(low[down] - step, -1)
        down, step = down[low[down] >= 0], 2 * step
        down = down[into[low[down]] >= values[down]]
    wide = np.flatnonzero(high - low > 1)
    while len(wide):
        middle = (low[wide] + high[wide]) >> 1
        less = into[middle] < values[wide]
        low[wide[less]] = middle[less]
        high[wide[~less]] = middle[~less]
        wide = wide[high[wide] - low[wide] > 1]
    return high


def firsts(count: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])


def align(short: np.ndarray, short_first: np.ndarray, long: np.ndarray, long_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For ends of documents side by side (``first``: where each begins): whether
    each end is common, in both lists, and for each token of the shorter lists
    the first token that it overlaps and how many."""
    n_short, n_long = np.diff(short_first), np.diff(long_first)
    rank = np.arange(len(short)) - np.repeat(short_first[:-1], n_short)
    at = gallop(short, long, np.repeat(long_first[:-1], n_short) + rank * np.repeat(n_long, n_short) // np.repeat(n_short, n_short))
    common = long[at] == short
    start = np.empty(len(short), np.int64)
    start[1:] = (at + common)[:-1]
    start[short_first[:-1][n_short > 0]] = long_first[:-1][n_short > 0]
    common_long = np.zeros(len(long), bool)
    common_long[at[common]] = True
    return common, common_long, start, at - start + 1


class Aligned:
    """The alignment of a batch of documents (lists of ids of both tokenizers,
    both empty or neither): counts by document, ``links`` (pairs of ids as one
    number, document by document) and ``groups`` (their digest)."""

    def __init__(self, tok: Tokenizers, a: list[np.ndarray], b: list[np.ndarray]) -> None:
        self.n_a, self.n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        self.n_groups, self.n_links = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        self.groups = [""] * len(a)
        parts: list[np.ndarray] = []
        order: list[np.ndarray] = []
        for a_short in (True, False):
            some = np.flatnonzero((self.n_a > 0) & ((self.n_a <= self.n_b) == a_short))
            if len(some):
                order.append(some)
                parts.append(self._side(tok, a, b, some, a_short))
        self.links = np.zeros(0, np.int64)
        if parts:  # back into the order of the documents
            docs = np.concatenate(order)
            doc = np.repeat(docs, self.n_links[docs])
            self.links = np.concatenate(parts)[np.argsort(doc, kind="stable")]

    def _side(self, tok: Tokenizers, a: list[np.ndarray], b: list[np.ndarray], some: np.ndarray, a_short: bool) -> np.ndarray:
        ids, first, ends = [], [], []
        for lists, size in ((a, tok.a_size), (b, tok.b_size)):
            ids.append(np.concatenate([lists[d] for d in some.tolist()]))
            first.append(firsts(np.array([len(lists[d]) for d in some.tolist()])))
            ends.append(np.cumsum(size[ids[-1]]))  # both lists of a document have as many bytes
        s, t = (0, 1) if a_short else (1, 0)
        common_s, common_t, start, count = align(ends[s], first[s], ends[t], first[t])
        common = (common_s, common_t) if a_short else (common_t, common_s)
        before = firsts(common_s)
        self.n_groups[some] = np.diff(before[first[s]])
        self.n_links[some] = totals(count, first[s])
        left = np.repeat(np.arange(len(ids[s])), count)
        right = np.arange(len(left)) + np.repeat(start - firsts(count)[:-1], count)
        pair = (ids[s][left], ids[t][right]) if a_short else (ids[t][right], ids[s][left])
        self._digests(some, ids, first, common)
        return (pair[0] << 32) | pair[1]

    def _digests(self, some: np.ndarray, ids: list[np.ndarray], first: list[np.ndarray], common: tuple[np.ndarray, np.ndarray]) -> None:
        """A token is written after those of the groups before it and, if of the
        second tokenizer, after its group's of the first."""
        group = [firsts(c)[:-1] for c in common]
        until = [np.flatnonzero(c) + 1 for c in common]  # where each group ends
        from_b = np.concatenate([[0], until[1]])
        place = (np.arange(len(ids[0])) + from_b[group[0]], np.arange(len(ids[1])) + until[0][group[1]])
        written_ids = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        for k in (0, 1):
            written_ids[place[k]] = 3 * ids[k] + np.where(common[k], 1 + k, 0)
        texts = _numbers()[written_ids].tolist()
        edge = (first[0] + first[1]).tolist()
        for k, d in enumerate(some.tolist()):
            self.groups[d] = hashlib.sha256("".join(texts[edge[k]:edge[k + 1]])[:-1].encode()).hexdigest()


@lru_cache(1)
def _numbers(most: int = 1 << 17) -> np.ndarray:
    """Numbers as text, each with the three marks after it: within a list, after the first list, after the second."""
    return np.array([f"{i}{mark}" for i in range(most) for mark in ",|;"], object)


CHUNKS = ("chunk string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, "
          "pairs binary, docs binary, links binary")


def alignments(docs: DataFrame, a_path: str, b_path: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The table of chunks, written: documents with their counts, the distinct
    pairs of the chunk, how many of its documents hold each, and the links as
    places in the list of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(a_path, b_path)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for x, y in in_batches(texts, chunk_chars):
                both = ([], [])
                for u, v in in_batches(texts[x:y], 200_000):  # the library's objects for a few texts at a time
                    for out, some in zip(both, tok.encode(texts[x + u:x + v]), strict=True):
                        out.extend(some)
                got = Aligned(tok, *both)
                links, pairs = pd.factorize(got.links, sort=True)
                doc = np.repeat(np.arange(y - x), got.n_links)
                once = pd.unique(doc * max(1, len(pairs)) + links)
                held = np.bincount(once % max(1, len(pairs)), minlength=len(pairs))
                counts = [[c.tolist()] for c in (got.n_a, got.n_b, got.n_groups, got.n_links)]
                packed = [pack_sorted(pairs.astype(np.uint64)), pack(held.astype(np.uint32)), pack(links.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().hex]), pa.array([ids[x:y]], pa.list_(pa.int64())), *(pa.array(c, pa.list_(pa.int64())) for c in counts),
                     pa.array([got.groups], pa.list_(pa.string())), *(pa.array([p], pa.binary()) for p in packed)],
                    names=[c.split()[0] for c in CHUNKS.split(", ")])

    return written(id_and_text(docs).mapInArrow(run, CHUNKS), "alignments")


def held_pairs(chunks: DataFrame) -> DataFrame:
    """(chunk, pair, n): a row for each distinct pair of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs = unpack_sorted(row["pairs"]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row["chunk"], object), pa.string()), pa.array(pairs),
                                                  pa.array(unpack(row["docs"], np.uint32).astype(np.int64))], names=["chunk", "pair", "n"])

    return chunks.select("chunk", "pairs", "docs").mapInArrow(run, "chunk string, pair long, n long")


def pair_counts(held: DataFrame) -> DataFrame:
    """(pair, n, best) over the corpus; ``best``: no pair of that first id has more."""
    counts = written(held.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts").withColumn("a", F.shiftright("pair", 32))
    return counts.join(counts.groupBy("a").agg(F.max("n").alias("most")), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document: tokens of both, groups, links, links that are
    the commonest of their first id, the sum of the links' counts, the digest."""
    chunks = alignments(docs, a_path, b_path)
    held = held_pairs(chunks)
    answers = held.select("chunk", "pair").join(pair_counts(held), "pair").groupBy("chunk").agg(F.collect_list(F.struct("pair", "n", "best")).alias("answer"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                batch = whole.slice(k, 1)
                row = {c: batch.column(c)[0] for c in batch.schema.names}
                n_links = np.array(row["n_links"].as_py(), np.int64)
                links = unpack(row["links"].as_py(), np.uint32)
                first = firsts(n_links)
                if len(links):
                    answer = row["answer"].values
                    order = np.argsort(answer.field("pair").to_numpy(zero_copy_only=False))
                    n = answer.field("n").to_numpy(zero_copy_only=False)[order][links]
                    best = answer.field("best").to_numpy(zero_copy_only=False)[order][links].astype(np.int64)
                else:
                    n = best = np.zeros(0, np.int64)
                lists = [row[c].values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array(totals(best, first)), pa.array(totals(n, first)), row["groups"].values],
                                                 names=[c.split()[0] for c in RESULT.split(", ")])

    found = chunks.join(answers, "chunk", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "answer")
    return found.mapInArrow(run, RESULT)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(read_table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")),
                     str(public_tokenizers.path("piece_bpe_32k.model")))
