"""Substring dedup by fixed-block anchors.

A window of 13 words holds a whole aligned block of 7 words, wherever it lies.
So each document's non-overlapping blocks of 7 words are indexed, and every
rolling window of 7 words of every document is a probe. Where a probe of one
chunk of documents meets a block of another, or of its own, the hit is extended
to the windows of 13 words around it: a repeat of n >= 13 words is n - 12 such
windows in a row, so their union is the maximal repeat. Windows that are not
near a hit can occur nowhere else and are not compared.

Anchors are exchanged as described in `chunks`, then the windows around hits,
with 96 bits of hash and the smallest doc_id that holds them in the chunk; the
answer says whether a smaller one holds them elsewhere.

A word is removed if a window over it starts also in a document of a smaller
doc_id; windows are judged on the input. Cases: a null or empty text has no
words; fewer than 13 words, nothing is removed; rows that share a doc_id do not
count as smaller than each other; a row without doc_id comes after all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiwatch.llm.chunks import buckets_for, chunked, ids_of, pack, pack_sorted, split_by_bucket, texts_of, unpack, unpack_sorted, with_answers
from epiwatch.llm.common import Words, grams, read_table, written

#: Anchor hashes keep this many bits beside the bucket's: a false hit costs a needless comparison, no error.
ANCHOR_BITS = 32


class _Chunk:
    """The words, probes and blocks of a chunk."""

    def __init__(self, row: dict, window: int, block: int) -> None:
        self.words = Words(texts_of(row["size"], row["texts"]))
        self.ids = ids_of(row["doc_id"])
        self.hashes = self.words.hashes()
        self.window, self.block = window, block

    def anchors(self, buckets: int) -> None:
        """Distinct probes (ascending, shortened) as ``keys``, and whether a
        document here has them as a block; ``probe_at``, ``probe_key``: each
        probe's place and index of its key."""
        g, at = grams(self.hashes, self.words.doc, self.block)
        keep = ANCHOR_BITS + buckets.bit_length() - 1
        g = (g >> np.uint64(64 - keep)) << np.uint64(64 - keep)
        self.keys, self.probe_key = np.unique(g, return_inverse=True)
        self.probe_at = at
        aligned = (at - self.words.first[self.words.doc[at]]) % self.block == 0
        self.is_block = np.zeros(len(self.keys), bool)
        self.is_block[self.probe_key[aligned]] = True

    def windows(self) -> None:
        """Every window's place and hash, and its index among the distinct
        ones, with the smallest doc_id that holds it here."""
        g, self.at = grams(self.hashes, self.words.doc, self.window, seed=13)
        self.hash, first, self.which = np.unique(g, return_index=True, return_inverse=True)
        self.sample = self.at[first]
        self.least = np.full(len(self.hash), np.iinfo(np.int64).max)
        self.doc = self.ids[self.words.doc[self.at]]
        np.minimum.at(self.least, self.which, self.doc)

    def near_hits(self, shared: np.ndarray) -> np.ndarray:
        """Which distinct windows hold a shared probe."""
        hit = np.zeros(len(self.hashes) + 1, np.int64)
        hit[self.probe_at[shared[self.probe_key]] + 1] = 1
        hit = np.cumsum(hit)
        inside = hit[self.at + self.window - self.block + 1] > hit[self.at]
        out = np.zeros(len(self.hash), bool)
        out[self.which[inside]] = True
        return out


def _bits(answers: list[dict] | None, n: int, cuts: np.ndarray, column: str = "bits") -> np.ndarray:
    """The answers of all buckets, set end to end in the order of the keys."""
    out = np.zeros(n, bool)
    for a in answers or []:
        lo, hi = int(cuts[a["bucket"]]), int(cuts[a["bucket"] + 1])
        out[lo:hi] = np.unpackbits(np.frombuffer(a[column], np.uint8), count=hi - lo).astype(bool)
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _meet(group: pd.DataFrame) -> pd.DataFrame:
    """Which probes are shared: in more than one chunk, and a block in some."""
    keys = [unpack_sorted(x) for x in group["keys"]]
    every = np.concatenate(keys)
    value, count = np.unique(every, return_counts=True)
    blocks = [k[np.unpackbits(np.frombuffer(b, np.uint8), count=len(k)).astype(bool)] for k, b in zip(keys, group["blocks"], strict=True)]
    shared = value[(count > 1) & np.isin(value, np.concatenate(blocks))]
    bits = [np.packbits(np.isin(k, shared, assume_unique=True)).tobytes() for k in keys]
    return pd.DataFrame({"chunk": group["chunk"], "bucket": group["bucket"], "bits": bits})


def _least(group: pd.DataFrame) -> pd.DataFrame:
    """Which windows a smaller doc_id holds in another chunk."""
    keys = [unpack_sorted(x) for x in group["keys"]]
    sizes = list(map(len, keys))
    whole = np.concatenate(keys)
    check = np.concatenate([unpack(x, np.uint32) for x in group["checks"]])
    least = np.concatenate([unpack(x, np.int64) for x in group["least"]])
    order = np.lexsort([check, whole])
    new = np.concatenate([[True], (whole[order][1:] != whole[order][:-1]) | (check[order][1:] != check[order][:-1])])
    first = np.minimum.reduceat(least[order], np.flatnonzero(new))
    smaller = np.empty(len(whole), bool)
    smaller[order] = first[np.cumsum(new) - 1] < least[order]
    bits = [np.packbits(x).tobytes() for x in np.split(smaller, np.cumsum(sizes)[:-1])]
    return pd.DataFrame({"chunk": group["chunk"], "bucket": group["bucket"], "bits": bits})


def substring_dedup(docs: DataFrame, window: int = 13, chunk_chars: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of ``docs``: ``kept``
    are the words that stay, joined by one space."""
    block = (window + 1) // 2
    chunks = chunked(docs, chunk_chars) if chunk_chars else chunked(docs)
    buckets = buckets_for(chunks)

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = _Chunk(row, window, block)
            c.anchors(buckets)
            cuts = split_by_bucket(c.keys, buckets)
            some = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            part = [slice(int(cuts[b]), int(cuts[b + 1])) for b in some]
            scale = np.uint64(64 - ANCHOR_BITS - (buckets.bit_length() - 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["chunk"]] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array([pack_sorted(c.keys[p] >> scale) for p in part], pa.binary()),
                 pa.array([np.packbits(c.is_block[p]).tobytes() for p in part], pa.binary())], names=["chunk", "bucket", "keys", "blocks"])

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = _Chunk(row, window, block)
            near = _candidates(c, row)
            keys, least = c.hash[near], c.least[near]
            check = (grams(c.words.hashes(1), np.zeros(len(c.hashes), np.int64), window, seed=17)[0][c.sample[near]] >> np.uint64(32)).astype(np.uint32)
            cuts = split_by_bucket(keys, buckets)
            some = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            part = [slice(int(cuts[b]), int(cuts[b + 1])) for b in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["chunk"]] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array([pack_sorted(keys[p]) for p in part], pa.binary()),
                 pa.array([pack(check[p]) for p in part], pa.binary()), pa.array([pack(least[p]) for p in part], pa.binary())],
                names=["chunk", "bucket", "keys", "checks", "least"])

    def _candidates(c: _Chunk, row: dict) -> np.ndarray:
        c.anchors(buckets)
        c.windows()
        return np.flatnonzero(c.near_hits(_bits(row["a0"], len(c.keys), split_by_bucket(c.keys, buckets))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = _Chunk(row, window, block)
            near = _candidates(c, row)
            keys = c.hash[near]
            elsewhere = np.zeros(len(c.hash), bool)
            elsewhere[near] = _bits(row["a1"], len(keys), split_by_bucket(keys, buckets))
            again = c.at[elsewhere[c.which] | (c.doc > c.least[c.which])]
            edge = np.zeros(len(c.hashes) + 1, np.int64)
            np.add.at(edge, again, 1)
            np.add.at(edge, again + window, -1)
            stays = np.cumsum(edge[:-1]) == 0
            start, end, first = c.words.start.tolist(), c.words.end.tolist(), c.words.first.tolist()
            kept, removed = [], []
            for a, b in zip(first[:-1], first[1:], strict=True):
                at = (np.flatnonzero(stays[a:b]) + a).tolist()
                removed.append(b - a - len(at))
                kept.append(b" ".join([c.words.raw[start[i]:end[i]] for i in at]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_id"], pa.int64()), pa.array(c.words.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept"])

    answer = "chunk string, bucket int, bits binary"
    shared = written(chunks.mapInArrow(ask_anchors, "chunk string, bucket int, keys binary, blocks binary").groupBy("bucket").applyInPandas(_meet, answer), "anchors")
    smaller = written(with_answers(chunks, shared).mapInArrow(ask_windows, "chunk string, bucket int, keys binary, checks binary, least binary")
                      .groupBy("bucket").applyInPandas(_least, answer), "windows")
    return with_answers(chunks, shared, smaller).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
