"""Questions that chunks of documents put to the whole corpus.

Some operators need, for each n-gram of a document, what the corpus knows of
it. A row for each n-gram would shuffle several times the input. Here documents
are first written as a table of chunks (some hundred thousand words each). A
chunk sends each bucket of the hash space one row: its distinct n-grams of that
bucket in hash order, packed. A bucket's task sees all chunks' rows and answers
each with one row, in the same order. An n-gram costs a chunk a few bytes,
however often it occurs there, so no key is hot; the number of buckets grows
with the corpus, so a task's share does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiwatch.llm.common import id_and_text, written

CHUNK_CHARS = 2_500_000
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id: after all others

CHUNKS = "chunk string, chars long, doc_id array<long>, size array<int>, texts binary"


def pack(x: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(wide, -1).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """As pack(), for ascending uint64: the differences."""
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def chunked(docs: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The table of chunks of ``docs``, written: every later step reads the
    same chunks, also after a task ran again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        ids: list[int] = []
        texts: list[str] = []

        def chunk() -> pa.RecordBatch:
            raw = [t.encode() for t in texts]
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(raw))
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([sum(map(len, texts))], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([list(map(len, raw))], pa.list_(pa.int32())), pa.array([blob], pa.binary())], names=["chunk", "chars", "doc_id", "size", "texts"])

        chars = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text)
                chars += len(text) + 1
                if chars >= chunk_chars:
                    yield chunk()
                    ids, texts, chars = [], [], 0
        if texts:
            yield chunk()

    return written(id_and_text(docs).mapInArrow(run, CHUNKS), "chunks")


def texts_of(size: list[int], blob: bytes) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, sum(size)))
    at = np.concatenate([[0], np.cumsum(size)]).tolist()
    return [raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)]


def ids_of(ids: list[int | None]) -> np.ndarray:
    return np.array([NO_ID if i is None else i for i in ids], np.int64)


def buckets_for(chunks: DataFrame, chars_each: int = 5_000_000) -> int:
    """A power of two such that a bucket has the n-grams of about ``chars_each`` characters."""
    chars = chunks.agg(F.sum("chars")).first()[0] or 0
    return 1 << max(3, (chars // chars_each).bit_length())


def split_by_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """For ascending uint64 keys, where each bucket (by the leading bits) begins, and the end."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    return np.searchsorted(keys >> shift, np.arange(buckets + 1, dtype=np.uint64))


def with_answers(chunks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Each chunk with its answers (chunk, bucket, ...) as one array column
    ``a0``, ``a1``, ... for each of ``answers``."""
    for i, found in enumerate(answers):
        cols = [c for c in found.columns if c != "chunk"]
        got = found.groupBy("chunk").agg(F.collect_list(F.struct(*cols)).alias(f"a{i}"))  # a row for each bucket
        chunks = chunks.join(got, "chunk", "left")
    return chunks
