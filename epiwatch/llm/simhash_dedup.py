"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint is the bitwise majority of the XXH64 of its word shingles.
For a radius r, each of the 64 bits is given a non-zero vector of r + 1 bits;
table v (1 .. 2^(r+1) - 1) keeps the bits whose vector has odd parity with v.
The vectors of r differing bits span less than the whole space, so some v is
orthogonal to all of them: in that table the two fingerprints agree on every
kept bit. Every pair within the radius hence meets in a table; none is lost.

Equal fingerprints are one node, so groups of copies cost a row. Nodes of a
table entry are joined by `common.linked`: connectivity, not pairs.

Cases: null and empty texts have fingerprint 0, which links like any other;
rows that share a doc_id are separate rows with the same component; a null
doc_id never names a component (null if there is no other id in it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiwatch.llm.common import id_and_text, linked, read_table, written

SEED = 42


def fingerprint(text: str, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of ``text``, A-Z lower-cased."""
    words = text.encode().lower().split()  # on bytes: A-Z alone; splits at the separators alone
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    end = (start + size)[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start[:n].tolist(), end, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(h[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, hash, fp): a hash of the text, and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(fp.view(np.int64))], names=["doc_id", "hash", "fp"])

    return id_and_text(docs).withColumn("hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, hash long, fp long")


def covering_masks(radius: int) -> list[int]:
    """Bit masks such that two 64-bit words that differ in at most ``radius``
    bits agree under one of them."""
    tables = 2 ** (radius + 1) - 1
    vector = [i % tables + 1 for i in range(64)]
    return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2) for v in range(1, tables + 1)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, hashed: bool = False) -> DataFrame:
    """(doc_id, fp, component_id) for every row, or (doc_id, hash, root) with
    ``hashed``: documents are linked if their
    fingerprints differ in at most ``radius`` bits, and a component is named by
    its smallest doc_id."""
    rows = written(fingerprints(docs, shingle), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    masks = F.array(*(F.lit(_signed(m)) for m in covering_masks(radius)))
    members = nodes.select(F.col("fp").alias("id"), "n", F.posexplode(masks).alias("table", "mask")).select(
        F.xxhash64("table", F.col("id").bitwiseAND(F.col("mask"))).alias("bucket"), "id", "n")
    roots = linked(members, F.bit_count(F.col("l.id").bitwiseXOR(F.col("r.id"))) <= radius, F.col("n"))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")).select("fp", "least", "root")
    if hashed:
        return rows.join(named.select("fp", "root"), "fp").select("doc_id", "hash", "root")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each component: of its smallest doc_id, and
    among rows of that id the one of the least text hash. Rows without doc_id
    stay only where no row of their component has one."""
    found = near_duplicates(docs, shingle, radius, hashed=True)
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "hash")
    first = found.groupBy("root").agg(F.min(key).alias("m")).select(F.col("m.doc_id").alias("__id"), F.col("m.hash").alias("__hash"))
    keyed = docs.withColumn("__text_hash", F.xxhash64(F.coalesce(docs["text"], F.lit(""))))
    kept = keyed.join(first, keyed["doc_id"].cast("long").eqNullSafe(first["__id"]) & (keyed["__text_hash"] == first["__hash"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__text_hash"]).select(*docs.columns)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
