"""Approximate nearest neighbours (cosine) by multi-index hashing.

Unit vectors are centred, projected and turned by a learned rotation (iterative
quantisation), and their signs are a binary code, split into substrings of 8
bits. Rows are dealt into blocks of bounded size; a block indexes its rows by
each substring. If two codes differ in at most r bits, one of m substrings
differs in at most r // m: probing every value within that distance in each of
the m tables retrieves every code within the radius. Retrieved codes are
checked against r and reranked by the cosine of the float vectors. Where a block
has fewer than k within r, its radius is doubled until it has.

The rotation and r are learned on at most ``sample_rows`` rows (least hashes of
the id, so the same at every run): r is the distance within which ``recall`` of
the nearest neighbours of sampled vectors lie in that sample. In all rows
neighbours are nearer, so their recall is higher. All rows are indexed.

Equal vectors are one row with their k + 1 smallest ids, which is all that a
result can show, so a vector that a third of the rows share costs no more than
another; queries with equal vectors are searched once.

Cases: vectors that are null, zero, of another length than most, or hold null
or non-finite components take no part, neither do rows without id; an id that
occurs twice counts once per vector; an empty table gives no rows. Ties go to
the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiwatch.llm.common import read_table, written

ONES = np.array([x.bit_count() for x in range(256)], np.uint8)


@dataclass
class Coder:
    """Codes of unit vectors: m bytes each."""

    mean: np.ndarray
    turn: np.ndarray
    radius: int = 0

    @classmethod
    def fit(cls, x: np.ndarray, recall: float, k: int, seed: int = 3, rounds: int = 30) -> Coder:
        r = np.random.default_rng(seed)
        mean = x.mean(0)
        bits = min(64, x.shape[1])
        axes = np.linalg.svd(x - mean, full_matrices=False)[2][:bits].T if len(x) >= bits else np.linalg.qr(r.normal(size=(x.shape[1], bits)))[0]
        flat = (x - mean) @ axes
        turn = np.linalg.qr(r.normal(size=(bits, bits)))[0]
        for _ in range(rounds):  # the rotation that brings the vectors nearest to corners
            u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        out = cls(mean, axes @ turn)
        probe = x[:min(len(x), 200)]
        near = probe @ x.T
        near[np.arange(len(probe)), np.arange(len(probe))] = -2
        best = np.argsort(-near, 1, kind="stable")[:, :min(k, len(x) - 1)]
        codes = out.codes(x)
        apart = ONES[codes[:len(probe), None] ^ codes[best]].sum(2)
        out.radius = int(np.quantile(apart, recall, method="higher")) if apart.size else bits
        return out

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.turn > 0, axis=1)


class MultiIndex:
    """Substring tables over the codes of a block."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.first = [np.concatenate([[0], np.cumsum(np.bincount(c, minlength=256))]) for c in codes.T]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is within ``radius`` of ``code``."""
        seen = np.zeros(len(self.codes), bool)
        for j, value in enumerate(code):
            first, order = self.first[j], self.order[:, j]
            for v in np.flatnonzero(ONES[np.arange(256) ^ value] <= radius // len(code)):
                seen[order[first[v]:first[v + 1]]] = True
        rows = np.flatnonzero(seen)
        return rows[ONES[self.codes[rows] ^ code].sum(1) <= radius]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _search(index: pd.DataFrame, queries: pd.DataFrame, coder: Coder, k: int) -> pd.DataFrame:
    """The k + 1 nearest distinct vectors of a block for each query vector."""
    rows: list[tuple] = []
    if len(index) and len(queries):
        index = index.sort_values("rep").reset_index(drop=True)
        x, q = _matrix(index["embedding"]), _matrix(queries["embedding"])
        size = np.sqrt((x * x).sum(1))
        table = MultiIndex(coder.codes(_unit(x)))
        for rep, vector, code in zip(queries["rep"], q, coder.codes(_unit(q)), strict=True):
            radius = coder.radius
            found = table.within(code, radius)
            while len(found) < min(k + 1, len(x)):
                radius = 2 * radius + 8
                found = table.within(code, radius)
            score = (x[found] * vector).sum(1) / (size[found] * np.sqrt((vector * vector).sum()))
            for i in np.lexsort([found, -score])[:k + 1]:
                rows.append((rep, float(score[i]), index["ids"][found[i]]))
    return pd.DataFrame(rows, columns=["rep", "score", "ids"])


def usable(column: Column) -> Column:
    whole = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return column.isNotNull() & whole & F.exists(column, lambda v: v != 0)


def neighbours(vectors: DataFrame, is_query: Column, k: int = 5, recall: float = 0.97, sample_rows: int = 4000, block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for
    which ``is_query`` (an expression over vec_id) holds."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("embedding")), F.lit(False)))
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    rows = rows.where(F.size("embedding") == sizes["n"]).distinct()
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    unique = written(rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("embedding")
                     .agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    sample = unique.select("rep", "embedding").orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).toPandas()
    coder = Coder.fit(_unit(_matrix(sample["embedding"])), recall, k)
    blocks = max(1, -(-unique.count() // block_rows))
    asked = written(rows.where(is_query).join(unique.select("embedding", "rep"), "embedding")
                    .select(F.col("vec_id").alias("query_id"), "rep", "embedding"), "queries")
    once = asked.select("rep", "embedding").dropDuplicates(["rep"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    index = unique.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _search(left, right, coder, k)

    found = index.groupBy("block").cogroup(once.groupBy("block")).applyInPandas(run, "rep long, score double, ids array<long>")
    best = Window.partitionBy("rep").orderBy(F.desc("score"), F.col("ids")[0])
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).select("rep", "score", F.explode("ids").alias("vec_id"))
    pairs = asked.select("query_id", "rep").join(found, "rep").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
