"""N-gram Jaccard join by count vectors in R-trees.

A document's set holds the distinct hashes of its word n-grams; documents whose
sets have a Jaccard similarity of ``percent`` or more are linked. The hashes are
dealt into ``DIMS`` groups, and the counts by group are the document's point. Two
sets share at most the sum of the smaller counts, so that sum bounds the
overlap of two points, and with the greatest counts of a box (and the least size
in it) that of everything in two nodes of an R-tree.

One tree over a whole corpus would be of no use in so many dimensions, and no
task could hold it, so the points are first parted without loss. Similar sets of
sizes a and b differ in at most (100 - percent)(a + b) / (100 + percent)
hashes. By size, sets fall into classes; a class deals hashes into so many
groups more than that ("fine" groups) that a linked pair has a group untouched,
of the same content in both, and not an empty one. Where documents share such a
group, they are tied to the first of them; what hangs together is a family, and
every link lies in one. Families are small (near copies, and few others).

In a family, first each document is compared with those it is tied to; links
found make a dense family one component at once. Then, exactly, an R-tree over
the points of the family finds the pairs still in different components that the
bound admits: nodes and points in one component are passed over, so copies are
not paired with each other. Families are put together in tiles of bounded size;
a family above it is cut into blocks, and each tile joins two blocks. All
pairs that survive are verified on the sets themselves.

Equal sets are one node, told by 64 bits of the sum of their mixed hashes.

Cases: null and empty texts have an empty set and are linked with nothing; a
text of fewer words than ``size`` has its whole sequence as the one n-gram; rows
that share a doc_id or a text are rows of their own; a null doc_id never names a
component; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiwatch.llm.common import Words, components, grams, id_and_text, in_batches, mix, read_table, shared_dir, written

DIMS = 32  # groups of a point
LEAF = 16  # points or nodes in a node of the tree
TILE = 2048  # points of a tile, about
BATCH_CHARS = 4_000_000


# -- sets of n-grams ---------------------------------------------------------------


def shingle_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the ascending distinct n-gram hashes of each text, end to end."""
    words = Words(texts, lower=True)
    h = words.hashes()
    found, at = grams(h, words.doc, size)
    doc = words.doc[at]
    for n in range(1, size):  # whole texts of fewer words
        few = np.flatnonzero(words.count == n)
        if len(few):
            whole, _ = grams(h[np.repeat(words.first[few], n) + np.tile(np.arange(n), len(few))], np.repeat(few, n), n, seed=100 + n)
            found, doc = np.concatenate([found, whole]), np.concatenate([doc, few])
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    found, doc = found[new], doc[new]
    return found, np.searchsorted(doc, np.arange(len(texts) + 1))


def most_differing(a: int, b: int, percent: int) -> int:
    """How many hashes two linked sets of these sizes differ in at most."""
    return (100 - percent) * (a + b) // (100 + percent)


def size_classes(most: int, percent: int) -> np.ndarray:
    """Least sizes of the classes; similar sets are in one or in neighbours."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * max(14_000, 1_000_000 // percent + 1) // 10_000)))
    return np.array(edges)


def fine_groups(edges: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each class the number of groups, and how many of them may be empty
    in a set whose empty groups are left out."""
    most = np.array([most_differing(int(e) - 1, int(e) - 1, percent) for e in edges[1:]])
    spare = 1 + most // 16
    return most + 1 + spare, spare


def group_keys(h: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, first): for each set a key for each of its fine groups' contents,
    in its class and, if a linked set can be in the next, there too."""
    n = np.diff(first)
    edges = size_classes(int(n.max(initial=1)) * 2, percent)
    groups, spare = fine_groups(edges, percent)
    own = np.searchsorted(edges, n, "right") - 1
    keys, of = [], []
    dealt = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    doc = np.repeat(np.arange(len(n)), n)
    for up in (0, 1):
        into = np.maximum(own, 0) + up
        some = (n > 0) & (groups[into] > 1 + spare[into])  # in classes where none may differ, linked sets are equal
        if up:
            some &= 100 * n // percent >= edges[into]
        width = np.where(some, groups[into], 0)
        at = np.concatenate([[0], np.cumsum(width)])
        mine = some[doc]
        cell = at[doc[mine]] + (dealt[mine] % width[doc[mine]].astype(np.uint64)).astype(np.int64)
        content, count = np.zeros(at[-1], np.uint64), np.bincount(cell, minlength=at[-1])
        np.add.at(content, cell, dealt[mine])
        who = np.repeat(np.arange(len(n)), width)
        empty = np.bincount(who[count == 0], minlength=len(n))
        kept = (count > 0) | (empty > spare[into])[who]
        group = np.arange(at[-1]) - at[who]
        named = (into[who].astype(np.uint64) << np.uint64(40)) | group.astype(np.uint64)
        keys.append(mix(mix(content) + mix(named + np.uint64(1)))[kept])
        of.append(who[kept])
    keys, of = np.concatenate(keys), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return keys[order], np.searchsorted(of[order], np.arange(len(n) + 1))


POINTS = "doc_id long, hash long, id long, n int, point binary, keys array<long>"


def points(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """A row for each document: a hash of its text, the set's id and size, its
    counts by group (two bytes each: capped for sets so large that a count does
    not fit, see ``bound``), and the keys of its fine groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_batches(texts, BATCH_CHARS):
                h, first = shingle_sets(texts[a:b], size)
                doc = np.repeat(np.arange(b - a), np.diff(first))
                dealt = mix(h)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(dealt)])
                counts = np.bincount(doc * DIMS + (dealt % np.uint64(DIMS)).astype(np.int64), minlength=(b - a) * DIMS).reshape(-1, DIMS)
                point = np.minimum(counts, 65535).astype("<u2")
                keys, edge = group_keys(h, first, percent)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("hash").slice(a, b - a),
                     pa.array(mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)), pa.array(np.diff(first).astype(np.int32)),
                     pa.array([p.tobytes() for p in point], pa.binary()), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(keys.view(np.int64)))],
                    names=[c.split()[0] for c in POINTS.split(", ")])

    return written(id_and_text(docs).withColumn("hash", F.xxhash64("text")).mapInArrow(run, POINTS), "points")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, hashes) of the texts whose hash is in ``wanted`` (id, hash), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_batches(texts, BATCH_CHARS):
                h, first = shingle_sets(texts[a:b], size)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))],
                                                 names=["id", "hashes"])

    texts = id_and_text(docs).select("text", F.xxhash64("text").alias("hash"))
    some = texts.join(wanted, "hash").dropDuplicates(["id"])
    return written(some.select("id", "text").mapInArrow(run, "id long, hashes array<long>"), "sets")


# -- the R-tree ----------------------------------------------------------------------


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The most that sets can share, by their points or the greatest of a
    node's. A count at the top of its range stands for any greater one."""
    least = np.minimum(x, y).astype(np.int64)
    return np.where((least == 65535).any(axis=1), np.iinfo(np.int64).max, least.sum(axis=1))


class RTree:
    """Points (family, size, counts) with a component each, packed by family,
    size and counts: ``LEAF`` neighbours a node, level by level."""

    def __init__(self, family: np.ndarray, root: np.ndarray, n: np.ndarray, point: np.ndarray) -> None:
        self.order = np.lexsort([*point[:, :4].T[::-1], n, family])
        lo = {k: v[self.order] for k, v in {"family": family, "root": root, "n": n}.items()}
        self.levels = [(lo, dict(lo), point[self.order])]
        while len(self.levels[-1][2]) > 1:
            low, high, most = self.levels[-1]
            edge = np.arange(0, len(most), LEAF)
            self.levels.append(({k: np.minimum.reduceat(v, edge) for k, v in low.items()},
                                {k: np.maximum.reduceat(v, edge) for k, v in high.items()}, np.maximum.reduceat(most, edge)))

    def _admitted(self, other: RTree, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        (lo, hi, most), (lo2, hi2, most2) = self.levels[level], other.levels[level]
        ok = (lo["family"][i] <= hi2["family"][j]) & (lo2["family"][j] <= hi["family"][i])
        ok &= (100 * hi2["n"][j] >= percent * lo["n"][i]) & (100 * hi["n"][i] >= percent * lo2["n"][j])
        ok &= ~((lo["root"][i] == hi["root"][i]) & (lo2["root"][j] == hi2["root"][j]) & (lo["root"][i] == lo2["root"][j]))
        at = np.flatnonzero(ok)
        for k in range(0, len(at), 1 << 16):  # the counts of so many pairs at a time
            some = at[k:k + (1 << 16)]
            ok[some] = bound(most[i[some]], most2[j[some]]) >= needed(lo["n"][i[some]], lo2["n"][j[some]], percent)
        return ok

    def join(self, other: RTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (of self, of other) that the bound admits, in
        portions; with itself, each pair once."""
        top = max(len(self.levels), len(other.levels)) - 1
        for t in (self, other):  # one height for both: a root of one child
            while len(t.levels) <= top:
                t.levels.append(t.levels[-1])
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            ok = self._admitted(other, level, i, j, percent)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if level == 0:
                yield self.order[i], other.order[j]
                continue
            fan = np.arange(LEAF)
            for k in range(0, len(i), 4096):  # depth first, so that few pairs wait
                x = (i[k:k + 4096, None] * LEAF + fan)[:, :, None]
                y = (j[k:k + 4096, None] * LEAF + fan)[:, None, :]
                x, y = (v.ravel() for v in np.broadcast_arrays(x, y))
                keep = (x < len(self.levels[level - 1][2])) & (y < len(other.levels[level - 1][2]))
                if self is other:
                    keep &= (x < y) if level == 1 else (x <= y)
                if keep.any():
                    stack.append((level - 1, x[keep], y[keep]))


def tiles(members: DataFrame, tile: int = TILE) -> DataFrame:
    """``members`` (family, ...) with (tile, block): families of up to ``tile``
    points share tiles; a greater one is cut into blocks by hash, and each pair
    of its blocks is a tile, with block 0 and block 1 (a block with itself: 0)."""
    size = members.groupBy("family").agg(F.count(F.lit(1)).alias("rows"))
    rows = size.where(F.col("rows") <= tile).agg(F.sum("rows")).first()[0] or 0
    shared = max(1, -(-rows // (tile // 2)))
    some = members.join(size.withColumn("blocks", F.ceil(F.col("rows") / (tile // 2)).cast("int")), "family")
    small = some.where(F.col("rows") <= tile).withColumn("tile", F.concat(F.lit("s"), F.pmod(F.xxhash64("family"), F.lit(shared)))).withColumn("block", F.lit(0))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks"))
    large = (some.where(F.col("rows") > tile).withColumn("mine", mine).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("tile", F.concat_ws("-", "family", F.least("mine", "with"), F.greatest("mine", "with"))).withColumn("block", (F.col("mine") > F.col("with")).cast("int")))
    cols = [*members.columns, "tile", "block"]
    return small.select(*cols).unionByName(large.select(*cols))


def admitted(members: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """(a, b): pairs of ``members`` (family, id, root, n, point) of one family
    and two components that the bound admits."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        blocks = []
        for k in (0, 1):
            g = group[group["block"] == k]
            if len(g):
                blocks.append((g["id"].to_numpy(), RTree(g["family"].to_numpy(), g["root"].to_numpy(), g["n"].to_numpy(np.int64),
                                                        np.frombuffer(b"".join(g["point"]), "<u2").reshape(len(g), -1))))
        (ids, tree), (ids2, tree2) = blocks[0], blocks[-1]
        parts = list(tree.join(tree2, percent))
        i, j = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
        return pd.DataFrame({"a": ids[i], "b": ids2[j]})

    return tiles(members, tile).groupBy("tile").applyInPandas(run, "a long, b long")


# -- the join ------------------------------------------------------------------------


def enough(a: str, b: str, shared: Column, percent: int) -> Column:
    """Whether sets of the sizes in columns ``a`` and ``b`` that share so many are linked."""
    return 100 * shared >= percent * (F.col(a).cast("long") + F.col(b) - shared)


def similar(docs: DataFrame, size: int = 3, percent: int = 90, tile: int = TILE) -> DataFrame:
    """(doc_id, n, component_id) for every row of ``docs``."""
    shared_dir(docs.sparkSession)
    rows = points(docs, size, percent)
    nodes = written(rows.where("n > 0").groupBy("id").agg(F.min("hash").alias("hash"), F.first("n").alias("n"), F.first("point").alias("point"), F.first("keys").alias("keys")), "nodes")
    dealt = nodes.select("id", F.explode("keys").alias("key")).repartition("key")
    met = dealt.groupBy("key").agg(F.min("id").alias("to"), F.max("id").alias("last")).where("to <> last").select("key", "to")
    ties = written(dealt.join(met, "key").where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")).distinct(), "ties")
    families = components(ties).withColumnRenamed("root", "family").checkpoint()
    inside = nodes.select("id", "hash", "n", "point").join(families.withColumnRenamed("node", "id"), "id").checkpoint()
    sets = sets_of(docs, inside.select("id", "hash"), size)

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sets are linked."""
        x, y = (sets.select(F.col("id").alias(c), F.col("hashes").alias(f"{c}_set"), F.size("hashes").alias(f"{c}_n")) for c in ("a", "b"))
        both = pairs.join(x, "a").join(y, "b")
        within = (100 * F.col("a_n") >= percent * F.col("b_n")) & (100 * F.col("b_n") >= percent * F.col("a_n"))
        shared = F.size(F.array_intersect("a_set", "b_set"))
        return both.where(within & enough("a_n", "b_n", shared, percent)).select("a", "b")

    star = linked(ties).checkpoint()
    roots = components(star).checkpoint()
    now = inside.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    split = now.groupBy("family").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("family")
    rest = written(admitted(now.join(split, "family").select("family", "id", "root", "n", "point").checkpoint(), percent, tile), "admitted")
    ends = components(star.union(linked(rest)))
    named = rows.join(ends.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "id")))
    least = named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return (named.select("doc_id", "n", "root").join(least, "root", "left")
            .select("doc_id", F.col("n").cast("long").alias("n"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(read_table(spark, sf_dir, "documents")).withColumnRenamed("n", "n_shingles")
