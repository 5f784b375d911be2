"""Merkle manifest of a dataset, with hash states kept in the parents.

A row's leaf is the SHA-256 of its fields. Per source, leaves ascend by doc_id;
every ``FANOUT`` consecutive nodes become a parent, until one node remains: the
subroot. Subroots, ordered by source, give the root the same way. Digests are
hashed as hex text, so a child is exactly one block of SHA-256 and the state of
a parent's hash before each child is eight words. A parent keeps these states
(``states``, 32 bytes a child). To fold a changed leaf up to the root, at each
level the state kept before its slot is resumed with the new digest and the
siblings to its right; those to its left are never read again.

Places of leaves come from a range partitioning and the rows of each source in
each range, added up; no source, whatever its size, is sorted or numbered in one
task. A tree level is a group-by of at most FANOUT rows a group. Ways to the
root are put together from the top down, for each run of leaves once: a join on
(tree, parent) with at most FANOUT rows a key.

Cases: nulls in any field have a leaf of their own (`-`); a null source is a
source, before all others; rows without doc_id come after the others of their
source and are not tampered with; rows that share a doc_id are leaves of their
own, in the order of their digests; a source of one row has that leaf as
subroot; an empty table has no rows and no root (None); other columns are not
read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiwatch.llm.common import importable, read_table, written

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# -- SHA-256 on arrays: one state of eight words for each row --------------------


def _primes(n: int) -> list[int]:
    out: list[int] = []
    k = 2
    while len(out) < n:
        if all(k % p for p in out):
            out.append(k)
        k += 1
    return out


def _root_bits(n: int, power: int) -> int:
    """The first 32 bits of the fraction of the ``power``-th root of ``n``, by which the standard defines its constants."""
    whole = n << (32 * power)
    r = int(round(whole ** (1 / power)))
    while r ** power > whole:
        r -= 1
    while (r + 1) ** power <= whole:
        r += 1
    return r & 0xFFFFFFFF


ROUND = np.array([_root_bits(p, 3) for p in _primes(64)], np.uint32)
START = np.array([_root_bits(p, 2) for p in _primes(8)], np.uint32)
_HEX = np.array([list(f"{b:02x}".encode()) for b in range(256)], np.uint8)


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x >> np.uint32(k)) | (x << np.uint32(32 - k))


def resume(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (n, 8) after a further block (n, 16) of big-endian words."""
    w = list(block.T.astype(np.uint32))
    for i in range(16, 64):
        x, y = w[i - 15], w[i - 2]
        w.append(w[i - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[i - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state.T.astype(np.uint32)
    for i in range(64):
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + ROUND[i] + w[i]
        u = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = t + u, a, b, c, d + t, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h], axis=1)


def child_block(digest: np.ndarray) -> np.ndarray:
    """Digests (n, 32 bytes) as hex text: a block each."""
    return np.ascontiguousarray(_HEX[digest].reshape(len(digest), 64)).view(">u4").astype(np.uint32)


def closed(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Digests (n, 32 bytes) of hashes of so many children."""
    last = np.zeros((len(state), 16), np.uint32)
    last[:, 0] = 1 << 31
    last[:, 15] = children * 512
    return resume(state, last).astype(">u4").view(np.uint8).reshape(len(state), 32)


def parents(digests: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """For the joined digests of each parent's children: the states before each child, and the parent's digest."""
    n = np.array([len(d) // 32 for d in digests])
    room = np.zeros((len(n), int(n.max(initial=1)), 32), np.uint8)
    for row, d in zip(room, digests, strict=True):
        row[:len(d) // 32] = np.frombuffer(d, np.uint8).reshape(-1, 32)
    state = np.tile(START, (len(n), 1))
    kept = np.zeros((len(n), room.shape[1], 8), ">u4")
    for t in range(room.shape[1]):
        kept[:, t] = state
        more = n > t
        state[more] = resume(state[more], child_block(room[more, t]))
    return [kept[i, :k].tobytes() for i, k in enumerate(n)], [x.tobytes() for x in closed(state, n)]


def folded(state: np.ndarray, digest: np.ndarray, right: np.ndarray, n_right: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Parents' digests when the children after ``state`` are ``digest`` and ``n_right`` of ``right`` (n, most, 32)."""
    state = resume(state, child_block(digest))
    for t in range(int(n_right.max(initial=0))):
        more = n_right > t
        state[more] = resume(state[more], child_block(right[more, t]))
    return closed(state, children)


# -- leaves ------------------------------------------------------------------------


def leaf(fields: list) -> bytes:
    h = hashlib.sha256()
    for x in fields:
        raw = None if x is None else str(x).encode()
        h.update(b"-" if raw is None else b"%d:%b" % (len(raw), raw))
    return h.digest()


LEAVES = "grp string, doc_id long, leaf binary, changed binary"


def leaves(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, leaf, changed) of every row: ``grp`` orders as the source
    does, null first; ``changed`` is the leaf after tampering, null where that
    changes nothing."""
    importable(docs.sparkSession)
    kinds = {"doc_id": "long", "n_chars": "long"}
    some = docs.select(*(docs[c].cast(kinds.get(c, "string")).alias(c) for c in FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            out: list[tuple] = []
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                for doc_id, source, lang, n_chars, text in zip(*(batch.column(c).to_pylist() for c in FIELDS), strict=True):
                    changed = None
                    if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
                        raw = text.encode()
                        if (lower := raw.lower()) != raw:  # on bytes: A-Z alone
                            changed = leaf([doc_id, source, lang, n_chars, lower.decode()])
                    out.append(("n" if source is None else "s" + source, doc_id, leaf([doc_id, source, lang, n_chars, text]), changed))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                                             names=["grp", "doc_id", "leaf", "changed"])

    return some.mapInArrow(run, LEAVES)


def placed(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with ``pos``, the place in ``grp`` by ``order`` (from 0), and ``n``,
    the rows of the group. Rows are range-partitioned and sorted there; the
    rows of each group in each range, added up, say where a range's begin."""
    row = F.monotonically_increasing_id()  # the partition above bit 33, the row in it below
    sorted_ = written(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("seq", row), "sorted")
    keyed = sorted_.withColumn("part", F.shiftright("seq", 33))
    piece = keyed.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("lo"))
    by_grp = Window.partitionBy("grp")  # a row for each range that the group is in
    before = F.coalesce(F.sum("rows").over(by_grp.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    piece = piece.select("grp", "part", (before - F.col("lo")).alias("shift"), F.sum("rows").over(by_grp).alias("n"))
    return keyed.join(piece, ["grp", "part"]).withColumn("pos", F.col("seq") + F.col("shift")).drop("seq", "part", "shift")


# -- levels ------------------------------------------------------------------------

CHILDREN = "states binary, digest binary"


def with_parents(rows: DataFrame) -> DataFrame:
    """``rows`` with (states, digest) of the parent of ``digests``."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), CHILDREN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                states, digest = parents(batch.column("digests").to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, pa.binary()), pa.array(digest, pa.binary())],
                                                 names=[*batch.schema.names, "states", "digest"])

    return rows.mapInArrow(run, schema)


def _joined(column: str) -> Column:
    """The digests of a group of rows (pos, ``column``), by place, end to end."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", column))), lambda x: x[column])
    return F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x))


@dataclass(frozen=True)
class Trees:
    """One tree for each ``grp``: ``levels[k]`` has (grp, idx, n, digests,
    states, digest) for the parents of level k + 1, ``tops`` (grp, top). Rows
    of ``levels[0]`` with n = 1 are the tree: a lone leaf, no parent."""

    levels: list[DataFrame]
    tops: DataFrame


def grown(nodes: DataFrame, fanout: int, name: str, *extra: Column) -> Trees:
    """Trees over ``nodes`` (grp, pos, n, digest); ``extra`` aggregates go into the first level."""
    first = nodes.groupBy("grp", F.expr(f"pos div {fanout}").alias("idx")).agg(F.first("n").alias("n"), _joined("digest").alias("digests"), *extra)
    levels = [written(with_parents(first), f"{name}-1")]
    most, span = levels[0].agg(F.max("n")).first()[0] or 0, fanout
    while most > span:
        below = levels[-1].where(F.col("n") > span).select("grp", F.col("idx").alias("pos"), "n", "digest")
        up = below.groupBy("grp", F.expr(f"pos div {fanout}").alias("idx")).agg(F.first("n").alias("n"), _joined("digest").alias("digests"))
        span *= fanout
        levels.append(written(with_parents(up), f"{name}-{len(levels) + 1}"))
    tops = None
    for k, level in enumerate(levels):
        lone = F.when(F.col("n") == 1, F.col("digests")).otherwise(F.col("digest"))
        last = level.where(F.col("n") <= fanout ** (k + 1)).select("grp", lone.alias("top"))
        tops = last if tops is None else tops.unionByName(last)
    return Trees(levels, tops)


STEP = "struct<state: binary, left: binary, right: binary>"


def _step(digests: str, states: str, slot: Column, fanout: int) -> Column:
    return F.struct(F.substring(F.col(states), slot * 32 + 1, F.lit(32)).alias("state"), F.substring(F.col(digests), F.lit(1), slot * 32).alias("left"),
                    F.substring(F.col(digests), slot * 32 + 33, F.lit(32 * fanout)).alias("right"))


def ways(trees: Trees, fanout: int, above: DataFrame | None = None) -> DataFrame:
    """``levels[0]`` with ``way``, the steps from its parent up to the root, and
    the other columns of ``above`` (grp, way, ...), the way from each tree's
    top (none: the top is the root). A step is the state before a node's slot
    and its siblings' digests."""
    cols = [] if above is None else [c for c in above.columns if c not in ("grp", "way")]
    done: DataFrame | None = None
    for k in range(len(trees.levels) - 1, -1, -1):
        level = trees.levels[k]
        ends = level.where(F.col("n") <= fanout ** (k + 1))  # a row for each tree
        ends = ends.withColumn("way", F.array().cast(f"array<{STEP}>")) if above is None else ends.join(above, "grp")
        if done is not None:
            slot = F.expr(f"cast(idx % {fanout} as int)")
            up = done.select("grp", F.col("idx").alias("up"), F.col("digests").alias("beside"), F.col("states").alias("kept"), F.col("way").alias("rest"), *cols)
            step = _step("beside", "kept", slot, fanout)
            more = (level.where(F.col("n") > fanout ** (k + 1)).withColumn("up", F.expr(f"idx div {fanout}")).join(up, ["grp", "up"])
                    .withColumn("way", F.concat(F.array(step), "rest")))
            ends = ends.unionByName(more.select(*ends.columns))
        done = written(ends, "ways") if k else ends
    return done


# -- the manifest --------------------------------------------------------------------

RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


@dataclass(frozen=True)
class Manifest:
    """``runs``: a row for each run of leaves, with doc_ids, leaves, changed
    leaves, the states kept and the way to the root. ``root`` None: no rows."""

    root: bytes | None
    sources: DataFrame
    runs: DataFrame


def manifest(docs: DataFrame, fanout: int = FANOUT) -> Manifest:
    rows = written(leaves(docs), "leaves")
    at = placed(rows, F.col("doc_id").asc_nulls_last(), "leaf").withColumnRenamed("leaf", "digest")
    one = F.struct("pos", "doc_id", "changed")
    of_docs = grown(at, fanout, "runs", F.sort_array(F.collect_list(one)).alias("rows"))
    tops = placed(of_docs.tops.select(F.lit("").alias("grp"), F.col("grp").alias("source"), F.col("top").alias("digest")), "source")
    of_sources = grown(tops, fanout, "sources", F.sort_array(F.collect_list(F.struct("pos", "source"))).alias("rows"))
    top = of_sources.tops.first()
    root = None if top is None else bytes(top["top"])
    member = ways(of_sources, fanout).select("n", "digests", "states", "way", F.explode("rows").alias("r"))
    slot = F.expr(f"cast(r.pos % {fanout} as int)")
    own = _step("digests", "states", slot, fanout)
    way = F.when(F.col("n") == 1, F.col("way")).otherwise(F.concat(F.array(own), "way"))
    sources = written(member.select(F.col("r.source").alias("grp"), F.substring("digests", slot * 32 + 1, F.lit(32)).alias("subroot"), way.alias("way")), "sources")
    return Manifest(root, sources, ways(of_docs, fanout, sources))


def proofs(m: Manifest) -> DataFrame:
    """Every row's leaf, its proof (siblings level by level, left to right) as a
    digest, and the root that its changed, else own, leaf folds up to."""
    root = m.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                out = _folded_runs(whole.slice(k, 256).to_pylist(), root)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES, strict=True)], names=_NAMES)

    return m.runs.select("n", "digests", "states", "rows", "way", "subroot").mapInArrow(run, RESULT)


_NAMES = [c.split()[0] for c in RESULT.split(", ")]
_TYPES = [pa.int64(), *[pa.string()] * 5, pa.bool_()]


def _folded_runs(runs: list[dict], root: bytes) -> tuple:
    own, doc_ids, subroots, proof, at = [], [], [], [], []
    node: list[bytes] = []
    steps: list[list[tuple[bytes, bytes, int]]] = []  # for each leaf: (state, right siblings, children)
    for run in runs:
        digests, states = run["digests"], run["states"]
        k = len(digests) // 32
        upper = [(s["state"], s["right"], (len(s["left"]) + len(s["right"])) // 32 + 1) for s in run["way"]]
        beside = "".join(s["left"].hex() + s["right"].hex() for s in run["way"])
        for slot, row in enumerate(run["rows"]):
            left, mine, right = digests[:32 * slot], digests[32 * slot:32 * slot + 32], digests[32 * slot + 32:]
            steps.append(([(states[32 * slot:32 * slot + 32], right, k)] if run["n"] > 1 else []) + upper)
            proof.append(hashlib.sha256((left.hex() + right.hex() + beside).encode()).hexdigest())
            own.append(mine.hex())
            doc_ids.append(row["doc_id"])
            subroots.append(run["subroot"].hex())
            node.append(row["changed"] or mine)
    now = np.frombuffer(b"".join(node), np.uint8).reshape(-1, 32).copy()
    for level in range(max(map(len, steps), default=0)):
        at = [i for i, s in enumerate(steps) if len(s) > level]
        some = [steps[i][level] for i in at]
        n_right = np.array([len(r) // 32 for _, r, _ in some])
        right = np.zeros((len(some), int(n_right.max(initial=0)), 32), np.uint8)
        for row, (_, r, _) in zip(right, some, strict=True):
            row[:len(r) // 32] = np.frombuffer(r, np.uint8).reshape(-1, 32)
        state = np.frombuffer(b"".join(s for s, _, _ in some), ">u4").reshape(-1, 8).astype(np.uint32)
        now[at] = folded(state, now[at], right, n_right, np.array([c for _, _, c in some]))
    ends = [x.tobytes() for x in now]
    return (doc_ids, own, subroots, [root.hex()] * len(own), proof, [x.hex() for x in ends], [x == root for x in ends])


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(manifest(read_table(spark, sf_dir, "documents")))
