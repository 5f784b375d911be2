"""Helpers shared by the operators: tables, shared storage, words, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these (space, tab to carriage return).
SEPARATORS = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a
    cluster without that folder gets it by --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs``; a null text counts as empty. Other columns
    are not read, so clashing names among them do no harm."""
    importable(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                       F.coalesce(docs["text"], F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one is set only
    for a local session that names none (tests)."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="llm-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives
    lost executors, and fixes rows that a second run might number otherwise."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_batches(texts: Iterable[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of ``texts`` of about ``most`` characters; every text whole."""
    a = size = 0
    b = 0
    for b, t in enumerate(texts, 1):
        size += len(t)
        if size >= most:
            yield a, b
            a, size = b, 0
    if a < b:
        yield a, b


# -- words and their hashes, for a batch of texts ------------------------------

_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Poly:
    """Polynomial hash modulo 2^64 of byte ranges through prefix sums."""

    def __init__(self, seed: int) -> None:
        r = np.random.default_rng(seed)
        self.value = r.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(r.integers(1, 2**61)) * 8 + 5
        self.power = self.inverse = np.ones(0, np.uint64)

    def __call__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.power) < len(buf):
            n = max(len(buf), 1 << 16)
            self.power, self.inverse = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b % 2**64, np.uint64)]))
                for b in (self.base, pow(self.base, -1, 2**64)))
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.value[buf] * self.power[:len(buf)], out=sums[1:])
        return mix((sums[end] - sums[start]) * self.inverse[start])


_HASHES = (_Poly(11), _Poly(23))


class Words:
    """The words of a batch of texts as arrays: ``start`` and ``end`` (bytes of
    ``buf``), ``doc`` (index of the text), ``first`` (words before each text)."""

    def __init__(self, texts: list[str], lower: bool = False) -> None:
        raw = [t.encode() for t in texts]
        joined = b"\n".join(raw) + b"\n"
        if lower:
            joined = joined.lower()  # bytes.lower() changes A-Z alone
        self.raw = joined
        self.buf = np.frombuffer(joined, np.uint8)
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.text_start = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        edge = np.flatnonzero(np.diff(_IS_SEPARATOR[self.buf].astype(np.int8), prepend=1))
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.text_start, self.start, "right") - 1
        self.first = np.searchsorted(self.start, self.text_start)
        self.count = np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        return _HASHES[which](self.buf, self.start, self.end)


def grams(h: np.ndarray, doc: np.ndarray, n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words that lies in one text, and where it starts."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    odd = np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out += h[j:j + m] * odd[j]
    at = np.flatnonzero(doc[:m] == doc[n - 1:])
    return mix(out[at]), at


def totals(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each range first[i]:first[i + 1]."""
    sums = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


# -- components --------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): one root for each
    connected component.

    Random contraction: in each round a node moves to the node of least hash
    within two steps of it, and edges are renamed. A star is one node after a
    round, and as the hash differs by round, the number of nodes falls
    geometrically whatever the shape. Rounds are cut by tables (``written``: one job
    each, where checkpoint() takes two and its last stage twice); nothing is collected.
    """
    shared_dir(edges.sparkSession)
    left = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    moves: list[DataFrame] = []
    while not left.isEmpty():
        def rank(c: str, k: int = len(moves)) -> Column:
            return F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("node"))
        both = left.union(left.select("b", "a"))
        one = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least(rank("a"), F.col("m")).alias("m"))
        near = both.join(one.select(F.col("a").alias("b"), "m"), "b")
        to = written(near.groupBy("a").agg(F.min("m").alias("m")).select(F.col("a").alias("node"), F.col("m")["node"].alias("root")), "moves")
        moves.append(to)
        left = written(left.join(to.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
                       .join(to.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
                       .where("x <> y")
                       .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = moves[0]
    for to in moves[1:]:
        step = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out


def linked(members: DataFrame, links: Column, prefer: Column, pivots: int = 3) -> DataFrame:
    """(node, root) over the rows of ``members`` (bucket, id, ...) that some
    row of the same bucket links to; ``links`` compares l.* with r.*.

    Only connectivity matters, so not every pair is looked at. First each row
    is compared with a few pivots of its bucket (the greatest ``prefer``, then
    hashed picks), which is linear and joins dense groups. Then, exactly, rows
    of one bucket that are still in different components are compared with each
    other; what comes out are links alone, by a join that Spark splits if a
    bucket is hot. A bucket in one component is not looked at again.
    """
    shared_dir(members.sparkSession)
    # No two rows of one id in a bucket, so a bucket of one row has no pair.
    picks = [F.max(F.struct(prefer.alias("o"), F.struct("*").alias("m")))["m"].alias("p0")]
    picks += [F.min(F.struct(F.xxhash64(F.lit(k), "id").alias("o"), F.struct("*").alias("m")))["m"].alias(f"p{k}")
              for k in range(1, pivots)]
    crowd = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), *picks).where("rows > 1")
    crowd = crowd.select(F.col("bucket"), F.array_distinct(F.array([F.col(f"p{k}") for k in range(pivots)])).alias("p"))
    full = members.join(crowd, "bucket").checkpoint()
    star = (full.select(F.struct(*members.columns).alias("l"), F.explode("p").alias("r"))
            .where("l.id <> r.id").where(links).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")))
    roots = components(star).checkpoint()
    rest = (full.drop("p").join(roots.withColumnRenamed("node", "id"), "id", "left")
            .withColumn("root", F.coalesce("root", "id")))
    split = rest.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    rest = rest.join(split.select("bucket"), "bucket").checkpoint()
    l = rest.select("bucket", F.struct(*members.columns, "root").alias("l"))
    r = rest.select("bucket", F.struct(*members.columns, "root").alias("r"))
    more = (l.join(r, (l["bucket"] == r["bucket"]) & (F.col("l.root") < F.col("r.root")) & links)
            .select(F.col("l.root").alias("a"), F.col("r.root").alias("b")))
    over = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
    seen = roots.union(rest.select("id", "root")).distinct()
    return (seen.join(over, "root", "left")
            .select("node", F.coalesce("top", "root").alias("root")))
