"""Scoring and nearest neighbours against brute force."""

import math
import random
import tempfile
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import lower, split
from pyspark.sql import functions as F

from epiwatch.llm import ngram_model
from epiwatch.llm.ann_search import MultiIndex, neighbours
from epiwatch.llm.ngram_model import EliasFano, Trie, quantised, restored, score


def test_elias_fano_round_trip():
    r = np.random.default_rng(0)
    with tempfile.TemporaryFile() as file:
        for n, top in ((0, 1), (1, 1), (1, 2**63), (50, 10), (500, 2**60), (300, 300)):
            x = np.sort(r.integers(0, top, n, dtype=np.uint64))
            assert EliasFano(x, file).values().tolist() == x.tolist()


def test_trie_lookup():
    r = random.Random(1)
    pairs = sorted({(r.randint(0, 9), r.randint(0, 30)) for _ in range(80)})
    names = np.sort(np.array(r.sample(range(10**6), 10), np.uint64))
    with tempfile.TemporaryFile() as file:
        trie = Trie(names, np.array([c for c, _ in pairs]), np.array([s for _, s in pairs], np.uint64), np.arange(1, len(pairs) + 1, dtype=np.uint8), file)
        ask = [(c, s) for c in range(10) for s in range(32)]
        got = trie.lookup(names[[c for c, _ in ask]], np.array([s for _, s in ask], np.uint64))
    assert got.tolist() == [pairs.index(p) + 1 if p in pairs else 0 for p in ask]


def test_quantisation_error():
    x = np.linspace(-11.9, 0, 1000)
    assert np.abs(np.log10(restored(quantised(x))) - x).max() <= ngram_model.STEP / 2 + 1e-9


@pytest.mark.parametrize(("chunk_chars", "heavy"), [(3000, 1 / 200), (10**7, 1 / 20)])
def test_scores(docs, rows, no_docs, monkeypatch, chunk_chars, heavy):
    monkeypatch.setattr(ngram_model, "HEAVY", heavy)
    k = 50.0
    tokens = [[*split(lower(t)), None] for _, t, *_ in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, *_ in rows]
    one, two, texts = Counter(), Counter(), 0
    for t, h in zip(tokens, held, strict=True):
        if not h:
            one.update(t)
            two.update(zip(["<s>", *t[:-1]], t, strict=True))
            texts += 1
    n, v = sum(one.values()), len(one)
    assert any(held)
    got = Counter()
    for x in score(docs, prior=k, chunk_chars=chunk_chars).collect():
        got[x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)] += 1
        found = next((t for (i, *_), t in zip(rows, tokens, strict=True) if i == x.doc_id and len(t) == x.n_tokens))
        p = [(two[c, w] + k * (one[w] + 1) / (n + v + 1)) / ((texts if c == "<s>" else one[c]) + k) for c, w in zip(["<s>", *found[:-1]], found, strict=True)]
        assert abs(sum(map(math.log10, p)) - x.score) <= 0.026 * len(found)
    want = Counter()
    for (i, *_), t, h in zip(rows, tokens, held, strict=True):
        want[i, h, len(t), sum(one[w] > 0 for w in t), n, round(sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t), 6)] += 1
    assert got == want
    assert score(no_docs).count() == 0


def test_probabilities_sum_to_one():
    """Over all known words and one unknown mass, for any context."""
    one, two, k = Counter("a b a c b a".split()), Counter(zip("a b a c b".split(), "b a c b a".split(), strict=True)), 3.0
    n, v = sum(one.values()), len(one)
    for c in "abc":
        followed = sum(x for (p, _), x in two.items() if p == c)
        total = sum((two[c, w] + k * (one[w] + 1) / (n + v + 1)) / (followed + k) for w in one) + k / (n + v + 1) / (followed + k)
        assert total == pytest.approx(1.0)


def test_multi_index_retrieves_every_code_within_the_radius():
    r = np.random.default_rng(2)
    codes = r.integers(0, 256, (400, 8), dtype=np.uint8)
    codes[:50] = codes[0] ^ (r.random((50, 8)) < 0.3).astype(np.uint8)
    index = MultiIndex(codes)
    for radius in (0, 3, 9, 25):
        for q in (codes[0], codes[77]):
            apart = np.bitwise_count(codes ^ q).sum(1)
            assert index.within(q, radius).tolist() == np.flatnonzero(apart <= radius).tolist()


def vectors():
    r = np.random.default_rng(3)
    base = r.normal(size=(6, 16))
    rows = [(i, (base[i % 6] + 0.5 * r.normal(size=16)).astype(np.float32).tolist()) for i in range(400)]
    same = rows[7][1]
    rows += [(i, same) for i in range(400, 560)]  # a vector that many share
    rows += [(560, [2 * x for x in same]), (561, None), (562, [0.0] * 16), (563, [float("nan")] * 16), (564, [None] * 16), (565, [1.0, 2.0]), (None, same),
             (600, [float("inf")] + [1.0] * 15), (7, same)]
    return rows


def test_neighbours(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("rep", "ids", "rank", "label")})
    got = neighbours(df, F.col("vec_id") % 50 == 0, block_rows=100).toPandas()
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    queries = sorted(i for i in good if i % 50 == 0)
    assert sorted(got["query_id"].unique()) == queries
    hit = 0
    for q in queries:
        found = got[got["query_id"] == q].sort_values("rank")
        assert found["rank"].tolist() == [1, 2, 3, 4, 5]
        cosine = {i: float(v @ good[q] / np.sqrt((v @ v) * (good[q] @ good[q]))) for i, v in good.items() if i != q}
        best = sorted(cosine, key=lambda i: (-round(cosine[i], 12), i))[:5]
        hit += len(set(best) & set(found["vec_id"]))
        assert np.allclose(found["score"], [cosine[i] for i in found["vec_id"]], atol=1e-12)
        assert (np.diff(found["score"]) <= 0).all()
    assert hit / (5 * len(queries)) >= 0.9
    q = got[got["query_id"] == 450].sort_values("rank")["vec_id"].tolist()
    assert len(set(q) & {7, *range(400, 410)}) >= 4  # copies, the smallest ids first
    assert q == sorted(q)


def test_neighbours_of_few_or_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (50, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = {(x.query_id, x.rank): x.vec_id for x in neighbours(few, F.col("vec_id") % 50 == 0).collect()}
    assert got == {(0, 1): 1, (0, 2): 50, (50, 1): 1, (50, 2): 0}
    assert neighbours(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0
