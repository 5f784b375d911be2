"""N-gram Jaccard join against all pairs of sets."""

import random
from itertools import combinations

import numpy as np
import pytest
from llm_fixtures import SCHEMA, Groups, lower, split

from epiwatch.llm import ngram_join as nj


def brute_set(text, size=3):
    ws = split(lower(text))
    return {tuple(ws[i:i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def brute(rows, percent=90):
    sets = [brute_set(r[1]) for r in rows]
    g = Groups()
    for i in range(len(rows)):
        g.find(i)
    for i, j in combinations(range(len(rows)), 2):
        x, y = sets[i], sets[j]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            g.join(i, j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[g.find(i)] = min(r[0], least.get(g.find(i), r[0]))
    return sorted(((r[0], len(sets[i]), least.get(g.find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=str)


def found(df, **options):
    return sorted((tuple(r) for r in nj.similar(df, **options).collect()), key=str)


def near_rows(seed, n=150, words=400):
    """Texts of many lengths with chains of edits around the threshold."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    texts = []
    while len(texts) < n:
        ws = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 5, 8, 11, 12, 13, 20, 40, 90, 200]))]
        for _ in range(r.randint(1, 6)):
            texts.append(" ".join(ws))
            for _ in range(r.randint(0, max(1, len(ws) // 50))):
                at = r.randrange(len(ws))
                ws = ws[:at] + r.choice([[], [r.choice(vocabulary)], [ws[at], r.choice(vocabulary)]]) + ws[at + 1:] or ["x"]
    return [(i, t, None, None, None) for i, t in enumerate(texts)]


def test_query_equals_brute_force_with_odd_rows(docs, rows):
    assert found(docs) == brute(rows)


@pytest.mark.parametrize("tile", [nj.TILE, 8])
def test_near_copies_of_all_lengths(spark, tile):
    """With the small tile, families are cut into blocks."""
    rows = near_rows(3)
    got = found(spark.createDataFrame(rows, SCHEMA).repartition(4), tile=tile)
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(rows)


def test_linked_sets_share_a_key():
    """No pair is lost by parting: linked sets that are not equal have a key in common."""
    texts = [t for seed in range(6) for _, t, *_ in near_rows(10 + seed, 120, 60)]
    h, first = nj.shingle_sets(texts, 3)
    keys, edge = nj.group_keys(h, first, 90)
    sets = [set(h[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)]
    assert [len(s) for s in sets] == [len(brute_set(t)) for t in texts]
    named = [set(keys[a:b].tolist()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    linked = [(i, j) for i, j in combinations(range(len(texts)), 2) if sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    assert len(linked) > 50 and all(named[i] & named[j] for i, j in linked)


def test_tree_join_equals_all_pairs():
    r = np.random.default_rng(2)
    for m, k in ((1, 1), (40, 40), (300, 7), (50, 400)):
        sides = []
        for size in (m, k):
            base = r.integers(0, 5, (3, nj.DIMS))
            point = np.maximum(base[r.integers(0, 3, size)] + r.integers(-1, 2, (size, nj.DIMS)) * (r.random((size, nj.DIMS)) < 0.1), 0).astype("<u2")
            point[r.random(size) < 0.05, 0] = 65535
            sides.append((r.integers(0, 3, size), r.integers(0, 9, size), point.sum(axis=1).astype(np.int64), point))
        trees = [nj.RTree(*s) for s in sides]
        for (f, c, n, p), (f2, c2, n2, p2), t, t2 in ((*sides, *trees), (sides[0], sides[0], trees[0], trees[0])):
            want = {(i, j) for i in range(len(n)) for j in range(i + 1 if t is t2 else 0, len(n2)) if f[i] == f2[j] and c[i] != c2[j]
                    and 100 * min(n[i], n2[j]) >= 90 * max(n[i], n2[j]) and nj.bound(p[i:i + 1], p2[j:j + 1])[0] >= nj.needed(n[i], n2[j], 90)}
            got = [(int(i), int(j)) for x, y in t.join(t2, 90) for i, j in zip(x, y, strict=True)]
            got = [tuple(sorted(g)) for g in got] if t is t2 else got
            assert len(got) == len(set(got)) and set(got) == {tuple(sorted(w)) for w in want} if t is t2 else set(got) == want


def test_no_rows_and_no_words(spark, no_docs):
    assert found(no_docs) == []
    rows = [(1, None, None, None, None), (2, " \n", None, None, None), (None, "", None, None, None), (3, "a b", None, None, None), (4, "A  b", None, None, None), (5, "ab", None, None, None)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_a_very_large_set_has_capped_counts(spark):
    r = random.Random(4)
    ws = [str(r.randrange(10**9)) for _ in range(70_000)]
    rows = [(1, " ".join(ws), None, None, None), (2, " ".join(ws[100:]), None, None, None), (3, " ".join(ws[:50_000]), None, None, None)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == [(1, 69_998, 1), (2, 69_898, 1), (3, 49_998, 3)]
