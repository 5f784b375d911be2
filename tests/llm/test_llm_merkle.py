"""Merkle manifest against hashlib on plain lists."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from llm_fixtures import SCHEMA, lower

from epiwatch.llm import merkle


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute_leaf(row, tampered=False):
    doc_id, text, lang, source, n_chars = row
    if tampered and text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
        text = lower(text)
    return H(field(x) for x in (doc_id, source, lang, n_chars, text))


def tree(nodes, fanout):
    """Levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([H(now[k:k + fanout]) for k in range(0, len(now), fanout)])
    return levels


def way(levels, i, fanout):
    """(place in the run, the run) of each level on the way up from node i."""
    out = []
    for now in levels[:-1]:
        out.append((i % fanout, now[i // fanout * fanout:i // fanout * fanout + fanout]))
        i //= fanout
    return out


def brute(rows, fanout=16):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for rs in by_source.values():
        rs.sort(key=lambda r: (r[0] is None, r[0] or 0, brute_leaf(r)))
    trees = {s: tree([brute_leaf(r) for r in rs], fanout) for s, rs in by_source.items()}
    top = tree([trees[s][-1][0] for s in names], fanout) if names else None
    out = []
    for k, s in enumerate(names):
        for i, row in enumerate(by_source[s]):
            steps = way(trees[s], i, fanout) + way(top, k, fanout)
            now = brute_leaf(row, tampered=True)
            for slot, run in steps:
                now = H([*run[:slot], now, *run[slot + 1:]])
            proof = H(x for slot, run in steps for j, x in enumerate(run) if j != slot)
            out.append((row[0], brute_leaf(row), trees[s][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=str)


def found(spark, rows, fanout=16):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted((tuple(r) for r in merkle.proofs(merkle.manifest(df, fanout)).collect()), key=str)


def test_constants_and_resumed_states_equal_hashlib():
    r = random.Random(1)
    for n in (1, 2, 7, 16):
        children = [bytes(r.randrange(256) for _ in range(32)) for _ in range(n)]
        states, digest = merkle.parents([b"".join(children)] * 3)
        want = hashlib.sha256("".join(c.hex() for c in children).encode()).digest()
        assert digest == [want] * 3
        for slot in range(n):
            new = bytes(r.randrange(256) for _ in range(32))
            state = np.frombuffer(states[0][32 * slot:32 * slot + 32], ">u4").astype(np.uint32)[None]
            right = np.frombuffer(b"".join(children[slot + 1:]), np.uint8).reshape(1, -1, 32)
            got = merkle.folded(state, np.frombuffer(new, np.uint8)[None], right, np.array([n - slot - 1]), np.array([n]))
            assert got.tobytes() == hashlib.sha256("".join(c.hex() for c in [*children[:slot], new, *children[slot + 1:]]).encode()).digest()


def test_query_equals_brute_force_with_odd_rows(spark, docs, rows):
    got = sorted((tuple(r) for r in merkle.proofs(merkle.manifest(docs)).collect()), key=str)
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}
    assert all(r[-1] == (brute_leaf(row) == brute_leaf(row, True)) for r in got for row in rows if brute_leaf(row) == r[1])


@pytest.mark.parametrize("fanout", [3, 16])
def test_uneven_trees(spark, fanout):
    r = random.Random(fanout)
    rows = [(i, f"Text {i}" * r.randint(0, 3), None, f"é{s}" if s else None, i) for s, n in enumerate([1, 2, 16, 17, 28, 257 if fanout == 16 else 40]) for i in range(n)]
    assert found(spark, rows, fanout) == brute(rows, fanout)


def test_one_source_one_row_many_sources_and_none(spark, no_docs):
    one = [(3, "ABC", "en", "s", 3)]
    assert found(spark, one) == brute(one)
    alone = [(i, "X", None, "s", None) for i in range(5)]
    assert found(spark, alone) == brute(alone)
    many = [(i, "Long" * 50_000 if i == 7 else "y", None, str(i), 1) for i in range(40)]
    assert found(spark, many) == brute(many)
    m = merkle.manifest(no_docs)
    assert m.root is None and merkle.proofs(m).count() == 0
