"""Token alignment against the owners of each byte."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import SCHEMA

from epiwatch.llm import token_alignment as ta

A, B = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def tok():
    return ta.tokenizers(A, B)


def spans(ids, table):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(table[i])))
        at += len(table[i])
    return out


def brute_one(tok, text):
    """(n_a, n_b, n_groups, links, groups text) of one text, by the libraries'
    single calls and the tokens that own each byte."""
    if not text:
        return 0, 0, 0, [], ""
    a, b = tok.a.encode(" " + text, add_special_tokens=False).ids, tok.b.encode(text)
    joined = [b"".join(t[i] for i in ids) for ids, t in ((a, tok.a_bytes), (b, tok.b_bytes))]
    if joined != [(" " + text).encode()] * 2:
        return 0, 0, 0, [], ""
    sa, sb = spans(a, tok.a_bytes), spans(b, tok.b_bytes)
    owner = [[i for i, (x, y) in enumerate(s) for _ in range(x, y)] for s in (sa, sb)]  # of each byte
    links = [(a[i], b[j]) for i, j in sorted(set(zip(*owner, strict=True)))]
    cuts = sorted({e for _, e in sa} & {e for _, e in sb})
    both = [[[] for _ in cuts] for _ in "ab"]
    for out, ids, s in zip(both, (a, b), (sa, sb), strict=True):
        for i, (_, end) in zip(ids, s, strict=True):
            out[bisect_left(cuts, end)].append(str(i))
    return len(a), len(b), len(cuts), links, ";".join(",".join(x) + "|" + ",".join(y) for x, y in zip(*both, strict=True))


def brute(tok, rows):
    one = [(r[0], *brute_one(tok, r[1])) for r in rows]
    held = Counter(p for *_, links, _ in one for p in set(links))
    most = {}
    for (a, _), n in held.items():
        most[a] = max(n, most.get(a, 0))
    return sorted(((d, n_a, n_b, n_g, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(g.encode()).hexdigest() if n_a else "") for d, n_a, n_b, n_g, links, g in one), key=str)


def test_bytes_of_ids_equal_the_libraries(tok):
    assert all(tok.a.decode([i]).encode() == x for i, x in enumerate(tok.a_bytes[:50256]) if b"\xef\xbf\xbd" not in tok.a.decode([i]).encode())
    assert len(tok.b_bytes) == 32000 and tok.b_bytes[3:259] == [bytes([k]) for k in range(256)]


def test_gallop_equals_searchsorted():
    r = np.random.default_rng(0)
    for n in (1, 2, 10, 1000):
        into = np.cumsum(r.integers(1, 9, n))
        values = r.integers(0, into[-1] + 1, 500)
        at = r.integers(0, n, 500)
        assert (ta.gallop(values, into, at) == np.searchsorted(into, values)).all()


def test_query_equals_brute_force_with_odd_rows(spark, tok, docs, rows):
    got = sorted((tuple(r) for r in ta.alignment(docs, A, B).collect()), key=str)
    assert got == brute(tok, rows)


def test_small_chunks_random_characters_and_special_strings(spark, tok):
    r = random.Random(5)
    alphabet = "ab  \n\t.é日🙂�\x00²½A0 ▁ñ'"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(150)]
    texts += ["<|endoftext|> and </s> <s><unk> <0x41>", "▁▁a", " ", "a" * 3000, "z" * 1, "the the the", None, ""]
    rows = [(i % 100, t, None, None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    chunks = ta.alignments(df, A, B, chunk_chars=300)
    assert chunks.count() > 5
    old = ta.alignments
    try:
        ta.alignments = lambda *a: old(*a, chunk_chars=300)
        got = sorted((tuple(x) for x in ta.alignment(df, A, B).collect()), key=str)
    finally:
        ta.alignments = old
    assert got == brute(tok, rows)


def test_no_rows_and_only_empty_texts(spark, no_docs):
    assert ta.alignment(no_docs, A, B).count() == 0
    got = ta.alignment(spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None)], SCHEMA), A, B).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
