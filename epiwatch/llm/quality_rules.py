"""Quality rules with suffix-array repetition.

The suffixes of a text's words are sorted by prefix doubling; the ranks of the
doublings also give the longest common prefix (LCP) of neighbours in the suffix
array. An LCP interval of value n holds the places where one substring of n
words recurs; those that cannot be extended on either side are the maximal
repeated substrings. Their spans are united; a text is rejected if the share of
its words in such spans, or the longest of them, is over its limit.

A word of a repeat of WINDOW words or more is a word in a window of that length
found twice, so the base rule's count is the size of the union of those. The
share has a shorter least length of its own (LEAST), so that it also rejects
what has no window found twice, such as a slogan between changing words. Texts
without any run of LEAST words found twice (by 64-bit hash) have no repeat that
counts and need no suffix array.

Cases: null and empty texts have no words, fail the base and are not kept;
repeated rows give a row each; a null doc_id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from epiwatch.llm.common import Words, grams, id_and_text, in_batches, read_table, totals

SYMBOLS = b"#*$%&|<>"
WINDOW = 8  # words of the base rule's window
LEAST = 4  # words of the shortest repeat that counts towards the share


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sa, lcp): places in order of their suffixes; lcp[i] is the common
    prefix of the suffixes at sa[i - 1] and sa[i], lcp[0] = 0."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    levels, step = [rank], 1
    sa = np.argsort(rank, kind="stable")
    while rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        sa = np.argsort(key, kind="stable")
        in_order = key[sa]
        rank = np.empty(n, np.int64)
        rank[sa] = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])])
        levels.append(rank)
        step *= 2
    lcp = np.zeros(n, np.int64)
    a, b = sa[:-1].copy(), sa[1:].copy()
    at = np.arange(1, n)
    for level in range(len(levels) - 1, -1, -1):
        # Equal ranks at a level stand for 2^level equal words (or ends alike, which separators rule out).
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[levels[level][a[inside]] == levels[level][b[inside]]]
        lcp[at[same]] += 1 << level
        a[same] += 1 << level
        b[same] += 1 << level
    return sa, lcp


def repeats(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the occurrences of repeated substrings of ``least``
    words or more: for each place the longest that recurs, from the LCP
    interval the place is in; those that extend to the left are left out."""
    sa, lcp = suffix_array(words)
    longest = np.zeros(len(words) + 1, np.int64)
    np.maximum.at(longest, sa[1:], lcp[1:])
    np.maximum.at(longest, sa[:-1], lcp[1:])
    # At a place whose left neighbour's repeat is one longer, that one covers this.
    inner = np.concatenate([[False], longest[:-2] == longest[1:-1] + 1]) if len(words) else np.zeros(0, bool)
    start = np.flatnonzero((longest[:-1] >= least) & ~inner)
    return start, longest[start]


def _repetition(w: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words in repeats of WINDOW or more, words of the longest of these, words
    in repeats of ``least`` or more) of every text of a batch."""
    covered, longest, short = (np.zeros(len(w.count), np.int64) for _ in range(3))
    h = w.hashes() + w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # words of one text are alike, not those of two
    g, at = grams(h, w.doc, min(least, WINDOW))
    order = np.argsort(g, kind="stable")
    twice = np.flatnonzero(g[order][1:] == g[order][:-1])
    texts = np.unique(w.doc[at[order[twice]]])
    if not len(texts):
        return covered, longest, short
    # The suffix array of these texts set end to end, each closed by a mark of its own.
    ids = np.unique(h, return_inverse=True)[1]
    parts = [np.append(ids[w.first[d]:w.first[d + 1]], len(h) + d) for d in texts]
    joined = np.concatenate(parts)
    first = np.concatenate([[0], np.cumsum(list(map(len, parts)))])
    start, length = repeats(joined, min(least, WINDOW))

    def united(some: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(joined) + 1, np.int64)
        np.add.at(edge, start[some], 1)
        np.add.at(edge, start[some] + length[some], -1)
        return totals(np.cumsum(edge[:-1]) > 0, first)

    long = length >= WINDOW
    covered[texts], short[texts] = united(long), united(length >= least)
    np.maximum.at(longest, texts[np.searchsorted(first, start[long], "right") - 1], length[long])
    return covered, longest, short


def _dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


COLUMNS = {"doc_id": "long", "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
           "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "longest_repeat": "long"}


def _measures(texts: list[str], max_covered: float, max_longest: int, least: int) -> list[np.ndarray]:
    w = Words(texts)
    first_byte = w.text_start
    is_start = (w.buf & 0xC0) != 0x80  # of a code point
    points = np.concatenate([[0], np.cumsum(is_start)])
    word_chars = totals(points[w.end] - points[w.start], w.first)
    n_symbols = totals(np.isin(w.buf, np.frombuffer(SYMBOLS, np.uint8)), first_byte)
    n_dup = np.fromiter(map(_dup_lines, texts), np.int64, len(texts))
    covered, longest, short = _repetition(w, least)
    failed = (w.count < 20) | (100 * covered > 30 * w.count)
    kept = ~failed & (short <= max_covered * w.count) & (longest <= max_longest)
    return [w.count, word_chars, n_symbols, n_dup, covered, failed, kept, longest]


def quality(docs: DataFrame, max_covered: float = 0.3, max_longest: int = 100, passed: bool = False,
            batch_chars: int = 1_000_000, least: int = LEAST) -> DataFrame:
    """The measures and the verdict of every row; with ``passed``, the rows of
    ``docs`` that are kept, as they are.

    A text is kept unless the base fails, more than ``max_covered`` of its
    words lie in repeats of ``least`` words or more, or a repeat has more than
    ``max_longest`` words.
    """
    def verdicts(texts: list[str]) -> list[np.ndarray]:
        found = [_measures(texts[a:b], max_covered, max_longest, least) for a, b in in_batches(texts, batch_chars)]
        return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, bool)] * (len(COLUMNS) - 1)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = verdicts(batch.column("text").to_pylist())
            kinds = [pa.int64() if k == "long" else pa.bool_() for k in list(COLUMNS.values())[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(got, kinds, strict=True))], names=list(COLUMNS))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(verdicts(texts)[6], pa.bool_()))

    if passed:
        return docs.mapInArrow(keep, docs.schema)
    return id_and_text(docs).mapInArrow(report, ", ".join(f"{k} {v}" for k, v in COLUMNS.items()))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"))
