"""Best-fit packing with swap-based local search.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens.
Pieces are dealt at random into groups of about ``group_pieces``; each group is
packed by best fit, longest first, and then improved: while the group has more
sequences than its tokens need, the emptiest sequences are worked on with
moves and one-for-one and two-for-one swaps with other underfull sequences.
A step is taken only if it increases the sum of the squared fills, so the
search ends, and steps drive the emptiest sequence towards being empty.

A group loses less than one sequence against the bound of its own tokens
whenever the search reaches that bound, so groups cost about one sequence in
``group_pieces``.

Cases: a null or empty text is the end token alone (one piece of length 1);
every row is packed, also rows that share a doc_id or have none; an empty table
gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiwatch.llm.common import id_and_text, mix, read_table, written
from epiwatch.llm.token_counts import _byte_of_char


#: The pattern of the tokenizer's pre-tokenizer, and its mark of a word's end.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


class _Encoder:
    """Token ids as bytes.

    Texts of Latin letters, which keep their form under NFC and lower-case alike
    everywhere, are cut into words here and given to tiktoken with the
    tokenizer's own vocabulary. The mark of a word's end is a zero byte there: a
    last character and its mark are merged before all else, as their tokens come
    first in the order of merges. All other texts, also those with a zero byte
    or what may be a special string, go to the tokenizers library whole. Nothing
    is remembered between texts."""

    LATIN = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(160, 384)] if c != 0x130]  # İ becomes two characters
    OTHERS = "‐‑‒–—―‘’‚“”„•…"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = self._fast(spec)
        self.other = re.compile("[^" + re.escape("".join(self.LATIN) + self.OTHERS) + "]|<\\|")
        low = sorted({x for c in self.LATIN for x in c.lower()})
        letters, numbers = ("".join(re.escape(c) for c in low if unicodedata.category(c)[0] == kind) for kind in "LN")
        blank = "".join(re.escape(c) for c in low if c.isspace())
        self.words = re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{blank}{letters}{numbers}]").replace(r"\p{L}", letters).replace(r"\p{N}", numbers))

    def _fast(self, spec: dict):
        """None where the file is not of the kind that this handles."""
        import tiktoken

        vocabulary = spec["model"]["vocab"]
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        if (spec["model"].get("end_of_word_suffix") != WORD_END or steps != ["NFC", "Replace", "Lowercase"] or split != PATTERN
                or any(vocabulary[m] != 512 + k for k, m in enumerate(merges))):
            return None
        to_byte, special = _byte_of_char(), {t["content"] for t in spec["added_tokens"]}
        ranks = {}
        for token, i in vocabulary.items():
            if token not in special:
                end = token.endswith(WORD_END)
                ranks[bytes(map(to_byte.__getitem__, token.removesuffix(WORD_END))) + b"\0" * end] = i
        return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or self.other.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary("\0".join([*self.words.findall(text.lower()), ""]))
        return np.array(ids, "<u4").tobytes()


@lru_cache(2)
def _encoder(path: str) -> _Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return _Encoder(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """A row for each piece; ``deal`` is a hash of the piece and of its place in
    the task's input, so equal rows are dealt out too, and a task that runs
    again deals as before."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, encoder = 0, _encoder(tokenizer)
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                out: list[tuple] = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    tokens = encoder.encode(text.as_py()) + end
                    for piece, at in enumerate(range(0, len(tokens), 4 * capacity)):
                        part = tokens[at:at + 4 * capacity]
                        out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), row))
                        row += 1
                cols = list(zip(*out, strict=True))
                deal = mix(np.array(cols[5], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array(cols[4], np.uint64)) >> np.uint64(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols[:5], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] + [pa.array(deal, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

    return id_and_text(docs).mapInArrow(run, PIECES)


def best_fit(length: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: longest first, into the fullest bin it fits."""
    bins_with: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free room
    some = 0  # bit r: a bin with free room r
    out, n = np.empty(len(length), np.int64), 0
    for i in np.argsort(-length, kind="stable").tolist():
        size = int(length[i])
        at = some >> size
        if at:
            room = size + (at & -at).bit_length() - 1
            b = bins_with[room].pop()
            if not bins_with[room]:
                some &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        out[i] = b
        if room > size:
            bins_with[room - size].append(b)
            some |= 1 << (room - size)
    return out


def improve(length: np.ndarray, bin_of: np.ndarray, capacity: int, steps: int = 1500) -> np.ndarray:
    """Local search over a packing; returns a packing of as many bins or fewer.
    ``steps`` bounds the effort where the tokens' bound can't be reached."""
    bin_of = np.unique(bin_of, return_inverse=True)[1]
    fill = np.bincount(bin_of, weights=length).astype(np.int64)
    needed = -(-int(length.sum()) // capacity)
    live = np.ones(len(fill), bool)
    stuck: set[int] = set()
    while live.sum() > needed and steps > 0:
        steps -= 1
        open_ = [int(b) for b in np.flatnonzero(live) if b not in stuck]
        if not open_:
            break
        victim = min(open_, key=lambda b: (fill[b], b))
        step = _best_step(length, bin_of, fill, live, victim, capacity)
        if step is None:
            stuck.add(victim)
            continue
        stuck.clear()
        items, to, back = step
        moved = int(length[items].sum() - length[back].sum())
        bin_of[items], bin_of[back] = to, victim
        fill[victim] -= moved
        fill[to] += moved
        live[victim] = fill[victim] > 0
    return np.unique(bin_of, return_inverse=True)[1]


def _best_step(length: np.ndarray, bin_of: np.ndarray, fill: np.ndarray, live: np.ndarray, victim: int, capacity: int):
    """The step out of ``victim`` that increases the squared fills most: items
    that go, the bin they go to, items that come back. None if none does."""
    room = np.where(live, capacity - fill, 0)
    room[victim] = 0
    mine = np.flatnonzero(bin_of == victim)
    others = np.flatnonzero((room[bin_of] > 0) & (bin_of != victim))
    best, step = 0, None

    def gain(d, b):  # of moving d tokens from victim to bin b
        return np.where((d > 0) & (d <= room[b]), 2 * d * (fill[b] - fill[victim] + d), 0)

    def look(items, back, d, b) -> None:
        nonlocal best, step
        g = gain(d, b)
        if len(g) and (k := int(g.argmax())) is not None and g[k] > best:
            best, step = int(g[k]), (np.array(items), int(b[k]), np.array(back(k), np.int64))

    bins = np.flatnonzero(room > 0)
    pair_a, pair_b = _pairs(bin_of, others)
    for i in dict(zip(length[mine].tolist(), mine.tolist(), strict=True)).values():
        look([i], lambda k: [], np.full(len(bins), length[i]), bins)  # move
        look([i], lambda k: [others[k]], length[i] - length[others], bin_of[others])  # one for one
        look([i], lambda k: [pair_a[k], pair_b[k]], length[i] - length[pair_a] - length[pair_b], bin_of[pair_a])  # one for two
    for x in range(len(mine)):
        for y in range(x):
            two = length[mine[x]] + length[mine[y]]
            look([mine[x], mine[y]], lambda k: [others[k]], two - length[others], bin_of[others])  # two for one
    return step


def _pairs(bin_of: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of items of one bin: all in bins of few items, else of neighbours in size order."""
    order = items[np.argsort(bin_of[items], kind="stable")]
    a, b = [], []
    for gap in range(1, 9):
        same = np.flatnonzero(bin_of[order[gap:]] == bin_of[order[:-gap]])
        a.append(order[:-gap][same])
        b.append(order[gap:][same])
    return np.concatenate(a), np.concatenate(b)


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, group_pieces: int = 8192) -> DataFrame:
    """A row for each piece with the sequence it is in and its place there."""
    every = written(pieces(docs, tokenizer, end_id, capacity), "pieces")
    groups = max(1, -(-every.count() // group_pieces))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "deal"], kind="stable").reset_index(drop=True)
        length = group["length"].to_numpy()
        bins = improve(length, best_fit(length, capacity), capacity)
        group["sequence_id"] = bins + (int(group["grp"].iloc[0]) << 32)
        group["offset"] = group.groupby("sequence_id")["length"].cumsum() - group["length"]
        return group[[c.split()[0] for c in PACKED.split(", ")]]

    dealt = every.withColumn("grp", F.pmod("deal", F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(run, PACKED)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
