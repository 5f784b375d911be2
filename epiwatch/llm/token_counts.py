"""Token counts by a compiled finite-state tokenizer (byte-level BPE).

Two deterministic transducers, exact for the tokenizer file they are compiled
from; the library is not called on the texts.

1. Splitter, over character classes (8 states). A text is cut into blocks; a
   block's *state map* says for each entry state where the block ends. Maps
   compose through a parallel prefix scan, which gives every block its entry
   state, so all blocks then mark the starts of pre-tokens at once.
2. Token transducer, over bytes. After each byte the encoding of the prefix has
   one last token: the only one that ends there and is compatible with the last
   token before it (merging the two again gives the two). A state holds, for
   each place where a later token can still begin, that place's last token and
   its count against the present one; the transition carries the change of the
   number of emitted tokens. States are compiled when first reached and kept in
   tables of bounded size, like a lazily determinised automaton. All pre-tokens
   of a batch run through it together, a byte at a time.

Cases: a null or empty text has 0 bytes and 0 tokens; repeated rows give a row
each; a null doc_id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from epiwatch.llm.common import id_and_text, in_batches, read_table, totals

#: The classes and contractions of the published pre-tokenizer pattern.
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
SHORT, LONG = "stmd", ("re", "ve", "ll")

# Classes of characters.
LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)
# Symbols: a character with what must be known of the ones after it.
S_LETTER, S_NUMBER, S_OTHER, S_APOS2, S_APOS3, S_IN_BLANKS, S_LAST_SPACE, S_LAST_BLANK = range(8)
FIRST, PAD = 8, 16  # added for the first character of a text; filler
# States: none open, in letters, numbers, others, blanks, after the space that goes with what follows, one or two characters of a contraction to come.
ANY, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, AFTER_SPACE, ONE_MORE, TWO_MORE = range(8)

BLOCK = 128


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    to, cut = np.zeros((17, 8), np.uint8), np.zeros((17, 8), bool)
    stays = {(IN_LETTERS, S_LETTER), (IN_NUMBERS, S_NUMBER), (IN_BLANKS, S_IN_BLANKS), (AFTER_SPACE, S_LETTER), (AFTER_SPACE, S_NUMBER)}
    stays |= {(q, s) for q in (IN_OTHERS, AFTER_SPACE) for s in (S_OTHER, S_APOS2, S_APOS3)}
    opens = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS, S_APOS2: ONE_MORE, S_APOS3: TWO_MORE,
             S_IN_BLANKS: IN_BLANKS, S_LAST_SPACE: AFTER_SPACE, S_LAST_BLANK: ANY}
    for q in range(8):
        for s in range(8):
            to[FIRST + s, q], cut[FIRST + s, q] = opens[s], True
            if q in (ONE_MORE, TWO_MORE):
                to[s, q] = ONE_MORE if q == TWO_MORE else ANY
            elif (q, s) in stays:
                to[s, q] = IN_OTHERS if s in (S_APOS2, S_APOS3) else opens[s]
            else:
                to[s, q], cut[s, q] = opens[s], True
        to[PAD, q] = q
    return to.ravel(), cut.ravel()


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", BLANK)):
        found = regex.compile(pattern)
        out[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and found.match(chr(c))]] = kind
    out[0x20] = SPACE
    return out


class Splitter:
    def __init__(self) -> None:
        self.to, self.cut = _splitter()
        self.kind = _classes()

    def starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens start in ``points`` (code points of texts set end to
        end, each beginning at a place in ``first``, none empty)."""
        n = len(points)
        kind = self.kind[points]
        ends = np.zeros(n, bool)
        ends[first[1:] - 1] = True
        ends[-1] = True
        after = np.append(kind[1:], BLANK)
        after[ends] = BLANK
        symbol = kind.copy()
        last = after < SPACE
        symbol[(kind >= SPACE) & ~last] = S_IN_BLANKS
        symbol[(kind == SPACE) & last] = S_LAST_SPACE
        symbol[(kind == BLANK) & last] = S_LAST_BLANK
        for i in np.flatnonzero(points == ord("'")):
            one = chr(points[i + 1]) if i + 1 < n and not ends[i] else ""
            two = one + chr(points[i + 2]) if one and i + 2 < n and not ends[i + 1] else ""
            if one and one in SHORT:
                symbol[i] = S_APOS2
            elif two in LONG:
                symbol[i] = S_APOS3
        symbol[first] += FIRST
        blocks = -(-n // BLOCK)
        grid = np.full(blocks * BLOCK, PAD, np.uint16)
        grid[:n] = symbol
        grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T) * np.uint16(8)
        maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (blocks, 8))
        for column in grid:
            maps = self.to[column[:, None] + maps]
        entry = np.concatenate([np.zeros(1, np.uint8), self.scan(maps)[:-1, ANY]])
        cuts = np.empty((BLOCK, blocks), bool)
        for column, out in zip(grid, cuts, strict=True):
            at = column + entry
            out[:] = self.cut[at]
            entry = self.to[at]
        return np.flatnonzero(cuts.T.reshape(-1)[:n])

    @staticmethod
    def scan(maps: np.ndarray) -> np.ndarray:
        """Inclusive prefix composition of state maps, in log2 many steps."""
        step = 1
        while step < len(maps):
            maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], maps[:-step], 1)])
            step *= 2
        return maps


#: Nothing read: the first token can begin here, after no token.
START = (b"", ((0, None, 0),))


class Transducer:
    """Counts the tokens of pre-tokens; see the module's text."""

    def __init__(self, tokens: list[bytes], merges: dict[tuple[bytes, bytes], int], most_states: int = 200_000) -> None:
        self.merges, self.most_states = merges, most_states
        self.made = {a + b: (rank, a, b) for (a, b), rank in reversed(merges.items())}
        self.whole: dict[bytes, bool] = {}
        self.tokens = {t for t in tokens if self.canonical(t)}
        self.longer: dict[bytes, list[bytes]] = {}
        for t in self.tokens:
            for k in range(len(t)):
                self.longer.setdefault(t[:k], []).append(t)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.alike: dict[tuple, bytes | None] = {}
        self.reset([START])

    def reset(self, states: list) -> None:
        """Keep these states only; all transitions are compiled anew."""
        self.states, self.ids = list(states), {s: i for i, s in enumerate(states)}
        self.cells = self.capacity = 0
        self.grow(max(1 << 16, 4 * len(states)))

    # Transitions: an open-addressed table from state * 256 + byte.

    def grow(self, capacity: int) -> None:
        old = (self.key, self.to, self.change) if self.cells else None
        self.capacity, self.shift = capacity, np.uint64(64 - (capacity.bit_length() - 1))
        self.capacity = 1 << (capacity.bit_length() - 1)
        self.key = np.full(self.capacity, -1, np.int64)
        self.to, self.change = np.zeros(self.capacity, np.int32), np.zeros(self.capacity, np.int16)
        self.cells = 0
        if old:
            for cell, to, change in zip(*(x[old[0] >= 0].tolist() for x in old), strict=True):
                self.put(cell, to, change)

    def put(self, cell: int, to: int, change: int) -> None:
        if 2 * self.cells > self.capacity:
            self.grow(2 * self.capacity)
        at = (cell * 0x9E3779B97F4A7C15 % 2**64) >> int(self.shift)
        while self.key[at] >= 0:
            at = (at + 1) % self.capacity
        self.key[at], self.to[at], self.change[at] = cell, to, change
        self.cells += 1

    def find(self, cell: np.ndarray) -> np.ndarray:
        """Places of cells in the table; those not compiled yet are compiled."""
        at = ((cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        off = np.flatnonzero(self.key[at] != cell)
        while len(off):
            free = self.key[at[off]] < 0
            if free.any():
                for c in np.unique(cell[off[free]]).tolist():
                    self.compile(c)
                return self.find(cell)
            at[off] = (at[off] + 1) % self.capacity
            off = off[self.key[at[off]] != cell[off]]
        return at

    # Merging.

    def canonical(self, token: bytes) -> bool:
        """Whether the merges make one token of these bytes: its two parts are
        canonical, and no earlier merge goes over the seam between them."""
        if len(token) > 1 and token not in self.whole:
            made = self.made.get(token)
            self.whole[token] = made is not None and self.canonical(made[1]) and self.canonical(made[2]) and self.seam_holds(*made[1:], seam=False)
        return len(token) == 1 or self.whole[token]

    def compatible(self, last: bytes, token: bytes) -> bool:
        """Whether merging ``last + token`` gives these two again: their merges
        are gone through backwards, and no merge over the seam may come before
        the merge that takes away one of the two beside it."""
        key = (last, token)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self.seam_holds(last, token)
        return known

    def seam_holds(self, a: bytes, b: bytes, seam: bool = True) -> bool:
        merges, made, before = self.merges, self.made, 1 << 60
        while True:
            if seam and merges.get((a, b), 1 << 60) < before:
                return False
            seam = True
            of_a, of_b = made.get(a), made.get(b)
            if of_a is None and of_b is None:
                return True
            if of_b is None or of_a is not None and of_a[0] > of_b[0]:
                before, a = of_a[0], of_a[2]
            else:  # a pair that ends in b's first part is further left: it wins a tie
                before, b = of_b[0] + 1, of_b[1]

    def like(self, begun: bytes, last: bytes | None) -> bytes | None:
        """One of the last tokens that allow the same longer tokens as ``last``
        where ``begun`` is the beginning; b"" if none is allowed. Makes states
        that act alike the same."""
        longer = self.longer[begun]
        if last is None or len(longer) > 16:
            return last
        key = (begun, last)
        if (known := self.alike.get(key)) is None:
            if len(self.alike) > 1_000_000:
                self.alike.clear()
            allowed = tuple(t for t in longer if self.compatible(last, t))
            known = self.alike[key] = self.alike.setdefault((begun, allowed), last) if allowed else b""
        return known

    def compile(self, cell: int) -> None:
        """Add the transition of state cell // 256 on byte cell % 256."""
        (context, open_), byte = self.states[cell // 256], bytes([cell % 256])
        grown = [(context[len(context) - n:] + byte, last, count) for n, last, count in open_]
        token, change = next((t, count + 1) for t, last, count in grown if t in self.tokens and (last is None or self.compatible(last, t)))
        kept = [(t, self.like(t, last), count - change) for t, last, count in grown if t in self.longer]
        kept = [x for x in kept if x[1] != b""]
        state = (kept[0][0] if kept else b"", (*((len(t), last, count) for t, last, count in kept), (0, token, 0)))
        to = self.ids.setdefault(state, len(self.states))
        if to == len(self.states):
            self.states.append(state)
        self.put(cell, to, change)

    def counts(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        order = np.argsort(-length, kind="stable")
        at, left = start[order], len(order)
        state, count = np.full(left, self.ids[START], np.int32), np.zeros(left, np.int64)
        longer = np.cumsum(np.bincount(length)[::-1])[::-1]  # texts of k bytes or more
        for k in range(len(longer) - 1):
            left = int(longer[k + 1])
            if len(self.states) > self.most_states:
                live, place = np.unique(np.append(state[:left], self.ids[START]), return_inverse=True)
                state[:left] = place[:-1]
                self.reset([self.states[i] for i in live])
            at_cell = self.find(state[:left].astype(np.int64) * 256 + buf[at[:left] + k])
            count[:left] += self.change[at_cell]
            state[:left] = self.to[at_cell]
        out = np.empty_like(count)
        out[order] = count
        return out


def _byte_of_char() -> dict[str, int]:
    """The published table of byte-level BPE: printable bytes stand for
    themselves, the others for the characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenCounter:
    """Counts tokens as the ``tokenizers`` library does for a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of_char()
        raw = lambda s: bytes(byte[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        merges = {(raw(a), raw(b)): i for i, (a, b) in enumerate(spec["model"]["merges"])}
        self.split = Splitter()
        self.run = Transducer([raw(t) for t in spec["model"]["vocab"] if t not in self.special], merges)
        self.cutter = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        pieces: list[str] = []
        owner: list[int] = []
        for i, t in enumerate(texts):
            parts = [t]
            if any(s in t for s in self.special):  # a special string is one token and parts what is beside it
                out[i] += len(self.cutter.findall(t))
                parts = self.cutter.split(t)
            for p in filter(None, parts):
                pieces.append(p)
                owner.append(i)
        if not pieces:
            return out
        joined = "".join(pieces)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        buf = np.frombuffer(joined.encode(), np.uint8)
        first = np.concatenate([[0], np.cumsum(list(map(len, pieces)))])
        cut = self.split.starts(points, first[:-1])
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        byte_at = np.concatenate([[0], np.cumsum(width)])
        begin = byte_at[cut]
        counted = self.run.counts(buf, begin, np.diff(np.append(begin, len(buf))))
        np.add.at(out, owner, totals(counted, np.searchsorted(cut, first)))
        return out


@lru_cache(2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, batch_chars: int = 1_000_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``;
    ``tokenizer`` is the path of a byte-level BPE file on every machine."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = np.concatenate([np.zeros(0, np.int64), *(counter(tokenizer).counts(texts[a:b]) for a, b in in_batches(texts, batch_chars))])
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs).mapInArrow(count, SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
