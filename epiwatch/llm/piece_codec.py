"""SentencePiece (BPE with byte fallback) encoding and decoding.

Encoding finds the one sequence of pieces in which all neighbours are
compatible, which is what the merges give: an Aho-Corasick automaton yields the
longest piece at each place, a piece is taken if merging it with the piece
before gives the two again, else the next shorter one is tried, and where none
is left the last piece is taken back; a bitfield keeps the places from which no
sequence goes on, so none is tried twice. The library is not called on texts.

No piece holds U+2581 after another character, nor some of the stops after a
letter (looked up when the model is read, for the very letters that end a part), so no merge crosses such a
place: a text is cut there, and the parts, which recur, are remembered in a
table of bounded size.

Cases: a null or empty text gives the end id alone and decodes to the empty
text; repeated rows give a row each; a null doc_id stays null.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from epiwatch.llm.common import id_and_text, read_table

MARK = "▁"  # stands for a space
#: Fixed values of the model format: types of pieces.
NORMAL, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 3, 4, 5, 6


class _Known(dict):
    """part -> ids, filled on demand and emptied when it is full."""

    def __init__(self, encode, most: int) -> None:
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, part: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        ids = self[part] = self.encode(part)
        return ids


class PieceCodec:
    def __init__(self, path: str, most_parts: int = 400_000) -> None:
        from sentencepiece import sentencepiece_model_pb2 as format

        model = format.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models that leave texts as they are, but for the space before them, are handled")
        if any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("models with user-defined pieces are not handled")
        self.score = {p.piece: p.score for p in model.pieces if p.type in (NORMAL, UNUSED)}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, UNUSED)}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.end_id = next(i for i, p in enumerate(model.pieces) if p.piece == "</s>")
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.text_of = [p.piece.replace(MARK, " ") if p.type in (NORMAL, UNUSED) else "" for p in model.pieces]
        self.text_of[0] = model.trainer_spec.unk_surface
        self.control = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        self.spaced = {i for p, i in self.id.items() if p.startswith(MARK)}
        self.number = [str(i) for i in range(len(model.pieces))]
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece goes on over a space")
        # Letters: what \w takes, but for digits and numbers such as superscripts, which pieces do join with a stop.
        number = "".join(re.escape(c) for c in map(chr, range(128, sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
        letter = f"[^\\W\\d_{number}]"
        inside = {b for p in self.score for a, b in zip(p, p[1:]) if re.match(letter, a)}  # noqa: B905
        stops = "".join(re.escape(c) for c in ",.;:!?" if c not in inside) or MARK
        # A part before a stop: a run of \w whose last character is a letter. What is asked of that
        # character comes after the stop is seen, as few places have one.
        self.parts = re.compile(f"{MARK}*+\\w++(?=[{stops}])(?<=[^\\W\\d_])(?<![{number}])|{MARK}*[^{MARK}]+|{MARK}+")
        self.whole = {p for p in self.score if self.merged(p) == [p]}
        self.shorter: dict[str, str | None] = {}
        self.holds: dict[tuple[str, str], bool] = {}
        self.most_chars = max(map(len, self.whole))
        self.find = ahocorasick.Automaton()
        for p in self.whole:
            self.find.add_word(p, len(p))
        self.find.make_automaton()
        self.known = _Known(self.encode_part, most_parts)

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text: the pair of the best score
        first, the leftmost of equals."""
        parts, score, none = list(text), self.score.get, float("-inf")
        pairs = [score(a + b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while pairs and (best := max(pairs)) > none:
            at = pairs.index(best)
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def compatible(self, a: str, b: str) -> bool:
        if (known := self.holds.get((a, b))) is None:
            if len(self.holds) > 500_000:
                self.holds.clear()
            known = self.holds[a, b] = self.merged(a + b) == [a, b]
        return known

    def next_shorter(self, piece: str) -> str | None:
        if piece not in self.shorter:
            self.shorter[piece] = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.whole), None)
        return self.shorter[piece]

    def longest(self, part: str, at: int) -> str:
        """The longest piece at a place (else its character), from how far the
        automaton's trie goes along with the text."""
        ahead = part[at:at + self.most_chars]
        ahead = ahead[:self.find.longest_prefix(ahead)] or ahead[:1]
        return ahead if ahead in self.whole else self.next_shorter(ahead) or ahead[:1]

    def split(self, part: str) -> list[str]:
        """The pieces of ``part``; a character that no piece has stands alone."""
        if part in self.whole:
            return [part]
        dead = bytearray(len(part) // 8 + 1)  # a bit for each place
        out: list[str] = []
        at, piece = 0, self.longest(part, 0)
        while piece:
            end = at + len(piece)
            if not dead[end >> 3] >> (end & 7) & 1 and (not out or self.compatible(out[-1], piece)):
                out.append(piece)
                at, piece = end, self.longest(part, end)
            elif shorter := self.next_shorter(piece):
                piece = shorter
            else:
                dead[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
        return out

    def encode_part(self, part: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.split(part):
            if (i := self.id.get(piece)) is not None:
                out.append(i)
            else:
                out.extend(self.byte_id[b] for b in piece.encode())
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.known.__getitem__, self.parts.findall(MARK + text.replace(" ", MARK)))))

    def decode(self, ids: list[int]) -> str:
        """Pieces set end to end without the space put before the text; runs of
        bytes as UTF-8, each byte that is none as U+FFFD."""
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join(map(self.text_of.__getitem__, ids))
        else:
            out: list[str] = []
            run = bytearray()
            for i in chain(ids, [None]):
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                while run:
                    try:
                        out.append(run.decode())
                        run.clear()
                    except UnicodeDecodeError as e:
                        out.append(run[:e.start].decode() + "�")
                        del run[:e.start + 1]
                if i is not None:
                    out.append(self.text_of[i])
            text = "".join(out)
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if first in self.spaced else text


@lru_cache(2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``,
    the end id included; ``model`` is the path of the model on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                ids = [*c.encode(text.as_py()), c.end_id]
                rows.append((len(ids), hashlib.sha256(" ".join(map(c.number.__getitem__, ids)).encode()).hexdigest(),
                             hashlib.sha256(c.decode(ids).encode()).hexdigest()))
            n, encoded, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, SCHEMA)


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(read_table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))
