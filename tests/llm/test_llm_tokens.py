"""Token counts, SentencePiece codec and packing against the public libraries."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from epiwatch.llm.packing import best_fit, improve, pack
from epiwatch.llm.piece_codec import codec, encode_decode
from epiwatch.llm.token_counts import ANY, Splitter, counter, token_counts

BYTE_BPE, WORD_BPE, PIECES = (str(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def odd_texts(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    some = " \n\t'sStdrevlmaä é1２3!?.,-_🙂中文ßñ 　​\x1c\x85▁<|endoftext|><0x0A></s>ΣςİÍ"
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 60))) for _ in range(n)]
    texts += ["".join(chr(r.choice([r.randint(1, 0xD7FF), r.randint(0xE000, 0x10FFFF), r.randint(32, 126)])) for _ in range(25)) for _ in range(n // 3)]
    return [*texts, "", " ", "a" * 700, " " * 90, "-" * 300, "I'll they're don't 'sx ''s 'rex  \n x", "a<|endoftext|> b  <|endoftext|>", "▁▁ a▁b"]


def test_counts_equal_the_library():
    texts = odd_texts(900, 1)
    want = [len(e.ids) for e in Tokenizer.from_file(BYTE_BPE).encode_batch(texts, add_special_tokens=False)]
    assert counter(BYTE_BPE).counts(texts).tolist() == want


def test_counts_with_tables_emptied_midway():
    texts = odd_texts(300, 2)
    c = counter(BYTE_BPE)
    want, most = c.counts(texts).tolist(), c.run.most_states
    c.run.most_states = 50
    try:
        assert c.counts(texts).tolist() == want
    finally:
        c.run.most_states = most


def test_state_maps_compose_like_running_through():
    s = Splitter()
    maps = np.random.default_rng(0).integers(0, 8, (37, 8)).astype(np.uint8)
    state, out = ANY, []
    for m in maps:
        state = m[state]
        out.append(state)
    assert s.scan(maps)[:, ANY].tolist() == out


def test_token_counts_rows(docs, rows, no_docs):
    library = Tokenizer.from_file(BYTE_BPE)
    want = Counter()
    for i, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 1024] += 1
    assert Counter(map(tuple, token_counts(docs, BYTE_BPE, batch_chars=5000).collect())) == want
    assert token_counts(no_docs, BYTE_BPE).count() == 0


def test_encoding_and_decoding_equal_the_library():
    library, c = sentencepiece.SentencePieceProcessor(model_file=PIECES), codec(PIECES)
    for t in odd_texts(900, 3):
        ids = library.encode(t)
        assert c.encode(t) == ids
        assert c.decode([*ids, 2]) == library.decode([*ids, 2])
    r = random.Random(4)
    for _ in range(1500):
        ids = [r.choice([r.randint(0, 400), r.randint(0, 31999)]) for _ in range(r.randint(0, 12))]
        assert c.decode(ids) == library.decode(ids)


def test_codec_numbers_and_pieces_beside_stops():
    """Numbers that are no digits join with stops in some pieces, letters do not."""
    library, c = sentencepiece.SentencePieceProcessor(model_file=PIECES), codec(PIECES)
    odd = "²³¹¼½¾ⅧⅠ①②٣१"
    texts = [f"10 m{a}{stop}{after}" for a in odd for stop in ",.;:!?" for after in ("", " x", "y", a)]
    for i in range(3, library.get_piece_size()):
        piece = library.id_to_piece(i).replace("▁", " ")
        texts.append(f"{piece}{',.;:!?'[i % 6]}{piece}")
    r = random.Random(8)
    alphabet = odd + "abé ñ ,.;:!?_0A日"
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 30))) for _ in range(20_000)]
    wrong = [t for t, ids in zip(texts, library.encode(texts), strict=True) if c.encode(t) != ids]
    assert wrong == []


def test_cutting_into_parts_takes_little_time():
    """What is asked of the letter before a stop is asked there alone: a set of all numbers at
    every word took twenty times as long as finding the words."""
    import re
    import time
    c, r = codec(PIECES), random.Random(15)
    texts = ["".join(r.choice(["▁", "▁the", "▁word", "²", "½", "a", "9", "_", "é", "٣", ".", ",", "①"]) for _ in range(12)) for _ in range(3000)]
    number = "".join(x for x in "²½①")
    slow = re.compile(f"▁*\\w*[^\\W\\d_{number}](?=[,.;:!?])|▁*[^▁]+|▁+")
    assert [c.parts.findall(x) for x in texts] == [slow.findall(x) for x in texts]
    text = "▁some▁plain▁words▁and▁a▁stop." * 20_000

    def least(pattern):
        times = []
        for _ in range(3):
            t = time.perf_counter()
            pattern.findall(text)
            times.append(time.perf_counter() - t)
        return min(times)

    assert least(c.parts) < 8 * least(re.compile("▁*[^▁]+"))


def test_codec_rows(docs, rows, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for i, t, *_ in rows:
        ids = [*library.encode(t or ""), 2]
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert Counter(map(tuple, encode_decode(docs, PIECES).collect())) == want
    assert encode_decode(no_docs, PIECES).count() == 0


@pytest.mark.parametrize("groups", [8192, 20])
def test_packing_keeps_every_token_once(docs, rows, no_docs, groups):
    library = Tokenizer.from_file(WORD_BPE)
    got = pack(docs, WORD_BPE, capacity=512, group_pieces=groups).toPandas()
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 512):
            part = ids[k:k + 512]
            want[-1 if i is None else i, k // 512, k, len(part), zlib.crc32(part.tobytes())] += 1
    found = got.assign(doc_id=got["doc_id"].fillna(-1).astype(int))
    assert Counter(found[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]]
        assert s["length"].sum() <= 512
    if groups == 8192:
        assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 512) + 1
    assert pack(no_docs, WORD_BPE).count() == 0


def test_local_search_saves_bins_and_loses_nothing():
    r = np.random.default_rng(5)
    saved = 0
    for low, high, n in ((100, 210, 300), (130, 150, 200), (1, 400, 300), (400, 401, 5)):
        length = r.integers(low, high, n)
        first = best_fit(length, 400)
        better = improve(length, first, 400)
        assert np.bincount(better, weights=length).max() <= 400
        assert better.max() <= first.max()
        saved += int(first.max() - better.max())
    assert saved > 5
