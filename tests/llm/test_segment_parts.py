"""op3_packing: a word is learned once, whatever punctuation is behind it; lists of texts are looked up by columns."""

import random

import numpy as np
import pytest

from toxscan.llm import tokenizing as Z

NAME = "byte_bpe_50k.json"
SOME = ["ab", " the", " foo", "Bar", " ", "\n", "\n\n", "\t", "\r", "\0", "é", "ÿ", "×", " ×!", "ʯ", "ɿ", " straße", "　", " ", "\xa0", "\x85", "\x1c", " 12", "3.5", "'s",
        "'", "_", "...", "!", ",", "%%%", '"', ">", "|>", "<|endoftext|>", "<|endoftext", " x<|endoftext|>.", "😀", " 中文", "ー.", "̈.", "½)", "٣!"]


def texts(n=600):
    some = random.Random(11)
    return ["".join(some.choice(SOME) for _ in range(some.randrange(30))) for _ in range(n)] + ["", "é", ".", "×.", " .", "a.", "　a", "a　 b"]


@pytest.mark.parametrize("cache", [40, 100_000])
@pytest.mark.parametrize("chars", [1, 300, 1 << 21])
def test_ids_and_counts_are_the_librarys(cache, chars, monkeypatch):
    monkeypatch.setattr(Z, "LOOKUP_CHARS", chars)
    ids, counts = Z.SegmentEncoder(NAME, True, cache), Z.SegmentEncoder(NAME, False, cache)
    want = [ids.tokenizer.encode(t, add_special_tokens=False).ids for t in texts()]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.batch(texts())] == want
    assert counts.batch(texts()) == [len(x) for x in want] and counts.batch(["", ""]) == [0, 0] and ids.batch([]) == []


def test_long_texts_come_in_pieces(monkeypatch):
    real = Z.pieces
    monkeypatch.setattr(Z, "pieces", lambda t: real(t, 20))
    ids, counts = Z.SegmentEncoder(NAME, True), Z.SegmentEncoder(NAME, False)
    want = [ids.tokenizer.encode(t, add_special_tokens=False).ids for t in texts()]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.batch(texts())] == want and counts.batch(texts()) == list(map(len, want))


def test_a_word_is_learned_once():
    e = Z.SegmentEncoder(NAME, True)
    words, ends = [f" word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)], ["", ".", ",", "!", "%%%"]
    e.batch(["".join(w + p for w in words for p in ends)])
    assert len(e.known) == len(words) + len(ends) - 1


def test_segment_starts_are_safe_places():
    for t in texts():
        raw = t.encode()
        places = [len(raw[:k].decode()) for k in Z.segment_starts(np.frombuffer(raw, np.uint8)).tolist() if k] if t else []
        assert all(t[p] in " \t\n\v\f\r" and t[p - 1] not in Z._WHITE for p in places)
        assert set(places) >= {p for p in range(1, len(t)) if t[p] in " \n" and t[p - 1] not in Z._WHITE}
