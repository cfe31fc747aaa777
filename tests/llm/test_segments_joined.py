"""op3_packing: new segments are encoded as one text, and cut again by the bytes of their ids."""

import random

import pytest

from toxscan.llm import tokenizing as Z

NAME = "byte_bpe_50k.json"


def texts(n=400):
    some = random.Random(5)
    return ["".join(some.choice(["ab", " ", " the", "\n", "\t", "\0", "é", "　", " 12", "ß.", "  x", "<|endoftext|>", "😀"]) for _ in range(some.randrange(40)))
            for _ in range(n)] + ["", " ", " a", "a "]


@pytest.mark.parametrize("ids", [True, False])
def test_joined_segments_equal_single_ones(ids, monkeypatch):
    monkeypatch.setattr(Z, "JOINED_SEGMENTS", 16)
    joined, alone = Z.SegmentEncoder(NAME, ids), Z.SegmentEncoder(NAME, ids)
    monkeypatch.setattr(alone, "_learn_joined", lambda part: False)
    assert joined.batch(texts()) == alone.batch(texts()) and joined.known == alone.known


def test_few_texts_are_encoded():
    e = Z.SegmentEncoder(NAME, True)
    seen, plain = [], e.tokenizer

    class Counting:
        def __getattr__(self, name):
            return getattr(plain, name)

        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return plain.encode_batch_fast(texts, **options)

    e.tokenizer = Counting()
    e.batch([" ".join(f"word{i}" for i in range(1000))])
    assert len(e.known) == 1000 and len(seen) <= 4


def test_segments_join_to_the_text():
    assert all("".join(Z.segments(t)) == t for t in texts())
    assert Z.segments("a b\nc") == ["a", " b", "\nc"] and Z.segments("a  b") == ["a", "  b"] and Z.segments(" a") == [" a"]
