"""Ids and id counts of whole texts by a public tokenizer file, in batches.

A byte-level BPE file without normalizer splits a text before it merges, and no split reaches across
a change from a character that is not white space to one that is. So a text may be cut there: the ids
of the segments, joined, are the ids of the text. Nor does a split reach from a letter or digit to
punctuation behind it, so a segment is a word and the punctuation at its end, two parts. Most parts come again
and again: each task encodes every distinct one once (``encode_batch_fast`` over the missing ones) and looks
the others up, a column of a list of texts at a time. The special string of the file holds no white space, so no cut
between segments falls inside it; a segment that holds one is a part by itself.
"""

from __future__ import annotations

import array
import os
import re
import string
from collections.abc import Iterator
from itertools import islice, repeat
from operator import itemgetter

from toxscan.llm.common import byte_batches, keeps

# The characters with the Unicode property White_Space.
WHITE_SPACE = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

_WHITE = frozenset(WHITE_SPACE.replace("\t-\r", "\t\n\v\f\r"))
_last = itemgetter(-1)
_SEGMENT = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
_CUT = re.compile(f"(?<=[^{WHITE_SPACE}])[{WHITE_SPACE}]")

#: Parts of segments that are encoded as one text.
JOINED_SEGMENTS = 512

#: Distinct parts of segments a worker keeps from task to task; beyond that the table starts anew (results do not change).
CACHE_SEGMENTS = 1_200_000

#: Characters of the texts whose segments are looked up at once.
LOOKUP_CHARS = 1 << 21


def pieces(text: str, limit: int = 1 << 20) -> Iterator[str]:
    """``text`` in parts of about ``limit`` characters, cut only at safe places. A run without white
    space stays whole, however long."""
    start = 0
    while len(text) - start > limit:
        m = _CUT.search(text, start + limit)
        if m is None:
            break
        yield text[start:m.start()]
        start = m.start()
    yield text[start:] if start else text


def segments(text: str) -> list[str]:
    """``text`` cut at every safe place: the plain form of ``segment_starts``, which leaves out white space beyond ASCII."""
    if "\0" not in text:
        cut = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        if not cut[0] and len(cut) > 1:
            del cut[0]
        if _WHITE.isdisjoint(map(_last, cut[:-1])):  # no white space before a cut
            return cut
    return _SEGMENT.findall(text)


def file_path(name: str) -> str:
    """A tokenizer file by its path, or by its name among the public tokenizers."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def segment_starts(data):
    """Places in UTF-8 bytes where ASCII white space follows a character that is none."""
    import numpy as np

    def ascii_white(b):
        return (b == 0x20) | ((b >= 0x09) & (b <= 0x0D))

    at = np.flatnonzero(ascii_white(data))
    before = data[at - 1]
    white = ascii_white(before)
    high = np.flatnonzero(before >= 0x80)
    if len(high):
        end = at[high]
        code = (data[end - 3].astype(np.int32) << 16) | (data[end - 2].astype(np.int32) << 8) | before[high]
        beyond = [int.from_bytes(c.encode()) for c in _WHITE if not c.isascii()]
        white[high] = np.isin(code, beyond) | np.isin(code & 0xFFFF, beyond)
    return at[~white]


def word_ends(segs, data, bounds):
    """For each of ``segs`` (their bytes and bounds in these) where the ASCII punctuation at its end begins, if that is behind a letter or
    digit of ASCII or of U+00C0 to U+027F, else its end."""
    import numpy as np
    import pyarrow.compute as pc

    end = bounds[:-1] + pc.binary_length(pc.utf8_rtrim(segs, characters=string.punctuation)).to_numpy(zero_copy_only=False)
    word = np.zeros(256, dtype=bool)
    word[list((string.ascii_letters + string.digits).encode())] = True
    last, lead = data[end - 1], data[np.maximum(end - 2, 0)]
    latin = (last >= 0x80) & (lead >= 0xC3) & (lead <= 0xC9) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))
    return np.where((end > bounds[:-1]) & (word[last] | latin), end, bounds[1:])


def _strings(bounds, data):
    import numpy as np
    import pyarrow as pa

    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(bounds, dtype=np.int64)), data)


def _with_room(a, n: int):
    import numpy as np

    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), dtype=a.dtype)])


class SegmentEncoder:
    """Counts or ids per text for a byte-level BPE ``.json`` file."""

    def __init__(self, name: str, ids: bool, cache_segments: int = CACHE_SEGMENTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file_path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ids, self.cache_segments = ids, cache_segments
        self.lengths = None
        self.forget()

    def forget(self) -> None:
        """Start anew: ``known`` numbers the parts from 1 on (0: the empty one), ``counts`` has their ids' counts, ``starts`` where in
        ``stored`` these are."""
        import numpy as np

        self.known: dict[str, int] = {}
        self.counts, self.starts = np.zeros(1024, dtype=np.int32), np.zeros(1024, dtype=np.int64)
        self.stored, self.n_stored = np.zeros(4096, dtype="<u4"), 0

    def byte_lengths(self):
        """By id, how many bytes of a text it stands for: a byte is one character of a byte-level piece."""
        import numpy as np

        if self.lengths is None:
            added = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
            size = {i: added.get(i, len(p)) for p, i in self.tokenizer.get_vocab().items()}
            self.lengths = np.zeros(max(size) + 1, dtype=np.int64)
            self.lengths[list(size)] = list(size.values())
        return self.lengths

    def learn(self, new: list[str]) -> None:
        """Learn distinct parts that are not known."""
        alone, joined = [], []
        for s in new:
            (joined if s[0] in _WHITE and s[-1] not in _WHITE else alone).append(s)
        for i in range(0, len(alone), 4096):
            self._learn_alone(alone[i:i + 4096])
        for i in range(0, len(joined), JOINED_SEGMENTS):
            part = joined[i:i + JOINED_SEGMENTS]
            if not self._learn_joined(part):
                self._learn_alone(part)

    def _learn_alone(self, part: list[str]) -> None:
        import numpy as np

        found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        self._add(part, np.fromiter(map(len, found), np.int64, len(part)), np.array([i for ids in found for i in ids], dtype="<u4"))

    def _learn_joined(self, part: list[str]) -> bool:
        """Learn parts that begin with white space and end with none from the ids of their concatenation, as one that is cut at safe
        places; each id tells how many bytes it stands for. False if the bytes do not come out even."""
        import numpy as np

        ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.cumsum(self.byte_lengths()[ids])
        cuts = np.cumsum(np.fromiter((len(s.encode()) for s in part), np.int64, len(part)))
        at = np.searchsorted(ends, cuts)
        if not len(ends) or ends[-1] != cuts[-1] or (ends[at] != cuts).any():
            return False
        self._add(part, np.diff(at + 1, prepend=0), ids)
        return True

    def _add(self, part: list[str], counts, ids) -> None:
        """``part`` gets the next numbers."""
        import numpy as np

        n = len(self.known) + 1
        self.known.update(zip(part, range(n, n + len(part))))
        self.counts = _with_room(self.counts, n + len(part))
        self.counts[n:n + len(part)] = counts
        if self.ids:
            self.starts = _with_room(self.starts, n + len(part))
            self.starts[n:n + len(part)] = self.n_stored + np.cumsum(counts) - counts
            self.stored = _with_room(self.stored, self.n_stored + len(ids))
            self.stored[self.n_stored:self.n_stored + len(ids)] = ids
            self.n_stored += len(ids)

    def _numbers(self, parts):
        """The numbers of distinct parts, learned if they are not known. All are known behind it, and none changes before the next call."""
        import numpy as np

        names = parts.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        empty = np.fromiter(map(len, names), np.int64, len(names)) == 0
        number[empty] = 0
        new = np.flatnonzero(number < 0)
        if len(self.known) + len(new) > self.cache_segments:
            self.forget()
            new = np.flatnonzero(~empty)
        self.learn([names[k] for k in new])
        number[new] = [self.known[names[k]] for k in new]
        return number

    def _looked_up(self, texts: list[str]) -> list:
        """``batch`` of some texts at once."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        raw = [t.encode() for t in texts]
        joined = b"".join(raw)
        edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])  # of the texts
        if not joined:
            return [b"" if self.ids else 0] * len(texts)
        data = np.frombuffer(joined, dtype=np.uint8)
        first = np.zeros(len(data) + 1, dtype=bool)
        first[segment_starts(data)] = True
        first[edges] = True
        bounds = np.flatnonzero(first)
        coded = _strings(bounds, pa.py_buffer(joined)).dictionary_encode()
        segs = coded.dictionary
        seg_bounds = np.frombuffer(segs.buffers()[1], dtype=np.int64)[:len(segs) + 1]
        ends = word_ends(segs, np.frombuffer(segs.buffers()[2], dtype=np.uint8), seg_bounds)
        for special in self.special:
            if special.encode() in joined:
                ends = np.where(pc.match_substring(segs, special).to_numpy(zero_copy_only=False), seg_bounds[1:], ends)
        halves = np.empty(2 * len(segs) + 1, dtype=np.int64)
        halves[::2], halves[1::2] = seg_bounds, ends
        parts = _strings(halves, segs.buffers()[2]).dictionary_encode()
        number = self._numbers(parts.dictionary)[parts.indices.to_numpy()]
        number = number.reshape(-1, 2)[coded.indices.to_numpy()].ravel()
        counts = self.counts[number]
        before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        at = before[2 * np.searchsorted(bounds, edges)]
        if not self.ids:
            return np.diff(at).tolist()
        places = np.repeat(self.starts[number] - before[:-1], counts)
        places += np.arange(len(places))
        flat, cut = self.stored[places].tobytes(), (4 * at).tolist()
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

    def batch(self, texts: list[str]) -> list:
        """For each text its id count, or its ids as little-endian unsigned 32-bit integers."""
        cut, n = [], []
        for t in texts:
            n.append(-len(cut))
            cut.extend(pieces(t))
            n[-1] += len(cut)
        found = (x for part in byte_batches(cut, LOOKUP_CHARS) for x in self._looked_up(part))
        join = b"".join if self.ids else sum
        return [next(found) if k == 1 else join(islice(found, k)) for k in n]


class PieceEncoder:
    """Counts or ids per text for a sentencepiece ``.model`` file, whole texts in batches: its
    normalizer may join white space, so texts are not cut."""

    def __init__(self, name: str, ids: bool):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=file_path(name))
        self.ids = ids

    def batch(self, texts: list[str]) -> list:
        found = self.model.encode(texts, num_threads=1)
        return [array.array("I", x).tobytes() if self.ids else len(x) for x in found]


class WholeEncoder:
    """Counts or ids per text for any other tokenizers ``.json`` file: its normalizer or splits may
    look across white space, so texts are not cut."""

    def __init__(self, name: str, ids: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file_path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ids = ids

    def batch(self, texts: list[str]) -> list:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array.array("I", e.ids).tobytes() if self.ids else len(e) for e in found]


_encoders: dict[tuple, object] = {}


def encoder(name: str, ids: bool = False, cache_segments: int = CACHE_SEGMENTS):
    """The encoder of a file, kept by the Python worker from one task to the next, with at most ``cache_segments``
    segments learned."""
    keeps("tokens", _encoders.clear)
    key = (name, ids, cache_segments)
    if key not in _encoders:
        if name.endswith(".model"):
            made = PieceEncoder(name, ids)
        else:
            made = SegmentEncoder(name, ids, cache_segments) if _cuts_safely(name) else WholeEncoder(name, ids)
        _encoders[key] = made
    return _encoders[key]


def _cuts_safely(name: str) -> bool:
    """Byte-level splits by the usual pattern, no normalizer, no prefix, and no special string that
    holds or swallows white space."""
    import json

    with open(file_path(name), encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    special = all(not (t.get("lstrip") or t.get("rstrip") or re.search(f"[{WHITE_SPACE}]", t["content"]))
                  for t in spec.get("added_tokens") or [])
    return bool(plain and special and spec.get("normalizer") is None)
