"""Encoding and decoding with a merge-type sentencepiece file, by a score-ordered agenda.

A text becomes symbols, one a character. The agenda holds every adjacent pair of symbols that together are a piece,
best score first, leftmost first among equals. The first pair is merged and its new neighbours join the agenda, until
none is left; pairs whose symbols have meanwhile been merged away are skipped. A symbol that is no piece becomes one id
for each of its UTF-8 bytes, or the unknown id where the file has no byte pieces. Short texts go through their agendas side by side: an
agenda is a row of scores then, and a step merges the best pair of every row (``PairTable``).

No merge reaches across two characters that stand side by side in no piece. Where the pieces allow it, a normalised text
is therefore cut before each run of word marks and around line ends: each distinct cut goes through the agenda once and
is looked up from then on. Files that use word marks in another way, or have pieces of users, are not cut.

The library's own results check these in each Arrow batch: the ids of every cut when it is learned, one whole text (the longest) of each list of
texts, and every decoded text. ``check="whole"`` compares the ids of every whole text instead. A difference stops the job.

Edge cases: a null or empty text has no ids but the end id, and decodes to an empty text; repeated rows give repeated
results; a null id stays null; an empty table gives an empty result. ``decode_pieces`` keeps all columns of its input and gives its
own another name where that clashes; null ids decode to an empty text. Texts are never truncated. A file that is not of the
merge type is an error.
"""

from __future__ import annotations

import array
import heapq
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toxscan.llm.common import byte_batches, keeps, python_ready, unused
from toxscan.llm.tokenizing import file_path

MARK = "▁"  # a space inside pieces
BATCH_CHARS = 1 << 20
#: Distinct cuts a worker keeps from task to task; beyond that the table starts anew (results do not change).
CACHE_CUTS = 1_500_000


class CheckFailed(ValueError):
    """The agenda and the library differ."""


class PairTable:
    """The agenda for many short texts at once. Symbols are numbers; a sorted table tells what two of them make."""

    #: Symbols of a text that goes through a row; longer ones have an agenda of their own.
    WIDTH = 40

    def __init__(self, ids: dict[str, int], score: dict[str, float]):
        import numpy as np

        symbols = {p: i for i, p in enumerate(ids)}
        for p in ids:
            for c in p:
                symbols.setdefault(c, len(symbols))
        self.ids = np.array([ids.get(p, -1) for p in symbols], dtype=np.int32)
        self.of_char = np.full(0x110000, -1, dtype=np.int32)
        for p, n in symbols.items():
            if len(p) == 1:
                self.of_char[ord(p)] = n
        self.base = len(symbols)
        made = [(symbols[p[:k]] * self.base + symbols[p[k:]], symbols[p], -score[p])
                for p in ids for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        made.sort()
        self.keys = np.array([m[0] for m in made] + [1 << 62], dtype=np.int64)
        self.joined = np.array([m[1] for m in made] + [-1], dtype=np.int32)
        self.cost = np.array([m[2] for m in made] + [np.inf], dtype=np.float64)

    def pairs(self, left, right):
        """What each two symbols make, and its negative score; -1 and infinity if they make nothing."""
        import numpy as np

        key = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.keys, key)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.joined[at], -1), np.where(hit, self.cost[at], np.inf)

    def merge(self, texts: list[str]):
        """The ids of all texts (not empty, of up to ``WIDTH`` symbols) one after the other, how many each has, and which have a symbol
        without an id."""
        import numpy as np

        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        width = int(size.max())
        chars = self.of_char[np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)]
        symbol = np.full((len(texts), width + 1), -2, dtype=np.int32)  # -2: no symbol, -1: one that no piece has
        symbol[np.arange(width + 1) < size[:, None]] = chars
        made, cost = self.pairs(symbol[:, :-1], symbol[:, 1:])
        after = np.tile(np.arange(1, width + 2), (len(texts), 1))
        before = np.tile(np.arange(-1, width), (len(texts), 1))
        rows = np.arange(len(texts))
        while True:
            i = cost[rows].argmin(axis=1)  # the leftmost of equal ones
            go = cost[rows, i] < np.inf
            rows, i = rows[go], i[go]
            if not len(rows):
                break
            j = after[rows, i]
            new, k, h = made[rows, i], after[rows, j], before[rows, i]
            symbol[rows, i], symbol[rows, j] = new, -2
            after[rows, i] = k
            inner = k <= width
            before[rows[inner], k[inner]] = i[inner]
            right = np.where(inner, symbol[rows, np.minimum(k, width)], -2)
            made[rows, i], cost[rows, i] = self.pairs(new, right)
            dead = j < width
            cost[rows[dead], j[dead]] = np.inf
            has = h >= 0
            made[rows[has], h[has]], cost[rows[has], h[has]] = self.pairs(symbol[rows[has], h[has]], new[has])
        live = symbol != -2
        ids = np.where(symbol >= 0, self.ids[np.maximum(symbol, 0)], -1)
        counts = live.sum(axis=1)
        bad = (live & (ids < 0)).any(axis=1)
        return ids[live], counts, bad


class PieceCodec:
    """Ids of texts and texts of ids for one ``.model`` file."""

    def __init__(self, name: str, cache_cuts: int = CACHE_CUTS):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as spec

        path = file_path(name)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = spec.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != spec.TrainerSpec.BPE:
            raise ValueError(f"{name} is not of the merge type")
        kind = spec.ModelProto.SentencePiece
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED, kind.UNUSED)}
        self.score = {p.piece: p.score for p in model.pieces if p.type in (kind.NORMAL, kind.USER_DEFINED, kind.UNUSED)}
        self.idle = {p.piece for p in model.pieces if p.type == kind.UNUSED}
        own = sorted((p.piece for p in model.pieces if p.type == kind.USER_DEFINED), key=len, reverse=True)
        self.own = frozenset(own)
        self.symbols = re.compile("|".join([*map(re.escape, own), "(?s:.)"])).findall if own else list
        self.bytes = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
        self.byte_ids = frozenset(self.bytes) if model.trainer_spec.byte_fallback else frozenset()
        self.unknown, self.end = self.library.unk_id(), self.library.eos_id()

        rule = model.normalizer_spec
        self.plain = not rule.precompiled_charsmap and not rule.remove_extra_whitespaces and not own \
            and rule.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        self.prefix = MARK if rule.add_dummy_prefix else ""
        self.strips = rule.add_dummy_prefix or rule.remove_extra_whitespaces
        self.strips_all = rule.remove_extra_whitespaces
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.cuts = self.plain and not inner and not any("\n" in p or "\0" in p for p in self.ids)

        self.control = [p.type == kind.CONTROL for p in model.pieces]
        self.surface = [b"" if p.type == kind.CONTROL else bytes([int(p.piece[1:-1], 16)]) if p.type == kind.BYTE
                        else model.trainer_spec.unk_surface.encode() if p.type == kind.UNKNOWN
                        else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        self.marked = [p.piece.startswith(MARK) and p.type not in (kind.CONTROL, kind.UNKNOWN, kind.BYTE) for p in model.pieces]
        self.pairs = PairTable(self.ids, self.score) if self.cuts and not self.idle else None
        self.cache_cuts = cache_cuts
        self.known: dict[str, bytes] = {"": b""}
        self.table = None

    # -- encoding

    def merged(self, text: str) -> list[str]:
        """The symbols of a normalised text once the agenda is empty."""
        symbol = self.symbols(text)
        n = len(symbol)
        if n < 2:
            return symbol
        score, own = self.score.get, self.own
        agenda = []
        for i in range(n - 1):
            a, b = symbol[i], symbol[i + 1]
            s = score(a + b)
            if s is not None and a not in own and b not in own:
                agenda.append((-s, i, i + 1, len(a) + len(b)))
        if not agenda:
            return symbol
        heapq.heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        fixed = [x in own for x in symbol] if own else None
        parts: dict[str, tuple[str, str]] = {}
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            a, b = symbol[i], symbol[j]
            if not a or not b or len(a) + len(b) != size:
                continue
            joined = a + b
            if joined in self.idle:
                parts[joined] = (a, b)
            symbol[i], symbol[j] = joined, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if fixed is None or not fixed[k]:
                    c = symbol[k]
                    s = score(joined + c)
                    if s is not None:
                        heapq.heappush(agenda, (-s, i, k, size + len(c)))
            h = before[i]
            if h >= 0 and (fixed is None or not fixed[h]):
                c = symbol[h]
                s = score(c + joined)
                if s is not None:
                    heapq.heappush(agenda, (-s, h, i, size + len(c)))
        left = [x for x in symbol if x]
        return self._split(left, parts) if parts else left

    def _split(self, symbols: list[str], parts: dict[str, tuple[str, str]]) -> list[str]:
        """Symbols that the file marks as unused, taken apart again into what they were merged from."""
        out, todo = [], symbols[::-1]
        while todo:
            s = todo.pop()
            if s in self.idle and s in parts:
                todo += parts[s][::-1]
            else:
                out.append(s)
        return out

    def cut_ids(self, text: str) -> bytes:
        """The ids of a normalised text, as 32-bit integers."""
        out: list[int] = []
        get = self.ids.get
        for s in self.merged(text):
            i = get(s)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.bytes[b] for b in s.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return array.array("i", out).tobytes()

    def cut(self, text: str) -> list[str]:
        """A text, normalised and cut where no merge can reach across."""
        if not self.plain:
            whole = self.library.normalize(text)
            return [whole] if whole else []
        if not text:
            return []
        whole = self.prefix + text.replace(" ", MARK)
        if not self.cuts:
            return [whole]
        if MARK * 2 in whole or "\0" in whole:
            return _CUTS(whole)
        return whole.replace(MARK, "\0" + MARK).replace("\n", "\0\n\0").split("\0")

    def learn(self, cuts: set[str]) -> None:
        """Take cuts into the table: short ones side by side, by length; the others, and those with a symbol that is no piece, one by one."""
        import numpy as np

        alone = cuts
        if self.pairs is not None:
            ordered = sorted((c for c in cuts if len(c) <= PairTable.WIDTH), key=len)
            alone = [c for c in cuts if len(c) > PairTable.WIDTH]
            for start in range(0, len(ordered), 1 << 14):
                some = ordered[start:start + (1 << 14)]
                ids, counts, bad = self.pairs.merge(some)
                raw, ends = ids.astype(np.int32).tobytes(), (4 * np.cumsum(counts)).tolist()
                self.known.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))))
                alone += [some[i] for i in np.flatnonzero(bad).tolist()]
        self.known.update((c, self.cut_ids(c)) for c in alone)

    def compare(self, texts: list[str], found: list[bytes]) -> None:
        """Compare ids of whole texts with the library's."""
        for t, got, want in zip(texts, found, self.library.encode(texts, num_threads=1)):
            if got != array.array("i", want).tobytes():
                raise CheckFailed(f"ids differ from the library's for a text of {len(t)} characters: {t[:80]!r}")

    def compare_cuts(self, cuts: Iterable[str]) -> None:
        """Compare what is known of cuts with the library's ids. It puts the mark before a text itself; a cut without it, or of it alone, stands
        behind a line end."""
        lead = self.library.encode("\n")
        begun = [c for c in cuts if len(c) > 1 and c[0] == MARK]
        bare = [c for c in cuts if c and (len(c) == 1 or c[0] != MARK)]
        self._compare_all(begun, self.library.encode([c[1:].replace(MARK, " ") for c in begun], num_threads=1))
        behind = self.library.encode(["\n" + c.replace(MARK, " ") for c in bare], num_threads=1)
        if any(ids[:len(lead)] != lead for ids in behind):
            raise CheckFailed("a line end does not stand for itself")
        self._compare_all(bare, [ids[len(lead):] for ids in behind])

    def _compare_all(self, cuts: list[str], want: list[list[int]]) -> None:
        known = list(map(self.known.__getitem__, cuts))
        if b"".join(known) == array.array("i", chain.from_iterable(want)).tobytes() and list(map(len, known)) == [4 * len(ids) for ids in want]:
            return
        bad = next(c for c, got, ids in zip(cuts, known, want) if got != array.array("i", ids).tobytes())
        raise CheckFailed(f"ids differ from the library's for {bad[:80]!r}")

    def encode(self, texts: Sequence[str], check: bool = False) -> list[bytes]:
        """For each text its ids, without begin and end; with ``check`` new cuts are compared with the library."""
        cut = [self.cut(t) for t in texts]
        fresh = set(chain.from_iterable(cut)).difference(self.known)
        if len(self.known) + len(fresh) > self.cache_cuts:
            self.known = {"": b""}
            fresh = set(chain.from_iterable(cut)).difference(self.known)
        self.learn(fresh)
        if check and self.cuts and self.prefix:
            self.compare_cuts(fresh)
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    # -- decoding

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: pieces side by side, marks as spaces, runs of byte pieces as UTF-8 (a byte that is no part of a
        character becomes U+FFFD), control ids as nothing, the mark before the first piece dropped."""
        out: list[str] = []
        run = bytearray()
        seen = False  # the mark at the beginning has been met
        for i in ids:
            if i in self.byte_ids:
                run += self.surface[i]
                continue
            if run:
                out.append(_readable(bytes(run)))
                run.clear()
            said = self.surface[i].decode()
            if self.strips and not seen and not any(out) and self.marked[i]:
                said = said[1:]
                seen = not self.strips_all
            out.append(said)
        out.append(_readable(bytes(run)))
        return "".join(out)

    def decode_lists(self, ids) -> list:
        """The same for an Arrow list array. The bytes of all pieces are joined by Arrow; a text that is not whole UTF-8 then,
        has control ids before its last, or whose file strips more than one mark, is decoded piece by piece."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.table is None:
            self.table = pa.array(self.surface, pa.binary())
        offsets = ids.offsets.to_numpy() - ids.offsets[0].as_py() if len(ids) else np.zeros(1, np.int32)
        flat = ids.flatten()
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.table.take(flat)), b"")
        number = flat.to_numpy(zero_copy_only=False)
        silent = np.flatnonzero(np.array(self.control)[number])
        row = np.searchsorted(offsets, silent, side="right") - 1
        slow = set(row[silent + 1 < offsets[row + 1]].tolist())
        out = []
        for row, raw in enumerate(joined.to_pylist()):
            part = number[offsets[row]:offsets[row + 1]]
            try:
                said = None if self.strips_all or row in slow else raw.decode()
            except UnicodeDecodeError:
                said = None
            if said is None:
                said = self.decode(part.tolist())
            elif self.strips and said.startswith(" "):
                first = next(i for i in part.tolist() if not self.control[i])
                said = said[1:] if self.marked[first] else said
            out.append(said)
        return out


_CUTS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall


def _readable(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(run):
        lead = run[i]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            out.append(run[i:i + size].decode())
        except UnicodeDecodeError:
            out.append("�")
            size = 1
        i += size
    return "".join(out)


_codecs: dict[str, PieceCodec] = {}


def codec(name: str) -> PieceCodec:
    """The codec of a file, kept by the Python worker from one task to the next."""
    keeps("pieces", _codecs.clear)
    if name not in _codecs:
        _codecs[name] = PieceCodec(name)
    return _codecs[name]


def encode_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str = "piece_bpe_32k.model",
                  end: bool = True, decoded: bool = False, check: bool | str = True) -> DataFrame:
    """Per row of ``df``: ``id_col`` and ``ids``, the ids of its whole text, with the end id behind them if ``end``; if ``decoded`` also
    ``decoded``, the text that these ids stand for, made in the same task."""
    python_ready(df.sparkSession)
    picked = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = T.StructType([T.StructField("_id", picked.schema["_id"].dataType),
                           T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
                           *([T.StructField("decoded", T.StringType())] if decoded else [])])

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        c = codec(model)
        tail = np.array([c.end], np.int32).tobytes() if end else b""
        for batch in batches:
            done = 0
            for texts in byte_batches(batch.column(1).to_pylist(), BATCH_CHARS):
                by_cut = check is True and c.cuts and bool(c.prefix)
                found = c.encode(texts, by_cut)
                if by_cut:
                    longest = max(range(len(texts)), key=lambda k: len(texts[k]))
                    c.compare([texts[longest]], [found[longest]])
                elif check:
                    c.compare(texts, found)
                found = [x + tail for x in found]
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
                columns = [batch.column(0).slice(done, len(found)), lists]
                if decoded:
                    columns.append(pa.array(decoded_lists(c, lists, check), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                done += len(found)

    return picked.mapInArrow(encode, schema).withColumnRenamed("_id", id_col)


def decoded_lists(c: PieceCodec, lists, check: bool) -> list[str]:
    """The texts of an Arrow list array of ids, compared with the library's if ``check``."""
    said = c.decode_lists(lists)
    if check:
        ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
        if said != c.library.decode([ids[a:b] for a, b in zip(ends[:-1], ends[1:])] or [[]], num_threads=1)[:len(said)]:
            raise CheckFailed("a decoded text differs from the library's")
    return said


def decode_pieces(df: DataFrame, ids_col: str = "ids", out: str = "decoded", *, model: str = "piece_bpe_32k.model",
                  check: bool = True) -> DataFrame:
    """``df`` and the text of its ids as ``out``."""
    python_ready(df.sparkSession)
    out = unused(df, out)
    at = df.columns.index(ids_col)
    fed = df.withColumn(ids_col, F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")))
    schema = T.StructType([*fed.schema.fields, T.StructField(out, T.StringType())])

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = codec(model)
        for batch in batches:
            rows = max(1, min(len(batch), (len(batch) << 18) // max(1, len(batch.column(at).flatten()))))
            for start in range(0, len(batch), rows):
                part = batch.slice(start, rows)
                said = pa.array(decoded_lists(c, part.column(at), check), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, said], names=schema.names)

    return fed.mapInArrow(decode, schema)
