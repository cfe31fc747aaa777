"""Periodic runs of words, by uniting suffix classes in the order of falling LCP.

The suffixes of a document's words are sorted and neighbours get their longest common prefix (LCP). Neighbours are united
from the greatest LCP down (Kruskal on the line of sorted suffixes), a union-find over ordered sets of positions. When
two sets become one, positions ``x < y`` that are now next to each other in it have exactly the present LCP in common. If
their distance is not greater than that, the words from ``x`` repeat with that distance: a seed. It reaches to
``y + LCP`` on the right; it is a run if it cannot be extended to the left. A run of period ``q`` over two periods long is
found at ``x`` = its start, ``y = x + q``: no position between them can be in the set, for the words would then have a
period that divides ``q``. For the same reason a multiple of the smallest period is never a seed: the place in
between joined before.

Only positions whose next words come again in the document can start a pair that matters; the words that must agree are
fewer than the shortest run less its period. Hashes find these positions and the words themselves decide; all
documents of a slice are sorted together by doubling, with the document as the first letter. A document is handled
in one task; nothing crosses documents, so there is no shuffle.

Edge cases: a null or text without words has no words, no runs and an empty collapsed text; ties (several runs of one place or length)
are all returned; repeated rows give repeated results; a null id stays null; an empty table gives an empty result; other
columns of the input are ignored, so none can clash. Texts are never cut short.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toxscan.llm.common import keeps, python_ready
from toxscan.llm.words import byte_slices, cut_words, numbered

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def least_lcp(min_length: int, min_exponent: int) -> int:
    """The least LCP that the first two periods of a run can have: its length less its period, over all periods."""
    return min(max(min_length, min_exponent * q) - q for q in range(1, min_length // min_exponent + 2))


def repeated_grams(words, counts, size: int):
    """Positions whose next ``size`` words may come again in the same document (a few too many by clashes of hashes). ``words``
    has -1 behind each document."""
    import numpy as np

    with np.errstate(over="ignore"):
        h = (words.astype(np.uint64) + np.uint64(2)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        fit = np.maximum(counts - size + 1, 0)
        first = np.cumsum(counts + 1) - (counts + 1)
        doc = np.repeat(np.arange(len(counts)), fit)
        at = np.arange(fit.sum()) + np.repeat(first - (np.cumsum(fit) - fit), fit)
        key = (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(31)
        factor = np.uint64(1)
        for j in range(size):
            factor *= np.uint64(0x2545F4914F6CDD1D)
            key += h[at + j] * factor
        key ^= key >> np.uint64(30)
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    bits = np.uint64((1 << max(16, len(key).bit_length() + 2)) - 1)
    seen = np.zeros(int(bits) + 1, dtype=bool)
    seen[again & bits] = True
    hit = seen[key & bits]
    return at[hit], doc[hit]


def sorted_suffixes(words, counts, size: int):
    """Positions whose next ``size`` words come again in their document, in the order of their suffixes, and whether each
    has these words in common with the one before it."""
    import numpy as np

    at, doc = repeated_grams(words, counts, size)
    if not len(at):
        return at, np.zeros(0, bool)
    end = np.cumsum(counts + 1) - 1  # the place of -1 behind each document
    spot, one = np.unique(np.concatenate([at, at + size]), return_index=True)
    home = np.concatenate([doc, doc])[one]
    grams = [words[np.minimum(spot + j, end[home])] for j in range(size)]
    order = np.lexsort([*grams[::-1], home])
    differs = home[order][1:] != home[order][:-1]
    for g in grams:
        differs |= g[order][1:] != g[order][:-1]
    spot = spot[order]
    rank = np.full(len(words), -1, dtype=np.int64)
    rank[spot], many = _group_starts(differs, np.zeros(len(spot), np.int64))
    tied = spot[many]
    group = rank[tied]
    if not len(tied):
        return tied, np.zeros(0, bool)
    every, reach = tied, size
    while len(tied):
        held, ahead = rank[tied], rank[tied + reach]
        order = np.lexsort([ahead, held])
        tied, held, ahead = tied[order], held[order], ahead[order]
        new_held = held[1:] != held[:-1]
        base = held - _starts(new_held)
        rank[tied], many = _group_starts(new_held | (ahead[1:] != ahead[:-1]), base)
        tied, reach = tied[many], reach * 2
    order = np.argsort(rank[every], kind="stable")
    every, group = every[order], group[order]
    return every, np.concatenate([[False], group[1:] == group[:-1]])


def _starts(differs):
    """For each row the row where its group begins; ``differs`` tells from the second row on whether a group begins."""
    import numpy as np

    first = np.concatenate([[True], differs])
    return np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))


def _group_starts(differs, base):
    """``base`` and the place of the group's first row, for each row; and which rows are not alone in their group."""
    import numpy as np

    start = _starts(differs)
    first = np.concatenate([[True], differs])
    alone = first & np.concatenate([differs, [True]])
    return base + start, ~alone


def common_prefixes(words: list[int], at: list[int], before: list[int], size: int) -> list[int]:
    """The LCP of each position (ascending) with the one before it in suffix order, at least ``size``; -1 has none. A
    position's LCP is at least that of the position to its left, less one."""
    out = []
    last, h = -2, 0
    for i, j in zip(at, before):
        if j < 0:
            out.append(0)
            last = -2
            continue
        h = h - 1 if i == last + 1 and h > size else size
        while words[i + h] == words[j + h]:
            h += 1
        out.append(h)
        last = i
    return out


def united_runs(words: list[int], at: list[int], pairs: list[tuple[int, int, int]], min_length: int,
                min_exponent: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs that arise when ``pairs`` (LCP falling; two rows of ``at``) are united."""
    root = list(range(len(at)))
    held: list[list[int] | None] = [None] * len(at)
    runs = []
    for lcp, a, b in pairs:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        large, small = held[a] or [at[a]], held[b] or [at[b]]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        n, m = len(large), len(small)
        for k, x in enumerate(small):
            p = bisect_left(large, x)
            if p and (not k or small[k - 1] < large[p - 1]):
                y = large[p - 1]
                q = x - y
                if q <= lcp and q + lcp >= min_length and q + lcp >= min_exponent * q and words[y - 1] != words[x - 1]:
                    runs.append((y, q + lcp, q))
            if p < n and (k + 1 == m or small[k + 1] > large[p]):
                y = large[p]
                q = y - x
                if q <= lcp and q + lcp >= min_length and q + lcp >= min_exponent * q and words[x - 1] != words[y - 1]:
                    runs.append((x, q + lcp, q))
        if m * 8 < n:
            for x in small:
                insort(large, x)
        else:
            large = sorted(large + small)
        root[b], held[b], held[a] = a, None, large
    return runs


def find_runs(codes, counts, min_length: int = 6, min_exponent: int = 4):
    """Runs of several documents: ``codes`` numbers their words one after the other, ``counts`` tells how many each has.
    Returns the document, start, length and period of each, by document, start and period."""
    import numpy as np

    size = least_lcp(min_length, min_exponent)
    counts = np.asarray(counts, dtype=np.int64)
    words = np.full(int(counts.sum()) + len(counts), -1, dtype=np.int32)
    first = np.cumsum(counts + 1) - (counts + 1)
    words[np.arange(len(codes)) + np.repeat(np.arange(len(counts)), counts)] = codes
    suffix, shares = sorted_suffixes(words, counts, size)
    if not len(suffix):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    by_place = np.argsort(suffix, kind="stable")
    row = np.empty(len(suffix), np.int64)  # by suffix order: the row in the order of places
    row[by_place] = np.arange(len(suffix))
    before = np.where(shares, np.concatenate([[-1], suffix[:-1]]), -1)[by_place]
    at, said = suffix[by_place].tolist(), words.tolist()
    lcp = np.array(common_prefixes(said, at, before.tolist(), size))
    edge = np.flatnonzero(shares)
    edge = edge[np.argsort(-lcp[row[edge]], kind="stable")]
    pairs = zip(lcp[row[edge]].tolist(), row[edge - 1].tolist(), row[edge].tolist())
    found = np.array(united_runs(said, at, pairs, min_length, min_exponent), dtype=np.int64).reshape(-1, 3)
    doc = np.searchsorted(first, found[:, 0], side="right") - 1
    start = found[:, 0] - first[doc]
    order = np.lexsort([found[:, 2], start, doc])
    return doc[order], start[order], found[order, 1], found[order, 2]


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_length: int = 6,
                  min_exponent: int = 4) -> DataFrame:
    """Per row of ``df``: ``id_col``, ``n_words``, ``runs`` (start, length, period; by start, then period) of at least
    ``min_length`` words and ``min_exponent`` (2 or more) periods, and ``collapsed``: the words without those that a run holds behind its first
    period, joined by a space."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run repeats its period at least once")
    python_ready(df.sparkSession)
    picked = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = T.StructType([T.StructField("_id", picked.schema["_id"].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])

    def runs(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        keeps("runs")
        for batch in batches:
            for begin, rows in byte_slices(batch.column(1)):
                words, counts = cut_words(batch.column(1).slice(begin, rows))
                doc, start, length, period = find_runs(numbered(words)[0], counts, min_length, min_exponent)
                place = np.cumsum(counts) - counts
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, place[doc] + start + period, 1)
                np.add.at(edge, place[doc] + start + length, -1)
                stays = np.cumsum(edge)[:-1] == 0
                left = np.concatenate([[0], np.cumsum(stays)])
                cuts = left[np.concatenate([[0], np.cumsum(counts)])]
                kept = pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), words.filter(pa.array(stays)))
                found = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], names=RUN.names)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, rows), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), found),
                     pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string())], names=schema.names)

    return picked.mapInArrow(runs, schema).withColumnRenamed("_id", id_col)
