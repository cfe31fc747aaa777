"""SimHash near-dedup with pigeonring filtering.

Fingerprint: 64 bits; a bit is set if more than half of the text's word shingles have it in their XXH64.
Fingerprints link at ``distance`` or fewer differing bits; a group is a connected component of links.

*Pigeonring.* The bits lie in a ring of ``m = distance + 1`` segments. If two fingerprints differ in at most
``distance`` bits, then from some segment on every chain of consecutive segments stays within its share: the
first j segments differ in at most ``j * distance / m`` bits together, for all j. (Walk the ring and start
behind the place where the running excess is greatest.) So the first segment of the chain is equal and the
first two differ in at most ``2 * distance / m`` bits. Both are in the join key: a fingerprint goes to the
bucket of each segment with the value of its neighbour, and to those of the neighbour's values within that
budget. Pairs that meet must then pass the budgets of all longer chains before their whole distance is counted.

*Buckets.* Equal fingerprints are one node. Bucket rows are shuffled and sorted by key and streamed: nothing
holds more than ``BUCKET`` rows of a key. A small bucket gives its links. In a larger one a search from node to
nodes not reached yet links what is connected, so a bucket of n near copies gives n - 1 links and not n². Rows of
a key beyond ``BUCKET`` are dealt into blocks, and each pair of blocks is a group of its own: every pair is still
compared, in tasks of equal size.

Edge cases: a null or empty text, or one without words, has fingerprint zero and links like any other; fewer words
than a shingle: the whole sequence is one shingle; repeated rows are in one group; a null id takes part, and a group
whose ids are all null has a null ``component_id``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toxscan.llm.common import keeps, python_ready, tidy, written
from toxscan.llm.components import connected_components
from toxscan.llm.words import byte_slices

SEED = 42
BITS = 64
BUCKET = 4096
SMALL = 16
_HASHES = 1 << 18


# --- fingerprints --------------------------------------------------------------------------------

def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 of each shingle: lower-case A-Z, words between white space, joined by one space."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split()  # of bytes: ASCII only, as the contract says
    if len(found) <= words:
        return [xxh64_intdigest(b" ".join(found), SEED)] if found else []
    line = b" ".join(found)
    ends = list(accumulate(map(len, found), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    return [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1:])]


def fingerprints(texts: list[str], words: int):
    """Signed 64-bit fingerprints of ``texts``."""
    import numpy as np

    out = np.zeros(len(texts), dtype=np.uint64)
    held: list[int] = []
    sizes: list[tuple[int, int]] = []

    def flush() -> None:
        if sizes:
            sums = _bit_sums(np.array(held, dtype=np.uint64), np.array([n for _, n in sizes]))
            for (i, n), s in zip(sizes, sums):
                out[i] = _packed(s, n)
        held.clear()
        sizes.clear()

    for i, text in enumerate(texts):
        h = shingle_hashes(text, words)
        if len(h) > _HASHES:  # a very long text: its sums in parts
            parts = (h[a:a + _HASHES] for a in range(0, len(h), _HASHES))
            total = sum(_bit_sums(np.array(p, dtype=np.uint64), np.array([len(p)]))[0] for p in parts)
            out[i] = _packed(total, len(h))
        elif h:
            held.extend(h)
            sizes.append((i, len(h)))
        if len(held) >= _HASHES:
            flush()
    flush()
    return out.view(np.int64)


def _bit_sums(hashes, sizes):
    """How many hashes of each run have each bit (bit 0 first)."""
    import numpy as np

    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=np.int64)


def _packed(sums, n: int):
    import numpy as np

    return np.packbits(2 * sums > n, bitorder="little").view("<u8")[0]


def with_fingerprints(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint as a signed long)."""
    python_ready(df.sparkSession)
    picked = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = T.StructType([T.StructField("_id", picked.schema["_id"].dataType), T.StructField("fp", T.LongType())])

    def prints(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keeps("simhash")
        for batch in batches:
            for start, n in byte_slices(batch.column(1)):
                found = fingerprints(batch.column(1).slice(start, n).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), pa.array(found, pa.int64())], names=schema.names)

    return picked.mapInArrow(tidy(prints), schema).withColumnRenamed("_id", id_col)


# --- the ring ------------------------------------------------------------------------------------

class Ring:
    """Segments, chain budgets and bucket keys for a distance."""

    def __init__(self, distance: int):
        import numpy as np

        if not 0 <= distance < BITS:
            raise ValueError("distance must be from 0 to 63")
        self.distance, self.m = distance, distance + 1
        self.widths = [BITS // self.m + (i < BITS % self.m) for i in range(self.m)]
        self.shifts = [0, *accumulate(self.widths)][:self.m]
        masks = [((1 << w) - 1) << s for w, s in zip(self.widths, self.shifts)]
        #: Bits of the chain of j + 1 segments from segment i, and the most that may differ there.
        self.chains = np.array([[sum(masks[(i + k) % self.m] for k in range(j + 1)) for j in range(self.m)]
                                for i in range(self.m)], dtype=np.uint64)
        self.budgets = [(j + 1) * distance // self.m for j in range(self.m)]

    def keys(self, fps):
        """Bucket keys (rows: fingerprints; columns: buckets) of unsigned fingerprints."""
        import numpy as np

        columns = []
        for i in range(self.m):
            j = (i + 1) % self.m
            own = (fps >> np.uint64(self.shifts[i])) & np.uint64((1 << self.widths[i]) - 1)
            if self.m == 1:
                columns.append(own)
                continue
            near = (fps >> np.uint64(self.shifts[j])) & np.uint64((1 << self.widths[j]) - 1)
            for n in range(self.budgets[1] + 1):
                for bits in combinations(range(self.widths[j]), n):
                    flip = np.uint64(sum(1 << b for b in bits))
                    key = (own << np.uint64(self.widths[j])) | (near ^ flip)
                    columns.append((key * np.uint64(self.m) + np.uint64(i)) & np.uint64((1 << 63) - 1))
        return np.stack(columns, axis=1)

    def linked(self, differing, start):
        """Which pairs, by their differing bits, pass every chain from segment ``start`` (one for all, or one
        for each) and then the whole distance."""
        import numpy as np

        ok = np.ones(differing.shape, dtype=bool)
        for j in range(1, self.m):
            ok &= np.bitwise_count(differing & self.chains[start, j]) <= self.budgets[j]
            if not ok.any():
                return ok
        return ok & (np.bitwise_count(differing) <= self.distance)

    def links(self, fps, start: int, small: int = SMALL):
        """Links (two arrays) among different fingerprints that share a bucket from segment ``start``: all of
        them in a small bucket, else a forest with the same components."""
        import numpy as np

        if len(fps) <= small:
            a, b = np.triu_indices(len(fps), 1)
            ok = self.linked(fps[a] ^ fps[b], start)
            return fps[a[ok]], fps[b[ok]]
        left, right = [], []
        unreached, queue = fps, []
        while len(unreached):
            if not queue:
                queue.append(unreached[0])
                unreached = unreached[1:]
            while queue and len(unreached):
                at = queue.pop()
                ok = self.linked(unreached ^ at, start)
                if ok.any():
                    found = unreached[ok]
                    left.append(np.full(len(found), at))
                    right.append(found)
                    queue.extend(found)
                    unreached = unreached[~ok]
            queue.clear()
        none = np.zeros(0, dtype=np.uint64)
        return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


_EDGES = T.StructType([T.StructField("key", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _bucket_links(distance: int, limit: int | None):
    """A function for batches of ``group``, ``key``, ``fp`` sorted by group. It yields links (null key), and the
    rows of groups over ``limit`` (their key, ``a`` the fingerprint, null ``b``)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ring = Ring(distance)
        m = ring.m
        held_key, held_group, held, n_held, spilling = None, None, [], 0, False

        def edges(a, b):
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                              names=_EDGES.names)

        def spilled(key, fps):
            n = len(fps)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, key, dtype=np.int64)), pa.array(fps.view(np.int64)),
                                               pa.nulls(n, pa.int64())], names=_EDGES.names)

        def close():
            if n_held > 1 and not spilling:
                a, b = ring.links(np.unique(np.concatenate(held)), int(held_key % m))
                if len(a):
                    yield edges(a, b)

        for batch in batches:
            if not batch.num_rows:
                continue
            group, key = (batch.column(k).to_numpy() for k in (0, 1))
            fps = batch.column(2).to_numpy().view(np.uint64)
            cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(group)]])
            # the groups that begin and end within the batch and are small: all at once, by size
            sizes = ends - starts
            inner = np.ones(len(starts), dtype=bool)
            inner[-1] = False
            if held_group is not None and group[0] == held_group:
                inner[0] = False
            for n in np.unique(sizes[inner & (sizes > 1) & (sizes <= SMALL)]):
                at = starts[inner & (sizes == n)]
                rows = fps[at[:, None] + np.arange(n)[None, :]]
                a, b = np.triu_indices(n, 1)
                x, y = rows[:, a].ravel(), rows[:, b].ravel()
                first = np.repeat((key[at] % m).astype(np.int64), len(a))
                ok = ring.linked(x ^ y, first) & (x != y)
                if ok.any():
                    yield edges(x[ok], y[ok])
            for k in np.flatnonzero(~inner | (sizes > SMALL)):
                lo, hi = starts[k], ends[k]
                if group[lo] != held_group:
                    yield from close()
                    held_group, held_key, held, n_held, spilling = group[lo], key[lo], [], 0, False
                held.append(fps[lo:hi].copy())
                n_held += hi - lo
                if limit is not None and (spilling or n_held > limit):
                    spilling = True
                    yield spilled(held_key, np.concatenate(held))
                    held = []
        yield from close()

    return run


def fingerprint_links(nodes: DataFrame, distance: int, bucket: int = BUCKET) -> DataFrame:
    """Links ``a``, ``b`` among the distinct fingerprints ``fp`` of ``nodes``, enough to connect what is connected."""
    spark = nodes.sparkSession
    python_ready(spark)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("fp", T.LongType())])

    def keyed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ring = Ring(distance)
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for a in range(0, len(fps), 2000):
                part = fps[a:a + 2000]
                keys = ring.keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, keys.shape[1]))], names=schema.names)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select("fp").mapInArrow(tidy(keyed), schema)
    dealt = rows.repartition(n, "key").sortWithinPartitions("key").select(F.col("key").alias("group"), "key", "fp")
    found = written(dealt.mapInArrow(tidy(_bucket_links(distance, bucket)), _EDGES), "simhash-links")
    links = found.filter(F.col("b").isNotNull()).select("a", "b")
    large = found.filter(F.col("b").isNull()).select("key", F.col("a").alias("fp"))
    if not large.head(1):
        return links
    blocks = large.groupBy("key").agg(F.ceil(2 * F.count(F.lit(1)) / F.lit(bucket)).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    pairs = (large.join(blocks, "key").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
             .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "key", "fp"))
    dealt = pairs.repartition(n, "group").sortWithinPartitions("group", "key")
    more = dealt.mapInArrow(tidy(_bucket_links(distance, None)), _EDGES).select("a", "b")
    return links.unionByName(written(more, "simhash-large-links"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 4,
                    distance: int = 4) -> DataFrame:
    """Per row of ``df``: ``id_col``, ``fingerprint`` (16 hex digits), ``component_id`` (least id of its group)."""
    prints = written(with_fingerprints(df, id_col, text_col, words), "simhash-fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "simhash-nodes")
    groups = connected_components(fingerprint_links(nodes, distance))
    labelled = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    by_print = labelled.join(least, "label").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 4,
                        distance: int = 4) -> DataFrame:
    """The rows of ``df`` whose id is the least of their group, all columns. Rows without an id cannot be told from each
    other; they stay where their whole group has none. Rows with the same id stay or go together."""
    groups = near_duplicates(df, id_col, text_col, words=words, distance=distance)
    gone = groups.filter(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_gone")).distinct()
    return df.join(gone, df[id_col].eqNullSafe(gone["_gone"]), "left_anti")
