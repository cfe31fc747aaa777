"""Ranked lexical search by pipelined term partitioning.

Documents are dealt into blocks of bounded size, as they lie in their files. A block's index holds, for each term that some item
asks for, the places of the documents that hold it and how often. Each term has one owner, chosen by its document
frequency, so the rarest terms come first. A bundle is a block's documents and a bounded group of items, each item with a
sparse accumulator: places and scores. The bundles pass through the owners' stages in turn. A stage is a cogroup of the
bundles with the postings of its owner by block and group of items; it adds the integer contributions of its terms. Behind the last
stage each bundle gives each item's best documents of the block, and a window over these gives the best of all.

A stage sends on no document that cannot become one of the best of its block: with a score so far, plus the greatest
contributions of the item's terms of later stages, below the ``top``-th score so far. Such a document may be met again by a later
stage, with too low a score, but stays below that bound. So nothing that can count is lost.

One task holds a block's documents, at most ``GROUP_ITEMS`` or so accumulators over them and the postings of one stage. The
driver gets two sums and the number of items. What is sent to tasks at the scan is a filter of fixed size over the items' terms.

Edge cases: a null or empty text has no terms: such a document is not counted, such an item finds nothing. Items of one id are
one item with the terms of all; each row of the documents is a document of its own, also where ids repeat or are
null (a null id comes behind others of the same score). Equal scores are ordered by id, then by nothing else. Without a document with
terms the result is empty. Other columns are ignored, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toxscan.llm.common import KeyFilter, keeps, python_ready, tidy, written
from toxscan.llm.words import byte_slices, cut_words, numbered

#: Characters that are in no term: ASCII but digits and letters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_DOCS = 1 << 13
BLOCK_POSTINGS = 1 << 22
GROUP_ITEMS = 128
OWNERS = 4
_SCALE = 1_000_000_000


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, term``: each term of an item once."""
    words = F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select(F.col(id_col).alias("item"), F.explode(words).alias("term")).distinct()


def _byte_table() -> bytes:
    """A-Z as a-z, other ASCII that is in no term as a space."""
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        table[b] = b if c.isalnum() else 32
        if c in UPPER:
            table[b] = ord(c.lower())
    return bytes(table)


def block_index(docs: DataFrame, asked: KeyFilter, id_col: str, text_col: str, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Rows of a block: one a term that ``asked`` may hold (``places``, ``counts``: in the document, ``most``, ``shortest``:
    greatest count, least number of terms of these documents), and one with a null term (``ids``, ``counts``: terms of each
    document, ``n_docs`` with terms, ``n_terms``)."""
    picked = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    id_type = picked.schema["_id"].dataType
    longs, ints = T.ArrayType(T.LongType(), False), T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("term", T.StringType()),
                           T.StructField("places", ints), T.StructField("counts", longs), T.StructField("most", T.LongType()),
                           T.StructField("shortest", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
                           T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType())])
    table = _byte_table()

    def index(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        keeps("search")
        task = TaskContext.get().partitionId()
        made = 0
        ids, sizes, found, term_of, docs_held, postings = [], [], [], {}, 0, 0

        def flush():
            nonlocal ids, sizes, found, term_of, docs_held, postings, made
            block = (task << 32) | made
            made += 1
            size = np.concatenate(sizes)
            doc, term, count = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort([doc, term])
            doc, term, count = doc[order], term[order], count[order]
            starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
            n = len(starts)
            names = list(term_of)
            ends = np.concatenate([starts, [len(term)], [len(term)]]).astype(np.int32)
            most = np.maximum.reduceat(count, starts).tolist() if n else []
            shortest = np.minimum.reduceat(size[doc], starts).tolist() if n else []
            every = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays([
                pa.array([block] * (n + 1), pa.int64()),
                pa.array([names[i].decode() for i in term[starts].tolist()] + [None], pa.string()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(doc.astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(np.concatenate([ends[:-1], [len(term) + len(size)]]).astype(np.int32)),
                                         pa.array(np.concatenate([count, size]).astype(np.int64))),
                pa.array([*most, None], pa.int64()), pa.array([*shortest, None], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(every)], pa.int32()), every),
                pa.array([None] * n + [int((size > 0).sum())], pa.int64()),
                pa.array([None] * n + [int(size.sum())], pa.int64())], names=schema.names)

        for batch in batches:
            for begin, rows in byte_slices(batch.column(1)):
                for start in range(begin, begin + rows, block_docs):
                    part = batch.slice(start, min(block_docs, begin + rows - start))
                    if docs_held and docs_held + len(part) > block_docs or postings > BLOCK_POSTINGS:
                        yield flush()
                        ids, sizes, found, term_of, docs_held, postings = [], [], [], {}, 0, 0
                    words, size = cut_words(part.column(1), table)
                    code, distinct = numbered(words)
                    names = [x.encode() for x in distinct.to_pylist()]
                    may = asked.may_hold(np.array([xxhash.xxh64_intdigest(x, 42) for x in names], dtype=np.uint64))
                    number = np.full(len(names), -1, np.int64)
                    for i in np.flatnonzero(may).tolist():
                        number[i] = term_of.setdefault(names[i], len(term_of))
                    term = number[code] if len(code) else np.zeros(0, np.int64)
                    hit = term >= 0
                    doc = np.repeat(np.arange(len(part)), size)[hit]
                    pair, count = np.unique(doc * (len(term_of) + 1) + term[hit], return_counts=True)
                    found.append((pair // (len(term_of) + 1) + docs_held, pair % (len(term_of) + 1), count))
                    ids.append(part.column(0))
                    sizes.append(size.astype(np.int64))
                    docs_held += len(part)
                    postings += len(pair)
        if docs_held:
            yield flush()

    return picked.mapInArrow(tidy(index), schema)


def search(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
           item_text: str = "text", top: int = 50, block_docs: int = BLOCK_DOCS, group_items: int = GROUP_ITEMS,
           owners: int = OWNERS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents with the highest score above 0 for each item."""
    spark = docs.sparkSession
    python_ready(spark)
    asked = written(item_terms(items, item_id, item_text), "search-terms")
    index = written(block_index(docs, KeyFilter(asked, F.xxhash64("term")), doc_id, doc_text, block_docs), "search-index")
    n_docs, n_terms = index.filter("term is null").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    id_type = docs.schema[doc_id].dataType
    if not n_terms:
        empty = T.StructType([T.StructField(item_id, items.schema[item_id].dataType), T.StructField("rank", T.IntegerType()),
                              T.StructField(doc_id, id_type), T.StructField("score", T.LongType())])
        return spark.createDataFrame([], empty)

    def measure(n: str) -> str:
        return f"50L + cast((cast(50 as decimal(20,0)) * {n} * {n_docs}L) div {n_terms}L as bigint)"

    bound = F.expr(f"({_SCALE}L * most) div (1000L * most + 20L * ({measure('shortest')}))")
    stats = index.filter("term is not null").groupBy("term").agg(
        F.sum(F.size("places").cast("long")).alias("df"), F.max(bound).alias("most"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    owner = F.least(F.lit(owners - 1), F.floor(owners * F.log("df") / F.log(F.lit(float(n_docs + 1))))).cast("int")
    n_items = asked.select("item").distinct().count()
    groups = max(1, -(-n_items // group_items))
    group = F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int")
    weighed = written(asked.join(stats, "term").select("item", group.alias("grp"), "term", weight.alias("w"), owner.alias("owner"), "most")
                      .filter("w > 0"), "search-weights")
    rest = [F.sum(F.when(F.col("owner") >= s, F.col("w") * F.col("most")).otherwise(0)).alias(f"r{s}") for s in range(owners + 1)]
    members = weighed.groupBy("grp", "item").agg(*rest).select(
        "grp", "item", F.array(*[f"r{s}" for s in range(owners + 1)]).alias("rest"))
    members = members.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("item", "rest"))).alias("members"))
    members = written(members, "search-items")
    number = members.select("grp", F.posexplode("members").alias("at", "m")).select("grp", "at", F.col("m.item").alias("item"))
    asking = weighed.join(number, (weighed.grp == number.grp) & weighed.item.eqNullSafe(number.item)).groupBy(
        weighed.grp, "term", "owner", "w").agg(F.sort_array(F.collect_list("at")).alias("who"))
    asking = written(asking, "search-asking")

    blocks = index.filter("term is null").select(
        "block", "ids", F.expr(f"transform(counts, n -> {measure('n')})").alias("m"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    none = F.transform("members", lambda x: F.array().cast("array<int>"))
    bundles = blocks.join(members, "grp").select(
        "block", "grp", "ids", "m", "members", none.alias("places"),
        F.transform("members", lambda x: F.array().cast("array<bigint>")).alias("scores"))
    postings = index.filter("term is not null").select("block", "term", "places", "counts").join(asking, "term")
    for s in range(owners):
        part = postings.filter(F.col("owner") == s).select(F.col("block").alias("in_block"), F.col("grp").alias("for_grp"), "w", "who",
                                                               "places", "counts")
        bundles = bundles.groupBy("block", "grp").cogroup(part.groupBy("in_block", "for_grp")).applyInArrow(
            _stage(s + 1, top), bundles.schema)
    item_type = items.schema[item_id].dataType
    best = T.StructType([T.StructField("item", item_type), T.StructField("doc", id_type), T.StructField("score", T.LongType())])
    picked = bundles.mapInArrow(_best(top), best)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return picked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        F.col("item").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")


def _stage(after: int, top: int):
    """One owner's stage: its contributions join the accumulators; ``after`` is the next stage's number."""

    def stage(left, right):
        import numpy as np
        import pyarrow as pa

        if not len(left):
            return left
        m = left.column("m").chunk(0).flatten().to_numpy()
        members = left.column("members").chunk(0).flatten().field("rest")
        rest = members.flatten().to_numpy().reshape(len(members), -1)[:, after]
        lists = [[] for _ in range(len(members))]
        rows = zip(right.column("w").to_pylist(), right.column("who").to_pylist(), right.column("places"), right.column("counts"))
        for w, who, places, counts in rows:
            at, tf = places.values.to_numpy(), counts.values.to_numpy()
            worth = w * ((_SCALE * tf) // (1000 * tf + 20 * m[at]))
            for i in who:
                lists[i].append((at, worth))
        sums = np.zeros(len(m), np.int64)
        old_places, old_scores = left.column("places").chunk(0)[0].values, left.column("scores").chunk(0)[0].values
        places, scores = [], []
        for i, more in enumerate(lists):
            at, value = old_places[i].values.to_numpy(), old_scores[i].values.to_numpy()
            if more:
                sums[:] = 0
                sums[at] = value
                for spots, worth in more:
                    sums[spots] += worth
                at = np.flatnonzero(sums).astype(np.int32)
                value = sums[at]
            if len(at) > top:
                least = np.partition(value, len(value) - top)[len(value) - top]
                stays = value + rest[i] >= least
                at, value = at[stays], value[stays]
            places.append(at)
            scores.append(value)
        ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in places])]).astype(np.int32))
        for name, held, kind in (("places", places, np.int32), ("scores", scores, np.int64)):
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(held).astype(kind)))
            field = left.schema.field(name)
            whole = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), lists).cast(field.type)
            left = left.set_column(left.schema.get_field_index(name), field, whole)
        return left

    return stage


def _best(top: int):
    """Each item's best documents of a block, by score, then id."""

    def best(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for row in range(len(batch)):
                ids = batch.column("ids")[row].values
                members = batch.column("members")[row].values.field("item")
                places, scores = batch.column("places")[row].values, batch.column("scores")[row].values
                who, docs, values = [], [], []
                for i in range(len(members)):
                    at, value = places[i].values, scores[i].values.to_numpy()
                    if len(value) > top:
                        least = np.partition(value, len(value) - top)[len(value) - top]
                        above = pa.array(np.flatnonzero(value > least))
                        level = pa.array(np.flatnonzero(value == least))
                        by_id = pc.array_sort_indices(ids.take(at.take(level)), order="ascending", null_placement="at_end")
                        chosen = pa.concat_arrays([above, level.take(by_id[:top - len(above)])])
                        at, value = at.take(chosen), value[chosen.to_numpy()]
                    who.append(np.full(len(value), i))
                    docs.append(ids.take(at))
                    values.append(value)
                if len(members):
                    yield pa.RecordBatch.from_arrays(
                        [members.take(pa.array(np.concatenate(who))), pa.concat_arrays(docs), pa.array(np.concatenate(values))],
                        names=["item", "doc", "score"])

    return best
