"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model's units are characters (lower case, white space runs as one space), so its tables grow with the
languages and not with the vocabulary; with words, the rows of a join between documents and counts would
exceed the text. The steps:

1. *Counts.* n-grams of all trusted documents but a held-out tenth, counted in tasks and summed by n-gram. Lower
   orders count the distinct n-grams that continue them to the left.
2. *Model.* By order, joins on context and on suffix give each seen n-gram its interpolated probability and each
   context its back-off weight. Discounts come from the counts of counts. Tables are sharded by n-gram.
3. *Scores.* Each task names the distinct n-grams of its chunks of documents (about ``CHUNK`` characters each). They
   meet the model in joins on n-gram, order by order, and come back to their chunk, where documents are scored:
   mean negative log-probability a character, the log-perplexity. Texts move once, compressed.
4. *Thresholds.* Scores of trusted documents give, by language, the median and quantiles of the deviation from it,
   scaled by the square root of the length (a mean over more characters varies less). A document is rejected if it
   lies beyond the upper or lower quantile: text that the model finds improbable, and text that is too predictable. So
   ``1 - quantile`` of the clean documents on each side is the bound on clean loss, 2 % in all. A word said over and over
   is only rejected if its own letters are improbable or too predictable on the mean. The upper one is of the held-out documents; the lower one of all trusted ones, as
   a text that the counts hold (a copy, too) scores lower than others.

Each language has its own median and limits at any number of documents. The median is that of the held-out documents, as if
``MEDIAN_ROWS`` more had the median of all its trusted ones; a limit is its own quantile, as if ``SPREAD_ROWS`` more had
that of all languages together, each around its own median. Where rows are too few for the quantile, it goes on beyond
them as an exponential tail. A document of a language without any trusted text is kept and not ``judged``; one with a null
language is rejected if the limits of every language reject it. Nothing is sampled or capped; the driver gets counts of
counts, the size of the alphabet and the limits of all languages together.

Edge cases: a null, empty or white text has no characters, is not scored (null) and is kept: no ground to reject it.
Without any held-out trusted document all is kept and not judged. Repeated rows are scored each. Ids join null-safe to nothing: a
null id is never trusted. Extra columns are ignored. A document longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toxscan.llm.common import anchored, give_back, keeps, python_ready, tidy, written
from toxscan.operators.joins import fits_broadcast, likely_in

ORDER = 4
MEDIAN_ROWS = 2
SPREAD_ROWS = 20
CHUNK = 1 << 23
PIECE = 1 << 20
START, END = "\x02", "\x03"
_CONTROL = re.compile("[\x00-\x1f\x7f]+")
#: Odd 64-bit multipliers of the hash that finds equal n-grams within a task.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
               0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def plain(text: str | None) -> str:
    return " ".join(_CONTROL.sub(" ", (text or "").lower()).split())


def windows(texts: list[str], order: int):
    """Padded characters of all texts joined, the places where a predicted character stands, and the hash of the
    n-gram that ends at each."""
    import numpy as np

    pad = START * (order - 1)
    joined = "".join(pad + t + END for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    at = np.flatnonzero(codes != ord(START))
    h = codes[order - 1:] * np.uint64(MULTIPLIERS[0])
    for k in range(1, order):
        h += codes[order - 1 - k:len(codes) - k] * np.uint64(MULTIPLIERS[k])
    return joined, at, h[at - (order - 1)]


def gram_hashes(grams: list[str], order: int):
    import numpy as np

    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    codes = codes.reshape(-1, order)
    h = np.zeros(len(codes), dtype=np.uint64)
    for k in range(order):
        h += codes[:, order - 1 - k] * np.uint64(MULTIPLIERS[k])
    return h


def distinct(texts: list[str], order: int):
    """The distinct n-grams of ``texts`` and how often each comes. Works through about ``PIECE`` characters at a time, so
    its arrays stay small however long the list."""
    import numpy as np
    import pandas as pd

    keeps("quality")
    hashes, counts, grams = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], []
    for part in by_size(((t,) for t in texts if t), PIECE):
        joined, at, h = windows([t for (t,) in part], order)
        which, own = pd.factorize(h)
        first = np.empty(len(own), dtype=np.int64)
        first[which[::-1]] = at[::-1]
        hashes.append(own)
        counts.append(np.bincount(which))
        grams += [joined[i - order + 1:i + 1] for i in first]
    which, own = pd.factorize(np.concatenate(hashes))
    n = np.bincount(which, weights=np.concatenate(counts), minlength=len(own)).astype(np.int64)
    first = np.empty(len(own), dtype=np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    return [grams[i] for i in first], n


def by_size(rows: Iterator, limit: int = CHUNK) -> Iterator[list]:
    """Rows (text last) in lists of about ``limit`` characters."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-1] or "")
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


# --- model ---------------------------------------------------------------------------------------

def ngram_counts(docs: DataFrame, text_col: str, order: int) -> DataFrame:
    """``gram``, ``c``: counts of n-grams over all of ``docs``."""
    schema = T.StructType([T.StructField("gram", T.StringType()), T.StructField("c", T.LongType())])

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in by_size(((t.as_py(),) for t in batch.column(0))):
                grams, n = distinct([plain(t) for (t,) in part], order)
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(n, pa.int64())], names=schema.names)

    return docs.select(text_col).mapInArrow(tidy(count), schema).groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts for counts 1, 2 and 3 or more, from the numbers of n-grams counted 1, 2, 3 and 4 times. Where a
    number is missing, or gives none from 0 to the count, the discount is half, one, one and a half."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [k - (k + 1) * y * above / own if own and above else -1.0 for k, own, above in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(x if 0 < x < k else k / 2 for x, k in zip(d, (1, 2, 3)))


@dataclass
class KneserNey:
    """``grams[k]``: ``gram``, ``p`` of order k; ``contexts[k]``: ``context``, ``gamma`` (k from 2). ``rest``: the
    probability of a character that no trusted text has."""

    order: int
    grams: dict[int, DataFrame]
    contexts: dict[int, DataFrame]
    rest: float


def fit(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> KneserNey:
    """The model of all texts of ``docs``."""
    python_ready(docs.sparkSession)
    counts = {order: written(ngram_counts(docs, text_col, order), "quality-counts")}
    for k in range(order - 1, 0, -1):
        counts[k] = written(counts[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(
            F.count(F.lit(1)).alias("c")), "quality-counts")
    grams, contexts, rest = {}, {}, 1.0
    for k in range(1, order + 1):
        c = counts[k]
        seen = c.agg(*[F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)], F.count(F.lit(1))).first()
        d = discounts(list(seen[:4]))
        less = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        c = c.withColumn("less", less)
        totals = (F.sum("c").cast("double").alias("total"), (F.sum("less") / F.sum("c")).alias("gamma"))
        if k == 1:
            total, gamma = c.agg(*totals).first()
            rest = (gamma if total else 1.0) / (seen[4] + 1)
            grams[1] = written(c.select("gram", ((F.col("c") - F.col("less")) / F.lit(total or 1.0) + F.lit(rest)).alias("p")),
                               "quality-grams")
            continue
        c = c.withColumn("context", F.substring("gram", 1, k - 1)).withColumn("tail", F.substring("gram", 2, k - 1))
        contexts[k] = written(c.groupBy("context").agg(*totals), "quality-contexts")
        lower = grams[k - 1].withColumnsRenamed({"gram": "tail", "p": "below"})
        grams[k] = written(c.join(contexts[k], "context").join(lower, "tail").select(
            "gram", ((F.col("c") - F.col("less")) / F.col("total") + F.col("gamma") * F.col("below")).alias("p")), "quality-grams")
    return KneserNey(order, grams, contexts, rest)


def log_probabilities(asked: DataFrame, model: KneserNey) -> DataFrame:
    """``gram``, ``logp`` for the distinct n-grams ``gram`` of ``asked``, backing off from order to order."""
    found = asked
    n = model.order
    for k in range(n, 0, -1):
        found = found.withColumn("tail", F.substring("gram", n - k + 1, k)).join(
            model.grams[k].withColumnsRenamed({"gram": "tail", "p": f"p{k}"}), "tail", "left").drop("tail")
        if k > 1:
            found = found.withColumn("context", F.substring("gram", n - k + 1, k - 1)).join(
                model.contexts[k].select("context", F.col("gamma").alias(f"g{k}")), "context", "left").drop("context")
    back: Column = F.lit(0.0)
    options = []
    for k in range(n, 0, -1):
        options.append(F.log(f"p{k}") + back)
        if k > 1:
            back = back + F.coalesce(F.log(f"g{k}"), F.lit(0.0))
    options.append(F.lit(math.log(model.rest)) + back)
    return found.select("gram", F.coalesce(*options).alias("logp"))


# --- scores --------------------------------------------------------------------------------------

def scores(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row of ``docs``: ``id``, ``lang``, ``text_key`` (two hashes of the text), ``n`` (characters predicted), ``loss``
    (log-perplexity, null without characters)."""
    order = model.order
    docs = anchored(docs, id_col, text_col, lang_col)  # two passes name the chunks of documents alike
    key = F.struct(F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit("text"), text_col).alias("h2"))
    picked = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), key.h1.alias("h1"), key.h2.alias("h2"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    asked_schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("gram", T.StringType())])
    chunk_schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("rows", T.BinaryType())])

    def chunks(batches: Iterator) -> Iterator[tuple[int, list]]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for part in by_size(tuple(v.as_py() for v in row) for row in zip(*batch.columns)):
                yield number, part
                number += 1

    def ask(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for number, part in chunks(batches):
            grams, _ = distinct([plain(r[4]) for r in part], order)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), number)), pa.array(grams, pa.string())],
                                             names=asked_schema.names)

    def carry(batches: Iterator) -> Iterator:
        import pickle

        import pyarrow as pa
        import zstandard

        keeps("quality")
        for number, part in chunks(batches):
            rows = zstandard.compress(pickle.dumps([(*r[:4], plain(r[4])) for r in part]), 3)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([rows], pa.binary())], names=chunk_schema.names)

    out_schema = T.StructType([*picked.schema.fields[:4], T.StructField("n", T.LongType()), T.StructField("loss", T.DoubleType())])

    def score(left, right):
        try:
            return answered(left, right)
        finally:
            give_back()

    def answered(left, right):
        import pickle

        import numpy as np
        import pandas as pd
        import pyarrow as pa
        import zstandard
        from pyspark.sql.pandas.types import to_arrow_schema

        known = pd.Index(gram_hashes(right["gram"].to_pylist(), order)) if right.num_rows else pd.Index([], dtype="uint64")
        logp = right["logp"].to_numpy() if right.num_rows else np.zeros(0)
        rows, n, loss = [], [], []
        for packed in left["rows"]:
            part = pickle.loads(zstandard.decompress(packed.as_py()))
            for some in by_size(part, PIECE):
                rows += some
                texts = [r[4] for r in some]
                sizes = np.array([len(t) + 1 if t else 0 for t in texts])
                n.append(sizes)
                sums = np.full(len(texts), np.nan)
                if sizes.any():
                    _, _, h = windows([t for t in texts if t], order)
                    at = known.get_indexer(h)
                    if (at < 0).any():
                        raise RuntimeError("an n-gram of a chunk has no answer: the chunks of two passes differ")
                    full = sizes > 0
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    sums[full] = -np.add.reduceat(logp[at], starts) / sizes[full]
                loss.append(sums)
        n, loss = np.concatenate(n), np.concatenate(loss)
        schema = to_arrow_schema(out_schema)
        columns = [pa.array([r[k] for r in rows], schema.field(k).type) for k in range(4)]
        return pa.Table.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(loss, pa.float64(), mask=np.isnan(loss))],
                                    schema=schema)

    asked = written(picked.mapInArrow(tidy(ask), asked_schema), "quality-asked")
    answers = asked.join(written(log_probabilities(asked.select("gram").distinct(), model), "quality-answers"), "gram")
    return (picked.mapInArrow(tidy(carry), chunk_schema).groupBy("chunk")
            .cogroup(answers.select("chunk", "gram", "logp").groupBy("chunk")).applyInArrow(score, out_schema))


# --- verdict -------------------------------------------------------------------------------------

def held_out(id_col: str = "doc_id") -> Column:
    """A tenth of the trusted documents, which sets the thresholds and is not in the counts."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0


def trusted_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is among ``ids``, a written table. Ids within the broadcast bound are sent to the texts, which do not
    move then; beyond, bitmaps of fixed size drop most other texts where they lie, before the join moves the rest."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = ids.withColumnRenamed(id_col, "id")
    if fits_broadcast(ids):
        return picked.join(F.broadcast(ids), "id", "left_semi")
    return likely_in(picked, ids, "id").join(ids, "id", "left_semi")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``doc_id`` of documents labelled good and not toxic."""
    return labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id")


def without_rejected(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns. The verdict depends on text and language alone, so rejected
    rows are found by those."""
    gone = classify(docs, trusted, id_col, text_col, lang_col, **options).filter(~F.col("kept")).select(
        "h1", "h2", F.col("lang").alias("language")).distinct()
    own = (F.xxhash64(docs[text_col]) == gone["h1"]) & (F.xxhash64(F.lit("text"), docs[text_col]) == gone["h2"])
    return docs.join(gone, own & docs[lang_col].eqNullSafe(gone["language"]), "left_anti")


def beyond(quantile: float, at: Column, tail: Column, rows: Column) -> Column:
    """The quantile ``at`` of ``rows`` deviations; where they are too few for it, further out by an exponential tail whose
    mean is ``tail``."""
    return at + F.coalesce(tail, F.lit(0.0)) * F.greatest(F.lit(0.0), -F.log((1 - quantile) * (rows + 1)))


def language_limits(sample: DataFrame, quantile: float) -> DataFrame:
    """``lang``, ``median``, ``low``, ``high`` from the scores of trusted documents (``lang``, ``n``, ``loss``, ``held``)."""
    spark = sample.sparkSession
    medians = sample.groupBy("lang").agg(F.percentile_approx("loss", 0.5, 10000).alias("every"), F.count_if("held").alias("rows"),
                                         F.percentile_approx(F.when(F.col("held"), F.col("loss")), 0.5, 10000).alias("own"))
    medians = written(medians.select("lang", ((F.coalesce("own", F.lit(0.0)) * F.col("rows") + F.col("every") * MEDIAN_ROWS)
                                              / (F.col("rows") + MEDIAN_ROWS)).alias("median")), "quality-medians")
    by_lang = sample.alias("s").join(medians.alias("m"), F.col("s.lang").eqNullSafe(F.col("m.lang"))).select(
        "s.lang", "held", "median", ((F.col("loss") - F.col("median")) * F.sqrt("n")).alias("z"))
    z, held = F.col("z"), F.col("held")
    spread = [F.first("median").alias("median"), F.count(F.lit(1)).alias("rows"), F.count_if(held).alias("held"),
              F.percentile_approx(z, 1 - quantile, 10000).alias("low"), F.avg(F.when(z < 0, z)).alias("low_tail"),
              F.percentile_approx(F.when(held, z), quantile, 10000).alias("high"),
              F.avg(F.when(held & (z > 0), z)).alias("high_tail")]
    low = beyond(quantile, F.col("low"), F.col("low_tail"), F.col("rows"))
    high = beyond(quantile, F.col("high"), F.col("high_tail"), F.col("held"))
    pooled = by_lang.agg(*spread).select(low.alias("low"), high.alias("high")).first()
    if pooled.high is None:  # no document held out
        return spark.createDataFrame([], medians.schema.add("low", "double").add("high", "double"))

    def shrunk(own: Column, rows: Column, every: float) -> Column:
        return (F.coalesce(own, F.lit(0.0)) * rows + every * SPREAD_ROWS) / (rows + SPREAD_ROWS)

    return by_lang.groupBy("lang").agg(*spread).select(
        "lang", "median", shrunk(low, F.col("rows"), pooled.low).alias("low"), shrunk(high, F.col("held"), pooled.high).alias("high"))


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
             order: int = ORDER, quantile: float = 0.99) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``lang``, ``n_chars``, ``log_perplexity``, ``z``, ``low``, ``high``, ``kept``, ``judged``,
    ``h1``, ``h2``. ``trusted``: the ids of trusted documents, in a column named ``id_col``. ``judged`` is false where
    there was nothing to judge by: no characters, or no trusted text of the language."""
    python_ready(docs.sparkSession)
    ids = written(trusted.select(id_col).filter(F.col(id_col).isNotNull()).distinct(), "quality-ids")
    model = fit(trusted_texts(docs, ids.filter(~held_out(id_col)), id_col, text_col), "text", order)
    scored = written(scores(docs, model, id_col, text_col, lang_col), "quality-scores")
    sample = written(scored.filter(F.col("loss").isNotNull()).join(ids.withColumnRenamed(id_col, "id"), "id", "left_semi").select(
        "lang", "n", "loss", held_out("id").alias("held")), "quality-trusted")
    limits = written(language_limits(sample, quantile), "quality-limits")
    own = F.struct("median", "low", "high")
    unknown = limits.agg(F.collect_list(own).alias("limits")).select(F.lit(None).cast(limits.schema["lang"].dataType).alias("lang"), "limits")
    options = written(limits.filter(F.col("lang").isNotNull()).select("lang", F.array(own).alias("limits")).unionByName(unknown),
                      "quality-options").withColumnRenamed("lang", "of")

    def against(o: Column) -> Column:
        z = (F.col("loss") - o["median"]) * F.sqrt("n")
        return F.struct(F.greatest(z - o["high"], o["low"] - z).alias("over"), z.alias("z"), o["low"].alias("low"), o["high"].alias("high"))

    judged = scored.join(options, F.col("lang").eqNullSafe(F.col("of")), "left").withColumn(
        "nearest", F.array_min(F.transform("limits", against)))
    over = F.col("nearest.over")
    return judged.select(F.col("id").alias(id_col), "lang", F.col("n").alias("n_chars"), F.col("loss").alias("log_perplexity"),
                         "nearest.z", "nearest.low", "nearest.high", F.coalesce(over <= 0, F.lit(True)).alias("kept"),
                         over.isNotNull().alias("judged"), "h1", "h2")
