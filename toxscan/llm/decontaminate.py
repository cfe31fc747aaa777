"""Benchmark decontamination by template windows.

Canonical form: words between white space (characters, in scripts without spaces), punctuation around them dropped, lower case. Numbers (digits and number
words), units behind a number, and names (neighbours join) become typed placeholders; their values are the slots. A word is a name by what the
benchmark says of it: one that the benchmark only has with a capital is a name in any letter case, one that it has otherwise never is; of the
words that it does not have, those with a capital are. So a benchmark word has one form in every letter case and place of a sentence. A window is
``WINDOW`` consecutive tokens of that template; one with fewer than ``LITERALS`` literal tokens is too bare to mean something, and is told by
its values instead. The steps:

1. The benchmark's windows, with place and slots, are one small table by item.
2. Tasks read the documents. A filter of fixed size over the benchmark's window hashes tells which windows may match;
   neighbouring ones are one run, with the hashes and slots it covers. Nothing else leaves the task.
3. Every window of a run is hash-joined with the benchmark's. Each item and alignment found is checked over the whole run: equal windows count
   whose slots are consistent, that is, each value of the item stands for one value of the document, the one it stands for most often.
4. An item is found in a document if consistent windows cover at least ``coverage`` of its tokens.

Changed numbers, names and units so do not hide a question, and chance neighbours that fill a template with mixed values do not
count. Runs of equal texts are one row, so a passage that a third of the documents share is joined once for each different
text, and by a key per passage window, not by pairs of documents.

Edge cases: null or empty texts match nothing; items shorter than a window are windows of their own length; items with
fewer than ``LITERALS`` tokens cannot be told from chance and never match; a null item id is reported as null;
equal texts get equal verdicts, whatever their ids; an empty benchmark leaves every document clean; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toxscan.llm.common import KeyFilter, keeps, python_ready, tidy, written
from toxscan.llm.words import byte_slices

WINDOW = 8
LITERALS = 4
COVERAGE = 0.5
#: Bytes of the texts of documents that are analysed at once.
TEXT_BYTES = 2 << 20

# Number words (English, German, French, Spanish) and units that are told apart from other words.
NUMBER_WORDS = frozenset("""two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn
zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend
deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante mille
dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce veinte treinta cuarenta cincuenta sesenta setenta ochenta
noventa cien mil""".split())
UNITS = frozenset("""mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t oz lb lbs pound pounds ton tons
gram grams kilogram kilograms ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour
hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres mph kmh
percent pct degree degrees c f k hz khz mhz ghz w kw kwh v a n j pa kb mb gb tb usd eur dollar dollars cent cents euro
euros""".split())

LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
_PLACEHOLDERS = (0, 0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0xFF51AFD7ED558CCD)
#: Bits of the filters of words that are names.
NAME_BITS = 23
_MULTIPLIER = 0x9E3779B97F4A7C15
_EDGES = r"^[^\pL\pN]+|[^\pL\pN]+$"
_NUMBER = r"^\p{Nd}+(?:[.,:/]\p{Nd}+)*$"
_QUANTITY = r"^(?P<n>\p{Nd}+(?:[.,:/]\p{Nd}+)*)(?P<u>\pL+)$"
#: Scripts without spaces: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _hashes(words):
    import numpy as np
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words.to_pylist()), dtype=np.uint64, count=len(words))


def _flags(column):
    import pyarrow.compute as pc

    return pc.fill_null(column, False).to_numpy(zero_copy_only=False)


class Words:
    """The words of texts, and what each distinct one is: analysed once for a list of texts, a column at a time."""

    def __init__(self, texts: list[str | None]):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        spaced = ["" if t is None else t if t.isascii() else _UNSPACED.sub(r" \g<0> ", t) for t in texts]
        lists = pc.utf8_split_whitespace(pa.array(spaced, pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        row, place = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)
        distinct = coded.dictionary
        core = pc.replace_substring_regex(distinct, pattern=_EDGES, replacement="")
        low = pc.utf8_lower(core)
        real = _flags(pc.greater(pc.binary_length(core), 0))
        keep = real[place] if len(place) else np.zeros(0, bool)
        self.owner, self.place = row[keep], place[keep]
        self.hash = _hashes(low)
        n = len(distinct)
        self.second, self.number, self.quantity = np.zeros(n, np.uint64), _flags(pc.is_in(low, pa.array(sorted(NUMBER_WORDS), low.type))), np.zeros(n, bool)
        self.unit = _flags(pc.is_in(low, pa.array(sorted(UNITS), low.type)))
        digits = np.flatnonzero(_flags(pc.match_substring_regex(low, r"\p{Nd}")))
        if len(digits):
            some = low.take(pa.array(digits))
            self.number[digits] |= _flags(pc.match_substring_regex(some, _NUMBER))
            parts = pc.extract_regex(some, pattern=_QUANTITY)
            amount, unit = parts.field("n"), parts.field("u")
            is_quantity = _flags(pc.and_(parts.is_valid(), pc.is_in(unit, pa.array(sorted(UNITS), unit.type))))
            at, chosen = digits[is_quantity], pa.array(np.flatnonzero(is_quantity))
            self.quantity[at] = True
            self.hash[at], self.second[at] = _hashes(amount.take(chosen)), _hashes(unit.take(chosen))
        raised = np.flatnonzero(_flags(pc.not_equal(core, low)))
        self.capital = np.zeros(n, bool)  # a capital, then nothing but small letters
        some = core.take(pa.array(raised))
        self.capital[raised] = _flags(pc.and_(pc.utf8_is_upper(pc.utf8_slice_codeunits(some, 0, 1)), pc.utf8_is_lower(pc.utf8_slice_codeunits(some, 1))))


class Names:
    """Which words are names: those that the benchmark has only with a capital, and of others those with a capital. Two filters of
    fixed size; a clash makes a word a name, or none, in the benchmark and in documents alike."""

    def __init__(self, only_capital, otherwise):
        self.only_capital, self.otherwise = only_capital, otherwise

    @classmethod
    def of(cls, benchmark: DataFrame, text_col: str) -> Names:
        """From the words of a benchmark."""
        def words(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                w = Words(batch.column(0).to_pylist())
                used = np.unique(w.place)
                yield pa.RecordBatch.from_arrays([pa.array(w.hash[used].view(np.int64)), pa.array(w.capital[used])], names=["h", "capital"])

        said = written(benchmark.select(text_col).mapInArrow(words, "h long, capital boolean").groupBy("h").agg(
            F.bool_and("capital").alias("name")), "benchmark-words")
        return cls(*(KeyFilter(said.filter(F.col("name") == flag), F.col("h"), NAME_BITS) for flag in (True, False)))

    def among(self, words: Words):
        """For each distinct word whether it is a name."""
        return self.only_capital.may_hold(words.hash) | (words.capital & ~self.otherwise.may_hold(words.hash))


def canonical_tokens(texts: list[str | None], names: Names):
    """``owner`` (place of the text), ``shape`` (template hash), ``value``, ``kind`` of each token, in order."""
    import numpy as np

    w = Words(texts)
    kind1 = np.where(w.number | w.quantity, NUMBER, np.where(names.among(w), NAME, LITERAL)).astype(np.int8)[w.place]
    two = w.quantity[w.place]
    n = 1 + two
    owner = np.repeat(w.owner, n)
    value, kind, unit = np.repeat(w.hash[w.place], n), np.repeat(kind1, n), np.repeat(w.unit[w.place], n)
    if two.any():
        second = np.cumsum(n)[two] - 1
        value[second], kind[second] = w.second[w.place[two]], UNIT
    same = np.zeros(len(owner), dtype=bool)
    same[1:] = owner[1:] == owner[:-1]
    behind = np.zeros(len(owner), dtype=bool)
    behind[1:] = kind[:-1] == NUMBER
    kind = np.where(unit & behind & same & (kind == LITERAL), UNIT, kind).astype(np.int8)
    again = np.zeros(len(owner), dtype=bool)  # a name right behind a name joins it
    again[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & same[1:]
    if again.any():
        heads = np.flatnonzero(~again)
        value = np.add.reduceat(value, heads)
        owner, kind = owner[heads], kind[heads]
    shape = np.where(kind == LITERAL, value, np.array(_PLACEHOLDERS, dtype=np.uint64)[kind])
    return owner, shape, value, kind


def _mixed(tokens, size: int):
    import numpy as np

    n = len(tokens) - size + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        h = h * np.uint64(_MULTIPLIER) + tokens[k:k + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def window_hashes(owner, shape, kind, size: int, literals: int, value=None):
    """Hash of the window that begins at each token, and whether there is one that counts. With ``value``, windows with
    fewer than ``literals`` literal tokens count by their values, if they have as many tokens."""
    import numpy as np

    n = len(shape) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    h = _mixed(shape, size)
    counts = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    plain = counts[size:] - counts[:n] >= literals
    whole = owner[:n] == owner[size - 1:]
    if value is None or size < literals:
        return h, whole & plain
    if not plain.all():
        h = np.where(plain, h, ~_mixed(value + shape * np.uint64(_MULTIPLIER), size))
    return h, whole


_LONGS = T.ArrayType(T.LongType())


def benchmark_items(benchmark: DataFrame, id_col: str, text_col: str, names, window: int, literals: int) -> DataFrame:
    """By item: ``item`` (a number of its own), ``item_id``, ``size`` (of its windows), ``tokens``, ``hashes`` (by
    place, null where no window counts), ``slots`` (the value of a placeholder by place, null for a literal). ``names``: broadcast."""
    picked = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    schema = T.StructType([picked.schema["item_id"], T.StructField("size", T.IntegerType()), T.StructField("tokens", T.IntegerType()),
                           T.StructField("hashes", _LONGS), T.StructField("slots", _LONGS)])

    def analysed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                owner, shape, value, kind = canonical_tokens([text], names.value)
                size = min(window, len(shape))
                if size:
                    h, ok = window_hashes(owner, shape, kind, size, literals, value)
                    if ok.any():
                        slots = np.where(kind == LITERAL, None, value.view(np.int64)).tolist()
                        rows.append((item_id, size, len(shape), np.where(ok, h.view(np.int64), None).tolist(), slots))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return written(picked.mapInArrow(analysed, schema).withColumn("item", F.monotonically_increasing_id()), "benchmark-items")


def document_runs(docs: DataFrame, text_col: str, sizes: list[int], filter_, names, literals: int) -> DataFrame:
    """Runs of windows that may be the benchmark's: ``h1``, ``h2`` (of the text), ``size``, ``start``, ``hashes`` by
    place from there, ``slots`` by token from there."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(filter_)
    picked = docs.select(F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit("text"), text_col).alias("h2"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("size", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("hashes", _LONGS), T.StructField("slots", _LONGS)])

    def runs(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        keeps("decontamination")
        arrow, may_hold = to_arrow_schema(schema), shared.value.may_hold
        for batch in batches:
            h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            text, rows = pc.fill_null(batch.column(2), ""), []
            for base, n in byte_slices(text, TEXT_BYTES):
                owner, shape, value, kind = canonical_tokens(text.slice(base, n).to_pylist(), names.value)
                begin = np.searchsorted(owner, np.arange(n))
                for size in sizes:
                    h, ok = window_hashes(owner, shape, kind, size, literals, value)
                    ok &= may_hold(h)
                    at = np.flatnonzero(ok)
                    if not len(at):
                        continue
                    new = np.concatenate([[True], (np.diff(at) > size) | (owner[at[1:]] != owner[at[:-1]])])
                    starts, ends = at[new], np.concatenate([at[np.flatnonzero(new)[1:] - 1], at[-1:]])
                    for a, b in zip(starts, ends):
                        o = owner[a]
                        own = np.where(ok[a:b + 1], h[a:b + 1].view(np.int64), None).tolist()
                        slots = np.where(kind[a:b + size] == LITERAL, None, value[a:b + size].view(np.int64)).tolist()
                        rows.append((h1[base + o], h2[base + o], size, int(a - begin[o]), own, slots))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return picked.mapInArrow(tidy(runs), schema)


def aligned(hashes: list, slots: list, item_hashes: list, item_slots: list, at: int, size: int, tokens: int) -> float:
    """The share of an item's tokens that consistent equal windows cover, if its place 0 is at ``at`` of a run."""
    lo, hi = max(0, at), min(len(hashes), at + len(item_hashes))
    equal = [p for p in range(lo, hi) if hashes[p] is not None and hashes[p] == item_hashes[p - at]]
    said: dict = {}  # for each value of the item how often it stands for which value, by place
    reached = 0
    for p in equal:
        for t in range(max(p, reached), p + size):
            if item_slots[t - at] is not None:
                votes = said.setdefault(item_slots[t - at], {})
                votes[slots[t]] = votes.get(slots[t], 0) + 1
        reached = p + size
    stands = {i: max(votes, key=lambda v: votes[v]) for i, votes in said.items()}
    covered = reached = 0
    for p in equal:
        if all(item_slots[t - at] is None or stands[item_slots[t - at]] == slots[t] for t in range(p, p + size)):
            covered += p + size - max(reached, p)
            reached = p + size
    return covered / tokens


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", *, window: int = WINDOW, literals: int = LITERALS,
                       coverage: float = COVERAGE) -> DataFrame:
    """``h1``, ``h2`` (of a text), ``item_id``, ``coverage``, ``start`` (token of the run): the items found in texts."""
    spark = docs.sparkSession
    python_ready(spark)
    names = spark.sparkContext.broadcast(Names.of(benchmark, item_text_col))
    items = benchmark_items(benchmark, item_col, item_text_col, names, window, literals)
    out_schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), items.schema["item_id"],
                               T.StructField("coverage", T.DoubleType()), T.StructField("start", T.LongType())])
    sizes = [r[0] for r in items.select("size").distinct().orderBy("size").collect()]
    if not sizes:
        return spark.createDataFrame([], out_schema)
    windows = items.select("item", "size", F.posexplode("hashes").alias("place", "h")).filter(F.col("h").isNotNull())
    found = document_runs(docs, text_col, sizes, KeyFilter(windows.select("h").distinct(), F.col("h")), names, literals)
    runs = written(found.distinct().withColumn("run", F.monotonically_increasing_id()), "benchmark-runs")
    asked = runs.select("run", "size", F.posexplode("hashes").alias("at", "h")).filter(F.col("h").isNotNull())
    candidates = (asked.join(windows, ["size", "h"]).select("run", "item", (F.col("at") - F.col("place")).alias("at")).distinct()
                  .join(items, "item").join(runs.select("run", "h1", "h2", "start", F.col("hashes").alias("run_hashes"),
                                                        F.col("slots").alias("run_slots")), "run"))

    def check(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_schema)
        for batch in batches:
            share = [aligned(r["run_hashes"], r["run_slots"], r["hashes"], r["slots"], r["at"], r["size"], r["tokens"])
                     for r in batch.to_pylist()]
            by = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            yield pa.RecordBatch.from_arrays([by["h1"], by["h2"], by["item_id"], pa.array(share, pa.float64()), by["start"]], schema=arrow)

    return candidates.mapInArrow(check, out_schema).filter(F.col("coverage") >= coverage)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``contaminated``, ``n_items``, ``item_ids`` (ascending), ``coverage`` (the greatest)."""
    found = contaminated_texts(docs, benchmark, text_col, item_col, item_text_col, **options)
    by_text = written(found.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"),
                                                    F.max("coverage").alias("coverage")), "benchmark-found")
    keyed = docs.select(F.col(id_col), F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit("text"), text_col).alias("h2"))
    return keyed.join(by_text, ["h1", "h2"], "left").select(
        id_col, F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast(T.ArrayType(found.schema["item_id"].dataType))).alias("item_ids"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found, all columns."""
    gone = written(contaminated_texts(docs, benchmark, text_col, **options).select("h1", "h2").distinct(), "benchmark-found")
    own = (F.xxhash64(docs[text_col]) == gone["h1"]) & (F.xxhash64(F.lit("text"), docs[text_col]) == gone["h2"])
    return docs.join(gone, own, "left_anti")
