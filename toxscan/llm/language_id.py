"""Language ID by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over hashed character n-grams (1 to
3, letters in lower case, everything else one space) tells the languages whose bit is set from the others:
naive Bayes log-odds per n-gram bucket, averaged over the text. Decoding sums, over the bits, a logistic loss of
the margin against each codeword, weighted by how far apart the bit's two sides lie (symmetric divergence);
the codeword with the least loss is chosen. A text whose two best codewords are near is flagged.

Up to seven languages get the exhaustive code (every split of the languages once). More get a seeded random
code with ten bits for each doubling, the best of 64 draws by the least distance between codewords.

Training counts n-grams over all training rows: tasks count, Spark sums. The model has ``2**bucket_bits`` rows and
as many columns as bits, whatever the input, so it is small enough to broadcast.

Edge cases: a null text, or one without letters, is ``und`` with score 0; ties between languages go to the
first in order; rows with a null language train nothing; with no training rows all is ``und``; with one language
every text with letters is that language, score 1; repeated rows count each; other columns are ignored. Whole
texts are read, long ones in parts that overlap, so no n-gram is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toxscan.llm.common import python_ready, written

BUCKET_BITS = 16
ORDERS = 3
PART = 1 << 20
AMBIGUOUS = 0.1
#: Odd multipliers of the rolling hash, by the distance of a character from the end of its n-gram.
MULTIPLIERS = (2654435761, 2246822519, 3266489917)
_SPACE = 32


def letters():
    """For each code point: its lower-case letter, or the space if it is none."""
    import numpy as np

    table = np.full(0x110000, _SPACE, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


_letters = None


def buckets(texts: list[str | None], bucket_bits: int):
    """``ids`` (bucket of each n-gram, ORDERS columns), ``starts`` (where each text begins in them) and
    ``n`` (n-gram positions by text, 0 without letters)."""
    import numpy as np

    global _letters
    if _letters is None:
        _letters = letters()
    lengths = np.array([len(t) if t else 0 for t in texts], dtype=np.int64)
    joined = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _letters[joined]
    owner = np.repeat(np.arange(len(texts)), lengths + 1)[:len(codes)]  # a text's last place is the break behind it
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE) | (owner[1:] != owner[:-1])
    codes, owner = codes[keep], owner[keep]
    has = np.bincount(owner, weights=codes != _SPACE, minlength=len(texts)) > 0
    drop = ~has[owner]
    codes, owner = codes[~drop], owner[~drop]
    n = np.bincount(owner, minlength=len(texts))
    shift = np.uint32(32 - bucket_bits)
    ids = np.empty((len(codes), ORDERS), dtype=np.int32)
    h = np.zeros(len(codes), dtype=np.uint32)
    first = np.zeros(len(codes), dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.zeros(0, dtype=np.int64)
    first = starts[owner] if len(owner) else first
    at = np.arange(len(codes))
    for k in range(ORDERS):
        back = np.where(at - k >= first, at - k, -1)
        prior = np.where(back >= 0, codes[back], np.uint32(_SPACE)) if len(codes) else codes
        h = h + prior * np.uint32(MULTIPLIERS[k])  # modulo 2**32
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
        ids[:, k] = mixed >> shift
    return ids, starts, n


def parts(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Lists of consecutive texts of about ``PART`` characters, with the place of the first. A longer
    text comes in overlapping parts, each a list of its own with the same place."""
    batch, first, held = [], 0, 0
    for i, t in enumerate(texts):
        if t is not None and len(t) > PART:
            if batch:
                yield first, batch
            for a in range(0, len(t), PART):
                yield i, [t[max(0, a - ORDERS + 1):a + PART]]
            batch, first, held = [], i + 1, 0
            continue
        batch.append(t)
        held += len(t or "")
        if held >= PART:
            yield first, batch
            batch, first, held = [], i + 1, 0
    if batch:
        yield first, batch


def code_matrix(n_languages: int, seed: int = 7):
    """Codewords (rows) of +1 and -1."""
    import numpy as np

    if n_languages <= 1:
        return np.ones((n_languages, 1))
    if n_languages <= 7:
        splits = np.arange(1, 1 << (n_languages - 1))
        return np.array([[1.0 if s >> k & 1 else -1.0 for s in splits] for k in range(n_languages)])
    draw, best, far = np.random.default_rng(seed), None, -1
    bits = 10 * int(np.ceil(np.log2(n_languages)))
    for _ in range(64):
        code = draw.choice([-1.0, 1.0], size=(n_languages, bits))
        near = (bits - (code @ code.T - 2 * bits * np.eye(n_languages))).min() / 2
        if near > far and (np.abs(code.sum(axis=0)) < n_languages).all():
            best, far = code, near
    if best is None:
        raise ValueError("no code found")
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: object  # languages x bits
    weights: object  # buckets x bits, float32
    losses: object  # bits
    bucket_bits: int

    def margins(self, texts: list[str | None]):
        """Mean log-odds by text and bit, and the number of n-gram positions by text."""
        import numpy as np

        total = np.zeros((len(texts), self.weights.shape[1]))
        seen = np.zeros(len(texts))
        for first, part in parts(texts):
            ids, starts, n = buckets(part, self.bucket_bits)
            if len(ids):
                rows = self.weights[ids[:, 0]]
                for k in range(1, ORDERS):
                    rows += self.weights[ids[:, k]]
                full = n > 0
                at = np.arange(first, first + len(part))[full]
                total[at] += np.add.reduceat(rows, starts[full], axis=0, dtype=np.float64)
                seen[first:first + len(part)] += n
        return total / np.maximum(seen, 1)[:, None], seen

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        import numpy as np

        if not self.languages:
            return [("und", 0.0, True)] * len(texts)
        margin, seen = self.margins(texts)
        z = -margin[:, None, :] * self.code[None, :, :] * 4.0
        loss = (np.logaddexp(0.0, z) * self.losses).sum(axis=2)
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        least = loss[np.arange(len(texts)), best]
        if len(self.languages) > 1:
            second = loss[np.arange(len(texts)), order[:, 1]]
            score = (second - least) / np.maximum(second + least, 1e-12)
        else:
            score = np.ones(len(texts))
        score = np.clip(score, 0.0, 1.0)
        return [(self.languages[b], float(s), bool(s < AMBIGUOUS)) if n else ("und", 0.0, True)
                for b, s, n in zip(best, score, seen)]


def ngram_counts(df: DataFrame, text_col: str, lang_col: str, bucket_bits: int) -> DataFrame:
    """``lang``, ``bucket``, ``n``: n-gram counts over all rows whose language is not null."""
    picked = df.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bucket", T.IntegerType()),
                           T.StructField("n", T.LongType())])

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: dict[str, object] = {}
        size = 1 << bucket_bits
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, part in parts(texts):
                ids, starts, n = buckets(part, bucket_bits)
                own = langs[first:first + len(part)]
                for lang in set(own):
                    rows = np.repeat(np.array([x == lang for x in own]), n)
                    if rows.any():
                        found = np.bincount(ids[rows].ravel(), minlength=size)
                        held[lang] = held[lang] + found if lang in held else found
        for lang, found in held.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at], pa.int64())],
                names=schema.names)

    return picked.mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", bucket_bits: int = BUCKET_BITS) -> LanguageModel:
    """A model of the languages of ``df``. The counts meet the codewords in Spark; the driver gets the names and sizes of the languages and, by bucket,
    two sums for each bit."""
    import numpy as np

    spark = df.sparkSession
    python_ready(spark)
    size = 1 << bucket_bits
    table = written(ngram_counts(df, text_col, lang_col, bucket_bits), "language-counts")
    total = {r.lang: r.n for r in table.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(total)
    code = code_matrix(len(languages))
    if not languages:
        return LanguageModel([], code, np.zeros((size, 1), dtype=np.float32), np.ones(1), bucket_bits)
    all_of = np.array([total[x] + 0.5 * size for x in languages])  # each language counts alike
    words = spark.createDataFrame([(x, float(t), c.tolist()) for x, t, c in zip(languages, all_of, code)],
                                  "lang string, total double, code array<double>")
    share = F.col("n") / F.col("total")
    sums = [F.sum(F.when(sign * F.col("code")[k] > 0, share).otherwise(0.0)) for k in range(code.shape[1]) for sign in (1, -1)]
    found = table.join(words, "lang").groupBy("bucket").agg(F.array(*sums).alias("sums")).collect()
    held = np.zeros((size, 2 * code.shape[1]))
    held[[r.bucket for r in found]] = [r.sums for r in found]
    weights, losses = [], []
    for k, bit in enumerate(code.T):
        if (bit > 0).all() or (bit < 0).all():
            weights.append(np.zeros(size))
            losses.append(1.0)
            continue
        yes, no = ((held[:, 2 * k + side] + (0.5 / all_of[own]).sum()) / own.sum() for side, own in ((0, bit > 0), (1, bit < 0)))
        odds = np.log(yes) - np.log(no)
        weights.append(odds)
        losses.append(float(((yes - no) * odds).sum()))
    losses = np.array(losses) / np.mean(losses)
    return LanguageModel(languages, code, np.ascontiguousarray(np.array(weights).T, dtype=np.float32), losses, bucket_bits)


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``lang_pred``, ``score`` (0 to 1: how far the best codeword is from the second),
    ``ambiguous``."""
    spark = df.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast(model)
    picked = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = T.StructType([T.StructField("_id", picked.schema["_id"].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = shared.value.predict(batch.column(1).to_pylist())
            langs, scores, flags = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())],
                names=schema.names)

    return picked.mapInArrow(decode, schema).withColumnRenamed("_id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never train: crc32 of the id as text leaves 2 when divided by 4. A null id trains nothing."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))
