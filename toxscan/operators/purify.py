"""M3, M4: token attribution and purification (mask until the document is no longer toxic).

The reference scores a sentence, and while it is toxic masks the not-yet-masked token with the
highest attribution and scores again. For an additive scorer the loop has a closed form over the
tokens of one document ordered by (weight desc, position asc):

    S      = bias + sum of all weights                 (first-pass score)
    pre_r  = sum of the weights ranked before r
    masked = min over ranks 1..r of (S - pre) > 0

Masking a token replaces its weight by the mask weight 0. The running minimum matters: once a
negative weight is passed, ``S - pre`` can rise above 0 again, but the loop had already stopped.
Grouping is by a key of the row, so documents that share an id stay apart; a group is the tokens of one document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toxscan.functions.text import MASK_CHAR, clean_text, mask_token, piece_token, token_pieces
from toxscan.operators.blocks import array_lookup
from toxscan.operators.joins import element_lookup, fits_broadcast
from toxscan.operators.scorer import AdditiveScorer, micro_weights, probabilities
from toxscan.operators.tokens import with_row_key


def prepare(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (),
            partitioned: bool = False) -> DataFrame:
    """Clean once and cut the cleaned text into token pieces: ``(_row, id, *keep, pieces)``.

    The one shuffle carries the raw text (smaller than cleaned text plus tokens), by a key of the row, and
    lets the regular expressions run on all partitions; what is exploded from a row is grouped again without
    an exchange. Rows that share an id stay apart. ``partitioned=True`` skips the shuffle for an input
    already hash-partitioned by the id (a table written by ``session.bucket_by_doc``)."""
    raw = with_row_key(df.select(id_col, *keep, text_col), partitioned)
    return raw.select("_row", id_col, *keep, token_pieces(clean_text(text_col)).alias("pieces"))


def piece_weights(base: DataFrame, scorer: AdditiveScorer, id_col: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """``(_row, id, *keep, pos, piece, token, w)``, ``w`` in millionths; an empty document keeps one row with
    null piece."""
    def explode(rows: DataFrame) -> DataFrame:
        ex = rows.select("_row", id_col, *keep, F.posexplode_outer("pieces").alias("pos", "piece"))
        return ex.withColumn("token", piece_token("piece"))

    weights = micro_weights(scorer)
    if not fits_broadcast(weights.select("token", "w")):
        out = _items_by_block(base, weights).select("_row", id_col, *keep, F.explode_outer("items").alias("_x"))
        out = out.select("_row", id_col, *keep, "_x.pos", "_x.piece", "_x.token", "_x.w")
        return out.withColumn("w", F.coalesce("w", F.lit(0).cast("long")))
    joined = element_lookup(base, explode, weights, "token", [id_col, *keep], "frequency")
    return joined.withColumn("w", F.coalesce("w", F.lit(0).cast("long")))


def _items_by_block(base: DataFrame, weights: DataFrame) -> DataFrame:
    """``base`` and ``items``, the tokens of each row (``pos, token, w, piece``), looked up by blocks of rows."""
    rows = base.withColumn("_tokens", F.transform("pieces", piece_token))
    both = array_lookup(rows, "_tokens", weights, "token", "w", "_w", keep_keys=True)
    zipped = F.arrays_zip(F.col("_tokens").alias("token"), F.col("_w").alias("w"), F.col("pieces").alias("piece"))
    items = F.transform(zipped, lambda x, i: F.struct(
        i.alias("pos"), x["token"].alias("token"), F.coalesce(x["w"], F.lit(0).cast("long")).alias("w"), x["piece"].alias("piece")))
    return both.withColumn("items", items)


def weighted_items(base: DataFrame, scorer: AdditiveScorer, id_col: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """``(id, *keep, items)``: the tokens of each row in order (``pos, token, w, piece``)."""
    weights = micro_weights(scorer)
    if not fits_broadcast(weights.select("token", "w")):
        return _items_by_block(base, weights).select(id_col, *keep, "items")
    tw = piece_weights(base, scorer, id_col, keep)
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", "token", "w", "piece"))
    docs = tw.groupBy("_row", id_col, *keep).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return docs.select(id_col, *keep, "items")


def attribute(df: DataFrame, scorer: AdditiveScorer, id_col: str = "doc_id", text_col: str = "text",
              partitioned: bool = False) -> DataFrame:
    """M3: softmax of the token scores over the positions of each document.

    For the additive scorer a token's attribution score is its weight. ``(id, pos, token, weight,
    prob)``; the start mark is not a token here, so nothing needs the -10000 exclusion.
    """
    tw = piece_weights(prepare(df, id_col, text_col, partitioned=partitioned), scorer, id_col)
    tw = tw.filter(F.col("pos").isNotNull()).withColumn("weight", F.col("w") / F.lit(1e6))
    doc = Window.partitionBy("_row", id_col)
    e = F.exp(F.col("weight") - F.max("weight").over(doc))
    return tw.withColumn("_e", e).select(id_col, "pos", "token", "weight", (F.col("_e") / F.sum("_e").over(doc)).alias("prob"))


def masking(items: Column, bias: int) -> tuple[Column, Column, Column]:
    """For the tokens of one document (``pos, token, w``): the order in which they are masked, the score, and
    the end of the loop (``n`` masked, score ``left``), in millionths.

    Candidates go by (weight desc, position); the mask character is none and comes last. The loop masks a
    prefix of that order: it stops at the first score that is not above 0, though later negative weights
    might raise it again."""
    order = F.array_sort(F.transform(items, lambda x: F.struct((x["token"] == MASK_CHAR).alias("out"), (-x["w"]).alias("nw"),
                                                               x["pos"].alias("pos"))))
    score = F.aggregate(items, F.lit(bias).cast("long"), lambda a, x: a + x["w"])
    state = F.struct(score.alias("left"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("on"))

    def step(a: Column, x: Column) -> Column:
        on = a["on"] & (a["left"] > 0) & ~x["out"]
        return F.struct((a["left"] + F.when(on, x["nw"]).otherwise(F.lit(0).cast("long"))).alias("left"),
                        (a["n"] + F.when(on, 1).otherwise(0)).alias("n"), on.alias("on"))

    done = F.when(score > 0, F.aggregate(order, state, step)).otherwise(state)
    return order, score, done


def purify(df: DataFrame, scorer: AdditiveScorer, id_col: str = "doc_id", text_col: str = "text",
           keep: Sequence[str] = (), partitioned: bool = False) -> DataFrame:
    """M4: ``(id, *keep, p0, p1, pred, text, n_masked, final_score)``, one row per row of ``df``.

    ``p0``, ``p1`` and ``pred`` are those of the first pass; ``text`` is the masked text (tokens
    joined by one space, a masked token written as one mask character per character) or, when
    nothing was masked, the cleaned text. Ids may repeat or be null. Ranking runs inside the row, and only
    for documents that score toxic. ``partitioned`` as in ``prepare``: with a bucketed input the whole plan
    runs without an exchange.
    """
    docs = weighted_items(prepare(df, id_col, text_col, keep, partitioned), scorer, id_col, keep)
    order, score, done = masking(F.col("items"), scorer.micro_bias)
    docs = docs.select(id_col, *keep, "items", score.alias("_s0"), done.alias("_done"))
    flags = F.array_sort(F.transform(order, lambda x, i: F.struct(
        x["pos"].alias("pos"), (i < F.col("_done.n")).alias("masked"))))
    masked_text = F.array_join(F.zip_with("items", flags, lambda x, f: F.when(f["masked"], mask_token(x["token"])).otherwise(
        x["token"])), " ")
    cleaned = F.array_join(F.transform("items", lambda x: x["piece"]), "")
    s0 = F.col("_s0") / F.lit(1e6)
    p0, p1 = probabilities(s0)
    return docs.select(
        id_col, *keep, p0.alias("p0"), p1.alias("p1"), (F.col("_s0") > 0).cast("int").alias("pred"),
        F.when(F.col("_done.n") > 0, masked_text).otherwise(cleaned).alias("text"),
        F.col("_done.n").alias("n_masked"), (F.col("_done.left") / F.lit(1e6)).alias("final_score"))


# --- M4 alternative: the literal loop with a pluggable model ------------------------------------

#: Tokens of documents whose strings a worker holds at once, one document at least.
SLICE_TOKENS = 1 << 18

PURIFIED_SCHEMA = "p0 double, p1 double, pred int, text string, n_masked long, final_score double"


def _spans(offsets, chosen):
    """The places of the tokens of ``chosen`` documents, one after the other, and the offsets of the documents among them."""
    import numpy as np

    size = (offsets[1:] - offsets[:-1])[chosen]
    ends = np.concatenate([[0], np.cumsum(size)])
    return np.arange(ends[-1]) + np.repeat(offsets[:-1][chosen] - ends[:-1], size), ends


def mask_batch(tokens, offsets, model):
    """The mask-and-rescore loop over a batch of documents: ``tokens`` (an object array, masked in place) one document after the other,
    ``offsets`` where each begins. Returns the first scores, the last scores and the number of masked tokens.

    Each round scores all documents that are still toxic and have a token left to mask, in one call of ``model(tokens, offsets) ->
    (score of each document, attribution of each token)``; then each gets its best candidate masked (ties: the first position).
    The others have left."""
    import numpy as np

    score, attribution = (np.array(x) for x in model(tokens, offsets))
    first, masked = score.copy(), np.zeros(len(score), np.int64)
    is_mask = np.fromiter((not t.strip(MASK_CHAR) for t in tokens), dtype=bool, count=len(tokens))
    live = np.flatnonzero(score > 0)
    while len(live):
        at, ends = _spans(offsets, live)
        open_ = ~is_mask[at]
        counts = np.concatenate([[0], np.cumsum(open_)])
        counts = counts[ends[1:]] - counts[ends[:-1]]
        live, at = live[counts > 0], at[open_]
        if not len(live):
            break
        starts = np.cumsum(counts[counts > 0]) - counts[counts > 0]
        worth = attribution[at]
        best = np.repeat(np.maximum.reduceat(worth, starts), counts[counts > 0]) == worth
        hits = np.flatnonzero(best)
        chosen = at[hits[np.searchsorted(hits, starts)]]
        for place in chosen.tolist():
            tokens[place] = MASK_CHAR * len(tokens[place].replace("#", "").replace(" ", ""))
        is_mask[chosen] = True
        masked[live] += 1
        at, ends = _spans(offsets, live)
        score[live], attribution[at] = model(tokens[at], ends)
        live = live[score[live] > 0]
    return first, score, masked


def purify_with_model(df: DataFrame, load_model, id_col: str = "doc_id", text_col: str = "text",
                      keep: Sequence[str] = (), keep_schema: str = "") -> DataFrame:
    """M4 for any model: score, and while toxic mask the unmasked token with the highest
    attribution (ties: first position) and score again; stop when not toxic or nothing is left.

    ``load_model()`` runs once per task and returns a model of batches (``mask_batch``) with an attribute ``scale`` (the score is
    ``score / scale``; integer scores divided by a power of ten give the same doubles as a decimal cast). Cleaning and token
    pieces are Spark expressions; a row is a whole document, so nothing is shuffled, grouped or split, and the same plan runs on a
    stream. Use ``purify`` for additive scorers: it is the closed form of this loop.
    """
    from toxscan.session import ship_package

    ship_package(df.sparkSession)
    base = df.select(id_col, *keep, token_pieces(clean_text(text_col)).alias("pieces"))
    base = base.withColumn("tokens", F.transform("pieces", piece_token))
    id_type = dict(df.dtypes)[id_col]
    schema = ", ".join(x for x in (f"{id_col} {id_type}", keep_schema, PURIFIED_SCHEMA) if x)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        model = load_model()
        scale = float(getattr(model, "scale", 1))
        for whole in batches:
            for batch in _slices(whole, pc.list_value_length(whole.column("tokens")).to_numpy(zero_copy_only=False)):
                lists = batch.column("tokens")
                offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
                tokens = np.array(lists.flatten().to_pylist(), dtype=object)
                first, last, masked = mask_batch(tokens, offsets, model)
                text = [" ".join(tokens[a:b]) if n else "".join(p.as_py())
                        for p, a, b, n in zip(batch.column("pieces"), offsets[:-1].tolist(), offsets[1:].tolist(), masked.tolist())]
                x = first.astype(float) / scale
                with np.errstate(over="ignore"):  # e^x overflows to infinity, as in the JVM
                    p0, p1 = 1.0 / (1.0 + np.exp(x)), 1.0 / (1.0 + np.exp(-x))
                out = [*(batch.column(c) for c in (id_col, *keep)), pa.array(p0), pa.array(p1), pa.array((first > 0).astype("int32")),
                       pa.array(text, pa.string()), pa.array(masked, pa.int64()), pa.array(last.astype(float) / scale)]
                yield pa.RecordBatch.from_arrays(out, names=[id_col, *keep, *(c.split()[0] for c in PURIFIED_SCHEMA.split(", "))])

    return base.select(id_col, *keep, "pieces", "tokens").mapInArrow(run, schema)


def _slices(batch, sizes):
    """Rows of an Arrow batch in turn, about ``SLICE_TOKENS`` in each slice by the rows' ``sizes``."""
    import numpy as np

    slice_of = (np.cumsum(sizes) - sizes) // SLICE_TOKENS
    starts = np.flatnonzero(np.diff(slice_of, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(int(a), int(b - a))
