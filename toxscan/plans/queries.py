"""The registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (or tables Spark derived from them) in full. Floating-point
results that depend on summation order are rounded to 6 decimals so that two engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toxscan.functions import keys as K
from toxscan.functions import text as T
from toxscan.operators import filters as P
from toxscan.operators import keylookup as KL
from toxscan.operators import logistic as LR
from toxscan.operators import metrics as A
from toxscan.operators import split as SP
from toxscan.operators import tokens as TK
from toxscan.operators import vectors as V
from toxscan.operators.purify import attribute, purify
from toxscan.operators.ranking import exact_rank, scan_rank
from toxscan.operators.scorer import AdditiveModelLoader, batch_score, cross_entropy, score
from toxscan.plans import artifacts
from toxscan.plans.dataset import all_data_split, with_text
from toxscan.session import read_table, scratch_path, spread, write_table
from toxscan.sources import files as S
from toxscan.sources.posts import kept_all, kept_confirmed, progress_counts, scan_posts


def _r6(c) -> F.Column:
    return F.round(c if not isinstance(c, str) else F.col(c), 6)


def _confirmed(spark, sf):
    return P.confirmed_only(scan_posts(spark, sf))


# --- S: sources and sinks --------------------------------------------------------------------

def q_scan_posts(spark: SparkSession, sf: str) -> DataFrame:
    return scan_posts(spark, sf, include_unlabelled=True)


def q_exported_posts(spark, sf):
    """S1 as a data source: the posts as a folder of JSON lines with fields that nobody asks for; the filters go to the source."""
    from toxscan.sources.exported import read_exported

    path = scratch_path(spark, "exported-posts")
    posts = scan_posts(spark, sf, include_unlabelled=True)
    posts.select(F.col("doc_id").alias("_id"), F.lit("x").alias("author"), "string", "label", "labeling_confirm").write.json(path)
    found = read_exported(spark, path, range_bytes=1 << 20)
    return found.filter((F.col("label") != -1) & (F.col("labeling_confirm") != 0))


def q_progress_counts(spark, sf):
    return progress_counts(scan_posts(spark, sf, include_unlabelled=True))


def q_dataset_csv_roundtrip(spark, sf):
    """S3 then S2: the labelled dataset (``_id`` per class, document, label) written as CSV and read
    back with the explicit schema."""
    ds = P.with_index(P.class_bucket(P.project_dataset(_confirmed(spark, sf))))
    path = scratch_path(spark, "ratings_labeled") + ".csv"
    S.write_dataset(ds, path)
    return S.read_dataset(spark, path)


def q_dataset_csv_split(spark, sf):
    """S3 then S2: the labelled dataset as one file, or a few beyond twice what one task reads, read in blocks."""
    ds = P.with_index(P.class_bucket(P.project_dataset(_confirmed(spark, sf))))
    path = scratch_path(spark, "ratings_labeled_one") + ".csv"
    S.write_dataset(S.in_few_files(ds), path)
    return S.read_dataset(spark, path, split=True)


def q_dataset_tsv_roundtrip(spark, sf):
    """S3 then S2 for the tab-separated form, on the shuffled test split."""
    ds = artifacts.dataset(spark, sf)
    test = with_text(ds.test, spark, sf, out="document").withColumn("_id", F.col("position"))
    path = scratch_path(spark, "ratings_labeled_test") + ".tsv"
    S.write_dataset(test, path)
    return S.read_dataset(spark, path)


def q_line_set(spark, sf):
    return S.line_set(read_table(spark, sf, "documents"), "text")


def q_report_head(spark, sf):
    """S5 + T11: the first 100 rows of the shuffled test file, scored, as report lines."""
    ds = artifacts.dataset(spark, sf)
    head = ds.test.orderBy("position").limit(100)
    p = purify(with_text(head, spark, sf), artifacts.scorer(spark, sf), keep=["label", "position"])
    return p.select("position", "doc_id", T.format_report("label", "pred", "p0", "p1").alias("report"))


# --- P: filters and projections --------------------------------------------------------------

def q_drop_unlabelled(spark, sf):
    return P.drop_unlabelled(scan_posts(spark, sf, include_unlabelled=True)).select("doc_id", "label")


def q_confirmed_only(spark, sf):
    return P.confirmed_only(scan_posts(spark, sf, include_unlabelled=True)).select("doc_id", "label", "labeling_confirm")


def q_project_dataset(spark, sf):
    return P.project_dataset(_confirmed(spark, sf))


def q_class_bucket(spark, sf):
    return P.class_bucket(_confirmed(spark, sf).select("doc_id", "label"))


def q_with_index(spark, sf):
    return P.with_index(P.class_bucket(_confirmed(spark, sf).select("doc_id", "label"))).select("doc_id", "bucket", "_id")


def q_null_as_text(spark, sf):
    docs = read_table(spark, sf, "documents")
    return P.null_text(docs.select("doc_id", "text")).select("doc_id", "text")


def q_lexicon_label(spark, sf):
    posts = P.confirmed_only(scan_posts(spark, sf, spread_text=True))
    return P.lexicon_label(posts, "string").select("doc_id", "label", "lexicon_label")


def q_lexicon_metrics(spark, sf):
    """The minimum slice: posts -> confirmed -> dataset -> clean -> lexicon label -> metrics."""
    ds = P.project_dataset(P.confirmed_only(scan_posts(spark, sf, spread_text=True)))
    labelled = P.lexicon_label(ds, "document", out="pred")
    return A.binary_metrics(labelled, "label", "pred")


def q_lexicon_file(spark, sf):
    """S4 then P7: the word list as a file of lines, in capitals, with copies and trailing white space."""
    path = scratch_path(spark, "lexicon") + ".txt"
    words = spark.createDataFrame([(w.upper() + end,) for w in P.DEFAULT_LEXICON for end in ("", " \t")], "value string")
    words.write.text(path)
    posts = P.confirmed_only(scan_posts(spark, sf, spread_text=True))
    found = P.lexicon_label(posts, "string", lexicon=S.read_line_set(spark, path))
    return found.select("doc_id", "label", "lexicon_label")


# --- R: split, sampling, set operations ------------------------------------------------------

def q_random_split(spark, sf):
    return all_data_split(spark, sf)


def q_stratified_split(spark, sf):
    return artifacts.dataset(spark, sf).split.select("doc_id", "bucket", "_id", "split")


def q_oversample(spark, sf):
    return artifacts.dataset(spark, sf).train.filter("bucket = 1").select("doc_id", "bucket", "_id", "copy")


def q_balanced_train(spark, sf):
    return artifacts.dataset(spark, sf).train.select("doc_id", "bucket", "copy")


def q_shuffle_rows(spark, sf):
    return artifacts.dataset(spark, sf).train.select("doc_id", "bucket", "copy", "position")


def q_split_summary(spark, sf):
    return artifacts.dataset(spark, sf).summary(q_progress_counts(spark, sf))


def q_split_summary_observed(spark, sf):
    """R6 with the progress counts that the build itself observed."""
    from toxscan.plans.dataset import observed_dataset

    dataset, progress = observed_dataset(scan_posts(spark, sf, include_unlabelled=True))
    return dataset.summary(progress)


def q_exact_rank(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return exact_rank(docs, [F.col("n_chars").desc(), "doc_id"], ["lang"], rank_col="rank").select("doc_id", "lang", "rank")


def _confirmed_labels(spark, sf):
    """The confirmed rows of the ``labels`` table as a plain scan, with their class."""
    labels = read_table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"), F.col("quality").alias("labeling_confirm"))
    return P.class_bucket(labels.filter(kept_confirmed()).select("doc_id", "label"))


def q_with_index_file_order(spark, sf):
    """P5 in input order: the place of each confirmed row of the label file within its class."""
    return scan_rank(_confirmed_labels(spark, sf), "bucket", rank_col="_id").select("doc_id", "bucket", "_id")


def q_stratified_split_file_order(spark, sf):
    """R2 in input order."""
    return SP.stratified_split_scan(_confirmed_labels(spark, sf)).select("doc_id", "bucket", "_id", "split")


def q_random_split_permuted(spark, sf):
    """R1 by a keyed permutation of the places in the label file."""
    labels = read_table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"))
    return SP.random_split_permuted(labels.filter(kept_all()))


def q_shuffle_permuted(spark, sf):
    """R5 by a keyed permutation, of the balanced train rows in input order."""
    split = write_table(SP.stratified_split_scan(_confirmed_labels(spark, sf)), "split-scan")
    n = SP.class_counts(split.filter("split = 'train'"))
    out = SP.shuffle_permuted(SP.balanced_train(split), n.get(0, 0), n.get(1, 0))
    return out.select("doc_id", "bucket", "copy", "position")


# --- T: text functions -----------------------------------------------------------------------

def q_allowlist_chars(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.allowlist_chars("text").alias("text"))


def q_strip_urls(spark, sf):
    pages = read_table(spark, sf, "pages")
    return pages.select("page_id", T.strip_urls(F.concat(F.lit("see "), "url", F.lit(" end"))).alias("text"))


def q_trim_text(spark, sf):
    conv = read_table(spark, sf, "conversations")
    return conv.select("conv_id", "turn", T.trim_text(F.concat(F.lit(" \t"), "text", F.lit("\n "))).alias("text"))


def q_collapse_repeats(spark, sf):
    return _documents(spark, sf).select("doc_id", T.collapse_repeats("text").alias("text"))


def _documents(spark, sf):
    """The documents table, spread over the task slots when the scan alone would not be."""
    return spread(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def q_clean_text(spark, sf):
    return _documents(spark, sf).select("doc_id", T.clean_text("text").alias("text"))


def q_clean_conversations(spark, sf):
    return read_table(spark, sf, "conversations").select("conv_id", "turn", T.clean_text("text").alias("text"))


def q_tokenize(spark, sf):
    docs = TK.with_tokens(_documents(spark, sf))
    return TK.token_table(docs).select("doc_id", F.col("pos").cast("long").alias("pos"), "token")


def q_build_vocab(spark, sf):
    return TK.build_vocab(TK.token_counts(TK.token_table(artifacts.doc_tokens(spark, sf))))


def _encoded(spark, sf, pad):
    vocab = artifacts.vocab(spark, sf)
    return TK.encode(artifacts.doc_tokens(spark, sf), vocab, pad=pad), vocab


def _ids_text(c):
    return F.array_join(F.col(c), " ")


def q_encode(spark, sf):
    enc, _ = _encoded(spark, sf, pad=False)
    return enc.select("doc_id", "chunk", F.size("input_ids").alias("n_ids"), _ids_text("input_ids").alias("input_ids"))


def q_model_inputs(spark, sf):
    enc, _ = _encoded(spark, sf, pad=True)
    mi = TK.model_inputs(enc)
    return mi.select("doc_id", "chunk", _ids_text("input_ids").alias("input_ids"),
                     _ids_text("token_type_ids").alias("token_type_ids"), _ids_text("attention_mask").alias("attention_mask"))


def q_decode(spark, sf):
    enc, vocab = _encoded(spark, sf, pad=False)
    return TK.decode(enc, vocab)


def q_mask_token(spark, sf):
    docs = TK.with_tokens(_documents(spark, sf))
    toks = TK.token_table(docs).select("token").distinct()
    return toks.select("token", T.mask_token("token").alias("masked"))


# --- M: scorer, attribution, purify, vectors ---------------------------------------------------

def _test_docs(spark, sf):
    return with_text(artifacts.dataset(spark, sf).test, spark, sf)


def q_fit_scorer(spark, sf):
    w = artifacts.scorer(spark, sf).weights
    return w.select("token", F.col("weight").cast("double").alias("weight"), "c0", "c1")


def _scored_test(spark, sf):
    test = TK.with_tokens(_test_docs(spark, sf))
    return score(test, artifacts.scorer(spark, sf), keep=["label", "position"])


def q_score(spark, sf):
    s = _scored_test(spark, sf)
    return s.select("doc_id", "label", "score", "pred", _r6("p0").alias("p0"), _r6("p1").alias("p1"))


def q_attribute(spark, sf):
    a = attribute(_test_docs(spark, sf), artifacts.scorer(spark, sf))
    return a.select("doc_id", F.col("pos").cast("long").alias("pos"), "token", "weight", _r6("prob").alias("prob"))


def q_purify(spark, sf):
    p = purify(_test_docs(spark, sf), artifacts.scorer(spark, sf), keep=["label"])
    return p.select("doc_id", "label", _r6("p0").alias("p0"), _r6("p1").alias("p1"), "pred", "text", "n_masked",
                    "final_score")


def q_purify_file(spark, sf):
    """The labelled dataset file, whose ``_id`` restarts in each class, purified row by row."""
    from toxscan.plans.inference import moderate

    path = scratch_path(spark, "ratings_labeled") + ".csv"
    S.write_dataset(with_text(artifacts.dataset(spark, sf).split, spark, sf, out="document"), path)
    rows = S.read_dataset(spark, path).select(F.col("_id").alias("doc_id"), F.col("document").alias("text"), "label")
    p = moderate(rows, artifacts.scorer(spark, sf))
    return p.select(F.col("doc_id").alias("_id"), "label", _r6("p0").alias("p0"), _r6("p1").alias("p1"), "pred", "text",
                    "n_masked", "final_score")


def q_purify_loop(spark, sf):
    """M4 alternative: the literal mask-and-rescore loop with the saved scorer as a pluggable model;
    equal to the closed form."""
    from toxscan.operators.purify import purify_with_model

    loader = AdditiveModelLoader(artifacts.scorer_path(spark, sf), token_model=True)
    p = purify_with_model(_test_docs(spark, sf), loader, keep=["label"], keep_schema="label int")
    return p.select("doc_id", "label", _r6("p0").alias("p0"), _r6("p1").alias("p1"), "pred", "text", "n_masked",
                    "final_score")


def q_fit_logistic(spark, sf):
    """M1 alternative: all weights after the last step."""
    w = artifacts.logistic(spark, sf)
    return w.select("token", _r6("weight").alias("weight"), "frequency")


def q_score_logistic(spark, sf):
    s = LR.score_logistic(TK.with_tokens(_test_docs(spark, sf)), artifacts.logistic(spark, sf), keep=["label"])
    return s.select("doc_id", "label", _r6("score").alias("score"), "pred", _r6("p1").alias("p1"))


def q_logistic_metrics(spark, sf):
    s = LR.score_logistic(TK.with_tokens(_test_docs(spark, sf)), artifacts.logistic(spark, sf), keep=["label"])
    return A.binary_metrics(s)


def q_cross_entropy(spark, sf):
    s = _scored_test(spark, sf)
    return s.select("doc_id", "label", _r6(cross_entropy()).alias("loss"))


def q_binary_metrics(spark, sf):
    return A.binary_metrics(_scored_test(spark, sf))


def q_batch_metrics(spark, sf):
    train = TK.with_tokens(with_text(artifacts.dataset(spark, sf).train, spark, sf))
    s = score(train, artifacts.scorer(spark, sf), id_col="doc_id", keep=["label", "copy", "position"])
    s = s.withColumn("loss", cross_entropy())
    out = A.batch_metrics(s, report_cycle=10)
    return out.select("batch_id", "n", "tp", "fp", "fn", "tn", _r6("accuracy").alias("accuracy"),
                      _r6("precision").alias("precision"), _r6("recall").alias("recall"), _r6("f1").alias("f1"),
                      _r6("loss").alias("loss"))


def q_epoch_loss(spark, sf):
    s = _scored_test(spark, sf).withColumn("loss", cross_entropy())
    out = A.epoch_loss(s)
    return out.select(_r6("epoch_loss").alias("epoch_loss"), "n_batches")


def _emb(spark, sf):
    return read_table(spark, sf, "embeddings")


def q_attention_scores(spark, sf):
    sc = V.attention_scores(_emb(spark, sf))
    return sc.select("label", "head", "vec_id", "query_id", _r6("score").alias("score"), _r6("prob").alias("prob"))


def q_attention_pool(spark, sf):
    return V.attention_pool(_emb(spark, sf)).select("label", "dim", _r6("value").alias("value"))


def q_attribute_attention(spark, sf):
    """M3 on vectors: 16 vectors in a row are a document; the projections are moments of the table."""
    rows = _emb(spark, sf).select(F.expr("vec_id div 16").alias("doc_id"), F.expr("vec_id % 16").alias("pos"), "embedding", "label")
    query = V.moment_projection(rows, rows=16)
    key = V.moment_projection(rows.filter("label % 2 = 0"), rows=16)
    out = V.attribute_attention(rows.select("doc_id", "pos", "embedding"), query, key)
    return out.select("doc_id", "pos", _r6("score").alias("score"), _r6("prob").alias("prob"), "place")


def q_split_heads(spark, sf):
    h = V.split_heads(_emb(spark, sf))
    total = F.aggregate("head_vec", F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate("head_vec", F.lit(0.0), lambda a, x: a + x * x))
    return h.select("vec_id", "head", _r6(total).alias("head_sum"), _r6(norm).alias("head_norm"))


def q_combine_layers(spark, sf):
    c = V.combine_layers(_emb(spark, sf))
    return c.select("label", "n", F.posexplode("combined").alias("dim", "value")).select(
        "label", "n", F.col("dim").cast("int").alias("dim"), _r6("value").alias("value"))


def q_linear_head(spark, sf):
    """The pooled vector of each label under the head that picks the nearest class mean of the table."""
    pooled = V.attention_pool(_emb(spark, sf))
    vecs = pooled.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("_p"))
    vecs = vecs.select("label", F.transform("_p", lambda x: x["value"]).alias("pooled"))
    out = V.linear_head(vecs, "pooled", V.centroid_head(_emb(spark, sf)))
    return out.select("label", "pred", F.posexplode("logits").alias("place", "z")).select(
        "label", "pred", F.col("place").cast("long").alias("place"), _r6("z").alias("z"))


# --- K: keys ---------------------------------------------------------------------------------

def _cache_entries(spark, sf):
    """Cache entries derived from pages: the URL without query and fragment, etag = md5(html)."""
    pages = read_table(spark, sf, "pages")
    base = F.regexp_extract("url", r"^[^?#]*", 0)
    return pages.select("page_id", base.alias("url"), F.md5("html").alias("etag"))


def q_url_key(spark, sf):
    pages = read_table(spark, sf, "pages")
    return pages.select("page_id", K.url_key("url").alias("url_key"),
                        K.url_key("url", F.md5("html")).alias("cache_key"))


def _requested_keys(spark, sf):
    pages = read_table(spark, sf, "pages")
    base = F.regexp_extract("url", r"^[^?#]*", 0)
    with_etag = pages.select(K.url_key(base, F.md5("html")).alias("key"))
    plain = pages.select(K.url_key("url").alias("key"))
    return with_etag.unionByName(plain).distinct()


def q_key_lookup(spark, sf):
    meta = KL.key_metadata(_cache_entries(spark, sf)).distinct()
    return KL.key_lookup(_requested_keys(spark, sf), meta)


def q_missing_keys(spark, sf):
    meta = KL.key_metadata(_cache_entries(spark, sf)).distinct()
    return KL.missing_keys(_requested_keys(spark, sf), meta).select("key")


def q_latest_version(spark, sf):
    """Entries by site (the URL up to its host), so that a key has several variants; a page without a query string
    is a plain entry."""
    pages = read_table(spark, sf, "pages")
    etag = F.when(F.col("url").contains("?"), F.md5("html"))
    return KL.latest_version(pages.select(F.regexp_extract("url", r"^[a-z]+://[^/?#]*", 0).alias("url"), etag.alias("etag")))


def _cache_folder(spark, entries, name):
    folder = scratch_path(spark, name)
    KL.write_cache(entries, folder)
    return folder


def q_cache_lookup(spark, sf):
    """K2 over a folder: the pages as cached files with sidecars."""
    pages = read_table(spark, sf, "pages")
    entries = _cache_entries(spark, sf).join(pages.select("page_id", F.col("html").alias("content")), "page_id")
    cached = entries.select(K.url_key("url", "etag").alias("key"), "url", "etag", "content").dropDuplicates(["key"])
    return KL.cache_lookup(_requested_keys(spark, sf), _cache_folder(spark, cached, "url-cache"))


def q_latest_cached(spark, sf):
    """K3 over a folder whose keys have several variants: entries by site, plain where the page's URL has no query string."""
    pages = read_table(spark, sf, "pages")
    etag = F.when(F.col("url").contains("?"), F.md5("html"))
    entries = pages.select(F.regexp_extract("url", r"^[a-z]+://[^/?#]*", 0).alias("url"), etag.alias("etag"))
    cached = entries.select(K.url_key("url", "etag").alias("key"), "url", "etag", F.col("url").alias("content")).dropDuplicates(["key"])
    return KL.latest_cached(entries, _cache_folder(spark, cached, "site-cache"))


def q_route_uri(spark, sf):
    pages = read_table(spark, sf, "pages")
    path = K.object_key("url")
    return pages.select("page_id", K.uri_scheme("url").alias("scheme"), K.route_uri("url").alias("route"),
                        K.route_uri(path).alias("path_route"), K.route_uri(F.concat(F.lit("ftp://"), path)).alias("ftp_route"))


def q_split_object_path(spark, sf):
    pages = read_table(spark, sf, "pages")
    return pages.select("page_id", K.object_bucket("url").alias("bucket"), K.object_key("url").alias("key"),
                        K.object_path_valid("url").cast("int").alias("valid"))


def q_file_extension(spark, sf):
    pages = read_table(spark, sf, "pages")
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", K.file_extension(path).alias("ext"), K.file_extension(path, dot=False).alias("ext_nodot"),
                        K.file_extension(F.upper(path), lower=False).alias("ext_upper"))


# --- X, U: streaming and the pluggable scorer ----------------------------------------------------

def q_stream_moderate(spark, sf):
    from toxscan.streaming.moderate import stream_moderate_test

    out = stream_moderate_test(spark, sf)
    return out.select("doc_id", "label", _r6("p0").alias("p0"), _r6("p1").alias("p1"), "pred", "text", "n_masked",
                      "final_score")


def q_stream_moderate_direct(spark, sf):
    from toxscan.streaming.moderate import stream_moderate_direct

    out = stream_moderate_direct(spark, sf)
    return out.select("doc_id", "label", _r6("p0").alias("p0"), _r6("p1").alias("p1"), "pred", "text", "n_masked",
                      "final_score")


def q_stream_progress(spark, sf):
    from toxscan.streaming.moderate import stream_progress

    return stream_progress(spark, sf)


def q_batch_scorer(spark, sf):
    test = TK.with_tokens(_test_docs(spark, sf)).select("doc_id", "tokens")
    loader = AdditiveModelLoader(artifacts.scorer_path(spark, sf))
    return batch_score(test, loader, "doc_id long, score double, pred int")


QUERIES = {
    "scan_posts": q_scan_posts,
    "exported_posts": q_exported_posts,
    "progress_counts": q_progress_counts,
    "dataset_csv_roundtrip": q_dataset_csv_roundtrip,
    "dataset_csv_split": q_dataset_csv_split,
    "dataset_tsv_roundtrip": q_dataset_tsv_roundtrip,
    "line_set": q_line_set,
    "report_head": q_report_head,
    "drop_unlabelled": q_drop_unlabelled,
    "confirmed_only": q_confirmed_only,
    "project_dataset": q_project_dataset,
    "class_bucket": q_class_bucket,
    "with_index": q_with_index,
    "null_as_text": q_null_as_text,
    "lexicon_label": q_lexicon_label,
    "lexicon_metrics": q_lexicon_metrics,
    "lexicon_file": q_lexicon_file,
    "random_split": q_random_split,
    "stratified_split": q_stratified_split,
    "oversample": q_oversample,
    "balanced_train": q_balanced_train,
    "shuffle_rows": q_shuffle_rows,
    "split_summary": q_split_summary,
    "split_summary_observed": q_split_summary_observed,
    "exact_rank": q_exact_rank,
    "with_index_file_order": q_with_index_file_order,
    "stratified_split_file_order": q_stratified_split_file_order,
    "random_split_permuted": q_random_split_permuted,
    "shuffle_permuted": q_shuffle_permuted,
    "allowlist_chars": q_allowlist_chars,
    "strip_urls": q_strip_urls,
    "trim_text": q_trim_text,
    "collapse_repeats": q_collapse_repeats,
    "clean_text": q_clean_text,
    "clean_conversations": q_clean_conversations,
    "tokenize": q_tokenize,
    "build_vocab": q_build_vocab,
    "encode": q_encode,
    "model_inputs": q_model_inputs,
    "decode": q_decode,
    "mask_token": q_mask_token,
    "fit_scorer": q_fit_scorer,
    "score": q_score,
    "attribute": q_attribute,
    "purify": q_purify,
    "purify_file": q_purify_file,
    "purify_loop": q_purify_loop,
    "fit_logistic": q_fit_logistic,
    "score_logistic": q_score_logistic,
    "logistic_metrics": q_logistic_metrics,
    "cross_entropy": q_cross_entropy,
    "binary_metrics": q_binary_metrics,
    "batch_metrics": q_batch_metrics,
    "epoch_loss": q_epoch_loss,
    "attention_scores": q_attention_scores,
    "attention_pool": q_attention_pool,
    "attribute_attention": q_attribute_attention,
    "split_heads": q_split_heads,
    "combine_layers": q_combine_layers,
    "linear_head": q_linear_head,
    "url_key": q_url_key,
    "key_lookup": q_key_lookup,
    "missing_keys": q_missing_keys,
    "latest_version": q_latest_version,
    "cache_lookup": q_cache_lookup,
    "latest_cached": q_latest_cached,
    "route_uri": q_route_uri,
    "split_object_path": q_split_object_path,
    "file_extension": q_file_extension,
    "stream_moderate": q_stream_moderate,
    "stream_moderate_direct": q_stream_moderate_direct,
    "stream_progress": q_stream_progress,
    "batch_scorer": q_batch_scorer,
}
