"""Artifacts shared by the queries of one application: the labelled dataset and the fitted scorer,
each written once to the shared folder and read back (lineage cut, files survive executor loss)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from toxscan.operators.logistic import fit_logistic
from toxscan.operators.scorer import AdditiveScorer, fit_scorer
from toxscan.plans.dataset import LabelledDataset, labelled_dataset
from toxscan.operators.tokens import build_vocab, token_counts, token_table, with_tokens
from toxscan.session import read_table, spread, write_table

_cache: dict = {}


def _key(spark: SparkSession, sf_dir: str, what: str):
    return (spark.sparkContext.applicationId, sf_dir.rstrip("/"), what)


def dataset(spark: SparkSession, sf_dir: str) -> LabelledDataset:
    k = _key(spark, sf_dir, "dataset")
    if k not in _cache:
        _cache[k] = labelled_dataset(spark, sf_dir, materialize=True)
    return _cache[k]


def scorer(spark: SparkSession, sf_dir: str) -> AdditiveScorer:
    k = _key(spark, sf_dir, "scorer")
    if k not in _cache:
        ds = dataset(spark, sf_dir)
        docs = read_table(spark, sf_dir, "documents")
        fitted, path = fit_scorer(ds.train, docs).materialized("scorer")
        _cache[k] = fitted
        _cache[_key(spark, sf_dir, "scorer_path")] = path
    return _cache[k]


def logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of the fitted logistic model."""
    k = _key(spark, sf_dir, "logistic")
    if k not in _cache:
        _cache[k] = fit_logistic(dataset(spark, sf_dir).train, read_table(spark, sf_dir, "documents"))
    return _cache[k]


def scorer_path(spark: SparkSession, sf_dir: str) -> str:
    scorer(spark, sf_dir)
    return _cache[_key(spark, sf_dir, "scorer_path")]


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, tokens`` of all documents, cleaned and tokenized once: the vocabulary and the encoding both
    read these arrays."""
    k = _key(spark, sf_dir, "doc_tokens")
    if k not in _cache:
        docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
        _cache[k] = write_table(with_tokens(docs).select("doc_id", "tokens"), "doc-tokens")
    return _cache[k]


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of all documents."""
    k = _key(spark, sf_dir, "vocab")
    if k not in _cache:
        _cache[k] = write_table(build_vocab(token_counts(token_table(doc_tokens(spark, sf_dir)))), "vocab")
    return _cache[k]
