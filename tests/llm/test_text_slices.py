"""pipeline: tasks of near dedup and decontamination hold the texts of a slice of an Arrow batch at a time."""

import numpy as np
import pyarrow as pa
import pytest

from toxscan.llm import decontaminate as D
from toxscan.llm import simhash as S


class Frame:
    """Takes the task of a mapInArrow."""

    def __init__(self, spark):
        self.sparkSession, self.schema = spark, S.T.StructType([S.T.StructField("_id", S.T.LongType())])

    def select(self, *columns):
        return self

    def mapInArrow(self, task, schema):
        self.task, self.columns = task, schema
        return self

    def withColumnRenamed(self, *names):
        return self


class All:
    def may_hold(self, hashes):
        return np.ones(len(hashes), dtype=bool)

    def among(self, words):
        return np.zeros(len(words.hash), dtype=bool)


TEXTS = [" ".join(f"w{i}x{k}" for k in range(12)) + " " * 99_000 for i in range(60)]


def test_decontamination_takes_slices(spark, monkeypatch):
    seen, real = [], D.canonical_tokens
    monkeypatch.setattr(D, "canonical_tokens", lambda texts, names: seen.append(sum(map(len, texts))) or real(texts, names))
    docs, names = Frame(spark), type("Shared", (), {"value": All()})
    D.document_runs(docs, "text", [8], All(), names, 4)
    texts = [*TEXTS, None, "", TEXTS[0]]
    ids = pa.array(range(len(texts)), pa.int64())
    out = pa.Table.from_batches(docs.task(iter([pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["h1", "h2", "text"])])))
    assert max(seen) <= 2 << 20 and sum(seen) == sum(len(t or "") for t in texts)
    assert out["h1"].to_pylist() == [*range(60), 62] and out["start"].to_pylist() == [0] * 61
    assert out["hashes"][0] == out["hashes"][60] and all(len(h) == 5 for h in out["hashes"])


def test_near_dedup_takes_slices(spark, monkeypatch):
    seen, real = [], S.fingerprints
    monkeypatch.setattr(S, "fingerprints", lambda texts, words: seen.append(sum(map(len, texts))) or real(texts, words))
    docs = Frame(spark)
    S.with_fingerprints(docs, "doc_id", "text", 4)
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(TEXTS)], names=["_id", "_text"])
    out = pa.Table.from_batches(docs.task(iter([batch])))
    assert max(seen) <= 4 << 20 and sum(seen) == sum(map(len, TEXTS))
    assert out["_id"].to_pylist() == list(range(60)) and out["fp"].to_pylist() == real(TEXTS, 4).tolist()


@pytest.mark.parametrize("limit", [1, 1000])
def test_decontamination_by_any_slices(spark, monkeypatch, limit):
    docs, names = Frame(spark), type("Shared", (), {"value": All()})
    texts = [t.strip() for t in TEXTS]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["h1", "h2", "text"])
    D.document_runs(docs, "text", [8, 3], All(), names, 4)
    whole = pa.Table.from_batches(docs.task(iter([batch]))).to_pylist()
    monkeypatch.setattr(D, "TEXT_BYTES", limit)
    key = lambda r: (r["h1"], r["size"])
    assert sorted(pa.Table.from_batches(docs.task(iter([batch]))).to_pylist(), key=key) == sorted(whole, key=key)
