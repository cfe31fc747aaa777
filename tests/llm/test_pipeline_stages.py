"""The quality and packing stages of the pipeline against the same work in plain Python."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F
from test_corpus_ops import _kneser_ney

import corpus_pipeline
from toxscan.llm import quality_lm as Q
from toxscan.llm.packing import Limits, pack_ids
from toxscan.llm.tokenizing import SegmentEncoder

SF001 = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def _at(values, share):
    """The value at a share of the sorted values, as percentile_approx has it."""
    values = sorted(values)
    return values[max(1, math.ceil(share * len(values))) - 1] if values else None


def _beyond(at, tail, rows):
    return at + (tail or 0.0) * max(0.0, -math.log(0.01 * (rows + 1)))


def _mean(values):
    return sum(values) / len(values) if values else None


def _plain_quality(rows, trusted):
    """Ids that are kept: the model of trusted texts but a tenth, limits by language, as the module says."""
    held = {i for i in trusted if zlib.crc32(str(i).encode()) % 10 == 0}
    p = _kneser_ney([Q.plain(t) for i, t, _ in rows if i in trusted and i not in held], 4)
    score = {}
    for i, t, lang in rows:
        s = Q.plain(t)
        if s:
            padded = Q.START * 3 + s + Q.END
            loss = -sum(math.log(p(padded[j - 3:j + 1])) for j in range(3, len(padded))) / (len(s) + 1)
            score[i] = (lang, len(s) + 1, loss)
    sample = [(lang, n, loss, i in held) for i, (lang, n, loss) in score.items() if i in trusted]
    median = {}
    for lang in {x[0] for x in sample}:
        own = [x[2] for x in sample if x[0] == lang and x[3]]
        median[lang] = ((_at(own, 0.5) or 0.0) * len(own) + _at([x[2] for x in sample if x[0] == lang], 0.5) * Q.MEDIAN_ROWS) / (len(own) + Q.MEDIAN_ROWS)
    z = [(lang, (loss - median[lang]) * math.sqrt(n), h) for lang, n, loss, h in sample]

    def limits(some):
        every, own = [x[1] for x in some], [x[1] for x in some if x[2]]
        low = _beyond(_at(every, 0.01), _mean([v for v in every if v < 0]), len(every))
        high = _beyond(_at(own, 0.99), _mean([v for v in own if v > 0]), len(own)) if own else None
        return low, high, len(every), len(own)

    pooled = limits(z)
    of = {}
    for lang in median:
        low, high, n, k = limits([x for x in z if x[0] == lang])
        of[lang] = ((low * n + pooled[0] * Q.SPREAD_ROWS) / (n + Q.SPREAD_ROWS), ((high or 0.0) * k + pooled[1] * Q.SPREAD_ROWS) / (k + Q.SPREAD_ROWS))
    kept = []
    for i, _, lang in rows:
        if i in score and lang in of:
            d = (score[i][2] - median[lang]) * math.sqrt(score[i][1])
            if not of[lang][0] <= d <= of[lang][1]:
                continue
        kept.append(i)
    return sorted(kept)


def test_quality_stage_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    trusted = {r.doc_id for r in Q.trusted_ids(labels).collect()}
    got = STAGES["quality"](spark, docs, SF001)
    assert got.columns == docs.columns
    want = _plain_quality(rows, trusted)
    assert sorted(r.doc_id for r in got.collect()) == want and 0 < len(want) < len(rows)


def test_packing_stage_equals_plain_packing(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").unionByName(
        spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0)], spark.read.parquet(f"{SF001}/documents.parquet").schema)).coalesce(1)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    encode = SegmentEncoder("byte_bpe_50k.json", True)
    ids = {i: [*np.frombuffer(x, "<u4").tolist(), 1] for (i, _), x in zip(rows, encode.batch([t for _, t in rows]))}

    class Example(list):
        def __init__(self, i):
            super().__init__(ids[i])
            self.doc = i

    want = []
    for k, pieces in enumerate(pack_ids(((Example(i), None) for i, _ in rows), Limits())):
        at = 0
        for p in pieces:
            part = np.array(p.example[p.start:p.start + p.length], "<u4").tobytes()
            want.append((p.example.doc, p.start, p.length, zlib.crc32(part), len(p.example), k, at))
            at += p.length
    got = STAGES["packing"](spark, docs, SF001).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_stages_on_null_rows_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (-5, "", "en", "s", 0), (-5, "", "en", "s", 0)], docs.schema)
    start = docs.unionByName(odd).withColumn("kept", F.lit(1)).withColumn("h1", F.lit(2)).withColumn("_at", F.lit(3)).withColumn("fp", F.lit(4))
    for name in ("quality", "near_dedup"):
        out = STAGES[name](spark, start, SF001)
        assert out.columns == start.columns
        left = out.filter("doc_id is null or doc_id = -5").count()
        # nothing to judge: all stay; near copies: the rows of the least id stay, both of them
        assert left == (4 if name == "quality" else 2) and {r._at for r in out.collect()} == {3}
