from pyspark.sql import functions as F

from toxscan.operators import tokens as TK
from toxscan.session import write_table

SF001 = "/root/testdata/sf0.001"


def test_encode_covers_the_whole_text(spark):
    docs = TK.with_tokens(spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text"))
    docs = write_table(docs.select("doc_id", "tokens"), "test-tokens")
    vocab = write_table(TK.build_vocab(TK.token_counts(TK.token_table(docs)), 500), "test-vocab")
    enc = TK.encode(docs, vocab, max_length=150)
    ids = {r.token: r.id for r in vocab.collect()}
    chunks = {}
    for r in enc.collect():
        assert len(r.input_ids) <= 150 and r.input_ids[0] == TK.CLS_ID and r.input_ids[-1] == TK.SEP_ID
        chunks.setdefault(r.doc_id, {})[r.chunk] = r.input_ids[1:-1]
    long_docs = 0
    for r in docs.collect():
        parts = chunks[r.doc_id]
        assert sorted(parts) == list(range(len(parts)))
        body = [i for c in sorted(parts) for i in parts[c]]
        assert body == [ids.get(t, TK.UNK_ID) for t in r.tokens]  # every token, in order
        long_docs += len(parts) > 1
    assert long_docs > 0  # some documents need several chunks


def test_model_inputs_and_decode(spark):
    vocab = spark.createDataFrame([("[PAD]", 0, None), ("[UNK]", 1, None), ("[CLS]", 2, None), ("[SEP]", 3, None),
                                   ("*", 4, None), ("you", 5, 9), ("idiot", 6, 3)], "token string, id int, count long")
    toks = spark.createDataFrame([(1, ["you", "idiot", "zzz", "*"]), (2, [])], "doc_id long, tokens array<string>")
    enc = TK.encode(toks, vocab, max_length=8, pad=True)
    mi = {r.doc_id: r for r in TK.model_inputs(enc).collect()}
    assert mi[1].input_ids == [2, 5, 6, 1, 4, 3, 0, 0] and mi[1].attention_mask == [1, 1, 1, 1, 1, 1, 0, 0]
    assert mi[2].input_ids == [2, 3, 0, 0, 0, 0, 0, 0] and mi[2].token_type_ids == [0] * 8
    dec = {r.doc_id: r.text for r in TK.decode(enc.withColumn("chunk", F.lit(0)), vocab).collect()}
    assert dec == {1: "you idiot *", 2: ""}  # pad, unknown, start and end dropped


def test_vocabulary_and_weights_have_no_cap(spark):
    from toxscan.plans import artifacts

    sf = "/root/testdata/sf0.1"
    assert artifacts.scorer(spark, sf).weights.count() == 101_840


def test_decode_returns_every_token(spark):
    docs = TK.with_tokens(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    vocab = TK.build_vocab(TK.token_counts(TK.token_table(docs)))
    back = TK.decode(TK.encode(docs, vocab), vocab)
    got = {}
    for r in back.orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).extend(r.text.split(" ") if r.text else [])
    assert got == {r.doc_id: list(r.tokens) for r in docs.collect()}


def test_ids_may_repeat(spark):
    docs = TK.with_tokens(spark.createDataFrame([(1, "a b"), (1, "c"), (None, "a")], "doc_id long, text string"))
    vocab = TK.build_vocab(TK.token_counts(TK.token_table(docs)))
    back = TK.decode(TK.encode(docs, vocab), vocab)
    assert sorted(r.text for r in back.collect()) == ["a", "a b", "c"]
