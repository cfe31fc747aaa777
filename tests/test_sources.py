import pytest

from toxscan.session import scratch_path
from toxscan.sources.files import dataset_separator, read_dataset, read_line_set, write_dataset

EDGE = [
    (0, "line one\nline two", 0),
    (1, "  leading and trailing  ", 1),
    (2, "", 0),
    (3, None, 1),
    (4, 'quote " and, comma\ttab', 0),
    (5, "carriage\rreturn\r\n", 1),
]


@pytest.mark.parametrize("suffix", [".csv", ".tsv", ".txt"])
def test_dataset_round_trip(spark, suffix):
    df = spark.createDataFrame(EDGE, "_id long, document string, label int")
    path = scratch_path(spark, "rt") + suffix
    write_dataset(df, path)
    back = sorted(tuple(r) for r in read_dataset(spark, path).collect())
    assert back == sorted(EDGE, key=lambda t: t[0])


def test_dataset_suffix_dispatch():
    assert dataset_separator("a/ratings.csv") == ","
    assert dataset_separator("a/ratingstsv") == "\t"
    assert dataset_separator("a/x.txt") == "\t"
    with pytest.raises(ValueError):
        dataset_separator("a/x.xlsx")


def test_read_line_set(spark, tmp_path):
    p = tmp_path / "words.txt"
    p.write_text("bad  \nworse\nbad\n\n  spaced\t\n", encoding="utf-8")
    got = sorted(r.item for r in read_line_set(spark, str(p)).collect())
    assert got == ["", "  spaced", "bad", "worse"]


def test_lexicon_dataframe_path_equals_list_path(spark, tmp_path):
    from pyspark.sql import functions as F

    from toxscan.operators.filters import DEFAULT_LEXICON, lexicon_label

    p = tmp_path / "lexicon.txt"
    p.write_text("\n".join(w.upper() for w in DEFAULT_LEXICON) + "\n", encoding="utf-8")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    a = {r.doc_id: r.lexicon_label for r in lexicon_label(docs, "text").collect()}
    words = read_line_set(spark, str(p))
    b = {r.doc_id: r.lexicon_label for r in lexicon_label(docs, "text", lexicon=words).collect()}
    c = {r.doc_id: r.lexicon_label for r in lexicon_label(docs, "text", lexicon=words.select(F.col("item")))
         .collect()}
    assert a == b == c and sum(a.values()) > 0


def test_dataset_is_read_by_its_header(spark, tmp_path):
    p = tmp_path / "two.tsv"
    p.write_text("document\tlabel\nhello there\t1\n", encoding="utf-8")
    assert [tuple(r) for r in read_dataset(spark, str(p)).collect()] == [(None, "hello there", 1)]
    p = tmp_path / "mixed.csv"
    p.write_text("label,extra,document,_id\n0,x,text,7\n", encoding="utf-8")
    assert [tuple(r) for r in read_dataset(spark, str(p)).collect()] == [(7, "text", 0)]


@pytest.mark.parametrize("text", ["_id,document,label\nx7,text,1\n", "_id,document,label\n7,text,yes\n"])
def test_a_bad_cell_is_an_error(spark, tmp_path, text):
    p = tmp_path / "bad.csv"
    p.write_text(text, encoding="utf-8")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        read_dataset(spark, str(p)).collect()


def test_a_missing_column_is_an_error(spark, tmp_path):
    p = tmp_path / "none.csv"
    p.write_text("_id,text\n1,a\n", encoding="utf-8")
    with pytest.raises(ValueError, match="document, label"):
        read_dataset(spark, str(p))


def test_posts_of_both_forms(spark, tmp_path):
    from toxscan.sources.posts import read_posts

    posts = spark.createDataFrame([("a", 1, 1), ("b", -1, None), (None, 0, 0)], "string string, label int, labeling_confirm int")
    posts.write.parquet(str(tmp_path / "p"))
    posts.write.json(str(tmp_path / "p.json"))
    for path in ("p", "p.json"):
        got = read_posts(spark, str(tmp_path / path))
        assert got.columns == ["doc_id", "string", "label", "labeling_confirm"]
        assert {tuple(r)[1:] for r in got.collect()} == {tuple(r) for r in posts.collect()}
        assert got.select("doc_id").distinct().count() == 3
    posts.drop("label").write.parquet(str(tmp_path / "q"))
    with pytest.raises(ValueError, match="label"):
        read_posts(spark, str(tmp_path / "q"))


def test_null_labels_are_rejected(spark):
    from toxscan.operators.filters import confirmed_only, drop_unlabelled

    posts = spark.createDataFrame([(1, "a", 1, 1), (2, "b", None, 1), (3, "c", None, 0)], "doc_id long, string string, label int, labeling_confirm int")
    for keep in (drop_unlabelled, confirmed_only):
        with pytest.raises(Exception, match="no label"):
            keep(posts).collect()
    assert confirmed_only(posts.filter("doc_id <> 2")).count() == 1
