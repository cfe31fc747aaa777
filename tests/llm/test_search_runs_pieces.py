"""Sentencepiece codec, periodic runs, ranked lexical search: against the library, brute force and SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from toxscan.llm.lexical_search import search
from toxscan.llm.oracle import ORACLE_SQL
from toxscan.llm.periodic_runs import find_runs, least_lcp, periodic_runs
from toxscan.llm.piece_codec import CheckFailed, PieceCodec, codec, decode_pieces, encode_pieces
from toxscan.llm.queries import QUERIES
from toxscan.llm.words import byte_slices, cut_words, numbered

SF001 = "/root/testdata/sf0.001"
MODEL = "piece_bpe_32k.model"
ODD = " ▁\n\t\0ab,é日\U0001f600<0x41>s​\r"


# --- sentencepiece codec ---------------------------------------------------------------------------

@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ODD, max_size=20) | st.text(max_size=30))
def test_agenda_equals_library(text):
    c = codec(MODEL)
    want = c.library.encode(text)
    assert np.frombuffer(c.encode([text])[0], np.int32).tolist() == want
    assert c.decode([*want, c.end]) == c.library.decode([*want, c.end])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 262) | st.integers(0, 31999), max_size=9))
def test_any_ids_decode_like_library(ids):
    c = codec(MODEL)
    want = c.library.decode(ids)
    assert c.decode(ids) == want
    assert c.decode_lists(pa.array([ids, []], pa.list_(pa.int32()))) == [want, ""]


def test_small_cache_changes_nothing():
    c, small = codec(MODEL), PieceCodec(MODEL, cache_cuts=3)
    texts = ["one two  three", "four\nfive one", "", "a" * 5000, "x y z " * 200]
    assert small.encode(texts) == c.encode(texts)
    small.cuts = False
    small.known = {"": b""}
    assert small.encode(texts) == c.encode(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="▁abcdest日é", min_size=1, max_size=12), min_size=1, max_size=8))
def test_agendas_side_by_side_equal_single_ones(texts):
    c = codec(MODEL)
    ids, counts, bad = c.pairs.merge(texts)
    ends = np.cumsum(counts)
    for t, n, e, b in zip(texts, counts, ends, bad):
        assert b or ids[e - n:e].astype(np.int32).tobytes() == c.cut_ids(t)


def test_a_wrong_id_is_noticed(spark):
    c = PieceCodec(MODEL)
    c.compare_cuts([])
    texts = ["one two\n three  four\n\n five ", " ", "", "▁", "é日😀"]
    assert c.encode(texts, check=True) == codec(MODEL).encode(texts)
    for wrong in ("▁two", "\n", "▁", "four" if "four" in c.known else "▁▁four"):
        assert wrong in c.known
        held = c.known[wrong]
        c.known[wrong] = held[:-4] + b"\x07\0\0\0"
        with pytest.raises(CheckFailed):
            c.compare_cuts([wrong])
        c.known[wrong] = held
    c.compare_cuts(c.known)
    with pytest.raises(CheckFailed):
        c.compare(["one"], [c.encode(["two"])[0]])


def test_pieces_edge_cases(spark):
    rows = [(1, None, 5), (2, "", 5), (2, " two  words ", 5), (2, " two  words ", 5), (None, "<s></s>▁", 5), (4, "longword" * 40_000 + " end" * 60_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded int")
    lib = codec(MODEL).library
    assert encode_pieces(df, check="whole").count() == len(rows)
    got = sorted((r.doc_id or 0, r.ids) for r in encode_pieces(df).collect())
    assert got == sorted((i or 0, lib.encode(t or "") + [2]) for i, t, _ in rows)
    back = decode_pieces(encode_pieces(df).withColumnRenamed("doc_id", "decoded"))
    assert back.columns == ["decoded", "ids", "decoded_"]
    texts = sorted((t or "").replace("▁", " ") for _, t, _ in rows)
    assert sorted(r.decoded_ for r in back.collect()) == texts
    assert sorted(r.decoded for r in encode_pieces(df, decoded=True).collect()) == texts
    assert encode_pieces(df.limit(0)).count() == 0 and decode_pieces(encode_pieces(df.limit(0))).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "a int, ids array<int>")
    assert [r.decoded for r in decode_pieces(nulls).collect()] == ["", ""]


def test_query_equals_library(spark):
    lib = codec(MODEL).library
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = QUERIES["op11_piece_codec"](spark, SF001).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id]) + [2]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


# --- periodic runs -----------------------------------------------------------------------------------

def plain_runs(w, min_length=6, min_exponent=4):
    """By each period: stretches that agree with themselves so much later, unless a shorter period does."""
    out = []
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - start
            if n >= max(min_length, min_exponent * q):
                if not any(all(w[start + t] == w[start + t + p] for t in range(n - p)) for p in range(1, q)):
                    out.append((start, n, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_least_lcp():
    assert least_lcp(6, 4) == 5 and least_lcp(2, 2) == 1
    for n, e in ((6, 4), (9, 2), (3, 5), (40, 3)):
        assert least_lcp(n, e) == min(max(n, e * q) - q for q in range(1, 100))


docs_strategy = st.lists(
    st.lists(st.integers(0, 3), max_size=40)
    | st.tuples(st.lists(st.integers(0, 2), max_size=8), st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9)).map(
        lambda x: x[0] + x[1] * x[2] + x[0][:3]), max_size=5)


@settings(max_examples=300, deadline=None)
@given(docs_strategy, st.sampled_from([(6, 4), (2, 2), (3, 2), (10, 3)]))
def test_runs_equal_brute_force(docs, limits):
    found = find_runs(np.array(sum(docs, []), np.int32), [len(d) for d in docs], *limits)
    got = [[] for _ in docs]
    for doc, *run in zip(*(x.tolist() for x in found)):
        got[doc].append(tuple(run))
    assert got == [plain_runs(d, *limits) for d in docs]


def test_words_are_cut_at_the_class_only():
    texts = ["", " a\tb\x0bc\x1cd\x85e\xa0f ", "\n\r\f", "x  y"]
    words, counts = cut_words(pa.array(texts))
    want = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert words.to_pylist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
    code, names = numbered(words)
    assert [names[i].as_py() for i in code] == sum(want, [])
    assert [s for s in byte_slices(pa.array(["aaaa", "b", "c" * 9]), 5)] == [(0, 1), (1, 1), (2, 1)]
    part = pa.array(["xx", "A-b", "é9"]).slice(1)
    table = bytes(32 if chr(b) == "-" else b for b in range(256))
    assert cut_words(part, table)[0].to_pylist() == ["A", "b", "é9"]


def test_runs_edge_cases(spark):
    rows = [(1, None, "z"), (2, "", "z"), (2, " \n", "z"), (3, "a a a a a a", "z"), (3, "a a a a a a", "z"), (None, "no run here", "z"),
            (4, "start " + "x y " * 50_000 + "end", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r.doc_id or 0), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect())
    assert got == [(0, 3, [], "no run here"), (1, 0, [], ""), (2, 0, [], ""), (2, 0, [], ""), (3, 6, [(0, 6, 1)], "a"),
                   (3, 6, [(0, 6, 1)], "a"), (4, 100_002, [(1, 100_000, 2)], "start x y end")]
    assert periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(df, min_exponent=1)


def test_runs_query_equals_brute_force(spark):
    rows = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF001).collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    assert len(rows) == len(docs) and any(r.n_runs for r in rows.values())
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue
        runs = plain_runs(w)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
                hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
        assert tuple(rows[d.doc_id])[1:] == want


# --- ranked lexical search -----------------------------------------------------------------------------

def plain_search(docs, items, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
    terms = [(i, Counter(cut((t or "").translate(lower)))) for i, t in docs]
    terms = [(i, c, sum(c.values())) for i, c in terms if c]
    n_docs, n_terms = len(terms), sum(n for _, _, n in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(cut((t or "").translate(lower)))
    out = []
    for item, wanted in asked.items():
        found = []
        for doc, c, n in terms:
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in wanted if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if null else doc, -s) for k, (s, null, doc) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"block_docs": 7, "group_items": 2, "owners": 3}, {"block_docs": 1, "group_items": 1, "owners": 1}])
def test_search_equals_brute_force(spark, sizes):
    rng = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(40)] + ["Ä", "ä", "THE", "a-b", "9"])
    odds = 1 / np.arange(1, len(words) + 1)
    say = lambda n: " ".join(rng.choice(words, n, p=odds / odds.sum()))
    docs = [(i, say(int(n)), 0) for i, n in enumerate(rng.integers(0, 60, 120))]
    docs += [(i, docs[3][1], 0) for i in range(200, 230)]  # ties
    docs += [(7, docs[7][1], 0), (None, docs[9][1], 0), (300, None, 0), (301, " .,!", 0), (302, "w1 " * 50_000 + "w30", 0)]
    items = [(0, say(9)), (1, say(30)), (1, "w30 w31"), (2, "THE the tHe"), (3, None), (4, "unseen words"), (5, "Ä w38"), (6, docs[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string, score int").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = search(d, q, top=5, **sizes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search([r[:2] for r in docs], items, 5)


def test_search_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search(d.limit(0), q).count() == 0 and search(d, q.limit(0)).count() == 0
    assert search(d.withColumn("text", d.text.substr(0, 0)), q).count() == 0
    assert search(d, q).count() == 1
    named = search(d.selectExpr("cast(doc_id as string) as name", "text as body"), q, doc_id="name", doc_text="body")
    assert [tuple(r)[:3] for r in named.collect()] == [(1, 1, "1")]


def test_search_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    out = con.execute("SELECT item_id, rank, doc_id, score FROM (" + ORACLE_SQL["op13_lexical_search"] + ")").fetchall()
    got = QUERIES["op13_lexical_search"](spark, SF001).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(out)
