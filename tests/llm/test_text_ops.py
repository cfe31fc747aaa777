"""Operators on single texts: chat formatting, HTML extraction, language ID, token counts, packing."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from toxscan.llm import chat_format as C
from toxscan.llm import html_extract as H
from toxscan.llm import language_id as L
from toxscan.llm.chat_template import Const, Text, TemplateError, compile_template, fold, parse
from toxscan.llm.packing import Limits, Piece, VectorPacker, pack, pack_ids
from toxscan.llm.token_count import count_tokens
from toxscan.llm.tokenizing import SegmentEncoder, encoder, pieces, segments

SF001 = "/root/testdata/sf0.001"
ODD = "x" * 30 + " \n" + "two  spaces\tand more   end<|endoftext|> tail 's don't 12,5 é\U0001f600 \x1c!"


# --- chat formatting -----------------------------------------------------------------------------

def test_template_folds_constants():
    filters = {"up": str.upper}
    assert fold(parse("a{{ 'b' ~ 1 | up }}{% if 1 + 1 == 2 %}c{% else %}d{% endif %}{# no #}"), filters) == (Text("ab1c"),)
    assert fold(parse("{% if x and false %}a{% else %}b{% endif %}"), filters)[0].test.right == Const(False)
    assert compile_template("{% for m in ms %}{{ m.t }}{% if not loop.last %},{% endif %}{% endfor %}", {})(
        {"ms": [{"t": "a"}, {"t": None}, {"t": 3}]}).text == "a,,3"


def test_strings_may_hold_the_end_of_a_mark():
    assert compile_template("a{{ '}}' ~ \"%}\" }}b{% if x == '%}' %}c{% endif %}{# it's no string #}d{{ 'it\\'s }}' }}", {})({"x": "%}"}).text == "a}}%}bcdit's }}"
    assert compile_template("{{ 'a' }} it's {{ 'b' }}", {})({}).text == "a it's b"


@pytest.mark.parametrize("bad", ["{% for x in y %}", "{{ a( }}", "{{ x | nothing }}", "{% import os %}", "{{ a b }}", "{{ 'a }}"])
def test_template_errors(bad):
    with pytest.raises(TemplateError):
        compile_template(bad, {})


def test_template_is_closed():
    class Thing:
        secret = "s"

    assert compile_template("{{ x.secret }}{{ x.__class__ }}{{ y.__class__ }}", {})({"x": Thing(), "y": "t"}).text == ""


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="<|\\ \nan>im_end"), st.text(alphabet="<|\\ \nan>im_end")), max_size=4))
def test_format_reads_back(turns):
    render = compile_template(C.TEMPLATE, C.FILTERS)
    said = render({"messages": [{"role": r, "text": t} for r, t in turns], "trained": ("assistant",)})
    assert C.read_back(said.text) == turns
    said = render({"messages": [{"role": "assistant", "text": t} for _, t in turns], "trained": ("assistant",)})
    assert [C.unescape(said.text[a:b]) for a, b in said.spans] == [t for _, t in turns]


def test_chat_edge_cases(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", "a", 0), (2, 0, None, None, 0), (None, 0, "assistant", "n", 0),
            (3, 5, "assistant", "same", 0), (3, 5, "assistant", "same", 0), (3, None, "user", "<|im_end|>", 0), (4, 0, "assistant", "x" * 300_000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in C.conversation_digests(C.format_conversations(df)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 2, 2: 1, None: 1, 3: 3, 4: 1}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and got[2].loss_chars == 0
    assert got[3].loss_sha256 == hashlib.sha256(b"samesame").hexdigest() and got[4].loss_chars == 300_000
    assert C.conversation_digests(C.format_conversations(df.limit(0))).count() == 0


# --- HTML ----------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) "</p>"</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, and more cookies, and ask for your consent, always and again.</p></div>
<div id="content"><h2>Head &amp; line</h2><p>First   paragraph, with commas, and <b>bold</b> text,
 and a <a href="x">link</a>.<p>Second one, short.<ul><li>item, one of the list<li>item two</ul>
<table><tr><td>cell a<td>cell b</table><aside>Aside, not the text, at all, really not.</aside></div>
<section id="comments"><p>A reader says, with many words, and commas, and opinions, that this is a comment.</p></section>
<form><p>Search, for something, in this, form.</p></form><footer>&copy; foot</footer></body></html>"""


def test_html_main_text():
    assert H.main_text(PAGE) == ("Head & line\nFirst paragraph, with commas, and bold text, and a link.\nSecond one, short.\n"
                                 "item, one of the list\nitem two\ncell a\ncell b")


@pytest.mark.parametrize("page, text", [
    ("", ""), ("   ", ""), ("just words", "just words"), ("<p>a &lt; b &am", "a < b &am"), ("<p>cut <b", "cut"),
    ("<body><p>&nbsp;</p></body>", ""), ("<nav>only menu</nav>", ""), ("<article><header><h1>Own</h1></header><p>Text</article>", "Own\nText"),
    ("<article><p>one<br>two</article>", "one two"), ("<article class='entry-header'><p>kept</article>", "kept"),
])
def test_html_edge_cases(page, text):
    assert H.main_text(page) == text


def test_html_names_from_headings_do_not_drop_the_article():
    prose = "Much has been written on this, at length, and by many, as the reader of these lines will know by now."
    page = (f'<body><article><h2 id="navigation-and-menus">Menus</h2><p>{prose}</p><section id="related-work"><p>A {prose}</p></section>'
            f'<section id="notice"><p>B {prose}</p></section><div class="share-this"><a href="x">Share</a></div>'
            f'<div class="ad"><p>C {prose}</p></div></article></body>')
    assert H.main_text(page) == f"Menus\n{prose}\nA {prose}\nB {prose}"
    assert H.main_text(f'<body><div class="post comments-open"><p>{prose}</p></div><div class="comment-list"><p>D {prose}</p></div></body>') == prose


def test_html_deep_and_long():
    assert H.main_text("<div>" * 20_000 + "<p>deep text</p>" + "</div>" * 20_000) == "deep text"
    assert len(H.main_text("<article>" + "<p>word, and more words to read here</p>" * 20_000 + "</article>").split("\n")) == 20_000


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (None, None, None, "t"), (1, "u", PAGE, "t")], "page_id long, url string, html string, text string")
    got = [tuple(r) for r in H.extract(df).collect()]
    assert got[0] == got[2] == (1, "u", H.main_text(PAGE), len(H.main_text(PAGE))) and got[1] == (None, None, "", 0)
    assert H.extract(df.limit(0)).count() == 0


# --- language ID ---------------------------------------------------------------------------------

def test_codes():
    assert L.code_matrix(1).shape == (1, 1)
    for n in (2, 3, 5, 7, 12):
        code = L.code_matrix(n)
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2)[np.triu_indices(n, 1)]
        assert apart.min() >= (1 if n == 2 else code.shape[1] // 4)
        assert np.array_equal(code, L.code_matrix(n))


def test_long_text_counts_every_ngram():
    text = "ab cd " * 400_000
    total = sum(ids.shape[0] for _, part in L.parts([text]) for ids, _, _ in [L.buckets(part, 12)])
    whole, _, n = L.buckets([text], 12)
    assert abs(total - n[0]) <= 2 * L.ORDERS * 3


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs.filter(~L.held_out()))
    got = docs.join(L.predict(docs, model), "doc_id").filter(L.held_out() & (F.length("text") >= 40))
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 200 and right >= 0.98
    assert got.filter("score < 0 or score > 1").count() == 0


def test_language_edge_cases(spark):
    df = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"),
                                (4, "12 !?", "de"), (5, "x" * 50, None), (None, "the dog", "en")], "doc_id long, text string, lang string")
    model = L.fit(df)
    got = {r.doc_id: r for r in L.predict(df.withColumn("score", F.lit(1)), model).collect()}
    assert got[1].lang_pred == got[None].lang_pred == "en" and got[2].lang_pred == "de"
    assert (got[3].lang_pred, got[3].score) == (got[4].lang_pred, got[4].score) == ("und", 0.0)
    assert got[5].lang_pred in ("de", "en")
    none = L.fit(df.limit(0))
    assert {r.lang_pred for r in L.predict(df, none).collect()} == {"und"}
    one = L.fit(df.filter("lang = 'en'"))
    assert {r.lang_pred for r in L.predict(df.filter("doc_id = 2"), one).collect()} == {"en"}
    assert L.predict(df.limit(0), model).count() == 0


# --- tokens --------------------------------------------------------------------------------------

def _tokenizer():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab Z9'.!\n\t\r\xa0\x1c\x85\x00\u3000\u00e9\u4e2d|<", "<|endoftext|>", "'s", "  "])).map("".join))
def test_segments_give_the_ids_of_the_text(text):
    whole = _TOK.encode(text, add_special_tokens=False).ids
    assert "".join(segments(text)) == text
    assert np.frombuffer(_IDS.batch([text])[0], dtype="<u4").tolist() == whole
    assert "".join(pieces(text, 3)) == text
    assert [i for p in pieces(text, 3) for i in _TOK.encode(p, add_special_tokens=False).ids] == whole


_TOK, _IDS = _tokenizer(), SegmentEncoder("byte_bpe_50k.json", ids=True, cache_segments=50)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_tokenizers(name):
    texts = ["Hello  world\n", "", ODD]
    got = encoder(name).batch(texts)
    if name.endswith(".model"):
        import public_tokenizers as P
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode(texts)]
    else:
        import public_tokenizers as P
        from tokenizers import Tokenizer

        want = [len(Tokenizer.from_file(P.path(name)).encode(t, add_special_tokens=False).ids) for t in texts]
    assert got == want


def test_token_counts(spark):
    texts = [ODD, "", None, "word " * 400_000, "y" * 5000, ODD]
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = [tuple(r) for r in count_tokens(df).collect()]
    want = [(i if i else None, len((t or "").encode()), n, n > 1024) for i, t in enumerate(texts)
            for n in [len(_TOK.encode(t or "", add_special_tokens=False).ids)]]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert count_tokens(df.limit(0)).count() == 0


# --- packing -------------------------------------------------------------------------------------

def _check_packed(rows, texts, limit=2048):
    at, covered = {}, {}
    for r in rows:
        ids = _TOK.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], dtype="<u4").tobytes())
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
        covered.setdefault(r.doc_id, []).append((r.start, r.length))

    def gapless(spans):
        end = 0
        for start, n in sorted(spans):
            assert start == end and n > 0
            end += n
        return end

    for k, t in texts.items():
        assert gapless(covered[k]) == len(_TOK.encode(t or "", add_special_tokens=False).ids) + 1
    return [gapless(v) for v in at.values()]


def test_packing_keeps_every_id(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").repartition(3)
    texts = {r.doc_id: r.text for r in docs.collect()} | {-1: None, -2: "", -3: "long " * 30_000}
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "long " * 30_000)], "doc_id long, text string")
    sizes = _check_packed(pack(docs.unionByName(more).withColumn("length", F.lit(0))).collect(), texts)
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes)
    assert sum(n == 2048 for n in sizes) > 0.8 * sum(sizes) / 2048
    assert pack(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(0, 2)), max_size=60), st.booleans(), st.integers(1, 6), st.integers(1, 40))
def test_packing_holds_all_limits(sizes, cutting, segments_, loss):
    limits = Limits(tokens=32, segments=segments_, loss=loss)
    examples = []
    for i, (n, kind) in enumerate(sizes):
        bears = np.ones(n, dtype=int) if kind == 0 else (np.arange(n) % 3 == 0).astype(int) if kind == 1 else np.zeros(n, dtype=int)
        examples.append((range(i * 1000, i * 1000 + n), np.concatenate([[0], np.cumsum(bears)]) if kind else None))
    got = list(pack_ids(examples, limits, cutting))
    for seq in got:
        assert sum(p.length for p in seq) <= 32 and len(seq) <= segments_ and sum(p.n_loss() for p in seq) <= loss
        assert not cutting or (n := sum(p.length for p in seq)) == 32 or n & (n - 1) == 0
    ids = sorted(x for seq in got for p in seq for x in p.example[p.start:p.start + p.length])
    assert ids == sorted(x for e, _ in examples for x in e)


def test_packing_prefers_the_best_dot_product():
    packer = VectorPacker(Limits(tokens=10, segments=10, loss=10), cutting=False)
    zero = np.zeros(7, dtype=int)
    list(packer.add(Piece(range(6), 0, 6, zero)))  # tokens only
    list(packer.add(Piece(range(5), 0, 5, None)))  # tokens and loss
    first = next(packer.finish())
    assert first[0].length == 5


def test_language_model_equals_the_same_sums_on_one_machine(spark):
    rows = [(i, lang, text * (1 + i % 3)) for i in range(30) for lang, text in (("aa", "abra cadabra "), ("bb", "bobo bibo "), ("cc", "cici coca "), ("", "1x2 "))]
    rows += [(99, "aa", None), (99, "aa", ""), (98, None, "abra"), (97, "bb", "bobo " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = L.fit(df, bucket_bits=10)
    assert model.languages == ["", "aa", "bb", "cc"]
    counts = np.zeros((4, 1024))
    for _, lang, text in rows:
        if lang is not None:
            for _, part in L.parts([text]):
                counts[model.languages.index(lang)] += np.bincount(L.buckets(part, 10)[0].ravel(), minlength=1024)
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    for k, bit in enumerate(model.code.T):
        odds = np.log(share[bit > 0].mean(axis=0)) - np.log(share[bit < 0].mean(axis=0))
        assert np.allclose(model.weights[:, k], odds, atol=1e-5)
    got = [(r.doc_id, r.lang_pred) for r in L.predict(df, model).collect()]
    assert len(got) == len(rows) and (97, "bb") in got and got.count((99, "und")) == 2 and (98, "aa") in got
    assert L.fit(df.limit(0)).languages == [] and {r.lang_pred for r in L.predict(df, L.fit(df.limit(0))).collect()} == {"und"}
    assert L.predict(df.limit(0), model).count() == 0


# --- HTML extraction: tags with stray quotes, long nesting, siblings, whole pages ---------------------

def test_a_quote_opens_a_value_behind_an_equals_sign_only():
    assert H.main_text("<p><a href=/john's-page>One</a> is a text, of some length.</p><p>The second.</p><p>It's the third.</p>") == \
        "One is a text, of some length.\nThe second.\nIt's the third."
    assert H.main_text("<p><a href=/o'neil>O'Neil</a> wrote \"this\" and that, it's said.</p>") == "O'Neil wrote \"this\" and that, it's said."
    assert H.main_text("<p title=\"a > b\" class = 'x>y' lang=d\"e data-q=1='2>All of it, every word.</p>") == "All of it, every word."


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abc =/'\"-", max_size=8), st.text(alphabet="xyz .,", min_size=1, max_size=12)), min_size=1, max_size=5))
def test_text_between_tags_is_kept(parts):
    # an attribute that ends in a bare value; its quotes stand inside the value
    page = "".join(f"<p data=v{a.replace(' ', '').replace('=', '')}>{t}</p>" for a, t in parts)
    assert H.main_text(f"<article>{page}</article>").split() == " ".join(t for _, t in parts).split()


@pytest.mark.parametrize("page", ["<p>" + "<i>x " * 100_000, "<p>" + "<i>x</b> " * 100_000, "<b><table><tr><td>" + "<i>" * 50_000 + "</b>" * 50_000,
                                  "<div>" * 50_000 + "<p class=note>x</p>" * 20_000, "<button>" * 20_000 + "<p>" * 20_000,
                                  "<a " + "x=' " * 50_000, "<div " + "=" * 100_000 + ">t", "<a b=\"c" * 20_000])
def test_long_nesting_takes_time_by_length(page):
    import time

    start = time.process_time()
    H.main_text(page)
    assert time.process_time() - start < 6


def test_stray_end_tags_close_no_container():
    assert H.main_text("<article><p>Before <b>bold<table><tr><td>cell</b> still cell</td></tr></table> behind it all.</p></article>") == \
        "Before bold\ncell still cell\nbehind it all."


def test_prose_in_a_plain_sibling_belongs_to_the_article():
    long = "A long paragraph of the article, with commas, and more words, that goes on for quite some time, as such ones do. " * 6
    page = (f"<body><div><div><p>{long}</p><p>{long}</p></div><h2>More</h2><div><p>A short last part of the article, in a box of its own, that ends it as "
            "it should end.</p></div><div><a href=/a>One link of many here</a> <a href=/b>and another link, of that kind, to go on with</a></div>"
            "<div class=comments><p>First! This is a comment of a reader, which is not of the article, as everyone knows well.</p></div></div></body>")
    text = H.main_text(page)
    assert "ends it as it should end." in text and "More" in text and "link" not in text and "First!" not in text


def test_pages_equal_a_plain_reading(spark):
    """The article of a page, read without a tree: these pages mark it, and its blocks are paragraphs, headings and list items."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: (r.text, r.n_chars) for r in H.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    assert len(got) == len(pages)
    for r in pages:
        body = "\n".join(re.findall(r"<article>(.*?)</article>", r.html, re.S))
        body = re.sub(r"<!--.*?-->|<(script|style|nav|aside|footer|form)\b.*?</\1>|<div class=\"ad\">.*?</div>", "", body, flags=re.S)
        marked = re.sub(r"</?(?:p|h[1-6]|li|ul|ol|div|blockquote|table|tr|td|section)\b[^>]*>", "\0", body.replace("<br>", " "))
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in marked.split("\0")]
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id] == (want, len(want))


# --- packing with loss spans -------------------------------------------------------------------------

def test_loss_spans_of_conversations(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], ["Why é so?", "Because 日本 😀 it is.", "And then?", "That was all; " * (c + 1)][t % 4])
            for c in range(12) for t in range(4)] + [(99, 0, "user", "no answer")]
    talk = C.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    limits = Limits(tokens=64, segments=8, loss=20)
    pieces = pack(talk, "conv_id", "formatted", loss_col="loss_spans", limits=limits).collect()
    by = {r.conv_id: r for r in talk.collect()}
    vocab = SegmentEncoder("byte_bpe_50k.json", True).tokenizer
    want = {}
    for i, r in by.items():
        at, flags = 0, []
        marks = [(len(r.formatted[:s.start].encode()), len(r.formatted[:s.end].encode())) for s in r.loss_spans]
        for token in vocab.encode(r.formatted, add_special_tokens=False).ids:
            flags.append(any(a <= at < b for a, b in marks))
            at += len(vocab.id_to_token(token))
        want[i] = [*flags, flags[-1]]
    assert want[99] == [False] * len(want[99]) and any(want[0])
    bins = {}
    for p in pieces:
        assert p.n_loss == sum(want[p.conv_id][p.start:p.start + p.length]) and p.doc_tokens == len(want[p.conv_id])
        bins.setdefault(p.sequence_id, []).append(p)
    for b in bins.values():
        assert sum(p.length for p in b) <= 64 and sum(p.n_loss for p in b) <= 20 and len(b) <= 8
    covered = sorted((p.conv_id, p.start + k) for p in pieces for k in range(p.length))
    assert covered == sorted((i, k) for i, w in want.items() for k in range(len(w)))
    # the limit of loss-bearing tokens is felt: without it the sequences are fuller
    free = pack(talk, "conv_id", "formatted", loss_col="loss_spans", limits=Limits(tokens=64, segments=8, loss=64)).collect()
    assert len({p.sequence_id for p in free}) < len(bins)


def test_loss_spans_edge_cases(spark):
    rows = [(1, "abc def", None), (2, "abc def", [(0, 99)]), (3, None, [(0, 1)]), (4, "abc def", [(3, 3), (5, 2)]), (5, "abc def", [(0, 1), (0, 7)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:int,end:int>>")
    got = {}
    for p in pack(df, loss_col="spans").collect():
        got[p.doc_id] = got.get(p.doc_id, 0) + p.n_loss
    assert got == {1: 0, 2: 3, 3: 0, 4: 0, 5: 3}
