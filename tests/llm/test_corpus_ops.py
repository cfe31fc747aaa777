"""Operators on a corpus against brute force: near and exact dedup, line dedup, decontamination, quality."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from xxhash import xxh64_intdigest
from pyspark.sql import functions as F

from toxscan.llm import decontaminate as D
from toxscan.llm import exact_dedup as X
from toxscan.llm import line_dedup as LD
from toxscan.llm import quality_lm as Q
from toxscan.llm import simhash as S
from toxscan.llm.components import connected_components

SF001 = "/root/testdata/sf0.001"


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- SimHash -------------------------------------------------------------------------------------

def _fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(prints: dict, distance: int) -> dict:
    ids, root = sorted(prints), {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    prints = {r.doc_id: _fingerprint(r.text) for r in docs.collect()}
    want = _components(prints, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


@pytest.mark.parametrize("distance", [0, 1, 4, 6])
def test_ring_never_loses_a_link(distance):
    rng = np.random.default_rng(distance)
    ring = S.Ring(distance)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, size=rng.integers(0, distance + 1), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    ka, kb = ring.keys(a), ring.keys(b)
    for x, y, p, q in zip(ka, kb, a, b):
        shared = set(x.tolist()) & set(y.tolist())
        assert any(ring.linked(np.array([p ^ q]), int(k % ring.m))[0] for k in shared)


@pytest.mark.parametrize("bucket", [4096, 100])
def test_links_in_large_buckets(spark, bucket):
    rng = np.random.default_rng(5)
    prints = []
    for n in (700, *rng.integers(1, 20, 30)):
        base = int(rng.integers(0, 1 << 63))
        for _ in range(n):
            x = base
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(bit)
            prints.append(x)
    prints = sorted(set(prints))
    signed = {x: int(np.uint64(x).astype(np.int64)) for x in prints}
    nodes = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    groups = {r.node: r.component for r in connected_components(S.fingerprint_links(nodes, 4, bucket)).collect()}
    want = _components({x: x for x in prints}, 4)
    same = defaultdict(set)
    for x in prints:
        same[groups.get(signed[x], signed[x])].add(want[x])
    assert all(len(v) == 1 for v in same.values()) and len(same) == len(set(want.values()))


def test_simhash_edge_cases(spark):
    long = "Word " * 300_000
    df = _docs(spark, [(5, None), (4, " \n"), (3, "ONE two"), (2, "one\ttwo"), (None, "one two"), (7, long), (7, long)]).withColumn("fp", F.lit("x"))
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    f, w = f"{_fingerprint('one two'):016x}", f"{_fingerprint('word word word word'):016x}"
    assert got == sorted([(5, "0" * 16, 4), (4, "0" * 16, 4), (3, f, 2), (2, f, 2), (None, f, 2), (7, w, 7), (7, w, 7)], key=str)
    assert S.near_duplicates(df.limit(0)).count() == 0
    kept = S.without_near_copies(df)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 7, 7] and kept.columns == df.columns


# --- exact dedup ---------------------------------------------------------------------------------

ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (None, " "), (6, "x"), (6, "x"), (7, "X y"), (8, "é "), (9, "z" * 200_000)]


def _exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i, t))
    return sorted(((m[2], min(g)[2], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for m in g), key=str)


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("files", [1, 1000])
def test_exact_dedup(spark, weak, files):
    digest = (lambda c: F.substring(F.sha2(c, 256), 1, 1)) if weak else X.sha256
    df = _docs(spark, ROWS).withColumn("digest", F.lit(1)).repartition(3)
    got = X.exact_dedup(df, digest=digest, files_per_batch=files).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == _exact(ROWS)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert X.exact_dedup(df.limit(0)).count() == 0


def test_without_copies_keeps_columns(spark):
    df = _docs(spark, ROWS).withColumn("_at", F.lit("mine")).withColumn("kept", F.lit(None).cast("int"))
    kept = X.without_copies(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "None", "6", "7", "8", "9"])
    assert {r["_at"] for r in kept.collect()} == {"mine"}


def test_state_goes_on_from_its_checkpoint(spark):
    from toxscan.session import scratch_path

    folder, checkpoint, out = (scratch_path(spark, n) for n in ("records", "checkpoint", "changes"))
    for rows in (ROWS[:4], ROWS[4:]):
        part = X.records(X.anchored(_docs(spark, rows), "doc_id", "text"), "doc_id", "text", X.sha256)
        part.write.mode("append").parquet(folder)
        state = X.run_state(spark, folder, part.schema, checkpoint, out, 10)
    got = {r.digest: (r.group_size, r.keep.id) for r in state.collect()}
    assert got == {sha: (n, keep) for _, keep, n, sha in _exact(ROWS)}


# --- line dedup ----------------------------------------------------------------------------------

def _lines(rows, min_chars=40, min_docs=5):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or i == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches, fan_out", [(1, 4), (5, 2), (7, 3)])
def test_line_dedup(spark, batches, fan_out):
    rare, common, short = "r" * 45, "The Common line that many documents hold, again", "short line"
    rows = [(i, f"{common}\n{short}\n \t{common.upper()}\x0b\nown line number {i} that is long enough to count") for i in range(6)]
    rows += [(i, f"{rare}\n{rare}\r") for i in range(10, 14)] + [(20, None), (21, ""), (22, "\n\n"), (None, common), (3, common), (30, "w" * 100_000)]
    df = _docs(spark, rows).withColumn("lost", F.lit(1)).withColumn("h1", F.lit(1))
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, "\n".join(r.kept)) for r in LD.dedup_lines(df, batches=batches, fan_out=fan_out).collect()), key=str)
    assert got == _lines(rows) and sum(r[2] for r in got) > 10
    assert LD.dedup_lines(df.limit(0)).count() == 0


def test_runs_know_what_is_fresh(spark):
    runs = LD.LineRuns(spark, fan_out=2)
    for part, fresh in (([(1, 1), (2, 1), (2, 2)], {1, 2}), ([(3, 2), (3, 3)], {3}), ([(4, 1), (4, 4)], {4}), ([(5, 5)], {5})):
        run = runs.add(spark.createDataFrame([(d, h, h) for d, h in part], "doc long, h1 long, h2 long"))
        assert {r.h1 for r in run.filter("fresh").collect()} == fresh
    assert [len(x) for x in runs.levels] == [0, 0, 1]  # merged twice over
    merged = spark.table(runs.levels[2][0])
    assert {(r.h1, r.n_docs, r.max_doc) for r in merged.collect()} == {(1, 3, 4), (2, 2, 3), (3, 1, 3), (4, 1, 4), (5, 1, 5)}
    run = runs.add(spark.createDataFrame([(d, h, h) for d, h in [(9, 1), (2, 5), (7, 6)]], "doc long, h1 long, h2 long"))
    assert {(r.h1, r.n_docs, r.max_doc, r.fresh) for r in run.collect()} == {(1, 4, 9, False), (5, 2, 5, False), (6, 1, 7, True)}
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_the_verdict_comes_from_the_merge_joins(spark, monkeypatch):
    df = _docs(spark, [(i, "a line that is held by all of the documents, again\nown") for i in range(12)])
    assert sum(r.n_dropped for r in LD.dedup_lines(df).collect()) == 11
    add = LD.LineRuns.add

    def forgetful(self, records):
        self.levels = []  # no run is met: every key is fresh
        return add(self, records)

    monkeypatch.setattr(LD.LineRuns, "add", forgetful)
    assert sum(r.n_dropped for r in LD.dedup_lines(df).collect()) == 0
    failed = LD.LineRuns.drop
    dropped = []
    monkeypatch.setattr(LD.LineRuns, "drop", lambda self: (dropped.append(1), failed(self)))
    monkeypatch.setattr(LD.LineRuns, "add", lambda self, records: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        LD.dedup_lines(df)
    assert dropped == [1]


def test_many_lost_lines_of_a_document(spark):
    import time

    text = "\n".join(f"boilerplate line with the number {i}, of some length" for i in range(20_000))
    df = _docs(spark, [(i, text) for i in range(5)])
    start = time.time()
    assert sorted(r.n_dropped for r in LD.dedup_lines(df).collect()) == [0, *[20_000] * 4]
    assert time.time() - start < 60


def test_rows_of_an_exploded_input_have_places_of_their_own(spark, tmp_path):
    spark.createDataFrame([(1, "same text"), (2, "other")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    scan = spark.read.parquet(str(tmp_path / "d"))
    twice = scan.select("doc_id", "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).selectExpr("doc_id * 10 + k as doc_id", "text")
    for df in (twice, scan.join(scan.select("doc_id"), "doc_id").unionByName(twice), twice.sample(1.0)):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        kept = [r.doc_id for r in X.exact_dedup(df).filter("kept").collect()]
        assert sorted(kept) == sorted({min(i for i, t in rows if t == text) for text in ("same text", "other")})
        assert X.without_copies(df).count() == 2


@pytest.mark.parametrize("kind", ["long", "int", "smallint"])
def test_least_id_stays(spark, kind):
    low = {"long": -2 ** 63, "int": -2 ** 31, "smallint": -2 ** 15}[kind]
    df = spark.createDataFrame([(low, "a b"), (5, "a b"), (None, "a b"), (None, "c"), (7, "c ")], f"doc_id {kind}, text string")
    got = {(r.doc_id, r.keep_id, r.kept) for r in X.exact_dedup(df).collect()}
    assert got == {(low, low, True), (5, low, False), (None, low, False), (None, 7, False), (7, 7, True)}


def test_large_groups_are_dealt_over_salts(spark, monkeypatch):
    monkeypatch.setattr(X, "LARGE", 10)
    rows = [(i, "copy of a text") for i in range(50)] + [(100 + i, f"pair {i // 2}") for i in range(40)] + [(999, "one")]
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    for digest in (X.sha256, weak):
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in X.exact_dedup(_docs(spark, rows), digest=digest).collect()) == sorted(
            (i, k, n) for i, k, n, _ in _exact(rows))


# --- decontamination -----------------------------------------------------------------------------

ITEM = "Yes John has 17 apples and gives 12 miles of them to Sue before John leaves the old market with 17 bags."


def test_decontaminate_finds_changed_slots(spark):
    docs = [(1, "noise before it. " + ITEM.replace("John", "Tom").replace("17", "3").replace("Sue", "Ann Lee").replace("miles", "kg") + " And noise."),
            (2, ITEM), (3, ITEM.lower()), (4, ITEM.replace("12 miles", "12miles")), (5, "Nothing of it, only other words, and many of them, for a while, you see."),
            (6, " ".join(reversed(ITEM.split()))), (7, None), (8, ""), (9, ITEM[:40]), (10, "filler " * 100_000 + ITEM), (2, ITEM), (None, ITEM)]
    items = spark.createDataFrame([(70, ITEM), (71, "too short"), (72, None), (73, "five plain words stand here")], "item_id long, text string")
    df = _docs(spark, docs + [(11, "see: Five plain words stand HERE, all of them")]).withColumn("h1", F.lit(1)).withColumn("_h1", F.lit(1))
    got = defaultdict(list)
    for r in D.decontaminate(df, items).collect():
        got[r.doc_id].append((r.contaminated, r.item_ids))
    found = {k for k, v in got.items() if v[0][0]}
    assert found == {1, 2, 3, 4, 10, 11, None} and len(got[2]) == 2 and got[2][0] == got[2][1] == (True, [70]) and got[11] == [(True, [73])]
    clean = D.without_contaminated(df, items)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {5, 6, 7, 8, 9}
    assert not any(r.contaminated for r in D.decontaminate(df, items.limit(0)).collect())
    assert D.decontaminate(df.limit(0), items).count() == 0


class PlainNames:
    """Names as the operator has them, in plain sets."""

    def __init__(self, items):
        low, only = set(), set()
        for w in (w.strip(".,!?:;()'\"") for t in items if t for w in t.split()):
            (only if w[:1].isupper() and w[1:].islower() else low).add(w.lower())
        self.low, self.only = {xxh64_intdigest(w) for w in low}, {xxh64_intdigest(w) for w in only - low}

    def among(self, words):
        held = [int(h) in self.only or bool(c) and int(h) not in self.low for h, c in zip(words.hash, words.capital)]
        return np.array(held, dtype=bool)


def _windows(text, names, size=None):
    owner, shape, value, kind = D.canonical_tokens([text], names)
    size = size or min(8, len(shape))
    h, ok = D.window_hashes(owner, shape, kind, size, 4, value) if size else ([], np.zeros(0, bool))
    return size, len(shape), [int(x) if y else None for x, y in zip(h, ok)], [None if k == D.LITERAL else int(v) for k, v in zip(kind, value)]


def _found(doc, items, names):
    """Every window of a document against every window of every item, run by run."""
    out = set()
    for size in {size for size, _, _, _ in items.values() if size}:
        known = {h for s, _, hs, _ in items.values() if s == size for h in hs if h is not None}
        _, _, hashes, slots = _windows(doc, names, size)
        at = [p for p, h in enumerate(hashes) if h in known]
        runs = []
        for p in at:
            if runs and p - runs[-1][-1] <= size:
                runs[-1].append(p)
            else:
                runs.append([p])
        for run in runs:
            a, b = run[0], run[-1]
            own = [h if h in known else None for h in hashes[a:b + 1]]
            for i, (s, tokens, item_hashes, item_slots) in items.items():
                if s == size:
                    places = {p - q for p, h in enumerate(own) if h is not None for q, g in enumerate(item_hashes) if g == h}
                    if any(D.aligned(own, slots[a:b + size], item_hashes, item_slots, x, size, tokens) >= 0.5 for x in places):
                        out.add(i)
    return sorted(out)


def test_slots_must_be_consistent():
    def share(a, b):
        names = PlainNames([a])
        (_, tokens, ih, islots), (_, _, dh, dslots) = _windows(a, names), _windows(b, names)
        return D.aligned(dh, dslots, ih, islots, 0, 8, tokens)

    item = "we saw 4 cats near the house and then 4 dogs near the barn and then 4 cows near the pond and so on"
    assert share(item, item.replace("4", "9")) == 1.0
    assert share(item, item.replace("4 dogs", "5 dogs").replace("4 cows", "6 cows")) < 0.8
    assert share(item, item.replace("4 dogs", "9 dogs")) > share(item, item.replace("4 dogs", "5 dogs").replace("4 cows", "6 cows"))


def test_an_item_is_found_beside_another_ones_windows(spark):
    a = "one plain passage about old river boats that nobody remembers"
    b = "boats that nobody remembers " + " ".join(f"alpha{i}" for i in range(36))
    text = "start " + "passage about old river boats that nobody remembers alpha0 alpha1 alpha2 alpha3 alpha4 alpha5 alpha6 alpha7" + " end"
    for items in ([(1, a)], [(1, a), (2, b)], [(2, b), (1, a)]):
        got = D.decontaminate(_docs(spark, [(5, text)]), spark.createDataFrame(items, "item_id long, text string")).first()
        assert got.contaminated and got.item_ids == [1] and got.coverage == pytest.approx(8 / 10)


@pytest.mark.parametrize("change", [str, str.lower, str.upper, str.title, lambda t: t.replace(" ", "  \n")])
def test_letter_case_hides_nothing(spark, change):
    items = ["In May the engineer John Smith of Leeds measured the bridge at 17 metres. USA teams say that he may be right.",
             "Tom has apples and he gives them to Sue. Tom buys more of them on the market."]
    docs = [(i, f"Some words before. {change(t)} And words behind.") for i, t in enumerate(items)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {r.doc_id: r.item_ids for r in D.decontaminate(_docs(spark, docs), bench).collect()} == {0: [0], 1: [1]}


def test_names_that_the_benchmark_lacks(spark):
    item = "Tom has 3 apples and he gives 2 of them to Sue. Tom buys five more of them."
    docs = [(1, item.replace("Tom", "Anna").replace("Sue", "Bert").replace("3", "8").replace("five", "six")), (2, item.replace("apples", "pears").replace("gives", "takes").replace("them", "it"))]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in D.decontaminate(_docs(spark, docs), bench).collect()} == {1: True, 2: False}


def test_decontaminate_equals_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = {r.item_id: r.text for r in items.collect()}
    names = PlainNames(texts.values())
    known = {i: _windows(t, names) for i, t in texts.items()}
    rows = docs.collect()
    some = rows[:120] + [r for r in rows[120:] if any(t in (r.text or "") for t in texts.values())]
    got = {r.doc_id: r.item_ids for r in D.decontaminate(docs, items).collect()}
    assert set(got) == {r.doc_id for r in rows}
    assert {r.doc_id: got[r.doc_id] for r in some} == {r.doc_id: _found(r.text, known, names) for r in some}
    held = {r.doc_id: sorted(i for i, t in texts.items() if t in (r.text or "")) for r in rows}
    assert sum(map(bool, held.values())) > 0 and all(set(held[d]) <= set(got[d]) for d in held)


# --- quality -------------------------------------------------------------------------------------

def _kneser_ney(texts, order):
    counts = {order: Counter()}
    for t in texts:
        if t:
            s = Q.START * (order - 1) + t + Q.END
            counts[order].update(s[i - order + 1:i + 1] for i in range(order - 1, len(s)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    less = {k: Q.discounts([sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]) for k, c in counts.items()}
    total, mass = defaultdict(Counter), defaultdict(Counter)
    for k, c in counts.items():
        for g, n in c.items():
            total[k][g[:-1]] += n
            mass[k][g[:-1]] += less[k][min(n, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(counts[1]) + 1)
        t = total[k][g[:-1]]
        if not t:
            return p(g[1:]) if k > 1 else 1 / (len(counts[1]) + 1)
        n = counts[k][g]
        return (n - less[k][min(n, 3) - 1] if n else 0) / t + mass[k][g[:-1]] / t * p(g[1:])

    return p


@pytest.mark.parametrize("order", [2, 4])
def test_kneser_ney_equals_brute_force(spark, order):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", F.substring("text", 1, 300).alias("text"), "lang")
    train = docs.filter("doc_id % 2 = 0")
    p = _kneser_ney([Q.plain(r.text) for r in train.collect()], order)
    extra = spark.createDataFrame([(-1, None, None), (-2, "  ", "en"), (-3, "中文 Ж", "xx"), (-4, "a", "en")], docs.schema)
    got = {r.id: (r.n, r.loss) for r in Q.scores(docs.limit(40).unionByName(extra), Q.fit(train, order=order)).collect()}
    want = {r.doc_id: Q.plain(r.text) for r in docs.limit(40).unionByName(extra).collect()}
    assert set(got) == set(want)
    for i, t in want.items():
        if not t:
            assert got[i] == (0, None)
            continue
        s = Q.START * (order - 1) + t + Q.END
        loss = -sum(math.log(p(s[j - order + 1:j + 1])) for j in range(order - 1, len(s))) / (len(t) + 1)
        assert got[i][0] == len(t) + 1 and got[i][1] == pytest.approx(loss, rel=1e-9)
    some = Counter(g[:-1] for g in ("ab" * order,))
    assert some and sum(p("a" * (order - 1) + c) for c in {x for t in want.values() for x in t}) <= 1 + 1e-9


def test_quality_keeps_clean_and_rejects_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = Q.classify(docs, Q.trusted_ids(labels)).join(labels, "doc_id")
    by = {r.quality: r.share for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert by[1] >= 0.99 and by[0] <= 0.4


def test_quality_edge_cases(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    odd = spark.createDataFrame([(None, None, None), (-1, "", "en"), (-1, "", "en"), (-2, "q£" * 60_000, None)], docs.schema)
    df = docs.unionByName(odd).withColumn("kept", F.lit("mine")).withColumn("h1", F.lit(1))
    got = Q.classify(df, Q.trusted_ids(labels))
    assert got.count() == docs.count() + 4
    assert {r.kept for r in got.filter("doc_id is null or doc_id = -1").collect()} == {True}
    assert not got.filter("doc_id = -2").first().kept
    kept = Q.without_rejected(df, Q.trusted_ids(labels))
    assert kept.columns == df.columns and kept.filter("doc_id = -2").count() == 0 and kept.filter("doc_id is null").count() == 1
    none = Q.classify(df, Q.trusted_ids(labels.limit(0)))
    assert none.filter("not kept").count() == 0 and none.count() == df.count()
    assert Q.classify(df.limit(0), Q.trusted_ids(labels)).count() == 0


def test_quality_rare_language_has_its_own_limits(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    trusted = Q.trusted_ids(labels).join(docs, "doc_id").filter("lang = 'en' or lang = 'de' and doc_id % 3 > 0").select("doc_id")
    got = Q.classify(docs, trusted).join(labels, "doc_id").filter("quality = 1 and toxic = 0").join(trusted.withColumn("seen", F.lit(True)), "doc_id", "left")
    rows = got.collect()
    unseen = [r for r in rows if r.lang == "de" and not r.seen]
    assert len(unseen) >= 5 and sum(r.kept for r in unseen) >= 0.9 * len(unseen) and all(r.judged for r in unseen)
    assert {(r.kept, r.judged) for r in rows if r.lang in ("es", "fr")} == {(True, False)}


def test_quality_limits_are_the_quantiles(spark):
    rng = np.random.default_rng(1)
    n, z = rng.integers(100, 5000, 20_000), rng.normal(0, 1, 20_000)
    rows = [("en" if i % 2 else "de", int(n[i]), float((2 + i % 2) + z[i] / math.sqrt(n[i])), i % 10 < 2) for i in range(len(n))]
    sample = spark.createDataFrame(rows, "lang string, n long, loss double, held boolean")
    limits = {r.lang: r for r in Q.language_limits(sample, 0.99).collect()}
    for lang, r in limits.items():
        own = [(x[2] - r.median) * math.sqrt(x[1]) for x in rows if x[0] == lang]
        assert 0.01 <= sum(v < r.low or v > r.high for v in own) / len(own) <= 0.03
    assert set(limits) == {"de", "en"}


def test_decontaminate_finds_bare_and_unspaced_items(spark):
    texts = {1: "What is 12 * 45 + 7?", 2: "3 5 8 13 21 34 55 89 144 233", 3: "今天天气很好，我们去公园散步，看见很多花。", 4: "Paul Anna 1912 Oslo 17 Rome 23"}
    items = spark.createDataFrame(list(texts.items()) + [(9, "12 45")], "item_id long, text string")
    docs = [(i, f"Some words stand before it. {t} And some behind it.") for i, t in texts.items()]
    docs += [(11, "See what is 13 * 45 + 7? Yes."), (12, "3 5 8 13 22 34 56 89 145 233"), (13, "今天天气不好，他们在家看书，没有散步。"), (14, "12 45")]
    got = {r.doc_id: r.item_ids for r in D.decontaminate(_docs(spark, docs), items).collect()}
    assert got == {1: [1], 2: [2], 3: [3], 4: [4], 11: [], 12: [], 13: [], 14: []}
