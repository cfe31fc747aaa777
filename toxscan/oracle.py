"""DuckDB SQL for each registered query, over the views ``documents labels pages embeddings
conversations ...``. Written as SQL, not generated from the Spark plans; only the fixed patterns
(allowlist, URL, word and token classes) are shared, because they are values both must use.

DuckDB has no regex backreferences, so the repeat collapse drops a word character equal to the two
before it with ``list_filter`` over the characters.
"""

from __future__ import annotations

from toxscan.functions import keys as K
from toxscan.functions import text as T
from toxscan.functions.permute import MIX, ROUNDS, round_keys
from toxscan.operators.logistic import PENALTY, RATE, STEPS

SEED = "42"


def _pats() -> dict:
    return {
        "NK": T.not_kept_pattern(),
        "URL": T.URL_PATTERN,
        "WS": T.WHITESPACE_CLASS,
        "W": T.word_class(),
        "TOK": T.token_pattern(),
    }


def trim_sql(expr: str) -> str:
    ws = T.WHITESPACE_CLASS
    return f"regexp_replace({expr}, '^[{ws}]+|[{ws}]+\\z', '', 'g')"


def collapse_ctes(name: str, src: str, ids: str, expr: str) -> str:
    """CTEs ``{name}_c`` (characters) and ``{name}`` (``ids, clean``) applying the repeat collapse,
    whitespace collapse and trim to ``expr`` evaluated over ``src``."""
    p = _pats()
    keep_char = f"NOT (i > 2 AND ch = chs[i - 1] AND ch = chs[i - 2] AND regexp_full_match(ch, '[{p['W']}]'))"
    joined = f"array_to_string(list_filter(chs, lambda ch, i: {keep_char}), '')"
    return (
        f"{name}_c AS (SELECT {ids}, string_split({expr}, '') AS chs FROM {src}),\n"
        f"{name} AS (SELECT {ids}, {trim_sql(f'''regexp_replace({joined}, '[{p['WS']}]+', ' ', 'g')''')} AS clean "
        f"FROM {name}_c)"
    )


def clean_ctes(name: str, src: str, ids: str, text: str) -> str:
    """CTEs ending in ``{name}(ids, clean)``: null as 'nan', allowlist, URLs, trim, collapse."""
    p = _pats()
    pre = trim_sql(
        f"regexp_replace(regexp_replace(coalesce({text}, 'nan'), '{p['NK']}', ' ', 'g'), '{p['URL']}', '', 'g')"
    )
    return f"{name}_p AS (SELECT {ids}, {pre} AS pre FROM {src}),\n" + collapse_ctes(name, f"{name}_p", ids, "pre")


def tokens_expr(clean: str = "clean") -> str:
    return f"regexp_extract_all(lower({clean}), '{_pats()['TOK']}', 0)"


DOC_TOKENS = (
    clean_ctes("doc_clean", "documents", "doc_id", "text")
    + f",\ndoc_tokens AS (SELECT doc_id, clean, {tokens_expr()} AS tokens FROM doc_clean)"
)

POSTS = "SELECT d.doc_id, d.text AS string, l.toxic AS label, l.quality AS labeling_confirm FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
POSTS_ALL = (
    "SELECT d.doc_id, d.text AS string, CAST(coalesce(l.toxic, -1) AS INTEGER) AS label, "
    "CAST(coalesce(l.quality, 0) AS INTEGER) AS labeling_confirm FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
)
CONFIRMED_WHERE = "coalesce(labeling_confirm <> 0, true) AND label <> -1"


def shuffle_key(*cols: str) -> str:
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"md5(concat_ws(':', '{SEED}', {parts}))"


DATASET = f"""
ds AS (SELECT doc_id, CAST(label AS INTEGER) AS label, CASE WHEN label = 0 THEN 0 ELSE 1 END AS bucket
       FROM ({POSTS}) p WHERE {CONFIRMED_WHERE}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS _id,
                  count(*) OVER (PARTITION BY bucket) AS n_c FROM ds),
split AS (SELECT doc_id, label, bucket, _id, CASE WHEN _id < floor(n_c * 0.75) THEN 'train' ELSE 'test' END AS split
          FROM ranked),
tr AS (SELECT * FROM split WHERE split = 'train'),
cnt AS (SELECT count(*) FILTER (WHERE bucket = 0) AS n0, count(*) FILTER (WHERE bucket = 1) AS n1 FROM tr),
over_all AS (SELECT tr.doc_id, tr.label, tr.bucket, tr._id, unnest(range(cnt.n0 // cnt.n1 + 1)) AS copy, cnt.n0, cnt.n1
             FROM tr, cnt WHERE tr.bucket = 1),
over AS (SELECT doc_id, label, bucket, _id, CAST(copy AS INTEGER) AS copy FROM over_all WHERE copy * n1 + _id < n0),
balanced AS (SELECT doc_id, label, bucket, _id, 0 AS copy FROM tr WHERE bucket = 0 UNION ALL SELECT * FROM over),
train AS (SELECT *, row_number() OVER (ORDER BY {shuffle_key('doc_id', 'copy')}, doc_id, copy) - 1 AS position FROM balanced),
test AS (SELECT doc_id, label, bucket, _id, 0 AS copy,
                row_number() OVER (ORDER BY {shuffle_key('doc_id', "'0'")}, doc_id) - 1 AS position
         FROM split WHERE split = 'test')"""

SCORER = f"""
copies AS (SELECT doc_id, bucket, count(*) AS copies FROM train GROUP BY doc_id, bucket),
tok AS (SELECT c.bucket, c.copies, unnest(t.tokens) AS token FROM copies c JOIN doc_tokens t ON c.doc_id = t.doc_id),
counts AS (SELECT token, CAST(sum(CASE WHEN bucket = 0 THEN copies ELSE 0 END) AS BIGINT) AS c0,
                  CAST(sum(CASE WHEN bucket = 1 THEN copies ELSE 0 END) AS BIGINT) AS c1
           FROM tok WHERE token <> '*' GROUP BY token),
vocab AS (SELECT * FROM counts),
tot AS (SELECT sum(c0) AS t0, sum(c1) AS t1, count(*) AS v FROM vocab),
weights AS (SELECT token, CAST(ln((CAST(c1 AS DOUBLE) + 1.0) / CAST(t1 + v AS DOUBLE))
                          - ln((CAST(c0 AS DOUBLE) + 1.0) / CAST(t0 + v AS DOUBLE)) AS DECIMAL(18,6)) AS weight, c0, c1
            FROM vocab, tot),
bias AS (SELECT CAST(ln(CAST(count(*) FILTER (WHERE bucket = 1) AS DOUBLE) / count(*) FILTER (WHERE bucket = 0))
                     AS DECIMAL(18,6)) AS b FROM train)"""

BASE = f"WITH {DOC_TOKENS},\n{DATASET},\n{SCORER}"

TEST_SCORED = """
test_tok AS (SELECT t.doc_id, t.label, t.position, dt.clean, dt.tokens FROM test t JOIN doc_tokens dt ON t.doc_id = dt.doc_id),
test_tw AS (SELECT doc_id, unnest(tokens) AS token FROM test_tok),
test_sums AS (SELECT x.doc_id, sum(coalesce(w.weight, 0)) AS s FROM test_tw x LEFT JOIN weights w ON x.token = w.token
              GROUP BY x.doc_id),
scored AS (SELECT t.doc_id, t.label, t.position, CAST(bias.b + coalesce(s.s, 0) AS DECIMAL(30,6)) AS sdec
           FROM test_tok t LEFT JOIN test_sums s ON t.doc_id = s.doc_id, bias),
scored2 AS (SELECT doc_id, label, position, CAST(sdec AS DOUBLE) AS score, CAST(sdec > 0 AS INTEGER) AS pred,
                   1.0 / (1.0 + exp(CAST(sdec AS DOUBLE))) AS p0, 1.0 / (1.0 + exp(-CAST(sdec AS DOUBLE))) AS p1 FROM scored)"""



def logistic_ctes() -> str:
    """CTEs ``w0 .. w{STEPS}(token, weight, frequency)``: the steps of ``operators.logistic``, one after the other."""
    out = """
lcopies AS (SELECT doc_id, bucket, CAST(count(*) AS DOUBLE) AS copies FROM train GROUP BY doc_id, bucket),
ltok AS (SELECT c.doc_id, unnest(t.tokens) AS token FROM lcopies c JOIN doc_tokens t ON c.doc_id = t.doc_id),
lcnt AS (SELECT DISTINCT doc_id, token FROM ltok WHERE token <> '*'),
lx AS MATERIALIZED (SELECT doc_id, token, 1.0 / sqrt(CAST(count(*) OVER (PARTITION BY doc_id) AS DOUBLE)) AS x FROM lcnt
                    UNION ALL SELECT doc_id, '', 1.0 FROM lcopies),
ln AS (SELECT sum(copies) AS n FROM lcopies),
w0 AS MATERIALIZED (SELECT token, CAST(0 AS DOUBLE) AS weight, CASE WHEN token <> '' THEN count(*) END AS frequency FROM lx GROUP BY token)"""
    for k in range(STEPS):
        out += f""",
e{k} AS MATERIALIZED (SELECT c.doc_id, c.copies * (1.0 / (1.0 + exp(-z.z)) - c.bucket) / ln.n AS e FROM lcopies c,  ln,
        (SELECT lx.doc_id, sum(w.weight * lx.x) AS z FROM lx JOIN w{k} w ON lx.token = w.token GROUP BY lx.doc_id) z WHERE c.doc_id = z.doc_id),
w{k + 1} AS MATERIALIZED (SELECT w.token, w.weight - {RATE} * (g.g + CASE WHEN w.token = '' THEN 0.0 ELSE {PENALTY} * w.weight END) AS weight, w.frequency
        FROM w{k} w JOIN (SELECT lx.token, sum(e.e * lx.x) AS g FROM lx JOIN e{k} e ON lx.doc_id = e.doc_id GROUP BY lx.token) g ON w.token = g.token)"""
    return out


LOGISTIC_TEST = f"""
lt AS (SELECT t.doc_id, t.label, unnest(d.tokens) AS token FROM test t JOIN doc_tokens d ON t.doc_id = d.doc_id),
ltc AS (SELECT DISTINCT doc_id, token FROM lt WHERE token <> '*'),
ltx AS (SELECT doc_id, token, 1.0 / sqrt(CAST(count(*) OVER (PARTITION BY doc_id) AS DOUBLE)) AS x FROM ltc UNION ALL SELECT doc_id, '', 1.0 FROM test),
lz AS (SELECT x.doc_id, sum(w.weight * x.x) AS z FROM ltx x JOIN w{STEPS} w ON x.token = w.token GROUP BY x.doc_id),
lscored AS (SELECT t.doc_id, t.label, z.z AS score, CAST(z.z > 0 AS INTEGER) AS pred, 1.0 / (1.0 + exp(-z.z)) AS p1
            FROM test t JOIN lz z ON t.doc_id = z.doc_id)"""

LOSS = "(greatest(0.0, score) + ln(exp(-greatest(0.0, score)) + exp(score - greatest(0.0, score))) - CASE WHEN label = 1 THEN score ELSE 0.0 END)"

PURIFY_FROM = """
pt AS (SELECT x.doc_id, x.pos, x.token, coalesce(w.weight, CAST(0 AS DECIMAL(18,6))) AS w, x.token <> '*' AS cand
       FROM (SELECT doc_id, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM {src}) x
       LEFT JOIN weights w ON x.token = w.token),
pf AS (SELECT pt.*, bias.b + sum(w) OVER (PARTITION BY doc_id) AS s0 FROM pt, bias),
pr AS (SELECT *, s0 - coalesce(sum(w) OVER (PARTITION BY doc_id, cand ORDER BY w DESC, pos
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remain FROM pf),
pm AS (SELECT *, cand AND min(remain) OVER (PARTITION BY doc_id, cand ORDER BY w DESC, pos
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > 0 AS masked FROM pr),
pd AS (SELECT doc_id, max(s0) AS s0, count(*) FILTER (WHERE masked) AS n_masked, sum(w) FILTER (WHERE masked) AS mw,
              string_agg(CASE WHEN masked THEN repeat('*', length(regexp_replace(token, '[# ]', '', 'g'))) ELSE token END,
                         ' ' ORDER BY pos) AS mtext
       FROM pm GROUP BY doc_id),
puri AS (SELECT t.doc_id, t.label, t.position, coalesce(pd.s0, bias.b) AS s0, coalesce(pd.n_masked, 0) AS n_masked,
                CASE WHEN coalesce(pd.n_masked, 0) > 0 THEN pd.mtext ELSE t.clean END AS text,
                CAST(coalesce(pd.s0, bias.b) - coalesce(pd.mw, 0) AS DOUBLE) AS final_score
         FROM {src} t LEFT JOIN pd ON t.doc_id = pd.doc_id, bias)"""

PURIFY_SELECT = """SELECT doc_id, label, round(1.0 / (1.0 + exp(CAST(s0 AS DOUBLE))), 6) AS p0,
       round(1.0 / (1.0 + exp(-CAST(s0 AS DOUBLE))), 6) AS p1, CAST(s0 > 0 AS INTEGER) AS pred, text,
       CAST(n_masked AS BIGINT) AS n_masked, final_score FROM puri"""

METRIC_COLS = """tp, fp, fn, tn,
  CASE WHEN tp + fp + fn + tn = 0 THEN 0.0 ELSE CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) END AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1"""

CONFUSION = """count(*) FILTER (WHERE {t} = 1 AND {p} = 1) AS tp, count(*) FILTER (WHERE {t} <> 1 AND {p} = 1) AS fp,
  count(*) FILTER (WHERE {t} = 1 AND {p} <> 1) AS fn, count(*) FILTER (WHERE {t} <> 1 AND {p} <> 1) AS tn"""


FILE_DATASET = f"""
lab AS (SELECT doc_id, CAST(toxic AS INTEGER) AS label, quality AS labeling_confirm, row_number() OVER () AS file_row FROM labels),
fds AS (SELECT doc_id, label, CASE WHEN label = 0 THEN 0 ELSE 1 END AS bucket, file_row FROM lab WHERE {CONFIRMED_WHERE}),
franked AS (SELECT doc_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY file_row) - 1 AS _id,
                   count(*) OVER (PARTITION BY bucket) AS n_c FROM fds),
fsplit AS (SELECT doc_id, bucket, _id, CASE WHEN _id < floor(n_c * 0.75) THEN 'train' ELSE 'test' END AS split FROM franked)"""


def permute_ctes(src: str) -> str:
    """CTEs ending in ``permuted(id, p)`` for ``src(id, place, n)``: the network of ``functions.permute`` round by round, and a
    recursive walk of the places that are not below n."""
    low = (1 << 31) - 1
    steps = ["p // b AS l0", "p % b AS r0"]
    for r, key in enumerate(round_keys(int(SEED))):
        left = r % 2 == 0
        digit, other = ("r", "l") if left else ("l", "r")
        steps += [f"xor({digit}{r} & {low}, {key}) * {MIX[0]} AS x{r}", f"(xor(x{r}, x{r} >> 29) & {low}) * {MIX[1]} AS y{r}",
                  f"({other}{r} + (xor(y{r}, y{r} >> 31) & {low})) % {'a' if left else 'b'} AS {other}{r + 1}",
                  f"{digit}{r} AS {digit}{r + 1}"]
    once = f"SELECT id, n, a, b, l{ROUNDS} * b + r{ROUNDS} AS p FROM (SELECT *, {', '.join(steps)} FROM {{from_}})"
    return f"""
based AS (SELECT id, place AS p, n, CAST(ceil(n / CAST(floor(sqrt(n)) AS DOUBLE)) AS BIGINT) AS a, CAST(floor(sqrt(n)) AS BIGINT) AS b
          FROM {src}),
walk AS ({once.format(from_='based')} UNION ALL {once.format(from_='walk WHERE p >= n')}),
permuted AS (SELECT id, p FROM walk WHERE p < n)"""


VOCAB = """
doc_tok AS (SELECT unnest(tokens) AS token FROM doc_tokens),
doc_counts AS (SELECT token, count(*) AS count FROM doc_tok GROUP BY token),
learned AS (SELECT token, row_number() OVER (ORDER BY count DESC, token) + 4 AS id, count
            FROM doc_counts WHERE token <> '*'),
vocab_all AS (SELECT * FROM (VALUES ('[PAD]', 0, NULL), ('[UNK]', 1, NULL), ('[CLS]', 2, NULL), ('[SEP]', 3, NULL),
                                    ('*', 4, NULL)) v(token, id, count)
              UNION ALL SELECT token, id, count FROM learned)"""


ENCODE = f"""WITH {DOC_TOKENS},{VOCAB},
ex AS (SELECT doc_id, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM doc_tokens),
ids AS (SELECT ex.doc_id, ex.pos, coalesce(v.id, 1) AS id, CAST(floor(ex.pos / 148) AS INTEGER) AS chunk
        FROM ex LEFT JOIN vocab_all v ON ex.token = v.token),
empty AS (SELECT doc_id, 0 AS chunk, [2, 3] AS input_ids FROM doc_tokens WHERE len(tokens) = 0),
enc AS (SELECT doc_id, chunk, list_concat([2], list(id ORDER BY pos), [3]) AS input_ids FROM ids GROUP BY doc_id, chunk
        UNION ALL SELECT * FROM empty)"""


def _dim_cols(n: int, fmt: str) -> str:
    return ", ".join(fmt.format(j=j, j1=j + 1) for j in range(n))


def _attention_ctes() -> str:
    return """
emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT label, min(vec_id) AS query_id, arg_min(v, vec_id) AS qv FROM emb GROUP BY label),
k AS (SELECT e.label, e.vec_id, q.query_id, e.v, q.qv, h.head FROM emb e JOIN q ON e.label = q.label,
      (SELECT unnest(range(4)) AS head) h WHERE e.vec_id <> q.query_id),
s AS (SELECT label, CAST(head AS INTEGER) AS head, vec_id, query_id, v,
             list_sum(list_transform(range(16), lambda j: qv[head * 16 + j + 1] * v[head * 16 + j + 1])) / sqrt(16) AS score
      FROM k),
m AS (SELECT label, head, max(score) AS mx FROM s GROUP BY label, head),
e AS (SELECT s.*, exp(s.score - m.mx) AS ex FROM s JOIN m ON s.label = m.label AND s.head = m.head),
z AS (SELECT label, head, sum(ex) AS zs FROM e GROUP BY label, head)"""


def _pool_ctes() -> str:
    sums = _dim_cols(16, "sum(e.ex * e.v[e.head * 16 + {j1}]) AS s{j}")
    arr = ", ".join(f"tanh(s{j} / zs)" for j in range(16))
    return _attention_ctes() + f""",
pool_sums AS (SELECT e.label, e.head, {sums} FROM e GROUP BY e.label, e.head),
pooled AS (SELECT p.label, p.head, [{arr}] AS vals FROM pool_sums p JOIN z ON p.label = z.label AND p.head = z.head),
pooled_rows AS (SELECT label, CAST(head * 16 + unnest(range(16)) AS INTEGER) AS dim, unnest(vals) AS value FROM pooled)"""


def oracle_sql() -> dict[str, str]:
    p = _pats()
    W = p["W"]
    pages_path = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"
    base_url = "regexp_extract(url, '^[^?#]*', 0)"

    def ext(path: str, dot: bool = True, lower: bool = True) -> str:
        e = f"regexp_extract(regexp_extract({path}, '[^/]*$', 0), '{K.EXTENSION_PATTERN}', 1)"
        if not dot:
            e = f"regexp_replace({e}, '^\\.', '')"
        return f"lower({e})" if lower else e

    def url_key(url: str, etag: str | None = None) -> str:
        k = f"sha256({url})"
        if etag is None:
            return k
        return f"CASE WHEN {etag} IS NULL OR {etag} = '' THEN {k} ELSE {k} || '.' || sha256({etag}) END"

    def scheme(u: str) -> str:
        return f"lower(regexp_extract({u}, '{K.SCHEME_PATTERN}', 1))"

    def route(u: str) -> str:
        s = scheme(u)
        return f"CASE WHEN {s} IN ('http', 'https', 's3') THEN 'remote' WHEN {s} = '' THEN 'local' ELSE 'error' END"

    obj_key = f"regexp_replace({pages_path}, '^/', '')"
    entries = f"SELECT page_id, {base_url} AS url, md5(html) AS etag FROM pages"
    meta = f"SELECT DISTINCT {url_key('url', 'etag')} AS key, url, etag FROM ({entries})"
    requested = (f"SELECT DISTINCT key FROM (SELECT {url_key(base_url, 'md5(html)')} AS key FROM pages "
                 f"UNION ALL SELECT {url_key('url')} AS key FROM pages)")

    q: dict[str, str] = {}
    q["scan_posts"] = POSTS_ALL
    q["exported_posts"] = f"SELECT doc_id, string, label, labeling_confirm FROM ({POSTS_ALL}) WHERE label <> -1 AND labeling_confirm <> 0"
    q["progress_counts"] = f"""SELECT count(*) FILTER (WHERE label <> -1) AS kept_all,
        count(*) FILTER (WHERE {CONFIRMED_WHERE}) AS kept_confirmed, count(*) AS seen FROM ({POSTS_ALL})"""
    q["dataset_csv_roundtrip"] = f"""SELECT row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS _id, document, label
        FROM (SELECT doc_id, string AS document, CAST(label AS INTEGER) AS label,
                     CASE WHEN label = 0 THEN 0 ELSE 1 END AS bucket FROM ({POSTS}) WHERE {CONFIRMED_WHERE})"""
    q["dataset_tsv_roundtrip"] = f"""WITH {DATASET.strip()}
        SELECT t.position AS _id, d.text AS document, t.label FROM test t JOIN documents d ON t.doc_id = d.doc_id"""
    q["dataset_csv_split"] = q["dataset_csv_roundtrip"]
    q["line_set"] = f"""SELECT DISTINCT regexp_replace(line, '[{T.UNICODE_WHITESPACE_CLASS}]+\\z', '', 'g') AS item
        FROM (SELECT unnest(string_split_regex(regexp_replace(text, '(\\r\\n|\\r|\\n)\\z', ''), '\\r\\n|\\r|\\n')) AS line
              FROM documents WHERE text <> '')"""
    q["report_head"] = f"""{BASE},
        head AS (SELECT * FROM test ORDER BY position LIMIT 100),
        head_tok AS (SELECT h.doc_id, h.label, h.position, dt.clean, dt.tokens FROM head h JOIN doc_tokens dt ON h.doc_id = dt.doc_id),
        {PURIFY_FROM.format(src='head_tok').strip()}
        SELECT position, doc_id, printf('label: %d,\tpred: %d,\tprobability: %.2f\t%.2f', label, CAST(s0 > 0 AS INTEGER),
               1.0 / (1.0 + exp(CAST(s0 AS DOUBLE))), 1.0 / (1.0 + exp(-CAST(s0 AS DOUBLE)))) AS report FROM puri"""
    q["drop_unlabelled"] = f"SELECT doc_id, label FROM ({POSTS_ALL}) WHERE label <> -1"
    q["confirmed_only"] = f"SELECT doc_id, label, labeling_confirm FROM ({POSTS_ALL}) WHERE {CONFIRMED_WHERE}"
    q["project_dataset"] = f"SELECT doc_id, string AS document, CAST(label AS INTEGER) AS label FROM ({POSTS}) WHERE {CONFIRMED_WHERE}"
    q["class_bucket"] = f"SELECT doc_id, label, CASE WHEN label = 0 THEN 0 ELSE 1 END AS bucket FROM ({POSTS}) WHERE {CONFIRMED_WHERE}"
    q["with_index"] = f"""SELECT doc_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS _id
        FROM (SELECT doc_id, CASE WHEN label = 0 THEN 0 ELSE 1 END AS bucket FROM ({POSTS}) WHERE {CONFIRMED_WHERE})"""
    q["null_as_text"] = "SELECT doc_id, coalesce(text, 'nan') AS text FROM documents"
    lex = "['idiot', 'moron', 'pathetic', 'scum', 'trash', 'worthless']"
    conf_posts = f"SELECT * FROM ({POSTS}) WHERE {CONFIRMED_WHERE}"
    q["lexicon_label"] = f"""WITH {clean_ctes('c', f'({conf_posts})', 'doc_id, label', 'string')}
        SELECT doc_id, label, CAST(list_has_any({tokens_expr()}, {lex}) AS INTEGER) AS lexicon_label FROM c"""
    q["lexicon_metrics"] = f"""WITH {clean_ctes('c', f'({conf_posts})', 'doc_id, label', 'string')},
        lab AS (SELECT label, CAST(list_has_any({tokens_expr()}, {lex}) AS INTEGER) AS pred FROM c),
        cm AS (SELECT {CONFUSION.format(t='label', p='pred')} FROM lab)
        SELECT {METRIC_COLS} FROM cm"""
    q["random_split"] = f"""SELECT doc_id, label, CASE WHEN rk < floor(n * 0.75) THEN 'train' ELSE 'test' END AS split
        FROM (SELECT doc_id, label, row_number() OVER (ORDER BY {shuffle_key('doc_id')}, doc_id) - 1 AS rk, count(*) OVER () AS n
              FROM ({POSTS_ALL}) WHERE label <> -1)"""
    q["stratified_split"] = f"WITH {DATASET.strip()} SELECT doc_id, bucket, _id, split FROM split"
    q["oversample"] = f"WITH {DATASET.strip()} SELECT doc_id, bucket, _id, copy FROM train WHERE bucket = 1"
    q["balanced_train"] = f"WITH {DATASET.strip()} SELECT doc_id, bucket, copy FROM train"
    q["shuffle_rows"] = f"WITH {DATASET.strip()} SELECT doc_id, bucket, copy, position FROM train"
    q["split_summary"] = f"""WITH {DATASET.strip()}
        SELECT 'all' AS split, bucket, count(*) AS n FROM split GROUP BY bucket
        UNION ALL SELECT split, bucket, count(*) AS n FROM split GROUP BY split, bucket
        UNION ALL SELECT 'train_balanced' AS split, bucket, count(*) AS n FROM train GROUP BY bucket
        UNION ALL SELECT 'kept', NULL, count(*) FROM documents d JOIN labels l ON d.doc_id = l.doc_id
                  WHERE coalesce(l.quality <> 0, true) AND l.toxic <> -1
        UNION ALL SELECT 'seen', NULL, count(*) FROM documents"""
    q["split_summary_observed"] = q["split_summary"]
    q["lexicon_file"] = q["lexicon_label"]
    q["exact_rank"] = """SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS rank
        FROM documents"""
    q["with_index_file_order"] = f"WITH {FILE_DATASET.strip()} SELECT doc_id, bucket, _id FROM fsplit"
    q["stratified_split_file_order"] = f"WITH {FILE_DATASET.strip()} SELECT doc_id, bucket, _id, split FROM fsplit"
    q["random_split_permuted"] = f"""WITH RECURSIVE lab AS (
            SELECT doc_id, CAST(toxic AS INTEGER) AS label, row_number() OVER () AS file_row FROM labels WHERE toxic <> -1),
        src AS (SELECT doc_id AS id, row_number() OVER (ORDER BY file_row) - 1 AS place, count(*) OVER () AS n FROM lab),
        {permute_ctes('src').strip()}
        SELECT lab.doc_id, label, p AS position,
               CASE WHEN p < floor((SELECT count(*) FROM lab) * 0.75) THEN 'train' ELSE 'test' END AS split
        FROM lab JOIN permuted ON lab.doc_id = permuted.id"""
    q["shuffle_permuted"] = f"""WITH RECURSIVE {FILE_DATASET.strip()},
        ftr AS (SELECT * FROM fsplit WHERE split = 'train'),
        fcnt AS (SELECT count(*) FILTER (WHERE bucket = 0) AS n0, count(*) FILTER (WHERE bucket = 1) AS n1 FROM ftr),
        fover AS (SELECT doc_id, bucket, _id, unnest(range(n0 // n1 + 1)) AS copy, n0, n1 FROM ftr, fcnt WHERE bucket = 1),
        fbal AS (SELECT doc_id, bucket, 0 AS copy, _id AS place, 2 * n0 AS n FROM ftr, fcnt WHERE bucket = 0
                 UNION ALL SELECT doc_id, bucket, CAST(copy AS INTEGER), n0 + copy * n1 + _id, 2 * n0 FROM fover WHERE copy * n1 + _id < n0),
        src AS (SELECT place AS id, place, n FROM fbal),
        {permute_ctes('src').strip()}
        SELECT doc_id, bucket, copy, p AS position FROM fbal JOIN permuted ON fbal.place = permuted.id"""
    q["allowlist_chars"] = f"SELECT doc_id, regexp_replace(text, '{p['NK']}', ' ', 'g') AS text FROM documents"
    q["strip_urls"] = f"SELECT page_id, regexp_replace('see ' || url || ' end', '{p['URL']}', '', 'g') AS text FROM pages"
    q["trim_text"] = f"SELECT conv_id, turn, {trim_sql("' ' || chr(9) || text || chr(10) || ' '")} AS text FROM conversations"
    q["collapse_repeats"] = f"WITH {collapse_ctes('cr', 'documents', 'doc_id', 'text')} SELECT doc_id, clean AS text FROM cr"
    q["clean_text"] = f"WITH {clean_ctes('c', 'documents', 'doc_id', 'text')} SELECT doc_id, clean AS text FROM c"
    q["clean_conversations"] = f"WITH {clean_ctes('c', 'conversations', 'conv_id, turn', 'text')} SELECT conv_id, turn, clean AS text FROM c"
    q["tokenize"] = f"""WITH {DOC_TOKENS}
        SELECT doc_id, CAST(unnest(range(len(tokens))) AS BIGINT) AS pos, unnest(tokens) AS token FROM doc_tokens"""
    q["build_vocab"] = f"WITH {DOC_TOKENS},{VOCAB} SELECT token, id, count FROM vocab_all"
    q["encode"] = f"""{ENCODE}
        SELECT doc_id, chunk, len(input_ids) AS n_ids, array_to_string(input_ids, ' ') AS input_ids FROM enc"""
    q["model_inputs"] = f"""{ENCODE},
        padded AS (SELECT doc_id, chunk, list_concat(input_ids, list_transform(range(150 - len(input_ids)), lambda x: 0)) AS ids FROM enc)
        SELECT doc_id, chunk, array_to_string(ids, ' ') AS input_ids,
               array_to_string(list_transform(ids, lambda x: 0), ' ') AS token_type_ids,
               array_to_string(list_transform(ids, lambda x: CASE WHEN x = 0 THEN 0 ELSE 1 END), ' ') AS attention_mask
        FROM padded"""
    q["decode"] = f"""{ENCODE},
        dex AS (SELECT doc_id, chunk, unnest(range(len(input_ids))) AS i, unnest(input_ids) AS id FROM enc),
        dj AS (SELECT dex.doc_id, dex.chunk, dex.i, v.token FROM dex LEFT JOIN vocab_all v ON dex.id = v.id AND v.id >= 4)
        SELECT doc_id, chunk, coalesce(string_agg(token, ' ' ORDER BY i) FILTER (WHERE token IS NOT NULL), '') AS text
        FROM dj GROUP BY doc_id, chunk"""
    q["mask_token"] = f"""WITH {DOC_TOKENS}
        SELECT token, repeat('*', length(regexp_replace(token, '[# ]', '', 'g'))) AS masked
        FROM (SELECT DISTINCT unnest(tokens) AS token FROM doc_tokens)"""
    q["fit_scorer"] = f"{BASE} SELECT token, CAST(weight AS DOUBLE) AS weight, c0, c1 FROM weights"
    q["score"] = f"""{BASE},{TEST_SCORED}
        SELECT doc_id, label, score, pred, round(p0, 6) AS p0, round(p1, 6) AS p1 FROM scored2"""
    q["attribute"] = f"""{BASE},{TEST_SCORED},
        atw AS (SELECT x.doc_id, x.pos, x.token, CAST(coalesce(w.weight, 0) AS DOUBLE) AS weight
               FROM (SELECT doc_id, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM test_tok) x
               LEFT JOIN weights w ON x.token = w.token),
        am AS (SELECT *, exp(weight - max(weight) OVER (PARTITION BY doc_id)) AS e FROM atw)
        SELECT doc_id, CAST(pos AS BIGINT) AS pos, token, weight, round(e / sum(e) OVER (PARTITION BY doc_id), 6) AS prob FROM am"""
    q["purify"] = f"""{BASE},{TEST_SCORED},{PURIFY_FROM.format(src='test_tok')}
        {PURIFY_SELECT}"""
    q["purify_file"] = f"""{BASE},
        file_tok AS (SELECT s.doc_id, s.label, s._id AS position, dt.clean, dt.tokens
                     FROM split s JOIN doc_tokens dt ON s.doc_id = dt.doc_id),
        {PURIFY_FROM.format(src='file_tok').strip()}
        {PURIFY_SELECT.replace('SELECT doc_id, label', 'SELECT position AS _id, label')}"""
    logistic = f"WITH {DOC_TOKENS},\n{DATASET},\n{logistic_ctes().strip()}"
    q["fit_logistic"] = f"{logistic} SELECT token, round(weight, 6) AS weight, frequency FROM w{STEPS}"
    q["score_logistic"] = f"""{logistic},{LOGISTIC_TEST}
        SELECT doc_id, label, round(score, 6) AS score, pred, round(p1, 6) AS p1 FROM lscored"""
    q["logistic_metrics"] = f"""{logistic},{LOGISTIC_TEST},
        cm AS (SELECT {CONFUSION.format(t='label', p='pred')} FROM lscored)
        SELECT {METRIC_COLS} FROM cm"""
    q["cross_entropy"] = f"{BASE},{TEST_SCORED} SELECT doc_id, label, round({LOSS}, 6) AS loss FROM scored2"
    q["binary_metrics"] = f"""{BASE},{TEST_SCORED},
        cm AS (SELECT {CONFUSION.format(t='label', p='pred')} FROM scored2)
        SELECT {METRIC_COLS} FROM cm"""
    train_scored = """
        train_docs AS (SELECT DISTINCT doc_id FROM train),
        train_tw AS (SELECT dt.doc_id, unnest(dt.tokens) AS token FROM doc_tokens dt JOIN train_docs td ON dt.doc_id = td.doc_id),
        train_sums AS (SELECT x.doc_id, sum(coalesce(w.weight, 0)) AS s FROM train_tw x LEFT JOIN weights w ON x.token = w.token
                       GROUP BY x.doc_id),
        tscored AS (SELECT t.doc_id, t.label, t.position, CAST(bias.b + coalesce(s.s, 0) AS DECIMAL(30,6)) AS sdec
                    FROM train t LEFT JOIN train_sums s ON t.doc_id = s.doc_id, bias),
        tscored2 AS (SELECT doc_id, label, position, CAST(sdec AS DOUBLE) AS score, CAST(sdec > 0 AS INTEGER) AS pred
                     FROM tscored)"""
    q["batch_metrics"] = f"""{BASE},{train_scored},
        b AS (SELECT CAST(floor(position / 16) AS BIGINT) AS batch_id, label, pred, {LOSS} AS loss FROM tscored2),
        cm AS (SELECT batch_id, count(*) AS n, {CONFUSION.format(t='label', p='pred')}, avg(loss) AS loss FROM b GROUP BY batch_id)
        SELECT batch_id, n, tp, fp, fn, tn,
               round(CASE WHEN n = 0 THEN 0.0 ELSE CAST(tp + tn AS DOUBLE) / n END, 6) AS accuracy,
               round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision,
               round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall,
               round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 6) AS f1,
               round(loss, 6) AS loss
        FROM cm WHERE batch_id % 10 = 0"""
    q["epoch_loss"] = f"""{BASE},{TEST_SCORED},
        b AS (SELECT floor(position / 16) AS batch_id, avg({LOSS}) AS bl FROM scored2 GROUP BY 1)
        SELECT round(avg(bl), 6) AS epoch_loss, count(*) AS n_batches FROM b"""
    q["attention_scores"] = f"""WITH {_attention_ctes().strip()}
        SELECT e.label, e.head, e.vec_id, e.query_id, round(e.score, 6) AS score, round(e.ex / z.zs, 6) AS prob
        FROM e JOIN z ON e.label = z.label AND e.head = z.head"""
    moments = _dim_cols(64, "avg(x * v[{j1}])")
    q["attribute_attention"] = f"""WITH emb AS (SELECT vec_id, label, vec_id // 16 AS doc_id, vec_id % 16 AS pos, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        xs AS (SELECT *, unnest(range(16)) AS place, unnest(v[1:16]) AS x FROM emb),
        mq AS (SELECT place, [{moments}] AS w, avg(x) AS b FROM xs GROUP BY place),
        mk AS (SELECT place, [{moments}] AS w, avg(x) AS b FROM xs WHERE label % 2 = 0 GROUP BY place),
        wq AS (SELECT list(w ORDER BY place) AS w, list(b ORDER BY place) AS b FROM mq),
        wk AS (SELECT list(w ORDER BY place) AS w, list(b ORDER BY place) AS b FROM mk),
        pr AS (SELECT doc_id, pos, list_transform(range(16), lambda i: list_inner_product(wq.w[i + 1], v) + wq.b[i + 1]) AS q,
                      list_transform(range(16), lambda i: list_inner_product(wk.w[i + 1], v) + wk.b[i + 1]) AS k FROM emb, wq, wk),
        f AS (SELECT doc_id, min(pos) AS first, arg_min(q, pos) AS q FROM pr GROUP BY doc_id),
        s AS (SELECT pr.doc_id, pr.pos, list_inner_product(f.q, pr.k) / sqrt(16) AS score FROM pr JOIN f ON pr.doc_id = f.doc_id WHERE pr.pos <> f.first),
        e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM s),
        p AS (SELECT doc_id, pos, score, e / sum(e) OVER (PARTITION BY doc_id) AS prob FROM e)
        SELECT doc_id, pos, round(score, 6) AS score, round(prob, 6) AS prob,
               CAST(row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, pos) - 1 AS INTEGER) AS place FROM p"""
    q["attention_pool"] = f"WITH {_pool_ctes().strip()} SELECT label, dim, round(value, 6) AS value FROM pooled_rows"
    q["split_heads"] = """WITH h AS (SELECT vec_id, CAST(head AS INTEGER) AS head,
              list_transform(range(16), lambda j: CAST(embedding[head * 16 + j + 1] AS DOUBLE)) AS hv
              FROM embeddings, (SELECT unnest(range(4)) AS head))
        SELECT vec_id, head, round(list_sum(hv), 6) AS head_sum,
               round(sqrt(list_sum(list_transform(hv, lambda x: x * x))), 6) AS head_norm FROM h"""
    sums64 = _dim_cols(64, "sum(CAST(embedding[{j1}] AS DOUBLE)) AS s{j}")
    arr64 = ", ".join(f"s{j}" for j in range(64))
    q["combine_layers"] = f"""WITH g AS (SELECT label, count(*) AS n, {sums64} FROM embeddings GROUP BY label),
        a AS (SELECT label, n, [{arr64}] AS v FROM g),
        st AS (SELECT label, n, v, list_sum(v) / len(v) AS mu FROM a),
        st2 AS (SELECT label, n, v, mu, list_sum(list_transform(v, lambda x: (x - mu) * (x - mu))) / len(v) AS var FROM st),
        c AS (SELECT label, n, CASE WHEN n > 1 THEN list_transform(v, lambda x: (x - mu) / sqrt(var + 1e-12)) ELSE v END AS cv FROM st2)
        SELECT label, n, CAST(unnest(range(64)) AS INTEGER) AS dim, round(unnest(cv), 6) AS value FROM c"""
    means = _dim_cols(64, "avg(CAST(embedding[{j1}] AS DOUBLE))")
    q["linear_head"] = f"""WITH {_pool_ctes().strip()},
        pv AS (SELECT label, list(value ORDER BY dim) AS pv FROM pooled_rows GROUP BY label),
        head AS (SELECT label AS class, [{means}] AS w, row_number() OVER (ORDER BY label) - 1 AS place
                 FROM embeddings GROUP BY label),
        lg AS (SELECT pv.label, head.class, head.place, list_sum(list_transform(range(64), lambda j: pv[j + 1] * w[j + 1]))
                      - 0.5 * list_sum(list_transform(w, lambda x: x * x)) AS z FROM pv, head)
        SELECT label, first_value(class) OVER (PARTITION BY label ORDER BY z DESC, class) AS pred, place, round(z, 6) AS z FROM lg"""
    q["url_key"] = f"SELECT page_id, {url_key('url')} AS url_key, {url_key('url', 'md5(html)')} AS cache_key FROM pages"
    q["key_lookup"] = f"SELECT r.key, m.url, m.etag FROM ({requested}) r JOIN ({meta}) m ON r.key = m.key"
    q["missing_keys"] = f"SELECT r.key FROM ({requested}) r WHERE NOT EXISTS (SELECT 1 FROM ({meta}) m WHERE m.key = r.key)"
    q["latest_version"] = f"""WITH site AS (SELECT regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS url,
              CASE WHEN contains(url, '?') THEN md5(html) END AS etag FROM pages),
        e AS (SELECT sha256(url) AS url_key, url, etag, {url_key('url', 'etag')} AS fn FROM site),
        r AS (SELECT *, count(*) OVER (PARTITION BY url_key) AS n_variants,
                     row_number() OVER (PARTITION BY url_key ORDER BY etag IS NULL DESC, fn DESC) AS k FROM e)
        SELECT url_key, url, fn AS file_name, etag, n_variants FROM r WHERE k = 1"""
    q["cache_lookup"] = f"""SELECT r.key, m.url, m.etag, m.length FROM ({requested}) r JOIN (
        SELECT DISTINCT {url_key('url', 'etag')} AS key, url, etag, octet_length(encode(html)) AS length
        FROM (SELECT {base_url} AS url, md5(html) AS etag, html FROM pages)) m ON r.key = m.key"""
    q["latest_cached"] = f"""WITH site AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS url,
              CASE WHEN contains(url, '?') THEN md5(html) END AS etag FROM pages),
        r AS (SELECT url, sha256(url) AS url_key, {url_key('url', 'etag')} AS file_name, count(*) OVER (PARTITION BY url) AS n_variants,
                     row_number() OVER (PARTITION BY url ORDER BY etag IS NULL DESC, {url_key('url', 'etag')} DESC) AS k FROM site)
        SELECT url, url_key, file_name, n_variants FROM r WHERE k = 1"""
    q["route_uri"] = f"""SELECT page_id, {scheme('url')} AS scheme, {route('url')} AS route, {route(obj_key)} AS path_route,
        {route("'ftp://' || " + obj_key)} AS ftp_route FROM pages"""
    q["split_object_path"] = f"""SELECT page_id, regexp_extract(url, '{K.NETLOC_PATTERN}', 1) AS bucket, {obj_key} AS key,
        CAST(regexp_extract(url, '{K.NETLOC_PATTERN}', 1) <> '' AND {pages_path} <> '' AS INTEGER) AS valid FROM pages"""
    q["file_extension"] = f"""SELECT page_id, {ext(pages_path)} AS ext, {ext(pages_path, dot=False)} AS ext_nodot,
        {ext('upper(' + pages_path + ')', lower=False)} AS ext_upper FROM pages"""
    q["stream_moderate"] = q["purify"]
    q["purify_loop"] = q["purify"]
    q["stream_moderate_direct"] = q["purify"]
    q["stream_progress"] = """SELECT CAST(coalesce(l.toxic, -1) AS INTEGER) AS label, count(*) AS seen,
        count(*) FILTER (WHERE coalesce(l.quality, 0) <> 0 AND coalesce(l.toxic, -1) <> -1) AS kept
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"""
    q["batch_scorer"] = f"{BASE},{TEST_SCORED} SELECT doc_id, score, pred FROM scored2"
    del W
    return q
