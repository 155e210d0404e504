"""DuckDB SQL twins of the registered queries (the correctness oracle).

The views derived from the provided tables are spelled once here as CTEs and
composed per query. Floats are rounded to 6 places in both the Spark query and
the SQL; ids are the last sort key wherever an order matters.
"""

from __future__ import annotations


def tokens(x: str) -> str:
    return (r"list_filter(string_split_regex(lower(strip_accents(regexp_replace("
            + x + r", '\p{Mn}', '', 'g'))), '[^\p{L}\p{N}\p{Co}]+'), lambda t: t <> '')")


def words(x: str) -> str:
    return r"list_filter(regexp_split_to_array(" + x + r", '\W'), lambda w: w <> '')"


CORPUS = """corpus AS (
  SELECT doc_id AS page, source,
         'https://' || source || '.example.com/' || lang || '/' || CAST(doc_id AS VARCHAR) AS url,
         substr(text, 1, 80) AS title, substr(text, 81, 160) AS description, text AS content,
         CAST(doc_id % 5 AS INTEGER) AS depth,
         CAST(CASE WHEN doc_id % 17 = 0 THEN 3 WHEN doc_id % 23 = 0 THEN 4 ELSE 2 END AS TINYINT) AS status,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS BIGINT)) AS crawled_at
  FROM documents)"""

COLTEXT = """coltext AS (
  SELECT page, 0 AS col, url AS text FROM corpus UNION ALL
  SELECT page, 1 AS col, title AS text FROM corpus UNION ALL
  SELECT page, 2 AS col, description AS text FROM corpus UNION ALL
  SELECT page, 3 AS col, content AS text FROM corpus)"""

POSITIONS = f"""coltoks AS (SELECT page, col, {tokens('text')} AS toks FROM coltext),
positions AS (
  SELECT page, col, unnest(toks) AS term, unnest(generate_series(0, len(toks) - 1)) AS pos
  FROM coltoks),
postings AS (SELECT term, page, col, count(*) AS tf FROM positions GROUP BY term, page, col),
doc_len AS (SELECT page, sum(len(toks)) AS dl FROM coltoks GROUP BY page),
stats AS (SELECT count(*) AS n_docs, sum(dl) / count(*) AS avgdl FROM doc_len),
vocab_terms AS (SELECT DISTINCT term FROM postings)"""

INDEX = ",\n".join([CORPUS, COLTEXT, POSITIONS])


def search_ctes(queries_sql: str) -> str:
    """CTEs computing ``matches(query_id, page, rank, score)`` for a query table."""
    return f"""{INDEX},
queries AS ({queries_sql}),
qwords AS (
  SELECT query_id, unnest(w) AS word, unnest(generate_series(0, len(w) - 1)) AS phrase_no
  FROM (SELECT query_id, {words('q')} AS w FROM queries)),
qphr AS (
  SELECT query_id, phrase_no, toks,
         max(phrase_no) OVER (PARTITION BY query_id) AS last_phrase,
         count(*) OVER (PARTITION BY query_id) AS n_phrases
  FROM (SELECT query_id, phrase_no, {tokens('word')} AS toks FROM qwords) WHERE len(toks) > 0),
qtok AS (
  SELECT query_id, phrase_no, n_phrases, len(toks) AS n_tok, unnest(toks) AS tok,
         unnest(generate_series(0, len(toks) - 1)) AS tok_idx, last_phrase
  FROM qphr),
qtok2 AS (
  SELECT query_id, phrase_no, n_phrases, n_tok, tok, tok_idx,
         (phrase_no = last_phrase AND tok_idx = n_tok - 1) AS is_prefix FROM qtok),
qterm AS (
  SELECT query_id, phrase_no, n_tok, tok_idx, tok AS term FROM qtok2 WHERE NOT is_prefix
  UNION ALL
  SELECT q.query_id, q.phrase_no, q.n_tok, q.tok_idx, v.term
  FROM qtok2 q JOIN vocab_terms v ON starts_with(v.term, q.tok) WHERE q.is_prefix),
hits1 AS (
  SELECT t.query_id, t.phrase_no, p.page, p.col, sum(p.tf) AS hits
  FROM qterm t JOIN postings p ON p.term = t.term WHERE t.n_tok = 1
  GROUP BY t.query_id, t.phrase_no, p.page, p.col),
cand AS (
  SELECT t.query_id, t.phrase_no, p.page, p.col
  FROM qterm t JOIN postings p ON p.term = t.term WHERE t.n_tok > 1
  GROUP BY t.query_id, t.phrase_no, t.n_tok, p.page, p.col
  HAVING count(DISTINCT t.tok_idx) = t.n_tok),
occ AS (
  SELECT t.query_id, t.phrase_no, c.page, c.col, x.pos - t.tok_idx AS start
  FROM qterm t JOIN cand c ON c.query_id = t.query_id AND c.phrase_no = t.phrase_no
  JOIN positions x ON x.term = t.term AND x.page = c.page AND x.col = c.col
  WHERE t.n_tok > 1
  GROUP BY t.query_id, t.phrase_no, t.n_tok, c.page, c.col, x.pos - t.tok_idx
  HAVING count(DISTINCT t.tok_idx) = t.n_tok),
hits AS (
  SELECT * FROM hits1 UNION ALL
  SELECT query_id, phrase_no, page, col, count(*) AS hits FROM occ
  GROUP BY query_id, phrase_no, page, col),
per_phrase AS (
  SELECT query_id, phrase_no, page, sum(hits * 1.0) AS f1,
         sum(CASE col WHEN 0 THEN hits * 1.0 WHEN 1 THEN hits * 3.0 WHEN 2 THEN hits * 0.8
                      ELSE hits * 1.0 END) AS fw
  FROM hits GROUP BY query_id, phrase_no, page),
n_hit AS (
  SELECT query_id, phrase_no,
         CASE WHEN ln(((SELECT n_docs FROM stats) - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6
              ELSE ln(((SELECT n_docs FROM stats) - count(*) + 0.5) / (count(*) + 0.5)) END AS idf
  FROM per_phrase GROUP BY query_id, phrase_no),
nphr AS (SELECT DISTINCT query_id, n_phrases FROM qphr),
matched AS (
  SELECT pp.query_id, pp.page FROM per_phrase pp JOIN nphr USING (query_id)
  GROUP BY pp.query_id, pp.page, nphr.n_phrases HAVING count(*) = nphr.n_phrases),
contrib AS (
  SELECT pp.query_id, pp.page,
    n.idf * pp.f1 * 2.2 / (pp.f1 + 1.2 * (1 - 0.75 + 0.75 * d.dl / (SELECT avgdl FROM stats))) AS c1,
    n.idf * pp.fw * 2.2 / (pp.fw + 1.2 * (1 - 0.75 + 0.75 * d.dl / (SELECT avgdl FROM stats))) AS cw
  FROM per_phrase pp
  JOIN matched m ON m.query_id = pp.query_id AND m.page = pp.page
  JOIN n_hit n ON n.query_id = pp.query_id AND n.phrase_no = pp.phrase_no
  JOIN doc_len d ON d.page = pp.page),
all_matches AS (
  SELECT query_id, page, -sum(c1) AS rank, -sum(cw) AS score FROM contrib GROUP BY query_id, page),
matches AS (
  SELECT m.* FROM all_matches m JOIN corpus c ON c.page = m.page WHERE c.status = 2)"""


def search_page_sql(queries_sql: str, page: int = 1, size: int = 10) -> str:
    lo, hi = (page - 1) * size, page * size
    return f"""WITH {search_ctes(queries_sql)},
totals AS (SELECT query_id, count(*) AS total,
                  CAST(greatest(1, ceil(count(*) / {size})) AS BIGINT) AS page_count
           FROM matches GROUP BY query_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), page) AS rn
           FROM matches)
SELECT r.query_id, r.rn, r.page, c.url, round(r.rank, 6) AS rank, round(r.score, 6) AS score,
       t.total, t.page_count
FROM ranked r JOIN totals t USING (query_id) JOIN corpus c ON c.page = r.page
WHERE r.rn > {lo} AND r.rn <= {hi}"""


QUERY_TEXTS = "SELECT item_id AS query_id, text AS q FROM benchmark"
WORD_QUERIES = ("SELECT q AS query_id, q FROM (SELECT DISTINCT unnest("
                + words("text") + ") AS q FROM benchmark)")
PHRASE_QUERIES = r"SELECT item_id AS query_id, regexp_replace(text, '\W+', '_', 'g') AS q FROM benchmark"


CHUNKS = """chunks AS (
  SELECT e.vec_id AS id, e.vec_id // 4 AS page, CAST(e.vec_id % 4 AS INTEGER) AS chunk_index,
         c.source, c.status, e.embedding,
         substr(c.content, CAST(e.vec_id % 4 AS INTEGER) * CAST(ceil(length(c.content) / 4) AS INTEGER) + 1,
                CAST(ceil(length(c.content) / 4) AS INTEGER)) AS chunk
  FROM embeddings e JOIN corpus c ON c.page = e.vec_id // 4)"""

QVEC_SELECT = """SELECT vec_id // 100 AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0"""

QVEC = f"qvec AS ({QVEC_SELECT})"

# a query for every two vectors 2i and 2i + 1, their mean (one without the other is the query itself)
PAIR_QVEC = """qvec AS (
  SELECT coalesce(a.vec_id, b.vec_id) // 2 AS query_id,
         CASE WHEN b.vec_id IS NULL THEN a.embedding WHEN a.vec_id IS NULL THEN b.embedding
              ELSE CAST(list_transform(list_zip(a.embedding, b.embedding),
                        lambda p: (CAST(p[1] AS DOUBLE) + CAST(p[2] AS DOUBLE)) / 2) AS FLOAT[]) END AS embedding
  FROM (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 2 = 0) a
  FULL OUTER JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 2 = 1) b ON b.vec_id = a.vec_id + 1)"""


def cosine(a: str, b: str) -> str:
    da, db = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    return (f"round(1 - list_dot_product({da}, {db}) / (sqrt(list_dot_product({da}, {da}))"
            f" * sqrt(list_dot_product({db}, {db}))), 12) + 0.0")


DIST = f"""dist AS (
  SELECT q.query_id, c.id, c.page, c.source, c.chunk, {cosine('c.embedding', 'q.embedding')} AS distance
  FROM qvec q CROSS JOIN chunks c)"""

VEC_BASE = ",\n".join([CORPUS, CHUNKS, QVEC, DIST])
PAIR_BASE = ",\n".join([CORPUS, CHUNKS, PAIR_QVEC, DIST])

NEAR_BY_SOURCE = """near AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY distance, id) AS rn
                 FROM dist) WHERE rn <= 10)"""

BEST_CHUNK = """best AS (
  SELECT query_id, source, page, min(distance) AS distance, arg_min(chunk, (distance, id)) AS chunk
  FROM near GROUP BY query_id, source, page),
ranked_best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY distance, page) AS rank_number
  FROM best)"""


def doc_url(src: str = "d.source", lang: str = "d.lang", doc: str = "d.doc_id") -> str:
    return f"('https://' || {src} || '.example.com/' || {lang} || '/' || CAST({doc} AS VARCHAR))"


def http(u: str) -> str:
    return f"replace({u}, 'https://', 'http://')"


UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
LOWER = "'abcdefghijklmnopqrstuvwxyz'"


def url_key(u: str) -> str:
    return f"translate({u}, {UPPER}, {LOWER})"


ALIASES = f"""aliases AS (
  SELECT source, {http('url')} AS url, url AS canonical, crawled_at FROM corpus WHERE page % 4 = 0)"""

SOURCES = """sources AS (
  SELECT source AS id, 'https://' || source || '.example.com/' AS url,
         [source || '.example.com'] AS allowed_domains, 3 AS max_depth, 2000 AS size_limit,
         5 AS speed, 30 AS min_age
  FROM (SELECT DISTINCT source FROM documents))"""

TITLE = r"regexp_extract(html, '<title[^>]*>(.*?)</title>', 1)"

RECRAWL = f"""lab AS (SELECT * FROM labels JOIN documents d USING (doc_id)),
batch AS (
  SELECT source, CASE WHEN quality = 0 THEN {doc_url('upper(source)', 'lang', 'doc_id')}
                      ELSE {doc_url('source', 'lang', 'doc_id')} END AS url,
         CAST(2 AS TINYINT) AS status, substr(text, 81, 160) AS description, text AS content,
         '' AS error_info, CAST(doc_id % 5 + 1 - 2 * toxic AS INTEGER) AS depth,
         'v2 ' || substr(text, 1, 80) AS title, doc_id * 2 AS seq
  FROM lab
  UNION ALL
  SELECT source, CASE WHEN quality = 0 THEN {doc_url('upper(source)', 'lang', 'doc_id')}
                      ELSE {doc_url('source', 'lang', 'doc_id')} END AS url,
         CAST(2 AS TINYINT), substr(text, 81, 160), text, '', 0,
         'v3 ' || substr(text, 1, 80), doc_id * 2 + 1
  FROM lab WHERE toxic = 1
  UNION ALL
  SELECT 'web', url, CAST(2 AS TINYINT), substr(body, 1, 160), body, '', 1, {TITLE}, 1000000000 + page_id
  FROM (SELECT *, regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g') AS body FROM pages))"""

UPSERT = f"""{RECRAWL},
nb AS (
  SELECT source, {url_key('url')} AS url_key, arg_max(status, seq) AS status,
         arg_max(title, seq) AS title, arg_max(description, seq) AS description,
         arg_max(content, seq) AS content, arg_max(error_info, seq) AS error_info,
         min(depth) AS b_depth, arg_min(url, seq) AS first_url, min(seq) AS first_seq
  FROM batch GROUP BY source, {url_key('url')}),
o AS (SELECT *, {url_key('url')} AS url_key FROM corpus),
kept AS (
  SELECT o.page, o.source, o.url,
         CASE WHEN nb.b_depth IS NOT NULL THEN least(o.depth, nb.b_depth) ELSE o.depth END AS depth,
         CASE WHEN nb.b_depth IS NOT NULL THEN nb.status ELSE o.status END AS status,
         CASE WHEN nb.b_depth IS NOT NULL THEN nb.title ELSE o.title END AS title,
         CASE WHEN nb.b_depth IS NOT NULL THEN nb.description ELSE o.description END AS description,
         CASE WHEN nb.b_depth IS NOT NULL THEN nb.content ELSE o.content END AS content,
         CASE WHEN nb.b_depth IS NOT NULL THEN TIMESTAMP '2024-03-01 00:00:00' ELSE o.crawled_at END AS crawled_at
  FROM o LEFT JOIN nb ON nb.source = o.source AND nb.url_key = o.url_key),
fresh AS (
  SELECT (SELECT max(page) FROM corpus) + row_number() OVER (ORDER BY first_seq) AS page,
         source, first_url AS url, b_depth AS depth, status, title, description, content,
         TIMESTAMP '2024-03-01 00:00:00' AS crawled_at
  FROM nb WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.source = nb.source AND o.url_key = nb.url_key)),
upserted AS (SELECT * FROM kept UNION ALL SELECT * FROM fresh)"""

ALIAS_WRITES = f"""writes AS (
  SELECT source, {http(doc_url('source', 'lang', 'doc_id'))} AS url,
         CASE WHEN toxic = 1 THEN {doc_url('source', 'lang', 'doc_id')} || '/'
              WHEN quality = 1 THEN {http(doc_url('source', 'lang', 'doc_id'))}
              ELSE {doc_url('source', 'lang', 'doc_id')} END AS canonical, doc_id AS seq
  FROM labels JOIN documents USING (doc_id)
  UNION ALL
  SELECT source, replace({doc_url('source', 'lang', 'doc_id')}, 'https://', 'HTTP://'),
         {doc_url('source', 'lang', 'doc_id')}, doc_id + 1000000
  FROM labels JOIN documents USING (doc_id) WHERE quality = 0)"""

FRONTIER = """frontier AS (
  SELECT event_id AS id, event_type AS source,
         'https://h' || CAST(user_id AS VARCHAR) || '.example.com/' || CAST(event_id % 50 AS VARCHAR) AS url,
         CAST(event_id % 4 AS INTEGER) AS status, CAST(event_id % 7 AS INTEGER) AS depth,
         ts AS added_at, ts + to_seconds(CAST(event_id % 120 AS BIGINT)) AS updated_at
  FROM events)"""

LINKS = """links AS (
  SELECT event_type AS source,
         'https://H' || CAST(user_id AS VARCHAR) || '.example.com/' || CAST((event_id + 1) % 50 AS VARCHAR) AS url,
         CAST(event_id % 7 + 1 AS INTEGER) AS depth, event_id AS seq
  FROM events)"""

EMBED_QUEUE = """eq AS (
  SELECT vec_id AS id, vec_id // 4 AS page, CAST(vec_id % 4 AS INTEGER) AS chunk_index,
         CAST(label % 5 AS INTEGER) AS status,
         TIMESTAMP '2024-02-29 23:50:00' + to_seconds(vec_id) AS added_at,
         TIMESTAMP '2024-02-29 23:50:00' + to_seconds(vec_id) + to_seconds(CAST(label * 10 AS BIGINT)) AS updated_at
  FROM embeddings)"""

TAGGED = """tagged AS (SELECT page_id, url, html, page_id % 7 = 3 AS blocked, page_id % 3 = 0 AS canonised,
  page_id % 4 = 1 AS described, page_id % 5 = 2 AS alternate FROM pages)"""

FETCHED = """fetched AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'html' WHEN 1 THEN 'map' WHEN 2 THEN 'feed'
  WHEN 3 THEN 'bad_feed' WHEN 4 THEN 'other' ELSE 'error' END AS kind FROM pages)"""

def phonetic_key(x: str) -> str:
    """Key of an ASCII word by plain replacements (no look-ahead, no back-references)."""
    c = f"CASE WHEN length({x}) > 2 THEN regexp_replace({x}, '^[gk]n', 'n') ELSE {x} END"
    c = f"replace(regexp_replace(replace({c}, 'wr', 'r'), 'd([jg])', '\\1', 'g'), 'tch', 'ch')"
    c = f"regexp_replace(regexp_replace({c}, '^[^A-Za-z0-9]+', ''), '[\\t\\f\\r ]', '', 'g')"
    groups = [("''hH", "H"), ("aeiouAEIOU", "A"), ("yY", "y"), ("bfpvwBFPVW", "B"), ("cgjkqsxzCGJKQSXZ", "C"), ("dtDT", "D"),
              ("lL", "L"), ("rR", "R"), ("mnMN", "M"), ("0123456789", "9")]
    plain = "".join(a for a, _ in groups)
    symbols = "".join(b * len(a.replace("''", "'")) for a, b in groups)
    c = f"translate(regexp_replace({c}, '[^{plain}]', '~', 'g'), '{plain}', '{symbols}')"
    c = f"regexp_replace(regexp_replace(regexp_replace({c}, '9~+', '9?', 'g'), '~+', '', 'g'), '^y', 'Y')"
    c = f"regexp_replace(regexp_replace(translate({c}, 'yH', 'A'), '([RL])A+', '\\1', 'g'), 'A+([RL])', '\\1', 'g')"
    for sym in "ABCDLRMY9":
        c = f"regexp_replace({c}, '{sym}+', '{sym}', 'g')"
    return f"regexp_replace({c}, '\\?+', '?', 'g')"


# Pairs of different lower-case ASCII words of the benchmark texts that share their first two letters.
WORD_PAIRS = r"""w AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) WHERE length(w) > 1),
pairs AS (SELECT a.w AS a, b.w AS b FROM w a JOIN w b ON substr(a.w, 1, 2) = substr(b.w, 1, 2) AND a.w <> b.w)"""


def edit_cost_ctes() -> str:
    """``costs(a, b, cost)`` of ASCII words: the weighted edit cost of ``pairs(a, b)``, a row of cells for each letter of a.

    A cell is cost * 256 + the last code of the string built so far.
    """
    from ..functions import phonetic as P
    first, later = (str(list(t)) for t in P.class_tables())
    cls = lambda p, c: f"CASE WHEN {p} = 0 THEN init[{c} + 1] ELSE mid[{c} + 1] END"

    def step(p, c, n):
        k = f"({cls(p, c)})"
        return (f"(CASE WHEN {k} = {P.SILENT} THEN {P.COST_SILENT} WHEN {p} = {c} THEN {P.COST_REPEAT} "
                f"WHEN {k} = {P.VOWEL} AND ({p} = 114 OR {n} = 114) THEN {P.COST_VOWEL_R} "
                f"WHEN {k} = ({cls(p, p)}) THEN CASE WHEN {k} = {P.VOWEL} THEN {P.COST_VOWEL_CLUSTER} ELSE {P.COST_SAME_CLASS} END "
                f"ELSE {P.COST_OTHER} END)")

    def swap(p, x, y):
        kx, ky = f"({cls(p, x)})", f"({cls(p, y)})"
        same = f"{x} = {y} OR (xor({x}, {y}) = 32 AND (({y} BETWEEN 65 AND 90) OR ({y} BETWEEN 97 AND 122)))"
        return (f"(CASE WHEN {same} THEN 0 WHEN {kx} = {ky} THEN {P.SUB_SAME_CLASS} "
                f"WHEN {kx} BETWEEN {P.CB} AND {P.CY} AND {ky} BETWEEN {P.CB} AND {P.CY} THEN {P.SUB_CONSONANTS} ELSE {P.SUB_OTHER} END)")

    here, after = "bc[y[1]]", "bc[y[1] + 1]"
    left = "acc[len(acc)]"
    grow = f"({left} // 256 + {step(f'({left} % 256)', here, after)} // (CASE WHEN i + 1 = na THEN {P.FINAL_INSERT_DIVISOR} ELSE 1 END))"
    drop = f"(r[y[1] + 1] // 256 + {step('(r[y[1] + 1] % 256)', 'c', after)})"
    keep = f"(r[y[1]] // 256 + {swap(f'({left} % 256)', 'c', here)})"
    return f"""cut AS (SELECT a, b, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, 1, i) = substr(b, 1, i))) AS k,
  {first}::INT[] AS init, {later}::INT[] AS mid FROM pairs),
codes AS (SELECT *, length(a) - k AS na, length(b) - k AS nb, CASE WHEN k = 0 THEN 0 ELSE ascii(substr(a, k, 1)) END AS before,
  list_append(list_transform(range(k + 1, length(a) + 1), lambda i: ascii(substr(a, i, 1))), 0) AS ac,
  list_append(list_transform(range(k + 1, length(b) + 1), lambda i: ascii(substr(b, i, 1))), 0) AS bc FROM cut),
start AS (SELECT *, list_reduce(list_transform(range(1, nb + 1), lambda j: [j::BIGINT]), lambda acc, y: list_append(acc,
    (({left} // 256) + {step(f'({left} % 256)', here, after)} // (CASE WHEN na = 0 THEN {P.FINAL_INSERT_DIVISOR} ELSE 1 END)) * 256 + {here}),
    [before::BIGINT]) AS r FROM codes),
cells AS (
  SELECT a, b, na, nb, before, ac, bc, init, mid, 0 AS i, before AS came, ac[1] AS c, r FROM start
  UNION ALL
  SELECT a, b, na, nb, before, ac, bc, init, mid, i + 1, c, ac[i + 2],
    list_reduce(list_transform(range(1, nb + 1), lambda j: [j::BIGINT]), lambda acc, y: list_append(acc,
      least({grow}, {drop}, {keep}) * 256 + CASE WHEN {drop} < {grow} THEN c ELSE {here} END),
      [((r[1] // 256) + {step('came', 'c', 'ac[i + 2]')}) * 256 + before::BIGINT])
  FROM cells WHERE i < na),
costs AS (SELECT a, b, (r[nb + 1] // 256)::BIGINT AS cost FROM cells WHERE i = na)"""


DICTIONARY = f"""v AS (SELECT term AS word, count(DISTINCT page) AS rank FROM postings GROUP BY term),
dict0 AS (SELECT word, rank, replace(word, 'ß', 'ss') AS a FROM v),
dict AS (SELECT word, rank, a, 0 AS langid, CASE WHEN a <> word THEN a END AS k1, {phonetic_key('a')} AS k2 FROM dict0)"""

NOW = "TIMESTAMP '2024-03-01 00:00:00'"

URL_RE = r"'^([A-Za-z][A-Za-z0-9+.\-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$'"


def url_part(u: str, i: int) -> str:
    return f"regexp_extract({u}, {URL_RE}, {i})"


def is_url(u: str) -> str:
    return f"(regexp_matches({u}, {URL_RE}) AND length({url_part(u, 3)}) > 0)"


def hostname(u: str) -> str:
    return (f"CASE WHEN {is_url(u)} THEN regexp_extract({url_part(u, 3)}, '^(?:[^@]*@)?([^:]*)', 1) END")


def canonical_guess(u: str) -> str:
    return (f"CASE WHEN {is_url(u)} THEN lower({url_part(u, 1)}) || ':' || {url_part(u, 2)} || "
            f"regexp_replace({url_part(u, 4)}, '/$', '') || {url_part(u, 5)} || "
            f"CASE WHEN contains({url_part(u, 6)}, '/') THEN {url_part(u, 6)} ELSE '' END END")

ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", " "), ("&amp;", "&")]


def unescape(c: str) -> str:
    for a, b in ENTITIES:
        lit = "'" + b.replace("'", "''") + "'"
        c = f"replace({c}, '{a}', {lit})"
    return c


def attr(tag: str, name: str) -> str:
    return unescape(f"""regexp_extract({tag}, '(?is)\\s{name}\\s*=\\s*["'']([^"'']*)["'']', 1)""")


def has_attr(tag: str, name: str) -> str:
    return f"regexp_matches({tag}, '(?is)\\s{name}\\s*=')"


def tags(html: str, name: str) -> str:
    return f"regexp_extract_all({html}, '(?is)<{name}\\s[^>]*>')"


def scheme(u: str) -> str:
    return f"lower({url_part(u, 1)})"


def origin(u: str) -> str:
    return f"({scheme(u)} || '://' || {url_part(u, 3)})"


def resolve(base: str, ref: str) -> str:
    nofrag = f"regexp_replace({base}, '#.*$', '')"
    noq = f"regexp_replace({nofrag}, '\\?.*$', '')"
    return (f"(CASE WHEN regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN {ref} "
            f"WHEN starts_with({ref}, '//') THEN {scheme(base)} || ':' || {ref} "
            f"WHEN starts_with({ref}, '/') THEN {origin(base)} || {ref} "
            f"WHEN starts_with({ref}, '#') THEN {nofrag} || {ref} "
            f"WHEN starts_with({ref}, '?') THEN {noq} || {ref} "
            f"WHEN {ref} = '' THEN {nofrag} "
            f"ELSE regexp_replace({noq}, '[^/]*$', '') || {ref} END)")


def anchors(html: str, base: str) -> str:
    good = f"list_filter({tags(html, 'a')}, lambda t: {has_attr('t', 'href')} AND NOT contains({attr('t', 'rel')}, 'nofollow'))"
    res = f"list_transform({good}, lambda t: {canonical_guess(resolve(base, attr('t', 'href')))})"
    return f"list_distinct(list_filter({res}, lambda x: x IS NOT NULL))"


def resolved_anchors(html: str, base: str) -> str:
    good = f"list_filter({tags(html, 'a')}, lambda t: {has_attr('t', 'href')} AND NOT contains({attr('t', 'rel')}, 'nofollow'))"
    return f"list_transform({good}, lambda t: {resolve(base, attr('t', 'href'))})"


def first_with(html: str, tag: str, a: str, value: str) -> str:
    return f"list_filter({tags(html, tag)}, lambda t: lower({attr('t', a)}) = '{value}')[1]"


def truncate(items: list[str], budget: str) -> list[str]:
    out, rem = [], budget
    for it in items:
        it = f"coalesce({it}, '')"
        n = f"strlen({it})"

        def pre(k):
            return f"CASE WHEN ({k}) >= 0 THEN try(decode(encode({it})[1:({k})])) END"

        cut = f"coalesce({pre(rem)}, {pre(rem + ' - 1')}, {pre(rem + ' - 2')}, {pre(rem + ' - 3')}, '')"
        out.append(f"(CASE WHEN {n} <= {rem} THEN {it} WHEN {rem} > 0 THEN {cut} ELSE '' END)")
        rem = f"(CASE WHEN {n} <= {rem} THEN {rem} - {n} ELSE 0 END)"
    return out


def epoch_s(ts: str) -> str:
    """Whole epoch seconds (timestamps compare at second precision)."""
    return f"CAST(floor(epoch({ts})) AS BIGINT)"


def stale(col: str) -> str:
    return f"({epoch_s(NOW)} - {epoch_s(col)} > 60)"
