"""The registered queries of the text operators, and their SQL where SQL can say it."""

from __future__ import annotations

import secrets
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm import license as licenses
from vigilake.llm import centroids, decontam, html, linededup, minhash, packing, phrases, pii, quality, simhash, toxicity, urlfilter
from vigilake.session import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    """Register a query under its name."""
    QUERIES[function.__name__] = lambda spark, sf_dir: function(importable(spark), sf_dir)
    return function


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return linededup.dedup_lines(docs)


ORACLES["op1_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
w AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
k AS (SELECT *, array_to_string(ws, ' ') AS t FROM w WHERE len(ws) > 0),
f AS (SELECT t, any_value(ws) AS ws, min((doc_id, i)) AS f FROM k GROUP BY t),
d AS (
  SELECT t, f, j, array_to_string(list_concat(ws[1:j - 1], ws[j + 1:]), ' ') AS v
  FROM f, unnest(range(1, len(ws) + 1)) AS u(j) WHERE len(ws) >= 5),
late AS (
  SELECT b.t FROM d AS a JOIN d AS b ON a.v = b.v AND a.j = b.j AND a.f < b.f
  UNION SELECT d.t FROM d JOIN f ON d.v = f.t AND f.f < d.f
  UNION SELECT f.t FROM d JOIN f ON d.v = f.t AND d.f < f.f),
s AS (
  SELECT k.doc_id, k.i FROM k JOIN f ON k.t = f.t AND (k.doc_id, k.i) = f.f WHERE k.t NOT IN (SELECT t FROM late)
  UNION ALL SELECT doc_id, i FROM w WHERE len(ws) = 0),
g AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text, count(*) AS n FROM l JOIN s USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(g.text, '') END AS text,
       CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(g.n, 0) AS BIGINT) AS n_dropped
FROM documents AS d LEFT JOIN g USING (doc_id)
"""


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = simhash.near_duplicates(docs)
    return found.withColumn("fingerprint", simhash.hex_form(F.col("fingerprint")))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decontam.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op3_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM benchmark),
dg AS (SELECT doc_id, len(ws) AS n, p, array_to_string(ws[p + 1:p + 5], ' ') AS g FROM d, unnest(range(0, len(ws) - 4)) AS u(p)),
bg AS (SELECT item_id, len(ws) AS m, array_to_string(ws[p + 1:p + 5], ' ') AS g FROM b, unnest(range(0, len(ws) - 4)) AS u(p)),
bc AS (SELECT item_id, m, g, count(*) AS c FROM bg GROUP BY ALL),
a AS (SELECT dg.doc_id, bc.item_id, bc.m, dg.n, dg.p FROM dg JOIN bc USING (g)),
s AS (SELECT DISTINCT doc_id, item_id, m, n, unnest(range(least(greatest(0, p - m + 5), greatest(0, least(p, n - m))), greatest(0, least(p, n - m)) + 1)) AS start FROM a),
wc AS (
  SELECT s.doc_id, s.item_id, s.start, s.m, s.n, dg.g, count(*) AS c
  FROM s JOIN dg ON dg.doc_id = s.doc_id AND dg.p BETWEEN s.start AND s.start + s.m - 5 GROUP BY ALL),
c AS (
  SELECT wc.doc_id, wc.item_id, wc.start, wc.m, wc.n, sum(least(wc.c, bc.c)) AS common
  FROM wc JOIN bc ON bc.item_id = wc.item_id AND bc.g = wc.g GROUP BY ALL),
j AS (SELECT doc_id, item_id, start, CAST(common AS DOUBLE) / (least(m, n) - 4 + m - 4 - common) AS similarity FROM c)
SELECT doc_id, item_id, round(max(similarity), 6) AS similarity, CAST(arg_max(start, (similarity, -start)) AS BIGINT) AS start
FROM j WHERE similarity >= 0.8 - 1e-9 GROUP BY doc_id, item_id
"""


URL_RULES = (
    urlfilter.Rule("block", "net", "/"),
    urlfilter.Rule("allow", "example.net", "/en/"),
    urlfilter.Rule("block", "example.com", "/de/"),
    urlfilter.Rule("allow", "org", "/fr/"),
)


@query
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urlfilter.filter_urls(pages, URL_RULES).drop("url")


ORACLES["op4_url_filters"] = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
r(verdict, h, p) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""


#: The key of this process's queries on a cluster where none is set.
_DRAWN_KEY = secrets.token_hex(32)


def pii_key(spark: SparkSession) -> str:
    """The key that spark.vigilake.pii.key names. Where it is unset, a local session takes one that everybody knows; on a
    cluster, where such pseudonyms would hide nothing, it is one drawn for this process and kept nowhere, so that they hide
    all and nobody can undo them."""
    key = spark.conf.get("spark.vigilake.pii.key", None)
    if key:
        return key
    if not spark.sparkContext.master.startswith("local"):
        warnings.warn("spark.vigilake.pii.key isn't set: these pseudonyms have a key of this process and can't be undone", stacklevel=3)
        return _DRAWN_KEY
    warnings.warn("spark.vigilake.pii.key isn't set: these pseudonyms have a key that everybody knows", stacklevel=3)
    return "a key for tests alone"


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pii.pseudonymise(docs, pii_key(spark))


@query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


@query
def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# The tables hold one-sentence notices alone; runs of several sentences are tested on fixtures.
ORACLES["op7_license_scans"] = r"""
WITH known(id, license, s) AS (
  VALUES ('gpl-3-short', 'GPL-3.0-only', 'this work is licensed under the gnu general public license version 3'),
         ('mit-short', 'MIT', 'released under the mit license'),
         ('apache-2-short', 'Apache-2.0', 'licensed under the apache license version 2.0'),
         ('cc-by-nc-4-short', 'CC-BY-NC-4.0', 'licensed under cc by nc 4.0'),
         ('cc-by-4-short', 'CC-BY-4.0', 'licensed under cc by 4.0')),
sentence AS (
  SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS x
  FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(text, '[.;!?](\s)', chr(1) || '\1', 'g'), '[.;!?]$', chr(1)), '[\n' || chr(1) || ']') AS l FROM documents)),
normal AS (
  SELECT doc_id, i, trim(regexp_replace(regexp_replace(regexp_replace(lower(x), '\.([^\p{N}]|$)', ' \1', 'g'), '(^|[^\p{N}])\.', '\1 ', 'g'), '[^\p{L}\p{N}.]+', ' ', 'g')) AS s
  FROM sentence)
SELECT doc_id, license, CAST(i AS INTEGER) AS first_sentence, CAST(i AS INTEGER) AS last_sentence, [id] AS sentence_ids
FROM normal JOIN known USING (s)
"""


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality.measure(docs)


ORACLES["op9_quality_rules"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, range(0, 5) AS u(k) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND NOT 10 * n_symbols > n_words AND NOT 2 * n_dup_lines > n_lines
          AND NOT word_chars < 2 * n_words AND NOT word_chars > 15 * n_words AS kept
FROM b
"""


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack(docs, tokenizer_path())


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


ORACLES["op11_phrase_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM w, range(1, 4) AS u(k), unnest(range(1, len(ws) - k + 2)) AS t(i)),
f AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND a >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, x.a AS l, y.a AS r, 1000000 * c.a * c.a // (x.a * y.a) AS score
  FROM c, range(1, 3) AS u(cut)
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:cut], ' ')
  JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[cut + 1:], ' ')
  WHERE cut < c.k),
s AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT DISTINCT c.lang, c.phrase FROM c
  JOIN (SELECT lang, a, array_to_string(ws[1:2], ' ') AS part FROM c WHERE k = 3
        UNION ALL SELECT lang, a, array_to_string(ws[2:3], ' ') FROM c WHERE k = 3) AS t
    ON t.lang = c.lang AND t.part = c.phrase AND 100 * t.a >= 50 * c.a
  WHERE c.k = 2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM s ANTI JOIN inside USING (lang, phrase))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n,
       CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@query
def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


# Links by every shingle that two sets share; components by reachability.
ORACLES["op12_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 1], ' ') AS g
  FROM w, unnest(range(1, greatest(len(ws) - 1, least(len(ws), 1)) + 1)) AS u(i)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g AS a JOIN g AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT x, y FROM shared JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
ends AS MATERIALIZED (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, ends.y FROM reach JOIN ends ON reach.y = ends.x),
low AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents AS d JOIN low USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _clustering_sql(rounds: int) -> str:
    distance = "list_sum(list_transform(range(1, 65), lambda i: (q[i] - c[i]) * (q[i] - c[i])))"

    def nearest(centroids: str) -> str:
        rows = f"SELECT vec_id, q, k, c, CAST({distance} AS BIGINT) AS d FROM v, {centroids}"
        return f"SELECT vec_id, q, unnest(arg_min({{'k': k, 'd': d, 'c': c}}, (d, k))) FROM ({rows}) GROUP BY vec_id, q"

    steps = []
    for t in range(rounds):
        steps.append(f"""
a{t} AS MATERIALIZED ({nearest(f"c{t}")}),
m{t} AS (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT k, i, sum(q[i]) AS s, count(*) AS n FROM a{t}, range(1, 65) AS u(i) GROUP BY k, i) GROUP BY k),
c{t + 1} AS MATERIALIZED (SELECT o.k, CAST(coalesce(m.c, o.c) AS BIGINT[]) AS c FROM c{t} AS o LEFT JOIN m{t} AS m USING (k)),""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, q AS c
  FROM (SELECT q, sha256('1:' || CAST(vec_id AS VARCHAR)) AS h FROM v ORDER BY h LIMIT 16)),{"".join(steps)}
z AS MATERIALIZED ({nearest(f"c{rounds}")})
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM z
"""


ORACLES["op13_centroid_clustering"] = _clustering_sql(3)


def tokenizer_path() -> str:
    """The byte-level BPE file of the public tokenizers, where they are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
