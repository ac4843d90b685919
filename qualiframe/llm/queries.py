"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_packing, centroids, cutting_stock, embeddings, line_dedup, media, mixing, ngram_join, order_minhash, quality, suffix_dedup, urls, vector_codes
from .scratch import Scratch
from .words import word_count

#: The rules of the URL query, as (verdict, host, path).
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    """File of a public vocabulary; pass any other path to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return binary_packing.pack(_docs(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end_id=50256, length=2048)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_docs(spark, sf_dir))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Every vector of the table in one label, so that the trees split, and a copy of two in three at distances around the threshold.
PLANTED_VECTORS = """
SELECT vec_id, embedding, 0 AS label FROM {embeddings}
UNION ALL SELECT vec_id + 1000000000, transform(embedding, (x, i) -> CAST(CAST(x AS DOUBLE) + CAST(((i * 7 + vec_id) % 11 - 5) * (vec_id % 8 + 1) AS DOUBLE) / 1024 AS FLOAT)), 0 FROM {embeddings} WHERE vec_id % 3 <> 0
"""


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding dedup over planted vectors, with its production parameters."""
    return embeddings.near_duplicates(spark.sql(PLANTED_VECTORS, embeddings=spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_docs(spark, sf_dir).select("doc_id", "text"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_docs(spark, sf_dir), span=50)
    removed = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda total, s: total + s["ends"] - s["starts"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting_stock.pack(_docs(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=2, length=4096, keep_ids=False)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _docs(spark, sf_dir).select("doc_id", "source", word_count("text").alias("size"))
    sized = Scratch(spark, "op4").save(sized, "sizes")
    mixed = mixing.mix(sized, weights=(3, 1, 2), share=1.5, cap=2.0)
    return mixed.selectExpr("doc_id", "size", "source_size", "target", "size * copies as taken")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe_texts(_docs(spark, sf_dir))


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, dims=64, scale=64, times=3, seed=1)


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_edits(_docs(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=4, entries=256, scale=1024, times=4)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_binary_packing, op2_ngram_join, op3_suffix_dedup, op4_mixing, op5_url_filter, op6_embedding_dedup, op7_line_dedup, op8_cutting_stock, op9_quality, op10_matroska, op11_delta_lloyd, op12_order_minhash, op13_vector_codes, url_aliases, near_vectors, pipeline)}


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), w AS (
  SELECT source, source_size, 2.0 * source_size AS cap,
         CAST([3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM s
), r AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
              - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_weight
  FROM w
), c AS (
  SELECT *, CAST(rest * weight AS DOUBLE) / rest_weight > cap AS capped FROM r
), f AS (
  SELECT rest AS lr, rest_weight AS lw FROM c WHERE NOT capped ORDER BY cap / weight, rest, rest_weight LIMIT 1
), t AS (
  SELECT c.source, c.source_size, CAST(CASE WHEN capped THEN cap ELSE least(CAST(cap AS DOUBLE), lr * weight / lw) END AS DOUBLE) AS target
  FROM c LEFT JOIN f ON true
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t
), blocks AS (
  SELECT source, h, sum(size) AS size FROM sized GROUP BY source, h
), cum AS (
  SELECT source, h, size, sum(size) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM blocks
)
SELECT d.doc_id, d.size, b.source_size, b.target,
       CAST(d.size * (b.times + CASE WHEN 2 * cum.upto - cum.size <= 2 * (b.target - b.times * b.source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d
JOIN b ON d.source IS NOT DISTINCT FROM b.source
JOIN cum ON cum.source IS NOT DISTINCT FROM d.source AND cum.h = d.h
"""

_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)



def _key_sql(host: str, path: str, query: str) -> str:
    """Alias key in SQL: dot segments go, an empty path is a slash."""
    longer = rf"CASE WHEN regexp_matches({path}, '/\.\.?$') THEN {path} || '/' ELSE {path} END"
    steps = f"list_reduce(list_transform(string_split({longer}, '/'), lambda x: [x]), lambda kept, x: CASE x[1] WHEN '..' THEN kept[1:greatest(len(kept) - 1, 1)] WHEN '.' THEN kept ELSE list_concat(kept, x) END)"
    return f"{host} || CASE WHEN {path} = '' THEN '/' WHEN contains({path}, '/.') THEN array_to_string({steps}, '/') ELSE {path} END || {query}"


def _attribute_sql(attributes: str, name: str) -> str:
    found = rf"list_filter({attributes}, lambda y: regexp_matches(y, '(?is)^{name}\s*='))[1]"
    bare = rf"""regexp_replace(regexp_replace({found}, '(?s)^[^=]*=\s*', ''), '(?s)^(["''])(.*)["'']$', '\2')"""
    return rf"trim(replace({bare}, '&amp;', '&'), e' \t\n\r\f\v')"


def _absolute_sql(to: str, host: str, path: str) -> str:
    slash = f"CASE WHEN {path} = '' THEN '/' ELSE {path} END"
    return rf"""CASE WHEN regexp_matches({to}, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN {to}
      WHEN {to} = '' OR {to} LIKE '#%' OR regexp_matches({to}, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN NULL
      WHEN {to} LIKE '//%' THEN 'http:' || {to} WHEN {to} LIKE '/%' THEN 'http://' || {host} || {to} WHEN {to} LIKE '?%' THEN 'http://' || {host} || {slash} || {to}
      ELSE 'http://' || {host} || regexp_replace({slash}, '[^/]*$', '') || {to} END"""


def _parts_sql(url: str, names: str = "host path query") -> str:
    host, path, query = names.split()
    at = lambda k: f"coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)', {k}), '')"
    return f"translate({at(1)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS {host}, {at(2)} AS {path}, {at(3)} AS {query}"


def url_sql(pages: str, redirects: str = "SELECT CAST(NULL AS VARCHAR) AS from_url, CAST(NULL AS VARCHAR) AS to_url") -> str:
    """The URL query over any pages and redirects, by a recursive walk over all links."""
    return rf"""
WITH RECURSIVE rules(verdict, rhost, rpath) AS (VALUES {_RULE_ROWS}),
u AS (SELECT page_id, html, url, {_parts_sql("url")} FROM ({pages})),
k AS (SELECT *, CASE WHEN host <> '' THEN {_key_sql("host", "path", "query")} END AS key FROM u),
tagged AS (
  SELECT key, host, path, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?is)<(?:link|meta|base)\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>') AS tags
  FROM k WHERE key IS NOT NULL AND html IS NOT NULL
), spread AS (
  SELECT key, host, path, unnest(tags) AS tag,
    regexp_extract_all(list_filter(tags, lambda y: regexp_matches(y, '(?is)^<base\b.*[\s"''/]href\s*='))[1], '(?s)[^\s"''>/=]+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)') AS base_attributes
  FROM tagged
), read AS (
  SELECT *, regexp_extract_all(tag, '(?s)[^\s"''>/=]+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)') AS attributes FROM spread
), links AS (
  SELECT key, host, path, {_attribute_sql("base_attributes", "href")} AS base,
    CASE WHEN regexp_matches(tag, '(?i)^<link\b') AND regexp_matches({_attribute_sql("attributes", "rel")}, '(?i)(^|\s)canonical(\s|$)') THEN {_attribute_sql("attributes", "href")}
      WHEN regexp_matches(tag, '(?i)^<meta\b') AND lower({_attribute_sql("attributes", "http-equiv")}) = 'refresh'
      THEN regexp_extract({_attribute_sql("attributes", "content")}, '(?is)^[0-9.\s]*[;,]?\s*url\s*=\s*["'']?\s*([^"''\s]+)', 1) END AS t
  FROM read
), seen AS (SELECT key, t, host, path, {_absolute_sql("base", "host", "path")} AS base FROM links WHERE t <> ''),
based AS (SELECT key, t, host, path, base, {_parts_sql("base", "bhost bpath bquery")} FROM seen),
near AS (SELECT key, t, CASE WHEN base IS NULL THEN host ELSE bhost END AS host, CASE WHEN base IS NULL THEN path ELSE bpath END AS path FROM based),
absolute AS (SELECT key AS a, {_absolute_sql("t", "host", "path")} AS t FROM near),
split AS (SELECT a, {_parts_sql("t", "h p q")} FROM absolute WHERE t IS NOT NULL),
r AS (SELECT {_parts_sql("from_url", "fh fp fq")}, {_parts_sql("to_url", "th tp tq")} FROM ({redirects})),
e AS (
  SELECT a, {_key_sql("h", "p", "q")} AS b FROM split WHERE h <> ''
  UNION ALL SELECT {_key_sql("fh", "fp", "fq")}, {_key_sql("th", "tp", "tq")} FROM r WHERE fh <> '' AND th <> ''
), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
member AS (
  SELECT r.a, r.b, (SELECT arg_max(verdict, length(rhost) + length(rpath)) FROM rules
    WHERE (regexp_extract(r.b, '^[^/?]*') = rhost OR suffix(regexp_extract(r.b, '^[^/?]*'), '.' || rhost)) AND starts_with(regexp_extract(r.b, '^[^/?]*([^?]*)', 1), rpath)) AS own
  FROM reach r
), alias AS (
  SELECT a FROM member GROUP BY a HAVING bool_or(own = 'block') AND NOT coalesce(bool_or(own = 'allow'), false)
), fit AS (
  SELECT k.page_id, k.host, k.path, k.key, k.url, k.html,
    (SELECT arg_max(rhost || rpath, length(rhost) + length(rpath)) FROM rules WHERE (k.host = rhost OR suffix(k.host, '.' || rhost)) AND starts_with(k.path, rpath)) AS rule,
    (SELECT arg_max(verdict, length(rhost) + length(rpath)) FROM rules WHERE (k.host = rhost OR suffix(k.host, '.' || rhost)) AND starts_with(k.path, rpath)) AS own
  FROM k
)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN key IN (SELECT a FROM alias) THEN 'block' ELSE 'allow' END) AS verdict FROM fit
"""


#: Every page of the table with links planted by fixed rules, in SQL that both engines take: canonical links in many spellings, bases, jumps and chains of mirrors.
PLANTED_PAGES = r"""
SELECT page_id, url, CASE
  WHEN page_id % 8 IN (0, 3, 6) THEN '<head><link' || chr(10) || ' data-href="http://x.example.net/q"' || chr(10) || ' rel="canonical"' || chr(10) || ' href="https://Mirror' || CAST(page_id % 307 AS VARCHAR(9)) || '.example/a/../p">'
  WHEN page_id % 8 IN (1, 4) THEN '<META http-equiv=refresh content="0; URL=''//mirror' || CAST(page_id % 307 AS VARCHAR(9)) || '.example/p''">'
  WHEN page_id % 8 IN (2, 5) THEN '<base href="http://mirror' || CAST(page_id % 307 AS VARCHAR(9)) || '.example/deep/x"><link title="a > b" rel=''next canonical'' href=../p#part>'
  WHEN page_id % 5 = 0 THEN '<!-- <link rel="canonical" href="http://blocked.example.org/es/1"> --><p>'
  WHEN page_id % 5 = 1 THEN '<link rel="alternate" href="http://blocked.example.org/es/1">'
  WHEN page_id % 5 = 2 THEN '<link rel="canonical" href="/copy?of=1&amp;n=' || CAST(page_id % 11 AS VARCHAR(9)) || '">'
  WHEN page_id % 5 = 3 THEN '<link rel=canonical href="mailto:a@example.org">' ELSE html END AS html
FROM pages
"""
PLANTED_REDIRECTS = r"""
SELECT 'http://mirror' || CAST(n AS VARCHAR(9)) || '.example/p' AS from_url,
  CASE WHEN n % 8 = 0 THEN 'https://hop' || CAST(n AS VARCHAR(9)) || '.example/' WHEN n % 8 = 2 THEN 'http://fine.example/' || CAST(n AS VARCHAR(9))
    WHEN n % 2 = 0 THEN 'http://x.example.net/de/8' || CAST(n AS VARCHAR(9)) ELSE 'https://a.example.org/es/' || CAST(n AS VARCHAR(9)) END AS to_url
FROM (SELECT DISTINCT page_id % 307 AS n FROM pages) AS m
UNION ALL SELECT 'http://hop' || CAST(n AS VARCHAR(9)) || '.example', CASE WHEN n % 16 = 0 THEN 'http://b.example.com/en/1' ELSE 'http://c.example.net/de/1' END FROM (SELECT DISTINCT page_id % 307 AS n FROM pages) AS m WHERE n % 8 = 0
UNION ALL SELECT 'http://mirror9.example/p', 'http://example.com/en/7'
"""


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL filter over all pages with planted links, so that aliases decide."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urls.judge(spark.sql(PLANTED_PAGES.replace("FROM pages", "FROM {pages}"), pages=pages), URL_RULES, spark.sql(PLANTED_REDIRECTS.replace("FROM pages", "FROM {pages}"), pages=pages))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), half AS (
  SELECT c.a, c.b, x.n = c.c AND y.n = c.c AS same FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 10 * c.c >= 8 * (x.n + y.n - c.c)
), e AS (
  SELECT a, b, same FROM half UNION ALL SELECT b, a, same FROM half
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b
), class AS (
  SELECT a, min(b) AS class_id FROM reach GROUP BY a
), degree AS (
  SELECT a, count(*) AS n_links, count(*) FILTER (WHERE same) AS copies FROM e GROUP BY a
)
SELECT d.doc_id, class.class_id, coalesce(n_links, 0) AS n_links, coalesce(copies, 0) AS copies
FROM documents d JOIN class ON class.a = d.doc_id LEFT JOIN degree ON degree.a = d.doc_id
"""

_NEAR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM ({vectors})
), half AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), e AS (
  SELECT a, b FROM half UNION ALL SELECT b, a FROM half
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b
), part AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), degree AS (
  SELECT a, count(*) AS n_links FROM e GROUP BY a
)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN part ON part.a = v.vec_id LEFT JOIN degree ON degree.a = v.vec_id
"""
OP6_SQL = _NEAR_SQL.format(vectors="SELECT * FROM embeddings")
NEAR_VECTORS_SQL = _NEAR_SQL.format(vectors="""
SELECT vec_id, embedding, 0 AS label FROM embeddings
UNION ALL SELECT vec_id + 1000000000, list_transform(embedding, lambda x, j: CAST(CAST(x AS DOUBLE) + CAST((((j - 1) * 7 + vec_id) % 11 - 5) * (vec_id % 8 + 1) AS DOUBLE) / 1024 AS FLOAT)), 0 FROM embeddings WHERE vec_id % 3 <> 0
""")


def _lloyd_sql(vectors: str, starts: str, width: int, rounds: int) -> str:
    """CTEs v (vec_id, label, part, x), c0 to c``rounds`` (part, c, x) and a0 to a``rounds`` (vec_id, label, part, m): all parts compared with all entries, every round anew."""
    steps = [f"v AS MATERIALIZED ({vectors})", f"c0 AS MATERIALIZED ({starts})"]
    for turn in range(rounds + 1):
        steps.append(f"""a{turn} AS MATERIALIZED (
  SELECT v.vec_id, any_value(v.label) AS label, v.part, any_value(v.x) AS x,
    min({{'d': list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, e.x) + list_dot_product(e.x, e.x), 'c': e.c}}) AS m
  FROM v JOIN c{turn} e ON e.part = v.part GROUP BY v.vec_id, v.part
)""")
        if turn < rounds:
            steps.append(f"""c{turn + 1} AS MATERIALIZED (
  SELECT part, c, list(s ORDER BY i) AS x FROM (SELECT part, m.c AS c, i, floor(sum(x[i]) / count(*)) AS s FROM a{turn}, range(1, {width + 1}) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2
  UNION ALL SELECT part, c, x FROM c{turn} WHERE (part, c) NOT IN (SELECT (part, m.c) FROM a{turn})
)""")
    return ",\n".join(steps)


_KEPT_SQL = "SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}"
_WHOLE_SQL = "list_transform({x}, lambda x: CAST(x AS BIGINT))"
OP11_SQL = f"""
WITH k AS MATERIALIZED ({_KEPT_SQL.format(scale=64, dims=64)}),
{_lloyd_sql("SELECT vec_id, label, 0 AS part, x FROM k", "SELECT 0 AS part, row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT x, sha256('1:' || CAST(vec_id AS VARCHAR)) AS h FROM k ORDER BY h, x LIMIT 16)", 64, 3)},
i AS (SELECT m.c AS c, CAST(sum(m.d) AS BIGINT) AS cluster_inertia FROM a3 GROUP BY 1)
SELECT a3.vec_id, CAST(a3.m.c AS INTEGER) AS cluster, CAST(a3.m.d AS BIGINT) AS distance, cluster_inertia, (SELECT CAST(sum(m.d) AS BIGINT) FROM a3) AS inertia,
  sha256(array_to_string({_WHOLE_SQL.format(x="c3.x")}, ',')) AS centroid_sha256
FROM a3 JOIN i ON i.c = a3.m.c JOIN c3 ON c3.c = a3.m.c
"""
OP13_SQL = f"""
WITH k AS MATERIALIZED ({_KEPT_SQL.format(scale=1024, dims=64)}),
{_lloyd_sql("SELECT vec_id, label, p AS part, x[16 * p + 1:16 * p + 16] AS x FROM k, range(4) t(p)", "SELECT p AS part, c, x[16 * p + 1:16 * p + 16] AS x FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c, x FROM k ORDER BY vec_id LIMIT 256), range(4) t(p)", 16, 4)},
s AS (SELECT sha256(string_agg(array_to_string({_WHOLE_SQL.format(x="x")}, ','), ',' ORDER BY part, c)) AS codebooks_sha256 FROM c4),
r AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m.c), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a4 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, s
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_delta_lloyd": OP11_SQL, "op13_vector_codes": OP13_SQL, "op2_ngram_join": OP2_SQL, "op6_embedding_dedup": OP6_SQL, "near_vectors": NEAR_VECTORS_SQL, "op4_mixing": OP4_SQL, "op5_url_filter": url_sql("SELECT * FROM pages"), "url_aliases": url_sql(PLANTED_PAGES, PLANTED_REDIRECTS)}
