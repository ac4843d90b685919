"""Registered queries of names, labels, choices and strategies, each over a whole table given.

The SQL holds its own rules; lists of fixed values are shared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from . import queries as base
from .functions import expr as E
from .functions import names as N
from .operators import detect, overrides, score, strategies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join(f"({', '.join(base.q(x) for x in r)})" for r in rows)


def _listed(values: list[str] | tuple[str, ...]) -> str:
    return f"([{', '.join(base.q(v) for v in values)}])"


def _pick(key: str, values: list[str] | tuple[str, ...]) -> Column:
    """One of the values by the remainder of a key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _d_pick(key: str, values: list[str] | tuple[str, ...]) -> str:
    return f"{_listed(values)}[CAST({key} % {len(values)} AS INT) + 1]"


# ---- issue types, by events: each stands for a finding ------------------------------------------

_ISSUES = list(C.ISSUES)
_FOUND = f"f AS (SELECT event_id, {_d_pick('event_id', _ISSUES)} AS issue_type FROM events)"


def _found(s: SparkSession, d: str) -> DataFrame:
    return base.table(s, d, "events").select("event_id", _pick("event_id", _ISSUES).alias("issue_type"))


@_query(f"WITH {_FOUND}, k(issue_type, label) AS (VALUES {_values(list(C.LABELS.items()))}) SELECT event_id, coalesce(k.label, upper(substr(replace(f.issue_type, '_', ' '), 1, 1)) || substr(replace(f.issue_type, '_', ' '), 2)) AS label FROM f LEFT JOIN k ON k.issue_type = f.issue_type")
def fn_label(s, d):
    return _found(s, d).select("event_id", E.label(F.col("issue_type")).alias("label"))


@_query(f"WITH {_FOUND}, k(issue_type, explanation) AS (VALUES {_values(list(C.EXPLANATIONS.items()))}) SELECT event_id, f.issue_type, explanation FROM f LEFT JOIN k ON k.issue_type = f.issue_type")
def fn_explain(s, d):
    return _found(s, d).select("event_id", "issue_type", E.explanation(F.col("issue_type")).alias("explanation"))


@_query(f"WITH {_FOUND}, k(issue_type, component_name) AS (VALUES {base._MAP}) SELECT event_id, f.issue_type, component_name FROM f JOIN k ON k.issue_type = f.issue_type")
def score_mapping(s, d):
    return _found(s, d).join(F.broadcast(score.component_map(s)), "issue_type").select("event_id", "issue_type", "component_name")


@_query(f"WITH {_FOUND}, k(issue_type, component_name) AS (VALUES {base._MAP}), w(component_name, component_weight) AS (VALUES {base._WEIGHT}) SELECT w.component_name, component_weight, count(event_id) AS findings FROM w LEFT JOIN k ON k.component_name = w.component_name LEFT JOIN f ON f.issue_type = k.issue_type GROUP BY ALL")
def ui_weights(s, d):
    counts = score_mapping(s, d).groupBy("component_name").agg(F.count(F.lit(1)).alias("n"))
    return score.weights(s).join(counts, "component_name", "left").orderBy("place").select("component_name", "component_weight", F.coalesce("n", F.lit(0).cast("long")).alias("findings"))


# ---- names: those of the headers of many tables -------------------------------------------------

#: A header for each customer who ordered, with a column for each order.
_HEADERS = """
SELECT o_custkey AS dataset, o_orderkey AS place, CASE CAST(o_orderkey % 9 AS INT) WHEN 0 THEN 'Order Date' WHEN 1 THEN 'order_date' WHEN 2 THEN ' ' || o_orderpriority WHEN 3 THEN lower(o_orderstatus) || 'Code'
  WHEN 4 THEN lower(o_orderpriority) WHEN 5 THEN 'prepaid' WHEN 6 THEN lower(o_orderstatus) || '_id' WHEN 7 THEN o_orderstatus || ' barcode' || chr(9) ELSE o_orderpriority END AS name
FROM {orders}
"""
_HEADERS_SQL = f"""WITH n AS (SELECT *, trim(name, ' ' || chr(9)) AS bare FROM ({_HEADERS.replace('{orders}', 'orders')})),
p AS (SELECT *, coalesce(nullif(trim(regexp_replace(lower(bare), '[^0-9a-z]+', '_', 'g'), '_'), ''), 'column') AS plain,
  CASE WHEN regexp_full_match(bare, '[a-z0-9]+(_[a-z0-9]+)*') THEN 'snake_case' WHEN regexp_full_match(bare, '[a-z0-9]+(-[a-z0-9]+)*') THEN 'kebab-case'
    WHEN regexp_full_match(bare, '[A-Za-z0-9]+( [A-Za-z0-9]+)+') THEN 'space separated' WHEN regexp_full_match(bare, '[A-Za-z][A-Za-z0-9]*') AND regexp_matches(substr(bare, 2), '[A-Z]') THEN 'camelCase/PascalCase' END AS style FROM n)"""


def _headers(s: SparkSession, d: str) -> DataFrame:
    return s.sql(_HEADERS, orders=base.table(s, d, "orders")).withColumn("name", F.col("name").cast("string"))


@_query(f"{_HEADERS_SQL} SELECT place, name, style FROM p")
def fn_name_style(s, d):
    return _headers(s, d).select("place", "name", N.style(F.col("name")).alias("style"))


@_query(f"{_HEADERS_SQL} SELECT place, plain, regexp_matches(plain, '(^|_)(id|code|number|key|uuid|guid|identifier)(_|$)|(code|number|key|uuid|guid|identifier)$') AS hinted FROM p")
def fn_name_hint(s, d):
    plain = N.normalized(F.col("name"))
    return _headers(s, d).select("place", plain.alias("plain"), N.hinted(plain, C.IDENTIFIER_HINTS).alias("hinted"))


_SAME_SQL = f"{_HEADERS_SQL}, g AS (SELECT dataset, plain, count(*) AS n, count(DISTINCT name) AS names FROM p GROUP BY ALL)"


@_query(f"{_SAME_SQL} SELECT p.dataset, place, 'duplicate_column_name' AS issue_type, 'Critical' AS severity, name AS column_name FROM p JOIN g ON g.dataset = p.dataset AND g.plain = p.plain WHERE n > names")
def duplicate_column_name(s, d):
    return detect.header_findings(_headers(s, d)).filter("issue_type = 'duplicate_column_name'").select("dataset", "place", "issue_type", "severity", "column_name")


@_query(f"""{_SAME_SQL}, x AS (SELECT dataset FROM p WHERE style IS NOT NULL GROUP BY 1 HAVING count(DISTINCT style) > 1)
SELECT p.dataset, place, CASE WHEN n > names THEN 'duplicate_column_name' ELSE 'near_duplicate_column_name' END AS issue_type, CASE WHEN n > names THEN 'Critical' ELSE 'Medium' END AS severity, CAST(1 AS DOUBLE) AS confidence, name AS column_name, CAST(NULL AS VARCHAR) AS suggested_value
  FROM p JOIN g ON g.dataset = p.dataset AND g.plain = p.plain WHERE n > 1
UNION ALL SELECT dataset, place, 'column_name_whitespace', 'Low', 1, name, bare FROM p WHERE name <> bare
UNION ALL SELECT dataset, place, 'inconsistent_column_name_formatting', 'Low', 0.7, name, plain FROM p WHERE style IS NOT NULL AND dataset IN (SELECT dataset FROM x)""")
def header_findings(s, d):
    """All findings about names, for the headers of all customers at once."""
    return detect.header_findings(_headers(s, d))


# ---- sizes --------------------------------------------------------------------------------------


@_query("WITH t AS (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) * CAST(pow(1024, doc_id % 5) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL) SELECT doc_id, size, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1024 ** 2 THEN format('{:.1f} KB', size / 1024) WHEN size < 1024 ** 3 THEN format('{:.1f} MB', size / 1024 ** 2) WHEN size < 1024 ** 4 THEN format('{:.1f} GB', size / 1024 ** 3) ELSE format('{:.1f} TB', size / 1024 ** 4) END AS shown FROM t")
def util_size(s, d):
    """The size of each text, times a power of 1024 by its id, so that all units occur."""
    size = F.octet_length("text").cast("long") * F.pow(F.lit(1024), F.col("doc_id") % 5).cast("long")
    return base.table(s, d, "documents").filter("text is not null").select("doc_id", size.alias("size")).select("doc_id", "size", E.shown_size(F.col("size")).alias("shown"))


# ---- overrides: a choice for each order ---------------------------------------------------------

_LABELS_ = [*C.OVERRIDE_OPTIONS, "no such label"]
_KINDS_ = [C.DECIMAL, C.FREE_TEXT, C.EMAIL, C.CATEGORICAL]
_CHOICES = f"c AS (SELECT 'column_' || o_orderkey AS column_name, {_d_pick('o_custkey', _KINDS_)} AS inferred_type, {_d_pick('o_orderkey', _LABELS_)} AS label, o_orderkey AS k FROM orders), o(label, logical_type) AS (VALUES {_values(list(C.OVERRIDE_OPTIONS.items()))})"


def _choices(s: SparkSession, d: str) -> DataFrame:
    return base.table(s, d, "orders").select(F.concat(F.lit("column_"), F.col("o_orderkey").cast("string")).alias("column_name"), _pick("o_custkey", _KINDS_).alias("inferred_type"), _pick("o_orderkey", _LABELS_).alias("label"), F.col("o_orderkey").alias("k"))


@_query(f"WITH {_CHOICES} SELECT column_name, c.label, logical_type FROM c LEFT JOIN o ON o.label = c.label")
def ovr_options(s, d):
    return _choices(s, d).select("column_name", "label", overrides.option(F.col("label")).alias("logical_type"))


@_query(f"WITH {_CHOICES} SELECT column_name AS original_name, coalesce(CASE WHEN k % 3 <> 0 THEN logical_type END, inferred_type) AS effective_logical_type FROM c LEFT JOIN o ON o.label = c.label")
def ovr_apply(s, d):
    """Columns of all orders; those of every third have no choice."""
    made = _choices(s, d)
    profiles = made.select(F.col("column_name").alias("original_name"), F.col("inferred_type").alias("logical_type"), F.col("inferred_type").alias("effective_logical_type"))
    return overrides.override_frame(profiles, made.filter("k % 3 <> 0").select("column_name", "label")).select("original_name", "effective_logical_type")


@_query(f"WITH {_CHOICES} SELECT column_name, inferred_type, coalesce(logical_type, inferred_type) AS effective_type, coalesce(logical_type, inferred_type) <> inferred_type AS changed FROM c LEFT JOIN o ON o.label = c.label")
def ovr_record(s, d):
    return overrides.override_log(_choices(s, d), "run", base.NOW).select("column_name", "inferred_type", "effective_type", "changed")


# ---- strategies on offer, by orders: each has a column of some type -----------------------------

_KINDS = ("Integer", "Decimal", "Possible currency", "Numeric stored as text", "Categorical", "Free text", "Boolean", "Date", "Datetime", "Date stored as text", "Email", "Phone number", "URL", "Possible identifier", "Mixed type", "Unknown", "Empty")
_NUMBERS = _KINDS[:4]


def _offers(s: SparkSession, d: str, offered: Callable[[str], list[str]]) -> DataFrame:
    offers = s.createDataFrame([(k, i, x) for k in _KINDS for i, x in enumerate(offered(k))], "kind string, place int, strategy string")
    return base.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), _pick("o_orderkey", _KINDS).alias("kind")).join(F.broadcast(offers), "kind").select("id", "kind", "place", "strategy")


def _offers_sql(rows: dict[tuple[str, ...], str]) -> str:
    values = ", ".join(f"('{k}', {i}, '{x}')" for kinds, listed in rows.items() for k in kinds for i, x in enumerate(listed.split()))
    return f"SELECT o_orderkey AS id, kind, CAST(place AS INT) AS place, strategy FROM orders JOIN (VALUES {values}) AS v(kind, place, strategy) ON kind = {_d_pick('o_orderkey', _KINDS)}"


@_query(_offers_sql({
    _NUMBERS: "keep_null mean median mode zero custom per_row", ("Categorical",): "keep_null mode unknown custom per_row", ("Free text",): "keep_null unknown not_provided custom per_row", ("Boolean",): "keep_null true false mode per_row",
    ("Date", "Datetime", "Date stored as text"): "keep_null custom per_row", ("Email", "Phone number", "URL", "Possible identifier"): "keep_null per_row",
}))
def cat_missing(s, d):
    return _offers(s, d, strategies.missing_strategies)


@_query(_offers_sql({_NUMBERS: "keep null median cap custom do_nothing"}))
def cat_outlier(s, d):
    return _offers(s, d, strategies.outlier_strategies)


@_query(_offers_sql({_NUMBERS: "valid invalid"}) + " UNION ALL " + _offers_sql({_NUMBERS: "null zero median custom"}))
def cat_negative(s, d):
    return _offers(s, d, lambda k: strategies.negative_strategies(k, False)).unionByName(_offers(s, d, lambda k: strategies.negative_strategies(k, True)))


@_query(_offers_sql({("Categorical",): "keep most_frequent select_canonical custom do_nothing"}))
def cat_variants(s, d):
    return _offers(s, d, lambda k: strategies.variant_strategies() if k == "Categorical" else [])
