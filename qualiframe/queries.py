"""Registered queries of the data-quality engine, with SQL twins for DuckDB.

Most tables given are clean, so many queries read ``MESSY``: customers with defects planted by fixed
rules, in SQL that both engines take as it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from . import store
from .functions import expr as E
from .functions import names as N
from .operators import clean, compare, detect, overrides, profile, ranks, score, strategies
from .plans import engine
from .sources.files import folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = "2026-01-01 00:00:00"


def _text(c: str) -> str:
    return f"CAST({c} AS VARCHAR(20))"


_K = "c_custkey"
_COLUMNS = {
    "segment": f"CASE WHEN {_K} % 29 = 0 THEN NULL WHEN {_K} % 23 = 0 THEN '' WHEN {_K} % 19 = 0 THEN '   ' WHEN {_K} % 17 = 0 THEN 'N/A' WHEN {_K} % 13 = 0 THEN lower(c_mktsegment) WHEN {_K} % 11 = 0 THEN '  ' || c_mktsegment WHEN {_K} % 7 = 0 THEN replace(lower(c_mktsegment), 'i', '-i') ELSE c_mktsegment END",
    "amount_text": f"CASE WHEN {_K} % 31 = 0 THEN 'abc' WHEN {_K} % 37 = 0 THEN NULL WHEN {_K} % 6 = 0 THEN '1.234,50' WHEN {_K} % 43 = 0 THEN '99999.5' ELSE {_text('c_nationkey')} || '.25' END",
    "signup": f"CASE WHEN {_K} % 41 = 0 THEN 'not-a-date' WHEN {_K} % 97 = 0 THEN '1850-03-05' WHEN {_K} % 101 = 0 THEN '2150-01-01' WHEN {_K} % 5 = 0 THEN '01/' || lpad({_text('c_nationkey % 28 + 1')}, 2, '0') || '/2023' ELSE '2023-01-' || lpad({_text('c_nationkey % 28 + 1')}, 2, '0') END",
    "score": f"CASE WHEN {_K} % 53 = 0 THEN NULL WHEN {_K} % 59 = 0 THEN CAST(1000000.5 AS DOUBLE) WHEN {_K} % 61 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE c_acctbal END",
    "customer_id": f"CASE WHEN {_K} % 47 = 0 THEN 'CUST-000001' WHEN {_K} % 37 = 0 THEN NULL WHEN {_K} % 33 = 0 THEN 'X' || {_text(_K)} ELSE 'CUST-' || lpad({_text(_K)}, 6, '0') END",
    "note": f"CASE WHEN {_K} % 9 = 0 THEN 'wide  gap ' || repeat('very ', CAST({_K} % 7 AS INT)) || c_name || ' ' WHEN {_K} % 21 = 0 THEN 'bell' || chr(7) || repeat('very ', CAST({_K} % 7 AS INT)) || c_name ELSE 'note ' || repeat('very ', CAST({_K} % 7 AS INT)) || c_name END",
    "email": f"CASE WHEN {_K} % 10 = 0 THEN 'bad' ELSE 'user' || {_text(_K)} || '@example.com' END",
    "phone": f"'+1 555-010-' || lpad({_text(_K + ' % 10000')}, 4, '0')",
    "flag": f"CASE WHEN {_K} % 2 = 0 THEN 'Yes' ELSE 'no' END",
    "mixture": f"CASE WHEN {_K} % 2 = 0 THEN {_text(_K)} ELSE 'A' || {_text(_K)} END",
    "site": f"CASE WHEN {_K} % 20 = 0 THEN 'none' ELSE 'https://example.com/' || {_text(_K)} END",
    "price": f"'$' || {_text(_K + ' % 900')} || '.50'",
    "steady": "CAST(7 AS BIGINT)",
}
_LIST = ", ".join(f"CASE WHEN {_K} % 500 = 0 THEN NULL ELSE {e} END AS {n}" for n, e in _COLUMNS.items())
MESSY = f"SELECT {_K} AS _row_id, {_LIST}, CAST(NULL AS VARCHAR(5)) AS nothing FROM {{customer}} UNION ALL SELECT {_K} + 1000000 AS _row_id, {_LIST}, CAST(NULL AS VARCHAR(5)) AS nothing FROM {{customer}} WHERE {_K} % 50 = 0"
_WITH = f"WITH m AS ({MESSY.replace('{customer}', 'customer')})"
TEXT_COLUMNS = [*[n for n in _COLUMNS if n not in ("score", "steady")], "nothing"]
ALL_COLUMNS = [*_COLUMNS, "nothing"]
TYPES = {
    "segment": C.CATEGORICAL, "amount_text": C.NUMERIC_TEXT, "signup": C.DATE_TEXT, "score": C.DECIMAL, "customer_id": C.IDENTIFIER, "note": C.FREE_TEXT, "email": C.EMAIL, "phone": C.PHONE,
    "flag": C.BOOLEAN, "mixture": C.MIXED, "site": C.URL, "price": C.CURRENCY, "steady": C.INTEGER, "nothing": C.EMPTY,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    # varchar(n) of the shared SQL is plain text in a frame
    df = spark.sql(MESSY, customer=table(spark, sf_dir, "customer"))
    return df.select(*[F.col(f.name).cast("string").alias(f.name) if f.dataType.simpleString().startswith(("varchar", "string")) else F.col(f.name) for f in df.schema])


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


# ---- SQL twins of the scalar rules -------------------------------------------------------------


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def d_strip(c: str) -> str:
    return f"regexp_replace({c}, {q(E.STRIP)}, '', 'g')"


def d_match(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def d_clean(c: str) -> str:
    s = d_strip(c)
    bare = f"regexp_replace(CASE WHEN {d_match(s, '(?s)^[(].*[)]$')} THEN regexp_extract({s}, {q('(?s)^[(](.*)[)]$')}, 1) ELSE {s} END, {q(E.NUMBER_MARKS)}, '', 'g')"
    return f"(CASE WHEN {d_match(s, '(?s)^[(].*[)]$')} AND {bare} <> '' AND NOT starts_with({bare}, '-') THEN '-' || {bare} ELSE {bare} END)"


def d_number(c: str) -> str:
    return f"({d_match(d_clean(c), E.NUMBER)} OR {d_match(d_clean(c), E.SPECIAL_NUMBER)})"


def d_value(c: str) -> str:
    return f"(CASE WHEN {d_match(d_clean(c), E.NUMBER)} THEN TRY_CAST({d_clean(c)} AS DOUBLE) END)"


def d_phone(c: str) -> str:
    marks = r"[\s\-().]"
    return d_match(f"regexp_replace({d_strip(c)}, {q(marks)}, '', 'g')", E.PHONE)


def d_date(c: str) -> str:
    return f"coalesce(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%m/%d/%Y'))"


def d_bool(c: str) -> str:
    return f"lower({d_strip(c)}) IN ({', '.join(q(b) for b in E.BOOLEANS)})"


_TOKENS = ", ".join(q(t) for t in C.PLACEHOLDERS)
D_PRINTABLE = r"[\x{0}-\x{8}\x{b}-\x{1f}\x{7f}-\x{a0}\x{ad}\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]"


def d_ladder(ratio: str, cutoffs: tuple[float, float, float]) -> str:
    return f"CASE WHEN {ratio} < {cutoffs[0]} THEN 'Low' WHEN {ratio} < {cutoffs[1]} THEN 'Medium' WHEN {ratio} < {cutoffs[2]} THEN 'High' ELSE 'Critical' END"


# ---- scalar functions --------------------------------------------------------------------------


def _scalar(name: str, column: str, spark_expr, sql_expr: str, alias: str = "value"):
    QUERIES[name] = lambda s, d: messy(s, d).select("_row_id", F.col(column), spark_expr(F.col(column)).alias(alias))
    SQL[name] = f"{_WITH} SELECT _row_id, {column}, {sql_expr} AS {alias} FROM m"


_scalar("fn_trim", "segment", E.strip, d_strip("segment"))
_scalar("fn_collapse_ws", "note", E.collapse, d_strip(f"regexp_replace(note, {q(E.WS + '+')}, ' ', 'g')"))
_scalar("fn_printable", "note", E.printable, f"regexp_replace(note, {q(D_PRINTABLE)}, '', 'g')")
_scalar("fn_clean_num", "amount_text", E.clean_number, d_clean("amount_text"))
_scalar("fn_is_num", "amount_text", E.is_number, d_number("amount_text"))
_scalar("fn_to_numeric", "amount_text", E.to_number, d_value("amount_text"))
_scalar("fn_to_date", "signup", lambda c: E.parse_date(c).cast("string"), f"strftime({d_date('signup')}, '%Y-%m-%d')")
_scalar("fn_date_shape", "signup", E.date_shape, "regexp_replace(signup, '[0-9]', 'D', 'g')")
_scalar("pred_boolean", "flag", E.is_boolean, d_bool("flag"))
_scalar("pred_email", "email", lambda c: E.strip(c).rlike(E.EMAIL), d_match(d_strip("email"), E.EMAIL))
_scalar("pred_url", "site", lambda c: E.strip(c).rlike(E.URL), d_match(d_strip("site"), E.URL))
_scalar("pred_phone", "phone", E.is_phone, d_phone("phone"))
_scalar("pred_phone_punct", "phone", E.has_phone_marks, d_match(d_strip("phone"), E.PHONE_PUNCTUATION))
_scalar("pred_currency", "price", lambda c: E.strip(c).rlike(E.CURRENCY), d_match(d_strip("price"), E.CURRENCY))
_scalar("pred_date_like", "signup", lambda c: E.strip(c).rlike(E.DATE_LIKE), d_match(d_strip("signup"), E.DATE_LIKE))
_scalar("pred_numeric", "mixture", E.is_number, d_number("mixture"))
_scalar("cfg_placeholders", "segment", E.is_placeholder, f"lower({d_strip('segment')}) IN ({_TOKENS})")
_scalar("phys_na", "segment", lambda c: F.when(~c.isin(*C.NA_TOKENS), c), f"CASE WHEN segment NOT IN ({', '.join(q(t) for t in C.NA_TOKENS)}) THEN segment END")
_scalar("fn_norm_col", "note", N.normalized, f"coalesce(nullif(regexp_replace(regexp_replace(lower({d_strip('note')}), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'column')")
_scalar("fn_decimals", "score", lambda c: F.abs(F.round(c * 100, 0) / 100 - c) < 1e-9, "abs(round(score * 100, 0) / 100 - score) < 1e-9")


@query(f"{_WITH} SELECT _row_id, length(customer_id) AS length, regexp_matches(customer_id, '[A-Za-z]') AS letters, regexp_matches(customer_id, '[0-9]') AS digits FROM m WHERE customer_id IS NOT NULL")
def fn_signature(s, d):
    return messy(s, d).filter("customer_id is not null").select("_row_id", E.signature(F.col("customer_id")).alias("x")).select("_row_id", "x.*")


@query(f"{_WITH}, v AS (SELECT {d_strip('customer_id')} AS v FROM m WHERE {d_strip('customer_id')} <> ''), s AS (SELECT length(v) a, regexp_matches(v, '[A-Za-z]') b, regexp_matches(v, '[0-9]') c, count(*) n FROM v GROUP BY ALL) SELECT max(n) / sum(n) AS consistency FROM s")
def fn_fmt_consistency(s, d):
    v = messy(s, d).select(E.strip(F.col("customer_id")).alias("v")).filter("v <> ''")
    return v.groupBy(E.signature(F.col("v")).alias("x")).count().agg((F.max("count") / F.sum("count")).alias("consistency"))


@query(f"{_WITH} SELECT CAST(sum(CASE WHEN {d_match(d_strip('email'), E.EMAIL)} THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS rate FROM m WHERE {d_strip('email')} <> ''")
def fn_match_rate(s, d):
    return messy(s, d).filter(E.strip(F.col("email")) != "").agg((F.sum(E.strip(F.col("email")).rlike(E.EMAIL).cast("int")) / F.count(F.lit(1))).alias("rate"))


@query(f"SELECT l_orderkey, l_linenumber, {d_ladder('l_discount', (0.02, 0.05, 0.08))} AS severity FROM lineitem")
def fn_ratio_sev(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", E.ratio_severity(F.col("l_discount"), (0.02, 0.05, 0.08)).alias("severity"))


def _d_rank(c: str) -> str:
    return f"CASE {c} WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END"


_EVENTS = "SELECT event_id, {} AS a, {} AS b FROM events".format(*[d_ladder(x, (10, 50, 100)) for x in ("value", "CAST(user_id % 150 AS DOUBLE)")])


@query(f"WITH e AS ({_EVENTS}) SELECT event_id, {_d_rank('a')} AS rank_a, CASE WHEN {_d_rank('a')} >= {_d_rank('b')} THEN a ELSE b END AS larger FROM e")
def fn_max_sev(s, d):
    e = table(s, d, "events").select("event_id", E.ratio_severity(F.col("value"), (10, 50, 100)).alias("a"), E.ratio_severity((F.col("user_id") % 150).cast("double"), (10, 50, 100)).alias("b"))
    a, b = E.severity_rank(F.col("a")), E.severity_rank(F.col("b"))
    return e.select("event_id", a.alias("rank_a"), F.when(a >= b, F.col("a")).otherwise(F.col("b")).alias("larger"))


QUERIES["fn_sev_rank"], SQL["fn_sev_rank"] = QUERIES["fn_max_sev"], SQL["fn_max_sev"]

# ---- detection ---------------------------------------------------------------------------------


def _cell(rule: str, column: str, condition: str, severity: str, current: str = "NULL", suggested: str = "NULL", confidence: float | None = None) -> str:
    confidence = C.ISSUES[rule][1] if confidence is None else confidence
    return f"SELECT '{rule}' AS issue_type, {severity} AS severity, CAST({confidence} AS DOUBLE) AS confidence, '{column}' AS column_name, _row_id AS row_index, CAST({current} AS VARCHAR) AS current_value, CAST({suggested} AS VARCHAR) AS suggested_value FROM m WHERE {condition}"


def _ratio(condition: str, cutoffs=C.MISSING_CUTOFFS) -> str:
    return f"(SELECT {d_ladder(f'count(*) FILTER (WHERE {condition}) / count(*)', cutoffs)} FROM m)"


def _whole(rule: str, column: str | None, severity: str, confidence: str, having: str = "true") -> str:
    name = "NULL" if column is None else f"'{column}'"
    return f"SELECT '{rule}', {severity}, CAST({confidence} AS DOUBLE), {name}, NULL, NULL, NULL FROM m HAVING {having}"


def _ranked(column: str, key: str, where: str) -> str:
    """Values with the most frequent of their key; the first seen on a tie."""
    return f"SELECT v, k, first_value(v) OVER (PARTITION BY k ORDER BY n DESC, seen) AS best, count(*) OVER (PARTITION BY k) AS variants, f FROM (SELECT {column} AS v, {key} AS k, lower({d_strip(column)}) AS f, count(*) AS n, min(_row_id) AS seen FROM m WHERE {where} GROUP BY ALL)"


def _numeric_text(c: str) -> str:
    return d_value(c) if c in TEXT_COLUMNS else c


def _detection_sql(columns: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    text = [c for c in columns if c in TEXT_COLUMNS]

    def add(rule: str, sql: str) -> None:
        out.setdefault(rule, []).append(sql)

    every = " AND ".join(f"{c} IS NULL" for c in columns)
    add("empty_row", f"SELECT 'empty_row', {_ratio(every, C.EMPTY_ROW_CUTOFFS)}, CAST(1.0 AS DOUBLE), NULL, _row_id, NULL, NULL FROM m WHERE {every}")
    add("exact_duplicate_row", f"SELECT 'exact_duplicate_row', (SELECT {d_ladder('count(*) FILTER (WHERE nth > 1) / count(*)', C.DUPLICATE_CUTOFFS)} FROM d), CAST(1.0 AS DOUBLE), NULL, _row_id, NULL, NULL FROM d WHERE nth > 1")
    for c in columns:
        add("missing_null", _cell("missing_null", c, f"{c} IS NULL", _ratio(f"{c} IS NULL")))
        add("empty_column", _whole("empty_column", c, "'High'", "1.0", f"count({c}) = 0"))
    for c in text:
        s = d_strip(c)
        for rule, test in (("blank_string", f"{c} = ''"), ("whitespace_only_string", f"{s} = '' AND {c} <> ''"), ("missing_placeholder", f"lower({s}) IN ({_TOKENS}) AND {s} <> ''")):
            add(rule, _cell(rule, c, test, _ratio(test), c))
    for c in [c for c in text if TYPES[c] in C.TEXT_TYPES]:
        s = d_strip(c)
        add("leading_trailing_whitespace", _cell("leading_trailing_whitespace", c, f"{c} <> {s}", "'Low'", c, s))
        collapsed = d_strip(f"regexp_replace({c}, {q(E.WS + '+')}, ' ', 'g')")
        add("repeated_internal_spaces", _cell("repeated_internal_spaces", c, d_match(s, E.WS + "{2,}"), "'Low'", c, collapsed))
        shown = f"regexp_replace({c}, {q(D_PRINTABLE)}, '', 'g')"
        add("non_printable_characters", _cell("non_printable_characters", c, f"{c} <> {shown}", "'Medium'", c, shown))
    keyed = _ranked("segment", "regexp_replace(lower(segment), '[^a-z0-9]', '', 'g')", "segment IS NOT NULL")
    similar = f"(SELECT v, k, best FROM (SELECT *, (SELECT count(DISTINCT f) FROM ({keyed}) y WHERE y.k = x.k) AS folds FROM ({keyed}) x) WHERE k <> '' AND variants > 1 AND folds > 1)"
    add("similar_category_values", f"SELECT 'similar_category_values', 'Medium', CAST(0.75 AS DOUBLE), 'segment', _row_id, segment, best FROM m JOIN {similar} x ON m.segment = x.v WHERE segment <> best")
    for c in ("segment", "customer_id", "note"):
        folded = _ranked(c, f"lower({d_strip(c)})", f"{c} IS NOT NULL")
        skip = f" AND {c} NOT IN (SELECT v FROM {similar})" if c == "segment" else ""
        add("inconsistent_capitalization", f"SELECT 'inconsistent_capitalization', 'Low', CAST(0.8 AS DOUBLE), '{c}', _row_id, {c}, best FROM m JOIN ({folded}) x ON m.{c} = x.v WHERE variants > 1 AND {c} <> best{skip}")
    for c in ("amount_text", "score", "price", "steady"):
        v = _numeric_text(c)
        finite = f"abs({v}) <> CAST('Infinity' AS DOUBLE)"
        shown = c if c in TEXT_COLUMNS else f"CASE WHEN {c} = CAST('Infinity' AS DOUBLE) THEN 'Infinity' ELSE CAST({c} AS VARCHAR) END"
        add("infinite_value", _cell("infinite_value", c, f"abs({v}) = CAST('Infinity' AS DOUBLE)", "'Critical'", shown))
        add("negative_value", _cell("negative_value", c, f"{finite} AND {v} < 0", "'Low'", shown))
        fence = f"(SELECT quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.75) AS q3 FROM m WHERE {finite})"
        add("possible_outlier", _cell("possible_outlier", c, f"{finite} AND (SELECT q3 > q1 AND ({v} < q1 - 1.5 * (q3 - q1) OR {v} > q3 + 1.5 * (q3 - q1)) FROM {fence})", "'Low'", shown))
        add("suspiciously_constant_column", _whole("suspiciously_constant_column", c, "'Low'", "0.6", f"count({v}) FILTER (WHERE {finite}) >= 2 AND count(DISTINCT {v}) FILTER (WHERE {finite}) = 1"))
    for c in ("amount_text", "price"):
        s = d_strip(c)
        counts = f"(SELECT count(*) FILTER (WHERE {d_match(s, E.DOT_DECIMAL)}) AS dots, count(*) FILTER (WHERE {d_match(s, E.COMMA_DECIMAL)}) AS commas FROM m)"
        test = f"(SELECT dots > 0 AND commas > 0 AND CASE WHEN dots <= commas THEN {d_match(s, E.DOT_DECIMAL)} ELSE {d_match(s, E.COMMA_DECIMAL)} END FROM {counts})"
        add("numeric_format_inconsistency", _cell("numeric_format_inconsistency", c, test, "'Medium'", s))
    add("value_fails_type_conversion", _cell("value_fails_type_conversion", "amount_text", f"NOT {d_number('amount_text')}", "'Medium'", "amount_text"))
    add("unexpected_text_in_numeric_column", _cell("unexpected_text_in_numeric_column", "mixture", f"NOT {d_number('mixture')} AND {d_strip('mixture')} <> ''", "'High'", "mixture"))
    day = d_date("signup")
    add("invalid_date", _cell("invalid_date", "signup", f"signup IS NOT NULL AND {day} IS NULL", "'High'", "signup"))
    add("unusually_old_date", _cell("unusually_old_date", "signup", f"{day} < TIMESTAMP '{NOW}' - INTERVAL '100' YEAR", "'Low'", "signup"))
    add("unusually_future_date", _cell("unusually_future_date", "signup", f"{day} > TIMESTAMP '{NOW}' + INTERVAL '5' YEAR", "'Low'", "signup"))
    main = f"(SELECT regexp_replace(signup, '[0-9]', 'D', 'g') AS shape FROM m WHERE {day} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, min(_row_id) LIMIT 1)"
    add("mixed_date_formats", _cell("mixed_date_formats", "signup", f"{day} IS NOT NULL AND regexp_replace(signup, '[0-9]', 'D', 'g') <> {main}", "'Medium'", "signup"))
    ident = d_strip("customer_id")
    add("identifier_missing_values", _whole("identifier_missing_values", "customer_id", f"CASE {d_ladder('count(*) FILTER (WHERE customer_id IS NULL) / count(*)', C.MISSING_CUTOFFS)} WHEN 'Low' THEN 'Medium' ELSE {d_ladder('count(*) FILTER (WHERE customer_id IS NULL) / count(*)', C.MISSING_CUTOFFS)} END", "1.0", "count(customer_id) < count(*)"))
    add("identifier_duplicate_value", _cell("identifier_duplicate_value", "customer_id", f"{ident} IN (SELECT {ident} FROM m WHERE customer_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)", "'Medium'", ident))
    sign = f"(length({ident}) || '/' || regexp_matches({ident}, '[A-Za-z]') || '/' || regexp_matches({ident}, '[0-9]'))"
    common = f"(SELECT {sign} FROM m WHERE customer_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, min(_row_id) LIMIT 1)"
    add("identifier_inconsistent_format", _cell("identifier_inconsistent_format", "customer_id", f"customer_id IS NOT NULL AND {sign} <> {common}", "'Low'", ident))
    for rule, c, severity, rate in (
        ("numeric_stored_as_text", "amount_text", "Medium", f"round(avg(CASE WHEN {d_number('amount_text')} THEN 1.0 ELSE 0.0 END) FILTER (WHERE {d_strip('amount_text')} <> ''), 3)"),
        ("date_stored_as_text", "signup", "Medium", f"round(avg(CASE WHEN {day} IS NOT NULL THEN 1.0 ELSE 0.0 END) FILTER (WHERE {d_strip('signup')} <> ''), 3)"),
        ("mixed_data_types", "mixture", "High", f"round(1 - abs(2 * avg(CASE WHEN {d_number('mixture')} THEN 1.0 ELSE 0.0 END) FILTER (WHERE {d_strip('mixture')} <> '') - 1), 3)"),
    ):
        add(rule, _whole(rule, c, f"'{severity}'", rate))
    return out


def _dup_sql(columns: list[str]) -> str:
    return f"d AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(columns)} ORDER BY _row_id) AS nth FROM m)"


_DUP = _dup_sql(ALL_COLUMNS)
_HEAD = "h(issue_type, severity, confidence, column_name, row_index, current_value, suggested_value)"
DETECTION = _detection_sql(ALL_COLUMNS)
_ALL_ISSUES = " UNION ALL ".join(x for rows in DETECTION.values() for x in rows)
# Names are all of one style but for single words, so no finding is about names.
ISSUES_CTE = f"{_WITH}, {_DUP}, {_HEAD} AS ({_ALL_ISSUES})"
ISSUE_COLUMNS = ["issue_type", "severity", "confidence", "column_name", "row_index", "current_value", "suggested_value"]


def dealt(df: DataFrame) -> DataFrame:
    """A derived table, read by several passes that are busy with patterns: dealt to all cores once, as its file may be one task; equal plans share one cached copy."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, "_row_id").persist()


def analysis(s: SparkSession, d: str) -> engine.Analysis:
    return engine.analyze(dealt(messy(s, d)), now=NOW)


def cleaned(s: SparkSession, d: str) -> engine.Session:
    return engine.Session(analysis(s, d)).apply([f.fix_id for f in clean.FIXES if not f.needs_approval and f.fix_id not in ("normalize_columns", "convert_dates", "convert_numbers")], now=NOW)


def _given_types(names: list[str]) -> list[profile.ColumnProfile]:
    return [profile.ColumnProfile(n, n, "", TYPES[n], 1.0, 0, 0, 0.0, 0, 0.0, 0, effective_logical_type=TYPES[n], evidence={"dominant": "numeric"}) for n in names]


def _rule(rule: str) -> Query:
    """One rule on its own columns: its plan has nothing of the other rules."""
    def run(s: SparkSession, d: str) -> DataFrame:
        profiles = _given_types(_rule_columns(rule))
        df = dealt(messy(s, d).select("_row_id", *[p.original_name for p in profiles]))
        return detect.detect(df, profiles, now=NOW, only={rule}).select(*ISSUE_COLUMNS)

    return run


def _rule_columns(rule: str) -> list[str]:
    if rule in ("empty_row", "exact_duplicate_row", "missing_null", "empty_column"):
        return ALL_COLUMNS
    if rule in ("blank_string", "whitespace_only_string", "missing_placeholder"):
        return TEXT_COLUMNS
    kinds = {
        "leading_trailing_whitespace": C.TEXT_TYPES, "repeated_internal_spaces": C.TEXT_TYPES, "non_printable_characters": C.TEXT_TYPES, "similar_category_values": (C.CATEGORICAL,),
        "inconsistent_capitalization": (C.CATEGORICAL, C.IDENTIFIER, C.FREE_TEXT), "infinite_value": C.NUMERIC_TYPES, "negative_value": C.NUMERIC_TYPES, "possible_outlier": C.NUMERIC_TYPES,
        "suspiciously_constant_column": C.NUMERIC_TYPES, "numeric_format_inconsistency": (C.NUMERIC_TEXT, C.CURRENCY), "value_fails_type_conversion": (C.NUMERIC_TEXT,), "unexpected_text_in_numeric_column": (C.MIXED,),
        "invalid_date": C.DATE_TYPES, "unusually_old_date": C.DATE_TYPES, "unusually_future_date": C.DATE_TYPES, "mixed_date_formats": C.DATE_TYPES,
        "identifier_missing_values": (C.IDENTIFIER,), "identifier_duplicate_value": (C.IDENTIFIER,), "identifier_inconsistent_format": (C.IDENTIFIER,),
    }[rule]
    return [n for n in ALL_COLUMNS if TYPES[n] in kinds]


def _type_rule(rule: str) -> Query:
    """A rule about the type of whole columns: only the columns that it tells of are profiled."""
    kind = {"numeric_stored_as_text": C.NUMERIC_TEXT, "date_stored_as_text": C.DATE_TEXT, "mixed_data_types": C.MIXED}[rule]

    def run(s: SparkSession, d: str) -> DataFrame:
        df = dealt(messy(s, d).select("_row_id", *[n for n in ALL_COLUMNS if TYPES[n] == kind]))
        return engine.analyze(df, now=NOW).issues_of({rule}).select(*ISSUE_COLUMNS)

    return run


for _name, _parts in DETECTION.items():
    if _name in ("numeric_stored_as_text", "date_stored_as_text", "mixed_data_types"):
        QUERIES[_name] = _type_rule(_name)
        SQL[_name] = f"{_WITH}, {_HEAD} AS ({_parts[0]}) SELECT * FROM h"
    else:
        QUERIES[_name] = _rule(_name)
        SQL[_name] = f"{_WITH}, {_DUP}, {_HEAD} AS ({' UNION ALL '.join(_parts)}) SELECT * FROM h"


@query(f"{ISSUES_CTE} SELECT * FROM h")
def detect_issues(s, d):
    return analysis(s, d).issues.select(*ISSUE_COLUMNS)


_DIM = ", ".join(f"('{k}', '{v[0]}', {'true' if v[2] else 'false'})" for k, v in C.ISSUES.items())
CATEGORY_CTE = f"{ISSUES_CTE}, c(issue_type, issue_category, safe) AS (VALUES {_DIM}), i AS (SELECT * FROM h JOIN c USING (issue_type))"


@query(f"{CATEGORY_CTE} SELECT 'total' AS dimension, NULL AS value, count(*) AS n FROM i UNION ALL SELECT 'category', issue_category, count(*) FROM i GROUP BY 2 UNION ALL SELECT 'type', issue_type, count(*) FROM i GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM i GROUP BY 2")
def det_summary(s, d):
    return analysis(s, d).summary()


@query(f"{CATEGORY_CTE} SELECT count(*) AS total, count(DISTINCT column_name) AS columns_affected, count(*) FILTER (WHERE severity IN ('High', 'Critical')) AS high_or_critical, count(*) FILTER (WHERE NOT safe) AS needs_review FROM i")
def dash_review_counts(s, d):
    return detect.review_counts(analysis(s, d).issues)


@query(f"{CATEGORY_CTE} SELECT issue_type, column_name, row_index FROM i WHERE column_name IN ('segment', 'score') AND issue_category IN ('Numeric', 'Text') AND severity IN ('Low', 'Critical')")
def iss_filter(s, d):
    return overrides.filter_issues(analysis(s, d).issues, column_name=["segment", "score"], issue_category=["Numeric", "Text"], severity=["Low", "Critical"]).select("issue_type", "column_name", "row_index")


@query(f"{CATEGORY_CTE} SELECT m._row_id, m.segment, m.score FROM m WHERE _row_id IN (SELECT DISTINCT row_index FROM h WHERE column_name = 'score' AND row_index IS NOT NULL ORDER BY row_index LIMIT 50)")
def iss_sample_rows(s, d):
    a = analysis(s, d)
    return overrides.sample_rows(a.df.select("_row_id", "segment", "score"), a.issues.filter("column_name = 'score'"))


_GUIDED = ", ".join(f"'{t}'" for t in C.GUIDED_TYPES)
_FROM_RANK = "CASE max({}) WHEN 3 THEN 'Critical' WHEN 2 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END".format(_d_rank("severity"))


@query(f"{ISSUES_CTE} SELECT column_name, issue_type, current_value AS value FROM h WHERE issue_type = 'inconsistent_capitalization' GROUP BY ALL")
def ui_variant_list(s, d):
    return analysis(s, d).issues_of({"inconsistent_capitalization"}).select("column_name", "issue_type", F.col("current_value").alias("value")).distinct()


# ---- scores ------------------------------------------------------------------------------------

_MAP = ", ".join(f"('{t}', '{n}')" for n, (_, ts) in C.COMPONENTS.items() for t in ts)
_WEIGHT = ", ".join(f"('{n}', CAST({w} AS DOUBLE))" for n, (w, _) in C.COMPONENTS.items())


def _score_cte(issues: str, columns: list[str]) -> str:
    present = " + ".join(f"count({c})" for c in columns)
    return f"""{issues}, map(issue_type, component_name) AS (VALUES {_MAP}), weight(component_name, component_weight) AS (VALUES {_WEIGHT}),
n AS (SELECT count(*) AS n_rows, {len(columns)} AS n_columns, {present} AS n_present FROM m),
k AS (SELECT component_name, CASE WHEN component_name = 'Uniqueness' THEN count(DISTINCT row_index) ELSE count(*) END AS issue_count FROM h JOIN map USING (issue_type) GROUP BY component_name),
p AS (SELECT w.component_name, component_weight, CAST(coalesce(issue_count, 0) AS BIGINT) AS issue_count, CAST(CASE w.component_name WHEN 'Completeness' THEN n_rows * n_columns WHEN 'Uniqueness' THEN n_rows WHEN 'Structural Quality' THEN n_rows + n_columns ELSE n_present END AS BIGINT) AS denominator FROM weight w LEFT JOIN k USING (component_name) CROSS JOIN n),
f AS (SELECT *, CASE WHEN denominator <= 0 THEN 0.0 ELSE least(issue_count / denominator * 100, 100.0) END AS x FROM p),
g AS (SELECT *, round(greatest(100 - x, 0.0), 2) AS component_score FROM f),
score AS (SELECT component_name, component_score, issue_count, denominator, round(x, 2) AS penalty, component_weight, round(component_score * component_weight / 100, 2) AS weighted_contribution FROM g)"""


SCORE_CTE = _score_cte(ISSUES_CTE, ALL_COLUMNS)


@query(f"{SCORE_CTE} SELECT * FROM score")
def score_components(s, d):
    return analysis(s, d).components.drop("calculation_explanation")


def _component_score(name: str) -> Query:
    """One component by the rules that count for it, types given; its plan has nothing of the other rules."""
    def run(s: SparkSession, d: str) -> DataFrame:
        df = dealt(messy(s, d))
        issues = detect.detect(df, _given_types(ALL_COLUMNS), now=NOW, only=set(C.COMPONENTS[name][1]))
        return score.score(df, issues).filter(F.col("component_name") == name).select("component_name", "component_score", "issue_count", "denominator")

    return run


for _component in C.COMPONENTS:
    _key = "score_" + _component.split(" ")[0].lower()
    QUERIES[_key] = _component_score(_component)
    SQL[_key] = f"{SCORE_CTE} SELECT component_name, component_score, issue_count, denominator FROM score WHERE component_name = '{_component}'"


@query(f"{SCORE_CTE} SELECT round(sum(weighted_contribution), 2) AS overall_score FROM score")
def score_overall(s, d):
    return analysis(s, d).overall


@query("SELECT o_orderkey, round(greatest(100 - least(o_custkey / o_orderkey * 100, 100.0), 0.0), 2) AS score FROM orders WHERE o_orderkey > 0")
def score_ratio(s, d):
    o = table(s, d, "orders").filter("o_orderkey > 0")
    return o.select("o_orderkey", E.score_of(F.col("o_custkey"), F.col("o_orderkey"))[0].alias("score"))


# ---- profiles ----------------------------------------------------------------------------------


def _profile_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS non_null_count, count(*) - count({c}) AS missing_count, CAST(round(100.0 * (count(*) - count({c})) / count(*), 2) AS DOUBLE) AS missing_pct, count(DISTINCT {c}) AS unique_count, greatest(count({c}) - count(DISTINCT {c}), 0) AS duplicate_value_count FROM {source}" for c in columns
    )


@query(f"{_WITH} {_profile_sql('m', ALL_COLUMNS)}")
def agg_count_missing(s, d):
    table_ = profile.profile_frame(s, profile.profile(messy(s, d)))
    return table_.select(F.col("original_name").alias("column_name"), "non_null_count", "missing_count", "missing_pct", "unique_count", "duplicate_value_count")


@query("SELECT 'l_quantity' AS column_name, count(DISTINCT l_quantity) AS unique_count FROM lineitem UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate) FROM lineitem")
def agg_unique(s, d):
    df = table(s, d, "lineitem").select(F.monotonically_increasing_id().alias("_row_id"), "l_quantity", "l_returnflag", "l_shipdate")
    return profile.value_table(df).groupBy("column").agg(F.count(F.lit(1)).alias("unique_count")).select(F.col("column").alias("column_name"), "unique_count")


@query(f"{_WITH}, v AS (SELECT signup AS value, min(_row_id) AS first_row FROM m WHERE signup IS NOT NULL GROUP BY 1 ORDER BY 2 LIMIT 5) SELECT value, row_number() OVER (ORDER BY first_row) AS place FROM v")
def agg_examples(s, d):
    found = profile.distinct_aggregates(profile.value_table(messy(s, d), ["signup"]))[0].select(F.posexplode("examples").alias("at", "value"))
    return found.select("value", (F.col("at") + 1).cast("long").alias("place"))


@query("SELECT 'p_retailprice' AS column_name, min(p_retailprice) AS min_value, max(p_retailprice) AS max_value, round(avg(CAST(p_retailprice AS DECIMAL(18, 6))), 2) AS mean, round(median(p_retailprice), 4) AS median FROM part UNION ALL SELECT 'c_acctbal', min(c_acctbal), max(c_acctbal), round(avg(CAST(c_acctbal AS DECIMAL(18, 6))), 2), round(median(c_acctbal), 4) FROM customer")
def agg_numeric(s, d):
    out = None
    for t, c in (("part", "p_retailprice"), ("customer", "c_acctbal")):
        df = table(s, d, t).select(F.monotonically_increasing_id().alias("_row_id"), c)
        one = df.agg(*profile.plain_aggregates(df)).select(F.lit(c).alias("column_name"), F.col("0_min").alias("min_value"), F.col("0_max").alias("max_value"), F.round("0_mean", 2).alias("mean"), F.round(F.lit(ranks.percentiles_of(df, {c: F.col(c)})[c][1]), 4).alias("median"))
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH s AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) SELECT count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outlier_count FROM events CROSS JOIN s")
def agg_iqr_outliers(s, d):
    p = profile.profile(table(s, d, "events").select(F.col("event_id").alias("_row_id"), "value"))
    return s.createDataFrame([(p[0].outlier_count,)], "outlier_count long")


@query("SELECT CAST(min(o_orderdate) AS VARCHAR) AS min_date, CAST(max(o_orderdate) AS VARCHAR) AS max_date FROM orders")
def agg_dates(s, d):
    df = table(s, d, "orders").select(F.col("o_orderkey").alias("_row_id"), "o_orderdate")
    return df.agg(*profile.plain_aggregates(df)).select(F.col("0_min_date").alias("min_date"), F.col("0_max_date").alias("max_date"))


@query("SELECT CAST(min(length(text)) AS BIGINT) AS shortest, CAST(max(length(text)) AS BIGINT) AS longest, round(avg(length(text)), 2) AS average FROM documents")
def agg_text_len(s, d):
    df = table(s, d, "documents").select(F.col("doc_id").alias("_row_id"), "text")
    return df.agg(*profile.plain_aggregates(df)).select(F.col("0_short").cast("long").alias("shortest"), F.col("0_long").cast("long").alias("longest"), F.round("0_length", 2).alias("average"))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10")
def agg_value_counts(s, d):
    return compare.frequent_values(table(s, d, "part"), "p_brand")


_GONE = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in ALL_COLUMNS)


@query(f"{_WITH}, {_DUP} SELECT count(*) AS n_rows, CAST({_GONE} AS BIGINT) AS missing_cells, {len(ALL_COLUMNS)} AS n_columns, count(*) FILTER (WHERE nth > 1) AS duplicate_rows FROM d")
def agg_overview(s, d):
    return compare.overview(messy(s, d))


_RATES = {
    "boolean": d_bool, "email": lambda c: d_match(d_strip(c), E.EMAIL), "url": lambda c: d_match(d_strip(c), E.URL), "phone": d_phone,
    "currency": lambda c: d_match(d_strip(c), E.CURRENCY), "date_like": lambda c: d_match(d_strip(c), E.DATE_LIKE), "numeric": d_number,
}


def _infer_sql(c: str) -> str:
    w = f"{d_strip(c)} <> ''"
    rates = ", ".join(f"count(*) FILTER (WHERE {w} AND {f(c)}) / count(*) FILTER (WHERE {w}) AS r_{k}" for k, f in _RATES.items())
    name = profile.normalize_name(c)
    hint, phone_hint = profile.has_hint(name, C.IDENTIFIER_HINTS), profile.has_hint(name, C.PHONE_HINTS)
    sign = f"(length({d_strip(c)}) || '/' || regexp_matches({d_strip(c)}, '[A-Za-z]') || '/' || regexp_matches({d_strip(c)}, '[0-9]'))"
    share = f"(SELECT max(k) / sum(k) FROM (SELECT count(*) AS k FROM m WHERE {w} GROUP BY {sign}))"
    facts = f"SELECT count({c}) AS present, count(*) FILTER (WHERE {w}) AS n, count(DISTINCT {c}) FILTER (WHERE {w}) AS u, avg(length({d_strip(c)})) FILTER (WHERE {w}) AS len, {share} AS share, count(*) FILTER (WHERE {w} AND {d_date(c)} IS NOT NULL) / count(*) FILTER (WHERE {w}) AS dated, count(*) FILTER (WHERE {w} AND {d_match(d_strip(c), E.PHONE_PUNCTUATION)}) / count(*) FILTER (WHERE {w}) AS marks, {rates} FROM m"
    best = "greatest(" + ", ".join(f"r_{k}" for k in _RATES) + ")"
    ladder = f"""CASE WHEN present = 0 OR n = 0 THEN 'Empty' WHEN r_boolean >= 0.9 AND u <= 4 THEN 'Boolean' WHEN r_email >= 0.8 THEN 'Email' WHEN r_url >= 0.8 THEN 'URL' WHEN r_currency >= 0.7 THEN 'Possible currency'
      WHEN r_date_like >= 0.6 AND dated >= 0.85 THEN 'Date stored as text' WHEN r_numeric >= 0.9 THEN 'Numeric stored as text' WHEN r_phone >= 0.8 AND (marks >= 0.3 OR {phone_hint}) THEN 'Phone number'
      WHEN {best} BETWEEN 0.15 AND 0.85 THEN 'Mixed type' WHEN u / n >= 0.95 AND n >= 5 AND ({hint} OR share >= 0.8) THEN 'Possible identifier'
      WHEN u < n AND (u <= 30 OR u / n <= 0.2) THEN 'Categorical' WHEN len >= 25 OR (u / n >= 0.9 AND len >= 8) THEN 'Free text' ELSE 'Unknown' END"""
    sure = {
        "Empty": "1.0", "Boolean": "r_boolean", "Email": "r_email", "URL": "r_url", "Possible currency": "r_currency", "Date stored as text": "dated", "Numeric stored as text": "r_numeric", "Phone number": "r_phone", "Mixed type": f"1 - abs(2 * {best} - 1)",
        "Possible identifier": f"least(0.5 + 0.25 * {int(hint)} + CASE WHEN share >= 0.8 THEN 0.2 ELSE 0 END, 0.95)", "Categorical": "least(greatest(1 - u / n, 0.5), 0.95)", "Free text": "least(0.5 + len / 100, 0.9)", "Unknown": "0.3",
    }
    confidence = "CASE logical_type " + " ".join(f"WHEN '{k}' THEN CAST({x} AS DOUBLE)" for k, x in sure.items()) + " END"
    return f"SELECT '{c}' AS column_name, logical_type, round({confidence}, 6) AS confidence FROM (SELECT *, {ladder} AS logical_type FROM ({facts}))"


def _whole_profile_sql(c: str) -> str:
    """All figures of one column; of ``score``, which holds an infinity, those that are about numbers are left out."""
    text, kind, none = c in TEXT_COLUMNS, TYPES[c], "CAST(NULL AS DOUBLE)"
    v = _numeric_text(c)
    counted = kind in C.NUMERIC_TYPES and c != "score"
    lengths = text and kind not in (*C.NUMERIC_TYPES, *C.DATE_TYPES, C.EMPTY, C.BOOLEAN)
    inferred = f"SELECT logical_type, confidence FROM ({_infer_sql(c)})" if text else f"SELECT '{kind}' AS logical_type, CAST(1.0 AS DOUBLE) AS confidence"
    examples = f"(SELECT coalesce(array_to_string(list(x ORDER BY seen)[1:5], '|'), '') FROM (SELECT {c} AS x, min(_row_id) AS seen FROM m WHERE {c} IS NOT NULL GROUP BY 1))" if text else "NULL"
    fence = f"(SELECT quantile_cont({v}, 0.25) AS a, quantile_cont({v}, 0.75) AS z FROM m)"
    outliers = f"(SELECT count(*) FILTER (WHERE z > a AND ({v} < a - 1.5 * (z - a) OR {v} > z + 1.5 * (z - a))) FROM m, {fence})" if counted else "CAST(NULL AS BIGINT)"
    numbers = {"min_value": f"CAST(min({v}) AS DOUBLE)", "max_value": f"CAST(max({v}) AS DOUBLE)", "mean": f"round(avg({v}), 4)", "median": f"CAST(round(quantile_cont({v}, 0.5), 4) AS DOUBLE)", "std": f"round(stddev_samp({v}), 4)"}
    texts = {"min_text_length": f"CAST(min(length({c})) AS DOUBLE)", "max_text_length": f"CAST(max(length({c})) AS DOUBLE)", "avg_text_length": f"round(avg(length({c})), 2)"}
    dates = {f"{f}_date": f"strftime({f}({d_date(c)}), '%Y-%m-%d')" if kind in C.DATE_TYPES else "CAST(NULL AS VARCHAR)" for f in ("min", "max")}
    figures = {k: x if counted else none for k, x in numbers.items()} | {k: x if lengths else none for k, x in texts.items()} | dates
    return f"""SELECT p.*, '{c}' AS normalized_name, '{'string' if text else 'double' if c == 'score' else 'bigint'}' AS storage_type, logical_type, confidence, logical_type AS effective_logical_type, false AS type_overridden, CAST(NULL AS VARCHAR) AS user_selected_type,
      CASE WHEN non_null_count = 0 THEN 0.0 ELSE round(unique_count / non_null_count, 3) END AS unique_ratio, {examples} AS examples, {outliers} AS outlier_count, g.*
      FROM ({_profile_sql('m', [c])}) p, ({inferred}) i, (SELECT {', '.join(f'{x} AS {k}' for k, x in figures.items())} FROM m LIMIT 1) g"""


@query(f"{_WITH} {' UNION ALL '.join(_whole_profile_sql(c) for c in ALL_COLUMNS)}")
def prof_df(s, d):
    """The whole profile of each column, examples as one text; numbers of ``score``, which holds an infinity, are left to detection."""
    made = profile.profile_frame(s, profile.profile(messy(s, d)))
    counted = F.col("original_name") != "score"
    return made.select(
        F.col("original_name").alias("column_name"), "normalized_name", "storage_type", "logical_type", F.round("confidence", 6).alias("confidence"), "non_null_count", "missing_count", "missing_pct", "unique_count", "unique_ratio", "duplicate_value_count",
        F.when(F.col("storage_type") == "string", F.array_join("example_values", "|")).alias("examples"), "effective_logical_type", "type_overridden", "user_selected_type", "min_date", "max_date", "min_text_length", "max_text_length", "avg_text_length",
        *[F.when(counted, F.col(n)).alias(n) for n in ("min_value", "max_value", "mean", "median", "std", "outlier_count")])


@query(f"{_WITH} {' UNION ALL '.join(_infer_sql(c) for c in TEXT_COLUMNS)}")
def infer_all(s, d):
    df = messy(s, d).select("_row_id", *TEXT_COLUMNS)
    return profile.profile_frame(s, profile.profile(df)).select(F.col("original_name").alias("column_name"), "logical_type", F.round("confidence", 6).alias("confidence"))


_ACTIONS = ", ".join(f"('{k}', {q(v)})" for k, v in detect.ACTIONS.items())
_TYPED = " UNION ALL ".join(_infer_sql(c) if c in TEXT_COLUMNS else f"SELECT '{c}' AS column_name, '{TYPES[c]}' AS logical_type, CAST(1.0 AS DOUBLE) AS confidence" for c in ALL_COLUMNS)


@query(
    f"""{CATEGORY_CTE}, act(issue_type, recommended_action) AS (VALUES {_ACTIONS}), t AS ({_TYPED}),
    g AS (SELECT column_name, issue_type, {_FROM_RANK} AS severity, count(*) AS n_issues, count(DISTINCT row_index) AS n_rows, min(row_index) AS first_row, max(row_index) AS last_row, min(issue_category) AS issue_category FROM i WHERE issue_type IN ({_GUIDED}) AND column_name <> '' GROUP BY column_name, issue_type)
    SELECT column_name, issue_type, severity, n_issues, n_rows, first_row, last_row, issue_category, recommended_action, coalesce(logical_type, 'Unknown') AS effective_logical_type, coalesce(confidence, 0.0) AS inference_confidence
    FROM g JOIN act USING (issue_type) LEFT JOIN t USING (column_name) ORDER BY {_d_rank('severity')} DESC, n_issues DESC, column_name, issue_type"""
)
def grp_build(s, d):
    """Groups with the profiles of their columns; a category and an action belong to each type."""
    a = analysis(s, d)
    return overrides.group_counts(a.issues, profiles=profile.profile_frame(s, a.types)).withColumn("inference_confidence", F.round("inference_confidence", 6))


@query(f"{_WITH}, t AS ({' UNION ALL '.join(_infer_sql(c) for c in TEXT_COLUMNS)}) SELECT logical_type, count(*) AS n FROM t GROUP BY 1")
def agg_type_counts(s, d):
    return infer_all(s, d).groupBy("logical_type").agg(F.count(F.lit(1)).alias("n"))


_STAT_SQL = "q AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.75) AS c FROM v), mo AS (SELECT x FROM v GROUP BY x ORDER BY count(*) DESC, x LIMIT 1)"


@query(f"WITH v AS (SELECT l_quantity AS x FROM lineitem), {_STAT_SQL} SELECT round(b, 4) AS median, round((SELECT x FROM mo), 4) AS mode, round(a, 4) AS q1, round(c, 4) AS q3, round(c - a, 4) AS iqr, round(a - 1.5 * (c - a), 4) AS lower_fence, round(c + 1.5 * (c - a), 4) AS upper_fence, round((SELECT avg(x) FROM v), 4) AS mean FROM q")
def stat_numeric(s, d):
    return strategies.numeric_stats(table(s, d, "lineitem"), "l_quantity")


@query(f"{_WITH} SELECT segment AS mode FROM m WHERE {d_strip('segment')} <> '' GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1")
def stat_cat_mode(s, d):
    return strategies.categorical_mode(messy(s, d), "segment")


@query(f"{_WITH} SELECT lower(flag) = 'yes' AS mode FROM m WHERE flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def stat_bool_mode(s, d):
    return strategies.boolean_mode(messy(s, d), "flag")


@query(f"{_WITH} SELECT coalesce(bool_and({d_value('amount_text')} IS NOT NULL) FILTER (WHERE amount_text IS NOT NULL), true) AS converts FROM m")
def stat_safe_convert(s, d):
    return strategies.converts_wholly(messy(s, d), "amount_text", "number")


# ---- cleaning ----------------------------------------------------------------------------------

_AUDITED = ["row_index", "column_name", "original_value", "new_value", "cleaning_action"]


def _text_fix_sql(action: str, new: Callable[[str], str]) -> str:
    rows = " UNION ALL ".join(f"SELECT _row_id AS row_index, '{c}' AS column_name, {c} AS original_value, {new(c)} AS new_value, '{action}' AS cleaning_action FROM m WHERE {c} IS DISTINCT FROM {new(c)}" for c in TEXT_COLUMNS)
    return f"{_WITH} {rows}"


def _nullified(c: str) -> str:
    return f"CASE WHEN NOT ({d_strip(c)} = '' OR lower({d_strip(c)}) IN ({_TOKENS})) THEN {c} END"


for _fix, _new in {
    "trim_whitespace": d_strip, "collapse_internal_spaces": lambda c: d_strip(f"regexp_replace({c}, {q(E.WS + '+')}, ' ', 'g')"),
    "remove_non_printable": lambda c: f"regexp_replace({c}, {q(D_PRINTABLE)}, '', 'g')", "nullify_blank_and_placeholders": _nullified,
}.items():
    QUERIES[f"fix_{_fix}"] = lambda s, d, f=_fix: clean.apply_fixes(messy(s, d), [], [f]).audit.select(*_AUDITED)
    SQL[f"fix_{_fix}"] = _text_fix_sql(_fix, _new)

_EVERY_NULL = " AND ".join(f"{c} IS NULL" for c in ALL_COLUMNS)


@query(f"{_WITH} SELECT _row_id, segment, score FROM m WHERE NOT ({_EVERY_NULL})")
def fix_remove_empty_rows(s, d):
    return clean.apply_fixes(messy(s, d), [], ["remove_empty_rows"]).df.select("_row_id", "segment", "score")


@query(f"{_WITH} SELECT _row_id, {', '.join(_COLUMNS)} FROM m")
def fix_remove_empty_columns(s, d):
    return clean.apply_fixes(messy(s, d), [], ["remove_empty_columns"]).df


@query(f"{_WITH}, {_DUP} SELECT _row_id, customer_id, phone FROM d WHERE nth = 1")
def fix_drop_duplicates(s, d):
    return clean.apply_fixes(messy(s, d), [], ["drop_duplicates"]).df.select("_row_id", "customer_id", "phone")


def _with_types(names: list[str]) -> list[profile.ColumnProfile]:
    return [profile.ColumnProfile(n, n, "", TYPES[n], 1.0, 0, 0, 0.0, 0, 0.0, 0, effective_logical_type=TYPES[n]) for n in names]


@query(f"{_WITH} SELECT _row_id, {d_value('amount_text')} AS amount_text FROM m WHERE amount_text <> 'abc'")
def fix_numeric_text(s, d):
    df = messy(s, d).filter("amount_text <> 'abc'").select("_row_id", "amount_text")
    return clean.apply_fixes(df, _with_types(["amount_text"]), ["convert_numbers"]).df


@query(f"{_WITH} SELECT _row_id, {d_date('signup')} AS signup FROM m WHERE signup <> 'not-a-date'")
def fix_dates_text(s, d):
    df = messy(s, d).filter("signup <> 'not-a-date'").select("_row_id", "signup")
    return clean.apply_fixes(df, _with_types(["signup"]), ["convert_dates"]).df


@query("SELECT c_custkey AS _row_id, c_name AS customer_name, c_acctbal AS customer_name_2 FROM customer")
def fix_normalize_columns(s, d):
    df = table(s, d, "customer").select(F.col("c_custkey").alias("_row_id"), F.col("c_name").alias("Customer Name"), F.col("c_acctbal").alias("customer-name "))
    return clean.apply_fixes(df, [], ["normalize_columns"]).df


@query(f"{_WITH} SELECT _row_id, CASE WHEN _row_id % 100 = 1 THEN 'Fixed' WHEN _row_id % 100 = 2 THEN NULL ELSE segment END AS segment FROM m")
def fix_value_replacements(s, d):
    df = messy(s, d).select("_row_id", "segment")
    asked = df.filter("_row_id % 100 in (1, 2)").select(F.col("_row_id").alias("row_index"), F.when(F.col("_row_id") % 100 == 1, "Fixed").alias("new_value"))
    return clean.replace_values(df, "segment", asked, "guided", "decided")[0]


_AFTER_TRIM = ", ".join(f"{d_strip(c)} AS {c}" for c in TEXT_COLUMNS)


@query(f"{_WITH}, t AS (SELECT _row_id, {_AFTER_TRIM} FROM m) " + " UNION ALL ".join([
    "SELECT 'trim_whitespace' AS fix_id, CAST({} AS BIGINT) AS affected FROM m".format(" + ".join(f"count(*) FILTER (WHERE {c} IS DISTINCT FROM {d_strip(c)})" for c in TEXT_COLUMNS)),
    "SELECT 'collapse_internal_spaces', CAST({} AS BIGINT) FROM t".format(" + ".join("count(*) FILTER (WHERE {0} IS DISTINCT FROM {1})".format(c, d_strip(f"regexp_replace({c}, {q(E.WS + '+')}, ' ', 'g')")) for c in TEXT_COLUMNS)),
]))
def fix_apply_selected(s, d):
    audit = clean.apply_fixes(messy(s, d), [], ["collapse_internal_spaces", "trim_whitespace"]).audit
    return compare.fix_counts(audit).select(F.col("cleaning_action").alias("fix_id"), F.col("changes").alias("affected"))


def _text_steps(source: str) -> tuple[str, list[str]]:
    """CTEs t1 to t4, the table after each of the text fixes in order, and for each fix the number of cells that it changes."""
    steps = {
        "trim_whitespace": d_strip, "collapse_internal_spaces": lambda c: d_strip(f"regexp_replace({c}, {q(E.WS + '+')}, ' ', 'g')"),
        "remove_non_printable": lambda c: f"regexp_replace({c}, {q(D_PRINTABLE)}, '', 'g')", "nullify_blank_and_placeholders": _nullified,
    }
    others, made, counts = [c for c in ["_row_id", *ALL_COLUMNS] if c not in TEXT_COLUMNS], [], []
    for i, (fix, new) in enumerate(steps.items(), 1):
        made.append(f"t{i} AS MATERIALIZED (SELECT {', '.join(others)}, {', '.join(f'{new(c)} AS {c}' for c in TEXT_COLUMNS)} FROM {source})")
        counts.append(f"SELECT '{fix}' AS fix_id, CAST({' + '.join(f'count(*) FILTER (WHERE {c} IS DISTINCT FROM {new(c)})' for c in TEXT_COLUMNS)} AS BIGINT) AS affected FROM {source}")
        source = f"t{i}"
    return ", ".join(made), counts


def _preview_sql() -> str:
    made, counts = _text_steps("m")
    converted = lambda fix, kind, new: f"SELECT '{fix}', CAST({' + '.join([f'(SELECT CASE WHEN count(*) FILTER (WHERE {c} IS NOT NULL AND {new(c)} IS NULL) = 0 THEN count({c}) ELSE 0 END FROM u)' for c in TEXT_COLUMNS if TYPES[c] == kind] or ['0'])} AS BIGINT)"
    counts += [
        f"SELECT 'normalize_columns', CAST({sum(profile.normalize_name(c) != c for c in ALL_COLUMNS)} AS BIGINT)", f"SELECT 'remove_empty_rows', count(*) FROM t4 WHERE {_EVERY_NULL}",
        f"SELECT 'remove_empty_columns', CAST({' + '.join(f'(count({c}) = 0)::INT' for c in ALL_COLUMNS)} AS BIGINT) FROM u", converted("convert_dates", C.DATE_TEXT, d_date), converted("convert_numbers", C.NUMERIC_TEXT, d_value),
        f"SELECT 'drop_duplicates', count(*) FROM (SELECT row_number() OVER (PARTITION BY {', '.join(ALL_COLUMNS)} ORDER BY _row_id) AS nth FROM u) WHERE nth > 1",
    ]
    return f"{_WITH}, {made}, u AS (SELECT * FROM t4 WHERE NOT ({_EVERY_NULL})) {' UNION ALL '.join(counts)}"


@query(_preview_sql())
def fix_preview(s, d):
    return clean.preview_fixes(messy(s, d).persist(), _with_types(ALL_COLUMNS))


QUERIES["fix_text_base"], SQL["fix_text_base"] = QUERIES["fix_trim_whitespace"], SQL["fix_trim_whitespace"]


@query(f"{ISSUES_CTE}, z AS (SELECT quantile_cont(score, 0.5) AS x FROM m) SELECT row_index, CAST(round(x, 4) AS DOUBLE) AS new_value FROM h CROSS JOIN z WHERE column_name = 'score' AND issue_type = 'missing_null'")
def res_missing(s, d):
    a = analysis(s, d)
    return strategies.resolve(a.df, a.issues, "score", "missing_null", "median").select("row_index", F.col("new_value").cast("double").alias("new_value"))


@query(f"{ISSUES_CTE}, z AS (SELECT quantile_cont(score, 0.25) AS a, quantile_cont(score, 0.75) AS c FROM m), f AS (SELECT round(a - 1.5 * (c - a), 4) AS lo, round(c + 1.5 * (c - a), 4) AS hi FROM z) SELECT row_index, CASE WHEN score < lo THEN lo WHEN score > hi THEN hi ELSE score END AS new_value FROM h JOIN m ON _row_id = row_index CROSS JOIN f WHERE column_name = 'score' AND issue_type = 'possible_outlier'")
def res_outlier(s, d):
    a = analysis(s, d)
    return strategies.resolve(a.df, a.issues, "score", "possible_outlier", "cap").select("row_index", F.col("new_value").cast("double").alias("new_value"))


@query(f"{ISSUES_CTE} SELECT row_index, '0' AS new_value FROM h WHERE column_name = 'score' AND issue_type = 'negative_value'")
def res_negative(s, d):
    a = analysis(s, d)
    return strategies.resolve(a.df, a.issues, "score", "negative_value", "zero")


@query(f"{ISSUES_CTE} SELECT row_index, suggested_value AS new_value FROM h WHERE column_name = 'segment' AND issue_type = 'similar_category_values'")
def res_variants(s, d):
    a = analysis(s, d)
    return strategies.resolve(a.df, a.issues, "segment", "similar_category_values", "most_frequent")


# ---- dashboard, on two tables of issues --------------------------------------------------------

# Issues of lines before and after: events stand for findings, those of even users are gone after.
_FOUND = "SELECT event_id AS row_index, event_type AS issue_type, CASE event_type WHEN 'click' THEN 'Text' WHEN 'view' THEN 'Numeric' ELSE 'Date' END AS issue_category, {} AS severity, CASE WHEN user_id % 7 = 0 THEN NULL ELSE 'column_' || CAST(user_id % 23 AS VARCHAR(5)) END AS column_name, event_type || ' action' AS recommended_action, user_id % 3 = 0 AS safe_to_auto_fix, user_id FROM {{events}}".format(d_ladder("value", (5, 20, 60)))
_BA = f"WITH b AS ({_FOUND.replace('{events}', 'events')}), a AS (SELECT * FROM b WHERE user_id % 2 = 1 AND issue_category <> 'Date')"


def found(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    before = s.sql(_FOUND, events=table(s, d, "events"))
    return before, before.filter("user_id % 2 = 1 and issue_category <> 'Date'")


def _full(key: str, where: str = "true") -> str:
    return f"{_BA} SELECT coalesce(x.{key}, y.{key}) AS {key}, coalesce(before, 0) AS before, coalesce(after, 0) AS after FROM (SELECT {key}, count(*) AS before FROM b WHERE {where} GROUP BY 1) x FULL JOIN (SELECT {key}, count(*) AS after FROM a WHERE {where} GROUP BY 1) y ON x.{key} = y.{key}"


@query(f"{_BA} SELECT 'Before' AS version, count(*) AS issues FROM b UNION ALL SELECT 'After', count(*) FROM a")
def dash_total(s, d):
    return compare.totals(*found(s, d))


@query(_full("issue_category"))
def dash_category(s, d):
    return compare.categories(*found(s, d))


@query(_full("severity"))
def dash_severity(s, d):
    return compare.severities(*found(s, d))


@query(f"{_BA}, t AS (SELECT column_name, count(*) AS before FROM b WHERE column_name IS NOT NULL GROUP BY 1 ORDER BY before DESC, column_name LIMIT 10) SELECT t.column_name, before, coalesce(n, 0) AS after FROM t LEFT JOIN (SELECT column_name, count(*) AS n FROM a GROUP BY 1) y ON y.column_name = t.column_name")
def dash_top_columns(s, d):
    return compare.top_columns(*found(s, d))


@query(f"{_BA} SELECT issue_type, issue_category, count(*) AS n, min(recommended_action) AS recommended_action FROM b WHERE NOT safe_to_auto_fix GROUP BY ALL")
def dash_unresolved(s, d):
    return compare.unresolved(found(s, d)[0])


@query(f"{_BA}, k AS (SELECT DISTINCT column_name, issue_type FROM a WHERE user_id % 5 = 1) SELECT 'accepted' AS part, count(*) AS n FROM b WHERE EXISTS (SELECT 1 FROM k WHERE k.column_name = b.column_name AND k.issue_type = b.issue_type) UNION ALL SELECT 'review', count(*) FROM b WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.column_name = b.column_name AND k.issue_type = b.issue_type)")
def dash_accept_split(s, d):
    before, after = found(s, d)
    parts = compare.split_by_decision(before, after.filter("user_id % 5 = 1"))
    return parts[0].agg(F.count(F.lit(1)).alias("n")).select(F.lit("accepted").alias("part"), "n").unionByName(parts[1].agg(F.count(F.lit(1)).alias("n")).select(F.lit("review").alias("part"), "n"))


@query(f"{_full('severity').replace('SELECT coalesce(x', ', w AS (SELECT coalesce(x', 1)}) SELECT severity, 'before' AS version, before AS value FROM w UNION ALL SELECT severity, 'after', after FROM w")
def dash_melt(s, d):
    return compare.melt(compare.severities(*found(s, d)), "severity")


@query(f"{_BA} SELECT issue_type AS cleaning_action, count(*) AS changes, count(DISTINCT row_index) AS rows_changed, count(DISTINCT column_name) AS columns_changed FROM b GROUP BY 1")
def dash_impact(s, d):
    return compare.impact(found(s, d)[0].withColumnRenamed("issue_type", "cleaning_action"))


QUERIES["ui_impact_rank"] = lambda s, d: compare.impact(found(s, d)[0].withColumnRenamed("issue_type", "cleaning_action")).orderBy("changes", "cleaning_action")
SQL["ui_impact_rank"] = SQL["dash_impact"]


@query(f"{_BA} SELECT issue_type AS cleaning_action, count(*) AS changes FROM b GROUP BY 1")
def dash_fix_counts(s, d):
    return compare.fix_counts(found(s, d)[0].withColumnRenamed("issue_type", "cleaning_action"))


@query(f"{_BA}, t AS (SELECT DISTINCT row_index FROM b WHERE user_id % 11 = 0 ORDER BY 1 LIMIT 10) SELECT row_index AS _row_id, row_index IN (SELECT row_index FROM a) AS present FROM t")
def dash_changed_rows(s, d):
    before, after = found(s, d)
    keyed = lambda x: x.withColumnRenamed("row_index", "_row_id")
    return compare.changed_rows(keyed(before), keyed(after), before.filter("user_id % 11 = 0"))


def _cleaned_score_cte() -> str:
    """Detection and scores in SQL of the table that the safe fixes leave: texts mended in turn, then rows and the column without values gone."""
    made, _ = _text_steps("raw")
    columns = [c for c in ALL_COLUMNS if c != "nothing"]
    found_ = " UNION ALL ".join(x for rows in _detection_sql(columns).values() for x in rows)
    table_ = f"{_WITH.replace('WITH m AS', 'WITH raw AS')}, {made}, m AS MATERIALIZED (SELECT * EXCLUDE (nothing) FROM t4 WHERE NOT ({_EVERY_NULL}))"
    return _score_cte(f"{table_}, {_dup_sql(columns)}, {_HEAD} AS ({found_})", columns)


CLEANED_CTE = _cleaned_score_cte()


@query(f"SELECT x.component_name, x.component_score AS before, y.component_score AS after, round(y.component_score - x.component_score, 2) AS delta FROM ({SCORE_CTE} SELECT * FROM score) x JOIN ({CLEANED_CTE} SELECT * FROM score) y ON y.component_name = x.component_name")
def dash_components(s, d):
    session = cleaned(s, d)
    return compare.components(session.before.components, session.after.components)


QUERIES["dash_component_delta"], SQL["dash_component_delta"] = QUERIES["dash_components"], SQL["dash_components"]


@query(f"SELECT x.*, y.*, round(score_after - score_before, 2) AS score_improvement FROM ({SCORE_CTE} SELECT (SELECT count(*) FROM m) AS total_rows, {len(ALL_COLUMNS)} AS total_columns, (SELECT count(*) FROM h) AS issues_before, round(sum(weighted_contribution), 2) AS score_before FROM score) x, ({CLEANED_CTE} SELECT (SELECT count(*) FROM h) AS issues_after, round(sum(weighted_contribution), 2) AS score_after FROM score) y")
def dash_kpis(s, d):
    return cleaned(s, d).kpis()


@query(f"{CLEANED_CTE} SELECT * FROM h")
def detect_cleaned(s, d):
    """Findings in the table that the safe fixes leave."""
    return cleaned(s, d).after.issues.select(*ISSUE_COLUMNS)


@query(f"{_WITH}, {_DUP}, x AS (SELECT * FROM m WHERE _row_id % 2 = 0), y AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(ALL_COLUMNS)} ORDER BY _row_id) AS nth FROM x) SELECT count(*) AS n_rows, CAST({_GONE} AS BIGINT) AS missing_cells, {len(ALL_COLUMNS)} AS n_columns, count(*) FILTER (WHERE nth > 1) AS duplicate_rows, 'original' AS version FROM d UNION ALL SELECT count(*), CAST({_GONE} AS BIGINT), {len(ALL_COLUMNS)}, count(*) FILTER (WHERE nth > 1), 'cleaned' FROM y")
def dash_before_after(s, d):
    df = messy(s, d)
    return compare.before_after(df, df.filter("_row_id % 2 = 0"))


# ---- run store: a run for each order -----------------------------------------------------------

_RUN, _NAMED = "'run_' || CAST(o_orderkey AS VARCHAR(20))", "'run_' || CAST(o_custkey AS VARCHAR(20))"
_SCORE_ROW = f"SELECT {_RUN} AS run_id, '%s' AS dataset_version, CAST((o_custkey * %d) %% 1000 AS DOUBLE) / 10 AS overall_score FROM {{orders}}"
_STORE = {
    "profiling_runs": f"SELECT {_RUN} AS run_id, 'set_' || CAST(o_orderkey % 4 AS VARCHAR(5)) AS dataset_name, 'csv' AS file_type, '2025-01-' || lpad(CAST(o_orderkey % 25 + 1 AS VARCHAR(5)), 2, '0') AS run_timestamp, o_orderkey % 3 <> 0 AS cleaning_applied, o_custkey AS original_row_count, CAST(9 AS BIGINT) AS original_column_count, o_custkey - 1 AS cleaned_row_count, CAST(8 AS BIGINT) AS cleaned_column_count FROM {{orders}}",
    "dataset_profiles": f"{_SCORE_ROW % ('original', 1)} UNION ALL {_SCORE_ROW % ('cleaned', 7)} WHERE o_orderkey % 5 <> 0",
    "data_quality_issues": f"SELECT {_NAMED} AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 'cleaned' ELSE 'original' END AS dataset_version, o_orderpriority AS issue_category, CASE o_orderstatus WHEN 'O' THEN 'Critical' WHEN 'F' THEN 'Low' ELSE 'High' END AS severity, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE 'column_' || CAST(o_custkey % 17 AS VARCHAR(5)) END AS column_name FROM {{orders}}",
    "applied_fixes": f"SELECT {_NAMED} AS run_id, 'fix_' || CAST(o_custkey % 5 AS VARCHAR(5)) AS fix_id, o_custkey % 50 AS affected_count FROM {{orders}} WHERE o_orderkey % 7 <> 0",
    "quality_scores": f"SELECT {_NAMED} AS run_id, 'original' AS dataset_version, 'part_' || CAST(o_orderkey AS VARCHAR(20)) AS component_name, CAST(o_custkey % 100 AS DOUBLE) AS component_score, o_custkey AS issue_count, o_orderkey AS denominator, CAST(o_custkey % 10 AS DOUBLE) AS penalty, CAST(o_orderkey % 31 AS DOUBLE) AS component_weight, CAST(o_custkey % 20 AS DOUBLE) AS weighted_contribution FROM {{orders}}",
}
_STORE = {k: v.replace("{{orders}}", "{orders}") for k, v in _STORE.items()}
_STORE_CTE = "WITH " + ", ".join(f"{k} AS ({v.replace('{orders}', 'orders')})" for k, v in _STORE.items()) + """, pair AS (
  SELECT run_id, max(overall_score) FILTER (WHERE dataset_version = 'original') AS original_score, max(overall_score) FILTER (WHERE dataset_version = 'cleaned') AS cleaned_score FROM dataset_profiles GROUP BY run_id
), scored AS (
  SELECT p.*, pair.original_score, pair.cleaned_score, round(pair.cleaned_score - pair.original_score, 2) AS score_improvement FROM profiling_runs p LEFT JOIN pair USING (run_id)
), own AS (SELECT * FROM data_quality_issues WHERE run_id = 'run_7' AND dataset_version = 'original'),
tally AS (
  SELECT run_id, count(*) FILTER (WHERE dataset_version = 'original') AS original_issue_count, count(*) FILTER (WHERE dataset_version = 'cleaned') AS cleaned_issue_count FROM data_quality_issues GROUP BY run_id
), fixes AS (SELECT run_id, count(*) AS n, CAST(sum(affected_count) AS BIGINT) AS changes FROM applied_fixes GROUP BY run_id)"""
_ARGS = {"run_id": "run_7", "dataset_name": "set_1", "dataset_version": "original"}
_HISTORY_SQL = {
    "q1_latest_runs": "SELECT run_id, dataset_name, run_timestamp, cleaning_applied, original_row_count, original_column_count FROM profiling_runs ORDER BY run_timestamp DESC, run_id LIMIT 20",
    "q2_score_by_run": "SELECT run_id, dataset_name, run_timestamp, original_score, cleaned_score FROM scored",
    "q3_improvement": "SELECT run_id, dataset_name, original_score, cleaned_score, score_improvement FROM scored WHERE score_improvement IS NOT NULL",
    "q4_by_category": "SELECT issue_category, count(*) AS issue_count FROM own GROUP BY ALL",
    "q5_by_severity": "SELECT severity, count(*) AS issue_count FROM own GROUP BY ALL",
    "q6_top_columns": "SELECT column_name, count(*) AS issue_count FROM data_quality_issues SEMI JOIN (SELECT run_id FROM profiling_runs WHERE dataset_name = 'set_1') USING (run_id) WHERE column_name IS NOT NULL GROUP BY ALL ORDER BY issue_count DESC, column_name LIMIT 10",
    "q7_fixes_by_run": "SELECT run_id, dataset_name, coalesce(n, 0) AS fixes_applied, changes AS total_changes FROM profiling_runs LEFT JOIN fixes USING (run_id)",
    "q8_avg_score": "SELECT dataset_name, round(avg(original_score), 2) AS avg_original_score, count(*) AS run_count FROM scored WHERE original_score IS NOT NULL GROUP BY ALL",
    "q9_best_runs": "SELECT run_id, dataset_name, run_timestamp, original_score, cleaned_score, score_improvement FROM scored WHERE cleaning_applied AND score_improvement IS NOT NULL ORDER BY score_improvement DESC, run_id LIMIT 10",
    "q10_components": "SELECT * EXCLUDE (run_id, dataset_version) FROM quality_scores WHERE run_id = 'run_7'",
    "db_history": "SELECT s.*, coalesce(original_issue_count, 0) AS original_issue_count, coalesce(cleaned_issue_count, 0) AS cleaned_issue_count, coalesce(n, 0) AS fixes_applied_count FROM scored s LEFT JOIN tally USING (run_id) LEFT JOIN fixes USING (run_id)",
}


def store_tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return {k: s.sql(v, orders=table(s, d, "orders")) for k, v in _STORE.items()}


for _name, _sql in _HISTORY_SQL.items():
    QUERIES[_name] = lambda s, d, n=_name: store.history(s, n, store_tables(s, d), **_ARGS)
    SQL[_name] = f"{_STORE_CTE} {_sql}"


def saved_runs(s: SparkSession, d: str) -> store.RunStore:
    """A store with the runs of all orders, saved at once and read again."""
    made = store.RunStore(s, f"{folder(s)}/runs-{uuid.uuid4().hex}")
    made.init(NOW)
    made.save_all(store_tables(s, d))
    return made


@query(f"{_STORE_CTE}, ids AS (SELECT {_RUN} AS run_id FROM orders UNION SELECT 'run_' || CAST(o_orderkey + 7 AS VARCHAR) FROM orders) SELECT run_id, run_id IN (SELECT run_id FROM profiling_runs) AS known FROM ids")
def db_run_exists(s, d):
    ids = s.sql(f"SELECT {_RUN} AS run_id FROM {{orders}} UNION SELECT 'run_' || CAST(o_orderkey + 7 AS VARCHAR(20)) FROM {{orders}}", orders=table(s, d, "orders"))
    return saved_runs(s, d).known(ids)


_PARTS = ("profiling_runs", "data_quality_issues", "applied_fixes", "quality_scores")


def _part_counts(tables: dict[str, DataFrame]) -> DataFrame:
    every = [tables[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n") for n in _PARTS]
    return every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])


def _part_counts_sql(where: str = "true") -> str:
    return f"{_STORE_CTE} {' UNION ALL '.join(f"SELECT '{n}' AS part, count(*) AS n FROM {n} WHERE {where}" for n in _PARTS)}"


@query(_part_counts_sql("run_id = 'run_7'"))
def db_detail(s, d):
    return _part_counts(saved_runs(s, d).detail("run_7"))


@query(f"{_STORE_CTE} SELECT run_id, issue_category, severity, column_name, count(*) AS n FROM data_quality_issues GROUP BY ALL")
def db_save(s, d):
    return saved_runs(s, d).table("data_quality_issues").groupBy("run_id", "issue_category", "severity", "column_name").agg(F.count(F.lit(1)).alias("n"))


@query(_part_counts_sql())
def db_retry(s, d):
    """All runs are written, lost before their commit, saved again, and saved a third time, which is refused."""
    made, tables = store.RunStore(s, f"{folder(s)}/runs-{uuid.uuid4().hex}"), store_tables(s, d)
    made.write(tables)
    made.save_all(tables)
    try:
        made.save_all(tables)
    except store.StoreError:
        return _part_counts(made.tables())
    raise AssertionError("runs were stored twice")


@query(_part_counts_sql("run_id NOT IN ('run_3', 'run_7')"))
def db_delete(s, d):
    """Deleting a run takes its rows out of every table."""
    made = saved_runs(s, d)
    made.delete("run_7")
    made.delete("run_3")
    return _part_counts(made.tables())


_COLUMNS = f"SELECT {_RUN} AS run_id, 'original' AS dataset_version, 'column_' || CAST(o_custkey % 17 AS VARCHAR(5)) AS column_name, o_custkey AS missing_count FROM {{orders}}"


@query(f"SELECT run_id, column_name, missing_count, CAST(CASE WHEN run_id = 'run_new' THEN 5 ELSE -1 END AS BIGINT) AS outlier_count, 1 AS steps FROM ({_COLUMNS.replace('{orders}', 'orders')} UNION ALL SELECT 'run_new', 'original', 'column_x', 4)")
def db_migrate(s, d):
    """A store of an older version, whose column profiles have no outlier_count: brought up twice, added to, and read."""
    made = store.RunStore(s, f"{folder(s)}/runs-{uuid.uuid4().hex}")
    made._commit(lambda: True, action="schema", schema_version="1.0.0", noted_at=NOW)
    old = {"profiling_runs": store_tables(s, d)["profiling_runs"], "column_profiles": s.sql(_COLUMNS, orders=table(s, d, "orders"))}
    made._commit(lambda: True, action="add", attempt=made.write(old), schema_version="1.0.0")
    made.init(NOW)
    made.init(NOW)
    made.save("run_new", {"profiling_runs": s.sql("SELECT 'new' AS dataset_name"), "column_profiles": s.sql("SELECT 'original' AS dataset_version, 'column_x' AS column_name, 4 AS missing_count, 5 AS outlier_count")})
    steps = made.table("schema_info").filter("schema_version = '1.1.0'").count()
    return made.table("column_profiles").select("run_id", "column_name", "missing_count", F.coalesce("outlier_count", F.lit(-1)).alias("outlier_count"), F.lit(steps).alias("steps"))


@query("SELECT '1.1.0' AS schema_version, count(*) AS n FROM (VALUES (1)) AS v(x)")
def db_init(s, d):
    made = saved_runs(s, d)
    made.init(NOW)
    return made.table("schema_info").groupBy("schema_version").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_STORE_CTE} SELECT run_id, overall_score, dataset_version FROM dataset_profiles")
def sink_run_store(s, d):
    return saved_runs(s, d).table("dataset_profiles").select("run_id", "overall_score", "dataset_version")


@query(f"{_STORE_CTE} SELECT run_id, dataset_name, run_timestamp FROM profiling_runs WHERE dataset_name IN ('set_1', 'set_2') AND run_timestamp >= '2025-01-10'")
def db_hist_filter(s, d):
    return store.filter_history(store_tables(s, d)["profiling_runs"], ["set_1", "set_2"], "2025-01-10").select("run_id", "dataset_name", "run_timestamp")


_METRICS = ("original_score", "cleaned_score", "original_issue_count", "cleaned_issue_count", "fixes_applied_count")


@query(f"{_STORE_CTE}, x AS ({_HISTORY_SQL['db_history']}) {' UNION ALL '.join(f"SELECT '{m}' AS metric, CAST(max({m}) FILTER (WHERE run_id = 'run_7') AS DOUBLE) AS first, CAST(max({m}) FILTER (WHERE run_id = 'run_8') AS DOUBLE) AS second FROM x" for m in _METRICS)}")
def db_compare(s, d):
    return store.compare_runs(store.history(s, "db_history", store_tables(s, d)), "run_7", "run_8")


# ---- presentation ------------------------------------------------------------------------------


@query(f"{_WITH} SELECT _row_id, segment, email FROM m ORDER BY _row_id LIMIT 500")
def ui_head(s, d):
    return messy(s, d).select("_row_id", "segment", "email").orderBy("_row_id").limit(C.MAX_DISPLAYED)


_LABELED = "coalesce(k.label, upper(substr(replace(h.issue_type, '_', ' '), 1, 1)) || substr(replace(h.issue_type, '_', ' '), 2))"


@query(f"{ISSUES_CTE}, k(issue_type, label) AS (VALUES {', '.join(f'({q(a)}, {q(b)})' for a, b in C.LABELS.items())}) SELECT {_LABELED} AS issue, h.column_name, h.row_index, h.severity FROM h LEFT JOIN k ON k.issue_type = h.issue_type")
def ui_issue_table(s, d):
    return analysis(s, d).issues.select(E.label(F.col("issue_type")).alias("issue"), "column_name", "row_index", "severity")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS shown FROM orders")
def ui_ts_format(s, d):
    return table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("shown"))


# ---- names, by a frame of four columns whose names have defects ---------------------------------

_NAMED = {"c_custkey": "_row_id", "c_name": "Customer ID", "c_nationkey": "customer_id", "c_acctbal": " balance", "c_mktsegment": "marketSegment"}
_NAMES = (
    ("near_duplicate_column_name", "Medium", 1.0, "Customer ID", None), ("near_duplicate_column_name", "Medium", 1.0, "customer_id", None), ("column_name_whitespace", "Low", 1.0, " balance", "balance"),
    ("inconsistent_column_name_formatting", "Low", 0.7, "Customer ID", "customer_id"), ("inconsistent_column_name_formatting", "Low", 0.7, "customer_id", "customer_id"),
    ("inconsistent_column_name_formatting", "Low", 0.7, " balance", "balance"), ("inconsistent_column_name_formatting", "Low", 0.7, "marketSegment", "marketsegment"),
)


def _name_rule(rule: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        df = table(s, d, "customer").select(*[F.col(a).alias(b) for a, b in _NAMED.items()])
        profiles = [profile.ColumnProfile(n, n, "", C.EMPTY, 1.0, 0, 0, 0.0, 0, 0.0, 0, effective_logical_type=C.EMPTY) for n in profile.data_columns(df)]
        return detect.detect(df, profiles, now=NOW).filter(F.col("issue_type") == rule).select("issue_type", "severity", "confidence", "column_name", "suggested_value")

    return run


for _name in ("near_duplicate_column_name", "column_name_whitespace", "inconsistent_column_name_formatting"):
    QUERIES[_name] = _name_rule(_name)
    SQL[_name] = "SELECT * FROM (VALUES {}) t(issue_type, severity, confidence, column_name, suggested_value)".format(", ".join(f"('{a}', '{b}', CAST({c} AS DOUBLE), {q(n)}, {'CAST(NULL AS VARCHAR)' if v is None else q(v)})" for a, b, c, n, v in _NAMES if a == _name))


# ---- one query for each inferred text type ------------------------------------------------------

_INFERRED = {
    "infer_empty": "nothing", "infer_bool": "flag", "infer_email": "email", "infer_url": "site", "infer_currency_text": "price", "infer_date_text": "signup", "infer_numeric_text": "amount_text",
    "infer_phone_text": "phone", "infer_mixed": "mixture", "infer_identifier": "customer_id", "infer_categorical": "segment", "infer_free_text": "note",
}


def _inferred(column: str) -> Query:
    return lambda s, d: profile.profile_frame(s, profile.profile(messy(s, d).select("_row_id", column))).select(F.col("original_name").alias("column_name"), "logical_type", F.round("confidence", 6).alias("confidence"))


for _name, _column in _INFERRED.items():
    QUERIES[_name] = _inferred(_column)
    SQL[_name] = f"{_WITH} {_infer_sql(_column)}"


def _whole_sql(c: str, other: str = "'Decimal'", sure: str = "1.0") -> str:
    whole = f"bool_and({c} = floor({c}))"
    kind = f"CASE WHEN any_value(typeof({c})) LIKE '%INT%' THEN 1.0 ELSE 0.9 END"
    return f"SELECT '{c}' AS column_name, CASE WHEN {whole} THEN 'Integer' ELSE {other} END AS logical_type, CAST(round(CASE WHEN {whole} THEN {kind} ELSE {sure} END, 6) AS DOUBLE) AS confidence"


@query(f"""{_whole_sql('l_quantity')} FROM lineitem
  UNION ALL {_whole_sql('l_extendedprice', "'Possible currency'", "least(0.6 + 0.3 * avg(CASE WHEN abs(round(l_extendedprice, 2) - l_extendedprice) < 1e-9 THEN 1.0 ELSE 0.0 END), 0.9)")} FROM lineitem
  UNION ALL SELECT 'o_orderdate', CASE WHEN bool_or(hour(o_orderdate) <> 0 OR minute(o_orderdate) <> 0 OR second(o_orderdate) <> 0) THEN 'Datetime' ELSE 'Date' END, 1.0 FROM orders
  UNION ALL {_whole_sql('c_acctbal')} FROM customer""")
def infer_native(s, d):
    out = None
    for c, t in (("l_quantity", "lineitem"), ("l_extendedprice", "lineitem"), ("o_orderdate", "orders"), ("c_acctbal", "customer")):
        df = table(s, d, t).select(F.monotonically_increasing_id().alias("_row_id"), c)
        one = profile.profile_frame(s, profile.profile(df)).select(F.col("original_name").alias("column_name"), "logical_type", F.round("confidence", 6).alias("confidence"))
        out = one if out is None else out.unionByName(one)
    return out


for _name in ("infer_date_native", "infer_whole_number", "infer_currency_native"):
    QUERIES[_name], SQL[_name] = QUERIES["infer_native"], SQL["infer_native"]


@query("SELECT event_id, value / 1000 AS confidence FROM events WHERE value / 1000 < 0.7")
def ovr_low_conf(s, d):
    return overrides.low_confidence(table(s, d, "events").select("event_id", (F.col("value") / 1000).alias("confidence")))


@query(f"{_WITH}, t AS (SELECT _row_id AS row_index, segment AS current, 'Fixed' AS proposed FROM m WHERE _row_id % 100 = 1 ORDER BY 1 LIMIT 10) SELECT * FROM t")
def ui_preview_changes(s, d):
    df = messy(s, d).select("_row_id", "segment")
    asked = df.filter("_row_id % 100 = 1").select(F.col("_row_id").alias("row_index"), F.lit("Fixed").alias("new_value"))
    audit = clean.replace_values(df, "segment", asked, "guided", "decided")[1]
    return audit.orderBy("row_index").limit(10).select("row_index", F.col("original_value").alias("current"), F.col("new_value").alias("proposed"))


QUERIES["ui_audit_table"], SQL["ui_audit_table"] = QUERIES["fix_trim_whitespace"], SQL["fix_trim_whitespace"]
QUERIES["ui_profile_table"], SQL["ui_profile_table"] = QUERIES["prof_df"], SQL["prof_df"]


@query(f"{ISSUES_CTE}, t AS (SELECT row_index FROM h WHERE column_name = 'score' AND issue_type = 'negative_value' ORDER BY 1 LIMIT 50) SELECT _row_id, CASE WHEN _row_id IN (SELECT row_index FROM t) THEN 0.0 ELSE score END AS score FROM m")
def res_scope(s, d):
    """Only the first fifty affected rows are treated, as a chosen subset."""
    a = analysis(s, d)
    asked = strategies.resolve(a.df, a.issues, "score", "negative_value", "zero").orderBy("row_index").limit(C.MAX_SAMPLE_ROWS)
    return clean.replace_values(a.df.select("_row_id", "score"), "score", asked, "guided_negative_value_zero", "decided")[0]


@query(f"{ISSUES_CTE} SELECT 'guided_negative_value_zero' AS cleaning_action, count(*) AS changes FROM h WHERE column_name = 'score' AND issue_type = 'negative_value'")
def res_apply(s, d):
    a = analysis(s, d)
    audit = clean.replace_values(a.df.select("_row_id", "score"), "score", strategies.resolve(a.df, a.issues, "score", "negative_value", "zero"), "guided_negative_value_zero", "decided")[1]
    return compare.fix_counts(audit)


def queries() -> dict[str, Query]:
    from . import catalog_queries, choice_queries, io_queries

    return QUERIES | io_queries.QUERIES | choice_queries.QUERIES | catalog_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import catalog_queries, choice_queries, io_queries

    return SQL | io_queries.SQL | choice_queries.SQL | catalog_queries.SQL
