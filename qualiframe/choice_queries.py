"""Registered queries of what people decide: strategies on offer, values of their own, and the tables of decisions.

The SQL holds its own rules and lists, not those of the engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from . import queries as base
from .functions import expr as E
from .operators import clean, overrides, strategies
from .plans import engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


#: What people type, by rows of orders.
_TYPED = """
SELECT o_orderkey AS id, CASE CAST(o_orderkey % 16 AS INT) WHEN 0 THEN ' 12.5 ' WHEN 1 THEN '1_000' WHEN 2 THEN '1__0' WHEN 3 THEN '-.5e2' WHEN 4 THEN '$5' WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN 'abc' WHEN 8 THEN '7.'
  WHEN 9 THEN '.' WHEN 10 THEN '1,000' WHEN 11 THEN '+3' WHEN 12 THEN '_1' WHEN 13 THEN '2023-02-30' WHEN 14 THEN '01/15/2023' ELSE CAST(o_custkey AS VARCHAR(20)) END AS typed
FROM {orders}
"""


def _typed(s: SparkSession, d: str) -> DataFrame:
    return s.sql(_TYPED, orders=base.table(s, d, "orders")).withColumn("typed", F.col("typed").cast("string"))


@_query(f"SELECT id, typed, CASE WHEN typed IN (' 12.5 ') THEN 12.5 WHEN typed = '1_000' THEN 1000 WHEN typed = '-.5e2' THEN -50 WHEN typed = '7.' THEN 7 WHEN typed = '+3' THEN 3 WHEN regexp_full_match(typed, '[0-9]+') THEN CAST(typed AS DOUBLE) END AS value FROM ({_TYPED.replace('{orders}', 'orders')})")
def fn_parse_float(s, d):
    return _typed(s, d).select("id", "typed", E.parse_float(F.col("typed")).alias("value"))


@_query(f"SELECT id, typed, CASE WHEN typed = '01/15/2023' THEN '2023-01-15' END AS as_date, CASE WHEN typed <> '' THEN typed END AS as_text FROM ({_TYPED.replace('{orders}', 'orders')}) WHERE typed IS NULL OR NOT regexp_full_match(typed, '[0-9]{{8}}')")
def fn_parse_date(s, d):
    rows = _typed(s, d).filter("typed is null or not typed rlike '^[0-9]{8}$'")
    return rows.select("id", "typed", E.custom_date(F.col("typed"), C.DATE).alias("as_date"), E.custom_date(F.col("typed"), C.DATE_TEXT).alias("as_text"))


@_query(f"{base._WITH}, g AS (SELECT _row_id FROM m WHERE score IS NULL ORDER BY _row_id LIMIT 50) SELECT _row_id AS row_index, CAST(_row_id AS VARCHAR) || '.5' AS new_value FROM g WHERE _row_id % 3 <> 0")
def res_per_row(s, d):
    a = base.analysis(s, d)
    given = a.df.select(F.col("_row_id").alias("row_index"), F.when(F.col("_row_id") % 3 == 0, " ").otherwise(F.concat(F.col("_row_id").cast("string"), F.lit(".5"))).alias("new_value"))
    return strategies.resolve(a.df, a.issues, "score", "missing_null", "per_row", given)


_LOG = """
SELECT 'run_' || CAST(o_orderkey AS VARCHAR(20)) AS run_id, CAST(o_orderdate AS VARCHAR(10)) AS decided_at, 'orders' AS dataset_name, o_orderpriority AS column_name, 'missing_null' AS issue_type, o_orderstatus AS strategy, o_custkey AS rows_affected, o_orderkey % 2 = 0 AS user_approved, 'by hand' AS note
FROM {orders}
"""


@_query("SELECT 'run_' || CAST(o_orderkey AS VARCHAR) AS \"Run ID\", strftime(o_orderdate, '%Y-%m-%d') AS \"Timestamp\", 'orders' AS \"Dataset\", o_orderpriority AS \"Column\", 'missing_null' AS \"Issue type\", CAST(NULL AS VARCHAR) AS \"Effective type\", CAST(NULL AS VARCHAR) AS \"Confidence\", o_orderstatus AS \"Strategy\", CAST(NULL AS VARCHAR) AS \"Scope\", o_custkey AS \"Affected count\", o_orderkey % 2 = 0 AS \"Approved\", CAST(NULL AS VARCHAR) AS \"Decision result\", CAST(NULL AS VARCHAR) AS \"Custom value\", 'by hand' AS \"Reason\" FROM orders")
def ui_decision_table(s, d):
    log = s.sql(_LOG, orders=base.table(s, d, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")))
    return overrides.decision_table(log)


@_query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS \"Timestamp\", o_orderstatus AS \"Original type\", CAST(o_custkey AS DOUBLE) / 16 AS \"Original confidence\", o_orderpriority AS \"New type\", o_orderkey % 2 = 0 AS \"User approved\" FROM orders WHERE o_custkey % 5 = 3")
def ui_type_history(s, d):
    log = base.table(s, d, "orders").select(
        F.concat(F.lit("column_"), (F.col("o_custkey") % 5).cast("string")).alias("column_name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("recorded_at"), F.col("o_orderstatus").alias("inferred_type"),
        (F.col("o_custkey").cast("double") / 16).alias("confidence"), F.col("o_orderpriority").alias("effective_type"), (F.col("o_orderkey") % 2 == 0).alias("user_approved"))
    return overrides.type_history(log, "column_3")


@_query("SELECT c_nationkey AS id, sha256('set_' || c_nationkey || ':' || count(*) || 'x5:' || CASE WHEN c_nationkey % 2 = 0 THEN 'Sheet1' ELSE '' END) AS run_id FROM customer GROUP BY c_nationkey")
def ui_run_id(s, d):
    sizes = base.table(s, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    key = F.col("c_nationkey")
    return sizes.select(key.alias("id"), engine.dataset_run_id(F.concat(F.lit("set_"), key.cast("string")), F.col("n"), F.lit(5), F.when(key % 2 == 0, "Sheet1")).alias("run_id"))


@_query("SELECT cleaning_action, column_name, count(*) AS n FROM (SELECT 'first' AS cleaning_action, 's_name' AS column_name FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'second', 's_name' FROM supplier WHERE s_suppkey % 4 = 0) GROUP BY ALL UNION ALL SELECT 'left', s_name, 1 FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0")
def fix_merge(s, d):
    """Two runs of replacements as one: both audits, and the frame after the second."""
    df = base.table(s, d, "supplier").select(F.col("s_suppkey").alias("_row_id"), "s_name")
    runs = []
    for name, k in (("first", 3), ("second", 4)):
        given = df.filter(f"_row_id % {k} = 0").select(F.col("_row_id").alias("row_index"), F.lit(name).alias("new_value"))
        df, audit = clean.replace_values(df, "s_name", given, name, "decided")
        runs.append(clean.Fixed(df, audit, [name]))
    both = clean.merge(*runs)
    audit = both.audit.groupBy("cleaning_action", "column_name").agg(F.count(F.lit(1)).alias("n"))
    left = both.df.filter("s_name not in ('first', 'second')")
    return audit.unionByName(left.select(F.lit("left").alias("cleaning_action"), F.col("s_name").alias("column_name"), F.lit(1).cast("long").alias("n")))
