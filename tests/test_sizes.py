"""Files, ranges and passes at larger sizes; white space, marks and null texts."""

import duckdb
import pyspark.sql.functions as F

from qualiframe import io_queries
from qualiframe.functions import expr as E
from qualiframe.operators import profile


def test_strip_and_marks_are_those_of_the_patterns(spark):
    """Every character of two bytes and some more, as text ends, inside and alone."""
    some = [chr(i) for i in (*range(1, 0x3100), 0xE000, 0xFEFF)]
    rows = [(t,) for c in some for t in (c, f"{c}1{c}2{c}", f"a{c} {c}\n")] + [(t,) for t in ("", "(5)", "( 5 )", "(-5)", "()", "(", " $1,000.50 ", "a \n", "\n", "+1 555-010", None)]
    df = spark.createDataFrame(rows, "c string")
    c = F.col("c")
    by_pattern = F.regexp_replace(c, E.STRIP, ""), F.regexp_replace(c, E.NUMBER_MARKS, ""), F.regexp_replace(c, E.PHONE_MARKS, "")
    quick = E.strip(c), F.translate(c, E.NUMBER_CHARS, ""), F.translate(c, E.PHONE_CHARS, "")
    for a, b in zip(by_pattern, quick):
        assert df.filter(~a.eqNullSafe(b)).count() == 0


def test_ranges_do_not_grow_with_the_table():
    assert io_queries._range_size(900_000, 5_000) == 5_000
    assert 330_000_000 / io_queries._range_size(330_000_000, 5_000) <= io_queries._RANGES


def test_files_hold_no_more_as_a_table_grows(spark, monkeypatch):
    monkeypatch.setattr(io_queries, "_FILE_BYTES", 1000)
    rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 10, "0").alias("t"))
    assert io_queries._files(rows, 2) == 10 and io_queries._files(rows.limit(10), 2) == 2


def test_decode_of_null_texts_and_languages(spark, tmp_path):
    """A null text is written and counted as an empty one; a null language has a folder too; utf-16 is written as such."""
    rows = [(i, None if i % 5 == 0 else "" if i % 7 == 0 else f"Größe façade señor {i} été déjà über", None if i % 3 == 0 else "de") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(io_queries.SQL["src_decode"]).fetchall(), key=repr)
    got = io_queries.QUERIES["src_decode"](spark, str(tmp_path)).select("lang", "written", "n", "same").collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_decode_of_languages_with_few_letters(spark, tmp_path, monkeypatch):
    """One letter does not tell an encoding; the files of one encoding are there at a time, and none is left."""
    rows = [(1, "voilà un caf\u00e9 noir", "fr"), (2, "plain", "en"), (3, "", "xx"), (4, "Ü", "de"), (5, "Ü", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(io_queries, "_place", lambda s: f"file://{tmp_path}/place")
    there, read_back = [], io_queries._read_back
    monkeypatch.setattr(io_queries, "_read_back", lambda *a: there.append(sorted(p.name for p in (tmp_path / "place").iterdir())) or read_back(*a))
    got = io_queries.QUERIES["src_decode"](spark, str(tmp_path)).collect()
    want = {(lang, e, n, n) for lang, n in (("fr", 1), ("en", 1), ("xx", 1), ("de", 2)) for e in io_queries._CODED}
    assert {(r["lang"], r["written"], r["n"], r["same"]) for r in got} == want and len(got) == len(want)
    assert there == [sorted(["plain", "had", e]) for e in io_queries._CODED] and not (tmp_path / "place").exists()


def test_scores_tell_rows_apart_for_uniqueness_only(spark, tmp_path):
    """The distinct rows are those of one component, so what is grouped by row is small."""
    from qualiframe.operators import score

    df = spark.range(20).select(F.col("id").alias("_row_id"), F.lit("x").alias("a"))
    issues = spark.range(400).select(F.when(F.col("id") < 100, "exact_duplicate_row").otherwise("missing_null").alias("issue_type"), (F.col("id") % 20).alias("row_index"))
    got = {r["component_name"]: r["issue_count"] for r in score.score(df, issues).collect()}
    assert got["Uniqueness"] == 20 and got["Completeness"] == 300
    plan = score.score(df, issues)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN (component_name" in plan.replace("#", " #").replace("  ", " ").split("Aggregate", 1)[1]


def test_quick_forms_of_text_rules_are_those_of_the_patterns(spark):
    some = [chr(i) for i in (*range(1, 0x3100), 0xE000, 0xFEFF)]
    rows = [(t,) for c in some for t in (c, f"a{c}b", f"a {c}b", f" a{c}{c}b")] + [(t,) for t in ("", "  ", "a  b", " a b ", "a b", "1e5", "(5)", "-Inf", "nan", " INFINITY ", "$1,000.50", "12 eur", None)]
    df = spark.createDataFrame(rows, "c string")
    c = F.col("c")
    plain = E.strip(F.regexp_replace(c, rf"{E.WS}+", " ")), F.regexp_replace(c, E.NON_PRINTABLE, ""), c != F.regexp_replace(c, E.NON_PRINTABLE, "")
    for a, b in zip(plain, (E.collapse(c), E.printable(c), E.unprintable(c))):
        assert df.filter(~a.eqNullSafe(b)).count() == 0
    assert df.filter(E.is_number(c) & ~E.maybe_number(E.strip(c))).count() == 0


def test_rules_on_cells_are_generated_code(spark):
    """``array_compact`` is not, and neither were the rules inside of it."""
    from qualiframe.plans import engine

    df = spark.range(50).selectExpr("id as _row_id", "concat(' a  b', id) as note", "if(id % 5 = 0, 'x', '2024-01-02') as day", "cast(id - 3 as double) as score")
    plan = engine.analyze(df).issues._jdf.queryExecution().executedPlan().toString()
    assert "explode" in plan and "lambda" not in plan


def test_a_session_works_out_what_is_asked_for(spark):
    """Fixes that ask for no type, and findings after them, need no profile, findings or figures of the table before."""
    from qualiframe.plans import engine

    df = spark.range(40).selectExpr("id as _row_id", "if(id % 4 = 0, ' a', 'a') as t", "id % 3 as k")
    session = engine.Session(engine.analyze(df)).apply(["trim_whitespace"])
    assert session.after.issues.filter("issue_type = 'leading_trailing_whitespace'").count() == 0
    assert not {"_typed", "issues", "components", "profiles"} & set(session.before.__dict__)
    assert "profiles" not in session.after.__dict__
    assert session.before.issues.filter("issue_type = 'leading_trailing_whitespace'").count() == 10
    assert {p.original_name: p.median for p in session.before.profiles}["k"] == 1.0


def test_rules_and_components_are_dealt_to_all_cores(spark, tmp_path):
    """A table of one file is one task until it is dealt."""
    from qualiframe import queries

    spark.range(300).selectExpr("id as c_custkey", "concat('Customer#', id) as c_name", "cast(id % 25 as int) as c_nationkey", "cast(id as double) as c_acctbal", "'BUILDING' as c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    df = queries.dealt(queries.messy(spark, str(tmp_path)))
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert queries.QUERIES["score_validity"](spark, str(tmp_path)).count() == 1
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() > 0


def test_long_methods_are_left_to_split_projections(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    for chosen, inside in ((None, "8000"), ("20000", "20000")):
        spark.conf.set(key, chosen) if chosen else spark.conf.unset(key)
        before = spark.conf.get(key)
        with profile.short_methods(spark):
            assert spark.conf.get(key) == inside
        assert spark.conf.get(key) == before
    spark.conf.unset(key)


def test_patterns_are_for_text_and_digits_for_numbers(spark):
    df = spark.createDataFrame([(i, f" (1,{i:03})", 1000 + i) for i in range(30)], "_row_id long, amount string, number long")
    rows, facts = profile.distinct_aggregates(profile.value_table(df), examples=False, text=["amount"])
    told = {r["column"]: r for r in rows.collect()}
    facts.unpersist()
    assert told["amount"]["numeric"] == 1.0 and told["amount"]["digit_share"] is None
    assert told["number"]["digit_share"] == 1.0 and told["number"]["shape_share"] is None and told["number"]["unique"] == 30


def test_patterns_are_tried_once_for_each_shape(spark):
    """Values that differ in digits alone are one shape; a number keeps its zeros, as its number of digits asks for them."""
    df = spark.createDataFrame([(i, f"user{i}@example.com", f"2024-01-{i % 28 + 1:02}" if i % 10 else "2024-13-45", 100 + i + (0.0 if i % 2 else 0.5)) for i in range(100, 900)], "_row_id long, mail string, day string, number double")
    values = profile.value_table(df)
    shapes = profile.value_shapes(values, ["mail", "day"]).groupBy("column").agg(F.count(F.lit(1)).alias("shapes"), F.sum("n").alias("n"), F.sum("k").alias("k"))
    got = {r["column"]: r for r in shapes.collect()}
    assert (got["mail"]["shapes"], got["mail"]["n"], got["mail"]["k"]) == (1, 800, 800)
    assert (got["day"]["shapes"], got["day"]["n"], got["day"]["k"]) == (1, 800, 29)
    assert got["number"]["k"] == 800 and got["number"]["shapes"] < 20
    typed = profile.Typed(df)
    types = {p.original_name: p for p in typed.profiles}
    assert types["mail"].logical_type == "Email" and types["mail"].unique_count == 800
    assert types["day"].logical_type == "Date stored as text" and types["day"].confidence == 0.9
    typed.values.unpersist()


def test_types_ask_for_no_figure_of_text(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, None, " ")], "_row_id long, a string, b string")
    assert len(profile.type_aggregates(df)) == 1
    typed = profile.Typed(df)
    assert [(s["present"], s["written"]) for s in typed.stats.values()] == [(1, 1), (2, 1)]
    assert [p.min_text_length for p in typed.figures()] == [1, 1]
    typed.values.unpersist()


def test_rows_that_share_a_hash_are_stored_before_they_are_counted_and_shown(spark):
    from qualiframe.operators import detect

    df = spark.range(60).selectExpr("id as _row_id", "if(id < 50, cast(id as string), 'x') as a", "if(id = 59, double('NaN'), 1.0d) as b", "if(id < 55, null, 2) as c")
    found = detect.duplicate_findings(df, 60)
    assert "InMemoryRelation" in found._jdf.queryExecution().withCachedData().toString()
    assert sorted(r["row_index"] for r in found.collect()) == [51, 52, 53, 54, 56, 57, 58]
    assert detect.duplicate_findings(df.filter("_row_id < 50"), 50) is None
