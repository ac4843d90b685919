"""The data-quality engine on small tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from qualiframe import config as C
from qualiframe.functions import expr as E
from qualiframe.operators import clean, compare, detect, overrides, profile, score, strategies
from qualiframe.plans import engine
from qualiframe.sources import loader, xlsx
from qualiframe.store import RunStore, StoreError, history


def frame(spark, schema, rows):
    return spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"_row_id long, {schema}")


def found(spark, schema, rows, kinds=None, **options):
    df = frame(spark, schema, rows)
    return engine.analyze(df, chosen=kinds, **options).issues.collect()


def of(issues, kind):
    return sorted(i["row_index"] if i["row_index"] is not None else -1 for i in issues if i["issue_type"] == kind)


# ---- expressions -------------------------------------------------------------------------------


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "v string").select(f(F.col("v")).alias("x")).first()[0]


@pytest.mark.parametrize("text, number", [("12", 12.0), ("$1,234.50", 1234.5), ("(5)", -5.0), ("12%", 12.0), (" 1e3 ", 1000.0), ("abc", None), ("", None), ("-", None), (".", None), ("1d", None), ("1_000", None), ("(-5)", -5.0)])
def test_numbers(spark, text, number):
    assert value(spark, text, E.to_number) == number


@pytest.mark.parametrize("text, day", [("2023-01-05", "2023-01-05"), ("13/01/2023", "2023-01-13"), ("01/02/2023", "2023-01-02"), ("20230115", "2023-01-15"), ("Jan 5, 2023", "2023-01-05"), ("5 January 2023", "2023-01-05"), ("2023.01.05", "2023-01-05"), ("01/15/23", "2023-01-15"), ("01/15/99", "1999-01-15"), ("2023-02-30", None), ("2023", None), ("10:30", None), ("x", None), (None, None)])
def test_dates(spark, text, day):
    assert value(spark, text, lambda c: E.parse_date(c).cast("string")) == day


def test_text_rules(spark):
    assert value(spark, "  a 　", E.strip) == "a"
    assert value(spark, " a \t b ", E.collapse) == "a b"
    assert value(spark, "a\x07b​c\nd", E.printable) == "abc\nd"
    assert value(spark, "+1 (555) 010-0001", E.is_phone) and not value(spark, "12345", E.is_phone)
    assert value(spark, "a@b.co", lambda c: c.rlike(E.EMAIL)) and not value(spark, "a@b", lambda c: c.rlike(E.EMAIL))
    assert value(spark, "€ 5", lambda c: c.rlike(E.CURRENCY)) and value(spark, "5 usd", lambda c: c.rlike(E.CURRENCY))
    assert value(spark, "missing_null", E.label) == "Missing values" and value(spark, "mixed_date_formats", E.label) == "Mixed date formats"


# ---- types -------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "name, kind, rows, logical",
    [
        ("x", "string", [None, None], C.EMPTY), ("x", "string", ["", "  "], C.EMPTY), ("x", "boolean", [True, None], C.BOOLEAN), ("x", "string", ["Yes", "no", "YES"], C.BOOLEAN),
        ("crates", "long", list(range(3, 43)), C.INTEGER), ("Year", "long", list(range(1961, 2003)), C.INTEGER), ("Phone", "long", [738400190 + 7 * i for i in range(31)], C.PHONE), ("Badge ID", "long", list(range(52300, 52340)), C.IDENTIFIER),
        ("unit_price", "double", [1.5, 2.25], C.CURRENCY), ("ratio", "double", [1.5, 2.25], C.DECIMAL), ("n", "double", [1.0, None, 3.0], C.INTEGER), ("email", "string", ["a@b.co", "c@d.org"], C.EMAIL),
        ("u", "string", ["https://a.b", "www.c.d"], C.URL), ("freight_amount", "string", ["$7.35", "$81.00", "$460.20", "$3.05"], C.CURRENCY), ("d", "string", ["2023-01-01", "2023-01-02"], C.DATE_TEXT), ("depth", "string", [str(11 * i) for i in range(19)] + ["shallow"], C.NUMERIC_TEXT),
        ("p", "string", ["+1 555-010-0001", "+1 555-010-0002"], C.PHONE), ("reading", "string", ["71", "oak", "8.5", "elm", "940", "ash", "66", "fir"], C.MIXED), ("parcel_id", "string", [f"PX{i:04d}" for i in range(40, 75)], C.IDENTIFIER),
        ("status", "string", ["A", "B", "A", "B", "C"], C.CATEGORICAL), ("notes", "string", [f"a sentence of some length {'very ' * i}{i}" for i in range(12)], C.FREE_TEXT), ("day", "timestamp_ntz", [datetime(2023, 1, 1)], C.DATE), ("at", "timestamp_ntz", [datetime(2023, 1, 1, 5)], C.DATETIME),
    ],
)
def test_types(spark, name, kind, rows, logical):
    assert profile.profile(frame(spark, f"`{name}` {kind}", rows))[0].logical_type == logical


def test_profile_figures(spark):
    a, b = profile.profile(frame(spark, "stats double, city string", [(4.0, "Quito"), (12.0, None), (28.0, "Turku"), (36.0, "Quito")]))
    assert (a.min_value, a.max_value, a.mean, a.median, a.outlier_count) == (4, 36, 20, 20, 0)
    assert (b.non_null_count, b.missing_count, b.missing_pct, b.unique_count, b.duplicate_value_count, b.example_values) == (3, 1, 25.0, 2, 1, ["Quito", "Turku"])
    assert profile.profile(frame(spark, "a string", []))[0].logical_type == C.EMPTY
    one = profile.profile(frame(spark, "a double", [5.5]))[0]
    assert (one.std, one.outlier_count) == (0.0, None)


# ---- issues ------------------------------------------------------------------------------------


def test_missing_values(spark):
    issues = found(spark, "status string", ["open", None, "N/A", "", "   ", "unknown", "shut"])
    assert of(issues, "missing_null") == [1] and of(issues, "missing_placeholder") == [2, 5] and of(issues, "blank_string") == [3] and of(issues, "whitespace_only_string") == [4]
    assert not of(found(spark, "n long, f boolean", [(0, True), (1, False), (0, True)]), "missing_null")


def test_rows_columns_and_names(spark):
    issues = found(spark, "a long, b string, c string", [(1, "x", None), (2, "y", None), (1, "x", None), (None, None, None)])
    assert of(issues, "exact_duplicate_row") == [2] and of(issues, "empty_row") == [3] and len(of(issues, "empty_column")) == 1
    names = detect.name_findings(["a", "a", "Customer ID", "customer_id", " b"])
    assert [n[0] for n in names].count("duplicate_column_name") == 2 and [n[0] for n in names].count("near_duplicate_column_name") == 2 and [n[0] for n in names].count("column_name_whitespace") == 1
    assert {n[3] for n in detect.name_findings(["first_name", "lastName", "Age X"]) if n[0] == "inconsistent_column_name_formatting"} == {"first_name", "lastName", "Age X"}


def test_text_variants(spark):
    rows = ["Port Said", "port-said", "Port_Said", "Lima", "lima", "Lima"] * 3
    issues = found(spark, "city string", rows, {"city": "Categorical"})
    assert len(of(issues, "similar_category_values")) == 6 and len(of(issues, "inconsistent_capitalization")) == 3
    assert {i["suggested_value"] for i in issues if i["issue_type"] == "inconsistent_capitalization"} == {"Lima"}
    issues = found(spark, "name string", ["  tern", "heron  ", "grey   plover", "rail\x00"])
    assert of(issues, "leading_trailing_whitespace") == [0, 1] and of(issues, "repeated_internal_spaces") == [2] and of(issues, "non_printable_characters") == [3]


def test_numbers_found(spark):
    assert of(found(spark, "value long", [42, 40, 43, 41, 44, 39, 42, 7300, 41, 43]), "possible_outlier") == [7]
    assert of(found(spark, "value double", [float("-inf"), 6.5, 7.25, float("inf")]), "infinite_value") == [0, 3]
    assert len(of(found(spark, "value long", [17] * 6), "suspiciously_constant_column")) == 1
    assert of(found(spark, "value long", [12, -8, 31, 25, -2, 19, 27, 33, 14]), "negative_value") == [1, 4]
    assert of(found(spark, "amount string", ["1.234,56", "2.5", "3.5", "4.5"], {"amount": "Currency"}), "numeric_format_inconsistency") == [0]
    issues = found(spark, "depth string", ["shallow"] + [str(13 * i) for i in range(15)])
    assert of(issues, "value_fails_type_conversion") == [0] and len(of(issues, "numeric_stored_as_text")) == 1


def test_dates_found(spark):
    days = [f"2019-07-{i:02d}" for i in range(11, 23)]
    assert of(found(spark, "sown string", ["someday", *days]), "invalid_date") == [0]
    assert of(found(spark, "sown string", [*days, "08/30/2019"]), "mixed_date_formats") == [12]
    issues = found(spark, "d timestamp_ntz", [datetime(1790, 5, 4), datetime(2016, 3, 9), datetime(2048, 2, 2)])
    assert of(issues, "unusually_old_date") == [0] and of(issues, "unusually_future_date") == [2]


def test_identifiers(spark):
    ids = [f"PX{i:04d}" for i in range(40, 75)]
    issues = found(spark, "parcel_id string", [None, *ids, "?", "PX0043"])
    assert of(issues, "identifier_duplicate_value") == [4, 37] and len(of(issues, "identifier_missing_values")) == 1 and of(issues, "identifier_inconsistent_format") == [36]


def test_issue_ids_are_stable_and_empty_tables_work(spark):
    df = frame(spark, "a string, n long", [("x", 1), (None, 2), ("x", 1)])
    first, second = ({r["issue_id"] for r in engine.analyze(df).issues.collect()} for _ in range(2))
    assert first == second
    empty = engine.analyze(frame(spark, "a string, n long", []))
    assert {r["issue_type"] for r in empty.issues.collect()} == {"empty_column"}
    assert empty.components.count() == 5


# ---- overrides, scores, cleaning ---------------------------------------------------------------


def test_overrides_and_groups(spark):
    p = profile.profile(frame(spark, "salary double", [float(i) + 0.5 for i in range(8)] + [None, None]))
    changed = overrides.apply_overrides(p, {"salary": "Categorical"})
    assert changed[0].effective_logical_type == C.CATEGORICAL and changed[0].type_overridden and not p[0].type_overridden
    assert overrides.apply_overrides(p, {"salary": "nothing"})[0].effective_logical_type == p[0].logical_type
    a = engine.analyze(frame(spark, "salary double", [None, 1.5, None, 2.5]))
    group = overrides.issue_groups(a.issues).filter("issue_type = 'missing_null'").first()
    assert group["row_indices"] == [0, 2] and group["severity"] == "Critical"


def test_scores(spark):
    a = engine.analyze(frame(spark, "a double, b long", [(1.5, 1), (None, 2), (None, 3), (2.5, 4)]))
    row = {r["component_name"]: r for r in a.components.collect()}["Completeness"]
    assert (row["component_score"], row["denominator"], row["issue_count"]) == (75.0, 8, 2)
    assert sum(w for w, _ in C.COMPONENTS.values()) == 100
    kinds = [t for _, ts in C.COMPONENTS.values() for t in ts]
    assert len(kinds) == len(set(kinds)) and set(kinds) < set(C.ISSUES) and set(C.EXPLANATIONS) == set(C.ISSUES) == set(detect.ACTIONS)


def test_safe_fixes(spark):
    df = frame(spark, "`First Name` string, `first-name` string, empty string", [(" a  b ", "N/A", None), ("", "x\x07", None), (None, None, None), (" a  b ", "N/A", None)])
    p = profile.profile(df)
    before = sorted(map(tuple, df.collect()), key=str)
    out = clean.apply_fixes(df, p, [f.fix_id for f in clean.FIXES])
    assert sorted(map(tuple, df.collect()), key=str) == before
    assert out.df.columns == ["_row_id", "first_name", "first_name_2"]
    assert sorted(map(tuple, out.df.collect())) == [(0, "a b", None), (1, None, "x")]
    actions = {r["cleaning_action"]: r["changes"] for r in compare.fix_counts(out.audit).collect()}
    assert actions["nullify_blank_and_placeholders"] == 3 and actions["drop_duplicates"] == 1 and actions["remove_empty_rows"] == 1 and actions["remove_empty_columns"] == 1
    preview = {r["fix_id"]: r["affected"] for r in clean.preview_fixes(df, p).collect()}
    assert {k: v for k, v in preview.items() if v} == actions


def test_conversions_need_every_value(spark):
    df = frame(spark, "n string, d string", [("1", "2023-01-01"), ("2", "2023-01-02"), ("x", "2023-01-03")] + [("3", "2023-01-04")] * 20)
    p = profile.profile(df)
    out = clean.apply_fixes(df, p, ["convert_numbers", "convert_dates"])
    assert dict(out.df.dtypes)["n"] == "string" and dict(out.df.dtypes)["d"] == "timestamp_ntz" and len(out.notes) == 1


def test_replacements_and_strategies(spark):
    df = frame(spark, "score double", [10.0, 20.0, None, 40.0, -1000.0])
    a = engine.analyze(df)
    fill = strategies.resolve(df, a.issues, "score", "missing_null", "median")
    out, audit = clean.replace_values(df, "score", fill, "guided_missing_null_median", "decided")
    assert out.orderBy("_row_id").collect()[2]["score"] == 15.0 and audit.count() == 1
    assert strategies.resolve(df, a.issues, "score", "missing_null", "keep_null").count() == 0
    assert strategies.resolve(df, a.issues, "score", "negative_value", "zero").collect() == [(4, "0")]
    stats = strategies.numeric_stats(frame(spark, "x double", [4.0, 12.0, 28.0, 36.0]), "x").first()
    assert (stats["mean"], stats["q1"], stats["q3"]) == (20.0, 10.0, 30.0)
    assert strategies.missing_strategies(C.MIXED) == [] and "mean" in strategies.missing_strategies(C.DECIMAL) and strategies.negative_strategies(C.INTEGER, True)[0] == "null"


# ---- files -------------------------------------------------------------------------------------


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_csv(spark, tmp_path):
    got = loader.load(spark, write(tmp_path / "clean.csv", "id,name,amount\n1,Ann,2.5\n2,\"B, b\",\n3,n/a,4\n"))
    assert got.delimiter == "," and not got.warnings and dict(got.df.dtypes) == {"id": "bigint", "name": "string", "amount": "double", "_row_id": "bigint"}
    assert [tuple(r) for r in got.df.select("_row_id", "name").orderBy("_row_id").collect()] == [(0, "Ann"), (1, "B, b"), (2, None)]
    assert loader.load(spark, write(tmp_path / "semi.csv", "a;b\n1;2\n3;4\n")).delimiter == ";"
    dupes = loader.load(spark, write(tmp_path / "dupes.csv", "id,amount,amount\n1,2,3\n"))
    assert [c for c in dupes.df.columns if c != "_row_id"] == ["id", "amount", "amount_1"] and dupes.warnings and dupes.header == ["id", "amount", "amount"]
    assert loader.load(spark, write(tmp_path / "no.csv", "1,2,3\n4,5,6\n")).warnings
    assert loader.load(spark, write(tmp_path / "one.csv", "a,b\n1,2\n"), delimiter=";").warnings
    for bad in ("", "   \n "):
        with pytest.raises(loader.LoadError):
            loader.load(spark, write(tmp_path / "bad.csv", bad))
    for missing in (str(tmp_path / "absent.csv"), str(tmp_path / "x.json")):
        with pytest.raises(loader.LoadError):
            loader.load(spark, missing)


def test_csv_in_hebrew(spark, tmp_path):
    got = loader.load(spark, write(tmp_path / "hebrew.csv", "שם,עיר\nדנה,חיפה\n".encode("windows-1255")))
    assert [c for c in got.df.columns if c != "_row_id"] == ["שם", "עיר"] and got.df.first()["עיר"] == "חיפה"


def test_excel(spark, tmp_path):
    df = frame(spark, "name string, n double, ok boolean", [("a<b", 1.5, True), (None, 2.0, False)])
    path = write(tmp_path / "book.xlsx", loader.to_excel(df))
    assert loader.excel_sheets(spark, path) == ["Cleaned"]
    got = loader.load(spark, path)
    assert [tuple(r) for r in got.df.orderBy("_row_id").collect()] == [(0, "a<b", 1.5, True), (1, None, 2.0, False)]
    with pytest.raises(loader.LoadError):
        loader.load(spark, path, sheet="none")
    assert list(xlsx.read_sheet(xlsx.write_sheet(["a"], [["x"], [None]]))) == [["a"], ["x"], [None]]


def test_helpers():
    assert [loader.human_size(x) for x in (500, 1536, 5 * 1024**2)] == ["500 B", "1.5 KB", "5.0 MB"]
    assert loader.dedupe_columns(["a", "a", "a_1", "", "Unnamed: 3"])[0] == ["a", "a_1", "a_1_1", "column", "column_1"]
    with pytest.raises(loader.LoadError):
        loader.check_size(300 * 1024**2)


# ---- store, comparison, stream -----------------------------------------------------------------


def test_run_store(spark, tmp_path):
    df = frame(spark, "id long, name string", [(1, " a"), (2, "N/A"), (3, None)])
    session = engine.Session(engine.analyze(df, run_id="r1")).apply(["trim_whitespace", "nullify_blank_and_placeholders"], run_id="r1")
    store = RunStore(spark, str(tmp_path / "store"))
    engine.store_run(store, session, run_id="r1", dataset="set", file_type="csv", when="2025-01-01")
    assert store.exists("r1") and not store.exists("r2")
    with pytest.raises(StoreError):
        engine.store_run(store, session, run_id="r1", dataset="set", file_type="csv", when="2025-01-01")
    detail = store.detail("r1")
    assert detail["profiling_runs"].count() == 1 and detail["quality_scores"].count() == 10 and detail["applied_fixes"].count() == 2
    rows = history(spark, "db_history", store.tables()).collect()
    assert len(rows) == 1 and rows[0]["score_improvement"] is not None and rows[0]["fixes_applied_count"] == 2
    assert session.kpis().first()["issues_after"] is not None
    with pytest.raises(StoreError):
        store.save("r3", {"profiling_runs": spark.createDataFrame([("x", "a"), ("x", "b")], "dataset_name string, file_type string")})


def bundle(spark, *runs):
    return {
        "profiling_runs": spark.createDataFrame([(r, "set") for r in runs], "run_id string, dataset_name string"),
        "data_quality_issues": spark.createDataFrame([(r, "original", "Low", i) for r in runs for i in range(3)], "run_id string, dataset_version string, severity string, row_index long"),
    }


def counts(store):
    return {r["run_id"]: r["n"] for r in store.table("data_quality_issues").groupBy("run_id").agg(F.count("*").alias("n")).collect()}


def test_a_broken_save_leaves_nothing_and_can_be_repeated(spark, tmp_path, monkeypatch):
    import qualiframe.store as module

    store = RunStore(spark, str(tmp_path / "store"))
    for at in (0, 1):  # lost before the commit, and inside of it
        with monkeypatch.context() as m:
            def lost(_, path, data):
                if at:
                    open(path, "xb").close()
                raise OSError("lost")

            m.setattr(module, "put_if_absent", lost)
            with pytest.raises(OSError):
                store.save_all(bundle(spark, "r1", "r2"))
        (tmp_path / "store" / "log").mkdir(exist_ok=True)
        assert counts(store) == {} and not store.exists("r1")
    store.save_all(bundle(spark, "r1", "r2"))
    assert counts(store) == {"r1": 3, "r2": 3} and store.table("profiling_runs").count() == 2
    assert store.vacuum() == [] and len(store.vacuum(older_than_s=-1)) == 2 and counts(store) == {"r1": 3, "r2": 3}


def test_of_two_writers_of_a_run_one_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    stores = [RunStore(spark, str(tmp_path / "store")) for _ in range(4)]

    def save(i):
        try:
            stores[i].save_all(bundle(spark, "same") if i < 3 else bundle(spark, "other"))
            return True
        except StoreError:
            return False

    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(save, range(4)))
    assert sum(won[:3]) == 1 and won[3] and counts(stores[0]) == {"same": 3, "other": 3}


def test_deleting_a_run_cascades_and_frees_its_id(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    store.save_all(bundle(spark, "r1", "r2"))
    store.delete("r1")
    assert counts(store) == {"r2": 3} and not store.exists("r1")
    with pytest.raises(StoreError):
        store.delete("r1")
    store.save_all(bundle(spark, "r1"))
    assert counts(store) == {"r1": 3, "r2": 3}


def test_comparison(spark):
    a = spark.createDataFrame([("Text", "Low"), ("Text", "High"), ("Date", "Low")], "issue_category string, severity string")
    b = spark.createDataFrame([("Text", "Low"), ("Numeric", "Low")], "issue_category string, severity string")
    assert [tuple(r) for r in compare.categories(a, b).collect()] == [("Date", 1, 0), ("Numeric", 0, 1), ("Text", 2, 1)]
    assert [r["severity"] for r in compare.severities(a, b).collect()] == ["High", "Low"]


def test_stream(spark, tmp_path):
    from qualiframe.streaming import monitor

    df = spark.createDataFrame([(i, datetime(2025, 1, 1, 0, i), None if i % 3 == 0 else f" v{i}", float(-i)) for i in range(9)], "_row_id long, ts timestamp_ntz, name string, x double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    counts = monitor.windowed_counts(monitor.row_findings(stream, profile.profile(df)), "ts")
    run = counts.writeStream.outputMode("complete").format("memory").queryName("found_by_window").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {r["issue_type"]: r["n"] for r in spark.sql("select issue_type, sum(n) n from found_by_window group by 1").collect()}
    assert got["missing_null"] == 3 and got["negative_value"] == 8


def test_registered_queries_have_twins():
    from qualiframe import queries

    assert set(queries.oracle_sql()) == set(queries.queries()) and len(queries.oracle_sql()) > 200
