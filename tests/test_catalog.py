"""Rules for tables of names, sizes and choices, held against their versions for one value."""

from pyspark.sql import functions as F

from qualiframe import config as C
from qualiframe.functions import expr as E
from qualiframe.functions import names as N
from qualiframe.operators import detect, overrides, profile
from qualiframe.sources import loader

HEADERS = {
    "plain": ["id", "amount", "amount"], "near": ["Order Date", "order_date", "total"], "styles": ["snake_case", "kebab-case", "camelCase", "Two Words", "Name", "one"], "blank": ["", " ", "\tx ", "_"],
    "tripled": ["A b", "A b", "a_b"], "one": ["solo"], "odd": ["é", "Ünïcode name", "a--b", "9 lives", "aB\n"],
}


def _headers(spark):
    rows = [(d, i, n) for d, names in HEADERS.items() for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "dataset string, place int, name string").repartition(3)


def test_findings_of_many_headers_are_those_of_each(spark):
    got = {(r["dataset"], r["issue_type"], r["severity"], r["confidence"], r["column_name"], r["suggested_value"], r["place"]) for r in detect.header_findings(_headers(spark)).collect()}
    want = []
    for d, names in HEADERS.items():
        want += [(d, f[0], f[1], f[2], f[3], f[6]) for f in detect.name_findings(names)]
    assert len(got) == len(want)
    assert sorted(map(repr, (g[:-1] for g in got))) == sorted(map(repr, want))


def test_null_names_count_as_empty(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, ""), (2, 0, None)], "dataset int, place int, name string")
    got = detect.header_findings(rows).select("dataset", "place", "issue_type").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "duplicate_column_name"), (1, 1, "duplicate_column_name")]
    assert detect.header_findings(rows.limit(0)).count() == 0


def test_names_by_columns_and_one_by_one(spark):
    plain = N.normalized(F.col("name"))
    for r in _headers(spark).select("name", plain.alias("plain"), N.style(F.col("name")).alias("style"), *[N.hinted(plain, h).alias(k) for k, h in (("i", C.IDENTIFIER_HINTS), ("c", C.CURRENCY_HINTS))]).collect():
        assert r["plain"] == profile.normalize_name(r["name"])
        assert r["style"] == detect.name_style(r["name"])
        assert (r["i"], r["c"]) == (profile.has_hint(r["plain"], C.IDENTIFIER_HINTS), profile.has_hint(r["plain"], C.CURRENCY_HINTS))


def test_sizes_by_columns_and_one_by_one(spark):
    sizes = [0, 1, 1023, 1024, 1280, 1075, 1048575, 1048576, 1572864, 1023 * 1024**2, 5 * 1024**3, 1024**4, 3000 * 1024**4]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", E.shown_size(F.col("n")).alias("shown")).collect()
    assert [r["shown"] for r in rows] == [loader.human_size(r["n"]) for r in rows]


def test_choices_by_tables_and_one_by_one(spark):
    rows = [("a", C.FREE_TEXT, next(iter(C.OVERRIDE_OPTIONS))), ("b", C.EMAIL, "no such label"), ("c", C.CATEGORICAL, "Categorical")]
    got = overrides.override_log(spark.createDataFrame(rows, "column_name string, inferred_type string, label string"), "run", "now").collect()
    assert [r.asDict() for r in got] == [overrides.override_record("run", c, k, l, "now") for c, k, l in rows]
