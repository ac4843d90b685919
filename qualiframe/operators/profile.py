"""Column profiles and type inference: one pass of plain aggregates, one of distinct values.

The plain pass is a single wide aggregate.  The distinct pass unpivots text and counts each value of
each column with its first row, so uniqueness, examples, value shapes and every pattern rate come
from distinct values weighted by their counts.  Both results have one row per column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import expr as E
from . import ranks as R

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass
class ColumnProfile:
    """Profile of one column; the inferred type never changes, the effective one may be overridden."""

    original_name: str
    normalized_name: str
    storage_type: str
    logical_type: str
    confidence: float
    non_null_count: int
    missing_count: int
    missing_pct: float
    unique_count: int
    unique_ratio: float
    duplicate_value_count: int
    example_values: list[str] = field(default_factory=list)
    effective_logical_type: str = ""
    type_overridden: bool = False
    user_selected_type: str | None = None
    min_value: float | None = None
    max_value: float | None = None
    mean: float | None = None
    median: float | None = None
    std: float | None = None
    min_date: str | None = None
    max_date: str | None = None
    min_text_length: float | None = None
    max_text_length: float | None = None
    avg_text_length: float | None = None
    outlier_count: int | None = None
    evidence: dict[str, Any] = field(default_factory=dict)


def normalize_name(name: str) -> str:
    """Lower case, other characters than letters and digits as single underscores; never empty."""
    return re.sub("[^0-9a-z]+", "_", name.strip().lower()).strip("_") or "column"


def has_hint(normalized: str, hints: tuple[str, ...]) -> bool:
    """Whether a hint is a word of the name, or, if longer than two letters, its end."""
    return bool(set(normalized.split("_")) & set(hints)) or any(len(h) > 2 and normalized.endswith(h) for h in hints)


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Plans whose generated method has over 8000 bytes of code run as Spark's split projections meanwhile, unless the session has chosen a limit: the JVM never compiles such a method."""
    key = "spark.sql.codegen.hugeMethodLimit"
    plain = spark.conf.get(key) == "65535"
    if plain:
        spark.conf.set(key, "8000")
    try:
        yield
    finally:
        if plain:
            spark.conf.unset(key)


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != C.ROW_ID]


def text_cells(df: DataFrame, names: list[str]) -> DataFrame:
    """(_row_id, column, value) of each cell as text, null where it is missing.

    By a generator: stored tables made by unpivoting are not found again where they are joined to themselves.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.when(~E.missing(df, n), F.col(f"`{n}`").cast("string")).alias("value")) for n in names])
    return df.select(F.col(C.ROW_ID), F.explode(cells).alias("cell")).select(C.ROW_ID, "cell.*")


def value_table(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, value, n, first_row): each distinct present value of each column as text, with its count."""
    names = names or data_columns(df)
    return text_cells(df, names).filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.min(C.ROW_ID).alias("first_row"))


def type_aggregates(df: DataFrame) -> list[Column]:
    """The few figures of numbers and times that types are told from."""
    out = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(data_columns(df)):
        c, kind = F.col(f"`{n}`"), df.schema[n].dataType
        if isinstance(kind, NUMERIC):
            v = F.when(~E.missing(df, n), c.cast("double"))
            out += [F.min(v).alias(f"{i}_min"), F.bool_and((F.abs(v) != float("inf")) & (v == F.floor(v))).alias(f"{i}_whole")]
            if has_hint(normalize_name(n), C.CURRENCY_HINTS):
                out.append(F.avg((F.abs(F.round(v, 2) - v) < 1e-9).cast("double")).alias(f"{i}_cents"))
        elif isinstance(kind, TIMES):
            stamp = c.cast("timestamp_ntz")
            out.append(F.bool_or((F.hour(stamp) != 0) | (F.minute(stamp) != 0) | (F.second(stamp) != 0)).alias(f"{i}_timed"))
    return out


def plain_aggregates(df: DataFrame) -> list[Column]:
    out = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(data_columns(df)):
        c, kind = F.col(f"`{n}`"), df.schema[n].dataType
        here = ~E.missing(df, n)
        out.append(F.count_if(here).alias(f"{i}_present"))
        if isinstance(kind, NUMERIC):
            v = F.when(here, c.cast("double"))
            finite = F.when(F.abs(v) != float("inf"), v)
            out += [f(v).alias(f"{i}_{k}") for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp))]
            out += [F.count(finite).alias(f"{i}_finite"), F.count_if(v < 0).alias(f"{i}_negative")]
            out += [F.bool_and((F.abs(v) != float("inf")) & (v == F.floor(v))).alias(f"{i}_whole"), F.avg(F.when(here, (F.abs(F.round(v, 2) - v) < 1e-9).cast("double"))).alias(f"{i}_cents"), F.min(finite).alias(f"{i}_finite_min"), F.max(finite).alias(f"{i}_finite_max")]
        elif isinstance(kind, TIMES):
            stamp = c.cast("timestamp_ntz")
            out += [F.min(c).cast("string").alias(f"{i}_min_date"), F.max(c).cast("string").alias(f"{i}_max_date")]
            out += [F.bool_or((F.hour(stamp) != 0) | (F.minute(stamp) != 0) | (F.second(stamp) != 0)).alias(f"{i}_timed")]
        elif isinstance(kind, T.StringType):
            v = F.when(here, c)
            out += [F.count_if(E.strip(v) != "").alias(f"{i}_written"), F.min(F.length(v)).alias(f"{i}_short"), F.max(F.length(v)).alias(f"{i}_long"), F.avg(F.length(v)).alias(f"{i}_length")]
    return out


def value_shapes(values: DataFrame, text: list[str] | None = None) -> DataFrame:
    """(column, value, n, k): rows and distinct values of each shape, which stands for all values that differ in digits alone.

    No pattern of text tells a digit from another.  The number of digits of a number asks which are 0,
    so those stay in columns that are not named in ``text`` (in all, if none are named).
    """
    v = F.col("value")
    shape = F.regexp_replace(v, "[2-9]", "1")
    if text:
        shape = F.when(F.col("column").isin(*text), F.regexp_replace(v, "[1-9]", "0")).otherwise(shape)
    return R.few_parts(values.groupBy("column", shape.alias("value")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")))


def dated_shares(values: DataFrame, names: list[str]) -> dict[str, float]:
    """Share of the written values of columns that are dates: asked for columns that look like dates, as here digits matter."""
    t = F.col("trimmed")
    dated = t.rlike(E.DATE_LIKE) & E.parse_date(F.lower(t), trimmed=True).isNotNull()
    some = values.filter(F.col("column").isin(*names)).withColumn("trimmed", E.strip(F.col("value"))).filter("trimmed <> ''").withColumn("dated", dated)
    shares = some.groupBy("column").agg((F.sum(F.when(F.col("dated"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    return {r["column"]: r["share"] for r in shares.collect()}


def distinct_aggregates(values: DataFrame, examples: bool = True, text: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(aggregates, facts to release once they are read): one row per column from ``value_table``: distinct values, pattern rates over written values, shape shares and, unless spared, examples.

    If the columns of ``text`` are named, only theirs are tried for patterns, and only other ones for
    their number of digits, which is what types are told from.
    """
    v = F.col("value")
    is_text = F.lit(True) if text is None else F.col("column").isin(*text) if text else F.lit(False)
    other = F.lit(True) if text is None else ~is_text
    examined = value_shapes(values, text)
    # What each shape is, as columns of their own; the aggregates behind only count.
    t = F.col("trimmed")
    examined = examined.withColumn("trimmed", E.strip(v)).withColumn("small", F.when(is_text, F.lower("trimmed")))
    examined = examined.withColumns({"digit": is_text & t.rlike("[0-9]"), "letter": is_text & t.rlike(r"\p{L}"), "numeral": E.maybe_number(t)})
    examined = examined.withColumn("cleaned", F.when(is_text & F.col("numeral"), E.clean_number(t, trimmed=True)))
    written, digit, letter = t != "", F.col("digit"), F.col("letter")
    tests = {
        "boolean": F.col("small").isin(*E.BOOLEANS), "email": t.contains("@") & t.rlike(E.EMAIL), "url": F.left("small", F.lit(1)).isin("h", "f", "w") & t.rlike(E.URL), "phone": digit & ~letter & E.is_phone(t, trimmed=True), "phone_marks": t.rlike(E.PHONE_PUNCTUATION), "currency": digit & t.rlike(E.CURRENCY),
        "date_like": digit & t.rlike(E.DATE_LIKE), "numeric": F.coalesce(F.col("cleaned").rlike(E.NUMBER) | F.col("cleaned").rlike(E.SPECIAL_NUMBER), F.lit(False)),
    }
    shape = F.struct(F.length("trimmed").alias("length"), letter.alias("letters"), digit.alias("digits"))
    # Patterns are tried once for each shape; what they tell is small and read by each of the groupings below.
    facts = examined.select(
        "column", "n", "k", written.alias("written"), F.length("trimmed").alias("length"), *[(is_text & written & x).alias(f"is_{k}") for k, x in tests.items()],
        F.when(is_text & written, shape).alias("shape"), F.when(other & F.col("numeral"), F.length(F.regexp_replace(v, r"(?:\.0*)?$|^-", ""))).alias("digits"),
    ).persist()

    def rate(name: str) -> Column:
        return F.try_divide(F.sum(F.when(F.col(f"is_{name}"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("written"), F.col("n")).otherwise(0))).alias(name)

    def distinct(test: str) -> Column:
        return F.sum(F.when(F.col(test), F.col("k")).otherwise(0))

    shares = facts.groupBy("column", "shape").agg(F.sum("n").alias("k")).filter("shape is not null").groupBy("column").agg((F.max("k") / F.sum("k")).alias("shape_share"))
    lengths = facts.filter("digits is not null").groupBy("column", "digits").agg(F.sum("n").alias("k")).groupBy("column").agg((F.max("k") / F.sum("k")).alias("digit_share"), F.max(F.struct("k", (-F.col("digits")).alias("d")))["d"].alias("minus_digits"))
    rates = facts.groupBy("column").agg(
        F.sum("n").alias("present"), F.sum(F.when(F.col("written"), F.col("n")).otherwise(0)).alias("written"), F.sum("k").alias("unique"), distinct("written").alias("unique_written"), *[rate(k) for k in tests],
        (F.sum(F.when(F.col("written"), F.col("length") * F.col("n"))) / F.sum(F.when(F.col("written"), F.col("n")))).alias("written_length"), distinct("is_boolean").alias("boolean_values"),
    )
    told = rates.join(shares, "column", "left").join(lengths, "column", "left")
    return (told.join(example_values(values), "column", "left") if examples else told), facts


def example_values(values: DataFrame) -> DataFrame:
    """(column, examples): the first distinct values of each column."""
    top = values.withColumn("_n", F.row_number().over(W.partitionBy("column").orderBy("first_row", "value"))).filter(F.col("_n") <= C.MAX_EXAMPLES)
    return top.groupBy("column").agg(F.transform(F.sort_array(F.collect_list(F.struct("first_row", "value"))), lambda s: s["value"]).alias("examples"))


def _whole(name: str, base: float, s: dict[str, Any]) -> tuple[str, float, dict[str, Any]]:
    """Integer, unless name and shape say phone number or identifier."""
    n, unique = s["present"], s["unique"] / s["present"]
    if n >= C.SEMANTIC_MIN_ROWS:
        low, high = C.SEMANTIC_PHONE_LENGTH
        steady = s["digit_share"] >= C.SEMANTIC_LENGTH_SHARE
        phone = s["min"] >= 0 and steady and low <= s["digits"] <= high
        for hints, kind, a, b in ((C.PHONE_HINTS, C.PHONE, phone, unique >= C.SEMANTIC_UNIQUE), (C.IDENTIFIER_HINTS, C.IDENTIFIER, steady, unique >= C.IDENTIFIER_UNIQUE)):
            if has_hint(name, hints):
                evidence = {"length_share": s["digit_share"], "unique_ratio": unique}
                if a or b:
                    return kind, C.SEMANTIC_HIGH if a and b else C.SEMANTIC_MODERATE, evidence
                return C.INTEGER, min(base, C.SEMANTIC_REDUCED), evidence
    return C.INTEGER, base, {}


def infer(name: str, kind: T.DataType, s: dict[str, Any]) -> tuple[str, float, dict[str, Any]]:
    """(logical type, confidence, evidence) from a column's aggregates."""
    n = s["present"]
    if not n:
        return C.EMPTY, 1.0, {}
    normalized = normalize_name(name)
    if isinstance(kind, T.BooleanType):
        return C.BOOLEAN, 1.0, {}
    if isinstance(kind, TIMES):
        return (C.DATETIME if s["timed"] else C.DATE), 1.0, {}
    if isinstance(kind, NUMERIC):
        floating = isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType))
        hint = has_hint(normalized, C.CURRENCY_HINTS)
        if not floating:
            return (C.CURRENCY, 0.6, {"hint": True}) if hint else _whole(normalized, 1.0, s)
        if s["whole"]:
            return _whole(normalized, 0.9, s)
        return (C.CURRENCY, min(0.6 + 0.3 * s["cents"], 0.9), {"hint": True, "cents": s["cents"]}) if hint else (C.DECIMAL, 1.0, {})
    if not s["written"]:
        return C.EMPTY, 1.0, {}
    r = {k: s[k] or 0.0 for k in ("boolean", "email", "url", "phone", "currency", "date_like", "numeric")}
    if r["boolean"] >= C.BOOLEAN_RATE and s["unique_written"] <= 4:
        return C.BOOLEAN, r["boolean"], r
    if r["email"] >= C.EMAIL_RATE:
        return C.EMAIL, r["email"], r
    if r["url"] >= C.URL_RATE:
        return C.URL, r["url"], r
    if r["currency"] >= C.CURRENCY_RATE:
        return C.CURRENCY, r["currency"], r
    if r["date_like"] >= C.DATE_GATE_RATE and s["dated"] >= C.DATE_PARSE_RATE:
        return C.DATE_TEXT, s["dated"], r
    if r["numeric"] >= C.NUMERIC_TEXT_RATE:
        return C.NUMERIC_TEXT, r["numeric"], r
    if r["phone"] >= C.PHONE_RATE and (s["phone_marks"] >= C.PHONE_PUNCTUATION_RATE or has_hint(normalized, C.PHONE_HINTS)):
        return C.PHONE, r["phone"], r
    best = max(r.values())
    if C.MIXED_RANGE[0] <= best <= C.MIXED_RANGE[1]:
        return C.MIXED, 1 - abs(2 * best - 1), r | {"dominant": next(k for k, x in r.items() if x == best)}
    unique, length = s["unique_written"] / s["written"], s["written_length"]
    if unique >= C.IDENTIFIER_UNIQUE and s["written"] >= C.IDENTIFIER_MIN_ROWS:
        hint, steady = has_hint(normalized, C.IDENTIFIER_HINTS), s["shape_share"] >= C.IDENTIFIER_FORMAT
        if hint or steady:
            return C.IDENTIFIER, min(0.5 + 0.25 * hint + 0.2 * steady, 0.95), r
    if s["unique_written"] < s["written"] and (s["unique_written"] <= C.CATEGORICAL_MAX_VALUES or unique <= C.CATEGORICAL_UNIQUE):
        return C.CATEGORICAL, min(max(1 - unique, 0.5), 0.95), r
    if length >= C.FREE_TEXT_LENGTH or (unique >= C.FREE_TEXT_UNIQUE and length >= C.FREE_TEXT_UNIQUE_LENGTH):
        return C.FREE_TEXT, min(0.5 + length / 100, 0.9), r
    return C.UNKNOWN, 0.3, r


def _rounded(x: float | None, digits: int) -> float | None:
    return None if x is None else round(float(x), digits)


def collect_statistics(df: DataFrame, values: DataFrame) -> tuple[int, dict[str, dict[str, Any]]]:
    """(rows, statistics by column) that types are told from: small results, one row and one row per column. ``values`` is the stored ``value_table``."""
    plain = df.agg(*type_aggregates(df)).first().asDict()
    names = data_columns(df)
    told, dated = {}, {}
    if names:
        values.count()  # stored before: its plan has the settings of when it was marked
        with short_methods(df.sparkSession):
            rows, facts = distinct_aggregates(values, examples=False, text=[n for n in names if E.is_text(df, n)])
            told = {r["column"]: r.asDict() for r in rows.collect()}
            if days := [n for n, r in told.items() if (r["date_like"] or 0.0) >= C.DATE_GATE_RATE]:
                dated = dated_shares(values, days)
        facts.unpersist()
    out = {}
    for i, n in enumerate(names):
        s = {"present": 0, "written": 0, "unique": 0, "unique_written": 0, "digit_share": 0.0, "minus_digits": 0, "shape_share": 0.0, "dated": dated.get(n, 0.0)}
        s |= {k.split("_", 1)[1]: v for k, v in plain.items() if k.startswith(f"{i}_")} | {k: v for k, v in told.get(n, {}).items() if v is not None}
        for k in ("boolean", "email", "url", "phone", "phone_marks", "currency", "date_like", "numeric", "written_length"):
            s.setdefault(k, 0.0)
        s["digits"] = -(s["minus_digits"] or 0)
        out[n] = s
    return plain["rows"], out


class Typed:
    """Types of all columns of a table, and its distinct values, which later steps read again; figures that no type needs are worked out when asked for."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.values = R.few_parts(value_table(df)).persist() if data_columns(df) else None
        rows, self.stats = collect_statistics(df, self.values)
        self.profiles = [self._profile(n, s, rows) for n, s in self.stats.items()]

    def _profile(self, n: str, s: dict[str, Any], rows: int) -> ColumnProfile:
        kind = self.df.schema[n].dataType
        logical, confidence, evidence = infer(n, kind, s)
        return ColumnProfile(
            original_name=n, normalized_name=normalize_name(n), storage_type=kind.simpleString(), logical_type=logical, confidence=confidence,
            non_null_count=s["present"], missing_count=rows - s["present"], missing_pct=round(100 * (rows - s["present"]) / rows, 2) if rows else 0.0,
            unique_count=s["unique"], unique_ratio=round(s["unique"] / s["present"], 3) if s["present"] else 0.0,
            duplicate_value_count=max(s["present"] - s["unique"], 0), effective_logical_type=logical, evidence=evidence,
        )

    def figures(self) -> list[ColumnProfile]:
        """The profiles with examples, lengths of text and all figures of numbers and dates; those kept as text get theirs in one more pass."""
        df, out = self.df, [replace(p) for p in self.profiles]
        plain = df.agg(*plain_aggregates(df)).first().asDict()
        stats = {n: s | {k.split("_", 1)[1]: v for k, v in plain.items() if k.startswith(f"{i}_")} for i, (n, s) in enumerate(self.stats.items())}
        shown = {r["column"]: list(r["examples"]) for r in example_values(self.values).collect()} if self.values is not None else {}
        numbers = [n for n in stats if isinstance(df.schema[n].dataType, NUMERIC)]
        quartiles = R.percentiles_of(df, {n: F.when(~E.missing(df, n), F.col(f"`{n}`").cast("double")) for n in numbers})
        later = []
        for p in out:
            n, kind = p.original_name, df.schema[p.original_name].dataType
            p.example_values = shown.get(n, [])
            if p.logical_type in C.DATE_TYPES and isinstance(kind, TIMES):
                p.min_date, p.max_date = stats[n]["min_date"], stats[n]["max_date"]
            if isinstance(kind, T.StringType) and p.logical_type not in (*C.NUMERIC_TYPES, *C.DATE_TYPES, C.EMPTY, C.BOOLEAN):
                p.min_text_length, p.max_text_length, p.avg_text_length = stats[n]["short"], stats[n]["long"], _rounded(stats[n]["length"], 2)
            if n in numbers:
                stats[n]["quartiles"] = quartiles.get(n)
            if p.logical_type in C.NUMERIC_TYPES and isinstance(kind, NUMERIC):
                _numbers(p, stats[n])
            if isinstance(kind, T.StringType) and p.logical_type in (*C.NUMERIC_TYPES, *C.DATE_TYPES) or p.logical_type in C.NUMERIC_TYPES:
                later.append(p)
        _late_figures(df, later, stats)
        return out


def profile(df: DataFrame) -> list[ColumnProfile]:
    """Profiles of all columns in order."""
    typed = Typed(df)
    try:
        return typed.figures()
    finally:
        if typed.values is not None:
            typed.values.unpersist()


def _numbers(p: ColumnProfile, s: dict[str, Any]) -> None:
    p.min_value, p.max_value, p.mean, p.std = s["min"], s["max"], _rounded(s["mean"], 4), _rounded(s["std"] or 0.0, 4)
    p.median = _rounded(s["quartiles"][1], 4) if s["quartiles"] else None


def _late_figures(df: DataFrame, profiles: list[ColumnProfile], stats: dict[str, dict[str, Any]]) -> None:
    """Figures of numbers and dates kept as text, then outlier counts of all numeric columns."""
    exprs, texts = [], {}
    for i, p in enumerate(profiles):
        if p.logical_type in C.DATE_TYPES:
            d = E.parse_date(F.col(f"`{p.original_name}`"))
            exprs += [F.min(d).cast("string").alias(f"{i}_min_date"), F.max(d).cast("string").alias(f"{i}_max_date")]
        elif E.is_text(df, p.original_name):
            v = E.number_of(df, p.original_name)
            exprs += [F.count(v).alias(f"{i}_present"), F.min(v).alias(f"{i}_min"), F.max(v).alias(f"{i}_max"), F.avg(v).alias(f"{i}_mean"), F.stddev_samp(v).alias(f"{i}_std")]
            texts[p.original_name] = v
    got = df.agg(*exprs).first().asDict() if exprs else {}
    quartiles = R.percentiles_of(df, texts)
    fences = []
    for i, p in enumerate(profiles):
        own = {k.split("_", 1)[1]: v for k, v in got.items() if k.startswith(f"{i}_")}
        if p.logical_type in C.DATE_TYPES:
            p.min_date, p.max_date = own["min_date"], own["max_date"]
            continue
        if own:
            own["quartiles"] = quartiles.get(p.original_name)
        s = own or stats[p.original_name]
        if own and own["present"]:
            _numbers(p, own)
        if s["present"] >= 4 and s["quartiles"]:
            q1, _, q3 = s["quartiles"]
            p.outlier_count = 0
            if q3 > q1:
                v, reach = E.number_of(df, p.original_name), C.IQR_FACTOR * (q3 - q1)
                fences.append((p, F.count_if((v < q1 - reach) | (v > q3 + reach))))
    if fences:
        row = df.agg(*[c.alias(str(i)) for i, (_, c) in enumerate(fences)]).first()
        for i, (p, _) in enumerate(fences):
            p.outlier_count = row[i]


PROFILE_SCHEMA = (
    "original_name string, normalized_name string, storage_type string, logical_type string, confidence double, non_null_count long, missing_count long, missing_pct double, "
    "unique_count long, unique_ratio double, duplicate_value_count long, example_values array<string>, effective_logical_type string, type_overridden boolean, user_selected_type string, "
    "min_value double, max_value double, mean double, median double, std double, min_date string, max_date string, min_text_length double, max_text_length double, avg_text_length double, outlier_count long"
)


def profile_frame(spark, profiles: list[ColumnProfile]) -> DataFrame:
    """Profiles as a table, one row per column."""
    schema = T._parse_datatype_string(PROFILE_SCHEMA)
    rows = [tuple(float(v) if isinstance(f.dataType, T.DoubleType) and v is not None else v for f in schema.fields for v in [getattr(p, f.name)]) for p in profiles]
    return spark.createDataFrame(rows, schema)
