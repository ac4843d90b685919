"""Column expressions of the scalar rules; all of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EXPLANATIONS, LABELS, PLACEHOLDERS, SEVERITIES

# The patterns of the rules. White space is listed, as engines differ in what \s means.
WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STRIP = rf"^{WS}+|{WS}+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SPECIAL_NUMBER = r"(?i)^[+-]?(inf|infinity|nan)$"
NUMBER_MARKS = r"[$€£¥₪,%\x09-\x0d\x20\x{a0}]"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
URL = r"(?i)^(https?://|ftp://|www\.)\S+$"
PHONE_MARKS = r"[\s\-().]"
PHONE = r"^\+*[0-9]{7,15}$"
PHONE_PUNCTUATION = r"[\s\-().]|^\+"
CURRENCY = r"(?i)^\(?-?\s*(?:[$€£¥₪]|usd|eur|gbp|ils|nis)\s*-?[0-9][0-9,]*\.?[0-9]*\)?$|^\(?-?[0-9][0-9,]*\.?[0-9]*\s*(?:[$€£¥₪]|usd|eur|gbp|ils|nis)\)?$"
DATE_LIKE = (
    r"(?i)^[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}([ t][0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?$"
    r"|^[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}([ t][0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?$"
    r"|^[0-9]{8}$|^[0-9]{1,2}\s+[a-z]{3,9}\s+[0-9]{2,4}$|^[a-z]{3,9}\s+[0-9]{1,2},?\s+[0-9]{2,4}$"
)
DOT_DECIMAL, COMMA_DECIMAL = r"^-?[0-9]{1,3}(,[0-9]{3})*\.[0-9]+$", r"^-?[0-9]{1,3}(\.[0-9]{3})*,[0-9]+$"
NON_PRINTABLE = r"[\p{C}\p{Zl}\p{Zp}&&[^\n\t]]|[\p{Zs}&&[^ ]]"
BOOLEANS = ("true", "false", "yes", "no", "y", "n", "t", "f")


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating column."""
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if is_floating(df, name) else c.isNull()


#: The characters of ``WS``.
WS_CHARS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Those of ``NUMBER_MARKS`` and ``PHONE_MARKS``.
NUMBER_CHARS, PHONE_CHARS = "$€£¥₪,%\t\n\x0b\x0c\r \xa0", " \t\n\x0b\x0c\r-()."


def strip(c: Column) -> Column:
    """Without what ``STRIP`` matches; only the ends are looked at, not every place."""
    return F.btrim(c, F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    """Single spaces stay as they are, so text is only rebuilt if it has other white space or several in a row."""
    return strip(F.when(c.rlike(r"  |[^\x21-\x7e ]"), F.regexp_replace(c, rf"{WS}+", " ")).otherwise(c))


def unprintable(c: Column) -> Column:
    """Whether ``printable`` drops anything; the costly class is only tried on text with other than plain characters."""
    return c.rlike(r"[^\x20-\x7e]") & c.rlike(NON_PRINTABLE)


def printable(c: Column) -> Column:
    return F.when(unprintable(c), F.regexp_replace(c, NON_PRINTABLE, "")).otherwise(c)


def clean_number(c: Column, trimmed: bool = False) -> Column:
    """Without symbols, thousands separators and percent signs; ``(x)`` becomes ``-x``.

    One chain, in which each step reads the one before once: a sign of no meaning (U+E000) stands for
    the brackets until the rest is known.  Spark's generated code stays small this way.  Text that
    begins with no bracket needs none of its patterns.
    """
    text = c if trimmed else strip(c)
    marked = F.regexp_replace(F.translate(text, "\ue000", "?"), r"(?s)^\((.*)\)$", "\ue000$1")
    bare = F.translate(marked, NUMBER_CHARS, "")
    bracketed = F.regexp_replace(F.regexp_replace(bare, "^\ue000(?=[^-])", "-"), "^\ue000", "")
    return F.when(text.startswith("("), bracketed).otherwise(F.translate(text, "\ue000" + NUMBER_CHARS, "?"))


def maybe_number(trimmed: Column) -> Column:
    """False only for text with a letter that no written number has, told at its first such letter."""
    return trimmed.rlike(r"(?i)^[^b-dg-hj-mo-su-xz]*$")


def is_number(c: Column) -> Column:
    cleaned = clean_number(c)
    return cleaned.rlike(NUMBER) | cleaned.rlike(SPECIAL_NUMBER)


def to_number(c: Column) -> Column:
    """The value of a number kept as text; null where it is none."""
    cleaned = clean_number(c)
    return F.when(cleaned.rlike(NUMBER), cleaned.try_cast("double"))


def number_of(df: DataFrame, name: str) -> Column:
    """Value of a numeric or numeric-text column as a double."""
    c = F.col(f"`{name}`")
    return to_number(c) if is_text(df, name) else c.cast("double")


def signature(c: Column) -> Column:
    return F.struct(F.length(c).alias("length"), c.rlike(r"\p{L}").alias("letters"), c.rlike(r"[0-9]").alias("digits"))


def date_shape(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]", "D")


def is_boolean(c: Column) -> Column:
    return F.lower(strip(c)).isin(*BOOLEANS)


def is_phone(c: Column, trimmed: bool = False) -> Column:
    return F.translate(c if trimmed else strip(c), PHONE_CHARS, "").rlike(PHONE)


def has_phone_marks(c: Column) -> Column:
    return strip(c).rlike(PHONE_PUNCTUATION)


def is_placeholder(c: Column, tokens=PLACEHOLDERS) -> Column:
    return F.lower(strip(c)).isin(*tokens)


def parse_float(c: Column) -> Column:
    """A value typed by a user as a double, by the rules of a plain number: no currency, no grouping, underscores only between digits; null for anything else."""
    digits = r"[0-9](?:_?[0-9])*"
    v = strip(c)
    plain = v.rlike(rf"(?i)^[+-]?(?:{digits}\.?(?:{digits})?|\.{digits})(?:e[+-]?{digits})?$")
    named = F.regexp_replace(F.lower(v), "^[+]", "")
    special = F.when(named.isin("inf", "infinity"), float("inf")).when(named.isin("-inf", "-infinity"), -float("inf")).when(named.isin("nan", "-nan"), float("nan"))
    return F.when(plain, F.replace(v, F.lit("_"), F.lit("")).try_cast("double")).otherwise(special)


def custom_date(c: Column, kind: str) -> Column:
    """A date typed by a user: a checked date (as text) for columns stored as dates, else the text as it is; null if blank or no date."""
    return F.when(c != "", parse_date(c).cast("string") if kind in DATE_STORED else c)


#: Effective types of columns that are stored as dates.
DATE_STORED = ("Date", "Datetime")
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _ymd(y: Column, m: Column, d: Column) -> Column:
    """A checked date from numbers as text; two-digit years lie within 50 years before or after 2026."""
    year = y.try_cast("int")
    year = F.when(F.length(y) <= 2, F.when(year > 75, year + 1900).otherwise(year + 2000)).otherwise(year)
    text = F.format_string("%04d-%02d-%02d", year, m.try_cast("int"), d.try_cast("int"))
    return F.when(year.isNotNull() & m.isNotNull() & d.isNotNull(), text.try_cast("date"))


def parse_date(c: Column, trimmed: bool = False) -> Column:
    """Date of the written forms that ``DATE_LIKE`` admits, month first unless that is impossible; null where it is none.

    ``trimmed`` says that the text is in lower case and without outer white space, worked out once for the many patterns.
    """
    v = c if trimmed else F.lower(strip(c))

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(v, pattern, group)

    ymd = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})(?:[ t]|$)"
    dmy = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{2,4})(?:[ t]|$)"
    compact = r"^([0-9]{4})([0-9]{2})([0-9]{2})$"
    day_name = r"^([0-9]{1,2})\s+([a-z]{3})[a-z]*\s+([0-9]{2,4})$"
    name_day = r"^([a-z]{3})[a-z]*\s+([0-9]{1,2}),?\s+([0-9]{2,4})$"

    def month(name: Column) -> Column:
        at = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), name)
        return F.when(at > 0, at.cast("string"))

    return (
        F.when(v.rlike(ymd), _ymd(part(ymd, 1), part(ymd, 2), part(ymd, 3)))
        .when(v.rlike(dmy), F.coalesce(_ymd(part(dmy, 3), part(dmy, 1), part(dmy, 2)), _ymd(part(dmy, 3), part(dmy, 2), part(dmy, 1))))
        .when(v.rlike(compact), _ymd(part(compact, 1), part(compact, 2), part(compact, 3)))
        .when(v.rlike(day_name), _ymd(part(day_name, 3), month(part(day_name, 2)), part(day_name, 1)))
        .when(v.rlike(name_day), _ymd(part(name_day, 3), month(part(name_day, 1)), part(name_day, 2)))
    )


def ratio_severity(ratio: Column, cutoffs: tuple[float, float, float]) -> Column:
    low, medium, high = cutoffs
    return F.when(ratio < low, "Low").when(ratio < medium, "Medium").when(ratio < high, "High").otherwise("Critical")


def severity_rank(c: Column) -> Column:
    return sum((F.when(c == s, i).otherwise(0) for i, s in enumerate(SEVERITIES)), F.lit(0))


def label(c: Column) -> Column:
    """An issue type as words: its own label, else its name with the first letter large."""
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[c]
    words = F.replace(c, F.lit("_"), F.lit(" "))
    return F.coalesce(known, F.concat(F.upper(F.substring(words, 1, 1)), words.substr(F.lit(2), F.length(words))))


def explanation(c: Column) -> Column:
    """What an issue type means; null for one that is not known."""
    return F.create_map(*[F.lit(x) for pair in EXPLANATIONS.items() for x in pair])[c]


def shown_size(c: Column) -> Column:
    """A number of bytes for people: whole bytes below 1024, else one digit of KB, MB, GB or TB."""
    shown = F.concat(c.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        one = F.concat(F.replace(F.format_number(c / 1024**k, 1), F.lit(","), F.lit("")), F.lit(f" {unit}"))
        shown = F.when(c < 1024**k, shown).otherwise(one)
    return shown


def score_of(count: Column, total: Column) -> tuple[Column, Column]:
    """(score, penalty) of ``count`` findings among ``total``."""
    penalty = F.when(total <= 0, 0.0).otherwise(F.least(count / total * 100, F.lit(100.0)))
    return F.round(F.greatest(100 - penalty, F.lit(0.0)), 2), F.round(penalty, 2)
