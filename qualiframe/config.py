"""Thresholds, word lists and mappings of the data-quality rules."""

from __future__ import annotations

ROW_ID = "_row_id"

# Files
CSV_EXTENSIONS = (".csv", ".txt")
EXCEL_EXTENSIONS = (".xlsx", ".xls")
MAX_FILE_MB = 200
SNIFF_BYTES = 100_000
ENCODING_FALLBACKS = ("utf-8", "utf-8-sig", "windows-1255", "cp1255", "windows-1252", "latin-1")
DELIMITERS = (",", ";", "\t", "|")

# Text that a CSV load turns into null
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Text that stands for a missing value, compared in lower case without outer white space
PLACEHOLDERS = ("n/a", "na", "null", "none", "unknown", "-", "--", "missing", "not available", "nan", "#n/a")

# Share of values that a type needs
EMAIL_RATE = URL_RATE = PHONE_RATE = 0.8
CURRENCY_RATE = 0.7
NUMERIC_TEXT_RATE = BOOLEAN_RATE = 0.9
DATE_GATE_RATE, DATE_PARSE_RATE = 0.6, 0.85
MIXED_RANGE = (0.15, 0.85)
PHONE_PUNCTUATION_RATE = 0.3
IDENTIFIER_UNIQUE, IDENTIFIER_MIN_ROWS, IDENTIFIER_FORMAT = 0.95, 5, 0.8
CATEGORICAL_MAX_VALUES, CATEGORICAL_UNIQUE = 30, 0.2
FREE_TEXT_LENGTH, FREE_TEXT_UNIQUE, FREE_TEXT_UNIQUE_LENGTH = 25.0, 0.9, 8.0
IDENTIFIER_HINTS = ("id", "code", "number", "key", "uuid", "guid", "identifier")
CURRENCY_HINTS = ("price", "cost", "amount", "salary", "fee", "revenue", "total", "pay", "wage", "income", "expense", "cash", "balance")
PHONE_HINTS = ("phone", "tel", "mobile", "cell", "fax")
SEMANTIC_MIN_ROWS, SEMANTIC_PHONE_LENGTH, SEMANTIC_LENGTH_SHARE, SEMANTIC_UNIQUE = 8, (7, 15), 0.8, 0.9
SEMANTIC_HIGH, SEMANTIC_MODERATE, SEMANTIC_REDUCED = 0.85, 0.65, 0.7

MAX_EXAMPLES = 5
IQR_FACTOR = 1.5
MISSING_CUTOFFS = (0.05, 0.2, 0.5)
DUPLICATE_CUTOFFS = EMPTY_ROW_CUTOFFS = (0.02, 0.1, 0.3)
OLD_YEARS, FUTURE_YEARS = 100, 5
MAX_DISPLAYED, MAX_SAMPLE_ROWS = 500, 50
LOW_CONFIDENCE = 0.7
SCHEMA_VERSION = "1.1.0"

SEVERITIES = ("Low", "Medium", "High", "Critical")

# Logical types
EMPTY, BOOLEAN, INTEGER, DECIMAL, NUMERIC_TEXT = "Empty", "Boolean", "Integer", "Decimal", "Numeric stored as text"
DATE, DATETIME, DATE_TEXT = "Date", "Datetime", "Date stored as text"
CATEGORICAL, FREE_TEXT, EMAIL, PHONE, URL = "Categorical", "Free text", "Email", "Phone number", "URL"
IDENTIFIER, CURRENCY, MIXED, UNKNOWN = "Possible identifier", "Possible currency", "Mixed type", "Unknown"
NUMERIC_TYPES = (INTEGER, DECIMAL, NUMERIC_TEXT, CURRENCY)
DATE_TYPES = (DATE, DATETIME, DATE_TEXT)
TEXT_TYPES = (CATEGORICAL, FREE_TEXT, EMAIL, URL, PHONE, IDENTIFIER, MIXED, UNKNOWN)
OVERRIDE_OPTIONS = {
    "Identifier": IDENTIFIER, "Categorical": CATEGORICAL, "Numeric": DECIMAL, "Currency": CURRENCY, "Boolean": BOOLEAN, "Date / Datetime": DATE,
    "Email": EMAIL, "Phone number": PHONE, "URL": URL, "Text": FREE_TEXT, "Mixed / Unknown": MIXED,
}

# Score components: weight and the issue types that count
COMPONENTS = {
    "Completeness": (30.0, ("missing_null", "blank_string", "whitespace_only_string", "missing_placeholder")),
    "Uniqueness": (15.0, ("exact_duplicate_row", "identifier_duplicate_value")),
    "Validity": (25.0, ("value_fails_type_conversion", "unexpected_text_in_numeric_column", "invalid_date", "infinite_value")),
    "Consistency": (15.0, ("leading_trailing_whitespace", "repeated_internal_spaces", "non_printable_characters", "similar_category_values", "inconsistent_capitalization", "mixed_date_formats", "numeric_format_inconsistency")),
    "Structural Quality": (15.0, ("empty_row", "empty_column", "duplicate_column_name", "near_duplicate_column_name", "column_name_whitespace", "inconsistent_column_name_formatting", "numeric_stored_as_text", "date_stored_as_text", "mixed_data_types")),
}

# Issue type: (category, confidence, safe to fix without a decision)
ISSUES = {
    "exact_duplicate_row": ("Dataset", 1.0, True), "empty_row": ("Dataset", 1.0, True), "empty_column": ("Dataset", 1.0, True),
    "duplicate_column_name": ("Dataset", 1.0, False), "near_duplicate_column_name": ("Dataset", 1.0, False),
    "column_name_whitespace": ("Dataset", 1.0, True), "inconsistent_column_name_formatting": ("Dataset", 0.7, False),
    "missing_null": ("Missing Value", 1.0, False), "blank_string": ("Missing Value", 1.0, True), "whitespace_only_string": ("Missing Value", 1.0, True), "missing_placeholder": ("Missing Value", 0.9, True),
    "numeric_stored_as_text": ("Type", None, True), "value_fails_type_conversion": ("Type", 0.9, False), "date_stored_as_text": ("Type", None, True),
    "mixed_data_types": ("Type", None, False), "unexpected_text_in_numeric_column": ("Type", 0.7, False),
    "leading_trailing_whitespace": ("Text", 1.0, True), "repeated_internal_spaces": ("Text", 1.0, True), "non_printable_characters": ("Text", 1.0, True),
    "similar_category_values": ("Text", 0.75, False), "inconsistent_capitalization": ("Text", 0.8, False),
    "infinite_value": ("Numeric", 1.0, False), "possible_outlier": ("Numeric", 0.7, False), "negative_value": ("Numeric", 1.0, False),
    "suspiciously_constant_column": ("Numeric", 0.6, False), "numeric_format_inconsistency": ("Numeric", 0.6, False),
    "invalid_date": ("Date", 0.9, False), "mixed_date_formats": ("Date", 0.7, False), "unusually_old_date": ("Date", 0.5, False), "unusually_future_date": ("Date", 0.5, False),
    "identifier_missing_values": ("Identifier", 1.0, False), "identifier_duplicate_value": ("Identifier", 1.0, False), "identifier_inconsistent_format": ("Identifier", 0.6, False),
}

# Issue type: what it means, in our own words
EXPLANATIONS = {
    "exact_duplicate_row": "The row repeats an earlier row in every column.",
    "empty_row": "No column of the row has a value.",
    "empty_column": "No row has a value in this column.",
    "duplicate_column_name": "Several columns have exactly this name.",
    "near_duplicate_column_name": "Column names that differ only in case or punctuation.",
    "column_name_whitespace": "The column name begins or ends with white space.",
    "inconsistent_column_name_formatting": "Column names follow more than one style.",
    "missing_null": "The cell has no value.",
    "blank_string": "The cell holds an empty string.",
    "whitespace_only_string": "The cell holds nothing but white space.",
    "missing_placeholder": "The cell holds a word that stands for a missing value.",
    "numeric_stored_as_text": "The column holds numbers kept as text.",
    "value_fails_type_conversion": "The value is no number although its column is.",
    "date_stored_as_text": "The column holds dates kept as text.",
    "mixed_data_types": "No single type describes the column.",
    "unexpected_text_in_numeric_column": "Text in a column of mostly numbers.",
    "leading_trailing_whitespace": "The value begins or ends with white space.",
    "repeated_internal_spaces": "The value has several spaces in a row.",
    "non_printable_characters": "The value has characters that cannot be shown.",
    "similar_category_values": "Spellings that differ in case and punctuation.",
    "inconsistent_capitalization": "Spellings that differ in case only.",
    "infinite_value": "The number is infinite.",
    "possible_outlier": "The number is far outside the middle half of the column.",
    "negative_value": "The number is below zero.",
    "suspiciously_constant_column": "Every value of the column is the same.",
    "numeric_format_inconsistency": "Decimal commas and decimal points are mixed.",
    "invalid_date": "The value is no date although its column is.",
    "mixed_date_formats": "The date is written unlike most of its column.",
    "unusually_old_date": "The date is more than a hundred years ago.",
    "unusually_future_date": "The date is more than five years ahead.",
    "identifier_missing_values": "An identifier column has missing values.",
    "identifier_duplicate_value": "The identifier occurs more than once.",
    "identifier_inconsistent_format": "The identifier is built unlike most of its column.",
}

GUIDED_TYPES = ("missing_null", "possible_outlier", "negative_value", "similar_category_values", "inconsistent_capitalization")

# Display labels that are more than the issue type's own words
LABELS = {
    "exact_duplicate_row": "Duplicate row", "column_name_whitespace": "Column name has whitespace", "identifier_duplicate_value": "Duplicate identifier", "identifier_inconsistent_format": "Inconsistent identifier format",
    "identifier_missing_values": "Missing identifier", "leading_trailing_whitespace": "Leading/trailing whitespace", "missing_null": "Missing values", "missing_placeholder": "Missing value placeholder",
    "non_printable_characters": "Non-printable characters", "whitespace_only_string": "Whitespace-only value", "numeric_format_inconsistency": "Inconsistent numeric format", "numeric_stored_as_text": "Number stored as text", "repeated_internal_spaces": "Repeated spaces",
}
