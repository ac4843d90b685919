"""Encodings of text files, told from all of their bytes.

One distributed pass per set of files counts, for each file, pairs of neighbouring bytes of words, one
of them above 127 (at most 256 x 256 rows a file), lines that break the rules of an encoding of
several bytes, and zero bytes.  A code page is then judged by what the pairs would say in it: letters
of one language, or of those that a text mixes, cost little, by how common they are there, while signs
inside of words, letters of two scripts side by side and capitals after small letters cost much.  The
cheapest page wins; its confidence is the share of the worst possible cost that it saves.
"""

from __future__ import annotations

import codecs
import math
import unicodedata
from collections import defaultdict
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C

# Letters beyond ASCII of some languages, the common ones first, and code pages in order of preference.
LETTERS = {
    "French": "éèàêçùâîôûëïœæÿ", "German": "üäößé", "Spanish": "óíáéñúü", "Portuguese": "ãçéáóêíúâõà", "Italian": "àèìòùé", "Danish": "åøæé", "Swedish": "äåöé",
    "Polish": "łęążśćóńź", "Czech": "íáéýěšřžčůúťňďó", "Hungarian": "éáöóőüíűú", "Romanian": "ăîâșțşţ", "Turkish": "ıişğüçöâ",
    "Russian": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", "Ukrainian": "оанивтерсілкудмпзяьбгчхцюїйєжшщфґ", "Greek": "αοιετσνηυρπκμλςωίόάγέδήχθύφβώξζψϊ", "Hebrew": "יוהלאתרבשמנםקעחכדפסטזגצןףךץ",
    "Arabic": "اليمنوتربدعسفهكقحجةشأصخطذءغضزىإئظثآؤ",
}
PAGES = (
    "windows-1252", "windows-1255", "latin-1", "iso-8859-15", "windows-1250", "iso-8859-2", "windows-1251", "koi8-r", "iso-8859-5", "cp866", "windows-1253", "iso-8859-7", "windows-1254", "iso-8859-9",
    "windows-1256", "iso-8859-8", "cp850", "cp437", "cp852", "mac-roman", "mac-cyrillic", "koi8-u",
)
# Well-formed lines, lead bytes of common characters.
WIDE = {
    "shift_jis": (r"[\x00-\x7f\xa1-\xdf]|[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]", r"[\x82\x83\x88-\x97]"),
    "euc-jp": (r"[\x00-\x7f]|[\xa1-\xfe][\xa1-\xfe]|\x8e[\xa1-\xdf]|\x8f[\xa1-\xfe][\xa1-\xfe]", r"[\xa4\xa5]"),
    "euc-kr": (r"[\x00-\x7f]|[\xa1-\xfe][\xa1-\xfe]", r"[\xb0-\xc8]"),
    "gb18030": (r"[\x00-\x7f]|[\x81-\xfe](?:[\x40-\x7e\x80-\xfe]|[\x30-\x39][\x81-\xfe][\x30-\x39])", r"[\xb0-\xd7]"),
    "big5": (r"[\x00-\x7f]|[\x81-\xfe][\x40-\x7e\xa1-\xfe]", r"[\xa4-\xc6]"),
}
#: Bits: a letter that no language of the page has, a sign inside of a word, a control character, two scripts, a capital after a small letter, accents side by side, a rarer page.
STRANGE, SIGN, CONTROL, MIXED, CAPITAL, BESIDE, RARE = 8.0, 10.0, 12.0, 7.0, 5.0, 2.0, 24.0
UNSURE = 0.5
#: Steps that fit the shares of languages in a text.
ROUNDS = 25


@lru_cache(maxsize=64)
def code_page(encoding: str) -> tuple[str | None, ...] | None:
    """Characters of bytes 128 to 255, None where there is none; None for an encoding that is not ASCII and single bytes."""
    out: list[str | None] = []
    try:
        if bytes(range(128)).decode(encoding) != bytes(range(128)).decode("ascii"):
            return None
        for b in range(128, 256):
            try:
                c = codecs.getincrementaldecoder(encoding)().decode(bytes([b]))
            except UnicodeDecodeError:
                c = None
            if c == "":
                return None
            out.append(c)
    except (UnicodeDecodeError, LookupError, TypeError):
        return None
    return tuple(out) if any(out) else None


def _script(c: str) -> str:
    n = ord(c)
    return "latin" if n < 0x370 or 0x1E00 <= n < 0x1F00 else "greek" if n < 0x400 else "cyrillic" if n < 0x530 else "hebrew" if n < 0x600 else "arabic" if n < 0x700 else "other"


@lru_cache(maxsize=64)
def _ranks(language: str) -> dict[str, float]:
    letters = LETTERS[language]
    return {c: math.log2(2 + i) for i, c in enumerate(letters)}


def _letter_costs(chars: set[str], counts: dict[str, int]) -> dict[str, float]:
    """Cost of each letter in the language, or the mix of languages, that makes the whole cheapest; texts quote words of other languages."""
    every = {c: [_ranks(x).get(c, _ranks(x).get(c.lower(), STRANGE - 1.5) + 1.5) for x in LETTERS] for c in chars}
    totals = [sum(every[c][i] * counts[c] for c in chars) for i in range(len(LETTERS))]
    best = min(range(len(LETTERS)), key=totals.__getitem__)
    alone = {c: costs[best] for c, costs in every.items()}
    # shares of the languages by expectation and maximization, from equal ones on
    odds = {c: [2.0**-x for x in costs] for c, costs in every.items()}
    shares, n = [1 / len(LETTERS)] * len(LETTERS), sum(counts[c] for c in chars)
    for _ in range(ROUNDS if chars else 0):
        parts = [0.0] * len(LETTERS)
        for c, odd in odds.items():
            each = [s * o for s, o in zip(shares, odd)]
            times = counts[c] / sum(each)
            parts = [p + times * x for p, x in zip(parts, each)]
        shares = [p / n for p in parts]
    mixed = {c: -math.log2(sum(s * o for s, o in zip(shares, odd))) for c, odd in odds.items()}
    return min(alone, mixed, key=lambda costs: sum(costs[c] * counts[c] for c in chars))


def page_cost(pairs: dict[tuple[int, int], int], encoding: str) -> float:
    """Bits that the pairs cost in a code page; infinite if a byte has no character there."""
    page = code_page(encoding)
    show = lambda b: chr(b) if b < 128 else page[b - 128]
    counts: dict[str, int] = defaultdict(int)
    for (_, b), n in pairs.items():
        if b >= 128:
            if show(b) is None:
                return math.inf
            counts[show(b)] += n
    letters = {c for c in counts if c.isalpha()}
    costs = _letter_costs(letters, counts)
    total = 0.0
    for (x, y), n in pairs.items():
        a, b = show(x), show(y)
        if a is None or b is None:
            return math.inf
        cost = costs.get(b, 0.0) if y >= 128 else 0.0
        if y >= 128 and not b.isalpha():
            # quotes and dashes stand at the ends of words, money and the like anywhere but inside
            mark = unicodedata.category(b)[0] in "PZ" or unicodedata.category(b) == "Sc"
            cost += CONTROL if not b.isprintable() and b != "\xa0" else 2.0 if mark and not a.isalpha() and x < 128 else SIGN
        if x >= 128 and not a.isalpha() and b.isalpha():
            cost += 2.0 if unicodedata.category(a)[0] == "P" else SIGN / 2
        if a.isalpha() and b.isalpha():
            if _script(a) != _script(b):
                cost += MIXED
            elif x >= 128 and y >= 128 and _script(a) == "latin":
                cost += BESIDE
            if b.isupper() and a.islower():
                cost += CAPITAL
        total += n * cost
    return total


def judge(pairs: dict[tuple[int, int], int], broken: dict[str, int], common: dict[str, float]) -> tuple[str, float]:
    """(encoding, confidence) of a file with bytes above 127 that is no valid utf-8."""
    high = sum(n for (_, b), n in pairs.items() if b >= 128)
    if not high:
        return "utf-8", 1.0
    costs = {e: page_cost(pairs, e) + (0.0 if e in C.ENCODING_FALLBACKS else RARE) for e in PAGES}
    for e in WIDE:
        if not broken[e]:
            # what looks Korean is common in Chinese too, but not the other way round
            costs[e] = high * (2.0 + 5.0 * (1 - common[e]) + 0.3 * (e == "gb18030")) + RARE
    best = min(costs, key=costs.get)
    if math.isinf(costs[best]):
        return "utf-8", 0.0
    free = 0.0 if best in C.ENCODING_FALLBACKS else RARE
    return best, max(0.0, 1 - (costs[best] - free) / high / SIGN)


def _lines(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, Column, Column]:
    raw = F.col("value")
    text = F.decode(raw.cast("binary"), "iso-8859-1")
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return lines, raw, text


def detect(spark: SparkSession, path: str | list[str], by_folder: bool = False) -> dict[str, tuple[str, float]]:
    """(encoding, confidence) of the files of each folder, or of all files together under an empty name.

    Plain ASCII and valid utf-8 are utf-8.  Zero bytes tell utf-16 and utf-32 apart by where they are.
    """
    lines, raw, text = _lines(spark, path)
    file = (F.regexp_replace("file", "/[^/]*$", "") if by_folder else F.lit("")).alias("file")
    facts = {"invalid": F.count_if(~F.is_valid_utf8(raw)), "lines": F.count(F.lit(1)), "size": F.sum(F.octet_length(raw))}
    facts["zeros"] = facts["size"] - F.sum(F.octet_length(F.replace(raw, F.lit("\x00"), F.lit(""))))
    # lines end at byte 10, whose zero byte comes after it (little end first) or before
    facts["not_after"] = F.count_if(~raw.startswith("\x00"))
    facts["not_before"] = F.count_if(~raw.endswith("\x00"))
    facts["files"] = F.count_distinct("file")
    told = {r["name"]: r for r in lines.groupBy(file.alias("name")).agg(*[v.alias(k) for k, v in facts.items()]).collect()}
    unsure = [n for n, r in told.items() if r["invalid"] and not r["zeros"]]
    broken, common = {}, {}
    if unsure:  # only lines with a byte above 127, of files that are no utf-8, can tell code pages and encodings of several bytes apart
        lines, text = lines.select(file, text.alias("text")), F.col("text")
        lines = lines.filter(text.rlike(r"[\x80-\xff]") & F.col("file").isin(*unsure))
        fits = [F.count_if(~text.rlike(rf"^(?:{whole})*+$")).alias(e) for e, (whole, _) in WIDE.items()]
        broken = {r["file"]: r for r in lines.groupBy("file").agg(*fits).collect()}
        whole = [e for e in WIDE if any(not r[e] for r in broken.values())]
        if whole:
            marked = F.regexp_replace(text, r"([\x81-\xfe][\x40-\xfe])", "$1\x00")  # pairs of bytes from the left, each with an end
            leads = [F.sum(F.regexp_count(marked, F.lit(rf"{WIDE[e][1]}[\x40-\xfe]\x00"))).alias(e) for e in whole]
            common = {r["file"]: r.asDict() for r in lines.groupBy("file").agg(*leads).collect()}
    # bytes above 127 with the letters beside them, as what two other bytes say is the same in all pages; equal ones are cut into pairs once
    words = F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-z]?[\x80-\xff](?:[A-Za-z]?[\x80-\xff])*+[A-Za-z]?"), 0))
    words = lines.select("file", words.alias("word")).groupBy("file", "word").count().withColumn("word", F.concat(F.lit(" "), "word", F.lit(" ")))
    pairs = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2))))
    counted = words.select("file", pairs.alias("pair"), "count").groupBy("file", "pair").agg(F.sum("count").alias("count")) if unsure else None
    of: dict[str, dict[tuple[int, int], int]] = defaultdict(dict)
    for r in counted.collect() if counted is not None else ():  # at most 65,536 rows a file
        of[r["file"]][tuple(map(ord, r["pair"]))] = r["count"]
    out = {}
    for name, r in told.items():
        if r["zeros"]:
            little = r["not_after"] >= r["files"] and r["not_after"] - r["files"] <= r["not_before"]
            out[name] = (f"utf-{32 if r['zeros'] > 0.62 * (r['size'] + r['lines']) else 16}-{'le' if little else 'be'}", 1.0)
        elif not r["invalid"]:
            out[name] = ("utf-8", 1.0)
        else:
            high = max(1, sum(n for (_, b), n in of[name].items() if b >= 128))
            out[name] = judge(of[name], {e: broken[name][e] for e in WIDE}, {e: min(1.0, 2 * (common.get(name, {}).get(e) or 0) / high) for e in WIDE})
    return out
