"""Encodings and line breaks of files."""

import csv
import io
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from qualiframe.sources import encodings, loader


def write(path, data):
    path.write_bytes(data)
    return str(path)


def cells(got, name):
    return [r[name] for r in got.df.orderBy("_row_id").select(name).collect()]


@pytest.mark.parametrize("encoding, word", [("windows-1255", "חיפה"), ("windows-1252", "Genève"), ("utf-8", "Genève")])
def test_encoding_is_that_of_all_bytes(spark, tmp_path, encoding, word):
    text = "id,city\n" + "".join(f"{i},plain ascii text\n" for i in range(8000)) + f"8000,{word}\n"
    got = loader.load(spark, write(tmp_path / "late.csv", text.encode(encoding)))
    assert got.encoding == encoding and len(text) > 150_000
    assert cells(got, "city")[-1] == word and got.df.count() == 8001


def test_western_text_is_not_hebrew(spark, tmp_path):
    got = loader.load(spark, write(tmp_path / "west.csv", "a,b\ncafé,Genève\nseñor,ÉTÉ\n".encode("windows-1252")))
    assert got.encoding == "windows-1252" and cells(got, "a") == ["café", "señor"] and cells(got, "b") == ["Genève", "ÉTÉ"]


def test_given_encoding_that_does_not_fit_falls_back(spark, tmp_path):
    path = write(tmp_path / "given.csv", "a,b\nחיפה,1\n".encode("windows-1255"))
    assert loader.load(spark, path, encoding="utf-8").encoding == "windows-1255"
    assert cells(loader.load(spark, path, encoding="windows-1252"), "a") == ["çéôä"]
    assert cells(loader.load(spark, write(tmp_path / "wide.csv", "a,b\nחיפה,1\n".encode("utf-16"))), "a") == ["חיפה"]


@pytest.mark.parametrize("encoding", ["utf-8", "windows-1255", "windows-1252", "shift_jis"])
def test_quoted_line_breaks_and_lines_equal_to_the_header(spark, tmp_path, encoding):
    word = {"windows-1252": "Genève", "shift_jis": "東京"}.get(encoding, "חיפה")
    text = f'id,city\n1,"{word}\nx, ""y"""\nid,city\n2,{word}\n'
    got = loader.load(spark, write(tmp_path / "breaks.csv", text.encode(encoding)), encoding=encoding)
    assert cells(got, "city") == [f'{word}\nx, "y"', "city", word] and cells(got, "id") == ["1", "id", "2"]


@pytest.mark.parametrize("encoding", ["utf-8", "windows-1255"])
def test_files_without_quoted_line_breaks_are_split(spark, tmp_path, encoding):
    path = write(tmp_path / "long.csv", ("id,city\r\n" + "".join(f'{i},"חיפה, ""{i}"""\r\n' for i in range(20000))).encode(encoding))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        got = loader.load(spark, path)
        assert got.df.rdd.getNumPartitions() > 1
        assert got.df.filter(got.df["id"] != got.df["_row_id"]).count() == 0 and cells(got, "city")[-1] == 'חיפה, "19999"'
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text, how", [('a,b\n"x ""y""",2\n', "lines"), ('a,b\n"x\ny",2\n', "records"), ('a,b\n5" z,"x\ny"\n', "records"), ("a,b\n1,2\r3,4\n", "whole"), ("a,b\r\n1,2\r\n", "lines"), ("a,b\n  \n1,2\n", "lines")])
def test_how_files_are_read(spark, tmp_path, text, how):
    assert loader.how_to_read(spark, write(tmp_path / "x.csv", text.encode()), ",") == how


def plain_rows(data, delimiter, header=True):
    """Rows by Python's own reader: blank lines go, empty cells are null."""
    rows = [r for r in csv.reader(io.StringIO(data.decode(), newline=""), delimiter=delimiter) if len(r) > 1 or r and r[0].strip()]
    width = max(map(len, rows))
    return [tuple(c or None for c in r + [None] * (width - len(r))) for r in rows[int(header) :]]


@pytest.fixture
def small_splits(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


CELLS = ["a", "", "two words", 'say ""hi""', "x\ny", "\n\n", "c,d", "crlf\r\nin", '""', "é☃", "long\n" * 40, "tail\n  \n"]


@pytest.mark.parametrize("size", [50, 170, 1 << 20])
def test_quoted_line_breaks_in_any_split(spark, tmp_path, small_splits, size):
    """The same records and ids wherever the splits fall, cells over several splits included."""
    rng = random.Random(size)
    lines = ["k,v,w"]
    for i in range(50):
        cells = [rng.choice(CELLS) for _ in range(2)]
        lines.append(",".join([str(i)] + [f'"{c}"' if any(x in c for x in '",\n\r') or rng.random() < 0.3 else c for c in cells]))
        lines += [rng.choice(["", "   "])] * (rng.random() < 0.1)
    lines += ['5" z,stray "q" here,x', 'last,"open quote', "goes on,1"]
    data = "\n".join(lines).encode()
    small_splits(size)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("k", "v", "w")])
    got = loader.read_records(spark, write(tmp_path / "x.csv", data), schema, delimiter=",", header=True, codec="utf-8").orderBy("_row_id").collect()
    wanted = plain_rows(data, ",")
    assert [r["_row_id"] for r in got] == list(range(len(wanted)))
    assert [(r["k"], r["v"], r["w"]) for r in got] == wanted


@pytest.mark.parametrize("kind", ["lines", "records", "parquet"])
def test_row_ids_of_several_files_under_two_split_sizes(spark, tmp_path, small_splits, kind):
    place = tmp_path / ("t.parquet" if kind == "parquet" else "t.csv")
    if kind == "parquet":
        spark.range(5000).repartition(3).write.parquet(str(place))
        wanted = [r["id"] for f in sorted(place.glob("*.parquet")) for r in pq.read_table(f).to_pylist()]
    else:
        place.mkdir()
        for f in range(3):
            cell = '"x\ny"' if kind == "records" else "x"
            write(place / f"part-{f}.csv", b"id,t\n" + b"".join(b"%d,%s\n" % (1000 * f + i, cell.encode()) for i in range(700)))
        wanted = [1000 * f + i for f in range(3) for i in range(700)]
    for size in (2000, 1 << 20):
        small_splits(size)
        got = loader.load(spark, str(place)).df
        assert [tuple(r) for r in got.select("_row_id", "id").orderBy("_row_id").collect()] == list(enumerate(wanted))


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_delimiter_is_that_of_most_lines(spark, tmp_path, small_splits, size):
    from qualiframe.sources import splits

    top = "id;note\n" + "".join(f"{i};a, b, c\n" for i in range(9))
    rest = "".join(f'{i};"x, y\nz; w, v | u\n"\n' for i in range(9)) + "".join(f"{i};plain\n" for i in range(12))
    small_splits(size)
    path = write(tmp_path / "x.csv", (top + rest).encode())
    counts = splits.delimiter_counts(spark, path, [",", ";", "|", "\t"])
    assert counts[";"] == {1: 22} and counts[","] == {0: 13, 2: 9} and counts["|"] == {0: 22}
    assert loader.steadiest_delimiter(counts) == ";" and loader.steadiest_delimiter({}) is None
    assert loader.steadiest_delimiter({",": {1: 5}, ";": {2: 5}}) == ";"


def test_workbooks_are_parsed_on_executors(spark, tmp_path, monkeypatch):
    from qualiframe.sources import xlsx

    path = write(tmp_path / "book.xlsx", xlsx.write_sheet(["n", "x", "mixed"], [[1, 1.5, "a"], [2, None, 3.0], [3, 2.0, True]]))

    def here(*_):
        raise AssertionError("parsed on the driver")

    monkeypatch.setattr(xlsx, "read_sheet", here)
    got = loader.load(spark, path)
    assert dict(got.df.dtypes) == {"_row_id": "bigint", "n": "bigint", "x": "double", "mixed": "string"}
    assert [tuple(r) for r in got.df.orderBy("_row_id").collect()] == [(0, 1, 1.5, "a"), (1, 2, None, "3.0"), (2, 3, 2.0, "True")]
    with pytest.raises(loader.LoadError):
        loader.load(spark, write(tmp_path / "no.xlsx", b"not a workbook"))


SAID = {
    "windows-1251": "Сегодня хорошая погода, и мы идём гулять в парк", "koi8-r": "Это простой русский текст для проверки", "cp866": "Привет, мир! Завтра будет дождь", "iso-8859-5": "Мы читаем книги каждый вечер",
    "windows-1253": "Καλημέρα κόσμε, αυτό είναι ένα απλό κείμενο", "windows-1250": "Zażółć gęślą jaźń, proszę przyjść jutro", "iso-8859-2": "Příliš žluťoučký kůň úpěl ďábelské ódy", "cp852": "Proszę się śpieszyć, już późno",
    "windows-1254": "Bugün hava çok güzel, dışarı çıkıp yürüyüş yapalım", "windows-1256": "مرحبا بالعالم هذا نص بسيط للاختبار", "windows-1255": "שלום עולם וברוכים הבאים", "cp850": "Übermäßig größere Straßen für die Bürger", "mac-roman": "élève très appliqué, déjà reçu à l'école",
    "shift_jis": "これは簡単な日本語の文章です。今日は天気がいいですね", "euc-kr": "안녕하세요 오늘은 날씨가 좋습니다", "gb18030": "今天天气很好我们去公园散步吧", "utf-16-le": "größer als Łódź", "utf-16-be": "größer als Łódź",
}


@pytest.mark.parametrize("encoding", SAID)
def test_encodings_are_told_from_bytes(spark, tmp_path, encoding):
    from qualiframe.sources import encodings

    data = f"id,said\n1,{SAID[encoding]}\n".encode(encoding)
    found, confidence = encodings.detect(spark, write(tmp_path / "x.csv", data))[""]
    assert data.decode(found) == data.decode(encoding) and confidence >= encodings.UNSURE


def test_a_page_that_lacks_a_byte_is_refused():
    from qualiframe.sources import encodings

    assert encodings.page_cost({(32, 0x81): 1}, "windows-1252") == float("inf")
    assert encodings.judge({}, {}, {}) == ("utf-8", 1.0)


def test_storage_types_of_a_wide_table(spark):
    """What cells rule out is or-ed by column: 500 columns are typed by one compiled stage, and empty ones stay text."""
    kinds = {
        "bigint": [" 12 ", None, "-9223372036854775808"],
        "double": ["1", "2.0", None],
        "boolean": ["True", "false", None],
        "string": ["True", "1", None],
    }
    wide = [*kinds] * 125
    df = spark.createDataFrame([[kinds[k][r] for k in wide] for r in range(3)], ", ".join(f"c{i} string" for i in range(500)))
    assert loader.storage_types(df) == {f"c{i}": k for i, k in enumerate(wide) if k != "string"}
    typed = loader.infer_storage(df)
    assert [t for _, t in typed.dtypes] == wide
    assert typed.select("c0", "c1", "c2", "c3").collect()[0] == (12, 1.0, True, "True")
    edges = spark.createDataFrame([("9223372036854775808", "1e400", "inf", "", None)], "big string, huge string, inf string, blank string, none string")
    assert loader.storage_types(edges) == {"big": "double", "huge": "double", "inf": "double"}
    assert loader.storage_types(edges.limit(0)) == {} and loader.infer_storage(edges.select()).columns == []


def test_words_of_several_languages_do_not_make_a_rarer_page():
    """Judged by one language alone, these words look like Polish in cp852."""
    for encoding in ("cp850", "mac-roman"):
        pairs: dict[tuple[int, int], int] = {}
        for word, n in (("forêt", 50), ("León", 50), ("año", 15), ("été", 5)):
            said = f" {word} ".encode(encoding)
            for pair in zip(said, said[1:]):
                pairs[pair] = pairs.get(pair, 0) + n
        assert encodings.judge(pairs, dict.fromkeys(encodings.WIDE, 1), dict.fromkeys(encodings.WIDE, 0.0))[0] == encoding


def test_lines_of_no_or_one_letter_are_utf_16_not_32(spark, tmp_path):
    for name, text in (("empty", "\n" * 40), ("short", "a\n" * 40)):
        for encoding in ("utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"):
            assert encodings.detect(spark, write(tmp_path / f"{name}-{encoding}.csv", text.encode(encoding)))[""][0] == encoding
