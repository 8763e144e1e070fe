import re
import uuid

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X


def apply(spark, expression, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.o for r in df.select("i", expression(F.col("t")).alias("o")).orderBy("i").collect()]


def test_chapter_numbers(spark):
    golden = {
        "第137 章 夜": 137, "1、歸零": 1, "第01章：起": 1, "第一百零五章": 105, "第十章": 10, "第二十三章 x": 23, "Chapter 7: x": 7, "第１２章": 12, "第三回": 3,
        "第二卷總結": None, "楔子": None, "第两千三章": 2003, "第一万零三百二十章": 10320, "第三萬章": 30000, "第十二万章": 120000, "第千章": 1000, " 第 9 話": 9, "chapter12": 12, "CHAPTER  8.": 8, "第x章": None, "7": None, "7：": 7, "第一万二千章": 12000, "": None, None: None, "12 x": 12, "１２．x": 12,
    }
    assert apply(spark, X.chapter_number, list(golden)) == list(golden.values())


def test_strip_and_titles(spark):
    assert apply(spark, X.strip, ["　 a b  \n", "", None]) == ["a b", "", None]
    assert apply(spark, X.norm_title, [" a　b\tc", None]) == ["abc", ""]
    assert apply(spark, X.url_key, ["http://a/b/?x=1", "http://a/b//", None]) == ["http://a/b/", "http://a/b", ""]
    assert apply(spark, X.guess_title, ["/x/my-novel_raw.txt", "http://a/some_book_12.html?x", "", "a b.viet.txt"]) == ["My Novel", "Some Book", "Truyen", "A B"]
    assert apply(spark, X.safe_name, ['a<b>:c?  d. ', "...", None]) == ["a_b__c_ d", "Truyen", "Truyen"]


def collapsed(text):
    """Words and what lies between them, walked by hand: runs of three and more equal words become the first one."""
    parts = re.split(r"(\w+)", text)
    words, between = parts[1::2], parts[::2]
    out, i = between[0], 0
    while i < len(words):
        j = i
        while j + 1 < len(words) and words[j + 1].casefold() == words[i].casefold() and between[j + 1] and not between[j + 1].strip(" \t"):
            j += 1
        keep = [i] if j - i >= 2 else range(i, j + 1)
        out += "".join(words[k] + (between[k + 1] if k != keep[-1] else "") for k in keep) + between[j + 1]
        i = j + 1
    return out


def test_collapse_repeats_by_hand(spark):
    texts = ["rất rất rất vui", "a a a b b", "Ha ha HA ha", "x\tx  x\nx", "một một hai", ""]
    assert apply(spark, X.collapse_repeats, texts) == [collapsed(t) for t in texts]


def test_long_repeats(spark):
    texts = ["ha " * 1_000_000 + "end", "x y " * 200_000, "a" * 500_000, "b b\nb b b", "ab ab. ab ab ab", "é É é"]
    assert [len(t) for t in apply(spark, X.collapse_repeats, texts)] == [len(t) for t in ["ha end", *texts[1:3], "b b\nb", "ab ab. ab", "é"]]


@pytest.mark.parametrize(("raw", "expected"), [
    ("Đi thôi” anh nói", "“Đi thôi” anh nói"), ("Đi thôi”.", "Đi thôi"), ("“Đi thôi.” anh nói", "“Đi thôi.” anh nói"), ("không có", "không có"),
    ("dòng một\ndòng hai” x", "dòng một\ndòng hai” x"), (" ” x", " ” x"), ("Đi thôi \n”\n", "Đi thôi"), ("a “ b\nc", "“a” b\nc"), ("a ’ , b” c", "a ’ , b” c"),
])
def test_stray_quote(spark, raw, expected):
    assert apply(spark, X.stray_quote, [raw]) == [expected]


def test_quotes(spark):
    assert apply(spark, X.curl_quotes, ['"a" b "c"', '"a', "x", '""']) == ["“a” b “c”", '"a', "x", "“”"]
    assert apply(spark, X.opening_quote, ["a” b", "a’ b", "“a” b", 'a" b”']) == ["“a” b", "‘a’ b", "“a” b", '“a" b”']


def test_repair(spark):
    cases = {
        "  ,xin  chào . bạn": "Xin chào. Bạn", "đi!!! đi??": "Đi! Đi?", "a....b": "A...b", "một,hai": "Một, hai", "được rồi,": "Được rồi.", "hết:": "Hết.",
        "thật sao.,? ừ": "Thật sao? Ừ", "ơ...? à": "Ơ..? À", "a;,b ,;": "A;b, .", "một..... hai": "Một... Hai", '“ Ừ”anh': "“Ừ” anh",
        "nói , “ ừ ”": "Nói, “ừ”".replace("ừ", "Ừ"), "đi.\nvề": "Đi.\nVề", "5,6 (a,b)": "5,6 (a, b)", "a.,.b": "A..b", "‘ừ’ nói": "‘Ừ’ nói",
        "“ chào ” anh nói": "“Chào” anh nói", "nói:“đi”rồi": "Nói: “Đi” rồi", "xong.Ân về": "Xong. Ân về", "rất rất rất vui": "Rất vui", "": "", "a ,b": "A, b", "x..y": "X.y",
    }
    assert apply(spark, X.repair, list(cases)) == list(cases.values())
    assert apply(spark, X.repair_lines, ["=== a  b ===\n\n xin  chào"]) == ["=== a  b ===\n\nXin chào"]


def test_repair_between_marks(spark):
    """Blanks, capitals and quotes around marks, and runs of words with and without characters of odd case."""
    cases = {
        "a.  b c!d": "A. B c!d", "“  ": "“", "a “  b c ” d.  “e": "A “B c” d. “E", "a . : “x": "“A. :” x", "x: “y”z": "X: “Y” z",
        "Σ σ σ x": "Σ x", "an An aN an b": "An b", "ı i ı i": "I i ı i", "a\u00a0.\u00a0b": "A.\u00a0B", "b b, b b": "B b, b b",
    }
    assert apply(spark, X.repair, list(cases)) == list(cases.values())


def test_phrases_before_characters(spark):
    pairs, phrases = {"發": "发", "髮": "发", "乾": "干"}, {"乾坤": "乾坤", "乾隆": "乾隆", "頭髮": "头发"}
    assert apply(spark, lambda c: X.to_simplified(c, pairs, phrases), ["乾坤乾杯，頭髮發", "", None]) == ["乾坤干杯，头发发", "", None]


def test_titles_of_chapters(spark):
    df = spark.createDataFrame([("Chương 3: Về nhà.", 3), ("Chapter 4", 4), ("第五章", 5), ("lời tựa", None)], "t string, n long")
    assert [r.o for r in df.select(X.chapter_title(F.col("t"), F.col("n")).alias("o")).collect()] == ["Chương 3: Về nhà", "Chương 4", "Chương 5", "lời tựa"]


def test_lines_of_sites(spark):
    assert apply(spark, X.is_ad, ["loadAdv(1, 2);", "(本章完)", "go to BGQ99.cc now", "text", "( )"]) == [True, True, True, False, True]
    assert apply(spark, X.clean_chapter_title, ["Tiêu  đề (2/5)", "a （1/2）", "b (x)"]) == ["Tiêu đề", "a", "b (x)"]
    assert apply(spark, X.is_challenge, ["<p>Just a moment...</p>", "ok", None]) == [True, False, False]


def test_identity_and_uuid(spark):
    assert apply(spark, X.source_identity, ["http://WWW.a.com/x/?q#f", "https://m.b.org"]) == ["https://a.com/x", "https://b.org"]
    names = ["https://a.com/x", "é"]
    assert apply(spark, X.uuid5_url, names) == [f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, n)}" for n in names]


def test_peak_hours(spark):
    times = ["2026-01-05 01:30:00", "2026-01-05 04:00:00", "2026-01-05 06:00:00", "2026-01-05 10:00:00", "2026-01-03 02:00:00"]
    assert apply(spark, lambda c: X.peak_hour(c.cast("timestamp")), times) == [True, False, True, False, False]


def test_status_classes(spark):
    codes = spark.createDataFrame([(c,) for c in (200, 204, 404, 403, 429, 500, 503, 408)], "c int")
    assert [r.o for r in codes.select(X.http_status_class(F.col("c")).alias("o")).collect()] == ["ok", "ok", "missing", "missing", "missing", "retry", "retry", "retry"]
    calls = spark.createDataFrame([(200, "x"), (200, " "), (402, None), (429, None), (400, "e")], "c int, b string")
    assert [r.o for r in calls.select(X.api_outcome(F.col("c"), F.col("b")).alias("o")).collect()] == ["ok", "retry", "stop", "retry", "retry"]


def test_filled_is_what_stripping_leaves(spark):
    ends = [chr(i) for i in (*range(0x3100), 0xFEFF, 0x1F600) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(t,) for c in ends for t in (c, c * 2, f" {c}\n", f"{c}x")] + [("",), (None,)], "t string")
    assert rows.where(~X.filled(F.col("t")).eqNullSafe(X.strip(F.col("t")) != "")).count() == 0
