"""Text expressions: all are Column to Column and stay inside the JVM.

Java's \\s, \\w and \\b cover ASCII unless (?U) is set, and trim() strips the space alone, so Unicode-aware patterns
are spelt out here.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Script classes for runs of a script in a text; the second is the one for CJK ideographs.
LETTERS = r"\p{L}"
CJK = r"\x{3400}-\x{9fff}\x{f900}-\x{faff}"

# Numerals of chapter titles, and the Vietnamese letters that the repair rules call lower and upper case.
CN_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "兩": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CN_UNITS = {"十": 10, "百": 100, "千": 1000}
CN_MYRIADS = ("万", "萬")
VIETNAMESE = "àáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"
LOWER = "a-z" + VIETNAMESE
UPPER = "A-Z" + VIETNAMESE.upper()
OPEN, CLOSE = "“‘\"", "”’\""


def let(value: Column, function: Callable[[Column], Column]) -> Column:
    """function(value) with the value computed once, however often the function names it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def strip(c: Column) -> Column:
    """White space of any script off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def filled(c: Column) -> Column:
    """Whether anything is left of a text once it is stripped; null of null."""
    return c.rlike(r"(?U)\S")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def norm_title(c: Column) -> Column:
    """A title without any white space; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def ascii_digits(c: Column) -> Column:
    return F.translate(c, "０１２３４５６７８９", "0123456789")


def _section(part: Column) -> Column:
    """The value of numerals below a myriad, place by place: the digit that stands before each unit, and the last one.

    A unit without a digit before it counts once.
    """
    ones = [k for k, v in CN_DIGITS.items() if v]
    digit = lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k in ones for x in (k, CN_DIGITS[k])]), c), F.lit(0))
    total = digit(F.substring(part, -1, 1))
    for unit, value in CN_UNITS.items():
        before = F.substring(F.substring_index(part, unit, 1), -1, 1)
        total = total + F.when(part.contains(unit), F.greatest(digit(before), F.lit(1)) * value).otherwise(0)
    return total.cast("long")


def chinese_number(c: Column) -> Column:
    """The value of a number in digits of either width or Chinese numerals; null where other characters occur."""
    plain = ascii_digits(c)
    myriad = CN_MYRIADS[0]
    parts = F.split(F.translate(c, "".join(CN_MYRIADS), myriad * len(CN_MYRIADS)), myriad, -1)
    values = F.transform(parts, _section)
    above = F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + v) - F.element_at(values, -1)
    known = "".join([*CN_DIGITS, *CN_UNITS, *CN_MYRIADS])
    numerals = (F.translate(c, known, "") == "") & (c != "")
    return F.when(plain.rlike("^[0-9]+$"), plain.try_cast("long")).when(numerals, above * 10000 + F.element_at(values, -1))


#: What counts chapters after 第N, and the marks that end a bare number.
COUNTERS, ENDS = "章回節节話话", "、.．:："


def chapter_number(title: Column) -> Column:
    """The number at the head of a chapter title, or null: 第12章, Chapter 12, or 12 followed by a mark or a space."""
    t = F.regexp_replace(title, r"(?U)^\s+", "")
    counted = F.translate(F.substring(t, 2, 1 << 30), COUNTERS, COUNTERS[0] * len(COUNTERS))
    numeral = F.when(counted.contains(COUNTERS[0]), chinese_number(strip(F.substring_index(counted, COUNTERS[0], 1))))
    english = F.regexp_extract(strip(F.substring(t, 8, 1 << 30)), "^[0-9]*", 0).try_cast("long")
    ended = F.split(F.translate(F.regexp_replace(t, r"(?U)\s", " "), ENDS, " " * len(ENDS)), " ", 2)
    bare = F.when(F.size(ended) > 1, ascii_digits(ended[0]))
    other = F.when(F.lower(F.substring(t, 1, 7)) == "chapter", english).when(bare.rlike("^[0-9]+$"), bare.try_cast("long"))
    return F.when(F.substring(t, 1, 1) == "第", numeral).otherwise(other)


def url_key(url: Column) -> Column:
    """A URL without trailing slashes, then without its query."""
    return F.substring_index(F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", ""), "?", 1)


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def base_domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^(www|m)\.", "")


def source_identity(url: Column) -> Column:
    """https, the host without www. or m., and the path; no query, fragment or trailing slash. Null without a host."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    return F.concat(F.lit("https://"), base_domain(url), path)


def guess_title(path: Column) -> Column:
    """A title from a file name or URL: the last part without endings, its words capitalised; Truyen if none is left."""
    slug = F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"/+$", "")
    slug = F.element_at(F.split(slug, r"[/\\]"), -1)
    for ending in (r"(?i)(_\d+)?\.html?$", r"(?i)\.viet\.txt$", r"(?i)\.txt$", r"(?i)_raw$"):
        slug = F.regexp_replace(slug, ending, "")
    words = F.filter(F.split(slug, r"(?U)[-_\s]+"), lambda w: w != "")
    title = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("Truyen"))


def safe_name(c: Column, default: str = "Truyen") -> Column:
    """A file name: forbidden characters as underscores, white space squeezed, no dots or spaces at the ends."""
    name = squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "_"))
    return F.coalesce(F.nullif(F.regexp_replace(name, r"^[. ]+|[. ]+$", ""), F.lit("")), F.lit(default))


# Promotional tails and advertisement lines of the sites.
PROMO_TAIL = r"(?i)(?:(?:请记住本书首发域名|顶点小说网手机版更新最快网址).*$|(?:\(本章完\)|（本章完）)\s*$)"
AD_LINES = ["(本章完)", "（本章完）", "()", "（）"]
AD_CALL = "loadadv("
AD_PARTS = ["bgq99.cc", "请记住本书首发域名", "请粘贴以下网址分享给你的qq"]
CHALLENGE_MARKS = ["/__gatekeeper_challenge/", "challenge_required", "browser verification required", "cf-turnstile", "checking your browser", "just a moment..."]


def clean_text(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), PROMO_TAIL, ""))


def clean_chapter_title(c: Column) -> Column:
    """Clean text without a trailing page count such as (2/5)."""
    t = clean_text(c)
    plain = F.translate(t, "（）", "()")
    last = F.substring_index(plain, "(", -1)
    counted = plain.contains("(") & F.translate(last, " ", "").rlike(r"(?U)^\d+/\d+\)$")
    return F.when(counted, strip(F.left(t, F.length(t) - F.length(last) - 1))).otherwise(t)


def is_ad(line: Column) -> Column:
    def marked(compact: Column) -> Column:
        out = compact.isin(*AD_LINES)
        for part in AD_PARTS:
            out = out | compact.contains(part)
        call = F.regexp_replace(compact, ";$", "")
        return F.when(compact.startswith(AD_CALL), F.instr(call, ")") == F.length(call)).otherwise(False) | out

    return let(F.lower(F.regexp_replace(line, r"(?U)\s+", "")), marked)


def is_challenge(html: Column, marks: list[str] | None = None) -> Column:
    low, out = F.lower(F.coalesce(html, F.lit(""))), F.lit(False)
    for mark in marks or CHALLENGE_MARKS:
        out = out | low.contains(mark)
    return out


def http_status_class(code: Column) -> Column:
    """ok, missing (does not come back) or retry, by HTTP status."""
    return F.when(code.between(200, 299), "ok").when((code >= 500) | code.isin(408, 409, 425), "retry").otherwise("missing")


def api_outcome(code: Column, body: Column) -> Column:
    """ok, retry or stop of one call of the model API: no credit stops all, an empty body and other errors are retried."""
    return F.when(code == 402, "stop").when((code == 200) & (filled(F.coalesce(body, F.lit("")))), "ok").otherwise("retry")


def has_script(c: Column, script: str = CJK) -> Column:
    return c.rlike(f"[{script}]")


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a part, 0 of an empty one."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")).otherwise(F.lit(0).cast("long"))


def snippet(text: Column, at: Column, size: Column, margin: int) -> Column:
    """Up to `margin` characters on both sides of a 1-based place, line breaks as spaces, ends stripped."""
    start = F.greatest(F.lit(1), at - margin)
    return strip(F.replace(F.substring(text, start, at + size + margin - start), F.lit("\n"), F.lit(" ")))


#: Characters that share an upper case with another one of a different lower case, or whose lower case depends on others; all Greek among them.
ODD_CASE = r"\x{b5}\x{130}\x{131}\x{17f}\x{345}\x{370}-\x{3ff}\x{13a0}-\x{13ff}\x{1c80}-\x{1c8f}\x{1e9b}\x{1e9e}\x{1f00}-\x{1fff}\x{2126}\x{212a}\x{212b}\x{ab30}-\x{abbf}\x{10000}-\x{10ffff}"


def collapse_repeats(c: Column) -> Column:
    """A word that follows itself twice or more, in any case, stays once.

    A pattern finds the runs of texts in which two characters are one in any case exactly if their lower case is the
    same. Others, with characters of ODD_CASE, are cut into words and what lies between them. A word repeats if only
    blanks part it from an equal one, and it goes, with those blanks, if the word before it or the one after it repeats
    too; so each is decided between its neighbours, however long the run.
    """

    def decided(a: Column) -> Column:
        repeats = lambda i: F.coalesce((F.translate(F.get(a, i - 1), " \t", "") == "") & (F.lower(F.get(a, i)) == F.lower(F.get(a, i - 2))) & F.get(a, i).rlike(r"(?U)^\w"), F.lit(False))
        gone = lambda i: repeats(i) & (repeats(i - 2) | repeats(i + 2))
        return F.array_join(F.transform(a, lambda x, i: F.when(gone(i) | gone(i + 1), "").otherwise(x)), "")

    slow = let(F.regexp_extract_all(c, F.lit(r"(?U)\w++|\W++"), F.lit(0)), decided)
    return F.when(c.rlike(f"[{ODD_CASE}]"), slow).otherwise(F.regexp_replace(c, r"(?iuU)(?<!\w)(\w++)(?:[ \t]++\1(?!\w)){2,}+", "$1"))


def curl_quotes(c: Column) -> Column:
    """An even number of straight quotes becomes pairs of opening and closing ones."""
    parts = F.split(c, '"', -1)
    curled = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.when(i % 2 == 1, "“").otherwise("”"), p))), "")
    return F.when((F.size(parts) > 1) & (F.size(parts) % 2 == 1), curled).otherwise(c)


def opening_quote(c: Column) -> Column:
    """If the first curly quote closes, its opening partner is put in front."""
    first = F.regexp_extract(c, "[“‘”’]", 0)
    return F.when(first == "”", F.concat(F.lit("“"), c)).when(first == "’", F.concat(F.lit("‘"), c)).otherwise(c)


def stray_quote(c: Column) -> Column:
    """A text with a single quote mark: what stands before it is quoted, or the mark goes if only marks follow.

    The text before the mark must be one line.
    """
    marks = "".join(dict.fromkeys(OPEN + CLOSE))
    alike = F.translate(c, marks, marks[0] * len(marks))
    at = F.instr(alike, marks[0])
    # Quotes that are alike are counted and placed; the text is cut at the only one.
    before, tail = F.regexp_replace(F.left(c, at - 1), r"(?U)\s++$", ""), strip(F.substring(c, at + 1, F.length(c)))
    fits = (F.length(c) - F.length(F.replace(alike, F.lit(marks[0]), F.lit(""))) == 1) & (strip(before) != "") & ~before.contains("\n")
    bare = F.translate(tail, " \t.,;:!?", "") == ""
    return F.when(~fits, c).when(bare, strip(before)).otherwise(F.concat(F.lit("“"), strip(before), F.lit("” "), tail))


#: A mark that another one next to it absorbs, as (absorbed, before or after, by which).
ABSORBED = [(",", "after", ".;"), (",", "before", ".!?"), (".", "before", "!?")]


def _settled_marks(c: Column) -> Column:
    """Runs of marks reduced: no blanks before them, equal ones once, dots one or three, weaker ones absorbed."""
    t = F.regexp_replace(c, r"(?U)\s+(?=[,;.!?])", "")
    t = F.regexp_replace(t, r"([,!?])\1+", "$1")
    t = F.replace(F.replace(F.regexp_replace(t, r"\.{3,}", "\ue001"), F.lit(".."), F.lit(".")), F.lit("\ue001"), F.lit("..."))
    around = [f"(?<=[{by}]){mark}+" if side == "after" else f"{re.escape(mark)}(?=,*[{by}])" for mark, side, by in ABSORBED]
    return F.regexp_replace(t, "|".join(around), "")


#: What (?U)\s takes for white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def _among(c: Column, characters: str) -> Column:
    """Whether a character is one of these; null if it is null."""
    return c.isin(*characters)


def _token(x: Column, one: Column, following: Column) -> Column:
    """What becomes of a token, a mark, a quote or all that stands between two of them, between its neighbours.

    one is the token before it, null at the start; following is null at the end. No blanks are at the ends of the text.
    """
    head, ahead, behind = F.left(x, F.lit(1)), F.left(following, F.lit(1)), F.right(one, F.lit(1))
    after_comma = _among(ahead, BLANKS + "\"')]0123456789" + CLOSE)
    mark = (
        F.when(x.isin(",", ";", ":") & following.isNull(), ".")
        .when((x == ",") & ~after_comma, ", ")
        .when(x.isin(".", "!", "?") & ahead.rlike(f"^[{UPPER}]"), F.concat(x, F.lit(" ")))
        .when((x == "“") & behind.rlike(r"(?U)[\w:]$"), " “")
        .when((x == "”") & ahead.rlike(r"(?U)^\w"), "” ")
        .otherwise(x)
    )
    opened, closed, led = F.coalesce(_among(one, OPEN), F.lit(False)), F.coalesce(_among(following, CLOSE), F.lit(False)), _among(head, BLANKS)
    begun = F.when(opened & led, F.regexp_replace(x, r"(?U)^\s+", "")).otherwise(x)
    kept = F.when(closed & _among(F.right(x, F.lit(1)), BLANKS), F.regexp_replace(begun, r"(?U)\s+$", "")).otherwise(begun)
    word = F.regexp_extract(kept, r"(?U)^\s*", 0)
    capital = F.concat(word, F.upper(F.substring(kept, F.length(word) + 1, F.lit(1))), F.substring(kept, F.length(word) + 2, F.lit(1 << 30)))
    headed = one.isNull() | ((opened | (led & one.isin(".", "!", "?"))) & kept.rlike(rf"(?U)^\s*[{LOWER}]"))
    return F.when(_among(x, ",;:.!?" + "".join(dict.fromkeys(OPEN + CLOSE))), mark).otherwise(F.when(headed, capital).otherwise(kept))


def repair(c: Column) -> Column:
    """The repair of a translated paragraph: spaces, repeats, quotes, marks and capitals.

    Quotes and runs of marks are settled on the whole paragraph; it is then cut into tokens once, and each token is
    decided between its neighbours.
    """
    t = F.regexp_replace(collapse_repeats(F.regexp_replace(c, r"[ \t]+", " ")), r"(?U)^[\s,;.\-!?]+", "")
    for step in (curl_quotes, opening_quote, stray_quote):
        t = let(t, step)
    t = strip(_settled_marks(t))
    marks = f",;:.!?{OPEN}{CLOSE}"
    tokens = F.regexp_extract_all(t, F.lit(rf"[{marks}]|[^{marks}]+"), F.lit(0))
    return strip(let(tokens, lambda a: F.array_join(F.transform(a, lambda x, i: _token(x, F.get(a, i - 1), F.get(a, i + 1))), "")))


def repair_lines(c: Column) -> Column:
    """repair() of each line but blank ones and === headers ===."""
    return F.array_join(F.transform(F.split(c, "\n", -1), lambda line: F.when(line.startswith("===") | (strip(line) == ""), line).otherwise(repair(line))), "\n")


def repair_title(c: Column) -> Column:
    """A title with white space squeezed, no marks at its head and none of its last run of marks."""
    return strip(F.rtrim(F.ltrim(squeeze(c), F.lit(" ,;.-!?")), F.lit(",;.-!?")))


def chapter_title(title: Column, label: Column) -> Column:
    """"Chương N: subtitle" from a translated title and a number; without a number the subtitle or the title."""
    plain = repair_title(title)
    subtitle = strip(F.regexp_replace(plain, r"(?iU)^(?:chương|chapter)\s*\d+\s*[:.\-]?\s*", ""))
    usable = (subtitle != "") & ~has_script(subtitle)
    return F.when(label.isNull(), F.when(subtitle != "", subtitle).otherwise(plain)).when(usable, F.concat(F.lit("Chương "), label.cast("string"), F.lit(": "), subtitle)).otherwise(F.concat(F.lit("Chương "), label.cast("string")))


def capital_words(c: Column) -> Column:
    """Words that begin with an upper-case letter."""
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w.rlike(r"^\p{Lu}")))


def chapter_text(title: Column, paragraphs: Column) -> Column:
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), F.array_join(paragraphs, "\n"))


def content_hash(title: Column, paragraphs: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256 over title and paragraphs as JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(paragraphs.alias("paragraphs"), title.alias("title"))), 256), 1, 16)


def uuid5_url(name: Column) -> Column:
    """urn:uuid of version 5 in the URL name space."""
    space = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    digest = F.sha1(F.concat(space, name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.lit("urn:uuid:"), F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def to_simplified(c: Column, pairs: dict[str, str], phrases: dict[str, str] | None = None) -> Column:
    """Phrases replaced by their own map, leftmost and longest first, and all other characters by theirs."""
    single = lambda x: F.translate(x, "".join(pairs), "".join(pairs.values()))
    if not phrases:
        return single(c)
    pattern = F.lit("|".join(re.escape(p) for p in sorted(phrases, key=lambda p: (-len(p), p))))
    table = F.create_map(*[F.lit(x) for pair in phrases.items() for x in pair])
    return F.array_join(F.zip_with(F.transform(F.split(c, pattern, -1), single), F.transform(F.regexp_extract_all(c, pattern, F.lit(0)), lambda p: table[p]), lambda between, put: F.concat(between, F.coalesce(put, F.lit("")))), "")


def peak_hour(ts: Column) -> Column:
    """Whether a UTC time is a Beijing working hour, 9 to 12 or 14 to 18, Monday to Friday; holidays are joined apart."""
    local = F.from_utc_timestamp(ts, "Asia/Shanghai")
    hour = F.hour(local)
    return (F.weekday(local) < 5) & (((hour >= 9) & (hour < 12)) | ((hour >= 14) & (hour < 18)))
