"""Driver queries of the library's readers, filters, joins and column functions, with DuckDB SQL that gives the same rows.

Where a table of the driver has no column of the wanted form (chapter titles with numbers, dictionary lines, replies of
a model), the query writes one from whole columns and the operator reads it; the SQL takes the short way from the same
columns to the same result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.tables import numbered, shared_folder
from quillspark.operators import chapters as C
from quillspark.operators import crawl, heal, mining, profile, terms, usage, validation
from quillspark.operators import state as S
from quillspark.operators import novel_run as N
from quillspark.plans.queries import CONTAINED, contained, query, table, turn_pairs
from quillspark.sources import dictionaries as D
from quillspark.sources import pages as P
from quillspark.sources import responses

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def stripped(column: str) -> str:
    return STRIP.format(column)


def md5(c):
    return F.md5(c.cast("binary"))


# Chapter files
TURN_LINES = f"""
WITH f AS (SELECT conv_id, turn, {stripped("unnest(string_split(text, chr(10)))")} AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations),
p AS (SELECT conv_id, turn, list(line ORDER BY i) FILTER (line <> '' AND line <> repeat('=', 40) AND NOT regexp_matches(line, '^===.*===$')) AS lines FROM f GROUP BY ALL),
c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, 'turn ' || turn AS title, coalesce(lines, []) AS lines FROM p)
"""


def conversation_files(spark, sf_dir):
    """A chapter file for each conversation: a line that belongs to no chapter, then a chapter for each turn."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    entry = F.concat(F.lit("  === turn "), F.col("turn"), F.lit(" ===\n\n"), F.col("text"), F.lit(f"\n\n{C.RULE}\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", entry.alias("entry")))), lambda x: x["entry"])
    return turns.groupBy(F.col("conv_id").alias("novel_id")).agg(F.concat(F.lit("no chapter\n"), F.array_join(parts, "")).alias("value"))


@query(TURN_LINES + "SELECT conv_id, pos, title, len(lines) AS n_paragraphs, md5(array_to_string(lines, chr(10))) AS body_md5, pos = 0 AND len(lines) = 0 AS is_title_entry FROM c")
def chapter_parse(spark, sf_dir):
    found = C.parse_chapters(conversation_files(spark, sf_dir))
    return found.select(F.col("novel_id").alias("conv_id"), F.col("pos").cast("long").alias("pos"), "title", F.size("paragraphs").cast("long").alias("n_paragraphs"), md5(F.array_join("paragraphs", "\n")).alias("body_md5"), "is_title_entry")


@query("SELECT conv_id, count(*) AS completed FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def chapters_completed(spark, sf_dir):
    return conversation_files(spark, sf_dir).select(F.col("novel_id").alias("conv_id"), C.completed(F.col("value")).alias("completed"))


NUMBERED = """(SELECT doc_id, source, CASE WHEN doc_id % 5 = 4 THEN NULL WHEN source LIKE '%1' THEN NULL ELSE doc_id % 1000 END AS number FROM documents)"""


def numbered_titles(spark, sf_dir):
    """documents with titles that have numbers in four forms, or none."""
    n = F.col("doc_id") % 1000
    digit = lambda place: F.element_at(F.split(F.lit("零 一 二 三 四 五 六 七 八 九"), " "), (F.floor(n / place) % 10 + 1).cast("int"))
    han = F.concat(
        F.when(n >= 100, F.concat(digit(100), F.lit("百"))).otherwise(""), F.when(F.floor(n / 10) % 10 > 0, F.concat(digit(10), F.lit("十"))).when(n >= 100, "零").otherwise(""),
        F.when((n % 10 > 0) | (n == 0), digit(1)).otherwise(""),
    )
    wide = F.translate(n.cast("string"), "0123456789", "０１２３４５６７８９")
    title = (
        F.when((F.col("doc_id") % 5 == 4) | F.col("source").endswith("1"), F.concat(F.lit("no number "), F.col("lang")))
        .when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" 第 "), n, F.lit("章 x"))).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("第"), han, F.lit("回")))
        .when(F.col("doc_id") % 5 == 2, F.concat(F.lit("Chapter "), n, F.lit(": x"))).otherwise(F.concat(wide, F.lit("、x")))
    )
    return table(spark, sf_dir, "documents").select("doc_id", "source", title.alias("title"))


@query(f"SELECT doc_id, number FROM {NUMBERED}")
def chapter_numbers(spark, sf_dir):
    return numbered_titles(spark, sf_dir).select("doc_id", X.chapter_number(F.col("title")).alias("number"))


@query(f"SELECT doc_id, source, CASE WHEN count(number) OVER (PARTITION BY source) * 2 >= count(*) OVER (PARTITION BY source) THEN number ELSE row_number() OVER (PARTITION BY source ORDER BY doc_id) END AS label FROM {NUMBERED}")
def chapter_labels(spark, sf_dir):
    rows = numbered_titles(spark, sf_dir).select("doc_id", F.col("source").alias("novel_id"), F.col("doc_id").alias("pos"), "title")
    return C.labels(rows).select("doc_id", F.col("novel_id").alias("source"), "label")


@query(f"SELECT doc_id, coalesce(last_value(number IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id), 0) AS carried FROM {NUMBERED}")
def carried_numbers(spark, sf_dir):
    rows = numbered_titles(spark, sf_dir)
    return C.carried_number(rows, ["source"], "doc_id", X.chapter_number(F.col("title"))).select("doc_id", "carried")


@query(f"SELECT doc_id, coalesce(number > 480 AND number <= 500, false) AS saved FROM {NUMBERED}")
def resume_overlap(spark, sf_dir):
    return numbered_titles(spark, sf_dir).select("doc_id", crawl.already_saved(F.col("title"), F.lit("第五百章")).alias("saved"))


@query(f"SELECT source, w AS wanted, CASE WHEN count(number) = 0 THEN w - 1 ELSE coalesce(min(ord) FILTER (number >= w), count(*)) END AS next_index FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ord FROM {NUMBERED}), (SELECT unnest([3, 500, 5000])::BIGINT AS w) GROUP BY source, w")
def catalogue_from_number(spark, sf_dir):
    rows = numbered_titles(spark, sf_dir).select(F.col("source").alias("book_id"), "title", "doc_id")
    rows = numbered(rows, ["book_id"], ["doc_id"]).select("book_id", "title", (F.col("number") - 1).alias("ord"))
    wanted = rows.select("book_id").distinct().withColumn("wanted", F.explode(F.array(*[F.lit(n).cast("long") for n in (3, 500, 5000)])))
    return crawl.from_number(rows, wanted).select(F.col("book_id").alias("source"), "wanted", "next_index")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Chương ' || p_size || CASE WHEN p_size % 3 = 0 THEN '' ELSE ': ' || p_name END ELSE p_name END AS title FROM part")
def chapter_titles(spark, sf_dir):
    head = F.concat(F.when(F.col("p_size") % 4 == 0, " .chương ").otherwise("Chapter  "), F.col("p_size"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit(" - "), F.col("p_name"))), F.lit(" ,.!"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, head).otherwise(F.concat(F.lit("..  "), F.col("p_name"))).alias("raw"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("n"))
    return rows.select("p_partkey", X.chapter_title(F.col("raw"), F.col("n")).alias("title"))


# Text functions
@query(f"SELECT doc_id, md5({stripped(r"regexp_replace(text, '\s+', ' ', 'g')")}) AS clean_md5, regexp_matches(text, '[\\x{{3400}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}]') AS cjk, md5(regexp_replace(text, '\\s+', '', 'g')) AS bare_md5 FROM documents")
def clean_texts(spark, sf_dir):
    text = F.col("text")
    tail = F.when(F.col("doc_id") % 3 == 0, "（本章完）").when(F.col("doc_id") % 3 == 1, "  (本章完) ").otherwise("")
    noted = F.concat(text, F.when(F.col("doc_id") % 2 == 0, " (2/5)").otherwise("（1 / 3） "), tail)
    return table(spark, sf_dir, "documents").select("doc_id", md5(X.clean_chapter_title(noted)).alias("clean_md5"), X.has_script(text).alias("cjk"), md5(X.norm_title(text)).alias("bare_md5"))


@query(f"""WITH q AS (SELECT doc_id, text, len(regexp_extract_all(text, '[“‘”’"]')) AS n, {stripped(r"""regexp_extract(text, '(?s)^(.*\S)\s*["]\s*([^"]*)$', 1)""")} AS head, {stripped(r"""regexp_extract(text, '(?s)^(.*\S)\s*["]\s*([^"]*)$', 2)""")} AS tail FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents))
SELECT doc_id, md5(CASE WHEN n <> 1 OR head = '' THEN text WHEN regexp_matches(tail, '^[ .,;:!?]*$') THEN head ELSE '“' || head || '” ' || tail END) AS quoted_md5 FROM q""")
def stray_quotes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", md5(X.stray_quote(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("quoted_md5"))


@query("SELECT doc_id, md5(lang || chr(10) || text) AS joined_md5, left(sha256(to_json({'paragraphs': string_split(text, chr(10)), 'title': lang})::VARCHAR), 16) AS hash FROM documents")
def content_hashes(spark, sf_dir):
    parts = F.split("text", "\n", -1)
    return table(spark, sf_dir, "documents").select("doc_id", md5(X.chapter_text(F.col("lang"), parts)).alias("joined_md5"), X.content_hash(F.col("lang"), parts).alias("hash"))


@query("SELECT page_id, string_split(rtrim(url, '/'), '?')[1] AS key, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^(www|m)\\.', '') AS domain, 'urn:uuid:' || h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || printf('%x', ('0x' || h[17])::INT & 3 | 8) || h[18:20] || '-' || h[21:32] AS book FROM (SELECT page_id, url, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)".replace("\\\\", "\\"))
def page_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.url_key(F.col("url")).alias("key"), X.base_domain(F.col("url")).alias("domain"), X.uuid5_url(F.col("url")).alias("book"))


@query("""WITH s AS (SELECT page_id, regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '[^/]*$'), '(_[0-9]+)?[.]html?$', '') AS slug FROM pages),
w AS (SELECT page_id, list_filter(string_split_regex(slug, '[-_\\s]+'), lambda x: x <> '') AS words FROM s)
SELECT page_id, coalesce(nullif(array_to_string(list_transform(words, lambda x: upper(x[1]) || lower(x[2:])), ' '), ''), 'Truyen') AS title FROM w""".replace("\\\\", "\\"))
def guessed_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.guess_title(F.col("url")).alias("title"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url || '  a', '[<>:\"/\\|?*\x00-\x1f]', '_', 'g'), '\s+', ' ', 'g'), '^[. ]+', ''), '[. ]+$', '') AS name FROM pages")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.safe_name(F.concat(F.col("url"), F.lit("  a ."))).alias("name"))


@query("SELECT event_id, CASE WHEN code = 200 OR code = 204 THEN 'ok' WHEN code >= 500 OR code IN (408, 409, 425) THEN 'retry' ELSE 'missing' END AS http, CASE WHEN code = 402 THEN 'stop' WHEN code = 200 THEN 'ok' ELSE 'retry' END AS api FROM (SELECT event_id, [200, 204, 402, 403, 404, 408, 409, 425, 429, 500, 503][event_id % 11 + 1] AS code FROM events)")
def status_classes(spark, sf_dir):
    codes = F.element_at(F.array(*[F.lit(c) for c in (200, 204, 402, 403, 404, 408, 409, 425, 429, 500, 503)]), (F.col("event_id") % 11 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", X.http_status_class(codes).alias("http"), X.api_outcome(codes, F.col("props")).alias("api"))


@query("SELECT doc_id, md5(term) AS term_md5, regexp_replace(replace(substring(text, greatest(1, p - 18), p + length(term) + 18 - greatest(1, p - 18)), chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS snippet FROM (SELECT doc_id, text, term, instr(text, term) AS p FROM documents d JOIN (SELECT DISTINCT text AS term FROM benchmark WHERE length(text) > 0) b ON contains(d.text, b.term))".replace("\\\\", "\\"))
def passage_snippets(spark, sf_dir):
    met = contained(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return met.select("doc_id", md5(F.col("term")).alias("term_md5"), X.snippet(F.col("text"), F.col("first_pos"), F.length("term"), 18).alias("snippet"))


# Terms
TERMS = "(SELECT p_partkey, string_split(p_name, ' ')[1] AS zh, p_type || ' ' || p_brand AS vi, p_name || ' ' || lower(p_type) AS chapter, p_size FROM part)"


def proposed(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.substring_index("p_name", " ", 1).alias("zh"), F.concat_ws(" ", "p_type", "p_brand").alias("vi"),
        F.when(F.col("p_size") % 3 == 0, F.lower("p_type")).otherwise(F.concat_ws(" ", "p_name", F.lower("p_type"))).alias("chapter"), "p_size",
    )


@query(f"""SELECT p_partkey, length(vi) <= 60 AND p_size % 3 <> 0 AS term, length(zh) BETWEEN 3 AND 24 AND p_size % 3 <> 0 AND p_size % 2 = 0 AS idiom,
length(vi) <= 60 AS name, p_size % 4 <> 0 AS rendering FROM {TERMS}""")
def term_admission(spark, sf_dir):
    rows, script, term = proposed(spark, sf_dir), "\\x{5e00}-\\x{5eff}", F.expr("concat(left(zh, 11), '年')")
    zh = F.concat(F.col("zh"), F.lit("年"))  # a character of the script, which no rendering has
    chapter = F.when(F.col("p_size") % 3 == 0, F.col("chapter")).otherwise(F.concat(zh, F.col("chapter")))
    gloss = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("Nghĩa đen: "), F.col("p_size"))).otherwise(F.col("p_size").cast("string"))
    output = F.when(F.col("p_size") % 2 == 0, F.upper("vi")).otherwise("")
    return rows.select(
        "p_partkey", terms.admitted_term(F.concat(F.lit(" "), term), F.col("vi"), F.when(F.col("p_size") % 3 == 0, F.col("chapter")).otherwise(F.concat(term, F.col("chapter"))), script).alias("term"),
        terms.admitted_idiom(zh, F.concat(F.lit("“"), F.col("vi"), F.lit("”")), chapter, output, script).alias("idiom"),
        terms.admitted_name(F.col("vi"), script).alias("name"), terms.admitted_rendering(gloss, script).alias("rendering"),
    )


@query("SELECT p_partkey, CASE p_size % 6 WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN '' WHEN 4 THEN '' ELSE lower(p_type) END AS meaning, p_size % 2 = 0 AS common FROM part")
def meaning_cleaning(spark, sf_dir):
    kind, plain = F.col("p_size") % 6, F.lower("p_type")
    raw = (
        F.when(kind == 0, F.concat(F.lit(" (thành ngữ) ; "), plain)).when(kind == 1, F.concat(F.lit("nghĩa đen "), plain)).when(kind == 2, F.concat(F.lit("Xem "), plain))
        .when(kind == 3, F.concat(plain, F.lit(" 年"))).when(kind == 4, F.concat(F.lit("Biến thể ["), plain)).otherwise(F.concat(plain, F.lit(" (thành ngữ),")))
    )
    case = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("12 "), plain)).otherwise(F.concat(F.lit("- "), F.initcap(plain)))
    return table(spark, sf_dir, "part").select("p_partkey", terms.clean_meaning(raw).alias("meaning"), terms.is_common(case).alias("common"))


@query("""WITH f AS (SELECT p_brand AS novel, p_partkey AS ord, p_name AS key FROM part WHERE p_size % 3 <> 0), g AS (SELECT DISTINCT p_brand AS novel, p_name AS key FROM part WHERE p_size % 3 = 0)
SELECT novel, key, min(ord) AS ord FROM f WHERE (novel, key) NOT IN (SELECT (novel, key) FROM g) GROUP BY ALL""")
def glossary_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("novel_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("key"), "p_size")
    return terms.merge_new(part.where("p_size % 3 = 0"), part.where("p_size % 3 <> 0")).select(F.col("novel_id").alias("novel"), "key", "ord")


@query("SELECT p_partkey, p_name IN (SELECT p_name FROM part WHERE p_size > 45) AS known, p_name NOT IN (SELECT p_name FROM part WHERE p_size > 45) AS forced FROM part")
def known_terms(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    out = terms.split_known(part.select("p_partkey", "p_name"), part.where("p_size > 45").select("p_name"), "p_name")
    return out.select("p_partkey", "known", (~F.col("known")).alias("forced"))


@query("""SELECT conv_id, turn, len(string_split(u, 'th')) > len(string_split(a, 'wh')) OR len(string_split(u, 'qu')) > len(string_split(a, 'zz')) AS flagged
FROM (SELECT u.conv_id, u.turn, u.text AS u, lower(a.text) AS a FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')""")
def term_usage_check(spark, sf_dir):
    """Terms whose strings share no character, so that masks of one never touch another."""
    listed = F.array(*[F.struct(F.lit(zh).alias("zh"), F.lit(vi).alias("vi")) for zh, vi in (("th", "wh"), ("qu", "zz"))])
    pairs = turn_pairs(spark, sf_dir).where("target IS NOT NULL").select("conv_id", "turn")
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("u"))
    told = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    met = pairs.join(asked, ["conv_id", "turn"]).join(told, ["conv_id", "turn"])
    return met.select("conv_id", "turn", (F.size(terms.missing_terms(F.col("u"), F.col("a"), listed)) > 0).alias("flagged"))


@query("SELECT doc_id, len(m) AS n, array_to_string(list_slice(m, 1, 50), ' ') AS spans FROM (SELECT doc_id, regexp_extract_all(text, 'them|then|the|and|an') AS m FROM documents)")
def greedy_term_spans(spark, sf_dir):
    found = terms.greedy_spans(F.col("text"), ["an", "the", "then", "and", "them"])
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(F.slice(found, 1, 50), " ").alias("spans"))


@query("SELECT doc_id, md5(replace(text, 'the', 'dəʀ')) AS restored_md5, contains(text, 'the') AS marked FROM documents")
def marked_spans(spark, sf_dir):
    marked = terms.mark_spans(F.col("text"), {"the": "dəʀ"})
    return table(spark, sf_dir, "documents").select("doc_id", md5(terms.restore_spans(marked)).alias("restored_md5"), marked.contains("​").alias("marked"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_type <> '' THEN p_type WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 5 > 0 THEN p_type ELSE '' END AS known,
CASE WHEN p_size % 4 = 0 THEN 'gợi ý: ' || p_type WHEN p_size % 3 = 0 THEN 'nghĩa: ' || p_brand ELSE '' END AS hint FROM part""")
def idiom_renderings(spark, sf_dir):
    size = F.col("p_size")
    curated = F.when(size % 3 == 0, F.col("p_brand")).otherwise("")
    used = F.when(size % 5 > 0, F.create_map("p_type", F.lit(1))).otherwise(F.create_map().cast("map<string,int>"))
    known = terms.known_rendering(size % 2 == 0, F.col("p_type"), used, curated)
    hint = terms.fresh_hint(F.when(size % 4 == 0, "chuan_bi").otherwise("dich"), F.when(size % 4 == 0, F.col("p_type")).otherwise(""), curated)
    return table(spark, sf_dir, "part").select("p_partkey", known.alias("known"), hint.alias("hint"))


@query("SELECT term_md5, chapters, first_doc FROM (SELECT md5(text) AS term_md5, (SELECT count(DISTINCT doc_id) FROM documents d WHERE contains(d.text, b.text)) AS chapters, (SELECT min(doc_id) FROM documents d WHERE contains(d.text, b.text)) AS first_doc FROM (SELECT DISTINCT text FROM benchmark WHERE length(text) > 0) b) WHERE chapters >= 1 ORDER BY chapters DESC, term_md5 LIMIT 300")
def commonest_passages(spark, sf_dir):
    found = terms.commonest(contained(spark, sf_dir), least=1, most=300)
    return found.select(md5(F.col("term")).alias("term_md5"), "chapters", "first_doc")


# Dictionaries
@query("""WITH l AS (SELECT p_partkey AS n, CASE WHEN p_size % 4 = 0 THEN 'S' || p_size ELSE 'T' || p_size || p_brand END AS word, CASE WHEN p_size % 3 = 0 THEN CASE WHEN length(p_name) > length(p_type) THEN p_name ELSE p_type END ELSE p_name END AS meaning FROM part WHERE p_size % 7 <> 0)
SELECT word, arg_max(meaning, n) AS meaning FROM l GROUP BY word""")
def dictionary_lines(spark, sf_dir):
    size = F.col("p_size")
    trad = F.when(size % 4 == 0, F.concat(F.lit("S"), size)).otherwise(F.concat(F.lit("T"), size, F.col("p_brand")))
    meanings = F.when(size % 3 == 0, F.concat(F.lit("/ab/"), F.col("p_type"), F.lit("/"), F.col("p_name"), F.lit("/"))).otherwise(F.concat(F.lit("/ "), F.col("p_name"), F.lit(" / /x/")))
    line = F.concat_ws(" ", trad, F.concat(F.lit("S"), size), F.when(size % 7 == 0, "pin yin").otherwise("[pin1 yin1]"), meanings)
    return D.cvdict_text(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), line.alias("value")))


@query("SELECT CASE WHEN p_size % 2 = 0 THEN 'T' || p_partkey ELSE 'S' || p_partkey END AS word, p_name AS meaning FROM part WHERE p_size % 5 <> 0")
def dictionary_json(spark, sf_dir):
    size = F.col("p_size")
    entry = F.struct(F.when(size % 2 == 0, F.concat(F.lit("T"), F.col("p_partkey"))).otherwise("").alias("trad"), F.when(size % 5 == 0, " ; / ").otherwise(F.concat(F.lit("; "), F.col("p_name"), F.lit(" / b; c"))).alias("definition"))
    return D.cvdict_json(table(spark, sf_dir, "part").select(F.to_json(F.create_map(F.concat(F.lit("S"), F.col("p_partkey")), entry)).alias("value")))


@query("""
WITH r AS (SELECT p_brand AS ch, lower(string_split(p_name, ' ')[1]) AS r FROM part UNION SELECT p_brand, lower(p_type) FROM part UNION SELECT p_brand, 'x' || p_size % 3 FROM part WHERE p_size % 2 = 0)
SELECT ch, array_to_string(list(r ORDER BY length(r), r), ', ') AS readings FROM r GROUP BY ch""")
def readings_union(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    literal = F.concat(F.lit("['"), F.substring_index("p_name", " ", 1), F.lit("', \""), F.col("p_type"), F.lit("\"]"))
    listed = D.readings_csv(part.select(F.col("p_brand").alias("char"), literal.alias("hanviet")))
    more = D.key_values(part.where("p_size % 2 = 0").select(F.concat(F.lit(" "), F.col("p_brand"), F.lit("= X"), F.col("p_size") % 3).alias("value"))).select(F.col("key").alias("ch"), F.col("value").alias("r"))
    return D.merged_readings([listed.select("ch", F.explode("readings").alias("r")), more]).select("ch", F.array_join("readings", ", ").alias("readings"))


@query("SELECT p_brand || p_partkey AS word, p_type AS meaning FROM part WHERE p_size % 2 = 0")
def cognate_table(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_size", F.concat(F.lit(" "), F.col("p_brand"), F.col("p_partkey")).alias("Word"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" / "), F.col("p_type"), F.lit("/b"))).otherwise("//").alias("MEANING"))
    return D.cognates_tsv(rows)


@query("SELECT p_partkey::VARCHAR AS word, p_name AS meaning FROM part WHERE p_size % 4 > 1")
def phrase_lines(spark, sf_dir):
    size = F.col("p_size") % 4
    line = F.when(size == 0, F.concat(F.lit("# "), F.col("p_partkey"), F.lit("=a"))).when(size == 1, F.col("p_name")).otherwise(F.concat(F.lit("  "), F.col("p_partkey"), F.lit(" = "), F.col("p_name"), F.lit("/b=c ")))
    return D.phrases(table(spark, sf_dir, "part").select(line.alias("value")))


@query("SELECT p_brand AS ch, r, count(*) AS n FROM (SELECT p_brand, unnest([p_type, p_size::VARCHAR]) AS r FROM part) GROUP BY ALL")
def level_readings(spark, sf_dir):
    kind = F.col("p_size") % 3
    both = F.concat_ws("; ", "p_type", "p_size")
    entry = F.struct(F.when(kind == 0, F.col("p_brand")).alias("hanzi"), F.when(kind != 0, F.col("p_brand")).alias("word"), F.when(kind == 1, both).alias("sinoViet"), F.when(kind != 1, F.replace(both, F.lit("; "), F.lit("|"))).alias("sino"))
    rows = D.hsk_json(table(spark, sf_dir, "part").select(F.to_json(F.array(entry)).alias("value")))
    return rows.groupBy("ch", "r").agg(F.count("*").alias("n"))


@query("SELECT p_name AS zh, arg_max(p_brand || ': ' || p_type, p_partkey) AS vi FROM part WHERE p_size % 3 <> 0 GROUP BY p_name")
def glossary_lines(spark, sf_dir):
    line = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.col("p_name"), F.lit(" : "), F.col("p_brand"), F.lit(": "), F.col("p_type")))
    return D.glossary_lines(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), line.alias("value")))


@query("SELECT DISTINCT unnest(CASE WHEN p_name = p_type THEN [p_name] ELSE ['s ' || p_type, p_type] END) AS key, p_type || '!' AS vi, p_type AS canonical FROM part")
def idiom_variants(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("s "), F.col("p_type")).alias("simp"), F.col("p_type").alias("trad"), F.concat(F.col("p_type"), F.lit("!")).alias("vi"))
    return D.variants(rows)


#: Parts as a dictionary: four figures of the key are four characters, of which the first two and the last two figures' are forms of one.
HAN = "一壹二貳三四五六七八"
IDIOMS = f"""d AS (SELECT p_partkey, translate(lpad((p_partkey % 10000)::VARCHAR, 4, '0'), '0123456789', '{HAN}') || CASE p_size % 11 WHEN 0 THEN '四四四四四' ELSE '' END AS word, p_size % 3 = 0 AS listed,
  CASE p_size % 5 WHEN 0 THEN '(Thành ngữ) ' || p_type WHEN 1 THEN p_type || ' (ca dao)' WHEN 2 THEN ' ab ' WHEN 3 THEN 'thành ngữ ' || p_type ELSE p_type END AS meaning FROM part),
i AS (SELECT *, length(word) = 4 AND (contains(lower(meaning), '(thành ngữ)') OR contains(meaning, '(ca dao)') OR listed AND length(trim(meaning)) >= 3) AS idiom FROM d)"""


def idiom_parts(spark, sf_dir):
    size, kind = F.col("p_size"), F.col("p_size") % 5
    word = F.translate(F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), "0123456789", HAN)
    meaning = F.when(kind == 0, F.concat(F.lit("(Thành ngữ) "), "p_type")).when(kind == 1, F.concat("p_type", F.lit(" (ca dao)"))).when(kind == 2, " ab ").when(kind == 3, F.concat(F.lit("thành ngữ "), "p_type")).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(word, F.when(size % 11 == 0, "四四四四四").otherwise("")).alias("word"), (size % 3 == 0).alias("listed"), meaning.alias("meaning"))


@query(f"WITH {IDIOMS} SELECT p_partkey, idiom FROM i")
def idiom_words(spark, sf_dir):
    return idiom_parts(spark, sf_dir).select("p_partkey", D.is_idiom(F.col("word"), F.col("meaning"), F.col("listed")).alias("idiom"))


@query(f"""WITH {IDIOMS},
g AS (SELECT word, min(p_partkey) AS n, arg_max(meaning, p_partkey) AS vi, bool_or(listed) AS listed FROM d GROUP BY word),
f AS (SELECT n, vi, word, translate(word, '壹貳', '一二') AS simp, translate(word, '一二', '壹貳') AS trad FROM g
  WHERE length(word) = 4 AND (contains(lower(vi), '(thành ngữ)') OR contains(vi, '(ca dao)') OR listed AND length(trim(vi)) >= 3)),
c AS (SELECT trad AS canonical, min(n) AS n, arg_min(vi, n) AS vi, arg_min(simp, n) AS simp FROM f GROUP BY trad),
k AS (SELECT simp AS key, canonical, n, vi FROM c UNION SELECT canonical, canonical, n, vi FROM c)
SELECT key, arg_max(vi, n) AS vi, bool_or(key = canonical) AS canonical FROM k GROUP BY key""")
def idiom_dictionary(spark, sf_dir):
    parts = idiom_parts(spark, sf_dir)
    forms = parts.select("word", F.translate("word", "壹貳", "一二").alias("simp"), F.translate("word", "一二", "壹貳").alias("trad"))
    out = D.idioms_built(parts.withColumnRenamed("p_partkey", "n"), parts.where("listed"), forms)
    named = out["canonical"].select(F.col("canonical").alias("key"), F.lit(True).alias("canonical"))
    return out["keys"].join(named, "key", "left").select("key", "vi", F.coalesce("canonical", F.lit(False)).alias("canonical"))


# Replies and usage
@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS body, max(turn) * 7 AS tokens FROM conversations WHERE text IS NOT NULL AND turn < 3 GROUP BY conv_id")
def event_stream_bodies(spark, sf_dir):
    """Each turn is a chunk; the third ends the stream, and what is no chunk or comes later is left out."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("response_id"), "turn", "text")
    chunk = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"), F.struct((F.col("turn") * 7).alias("total_tokens")).alias("usage")))
    lines = F.array(F.lit(": comment"), F.lit("data: {broken"), F.when(F.col("turn") == 3, F.lit("data: [DONE]")), F.concat(F.lit("data: "), chunk))
    rows = turns.select("response_id", "turn", F.posexplode(lines).alias("k", "line")).select("response_id", (F.col("turn") * 4 + F.col("k")).alias("pos"), "line").where("line IS NOT NULL")
    done = responses.event_streams(rows)
    return done.select(F.col("response_id").alias("conv_id"), "body", F.col("usage.total_tokens").alias("tokens"))


@query("SELECT conv_id, turn, role AS title, len(string_split(text, chr(10))) AS n_paragraphs, md5(text) AS body_md5, turn % 2 = 0 AS kept_idioms FROM conversations WHERE text IS NOT NULL")
def reply_repair(spark, sf_dir):
    """Whole replies as JSON for even turns; odd ones are cut off at the end and repaired."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    body = F.to_json(F.struct(F.col("role").alias("title"), F.split("text", "\n", -1).alias("paragraphs"), F.create_map(F.lit("k"), "role").alias("new_terms"), F.create_map(F.lit("i"), "role").alias("idioms")))
    sent = F.when(F.col("turn") % 2 == 0, body).otherwise(F.expr("substring(body, 1, length(body) - 12)"))
    rows = turns.withColumn("body", body).withColumn("r", responses.reply(sent))
    return rows.select("conv_id", "turn", F.col("r.title").alias("title"), F.size("r.paragraphs").cast("long").alias("n_paragraphs"), md5(F.array_join("r.paragraphs", "\n")).alias("body_md5"), (F.size("r.idioms") > 0).alias("kept_idioms"))


@query("SELECT event_id, 3 * k AS prompt, k AS hit, CASE WHEN event_id % 2 = 0 THEN 2 * k ELSE 5 END AS miss, user_id AS completion FROM (SELECT event_id, user_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events)")
def usage_lines(spark, sf_dir):
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0).cast("long"))
    counts = {"prompt_tokens": 3 * k, "prompt_cache_hit_tokens": k, "prompt_cache_miss_tokens": F.when(F.col("event_id") % 2 == 1, 5), "completion_tokens": F.col("user_id")}
    rows = table(spark, sf_dir, "events").select("event_id", usage.usage_from_log(F.concat(F.lit("12:00 "), usage.usage_line(counts))).alias("u"))
    return rows.select("event_id", F.col("u.prompt_tokens").alias("prompt"), F.col("u.prompt_cache_hit_tokens").alias("hit"), F.col("u.prompt_cache_miss_tokens").alias("miss"), F.col("u.completion_tokens").alias("completion"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0.25 WHEN p_size % 4 = 0 THEN 0.95 WHEN p_size % 4 = 1 THEN 1.2 ELSE 1.0 END::DOUBLE AS factor FROM part")
def reasoning_factors(spark, sf_dir):
    effort = F.element_at(F.array(F.lit("LOW"), F.lit("max"), F.lit("medium"), F.lit("other")), F.col("p_size") % 4 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", usage.reasoning_factor(effort, F.col("p_size") % 5 != 0).alias("factor"))


@query("""WITH h AS (SELECT ts::DATE AS day FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'signup') > count(*) FILTER (event_type = 'click'))
SELECT event_id, CASE WHEN l::DATE IN (SELECT day FROM h) THEN ts WHEN isodow(l) < 6 AND hour(l) BETWEEN 9 AND 11 THEN date_trunc('day', l) + INTERVAL 4 HOUR WHEN isodow(l) < 6 AND hour(l) BETWEEN 14 AND 17 THEN date_trunc('day', l) + INTERVAL 10 HOUR ELSE ts END AS starts FROM (SELECT event_id, ts, ts + INTERVAL 8 HOUR AS l FROM events)""")
def next_offpeak(spark, sf_dir):
    """Days with more signups than clicks stand for holidays."""
    events = table(spark, sf_dir, "events")
    free = events.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "signup").alias("a"), F.count_if(F.col("event_type") == "click").alias("b")).where("a > b")
    out = usage.next_offpeak(events.withColumn("ts", F.col("ts").cast("timestamp")), free)
    return out.select("event_id", F.col("starts").cast("timestamp_ntz").alias("starts"))


@query("""WITH j AS (SELECT c_custkey AS k, c_name AS n, c_nationkey AS m FROM customer) SELECT k AS custkey, m % 3 <> 0 AS available, CASE WHEN m % 3 = 0 THEN 0 ELSE 1 END::BIGINT AS n, CASE WHEN m % 3 <> 0 THEN n END AS total FROM j""")
def account_balances(spark, sf_dir):
    kind = F.col("c_nationkey") % 3
    infos = F.array(F.struct(F.lit("USD").alias("currency"), F.col("c_name").alias("total_balance")))
    body = F.when(kind == 0, "oops").otherwise(F.to_json(F.struct(F.lit(True).alias("is_available"), infos.alias("balance_infos"))))
    rows = table(spark, sf_dir, "customer").select("c_custkey", responses.balance(body).alias("b"))
    return rows.select(F.col("c_custkey").alias("custkey"), "b.available", F.coalesce(F.size("b.balances"), F.lit(0)).cast("long").alias("n"), F.get("b.balances", F.lit(0))["total_balance"].alias("total"))


@query("SELECT c_custkey AS custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'medium' ELSE c_mktsegment END AS effort, CASE WHEN c_nationkey % 3 = 0 THEN 1 ELSE c_nationkey END::BIGINT AS workers, true AS epub FROM customer")
def job_defaults(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 1, F.col("c_mktsegment")).alias("reasoning_effort"), F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey")).alias("workers"))
    return responses.jobs(rows).select(F.col("c_custkey").alias("custkey"), F.col("reasoning_effort").alias("effort"), F.col("workers").cast("long").alias("workers"), "epub")


# Catalogues, caches, reports
@query("""WITH o AS (SELECT o_custkey AS custkey, o_orderkey AS orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT custkey, orderkey FROM o WHERE i IN (0, least(greatest(1, n // 2), n - 1), least(2 * greatest(1, n // 2), n - 1))""")
def catalogue_picks(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("ord"))
    return usage.catalogue_sample(rows).select(F.col("book_id").alias("custkey"), F.col("ord").alias("orderkey"))


#: Orders as pages of the books that customers stand for: in the order of keys, notices among them, some numbers left out.
BOOK_PAGES = """
o AS (SELECT o_custkey AS book, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderstatus AS status, o_totalprice AS price FROM orders),
p AS (SELECT book, page, CASE WHEN status <> 'P' THEN page - sum((status = 'P')::INT) OVER (PARTITION BY book ORDER BY page) + 2 * sum((price < 30000)::INT) OVER (PARTITION BY book ORDER BY page) END::BIGINT AS number, price FROM o),
there AS (SELECT * FROM p WHERE price >= 20000),
w AS (SELECT c_custkey AS book, n AS wanted, CASE WHEN c_acctbal > 0 THEN q.page END::BIGINT AS saved_page, CASE WHEN c_acctbal > 0 THEN q.number END AS saved_number
  FROM customer, (SELECT unnest([1, 4, 9, 40])::BIGINT AS n) LEFT JOIN (SELECT book, arg_min(page, page) FILTER (number IS NOT NULL) AS page, arg_min(number, page) FILTER (number IS NOT NULL) AS number FROM there GROUP BY book) q ON q.book = c_custkey)"""


@query(f"""WITH RECURSIVE {BOOK_PAGES},
s AS (SELECT book, wanted, wanted + coalesce(saved_page - saved_number, 0) AS page, []::BIGINT[] AS seen, NULL::BIGINT AS an, NULL::BIGINT AS ap, NULL::BIGINT AS found FROM w
  UNION ALL SELECT book, wanted, page + CASE WHEN missing THEN CASE WHEN an2 IS NOT NULL THEN -1 ELSE 1 END WHEN number IS NULL THEN 1 ELSE wanted - number END, list_append(seen, page), an2, ap2, CASE WHEN number = wanted THEN page END
  FROM (SELECT s.*, t.number, t.page IS NULL AS missing, CASE WHEN t.number > wanted AND (an IS NULL OR t.number < an) THEN t.number ELSE an END AS an2, CASE WHEN t.number > wanted AND (an IS NULL OR t.number < an) THEN s.page ELSE ap END AS ap2
    FROM s LEFT JOIN there t ON t.book = s.book AND t.page = s.page WHERE found IS NULL AND s.page >= 1 AND NOT list_contains(seen, s.page) AND len(seen) < 12))
SELECT book AS custkey, wanted, coalesce(arg_max(found, len(seen)), arg_max(ap, len(seen)), wanted) AS page, max(len(seen)) AS probes FROM s GROUP BY book, wanted""")
def located_pages(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), "o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    so_far = Window.partitionBy("book_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    pages = numbered(orders, ["book_id"], ["o_orderkey"], "page")
    number = F.col("page") - F.sum((F.col("o_orderstatus") == "P").cast("int")).over(so_far) + 2 * F.sum((F.col("price") < 30000).cast("int")).over(so_far)
    pages = pages.withColumn("number", F.when(F.col("o_orderstatus") != "P", number)).where("price >= 20000").select("book_id", F.col("page").cast("long").alias("page"), F.col("number").cast("long").alias("number"))
    first = pages.where("number IS NOT NULL").groupBy("book_id").agg(F.min(F.struct("page", "number")).alias("q"))
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"), (F.col("c_acctbal") > 0).alias("known")).join(first, "book_id", "left")
    saved = [F.when(F.col("known"), F.col(f"q.{c}")).alias(f"saved_{c}") for c in ("page", "number")]
    wanted = books.select("book_id", F.explode(F.array(*[F.lit(w).cast("long") for w in (1, 4, 9, 40)])).alias("wanted"), *saved)
    return crawl.locate_page(pages, wanted).select(F.col("book_id").alias("custkey"), "wanted", "page", "probes")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN page_id + 1 WHEN page_id % 3 = 1 THEN page_id + 2 ELSE 77 END AS number FROM pages")
def resume_numbers(spark, sf_dir):
    key = F.col("page_id")
    saved = F.when(key % 3 == 0, F.concat(F.col("url"), F.lit("_"), key, F.lit(".html"))).otherwise("http://other/1.html")
    existing = F.when(key % 3 == 1, key + 1).otherwise(F.lit(0))
    return table(spark, sf_dir, "pages").select("page_id", crawl.resume_number(saved, F.concat(F.col("url"), F.lit("_")), F.lit(".html"), existing, F.lit(77)).cast("long").alias("number"))


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS r FROM lineitem WHERE l_linenumber > 2)
SELECT k AS orderkey, n::BIGINT AS page, 'p' || p AS path FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r, n, 'p' || p) AS i FROM l) WHERE i = 1""")
def next_pages(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.lit(2).alias("current"), F.col("l_linenumber").cast("long").alias("page"), F.concat(F.lit("p"), F.col("l_partkey")).alias("path"), F.when(F.col("l_returnflag") == "R", "next").otherwise("").alias("rel"))
    return crawl.next_page(links, ["orderkey"])


@query("SELECT user_id, count(*) AS n FROM (SELECT user_id, event_id, min(event_id) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS stop FROM events) WHERE stop IS NULL OR event_id < stop GROUP BY user_id")
def rows_before_stop(spark, sf_dir):
    return crawl.before_stop(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "error").groupBy("user_id").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt FROM events)
SELECT user_id, arg_min(event_id, attempt) FILTER (event_type = 'purchase') AS event_id, min(attempt) FILTER (event_type = 'purchase') AS attempt, count(*) AS attempts FROM a WHERE attempt <= 3 GROUP BY user_id""")
def first_passing_attempt(spark, sf_dir):
    tries = table(spark, sf_dir, "events").withColumn("attempt", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    return validation.first_passing(tries, ["user_id"], F.col("event_type") == "purchase", "event_id")


def versions(spark, sf_dir):
    """Documents as chapters, and a cache of other results for them: some fit, some have another hash or other lines."""
    parts = F.split("text", "\n", -1)
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("novel_id"), F.col("doc_id").alias("pos"), F.col("lang").alias("title"), parts.alias("paragraphs"))
    kind = F.col("pos") % 5
    changed = F.when(kind == 1, F.concat("paragraphs", F.array(F.lit("more")))).when(kind == 2, F.transform("paragraphs", lambda p: F.concat(p, F.lit("年")))).otherwise(F.col("paragraphs"))
    own = X.content_hash(F.col("title"), F.col("paragraphs"))
    cache = rows.where("pos % 5 <> 4").select("novel_id", "pos", changed.alias("paragraphs"), F.when(kind == 3, "other").when(F.col("pos") % 2 == 0, own).alias("source_hash"))
    return rows, cache


@query("SELECT doc_id, doc_id % 5 = 0 AS hit FROM documents")
def cache_hits(spark, sf_dir):
    return heal.cached_result(*versions(spark, sf_dir)).select(F.col("pos").alias("doc_id"), "hit")


@query("SELECT count(*) FILTER (lang = 'en') AS taken, count(*) FILTER (lang <> 'en') AS remaining FROM documents")
def stash_take(spark, sf_dir):
    stash = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("|", "doc_id", "text"), 256).alias("hash"))
    taken, rest = heal.take_stashed(stash, table(spark, sf_dir, "documents").where("lang = 'en'").select(F.sha2(F.concat_ws("|", "doc_id", "text"), 256).alias("hash")))
    counts = taken.agg(F.count("*").alias("taken")), rest.agg(F.count("*").alias("remaining"))
    return counts[0].crossJoin(counts[1])


@query(r"""
WITH r AS (SELECT conv_id, turn, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS r FROM conversations WHERE role = 'user'),
t AS (SELECT conv_id, turn - 1 AS turn, array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), chr(10)) AS body, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS t FROM conversations WHERE role = 'assistant'),
b AS (SELECT t.*, r.r, len(regexp_extract_all(body, '[0-9]')) AS left_over FROM t LEFT JOIN r USING (conv_id, turn))
SELECT conv_id, turn + 1 AS chapter, 'empty' AS rule, 0::BIGINT AS n FROM b WHERE t = 0
UNION ALL SELECT conv_id, turn + 1, 'paragraphs', t - r FROM b WHERE t > 0 AND t <> r
UNION ALL SELECT conv_id, turn + 1, 'script', left_over FROM b WHERE t > 0 AND left_over > 0
UNION ALL SELECT conv_id, NULL, 'chapters', coalesce(nt, 0) - coalesce(nr, 0) FROM (SELECT conv_id, count(*) AS nt FROM t GROUP BY 1) FULL JOIN (SELECT conv_id, count(*) AS nr FROM r GROUP BY 1) USING (conv_id) WHERE coalesce(nt, 0) <> coalesce(nr, 0)""")
def validation_report(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("paragraphs", F.split("text", "\n", -1))
    raw = turns.where("role = 'user'").select(F.col("conv_id").alias("novel_id"), F.col("turn").alias("pos"), "paragraphs")
    done = turns.where("role = 'assistant'").select(F.col("conv_id").alias("novel_id"), (F.col("turn") - 1).alias("pos"), "paragraphs")
    return validation.report(raw, done, "0-9").select(F.col("novel_id").alias("conv_id"), F.col("chapter").cast("long").alias("chapter"), "rule", F.col("n").cast("long").alias("n"))


@query("SELECT p_partkey, p_partkey % 25 = 0 AND p_size % 2 = 0 AS due FROM part")
def packages_due(spark, sf_dir):
    index = F.when(F.col("p_size") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", profile.package_due(index).alias("due"))


@query("SELECT p_name AS path, CASE WHEN p_size % 4 = 0 THEN true WHEN p_size % 4 = 1 THEN true WHEN p_size % 4 = 2 THEN true ELSE false END AS rebuild, p_partkey FROM part")
def stale_packages(spark, sf_dir):
    size = F.col("p_size")
    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", F.concat_ws("#", "p_name", "p_partkey").alias("path"), size.cast("long").alias("size"), F.col("p_partkey").alias("mtime"), F.sha2("p_name", 256).alias("sha256"),
        F.col("p_type").alias("title"), F.col("p_brand").alias("author"), F.lit(None).cast("string").alias("metadata"), F.lit("2026").alias("publication_date"),
    )
    old = part.where("p_size % 4 <> 0").withColumn("valid", size % 4 != 1).withColumn("sha256", F.when(size % 4 == 2, "other").otherwise(F.col("sha256")))
    out = profile.stale_packages(part, old.drop("p_partkey", "p_size", "publication_date"))
    return out.select(F.substring_index("path", "#", 1).alias("path"), "rebuild", "p_partkey")


@query("""SELECT name, folder, row_number() OVER (ORDER BY mtime DESC, name) AS rank FROM (SELECT o_orderpriority || o_custkey || '.EPUB' AS name, min(o_orderkey) AS folder, arg_min(o_orderdate, o_orderkey) AS mtime FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1)""")
def library_listing(spark, sf_dir):
    ending = F.when(F.col("o_orderkey") % 3 == 0, ".tmp").otherwise(".EPUB")
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("folder_order"), F.concat("o_orderpriority", "o_custkey", ending).alias("name"), F.lit(1).alias("size"), F.col("o_orderdate").alias("mtime"))
    return profile.library(files, [".epub", ".pdf"]).select("name", F.col("folder_order").alias("folder"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name WHEN p_size % 3 = 0 THEN 'kept' WHEN p_size % 5 = 0 THEN p_type ELSE 'A Book' END AS title,
CASE WHEN p_size % 2 = 0 THEN 'manual' WHEN p_size % 3 = 0 THEN 'manual' WHEN p_size % 5 = 0 THEN 'source' ELSE 'fallback' END AS origin, 'Unknown' AS author FROM part""")
def book_profiles(spark, sf_dir):
    size, none = F.col("p_size"), F.lit(None).cast("string")
    part = table(spark, sf_dir, "part").withColumn("path", F.concat(F.lit("/x/"), F.col("p_partkey"), F.lit("/a-book_raw.txt")))
    asked = part.select(
        "path", none.alias("source_url"), F.when(size % 2 == 0, F.concat(F.lit(" "), F.col("p_name"))).alias("title"), none.alias("author"),
        F.when(size % 5 == 0, F.col("p_type")).alias("original_title"), *[none.alias(c) for c in ("original_author", "genre", "publication_date")],
    )
    old = part.where("p_size % 3 = 0").select("path", *[none.alias(c) for c in ("book_id", "created_at", "source_identity", "author", "author_origin", *profile.SOURCE_FIELDS)], F.lit("kept").alias("display_title"), F.lit("manual").alias("display_title_origin"))
    made = profile.prepare(asked, old, F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return made.select(F.split("path", "/")[2].cast("long").alias("p_partkey"), F.col("display_title").alias("title"), F.col("display_title_origin").alias("origin"), "author")


@query("""SELECT p_partkey, sha256('{"display_title":"' || p_name || '","author":"' || p_brand || '","genre":"","publication_date":"' || p_size || '","book_id":"' || p_partkey || '"}') AS stamp FROM part""")
def profile_stamps(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("display_title"), F.col("p_brand").alias("author"), F.lit(None).cast("string").alias("genre"), F.col("p_size").alias("publication_date"), F.col("p_partkey").alias("book_id"))
    return rows.select("p_partkey", profile.fingerprint().alias("stamp"))


@query("""SELECT c_custkey AS custkey, coalesce(n, 0) AS source_chapters, coalesce(m, 0) AS exported_chapters, coalesce(n, 0) > 0 AND coalesce(m, 0) >= n AS snapshot_complete
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def export_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), "o_orderstatus")
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"))
    return profile.export_counts(books, orders, orders.where("o_orderstatus = 'F'")).withColumnRenamed("path", "custkey")


# Pages, scripts, parts of names
#: Hosts that pages are taken to stand at, by their number, and the sites that these are; other pages stay where they are.
MOVED = {0: ("www.uukanshu.cc", "uukanshu"), 1: ("wx.bgq99.cc", "bgq99"), 2: ("69shuba.cx", "69shuba"), 3: ("M.SHUBAOW.NET", "shubaow"), 4: ("not-biquge.tw", None)}


@query("SELECT page_id, CASE page_id % 7 " + " ".join(f"WHEN {k} THEN '{name}'" for k, (_, name) in MOVED.items() if name) + r""" END AS site, CASE WHEN page_id % 7 IN (0, 2) THEN page_id::VARCHAR END AS book FROM pages""")
def site_routes(spark, sf_dir):
    """Pages moved to known hosts, and the site and book that their URLs then name."""
    host = F.element_at(F.create_map(*[F.lit(x) for k, (h, _) in MOVED.items() for x in (k, h)]), (F.col("page_id") % 7).cast("int"))
    moved = table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.concat(F.lit("https://"), host, F.lit("/book/"), "page_id", F.lit("/")), "url").alias("url"))
    return moved.select("page_id", P.site(F.col("url")).alias("site"), F.when(F.col("page_id") % 7 != 1, F.when(F.col("page_id") % 7 != 3, P.url_ids(F.col("url"))["book"])).alias("book"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS bare, regexp_extract(url, '^[^?#]+') AS path, regexp_extract(url, '^[a-z]+://[^/?#]+') AS root FROM pages),
d AS (SELECT *, CASE WHEN path = root THEN root || '/' ELSE regexp_replace(path, '[^/]*$', '') END AS folder FROM p)
SELECT page_id, folder || 'x.html' AS next, root || '/b/c' AS rooted, 'https://else.org/q' AS whole, path || '?page=2' AS query, bare || '#end' AS part FROM d""")
def absolute_links(spark, sf_dir):
    links = {"next": "./y/../x.html", "rooted": "/b/./c", "whole": "https://else.org/q", "query": "?page=2", "part": "#end"}
    return table(spark, sf_dir, "pages").select("page_id", *[P.absolute(F.col("url"), F.lit(h)).alias(n) for n, h in links.items()])


@query("SELECT doc_id, md5(CASE WHEN lang = 'en' THEN text ELSE '年' || text END) AS text_md5 FROM documents")
def decoded_bytes(spark, sf_dir):
    """English documents as UTF-8; the others as GB18030, after a character whose bytes are not UTF-8."""
    encoded = P.rowwise(lambda t: None if t is None else ("年" + t).encode("gb18030"), "binary")
    raw = F.when(F.col("lang") == "en", F.col("text").cast("binary")).otherwise(encoded(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", md5(P.decoded(raw)).alias("text_md5"))


@query("SELECT doc_id, md5(translate(text, 'aeß', 'αεs')) AS text_md5 FROM documents")
def mapped_scripts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", md5(X.to_simplified(F.col("text"), {"a": "α", "e": "ε", "ß": "s"})).alias("text_md5"))


@query("SELECT c_custkey AS custkey, count(*) FILTER (o_orderstatus = 'F') = count(*) AS ok, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def chapter_pages(spark, sf_dir):
    """Orders as the pages of a chapter of each customer: whole only if every one is there and in order."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), F.lit(1).alias("chapter"), place.alias("page"), F.count("*").over(Window.partitionBy("o_custkey")).alias("last"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("missing").alias("status"), F.array("o_orderpriority").alias("paragraphs"))
    out = P.join_chapter_pages(rows).join(rows.groupBy("book").agg(F.count("*").alias("n")), "book")
    return out.select(F.col("book").alias("custkey"), (F.col("status") == "ok").alias("ok"), "n")


@query("""WITH k AS (SELECT p_name AS gram, count(*) AS n FROM part GROUP BY 1 UNION SELECT left(p_name, 4), count(*) FROM part GROUP BY 1 UNION SELECT p_name || 'x', 1 FROM part WHERE p_size < 20),
u AS (SELECT gram, max(n) AS n FROM k GROUP BY gram),
c AS (SELECT h.gram AS h, h.n AS hn, g.gram AS g, g.n AS gn, replace(h.gram, g.gram, '') AS rest FROM u h JOIN u g ON contains(h.gram, g.gram) AND length(g.gram) BETWEEN 2 AND length(h.gram) - 1)
SELECT DISTINCT CASE WHEN hn >= 0.8 * gn THEN g ELSE h END AS gram FROM c WHERE hn >= 0.8 * gn OR (length(rest) = 1 AND gn >= 2 * hn)""")
def suppressed_parts(spark, sf_dir):
    """Part names, their heads of four characters and some longer by one, as candidates with their counts."""
    part = table(spark, sf_dir, "part")
    kept = part.groupBy(F.col("p_name").alias("gram")).agg(F.count("*").alias("n")).unionByName(part.groupBy(F.substring("p_name", 1, 4).alias("gram")).agg(F.count("*").alias("n")))
    kept = kept.unionByName(part.where("p_size < 20").select(F.concat(F.col("p_name"), F.lit("x")).alias("gram")).distinct().withColumn("n", F.lit(1).cast("long")))
    kept = kept.groupBy("gram").agg(F.max("n").alias("n"))
    return mining.suppressed(kept, part.select(F.col("p_name").alias("word")).where("false"), [])


# Dictionaries as a whole
@query("""
WITH s AS (
SELECT 1::BIGINT AS source, p_partkey AS n, 'w' || p_partkey % 700 AS word, p_type AS meaning FROM part WHERE p_size % 2 = 0
UNION ALL SELECT 2, 0, 'w' || p_partkey, p_brand FROM part WHERE p_size % 3 = 0
UNION ALL SELECT 3, p_partkey, 'w' || p_partkey % 500, p_name FROM part WHERE p_size % 5 = 0
UNION ALL SELECT 4, 0, 'w' || p_partkey, p_type FROM part WHERE p_size % 7 = 0
UNION ALL SELECT 5, 0, 'w' || p_partkey, p_brand || 'c' FROM part WHERE p_size % 11 = 0
UNION ALL SELECT 6, 0, 'w' || p_partkey, p_name || 's' FROM part WHERE p_size % 13 = 0
UNION ALL SELECT 0, 0, 'w' || p_partkey, 'g' FROM part)
SELECT word, arg_max(meaning, source * 1000000000 + n) AS meaning, max(source)::INT AS source FROM s GROUP BY word""")
def dictionary_build(spark, sf_dir):
    """The parts as lines of six sources and a glossary that overlap in their words."""
    part = table(spark, sf_dir, "part").withColumn("w", F.concat(F.lit("w"), "p_partkey"))
    every = lambda k: part.where(F.col("p_size") % k == 0)
    wrapped = lambda k: F.concat(F.lit("w"), F.col("p_partkey") % k)
    sources = {
        "cvdict": every(2).select(F.col("p_partkey").alias("n"), F.concat(wrapped(700), F.lit(" S [p] /"), "p_type", F.lit("/b/")).alias("value")),
        "cognates": every(3).select(F.col("w").alias("word"), F.concat("p_brand", F.lit("/b")).alias("meaning")),
        "phrases": every(5).select(F.col("p_partkey").alias("n"), F.concat(wrapped(500), F.lit(" = "), "p_name", F.lit("/x")).alias("value")),
        "json": every(7).select(F.to_json(F.create_map("w", F.struct(F.concat("p_type", F.lit("; b")).alias("definition")))).alias("value")),
        "crawled": every(11).select(F.col("w").alias("word"), F.concat("p_brand", F.lit("c")).alias("meaning")),
        "seeds": every(13).select(F.col("w").alias("word"), F.concat("p_name", F.lit("s")).alias("meaning")),
        "glossary": part.select(F.col("w").alias("word"), F.lit("g").alias("meaning")),
    }
    return D.built(sources)["words"]


@query("SELECT 'w' || p_partkey % 700 AS word, arg_max(p_name, p_partkey) AS meaning FROM part WHERE p_size % 5 <> 0 GROUP BY 1")
def dictionary_pages(spark, sf_dir):
    """The parts as saved dictionary pages; every fifth has no meaning."""
    name = F.concat(F.lit(f"{P.CRUMB} "), "p_type", F.lit(" - w"), F.col("p_partkey") % 700)
    crumb = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('<script type="application/ld+json">{"name": "'), name, F.lit('"}</script>'))).otherwise(F.concat(F.lit("<ul><li>Home » <li>"), name, F.lit("» more</ul>")))
    lead = F.when(F.col("p_size") % 5 == 0, "<p>no lead").otherwise(F.concat(F.lit('<p class="lead">'), "p_name", F.lit(" <i>(Từ điển chung)</i></p>")))
    return P.dictionary_entries(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.concat(crumb, lead).alias("html")))


@query("SELECT DISTINCT replace(p_brand, '#', '_') || p_size AS slug FROM part WHERE p_size % 3 = 0")
def dictionary_slugs(spark, sf_dir):
    """The parts as lists of links: to entries, to a placeholder, and to other pages."""
    slug = F.concat(F.replace("p_brand", F.lit("#"), F.lit("_")), "p_size")
    href = F.when(F.col("p_size") % 3 == 0, slug).when(F.col("p_size") % 3 == 1, "none").otherwise(F.concat(F.lit("a/"), slug))
    return P.entry_slugs(table(spark, sf_dir, "part").select(F.concat(F.lit('<a href="tu-dien_han-viet_'), href, F.lit('_rong-mo-tam-hon.html">x</a>')).alias("html")))


@query("""
WITH s AS (SELECT 'parts' AS source, p_partkey AS n, p_name AS value FROM part UNION ALL SELECT 'texts', doc_id, text FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n) AS r FROM s WHERE NOT starts_with(value, '#') AND regexp_matches(value, '\\S'))
SELECT source, count(*) AS lines, md5(string_agg(left(value, 120), '|' ORDER BY n) FILTER (r <= 5)) AS samples_md5 FROM k GROUP BY source""".replace("\\\\", "\\"))
def source_inspection(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), F.col("p_name").alias("value"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), F.col("text").alias("value"))
    return D.inspected({"parts": parts, "texts": texts}).select("source", "lines", md5(F.array_join("samples", "|")).alias("samples_md5"))


# Large dictionaries
WORDS = r"(SELECT string_agg(w, '|' ORDER BY length(w) DESC, w) FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-zA-Z]{3,}')) AS w FROM benchmark))"


def benchmark_words(spark, sf_dir):
    found = F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]{3,}"), F.lit(0)))
    return table(spark, sf_dir, "benchmark").select(found.alias("term")).distinct()


@query(f"SELECT doc_id, len(s) AS n_spans, md5(array_to_string(s, chr(10))) AS spans_md5 FROM (SELECT doc_id, regexp_extract_all(text, {WORDS}) AS s FROM documents) WHERE len(s) > 0")
def dictionary_spans(spark, sf_dir):
    """Words of the benchmark's passages wherever they stand in documents, within other words too, leftmost and longest first."""
    spans = terms.term_spans(table(spark, sf_dir, "documents"), benchmark_words(spark, sf_dir))
    found = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "term"))).alias("s"))
    return found.select("doc_id", F.size("s").cast("long").alias("n_spans"), md5(F.array_join(F.transform("s", lambda x: x["term"]), "\n")).alias("spans_md5"))


@query(f"SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '(' || {WORDS} || ')', '​\\1​', 'g')) AS marked_md5 FROM documents")
def dictionary_marks(spark, sf_dir):
    words = benchmark_words(spark, sf_dir).select(F.col("term").alias("zh"), F.col("term").alias("vi"))
    return terms.marked_texts(table(spark, sf_dir, "documents"), words).select("doc_id", md5(F.col("text")).alias("marked_md5"))


# Attempts and state
@query("""
WITH l AS (SELECT user_id, event_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) % 6 + 1 AS n, event_type IN ('error', 'click') AS again, event_type = 'purchase' AS stop FROM events),
g AS (SELECT *, CASE WHEN again THEN least(power(2, n - 1), 30)::BIGINT * 3600 ELSE 0 END AS wait FROM l),
e AS (SELECT *, ts + to_seconds(CASE WHEN again THEN wait + 3600 ELSE 1 END) AS until FROM g),
b AS (SELECT *, coalesce(ts > max(until) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM e),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM b)
SELECT user_id, min(ts) AS start, count(*) AS attempts, sum(wait)::BIGINT AS waited, CASE WHEN arg_max(again, ts) THEN 'failed' WHEN arg_max(stop, ts) THEN 'stop' ELSE 'ok' END AS outcome FROM s GROUP BY user_id, session""")
def call_attempts(spark, sf_dir):
    """Events as attempts at calls, hours for seconds: errors and clicks are tried again, a purchase finds the account empty."""
    code = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "click", 429).when(F.col("event_type") == "purchase", 402).otherwise(200)
    number = F.get_json_object("props", "$.k").cast("long") % 6 + 1
    log = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), number.alias("attempt"), code.alias("code"), F.lit("answer").alias("body"))
    return validation.attempt_sessions(log, ["user_id"], unit=3600).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
SELECT doc_id AS pos, md5(CASE WHEN lang = 'en' THEN text || ' again' ELSE text END) AS body_md5, CASE WHEN lang = 'en' THEN 'second' ELSE 'first' END AS title FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) OR lang = 'fr'""")
def state_versions(spark, sf_dir):
    """Results of all documents saved, English ones saved again, toxic ones deleted, French ones of these saved once more."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    rows = lambda df, title, text: df.select(F.col("source").alias("novel_id"), F.col("doc_id").alias("pos"), F.lit(title).alias("title"), F.array(text).alias("paragraphs"), F.sha2("text", 256).alias("source_hash"))
    toxic = docs.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    S.results(spark, folder).upsert(rows(docs, "first", F.col("text")))
    S.results(spark, folder).upsert(rows(docs.where("lang = 'en'"), "second", F.concat("text", F.lit(" again"))))
    S.results(spark, folder).delete(rows(toxic, "", F.lit("")))
    held = S.results(spark, folder)
    held.upsert(rows(toxic.where("lang = 'fr'"), "first", F.col("text")))
    held.compact()
    return S.results(spark, folder).load().select("pos", md5(F.col("paragraphs")[0]).alias("body_md5"), "title")


# Saved files and catalogues
@query("""SELECT page_id, url, md5(CASE WHEN contains(url, '?') THEN html ELSE '<!-- saved from url=(0)' || url || ' -->' || chr(10) || html || chr(10) END) AS html_md5 FROM pages""")
def saved_page_files(spark, sf_dir):
    """All pages saved as files, those whose URL has a query as MHTML, and read back."""
    pages = table(spark, sf_dir, "pages")
    wrapped = F.concat(
        F.lit("From: <saved>\r\nSnapshot-Content-Location: "), "url", F.lit('\r\nMIME-Version: 1.0\r\nContent-Type: multipart/related; type="text/html"; boundary="b0"\r\n\r\n--b0\r\nContent-Type: text/html; charset="utf-8"\r\nContent-Transfer-Encoding: base64\r\n\r\n'),
        F.base64(F.col("html").cast("binary")), F.lit("\r\n--b0--\r\n"),
    )
    plain = F.concat(F.lit("<!-- saved from url=(0)"), "url", F.lit(" -->\n"), "html")
    place = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    P.save_pages(pages.select("page_id", F.when(F.col("url").contains("?"), wrapped).otherwise(plain).alias("value")), place)
    out = P.saved_pages(spark, place)
    return out.select(F.regexp_extract("path", "-page_id=([0-9]+)[.]html$", 1).cast("long").alias("page_id"), "url", md5(F.col("html")).alias("html_md5"))


#: Orders as links of a catalogue page for each customer: dear ones first, numbered by key unless their status is P.
LINKS = """
WITH l AS (SELECT o_custkey AS book, o_orderkey AS chapter, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS number, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders),
e AS (SELECT book, count(number) = count(*) AS by_number, coalesce(arg_min_null(number, n) > arg_max_null(number, n), false) AS falling, arg_max(chapter, n) AS last FROM l GROUP BY book),
c AS (SELECT book, chapter, last, row_number() OVER (PARTITION BY book ORDER BY CASE WHEN by_number THEN number WHEN falling THEN -n ELSE n END) - 1 AS ord FROM l JOIN e USING (book))
"""


def catalogue_pages(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    number = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit(' data-num="'), "o_orderkey", F.lit('"'))).otherwise("")
    item = F.concat(F.lit("<li"), number, F.lit('><a href="/txt/'), "o_custkey", F.lit("/"), "o_orderkey", F.lit('">Chapter '), "o_orderkey", F.lit("</a>"))
    items = F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey", item.alias("item"))))
    pages = orders.groupBy(F.col("o_custkey").alias("page_id")).agg(items.alias("items"))
    return pages.select("page_id", F.concat(F.lit("https://www.69shuba.com/book/"), "page_id", F.lit(".htm")).alias("url"), F.concat(F.lit('<div id="catalog"><ul>'), F.array_join(F.transform("items", lambda x: x["item"]), "\n"), F.lit("</ul></div>")).alias("html"))


@query(LINKS + "SELECT book AS custkey, ord::INT AS ord, 'Chapter ' || chapter AS title FROM c")
def catalogue_order(spark, sf_dir):
    return P.catalogue(catalogue_pages(spark, sf_dir)).select(F.col("page_id").alias("custkey"), "ord", "title")


@query(LINKS + "SELECT book AS custkey, 'listed' AS kind, max(ord) FILTER (chapter = last)::INT AS ord FROM c GROUP BY book UNION ALL SELECT DISTINCT book, kind, 0 FROM c, (SELECT unnest(['absent', 'catalogue']) AS kind)")
def catalogue_starts(spark, sf_dir):
    """Where to start for the URL of the last link of each catalogue, of a chapter that isn't listed, and of the catalogue."""
    listed = P.catalogue(catalogue_pages(spark, sf_dir))
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.max(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey")).alias("m"))
    base = F.concat(F.lit("https://69shuba.cx/txt/"), "page_id", F.lit("/"))
    urls = {"listed": F.concat(base, "m.o_orderkey"), "absent": F.concat(base, F.lit("1000000000")), "catalogue": F.concat(F.lit("https://69shuba.cx/book/"), "page_id", F.lit(".htm"))}
    starts = last.select("page_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), u.alias("start_url")) for k, u in urls.items()])).alias("s")).select("page_id", "s.kind", "s.start_url")
    found = P.start_index(listed, starts)
    return found.join(starts, ["page_id", "start_url"]).select(F.col("page_id").alias("custkey"), "kind", "ord")


# Terms of chapters
@query(f"""WITH f AS {CONTAINED}, m AS (SELECT term, count(DISTINCT doc_id) AS chapters, min(doc_id) AS first_doc, arg_min(first_pos, doc_id) AS p FROM f GROUP BY term)
SELECT md5(term) AS term_md5, chapters, first_doc, md5({stripped("replace(substr(text, greatest(1, p - 18), p + length(term) + 18 - greatest(1, p - 18)), chr(10), ' ')")}) AS example_md5 FROM m JOIN documents ON doc_id = first_doc""")
def passage_examples(spark, sf_dir):
    out = terms.examples(contained(spark, sf_dir), table(spark, sf_dir, "documents"))
    return out.select(md5(F.col("term")).alias("term_md5"), "chapters", "first_doc", md5(F.col("example")).alias("example_md5"))


@query("SELECT vi, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z]{3,}')) AS vi FROM benchmark) WHERE vi = lower(vi) GROUP BY vi")
def lower_renderings(spark, sf_dir):
    listed = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]{3,}"), F.lit(0))).alias("vi"))
    return terms.lower_renderings(listed).groupBy("vi").agg(F.count("*").alias("n"))


@query("SELECT length(regexp_extract(text, '[a-zA-Z]+')) AS length, count(*) AS entries, count(*) FILTER (contains(text, '[') OR contains(text, ']') OR contains(text, '(Tw)') OR contains(text, '(Hk)') OR contains(text, '/zhōng/') OR contains(text, '/xué/')) AS suspicious FROM documents GROUP BY 1 ORDER BY 1 LIMIT 10")
def dictionary_lengths(spark, sf_dir):
    """The first word of each document as an entry, its text as the meaning."""
    words = table(spark, sf_dir, "documents").select(F.regexp_extract("text", "[a-zA-Z]+", 0).alias("word"), F.col("text").alias("meaning"))
    return validation.dictionary_lengths(words)


@query("SELECT doc_id, md5(translate(regexp_replace(text, 'the|qu', '', 'g'), 'aeß', 'αεs')) AS text_md5 FROM documents")
def mapped_phrases(spark, sf_dir):
    """Two phrases vanish; all other characters follow the map."""
    return table(spark, sf_dir, "documents").select("doc_id", md5(X.to_simplified(F.col("text"), {"a": "α", "e": "ε", "ß": "s"}, {"the": "", "qu": ""})).alias("text_md5"))


GLOSSARY = """
w AS (SELECT DISTINCT item_id % 4 AS k, unnest(regexp_extract_all(text, '[a-zA-Z]{4,}')) AS zh FROM benchmark),
g AS (SELECT source, zh, row_number() OVER (PARTITION BY source ORDER BY zh) AS ord FROM (SELECT DISTINCT source, length(source) % 2 AS k FROM documents) s JOIN (SELECT DISTINCT k % 2 AS k, zh FROM w) USING (k))"""


def glossaries(spark, sf_dir):
    """Words of the benchmark as the glossaries of the sources: by the parity of the item and of the source's name."""
    words = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 2).alias("k"), F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]{4,}"), F.lit(0))).alias("zh")).distinct()
    novels = table(spark, sf_dir, "documents").select(F.col("source").alias("novel_id"), (F.length("source") % 2).cast("long").alias("k")).distinct()
    return numbered(novels.join(words, "k").select("novel_id", "zh"), ["novel_id"], ["zh"], "ord").withColumn("vi", F.upper("zh"))


def text_chapters(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("novel_id"), F.col("doc_id").alias("pos"), F.lit("").alias("title"), F.split("text", "\n", -1).alias("paragraphs"))


@query(f"""WITH {GLOSSARY},
f AS (SELECT doc_id, zh, ord, row_number() OVER (PARTITION BY doc_id ORDER BY length(zh) DESC, ord) AS k FROM documents d JOIN g ON g.source = d.source AND contains(d.text, g.zh))
SELECT doc_id, count(*) AS n, md5(string_agg(zh || CASE WHEN length(zh) = 4 THEN '?' ELSE '' END, ' ' ORDER BY ord)) AS terms_md5 FROM f WHERE k <= 300 GROUP BY doc_id""")
def chapter_terms(spark, sf_dir):
    """The terms of each document's own glossary; words of four letters stand for common words."""
    glossary = glossaries(spark, sf_dir)
    common = glossary.where(F.length("zh") == 4).select(F.col("zh").alias("word"))
    found = N.chapter_terms(text_chapters(spark, sf_dir), glossary, common)
    shown = F.concat("zh", F.when(F.col("kind") == "ambiguous", "?").otherwise(""))
    out = found.groupBy(F.col("pos").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("ord", shown.alias("t")))).alias("l"))
    return out.select("doc_id", F.size("l").cast("long").alias("n"), md5(F.array_join(F.transform("l", lambda x: x["t"]), " ")).alias("terms_md5"))


@query(f"""WITH {GLOSSARY},
i AS (SELECT DISTINCT zh FROM w WHERE k IN (1, 3)),
f AS (SELECT doc_id, d.source, zh, instr(text, zh) AS p FROM documents d JOIN i ON contains(text, zh) AND (length(zh) = 5 OR zh >= 'm' OR length(zh) % 2 = length(source) % 2) ANTI JOIN g ON g.source = d.source AND g.zh = i.zh),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, zh) AS k FROM f)
SELECT doc_id, count(*) AS n, md5(string_agg(CASE WHEN length(zh) = 5 THEN 'known:' || upper(zh) WHEN zh < 'm' THEN 'hint:gợi ý: ' || zh || '!' ELSE 'hint:nghĩa: ' || lower(zh) END, ' ' ORDER BY k)) AS idioms_md5 FROM h WHERE k <= 60 GROUP BY doc_id""")
def chapter_idioms(spark, sf_dir):
    """Words of odd benchmark items as idioms: curated ones have five letters, prepared ones begin before m, others are detected.

    A source's memory holds the prepared words whose length has the parity of its name's.
    """
    words = table(spark, sf_dir, "benchmark").where("item_id % 2 = 1").select(F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]{4,}"), F.lit(0))).alias("key")).distinct()
    novels = table(spark, sf_dir, "documents").select(F.col("source").alias("novel_id"), (F.length("source") % 2).alias("k")).distinct()
    curated = words.where("length(key) = 5").select("key", F.upper("key").alias("vi"))
    memory = novels.join(words.where("length(key) <> 5 AND key < 'm'").withColumn("k", F.length("key") % 2), "k").select("novel_id", "key", F.concat("key", F.lit("!")).alias("vi"), F.lit(False).alias("approved"), F.lit("chuan_bi").alias("source"), F.lit(0).alias("uses"))
    detector = words.where("length(key) <> 5 AND key >= 'm'").select("key", F.lower("key").alias("hint"))
    found = N.chapter_idioms(text_chapters(spark, sf_dir), glossaries(spark, sf_dir), memory, curated, detector)
    out = found.groupBy(F.col("pos").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("ord", F.concat("kind", F.lit(":"), "vi").alias("t")))).alias("l"))
    return out.select("doc_id", F.size("l").cast("long").alias("n"), md5(F.array_join(F.transform("l", lambda x: x["t"]), " ")).alias("idioms_md5"))
