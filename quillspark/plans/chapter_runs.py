"""Driver queries of runs over whole novels: translation on recorded replies, preparation, books and paths."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.tables import cut, dropped, numbered, numbered_wide, shared_folder
from quillspark.operators import jobs
from quillspark.operators import novel_run as N
from quillspark.plans.queries import as_novels, lines_of, query, table
from quillspark.sources import books
from quillspark.streaming import chapters as stream
from quillspark.streaming import evolving as E


def full_lines(c):
    return F.filter(F.split(c, "\n", -1), lambda p: X.strip(p) != "")


FULL = r"list_filter(string_split({}, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')"


def conversation_run(spark, sf_dir):
    """A run over conversations: user turns are chapters, and recorded replies, a cache and a stash answer them.

    The first reply to a chapter is the assistant's next turn, refused by the service in some conversations; each
    fourth turn has a second reply with its own lines without digits, and a few find the account empty.
    """
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    asked = turns.where("role = 'user'").select(F.col("conv_id").alias("novel_id"), F.col("turn").alias("pos"), F.lit("a title").alias("title"), full_lines(F.col("text")).alias("paragraphs"), F.regexp_replace("text", "[0-9]", "").alias("bare"))
    body = lambda p: F.to_json(F.struct(F.lit("a title").alias("title"), p.alias("paragraphs"), F.create_map(F.lit("k"), F.lit("v")).alias("new_terms")))
    first = turns.where("role = 'assistant'").select(F.col("conv_id").alias("novel_id"), (F.col("turn") - 1).alias("pos"), F.lit(1).alias("attempt"), F.when(F.col("conv_id") % 7 == 3, 500).otherwise(200).alias("code"), body(F.split("text", "\n", -1)).alias("body"))
    second = asked.where("pos % 4 = 0").select("novel_id", "pos", F.lit(2).alias("attempt"), F.when((F.col("novel_id") % 5 == 4) & (F.col("pos") > 0), 402).otherwise(200).alias("code"), body(F.split("bare", "\n", -1)).alias("body"))
    cache = asked.where("pos % 6 = 2").select("novel_id", "pos", "title", full_lines(F.col("bare")).alias("paragraphs"), F.when(F.col("novel_id") % 2 == 0, "of another text").alias("source_hash"))
    stash = asked.where("pos % 8 = 6").select(X.content_hash(F.col("title"), F.col("paragraphs")).alias("hash"), "title", "paragraphs")
    none = spark.createDataFrame([], "novel_id long, ord struct<pos:long,zh:string>, zh string, vi string")
    return N.translate(asked.drop("bare"), first.unionByName(second), cache, stash, none, "0-9")


RUN = rf"""
WITH u AS (SELECT conv_id, turn, len({FULL.format("text")}) AS n, len({FULL.format("regexp_replace(text, '[0-9]', '', 'g')")}) AS bare, {FULL.format("text")} AS lines FROM conversations WHERE role = 'user' AND text IS NOT NULL),
a AS (SELECT conv_id, turn - 1 AS turn, len({FULL.format("text")}) AS m, regexp_matches(text, '[0-9]') AS digits FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
s AS (SELECT DISTINCT lines FROM u WHERE turn % 8 = 6),
t AS (SELECT u.*, CASE WHEN m IS NULL THEN NULL WHEN conv_id % 7 = 3 THEN 'retry' WHEN m <> n THEN 'paragraphs' WHEN digits THEN 'script' ELSE 'ok' END AS v1,
  CASE WHEN turn % 4 <> 0 THEN NULL WHEN conv_id % 5 = 4 AND turn > 0 THEN 'stop' WHEN bare <> n THEN 'paragraphs' ELSE 'ok' END AS v2 FROM u LEFT JOIN a USING (conv_id, turn)),
o AS (SELECT *, CASE WHEN lines IN (SELECT lines FROM s) THEN 'stash' WHEN turn % 6 = 2 AND conv_id % 2 = 1 AND bare = n THEN 'cache' WHEN v1 = 'ok' OR v2 = 'ok' THEN 'reply' END AS origin FROM t),
g AS (SELECT *, sum((origin IS NULL)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM o),
p AS (SELECT *, CASE WHEN gap = 0 THEN 'written' WHEN origin IS NOT NULL THEN 'kept' WHEN gap = 1 THEN 'failed' ELSE 'waiting' END AS place,
  CASE WHEN v2 = 'stop' THEN 'stop' ELSE coalesce(v2, v1, 'retry') END AS verdict FROM g)
"""


@query(RUN + "SELECT conv_id, turn, place, CASE place WHEN 'written' THEN origin WHEN 'failed' THEN verdict ELSE '' END AS how FROM p WHERE place <> 'waiting'")
def chapter_run(spark, sf_dir):
    out = conversation_run(spark, sf_dir)
    rows = [out[k].select(F.col("novel_id").alias("conv_id"), F.col("pos").alias("turn"), F.lit(k).alias("place"), how.alias("how")) for k, how in (("written", F.col("origin")), ("kept", F.lit("")), ("failed", F.col("verdict")))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(RUN + """, c AS (SELECT conv_id, count(*) FILTER (place = 'failed') AS failed, bool_or(place = 'failed' AND verdict = 'stop') AS stop FROM p GROUP BY conv_id)
SELECT status, CASE status WHEN 'done' THEN 'HOAN TAT' WHEN 'stopped' THEN 'DA DUNG (resume khi chay lai)' ELSE 'DUNG DO HET SO DU API' END AS label, count(*) AS novels, sum(failed)::BIGINT AS failed
FROM (SELECT *, CASE WHEN failed = 0 THEN 'done' WHEN stop THEN 'stopped_balance' ELSE 'stopped' END AS status FROM c) GROUP BY status""")
def run_outcomes(spark, sf_dir):
    return N.run_summary(conversation_run(spark, sf_dir)["summary"])


def candidate_names(spark, sf_dir):
    """Parts as candidates of the novels that brands stand for: the commonest names of a brand first."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("novel_id"), F.col("p_name").alias("zh")).agg(F.count("*").alias("n"), F.min("p_size").alias("size"))
    place = F.row_number().over(Window.partitionBy("novel_id").orderBy(F.desc("n"), "zh"))
    return names.withColumn("rank", place.cast("long"))


NAMES = """
WITH n AS (SELECT p_brand AS brand, p_name AS name, count(*) AS n, min(p_size) AS size FROM part GROUP BY ALL),
skipped AS (SELECT p_brand AS brand FROM part GROUP BY 1 HAVING count(*) % 3 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, name) AS rank FROM n),
todo AS (SELECT *, (row_number() OVER (PARTITION BY brand ORDER BY rank, name) - 1) // 150 AS batch FROM r WHERE brand NOT IN (SELECT brand FROM skipped) AND size % 5 <> 0 AND size % 7 <> 0)
"""


def preparation(spark, sf_dir):
    names = candidate_names(spark, sf_dir)
    chapters = table(spark, sf_dir, "part").select(F.col("p_brand").alias("novel_id"))
    state = chapters.groupBy("novel_id").agg(F.count("*").alias("chapters")).select("novel_id", "chapters", (F.col("chapters") % 3 == 0).alias("done"))
    glossary = names.where("size % 5 = 0").select("novel_id", F.col("rank").alias("ord"), "zh", F.upper("zh").alias("vi"))
    checked = names.where("size % 7 = 0").select("novel_id", "zh")
    given = names.select("novel_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("batch"), "zh", F.when(F.col("size") % 2 == 0, F.initcap("zh")).otherwise(F.col("zh")).alias("vi")).withColumn("batch", F.col("batch").cast("long"))
    return N.prepare(chapters, names, glossary, state, checked, given)


@query(NAMES + "SELECT brand, name, rank FROM todo WHERE size % 2 = 0 AND contains(name, ' ') AND batch <= 1")
def prepared_names(spark, sf_dir):
    return preparation(spark, sf_dir)["added"].select(F.col("novel_id").alias("brand"), F.col("zh").alias("name"), F.col("ord").alias("rank"))


@query(NAMES + """SELECT brand, brand IN (SELECT brand FROM skipped) AS skipped, (SELECT count(*) FROM todo t WHERE t.brand = b.brand) AS candidates, (SELECT count(*) FROM todo t WHERE t.brand = b.brand AND size % 2 = 0 AND contains(name, ' ') AND batch <= 1) AS names_added FROM (SELECT DISTINCT p_brand AS brand FROM part) b""")
def preparation_summary(spark, sf_dir):
    return preparation(spark, sf_dir)["summary"].select(F.col("novel_id").alias("brand"), "skipped", "candidates", "names_added")


@query("SELECT p_brand AS brand, p_name AS key, count(*) AS chapters FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size = 1) AND (p_brand, p_name) NOT IN (SELECT (p_brand, p_name) FROM part WHERE p_size > 40) GROUP BY ALL")
def idioms_to_render(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    counts = part.groupBy(F.col("p_brand").alias("novel_id"), F.col("p_name").alias("key")).agg(F.count("*").alias("chapters"))
    late = part.where("p_size > 40").select(F.col("p_brand").alias("novel_id"), F.col("p_name").alias("key"), "p_size")
    memory = late.where("p_size < 49").select("novel_id", "key", (F.col("p_size") % 3 == 0).alias("approved"), F.when(F.col("p_size") % 3 == 1, "chuan_bi").otherwise("dich").alias("source"), F.when(F.col("p_size") % 3 == 2, 1).otherwise(0).alias("uses"))
    out = N.unchecked_idioms(counts, memory, part.where("p_size = 1").select(F.col("p_name").alias("key")), late.where("p_size >= 49"))
    return out.withColumnRenamed("novel_id", "brand")


@query("""WITH t AS (SELECT o_custkey AS custkey, o_orderkey AS ord, CASE WHEN o_orderstatus = 'F' THEN 'forced' WHEN o_orderstatus = 'O' THEN 'ambiguous' ELSE 'hint' END AS kind, o_orderpriority || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ' = ' || o_orderkey END AS line FROM orders)
SELECT custkey, md5(concat_ws(chr(10), 'F:' || chr(10) || string_agg(line, chr(10) ORDER BY ord) FILTER (kind = 'forced') || chr(10), 'A:' || chr(10) || string_agg(line, chr(10) ORDER BY ord) FILTER (kind = 'ambiguous') || chr(10), 'H:' || chr(10) || string_agg(line, chr(10) ORDER BY ord) FILTER (kind = 'hint') || chr(10))) AS block_md5 FROM t GROUP BY custkey""")
def terms_blocks(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "forced").when(F.col("o_orderstatus") == "O", "ambiguous").otherwise("hint")
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("novel_id"), F.lit(1).alias("pos"), kind.alias("kind"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("zh"), F.when(kind != "hint", F.col("o_orderkey").cast("string")).alias("vi"))
    out = N.terms_block(found, {"forced": "F:", "ambiguous": "A:", "hint": "H:"})
    return out.select(F.col("novel_id").alias("custkey"), F.md5(F.col("block").cast("binary")).alias("block_md5"))


#: A book's pages out of documents.
BOOK = rf"""WITH c AS (SELECT source, doc_id, {FULL.format("text")} AS lines FROM documents),
l AS (SELECT source, doc_id, coalesce(regexp_replace(lines[1], '^\s+|\s+$', '', 'g'), '') AS title, list_transform(lines[2:], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS ps FROM c),
f AS (SELECT source, title, ps, min(doc_id) AS doc_id FROM l GROUP BY ALL),
e AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS t,
  array_to_string(list_transform(ps, lambda p: '<p>' || replace(replace(replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') || '</p>'), chr(10)) AS body FROM f),
b AS (SELECT source, printf('chap_%03d.xhtml', k) AS file_name, title, '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>' || t || '</title></head>' || chr(10) || '<body><h1>' || t || '</h1>' || chr(10) || body || chr(10) || '</body></html>' || chr(10) AS page FROM (SELECT e.*, f.title FROM e JOIN f USING (source, doc_id)))
"""


@query(BOOK + "SELECT source, file_name, md5(page) AS page_md5 FROM b")
def book_pages(spark, sf_dir):
    rows = as_novels(spark, sf_dir).withColumn("is_title_entry", F.lit(False))
    return N.book_pages(rows).select(F.col("novel_id").alias("source"), "file_name", F.md5(F.col("content").cast("binary")).alias("page_md5"))


@query(BOOK + "SELECT source, 'urn:' || source AS book_id, file_name, md5(title) AS title_md5, md5(page) AS page_md5 FROM b")
def epub_books(spark, sf_dir):
    """All documents as books, a container for each source, read back."""
    pages = N.book_pages(as_novels(spark, sf_dir).withColumn("is_title_entry", F.lit(False)))
    place = f"{shared_folder(spark)}/books-{uuid.uuid4().hex}"
    books.write_books(pages, profiles_of(spark, sf_dir), place)
    out = books.read_books(spark, place)
    return out.select(F.col("file").alias("source"), "book_id", "file_name", F.md5(F.col("chapter").cast("binary")).alias("title_md5"), F.md5(F.col("content").cast("binary")).alias("page_md5"))


def profiles_of(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("novel_id")).distinct()
    return sources.select("novel_id", F.concat(F.lit("urn:"), "novel_id").alias("book_id"), F.upper("novel_id").alias("title"), F.lit("").alias("author"))


@query(BOOK + "SELECT source, 'urn:' || source AS book_id, upper(source) AS title, count(*) AS pages, sum(strlen(page))::BIGINT AS bytes FROM b GROUP BY source")
def book_manifests(spark, sf_dir):
    pages = N.book_pages(as_novels(spark, sf_dir).withColumn("is_title_entry", F.lit(False)))
    return N.book_manifest(pages, profiles_of(spark, sf_dir)).select(F.col("novel_id").alias("source"), "book_id", "title", "pages", "bytes")


@query(r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]*$', ''), '[^a-zA-Z0-9_.-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), ''), 'novel') || '_' || left(sha256(url), 8) AS key FROM pages""")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.cache_key(F.col("url")).alias("key"))


SLUG = """(SELECT page_id, url, coalesce(nullif(array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '[^/]*$'), '(_[0-9]+)?[.]html?$', ''), '[-_ ]+'), lambda x: x <> ''), lambda x: upper(x[1]) || lower(x[2:])), ' '), ''), 'Truyen') AS slug,
regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^(www|m)[.]', '') AS site,
regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS path FROM pages)"""


@query(f"""WITH s AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN '/out/' ELSE '/base/' END AS folder, CASE WHEN page_id % 2 = 0 THEN 'A Book' ELSE slug END AS safe FROM {SLUG}),
r AS (SELECT *, folder || CASE WHEN (site, path, folder) IN (SELECT (site, path, folder) FROM s WHERE page_id % 4 = 1) THEN slug || '_raw.txt' ELSE slug || ' (' || site || ')_raw.txt' END AS raw FROM s)
SELECT page_id, raw, folder || regexp_extract(raw, '[^/]*$') || '.viet.txt' AS translated, folder || safe || '.epub' AS epub FROM r""")
def pipeline_paths(spark, sf_dir):
    """Of pages as requests; some have an older file of the same source, others one that belongs to another."""
    pages = table(spark, sf_dir, "pages")
    key, slug = F.col("page_id"), X.safe_name(X.guess_title(F.col("url")))
    folder = F.when(key % 3 == 0, "/out").otherwise("/base")
    asked = pages.select(F.col("page_id").alias("id"), F.col("url").alias("input"), F.when(key % 2 == 0, "A Book").alias("title"), F.when(key % 3 == 0, " /out ").alias("output_dir"))
    old = pages.where("page_id % 4 = 1").select(F.concat(folder, F.lit("/"), slug, F.lit("_raw.txt")).alias("path"), X.source_identity(F.col("url")).alias("identity"))
    other = pages.where("page_id % 4 = 2").select(F.concat(folder, F.lit("/"), slug, F.lit("_raw.txt")).alias("path"), F.lit("https://else/x").alias("identity"))
    out = N.pipeline_paths(asked, old.unionByName(other), "/base")
    return out.select(F.col("id").alias("page_id"), "raw", "translated", "epub")


@query("SELECT c_custkey AS custkey, '$' || printf('%.2f', c_acctbal) AS balance FROM customer")
def balance_texts(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), N.usd(F.col("c_acctbal")).alias("balance"))


# Whole jobs
JOB = rf"""WITH l AS (SELECT source, doc_id, {FULL.format("text")} AS lines FROM documents WHERE regexp_matches(text, '\S')),
h AS (SELECT source, list_transform(lines, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS lines, min(doc_id) AS doc_id, count(*) AS copies, bool_or(doc_id % 16 <> 15) AS done FROM l GROUP BY ALL),
g AS (SELECT *, sum((NOT done)::INT) OVER (PARTITION BY source ORDER BY doc_id) AS gap, len(lines) AS n FROM h),
o AS (SELECT *, lines IN (SELECT lines FROM g WHERE gap > 0 AND done) OR n % 3 <> 0 OR n % 2 = 0 AND n % 7 <> 0 AS made, n % 3 = 0 AND n % 2 = 0 AND n % 7 = 0 AS stop FROM g WHERE gap > 0),
p AS (SELECT *, sum((NOT made)::INT) OVER (PARTITION BY source ORDER BY doc_id) AS gap2 FROM o),
w AS (SELECT DISTINCT item_id % 2 AS k, unnest(regexp_extract_all(text, '[a-zA-Z]{{9,}}')) AS zh FROM benchmark),
t AS (SELECT source, doc_id, zh, row_number() OVER (PARTITION BY source, doc_id ORDER BY length(zh) DESC, zh) AS place FROM p JOIN w ON k = length(source) % 2 AND contains(array_to_string(lines, chr(10)), zh) WHERE gap2 = 0 AND length(zh) = 9),
a AS (SELECT source, count(*) AS total, sum(copies - 1)::BIGINT AS duplicates, count(*) FILTER (gap = 0) AS before FROM g GROUP BY source),
b AS (SELECT source, count(*) FILTER (gap2 = 0) AS written, count(*) FILTER (gap2 > 0 AND made) AS kept, count(*) FILTER (gap2 = 1 AND NOT made) AS failed, count(*) FILTER (gap2 > 1 AND NOT made) AS waiting, bool_or(gap2 = 1 AND NOT made AND stop) AS stop FROM p GROUP BY source),
u AS (SELECT source, count(*) AS unused FROM t WHERE place <= 300 GROUP BY source),
s AS (SELECT DISTINCT source FROM documents)
SELECT s.source, CASE WHEN total IS NULL THEN 'error' WHEN coalesce(failed, 0) = 0 THEN 'done' WHEN stop THEN 'stopped_balance' ELSE 'stopped' END AS status, coalesce(total, 0) AS total, coalesce(duplicates, 0) AS duplicates, coalesce(before, 0) AS before,
  coalesce(written, 0) AS written, coalesce(kept, 0) AS kept, coalesce(failed, 0) AS failed, coalesce(waiting, 0) AS waiting, coalesce(unused, 0) AS unused, coalesce((before + coalesce(written, 0) <> total)::BIGINT, 0) AS warnings, coalesce(before + coalesce(written, 0), 0) AS pages
FROM s LEFT JOIN a USING (source) LEFT JOIN b USING (source) LEFT JOIN u USING (source)"""


@query(JOB)
def novel_jobs(spark, sf_dir):
    """All documents as the chapters of their sources, one in sixteen not translated yet, carried on to books.

    A translated line is the letters of its digest. The first reply fails for each third number of lines; each second
    number has another reply, which for each seventh finds the account empty.
    """
    texts = table(spark, sf_dir, "documents").where(X.filled(F.col("text"))).select(F.col("source").alias("novel_id"), F.col("doc_id").alias("pos"), lines_of(F.col("text")).alias("paragraphs"))
    # Lines are cut and translated once; the job reads them many times.
    rows = cut(texts.withColumn("done", F.transform("paragraphs", lambda p: F.regexp_replace(F.sha2(p, 256), "[0-9]", ""))))
    chapters = rows.select("novel_id", "pos", F.lit("a title").alias("title"), "paragraphs", "done")
    translated = rows.where("pos % 16 <> 15").select("novel_id", "pos", F.lit("t").alias("title"), F.col("done").alias("paragraphs"))
    n = F.size("paragraphs")
    body = F.to_json(F.struct(F.lit("t").alias("title"), F.col("done").alias("paragraphs")))
    first = F.struct(F.lit(1).alias("attempt"), F.when(n % 3 == 0, 500).otherwise(200).alias("code"))
    second = F.when(n % 2 == 0, F.struct(F.lit(2).alias("attempt"), F.when(n % 7 == 0, 402).otherwise(200).alias("code")))
    answered = chapters.select(X.content_hash(F.col("title"), F.col("paragraphs")).alias("hash"), body.alias("body"), F.array_compact(F.array(first, second)).alias("tries"))
    replies = answered.select("hash", "body", F.inline("tries"))
    words = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 2).alias("k"), F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]{9,}"), F.lit(0))).alias("zh")).where(F.length("zh") == 9).distinct()
    novels = profiles_of(spark, sf_dir)
    terms = numbered(novels.join(words, (F.length("novel_id") % 2).cast("long") == F.col("k")).select("novel_id", "zh"), ["novel_id"], ["zh"], "ord")
    glossary = terms.select("novel_id", F.struct(F.lit(-1).cast("long").alias("pos"), "zh").alias("ord"), "zh", F.concat(F.lit("="), "zh").alias("vi"))
    cache = spark.createDataFrame([], "novel_id string, pos int, title string, paragraphs array<string>, source_hash string")
    stash = spark.createDataFrame([], "novel_id string, hash string, title string, paragraphs array<string>")
    common = spark.createDataFrame([], "word string")
    out = jobs.run_novels(chapters.drop("done"), translated, replies, cache, stash, glossary, common, novels, "0-9")["summary"]
    return out.drop("moved").withColumnRenamed("novel_id", "source")


# Streams
@query(r"""
WITH d AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, text, lang, regexp_extract(text, '[a-z]{6,12}') AS zh FROM documents WHERE regexp_matches(text, '\S')),
t AS (SELECT source, zh, min(pos) AS first, arg_min(lang, pos) AS lang FROM d WHERE zh <> '' GROUP BY source, zh),
u AS (SELECT d.source, d.pos, count(t.zh) AS n_used, md5(coalesce(string_agg(t.zh || ' = ' || upper(t.zh) || ' ' || upper(t.lang), chr(10) ORDER BY t.first), '')) AS used_md5
  FROM d LEFT JOIN t ON t.source = d.source AND t.first < d.pos AND contains(d.text, t.zh) GROUP BY ALL)
SELECT u.source AS novel_id, u.pos, n_used, used_md5, coalesce(t.zh, '') AS added FROM u LEFT JOIN t ON t.source = u.source AND t.first = u.pos""")
def streaming_glossary(spark, sf_dir):
    """All documents through the stateful stream in two runs: half of the events come first, with gaps everywhere.

    A chapter's reply is its text in capitals, and proposes the text's first word of 6 to 12 small letters as a term.
    """
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(place)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    docs = table(spark, sf_dir, "documents").where(X.filled(F.col("text"))).select(F.col("source").alias("novel_id"), "doc_id", "lang", "text")
    numbered_wide(docs, "novel_id", "doc_id").write.options(**E.ZSTD).parquet(f"{place}/numbered")
    dropped(spark)
    rows = spark.read.parquet(f"{place}/numbered")
    said = rows.select("novel_id", (F.col("number") - 1).alias("pos"), F.lit("").alias("title"), lines_of(F.col("text")).alias("paragraphs"), "lang", F.regexp_extract("text", "[a-z]{6,12}", 0).alias("zh"))
    named = F.when(F.col("zh") != "", F.create_map("zh", F.concat(F.upper("zh"), F.lit(" "), F.upper("lang"))))
    done = F.transform("paragraphs", F.upper)
    body = F.to_json(F.struct(F.upper("title").alias("title"), done.alias("paragraphs"), named.alias("new_terms")))
    replies = said.select("novel_id", "pos", F.lit(1).alias("attempt"), body.alias("body"))
    events = E.chapter_events(said).unionByName(E.reply_events(replies, "a-z"))
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(rows.select("novel_id").distinct().count(), 1))
    first = F.pmod(F.xxhash64("novel_id", "pos", "attempt"), F.lit(2)) == 0
    for part, read in ((first, []), (~first, ["numbered"])):
        events.where(part).write.mode("append").options(**E.ZSTD).parquet(f"{place}/in")
        dropped(spark, *[f"{place}/{step}" for step in read])
        out = E.run(spark, f"{place}/in", f"{place}/out", f"{place}/state", tasks=tasks)
        # What the stream has committed it doesn't read again.
        dropped(spark, f"{place}/in")
    used = F.from_json("used", "map<string,string>")
    lines = F.transform(F.map_entries(used), lambda x: F.concat(x["key"], F.lit(" = "), x["value"]))
    return out.select("novel_id", "pos", F.size(used).cast("long").alias("n_used"), F.md5(F.array_join(lines, "\n").cast("binary")).alias("used_md5"), F.coalesce(F.try_element_at(F.map_keys(F.from_json("added", "map<string,string>")), F.lit(1)), F.lit("")).alias("added"))


def event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


@query("SELECT user_id, sum(value::DECIMAL(18,4))::DOUBLE AS spend, count(value) AS n FROM events GROUP BY user_id")
def streaming_spend(spark, sf_dir):
    out = stream.settled(stream.spend(event_stream(spark, sf_dir).where("value IS NOT NULL").withColumn("cost", F.col("value").cast("decimal(18,4)")), "user_id", "cost"))
    return out.select("user_id", F.col("spend").cast("double").alias("spend"), "n")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def streaming_progress(spark, sf_dir):
    return stream.settled(stream.progress(event_stream(spark, sf_dir), "user_id", "event_id", "event_type"))
