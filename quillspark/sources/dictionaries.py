"""Dictionary sources: each reader turns a text or JSON table into rows of words or readings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X


def _first_part(c: Column, marks: str) -> Column:
    parts = F.filter(F.transform(F.split(c, marks), X.strip), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last in order."""
    top = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_r"))
    return top.select(key, "_r.*")


def cvdict_text(lines: DataFrame) -> DataFrame:
    """(word, meaning) from lines (n, value) "trad simp [pinyin] /m1/m2/".

    The first meaning, or the longest where the first has under 3 characters. The key is the traditional form if it
    differs, else the simplified; the last line of a key counts.
    """
    pattern = r"^(\S+)\s+(\S+)\s+\[[^\]]*\]\s+(/.+/)\s*$"
    rows = lines.where(F.col("value").rlike(pattern) & ~F.col("value").startswith("#"))
    trad, simp = F.regexp_extract("value", pattern, 1), F.regexp_extract("value", pattern, 2)
    meanings = F.filter(F.transform(F.split(F.regexp_extract("value", pattern, 3), "/"), X.strip), lambda m: m != "")
    longest = F.aggregate(meanings, F.lit(""), lambda best, m: F.when(F.length(m) > F.length(best), m).otherwise(best))
    rows = rows.select("n", F.when(trad != simp, trad).otherwise(simp).alias("word"), meanings.alias("m"), longest.alias("longest")).where(F.size("m") > 0)
    meaning = F.when((F.length(F.col("m")[0]) < 3) & (F.size("m") > 1), F.col("longest")).otherwise(F.col("m")[0])
    return last_wins(rows.select("n", "word", meaning.alias("meaning")), "word", "n").select("word", "meaning")


def cvdict_json(docs: DataFrame) -> DataFrame:
    """(word, meaning) from JSON objects {word: {trad, definition}} in column value."""
    entries = docs.select(F.explode(F.from_json("value", "map<string,struct<trad:string,pinyin:string,definition:string>>")).alias("word", "e"))
    word = F.when((F.coalesce("e.trad", F.lit("")) != "") & (F.col("e.trad") != F.col("word")), F.col("e.trad")).otherwise(F.col("word"))
    return entries.select(word.alias("word"), _first_part(F.coalesce("e.definition", F.lit("")), "[;/]").alias("meaning")).where("meaning != ''")


def readings_csv(rows: DataFrame) -> DataFrame:
    """(ch, readings) from rows (char, hanviet), hanviet a list literal; readings sorted by length, then text."""
    each = rows.select(F.col("char").alias("ch"), F.explode(F.regexp_extract_all("hanviet", F.lit("['\"]([^'\"]+)['\"]"), F.lit(1))).alias("r"))
    return merged_readings([each])


def merged_readings(tables: list[DataFrame]) -> DataFrame:
    """(ch, readings) from tables (ch, r): the union, sorted by length, then text."""
    each = reduce(DataFrame.unionByName, tables).select("ch", X.strip(F.lower("r")).alias("r")).where("r != ''")
    sets = each.groupBy("ch").agg(F.array_sort(F.transform(F.collect_set("r"), lambda r: F.struct(F.length(r).alias("n"), r.alias("r")))).alias("s"))
    return sets.select("ch", F.transform("s", lambda x: x["r"]).alias("readings"))


def cognates_tsv(rows: DataFrame) -> DataFrame:
    """(word, meaning) from a table with columns word and meaning, or by place (3rd and 7th) without them."""
    names = [c.lower() for c in rows.columns]
    word = rows.columns[names.index("word") if "word" in names else min(2, len(names) - 1)]
    meaning = rows.columns[names.index("meaning") if "meaning" in names else min(6, len(names) - 1)]
    return rows.select(X.strip(F.col(word)).alias("word"), _first_part(F.coalesce(F.col(meaning), F.lit("")), "/").alias("meaning")).where("word != '' AND meaning != ''")


def key_values(lines: DataFrame) -> DataFrame:
    """(key, value) of lines "key=value", with their n if they have one; comments and lines without = are left out."""
    line = X.strip(F.col("value"))
    place = [c for c in lines.columns if c == "n"]
    rows = lines.where(~line.startswith("#") & line.contains("=")).select(*place, F.split(line, "=", 2).alias("p"))
    return rows.select(*place, X.strip(F.col("p")[0]).alias("key"), X.strip(F.col("p")[1]).alias("value")).where("key != ''")


def phrases(lines: DataFrame) -> DataFrame:
    """(word, meaning) of lines "word=meaning/...", with their n if they have one."""
    place = [c for c in lines.columns if c == "n"]
    return key_values(lines).select(*place, F.col("key").alias("word"), _first_part(F.col("value"), "/").alias("meaning")).where("meaning != ''")


def hsk_json(docs: DataFrame) -> DataFrame:
    """(ch, r): readings of a JSON array of objects with aliased keys, split at , / ; and |."""
    kinds = "array<struct<hanzi:string,character:string,word:string,sinoViet:string,hanviet:string,sino:string>>"
    rows = docs.select(F.explode(F.from_json("value", kinds)).alias("e"))
    readings = F.split(F.coalesce("e.sinoViet", "e.hanviet", "e.sino", F.lit("")), r"[,/;|]")
    return rows.select(F.coalesce("e.hanzi", "e.character", "e.word").alias("ch"), F.explode(readings).alias("r")).select("ch", X.strip(F.col("r")).alias("r")).where("ch IS NOT NULL AND r != ''")


def glossary_lines(lines: DataFrame) -> DataFrame:
    """(zh, vi) of lines "zh: vi" (n, value); blank lines are skipped, the last line of a term counts."""
    rows = lines.where(F.col("value").contains(":")).select("n", F.split("value", ":", 2).alias("p"))
    rows = rows.select("n", X.strip(F.col("p")[0]).alias("zh"), X.strip(F.col("p")[1]).alias("vi")).where("zh != '' AND vi != ''")
    return last_wins(rows, "zh", "n").select("zh", "vi")


def variants(idioms: DataFrame) -> DataFrame:
    """(key, vi, canonical): a row for the simplified and one for the traditional form, where they differ."""
    rows = idioms.select(F.explode(F.array_distinct(F.array("simp", "trad"))).alias("key"), "vi", F.col("trad").alias("canonical"))
    return rows.groupBy("key").agg(F.min_by(F.struct("vi", "canonical"), "canonical").alias("m")).select("key", "m.*")


#: Marks of an idiom in a word's meaning, the least meaning of a listed word, lengths of long idioms.
MARKS, LONG_MARKS = ["thành ngữ", "tục ngữ", "ca dao", "câu đối", "ngạn ngữ", "cổ ngữ"], ["thành ngữ", "tục ngữ", "câu đối", "ngạn ngữ"]
LEAST_MEANING, LONG = 3, (8, 12)


def is_idiom(word: Column, meaning: Column, listed: Column) -> Column:
    """Whether a dictionary's word is an idiom, by its meaning and by whether a phrase list has it.

    Four Han characters whose meaning bears a mark in brackets, or that are listed with a meaning of three characters;
    or 8 to 12 that are listed, bear a mark, and have no ASCII letter or digit in their meaning. All marks hold ASCII
    letters, so by that last rule no long word passes. Nulls are no idioms.
    """
    han = lambda low, high: word.rlike(f"^[\\x{{4e00}}-\\x{{9fff}}]{{{low},{high}}}$")
    marked = lambda marks: F.lower(meaning).rlike(f"\\(({'|'.join(marks)})\\)")
    four = han(4, 4) & (marked(MARKS) | (listed & (F.length(X.strip(meaning)) >= LEAST_MEANING)))
    return F.coalesce(four, F.lit(False)) | F.coalesce(han(*LONG) & listed & marked(LONG_MARKS) & ~meaning.rlike("[0-9a-zA-Z]"), F.lit(False))


def idioms_built(glossary: DataFrame, phrases: DataFrame, forms: DataFrame) -> dict[str, DataFrame]:
    """canonical (canonical, vi, simp, trad) and keys (key, vi): the idioms of a glossary under both their forms.

    glossary(n, word, meaning) in the order of n, of a repeated word the first place and the last meaning; phrases(word)
    are the listed ones; forms(word, simp, trad), words without a row have one form. The canonical form is the
    traditional one, its first idiom counts. A key is either form; where idioms share one, the later counts.
    """
    words = glossary.groupBy("word").agg(F.min("n").alias("n"), F.max_by("meaning", "n").alias("vi"))
    listed = phrases.select("word").distinct().withColumn("listed", F.lit(True))
    both = forms.groupBy("word").agg(F.min(F.struct("simp", "trad")).alias("f")).select("word", "f.simp", "f.trad")
    rows = words.join(listed, "word", "left").where(is_idiom(F.col("word"), F.col("vi"), F.coalesce("listed", F.lit(False)))).join(both, "word", "left")
    rows = rows.select("n", "vi", F.coalesce("simp", "word").alias("simp"), F.coalesce("trad", "word").alias("trad"), "word")
    rows = rows.withColumn("canonical", F.when(F.col("trad") != F.col("simp"), F.col("trad")).otherwise(F.col("word")))
    first = rows.groupBy("canonical").agg(F.min_by(F.struct("n", "vi", "simp", "trad"), "n").alias("m")).select("canonical", "m.*")
    keys = first.select("n", "vi", F.explode(F.array_distinct(F.array("simp", "trad"))).alias("key")).groupBy("key").agg(F.max_by("vi", "n").alias("vi"))
    return {"canonical": first.drop("n"), "keys": keys}


def priority_union(tables: list[DataFrame], fallback: DataFrame | None = None, key: str = "word") -> DataFrame:
    """(word, meaning, source): later tables replace earlier ones, the fallback only fills gaps."""
    ranked = [t.select(key, "meaning", F.lit(i + 1).alias("source")) for i, t in enumerate(tables)]
    if fallback is not None:
        ranked.append(fallback.select(key, "meaning", F.lit(0).alias("source")))
    union = reduce(DataFrame.unionByName, ranked)
    return union.groupBy(key).agg(F.max(F.struct("source", "meaning")).alias("m")).select(key, "m.meaning", "m.source")


def built(sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """words (word, meaning, source) and chars (ch, readings) of a whole dictionary, from those raw sources that are given.

    Words, each overwriting those before it: `cvdict` lines (n, value), `cognates` rows, `phrases` lines (n, value), `json`
    objects (value), `crawled` and `seeds` (word, meaning); `glossary` (word, meaning) only fills gaps and is source 0.
    Readings are united: `csv` rows (char, hanviet), `readings` lines (value) "character=reading", `hsk` arrays (value).
    Blank words and meanings are left out; of one source's rows of a word the greatest meaning counts where they have
    no order of their own.
    """
    readers = {"cvdict": cvdict_text, "cognates": cognates_tsv, "phrases": lambda t: last_wins(phrases(t), "word", "n"), "json": cvdict_json, "crawled": None, "seeds": None}
    tables = [(i + 1, readers[n](sources[n]) if readers[n] else sources[n]) for i, n in enumerate(readers) if n in sources]
    if "glossary" in sources:
        tables.append((0, sources["glossary"]))
    ranked = reduce(DataFrame.unionByName, [t.select("word", "meaning", F.lit(i).alias("source")) for i, t in tables])
    ranked = ranked.where((X.strip(F.col("word")) != "") & (X.strip(F.col("meaning")) != ""))
    words = ranked.groupBy("word").agg(F.max(F.struct("source", "meaning")).alias("m")).select("word", "m.meaning", "m.source")
    split = {
        "csv": lambda t: readings_csv(t).select("ch", F.explode("readings").alias("r")),
        "readings": lambda t: key_values(t).select(F.col("key").alias("ch"), F.col("value").alias("r")),
        "hsk": hsk_json,
    }
    chars = [read(sources[n]).select("ch", "r") for n, read in split.items() if n in sources]
    return {"words": words} | ({"chars": merged_readings(chars)} if chars else {})


def inspected(sources: dict[str, DataFrame], n: int = 5) -> DataFrame:
    """(source, lines, samples): how many lines with text a source (n, value) has, and its first ones, 120 characters each.

    Comments (#) don't count. Each source is counted and its first lines are picked on their own, so nothing is gathered.
    """
    out = []
    for name, rows in sources.items():
        lines = rows.where(~F.col("value").startswith("#") & (X.strip(F.col("value")) != ""))
        first = lines.orderBy("n").limit(n).agg(F.array_sort(F.collect_list(F.struct("n", F.substring("value", 1, 120).alias("v")))).alias("s"))
        counted = lines.agg(F.count("*").alias("lines"))
        out.append(counted.join(first, F.lit(True)).select(F.lit(name).alias("source"), "lines", F.transform("s", lambda x: x["v"]).alias("samples")))
    return reduce(DataFrame.unionByName, out)
