"""Recorded model responses: event streams, JSON replies and their repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X

REPLY = "struct<title:string,paragraphs:array<string>,new_terms:map<string,string>,idioms:map<string,string>>"
CHUNK = "struct<choices:array<struct<delta:struct<content:string>>>,usage:struct<prompt_tokens:bigint,prompt_cache_hit_tokens:bigint,prompt_cache_miss_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>>"


def event_streams(lines: DataFrame) -> DataFrame:
    """(response_id, body, usage) from lines (response_id, pos, line) of server-sent events.

    Only "data: " lines before the first [DONE] count; chunks that are not JSON are skipped; deltas are joined in
    order and the last usage stays.
    """
    data = lines.where(F.col("line").startswith("data: ")).withColumn("raw", X.strip(F.substring("line", 7, 1 << 30)))
    done = data.where("raw = '[DONE]'").groupBy("response_id").agg(F.min("pos").alias("done"))
    chunks = data.join(done, "response_id", "left").where("done IS NULL OR pos < done").withColumn("c", F.from_json("raw", CHUNK))
    parts = F.array_sort(F.collect_list(F.struct("pos", F.coalesce(F.try_element_at("c.choices", F.lit(1))["delta"]["content"], F.lit("")).alias("t"))))
    out = chunks.groupBy("response_id").agg(parts.alias("p"), F.max_by("c.usage", F.when(F.col("c.usage").isNotNull(), F.col("pos"))).alias("usage"))
    return out.select("response_id", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("body"), "usage")


def _unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))


#: A JSON string with its content as a group. No part gives back what it took, so that its length costs no stack.
STRING = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
BLANK = r"[ \t\r\n]*+"
#: The names under which a reply holds its new terms.
TERM_KEYS = ("new_terms", "new_names")


def _after(body: Column, key: str, mark: str, item: str) -> Column:
    """The run of whole items, parted by commas, after the first "key": and its opening mark; empty if there is none."""
    run = f"(?:{BLANK}{item}{BLANK},?+)*+".replace("([^", "(?:[^")
    return F.regexp_extract(body, f'(?s)"{key}"{BLANK}:{BLANK}{mark}({run})', 1)


def reply(body: Column) -> Column:
    """A reply as a struct: as JSON, else what a scan of its text gives for title, paragraphs and new terms (idioms are lost then).

    Null if no paragraphs can be found. The scan takes the whole strings of a section up to the place where the reply
    is cut off or broken; a string that is cut off is no paragraph. New terms stand under either of two names; the first
    section that has any counts.
    """
    def scanned(paragraphs: Column) -> Column:
        pair = f"{STRING}{BLANK}:{BLANK}{STRING}"
        sections = [F.nullif(_after(body, key, r"\{", pair), F.lit("")) for key in TERM_KEYS]
        pairs = X.let(F.coalesce(*sections, F.lit("")), lambda t: F.arrays_zip(*[F.transform(F.regexp_extract_all(t, F.lit(f"(?s){pair}"), F.lit(group)), _unescape).alias(name) for group, name in ((1, "k"), (2, "v"))]))
        terms = X.let(pairs, lambda p: F.map_from_entries(F.filter(F.transform(p, lambda x, i: F.when(~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["k"] == x["k"]), F.struct(x["k"].alias("key"), x["v"].alias("value")))), lambda x: x.isNotNull())))
        title = _unescape(F.regexp_extract(body, f'(?s)"title"{BLANK}:{BLANK}{STRING}', 1))
        return F.when(F.size(paragraphs) > 0, F.struct(title.alias("title"), paragraphs.alias("paragraphs"), terms.alias("new_terms"), F.create_map().cast("map<string,string>").alias("idioms")))

    def chosen(strict: Column) -> Column:
        whole = F.struct(strict["title"].alias("title"), strict["paragraphs"].alias("paragraphs"), F.coalesce(strict["new_terms"], strict["new_names"]).alias("new_terms"), strict["idioms"].alias("idioms"))
        strings = F.regexp_extract_all(_after(body, "paragraphs", r"\[", STRING), F.lit(f"(?s){STRING}"), F.lit(1))
        valid = strict["_corrupt_record"].isNull() & (F.size(strict["paragraphs"]) > 0)
        return F.when(valid, whole).otherwise(X.let(F.transform(strings, _unescape), scanned))

    return X.let(F.from_json(body, f"{REPLY[:-1]},new_names:map<string,string>,_corrupt_record:string>"), chosen)


def balance(body: Column) -> Column:
    """available, reason and the balances of an account reply, four texts for each currency."""
    kinds = "struct<is_available:boolean,balance_infos:array<struct<currency:string,total_balance:string,granted_balance:string,topped_up_balance:string>>>"
    b = F.from_json(body, kinds)
    fine = F.coalesce(b["is_available"], F.lit(False)) & (F.coalesce(F.size(b["balance_infos"]), F.lit(0)) > 0)
    return F.struct(fine.alias("available"), F.when(~fine, "no balance in the reply").alias("reason"), F.when(fine, b["balance_infos"]).alias("balances"))


def jobs(rows: DataFrame) -> DataFrame:
    """Job rows with the defaults of missing settings."""
    # The settings' defaults.
    defaults = {"model": "deepseek-flash", "reasoning_effort": "medium", "workers": 1, "avoid_peak": False, "style_detect": True, "thinking": True, "prepare": True, "epub": True, "pdf": False}
    return rows.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in rows.columns else F.lit(v) for k, v in defaults.items()})
