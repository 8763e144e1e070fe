"""Costs and usage: estimates by characters, prices of tokens, running spend and peak hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.tables import numbered, running

# USD for a source character, USD for a million tokens, factors of the reasoning setting.
RATES = {"low": 3.9e-6, "average": 4.4e-6, "high": 5.7e-6}
PRICES = {"prompt_cache_hit_tokens": 0.003, "prompt_cache_miss_tokens": 0.15, "completion_tokens": 0.6}
FACTORS = {"low": 0.95, "medium": 1.0, "high": 1.0, "max": 1.2}
NO_THINKING, PEAK = 0.25, 2.0


def reasoning_factor(effort: Column, thinking: Column) -> Column:
    out = F.lit(1.0)
    for name, value in FACTORS.items():
        out = F.when(F.lower(effort) == name, F.lit(value)).otherwise(out)
    return F.when(thinking, out).otherwise(F.lit(NO_THINKING))


def costs(chars: Column, factor: Column, peak: Column) -> Column:
    """A struct of the low, average and high cost."""
    times = factor * F.when(peak, F.lit(PEAK)).otherwise(F.lit(1.0))
    return F.struct(*[(chars * F.lit(rate) * times).alias(name) for name, rate in RATES.items()])


def usage_cost(usage: dict[str, Column], peak: Column | None = None) -> Column:
    """USD of one usage row; counts that are missing or not numbers cost nothing."""
    total = F.lit(0.0)
    for name, price in PRICES.items():
        if name in usage:
            total = total + F.coalesce(usage[name].try_cast("double"), F.lit(0.0)) / 1e6 * price
    return total if peak is None else total * F.when(peak, F.lit(PEAK)).otherwise(F.lit(1.0))


def estimate(chapters: DataFrame, translated: DataFrame, effort: str = "medium", thinking: bool = True, peak: bool = False, web_chapters: DataFrame | None = None) -> DataFrame:
    """A row for each novel: characters, those left after the translated chapters, and what both cost.

    chapters(novel_id, pos, chars), translated(novel_id, n), and web_chapters(novel_id, n) where a catalogue is longer
    than what was crawled: its missing chapters count with the average length, rounded half to even.
    """
    rows = numbered(chapters.select("novel_id", "pos", "chars"), ["novel_id"], ["pos"], "ord").join(translated.select("novel_id", F.col("n").alias("done")), "novel_id", "left")
    sums = rows.groupBy("novel_id").agg(F.count("*").alias("crawled"), F.sum("chars").alias("chars"), F.sum(F.when(F.col("ord") > F.coalesce("done", F.lit(0)), F.col("chars")).otherwise(0)).alias("left"), F.max(F.coalesce("done", F.lit(0))).alias("done"))
    if web_chapters is not None:
        sums = sums.join(web_chapters.select("novel_id", F.col("n").alias("web")), "novel_id", "left")
    else:
        sums = sums.withColumn("web", F.lit(None).cast("long"))
    total = F.greatest(F.col("crawled"), F.coalesce("web", F.lit(0)))
    more = F.bround(F.col("chars") / F.col("crawled") * (total - F.col("crawled"))).cast("long")
    factor = reasoning_factor(F.lit(effort), F.lit(thinking))
    return sums.select(
        "novel_id", total.alias("chapters"), F.least(F.greatest(F.col("done"), F.lit(0)), total).alias("translated_chapters"), (F.col("chars") + more).alias("total_chars"), (F.col("left") + more).alias("remaining_chars"),
        costs(F.col("chars") + more, factor, F.lit(peak)).alias("cost_total"), costs(F.col("left") + more, factor, F.lit(peak)).alias("cost_remaining"),
    )


def running_cost(events: DataFrame, group: list[str], order: list[str], cost: str = "cost") -> DataFrame:
    """spend: the cost so far within a group, in order."""
    return running(events, group, order, {"spend": ("sum", F.col(cost))})


def at_peak(events: DataFrame, holidays: DataFrame, ts: str = "ts") -> DataFrame:
    """peak: Beijing working hours, holidays(day) apart."""
    day = F.to_date(F.from_utc_timestamp(F.col(ts), "Asia/Shanghai"))
    free = holidays.select(F.col("day").alias("_day")).distinct()
    return events.join(free, day == F.col("_day"), "left").withColumn("peak", X.peak_hour(F.col(ts)) & F.col("_day").isNull()).drop("_day")


def next_offpeak(events: DataFrame, holidays: DataFrame, ts: str = "ts") -> DataFrame:
    """starts: when work may start, now or at the end of the peak window that a time falls in; holidays(day) have none."""
    local = F.from_utc_timestamp(F.col(ts), "Asia/Shanghai")
    end = F.when(F.hour(local) < 12, 12).otherwise(18)
    after = F.to_utc_timestamp(F.date_trunc("DAY", local) + F.make_dt_interval(F.lit(0), end), "Asia/Shanghai")
    return at_peak(events, holidays, ts).withColumn("starts", F.when(F.col("peak"), after).otherwise(F.col(ts))).drop("peak")


def catalogue_sample(catalog: DataFrame, picks: int = 3) -> DataFrame:
    """The entries at the start, middle and end of each catalogue by which its average length is estimated."""
    order, whole = Window.partitionBy("book_id").orderBy("ord"), Window.partitionBy("book_id")
    rows = catalog.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(whole))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    return rows.where(F.array_contains(F.transform(F.sequence(F.lit(0), F.lit(picks - 1)), lambda k: F.least(k * step, F.col("n") - 1)), F.col("i").cast("long"))).drop("i", "n")


def fresh(events: DataFrame, group: list[str], ts: str, ok: Column, good: int = 300, bad: int = 60) -> DataFrame:
    """hit: whether a lookup is answered by the one before it, within 300 s of a good and 60 s of a bad answer."""
    rows = running(events, group, [ts, "event_id"], {"_last": ("last", F.struct(F.unix_timestamp(ts).alias("at"), ok.alias("ok")))}, before=True)
    age = F.unix_timestamp(ts) - F.col("_last.at")
    return rows.withColumn("hit", F.coalesce(age <= F.when(F.col("_last.ok"), good).otherwise(bad), F.lit(False))).drop("_last")


def usage_from_log(line: Column) -> Column:
    """The counts of a [usage] log line as a struct of longs, null for other lines."""
    part = lambda name: F.regexp_extract(line, rf"\b{name}\s*[=:]\s*([0-9]+)", 1).try_cast("long")
    fields = {"prompt": "prompt_tokens", "hit": "prompt_cache_hit_tokens", "miss": "prompt_cache_miss_tokens", "completion": "completion_tokens"}
    return F.when(line.contains("[usage]"), F.struct(*[part(k).alias(v) for k, v in fields.items()]))


def usage_line(usage: dict[str, Column]) -> Column:
    """A [usage] log line; a missing miss count is what the prompt has beyond the hits."""
    get = lambda k: F.coalesce(usage.get(k, F.lit(None)).cast("long"), F.lit(0).cast("long"))
    miss = F.coalesce(usage.get("prompt_cache_miss_tokens", F.lit(None)).cast("long"), F.greatest(F.lit(0).cast("long"), get("prompt_tokens") - get("prompt_cache_hit_tokens")))
    total = F.coalesce(usage.get("total_tokens", F.lit(None)).cast("long"), get("prompt_tokens") + get("completion_tokens"))
    return F.concat(F.lit("[usage] prompt="), get("prompt_tokens"), F.lit(" hit="), get("prompt_cache_hit_tokens"), F.lit(" miss="), miss, F.lit(" completion="), get("completion_tokens"), F.lit(" total="), total)
