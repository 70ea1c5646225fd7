"""Aggregations over an event log: counts, distinct users, windows in time, health and rates."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Numbers of days of the usual ranges, which end with the last day.
PRESETS = (1, 7, 30, 90)


@dataclass(frozen=True)
class Filter:
    """A range of time and a page; wrong ones are refused before a job is built."""

    start: datetime | None = None
    end: datetime | None = None
    limit: int = 50
    offset: int = 0

    def __post_init__(self):
        if self.start is not None and self.end is not None and self.start > self.end:
            raise ValueError("start must not be later than end")
        if not 1 <= self.limit <= 365 or self.offset < 0:
            raise ValueError("limit must be from 1 to 365, offset not negative")

    def of(self, ts: str) -> Column:
        return in_window(ts, self.start, self.end)


def in_window(ts: str, start, end) -> Column:
    """Both ends count; a missing end is open."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(ts) >= F.lit(start))
    if end is not None:
        cond = cond & (F.col(ts) <= F.lit(end))
    return cond


def trailing_distinct(log: DataFrame, key: str, ts: str, days: tuple[int, ...] = (1, 7, 30), names: tuple[str, ...] = ("dau", "wau", "mau")) -> DataFrame:
    """Distinct keys in trailing windows that end at the last time of the log, all in one pass."""
    anchor = log.agg(F.max(ts).alias("anchor"))
    own = log.select(key, ts).where(F.col(key).isNotNull())
    cols = [F.countDistinct(F.when(F.col(ts) >= F.col("anchor") - F.expr(f"INTERVAL {d} DAYS"), F.col(key))).alias(n) for d, n in zip(days, names, strict=True)]
    return own.join(F.broadcast(anchor)).agg(*cols)  # anchor is one row


def daily(log: DataFrame, ts: str, *aggs: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates by UTC day; days without rows are left out."""
    return log.groupBy(F.to_date(ts).alias("day"), *keys).agg(*aggs)


def with_gaps_filled(series: DataFrame, day: str, value: str) -> DataFrame:
    """A daily series with 0 for the days between its ends that it lacks."""
    days = series.agg(F.explode(F.sequence(F.min(day), F.max(day))).alias(day))
    return days.join(series, day, "left").select(day, F.coalesce(value, F.lit(0)).alias(value))


def ratio(part: Column, whole: Column, digits: int = 2) -> Column:
    """part of whole in percent; 0 where there is no whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole * 100, digits))


def health(failed: Column, attempts: Column) -> Column:
    """unavailable from a rate of 0.5, degraded from 0.2; healthy without attempts."""
    rate = failed / attempts
    return F.when(attempts == 0, "healthy").when(rate >= 0.5, "unavailable").when(rate >= 0.2, "degraded").otherwise("healthy")


def service(event_type: Column, category: Column, fallback: str | None = None) -> Column:
    """The service that an event belongs to by the start of its type; else fallback, or the category in lower case."""
    out = F.lit(fallback) if fallback else F.lower(category)
    for prefix, name in (("document.", "documents"), ("chat.", "chat"), ("security.", "security"), ("auth.", "authentication")):
        out = F.when(event_type.startswith(prefix), name).otherwise(out)
    return out


def response_times(messages: DataFrame) -> DataFrame:
    """conversation_id, turn, seconds: for each answer whose message before it is a question; negative times are dropped."""
    spoken = messages.where(F.col("role").isin("user", "assistant"))
    w = Window.partitionBy("conversation_id").orderBy("created_s", "turn")
    paired = spoken.withColumns({"before": F.lag("role").over(w), "asked": F.lag("created_s").over(w)})
    good = (F.col("role") == "assistant") & (F.col("before") == "user") & (F.col("created_s") >= F.col("asked"))
    return paired.where(good).select("conversation_id", "turn", (F.col("created_s") - F.col("asked")).alias("seconds"))


def last_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of the ordered rows."""
    if offset < 0 or not 1 <= limit <= 365:
        raise ValueError("offset must not be negative and limit must be from 1 to 365")
    return df.orderBy(*order).offset(offset).limit(limit)


def printed(value: Column, kind: str) -> Column:
    """A value as reports print it: N/A, Yes or No, two decimals, ISO times."""
    if kind in ("double", "float"):
        shown = F.format_string("%.2f", value)
    elif kind == "boolean":
        shown = F.when(value, "Yes").otherwise("No")
    elif kind.startswith("timestamp"):
        shown = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    else:
        shown = value.cast("string")
    return F.when(value.isNull(), "N/A").otherwise(shown)


def humanised(key: Column) -> Column:
    """A key of words joined by underscores as a label."""
    return F.initcap(F.trim(F.replace(key, F.lit("_"), F.lit(" "))))


def json_list(text: Column) -> Column:
    """A JSON list of strings; an empty one where there is none or it can't be read."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def json_number(text: Column, path: str) -> Column:
    """A number in JSON; null where there is none, or a boolean or a text in its place."""
    found = F.try_variant_get(F.try_parse_json(text), path, "variant")
    kind = F.schema_of_variant(found)
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(F.try_parse_json(text), path, "double"))


def within(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, seconds: int) -> DataFrame:
    """Pairs of rows of a key of which the right one comes after the left, at most so many seconds later.

    Times are cut in spans of that length, so that a row meets those of two spans of its key only, however many the key has.
    """
    span = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    a = left.withColumn("_span", F.explode(F.array(span(left_at), span(left_at) + 1)))
    b = right.withColumn("_span", span(right_at))
    gap = F.unix_micros(F.col(right_at).cast("timestamp")) - F.unix_micros(F.col(left_at).cast("timestamp"))
    return a.join(b, [key, "_span"]).where((gap > 0) & (gap <= seconds * 1_000_000)).drop("_span")
