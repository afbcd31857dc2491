"""Acquired items of several sources as one shape, indexes of them by id, and insights shown with
the sources that support them. Items are variants."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.json_paths import walk
from .normalize import either, get

#: Where each source's items have their id, time, title and URL.
SOURCES = {
    "news": {"id": ("news_id",), "time": "date", "title": "title", "url": "url"},
    "twitter": {"id": ("tweet_post_id",), "time": "published_at", "title": "text", "url": "url"},
    "youtube": {"id": ("video_id",), "time": "video_info.publishtime", "title": "video_info.title", "url": "video_info.url"},
    "github": {"id": ("url", "title"), "time": "published_at", "title": "title", "url": "url"},
    "huggingface": {"id": ("url", "title"), "time": "published_at", "title": "title", "url": "url"},
}
TITLE_CHARS = 160  # of texts that serve as titles
#: Fields of a record that may hold its title, its URL, its ids.
TITLES = ("title", "name", "news_title", "paper_title")
URLS = ("url", "link", "html_url")
IDS = ("source_id", "id", "news_id", "paper_id", "scholar_id", "institution_id", *URLS)
ZONE = "+08:00"  # of times that name none


@F.pandas_udf(StringType())
def sorted_json(s: pd.Series) -> pd.Series:
    """Keys sorted, a space after commas and colons; null stays null."""
    return s.map(lambda t: json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True), na_action="ignore")


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


def instant(c: Column, zone: str = ZONE) -> Column:
    """An ISO date or time as a timestamp, null where it is none; ``zone`` where it names none."""
    t = F.trim(c)
    full = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit("T00:00:00"))).otherwise(t)
    zoned = F.when(full.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), full).otherwise(F.concat(full, F.lit(zone)))
    return F.when(full.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), zoned.try_cast("timestamp"))


def by_source(df: DataFrame, source: str, made) -> Column:
    """``made(rule)`` of each row's source."""
    out = None
    for name, rule in SOURCES.items():
        here = F.col(source) == name
        out = F.when(here, made(rule)) if out is None else out.when(here, made(rule))
    return out


def scope_items(df: DataFrame, source: str = "source", item: str = "item") -> DataFrame:
    """source, source_id, title, published_at, url, data. The id is the source's own, else 16
    digits of the SHA-256 of the item as sorted JSON; blank titles and URLs are null."""
    text = lambda path: F.nullif(F.trim(get(item, path)), F.lit(""))
    own = by_source(df, source, lambda r: F.nullif(F.try_variant_get(either(*r["id"], of=item) if len(r["id"]) > 1 else get(item, r["id"][0], "variant"), "$", "string"), F.lit("")))
    title = by_source(df, source, lambda r: F.substring(text(r["title"]), 1, TITLE_CHARS) if r["title"] == "text" else text(r["title"]))
    named = df.withColumn("_own", own)
    hashed = F.substring(F.sha2(sorted_json(F.to_json(F.col(item))), 256), 1, 16)
    mark = F.concat(F.col(source), F.lit(":"))
    shape = lambda rows, name: rows.select(F.col(source).alias("source"), F.concat(mark, name).alias("source_id"), title.alias("title"), by_source(df, source, lambda r: instant(get(item, r["time"]))).alias("published_at"), by_source(df, source, lambda r: text(r["url"])).alias("url"), F.col(item).alias("data"))
    # only rows without an id of their own go through Python
    return shape(named.filter("_own is not null"), F.col("_own")).unionByName(shape(named.filter("_own is null"), hashed))


def source_index(items: DataFrame, order: list[str], strict: bool = False) -> DataFrame:
    """source_id, source, title, url of the last item of each id, blank where absent; strict: an
    item without title or URL isn't one. Aggregated, so a repeated id is no burden."""
    clean = lambda c: F.coalesce(F.trim(c), F.lit("")).alias(c)
    rows = items.select(*(clean(c) for c in ("source_id", "source", "title", "url")), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order))).filter("source_id <> ''")
    if strict:
        rows = rows.filter("title <> '' and url <> ''")
    at = [f"_o{i}" for i in range(len(order))]
    last = rows.groupBy("source_id").agg(F.max(F.struct(*at, "source", "title", "url")).alias("x"))
    return last.select("source_id", "x.source", "x.title", "x.url")


def evidence_texts(items: DataFrame, order: list[str]) -> DataFrame:
    """source_id, evidence: data, published_at and title of the last item as sorted JSON, folded."""
    shown = F.to_json(F.struct("data", "published_at", "title"), {"ignoreNullFields": "false"})
    last = items.filter("trim(source_id) <> ''").groupBy(F.trim("source_id").alias("source_id")).agg(F.max_by(shown, F.struct(*order)).alias("j"))
    return last.select("source_id", casefold(sorted_json("j")).alias("evidence"))


def clean_text(c: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def identifier(c: Column) -> Column:
    """White space collapsed, no slashes at the end, lower case."""
    return F.lower(F.regexp_replace(clean_text(c), "/+$", ""))


def with_link(c: Column) -> Column:
    """The identifier, and what follows a colon from ``http`` on."""
    return F.when(c.contains(":http"), F.array(c, F.substring(c, F.instr(c, "http"), F.length(c)))).otherwise(F.array(c))


def _text(value) -> str:
    return " ".join(value.split()) if isinstance(value, str) else ""


def nested_records(df: DataFrame, order: str, json_col: str) -> DataFrame:
    """(order, place, identifier, title, url) of every object at any depth that has a title or a
    URL, one row an identifier, objects before what they hold. Texts that aren't JSON give none.
    The depth is free, so this walks in Python, by Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, raw in zip(batch["k"], batch["j"]):
                try:
                    document = json.loads(raw)
                except (TypeError, ValueError):
                    continue
                for place, (_, _, value) in enumerate(walk(document)):
                    if isinstance(value, dict):
                        title, url = (next(filter(None, (_text(value.get(f)) for f in fields)), "") for fields in (TITLES, URLS))
                        if title or url:
                            ids = dict.fromkeys(filter(None, (_text(value.get(f)) for f in IDS)))
                            rows += [(k, place, i, title, url) for i in ids]
            yield pd.DataFrame(rows, columns=["k", "place", "identifier", "title", "url"])

    kind = df.schema[order].dataType.simpleString()
    found = df.select(F.col(order).alias("k"), F.col(json_col).alias("j")).mapInPandas(run, f"k {kind}, place long, identifier string, title string, url string")
    return found.withColumn("identifier", F.explode(with_link(identifier(F.col("identifier"))))).filter("identifier <> ''").withColumnRenamed("k", order)


def record_index(records: DataFrame, order: list[str]) -> DataFrame:
    """identifier, title, url: for each, the first that isn't blank."""
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.struct(*order))), F.lit("")).alias(c)
    # min_by skips null orders, so blank ones never win
    return records.groupBy("identifier").agg(first("title"), first("url"))


def public_insights(insights: DataFrame, index: DataFrame) -> DataFrame:
    """insights: insight_id, title, thesis, external_support (array of source_id, id, title, url).
    insight_id, title, content, sources: those with a title and a URL, of their own, else of the
    index, else (URL) of the source id; one of each URL, in order."""
    own = lambda f: clean_text(F.col(f"r.{f}"))
    refs = insights.select("insight_id", F.posexplode("external_support").alias("pos", "r"))
    keys = F.flatten(F.array(*(with_link(identifier(F.col(f"r.{f}"))) for f in ("source_id", "url", "id"))))
    wanted = refs.select("insight_id", "pos", F.posexplode(keys).alias("place", "identifier")).filter("identifier <> ''")
    found = wanted.join(index, "identifier").groupBy("insight_id", "pos").agg(*(F.min_by(c, F.when(F.col(c) != "", F.col("place"))).alias(f"found_{c}") for c in ("title", "url")))
    sid = own("source_id")
    linked = F.when(sid.contains("http"), F.substring(sid, F.instr(sid, "http"), F.length(sid)))
    blank = lambda c: F.nullif(c, F.lit(""))
    full = refs.join(found, ["insight_id", "pos"], "left").select("insight_id", "pos", F.coalesce(blank(own("title")), "found_title").alias("title"), F.coalesce(blank(own("url")), "found_url", linked).alias("url"))
    kept = full.filter("title is not null").withColumn("same", identifier(F.col("url"))).filter("same <> ''")
    one = kept.groupBy("insight_id", "same").agg(F.min(F.struct("pos", "title", "url")).alias("x"))
    listed = one.groupBy("insight_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"))).alias("sources"))  # an insight's own references
    none = F.array().cast("array<struct<title:string,url:string>>")
    return insights.join(listed, "insight_id", "left").select(clean_text(F.col("insight_id")).alias("insight_id"), clean_text(F.col("title")).alias("title"), clean_text(F.col("thesis")).alias("content"), F.coalesce("sources", none).alias("sources"))


def envelope_headers(items: DataFrame, order: str) -> DataFrame:
    """source, total, trace_id (the last one) of every source that has items."""
    return items.filter("data is not null").groupBy("source").agg(F.count("*").alias("total"), F.max_by("trace_id", F.when(F.col("trace_id") != "", F.col(order))).alias("trace_id"))


def write_filtered(items: DataFrame, path: str) -> DataFrame:
    """Kept items as JSON lines in a folder of each source, however many; none at all is an
    error. Returns what was written."""
    items.filter("data is not null").select("source", "source_id", F.to_json("data").alias("data")).write.partitionBy("source").mode("overwrite").json(path)
    written = items.sparkSession.read.schema("source_id string, data string, source string").json(path)
    if written.isEmpty():
        raise ValueError("no source has items")
    return written


def preview(df: DataFrame, order: list, rows: int = 10) -> DataFrame:
    """The first rows and the number of all."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).limit(rows).join(total, how="cross")  # total is one row
