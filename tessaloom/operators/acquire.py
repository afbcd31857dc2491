"""Acquisition semantics: filters, windows of days, retrieval groups, sorting and paging."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_CAP = 50


def any_term(text: Column, terms: Iterable[str]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(F.lower(text), F.lit(t.lower()))
    return found


def topic_filter(df: DataFrame, columns: list[str], terms: Iterable[str]) -> DataFrame:
    """Rows whose columns, joined by spaces, hold any of the terms."""
    return df.filter(any_term(F.concat_ws(" ", *columns), terms))


def retrieval_filter(df: DataFrame, text: str, keywords: list[str] = (), entities: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """OR within a group, AND across groups, none of the excluded; an empty group asks nothing."""
    for group in (keywords, entities):
        if group:
            df = df.filter(any_term(F.col(text), group))
    return df.filter(~any_term(F.col(text), exclude)) if exclude else df


def exact_range(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """From a day on (whole days) up to an instant; rows without a time are skipped. The bound
    is written against the column itself, so that it reaches the scan."""
    return df.filter((F.col(ts) >= F.lit(start).cast("date").cast("timestamp")) & (F.col(ts) <= F.lit(end).cast("timestamp")))


def latest_on_or_before(df: DataFrame, ts: str, by: list[str], end: str) -> DataFrame:
    """Each group's rows of its last day up to an instant. The last day is a small aggregate,
    so no group is sorted."""
    fit = df.filter(F.col(ts) <= F.lit(end).cast("timestamp"))
    last = fit.groupBy(*by).agg(F.max(F.to_date(ts)).alias("_last"))
    return fit.join(last, by).filter(F.to_date(ts) == F.col("_last")).drop("_last")


SORTS = {"heat": ["heat", "total"], "index": ["heat", "total"], "citations": ["citation_count", "paper_count"], "paperCount": ["citation_count", "paper_count"], "publish_time": ["pub_date", "published_at"]}


def sort_rows(df: DataFrame, sort_type: str, position: str) -> DataFrame:
    """By the first truthy of the sort's columns, descending; ties, and unknown sorts, by
    position."""
    keys = [c for c in SORTS.get(sort_type, []) if c in df.columns]
    if not keys:
        return df.orderBy(position)
    number = sort_type != "publish_time"
    value = F.coalesce(*[F.nullif(F.col(c), F.lit(0 if number else "")) for c in keys], F.lit(0 if number else ""))
    return df.orderBy(value.desc(), F.col(position))


def page_slice(df: DataFrame, page: int = 1, size: int = 10) -> DataFrame:
    size = max(1, min(size, PAGE_CAP))
    return df.offset((max(1, page) - 1) * size).limit(size)


def search_page(df: DataFrame, columns: list[str], terms: list[str], order: list, page: int = 1, size: int = 10) -> DataFrame:
    """A page of the topic's rows in order, with the total before paging."""
    fit = topic_filter(df, columns, terms) if terms else df
    total = fit.agg(F.count("*").alias("total"))
    return page_slice(fit.orderBy(*order), page, size).join(total, how="cross")  # total is one row


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; Spark limits groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", rank).filter(F.col("_r") == 1).drop("_r")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_wins(df, keys, [F.col(c).desc() for c in order])


def scan_summary(df: DataFrame, source: str, page: str, page_cap: int) -> DataFrame:
    """Kept rows and pages by source; complete unless the page cap was met."""
    return df.groupBy(source).agg(F.count("*").alias("kept"), F.max(page).alias("pages"), (F.max(page) < page_cap).alias("scan_complete"))


def call_budget(requested: int, used: int, most: int) -> None:
    if used + requested > most:
        raise RuntimeError(f"call budget exceeded: {used + requested} of {most}")
