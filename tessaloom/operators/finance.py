"""Filings, facts and prices: nested JSON series to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HITS = "struct<hits: struct<total: struct<value: long>, hits: array<struct<_id: string, _source: struct<ciks: array<string>, display_names: array<string>, form: string, file_date: string>>>>>"
FACTS = "struct<facts: map<string, map<string, struct<label: string, units: map<string, array<struct<start: string, end: string, val: double, form: string, filed: string, fy: int, fp: string>>>>>>>"
PRICES = "struct<timestamp: array<long>, open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<double>>"


def filing_hits(df: DataFrame, json_col: str) -> DataFrame:
    """Search hits: accession and document from the id's two sides of the first colon."""
    j = F.from_json(json_col, HITS)
    return df.select(j["hits"]["total"]["value"].alias("total"), F.size(j["hits"]["hits"]).alias("returned"), F.posexplode(j["hits"]["hits"]).alias("i", "h")).select((F.col("i") + 1).alias("rank"), F.substring_index("h._id", ":", 1).alias("accession"), F.expr("substr(h._id, length(substring_index(h._id, ':', 1)) + 2)").alias("document"), "h._source.form", "h._source.file_date", (F.col("returned") < F.col("total")).alias("truncated"))


def cik(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{1,10}$"), F.lpad(c, 10, "0"))


def resolve_company(wanted: DataFrame, tickers: DataFrame) -> DataFrame:
    """A number as CIK, else the ticker's, case-insensitively, the least of several."""
    one = tickers.groupBy(F.upper("ticker").alias("t")).agg(F.min(F.lpad(F.col("cik").cast("string"), 10, "0")).alias("found"))
    return wanted.join(one, F.upper(F.col("company")) == F.col("t"), "left").select("company", F.coalesce(cik(F.col("company")), "found").alias("cik"))


def fact_rows(df: DataFrame, json_col: str, taxonomy: str, concepts: list[str], forms: list[str] = (), start: str | None = None, end: str | None = None, limit: int = 50) -> DataFrame:
    """Facts of the concepts, latest filed first; date bounds apply to facts with an end."""
    t = df.select(F.explode(F.from_json(json_col, FACTS)["facts"]).alias("taxonomy", "c")).filter(F.lower("taxonomy") == taxonomy.lower())
    c = t.select("taxonomy", F.explode("c").alias("concept", "x")).filter(F.col("concept").isin(concepts))
    u = c.select("taxonomy", "concept", F.explode("x.units").alias("unit", "o")).select("taxonomy", "concept", "unit", F.explode("o").alias("o")).select("taxonomy", "concept", "unit", "o.*")
    if forms:
        u = u.filter(F.upper("form").isin([f.upper() for f in forms]))
    for bound, op in ((start, ">="), (end, "<=")):
        if bound:
            u = u.filter(F.col("end").isNull() | F.expr(f"`end` {op} '{bound}'"))
    return u.orderBy(F.coalesce(F.col("filed"), F.col("end")).desc_nulls_last(), "concept", "unit", "end").limit(min(limit, 200))


def fact_catalog(df: DataFrame, json_col: str) -> DataFrame:
    t = df.select(F.explode(F.from_json(json_col, FACTS)["facts"]).alias("taxonomy", "c"))
    return t.select("taxonomy", F.explode("c").alias("concept", "x")).select("taxonomy", "concept", "x.label", F.array_join(F.array_sort(F.map_keys("x.units")), ",").alias("units"))


def price_rows(df: DataFrame, key: str, series: Column) -> DataFrame:
    """Parallel arrays to daily rows; rows without a close are dropped."""
    z = F.explode(F.arrays_zip(*[series[c].alias(c) for c in ("timestamp", "open", "high", "low", "close", "volume")])).alias("p")
    return df.select(key, z).select(key, F.to_date(F.timestamp_seconds("p.timestamp")).alias("day"), *[F.col(f"p.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")]).filter("close is not null")


def first_last(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.count("*").alias("n"))


def zipped_profile(df: DataFrame, arrays: list[str], form: str, forms: list[str] = (), limit: int = 10) -> DataFrame:
    """Parallel arrays of recent filings to rows, up to the shortest."""
    least = F.array_min(F.array(*[F.size(a) for a in arrays]))
    rows = df.select(F.posexplode(F.slice(F.arrays_zip(*arrays), F.lit(1), least)).alias("i", "f")).select("i", "f.*")
    return (rows.filter(F.col(form).isin(list(forms))) if forms else rows).orderBy("i").limit(min(limit, 50))


def funding_profiles(institutions: DataFrame, key: str, total: str) -> DataFrame:
    """Per institution the profile that its total alone supports: one round where it is above
    none, no investors, nothing invested."""
    value = F.coalesce(F.col(total).cast("long"), F.lit(0))
    money = F.struct(F.lit("USD").alias("currency"), value.alias("value"), value.alias("value_usd"))
    return institutions.select(key, money.alias("total_funding"), F.when(value != 0, 1).otherwise(0).alias("funding_round_count"), F.lit(0).alias("investor_count"), F.lit(0).alias("invested_round_count"))
