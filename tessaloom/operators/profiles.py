"""Profiles of columns, keys and joins. Each is one pass of two-level aggregation: values are
counted with map-side combine first, so a hot value never meets in one task row by row."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import fits

KINDS = ("boolean", "integer", "number", "date", "datetime", "json_array", "json_object")


def profile_columns(df: DataFrame, limit: int | None = None) -> DataFrame:
    """One row a column: counts of cells, distinct values, lengths, fits of every type, and the
    first type that all cells fit."""
    if limit is not None:
        df = df.limit(limit)
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns])).alias("x")).select("x.*")
    values = cells.groupBy("column", "value").agg(F.count("*").alias("n")).withColumn("filled", F.coalesce(F.trim("value") != "", F.lit(False)))
    counted = values.groupBy("column").agg(
        F.sum("n").alias("inspected"),
        F.coalesce(F.sum(F.when(F.col("filled"), F.col("n"))), F.lit(0)).alias("nonblank"),
        F.coalesce(F.sum(F.when(~F.col("filled"), F.col("n"))), F.lit(0)).alias("blank"),
        F.count_if("filled").alias("distinct_nonblank"),
        F.coalesce(F.sum(F.when(F.col("filled"), F.col("n") - 1)), F.lit(0)).alias("duplicate_nonblank"),
        F.coalesce(F.max(F.when(F.col("filled"), F.length("value"))), F.lit(0)).cast("long").alias("max_length"),
        *[F.coalesce(F.sum(F.when(F.col("filled") & fits(k, F.col("value") if k in ("integer", "number") else F.trim("value")), F.col("n"))), F.lit(0)).alias(f"fits_{k}") for k in KINDS],
    )
    inferred = F.when(F.col("nonblank") == 0, "unknown")
    for k in KINDS:
        inferred = inferred.when(F.col(f"fits_{k}") == F.col("nonblank"), k)
    return counted.withColumn("inferred", inferred.otherwise("string"))


def _keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Trimmed key, its rows; keys with a blank part left out."""
    parts = [F.trim(F.col(c).cast("string")) for c in columns]
    filled = F.lit(True)
    for p in parts:
        filled = filled & F.coalesce(p != "", F.lit(False))
    return df.filter(filled).groupBy(F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)]).alias("key")).agg(F.count("*").alias("n"))


def profile_identity(df: DataFrame, columns: list[str]) -> DataFrame:
    """Complete and distinct keys, duplicates, and what the key may serve as."""
    total = df.agg(F.count("*").alias("rows"))
    keys = _keys(df, columns).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("complete_rows"),
        F.count("*").alias("distinct_keys"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_multiplicity"),
    )
    out = total.join(keys, how="cross")  # one row each
    unique = (F.col("rows") > 0) & (F.col("complete_rows") == F.col("rows")) & (F.col("distinct_keys") == F.col("rows"))
    return out.withColumn("incomplete_rows", F.col("rows") - F.col("complete_rows")).withColumn("row_unique", unique).withColumn("semantics", F.when(unique, "row_primary_key").otherwise("entity_merge_key"))


def profile_join(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str]) -> DataFrame:
    """A join measured, not made: rows, keys, coverage and cardinality, as one row."""
    a, b = _keys(left, left_on), _keys(right, right_on)
    matched = a.join(b.select("key", F.col("n").alias("m")), "key", "full_outer")
    s = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    out = matched.agg(
        s("n", "left_rows"),
        s("m", "right_rows"),
        F.count("n").alias("left_keys"),
        F.count("m").alias("right_keys"),
        s(F.when(F.col("m").isNotNull(), F.col("n")), "matched_left_rows"),
        F.count_if(F.col("n").isNotNull() & F.col("m").isNotNull()).alias("matched_keys"),
    )
    coverage = lambda part, of: F.when(F.col(of) == 0, F.lit(1.0)).otherwise(F.round(F.col(part) / F.col(of), 9))
    one_left, one_right = F.col("left_rows") == F.col("left_keys"), F.col("right_rows") == F.col("right_keys")
    return out.withColumns({
        "row_coverage": coverage("matched_left_rows", "left_rows"),
        "key_coverage": coverage("matched_keys", "left_keys"),
        "left_unique": one_left,
        "right_unique": one_right,
        "cardinality": F.concat(F.when(one_left, "one").otherwise("many"), F.lit("_to_"), F.when(one_right, "one").otherwise("many")),
    })


def discover_joins(tables: dict[str, DataFrame], shared) -> DataFrame:
    """Profiles of all ordered pairs of tables over columns that ``shared`` pairs up:
    a function (left columns, right columns) -> [(left column, right column)]."""
    found = None
    for a, b in permutations(sorted(tables), 2):
        for x, y in shared(tables[a].columns, tables[b].columns):
            one = profile_join(tables[a], tables[b], [x], [y]).select(F.lit(a).alias("left_table"), F.lit(b).alias("right_table"), F.lit(x).alias("left_column"), F.lit(y).alias("right_column"), "*")
            found = one if found is None else found.unionByName(one)
    return found


def catalog_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables, non-empty tables and rows."""
    each = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows"))
        each = one if each is None else each.unionByName(one)
    return each.agg(F.count("*").alias("tables"), F.count_if(F.col("rows") > 0).alias("nonempty"), F.sum("rows").alias("rows"))


def path_profile(fragments: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Occurrences, documents, kinds and the least three pointers of every pattern."""
    counted = fragments.groupBy(*by, "pattern").agg(F.count("*").alias("occurrences"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    documents = fragments.select(*by, "pattern", key).distinct().groupBy(*by, "pattern").agg(F.count("*").alias("documents"))
    samples = fragments.groupBy(*by, "pattern", "pointer").agg(F.lit(1).alias("one")).groupBy(*by, "pattern").agg(F.slice(F.array_sort(F.collect_list("pointer")), 1, 3).alias("samples"))
    return counted.join(documents, [*by, "pattern"]).join(samples, [*by, "pattern"])


def field_consensus(df: DataFrame, entity: str, fields: list[str]) -> DataFrame:
    """Per field: entities with no value, with one, and with several; '' is a value."""
    cells = df.filter(F.col(entity).isNotNull()).select(F.col(entity).alias("e"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])).alias("x"))
    distinct = cells.select("e", "x.*").distinct().groupBy("e", "field").agg(F.count("v").alias("values"))
    return distinct.groupBy("field").agg(F.count_if(F.col("values") == 0).alias("missing"), F.count_if(F.col("values") == 1).alias("consensus"), F.count_if(F.col("values") > 1).alias("conflict"))


def consensus_projection(df: DataFrame, entity: str, value: str) -> DataFrame:
    """The value all of an entity's non-empty values agree in, else null and their number."""
    v = F.col(value).cast("string")
    distinct = df.filter(F.col(entity).isNotNull() & (v != "")).select(F.col(entity).alias("entity"), v.alias("v")).distinct()
    return distinct.groupBy("entity").agg(F.count("*").alias("values"), F.when(F.count("*") == 1, F.min("v")).alias("agreed"))


def relation_compare(authority: DataFrame, corroborating: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct pairs of both sides, common ones, and both differences."""
    a = authority.select(*columns).distinct().withColumn("a", F.lit(1))
    b = corroborating.select(*columns).distinct().withColumn("b", F.lit(1))
    return a.join(b, columns, "full_outer").agg(
        F.count("a").alias("authoritative"),
        F.count("b").alias("corroborating"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"),
        F.count_if(F.col("b").isNull()).alias("authority_only"),
        F.count_if(F.col("a").isNull()).alias("corroborating_only"),
    )


def length_totals(df: DataFrame, key: str, text: str) -> DataFrame:
    from ..functions.text import visible_chars, word_count

    return df.select(F.col(key), visible_chars(F.coalesce(F.col(text), F.lit(""))).alias("chars"), word_count(F.coalesce(F.col(text), F.lit(""))).alias("words"))
