"""Documents, their records and fragments; coverage of what was found against what was declared;
order and identity of quads and bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json_paths import canonical_json


def keyword(df: DataFrame, word: str) -> DataFrame:
    """Rows whose whole record, as JSON, holds the word in either case."""
    return df.filter(F.contains(F.lower(F.to_json(F.struct(*df.columns))), F.lit(word.lower())))


def drop_empty(payload: dict) -> dict:
    """A request without what is None or an empty list or object; 0 and '' stay."""
    return {k: v for k, v in payload.items() if v is not None and v != [] and v != {}}


def serving_filter(df: DataFrame, **equal) -> DataFrame:
    """Rows equal in every named column, by value; without a name, rows that have an id."""
    for name, value in equal.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df if equal else df.filter(F.col("id").isNotNull())


def named_tables(names: list[str], include: list[str] = (), exclude: list[str] = ()) -> list[str]:
    """File names that are included (all, without a list) and not excluded, by name or stem."""
    either = lambda n, given: n in given or n.rsplit(".", 1)[0] in given
    return [n for n in names if (not include or either(n, include)) and not either(n, exclude)]


def path_lookup(profile: DataFrame, endpoint: str | None = None, pattern: str | None = None) -> DataFrame:
    for name, value in (("endpoint", endpoint), ("pattern", pattern)):
        if value is not None:
            profile = profile.filter(F.col(name) == value)
    return profile


def with_provenance(records: DataFrame, documents: DataFrame, fragments: DataFrame, document: str, pointer: str) -> DataFrame:
    """Records with their documents' columns, and with their fragment's where one is known."""
    return records.join(documents, document).join(fragments, [document, pointer], "left")


def unproven(rows: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys, together, the mapping doesn't have."""
    return rows.join(mapping.select(*keys).distinct(), keys, "left_anti")


def coverage_diff(declared: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): declared but not found (missing), found but not declared (extra)."""
    a, b = declared.select(*keys).distinct(), found.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("extra")))


def concatenated(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; columns that one lacks are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_in_order(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each key's first place in the order, by aggregation."""
    return df.groupBy(*keys).agg(F.min(order).alias(order))


def quad_order(quads: DataFrame) -> DataFrame:
    """Quads in order of their six texts, by bytes; a range exchange, not one task."""
    return quads.orderBy("graph", "subject", "predicate", "value", "kind", "datatype")


def resolved_bindings(bindings: DataFrame) -> DataFrame:
    """bindings: endpoint, path, property, preferred, formula. One property a path: preferred
    ones first, then those with the lesser formula, then by name; different formulas of a path
    keep one each."""
    order = (F.col("preferred").desc(), F.col("formula"), F.col("property"))
    return bindings.withColumn("r", F.row_number().over(Window.partitionBy("endpoint", "path", "formula").orderBy(*order))).filter("r = 1").drop("r")


def label_consensus(df: DataFrame, concept: str, label: str) -> DataFrame:
    """(concept, spellings, label): the label only where there is a single spelling."""
    return df.filter(F.col(concept).isNotNull()).groupBy(concept).agg(F.count_distinct(label).alias("spellings"), F.min(label).alias("l")).select(concept, "spellings", F.when(F.col("spellings") == 1, F.col("l")).alias("label"))


def lineage_counts(paths: DataFrame, columns: DataFrame, rules: DataFrame) -> DataFrame:
    """rules: column, pattern. Per column: occurrences of its paths, nonblank outputs, and those
    beyond the occurrences (defaulted)."""
    raw = rules.join(paths, "pattern", "left").groupBy("column").agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"))
    return raw.join(columns.select("column", "nonblank"), "column").withColumn("defaulted", F.greatest(F.lit(0), F.col("nonblank") - F.col("occurrences")))


def scope_summary(calls: DataFrame, by: str) -> DataFrame:
    """calls: kind, truncated, omitted. Numbers of calls, searches and gets, and what was cut."""
    return calls.groupBy(by).agg(F.count("*").alias("calls"), F.count_if(F.col("kind") == "search").alias("searches"), F.count_if(F.col("kind") == "get").alias("gets"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"), F.coalesce(F.sum("omitted"), F.lit(0)).alias("omitted"))


def record_place(listed: Column, record: Column) -> Column:
    """The first place (from 0) of a record in a list of JSON texts, by equal content."""
    return F.array_position(listed, record) - 1


def same_content(a: Column, b: Column) -> Column:
    """JSON texts that are equal but for key order and spaces."""
    return canonical_json(a).eqNullSafe(canonical_json(b))


def award_labels(listed: Column) -> Column:
    """Of a list of variants, each text, or an object's title, name or key, once, in order."""
    label = lambda x: F.coalesce(F.nullif(F.try_variant_get(x, "$.title", "string"), F.lit("")), F.nullif(F.try_variant_get(x, "$.name", "string"), F.lit("")), F.nullif(F.try_variant_get(x, "$.key", "string"), F.lit("")), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    return F.array_distinct(F.filter(F.transform(listed, label), lambda x: x.isNotNull() & (x != "")))


def excerpt(items: DataFrame, cited: DataFrame, key: str, text: str, order: str, chars: int = 900, records: int = 30, total: int = 24_000) -> DataFrame:
    """The first ``records`` cited items in order, each of collapsed white space and at most
    ``chars`` characters, while they fit ``total``: (key, place, text)."""
    short = F.substring(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 1, chars)
    first = items.join(F.broadcast(cited.select(key).distinct().limit(200)), key, "left_semi").select(key, order, short.alias("t")).orderBy(order, key).limit(records)  # 200 ids is the feature's bound
    w = Window.orderBy(order, key)  # over at most ``records`` rows
    return first.withColumn("place", F.row_number().over(w)).withColumn("sum", F.sum(F.length("t")).over(w)).filter(F.col("sum") <= total).select(key, "place", F.col("t").alias("text"))


def entity_hints(hints: DataFrame, columns: DataFrame, identities: DataFrame) -> DataFrame:
    """hints: class, table, id_field; columns: table, column; identities: table, id_field,
    evidence. Whether what a hint names exists, and the evidence for its identity. All three are
    of the catalog's size."""
    tables = columns.select("table").distinct().withColumn("table_exists", F.lit(True))
    known = columns.select("table", F.col("column").alias("id_field")).distinct().withColumn("field_exists", F.lit(True))
    joined = hints.join(tables, "table", "left").join(known, ["table", "id_field"], "left").join(identities, ["table", "id_field"], "left")
    return joined.select("class", "table", "id_field", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("table_exists", "field_exists")), "evidence")


def relation_hints(hints: DataFrame, entities: DataFrame, joins: DataFrame) -> DataFrame:
    """hints: relation (Source-predicate-Target, or without a target), table, source_field,
    target_field; entities: class, table, id_field; joins: table, field, to_table, to_field,
    evidence. The join evidence of both ends; a relation without a target ends in a value."""
    parts = F.split("relation", "-")
    named = hints.select("*", F.get(parts, F.lit(0)).alias("source_class"), F.get(parts, F.lit(1)).alias("predicate"), F.get(parts, F.lit(2)).alias("target_class"))
    for end in ("source", "target"):
        of = entities.select(F.col("class").alias(f"{end}_class"), F.col("table").alias("to_table"), F.col("id_field").alias("to_field"))
        proof = joins.select("table", F.col("field").alias(f"{end}_field"), "to_table", "to_field", F.col("evidence").alias(f"{end}_evidence"))
        named = named.join(of, f"{end}_class", "left").join(proof, ["table", f"{end}_field", "to_table", "to_field"], "left").drop("to_table", "to_field")
    return named.select("relation", "source_class", "predicate", "target_class", "table", "source_evidence", "target_evidence", F.col("target_class").isNull().alias("scalar"))
