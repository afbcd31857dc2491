"""Checks whose outcome is a frame of issues, so that they run where the rows are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json_paths import strict_json
from .normalize import get, is_a

#: Kinds of JSON values as Spark names them.
VARIANT_KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def issue(code: str, path: str, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(path).alias("path")))


def issues(df: DataFrame, key: str, found: list[Column]) -> DataFrame:
    """(key, code, path), one row an issue."""
    return df.select(key, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select(key, "i.*")


def field_state(v: Column, path: str) -> Column:
    """missing, null, empty or present."""
    x = F.try_variant_get(v, f"$.{path}", "variant")
    return F.when(x.isNull(), "missing").when(F.schema_of_variant(x) == "VOID", "null").when(F.to_json(x).isin('""', "[]", "{}"), "empty").otherwise("present")


def payload_issues(df: DataFrame, key: str, v: str, fields: dict[str, dict]) -> DataFrame:
    """Fields as {path: {kind, required, least, most}}: missing ones, wrong kinds, numbers out of
    bounds."""
    found = []
    for path, rule in fields.items():
        x, state = get(v, path, "variant"), field_state(F.col(v), path)
        there = state.isin("empty", "present")
        kinds = F.lit(False)
        for name in VARIANT_KINDS[rule["kind"]]:
            kinds = kinds | is_a(x, name)
        number = F.try_variant_get(x, "$", "double")
        if rule.get("required"):
            found.append(issue("required", path, ~there))
        found.append(issue("kind", path, there & ~kinds))
        if "least" in rule or "most" in rule:
            found.append(issue("range", path, there & kinds & ((number < rule.get("least", float("-inf"))) | (number > rule.get("most", float("inf"))))))
    return issues(df, key, found)


def envelope_issues(df: DataFrame, key: str, v: str, fields: dict[str, str]) -> DataFrame:
    """An object of exactly these keys, each of its kind."""
    keys = F.array_sort(F.map_keys(F.try_variant_get(F.col(v), "$", "map<string,variant>")))
    found = [issue("not_object", "", ~is_a(F.col(v), "OBJECT")), issue("keys", "", is_a(F.col(v), "OBJECT") & (keys != F.array(*map(F.lit, sorted(fields)))))]
    for path, kind in fields.items():
        x = get(v, path, "variant")
        fine = F.lit(False)
        for name in VARIANT_KINDS[kind]:
            fine = fine | is_a(x, name)
        found.append(issue("kind", path, x.isNotNull() & ~fine))
    return issues(df, key, found)


def measured(text: Column, unit: str) -> Column:
    """Length in words (runs of letters and digits, joined by apostrophes or hyphens) or in
    characters that aren't white space."""
    if unit == "words":
        return F.size(F.regexp_extract_all(text, F.lit(r"(?U)[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"), F.lit(0)))
    return F.length(F.regexp_replace(text, r"(?U)\s", ""))


def writing_issues(items: DataFrame, report: str, position: str, text: str, sources: str, count: dict, length: dict, cross_record: bool) -> DataFrame:
    """(report, level, code, position) of reports of items: too many items are errors, too few or
    another number than asked for warnings; lengths likewise, of each item or (scope total) of
    the report; items of a cross-record report need two sources (warning), of a per-record one
    exactly one that no earlier item has (errors). ``sources``: array of ids."""
    size = F.coalesce(measured(F.col(text), length["unit"]), F.lit(0))
    rows = items.select(report, position, size.alias("size"), F.array_distinct(F.filter(F.coalesce(sources, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))).alias("ids"))
    totals = rows.groupBy(report).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    bounds = lambda value, rule, name: [_level("error", f"{name}_max", value > rule["max"]) if rule.get("max") is not None else None, _level("warning", f"{name}_min", value < rule["min"]) if rule.get("min") is not None else None, _level("warning", f"{name}_target", value != rule["target"]) if rule.get("target") is not None else None]
    whole = length.get("scope") == "total"
    of_report = bounds(F.col("n"), count, "count") + (bounds(F.col("size"), length, "length") if whole else [])
    of_item = [] if whole else bounds(F.col("size"), length, "length")
    n = F.size("ids")
    of_item.append(_level("warning", "few_sources", n < 2) if cross_record else _level("error", "one_source", n != 1))
    out = _levels(totals.withColumn(position, F.lit(None).cast("long")), report, position, of_report).unionByName(_levels(rows, report, position, of_item))
    if cross_record:
        return out
    used = rows.select(report, position, F.explode("ids").alias("id")).withColumn("first", F.min(position).over(Window.partitionBy(report, "id")))
    reused = used.filter(F.col(position) > F.col("first")).select(report, F.lit("error").alias("level"), F.lit("reused_source").alias("code"), F.col(position).cast("long").alias(position)).distinct()
    return out.unionByName(reused)


def _level(level: str, code: str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code")))


def _levels(df: DataFrame, report: str, position: str, found: list[Column | None]) -> DataFrame:
    kept = [f for f in found if f is not None]
    each = F.explode(F.filter(F.array(*kept), lambda x: x.isNotNull())) if kept else F.explode(F.array().cast("array<struct<level:string,code:string>>"))
    return df.select(report, F.col(position).cast("long").alias(position), each.alias("i")).select(report, "i.level", "i.code", position)


def analysis_issues(rows: DataFrame, catalog: DataFrame, subjects: DataFrame, signals: DataFrame) -> DataFrame:
    """(code, id) of an analysis. rows: source_id, subject; catalog: source_id; subjects: source_id,
    subject (of the graph); signals: signal_id, summary, source_ids. Reported are rows of unknown
    sources, rows whose subject the graph doesn't prove, signals without id, summary or sources,
    of repeated ids, of unknown sources, and of sources that no row has."""
    made = lambda df, code, name: df.select(F.lit(code).alias("code"), F.col(name).alias("id")).distinct()
    known, in_rows = catalog.select("source_id").distinct(), rows.select("source_id").distinct()
    cited = signals.select("signal_id", F.explode("source_ids").alias("source_id")).filter("trim(source_id) <> ''")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    parts = [
        made(rows.join(known, "source_id", "left_anti"), "unknown_source", "source_id"),
        made(rows.join(known, "source_id", "left_semi").join(subjects.distinct(), ["source_id", "subject"], "left_anti"), "unproven_subject", "source_id"),
        made(signals.filter(blank("summary")), "no_summary", "signal_id"),
        made(signals.groupBy("signal_id").count().filter("count > 1 or trim(coalesce(signal_id, '')) = ''"), "signal_id", "signal_id"),
        made(signals.select("signal_id").distinct().join(cited.select("signal_id"), "signal_id", "left_anti"), "no_sources", "signal_id"),
        made(cited.join(known, "source_id", "left_anti"), "cites_unknown", "signal_id"),
        made(cited.join(known, "source_id", "left_semi").join(in_rows, "source_id", "left_anti"), "cites_absent", "signal_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def identifier_fine(c: Column) -> Column:
    """1 to 1024 characters, none of them a control character."""
    return F.coalesce(F.length(c).between(1, 1024) & ~c.rlike(r"[\x00-\x1f\x7f]"), F.lit(False))


def nonblank_row(*columns: str) -> Column:
    return F.exists(F.array(*(F.col(c).cast("string") for c in columns)), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))


#: Keys of the composite field types.
HOTNESS = ("day", "week", "month", "half_year", "previous_half_year")
IMPACT = ("paper", "talent", "news", "funding", "industry")
NEWS = ("title", "source", "date")


def fits_contract(v: Column, kind: str) -> Column:
    """Whether a variant is of a field type of the templates: string, integer, number,
    string_array, hotness, impact or news_array."""
    among = lambda x, *kinds: F.exists(F.array(*(F.lit(k) for k in kinds)), lambda k: F.startswith(F.schema_of_variant(x), k))
    number = lambda x: among(x, *VARIANT_KINDS["number"])
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    keys, listed = F.transform(entries, lambda e: e["key"]), F.try_variant_get(v, "$", "array<variant>")
    same = lambda found, wanted: F.array_sort(found) == F.array(*map(F.lit, sorted(wanted)))
    if kind == "string_array":
        fine = is_a(v, "ARRAY") & F.forall(listed, lambda x: among(x, "STRING"))
    elif kind == "hotness":
        fine = is_a(v, "OBJECT") & (F.size(F.array_except(keys, F.array(*map(F.lit, HOTNESS)))) == 0) & F.array_contains(keys, "half_year") & F.forall(entries, lambda e: among(e["value"], "BIGINT"))
    elif kind == "impact":
        fine = is_a(v, "OBJECT") & same(keys, IMPACT) & F.forall(entries, lambda e: number(e["value"]))
    elif kind == "news_array":
        inner = lambda x: F.map_entries(F.try_variant_get(x, "$", "map<string,variant>"))
        fine = is_a(v, "ARRAY") & F.forall(listed, lambda x: among(x, "OBJECT") & same(F.transform(inner(x), lambda e: e["key"]), NEWS) & F.forall(inner(x), lambda e: among(e["value"], "STRING")))
    else:
        fine = among(v, *VARIANT_KINDS[kind])
    return F.coalesce(fine, F.lit(False))


def seed_issues(plan: DataFrame, seed: DataFrame, key: str, forbidden: list[str]) -> DataFrame:
    """(key, code) of plans (key, text as JSON) against their seeds: missing, extra or changed, or
    with a forbidden key at its top."""
    both = seed.select(key, F.col("text").alias("s")).join(plan.select(key, F.col("text").alias("p")), key, "full_outer")
    p, s = strict_json(F.col("p")), strict_json(F.col("s"))
    keys = F.coalesce(F.map_keys(F.try_variant_get(p, "$", "map<string,variant>")), F.array().cast("array<string>"))
    codes = F.array(F.when(F.col("p").isNull(), "missing"), F.when(F.col("s").isNull(), "extra"), F.when(~F.to_json(p).eqNullSafe(F.to_json(s)) & F.col("p").isNotNull() & F.col("s").isNotNull(), "changed"), F.when(F.arrays_overlap(keys, F.array(*map(F.lit, forbidden))), "forbidden_key"))
    return both.select(key, F.explode(F.array_compact(codes)).alias("code"))
