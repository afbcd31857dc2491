"""Grounding of reported findings in the evidence they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_number, evidence_numbers, latin_key, name_tokens, number_tokens

MOST_ISSUES = 12
HOT = 64


def unsupported_tokens(findings: DataFrame, evidence: DataFrame, key: str, text: str, english: bool = False) -> DataFrame:
    """(key, token) of numbers and names in a finding that its evidence lacks, at most 12 a
    finding, numbers first. A number is there if its digits stand in the evidence's letters and
    digits, or a number of equal value and kind (share or plain) does; a name if its letters and
    digits do, in either case. evidence: one row a key."""
    joined = findings.select(key, F.col(text).alias("f")).join(evidence.select(key, F.coalesce(F.col(text), F.lit("")).alias("e")), key, "left")
    prepared = joined.select(key, number_tokens(F.col("f")).alias("numbers"), name_tokens(F.col("f"), english).alias("names"), F.coalesce(latin_key(F.col("e")), F.lit("")).alias("have"), F.coalesce(evidence_numbers(F.col("e")), evidence_numbers(F.lit(""))).alias("values"))
    digits = lambda t: F.regexp_replace(F.lower(t), r"[\s,]+", "")
    no_number = F.filter("numbers", lambda t: ~F.contains(F.col("have"), digits(t)) & ~F.coalesce(F.array_contains(F.col("values"), canonical_number(t)), F.lit(False)))
    no_name = F.filter("names", lambda t: ~F.contains(F.col("have"), latin_key(t)))
    return prepared.select(key, F.explode(F.slice(F.concat(no_number, no_name), 1, MOST_ISSUES)).alias("token"))


def duplicate_findings(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Rows whose words equal an earlier row's, and that row; rows that are null in all columns
    have no words to compare. Letters are lower-cased one by one, so a capital sigma or dotted I
    gives the same at any place. The earliest rows of the largest groups come by broadcast, and
    their rows are then spread by themselves. One plan of the largest is used for both, with ties
    in their number broken by key: two plans could differ in them, and lose or repeat rows."""
    norm = F.regexp_replace(F.concat_ws(" ", *columns), r"[^\p{L}\p{N}]+", "")
    lower = F.lower(F.replace(F.replace(norm, F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("i")))
    keyed = df.filter(F.col(order).isNotNull() & F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()).select(F.col(order).alias("row"), F.sha2(lower, 256).alias("k"))
    first = keyed.groupBy("k").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1")
    hot = first.orderBy(F.desc("n"), "k").limit(HOT).select("k", F.col("first").alias("hot_first"))  # a top list of bounded size
    own = F.concat(F.lit("row "), F.col("row").cast("string"))  # no key begins so
    marked = keyed.join(F.broadcast(hot), "k", "left").select("row", "hot_first", F.when(F.col("hot_first").isNull(), F.col("k")).otherwise(own).alias("k"))
    return marked.join(first.select("k", "first"), "k", "left").select("row", F.coalesce("hot_first", "first").alias("first")).filter(F.col("row") > F.col("first"))


def unknown_sources(rows: DataFrame, known: DataFrame, column: str) -> DataFrame:
    return rows.join(known.select(column).distinct(), column, "left_anti")


def prefix_resolve(wanted: DataFrame, known: DataFrame, column: str, least: int = 8) -> DataFrame:
    """(wanted, resolved): the equal id, else the only id that begins with it, if it is of
    ``least`` characters. Known ids are counted by their prefixes of the lengths that are wanted,
    before anything is joined, so ids that share a beginning never meet pair by pair."""
    w = wanted.select(F.col(column).alias("wanted")).filter("wanted is not null").distinct()
    k = known.select(F.col(column).alias("id")).filter("id is not null").distinct()
    lengths = [r[0] for r in w.select(F.length("wanted")).distinct().collect() if r[0] >= least]  # as many as the longest id has characters, at most
    heads = F.transform(F.filter(F.array(*map(F.lit, lengths or [least])), lambda n: n <= F.length("id")), lambda n: F.lower(F.substring(F.col("id"), F.lit(1), n)))
    one = k.select("id", F.explode(heads).alias("head")).groupBy("head").agg(F.count("*").alias("n"), F.min("id").alias("only")).filter("n = 1")
    exact = w.join(k, w["wanted"] == k["id"], "left")
    near = exact.join(one, (F.lower("wanted") == F.col("head")) & (F.length("wanted") >= least), "left")
    return near.select("wanted", F.coalesce("id", "only").alias("resolved"))


def repair_rows(rows: DataFrame, catalog: DataFrame, key: str, fill: list[str]) -> DataFrame:
    """Rows with known keys, once each, with empty fields filled from the catalog."""
    first = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in rows.columns if c != key])
    known = catalog.select(key, *[F.col(c).alias(f"_{c}") for c in fill])
    fixed = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").join(known, key)
    return fixed.select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")).alias(c) if c in fill else F.col(c) for c in rows.columns])


def missing_rows(cited: DataFrame, rows: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Catalog rows that are cited but not in ``rows``."""
    return catalog.join(cited.select(key).distinct(), key, "left_semi").join(rows.select(key).distinct(), key, "left_anti")


def transitive_support(insights: DataFrame, signals: DataFrame) -> DataFrame:
    """(insight, source) cited by an insight but by none of its signals. insights: insight,
    signals, sources; signals: signal, sources."""
    cited = insights.select("insight", F.explode("sources").alias("source"))
    proven = insights.select("insight", F.explode("signals").alias("signal")).join(signals, "signal").select("insight", F.explode("sources").alias("source")).distinct()
    return cited.distinct().join(proven, ["insight", "source"], "left_anti")


def finalise_insights(df: DataFrame) -> DataFrame:
    """Valid rows with defaults: ids ins_ and three digits or more, confidence from 0 to 1."""
    fine = F.col("insight_id").rlike(r"^ins_\d{3,}$") & (F.trim("title") != "")
    return df.filter(fine).withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("confidence").cast("double"), F.lit(0.5)))))


def review(df: DataFrame, required: list[str], most: int) -> DataFrame:
    """(code, row): rows lacking a field, and too many or no rows at all."""
    lacking = df.select(F.col("insight_id").alias("row"), F.explode(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)), F.lit(f"missing_{c}")) for c in required])).alias("code")).filter("code is not null").select("code", "row")
    count = df.agg(F.count("*").alias("n")).select(F.when(F.col("n") == 0, "empty").when(F.col("n") > most, "too_many").alias("code"), F.lit(None).cast("string").alias("row")).filter("code is not null")
    return lacking.unionByName(count)
