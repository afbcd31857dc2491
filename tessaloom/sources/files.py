"""Tables, raw JSON envelopes, CSV directories, event lines and text stores."""

from __future__ import annotations

import posixpath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_paths import strict_json

KEY_SHAPE = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_envelopes(spark: SparkSession, path: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Whole JSON files that are envelopes of ``source``, and those that aren't."""
    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw_text"), F.sha2("value", 256).alias("sha256"))
    v = strict_json(F.col("raw_text"))
    data = F.schema_of_variant(F.try_variant_get(v, "$.data", "variant"))
    fine = (F.try_variant_get(v, "$.source", "string") == source) & F.try_variant_get(v, "$.endpoint", "string").isNotNull() & (data.startswith("OBJECT") | data.startswith("ARRAY"))
    judged = read.withColumn("fine", F.coalesce(fine, F.lit(False)))
    return judged.filter("fine").drop("fine"), judged.filter("not fine").drop("fine")


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text; blank or repeated headers, and rows of too many cells, are errors."""
    first = spark.read.text(path).limit(1).collect()
    header = spark.read.option("header", False).option("escape", '"').csv(spark.createDataFrame([(first[0].value.lstrip("﻿"),)], "value string").rdd.map(lambda r: r.value)).first() if first else []
    names = [h or "" for h in header]
    if any(not n.strip() for n in names) or len(set(names)) != len(names):
        raise ValueError(f"blank or repeated header in {path}: {names}")
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("mode", "FAILFAST").option("inferSchema", False).schema(", ".join(f"`{n}` string" for n in names)).csv(path)


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as (event variant, warning); malformed lines are warnings."""
    v = strict_json(F.col("value"))
    return spark.read.text(path).filter(F.trim("value") != "").select(v.alias("event"), F.when(v.isNull(), F.col("value")).alias("warning"))


def file_listing(spark: SparkSession, path: str, pattern: str = "*", limit: int = 100) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime").orderBy("path").limit(max(1, min(limit, 500)))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_new_only(new: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key isn't stored yet; a content hash as key makes it write-once. For
    one writer at a time."""
    spark = new.sparkSession
    fresh = new.dropDuplicates([key])
    try:
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def stored_text(store: DataFrame, wanted: DataFrame, key_cap: int = 16_000) -> DataFrame:
    """(key, text, clipped) of wanted (key, start, end): whole texts up to a cap, ranges cut to
    the text."""
    n = F.length("text")
    lo = F.greatest(F.lit(0), F.least(F.coalesce("start", F.lit(0)), n))
    hi = F.greatest(lo, F.least(F.coalesce("end", n), n, lo + key_cap))
    return wanted.filter(F.col("key").rlike(KEY_SHAPE)).join(store, "key").select("key", F.substring("text", lo + 1, hi - lo).alias("text"), (hi < F.least(F.coalesce("end", n), n)).alias("clipped"))


def contained(base: str, relative: str, also: tuple[str, ...] = ()) -> str:
    """The path below ``base``, normalised; ValueError if it leaves it and isn't below one of
    ``also`` either. By its text: storage shared by executors has no links to follow."""
    full = posixpath.normpath(posixpath.join(base, relative))
    if any(full == b or full.startswith(f"{b}/") for b in map(posixpath.normpath, (base, *also))):
        return full
    raise ValueError(f"path leaves its folder: {relative}")


def csv_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, all cells text; no file gives no rows."""
    try:
        return spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(schema).csv(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def field_names(spark: SparkSession, path: str) -> list[str]:
    """The sorted keys of a JSON object, or the header of a CSV or TSV file."""
    if path.endswith(".json"):
        keys = spark.read.text(path, wholetext=True).select(F.array_sort(F.json_object_keys("value")).alias("k")).first()
        return list(keys.k or []) if keys else []
    return spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path).columns


def serving_scan(spark: SparkSession, name: str, columns: list[str], limit: int, **equal) -> DataFrame:
    """Columns of a catalog table's rows that equal all given values; a table that isn't there is
    an error, and is never made. Filters and columns reach the scan."""
    if not spark.catalog.tableExists(name):
        raise LookupError(f"no table {name}")
    from ..operators.lineage import serving_filter

    return serving_filter(spark.table(name), **equal).select(*columns).limit(limit)


def append_stage_events(events: DataFrame, path: str) -> None:
    """Events of stages (job, stage, state, at) as JSON lines, appended."""
    events.write.mode("append").json(path)


def publish(df: DataFrame, root: str, run: str) -> None:
    """Writes a bundle under its run's name, once, and then one row that points to it: readers see
    the old bundle or the whole new one."""
    df.write.mode("errorifexists").parquet(f"{root}/bundles/{run}")
    df.sparkSession.range(1).select(F.lit(run).alias("run"), F.current_timestamp().alias("published_at")).write.mode("append").parquet(f"{root}/pointers")


def published(spark: SparkSession, root: str) -> DataFrame:
    """The bundle published last."""
    last = spark.read.parquet(f"{root}/pointers").agg(F.max_by("run", F.struct("published_at", "run")).alias("run")).first()
    return spark.read.parquet(f"{root}/bundles/{last.run}")
