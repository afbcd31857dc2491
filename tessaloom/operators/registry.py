"""Append-only logs read as registries: latest rows, attempts, transitions, call sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: list[str], created: str) -> DataFrame:
    """The last row of every key, with the first row's creation time; one aggregation with
    map-side combine, so a hot key is no burden."""
    rest = [c for c in log.columns if c not in keys]
    last = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_r")
    return log.groupBy(*keys).agg(last, F.min(created).alias("created_at")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest], "created_at")


def attempts(log: DataFrame, keys: list[str], order: list, starts) -> DataFrame:
    """Attempt numbers: 1 and one more at every row where ``starts`` holds after the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("attempt", (F.sum(starts.cast("int")).over(w) - F.first(starts.cast("int")).over(w) + 1).cast("long"))


def guarded_transitions(log: DataFrame, keys: list[str], order: list, state: str, ends: list[str]) -> DataFrame:
    """Rows up to and with a key's first terminal state; later ones are refused."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("_over", F.coalesce(F.max(F.col(state).isin(ends)).over(w), F.lit(False))).filter(~F.col("_over")).drop("_over")


def sequence_issues(calls: DataFrame, key: str, position: str, tool: str, first: str, most: int) -> DataFrame:
    """(key, issue): not begun by ``first``, ``first`` again later, or too many calls."""
    each = calls.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct(position, tool)).alias("f"), F.count_if(F.col(tool) == first).alias("firsts"))
    issues = F.array(F.when(F.col("f")[tool] != first, "bad_start"), F.when(F.col("firsts") > 1, "repeated_start"), F.when(F.col("n") > most, "too_many"))
    return each.select(key, F.explode(F.array_compact(issues)).alias("issue"))


def status_summary(df: DataFrame, by: str, status: str, order: list[str]) -> DataFrame:
    """The status of the highest precedence in each group (first in ``order``)."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(status))
    return df.groupBy(by).agg(F.min(F.when(place > 0, place)).alias("p")).select(by, F.get(F.array(*map(F.lit, order)), (F.col("p") - 1).cast("int")).alias("status"))


def byte_budget(df: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows kept from the first on while the group's bytes stay within the budget."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(w)).filter(F.col("running") <= budget)


def evict_largest(records: list[dict], heavy: list[str], budget: int) -> tuple[list[dict], list[tuple[int, str]]]:
    """One result set: the largest heavy field goes until its compact JSON fits; then records
    from the end."""
    import json

    size = lambda x: len(json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode())
    records, gone = [dict(r) for r in records], []
    total, sizes = size(records), {(i, k): size(r[k]) for i, r in enumerate(records) for k in heavy if r.get(k) is not None}
    for (i, k), _ in sorted(sizes.items(), key=lambda x: (-x[1], -x[0][0], x[0][1])):
        if total <= budget:
            break
        records[i][k] = None
        gone.append((i, k))
        total = size(records)
    while records and size(records) > budget:
        records.pop()
    return records, gone


def retry_fold(events: DataFrame, key: str, order: str, ok: str) -> DataFrame:
    """Keys whose last event failed, with the number of failures since the last success."""
    last_ok = F.max(F.when(F.col(ok), F.col(order))).over(Window.partitionBy(key))
    return events.withColumn("_ok", last_ok).filter(F.col("_ok").isNull() | (F.col(order) > F.col("_ok"))).groupBy(key).agg(F.count("*").alias("failures"))
