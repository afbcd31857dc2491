"""Extraction plans: a closed vocabulary of declarative operations, compiled to quads over one
scan of the records. A plan is plain data on the driver; operations are checked, deduplicated
and pruned before anything runs."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import concept_key, percent_encode
from ..functions.values import lexical
from ..operators.graph import as_set, emit, quad

VOCABULARY = ("copy_scalar", "require_consensus", "concept_by_normalized_value", "reference_by_business_id", "object_fields", "reify_array_membership", "authority_projection", "explode_array", "derived_formula")
REFUSED = ("explode_array", "derived_formula", "authority_projection")  # known, but nothing here would carry them out


@dataclass(frozen=True)
class Operation:
    op: str
    path: str
    property: str
    datatype: str = "string"
    target: str = ""
    fields: tuple[tuple[str, str], ...] = ()


def compile_plan(operations: list[Operation], present: set[str] | None = None) -> list[Operation]:
    """Known operations, once each, whose paths occur, in order of their content."""
    for o in operations:
        if o.op not in VOCABULARY or o.op in REFUSED:
            raise ValueError(f"operation not executable: {o.op}")
    kept = {json.dumps(asdict(o), sort_keys=True): o for o in operations if present is None or o.path in present}
    return [kept[k] for k in sorted(kept)]


def fingerprint(operations: list[Operation]) -> str:
    return sha256(json.dumps([asdict(o) for o in operations], sort_keys=True).encode()).hexdigest()


def _at(item: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(item, "$" + path.replace("/", "."), kind)


def materialise(records: DataFrame, operations: list[Operation], base: str, graph: str = "data") -> DataFrame:
    """records: id, item (variant). Quads of all operations, as a set."""
    entity = F.concat(F.lit(f"{base}entity/"), percent_encode(F.col("id")))
    node = lambda kind, value: F.concat(F.lit(f"{base}{kind}/"), value)
    item = F.col("item")
    g = f"{base}graph/{graph}"
    name = lambda p: f"{base}{p}"
    single, frames = [quad(g, entity, name("type"), F.lit(name("Entity")), "iri")], []
    for o in compile_plan(operations):
        value = _at(item, o.path, "string")
        if o.op == "copy_scalar":
            single.append(quad(g, entity, name(o.property), lexical(value, o.datatype), "literal", o.datatype))
        elif o.op == "concept_by_normalized_value":
            concept = F.when(F.trim(value) != "", node("concept", concept_key(value)))
            single += [quad(g, entity, name(o.property), concept, "iri"), quad(g, F.coalesce(concept, F.lit("")), name("label"), F.when(concept.isNotNull(), value), "literal", "string")]
        elif o.op == "reference_by_business_id":
            single.append(quad(g, entity, name(o.property), F.when(value != "", node(o.target or "entity", percent_encode(value))), "iri"))
        elif o.op == "object_fields":
            inner = F.concat(entity, F.lit("/" + o.property))
            single.append(quad(g, entity, name(o.property), F.when(F.try_variant_get(item, "$" + o.path.replace("/", "."), "variant").isNotNull(), inner), "iri"))
            single += [quad(g, inner, name(f), lexical(_at(item, o.path + p, "string"), "string"), "literal", "string") for p, f in o.fields]
        elif o.op == "reify_array_membership":
            members = records.select(entity.alias("e"), F.posexplode(_at(item, o.path, "array<string>")).alias("i", "m"))
            link = F.concat("e", F.lit(f"/{o.property}/"), F.col("i").cast("string"))
            frames.append(emit(members, [quad(g, F.col("e"), name(o.property), link, "iri"), quad(g, link, name("position"), F.col("i") + 1, "literal", "integer"), quad(g, link, name("member"), node(o.target or "entity", percent_encode(F.col("m"))), "iri")]))
        elif o.op == "require_consensus":
            seen = records.select(entity.alias("e"), lexical(value, o.datatype).alias("v")).filter("v != ''").distinct().groupBy("e").agg(F.count("*").alias("n"), F.min("v").alias("v")).filter("n = 1")
            frames.append(emit(seen, [quad(g, F.col("e"), name(o.property), F.col("v"), "literal", o.datatype)]))
    return as_set(emit(records, single), *frames)
