"""Records with their sources as quads: the schema's own statements, documents, records and
fragments, entities and observations by mappings; replay of stored fragments against their
documents; navigation of a graph along checked paths. Mappings and schemas are plain data."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_paths import deep_select, fragments, json_sha256
from ..functions.text import percent_encode
from ..functions.values import lexical
from ..operators.graph import as_set, emit, quad

TYPE, LABEL, SUBCLASS = "rdf:type", "rdfs:label", "rdfs:subClassOf"


@dataclass(frozen=True)
class Property:
    domain: str
    range: str


@dataclass
class Schema:
    """Classes by name with their parent ('' for none); properties between classes, and to values."""

    classes: dict[str, str]
    objects: dict[str, Property] = field(default_factory=dict)
    datatypes: dict[str, Property] = field(default_factory=dict)

    def below(self, name: str) -> Iterable[str]:
        """The class and all above it; a circle of parents ends."""
        seen = []
        while name and name not in seen:
            seen.append(name)
            name = self.classes.get(name, "")
        return seen


def schema_quads(spark: SparkSession, schema: Schema, base: str) -> DataFrame:
    """Types, labels, parents, domains and ranges; names that the schema doesn't define are left
    out. Rows of the schema's size."""
    g, rows = f"{base}graph/schema", []
    for name, parent in schema.classes.items():
        rows += [(name, TYPE, "owl:Class", "iri", ""), (name, LABEL, name, "literal", "string")]
        if parent in schema.classes:
            rows.append((name, SUBCLASS, base + parent, "iri", ""))
    for kind, properties in (("owl:ObjectProperty", schema.objects), ("owl:DatatypeProperty", schema.datatypes)):
        for name, p in properties.items():
            rows.append((name, TYPE, kind, "iri", ""))
            if p.domain in schema.classes:
                rows.append((name, "rdfs:domain", base + p.domain, "iri", ""))
            if p.range in schema.classes or p.range.startswith("xsd:"):
                rows.append((name, "rdfs:range", p.range if p.range.startswith("xsd:") else base + p.range, "iri", ""))
    return spark.createDataFrame([(g, base + s, p, v, k, d) for s, p, v, k, d in rows], "graph string, subject string, predicate string, value string, kind string, datatype string")


def short_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))), 256), 1, 24)


def source_quads(documents: DataFrame, records: DataFrame, base: str, walked: DataFrame | None = None) -> DataFrame:
    """documents: path, source; records: path, pointer, hash; walked: path, record (pointer),
    pointer, kind, value. Documents without records are stated too. Joins nothing: every node's
    name follows from its own row."""
    g, p = f"{base}graph/source", lambda name: base + name
    document = F.concat(F.lit(f"{base}document/"), short_id(F.col("path")))
    record = lambda at: F.concat(F.lit(f"{base}record/"), short_id(F.col("path"), F.col(at)))
    frames = [
        emit(documents, [quad(g, document, TYPE, F.lit(p("SourceDocument")), "iri"), quad(g, document, p("sourceSystem"), F.col("source"), "literal", "string"), quad(g, document, p("sourcePath"), F.col("path"), "literal", "string")]),
        emit(records, [quad(g, record("pointer"), TYPE, F.lit(p("SourceRecord")), "iri"), quad(g, record("pointer"), p("recordFromDocument"), document, "iri"), quad(g, record("pointer"), p("recordHash"), F.col("hash"), "literal", "string"), quad(g, record("pointer"), p("recordJsonPointer"), F.col("pointer"), "literal", "string")]),
    ]
    if walked is not None:
        fragment = F.concat(F.lit(f"{base}fragment/"), short_id(F.col("path"), F.col("pointer")))
        frames.append(emit(walked, [quad(g, fragment, TYPE, F.lit(p("SourceFragment")), "iri"), quad(g, record("record"), p("recordHasFragment"), fragment, "iri"), quad(g, fragment, p("fragmentFromDocument"), document, "iri"), quad(g, fragment, p("jsonPointer"), F.col("pointer"), "literal", "string"), quad(g, fragment, p("valueKind"), F.col("kind"), "literal", "string")]))
    return as_set(*frames)


@dataclass(frozen=True)
class Scalar:
    path: str
    property: str
    datatype: str = "string"
    subject: str = "entity"  # or observation


@dataclass(frozen=True)
class Relation:
    """``id`` and ``label``: fields of objects; texts are both themselves."""

    path: str
    property: str
    target: str
    id: str = "id"
    label: str = "name"


def project(items: DataFrame, schema: Schema, entity_class: str, observation_class: str, scalars: list[Scalar], relations: list[Relation], base: str) -> DataFrame:
    """items: source, source_id, path, rank, data (variant). An entity and an observation of every
    item, its mapped values, and the concepts it refers to; one pass for all that is single, one
    for each mapping of many."""
    for m in (*scalars, *relations):
        known = schema.datatypes if isinstance(m, Scalar) else schema.objects
        if m.property not in known:
            raise ValueError(f"no property {m.property}")
    p = lambda name: base + name
    domain, observed = f"{base}graph/domain", f"{base}graph/observation"
    entity = F.concat(F.lit(f"{base}entity/"), percent_encode(F.col("source_id")))
    observation = F.concat(F.lit(f"{base}observation/"), short_id(F.col("source"), F.col("source_id")))
    single = [quad(domain, entity, TYPE, F.lit(p(entity_class)), "iri"), quad(domain, entity, p("sourceId"), F.col("source_id"), "literal", "string"), quad(observed, observation, TYPE, F.lit(p(observation_class)), "iri"), quad(observed, observation, p("observesEntity"), entity, "iri"), quad(observed, observation, p("resultRank"), F.col("rank"), "literal", "positiveInteger")]
    frames = [emit(items, single)]
    named = items.select(entity.alias("e"), observation.alias("o"), "data")
    for m in scalars:
        values = named.select("e", "o", F.explode(deep_select(F.col("data"), m.path)).alias("v"))
        text = lexical(F.try_variant_get("v", "$", "string"), m.datatype)
        plain = F.when(~F.schema_of_variant("v").rlike("^(ARRAY|OBJECT|VOID)") & (text != ""), text)
        on, at = (domain, "e") if m.subject == "entity" else (observed, "o")
        frames.append(emit(values, [quad(on, F.col(at), p(m.property), plain, "literal", m.datatype)]))
    for m in relations:
        values = named.select("e", F.explode(deep_select(F.col("data"), m.path)).alias("v"))
        either = lambda f: F.coalesce(F.nullif(F.try_variant_get("v", f"$.{f}", "string"), F.lit("")), F.when(F.schema_of_variant("v") == "STRING", F.nullif(F.trim(F.try_variant_get("v", "$", "string")), F.lit(""))))
        known = values.select("e", either(m.id).alias("i"), either(m.label).alias("l")).filter("i is not null")
        target = F.concat(F.lit(f"{base}concept/{m.target}/"), short_id(F.col("i")))
        frames.append(emit(known, [quad(domain, target, TYPE, F.lit(p(m.target)), "iri"), quad(domain, F.col("e"), p(m.property), target, "iri"), quad(domain, target, LABEL, F.col("l"), "literal", "string")]))
    return as_set(*frames)


def replay(stored: DataFrame, documents: DataFrame, key: str, text: str) -> DataFrame:
    """stored: key, pointer, hash. Pointers that the documents no longer have (gone), or whose
    content differs (changed): (key, pointer, state). Every fragment is hashed where its document
    is walked; the join moves hashes, not texts."""
    now = fragments(documents, key, text).select(key, "pointer", json_sha256(F.col("value")).alias("now"))
    both = stored.join(now, [key, "pointer"], "left")
    return both.filter(~F.col("hash").eqNullSafe(F.col("now"))).select(key, "pointer", F.when(F.col("now").isNull(), "gone").otherwise("changed").alias("state"))


def executable_path(schema: Schema, start: str, steps: list[str]) -> str | None:
    """The class or datatype that a path of properties ends in (``^``: backwards), or null where a
    step doesn't fit the class it is at. A value ends a path and has no way back."""
    at, value = start, None
    if start not in schema.classes:
        return None
    for step in steps:
        back, name = step.startswith("^"), step.removeprefix("^")
        p = schema.objects.get(name) or (None if back else schema.datatypes.get(name))
        if value or p is None or (p.range if back else p.domain) not in schema.below(at):
            return None
        if name in schema.objects:
            at = p.domain if back else p.range
        else:
            value = p.range
    return value or at


def navigate(quads: DataFrame, schema: Schema, start: str, steps: list[str], base: str) -> DataFrame:
    """(subject, value) pairs along a path that the schema allows; a join a step."""
    if executable_path(schema, start, steps) is None:
        raise ValueError(f"path not executable from {start}: {'/'.join(steps)}")
    found = quads.filter((F.col("predicate") == TYPE) & (F.col("value") == base + start)).select("subject", F.col("subject").alias("value")).distinct()
    for step in steps:
        edges = quads.filter(F.col("predicate") == base + step.removeprefix("^"))
        a, b = ("value", "subject") if step.startswith("^") else ("subject", "value")
        edges = edges.select(F.col(a).alias("_from"), F.col(b).alias("_to")).distinct()
        found = found.join(edges, found["value"] == edges["_from"]).select("subject", F.col("_to").alias("value")).distinct()
    return found


def competency_coverage(schema: Schema, questions: dict[str, list[tuple[str, list[str]]]]) -> dict[str, dict]:
    """By question: covered where one of its paths (start, steps) is executable, and where those
    end."""
    out = {}
    for name, paths in questions.items():
        ends = {f"{start}/{'/'.join(steps)}": executable_path(schema, start, steps) for start, steps in paths}
        fine = {k: v for k, v in ends.items() if v is not None}
        out[name] = {"status": "covered" if fine else "not_covered", "paths": fine}
    return out


def compose(base: Schema, *parts: Schema) -> Schema:
    """One schema of several: what an earlier one defines stays, classes that properties name but
    none defines are added, and a property of different ranges ends in their nearest common class
    (in text, where values differ)."""
    out = Schema(dict(base.classes), dict(base.objects), dict(base.datatypes))
    for part in parts:
        for name, parent in part.classes.items():
            out.classes.setdefault(name, parent)
    for part in parts:
        for name, p in part.objects.items():
            q = out.objects.get(name, p)
            common = [c for c in out.below(q.range) if c in out.below(p.range)]
            out.objects[name] = Property(q.domain, q.range if q.range == p.range else common[0] if common else "Thing")
        for name, p in part.datatypes.items():
            q = out.datatypes.get(name, p)
            out.datatypes[name] = Property(q.domain, q.range if q.range == p.range else "xsd:string")
    for p in [*out.objects.values(), *out.datatypes.values()]:
        for c in (p.domain, p.range):
            if not c.startswith("xsd:"):
                out.classes.setdefault(c, "")
    return out


def canonical_names(schema: Schema, aliases: dict[str, str]) -> Schema:
    """Properties by their canonical names; where both an alias and its name are declared, the
    canonical declaration stays."""
    def renamed(properties):
        out = {aliases[n]: p for n, p in properties.items() if n in aliases}
        return out | {n: p for n, p in properties.items() if n not in aliases}

    return Schema(dict(schema.classes), renamed(schema.objects), renamed(schema.datatypes))
