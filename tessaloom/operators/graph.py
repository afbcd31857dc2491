"""Quads (graph, subject, predicate, value, kind, datatype): making, serialising, checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("graph", "subject", "predicate", "value", "kind", "datatype")


def iri(base: str, *parts: Column) -> Column:
    from ..functions.text import percent_encode

    return F.concat(F.lit(base), *[x for i, p in enumerate(parts) for x in ((F.lit("/"), percent_encode(p.cast("string"))) if i else (percent_encode(p.cast("string")),))])


def quad(graph: str | Column, subject: Column, predicate: str, value: Column, kind: str, datatype: str = "") -> Column:
    graph = F.lit(graph) if isinstance(graph, str) else graph
    return F.struct(graph.alias("graph"), subject.alias("subject"), F.lit(predicate).alias("predicate"), value.cast("string").alias("value"), F.lit(kind).alias("kind"), F.lit(datatype).alias("datatype"))


def emit(df: DataFrame, quads: list[Column]) -> DataFrame:
    """All quads of every row in one pass; those without a value are left out."""
    return df.select(F.explode(F.filter(F.array(*quads), lambda q: q["value"].isNotNull())).alias("q")).select("q.*")


def as_set(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.dropDuplicates(list(COLUMNS))


def triples(quads: DataFrame) -> DataFrame:
    return quads.drop("graph").distinct()


def graph_metrics(quads: DataFrame) -> DataFrame:
    """Quads by predicate and by graph, and the number of triples, as (scope, name, n)."""
    by = lambda c: quads.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(c).alias("scope"), "name", "n")
    return by("predicate").unionByName(by("graph")).unionByName(triples(quads).agg(F.count("*").alias("n")).select(F.lit("triples").alias("scope"), F.lit("").alias("name"), "n"))


def escape_literal(c: Column) -> Column:
    for raw, mark in (("\\", "\\\\"), ("\t", "\\t"), ("\b", "\\b"), ("\n", "\\n"), ("\r", "\\r"), ("\f", "\\f"), ('"', '\\"')):
        c = F.replace(c, F.lit(raw), F.lit(mark))
    return c


def object_term(value: str = "value", kind: str = "kind", datatype: str = "datatype") -> Column:
    literal = F.concat(F.lit('"'), escape_literal(F.col(value)), F.lit('"'), F.when(F.col(datatype) != "", F.concat(F.lit("^^<"), F.col(datatype), F.lit(">"))).otherwise(""))
    return F.when(F.col(kind) == "iri", F.concat(F.lit("<"), F.col(value), F.lit(">"))).otherwise(literal)


def nquads(quads: DataFrame) -> DataFrame:
    return quads.select(F.concat(F.lit("<"), "subject", F.lit("> <"), "predicate", F.lit("> "), object_term(), F.lit(" <"), "graph", F.lit("> .")).alias("line"))


def ntriples(quads: DataFrame) -> DataFrame:
    return triples(quads).select(F.concat(F.lit("<"), "subject", F.lit("> <"), "predicate", F.lit("> "), object_term(), F.lit(" .")).alias("line"))


def rdf_xml(quads: DataFrame) -> DataFrame:
    """One description a subject, properties in order."""
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    local, space = F.regexp_extract("predicate", r"([A-Za-z_][\w.-]*)$", 1), F.regexp_extract("predicate", r"^(.*?)[A-Za-z_][\w.-]*$", 1)
    opened = F.concat(F.lit("<p:"), local, F.lit(' xmlns:p="'), escape(space), F.lit('"'))
    body = F.when(F.col("kind") == "iri", F.concat(opened, F.lit(' rdf:resource="'), escape(F.col("value")), F.lit('"/>'))).otherwise(F.concat(opened, F.when(F.col("datatype") != "", F.concat(F.lit(' rdf:datatype="'), escape(F.col("datatype")), F.lit('"'))).otherwise(""), F.lit(">"), escape(F.col("value")), F.lit("</p:"), local, F.lit(">")))
    return triples(quads).select("subject", body.alias("b")).groupBy("subject").agg(F.array_join(F.array_sort(F.collect_list("b")), "").alias("b")).select("subject", F.concat(F.lit('<rdf:Description rdf:about="'), escape(F.col("subject")), F.lit('">'), "b", F.lit("</rdf:Description>")).alias("xml"))


def read_nquads(lines: DataFrame, column: str = "value") -> DataFrame:
    shape = r'^<([^>]*)> <([^>]*)> (?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>)?) <([^>]*)> \.$'
    g = lambda i: F.regexp_extract(column, shape, i)
    is_iri = g(3) != ""
    literal = g(4)
    for raw, mark in (("\t", "\\t"), ("\b", "\\b"), ("\n", "\\n"), ("\r", "\\r"), ("\f", "\\f"), ('"', '\\"')):
        literal = F.replace(literal, F.lit(mark), F.lit(raw))
    literal = F.replace(literal, F.lit("\\\\"), F.lit("\\"))
    return lines.filter(F.col(column).rlike(shape)).select(g(6).alias("graph"), g(1).alias("subject"), g(2).alias("predicate"), F.when(is_iri, g(3)).otherwise(literal).alias("value"), F.when(is_iri, "iri").otherwise("literal").alias("kind"), g(5).alias("datatype"))


def reference_only(referenced: DataFrame, observed: DataFrame, column: str) -> DataFrame:
    return referenced.select(column).distinct().join(observed.select(column).distinct(), column, "left_anti")


def subclass_closure(spark, subclasses: DataFrame, most: int = 64) -> DataFrame:
    """(sub, super) with every class above itself, transitively; cycles end."""
    classes = subclasses.select(F.col("sub").alias("c")).union(subclasses.select("super")).distinct()
    closure = classes.select(F.col("c").alias("sub"), F.col("c").alias("super")).unionByName(subclasses.select("sub", "super")).distinct()
    for _ in range(most):  # doubling: a chain of n classes takes log2 n steps
        wider = closure.alias("a").join(closure.alias("b"), F.col("a.super") == F.col("b.sub")).select("a.sub", "b.super").distinct()
        if wider.count() == closure.count():
            return closure
        closure = wider
    return closure


def domain_range_violations(quads: DataFrame, types: DataFrame, rules: DataFrame, closure: DataFrame) -> DataFrame:
    """Quads whose subject isn't of the predicate's domain, or whose object isn't of its range.
    rules: predicate, domain, range (of iri objects). Rules and closure are schema-sized."""
    typed = types.join(closure, types["class"] == closure["sub"]).select("subject", F.col("super").alias("class")).distinct()
    bound = quads.filter("kind = 'iri'").join(rules, "predicate")
    side = lambda at, rule, name: bound.join(typed.select(F.col("subject").alias(at), F.col("class").alias(rule)), [at, rule], "left_anti").select("predicate", "subject", "value", F.lit(name).alias("violation"))
    return side("subject", "domain", "domain").unionByName(side("value", "range", "range").select("predicate", "subject", "value", "violation"))


def cardinality_violations(subjects: DataFrame, quads: DataFrame, shapes: DataFrame) -> DataFrame:
    """Per subject of a class and shape (class, predicate, least, most): counts out of bounds."""
    counts = quads.groupBy("subject", "predicate").agg(F.count("*").alias("n"))
    wanted = subjects.join(shapes, "class")
    return wanted.join(counts, ["subject", "predicate"], "left").withColumn("n", F.coalesce("n", F.lit(0))).filter((F.col("n") < F.col("least")) | (F.col("n") > F.col("most"))).select("subject", "predicate", "n")


def metric_check(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Metrics that differ or that one side lacks: (name, expected, actual)."""
    both = expected.select("name", F.col("n").alias("expected")).join(actual.select("name", F.col("n").alias("actual")), "name", "full_outer")
    return both.filter(~F.col("expected").eqNullSafe(F.col("actual")))


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one frame but not in the other; none when both are the same set."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))
