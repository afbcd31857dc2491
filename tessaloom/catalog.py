"""The registered queries of the library and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import json_paths
from .functions.html import page_parts
from .operators import acquire, finance, graph, grounding, profiles, registry
from .sources import bounded_sql
from .sources.files import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _join_sql(left: str, right: str, a: str, b: str) -> str:
    return f"""
WITH l AS (SELECT trim(CAST({a} AS VARCHAR)) AS k, count(*) AS n FROM {left} WHERE trim(CAST({a} AS VARCHAR)) <> '' GROUP BY 1),
     r AS (SELECT trim(CAST({b} AS VARCHAR)) AS k, count(*) AS m FROM {right} WHERE trim(CAST({b} AS VARCHAR)) <> '' GROUP BY 1),
     j AS (SELECT n, m FROM l FULL JOIN r USING (k)),
     s AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS left_rows, CAST(coalesce(sum(m), 0) AS BIGINT) AS right_rows, count(n) AS left_keys, count(m) AS right_keys,
                  CAST(coalesce(sum(n) FILTER (m IS NOT NULL), 0) AS BIGINT) AS matched_left_rows, count(*) FILTER (n IS NOT NULL AND m IS NOT NULL) AS matched_keys FROM j)
SELECT *, CASE WHEN left_rows = 0 THEN 1.0 ELSE round(CAST(matched_left_rows AS DOUBLE) / left_rows, 9) END AS row_coverage,
       CASE WHEN left_keys = 0 THEN 1.0 ELSE round(CAST(matched_keys AS DOUBLE) / left_keys, 9) END AS key_coverage,
       left_rows = left_keys AS left_unique, right_rows = right_keys AS right_unique,
       CASE WHEN left_rows = left_keys THEN 'one' ELSE 'many' END || '_to_' || CASE WHEN right_rows = right_keys THEN 'one' ELSE 'many' END AS cardinality FROM s"""


@query(_join_sql("orders", "customer", "o_custkey", "c_custkey"))
def profile_join_orders_customer(s, d):
    return profiles.profile_join(table(s, d, "orders"), table(s, d, "customer"), ["o_custkey"], ["c_custkey"])


@query(_join_sql("lineitem", "part", "l_partkey", "p_partkey"))
def profile_join_lineitem_part(s, d):
    return profiles.profile_join(table(s, d, "lineitem"), table(s, d, "part"), ["l_partkey"], ["p_partkey"])


_STAR = (("nation", "region", "n_regionkey", "r_regionkey"), ("customer", "nation", "c_nationkey", "n_nationkey"), ("supplier", "nation", "s_nationkey", "n_nationkey"), ("orders", "customer", "o_custkey", "c_custkey"))


def _suffix_pairs(left: list[str], right: list[str]) -> list[tuple[str, str]]:
    """Columns that are the same *key after the table's letter, where the right side owns it."""
    return [(a, b) for a in left for b in right if a.endswith("key") and a.split("_", 1)[-1] == b.split("_", 1)[-1]]


def _discovery_sql() -> str:
    cols = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"]}
    parts = [f"SELECT '{a}' AS left_table, '{b}' AS right_table, '{x}' AS left_column, '{y}' AS right_column, * FROM ({_join_sql(a, b, x, y)})" for a in sorted(cols) for b in sorted(cols) if a != b for x in cols[a] for y in cols[b] if x[2:] == y[2:]]
    return " UNION ALL ".join(parts)


@query(_discovery_sql())
def join_discovery(s, d):
    return profiles.discover_joins({t: table(s, d, t) for t in TABLES}, _suffix_pairs)


_FIT_SQL = {
    "boolean": r"regexp_full_match(lower(trim(value)), 'true|false')",
    "integer": r"regexp_full_match(value, '[+-]?[0-9]+')",
    "number": r"regexp_full_match(value, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')",
    "date": r"(regexp_full_match(trim(value), '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(trim(value) AS DATE) IS NOT NULL)",
    "datetime": r"(regexp_full_match(trim(value), '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2})?') AND try_cast(trim(value) AS TIMESTAMPTZ) IS NOT NULL)",
    "json_array": r"(ltrim(value)[1] = '[' AND json_valid(value))",
    "json_object": r"(ltrim(value)[1] = '{' AND json_valid(value))",
}


def _columns_sql(name: str, columns: dict[str, str]) -> str:
    cells = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {e} AS value FROM {name}" for c, e in columns.items())
    fits = ", ".join(f"count(*) FILTER (f AND {e}) AS fits_{k}" for k, e in _FIT_SQL.items())
    cases = " ".join(f"WHEN fits_{k} = nonblank THEN '{k}'" for k in _FIT_SQL)
    return f"""WITH c AS ({cells}), x AS (SELECT *, coalesce(trim(value) <> '', false) AS f FROM c),
  p AS (SELECT "column", count(*) AS inspected, count(*) FILTER (f) AS nonblank, count(*) FILTER (NOT f) AS blank, count(DISTINCT value) FILTER (f) AS distinct_nonblank,
        count(*) FILTER (f) - count(DISTINCT value) FILTER (f) AS duplicate_nonblank, CAST(coalesce(max(length(value)) FILTER (f), 0) AS BIGINT) AS max_length, {fits} FROM x GROUP BY 1)
SELECT *, CASE WHEN nonblank = 0 THEN 'unknown' {cases} ELSE 'string' END AS inferred FROM p"""


@query(_columns_sql("events", {c: f"CAST({c} AS VARCHAR)" for c in ("event_id", "user_id", "event_type", "props")} | {"ts": "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')", "value": "CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR)"}))
def profile_columns_events(s, d):
    """Times and amounts as texts of one form, as engines print them differently."""
    e = table(s, d, "events")
    return profiles.profile_columns(e.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).withColumn("value", F.col("value").cast("decimal(18,2)").cast("string")))


@query(_columns_sql("documents", {c: f"CAST({c} AS VARCHAR)" for c in ("doc_id", "text", "lang", "source", "n_chars")}))
def profile_columns_documents(s, d):
    return profiles.profile_columns(table(s, d, "documents"))


def _identity_sql(name: str, keys: list[str]) -> str:
    filled = " AND ".join(f"trim(CAST({k} AS VARCHAR)) <> ''" for k in keys)
    return f"""WITH k AS (SELECT count(*) AS n FROM {name} WHERE {filled} GROUP BY {", ".join(keys)}), t AS (SELECT count(*) AS "rows" FROM {name}),
  a AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS complete_rows, count(*) AS distinct_keys, count(*) FILTER (n > 1) AS duplicate_groups,
        CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows, coalesce(max(n), 0) AS max_multiplicity FROM k),
  u AS (SELECT *, "rows" - complete_rows AS incomplete_rows, "rows" > 0 AND complete_rows = "rows" AND distinct_keys = "rows" AS row_unique FROM t, a)
SELECT *, CASE WHEN row_unique THEN 'row_primary_key' ELSE 'entity_merge_key' END AS semantics FROM u"""


@query(_identity_sql("lineitem", ["l_orderkey", "l_linenumber"]))
def profile_identity_lineitem(s, d):
    return profiles.profile_identity(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(_identity_sql("orders", ["o_orderkey"]))
def profile_identity_orders(s, d):
    return profiles.profile_identity(table(s, d, "orders"), ["o_orderkey"])


@query("SELECT CAST(14 AS BIGINT) AS tables, CAST(14 AS BIGINT) AS nonempty, CAST(" + " + ".join(f"(SELECT count(*) FROM {t})" for t in TABLES) + ' AS BIGINT) AS "rows"')
def catalog_totals(s, d):
    return profiles.catalog_totals({t: table(s, d, t) for t in TABLES})


@query("""WITH f AS (SELECT event_type, event_id, '' AS pointer, 'object' AS kind FROM events UNION ALL SELECT event_type, event_id, '/' || unnest(json_keys(props)), 'integer' FROM events)
SELECT event_type, pointer AS pattern, count(*) AS occurrences, min(kind) AS kinds, count(DISTINCT event_id) AS documents, min(pointer) AS samples FROM f GROUP BY 1, 2""")
def path_profile_events(s, d):
    f = json_paths.fragments(table(s, d, "events"), "event_id", "props").join(table(s, d, "events").select("event_id", "event_type"), "event_id")
    return profiles.path_profile(f, "event_id", ["event_type"]).select("event_type", "pattern", "occurrences", F.array_join("kinds", ",").alias("kinds"), "documents", F.array_join("samples", ",").alias("samples"))


@query("SELECT event_id, '' AS pointer, '' AS pattern, 'object' AS kind, replace(props, ' ', '') AS value FROM events UNION ALL SELECT event_id, '/k', '/k', 'integer', json_extract_string(props, '$.k') FROM events")
def json_fragments_events(s, d):
    return json_paths.fragments(table(s, d, "events"), "event_id", "props")


@query("""WITH x AS (SELECT user_id AS e, 'event_type' AS field, event_type AS v FROM events UNION SELECT user_id, 'day', CAST(CAST(ts AS DATE) AS VARCHAR) FROM events),
  c AS (SELECT e, field, count(DISTINCT v) AS n FROM x WHERE e IS NOT NULL GROUP BY 1, 2)
SELECT field, count(*) FILTER (n = 0) AS missing, count(*) FILTER (n = 1) AS consensus, count(*) FILTER (n > 1) AS conflict FROM c GROUP BY 1""")
def field_consensus(s, d):
    return profiles.field_consensus(table(s, d, "events").withColumn("day", F.to_date("ts")), "user_id", ["event_type", "day"])


@query("SELECT o_custkey AS entity, count(DISTINCT o_orderstatus) AS \"values\", CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS agreed FROM orders WHERE o_orderstatus <> '' AND o_custkey IS NOT NULL GROUP BY 1")
def consensus_projection(s, d):
    return profiles.consensus_projection(table(s, d, "orders"), "o_custkey", "o_orderstatus")


@query("""WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N'), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'N')
SELECT (SELECT count(*) FROM a) AS authoritative, (SELECT count(*) FROM b) AS corroborating, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS common,
  (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS authority_only, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS corroborating_only""")
def relation_compare(s, d):
    l = table(s, d, "lineitem")
    return profiles.relation_compare(l.filter("l_returnflag = 'N'"), l.filter("l_returnflag <> 'N'"), ["l_partkey", "l_suppkey"])


@query("SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-12 12:00:00'")
def window_exact_range(s, d):
    return acquire.exact_range(table(s, d, "events"), "ts", "2024-01-10", "2024-01-12 12:00:00").select("event_id", "ts", "event_type")


@query("""WITH f AS (SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-20 09:00:00'), m AS (SELECT event_type, max(CAST(ts AS DATE)) AS last FROM f GROUP BY 1)
SELECT f.event_id, f.event_type, f.ts FROM f JOIN m USING (event_type) WHERE CAST(f.ts AS DATE) = m.last""")
def latest_on_or_before(s, d):
    return acquire.latest_on_or_before(table(s, d, "events"), "ts", ["event_type"], "2024-01-20 09:00:00").select("event_id", "event_type", "ts")


@query("SELECT doc_id FROM documents WHERE (contains(lower(text), 'token') OR contains(lower(text), 'license')) AND (contains(lower(text), 'the') OR contains(lower(text), 'der')) AND NOT contains(lower(text), 'gnu')")
def retrieval_filter(s, d):
    return acquire.retrieval_filter(table(s, d, "documents"), "text", ["token", "license"], ["the", "der"], ["gnu"]).select("doc_id")


@query("""WITH f AS (SELECT * FROM part WHERE contains(lower(concat_ws(' ', p_name, p_type)), 'steel') OR contains(lower(concat_ws(' ', p_name, p_type)), 'blue'))
SELECT p_partkey, p_retailprice, (SELECT count(*) FROM f) AS total FROM f ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 20""")
def topic_search_page(s, d):
    return acquire.search_page(table(s, d, "part"), ["p_name", "p_type"], ["steel", "blue"], [F.desc("p_retailprice"), "p_partkey"], page=2, size=20).select("p_partkey", "p_retailprice", "total")


@query("SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_wins_dedupe(s, d):
    return acquire.first_wins(table(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "ts")


@query("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_wins_index(s, d):
    return acquire.last_wins(table(s, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "ts")


@query("SELECT source, count(*) AS kept, max(doc_id // 50) AS pages, max(doc_id // 50) < 50 AS scan_complete FROM documents GROUP BY 1")
def scope_summary(s, d):
    return acquire.scan_summary(table(s, d, "documents").withColumn("page", F.expr("doc_id div 50")), "source", "page", 50)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def bounded_sql_rows(s, d):
    table(s, d, "orders").createOrReplaceTempView("bounded_sql_orders")
    return bounded_sql.bounded_sql(s, "SELECT o_orderkey, o_custkey, o_totalprice FROM bounded_sql_orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey")[0]


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) ELSE text END AS text, lang FROM documents")
def clip_cells(s, d):
    return bounded_sql.clip_cells(table(s, d, "documents").select("doc_id", "text", "lang"))


@query("SELECT conv_id, turn, running FROM (SELECT conv_id, turn, CAST(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM (SELECT conv_id, turn, max(text) AS text FROM conversations GROUP BY 1, 2)) WHERE running <= 2048")
def byte_budget(s, d):
    c = table(s, d, "conversations").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    return registry.byte_budget(c.withColumn("bytes", F.octet_length("text")), "conv_id", "turn", "bytes", 2048).select("conv_id", "turn", "running")


@query()
def html_text(s, d):
    p = page_parts("html")
    return table(s, d, "pages").select("page_id", p.alias("p")).select("page_id", "p.title", "p.text", F.size("p.tables").alias("tables"))


def _star_quads(s, d) -> DataFrame:
    base = "http://example.org/"
    g, q, iri = f"{base}g", graph.quad, lambda kind, c: graph.iri(f"{base}{kind}/", F.col(c))
    customers = graph.emit(table(s, d, "customer"), [q(g, iri("customer", "c_custkey"), f"{base}name", F.col("c_name"), "literal", "string"), q(g, iri("customer", "c_custkey"), f"{base}nation", iri("nation", "c_nationkey"), "iri")])
    orders = graph.emit(table(s, d, "orders"), [q(g, iri("order", "o_orderkey"), f"{base}status", F.col("o_orderstatus"), "literal", "string"), q(g, iri("order", "o_orderkey"), f"{base}customer", iri("customer", "o_custkey"), "iri")])
    nations = graph.emit(table(s, d, "nation"), [q(f"{base}ref", iri("nation", "n_nationkey"), f"{base}name", F.col("n_name"), "literal", "string")])
    return graph.as_set(customers, orders, nations)


_QUADS_SQL = """WITH q AS (
  SELECT 'http://example.org/g' AS graph, 'http://example.org/customer/' || c_custkey AS subject, 'http://example.org/name' AS predicate, c_name AS value, 'literal' AS kind, 'string' AS datatype FROM customer
  UNION SELECT 'http://example.org/g', 'http://example.org/customer/' || c_custkey, 'http://example.org/nation', 'http://example.org/nation/' || c_nationkey, 'iri', '' FROM customer
  UNION SELECT 'http://example.org/g', 'http://example.org/order/' || o_orderkey, 'http://example.org/status', o_orderstatus, 'literal', 'string' FROM orders
  UNION SELECT 'http://example.org/g', 'http://example.org/order/' || o_orderkey, 'http://example.org/customer', 'http://example.org/customer/' || o_custkey, 'iri', '' FROM orders
  UNION SELECT 'http://example.org/ref', 'http://example.org/nation/' || n_nationkey, 'http://example.org/name', n_name, 'literal', 'string' FROM nation) """


@query(_QUADS_SQL + "SELECT * FROM q WHERE value IS NOT NULL")
def quads_star(s, d):
    return _star_quads(s, d)


@query(_QUADS_SQL + "SELECT 'predicate' AS scope, predicate AS name, count(*) AS n FROM q GROUP BY 2 UNION ALL SELECT 'graph', graph, count(*) FROM q GROUP BY 2 UNION ALL SELECT 'triples', '', count(*) FROM (SELECT DISTINCT subject, predicate, value, kind, datatype FROM q)")
def rollup_counts_graph(s, d):
    return graph.graph_metrics(_star_quads(s, d))


@query(_QUADS_SQL + """SELECT '<' || subject || '> <' || predicate || '> ' || CASE WHEN kind = 'iri' THEN '<' || value || '>' ELSE '"' || replace(replace(value, '\\', '\\\\'), '"', '\\"') || '"^^<' || datatype || '>' END || ' <' || graph || '> .' AS line FROM q""")
def nquads_lines(s, d):
    return graph.nquads(_star_quads(s, d))


@query(_QUADS_SQL + "SELECT * FROM q")
def nquads_round_trip(s, d):
    return graph.read_nquads(graph.nquads(_star_quads(s, d)), "line")


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
def reference_only(s, d):
    return graph.reference_only(table(s, d, "orders").withColumnRenamed("o_orderkey", "k"), table(s, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k").withColumnRenamed("k", "o_orderkey")


@query(_QUADS_SQL + """SELECT predicate, subject, value, 'range' AS violation FROM q WHERE predicate = 'http://example.org/customer' AND value NOT IN (SELECT subject FROM q WHERE subject LIKE '%/customer/%' AND predicate = 'http://example.org/name' AND value LIKE '%1')
UNION ALL SELECT predicate, subject, value, 'domain' FROM q WHERE predicate = 'http://example.org/nation' AND NOT (subject IN (SELECT subject FROM q WHERE predicate = 'http://example.org/name' AND value LIKE '%1'))""")
def domain_range_violations(s, d):
    """Customers are typed only where their name ends in 1, so that violations are there to find."""
    b = "http://example.org/"
    q = _star_quads(s, d)
    customers = q.filter((F.col("predicate") == f"{b}name") & F.contains("subject", F.lit("/customer/")) & F.col("value").endswith("1")).select("subject", F.lit("Buyer").alias("class"))
    others = q.filter(F.contains("subject", F.lit("/order/"))).select("subject", F.lit("Order").alias("class")).unionByName(q.filter(F.contains("subject", F.lit("/nation/"))).select("subject", F.lit("Nation").alias("class"))).distinct()
    closure = graph.subclass_closure(s, s.createDataFrame([("Buyer", "Party"), ("Party", "Thing"), ("Order", "Thing"), ("Nation", "Thing")], "sub string, super string"))
    rules = s.createDataFrame([(f"{b}customer", "Order", "Party"), (f"{b}nation", "Party", "Nation")], "predicate string, domain string, range string")
    return graph.domain_range_violations(q, customers.unionByName(others), rules, closure)


@query("SELECT 'http://example.org/order/' || o_orderkey AS subject, 'http://example.org/line' AS predicate, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(l_orderkey) < 1 OR count(l_orderkey) > 6")
def shacl_cardinality(s, d):
    b = "http://example.org/"
    lines = graph.emit(table(s, d, "lineitem"), [graph.quad(f"{b}g", graph.iri(f"{b}order/", F.col("l_orderkey")), f"{b}line", F.col("l_linenumber"), "literal", "integer")])
    subjects = table(s, d, "orders").select(graph.iri(f"{b}order/", F.col("o_orderkey")).alias("subject"), F.lit("Order").alias("class")).distinct()
    return graph.cardinality_violations(subjects, lines, s.createDataFrame([("Order", f"{b}line", 1, 6)], "class string, predicate string, least int, most int"))


@query("""WITH n AS (SELECT doc_id AS row, lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) AS k FROM documents), f AS (SELECT k, min(row) AS first FROM n GROUP BY 1)
SELECT row, first FROM n JOIN f USING (k) WHERE row > first""")
def duplicate_texts(s, d):
    return grounding.duplicate_findings(table(s, d, "documents"), ["text"], "doc_id")


@query("SELECT l.doc_id, l.quality, d.lang, d.source FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l JOIN documents d USING (doc_id)")
def source_lineage_repair(s, d):
    rows = table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).select("doc_id", "quality", F.lit("").alias("lang"), F.lit(None).cast("string").alias("source"))
    return grounding.repair_rows(rows, table(s, d, "documents"), "doc_id", ["lang", "source"])


@query("SELECT doc_id, text IS NULL AS no_text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unlabelled_sources(s, d):
    return grounding.unknown_sources(table(s, d, "documents"), table(s, d, "labels"), "doc_id").select("doc_id", F.col("text").isNull().alias("no_text"))


@query("""WITH w AS (SELECT DISTINCT substr(c_name, 1, 17) AS wanted FROM customer), m AS (SELECT wanted, count(*) AS n, min(c_name) AS sole FROM w JOIN (SELECT DISTINCT c_name FROM customer) ON starts_with(lower(c_name), lower(wanted)) GROUP BY 1)
SELECT w.wanted, CASE WHEN c.c_name IS NOT NULL THEN c.c_name WHEN n = 1 THEN sole END AS resolved FROM w LEFT JOIN m USING (wanted) LEFT JOIN (SELECT DISTINCT c_name FROM customer) c ON c.c_name = w.wanted""")
def prefix_resolve(s, d):
    names = table(s, d, "customer").select(F.col("c_name").alias("name"))
    return grounding.prefix_resolve(names.select(F.substring("name", 1, 17).alias("name")), names, "name")


@query("SELECT user_id, ts, event_id, event_type, m AS created_at FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def state_latest(s, d):
    return registry.latest(table(s, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "ts")


@query("""SELECT event_id, user_id, CAST(sum(CAST(event_type = 'error' AS INTEGER)) OVER w - first_value(CAST(event_type = 'error' AS INTEGER)) OVER w + 1 AS BIGINT) AS attempt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def state_attempts(s, d):
    return registry.attempts(table(s, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id", "attempt")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, max(CAST(event_type = 'purchase' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM events) WHERE coalesce(o, 0) = 0")
def state_guarded(s, d):
    return registry.guarded_transitions(table(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", ["purchase"]).select("event_id", "user_id", "event_type")


@query("""WITH c AS (SELECT conv_id, count(*) AS n, arg_min(role, turn) AS f, count(*) FILTER (role = 'system') AS firsts FROM (SELECT DISTINCT conv_id, turn, role FROM conversations) GROUP BY 1)
SELECT conv_id, 'bad_start' AS issue FROM c WHERE f <> 'system' UNION ALL SELECT conv_id, 'repeated_start' FROM c WHERE firsts > 1 UNION ALL SELECT conv_id, 'too_many' FROM c WHERE n > 6""")
def call_sequence(s, d):
    return registry.sequence_issues(table(s, d, "conversations").select("conv_id", "turn", "role").distinct(), "conv_id", "turn", "role", "system", 6)


@query("SELECT user_id, CASE min(CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'view' THEN 4 WHEN 'click' THEN 5 END) WHEN 1 THEN 'error' WHEN 2 THEN 'signup' WHEN 3 THEN 'purchase' WHEN 4 THEN 'view' WHEN 5 THEN 'click' END AS status FROM events GROUP BY 1")
def status_summary(s, d):
    return registry.status_summary(table(s, d, "events"), "user_id", "event_type", ["error", "signup", "purchase", "view", "click"])


@query("SELECT user_id, count(*) AS failures FROM (SELECT *, max(event_id) FILTER (event_type <> 'error') OVER (PARTITION BY user_id) AS ok FROM events) WHERE ok IS NULL OR event_id > ok GROUP BY 1")
def retry_fold(s, d):
    return registry.retry_fold(table(s, d, "events").withColumn("ok", F.col("event_type") != "error"), "user_id", "event_id", "ok")


@query("SELECT doc_id, CAST(length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) AS BIGINT) AS chars, len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+')) AS words FROM documents")
def length_checks(s, d):
    return profiles.length_totals(table(s, d, "documents"), "doc_id", "text")


@query()
def schema_catalog(s, d):
    return bounded_sql.schema_catalog({t: table(s, d, t) for t in TABLES})


@query("SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first, arg_max(o_totalprice, o_orderkey) AS last, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1")
def first_last_series(s, d):
    return finance.first_last(table(s, d, "orders").filter("o_custkey is not null"), "o_custkey", "o_orderkey", "o_totalprice")


from . import catalog_more, catalog_scope, catalog_tables  # noqa: E402, F401  they register more
