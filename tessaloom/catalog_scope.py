"""Registered queries of acquired items, outcomes and projections. The tables' own columns are
dressed as items, calls and reports, so that the SQL knows the answer by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _QUADS_SQL, _star_quads, query
from .functions import json_paths, values
from .operators import finance, lineage, normalize, outcomes, scope, validation
from .plans import projection
from .sources.files import table


@query("""WITH e AS (SELECT event_id AS i, event_type AS t, CASE event_id % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'twitter' ELSE 'github' END AS source FROM events)
SELECT source, source || ':' || CASE WHEN source = 'news' THEN CAST(i AS VARCHAR) WHEN source = 'github' THEN 'http://r/' || i WHEN i % 2 = 0 THEN 't' || i ELSE substr(sha256('{"n": ' || i || ', "published_at": "x", "text": "' || t || '"}'), 1, 16) END AS source_id,
  t AS title, CASE source WHEN 'news' THEN TIMESTAMP '2024-01-04 16:00:00' WHEN 'github' THEN TIMESTAMP '2024-01-05 01:02:03' END AS published_at, CASE source WHEN 'github' THEN 'http://r/' || i END AS url FROM e""")
def scope_items(s, d):
    i, t = F.col("event_id"), F.col("event_type")
    made = F.when(i % 3 == 0, F.format_string('{"news_id":%d,"date":"2024-01-05","title":" %s ","url":" "}', i, t)).when(i % 3 == 2, F.format_string('{"url":"http://r/%d","title":"%s","published_at":"2024-01-05T01:02:03Z"}', i, t)).when(i % 2 == 0, F.format_string('{"tweet_post_id":"t%d","text":"%s"}', i, t)).otherwise(F.format_string('{"text":"%s","published_at":"x","n":%d}', t, i))
    source = F.element_at(F.array(*map(F.lit, ("news", "twitter", "github"))), (i % 3 + 1).cast("int"))
    rows = table(s, d, "events").select(source.alias("source"), F.parse_json(made).alias("item"))
    return scope.scope_items(rows).select("source", "source_id", "title", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "url")


_INDEX = "SELECT 's' || l_partkey AS source_id, l_returnflag AS source, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 't' || l_suppkey END AS title, 'u' || l_orderkey AS url, l_orderkey, l_linenumber FROM lineitem"


@query(f"SELECT 'all' AS which, source_id, source, title, url FROM ({_INDEX}) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY l_orderkey DESC, l_linenumber DESC, source DESC, title DESC, url DESC) = 1 UNION ALL SELECT 'strict', source_id, source, title, url FROM ({_INDEX}) WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY l_orderkey DESC, l_linenumber DESC, source DESC, title DESC, url DESC) = 1")
def source_index(s, d):
    l = table(s, d, "lineitem")
    items = l.select(F.format_string(" s%d", "l_partkey").alias("source_id"), F.col("l_returnflag").alias("source"), F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise(F.concat(F.lit("t"), "l_suppkey")).alias("title"), F.concat(F.lit("u"), "l_orderkey").alias("url"), "l_orderkey", "l_linenumber")
    both = [scope.source_index(items, ["l_orderkey", "l_linenumber"], strict).select(F.lit(name).alias("which"), "*") for name, strict in (("all", False), ("strict", True))]
    return both[0].unionByName(both[1])


@query("""SELECT 'u' || user_id AS source_id, '{"data": {"k": ' || arg_max(CAST(props::JSON->>'k' AS INTEGER), event_id) || '}, "published_at": null, "title": "' || arg_max(event_type, event_id) || '"}' AS evidence FROM events GROUP BY user_id""")
def evidence_texts(s, d):
    items = table(s, d, "events").select(F.concat(F.lit("u"), "user_id").alias("source_id"), F.parse_json("props").alias("data"), F.lit(None).cast("string").alias("published_at"), F.initcap("event_type").alias("title"), "event_id")
    return scope.evidence_texts(items, ["event_id"])


_NESTED = """n AS (SELECT 'e' || event_id AS identifier, 'outer ' || event_type AS title, '' AS url, event_id AS o, 0 AS p FROM events
  UNION ALL SELECT 'x:http://u/' || user_id, '', 'http://u/' || user_id, event_id, 1 FROM events UNION ALL SELECT 'http://u/' || user_id, '', 'http://u/' || user_id, event_id, 1 FROM events UNION ALL SELECT 'y' || user_id, 'inner ' || event_type, '', event_id, 2 FROM events),
  ix AS (SELECT identifier, coalesce(arg_min(title, (o, p)) FILTER (title <> ''), '') AS title, coalesce(arg_min(url, (o, p)) FILTER (url <> ''), '') AS url FROM n GROUP BY 1)"""


def _nested(s, d):
    made = F.format_string('{"id":"E%d","title":"outer  %s","a":[{"source_id":"x:http://u/%d/","link":"http://u/%d"},[{"paper_id":" Y%d ","name":"inner %s"},7]]}', "event_id", "event_type", "user_id", "user_id", "user_id", "event_type")
    found = scope.nested_records(table(s, d, "events").select("event_id", made.alias("j")), "event_id", "j")
    return scope.record_index(found, ["event_id", "place"])


@query(f"WITH {_NESTED} SELECT * FROM ix")
def nested_record_index(s, d):
    return _nested(s, d)


@query(f"""WITH {_NESTED}, f AS (SELECT user_id, min(title) AS t FROM events JOIN ix ON identifier = 'y' || user_id GROUP BY 1)
SELECT 'i' || user_id AS insight_id, 'T ' || user_id AS title, 'c' AS content, 'Own|http://Own/1;' || f.t || '|http://z/' || user_id AS sources FROM f""")
def public_insights(s, d):
    users = table(s, d, "events").select("user_id").distinct()
    ref = lambda sid, title, url: F.struct(sid.alias("source_id"), F.lit(None).cast("string").alias("id"), title.alias("title"), url.alias("url"))
    u, none = F.col("user_id"), F.lit(None).cast("string")
    refs = F.array(ref(none, F.lit(" Own "), F.lit("http://Own/1")), ref(none, F.lit("again"), F.lit("HTTP://own/1/")), ref(F.concat(F.lit("Y"), u), none, F.concat(F.lit("http://z/"), u)), ref(F.concat(F.lit("x:http://u/"), u), none, none), ref(F.lit("none"), F.lit("t"), none))
    insights = users.select(F.concat(F.lit("i"), u).alias("insight_id"), F.concat(F.lit(" T  "), u).alias("title"), F.lit("c").alias("thesis"), refs.alias("external_support"))
    shown = F.array_join(F.transform("sources", lambda x: F.concat_ws("|", x["title"], x["url"])), ";")
    return scope.public_insights(insights, _nested(s, d)).select("insight_id", "title", "content", shown.alias("sources"))


@query("SELECT l_returnflag AS source, count(*) AS total, 't' || max(l_orderkey) FILTER (l_linenumber > 1) AS trace_id FROM lineitem WHERE l_quantity <> 7 GROUP BY 1")
def envelope_headers(s, d):
    trace = F.when(F.col("l_linenumber") > 1, F.concat(F.lit("t"), "l_orderkey")).otherwise("")
    return scope.envelope_headers(table(s, d, "lineitem").select(F.col("l_returnflag").alias("source"), F.when(F.col("l_quantity") != 7, F.lit("{}")).alias("data"), trace.alias("trace_id"), "l_orderkey"), "l_orderkey")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def response_preview(s, d):
    return scope.preview(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"])


#: Code, message, stage, and the class that they must get.
_ERRORS = (
    ("intent_model_failed", "", "", "model_error", "intent_recognition_failed", True, "retry"),
    ("invalid_scope: x", "", "", "intent_error", "invalid_instruction", False, "revise_request"),
    ("source_modeling_raw_empty", "", "", "source_error", "no_data", False, "revise_request"),
    ("source_modeling_review_bad", "", "", "analysis_error", "ontology_review_rejected", False, "revise_request"),
    ("server_modeling_failed", "", "", "analysis_error", "ontology_build_failed", True, "retry"),
    ("internal_error", "Connection lost", "fetching_source", "source_error", "connection_failed", True, "retry"),
    ("internal_error", "timed out", "analyzing_with_agent", "model_error", "request_timeout", True, "retry_or_switch_model"),
    ("internal_error", "odd", "x", "service_error", "internal_error", True, "retry"),
    ("run_cancelled", "", "", "service_error", "service_shutdown", True, "retry"),
    ("server_configuration_invalid", "", "", "service_error", "configuration_invalid", False, "contact_administrator"),
    ("agent_binary_not_found", "", "", "service_error", "dependency_missing", False, "retry"),
    ("agent_model_error", "401", "", "model_error", "authentication_failed", False, "contact_administrator"),
    ("agent_x", "Max Retries", "", "model_error", "max_retries_exceeded", True, "retry_or_switch_model"),
    ("source_http_503", "", "", "source_error", "upstream_error", True, "retry"),
    ("source_network_error", "timeout", "", "source_error", "request_timeout", True, "retry"),
    ("agent_process_timeout", "", "", "analysis_error", "agent_timeout", True, "retry"),
    ("agent_process_nonzero_exit", "", "", "analysis_error", "agent_process_failed", True, "retry"),
    ("stage_artifact_invalid", "source url", "", "artifact_error", "source_reference_invalid", False, "revise_request"),
    ("x", "Invalid JSON", "", "artifact_error", "invalid_json", True, "retry"),
    ("agent_ontology_x", "", "", "analysis_error", "ontology_build_failed", True, "retry"),
    ("never_seen", "", "", "service_error", "internal_error", True, "retry"),
)


@query("SELECT n_nationkey, code, category, reason, retryable, action FROM nation, (VALUES " + ", ".join(f"('{c}', '{k}', '{r}', {again}, '{a}', '{m}')" for c, m, _, k, r, again, a in _ERRORS) + ") t(code, category, reason, retryable, action, m)")
def error_classes(s, d):
    cases = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(e, ("code", "message", "stage")))) for e in _ERRORS))
    rows = table(s, d, "nation").select("n_nationkey", F.explode(cases).alias("e")).select("n_nationkey", "e.*")
    return rows.select("n_nationkey", "code", outcomes.error_class(F.col("code"), F.col("message"), F.col("stage")).alias("c")).select("n_nationkey", "code", "c.*")


@query("SELECT event_id, CASE WHEN event_id % 100 >= 90 THEN 'validating_insights' WHEN event_id % 100 >= 40 THEN 'analyzing_with_agent' WHEN event_id % 100 >= 30 THEN 'source_ready' WHEN event_id % 100 >= 15 THEN 'fetching_source' WHEN event_id % 100 >= 5 THEN 'preparing_workspace' ELSE 'queued' END AS stage FROM events")
def failure_stages(s, d):
    return table(s, d, "events").select("event_id", outcomes.failure_stage(F.col("event_id") % 100, F.lit("failed")).alias("stage"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'search_arguments' WHEN 2 THEN 'search_arguments' WHEN 4 THEN 'get_arguments' WHEN 5 THEN 'get_arguments' WHEN 6 THEN 'unknown_tool' WHEN 7 THEN 'not_object' END AS issue FROM events""")
def argument_checks(s, d):
    made = ('{"reward":0,"limit":1,"job_id":"j"}', '{"reward":0,"limit":2}', '{"reward":0,"limit":1,"other":1}', '{"record_id":"r","fields":["trace"]}', '{"record_id":"r","fields":["trace","goal"]}', '{"record_id":"","fields":["goal"]}', "{}", "[]")
    tools = ("search", "search", "search", "get", "get", "get", "other", "search")
    at = (F.col("event_id") % 8 + 1).cast("int")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), at)
    return table(s, d, "events").select("event_id", outcomes.argument_issue(pick(tools), F.parse_json(pick(made)), ["trace", "goal"]).alias("issue"))


@query("SELECT event_id AS call_id, CASE WHEN event_id % 4 = 0 THEN 'error' ELSE 'ok' END AS transport, CASE WHEN event_id % 4 > 0 THEN props END AS envelope FROM events")
def call_log(s, d):
    e = table(s, d, "events").withColumnRenamed("event_id", "call_id")
    answers = e.filter("call_id % 4 > 0").select("call_id", F.lit("ok").alias("transport"), F.col("props").alias("envelope"))
    return outcomes.call_log(outcomes.reserved(e).unionByName(outcomes.filled(answers)))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(lag(o_orderkey) OVER w, -1) AS previous_o_orderkey, lag(o_orderstatus) OVER w AS previous_o_orderstatus FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def attempts_with_previous(s, d):
    return outcomes.with_previous(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus"]).fillna(-1, ["previous_o_orderkey"])


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def first_waiting_jobs(s, d):
    return outcomes.queue_order(table(s, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), "o_orderdate", "o_orderkey", F.col("o_orderstatus") == "O").drop("o_orderstatus").limit(50)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def newest_jobs(s, d):
    return outcomes.newest_first(table(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 20).select("o_orderkey")


@query(_QUADS_SQL + """, n AS (SELECT count(*) FILTER (predicate = 'http://example.org/status') AS st, count(*) FILTER (predicate = 'http://example.org/customer') AS cu FROM q)
SELECT * FROM (SELECT 'links' AS question, CASE WHEN st > 0 AND cu > 0 THEN 'pass' ELSE 'fail' END AS status, 'customers=' || cu || ',status=' || st AS evidence FROM n UNION ALL SELECT 'numbers', CASE WHEN st = 3 THEN 'pass' ELSE 'fail' END, 'status=' || st FROM n UNION ALL SELECT 'news', 'not_applicable', 'news=0' UNION ALL SELECT 'none', 'fail', 'x=0')""")
def competency_checks(s, d):
    m, base = outcomes.Measure, "http://example.org/"
    return outcomes.competency(_star_quads(s, d), [m("links", "status", f"{base}status"), m("links", "customers", f"{base}customer"), m("numbers", "status", f"{base}status", 3), m("news", "news", f"{base}news", 0, False), m("none", "x", f"{base}x")])


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'empty' WHEN 2 THEN 'not_json' WHEN 3 THEN 'not_list' END AS issue FROM events")
def output_checks(s, d):
    i = F.col("event_id") % 5
    text = F.when(i == 1, " \n").when(i == 2, F.concat("props", F.lit("}"))).when(i == 3, F.col("props")).when(i == 4, F.concat(F.lit("["), "props", F.lit("]")))
    return table(s, d, "events").select("event_id", outcomes.output_issue(text).alias("issue"))


@query("""SELECT o_orderkey AS report_id, code FROM orders, (VALUES ('objective_mismatch', 2), ('limitations_required', 3), ('limitations_mismatch', 5), ('status_mismatch', 7), ('unsupported_localization', 11)) t(code, n) WHERE o_orderkey % n = 0 AND (n <> 7 OR o_orderkey % 11 > 0) AND (n <> 11 OR o_orderkey % 7 > 0)
UNION ALL SELECT o_orderkey, code FROM orders, (VALUES ('insufficient_trace'), ('support_required')) t(code) WHERE o_orderkey % 77 = 0""")
def report_checks(s, d):
    """Located reports that were cut and have no success condition (ids of 77), others with a
    cause (of 11), or of a status that what was read doesn't allow (of 7)."""
    k = F.col("o_orderkey")
    located = k % 77 == 0
    limits = F.filter(F.array(F.lit("bounded_record_not_full_session"), F.when(k % 5 > 0, "granularity_unverified"), F.when(located, "truncated_output"), F.lit("success_condition_unknown"), F.lit("outcome_unknown"), F.when(k % 3 == 0, " ")), lambda x: x.isNotNull())
    text = lambda c, name: F.when(c, "x").alias(name)
    rows = table(s, d, "orders").select(k.alias("report_id"), F.when(located, "located").when(k % 7 == 0, "no_records").otherwise("insufficient_evidence").alias("status"), F.lit("o").alias("asked"), F.when(k % 2 == 0, "p").otherwise("o").alias("objective"), F.lit("u").alias("uncertainty"), limits.alias("limitations"), F.lit("ok").alias("read"), F.lit(False).alias("empty_get"), located.alias("truncated"), F.lit("present").alias("trace_state"), text(k % 11 == 0, "key_failure").alias("key_failure"), text(located, "direct_cause"), F.lit("g").alias("task_goal"), F.lit(None).cast("string").alias("success_condition"), F.lit(None).cast("string").alias("outcome"))
    # ids of 7 and 11 alone: 7 has no cause, 11 has one without being located
    return outcomes.report_issues(rows)


@query("SELECT event_id, kind, CASE kind WHEN 'string' THEN event_id % 6 = 0 WHEN 'integer' THEN event_id % 6 = 1 WHEN 'number' THEN event_id % 6 IN (1, 2) WHEN 'string_array' THEN event_id % 6 = 3 WHEN 'hotness' THEN event_id % 6 = 4 WHEN 'news_array' THEN event_id % 6 = 5 ELSE false END AS fits FROM events, (VALUES ('string'), ('integer'), ('number'), ('string_array'), ('hotness'), ('impact'), ('news_array')) t(kind)")
def contract_fits(s, d):
    made = ('"x"', "7", "1.5", '["a","b"]', '{"half_year":3,"day":1}', '[{"date":"d","title":"t","source":"s"}]')
    v = F.parse_json(F.element_at(F.array(*map(F.lit, made)), (F.col("event_id") % 6 + 1).cast("int")))
    kinds = ("string", "integer", "number", "string_array", "hotness", "impact", "news_array")
    rows = table(s, d, "events").select("event_id", v.alias("v"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), validation.fits_contract(F.col("v"), k).alias("fits")) for k in kinds))).alias("x")
    return rows.select("event_id", each).select("event_id", "x.*")


@query("SELECT event_id, code FROM events, (VALUES ('missing', 1), ('changed', 2), ('forbidden_key', 2), ('extra', 3)) t(code, n) WHERE event_id % 4 = n")
def seed_checks(s, d):
    e, i = table(s, d, "events"), F.col("event_id") % 4
    plan = e.filter(i != 1).select("event_id", F.when(i == 2, '{"iri":1}').otherwise(F.concat(F.lit(" "), "props")).alias("text"))
    return validation.seed_issues(plan, e.filter(i != 3).select("event_id", F.col("props").alias("text")), "event_id", ["value", "default", "code", "iri"])


@query("SELECT n_nationkey, e AS endpoint, k AS kind FROM nation, (VALUES ('/openapi/paper/search', 'paper'), ('/openapi/scholar/search', 'scholar'), ('/x/institutions/search', 'institution'), ('/i/7/funding-profile', 'funding'), ('/other', NULL)) t(e, k)")
def endpoint_kinds(s, d):
    shown = F.explode(F.array(*map(F.lit, ("/openapi/paper/search", "/openapi/scholar/search", "/x/institutions/search", "/i/7/funding-profile", "/other")))).alias("endpoint")
    return table(s, d, "nation").select("n_nationkey", shown).withColumn("kind", normalize.record_kind(F.col("endpoint")))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderdate AS DATE) - 3 WHEN 1 THEN CAST(o_orderdate AS DATE) - 1 WHEN 2 THEN make_date(CAST(year(o_orderdate) AS BIGINT), 3, 4) WHEN 3 THEN DATE '2023-11-05' WHEN 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END::TIMESTAMP AS asked,
  CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) AS seconds FROM orders""")
def asked_dates(s, d):
    made = ("大前天的快讯", "昨日 news", "3月4日 news", "2023年11月05日", "昨天 and 2023-02-01", "the news")
    day = F.col("o_orderdate").cast("date")
    text = F.element_at(F.array(*map(F.lit, made)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(s, d, "orders").select("o_orderkey", values.asked_date(text, day).cast("timestamp_ntz").alias("asked"), values.epoch(F.date_format(day, "yyyy-MM-dd")).alias("seconds"))


_B = "http://example.org/"
_SCHEMA = projection.Schema({"Entity": "", "Customer": "Entity", "Order": "Entity", "Nation": ""}, {"customer": projection.Property("Order", "Customer"), "nation": projection.Property("Customer", "Nation"), "topic": projection.Property("Entity", "Nation")}, {"name": projection.Property("Entity", "xsd:string"), "size": projection.Property("Entity", "xsd:integer")})


@query(f"""SELECT '{_B}graph/schema' AS graph, '{_B}' || s AS subject, p AS predicate, v AS value, k AS kind, CASE k WHEN 'literal' THEN 'string' ELSE '' END AS datatype FROM (VALUES
  ('Entity', 'rdf:type', 'owl:Class', 'iri'), ('Entity', 'rdfs:label', 'Entity', 'literal'), ('Customer', 'rdf:type', 'owl:Class', 'iri'), ('Customer', 'rdfs:label', 'Customer', 'literal'), ('Customer', 'rdfs:subClassOf', '{_B}Entity', 'iri'),
  ('Order', 'rdf:type', 'owl:Class', 'iri'), ('Order', 'rdfs:label', 'Order', 'literal'), ('Order', 'rdfs:subClassOf', '{_B}Entity', 'iri'), ('Nation', 'rdf:type', 'owl:Class', 'iri'), ('Nation', 'rdfs:label', 'Nation', 'literal'),
  ('customer', 'rdf:type', 'owl:ObjectProperty', 'iri'), ('customer', 'rdfs:domain', '{_B}Order', 'iri'), ('customer', 'rdfs:range', '{_B}Customer', 'iri'), ('nation', 'rdf:type', 'owl:ObjectProperty', 'iri'), ('nation', 'rdfs:domain', '{_B}Customer', 'iri'), ('nation', 'rdfs:range', '{_B}Nation', 'iri'),
  ('topic', 'rdf:type', 'owl:ObjectProperty', 'iri'), ('topic', 'rdfs:domain', '{_B}Entity', 'iri'), ('topic', 'rdfs:range', '{_B}Nation', 'iri'), ('name', 'rdf:type', 'owl:DatatypeProperty', 'iri'), ('name', 'rdfs:domain', '{_B}Entity', 'iri'), ('name', 'rdfs:range', 'xsd:string', 'iri'),
  ('size', 'rdf:type', 'owl:DatatypeProperty', 'iri'), ('size', 'rdfs:domain', '{_B}Entity', 'iri'), ('size', 'rdfs:range', 'xsd:integer', 'iri')) t(s, p, v, k)""")
def schema_quads(s, d):
    return projection.schema_quads(s, _SCHEMA, _B)


@query(f"""WITH e AS (SELECT 'raw/' || user_id AS path, '/' || event_id AS pointer, sha256(props) AS hash, CAST(props::JSON->>'k' AS VARCHAR) AS k FROM events),
  n AS (SELECT *, '{_B}document/' || substr(sha256('["' || path || '"]'), 1, 24) AS doc, '{_B}record/' || substr(sha256('["' || path || '","' || pointer || '"]'), 1, 24) AS rec, '{_B}fragment/' || substr(sha256('["' || path || '","' || pointer || '/k"]'), 1, 24) AS frag FROM e),
  q AS (SELECT doc AS subject, 'rdf:type' AS predicate, '{_B}SourceDocument' AS value, 'iri' AS kind FROM n UNION ALL SELECT doc, '{_B}sourceSystem', 'ev', 'literal' FROM n UNION ALL SELECT doc, '{_B}sourcePath', path, 'literal' FROM n
  UNION ALL SELECT rec, 'rdf:type', '{_B}SourceRecord', 'iri' FROM n UNION ALL SELECT rec, '{_B}recordFromDocument', doc, 'iri' FROM n UNION ALL SELECT rec, '{_B}recordHash', hash, 'literal' FROM n UNION ALL SELECT rec, '{_B}recordJsonPointer', pointer, 'literal' FROM n
  UNION ALL SELECT frag, 'rdf:type', '{_B}SourceFragment', 'iri' FROM n UNION ALL SELECT rec, '{_B}recordHasFragment', frag, 'iri' FROM n UNION ALL SELECT frag, '{_B}fragmentFromDocument', doc, 'iri' FROM n UNION ALL SELECT frag, '{_B}jsonPointer', pointer || '/k', 'literal' FROM n UNION ALL SELECT frag, '{_B}valueKind', 'integer', 'literal' FROM n)
SELECT DISTINCT '{_B}graph/source' AS graph, subject, predicate, value, kind, CASE kind WHEN 'literal' THEN 'string' ELSE '' END AS datatype FROM q""")
def source_quads(s, d):
    e = table(s, d, "events").select(F.concat(F.lit("raw/"), "user_id").alias("path"), F.concat(F.lit("/"), "event_id").alias("pointer"), F.sha2("props", 256).alias("hash"), "props")
    walked = json_paths.fragments(e.withColumn("at", F.concat_ws("|", "path", "pointer")), "at", "props").filter("pointer <> ''")
    at = F.split("at", r"\|")
    walked = walked.select(at[0].alias("path"), at[1].alias("record"), F.concat(at[1], "pointer").alias("pointer"), "kind", "value")
    return projection.source_quads(e.select("path", F.lit("ev").alias("source")).distinct(), e, _B, walked)


@query(f"""WITH p AS (SELECT p_partkey AS k, '{_B}entity/p' || p_partkey AS e, '{_B}observation/' || substr(sha256('["parts","p' || p_partkey || '"]'), 1, 24) AS o, * FROM part),
  c AS (SELECT e, x, '{_B}concept/Nation/' || substr(sha256('["' || x || '"]'), 1, 24) AS t FROM (SELECT e, unnest([p_brand, p_type]) AS x FROM p)),
  q AS (SELECT 'domain' AS g, e AS subject, 'rdf:type' AS predicate, '{_B}Entity' AS value, 'iri' AS kind, '' AS datatype FROM p UNION ALL SELECT 'domain', e, '{_B}sourceId', 'p' || k, 'literal', 'string' FROM p
  UNION ALL SELECT 'observation', o, 'rdf:type', '{_B}Order', 'iri', '' FROM p UNION ALL SELECT 'observation', o, '{_B}observesEntity', e, 'iri', '' FROM p UNION ALL SELECT 'observation', o, '{_B}resultRank', CAST(k + 1 AS VARCHAR), 'literal', 'positiveInteger' FROM p
  UNION ALL SELECT 'domain', e, '{_B}name', p_name, 'literal', 'string' FROM p UNION ALL SELECT 'observation', o, '{_B}size', CAST(p_size AS VARCHAR), 'literal', 'integer' FROM p
  UNION ALL SELECT 'domain', t, 'rdf:type', '{_B}Nation', 'iri', '' FROM c UNION ALL SELECT 'domain', e, '{_B}topic', t, 'iri', '' FROM c UNION ALL SELECT 'domain', t, 'rdfs:label', x, 'literal', 'string' FROM c)
SELECT DISTINCT '{_B}graph/' || g AS graph, * EXCLUDE (g) FROM q""")
def projected_items(s, d):
    k = F.col("p_partkey")
    made = F.format_string('{"name":"%s","n":[{"size":%d}],"tags":["%s",{"id":"%s","name":"%s"},"",7]}', "p_name", "p_size", "p_brand", "p_type", "p_type")
    items = table(s, d, "part").select(F.lit("parts").alias("source"), F.concat(F.lit("p"), k).alias("source_id"), F.lit("x").alias("path"), (k + 1).alias("rank"), F.parse_json(made).alias("data"))
    return projection.project(items, _SCHEMA, "Entity", "Order", [projection.Scalar("/name", "name"), projection.Scalar("/n/*/size", "size", "integer", "observation")], [projection.Relation("/tags/*", "topic", "Nation")], _B)


@query("SELECT event_id, '/k' AS pointer, 'changed' AS state FROM events WHERE event_id % 3 = 1 UNION ALL SELECT event_id, '/gone', 'gone' FROM events WHERE event_id % 3 = 2")
def replayed_fragments(s, d):
    e, i = table(s, d, "events"), F.col("event_id") % 3
    stored = e.select("event_id", F.when(i == 2, "/gone").otherwise("/k").alias("pointer"), F.when(i == 1, "x").otherwise(F.sha2(F.get_json_object("props", "$.k"), 256)).alias("hash"))
    return projection.replay(stored, e, "event_id", "props")


@query(f"SELECT DISTINCT '{_B}nation/' || c_nationkey AS subject, o_orderstatus AS value FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation)")
def navigated_path(s, d):
    """From nations back to their customers, back to their orders, and on to the orders' status."""
    quads = _star_quads(s, d).select("subject", "predicate", "value")
    typed = table(s, d, "nation").select(F.concat(F.lit(f"{_B}nation/"), "n_nationkey").alias("subject"), F.lit(projection.TYPE).alias("predicate"), F.lit(f"{_B}Nation").alias("value"))
    schema = projection.Schema(_SCHEMA.classes, _SCHEMA.objects, {"status": projection.Property("Order", "xsd:string")})
    return projection.navigate(quads.unionByName(typed), schema, "Nation", ["^nation", "^customer", "status"], _B)


@query("SELECT c_custkey, 'USD' AS currency, CAST(coalesce(trunc(c_acctbal / 1000), 0) AS BIGINT) AS value, CAST(coalesce(trunc(c_acctbal / 1000), 0) <> 0 AS INTEGER) AS funding_round_count FROM customer")
def funding_profiles(s, d):
    made = finance.funding_profiles(table(s, d, "customer").withColumn("total", F.col("c_acctbal") / 1000), "c_custkey", "total")
    return made.select("c_custkey", "total_funding.currency", "total_funding.value", "funding_round_count")


def _columns(s, d):
    names = [(t, f.name) for t in ("customer", "orders", "nation") for f in table(s, d, t).schema]
    return s.createDataFrame(names, "table string, column string")


@query("""WITH c AS (SELECT count(*) = count(DISTINCT c_custkey) AS u FROM customer), o AS (SELECT count(*) = count(DISTINCT o_custkey) AS u FROM orders)
SELECT * FROM (VALUES ('Customer', 'customer', 'c_custkey', true, true), ('Buyer', 'orders', 'o_custkey', true, true), ('Place', 'nation', 'none', true, false), ('Ghost', 'ghosts', 'id', false, false)) t(class, "table", id_field, table_exists, field_exists)
LEFT JOIN (SELECT 'customer' AS "table", 'c_custkey' AS id_field, 'unique=' || u AS evidence FROM c UNION ALL SELECT 'orders', 'o_custkey', 'unique=' || u FROM o) USING ("table", id_field)""")
def entity_hints(s, d):
    hints = s.createDataFrame([("Customer", "customer", "c_custkey"), ("Buyer", "orders", "o_custkey"), ("Place", "nation", "none"), ("Ghost", "ghosts", "id")], "class string, table string, id_field string")
    proof = lambda t, c: table(s, d, t).agg(F.concat(F.lit("unique="), (F.count("*") == F.count_distinct(c)).cast("string")).alias("evidence")).select(F.lit(t).alias("table"), F.lit(c).alias("id_field"), "evidence")
    return lineage.entity_hints(hints, _columns(s, d), proof("customer", "c_custkey").unionByName(proof("orders", "o_custkey")))


@query("""WITH j AS (SELECT 'matched=' || count(*) AS e FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)), k AS (SELECT 'matched=' || count(*) AS e FROM orders)
SELECT * FROM (SELECT 'Order-of-Customer' AS relation, 'Order' AS source_class, 'of' AS predicate, 'Customer' AS target_class, 'orders' AS "table", (SELECT e FROM k) AS source_evidence, (SELECT e FROM j) AS target_evidence, false AS scalar
UNION ALL SELECT 'Order-status', 'Order', 'status', NULL, 'orders', (SELECT e FROM k), NULL, true)""")
def relation_hints(s, d):
    orders, customers = table(s, d, "orders"), table(s, d, "customer")
    shown = lambda df, *at: df.agg(F.concat(F.lit("matched="), F.count("*").cast("string")).alias("evidence")).select(*(F.lit(x).alias(n) for x, n in zip(at, ("table", "field", "to_table", "to_field"))), "evidence")
    joins = shown(orders.join(customers.select(F.col("c_custkey").alias("o_custkey")).distinct(), "o_custkey", "left_semi"), "orders", "o_custkey", "customer", "c_custkey").unionByName(shown(orders, "orders", "o_orderkey", "orders", "o_orderkey"))
    hints = s.createDataFrame([("Order-of-Customer", "orders", "o_orderkey", "o_custkey"), ("Order-status", "orders", "o_orderkey", "o_orderstatus")], "relation string, table string, source_field string, target_field string")
    entities = s.createDataFrame([("Customer", "customer", "c_custkey"), ("Order", "orders", "o_orderkey")], "class string, table string, id_field string")
    return lineage.relation_hints(hints, entities, joins)
