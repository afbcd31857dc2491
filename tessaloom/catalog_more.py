"""More registered queries: text and value functions, checks, lineage. Where the driver's tables
have no such cases, rows are made of their columns, so that the SQL knows the answer by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _QUADS_SQL, _star_quads, query
from .functions import json_paths, text, values
from .operators import acquire, finance, graph, grounding, lineage, normalize, validation
from .sources.files import stored_text, table


@query("SELECT c_custkey, 'run [REDACTED] with api_key=[REDACTED], [REDACTED]; ask-me ' || c_name AS text FROM customer")
def redacted_texts(s, d):
    made = F.concat(F.lit("run sk-a"), "c_custkey", F.lit(" with api_key="), "c_name", F.lit(", ak_"), "c_custkey", F.lit("; ask-me "), "c_name")
    return table(s, d, "customer").select("c_custkey", text.redact(made).alias("text"))


@query("""SELECT p_partkey, t AS token FROM (SELECT p_partkey, unnest(list_filter([
    CASE WHEN p_partkey % 2 = 1 THEN (p_size + 100) || '%' END,
    CASE WHEN p_partkey % 3 = 1 THEN '7' || p_size || '万' END,
    CASE WHEN p_partkey % 5 = 1 THEN 'GPT-x' || p_partkey END], lambda x: x IS NOT NULL)) AS t FROM part)""")
def grounding_tokens(s, d):
    """Shares, multiples and names of every part against evidence that has some of them: the digits
    of a share alone don't prove it, an equal number in another form does."""
    n, size = F.col("p_partkey"), F.col("p_size")
    share, model = F.concat(size + 100, F.lit("%")), F.concat(F.lit("GPT-x"), n)
    finding = F.concat_ws(" ", F.lit("the part grew"), share, F.lit("to"), F.concat(F.lit("7"), size, F.lit("万")), F.lit("with"), model, F.lit("Nothing"))
    plain = F.concat(F.lit("7"), size).cast("int")
    proof = F.concat_ws(" ", F.when(n % 2 == 1, (size + 100).cast("string")).otherwise(share), F.lit("and"), F.when(n % 3 == 1, "none").otherwise(F.format_string("%d.0k", plain * 10)), F.lit("by"), F.when(n % 5 == 1, "another").otherwise(F.lower(F.concat(F.lit("gpt x"), n))))
    p = table(s, d, "part")
    return grounding.unsupported_tokens(p.select("p_partkey", finding.alias("t")), p.select("p_partkey", proof.alias("t")), "p_partkey", "t", english=True)


@query("""SELECT p_partkey, CAST(p_size * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 10000 ELSE 1 END AS DOUBLE) AS value, CASE WHEN p_partkey % 4 = 3 THEN 'percent' ELSE 'scalar' END AS kind FROM part""")
def canonical_numbers(s, d):
    shown = F.concat(F.lit("$ "), "p_size", F.element_at(F.array(*map(F.lit, ("", " k", "万", "%"))), (F.col("p_partkey") % 4 + 1).cast("int")))
    n = text.canonical_number(shown)
    return table(s, d, "part").select("p_partkey", n["value"].cast("double").alias("value"), n["kind"].alias("kind"))


_PATTERNS = {"/raw": "redundant_but_source_linked", "/raw/x": "redundant_but_source_linked", "/request/q": "observation_promoted", "/data/total": "observation_promoted", "/data/list/*/title": "semantic_promoted", "/data/list/*/hotness/day": "observation_promoted", "/data/list/*/other": "source_only", "/data/list/*": "source_only", "": "source_only", "/rawness": "source_only"}


@query("SELECT n_nationkey, p AS pattern, c AS class FROM nation, (VALUES " + ", ".join(f"('{p}', '{c}')" for p, c in _PATTERNS.items()) + ") t(p, c)")
def path_classes(s, d):
    return table(s, d, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, _PATTERNS))).alias("pattern")).select("n_nationkey", "pattern", json_paths.path_class(F.col("pattern")).alias("class"))


@query("""SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS one_line, CAST(length(regexp_replace(text, '\\s+', '', 'g')) AS BIGINT) AS visible, regexp_matches(text, '[\\x{3400}-\\x{9fff}]') AS cjk,
  CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 80 THEN substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 77) || '...' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS compact,
  regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS latin, CASE WHEN length(text) > 300 THEN right(text, 300) ELSE text END AS tail FROM documents""")
def text_measures(s, d):
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", text.collapse_space(t).alias("one_line"), text.visible_chars(t).alias("visible"), text.has_cjk(t).alias("cjk"), text.compact(t, 80).alias("compact"), text.latin_key(t).alias("latin"), text.clip_tail(t, 300).alias("tail"))


@query("""SELECT p_partkey, sha256('"' || lower(trim(p_name || ' ' || p_brand)) || '"') AS concept, replace(replace(p_brand || ' /x', '#', '%23'), ' /', '%20%2F') AS percent, rtrim(replace(replace(to_base64(encode('/data/' || p_partkey || '?')), '+', '-'), '/', '_'), '=') AS token FROM part""")
def keys_and_iris(s, d):
    return table(s, d, "part").select("p_partkey", text.concept_key(F.concat_ws(" ", F.lit(""), "p_name", "p_brand")).alias("concept"), text.percent_encode(F.concat("p_brand", F.lit(" /x"))).alias("percent"), text.pointer_token(F.concat(F.lit("/data/"), "p_partkey", F.lit("?"))).alias("token"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS integer, CASE WHEN event_id % 2 = 0 AND user_id > 0 THEN CAST(user_id AS VARCHAR) END AS positive, event_type = 'error' AS is_error, CASE WHEN event_id % 31 < 28 THEN '2023-02-' || lpad(CAST(event_id % 31 + 1 AS VARCHAR), 2, '0') END AS day, 'http://x/' || event_id AS uri FROM events""")
def lexical_casts(s, d):
    e = table(s, d, "events")
    number = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" +"), "user_id")).otherwise(F.concat("user_id", F.lit("x")))
    day = F.concat(F.lit("2023-02-"), F.lpad((F.col("event_id") % 31 + 1).cast("string"), 2, "0"))
    flag = F.when(F.col("event_type") == "error", "TRUE").otherwise("False")
    return e.select("event_id", values.lexical(number, "integer").alias("integer"), values.lexical(number, "positiveInteger").alias("positive"), (values.lexical(flag, "boolean") == "true").alias("is_error"), values.lexical(day, "date").alias("day"), values.lexical(F.concat(F.lit(" http://x/"), "event_id"), "anyURI").alias("uri"))


@query("""SELECT o_orderkey, CAST(least(50, greatest(1, CASE WHEN o_custkey % 5 = 0 THEN 10 ELSE CAST(floor(o_totalprice / 1000) AS INTEGER) END)) AS INTEGER) AS size, CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS month_before, CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus WHEN o_custkey % 3 = 1 THEN '0' ELSE 'z' END AS first FROM orders""")
def bounded_and_first_values(s, d):
    k = F.col("o_custkey")
    size = F.when(k % 5 == 0, "nan?").otherwise((F.col("o_totalprice") / 1000).cast("string"))
    first = values.first_present(F.when(k % 3 == 0, F.col("o_orderstatus")).otherwise(""), F.when(k % 3 == 1, F.lit("0")), F.lit("z"))
    return table(s, d, "orders").select("o_orderkey", values.bounded_int(size, 1, 50, 10).alias("size"), values.month_before(F.col("o_orderdate").cast("date")).cast("timestamp_ntz").alias("month_before"), first.alias("first"))


@query("SELECT p_partkey, p_size, row_number() OVER (ORDER BY CASE WHEN p_size % 7 = 0 THEN CAST(p_retailprice AS DOUBLE) ELSE p_size END DESC, p_partkey) AS place FROM part QUALIFY place BETWEEN 21 AND 40 ")
def sorted_page(s, d):
    rows = table(s, d, "part").withColumn("heat", F.when(F.col("p_size") % 7 == 0, F.lit(0.0)).otherwise(F.col("p_size").cast("double"))).withColumn("total", F.col("p_retailprice").cast("double"))
    page = acquire.page_slice(acquire.sort_rows(rows, "heat", "p_partkey"), 2, 20)
    return page.select("p_partkey", "p_size", F.expr("row_number() over (order by coalesce(nullif(heat, 0), total) desc, p_partkey) + 20").alias("place"))


@query("SELECT DISTINCT c_nationkey, c_mktsegment, extra FROM (SELECT c_nationkey, c_mktsegment, NULL AS extra FROM customer UNION ALL SELECT c_nationkey, c_mktsegment, CASE WHEN c_nationkey < 5 THEN 'x' END FROM customer)")
def append_merge_rows(s, d):
    c = table(s, d, "customer").select("c_nationkey", "c_mktsegment")
    return normalize.append_merge(c, c.withColumn("extra", F.when(F.col("c_nationkey") < 5, "x")))


@query(_QUADS_SQL + """SELECT DISTINCT '<' || subject || '> <' || predicate || '> ' || CASE WHEN kind = 'iri' THEN '<' || value || '>' ELSE '"' || replace(replace(value, '\\', '\\\\'), '"', '\\"') || '"^^<' || datatype || '>' END || ' .' AS line FROM q""")
def ntriples_lines(s, d):
    return graph.ntriples(_star_quads(s, d))


@query(_QUADS_SQL + "SELECT * FROM q ORDER BY graph, subject, predicate, value, kind, datatype LIMIT 200")
def first_quads_in_order(s, d):
    return lineage.quad_order(_star_quads(s, d)).limit(200)


@query("""WITH i AS (SELECT conv_id AS report, turn AS pos, max(text) AS t, count(*) AS k FROM conversations GROUP BY ALL),
  m AS (SELECT *, CAST(length(regexp_replace(coalesce(t, ''), '\\s', '', 'g')) AS BIGINT) AS size FROM i), n AS (SELECT report, count(*) AS n FROM i GROUP BY 1)
SELECT report, 'error' AS level, 'count_max' AS code, CAST(-1 AS BIGINT) AS pos FROM n WHERE n > 4 UNION ALL SELECT report, 'warning', 'count_min', -1 FROM n WHERE n < 3 UNION ALL SELECT report, 'error', 'length_max', pos FROM m WHERE size > 120 UNION ALL SELECT report, 'warning', 'length_min', pos FROM m WHERE size < 20
UNION ALL SELECT report, 'error', 'one_source', pos FROM m WHERE pos % 4 = 3 UNION ALL SELECT report, 'error', 'reused_source', pos FROM m WHERE pos % 4 = 2 AND EXISTS (SELECT 1 FROM m x WHERE x.report = m.report AND x.pos < m.pos AND x.pos % 4 = 2)""")
def writing_checks(s, d):
    """Turns as items: every fourth has no source, and the ones two after it share one."""
    c = table(s, d, "conversations").groupBy(F.col("conv_id").alias("report"), F.col("turn").alias("pos")).agg(F.max("text").alias("t"))
    ids = F.when(F.col("pos") % 4 == 3, F.array().cast("array<string>")).when(F.col("pos") % 4 == 2, F.array(F.lit("same"))).otherwise(F.array(F.concat(F.lit("s"), F.col("pos"))))
    found = validation.writing_issues(c.withColumn("ids", ids), "report", "pos", "t", "ids", {"max": 4, "min": 3}, {"unit": "chars", "scope": "item", "max": 120, "min": 20}, cross_record=False)
    return found.fillna(-1, ["pos"])  # issues of a whole report


@query("""SELECT p_partkey, code, path FROM part, (VALUES ('required', 'name', 2), ('kind', 'size', 3), ('range', 'price', 5)) t(code, path, n) WHERE p_partkey % n = 0""")
def payload_checks(s, d):
    n = F.col("p_partkey")
    made = F.concat(F.lit('{"name":'), F.when(n % 2 == 0, "null").otherwise('"x"'), F.lit(',"size":'), F.when(n % 3 == 0, '"7"').otherwise(F.col("p_size").cast("string")), F.lit(',"price":'), F.when(n % 5 == 0, "-1.5").otherwise("2"), F.lit("}"))
    rows = table(s, d, "part").select("p_partkey", F.parse_json(made).alias("v"))
    return validation.payload_issues(rows, "p_partkey", "v", {"name": {"kind": "string", "required": True}, "size": {"kind": "integer"}, "price": {"kind": "number", "least": 0}})


@query("""SELECT event_id, CASE WHEN event_id % 4 = 1 THEN 'keys' WHEN event_id % 4 = 2 THEN 'kind' ELSE 'not_object' END AS code, CASE WHEN event_id % 4 = 2 THEN 'k' ELSE '' END AS path FROM events WHERE event_id % 4 > 0""")
def envelope_checks(s, d):
    n = F.col("event_id") % 4
    made = F.when(n == 0, F.col("props")).when(n == 1, '{"k": 1, "other": 2}').when(n == 2, '{"k": "1"}').otherwise("[1]")
    return validation.envelope_issues(table(s, d, "events").select("event_id", F.parse_json(made).alias("v")), "event_id", "v", {"k": "integer"})


@query("""SELECT event_id, path, CASE path WHEN 'k' THEN 'present' WHEN 'none' THEN 'missing' WHEN 'n' THEN 'null' ELSE 'empty' END AS state FROM events, (VALUES ('k'), ('none'), ('n'), ('e')) t(path)""")
def field_states(s, d):
    v = F.parse_json(F.concat(F.rtrim("props", F.lit("}")), F.lit(', "n": null, "e": []}')))
    paths = F.explode(F.array(*(F.struct(F.lit(p).alias("path"), validation.field_state(F.col("v"), p).alias("state")) for p in ("k", "none", "n", "e")))).alias("x")
    return table(s, d, "events").select("event_id", v.alias("v")).select("event_id", paths).select("event_id", "x.*")


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey % 200 AS src FROM orders), k AS (SELECT c_custkey AS src FROM customer WHERE c_custkey % 10 <> 3), g AS (SELECT c_custkey AS src FROM customer WHERE c_custkey % 10 <> 5)
SELECT DISTINCT 'unknown_source' AS code, 's' || src AS id FROM r WHERE src NOT IN (SELECT src FROM k) UNION ALL SELECT DISTINCT 'unproven_subject', 's' || src FROM r WHERE src IN (SELECT src FROM k) AND src NOT IN (SELECT src FROM g)
UNION ALL SELECT 'no_summary', 'g' || n_nationkey FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'no_sources', 'g' || n_nationkey FROM nation WHERE n_nationkey % 6 = 5
UNION ALL SELECT 'cites_unknown', 'g' || n_nationkey FROM nation WHERE n_nationkey % 6 <> 5 AND n_nationkey NOT IN (SELECT src FROM k) UNION ALL SELECT 'cites_absent', 'g' || n_nationkey FROM nation WHERE n_nationkey % 6 <> 5 AND n_nationkey IN (SELECT src FROM k) AND n_nationkey NOT IN (SELECT src FROM r)""")
def analysis_checks(s, d):
    sid = lambda c: F.concat(F.lit("s"), c)
    c, src = table(s, d, "customer"), F.col("o_custkey") % 200
    rows = table(s, d, "orders").select(sid(src).alias("source_id"), sid(src).alias("subject"))
    n = F.col("n_nationkey")
    signals = table(s, d, "nation").select(F.concat(F.lit("g"), n).alias("signal_id"), F.when(n % 4 == 0, " ").otherwise("x").alias("summary"), F.when(n % 6 == 5, F.array(F.lit(" "))).otherwise(F.array(sid(n))).alias("source_ids"))
    return validation.analysis_issues(rows, c.filter("c_custkey % 10 <> 3").select(sid("c_custkey").alias("source_id")), c.filter("c_custkey % 10 <> 5").select(sid("c_custkey").alias("source_id"), sid("c_custkey").alias("subject")), signals)


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name || '|' || p_brand || '|' || p_type), 'brand#1')")
def keyword_rows(s, d):
    return lineage.keyword(table(s, d, "part"), "Brand#1").select("p_partkey")


@query("SELECT o_orderkey, c_name, l_quantity FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey AND l_linenumber = 3")
def record_provenance(s, d):
    records = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("document"), F.concat(F.lit("/"), "o_orderkey", F.lit("/3")).alias("pointer"))
    line = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))
    fragments = line.join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("document"), F.concat_ws("/", F.lit(""), "l_orderkey", "l_linenumber").alias("pointer"), "l_quantity")
    return lineage.with_provenance(records, table(s, d, "customer").select(F.col("c_custkey").alias("document"), "c_name"), fragments, "document", "pointer").select("o_orderkey", "c_name", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_returnflag <> 'N')")
def unproven_pairs(s, d):
    l = table(s, d, "lineitem")
    return lineage.unproven(l, l.filter("l_returnflag <> 'N'"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey + 5 AS k FROM orders) SELECT k, 'missing' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'extra' FROM b WHERE k NOT IN (SELECT k FROM a)")
def coverage_diff(s, d):
    return lineage.coverage_diff(table(s, d, "customer").select(F.col("c_custkey").alias("k")), table(s, d, "orders").select((F.col("o_custkey") + 5).alias("k")), ["k"])


@query("SELECT 'n' AS kind, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation UNION ALL SELECT 'r', r_name, NULL FROM region")
def concatenated_tables(s, d):
    return lineage.concatenated(table(s, d, "nation").select(F.lit("n").alias("kind"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region")), table(s, d, "region").select(F.lit("r").alias("kind"), F.col("r_name").alias("name")))


@query("SELECT l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1")
def distinct_in_order(s, d):
    return lineage.distinct_in_order(table(s, d, "lineitem"), ["l_partkey"], "l_orderkey")


_BINDINGS = "SELECT DISTINCT p_type AS endpoint, 'path' || p_size AS path, p_name AS property, p_partkey % 3 = 0 AS preferred, CASE WHEN p_partkey % 2 = 0 THEN 'f' ELSE '' END AS formula FROM part"


@query(f"SELECT * FROM ({_BINDINGS}) QUALIFY row_number() OVER (PARTITION BY endpoint, path, formula ORDER BY preferred DESC, property) = 1")
def resolved_bindings(s, d):
    k = F.col("p_partkey")
    made = table(s, d, "part").select(F.col("p_type").alias("endpoint"), F.concat(F.lit("path"), "p_size").alias("path"), F.col("p_name").alias("property"), (k % 3 == 0).alias("preferred"), F.when(k % 2 == 0, "f").otherwise("").alias("formula"))
    return lineage.resolved_bindings(made.distinct())


@query("SELECT p_size AS concept, count(DISTINCT p_name) AS spellings, CASE WHEN count(DISTINCT p_name) = 1 THEN min(p_name) END AS label FROM part WHERE p_size IS NOT NULL GROUP BY 1")
def label_consensus(s, d):
    return lineage.label_consensus(table(s, d, "part").withColumnRenamed("p_size", "concept"), "concept", "p_name")


@query("SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS searches, count(*) FILTER (event_type = 'signup') AS gets, bool_or(value > 400) AS truncated, CAST(sum(event_id % 3) AS BIGINT) AS omitted FROM events GROUP BY 1")
def evidence_scope(s, d):
    kind = F.when(F.col("event_type") == "error", "search").when(F.col("event_type") == "signup", "get").otherwise("other")
    return lineage.scope_summary(table(s, d, "events").select("user_id", kind.alias("kind"), (F.col("value") > 400).alias("truncated"), (F.col("event_id") % 3).alias("omitted")), "user_id")


@query("""WITH p AS (SELECT event_type AS pattern, count(*) AS n FROM events GROUP BY 1), c(col, pattern, filled) AS (VALUES ('a', 'error', 5), ('a', 'signup', 5), ('b', 'nothing', 7))
SELECT col AS "column", CAST(coalesce(sum(n), 0) AS BIGINT) AS occurrences, CAST(max(filled) AS BIGINT) AS nonblank, CAST(greatest(0, max(filled) - coalesce(sum(n), 0)) AS BIGINT) AS defaulted FROM c LEFT JOIN p USING (pattern) GROUP BY 1""")
def lineage_counts(s, d):
    paths = table(s, d, "events").groupBy(F.col("event_type").alias("pattern")).agg(F.count("*").alias("occurrences"))
    rules = s.createDataFrame([("a", "error"), ("a", "signup"), ("b", "nothing")], "column string, pattern string")
    return lineage.lineage_counts(paths, s.createDataFrame([("a", 5), ("b", 7)], "column string, nonblank long"), rules)


@query("SELECT p_partkey, CAST(p_size % 3 AS BIGINT) AS place, true AS same FROM part")
def record_places(s, d):
    k = F.col("p_size") % 3
    listed = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.format_string('{"a":%d,"b":%d}', i, F.col("p_partkey")))
    record = F.format_string('{"a":%d,"b":%d}', k, F.col("p_partkey"))
    return table(s, d, "part").select("p_partkey", lineage.record_place(listed, record).alias("place"), lineage.same_content(record, F.format_string('{"b": %d, "a": %d}', F.col("p_partkey"), k)).alias("same"))


@query("SELECT p_partkey, p_name || ',T,K' AS labels FROM part")
def award_labels(s, d):
    v = F.parse_json(F.concat(F.lit('["'), "p_name", F.lit('",{"title":"T","name":"N"},{"title":"","key":"K"},"'), "p_name", F.lit('",7]')))
    return table(s, d, "part").select("p_partkey", F.array_join(lineage.award_labels(F.variant_get(v, "$", "array<variant>")), ",").alias("labels"))


@query("SELECT p_partkey, p_size + 1 || ',' || p_size AS found FROM part")
def deep_selected(s, d):
    v = F.parse_json(F.format_string('{"a":{"x/y":[[{"b":%d}],[{"b":%d},{"c":0}]]}}', F.col("p_size") + 1, F.col("p_size")))
    return table(s, d, "part").select("p_partkey", F.array_join(F.transform(json_paths.deep_select(v, "/a/x~1y/*/*/b"), lambda x: F.to_json(x)), ",").alias("found"))


@query("SELECT doc_id AS key, substr(text, 11, 40) AS text, false AS clipped FROM documents")
def stored_ranges(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("key"), "text")
    found = stored_text(docs, docs.select("key", F.lit(10).alias("start"), F.lit(50).alias("end")))
    return found.select(F.col("key").cast("long").alias("key"), "text", "clipped")


@query("SELECT s_suppkey AS wanted, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS padded FROM supplier")
def padded_company_ids(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("wanted"), finance.cik(F.col("s_suppkey").cast("string")).alias("padded"))


@query("SELECT event_id, length(event_type) BETWEEN 1 AND 1024 AND event_id % 7 <> 0 AS fine, event_id % 2 = 0 AS filled FROM events")
def identifier_checks(s, d):
    name = F.when(F.col("event_id") % 7 == 0, F.concat("event_type", F.lit("\t"))).otherwise(F.col("event_type"))
    e = table(s, d, "events").withColumn("a", F.lit(" ")).withColumn("b", F.when(F.col("event_id") % 2 == 0, "x"))
    return e.select("event_id", validation.identifier_fine(name).alias("fine"), validation.nonblank_row("a", "b").alias("filled"))


@query(_QUADS_SQL + ", m AS (SELECT predicate AS name, count(*) AS n FROM q GROUP BY 1) SELECT name, n + 1 AS expected, n AS actual FROM m WHERE name LIKE '%status' UNION ALL SELECT 'other', 7, -1")
def expected_metrics(s, d):
    actual = graph.graph_metrics(_star_quads(s, d)).filter("scope = 'predicate'").select("name", "n")
    expected = actual.select("name", F.when(F.col("name").endswith("status"), F.col("n") + 1).otherwise(F.col("n")).alias("n")).unionByName(s.createDataFrame([("other", 7)], "name string, n long"))
    return graph.metric_check(expected, actual).fillna(-1, ["actual"])


@query("SELECT 'ins_' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(3, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') AS insight_id, p_name AS title, least(1.0, greatest(0.0, CASE WHEN p_partkey % 4 = 0 THEN 0.5 ELSE CAST(p_size AS DOUBLE) - 3 END)) AS confidence FROM part WHERE p_partkey % 3 > 0")
def finalised_insights(s, d):
    k = F.col("p_partkey")
    made = table(s, d, "part").select(F.when(k % 3 == 0, F.concat(F.lit("x_"), k)).otherwise(F.concat(F.lit("ins_"), F.lpad(k.cast("string"), F.greatest(F.lit(3), F.length(k.cast("string"))), F.lit("0")))).alias("insight_id"), F.col("p_name").alias("title"), F.when(k % 4 > 0, F.col("p_size") - 3).alias("confidence"))
    return grounding.finalise_insights(made)


@query("SELECT doc_id, text AS excerpt, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS place FROM (SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 900) AS text FROM documents WHERE doc_id % 9 = 0 AND doc_id < 1800 ORDER BY doc_id LIMIT 30) QUALIFY sum(length(text)) OVER (ORDER BY doc_id) <= 24000")
def evidence_excerpt(s, d):
    docs = table(s, d, "documents")
    cited = docs.filter("doc_id % 9 = 0 and doc_id < 1800").select("doc_id")
    return lineage.excerpt(docs, cited, "doc_id", "text", "doc_id").select("doc_id", F.col("text").alias("excerpt"), "place")


