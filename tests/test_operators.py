"""Operators on small frames, where tables of the driver have no such cases."""

import json

import pytest
from pyspark.sql import functions as F

from tessaloom.functions import html, json_paths, text, values
from tessaloom.operators import finance, graph, grounding, normalize, profiles, registry
from tessaloom.plans import extraction
from tessaloom.sources import bounded_sql, files
from tessaloom.streaming import incremental


def rows(df):
    return [tuple(r) for r in df.collect()]


def column(spark, values_, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values_)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("x")).collect()]


def test_text_functions(spark):
    assert column(spark, [" a  b\n", None], text.collapse_space) == ["a b", None]
    assert column(spark, ["a b c/~*é"], text.percent_encode) == ["a%20b%20c%2F~%2A%C3%A9"]
    assert column(spark, ["/data/0"], text.pointer_token) == ["L2RhdGEvMA"]
    assert column(spark, ["中文", "abc"], text.has_cjk) == [True, False]
    assert column(spark, [" Straße ", "ＡＢ"], text.folded) == ["strasse", "ab"]
    assert column(spark, ["key sk-abc, api_key=abc ak_x1 API-KEY: y;z", "ask-me", "x" * 1300], text.redact) == ["key [REDACTED], api_key=[REDACTED] [REDACTED] API-KEY: [REDACTED];z", "ask-me", "x" * 1200]
    found = column(spark, ["1.5m", "3,000", "7%", "x", "2万"], text.canonical_number)
    assert [(float(r.value), r.kind) if r else None for r in found] == [(1.5e6, "scalar"), (3000.0, "scalar"), (7.0, "percent"), None, (20000.0, "scalar")]
    assert text.heading_sections("# A\nx\n```\n# no\n```\n## B\ny") == [(1, "A", "x\n```\n# no\n```"), (2, "B", "y")]


def test_concept_key_is_the_hash_of_the_folded_json_string(spark):
    from hashlib import sha256

    assert column(spark, [' A"b'], text.concept_key) == [sha256(json.dumps('a"b').encode()).hexdigest()]


def test_fits_and_lexical(spark):
    assert column(spark, ["2024-02-30", "2024-02-29"], lambda c: values.fits("date", c)) == [False, True]
    assert column(spark, ["[1", "[1]", "{}"], lambda c: values.fits("json_array", c)) == [False, True, False]
    assert column(spark, ["0", "+7", "x"], lambda c: values.lexical(c, "positiveInteger")) == [None, "7", None]
    assert column(spark, ["TRUE", "1"], lambda c: values.lexical(c, "boolean")) == ["true", None]


def test_json_walk_and_pointers(spark):
    document = {"a/b": [1, {"c": None}], "d": True}
    found = list(json_paths.walk(document))
    assert ("/a~1b/1/c", "/a~1b/*/c", None) in found and found[0][0] == ""
    for pointer, _, value in found:
        assert json_paths.pointer_get(document, pointer) == value
    for miss in ("a", "/a~1b/2", "/a~1b/01", "/x", "/d/0", "/a~b", "/a~1b/1/c/x"):
        with pytest.raises(LookupError):
            json_paths.pointer_get(document, miss)
    assert [json_paths.kind_of(x) for x in (None, True, 1, 1.5, "", [], {})] == ["null", "boolean", "integer", "number", "string", "array", "object"]
    assert json_paths.select(document, "/a~1b/*") == [("/a~1b/0", 1), ("/a~1b/1", {"c": None})]
    df = spark.createDataFrame([(1, json.dumps(document)), (2, "no json"), (3, None)], "k int, j string")
    assert json_paths.fragments(df, "k", "j").count() == len(found)
    assert column(spark, ['{"b": 1, "a": [1.50]}', "x"], json_paths.canonical_json) == ['{"a":[1.5],"b":1}', None]


def test_html_tables():
    title, body, tables = html.parse_page("<title>T</title><p>a &amp; b<script>x</script><table><tr><th>h<th>i<tr><td>1<td>2</table>")
    assert (title, tables) == ("T", [[["h", "i"], ["1", "2"]]])
    assert body.split("\n") == ["a & b", "h | i", "1 | 2"]


def test_profiles_of_edges(spark):
    empty = spark.createDataFrame([], "k string")
    one = profiles.profile_join(empty, empty, ["k"], ["k"]).first()
    assert (one.row_coverage, one.cardinality) == (1.0, "one_to_one")
    df = spark.createDataFrame([("1", " "), ("1", None), ("2", "x")], "a string, b string")
    found = {r.column: r for r in profiles.profile_columns(df).collect()}
    assert (found["a"].inferred, found["a"].duplicate_nonblank, found["b"].blank) == ("integer", 1, 2)
    assert profiles.profile_identity(df, ["a"]).first().semantics == "entity_merge_key"


def test_normalise_papers(spark):
    envelope = {"endpoint": "/v1/paper/search", "data": {"list": [
        {"paper_id": "p1", "title": "T", "authors": [{"author_id": "s1", "is_first_author": True}], "author_ids": ["s2", ""], "institution_ids": ["i1", "i2"], "institution_id": "i2", "institutions": ["I"], "hotness": {"half_year": 0, "month": 3}, "citation_count": 4, "conference_name": "", "journal_name": "J", "count_by_year": [{"year": 2020, "count": 2}], "awards": "Best"},
        "junk", {"id": 0, "title": None}]}}
    raw = spark.createDataFrame([(json.dumps(envelope),), ("junk",), (None,), (json.dumps(envelope | {"endpoint": "/papers"}),)], "raw_text string")
    tables = normalize.normalise(raw)
    papers = {r.paper_id: r for r in tables["papers"].collect()}
    assert set(papers) == {"p1", ""}  # an unknown endpoint gives none
    assert (papers["p1"].venue, papers["p1"].heat, papers["p1"].cited_by_count, papers[""].citation_count, papers[""].title) == ("J", "3", "4", "0", "")
    assert sorted((r.scholar_id, r.author_order) for r in tables["paper_author"].collect()) == [("s1", 1), ("s2", 1)]
    assert sorted((r.institution_id, r.institution_name, r.is_primary) for r in tables["paper_institution"].collect()) == [("i1", "I", False), ("i2", "", True)]
    assert rows(tables["paper_yearly_counts"].select("year", "cited_by_count")) == [("2020", "2")]
    assert rows(tables["paper_awards"].select("conf", "award_title")) == [("", "Best")]
    assert set(tables) == {t for _, x in normalize.NORMALISERS.values() for t in x} and len(tables) == 18


def test_funding_of_a_profile_without_rounds(spark):
    profile = lambda i, data: (json.dumps({"endpoint": "/funding-profile", "request": {"institution_id": i}, "data": data}),)
    raw = spark.createDataFrame([profile("a", {"summary": {"total_funding": {"currency": "USD", "value": 5}}}), profile("b", {"funding": {"funding_rounds": [{"id": "r"}]}}), profile("c", [])], "raw_text string")
    found = normalize.normalise(raw)["funding_rounds"]
    assert sorted(rows(found.select("institution_id", "funding_id", "title", "value"))) == [("a", "a_funding_summary", "Funding summary", "5"), ("b", "r", "", ""), ("c", "c_funding_summary", "Funding summary", "")]


def test_append_merge_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    assert normalize.append_merge(df, df).count() == 2


def test_plan_and_serialisations(spark):
    op = extraction.Operation
    plan = [op("copy_scalar", "/t", "title"), op("copy_scalar", "/t", "title"), op("concept_by_normalized_value", "/d", "domain"), op("reference_by_business_id", "/i", "inst"), op("reify_array_membership", "/a", "author"), op("require_consensus", "/t", "agreed"), op("object_fields", "/o", "score", fields=(("/x", "x"),))]
    assert len(extraction.compile_plan(plan)) == 6
    with pytest.raises(ValueError):
        extraction.compile_plan([op("derived_formula", "/t", "x")])
    data = spark.createDataFrame([("1", '{"t": "A \\"q\\"\\n", "d": "ML", "i": "z 1", "a": ["u", "v"], "o": {"x": 3}}'), ("2", "{}")], "id string, j string").select("id", F.parse_json("j").alias("item"))
    quads = extraction.materialise(data, plan, "http://e/")
    assert quads.count() == quads.distinct().count()
    assert graph.triples(quads).count() <= quads.count()
    back = graph.read_nquads(graph.nquads(quads), "line")
    assert graph.same_set(quads, back).count() == 0
    assert graph.rdf_xml(quads).count() == quads.select("subject").distinct().count()
    assert quads.filter("predicate = 'http://e/inst'").first().value == "http://e/entity/z%201"


def test_duplicate_findings(spark):
    """Far more groups of one size than are broadcast, with partitions that Spark joins as their sizes tell."""
    adaptive = "spark.sql.adaptive."
    settings = {"spark.sql.shuffle.partitions": "64", f"{adaptive}coalescePartitions.parallelismFirst": "false", f"{adaptive}advisoryPartitionSizeInBytes": "16k", f"{adaptive}coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        texts = spark.range(0, 6000, 1, 7).select("id", F.concat(F.lit("Text "), F.pmod("id", F.lit(1500)).cast("string"), F.when(F.col("id") % 2 == 0, ".").otherwise("!")).alias("t"))
        assert sorted(rows(grounding.duplicate_findings(texts, ["t"], "id"))) == [(i, i % 1500) for i in range(1500, 6000)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_duplicate_findings_of_odd_texts(spark):
    odd = spark.createDataFrame([(1, None), (2, None), (3, ""), (4, " -"), (5, "ΟΔΟΣ"), (6, "οδοσ"), (7, "İ"), (8, "i"), (None, "i"), (9, "οδοσ α")], "id int, t string")
    assert sorted(rows(grounding.duplicate_findings(odd, ["t"], "id"))) == [(4, 3), (6, 5), (8, 7)]
    two = odd.select("id", "t", F.when(F.col("id") == 2, "").alias("u"))
    assert sorted(rows(grounding.duplicate_findings(two, ["t", "u"], "id"))) == [(3, 2), (4, 2), (6, 5), (8, 7)]


def test_grounding(spark):
    findings = spark.createDataFrame([(1, "GPT4 grew 12% in 2020"), (2, "Nothing here")], "k int, t string")
    evidence = spark.createDataFrame([(1, "gpt-4 in 2020, 12 of them")], "k int, t string")
    assert sorted(rows(grounding.prefix_resolve(spark.createDataFrame([("abcdefgh",), ("abcdefghi1",), ("ABCDEFGHI2",), ("abc",), (None,)], "k string"), spark.createDataFrame([("abcdefghi1",), ("abcdefghi2",), ("abcdefghi2",), ("abc",)], "k string"), "k"))) == [("ABCDEFGHI2", "abcdefghi2"), ("abc", "abc"), ("abcdefgh", None), ("abcdefghi1", "abcdefghi1")]
    assert rows(grounding.unsupported_tokens(findings, evidence, "k", "t", english=True)) == [(1, "12%")]
    insights = spark.createDataFrame([("i", ["s"], ["a", "b"])], "insight string, signals array<string>, sources array<string>")
    signals = spark.createDataFrame([("s", ["a"])], "signal string, sources array<string>")
    assert rows(grounding.transitive_support(insights, signals)) == [("i", "b")]
    issues = grounding.review(spark.createDataFrame([("ins_001", " ")], "insight_id string, title string"), ["title"], 5)
    assert rows(issues) == [("missing_title", "ins_001")]


def test_evict_largest():
    kept, gone = registry.evict_largest([{"id": 1, "a": "x" * 50, "b": "y" * 80}, {"id": 2, "a": "z" * 80}], ["a", "b"], 200)
    assert gone == [(1, "a")] and kept[1]["a"] is None and len(kept) == 2


def test_price_rows_drop_null_close(spark):
    df = spark.createDataFrame([("X", {"timestamp": [0, 86400], "open": [1.0, 2.0], "high": [1.0, 2.0], "low": [1.0, 2.0], "close": [None, 2.0], "volume": [1.0, 1.0]})], f"s string, q {finance.PRICES}")
    assert [str(r.day) for r in finance.price_rows(df, "s", F.col("q")).collect()] == ["1970-01-02"]


def test_facts(spark):
    facts = {"facts": {"us-gaap": {"Assets": {"label": "A", "units": {"USD": [{"end": "2020-12-31", "val": 1, "form": "10-K", "filed": "2021-02-01"}, {"end": "2021-12-31", "val": 2, "form": "10-K", "filed": "2022-02-01"}, {"end": "2021-03-31", "val": 3, "form": "10-Q", "filed": "2021-05-01"}]}}}}}
    df = spark.createDataFrame([(json.dumps(facts),)], "j string")
    assert [r.val for r in finance.fact_rows(df, "j", "US-GAAP", ["Assets"], forms=["10-k"]).collect()] == [2.0, 1.0]
    assert rows(finance.fact_catalog(df, "j").select("concept", "units")) == [("Assets", "USD")]


def test_sql_guard(spark):
    spark.range(30).createOrReplaceTempView("numbers")
    got, more = bounded_sql.bounded_sql(spark, "WITH x AS (SELECT id, 'DROP TABLE x' AS s FROM numbers) SELECT * FROM x", 10)
    assert (got.count(), more) == (10, True)
    for bad in ("DROP TABLE numbers", "INSERT INTO numbers VALUES (1)", "CREATE TABLE t AS SELECT 1", "SET a=b"):
        with pytest.raises(bounded_sql.NotReadOnly):
            bounded_sql.bounded_sql(spark, bad)
    for bad in ("SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM (SELECT java_method('a', 'b') AS x)", "SELECT * FROM csv.`/etc/passwd`", "EXPLAIN DROP TABLE numbers", "WITH x AS (SELECT reflect('a', 'b')) SELECT * FROM x"):
        with pytest.raises(bounded_sql.NotReadOnly):
            bounded_sql.guard(spark, bad)
    bounded_sql.guard(spark, "EXPLAIN FORMATTED SELECT id, 'reflect(1)' FROM numbers")


def test_files(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.json").write_text(json.dumps({"source": "x", "endpoint": "/p", "data": {"list": []}}))
    (tmp_path / "raw" / "b.json").write_text("{")
    good, bad = files.raw_envelopes(spark, str(tmp_path / "raw"), "x")
    assert (good.count(), bad.count()) == (1, 1)
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny"\n')
    assert rows(files.csv_table(spark, str(tmp_path / "t.csv"))) == [("1", "x\ny")]
    (tmp_path / "u.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError):
        files.csv_table(spark, str(tmp_path / "u.csv"))
    df = spark.createDataFrame([("k", 1)], "k string, n int")
    for _ in range(2):
        assert files.write_new_only(df, str(tmp_path / "store"), "k").count() == 1


def test_streaming(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", 1, False), ("a", 2, False), ("b", 1, True), ("a", 3, True), ("a", 4, False)], "k string, o int, ok boolean").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("k string, o int, ok boolean").parquet(str(source))
    q = incremental.error_fold(stream, "k", "o", "ok").writeStream.outputMode("update").format("memory").queryName("folded").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(rows(spark.table("folded"))) == [("a", 1), ("b", 0)]


def run_stream(spark, stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return spark.table(name)


def test_streams_of_events(spark, tmp_path):
    schema = "k string, n int, ts timestamp"
    day = "2024-01-01 "
    data = [("a", 1, f"{day}10:00:00"), ("a", 1, f"{day}10:05:00"), ("b", 2, f"{day}10:30:00"), ("b", 3, f"{day}11:10:00"), ("c", 4, None)]
    spark.createDataFrame(data, "k string, n int, t string").select("k", "n", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert sorted(rows(run_stream(spark, incremental.deduplicated(stream().filter("ts is not null"), ["k", "n"], "ts"), "once").select("k", "n"))) == [("a", 1), ("b", 2), ("b", 3)]
    counted = run_stream(spark, incremental.windowed_counts(stream(), "ts", ["k"]), "counted", "update")
    assert sorted((r.k, r.n) for r in counted.collect()) == [("a", 2), ("b", 1), ("b", 1)]
    assert sorted(rows(run_stream(spark, incremental.within(stream(), "ts", "2024-01-01", f"{day}10:30:00"), "kept").select("n"))) == [(1,), (1,), (2,)]
    for _ in range(2):  # the same batch again adds nothing
        stream().writeStream.foreachBatch(incremental.append_merge_sink(str(tmp_path / "out"), ["k", "n"])).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(rows(spark.read.parquet(str(tmp_path / "out")).select("k", "n"))) == [("a", 1), ("b", 2), ("b", 3), ("c", 4)]
    events = spark.createDataFrame([('{"type": "delta", "partial": "x", "text": "y"}',)], "event string")
    assert json.loads(incremental.compact_events(events).first().event) == {"type": "delta", "text": "y"}


def test_error_fold_counts_unknown_outcomes_as_failures(spark, tmp_path):
    spark.createDataFrame([("a", 1, True), ("a", 2, None), ("a", 3, False)], "k string, o int, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, o int, ok boolean").parquet(str(tmp_path / "in"))
    assert rows(run_stream(spark, incremental.error_fold(stream, "k", "o", "ok"), "unknown", "update")) == [("a", 2)]


def test_files_as_tables(spark, tmp_path):
    from hashlib import sha256

    (tmp_path / "e.jsonl").write_text('{"a": 1}\n\n{bad\n')
    found = files.event_lines(spark, str(tmp_path / "e.jsonl"))
    assert [r.warning for r in found.select("warning").collect()] == [None, "{bad"]
    assert [r.length for r in files.file_listing(spark, str(tmp_path), "*.jsonl").collect()] == [15]
    assert files.checksums(spark, str(tmp_path)).first().sha256 == sha256((tmp_path / "e.jsonl").read_bytes()).hexdigest()


def test_filings_and_companies(spark):
    hits = {"hits": {"total": {"value": 5}, "hits": [{"_id": "0001-23:doc.htm:x", "_source": {"form": "10-K", "file_date": "2024-01-02"}}]}}
    df = spark.createDataFrame([(json.dumps(hits),)], "j string")
    assert rows(finance.filing_hits(df, "j")) == [(1, "0001-23", "doc.htm:x", "10-K", "2024-01-02", True)]
    wanted, tickers = spark.createDataFrame([("320193",), ("msft",), ("none",)], "company string"), spark.createDataFrame([("MSFT", 789019), ("MSFT", 999999)], "ticker string, cik long")
    assert sorted(rows(finance.resolve_company(wanted, tickers))) == [("320193", "0000320193"), ("msft", "0000789019"), ("none", None)]
    recent = spark.createDataFrame([(["a", "b", "c"], ["10-K", "8-K"])], "id array<string>, form array<string>")
    assert [r.id for r in finance.zipped_profile(recent, ["id", "form"], "form").collect()] == ["a", "b"]
    assert [r.id for r in finance.zipped_profile(recent, ["id", "form"], "form", ["8-K"]).collect()] == ["b"]


def test_sorts_windows_and_budgets(spark):
    from datetime import date

    from tessaloom.operators import acquire, lineage

    df = spark.createDataFrame([(1, 0.0, 5.0, "2024"), (2, 7.0, 1.0, ""), (3, 6.0, 9.0, "2025")], "i int, heat double, total double, pub_date string")
    order = lambda kind: [r.i for r in acquire.sort_rows(df, kind, "i").collect()]
    assert (order("heat"), order("publish_time"), order("whatever")) == ([2, 3, 1], [3, 1, 2], [1, 2, 3])
    acquire.call_budget(1, 5, 6)
    with pytest.raises(RuntimeError):
        acquire.call_budget(2, 5, 6)
    today = date(2024, 3, 31)
    assert values.resolve_window(None, None, today) == (today, today)
    assert values.resolve_window(None, date(2024, 3, 30), today) == (date(2024, 3, 1), date(2024, 3, 30))
    assert column(spark, ["2024-03-31"], lambda c: values.month_before(c.cast("date")).cast("string")) == ["2024-02-29"]
    assert column(spark, ["a\n# b", "- x", "a"], text.markdown_structured) == [True, True, False]
    assert [html.text_limit(x) for x in (None, 5, 99_999, 700)] == [12_000, 200, 30_000, 700]
    assert lineage.drop_empty({"a": None, "b": [], "c": {}, "d": 0, "e": ""}) == {"d": 0, "e": ""}
    assert lineage.named_tables(["a.csv", "b.csv"], ["a"], []) == ["a.csv"] and lineage.named_tables(["a.csv", "b.csv"], [], ["b.csv"]) == ["a.csv"]
    served = spark.createDataFrame([("1", 0.0), ("2", 1.0), (None, 0.0)], "id string, reward double")
    assert [lineage.serving_filter(served, **w).count() for w in ({}, {"reward": 0}, {"id": "1' or '1'='1"})] == [2, 2, 0]
    profile = spark.createDataFrame([("e", "/a"), ("e", "/b"), ("f", "/a")], "endpoint string, pattern string")
    assert [lineage.path_lookup(profile, *w).count() for w in ((), ("e",), (None, "/a"), ("e", "/a"))] == [3, 2, 2, 1]
    grid = spark.createDataFrame([([[["x" * 600] * 40] * 60] * 12,)], "t array<array<array<string>>>").select(html.clip_tables(F.col("t")).alias("t")).first().t
    assert (len(grid), len(grid[0]), len(grid[0][0]), len(grid[0][0][0])) == (10, 50, 30, 500)


def test_evidence_excerpt_keeps_within_its_total(spark):
    from tessaloom.operators import lineage

    items = spark.createDataFrame([(i, "word  " * 400) for i in range(60)], "id int, t string")
    got = lineage.excerpt(items, items.select("id").filter("id >= 10"), "id", "t", "id").collect()
    assert [r.id for r in got] == list(range(10, 36)) and {len(r.text) for r in got} == {900}
