"""Schemas and paths, files, and cases of items and errors that the tables don't have."""

import json
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tessaloom.functions.json_paths import strict_json
from tessaloom.operators import outcomes, scope
from tessaloom.plans.projection import Property, Schema, canonical_names, competency_coverage, compose, executable_path, navigate
from tessaloom.sources import files

SCHEMA = Schema({"Entity": "", "Paper": "Entity", "Scholar": "Entity", "Observation": ""}, {"authoredBy": Property("Paper", "Scholar"), "observes": Property("Observation", "Entity")}, {"count": Property("Observation", "xsd:integer")})


def test_paths_follow_the_schema():
    assert executable_path(SCHEMA, "Paper", ["authoredBy"]) == "Scholar"
    assert executable_path(SCHEMA, "Scholar", ["^authoredBy"]) == "Paper"
    assert executable_path(SCHEMA, "Paper", ["^observes", "count"]) == "xsd:integer"  # by the parent class
    assert executable_path(SCHEMA, "Paper", []) == "Paper"
    for start, steps in (("Paper", ["count"]), ("Paper", ["^observes", "count", "authoredBy"]), ("Observation", ["^count"]), ("None", []), ("Paper", ["unknown"]), ("Observation", ["authoredBy"])):
        assert executable_path(SCHEMA, start, steps) is None
    got = competency_coverage(SCHEMA, {"a": [("Paper", ["authoredBy"]), ("Paper", ["count"])], "b": [("Paper", ["count"])]})
    assert got["a"] == {"status": "covered", "paths": {"Paper/authoredBy": "Scholar"}} and got["b"]["status"] == "not_covered"
    assert Schema({"A": "B", "B": "A"}).below("A") == ["A", "B"]


def test_schemas_are_composed():
    other = Schema({"Paper": "Other", "Post": "Entity"}, {"authoredBy": Property("Post", "Post"), "about": Property("Post", "Topic")}, {"count": Property("Observation", "xsd:decimal")})
    got = compose(SCHEMA, other)
    assert got.classes["Paper"] == "Entity" and got.classes["Topic"] == "" and got.objects["authoredBy"] == Property("Paper", "Entity") and got.datatypes["count"].range == "xsd:string"
    named = canonical_names(Schema({}, {"writtenBy": Property("x", "y"), "authoredBy": Property("a", "b"), "cites": Property("c", "c")}), {"writtenBy": "authoredBy", "cites": "references"})
    assert named.objects == {"authoredBy": Property("a", "b"), "references": Property("c", "c")}


def test_refused_paths_are_errors(spark):
    with pytest.raises(ValueError):
        navigate(spark.createDataFrame([], "subject string, predicate string, value string"), SCHEMA, "Paper", ["count"], "b/")


def test_paths_stay_in_their_folder():
    assert files.contained("/a/b", "c/../d") == "/a/b/d"
    assert files.contained("/a/b", "/x/y", ("/x",)) == "/x/y"
    for bad in ("../c", "/a/bc", "c/../../x"):
        with pytest.raises(ValueError):
            files.contained("/a/b", bad)


def test_files(spark, tmp_path):
    assert files.csv_or_empty(spark, str(tmp_path / "none.csv"), "a string").count() == 0
    (tmp_path / "a.csv").write_text('a\n"x,\ny"\n')
    assert [r.a for r in files.csv_or_empty(spark, str(tmp_path / "a.csv"), "a string").collect()] == ["x,\ny"]
    (tmp_path / "b.json").write_text('{"z": 1,\n"a": 2}')
    (tmp_path / "c.tsv").write_text("q\tp\n1\t2\n")
    assert files.field_names(spark, str(tmp_path / "b.json")) == ["a", "z"] and files.field_names(spark, str(tmp_path / "c.tsv")) == ["q", "p"]
    events = spark.createDataFrame([("j", "s", "begun", 1)], "job string, stage string, state string, at long")
    for _ in range(2):
        files.append_stage_events(events, str(tmp_path / "events"))
    assert files.event_lines(spark, str(tmp_path / "events")).filter("warning is null").count() == 2


def test_serving_scan(spark):
    spark.range(20).selectExpr("id", "id % 3 as reward", "'x' as other").createOrReplaceTempView("served")
    got = files.serving_scan(spark, "served", ["id"], 2, reward=1)
    assert got.columns == ["id"] and sorted(r.id for r in got.collect()) == [1, 4]
    with pytest.raises(LookupError):
        files.serving_scan(spark, "unserved", ["id"], 1)


def test_strict_json(spark):
    texts = ["{}", "[1]", " 7 ", '"x"', "null", "", "{}}", "[1] [2]", "1, 2", "1} {", '1, "v": 2', "{", "nul", None, '{"a":']
    got = [r.ok for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(strict_json(F.col("t")).isNotNull().alias("ok")).collect()]

    def fine(t):
        try:
            return t is not None and (json.loads(t), True)[1]
        except ValueError:
            return False

    assert got == [fine(t) for t in texts]


def test_items_without_ids_times_or_titles(spark):
    raw = [("news", '{"title":""}'), ("github", '{"url":"","title":"T"}'), ("youtube", '{"video_id":"v","video_info":{"title":"a","publishtime":"2024-02-30"}}'), ("twitter", '{"text":"' + "é" * 200 + '"}'), ("huggingface", '{"url":"u","published_at":"2024-01-01 10:00:00+01:00"}')]
    rows = spark.createDataFrame(raw, "source string, j string").select("source", F.parse_json("j").alias("item"))
    got = {r.source: r for r in scope.scope_items(rows).withColumn("published_at", F.unix_timestamp("published_at")).drop("data").collect()}
    assert got["news"].source_id == "news:" + sha256(b'{"title": ""}').hexdigest()[:16] and got["news"].title is None
    assert got["github"].source_id == "github:T" and got["youtube"].source_id == "youtube:v" and got["youtube"].published_at is None
    assert got["twitter"].title == "é" * 160 and got["huggingface"].published_at == 1704099600
    assert scope.scope_items(rows.limit(0)).count() == 0


def test_filtered_items_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", '{"x":1}'), ("a", "2", None), ("b", "3", "{}")], "source string, source_id string, j string").select("source", "source_id", F.parse_json("j").alias("data"))
    assert sorted((r.source, r.source_id, r.data) for r in scope.write_filtered(rows, str(tmp_path / "w")).collect()) == [("a", "1", '{"x":1}'), ("b", "3", "{}")]
    with pytest.raises(ValueError):
        scope.write_filtered(rows.filter("source_id = '2'"), str(tmp_path / "none"))


def test_nulls_give_defined_classes(spark):
    one = spark.range(1).select(outcomes.error_class(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("c"), outcomes.argument_issue(F.lit("get"), F.lit(None).cast("variant"), ["a"]).alias("i"), outcomes.failure_stage(F.lit(None).cast("int"), F.lit(None).cast("string")).alias("s")).first()
    assert one.c.reason == "internal_error" and one.c.retryable and one.i == "not_object" and one.s == "queued"


class _Service:
    """A paged service on this machine that fails the first calls of each page it is told to."""

    def __init__(self, rows, failures=None, total=True):
        import threading
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

        calls = self.calls = []
        failures = dict(failures or {})

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                calls.append((asked["page"], self.headers.get("X-Key")))
                left = failures.get(asked["page"], [])
                status = left.pop(0) if left else 200
                found = rows[(asked["page"] - 1) * asked["size"] : asked["page"] * asked["size"]]
                body = json.dumps({"code": 0, "trace_id": f"t{asked['page']}", "data": {**({"total": len(rows)} if total else {}), "list": found}}).encode()
                self.send_response(status)
                self.send_header("Retry-After", "0")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}/search"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


def _pages(spark, service, **options):
    from tessaloom.sources.http import PagedJson

    spark.dataSource.register(PagedJson)
    return spark.read.format("paged_json").options(url=service.url, size="10", pages_per_task="2", **{"header.X-Key": "k"}, **options).load()


def test_pages_are_read_once_each_and_tried_again(spark):
    service = _Service([{"id": i} for i in range(47)], {1: [429], 3: [503, 503]})
    got = _pages(spark, service)
    from tessaloom.operators.normalize import envelopes, items

    ids = items(envelopes(got)).select(F.try_variant_get("item", "$.id", "int").alias("id"))
    assert sorted(r.id for r in ids.collect()) == list(range(47)) and all(key == "k" for _, key in service.calls)
    assert _pages(spark, service, max_pages="2").count() == 2


def test_pages_without_a_total_end_at_an_empty_one(spark):
    service = _Service([{"id": i} for i in range(25)], total=False)
    assert sorted(r.page for r in _pages(spark, service).collect()) == [1, 2, 3] and max(p for p, _ in service.calls) == 4
    assert _pages(spark, _Service([])).count() == 0


def test_refusals_are_errors():
    from tessaloom.sources import http

    service = _Service([{"id": 1}], {1: [403]})
    with pytest.raises(http.ServiceError, match="403"):
        http.fetch(service.url, b'{"page": 1, "size": 1}')
    assert len(service.calls) == 1
    slept = []
    with pytest.raises(http.ServiceError, match="no answer"):
        http.fetch("http://127.0.0.1:9/none", sleep=slept.append)
    assert slept == [1.0, 2.0] and http.waited({"Retry-After": "7"}, 0) == 7 and http.waited({"Retry-After": "x"}, 1) == 2
    for bad in (b"x", b"[]", b'{"code": 3}', b'{"code": 0, "data": {"list": 1}}'):
        with pytest.raises(http.ServiceError):
            http.envelope(bad, "u")


def test_requests():
    from tessaloom.sources.http import filing_search, page_address, price_request

    assert price_request("b", " brk-b ", "w", end="2024-01-02") == f"b/BRK-B?period1={1704239999 - 365 * 86400}&period2=1704239999&interval=1wk"
    assert price_request("b", "X", start="2024-01-02", now=5) == "b/X?period1=1704153600&period2=1704153600&interval=1d"
    assert filing_search("b", '"a b"', "10-K", "2024-01-01", "2024-02-01") == "b?q=%22a+b%22&forms=10-K&dateRange=custom&startdt=2024-01-01&enddt=2024-02-01"
    assert page_address(path="a/b.HTM") == ("path", "a/b.HTM")
    for bad in (lambda: price_request("b", ""), lambda: filing_search("b", "x", start="2024-01-01"), lambda: page_address("https://a", "b.html"), lambda: page_address("http://a"), lambda: page_address(path="a.txt")):
        with pytest.raises(ValueError):
            bad()


def test_bundles_are_published_whole(spark, tmp_path):
    from pyspark.errors import AnalysisException

    files.publish(spark.range(3), str(tmp_path), "r1")
    files.publish(spark.range(5), str(tmp_path), "r2")
    assert files.published(spark, str(tmp_path)).count() == 5
    with pytest.raises(AnalysisException):
        files.publish(spark.range(1), str(tmp_path), "r1")
    assert files.published(spark, str(tmp_path)).count() == 5
