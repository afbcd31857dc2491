"""Outcomes of calls and jobs: the public class of an error, checks of arguments and reports, logs
in which a call is reserved before it is made, and questions a graph must be able to answer."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json_paths import strict_json
from .normalize import get, is_a
from .validation import identifier_fine

#: Reasons of codes that name them.
INTENT = {"invalid_query": "invalid_instruction", "invalid_scope": "invalid_instruction", "unsupported_scope": "unsupported_instruction", "module_required": "module_required", "time_range_not_supported": "time_range_not_supported", "invalid_time_expression": "invalid_instruction"}
SERVICE = {"invalid_{agent}_config": "configuration_invalid", "{agent}_binary_not_found": "dependency_missing", "explorer_runtime_not_ready": "dependency_missing", "service_restarted": "service_restarted", "service_shutdown": "service_shutdown"}
ARTIFACT = {"invalid_insight_count": "empty_insights", "insight_format_invalid": "schema_invalid", "quality_review_failed": "quality_review_failed", "{agent}_event_parse_error": "invalid_agent_output"}
RENAMED = {"output_contract_failed": "invalid_insights", "stage_artifact_invalid": "invalid_insights", "domain_review_failed": "quality_review_failed", "run_cancelled": "service_shutdown", "server_configuration_invalid": "invalid_{agent}_config", "{source}_modeling_raw_acquisition_failed": "{source}_acquisition_failed", "{source}_modeling_raw_empty": "no_source_data"}
#: Marks in codes and messages, and the reasons they stand for, the first that fits.
TIMEOUT = "timeout|timed out"
TRANSPORT = "timeout|timed out|connection|reset by peer|network|unreachable"
MODEL = "{agent}_model_error|model error|model_error|model request|openai|maximum retry|max retries|max_retries"
ARTIFACT_MARKS = r"insight_candidates\.json|invalid json|required schema|missing required|contains no insight|quality review"
MODEL_REASONS = {"authentication_failed": "401|403|unauthorized|api key|authentication", "rate_limited": "429|rate limit", "request_timeout": TIMEOUT, "max_retries_exceeded": "max.*retr|retr.*max", "model_terminated": "terminated|connection reset|connection aborted", "invalid_request": "invalid|400"}
SOURCE_REASONS = {"no_data": "no data|non-zero total record", "authentication_failed": "invalid_api_key|401|403|unauthorized|api key format|authentication", "rate_limited": "429|rate limit", "request_timeout": TIMEOUT, "max_retries_exceeded": "max.*retr|retr.*max", "invalid_response": "invalid_response|invalid response|non-json", "connection_failed": "network|connection|reset by peer|unreachable"}
ANALYSIS_REASONS = {"agent_timeout": "cli timed out", "ontology_review_rejected": "review.*(reject|unusable|terminal_failed)|(reject|unusable|terminal_failed).*review", "ontology_build_failed": "stage1|^[^ ]*ontology", "insight_extraction_failed": "insight"}
ARTIFACT_REASONS = {"empty_insights": "contains no insight", "output_missing": "missing", "invalid_json": "invalid json|not valid json", "source_reference_invalid": "source.*(reference|url)|(reference|url).*source", "quality_review_failed": "quality review"}
#: Reasons after which a retry is of no use.
FINAL = {"model_error": ("authentication_failed", "invalid_request"), "source_error": ("authentication_failed", "no_data", "invalid_request"), "artifact_error": ("schema_invalid", "source_reference_invalid"), "analysis_error": ("ontology_review_rejected",), "service_error": ("configuration_invalid", "dependency_missing")}


def _lookup(code: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(code == k, v) for k, v in table.items()))


def _cases(*cases: tuple[Column, str | Column], default: str | Column) -> Column:
    out = F.when(*cases[0])
    for when, value in cases[1:]:
        out = out.when(when, value)
    return out.otherwise(default)


def error_class(code: Column, message: Column, stage: Column, agent: str = "agent", source: str = "source") -> Column:
    """(category, reason, retryable, action) of a failure; ``agent`` and ``source`` are the
    prefixes that the codes of the agent and of the data source have."""
    named = lambda t: {k.format(agent=agent, source=source): v.format(agent=agent, source=source) for k, v in t.items()}
    raw = F.element_at(F.split(F.lower(F.trim(F.coalesce(code, F.lit("")))), ":"), 1)
    text = F.lower(F.concat_ws(" ", F.coalesce(code, F.lit("")), F.coalesce(message, F.lit(""))))
    modeling = (raw.startswith(f"{source}_modeling_") | (raw == "server_modeling_failed")) & ~raw.isin(*(k for k in named(RENAMED) if k.startswith(f"{source}_modeling_")))
    c = F.coalesce(_lookup(raw, named(RENAMED)), raw)
    late = text.rlike(TIMEOUT)
    told = lambda reasons: [(text.rlike(shape), reason) for reason, shape in reasons.items()]
    model = _cases(*told(MODEL_REASONS), default="model_unavailable")
    data = _cases(
        (c == f"{source}_network_error", F.when(late, "request_timeout").otherwise("connection_failed")),
        (c.isin("no_source_data", f"{agent}_ontology_raw_empty"), "no_data"), *told(SOURCE_REASONS), (c.rlike(r"http_[45]\d\d"), "upstream_error"), default="acquisition_failed")
    analysis = _cases((c == f"{agent}_output_incomplete", "insight_extraction_failed"), (c == f"{agent}_process_timeout", "agent_timeout"), *told(ANALYSIS_REASONS), (c.startswith(f"{agent}_process_nonzero_exit"), "agent_process_failed"), default="agent_analysis_failed")
    artifact = F.coalesce(_lookup(c, named(ARTIFACT)), _cases(*told(ARTIFACT_REASONS), default="schema_invalid"))

    made = lambda category, reason: F.struct(F.lit(category).alias("category"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    broken = (c == "internal_error") & text.rlike(TRANSPORT)
    of = _cases(
        (raw == "intent_model_failed", made("model_error", "intent_recognition_failed")),
        (modeling, made("analysis_error", F.when(raw.contains("review"), "ontology_review_rejected").otherwise("ontology_build_failed"))),
        (broken & (stage == f"fetching_{source}"), made("source_error", F.when(late, "request_timeout").otherwise("connection_failed"))),
        (broken & (stage == f"analyzing_with_{agent}"), made("model_error", F.when(late, "request_timeout").otherwise("model_terminated"))),
        (c == "internal_error", made("service_error", "internal_error")),
        (c.isin(*INTENT), made("intent_error", _lookup(c, INTENT))),
        (c.isin(*named(SERVICE)), made("service_error", _lookup(c, named(SERVICE)))),
        ((c == f"{agent}_model_error") | text.rlike(MODEL.format(agent=agent)), made("model_error", model)),
        (c.startswith(f"{source}_") | c.isin("no_source_data", f"{agent}_ontology_raw_acquisition_failed", f"{agent}_ontology_raw_empty"), made("source_error", data)),
        (c.isin(f"{agent}_process_timeout", f"{agent}_process_nonzero_exit"), made("analysis_error", analysis)),
        ((c == "invalid_insights") | c.isin(*named(ARTIFACT)) | text.rlike(ARTIFACT_MARKS), made("artifact_error", artifact)),
        (c.startswith(f"{agent}_"), made("analysis_error", analysis)),
        default=made("service_error", "internal_error"))
    category, reason = of["category"], of["reason"]
    final = reduce(lambda a, b: a | b, ((category == k) & reason.isin(*v) for k, v in FINAL.items())) | (category == "intent_error")
    action = _cases(
        ((category == "service_error") & (reason != "configuration_invalid"), "retry"), ((category == "service_error"), "contact_administrator"),
        (category == "intent_error", "revise_request"), (reason == "authentication_failed", "contact_administrator"),
        (reason.isin("no_data", "source_reference_invalid", "ontology_review_rejected"), "revise_request"),
        ((category == "model_error") & (reason != "intent_recognition_failed"), "retry_or_switch_model"), default="retry")
    return F.struct(category.alias("category"), reason.alias("reason"), (~final).alias("retryable"), action.alias("action"))


#: By progress, the stage that a job was at.
STAGES = ((90, "validating_insights"), (40, "analyzing_with_{agent}"), (30, "source_ready"), (15, "fetching_{source}"), (5, "preparing_workspace"))


def failure_stage(progress: Column, stored: Column, agent: str = "agent", source: str = "source") -> Column:
    """The stored stage unless it is blank or ``failed``, else the one of the progress."""
    known = F.when((stored != "") & (stored != "failed"), stored)
    return F.coalesce(known, _cases(*((progress >= n, s.format(agent=agent, source=source)) for n, s in STAGES), default="queued"))


def argument_issue(tool: Column, args: Column, fields: list[str]) -> Column:
    """Null, or why a call is refused. ``search``: reward 0, limit 1 and perhaps job and session.
    ``get``: a record, exactly one of the fields, and perhaps a job."""
    keys = F.map_keys(F.try_variant_get(args, "$", "map<string,variant>"))
    is_object = is_a(args, "OBJECT")
    has = lambda needed, allowed: is_object & (F.size(F.array_except(F.array(*map(F.lit, needed)), keys)) == 0) & (F.size(F.array_except(keys, F.array(*map(F.lit, needed + allowed)))) == 0)
    text = lambda k: is_a(get(args, k, "variant"), "STRING") & identifier_fine(get(args, k))
    maybe = lambda k: get(args, k, "variant").isNull() & ~F.coalesce(F.array_contains(keys, k), F.lit(False)) | text(k)
    number = reduce(lambda a, b: a | b, (is_a(get(args, "reward", "variant"), k) for k in ("BIGINT", "DOUBLE", "DECIMAL")))
    search = has(["reward", "limit"], ["job_id", "session_id"]) & number & (get(args, "reward", "double") == 0) & is_a(get(args, "limit", "variant"), "BIGINT") & (get(args, "limit", "long") == 1) & maybe("job_id") & maybe("session_id")
    listed = get(args, "fields", "array<string>")
    fetch = has(["record_id", "fields"], ["job_id"]) & (F.size(listed) == 1) & F.get(listed, F.lit(0)).isin(*fields) & text("record_id") & maybe("job_id")
    no = lambda fine: ~F.coalesce(fine, F.lit(False))
    return _cases((~is_object, "not_object"), ((tool == "search") & no(search), "search_arguments"), ((tool == "get") & no(fetch), "get_arguments"), (~tool.isin("search", "get"), "unknown_tool"), default=F.lit(None).cast("string"))


def reserved(calls: DataFrame) -> DataFrame:
    """Rows to append before the calls are made: a process that dies leaves a failed call."""
    return calls.select("call_id", F.lit(0).alias("phase"), F.lit("error").alias("transport"), F.lit(None).cast("string").alias("envelope"))


def filled(answers: DataFrame) -> DataFrame:
    """Rows to append after the calls; they replace the reserved ones."""
    return answers.select("call_id", F.lit(1).alias("phase"), "transport", "envelope")


def call_log(log: DataFrame) -> DataFrame:
    """Each call as it stands: its last row."""
    last = log.groupBy("call_id").agg(F.max(F.struct("phase", "transport", "envelope")).alias("x"))
    return last.select("call_id", "x.transport", "x.envelope")


def with_previous(attempts: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each attempt beside the one before it of the same job."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return attempts.withColumns({f"previous_{c}": F.lag(c).over(w) for c in columns})


def queue_order(jobs: DataFrame, submitted: str, key: str, waiting: Column) -> DataFrame:
    """Waiting jobs, the first submitted first; a range exchange, not one task."""
    return jobs.filter(waiting).orderBy(submitted, key)


def newest_first(jobs: DataFrame, created: str, key: str, limit: int) -> DataFrame:
    return jobs.orderBy(F.col(created).desc(), F.col(key).desc()).limit(limit)


@dataclass(frozen=True)
class Measure:
    """A count of quads of a predicate: with ``expected`` it must be that, else above none."""

    question: str
    name: str
    predicate: str
    expected: int | None = None
    supported: bool = True


def competency(quads: DataFrame, measures: list[Measure]) -> DataFrame:
    """question, status (pass, fail, or not_applicable where the source lacks a field), evidence.
    One aggregation by predicate; the measures are of the schema's size."""
    spark = quads.sparkSession
    rules = spark.createDataFrame([(m.question, m.name, m.predicate, m.expected, m.supported) for m in measures], "question string, name string, predicate string, expected long, supported boolean")
    counts = quads.groupBy("predicate").agg(F.count("*").alias("n"))
    both = F.broadcast(rules).join(counts.filter(F.col("predicate").isin(*{m.predicate for m in measures})), "predicate", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    fine = F.when(F.col("expected").isNull(), F.col("n") > 0).otherwise(F.col("n") == F.col("expected"))
    each = both.groupBy("question").agg(F.bool_and("supported").alias("s"), F.bool_and(fine).alias("f"), F.array_sort(F.collect_list(F.format_string("%s=%d", "name", "n"))).alias("evidence"))
    return each.select("question", F.when(~F.col("s"), "not_applicable").when(F.col("f"), "pass").otherwise("fail").alias("status"), F.array_join("evidence", ",").alias("evidence"))


def output_issue(text: Column, listed: bool = True) -> Column:
    """Null, or what is wrong with an output file's text: missing, empty, not_json, not_list."""
    v = strict_json(text)
    return F.when(text.isNull(), "missing").when(text.rlike(r"^\s*$"), "empty").when(v.isNull(), "not_json").when(F.lit(listed) & ~is_a(v, "ARRAY"), "not_list")


#: What a report of bounded reads must always say of its limits.
ALWAYS = ("bounded_record_not_full_session", "granularity_unverified")


def report_issues(reports: DataFrame) -> DataFrame:
    """(report_id, code) of reports on calls: report_id, status, objective, asked (the objective
    given), uncertainty, limitations, read (error, empty or ok), empty_get, truncated,
    trace_state, and statements key_failure, direct_cause, task_goal, success_condition, outcome.
    The status must follow from what was read, the limitations must name all that was cut or is
    unknown, and only a located failure may have a cause."""
    c = F.col
    needed = [F.array(*map(F.lit, ALWAYS)), F.when(c("truncated"), F.array(F.lit("truncated_output"))), F.when(c("trace_state") != "present", F.array(F.concat(F.lit("chosen_trace_"), "trace_state")))]
    needed += [F.when(c(f).isNull(), F.array(F.lit(f"{f}_unknown"))) for f in ("task_goal", "success_condition", "outcome")]
    none = F.array().cast("array<string>")
    missing = F.array_except(F.flatten(F.array(*(F.coalesce(x, none) for x in needed))), F.coalesce("limitations", none))
    status = F.when(c("read") == "error", c("status") == "read_failed").when(c("read") == "empty", c("status") == "no_records").when(c("empty_get"), c("status") == "insufficient_evidence").otherwise(c("status").isin("located", "insufficient_evidence"))
    blank = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    located = c("status") == "located"
    codes = [
        F.when(~c("objective").eqNullSafe(c("asked")), "objective_mismatch"),
        F.when(blank(c("uncertainty")) | F.exists(F.coalesce("limitations", none), blank), "limitations_required"),
        F.when(F.size(missing) > 0, "limitations_mismatch"),
        F.when(~F.coalesce(status, F.lit(False)), "status_mismatch"),
        F.when(located & (c("truncated") | (c("trace_state") != "present")), "insufficient_trace"),
        F.when(located & (blank(c("key_failure")) | blank(c("direct_cause")) | blank(c("task_goal")) | blank(c("success_condition"))), "support_required"),
        F.when(~located & (c("key_failure").isNotNull() | c("direct_cause").isNotNull()), "unsupported_localization"),
    ]
    return reports.select("report_id", F.explode(F.array_compact(F.array(*codes))).alias("code"))
