"""Event plumbing: vocabulary, validation, classification, lookups and the funnel's stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.sources.views import product_events, table

#: The closed vocabulary of event names.
EVENT_NAMES = [
    "auth.code_requested", "auth.code_verified", "auth.code_failed", "auth.password_succeeded", "auth.password_failed", "auth.locked_out", "auth.logged_out", "user.registered",
    "project.created", "project.stage_entered", "project.stage_failed", "project.recovered", "project.transition_rejected",
    "gate.brief_confirmed", "gate.brief_edited", "gate.corpus_confirmed", "gate.source_toggled", "gate.source_deleted", "gate.script_approved", "gate.script_review_requested", "gate.blocked", "gate.resolved",
    "workflow.rewound", "episode.audio_downloaded", "episode.source_trace_opened", "episode.evidence_judged", "plan.reviewed", "plan.omitted_list_opened", "plan.duration_changed",
]

#: The stage of the funnel of each project state; failed states have none.
STAGE_OF_STATE = {
    "draft": 1, "brief_ready": 2, "sources_collecting": 3, "source_selection_required": 3, "corpus_building": 4, "corpus_ready": 4, "episode_planning": 5, "episode_planned": 5,
    "script_drafting": 6, "script_ready": 6, "script_verifying": 6, "script_review_required": 6, "script_verified": 6, "audio_generating": 7, "audio_ready": 7, "audio_verifying": 7, "complete": 7,
}

#: Words that decide the class of an error message, and of a gate's reason; the first match wins.
ERROR_WORDS = [
    ("timeout", ["timeout", "timed out", "deadline"]),
    ("coverage", ["coverage", "insufficient", "material gap"]),
    ("parser", ["parse", "parser", "json", "schema", "validation", "docling", "mineru"]),
    ("model", ["model", "gemini", "openai", "llm", "token", "rate limit", "quota"]),
]
GATE_WORDS = [
    ("coverage", ["coverage", "budget", "insufficient", "material"]),
    ("quality", ["quality", "verdict", "unsupported"]),
    ("preflight", ["preflight", "ready", "credential", "api key"]),
    ("selection", ["selection", "source", "corpus"]),
]


def stage_of_state(state: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in STAGE_OF_STATE.items() for x in pair]), state)


def classified(message: Column, words: list[tuple[str, list[str]]], empty: str) -> Column:
    text = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit("other")
    for name, tokens in reversed(words):
        hit = F.lit(False)
        for token in tokens:
            hit = hit | F.contains(text, F.lit(token))
        out = F.when(hit, name).otherwise(out)
    return F.when(text == "", empty).otherwise(out)


def p02_funnel_stages(spark, sf_dir):
    e = product_events(spark, sf_dir, "flow").where("name = 'project.stage_entered'")
    return e.groupBy("state", stage_of_state(F.col("state")).alias("funnel_stage")).agg(F.count("*").alias("events"))


def p06_last_event_times(spark, sf_dir):
    e = product_events(spark, sf_dir, "gate")
    return e.groupBy("name", "gate_name").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_at"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def p07_list_events(spark, sf_dir, name: str = "project.stage_entered", limit: int = 100):
    """Newest first: one top-k, no full sort."""
    e = product_events(spark, sf_dir).where(F.col("name") == name)
    return e.orderBy(F.desc("ts"), "event_id").limit(limit).select("event_id", "user_id", "project_id", "stage")


def p08_validated_events(spark, sf_dir):
    """Events by what is wrong with them; bad ones would go to a quarantine table."""
    e = product_events(spark, sf_dir, "flow")
    problem = (
        F.when(F.col("name").isNull() | ~F.col("name").isin(EVENT_NAMES), "unknown_name")
        .when((F.col("name") == "project.stage_entered") & F.col("state").isNull(), "no_state")
        .when((F.col("name") == "project.stage_failed") & (F.col("stage") > 6), "stage_out_of_range")
        .otherwise("valid")
    )
    return e.groupBy(problem.alias("outcome"), "name").agg(F.count("*").alias("events"))


def p09_error_classes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(classified(F.col("text"), ERROR_WORDS, "unknown").alias("error_class"), classified(F.col("text"), GATE_WORDS, "other").alias("gate_class")).agg(F.count("*").alias("documents"))


def p13_recent_days(spark, sf_dir, days: int = 3):
    """The newest days of a metric for each dimension."""
    from heddle.operators.metrics import METRICS

    m = METRICS["m35_stage_failure_rate"].compute(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("dimension_json").orderBy(F.desc("day")))
    return m.withColumn("place", place).where(F.col("place") <= days).select("dimension_json", "day", "value", "place")


QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] == "p" and name[1:3].isdigit()}


def _sql_cases(words, empty):
    text = "lower(coalesce(text, ''))"
    whens = " ".join(f"WHEN {' OR '.join(f'contains({text}, {chr(39)}{t}{chr(39)})' for t in tokens)} THEN '{name}'" for name, tokens in words)
    return f"CASE WHEN {text} = '' THEN '{empty}' {whens} ELSE 'other' END"


_STAGES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in STAGE_OF_STATE.items())
SQL = {
    "p02_funnel_stages": f"SELECT state, CASE state {_STAGES} END AS funnel_stage, count(*) AS events FROM flow_events WHERE name = 'project.stage_entered' GROUP BY ALL",
    "p06_last_event_times": "SELECT name, gate_name, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at, arg_max(event_id, (ts, event_id)) AS event_id FROM gate_events GROUP BY ALL",
    "p07_list_events": "SELECT event_id, user_id, project_id, stage FROM core_events WHERE name = 'project.stage_entered' ORDER BY ts DESC, event_id LIMIT 100",
    "p08_validated_events": "SELECT CASE WHEN name IS NULL OR name NOT IN (" + ", ".join(f"'{n}'" for n in EVENT_NAMES) + ") THEN 'unknown_name' WHEN name = 'project.stage_entered' AND state IS NULL THEN 'no_state' WHEN name = 'project.stage_failed' AND stage > 6 THEN 'stage_out_of_range' ELSE 'valid' END AS outcome, name, count(*) AS events FROM flow_events GROUP BY ALL",
    "p09_error_classes": f"SELECT {_sql_cases(ERROR_WORDS, 'unknown')} AS error_class, {_sql_cases(GATE_WORDS, 'other')} AS gate_class, count(*) AS documents FROM documents GROUP BY ALL",
}
