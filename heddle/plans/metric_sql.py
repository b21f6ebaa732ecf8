"""DuckDB SQL for the metrics, over the views of heddle.sources.views."""

from __future__ import annotations

from heddle.operators.metrics import ACTIVE_AS_OF, IDLE_AS_OF

ENTERED = "name = 'project.stage_entered'"
DONE = f"{ENTERED} AND stage = 7"


def out(value: str, numerator: str = "NULL", denominator: str = "NULL", day: str = "day", dim: str = "'{}'", more: str = "") -> str:
    return f"SELECT {day} AS day, {dim} AS dimension_json, ({value})::DOUBLE AS value, ({numerator})::DOUBLE AS numerator, ({denominator})::DOUBLE AS denominator{more}"


def ratio(n: str, d: str, day: str = "day", dim: str = "'{}'") -> str:
    return out(f"({n})::DOUBLE / nullif(({d})::DOUBLE, 0)", n, d, day, dim)


def dim(**names: str) -> str:
    return "json_object(" + ", ".join(f"'{k}', {v}" for k, v in names.items()) + ")::VARCHAR"


def quantile(q: float, day: str = "day", dim_: str = "'{}'", x: str = "secs") -> str:
    return out(f"quantile_cont({x}, {q})", day=day, dim=dim_, more=f", avg({x})::DOUBLE AS value_ref")


def secs(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 1e6)"


COHORT = "regs AS (SELECT user_id, min(ts) AS at, arg_min(week, ts) AS week FROM core WHERE name = 'user.registered' AND user_id IS NOT NULL GROUP BY user_id)"
ENTRIES = f"entries AS (SELECT project_id, stage, min(ts) AS at, min(day) AS day FROM core WHERE {ENTERED} GROUP BY ALL)"
DEEPEST = f"deepest AS (SELECT project_id, max(stage) AS stage, max(ts) AS last, min(day) AS day, min(day) FILTER (stage = 5) AS five FROM fine WHERE {ENTERED} GROUP BY 1)"
IDLE = f"epoch_us(TIMESTAMP '{IDLE_AS_OF}') - epoch_us(last) >= 14 * 86400 * 1000000::BIGINT"
PLANNED = f"planned AS (SELECT project_id, min(day) AS day FROM flow WHERE {ENTERED} AND state = 'episode_planned' GROUP BY 1)"
FIRST_EPISODE = f"WITH {COHORT}, f AS (SELECT r.user_id, any_value(r.week) AS week, min({secs('r.at', 'e.ts')}) AS secs FROM regs r JOIN core e ON e.user_id = r.user_id AND e.name = 'project.stage_entered' AND e.stage = 7 GROUP BY 1) "
END_TO_END = f"WITH made AS (SELECT project_id, min(ts) AS at, min(day) AS day FROM core WHERE name = 'project.created' GROUP BY 1), done AS (SELECT project_id, min(ts) AS at FROM core WHERE {DONE} GROUP BY 1), f AS (SELECT m.day, {secs('m.at', 'd.at')} AS secs FROM made m JOIN done d USING (project_id)) "


def _recent(days: int) -> str:
    return f"epoch_us(TIMESTAMP '{ACTIVE_AS_OF}') - epoch_us(ts) <= {days} * 86400 * 1000000::BIGINT"


def _cost(projects: str, calls: str) -> str:
    return f"WITH {projects}, k AS (SELECT project_id, sum(cost_micros) AS cost FROM model_calls WHERE {calls} cost_micros IS NOT NULL GROUP BY 1) " + ratio("sum(coalesce(cost, 0))", "count(DISTINCT p.project_id)") + " FROM p LEFT JOIN k USING (project_id) GROUP BY day"


SQL: dict[str, str] = {
    "m01_trusted_episodes_weekly": f"WITH c AS (SELECT DISTINCT project_id, week AS day FROM core WHERE {DONE}) " + out("count(*)", "count(*)") + " FROM c WHERE project_id IN (SELECT project_id FROM core WHERE name = 'episode.audio_downloaded') GROUP BY day",
    "m02_auth_request_to_verify_rate": ratio("count(*) FILTER (name = 'auth.code_verified')", "count(*) FILTER (name = 'auth.code_requested')") + " FROM auth WHERE name IN ('auth.code_requested', 'auth.code_verified') GROUP BY day",
    "m03_auth_verify_failure_rate": ratio("count(*) FILTER (name = 'auth.code_failed')", "count(*)") + " FROM auth WHERE name IN ('auth.code_failed', 'auth.code_verified') GROUP BY day",
    "m04_auth_median_seconds_to_verify": "WITH v AS (SELECT * FROM auth WHERE name = 'auth.code_verified'), p AS (SELECT v.event_id, v.day, v.ts, max(r.ts) AS asked FROM v JOIN auth r ON r.name = 'auth.code_requested' AND r.ts <= v.ts AND (r.user_id = v.user_id OR r.anon_id = v.anon_id) GROUP BY ALL) " + out(f"avg({secs('asked', 'ts')})") + " FROM p GROUP BY day",
    "m05_auth_lockout_rate": "WITH a AS (SELECT day, count(DISTINCT coalesce(user_id, anon_id)) AS d FROM auth WHERE name IN ('auth.code_requested', 'auth.code_failed', 'auth.password_failed', 'auth.password_succeeded') GROUP BY 1), l AS (SELECT day, count(DISTINCT coalesce(user_id, anon_id)) AS n FROM auth WHERE name = 'auth.locked_out' GROUP BY 1) " + ratio("coalesce(n, 0)", "d") + " FROM a LEFT JOIN l USING (day)",
    "m06_new_users_weekly": out("count(DISTINCT user_id)", "count(DISTINCT user_id)", day="week") + " FROM core WHERE name = 'user.registered' GROUP BY week",
    "m07_activation_rate_7d": f"WITH {COHORT}, a AS (SELECT DISTINCT r.user_id FROM regs r JOIN core e ON e.user_id = r.user_id AND e.name = 'project.stage_entered' AND e.stage = 7 AND {secs('r.at', 'e.ts')} <= 7 * 86400) " + ratio("count(a.user_id)", "count(*)", day="week") + " FROM regs LEFT JOIN a ON a.user_id = regs.user_id GROUP BY week",
    "m08_time_to_first_episode_p50": FIRST_EPISODE + quantile(0.5, "week") + " FROM f GROUP BY week",
    "m09_time_to_first_episode_p90": FIRST_EPISODE + quantile(0.9, "week") + " FROM f GROUP BY week",
    "m10_first_project_rate": f"WITH {COHORT} " + ratio("count(*) FILTER (user_id IN (SELECT user_id FROM core WHERE name = 'project.created'))", "count(*)", day="week") + " FROM regs GROUP BY week",
    "m11_first_session_depth": f"WITH f AS (SELECT user_id, arg_min(project_id, (ts, project_id)) AS project_id, min(day) AS day FROM core WHERE name = 'project.created' GROUP BY 1), s AS (SELECT f.user_id, f.day, max(stage) AS stage FROM f JOIN core e ON e.project_id = f.project_id AND e.{ENTERED} GROUP BY ALL) " + out("count(*)", "count(*)", dim=dim(stage="stage")) + " FROM s GROUP BY day, stage",
    "m12_stage_conversion": f"WITH {ENTRIES}, b AS (SELECT day, stage, count(*) AS n FROM entries GROUP BY ALL) " + ratio("coalesce(b.n, 0)", "a.n", day="a.day", dim=dim(from_stage="a.stage", to_stage="a.stage + 1")) + " FROM b a LEFT JOIN b ON b.day = a.day AND b.stage = a.stage + 1 WHERE a.stage BETWEEN 1 AND 6",
    "m13_stage_dropoff_absolute": f"WITH {DEEPEST} " + out("count(*)", "count(*)", day=f"'{IDLE_AS_OF[:10]}'", dim=dim(stage="stage")) + f" FROM deepest WHERE {IDLE} AND stage < 7 GROUP BY stage",
    "m14_stage_median_duration": f"WITH {ENTRIES}, d AS (SELECT a.stage, a.day, {secs('a.at', 'b.at')} AS secs FROM entries a JOIN entries b ON a.project_id = b.project_id AND b.stage = a.stage + 1) " + quantile(0.5, dim_=dim(stage="stage")) + " FROM d GROUP BY day, stage",
    "m15_end_to_end_completion_rate": f"WITH {ENTRIES} " + ratio("count(*) FILTER (project_id IN (SELECT project_id FROM entries WHERE stage = 7))", "count(*)") + " FROM entries WHERE stage = 1 GROUP BY day",
    "m16_end_to_end_duration_p50": END_TO_END + quantile(0.5) + " FROM f GROUP BY day",
    "m17_end_to_end_duration_p90": END_TO_END + quantile(0.9) + " FROM f GROUP BY day",
    "m18_brief_confirm_rate": ratio("count(*) FILTER (project_id NOT IN (SELECT project_id FROM gate WHERE name = 'gate.brief_edited'))", "count(*)") + " FROM gate WHERE name = 'gate.brief_confirmed' GROUP BY day",
    "m19_corpus_edit_depth": "WITH c AS (SELECT project_id, min(day) AS day FROM gate WHERE name = 'gate.corpus_confirmed' GROUP BY 1), e AS (SELECT project_id, day FROM gate WHERE name IN ('gate.source_toggled', 'gate.source_deleted')) " + ratio("count(e.project_id)", "count(DISTINCT c.project_id)", day="c.day") + " FROM c LEFT JOIN e ON e.project_id = c.project_id AND e.day <= c.day GROUP BY c.day",
    "m20_script_approval_rate": ratio("count(*) FILTER (name = 'gate.script_approved')", "count(*)") + " FROM flow WHERE name IN ('gate.script_approved', 'gate.script_review_requested') GROUP BY day",
    "m21_script_rework_loops": ratio("count(*)", "count(DISTINCT project_id)") + f" FROM flow WHERE {ENTERED} AND from_state = 'script_verifying' AND state = 'script_drafting' GROUP BY day",
    "m22_gate_block_rate": "WITH a AS (SELECT day, count(DISTINCT project_id) AS d FROM gate GROUP BY 1), b AS (SELECT day, gate_name, count(DISTINCT project_id) AS n FROM gate WHERE name = 'gate.blocked' GROUP BY ALL) " + ratio("n", "d", dim=dim(gate_name="gate_name")) + " FROM a JOIN b USING (day)",
    "m23_gate_resolution_rate": "WITH b AS (SELECT day, gate_name, count(*) AS d FROM gate WHERE name = 'gate.blocked' GROUP BY ALL), r AS (SELECT day, gate_name, count(*) AS n FROM gate WHERE name = 'gate.resolved' GROUP BY ALL) " + ratio("coalesce(n, 0)", "d", dim=dim(gate_name="gate_name")) + " FROM b LEFT JOIN r USING (day, gate_name)",
    "m24_gate_median_blocked_seconds": quantile(0.5, dim_=dim(gate_name="gate_name"), x="blocked_seconds") + " FROM gate WHERE name = 'gate.resolved' GROUP BY day, gate_name",
    "m25_rewind_rate": "WITH a AS (SELECT day, count(DISTINCT project_id) AS d FROM gate GROUP BY 1), b AS (SELECT day, from_stage, count(DISTINCT project_id) AS n FROM gate WHERE name = 'workflow.rewound' GROUP BY ALL) " + ratio("n", "d", dim=dim(from_stage="from_stage")) + " FROM a JOIN b USING (day)",
    "m26_plan_review_depth_rate": "WITH r AS (SELECT day, count(*) AS d FROM gate WHERE name = 'plan.reviewed' GROUP BY 1), o AS (SELECT day, origin, count(*) AS n FROM gate WHERE name = 'plan.omitted_list_opened' GROUP BY ALL) " + ratio("n", "d", dim=dim(origin="origin")) + " FROM o JOIN r USING (day)",
    "m27_plan_duration_adjust_rate": f"WITH {PLANNED} " + ratio("count(*) FILTER (project_id IN (SELECT project_id FROM flow WHERE name = 'plan.duration_changed'))", "count(*)") + " FROM planned GROUP BY day",
    "m28_plan_duration_increase_share": ratio("count(*) FILTER (direction = 'up')", "count(*)") + " FROM gate WHERE name = 'plan.duration_changed' GROUP BY day",
    "m29_plan_gate_abandon_rate": f"WITH {DEEPEST} " + ratio(f"count(*) FILTER (stage = 5 AND {IDLE})", "count(*)", day="five") + " FROM deepest WHERE five IS NOT NULL GROUP BY five",
    "m30_plan_replan_before_approval": f"WITH {PLANNED}, r AS (SELECT project_id, count(*) AS n FROM flow WHERE {ENTERED} AND from_state = 'episode_planned' AND state = 'episode_planning' GROUP BY 1) " + quantile(0.5, x="coalesce(n, 0)") + " FROM planned LEFT JOIN r USING (project_id) GROUP BY day",
    "m31_source_trace_open_rate": f"WITH c AS (SELECT day, count(DISTINCT project_id) AS d FROM flow WHERE {DONE} GROUP BY 1), o AS (SELECT day, count(DISTINCT project_id) AS n FROM flow WHERE name = 'episode.source_trace_opened' GROUP BY 1) " + ratio("coalesce(n, 0)", "d") + " FROM c LEFT JOIN o USING (day)",
    "m32_coverage_block_rate": out("count(DISTINCT project_id)", "count(DISTINCT project_id)") + " FROM gate WHERE name = 'gate.blocked' AND gate_name = 'g2' GROUP BY day",
    "m33_claim_retention_rate": ratio("sum(kept)", "sum(kept) + sum(dropped)") + " FROM flow_events WHERE name = 'corpus.evidence_attempts' GROUP BY day",
    "m34_episodes_per_source_count": ratio(f"count(DISTINCT project_id) FILTER (project_id IN (SELECT project_id FROM core WHERE {DONE}))", "count(DISTINCT project_id)", dim=dim(source_count="source_count")) + " FROM gate WHERE name = 'gate.corpus_confirmed' GROUP BY day, source_count",
    "m35_stage_failure_rate": f"WITH e AS (SELECT day, stage, count(*) AS d FROM core WHERE {ENTERED} GROUP BY ALL), f AS (SELECT day, stage, count(*) AS n FROM core WHERE name = 'project.stage_failed' GROUP BY ALL) " + ratio("coalesce(n, 0)", "d", dim=dim(stage="stage")) + " FROM e LEFT JOIN f USING (day, stage)",
    "m36_recovery_rate": "WITH f AS (SELECT day, count(*) AS d FROM flow WHERE name = 'project.stage_failed' GROUP BY 1), r AS (SELECT day, count(*) AS n FROM flow WHERE name = 'project.recovered' GROUP BY 1) " + ratio("coalesce(n, 0)", "d") + " FROM f LEFT JOIN r USING (day)",
    "m37_permanent_failure_rate": "WITH c AS (SELECT day, count(DISTINCT project_id) AS d FROM flow WHERE name = 'project.created' GROUP BY 1), p AS (SELECT day, count(DISTINCT project_id) AS n FROM flow WHERE name = 'project.stage_failed' AND permanent GROUP BY 1) " + ratio("coalesce(n, 0)", "d") + " FROM c LEFT JOIN p USING (day)",
    "m38_user_visible_failure_rate": ratio("count(DISTINCT user_id) FILTER (name = 'project.stage_failed')", "count(DISTINCT user_id)") + " FROM core WHERE user_id IS NOT NULL GROUP BY day",
    "m39_wau": out("count(DISTINCT user_id)", "count(DISTINCT user_id)", day=f"'{ACTIVE_AS_OF[:10]}'") + f" FROM core WHERE {_recent(7)}",
    "m40_mau": out("count(DISTINCT user_id)", "count(DISTINCT user_id)", day=f"'{ACTIVE_AS_OF[:10]}'") + f" FROM core WHERE {_recent(30)}",
    "m41_w1_w4_retention": f"WITH {COHORT}, a AS (SELECT DISTINCT user_id, week FROM core), j AS (SELECT r.week AS day, r.user_id, (a.week::DATE - r.week::DATE) // 7 AS week_n FROM regs r JOIN a ON a.user_id = r.user_id) " + out("count(DISTINCT user_id)", "count(DISTINCT user_id)", "(SELECT count(*) FROM regs WHERE regs.week = j.day)", dim=dim(week_n="week_n")) + " FROM j WHERE week_n BETWEEN 1 AND 4 GROUP BY day, week_n",
    "m42_projects_per_user_p50": f"WITH p AS (SELECT user_id, count(DISTINCT project_id) AS n FROM core WHERE name = 'project.created' AND {_recent(30)} GROUP BY 1) " + quantile(0.5, day=f"'{ACTIVE_AS_OF[:10]}'", x="n") + " FROM p",
    "m43_resumption_rate": f"WITH g AS (SELECT DISTINCT project_id FROM (SELECT project_id, ts, lag(ts) OVER (PARTITION BY project_id ORDER BY ts) AS prev FROM core) WHERE {secs('prev', 'ts')} >= 3 * 3600), made AS (SELECT project_id, min(day) AS day FROM core WHERE name = 'project.created' GROUP BY 1) " + ratio(f"count(*) FILTER (project_id IN (SELECT project_id FROM g) AND project_id IN (SELECT project_id FROM core WHERE {DONE}))", "count(*)") + " FROM made GROUP BY day",
    "m44_cost_per_completed_episode": _cost(f"p AS (SELECT project_id, min(day) AS day FROM core WHERE {DONE} GROUP BY 1)", "status = 'succeeded' AND"),
    "m45_cost_per_abandoned_project": _cost(f"{DEEPEST}, p AS (SELECT project_id, day FROM deepest WHERE {IDLE} AND stage < 7)", ""),
}
