"""Product metrics: 45 definitions over product events.

Every metric returns day, dimension_json, value, numerator, denominator (and value_ref, the mean, where the value is
a percentile).  A ratio whose denominator is 0 is null.  ``as_of`` is a parameter wherever a metric depends on
the present.  Days and weeks are ISO text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions.columns import iso, ref_week, seconds_between, share
from heddle.sources.views import model_calls, product_events, real

ENTERED, LAST_STAGE, IDLE_DAYS = "project.stage_entered", 7, 14
ACTIVE_AS_OF, IDLE_AS_OF = "2024-01-31 00:00:00", "2024-02-13 12:00:00"


@dataclass(frozen=True)
class Metric:
    key: str
    grain: str
    compute: Callable[[SparkSession, str], DataFrame]


METRICS: dict[str, Metric] = {}


def metric(key: str, grain: str = "day"):
    def keep(fn):
        METRICS[key] = Metric(key, grain, fn)
        return fn

    return keep


def events(spark: SparkSession, sf_dir: str, family: str, projects: int = 60) -> DataFrame:
    return real(product_events(spark, sf_dir, family, projects))


def named(df: DataFrame, *names: str) -> DataFrame:
    return df.where(F.col("name").isin(*names))


def rows(df: DataFrame, value: Column, numerator=None, denominator=None, day="day", **dims) -> DataFrame:
    """The common output columns; ``dims`` become dimension_json in the given order."""
    none = F.lit(None).cast("double")
    dimension = F.to_json(F.struct(*[F.col(c).alias(k) for k, c in dims.items()])) if dims else F.lit("{}")
    as_double = lambda c: none if c is None else (F.col(c) if isinstance(c, str) else c).cast("double")
    return df.select(F.col(day).alias("day"), dimension.alias("dimension_json"), value.cast("double").alias("value"), as_double(numerator).alias("numerator"), as_double(denominator).alias("denominator"))


def ratio(df: DataFrame, numerator="n", denominator="d", **dims) -> DataFrame:
    return rows(df, share(F.coalesce(F.col(numerator), F.lit(0)), F.col(denominator)), F.coalesce(F.col(numerator), F.lit(0)), denominator, **dims)


def counted(df: DataFrame, **dims) -> DataFrame:
    return rows(df, F.col("n"), "n", None, **dims)


def per(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[v.alias(k) for k, v in aggregates.items()])


def at_stage(df: DataFrame, stage: int) -> DataFrame:
    return named(df, ENTERED).where(F.col("stage") == stage)


def same_day_ratio(top: DataFrame, bottom: DataFrame, how: str = "right", keys: tuple = ("day",), **dims) -> DataFrame:
    """top.n over bottom.d by day (and more keys); ``right`` keeps days without a numerator."""
    return ratio(top.join(bottom, list(keys), how), **dims)


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First registration of each user with its reporting week."""
    regs = named(events(spark, sf_dir, "core"), "user.registered").where("user_id is not null")
    return per(regs, ["user_id"], at=F.min("ts")).withColumn("week", iso(ref_week(F.to_date("at"))))


@metric("m01_trusted_episodes_weekly", "week")
def m01(spark, sf_dir):
    e = events(spark, sf_dir, "core")
    done = at_stage(e, LAST_STAGE).select("project_id", F.col("week").alias("day")).distinct()
    return counted(per(done.join(named(e, "episode.audio_downloaded").select("project_id").distinct(), "project_id", "left_semi"), ["day"], n=F.count("*")))


def _share_of(spark, sf_dir, family, part, whole):
    e = named(events(spark, sf_dir, family), *whole)
    return ratio(per(e, ["day"], n=F.count_if(F.col("name").isin(*part)), d=F.count("*")))


@metric("m02_auth_request_to_verify_rate")
def m02(spark, sf_dir):
    e = named(events(spark, sf_dir, "auth"), "auth.code_requested", "auth.code_verified")
    return ratio(per(e, ["day"], n=F.count_if(F.col("name") == "auth.code_verified"), d=F.count_if(F.col("name") == "auth.code_requested")))


@metric("m03_auth_verify_failure_rate")
def m03(spark, sf_dir):
    return _share_of(spark, sf_dir, "auth", ["auth.code_failed"], ["auth.code_failed", "auth.code_verified"])


@metric("m04_auth_median_seconds_to_verify")
def m04(spark, sf_dir):
    """As-of join without a join: the last request at or before each verification, once by user and once by
    anonymous id; the later of the two counts.  The mean is the value, as the key's definition has it."""
    e = named(events(spark, sf_dir, "auth"), "auth.code_requested", "auth.code_verified")
    request = F.when(F.col("name") == "auth.code_requested", F.col("ts"))

    def latest(key: str) -> Column:
        w = Window.partitionBy(key).orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return F.last(request, ignorenulls=True).over(w)

    by_user = e.where("user_id is not null").withColumn("asked", latest("user_id"))
    by_anon = e.where("anon_id is not null").withColumn("asked", latest("anon_id"))
    found = by_user.unionByName(by_anon).where("name = 'auth.code_verified' and asked is not null")
    pairs = per(found, ["event_id"], day=F.first("day"), secs=F.min(seconds_between(F.col("asked"), F.col("ts"))))
    return rows(per(pairs, ["day"], v=F.avg("secs"), mid=F.median("secs")), F.col("v"))


@metric("m05_auth_lockout_rate")
def m05(spark, sf_dir):
    e = events(spark, sf_dir, "auth").withColumn("who", F.coalesce("user_id", "anon_id"))
    tried = per(named(e, "auth.code_requested", "auth.code_failed", "auth.password_failed", "auth.password_succeeded"), ["day"], d=F.countDistinct("who"))
    return same_day_ratio(per(named(e, "auth.locked_out"), ["day"], n=F.countDistinct("who")), tried)


@metric("m06_new_users_weekly", "week")
def m06(spark, sf_dir):
    e = named(events(spark, sf_dir, "core"), "user.registered").withColumn("day", F.col("week"))
    return counted(per(e, ["day"], n=F.countDistinct("user_id")))


@metric("m07_activation_rate_7d", "week")
def m07(spark, sf_dir):
    """The first finished episode decides: it is within seven days after registration if any is."""
    first = per(at_stage(events(spark, sf_dir, "core"), LAST_STAGE), ["user_id"], first=F.min("ts"))
    c = cohort(spark, sf_dir).join(first, "user_id", "left").withColumn("day", F.col("week"))
    in_time = seconds_between(F.col("at"), F.col("first")) <= 7 * 86400
    return ratio(per(c, ["day"], n=F.count_if(in_time), d=F.count("*")))


def _first_episode(spark, sf_dir, q):
    done = at_stage(events(spark, sf_dir, "core"), LAST_STAGE)
    first = per(done, ["user_id"], first=F.min("ts"))
    c = cohort(spark, sf_dir).join(first, "user_id").withColumn("secs", seconds_between(F.col("at"), F.col("first")))
    return _percentile(per(c.withColumn("day", F.col("week")), ["day"], v=F.percentile("secs", q), mean=F.avg("secs")))


def _percentile(df: DataFrame, **dims) -> DataFrame:
    names = df.columns
    out = rows(df.withColumn("numerator_", F.col("mean")), F.col("v"), "numerator_", None, **dims)
    assert "mean" in names
    return out.withColumnRenamed("numerator", "value_ref").withColumn("numerator", F.lit(None).cast("double"))


@metric("m08_time_to_first_episode_p50", "week")
def m08(spark, sf_dir):
    return _first_episode(spark, sf_dir, 0.5)


@metric("m09_time_to_first_episode_p90", "week")
def m09(spark, sf_dir):
    return _first_episode(spark, sf_dir, 0.9)


@metric("m10_first_project_rate", "week")
def m10(spark, sf_dir):
    made = named(events(spark, sf_dir, "core"), "project.created").select("user_id").distinct().withColumn("made", F.lit(1))
    c = cohort(spark, sf_dir).join(made, "user_id", "left").withColumn("day", F.col("week"))
    return ratio(per(c, ["day"], n=F.count("made"), d=F.count("*")))


@metric("m11_first_session_depth")
def m11(spark, sf_dir):
    e = events(spark, sf_dir, "core")
    made = named(e, "project.created").where("user_id is not null and project_id is not null")
    first = per(made, ["user_id"], f=F.min(F.struct("ts", "project_id"))).select("user_id", "f.project_id", iso(F.to_date("f.ts")).alias("day"))
    deepest = per(named(e, ENTERED), ["project_id"], stage=F.max("stage"))
    return counted(per(first.join(deepest, "project_id"), ["day", "stage"], n=F.count("*")), stage="stage")


def _entries(spark, sf_dir) -> DataFrame:
    return per(named(events(spark, sf_dir, "core"), ENTERED), ["project_id", "stage"], at=F.min("ts"))


@metric("m12_stage_conversion")
def m12(spark, sf_dir):
    """Both counts are of the same calendar day, so that a ratio may pass 1."""
    by = per(_entries(spark, sf_dir).withColumn("day", iso(F.to_date("at"))), ["day", "stage"], d=F.count("*"))
    after = by.select("day", (F.col("stage") - 1).alias("stage"), F.col("d").alias("n"))
    joined = by.where("stage between 1 and 6").join(after, ["day", "stage"], "left").withColumn("next", F.col("stage") + 1)
    return ratio(joined, from_stage="stage", to_stage="next")


def _deepest(spark, sf_dir) -> DataFrame:
    entered = named(events(spark, sf_dir, "core", projects=600), ENTERED)
    return per(entered, ["project_id"], stage=F.max("stage"), last=F.max("ts"), first=F.min("ts"), at_five=F.min(F.when(F.col("stage") == 5, F.col("ts"))))


def _idle(as_of: str) -> Column:
    return seconds_between(F.col("last"), F.lit(as_of).cast("timestamp")) >= IDLE_DAYS * 86400


@metric("m13_stage_dropoff_absolute")
def m13(spark, sf_dir, as_of=IDLE_AS_OF):
    stuck = _deepest(spark, sf_dir).where(_idle(as_of) & (F.col("stage") < LAST_STAGE)).withColumn("day", F.lit(as_of[:10]))
    return counted(per(stuck, ["day", "stage"], n=F.count("*")), stage="stage")


@metric("m14_stage_median_duration")
def m14(spark, sf_dir):
    """Seconds from the first entry of a stage to that of the next; negative where they are out of order."""
    w = Window.partitionBy("project_id").orderBy("stage")
    steps = _entries(spark, sf_dir).withColumns({"next": F.lead("stage").over(w), "then": F.lead("at").over(w)}).where("next = stage + 1")
    secs = steps.withColumns({"secs": seconds_between(F.col("at"), F.col("then")), "day": iso(F.to_date("at"))})
    return _percentile(per(secs, ["day", "stage"], v=F.median("secs"), mean=F.avg("secs")), stage="stage")


@metric("m15_end_to_end_completion_rate")
def m15(spark, sf_dir):
    p = per(_entries(spark, sf_dir), ["project_id"], start=F.min(F.when(F.col("stage") == 1, F.col("at"))), done=F.max(F.when(F.col("stage") == LAST_STAGE, 1)))
    return ratio(per(p.where("start is not null").withColumn("day", iso(F.to_date("start"))), ["day"], n=F.count("done"), d=F.count("*")))


def _end_to_end(spark, sf_dir, q):
    e = events(spark, sf_dir, "core")
    made = F.when(F.col("name") == "project.created", F.col("ts"))
    done = F.when((F.col("name") == ENTERED) & (F.col("stage") == LAST_STAGE), F.col("ts"))
    p = per(e, ["project_id"], made=F.min(made), done=F.min(done)).where("made is not null and done is not null")
    p = p.withColumns({"day": iso(F.to_date("made")), "secs": seconds_between(F.col("made"), F.col("done"))})
    return _percentile(per(p, ["day"], v=F.percentile("secs", q), mean=F.avg("secs")))


@metric("m16_end_to_end_duration_p50")
def m16(spark, sf_dir):
    return _end_to_end(spark, sf_dir, 0.5)


@metric("m17_end_to_end_duration_p90")
def m17(spark, sf_dir):
    return _end_to_end(spark, sf_dir, 0.9)


@metric("m18_brief_confirm_rate")
def m18(spark, sf_dir):
    e = events(spark, sf_dir, "gate")
    edited = named(e, "gate.brief_edited").select("project_id").distinct().withColumn("edited", F.lit(1))
    c = named(e, "gate.brief_confirmed").join(edited, "project_id", "left")
    return ratio(per(c, ["day"], n=F.count_if(F.col("edited").isNull()), d=F.count("*")))


@metric("m19_corpus_edit_depth")
def m19(spark, sf_dir):
    """A range join behind an equality: edits per project and day first, then those up to the first confirmation."""
    e = events(spark, sf_dir, "gate")
    edits = per(named(e, "gate.source_toggled", "gate.source_deleted"), ["project_id", "day"], edits=F.count("*")).withColumnRenamed("day", "edit_day")
    first = per(named(e, "gate.corpus_confirmed"), ["project_id"], at=F.min("ts")).withColumn("day", iso(F.to_date("at")))
    joined = first.join(edits, "project_id", "left").withColumn("m", F.when(F.col("edit_day") <= F.col("day"), F.col("edits")).otherwise(0))
    return ratio(per(joined, ["day"], n=F.sum("m"), d=F.countDistinct("project_id")))


@metric("m20_script_approval_rate")
def m20(spark, sf_dir):
    return _share_of(spark, sf_dir, "flow", ["gate.script_approved"], ["gate.script_approved", "gate.script_review_requested"])


@metric("m21_script_rework_loops")
def m21(spark, sf_dir):
    e = named(events(spark, sf_dir, "flow"), ENTERED).where("from_state = 'script_verifying' and state = 'script_drafting'")
    return ratio(per(e, ["day"], n=F.count("*"), d=F.countDistinct("project_id")))


def _active_projects(e: DataFrame) -> DataFrame:
    return per(e.where("project_id is not null"), ["day"], d=F.countDistinct("project_id"))


def _gate(e: DataFrame, name: str, n: Column) -> DataFrame:
    return per(named(e, name).withColumn("gate_name", F.coalesce("gate_name", F.lit("unknown"))), ["day", "gate_name"], n=n)


@metric("m22_gate_block_rate")
def m22(spark, sf_dir):
    e = events(spark, sf_dir, "gate")
    return same_day_ratio(_gate(e, "gate.blocked", F.countDistinct("project_id")), _active_projects(e), "inner", gate_name="gate_name")


@metric("m23_gate_resolution_rate")
def m23(spark, sf_dir):
    """Blocked and resolved counted in one pass; gates without a block are left out."""
    e = named(events(spark, sf_dir, "gate"), "gate.blocked", "gate.resolved").withColumn("gate_name", F.coalesce("gate_name", F.lit("unknown")))
    by = per(e, ["day", "gate_name"], n=F.count_if(F.col("name") == "gate.resolved"), d=F.count_if(F.col("name") == "gate.blocked"))
    return ratio(by.where("d > 0"), gate_name="gate_name")


@metric("m24_gate_median_blocked_seconds")
def m24(spark, sf_dir):
    e = named(events(spark, sf_dir, "gate"), "gate.resolved").withColumn("gate_name", F.coalesce("gate_name", F.lit("unknown")))
    return _percentile(per(e, ["day", "gate_name"], v=F.median("blocked_seconds"), mean=F.avg("blocked_seconds")), gate_name="gate_name")


@metric("m25_rewind_rate")
def m25(spark, sf_dir):
    e = events(spark, sf_dir, "gate")
    back = per(named(e, "workflow.rewound").withColumn("from_stage", F.coalesce("from_stage", F.lit(0))), ["day", "from_stage"], n=F.countDistinct("project_id"))
    return same_day_ratio(back, _active_projects(e), "inner", from_stage="from_stage")


@metric("m26_plan_review_depth_rate")
def m26(spark, sf_dir):
    e = events(spark, sf_dir, "gate")
    opened = per(named(e, "plan.omitted_list_opened").withColumn("origin", F.coalesce("origin", F.lit("unknown"))), ["day", "origin"], n=F.count("*"))
    return same_day_ratio(opened, per(named(e, "plan.reviewed"), ["day"], d=F.count("*")), "inner", origin="origin")


def _planned(e: DataFrame) -> DataFrame:
    return per(named(e, ENTERED).where("state = 'episode_planned'"), ["project_id"], at=F.min("ts")).withColumn("day", iso(F.to_date("at")))


@metric("m27_plan_duration_adjust_rate")
def m27(spark, sf_dir):
    e = events(spark, sf_dir, "flow")
    changed = named(e, "plan.duration_changed").select("project_id").distinct().withColumn("changed", F.lit(1))
    return ratio(per(_planned(e).join(changed, "project_id", "left"), ["day"], n=F.count("changed"), d=F.count("*")))


@metric("m28_plan_duration_increase_share")
def m28(spark, sf_dir):
    e = named(events(spark, sf_dir, "gate"), "plan.duration_changed")
    return ratio(per(e, ["day"], n=F.count_if(F.col("direction") == "up"), d=F.count("*")))


@metric("m29_plan_gate_abandon_rate")
def m29(spark, sf_dir, as_of=IDLE_AS_OF):
    p = _deepest(spark, sf_dir).where("at_five is not null").withColumn("day", iso(F.to_date("at_five")))
    return ratio(per(p, ["day"], n=F.count_if(_idle(as_of) & (F.col("stage") == 5)), d=F.count("*")))


@metric("m30_plan_replan_before_approval")
def m30(spark, sf_dir):
    e = events(spark, sf_dir, "flow")
    again = per(named(e, ENTERED).where("from_state = 'episode_planned' and state = 'episode_planning'"), ["project_id"], n=F.count("*"))
    p = _planned(e).join(again, "project_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _percentile(per(p, ["day"], v=F.median("n"), mean=F.avg("n")))


@metric("m31_source_trace_open_rate")
def m31(spark, sf_dir):
    e = events(spark, sf_dir, "flow")
    return same_day_ratio(per(named(e, "episode.source_trace_opened"), ["day"], n=F.countDistinct("project_id")), per(at_stage(e, LAST_STAGE), ["day"], d=F.countDistinct("project_id")))


@metric("m32_coverage_block_rate")
def m32(spark, sf_dir, gate_name="g2"):
    e = named(events(spark, sf_dir, "gate"), "gate.blocked").where(F.col("gate_name") == gate_name)
    return counted(per(e, ["day"], n=F.countDistinct("project_id")))


@metric("m33_claim_retention_rate")
def m33(spark, sf_dir):
    """Synthetic rows count here."""
    e = named(product_events(spark, sf_dir, "flow"), "corpus.evidence_attempts")
    return ratio(per(e, ["day"], n=F.sum("kept"), d=F.sum("kept") + F.sum("dropped")))


@metric("m34_episodes_per_source_count")
def m34(spark, sf_dir):
    done = at_stage(events(spark, sf_dir, "core"), LAST_STAGE).select("project_id").distinct().withColumn("done", F.col("project_id"))
    c = named(events(spark, sf_dir, "gate"), "gate.corpus_confirmed").join(done, "project_id", "left")
    return ratio(per(c, ["day", "source_count"], n=F.countDistinct("done"), d=F.countDistinct("project_id")), source_count="source_count")


@metric("m35_stage_failure_rate")
def m35(spark, sf_dir):
    e = named(events(spark, sf_dir, "core"), ENTERED, "project.stage_failed")
    by = per(e, ["day", "stage"], n=F.count_if(F.col("name") == "project.stage_failed"), d=F.count_if(F.col("name") == ENTERED))
    return ratio(by.where("d > 0"), stage="stage")


def _same_day_counts(e: DataFrame, top: str, bottom: str) -> DataFrame:
    by = per(named(e, top, bottom), ["day"], n=F.count_if(F.col("name") == top), d=F.count_if(F.col("name") == bottom))
    return ratio(by.where("d > 0"))


@metric("m36_recovery_rate")
def m36(spark, sf_dir):
    return _same_day_counts(events(spark, sf_dir, "flow"), "project.recovered", "project.stage_failed")


@metric("m37_permanent_failure_rate")
def m37(spark, sf_dir):
    e = events(spark, sf_dir, "flow")
    bad = per(named(e, "project.stage_failed").where("permanent"), ["day"], n=F.countDistinct("project_id"))
    return same_day_ratio(bad, per(named(e, "project.created"), ["day"], d=F.countDistinct("project_id")))


@metric("m38_user_visible_failure_rate")
def m38(spark, sf_dir):
    e = events(spark, sf_dir, "core").where("user_id is not null")
    failed = F.when(F.col("name") == "project.stage_failed", F.col("user_id"))
    return ratio(per(e, ["day"], n=F.countDistinct(failed), d=F.countDistinct("user_id")))


def _actives(spark, sf_dir, days, as_of):
    recent = seconds_between(F.col("ts"), F.lit(as_of).cast("timestamp")) <= days * 86400
    e = events(spark, sf_dir, "core").where(F.col("user_id").isNotNull() & recent)
    return counted(e.agg(F.countDistinct("user_id").alias("n")).withColumn("day", F.lit(as_of[:10])))


@metric("m39_wau")
def m39(spark, sf_dir, as_of=ACTIVE_AS_OF):
    return _actives(spark, sf_dir, 7, as_of)


@metric("m40_mau")
def m40(spark, sf_dir, as_of=ACTIVE_AS_OF):
    return _actives(spark, sf_dir, 30, as_of)


@metric("m41_w1_w4_retention", "week")
def m41(spark, sf_dir):
    """The cohort's size comes from a window over it instead of a correlated count."""
    c = cohort(spark, sf_dir).withColumn("d", F.count("*").over(Window.partitionBy("week"))).select("user_id", F.col("week").alias("day"), "d")
    active = events(spark, sf_dir, "core").where("user_id is not null").select("user_id", "week").distinct()
    week_n = F.floor(F.datediff(F.to_date("week"), F.to_date("day")) / 7).cast("int")
    by = c.join(active, "user_id").withColumn("week_n", week_n).where("week_n between 1 and 4")
    out = per(by, ["day", "week_n", "d"], n=F.count("*"))
    return rows(out, F.col("n"), "n", "d", week_n="week_n")


@metric("m42_projects_per_user_p50")
def m42(spark, sf_dir, as_of=ACTIVE_AS_OF):
    recent = seconds_between(F.col("ts"), F.lit(as_of).cast("timestamp")) <= 30 * 86400
    made = named(events(spark, sf_dir, "core"), "project.created").where(F.col("user_id").isNotNull() & recent)
    by = per(made, ["user_id"], n=F.countDistinct("project_id"))
    return _percentile(by.agg(F.median("n").alias("v"), F.avg("n").alias("mean")).withColumn("day", F.lit(as_of[:10])))


@metric("m43_resumption_rate")
def m43(spark, sf_dir, gap_hours=3):
    """Share of created projects that were left for ``gap_hours`` (24 in production) and still finished."""
    e = events(spark, sf_dir, "core").where("project_id is not null")
    gap = seconds_between(F.lag("ts").over(Window.partitionBy("project_id").orderBy("ts")), F.col("ts")) >= gap_hours * 3600
    made = F.when(F.col("name") == "project.created", F.col("ts"))
    done = (F.col("name") == ENTERED) & (F.col("stage") == LAST_STAGE)
    p = per(e.withColumn("gap", gap), ["project_id"], at=F.min(made), both=F.bool_or("gap") & F.bool_or(done)).where("at is not null")
    return ratio(per(p.withColumn("day", iso(F.to_date("at"))), ["day"], n=F.count_if(F.col("both")), d=F.count("*")))


def _cost_per(projects: DataFrame, calls: DataFrame) -> DataFrame:
    costs = per(calls.where("cost_micros is not null"), ["project_id"], cost=F.sum("cost_micros"))
    return ratio(per(projects.join(costs, "project_id", "left"), ["day"], n=F.sum(F.coalesce("cost", F.lit(0))), d=F.count("*")))


@metric("m44_cost_per_completed_episode")
def m44(spark, sf_dir):
    done = per(at_stage(events(spark, sf_dir, "core"), LAST_STAGE), ["project_id"], at=F.min("ts")).withColumn("day", iso(F.to_date("at")))
    return _cost_per(done, model_calls(spark, sf_dir).where("status = 'succeeded'"))


@metric("m45_cost_per_abandoned_project")
def m45(spark, sf_dir, as_of=IDLE_AS_OF):
    left = _deepest(spark, sf_dir).where(_idle(as_of) & (F.col("stage") < LAST_STAGE)).withColumn("day", iso(F.to_date("first")))
    return _cost_per(left, model_calls(spark, sf_dir))


def rollup(spark: SparkSession, sf_dir: str, since: str | None = None) -> DataFrame:
    """All metrics as one table (metric_key, day, dimension_json, value, numerator, denominator); rows with
    a null day or value are left out, and with ``since`` only days from there on are kept."""
    out = None
    for m in METRICS.values():
        part = m.compute(spark, sf_dir).select(F.lit(m.key).alias("metric_key"), "day", "dimension_json", "value", "numerator", "denominator")
        out = part if out is None else out.unionByName(part)
    out = out.where("day is not null and value is not null")
    return out.where(F.col("day") >= since) if since else out


def write_rollup(df: DataFrame, path: str) -> None:
    """Idempotent: only the (metric, day) partitions that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric_key", "day").parquet(path)
