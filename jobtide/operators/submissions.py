"""Starting jobs: submission manifests out, submission results back in."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.rendering import (
    generate_name, pair_string, pairs, parameter_string, template_name,
)
from jobtide.functions.text import DEFAULT_ORIGIN
from jobtide.functions.times import moment
from jobtide.operators.lookup import match_state
from jobtide.schemas import STATE_COLUMNS


def build_parameters(configs: DataFrame) -> DataFrame:
    """Configs in a ``config`` struct to a rendered ``parameters`` string."""
    return configs.withColumn("parameters", parameter_string("config.")).drop("config")


def plan_submissions(starts: DataFrame, state: DataFrame, prefix: str, tool_version: str,
                     namespace: str, few: bool = False) -> DataFrame:
    """Submission manifest per start: OK, UNAUTHORIZED, or NOOP for an unknown job.

    ``starts`` has ``job_id``, ``secret``, ``config`` and a cleaned ``origin`` (may be
    null). A job that already runs can be started again.
    """
    rendered = build_parameters(starts)
    matched = match_state(rendered, state, ["name"], few)
    ok = F.col("access") == "OK"
    labels = F.create_map(
        F.lit("jobid"), F.col("job_id"),
        F.lit("name"), F.col("state_name"),
        F.lit("secret"), F.col("state_secret"),
        F.lit("origin"), F.coalesce(F.col("origin"), F.lit(DEFAULT_ORIGIN)))
    arguments = F.create_map(
        F.lit("parameter"), F.col("parameters"), F.lit("jobid"), F.col("job_id"))
    kept = [c for c in starts.columns if c not in ("job_id", "secret", "config", "origin")]
    return matched.select(
        *kept, "job_id",
        F.when(F.col("access") == "NOT_FOUND", "NOOP").otherwise(F.col("access")).alias("outcome"),
        F.when(ok, namespace).alias("namespace"),
        F.when(ok, "WorkflowTemplate").alias("resource_kind"),
        F.when(ok, template_name(prefix, tool_version)).alias("resource_name"),
        F.when(ok, generate_name(prefix, F.col("job_id"))).alias("generate_name"),
        F.when(ok, pair_string(labels)).alias("labels"),
        F.when(ok, pairs(arguments)).alias("parameters"))


def submission_documents(plans: DataFrame) -> DataFrame:
    """``(job_id, body)``: the JSON a submitter posts for each accepted start."""
    body = F.struct(
        "namespace",
        F.col("resource_kind").alias("resourceKind"),
        F.col("resource_name").alias("resourceName"),
        F.struct(
            "labels", "parameters",
            F.lit(None).cast("string").alias("serviceAccount"),
            F.col("generate_name").alias("generateName"),
        ).alias("submitOptions"))
    accepted = plans.where("outcome = 'OK'")
    return accepted.select("job_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def apply_submissions(state: DataFrame, results: DataFrame, as_of: Column | datetime,
                      listed: str | None = None) -> DataFrame:
    """State after submissions: name, phase and times of started jobs change, no more.

    ``results`` is ``(pos, job_id, name, creation_timestamp)``; the last one of a job
    counts. If results are kept for longer, name in ``listed`` the state column that says,
    in the order of ``pos``, when a row was listed: a result from before it is spent.
    """
    last = results.groupBy("job_id").agg(
        F.max(F.struct("pos", "name", "creation_timestamp")).alias("submitted"))
    started = F.col("submitted").isNotNull()
    if listed is not None:
        started = started & (F.col(listed).isNull() | (F.col("submitted.pos") > F.col(listed)))
    changed = {
        "workflow_name": F.col("submitted.name"),
        "status": F.lit("Pending"),
        "started": F.col("submitted.creation_timestamp"),
        "updated": moment(as_of),
    }
    return state.join(last, "job_id", "left").select(*[
        F.when(started, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else c
        for c in STATE_COLUMNS])
