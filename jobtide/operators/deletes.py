"""Deleting jobs by (job id, secret)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.operators.lookup import match_state
from jobtide.schemas import STATE_COLUMNS


def _first_requests(requests: DataFrame) -> DataFrame:
    """One row per (job, secret), with its first place."""
    return requests.groupBy("job_id", "secret").agg(F.min("pos").alias("deleted_by"))


def mark_deleted(requests: DataFrame, state: DataFrame) -> DataFrame:
    """State with ``deleted_by``: the first request that removes the job, null if none.

    Requests are reduced to one row per (job, secret) before they meet the state.
    """
    first = _first_requests(requests)
    return state.join(first, ["job_id", "secret"], "left").select(*state.columns, "deleted_by")


def remaining_state(marked: DataFrame) -> DataFrame:
    return marked.where("deleted_by is null").select(*STATE_COLUMNS)


def delete_targets(marked: DataFrame, namespace: str) -> DataFrame:
    """What to remove on the workflow server for each deleted job, null if nothing is.

    An archived workflow is named by its uid, a live one by its name.
    """
    # Path formats of the workflow server.
    archived = F.concat(F.lit("/api/v1/archived-workflows/"), F.col("remote_uid"))
    live = F.concat(F.lit(f"/api/v1/workflows/{namespace}/"), F.col("workflow_name"))
    return marked.where("deleted_by is not null").select(
        "job_id", "deleted_by", F.when(F.col("archived"), archived).otherwise(live).alias("delete_path"))


def delete_outcomes(requests: DataFrame, state: DataFrame, few: bool = False) -> DataFrame:
    """Answer per request, as if they were handled in ``pos`` order.

    Deleting an unknown job succeeds, so once a job is gone any secret does. The state is
    only asked for its secrets; ``few`` is that of :func:`match_state`.
    """
    matched = match_state(requests, state, [], few)
    gone = _first_requests(requests).withColumnRenamed("secret", "state_secret")
    joined = matched.join(gone, ["job_id", "state_secret"], "left")
    refused = (
        (F.col("access") == "UNAUTHORIZED")
        & (F.col("deleted_by").isNull() | (F.col("pos") < F.col("deleted_by")))
    )
    return joined.select(
        "pos", "job_id",
        F.when(refused, "UNAUTHORIZED").otherwise("OK").alias("outcome"),
        F.coalesce(F.col("pos") == F.col("deleted_by"), F.lit(False)).alias("removed"))


def delete_jobs(requests: DataFrame, state: DataFrame,
                few: bool = False) -> tuple[DataFrame, DataFrame]:
    """Outcomes per request ``(pos, job_id, secret)``, and the state that is left."""
    left = remaining_state(mark_deleted(requests, state))
    return delete_outcomes(requests, state, few), left
