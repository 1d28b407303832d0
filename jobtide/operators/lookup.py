"""Status lookups by (job id, secret)."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.status import is_terminal, public_status
from jobtide.functions.times import moment


def match_state(requests: DataFrame, state: DataFrame, columns: list[str],
                few: bool = False) -> DataFrame:
    """Each request with the given state columns as ``state_*``, and how it is allowed.

    ``access`` is NOT_FOUND, UNAUTHORIZED or OK. The secret is compared after the join,
    because a wrong secret and an unknown job are different answers.

    The join is many-to-one on the job, and adaptive execution splits a job that most
    requests ask for. Say ``few`` for a handful of requests over a large state: the state
    is then thinned to the jobs they name first, by a semi-join that can be broadcast
    where a left join's left side cannot.
    """
    known = state.select("job_id", *[F.col(c).alias(f"state_{c}") for c in ["secret", *columns]])
    if few:
        known = known.join(requests.select("job_id").distinct(), "job_id", "left_semi")
    joined = requests.join(known, "job_id", "left")
    access = (
        F.when(F.col("state_secret").isNull(), "NOT_FOUND")
        .when(F.col("secret").eqNullSafe(F.col("state_secret")), "OK")
        .otherwise("UNAUTHORIZED")
    )
    return joined.withColumn("access", access)


def public_rows(state: DataFrame) -> DataFrame:
    """State as callers see it; jobs that were never started are left out."""
    started = state.where("status is not null and started is not null and updated is not null")
    return started.select(
        "job_id", public_status(F.col("status")).alias("status"), "started", "updated", "name")


def lookup_jobs(requests: DataFrame, state: DataFrame, as_of: Column | datetime,
                few: bool = False) -> DataFrame:
    """One answer per request: OK, NOT_FOUND, UNAUTHORIZED or OMITTED.

    ``requests`` has ``job_id`` and ``secret``; its other columns are kept. OMITTED is a
    known job that was never started. A job still running reports ``as_of`` as its update
    time. ``few`` is that of :func:`match_state`.
    """
    columns = ["status", "started", "updated", "name"]
    matched = match_state(requests, state, columns, few)
    incomplete = (F.col("state_status").isNull() | F.col("state_started").isNull()
                  | F.col("state_updated").isNull())
    outcome = F.when((F.col("access") == "OK") & incomplete, "OMITTED").otherwise(F.col("access"))
    answered = F.col("outcome") == "OK"
    updated = F.when(is_terminal(F.col("state_status")), F.col("state_updated")).otherwise(moment(as_of))
    kept = [c for c in requests.columns if c not in ("job_id", "secret")]
    return matched.withColumn("outcome", outcome).select(
        *kept, "job_id", "outcome",
        F.when(answered, public_status(F.col("state_status"))).alias("status"),
        F.when(answered, F.col("state_started")).alias("started"),
        F.when(answered, updated).alias("updated"),
        F.when(answered, F.col("state_name")).alias("name"))


def found_jobs(answers: DataFrame) -> DataFrame:
    return answers.where("outcome = 'OK'").drop("outcome")


def failed_jobs(answers: DataFrame) -> DataFrame:
    failed = answers.where("outcome in ('NOT_FOUND', 'UNAUTHORIZED')")
    return failed.drop("status", "started", "updated", "name").withColumnRenamed("outcome", "status")
