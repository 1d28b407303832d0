"""Table shapes and the fixed words shared by every module."""

from pyspark.sql import types as T

# Workflow phases, in the order a job normally moves through them.
PHASES = ["Pending", "Init", "Running", "Succeeded", "Failed", "Error"]
# Phases after which a job no longer changes.
TERMINAL_PHASES = ["Error", "Succeeded", "Failed"]
# Label keys read from a workflow.
LABEL_JOB_ID = "jobid"
LABEL_NAME = "name"
LABEL_SECRET = "secret"
LABEL_ARCHIVED = "workflows.argoproj.io/workflow-archiving-status"
# Stand-ins for labels that are absent.
DEFAULT_SECRET = "Unknown"
DEFAULT_NAME = "Unknown name"

STATE_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("remote_uid", T.StringType()),
    T.StructField("resource_version", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("started", T.TimestampType()),
    T.StructField("updated", T.TimestampType()),
    T.StructField("workflow_name", T.StringType()),
    T.StructField("secret", T.StringType()),
    T.StructField("archived", T.BooleanType()),
])
STATE_COLUMNS = STATE_SCHEMA.fieldNames()
STATE_VALUES = [c for c in STATE_COLUMNS if c != "job_id"]
