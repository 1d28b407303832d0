"""Rows used by several tests."""

from datetime import datetime

from jobtide.schemas import STATE_COLUMNS, STATE_SCHEMA

AS_OF = datetime(2024, 5, 1, 12, 0, 0)
START = datetime(2024, 4, 1, 8, 0, 0)
END = datetime(2024, 4, 1, 9, 0, 0)


def job(number: int) -> str:
    return f"00000000-0000-4000-8000-{number:012d}"


def state_row(number, status="Running", **changed):
    row = dict(
        job_id=job(number), remote_uid=job(900 + number), resource_version="1",
        name=f"sample_{number}", status=status, started=START, updated=END,
        workflow_name=f"wf-{number}", secret=f"s{number}", archived=False)
    row.update(changed)
    return tuple(row[c] for c in STATE_COLUMNS)


def state_of(spark, *rows):
    return spark.createDataFrame(list(rows), STATE_SCHEMA)


def requests_of(spark, *rows):
    """Rows of (pos, job number, secret)."""
    return spark.createDataFrame(
        [(pos, job(n), secret) for pos, n, secret in rows],
        "pos long, job_id string, secret string")


def rows_of(df, *columns, order=None):
    picked = df.select(*columns) if columns else df
    rows = [tuple(r) for r in picked.collect()]
    return rows if order == "kept" else sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])
