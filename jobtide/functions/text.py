"""Text clean-up: names, origins, quoting, log lines."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a label may not hold, and how long it may be.
UNSAFE_RUN = r"[^0-9a-zA-Z_.]+"
NAME_LIMIT = 63
DEFAULT_ORIGIN = "Unknown"
# Fixed value: marks the workflow runner's own lines inside a log.
RUNNER_MARK = "argo=true"


def clean_name(name: Column) -> Column:
    """Label-safe job name: unsafe runs to ``_``, 63 long, no trailing ``_`` or ``.``.

    The text is ASCII once the runs are replaced, so characters and bytes agree and
    only ``_`` and ``.`` can be left to trim.
    """
    safe = F.regexp_replace(name, UNSAFE_RUN, "_")
    return F.rtrim(F.substring(safe, 1, NAME_LIMIT), F.lit("_."))


def clean_origin(origin: Column) -> Column:
    """Label-safe request origin; null or text outside printable ASCII is unknown."""
    readable = F.when(origin.rlike(r"\A[\x20-\x7e\t]*\z"), origin)
    host = F.regexp_replace(readable, r"\Ahttps://", "")
    return F.coalesce(F.regexp_replace(host, UNSAFE_RUN, "_"), F.lit(DEFAULT_ORIGIN))


def quote(value: Column) -> Column:
    """Single-quoted shell word; quotes inside the value are dropped."""
    mark = F.lit("'")
    return F.concat(mark, F.replace(value, mark, F.lit("")), mark)


def drop_cr(line: Column) -> Column:
    """The line without the ``\\r`` of a ``\\r\\n`` ending."""
    return F.regexp_replace(line, r"\r\z", "")


def has_text(line: Column) -> Column:
    """True unless the line is only Unicode whitespace."""
    return line.rlike(r"(?U)\S")


def is_runner_line(content: Column) -> Column:
    return F.contains(content, F.lit(RUNNER_MARK))
