"""Workflow phases and the public statuses they map to."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtide.schemas import PHASES, TERMINAL_PHASES


def known_phase(phase: Column) -> Column:
    """The phase if it is one of the six exact words, else null."""
    return F.when(phase.isin(PHASES), phase)


def public_status(phase: Column) -> Column:
    # Phase to public status.
    return (
        F.when(phase.isin("Pending", "Init"), "INIT")
        .when(phase == "Running", "RUNNING")
        .when(phase == "Succeeded", "SUCCESSFUL")
        .when(phase.isin("Failed", "Error"), "ERROR")
    )


def is_terminal(phase: Column) -> Column:
    return F.coalesce(phase.isin(TERMINAL_PHASES), F.lit(False))


def results_ready(phase: Column, strict: bool = False) -> Column:
    """True for a finished job; a job with no phase at all passes unless ``strict``."""
    done = F.coalesce(phase == "Succeeded", F.lit(False))
    return done if strict else done | phase.isNull()
