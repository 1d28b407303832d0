"""Command-line parameters, label strings and name templates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtide.functions.text import quote


def _flag(condition: Column, text: str) -> Column:
    return F.when(condition, F.lit(text))


def _worded(option: str, value: Column) -> Column:
    # Emptiness is judged before quoting, so a lone quote still gives ''.
    return F.when(value != "", F.concat(F.lit(option + " "), quote(value)))


def parameter_string(prefix: str = "") -> Column:
    """The tool's arguments for one config row, absent parts left out.

    ``prefix`` names the struct holding the config columns (``"config."``).
    """
    def col(name: str) -> Column:
        return F.col(prefix + name)

    # Options, their order and their file paths.
    parts = [
        F.when(col("min_contig_length") > 1,
               F.concat(F.lit("--min-contig-length "),
                        col("min_contig_length").cast("string"))),
        _flag(col("prodigal_training_file").isNotNull(), "--prodigal /data/prodigal.tf"),
        _flag(col("has_replicons"), "--replicons /data/replicons.tsv"),
        _flag(col("complete_genome"), "--complete"),
        _worded("--locus", col("locus")),
        _worded("--locus-tag", col("locus_tag")),
        _flag(col("keep_contig_headers"), "--keep-contig-headers"),
        _worded("--genus", col("genus")),
        _worded("--species", col("species")),
        _worded("--strain", col("strain")),
        _worded("--plasmid", col("plasmid")),
        _flag(col("compliant"), "--compliant"),
        _flag(col("translation_table") == 4, "--translation-table 4"),
        F.when(col("derm_type") == "MONODERM", "--gram +")
        .when(col("derm_type") == "DIDERM", "--gram -")
        .otherwise("--gram ?"),
    ]
    return F.concat_ws(" ", *parts)


def pairs(mapping: Column) -> Column:
    """Map as a sorted array of ``key=value``."""
    entries = F.transform(
        F.map_entries(mapping),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_sort(entries)


def pair_string(mapping: Column) -> Column:
    """Map as ``k=v,k=v`` in key order."""
    return F.array_join(pairs(mapping), ",")


def template_name(prefix: str, tool_version: str) -> str:
    return f"{prefix}-{tool_version}"


def generate_name(prefix: str, job_id: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), job_id, F.lit("-"))
