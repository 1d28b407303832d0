"""Strict JSON field checks over variant values.

A schema-driven reader turns numbers into text and cannot tell a null from a missing
field; a variant keeps the written type, so both can be checked.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_document(text: Column) -> Column:
    """The text as a variant array of one element, null if malformed.

    The brackets make anything after the document a syntax error or a second element.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))


def is_whole(document: Column) -> Column:
    """True if the parsed text was exactly one document."""
    first = F.try_variant_get(document, "$[0]", "variant")
    second = F.try_variant_get(document, "$[1]", "variant")
    return first.isNotNull() & second.isNull()


def field(document: Column, path: str) -> Column:
    return F.try_variant_get(document, "$[0]" + path, "variant")


def kind(value: Column) -> Column:
    """Written type: STRING, BIGINT, BOOLEAN, ..., VOID for null, SQL null if missing."""
    return F.schema_of_variant(value)


def text_of(value: Column) -> Column:
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))
