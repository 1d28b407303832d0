"""Job and workflow identifiers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_HYPHENATED = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
# Plain hex, hyphenated, braced, or URN.
UUID_TEXT = (
    rf"\A(?:[0-9a-fA-F]{{32}}|{_HYPHENATED}|\{{{_HYPHENATED}\}}|urn:uuid:{_HYPHENATED})\z"
)
_CANONICAL = r"\A[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"
_PARTS = r"\A(?:urn:uuid:)?\{?(.{8})-?(.{4})-?(.{4})-?(.{4})-?(.{12})\}?\z"


def canonical_uuid(text: Column) -> Column:
    """Lower-case hyphenated form of any accepted spelling, null for anything else.

    Most ids are canonical as they are written; those are only tested.
    """
    spelled = F.lower(F.regexp_replace(text, _PARTS, "$1-$2-$3-$4-$5"))
    return F.when(text.rlike(_CANONICAL), text).when(text.rlike(UUID_TEXT), spelled)
