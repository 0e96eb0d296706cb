"""Classification of a parsed record into exactly one route."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reasons stored in the dead-letter table.
MISSING_SCHEMA = "missing_schema"
MISSING_VERSION = "missing_version"
SCHEMA_MISMATCH = "schema_mismatch"
UNSUPPORTED_VERSION = "unsupported_version"
DESERIALIZE_ERROR = "deserialize_error"
REQUIRED_NULL = "required_null"
OK = "ok"

REASONS = (
    MISSING_SCHEMA,
    MISSING_VERSION,
    SCHEMA_MISMATCH,
    UNSUPPORTED_VERSION,
    DESERIALIZE_ERROR,
    REQUIRED_NULL,
)


def event_time() -> Column:
    """Timestamp of a parsed record; NULL when the text is not a time."""
    return F.try_to_timestamp(F.col("payload.datetime"))


def first_failure(rules: list[tuple[Column, str]]) -> Column:
    """Name of the first rule that holds, ``ok`` when none does. Never NULL."""
    route = F.lit(OK)
    for broken, reason in reversed(rules):
        route = F.when(F.coalesce(broken, F.lit(False)), F.lit(reason)).otherwise(route)
    return route


def content_rules() -> list[tuple[Column, str]]:
    """Faults that show in the payload alone."""
    return [
        (F.col("payload").isNull(), DESERIALIZE_ERROR),
        (F.col("payload.id").isNull() | F.col("event_time").isNull(), REQUIRED_NULL),
    ]


def record_route(expected: str, max_version: int) -> Column:
    schema, version = F.col("proto_schema"), F.col("proto_version")
    return first_failure(
        [
            (schema.isNull(), MISSING_SCHEMA),
            (version.isNull(), MISSING_VERSION),
            (schema != F.lit(expected), SCHEMA_MISMATCH),
            (version > F.lit(max_version), UNSUPPORTED_VERSION),
            *content_rules(),
        ]
    )


def replay_route(expected: str, accepted: Sequence[str] = ()) -> Column:
    """Route of a stored reject whose stored reason is ``was``.

    Headers other than the schema name are gone, so a version that was refused stays
    refused unless ``accepted`` names the reason.
    """
    schema, was = F.col("schema_name"), F.col("was")

    def still(reason: str) -> tuple[Column, str]:
        return (F.lit(False) if reason in accepted else was == reason), reason

    return first_failure(
        [
            (schema.isNull(), MISSING_SCHEMA),
            still(MISSING_VERSION),
            (schema != F.lit(expected), SCHEMA_MISMATCH),
            still(UNSUPPORTED_VERSION),
            *content_rules(),
        ]
    )
