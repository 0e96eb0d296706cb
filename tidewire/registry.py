"""Stream and producer registries: one frozen entry per message type."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wire names shared by producers and consumers.
SCHEMA_HEADER = "proto-schema"
VERSION_HEADER = "proto-version"
EVENT_FIELDS = "id BIGINT, datetime STRING, name STRING"
EVENT_TOPIC = "sample-events-event"
NOTIFICATION_TOPIC = "sample-events-notification"
EVENT_TABLE = "sample_events_event"
NOTIFICATION_TABLE = "sample_events_notification"
DLQ_TABLE = "sample_events_dlq"


@dataclass(frozen=True)
class StreamSpec:
    """Everything one ingest stream needs to know.

    ``message`` is the full name of the message in the descriptor set; only the
    Protobuf codecs read it. ``fields`` is the payload as DDL text. ``target``
    is a folder, or a catalog table name when the job writes to a v2 catalog.
    """

    schema_name: str
    topic: str
    target: str
    checkpoint: str
    max_version: int = 1
    message: str = ""
    fields: str = EVENT_FIELDS

    @property
    def query_name(self) -> str:
        return f"consumer-{self.schema_name}"


@dataclass(frozen=True)
class ProducerSpec:
    """One destination topic and the payload it receives.

    ``payload`` maps the index column and the stamp column to a struct column.
    ``message`` is its full name in the descriptor set, as in ``StreamSpec``.
    """

    topic: str
    payload: Callable[[Column, Column], Column]
    schema_name: str
    version: int = 1
    message: str = ""


def event_payload(index: Column, stamp: Column) -> Column:
    return F.struct(
        index.cast("bigint").alias("id"),
        iso_utc(stamp).alias("datetime"),
        F.concat(F.lit("hello from producer #"), index.cast("string")).alias("name"),
    )


def iso_utc(stamp: Column) -> Column:
    """ISO-8601 text with microseconds and a UTC offset."""
    return F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


EVENT_PRODUCER = ProducerSpec(EVENT_TOPIC, event_payload, "Event", 1)


def validate(specs: Sequence[StreamSpec]) -> list[StreamSpec]:
    """Names, topics, targets and checkpoints must all be distinct."""
    if not specs:
        raise ValueError("the registry is empty")
    for s in specs:
        # Schema names become folder names.
        if not re.fullmatch(r"[A-Za-z]\w*", s.schema_name, re.ASCII):
            raise ValueError(f"not a message name: {s.schema_name!r}")
    for field in ("schema_name", "topic", "target", "checkpoint"):
        values = [getattr(s, field).rstrip("/") for s in specs]
        if "" in values:
            raise ValueError(f"{field} must not be empty")
        twice = sorted({v for v in values if values.count(v) > 1})
        if twice:
            raise ValueError(f"{field} used more than once: {', '.join(twice)}")
    points = sorted(s.checkpoint.rstrip("/") + "/" for s in specs)
    for outer, inner in zip(points, points[1:]):
        if inner.startswith(outer):
            raise ValueError(f"checkpoint {inner} lies inside {outer}")
    return list(specs)


def message_name(package: str, schema_name: str) -> str:
    """Full name of a message; without a package there is no descriptor to look it up in."""
    return f"{package}.{schema_name}" if package else ""


def sample_registry(
    tables: str, checkpoints: str, topics: Sequence[str] = (EVENT_TOPIC,), joint: str = "/", package: str = ""
) -> list[StreamSpec]:
    """The sample streams, with tables and folders below ``tables`` and ``checkpoints``.

    ``joint`` is ``.`` when ``tables`` is a catalog and namespace; ``package`` is
    the messages' package in the descriptor set.
    """
    known = {
        EVENT_TOPIC: ("Event", EVENT_TABLE),
        NOTIFICATION_TOPIC: ("Notification", NOTIFICATION_TABLE),
    }
    return validate(
        [
            StreamSpec(
                schema_name=known[t][0],
                topic=t,
                target=f"{tables}{joint}{known[t][1]}",
                checkpoint=f"{checkpoints}/{known[t][0].lower()}",
                message=message_name(package, known[t][0]),
            )
            for t in topics
        ]
    )
