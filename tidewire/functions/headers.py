"""Record headers: ``array<struct<key string, value binary>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def header_value(headers: Column | str, key: str) -> Column:
    """Bytes of the first header with this key; NULL when there is none."""
    column = F.col(headers) if isinstance(headers, str) else headers
    return F.get(F.filter(column, lambda h: h["key"] == F.lit(key)), F.lit(0))["value"]


def header_text(headers: Column | str, key: str) -> Column:
    return header_value(headers, key).cast("string")


def header_int(headers: Column | str, key: str) -> Column:
    """Integer text of the first header with this key; NULL when it is not a number."""
    return header_text(headers, key).try_cast("int")


def build_headers(**pairs: Column | str) -> Column:
    """Headers in the order given; ``_`` in a name stands for ``-``."""
    return F.array(
        *[
            F.struct(
                F.lit(name.replace("_", "-")).alias("key"),
                (F.lit(v) if isinstance(v, str) else v).cast("string").cast("binary").alias("value"),
            )
            for name, v in pairs.items()
        ]
    )
